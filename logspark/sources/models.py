"""Fitted models on disk: SVD and scaler, the model grid, the sequence models.

A model is a folder of Parquet tables and one JSON line of parameters, in any store Spark
writes to. What grows with the data (neighbour points, node tables, patterns) goes from
executors to the store and back; only matrices bounded by parameters (components, landmarks,
weights) pass the driver. A loaded model scores as the fitted one does.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..operators.forest import Forest
from ..operators.grid import ModelGrid
from ..operators.oneclass import OneClass
from ..operators.sequence import SequenceModel
from .stores import load_table, save_tables


def save_parameters(spark: SparkSession, path: str, parameters: dict) -> None:
    row = [(json.dumps(parameters),)]
    spark.createDataFrame(row, "value string").coalesce(1).write.mode("overwrite").text(f"{path}/parameters")


def load_parameters(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/parameters").first()["value"])


def save_matrix(spark: SparkSession, path: str, name: str, rows) -> None:
    """A matrix, or vectors of different lengths, one row each."""
    table = pa.table({
        "row": pa.array(range(len(rows)), pa.int64()),
        "values": pa.array([np.asarray(r, float) for r in rows], pa.list_(pa.float64()))})
    save_tables(path, **{name: spark.createDataFrame(table)})


def load_matrix(spark: SparkSession, path: str, name: str):
    """An array, or a list of arrays if their lengths differ."""
    found = load_table(spark, path, name).orderBy("row").toArrow()
    rows = [values.values.to_numpy() for values in found["values"]]
    return np.stack(rows) if len({len(r) for r in rows}) == 1 else rows


def save_svd(spark: SparkSession, path: str, components: np.ndarray, values: np.ndarray, scaler: DataFrame) -> None:
    """What ``svd_components`` and ``scaler_fit`` gave."""
    save_matrix(spark, path, "components", components)
    save_matrix(spark, path, "singular_values", [values])
    save_tables(path, scaler=scaler)


def load_svd(spark: SparkSession, path: str) -> tuple[np.ndarray, np.ndarray, DataFrame]:
    return (load_matrix(spark, path, "components"), load_matrix(spark, path, "singular_values")[0],
            load_table(spark, path, "scaler"))


def _save_one_class(spark: SparkSession, path: str, model: OneClass) -> None:
    maps = [(kernel, name, float(gamma)) for (kernel, name), (gamma, _) in model.maps.items()]
    save_parameters(spark, path, {
        "maps": maps, "configs": [list(c) for c in model.configs], "passes": int(model.passes),
        "converged": [bool(x) for x in model.converged]})
    save_matrix(spark, path, "landmarks", model.landmarks)
    for i, (_, white) in enumerate(model.maps.values()):
        save_matrix(spark, path, f"map_{i}", white)
    save_matrix(spark, path, "weights", model.weights)
    save_matrix(spark, path, "borders", [model.rho, model.gap])


def _load_one_class(spark: SparkSession, path: str) -> OneClass:
    known = load_parameters(spark, path)
    maps = {(kernel, name): (gamma, load_matrix(spark, path, f"map_{i}"))
            for i, (kernel, name, gamma) in enumerate(known["maps"])}
    rho, gap = load_matrix(spark, path, "borders")
    return OneClass(
        load_matrix(spark, path, "landmarks"), maps, [tuple(c) for c in known["configs"]],
        load_matrix(spark, path, "weights"), rho, gap, np.array(known["converged"]), known["passes"])


def save_grid(path: str, grid: ModelGrid) -> None:
    """Forests, neighbour points and references, one-class models and offsets."""
    spark = grid.offsets.sparkSession
    save_parameters(spark, path, {
        "key": grid.key, "shares": list(grid.forests), "neighbours": list(grid.references)})
    for i, forest in enumerate(grid.forests.values()):
        forest.save(f"{path}/forest_{i}")
    save_tables(path, points=grid.points, offsets=grid.offsets, **{
        f"reference_{k}": reference for k, reference in grid.references.items()})
    _save_one_class(spark, f"{path}/one_class", grid.one_class)


def load_grid(spark: SparkSession, path: str) -> ModelGrid:
    known = load_parameters(spark, path)
    return ModelGrid(
        known["key"],
        {share: Forest.load(spark, f"{path}/forest_{i}") for i, share in enumerate(known["shares"])},
        load_table(spark, path, "points"),
        {k: load_table(spark, path, f"reference_{k}") for k in known["neighbours"]},
        _load_one_class(spark, f"{path}/one_class"), load_table(spark, path, "offsets"))


def save_sequence_model(path: str, model: SequenceModel) -> None:
    save_parameters(model.runs.sparkSession, path, {
        "length": model.length, "weights": list(model.weights), "threshold": model.threshold})
    save_tables(path, runs=model.runs, vocabulary=model.vocabulary, patterns=model.patterns)


def load_sequence_model(spark: SparkSession, path: str) -> SequenceModel:
    known = load_parameters(spark, path)
    return SequenceModel(
        *[load_table(spark, path, name) for name in ("runs", "vocabulary", "patterns")],
        known["length"], tuple(known["weights"]), known["threshold"])
