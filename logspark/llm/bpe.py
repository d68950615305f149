"""Byte-level BPE by backtracking over longest matches.

The vocabulary is a rank file (token in base64, rank). Bytes are mapped to Latin-1, so that
an Aho-Corasick automaton over strings finds tokens; at each place it gives the longest
token. A token may follow another only if merging the two by rank would leave their border
alone; that is decided from the tokens' own merges and remembered. Where the longest token
does not fit, shorter prefixes are tried, then the previous token is taken back. Each place
is given up at most once, so the time is linear, and the result is what merging the lowest
ranks first gives.

Nulls and edge cases: a null text is an empty one; an empty text has no tokens; texts of any
length are encoded whole; repeated rows and extra columns pass through.
"""

from __future__ import annotations

import base64
from hashlib import sha256

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .common import slices, unused

# Entries of a generation of a worker's memories of pieces and chunks, of under 70 MB; twice
# as many for pairs and for whole round trips.
REMEMBERED = 150_000
ROWS = 256  # texts handled together
# A space at an end of the text or beside other white space.
BLANKS = regex.compile(r"^ | $| \s|\s ").search


class Memory:
    """Remembers the values of a function for up to two generations of keys.

    ``young`` may be read directly. When it is full it becomes the old generation; what is
    asked for again moves back, so frequent keys stay and rare ones are forgotten.
    """

    def __init__(self, make, most: int = REMEMBERED):
        self.make, self.most, self.young, self.old = make, most, {}, {}

    def __call__(self, key):
        made = self.young.get(key)
        if made is None:
            made = self.old.get(key)
            if made is None:
                made = self.make(key)
            if len(self.young) >= self.most:
                self.old, self.young = self.young, {}
            self.young[key] = made
        return made


class Encoder:
    """Encodes and decodes with one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leads: bool = True):
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.token = {rank: token for token, rank in ranks.items()}
        self.size = {rank: len(token) for token, rank in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (len(token) - 1, rank))
        self.automaton.make_automaton()
        self.shorter = {rank: self._prefix(token) for token, rank in ranks.items()}
        self.joined: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        for rank in sorted(self.token):
            self._learn(rank)
        self.fits = Memory(lambda pair: self._apart(pair >> 32, pair & 0xFFFFFFFF), 2 * REMEMBERED)
        self.known = Memory(lambda piece: self.piece(piece.encode()))
        self.coded = Memory(self._ids)
        self.rounds = Memory(self._round, 2 * REMEMBERED)
        self.leads = leads

    def _prefix(self, token: bytes) -> int | None:
        """The longest token that begins this one and is shorter."""
        for end in range(len(token) - 1, 0, -1):
            if (rank := self.ranks.get(token[:end])) is not None:
                return rank
        return None

    def _learn(self, rank: int) -> None:
        """Find the merge that makes a token: the split whose halves stay apart until then."""
        token, left = self.token[rank], self.shorter[rank]
        while left is not None:
            right = self.ranks.get(token[self.size[left]:])
            if right is not None and left < rank and right < rank and self._apart(left, right):
                self.joined[left, right] = rank
                self.halves[rank] = (left, right)
                return
            left = self.shorter[left]

    def _apart(self, one: int, two: int) -> bool:
        """Whether merging the bytes of two tokens gives these two tokens again.

        Undoes merges at the border, the latest first. A merge across the border that comes
        before the one undone last would have happened.
        """
        limit, joined, halves = float("inf"), self.joined, self.halves
        while True:
            across = joined.get((one, two))
            if across is not None and across < limit:
                return False
            # The later merge is undone first; of equal ones the right, made last.
            order = ((0, one), (1, two)) if one > two else ((1, two), (0, one))
            for right, token in order:
                limit = token + right
                if token in halves:
                    break
            else:
                return True  # both are single bytes
            if right:
                two = halves[two][0]
            else:
                one = halves[one][1]

    def may_follow(self, one: int, two: int) -> bool:
        """Memoised adjacent-token compatibility."""
        return self.fits(one << 32 | two)

    def _longest(self, data: str) -> list[int]:
        """The longest token at each place."""
        best = [-1] * len(data)
        for end, (before, rank) in self.automaton.iter(data):
            best[end - before] = rank  # matches come by rising end, so the last is the longest
        return best

    def piece(self, data: bytes) -> tuple[int, ...]:
        """The tokens of one piece."""
        if (whole := self.ranks.get(data)) is not None:
            return (whole,)
        best, size, shorter = self._longest(data.decode("latin-1")), self.size, self.shorter
        fits, known = self.fits, self.fits.young.get
        end, at, out, last = len(data), 0, [], -1
        open_ = bytearray(b"\x01") * (end + 1)  # places that were not given up
        token = best[0]
        while at < end:
            if token is None:  # nothing fits here: give the place up, shorten what led to it
                open_[at] = 0
                token = out.pop()
                last = out[-1] if out else -1
                at -= size[token]
                token = shorter[token]
                continue
            to = at + size[token]
            fit = open_[to]
            if fit and last >= 0:
                fit = known(last << 32 | token)
                if fit is None:
                    fit = fits(last << 32 | token)
            if fit:
                out.append(token)
                last, at = token, to
                token = best[at] if at < end else None
            else:
                token = shorter[token]
        return tuple(out)

    def pieces(self, text: str) -> list[tuple[int, ...]]:
        """The tokens of each match of the pattern."""
        known = self.known
        return [known(m) if len(m) <= 64 else self.piece(m.encode()) for m in self.find(text)]

    def chunks(self, text: str | None) -> list[str]:
        """The text cut where a piece must begin.

        In the published patterns a space only begins a piece or lies among other white
        space. So a single space between two other characters always begins a piece.
        """
        if not text:
            return []
        if not self.leads or BLANKS(text):
            return [text]
        parts = text.split(" ")
        return [parts[0], *[" " + part for part in parts[1:]]]

    def _ids(self, chunk: str) -> tuple[int, ...]:
        # In the published patterns letters with at most a space before them are one piece.
        if self.leads and chunk[chunk[0] == " ":].isalpha():
            return self.piece(chunk.encode())
        return tuple([rank for piece in self.pieces(chunk) for rank in piece])

    def _round(self, chunk: str) -> tuple:
        ids = self._ids(chunk)
        return len(ids), ",".join(map(str, ids)), self.decode(ids)

    def _each(self, text: str | None, memory: Memory, make) -> list:
        get = memory.young.get
        return [get(c) or (memory(c) if len(c) <= 64 else make(c)) for c in self.chunks(text)]

    def encode(self, text: str | None) -> list[int]:
        return [rank for ids in self._each(text, self.coded, self._ids) for rank in ids]

    def round_trip(self, text: str | None) -> list[tuple]:
        """(number of ids, ids as text, decoded ids) of each chunk."""
        return self._each(text, self.rounds, self._round)

    def gives_back(self, text: str | None, ids) -> bool:
        """Whether decoding the ids gives the text; a null text is an empty one."""
        return self.decode(ids) == (text or "").encode()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


def read_ranks(data: bytes) -> dict[bytes, int]:
    """A rank file's lines: token in base64, rank."""
    return {base64.b64decode(t): int(r) for t, r in map(bytes.split, data.splitlines()) if t}


def _shared(df: DataFrame, path: str, pattern: str):
    """The vocabulary file as a broadcast; a worker builds its encoder once.

    The file is the driver's, of fixed size (under 1 MB for 50,000 tokens).
    """
    with open(path, "rb") as file:
        data = file.read()
    return df.sparkSession.sparkContext.broadcast({"ranks": data, "pattern": pattern})


def _encoder(shared) -> Encoder:
    state = shared.value  # one object for all tasks of a worker process
    if "encoder" not in state:
        state["encoder"] = Encoder(read_ranks(state["ranks"]), state["pattern"])
    return state["encoder"]


def encode(
    df: DataFrame, text: str, path: str, pattern: str, name: str = "ids", back: str | None = None
) -> DataFrame:
    """All columns and the token ids as an array column. ``back`` names a further column:
    whether the ids, decoded, are the text."""
    shared = _shared(df, path, pattern)
    columns = [c for c in df.columns if c not in (name, back)]
    added = [name, *([back] if back else [])]

    def work(batches):
        encoder = _encoder(shared)
        for batch in slices(batches, ROWS):
            texts = batch.column(batch.num_columns - 1).to_pylist()
            made = [encoder.encode(t) for t in texts]
            ends = np.cumsum([0, *map(len, made)])
            flat = np.fromiter((i for ids in made for i in ids), np.int32, int(ends[-1]))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))]
            if back:
                lists.append(pa.array([encoder.gives_back(t, ids) for t, ids in zip(texts, made)], pa.bool_()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *lists], [*batch.schema.names[:-1], *added])

    kept = df.select(*columns, F.col(text).alias(unused(df, "_text")))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema[:-1]]
    fields += [f"`{name}` array<int>", *([f"`{back}` boolean"] if back else [])]
    return kept.mapInArrow(work, ", ".join(fields))


def decode(df: DataFrame, ids: str, path: str, pattern: str, name: str = "decoded") -> DataFrame:
    """All columns and the decoded bytes of an array of token ids; null for null."""
    shared = _shared(df, path, pattern)
    columns = [c for c in df.columns if c != name]

    def work(batches):
        encoder = _encoder(shared)
        for batch in slices(batches, ROWS):
            made = [None if i is None else encoder.decode(i) for i in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(made, pa.binary())], [*batch.schema.names[:-1], name])

    kept = df.select(*columns, F.col(ids).alias(unused(df, "_ids")))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema[:-1]]
    return kept.mapInArrow(work, ", ".join([*fields, f"`{name}` binary"]))


def digests(df: DataFrame, key: str, text: str, path: str, pattern: str) -> DataFrame:
    """Encode, decode the ids, and keep only counts and digests of both."""
    shared = _shared(df, path, pattern)

    def work(batches):
        encoder = _encoder(shared)
        for batch in slices(batches, ROWS):
            counts, coded, decoded = [], [], []
            for text in batch.column(1).to_pylist():
                chunks = encoder.round_trip(text)
                counts.append(sum([n for n, _, _ in chunks]))
                joined = ",".join([said for _, said, _ in chunks])
                coded.append(sha256(joined.encode()).hexdigest())
                decoded.append(sha256(b"".join([back for _, _, back in chunks])).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(coded, pa.string()),
                 pa.array(decoded, pa.string())],
                [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.col(text).alias("_text")).mapInArrow(
        work, f"`{key}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
