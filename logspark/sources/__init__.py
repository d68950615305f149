"""Reading log files and label files; writing scored logs, metrics and models."""
