"""Logging under one name, plain or as JSON lines."""

from __future__ import annotations

import json
import logging

ROOT = "metrikon"
_PLAIN = frozenset(vars(logging.makeLogRecord({}))) | {"message", "asctime"}


class JsonFormatter(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        own = {"time": self.formatTime(record), "level": record.levelname, "logger": record.name, "message": record.getMessage()}
        own |= {k: v for k, v in vars(record).items() if k not in _PLAIN}
        if record.exc_info:
            own["exception"] = self.formatException(record.exc_info)
        return json.dumps(own, default=str)


def get_logger(name: str = "") -> logging.Logger:
    return logging.getLogger(name if name.split(".")[0] == ROOT else f"{ROOT}.{name}".rstrip("."))


def configure_logging(*, level: int | str = "INFO", structured: bool = False, force: bool = False) -> None:
    """Give the library's logger a handler; an existing one stays unless ``force`` is set."""
    root = logging.getLogger(ROOT)
    if root.handlers and not force:
        root.setLevel(level)
        return
    handler = logging.StreamHandler()
    handler.setFormatter(JsonFormatter() if structured else logging.Formatter("%(asctime)s %(levelname)s %(name)s %(message)s"))
    root.handlers[:] = [handler]
    root.setLevel(level)
