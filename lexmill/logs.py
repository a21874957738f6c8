"""Log records as JSON lines, which ``spark.read.json`` reads back."""

from __future__ import annotations

import json
import logging
from datetime import UTC, datetime


class JsonFormatter(logging.Formatter):
    """One object a record: time, level, logger, message, place, error, and what ``extra`` gave."""

    _OWN = frozenset(vars(logging.makeLogRecord({}))) | {"message", "asctime"}

    def format(self, record: logging.LogRecord) -> str:
        out = {
            "timestamp": datetime.fromtimestamp(record.created, UTC).isoformat(),
            "level": record.levelname,
            "logger": record.name,
            "message": record.getMessage(),
            "place": f"{record.module}:{record.funcName}:{record.lineno}",
        }
        if record.exc_info:
            out["error"] = self.formatException(record.exc_info)
        out.update({k: v for k, v in vars(record).items() if k not in self._OWN})
        return json.dumps(out, ensure_ascii=False, default=str)


def log_to(path: str | None = None, level: int = logging.INFO, name: str = "lexmill") -> logging.Logger:
    """The library's logger with JSON lines on a file or, without one, on standard error."""
    handler = logging.FileHandler(path, encoding="utf-8") if path else logging.StreamHandler()
    handler.setFormatter(JsonFormatter())
    logger = logging.getLogger(name)
    logger.handlers[:] = [handler]
    logger.setLevel(level)
    return logger
