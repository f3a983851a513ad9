"""A producer of logs that the parser reads fully: JSON lines with a correlation id from the context."""

from __future__ import annotations

import json
import logging
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from datetime import UTC, datetime
from uuid import uuid4

_correlation: ContextVar[str | None] = ContextVar("correlation_id", default=None)
_PLAIN = set(logging.LogRecord("", 0, "", 0, "", (), None).__dict__) | {"message", "asctime", "taskName", "correlation_id"}


@contextmanager
def correlation_context(correlation_id: str | None = None) -> Iterator[str]:
    """Records inside carry the id; the outer one is back afterwards."""
    own = correlation_id or f"req-{uuid4().hex[:12]}"
    token = _correlation.set(own)
    try:
        yield own
    finally:
        _correlation.reset(token)


def current_correlation() -> str | None:
    return _correlation.get()


class CorrelationFilter(logging.Filter):
    def filter(self, record: logging.LogRecord) -> bool:
        if getattr(record, "correlation_id", None) is None:
            record.correlation_id = _correlation.get()
        return True


class JsonFormatter(logging.Formatter):
    def __init__(self, service: str | None = None) -> None:
        super().__init__()
        self.service = service

    def format(self, record: logging.LogRecord) -> str:
        out = {"timestamp": datetime.fromtimestamp(record.created, UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z"), "level": record.levelname, "message": record.getMessage(), "thread": record.threadName, "logger": record.name}
        if self.service:
            out["service"] = self.service
        if found := getattr(record, "correlation_id", None) or _correlation.get():
            out["correlation_id"] = found
        out |= {k: v for k, v in record.__dict__.items() if k not in _PLAIN}
        if record.exc_info:
            out["exception"] = self.formatException(record.exc_info)
        return json.dumps(out, ensure_ascii=False, default=str)


class JsonHandler(logging.FileHandler):
    def __init__(self, path: str, service: str | None = None) -> None:
        super().__init__(path, encoding="utf-8")
        self.setFormatter(JsonFormatter(service))
        self.addFilter(CorrelationFilter())
