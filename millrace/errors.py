"""Settings, leveled log and a bounded ring of errors."""

from __future__ import annotations

import logging
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field
from threading import Lock

LEVELS = ("debug", "info", "warning", "fatal")
#: Errors that are kept; older ones make room.
CAPACITY = 1536
log = logging.getLogger("millrace")


@dataclass(frozen=True)
class ErrorInfo:
    level: str
    package: str
    function: str
    message: str


@dataclass
class Config:
    log_level: str = "info"
    colored: bool = True
    dont_panic: bool = False
    handler: Callable[[ErrorInfo], None] | None = None


@dataclass
class Ring:
    """First in, first out; at most ``capacity`` entries."""

    capacity: int = CAPACITY
    items: deque = field(default_factory=deque)
    lock: Lock = field(default_factory=Lock)

    def push(self, e: ErrorInfo) -> None:
        with self.lock:
            if len(self.items) == self.capacity:
                self.items.popleft()
            self.items.append(e)

    def pop(self, last: bool = False, where: Callable[[ErrorInfo], bool] = lambda e: True) -> ErrorInfo | None:
        """Take out the first, or last, entry that fits."""
        with self.lock:
            for e in reversed(self.items) if last else self.items:
                if where(e):
                    self.items.remove(e)
                    return e
        return None

    def pop_all(self) -> list[ErrorInfo]:
        with self.lock:
            out = list(self.items)
            self.items.clear()
            return out

    def all(self, where: Callable[[ErrorInfo], bool] = lambda e: True) -> list[ErrorInfo]:
        return [e for e in list(self.items) if where(e)]


config, errors = Config(), Ring()


def report(level: str, package: str, function: str, message: str) -> None:
    """Log, remember, and for a fatal error raise unless the settings say not to."""
    e = ErrorInfo(level, package, function, message)
    if LEVELS.index(level) >= LEVELS.index(config.log_level):
        getattr(log, "critical" if level == "fatal" else level)("[%s.%s] %s", package, function, message)
    if level in ("warning", "fatal"):
        errors.push(e)
        if config.handler:
            config.handler(e)
    if level == "fatal" and not config.dont_panic:
        raise RuntimeError(message)


def has_error_above(level: str) -> bool:
    return bool(errors.all(lambda e: LEVELS.index(e.level) > LEVELS.index(level)))
