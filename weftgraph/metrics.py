"""Timers by name, and the library's logger."""

from __future__ import annotations

import logging
import time
from collections.abc import Iterator
from contextlib import contextmanager

_LOGGER = logging.getLogger("weftgraph")


def log(message: str) -> None:
    """A line for whoever listens to the logger "weftgraph" at level INFO."""
    _LOGGER.info(message)


class Timers:
    """Seconds by name, added up over all spans of a name."""

    def __init__(self):
        self.seconds: dict[str, float] = {}

    @contextmanager
    def span(self, name: str) -> Iterator[None]:
        begin = time.perf_counter()
        try:
            yield
        finally:
            self.seconds[name] = self.seconds.get(name, 0.0) + time.perf_counter() - begin

    def reset(self, name: str) -> None:
        self.seconds.pop(name, None)

    def report(self) -> str:
        return ", ".join(f"{n}: {s:.3f} s" for n, s in self.seconds.items())
