"""Logging of the engine: one handler, the level by TRACEWELL_LOG_LEVEL, durations of operations and tools."""

from __future__ import annotations

import logging
import os
import sys
import time
from collections.abc import Iterator
from contextlib import contextmanager
from typing import TextIO

NAME = "tracewell"
_FORMAT = "%(asctime)s %(levelname)s %(name)s %(message)s"


def set_up(level: str | None = None, stream: TextIO | None = None) -> logging.Logger:
    """The package's logger with exactly one handler, whatever was set up before; an unknown level counts as INFO."""
    logger = logging.getLogger(NAME)
    number = logging.getLevelName((level or os.environ.get("TRACEWELL_LOG_LEVEL") or "INFO").upper())
    logger.setLevel(number if isinstance(number, int) else logging.INFO)
    handler = logging.StreamHandler(stream or sys.stderr)
    handler.setFormatter(logging.Formatter(_FORMAT))
    logger.handlers[:] = [handler]
    logger.propagate = False
    return logger


@contextmanager
def timed(what: str, logger: logging.Logger | None = None) -> Iterator[dict]:
    """Logs how long the block took and how it ended; what the block puts into the dict is logged too."""
    logger, said, began = logger or logging.getLogger(NAME), {}, time.perf_counter()
    logger.debug("%s begins", what)
    try:
        yield said
    except Exception as e:
        logger.error("%s failed after %.2f s: %s", what, time.perf_counter() - began, e)
        raise
    logger.info("%s took %.2f s%s", what, time.perf_counter() - began, "".join(f", {k} {v}" for k, v in said.items()))


def pace(done: int, total: int, seconds: float) -> str:
    """``12.5 files/s, 40 s left``; empty before anything is done."""
    if done <= 0 or seconds <= 0:
        return ""
    rate = done / seconds
    left = (total - done) / rate
    return f"{rate:.1f} files/s" + (f", {left:.0f} s left" if 0 < left < 60 else f", {left / 60:.0f} min left" if left >= 60 else "")
