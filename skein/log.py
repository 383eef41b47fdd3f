"""Logging of the engine: one logger a module, below "skein"; warnings and worse are shown unless told otherwise."""

from __future__ import annotations

import logging

LEVELS = {0: logging.DEBUG, 1: logging.INFO, 2: logging.WARNING, 3: logging.ERROR}
DEFAULT = 2
logging.getLogger("skein").addHandler(logging.NullHandler())


def logger(name: str) -> logging.Logger:
    return logging.getLogger(name if name.startswith("skein") else f"skein.{name}")


def show(level: int = DEFAULT, stream=None) -> logging.Handler:
    """Writes what is at least of a level (0 debug to 3 error) to stream, stderr by default."""
    handler = logging.StreamHandler(stream)
    handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
    root = logging.getLogger("skein")
    for h in [h for h in root.handlers if isinstance(h, logging.StreamHandler)]:
        root.removeHandler(h)
    root.addHandler(handler)
    root.setLevel(LEVELS[level])
    return handler
