"""Logging of the library: one logger, quiet unless the application says otherwise, with a level below DEBUG for trees."""

from __future__ import annotations

import logging

TRACE = 5
logging.addLevelName(TRACE, "TRACE")
log = logging.getLogger("cauza")
log.addHandler(logging.NullHandler())


def set_level(level: int | str) -> None:
    """A number, or a name such as ``INFO`` or ``TRACE``."""
    log.setLevel(level if isinstance(level, int) else logging.getLevelNamesMapping()[level.upper()])


def trace(message: str, *args) -> None:
    log.log(TRACE, message, *args)
