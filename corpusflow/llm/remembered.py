"""Tables that a Python worker remembers between tasks, one at a time.

A worker serves the stages of a pipeline one after another. The first use of a
table empties the one in use before, so that the worker holds the largest of
them and not all together.
"""

from __future__ import annotations

_IN_USE: list[dict] = []


def use(table: dict) -> dict:
    """The table, after any other one was emptied."""
    if not _IN_USE or _IN_USE[0] is not table:
        for other in _IN_USE:
            other.clear()
        _IN_USE[:] = [table]
    return table
