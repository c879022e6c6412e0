"""Column names that cannot clash with those of the input."""

from __future__ import annotations

from collections.abc import Iterable


def fresh(columns: Iterable[str], *wanted: str) -> list[str]:
    """The wanted names, each with as many underscores in front as make it new.

    Spark compares names without case, so this does as well.
    """
    taken = {c.lower() for c in columns}
    names = []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        names.append(name)
    return names
