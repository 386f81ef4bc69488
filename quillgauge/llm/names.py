"""Names for columns that an operator adds for its own use."""

from __future__ import annotations

from collections.abc import Iterable


def fresh(name: str, columns: Iterable[str]) -> str:
    """``name``, lengthened until no column has it (names differ in more than case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(columns: Iterable[str]) -> list[str]:
    """Columns as they are named, dots included."""
    return [f"`{c}`" for c in columns]
