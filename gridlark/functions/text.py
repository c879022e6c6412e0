"""Text rules: blank query text and safe names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters of a safe name; a character that makes a query text non-blank (white
# space includes the separators 1C to 1F); white space that clients strip from a text (the byte
# order mark is stripped, the next-line sign is not).
SAFE_NAME = r"[a-zA-Z0-9_.]+"
VISIBLE = r"(?U)[^\s\x1C-\x1F]"
EDGE_SPACE = r"(?U)^[\s\uFEFF&&[^\x85]]+|[\s\uFEFF&&[^\x85]]+\z"


def has_text(col: Column) -> Column:
    """True where the text holds something besides white space of any kind."""
    return F.coalesce(col.rlike(VISIBLE), F.lit(False))


def stripped(col: Column) -> Column:
    """Text without white space of any kind at both ends."""
    return F.regexp_replace(col, EDGE_SPACE, "")


def valid_identifier(col: Column) -> Column:
    """True for names of letters, digits, underscores and dots, end to end."""
    return F.coalesce(col.rlike(rf"^{SAFE_NAME}\z"), F.lit(False))


def full_name(catalog: Column, namespace: Column, name: Column) -> Column:
    """``catalog.namespace.name`` where all three parts are safe, else null."""
    safe = valid_identifier(catalog) & valid_identifier(namespace) & valid_identifier(name)
    return F.when(safe, F.concat_ws(".", catalog, namespace, name))


def checked_name(*parts: str) -> str:
    """The parts as one dotted name for a statement; an unsafe part is refused."""
    for part in parts:
        if not re.fullmatch(SAFE_NAME, part):
            raise ValueError(f"not a safe name: {part!r}")
    return ".".join(parts)
