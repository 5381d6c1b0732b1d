"""Thai normalization as built-in column expressions: one Project, no Python.

Each step takes and returns a Column, so steps can be used and tested alone. NULL stays NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from segspark import charsets as C


def number_space(c: Column) -> Column:
    """One space on each side of every run of ASCII digits."""
    return F.regexp_replace(c, "([0-9]+)", " $1 ")


def zero_width(c: Column) -> Column:
    return F.replace(c, F.lit(C.ZERO_WIDTH_SPACE), F.lit(""))


def collapse_whitespace(c: Column) -> Column:
    """Runs of spaces, then of tabs, then of newlines become one."""
    for x in " \t\n":
        c = F.regexp_replace(c, f"{x}{{2,}}", x)
    return c


def reorder(c: Column, compat: str = "corrected") -> Column:
    """Marks in canonical order. ``reference`` writes the literal group names that the reference writes."""
    if compat not in ("corrected", "reference"):
        raise ValueError(f"compat must be 'corrected' or 'reference', not {compat!r}")
    for match, corrected, literal in C.REORDER:
        parts = corrected if compat == "corrected" else literal
        c = F.regexp_replace(c, match, "".join(f"${p}" if isinstance(p, int) else p.replace("\\", "\\\\") for p in parts))
    return c


def collapse_marks(c: Column) -> Column:
    return F.regexp_replace(c, f"([{C.COLLAPSING}])\\1+", "$1")


def normalize(col: Column | str, whitespace_number: bool = True, compat: str = "corrected") -> Column:
    c = F.col(col) if isinstance(col, str) else col
    if whitespace_number:
        c = number_space(c)
    return collapse_marks(reorder(collapse_whitespace(zero_width(c)), compat))
