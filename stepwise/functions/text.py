"""Text helpers with Python ``str`` semantics, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.isspace() accepts.
_WS_RANGES = [(0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680),
              (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)]
PY_WS_CHARS = "".join(chr(c) for a, b in _WS_RANGES for c in range(a, b + 1))


def py_strip(c: Column) -> Column:
    """``str.strip()``: remove leading/trailing Unicode whitespace (native trim, no regex)."""
    return F.trim(c, F.lit(PY_WS_CHARS))


def py_strip_sql(expr: str) -> str:
    chars = " || ".join(f"chr({ord(ch)})" for ch in PY_WS_CHARS)
    return f"trim({expr}, {chars})"


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it (possibly many times) in ``body``.

    ``body`` receives a lambda variable.  Keeping every step's reference to
    its input single stops alias substitution (predicate push-down, project
    collapsing) from duplicating large expressions exponentially.
    """
    return F.get(F.transform(F.array(value), body), 0)
