"""Ticker and identifier spelling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def symbol_key(c: Column | str) -> Column:
    """One spelling for tickers that differ only in letter case, blanks around them, a leading
    ``$`` or the sign before a share class (``.``, ``-``, ``/``). Null stays null."""
    c = F.col(c) if isinstance(c, str) else c
    bare = F.regexp_replace(F.upper(F.trim(F.regexp_replace(c, r"^\s+|\s+$", ""))), r"^\$\s*", "")
    return F.regexp_replace(bare, r"[-/](?=[A-Z]+$)", ".")


def symbol_key_sql(c: str) -> str:
    """The same spelling in DuckDB's SQL (its patterns know no look-ahead)."""
    bare = f"regexp_replace(upper(regexp_replace({c}, '^\\s+|\\s+$', '', 'g')), '^\\$\\s*', '')"
    return f"regexp_replace({bare}, '[-/]([A-Z]+)$', '.\\1')"


def message_key(c: Column | str) -> Column:
    """An identifier without letter case, blanks and the kind prefix ``t1_``/``t3_``."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.lower(F.regexp_replace(c, r"\s+", "")), r"^t[13]_", "")


def message_key_sql(c: str) -> str:
    return f"regexp_replace(lower(regexp_replace({c}, '\\s+', '', 'g')), '^t[13]_', '')"
