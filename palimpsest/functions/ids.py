"""Comparing identifiers that were typed, trimmed or cased differently."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that is removed at both ends of an identifier.
ID_BLANKS = " \t\n\r\x0b\x0c"


def clean_id(c: Column | str) -> Column:
    """An identifier without white space at its ends, in lower case; null where nothing is left, so that it names nothing."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.lower(F.btrim(c, F.lit(ID_BLANKS))), F.lit(""))
