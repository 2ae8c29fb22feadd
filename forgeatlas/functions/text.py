"""String expressions shared by the URL, path and RDF functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The characters Python's str.strip() removes.
SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# End of fixed values.
# Characters Python's \w accepts: letters, numbers of any script, underscore.
WORD = r"\p{L}\p{N}_"


def strip(value: Column) -> Column:
    return F.trim(value, F.lit(SPACE))


def sanitise_name(name: Column) -> Column:
    """Every character other than a word character or ``-`` becomes ``_``."""
    return F.regexp_replace(name, rf"[^{WORD}\-]", "_")


def with_sanitised(df: DataFrame, source: str, target: str) -> DataFrame:
    """B9 on a named column; a column that is not text is a TypeError."""
    kind = df.schema[source].dataType
    if not isinstance(kind, T.StringType):
        raise TypeError(f"column {source!r} must be a string, not {kind.simpleString()}")
    return df.withColumn(target, sanitise_name(F.col(source)))


def last_segment(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(name: Column) -> Column:
    """Last suffix with its dot; a leading or a trailing dot starts none."""
    return F.regexp_extract(name, r"(?s).(\.[^.]+)\z", 1)


def stem(name: Column) -> Column:
    """Name without its last suffix."""
    return F.regexp_replace(name, r"(?s)(?<=.)\.[^.]+\z", "")
