"""Left join against a table with one row per key, safe for hot and missing keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forgeatlas.session import cut_lineage

# A lookup table is broadcast whole only within these bounds, which are checked.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20
# A key is hot if it holds more than 1/(HOT_PARTS x shuffle partitions) of the rows: at most
# that many keys are, and no other key fills more than 1/HOT_PARTS of a mean task.
HOT_PARTS = 4


def frequent_keys(counts: DataFrame, key: str, n: str = "n") -> DataFrame:
    """All hot keys of a ``(key, n)`` table; a missing key has the count 0."""
    parts = HOT_PARTS * int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = counts.agg(F.sum(n)).first()[0] or 0
    return counts.filter(F.col(n) > max(1, total // parts)).select(key)


def is_small(stored: DataFrame) -> bool:
    """Whether a stored table is within the broadcast bounds: two partial sums per task."""
    text = F.to_json(F.struct(*stored.columns))
    seen = stored.agg(
        F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("b")
    ).first()
    return seen["n"] <= BROADCAST_ROWS and seen["b"] <= BROADCAST_BYTES


def lookup(
    left: DataFrame,
    right: DataFrame,
    key: str,
    *,
    spread: str,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Add the columns of ``right`` (unique in ``key``) to the rows of ``left``.

    ``right`` is stored first, so that what is behind it is computed once. A small
    ``right`` is broadcast and the rows of ``left`` stay where they are. Beyond
    the bounds the rows of all hot keys are answered from a small table of their
    own, broadcast if its bytes are within the bounds; in the shuffle join that
    answers the rest they, and the rows without a key, carry a value of their own
    made from the unique column ``spread``, so that no task receives all rows of
    one key. Unless
    ``hot`` names the frequent keys, ``left`` is read a second time to count them.
    """
    values = [c for c in right.columns if c != key]
    packed = cut_lineage(right.select(key, F.struct(*values).alias("_value")))
    if is_small(packed):
        joined = left.join(F.broadcast(packed), key, "left")
        return joined.withColumns({c: F.col("_value")[c] for c in values}).drop("_value")
    if hot is None:
        hot = frequent_keys(left.groupBy(key).agg(F.count(key).alias("n")), key)
    hot_rows = cut_lineage(
        packed.join(hot, key, "left_semi").withColumnRenamed("_value", "_hot")
    )
    if is_small(hot_rows):
        hot_rows = F.broadcast(hot_rows)
    # U+0000 cannot start a key: keys are host names and paths.
    own = F.concat(F.lit("\u0000"), F.col(spread).cast("string"))
    answered = F.col("_hot").isNotNull()
    probe = left.join(hot_rows, key, "left").withColumn(
        "_probe", F.when(answered | F.col(key).isNull(), own).otherwise(F.col(key))
    )
    rest = packed.withColumnsRenamed({key: "_probe", "_value": "_cold"})
    joined = probe.join(rest, "_probe", "left")
    value = F.coalesce("_hot", "_cold")
    return joined.withColumns({c: value[c] for c in values}).drop("_probe", "_hot", "_cold")
