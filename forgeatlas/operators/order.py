"""Order-sensitive steps that never put the whole table into one task.

The rows are cut into blocks of consecutive positions. A block is small enough
for one task; what crosses block borders (the last header, the number of rows so
far) is one row per block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from forgeatlas.session import cut_lineage

# 2**18 consecutive row ids form one block: enough blocks to occupy a cluster, and
# 4 million of them for 10**12 rows.
BLOCK_BITS = 18


def block_of(row_id: Column, bits: int = BLOCK_BITS) -> Column:
    return F.shiftright(row_id, bits)


# 2**12 blocks form one block of blocks: 10**12 rows have a thousand of them.
SUPER_BITS = 12


def _before(order: list[str], partition: list[str] | None = None):
    return (
        W.partitionBy(*(partition or [F.lit(0)]))
        .orderBy(*order)
        .rowsBetween(W.unboundedPreceding, -1)
    )


def carry_over(
    blocks: DataFrame,
    group: list[str],
    block: str,
    tails: list[str],
    *,
    chain: str | None = None,
    super_bits: int | None = None,
) -> DataFrame:
    """For one row per ``(group, block)`` with ``tails`` and ``n`` replace every tail by its
    last non-null value in the blocks before, and add ``offset`` (rows of the blocks before).

    With ``super_bits`` the blocks are numbers, and 2**super_bits of them are handled by one
    task; what crosses these borders is one row per block of blocks. Without it a group is
    one window of one small row per block. ``chain`` makes the groups, in their order, one
    sequence: ``"rows"`` for the offset only, ``"fill"`` for both.
    """

    def seen_before(rows: DataFrame, inside, overall, keys: list[str]) -> DataFrame:
        fill = overall if chain == "fill" else inside
        carries = [F.last(t, ignorenulls=True).over(fill).alias(t) for t in tails]
        offset = F.coalesce(F.sum("n").over(overall if chain else inside), F.lit(0))
        return rows.select(*keys, *carries, offset.alias("offset"))

    if super_bits is None:
        return seen_before(
            blocks, _before([block], group), _before([*group, block]), [*group, block]
        )
    if chain:
        raise ValueError("blocks of blocks belong to one group at a time")
    blocks = blocks.withColumn("_super", F.shiftright(block, super_bits))
    keys = [*group, "_super"]
    within = _before([block], keys)
    near = seen_before(blocks, within, within, [*keys, block])
    sums = blocks.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        *(F.max_by(t, F.when(F.col(t).isNotNull(), F.col(block))).alias(t) for t in tails),
    )
    over = _before(["_super"], group)
    far = seen_before(sums, over, over, keys).withColumnsRenamed(
        {c: f"_far_{c}" for c in [*tails, "offset"]}
    )
    carries = [F.coalesce(t, f"_far_{t}").alias(t) for t in tails]
    offset = (F.col("offset") + F.col("_far_offset")).alias("offset")
    return near.join(far, keys).select(*group, block, *carries, offset)


def fill_forward(
    df: DataFrame,
    units: list[list[str]],
    *,
    group: list[str],
    block: str,
    order: str,
    position: str | None = None,
    chain: str | None = None,
    super_bits: int | None = None,
) -> DataFrame:
    """replace nulls by the last values before.

    The columns of a unit move together: they are replaced where all of them are null, by
    those of the last row where one is not. Rows are ordered by ``(block, order)`` within
    ``group``. With ``position`` a dense 0-based number is added as well; see
    :func:`carry_over` for ``chain`` and ``super_bits``.
    """
    headers = {f"_tail{k}": (F.struct(*u), F.coalesce(*u).isNotNull()) for k, u in enumerate(units)}
    blocks = df.groupBy(*group, block).agg(
        *(F.max_by(h, F.when(there, F.col(order))).alias(t) for t, (h, there) in headers.items()),
        F.count("*").alias("n"),
    )
    so_far = W.partitionBy(*group, block).orderBy(order)
    up_to_here = so_far.rowsBetween(W.unboundedPreceding, W.currentRow)
    filled = df.withColumns(
        {
            f"_fill{t}": F.last(F.when(there, h), ignorenulls=True).over(up_to_here)
            for t, (h, there) in headers.items()
        }
    )
    if position:
        filled = filled.withColumn("_rank", F.row_number().over(so_far))
    carried = carry_over(blocks, group, block, [*headers], chain=chain, super_bits=super_bits)
    filled = filled.join(carried, [*group, block])
    if position:
        filled = filled.withColumn(position, F.col("offset") + F.col("_rank") - 1)
    values = {
        c: F.coalesce(f"_fill{t}", t)[c] for t, unit in zip(headers, units, strict=True) for c in unit
    }
    return filled.withColumns(values).drop(
        *headers, *(f"_fill{t}" for t in headers), "_rank", "offset"
    )


def fill_by_row_id(
    df: DataFrame,
    columns: list[str],
    row_id: str = "row_id",
    bits: int = BLOCK_BITS,
    super_bits: int = SUPER_BITS,
) -> DataFrame:
    """F1 on a table that already has a global ``row_id``; leaves ``_block`` behind so
    that the next order-sensitive step can use the same partitioning."""
    df = df.withColumn("_block", block_of(F.col(row_id), bits))
    return fill_forward(
        df, [columns], group=[], block="_block", order=row_id, super_bits=super_bits
    )


def flag_repeats(df: DataFrame, columns: list[str], row_id: str = "row_id") -> DataFrame:
    """``duplicate_flag`` is true for every row but the first of equal rows.

    A run of copies of any length is first thinned inside each block (one
    survivor per block), and only the survivors of a key meet in one group; rows
    already known to be repeats stay spread over their blocks.
    """
    if "_block" not in df.columns:
        df = df.withColumn("_block", block_of(F.col(row_id)))
    in_block = W.partitionBy(*columns, "_block").orderBy(row_id)
    df = df.withColumn("_first_here", F.row_number().over(in_block) == 1)
    home = F.when(F.col("_first_here"), F.lit(-1)).otherwise(F.col("_block"))
    overall = W.partitionBy(*columns, home).orderBy(row_id)
    first = F.col("_first_here") & (F.row_number().over(overall) == 1)
    return df.withColumn("duplicate_flag", ~first).drop("_block", "_first_here")


def number_rows(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Dense 0-based numbering in a global order.

    Range partitioning sorts in parallel; the range borders come from a sample,
    so the partition numbers are frozen by a checkpoint before they are counted.
    The offsets table has one row per partition.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = cut_lineage(
        ranged.withColumn("_id", F.monotonically_increasing_id())
    )
    # monotonically_increasing_id: partition in the upper bits, position in the lower 33.
    ranged = ranged.withColumn("_part", F.shiftright("_id", 33)).withColumn(
        "_at", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    )
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    offsets = counts.select(
        "_part", F.coalesce(F.sum("_n").over(_before(["_part"])), F.lit(0)).alias("_offset")
    )
    return (
        ranged.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + F.col("_at"))
        .drop("_part", "_at", "_id", "_offset")
    )
