"""Flow graph of the enriched registry: node and link tables.

One pass over the registry reduces it to counts per host and stage and per runner
and bucket; everything else works on these counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from forgeatlas.functions import labels
from forgeatlas.functions.labels import NODE_ID
from forgeatlas.operators.hosts import BIG_HOST_GT
from forgeatlas.operators.order import number_rows
from forgeatlas.session import cut_lineage

_RUNNER_COUNTS = [f"{runner}_file_patterns" for runner in labels.RUNNERS]


def with_flow_columns(df: DataFrame) -> DataFrame:
    """B13-B15 on every row."""
    counts = [F.col(c) for c in _RUNNER_COUNTS]
    return df.withColumns(
        {f"{runner}_total": F.col(c) for runner, c in zip(labels.RUNNERS, _RUNNER_COUNTS)}
    ).withColumns(
        {
            "No_test_runner_detected": labels.no_runner_flag(*counts),
            "test_file_category": labels.count_bucket(F.col("testfilecountlocal")),
            "primary_runner": labels.primary_runner(*counts),
        }
    )


def flow_counts(df: DataFrame, big_host_gt: int = BIG_HOST_GT) -> DataFrame:
    """Rows per (host, duplicate, stage) and, apart from it, per (cloned, runner, bucket).

    Both groupings come from one pass and combine on the map side; what is
    shuffled is a few rows per host and task, whatever the size of the host. The
    window that adds up the host total sees these few rows.
    """
    counts = [F.col(c) for c in _RUNNER_COUNTS]
    alive = ~F.col("duplicate_flag")
    complete = alive & ~F.col("incomplete_url_flag")
    stage = (
        F.when(alive & F.col("incomplete_url_flag"), labels.INCOMPLETE)
        .when(complete & (F.col("clone_status") == "failed"), labels.NOT_CLONED)
        .when(complete & (F.col("clone_status") == "successful"), labels.CLONED)
    )
    cloned = F.coalesce(F.col("clone_status") == "successful", F.lit(False))
    by_host = ["repodomain", "duplicate_flag", "stage"]
    by_runner = ["cloned", "runner", "bucket"]
    reduced = (
        df.select(
            "repodomain",
            "row_id",
            "duplicate_flag",
            stage.alias("stage"),
            cloned.alias("cloned"),
            F.when(cloned, labels.primary_runner(*counts)).alias("runner"),
            F.when(cloned, labels.count_bucket(F.col("testfilecountlocal"))).alias("bucket"),
        )
        .groupingSets([by_host, by_runner], *by_host, *by_runner)
        .agg(
            F.count("*").alias("n"),
            F.min("row_id").alias("first_row_id"),
            F.grouping("repodomain").alias("without_host"),
        )
    )
    of_host = W.partitionBy("without_host", "repodomain")
    known = F.col("repodomain").isNotNull()
    return (
        reduced.withColumn("host_n", F.sum("n").over(of_host))
        .withColumn("host_first", F.min("first_row_id").over(of_host))
        .withColumn("is_big", F.when(known, F.col("host_n") > big_host_gt))
    )


def _fixed_id(label):
    node = F.lit(None).cast("int")
    for caption, number in NODE_ID.items():
        node = F.when(label == caption, F.lit(number)).otherwise(node)
    return node


def flow_nodes(counts: DataFrame) -> DataFrame:
    """the fixed nodes, then the big hosts by size and first appearance.

    A host spelled like a fixed node shares that node.
    """
    spark = counts.sparkSession
    fixed = spark.createDataFrame(
        [(number, label) for label, number in NODE_ID.items()], "node_id int, label string"
    )
    big = (
        counts.filter("is_big")
        .groupBy("repodomain")
        .agg(F.first("host_n").alias("n"), F.first("host_first").alias("first_row_id"))
        .filter(~F.col("repodomain").isin(list(NODE_ID)))
    )
    numbered = number_rows(big, [F.desc("n"), F.asc("first_row_id")], "position")
    return fixed.unionByName(
        numbered.select(
            (F.col("position") + len(NODE_ID)).cast("int").alias("node_id"),
            F.col("repodomain").alias("label"),
        )
    )


def flow_links(counts: DataFrame, nodes: DataFrame) -> DataFrame:
    """E4, E7-E10 in one step: every count contributes to the links it is part of.

    The link from the original data to the small hosts exists even when empty,
    all others only when they hold rows.
    """

    def end(fixed=None, host=None):
        return F.struct(
            F.lit(fixed).cast("string").alias("fixed") if isinstance(fixed, (str, type(None)))
            else fixed.alias("fixed"),
            (host if host is not None else F.lit(None).cast("string")).alias("host"),
        )

    known = F.col("repodomain").isNotNull()
    host_end = end(
        F.when(~F.col("is_big"), F.lit(labels.SMALL_HOSTS)),
        F.when(F.col("is_big"), F.col("repodomain")),
    )

    def link(condition, source, target):
        return F.when(condition, F.struct(source.alias("s"), target.alias("t")))

    contributions = F.array_compact(
        F.array(
            link(known, end(labels.ORIGINAL), host_end),
            link(F.col("duplicate_flag"), end(labels.ORIGINAL), end(labels.DUPLICATES)),
            link(known & F.col("stage").isNotNull(), host_end, end(F.col("stage"))),
            link(F.col("cloned"), end(labels.CLONED), end(F.col("runner"))),
            link(
                F.col("cloned") & F.col("bucket").isNotNull(),
                end(F.col("runner")),
                end(F.col("bucket")),
            ),
        )
    )
    parts = counts.select("n", F.explode(contributions).alias("l")).select(
        F.col("l.s.fixed").alias("s_fixed"),
        F.col("l.t.fixed").alias("t_fixed"),
        F.coalesce("l.s.host", "l.t.host").alias("label"),
        F.col("l.s.host").isNotNull().alias("from_host"),
        "n",
    )
    always = counts.sparkSession.range(1).select(
        F.lit(labels.ORIGINAL).alias("s_fixed"),
        F.lit(labels.SMALL_HOSTS).alias("t_fixed"),
        F.lit(None).cast("string").alias("label"),
        F.lit(False).alias("from_host"),
        F.lit(0).cast("long").alias("n"),
    )
    # At most four links per host and a few dozen without one remain here.
    totals = (
        parts.unionByName(always)
        .groupBy("s_fixed", "t_fixed", "label", "from_host")
        .agg(F.sum("n").alias("value"))
    )
    with_ids = totals.join(nodes, "label", "left")
    return with_ids.select(
        F.when(F.col("from_host"), F.col("node_id"))
        .otherwise(_fixed_id(F.col("s_fixed")))
        .alias("source"),
        F.when(~F.col("from_host") & F.col("label").isNotNull(), F.col("node_id"))
        .otherwise(_fixed_id(F.col("t_fixed")))
        .alias("target"),
        "value",
    )


def flow_graph(df: DataFrame, big_host_gt: int = BIG_HOST_GT) -> tuple[DataFrame, DataFrame]:
    """``(nodes, links)``. The reduced counts are stored once and read by both."""
    counts = cut_lineage(flow_counts(df, big_host_gt))
    nodes = flow_nodes(counts)
    return nodes, flow_links(counts, nodes)


def write_flow(nodes: DataFrame, links: DataFrame, folder: str) -> None:
    """A21."""
    nodes.write.mode("overwrite").parquet(f"{folder}/nodes")
    links.write.mode("overwrite").parquet(f"{folder}/links")
