"""SimHash near-duplicates, compared in bit-sliced blocks.

Equal fingerprints are merged first (partial aggregation), so copies never meet as pairs.
Different fingerprints with at most ``RADIUS`` = 4 differing bits agree in at least two of
six bands of bits, so every link is found under one of the 15 pairs of bands. Under a key
the fingerprints lie in blocks of 64: a block is stored as 64 vertical bit planes (one
64-bit word each). A fingerprint is compared with a whole block at once; the differing bits
are added into carry-save counters of one word per binary digit, and a comparison is
abandoned when all 64 lanes exceed the radius.

A key with very many fingerprints is cut into tiles of ``TILE``; each pair of tiles is
compared in a group of its own. A group gives back a forest (at most one link per
fingerprint), never all pairs. Links between groups are closed by alternating large-star
and small-star steps, whose edges are stored between rounds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forgeatlas.llm.common import pick, store, table

RADIUS = 4
SHINGLE_WORDS = 4
BANDS = (11, 11, 11, 11, 10, 10)
TILE = 4096
LANES = 64
# (row, block) comparisons that are held at once.
PAIRS_AT_ONCE = 1 << 19
WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
# Shingles whose hashes are held at once.
HASHES_AT_ONCE = 1 << 16
ROUNDS = 60


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the 64-bit hashes have each bit set; index 0 is the lowest bit."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(axis=0, dtype=np.int64)


def fingerprint(text: str | None, width: int = SHINGLE_WORDS) -> int:
    """SimHash of a whole text; zero without a word."""
    words = WORDS.findall((text or "").encode().lower())
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, HASHES_AT_ONCE):
        stop = min(n, at + HASHES_AT_ONCE)
        if len(words) <= width:
            shingles = [b" ".join(words)]
        else:
            part = words[at : stop + width - 1]
            shingles = map(b" ".join, zip(*(part[k:] for k in range(width)), strict=False))
        counts += _bit_counts(np.array([digest(s, 42) for s in shingles], np.uint64))
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = []
            for at in range(0, batch.num_rows, 256):
                values += map(fingerprint, batch.column(1).slice(at, 256).to_pylist())
            fps = np.array(values, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])

    rows = pick(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, fp long")


# Bit-sliced comparison -------------------------------------------------------


def bit_planes(fps: np.ndarray, block: np.ndarray, lane: np.ndarray, blocks: int) -> np.ndarray:
    """(64, blocks) words: bit ``lane`` of word ``block`` in plane b is bit b of the value."""
    planes = np.zeros((64, blocks), np.uint64)
    for b in range(64):
        bit = (fps >> np.uint64(b)) & np.uint64(1)
        np.bitwise_or.at(planes[b], block, bit << lane)
    return planes


def close_lanes(planes: np.ndarray, blocks: np.ndarray, queries: np.ndarray, radius: int = RADIUS):
    """For each (query, block) pair the word of lanes within ``radius``, for pairs that have
    one: ``(pair numbers, words)``."""
    alive = np.arange(len(queries))
    digits = int(radius).bit_length()
    counters = [np.zeros(len(alive), np.uint64) for _ in range(digits)]
    over = np.zeros(len(alive), np.uint64)
    full = ~np.uint64(0)
    for b in range(64):
        wanted = (queries[alive] >> np.uint64(b)) & np.uint64(1)
        carry = planes[b, blocks[alive]] ^ (np.uint64(0) - wanted)
        for k in range(digits):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        over |= carry
        if b % 8 == 7:
            beyond = over | _above(counters, radius)
            left = np.flatnonzero(beyond != full)
            if len(left) < len(alive):
                alive, over = alive[left], over[left]
                counters = [c[left] for c in counters]
            if not len(alive):
                break
    return alive, ~(over | _above(counters, radius))


def _above(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter is over ``radius``, compared digit by digit from the top."""
    above = np.zeros_like(counters[0])
    equal = ~above
    for k in reversed(range(len(counters))):
        if radius >> k & 1:
            equal = equal & counters[k]
        else:
            above |= equal & counters[k]
            equal = equal & ~counters[k]
    return above


def forest(group: np.ndarray, fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what is connected inside each group (``group`` is sorted)."""
    n = len(fps)
    start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[start, n])
    blocks_of = -(-size // LANES)
    first_block = np.r_[0, np.cumsum(blocks_of)]
    of = np.repeat(np.arange(len(start)), size)
    place = np.arange(n) - start[of]
    block = first_block[of] + place // LANES
    planes = bit_planes(fps, block, (place % LANES).astype(np.uint64), int(first_block[-1]))
    base = np.repeat(start, blocks_of) + LANES * (np.arange(first_block[-1]) - np.repeat(first_block[:-1], blocks_of))
    length = np.minimum(LANES, np.repeat(start + size, blocks_of) - base)
    # A row is compared with its own block and the blocks before it.
    many = block - first_block[of] + 1
    edge = np.r_[0, np.cumsum(many)]
    parent = np.arange(n)
    out_a, out_b = [], []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    at = 0
    while at < n:
        stop = max(at + 1, int(np.searchsorted(edge, edge[at] + PAIRS_AT_ONCE, "right")) - 1)
        rows = np.repeat(np.arange(at, stop), many[at:stop])
        targets = first_block[of[rows]] + np.arange(len(rows)) - (edge[rows] - edge[at])
        found, lanes = close_lanes(planes, targets, fps[rows], radius)
        for pair, word in zip(found.tolist(), lanes.tolist(), strict=True):
            row, target = int(rows[pair]), int(targets[pair])
            word &= (1 << int(length[target])) - 1
            while word:
                low = word & -word
                word ^= low
                other = int(base[target]) + low.bit_length() - 1
                if other < row and (a := root(row)) != (b := root(other)):
                    parent[max(a, b)] = min(a, b)
                    out_a.append(row)
                    out_b.append(other)
        at = stop
    return np.array(out_a, np.int64), np.array(out_b, np.int64)


# Candidates and components ---------------------------------------------------


def _band_keys(fp):
    """One key for each pair of bands: number of the pair above, their bits below."""
    low, parts = 0, []
    for width in BANDS:
        parts.append((F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1)), width))
        low += width
    keys = []
    for number, ((a, _), (b, width)) in enumerate(combinations(parts, 2)):
        keys.append(F.lit(number << 32).cast("long") + F.shiftleft(a, width).bitwiseOR(b))
    return F.array(*keys)


def links(values: DataFrame, tile: int = TILE) -> DataFrame:
    """``a, b``: links (fingerprints, ``a`` > ``b`` as they are met) among the distinct
    values of column ``fp``, as a forest per key."""
    keyed = values.select("fp", F.explode(_band_keys(F.col("fp"))).alias("key"))
    # Only keys above one tile need cutting; there are at most 15 n / tile of them.
    large = store(
        keyed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > tile)
        .select("key", F.ceil(F.col("n") / tile).cast("int").alias("tiles")),
        "large-keys",
    )
    cut = keyed.join(large, "key", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    each = F.sequence(F.lit(0), F.col("tiles") - 1)
    code = F.transform(each, lambda other: F.least(own, other) * F.col("tiles") + F.greatest(own, other))
    tiles = cut.select("fp", "key", F.explode(code).alias("tile"))
    dealt = tiles.repartition("key", "tile").sortWithinPartitions("key", "tile")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a", "b"]
        held: list[np.ndarray] = []

        def compared(part: np.ndarray) -> pa.RecordBatch:
            change = (part[1:, :2] != part[:-1, :2]).any(axis=1)
            group = np.r_[0, np.cumsum(change)]
            size = np.bincount(group)
            keep = size[group] > 1
            part, group = part[keep], group[keep]
            if not len(part):
                return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, names=names)
            fps = np.ascontiguousarray(part[:, 2])
            a, b = forest(group, fps.view(np.uint64))
            return pa.RecordBatch.from_arrays([pa.array(fps[a]), pa.array(fps[b])], names=names)

        for batch in batches:
            held.append(np.stack([np.asarray(batch.column(k)).astype(np.int64) for k in range(3)], axis=1))
            if sum(map(len, held)) < 1 << 18:
                continue
            part = np.concatenate(held)
            last = np.flatnonzero((part[1:, :2] != part[:-1, :2]).any(axis=1))
            stop = int(last[-1]) + 1 if len(last) else 0
            if stop:
                yield compared(part[:stop])
            held = [part[stop:]]
        if held and sum(map(len, held)):
            yield compared(np.concatenate(held))

    return dealt.select("key", "tile", "fp").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for the nodes of the links: the smallest node that can be reached.

    Alternating large-star and small-star steps; each round joins an edge table with one
    row per node and stores the result. The loop ends when a round changes nothing.
    """
    edges = store(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = _mark(edges)
    for _ in range(ROUNDS):
        if seen[0] == 0:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = (
            both.join(least, "u").filter((F.col("v") > F.col("u")) & (F.col("v") != F.col("m")))
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u").filter(F.col("v") != F.col("m"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        merged = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges = store(merged, "edges")
        before, seen = seen, _mark(edges)
        if before == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    if seen[0]:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _mark(edges: DataFrame) -> tuple[int, int]:
    """Number and order-free checksum of the edges."""
    row = edges.agg(
        F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")
    ).first()
    return row["n"], int(row["s"] or 0)


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row.

    ``fingerprint`` has 16 hexadecimal digits; ``component_id`` is the smallest key that can
    be reached over links of at most 4 differing bits. Texts without a word (null and empty
    ones too) have fingerprint zero and are linked like any other. Repeated rows get the
    same class. A row without a key is linked too and reads its class from the others; a
    class that has no key at all has a null ``component_id``. An empty table gives an empty
    table; other columns are not looked at.
    """
    marked = store(fingerprints(docs, id_col=id_col, text_col=text_col), "fingerprints")
    values = store(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "values")
    roots = components(links(values))
    rooted = values.join(roots, values.fp == roots.node, "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    classes = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(classes, "root").select("fp", "component_id")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return marked.join(named, "fp").select("doc_id", digits, "component_id")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
