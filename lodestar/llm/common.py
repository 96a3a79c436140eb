"""Shared plumbing of the training-data operators: scratch tables, vectorised words, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.sources.scratch import Scratch, shared_dir  # noqa: F401


def parts_for(spark: SparkSession, least: int = 0) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), least)


# --- words as arrays -------------------------------------------------------------------------

_rng = np.random.default_rng(0x10DE57A2)
BYTE_KEYS = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_MULT = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_BLOCK = 1 << 20
_powers: dict[str, np.ndarray] = {}

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _power(kind: str, n: int) -> np.ndarray:
    table = _powers.get(kind)
    if table is None or len(table) < n:
        base = np.full(max(n, _BLOCK + 1), _MULT if kind == "up" else _INV, dtype=np.uint64)
        base[0] = 1
        table = np.multiply.accumulate(base)
        _powers[kind] = table
    return table[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit (wrapping 64-bit arithmetic)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of a column of texts, A-Z lowered; null texts count as empty.

    data: bytes of all texts; starts, ends: of each word; doc: row of each word; bounds: first word of each row.
    """

    def __init__(self, column: pa.Array, lower: bool = True):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        column = pc.fill_null(column, "").cast(pa.large_string())
        bufs = column.buffers()
        offs = np.frombuffer(bufs[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
        raw = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
        data = raw[offs[0] : offs[-1]] if len(offs) else raw[:0]
        offs = offs - offs[0] if len(offs) else np.zeros(1, np.int64)
        self.data = LOWER[data] if lower else data
        self.offsets = offs
        n = len(self.data)
        word = ~IS_SPACE[self.data]
        first = np.zeros(n + 1, dtype=bool)
        first[offs] = True
        before = np.concatenate([[False], word[:-1]]) if n else word
        self.starts = np.flatnonzero(word & (~before | first[:n]))
        after = np.concatenate([word[1:], [False]]) if n else word
        self.ends = np.flatnonzero(word & (~after | first[1 : n + 1])) + 1
        self.bounds = np.searchsorted(self.starts, offs)
        self.doc = np.repeat(np.arange(len(column)), np.diff(self.bounds))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes, computed in blocks so that memory stays bounded."""
        out = np.empty(len(self.starts), dtype=np.uint64)
        i = 0
        while i < len(out):
            j = max(i + 1, int(np.searchsorted(self.ends, self.starts[i] + _BLOCK, "right")))
            s, e = int(self.starts[i]), int(self.ends[j - 1])
            n = e - s
            sums = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(BYTE_KEYS[self.data[s:e]] * _power("up", n), out=sums[1:])
            a, b = self.starts[i:j] - s, self.ends[i:j] - s
            out[i:j] = (sums[b] - sums[a]) * _power("down", n)[a]
            i = j
        return mix64(out)


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 4 << 20, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most `rows` rows and about `most` bytes of a column, one row at least."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        a = 0
        while a < len(size):
            b = a + max(1, int(np.searchsorted(np.cumsum(size[a : a + rows]), most, "right")))
            yield batch.slice(a, b - a)
            a = b


# --- connected components --------------------------------------------------------------------


def connected_components(scratch: Scratch, edges: DataFrame, label: str = "cc") -> DataFrame:
    """(node, component) of every node that has an edge; component is the smallest node reachable.

    edges: columns a, b (long). Alternating large-star and small-star steps; each step is two
    aggregations by node with map-side combining and two joins, written to the shared folder.
    Ends when a step changes nothing; a path of n nodes needs O(log^2 n) steps.
    """
    a, b = F.col("a"), F.col("b")
    now = edges.where("a <> b").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now = scratch.save(now, f"{label}-0")
    stats = F.struct(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
    before, step = now.agg(stats).first()[0], 0
    while before[0]:
        sym = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sym.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = sym.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least2, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = small.union(least2.select("u", F.col("m").alias("v"))).distinct()
        step += 1
        after = scratch.save(after, f"{label}-{step}")
        scratch.drop(f"{label}-{step - 1}")
        now, seen = after, after.agg(stats).first()[0]
        if seen == before:
            break
        before = seen
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
