"""Embedding near-duplicates by randomised-rotation binary codes.

Vectors are scaled to length 1 and turned by a random rotation; what is stored of each is packed bits: the code
(the sign of each coordinate), the correction factor (inner product of the turned vector with its code), and the
turned vector itself rounded at random to 4 bits a coordinate, kept as bit planes. For a pair, the planes of one
and the code of the other give an unbiased estimate of the inner product by AND and population count, over the
factor; the estimate's confidence bound decides which pairs are recomputed exactly in double precision, for which
alone vectors are fetched. Only pairs that the exact product confirms link.

Candidates come from tables of sign keys of further random directions; their number follows from the recall
wanted at the threshold and the key length from the number of vectors. A pair that meets in several tables is
handled in the first of them. Equal vectors form one class, so copies never meet in pairs. Large buckets are
compared by pairs of blocks, so no task holds more than two blocks of a bucket, and no pair is ever a row of a
table: what is fetched for a pair of blocks are the vectors that have an open pair there. A pair at the threshold
is missed with chance 1 - recall, and one in about 15,000 by the bound; `exact` compares all blocks with each
other, without codes, and misses none.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing;
vectors of different dimensions don't link; a null vec_id has no links and no component; rows that repeat a
vec_id count as vectors of their own that share a node; a cosine equal to the threshold links; an empty table
gives no rows; columns other than vec_id and embedding are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import Scratch, connected_components, mix64


@dataclass(frozen=True)
class VectorConfig:
    """cosine: link from here on; recall: chance that a pair at the threshold meets in a table; exact: no chance,
    all pairs are compared; per_bucket: vectors a bucket would have if they were spread evenly; deviations: width
    of the bound; planes: bits of a stored coordinate."""

    cosine: float = 0.9
    recall: float = 0.995
    per_bucket: int = 48
    block: int = 512
    deviations: float = 4.0
    planes: int = 4
    exact: bool = False
    seed: int = 17

    def shape(self, n: int) -> tuple[int, int]:
        """(tables, bits of a key) for n vectors."""
        if self.exact:
            return 1, 0
        bits = max(4, min(30, round(math.log2(max(n, 1) / self.per_bucket)))) if n > self.per_bucket else 4
        meet = (1 - math.acos(self.cosine) / math.pi) ** bits
        return max(1, math.ceil(math.log(1 - self.recall) / math.log(1 - meet))), bits


@lru_cache(8)
def rotation(d: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng([seed, d]).normal(size=(d, d)))
    return q * np.sign(np.diag(r))


@lru_cache(8)
def directions(d: int, n: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, d, n]).normal(size=(d, n))


@dataclass
class Codes:
    """Packed codes of unit vectors. bits: (n, words) signs; planes: (n, planes, words) of the rounded coordinates,
    which are low + step * value; factor: of each code; d: dimension."""

    bits: np.ndarray
    planes: np.ndarray
    factor: np.ndarray
    low: np.ndarray
    step: np.ndarray
    d: int

    def row(self, i: int) -> bytes:
        return np.concatenate([[self.factor[i], self.low[i], self.step[i]]]).astype("<f8").tobytes() + self.bits[i].astype("<u8").tobytes() + self.planes[i].astype("<u8").tobytes()

    @staticmethod
    def of_rows(rows: list[bytes], d: int, planes: int) -> Codes:
        raw = np.frombuffer(b"".join(rows), dtype="<u8").reshape(len(rows), -1)
        numbers, words = raw[:, :3].copy().view("<f8"), -(-d // 64)
        return Codes(raw[:, 3 : 3 + words], raw[:, 3 + words :].reshape(len(rows), planes, words), *numbers.T, d)


def _pack(flags: np.ndarray) -> np.ndarray:
    """(n, d) of 0 and 1 as (n, words) of 64 bits."""
    n, d = flags.shape
    wide = np.zeros((n, -(-d // 64) * 64), dtype=np.uint8)
    wide[:, :d] = flags
    return np.packbits(wide, axis=1, bitorder="little").view("<u8")


def encode(x: np.ndarray, c: VectorConfig) -> Codes:
    """Codes of unit vectors (n, d)."""
    n, d = x.shape
    turned = x @ rotation(d, c.seed).T
    top = (1 << c.planes) - 1
    low = turned.min(axis=1)
    step = np.maximum(turned.max(axis=1) - low, 1e-300) / top
    # rounding up with the chance of the part that is cut off keeps the mean; the same vector rounds the same way
    chance = np.random.default_rng([c.seed, d, 1]).random(d)
    value = np.minimum(top, np.floor((turned - low[:, None]) / step[:, None] + chance)).astype(np.int64)
    planes = np.stack([_pack((value >> k) & 1) for k in range(c.planes)], axis=1)
    return Codes(_pack(turned > 0), planes, np.abs(turned).sum(axis=1) / math.sqrt(d), low, step, d)


def estimates(q: Codes, o: Codes, deviations: float) -> tuple[np.ndarray, np.ndarray]:
    """(estimated inner products, bounds) of the rounded vectors of q with the codes of o: (rows of q, rows of o)."""
    both = np.zeros((len(q.bits), len(o.bits)))
    for k in range(q.planes.shape[1]):
        for w in range(o.bits.shape[1]):
            both += np.bitwise_count(q.planes[:, k, w, None] & o.bits[None, :, w]).astype(np.float64) * float(1 << k)
    ones = np.bitwise_count(o.bits).sum(axis=1, dtype=np.int64)
    value = sum(float(1 << k) * np.bitwise_count(q.planes[:, k]).sum(axis=1, dtype=np.int64) for k in range(q.planes.shape[1]))
    # sum of (2 * bit - 1) * (low + step * value)
    inner = 2 * q.step[:, None] * both + q.low[:, None] * (2 * ones - o.d)[None, :] - (q.step * value)[:, None]
    # deviation of the code's estimate, and of the rounding
    spread = np.sqrt(np.maximum(0, 1 - o.factor**2) / (o.factor**2 * max(1, o.d - 1)))[None, :] + (q.step[:, None] / 2) / o.factor[None, :]
    return inner / math.sqrt(o.d) / o.factor, deviations * spread


SIGNED = "rep long, cls long, copies long, dim int, code binary, keys array<long>"


def _keys(tables: int, bits: int, c: VectorConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("embedding").to_pylist()
            keys, codes = [None] * len(rows), [None] * len(rows)
            by_size: dict[int, list[int]] = {}
            for i, x in enumerate(rows):
                by_size.setdefault(len(x), []).append(i)
            for d, at in by_size.items():
                x = _units([rows[i] for i in at])
                sign = (x @ directions(d, max(1, tables * bits), c.seed) > 0)[:, : tables * bits].reshape(len(at), tables, bits)
                code = (sign * (np.uint64(1) << np.arange(bits, dtype=np.uint64))).sum(axis=2, dtype=np.uint64)
                code = mix64(code + (np.arange(1, tables + 1, dtype=np.uint64) << np.uint64(32)) + np.uint64(d << 48)).view(np.int64)
                packed = encode(x, c)
                for k, i in enumerate(at):
                    keys[i], codes[i] = code[k], packed.row(k)
            yield pa.RecordBatch.from_arrays(
                [batch.column("rep"), batch.column("cls"), batch.column("copies"), pa.array([len(x) for x in rows], pa.int32()), pa.array(codes, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=[x.split()[0] for x in SIGNED.split(", ")],
            )

    return run


def _units(rows: list[list[float]]) -> np.ndarray:
    """Vectors of one dimension at length 1; scaled by their largest component first, so that no square overflows."""
    x = np.array(rows, dtype=np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def open_pairs(codes: Codes, keys: np.ndarray, table: int, split: int | None, c: VectorConfig) -> tuple[np.ndarray, np.ndarray]:
    """The pairs i < j of a bucket of table whose estimate leaves a link open and that meet in no earlier table.

    split: rows before it meet only rows from it on (None: all pairs).
    """
    n = len(codes.bits)
    if c.exact:
        open_ = np.ones((n, n), dtype=bool)
    else:
        value, bound = estimates(codes, codes, c.deviations)
        open_ = value + bound >= c.cosine
    open_ &= np.arange(n)[None, :] > np.arange(n)[:, None]
    if split is not None:
        open_[split:] = False
        open_[:, :split] = False
    i, j = np.nonzero(open_)
    if table and len(i):
        fresh = np.ones(len(i), dtype=bool)
        for a in range(0, len(i), 1 << 16):
            part = slice(a, a + (1 << 16))
            fresh[part] = ~(keys[i[part], :table] == keys[j[part], :table]).any(axis=1)
        i, j = i[fresh], j[fresh]
    return i, j


def _local_components(n: int, i: np.ndarray, j: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Least name that each row reaches by the links (i, j)."""
    label = names.copy()
    while True:
        before = label.copy()
        np.minimum.at(label, i, before[j])
        np.minimum.at(label, j, label[i])
        if (label == before).all():
            return label


PAIRED = ("key", "lo", "hi", "table", "part", "cls", "rep", "copies", "dim", "code", "keys")


def _bucket_pairs(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[list[tuple]]:
    """The rows of one (key, lo, hi) after the other, those of part lo first."""
    rows: list[tuple] = []
    for batch in batches:
        for r in zip(*(batch.column(k).to_pylist() for k in columns), strict=True):
            if rows and rows[0][:3] != r[:3]:
                yield sorted(rows, key=lambda x: (x[4] != x[1], x[5]))
                rows = []
            rows.append(r)
    if rows:
        yield sorted(rows, key=lambda x: (x[4] != x[1], x[5]))


def _open(rows: list[tuple], c: VectorConfig) -> tuple[np.ndarray, np.ndarray]:
    _, lo, hi, table = rows[0][:4]
    split = sum(r[4] == lo for r in rows) if lo != hi else None
    if len(rows) < 2 or split in (0, len(rows)):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = Codes.of_rows([r[9] for r in rows], rows[0][8], c.planes)
    return open_pairs(codes, np.array([r[10] for r in rows], dtype=np.int64), table, split, c)


def _estimate(c: VectorConfig):
    """The rows of each pair of blocks that have an open pair in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _bucket_pairs(batches, PAIRED):
            i, j = _open(rows, c)
            at = np.union1d(i, j)
            if len(at):
                cols = list(zip(*(rows[k] for k in at), strict=True))
                types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, types, strict=True)], names=list(PAIRED))

    return run


def _confirm(c: VectorConfig):
    """Exact products of the open pairs: links of each row, and the least rep that it reaches in these blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _bucket_pairs(batches, (*PAIRED, "embedding")):
            i, j = _open(rows, c)
            if not len(i):
                continue
            x = _units([r[11] for r in rows])
            close = np.zeros(len(i), dtype=bool)
            for a in range(0, len(i), 1 << 14):
                part = slice(a, a + (1 << 14))
                close[part] = np.einsum("ij,ij->i", x[i[part]], x[j[part]]) >= c.cosine
            i, j = i[close], j[close]
            if not len(i):
                continue
            copies, reps = (np.array([r[k] for r in rows], dtype=np.int64) for k in (7, 6))
            links = np.bincount(i, copies[j], len(rows)) + np.bincount(j, copies[i], len(rows))
            least = _local_components(len(rows), i, j, reps)
            at = np.flatnonzero(links)
            cls = [rows[k][5] for k in at]
            yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(reps[at]), pa.array(links[at].astype(np.int64)), pa.array(least[at])], names=["cls", "rep", "links", "least"])

    return run


def vector_links(spark: SparkSession, rows: DataFrame, config: VectorConfig | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of rows (vec_id, embedding)."""
    c = config or VectorConfig()
    s = Scratch(spark, "vectors")
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    good = "vec_id is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)"
    classes = rows.where(good).groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    # a class is named by its vector's hash: vec_ids may repeat
    classes = s.save(classes.withColumn("cls", F.xxhash64("embedding", "rep")), "classes")
    tables, bits = c.shape(classes.count())
    signed = classes.repartition("cls").mapInArrow(_keys(tables, bits, c), SIGNED)
    signed = s.save(signed, "signed")
    named = signed.select("cls", "rep", "copies", "dim", "code", "keys", F.posexplode("keys").alias("table", "key"))
    sizes = signed.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    held = named.join(sizes, "key").withColumn("parts", F.expr(f"cast((n + {c.block - 1}) div {c.block} as int)"))
    held = held.withColumn("part", F.expr("cast(pmod(hash(cls), parts) as int)")).withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    held = held.withColumn("lo", F.least("part", "other")).withColumn("hi", F.greatest("part", "other")).select(*PAIRED)
    paired = "key long, lo int, hi int, table int, part int, cls long, rep long, copies long, dim int, code binary, keys array<long>"
    together = lambda d: d.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    left = s.save(together(held).mapInArrow(_estimate(c), paired), "open")
    fetched = left.join(classes.select("cls", "embedding"), "cls").select(*PAIRED, "embedding")
    found = s.save(together(fetched).mapInArrow(_confirm(c), "cls long, rep long, links long, least long"), "found")
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    comps = connected_components(s, found.select(F.col("rep").alias("a"), F.col("least").alias("b")), "cc").withColumnRenamed("node", "rep")
    per = classes.join(links, "cls", "left").join(comps, "rep", "left")
    per = per.select("embedding", F.col("rep"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    out = rows.where(good).join(per, "embedding").select("vec_id", "n_links", F.col("component").alias("component_id"))
    alone = rows.where(f"not coalesce({good}, false)").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
