"""MinHash near-duplicate detection with odd sketches.

Every document's set of word shingles gives `bands * rows` MinHash samples. Samples are used twice:
banded into bucket keys that propose candidates, and folded into a parity bitmap (odd sketch) whose
XOR population count estimates the similarity of a candidate before its full sets are compared.

Scale and skew. Documents with equal sets form one class by digest, so exact copies never meet in a
join. In a bucket only (smallest document, member) pairs are proposed, one verified link per member;
in buckets that these links leave in several components, documents whose sketches allow a link are joined
to clusters, and within a cluster documents of different components are compared exactly, block by block,
by matrix products. So a group of near copies that hang together costs one comparison each, its pairs are
never rows of a table, and no link that the bands propose is lost. A leader's members are verified in
salted slices. Defined results: null or blank text has an empty set and links with nothing; a text of
fewer words than the shingle size is one shingle; rows that repeat a doc_id count as one node, a null doc_id links
with nothing; very long texts are compared whole; an empty table gives no rows; columns other than doc_id and
text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import Scratch, Words, connected_components, mix64, text_slices


@dataclass(frozen=True)
class MinHashConfig:
    """percent: link at 100 * intersection >= percent * union. At similarity 0.85 the chance that 32
    bands of 6 rows all miss is 3e-7; slack is the estimate's allowance (over five deviations)."""

    percent: int = 80
    shingle: int = 5
    bands: int = 32
    rows: int = 6
    sketch_words: int = 8
    slack: float = 0.15
    filter_bits: int = 24
    block: int = 256

    @property
    def samples(self) -> int:
        return self.bands * self.rows

    @property
    def most_odd_bits(self) -> int:
        """Largest XOR population count that an estimate of percent/100 - slack allows."""
        n, apart = 64 * self.sketch_words, 2 * self.samples * (1 - self.percent / 100 + self.slack)
        return int(np.ceil(n * (1 - np.exp(-2 * apart / n)) / 2))


_SHINGLE_KEYS = np.random.default_rng(0x5417).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_SAMPLE_RNG = np.random.default_rng(0x0DD5)
_SAMPLE_XOR = _SAMPLE_RNG.integers(0, 2**32, 4096, dtype=np.uint64).astype(np.uint32)
_SAMPLE_MUL = _SAMPLE_RNG.integers(0, 2**32, 4096, dtype=np.uint64).astype(np.uint32) | np.uint32(1)


def shingle_sets(words: Words, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    h = words.hashes()
    n = len(h)
    full = np.zeros(max(0, n - size + 1), dtype=np.uint64)
    for k in range(size):
        full += h[k : k + len(full)] * _SHINGLE_KEYS[k]
    full = mix64(full)
    for a, b in zip(words.bounds[:-1], words.bounds[1:], strict=True):
        if b - a >= size:
            yield np.unique(full[a : b - size + 1])
        elif b > a:
            lone = np.full(1, b - a, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)
            yield mix64(lone + (h[a:b] * _SHINGLE_KEYS[: b - a]).sum(dtype=np.uint64))
        else:
            yield np.zeros(0, dtype=np.uint64)


def min_samples(hashes: np.ndarray, k: int) -> np.ndarray:
    """k MinHash samples (32 bits each) of a non-empty set, in blocks that fit the cache."""
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    best = np.full(k, 0xFFFFFFFF, dtype=np.uint32)
    xor, mul = _SAMPLE_XOR[:k, None], _SAMPLE_MUL[:k, None]
    for i in range(0, len(low), 1024):
        block = low[None, i : i + 1024] ^ xor
        block *= mul
        np.minimum(best, block.min(axis=1), out=best)
    return best


def signature(hashes: np.ndarray, c: MinHashConfig) -> tuple[np.ndarray, np.ndarray]:
    """(band keys, odd sketch) of a non-empty set, both int64."""
    s = min_samples(hashes, c.samples).astype(np.uint64)
    grid = s.reshape(c.bands, c.rows)
    keys = np.arange(1, c.bands + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for j in range(c.rows):
        keys = mix64(keys ^ (grid[:, j] + np.uint64(j << 40)))
    bits = mix64(s + (np.arange(c.samples, dtype=np.uint64) << np.uint64(32))) % np.uint64(64 * c.sketch_words)
    parity = (np.bincount(bits.astype(np.int64), minlength=64 * c.sketch_words) & 1).astype(np.uint8)
    return keys.view(np.int64), np.packbits(parity, bitorder="little").view(np.int64)


def _sign(c: MinHashConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            sizes, digests, keys, odd = [], [], [], []
            for hs in shingle_sets(Words(batch.column("text")), c.shingle):
                sizes.append(len(hs))
                digests.append(hashlib.blake2b(hs.tobytes(), digest_size=16).digest() if len(hs) else None)
                k, o = signature(hs, c) if len(hs) else (None, None)
                keys.append(k)
                odd.append(o)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, longs), pa.array(odd, longs)],
                names=["doc_id", "n_shingles", "digest", "bands", "odd"],
            )

    return run


def _verify(c: MinHashConfig):
    """Rows come sorted by (leader, slice, leader first); keeps one leader's set at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, mine = None, None
        for batch in text_slices(batches):
            a, b = [], []
            lead, doc = batch.column("a").to_pylist(), batch.column("doc_id").to_pylist()
            for x, y, hs in zip(lead, doc, shingle_sets(Words(batch.column("text")), c.shingle), strict=True):
                if x == y:
                    at, mine = x, hs
                elif x == at:
                    both = len(np.intersect1d(mine, hs, assume_unique=True))
                    if 100 * both >= c.percent * (len(mine) + len(hs) - both):
                        a.append(x)
                        b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def texts_of(docs: DataFrame, ids: DataFrame, bits: int) -> DataFrame:
    """The rows of docs whose doc_id is, or hashes like one that is, among ids (column doc_id).

    The filter is a bitmap of 2^bits bits, broadcast as at most 2^(bits-6) rows whatever the input;
    when it fills up it lets everything pass, and the join that follows still decides.
    """
    spot = F.expr(f"pmod(xxhash64(doc_id), {1 << bits})")
    words = ids.select(spot.alias("_s")).groupBy((F.col("_s") / 64).cast("long").alias("_w"))
    words = words.agg(F.bit_or(F.expr("shiftleft(1L, cast(_s % 64 as int))")).alias("_bits"))
    marked = docs.withColumn("_s", spot).withColumn("_w", (F.col("_s") / 64).cast("long"))
    hit = marked.join(F.broadcast(words), "_w").where("(shiftright(_bits, cast(_s % 64 as int)) & 1) = 1")
    return hit.select(*docs.columns)


def verify_pairs(docs: DataFrame, pairs: DataFrame, c: MinHashConfig) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough. docs: doc_id (unique), text."""
    per = pairs.groupBy("a").agg(F.count("*").alias("n"))
    sliced = pairs.join(per, "a").select("a", F.col("b").alias("doc_id"), F.expr("pmod(hash(b), greatest(1, n div 256))").alias("salt"))
    leaders = sliced.select("a", "salt").distinct().select("a", F.col("a").alias("doc_id"), "salt")
    wanted = sliced.select("a", "doc_id", "salt").unionByName(leaders)
    texts = texts_of(docs, wanted.select("doc_id"), c.filter_bits)
    rows = wanted.join(texts, "doc_id").select("a", "salt", "doc_id", "text")
    rows = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", (F.col("doc_id") != F.col("a")), "doc_id")
    return rows.mapInArrow(_verify(c), "a long, b long")


def blocks(rows: DataFrame, key: str, size: int, more: DataFrame | None = None) -> DataFrame:
    """rows (key, n rows of the key, doc_id, ...) dealt to groups (key, lo, hi) of at most about two blocks of
    `size` rows, so that any two rows of a key meet in one group; more: joined by doc_id."""
    rows = rows.withColumn("parts", F.expr(f"cast((n + {size - 1}) div {size} as int)"))
    rows = rows.withColumn("part", F.expr("cast(pmod(hash(doc_id), parts) as int)")).withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    rows = rows.withColumn("lo", F.least("part", "other")).withColumn("hi", F.greatest("part", "other")).drop("parts", "other", "n").withColumnRenamed(key, "key")
    if more is not None:
        rows = rows.join(more, "doc_id")
    return rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")


def _groups(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[list[tuple]]:
    """Rows (part, *columns) of one (key, lo, hi) after the other; their ids with them as lo and hi."""
    at, rows = None, []
    for batch in batches:
        keys = zip(*(batch.column(k).to_pylist() for k in ("key", "lo", "hi")), strict=True)
        for k, r in zip(keys, zip(*(batch.column(k).to_pylist() for k in ("part", *columns)), strict=True), strict=True):
            if k != at:
                if len(rows) > 1:
                    yield rows
                at, rows = k, []
            rows.append(r)
    if len(rows) > 1:
        yield rows


def forest(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    """(a, b): each id that the links (i, j) join to a smaller one, and the least it reaches here."""
    label = ids.copy()
    while True:
        before = label.copy()
        np.minimum.at(label, i, before[j])
        np.minimum.at(label, j, label[i])
        if (label == before).all():
            break
    at = np.flatnonzero(label < ids)
    return pa.RecordBatch.from_arrays([pa.array(label[at]), pa.array(ids[at])], names=["a", "b"])


def _alike(c: MinHashConfig):
    """Within buckets, joins documents whose odd sketches allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, ("doc_id", "odd")):
            ids = np.array([r[1] for r in rows], dtype=np.int64)
            odd = np.array([r[2] for r in rows], dtype=np.int64).view(np.uint64)
            apart = sum(np.bitwise_count(odd[:, None, k] ^ odd[None, :, k]).astype(np.int16) for k in range(odd.shape[1]))
            i, j = np.nonzero(apart <= c.most_odd_bits)
            yield forest(ids, i, j)

    return run


def intersections(sets: list[np.ndarray], width: int = 1 << 14) -> np.ndarray:
    """Sizes of the intersections of all sets with each other, by products of slices of their incidence matrix."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(x) for x in sets])
    flat = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    column = np.cumsum(np.concatenate([[False], flat[1:] != flat[:-1]])) if len(flat) else np.zeros(0, np.int64)
    out = np.zeros((n, n))
    columns = int(column[-1]) + 1 if len(column) else 0
    cuts = np.searchsorted(column, np.arange(0, columns + width, width))
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        grid = np.zeros((n, min(width, columns - k * width)), dtype=np.float32)
        grid[owner[a:b], column[a:b] - k * width] = 1
        out += grid @ grid.T
    return out


def _cross_links(c: MinHashConfig):
    """Within clusters, exact links between documents of different components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, ("doc_id", "comp", "text")):
            comp = np.array([r[2] for r in rows], dtype=np.int64)
            if (comp == comp[0]).all():
                continue
            ids = np.array([r[1] for r in rows], dtype=np.int64)
            sets = list(shingle_sets(Words(pa.array([r[3] for r in rows], pa.large_string())), c.shingle))
            size = np.array([len(x) for x in sets])
            both = intersections(sets)
            i, j = np.nonzero((100 * both >= c.percent * (size[:, None] + size[None, :] - both)) & (comp[:, None] != comp[None, :]))
            yield forest(ids, i, j)

    return run


def minhash_components(spark: SparkSession, docs: DataFrame, config: MinHashConfig | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (columns doc_id, text; more are ignored)."""
    c = config or MinHashConfig()
    s = Scratch(spark, "minhash")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = s.save(docs.mapInArrow(_sign(c), "doc_id long, n_shingles long, digest binary, bands array<long>, odd array<long>"), "signed")
    named = signed.where("digest is not null and doc_id is not null")
    classes = s.save(named.groupBy("digest").agg(F.min("doc_id").alias("rep")), "classes")
    # one representative row per class; a doc_id that repeats in the input may stand for several classes
    reps = s.save(named.select("doc_id", "digest", "bands", "odd").join(classes.withColumnRenamed("rep", "doc_id"), ["digest", "doc_id"]).dropDuplicates(["digest"]), "reps")
    odd = reps.select("doc_id", "odd").dropDuplicates(["doc_id"])
    unique_docs = texts_of(docs.where("doc_id is not null"), reps.select("doc_id"), c.filter_bits)

    buckets = reps.select("doc_id", F.explode("bands").alias("key"))
    leads = buckets.groupBy("key").agg(F.min("doc_id").alias("lead"), F.max("doc_id").alias("last")).where("lead < last").drop("last")
    shared = s.save(buckets.join(leads, "key"), "shared")
    apart = F.expr("aggregate(zip_with(odd, odd2, (x, y) -> cast(bit_count(x ^ y) as int)), 0, (x, y) -> x + y)")
    stars = shared.where("doc_id <> lead").select("doc_id", "lead").distinct()
    # a leader's sketch is dealt to its members in slices
    per = stars.groupBy("lead").agg(F.expr("count(*) div 256 + 1").alias("slices"))
    leaders = per.join(odd.withColumnRenamed("doc_id", "lead").withColumnRenamed("odd", "odd2"), "lead")
    leaders = leaders.select("lead", "odd2", F.explode(F.expr("sequence(0L, slices - 1)")).alias("salt"))
    stars = stars.join(per, "lead").withColumn("salt", F.expr("pmod(xxhash64(doc_id), slices)")).drop("slices")
    stars = stars.join(odd, "doc_id").join(leaders, ["lead", "salt"])
    stars = stars.where(apart <= c.most_odd_bits).groupBy("doc_id").agg(F.min("lead").alias("a")).select("a", F.col("doc_id").alias("b"))
    links = s.save(verify_pairs(unique_docs, s.save(stars, "stars"), c), "links")

    parts = s.save(connected_components(s, links, "cc"), "parts")
    known = shared.select("key", "doc_id").join(parts.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    known = s.save(known.select("key", "doc_id", F.coalesce("component", "doc_id").alias("comp")), "known")
    mixed = known.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("key", "n")
    rows = known.join(mixed, "key").join(odd, "doc_id").select("key", "n", "doc_id", "odd")
    alike = blocks(rows, "key", c.block).mapInArrow(_alike(c), "a long, b long")
    clusters = s.save(connected_components(s, alike, "alike"), "clusters")
    if not clusters.isEmpty():
        whole = clusters.select("node", "component").unionByName(clusters.select(F.col("component").alias("node"), "component").distinct())
        whole = whole.select(F.col("node").alias("doc_id"), F.col("component").alias("cluster")).join(parts.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        whole = whole.select("cluster", "doc_id", F.coalesce("component", "doc_id").alias("comp"))
        open_ = whole.groupBy("cluster").agg(F.count("*").alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("cluster", "n")
        members = s.save(whole.join(open_, "cluster"), "members")
        texts = texts_of(unique_docs, members.select("doc_id"), c.filter_bits)
        found = blocks(members, "cluster", c.block, texts).mapInArrow(_cross_links(c), "a long, b long")
        both = parts.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(found)
        parts = s.save(connected_components(s, both, "all"), "all-parts")

    linked = parts.withColumnRenamed("node", "rep")
    out = signed.select("doc_id", "n_shingles", "digest").join(classes, "digest", "left").join(linked, "rep", "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
