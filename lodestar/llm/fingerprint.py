"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text's units are its paragraphs (lines), long ones cut further after words whose hash says so, which an
edit elsewhere doesn't move. Each unit's 64-bit digest is added to three cells of a small table of
(count, key sum, check sum). The difference of two tables holds only the units that differ; peeling cells
with a single unit recovers them. If peeling gets stuck, both are sketched again in a table four times
larger, until all differing digests are out. Likeness is 1 - differing units / units of both.

Most texts are one long line, so most units are such pieces, of about eight words each.

Defined results: null text counts as empty; two texts without words have likeness 1; repeated units of a
text count as often as they occur; equal texts have equal fingerprints, whatever their doc_ids; rows that repeat
a doc_id follow each other by text; very long texts are sketched whole; an empty table gives no rows; columns
other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import Words, mix64, parts_for


@dataclass(frozen=True)
class FingerprintConfig:
    """cells: of the fingerprint's own table; cut: a unit ends after one word in 2^cut on average; range_bytes: of
    text that a range of doc_ids has; ranges: as many at most, more text makes them larger."""

    cells: int = 24
    cut: int = 3
    hashes: int = 3
    growth: int = 4
    levels: int = 14
    range_bytes: int = 64 << 20
    ranges: int = 20_000


_ORDER = np.uint64(0xBF58476D1CE4E5B9)


def unit_digests(texts: list[str], c: FingerprintConfig) -> tuple[np.ndarray, np.ndarray]:
    """(digests, first digest of each text) of all units of texts; the n-th repeat of a unit has a digest of its own."""
    w = Words(pa.array(texts, pa.large_string()), lower=False)
    h = w.hashes()
    n = len(h)
    if not n:
        return h, np.zeros(len(texts) + 1, dtype=np.int64)
    lines = np.cumsum(w.data == 10, dtype=np.int64)
    start = np.zeros(n, dtype=bool)
    start[0] = True
    start[1:] = (w.doc[1:] != w.doc[:-1]) | (lines[w.starts[1:]] > lines[w.ends[:-1] - 1]) | ((h[:-1] & np.uint64((1 << c.cut) - 1)) == 0)
    first = np.flatnonzero(start)
    place = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
    powers = np.full(int(place.max()) + 1, _ORDER, dtype=np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    digests = mix64(np.add.reduceat(h * powers[place], first))
    doc = w.doc[first]
    order = np.lexsort((digests, doc))
    d, k = digests[order], doc[order]
    fresh = np.ones(len(d), dtype=bool)
    fresh[1:] = (d[1:] != d[:-1]) | (k[1:] != k[:-1])
    runs = np.flatnonzero(fresh)
    nth = np.arange(len(d)) - np.repeat(runs, np.diff(np.append(runs, len(d))))
    return mix64(d + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), np.searchsorted(k, np.arange(len(texts) + 1))


class Tables:
    """Sketches of several unit sets, `cells` cells each, side by side."""

    def __init__(self, n: int, cells: int, level: int, c: FingerprintConfig):
        self.n, self.level, self.k = n, level, c.hashes
        self.part = max(2, -(-cells // c.hashes))
        self.cells = self.part * c.hashes
        self.count = np.zeros(n * self.cells, dtype=np.int64)
        self.sum = np.zeros(n * self.cells, dtype=np.uint64)
        self.check = np.zeros(n * self.cells, dtype=np.uint64)

    def add(self, doc: np.ndarray, keys: np.ndarray, sign: np.ndarray | int = 1) -> None:
        s = np.broadcast_to(np.asarray(sign, dtype=np.int64), keys.shape)
        signed, mark = keys * s.astype(np.uint64), self._mark(keys) * s.astype(np.uint64)
        for j in range(self.k):
            at = doc * self.cells + self._spot(keys, j)
            np.add.at(self.count, at, s)
            np.add.at(self.sum, at, signed)
            np.add.at(self.check, at, mark)

    def _spot(self, keys: np.ndarray, j: int) -> np.ndarray:
        return (mix64(keys ^ np.uint64((self.level * 16 + j + 1) * 0x632BE59BD9B4E019 % 2**64)) % np.uint64(self.part)).astype(np.int64) + j * self.part

    @staticmethod
    def _mark(keys: np.ndarray) -> np.ndarray:
        return mix64(keys + np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(32)

    def minus(self, mine: np.ndarray, other: np.ndarray) -> Tables:
        """Tables of the differences of the sets at mine and those at other."""
        out = object.__new__(Tables)
        out.n, out.level, out.k, out.part, out.cells = len(mine), self.level, self.k, self.part, self.cells
        for f in ("count", "sum", "check"):
            grid = getattr(self, f).reshape(self.n, self.cells)
            setattr(out, f, (grid[mine] - grid[other]).ravel())
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(set, key, sign) of what was recovered, and which sets are recovered in full."""
        sets, keys, signs = [], [], []
        while True:
            at = np.flatnonzero(np.abs(self.count) == 1)
            sign = self.count[at]
            key = self.sum[at] * sign.astype(np.uint64)
            ok = self._mark(key) == self.check[at] * sign.astype(np.uint64)
            doc, key, sign = at[ok] // self.cells, key[ok], sign[ok]
            if not len(key):
                break
            _, one = np.unique(np.stack([doc.astype(np.uint64), key]), axis=1, return_index=True)
            doc, key, sign = doc[one], key[one], sign[one]
            sets.append(doc)
            keys.append(key)
            signs.append(sign)
            self.add(doc, key, -sign)
        full = ~((self.count != 0) | (self.sum != 0) | (self.check != 0)).reshape(self.n, self.cells).any(axis=1)
        cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        return cat(sets, np.int64), cat(keys, np.uint64), cat(signs, np.int64), full

    def text(self, i: int, units: int) -> str:
        a = slice(i * self.cells, (i + 1) * self.cells)
        raw = self.count[a].astype("<i4").tobytes() + self.sum[a].astype("<u8").tobytes() + self.check[a].astype("<u4").tobytes()
        return f"{units:x}.{base64.b64encode(raw).decode()}"


def differing(digests: np.ndarray, bounds: np.ndarray, mine: np.ndarray, other: np.ndarray, base: Tables, c: FingerprintConfig) -> np.ndarray:
    """How many unit digests differ between the sets at mine and at other, pair by pair."""
    found = np.zeros(len(mine), dtype=np.int64)
    todo, table, cells = np.arange(len(mine)), base.minus(mine, other), base.cells
    for level in range(1, c.levels):
        doc, _, _, full = table.peel()
        counts = np.bincount(doc, minlength=len(todo))
        found[todo[full]] = counts[full]
        todo = todo[~full]
        if not len(todo):
            return found
        cells *= c.growth
        table = Tables(len(todo), cells, level, c)
        for side, sign in ((mine[todo], 1), (other[todo], -1)):
            size = bounds[side + 1] - bounds[side]
            doc = np.repeat(np.arange(len(todo)), size)
            at = np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(bounds[side], size)
            table.add(doc, digests[at], sign)
    for i in todo:  # not seen: hash cells that never come apart
        a, b = (digests[bounds[x[i]] : bounds[x[i] + 1]] for x in (mine, other))
        found[i] = len(np.setxor1d(a, b))
    return found


def edited_text(text: str, following: str) -> str:
    k = len(text) // 3
    return text[: len(text) - k] + following[:k] if k else text


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_units long"


def _sketch(c: FingerprintConfig):
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
    names = [x.split()[0] for x in OUT.split(", ")]

    def done(rows: list[tuple[int | None, str, str]]) -> pa.RecordBatch:
        ids, texts, after = zip(*rows, strict=True)
        edited = [edited_text(a, b) for a, b in zip(texts, after, strict=True)]
        n = len(texts)
        digests, bounds = unit_digests([*texts, *edited, *after], c)
        size = np.diff(bounds)
        base = Tables(3 * n, c.cells, 0, c)
        base.add(np.repeat(np.arange(3 * n), size), digests)
        me = np.arange(n)
        near = []
        for other in (me + n, me + 2 * n):
            both = size[me] + size[other]
            near.append(1 - differing(digests, bounds, me, other, base, c) / np.maximum(both, 1))
        columns = [ids, [len(x) for x in texts], [hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in edited]]
        columns += [[base.text(i, int(size[i])) for i in me], [base.text(i, int(size[i])) for i in me + n], *near, size[:n]]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, last, ended = [], 0, None, None
        for batch in batches:
            for p, kind, i, text in zip(*(batch.column(k).to_pylist() for k in ("p", "kind", "doc_id", "text")), strict=True):
                text = text or ""
                if last is not None and p == last[0]:
                    rows.append((last[1], last[2], text))
                    held += 3 * len(last[2]) + len(text)
                last = None if kind else (p, i, text)
                if kind:
                    ended = p
                if held > 1 << 20 or len(rows) >= 500:
                    yield done(rows)
                    rows, held = [], 0
        if last is not None and ended != last[0]:
            raise ValueError(f"range {last[0]} has no row that follows it")
        if rows:
            yield done(rows)

    return run


def _range_of(bounds: np.ndarray):
    """Number of the range that a doc_id lies in: ascending bounds, descending ranges, null doc_ids in the last."""

    @F.pandas_udf("int")
    def place(ids: pd.Series) -> pd.Series:
        known = ids.notna().to_numpy()
        out = np.full(len(ids), len(bounds), dtype=np.int32)
        out[known] = len(bounds) - np.searchsorted(bounds, ids.to_numpy(dtype=object)[known].astype(np.int64), "left")
        return pd.Series(out)

    return place


def fingerprint_documents(spark: SparkSession, docs: DataFrame, config: FingerprintConfig | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text (OUT), by ranges of descending doc_id.

    One shuffle of the texts; the row that follows a range's last is sent to it as well. A bound and a first
    doc_id per range, `ranges` at most, are all that comes to the driver. Null doc_ids come last; rows of equal
    doc_id go by text, null texts first.
    """
    c = config or FingerprintConfig()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = min(c.ranges, parts_for(spark, total // c.range_bytes))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], max(10_000, 20 * n))).first()[0] or []
    place = _range_of(np.unique(np.array(cuts, dtype=np.int64)))
    docs = docs.withColumn("p", place("doc_id"))
    firsts = [tuple(r) for r in docs.select("p", "doc_id").groupBy("p").agg(F.max("doc_id")).orderBy("p").collect()]
    after = [(firsts[i][0], *firsts[(i + 1) % len(firsts)]) for i in range(len(firsts))]
    sent = F.broadcast(spark.createDataFrame(after, "before int, p int, first long"))  # a row per range
    # one row of each range's first doc_id goes to the range before as well
    edge = docs.join(sent, "p").where(F.col("doc_id").eqNullSafe(F.col("first"))).groupBy("before").agg(F.min(F.struct("text", "doc_id")).alias("x"))
    edge = edge.select(F.col("before").alias("p"), F.lit(1).alias("kind"), "x.doc_id", "x.text")
    rows = docs.select("p", F.lit(0).alias("kind"), "doc_id", "text").unionByName(edge)
    rows = rows.repartition(n, "p").sortWithinPartitions("p", "kind", F.col("doc_id").desc_nulls_last(), "text")
    return rows.mapInArrow(_sketch(c), OUT)
