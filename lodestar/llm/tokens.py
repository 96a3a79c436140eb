"""Token ids in binary files: frequency ranks in byte-aligned variable-length code.

Tokens get ranks by falling frequency over the whole corpus. A rank takes one to four bytes; the lengths
of four ranks share one control byte, and control bytes and data bytes are stored apart, so that decoding
is table lookups and gathers over whole blocks. A file is a Parquet shard of a doc_id range whose rows are
blocks (doc_ids, lengths, control, data), plus one small table of the ranks' ids; the files are written
by Spark's committing writer and come in ascending doc_id order.

Texts are split into the words of byte-level BPE by array operations over code-point classes, and each
distinct word is encoded once by the tokenizers library's model (a text holding a special token's string
is given to the library whole); ids equal those of encoding the whole text. Defined results: null text is
empty and has only the end id; null doc_ids come first; rows of equal doc_id stay separate documents; texts
are never cut, a very long one makes a batch and a block by itself; an empty table gives empty files and no
rows; columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.llm.common import Scratch, parts_for, text_slices


@dataclass(frozen=True)
class TokenConfig:
    """tokenizer: a tokenizers file of byte-level BPE; memo: words kept per worker; block: ids per block;
    batch_bytes: text encoded at a time; shard_bytes: of plain ids that a shard has, more if the table is small."""

    tokenizer: str
    end_id: int = 2
    memo: int = 1_000_000
    block: int = 1 << 17
    batch_bytes: int = 8 << 20
    shard_bytes: int = 64 << 20


# The contractions that the word pattern splits off.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
_LETTER, _NUMBER, _SPACE, _OTHER = range(4)


def code_point_classes() -> np.ndarray:
    """Class of every code point as the pattern sees it: letter, number, white space or other."""
    import regex

    out = np.full(0x110000, _OTHER, dtype=np.uint8)
    points = np.array([x for x in range(0x110000) if not 0xD800 <= x < 0xE000], dtype=np.uint32)
    every = points.tobytes().decode("utf-32-le")
    for cls, what in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
        for m in regex.finditer(what, every):
            out[points[m.start() : m.end()]] = cls
    return out


def word_starts(cp: np.ndarray, first: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Is each code point the first of a word? The pattern's words cover their text without gaps.

    cp: code points of texts on end; first: is it a text's first? A word is a run of letters, numbers or
    other signs with at most one blank ahead of it; white space before a word leaves its last sign to that
    word if it is a blank, else to itself; a contraction ends within its run of letters.
    """
    n = len(cp)
    kind = classes[cp]
    start = np.ones(n, dtype=bool)
    start[1:] = kind[1:] != kind[:-1]
    start |= first
    space = kind == _SPACE
    # white space whose next sign is no white space of the same text
    last = space.copy()
    last[:-1] &= ~space[1:] & ~first[1:]
    if n:
        last[-1] = False
    start |= last
    start[1:] &= ~(last[:-1] & (cp[:-1] == 32))
    for x in CONTRACTIONS:
        k = len(x)
        at = np.flatnonzero((cp[: max(0, n - k + 1)] == 39) & start[: max(0, n - k + 1)])
        for i in range(1, k):
            at = at[(cp[at + i] == ord(x[i])) & ~first[at + i]]
        start[at + 1] = False
        at = at[at + k < n]
        start[at + k] = True
    return start


class WordEncoder:
    """Encodes texts as little-endian ids of `width` bytes by way of a bounded table of words.

    Words are found by array operations and told apart by Arrow's dictionary encoding; the library's own
    BPE model, loaded from the tokenizer's file, encodes each word that the table lacks.
    """

    def __init__(self, c: TokenConfig):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.t, self.c = Tokenizer.from_file(c.tokenizer), c
        self.special = [x.content for x in self.t.get_added_tokens_decoder().values()]
        self.width = 2 if max(self.t.get_vocab_size(), c.end_id + 1) <= 65536 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        self._open()
        self._forget()

    def _open(self) -> None:
        from tokenizers import Tokenizer
        from tokenizers.models import BPE
        from tokenizers.pre_tokenizers import ByteLevel

        spec = json.loads(self.t.to_str())
        model, ahead = spec["model"], spec["pre_tokenizer"] or {}
        if model["type"] != "BPE" or ahead.get("type") != "ByteLevel" or ahead.get("add_prefix_space") or spec["normalizer"]:
            raise ValueError("the word table needs a byte-level BPE tokenizer without prefix space or normalizer")
        self.bpe = Tokenizer(BPE(vocab=model["vocab"], merges=[tuple(x) if not isinstance(x, str) else tuple(x.split(" ")) for x in model["merges"]], cache_capacity=0, ignore_merges=model.get("ignore_merges", False)))
        # the sign that stands for each byte: the library says it for the bytes that UTF-8 texts can hold
        signs = np.zeros(256, dtype=np.uint16)
        by_level = ByteLevel(add_prefix_space=False, use_regex=False)
        for x in [*map(chr, range(128)), *(chr(x) for x in range(128, 0x800, 64)), *(chr(x) for x in range(0x80, 0xC0)), *(chr(max(x << 12, 0x800)) for x in range(16)), *(chr(max(x << 18, 0x10000)) for x in range(5))]:
            mapped = by_level.pre_tokenize_str(x)[0][0]
            for b, sign in zip(x.encode(), mapped, strict=True):
                signs[b] = ord(sign)
        self.signs = signs
        self.id_bytes = np.zeros(max(model["vocab"].values()) + 1, dtype=np.int64)
        for x, i in model["vocab"].items():
            self.id_bytes[i] = len(x)
        self.classes = code_point_classes()

    def _forget(self) -> None:
        """Empties the table: place of each word, and the ids of all words on end."""
        self.memo: dict[bytes, int] = {}
        self.at, self.pool = np.zeros(1, dtype=np.int64), np.zeros(0, dtype=self.dtype)

    def _learn(self, words: list[bytes]) -> None:
        """Adds words to the table; the library encodes them side by side, their ids are told apart by their bytes."""
        pools, sizes = [], []
        for i in range(0, len(words), 20_000):
            part = words[i : i + 20_000]
            size = np.fromiter(map(len, part), dtype=np.int64, count=len(part))
            end = np.cumsum(size)
            signs = self.signs[np.frombuffer(b"".join(part), dtype=np.uint8)].tobytes().decode("utf-16-le")
            ids = np.array(self.bpe.encode_batch_fast([[signs[a:b] for a, b in zip((end - size).tolist(), end.tolist(), strict=True)]], is_pretokenized=True, add_special_tokens=False)[0].ids, dtype=np.int64)
            upto = np.searchsorted(np.cumsum(self.id_bytes[ids]), end, "right")
            if len(ids) and int(self.id_bytes[ids].sum()) != int(end[-1]):
                raise ValueError("ids don't cover the bytes of their words")
            sizes.append(np.diff(upto, prepend=0))
            pools.append(ids.astype(self.dtype))
        known = len(self.memo)
        self.memo.update(zip(words, range(known, known + len(words)), strict=True))
        self.pool = np.concatenate([self.pool, *pools])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(np.concatenate(sizes))])

    def batch(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts of a column on end, an end id after each text; ids up to the end of each text)."""
        column = pc.fill_null(column, "").cast(pa.large_string())
        raw = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
        cut = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
        raw, cut = raw[cut[0] : cut[-1]], cut - cut[0]
        lead = np.flatnonzero((raw & 0xC0) != 0x80)
        cp = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
        first = np.zeros(len(raw) + 1, dtype=bool)
        first[cut] = True
        starts = lead[word_starts(cp, first[lead], self.classes)]
        n = len(starts)
        if n:
            offsets = np.append(starts, len(raw)).astype(np.int64)
            words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw))]).dictionary_encode()
            distinct = words.dictionary.to_pylist()
            if len(self.memo) + len(distinct) > self.c.memo and len(self.memo) > self.c.memo // 2:
                self._forget()
            memo = self.memo
            fresh = [w for w in distinct if w not in memo]
            if fresh:
                self._learn(fresh)
            place = np.fromiter(map(memo.__getitem__, distinct), dtype=np.int64, count=len(distinct))[words.indices.to_numpy()]
            begin, size = self.at[place], self.at[place + 1] - self.at[place]
        else:
            begin = size = np.zeros(0, dtype=np.int64)
        # words of each text, and an end id after them
        upto = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(starts, cut)]
        before = np.cumsum(size) - size
        flat = self.pool[np.arange(int(size.sum())) + np.repeat(begin - before, size)]
        ends = upto[1:] + np.arange(1, len(cut))
        out = np.empty(len(flat) + len(column), dtype=self.dtype)
        mine = np.ones(len(out), dtype=bool)
        mine[ends - 1] = False
        out[mine], out[ends - 1] = flat, self.c.end_id
        if self.special:
            out, ends = self._whole(column, out, ends)
        return out, ends

    def _whole(self, column: pa.Array, out: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts that hold a special token's string are given to the library whole."""
        odd = np.zeros(len(column), dtype=bool)
        for x in self.special:
            odd |= pc.match_substring(column, x).to_numpy(zero_copy_only=False)
        if not odd.any():
            return out, ends
        parts = np.split(out, ends[:-1])
        for i in np.flatnonzero(odd):
            ids = self.t.encode_batch_fast([column[int(i)].as_py()], add_special_tokens=False)[0].ids
            parts[i] = np.array([*ids, self.c.end_id], dtype=self.dtype)
        return np.concatenate(parts), np.cumsum([len(x) for x in parts])


_encoders: dict[TokenConfig, WordEncoder] = {}


def encoder(c: TokenConfig) -> WordEncoder:
    if c not in _encoders:
        _encoders[c] = WordEncoder(c)
    return _encoders[c]


def _encode(c: TokenConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(c)
        held: list[pa.RecordBatch] = []
        size = 0

        def done() -> pa.RecordBatch:
            texts = pa.concat_arrays([x.column("text") for x in held])
            ids, ends = e.batch(texts)
            offsets = np.concatenate([[0], ends * e.width]).astype(np.int32)
            binary = pa.BinaryArray.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(offsets), pa.py_buffer(ids.tobytes())])
            return pa.RecordBatch.from_arrays([pa.concat_arrays([x.column("doc_id") for x in held]), pa.array(np.diff(ends, prepend=0).astype(np.int64)), binary], names=["doc_id", "n_tokens", "ids"])

        for part in text_slices(batches, most=c.batch_bytes, rows=1 << 20):
            n = pc.sum(pc.binary_length(part.column("text"))).as_py() or 0
            if held and size + n > c.batch_bytes:
                yield done()
                held, size = [], 0
            held.append(part)
            size += n
        if held:
            yield done()

    return run


def _count(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            got = np.bincount(np.frombuffer(b"".join(batch.column("ids").to_pylist()), dtype=f"<u{width}"), minlength=len(total))
            got[: len(total)] += total
            total = got
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["id", "n"])

    return run


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of ranks."""
    r = ranks.astype("<u4")
    code = (r > 0xFF).astype(np.uint8) + (r > 0xFFFF) + (r > 0xFFFFFF)
    most = int(code.max(initial=0)) + 1
    used = np.ones(len(r) * most, dtype=bool)
    for k in range(1, most):
        used[k::most] = code >= k
    data = np.ascontiguousarray(r.view(np.uint8).reshape(-1, 4)[:, :most]).ravel()[used]
    quads = np.zeros(-(-len(r) // 4) * 4, dtype=np.uint8)
    quads[: len(r)] = code
    a, b, c, d = (quads[k::4] for k in range(4))
    return (a | b << 2 | c << 4 | d << 6).tobytes(), data.tobytes()


_LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n ranks of pack's bytes: lengths by table lookup, then at most four gathers."""
    size = _LENGTHS[np.frombuffer(control, dtype=np.uint8)].ravel()[:n].astype(np.int64)
    at = np.cumsum(size) - size
    raw = np.frombuffer(data, dtype=np.uint8)
    out = raw[at].astype(np.uint32) if n else np.zeros(0, np.uint32)
    for k in range(1, 4):
        more = np.flatnonzero(size > k)
        if not len(more):
            break
        out[more] |= raw[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


BLOCKS = "shard int, before long, n long, doc_ids array<long>, lengths array<long>, control binary, data binary"


def _shards(rank_of: np.ndarray, width: int, c: TokenConfig):
    """Blocks of the rows of a task's partition in order; before: ids of the shard ahead of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, before = TaskContext.get().partitionId(), 0
        ids, sizes, raw, held = [], [], [], 0

        def block():
            ranks = rank_of[np.frombuffer(b"".join(raw), dtype=f"<u{width}")]
            control, data = pack(ranks)
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([before], pa.int64()), pa.array([len(ranks)], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([control], pa.binary()), pa.array([data], pa.binary())],
                names=[x.split()[0] for x in BLOCKS.split(", ")],
            )

        for batch in batches:
            for i, x in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                ids.append(i)
                sizes.append(len(x) // width)
                raw.append(x)
                held += sizes[-1]
                if held >= c.block:
                    yield block()
                    before += held
                    ids, sizes, raw, held = [], [], [], 0
        if ids:
            yield block()

    return run


def _digests(id_of: np.ndarray):
    names = ["shard", "doc_id", "place", "n_tokens", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = id_of[unpack(r["control"], r["data"], r["n"])]
                size = np.array(r["lengths"], dtype=np.int64)
                end = np.cumsum(size)
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(end - size, end, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["shard"]] * len(size), pa.int32()), pa.array(r["doc_ids"], pa.int64()), pa.array(end - size + r["before"], pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())], names=names
                )

    return run


def write_tokens(spark: SparkSession, docs: DataFrame, path: str, c: TokenConfig, s: Scratch) -> None:
    """Encodes docs (doc_id, text) and writes path/ranks and path/shards."""
    width = encoder(c).width
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ids = s.save(docs.mapInArrow(_encode(c), "doc_id long, n_tokens long, ids binary"), "ids")
    # at most as many rows as the vocabulary has ids
    counts = ids.select("ids").mapInArrow(_count(width), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    counts = counts.toPandas().sort_values(["n", "id"], ascending=[False, True])
    order = counts["id"].to_numpy(dtype=np.int64)
    rank_of = np.zeros(int(order.max()) + 1 if len(order) else 1, dtype=np.uint32)
    rank_of[order] = np.arange(len(order), dtype=np.uint32)
    spark.createDataFrame([(r, int(i)) for r, i in enumerate(order)], "rank int, id int").coalesce(1).write.mode("overwrite").parquet(f"{path}/ranks")
    shards = parts_for(spark, int(counts["n"].sum()) * width // c.shard_bytes)
    ranged = ids.repartitionByRange(shards, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "n_tokens", "ids")
    ranged.mapInArrow(_shards(rank_of, width, c), BLOCKS).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/shards")
    s.drop("ids")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files below path."""
    ranks = spark.read.parquet(f"{path}/ranks").toPandas().sort_values("rank")
    id_of = ranks["id"].to_numpy(dtype="<u4")
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/shards")
    # one row per shard
    ends = blocks.groupBy("shard").agg(F.sum("n").alias("n"))
    starts = ends.select("shard", F.coalesce(F.sum("n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    rows = blocks.mapInArrow(_digests(id_of), "shard int, doc_id long, place long, n_tokens long, ids_crc32 long")
    return rows.join(starts, "shard").select("doc_id", (F.col("ahead") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def token_table(spark: SparkSession, docs: DataFrame, c: TokenConfig) -> DataFrame:
    s = Scratch(spark, "tokens")
    write_tokens(spark, docs, s.path("files"), c, s)
    return read_tokens(spark, s.path("files"))
