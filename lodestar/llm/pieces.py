"""SentencePiece encoding and decoding: Unigram Viterbi over a double-array trie of pieces.

Pieces and scores come from a SentencePiece model file. A BPE file has merge ranks instead of log scores;
rank r then counts as log(1 / (r + 1)) less the log of the harmonic sum (a Zipf law). Characters without a
piece of their own become byte pieces, at a score of 10 below the lowest. A text gets one leading marker;
spaces become markers, and decoding turns them back. A marker character in the text itself goes through
byte pieces, so decoding returns every text exactly.

No piece has a marker or a line break after another character (checked at load; text is split by marker
alone otherwise), so the best path of a text is that of its chunks; each distinct chunk of a batch is
solved once, those of like length in step, lone long ones byte by byte in time in proportion to their length.
Defined results: null and empty texts have no pieces and decode to empty; of paths of equal score the one whose
last piece begins first wins; very long texts and words are encoded whole; rows that repeat get the same result
each; an empty table gives no rows; columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import text_slices

MARK = "▁"


@dataclass(frozen=True)
class PieceConfig:
    """model: a SentencePiece model file with byte pieces; memo: chunks kept per worker."""

    model: str
    memo: int = 300_000
    below: float = 10.0


def double_array(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base, check, key number or -1) of a trie over sorted distinct keys; state 0 is the root.

    The child of state s by byte b is base[s] + b + 1 if its check is s.
    """
    size = 1 << 18
    base, check, value = (np.full(size, x, dtype=np.int64) for x in (0, -1, -1))
    check[0] = 0
    lowest = 1
    todo = [(0, 0, len(keys), 0)]
    while todo:
        s, lo, hi, depth = todo.pop()
        if len(keys[lo]) == depth:
            value[s] = lo
            lo += 1
        groups = []
        while lo < hi:
            b, j = keys[lo][depth], lo
            while j < hi and keys[j][depth] == b:
                j += 1
            groups.append((b + 1, lo, j))
            lo = j
        if not groups:
            continue
        offsets = np.array([g[0] for g in groups])
        while check[lowest] != -1:
            lowest += 1
        at, start = 0, max(1, lowest - int(offsets[0]))
        while not at:
            while start + 4096 + 300 >= size:
                base, check, value = (np.concatenate([x, np.full(size, y, dtype=np.int64)]) for x, y in ((base, 0), (check, -1), (value, -1)))
                size *= 2
            free = np.ones(4096, dtype=bool)
            for o in offsets:
                free &= check[start + o : start + o + 4096] == -1
            if free.any():
                at = start + int(free.argmax())
            start += 4096
        base[s] = at
        for b, i, j in groups:
            check[at + b] = s
        for b, i, j in groups:
            todo.append((at + b, i, j, depth + 1))
    return base, check, value


class PieceModel:
    def __init__(self, c: PieceConfig):
        import sentencepiece

        self.c = c
        sp = sentencepiece.SentencePieceProcessor(model_file=c.model)
        n = sp.get_piece_size()
        self.byte_id = np.zeros(256, dtype=np.int64)
        names, ids, scores = [], [], []
        ranked = True
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[1:-1], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                names.append(piece)
                ids.append(i)
                scores.append(sp.get_score(i))
                ranked &= sp.get_score(i) == round(sp.get_score(i))
        if ranked:  # merge ranks
            scores = list(-np.log(np.arange(1, len(names) + 1)) - np.log((1 / np.arange(1, len(names) + 1)).sum()))
        order = sorted(range(len(names)), key=lambda k: names[k].encode())
        self.base, self.check, self.value = double_array([names[k].encode() for k in order])
        self.ids = np.array([ids[k] for k in order], dtype=np.int64)
        self.scores = np.array([scores[k] for k in order])
        self.unknown = float(self.scores.min()) - c.below
        self.longest = max(len(x.encode()) for x in names)
        inner = any(MARK in x.lstrip(MARK) for x in names)
        lines = any("\n" in x and len(x) > 1 for x in names)
        if inner:
            raise ValueError("pieces that go on after a marker aren't supported")
        self.chunks = re.compile(f" *[^ {MARK}]+|{MARK}| +" if lines else f" *[^ \n{MARK}]+|\n|{MARK}| +").findall
        self.width = 2 if n <= 65536 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        self.bytes_of = [x.replace(MARK, " ").encode() for x in map(sp.id_to_piece, range(n))]
        for b, i in enumerate(self.byte_id):
            self.bytes_of[i] = bytes([b])
        self.memo: dict[str, bytes] = {}
        self._lists: tuple[list, ...] | None = None

    def _solve(self, raw: list[bytes]) -> list[np.ndarray]:
        """Ids of the best path of each chunk (bytes of about equal length)."""
        n, width = len(raw), max(map(len, raw))
        size = np.array([len(x) for x in raw])
        grid = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in raw), dtype=np.uint8).reshape(n, width).astype(np.int64)
        best = np.full((n, width + 1), -np.inf)
        best[:, 0] = 0
        back = np.zeros((n, width + 1), dtype=np.int32)
        via = np.full((n, width + 1), -1, dtype=np.int32)
        lead = (grid & 0xC0) != 0x80
        for s in range(width):
            rows = np.flatnonzero((best[:, s] > -np.inf) & (s < size) & lead[:, s])
            if not len(rows):
                continue
            first = grid[rows, s]
            step = 1 + (first >= 0xC0) + (first >= 0xE0) + (first >= 0xF0)
            self._relax(best, back, via, rows, s, s + step, best[rows, s] + self.unknown, -1)
            state = np.zeros(len(rows), dtype=np.int64)
            for d in range(s, min(width, s + self.longest)):
                inside = d < size[rows]
                rows, state = rows[inside], state[inside]
                nxt = self.base[state] + grid[rows, d] + 1
                ok = (nxt < len(self.check)) & (self.check[np.minimum(nxt, len(self.check) - 1)] == state) & (self.base[state] > 0)
                rows, state = rows[ok], nxt[ok]
                if not len(rows):
                    break
                piece = self.value[state]
                hit = np.flatnonzero(piece >= 0)
                if len(hit):
                    r, p = rows[hit], piece[hit]
                    self._relax(best, back, via, r, s, np.full(len(r), d + 1), best[r, s] + self.scores[p], p)
        out = []
        for i in range(n):
            at, got = len(raw[i]), []
            while at:
                s, p = int(back[i, at]), int(via[i, at])
                if p >= 0:
                    got.append(int(self.ids[p]))
                else:
                    got.extend(int(self.byte_id[b]) for b in reversed(raw[i][s:at]))
                at = s
            out.append(np.array(got[::-1], dtype=self.dtype))
        return out

    @staticmethod
    def _relax(best, back, via, rows, s, to, score, piece) -> None:
        better = score > best[rows, to]
        r, t = rows[better], to[better]
        best[r, t] = score[better]
        back[r, t] = s
        via[r, t] = piece if np.isscalar(piece) else piece[better]

    def _solve_long(self, raw: bytes) -> np.ndarray:
        """Ids of the best path of one long chunk, byte by byte without arrays."""
        if self._lists is None:
            self._lists = tuple(x.tolist() for x in (self.base, self.check, self.value, self.scores))
        base, check, value, scores = self._lists
        n, states = len(raw), len(check)
        best, back, via = [-math.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        for s in range(n):
            mine, first = best[s], raw[s]
            if mine == -math.inf or first & 0xC0 == 0x80:
                continue
            to = s + 1 + (first >= 0xC0) + (first >= 0xE0) + (first >= 0xF0)
            if mine + self.unknown > best[to]:
                best[to], back[to], via[to] = mine + self.unknown, s, -1
            state = 0
            for d in range(s, min(n, s + self.longest)):
                nxt = base[state] + raw[d] + 1
                if nxt >= states or check[nxt] != state or base[state] <= 0:
                    break
                state = nxt
                p = value[state]
                if p >= 0 and mine + scores[p] > best[d + 1]:
                    best[d + 1], back[d + 1], via[d + 1] = mine + scores[p], s, p
        got, at = [], n
        while at:
            s, p = back[at], via[at]
            if p >= 0:
                got.append(int(self.ids[p]))
            else:
                got.extend(int(self.byte_id[b]) for b in reversed(raw[s:at]))
            at = s
        return np.array(got[::-1], dtype=self.dtype)

    def _raw(self, chunks: list[str]) -> dict[str, bytes]:
        out, todo = {}, []
        for x in chunks:
            if x == MARK:
                out[x] = self.byte_id[np.frombuffer(MARK.encode(), dtype=np.uint8)].astype(self.dtype).tobytes()
            else:
                todo.append((x, x.replace(" ", MARK).encode("utf-8", "replace")))
        todo.sort(key=lambda x: len(x[1]))
        i = 0
        while i < len(todo):
            top, j = max(8, len(todo[i][1]) * 5 // 4), i
            room = 1 << 20
            while j < len(todo) and (j == i or len(todo[j][1]) <= top and (j - i + 1) * (top + 1) <= room):
                j += 1
            raw = [b for _, b in todo[i:j]]
            # array steps pay off where many chunks take them together
            solved = map(self._solve_long, raw) if j - i < 8 or len(raw[0]) > 4096 else self._solve(raw)
            for (x, _), ids in zip(todo[i:j], solved, strict=True):
                out[x] = ids.tobytes()
            i = j
        return out

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids (width bytes each) of each text."""
        split = [self.chunks(" " + x) if x else [] for x in texts]
        memo = self.memo
        fresh = list({w for ws in split for w in ws if w not in memo})
        memo.update(self._raw(fresh))
        get = memo.__getitem__
        out = [b"".join(map(get, ws)) for ws in split]
        for w in fresh[max(0, self.c.memo - (len(memo) - len(fresh))) :]:
            del memo[w]
        return out

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode_batch([text])[0], dtype=self.dtype)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")[1:]


_models: dict[PieceConfig, PieceModel] = {}


def piece_model(c: PieceConfig) -> PieceModel:
    if c not in _models:
        _models[c] = PieceModel(c)
    return _models[c]


def encode_documents(docs: DataFrame, c: PieceConfig) -> DataFrame:
    """doc_id, n_chars, n_pieces, pieces (little-endian ids of 2 or 4 bytes), decoded (the text read back from them)."""
    names = ["doc_id", "n_chars", "n_pieces", "pieces", "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = piece_model(c)
        for part in text_slices(batches, rows=250):
            texts = [x or "" for x in part.column("text").to_pylist()]
            ids = m.encode_batch(texts)
            back = [m.decode(np.frombuffer(x, dtype=m.dtype)) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(map(len, texts), pa.int64()), pa.array([len(x) // m.width for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(back, pa.string())], names=names
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_chars long, n_pieces long, pieces binary, decoded string")
