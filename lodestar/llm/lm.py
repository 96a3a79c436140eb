"""Language-model scoring: a gated recurrent network with a class-factored output, in numpy.

Vocabulary. Word counts are taken over all training documents. The `words` most frequent words are spelt
out by the network in classes of `members`; every other word, known or not, is a member of one further class
by its spelling (64 kinds: last byte, any byte beyond ASCII), and has its add-0.1 share of that kind's count.
So P(word | past) = softmax over classes x softmax within the class (x the share), a proper distribution.

Learning. The network starts at the corpus's class and word frequencies, is warmed up on a bounded sample
(about `warm_docs` whole documents, so that tasks begin alike), then every task trains its share of all training
documents by truncated backpropagation and the weights are averaged by token counts, task by task up a tree.
Scoring carries the state across windows from a document's first token to its end token.

Counts of words beyond the `head` most frequent are joined by hash; words are told apart by a 64-bit hash.
Defined results: null and empty texts have one token, the end; without training documents all counts are 0;
rows that repeat are scored, and learnt from, each; a null doc_id is not held out; words of equal count are
all in or all out of the head; very long texts are read whole; an empty table gives no rows; columns other
than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import Scratch, Words, parts_for, text_slices


@dataclass(frozen=True)
class LmConfig:
    """words: spelt out by the network, in classes of members; head: counts that every task holds (words beyond them
    are joined); hidden: size of the state; lanes, window: tokens of a training step; flush: tokens held in memory."""

    words: int = 4096
    members: int = 64
    head: int = 262_144
    hidden: int = 16
    lanes: int = 512
    window: int = 16
    rate: float = 0.012
    warm_docs: int = 600
    smooth: float = 0.1
    flush: int = 3_000_000
    held_out_of: int = 10


END = np.int64(0x7E57E4D0F7E87)
END_CLASS = 64
SPELLINGS = 65
_LAST = np.full(256, 30, dtype=np.int64)
_LAST[97:123] = np.arange(26)
_LAST[48:58] = 26
_LAST[[46, 44, 33]] = [27, 28, 29]
_LAST[128:] = 31


def tokens_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, spelling classes, first token of each text); every text ends in the end token."""
    w = Words(column)
    n, m = len(w.starts), len(w.bounds) - 1
    cls = _LAST[w.data[w.ends - 1]] if n else np.zeros(0, np.int64)
    wide = np.searchsorted(w.starts, np.flatnonzero(w.data >= 128), "right") - 1
    cls[wide] |= 32  # bytes beyond ASCII are never white space, so each lies in a word
    bounds = w.bounds + np.arange(m + 1)
    at = np.arange(n) + w.doc
    h = np.full(n + m, END, dtype=np.int64)
    c = np.full(n + m, END_CLASS, dtype=np.int64)
    h[at] = w.hashes().view(np.int64)
    c[at] = cls
    return h, c, bounds


def _count(c: LmConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hs, cs, held = [], [], 0

        def flush():
            h, k = np.concatenate(hs), np.concatenate(cs)
            u, first, n = np.unique(h, return_index=True, return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(k[first].astype(np.int32)), pa.array(n.astype(np.int64))], names=["h", "cls", "n"])

        for batch in text_slices(batches):
            h, k, _ = tokens_of(batch.column("text"))
            hs.append(h)
            cs.append(k.astype(np.int8))
            held += len(h)
            if held >= c.flush:
                yield flush()
                hs, cs, held = [], [], 0
        if hs:
            yield flush()

    return run


class Lexicon:
    """Counts that every task needs: bounded by head, words and the spelling classes."""

    def __init__(self, c: LmConfig, head: np.ndarray, counts: np.ndarray, cls: np.ndarray, spelling_n: np.ndarray, spelling_v: np.ndarray, total: int, distinct: int):
        self.c, self.total, self.distinct = c, total, distinct
        words = [i for i in range(len(head)) if head[i] != END][: c.words]
        self.word_counts = counts[words].astype(np.float64)
        order = np.argsort(head)
        self.head, self.counts = head[order], counts[order]
        place = np.full(len(head), -1, dtype=np.int64)
        place[words] = np.arange(len(words))
        self.place = place[order]
        self.groups = max(1, -(-len(words) // c.members))
        # what the spelt-out words count for is not in the spelling classes
        n, v = spelling_n.astype(np.float64).copy(), spelling_v.astype(np.float64).copy()
        np.subtract.at(n, cls[words], counts[words])
        np.subtract.at(v, cls[words], 1)
        self.spelling_n = np.maximum(n, 0)
        self.share = np.log10(n + c.smooth * (v + 1))

    def look(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count or -1 if beyond the head, spelt-out word or -1) of each token."""
        if not len(self.head):
            return np.full(len(h), -1, dtype=np.int64), np.full(len(h), -1, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.head, h), len(self.head) - 1)
        hit = self.head[at] == h
        return np.where(hit, self.counts[at], -1), np.where(hit, self.place[at], -1)

    def symbols(self, word: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(input symbol, output class, member) of each token: a word's group and place in it, or the class of
        all other words and the spelling class, or the class of the end, whose member is -1."""
        m = self.c.members
        spelt, end = word >= 0, cls == END_CLASS
        group = np.where(spelt, word // m, self.groups + end)
        return np.where(spelt, word, self.c.words + cls), group, np.where(spelt, word % m, np.where(end, -1, cls))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x = np.exp(np.negative(x, out=x), out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _slices(sorted_groups: np.ndarray) -> list[tuple[int, slice]]:
    """(group, its places) in an array of sorted group numbers."""
    first = np.flatnonzero(np.diff(sorted_groups, prepend=-1)).tolist()
    return [(int(sorted_groups[a]), slice(a, b)) for a, b in zip(first, [*first, len(sorted_groups)][1:], strict=True)]


def _parts(rows: slice, size: int = 1024) -> Iterator[slice]:
    """A slice in parts whose logits stay in a core's own cache."""
    for a in range(rows.start, rows.stop, size):
        yield slice(a, min(a + size, rows.stop))


class GatedNet:
    """Weights in float32. Gates (update, reset, new) come first: G by input symbol (last: start), U recurrent, b;
    C, bc classes; M, bm members of each class of words and, last, the spelling classes of all other words."""

    NAMES = ("G", "U", "b", "C", "bc", "M", "bm")

    def __init__(self, lex: Lexicon, seed: int = 5):
        c, r = lex.c, np.random.default_rng(seed)
        h, g, width = c.hidden, lex.groups, max(c.members, END_CLASS)
        f = lambda *s, scale=0.1: (r.normal(size=s) * scale).astype(np.float32)
        self.h, self.start = h, c.words + SPELLINGS
        self.G, self.U, self.b = f(3, self.start + 1, h, scale=0.3), f(3, h, h), np.zeros((3, 1, h), np.float32)
        self.b[0] = 1.0
        self.C, self.M = f(h, g + 2, scale=0.05), f(g + 1, h, width, scale=0.05)
        counts = np.full((g + 1, width), -1.0)
        cells = np.full(g * c.members, -1.0)
        cells[: len(lex.word_counts)] = lex.word_counts
        counts[:g, : c.members] = cells.reshape(g, c.members)
        counts[g, :END_CLASS] = lex.spelling_n[:END_CLASS]
        # a member that stands for no word gets next to nothing
        self.bm = np.where(counts < 0, -30, np.log(np.maximum(counts, 0) + 0.1)).astype(np.float32)
        self.bc = np.log(np.append(np.maximum(counts, 0).sum(axis=1), lex.spelling_n[END_CLASS]) + 1.0).astype(np.float32)

    def step(self, gates: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """(new state, update gate, reset gate, candidate, recurrent part of the candidate); gates: (3, rows, h)."""
        u = np.matmul(h, self.U)
        zr = u[:2]
        zr += gates[:2]
        z, r = _sigmoid(zr)
        n = r * u[2]
        n += gates[2]
        np.tanh(n, out=n)
        new = h - n
        new *= z
        new += n
        return new, z, r, n, u[2]

    def log_probs(self, h: np.ndarray, cls: np.ndarray, member: np.ndarray) -> np.ndarray:
        """Natural log of class and member probabilities after states h."""
        order = np.argsort(cls.astype(np.uint16), kind="stable")
        cls, member, h = cls[order], member[order], h[order]
        got = np.empty(len(h), dtype=np.float64)
        for part in _parts(slice(0, len(h))):
            got[part] = _chosen(h[part] @ self.C, self.bc, cls[part])
        for g, rows in _slices(cls):
            if g < len(self.M):
                for part in _parts(rows):
                    got[part] += _chosen(h[part] @ self.M[g], self.bm[g], member[part])
        out = np.empty(len(h), dtype=np.float64)
        out[order] = got
        return out

    def score(self, sym: np.ndarray, cls: np.ndarray, member: np.ndarray, bounds: np.ndarray, window: int = 64) -> np.ndarray:
        """Natural log probability of the class and member choices of each text."""
        size = np.diff(bounds)
        order = np.argsort(-size, kind="stable")
        size, begin = size[order], bounds[:-1][order]
        total = np.zeros(len(order))
        h = np.zeros((len(order), self.h), dtype=np.float32)
        sym_in = np.concatenate([[self.start], sym])  # shifted by one
        longest = int(size[0]) if len(size) else 0
        # texts longer than t come first
        live = np.searchsorted(-size, -np.arange(longest), "left")
        table = self.G + self.b
        for t0 in range(0, longest, window):
            rows, at, states = [], [], []
            for t in range(t0, min(longest, t0 + window)):
                n = int(live[t])
                pos = begin[:n] + t
                h = self.step(table[:, sym_in[pos] if t else np.full(n, self.start)], h[:n])[0]
                rows.append(np.arange(n))
                at.append(pos)
                states.append(h)
            rows, at = np.concatenate(rows), np.concatenate(at)
            got = self.log_probs(np.concatenate(states), cls[at], member[at])
            total += np.bincount(rows, got, len(order))
        out = np.zeros(len(order))
        out[order] = total
        return out

    def pack(self) -> np.ndarray:
        return np.concatenate([getattr(self, n).ravel() for n in self.NAMES])

    def unpack(self, flat: np.ndarray) -> GatedNet:
        at = 0
        for n in self.NAMES:
            w = getattr(self, n)
            setattr(self, n, flat[at : at + w.size].reshape(w.shape).astype(np.float32))
            at += w.size
        return self


def _chosen(logits: np.ndarray, bias: np.ndarray, choice: np.ndarray) -> np.ndarray:
    """Log probability of the chosen column of each row; overwrites logits."""
    logits += bias
    logits -= logits.max(axis=1, keepdims=True)
    got = logits[np.arange(len(logits)), choice]
    np.exp(logits, out=logits)
    return got - np.log(logits @ np.ones(logits.shape[1], np.float32))


def _off(logits: np.ndarray, bias: np.ndarray, weights: np.ndarray, choice: np.ndarray, size: int) -> np.ndarray:
    """Gradient of the mean loss by logits: probabilities less the choice, over size; overwrites logits."""
    top = bias.max()
    logits += bias - top
    if np.abs(weights).sum(axis=0).max() > 60:  # else no logit, from states below 1, is out of exp's range
        logits -= logits.max(axis=1, keepdims=True)
    np.exp(logits, out=logits)
    logits *= (np.float32(1 / size) / (logits @ np.ones(logits.shape[1], np.float32)))[:, None]
    logits[np.arange(len(logits)), choice] -= np.float32(1 / size)
    return logits


class Trainer:
    """Truncated backpropagation in windows over lanes of whole documents; the state resets at a document's start.

    Adam's moments of the input gates move only for the symbols that a window holds.
    """

    def __init__(self, net: GatedNet, c: LmConfig):
        self.net, self.c, self.t = net, c, 0
        self.m = {n: np.zeros_like(getattr(net, n)) for n in net.NAMES}
        self.v = {n: np.zeros_like(getattr(net, n)) for n in net.NAMES}

    def run(self, sym: np.ndarray, cls: np.ndarray, member: np.ndarray, bounds: np.ndarray) -> None:
        c, net = self.c, self.net
        if not len(sym):
            return
        lanes = max(1, min(c.lanes, len(sym) // c.window))
        steps = len(sym) // lanes
        start = np.zeros(len(sym), dtype=bool)
        start[bounds[:-1][np.diff(bounds) > 0]] = True
        prev = np.concatenate([[net.start], sym[:-1]])
        prev[start] = net.start
        rest = [x[lanes * steps :, None] for x in (prev, cls, member, start)]
        grid = lambda x: np.ascontiguousarray(x[: lanes * steps].reshape(lanes, steps).T)
        prev, cls, member, start = grid(prev), grid(cls), grid(member), grid(start)
        h = np.zeros((lanes, net.h), dtype=np.float32)
        for a in range(0, steps, c.window):
            b = min(steps, a + c.window)
            h = self._window(prev[a:b], cls[a:b], member[a:b], start[a:b], h)
        if len(rest[0]):  # what the lanes leave over, fewer tokens than lanes, goes on from the last one
            self._window(*rest, h[-1:])

    def _window(self, x, cls, member, start, h):
        net, k = self.net, self.net.h
        steps, lanes = x.shape
        size = steps * lanes
        gates = np.take(net.G, x.ravel(), axis=1)
        gates += net.b
        gates = gates.reshape(3, steps, lanes, k)
        kept, before, after = [], np.empty((steps, lanes, k), np.float32), np.empty((steps, lanes, k), np.float32)
        fresh = start.any(axis=1)
        for t in range(steps):
            if fresh[t]:
                h = h * ~start[t][:, None]
            before[t] = h
            h, *rest = net.step(gates[:, t], h)
            after[t] = h
            kept.append(rest)
        grad = {}
        order = np.argsort(cls.ravel().astype(np.uint16), kind="stable")
        flat, c1, m1 = after.reshape(size, k)[order], cls.ravel()[order], member.ravel()[order]
        for name in ("C", "bc", "M", "bm"):
            grad[name] = np.zeros_like(getattr(net, name))
        out, back = np.empty_like(flat), np.ascontiguousarray(net.C.T)
        for part in _parts(slice(0, size)):
            p = _off(flat[part] @ net.C, net.bc, net.C, c1[part], size)
            grad["C"] += flat[part].T @ p
            grad["bc"] += np.ones(len(p), np.float32) @ p
            np.matmul(p, back, out=out[part])
        for g, rows in _slices(c1):
            if g < len(net.M):
                weights, back = net.M[g], np.ascontiguousarray(net.M[g].T)
                for part in _parts(rows):
                    q = _off(flat[part] @ weights, net.bm[g], weights, m1[part], size)
                    grad["M"][g] += flat[part].T @ q
                    grad["bm"][g] += np.ones(len(q), np.float32) @ q
                    out[part] += q @ back
        back = np.empty_like(out)
        back[order] = out
        back = back.reshape(steps, lanes, k)
        turned = np.ascontiguousarray(net.U.transpose(0, 2, 1)).reshape(3 * k, k)
        by_gate, by_u = np.empty((size, 3 * k), np.float32), np.empty((steps, lanes, 3 * k), np.float32)
        per_step = by_gate.reshape(steps, lanes, 3 * k)
        dh = np.zeros((lanes, k), dtype=np.float32)
        for t in range(steps - 1, -1, -1):
            z, r, n, un = kept[t]
            dh += back[t]
            dn = dh * (1 - z)
            dz = dn * z
            dz *= before[t] - n
            dn *= 1 - n * n
            inner = dn * r
            dr = inner * un
            dr *= 1 - r
            for to, last in ((per_step[t], dn), (by_u[t], inner)):
                to[:, :k], to[:, k : 2 * k], to[:, 2 * k :] = dz, dr, last
            dh = dh * z
            dh += by_u[t] @ turned
            if fresh[t]:
                dh *= ~start[t][:, None]
        grad["U"] = np.ascontiguousarray((before.reshape(size, k).T @ by_u.reshape(size, 3 * k)).reshape(k, 3, k).transpose(1, 0, 2))
        order = np.argsort(x.ravel().astype(np.uint16 if net.start < 65536 else np.int64), kind="stable")
        symbol = x.ravel()[order]
        first = np.flatnonzero(np.diff(symbol, prepend=-1))
        sums = np.cumsum(np.take(by_gate, order, axis=0), axis=0, dtype=np.float32)
        grad["b"] = sums[-1].reshape(3, 1, k).copy()
        sums = np.diff(sums[np.append(first[1:], size) - 1], axis=0, prepend=np.zeros((1, 3 * k), np.float32))
        grad["G"] = np.ascontiguousarray(sums.reshape(-1, 3, k).transpose(1, 0, 2))
        self._adam(grad, symbol[first])
        return h

    def _adam(self, grad, symbols) -> None:
        self.t += 1
        norm = math.sqrt(sum(float(np.vdot(g, g)) for g in grad.values()))
        scale = np.float32(min(1.0, 1.0 / (norm + 1e-9)))
        rate = np.float32(self.c.rate * math.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t))
        for n, g in grad.items():
            w, m, v = getattr(self.net, n), self.m[n], self.v[n]
            if n == "G":
                w0, m0, v0 = w, m, v
                w, m, v = (np.take(x, symbols, axis=1) for x in (w, m, v))
            g *= scale
            m *= np.float32(0.9)
            m += np.float32(0.1) * g
            g *= g
            g *= np.float32(0.001)
            v *= np.float32(0.999)
            v += g
            np.sqrt(v, out=g)
            g += np.float32(1e-8)
            np.divide(m, g, out=g)
            g *= rate
            w -= g
            if n == "G":
                w0[:, symbols], m0[:, symbols], v0[:, symbols] = w, m, v


def _sequences(lex: Lexicon, column: pa.Array):
    h, cls, bounds = tokens_of(column)
    _, word = lex.look(h)
    return *lex.symbols(word, cls), bounds


def _train(blob: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, net = pickle.loads(zlib.decompress(blob))
        trainer, n = Trainer(net, lex.c), 0
        for batch in text_slices(batches):
            seq = _sequences(lex, batch.column("text"))
            trainer.run(*seq)
            n += len(seq[0])
        if n:
            yield _weights(n, net.pack())

    return run


def _weights(n: int, w: np.ndarray) -> pa.RecordBatch:
    """Weights that n tokens have trained, as float32 bytes."""
    return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([w.astype("<f4").tobytes()], pa.binary())], names=["n", "w"])


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, w = 0, None
    for batch in batches:
        for k, x in zip(batch.column("n").to_pylist(), batch.column("w"), strict=True):
            x = np.frombuffer(x.as_buffer(), dtype="<f4") * float(k)
            n, w = n + k, x if w is None else w + x
    if w is not None:
        yield _weights(n, w / n)


SCORED = "row long, doc_id long, held_out boolean, n_tokens long, known long, counts double, spelt double, rare array<long>, times array<int>"


def _score(blob: bytes):
    names = [x.split()[0] for x in SCORED.split(", ")]
    types = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, net = pickle.loads(zlib.decompress(blob))
        c = lex.c
        row = (TaskContext.get().partitionId() << 40) if TaskContext.get() else 0
        parts, held = [], 0

        def flush():
            nonlocal row
            size = np.concatenate([np.diff(p[5]) for p in parts])
            bounds = np.concatenate([[0], np.cumsum(size)])
            neural = net.score(*(np.concatenate([p[k] for p in parts]) for k in (2, 3, 4)), bounds) / np.log(10)
            at = 0
            for ids, held_out, _, _, _, bo, counts, h, unspelt, cls in parts:
                m, n = len(bo) - 1, len(cls)
                doc = np.repeat(np.arange(m), np.diff(bo))
                head = counts >= 0
                logs = np.log10(np.maximum(counts, 0) + c.smooth)
                total = lambda x, doc=doc, m=m: np.bincount(doc, x, m)
                # what joining the rare words will add to both sums is left out of both here
                base = total(np.where(head, logs, 0))
                spelt = neural[at : at + m] + total(np.where(unspelt, np.where(head, logs, 0) - lex.share[cls], 0))
                known = total(counts > 0)
                rare_at = np.flatnonzero(~head)
                key = np.stack([doc[rare_at], h[rare_at]]) if n else np.zeros((2, 0), np.int64)
                order = np.lexsort((key[1], key[0]))
                d, x = key[0][order], key[1][order]
                new = np.ones(len(d), dtype=bool)
                new[1:] = (d[1:] != d[:-1]) | (x[1:] != x[:-1])
                first = np.flatnonzero(new)
                times = np.diff(np.append(first, len(d))).astype(np.int32)
                offsets = pa.array(np.searchsorted(d[first], np.arange(m + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + m)), ids, held_out, pa.array(np.diff(bo).astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(base), pa.array(spelt), pa.ListArray.from_arrays(offsets, pa.array(x[first], pa.int64())), pa.ListArray.from_arrays(offsets, pa.array(times, pa.int32()))],
                    names=names,
                ).cast(pa.schema(list(zip(names, types, strict=True))))
                at += m
                row += m

        for batch in text_slices(batches):
            h, cls, bounds = tokens_of(batch.column("text"))
            counts, word = lex.look(h)
            parts.append((batch.column("doc_id"), batch.column("held_out"), *lex.symbols(word, cls), bounds, counts, h, word < 0, cls))
            held += len(h)
            if held >= c.flush:
                yield from flush()
                parts, held = [], 0
        if parts:
            yield from flush()

    return run


def frequent(counts: DataFrame, most: int) -> DataFrame:
    """The rows of counts (n) whose n is so large that there are at most `most` of them, ties all in or all out.

    Only a histogram by n, at 16 steps to a doubling, comes to the driver.
    """
    step = F.floor(F.log2("n") * 16).cast("int")
    steps = counts.groupBy(step.alias("s")).agg(F.count("*").alias("k")).orderBy(F.desc("s")).collect()  # at most 1,024 rows
    held, least = 0, 1 << 20
    for r in steps:
        if held + r["k"] > most:
            break
        held, least = held + r["k"], r["s"]
    return counts.where(step >= least)


def train(spark: SparkSession, docs: DataFrame, counts: DataFrame, c: LmConfig) -> tuple[Lexicon, GatedNet]:
    """docs: text, turn (with the text's hash it picks the warm-up); counts: h, cls, n of their words."""
    total, distinct = counts.agg(F.sum("n"), F.count("*")).first()
    top = frequent(counts, c.head).toPandas()  # at most head rows
    per = counts.groupBy("cls").agg(F.sum("n").alias("n"), F.count("*").alias("v")).toPandas()  # at most 65 rows
    n, v = np.zeros(SPELLINGS), np.zeros(SPELLINGS)
    n[per["cls"]], v[per["cls"]] = per["n"], per["v"]
    top = top.sort_values(["n", "h"], ascending=[False, True])
    lex = Lexicon(c, top["h"].to_numpy(np.int64), top["n"].to_numpy(np.int64), top["cls"].to_numpy(np.int64), n, v, int(total or 0), int(distinct))
    net = GatedNet(lex)
    # about warm_docs of the documents, those of the smallest hashes: no partition sends more than its share
    few = F.lit(float(c.warm_docs)) / F.greatest(F.lit(1), F.lit(docs.count()))
    place = F.shiftrightunsigned(F.xxhash64("turn", "text"), 11) / F.lit(float(2**53))
    warm = docs.select(place.alias("place"), "text").where(F.col("place") < few).distinct().orderBy("place", "text").limit(2 * c.warm_docs).select("text").toPandas()
    if len(warm):
        Trainer(net, c).run(*_sequences(lex, pa.array(warm["text"].tolist(), pa.string())))
    blob = zlib.compress(pickle.dumps((lex, net)), 1)
    trained, parts = docs.select("text").mapInArrow(_train(blob), "n long, w binary"), parts_for(spark)
    while parts > 1:
        parts = -(-parts // 16)
        trained = trained.repartition(parts).mapInArrow(_average, "n long, w binary")
    for r in trained.collect():  # one row
        net.unpack(np.frombuffer(r["w"], dtype="<f4"))
    return lex, net


def score_documents(spark: SparkSession, docs: DataFrame, config: LmConfig | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs (doc_id, text)."""
    c = config or LmConfig()
    s = Scratch(spark, "lm")
    crc = F.crc32(F.col("doc_id").cast("string"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("held_out", F.coalesce(crc % c.held_out_of == 0, F.lit(False)))
    learn = docs.where("not held_out").select(F.coalesce((crc / c.held_out_of).cast("long"), F.lit(0)).alias("turn"), "text")
    counts = learn.select("text").mapInArrow(_count(c), "h long, cls int, n long").groupBy("h").agg(F.max("cls").alias("cls"), F.sum("n").alias("n"))
    counts = s.save(counts, "counts")
    lex, net = train(spark, learn, counts, c)
    blob = zlib.compress(pickle.dumps((lex, net)), 1)
    scored = s.save(docs.mapInArrow(_score(blob), SCORED), "scored")
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("h"), F.col("x.times").alias("times"))
    rare = rare.join(counts.select("h", "n"), "h", "left")
    logs = F.log10(F.coalesce("n", F.lit(0)) + F.lit(c.smooth))
    rare = rare.groupBy("row").agg(F.sum(F.col("times") * logs).alias("logs"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more"))
    out = scored.drop("rare", "times").join(rare, "row", "left")
    logs, more = F.coalesce("logs", F.lit(0.0)), F.coalesce("more", F.lit(0))
    norm = float(np.log10(lex.total + c.smooth * (lex.distinct + 1)))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + more).cast("long").alias("n_known"),
        F.lit(lex.total).cast("long").alias("train_tokens"),
        (F.col("counts") + logs - F.col("n_tokens") * F.lit(norm)).alias("base_score"),
        (F.col("spelt") + logs).alias("score"),
    )
