"""Language identification by cross-parsing entropy.

A suffix automaton of each language's labelled text gives the longest match of a text from any position
on. Parsing a text greedily into such longest matches, the language that needs the fewest phrases (times
the log of its training length, over the text's length) is the nearest one.

Texts are lowered; every run of non-letters counts as one space. All texts of a batch are parsed in step:
each is dealt into lanes of equal length, whose phrase counts are added, so whole texts are read however
long they are. A letter that no labelled text has is a phrase by itself. Defined results: `und` with score 0
for null text or text without a letter, and for all if there is nothing to learn from; ties go to the language
that is first by code point; rows that repeat get the same result each, and count once in the sample learnt
from; an empty table gives no rows; other columns are passed on, clashing ones as said at identify.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.llm.common import text_slices


@dataclass(frozen=True)
class LangConfig:
    """rows, chars: bound of the labelled sample per language (rows of smallest hash, of any length, until chars
    letters are reached; what goes beyond chars is not learnt). The samples are made equally long: all are cut to
    the shortest language's letters, but not below a quarter of chars. lane: letters parsed in one lane."""

    rows: int = 100
    chars: int = 30_000
    lane: int = 400
    undecided: str = "und"


@dataclass
class Automaton:
    """goto: next state by state and letter class, 0 where there is none (state 1 is the root)."""

    lang: str
    goto: np.ndarray
    size: int


def _fold(text: str) -> str:
    return "".join(c if c.isalpha() else " " for c in text.lower())


def suffix_automaton(symbols: list[int], width: int) -> np.ndarray:
    """Dense goto table of the suffix automaton of symbols; row 0 is the dead state, row 1 the root."""
    link, length, goto = [0, 0], [0, 0], [{}, {}]
    last = 1
    for s in symbols:
        new = len(link)
        link.append(0)
        length.append(length[last] + 1)
        goto.append({})
        p = last
        while p and s not in goto[p]:
            goto[p][s] = new
            p = link[p]
        if not p:
            link[new] = 1
        else:
            q = goto[p][s]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(link)
                link.append(link[q])
                length.append(length[p] + 1)
                goto.append(dict(goto[q]))
                while p and goto[p].get(s) == q:
                    goto[p][s] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    kind = np.uint16 if len(link) < 65536 else np.int32
    table = np.zeros((len(link), width), dtype=kind)
    for state, nexts in enumerate(goto):
        for s, to in nexts.items():
            table[state, s] = to
    return table


@dataclass
class LangModel:
    """letters: code points with a class of their own, from 2 on; class 1 is space, 0 any other letter."""

    config: LangConfig
    texts: dict[str, str]
    letters: np.ndarray = field(init=False)
    automata: list[Automaton] = field(init=False)

    def __post_init__(self):
        self.letters = np.array(sorted({ord(c) for t in self.texts.values() for c in t} - {32}), dtype=np.uint32)
        self.width = len(self.letters) + 2
        self.table = np.full(0x110000, 255, dtype=np.uint16)
        self.table[self.letters] = np.arange(2, self.width)
        self.table[32] = 1
        self.automata = [Automaton(lang, suffix_automaton(self.classes(t).tolist(), self.width).ravel(), len(t)) for lang, t in sorted(self.texts.items())]

    def classes(self, text: str) -> np.ndarray:
        """Letter classes of a text; runs of spaces are one."""
        cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        got = self.table[cp]
        for x in np.unique(cp[got == 255]):
            self.table[x] = 0 if chr(x).isalpha() else 1
        got = self.table[cp]
        space = got == 1
        if len(got):
            keep = ~space
            keep[1:] |= ~space[:-1]
            got = got[keep]
        return got

    def phrases(self, lanes: np.ndarray) -> np.ndarray:
        """(languages, lanes) phrases of lanes (steps, lanes) of letter classes; padding is class width."""
        out = np.zeros((len(self.automata), lanes.shape[1]), dtype=np.int64)
        steps = lanes.astype(np.int64)
        live = lanes < self.width
        for k, a in enumerate(self.automata):
            state = np.ones(lanes.shape[1], dtype=np.int64)
            count = np.zeros(lanes.shape[1], dtype=np.int64)
            for t in range(len(steps)):
                on = live[t]
                c = np.where(on, steps[t], 0)
                nxt = a.goto[state * self.width + c].astype(np.int64)
                stop = (nxt == 0) & on
                # the letter that ended a phrase, if there was one, begins the next; one that no text has is its own
                again = a.goto[self.width + c].astype(np.int64)
                count += stop & (state != 1)
                count += stop & (again == 0)
                state = np.where(stop, np.maximum(again, 1), np.where(on, nxt, state))
            out[k] = count + (state != 1)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        c = self.config
        seqs = [self.classes(x) if x else np.zeros(0, np.uint16) for x in texts]
        letters = np.array([bool(len(s)) and bool((s != 1).any()) for s in seqs])
        size = np.array([len(s) for s in seqs], dtype=np.int64)
        totals = np.zeros((len(self.automata), len(texts)), dtype=np.int64)
        n = np.where(letters, -(-size // c.lane), 0)
        doc = np.repeat(np.arange(len(texts)), n)
        if len(doc) and self.automata:
            flat = np.concatenate([s for s, ok in zip(seqs, letters, strict=True) if ok])
            own = np.where(letters, size, 0)
            begin = np.repeat(np.cumsum(own) - own, n) + (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * c.lane
            stop = np.minimum(begin + c.lane, np.repeat(np.cumsum(own), n))
            order = np.argsort(begin - stop, kind="stable")  # full lanes first
            for i in range(0, len(doc), 4096):
                part = order[i : i + 4096]
                longest = int((stop[part] - begin[part]).max())
                at = begin[part][None, :] + np.arange(longest)[:, None]
                lanes = np.where(at < stop[part][None, :], flat[np.minimum(at, len(flat) - 1)], self.width)
                got = self.phrases(lanes)
                for k in range(len(got)):
                    totals[k] += np.bincount(doc[part], weights=got[k], minlength=len(texts)).astype(np.int64)
        langs, scores = [], []
        weight = np.array([np.log2(a.size + 2) for a in self.automata])
        for i in range(len(texts)):
            if not letters[i] or not self.automata:
                langs.append(c.undecided)
                scores.append(0.0)
                continue
            bits = totals[:, i] * weight
            best = int(np.argmin(bits))
            likely = 2.0 ** -np.minimum(bits - bits[best], 60)
            langs.append(self.automata[best].lang)
            scores.append(float(1 / likely.sum()))
        return langs, scores


def training_texts(docs: DataFrame, c: LangConfig) -> dict[str, str]:
    """Labelled text per language, equally much of each: at most `rows` texts by smallest hash of the text, one at
    least, until `chars` letters are reached; then as many letters of each as the shortest language has, but no
    fewer than a quarter of `chars` where there are as many."""
    docs = docs.where("lang is not null and text is not null").select(F.col("lang").cast("string").alias("lang"), "text").where(F.col("text").rlike(r"\p{L}"))
    # places of texts in [0, 1) by hash; below 4 * rows / texts lie about 4 * rows of a language's, below 1 all
    place = F.shiftrightunsigned(F.xxhash64("text"), 11) / F.lit(float(2**53))
    least = docs.groupBy("lang").agg((F.lit(4.0 * c.rows) / F.approx_count_distinct(F.xxhash64("text"))).alias("upto"))
    # a row per language, as many as automata that every task gets anyway; so the texts themselves aren't dealt by language
    first = docs.withColumn("place", place).join(F.broadcast(least), "lang").where("place < upto").select("lang", "text", "place").distinct()
    order = W.partitionBy("lang").orderBy("place", "text")
    got: dict[str, list[str]] = {}
    first = first.withColumn("rn", F.row_number().over(order)).where(f"rn <= {c.rows}")
    before = F.sum(F.length(F.regexp_replace("text", r"[^\p{L}]+", " "))).over(W.partitionBy("lang").orderBy("rn").rowsBetween(W.unboundedPreceding, -1))
    for r in first.withColumn("before", F.coalesce(before, F.lit(0))).where(f"before < {c.chars}").orderBy("lang", "rn").collect():
        got.setdefault(r["lang"], []).append(r["text"])
    joined = {lang: " ".join(_fold(" ".join(ts)).split()) for lang, ts in got.items()}
    joined = {lang: t for lang, t in joined.items() if t}
    least = min([c.chars, *map(len, joined.values())])
    return {lang: t[: max(least, min(len(t), c.chars // 4))] for lang, t in joined.items()}


_models: dict[tuple, LangModel] = {}


def _predict(texts: dict[str, str], c: LangConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (c, tuple(sorted(texts.items())))
        if key not in _models:
            _models.clear()
            _models[key] = LangModel(c, texts)
        model = _models[key]
        for part in text_slices(batches, rows=500):
            langs, scores = model.predict(part.column("text").to_pylist())
            cols = [part.column(k) for k in part.schema.names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*part.schema.names, "_lang_pred", "_score"])

    return run


def identify(spark: SparkSession, docs: DataFrame, labelled: DataFrame, config: LangConfig | None = None) -> DataFrame:
    """docs with columns _lang_pred and _score (in place of any that docs have by these names). labelled: lang, text to
    learn from; of docs only text is read."""
    c = config or LangConfig()
    docs = docs.drop("_lang_pred", "_score")
    texts = training_texts(labelled, c)
    from pyspark.sql.types import DoubleType, StringType, StructType

    schema = StructType([*docs.schema.fields]).add("_lang_pred", StringType()).add("_score", DoubleType())
    return docs.mapInArrow(_predict(texts, c), schema)
