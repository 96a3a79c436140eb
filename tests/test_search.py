import math
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestar.operators import er


def brute(queries, targets, k, low, high, min_df=2, max_df=1.0, least=0.0):
    def counts(t):
        t = t or "unknown"
        return Counter(t[i : i + n] for n in range(low, high + 1) for i in range(len(t) - n + 1))

    df = Counter(g for _, t in targets for g in counts(t))
    idf = {g: math.log((len(targets) + 1) / (n + 1)) + 1 for g, n in df.items() if min_df <= n <= max_df * len(targets)}

    def unit(t):
        w = {g: (1 + math.log(n)) * idf[g] for g, n in counts(t).items() if g in idf}
        return {g: x / math.sqrt(sum(y * y for y in w.values())) for g, x in w.items()}

    units, out = [(i, unit(t)) for i, t in targets], {}
    for q, t in queries:
        u = unit(t)
        found = [(-round(sum(x * v[g] for g, x in u.items() if g in v), 6), i) for i, v in units if u.keys() & v.keys()]
        for rank, (s, i) in enumerate(sorted(x for x in found if -x[0] >= least)[:k], 1):
            out[q, i] = (-s, rank)
    return out


@pytest.mark.parametrize("sizes, letters", [((1 << 17, 1 << 14), "ab 0"), ((40, 15), "ab 0"), ((40, 15), "aé😀")])
def test_best_by_tfidf_in_blocks(spark, monkeypatch, sizes, letters):
    from lodestar.operators import search

    monkeypatch.setattr(search, "TARGETS", sizes[0])
    monkeypatch.setattr(search, "QUERIES", sizes[1])
    rng = random.Random(5)
    text = lambda: "shop" + "".join(rng.choice(letters) for _ in range(rng.randint(0, 7)))
    queries = [(f"S1-{i}", text()) for i in range(40)] + [("S1-x", ""), ("S1-y", "zzzz")]
    targets = [(f"S2-{i}", text()) for i in range(150)] + [("S2-x", ""), ("S3-x", "")]
    frame = lambda rows: spark.createDataFrame(rows, "id string, t string")
    for how in ({"k": 7, "low": 3, "high": 5}, {"k": 4, "low": 3, "high": 3, "max_df": 0.25, "least": 0.2}):
        got = er.tfidf_topk(frame(queries), frame(targets), **how)
        assert {(r["s1_id"], r["target_id"]): (r["sim"], r["rank"]) for r in got.collect()} == brute(queries, targets, **how)


def test_pairs_of_a_common_gram_never_are_rows(spark):
    """60 x 60 names that share a gram: no join may bring the products of their vectors into rows."""
    ids = spark.range(60).select(F.col("id").cast("string").alias("id"), F.concat(F.lit("same "), F.col("id") + 100).alias("t"))
    got = er.tfidf_topk(ids, ids, 2)
    assert got.count() == 120
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Join" in line and "gram" in line]


def test_grams_of_many_letters_are_told_apart():
    from lodestar.operators import search

    rng = random.Random(3)
    letters = [chr(0x4E00 + i) for i in range(9000)]
    texts = ["".join(rng.sample(letters, 40)) for _ in range(300)]
    grams = sorted({t[i : i + n] for t in texts[:250] for n in (3, 5) for i in range(len(t) - n + 1)})
    vocabulary = search.Vocabulary(pa.array(grams), pa.array(range(1, len(grams) + 1), pa.float64()).to_numpy())
    rows, found, _, _ = vocabulary.vectors(pa.array(texts))
    known = set(grams)
    want = {(i, g) for i, t in enumerate(texts) for n in (3, 5) for j in range(len(t) - n + 1) if (g := t[j : j + n]) in known}
    assert {(int(i), grams[g]) for i, g in zip(rows, found, strict=True)} == want


def test_nine_routes_parse_and_block_once(spark, monkeypatch):
    """Records and hits are written and read back: parsed and blocked anew for each use, plans fill the driver."""
    from lodestar.plans import catalog

    rows = [("S1-1", "S1", 1, "acme steel", "12 oak lane 40001", "x"), ("S2-1", "S2", 1, "acme steel", "12 oak lane 40001", "x"), ("S3-1", "S3", 1, "acme foods", "9 elm road 40001", "x")]
    rec = spark.createDataFrame(rows, "id string, src string, seq long, name string, addr string, country string")
    monkeypatch.setattr(catalog, "records", lambda spark, d: rec)
    calls = Counter()
    for name in ("parse", "blocked"):
        monkeypatch.setattr(er, name, lambda *a, f=getattr(er, name), n=name, **b: calls.update([n]) or f(*a, **b))
    funnel = catalog.queries()["recall_funnel_nine_routes"](spark, "")
    assert calls == {"parse": 1, "blocked": 1}
    assert funnel.count() > 0


def test_nine_routes_are_written_one_by_one_and_broadcast_nothing(spark, monkeypatch):
    """A plan of all routes at once, and records that are broadcast by their compressed size, fill the driver."""
    from lodestar.plans import catalog
    from lodestar.sources.scratch import Scratch

    rows = [("S1-1", "S1", 1, "acme steel", "12 oak lane 40001", "x"), ("S2-1", "S2", 1, "acme steel", "12 oak lane 40001", "x"), ("S3-1", "S3", 1, "acme foods", "9 elm road 40001", "x")]
    rec = spark.createDataFrame(rows, "id string, src string, seq long, name string, addr string, country string")
    monkeypatch.setattr(catalog, "records", lambda spark, d: rec)
    saved, plan = [], lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(Scratch, "save", lambda self, df, name, *a, f=Scratch.save, **b: saved.append((name, plan(df))) or f(self, df, name, *a, **b))
    features = catalog.queries()["pair_features_nine_routes"](spark, "")
    assert {r["target_id"] for r in features.collect()} == {"S2-1", "S3-1"}
    assert Counter(n for n, _ in saved) == {"parsed": 1, "keys": 1, "blocked": 1, "hits": 5, "pairs": 1}
    assert not [n for n, p in [*saved, ("result", plan(features))] if "Broadcast" in p]


def test_a_task_gives_k_rows_a_query_for_all_its_blocks(monkeypatch):
    """What each block of targets gave by itself was shuffled, with the texts, and filled the disk."""
    from lodestar.operators import search

    monkeypatch.setattr(search, "TARGETS", 10)
    texts = [f"name {i:03d}" for i in range(40)]
    grams = ["nam", "ame", "me ", "e 0", " 03", "039", "000"]
    kinds = [search.VOCAB] * len(grams) + [search.TARGET] * 40 + [search.QUERY]
    firsts = [None] * len(grams) + [f"S2-{i:02d}" for i in range(40)] + [None]
    cell = pa.table({"kind": kinds, "t": [*grams, *texts, "name 039"], "first": firsts, "x": [1.0] * len(grams) + [None] * 41})
    got = search.best(cell, 3, 3, 3, 0.0)
    assert got.column_names == ["q", "first", "sim"]
    assert got["first"].to_pylist() == ["S2-39", "S2-30", "S2-31"]
