"""Decision rules over whole candidate lists, grids of their parameters and the choice of the best.

Every query's candidates are collapsed once into an array sorted by falling p (at most `most` of them, the cap that
retrieval has anyway); a rule is an expression over that array, so any number of parameter sets is scored in one
pass: a row per query and set, summed up map-side, never a row per pair and set.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.operators.er import PAIR, Decision

Rule = Callable[[Column, dict[str, Column]], Column]


def collapsed(s1: DataFrame, truth: DataFrame, scores: DataFrame) -> DataFrame:
    """s1_id, n_true, c: candidates (p, target_id, s2, hit) by falling p, ties by target_id; empty for queries without."""
    true = truth.select(*PAIR, F.lit(1).alias("hit"))
    c = F.struct((-F.col("p")).alias("o"), "target_id", "p", F.col("target_id").startswith("S2-").alias("s2"), F.coalesce("hit", F.lit(0)).alias("hit"))
    per = scores.select(*PAIR, "p").join(true, PAIR, "left").groupBy("s1_id").agg(F.array_sort(F.collect_list(c)).alias("c"))
    known = truth.groupBy("s1_id").agg(F.count("*").alias("n_true"))
    out = s1.select("s1_id").join(known, "s1_id", "left").join(per, "s1_id", "left").na.fill(0, ["n_true"])
    return out.withColumn("c", F.coalesce("c", F.array().cast(per.schema["c"].dataType)))


def _top(c: Column) -> Column:
    return F.coalesce(F.get(c, F.lit(0))["p"], F.lit(-1.0))


def _none(c: Column) -> Column:
    return F.slice(c, 1, 0)


def by_threshold(c: Column, k: dict[str, Column]) -> Column:
    return F.filter(c, lambda x: x["p"] >= k["threshold"])


def by_top_gate(c: Column, k: dict[str, Column]) -> Column:
    """Nothing if the best is below min_top, else all from the threshold on."""
    return F.when(_top(c) < k["min_top"], _none(c)).otherwise(by_threshold(c, k))


def by_margin(c: Column, k: dict[str, Column]) -> Column:
    """All from the threshold on that are at most margin below the best."""
    top = _top(c)
    return F.filter(c, lambda x: (x["p"] >= k["threshold"]) & (F.round(top - x["p"], 9) <= k["margin"]))


def by_prefix(c: Column, k: dict[str, Column]) -> Column:
    """From a best of min_top on: it, and of the next nine as many as reach 0.55 without a gap."""
    rest = F.slice(c, 2, 9)
    fails = F.filter(F.transform(rest, lambda x, i: F.when(x["p"] < 0.55, i)), lambda i: i.isNotNull())
    n = F.coalesce(F.array_min(fails), F.size(rest)) + 1
    return F.when(_top(c) < k["min_top"], _none(c)).otherwise(F.slice(c, F.lit(1), n.cast("int")))


def by_rank(c: Column, k: dict[str, Column]) -> Column:
    return by_threshold(F.slice(c, F.lit(1), k["max_k"].cast("int")), k)


def by_rising_threshold(c: Column, k: dict[str, Column]) -> Column:
    """The threshold rises by 0.04 with every rank."""
    return F.filter(c, lambda x, i: x["p"] >= F.round(k["threshold"] + 0.04 * i, 9))


def by_source(c: Column, k: dict[str, Column]) -> Column:
    return F.filter(c, lambda x: x["p"] >= F.when(x["s2"], k["s2"]).otherwise(k["s3"]))


def by_near_top(c: Column, k: dict[str, Column]) -> Column:
    """From a best of threshold on: it, and others from the threshold on within margin of it."""
    return F.when(_top(c) < k["threshold"], _none(c)).otherwise(by_margin(c, k))


def by_dynamic_gap(c: Column, k: dict[str, Column]) -> Column:
    """As by_near_top, the margin shrinking with the square of the best."""
    top = _top(c)
    return F.when(top < k["threshold"], _none(c)).otherwise(F.filter(c, lambda x: (x["p"] >= k["threshold"]) & (F.round(top - x["p"], 9) <= F.round(k["margin"] * top * top, 9))))


def by_expected_f(c: Column, k: dict[str, Column]) -> Column:
    """The prefix of the largest expected F0.5, with 1.5 matches expected; its last candidate reaches `least`."""
    sums = F.transform(F.sequence(F.lit(1), F.greatest(F.size(c), F.lit(1))), lambda n: F.aggregate(F.slice(c, F.lit(1), n), F.lit(0.0), lambda s, x: s + x["p"]))

    def expected(s: Column, i: Column) -> Column:
        p, r = s / (i + 1), s / 1.5
        f = F.round(1.25 * p * r / (0.25 * p + r + 1e-8), 9)
        return F.struct(F.when(F.get(c, i)["p"] >= k["least"], f).otherwise(F.lit(0.0)).alias("f"), (-(i + 1)).alias("n"))

    best = F.array_max(F.transform(sums, expected))
    return F.when((F.size(c) == 0) | (best["f"] <= 0), _none(c)).otherwise(F.slice(c, F.lit(1), (-best["n"]).cast("int")))


def by_capacity(c: Column, k: dict[str, Column]) -> Column:
    """The adaptive rule: gates on the best, then others near it, at most per_source (0: any number) of each source."""
    top, first = _top(c), F.get(c, F.lit(0))
    own = lambda x: F.when(x["s2"], k["s2"]).otherwise(k["s3"])
    second = F.coalesce(F.get(c, F.lit(1))["p"], F.lit(0.0))
    unsure = (top < F.round(own(first) + 0.05, 9)) & (F.round(top - second, 9) < k["min_margin"]) & (F.size(c) > 1)
    stop = (F.size(c) == 0) | (top < F.greatest(k["min_top"], own(first))) | unsure
    rest = F.filter(c, lambda x, i: (i == 0) | ((x["p"] >= F.greatest(own(x), k["multi"])) & (F.round(top - x["p"], 9) <= k["max_drop"])))
    most = F.when(k["per_source"] > 0, k["per_source"]).otherwise(F.greatest(F.size(c), F.lit(1))).cast("int")
    s2, s3 = F.filter(rest, lambda x: x["s2"]), F.filter(rest, lambda x: ~x["s2"])
    return F.when(stop, _none(c)).otherwise(F.concat(F.slice(s2, F.lit(1), most), F.slice(s3, F.lit(1), most)))


def _sets(sets: list[dict[str, float]]) -> Column:
    """The parameter sets as a literal array of structs (number, then values by name)."""
    names = sorted({k for s in sets for k in s})
    return F.array(*[F.struct(F.lit(i).alias("set"), *[F.lit(float(s.get(k, 0.0))).alias(k) for k in names]) for i, s in enumerate(sets)])


def scored_sets(lists: DataFrame, rule: Rule, sets: list[dict[str, float]], by: list[str] | None = None) -> DataFrame:
    """Macro F0.5, precision and recall of a rule under every parameter set: a row per set (and group in by)."""
    names = sorted({k for s in sets for k in s})
    rows = lists.withColumn("k", F.explode(_sets(sets)))
    taken = rule(F.col("c"), {n: F.col(f"k.{n}") for n in names})
    rows = rows.withColumn("taken", taken).withColumn("n_pred", F.size("taken"))
    rows = rows.withColumn("n_hit", F.aggregate("taken", F.lit(0), lambda s, x: s + x["hit"]))
    m, n, h = F.col("n_true"), F.col("n_pred"), F.col("n_hit")
    f = F.when((m == 0) & (n == 0), 1.0).when(h == 0, 0.0).otherwise(1.25 * h / (0.25 * m + n))
    p = F.when((m == 0) & (n == 0), 1.0).when(n == 0, 0.0).otherwise(h / n)
    r = F.when((m == 0) & (n == 0), 1.0).when(m == 0, 0.0).otherwise(h / m)
    mean = lambda c, name: F.round(F.avg(c), 6).alias(name)
    return rows.groupBy(F.col("k.set").alias("set"), *[F.col(f"k.{x}").alias(x) for x in names], *(by or [])).agg(mean(f, "macro_f"), mean(p, "macro_precision"), mean(r, "macro_recall"), mean(n, "mean_picks"))


def best_set(scored: DataFrame) -> DataFrame:
    """The set of the largest macro F, the first of equals."""
    return scored.orderBy(F.desc("macro_f"), "set").limit(1)


def grid(**values: list[float]) -> list[dict[str, float]]:
    """All combinations, the last name varying fastest."""
    out: list[dict[str, float]] = [{}]
    for k, vs in values.items():
        out = [{**o, k: float(v)} for o in out for v in vs]
    return out


def steps(low: float, high: float, step: float) -> list[float]:
    return [round(low + i * step, 6) for i in range(round((high - low) / step) + 1)]


COARSE = grid(threshold=steps(0.01, 0.99, 0.01))
SINGLETON = [{"min_top": a, "threshold": b} for a in steps(0.50, 0.85, 0.05) for b in steps(0.35, a, 0.05)]
CAPACITIES = {"max_1": (1, False), "max_2": (2, False), "max_3": (3, False), "no_limit": (0, False), "adaptive": (3, True)}

#: The six strategies that are compared, each with its own grid.
STRATEGIES: dict[str, tuple[Rule, list[dict[str, float]]]] = {
    "threshold": (by_threshold, grid(threshold=steps(0.50, 0.96, 0.02))),
    "top_gate": (by_top_gate, grid(min_top=[0.60, 0.70, 0.75, 0.80, 0.85, 0.90], threshold=[0.55, 0.60, 0.65, 0.70, 0.75, 0.80])),
    "margin": (by_near_top, grid(threshold=[0.60, 0.70, 0.75, 0.80], margin=[0.05, 0.10, 0.15, 0.20])),
    "prefix": (by_prefix, grid(min_top=[0.50, 0.60, 0.70, 0.80])),
    "rank": (by_rank, grid(max_k=[1, 2, 3, 5], threshold=[0.55, 0.65, 0.75, 0.82])),
    "source": (by_source, grid(s2=[0.50, 0.60, 0.70], s3=[0.50, 0.60, 0.70])),
}


def fine_search(lists: DataFrame) -> DataFrame:
    """The best threshold: coarse steps of 0.01, then 0.0025 within 0.10 of the best of them."""
    top = best_set(scored_sets(lists, by_threshold, COARSE)).first()["threshold"]
    return best_set(scored_sets(lists, by_threshold, grid(threshold=steps(max(0.0025, top - 0.10), min(0.9975, top + 0.10), 0.0025))))


def compare_strategies(lists: DataFrame, strategies: dict[str, tuple[Rule, list[dict[str, float]]]] | None = None) -> DataFrame:
    """The best set's figures of every strategy."""
    out = None
    for name, (rule, sets) in (strategies or STRATEGIES).items():
        one = best_set(scored_sets(lists, rule, sets)).select(F.lit(name).alias("strategy"), "set", "macro_f", "macro_precision", "macro_recall")
        out = one if out is None else out.unionByName(one)
    return out


def picks(lists: DataFrame, rule: Rule, **values: float) -> DataFrame:
    """picks(s1_id, target_id, p) of a rule under one parameter set."""
    taken = rule(F.col("c"), {k: F.lit(float(v)) for k, v in values.items()})
    return lists.select("s1_id", F.explode(taken).alias("x")).select("s1_id", "x.target_id", "x.p")


def precision_prune(scores: DataFrame, countries: DataFrame, least: float = 0.58, drop: float = 0.12, other: float = 0.62) -> DataFrame:
    """Pairs of known, different countries and those below least go; of the rest the best stays, and others from
    `other` on within drop of it. countries: id, country as written."""
    code = countries.select("id", "country")
    s = scores.join(code.toDF("s1_id", "qc"), "s1_id", "left").join(code.toDF("target_id", "tc"), "target_id", "left").na.fill("", ["qc", "tc"])
    s = s.where((F.col("qc") == "") | (F.col("tc") == "") | (F.col("qc") == F.col("tc"))).where(F.col("p") >= least)
    s = s.withColumn("rn", F.row_number().over(W.partitionBy("s1_id").orderBy(F.desc("p"), "target_id"))).withColumn("top", F.max("p").over(W.partitionBy("s1_id")))
    return s.where((F.col("rn") == 1) | ((F.round(F.col("top") - F.col("p"), 9) <= drop) & (F.col("p") >= other))).select(*PAIR, "p")


def recover(picked: DataFrame, candidates: DataFrame, names: DataFrame, least: float = 0.85, most: int = 3) -> DataFrame:
    """picked, and for queries without any their candidates of token-sort similarity from least on, `most` at most."""
    from lodestar.functions import fuzzy

    lone = candidates.select(*PAIR).join(picked.select("s1_id").distinct(), "s1_id", "left_anti")
    n = names.select("id", "n")
    lone = lone.join(n.toDF("s1_id", "qn"), "s1_id").join(n.toDF("target_id", "tn"), "target_id").withColumn("p", F.round(fuzzy.token_sort_of(F.col("qn"), F.col("tn")), 6))
    lone = lone.where(F.col("p") >= least).withColumn("rn", F.row_number().over(W.partitionBy("s1_id").orderBy(F.desc("p"), "target_id"))).where(f"rn <= {most}")
    return picked.select(*PAIR, "p", F.lit(False).alias("recovered")).unionByName(lone.select(*PAIR, "p", F.lit(True).alias("recovered")))


def similarity_prune(picked: DataFrame, names: DataFrame, least: float = 0.60) -> DataFrame:
    """Every query's picks of token-sort similarity from least on, joined by commas by falling similarity."""
    from lodestar.functions import fuzzy

    n = names.select("id", "n")
    j = picked.select(*PAIR).join(n.toDF("s1_id", "qn"), "s1_id").join(n.toDF("target_id", "tn"), "target_id").withColumn("sim", F.round(fuzzy.token_sort_of(F.col("qn"), F.col("tn")), 6))
    kept = j.where(F.col("sim") >= least).groupBy("s1_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("sim")).alias("o"), "target_id"))).alias("x"))
    return kept.select("s1_id", F.array_join(F.transform("x", lambda y: y["target_id"]), ",").alias("matched_entity_ids"))


def keep_best(scores: DataFrame) -> DataFrame:
    """One row per pair, that of the largest p."""
    return scores.groupBy(*PAIR).agg(F.max("p").alias("p"))


def to_json(d: Decision) -> str:
    return json.dumps(asdict(d), sort_keys=True)


def from_json(text: str) -> Decision:
    return Decision(**json.loads(text))
