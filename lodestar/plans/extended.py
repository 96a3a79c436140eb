"""Queries of presets, grids, audits, samples and forensics, and their SQL.

They run over the records of the catalog or, where its tables hold no such case, over a fixture of a few records
with equal and reordered names, legal forms, address words, missing fields and repeats.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.operators import audit, blocking, er, features, forensics, learn, rules, sampling
from lodestar.plans import catalog as c
from lodestar.sources import tables

Query = Callable[[SparkSession, str], DataFrame]

DECISION = er.Decision(strategy="adaptive_multi", threshold=0.35, s2=0.34, s3=0.30, min_top=0.3, multi=0.28, max_drop=0.3)
SOURCE_GRID = rules.grid(s2=[0.2, 0.3, 0.4, 0.5], s3=[0.2, 0.3, 0.4])
ADAPTIVE_GRID = rules.grid(s2=[0.25, 0.35, 0.45], s3=[0.30], min_top=[0.2, 0.3, 0.4], min_margin=[0.0, 0.05, 0.1], multi=[0.28, 0.4], max_drop=[0.1, 0.3], per_source=[1, 3])
CAPACITY_GRID = [{"s2": 0.34, "s3": 0.30, "min_top": 0.3, "min_margin": 0.0, "multi": 0.30 if near else 0.28, "max_drop": 0.12 if near else 0.16, "per_source": float(k)} for k, near in rules.CAPACITIES.values()]
SMALL = {
    "threshold": (rules.by_threshold, rules.grid(threshold=rules.steps(0.20, 0.80, 0.02))),
    "top_gate": (rules.by_top_gate, rules.grid(min_top=[0.3, 0.4, 0.5], threshold=[0.25, 0.35, 0.45])),
    "margin": (rules.by_near_top, rules.grid(threshold=[0.25, 0.35, 0.45], margin=[0.05, 0.10, 0.20])),
    "rank": (rules.by_rank, rules.grid(max_k=[1, 2, 3, 5], threshold=[0.25, 0.35, 0.45])),
    "source": (rules.by_source, SOURCE_GRID),
}
POINTS = {"A": ("exact_name", "name_sig"), "B": ("exact_name", "name_sig", "rare_token"), "C": tuple(c.CAPS)}


def _pairs(spark, d):
    return er.union_provenance(c._hits(spark, d))


def _few(spark, d):
    """Pairs of equal and reordered names alone, so that most true pairs are missed."""
    return er.union_provenance(c._hits(spark, d, "exact_name", "name_sig"))


def _lists(spark, d):
    return rules.collapsed(c._s1(spark, d), c._truth(spark, d), c._scores(spark, d))


def _picks(spark, d):
    return c._decided("global")(spark, d)


def _similar(scale: float = 1.0):
    """Name and address similarity in built-in functions: token overlap and Jaccard."""
    q, t = F.col("q.name_tokens"), F.col("t.name_tokens")
    return scale * er.overlap(q, t), scale * er.jaccard(F.col("q.addr_tokens"), F.col("t.addr_tokens"))


def _bands(name: str) -> Query:
    def run(spark, d):
        bands = blocking.PRESETS[name]
        if blocking.unbounded(bands):
            return blocking.whole_pairs(c.parsed(spark, d), bands)
        p = blocking.pairs_of(blocking.banded(c.parsed(spark, d), bands))
        return p.select(*er.PAIR, F.array_join("routes", ",").alias("routes"), "n_routes")

    return run


def pairs_with_country(spark, d):
    return blocking.with_country(_pairs(spark, d), c.parsed(spark, d)).select(*er.PAIR, F.array_join("routes", ",").alias("routes"), "n_routes")


def bands_preranked(spark, d):
    p = c.parsed(spark, d)
    return blocking.preranked(blocking.pairs_of(blocking.banded(p, blocking.PRESETS["prune_conservative"])), p, 50).select(*er.PAIR, "n_routes")


def bands_first_records(spark, d):
    """The seven-route preset over the first 500 records of each source."""
    p = blocking.pairs_of(blocking.banded(c.parsed(spark, d), blocking.PRESETS["seven"], limit=500))
    return p.select(*er.PAIR, F.array_join("routes", ",").alias("routes"), "n_routes")


def _flags(spark, d):
    return blocking.rule_flags(er.join_records(c._truth(spark, d), c.parsed(spark, d)))


def rule_report(spark, d):
    return blocking.rule_report(_flags(spark, d))


def removal_waterfall(spark, d):
    return blocking.removal_waterfall(_flags(spark, d))


def route_matrix(spark, d):
    return blocking.route_matrix(_pairs(spark, d), c._truth(spark, d), tuple(c.CAPS))


def operating_points(spark, d):
    return blocking.operating_points(_pairs(spark, d), c._truth(spark, d), POINTS)


def route_algebra(spark, d):
    return blocking.route_algebra(_pairs(spark, d), "postal", "building")


def route_report(spark, d):
    r = c.records(spark, d).agg(F.count_if(F.col("src") == "S1").alias("q"), F.count_if(F.col("src") != "S1").alias("t")).first()
    return blocking.route_report(c._hits(spark, d), c._truth(spark, d), r["q"], r["t"])


def _scored(rule: rules.Rule, sets: list[dict[str, float]]) -> Query:
    return lambda spark, d: rules.scored_sets(_lists(spark, d), rule, sets)


def best_threshold(spark, d):
    return er.best_threshold(c.threshold_sweep(spark, d))


def fine_threshold(spark, d):
    return rules.fine_search(_lists(spark, d)).select("threshold", "macro_f")


def strategy_comparison(spark, d):
    return rules.compare_strategies(_lists(spark, d), SMALL).select("strategy", "set", "macro_f")


def _ruled(rule: rules.Rule, **values: float) -> Query:
    return lambda spark, d: rules.picks(_lists(spark, d), rule, **values)


def precision_prune(spark, d):
    return rules.precision_prune(c._scores(spark, d), c.records(spark, d), 0.30, 0.12, 0.34)


def recall_recovery(spark, d):
    return rules.recover(_picks(spark, d), _pairs(spark, d), c.parsed(spark, d), least=0.5)


def similarity_prune(spark, d):
    return rules.similarity_prune(_picks(spark, d), c.parsed(spark, d), 0.3)


#: Twelve score maps, whether the query has an address, and the targets that the adaptive rule must pick.
STRESS = (
    ({"S2-1": 0.35, "S3-1": 0.30}, True, ""), ({"S2-1": 0.22, "S2-2": 0.18, "S3-1": 0.15}, True, ""), ({"S2-1": 0.85, "S3-1": 0.82}, True, "S2-1,S3-1"), ({"S2-1": 0.48}, False, ""), ({"S2-1": 0.75, "S3-1": 0.20}, True, "S2-1"),
    ({"S2-1": 0.70, "S2-2": 0.40}, True, "S2-1"), ({"S2-1": 0.30, "S3-1": 0.28}, True, ""), ({"S2-1": 0.35, "S2-2": 0.25}, True, ""), ({"S2-1": 0.65, "S2-2": 0.32}, True, "S2-1"), ({"S3-1": 0.78}, True, "S3-1"),
    ({"S2-1": 0.10, "S3-1": 0.05}, True, ""), ({"S2-1": 0.95, "S3-1": 0.50, "S2-2": 0.48}, True, "S2-1"),
)
STRESSED = er.Decision(s2=0.4775, s3=0.4975, min_top=0.428, min_margin=0.0, multi=0.458, max_drop=0.16, per_source=3, boost=0.05)


def decision_stress(spark, d):
    rows = [(f"S1-{i}", t, p) for i, (scores, _, _) in enumerate(STRESS, 1) for t, p in scores.items()]
    scores = spark.createDataFrame(rows, "s1_id string, target_id string, p double")
    meta = spark.createDataFrame([(f"S1-{i}", addr) for i, (_, addr, _) in enumerate(STRESS, 1)], "s1_id string, has_addr boolean")
    return er.prediction_lists(meta.select("s1_id"), er.decide(scores, STRESSED, meta))


def decide_without_address(spark, d):
    """The adaptive rule where the queries of even number have no address, so that their thresholds are raised."""
    s1 = c._s1(spark, d).withColumn("has_addr", F.expr("cast(substring(s1_id, 4) as long) % 2 = 1"))
    return er.decide(c._scores(spark, d), DECISION, s1)


def decide_margin_without_address(spark, d):
    s1 = c._s1(spark, d).withColumn("has_addr", F.expr("cast(substring(s1_id, 4) as long) % 2 = 1"))
    return er.decide(c._scores(spark, d), er.Decision(strategy="margin_abstention", threshold=0.35, min_top=0.3), s1)


def table_audit(spark, d):
    r = c.records(spark, d)
    return audit.table_audit({s: (r.where(F.col("src") == s), "id") for s in ("S1", "S2", "S3")})


def truth_audit(spark, d):
    return audit.truth_audit(c._s1(spark, d), c._truth(spark, d))


def match_counts(spark, d):
    return audit.match_counts(c._s1(spark, d), c._truth(spark, d))


def top_countries(spark, d):
    return audit.top_countries(c.records(spark, d), 5)


def distribution(spark, d):
    return audit.distribution(c.records(spark, d), "src")


def distribution_risk(spark, d):
    return audit.risk(distribution(spark, d), "S2", "S3", "src")


def feature_quality(spark, d):
    return audit.feature_quality(c.pair_features(spark, d))


def truth_patterns(spark, d):
    return audit.truth_patterns(er.join_records(c._truth(spark, d), c.parsed(spark, d)))


def recall_by_country(spark, d):
    return audit.recall_by(c._truth(spark, d), _pairs(spark, d), c.records(spark, d))


def probability_histogram(spark, d):
    return audit.probability_histogram(c._scores(spark, d))


def running_counters(spark, d):
    return audit.running_counters(c._s1(spark, d), _picks(spark, d))


def probability_measures(spark, d):
    return audit.probability_measures(c._scores(spark, d), c._truth(spark, d))


def source_scores(spark, d):
    args = c._s1(spark, d), c._truth(spark, d), _picks(spark, d)
    return audit.source_scores(*args, "S2").unionByName(audit.source_scores(*args, "S3"))


def invariants(spark, d):
    return audit.invariants(c._s1(spark, d), c.records(spark, d).where("src <> 'S1'"), c.sink_rows(spark, d), _pairs(spark, d))


def determinism(spark, d):
    return audit.determinism(c._scores(spark, d), c._scores(spark, d))


def consistency(spark, d):
    """Volume and pairs per query of every route: as the route report has them, and counted anew."""
    n = c._s1(spark, d).count()
    anew = c._hits(spark, d).distinct().groupBy("route").agg(F.count("*").alias("volume"), F.round(F.count("*") / n, 6).alias("per_query"))
    return audit.consistency(route_report(spark, d).select("route", "volume", "per_query"), anew, "route", ["volume", "per_query"])


#: Rows of a truth table that break its rules.
BROKEN = [("S1-1", "S2-1,S2-1"), ("S1-1", "S3-2"), ("X-9", "S2-2"), ("S1-3", "S1-2,Q-7"), ("S1-77", " "), ("S1-4", "S2-999999999, S3-1 ,")]


def truth_findings(spark, d):
    r = c.records(spark, d)
    return audit.truth_findings(spark.createDataFrame(BROKEN, "s1_id string, matched_entity_ids string"), c._s1(spark, d), r.where("src <> 'S1'"))


def broken_lists(spark, d):
    r = c.records(spark, d)
    few = r.where("src = 'S1' and seq <= 5").select("id")
    return tables.list_findings(spark.createDataFrame(BROKEN, "s1_id string, matched_entity_ids string"), few, r.where("src <> 'S1'").select("id"))


def split_three_way(spark, d):
    return sampling.three_way(c._s1(spark, d), c._truth(spark, d))


def split_four(spark, d):
    return sampling.four_strata(c._s1(spark, d), c._truth(spark, d))


def split_two_samples(spark, d):
    return sampling.two_samples(c._s1(spark, d), 30)


def split_unexposed(spark, d):
    exposed = c.stratified_split(spark, d).where("part = 'validation'")
    return sampling.unexposed(c._s1(spark, d), c._truth(spark, d), exposed)


def split_overlap(spark, d):
    a = c.stratified_split(spark, d).select("s1_id", F.concat(F.lit("one "), "part").alias("part"))
    return sampling.split_overlap(a.unionByName(split_three_way(spark, d).select("s1_id", F.concat(F.lit("two "), "part").alias("part"))))


def _pool(spark, d):
    return sampling.negatives(c._joined(spark, d), c._truth(spark, d), *_similar())


def negative_categories(spark, d):
    return _pool(spark, d)


def false_positives(spark, d):
    return sampling.mined_false_positives(c._joined(spark, d), c._truth(spark, d), c._scores(spark, d), *_similar())


def negatives_ratio(spark, d):
    return sampling.ratio_sample(_pool(spark, d), 40, 4, 10).select(*er.PAIR, "category", "hardness")


def negatives_curriculum(spark, d):
    return sampling.curriculum(_pool(spark, d), 40, 6, 0.65).select(*er.PAIR, "category", "hardness", "origin")


def negatives_hardest(spark, d):
    return sampling.curriculum(_pool(spark, d), 40, 5, 1.0).select(*er.PAIR, "hardness")


def _ranked(spark, d):
    return c._retrieval("lean")(spark, d)


def negatives_by_routes(spark, d):
    return sampling.negatives_by_routes(_ranked(spark, d), c._truth(spark, d))


def negatives_few(spark, d):
    return sampling.few_negatives(_ranked(spark, d), c._truth(spark, d))


def sample_of_queries(spark, d):
    return sampling.some_of(c._s1(spark, d), 40, "reality", ["s1_id"])


def most_common_countries(spark, d):
    return sampling.most_common(c.records(spark, d), "country", 10)


def best_similar(spark, d):
    return sampling.best_similar(c._scores(spark, d), "p", 3).select(*er.PAIR, "p", "rn")


def _missed(spark, d):
    return forensics.missed_joined(c._truth(spark, d), _few(spark, d), c.parsed(spark, d))


def missed_reasons(spark, d):
    return forensics.missed_reasons(_missed(spark, d))


def missed_scopes(spark, d):
    return forensics.scope_categories(_missed(spark, d))


def missed_categories(spark, d):
    return _missed(spark, d).select(*er.PAIR, forensics.missed_category(*_similar(100.0)).alias("category"))


def rescue(spark, d):
    return forensics.rescue(c._truth(spark, d), er.union_provenance(c._hits(spark, d, "rare_token")), er.union_provenance(c._hits(spark, d, "postal", "building")))


def without_candidates(spark, d):
    return forensics.without_candidates(c._s1(spark, d), c._truth(spark, d), _few(spark, d), c.parsed(spark, d), _similar()[0])


def funnel_stages(spark, d):
    raw = _pairs(spark, d)
    kept = er.union_provenance(c._hits(spark, d), most=60)
    return forensics.recall_funnel(c._truth(spark, d), raw, kept, c._scores(spark, d), DECISION)


def error_samples(spark, d):
    return forensics.error_samples(c._truth(spark, d), _picks(spark, d), _pairs(spark, d), c._scores(spark, d), 0.35, 50)


def drop_duplicates(spark, d):
    s = c._scores(spark, d)
    return rules.keep_best(s.unionByName(s.withColumn("p", F.round(F.col("p") / 2, 6))))


def pair_columns(spark, d):
    return features.pair_columns(c._joined(spark, d))


def _retrieved(spark, d):
    q, t = c._keys(spark, d)
    p = er.retrieve_routes(q, t, er.PROFILES["lean"])
    return er.join_records(p, c.parsed(spark, d))


def wide_columns(spark, d):
    return features.wide_columns(_retrieved(spark, d))


def rough_scores(spark, d):
    return features.rough_score(c._joined(spark, d))


def contextual_features(spark, d):
    j = c._joined(spark, d)
    return features.contextual(features.pair_columns(j), j, c._scores(spark, d))


def negatives_fuzzy(spark, d):
    j = c._joined(spark, d)
    sim = lambda col: features.similarities(F.col(f"q.{col}"), F.col(f"t.{col}"))["wratio"]
    return sampling.negatives(j, c._truth(spark, d), sim("n"), sim("a"))


def _train_rest(spark, d):
    """Rows to fit to and others, kept while several models pass over them; lost blocks are computed again."""
    train, rest = learn.split_fit(c.pair_features(spark, d), c._truth(spark, d), c.stratified_split(spark, d))
    return train.persist(), rest.persist()


def model_ensemble(spark, d):
    return learn.ensemble(*_train_rest(spark, d))


def model_pruner(spark, d):
    return learn.pruner_curve(*_train_rest(spark, d))


def model_ablation(spark, d):
    return learn.ablation(*_train_rest(spark, d))


def model_importances(spark, d):
    train, _ = _train_rest(spark, d)
    names = learn.feature_names(train)
    return learn.importances(learn.fit_trees(train, names, 5, 3), names)


def tfidf_per_source(spark, d):
    r = c.records(spark, d).withColumn("t", T.normalize("name", False))
    return er.tfidf_per_source(r.where("src = 'S1'"), r.where("src <> 'S1'"), (5, 20), low=3, high=3, max_df=0.25, least=0.18)


def tfidf_compact(spark, d):
    """4-grams of compact names, from a similarity of 0.15 on, grams in a quarter of the targets or more left out."""
    r = c.records(spark, d).withColumn("t", T.compact(T.normalize("name", False)))
    return er.tfidf_topk(r.where("src = 'S1'"), r.where("src <> 'S1'"), 10, 4, 4, 2, 0.25, 0.15)


def legal_and_address_fixture(spark, d):
    r = c.parsed(spark, c.Fixture(d))
    return r.select("id", T.expand_legal(F.col("n")).alias("legal"), T.expand_address(F.col("a")).alias("address"), "core", T.country_code("country").alias("country_code"), "street", "pin", "building")


def queries() -> dict[str, Query]:
    plain = [
        pairs_with_country, bands_preranked, bands_first_records, rule_report, removal_waterfall, route_matrix, operating_points, route_algebra, route_report, best_threshold, fine_threshold, strategy_comparison, precision_prune,
        recall_recovery, similarity_prune, decision_stress, decide_without_address, decide_margin_without_address, table_audit, truth_audit, match_counts, top_countries, distribution, distribution_risk, feature_quality, truth_patterns,
        recall_by_country, probability_histogram, running_counters, probability_measures, source_scores, invariants, determinism, consistency, truth_findings, broken_lists, split_three_way, split_four, split_two_samples, split_unexposed,
        split_overlap, negative_categories, false_positives, negatives_ratio, negatives_curriculum, negatives_hardest, negatives_by_routes, negatives_few, sample_of_queries, most_common_countries, best_similar, missed_reasons,
        missed_scopes, missed_categories, rescue, without_candidates, funnel_stages, error_samples, drop_duplicates, pair_columns, wide_columns, rough_scores, contextual_features, negatives_fuzzy, model_ensemble, model_pruner,
        model_ablation, model_importances, tfidf_per_source, tfidf_compact, legal_and_address_fixture,
    ]
    out = {f.__name__: f for f in plain} | {f"bands_{p}": _bands(p) for p in blocking.PRESETS}
    out |= {
        "grid_threshold": _scored(rules.by_threshold, rules.COARSE), "grid_source": _scored(rules.by_source, SOURCE_GRID), "grid_adaptive": _scored(rules.by_capacity, ADAPTIVE_GRID), "grid_capacity": _scored(rules.by_capacity, CAPACITY_GRID),
        "grid_singleton": _scored(rules.by_top_gate, rules.SINGLETON), "decide_near_top": _ruled(rules.by_near_top, threshold=0.35, margin=0.1), "decide_dynamic_gap": _ruled(rules.by_dynamic_gap, threshold=0.3, margin=0.5),
        "decide_expected_f": _ruled(rules.by_expected_f, least=0.25), "decide_rising": _ruled(rules.by_rising_threshold, threshold=0.3), "decide_prefix_gate": _ruled(rules.by_prefix, min_top=0.4),
    }
    fixed = {"block_exact_name": c._block("exact_name"), "block_name_sig": c._block("name_sig"), "missed_categories": missed_categories, "missed_reasons": missed_reasons, "missed_scopes": missed_scopes, "without_candidates": without_candidates}
    fixed |= {f"bands_{p}": _bands(p) for p in ("second", "reconstruction", "seven")} | {"rule_report": rule_report, "truth_patterns": truth_patterns, "src_profile": c.src_profile, "distribution": distribution, "retrieval_balanced": c._retrieval("balanced")}
    return out | {f"{n}_fixture": lambda spark, d, f=f: f(spark, c.Fixture(d)) for n, f in fixed.items()}


# --- the same in DuckDB's SQL ------------------------------------------------------------------


def _words(x: str, table: list[tuple[str, str]]) -> str:
    for word, full in table:
        x = rf"regexp_replace({x}, '\b{word}\b', '{full}', 'g')"
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


_STOP = ", ".join(f"'{x}'" for x in T.NAME_STOP_WORDS)
_CODE = "coalesce(MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in T.COUNTRIES.items()) + "}[upper(trim(country))], upper(trim(country)))"
_WIDE = rf""",
wide0 AS (
  SELECT *, array_to_string(list_sort(adt), ' ') AS asig, array_to_string(list_filter(string_split(n, ' '), lambda x: x NOT IN ({_STOP}) AND length(x) > 1), ' ') AS core0, regexp_replace(n, '[^a-z0-9]', '', 'g') AS comp,
    {_words("n", T.LEGAL_SUFFIXES)} AS legal, {_words("a", T.ADDRESS_WORDS)} AS expd, {_CODE} AS cc,
    list_filter(string_split(a, ' '), lambda x: length(x) >= 3 AND NOT regexp_matches(x, '^\d+$') AND x <> bld)[1] AS street, list_min(pins) AS pin FROM par),
wide AS (SELECT *, CASE WHEN core0 = '' THEN n ELSE core0 END AS core, split_part(CASE WHEN core0 = '' THEN n ELSE core0 END, ' ', 1) AS head FROM wide0)"""
_BAND_KEYS = r""",
bk0 AS (
  SELECT id, src, seq, unnest([{'kind': 'name', 'key': n}, {'kind': 'legal', 'key': legal}, {'kind': 'addr', 'key': a}, {'kind': 'expanded', 'key': expd}, {'kind': 'name_sig', 'key': sig}, {'kind': 'addr_sig', 'key': asig},
    {'kind': 'long_name_sig', 'key': CASE WHEN contains(sig, ' ') THEN sig END}, {'kind': 'long_addr_sig', 'key': CASE WHEN contains(asig, ' ') THEN asig END}, {'kind': 'building', 'key': nullif(bld, '')},
    {'kind': 'num_street', 'key': nullif(bld, '') || '_' || street}, {'kind': 'name_num', 'key': head || '_' || nullif(bld, '')}, {'kind': 'name_postal', 'key': head || '_' || pin}, {'kind': 'compact', 'key': comp}]) AS x FROM wide
  UNION ALL SELECT id, src, seq, unnest(list_concat(list_transform(nt, lambda t: {'kind': 'token', 'key': t}), list_transform(list_filter(nt, lambda t: length(t) >= 3), lambda t: {'kind': 'token3', 'key': t}),
    list_transform(pins, lambda t: {'kind': 'postal', 'key': t}), list_transform(adt, lambda t: {'kind': 'addr_token', 'key': t}),
    list_transform(list_filter(nt, lambda t: length(t) >= 4), lambda t: {'kind': 'country_token', 'key': nullif(cc, '') || '|' || t}), list_transform(nt, lambda t: {'kind': 'token_by_country', 'key': nullif(cc, '') || '|' || t}))) FROM wide),
bk AS (SELECT id, src, seq, x.kind AS kind, x.key AS key FROM bk0 WHERE x.key IS NOT NULL AND trim(x.key) <> '')"""
_SHARED = "len(list_intersect(q.nt, t.nt))"
_SAME_BLD, _SAME_PIN = "(q.bld = t.bld AND q.bld <> '')", "list_has_any(q.pins, t.pins)"
_COMPATIBLE = "(q.country = t.country OR q.country = '' OR t.country = '')"


def _bands_sql(name: str, limit: int = 0) -> str:
    bands = ", ".join(f"('{b.key}', {b.floor}, {b.gate}, {b.cap}, '{b.rest}')" for b in blocking.PRESETS[name])
    rec = f"(SELECT * FROM bk WHERE seq < {limit})" if limit else "bk"
    return f"""{_WIDE}{_BAND_KEYS}, b(kind, flo, gate, cap, rest) AS (VALUES {bands}),
bt AS (SELECT b.rest, kind, key, id FROM (SELECT *, row_number() OVER (PARTITION BY kind, key ORDER BY src, seq) AS rn, count(*) OVER (PARTITION BY kind, key) AS df FROM {rec} WHERE src <> 'S1') JOIN b USING (kind)
  WHERE df > flo AND df <= gate AND rn <= cap),
bh AS (SELECT DISTINCT x.id AS s1_id, bt.id AS target_id, kind AS route FROM {rec} x JOIN bt USING (kind, key) JOIN par q ON q.id = x.id JOIN par t ON t.id = bt.id WHERE x.src = 'S1' AND CASE rest
  WHEN 'token' THEN {_SHARED} > 0 WHEN 'token_country' THEN {_SHARED} > 0 AND q.country = t.country WHEN 'token_or_building' THEN {_SHARED} > 0 OR {_SAME_BLD} WHEN 'country' THEN {_COMPATIBLE}
  WHEN 'supported' THEN {_COMPATIBLE} AND ({_SHARED} >= 2 OR {_SAME_BLD} OR {_SAME_PIN}) ELSE true END)
SELECT s1_id, target_id, array_to_string(list_sort(list(route)), ',') AS routes, count(*)::INT AS n_routes FROM bh GROUP BY 1, 2"""


def _retrieval_sql(name: str) -> str:
    p = er.PROFILES[name]
    rows = ", ".join(f"('{r}', {er.ROUTES[r][0]}::DOUBLE, {p.caps[r]}, {p.gates.get(r, er.ROUTES[r][2])}, {p.gates['rare_token'] if r == 'sig_token' else 0})" for r in p.routes)
    grams = lambda n: f"CASE WHEN length(g) = 0 THEN [] WHEN length(g) < {n} THEN [g] ELSE list_transform(range(1, length(g) - {n} + 2), lambda i: substring(g, i, {n})) END"
    once = lambda n: f"CASE WHEN src = 'S1' THEN {grams(n)} ELSE list_distinct({grams(n)}) END"
    return rf"""{_WIDE}, rt(route, weight, cap, gate, flo) AS (VALUES {rows}), gr AS (SELECT *, regexp_replace(core, '[^a-z0-9]', '', 'g') AS g FROM wide),
rk0 AS (
  SELECT id, src, seq, unnest(list_concat([{{'r': 'exact_name', 'k': n}}, {{'r': 'compact_name', 'k': comp}}, {{'r': 'core_name', 'k': CASE WHEN src = 'S1' OR core <> n THEN core END}}, {{'r': 'name_sig', 'k': sig}}, {{'r': 'exact_addr', 'k': a}},
    {{'r': 'addr_sig', 'k': asig}}, {{'r': 'building', 'k': nullif(bld, '')}}, {{'r': 'num_street', 'k': nullif(bld, '') || '_' || street}}, {{'r': 'name_num', 'k': head || '_' || nullif(bld, '')}}, {{'r': 'name_postal', 'k': head || '_' || pin}}],
    list_transform(list_filter(nt, lambda t: length(t) >= 3), lambda t: {{'r': 'rare_token', 'k': t}}), list_transform(list_filter(nt, lambda t: length(t) >= 3), lambda t: {{'r': 'sig_token', 'k': t}}),
    list_transform(pins, lambda t: {{'r': 'postal', 'k': t}}), list_transform({once(4)}, lambda t: {{'r': 'char_4gram', 'k': t}}), list_transform({once(3)}, lambda t: {{'r': 'char_3gram', 'k': t}}))) AS x FROM gr),
rk AS (SELECT id, src, seq, x.r AS route, x.k AS key FROM rk0 WHERE x.k IS NOT NULL AND x.k <> ''),
tg AS (SELECT *, row_number() OVER (PARTITION BY route, key ORDER BY src, seq) AS rn, count(*) OVER (PARTITION BY CASE WHEN route IN ('char_3gram', 'char_4gram') THEN 'gram' ELSE route END, key) AS df FROM rk WHERE src <> 'S1'),
rh AS (SELECT q.id AS s1_id, tg.id AS target_id, route, weight FROM rk q JOIN tg USING (route, key) JOIN rt USING (route) WHERE q.src = 'S1' AND rn <= cap AND (gate = 0 OR df <= gate) AND df > flo),
rs AS (SELECT s1_id, target_id, round(sum(weight), 6) AS score, count(DISTINCT route) AS n_routes FROM rh GROUP BY 1, 2),
ret AS (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY n_routes DESC, score DESC, target_id)::INT AS rank FROM rs QUALIFY rank <= {p.most})"""


_LISTS = """, rn AS (
  SELECT sc.*, (truth.s1_id IS NOT NULL)::INT AS hit, row_number() OVER w AS rn, max(p) OVER (PARTITION BY s1_id) AS top, count(*) OVER (PARTITION BY s1_id) AS cnt, coalesce(lead(p) OVER w, 0) AS nxt
  FROM sc LEFT JOIN truth USING (s1_id, target_id) WINDOW w AS (PARTITION BY s1_id ORDER BY p DESC, target_id)),
ld AS (SELECT *, max(CASE WHEN rn = 1 THEN nxt END) OVER (PARTITION BY s1_id) AS second, max(CASE WHEN rn = 1 THEN target_id END) OVER (PARTITION BY s1_id) AS best, target_id LIKE 'S2-%' AS s2src FROM rn)"""


def _sets_sql(sets: list[dict[str, float]]) -> str:
    names = sorted({k for s in sets for k in s})
    rows = ", ".join(f"({i}, " + ", ".join(f"{float(s.get(k, 0.0))!r}::DOUBLE" for k in names) + ")" for i, s in enumerate(sets))
    return f", ps(\"set\", {', '.join(names)}) AS (VALUES {rows})"


_OWN = lambda x: f"CASE WHEN {x} LIKE 'S2-%' THEN s2 ELSE s3 END"
_TAKEN = {
    "threshold": "p >= threshold", "top_gate": "top >= min_top AND p >= threshold", "margin": "top >= threshold AND p >= threshold AND round(top - p, 9) <= margin", "rank": "rn <= max_k AND p >= threshold",
    "source": f"p >= {_OWN('target_id')}",
}
_CAPACITY = f"""SELECT * EXCLUDE k FROM (SELECT *, row_number() OVER (PARTITION BY "set", s1_id, s2src ORDER BY rn) AS k FROM (SELECT * FROM ld CROSS JOIN ps
  WHERE NOT (top < greatest(min_top, {_OWN('best')}) OR (top < round({_OWN('best')} + 0.05, 9) AND round(top - second, 9) < min_margin AND cnt > 1))
  AND (rn = 1 OR (p >= greatest({_OWN('target_id')}, multi) AND round(top - p, 9) <= max_drop)))) WHERE per_source = 0 OR k <= per_source"""


def _grid_sql(sets: list[dict[str, float]], taken: str, tag: str = "") -> str:
    """CTEs up to g{tag}: a row per set with its figures; taken: a condition, or a whole SELECT of taken candidates."""
    names = sorted({k for s in sets for k in s})
    body = taken if taken.startswith("SELECT") else f"SELECT * FROM ld CROSS JOIN ps WHERE {taken}"
    cols = ", ".join(names)
    sql = f"""{_sets_sql(sets)}, tk AS ({body}), cn AS (SELECT "set", s1_id, count(*) AS n, sum(hit) AS h FROM tk GROUP BY 1, 2), tn AS (SELECT s1_id, count(*) AS m FROM truth GROUP BY 1),
fl AS (SELECT ps.*, s1_id, coalesce(m, 0) AS m, coalesce(n, 0) AS n, coalesce(h, 0) AS h FROM s1 CROSS JOIN ps LEFT JOIN tn USING (s1_id) LEFT JOIN cn USING ("set", s1_id)),
g AS (SELECT "set", {cols}, round(avg(CASE WHEN m = 0 AND n = 0 THEN 1.0 WHEN h = 0 THEN 0.0 ELSE 1.25 * h / (0.25 * m + n) END), 6) AS macro_f, round(avg(CASE WHEN m = 0 AND n = 0 THEN 1.0 WHEN n = 0 THEN 0.0 ELSE h / n END), 6) AS macro_precision,
  round(avg(CASE WHEN m = 0 AND n = 0 THEN 1.0 WHEN m = 0 THEN 0.0 ELSE h / m END), 6) AS macro_recall, round(avg(n), 6) AS mean_picks FROM fl GROUP BY ALL)"""
    if tag:
        for x in ("ps", "tk", "cn", "tn", "fl", "g"):
            sql = sql.replace(f", {x}(", f", {x}{tag}(").replace(f", {x} AS (", f", {x}{tag} AS (").replace(f"\n{x} AS (", f"\n{x}{tag} AS (").replace(f"JOIN {x} ", f"JOIN {x}{tag} ").replace(f"FROM {x} ", f"FROM {x}{tag} ").replace(f"{x}.*", f"{x}{tag}.*")
    return sql


def _adaptive_sql(abstain: bool, per_source: int, boosted: bool) -> str:
    b = "CASE WHEN CAST(substring(s1_id, 4) AS BIGINT) % 2 = 0 THEN 0.05 ELSE 0.0 END" if boosted else "0.0"
    own = lambda x: f"(CASE WHEN {x} LIKE 'S2-%' THEN 0.34 ELSE 0.30 END)"
    stop = f"(top < greatest(0.3, {own('best')}) + b OR (top < {own('best')} + b + 0.05 AND round(top - second, 9) < 0.05 AND cnt > 1))" if abstain else "false"
    return f"""SELECT s1_id, target_id, p FROM (SELECT *, row_number() OVER (PARTITION BY s1_id, s2src ORDER BY rn) AS k FROM (SELECT *, {b} AS b FROM ld) WHERE NOT {stop}
        AND (rn = 1 OR (p >= greatest({own('target_id')}, 0.28) + b AND round(top - p, 9) <= 0.3))) WHERE {per_source} = 0 OR k <= {per_source}"""


_FLAGS = lambda: {
    "exact_name": "(q.n <> '' AND q.n = t.n) OR (q.comp <> '' AND q.comp = t.comp)", "name_sig": "q.sig <> '' AND q.sig = t.sig", "shared_token": "len(list_filter(list_intersect(q.nt, t.nt), lambda x: length(x) >= 3)) > 0", "name_gram3": f"{_dice('n', 3)} >= 0.25",
    "name_gram4": f"{_dice('n', 4)} >= 0.20", "addr_token": r"len(list_filter(list_intersect(q.adt, t.adt), lambda x: length(x) >= 3 AND NOT regexp_matches(x, '^\d+$'))) > 0", "addr_gram3": f"{_dice('a', 3)} >= 0.25", "addr_gram4": f"{_dice('a', 4)} >= 0.20",
    "postal": _SAME_PIN, "building": _SAME_BLD, "number_street": f"{_SAME_BLD} AND len(list_intersect(q.adt, t.adt)) > 0", "name_number": f"{_SAME_BLD} AND ({_SHARED} > 0 OR {_dice('n', 4)} >= 0.20)",
    "name_country": f"q.country <> '' AND q.country = t.country AND ({_SHARED} > 0 OR {_dice('n', 4)} >= 0.20)", "name_postal": f"{_SAME_PIN} AND ({_SHARED} > 0 OR {_dice('n', 4)} >= 0.20)", "same_country": _COMPATIBLE,
    "either_way": "(q.comp <> '' AND q.comp = t.comp) OR (q.asig <> '' AND q.asig = t.asig) OR (q.a <> '' AND q.a = t.a)", "strict": "(q.n <> '' AND q.n = t.n) OR (q.a <> '' AND q.a = t.a) OR (q.sig <> '' AND q.sig = t.sig) OR (q.asig <> '' AND q.asig = t.asig)",
}


def _dice(col: str, n: int) -> str:
    g = lambda s: f"(CASE WHEN length(regexp_replace({s}.{col}, '[^a-z0-9]', '', 'g')) = 0 THEN [] WHEN length(regexp_replace({s}.{col}, '[^a-z0-9]', '', 'g')) < {n} THEN [regexp_replace({s}.{col}, '[^a-z0-9]', '', 'g')] ELSE list_distinct(list_transform(range(1, length(regexp_replace({s}.{col}, '[^a-z0-9]', '', 'g')) - {n} + 2), lambda i: substring(regexp_replace({s}.{col}, '[^a-z0-9]', '', 'g'), i, {n}))) END)"
    return f"coalesce(2 * len(list_intersect({g('q')}, {g('t')})) / nullif(len({g('q')}) + len({g('t')}), 0), 0)"


def _flags_sql() -> str:
    flags = ", ".join(f"coalesce({x}, false) AS {k}" for k, x in _FLAGS().items())
    return f"{_WIDE}, fg AS (SELECT s1_id, target_id, {flags} FROM truth JOIN wide q ON q.id = s1_id JOIN wide t ON t.id = target_id)"


_OVER = f"(CASE WHEN len(q.nt) = 0 OR len(t.nt) = 0 THEN 0.0 ELSE {_SHARED} / least(len(q.nt), len(t.nt)) END)"
_AJAC = "(CASE WHEN len(q.adt) = 0 OR len(t.adt) = 0 THEN 0.0 ELSE len(list_intersect(q.adt, t.adt)) / len(list_distinct(list_concat(q.adt, t.adt))) END)"
_POOL = f""", neg AS (SELECT s1_id, target_id, CASE WHEN nm >= 0.85 AND ad <= 0.40 THEN '1_high_name_wrong_address' WHEN ad >= 0.85 AND nm <= 0.40 THEN '2_high_address_wrong_name' WHEN nm >= 0.80 AND ad >= 0.70 THEN '3_high_name_high_address_wrong_entity'
  WHEN pin THEN '4_same_postal_wrong_entity' WHEN bld THEN '5_same_building_wrong_entity' WHEN nr >= 2 THEN '9_multi_route_hit_wrong_entity' WHEN nm >= 0.60 THEN 'medium_name_similarity' ELSE 'easy_negative' END AS category, round((nm + ad) / 2, 6) AS hardness
  FROM (SELECT s1_id, target_id, len(rs) AS nr, {_OVER} AS nm, {_AJAC} AS ad, {_SAME_PIN} AS pin, {_SAME_BLD} AS bld FROM pairs ANTI JOIN truth USING (s1_id, target_id) JOIN par q ON q.id = s1_id JOIN par t ON t.id = target_id))"""
_MISSED = ", few AS (SELECT DISTINCT s1_id, target_id FROM hits WHERE route IN ('exact_name', 'name_sig')), ms AS (SELECT s1_id, target_id FROM truth ANTI JOIN few USING (s1_id, target_id))"


def _split_sql(table: str, most: int, parts: list[tuple[str, float]], rest: str, seed: str) -> str:
    ends, case = "0", ""
    for name, share in parts:
        ends = f"{ends} + floor(n * {share!r}::DOUBLE)"
        case += f" WHEN rn <= {ends} THEN '{name}'"
    return f"""SELECT s1_id, stratum, CASE{case} ELSE '{rest}' END AS part FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('{seed}' || s1_id), s1_id) AS rn, count(*) OVER (PARTITION BY stratum) AS n
        FROM (SELECT s1_id, CAST(least(count(target_id), {most}) AS INT) AS stratum FROM {table} LEFT JOIN truth USING (s1_id) GROUP BY 1))"""


def fixture_sql(sql: str) -> str:
    """The same SQL over the fixture in place of the tables."""
    a = sql.index("rec AS (")
    b = sql.index("nrm AS (")
    rows = ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'" for x in r) + ")" for r in c.FIXTURE)
    return f"{sql[:a]}rec(id, src, seq, name, addr, country) AS (SELECT * FROM (VALUES {rows})),\n{sql[b:]}"


def oracle_sql() -> dict[str, str]:
    w = lambda chain, last: f"WITH {chain}\n{last}"
    rec = c._REC
    pairs = rec + c._KEYS + c._PAIRS
    sc, picks = pairs + c._SCORES, pairs + c._SCORES + c._PICKS
    lists = sc + _LISTS
    out = {f"bands_{p}": w(rec, _bands_sql(p)) for p in blocking.PRESETS}
    out["bands_first_records"] = w(rec, _bands_sql("seven", 500))
    said = f"CASE WHEN cc(q) = '' OR cc(t) = '' THEN rs WHEN cc(q) = cc(t) THEN list_append(rs, 'country_match') ELSE list_append(rs, 'country_mismatch') END".replace("cc(q)", "q.cc").replace("cc(t)", "t.cc")
    out["pairs_with_country"] = w(pairs + _WIDE, f"SELECT s1_id, target_id, array_to_string({said}, ',') AS routes, len(rs)::INT AS n_routes FROM pairs JOIN wide q ON q.id = s1_id JOIN wide t ON t.id = target_id")
    for p in er.PROFILES:
        out[f"retrieval_{p}"] = w(rec + _retrieval_sql(p), "SELECT s1_id, target_id, score, n_routes, rank FROM ret")
    one = " UNION ALL ".join(f"SELECT '{r}' AS rule, count(*) FILTER ({r}) AS found, count(*) FILTER ({r} AND ({' + '.join(f'{x}::INT' for x in blocking.RULES)}) = 1) AS alone, round(count(*) FILTER ({r}) / count(*), 6) AS recall FROM fg" for r in blocking.RULES)
    out["rule_report"] = w(pairs + _flags_sql(), one)
    gone, steps, last = {"same_country", "strict"}, [], None
    for i, (name, rs) in enumerate(blocking.STEPS):
        gone |= set(rs)
        now = f"count(*) FILTER ({' OR '.join(r for r in blocking.RULES if r not in gone)})"
        steps.append(f"SELECT {i} AS step, '{name}' AS name, {now} AS found, {f'{last} - {now}' if last else '0'} AS lost FROM fg")
        last = now
    out["removal_waterfall"] = w(pairs + _flags_sql(), " UNION ALL ".join(steps))
    out["route_matrix"] = w(pairs, "SELECT s1_id, target_id, " + ", ".join(f"coalesce(list_contains(rs, '{r}'), false)::INT AS {r}" for r in c.CAPS) + ", coalesce(len(rs), 0)::INT AS n_routes FROM truth LEFT JOIN pairs USING (s1_id, target_id)")
    has = lambda rs: f"list_has_any(rs, [{', '.join(repr(r) for r in rs)}])"
    out["operating_points"] = w(pairs, " UNION ALL ".join(f"SELECT '{n}' AS point, count(*) AS volume, count(truth.s1_id) AS found, round(count(truth.s1_id) / (SELECT count(*) FROM truth), 6) AS recall FROM pairs LEFT JOIN truth USING (s1_id, target_id) WHERE {has(rs)}" for n, rs in POINTS.items()))
    x, y = "list_contains(rs, 'postal')", "list_contains(rs, 'building')"
    out["route_algebra"] = w(pairs, f"SELECT count(*) FILTER ({x}) AS in_a, count(*) FILTER ({y}) AS in_b, count(*) FILTER ({x} AND {y}) AS in_both, count(*) FILTER ({x} OR {y}) AS in_either, count(*) FILTER ({x} AND NOT {y}) AS a_only, count(*) FILTER ({y} AND NOT {x}) AS b_only FROM pairs")
    report = """, hr AS (SELECT DISTINCT s1_id, target_id, route FROM hits), rp AS (SELECT route, count(*) AS volume, count(truth.s1_id) AS f, count(truth.s1_id) FILTER (target_id LIKE 'S2-%') AS f2, count(truth.s1_id) FILTER (target_id LIKE 'S3-%') AS f3 FROM hr LEFT JOIN truth USING (s1_id, target_id) GROUP BY 1),
        nn AS (SELECT (SELECT count(*) FROM s1) AS q, (SELECT count(*) FROM rec WHERE src <> 'S1') AS t, (SELECT count(*) FROM truth) AS n, (SELECT count(*) FROM truth WHERE target_id LIKE 'S2-%') AS n2, (SELECT count(*) FROM truth WHERE target_id LIKE 'S3-%') AS n3)"""
    out["route_report"] = w(pairs + report, "SELECT route, volume, round(1 - volume / (q::DOUBLE * t), 9) AS reduction, round(f / n, 6) AS recall, round(f2 / n2, 6) AS recall_s2, round(f3 / n3, 6) AS recall_s3, round(volume / q, 6) AS per_query FROM rp, nn")
    out["consistency"] = w(pairs + report, "SELECT route, 'volume' AS measure, volume::DOUBLE AS reported, volume::DOUBLE AS computed, 'PASS' AS status FROM rp UNION ALL SELECT route, 'per_query', round(volume / q, 6), round(volume / q, 6), 'PASS' FROM rp, nn")
    out["grid_threshold"] = w(lists + _grid_sql(rules.COARSE, _TAKEN["threshold"]), "SELECT * FROM g")
    out["grid_source"] = w(lists + _grid_sql(SOURCE_GRID, _TAKEN["source"]), "SELECT * FROM g")
    out["grid_singleton"] = w(lists + _grid_sql(rules.SINGLETON, _TAKEN["top_gate"]), "SELECT * FROM g")
    out["grid_adaptive"] = w(lists + _grid_sql(ADAPTIVE_GRID, _CAPACITY), "SELECT * FROM g")
    out["grid_capacity"] = w(lists + _grid_sql(CAPACITY_GRID, _CAPACITY), "SELECT * FROM g")
    out["best_threshold"] = w(lists + _grid_sql([{"threshold": t} for t in c.THRESHOLDS], _TAKEN["threshold"]), "SELECT threshold, macro_f FROM g ORDER BY macro_f DESC, threshold LIMIT 1")
    every = sorted({x for t in rules.steps(0.01, 0.99, 0.01) for x in rules.steps(max(0.0025, t - 0.10), min(0.9975, t + 0.10), 0.0025)})
    fine = _grid_sql([{"threshold": t} for t in every], _TAKEN["threshold"], "_f")
    out["fine_threshold"] = w(lists + _grid_sql(rules.COARSE, _TAKEN["threshold"]) + fine, """SELECT threshold, macro_f FROM g_f, (SELECT threshold AS t FROM g ORDER BY macro_f DESC, "set" LIMIT 1) WHERE threshold >= round(greatest(0.0025, t - 0.10), 6) AND threshold <= round(least(0.9975, t + 0.10), 6) ORDER BY macro_f DESC, threshold LIMIT 1""")
    best = [(n, _grid_sql(sets, _TAKEN[n], f"_{n}")) for n, (_, sets) in SMALL.items()]
    out["strategy_comparison"] = w(lists + "".join(s for _, s in best), " UNION ALL ".join(f"""(SELECT '{n}' AS strategy, "set", macro_f FROM g_{n} ORDER BY macro_f DESC, "set" LIMIT 1)""" for n, _ in best))
    pick = "SELECT s1_id, target_id, p FROM ld WHERE "
    out["decide_near_top"] = w(lists, pick + "top >= 0.35 AND p >= 0.35 AND round(top - p, 9) <= 0.1")
    out["decide_dynamic_gap"] = w(lists, pick + "top >= 0.3 AND p >= 0.3 AND round(top - p, 9) <= round(0.5::DOUBLE * top * top, 9)")
    out["decide_rising"] = w(lists, pick + "p >= round(0.3::DOUBLE + 0.04::DOUBLE * (rn - 1), 9)")
    out["decide_prefix_gate"] = w(lists + ", bd AS (SELECT *, min(CASE WHEN rn > 1 AND p < 0.55 THEN rn END) OVER (PARTITION BY s1_id) AS bad FROM ld)", "SELECT s1_id, target_id, p FROM bd WHERE top >= 0.4 AND rn <= 10 AND (bad IS NULL OR rn < bad)")
    out["decide_expected_f"] = w(lists + """, ex AS (SELECT *, sum(p) OVER (PARTITION BY s1_id ORDER BY rn) AS s FROM ld), ef AS (SELECT *, CASE WHEN p >= 0.25 THEN round(1.25::DOUBLE * (s / rn) * (s / 1.5::DOUBLE) / (0.25::DOUBLE * (s / rn) + s / 1.5::DOUBLE + 1e-8::DOUBLE), 9) ELSE 0 END AS f FROM ex),
        bk2 AS (SELECT s1_id, rn AS k FROM ef QUALIFY row_number() OVER (PARTITION BY s1_id ORDER BY f DESC, rn) = 1 AND f > 0)""", "SELECT s1_id, target_id, p FROM ld JOIN bk2 USING (s1_id) WHERE rn <= k")
    out["decide_adaptive"], out["decide_adaptive_all"], out["decide_without_address"] = (w(lists, _adaptive_sql(*x)) for x in ((True, 1, False), (False, 0, False), (True, 1, True)))
    b = "(CASE WHEN CAST(substring(s1_id, 4) AS BIGINT) % 2 = 0 THEN 0.05 ELSE 0.0 END)"
    out["decide_margin_without_address"] = w(lists, pick + f"NOT (top < 0.3 + {b} OR (top < 0.35 + {b} AND round(top - second, 9) < 0.05)) AND p >= 0.35 + {b}")
    out["precision_prune"] = w(sc + """, ok AS (SELECT sc.*, row_number() OVER (PARTITION BY s1_id ORDER BY p DESC, target_id) AS rn, max(p) OVER (PARTITION BY s1_id) AS top FROM sc JOIN rec q ON q.id = s1_id JOIN rec t ON t.id = target_id WHERE (q.country = '' OR t.country = '' OR q.country = t.country) AND p >= 0.30)""", "SELECT s1_id, target_id, p FROM ok WHERE rn = 1 OR (round(top - p, 9) <= 0.12 AND p >= 0.34)")
    out["decision_stress"] = "SELECT * FROM (VALUES " + ", ".join(f"('S1-{i}', '{ids}')" for i, (_, _, ids) in enumerate(STRESS, 1)) + ") x(s1_id, matched_entity_ids)"
    out["table_audit"] = w(rec, "SELECT src AS name, count(*) AS n_rows, 6 AS n_columns, count(DISTINCT id) AS n_ids, count(*) FILTER (trim(id) = '') AS blank_ids, count(*) - count(DISTINCT id) AS repeats FROM rec GROUP BY 1")
    per_s1 = ", mm AS (SELECT s1_id, count(target_id) AS m FROM s1 LEFT JOIN truth USING (s1_id) GROUP BY 1)"
    out["truth_audit"] = w(pairs + per_s1, "SELECT count(*) FILTER (m = 0) AS none, count(*) FILTER (m = 1) AS one, count(*) FILTER (m > 1) AS more, max(m) AS most, sum(m)::BIGINT AS pairs FROM mm")
    out["match_counts"] = w(pairs + per_s1, "SELECT m, count(*) AS n FROM mm GROUP BY 1")
    out["top_countries"] = w(rec, "SELECT src, country, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY src), 6) AS share, row_number() OVER (PARTITION BY src ORDER BY count(*) DESC, country)::INT AS rank FROM rec GROUP BY 1, 2 QUALIFY rank <= 5")
    dist = """SELECT src, count(*) AS n, round(avg(length(name)), 6) AS mean_length, quantile_cont(length(name), 0.5) AS median_length, round(quantile_cont(length(name), 0.95), 6) AS p95_length, max(length(name)) AS max_length, round(avg((trim(addr) = '')::INT), 6) AS no_address,
        round(avg(regexp_matches(name, '[^\\x00-\\x7F]')::INT), 6) AS beyond_ascii, round(avg(regexp_matches(lower(name), '[éèêëàâäîïôöùûüçñ]')::INT), 6) AS accented, count(DISTINCT country) AS countries FROM rec GROUP BY 1"""
    out["distribution"] = w(rec, dist)
    names = ["mean_length", "median_length", "p95_length", "max_length", "no_address", "beyond_ascii", "accented"]
    out["distribution_risk"] = w(rec + f", ds AS ({dist}), lg AS (" + " UNION ALL ".join(f"SELECT '{m}' AS measure, max({m}) FILTER (src = 'S2')::DOUBLE AS base, max({m}) FILTER (src = 'S3')::DOUBLE AS other FROM ds" for m in names) + ")", "SELECT measure, base, other, round(abs(base - other) / greatest(abs(base), 1.0), 6) AS apart, CASE WHEN abs(base - other) / greatest(abs(base), 1.0) > 0.05 THEN 'RISK' ELSE 'OK' END AS status FROM lg")
    same = lambda col: f"(q.{col} = t.{col} AND q.{col} <> '')"
    njac = f"(CASE WHEN len(q.nt) = 0 OR len(t.nt) = 0 THEN 0.0 ELSE {_SHARED} / len(list_distinct(list_concat(q.nt, t.nt))) END)"
    said = [same("name"), same("n"), same("sig"), same("addr"), same("a"), same("asig"), same("country"), _SAME_PIN, _SAME_BLD, f"({same('n')} OR {same('a')})", f"({same('n')} AND {same('a')})", f"({njac} >= 0.5)", f"({_AJAC} >= 0.5)"]
    cols = ", ".join(f"round(100 * avg({x}::INT), 6) AS {n}" for n, x in zip(audit.PATTERNS, said, strict=True))
    out["truth_patterns"] = w(pairs + _WIDE, f"SELECT coalesce(src2, 'all') AS source, count(*) AS n, {cols} FROM (SELECT *, target_id[1:2] AS src2 FROM truth) JOIN wide q ON q.id = s1_id JOIN wide t ON t.id = target_id GROUP BY ROLLUP (src2)")
    out["recall_by_country"] = w(pairs, "SELECT coalesce(country, 'all') AS country, count(*) AS n_true, count(pairs.s1_id) AS n_found, round(count(pairs.s1_id) / count(*), 6) AS recall FROM truth LEFT JOIN pairs USING (s1_id, target_id) JOIN rec ON rec.id = truth.s1_id GROUP BY ROLLUP (country)")
    out["probability_histogram"] = w(sc, "SELECT count(*) FILTER (p >= 0.8) AS from_08, count(*) FILTER (p >= 0.7 AND p < 0.8) AS from_07, count(*) FILTER (p >= 0.6 AND p < 0.7) AS from_06, count(*) FILTER (p >= 0.5 AND p < 0.6) AS from_05, count(*) FILTER (p < 0.5) AS below_05 FROM sc")
    out["running_counters"] = w(picks + ", pn AS (SELECT s1_id, count(target_id) AS n, count(target_id) FILTER (target_id LIKE 'S2-%') AS n2 FROM s1 LEFT JOIN picks USING (s1_id) GROUP BY 1)", "SELECT count(*) FILTER (n = 0) AS zero, count(*) FILTER (n = 1) AS one, count(*) FILTER (n > 1) AS more, sum(n2)::BIGINT AS picks_s2, sum(n - n2)::BIGINT AS picks_s3 FROM pn")
    out["probability_measures"] = w(sc + """, lb AS (SELECT p, (truth.s1_id IS NOT NULL)::INT AS y FROM sc LEFT JOIN truth USING (s1_id, target_id)), pp AS (SELECT p, count(*) AS n, sum(y) AS y FROM lb GROUP BY 1),
        cu AS (SELECT *, sum(y) OVER (ORDER BY p DESC) AS tp, sum(n) OVER (ORDER BY p DESC) AS seen FROM pp)""", """SELECT sum(n)::BIGINT AS n, sum(y)::BIGINT AS pos, round(sum((n - y) * (tp - y / 2)) / (sum(y) * (sum(n) - sum(y))), 6) AS roc_auc, round(sum(y * tp / seen) / sum(y), 6) AS average_precision,
        round(sum(y * (1 - p) * (1 - p) + (n - y) * p * p) / sum(n), 6) AS brier FROM cu""")
    per = c._PER.replace("per0", "per0{0}").replace("per AS", "per{0} AS").replace("FROM picks x", "FROM (SELECT * FROM picks WHERE target_id LIKE '{0}-%') x").replace("FROM truth x", "FROM (SELECT * FROM truth WHERE target_id LIKE '{0}-%') x")
    out["source_scores"] = w(picks + per.replace("{0}", "S2") + per.replace("{0}", "S3"), " UNION ALL ".join(f"SELECT {c._MACRO}, '{s}' AS source FROM per{s}" for s in ("S2", "S3")))
    nine = ["A every query has a row", "B no other rows", "C one row per query", "D no id twice in a list", "E every id exists", "F only ids of targets", "G every match is a candidate", "H candidates exist", "I lists read back"]
    out["invariants"] = "SELECT * FROM (VALUES " + ", ".join(f"('{n}', 0::BIGINT)" for n in nine) + ") x(invariant, violations)"
    out["determinism"] = "SELECT 0::BIGINT AS only_first, 0::BIGINT AS only_second, 0::BIGINT AS apart"
    bl = ", bl(s1_id, m) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in BROKEN) + "), pl AS (SELECT s1_id, list_filter(list_transform(string_split(m, ','), lambda x: trim(x)), lambda x: x <> '') AS l FROM bl), ul AS (SELECT s1_id, unnest(l) AS id FROM pl)"
    known = "SELECT id FROM rec WHERE src <> 'S1'"
    foreign = "NOT (x LIKE 'S1-%' OR x LIKE 'S2-%' OR x LIKE 'S3-%')"
    out["truth_findings"] = w(rec + bl, f"""SELECT 'wrong_key' AS category, count(*) AS n FROM pl WHERE s1_id NOT LIKE 'S1-%' UNION ALL SELECT 'repeated_in_list', count(*) FROM pl WHERE len(l) <> len(list_distinct(l)) UNION ALL SELECT 'query_in_list', count(*) FROM pl WHERE len(list_filter(l, lambda x: x LIKE 'S1-%')) > 0
        UNION ALL SELECT 'foreign_in_list', count(*) FROM pl WHERE len(list_filter(l, lambda x: {foreign})) > 0 UNION ALL SELECT 'repeated_key', count(*) FROM (SELECT s1_id FROM pl GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'unknown_key', count(*) FROM pl WHERE s1_id NOT IN (SELECT id FROM rec WHERE src = 'S1')
        UNION ALL SELECT 'unknown_id', count(*) FROM ul WHERE id NOT IN ({known})""")
    few = "SELECT id FROM rec WHERE src = 'S1' AND seq <= 5"
    out["broken_lists"] = w(rec + bl, f"""SELECT 'missing_key' AS category, count(*) AS n FROM ({few}) WHERE id NOT IN (SELECT s1_id FROM pl) UNION ALL SELECT 'extra_key', count(*) FROM pl WHERE s1_id NOT IN ({few}) UNION ALL SELECT 'repeated_key', count(*) FROM (SELECT s1_id FROM pl GROUP BY 1 HAVING count(*) > 1)
        UNION ALL SELECT 'repeated_id', count(*) FROM pl WHERE len(l) <> len(list_distinct(l)) UNION ALL SELECT 'self_match', count(*) FROM ul WHERE id LIKE 'S1-%' UNION ALL SELECT 'wrong_prefix', count(*) FROM ul WHERE {foreign.replace('x LIKE', 'id LIKE')} UNION ALL SELECT 'unknown_id', count(*) FROM ul WHERE id NOT IN ({known})""")
    out["list_violations"] = "SELECT * FROM (VALUES " + ", ".join(f"('{n}', 0::BIGINT)" for n in ("missing_key", "extra_key", "repeated_key", "repeated_id", "self_match", "wrong_prefix", "unknown_id")) + ") x(category, n)"
    out["schema_violations"] = w(rec, "SELECT 'blank_id' AS category, count(*) FILTER (trim(id) = '') AS n FROM rec UNION ALL SELECT 'wrong_prefix', count(*) FILTER (id[1:2] NOT IN ('S1', 'S2')) FROM rec UNION ALL SELECT 'repeated_id', count(*) FROM (SELECT id FROM rec GROUP BY 1 HAVING count(*) > 1)")
    three = _split_sql("s1", 2, [("validation", 0.20), ("mining", 0.10)], "train", "three")
    two = _split_sql("s1", 2, [("validation", 0.2)], "train", "split")
    out["split_three_way"] = w(pairs, three)
    out["split_four"] = w(pairs, _split_sql("s1", 3, [("train", 0.816), ("dev", 0.092)], "holdout", "four"))
    out["split_two_samples"] = w(pairs, "SELECT s1_id, CASE WHEN rn <= 30 THEN 'dev' ELSE 'holdout' END AS part FROM (SELECT s1_id, row_number() OVER (ORDER BY md5('two' || s1_id), s1_id) AS rn FROM s1) WHERE rn <= 60")
    out["split_unexposed"] = w(f"{pairs}, ex AS ({two}), fr AS (SELECT s1_id FROM s1 ANTI JOIN (SELECT s1_id FROM ex WHERE part = 'validation') USING (s1_id))", _split_sql("fr", 2, [("validation", 0.15)], "reserve", "virgin"))
    out["split_overlap"] = w(f"{pairs}, a1 AS ({two}), a2 AS ({three}), al AS (SELECT s1_id, 'one ' || part AS part FROM a1 UNION ALL SELECT s1_id, 'two ' || part FROM a2)", "SELECT x.part AS part_a, y.part AS part_b, count(DISTINCT s1_id) AS n FROM al x JOIN al y USING (s1_id) WHERE x.part <= y.part GROUP BY 1, 2")
    out["negative_categories"] = w(pairs + _POOL, "SELECT s1_id, target_id, category, hardness FROM neg")
    kinds = "(SELECT count(DISTINCT category) FROM neg)"
    out["negatives_ratio"] = w(pairs + _POOL, f"SELECT s1_id, target_id, category, hardness FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY hardness DESC, s1_id, target_id) AS rn FROM neg) WHERE rn <= 160 // {kinds} + 10 ORDER BY hardness DESC, s1_id, target_id LIMIT 160")
    out["negatives_hardest"] = w(pairs + _POOL, "SELECT s1_id, target_id, hardness FROM neg ORDER BY hardness DESC, s1_id, target_id LIMIT 200")
    out["negatives_curriculum"] = w(pairs + _POOL + f""", tp AS (SELECT * FROM neg ORDER BY hardness DESC, s1_id, target_id LIMIT 156), sp AS (SELECT *, md5('mix' || s1_id || '|' || target_id) AS h FROM neg ANTI JOIN tp USING (s1_id, target_id)),
        sq AS (SELECT * FROM sp QUALIFY row_number() OVER (PARTITION BY category ORDER BY h, s1_id, target_id) <= 84 // {kinds} + 50 ORDER BY h, s1_id, target_id LIMIT 84)""", "SELECT s1_id, target_id, category, hardness, 'hard' AS origin FROM tp UNION ALL SELECT s1_id, target_id, category, hardness, 'spread' FROM sq")
    out["false_positives"] = w(sc, f"""SELECT s1_id, target_id, p, round(nm, 6) AS name_similarity, round(ad, 6) AS addr_similarity, CASE WHEN nm >= 0.85 AND ad <= 0.35 THEN 'same_name_diff_address' WHEN ad >= 0.85 AND nm <= 0.40 THEN 'same_address_diff_name' WHEN nm >= 0.80 AND ad >= 0.70 THEN 'high_name_high_address_wrong_entity'
        WHEN pin THEN 'same_postal_wrong_entity' WHEN bld THEN 'same_building_wrong_entity' WHEN noaddr THEN 'missing_address_collision' WHEN nr >= 2 THEN 'multi_route_collision' WHEN nm >= 0.75 THEN 'franchise_duplicate_collision' ELSE 'medium_collision' END AS category
        FROM (SELECT s1_id, target_id, p, len(rs) AS nr, {_OVER} AS nm, {_AJAC} AS ad, {_SAME_PIN} AS pin, {_SAME_BLD} AS bld, q.a = '' OR t.a = '' AS noaddr FROM sc JOIN pairs USING (s1_id, target_id) ANTI JOIN truth USING (s1_id, target_id) JOIN par q ON q.id = s1_id JOIN par t ON t.id = target_id WHERE p >= 0.25)""")
    lean = rec + _retrieval_sql("lean") + ", truth AS (SELECT a.id AS s1_id, b.id AS target_id FROM rec a JOIN rec b USING (seq) WHERE a.src = 'S1' AND b.src <> 'S1')"
    ranked = "(SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY n_routes DESC, score DESC, target_id)::INT AS rn FROM ret ANTI JOIN truth USING (s1_id, target_id))"
    out["negatives_by_routes"] = w(lean, f"SELECT s1_id, target_id, rn FROM {ranked} LEFT JOIN (SELECT s1_id, count(*) AS m FROM truth GROUP BY 1) USING (s1_id) WHERE rn <= greatest(3, coalesce(m, 0) * 3)")
    out["negatives_few"] = w(lean, f"SELECT s1_id, target_id, rn FROM {ranked} LEFT JOIN (SELECT s1_id, count(*) AS m FROM ret SEMI JOIN truth USING (s1_id, target_id) GROUP BY 1) USING (s1_id) WHERE rn <= least(3, greatest(1, 2 * coalesce(m, 0)))")
    out["sample_of_queries"] = w(pairs, "SELECT s1_id FROM s1 ORDER BY md5('reality|' || s1_id), s1_id LIMIT 40")
    out["most_common_countries"] = w(rec, "SELECT country, count(*) AS n FROM rec GROUP BY 1 ORDER BY n DESC, country LIMIT 10")
    out["best_similar"] = w(sc, "SELECT s1_id, target_id, p, row_number() OVER (PARTITION BY s1_id ORDER BY p DESC, target_id)::INT AS rn FROM sc QUALIFY rn <= 3")
    j = "ms JOIN par q ON q.id = s1_id JOIN par t ON t.id = target_id"
    out["missed_reasons"] = w(pairs + _MISSED, f"""SELECT s1_id, target_id, CASE WHEN q.n = '' OR len(t.nt) = 0 THEN 'empty_or_missing_name' WHEN q.country <> '' AND t.country <> '' AND q.country <> t.country THEN 'cross_country_mismatch' WHEN {_SHARED} = 0 THEN 'zero_shared_tokens_transliteration'
        ELSE 'partial_token_overlap_unindexed' END AS reason, array_to_string(list_sort(list_intersect(q.nt, t.nt)), ',') AS shared_tokens FROM {j}""")
    nm, ad = f"{_SHARED} > 0", "len(list_intersect(q.adt, t.adt)) > 0"
    out["missed_scopes"] = w(pairs + _MISSED, f"SELECT s1_id, target_id, CASE WHEN trim(t.addr) = '' THEN '1 target without address' WHEN NOT ({nm}) AND NOT ({ad}) THEN '2 nothing shared' WHEN NOT ({nm}) THEN '3 address shared, name not' WHEN NOT ({ad}) THEN '4 name shared, address not' ELSE '5 both shared, ranked too low' END AS category FROM {j}")
    ini = lambda s: f"array_to_string(list_transform(list_filter(string_split({s}.n, ' '), lambda x: x <> ''), lambda x: x[1]), '')"
    out["missed_categories"] = w(pairs + _MISSED, f"""SELECT s1_id, target_id, CASE WHEN qname = '' OR tname = '' THEN '7. missing name' WHEN qaddr = '' OR taddr = '' THEN '6. missing address' WHEN regexp_matches(qname, '[^\\x00-\\x7F]') <> regexp_matches(tname, '[^\\x00-\\x7F]') THEN '10. cross-script'
        WHEN nq > 0 AND qsig = tsig THEN '5. word reordering' WHEN (length(qn) <= 4 AND contains(ti, qn)) OR (length(tn) <= 4 AND contains(qi, tn)) THEN '4. abbreviation' WHEN nm >= 60 AND nm < 90 THEN '1. spelling corruption' WHEN translate(qn, '015', 'ois') = translate(tn, '015', 'ois') THEN '2. OCR corruption'
        WHEN nm >= 90 AND ad < 40 THEN '8. common name' WHEN ad >= 50 THEN '9. address variation' WHEN nm >= 40 AND nm < 60 THEN '3. transliteration' ELSE '11. other' END AS category FROM (SELECT s1_id, target_id, q.name AS qname, t.name AS tname, q.addr AS qaddr, t.addr AS taddr, len(q.nt) AS nq, q.sig AS qsig, t.sig AS tsig,
        q.n AS qn, t.n AS tn, {ini('q')} AS qi, {ini('t')} AS ti, 100.0::DOUBLE * {_OVER} AS nm, 100.0::DOUBLE * {_AJAC} AS ad FROM {j})""")
    out["rescue"] = w(pairs + ", o AS (SELECT DISTINCT s1_id, target_id, 1 AS o FROM hits WHERE route = 'rare_token'), nw AS (SELECT DISTINCT s1_id, target_id, 1 AS n FROM hits WHERE route IN ('postal', 'building'))", "SELECT CASE WHEN o = 1 AND n = 1 THEN 'both' WHEN n = 1 THEN 'rescued' WHEN o = 1 THEN 'lost' ELSE 'neither' END AS kind, count(*) AS n FROM truth LEFT JOIN o USING (s1_id, target_id) LEFT JOIN nw USING (s1_id, target_id) GROUP BY 1")
    out["without_candidates"] = w(pairs + _MISSED + f""", lo AS (SELECT s1_id FROM s1 ANTI JOIN few USING (s1_id)), ne AS (SELECT s1_id, count(*) AS n, max({_OVER}) AS s FROM lo JOIN truth USING (s1_id) JOIN par q ON q.id = s1_id JOIN par t ON t.id = target_id GROUP BY 1)""", """SELECT s1_id, coalesce(n, 0) AS n_true,
        CASE WHEN coalesce(n, 0) = 0 THEN 'A_True_Singleton' WHEN addr = '' OR length(name) <= 3 OR NOT regexp_matches(name, '[A-Za-z0-9]') THEN 'C_Systematic_Sparse_Address_Or_Script' ELSE 'B_True_Matched_Retrieval_Failure' END AS category, round(coalesce(s, 0.0), 6) AS nearest FROM lo JOIN rec ON rec.id = s1_id LEFT JOIN ne USING (s1_id)""")
    stage = """, tr AS (SELECT s1_id, target_id, CASE WHEN list_has_any(rs, ['exact_name', 'name_sig']) THEN 1 WHEN list_contains(rs, 'rare_token') THEN 2 ELSE 3 END AS tier, rs FROM pairs), kp AS (SELECT * FROM tr QUALIFY row_number() OVER (PARTITION BY s1_id ORDER BY tier, len(rs) DESC, target_id) <= 60),
        sr AS (SELECT *, row_number() OVER (PARTITION BY s1_id, s2src ORDER BY p DESC, target_id) AS k FROM ld), sg AS (SELECT truth.target_id LIKE 'S2-%' AS s2, CASE WHEN pairs.rs IS NULL THEN 1 WHEN kp.rs IS NULL THEN 2 WHEN p IS NULL THEN 3
        WHEN p < greatest(CASE WHEN truth.target_id LIKE 'S2-%' THEN 0.34 ELSE 0.30 END, CASE WHEN p < top THEN 0.28 ELSE 0 END) THEN 4 WHEN top < 0.3 THEN 5 WHEN round(top - p, 9) > 0.3 THEN 6 WHEN k > 1 THEN 7 ELSE 8 END AS stage
        FROM truth LEFT JOIN pairs USING (s1_id, target_id) LEFT JOIN kp USING (s1_id, target_id) LEFT JOIN sr USING (s1_id, target_id))"""
    share = lambda i, cond: f"coalesce(round(count(*) FILTER (stage > {i} AND {cond}) / nullif(count(*) FILTER ({cond}), 0), 6), 1.0)"
    out["funnel_stages"] = w(lists + stage, " UNION ALL ".join(f"""SELECT '{n.replace("'", "''")}' AS stage, count(*) FILTER (stage = {i}) AS lost, count(*) FILTER (stage > {i}) AS "left", {share(i, 'true')} AS recall, {share(i, 's2')} AS recall_s2, {share(i, 'NOT s2')} AS recall_s3 FROM sg""" for i, n in enumerate(forensics.FUNNEL[:7], 1)))
    side = lambda a, b, seed: f"(SELECT s1_id, target_id FROM {a} ANTI JOIN {b} USING (s1_id, target_id) ORDER BY md5('{seed}|' || s1_id || '|' || target_id), s1_id, target_id LIMIT 50)"
    out["error_samples"] = w(picks + f", er AS (SELECT *, 'false link' AS kind FROM {side('picks', 'truth', 'fp')} UNION ALL SELECT *, 'missed' FROM {side('truth', 'picks', 'fn')})", "SELECT s1_id, target_id, kind, p, CASE WHEN kind = 'false link' THEN 'scored from the threshold on' WHEN rs IS NULL THEN 'no candidate' WHEN p < 0.35 THEN 'scored below the threshold' ELSE 'left out by the decision' END AS reason FROM er LEFT JOIN sc USING (s1_id, target_id) LEFT JOIN pairs USING (s1_id, target_id)")
    out["drop_duplicates"] = w(sc, "SELECT * FROM sc")
    tf = lambda grams, col, who: f""", d AS (SELECT id, src, unnest({grams}) AS g FROM (SELECT id, src, {col} AS v FROM par)), cc AS (SELECT id, src, g, count(*) AS c FROM d GROUP BY ALL),
        tn0 AS (SELECT count(*) AS n FROM rec WHERE src {who}), idf AS (SELECT g, ln((n + 1) / (count(*) + 1)) + 1 AS idf FROM cc, tn0 WHERE src {who} GROUP BY g, n HAVING count(*) >= 2 AND count(*) <= 0.25 * n),
        wt AS (SELECT id, src, g, (ln(c) + 1) * idf AS w FROM cc JOIN idf USING (g)), nm AS (SELECT id, sqrt(sum(w * w)) AS norm FROM wt GROUP BY id), v AS (SELECT id, src, g, w / norm AS w FROM wt JOIN nm USING (id)),
        sim AS (SELECT a.id AS s1_id, b.id AS target_id, round(sum(a.w * b.w), 6) AS sim FROM v a JOIN v b USING (g) WHERE a.src = 'S1' AND b.src {who} GROUP BY 1, 2)"""  # noqa: E731
    four = "CASE WHEN length(v) < 4 THEN [] ELSE list_transform(range(1, length(v) - 2), lambda i: substring(v, i, 4)) END"
    out["tfidf_compact"] = w(rec + tf(four, "replace(n, ' ', '')", "<> 'S1'"), "SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY sim DESC, target_id)::INT AS rank FROM sim WHERE sim >= 0.15 QUALIFY rank <= 10")
    g3 = "list_transform(range(1, length(v) - 1), lambda i: substring(v, i, 3))"
    half = {s: "".join(tf(g3, "n", f"= '{s}'")) for s in ("S2", "S3")}
    source = lambda s: f"(WITH dummy AS (SELECT 1){half[s]} SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY sim DESC, target_id)::INT AS rank, '{s}' AS source FROM sim WHERE sim >= 0.18 QUALIFY rank <= 20)"
    out["tfidf_per_source"] = w(rec, f"SELECT *, CASE WHEN rank <= 5 THEN 5 ELSE 20 END AS within FROM (SELECT * FROM {source('S2')} UNION ALL SELECT * FROM {source('S3')})")
    out["legal_and_address_fixture"] = fixture_sql(w(rec + _WIDE, "SELECT id, legal, expd AS address, core, cc AS country_code, street, pin, nullif(bld, '') AS building FROM wide"))
    base = c.base_sql()
    for n in ("missed_categories", "missed_reasons", "missed_scopes", "without_candidates", "bands_second", "bands_reconstruction", "bands_seven", "rule_report", "truth_patterns", "distribution", "retrieval_balanced"):
        out[f"{n}_fixture"] = fixture_sql(out[n])
    for n in ("block_exact_name", "block_name_sig", "src_profile"):
        out[f"{n}_fixture"] = fixture_sql(base[n])
    feats = base["pair_features"]
    names = [x.split()[-1] for x in c.FEATURE_SQL]
    long = " UNION ALL ".join(f"SELECT '{n}' AS feature, round(avg(({n} IS NULL)::INT), 6) AS missing, 0.0::DOUBLE AS infinite, min({n}) AS least, max({n}) AS most, round(avg({n}), 6) AS mean, round(stddev_samp({n}), 6) AS deviation, min({n}) = max({n}) AS constant FROM ft" for n in names)
    cut = feats.rindex("\nSELECT")
    out["feature_quality"] = f"{feats[:cut]}, ft AS ({feats[cut + 1 :]})\n{long}"
    return out
