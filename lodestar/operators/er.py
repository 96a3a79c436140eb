"""Entity-resolution dataflow: keys, blocking joins, retrieval, features, decisions and metrics.

Tables: records(id, src, seq, name, addr, country) with src S1 for queries and S2, S3 for targets;
keys(route, key, id, src, seq); hits(s1_id, target_id, route, weight); pairs(s1_id, target_id, routes,
n_routes, score); scores(s1_id, target_id, p). Every cap counts targets in (src, seq) order and is a
window on the target side before the join; heavy tokens are gated by document frequency before it too.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.functions import text as T

PAIR = ["s1_id", "target_id"]
#: route -> (weight, default cap, most targets a token may have: 0 for any)
ROUTES = {
    "exact_name": (5.0, 500, 0), "compact_name": (4.0, 400, 0), "core_name": (3.5, 300, 0), "name_sig": (3.5, 300, 0), "rare_token": (3.0, 250, 350), "sig_token": (2.0, 150, 3500),
    "num_street": (3.0, 100, 0), "name_num": (3.0, 100, 0), "name_postal": (3.0, 100, 0), "postal": (1.5, 100, 0), "building": (1.0, 100, 0),
    "char_4gram": (2.5, 100, 500), "char_3gram": (2.0, 100, 500), "exact_addr": (3.0, 200, 0), "addr_sig": (2.5, 200, 0), "phonetic": (3.5, 150, 0), "word2gram": (3.0, 150, 350),
}


@dataclass(frozen=True)
class Profile:
    """most: pairs kept per query; scale: of the caps; routes: names used (none: all); caps, gates: by route, in
    place of the scaled cap and of the gate in ROUTES. Significant tokens are those over the gate of rare ones."""

    most: int = 250
    scale: float = 1.0
    routes: tuple[str, ...] = ()
    caps: dict[str, int] = field(default_factory=dict)
    gates: dict[str, int] = field(default_factory=dict)


def _profile(most: int, scale: float, names: tuple[int, ...], other: int, gates: tuple[int, int, int]) -> Profile:
    """The caps of name routes, of numbers and grams, and the gates of rare and significant tokens and grams; addresses have one cap."""
    caps = dict(zip(("exact_name", "compact_name", "core_name", "name_sig", "rare_token", "sig_token"), names, strict=True))
    caps |= dict.fromkeys(("postal", "building", "num_street", "name_num", "name_postal", "char_3gram", "char_4gram"), other) | {"exact_addr": 200, "addr_sig": 200}
    return Profile(most, scale, tuple(caps), caps, dict(zip(("rare_token", "sig_token", "char_3gram", "char_4gram"), (*gates, gates[2]), strict=True)))


PROFILES = {
    "high": _profile(300, 1.0, (500, 400, 300, 300, 250, 150), 100, (400, 4000, 600)),
    "balanced": _profile(150, 0.6, (250, 200, 150, 150, 100, 80), 50, (250, 2500, 300)),
    "lean": _profile(80, 0.3, (100, 80, 60, 60, 50, 30), 25, (150, 1500, 150)),
}


def parse(records: DataFrame, unicode_text: bool = False) -> DataFrame:
    """records with all search keys; unicode_text: names may hold characters beyond ASCII."""
    r = records.withColumn("n", T.normalize("name", unicode_text)).withColumn("a", T.normalize("addr", unicode_text))
    r = r.withColumn("core", T.core_name("n")).withColumn("compact", T.compact("n")).withColumn("name_sig", T.signature("n"))
    r = r.withColumn("addr_sig", T.signature("a")).withColumn("name_tokens", F.array_distinct(T.tokens("n"))).withColumn("addr_tokens", F.array_distinct(T.tokens("a")))
    r = r.withColumn("building", T.building("addr")).withColumn("postals", F.array_distinct(T.postal_codes("addr"))).withColumn("pin", F.array_min("postals"))
    r = r.withColumn("street", T.street_token("a", "building")).withColumn("phonetic", T.phonetic_key("core"))
    return r


def route_keys(parsed: DataFrame) -> DataFrame:
    """keys of every route; empty keys are left out. One pass over the records.

    A target's core name is a key only where it isn't its whole name; grams are those of the core name, and a query
    keeps those that repeat, so they count as often as they occur in it.
    """
    first = F.get(F.split("core", " "), F.lit(0))
    query = F.col("src") == "S1"
    grams = lambda n: F.when(query, T.key_ngrams("core", n)).otherwise(F.array_distinct(T.key_ngrams("core", n)))
    single = {
        "exact_name": F.col("n"), "compact_name": F.col("compact"), "core_name": F.when(query | (F.col("core") != F.col("n")), F.col("core")), "name_sig": F.col("name_sig"), "exact_addr": F.col("a"), "addr_sig": F.col("addr_sig"),
        "building": F.col("building"), "num_street": F.concat("building", F.lit("_"), "street"), "name_num": F.concat(first, F.lit("_"), "building"),
        "name_postal": F.concat(first, F.lit("_"), "pin"), "phonetic": F.col("phonetic"),
    }
    long = F.filter("name_tokens", lambda t: F.length(t) >= 3)
    many = {
        "rare_token": long, "sig_token": long, "postal": F.col("postals"), "char_4gram": grams(4),
        "char_3gram": grams(3), "word2gram": F.array_distinct(T.word_bigrams("n")),
    }
    tagged = lambda route: lambda k: F.struct(F.lit(route).alias("route"), k.alias("key"))
    arrays = [F.transform(F.array(c), tagged(r)) for r, c in single.items()] + [F.transform(c, tagged(r)) for r, c in many.items()]
    out = parsed.select("id", "src", "seq", F.explode(F.flatten(F.array(*arrays))).alias("k")).select("k.route", "k.key", "id", "src", "seq")
    return out.where("key is not null and key <> ''")


def blocked(queries: DataFrame, targets: DataFrame, caps: dict[str, int], gates: dict[str, int], floors: dict[str, int] | None = None) -> DataFrame:
    """hits(s1_id, target_id, route): equal keys, first cap targets per key, keys over their gate or not over their floor left out."""
    wanted = F.create_map(*[F.lit(x) for kv in caps.items() for x in kv])
    gate = F.create_map(*[F.lit(x) for r in caps for x in (r, gates.get(r, 0))])
    floor = F.create_map(*[F.lit(x) for r in caps for x in (r, (floors or {}).get(r, 0))])
    keep = list(caps)
    asked = queries.where(F.col("route").isin(keep)).select("route", "key").distinct()
    t = targets.where(F.col("route").isin(keep)).join(asked.hint("merge"), ["route", "key"], "left_semi")
    df = t.groupBy("route", "key").agg(F.count("*").alias("df"))
    if {"char_3gram", "char_4gram"} <= set(caps):
        # grams of both lengths share their count: a text too short for either is the same gram to both
        short = df.where("route in ('char_3gram', 'char_4gram') and length(key) <= 3").groupBy("key").agg(F.sum("df").alias("both"))
        gram = F.col("route").isin("char_3gram", "char_4gram")
        df = df.join(short, "key", "left").withColumn("df", F.when(gram, F.coalesce("both", "df")).otherwise(F.col("df"))).drop("both")
    df = df.where((gate[F.col("route")] == 0) | (F.col("df") <= gate[F.col("route")])).where(F.col("df") > floor[F.col("route")]).select("route", "key")
    order = W.partitionBy("route", "key").orderBy("src", "seq")
    most = max(caps.values())
    t = t.join(df.hint("merge"), ["route", "key"], "left_semi").withColumn("rn", F.row_number().over(order)).where(f"rn <= {most}").where(F.col("rn") <= wanted[F.col("route")])
    q = queries.where(F.col("route").isin(keep)).select("route", "key", F.col("id").alias("s1_id"))
    return q.join(t.select("route", "key", F.col("id").alias("target_id")).hint("merge"), ["route", "key"]).select("s1_id", "target_id", "route")


def tfidf_per_source(queries: DataFrame, targets: DataFrame, ks: tuple[int, ...] = (20, 50, 100, 200), **how) -> DataFrame:
    """The best of each target source per query, searched once; `within` tells the smallest of ks that holds a row."""
    got = None
    for source in ("S2", "S3"):
        one = tfidf_topk(queries, targets.where(F.col("src") == source), max(ks), **how).withColumn("source", F.lit(source))
        got = one if got is None else got.unionByName(one)
    within = F.lit(max(ks))
    for k in sorted(ks, reverse=True):
        within = F.when(F.col("rank") <= k, F.lit(k)).otherwise(within)
    return got.withColumn("within", within)


def with_residual(hits: DataFrame, parsed: DataFrame, same_country: bool = False) -> DataFrame:
    """hits whose records share a name token (and a country)."""
    q = parsed.select(F.col("id").alias("s1_id"), F.col("name_tokens").alias("qt"), F.col("country").alias("qc"))
    t = parsed.select(F.col("id").alias("target_id"), F.col("name_tokens").alias("tt"), F.col("country").alias("tc"))
    out = hits.join(q.hint("merge"), "s1_id").join(t.hint("merge"), "target_id").where(F.arrays_overlap("qt", "tt"))
    return (out.where("qc = tc") if same_country else out).select("s1_id", "target_id", "route")


def union_provenance(hits: DataFrame, most: int = 0) -> DataFrame:
    """pairs with their sorted routes, tier (1 exact or signature, 2 rare or n-gram, 3 other) and cap per query."""
    p = hits.groupBy(*PAIR).agg(F.array_sort(F.collect_set("route")).alias("routes"))
    p = p.withColumn("n_routes", F.size("routes"))
    tier = F.when(F.arrays_overlap("routes", F.array(*map(F.lit, ("exact_name", "exact_addr", "name_sig", "addr_sig")))), 1)
    p = p.withColumn("tier", tier.when(F.arrays_overlap("routes", F.array(*map(F.lit, ("rare_token", "name_tfidf", "addr_tfidf")))), 2).otherwise(3))
    if most:
        order = W.partitionBy("s1_id").orderBy("tier", F.desc("n_routes"), "target_id")
        p = p.withColumn("rn", F.row_number().over(order)).where(f"rn <= {most}").drop("rn")
    return p


def retrieve(queries: DataFrame, targets: DataFrame, profile: Profile) -> DataFrame:
    """Weighted retrieval: scores summed over hits, ranked by (routes, score, target) within the query."""
    return retrieve_routes(queries, targets, profile).drop("routes")


def retrieve_routes(queries: DataFrame, targets: DataFrame, profile: Profile) -> DataFrame:
    """As retrieve, with the sorted routes of every pair."""
    names = profile.routes or tuple(ROUTES)
    caps = {r: profile.caps.get(r, max(1, int(ROUTES[r][1] * profile.scale))) for r in names}
    gates = {r: profile.gates.get(r, ROUTES[r][2]) for r in ROUTES}
    hits = blocked(queries, targets, caps, gates, {"sig_token": gates["rare_token"]})
    weight = F.create_map(*[F.lit(x) for r in names for x in (r, ROUTES[r][0])])
    p = hits.groupBy(*PAIR).agg(F.round(F.sum(weight[F.col("route")]), 6).alias("score"), F.array_sort(F.collect_set("route")).alias("routes"))
    p = p.withColumn("n_routes", F.size("routes").cast("long"))
    order = W.partitionBy("s1_id").orderBy(F.desc("n_routes"), F.desc("score"), "target_id")
    return p.withColumn("rank", F.row_number().over(order)).where(f"rank <= {profile.most}")


def tfidf_topk(queries: DataFrame, targets: DataFrame, k: int, low: int = 3, high: int = 3, min_df: int = 2, max_df: float = 1.0, least: float = 0.0) -> DataFrame:
    """Character-gram TF-IDF cosine, best k targets per query: 1 + ln tf, smoothed idf over targets, unit length.

    queries, targets: id, t (text). See `search`: vectors and products stay in tasks.
    """
    from lodestar.operators import search

    return search.topk(queries, targets, k, low, high, min_df, max_df, least)


def jaccard(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def overlap(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b)))


def dice(a: Column, b: Column) -> Column:
    return F.when(F.size(a) + F.size(b) == 0, F.lit(0.0)).otherwise(2 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b)))


def levenshtein_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(0.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def grams3(c: Column) -> Column:
    """Distinct 3-grams with spaces; a shorter text is its own."""
    return F.when(c == "", F.array().cast("array<string>")).when(F.length(c) < 3, F.array(c)).otherwise(F.array_distinct(T._grams(c, 3)))


def join_records(pairs: DataFrame, parsed: DataFrame) -> DataFrame:
    """pairs with both records as structs q and t. Records are never broadcast: their compressed size, by which Spark decides,
    tells little of what they take in the driver."""
    cols = [c for c in parsed.columns]
    q = parsed.select(F.col("id").alias("s1_id"), F.struct(*cols).alias("q"))
    t = parsed.select(F.col("id").alias("target_id"), F.struct(*cols).alias("t"))
    return pairs.join(q.hint("merge"), "s1_id").join(t.hint("merge"), "target_id")


def pair_features(joined: DataFrame) -> DataFrame:
    """Features of pairs that stay in built-in functions; all doubles rounded to six places."""
    q, t = lambda c: F.col(f"q.{c}"), lambda c: F.col(f"t.{c}")
    f: dict[str, Column] = {}
    for p, c, toks in (("name", "n", "name_tokens"), ("addr", "a", "addr_tokens")):
        raw = {"name": "name", "addr": "addr"}[p]
        f[f"{p}_exact_raw"] = F.when((q(raw) == t(raw)) & (q(raw) != ""), 1.0).otherwise(0.0)
        f[f"{p}_exact_norm"] = F.when((q(c) == t(c)) & (q(c) != ""), 1.0).otherwise(0.0)
        f[f"{p}_levenshtein"] = levenshtein_similarity(q(c), t(c))
        f[f"{p}_jaccard"] = jaccard(q(toks), t(toks))
        f[f"{p}_overlap"] = overlap(q(toks), t(toks))
        f[f"{p}_char3"] = jaccard(grams3(q(c)), grams3(t(c)))
        f[f"{p}_token_diff"] = F.abs(F.size(q(toks)) - F.size(t(toks))).cast("double")
        f[f"{p}_length_ratio"] = F.least(F.length(q(c)), F.length(t(c))) / F.greatest(F.length(q(c)), F.length(t(c)), F.lit(1))
        f[f"{p}_dice"] = dice(grams3(q(c)), grams3(t(c)))
        f[f"{p}_contains"] = F.when((F.length(q(c)) >= 4) & (F.length(t(c)) >= 4) & (q(c).contains(t(c)) | t(c).contains(q(c))), 1.0).otherwise(0.0)
    f["country_match"] = F.when((q("country") != "") & (q("country") == t("country")), 1.0).otherwise(0.0)
    f["country_mismatch"] = F.when((q("country") != "") & (t("country") != "") & (q("country") != t("country")), 1.0).otherwise(0.0)
    f["postal_match"] = F.when(F.arrays_overlap(q("postals"), t("postals")), 1.0).otherwise(0.0)
    f["building_match"] = F.when(q("building") == t("building"), 1.0).otherwise(0.0)
    f["first_word_match"] = F.when(F.substring_index(q("n"), " ", 1) == F.substring_index(t("n"), " ", 1), 1.0).otherwise(0.0)
    f["target_is_s2"] = F.when(t("src") == "S2", 1.0).otherwise(0.0)
    f["name_x_addr"] = f["name_jaccard"] * f["addr_jaccard"]
    return joined.select(*PAIR, *[F.round(c, 6).alias(k) for k, c in f.items()])


def context_features(scores: DataFrame) -> DataFrame:
    """Rank, gap to the best and candidate count per query; frequency and rank on the target side."""
    q, t = W.partitionBy("s1_id"), W.partitionBy("target_id")
    rank = lambda w, tie: F.row_number().over(w.orderBy(F.desc("p"), tie))
    return scores.select(
        *PAIR,
        "p",
        rank(q, "target_id").alias("rank"),
        F.round(F.max("p").over(q) - F.col("p"), 6).alias("gap_to_top"),
        F.count("*").over(q).alias("n_candidates"),
        F.count("*").over(t).alias("target_frequency"),
        rank(t, "s1_id").alias("target_rank"),
    )


@dataclass(frozen=True)
class Decision:
    """Thresholds of the decision rules."""

    strategy: str = "adaptive_multi"
    threshold: float = 0.65
    s2: float = 0.62
    s3: float = 0.68
    min_top: float = 0.58
    min_margin: float = 0.05
    multi: float = 0.60
    max_drop: float = 0.12
    per_source: int = 1
    boost: float = 0.05
    abstain: bool = True
    multiple: bool = True


def decide(scores: DataFrame, d: Decision, meta: DataFrame | None = None) -> DataFrame:
    """picks(s1_id, target_id, p). meta: s1_id, has_addr; queries without an address get higher thresholds. Of a
    target that repeats among a query's scores the best counts; queries are dealt out once for that and all windows."""
    scores = scores.select(*PAIR, "p").repartition("s1_id").groupBy(*PAIR).agg(F.max("p").alias("p"))
    boost = F.lit(0.0)
    if meta is not None:
        scores = scores.join(meta, "s1_id", "left")
        boost = F.when(F.coalesce("has_addr", F.lit(True)), 0.0).otherwise(d.boost)
    w = W.partitionBy("s1_id").orderBy(F.desc("p"), "target_id")
    s = scores.withColumn("b", boost).withColumn("own", F.when(F.col("target_id").startswith("S2-"), d.s2).otherwise(d.s3))
    if d.strategy == "global":
        return s.where(F.col("p") >= d.threshold + F.col("b")).select(*PAIR, "p")
    if d.strategy == "source_specific":
        return s.where(F.col("p") >= F.col("own") + F.col("b")).select(*PAIR, "p")
    whole = W.partitionBy("s1_id")
    s = s.withColumn("rn", F.row_number().over(w)).withColumn("top", F.max("p").over(whole)).withColumn("n", F.count("*").over(whole))
    s = s.withColumn("second", F.max(F.when(F.col("rn") == 2, F.col("p"))).over(whole)).withColumn("margin", F.round(F.col("top") - F.coalesce("second", F.lit(0.0)), 9))
    if d.strategy == "margin_abstention":
        out = (F.col("top") < d.min_top + F.col("b")) | ((F.col("top") < d.threshold + F.col("b")) & (F.col("margin") < d.min_margin))
        return s.where(~(out if d.abstain else F.lit(False)) & (F.col("p") >= d.threshold + F.col("b"))).select(*PAIR, "p")
    if d.strategy == "prefix":  # stops at the first that fails
        bad = F.min(F.when(F.col("p") < d.threshold, F.col("rn"))).over(whole)
        return s.withColumn("bad", bad).where("bad is null or rn < bad").select(*PAIR, "p")
    if d.strategy == "rank_aware":  # thresholds rise with rank
        return s.where(F.col("p") >= d.threshold + 0.04 * (F.col("rn") - 1)).where(f"rn <= {max(1, d.per_source)}").select(*PAIR, "p")
    first = F.max(F.when(F.col("rn") == 1, F.col("own"))).over(whole)
    s = s.withColumn("gate", first)
    stop = F.lit(False)
    if d.abstain:
        stop = F.col("top") < F.greatest(F.lit(d.min_top), F.col("gate")) + F.col("b")
        stop = stop | ((F.col("top") < F.col("gate") + F.col("b") + 0.05) & (F.col("margin") < d.min_margin) & (F.col("n") > 1))
    s = s.withColumn("stop", stop).where("not stop")
    more = (F.col("p") >= F.greatest(F.col("own"), F.lit(d.multi)) + F.col("b")) & (F.round(F.col("top") - F.col("p"), 9) <= d.max_drop) if d.multiple else F.lit(False)
    s = s.where((F.col("rn") == 1) | more)
    if d.per_source:
        per = W.partitionBy("s1_id", F.substring("target_id", 1, 2)).orderBy("rn")
        s = s.withColumn("k", F.row_number().over(per)).where(f"k <= {d.per_source}")
    return s.select(*PAIR, "p")


def prediction_lists(s1: DataFrame, picks: DataFrame) -> DataFrame:
    """Every query with its sorted targets joined by commas; empty for none."""
    got = picks.groupBy("s1_id").agg(F.array_join(F.array_sort(F.collect_set("target_id")), ",").alias("ids"))
    return s1.select("s1_id").join(got, "s1_id", "left").select("s1_id", F.coalesce("ids", F.lit("")).alias("matched_entity_ids"))


def entity_scores(s1: DataFrame, truth: DataFrame, picks: DataFrame, beta: float = 0.5) -> DataFrame:
    """Per query: n_true, n_pred, n_hit, precision, recall, f. Two empty sides score 1, one empty side 0."""
    pairs = truth.select(*PAIR, F.lit(1).alias("t"), F.lit(0).alias("h")).unionByName(picks.select(*PAIR, F.lit(0).alias("t"), F.lit(1).alias("h")))
    pairs = pairs.groupBy(*PAIR).agg(F.max("t").alias("t"), F.max("h").alias("h"))
    per = pairs.groupBy("s1_id").agg(F.sum("t").alias("n_true"), F.sum("h").alias("n_pred"), F.sum(F.col("t") * F.col("h")).alias("n_hit"))
    s = s1.select("s1_id").join(per, "s1_id", "left").na.fill(0, ["n_true", "n_pred", "n_hit"])
    both = (F.col("n_true") == 0) & (F.col("n_pred") == 0)
    p = F.when(both, 1.0).when(F.col("n_pred") == 0, 0.0).otherwise(F.col("n_hit") / F.col("n_pred"))
    r = F.when(both, 1.0).when(F.col("n_true") == 0, 0.0).otherwise(F.col("n_hit") / F.col("n_true"))
    s = s.withColumn("precision", p).withColumn("recall", r)
    b = beta * beta
    f = F.when(F.col("precision") + F.col("recall") == 0, 0.0).otherwise((1 + b) * F.col("precision") * F.col("recall") / (b * F.col("precision") + F.col("recall")))
    return s.withColumn("f", f)


def macro_metrics(per: DataFrame, by: list[str] | None = None) -> DataFrame:
    single = F.col("n_true") == 0
    return per.groupBy(*(by or [])).agg(
        F.count("*").alias("n"),
        F.round(F.avg("f"), 6).alias("macro_f"),
        F.round(F.avg("precision"), 6).alias("macro_precision"),
        F.round(F.avg("recall"), 6).alias("macro_recall"),
        F.sum("n_hit").alias("hits"),
        F.round(F.coalesce(F.sum("n_hit") / F.nullif(F.sum("n_pred"), F.lit(0)), F.lit(0.0)), 6).alias("micro_precision"),
        F.round(F.coalesce(F.sum("n_hit") / F.nullif(F.sum("n_true"), F.lit(0)), F.lit(1.0)), 6).alias("micro_recall"),
        F.round(F.coalesce(F.avg(F.when(single, (F.col("n_pred") == 0).cast("double"))), F.lit(1.0)), 6).alias("singleton_accuracy"),
    )


def error_kinds(per: DataFrame) -> DataFrame:
    fp, fn = F.col("n_pred") - F.col("n_hit"), F.col("n_true") - F.col("n_hit")
    kind = F.when((fp == 0) & (fn == 0), "perfect").when((F.col("n_true") == 0), "false_merge").when(F.col("n_pred") == 0, "miss").when((fp > 0) & (fn > 0), "mixed").when(fp > 0, "over").otherwise("under")
    return per.withColumn("fp", fp).withColumn("fn", fn).withColumn("kind", kind)


def threshold_sweep(s1: DataFrame, truth: DataFrame, scores: DataFrame, thresholds: list[float]) -> DataFrame:
    """Macro F by threshold: every query's candidates are collapsed once, then counted from each threshold on."""
    from lodestar.operators import rules

    sets = [{"threshold": x} for x in thresholds]
    return rules.scored_sets(rules.collapsed(s1, truth, scores), rules.by_threshold, sets).select("threshold", "macro_f")


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The row of the largest macro F, of equals that of the smallest threshold."""
    return sweep.orderBy(F.desc("macro_f"), "threshold").limit(1)


def stratified_split(s1: DataFrame, truth: DataFrame, share: float = 0.2, seed: str = "split") -> DataFrame:
    """s1_id, stratum (0, 1, 2 or more matches), part: the first floor(n * share) by hash of each stratum validate."""
    from lodestar.operators.sampling import split, strata

    return split(strata(s1, truth, 2), [("validation", share)], "train", seed)


def hard_negatives(scores: DataFrame, truth: DataFrame, ratio: int = 3) -> DataFrame:
    """The best-scored wrong candidates, up to max(ratio, ratio * matches) per query."""
    known = truth.groupBy("s1_id").agg(F.count("*").alias("m"))
    wrong = scores.join(truth.select(*PAIR), PAIR, "left_anti").join(known, "s1_id", "left")
    order = W.partitionBy("s1_id").orderBy(F.desc("p"), "target_id")
    return wrong.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= F.greatest(F.lit(ratio), F.coalesce("m", F.lit(0)) * ratio)).select(*PAIR, "p", "rn")
