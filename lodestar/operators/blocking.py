"""Blocking presets: sets of bands over derived keys, their residual conditions, unions and comparisons.

A band takes targets whose key equals the query's, if as many targets as its floor and gate allow have that key,
at most cap per key in (src, seq) order, and then only pairs that its residual condition admits. Frequencies and
caps are settled on the target side before the join; residuals see just the columns that they need.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.operators.er import PAIR

ANY = 1 << 30


@dataclass(frozen=True)
class Band:
    """key: kind of key; floor < targets with the key <= gate (ANY: no bound); rest: residual condition by name."""

    key: str
    cap: int
    floor: int = 0
    gate: int = ANY
    rest: str = ""


def _common(cap: int) -> tuple[Band, ...]:
    return tuple(Band(k, cap) for k in ("name", "addr", "name_sig", "addr_sig"))


def _mode(cap: int, tokens: tuple[tuple[int, int, int], ...], postal: int, building: int) -> tuple[Band, ...]:
    return (*_common(cap), *(Band("token", c, low, high) for low, high, c in tokens), Band("postal", postal), Band("building", building))


#: Named sets of bands: the seven-route benchmark, the second version and its fast form, the four-route-token retriever,
#: pruning modes, production, the closed pool, and the further routes of the reconstruction.
PRESETS: dict[str, tuple[Band, ...]] = {
    "seven": (*_common(50), Band("token3", 30, 0, 100), Band("postal", 30, rest="token"), Band("building", 20, rest="token_country")),
    "second": (
        Band("name", 50), Band("legal", 50), Band("addr", 50), Band("expanded", 50), Band("name_sig", 50), Band("addr_sig", 50), Band("token", 50, 0, 150), Band("token", 30, 150, 1000, "supported"),
        Band("postal", 50, rest="token_or_building"), Band("building", 30, rest="token_country"),
    ),
    "fast": (Band("name", 50), Band("addr", 50), Band("long_name_sig", 50), Band("long_addr_sig", 50), Band("token3", 40, 0, 150), Band("token3", 20, 150, 1000), Band("postal", 30)),
    "retriever": _mode(50, ((0, 150, 50), (150, 800, 25)), 30, 25),
    "prune_none": _mode(500, ((0, 1000, 200),), 200, 100),
    "prune_current": _mode(50, ((0, 150, 50), (150, 800, 25)), 30, 25),
    "prune_conservative": _mode(150, ((0, 300, 100), (300, 1500, 50)), 100, 50),
    "prune_recall_first": _mode(300, ((0, 500, 150), (500, 2500, 80)), 150, 80),
    "production": _mode(500, ((0, 1000, 200),), 200, 100),
    "uncapped": _mode(ANY, ((0, ANY, ANY),), ANY, ANY),
    "closed_pool": (Band("token", 25), Band("postal", 25), Band("building", 25)),
    "reconstruction": (
        Band("addr_token", 30, 1, 300), Band("building", 100, rest="country"), Band("num_street", 100), Band("name_num", 100), Band("country_token", 50, 0, 1000), Band("name_postal", 100),
        Band("token_by_country", 50, 150, 1000), Band("compact", 50), Band("addr_sig", 50),
    ),
}


def band_keys(parsed: DataFrame) -> DataFrame:
    """keys(kind, key, id, src, seq) of every kind of key that a band may name; empty keys are left out."""
    first = F.get(F.split("core", " "), F.lit(0))
    two = lambda c: F.when(F.size(F.split(F.col(c), " ")) > 1, F.col(c))
    country = T.country_code("country")
    single = {
        "name": F.col("n"), "legal": T.expand_legal(F.col("n")), "addr": F.col("a"), "expanded": T.expand_address(F.col("a")), "name_sig": F.col("name_sig"), "addr_sig": F.col("addr_sig"),
        "long_name_sig": two("name_sig"), "long_addr_sig": two("addr_sig"), "building": F.col("building"), "num_street": F.concat("building", F.lit("_"), "street"),
        "name_num": F.concat(first, F.lit("_"), "building"), "name_postal": F.concat(first, F.lit("_"), "pin"), "compact": F.col("compact"),
    }
    known = F.when(country != "", country)
    many = {
        "token": F.col("name_tokens"), "token3": F.filter("name_tokens", lambda t: F.length(t) >= 3), "postal": F.col("postals"), "addr_token": F.col("addr_tokens"),
        "country_token": F.transform(F.filter("name_tokens", lambda t: F.length(t) >= 4), lambda t: F.concat(known, F.lit("|"), t)),
        "token_by_country": F.transform("name_tokens", lambda t: F.concat(known, F.lit("|"), t)),
    }
    tagged = lambda kind: lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key"))
    arrays = [F.transform(F.array(c), tagged(k)) for k, c in single.items()] + [F.transform(c, tagged(k)) for k, c in many.items()]
    out = parsed.select("id", "src", "seq", F.explode(F.flatten(F.array(*arrays))).alias("k")).select("k.kind", "k.key", "id", "src", "seq")
    return out.where("key is not null and trim(key) <> ''")


def _admitted(rest: Column) -> Column:
    """Does the residual condition that rest names hold for the records q and t?"""
    shared = F.size(F.array_intersect("q.name_tokens", "t.name_tokens"))
    building = F.coalesce(F.col("q.building") == F.col("t.building"), F.lit(False))
    country, postal = F.col("q.country") == F.col("t.country"), F.arrays_overlap("q.postals", "t.postals")
    compatible = country | (F.col("q.country") == "") | (F.col("t.country") == "")
    return (
        F.when(rest == "token", shared > 0)
        .when(rest == "token_country", (shared > 0) & country)
        .when(rest == "token_or_building", (shared > 0) | building)
        .when(rest == "country", compatible)
        .when(rest == "supported", compatible & ((shared >= 2) | building | postal))
        .otherwise(F.lit(True))
    )


def banded(parsed: DataFrame, bands: tuple[Band, ...], limit: int = 0) -> DataFrame:
    """hits(s1_id, target_id, route) of the bands, route being the kind of key. limit: records per source, 0 for all."""
    if limit:
        parsed = parsed.where(F.col("seq") < limit)
    keys = band_keys(parsed).where(F.col("kind").isin(sorted({b.key for b in bands})))
    table = F.array(*[F.struct(F.lit(b.key).alias("kind"), F.lit(b.floor).alias("floor"), F.lit(b.gate).alias("gate"), F.lit(b.cap).alias("cap"), F.lit(b.rest).alias("rest")) for b in bands])
    q = keys.where("src = 'S1'").select("kind", "key", F.col("id").alias("s1_id"))
    t = keys.where("src <> 'S1'").join(q.select("kind", "key").distinct(), ["kind", "key"], "left_semi")
    df = t.groupBy("kind", "key").agg(F.count("*").alias("df")).withColumn("band", F.explode(table))
    df = df.where("band.kind = kind and df > band.floor and df <= band.gate").select("kind", "key", "band.cap", "band.rest")
    t = t.withColumn("rn", F.row_number().over(W.partitionBy("kind", "key").orderBy("src", "seq")))
    most = max(b.cap for b in bands)
    t = (t.where(f"rn <= {most}") if most < ANY else t).join(df, ["kind", "key"]).where("rn <= cap")
    hits = q.join(t.select("kind", "key", F.col("id").alias("target_id"), "rest"), ["kind", "key"]).select(*PAIR, F.col("kind").alias("route"), "rest")
    plain = hits.where("rest = ''").drop("rest")
    if all(not b.rest for b in bands):
        return plain
    slim = parsed.select("id", F.struct("name_tokens", "building", "postals", "country").alias("r"))
    tied = hits.where("rest <> ''").join(slim.select(F.col("id").alias("s1_id"), F.col("r").alias("q")), "s1_id").join(slim.select(F.col("id").alias("target_id"), F.col("r").alias("t")), "target_id")
    return plain.unionByName(tied.where(_admitted(F.col("rest"))).select(*PAIR, "route"))


def pairs_of(hits: DataFrame) -> DataFrame:
    """pairs(s1_id, target_id, routes sorted, n_routes)."""
    return hits.groupBy(*PAIR).agg(F.array_sort(F.collect_set("route")).alias("routes")).withColumn("n_routes", F.size("routes"))


def unbounded(bands: tuple[Band, ...]) -> bool:
    return all((b.cap, b.floor, b.gate, b.rest) == (ANY, 0, ANY, "") for b in bands)


LISTS, DEALT = 256, 8  # lists that the records of one set of keys come in at most; parts that a key's targets are dealt to


def whole_pairs(parsed: DataFrame, bands: tuple[Band, ...]) -> DataFrame:
    """pairs_of(banded(...)) of bands without bounds or conditions, routes joined by commas. Pairs are never shuffled.

    Records with the same keys, of those that both sides have, are lists of ids. Lists meet at every key they have in
    common and count at the least one, where all their common keys tell the routes; only then are they spread into pairs.
    """
    keys = band_keys(parsed).where(F.col("kind").isin(sorted({b.key for b in bands})))
    query = F.col("src") == "S1"
    both = keys.groupBy("kind", "key").agg(F.bool_or(query).alias("a"), F.bool_or(~query).alias("b")).where("a and b").select("kind", "key")
    live = keys.join(both.hint("merge"), ["kind", "key"]).groupBy(query.alias("query"), "id").agg(F.array_sort(F.collect_set(F.struct("kind", "key"))).alias("keys"))
    lists = live.groupBy("query", "keys", F.pmod(F.xxhash64("id"), F.lit(LISTS)).alias("nth")).agg(F.collect_list("id").alias("ids"))
    parts = max(64, 4 * parsed.sparkSession.sparkContext.defaultParallelism)

    def side(which: str, salt: Column, name: str) -> DataFrame:
        one = lists.where(which).select("keys", "ids", salt.alias("salt")).select("salt", "keys", "ids", F.explode("keys").alias("k"))
        # a number of partitions of its own: few lists may make very many pairs
        return one.select("k.kind", "k.key", "salt", F.col("keys").alias(f"{name}_keys"), F.col("ids").alias(f"{name}_ids")).repartition(parts, "kind", "key", "salt")

    q = side("query", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))), "q")
    t = side("not query", F.pmod("nth", F.lit(DEALT)).cast("int"), "t")
    met = q.join(t.hint("merge"), ["kind", "key", "salt"]).withColumn("common", F.array_intersect("q_keys", "t_keys"))
    met = met.where((F.col("common")[0]["kind"] == F.col("kind")) & (F.col("common")[0]["key"] == F.col("key")))
    routes = F.array_sort(F.array_distinct(F.col("common.kind")))
    met = met.select("q_ids", "t_ids", F.array_join(routes, ",").alias("routes"), F.size(routes).alias("n_routes"))
    return met.select(F.explode("q_ids").alias("s1_id"), "t_ids", "routes", "n_routes").select("s1_id", F.explode("t_ids").alias("target_id"), "routes", "n_routes")


def with_country(pairs: DataFrame, parsed: DataFrame) -> DataFrame:
    """pairs whose routes end in country_match or country_mismatch where both countries are known; n_routes stays."""
    code = parsed.select("id", T.country_code("country").alias("c"))
    out = pairs.join(code.select(F.col("id").alias("s1_id"), F.col("c").alias("qc")), "s1_id").join(code.select(F.col("id").alias("target_id"), F.col("c").alias("tc")), "target_id")
    said = F.when((F.col("qc") == "") | (F.col("tc") == ""), F.array().cast("array<string>")).when(F.col("qc") == F.col("tc"), F.array(F.lit("country_match"))).otherwise(F.array(F.lit("country_mismatch")))
    return out.withColumn("routes", F.concat("routes", said)).drop("qc", "tc")


def preranked(pairs: DataFrame, parsed: DataFrame, most: int = 150) -> DataFrame:
    """Queries with more than `most` pairs keep the best by 0.6 name and 0.3 address token-set similarity (0 to 100)
    and 10 a route; only their pairs are compared."""
    from lodestar.functions import fuzzy

    n = pairs.groupBy("s1_id").agg(F.count("*").alias("n"))
    few, many = (pairs.join(n.where(c).select("s1_id"), "s1_id", "left_semi") for c in (f"n <= {most}", f"n > {most}"))
    slim = parsed.select("id", "n", "a")
    many = many.join(slim.toDF("s1_id", "qn", "qa"), "s1_id").join(slim.toDF("target_id", "tn", "ta"), "target_id")
    score = 60 * fuzzy.token_set_of(F.col("qn"), F.col("tn")) + 30 * F.when((F.col("qa") == "") | (F.col("ta") == ""), 0.0).otherwise(fuzzy.token_set_of(F.col("qa"), F.col("ta"))) + 10 * F.col("n_routes")
    order = W.partitionBy("s1_id").orderBy(F.desc("score"), "target_id")
    many = many.withColumn("score", F.round(score, 6)).withColumn("rn", F.row_number().over(order)).where(f"rn <= {most}")
    return few.unionByName(many.select(few.columns))


RULES = ("exact_name", "name_sig", "shared_token", "name_gram3", "name_gram4", "addr_token", "addr_gram3", "addr_gram4", "postal", "building", "number_street", "name_number", "name_country", "name_postal", "same_country", "either_way", "strict")


def rule_flags(joined: DataFrame) -> DataFrame:
    """Seventeen boolean rules on pairs of records q and t: what each rule alone would have found."""
    from lodestar.operators.er import dice

    q, t = lambda c: F.col(f"q.{c}"), lambda c: F.col(f"t.{c}")
    same = lambda c: (q(c) != "") & (q(c) == t(c))
    grams = lambda c, k: F.array_distinct(T.key_ngrams(c, k))
    shared = F.array_intersect(q("name_tokens"), t("name_tokens"))
    building, postal = F.coalesce(q("building") == t("building"), F.lit(False)), F.coalesce(F.arrays_overlap(q("postals"), t("postals")), F.lit(False))
    words = F.filter(F.array_intersect(q("addr_tokens"), t("addr_tokens")), lambda x: (F.length(x) >= 3) & ~x.rlike(r"^\d+$"))
    name4 = dice(grams(q("n"), 4), grams(t("n"), 4)) >= 0.20
    some = F.size(shared) > 0
    flags = {
        "exact_name": same("n") | same("compact"), "name_sig": same("name_sig"), "shared_token": F.size(F.filter(shared, lambda x: F.length(x) >= 3)) > 0, "name_gram3": dice(grams(q("n"), 3), grams(t("n"), 3)) >= 0.25,
        "name_gram4": name4, "addr_token": F.size(words) > 0, "addr_gram3": dice(grams(q("a"), 3), grams(t("a"), 3)) >= 0.25, "addr_gram4": dice(grams(q("a"), 4), grams(t("a"), 4)) >= 0.20, "postal": postal,
        "building": building, "number_street": building & (F.size(F.array_intersect(q("addr_tokens"), t("addr_tokens"))) > 0), "name_number": building & (some | name4), "name_country": same("country") & (some | name4),
        "name_postal": postal & (some | name4), "same_country": (q("country") == "") | (t("country") == "") | (q("country") == t("country")), "either_way": same("compact") | same("addr_sig") | same("a"),
        "strict": same("n") | same("a") | same("name_sig") | same("addr_sig"),
    }
    return joined.select(*PAIR, *[flags[r].alias(r) for r in RULES])


def rule_report(flags: DataFrame) -> DataFrame:
    """Per rule: share of the pairs it finds, and pairs that no other rule finds."""
    n = sum(F.col(r).cast("int") for r in RULES)
    sums = flags.agg(F.count("*").alias("n"), *[F.sum(F.col(r).cast("int")).alias(f"{r}_found") for r in RULES], *[F.sum((F.col(r) & (n == 1)).cast("int")).alias(f"{r}_alone") for r in RULES])
    rows = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"{r}_found").alias("found"), F.col(f"{r}_alone").alias("alone")) for r in RULES]))
    return sums.select("n", rows.alias("r")).select("r.rule", "r.found", "r.alone", F.round(F.col("r.found") / F.col("n"), 6).alias("recall"))


#: Steps of the removal waterfall: after each, pairs that only the named rules found are lost.
STEPS = (("all", ()), ("address grams", ("addr_gram3", "addr_gram4")), ("name grams", ("name_gram3", "name_gram4")), ("composites", ("number_street", "name_number", "name_country", "name_postal")))


def removal_waterfall(flags: DataFrame) -> DataFrame:
    """(step, name, found, lost): pairs still found as groups of rules are taken away one after the other."""
    gone: set[str] = {"same_country", "strict"}
    sums = []
    for i, (name, rules) in enumerate(STEPS):
        gone |= set(rules)
        left = [F.col(r) for r in RULES if r not in gone]
        found = left[0]
        for c in left[1:]:
            found = found | c
        sums.append(F.struct(F.lit(i).alias("step"), F.lit(name).alias("name"), F.count_if(found).alias("found")))
    rows = flags.agg(F.array(*sums).alias("a")).select(F.posexplode("a").alias("i", "s"), "a")
    before = F.when(F.col("i") == 0, F.col("s.found")).otherwise(F.get("a", F.col("i") - 1)["found"])
    return rows.select("s.step", "s.name", "s.found", (before - F.col("s.found")).alias("lost"))


def route_matrix(pairs: DataFrame, truth: DataFrame, routes: tuple[str, ...]) -> DataFrame:
    """One 0/1 column per route for every true pair, and how many routes find it."""
    j = truth.join(pairs.select(*PAIR, "routes"), PAIR, "left").withColumn("routes", F.coalesce("routes", F.array().cast("array<string>")))
    return j.select(*PAIR, *[F.array_contains("routes", r).cast("int").alias(r) for r in routes], F.size("routes").alias("n_routes"))


def operating_points(pairs: DataFrame, truth: DataFrame, points: dict[str, tuple[str, ...]]) -> DataFrame:
    """Per named union of routes: pairs, true pairs found and recall, in one pass over the pairs."""
    j = truth.select(*PAIR, F.lit(1).alias("t")).join(pairs, PAIR, "full")
    has = {name: F.arrays_overlap("routes", F.array(*map(F.lit, rs))) for name, rs in points.items()}
    sums = [F.struct(F.lit(n).alias("point"), F.count_if(c).alias("volume"), F.count_if(c & F.col("t").isNotNull()).alias("found"), F.count("t").alias("n_true")) for n, c in has.items()]
    rows = j.agg(F.array(*sums).alias("a")).select(F.explode("a").alias("p"))
    return rows.select("p.point", "p.volume", "p.found", F.round(F.when(F.col("p.n_true") == 0, 1.0).otherwise(F.col("p.found") / F.col("p.n_true")), 6).alias("recall"))


def route_algebra(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """How many pairs route a finds, route b, both, either, and one without the other."""
    x, y = F.array_contains("routes", a), F.array_contains("routes", b)
    return pairs.agg(*[F.count_if(c).alias(k) for k, c in {"in_a": x, "in_b": y, "in_both": x & y, "in_either": x | y, "a_only": x & ~y, "b_only": y & ~x}.items()])


def route_report(hits: DataFrame, truth: DataFrame, n_queries: int, n_targets: int) -> DataFrame:
    """Per route: pairs, reduction ratio, recall of all true pairs and of each source's, pairs per query."""
    totals = truth.agg(F.count("*").alias("n"), F.count_if(F.col("target_id").startswith("S2-")).alias("n2"), F.count_if(F.col("target_id").startswith("S3-")).alias("n3"))
    j = hits.distinct().join(truth.select(*PAIR, F.lit(1).alias("t")), PAIR, "left")
    true = F.col("t").isNotNull()
    per = j.groupBy("route").agg(F.count("*").alias("volume"), F.count("t").alias("f"), F.count_if(true & F.col("target_id").startswith("S2-")).alias("f2"), F.count_if(true & F.col("target_id").startswith("S3-")).alias("f3"))
    share = lambda a, b: F.round(F.when(F.col(b) == 0, 1.0).otherwise(F.col(a) / F.col(b)), 6)
    return per.crossJoin(F.broadcast(totals)).select(
        "route", "volume", F.round(1 - F.col("volume") / (float(n_queries) * n_targets), 9).alias("reduction"), share("f", "n").alias("recall"), share("f2", "n2").alias("recall_s2"), share("f3", "n3").alias("recall_s3"),
        F.round(F.col("volume") / n_queries, 6).alias("per_query"),
    )
