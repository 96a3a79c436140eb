"""Splits, negatives and samples: deterministic by hash, so that reruns agree whatever the partitioning.

Cuts by share are made in two steps: a histogram of hash places per stratum finds the place where a share ends,
then each row is compared with it; only the rows of the one place in which a cut falls are ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.operators.er import PAIR


def place(seed: str, key: str = "s1_id") -> Column:
    return F.md5(F.concat(F.lit(seed), F.col(key)))


def strata(s1: DataFrame, truth: DataFrame, most: int) -> DataFrame:
    """s1_id, stratum: matches, at most `most`."""
    known = truth.groupBy("s1_id").agg(F.count("*").alias("m"))
    return s1.select("s1_id").join(known, "s1_id", "left").select("s1_id", F.least(F.coalesce("m", F.lit(0)), F.lit(most)).cast("int").alias("stratum"))


def split(rows: DataFrame, parts: list[tuple[str, float]], rest: str, seed: str) -> DataFrame:
    """Adds part to rows (s1_id, stratum): in each stratum, by hash, the first floor(n * share) are the first part, the
    next floor(n * share) the second and so on; what is left is rest."""
    h = place(seed)
    rows = rows.withColumn("_h", h).withColumn("_b", F.conv(F.substring("_h", 1, 3), 16, 10).cast("int"))
    counts = rows.groupBy("stratum", "_b").agg(F.count("*").alias("_c"))
    whole = W.partitionBy("stratum")
    counts = counts.withColumn("_n", F.sum("_c").over(whole)).withColumn("_before", F.coalesce(F.sum("_c").over(whole.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    ends, at = [], F.lit(0).cast("long")
    for _, share in parts:
        at = at + F.floor(F.col("_n") * share)
        ends.append(at)
    # a bin that no cut falls into belongs to one part as a whole
    cut = F.lit(False)
    for e in ends:
        cut = cut | ((F.col("_before") < e) & (e < F.col("_before") + F.col("_c")))
    marked = rows.join(counts.withColumn("_cut", cut), ["stratum", "_b"])

    def named(rank: Column) -> Column:
        c = F.lit(rest)
        for (name, _), e in reversed(list(zip(parts, ends, strict=True))):
            c = F.when(rank < e, F.lit(name)).otherwise(c)
        return c

    inside = marked.where("_cut").withColumn("_r", F.col("_before") + F.row_number().over(W.partitionBy("stratum", "_b").orderBy("_h", "s1_id")) - 1)
    out = marked.where("not _cut").withColumn("part", named(F.col("_before"))).drop("_cut").unionByName(inside.withColumn("part", named(F.col("_r"))).drop("_r", "_cut"))
    return out.drop("_h", "_b", "_c", "_n", "_before")


def three_way(s1: DataFrame, truth: DataFrame) -> DataFrame:
    """Strata of 0, 1, 2 and more matches: 20 % validation, 10 % mining, rest train."""
    return split(strata(s1, truth, 2), [("validation", 0.20), ("mining", 0.10)], "train", "three")


def four_strata(s1: DataFrame, truth: DataFrame) -> DataFrame:
    """Strata of 0, 1, 2, 3 and more matches: 81.6 % train, 9.2 % development, rest held out."""
    return split(strata(s1, truth, 3), [("train", 0.816), ("dev", 0.092)], "holdout", "four")


def two_samples(s1: DataFrame, n: int = 10_000, seed: str = "two") -> DataFrame:
    """The first n queries by hash, and the next n: s1_id, part."""
    first = s1.select("s1_id", place(seed).alias("_h")).orderBy("_h", "s1_id").limit(2 * n)
    first = first.withColumn("rn", F.row_number().over(W.orderBy("_h", "s1_id")))  # 2 n rows
    return first.select("s1_id", F.when(F.col("rn") <= n, "dev").otherwise("holdout").alias("part"))


def unexposed(s1: DataFrame, truth: DataFrame, exposed: DataFrame) -> DataFrame:
    """Queries not among exposed (s1_id): 15 % validation by strata, rest reserve."""
    return split(strata(s1.join(exposed.select("s1_id"), "s1_id", "left_anti"), truth, 2), [("validation", 0.15)], "reserve", "virgin")


def split_overlap(splits: DataFrame) -> DataFrame:
    """(part_a, part_b, n): ids that two parts of splits(s1_id, part) share; each part with itself gives its size."""
    a, b = splits.select("s1_id", F.col("part").alias("part_a")), splits.select("s1_id", F.col("part").alias("part_b"))
    return a.join(b, "s1_id").where("part_a <= part_b").groupBy("part_a", "part_b").agg(F.countDistinct("s1_id").alias("n"))


def negative_category(name: Column, addr: Column, n_routes: Column) -> Column:
    """Kind of a wrong candidate by name and address similarity (0 to 1); records as q and t; first rule that holds."""
    q, t = lambda c: F.col(f"q.{c}"), lambda c: F.col(f"t.{c}")
    return (
        F.when((name >= 0.85) & (addr <= 0.40), "1_high_name_wrong_address")
        .when((addr >= 0.85) & (name <= 0.40), "2_high_address_wrong_name")
        .when((name >= 0.80) & (addr >= 0.70), "3_high_name_high_address_wrong_entity")
        .when(F.arrays_overlap(q("postals"), t("postals")), "4_same_postal_wrong_entity")
        .when(q("building") == t("building"), "5_same_building_wrong_entity")
        .when(n_routes >= 2, "9_multi_route_hit_wrong_entity")
        .when(name >= 0.60, "medium_name_similarity")
        .otherwise("easy_negative")
    )


def negatives(joined: DataFrame, truth: DataFrame, name: Column, addr: Column) -> DataFrame:
    """Wrong candidates of joined (s1_id, target_id, n_routes, q, t) with category and hardness, the mean similarity."""
    wrong = joined.withColumn("_n", name).withColumn("_a", addr).join(truth.select(*PAIR), PAIR, "left_anti")
    return wrong.select(*PAIR, negative_category(F.col("_n"), F.col("_a"), F.col("n_routes")).alias("category"), F.round((F.col("_n") + F.col("_a")) / 2, 6).alias("hardness"))


def false_positive_category(name: Column, addr: Column, n_routes: Column) -> Column:
    q, t = lambda c: F.col(f"q.{c}"), lambda c: F.col(f"t.{c}")
    return (
        F.when((name >= 0.85) & (addr <= 0.35), "same_name_diff_address")
        .when((addr >= 0.85) & (name <= 0.40), "same_address_diff_name")
        .when((name >= 0.80) & (addr >= 0.70), "high_name_high_address_wrong_entity")
        .when(F.arrays_overlap(q("postals"), t("postals")), "same_postal_wrong_entity")
        .when(q("building") == t("building"), "same_building_wrong_entity")
        .when((q("a") == "") | (t("a") == ""), "missing_address_collision")
        .when(F.concat(q("name"), t("name")).rlike(r"[^\x00-\x7F]"), "multilingual_collision")
        .when(n_routes >= 2, "multi_route_collision")
        .when(name >= 0.75, "franchise_duplicate_collision")
        .otherwise("medium_collision")
    )


def mined_false_positives(joined: DataFrame, truth: DataFrame, scores: DataFrame, name: Column, addr: Column, least: float = 0.25) -> DataFrame:
    """Wrong candidates of p from least on, with category and similarities."""
    wrong = joined.withColumn("_n", name).withColumn("_a", addr).join(truth.select(*PAIR), PAIR, "left_anti").join(scores.select(*PAIR, "p").where(F.col("p") >= least), PAIR)
    return wrong.select(*PAIR, "p", F.round("_n", 6).alias("name_similarity"), F.round("_a", 6).alias("addr_similarity"), false_positive_category(F.col("_n"), F.col("_a"), F.col("n_routes")).alias("category"))


def hardest(pool: DataFrame, n: int) -> DataFrame:
    """The n hardest of pool (hardness), ties by pair: a top-k, not a sort of the whole."""
    return pool.orderBy(F.desc("hardness"), *PAIR).limit(n)


def per_category(pool: DataFrame, each: int, order: list[Column]) -> DataFrame:
    """At most `each` rows of a category by order; the window's limit acts below its shuffle."""
    w = W.partitionBy("category").orderBy(*order)
    return pool.withColumn("rn", F.row_number().over(w)).where(f"rn <= {each}").drop("rn")


def ratio_sample(pool: DataFrame, n_pos: int, ratio: int = 4, spare: int = 200) -> DataFrame:
    """ratio * n_pos negatives: of each category an equal share and `spare` of the hardest, then the hardest of those."""
    want = n_pos * ratio
    kinds = max(1, pool.select("category").distinct().count())
    return hardest(per_category(pool, want // kinds + spare, [F.desc("hardness"), *map(F.col, PAIR)]), want)


def curriculum(pool: DataFrame, n_pos: int, ratio: int, hard: float, seed: str = "mix") -> DataFrame:
    """ratio * n_pos negatives with origin: a share `hard` of the hardest, the rest spread over the categories by hash.

    hard = 1 takes only the hardest, 0 only the spread."""
    want = n_pos * ratio
    n_hard = int(want * hard)
    kinds = max(1, pool.select("category").distinct().count())
    top = hardest(pool, n_hard)
    by_hash = F.md5(F.concat(F.lit(seed), F.col("s1_id"), F.lit("|"), F.col("target_id")))
    rest = pool.join(top.select(*PAIR), PAIR, "left_anti").withColumn("_h", by_hash)
    spread = per_category(rest, (want - n_hard) // kinds + 50, [F.col("_h"), *map(F.col, PAIR)]).orderBy("_h", *PAIR).limit(want - n_hard).drop("_h")
    return top.withColumn("origin", F.lit("hard")).unionByName(spread.withColumn("origin", F.lit("spread")))


def negatives_by_routes(pairs: DataFrame, truth: DataFrame, ratio: int = 3) -> DataFrame:
    """Per query the wrong pairs of most routes and score, up to max(ratio, matches * ratio)."""
    known = truth.groupBy("s1_id").agg(F.count("*").alias("m"))
    wrong = pairs.join(truth.select(*PAIR), PAIR, "left_anti").join(known, "s1_id", "left")
    order = W.partitionBy("s1_id").orderBy(F.desc("n_routes"), F.desc("score"), "target_id")
    return wrong.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= F.greatest(F.lit(ratio), F.coalesce("m", F.lit(0)) * ratio)).select(*PAIR, "rn")


def few_negatives(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """Per query at most three wrong pairs, and no more than twice its found matches (one at least)."""
    found = pairs.join(truth.select(*PAIR), PAIR, "left_semi").groupBy("s1_id").agg(F.count("*").alias("pos"))
    wrong = pairs.join(truth.select(*PAIR), PAIR, "left_anti").join(found, "s1_id", "left")
    order = W.partitionBy("s1_id").orderBy(F.desc("n_routes"), F.desc("score"), "target_id")
    most = F.least(F.lit(3), F.greatest(F.lit(1), 2 * F.coalesce("pos", F.lit(0))))
    return wrong.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= most).select(*PAIR, "rn")


def some_of(rows: DataFrame, n: int, seed: str, keys: list[str]) -> DataFrame:
    """n rows by hash of their keys."""
    h = F.md5(F.concat_ws("|", F.lit(seed), *[F.col(k).cast("string") for k in keys]))
    return rows.withColumn("_h", h).orderBy("_h", *keys).limit(n).drop("_h")


def most_common(rows: DataFrame, column: str, n: int = 10) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(n)


def best_similar(pairs: DataFrame, similarity: str, n: int = 3) -> DataFrame:
    """The n most similar pairs of each query."""
    return pairs.withColumn("rn", F.row_number().over(W.partitionBy("s1_id").orderBy(F.desc(similarity), "target_id"))).where(f"rn <= {n}")
