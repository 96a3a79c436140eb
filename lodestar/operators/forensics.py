"""Why pairs are lost or wrongly linked: ordered rules over pairs of records, counted or listed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.operators.er import PAIR, Decision, join_records


def _q(c: str) -> Column:
    return F.col(f"q.{c}")


def _t(c: str) -> Column:
    return F.col(f"t.{c}")


def missed_category(name: Column, addr: Column) -> Column:
    """Eleven kinds of a missed pair by similarities of 0 to 100; the first rule that holds."""
    beyond = lambda c: c.rlike(r"[^\x00-\x7F]")
    q, t = _q("n"), _t("n")
    initials = lambda short, long: (F.length(short) <= 4) & F.contains(T.initials(long), short)
    return (
        F.when((_q("name") == "") | (_t("name") == ""), "7. missing name")
        .when((_q("addr") == "") | (_t("addr") == ""), "6. missing address")
        .when(beyond(_q("name")) != beyond(_t("name")), "10. cross-script")
        .when((F.size(_q("name_tokens")) > 0) & (_q("name_sig") == _t("name_sig")), "5. word reordering")
        .when(initials(q, t) | initials(t, q), "4. abbreviation")
        .when((name >= 60) & (name < 90), "1. spelling corruption")
        .when(T.ocr_fold(q) == T.ocr_fold(t), "2. OCR corruption")
        .when((name >= 90) & (addr < 40), "8. common name")
        .when(addr >= 50, "9. address variation")
        .when((name >= 40) & (name < 60), "3. transliteration")
        .otherwise("11. other")
    )


def missed_joined(truth: DataFrame, pairs: DataFrame, parsed: DataFrame) -> DataFrame:
    return join_records(truth.select(*PAIR).join(pairs.select(*PAIR), PAIR, "left_anti"), parsed)


def missed_reasons(missed: DataFrame) -> DataFrame:
    """Missed pairs (records q, t) by the plain reasons: empty name, other country, no token shared, some shared."""
    shared = F.size(F.array_intersect(_q("name_tokens"), _t("name_tokens")))
    reason = (
        F.when((_q("n") == "") | (F.size(_t("name_tokens")) == 0), "empty_or_missing_name")
        .when((_q("country") != "") & (_t("country") != "") & (_q("country") != _t("country")), "cross_country_mismatch")
        .when(shared == 0, "zero_shared_tokens_transliteration")
        .otherwise("partial_token_overlap_unindexed")
    )
    return missed.select(*PAIR, reason.alias("reason"), F.array_join(F.array_sort(F.array_intersect(_q("name_tokens"), _t("name_tokens"))), ",").alias("shared_tokens"))


def scope_categories(missed: DataFrame) -> DataFrame:
    """Missed pairs by which field they still share a token in."""
    name, addr = F.arrays_overlap(_q("name_tokens"), _t("name_tokens")), F.arrays_overlap(_q("addr_tokens"), _t("addr_tokens"))
    kind = (
        F.when(F.trim(_t("addr")) == "", "1 target without address")
        .when(~name & ~addr, "2 nothing shared")
        .when(~name & addr, "3 address shared, name not")
        .when(name & ~addr, "4 name shared, address not")
        .otherwise("5 both shared, ranked too low")
    )
    return missed.select(*PAIR, kind.alias("category"))


def rescue(truth: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """True pairs by which of two candidate sets finds them."""
    j = truth.select(*PAIR).join(old.select(*PAIR, F.lit(True).alias("o")), PAIR, "left").join(new.select(*PAIR, F.lit(True).alias("n")), PAIR, "left").na.fill(False, ["o", "n"])
    kind = F.when(F.col("o") & F.col("n"), "both").when(F.col("n"), "rescued").when(F.col("o"), "lost").otherwise("neither")
    return j.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def without_candidates(s1: DataFrame, truth: DataFrame, pairs: DataFrame, parsed: DataFrame, similarity: Column | None = None) -> DataFrame:
    """Queries without candidates: matches, kind, and the similarity of their nearest true target (records q, t)."""
    lone = s1.select("s1_id").join(pairs.select("s1_id").distinct(), "s1_id", "left_anti")
    own = lone.join(parsed.select(F.col("id").alias("s1_id"), "name", "addr"), "s1_id", "left")
    j = join_records(lone.join(truth, "s1_id").select(*PAIR), parsed)
    nearest = j.groupBy("s1_id").agg(F.count("*").alias("n_true"), F.round(F.max(similarity if similarity is not None else F.lit(0.0)), 6).alias("nearest"))
    out = own.join(nearest, "s1_id", "left").na.fill(0, ["n_true"]).na.fill(0.0, ["nearest"])
    kind = (
        F.when(F.col("n_true") == 0, "A_True_Singleton")
        .when((F.col("addr") == "") | (F.length("name") <= 3) | ~F.col("name").rlike(r"[\p{L}\p{N}]"), "C_Systematic_Sparse_Address_Or_Script")
        .otherwise("B_True_Matched_Retrieval_Failure")
    )
    return out.select("s1_id", "n_true", kind.alias("category"), "nearest")


FUNNEL = ("1 not retrieved", "2 removed by pruning", "3 without score", "4 score too low", "5 singleton gate", "6 too far below the best", "7 beyond a source's capacity", "8 linked")


def recall_funnel(truth: DataFrame, raw: DataFrame, kept: DataFrame, scores: DataFrame, d: Decision) -> DataFrame:
    """True pairs lost at each stage from blocking to the decision, what is left after it, and its recall by source.

    raw, kept: pairs before and after pruning; the decision's stages follow the adaptive rule.
    """
    w = W.partitionBy("s1_id")
    own = F.when(F.col("target_id").startswith("S2-"), d.s2).otherwise(d.s3)
    s = scores.select(*PAIR, "p").withColumn("top", F.max("p").over(w))
    s = s.withColumn("src_rank", F.row_number().over(W.partitionBy("s1_id", F.substring("target_id", 1, 2)).orderBy(F.desc("p"), "target_id")))
    j = truth.select(*PAIR)
    for name, table in (("raw", raw), ("kept", kept)):
        j = j.join(table.select(*PAIR, F.lit(True).alias(name)), PAIR, "left")
    j = j.join(s, PAIR, "left")
    low = F.col("p") < F.greatest(own, F.when(F.col("p") < F.col("top"), F.lit(d.multi)).otherwise(0.0))
    stage = (
        F.when(F.col("raw").isNull(), 1)
        .when(F.col("kept").isNull(), 2)
        .when(F.col("p").isNull(), 3)
        .when(low, 4)
        .when(F.col("top") < d.min_top, 5)
        .when(F.round(F.col("top") - F.col("p"), 9) > d.max_drop, 6)
        .when((F.lit(d.per_source) > 0) & (F.col("src_rank") > d.per_source), 7)
        .otherwise(8)
    )
    j = j.withColumn("stage", stage).withColumn("s2", F.col("target_id").startswith("S2-").cast("int"))
    # eight counts a source, in one row
    after = lambda i, c: F.count_if((F.col("stage") > i) & c)
    two, three = F.col("s2") == 1, F.col("s2") == 0
    sums = [
        F.struct(F.lit(n).alias("stage"), F.count_if(F.col("stage") == i).alias("lost"), after(i, F.lit(True)).alias("left"), after(i, two).alias("a"), F.count_if(two).alias("n2"), after(i, three).alias("b"), F.count_if(three).alias("n3"), F.count("*").alias("n"))
        for i, n in enumerate(FUNNEL[:7], 1)
    ]
    rows = j.agg(F.array(*sums).alias("x")).select(F.explode("x").alias("x")).select("x.*")
    share = lambda a, b: F.round(F.when(F.col(b) == 0, 1.0).otherwise(F.col(a) / F.col(b)), 6)
    return rows.select("stage", "lost", "left", share("left", "n").alias("recall"), share("a", "n2").alias("recall_s2"), share("b", "n3").alias("recall_s3"))


def error_samples(truth: DataFrame, picks: DataFrame, pairs: DataFrame, scores: DataFrame, threshold: float, n: int = 100) -> DataFrame:
    """n false links and n missed ones by hash, with p and the reason."""
    from lodestar.operators.sampling import some_of

    p = scores.select(*PAIR, "p")
    wrong = some_of(picks.select(*PAIR).join(truth.select(*PAIR), PAIR, "left_anti"), n, "fp", PAIR).withColumn("kind", F.lit("false link"))
    lost = some_of(truth.select(*PAIR).join(picks.select(*PAIR), PAIR, "left_anti"), n, "fn", PAIR).withColumn("kind", F.lit("missed"))
    both = wrong.unionByName(lost).join(p, PAIR, "left").join(pairs.select(*PAIR, F.lit(True).alias("got")), PAIR, "left")
    reason = F.when(F.col("kind") == "false link", "scored from the threshold on").when(F.col("got").isNull(), "no candidate").when(F.col("p") < threshold, "scored below the threshold").otherwise("left out by the decision")
    return both.select(*PAIR, "kind", "p", reason.alias("reason"))
