"""The full feature sets of pairs: built-in expressions, and one Arrow pass per field for the string similarities.

Joined rows hold both records as structs q and t (parsed), and routes, n_routes; retrieval adds rank and score.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lodestar.functions import fuzzy
from lodestar.functions import text as T
from lodestar.operators.er import PAIR, grams3, jaccard, levenshtein_similarity, overlap

# The names and the order of the columns that models are given.
PAIR_COLUMNS = (
    "name_exact_raw name_exact_norm name_fuzz_ratio name_fuzz_wratio name_fuzz_token_sort name_fuzz_token_set name_fuzz_partial_ratio name_levenshtein_sim name_jaccard_token name_overlap_token "
    "name_char_ngram_jaccard name_token_count_diff name_len_ratio addr_exact_raw addr_exact_norm addr_fuzz_ratio addr_fuzz_wratio addr_fuzz_token_sort addr_fuzz_token_set addr_fuzz_partial_ratio "
    "addr_levenshtein_sim addr_jaccard_token addr_overlap_token addr_char_ngram_jaccard addr_token_count_diff addr_len_ratio country_exact_match country_mismatch postal_exact_match building_exact_match "
    "numeric_token_overlap numeric_token_exact_match s1_has_address target_has_address both_have_address target_is_s2 exact_name_hit exact_address_hit name_token_hit address_token_hit rare_token_hit "
    "postal_numeric_hit cross_field_hit name_tfidf_hit address_tfidf_hit route_hit_count name_x_addr_wratio name_high_addr_high name_high_addr_low name_low_addr_high both_fields_present"
).split()
WIDE_COLUMNS = (
    "name_ratio name_token_sort name_token_set name_partial name_wratio name_lev_sim name_jaro_winkler name_jaccard_tok name_overlap_tok name_containment name_char3_jaccard name_char4_jaccard name_len_ratio "
    "core_name_ratio core_name_token_set first_word_match addr_ratio addr_token_sort addr_token_set addr_partial addr_wratio addr_lev_sim addr_jaro_winkler addr_jaccard_tok addr_overlap_tok addr_containment "
    "addr_char3_jaccard addr_char4_jaccard addr_len_ratio country_match country_mismatch postal_match building_match numeric_jaccard numeric_exact both_have_addr target_is_s2 route_hit_count has_exact_name "
    "has_compact_name has_core_name has_name_sig has_rare_token has_num_street has_name_num has_name_postal has_postal has_building has_exact_addr has_phonetic name_x_addr name_high_addr_high "
    "name_high_addr_low ctx_cand_rank ctx_score_gap ctx_cand_count"
).split()
#: Which route stands behind which hit flag.
HITS = {
    "exact_name_hit": "exact_name", "exact_address_hit": "exact_addr", "name_token_hit": "name_sig", "address_token_hit": "addr_sig", "rare_token_hit": "rare_token", "postal_numeric_hit": "postal",
    "cross_field_hit": "building", "name_tfidf_hit": "name_tfidf", "address_tfidf_hit": "addr_tfidf",
}
SIMILARITIES = {"ratio": fuzzy.ratio, "wratio": fuzzy.weighted_ratio, "token_sort": fuzzy.token_sort_ratio, "token_set": fuzzy.token_set_ratio, "partial": fuzzy.partial_ratio, "jaro": fuzzy.jaro_winkler}


@F.pandas_udf(StructType([StructField(k, DoubleType()) for k in SIMILARITIES]))
def similarities(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """All string similarities of a pair in one pass; each distinct pair of a batch is compared once. Both empty: 0."""
    memo: dict[tuple[str, str], tuple[float, ...]] = {}
    out = []
    for pair in zip(a.fillna(""), b.fillna(""), strict=True):
        if pair not in memo:
            memo[pair] = tuple(f(*pair) if pair != ("", "") else 0.0 for f in SIMILARITIES.values())
        out.append(memo[pair])
    return pd.DataFrame(out, columns=list(SIMILARITIES), dtype="float64")


def _flag(c: Column) -> Column:
    return F.when(c, 1.0).otherwise(0.0)


def _q(c: str) -> Column:
    return F.col(f"q.{c}")


def _t(c: str) -> Column:
    return F.col(f"t.{c}")


def _numbers(side) -> Column:
    return F.array_distinct(T.numbers(side("addr")))


def _structure(match: str) -> dict[str, Column]:
    a, b = _numbers(_q), _numbers(_t)
    known = (_q("country") != "") & (_t("country") != "")
    return {
        match: _flag(known & (_q("country") == _t("country"))), "country_mismatch": _flag(known & (_q("country") != _t("country"))), "postal": _flag(F.arrays_overlap(_q("postals"), _t("postals"))),
        "building": _flag(_q("building") == _t("building")), "numbers": jaccard(a, b), "same_numbers": _flag((F.size(a) > 0) & (F.array_sort(a) == F.array_sort(b))), "s1_has_address": _flag(_q("a") != ""),
        "target_has_address": _flag(_t("a") != ""), "both": _flag((_q("a") != "") & (_t("a") != "")), "target_is_s2": _flag(F.col("target_id").startswith("S2-")),
    }


def _with_similarities(joined: DataFrame, name: str, addr: str) -> DataFrame:
    return joined.withColumn("_n", similarities(_q(name), _t(name))).withColumn("_a", similarities(_q(addr), _t(addr)))


def pair_columns(joined: DataFrame) -> DataFrame:
    """PAIR_COLUMNS of every pair, rounded to six places."""
    f: dict[str, Column] = {}
    for p, c, raw, toks, s in (("name", "n", "name", "name_tokens", "_n"), ("addr", "a", "addr", "addr_tokens", "_a")):
        q, t = _q(c), _t(c)
        f[f"{p}_exact_raw"], f[f"{p}_exact_norm"] = _flag((_q(raw) == _t(raw)) & (_q(raw) != "")), _flag((q == t) & (q != ""))
        for out, key in (("fuzz_ratio", "ratio"), ("fuzz_wratio", "wratio"), ("fuzz_token_sort", "token_sort"), ("fuzz_token_set", "token_set"), ("fuzz_partial_ratio", "partial")):
            f[f"{p}_{out}"] = F.col(f"{s}.{key}")
        f[f"{p}_levenshtein_sim"], f[f"{p}_jaccard_token"], f[f"{p}_overlap_token"] = levenshtein_similarity(q, t), jaccard(_q(toks), _t(toks)), overlap(_q(toks), _t(toks))
        f[f"{p}_char_ngram_jaccard"], f[f"{p}_token_count_diff"] = jaccard(grams3(q), grams3(t)), F.abs(F.size(_q(toks)) - F.size(_t(toks))).cast("double")
        f[f"{p}_len_ratio"] = F.least(F.length(q), F.length(t)) / F.greatest(F.length(q), F.length(t), F.lit(1))
    s = _structure("country_exact_match")
    f |= {"country_exact_match": s["country_exact_match"], "country_mismatch": s["country_mismatch"], "postal_exact_match": s["postal"], "building_exact_match": s["building"], "numeric_token_overlap": s["numbers"], "numeric_token_exact_match": s["same_numbers"]}
    f |= {"s1_has_address": s["s1_has_address"], "target_has_address": s["target_has_address"], "both_have_address": s["both"], "target_is_s2": s["target_is_s2"]}
    hits = {k: _flag(F.array_contains("routes", r)) for k, r in HITS.items()}
    total = sum(hits.values(), F.lit(0.0))
    n, a = F.col("_n.wratio"), F.col("_a.wratio")
    f |= hits | {"route_hit_count": F.coalesce(F.col("n_routes").cast("double"), total), "name_x_addr_wratio": n * a, "name_high_addr_high": _flag((n >= 0.85) & (a >= 0.85)), "name_high_addr_low": _flag((n >= 0.85) & (a <= 0.40))}
    f |= {"name_low_addr_high": _flag((n <= 0.40) & (a >= 0.85)), "both_fields_present": _flag((_q("n") != "") & (_q("a") != "") & (_t("n") != "") & (_t("a") != ""))}
    return _with_similarities(joined, "n", "a").select(*PAIR, *[F.round(f[k], 6).alias(k) for k in PAIR_COLUMNS])


def wide_columns(joined: DataFrame) -> DataFrame:
    """WIDE_COLUMNS of every retrieved pair (rank, score), rounded to six places."""
    f: dict[str, Column] = {}
    one = F.lit(1.0)
    for p, c, toks, s, least in (("name", "n", "name_tokens", "_n", 4), ("addr", "a", "addr_tokens", "_a", 5)):
        q, t = _q(c), _t(c)
        both = (q != "") & (t != "") if p == "addr" else F.lit(True)
        guard = lambda x, both=both: F.when(both, x).otherwise(0.0)
        for out, key in (("ratio", "ratio"), ("token_sort", "token_sort"), ("token_set", "token_set"), ("partial", "partial"), ("wratio", "wratio"), ("jaro_winkler", "jaro")):
            f[f"{p}_{out}"] = guard(F.col(f"{s}.{key}"))
        long, short = F.greatest(F.length(q), F.length(t)), F.least(F.length(q), F.length(t))
        f[f"{p}_lev_sim"] = guard(F.when(long == 0, one).otherwise(1 - F.levenshtein(q, t) / long))
        f[f"{p}_jaccard_tok"], f[f"{p}_overlap_tok"] = guard(jaccard(_q(toks), _t(toks))), guard(overlap(_q(toks), _t(toks)))
        f[f"{p}_containment"], f[f"{p}_len_ratio"] = guard(_flag((short >= least) & (q.contains(t) | t.contains(q)))), guard(F.when(long == 0, one).otherwise(short / long))
    grams = lambda side, k: F.array_distinct(T.key_ngrams(side("core"), k))
    f |= {f"name_char{k}_jaccard": jaccard(grams(_q, k), grams(_t, k)) for k in (3, 4)} | {f"addr_char{k}_jaccard": f["addr_jaccard_tok"] for k in (3, 4)}
    first = lambda side: F.substring_index(side("n"), " ", 1)
    f |= {"core_name_ratio": F.col("_c.ratio"), "core_name_token_set": F.col("_c.token_set"), "first_word_match": _flag((first(_q) != "") & (first(_q) == first(_t)))}
    s = _structure("country_match")
    f |= {"country_match": s["country_match"], "country_mismatch": s["country_mismatch"], "postal_match": s["postal"], "building_match": s["building"], "numeric_jaccard": s["numbers"], "numeric_exact": s["same_numbers"], "both_have_addr": s["both"], "target_is_s2": s["target_is_s2"]}
    f |= {"route_hit_count": F.col("n_routes").cast("double")} | {k: _flag(F.array_contains("routes", k.removeprefix("has_"))) for k in WIDE_COLUMNS if k.startswith("has_")}
    n, a = f["name_wratio"], f["addr_wratio"]
    f |= {"name_x_addr": n * a, "name_high_addr_high": _flag((n >= 0.85) & (a >= 0.85)), "name_high_addr_low": _flag((n >= 0.85) & (a <= 0.30))}
    whole = W.partitionBy("s1_id")
    ranked = joined.withColumn("_gap", F.max("score").over(whole) - F.col("score")).withColumn("_count", F.count("*").over(whole))
    f |= {"ctx_cand_rank": F.col("rank").cast("double"), "ctx_score_gap": F.col("_gap"), "ctx_cand_count": F.col("_count").cast("double")}
    rows = _with_similarities(ranked, "n", "a").withColumn("_c", similarities(_q("core"), _t("core")))
    return rows.select(*PAIR, *[F.round(f[k], 6).alias(k) for k in WIDE_COLUMNS])


def rough_score(joined: DataFrame) -> DataFrame:
    """scores(s1_id, target_id, p): 0.6 of the weighted ratio of names and 0.4 of that of addresses."""
    rows = _with_similarities(joined, "n", "a")
    return rows.select(*PAIR, F.round(0.6 * F.col("_n.wratio") + 0.4 * F.col("_a.wratio"), 6).alias("p"))


def contextual(features: DataFrame, joined: DataFrame, scores: DataFrame) -> DataFrame:
    """Fourteen features of a pair among the others of its query and of its target; scores: preliminary p."""
    agree = lambda a, b, same: F.when(a & b, F.when(same, 1.0).otherwise(-1.0)).otherwise(0.0)
    some = lambda side: F.size(side("postals")) > 0
    own = joined.select(
        *PAIR, F.size(F.array_intersect(_q("name_tokens"), _t("name_tokens"))).cast("double").alias("context_rare_tok_overlap"), agree(some(_q), some(_t), F.arrays_overlap(_q("postals"), _t("postals"))).alias("context_postal_compat"),
        agree(_q("building").isNotNull(), _t("building").isNotNull(), _q("building") == _t("building")).alias("context_bldg_compat"),
    )
    q, t = W.partitionBy("s1_id"), W.partitionBy("target_id")
    s = scores.select(
        *PAIR, F.row_number().over(q.orderBy(F.desc("p"), "target_id")).cast("double").alias("context_cand_rank"), F.round(F.max("p").over(q) - F.col("p"), 6).alias("context_score_gap_top"),
        F.count("*").over(q).cast("double").alias("context_cand_density"), F.count("*").over(t).cast("double").alias("context_target_freq"), F.row_number().over(t.orderBy(F.desc("p"), "s1_id")).cast("double").alias("context_target_side_rank"),
    )
    near = lambda c: F.when(F.col(c) > 0.85, 1.0).otherwise(2.0)
    f = features.select(
        *PAIR, near("name_fuzz_wratio").alias("context_name_rank"), near("addr_fuzz_wratio").alias("context_addr_rank"), F.col("route_hit_count").alias("context_route_count"), F.col("name_char_ngram_jaccard").alias("context_char_sim"),
        F.col("addr_char_ngram_jaccard").alias("context_addr_char_sim"), F.col("name_x_addr_wratio").alias("context_name_addr_interaction"),
    )
    out = f.join(own, PAIR).join(s, PAIR, "left")
    return out.na.fill(999.0, ["context_cand_rank", "context_target_side_rank"]).na.fill(0.0, ["context_score_gap_top", "context_cand_density", "context_target_freq"])
