"""Audits and reports: small tables of findings, computed in one pass over what they judge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.operators.er import PAIR


def blank(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c), F.lit(""))) == ""


def require_columns(table: DataFrame, columns: tuple[str, ...], name: str) -> None:
    """Raises if the table hasn't exactly these columns, whatever their order."""
    if sorted(table.columns) != sorted(columns):
        raise ValueError(f"{name}: columns {table.columns} instead of {list(columns)}")


def source_errors(table: DataFrame, prefix: str, name: str, allow_empty: bool = False) -> list[str]:
    """What is wrong with a source table (entity_id, ...): no rows, blank, foreign or repeated ids, with up to five of them."""
    found = []
    n, blanks, foreign = table.agg(F.count("*"), F.count_if(blank("entity_id")), F.count_if(~blank("entity_id") & ~F.col("entity_id").startswith(prefix))).first()
    if not n and not allow_empty:
        found.append(f"{name}: no rows")
    if blanks:
        found.append(f"{name}: {blanks} blank ids")
    if foreign:
        some = [r[0] for r in table.where(~blank("entity_id") & ~F.col("entity_id").startswith(prefix)).select("entity_id").orderBy("entity_id").limit(5).collect()]
        found.append(f"{name}: {foreign} ids without prefix {prefix}, as {some}")
    repeats = [r[0] for r in table.groupBy("entity_id").count().where("count > 1").select("entity_id").orderBy("entity_id").limit(5).collect()]
    if repeats:
        found.append(f"{name}: repeated ids, as {repeats}")
    return found


def check_source(table: DataFrame, prefix: str, name: str, columns: tuple[str, ...], allow_empty: bool = False) -> DataFrame:
    """The table itself; raises ValueError with all that is wrong with it."""
    require_columns(table, columns, name)
    found = source_errors(table, prefix, name, allow_empty)
    if found:
        raise ValueError("; ".join(found))
    return table


def truth_findings(lists: DataFrame, s1: DataFrame | None = None, targets: DataFrame | None = None) -> DataFrame:
    """(category, n) of a truth table (s1_id, matched_entity_ids): the rules that it must keep, zeros included."""
    from lodestar.sources.tables import parse_lists

    rows = parse_lists(lists)
    a = F.col("matched_entity_ids")
    counted = rows.agg(
        F.count_if(~F.coalesce(F.col("s1_id").startswith("S1-"), F.lit(False))).alias("wrong_key"),
        F.count_if(F.size(a) != F.size(F.array_distinct(a))).alias("repeated_in_list"),
        F.count_if(F.exists(a, lambda x: x.startswith("S1-"))).alias("query_in_list"),
        F.count_if(F.exists(a, lambda x: ~(x.startswith("S1-") | x.startswith("S2-") | x.startswith("S3-")))).alias("foreign_in_list"),
    )
    counted = counted.crossJoin(rows.groupBy("s1_id").count().agg(F.count_if(F.col("count") > 1).alias("repeated_key")))
    if s1 is not None:
        counted = counted.crossJoin(rows.select("s1_id").join(s1.select("s1_id"), "s1_id", "left_anti").agg(F.count("*").alias("unknown_key")))
    if targets is not None:
        ids = rows.select(F.explode(a).alias("id"))
        counted = counted.crossJoin(ids.join(targets.select("id"), "id", "left_anti").agg(F.count("*").alias("unknown_id")))
    return counted.select(F.explode(F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).alias("n")) for c in counted.columns])).alias("x")).select("x.*")


def table_audit(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Rows, columns, distinct ids, repeats and blank ids of each table; tables: name -> (table, id column)."""
    out = None
    for name, (t, key) in tables.items():
        one = t.agg(F.lit(name).alias("name"), F.count("*").alias("n_rows"), F.lit(len(t.columns)).alias("n_columns"), F.countDistinct(key).alias("n_ids"), F.count_if(blank(key)).alias("blank_ids"))
        one = one.withColumn("repeats", F.col("n_rows") - F.col("n_ids"))
        out = one if out is None else out.unionByName(one)
    return out


def truth_audit(s1: DataFrame, truth: DataFrame) -> DataFrame:
    """How many queries have none, one or more matches; the most; all pairs."""
    n = s1.select("s1_id").join(truth.groupBy("s1_id").agg(F.count("*").alias("m")), "s1_id", "left").na.fill(0, ["m"])
    return n.agg(F.count_if(F.col("m") == 0).alias("none"), F.count_if(F.col("m") == 1).alias("one"), F.count_if(F.col("m") > 1).alias("more"), F.max("m").alias("most"), F.sum("m").alias("pairs"))


def match_counts(s1: DataFrame, truth: DataFrame) -> DataFrame:
    n = s1.select("s1_id").join(truth.groupBy("s1_id").agg(F.count("*").alias("m")), "s1_id", "left").na.fill(0, ["m"])
    return n.groupBy("m").agg(F.count("*").alias("n"))


def top_countries(records: DataFrame, n: int = 10) -> DataFrame:
    """The n most frequent countries of each source, and their share."""
    per = records.groupBy("src", "country").agg(F.count("*").alias("n"))
    rank = F.row_number().over(W.partitionBy("src").orderBy(F.desc("n"), "country"))
    per = per.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy("src")), 6)).withColumn("rank", rank)
    return per.where(f"rank <= {n}")


def distribution(records: DataFrame, by: str) -> DataFrame:
    """Per group: rows, lengths of names, share of missing addresses, of names beyond ASCII and of accented ones."""
    n = F.length("name")
    share = lambda c, name: F.round(F.avg(c.cast("double")), 6).alias(name)
    return records.groupBy(by).agg(
        F.count("*").alias("n"), F.round(F.avg(n), 6).alias("mean_length"), F.percentile(n, 0.5).alias("median_length"), F.round(F.percentile(n, 0.95), 6).alias("p95_length"), F.max(n).cast("long").alias("max_length"),
        share(blank("addr"), "no_address"), share(F.col("name").rlike(r"[^\x00-\x7F]"), "beyond_ascii"), share(F.lower("name").rlike("[éèêëàâäîïôöùûüçñ]"), "accented"), F.countDistinct("country").alias("countries"),
    )


def risk(profile: DataFrame, base: str, other: str, by: str, tolerance: float = 0.05) -> DataFrame:
    """Each measure of two groups of a distribution, their difference, and whether it is beyond tolerance."""
    measures = [c for c in profile.columns if c not in (by, "n", "countries")]
    pick = lambda g: profile.where(F.col(by) == g).select(F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias(g)) for c in measures])).alias("x")).select("x.*")
    j = pick(base).join(pick(other), "measure")
    apart = F.abs(F.col(base) - F.col(other)) / F.greatest(F.abs(F.col(base)), F.lit(1.0))
    return j.select("measure", F.col(base).alias("base"), F.col(other).alias("other"), F.round(apart, 6).alias("apart"), F.when(apart > tolerance, "RISK").otherwise("OK").alias("status"))


def feature_quality(features: DataFrame) -> DataFrame:
    """Per feature: share of missing and of infinite values, least, most, mean, deviation, and whether it is constant."""
    names = [c for c in features.columns if c not in PAIR]
    long = features.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in names])).alias("x")).select("x.feature", "x.v")
    bad = F.col("v").isNull() | F.isnan("v")
    endless = F.abs("v") == float("inf")
    fine = F.when(~bad & ~endless, F.col("v"))
    return long.groupBy("feature").agg(
        F.round(F.avg(bad.cast("double")), 6).alias("missing"), F.round(F.avg(F.coalesce(endless, F.lit(False)).cast("double")), 6).alias("infinite"), F.min(fine).alias("least"), F.max(fine).alias("most"),
        F.round(F.avg(fine), 6).alias("mean"), F.round(F.stddev_samp(fine), 6).alias("deviation"), (F.min(fine) == F.max(fine)).alias("constant"),
    )


def consistency(reported: DataFrame, computed: DataFrame, key: str, measures: list[str], tolerance: float = 1e-6) -> DataFrame:
    """(key, measure, reported, computed, status): PASS where both agree within tolerance, else MISMATCH."""
    melt = lambda d, name: d.select(key, F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias(name)) for m in measures])).alias("x")).select(key, "x.*")
    j = melt(reported, "reported").join(melt(computed, "computed"), [key, "measure"], "full")
    same = F.abs(F.col("reported") - F.col("computed")) <= tolerance
    return j.withColumn("status", F.when(F.coalesce(same, F.lit(False)), "PASS").otherwise("MISMATCH"))


def determinism(first: DataFrame, second: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """How many pairs only one of two runs has, and how many have p apart by more than tolerance."""
    j = first.select(*PAIR, F.col("p").alias("a")).join(second.select(*PAIR, F.col("p").alias("b")), PAIR, "full")
    return j.agg(F.count_if(F.col("b").isNull()).alias("only_first"), F.count_if(F.col("a").isNull()).alias("only_second"), F.count_if(F.abs(F.col("a") - F.col("b")) > tolerance).alias("apart"))


def invariants(s1: DataFrame, targets: DataFrame, lists: DataFrame, candidates: DataFrame) -> DataFrame:
    """(invariant, violations) of a finished result: lists (s1_id, matched_entity_ids), candidates (s1_id, target_id)."""
    from lodestar.sources.tables import parse_lists, subset_violations

    rows = parse_lists(lists)
    ids = rows.select("s1_id", F.explode("matched_entity_ids").alias("target_id"))
    a = F.col("matched_entity_ids")
    again = parse_lists(rows.select("s1_id", F.array_join(a, ",").alias("matched_entity_ids")))
    counted = {
        "A every query has a row": s1.select("s1_id").join(rows, "s1_id", "left_anti"),
        "B no other rows": rows.join(s1.select("s1_id"), "s1_id", "left_anti"),
        "C one row per query": rows.groupBy("s1_id").count().where("count > 1"),
        "D no id twice in a list": rows.where(F.size(a) != F.size(F.array_distinct(a))),
        "E every id exists": ids.join(targets.select(F.col("id").alias("target_id")), "target_id", "left_anti"),
        "F only ids of targets": ids.where("not (target_id like 'S2-%' or target_id like 'S3-%')"),
        "G every match is a candidate": subset_violations(ids, candidates),
        "H candidates exist": candidates.select("target_id").join(targets.select(F.col("id").alias("target_id")), "target_id", "left_anti"),
        "I lists read back": rows.select("s1_id", a.alias("x")).join(again, "s1_id").where(F.col("x") != a),
    }
    out = None
    for name, d in counted.items():
        one = d.agg(F.count("*").alias("violations")).select(F.lit(name).alias("invariant"), "violations")
        out = one if out is None else out.unionByName(one)
    return out


def list_file_findings(spark: SparkSession, path: str, s1: DataFrame, targets: DataFrame | None = None, header: tuple[str, str] = ("source1_entity_id", "matched_entity_ids")) -> DataFrame:
    """(severity, category, n) of a tab-separated list file as it lies there: header, tabs, then the rules of lists."""
    from lodestar.sources.tables import list_findings

    lines = spark.read.text(path)
    want = "\t".join(header)
    shape = lines.agg(
        F.count_if(F.col("value") == want).alias("h"), F.count_if((F.col("value") != "") & ~F.col("value").contains("\t")).alias("no_tab"), F.count_if(F.col("value") == ",".join(header)).alias("comma_header"), F.count("*").alias("lines")
    )
    counted = {"empty_file": (F.col("lines") == 0).cast("long"), "wrong_header": (F.col("h") != 1).cast("long"), "comma_header": F.col("comma_header"), "row_without_tab": F.col("no_tab")}
    shape = shape.select(F.explode(F.array(*[F.struct(F.lit(k).alias("category"), n.alias("n")) for k, n in counted.items()])).alias("x")).select("x.*")
    parts = F.split("value", "\t", 2)
    body = lines.where((F.col("value") != want) & F.col("value").contains("\t")).select(F.trim(parts[0]).alias("s1_id"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("matched_entity_ids"))
    found = list_findings(body, s1, targets if targets is not None else body.select(F.explode(F.split("matched_entity_ids", ",")).alias("id")).select(F.trim("id").alias("id")))
    return shape.unionByName(found).select(F.when(F.col("n") == 0, "OK").otherwise("ERROR").alias("severity"), "category", "n")


def validate_files(spark: SparkSession, matching: str, candidate: str | None, s1: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Findings of both result files; a missing candidate file and matches that are no candidates are warnings."""
    from lodestar.sources.tables import parse_lists, subset_violations

    out = list_file_findings(spark, matching, s1, targets).withColumn("file", F.lit("matching"))
    if candidate is None:
        return out.unionByName(spark.createDataFrame([("WARNING", "no_file", 1, "candidate")], "severity string, category string, n long, file string"))
    names = ("source1_entity_id", "candidate_entity_ids")
    out = out.unionByName(list_file_findings(spark, candidate, s1, targets, names).withColumn("file", F.lit("candidate")))

    def pairs(path: str, head: str) -> DataFrame:
        rows = spark.read.text(path).where(F.col("value").contains("\t")).select(F.split("value", "\t", 2).alias("x")).select(F.col("x")[0].alias("s1_id"), F.col("x")[1].alias("matched_entity_ids")).where(F.col("s1_id") != head)
        return parse_lists(rows).select("s1_id", F.explode("matched_entity_ids").alias("target_id")).distinct()

    beyond = subset_violations(pairs(matching, names[0]), pairs(candidate, names[0])).agg(F.count("*").alias("n"))
    return out.unionByName(beyond.select(F.when(F.col("n") > 0, "WARNING").otherwise("OK").alias("severity"), F.lit("not_a_candidate").alias("category"), "n", F.lit("both").alias("file")))


def missing_predictions(truth_keys: DataFrame, lists: DataFrame) -> None:
    """Raises if a query of the truth has no row among the predictions: such metrics would count it as empty."""
    lost = [r[0] for r in truth_keys.select("s1_id").join(lists.select("s1_id"), "s1_id", "left_anti").orderBy("s1_id").limit(5).collect()]
    if lost:
        raise ValueError(f"no prediction for queries as {lost}")


def probability_histogram(scores: DataFrame) -> DataFrame:
    p = F.col("p")
    return scores.agg(
        F.count_if(p >= 0.8).alias("from_08"), F.count_if((p >= 0.7) & (p < 0.8)).alias("from_07"), F.count_if((p >= 0.6) & (p < 0.7)).alias("from_06"), F.count_if((p >= 0.5) & (p < 0.6)).alias("from_05"), F.count_if(p < 0.5).alias("below_05")
    )


def running_counters(s1: DataFrame, picks: DataFrame) -> DataFrame:
    """Queries with no, one and more picks, and picks by source."""
    per = picks.groupBy("s1_id").agg(F.count("*").alias("n"), F.count_if(F.col("target_id").startswith("S2-")).alias("n2"))
    j = s1.select("s1_id").join(per, "s1_id", "left").na.fill(0, ["n", "n2"])
    return j.agg(F.count_if(F.col("n") == 0).alias("zero"), F.count_if(F.col("n") == 1).alias("one"), F.count_if(F.col("n") > 1).alias("more"), F.sum("n2").alias("picks_s2"), F.sum(F.col("n") - F.col("n2")).alias("picks_s3"))


def probability_measures(scores: DataFrame, truth: DataFrame) -> DataFrame:
    """ROC-AUC, average precision (by steps) and Brier score of p, ties counted as ties.

    Pairs are first counted by distinct p, so what is accumulated in one order has a row per p (rounded to six places).
    """
    j = scores.select(*PAIR, F.round("p", 6).alias("p")).join(truth.select(*PAIR, F.lit(1).alias("y")), PAIR, "left").na.fill(0, ["y"])
    per = j.groupBy("p").agg(F.count("*").alias("n"), F.sum("y").alias("y"))
    down = W.orderBy(F.desc("p")).rowsBetween(W.unboundedPreceding, 0)
    per = per.withColumn("tp", F.sum("y").over(down)).withColumn("seen", F.sum("n").over(down))
    # of each negative, the positives ranked above it and half of those level with it
    above = (F.col("n") - F.col("y")) * (F.col("tp") - F.col("y") / 2)
    sums = per.agg(
        F.sum("n").alias("n"), F.sum("y").alias("pos"), F.sum(above).alias("area"), F.sum(F.col("y") * F.col("tp") / F.col("seen")).alias("ap"),
        F.sum(F.col("y") * (1 - F.col("p")) * (1 - F.col("p")) + (F.col("n") - F.col("y")) * F.col("p") * F.col("p")).alias("square"),
    )
    neg = F.col("n") - F.col("pos")
    return sums.select(
        F.col("n"), "pos", F.round(F.when((F.col("pos") > 0) & (neg > 0), F.col("area") / (F.col("pos") * neg)), 6).alias("roc_auc"), F.round(F.when(F.col("pos") > 0, F.col("ap") / F.col("pos")), 6).alias("average_precision"),
        F.round(F.col("square") / F.col("n"), 6).alias("brier"),
    )


def source_scores(s1: DataFrame, truth: DataFrame, picks: DataFrame, source: str) -> DataFrame:
    """The metrics with truth and picks both restricted to one source."""
    from lodestar.operators.er import entity_scores, macro_metrics

    own = lambda d: d.where(F.col("target_id").startswith(f"{source}-"))
    return macro_metrics(entity_scores(s1, own(truth), own(picks))).withColumn("source", F.lit(source))


def recall_by(truth: DataFrame, pairs: DataFrame, records: DataFrame) -> DataFrame:
    """True pairs and found ones by the query's country, and over all."""
    j = truth.join(pairs.select(*PAIR, F.lit(1).alias("hit")), PAIR, "left").join(records.select(F.col("id").alias("s1_id"), "country"), "s1_id")
    per = j.rollup("country").agg(F.count("*").alias("n_true"), F.count("hit").alias("n_found"))
    return per.select(F.coalesce("country", F.lit("all")).alias("country"), "n_true", "n_found", F.round(F.col("n_found") / F.col("n_true"), 6).alias("recall"))


PATTERNS = (
    "raw_name", "name", "name_sig", "raw_address", "address", "address_sig", "country", "postal", "building", "name_or_address", "name_and_address", "name_jaccard_half", "address_jaccard_half",
)


def truth_patterns(joined: DataFrame) -> DataFrame:
    """Thirteen agreements of true pairs (records q and t) in percent, by the target's source and over all."""
    from lodestar.operators.er import jaccard

    q, t = lambda c: F.col(f"q.{c}"), lambda c: F.col(f"t.{c}")
    same = lambda c: (q(c) == t(c)) & (q(c) != "")
    said = {
        "raw_name": same("name"), "name": same("n"), "name_sig": same("name_sig"), "raw_address": same("addr"), "address": same("a"), "address_sig": same("addr_sig"), "country": same("country"),
        "postal": F.coalesce(F.arrays_overlap(q("postals"), t("postals")), F.lit(False)), "building": F.coalesce(q("building") == t("building"), F.lit(False)), "name_or_address": same("n") | same("a"), "name_and_address": same("n") & same("a"),
        "name_jaccard_half": jaccard(q("name_tokens"), t("name_tokens")) >= 0.5, "address_jaccard_half": jaccard(q("addr_tokens"), t("addr_tokens")) >= 0.5,
    }
    rows = joined.select(F.substring("target_id", 1, 2).alias("source"), *[c.cast("double").alias(k) for k, c in said.items()])
    per = rows.rollup("source").agg(F.count("*").alias("n"), *[F.round(100 * F.avg(k), 6).alias(k) for k in PATTERNS])
    return per.withColumn("source", F.coalesce("source", F.lit("all")))
