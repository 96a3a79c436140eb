"""Tab-separated sources and sinks, schema findings, profiles and list-file validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SOURCE_COLUMNS = ("entity_id", "business_name", "business_address", "country")


def read_tsv(spark: SparkSession, path: str, columns: tuple[str, ...] = SOURCE_COLUMNS) -> DataFrame:
    """All-string table with exactly these columns; empty fields are empty strings, a wrong header raises."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    got = spark.read.option("sep", "\t").option("header", True).option("encoding", "UTF-8").option("enforceSchema", False).schema(schema).csv(path)
    return got.na.fill("")


def parse_lists(table: DataFrame, column: str = "matched_entity_ids") -> DataFrame:
    """The comma list of column as an array of trimmed, non-empty ids."""
    return table.withColumn(column, F.filter(F.transform(F.split(F.coalesce(column, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != ""))


def write_lists(rows: DataFrame, path: str, key: str = "s1_id", column: str = "matched_entity_ids") -> None:
    """One tab-separated file set, sorted by key within and across files."""
    rows.orderBy(key).write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", "").option("emptyValue", "").csv(path)


def profile(table: DataFrame, columns: list[str], by: str, measured: str = "name") -> DataFrame:
    """Rows, distinct and blank values per column and lengths of one column, by group."""
    n = F.length(measured)
    return table.groupBy(by).agg(
        F.count("*").alias("n_rows"),
        *[F.countDistinct(c).alias(f"distinct_{c}") for c in columns],
        *[F.count_if(F.trim(F.coalesce(c, F.lit(""))) == "").alias(f"blank_{c}") for c in columns],
        F.round(F.avg(n), 6).alias(f"mean_{measured}"),
        F.percentile(n, 0.5).alias(f"median_{measured}"),
        F.round(F.percentile(n, 0.95), 6).alias(f"p95_{measured}"),
        F.max(n).alias(f"max_{measured}"),
    )


def source_findings(table: DataFrame, prefixes: set[str]) -> DataFrame:
    """(category, n): blank ids, ids without one of the prefixes, ids that repeat."""
    blank = F.trim(F.coalesce("entity_id", F.lit(""))) == ""
    bad = ~F.substring("entity_id", 1, 2).isin(sorted(prefixes)) & ~blank
    checks = table.agg(F.count_if(blank).alias("blank_id"), F.count_if(bad).alias("wrong_prefix"))
    repeats = table.groupBy("entity_id").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("repeated_id"))
    return checks.crossJoin(repeats).select(F.expr("stack(3, 'blank_id', blank_id, 'wrong_prefix', wrong_prefix, 'repeated_id', repeated_id) as (category, n)"))


def list_findings(lists: DataFrame, s1: DataFrame, targets: DataFrame) -> DataFrame:
    """(category, n) of a list table: missing and extra keys, repeated rows, repeated, foreign and unknown ids."""
    rows = parse_lists(lists)
    ids = rows.select("s1_id", F.explode("matched_entity_ids").alias("id"))
    counted = {
        "missing_key": s1.select(F.col("id").alias("s1_id")).join(rows, "s1_id", "left_anti"),
        "extra_key": rows.join(s1.select(F.col("id").alias("s1_id")), "s1_id", "left_anti"),
        "repeated_key": rows.groupBy("s1_id").count().where("count > 1"),
        "repeated_id": rows.where(F.size("matched_entity_ids") != F.size(F.array_distinct("matched_entity_ids"))),
        "self_match": ids.where("id like 'S1-%'"),
        "wrong_prefix": ids.where("not (id like 'S1-%' or id like 'S2-%' or id like 'S3-%')"),
        "unknown_id": ids.join(targets.select("id"), "id", "left_anti"),
    }
    out = None
    for name, d in counted.items():
        one = d.agg(F.count("*").alias("n")).select(F.lit(name).alias("category"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def subset_violations(matching: DataFrame, candidates: DataFrame) -> DataFrame:
    """Matches that aren't candidates: (s1_id, target_id)."""
    return matching.select("s1_id", "target_id").join(candidates.select("s1_id", "target_id"), ["s1_id", "target_id"], "left_anti")


def id_fingerprint(table: DataFrame, column: str, by: str) -> DataFrame:
    """SHA-256 of the sorted ids of each group, one per line: for id sets that fit a driver's report."""
    return table.groupBy(by).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list(column)), "\n"), 256).alias("sha256"))


def append_run(run: DataFrame, path: str) -> None:
    """Adds the rows of one run to the history table at path; runs may differ in their columns."""
    run.withColumn("recorded_at", F.current_timestamp()).write.mode("append").parquet(path)


def run_history(spark: SparkSession, path: str) -> DataFrame:
    """All runs recorded at path; a column that a run lacked is null there."""
    return spark.read.option("mergeSchema", True).parquet(path)


def markdown(report: DataFrame) -> DataFrame:
    """The rows of a small report as lines of a Markdown table (line_no, line), in the report's order.

    For aggregates only: the lines are numbered on the driver.
    """
    cells = [" | ".join("" if v is None else str(v).replace("|", "\\|").replace("\n", " ") for v in row) for row in report.collect()]
    lines = [" | ".join(report.columns), "|".join("-" for _ in report.columns), *cells]
    return report.sparkSession.createDataFrame([(i, f"|{x}|") for i, x in enumerate(lines)], "line_no int, line string")
