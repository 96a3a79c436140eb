"""Where tables lie and how they are loaded, written and packed; driver-side paths go through Hadoop's file systems."""

from __future__ import annotations

import json
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators.audit import check_source
from lodestar.sources.tables import SOURCE_COLUMNS, parse_lists, read_tsv, write_lists

LISTS = {"matching": ("source1_entity_id", "matched_entity_ids"), "candidates": ("source1_entity_id", "candidate_entity_ids")}


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def resolve(spark: SparkSession, root: str, split: str, name: str) -> str:
    """The first of root/split/name, root/name and root/dataset/split/name that exists."""
    tried = [f"{root}/{split}/{name}", f"{root}/{name}", f"{root}/dataset/{split}/{name}"]
    for path in tried:
        if _exists(spark, path):
            return path
    raise FileNotFoundError(f"none of {tried}")


def load_source(spark: SparkSession, root: str, split: str, number: int, check: bool = True) -> DataFrame:
    """Source 1, 2 or 3 of a split, checked: columns, ids, prefix."""
    table = read_tsv(spark, resolve(spark, root, split, f"source{number}.tsv"))
    return check_source(table, f"S{number}-", f"{split}/source{number}", SOURCE_COLUMNS) if check else table


def load_truth(spark: SparkSession, root: str, split: str = "train") -> DataFrame:
    return read_tsv(spark, resolve(spark, root, split, "ground_truth.tsv"), LISTS["matching"]).toDF("s1_id", "matched_entity_ids")


def load_lists(spark: SparkSession, path: str, kind: str = "matching") -> DataFrame:
    """A result file as (s1_id, ids), unchecked."""
    rows = read_tsv(spark, path, LISTS[kind]).toDF("s1_id", "ids")
    return parse_lists(rows, "ids")


def records_of(sources: dict[int, DataFrame]) -> DataFrame:
    """The sources as one records table (id, src, seq, name, addr, country); seq: place within the source's ids by
    their number, which sorts as the files do."""
    out = None
    for number, t in sorted(sources.items()):
        seq = F.coalesce(F.regexp_extract("entity_id", r"(\d+)$", 1).try_cast("long"), F.xxhash64("entity_id"))
        one = t.select(F.col("entity_id").alias("id"), F.lit(f"S{number}").alias("src"), seq.alias("seq"), F.col("business_name").alias("name"), F.col("business_address").alias("addr"), "country")
        out = one if out is None else out.unionByName(one)
    return out


def first_rows(table: DataFrame, n: int, order: str) -> DataFrame:
    """The first n rows by a column: a top-k, not a sort of the whole."""
    return table.orderBy(order).limit(n)


def ids_in(table: DataFrame, column: str = "entity_id") -> DataFrame:
    """The distinct ids of a column, blank ones left out."""
    return table.select(F.trim(column).alias("id")).where("id <> ''").distinct()


def side_by_side(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows of two result tables by key, where line numbers would be trusted otherwise; keys of one side stay with nulls."""
    mine = b.select(key, *[F.col(c).alias(f"{c}_2") for c in b.columns if c != key])
    return a.join(mine, key, "full")


def write_matching(rows: DataFrame, out: str) -> str:
    path = f"{out}/matching_results.tsv"
    write_lists(rows.select(F.col("s1_id").alias("source1_entity_id"), "matched_entity_ids"), path, "source1_entity_id")
    return path


def write_candidates(rows: DataFrame, out: str) -> str:
    path = f"{out}/candidate_pairs.tsv"
    write_lists(rows.select(F.col("s1_id").alias("source1_entity_id"), F.col("matched_entity_ids").alias("candidate_entity_ids")), path, "source1_entity_id", "candidate_entity_ids")
    return path


def write_split(parts: DataFrame, path: str) -> None:
    """Split ids as a table (s1_id, part)."""
    parts.select("s1_id", "part").write.mode("overwrite").partitionBy("part").parquet(path)


def read_split(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("s1_id", F.col("part").cast("string").alias("part"))


def write_report(report: DataFrame, path: str, kind: str = "json") -> None:
    """A small result table as JSON lines or CSV with a header."""
    w = report.coalesce(1).write.mode("overwrite")
    w.json(path) if kind == "json" else w.option("header", True).csv(path)


def frozen(config: dict, files: dict[str, str]) -> dict:
    """What a run is pinned to: its parameters and the digests of its inputs, as one JSON-ready record."""
    import hashlib

    body = json.dumps({"config": config, "files": files}, sort_keys=True)
    return {"config": config, "files": files, "sha256": hashlib.sha256(body.encode()).hexdigest()}


def check_frozen(record: dict, config: dict, files: dict[str, str]) -> list[str]:
    """What differs from a frozen record."""
    out = [f"{k}: {record['config'].get(k)!r} became {config.get(k)!r}" for k in sorted({*record["config"], *config}) if record["config"].get(k) != config.get(k)]
    return out + [f"{k} has changed" for k in sorted({*record["files"], *files}) if record["files"].get(k) != files.get(k)]


def package(paths: list[str], out: str) -> list[str]:
    """Packs local files and folders into one zip archive; the names it holds, sorted."""
    names = []
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for root in map(Path, paths):
            if not root.exists():
                raise FileNotFoundError(root)
            for f in sorted([root] if root.is_file() else [p for p in root.rglob("*") if p.is_file()]):
                name = str(f.relative_to(root.parent))
                z.write(f, name)
                names.append(name)
    return sorted(names)
