"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

A source's target is shared out among its documents as expected copies e of each: target / source size, more
for longer documents and less for shorter ones (by `tilt`), so that size * e adds up to the target. The whole
part of e is allocated for certain; its fraction is the inclusion probability p of one more copy. Pareto
sampling ranks the documents of a source by (u / (1 - u)) / (p / (1 - p)), u uniform, and takes the smallest
ranks as long as the words wanted aren't exceeded. What is still missing then is filled by the one document, of
those not taken, whose size comes nearest to it, if it is below twice that.

Nothing ranks a whole source in one task: documents with p = 0 are decided beforehand, ranks are counted in
`bins` ordered bins per source first, and only the bin in which the wanted sum falls is ranked row by row. u
comes from a digest of seed, doc_id and text, so reruns agree. Defined results: null text has size 0, takes
nothing and counts for nothing; a source of size 0 has target 0; a null source is a source of its own, last;
rows that repeat doc_id, source and text share u and so are tied; ties go by size, then doc_id; very long texts
count whole; an empty table gives no rows; other columns are passed on by mixed_documents, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.llm.common import Scratch


@dataclass(frozen=True)
class MixConfig:
    """weights: given to the sources in code point order, repeating; share: of all sizes that the mix takes;
    most: times its size that a source may get; tilt: how far expected copies may be off their mean, as a share of
    the room that they have; bins: ordered bins of the random ranks per source."""

    weights: tuple[float, ...] = (3.0, 1.0, 2.0)
    share: float = 1.5
    most: float = 2.0
    tilt: float = 0.5
    seed: str = "mix"
    bins: int = 16_384


def source_targets(sizes: DataFrame, c: MixConfig) -> DataFrame:
    """source, source_size, n_docs, target: water-filling of the total by weight below most * size.

    Windows run over one row per source, sorted by the level at which the source is full.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in c.weights]), ((F.row_number().over(order) - 1) % len(c.weights) + 1).cast("int"))
    per = per.withColumn("w", weight).withColumn("cap", F.lit(c.most) * F.col("source_size"))
    full = W.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    seen = full.rowsBetween(W.unboundedPreceding, -1)
    per = per.withColumn("total", F.lit(c.share) * F.sum("source_size").over(W.partitionBy()))
    per = per.withColumn("above", F.coalesce(F.sum("cap").over(seen), F.lit(0.0)))
    per = per.withColumn("rest", F.sum("w").over(full.rowsBetween(0, W.unboundedFollowing)))
    per = per.withColumn("level", (F.col("total") - F.col("above")) / F.col("rest"))
    # the level of the first source that it doesn't fill; all before it are full
    per = per.withColumn("k", F.row_number().over(full)).withColumn("ok", F.col("level") * F.col("w") <= F.col("cap"))
    least = F.min(F.when(F.col("ok"), F.struct("k", "level"))).over(W.partitionBy())
    per = per.withColumn("first", least)
    target = F.when(F.col("first").isNull() | (F.col("k") < F.col("first.k")), F.col("cap")).otherwise(F.col("first.level") * F.col("w"))
    return per.select("source", "source_size", "n_docs", target.alias("target"))


KEY = ("_k1", "_k2", "_k3")


def _keyed(docs: DataFrame) -> DataFrame:
    """Adds what tells rows apart (KEY): doc_id, source and the digest of the text."""
    return docs.withColumn("_k1", F.col("doc_id")).withColumn("_k2", F.col("source")).withColumn("_k3", F.md5("text"))


def _on_key(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """a joined with b on KEY, null-safe; b's key columns go."""
    b = b.select(*[F.col(k).alias(f"{k}_") for k in KEY], *[c for c in b.columns if c not in KEY])
    on = [a[k].eqNullSafe(b[f"{k}_"]) for k in KEY]
    return a.join(b, on, how).drop(*[f"{k}_" for k in KEY])


def expected_copies(sizes: DataFrame, targets: DataFrame, c: MixConfig) -> DataFrame:
    """Adds source_size, target, whole (copies for certain) and p (probability of one more) to sizes (source, size).

    e = ratio + delta * (q - mean of q over the source's words), q = size / (size + mean size), where delta keeps
    e within 0 and `most`; so size * e adds up to the target exactly.
    """
    q = F.col("size") / (F.col("size") + F.col("source_size") / F.col("n_docs"))
    t = targets.withColumnRenamed("source", "_src")
    rows = sizes.join(t, sizes["source"].eqNullSafe(t["_src"])).drop("_src").withColumn("q", F.when(F.col("size") > 0, q).otherwise(0.0))
    middle = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("q")).alias("_q")).withColumnRenamed("source", "_src")
    rows = rows.join(middle, rows["source"].eqNullSafe(middle["_src"])).drop("_src")
    full = F.col("source_size") > 0
    ratio = F.when(full, F.col("target") / F.col("source_size")).otherwise(0.0)
    delta = c.tilt * F.greatest(F.lit(0.0), F.least(ratio, c.most - ratio))
    e = F.when(F.col("size") > 0, ratio + delta * (F.col("q") - F.col("_q") / F.col("source_size"))).otherwise(0.0)
    rows = rows.withColumn("e", F.greatest(F.lit(0.0), F.least(F.lit(float(c.most)), e)))
    return rows.withColumn("whole", F.floor("e")).withColumn("p", F.col("e") - F.floor("e")).drop("q", "_q", "e", "n_docs")


def _draw(s: Scratch, rows: DataFrame, bins: int) -> DataFrame:
    """Adds picked (0 or 1) to rows (source, size, u, whole, p, target): the draw of one more copy."""
    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
    drawn = rows.where("p > 0").withColumn("rank", odds)
    # rank / (1 + rank) spreads the ranks over (0, 1)
    drawn = drawn.withColumn("bin", F.least(F.lit(bins - 1), F.floor(bins * F.col("rank") / (1 + F.col("rank")))).cast("int"))
    certain = rows.groupBy("source").agg((F.first("target") - F.sum(F.col("size") * F.col("whole"))).alias("want")).withColumnRenamed("source", "_src")
    sums = drawn.groupBy("source", "bin").agg(F.sum("size").alias("words"))
    before = F.coalesce(F.sum("words").over(W.partitionBy("source").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("before", before).join(certain, F.col("source").eqNullSafe(F.col("_src"))).drop("_src")
    # bins before the edge are taken whole, its own rows are ranked, later ones aren't taken
    edge = sums.groupBy("source").agg(
        F.first("want").alias("want"), F.min(F.when(F.col("before") + F.col("words") > F.col("want"), F.struct("bin", "before"))).alias("at"), F.sum("words").alias("all_words")
    )
    edge = edge.select(F.col("source").alias("_src"), "want", F.coalesce("at.bin", F.lit(bins)).alias("edge"), F.coalesce("at.before", "all_words").alias("edge_before"))
    edge = s.save(edge, "edge")
    marked = drawn.join(edge, drawn["source"].eqNullSafe(edge["_src"])).drop("_src")
    order = W.partitionBy("source").orderBy("rank", "size", "doc_id", "_k3").rowsBetween(W.unboundedPreceding, 0)
    within = marked.where("bin = edge").withColumn("upto", F.sum("size").over(order) + F.col("edge_before"))
    within = within.withColumn("picked", (F.col("upto") <= F.col("want")).cast("int")).drop("upto")
    whole = marked.where("bin <> edge").withColumn("picked", (F.col("bin") < F.col("edge")).cast("int"))
    drawn = s.save(whole.unionByName(within).drop("edge", "edge_before", "bin"), "drawn")
    took = drawn.groupBy("source").agg((F.first("want") - F.sum(F.col("size") * F.col("picked"))).alias("gap")).withColumnRenamed("source", "_src")
    took = s.save(took, "gaps")
    # the last document: the one whose size is nearest to the gap, if that brings the source nearer to its target
    spare = drawn.where("picked = 0").join(took, drawn["source"].eqNullSafe(took["_src"])).where("size < 2 * gap")
    last = spare.groupBy("source").agg(F.min(F.struct(F.abs(F.col("size") - F.col("gap")).alias("off"), "rank", "doc_id", "_k3")).alias("x"))
    last = s.save(last.select(F.col("x.doc_id").alias("_k1"), F.col("source").alias("_k2"), F.col("x._k3").alias("_k3"), F.lit(1).alias("last")), "last")
    drawn = _on_key(drawn.drop("want", "rank"), last, "left")
    drawn = drawn.withColumn("picked", F.greatest("picked", F.coalesce("last", F.lit(0)))).drop("last")
    return drawn.unionByName(rows.where("p <= 0").withColumn("picked", F.lit(0)))


def mix_plan(spark: SparkSession, docs: DataFrame, config: MixConfig | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken (and KEY) for every row of docs (doc_id, text, source)."""
    c = config or MixConfig()
    s = Scratch(spark, "mix")
    size = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    keyed = _keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text")))
    digest = F.md5(F.concat_ws(":", F.lit(c.seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce("_k3", F.lit("null"))))
    u = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(2**48))
    sizes = s.save(keyed.select(*KEY, "doc_id", "source", size.alias("size"), u.alias("u")), "sizes")
    targets = s.save(source_targets(sizes, c), "targets")
    out = _draw(s, expected_copies(sizes, targets, c), c.bins)
    copies = (F.col("whole") + F.col("picked")).cast("int")
    return out.select(*KEY, "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def mixed_documents(spark: SparkSession, docs: DataFrame, config: MixConfig | None = None) -> DataFrame:
    """The rows of docs, each as often as the mix takes it (none to most times); columns of docs.

    Rows of equal key are interchangeable: each gets an equal share of their copies; where that doesn't come
    out even, which is so for one key of a source at most, the key's first row stands for all of them.
    """
    named = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    at = {n: f"c{i}" for i, n in reversed(list(enumerate(docs.columns)))}
    plan = mix_plan(spark, named.select(*[F.col(at[n]).alias(n) for n in ("doc_id", "text", "source")]), config)
    per = plan.groupBy(*KEY).agg(F.sum("copies").alias("_n"), F.count("*").alias("_rows")).where("_n > 0")
    keys = named.select("*", *[F.col(at[n]).alias(n) for n in ("doc_id", "text", "source")])
    keyed = _keyed(keys.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("source", F.col("source").cast("string")).withColumn("text", F.col("text").cast("string")))
    out = _on_key(keyed.drop("doc_id", "text", "source"), per)
    even = out.where("_n % _rows = 0").withColumn("_n", (F.col("_n") / F.col("_rows")).cast("long"))
    odd = out.where("_n % _rows <> 0").groupBy(*KEY).agg(F.min(F.struct("_n", *named.columns)).alias("x")).select("x.*")
    out = even.select("_n", *named.columns).unionByName(odd)
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n")))).select(*named.columns).toDF(*docs.columns)
