"""Named queries over the driver's tables and the equivalent SQL.

Records: suppliers are the queries (S1), customers and parts the targets (S2, S3). A supplier's number
links it to the customer and the part of that number, which is the truth the metrics use.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import fuzzy
from lodestar.functions import text as T
from lodestar.operators import er, learn
from lodestar.sources import tables
from lodestar.sources.scratch import Scratch

CAPS = {"exact_name": 50, "name_sig": 50, "rare_token": 30, "postal": 30, "building": 20}
ALL_CAPS = CAPS | {"exact_addr": 50, "addr_sig": 50}
GATES = {"rare_token": 100}
THRESHOLDS = [round(0.20 + 0.01 * i, 2) for i in range(66)]


class Fixture(str):
    """A directory of tables in whose place the records of FIXTURE are read."""


#: id, src, seq, name, address, country: equal, reordered and abbreviated names, legal forms, address words, gaps.
FIXTURE = [
    ("S1-1", "S1", 1, "Acme Steel Works Pvt Ltd", "12 Oak St Apt 4 40001", "India"), ("S1-2", "S1", 2, "Borea & Sons Inc.", "7B Elm Rd. 50002", "USA"), ("S1-3", "S1", 3, "Cobalt Foods", "", "FR"),
    ("S1-4", "S1", 4, "Dune Textile Mills", "99 Hill Blvd 60003", ""), ("S1-5", "S1", 5, "IBM", "1 New Orchard Rd 10504", "United States"), ("S1-6", "S1", 6, "Zen1th T00ls", "5 Lake Dr 70005", "DE"),
    ("S1-7", "S1", 7, "The Company of", "3 P.O. Box 81 80006", "UK"), ("S1-8", "S1", 8, "Quiet Harbor Shipping", "14 Pier No 3 90007", "CA"), ("S1-9", "S1", 9, "Lone Star", "8 Ranch Ln 75001", "USA"),
    ("S2-1", "S2", 1, "acme steel works pvt ltd", "12 Oak Street Apartment 4 40001", "India"), ("S2-2", "S2", 2, "Sons & Borea Inc", "7b Elm Road 50002", "USA"), ("S2-3", "S2", 3, "Cobalt Fods", "22 Rue Verte 33000", "FR"),
    ("S2-4", "S2", 4, "Textile Dune Mills", "100 Hill Blvd 60003", "IN"), ("S2-5", "S2", 5, "International Business Machines", "1 New Orchard Rd 10504", "US"), ("S2-6", "S2", 6, "Zenith Tools", "5 Lake Drive 70005", "Germany"),
    ("S2-7", "S2", 7, "The Company of", "PO Box 81 80006", "GB"), ("S2-8", "S2", 8, "Harbor Fish", "", "CA"), ("S2-20", "S2", 20, "Acme Steel Works Pvt Ltd", "300 Other Ave 11111", "India"),
    ("S3-1", "S3", 1, "Acme Steel Works Private Limited", "12 Oak St 40001", "IND"), ("S3-2", "S3", 2, "Borea Sons", "7B Elm Rd 50002", "Canada"), ("S3-3", "S3", 3, "", "22 Rue Verte 33000", "FR"),
    ("S3-4", "S3", 4, "Dune Textile Mills", "", "IN"), ("S3-6", "S3", 6, "Zen1th T00ls GmbH", "5 Lake Dr 70005", "DE"), ("S3-8", "S3", 8, "Quiet Harbor Shipping Co", "Pier 3 90007", "CA"), ("S3-21", "S3", 21, "Orchard Cafe", "1 New Orchard Rd 10504", "US"),
]


class AllRoutes(str):
    """A directory of tables whose candidates come from all nine routes; plain strings take those of the SQL.

    A query makes one of its own, and its parsed records, keys, hits and pairs are written once and read back wherever they
    are used. Hits are written route by route: adaptive execution plans a whole query anew after each of its stages, so
    what one long plan leaves in the driver grows with the square of its length.
    """

    def stored(self, spark: SparkSession, name: str, *make: Callable[[], DataFrame]) -> DataFrame:
        """What all of make give, each planned and written by itself."""
        found = self.__dict__.setdefault("found", {})
        if name not in found:
            if "scratch" not in self.__dict__:
                self.scratch = Scratch(spark, "routes")
            for i, one in enumerate(make):
                found[name] = self.scratch.save(one(), name, mode="append" if i else "overwrite")
        return found[name]


def records(spark: SparkSession, d: str) -> DataFrame:
    if isinstance(d, Fixture):
        return spark.createDataFrame(FIXTURE, "id string, src string, seq long, name string, addr string, country string")
    read = lambda t: spark.read.parquet(f"{d}/{t}.parquet")
    street = lambda n, kind: F.concat(n.cast("string"), F.lit(f" Main {kind} "), (n + 10000).cast("string"))
    nine = lambda c: F.lpad(F.col(c).cast("string"), 9, "0")

    def side(t, src, key, name, n, kind, country):
        return t.select(F.concat(F.lit(f"{src}-"), F.col(key).cast("string")).alias("id"), F.lit(src).alias("src"), F.col(key).cast("long").alias("seq"), name.alias("name"), street(F.col(n), kind).alias("addr"), country.alias("country"))

    nation = lambda c: F.concat(F.lit("nation_"), F.col(c).cast("string"))
    s1 = side(read("supplier"), "S1", "s_suppkey", F.col("s_name"), "s_nationkey", "St", nation("s_nationkey"))
    s2 = side(read("customer"), "S2", "c_custkey", F.col("c_name"), "c_nationkey", "Rd", nation("c_nationkey"))
    s3 = side(read("part"), "S3", "p_partkey", F.concat(F.col("p_name"), F.lit(" Co. & Sons #"), nine("p_partkey")), "p_size", "Ave", F.lit("usa"))
    return s1.unionByName(s2).unionByName(s3)


def parsed(spark, d):
    if isinstance(d, AllRoutes):
        return d.stored(spark, "parsed", lambda: er.parse(records(spark, d)))
    return er.parse(records(spark, d))


def _keys(spark, d):
    keys = er.route_keys(parsed(spark, d))
    if isinstance(d, AllRoutes):
        keys = d.stored(spark, "keys", lambda: keys.where(F.col("route").isin(list(ALL_CAPS))))
    return keys.where("src = 'S1'"), keys.where("src <> 'S1'")


def _all_hits(spark, d):
    """Blocked hits, those of postal codes and buildings with a name token in common, and both TF-IDF searches."""
    p = parsed(spark, d)
    q, t = _keys(spark, d)
    hits = d.stored(spark, "blocked", lambda: er.blocked(q, t, ALL_CAPS, GATES))
    searched = lambda route, column: lambda: _tfidf_of(p.select("id", "src", F.col(column).alias("t"))).select(*er.PAIR, F.lit(route).alias("route"))
    return d.stored(
        spark,
        "hits",
        lambda: hits.where("route not in ('postal', 'building')"),
        lambda: er.with_residual(hits.where("route = 'postal'"), p),
        lambda: er.with_residual(hits.where("route = 'building'"), p, same_country=True),
        searched("name_tfidf", "n"),
        searched("addr_tfidf", "a"),
    )


def _hits(spark, d, *routes):
    if isinstance(d, AllRoutes):
        return _all_hits(spark, d)
    q, t = _keys(spark, d)
    return er.blocked(q, t, {r: CAPS[r] for r in routes or CAPS}, GATES)


def _truth(spark, d):
    r = records(spark, d)
    q = r.where("src = 'S1'").select(F.col("id").alias("s1_id"), "seq")
    return q.join(r.where("src <> 'S1'").select(F.col("id").alias("target_id"), "seq"), "seq").select("s1_id", "target_id")


def _s1(spark, d):
    return records(spark, d).where("src = 'S1'").select(F.col("id").alias("s1_id"))


def _pairs(spark, d):
    pairs = lambda: er.union_provenance(_hits(spark, d))
    return d.stored(spark, "pairs", pairs) if isinstance(d, AllRoutes) else pairs()


def _joined(spark, d):
    return er.join_records(_pairs(spark, d), parsed(spark, d))


def _scores(spark, d):
    j = _joined(spark, d)
    q, t = F.col("q.name_tokens"), F.col("t.name_tokens")
    p = 0.6 * er.overlap(q, t) + 0.3 * er.jaccard(F.col("q.addr_tokens"), F.col("t.addr_tokens")) + 0.1 * F.when(F.col("q.country") == F.col("t.country"), 1.0).otherwise(0.0)
    return j.select("s1_id", "target_id", F.round(p, 6).alias("p"))


def _decided(strategy: str, **kw):
    def run(spark, d):
        return er.decide(_scores(spark, d), er.Decision(strategy=strategy, threshold=0.35, s2=0.34, s3=0.30, min_top=0.3, multi=0.28, max_drop=0.3, **kw))

    return run


def _per(spark, d):
    return er.entity_scores(_s1(spark, d), _truth(spark, d), _decided("global")(spark, d))


def src_profile(spark, d):
    return tables.profile(records(spark, d), ["id", "name", "addr", "country"], by="src")


def norm_tokens(spark, d):
    r = records(spark, d).withColumn("n", T.normalize("name"))
    return r.select("id", "n", T.signature("n").alias("sig"), F.size(T.tokens("n")).alias("n_tokens"), T.alnum("n").alias("alnum"))


def norm_documents(spark, d):
    """Whole texts beyond ASCII as well: no SQL form for case folding of all of Unicode."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    n = T.normalize("text")
    return docs.select("doc_id", F.length(n).alias("n_norm"), F.md5(n).alias("norm_md5"), F.md5(T.clean_ascii("text")).alias("ascii_md5"), F.md5(T.transliterate("text")).alias("translit_md5"))


def norm_legal_address(spark, d):
    r = records(spark, d)
    return r.select("id", T.expand_legal(T.normalize("name", False)).alias("legal"), T.expand_address(T.normalize("addr", False)).alias("address"))


def extract_structural(spark, d):
    r = parsed(spark, d)
    return r.select("id", F.array_join(T.numbers("addr"), ",").alias("numbers"), F.array_join("postals", ",").alias("postals"), "building", "street", "pin")


def char_ngrams(spark, d):
    r = records(spark, d).withColumn("n", T.normalize("name", False))
    g = T.char_ngrams("n")
    return r.select("id", F.size(g).alias("n_grams"), F.array_join(F.array_sort(g), " ").alias("grams"), F.size(T.key_ngrams("n", 4)).alias("n_keys"))


def word_bigrams(spark, d):
    r = records(spark, d).withColumn("n", T.normalize("name", False))
    return r.select("id", F.array_join(T.word_bigrams("n"), " ").alias("bigrams"))


def core_compact(spark, d):
    r = records(spark, d).withColumn("n", T.normalize("name", False))
    return r.select("id", T.core_name("n").alias("core"), T.compact("n").alias("compact"), T.country_code("country").alias("country_code"), T.initials("n").alias("initials"), T.ocr_fold("n").alias("ocr"))


def phonetic_keys(spark, d):
    return parsed(spark, d).select("id", "phonetic")


def token_df(spark, d):
    t = parsed(spark, d).where("src <> 'S1'").select(F.explode("name_tokens").alias("token"))
    return t.groupBy("token").agg(F.count("*").alias("df")).withColumn("rare", F.col("df") <= 100)


def _block(route):
    return lambda spark, d: _hits(spark, d, route)


def block_postal_residual(spark, d):
    return er.with_residual(_hits(spark, d, "postal"), parsed(spark, d))


def block_building_residual(spark, d):
    return er.with_residual(_hits(spark, d, "building"), parsed(spark, d), same_country=True)


def union_provenance(spark, d):
    p = er.union_provenance(_hits(spark, d), most=150)
    return p.select("s1_id", "target_id", F.array_join("routes", ",").alias("routes"), "n_routes", "tier")


def _retrieval(name):
    def run(spark, d):
        q, t = _keys(spark, d)
        return er.retrieve(q, t, er.PROFILES[name])

    return run


def tfidf_topk(spark, d):
    r = records(spark, d).withColumn("t", T.normalize("name", False))
    return er.tfidf_topk(r.where("src = 'S1'"), r.where("src = 'S3'"), 5)


def _tfidf_all(column):
    def run(spark, d):
        return _tfidf_of(records(spark, d).withColumn("t", T.normalize(column, False)))

    return run


def _tfidf_of(r):
    return er.tfidf_topk(r.where("src = 'S1'"), r.where("src <> 'S1'"), 50, 3, 5)


def pair_features(spark, d):
    return er.pair_features(_joined(spark, d))


def context_features(spark, d):
    return er.context_features(_scores(spark, d))


def fuzzy_features(spark, d):
    j = _joined(spark, d)
    a, b = F.col("q.n"), F.col("t.n")
    fs = {"ratio": fuzzy.ratio_of, "partial": fuzzy.partial_of, "token_sort": fuzzy.token_sort_of, "token_set": fuzzy.token_set_of, "weighted": fuzzy.weighted_of}
    return j.select("s1_id", "target_id", *[F.round(f(a, b), 6).alias(k) for k, f in fs.items()])


def jaro_winkler(spark, d):
    j = _joined(spark, d)
    return j.select("s1_id", "target_id", F.round(fuzzy.jaro_winkler_of(F.col("q.n"), F.col("t.n")), 6).alias("jw"))


def threshold_sweep(spark, d):
    return er.threshold_sweep(_s1(spark, d), _truth(spark, d), _scores(spark, d), THRESHOLDS)


def macro_metrics(spark, d):
    return er.macro_metrics(_per(spark, d))


def subgroup_metrics(spark, d):
    r = records(spark, d).select(F.col("id").alias("s1_id"), "country")
    groups = F.array(F.col("country"), F.when(F.col("n_true") == 0, "single").when(F.col("n_true") == 1, "one").otherwise("multi"))
    return er.macro_metrics(_per(spark, d).join(r, "s1_id").withColumn("grp", F.explode(groups)), ["grp"])


def candidate_recall(spark, d):
    return learn.candidate_recall(_s1(spark, d), _truth(spark, d), _pairs(spark, d))


def route_benchmark(spark, d):
    return learn.route_benchmark(_hits(spark, d), _truth(spark, d))


def candidate_distribution(spark, d):
    return learn.candidate_distribution(_s1(spark, d), _pairs(spark, d))


def recall_funnel(spark, d):
    return learn.recall_funnel(_truth(spark, d), _pairs(spark, d), _scores(spark, d), _decided("global")(spark, d), 0.35)


def error_breakdown(spark, d):
    return er.error_kinds(_per(spark, d)).select("s1_id", "n_true", "n_pred", "n_hit", "fp", "fn", "kind")


def missed_pairs(spark, d):
    return learn.missed_pairs(_truth(spark, d), _pairs(spark, d), parsed(spark, d))


def stratified_split(spark, d):
    return er.stratified_split(_s1(spark, d), _truth(spark, d))


def hard_negatives(spark, d):
    return er.hard_negatives(_scores(spark, d), _truth(spark, d))


def sink_rows(spark, d):
    return er.prediction_lists(_s1(spark, d), _decided("global")(spark, d))


def list_violations(spark, d):
    lists = sink_rows(spark, d)
    ids = records(spark, d)
    return tables.list_findings(lists, ids.where("src = 'S1'").select("id"), ids.where("src <> 'S1'").select("id"))


def schema_violations(spark, d):
    return tables.source_findings(records(spark, d).withColumnRenamed("id", "entity_id"), {"S1", "S2"})


def id_fingerprint(spark, d):
    return tables.id_fingerprint(records(spark, d), "id", "src")


def gbt_scores(spark, d):
    """Scores of pairs of queries that the model wasn't fitted to."""
    features = pair_features(spark, d)
    if isinstance(d, AllRoutes):  # fitting reads them again and again
        features = d.stored(spark, "features", lambda: pair_features(spark, d))
    train, rest = learn.split_fit(features, _truth(spark, d), stratified_split(spark, d))
    return learn.scored(learn.fit_trees(train, learn.feature_names(train)), rest).select("s1_id", "target_id", "p", "label")


def calibration(spark, d):
    return learn.calibrated_apart(_scores(spark, d), _truth(spark, d), stratified_split(spark, d))


def revenue_by_nation(spark, d):
    """Scan, join and aggregate over the fact tables: the roll-up shape of the audits."""
    o, c, li = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("orders", "customer", "lineitem"))
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    return j.groupBy("c_nationkey").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    plain = [
        src_profile, norm_tokens, norm_documents, norm_legal_address, extract_structural, char_ngrams, word_bigrams, core_compact, phonetic_keys, token_df, block_postal_residual,
        block_building_residual, union_provenance, tfidf_topk, pair_features, context_features, fuzzy_features, jaro_winkler, threshold_sweep, macro_metrics, subgroup_metrics,
        candidate_recall, route_benchmark, candidate_distribution, recall_funnel, error_breakdown, missed_pairs, stratified_split, hard_negatives, sink_rows, list_violations,
        schema_violations, id_fingerprint, gbt_scores, calibration, revenue_by_nation,
    ]
    out = {f.__name__: f for f in plain}
    out |= {f"block_{r}": _block(r) for r in CAPS} | {f"retrieval_{p}": _retrieval(p) for p in er.PROFILES}
    out |= {"tfidf_name_all": _tfidf_all("name"), "tfidf_addr_all": _tfidf_all("addr")}
    out |= {"decide_global": _decided("global"), "decide_source": _decided("source_specific"), "decide_margin": _decided("margin_abstention")}
    out |= {"decide_adaptive": _decided("adaptive_multi"), "decide_adaptive_all": _decided("adaptive_multi", per_source=0, abstain=False), "decide_prefix": _decided("prefix"), "decide_rank_aware": _decided("rank_aware", per_source=3)}
    routed = [
        "union_provenance", "pair_features", "context_features", "fuzzy_features", "jaro_winkler", "threshold_sweep", "macro_metrics", "subgroup_metrics", "candidate_recall", "route_benchmark", "candidate_distribution",
        "recall_funnel", "error_breakdown", "missed_pairs", "hard_negatives", "sink_rows", "list_violations", "gbt_scores", "calibration", *[n for n in out if n.startswith("decide_")],
    ]
    from lodestar.plans import extended

    return out | {f"{n}_nine_routes": lambda spark, d, f=out[n]: f(spark, AllRoutes(d)) for n in routed} | extended.queries()


# --- the same in DuckDB's SQL ------------------------------------------------------------------

_REC = r"""
rec AS (
  SELECT 'S1-' || s_suppkey AS id, 'S1' AS src, CAST(s_suppkey AS BIGINT) AS seq, s_name AS name, s_nationkey || ' Main St ' || (s_nationkey + 10000) AS addr, 'nation_' || s_nationkey AS country FROM supplier
  UNION ALL SELECT 'S2-' || c_custkey, 'S2', CAST(c_custkey AS BIGINT), c_name, c_nationkey || ' Main Rd ' || (c_nationkey + 10000), 'nation_' || c_nationkey FROM customer
  UNION ALL SELECT 'S3-' || p_partkey, 'S3', CAST(p_partkey AS BIGINT), p_name || ' Co. & Sons #' || lpad(CAST(p_partkey AS VARCHAR), 9, '0'), p_size || ' Main Ave ' || (p_size + 10000), 'usa' FROM part),
nrm AS (
  SELECT *, trim(regexp_replace(regexp_replace(replace(lower(name), '&', ' and '), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) AS n,
    trim(regexp_replace(regexp_replace(replace(lower(addr), '&', ' and '), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) AS a FROM rec),
par AS (
  SELECT *, list_filter(list_distinct(string_split(n, ' ')), lambda x: x <> '') AS nt, list_filter(list_distinct(string_split(a, ' ')), lambda x: x <> '') AS adt, array_to_string(list_sort(list_filter(list_distinct(string_split(n, ' ')), lambda x: x <> '')), ' ') AS sig,
    lower(regexp_extract(addr, '^\s*(\d+[a-zA-Z]?)\b', 1)) AS bld, list_distinct(regexp_extract_all(addr, '\b\d{5,6}\b')) AS pins FROM nrm)"""
_KEYS = r""",
k AS (
  SELECT 'exact_name' AS route, n AS key, id, src, seq FROM par WHERE n <> '' UNION ALL SELECT 'name_sig', sig, id, src, seq FROM par WHERE sig <> ''
  UNION ALL SELECT 'rare_token', x, id, src, seq FROM (SELECT unnest(nt) AS x, id, src, seq FROM par) WHERE length(x) >= 3
  UNION ALL SELECT 'postal', unnest(pins), id, src, seq FROM par UNION ALL SELECT 'building', bld, id, src, seq FROM par WHERE bld <> ''),
caps(route, cap, gate) AS (VALUES ('exact_name', 50, 0), ('name_sig', 50, 0), ('rare_token', 30, 100), ('postal', 30, 0), ('building', 20, 0)),
t AS (
  SELECT k.route, key, id FROM (SELECT *, row_number() OVER (PARTITION BY route, key ORDER BY src, seq) AS rn, count(*) OVER (PARTITION BY route, key) AS df FROM k WHERE src <> 'S1') k
  JOIN caps USING (route) WHERE rn <= cap AND (gate = 0 OR df <= gate)),
hits AS (SELECT q.id AS s1_id, t.id AS target_id, route FROM k q JOIN t USING (route, key) WHERE q.src = 'S1')"""
_PAIRS = r""",
pairs AS (SELECT s1_id, target_id, list_sort(list_distinct(list(route))) AS rs FROM hits GROUP BY 1, 2),
truth AS (SELECT a.id AS s1_id, b.id AS target_id FROM rec a JOIN rec b USING (seq) WHERE a.src = 'S1' AND b.src <> 'S1'),
s1 AS (SELECT id AS s1_id FROM rec WHERE src = 'S1')"""
_SCORES = r""",
sc AS (
  SELECT s1_id, target_id, round(0.6 * len(list_intersect(q.nt, t.nt)) / least(len(q.nt), len(t.nt)) + 0.3 * len(list_intersect(q.adt, t.adt)) / len(list_distinct(list_concat(q.adt, t.adt)))
    + 0.1 * CASE WHEN q.country = t.country THEN 1.0 ELSE 0.0 END, 6) AS p
  FROM pairs JOIN par q ON q.id = s1_id JOIN par t ON t.id = target_id)"""
_PICKS = ", picks AS (SELECT * FROM sc WHERE p >= 0.35)"
_PER = r""",
per0 AS (
  SELECT s1_id, (SELECT count(*) FROM truth x WHERE x.s1_id = s1.s1_id) AS n_true, (SELECT count(*) FROM picks x WHERE x.s1_id = s1.s1_id) AS n_pred,
    (SELECT count(*) FROM picks x JOIN truth y USING (s1_id, target_id) WHERE x.s1_id = s1.s1_id) AS n_hit FROM s1),
per AS (
  SELECT *, CASE WHEN n_true = 0 AND n_pred = 0 THEN 1.0 WHEN n_pred = 0 THEN 0.0 ELSE n_hit / n_pred END AS pr, CASE WHEN n_true = 0 AND n_pred = 0 THEN 1.0 WHEN n_true = 0 THEN 0.0 ELSE n_hit / n_true END AS re,
    CASE WHEN n_true = 0 AND n_pred = 0 THEN 1.0 WHEN n_hit = 0 THEN 0.0 ELSE 1.25 * n_hit / (0.25 * n_true + n_pred) END AS f FROM per0)"""
_MACRO = """count(*) AS n, round(avg(f), 6) AS macro_f, round(avg(pr), 6) AS macro_precision, round(avg(re), 6) AS macro_recall, CAST(sum(n_hit) AS BIGINT) AS hits, round(coalesce(sum(n_hit) / nullif(sum(n_pred), 0), 0.0), 6) AS micro_precision,
round(coalesce(sum(n_hit) / nullif(sum(n_true), 0), 1.0), 6) AS micro_recall, round(coalesce(avg(CASE WHEN n_true = 0 THEN CASE WHEN n_pred = 0 THEN 1.0 ELSE 0.0 END END), 1.0), 6) AS singleton_accuracy"""


def oracle_sql() -> dict[str, str]:
    from lodestar.plans import extended

    return base_sql() | extended.oracle_sql()


FEATURE_SQL: list[str] = []


def base_sql() -> dict[str, str]:
    w = lambda chain, last: f"WITH {chain}\n{last}"
    rec, keys = _REC, _REC + _KEYS
    pairs = keys + _PAIRS
    sc = pairs + _SCORES
    picks = sc + _PICKS
    per = picks + _PER
    ranked = ", r AS (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY p DESC, target_id) AS rn FROM sc)"
    out = {
        "src_profile": w(rec, """SELECT src, count(*) AS n_rows, count(DISTINCT id) AS distinct_id, count(DISTINCT name) AS distinct_name, count(DISTINCT addr) AS distinct_addr, count(DISTINCT country) AS distinct_country,
            count(*) FILTER (trim(id) = '') AS blank_id, count(*) FILTER (trim(name) = '') AS blank_name, count(*) FILTER (trim(addr) = '') AS blank_addr, count(*) FILTER (trim(country) = '') AS blank_country,
            round(avg(length(name)), 6) AS mean_name, quantile_cont(length(name), 0.5) AS median_name, round(quantile_cont(length(name), 0.95), 6) AS p95_name, max(length(name)) AS max_name FROM rec GROUP BY src"""),
        "norm_tokens": w(rec, "SELECT id, n, sig, len(string_split(n, ' ')) AS n_tokens, replace(n, ' ', '') AS alnum FROM par, (SELECT 1) WHERE true"),
        "norm_legal_address": w(rec, r"SELECT id, regexp_replace(n, '\bco\b', 'company', 'g') AS legal, regexp_replace(regexp_replace(regexp_replace(a, '\brd\b', 'road', 'g'), '\bst\b', 'street', 'g'), '\bave\b', 'avenue', 'g') AS address FROM par"),
        "extract_structural": w(rec, r"SELECT id, array_to_string(regexp_extract_all(addr, '\b\d+\b'), ',') AS numbers, array_to_string(pins, ',') AS postals, nullif(bld, '') AS building, 'main' AS street, list_min(pins) AS pin FROM par"),
        "char_ngrams": w(rec, r"""SELECT id, len(g) AS n_grams, array_to_string(list_sort(g), ' ') AS grams, greatest(length(c) - 3, 1) AS n_keys FROM (SELECT id, c, list_distinct(flatten(list_transform([3, 4, 5],
            lambda m: list_transform(range(1, length(c) - m + 2), lambda i: substring(c, i, m))))) AS g FROM (SELECT id, replace(n, ' ', '') AS c FROM par))"""),
        "word_bigrams": w(rec, "SELECT id, array_to_string(list_transform(range(1, len(ts)), lambda i: ts[i] || '_' || ts[i + 1]), ' ') AS bigrams FROM (SELECT id, string_split(n, ' ') AS ts FROM par)"),
        "core_compact": w(rec, """SELECT id, array_to_string(list_filter(string_split(n, ' '), lambda x: x NOT IN ('and', 'co') AND length(x) > 1), ' ') AS core, replace(n, ' ', '') AS compact, CASE WHEN upper(country) = 'USA' THEN 'US' ELSE upper(country) END AS country_code,
            array_to_string(list_transform(string_split(n, ' '), lambda x: x[1]), '') AS initials, translate(n, '015', 'ois') AS ocr FROM par"""),
        "token_df": w(rec, "SELECT token, count(*) AS df, count(*) <= 100 AS rare FROM (SELECT unnest(nt) AS token FROM par WHERE src <> 'S1') GROUP BY 1"),
        "block_postal_residual": w(keys, "SELECT s1_id, target_id, route FROM hits JOIN par q ON q.id = s1_id JOIN par t ON t.id = target_id WHERE route = 'postal' AND len(list_intersect(q.nt, t.nt)) > 0"),
        "block_building_residual": w(keys, "SELECT s1_id, target_id, route FROM hits JOIN par q ON q.id = s1_id JOIN par t ON t.id = target_id WHERE route = 'building' AND len(list_intersect(q.nt, t.nt)) > 0 AND q.country = t.country"),
        "union_provenance": w(pairs, """SELECT s1_id, target_id, array_to_string(rs, ',') AS routes, len(rs) AS n_routes, tier FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY tier, len(rs) DESC, target_id) AS rn FROM (SELECT *,
            CASE WHEN list_has_any(rs, ['exact_name', 'name_sig']) THEN 1 WHEN list_contains(rs, 'rare_token') THEN 2 ELSE 3 END AS tier FROM pairs)) WHERE rn <= 150"""),
        "context_features": w(sc, """SELECT s1_id, target_id, p, row_number() OVER (PARTITION BY s1_id ORDER BY p DESC, target_id) AS rank, round(max(p) OVER (PARTITION BY s1_id) - p, 6) AS gap_to_top, count(*) OVER (PARTITION BY s1_id) AS n_candidates,
            count(*) OVER (PARTITION BY target_id) AS target_frequency, row_number() OVER (PARTITION BY target_id ORDER BY p DESC, s1_id) AS target_rank FROM sc"""),
        "jaro_winkler": w(pairs, "SELECT s1_id, target_id, round(jaro_winkler_similarity(q.n, t.n), 6) AS jw FROM pairs JOIN par q ON q.id = s1_id JOIN par t ON t.id = target_id"),
        "decide_global": w(sc, "SELECT * FROM sc WHERE p >= 0.35"),
        "decide_source": w(sc, "SELECT * FROM sc WHERE p >= CASE WHEN target_id LIKE 'S2-%' THEN 0.34 ELSE 0.30 END"),
        "decide_margin": w(sc + ranked, """SELECT s1_id, target_id, p FROM (SELECT *, max(p) OVER w AS top, coalesce(max(CASE WHEN rn = 2 THEN p END) OVER w, 0) AS second FROM r WINDOW w AS (PARTITION BY s1_id))
            WHERE NOT (top < 0.3 OR (top < 0.35 AND round(top - second, 9) < 0.05)) AND p >= 0.35"""),
        "decide_prefix": w(sc + ranked, "SELECT s1_id, target_id, p FROM (SELECT *, min(CASE WHEN p < 0.35 THEN rn END) OVER (PARTITION BY s1_id) AS bad FROM r) WHERE bad IS NULL OR rn < bad"),
        "decide_rank_aware": w(sc + ranked, "SELECT s1_id, target_id, p FROM r WHERE p >= 0.35 + 0.04 * (rn - 1) AND rn <= 3"),
        "threshold_sweep": w(sc, """, th AS (SELECT round(0.20 + 0.01 * i, 2) AS threshold FROM range(66) x(i)), nt AS (SELECT s1_id, count(*) AS m FROM truth GROUP BY 1),
            hp AS (SELECT threshold, sc.s1_id, count(*) AS n, count(truth.target_id) AS h FROM sc JOIN th ON p >= threshold LEFT JOIN truth USING (s1_id, target_id) GROUP BY 1, 2)
            SELECT threshold, round(avg(CASE WHEN coalesce(n, 0) = 0 AND coalesce(m, 0) = 0 THEN 1.0 WHEN coalesce(h, 0) = 0 THEN 0.0 ELSE 1.25 * h / (0.25 * m + n) END), 6) AS macro_f
            FROM s1 CROSS JOIN th LEFT JOIN nt USING (s1_id) LEFT JOIN hp USING (threshold, s1_id) GROUP BY 1""").replace("\n, th AS", ", th AS"),
        "macro_metrics": w(per, f"SELECT {_MACRO} FROM per"),
        "subgroup_metrics": w(per, f"SELECT grp, {_MACRO} FROM (SELECT per.*, unnest([country, CASE WHEN n_true = 0 THEN 'single' WHEN n_true = 1 THEN 'one' ELSE 'multi' END]) AS grp FROM per JOIN rec ON id = s1_id) GROUP BY grp"),
        "candidate_recall": w(pairs, """SELECT (SELECT count(*) FROM truth) AS n_true, (SELECT count(*) FROM truth SEMI JOIN pairs USING (s1_id, target_id)) AS n_found, (SELECT count(*) FROM pairs) AS n_candidates,
            round((SELECT count(*) FROM truth SEMI JOIN pairs USING (s1_id, target_id)) / (SELECT count(*) FROM truth), 6) AS recall, round((SELECT count(*) FROM pairs) / (SELECT count(*) FROM s1), 6) AS per_query"""),
        "route_benchmark": w(pairs, """, hr AS (SELECT DISTINCT s1_id, target_id, route FROM hits), nr AS (SELECT s1_id, target_id, count(*) AS c FROM hr GROUP BY 1, 2)
            SELECT route, count(*) AS volume, count(truth.target_id) AS found, count(*) FILTER (c = 1) AS only_here, count(truth.target_id) FILTER (c = 1) AS found_only_here
            FROM hr JOIN nr USING (s1_id, target_id) LEFT JOIN truth USING (s1_id, target_id) GROUP BY 1""").replace("\n, hr AS", ", hr AS"),
        "candidate_distribution": w(pairs, """, c AS (SELECT s1_id, count(target_id) AS c FROM s1 LEFT JOIN pairs USING (s1_id) GROUP BY 1) SELECT count(*) AS n, round(avg(c), 6) AS mean, round(quantile_cont(c, 0.5), 6) AS median, round(quantile_cont(c, 0.75), 6) AS p75,
            round(quantile_cont(c, 0.9), 6) AS p90, round(quantile_cont(c, 0.95), 6) AS p95, round(quantile_cont(c, 0.99), 6) AS p99, max(c) AS most, round(avg(CASE WHEN c = 0 THEN 1.0 ELSE 0.0 END), 6) AS zero_share FROM c""").replace("\n, c AS", ", c AS"),
        "recall_funnel": w(picks, """, st AS (SELECT CASE WHEN p2.rs IS NULL THEN '1 not retrieved' WHEN sc.p < 0.35 THEN '2 below threshold' WHEN k.p IS NULL THEN '3 not picked' ELSE '4 linked' END AS stage FROM truth t LEFT JOIN pairs p2 USING (s1_id, target_id)
            LEFT JOIN sc USING (s1_id, target_id) LEFT JOIN picks k USING (s1_id, target_id)) SELECT stage, count(*) AS n FROM st GROUP BY 1""").replace("\n, st AS", ", st AS"),
        "error_breakdown": w(per, """SELECT s1_id, n_true, n_pred, n_hit, n_pred - n_hit AS fp, n_true - n_hit AS fn, CASE WHEN n_pred = n_hit AND n_true = n_hit THEN 'perfect' WHEN n_true = 0 THEN 'false_merge' WHEN n_pred = 0 THEN 'miss'
            WHEN n_pred > n_hit AND n_true > n_hit THEN 'mixed' WHEN n_pred > n_hit THEN 'over' ELSE 'under' END AS kind FROM per"""),
        "missed_pairs": w(pairs, """SELECT s1_id, target_id, CASE WHEN q.n = t.n THEN 'same name' WHEN len(list_intersect(q.nt, t.nt)) > 0 THEN 'shared token' WHEN list_has_any(q.pins, t.pins) THEN 'shared postal' WHEN q.bld = t.bld AND q.bld <> '' THEN 'shared building'
            WHEN q.country <> t.country THEN 'other country' ELSE 'nothing shared' END AS category FROM truth ANTI JOIN pairs USING (s1_id, target_id) JOIN par q ON q.id = s1_id JOIN par t ON t.id = target_id"""),
        "stratified_split": w(pairs, """, st AS (SELECT s1_id, CAST(least(count(target_id), 2) AS INT) AS stratum FROM s1 LEFT JOIN truth USING (s1_id) GROUP BY 1)
            SELECT s1_id, stratum, CASE WHEN row_number() OVER (PARTITION BY stratum ORDER BY md5('split' || s1_id)) <= floor(count(*) OVER (PARTITION BY stratum) * 0.2) THEN 'validation' ELSE 'train' END AS part FROM st""").replace("\n, st AS", ", st AS"),
        "hard_negatives": w(sc, """, m AS (SELECT s1_id, count(*) AS m FROM truth GROUP BY 1) SELECT s1_id, target_id, p, rn FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY p DESC, target_id) AS rn FROM sc ANTI JOIN truth USING (s1_id, target_id))
            LEFT JOIN m USING (s1_id) WHERE rn <= greatest(3, coalesce(m, 0) * 3)""").replace("\n, m AS", ", m AS"),
        "sink_rows": w(picks, "SELECT s1_id, coalesce(string_agg(target_id, ',' ORDER BY target_id), '') AS matched_entity_ids FROM s1 LEFT JOIN picks USING (s1_id) GROUP BY 1"),
        "id_fingerprint": w(rec, "SELECT src, count(*) AS n, sha256(string_agg(id, chr(10) ORDER BY id)) AS sha256 FROM rec GROUP BY src"),
        "revenue_by_nation": "SELECT c_nationkey, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1",
    }
    out |= {f"block_{r}": w(keys, f"SELECT * FROM hits WHERE route = '{r}'") for r in CAPS}
    jac = lambda a, b: f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) END"
    cols = []
    g3 = lambda x: f"list_distinct(list_transform(range(1, length({x}) - 1), lambda i: substring({x}, i, 3)))"
    for p, c, toks in (("name", "n", "nt"), ("addr", "a", "adt")):
        q, t = f"q.{c}", f"t.{c}"
        cols += [
            f"CASE WHEN q.{p} = t.{p} THEN 1.0 ELSE 0.0 END AS {p}_exact_raw", f"CASE WHEN {q} = {t} THEN 1.0 ELSE 0.0 END AS {p}_exact_norm", f"round(1 - levenshtein({q}, {t}) / greatest(length({q}), length({t})), 6) AS {p}_levenshtein",
            f"round({jac(f'q.{toks}', f't.{toks}')}, 6) AS {p}_jaccard", f"round(len(list_intersect(q.{toks}, t.{toks})) / least(len(q.{toks}), len(t.{toks})), 6) AS {p}_overlap", f"round({jac(g3(q), g3(t))}, 6) AS {p}_char3",
            f"CAST(abs(len(q.{toks}) - len(t.{toks})) AS DOUBLE) AS {p}_token_diff", f"round(least(length({q}), length({t})) / greatest(length({q}), length({t})), 6) AS {p}_length_ratio",
            f"round(2 * len(list_intersect({g3(q)}, {g3(t)})) / (len({g3(q)}) + len({g3(t)})), 6) AS {p}_dice", f"CASE WHEN length({q}) >= 4 AND length({t}) >= 4 AND (contains({q}, {t}) OR contains({t}, {q})) THEN 1.0 ELSE 0.0 END AS {p}_contains",
        ]
    cols += [
        "CASE WHEN q.country = t.country THEN 1.0 ELSE 0.0 END AS country_match", "CASE WHEN q.country <> t.country THEN 1.0 ELSE 0.0 END AS country_mismatch", "CASE WHEN list_has_any(q.pins, t.pins) THEN 1.0 ELSE 0.0 END AS postal_match",
        "CASE WHEN q.bld = t.bld AND q.bld <> '' THEN 1.0 ELSE 0.0 END AS building_match", "CASE WHEN split_part(q.n, ' ', 1) = split_part(t.n, ' ', 1) THEN 1.0 ELSE 0.0 END AS first_word_match", "CASE WHEN t.src = 'S2' THEN 1.0 ELSE 0.0 END AS target_is_s2",
        f"round(({jac('q.nt', 't.nt')}) * ({jac('q.adt', 't.adt')}), 6) AS name_x_addr",
    ]
    cols = [x.replace("THEN 1.0 ELSE 0.0 END", "THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END") for x in cols]
    FEATURE_SQL[:] = cols
    out["pair_features"] = w(pairs, f"SELECT s1_id, target_id, {', '.join(cols)} FROM pairs JOIN par q ON q.id = s1_id JOIN par t ON t.id = target_id")
    out["tfidf_topk"] = w(rec, """, d AS (SELECT id, src, unnest(list_transform(range(1, length(n) - 1), lambda i: substring(n, i, 3))) AS g FROM par WHERE src IN ('S1', 'S3')), c AS (SELECT id, src, g, count(*) AS c FROM d GROUP BY ALL),
        idf AS (SELECT g, ln(((SELECT count(*) FROM rec WHERE src = 'S3') + 1) / (count(*) + 1)) + 1 AS idf FROM c WHERE src = 'S3' GROUP BY g HAVING count(*) >= 2),
        wt AS (SELECT id, src, g, (ln(c) + 1) * idf AS w FROM c JOIN idf USING (g)), nm AS (SELECT id, sqrt(sum(w * w)) AS norm FROM wt GROUP BY id), v AS (SELECT id, src, g, w / norm AS w FROM wt JOIN nm USING (id)),
        sim AS (SELECT a.id AS s1_id, b.id AS target_id, round(sum(a.w * b.w), 6) AS sim FROM v a JOIN v b USING (g) WHERE a.src = 'S1' AND b.src = 'S3' GROUP BY 1, 2)
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY sim DESC, target_id) AS rank FROM sim) WHERE rank <= 5""").replace("\n, d AS", ", d AS")
    return out
