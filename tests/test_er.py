import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestar.functions import fuzzy
from lodestar.functions import text as T
from lodestar.operators import er
from lodestar.sources import tables


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f("x").alias("y")).first()["y"]


@pytest.mark.parametrize(
    "f, value, want",
    [
        (lambda c: T.normalize(c), "  Straße & Söhne, Ltd. ", "strasse and söhne ltd"),
        (lambda c: T.normalize(c), None, ""),
        (lambda c: T.expand_legal(T.normalize(c)), "Acme Pvt Ltd", "acme private limited"),
        (lambda c: T.expand_address(T.normalize(c)), "P.O. Box 789", "pobox 789"),
        (lambda c: T.postal_codes(c), "124, MG Road 400051", ["400051"]),
        (lambda c: T.building(c), "12B Main", "12b"),
        (lambda c: T.building(c), "Main 12", None),
        (lambda c: T.core_name(T.normalize(c)), "The Acme Company", "acme"),
        (lambda c: T.key_ngrams(c, 3), "aaaa", ["aaa", "aaa"]),
        (lambda c: T.soundex(c), "ashcraft", "a226"),
        (lambda c: T.transliterate(c), "नमस्ते é", "namaste e"),
        (lambda c: T.country_code(c), " united kingdom", "GB"),
    ],
)
def test_text(spark, f, value, want):
    assert one(spark, value, f) == want


def test_fuzzy():
    assert fuzzy.ratio("abcd", "abxd") == 0.75 and fuzzy.ratio("", "") == 1
    assert fuzzy.token_sort_ratio("b a", "a b") == 1 and fuzzy.token_set_ratio("a b", "a b c") == 1
    assert fuzzy.partial_ratio("bc", "abcd") == 1 and fuzzy.weighted_ratio("", "a") == 0
    assert round(fuzzy.jaro_winkler("martha", "marhta"), 4) == 0.9611


def test_metrics_and_decisions(spark):
    s1 = spark.createDataFrame([("S1-1",), ("S1-2",), ("S1-3",)], "s1_id string")
    truth = spark.createDataFrame([("S1-1", "S2-1"), ("S1-1", "S3-1"), ("S1-2", "S2-9")], "s1_id string, target_id string")
    scores = spark.createDataFrame([("S1-1", "S2-1", 0.9), ("S1-1", "S3-1", 0.85), ("S1-1", "S2-2", 0.84), ("S1-2", "S2-3", 0.4)], "s1_id string, target_id string, p double")
    picks = er.decide(scores, er.Decision())
    assert {tuple(r) for r in picks.select("s1_id", "target_id").collect()} == {("S1-1", "S2-1"), ("S1-1", "S3-1")}
    got = er.macro_metrics(er.entity_scores(s1, truth, picks)).first()
    assert got["macro_f"] == round(2 / 3, 6) and got["singleton_accuracy"] == 1.0
    lists = er.prediction_lists(s1, picks)
    assert {tuple(r) for r in lists.collect()} == {("S1-1", "S2-1,S3-1"), ("S1-2", ""), ("S1-3", "")}


RECORDS = [
    ("S1-1", "S1", 1, "acme steel works", "12 oak lane 40001", "x"), ("S1-2", "S1", 2, "borea", "", "x"), ("S2-1", "S2", 1, "acme steelworks", "lane oak 12 40001", "x"),
    ("S2-2", "S2", 2, "zenith foods", "12 oak lane 40001", "y"), ("S2-3", "S2", 3, "acme foods", "12 elm road 50002", "y"), ("S3-1", "S3", 1, "acme steel work", "9 elm road 40001", "x"), ("S3-2", "S3", 2, "boreas", "7 oak road 50002", "x"),
]


@pytest.fixture
def small(spark, monkeypatch):
    from lodestar.plans import catalog

    rec = spark.createDataFrame(RECORDS, "id string, src string, seq long, name string, addr string, country string")
    monkeypatch.setattr(catalog, "records", lambda spark, d: rec)
    return catalog.queries()


@pytest.mark.parametrize("name, place", [("tfidf_name_all", 3), ("tfidf_addr_all", 4)])
def test_tfidf_over_all_targets(spark, small, name, place):
    def counts(r):
        t = r[place] or "unknown"
        return Counter(t[i : i + n] for n in (3, 4, 5) for i in range(len(t) - n + 1))

    targets = [r for r in RECORDS if r[1] != "S1"]
    df = Counter(g for r in targets for g in counts(r))
    idf = {g: math.log((len(targets) + 1) / (n + 1)) + 1 for g, n in df.items() if n >= 2}

    def unit(r):
        w = {g: (1 + math.log(n)) * idf[g] for g, n in counts(r).items() if g in idf}
        return {g: x / math.sqrt(sum(y * y for y in w.values())) for g, x in w.items()}

    want = {(q[0], t[0]): sum(x * unit(t).get(g, 0) for g, x in unit(q).items()) for q in RECORDS if q[1] == "S1" for t in targets}
    got = {(r["s1_id"], r["target_id"]): r["sim"] for r in small[name](spark, "").collect()}
    assert got == pytest.approx({k: x for k, x in want.items() if x > 0}, abs=1e-6) and {t[:2] for _, t in got} == {"S2", "S3"}


def test_candidates_of_all_routes(spark, small):
    got = {(r["s1_id"], r["target_id"]): (r["routes"], r["tier"]) for r in small["union_provenance_nine_routes"](spark, "").collect()}
    assert got == {
        ("S1-1", "S2-1"): ("addr_sig,addr_tfidf,name_tfidf,postal,rare_token", 1),
        ("S1-1", "S2-2"): ("addr_sig,addr_tfidf,exact_addr", 1),
        ("S1-1", "S2-3"): ("addr_tfidf,name_tfidf,rare_token", 2),
        ("S1-1", "S3-1"): ("addr_tfidf,name_tfidf,postal,rare_token", 2),
        ("S1-1", "S3-2"): ("addr_tfidf", 2),
    }
    plain = {(r["s1_id"], r["target_id"]) for r in small["union_provenance"](spark, "").collect()}
    assert ("S1-1", "S3-2") not in plain
    assert small["decide_global_nine_routes"](spark, "").count() == 2 and small["candidate_recall_nine_routes"](spark, "").first()["n_candidates"] == 5


@pytest.mark.parametrize("name, want", [("high", {(5.0, 2): 100, (3.0, 1): 150}), ("balanced", {(2.0, 1): 80}), ("lean", {(2.0, 1): 30})])
def test_profiles_find_names_by_their_common_tokens(spark, name, want):
    rows = [("S1-1", "S1", 1, "mid zzz", "", "x")] + [(f"S2-{i}", "S2", i, f"mid q{chr(97 + i % 26)}{chr(97 + i // 26)}", "", "x") for i in range(380)]
    keys = er.route_keys(er.parse(spark.createDataFrame(rows, "id string, src string, seq long, name string, addr string, country string")))
    got = er.retrieve(keys.where("src = 'S1'"), keys.where("src <> 'S1'"), er.PROFILES[name]).collect()
    assert Counter((r["score"], r["n_routes"]) for r in got) == want


def test_tsv(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\tA\t\tIN\nS1-1\tB\tx\tIN\n")
    t = tables.read_tsv(spark, str(tmp_path / "a.tsv"))
    assert [tuple(r) for r in t.collect()][0] == ("S1-1", "A", "", "IN")
    assert {tuple(r) for r in tables.source_findings(t, {"S1"}).collect()} == {("blank_id", 0), ("wrong_prefix", 0), ("repeated_id", 1)}


def test_stream(spark, tmp_path):
    from lodestar.streaming import batches

    rec = spark.createDataFrame([("S1-1", "S1", 1, "acme one", "1 a st", "x"), ("S2-1", "S2", 1, "acme one", "1 a st", "x")], "id string, src string, seq long, name string, addr string, country string")
    keys = er.route_keys(er.parse(rec)).where("src <> 'S1'")
    rec.where("src = 'S1'").write.parquet(str(tmp_path / "in"))
    batches.retrieve_stream(spark, str(tmp_path / "in"), keys, str(tmp_path / "out"), str(tmp_path / "ck"), er.PROFILES["lean"])
    assert spark.read.parquet(str(tmp_path / "out")).select("target_id").distinct().collect()[0][0] == "S2-1"


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert F is not None


def test_run_history_and_report(spark, tmp_path):
    path = f"file://{tmp_path}/history"
    tables.append_run(spark.createDataFrame([("first", 0.5)], "run string, macro_f double"), path)
    tables.append_run(spark.createDataFrame([("second", 0.6, "a|b")], "run string, macro_f double, note string"), path)
    got = tables.run_history(spark, path).orderBy("recorded_at").select("run", "macro_f", "note")
    assert [tuple(r) for r in got.collect()] == [("first", 0.5, None), ("second", 0.6, "a|b")]
    lines = [r["line"] for r in tables.markdown(got).orderBy("line_no").collect()]
    assert lines == ["|run | macro_f | note|", "|-|-|-|", "|first | 0.5 | |", "|second | 0.6 | a\\|b|"]
