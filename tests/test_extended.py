import json
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestar.functions import fuzzy
from lodestar.operators import audit, blocking, er, features, forensics, learn, rules, sampling
from lodestar.plans import catalog, extended
from lodestar.sources import layout, tables

PAIRS = "s1_id string, target_id string"


def plain(rows):
    return sorted(tuple(str(r[k]) for k in sorted(r.asDict())) for r in rows)


@pytest.mark.parametrize("name", ["legal_and_address_fixture", "block_exact_name_fixture", "block_name_sig_fixture", "bands_second_fixture", "missed_categories_fixture", "without_candidates_fixture", "retrieval_balanced_fixture"])
def test_fixture_queries_equal_their_sql(spark, name):
    got = extended.queries()[name](spark, "")
    want = duckdb.sql(extended.oracle_sql()[name])
    cols = sorted(want.columns)
    assert got.count() > 0 and sorted(got.columns) == cols
    rows = [tuple(dict(zip(want.columns, r))[k] for k in cols) for r in want.fetchall()]
    assert plain(got.collect()) == sorted(tuple(str(x) for x in r) for r in rows)


def test_stress_cases(spark):
    got = dict(extended.decision_stress(spark, "").collect())
    assert got == {f"S1-{i}": ids for i, (_, _, ids) in enumerate(extended.STRESS, 1)}


def test_decisions_with_missing_addresses_and_repeats(spark):
    scores = spark.createDataFrame([("S1-1", "S2-1", 0.60), ("S1-2", "S2-1", 0.60), ("S1-2", "S2-1", 0.64), ("S1-3", "S2-9", 0.5)], PAIRS + ", p double")
    meta = spark.createDataFrame([("S1-1", False)], "s1_id string, has_addr boolean")
    d = er.Decision(strategy="margin_abstention", threshold=0.55, min_top=0.57)
    assert {r["s1_id"]: r["p"] for r in er.decide(scores, d, meta).collect()} == {"S1-2": 0.64}
    free = er.Decision(strategy="margin_abstention", threshold=0.45, min_top=0.57, abstain=False)
    assert {r["s1_id"] for r in er.decide(scores, free).collect()} == {"S1-1", "S1-2", "S1-3"}


def test_rules_over_lists(spark):
    s1 = spark.createDataFrame([("S1-1",), ("S1-2",)], "s1_id string")
    truth = spark.createDataFrame([("S1-1", "S2-1"), ("S1-1", "S3-1")], PAIRS)
    scores = spark.createDataFrame([("S1-1", "S2-1", 0.9), ("S1-1", "S3-1", 0.8), ("S1-1", "S2-2", 0.5)], PAIRS + ", p double")
    lists = rules.collapsed(s1, truth, scores)

    def taken(rule, **k):
        return {r["target_id"] for r in rules.picks(lists, rule, **k).collect()}

    assert taken(rules.by_threshold, threshold=0.8) == {"S2-1", "S3-1"} and taken(rules.by_top_gate, min_top=0.95, threshold=0.1) == set()
    assert taken(rules.by_near_top, threshold=0.5, margin=0.1) == {"S2-1", "S3-1"} and taken(rules.by_prefix, min_top=0.5) == {"S2-1", "S3-1"}
    assert taken(rules.by_rank, max_k=1, threshold=0.1) == {"S2-1"} and taken(rules.by_source, s2=0.95, s3=0.7) == {"S3-1"}
    assert taken(rules.by_expected_f, least=0.35) == {"S2-1", "S3-1"} and taken(rules.by_dynamic_gap, threshold=0.5, margin=0.2) == {"S2-1", "S3-1"}
    assert taken(rules.by_capacity, s2=0.4, s3=0.4, min_top=0.3, min_margin=0, multi=0.4, max_drop=0.5, per_source=1) == {"S2-1", "S3-1"}
    best = rules.best_set(rules.scored_sets(lists, rules.by_threshold, rules.COARSE)).first()
    assert best["threshold"] == 0.51 and best["macro_f"] == 1.0
    assert rules.fine_search(lists).first()["threshold"] == 0.5025
    assert rules.from_json(rules.to_json(er.Decision(s2=0.1))) == er.Decision(s2=0.1)


def test_splits_add_up(spark):
    s1 = spark.range(1000).select(F.concat(F.lit("S1-"), "id").alias("s1_id"))
    truth = s1.where("cast(substring(s1_id, 4) as int) % 3 = 0").withColumn("target_id", F.lit("S2-1"))
    parts = {(r["stratum"], r["part"]): r["n"] for r in sampling.three_way(s1, truth).groupBy("stratum", "part").agg(F.count("*").alias("n")).collect()}
    assert parts == {(0, "validation"): 133, (0, "mining"): 66, (0, "train"): 467, (1, "validation"): 66, (1, "mining"): 33, (1, "train"): 235}
    assert sampling.two_samples(s1, 10).groupBy("part").count().collect() and sampling.two_samples(s1, 10).count() == 20
    left = sampling.unexposed(s1, truth, s1.limit(100))
    assert left.count() == 900


def test_source_and_file_findings(spark, tmp_path):
    good = spark.createDataFrame([("S1-1", "a", "b", "c")], "entity_id string, business_name string, business_address string, country string")
    assert audit.check_source(good, "S1-", "x", tables.SOURCE_COLUMNS) is good
    bad = good.unionAll(good).unionAll(spark.createDataFrame([("Q", "", "", ""), (" ", "", "", "")], good.schema))
    with pytest.raises(ValueError, match=r"1 blank ids; x: 1 ids without prefix S1-, as \['Q'\]; x: repeated ids"):
        audit.check_source(bad, "S1-", "x", tables.SOURCE_COLUMNS)
    with pytest.raises(ValueError, match="no rows"):
        audit.check_source(good.limit(0), "S1-", "x", tables.SOURCE_COLUMNS)
    with pytest.raises(ValueError, match="columns"):
        audit.check_source(good.drop("country"), "S1-", "x", tables.SOURCE_COLUMNS)
    s1, targets = spark.createDataFrame([("S1-1",), ("S1-2",)], "id string"), spark.createDataFrame([("S2-1",)], "id string")
    f, g = tmp_path / "m.tsv", tmp_path / "c.tsv"
    f.write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1, S2-1\nS1-9\t\nbroken\n")
    g.write_text("source1_entity_id\tcandidate_entity_ids\nS1-1\t\nS1-2\t\n")
    found = {(r["file"], r["category"]): (r["severity"], r["n"]) for r in audit.validate_files(spark, str(f), str(g), s1, targets).collect()}
    assert found["matching", "row_without_tab"] == ("ERROR", 1) and found["matching", "missing_key"] == ("ERROR", 1) and found["matching", "extra_key"] == ("ERROR", 1)
    assert found["matching", "repeated_id"] == ("ERROR", 1) and found["candidate", "wrong_header"] == ("OK", 0) and found["both", "not_a_candidate"] == ("WARNING", 1)
    assert {r["severity"] for r in audit.validate_files(spark, str(f), None, s1).where("file = 'candidate'").collect()} == {"WARNING"}
    with pytest.raises(ValueError, match="S1-2"):
        audit.missing_predictions(s1.toDF("s1_id"), spark.createDataFrame([("S1-1",)], "s1_id string"))


def test_layout(spark, tmp_path):
    (tmp_path / "train").mkdir()
    (tmp_path / "train" / "source2.tsv").write_text("entity_id\tbusiness_name\tbusiness_address\tcountry\nS2-7\tA\t\tX\n")
    got = layout.load_source(spark, str(tmp_path), "train", 2)
    assert [tuple(r) for r in layout.records_of({2: got}).collect()] == [("S2-7", "S2", 7, "A", "", "X")]
    with pytest.raises(FileNotFoundError):
        layout.resolve(spark, str(tmp_path), "test", "none.tsv")
    lists = spark.createDataFrame([("S1-2", "S2-1,S3-1"), ("S1-1", "")], "s1_id string, matched_entity_ids string")
    back = layout.load_lists(spark, layout.write_matching(lists, str(tmp_path / "out")))
    assert {r["s1_id"]: r["ids"] for r in back.collect()} == {"S1-2": ["S2-1", "S3-1"], "S1-1": []}
    assert [r["id"] for r in layout.ids_in(got).collect()] == ["S2-7"]
    parts = spark.createDataFrame([("S1-1", "train")], "s1_id string, part string")
    layout.write_split(parts, str(tmp_path / "split"))
    assert layout.read_split(spark, str(tmp_path / "split")).collect() == parts.collect()
    record = json.loads(json.dumps(layout.frozen({"cap": 5}, {"a": "1"})))
    assert layout.check_frozen(record, {"cap": 6}, {"a": "1"}) == ["cap: 5 became 6"]
    (tmp_path / "x.txt").write_text("x")
    assert layout.package([str(tmp_path / "x.txt"), str(tmp_path / "train")], str(tmp_path / "p.zip")) == ["train/source2.tsv", "x.txt"]
    assert zipfile.ZipFile(tmp_path / "p.zip").read("x.txt") == b"x"
    both = layout.side_by_side(lists, lists.where("s1_id = 'S1-1'"), "s1_id")
    assert both.count() == 2 and "matched_entity_ids_2" in both.columns


def test_measures_of_probabilities(spark):
    rows = [("S1-1", "S2-1", 0.9, 1), ("S1-1", "S2-2", 0.8, 0), ("S1-2", "S2-1", 0.8, 1), ("S1-2", "S2-3", 0.1, 0)]
    scores = spark.createDataFrame([r[:3] for r in rows], PAIRS + ", p double")
    truth = spark.createDataFrame([r[:2] for r in rows if r[3]], PAIRS)
    got = audit.probability_measures(scores, truth).first()
    assert got["roc_auc"] == 0.875 and got["average_precision"] == round(0.5 + 0.5 * 2 / 3, 6) and got["brier"] == round((0.01 + 0.64 + 0.04 + 0.01) / 4, 6)


def test_features_of_all_columns(spark):
    d = catalog.Fixture("")
    j = catalog._joined(spark, d)
    got = features.pair_columns(j)
    assert got.columns == [*er.PAIR, *features.PAIR_COLUMNS] and len(features.PAIR_COLUMNS) == 51 and len(features.WIDE_COLUMNS) == 56
    r = got.where("s1_id = 'S1-1' and target_id = 'S2-1'").first()
    assert r["name_exact_norm"] == 1.0 and r["name_exact_raw"] == 0.0 and r["postal_exact_match"] == 1.0 and r["numeric_token_overlap"] == 1.0 and r["both_have_address"] == 1.0
    assert r["name_fuzz_ratio"] == round(fuzzy.ratio("acme steel works pvt ltd", "acme steel works pvt ltd"), 6) and r["route_hit_count"] >= 2 and r["exact_name_hit"] == 1.0
    wide = features.wide_columns(extended._retrieved(spark, d))
    assert wide.columns == [*er.PAIR, *features.WIDE_COLUMNS] and wide.agg(F.min("ctx_cand_rank")).first()[0] == 1.0
    assert wide.where("addr_ratio > 0 and both_have_addr = 0").count() == 0
    context = features.contextual(got, j, catalog._scores(spark, d))
    assert len(context.columns) == 16 and context.agg(F.min("context_postal_compat"), F.max("context_postal_compat")).first()[1] == 1.0


def test_bands_residuals_and_preranking(spark):
    p = catalog.parsed(spark, catalog.Fixture(""))
    hits = blocking.banded(p, (blocking.Band("postal", 5, rest="token"),))
    assert ("S1-5", "S3-21") not in {(r["s1_id"], r["target_id"]) for r in hits.collect()}
    pairs = blocking.pairs_of(blocking.banded(p, blocking.PRESETS["uncapped"]))
    few = blocking.preranked(pairs, p, 1)
    assert few.count() == pairs.select("s1_id").distinct().count()
    assert few.where("s1_id = 'S1-1'").first()["target_id"] in ("S2-1", "S2-20")
    assert {tuple(sorted(r["routes"]))[-1] for r in blocking.with_country(pairs, p).where("s1_id = 'S1-5' and target_id = 'S2-5'").collect()} <= {"postal", "country_match"}


def test_recovery_and_pruning(spark):
    names = spark.createDataFrame([("S1-1", "a b c"), ("S2-1", "c b a"), ("S2-2", "x y")], "id string, n string")
    candidates = spark.createDataFrame([("S1-1", "S2-1"), ("S1-1", "S2-2")], PAIRS)
    got = rules.recover(spark.createDataFrame([], PAIRS + ", p double"), candidates, names).collect()
    assert [(r["target_id"], r["p"], r["recovered"]) for r in got] == [("S2-1", 1.0, True)]
    assert rules.similarity_prune(candidates, names).collect()[0]["matched_entity_ids"] == "S2-1"


def test_models_on_other_rows(spark, tmp_path):
    rows = [(f"S1-{i}", f"S2-{i % 7}", float(i % 10) / 10, float(i % 3)) for i in range(120)]
    table = spark.createDataFrame(rows, PAIRS + ", name_x double, addr_x double")
    truth = table.where("name_x >= 0.5").select(*er.PAIR)
    part = table.select("s1_id").withColumn("part", F.when(F.substring("s1_id", -1, 1).cast("int") < 5, "train").otherwise("validation"))
    part = part.withColumn("part", F.when(F.substring("s1_id", -2, 2).rlike("[02468]$"), "train").otherwise("validation"))
    train, rest = learn.split_fit(table, truth, part)
    model = learn.fit_trees(train, learn.feature_names(train), 2, 2)
    learn.save_model(model, str(tmp_path / "m"))
    a, b = (plain(learn.scored(m, rest).select(*er.PAIR, "p").collect()) for m in (model, learn.load_model(str(tmp_path / "m"))))
    assert a == b and len(a) == rest.count()
    assert {r["feature"]: r["importance"] > 0 for r in learn.importances(model, learn.feature_names(train)).collect()}["name_x"]


def test_samples_and_reasons(spark):
    pool = spark.createDataFrame([(f"S1-{i}", "S2-1", "ab"[i % 2], i / 100) for i in range(60)], PAIRS + ", category string, hardness double")
    assert sampling.ratio_sample(pool, 5, 4, 1).count() == 20 and sampling.curriculum(pool, 5, 4, 0.5).groupBy("origin").count().count() == 2
    assert [r["hardness"] for r in sampling.hardest(pool, 2).collect()] == [0.59, 0.58]
    d = catalog.Fixture("")
    said = {r["s1_id"]: r["category"] for r in forensics.without_candidates(catalog._s1(spark, d), catalog._truth(spark, d), spark.createDataFrame([], PAIRS), catalog.parsed(spark, d)).collect()}
    assert said["S1-9"] == "A_True_Singleton" and said["S1-3"].startswith("C_") and said["S1-1"].startswith("B_")


def test_unbounded_bands_never_deal_out_pairs(spark):
    """A hit of every pair and route was shuffled; now lists of records meet and pairs are spread from them last."""
    bands = blocking.PRESETS["uncapped"]
    assert [n for n, b in blocking.PRESETS.items() if blocking.unbounded(b)] == ["uncapped"]
    rows = [(f"{s}-{i}", s, i, f"{w} {i % 7}", f"{i % 3} Oak St 4000{i % 3}", "x") for s, w in (("S1", "acme"), ("S2", "acme"), ("S3", "")) for i in range(60)]
    records = spark.createDataFrame([*rows, ("S1-x", "S1", 61, None, None, "")], "id string, src string, seq long, name string, addr string, country string")
    for p in (catalog.parsed(spark, catalog.Fixture("")), er.parse(records)):
        want = blocking.pairs_of(blocking.banded(p, bands)).select(*er.PAIR, F.array_join("routes", ",").alias("routes"), "n_routes")
        got = blocking.whole_pairs(p, bands)
        assert sorted(got.collect()) == sorted(want.collect())
    plan = extended.queries()["bands_uncapped"](spark, catalog.Fixture(""))._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("Join")]
    assert "Generate" in above and "Exchange" not in above and "Aggregate" not in above
