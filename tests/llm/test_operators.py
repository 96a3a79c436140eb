import io
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql.classic.dataframe import DataFrame

from lodestar.llm import common, fingerprint, html, langid, lm, minhash, mixing, pieces, tokens, vectors, warc

random.seed(3)
WORDS = ["".join(random.choices("abcdefgh", k=random.randint(2, 6))) for _ in range(60)]
BASE = " ".join(random.choices(WORDS, k=120))
NEAR = " ".join([*BASE.split()[:118], "zz", "yy"])
TEXTS = [BASE, NEAR, BASE, None, "", "  \n", "one two", "One TWO", *[" ".join(random.choices(WORDS, k=80)) for _ in range(12)]]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "fr", None][i % 3], ["a", "b", None][i % 3], "clash") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, component_id string")


def test_words_and_components(spark):
    w = common.Words(pa.array(["a b", None, "c\x0bd"]))
    assert [bytes(w.data[s:e]) for s, e in zip(w.starts, w.ends)] == [b"a", b"b", b"c", b"d"] and list(w.bounds) == [0, 2, 2, 4]
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 40), (41, 50)], "a long, b long")
    got = dict(common.connected_components(common.Scratch(spark, "t"), edges).collect())
    assert got == {i: 0 for i in range(1, 31)} | {41: 40, 50: 40}


def test_minhash_against_brute_force(spark, docs):
    got = {r["doc_id"]: r for r in minhash.minhash_components(spark, docs, minhash.MinHashConfig(percent=85)).collect()}
    assert len(got) == len(TEXTS)
    assert [got[i]["component_id"] for i in range(8)] == [0, 0, 0, 3, 4, 5, 6, 6]
    assert got[3]["n_shingles"] == 0 and got[6]["n_shingles"] == 1 and got[1]["kept"] is False
    assert minhash.minhash_components(spark, docs.limit(0)).count() == 0


def test_cluster_comparison_is_exact():
    sets = [np.unique(np.array(random.choices(range(40), k=30), dtype=np.uint64)) for _ in range(9)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    assert minhash.intersections(sets, width=7).astype(int).tolist() == want


def test_tokens(spark, docs):
    from tokenizers import Tokenizer

    c = tokens.TokenConfig(public_tokenizers.path("byte_bpe_50k.json"))
    t, start = Tokenizer.from_file(c.tokenizer), 0
    for r in sorted(tokens.token_table(spark, docs, c).collect()):
        ids = [*t.encode(TEXTS[r["doc_id"]] or "", add_special_tokens=False).ids, 2]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    ranks = np.array([0, 255, 256, 65535, 65536, 2**24, 2**32 - 1, 3], dtype=np.uint32)
    assert (tokens.unpack(*tokens.pack(ranks), len(ranks)) == ranks).all() and len(tokens.unpack(*tokens.pack(ranks[:0]), 0)) == 0


def test_fingerprints(spark, docs):
    got = {r["doc_id"]: r for r in fingerprint.fingerprint_documents(spark, docs).collect()}
    assert len(got) == len(TEXTS) and got[0]["fingerprint"] == got[2]["fingerprint"] != got[1]["fingerprint"]
    assert got[4]["near_next"] == 1.0 and got[10]["near_edited"] > 0.4 > got[10]["near_next"]
    c = fingerprint.FingerprintConfig()
    texts = ["\n".join(random.choices(WORDS, k=n)) for n in (5, 300, 2000)]
    d, b = fingerprint.unit_digests(texts, c)
    base = fingerprint.Tables(3, c.cells, 0, c)
    base.add(np.repeat(np.arange(3), np.diff(b)), d)
    for i, j in itertools.permutations(range(3), 2):
        n = fingerprint.differing(d, b, np.array([i]), np.array([j]), base, c)
        assert n[0] == len(np.setxor1d(d[b[i] : b[i + 1]], d[b[j] : b[j + 1]]))


def test_mix(spark, docs):
    a, b = (sorted(map(tuple, mixing.mix_plan(spark, docs).select("doc_id", "size", "taken", "target", "source").collect())) for _ in range(2))
    assert a == b and len(a) == len(TEXTS) and all(t <= 2 * s for _, s, t, _, _ in a)
    assert math.isclose(sum({r[4]: r[3] for r in a}.values()), 1.5 * sum(r[1] for r in a))
    assert mixing.mix_plan(spark, docs.limit(0)).count() == 0


def test_lm(spark, docs):
    got = {r["doc_id"]: r for r in lm.score_documents(spark, docs, lm.LmConfig(words=64, members=16, head=20, hidden=8)).collect()}
    words = {i: [*(t or "").lower().split(), "\0end"] for i, t in enumerate(TEXTS)}
    train = [w for i, ws in words.items() if zlib.crc32(str(i).encode()) % 10 for w in ws]
    count = {w: train.count(w) for w in set(train)}
    for i, ws in words.items():
        want = sum(math.log10((count.get(w, 0) + 0.1) / (len(train) + 0.1 * (len(count) + 1))) for w in ws)
        assert math.isclose(got[i]["base_score"], want, rel_tol=1e-9) and got[i]["n_known"] == sum(w in count for w in ws)
        assert got[i]["n_tokens"] == len(ws) and got[i]["score"] < 0


def test_lm_learns_from_every_training_document(spark, docs, monkeypatch):
    added = []
    monkeypatch.setattr(lm.GatedNet, "unpack", lambda net, flat: added.append(flat) or net)
    real = DataFrame.collect
    seen = []
    monkeypatch.setattr(DataFrame, "collect", lambda d: [seen.append(r["n"]) or r for r in real(d)] if d.columns == ["n", "w"] else real(d))
    got = lm.score_documents(spark, docs, lm.LmConfig(words=64, members=16, head=20, hidden=8))
    assert len(added) == 1 and sum(seen) == got.first()["train_tokens"]
    c = lm.LmConfig(words=64, members=16, head=20, hidden=8)
    h, k, bounds = lm.tokens_of(pa.array([BASE]))
    u, first, n = np.unique(h, return_index=True, return_counts=True)
    lex = lm.Lexicon(c, u, n, k[first], np.bincount(k, minlength=65), np.bincount(k[first], minlength=65), len(h), len(u))
    trainer, sizes = lm.Trainer(lm.GatedNet(lex), c), []
    window = trainer._window
    trainer._window = lambda x, *more: sizes.append(x.size) or window(x, *more)
    trainer.run(*lm._sequences(lex, pa.array([BASE])))
    assert sum(sizes) == len(h) == 121


def test_pieces():
    m = pieces.piece_model(pieces.PieceConfig(public_tokenizers.path("piece_bpe_32k.model")))
    texts = ["", " a  b\n▁c", "日本🎉", "x" * 500, *[t or "" for t in TEXTS]]
    assert [m.decode(m.encode(t)) for t in texts] == texts
    base, check, value = pieces.double_array(sorted([b"a", b"ab", b"b"]))
    assert value[base[0] + ord("a") + 1] == 0 and check[base[0] + ord("b") + 1] == 0


def test_vectors(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(300, 16))
    x[100:140] = x[0] + 0.05 * r.normal(size=(40, 16))
    rows = [(i, [float(y) for y in v]) for i, v in enumerate(x)] + [(300, None), (301, [0.0] * 16), (302, [float("nan")] * 16), (303, [float(y) for y in x[5]])]
    got = {q["vec_id"]: q for q in vectors.vector_links(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    u = np.vstack([u, u[5]])
    n = (u @ u.T >= 0.9).sum(axis=1) - 1
    assert sum(got[i]["n_links"] for i in range(300)) >= 0.97 * n[:300].sum() and got[303]["component_id"] == 5
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in (300, 301, 302)) and got[120]["component_id"] == 0


def test_warc(spark):
    raw = [warc.gzip_member(warc.record([("WARC-Type", "response"), ("X-Page-ID", str(i))], bytes([31, 139, 8]) * i)) for i in range(40)]
    data, cut = b"".join(raw), 97
    got = [warc.parse_record(x)[0]["x-page-id"] for a in range(0, len(data), cut) for _, x in warc.members_in(io.BytesIO(data), a, a + cut)]
    assert got == [str(i) for i in range(40)]
    pages = spark.createDataFrame([(1, "u", "a"), (2, "u", "a"), (3, None, None), (None, "v", ""), (2, "u", "a")], "page_id long, url string, html string")
    out = sorted(((r["page_id"] or 0, r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.archived_pages(spark, pages).collect()), key=str)
    assert out == sorted([(1, "revisit", 2, 1), (2, "response", None, 1), (2, "revisit", 2, 1), (3, "response", None, 0), (0, "revisit", 3, 0)], key=str)


def test_language():
    texts = {"en": "the cat and the dog of the house " * 20, "de": "der hund und die katze in dem haus " * 20}
    m = langid.LangModel(langid.LangConfig(lane=7), {k: langid._fold(v) for k, v in texts.items()})
    got, score = m.predict(["the dog and the house", "die katze und der hund", None, "", "123 ..."])
    assert got == ["en", "de", "und", "und", "und"] and score[2:] == [0, 0, 0] and all(0 <= s <= 1 for s in score)


def test_language_learns_from_long_texts(spark):
    en, de, junk = "the cat and the dog of the house " * 300, "der hund und die katze in dem haus " * 300, "1234 " * 20_000
    rows = [("en", en), ("en", "the bird of the tree"), ("de", de), ("de", junk), ("fr", None)]
    labelled = spark.createDataFrame(rows, "lang string, text string")
    texts = langid.training_texts(labelled, langid.LangConfig())
    assert set(texts) == {"en", "de"} and all(len(t) >= 9000 for t in texts.values())
    docs = spark.createDataFrame([(1, "die katze und der hund"), (2, "the dog and the house")], "doc_id long, text string")
    assert {r["doc_id"]: r["_lang_pred"] for r in langid.identify(spark, docs, labelled).collect()} == {1: "de", 2: "en"}
    short = langid.training_texts(labelled, langid.LangConfig(chars=400))
    assert {k: len(t) for k, t in short.items()} == {"de": 400, "en": 400}


def test_html():
    page = '<html><nav><a href=x>Home</a></nav><div class="cookie-notice">We use the cookies of the site and more of them.</div><article><h1>A &amp; b</h1><p>The first of  the\nlines<p>and the second</article><footer>The end of it</footer>'
    assert html.main_text(page) == "A & b\nThe first of the lines\nand the second"
    assert html.main_text(None) == "" and html.main_text("<p") == ""
    assert re.search("x" * 1000, html.main_text("<article><p>" + "x" * 1000 + "</article>"))


@pytest.mark.parametrize("code", ["for(i=0;i<n;i++){f(i)}", "if(a<b)c='it", 'x="<!--"', "document.write('</head><p>')"])
def test_html_after_scripts(code):
    page = f"<html><head><script>{code}</script></head><body><article><p>A<script>{code}</SCRIPT ><p>B<style>a<b</style></article><p>it's</body>"
    assert html.main_text(page) == "A\nB"
    assert [b.text for b in html.blocks_of(f"<p>A<script>{code}</script> tail")] == ["A tail"]


@pytest.mark.parametrize("name", sorted(html.SKIPPED))
def test_html_after_unclosed_elements(name):
    assert html.main_text(f"<article><p>A</p><{name} src=x><p>B</p></article>") == "A\nB"
    if name not in html.VOID:
        assert html.main_text(f"<article><p>A</p><{name}><p>B</p><{name}>x</{name}><p>C</p></article>").split("\n") == (["A", "C"] if name in html.RAW_END else ["A", "B", "C"])
        assert html.main_text(f"<article><p>A</p><{name}>x</{name}><p>C</p></article>") == "A\nC"


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    c = tokens.TokenConfig(public_tokenizers.path("byte_bpe_50k.json"))
    assert tokens.token_table(spark, none, c).count() == 0
    assert fingerprint.fingerprint_documents(spark, none).count() == 0
    assert pieces.encode_documents(none, pieces.PieceConfig(public_tokenizers.path("piece_bpe_32k.model"))).count() == 0
    assert langid.identify(spark, none, none.select("lang", "text")).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert html.extract_pages(pages).count() == 0 and warc.archived_pages(spark, pages).count() == 0
    assert vectors.vector_links(spark, spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_repeated_and_null_rows_of_token_files(spark):
    c = tokens.TokenConfig(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [(1, "a b"), (1, "a b"), (None, "c"), (2, None), (3, "<|endoftext|> x")]
    got = tokens.token_table(spark, spark.createDataFrame(rows, "doc_id long, text string"), c).collect()
    assert sorted(r["doc_id"] for r in got if r["doc_id"] is not None) == [1, 1, 2, 3] and len(got) == 5
    by_start = sorted((r["start"], r["n_tokens"]) for r in got)
    assert all(a + n == b for (a, n), (b, _) in zip(by_start, by_start[1:])) and next(r["start"] for r in got if r["doc_id"] is None) == 0
