"""Operators against plain versions of what they compute, and their defined results at the edges."""

import hashlib
import io
import math
import random
import time
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestar.llm import common, fingerprint, html, langid, lm, minhash, mixing, pieces, queries, tokens, vectors, warc

R = random.Random(11)
WORDS = ["".join(R.choices("abcdefgh", k=R.randint(2, 6))) for _ in range(80)]
LONG = " ".join(R.choices(WORDS, k=30_000))
PIECES = pieces.PieceConfig(public_tokenizers.path("piece_bpe_32k.model"))
TOKENS = tokens.TokenConfig(public_tokenizers.path("byte_bpe_50k.json"))


def prose(n):
    return " ".join(R.choices(WORDS, k=n))


BASE = prose(200)
NEAR = " ".join([*BASE.split()[:196], "zz", "yy", "xx", "ww"])
# doc_id, text, lang, source: repeats of rows and ids, nulls, blanks, ties, copies, one very long text
ROWS = [
    (5, BASE, "en", "a"), (5, BASE, "en", "a"), (5, prose(50), "en", "b"), (7, NEAR, "de", "b"), (9, BASE, None, None), (None, BASE, "en", "a"), (None, None, "en", "a"),
    (11, "", "de", "b"), (12, " \n\t", "de", "b"), (13, LONG, "en", "a"), (14, "ab cd", "en", "c"), (15, "Ab  CD", "en", "c"), (16, None, None, None), *[(20 + i, prose(40 + i), "en", "abc"[i % 3]) for i in range(24)],
]
NAMES = "doc_id long, text string, lang string, source string, n_chars int, p int, key long, copies int, _id long, _copies int, _copy int, score double, _score string, _lang_pred string, text_ string, rank int, h long"


def frame(spark, rows=ROWS):
    """Documents with columns whose names clash with those that operators use."""
    return spark.createDataFrame([(i, t, x, s, len(t or ""), 1, 2, 3, 4, 5, 6, 0.5, "s", "l", "t", 7, 8) for i, t, x, s in rows], NAMES)


def shingles(text, k=5):
    ws = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)} if len(ws) >= k else ({tuple(ws)} if ws else set())


def test_minhash(spark):
    rows = [r for r in ROWS if r[0] is not None]
    got = minhash.minhash_components(spark, frame(spark), minhash.MinHashConfig(percent=85)).collect()
    assert len(got) == len(ROWS) and sum(r["doc_id"] is None and r["component_id"] is None for r in got) == 2
    sets = [shingles(t) for _, t, _, _ in rows]
    comp = {i: i for i, *_ in rows}
    for _ in rows:
        for (i, *_), a in zip(rows, sets):
            for (j, *_), b in zip(rows, sets):
                if a and b and 100 * len(a & b) >= 85 * len(a | b):
                    comp[i] = comp[j] = min(comp[i], comp[j])
    assert {(r["doc_id"], r["component_id"]) for r in got if r["doc_id"] is not None} == set(comp.items())
    assert sorted((r["doc_id"], r["n_shingles"]) for r in got if r["doc_id"] is not None) == sorted((r[0], len(s)) for r, s in zip(rows, sets))
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got if r["doc_id"] is not None)


def test_tokens(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENS.tokenizer)
    edge = ["it's 'sabc 'll've x's\n\n y", "a'", "'", "''s", " \t x", "a　b \x85c", "<|endoftext|> x's", "日本🎉 ½", "x" * 70_000]
    rows = [*ROWS, *[(100 + i, x, None, None) for i, x in enumerate(edge)]]
    got = tokens.token_table(spark, frame(spark, rows), TOKENS).collect()
    ids = [(i, np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4")) for i, x, _, _ in rows]
    assert sorted(map(str, ((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got))) == sorted(str((i, len(x), zlib.crc32(x.tobytes()))) for i, x in ids)
    place = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == place
        place += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda x: (x is not None, x or 0))


def test_fingerprints(spark):
    got = fingerprint.fingerprint_documents(spark, frame(spark), fingerprint.FingerprintConfig(range_bytes=4000))
    order = sorted(ROWS, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, (r[1] or "").encode()))
    texts = [t or "" for _, t, _, _ in order]
    after = [*texts[1:], texts[0]]
    edited = [fingerprint.edited_text(a, b) for a, b in zip(texts, after)]
    assert edited[0] == (texts[0][: len(texts[0]) - len(texts[0]) // 3] + after[0][: len(texts[0]) // 3] if len(texts[0]) > 2 else texts[0])
    c = fingerprint.FingerprintConfig()

    def like(a, b):
        d, cut = fingerprint.unit_digests([a, b], c)
        x, y = d[: cut[1]], d[cut[1] :]
        return 1 - len(np.setxor1d(x, y)) / max(1, len(x) + len(y))

    want = [(i, len(t), hashlib.sha256(e.encode()).hexdigest(), like(t, e), like(t, n)) for (i, *_), t, e, n in zip(order, texts, edited, after)]
    rows = [(r["doc_id"], r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"]) for r in got.collect()]
    assert sorted(map(str, rows)) == sorted(map(str, want))


def mix_by_hand(rows, c):
    size = [len((t or "").split()) for _, t, _, _ in rows]
    names = sorted({s for *_, s in rows if s is not None}) + ([None] if any(s is None for *_, s in rows) else [])
    total = {s: sum(n for n, r in zip(size, rows) if r[3] == s) for s in names}
    weight = {s: c.weights[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, list(names), c.share * sum(size)
    while free:
        level = left / sum(weight[s] for s in free)
        full = [s for s in free if level * weight[s] > c.most * total[s]]
        if not full:
            target |= {s: level * weight[s] for s in free}
            break
        for s in full:
            target[s], left = c.most * total[s], left - c.most * total[s]
            free.remove(s)
    taken = []
    for s in names:
        mine = [k for k, r in enumerate(rows) if r[3] == s]
        mean, ratio = total[s] / len(mine), target[s] / total[s] if total[s] else 0
        q = {k: size[k] / (size[k] + mean) if size[k] else 0 for k in mine}
        middle = sum(size[k] * q[k] for k in mine) / max(1, total[s])
        e = {k: min(c.most, max(0, ratio + c.tilt * max(0, min(ratio, c.most - ratio)) * (q[k] - middle))) if size[k] else 0 for k in mine}
        want = target[s] - sum(size[k] * math.floor(e[k]) for k in mine)
        ranks = []
        for k in mine:
            p = e[k] - math.floor(e[k])
            i, t = rows[k][:2]
            key = "null" if t is None else hashlib.md5(t.encode()).hexdigest()
            u = (int(hashlib.md5(f"{c.seed}:{'null' if i is None else i}:{key}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
            if p > 0:
                ranks.append(((u / (1 - u)) / (p / (1 - p)), size[k], i if i is not None else -1, k))
        copies = {k: math.floor(e[k]) for k in mine}
        sums, open_ = 0, []
        for _, n, _, k in sorted(ranks):
            sums += n
            if sums <= want:
                copies[k] += 1
            else:
                open_.append(k)
        gap = target[s] - sum(size[k] * copies[k] for k in mine)
        spare = [(abs(size[k] - gap), r[0], k) for r in sorted(ranks) for k in [r[3]] if k in open_ and size[k] < 2 * gap]
        if spare:
            copies[min(spare)[2]] += 1
        taken += [(rows[k][0], size[k], total[s], round(target[s], 6), size[k] * copies[k]) for k in mine]
    return taken


@pytest.mark.parametrize("share", [0.2, 1.5])
def test_mix(spark, share):
    c = mixing.MixConfig(share=share)
    rows = [r for i, r in enumerate(ROWS) if r[:2] != ROWS[0][:2] or i == 0]  # repeats are told apart below
    got = mixing.mix_plan(spark, frame(spark, rows), c).collect()
    assert sorted(map(str, ((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in got))) == sorted(map(str, mix_by_hand(rows, c)))
    assert all(r["taken"] <= 2 * r["size"] for r in got)


def test_mixed_documents_take_what_the_plan_says(spark):
    docs = frame(spark, ROWS * 2)
    plan = mixing.mix_plan(spark, docs)
    got = mixing.mixed_documents(spark, docs)
    assert got.columns == docs.columns and got.count() == plan.where("size > 0").agg(F.sum("copies")).first()[0]
    words = got.groupBy("source").agg(F.sum(F.regexp_count("text", F.lit(r"\S+"))).alias("n")).collect()
    taken = {r["source"]: r["taken"] for r in plan.groupBy("source").agg(F.sum("taken").alias("taken")).collect()}
    assert {r["source"]: r["n"] for r in words} == {s: n for s, n in taken.items() if n}
    assert mixing.mixed_documents(spark, frame(spark, [(1, "", "x", "s"), (2, None, "x", "s")])).count() == 0


def test_lm_score_is_the_log_probability_of_a_proper_distribution(spark):
    c = lm.LmConfig(words=32, members=16, head=40, hidden=6, lanes=4, window=5)
    col = pa.array([t for _, t, _, _ in ROWS if t != LONG])
    h, k, _ = lm.tokens_of(col)
    u, first, n = np.unique(h, return_index=True, return_counts=True)
    order = np.lexsort((u, -n))[: c.head]
    lex = lm.Lexicon(c, u[order], n[order], k[first][order], np.bincount(k, minlength=65), np.bincount(k[first], minlength=65), len(h), len(u))
    net = lm.GatedNet(lex)
    before = net.score(*lm._sequences(lex, col)).sum()
    for _ in range(30):
        lm.Trainer(net, c).run(*lm._sequences(lex, col))
    seq = lm._sequences(lex, col)
    assert net.score(*seq).sum() > before
    for text in (3, 10):
        a, b = seq[3][text], seq[3][text + 1]
        state, total = np.zeros((1, net.h)), 0.0
        for t in range(a, b):
            gates = net.G[:, [net.start if t == a else seq[0][t - 1]]] + net.b
            x = state @ net.U.astype(float)
            z, r = (1 / (1 + np.exp(-(gates[i] + x[i]))) for i in (0, 1))
            cand = np.tanh(gates[2] + r * x[2])
            state = (1 - z) * cand + z * state
            top = np.exp(state @ net.C + net.bc)[0]
            total += math.log(top[seq[1][t]] / top.sum())
            if seq[2][t] >= 0:
                inner = np.exp(state @ net.M[seq[1][t]] + net.bm[seq[1][t]])[0]
                total += math.log(inner[seq[2][t]] / inner.sum())
        assert math.isclose(net.score(*seq)[text], total, rel_tol=1e-4)
    # gradient of one window's mean loss against differences
    grads = {}
    trainer = lm.Trainer(net, c)
    trainer._adam = lambda grad, symbols: grads.update(grad, symbols=symbols)
    x = [v[: len(v) // 4 * 4].reshape(-1, 4) for v in (seq[0][:80], seq[1][1:81], seq[2][1:81], np.zeros(80, bool))]
    state = np.zeros((4, net.h), np.float32)
    trainer._window(*x, state)

    def loss():
        got = []
        s = state
        for t in range(len(x[0])):
            s = net.step(net.G[:, x[0][t]] + net.b, s)[0]
            got.append(net.log_probs(s, x[1][t], x[2][t]))
        return -np.concatenate(got).mean()

    for name, at in (("U", (2, 1, 3)), ("U", (0, 2, 2)), ("b", (1, 0, 4)), ("C", (2, 0)), ("M", (0, 1, 2)), ("bc", (1,)), ("G", None)):
        w = getattr(net, name)
        spot, want = ((1, grads["symbols"][0], 2), grads["G"][1, 0, 2]) if at is None else (at, grads[name][at])
        old, eps = w[spot], 1e-2
        w[spot] = old + eps
        up = loss()
        w[spot] = old - eps
        assert math.isclose((up - loss()) / (2 * eps), want, abs_tol=2e-4, rel_tol=0.05)
        w[spot] = old


def test_lm_edges(spark):
    c = lm.LmConfig(words=32, members=16, head=10, hidden=6)
    got = lm.score_documents(spark, frame(spark), c).collect()
    assert len(got) == len(ROWS) and sum(r["n_tokens"] for r in got) == sum(len((t or "").split()) + 1 for _, t, _, _ in ROWS)
    assert all(math.isfinite(r["score"]) and r["score"] <= 0 for r in got)
    assert lm.score_documents(spark, frame(spark, []), c).count() == 0
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0][:3]
    alone = lm.score_documents(spark, frame(spark, [(i, "a b", "x", "s") for i in held]), c).collect()
    assert all(r["held_out"] and r["train_tokens"] == 0 and r["n_known"] == 0 for r in alone)


def test_frequent_words_are_cut_by_count(spark):
    counts = spark.createDataFrame([(i, 0, 100 - i) for i in range(60)], "h long, cls int, n long")
    got = [r["n"] for r in lm.frequent(counts, 20).collect()]
    assert 0 < len(got) <= 20 and min(got) > max({100 - i for i in range(60)} - set(got))
    assert lm.frequent(counts, 1000).count() == 60


def test_pieces_take_the_best_path():
    m = pieces.piece_model(PIECES)
    names = {}
    for i, s in zip(m.ids, m.scores):
        names[m.bytes_of[i].replace(b" ", pieces.MARK.encode())] = float(s)

    def best(raw):
        top = [0.0] + [-math.inf] * len(raw)
        for e in range(1, len(raw) + 1):
            for s in range(max(0, e - m.longest), e):
                if raw[s:e] in names and (s == 0 or raw[s] & 0xC0 != 0x80):
                    top[e] = max(top[e], top[s] + names[raw[s:e]])
                if len(raw[s:e].decode("utf-8", "ignore")) == 1 and len(raw[s:e].decode("utf-8", "ignore").encode()) == e - s:
                    top[e] = max(top[e], top[s] + m.unknown)
        return top[-1]

    id_score = dict(zip(m.ids.tolist(), m.scores.tolist()))
    for text in ["hello world", "日本🎉x", "aaaa", "é" * 9, "the  quick", *WORDS[:20], "x" * 300]:
        for chunk in m.chunks(" " + text):
            raw = chunk.replace(" ", pieces.MARK).encode()
            a, b = m._solve([raw])[0], m._solve_long(raw)
            assert a.tolist() == b.tolist()
            spent = sum(id_score.get(int(i), 0) for i in a)
            lone = [int(i) for i in a if int(i) not in id_score]
            chars = len(b"".join(m.bytes_of[i] for i in lone).decode("utf-8"))
            assert math.isclose(spent + chars * m.unknown, best(raw), rel_tol=1e-9)


def test_pieces_of_long_words_and_clashing_columns(spark):
    m, word = pieces.piece_model(PIECES), "abcdefghij" * 20_000
    began = time.process_time()
    assert m.decode(m.encode(word)) == word and time.process_time() - began < 10
    got = pieces.encode_documents(frame(spark), PIECES).collect()
    assert sorted(r["decoded"] for r in got) == sorted(t or "" for _, t, _, _ in ROWS)


def test_vectors_link_as_brute_force(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(500, 64))
    x[100:300] = x[:4].repeat(50, axis=0) + r.normal(size=(200, 64)) * r.uniform(0.1, 0.6, size=(200, 1))
    x[300:320] = x[100] * r.uniform(0.1, 5, size=(20, 1))
    x[320:330] = x[5]
    odd = [(600, None), (601, []), (602, [0.0] * 64), (603, [float("nan")] * 64), (604, [float("inf")] * 64), (605, [None] * 64), (606, [1.0, 2.0]), (607, [1.0, 2.0]), (None, [1.0] * 64)]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + odd + [(3, x[3].tolist())]
    table = spark.createDataFrame([(i, v, 1, 2, "k", 3) for i, v in rows], "vec_id long, embedding array<double>, rep long, cls long, key string, links long")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    cos = np.vstack([u, u[3]]) @ np.vstack([u, u[3]]).T
    links = (cos >= 0.9).sum(axis=1) - 1
    comp = np.append(np.arange(500), 3)
    for _ in range(30):
        comp = np.array([comp[row].min() for row in cos >= 0.9])
    for c in (vectors.VectorConfig(exact=True, block=64), vectors.VectorConfig(per_bucket=8, block=32)):
        got = vectors.vector_links(spark, table, c).collect()
        assert len(got) == len(rows)
        seen = {(q["vec_id"], q["n_links"], q["component_id"]) for q in got if q["vec_id"] is not None and q["vec_id"] < 500}
        want = {(int(i), int(n), int(k)) for i, n, k in zip(np.append(np.arange(500), 3), links, comp)}
        if c.exact:
            assert seen == want
        else:
            assert sum(n for _, n, _ in seen) >= 0.98 * sum(n for _, n, _ in want)
        alone = {q["vec_id"]: (q["n_links"], q["kept"]) for q in got if q["vec_id"] is None or q["vec_id"] >= 600}
        assert alone == {i: (0, True) for i in (*range(600, 606), None)} | {606: (1, True), 607: (1, False)}
    u = vectors._units(x.tolist())
    codes = vectors.encode(u, vectors.VectorConfig())
    value, bound = vectors.estimates(codes, codes, 4.0)
    off = (value - u @ u.T)[~np.eye(500, dtype=bool)]
    assert abs(off.mean()) < 0.01 and (np.abs(value - u @ u.T) <= bound).mean() > 0.999


def test_warc_against_a_plain_reading(spark):
    rows = [(1, "u", "a"), (2, "v\r\nX: y", "a"), (3, None, None), (None, "w", ""), (2, "u", "a"), (8, "z", "é" * 300_000), (9, "z", "é" * 300_000), (4, "u", "b"), (4, "u", "b")]
    pages = spark.createDataFrame([(i, u, h, "k", 1, "s") for i, u, h in rows], "page_id long, url string, html string, keeper string, place int, sha string")
    got = sorted(((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in warc.archived_pages(spark, pages).collect()), key=str)
    import base64

    want = []
    for body in {(h or "") for *_, h in rows}:
        mine = sorted((r[0] for r in rows if (r[2] or "") == body), key=lambda x: (x is not None, x or 0))
        raw = body.encode()
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        want += [(i, "revisit", mine[-1], len(raw), digest) for i in mine[:-1]] + [(mine[-1], "response", None, len(raw), digest)]
    assert got == sorted(want, key=str)


def test_warc_reader_passes_over_damage():
    member = lambda i: warc.gzip_member(warc.record([("WARC-Type", "response"), ("X-Page-ID", str(i)), ("X-Long", "h" * 9000)], b"body%d" % i * 500))
    bad = bytearray(member(1))
    bad[len(bad) // 2] ^= 0xFF
    data = member(0) + bytes(bad) + member(2) + member(3)[:-9]
    for cut in (61, 1 << 20):
        got = [warc.parse_record(x)[0]["x-page-id"] for a in range(0, len(data), cut) for _, x in warc.members_in(io.BytesIO(data), a, a + cut)]
        assert got == ["0", "2"]


def phrases_by_hand(text, learnt, start=0):
    n = 0
    while start < len(text):
        k = 1
        while start + k <= len(text) and text[start : start + k] in learnt:
            k += 1
        start += max(1, k - 1)
        n += 1
    return n


@pytest.mark.parametrize("text", ["the xqxq cat", "das ist wie qualm", "the cat", "ñ", "hund the ñandú qq"])
def test_language_phrases_are_those_of_a_direct_parse(text):
    texts = {"en": "the cat and the dog of the house is in it", "de": "der hund und die katze ist in dem haus wie das"}
    m = langid.LangModel(langid.LangConfig(), texts)
    lanes = m.classes(text)[:, None]
    assert m.phrases(lanes)[:, 0].tolist() == [phrases_by_hand(text, texts[k]) for k in sorted(texts)]
    want = [phrases_by_hand(text, texts[k]) * math.log2(len(texts[k]) + 2) for k in sorted(texts)]
    assert m.predict([text])[0] == [sorted(texts)[int(np.argmin(want))]]


def test_language_edges(spark):
    rows = [(1, "the cat and the dog", "en", None), (2, None, "en", None), (3, " 12 ", "de", None), (4, "q " * 100_000, None, None)] * 2
    got = langid.identify(spark, frame(spark, rows), frame(spark, rows)).collect()
    assert len(got) == 8 and {(r["doc_id"], r["_lang_pred"], r["_score"]) for r in got} == {(1, "en", 1.0), (2, "und", 0.0), (3, "und", 0.0), (4, "en", 1.0)}
    none = langid.identify(spark, frame(spark, rows), frame(spark, [])).collect()
    assert {(r["_lang_pred"], r["_score"]) for r in none} == {("und", 0.0)}
    many = frame(spark, [(i, f"der hund {i} und katze", "de", None) for i in range(3000)] + [(5000, "the house", "en", None)])
    assert set(langid.training_texts(many, langid.LangConfig(rows=5))) == {"de", "en"}


PARA = "The first of the lines that is in the text of this page and it has more words to go on with than that."
RUSSIAN = "Сегодня утром в городе открылась новая библиотека, и жители смогли увидеть редкие книги, собранные за сто лет. " * 2


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f'<body><div class="page with-sidebar"><p>{PARA}</p><div class="sidebar"><p>{PARA[:50]}</p></div></div>', PARA),
        (f'<div class="sidebar-layout"><h1 class="post-header">Head</h1><p>{PARA}</p></div><div class="comments"><p>{PARA}</p><p>{PARA}</p></div>', f"Head\n{PARA}"),
        (f"<nav><a href=x>Главная</a></nav><h1>Заголовок</h1><p>{RUSSIAN}</p><footer>Подвал</footer>", f"Заголовок\n{RUSSIAN.strip()}"),
        ('<article><p class="a>one</p><p class="b">two</p><p title="a > b">three</p></article>', "one\ntwo\nthree"),
        ("<article><p>A</p><noscript><p>B</p></article>", "A\nB"),
        ("<article>x <!-- y <p>z</article>", "x z"),
        ("<article>a < b</article><p", "a < b"),
    ],
)
def test_main_text_of_odd_pages(page, want):
    assert html.main_text(page) == want


@pytest.mark.parametrize("part", ['<a "', "<a ", "<!--", '<p class="', '<a =">', "<b x='\">", "<div>", "<script>", "<"])
def test_main_text_takes_time_in_proportion(part):
    took = []
    for n in (20_000, 80_000):
        began = time.process_time()
        html.main_text(part * n)
        took.append(time.process_time() - began)
    assert took[1] < 10 * took[0] + 0.2


def test_main_text_of_long_and_repeated_pages(spark):
    page = "<article>" + "".join(f"<p>{PARA} {i}</p>" for i in range(20_000)) + "</article>"
    rows = [(1, "u", page, 1, "t"), (1, "u", page, 1, "t"), (None, None, None, 2, "t")]
    got = html.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int, text string")).collect()
    assert sorted(r["n_chars"] for r in got)[0] == 0 and [r["text"].count("\n") for r in got if r["page_id"]] == [19_999] * 2


def test_pipeline_stages(spark, tmp_path):
    near = [(30 + i, " ".join(["word", *BASE.split()]), "en", "a") for i in range(3)]
    docs = frame(spark, ROWS + near)
    found = corpus_pipeline.keep_identified(spark, docs, "")
    assert found.columns == list(corpus_pipeline.COLUMNS) and found.count() == sum(any(c.isalpha() for c in t or "") for _, t, _, _ in ROWS + near)
    found.write.parquet(str(tmp_path / "a"))
    found = spark.read.parquet(str(tmp_path / "a"))
    kept = corpus_pipeline.keep_distinct(spark, found, "")
    assert kept.columns == list(corpus_pipeline.COLUMNS)
    # groups by brute force at 0.8; rows of a doc_id with different texts are documents of their own
    rows = sorted({(i, t) for i, t, _, _ in ROWS + near if any(c.isalpha() for c in t or "")}, key=lambda r: (r[0] is None, r[0] or 0))
    sets, group = [shingles(t) for _, t in rows], list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            for b in range(len(rows)):
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    group[a] = group[b] = min(group[a], group[b])
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in kept.collect()))) == sorted(str(rows[g]) for g in set(group))
    kept.write.parquet(str(tmp_path / "b"))
    kept = spark.read.parquet(str(tmp_path / "b"))
    mixed = corpus_pipeline.mix_sources(spark, kept, "")
    assert mixed.columns == list(corpus_pipeline.COLUMNS) and mixed.count() == mixing.mix_plan(spark, kept).where("size > 0").agg(F.sum("copies")).first()[0]
    last = corpus_pipeline.encode(spark, mixed, "").collect()
    texts = {}
    for r in mixed.collect():
        texts.setdefault(r["doc_id"], set()).add(hashlib.sha256(r["text"].encode()).hexdigest())
    assert len(last) == mixed.count() and all(r["decoded_sha256"] in texts[r["doc_id"]] for r in last)


def test_pipeline_of_nothing(spark, tmp_path):
    frame(spark, []).select(*corpus_pipeline.COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "minhash_dedup", "source_mix", "piece_encoding"]


def test_shared_folder_must_be_named_on_a_cluster(spark, monkeypatch):
    class Conf:
        get = staticmethod(lambda *a: None)

    class Session:
        conf = Conf
        sparkContext = type("C", (), {"master": "spark://host:7077", "getConf": staticmethod(lambda: Conf)})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session)


def test_every_query_has_sql_or_a_test():
    assert len(queries.queries()) == 10 and set(queries.oracle_sql()) <= set(queries.queries())
