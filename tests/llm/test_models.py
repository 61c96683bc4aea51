"""Subwords, token files, HTML, languages, LM scores and embeddings against their libraries, brute force and held-out data."""

import hashlib
import random
import zlib

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from maskquery.llm import embedding_dup, html_text, language, lm_score, near_dup, subwords, token_store

ODD = [
    "",
    "<|endoftext|>",
    "x<|endoftext|><|endoftext|> y <|endof <|startoftext|>",
    "aaaaaaaaaaaaaaaaaa",
    "  \n\n  a  b\t\tc 's 'll don't 'LL  ",
    "日本語のテキスト。中文字",
    "😀😀 é՘ ֋1౜ J̌ İstanbul ΣΑΣ ß ª²¼ \x1c\x85　x",
    "a" * 2000,
]


@pytest.fixture(scope="module")
def docs(spark):
    return brute.documents(spark).cache()


@pytest.fixture(scope="module")
def pairs(docs):
    return [tuple(r) for r in docs.select("doc_id", "text").collect()]


def library(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(subwords.vocabulary_path(name))
    t.no_padding()
    t.no_truncation()
    return t


def by_library(name, texts):
    t = library(name)
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def cut(ids, at):
    return [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_merges_equal_the_library(texts):
    m = subwords.merges(subwords.VOCABULARY)
    ids, at = m.encode(texts)
    assert cut(ids, at) == by_library(subwords.VOCABULARY, texts)
    assert [t.decode() for t in m.decode(ids, at)] == texts


def test_merges_on_odd_texts():
    m = subwords.merges(subwords.VOCABULARY)
    r = random.Random(1)
    texts = ODD + ["".join(r.choice("theaonin ") for _ in range(3000)), "".join(r.choice("ab") for _ in range(3000))]
    ids, at = m.encode(texts)
    assert cut(ids, at) == by_library(subwords.VOCABULARY, texts)
    assert m.decode(np.array([[i for i in range(m.size) if m.bytes_flat[m.bytes_at[i]] == 0xC3][0]]), np.array([0, 1]))[0].decode() == "�"


def test_encode_and_decode_query(spark, docs, pairs):
    got = sorted(map(tuple, subwords.encoded(docs).collect()))
    texts = [t or "" for _, t in pairs]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == sorted((d, len(i), sha(",".join(map(str, i))), sha(t)) for (d, _), i, t in zip(pairs, by_library(subwords.VOCABULARY, texts), texts))
    assert subwords.encoded(brute.empty(spark)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_words_equal_the_library(texts):
    ids, at = token_store.words(token_store.VOCABULARY).encode(texts)
    assert cut(ids, at) == by_library(token_store.VOCABULARY, texts)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**40), max_size=300))
def test_codes_round_trip_and_random_access(ids):
    x = np.array(ids, np.int64)
    levels = token_store.Levels.pack(x)
    back = token_store.Levels.load(len(x), levels.dump())
    order = np.random.default_rng(1).permutation(len(x))
    assert (back.at(order) == x[order]).all()


def test_token_files(spark, docs, pairs, tmp_path_factory, monkeypatch):
    import tempfile

    monkeypatch.setattr(token_store, "SHARD_TOKENS", 5000)
    monkeypatch.setattr(token_store, "RANGE_ROWS", 40)
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/tokens"
    token_store.write_tokens(docs, path)
    assert spark.read.parquet(path).count() > 5
    got = token_store.documents_of(token_store.read_tokens(spark, path)).orderBy("start").collect()
    order = sorted(pairs, key=lambda r: (r[0], r[1] or ""))
    start, want = 0, []
    for (d, _), ids in zip(order, by_library(token_store.VOCABULARY, [t or "" for _, t in order])):
        ids = [*ids, 2]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert list(map(tuple, got)) == want


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x:"</p>"}</style><script>var a = "<p>no</p>";</script></head><body class="page">
<header><p>Site</p></header><nav><ul><li><a href="/x>y">menu</a><li>two</ul></nav><!-- <p>hidden</p> --><div class="cookie-notice">We use cookies</div>
<article><header><h1>A &amp; B</h1></header><p>One<b> two</b>&nbsp;&#8211;
 three<br>four<p>five <i>six</i></p><aside>see also</aside><form><p>mail</p></form><div id="comments"><p>first!</p></div><pre>a   b</pre><p class="lead">End &lt;p&gt; &unknown; &am</article>
<div class="sidebarAd ads"><p>buy</p></div><footer>(c)</footer></body></html>"""


def test_html_blocks():
    assert [t for r, t in html_text.blocks(PAGE) if r == html_text.ARTICLE] == ["A & B", "One two – three four", "five six", "a b", "End <p> &unknown; &am"]
    assert not [t for r, t in html_text.blocks(PAGE) if r == html_text.OPEN]
    assert html_text.blocks("") == [] and html_text.blocks("<p") == [] and html_text.blocks("<!-- x") == []
    framed = '<body class="nav-open"><div class="content has-sidebar"><article class="post ad-free comments-open"><p>kept</p></article></div><div role="complementary">x</div>'
    assert [t for r, t in html_text.blocks(framed) if r != html_text.CHROME] == ["kept"]
    assert html_text.blocks("plain") == [(html_text.OPEN, "plain")]


def test_host_suffix_array(spark):
    notice = "this very site keeps a long notice on each and every page"
    rows = [(i, f"https://a.org/{i}", f"<p>{notice} today</p><p>own words of page number {i} and {'z' * (i + 1)} only here</p><p>short</p>") for i in range(4)]
    rows += [(9, "https://b.org/", f"<p>{notice}</p>"), (10, None, None), (11, "x", ""), (12, "https://a.org/4", "<article><p>" + notice + "</p></article>"), rows[0]]
    got = {r.page_id: r.text for r in html_text.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {**{i: f"own words of page number {i} and {'z' * (i + 1)} only here" for i in range(4)}, 9: notice, 10: "", 11: "", 12: notice}
    assert html_text.extracted(brute.empty(spark, "page_id long, url string, html string")).count() == 0


def test_html_query_counts_code_points(spark):
    r = html_text.op4_html_extraction(spark, brute.SF).collect()
    assert len(r) == 50 and all(x.n_chars == len(x.text) > 0 and "<" not in x.text for x in r)


def test_language_on_held_out_documents(spark):
    r = language.op2_language_id(spark, brute.SF).join(spark.read.parquet(f"{brute.SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [x for x in r if x.held_out]
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 4 == 2) for x in r)
    assert len(held) > 20 and sum(x.lang == x.lang_pred for x in held) / len(held) > 0.95


def test_language_spans_and_edges(spark, docs):
    model = language.learn(docs.filter("lang is not null"))
    by = {r.lang: r.text for r in docs.filter("doc_id < 200 and n_chars > 400").collect()}
    mixed = " ".join(by["en"].split()[:40] + by["de"].split()[:40])
    rows = [(1, mixed), (2, None), (3, ""), (4, "12 -- !?"), (5, "¿¡ “”"), (6, "日本"), (6, "日本"), (None, by["fr"])]
    got = language.labelled(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    spans = got[0].spans
    assert [s.lang for s in spans] == ["en", "de"] and abs(spans[0].to - 40) < 8 and 0.3 < got[0].score < 0.7
    assert [(x.lang_pred, x.score) for x in got[1:5]] == [("und", 0.0)] * 4
    assert got[5].lang_pred in model.names and got[5][1:] == got[6][1:] and got[7].lang_pred == "fr"
    nothing = language.learn(brute.empty(spark))
    assert [x.lang_pred for x in language.labelled(docs.limit(3), nothing).collect()] == ["und"] * 3


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(4)
    for _ in range(20):
        n = rng.integers(1, 6, 4)
        score = rng.normal(size=(n.sum(), 3)).astype(np.float32) * 3
        first = np.cumsum(n) - n
        got = language.viterbi(score, first, n, 2.0)

        def value(path, a):
            return sum(score[a + i, p] for i, p in enumerate(path)) - 2.0 * sum(x != y for x, y in zip(path, path[1:]))

        import itertools

        for a, k in zip(first, n):
            best = max(value(p, a) for p in itertools.product(range(3), repeat=int(k)))
            assert abs(value(got[a : a + k], a) - best) < 1e-4


def test_script_narrows():
    t = language._Text(np.frombuffer("abc Ελλα мир 日本 é 12".encode(), np.uint8), np.array([0, len("abc Ελλα мир 日本 é 12".encode())]))
    assert [language.SCRIPTS[s] for s in t.script] == ["latin", "greek", "cyrillic", "han", "latin", "common"]


def test_lm_baseline_and_model(spark, docs):
    plain = [(d, t) for d, t in {(r.doc_id, r.text) for r in docs.collect()}]
    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    df = spark.createDataFrame(plain, "doc_id long, text string")
    out = lm_score.scored(df, ~lm_score.held_out(df["doc_id"])).collect()
    want = brute.unigram(plain, held)
    for r in out:
        n, known, total, base = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total) and abs(r.base_score - base) < 1e-6 * max(1, abs(base))
        assert r.score < 0
    assert len(out) == len(plain)


def test_lm_probabilities_sum_to_one():
    rng = np.random.default_rng(2)
    p = {k: v + rng.normal(size=v.shape).astype(np.float32) * 0.3 for k, v in lm_score._fresh_parameters().items()}
    classes = (np.arange(60) % lm_score.CLASSES).astype(np.uint8)
    n = np.arange(60) + 1.0
    inner = np.log(n / np.bincount(classes, n, lm_score.CLASSES)[classes]).astype(np.float32)
    model = lm_score.Model(classes, inner, p)
    for length in (0, 3, 15, 16, 17, 24, 25, 40):
        before = rng.integers(0, 60, length)
        texts = np.array([[*before, last] for last in range(60)]).ravel()
        at = np.arange(61) * (length + 1)
        whole = lm_score.log_probabilities(model, texts, texts % lm_score.HASHED, at)
        start = lm_score.log_probabilities(model, before, before % lm_score.HASHED, np.array([0, length]))[0] if length else 0.0
        assert abs(np.sum(10 ** (whole - start)) - 1) < 1e-3


def test_lm_windows_score_each_id_once():
    for n in range(1, 70):
        begin, since, length = lm_score._windows(np.array([0, n]))
        places = [b + i for b, s, k in zip(begin, since, length) for i in range(s, k)]
        assert places == list(range(n))


def test_lm_spelling_is_a_distribution():
    s = lm_score.Spelling(np.array([3 * 5 + 1, 4 * 5 + 3]), np.array([2, 3]), np.array([0.0, 0, 0, 2, 3]), np.array([0.0, 0, 0, 1, 1]), np.full(5, 0.2))
    for before in range(5):
        seen = [int(s.count[np.where(s.keys == before * 5 + a)[0]].sum()) for a in range(5)]
        back = s.followers[before] + 1
        assert abs(sum((c + back * 0.2) / (s.total[before] + back) for c in seen) - 1) < 1e-9


def vectors(spark, n=300, d=20, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)).astype(np.float32)
    for i in range(n // 2):
        x[n // 2 + i] = x[i] + rng.normal(size=d).astype(np.float32) * 0.12
    x[7] = x[8] = x[9]
    rows = [(i, x[i].tolist(), i % 3 if i < 290 else None) for i in range(n)]
    rows += [(n, None, 1), (n + 1, [], 1), (n + 2, [0.0] * d, 1), (n + 3, [float("nan")] * d, 1), (n + 4, [1.0, None] * (d // 2), 1), (n + 5, [float("inf")] * d, 1), (n + 6, x[0].tolist()[:5], 0), (n + 7, [1e-30 * v for v in x[9].tolist()], 0)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_embeddings_against_brute_force(spark):
    rows, df = vectors(spark)
    ok = [i for i, (_, e, lab) in enumerate(rows) if lab is not None and e and None not in e and np.isfinite(e).all() and any(e)]
    links, comp = dict.fromkeys(range(len(rows)), 0), {i: rows[i][0] for i in range(len(rows))}
    for _ in range(6):
        for i in ok:
            for j in ok:
                if i != j and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                    a, b = (np.array(rows[k][1], np.float64) for k in (i, j))
                    if a @ b >= 0.98 * np.sqrt(a @ a) * np.sqrt(b @ b):
                        links[i] += _ == 0
                        comp[i] = comp[j] = min(comp[i], comp[j])
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dup.linked(df).collect()}
    want = {rows[i][0]: (links[i], comp[i], comp[i] == rows[i][0]) for i in range(len(rows))}
    assert sum(links.values()) > 40 and got == want
    assert embedding_dup.linked(brute.empty(spark, "vec_id long, embedding array<float>, label int")).count() == 0


def test_bucket_plan_reaches_its_recall():
    depth, tables = embedding_dup.plan(50_000, 64)
    rng = np.random.default_rng(12)
    x = rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.normal(size=(3000, 64))
    z -= (z * x).sum(1, keepdims=True) * x
    y = 0.98 * x + np.sqrt(1 - 0.98**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    met = np.zeros(3000, bool)
    for t in range(tables):
        a, b = (embedding_dup.bucket_keys(v, t, depth, np.zeros(3000, np.uint64)) for v in (x, y))
        met |= (a[:, :, None] == b[:, None, :]).any((1, 2))
    assert met.mean() > 0.998


def test_pipeline_stages_pass_columns_on(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{brute.SF}/documents.parquet")
    ids, columns = {r[0] for r in docs.select("doc_id").collect()}, docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, brute.SF).cache()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns
        got = [r[0] for r in out.select("doc_id").collect()]
        assert set(got) <= ids and len(got) == len(set(got)) > 50
        docs = out
    assert near_dup.SIMILARITY == 0.8 and corpus_pipeline.ORACLE_SQL is None
