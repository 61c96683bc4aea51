"""Decontamination, line dedup, near dedup and the quality classifier against brute force and at their edges."""

import brute
import numpy as np
import pytest

from maskquery.llm import decontamination, line_dedup, near_dup, quality, slots
from maskquery.llm import text as T


@pytest.fixture(scope="module")
def docs(spark):
    return brute.documents(spark).cache()


@pytest.fixture(scope="module")
def pairs(docs):
    return [tuple(r) for r in docs.select("doc_id", "text").collect()]


def test_hashes_do_not_depend_on_place():
    a, b = np.frombuffer(b"one two", np.uint8), np.frombuffer(b"xx  two two", np.uint8)
    h = [T.run_hashes(x, *T.bounds(T.NOT_SPACE[x], np.array([0, len(x)]))[:2]) for x in (a, b)]
    assert h[0][1] == h[1][1] == h[1][2] != h[0][0]


def test_words_do_not_cross_rows():
    data = np.frombuffer(b"abcd", np.uint8)
    s, e, row = T.bounds(T.NOT_SPACE[data], np.array([0, 2, 2, 4]))
    assert (s.tolist(), e.tolist(), row.tolist()) == ([0, 2], [2, 4], [0, 1, 1, 2])


def test_slot_map_loses_nothing(spark):
    keys = spark.range(1000).selectExpr("xxhash64(id) as k")
    assert keys.filter(slots.maybe_in(keys)("k")).count() == 1000
    df = spark.range(1000).withColumnRenamed("id", "doc_id")
    left = slots.without(df, df["doc_id"], spark.range(0, 1000, 3).withColumnRenamed("id", "gone"))
    assert sorted(r[0] for r in left.collect()) == [i for i in range(1000) if i % 3]


def test_decontamination(spark, docs, pairs):
    items = [tuple(r) for r in spark.read.parquet(f"{brute.SF}/benchmark.parquet").select("item_id", "text").collect()]
    items += [(900, None), (901, ""), (902, "one"), (903, pairs[0][1]), (904, " ".join(brute.words_of(pairs[1][1])[:4])), (905, pairs[0][1]), (905, pairs[0][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.contamination(docs, bench).collect()
    assert sorted(map(tuple, got)) == sorted(brute.contamination(pairs, items))
    bad = {(d, t) for (d, t), r in zip(pairs, brute.contamination(pairs, items)) if r[5]}
    kept = decontamination.clean(brute.documents(spark, extra=True), bench)
    assert kept.columns == brute.documents(spark, extra=True).columns
    assert sorted(map(repr, map(tuple, kept.select("doc_id", "text").collect()))) == sorted(repr(p) for p in pairs if p not in bad)


def test_decontamination_of_nothing(spark, docs):
    none = brute.empty(spark, "item_id long, text string")
    assert decontamination.contamination(docs, none).filter("contaminated or n_items > 0").count() == 0
    assert decontamination.clean(docs, none).count() == docs.count()
    assert decontamination.contamination(brute.empty(spark), none).count() == 0


def test_line_dedup(spark, docs, pairs):
    want = brute.removed_lines(pairs, line_dedup.LEAST_WORDS)
    j = line_dedup.with_removals(docs.select("doc_id", "text"))
    for r in j.collect():
        n, near, left = want[r.doc_id, r.text]
        assert (len(r.places or []), r.near or 0, r.left) == (n, near, left)
    assert sum(n for n, _, _ in want.values()) > 100 and sum(k for _, k, _ in want.values()) > 3


def test_line_dedup_keeps_columns_and_clean_documents(spark, pairs):
    wide = brute.documents(spark, extra=True)
    out = line_dedup.deduped(wide)
    assert out.columns == wide.columns
    want = brute.removed_lines(pairs, line_dedup.LEAST_WORDS)
    keep = [(d, w[2]) for d, t in pairs for w in [want[d, t]] if not w[0] or w[2].strip()]
    got = [tuple(r) for r in out.select("doc_id", "text").collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, keep))
    assert line_dedup.deduped(brute.empty(spark)).count() == 0


def test_line_dedup_settles_ties(spark):
    w = [f"w{i}" for i in range(12)]
    lines = [w, w[:-1] + ["x"], w + ["y"], w[:5] + w[6:], ["the", "the"] + w, ["the"] + w, w[:9], w[:8] + ["z"]]
    rows = [(9 - i, " ".join(x)) for i, x in enumerate(lines)] + [(None, " ".join(w)), (50, " ".join(w) + "\n" + " ".join(w))]
    got = {r.doc_id: len(r.places or []) for r in line_dedup.with_removals(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute.removed_lines([(-1 if d is None else d, t) for d, t in rows], line_dedup.LEAST_WORDS)
    assert got == {None if d == -1 else d: n for (d, _), (n, _, _) in want.items()}


def test_near_dup(spark, docs, pairs):
    got = sorted((r.doc_id, r.n_links, r.component_id) for r in near_dup.linked(docs).collect())
    assert got == sorted((d, *x) for (d, _), x in zip(pairs, brute.linked(pairs)))


def test_one_of_each(spark, pairs):
    wide = brute.documents(spark, extra=True)
    out = near_dup.one_of_each(wide)
    assert out.columns == wide.columns
    want = {d for (d, _), (_, c) in zip(pairs, brute.linked(pairs)) if c == d}
    got = [r[0] for r in out.select("doc_id").collect()]
    assert sorted(got) == sorted(want)
    assert near_dup.one_of_each(brute.empty(spark)).count() == 0


def test_near_dup_of_null_ids(spark):
    t = "a b c d e f g h i j k l m n o p"
    df = spark.createDataFrame([(None, t), (7, t), (None, t), (None, None), (None, "")], "doc_id long, text string")
    assert sorted(r.n_links for r in near_dup.linked(df).collect()) == [0, 0, 2, 2, 2]
    assert near_dup.one_of_each(df).count() == 3


def test_large_group_in_blocks(spark, monkeypatch):
    from maskquery.llm import blocks

    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base[:k] + [f"x{i}"] + base[k + 1 :])) for i, k in enumerate([55 + i % 5 for i in range(90)])]
    monkeypatch.setattr(blocks.blocks, "__defaults__", (16,))
    got = sorted((r.doc_id, r.n_links, r.component_id) for r in near_dup.linked(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(d, *x) for (d, _), x in zip(rows, brute.linked(rows))]


def test_prefixes_shorten_until_recall():
    assert near_dup.prefix_length(0.8, 12, 6, 0.9995) == 3
    assert near_dup.prefix_length(0.99, 12, 6, 0.9995) == 6
    assert near_dup.prefix_length(0.1, 2, 6, 0.9995) == 1


def test_quality_on_unseen_documents(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    seen = labels.filter("doc_id % 4 <> 0")
    out = quality.judged(docs.select("doc_id", "text", "lang", "source"), seen).select("doc_id", "verdict.*")
    r = out.join(quality.labels_of(labels.filter("doc_id % 4 = 0")), "doc_id").toPandas()
    clean, bad = r[(r.junk == 0) & (r.toxic == 0)], r[(r.junk == 1) | (r.toxic == 1)]
    assert clean.kept.mean() > 0.97 and bad.kept.mean() < 0.2


def test_quality_edges(spark):
    wide = brute.documents(spark, extra=True)
    labels = spark.createDataFrame([(1, 0, 1), (1, 1, 0), (2, None, 0), (None, 0, 0), (10**9, 0, 0)], "doc_id long, quality int, toxic int")
    out = quality.accepted(wide, labels)
    assert out.columns == wide.columns and out.count() > 0
    none = brute.empty(spark, "doc_id long, quality int, toxic int")
    assert quality.accepted(wide, none).count() == wide.count()
    assert quality.accepted(brute.empty(spark), labels).count() == 0


def test_sparse_sites_lean_on_their_parents(spark):
    rows = [("big", "en", [4.0, -9.0])] * 300 + [("big", "en", [-9.0, -9.0])] * 100 + [("small", "en", [-9.0, -9.0])] + [(f"s{i}", "en", [-9.0, -9.0]) for i in range(40)]
    w = quality.Weights(np.zeros(0, np.int64), np.zeros((2, 0)), (0.0, 0.0), (0.3, 0.1))
    r = {x.source: x.junk_rate for x in quality.site_rates(spark.createDataFrame(rows, "source string, lang string, said array<double>"), w).collect()}
    assert r["big"] > 0.6 and 0.05 < r["small"] < r["big"]
