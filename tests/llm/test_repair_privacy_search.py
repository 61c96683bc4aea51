"""Conversation repair, personal data and ranked search against plain counterparts, with nulls, empty tables, ties and repeated rows."""

import hashlib
import math
import re
from collections import Counter, defaultdict
from itertools import product

import brute
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from maskquery.llm import conversations, disclosure, grammar, search

# --- grammar


def expand(g, symbol):
    if symbol < g.terminals:
        return [symbol]
    return expand(g, g.left[symbol - g.terminals]) + expand(g, g.right[symbol - g.terminals])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=30), max_size=8))
def test_rules_spell_the_sequences(rows):
    first = np.cumsum([0] + [len(r) for r in rows])
    for g in (grammar.compress(np.array(sum(rows, []), np.int64), first, 4), grammar.fold(grammar.compress(np.array(sum(rows, []), np.int64), first, 4))):
        got = [sum((expand(g, s) for s in g.seq[a:b].tolist()), []) for a, b in zip(g.first[:-1], g.first[1:])]
        assert got == rows
        assert all(g.left[k] < g.terminals + lo and g.right[k] < g.terminals + lo for lo, hi in g.spans() for k in range(lo, hi))
    assert (np.diff(g.first) <= 1).all()


def test_repeats_become_rules():
    g = grammar.compress(np.array([0, 1, 2] * 40), np.array([0, 60, 120]), 3)
    assert len(g.seq) <= 4 and len(g.left) < 12


# --- conversations

PATTERN = re.compile(r"(s?(ua)+)?")


def cheapest(rows):
    """(cost, audit, roles and texts) by trying all edits; rows are (role, text, fault)."""
    best = None
    for edits in product("KRD", repeat=len(rows)):
        if any(e != "D" and r[2] in ("blank", "duplicate") for e, r in zip(edits, rows)):
            continue
        for gaps in product(range(3), repeat=len(rows) + 1):
            if sum(gaps) > 2:
                continue
            letters, audit, cost, out = [], "", 0, []
            for k in range(len(rows) + 1):
                letters += ["?"] * gaps[k]
                out += [None] * gaps[k]
                audit += "I" * gaps[k]
                cost += 5 * gaps[k]
                if k < len(rows):
                    e, (role, text, fault) = edits[k], rows[k]
                    audit += e
                    cost += {"K": 0, "R": 1, "D": 2}[e] + 5 * (e != "D" and fault == "truncated")
                    if e != "D":
                        letters.append(role[:1] or "-" if e == "K" else "?")
                        out.append((role if e == "K" else None, text))
            # what is new is user or assistant, as the pattern asks
            start = 1 if letters[:1] == ["s"] else 0
            want = ["s"] * start + ["ua"[(i - start) % 2] for i in range(start, len(letters))]
            if not PATTERN.fullmatch("".join(want)) or any(x not in ("?", y) for x, y in zip(letters, want)):
                continue
            if best is None or (cost, audit) < best[:2]:
                names = {"u": "user", "a": "assistant"}
                best = cost, audit, [(names[w], "") if o is None else (o[0] or names[w], o[1]) for o, w in zip(out, want)]
    return best


def judged(rows):
    """Rows (turn, role, text) in order with their first fault."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))
    seen, out = set(), []
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated"
        seen.add((role, text))
        out.append((role, text, fault))
    return rows, out


def digest(rows):
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in rows).encode()).hexdigest()


def test_repairs_equal_all_edits_tried(spark):
    texts, roles = ["Yes.", "No", " \n", "Why? ", "Yes.", ""], ["user", "assistant", "system", "tool", "", "ünknown", None]
    rng, rows = np.random.default_rng(5), []
    for conv in range(70):
        for _ in range(rng.integers(1, 5)):
            turn = None if rng.random() < 0.1 else int(rng.integers(0, 5))
            rows.append((conv if conv else None, turn, roles[rng.integers(0, len(roles) if conv % 2 else 3)], None if rng.random() < 0.05 else texts[rng.integers(0, len(texts))], False, 0))
    rows += [(1000, 1, "user", "Gone.", True, 0), (1001, 3, "user", "Here.", False, 0), (1001, 4, "assistant", "Gone.", True, 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, gone boolean, kind int")
    df = df.fillna(" ", ["role", "text"]).repartition(5)
    got = {r.conv_id: r for r in conversations.digests(df, conversations.audits(df)).collect()}
    whole = defaultdict(list)
    for r in conversations.repaired(df).orderBy("place").collect():
        whole[r.conv_id].append((r.role, r.text))
    assert set(got) == {r[0] for r in rows} and len(got) == 72
    for conv, r in got.items():
        mine, faults = judged([(t, ro if ro is not None else " ", x if x is not None else " ") for c, t, ro, x, gone, _ in rows if c == conv and not gone])
        cost, audit, fixed = cheapest(faults)
        turns = [t for t, *_ in mine if t is not None]
        illegal = sum((a[:1] or "-") + (b[:1] or "-") not in ("su", "ua", "au") for (a, _, _), (b, _, _) in zip(faults, faults[1:]))
        count = Counter(f for *_, f in faults)
        want = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit)
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit) == want, conv
        assert r.repaired_sha256 == digest(fixed) and whole.get(conv, []) == fixed


def by_rows(faults):
    """Cost and audit by a plain pass over the rows, for long conversations."""
    at = {0: (0, "")}
    nxt = conversations.NEXT

    def insert(at):
        out = dict(at)
        for _ in range(3):
            for p, (c, a) in list(out.items()):
                for k in "ua":
                    if p in nxt[k]:
                        q = nxt[k][p]
                        out[q] = min(out.get(q, (1 << 50, "")), (c + 5, a + "I"))
        return out

    for role, _, fault in faults:
        new = {}
        for p, (c, a) in insert(at).items():
            ways = [(p, 2, "D")]
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                if p in nxt.get(role[:1], {}):
                    ways.append((nxt[role[0]][p], more, "K"))
                ways += [(nxt[k][p], 1 + more, "R") for k in "ua" if p in nxt[k]]
            for q, price, e in ways:
                new[q] = min(new.get(q, (1 << 50, "")), (c + price, a + e))
        at = new
    return min(v for q, v in insert(at).items() if q in (0, 3))


def test_one_conversation_over_many_tasks(spark):
    rng = np.random.default_rng(9)
    rows = [(7, int(t), ["user", "assistant", "system", "x"][int(rng.integers(0, 4))], ["A.", "b", "", f"c {t}.", f"d {t}"][int(rng.integers(0, 5))], False) for t in range(4000) for _ in range(1 + (t % 9 == 0))]
    rows += [(8, 1, "user", "x.", False)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, gone boolean").repartition(6)
    got = {r.conv_id: r for r in conversations.digests(df, conversations.audits(df)).collect()}
    _, faults = judged([r[1:4] for r in rows if r[0] == 7])
    count = Counter(f for *_, f in faults)
    assert (got[7].cost, got[7].audit) == by_rows(faults)
    assert (got[7].blank, got[7].duplicate, got[7].truncated, got[7].gaps) == (count["blank"], count["duplicate"], count["truncated"], 0)
    assert (got[8].cost, got[8].audit) == (2, "D")


def test_no_conversations(spark):
    df = conversations.damaged(brute.empty(spark, "conv_id long, turn long, role string, text string"))
    assert conversations.digests(df, conversations.audits(df)).count() == 0
    assert conversations.repaired(df).count() == 0


# --- personal data

FORMS = [
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"),
    re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def check_digit(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def values(text):
    out = []
    for kind, form in enumerate(FORMS):
        for m in form.finditer(text):
            d = re.sub("[^0-9]", "", m.group())
            if kind == 1 and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == 2 and not (14 <= len(d) <= 19 and check_digit(d)) or kind == 3 and not 10 <= len(d) <= 15:
                continue
            out.append((m.start(), kind, m.end()))
    return sorted(out)


MARKS = st.one_of(*[st.text(alphabet, max_size=40) for alphabet in ("ab1.@-+ é", "0123456789 -", "12.5. 0", "+1 ()2.-a", "a@b.c_d", "4111 -0")])


@settings(max_examples=400, deadline=None)
@given(st.lists(MARKS, min_size=1, max_size=4))
def test_values_equal_the_forms(texts):
    raw = [t.encode() for t in texts]
    data, off = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw])
    got = [[] for _ in texts]
    if len(data):
        x = disclosure._Slice(data, off)
        for row, s, kind, e in x.spans:
            got[row].append((int(x.point(s, row)), kind, int(x.point(e, row))))
    assert got == [values(t) for t in texts]


def test_values_of_whole_documents(spark):
    docs = brute.documents(spark, extra=True)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = sorted((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in disclosure.digests(disclosure.found(docs)).collect())
    want = []
    for doc_id, text in rows:
        spans = values(text or "")
        count = Counter(k for _, k, _ in spans)
        shown = ",".join(f"{disclosure.KINDS[k]}:{s}:{e}" for s, k, e in spans)
        want.append((doc_id, *(count[k] for k in range(4)), hashlib.sha256(shown.encode()).hexdigest()))
    assert got == sorted(want) and sum(sum(w[1:5]) for w in want) > 10


def test_terms_that_tell(spark):
    rng = np.random.default_rng(3)
    plain = [f"w{k}" for k in range(60)]
    some = lambda n: " ".join(plain[k] for k in rng.integers(0, 60, n))
    rows = [(k, some(30)) for k in range(400)]
    rows += [(1000 + k, f"{some(12)} Zorlan {plain[k]} zl.quux@post.example.org {some(12)}") for k in range(8)]
    rows += [(2000, f"{some(6)} Zorlan {some(6)}")]  # the name without the address
    rows += [(3000 + k, f"{some(3)} only here once a.b@c.example {plain[1]}") for k in range(1)] * 50  # copies are one piece of evidence
    rows += [(4000, None), (4001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in disclosure.digests(disclosure.found(docs)).collect()}
    by_id = dict(rows)
    for k in [*range(1000, 1008), 2000]:
        at = by_id[k].index("Zorlan")
        assert f"term:{at}:{at + 6}" in got[k].spans.split(",")
    assert all("term" not in got[k].spans for k in [*range(400), 3000, 4000, 4001])
    clean = {r.doc_id: r.text for r in disclosure.sanitised(docs).collect()}
    assert "Zorlan" not in clean[2000] and "[email]" in clean[1000] and clean[4000] is None and clean[3] == by_id[3]


def test_sanitising_and_empty_tables(spark):
    assert disclosure.cleaned("call Ann at +1 22 now", [(5, 4, 8, 0.9), (12, 3, 17, 1.0)]) == "call [name] at [phone] now"
    assert disclosure.cleaned("abc", [(0, 0, 2, 1.0), (1, 1, 3, 1.0)]) == "[email]"
    assert disclosure.digests(disclosure.found(brute.empty(spark))).count() == 0


# --- search


def terms(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def ranks(docs, items):
    own = [(d, Counter(terms(t)), len(terms(t))) for d, t in docs]
    n, total = sum(k > 0 for *_, k in own), sum(k for *_, k in own)
    df = Counter(t for _, c, _ in own for t in c)
    out = []
    for item_id, text in items:
        want = Counter(terms(text))
        scored = []
        for d, c, k in own:
            score = 0
            for t, times in want.items():
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                    score += times * w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * (25 + (75 * k * n) // total)))
            if score > 0:
                scored.append((-score, d is not None, d or 0))
        out += [(item_id, k + 1, d if some else None, -s) for k, (s, some, d) in enumerate(sorted(scored)[:10])]
    return out


def test_ranks_equal_brute_force(spark):
    docs = brute.documents(spark, extra=True)
    doc_rows = [tuple(r) for r in docs.select("doc_id", "text").collect()] + [(None, "One one two"), (5_000_000, "one ONE Two")]
    docs = spark.createDataFrame([(*r, 1) for r in doc_rows], "doc_id long, text string, term long")
    items = [tuple(r) for r in spark.read.parquet(f"{brute.SF}/benchmark.parquet").select("item_id", "text").collect()]
    kind = type(items[0][0])
    items += [(kind(9001), None), (kind(9002), " .,; "), (kind(9003), "one two one"), (kind(9004), "nowhereatall"), (kind(9003), "one two one"), (None, "é日本 one"), (kind(9005), " ".join(t or "" for _, t in doc_rows[:80]))]
    item_type = spark.read.parquet(f"{brute.SF}/benchmark.parquet").schema["item_id"].dataType.simpleString()
    got = [tuple(r) for r in search.ranked(docs, spark.createDataFrame([(*i, 2) for i in items], f"item_id {item_type}, text string, score int")).collect()]
    assert Counter(got) == Counter(ranks(doc_rows, items)) and len(got) > 400


def test_queries_share_nodes():
    texts = ["the cat sat on the mat", "the cat sat on the hat", "a dog", "the cat sat"]
    data, first = "\n".join(texts), [0]
    for t in texts:
        first.append(first[-1] + len(t.split()))
    key = lambda w, salt: np.uint64(int.from_bytes(hashlib.sha256((salt + w).encode()).digest()[:8], "little"))
    words = data.split()
    plan = search.query_plan(np.array([key(w, "a") for w in words]), np.array([key(w, "b") for w in words]), np.array(first))
    atoms = sum(len(set(Counter(t.split()).items())) for t in texts)
    assert len(plan["left"]) > 0 and len(plan["seq"]) + len(plan["left"]) < atoms


def test_search_without_rows(spark):
    some = spark.createDataFrame([(1, "one")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "one")], "item_id long, text string")
    assert search.ranked(brute.empty(spark), items).count() == 0
    assert search.ranked(some, brute.empty(spark, "item_id long, text string")).count() == 0
    assert [tuple(r)[:3] for r in search.ranked(some.union(spark.createDataFrame([(2, "x"), (3, "y")], some.schema)), items).collect()] == [(1, 1, 1)]
