"""Plain counterparts of the corpus operators, for small tables."""

from __future__ import annotations

import hashlib
from collections import Counter

SF = "/root/testdata/sf0.001"


def documents(spark, extra: bool = False):
    """Documents with awkward rows: null and empty texts, one very long, repeated rows, a null id; with ``extra``, clashing columns."""
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    long_text = "\n".join(t for _, t, *_ in rows[:60]) * 3
    rows += [
        (1_000_001, None, None, None, None),
        (1_000_002, "", "en", "src1", 0),
        (1_000_003, " \n\t \n", "en", "src1", 5),
        (1_000_004, long_text, "en", "src0", len(long_text)),
        (1_000_005, "One", "en", "a/b", 3),
        (1_000_006, "one", "en", "a/c", 3),
        (1_000_007, "é日本 <|endoftext|> 'll x" + "y" * 3000, "en", "a/c", 3),
        rows[5],
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    if extra:
        for c in ("digest", "places", "near", "left", "gone_at", "near_id", "text_digest", "near_digest", "said", "verdict", "Row"):
            df = df.selectExpr("*", f"doc_id as {c}")
    return df


def empty(spark, schema: str = "doc_id long, text string, lang string, source string, n_chars long"):
    return spark.createDataFrame([], schema)


def near_lines(a: list[bytes], b: list[bytes], least: int) -> bool:
    if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < least:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i:] == b[i + 1 :]


def removed_lines(rows, least: int) -> dict:
    """``{(doc_id, text): (removed, near, text left)}``, first occurrences by id and place."""
    seen, lines, out = set(), [], {}
    for doc_id, text in sorted(set(rows), key=lambda r: (r[0], r[1] or "")):
        gone = {}
        for k, line in enumerate((text or "").split("\n")):
            words = line.encode().split()
            if not words:
                continue
            if line in seen:
                gone[k] = 0
                continue
            if any(near_lines(words, w, least) for w in lines):
                gone[k] = 1
            seen.add(line)
            lines.append(words)
        left = text if text is None else "\n".join(line for k, line in enumerate(text.split("\n")) if k not in gone)
        out[doc_id, text] = (len(gone), sum(gone.values()), left)
    return out


def shingles(text) -> set:
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def linked(rows, similarity: float = 0.8) -> list[tuple[int, int]]:
    """Per row: links to other rows and the least id reachable."""
    sets = [shingles(t) for _, t in rows]
    links, comp = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and len(a & b) >= similarity * len(a | b) - 1e-9:
                links[i] += 1
                links[j] += 1
                comp[find(i)] = find(j)
    least: dict[int, int] = {}
    for i, (doc_id, _) in enumerate(rows):
        r = find(i)
        least[r] = min(doc_id, least.get(r, doc_id))
    return [(links[i], least[find(i)]) for i in range(len(rows))]


def words_of(text) -> list[str]:
    import regex

    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return regex.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def contamination(docs, items) -> list[tuple]:
    windows: dict[tuple, set] = {}
    for item, text in items:
        w = words_of(text)
        n = min(len(w), 10)
        for i in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    sizes = {len(w) for w in windows}
    out = []
    for doc_id, text in docs:
        w, hit, met = words_of(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                got = windows.get(tuple(w[i : i + n]))
                if got:
                    hit.update(range(i, i + n))
                    met |= got
        out.append((doc_id, len(w), len(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(), bool(hit)))
    return out


def unigram(docs, held_out) -> dict:
    import math

    tokens = {d: [*(t or "").encode().lower().split(), None] for d, t in docs}
    c = Counter(w for d, ws in tokens.items() if not held_out(d) for w in ws)
    n, v = sum(c.values()), len(c)
    return {d: (len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for d, ws in tokens.items()}
