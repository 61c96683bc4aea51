"""Conversations whose turns were damaged: what is wrong with them, and the cheapest edits that make them well formed again.

A conversation is well formed if the first letters of its roles read ``(s?(ua)+)?``: a system turn at most, then user and assistant
in turn. Edits are Keep (0), Rerole to user or assistant (1), Delete (2, the only one for blank and duplicate rows) and Insert
an empty turn (5); a truncated row that is not deleted adds 5. Of equally cheap edit sequences the one whose initials
(the audit) sort first counts.

What the edits of a row depend on is one of nine symbols (first letter of the role, truncated or not; must go). A symbol is a
min-plus transfer matrix between the four states of the pattern, whose entries are a cost and an audit rope. Sequences of symbols
are compressed by Re-Pair (``grammar``), and the matrix of every rule is the product of two earlier ones, so what many
conversations share is evaluated once. Ties are decided inside the product: with equal cost no audit is the beginning of another one,
so the lesser of two audits stays the lesser whatever follows.

Rows are range-partitioned by conversation, turn, role and text digest, so one huge conversation is spread over tasks; each task hands on
one matrix per conversation and block of rows, which are multiplied afterwards. Only the repaired text itself, in its order, is one task's
stream per conversation: the rows pass by in sorted order behind their audit and none is held.

Defined cases: a null id or turn is a value of its own, a null role or text is one space; rows of a conversation stand by turn (null first), then role, then MD5
of the text; a role that does not begin with s, u or a (also an empty role) fits nowhere; repeated rows are duplicates; a conversation that lost all rows has
zeros, an empty audit and the digest of an empty text; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskquery.llm.grammar import Grammar, compress, fold
from maskquery.llm.store import keep

#: Rows whose symbols are compressed together in a task.
BLOCK = 1 << 16
SPACE = " \t\n\x0b\x0c\r"
NEVER = 1 << 40

START, SYSTEM, USER, ASSISTANT = range(4)
#: The states that a turn by its first letter leads to.
NEXT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
ENDS = (START, ASSISTANT)
ROLE = {USER: "user", ASSISTANT: "assistant"}
MUST_GO = 8
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5

Rope = str | tuple


def _letters(rope: Rope) -> Iterator[str]:
    stack = [rope]
    while stack:
        top = stack.pop()
        if isinstance(top, str):
            yield top
        else:
            stack += [top[1], top[0]]


def text_of(rope: Rope) -> str:
    return "".join(_letters(rope))


def _before(a: Rope, b: Rope) -> bool:
    """Whether the text of ``a`` sorts before that of ``b``, read only as far as they are equal."""
    one, two = _letters(a), _letters(b)
    x = y = ""
    while True:
        x = x or next((t for t in one if t), "")
        y = y or next((t for t in two if t), "")
        n = min(len(x), len(y))
        if not n:
            return bool(y)
        if x[:n] != y[:n]:
            return x < y
        x, y = x[n:], y[n:]


def _joined(a: Rope, b: Rope) -> Rope:
    if isinstance(a, str) and isinstance(b, str) and len(a) + len(b) <= 64:
        return a + b
    return (a, b)


def product(a_cost: np.ndarray, a_rope: list, b_cost: np.ndarray, b_rope: list) -> tuple[np.ndarray, list]:
    """Min-plus products of matrices, one after the other: costs ``(n, 4, 4)``, ropes as nested lists. Of equal costs the lesser audit stays."""
    sums = a_cost[:, :, :, None] + b_cost[:, None, :, :]
    cost = np.minimum(sums.min(axis=2), NEVER)
    best = sums == cost[:, :, None, :]
    first, ways = best.argmax(axis=2).tolist(), best.sum(axis=2).tolist()
    possible = (cost < NEVER).tolist()
    out = []
    for r in range(len(cost)):
        left, right = a_rope[r], b_rope[r]
        rows = [[None] * 4 for _ in range(4)]
        for i in range(4):
            for j in range(4):
                if not possible[r][i][j]:
                    continue
                k = first[r][i][j]
                rope = _joined(left[i][k], right[k][j])
                if ways[r][i][j] > 1:
                    for k in np.flatnonzero(best[r, i, :, j])[1:].tolist():
                        other = _joined(left[i][k], right[k][j])
                        if _before(other, rope):
                            rope = other
                rows[i][j] = rope
        out.append(rows)
    return cost, out


def _matrix(entries: dict[tuple[int, int], list[tuple[int, str]]]) -> tuple[np.ndarray, list]:
    cost, rope = np.full((1, 4, 4), NEVER, np.int64), [[None] * 4 for _ in range(4)]
    for (i, j), ways in entries.items():
        cost[0, i, j], rope[i][j] = min(ways)
    return cost, [rope]


IDENTITY = _matrix({(s, s): [(0, "")] for s in range(4)})


def _inserts() -> tuple[np.ndarray, list]:
    """Any number of inserted turns, none included; no cheapest path visits a state twice."""
    one = {(p, q): [(INSERT, "I")] for c in "ua" for p, q in NEXT[c].items()}
    step = _matrix(one | {(s, s): [(0, "")] for s in range(4)})
    return product(*product(*step, *step), *step)


INSERTS = _inserts()


def _symbol(letter: str, truncated: bool, must_go: bool) -> tuple[np.ndarray, list]:
    """Inserts before a row, then what can be done with the row."""
    ways: dict[tuple[int, int], list[tuple[int, str]]] = {(s, s): [(DELETE, "D")] for s in range(4)}
    if not must_go:
        more = TRUNCATED * truncated
        for p, q in NEXT.get(letter, {}).items():
            ways.setdefault((p, q), []).append((KEEP + more, "K"))
        for c in "ua":
            for p, q in NEXT[c].items():
                ways.setdefault((p, q), []).append((REROLE + more, "R"))
    return product(*INSERTS, *_matrix(ways))


#: Matrices of the nine symbols: twice the place of the first letter in ``sua-``, one more if truncated; then the rows that must go.
SYMBOLS = [_symbol(c, t, False) for c in "sua-" for t in (False, True)] + [_symbol("-", False, True)]


def transfer(g: Grammar) -> tuple[np.ndarray, list]:
    """The matrices of all symbols of a grammar, bottom-up."""
    cost = np.empty((g.terminals + len(g.left), 4, 4), np.int64)
    cost[: g.terminals] = np.concatenate([c for c, _ in SYMBOLS])
    rope = [r[0] for _, r in SYMBOLS]
    for lo, hi in g.spans():
        a, b = g.left[lo:hi], g.right[lo:hi]
        cost[g.terminals + lo : g.terminals + hi], more = product(cost[a], [rope[k] for k in a.tolist()], cost[b], [rope[k] for k in b.tolist()])
        rope += more
    return cost, rope


def whole(symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Of each sequence: its matrix's costs (16, by row) and audits, as one entry per distinct sequence, and the place of each sequence's entry."""
    g = fold(compress(symbols, first, len(SYMBOLS)))
    cost, rope = transfer(g)
    n = np.diff(g.first)
    own = np.full(len(n), len(cost))
    own[n > 0] = g.seq
    kinds, place = np.unique(own, return_inverse=True)
    entries = [(cost[k], rope[k]) if k < len(cost) else (IDENTITY[0][0], IDENTITY[1][0]) for k in kinds.tolist()]
    texts = [[None if r is None else text_of(r) for row in rope_ for r in row] for _, rope_ in entries]
    return np.stack([c for c, _ in entries]).reshape(-1, 16) if entries else np.zeros((0, 16), np.int64), pa.array(texts, pa.list_(pa.string())), place


def closed(cost: np.ndarray, rope: list) -> tuple[int, str]:
    """The cheapest well-formed result of a whole conversation's matrix: its cost and audit."""
    cost, rope = product(cost, rope, *INSERTS)
    return min((int(cost[0, START, q]), text_of(rope[0][START][q])) for q in ENDS if cost[0, START, q] < NEVER)


def _space(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, gone``: rows damaged by a checksum of their id and turn; a dropped row stays as ``gone``."""
    how = F.crc32(F.concat(_space("conv_id"), F.lit(":"), _space("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", _space("role").alias("role"), _space("text").alias("text"), how.alias("how"))
    text = F.when(F.col("how") == 1, F.lit("")).when(F.col("how") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("how") == 4, F.lit("user")).otherwise(F.col("role"))
    times = F.explode(F.sequence(F.lit(1), F.when(F.col("how") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("how") == 0).alias("gone"), times.alias("copy")).drop("copy")


def _digest() -> Column:
    return F.unhex(F.md5("text"))


def facts(rows: DataFrame) -> DataFrame:
    """What decides about a row, without its text: key, first letter of the role (place in ``sua``, else 3), fault (0 none, 1 blank, 2 seen
    in an earlier turn, 3 truncated). A repeat within one turn is left to the sorted stream."""
    body = F.rtrim(F.col("text"), F.lit(SPACE))
    letter = F.left("role", F.lit(1))
    blank, ended = body == "", F.right(body, F.lit(1)).isin(".", "!", "?")
    r = rows.select("conv_id", "turn", "role", _digest().alias("digest"), "gone", F.when(letter == "s", 0).when(letter == "u", 1).when(letter == "a", 2).otherwise(3).alias("letter"), blank.alias("blank"), ended.alias("ended"))
    when = F.struct(F.col("turn").isNotNull().alias("some"), F.col("turn"))
    seen = r.where("NOT gone AND NOT blank").groupBy("conv_id", "role", "digest").agg(F.min(when).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    seen = seen.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first")
    j = r.join(seen, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left")
    fault = F.when(F.col("blank"), 1).when(F.col("first") < when, 2).when(~F.col("ended"), 3).otherwise(0)
    return j.select("conv_id", "turn", "role", "digest", "gone", F.col("letter").cast("int").alias("letter"), fault.cast("int").alias("fault"))


_PORTION = "part long, n_rows long, blank long, duplicate long, truncated long, illegal long, first_letter int, last_letter int, first_turn long, last_turn long, turns long, cost array<long>, audit array<string>"
_LEGAL = np.zeros((4, 4), bool)
_LEGAL[0, 1] = _LEGAL[1, 2] = _LEGAL[2, 1] = True


def _same(col: pa.Array) -> np.ndarray:
    """Whether an entry equals the one before it, nulls being equal."""
    a, b = col[1:], col[:-1]
    return pc.fill_null(pc.or_kleene(pc.equal(a, b), pc.and_(pc.is_null(a), pc.is_null(b))), False).to_numpy(zero_copy_only=False)


def portions(ordered: DataFrame) -> DataFrame:
    """Per conversation and block of sorted rows: counts, the ends that meet the next block, and the transfer matrix."""
    kind = ordered.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", *[c.split()[0] for c in _PORTION.split(", ")]]

    def block(table: pa.Table, part: int) -> pa.RecordBatch:
        """``table`` holds in its first row the row before, if any, which only serves to tell repeats."""
        cols = {c: table[c].combine_chunks() for c in table.column_names}
        same = {c: _same(cols[c]) for c in ("conv_id", "turn", "role", "digest")}
        live_all = ~cols["gone"].to_numpy(zero_copy_only=False)
        twin = same["conv_id"] & same["turn"] & same["role"] & same["digest"] & live_all[:-1]
        new = ~same["conv_id"]
        new[0] = True
        heads = np.flatnonzero(new)
        ids = cols["conv_id"][1:].take(pa.array(heads))
        live = live_all[1:]
        of = np.cumsum(new) - 1
        letter, fault = (cols[c][1:].to_numpy().astype(np.int64) for c in ("letter", "fault"))
        fault = np.where(twin & (fault != 1), 2, fault)
        of, letter, fault = of[live], letter[live], fault[live]
        turn = cols["turn"][1:].filter(pa.array(live))
        n = len(heads)
        count = lambda mask: np.bincount(of[mask], minlength=n)
        first = np.searchsorted(of, np.arange(n + 1))
        pair = np.flatnonzero(of[1:] == of[:-1])
        illegal = np.bincount(of[pair[~_LEGAL[letter[pair], letter[pair + 1]]]], minlength=n)
        some = np.flatnonzero(turn.is_valid().to_numpy(zero_copy_only=False))
        t, t_of = turn.drop_null().to_numpy().astype(np.int64), of[some]
        t_new = np.ones(len(t), bool)
        t_new[1:] = (t_of[1:] != t_of[:-1]) | (t[1:] != t[:-1])
        t_first = np.searchsorted(t_of, np.arange(n + 1))
        has_t, has = np.diff(t_first) > 0, np.diff(first) > 0
        pick = lambda values, at, ok: pa.array(np.where(ok, values[np.clip(at, 0, max(0, len(values) - 1))] if len(values) else 0, 0), mask=~ok)
        symbol = np.where((fault == 1) | (fault == 2), MUST_GO, letter * 2 + (fault == 3))
        cost, audit, place = whole(symbol, first)
        flat = pa.array(cost[place].ravel())
        longs = [np.arange(n) + part, np.diff(first), count(fault == 1), count(fault == 2), count(fault == 3), illegal]
        return pa.RecordBatch.from_arrays(
            [
                ids, *(pa.array(x.astype(np.int64)) for x in longs),
                pick(letter, first[:-1], has).cast(pa.int32()), pick(letter, first[1:] - 1, has).cast(pa.int32()),
                pick(t, t_first[:-1], has_t), pick(t, t_first[1:] - 1, has_t), pa.array(np.bincount(t_of[t_new], minlength=n).astype(np.int64)),
                pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * 16), flat), audit.take(pa.array(place)),
            ],
            names,
        )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, last = TaskContext.get().partitionId() << 40, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) >= BLOCK:
                out = block(_with_row_before(held, last), part)
                part, last, held = part + out.num_rows, held[-1].slice(held[-1].num_rows - 1), []
                yield out
        if held:
            yield block(_with_row_before(held, last), part)

    return ordered.mapInArrow(read, f"conv_id {kind}, {_PORTION}")


def _with_row_before(held: list[pa.RecordBatch], last: pa.RecordBatch | None) -> pa.Table:
    """A block of rows behind the row before it; behind a row that is gone if there is none."""
    if last is None:
        first = held[0].slice(0, 1)
        gone = first.schema.get_field_index("gone")
        last = first.set_column(gone, first.schema.field(gone), pa.array([True]))
    return pa.Table.from_batches([last, *held])


def audits(rows: DataFrame) -> DataFrame:
    """Per conversation of ``rows`` (``conv_id, turn, role, text, gone``): gaps, counts of faults and illegal neighbours, cost and audit."""
    key = ["conv_id", "turn", "role", "digest"]
    ordered = facts(rows).repartitionByRange(*key).sortWithinPartitions(*key)
    kind = rows.schema["conv_id"].dataType.simpleString()
    per = portions(ordered)
    parts = per.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(*[c for c in per.columns if c != "conv_id"]))).alias("parts"))
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, tuple[int, str]] = {}
        for batch in batches:
            rows_ = []
            for parts in batch.column(1).to_pylist():
                cost, rope = _entry(parts[0])
                total = {c: sum(p[c] for p in parts) for c in ("blank", "duplicate", "truncated", "illegal", "turns")}
                letter = turn = None
                for p in parts:
                    if p["n_rows"]:
                        total["illegal"] += letter is not None and not _LEGAL[letter, p["first_letter"]]
                        letter = p["last_letter"]
                    if p["turns"]:
                        total["turns"] -= turn == p["first_turn"]
                        turn = p["last_turn"]
                for p in parts[1:]:
                    cost, rope = product(cost, rope, *_entry(p))
                at = (cost[0, START].tobytes(), *rope[0][START])
                if len(parts) > 1:
                    end = closed(cost, rope)
                elif at in known:
                    end = known[at]
                else:
                    end = closed(cost, rope)
                    if len(known) < 10_000:
                        known[at] = end
                turns = [p["first_turn"] for p in parts if p["turns"]]
                gaps = turn - turns[0] + 1 - total["turns"] if turns else 0
                rows_.append((gaps, total["blank"], total["duplicate"], total["truncated"], total["illegal"], *end))
            types = [pa.int64()] * 6 + [pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), t) for c, t in zip(zip(*rows_) if rows_ else [[]] * 7, types))], names)

    return parts.mapInArrow(read, f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


def _entry(part: dict) -> tuple[np.ndarray, list]:
    a = part["audit"]
    return np.array(part["cost"], np.int64).reshape(1, 4, 4), [[a[4 * i : 4 * i + 4] for i in range(4)]]


class _Walk:
    """One conversation's edits applied to its rows as they pass by; gives ``(role, text)`` of the repaired rows."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def _new(self) -> str:
        self.state = ASSISTANT if self.state == USER else USER
        return ROLE[self.state]

    def inserted(self) -> Iterator[tuple[str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield self._new(), ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = NEXT[role[0]][self.state]
            yield role, text
        elif edit == "R":
            yield self._new(), text


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _stream(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Audits and rows in one stream: each conversation's audit, then its rows in order, in one partition."""
    nothing = [F.lit(None).cast("long").alias(c) for c in _COUNTS]
    texts = rows.where("NOT gone").select("conv_id", F.lit(1).alias("kind"), "turn", "role", _digest().alias("digest"), "text", *nothing, F.lit(None).cast("string").alias("audit"))
    null = lambda c: F.lit(None).cast(texts.schema[c].dataType).alias(c)
    heads = found.select("conv_id", F.lit(0).alias("kind"), *(null(c) for c in ("turn", "role", "digest", "text")), *_COUNTS, "audit")
    return heads.unionByName(texts).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "digest")


def digests(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` with ``repaired_sha256``, the digest of the repaired conversation."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    out = ["conv_id", *_COUNTS[:5], "cost", "audit", "repaired_sha256"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = walk = sha = None
        lines = 0

        def tell(new) -> None:
            nonlocal lines
            for role, text in new:
                sha.update((b"\n" if lines else b"") + f"{role}:{text}".encode())
                lines += 1

        schema = None
        for batch in batches:
            done = []
            id_at = batch.column(0)
            schema = schema or pa.schema([pa.field("conv_id", id_at.type), *[pa.field(c, pa.int64()) for c in _COUNTS], pa.field("audit", pa.string()), pa.field("repaired_sha256", pa.string())])
            for row in batch.to_pylist():
                if row["kind"] == 0:
                    if head is not None:
                        tell(walk.inserted())
                        done.append(head | {"repaired_sha256": sha.hexdigest()})
                    head = {c: row[c] for c in out[:-1]}
                    walk, sha, lines = _Walk(row["audit"]), hashlib.sha256(), 0
                else:
                    tell(walk.row(row["role"], row["text"]))
            yield pa.RecordBatch.from_pylist(done, schema)
        if head is not None:
            tell(walk.inserted())
            yield pa.RecordBatch.from_pylist([head | {"repaired_sha256": sha.hexdigest()}], schema)

    counts = ", ".join(f"{c} long" for c in _COUNTS)
    return _stream(rows, found).mapInArrow(read, f"conv_id {kind}, {counts}, audit string, repaired_sha256 string")


def repaired(rows: DataFrame) -> DataFrame:
    """``conv_id, place, role, text``: the rows of the repaired conversations, places from 0."""
    kind = rows.schema["conv_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, conv, place, schema = None, None, 0, None
        for batch in batches:
            done = []
            schema = schema or pa.schema([pa.field("conv_id", batch.column(0).type), pa.field("place", pa.int64()), pa.field("role", pa.string()), pa.field("text", pa.string())])

            def tell(new) -> None:
                nonlocal place
                for role, text in new:
                    done.append({"conv_id": conv, "place": place, "role": role, "text": text})
                    place += 1

            for row in batch.select(["conv_id", "kind", "role", "text", "audit"]).to_pylist():
                if row["kind"] == 0:
                    if walk:
                        tell(walk.inserted())
                    walk, conv, place = _Walk(row["audit"]), row["conv_id"], 0
                else:
                    tell(walk.row(row["role"], row["text"]))
            yield pa.RecordBatch.from_pylist(done, schema)
        if walk:
            last = [{"conv_id": conv, "place": place + k, "role": role, "text": text} for k, (role, text) in enumerate(walk.inserted())]
            yield pa.RecordBatch.from_pylist(last, schema)

    return _stream(rows, keep(audits(rows), "repair-audits")).mapInArrow(read, f"conv_id {kind}, place long, role string, text string")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return digests(rows, keep(audits(rows), "repair-audits"))


def _crc_table() -> list[int]:
    """The table of the CRC-32 checksum, from its reversed polynomial."""
    out = []
    for k in range(256):
        for _ in range(8):
            k = k >> 1 ^ 0xEDB88320 * (k & 1)
        out.append(k)
    return out


SQL = rf"""
WITH RECURSIVE t AS (SELECT {_crc_table()}::BIGINT[] AS t),
k AS (
  SELECT dense_rank() OVER (ORDER BY conv_id) AS c, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT)) AS key
  FROM conversations),
h AS (
  SELECT k.*, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), key), lambda a, b: xor(a >> 8, t.t[CAST((xor(a, b) & 255) + 1 AS BIGINT)]))) % 20 AS how FROM k, t),
d AS (
  SELECT c, conv_id, turn, CASE how WHEN 4 THEN 'user' ELSE role END AS role,
    CASE how WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM (SELECT h.*, unnest(range(CASE how WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM h)),
o AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, md5(text)) AS pos, CASE WHEN role = '' THEN '-' ELSE left(role, 1) END AS i FROM d),
f AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY pos) > 1 THEN 'd'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE '' END AS fault,
    lag(i) OVER (PARTITION BY c ORDER BY pos) || i AS two FROM o),
ins(p, m, edits, price, lines) AS (VALUES (0, 0, '', 0, ''), (1, 1, '', 0, ''), (2, 2, '', 0, ''), (3, 3, '', 0, ''),
  (0, 2, 'I', 5, 'user:' || chr(10)), (1, 2, 'I', 5, 'user:' || chr(10)), (3, 2, 'I', 5, 'user:' || chr(10)), (2, 3, 'I', 5, 'assistant:' || chr(10)),
  (0, 3, 'II', 10, 'user:' || chr(10) || 'assistant:' || chr(10)), (1, 3, 'II', 10, 'user:' || chr(10) || 'assistant:' || chr(10))),
edge(m, q, edit, needs) AS (VALUES (0, 1, 'K', 's'), (0, 2, 'K', 'u'), (1, 2, 'K', 'u'), (3, 2, 'K', 'u'), (2, 3, 'K', 'a'),
  (0, 2, 'R', ''), (1, 2, 'R', ''), (3, 2, 'R', ''), (2, 3, 'R', ''), (0, 0, 'D', ''), (1, 1, 'D', ''), (2, 2, 'D', ''), (3, 3, 'D', '')),
dp AS (
  SELECT c, CAST(0 AS BIGINT) AS pos, 0 AS st, '000000000' AS best, '' AS txt FROM (SELECT DISTINCT c FROM f)
  UNION ALL
  SELECT c, pos, q AS st, min(new) AS best, arg_min(grown, new) AS txt FROM (
    SELECT dp.c, f.pos, edge.q,
      printf('%09d', CAST(left(best, 9) AS BIGINT) + price + CASE edit WHEN 'K' THEN 0 WHEN 'R' THEN 1 ELSE 2 END + CASE WHEN edit <> 'D' AND fault = 't' THEN 5 ELSE 0 END) || substr(best, 10) || edits || edit AS new,
      txt || lines || CASE edit WHEN 'K' THEN role || ':' || text || chr(10) WHEN 'R' THEN CASE edge.q WHEN 2 THEN 'user' ELSE 'assistant' END || ':' || text || chr(10) ELSE '' END AS grown
    FROM dp JOIN f ON f.c = dp.c AND f.pos = dp.pos + 1 JOIN ins ON ins.p = dp.st JOIN edge ON edge.m = ins.m AND (needs = '' OR needs = i) AND (edit = 'D' OR fault NOT IN ('b', 'd')))
  GROUP BY c, pos, q),
fin AS (
  SELECT c, min(new) AS best, arg_min(grown, new) AS txt FROM (
    SELECT dp.c, printf('%09d', CAST(left(best, 9) AS BIGINT) + price) || substr(best, 10) || edits AS new, txt || lines AS grown
    FROM dp JOIN (SELECT c, max(pos) AS pos FROM f GROUP BY c) USING (c, pos) JOIN ins ON ins.p = dp.st WHERE ins.m IN (0, 3)) GROUP BY c),
n AS (
  SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
    count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY c)
SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(CAST(left(best, 9) AS BIGINT), 0) AS cost, coalesce(substr(best, 10), '') AS audit,
  sha256(coalesce(CASE WHEN txt = '' THEN '' ELSE left(txt, CAST(length(txt) - 1 AS BIGINT)) END, '')) AS repaired_sha256
FROM (SELECT DISTINCT c, conv_id FROM k) LEFT JOIN n USING (c) LEFT JOIN fin USING (c)
"""

QUERIES = {"op11_conversation_repair": op11_conversation_repair}
ORACLES = {"op11_conversation_repair": SQL}
