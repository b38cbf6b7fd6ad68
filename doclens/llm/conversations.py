"""Operator 11, conversation structure repair.

A conversation is sound when the initials of its roles read (s?(ua)+)?: at most one system turn first, then user and
assistant in turn. A row's fault (blank, duplicate, truncated) and its role's initial make one symbol; a conversation's
symbols, in order, are its signature. Signatures are sorted and inserted into a prefix trie; the dynamic program over
(symbols read, state of the pattern) has one layer a node, so a prefix that many conversations share is computed once, and
a signature's cheapest edits are read off at its terminal node.

Nothing holds a whole conversation: rows are sorted by Spark and streamed. Faults are found on rows without texts, identical
rows collapsed to a count; texts pass one shuffle, to be hashed in their order. Signatures are dealt by range of (their head,
conversation), so a signature that a third of all conversations share is spread. What one conversation needs in memory is
its signature and edits, a few bytes a row.

Defined cases. A null conv_id is a conversation, returned as null; null roles and texts are one space, and so is a null
conv_id or turn in the key of the damage. Rows of one turn go by role, then by the digest of the text. Empty texts are blank.
Repeated rows are duplicates. A conversation that loses all rows has zeros, no edits and the hash of an empty string. An
empty table gives an empty result; further columns are not read. Very long texts are hashed whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doclens.llm.common import bound_batches, buckets_for, cut, discard, table

KEEP, REROLE, DELETE, INSERT = 0, 3, 4, 3
TRUNCATED = 3
_BLANKS = "\t\n\x0b\x0c\r "

#: States of (s?(ua)+)?: nothing yet, after s, after u, after a.
NEXT: list[dict[str, int]] = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
SOUND = (0, 3)

#: (cost, rank) of the best edits by state, or None. Ranks order the states' edits as strings. No two are equal and none
#: begins another, as each ends with the edit of the same row; so ranks survive whatever is appended.
Layer = tuple["tuple[int, int] | None", ...]
ROOT: Layer = ((0, 0), None, None, None)


def _inserted(state: int) -> Iterator[tuple[int, int]]:
    """(state, number) after up to two insertions; more never pay."""
    yield state, 0
    for n in (1, 2):
        state = next(NEXT[state][r] for r in "ua" if r in NEXT[state])
        yield state, n


def _moves(symbol: str) -> list[tuple[int, int, int, str]]:
    """(from, to, cost, edits) of a row: D where it must go, else the initial (o: any other), upper-case where it is truncated."""
    initial, extra, out = symbol.lower(), TRUNCATED * (symbol != "D" and symbol.isupper()), []
    for state in range(len(NEXT)):
        for at, n in _inserted(state):
            out.append((state, at, INSERT * n + DELETE, "I" * n + "D"))
            if symbol != "D":
                out += [(state, NEXT[at][r], INSERT * n + (KEEP if r == initial else REROLE) + extra, "I" * n + ("K" if r == initial else "R")) for r in NEXT[at] if r == initial or r in "ua"]
    return out


MOVES = {symbol: _moves(symbol) for symbol in "DsuaoSUAO"}


@lru_cache(maxsize=1 << 16)
def step(layer: Layer, symbol: str) -> tuple[Layer, int, tuple[tuple[int, str] | None, ...]]:
    """The next layer, lowered to a least cost of 0; what it was lowered by; and by state, where it comes from with which edits."""
    best: list = [None] * len(NEXT)
    for state, to, cost, edits in MOVES[symbol]:
        if layer[state] is not None:
            found = (layer[state][0] + cost, layer[state][1], edits, state)
            best[to] = found if best[to] is None else min(best[to], found)
    order = sorted(b[1:3] for b in best if b)
    least = min(b[0] for b in best if b)
    return tuple(b and (b[0] - least, order.index(b[1:3])) for b in best), least, tuple(b and (b[3], b[2]) for b in best)


@lru_cache(maxsize=1 << 16)
def finish(layer: Layer) -> tuple[int, int, str]:
    """(cost, state, last edits) of the best ending."""
    ends = [(layer[s][0] + INSERT * n, layer[s][1], "I" * n, s) for s in range(len(NEXT)) if layer[s] for at, n in _inserted(s) if at in SOUND]
    cost, _, edits, state = min(ends)
    return cost, state, edits


class Trie:
    """A prefix trie that takes signatures in sorted order. Of it, the path to the last one is held: a node left is never entered again."""

    def __init__(self) -> None:
        self.word, self.nodes, self.layers = "", [(ROOT, 0, None)], 0
        self.answer: tuple[int, str] | None = None

    def insert(self, word: str) -> tuple[int, str]:
        """The least cost of a signature's edits, and their initials."""
        if word == self.word and self.answer:
            return self.answer
        shared = shared_length(self.word, word)
        del self.nodes[shared + 1 :]
        layer, total, _ = self.nodes[-1]
        for symbol in word[shared:]:
            layer, more, back = step(layer, symbol)
            total += more
            self.nodes.append((layer, total, back))
        self.layers += len(word) - shared
        cost, state, edits = finish(layer)
        out = [edits]
        for _, _, back in reversed(self.nodes[1:]):
            state, edits = back[state]
            out.append(edits)
        self.word, self.answer = word, (total + cost, "".join(reversed(out)))
        return self.answer


def shared_length(a: str, b: str) -> int:
    """Length of the longest common prefix, by doubling and halving."""
    if b.startswith(a):
        return len(a)
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid - 1)
    return lo


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after damage, and `copies`: 0 for a row that it drops, 2 for one that it repeats."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    return rows.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), fate.alias("fate")).select(
        "conv_id", "turn",
        F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("fate") == 0, 0).when(F.col("fate") == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def _digest() -> Column:
    return F.unhex(F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 32))


def _in_order(rows: DataFrame, tasks: int, *first: str) -> DataFrame:
    """rows dealt by conversation, each task's sorted: by `first`, then turn (nulls first), role and digest."""
    return rows.repartition(tasks, "conv_id").sortWithinPartitions("conv_id", *first, F.asc_nulls_first("turn"), "role", "digest")


_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal"]


def _read_signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a conversation, of rows in order."""
    state, legal, schema = None, {"su", "ua", "au"}, None

    def closed(out: dict[str, list]) -> None:
        conv, symbols, turns, counts, _ = state
        span = turns[2] - turns[1] + 1 - turns[0] if turns[0] else 0
        for name, value in zip(schema.names, [conv, symbols.decode(), span, *counts], strict=True):
            out[name].append(value)

    for batch in batches:
        schema = schema or pa.schema([("conv_id", batch.schema.field("conv_id").type), ("signature", pa.string()), *((c, pa.int64()) for c in _COUNTS)])
        out: dict[str, list] = {name: [] for name in schema.names}
        for conv, turn, role, symbol, copies, later in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "symbol", "copies", "later")), strict=True):
            if state is None or state[0] != conv:
                if state is not None:
                    closed(out)
                state = [conv, bytearray(), [0, None, None], [0, 0, 0, 0], None]
            if not copies:
                continue
            _, symbols, turns, counts, before = state
            if turn is not None and turn != turns[2]:
                state[2] = [turns[0] + 1, turn if turns[1] is None else turns[1], turn]
            if symbol == "D":
                counts[0] += copies
                symbols += b"D" * copies
            else:
                counts[1] += copies - (not later)
                counts[2] += symbol.isupper() and not later
                symbols += (b"D" if later else symbol.encode()) + b"D" * (copies - 1)
            initial = role[:1]
            counts[3] += copies - 1 + (before is not None and before + initial not in legal)
            state[4] = initial
        yield pa.RecordBatch.from_pydict(out, schema)
    if state is not None:
        out = {name: [] for name in schema.names}
        closed(out)
        yield pa.RecordBatch.from_pydict(out, schema)


def signatures(rows: DataFrame) -> DataFrame:
    """conv_id, signature and counts of faults of every conversation of damaged rows."""
    bare = F.rtrim("text", F.lit(_BLANKS))
    initial = F.substring("role", 1, 1)
    initial = F.when(initial.isin("s", "u", "a"), initial).otherwise(F.lit("o"))
    symbol = F.when(bare == "", "D").when(F.right(bare, F.lit(1)).isin(".", "!", "?"), initial).otherwise(F.upper(initial))
    light = cut(rows.select("conv_id", "turn", "role", _digest().alias("digest"), symbol.alias("symbol"), "copies").groupBy("conv_id", "turn", "role", "digest", "symbol").agg(F.sum("copies").alias("copies")), "turns")
    turn = F.struct("turn")
    again = light.filter("copies > 0 AND symbol <> 'D'").groupBy("conv_id", "role", "digest").agg(F.min(turn).alias("first"), F.max(turn).alias("last")).filter("first < last").select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first")
    marked = light.join(again, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left")
    found = marked.select("conv_id", "turn", "role", "digest", "symbol", "copies", F.coalesce(turn > F.col("first"), F.lit(False)).alias("later"))
    kind = rows.schema["conv_id"].dataType.simpleString()
    bound_batches(rows.sparkSession)
    out = cut(_in_order(found, buckets_for(light, 2 << 20)).mapInArrow(_read_signatures, f"conv_id {kind}, signature string, " + ", ".join(f"{c} long" for c in _COUNTS)), "signatures")
    discard(light)
    return out


def cheapest_edits(signed: DataFrame) -> DataFrame:
    """signed (with a column signature) with cost and audit, the initials of its cheapest edits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie()
        for batch in batches:
            found = [trie.insert(s) for s in batch.column("signature").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string())], [*batch.schema.names, "cost", "audit"])

    bound_batches(signed.sparkSession)
    dealt = signed.withColumn("head", F.substring("signature", 1, 64)).repartitionByRange(buckets_for(signed, 2 << 20), "head", "conv_id").drop("head").sortWithinPartitions("signature", "conv_id")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in signed.schema)
    return dealt.mapInArrow(run, f"{schema}, cost long, audit string")


class _Repair:
    """One conversation's repaired rows, hashed as they come."""

    def __init__(self, audit: str) -> None:
        self.edits, self.at, self.written = audit, 0, 0
        self.system = (len(audit) - audit.count("D")) % 2
        self.hash = hashlib.sha256()

    def _write(self, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) * bool(self.written)}{role}:".encode())
        for k in range(0, len(text), 1 << 20):
            self.hash.update(text[k : k + (1 << 20)].encode())
        self.written += 1

    def _role(self) -> str:
        return ("user", "assistant")[(self.written - self.system) % 2]

    def _insert(self) -> None:
        while self.edits[self.at : self.at + 1] == "I":
            self._write(self._role(), "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self._insert()
        edit = self.edits[self.at]
        self.at += 1
        if edit != "D":
            self._write(role if edit == "K" else self._role(), text)

    def digest(self) -> str:
        self._insert()
        if self.at != len(self.edits):
            raise ValueError("a conversation's rows do not match its edits")
        return self.hash.hexdigest()


def repaired(rows: DataFrame, audited: DataFrame) -> DataFrame:
    """audited with repaired_sha256: the hash of the rows after the edits, as role:text, a line feed between them."""
    names = audited.columns
    head = audited.select("*", F.lit(0).alias("kind"))
    body = rows.filter("copies > 0").select("conv_id", "turn", "role", "text", "copies", _digest().alias("digest"), F.lit(1).alias("kind"))
    together = _in_order(head.unionByName(body, allowMissingColumns=True), buckets_for(rows, 4 << 20), "kind").drop("digest")
    fields = [(f.name, f.dataType.simpleString()) for f in audited.schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_row, repair, schema = None, None, None
        for batch in batches:
            schema = schema or pa.schema([*(batch.schema.field(n) for n in names), pa.field("repaired_sha256", pa.string())])
            own, done = pa.Table.from_batches([batch.select(names)]), []
            for i, (kind, role, text, copies) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("kind", "role", "text", "copies")), strict=True)):
                if kind == 0:
                    if repair is not None:
                        done.append(open_row | {"repaired_sha256": repair.digest()})
                    open_row = own.slice(i, 1).to_pylist()[0]
                    repair = _Repair(open_row["audit"])
                else:
                    for _ in range(copies):
                        repair.row(role, text)
            yield pa.RecordBatch.from_pylist(done, schema)
        if repair is not None:
            yield pa.RecordBatch.from_pylist([open_row | {"repaired_sha256": repair.digest()}], schema)

    bound_batches(rows.sparkSession)
    return together.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in fields) + ", repaired_sha256 string")


def repair(conversations: DataFrame) -> DataFrame:
    """One row a conversation: counts of faults, cost and initials of the cheapest edits, hash of the repaired rows."""
    rows = damaged(conversations)
    return repaired(rows, cheapest_edits(signatures(rows)).drop("signature"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(table(spark, sf_dir, "conversations"))


def _op11_sql() -> str:
    crc = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(k, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"
    add = lambda key, cost, letter: f"lpad((left({key}, 9)::INT + {cost})::VARCHAR, 9, '0') || substr({key}, 10) || '{letter}'"
    keep = lambda key, r: f"CASE WHEN NOT gone THEN CASE WHEN initial = '{r}' THEN {add(key, 'extra', 'K')} ELSE {add(key, '3 + extra', 'R')} END END"
    return f"""
WITH RECURSIVE d0 AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
d1 AS (SELECT conv_id, turn, role, text, {crc} % 20 AS h FROM d0),
d2 AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE WHEN h = 1 THEN '' WHEN h = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
  unnest(range(CASE WHEN h = 0 THEN 0 WHEN h = 3 THEN 2 ELSE 1 END)) AS copy FROM d1),
r0 AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i,
  rtrim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS bare, left(role, 1) AS initial FROM d2),
r AS MATERIALIZED (SELECT *, bare = '' AS blank, bare <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS dup,
  right(bare, 1) NOT IN ('.', '!', '?') AS cut, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM r0),
e AS MATERIALIZED (SELECT conv_id, i, role, text, initial, blank OR dup AS gone, CASE WHEN cut THEN 3 ELSE 0 END AS extra, count(*) OVER (PARTITION BY conv_id) AS n FROM r),
ids AS (SELECT DISTINCT conv_id FROM conversations),
p AS (
  SELECT conv_id, 0::BIGINT AS i, '000000000' AS p0, NULL::VARCHAR AS p1, NULL::VARCHAR AS p2, NULL::VARCHAR AS p3 FROM ids
  UNION ALL
  SELECT conv_id, i + 1, {add("p0", 4, "D")}, least({add("p1", 4, "D")}, CASE WHEN NOT gone AND initial = 's' THEN {add("p0", "extra", "K")} END),
    least({add("t2", 4, "D")}, {keep("p0", "u")}, {keep("p1", "u")}, {keep("t3", "u")}), least({add("t3", 4, "D")}, {keep("t2", "a")})
  FROM (SELECT *, least(p3, {add("t2", 3, "I")}) AS t3 FROM (SELECT p.*, e.gone, e.initial, e.extra, least(p2, {add("p0", 3, "I")}, {add("p1", 3, "I")}, {add("p3", 3, "I")}) AS t2
    FROM p JOIN e ON e.conv_id IS NOT DISTINCT FROM p.conv_id AND e.i = p.i + 1))
),
best AS (SELECT conv_id, least(p0, t3) AS best FROM (SELECT *, least(p3, {add("t2", 3, "I")}) AS t3 FROM (SELECT p.*, least(p2, {add("p0", 3, "I")}, {add("p1", 3, "I")}) AS t2
  FROM p LEFT JOIN (SELECT DISTINCT conv_id, n FROM e) s ON s.conv_id IS NOT DISTINCT FROM p.conv_id WHERE p.i = coalesce(s.n, 0)))),
a AS (SELECT conv_id, left(best, 9)::BIGINT AS cost, substr(best, 10) AS audit FROM best),
x AS (SELECT conv_id, unnest(string_split(audit, '')) AS op, generate_subscripts(string_split(audit, ''), 1) AS j, length(replace(audit, 'D', '')) % 2 AS sys FROM a WHERE audit <> ''),
y AS (SELECT *, sum(CASE WHEN op <> 'I' THEN 1 ELSE 0 END) OVER w AS i, sum(CASE WHEN op <> 'D' THEN 1 ELSE 0 END) OVER w - 1 - sys AS o FROM x WINDOW w AS (PARTITION BY conv_id ORDER BY j)),
z AS (SELECT y.conv_id, string_agg(CASE WHEN op = 'K' THEN e.role WHEN o % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN op = 'I' THEN '' ELSE e.text END, chr(10) ORDER BY j) AS whole
  FROM y LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM y.conv_id AND e.i = y.i WHERE op <> 'D' GROUP BY y.conv_id),
f AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate,
  count(*) FILTER (NOT blank AND NOT dup AND cut) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, cost, audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM a LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM a.conv_id
"""


OP11_SQL = _op11_sql()
