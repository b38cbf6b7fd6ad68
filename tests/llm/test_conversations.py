"""Conversation structure repair against plain Python and SQL."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from parity import connect
from pyspark.sql import functions as F

from doclens.llm import conversations as cv

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"
EXTRA = SCHEMA + ", kind int, digest string, copies long, symbol string, later boolean, cost long, audit string, signature string, head string"


def best_by_force(symbols: str) -> tuple[int, str]:
    """Cheapest edits by trying every sequence of edits with up to two insertions in each gap."""
    best = None
    for gaps in itertools.product((0, 1, 2), repeat=len(symbols) + 1):
        for ops in itertools.product("DKua", repeat=len(symbols)):
            cost, audit, roles = 0, "", []
            for gap, op, symbol in zip(gaps, [*ops, ""], [*symbols, ""], strict=True):
                audit += "I" * gap
                roles += [None] * gap
                cost += 3 * gap
                if not op:
                    continue
                if symbol == "D" and op != "D":
                    break
                audit += op if op in "DK" else "R"
                cost += 4 if op == "D" else (0 if op == "K" else 3) + 3 * symbol.isupper()
                if op != "D":
                    roles.append(symbol.lower() if op == "K" else op)
            else:
                system = len(roles) % 2
                wanted = "s" * system + "ua" * (len(roles) // 2)
                if wanted != "s" and all(r in (None, w) for r, w in zip(roles, wanted, strict=True)) and not (system and roles[0] is None):
                    best = min(best or (cost, audit), (cost, audit))
    return best


@pytest.mark.parametrize("n", range(4))
def test_edits_by_force(n):
    words = ["".join(w) for w in itertools.product("DsuaoSUAO" if n < 3 else "DsuaU", repeat=n)]
    trie = cv.Trie()
    for word in sorted(words):
        assert trie.insert(word) == best_by_force(word), word


def test_a_layer_is_computed_once_a_prefix():
    random.seed(5)
    words = sorted("".join(random.choices("DsuaU", k=random.randint(0, 30))) for _ in range(2000))
    trie = cv.Trie()
    found = [trie.insert(w) for w in words]
    assert trie.layers == len({w[:k] for w in words for k in range(1, len(w) + 1)})
    assert found == [cv.Trie().insert(w) for w in words]  # each alone


def plain(rows):
    """The operator's result by conversation, from plain Python; edits from Trie, which is tested above."""
    blank = lambda x: " " if x is None else str(x)
    convs = {}
    for conv, turn, role, text in rows:
        kept = convs.setdefault(conv, [])
        role, text = blank(role), blank(text)
        h = zlib.crc32(f"{blank(conv)}:{blank(turn)}".encode()) % 20
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        kept += [(turn, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    out = {}
    for conv, kept in convs.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        seen, word, counts = set(), "", {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in kept:
            bare = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            symbol = role[:1] if role[:1] in ("s", "u", "a") else "o"
            word += "D" if fault in ("blank", "duplicate") else symbol.upper() if fault else symbol
        turns = {t for t, _, _ in kept if t is not None}
        cost, audit = cv.Trie().insert(word)
        lines, at, roles = [], 0, []
        system = len(audit.replace("D", "")) % 2
        for op in audit:
            if op != "D":
                role = "s" if system and not roles else ("user", "assistant")[(len(roles) - system) % 2]
                lines.append(f"{role}:" if op == "I" else f"{kept[at][1] if op == 'K' else role}:{kept[at][2]}")
                roles.append(role)
            at += op != "I"
        counts["gaps"] = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        counts["illegal"] = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(kept))
        out[conv] = counts | {"cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest()}
    return out


def got(df):
    return {r["conv_id"]: {k: v for k, v in r.asDict().items() if k != "conv_id"} for r in df.collect()}


def test_same_rows_as_sql(spark):
    columns = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    ours = cv.op11_conversation_repair(spark, SF).select(columns)
    assert {tuple(r) for r in ours.collect()} == set(connect(SF).execute(f"SELECT {', '.join(columns)} FROM ({cv.OP11_SQL})").fetchall())


def odd_conversations():
    random.seed(3)
    some = lambda xs: random.choice(xs)
    texts = ["One.", "one", "two!", "", " \t\x0b\n", None, "what? \r\n", " ", "ü\U0001f600.", "x" * 200_000 + "."]
    rows = [(some([1, 2, 3, None]), some([None, 0, 1, 2, 5, 9]), some(["user", "assistant", "system", "tool", "", None, "User"]), some(texts)) for _ in range(150)]
    rows += [(10, k, ("user", "assistant")[k % 2], f"turn {k}.") for k in range(3000)]  # one long conversation
    rows += [(11, 1, "user", "again and again.")] * 500 + [(12, k, "user", "the same text.") for k in range(500)]
    rows += [(100 + k, 0, "user", "hello.") for k in range(300)]  # one first turn that many share
    return rows


@pytest.mark.parametrize("tasks", [1, 5])
def test_odd_conversations_by_force(spark, tasks):
    rows = odd_conversations()
    table = spark.createDataFrame([(*r, 9, "d", 7, "u", True, 1, "K", "s", "h") for r in rows], EXTRA).repartition(tasks)
    assert got(cv.repair(table)) == plain(rows)


def test_a_conversation_that_loses_all_rows(spark):
    lost = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    row = got(cv.repair(spark.createDataFrame([(lost, 0, "user", "Hi.")], SCHEMA)))[lost]
    assert row == dict.fromkeys(["gaps", "blank", "duplicate", "truncated", "illegal", "cost"], 0) | {"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}


def test_an_empty_table(spark):
    empty = spark.createDataFrame([], EXTRA)
    assert cv.repair(empty).count() == 0


def test_batches_may_end_anywhere(spark):
    rows = odd_conversations()
    table = spark.createDataFrame(rows, SCHEMA)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert got(cv.repair(table)) == plain(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_sorted_signatures_share_whatever_is_common():
    assert [cv.shared_length(a, b) for a, b in [("", "u"), ("ua", "uau"), ("uas", "uau"), ("u" * 999 + "a", "u" * 1500), ("s", "u")]] == [0, 2, 2, 999, 0]


def test_no_signature_is_dealt_to_one_task(spark):
    table = spark.createDataFrame([(k, t, ("user", "assistant")[t], f"{k} {t}.") for k in range(4000) for t in (0, 1)], SCHEMA)
    signed = cv.signatures(cv.damaged(table))
    spread = cv.cheapest_edits(signed).filter("signature = 'ua'").groupBy(F.spark_partition_id()).count()
    assert spread.count() > 1
