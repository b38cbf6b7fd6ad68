"""Periodic runs and document fingerprints against plain Python."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from helpers import EXTRA, ODD, SPACE_WORDS, odd_rows, shingles, with_extras
from hypothesis import given, settings
from hypothesis import strategies as st
from parity import connect
from pyspark.sql import functions as F

from doclens.llm import fingerprints as fp
from doclens.llm import periodic as pr
from doclens.llm.textbytes import column_bytes

SF = "/root/testdata/sf0.001"


# ---- periodic runs ----------------------------------------------------------------------------------------------


def runs_by_force(words, least=6, times=4):
    """(start, length, period) of all runs, by comparing every word with the one q further on."""
    found = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, times * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((i, n, q) for (i, n), q in found.items())


def row_by_force(doc_id, text, edit=True):
    words = SPACE_WORDS.findall(text or "")
    n = len(words)
    if edit and doc_id is not None and n and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = sorted(runs_by_force(words), key=lambda r: (r[0], r[2]))
    gone = {i for s, w, q in runs for i in range(s + q, s + w)}
    top = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    said = "".join(f"{s},{w},{q}\n" for s, w, q in runs)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return [len(runs), *(top or [None] * 3), 1000 * top[1] // top[2] if top else None, sha(said), sha(" ".join(w for i, w in enumerate(words) if i not in gone))]


def reported(texts, ids=None, edit=False):
    return pr.report(*column_bytes(pa.array(texts, pa.string())), ids or list(range(len(texts))), edit=edit)


periodic_words = st.lists(st.one_of(st.lists(st.sampled_from("ab"), max_size=12), st.tuples(st.lists(st.sampled_from("abc"), min_size=1, max_size=6), st.integers(1, 12)).map(lambda x: x[0] * x[1])), max_size=5).map(lambda parts: [w for p in parts for w in p])


@settings(max_examples=150, deadline=None)
@given(st.lists(periodic_words, min_size=1, max_size=5), st.sampled_from([1, 2, 13]))
def test_runs_by_force(texts, top):
    texts.sort(key=len, reverse=True)
    sizes = np.array([len(t) for t in texts])
    numbers = np.array([ord(w) for t in texts for w in t], dtype=np.int64)
    found = pr.runs_of(numbers, np.repeat(np.arange(len(texts)), sizes), sizes, top=top).tolist()
    at, expected = 0, []
    for t in texts:
        expected += [(at + s, w, q) for s, w, q in runs_by_force(t)]
        at += len(t)
    assert sorted(map(tuple, found)) == sorted(expected)


def test_names_are_those_of_windows():
    random.seed(4)
    texts = sorted((random.choices("ab", k=random.randint(0, 90)) for _ in range(6)), key=len, reverse=True)
    sizes = np.array([len(t) for t in texts])
    numbers = np.array([ord(w) for t in texts for w in t], dtype=np.int64)
    upto = np.concatenate([[0], np.cumsum(sizes)])
    for k, level in enumerate(pr.names(numbers, np.repeat(np.arange(6), sizes), sizes, pr.RunRule(), 4)):
        for r, text in enumerate(texts):
            windows = [tuple(text[i : i + (1 << k)]) for i in range(len(text) - (1 << k) + 1)]
            own = level[upto[r] : upto[r] + len(windows)].tolist()
            if len(own) == len(windows):
                assert all((a == b) == (x == y) for a, x in zip(own, windows, strict=True) for b, y in zip(own, windows, strict=True))


def test_words_are_told_apart_exactly():
    texts = ["a b ab a", "é e é", "\x1ca a"]
    data, offsets = column_bytes(pa.array(texts))
    starts, ends, rows = pr.spans(data, offsets, pr.SPACE)
    words = [data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
    numbers = pr.word_numbers(data, starts, ends).tolist()
    assert len(set(zip(words, numbers, strict=True))) == len(set(words)) == len(set(numbers))


def test_periodic_rows_by_force(spark):
    random.seed(6)
    rows = [(k, (" ".join(random.choices("abcd", k=random.randint(0, 5)) + random.choices("abcd", k=random.randint(1, 9)) * random.randint(1, 9)))) for k in range(150)]
    rows += [(200 + k, t) for k, t in enumerate(ODD)] + [(None, "a " * 20), (7, "again " * 9), (7, "again " * 9)]
    table = spark.createDataFrame(with_extras([(i, t, None, "x", 3) for i, t in rows]), EXTRA)
    got = sorted(map(tuple, pr.periodic_runs(table, edit=True).collect()), key=repr)
    assert got == sorted(((i, *row_by_force(i, t)) for i, t in rows), key=repr)
    assert pr.periodic_runs(table.limit(0), edit=True).count() == 0


def test_same_runs_as_sql(spark):
    ours = {tuple(r) for r in pr.op12_periodic_runs(spark, SF).select("doc_id", *pr.REPORT).collect()}
    assert ours == set(connect(SF).execute(f"SELECT doc_id, {', '.join(pr.REPORT)} FROM ({pr.OP12_SQL})").fetchall())
    assert sum(r[1] > 0 for r in ours) > 10


def test_long_texts_are_searched_whole():
    words = [f"w{k}" for k in range(30_000)]
    text = " ".join(words + words[:9000] * 4 + ["x", "y", "z"] * 40_000)  # beyond a block, with a long period and many repeats
    row = reported([text, "a b " * 5])[0]
    assert row[:5] == [2, 66_000, 120_000, 3, 40_000_000]
    assert row[5] == hashlib.sha256(b"30000,36000,9000\n66000,120000,3\n").hexdigest()
    assert row[6] == hashlib.sha256(" ".join(words + words[:9000] + ["x", "y", "z"]).encode()).hexdigest()


def test_a_wholly_periodic_text_is_quick():
    assert reported(["la " * 300_000])[0][:5] == [1, 0, 300_000, 1, 300_000_000]


# ---- fingerprints -----------------------------------------------------------------------------------------------


def jaccard(a, b):
    x, y = shingles(a, 5), shingles(b, 5)
    return len(x & y) / len(x | y) if x | y else 1.0


def print_by_force(text, sketch):
    """The low bits by bin, from one text's shingle hashes, one at a time."""
    hashes, _ = fp.shingle_hashes(*column_bytes(pa.array([text])), sketch.n)
    least: dict = {}
    for h in map(int, hashes):
        b = h >> (64 - sketch.bins.bit_length() + 1)
        least[b] = min(least.get(b, h), h)
    if not least:
        return b""
    order, out = fp.borrowing_order(sketch.bins), 0
    for b in range(sketch.bins):
        value = least[b] if b in least else least[next(int(t) for t in order[b] if int(t) in least)]
        mixed = int(fp.mix(np.array([value], dtype=np.uint64) ^ fp.mix(np.array([b + 1], dtype=np.uint64)))[0])
        out = out << sketch.bits | mixed & ((1 << sketch.bits) - 1)
    return out.to_bytes(sketch.bins * sketch.bits // 8, "big")


TEXTS = ["", " \n", "one", "a b c d", "a b c d e", "a b c d e f", "A b C d e", "x " * 50, " ".join(map(str, range(700))), "ü ß 漢 字 \U0001f600 é"]


@pytest.mark.parametrize("sketch", [fp.Sketch(), fp.Sketch(bins=64, bits=8), fp.Sketch(n=2, bins=128, bits=1), fp.Sketch(bits=2)])
def test_fingerprints_by_force(sketch):
    assert fp.fingerprints(pa.array(TEXTS), sketch) == [print_by_force(t, sketch) for t in TEXTS]


def test_borrowing_order_tries_every_other_bin_once():
    order = fp.borrowing_order(64)
    assert all(sorted([b, *row]) == list(range(64)) for b, row in enumerate(order.tolist()))
    assert len({tuple((row - b) % 64) for b, row in enumerate(order)}) == 64  # no two bins step alike


@pytest.mark.parametrize("sketch", [fp.Sketch(), fp.Sketch(bits=1), fp.Sketch(bins=1024, bits=8)])
def test_likeness_is_unbiased(sketch):
    random.seed(8)
    vocabulary = [f"w{k}" for k in range(400)]
    for n in (12, 60, 900):
        for keep in (0, 0.5, 0.9):
            pairs = []
            for _ in range(60):
                a = random.choices(vocabulary, k=n)
                pairs.append((" ".join(a), " ".join(a[: int(n * keep)] + random.choices(vocabulary, k=n - int(n * keep)))))
            left, right = (fp.fingerprints(pa.array(side), sketch) for side in zip(*pairs, strict=True))
            errors = fp.likeness(left, right, sketch) - [jaccard(*p) for p in pairs]
            assert abs(errors.mean()) < 0.05 and (sketch.bits == 1 or np.abs(errors).max() < 0.2)


def successors_by_force(rows):
    """(id, n_chars, edited text, Jaccard to it, Jaccard to the next) of rows with distinct ids."""
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out = []
    for k, (i, t) in enumerate(ordered):
        t, after = t or "", ordered[(k + 1) % len(ordered)][1] or ""
        e = fp.edited(t, after)
        assert len(e) == len(t) - len(t) // 2 + min(len(t) // 2, len(after))
        out.append((i, len(t), e, jaccard(t, e), jaccard(t, after)))
    return out


@pytest.mark.parametrize("tasks", [1, 4, 40])
def test_successors_by_force(spark, tasks, monkeypatch):
    monkeypatch.setattr(fp, "buckets_for", lambda df, size: tasks)
    rows = [r[:2] for r in odd_rows() if r[0] is None or r[0] != 11][:-1] + [(500 + k, t) for k, t in enumerate(TEXTS)] + [(600, "the long one " * 200_000)]
    table = spark.createDataFrame(with_extras([(*r, None, None, 1) for r in rows]), EXTRA)
    got = {r["doc_id"]: r for r in fp.with_successors(table).collect()}
    expected = successors_by_force(rows)
    assert len(got) == len(expected)
    prints = dict(zip([i for i, _ in rows], fp.fingerprints(pa.array([t or "" for _, t in rows]), fp.Sketch()), strict=True))
    for i, n, e, near_edited, near_next in expected:
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (n, hashlib.sha256(e.encode()).hexdigest())
        assert r["fingerprint"] == prints[i].hex() and r["edited_fingerprint"] == fp.fingerprints(pa.array([e]), fp.Sketch())[0].hex()
        assert abs(r["near_edited"] - near_edited) < 0.2 and abs(r["near_next"] - near_next) < 0.2


def test_repeated_rows_single_rows_and_no_rows(spark):
    one = fp.with_successors(spark.createDataFrame([(1, "abcd efgh")], "doc_id long, text string")).collect()
    assert [(r["near_next"], r["edited_sha256"]) for r in one] == [(1.0, hashlib.sha256(b"abcd abcd").hexdigest())]
    assert fp.with_successors(spark.createDataFrame([], EXTRA)).count() == 0
    many = spark.createDataFrame([(5, "same words here")] * 300 + [(None, None)] * 3, "doc_id long, text string")
    got = fp.with_successors(many).groupBy("doc_id", "fingerprint", F.round("near_next", 6).alias("near")).count().collect()
    assert {(r["doc_id"], r["near"], r["count"]) for r in got} == {(5, 1.0, 299), (5, 0.0, 1), (None, 1.0, 2), (None, 0.0, 1)}


def test_equal_texts_have_equal_fingerprints(spark):
    got = fp.op13_fingerprints(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id")
    assert got.count() == 200
    assert got.groupBy("text").agg(F.count_distinct("fingerprint").alias("n")).filter("n > 1").isEmpty()


def test_odd_rows_keep_their_number(spark):
    for rows in ([], odd_rows()):
        odd = spark.createDataFrame(with_extras(rows), EXTRA)
        assert fp.with_successors(odd).count() == pr.periodic_runs(odd).count() == len(rows)
