"""Operators that look across rows: archive, packing, sharding, near duplicates, language model, pipeline."""

import base64
import collections
import hashlib
import itertools
import math
import zlib

import numpy as np
import pyarrow as pa
import pytest
from helpers import EXTRA, SCHEMA, components_by_force, odd_rows, shingles, space_words, with_extras
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from doclens.llm import components as comp
from doclens.llm import lm
from doclens.llm import near_dup as nd
from doclens.llm import packing as pk
from doclens.llm import quality_rules as qr
from doclens.llm import sharding as sh
from doclens.llm import tally, trie, warc
from doclens.llm.common import crc_mod, cut, scratch
from doclens.llm.queries import oracle_sql, queries
from doclens.llm.textbytes import column_bytes

SF = "/root/testdata/sf0.001"
PAGES = "page_id long, url string, html string, header string, payload_key string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("name", sorted(set(oracle_sql()) - {"op11_conversation_repair", "op12_periodic_runs"}))
def test_parity(spark, name):
    from parity import assert_same, connect

    assert_same(queries()[name](spark, SF).toPandas(), connect(SF).execute(oracle_sql()[name]).df())


# ---- archive ----------------------------------------------------------------------------------------------------


def test_archive_round_trip(spark):
    rows = [(5, "http://b\r\nX: y", "same", "h", "k"), (2, "http://a", "same", "h", "k"), (2, "http://a", "same", "h", "k"), (7, None, None, None, None), (8, "u", "", None, None), (None, "n", "same", None, None), (None, "n", "only here é", None, None)]
    pages = spark.createDataFrame(rows, PAGES)
    path = scratch(spark, "test-warc")
    warc.write_archive(pages, path)
    assert spark.read.parquet(f"{path}/payloads").count() == 3  # each payload once
    records = warc.read_archive(spark, path).withColumn("record", warc.record_bytes()).collect()
    got = collections.Counter((r["page_id"], r["record_type"], r["refers_to"], bytes(r["payload"]).decode()) for r in records)
    assert got == collections.Counter({(5, "revisit", 2, "same"): 1, (2, "response", None, "same"): 2, (7, "response", None, ""): 1, (8, "revisit", 7, ""): 1, (None, "revisit", 2, "same"): 1, (None, "response", None, "only here é"): 1})
    for r in records:
        head, body = bytes(r["record"]).split(b"\r\n\r\n", 1)
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: " + r["record_type"].encode()) and b"\r\nX: y" not in head
        assert body == (b"" if r["record_type"] == "revisit" else bytes(r["payload"])) + b"\r\n\r\n"
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(bytes(r["payload"])).digest()).decode()
        assert f"Content-Length: {0 if r['record_type'] == 'revisit' else len(r['payload'])}".encode() in head


def test_small_payloads_are_responses_and_damage_is_seen(spark):
    pages = spark.createDataFrame([(1, "u", "tiny", "", ""), (2, "u", "tiny", "", ""), (3, "u", "large" * 9, "", ""), (4, "u", "large" * 9, "", "")], PAGES)
    path = scratch(spark, "test-warc")
    warc.write_archive(pages, path, min_payload=10)
    assert {r["page_id"]: r["record_type"] for r in spark.read.parquet(f"{path}/headers").collect()} == {1: "response", 2: "response", 3: "response", 4: "revisit"}
    spark.read.parquet(f"{path}/payloads").withColumn("payload", F.lit(b"x")).write.parquet(f"{path}-bad/payloads")
    with pytest.raises(Exception, match="damaged payload"):
        warc.read_payloads(spark, f"{path}-bad").collect()
    spark.read.parquet(f"{path}/headers").withColumn("header", F.regexp_replace("header", "urn:uuid:.", "urn:uuid:x")).write.parquet(f"{path}-bad/headers")
    with pytest.raises(Exception, match="damaged header"):
        warc.read_headers(spark, f"{path}-bad").collect()
    warc.write_archive(pages.limit(0), f"{path}-none")
    assert warc.read_archive(spark, f"{path}-none").count() == 0


# ---- packing ----------------------------------------------------------------------------------------------------


def check_packing(rows, pieces, how):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path(pk.VOCABULARY))
    want = collections.Counter()
    for doc_id, text in rows:
        want[doc_id, np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, how.end_id], dtype="<u4").tobytes()] += 1
    windows, whole = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        windows[p["sequence_id"]].append((p["offset"], p["length"]))
        assert len(p["ids"]) == 4 * p["length"] and zlib.crc32(bytes(p["ids"])) == p["ids_crc32"]
        whole[p["doc_id"]].append((p["start"], bytes(p["ids"]), p["doc_tokens"]))
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= how.size
    for doc_id, parts in whole.items():
        texts = [ids for (d, ids), n in want.items() for _ in range(n) if d == doc_id]
        assert sum(len(ids) for _, ids, _ in parts) == sum(map(len, texts))
        if len(texts) == 1:
            assert b"".join(ids for _, ids, _ in sorted(parts)) == texts[0] and all(n == len(texts[0]) // 4 for _, _, n in parts)
    return sum(how.size - sum(n for _, n in parts) for parts in windows.values())


@pytest.mark.parametrize("how", [pk.Packing(), pk.Packing(size=64, open_windows=3), pk.Packing(size=64, open_windows=3, fill=False)])
def test_packing_is_exact(spark, docs, how):
    odd = spark.createDataFrame(with_extras(odd_rows()), EXTRA)
    check_packing([(r[0], r[1]) for r in odd_rows()], pk.pack(odd, how).collect(), how)
    assert pk.pack(odd.limit(0), how).count() == 0
    padding = check_packing(docs.select("doc_id", "text").collect(), pk.pack(docs.repartition(7, "doc_id"), how).collect(), how)
    if how.fill:
        assert padding < how.size


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=40), st.integers(1, 5), st.booleans())
def test_packer_places_every_token_once(sizes, windows, fill):
    how, out = pk.Packing(size=16, open_windows=windows, fill=fill), []
    packer = pk.Packer(how, out.append)
    for k, n in enumerate(sizes):
        packer.add(k, np.arange(n, dtype="<u4").tobytes())
        assert len(packer.open) <= windows
    rest = packer.leftovers()
    assert sum(len(p[2]) for p in rest) < 4 * how.size
    got = collections.defaultdict(bytes)
    for doc, _, ids, _ in sorted(p for w in [*out, rest] for p in w):
        got[doc] += ids
    assert got == {k: np.arange(n, dtype="<u4").tobytes() for k, n in enumerate(sizes)}
    assert all(sum(len(p[2]) for p in w) // 4 == how.size for w in out) or not fill


def test_long_text_is_tokenised_like_the_library():
    from public_tokenizers import path
    from tokenizers import Tokenizer

    text = "Lorem ipsum, dolor's SIT 42 amet—Ünï " * 3000 + "x" * 3000
    want = Tokenizer.from_file(path(pk.VOCABULARY)).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(pk.Encoder(None, 50).block([text.encode()])[0], dtype="<u4").tolist() == want


# ---- sharding ---------------------------------------------------------------------------------------------------


def check_shards(rows, found, shards):
    assert len(found) == len(rows)
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == collections.Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    slots = collections.defaultdict(list)
    for r in found:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))
    counts = [len(slots[s]) for s in range(shards)]
    assert max(counts) - min(counts) <= 1


def test_shards_are_even_and_keep_copies_together(spark, docs):
    rows = [(k, f"text {k}") for k in range(400)] + [(1000 + k, f"copy {k // 4}") for k in range(400)]
    found = sh.shard(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    check_shards(rows, found, 16)
    where = {r["doc_id"]: r["shard"] for r in found}
    split = sum(len({where[1000 + 4 * g + j] for j in range(4)}) > 1 for g in range(100))
    assert split == 0


def fewest_cut_groups(sizes: list[int], caps: list[int]) -> int:
    """By enumeration: the fewest groups that do not lie whole in one shard (None: cut; its rows fill what is left)."""
    best = len(sizes)
    for places in itertools.product([*range(len(caps)), None], repeat=len(sizes)):
        load = [sum(n for n, p in zip(sizes, places, strict=True) if p == k) for k in range(len(caps))]
        if all(a <= b for a, b in zip(load, caps, strict=True)):
            best = min(best, places.count(None))
    return best


@pytest.mark.parametrize("seed", range(3))
def test_cut_groups_against_the_optimum(spark, seed):
    sizes = np.random.default_rng(seed).integers(2, 14, 6).tolist()
    rows = [(k, f"group {g}") for k, g in enumerate(g for g, n in enumerate(sizes) for _ in range(n))]
    rows += [(1000 + k, f"single {k}") for k in range(sum(sizes) // 2)]
    found = sh.shard(spark.createDataFrame(rows, "doc_id long, text string"), 3).collect()
    check_shards(rows, found, 3)
    texts, where = dict(rows), collections.defaultdict(set)
    for r in found:
        where[texts[r["doc_id"]]].add(r["shard"])
    assert sum(len(s) > 1 for s in where.values()) <= fewest_cut_groups(sizes, sh.quotas(len(rows), 3))


def shards_by_text(spark, rows):
    found = sh.shard(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    check_shards(rows, found, 16)
    texts, where = dict(rows), collections.defaultdict(set)
    for r in found:
        where[texts[r["doc_id"]]].add(r["shard"])
    return where


@pytest.mark.parametrize("n", [1_600, 32_000])
def test_a_hot_group_takes_as_few_shards_as_hold_it(spark, n):
    where = shards_by_text(spark, [(k, "hot" if k % 3 == 0 else f"copy {k // 12} {k % 3}") for k in range(n)])
    assert len(where["hot"]) == 6
    assert sum(len(s) > 1 for t, s in where.items() if t != "hot") <= 31


@pytest.mark.parametrize("n", [1_600, 32_000])
def test_groups_of_a_table_of_copies_stay_whole(spark, n):
    where = shards_by_text(spark, [(k, f"copy {k // 4}") for k in range(n)])
    assert sum(len(s) > 1 for s in where.values()) <= 31


def test_most_rows_in_groups(spark):
    where = shards_by_text(spark, [(k, f"copy {k // 4}" if k % 40 < 36 else f"single {k}") for k in range(24_000)])
    assert sum(len(s) > 1 for s in where.values()) <= 31


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_labels_propagate_on_the_given_tables(spark, sf, monkeypatch):
    original, met = sh._round, []
    monkeypatch.setattr(sh, "_round", lambda members, room, turn: met.append(members.select("grp").distinct().count()) or original(members, room, turn))
    docs = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet")
    found = sh.shard(docs).join(docs, "doc_id")
    linked = docs.groupBy("text").count().filter("count > 1")
    assert met[0] > 0.9 * linked.count()
    assert found.groupBy("text").agg(F.count_distinct("shard").alias("n")).filter("n > 1").isEmpty()


def test_rejected_members_ask_again(spark):
    members = spark.createDataFrame([(g, t, n) for g in range(300) for t, n in ((0, 2), (1 + g % 3, 1))], "grp long, label int, n long")
    room = [120, 300, 300, 300]
    label = {r["grp"]: r["label"] for r in sh.propagate(members, room).collect()}
    load = collections.Counter(label.values())
    assert len(label) == 300 and load[0] == 40 and all(3 * load[t] <= room[t] for t in range(4))
    assert sum(label[g] == 1 + g % 3 for g in label) > 200  # those that the full shard turned away went where their other member is
    assert sh.propagate(members, [0, 2, 2, 2]).count() == 0


@pytest.mark.parametrize("kind", ["odd", "hot", "empty", "few"])
def test_shards_of_odd_tables(spark, kind):
    rows = {"odd": odd_rows(), "hot": [(k, "hot" if k % 3 == 0 else f"t{k}", None, None, 0) for k in range(900)], "empty": [], "few": odd_rows()[:3]}[kind]
    frame = spark.createDataFrame(with_extras(rows), EXTRA)
    check_shards([(r[0], r[1]) for r in rows], sh.shard(frame).collect(), 16)


# ---- near duplicates --------------------------------------------------------------------------------------------


def edited(rng, words, share):
    return [f"z{rng.integers(1 << 40)}" if rng.random() < share else w for w in words]


def planted(seed=4, bases=12):
    """Texts of which some are exact and near copies, and a passage that many share."""
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{k}" for k in range(4000)]
    passage = list(rng.choice(vocabulary, 60))
    rows, k = [], 100
    for _ in range(bases):
        base = list(rng.choice(vocabulary, rng.integers(5, 220)))
        for _ in range(rng.integers(1, 9)):
            w = edited(rng, base, rng.choice([0, 0.005, 0.02, 0.06]))
            rows.append((k, " ".join(w + (passage if rng.random() < 0.4 else []))))
            k += 1
    return rows


@pytest.mark.parametrize("join", [nd.Join(), nd.Join(n=5, percent=80), nd.Join(group_elements=300), nd.Join(n=5, percent=80, group_elements=60, pivots=1)])
def test_components_by_force(spark, join):
    rows = planted()
    want = components_by_force(rows, join.n, join.percent)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for r in nd.near_duplicates(frame, join).collect():
        s = shingles(dict(rows)[r["doc_id"]], join.n)
        assert (r["n_shingles"], r["component_id"]) == (len(s), want[s])


def test_texts_that_share_a_passage_by_chance_are_no_cluster(spark, monkeypatch):
    """Each text shares half of its shingles with the next, whose size excludes a link: before, all were one cluster."""
    met = {}
    original = nd.cut
    monkeypatch.setattr(nd, "cut", lambda df, name, *more: met.setdefault(name, original(df, name, *more)))
    words = lambda k, n: [f"w{k}x{j}" for j in range(n)]
    passages = [words(k, 20 * 2 ** (k % 5)) for k in range(41)]
    rows = [(k, " ".join(passages[k] + passages[k + 1])) for k in range(40)]
    rows += [(100 + k, " ".join(words(100, 60) + words(200 + k, k))) for k in range(4)]  # near copies
    want = components_by_force(rows, 4, 85)
    found = nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == {i: want[shingles(t, 4)] for i, t in rows}
    assert met["members"].groupBy("label").count().agg({"count": "max"}).first()[0] == 4


@pytest.mark.parametrize("kind", ["stars that overlap", "chain", "random", "none"])
def test_components_meet_in_their_centres(spark, monkeypatch, kind):
    """Stars that overlap, as those of near copies do, are joined by their centres: the rounds do not see every edge again."""
    rng = np.random.default_rng(7)
    edges = {"stars that overlap": [(a, b) for a in range(20, 420) for b in range(20)], "chain": [(k + 1, k) for k in range(60)] + [(100, 101)] * 2 + [(7, 7)], "random": rng.integers(0, 300, (250, 2)).tolist(), "none": []}[kind]
    names = (rng.permutation(500) - 250).tolist()
    edges = [(names[a], names[b]) for a, b in edges]
    group = {k: {k} for e in edges for k in e if e[0] != e[1]}
    for a, b in edges:
        if a != b and group[a] is not group[b]:
            group[a] |= group[b]
            for k in group[b]:
                group[k] = group[a]
    rows, write = [], comp.cut

    def counted(df, name):
        out = write(df, name)
        rows.append((name, out.count()))
        return out

    monkeypatch.setattr(comp, "cut", counted)
    found = {r["node"]: r["label"] for r in comp.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found.keys() == group.keys()
    assert all(label in group[node] and all(found[k] == label for k in group[node]) for node, label in found.items())
    if kind == "stars that overlap":
        assert max(n for name, n in rows if name == "edges") < 100 < 2 * len(edges)


@pytest.mark.parametrize("percent", [50, 85, 99, 100])
def test_similar_sizes_are_of_neighbouring_classes(spark, percent):
    pairs = spark.range(1, 40_000).select(F.col("id").alias("a"), F.floor(100 * F.col("id") / percent).alias("b"))
    apart = nd.size_class(F.col("b"), percent) - nd.size_class(F.col("a"), percent)
    assert pairs.filter(~apart.isin(0, 1)).count() == 0


def test_components_of_odd_rows(spark):
    odd = spark.createDataFrame(with_extras(odd_rows()), EXTRA)
    want = components_by_force([(r[0], r[1]) for r in odd_rows()], 4, 85)
    text = {r[0]: r[1] for r in odd_rows() if r[0] is not None}
    found = nd.near_duplicates(odd).collect()
    assert len(found) == len(odd_rows())
    for r in found:
        if r["doc_id"] is not None:
            s = shingles(text[r["doc_id"]], 4)
            assert (r["n_shingles"], r["component_id"]) == (len(s), want[s] if s else r["doc_id"])
    kept = nd.keep_one(odd)
    groups = {shingles(r[1], 4) for r in odd_rows()} - {frozenset()}
    assert kept.schema == odd.schema and kept.count() == len(groups) + sum(not shingles(r[1], 4) for r in odd_rows())
    assert nd.near_duplicates(odd.limit(0)).count() == 0 and nd.keep_one(odd.limit(0)).count() == 0


def test_documents_by_force(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    want = components_by_force(rows, 4, 85)
    got = {r["doc_id"]: r["component_id"] for r in queries()["op8_ngram_join"](spark, SF).collect()}
    assert got == {i: want[s] if (s := shingles(t, 4)) else i for i, t in rows}


def test_trie_search_by_force():
    rng = np.random.default_rng(9)
    for _ in range(60):
        pool = rng.choice(1 << 30, rng.integers(3, 80), replace=False).astype(np.uint64)
        sets = [np.unique(rng.choice(pool, rng.integers(1, len(pool) + 1))) for _ in range(rng.integers(2, 25))]
        tree = trie.Trie(sets)
        for k, x in enumerate(sets):
            want = [j for j, y in enumerate(sets) if 100 * len(np.intersect1d(x, y)) >= 60 * len(np.union1d(x, y))]
            assert sorted(tree.similar(k, 60).tolist()) == want


def test_tally_round_trip():
    keys = np.unique(np.random.default_rng(0).integers(0, 1 << 63, 1000, dtype=np.uint64) << np.uint64(1))
    for width in (41, 48, 64):
        shift = np.uint64(64 - width)
        got = np.concatenate([np.cumsum(tally.unsqueeze(k, "<u8"), dtype=np.uint64) << shift for _, k, _ in tally.parts(keys, np.ones(1000), 7, width)])
        assert (got == keys >> shift << shift).all()
    assert len(tally.unsqueeze(tally.squeeze(np.zeros(0, "<u4")), "<u4")) == 0


# ---- language model ---------------------------------------------------------------------------------------------


def lm_by_force(rows, learn, model):
    texts = [[*space_words(t), None] for _, t in rows]
    taught = [w for w, r in zip(texts, rows, strict=True) if learn(r[0])]
    c1 = collections.Counter(w for text in taught for w in text)
    c2 = collections.Counter(p for text in taught for p in zip([0, *text[:-1]], text, strict=True))
    c3 = collections.Counter(p for text in taught for p in zip([0, *text[:-2]], text[:-1], text[1:]))  # noqa: B905
    n, v = sum(c1.values()), len(c1)
    p1 = lambda w: (c1[w] + 1) / (n + v + 1)
    first = lambda h: c1[h] if h else len(taught)
    out = []
    for text in texts:
        base = score = 0.0
        for k, w in enumerate(text):
            h = text[k - 1] if k else 0
            p = (c2[h, w] + model.pair_weight * p1(w)) / (first(h) + model.pair_weight)
            if k:
                g = text[k - 2] if k > 1 else 0
                p = (c3[g, h, w] + model.triple_weight * p) / (c2[g, h] + model.triple_weight)
            score += math.log10(p)
            base += math.log10(p1(w))
        out.append((len(text), sum(c1[w] > 0 for w in text), n, base, score))
    return out


@pytest.mark.parametrize("model", [lm.Model(), lm.Model(pair_weight=2, triple_weight=0.5, segment=2)])
def test_language_model_by_force(spark, docs, model, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK", 100_000)
    frame = docs.select("doc_id", "text").unionByName(spark.createDataFrame([r[:2] for r in odd_rows() if r[0] is not None], "doc_id long, text string").withColumn("doc_id", F.col("doc_id") + 10_000)).repartition(3)
    rows = [tuple(r) for r in frame.collect()]
    learn = lambda i: zlib.crc32(str(i).encode()) % 7 != 2
    got = collections.defaultdict(list)
    for r in lm.language_model_scores(frame, crc_mod("doc_id", 7) != 2, model).collect():
        got[r["doc_id"]].append(tuple(r)[1:])
    for (doc_id, _), want in zip(rows, lm_by_force(rows, learn, model), strict=True):
        assert any(g == pytest.approx(want, rel=1e-9, abs=1e-6) for g in got[doc_id])


def test_probabilities_of_every_state_sum_to_one(docs):
    rows = [r["text"] for r in docs.select("text").limit(40).collect()]
    data, offsets = column_bytes(pa.array(rows))
    row = dict(zip(lm.COLUMNS, lm.block_row(data, offsets, np.array([k % 5 != 0 for k in range(len(rows))], dtype=np.uint8)), strict=True)) | {"docs": rows}
    block = lm.Block(row)
    words, pairs, triples = block.counts()
    n, v = int(words.sum()), int((words > 0).sum())
    machine = lm.Automaton(block, words, pairs, triples, n, v, 32, lm.Model())
    arcs = collections.defaultdict(dict)
    for s, w, weight in zip(machine.arc_from.tolist(), machine.arc_word.tolist(), machine.arc_weight.tolist(), strict=True):
        if s or words[w]:
            arcs[s][w] = 10**weight
    known = {0: arcs[0]}
    assert sum(arcs[0].values()) == pytest.approx(1 - 1 / (n + v + 1))  # all but the share of unknown words
    for order in (1, 2):
        for s in np.flatnonzero(machine.order == order)[:300].tolist():
            fail, to = 10 ** machine.fail_weight[s], int(machine.fail_to[s])
            if to not in known:
                known[to] = {w: 10 ** machine.fail_weight[to] * p for w, p in arcs[0].items()} | arcs[to]
            known[s] = {w: fail * p for w, p in known[to].items()} | arcs[s]
            unknown = fail * (10 ** machine.fail_weight[to] if to else 1.0) / (n + v + 1)
            assert sum(known[s].values()) + unknown == pytest.approx(1)


def test_language_model_of_odd_tables(spark):
    odd = spark.createDataFrame(with_extras(odd_rows()), EXTRA)
    found = lm.language_model_scores(odd, crc_mod("doc_id", 7) != 2).collect()
    assert len(found) == len(odd_rows()) and all(r["score"] <= 0 for r in found)
    untaught = lm.language_model_scores(odd, F.lit(False)).collect()
    assert all(r["score"] == 0 and r["base_score"] == 0 and r["train_tokens"] == 0 for r in untaught)
    assert lm.language_model_scores(odd.limit(0), F.lit(True)).count() == 0


# ---- pipeline ---------------------------------------------------------------------------------------------------


def test_pipeline_stages_keep_what_they_should(spark, docs):
    held = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = cut(stage(spark, held, SF), f"test-{name}")
        assert out.schema == docs.schema
        before, after = ({r["doc_id"]: r["text"] for r in x.collect()} for x in (held, out))
        if name == "quality_rules":
            assert set(after) == {r["doc_id"] for r in qr.repetition_report(held).filter("kept").collect()}
        elif name == "language_id":
            assert len(after) >= 0.99 * len(before)
        elif name == "near_duplicates":
            want = components_by_force(list(before.items()), 5, 80)
            assert set(after) == {i for i, t in before.items() if not (s := shingles(t, 5)) or want[s] == i}
        else:
            from test_row_operators import force_contamination

            items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
            assert set(after) == {i for i, t in before.items() if not force_contamination(t, items)[1]}
        held = out
    last = corpus_pipeline.STAGES[-1][1](spark, held, SF).collect()
    check_packing([(r["doc_id"], r["text"]) for r in held.collect()], last, pk.Packing())


def test_pipeline_on_odd_rows(spark):
    held = spark.createDataFrame(odd_rows(), SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        held = cut(stage(spark, held, SF), "test-odd")
    # repeated words, rare languages and short texts go with the first stages; no odd row stays
    assert held.count() == 0
    empty = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        empty = cut(stage(spark, empty, SF), "test-empty")
    assert empty.count() == 0
