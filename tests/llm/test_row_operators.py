"""Operators that judge each row by itself: quality rules, classifiers, language, benchmark passages."""

import hashlib
import math
import re
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from helpers import EXTRA, FOLDED_WORDS, ODD, SCHEMA, UPPER, odd_rows, with_extras
from pyspark.sql import functions as F

from doclens.llm import decontaminate as de
from doclens.llm import langid as li
from doclens.llm import quality_rules as qr
from doclens.llm import subword as sw
from doclens.llm import toxicity as tox
from doclens.llm.common import crc_mod, look_up, mark_listed, shared_dir
from doclens.llm.textbytes import column_bytes, words

SF = "/root/testdata/sf0.001"
BENCH = "item_id long, text string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def rule_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    where: dict = {}
    for i in range(len(words) - 2):
        where.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + k for at in where.values() if len(at) > 1 for i in at for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def coverage(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, covered = set(), set()
    for i in range(len(words) - n + 1):
        gram = tuple(words[i : i + n])
        if gram in seen:
            covered.update(range(i, i + n))
        seen.add(gram)
    return sum(len(words[i]) for i in covered) / max(1, sum(map(len, words)))


def test_quality_counts_by_force(spark, docs):
    every = docs.unionByName(spark.createDataFrame(odd_rows(), SCHEMA))
    texts = every.select(F.monotonically_increasing_id().alias("doc_id"), "text").persist()
    got = {r["doc_id"]: r for r in qr.repetition_report(texts).collect()}
    for r in texts.collect():
        g = got[r["doc_id"]]
        n, chars, symbols, dup, repeat = rule_counts(r["text"])
        assert (g["n_words"], g["word_chars"], g["n_symbols"], g["n_dup_lines"], g["n_repeat_words"]) == (n, chars, symbols, dup, repeat)
        assert g["base_failed"] == (n < 50 or 100 * repeat > 50 * n)
        assert not (g["base_failed"] and g["kept"])
        for k in (5, 10):
            assert g[f"coverage_{k}"] == pytest.approx(coverage(r["text"], k))


def test_quality_keeps_clean_texts(spark):
    clean = " ".join(f"w{k}" for k in range(80))
    rows = [(1, clean), (2, clean + " #|#|" * 40), (3, "\n".join([clean[:60]] * 2 + [clean])), (4, (clean[:150] + " ") * 8)]
    got = {r["doc_id"]: r["kept"] for r in qr.repetition_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: True, 2: False, 3: True, 4: False}


def test_long_text_is_read_whole():
    text = "abc def ghi " * 400_000 + "tail"
    got = qr._measured(pa.array([text]), qr.Rules())
    assert got["n_words"][0] == 1_200_001 and got["n_repeat_words"][0] == 1_200_000


@pytest.mark.parametrize("rows", [[], odd_rows()])
def test_row_operators_on_odd_rows(spark, docs, labels, rows):
    odd = spark.createDataFrame(with_extras(rows), EXTRA)
    quality = sw.fit_quality(docs, labels, F.lit(True))
    toxic = tox.fit_toxicity(docs, labels, F.lit(True))
    language = li.learn_languages(docs, F.lit(True))
    assert qr.repetition_report(odd).count() == len(rows)
    assert qr.keep_good(odd).schema == odd.schema
    for scored in (sw.classify(odd, quality, sw.Settings(), 0.3), tox.classify(odd, toxic, tox.Settings(), 0.5, tox.score)):
        found = scored.collect()
        assert len(found) == len(rows) and all(0 <= r["score"] <= 1 for r in found)
    found = li.identify(odd, language).collect()
    assert len(found) == len(rows) and all(0 <= r["score"] <= 1 for r in found)
    und = {ODD.index(t) for t in (None, "", " \t\n\x0b\x0c\r ", "!!! ...")}
    assert {r["doc_id"] for r in found if r["lang_pred"] == "und" and r["doc_id"] is not None} >= und if rows else True
    kept = li.keep_identified(odd, language)
    assert kept.schema == odd.schema and kept.count() <= len(rows)
    bench = spark.createDataFrame([(1, "same text again here now"), (None, "word word word word word word word word word word word"), (3, None), (4, "")], BENCH)
    assert de.contamination(odd, bench).count() == len(rows)
    clean = de.drop_contaminated(odd, bench)
    assert clean.schema == odd.schema and clean.count() == max(0, len(rows) - 5)
    assert de.drop_contaminated(odd, bench.limit(0)).count() == len(rows)


def test_models_without_labels(spark, docs, labels):
    nothing = labels.limit(0)
    for fit, settings, scorer in ((sw.fit_quality, sw.Settings(), sw.score), (tox.fit_toxicity, tox.Settings(), tox.score)):
        assert scorer(pa.array(["a b c", None]), *fit(docs, nothing, F.lit(True)), settings).tolist() == [0.5, 0.5]
    none = li.learn_languages(docs.limit(0), F.lit(True))
    assert {r["lang_pred"] for r in li.identify(docs.limit(3), none).collect()} == {"und"}


def test_long_texts_are_scored_in_parts():
    words = "some word " * 100_000
    s = tox.Settings()
    weights = np.zeros(1 << s.buckets_log2, dtype=np.float32)
    raw = np.frombuffer(b" clown ", dtype=np.uint8)
    rows, buckets = tox.distinct(raw, np.array([0, len(raw)]), s)
    weights[buckets] = 1
    low, high = tox.score(pa.array([words, words + " clown " + words]), weights, -1.0, s)
    assert low == pytest.approx(1 / (1 + np.exp(1.0))) and high > 0.9
    numbers = np.random.default_rng(0).normal(size=1 << sw.Settings().buckets_log2).astype(np.float32)
    assert 0 < sw.score(pa.array([words]), numbers, 0.0, sw.Settings())[0] < 1


def test_held_out_accuracy(spark):
    from doclens.llm.queries import queries

    d = "/root/testdata/sf0.01"
    known = spark.read.parquet(f"{d}/labels.parquet")
    for name, column in (("op1_quality_classifier", "quality"), ("op4_toxicity", "toxic")):
        held = queries()[name](spark, d).join(known, "doc_id").filter("held_out").persist()
        right = held.filter(F.col("predicted") == F.col(column)).count()
        assert right >= 0.93 * held.count()
    held = queries()["op2_language_id"](spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out")
    assert held.filter("lang_pred = lang").count() >= 0.97 * held.count()


def test_every_language_is_learned_from_what_it_has(spark, monkeypatch):
    """Copies, long texts and estimates of the number of texts that are too high leave no language without its sample."""
    rows = [(k, f"kopie aa{'bcdefghijk'[k % 10]} wort", "copies") for k in range(10_000)]
    rows += [(20_000 + k, " ".join(f"wide{c}" for c in "abc") + f" {k:04d}", "wide") for k in range(3_000)]
    rows += [(30_000 + k, "größe " * 4_000 + "x" * k, "long") for k in range(3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = {}
    real = li._sample
    monkeypatch.setattr(li, "_sample", lambda usable, s: seen.setdefault("chosen", real(usable, s)))
    for far in (1, 1000):
        seen.clear()
        monkeypatch.setattr(li, "share_for", lambda wanted, there, far=far: min(1.0, (wanted + 5 * wanted**0.5) / max(1, there * far)))
        model = li.learn_languages(frame, F.lit(True))
        assert {r["lang"]: r["count"] for r in seen["chosen"].groupBy("lang").count().collect()} == {"copies": 10, "wide": 400, "long": 3}
        assert seen["chosen"].distinct().count() == 413
        assert model.languages == ["copies", "long", "wide"]
    found = li.identify(frame.filter("doc_id % 1000 < 5"), model).join(frame.select("doc_id", "lang"), "doc_id")
    assert found.filter("lang_pred <> lang").count() == 0


def test_foreign_and_random_texts_are_not_kept(spark, docs):
    rng = np.random.default_rng(1)
    drawn = [" ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(3, 9))) for _ in range(80)) for _ in range(20)]
    finnish = "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki ja omatunto " * 5
    russian = "все люди рождаются свободными и равными в своем достоинстве и правах они наделены разумом и совестью " * 5
    foreign = spark.createDataFrame([(k, t) for k, t in enumerate([*drawn, finnish, russian])], "doc_id long, text string")
    model = li.learn_languages(docs, F.lit(True))
    assert li.keep_identified(foreign, model).count() == 0
    good = qr.keep_good(docs)
    assert li.keep_identified(good, model).count() >= 0.99 * good.count()


def log_forward(index: dict, log_p: np.ndarray, data: bytes) -> float:
    """Plain forward recursion over a whole word, in logarithms."""
    a = [0.0]
    for end in range(1, len(data) + 1):
        each = [a[end - n] + log_p[k] for n in range(1, end + 1) if (k := index.get(data[end - n : end])) is not None]
        top = max(each)
        a.append(top + math.log(sum(math.exp(x - top) for x in each)))
    return a[-1]


def piece_index(vocabulary: li.Pieces) -> dict:
    import base64

    import public_tokenizers

    number = {int(h): k for k, h in enumerate(vocabulary.hashes)}
    found = {base64.b64decode(line.split()[0]) for line in open(public_tokenizers.path(li.VOCABULARY), "rb") if line.strip()} | {bytes([b]) for b in range(256)}
    return {p: number[li._hash(p)] for p in found if li._hash(p) in number}


RUNS = ["the", "haus", "x", "übermut", "a" * 31, "international" * 20, "漢字かな混じり文を読むことができますか" * 6, "".join(np.random.default_rng(3).choice(list("etaoinsrhl"), 200)), "ภาษาไทยไม่มีช่องว่างระหว่างคำ" * 3]


def test_forward_algorithm_by_force():
    """All segmentations of whole words count, of 200 bytes and more too, and the EM counts spell the words."""
    vocabulary = li.Pieces()
    index = piece_index(vocabulary)
    p = np.random.default_rng(2).random((len(vocabulary.hashes), 2))
    p /= p.sum(axis=0)
    text = " ".join(RUNS)
    column = pa.array([text, None, "", "42 !", RUNS[5]])
    total = np.zeros((len(column), 2))
    for first, count, lattices, _, rows, which in li._distinct(vocabulary, column):
        logs = np.concatenate([x.logs(p) for x in lattices])
        for j in (0, 1):
            total[first : first + count, j] += np.bincount(rows, weights=logs[which, j], minlength=count)
    for j in (0, 1):
        want = [log_forward(index, np.log(p[:, j]), b" " + w.encode()) for w in RUNS]
        assert total[0, j] == pytest.approx(sum(want), rel=1e-9) and total[4, j] == pytest.approx(want[5], rel=1e-9)
    assert (total[1:4] == 0).all()
    q = np.full((len(vocabulary.hashes), 1), 1 / len(vocabulary.hashes))
    size_of = np.zeros(len(q))
    for piece, k in index.items():
        size_of[k] = len(piece)
    used = np.zeros(len(q))
    for _, _, (lattice,), _, _, which in li._distinct(vocabulary, pa.array([text])):
        used += lattice.expected(q, np.bincount(which).astype(float))
    assert (used * size_of).sum() == pytest.approx(len(text.encode()) + 1)


def test_words_are_cut_only_where_no_piece_reaches(monkeypatch):
    """The same sums where long texts are read in parts and long words go through the other recursion."""
    vocabulary = li.Pieces()
    p = np.random.default_rng(4).random((len(vocabulary.hashes), 1)) / 1e4
    column = pa.array([" ".join(RUNS * 3)])

    def whole() -> float:
        return sum(float(np.concatenate([x.logs(p) for x in lattices])[which].sum()) for _, _, lattices, _, _, which in li._distinct(vocabulary, column, block))

    block = 1 << 20
    want = whole()
    block = 64
    assert whole() == pytest.approx(want, rel=1e-9)
    monkeypatch.setattr(li, "WORD", 3)
    assert whole() == pytest.approx(want, rel=1e-9)


def test_long_pieces_are_segments():
    vocabulary = li.Pieces()
    index = piece_index(vocabulary)
    for piece in (b" government", b" international", b" responsibilities"):
        p = np.full((len(vocabulary.hashes), 1), 1e-9)
        p[index[piece]] = 0.5
        logs = li.Lattice(vocabulary, np.frombuffer(piece[1:], dtype=np.uint8), np.array([0]), np.array([len(piece) - 1]), np.array([1])).logs(p)
        assert logs[0, 0] == pytest.approx(np.log(0.5), abs=1e-3)


def quality_by_force(text: str, numbers: np.ndarray, bias: float, s: sw.Settings) -> float:
    half, low, long = s.buckets_log2 - 1, (1 << 32) - 1, (1 << 64) - 1
    place = lambda hashed: ((hashed * 0x9E3779B97F4A7C15) & long) >> (64 - half)
    words = re.findall("[^\\x20\\x09-\\x0D]+", text)
    hashed = [li._hash(w.encode()) for w in words]
    found = [place(h) for h in hashed]
    found += [place(int(sw.SAME) if words[k] == words[k + 1] else (hashed[k] * 0xD1342543DE82EF95 + hashed[k + 1]) & long) for k in range(len(words) - 1)]
    codes = [li._hash(c.encode()) & low for c in text]
    for n in s.ngrams:
        for at in range(len(text) - n + 1):
            total = sum(codes[at + k] * int(sw._STEPS[k]) for k in range(n)) & low
            found.append(((((total ^ total >> 15) * 0x2C1B3C6D) & low) >> (32 - half)) + (1 << half))
    total = sum(float(numbers[b]) for b in found) / max(len(found), 1) + bias
    return 1 / (1 + math.exp(-total))


def test_quality_score_by_force():
    s = sw.Settings(buckets_log2=12)
    numbers = np.random.default_rng(5).normal(0, 3, 1 << 12)
    texts = ["", "a", "que que que que que", "Ünïcode straße 漢字 \U0001f600 and a longer text | with | signs, " * 4, "same words same words", "one", "one"]
    got = sw.score(pa.array([*texts, None]), numbers, 0.25, s)
    assert got == pytest.approx([quality_by_force(t, numbers, 0.25, s) for t in [*texts, ""]])


def test_quality_step_follows_the_gradient():
    rng = np.random.default_rng(6)
    vectors, layer, bias = rng.normal(0, 1, (6, 3)), rng.normal(0, 1, (3, 2)), rng.normal(0, 1, 2)
    ids, weight, rate = np.array([0, 2, 5]), np.array([0.5, 0.3, 0.2]), 1e-6

    def loss() -> float:
        z = weight @ vectors[ids] @ layer + bias
        return float(np.log(np.exp(z).sum()) - z[1])

    def slope(of: np.ndarray, at: tuple) -> float:
        held, out = of[at], []
        for shift in (1e-5, -1e-5):
            of[at] = held + shift
            out.append(loss())
        of[at] = held
        return (out[0] - out[1]) / 2e-5

    want = [np.array([slope(x, at) for at in np.ndindex(x.shape)]).reshape(x.shape) for x in (vectors, layer, bias)]
    before = [x.copy() for x in (vectors, layer, bias)]
    sw.step(vectors, layer, bias, ids, weight, 1, rate)
    for old, new, gradient in zip(before, (vectors, layer, bias), want, strict=True):
        assert (old - new) / rate == pytest.approx(gradient, rel=1e-3, abs=1e-4)


def toxic_features(text: str, s: tox.Settings) -> set[int]:
    low, codes = (1 << 32) - 1, [int(tox._CODES[tox._FOLD[b]]) for b in text.encode()]
    totals = [sum(codes[at + k] * int(tox._STEPS[k]) for k in range(n)) & low for n in s.ngrams for at in range(len(codes) - n + 1)]
    return {(((t ^ t >> 15) * 0x2C1B3C6D) & low) >> (32 - s.buckets_log2) for t in totals}


def test_toxicity_by_force():
    """Scores and log-count ratios, from sets of n-grams in plain Python."""
    s = tox.Settings(buckets_log2=12, ngrams=(3, 4))
    rng = np.random.default_rng(8)
    weights = np.where(rng.random(1 << 12) < 0.3, rng.normal(0, 1, 1 << 12), 0.0)
    texts = ["", "abc", "A nasty NASTY text, with signs!", "straße 漢字 " * 5, "calm words " * 9, "nasty again"]
    want = [1 / (1 + math.exp(-sum(weights[b] for b in toxic_features(t, s)) - 0.5)) for t in texts]
    assert tox.score(pa.array(texts), weights, 0.5, s) == pytest.approx(want)
    labels = np.array([0, 0, 1, 0, 0, 1])
    counts, ratio = tox.log_count_ratios(pa.array(texts), labels, s)
    held = [toxic_features(t, s) for t in texts]
    for b in {b for h in held for b in h} | {0, 1}:
        n = [sum(b in h for h, y in zip(held, labels, strict=True) if y == k) for k in (0, 1)]
        whole = [sum(len(h) for h, y in zip(held, labels, strict=True) if y == k) + (1 << 12) * s.smoothing for k in (0, 1)]
        assert counts[:, b].tolist() == n
        assert ratio[b] == pytest.approx(math.log((n[1] + s.smoothing) / whole[1]) - math.log((n[0] + s.smoothing) / whole[0]))


def force_contamination(text, items, window=10):
    w = FOLDED_WORDS.findall((text or "").translate(UPPER))
    hit, found = set(), set()
    for item, body in items:
        v = FOLDED_WORDS.findall((body or "").translate(UPPER))
        n = min(window, len(v))
        for j in range(len(v) - n + 1 if n else 0):
            for i in range(len(w) - n + 1):
                if w[i : i + n] == v[j : j + n]:
                    hit.update(range(i, i + n))
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("limit", [de.STATES, 9])
def test_contamination_by_force(spark, limit):
    """The same rows, whether one automaton holds all windows or several are passed in turn."""
    items = [(1, "The quick, brown fox jumps over the lazy dog and then runs far away"), (2, "short one"), (3, "Short  ONE"), (10, "über straße 漢字"), (11, "")]
    rows = [(1, "x the QUICK brown fox-jumps over the lazy dog and then stops"), (2, "a short one, a short one"), (3, None), (4, "shorts one"), (5, "Über Straße 漢字! über"), (6, "clean text"), (7, "the quick brown fox jumps over the lazy dog and then runs far away and short one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in de.contamination(docs, spark.createDataFrame(items, BENCH), limit=limit).collect()}
    for doc_id, text in rows:
        r = got[doc_id]
        n, hit, found = force_contamination(text, items)
        assert (r["n_words"], sum(b - a for a, b in zip(r["word_from"], r["word_to"], strict=True)), sorted(r["items"])) == (n, hit, found)
        for a, b, lo, hi in zip(r["char_from"], r["char_to"], r["word_from"], r["word_to"], strict=True):
            assert len(FOLDED_WORDS.findall(text[a:b].translate(UPPER))) == hi - lo
    assert de.drop_contaminated(docs, spark.createDataFrame(items, BENCH), limit=limit).count() == sum(not force_contamination(t, items)[1] for _, t in rows)
    assert de.items_digest(["1", "2"]) == hashlib.sha256(b"1,2").hexdigest()


def test_automata_are_taken_in_turn(spark, monkeypatch):
    """Between two automata the rows are written, so that no stage holds two."""
    items = [(k, f"item {k} has words of its own {k * 7} and {k * 11} to be found by") for k in range(12)]
    docs = spark.createDataFrame([(k, f"before {body} after") for k, body in items], "doc_id long, text string")
    original, plans = de.cut, []
    monkeypatch.setattr(de, "cut", lambda df, name: plans.append((name, df._jdf.queryExecution().executedPlan().toString().count("MapInArrow"))) or original(df, name))
    found = de.contamination(docs, spark.createDataFrame(items, BENCH), limit=60).collect()
    scans = [n for name, n in plans if name == "scanned"]
    assert len(scans) > 3 and max(scans) == 1
    assert all(r["items"] == [str(r["doc_id"])] for r in found)


def test_only_runs_of_known_words_are_walked():
    machine = de.Machine(["a b c", "c d"], [1, 2])
    walked = []
    automaton = machine.automaton
    machine.automaton = SimpleNamespace(iter=lambda x: walked.append(x) or automaton.iter(x))
    symbols = machine.read(de.words(*column_bytes(pa.array(["a x b c d a b c x a x c d"])), de._APART)[0])
    assert machine.hits(symbols) == [(3, 5, 2), (5, 8, 1), (11, 13, 2)]
    assert sorted(map(len, walked)) == [2, 6]


def test_crc_of_null_is_null(spark):
    assert spark.range(1).select(crc_mod("id", 5).alias("x"), F.crc32(F.lit(None).cast("binary")).alias("y")).first()["y"] is None


def test_words_of_parts_are_words_of_the_whole():
    """Texts of more than a part, words longer than one, empty rows: the same words, and none across rows."""
    column = pa.array([*ODD, "ab" * 40 + " c " * 30, "", "x", "y" * 33, "a b"])
    data, offsets = column_bytes(column)
    whole = words(data, offsets)
    for most in (1, 7, 16, 1000):
        assert all((a == b).all() for a, b in zip(whole, words(data, offsets, most=most), strict=True))
    texts = [t or "" for t in column.to_pylist()]
    assert [texts[r].encode()[a - offsets[r] : b - offsets[r]].decode() for a, b, r in zip(*whole[1:], strict=True)] == [w for t in texts for w in re.findall("[^\\x20\\x09-\\x0D]+", t)]


def test_filter_lets_all_listed_hashes_through(spark):
    rows = spark.range(3000).select(F.xxhash64("id").alias("h"), "id")
    listed = rows.filter("id < 40").select("h")
    marked = mark_listed(rows, "h", listed, 40, "maybe").filter("maybe")
    assert marked.filter("id < 40").count() == 40 and marked.count() < 400 and "filter_word" not in marked.columns


def test_hot_keys_are_looked_up_like_others(spark):
    rows = spark.createDataFrame([(k, 7 if k < 900 else k % 50) for k in range(1200)], "id long, key long")
    facts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("held"), F.min("id").alias("least"))
    got = look_up(rows, facts, "key", 1200)
    assert got.count() == 1200 and got.filter("key = 7").select("least").distinct().collect() == [(0,)]


def test_a_cluster_must_name_its_shared_folder():
    unset = SimpleNamespace(get=lambda *_: None)
    session = lambda master: SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(master=master, getConf=lambda: unset))
    assert shared_dir(session("local[2]")) == shared_dir(session("local"))
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,512]"):
        with pytest.raises(ValueError, match="checkpoint.dir"):
            shared_dir(session(master))
