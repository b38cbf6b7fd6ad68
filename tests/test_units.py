import json

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from doclens.catalog import QUERIES
from doclens.functions import image_kernels as ik
from doclens.functions import text as tx
from doclens.functions.porter2 import stem
from doclens.operators import evaluate as ev
from doclens.operators import images as im
from doclens.operators import ingest as ig
from doclens.operators import layout as ly
from doclens.operators import learning as ml
from doclens.operators import tfidf as tf
from doclens.plans.ocr import examples, failures, ocr_statistics, readable, resume, run_ocr
from doclens.sources import corpus as so
from doclens.streaming.ingest import ingest, quota_reached, row_stream

#: Word pairs of the published stemmer description.
PAIRS = {
    "consign": "consign", "consigned": "consign", "consigning": "consign", "consignment": "consign", "consist": "consist", "consistency": "consist",
    "consolation": "consol", "knack": "knack", "knackeries": "knackeri", "knavish": "knavish", "knightly": "knight", "knitted": "knit", "caresses": "caress",
    "ties": "tie", "cries": "cri", "gas": "gas", "gaps": "gap", "hopping": "hop", "hoped": "hope", "luxuriated": "luxuri", "dying": "die", "news": "news",
    "generate": "generat", "general": "general", "relational": "relat", "hopefulness": "hope", "rate": "rate", "controlling": "control", "youth": "youth", "happy": "happi",
    "sky": "sky", "say": "say", "by": "by", "exceed": "exceed", "agreed": "agre", "feed": "feed", "national": "nation", "formative": "format",
}


@pytest.mark.parametrize(("word", "want"), PAIRS.items())
def test_stem(word, want):
    assert stem(word) == want


@given(st.text(alphabet="abcdefghijklmnopqrstuvwxyz'", max_size=14))
def test_stem_never_fails(word):
    assert len(stem(word)) <= len(word) + 1


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "want"), [(None, []), ("", []), (" \n", []), ("Don't STOP the canción, abc12de x", ["dont", "stop", "cancin", "abcde"]), ("the and", [])])
def test_tokens(spark, text, want):
    assert one(spark, text, tx.tokens) == want


def test_text_columns(spark):
    assert one(spark, "a b c", lambda t: tx.ngrams(F.split(t, " "), 1, 2)) == ["a", "b", "c", "a b", "b c"]
    assert one(spark, "a", lambda t: tx.ngrams(F.split(t, " "), 2, 2)) == []
    assert one(spark, "x" * 201, tx.preview) == "x" * 200 + "..."
    assert one(spark, "x" * 200, tx.preview) == "x" * 200
    assert one(spark, "--File  Folder!", tx.safe_name) == "--file_folder"
    assert one(spark, "news_article", tx.title_name) == "News Article"
    assert one(spark, "a\U0001f600b", tx.strip_astral) == "ab"
    assert one(spark, "root\\memo\\memo_1.tiff", tx.class_of_path) == "memo"
    assert one(spark, "memo/memo_1.tiff", tx.stem) == "memo_1"
    assert one(spark, "x/y.TIFF", lambda t: tx.image_extension(F.lit(None).cast("string"), t)) == "tif"


def test_split_quotas_match_recorded_supports(spark):
    sizes = [989, 973, 997, 988, 966, 499, 980, 946, 995, 996, 979, 987, 966, 990]
    supports = [198, 195, 200, 198, 193, 100, 196, 189, 199, 199, 196, 197, 193, 198]
    rows = spark.createDataFrame([(f"c{k:02d}", n) for k, n in enumerate(sizes)], "class string, n long")
    assert [r["quota"] for r in ml.split_quotas(rows).orderBy("class").collect()] == supports


def test_scalers(spark):
    rows = spark.createDataFrame([(1, [1.0, 5.0]), (2, [3.0, 5.0])], "vec_id long, vector array<double>")
    assert [r["vector"] for r in ml.standard_scaled(rows, rows).orderBy("vec_id").collect()] == [[-1.0, 0.0], [1.0, 0.0]]
    assert [r["vector"] for r in ml.minmax_scaled(rows, rows).orderBy("vec_id").collect()] == [[0.0, 0.0], [1.0, 0.0]]


def test_glcm_of_a_small_image(spark):
    image = np.array([[0, 0, 1, 1], [0, 0, 1, 1], [0, 2, 2, 2], [2, 2, 3, 3]]) * 4
    pixels = spark.createDataFrame([(1, 0, y, x, int(image[y, x])) for y in range(4) for x in range(4)], "img_id long, label int, y int, x int, v int")
    got = im.glcm_features(pixels, [(0, 1)]).first()
    p = np.zeros((4, 4))
    for row in image // 4:
        for a, b in zip(row[:-1], row[1:], strict=True):
            p[a, b] += 1
            p[b, a] += 1
    p /= p.sum()
    i, j = np.indices(p.shape)
    assert got["contrast"] == pytest.approx((p * (i - j) ** 2).sum(), abs=1e-6)
    assert got["energy"] == pytest.approx(np.sqrt((p**2).sum()), abs=1e-6)


def test_image_kernels():
    flat = np.full((32, 32), 7, dtype=np.uint8)
    histogram = ik.lbp_histogram(flat)
    assert histogram.sum() == pytest.approx(1) and histogram[24] > 0.5
    assert ik.resize(flat, 8).tolist() == [[7] * 8] * 8
    assert ik.resize(np.array([[0, 100], [100, 200]], dtype=np.uint8), 4).shape == (4, 4)
    ramp = np.tile(np.arange(64, dtype=np.uint8), (64, 1))
    assert ik.clahe(ramp).max() > ramp.max()
    two = np.array([10] * 50 + [200] * 50, dtype=np.uint8).reshape(10, 10)
    assert 10 <= ik.otsu_threshold(two) < 200


def test_otsu_relational_and_kernel_agree(spark):
    rng = np.random.default_rng(1)
    images = [rng.integers(0, 256, (8, 8), dtype=np.uint8) for _ in range(5)]
    rows = [(k, 0, y, x, int(image[y, x])) for k, image in enumerate(images) for y in range(8) for x in range(8)]
    got = {r["img_id"]: r["threshold"] for r in im.otsu_thresholds(spark.createDataFrame(rows, "img_id long, label int, y int, x int, v int")).collect()}
    assert got == {k: ik.otsu_threshold(image) for k, image in enumerate(images)}


def test_anchor_is_not_the_previous_value():
    assert ly.anchored_groups([10, 15, 17.5, 30], 8) == [0, 0, 0, 1]
    assert ly.anchored_groups([0, 7, 14], 8) == [0, 0, 1]


def test_reading_order_ignores_input_order(spark):
    boxes = [(0, "B", 60.0, 90.0, 0.0, 10.0), (1, "A", 0.0, 50.0, 1.0, 11.0), (2, "below", 0.0, 50.0, 20.0, 30.0), (3, "far", 500.0, 540.0, 0.0, 10.0), (4, "late", 0.0, 50.0, 900.0, 910.0)]
    rows = [(1, i, t, a, b, c, d, (c + d) / 2) for i, t, a, b, c, d in boxes]
    texts = set()
    for some in (rows, rows[::-1], rows[2:] + rows[:2]):
        frame = spark.createDataFrame(some, f"image_id long, item long, {ly.BOX}")
        texts.add(ly.page_text(frame, ly.reading_order(frame)).first()["text"])
    assert texts == {"A B\nbelow\n\nfar\n\nlate\n"}


def test_report_totals(spark):
    rows = spark.createDataFrame([("m", 0, 0), ("m", 0, 1), ("m", 1, 1), ("m", 2, 1)], "model string, label int, predicted int")
    assert ev.confusion(rows).agg(F.sum("n")).first()[0] == 4
    report = {r["class"]: r for r in ev.full_report(rows).collect()}
    assert report["2"]["f1"] == 0 and report["accuracy"]["f1"] == 0.5 and report["weighted avg"]["recall"] == 0.5
    assert ev.radar(spark.createDataFrame([("m", "k", 0, 0.1, 0.1, 0.1, 0.1)], "model string, kind string, ord int, accuracy double, precision double, recall double, f1 double")).count() == 0
    history = spark.createDataFrame([(1, 0.5), (2, 0.9), (3, 0.9)], "epoch int, val_accuracy double")
    assert tuple(ev.best_epoch(history).first()) == (2, 0.9)


def test_ocr_plan(spark):
    images = spark.createDataFrame([("a/1.png", "a", b"Invoices paid"), ("a/2.png", "a", b""), ("b/3.png", "b", b"!bad")], "path string, class string, content binary")

    def build():
        def engine(content: bytes) -> str:
            if content.startswith(b"!"):
                raise ValueError
            return content.decode()

        return engine

    results = run_ocr(images, build).persist()
    assert {r["path"]: (r["ok"], r["processed"]) for r in results.collect()} == {"a/1.png": (True, "invoic paid"), "a/2.png": (False, ""), "b/3.png": (False, "")}
    stats = {r["class"]: r for r in ocr_statistics(results).collect()}
    assert (stats["TOTAL"]["total"], stats["TOTAL"]["successes"], stats["a"]["rate"], stats["b"]["min_len"]) == (3, 1, 50.0, 0)
    assert failures(results).collect() == [("b", 1)] and readable(results).count() == 2
    assert resume(images, results, build).count() == 2
    assert examples(results, least=5).count() == 1


def test_manifest_repair_and_quota(spark, tmp_path):
    rows = spark.createDataFrame([("letter/letter_00001.jpg", "letter", 0)], so.MANIFEST)
    assert tuple(ig.repaired_manifest(rows).first()) == ("advertisement/advertisement_00001.jpg", "advertisement", 0)
    so.write_manifest(rows, str(tmp_path / "m"))
    so.write_manifest(rows, str(tmp_path / "m"), append=True)
    assert so.manifest(spark, str(tmp_path / "m")).count() == 2
    assert so.cached_metrics(spark, str(tmp_path / "none")) is None


def test_text_and_image_trees(spark, tmp_path):
    for name, text in (("memo/memo_1.txt", " hello "), ("memo/memo_2.txt", "  "), ("form/form_1.txt", "x")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "memo/memo_3.png").write_bytes(b"png")
    (tmp_path / "memo/memo_4.jpg").write_bytes(b"jpg")
    assert {(r["class"], r["stem"], r["text"]) for r in so.text_corpus(spark, str(tmp_path)).collect()} == {("memo", "memo_1", "hello"), ("form", "form_1", "x")}
    assert [r["name"] for r in so.image_files(spark, str(tmp_path), cap=1).collect()] == ["memo_3.png"]


def test_paths_of_long_ids(spark, tmp_path):
    ids = [7, 99_999, 100_000, 123_456, 123_457, 1_234_567_890_123, None]
    spark.createDataFrame([(k, f"text {k}", "en") for k in ids], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {r["doc_id"]: r["path"] for r in so.documents_corpus(spark, str(tmp_path)).collect()}
    assert found == {k: None if k is None else f"en/en_{k:05d}.txt" for k in ids}
    paths = QUERIES["p1_path_parts"](spark, str(tmp_path)).collect()
    assert len(paths) == len(ids)


def test_streaming_top_up(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(k, "a" if k % 3 else "b") for k in range(30)]
    spark.createDataFrame(rows[:15], "id long, class string").coalesce(1).write.parquet(source)
    spark.createDataFrame(rows[10:], "id long, class string").coalesce(1).write.mode("append").parquet(source)
    classes = spark.createDataFrame([("a",), ("b",)], "class string")
    for _ in range(2):  # the second run finds nothing new
        ingest(row_stream(spark, source, "id long, class string"), out, str(tmp_path / "check"), classes, 8, ["id"], "id").awaitTermination()
        got = spark.read.parquet(out)
        assert {r["class"]: r["count"] for r in got.groupBy("class").count().collect()} == {"a": 8, "b": 8}
        assert got.select("id").distinct().count() == 16 and got.filter("class = 'a'").select("file_name").distinct().count() == 8
    assert quota_reached(got, classes, 8) and not quota_reached(got, classes, 9)


def test_paged_source(spark, tmp_path):
    from doclens.sources.paged import PagedRows

    for at in (0, 2, 4):
        (tmp_path / f"page_{at}.json").write_text(json.dumps({"rows": [{"row": {"k": at + k}} for k in range(min(2, 5 - at))]}))
    spark.dataSource.register(PagedRows)
    got = spark.read.format("paged_rows").option("url", "file://" + str(tmp_path) + "/page_{offset}.json").option("total", 5).option("page", 2).load()
    assert sorted(r["row"] for r in got.collect()) == [json.dumps({"k": k}) for k in range(5)]


def test_sinks_guards_and_saved_index(spark, tmp_path, capsys):
    from doclens.__main__ import main
    from doclens.operators.corpus import require_documents, throughput
    from doclens.sources import sinks

    for name, text in (("memo/memo_1.txt", "invoice payment total"), ("memo/memo_2.txt", "payment schedule meeting"), ("form/form_1.txt", "address name form")):
        (tmp_path / "t" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "t" / name).write_text(text)
    main(["index", str(tmp_path / "t"), str(tmp_path / "ix")])
    main(["search", str(tmp_path / "ix"), "payment invoice"])
    shown = capsys.readouterr().out
    assert "invoice payment total" in shown and "address" not in shown
    docs = so.text_corpus(spark, str(tmp_path / "t"))
    assert require_documents(docs, 3) is docs
    with pytest.raises(ValueError, match="fewer than 4"):
        require_documents(docs, 4)
    sinks.write_vocabulary(spark.createDataFrame([("b",), ("a",)], "term string"), str(tmp_path / "v"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "v")).collect()] == ["a", "b"]
    rows = spark.createDataFrame([("m", 0, 0), ("m", 1, 0)], "model string, label int, predicted int")
    sinks.write_report(ev.full_report(rows), str(tmp_path / "r"))
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "r")).collect()]
    assert len(lines) == 5 and any("accuracy" in line and "0.5000" in line for line in lines)
    metrics = ev.model_metrics(rows).withColumn("kind", F.lit("k"))
    sinks.write_metrics(metrics, str(tmp_path / "j"))
    assert so.cached_metrics(spark, str(tmp_path / "j")).first()["accuracy"] == 0.5
    assert throughput(10, 4.0) == 2.5 and throughput(1, 0) == 0.0
    images = spark.createDataFrame([("a", "x.png", b"1"), ("a", "y.png", b"2")], "class string, name string, content binary")
    sinks.write_images(images, str(tmp_path / "i"), 128, spark.createDataFrame([("x.png",)], "name string"))
    assert [r["name"] for r in spark.read.parquet(str(tmp_path / "i")).collect()] == ["y.png"]


def test_every_document_keeps_its_row_when_stemmed(spark):
    from doclens.functions.stemming import normalize_stemmed, stemmed_tokens

    rows = spark.createDataFrame([(1, "The running dogs were happily eating"), (2, "of the"), (3, ""), (4, None)], "doc_id long, text string")
    want = {1: "run dog happili eat", 2: "", 3: "", 4: ""}
    assert {r["doc_id"]: r["text"] for r in stemmed_tokens(rows.withColumn("w", tx.tokens(F.col("text")))).collect()} == want
    assert {r["doc_id"]: r["t"] for r in rows.select("doc_id", normalize_stemmed(F.col("text")).alias("t")).collect()} == want


def test_null_classes_are_classes(spark):
    from doclens.operators import corpus as cp

    docs = spark.createDataFrame([(k, "a" if k % 2 else None, f"word{'x' * (k % 3)} text") for k in range(40)], "doc_id long, class string, text string")
    parts = ml.stratified_split(docs).groupBy("class", "part").count().collect()
    assert sorted((str(r["class"]), r["part"], r["count"]) for r in parts) == [("None", "test", 4), ("None", "train", 16), ("a", "test", 4), ("a", "train", 16)]
    found = {r["class"]: (r["n_docs"], r["n_tokens"]) for r in cp.corpus_summary(docs, tx.tokens(F.col("text"))).collect()}
    assert found == {None: (20, 40), "a": (20, 40), "TOTAL": (40, 80)}


def test_numbers_run_through_ranges(spark, monkeypatch):
    from doclens.operators import numbering as nu

    monkeypatch.setattr(nu, "RANGE_ROWS", 7)
    rows = spark.createDataFrame([((k * 37) % 101, "a" if k % 3 else None) for k in range(100)], "id long, class string")
    got = nu.numbered(rows, ["id"], nu.range_of(rows, "id"), ["class"]).collect()
    for name in ("a", None):
        own = sorted(((r["id"], r["n"]) for r in got if r["class"] == name))
        assert [n for _, n in own] == list(range(1, len(own) + 1))
    named = rows.withColumn("name", F.concat(F.lit("n"), F.format_string("%05d", "id")))
    assert [r["n"] for r in sorted(nu.numbered(named, ["name"], nu.range_of(named, "name")).collect(), key=lambda r: r["name"])] == list(range(1, 101))
    whole = nu.numbered(rows, ["id"], nu.range_of(rows, "id")).collect()
    assert [r["n"] for r in sorted(whole, key=lambda r: r["id"])] == list(range(1, 101))


def test_kernels_agree_with_pixel_tables(spark):
    rng = np.random.default_rng(2)
    images = spark.createDataFrame([(k, 0, rng.integers(0, 256, 64).tolist()) for k in range(5)] + [(9, 1, [7] * 64)], "img_id long, label int, pixels array<int>")
    pixels = im.pixel_table(images, 8)
    same = lambda a, b: sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert same(im.image_glcm(images, 8), im.glcm_features(pixels)) and same(im.image_otsu(images), im.otsu_thresholds(pixels))
    assert same(im.image_histograms(images), im.intensity_histogram(pixels)) and same(im.image_binarised(images, 8), im.binarised(pixels).select("img_id", "y", "x", "v"))


def test_classifiers_separate_what_can_be_separated(spark):
    rng = np.random.default_rng(3)
    rows = [(k, k % 2, (rng.normal(0, 1, 3) + 4 * (k % 2)).tolist()) for k in range(120)]
    frame = spark.createDataFrame(rows, "vec_id long, label int, vector array<double>")
    train, test = frame.filter("vec_id < 80"), frame.filter("vec_id >= 80")
    for estimator in (ml.linear_svc(80), ml.logistic_regression(80), ml.perceptron(3, 2, hidden=4)):
        found = ml.fit_predict(estimator, train, test)[1].collect()
        assert sum(r["label"] == r["predicted"] for r in found) >= 38
    ring = [(k, int(np.hypot(*p) > 1.2), p.tolist()) for k, p in enumerate(rng.normal(0, 1, (300, 2)))]
    frame = spark.createDataFrame(ring, "vec_id long, label int, vector array<double>")
    lifted = lambda part: ml.random_fourier_features(part, 2, gamma=0.5)
    found = ml.fit_predict(ml.linear_svc(200, 10.0), lifted(frame.filter("vec_id < 200")), lifted(frame.filter("vec_id >= 200")))[1].collect()
    assert sum(r["label"] == r["predicted"] for r in found) >= 85  # no line parts a disc from its ring


def test_logistic_regression_against_a_plain_solver(spark):
    """Gradient descent on the same penalised loss over sparse term vectors gives the same coefficients."""
    weights = spark.createDataFrame([(0, "a", 1.0), (0, "b", 0.5), (1, "b", 1.0), (2, "a", 0.2), (2, "c", 1.0), (3, "c", 0.7), (4, "a", 0.9), (5, "b", 0.8)], "doc_id long, term string, weight double")
    docs = spark.createDataFrame([(k, float(k % 2)) for k in range(7)], "doc_id long, label double")
    ids = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "term string, term_id int")
    rows = ml.tfidf_features(weights, docs, ids, 3)
    model = ml.fit_features(ml.logistic_regression(7), rows, rows, "doc_id")[0]
    got = sorted((r["doc_id"], r["features"].toArray(), r["label"]) for r in rows.collect())
    x, y = np.stack([v for _, v, _ in got]), np.eye(2)[[int(label) for _, _, label in got]]
    w, b = np.zeros((3, 2)), np.zeros(2)
    for _ in range(20_000):
        z = x @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        w -= 0.3 * (x.T @ (p - y) / 7 + w / 7)
        b -= 0.3 * (p - y).mean(axis=0)
    assert (model.coefficientMatrix.toArray()[1] - model.coefficientMatrix.toArray()[0]) == pytest.approx(w[:, 1] - w[:, 0], abs=1e-3)


def test_stages_resume_and_metrics_are_cached(spark, tmp_path):
    from doclens.plans.stages import run_stages, train_all

    ran = []

    def stage(name, make):
        return name, lambda done: ran.append(name) or make(done)

    stages = [stage("one", lambda done: spark.range(5)), stage("two", lambda done: done["one"].filter("id > 2"))]
    assert run_stages(spark, stages, str(tmp_path))["two"].count() == 2
    run_stages(spark, [*stages, stage("three", lambda done: done["two"])], str(tmp_path))
    assert ran == ["one", "two", "three"]
    rows = spark.createDataFrame([(0, 0), (1, 1), (1, 0)], "label int, predicted int")
    trained = []
    models = [(n, "k", lambda n=n: trained.append(n) or rows) for n in ("m", "o")]
    train_all(spark, models[:1], str(tmp_path / "metrics"))
    table = train_all(spark, models, str(tmp_path / "metrics")).collect()
    assert trained == ["m", "o"] and [r["model"] for r in table] == ["m", "o"]


def test_feature_tables(spark, tmp_path):
    from doclens.sources import sinks

    rows = spark.createDataFrame([(1, 0, "lbp", [0.5]), (2, 1, "lbp", [0.25]), (1, 0, "glcm", [1.0, 2.0])], "img_id long, label int, kind string, vector array<double>")
    sinks.write_features(rows, str(tmp_path / "f"))
    assert {r["img_id"]: r["vector"] for r in sinks.read_features(spark, str(tmp_path / "f"), "lbp").collect()} == {1: [0.5], 2: [0.25]}
    pixels = spark.createDataFrame([("a", "x.bin", [1, 2], 2)], "class string, name string, pixels array<int>, width int")
    sinks.write_encoded_images(pixels, str(tmp_path / "e"), lambda p, width: bytes([width, *p]))
    assert bytes(spark.read.parquet(str(tmp_path / "e")).first()["content"]) == b"\x02\x01\x02"


def test_reading_order_of_a_page():
    """Two panels of stacked lines beside each other, and one below: left before right, upper before lower, words of a line by x."""
    box = lambda item, x, y, w=40: {"item": item, "min_x": float(x), "max_x": float(x + w), "min_y": float(y), "max_y": y + 12.0, "center_y": y + 6.0}
    page = [box(0, 300, 10), box(1, 10, 12), box(2, 55, 14), box(3, 10, 40), box(4, 300, 44), box(5, 12, 400), box(6, 56, 402)]
    got = [item for item, *_ in ly.page_order(page)]
    assert got == [1, 2, 3, 0, 4, 5, 6]
    assert ly.page_blocks(page) == {0: 0, 1: 1, 2: 1, 3: 1, 4: 0, 5: 5, 6: 5}


def test_decoded_images_and_their_failures(spark):
    from doclens.plans import images as pi

    files = spark.createDataFrame([("a/1.g", "a", "1.g", bytes([2, 9, 9, 9, 9])), ("a/2.g", "a", "2.g", b""), ("b/3.g", "b", "3.g", bytes([4, *range(16)]))], "path string, class string, name string, content binary")

    def build():
        return lambda content: np.frombuffer(content[1:], dtype=np.uint8).reshape(-1, content[0])

    found = pi.decode_images(files, build)
    assert {r["name"]: (r["pixels"] and len(r["pixels"]), r["width"]) for r in found.collect()} == {"1.g": (4, 2), "2.g": (None, None), "3.g": (16, 4)}
    assert [tuple(r) for r in pi.processing_counts(found).collect()] == [(128, 2, 1), (256, 2, 1)]
    assert {r["name"]: len(r["pixels"]) for r in pi.preprocessed(found, 16).collect()} == {"1.g": 256, "3.g": 256}
    tensors = {r["name"]: np.array(r["tensor"]) for r in pi.tensors(found, 8).collect()}
    assert tensors["1.g"] == pytest.approx(np.full(64, 9 / 255)) and 0 <= tensors["3.g"].min() and tensors["3.g"].max() <= 1
    assert ik.sinc_weights(4, 4) == pytest.approx(np.eye(4), abs=1e-12)


def test_weights_inside_rows_are_those_of_postings(spark):
    rows = [(1, "a", ["x", "y", "x", "z"]), (2, None, ["y", "y", "é"]), (3, "b", []), (4, "b", ["q"]), (5, "a", ["x", "z", "z", "z"]), (None, "a", ["x"])]
    for found in (rows, [*rows, (1, "a", ["x", "w"])]):  # in the second one an id repeats
        docs = spark.createDataFrame(found, "doc_id long, class string, w array<string>").repartition(3)
        for v in (tf.Vectorizer(4), tf.Vectorizer(3, sublinear=False, smooth=False, l2=False)):
            post = tf.postings(docs, F.col("w"), "class")
            idf = v.fit(post, 6)
            n, repeat = tf.counted_ids(docs)
            assert (n, repeat) == (len(found), len(found) > 6)
            mine = tf.fitted(docs, F.col("w"), v, 6, repeat)
            assert sorted(map(tuple, mine.collect())) == sorted(map(tuple, idf.collect()))
            said = lambda df: sorted((str(r["doc_id"]), str(r["class"]), r["term"], round(r["weight"], 9)) for r in df.collect())
            assert said(tf.weighted(docs, F.col("w"), v, mine, repeat, "class")) == said(v.transform(post, idf))


def test_weights_shuffle_no_postings(spark):
    docs = spark.createDataFrame([(1, ["x", "y"]), (2, ["x"])], "doc_id long, w array<string>")
    found = tf.weighted(docs, F.col("w"), tf.Vectorizer(2), tf.fitted(docs, F.col("w"), tf.Vectorizer(2), 2, False), False)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_narrow_tiles_are_packed_together(spark, monkeypatch):
    from doclens.sources import sparse as sp

    cells = spark.createDataFrame([(r, c, float(r * 100 + c + 1)) for r in (0, 3, 5) for c in range(0, 90, 7)], "row long, column long, value double")
    calls = []
    original = type(cells.groupBy("row")).applyInArrow
    monkeypatch.setattr(type(cells.groupBy("row")), "applyInArrow", lambda self, f, schema: calls.append(f) or original(self, f, schema))
    how = sp.Tiling(tile_rows=4, tile_columns=10)
    found = sp.tiles(cells, how).collect()
    assert sorted((r["tile_row"], r["tile_column"]) for r in found) == sorted({(r // 4, c // 10) for r in (0, 3, 5) for c in range(0, 90, 7)})
    back = {(t["tile_row"] * 4 + r, t["tile_column"] * 10 + t["columns"][k]): t["values"][k] for t in found for r in range(4) for k in range(t["starts"][r], t["starts"][r + 1])}
    assert back == {(r["row"], r["column"]): r["value"] for r in cells.collect()}
    import pyarrow as pa

    group = pa.table({"tile_row": [0, 0, 0], "tile_column": [0, 0, 1], "r": pa.array([1, 0, 0], pa.int32()), "c": pa.array([2, 3, 4], pa.int32()), "v": [1.0, 2.0, 3.0]})
    assert calls[0]((pa.scalar(0), pa.scalar(0)), group).num_rows == 2  # two tiles from one call
