"""The paged stream and the quota with keyed state: offsets, limits, restarts, exact quotas."""

import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from doclens.sources.paged import PagedRows, PagedStreamReader
from doclens.streaming.quota import accepted, stop_when_full, write_quota

SCHEMA = "k long, class string"


@pytest.fixture
def server():
    """Rows {k, class} by offset and length; `asked` has every request for more than a row."""

    class Handler(BaseHTTPRequestHandler):
        rows, asked = 230, []

        def do_GET(self):
            q = parse_qs(urlparse(self.path).query)
            at, n = int(q["offset"][0]), int(q["length"][0])
            if n > 1:
                Handler.asked.append((at, n))
            body = json.dumps({"rows": [{"row": {"k": k, "class": "ab"[k % 3 == 0]}} for k in range(at, min(at + n, Handler.rows))]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    Handler.url = f"http://127.0.0.1:{http.server_address[1]}/?offset={{offset}}&length={{length}}"
    yield Handler
    http.shutdown()


def paged(spark, server, **options):
    spark.dataSource.register(PagedRows)
    stream = spark.readStream.format("paged_rows").option("url", server.url).option("page", 20)
    for name, value in options.items():
        stream = stream.option(name, value)
    return stream.load()


def run(stream, out, check):
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(processingTime="0 seconds").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def test_a_stream_goes_on_where_it_stopped(spark, server, tmp_path):
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    run(paged(spark, server, pages_per_batch=2, limit=90), out, check)
    numbers = lambda: sorted(r["row_number"] for r in spark.read.parquet(out).collect())
    assert numbers() == list(range(90))
    assert max(at + n for at, n in server.asked) == 90  # no page beyond the limit, the last one cut
    server.asked.clear()
    run(paged(spark, server, pages_per_batch=3), out, check)  # restarted without a limit, with other batches
    assert numbers() == list(range(230))  # no row twice, none left out
    assert min(at for at, _ in server.asked) >= 90 or min(server.asked) == (80, 10)
    run(paged(spark, server), out, check)
    assert numbers() == list(range(230))
    server.rows = 300  # rows that came later
    run(paged(spark, server), out, check)
    assert numbers() == list(range(300))


def test_rate_and_offsets():
    reader = PagedStreamReader({"url": "http://127.0.0.1:1/", "page": "10", "pages_per_batch": "4", "pages_per_second": "1"})
    reader._there = lambda row: True
    assert reader.initialOffset() == {"row": 0}
    assert reader.latestOffset() == {"row": 10} and reader.latestOffset() == {"row": 10}  # the first page at once, the next after a second
    reader.since -= 2
    assert reader.latestOffset() == {"row": 30}
    assert [(p.offset, p.length) for p in reader.partitions({"row": 5}, {"row": 30})] == [(5, 10), (15, 10), (25, 5)]
    assert reader.partitions({"row": 30}, {"row": 30}) == []
    fresh = PagedStreamReader({"url": "http://127.0.0.1:1/", "page": "10"})
    fresh.partitions({"row": 40}, {"row": 50})  # what Spark plans first after a restart
    assert fresh.latestOffset() == {"row": 50}  # the server cannot be reached: nothing new


def write(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def test_quota_with_state(spark, tmp_path):
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    wanted = {"a": 8, "b": 5, None: 3}

    def step(have=None):
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        write_quota(accepted(stream, wanted, "k", "k", have or {"b": 2}), out, check).awaitTermination()
        return spark.read.parquet(out)

    write(spark, source, [(k, "a" if k % 3 else "b") for k in range(12, -1, -1)])
    got = step()
    assert {r["k"] for r in got.filter("class = 'b'").collect()} == {0, 3, 6}  # two were there: the three smallest
    assert {r["file_name"] for r in got.filter("class = 'b'").collect()} == {f"b_{n:05d}.jpg" for n in (3, 4, 5)}
    write(spark, source, [(k, "a" if k % 3 else "b") for k in range(5, 40)])  # some keys again
    write(spark, source, [(k, None) for k in (7, 7, 8, 9, 10)] + [(None, "a"), (50, "other")])
    got = step()  # a restart: state and offsets come from the checkpoint
    counts = {r["class"]: r["count"] for r in got.groupBy("class").count().collect()}
    assert counts == {"a": 8, "b": 3, None: 3}
    assert {r["k"] for r in got.filter("class = 'a'").collect()} == {1, 2, 4, 5, 7, 8, 10, 11}
    assert sorted(r["n"] for r in got.filter("class = 'a'").collect()) == list(range(1, 9))
    write(spark, source, [(k, "a") for k in range(100, 130)])
    assert step().count() == 14


def test_a_batch_does_not_read_the_output(spark, tmp_path):
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    write(spark, source, [(k, "a") for k in range(5)])
    stream = spark.readStream.schema(SCHEMA).parquet(source)
    query = write_quota(accepted(stream, {"a": 100}, "k", "k"), out, check)
    query.awaitTermination()
    assert query.lastProgress["sources"][0]["description"].count(source) == 1 and len(query.lastProgress["sources"]) == 1
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 1


def test_a_hot_class_and_a_large_batch(spark, tmp_path):
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    spark.range(200_000).select(F.col("id").alias("k"), F.when(F.col("id") % 10 == 0, "b").otherwise("a").alias("class")).repartition(7).write.parquet(source)
    write_quota(accepted(spark.readStream.schema(SCHEMA).parquet(source), {"a": 50, "b": 50}, "k", "k"), out, check).awaitTermination()
    got = spark.read.parquet(out)
    assert sorted(r["k"] for r in got.filter("class = 'a'").collect()) == [k for k in range(60) if k % 10][:50]
    assert sorted(r["k"] for r in got.filter("class = 'b'").collect()) == list(range(0, 500, 10))


def test_from_pages_to_a_full_quota(spark, server, tmp_path):
    server.rows = 10_000
    server.asked.clear()
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    rows = paged(spark, server, pages_per_batch=2).select(F.from_json("row", SCHEMA).alias("r")).select("r.*")
    query = write_quota(accepted(rows, {"a": 30, "b": 12}, "k", "k"), out, check, "0 seconds")
    began = time.monotonic()
    assert stop_when_full(spark, query, 42, out, timeout_seconds=120) and time.monotonic() - began < 120
    got = spark.read.parquet(out)
    assert {r["class"]: r["count"] for r in got.groupBy("class").count().collect()} == {"a": 30, "b": 12}
    assert len(server.asked) < 400  # it stops early
