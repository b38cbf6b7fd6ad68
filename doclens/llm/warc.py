"""Operator 3, a content-addressed web archive.

An archive is a folder of two Parquet tables. `payloads` holds each distinct payload once, under its SHA-256; `headers`
holds the exact header block of every record and the key of its payload. Reading verifies every payload against its key
(a mismatch raises) and every header block against its row and payload, and rebuilds records by joining the two.

Of the records that share a payload of at least `min_payload` bytes, the one with the smallest page_id is the response;
the others are revisits that refer to it. Smaller payloads are all responses.

Defined cases. A null html is an empty payload. A null page_id sorts after all others; where all sharers are null they
are all responses. Rows that repeat the smallest page_id are all responses (their payload is still stored once). A null
url gives an empty target URI. Further columns are not archived. An empty table gives an archive without records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doclens.llm.common import scratch, table

#: The digits that Spark's base conversion uses and the RFC 4648 base32 alphabet.
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_CRLF = "\r\n"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of SHA-1: eight groups of five hexadecimal digits, each four base32 digits."""
    digest = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digest, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*groups), _DIGITS, _BASE32)


def _record_id(page_id: Column, key: Column) -> Column:
    h = F.md5(F.concat_ws(":", F.coalesce(page_id.cast("string"), F.lit("")), key))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-"), part(13, 4), F.lit("-"), part(17, 4), F.lit("-"), part(21, 12), F.lit(">"))


def _header_block(date: str) -> Column:
    """The record's header lines, CRLF after each; the empty line that ends the block is not part of it."""
    revisit = F.col("record_type") == "revisit"
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(_CRLF))
    return F.concat(
        F.lit(f"WARC/1.1{_CRLF}"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("payload_key"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"[\r\n]", "")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", _record_id(F.col("refers_to"), F.col("payload_key"))), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("payload_bytes").cast("string"))),
    )


def write_archive(pages: DataFrame, path: str, min_payload: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes one record for each row of pages (page_id, url, html) under path.

    Sharers are found on digests alone. Payload bytes pass one shuffle, after each task has dropped the copies that it holds.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    records = pages.select("page_id", F.col("url").cast("string").alias("url"), F.sha2(payload, 256).alias("payload_key"), base32_sha1(payload).alias("payload_digest"), F.octet_length(payload).cast("long").alias("payload_bytes"))
    firsts = records.groupBy("payload_key").agg(F.min("page_id").alias("first_id"))
    joined = records.join(firsts, "payload_key")
    revisit = (F.col("payload_bytes") >= min_payload) & F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    typed = joined.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn("refers_to", F.when(revisit, F.col("first_id")))
    typed.select("page_id", "payload_key", "payload_bytes", "payload_digest", "record_type", "refers_to", _header_block(date).alias("header")).write.option("compression", "zstd").parquet(f"{path}/headers")

    stored = pages.select(F.sha2(payload, 256).alias("payload_key"), payload.alias("payload"))
    stored.dropDuplicates(["payload_key"]).write.option("compression", "zstd").parquet(f"{path}/payloads")


def _field(name: str) -> Column:
    """The value of a line of the header block, an empty string where there is none."""
    return F.regexp_extract("header", rf"\r\n{name}: ([^\r]*)\r\n", 1)


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_key, refers_to, and what the exact header block of each record says: record_type, said_digest, said_bytes.

    Raises where a block does not bear the record's own identifier, or refers to another record than the row does.
    """
    found = spark.read.parquet(f"{path}/headers").select("page_id", "payload_key", "refers_to", _field("WARC-Type").alias("record_type"), F.substring_index(_field("WARC-Payload-Digest"), ":", -1).alias("said_digest"), _field("Content-Length").cast("long").alias("said_bytes"), _field("WARC-Record-ID").alias("__id"), _field("WARC-Refers-To").alias("__of"))
    refers = F.when(F.col("record_type") == "revisit", _record_id(F.col("refers_to"), F.col("payload_key"))).otherwise(F.lit(""))
    sound = (F.col("__id") == _record_id(F.col("page_id"), F.col("payload_key"))) & (F.col("__of") == refers)
    return found.withColumn("record_type", _or_raise(sound, F.col("record_type"), F.col("page_id"))).drop("__id", "__of")


def _or_raise(sound: Column, value: Column, page_id: Column) -> Column:
    return F.when(sound, value).otherwise(F.raise_error(F.concat(F.lit("damaged header of page "), F.coalesce(page_id.cast("string"), F.lit("null")))).cast("string"))


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """payload_key, payload; raises where a payload does not have the digest it is stored under."""
    found = spark.read.parquet(f"{path}/payloads")
    sound = F.sha2(F.col("payload"), 256) == F.col("payload_key")
    return found.withColumn("payload", F.when(sound, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("payload_key"))).cast("binary")))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Every record with its header columns, exact header block and full payload; a revisit gets the payload it refers to."""
    return spark.read.parquet(f"{path}/headers").join(read_payloads(spark, path), "payload_key")


def record_bytes() -> Column:
    """The WARC serialisation of a row of read_archive: header block, empty line, body (none for a revisit), two CRLF."""
    body = F.when(F.col("record_type") == "revisit", F.lit("").cast("binary")).otherwise(F.col("payload"))
    return F.concat(F.col("header").cast("binary"), F.lit(_CRLF).cast("binary"), body, F.lit(_CRLF * 2).cast("binary"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "op3")
    write_archive(table(spark, sf_dir, "pages"), path)
    facts = read_payloads(spark, path).select("payload_key", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"))
    records = read_headers(spark, path).join(facts, "payload_key")
    length = F.when(F.col("record_type") == "revisit", F.lit(0)).otherwise(F.col("payload_bytes"))
    sound = (F.col("said_digest") == F.col("payload_digest")) & (F.col("said_bytes") == length)
    return records.select("page_id", "payload_bytes", _or_raise(sound, F.col("payload_digest"), F.col("page_id")).alias("payload_digest"), "record_type", "refers_to")


OP3_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h, min(page_id) OVER (PARTITION BY sha256(b)) AS f FROM p)
SELECT page_id, n::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(h, 1 + 5 * (k // 4)::INT, 5))::BIGINT >> (15 - 5 * (k % 4))::BIGINT) & 31)::INT, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> f THEN f END AS refers_to
FROM d
"""
