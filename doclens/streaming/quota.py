"""Top-up to a quota a class with keyed state (R2, R3, W1, W2, J4, J12): what a batch costs does not depend on what was written.

The state of a class is the number and the keys of the rows accepted so far, so it is bounded by the target. Of the rows that
a batch brings, those with the smallest `order` are accepted, new keys only, until the class is full; they are numbered and
named on from what was there. The file sink writes each batch once, and state and offsets are in the checkpoint, so after a
restart every class gets exactly its quota.

Defined cases. A null class is a class, with files named after it as `null`. Rows without a key are left out. A class that is
not listed is left out. Repeated keys count once, the smallest order first. A class with more rows than the target before the
stream begins gets none.
"""

from __future__ import annotations

import heapq
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Name under which a class that is null is kept in the state.
NO_CLASS = "\0"


def accepted(rows: DataFrame, wanted: dict[str | None, int], key: str, order: str, have: dict[str | None, int] | None = None) -> DataFrame:
    """class, key, n and file_name of the streaming rows (class, key, order) that the classes still need.

    `wanted` is the target by class and `have` what each had before the stream began; both are a number a class.
    """
    have = have or {}
    kinds = {c: rows.schema[c].dataType.simpleString() for c in (key, order)}
    name = F.coalesce(F.col("class").cast("string"), F.lit(NO_CLASS))
    chosen = rows.filter(F.col(key).isNotNull()).select(name.alias("class"), F.col(key).alias("key"), F.col(order).alias("order"))
    chosen = chosen.filter(F.col("class").isin([NO_CLASS if c is None else c for c in wanted]))

    def top_up(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        label = None if group[0] == NO_CLASS else group[0]
        n, keys = state.get if state.exists else (have.get(label, 0), [])
        room, seen = wanted[label] - n, set(keys)
        best: dict = {}  # of the batch's new keys those of smallest order, at most twice the room
        for part in parts:
            if room <= 0:
                continue
            for k, o in zip(part["key"].tolist(), part["order"].tolist(), strict=True):
                if k not in seen and (k not in best or (o, k) < best[k]):
                    best[k] = (o, k)
            if len(best) > 2 * room:
                best = {x[1]: x for x in heapq.nsmallest(room, best.values())}
        taken = [k for _, k in heapq.nsmallest(max(room, 0), best.values())]
        state.update((n + len(taken), [*keys, *taken]))
        numbers = range(n + 1, n + len(taken) + 1)
        shown = "null" if label is None else label
        yield pd.DataFrame({"class": [label] * len(taken), key: taken, "n": list(numbers), "file_name": [f"{shown}_{i:05d}.jpg" for i in numbers]})

    out, held = f"class string, `{key}` {kinds[key]}, n long, file_name string", f"n long, keys array<{kinds[key]}>"
    return chosen.groupBy("class").applyInPandasWithState(top_up, out, held, "append", GroupStateTimeout.NoTimeout)


def write_quota(found: DataFrame, out: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Appends what `accepted` gives to Parquet files in `out`: all that is there and then ends, or for good at an interval."""
    writer = found.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def stop_when_full(spark: SparkSession, query: StreamingQuery, found_rows: int, out: str, poll_seconds: float = 0.2, timeout_seconds: float = 3600) -> bool:
    """Stops a running query once `out` holds so many rows (counted from the files' footers), or the time is over; says whether it does."""
    until = time.monotonic() + timeout_seconds
    schema = "class string"
    while query.isActive and time.monotonic() < until:
        before = query.lastProgress
        if before is not None and spark.read.schema(schema).parquet(out).count() >= found_rows:
            query.stop()
            return True
        time.sleep(poll_seconds)
    query.stop()
    return False
