"""Operator 8, a near-duplicate join on n-gram sets by prefix trees.

A text's set holds its distinct `n`-word shingles (64-bit hashes). Two texts link when 100 |x & y| >= percent |x | y|; the
result is the connected component of every text. No link is lost:

1. Linked sets share an element among their first |x| - ceil(percent |x| / 100) + 1 in any one global order. The order
   used here puts a fixed part of the hash space first, by how many sets hold an element (rarest first), then the rest by
   hash; the part is 1.7 times what a prefix takes. The counts come from `tally`, so that they cover all texts and grow with them. Elements of one set only are
   left out at once; a text without near copies thus leaves no trace, and passages that many texts share come last.
2. Texts that share such an element, and that size and place do not exclude, are joined to clusters (`components`): a star
   a shared element and class of sizes, never its pairs. Linked sets are of the same class or of neighbouring ones, and of
   the first element that they share at least as many elements are left in either as they must have in common; so in the
   smaller set it stands among the first |x| - ceil(2 percent |x| / (100 + percent)) + 1. Without that, rare elements that
   texts share by chance would join most of a large corpus to one cluster.
3. The sets of clusters are built again from one text a node. Texts are found by a filter of bounded size on their hash; each
   task drops the copies that it holds, the rest is shuffled to the list of wanted hashes, and the sets are written once.
   The plan is the same for every size of input.
4. The sets of a cluster meet in one prefix tree (`trie`), which is traversed by probes until every set outside the
   largest component was probed. Clusters beyond `group_elements` are dealt into blocks by one of each set's shared
   elements, those of an element that more than a block shares by hash: each block is joined by itself and with the cluster's pivots; then every set outside the cluster's largest component is
   probed against those blocks that hold a set of its own or a neighbouring class with which it shares an element of both prefixes.

Equal sets are one node throughout, so exact copies, however many, are one entry a block of input.

Defined cases. A text of fewer words has its whole sequence as its only shingle; a null text, or one without words, has
none, links with nothing and is its own component (its doc_id). A null doc_id does not count as smallest unless all of its
component's are null. Repeated rows are copies of each other. An empty table gives an empty result; further columns do not
enter it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclens.llm.common import bound_batches, buckets_for, cut, discard, give_back, look_up, mark_listed, table, text_of
from doclens.llm.components import components, tasks_for
from doclens.llm.tally import PART, add_up, by_key, parts, squeeze, totals_in_order, unsqueeze
from doclens.llm.textbytes import mix, pieces, row_blocks, window_hash, word_hashes
from doclens.llm.trie import linked

BLOCK = 2 << 20
KEY_BITS = 48
_SHORT = np.uint64(0x5707)


@dataclass(frozen=True)
class Join:
    n: int = 4
    percent: int = 85
    group_elements: int = 1 << 18
    pivots: int = 4


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    words, rows = word_hashes(data, offsets)
    at = np.searchsorted(rows, np.arange(len(offsets)))
    hashes = window_hash(words, n)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(hashes[a : b - n + 1]))
        elif b > a:
            whole = np.zeros(1, dtype=np.uint64)
            for w in words[a:b]:
                whole = mix(whole + w + _SHORT)
            out.append(whole)
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def _sets(data: np.ndarray, offsets: np.ndarray, n: int) -> Iterator[np.ndarray]:
    for a, b in row_blocks(offsets, 1 << 20):
        yield from shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], n)


def node_of(elements: np.ndarray) -> int:
    """A 64-bit name of a set of hashes, as a signed integer."""
    total = mix(elements).sum(dtype=np.uint64) + np.uint64(len(elements))
    return int(mix(np.array([total], dtype=np.uint64)).view(np.int64)[0])


def _prefix(sizes: np.ndarray, percent: int) -> np.ndarray:
    return sizes - -(-percent * sizes // 100) + 1


def _first_part(percent: int) -> np.uint64:
    return np.uint64(min((1 << 64) - 1, (1 << 64) * 17 * (100 - percent) // 1000))


_HELD = f"{PART}, docs array<struct<id: KIND, th: long, set: int>>, nodes binary, sizes binary, lows binary, places binary, extras binary, n_extras binary"


def _first_pass(join: Join, buckets: int, kind: pa.DataType | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        first_part = _first_part(join.percent)
        for batch in batches:
            for first, data, offsets in pieces(batch.column(1), BLOCK):
                count = len(offsets) - 1
                place: dict[int, int] = {}
                sets, of = [], []
                for s in _sets(data, offsets, join.n):
                    if not len(s):
                        of.append(-1)
                        continue
                    node = node_of(s)
                    if node not in place:
                        place[node] = len(sets)
                        sets.append(s)
                    of.append(place[node])
                sizes = np.array([len(s) for s in sets], dtype=np.int64)
                lows = np.array([int(np.searchsorted(s, first_part)) for s in sets], dtype=np.int64)
                low = np.concatenate([s[:k] for s, k in zip(sets, lows, strict=True)]) if sets else np.zeros(0, np.uint64)
                keys, places, counts = np.unique(low, return_inverse=True, return_counts=True)
                missing = np.maximum(_prefix(sizes, join.percent) - lows, 0)
                extras = [s[k : k + m] for s, k, m in zip(sets, lows, missing, strict=True) if m]
                rows = [(block, b, k, c, *[None] * 7) for b, k, c in parts(keys, counts, buckets, KEY_BITS, int(first_part))]
                ids, ths = batch.column(0).slice(first, count), batch.column(2).slice(first, count)
                docs = pa.StructArray.from_arrays([ids, ths, pa.array(of, pa.int32())], ["id", "th", "set"])
                rows.append((block, -1, None, None, 0, np.array(list(place), dtype="<i8").tobytes(), sizes.astype("<u4").tobytes(), lows.astype("<u4").tobytes(), squeeze(places.astype("<u4")), b"".join(e.astype("<u8").tobytes() for e in extras), missing.astype("<u4").tobytes()))
                names = ["block", "bucket", "keys", "counts", "docs", "nodes", "sizes", "lows", "places", "extras", "n_extras"]
                types = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), None, *[pa.binary()] * 6]
                columns = list(zip(*rows, strict=True))
                held = pa.ListArray.from_arrays(pa.array([0] * len(rows) + [count], pa.int32()), docs)
                arrays = [held if t is None else pa.array(c, t) for c, t in zip(columns, types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names)
                block += 1
        give_back()

    return run


def _postings(join: Join):
    """Elements of each set's prefix that more than one set holds, with the set's size `n` and `rest`, its elements from this one on."""

    def run(_: tuple, meta: pa.Table, own: pa.Table) -> pa.Table:
        tokens, nodes, ns, rests = [], [], [], []
        for row in meta.to_pylist():
            names = np.frombuffer(row["nodes"], dtype="<i8")
            sizes, lows, n_extras = (np.frombuffer(row[c], dtype="<u4").astype(np.int64) for c in ("sizes", "lows", "n_extras"))
            places = unsqueeze(row["places"], "<u4").astype(np.int64)
            held_by, keys = totals_in_order(own, shared=2)
            of = np.repeat(np.arange(len(names)), lows)
            held = held_by[places] if len(places) else places
            order = np.lexsort((places, held, of))  # rarest first, then by hash
            of, held, places = of[order], held[order], places[order]
            position = np.arange(len(of)) - np.repeat(np.cumsum(lows) - lows, lows)
            chosen = (position < _prefix(sizes, join.percent)[of]) & (held > 1) if len(of) else np.zeros(0, bool)
            tokens += [keys[places[chosen]], np.frombuffer(row["extras"], dtype="<u8")]
            nodes += [names[of[chosen]], np.repeat(names, n_extras)]
            ns += [sizes[of[chosen]], np.repeat(sizes, n_extras)]
            before = np.arange(n_extras.sum()) - np.repeat(np.cumsum(n_extras) - n_extras, n_extras)
            rests += [sizes[of[chosen]] - position[chosen], np.repeat(sizes - lows, n_extras) - before]
        return pa.table({"token": np.concatenate(tokens).view(np.int64), "node": np.concatenate(nodes), "n": np.concatenate(ns).astype(np.int32), "rest": np.concatenate(rests).astype(np.int32)})

    return run


def size_class(n: F.Column, percent: int) -> F.Column:
    """Sizes whose smaller is at least `percent` of the larger are in the same class or in neighbouring ones. The margin is for rounding."""
    width = -math.log(percent / 100) * (1 + 1e-9) or 1e-9
    return F.floor(F.log(n.cast("double")) / F.lit(width))


def _near_links(postings: DataFrame, percent: int) -> DataFrame:
    """token, a, b: links between sets that share an element of their prefixes and may be similar by sizes and places.

    Any two sets that are similar are connected by them. `early` are places that an element may have in the smaller of two
    similar sets if it is the first that they share. In a class of sizes all meet if there are two early ones, or one that is
    smaller than another set; a set meets the early ones of the class below if the largest of them is large enough. Two sets
    alone, one of them early, are held against the bound on what they can have in common.
    """
    early = F.col("rest") * (100 + percent) >= 2 * percent * F.col("n")
    packed = F.shiftleft(F.col("n").cast("long"), 32) + F.col("rest")  # a long a set, so that sums by hash do
    n, rest = lambda c: F.shiftright(c, 32), lambda c: F.col(c).bitwiseAND(F.lit((1 << 32) - 1))
    classes = postings.groupBy("token", "class").agg(
        F.count(F.lit(1)).alias("c"), F.min("node").alias("centre"), F.min(packed).alias("first"), F.max(packed).alias("last"),
        F.count_if(early).alias("n_early"), F.min(F.when(early, F.col("n"))).alias("low_early"), F.max(F.when(early, packed)).alias("top"), F.min(F.when(early, F.col("node"))).alias("early"),
    )
    few = tasks_for(postings.count())
    classes = cut(classes.coalesce(few), "classes")
    reach = lambda a, b, na, nb: F.least(a, b) * (100 + percent) >= percent * (na + nb)
    larger = (F.col("low_early") < n("last")) & ((F.col("c") > 2) | reach(rest("first"), rest("last"), n("first"), n("last")))
    own = classes.select("token", "class", F.lit(True).alias("there"), F.when((F.col("n_early") > 1) | ((F.col("n_early") == 1) & larger), F.col("centre")).alias("centre"), *(F.lit(None).cast("long").alias(c) for c in ("top", "early", "n_early")))
    below = classes.filter("n_early > 0").select("token", (F.col("class") + 1).alias("class"), F.lit(None).cast("boolean").alias("there"), F.lit(None).cast("long").alias("centre"), "top", "early", "n_early")
    merged = own.unionByName(below).groupBy("token", "class").agg(*(F.max(c).alias(c) for c in ("there", "centre", "top", "early", "n_early")))
    centres = cut(merged.filter("there AND (centre IS NOT NULL OR early IS NOT NULL)").drop("there").coalesce(few), "centres")
    discard(classes)
    met = postings.join(centres, ["token", "class"])
    # Several early sets of a class meet, so that any of them stands for the largest.
    down = (percent * F.col("n") <= 100 * n("top")) & ((F.col("n_early") > 1) | reach(F.col("rest"), rest("top"), F.col("n"), n("top")))
    ends = F.array(F.col("centre"), F.when(down, F.col("early")))
    return met.select("token", F.col("node").alias("a"), F.explode(ends).alias("b")).filter("a <> b").coalesce(few)


def _texts_of(docs: DataFrame, listed: DataFrame, n_listed: int) -> DataFrame:
    """th, t of one text for each th of listed (a written table of distinct th), or few more texts."""
    texts = docs.select(text_of("text").alias("t")).withColumn("th", F.xxhash64("t"))
    found = mark_listed(texts, "th", listed.select("th"), n_listed, "wanted").filter("wanted")
    return found.groupBy("th").agg(F.min("t").alias("t"))


def _build(rows: DataFrame, join: Join) -> DataFrame:
    """rows (t and others) with `elements`, the set of t, in place of t."""
    names = [c for c in rows.columns if c != "t"]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in pieces(batch.column(0), BLOCK):
                sets = [s.astype("<u8").tobytes() for s in _sets(data, offsets, join.n)]
                yield pa.RecordBatch.from_arrays([*(batch.column(k + 1).slice(first, len(sets)) for k in range(len(names))), pa.array(sets, pa.binary())], [*names, "elements"])
        give_back()

    kept = rows.select("t", *names)
    return kept.mapInArrow(build, ", ".join(f"{c} {kind}" for c, kind in kept.drop("t").dtypes) + ", elements binary")


def _links(sets: DataFrame, join: Join, tasks: int) -> DataFrame:
    """Links (a, b) among sets (node, grp, part, probe, elements) of the same grp and part; where some are probes, only those against all."""

    def meet(_: tuple, group: pa.Table) -> pa.Table:
        a, b = [], []
        group = group.sort_by([("part", "ascending"), ("node", "ascending")])
        part, node = group.column("part").to_numpy(), group.column("node").to_numpy()
        probe = group.column("probe").to_numpy()
        if len(part):
            new = np.ones(len(part), dtype=bool)
            new[1:] = (part[1:] != part[:-1]) | (node[1:] != node[:-1])
            rows = np.flatnonzero(new)
            probes = np.logical_or.reduceat(probe, rows)
            starts = np.flatnonzero(np.append(True, part[rows][1:] != part[rows][:-1]))
            elements = group.column("elements")
            for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(rows)], strict=True):
                found = [np.frombuffer(elements[r].as_py(), dtype="<u8") for r in rows[lo:hi].tolist()]
                mask = probes[lo:hi] if probes[lo:hi].any() else None
                for k, r in enumerate(linked(found, join.percent, mask)):
                    if r != k:
                        a.append(node[rows[lo + k]])
                        b.append(node[rows[lo + r]])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return by_key(sets.select("node", "grp", "part", "probe", "elements"), "grp", tasks).groupBy("grp").applyInArrow(meet, "a long, b long")


def _clusters(docs: DataFrame, known: DataFrame, labels: DataFrame, postings: DataFrame, join: Join) -> DataFrame:
    """node, label of the linked nodes in clusters (labels: node, label; known: node, th, n)."""
    few = tasks_for(labels.count())
    members = cut(labels.join(known.select("node", "th", "n"), "node").coalesce(few), "members")
    sized = cut(members.groupBy("label").agg(F.sum("n").alias("elements")).coalesce(few), "clusters")
    got = members.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("c")).first()
    total = int(got["n"])
    groups = max(1, -(-total // (join.group_elements // 2)))
    tasks = max(8, total >> 20)
    dealt = members.join(sized.withColumn("blocks", F.ceil(F.col("elements") / join.group_elements).cast("long")), "label")
    lone = F.col("blocks") == 1
    homes = postings.groupBy("node").agg(F.min(F.xxhash64("token")).alias("home"))  # near copies most often have the same
    dealt = cut(dealt.join(homes, "node").coalesce(few), "dealt")
    crowds = cut(dealt.filter("blocks > 1").groupBy("label", "home").agg(F.ceil(F.sum("n") / join.group_elements).cast("long").alias("crowd")).coalesce(few), "crowds")
    dealt = dealt.join(crowds, ["label", "home"], "left")
    dealt = dealt.withColumn("block", F.when(lone, 0).otherwise(F.pmod(F.xxhash64("home", F.pmod(F.xxhash64("node"), F.coalesce("crowd", F.lit(1)))), F.col("blocks"))))
    part = lambda *c: F.xxhash64(*c)
    dealt = dealt.withColumn("grp", F.when(lone, F.pmod(F.xxhash64("label"), F.lit(groups))).otherwise(part("label", "block"))).withColumn("part", F.when(lone, F.col("label")).otherwise(part("label", "block")))
    texts = _texts_of(docs, members, int(got["c"])).join(dealt.select("th", "node", "label", "n", "blocks", "block", "grp", "part"), "th")
    sets = cut(_build(texts.drop("th").coalesce(tasks), join).withColumn("probe", F.lit(False)), "sets")
    discard(sized)
    large = sets.filter("blocks > 1")
    if large.isEmpty():
        return components(cut(_links(sets, join, tasks), "links"))
    ranked = large.groupBy("label", "blocks").agg(*(F.min_by("node", F.xxhash64("node", F.lit(k + 1))).alias(f"p{k}") for k in range(join.pivots)))
    pivots = cut(ranked.select("label", "blocks", F.explode(F.array_distinct(F.array(*(f"p{k}" for k in range(join.pivots))))).alias("node")), "pivots")
    spread = large.join(pivots.select("node"), "node").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    spread = spread.withColumn("grp", part("label", "block")).withColumn("part", F.col("grp"))
    edges = cut(_links(sets.unionByName(spread.select(sets.columns)), join, tasks), "links")

    at = large.select("node", "label", "n", "block").join(components(edges).select("node", F.col("label").alias("comp")), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    at = cut(at.coalesce(few), "placed")
    largest = cut(at.groupBy("label", "comp").agg(F.count(F.lit(1)).alias("c")).groupBy("label").agg(F.max_by("comp", F.struct("c", "comp")).alias("largest")).coalesce(few), "largest")
    outside = cut(at.join(largest, "label").filter("comp <> largest").select("node", "label", "n", F.col("block").alias("own")).coalesce(few), "outside")
    if outside.isEmpty():
        return components(edges)
    # A set outside its cluster's largest component meets the other blocks that hold one of its shared prefix elements, in runs of a block's elements.
    held = cut(postings.join(at.select("node", "block"), "node").select("token", "class", "block").distinct().coalesce(few), "token-blocks")
    near = F.explode(F.array(*(F.col("class") + k for k in (-1, 0, 1))))
    visits = cut(postings.join(outside, "node").withColumn("class", near).join(held, ["token", "class"]).filter("block <> own").select("node", "label", "n", "block").distinct().coalesce(few), "visits")
    runs = visits.groupBy("label", "block").agg(F.ceil(F.sum("n") / join.group_elements).cast("long").alias("runs"))
    probes = visits.join(runs, ["label", "block"]).withColumn("run", F.pmod(F.xxhash64("node", F.lit(9)), F.col("runs")))
    base = at.select("node", "label", "block").join(runs, ["label", "block"]).withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.col("runs") - 1)))
    key = part("label", "block", "run")
    second = probes.select("node", key.alias("grp"), F.lit(True).alias("probe")).unionByName(base.select("node", key.alias("grp"), F.lit(False).alias("probe")))
    again = cut(second.withColumn("part", F.col("grp")).coalesce(few), "second")
    visited = runs.agg(F.coalesce(F.sum("runs"), F.lit(0))).first()[0]  # groups of two blocks' elements at most: a task each
    more = cut(_links(again.join(large.select("node", "elements"), "node"), join, max(8, int(visited))), "links")
    return components(edges.unionByName(more))


def near_duplicates(docs: DataFrame, join: Join | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a row of docs: id_col, n_shingles, component_id, and th (xxhash64 of the text) and grp (null without shingles) of its component."""
    join = join or Join()
    bound_batches(docs.sparkSession)
    docs = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    buckets = buckets_for(docs, 8 << 20)
    keyed = docs.select("id", "text", F.xxhash64(text_of("text")).alias("th"))
    held = cut(keyed.mapInArrow(_first_pass(join, buckets), _HELD.replace("KIND", kind)), "shingles")

    own = add_up(held.filter("bucket >= 0"), buckets, bits=KEY_BITS, shared=2)
    meta = held.filter("bucket = -1").select("block", "nodes", "sizes", "lows", "places", "extras", "n_extras")
    meet = by_key(meta, "block", buckets).groupBy("block").cogroup(by_key(own, "block", buckets).groupBy("block"))
    found = meet.applyInArrow(_postings(join), "token long, node long, n int, rest int")
    postings = cut(found.withColumn("class", size_class(F.col("n"), join.percent)), "postings")
    links = cut(_near_links(postings, join.percent), "near-links")
    shared = postings.select("token", "class", "node").join(links.select("token").distinct(), "token", "left_semi")
    shared = cut(shared.coalesce(tasks_for(links.count())), "shared")
    discard(postings)
    labels = components(links.select("a", "b"))

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                docs_of = batch.column(0)[k].values
                of = docs_of.field("set").to_numpy(zero_copy_only=False)
                none = of < 0
                pick = np.where(none, 0, of)
                nodes = np.append(np.frombuffer(batch.column(1)[k].as_py(), dtype="<i8"), 0)
                sizes = np.append(np.frombuffer(batch.column(2)[k].as_py(), dtype="<u4").astype(np.int64), 0)
                yield pa.RecordBatch.from_arrays([docs_of.field("id"), docs_of.field("th"), pa.array(np.where(none, 0, sizes[pick])), pa.array(nodes[pick], mask=none)], ["id", "th", "n", "node"])

    rows = cut(held.filter("bucket = -1").select("docs", "nodes", "sizes").mapInArrow(expand, f"id {kind}, th long, n long, node long"), "documents")
    discard(held)
    filled, bare = rows.filter("node IS NOT NULL"), rows.filter("node IS NULL")
    known = cut(filled.groupBy("node").agg(F.min("th").alias("th"), F.min("n").alias("n"), F.min("id").alias("own_least"), F.count(F.lit(1)).alias("held")), "nodes")
    found = cut(_clusters(docs, known, labels, shared, join).withColumnRenamed("label", "grp"), "grouped")
    named = cut(found.join(known.select("node", "own_least"), "node"), "named")
    least = cut(named.groupBy("grp").agg(F.min("own_least").alias("least")), "least")
    of_node = cut(named.join(least, "grp").select("node", "grp", "least"), "of-node")
    facts = cut(known.select("node", "own_least", "held").join(of_node, "node", "left").select("node", "held", F.coalesce("grp", "node").alias("grp"), F.when(F.col("grp").isNull(), F.col("own_least")).otherwise(F.col("least")).alias("component_id")), "facts")
    total = known.agg(F.coalesce(F.sum("held"), F.lit(0))).first()[0]
    out = look_up(filled, facts, "node", int(total)).select("id", "n", "component_id", "th", "grp")
    out = out.unionByName(bare.select("id", "n", F.col("id").alias("component_id"), "th", F.lit(None).cast("long").alias("grp")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", "th", "grp")


def keep_one(docs: DataFrame, join: Join | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, that of the smallest id (null ids last), with all its columns. Rows without shingles stay."""
    found = near_duplicates(docs, join, id_col, text_col).select(F.col(id_col).alias("drop_id"), F.col("th").alias("drop_th"), "grp").filter("grp IS NOT NULL")
    keys = ["drop_id", "drop_th"]
    inside = cut(found.groupBy("grp", *keys).agg(F.count(F.lit(1)).alias("c")), "components")
    first = inside.groupBy("grp").agg(F.min(F.struct(F.col("drop_id").isNull().alias("none"), *keys)).alias("w"), F.count(F.lit(1)).alias("held"), F.max("c").alias("copies"))
    first = cut(first, "firsts")
    several = first.filter("held > 1 OR copies > 1")
    total = several.agg(F.coalesce(F.sum("held"), F.lit(0))).first()[0]
    # Listed are only the rows of components of more than one: the kept one where it is repeated, and those that go.
    inside = inside.join(several.select("grp"), "grp", "left_semi")
    listed = look_up(inside, several.select("grp", "w", "held"), "grp", int(total)).withColumn("goes", ~(F.col("drop_id").eqNullSafe(F.col("w.drop_id")) & (F.col("drop_th") == F.col("w.drop_th")))).filter("goes OR c > 1")
    listed = cut(listed.select(*keys, "goes"), "dropped")
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("held"), F.col(f"`{id_col}`").alias("row_id"), F.xxhash64(text_of(f"`{text_col}`")).alias("row_th"))
    # Rows whose text is listed nowhere stay where they are; the others are shuffled to the list, by id too, so that copies part.
    marked = mark_listed(held, "row_th", listed.select(F.col("drop_th").alias("row_th")), listed.count(), "maybe")
    some = marked.filter("maybe")
    some = some.join(listed, (some["row_th"] == listed["drop_th"]) & some["row_id"].eqNullSafe(listed["drop_id"]), "left").filter("goes IS NULL OR NOT goes")
    # `goes` is null for a row that is listed nowhere; a repeated kept row loses its repetitions
    once = marked.filter("NOT maybe").select("held").unionByName(some.filter("goes IS NULL").select("held")).unionByName(some.filter("NOT goes").dropDuplicates(["row_id", "row_th"]).select("held"))
    return once.select(*(F.col(f"held.`{c}`").alias(c) for c in docs.columns))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


OP8_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
e AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
l AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
r AS (SELECT doc_id, doc_id AS o FROM s UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.o = l.a)
SELECT s.doc_id, len(any_value(s.s))::BIGINT AS n_shingles, min(r.o) AS component_id FROM s JOIN r ON r.doc_id = s.doc_id GROUP BY s.doc_id
"""
