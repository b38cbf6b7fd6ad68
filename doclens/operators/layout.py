"""Reading order from text boxes.

A page's boxes are few and belong together, so a page is one Arrow group; edges are also available as a relational join.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOX = "text string, min_x double, max_x double, min_y double, max_y double, center_y double"


def boxes_from_polygons(rows: DataFrame, polygon: str = "poly") -> DataFrame:
    """Bounding box and mean height of four-cornered polygons (array of x, y)."""
    xs, ys = F.transform(polygon, lambda p: p["x"]), F.transform(polygon, lambda p: p["y"])
    centre = F.aggregate(ys, F.lit(0.0), lambda s, y: s + y) / 4
    return rows.withColumns({"min_x": F.array_min(xs), "max_x": F.array_max(xs), "min_y": F.array_min(ys), "max_y": F.array_max(ys), "center_y": centre})


def _gap(low_a: Column, high_a: Column, low_b: Column, high_b: Column) -> Column:
    return F.greatest(F.lit(0.0), low_a - high_b, low_b - high_a)


def box_edges(boxes: DataFrame) -> DataFrame:
    """image_id, a, b (a < b): boxes on one line, or stacked. An equality join on the page, then the spatial condition."""
    a, b = boxes.alias("a"), boxes.alias("b")
    dx = _gap(F.col("a.min_x"), F.col("a.max_x"), F.col("b.min_x"), F.col("b.max_x"))
    dy = _gap(F.col("a.min_y"), F.col("a.max_y"), F.col("b.min_y"), F.col("b.max_y"))
    near = ((F.abs(F.col("a.center_y") - F.col("b.center_y")) < 6) & (dx < 20)) | ((dx < 25) & (dy < 50))
    joined = a.join(b, (F.col("a.image_id") == F.col("b.image_id")) & (F.col("a.item") < F.col("b.item")) & near)
    return joined.select(F.col("a.image_id").alias("image_id"), F.col("a.item").alias("a"), F.col("b.item").alias("b"))


def anchored_groups(values: list[float], tolerance: float) -> list[int]:
    """Group numbers of sorted values: a value joins while it is within tolerance of the first of its group."""
    out, anchor, group = [], None, -1
    for v in values:
        if anchor is None or abs(v - anchor) >= tolerance:
            anchor, group = v, group + 1
        out.append(group)
    return out


def page_blocks(boxes: list[dict]) -> dict:
    """The smallest item of each box's block (connected component), by item. Boxes are swept from left to right."""
    up = {b["item"]: b["item"] for b in boxes}

    def root(k):
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    rows = sorted(boxes, key=lambda b: b["min_x"])
    for k, a in enumerate(rows):
        for b in rows[k + 1 :]:
            dx = max(0.0, b["min_x"] - a["max_x"])
            if dx >= 25:
                break  # all that follow are further to the right
            dy = max(0.0, b["min_y"] - a["max_y"], a["min_y"] - b["max_y"])
            if (abs(a["center_y"] - b["center_y"]) < 6 and dx < 20) or dy < 50:
                x, y = root(a["item"]), root(b["item"])
                up[max(x, y)] = min(x, y)
    return {k: root(k) for k in up}


def page_order(boxes: list[dict]) -> list[tuple]:
    """(item, block, panel, place, line, position) of a page's boxes in reading order."""
    block_of = page_blocks(boxes)
    blocks: dict = {}
    for b in sorted(boxes, key=lambda b: b["item"]):
        blocks.setdefault(block_of[b["item"]], []).append(b)
    centre = {}
    for block, own in blocks.items():
        x, y = min(b["min_x"] for b in own) + max(b["max_x"] for b in own), min(b["min_y"] for b in own) + max(b["max_y"] for b in own)
        centre[block] = (y / 2, x / 2)
    down = sorted(blocks, key=lambda k: (*centre[k], k))
    panel_of = dict(zip(down, anchored_groups([centre[k][0] for k in down], 180), strict=True))
    out = []
    for place, block in enumerate(sorted(down, key=lambda k: (panel_of[k], centre[k][1], centre[k][0]))):
        own = sorted(blocks[block], key=lambda b: (b["center_y"], b["min_x"], b["item"]))
        lines = anchored_groups([b["center_y"] for b in own], 8)
        for line, b in sorted(zip(lines, own, strict=True), key=lambda x: (x[0], x[1]["min_x"], x[1]["item"])):
            out.append((b["item"], block, panel_of[block], place, line, len(out)))
    return out


def reading_order(boxes: DataFrame) -> DataFrame:
    """image_id, item, block, panel, place (of the block), line (in the block), position; independent of input order."""
    kind = boxes.schema["image_id"].dataType.simpleString()
    names = ["item", "block", "panel", "place", "line", "position"]

    def run(key: tuple, group: pa.Table) -> pa.Table:
        columns = list(zip(*page_order(group.to_pylist()), strict=True))
        ids = pa.array([key[0].as_py()] * group.num_rows, group.schema.field("image_id").type)
        return pa.table({"image_id": ids} | {n: pa.array(c, pa.int64()) for n, c in zip(names, columns, strict=True)})

    needed = boxes.select("image_id", F.col("item").cast("long").alias("item"), "min_x", "max_x", "min_y", "max_y", "center_y")
    return needed.groupBy("image_id").applyInArrow(run, f"image_id {kind}, " + ", ".join(f"{n} long" for n in names))


def page_text(boxes: DataFrame, order: DataFrame) -> DataFrame:
    """image_id, text: items of a line joined by spaces, a blank line after each block."""
    joined = order.join(boxes.select("image_id", "item", "text"), ["image_id", "item"])
    lines = joined.groupBy("image_id", "place", "line").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "text"))), lambda s: s["text"]), " ").alias("t"))
    blocks = lines.groupBy("image_id", "place").agg(F.concat(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "t"))), lambda s: s["t"]), "\n"), F.lit("\n")).alias("t"))
    return blocks.groupBy("image_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "t"))), lambda s: s["t"]), "\n").alias("text"))


def block_boxes(boxes: DataFrame, blocks: DataFrame) -> DataFrame:
    """Bounding box and centre of each block."""
    found = boxes.join(blocks.select("image_id", "item", "block"), ["image_id", "item"]).groupBy("image_id", "block").agg(F.min("min_x").alias("min_x"), F.max("max_x").alias("max_x"), F.min("min_y").alias("min_y"), F.max("max_y").alias("max_y"))
    return found.withColumns({"center_x": (F.col("min_x") + F.col("max_x")) / 2, "center_y": (F.col("min_y") + F.col("max_y")) / 2})
