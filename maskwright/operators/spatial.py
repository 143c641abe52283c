"""Coverage rasters, connected regions, box joins and suppression; all per scope."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import box, containment, intersection, iou, overlaps
from ..schema import opaque, visibility
from ..session import cut

CELL = 32
TILE = 256


def covered_cells(elements: DataFrame, width: int, height: int) -> DataFrame:
    """scope, cx, cy that visible, non-opaque elements explain; those over 60 % of the frame explain nothing."""
    last_x, last_y = -(-width // CELL) - 1, -(-height // CELL) - 1
    shown = F.col("visible") & ~opaque(F.col("tag"), F.col("role")) & (F.col("role") != "other") & (F.col("w") * F.col("h") <= 0.6 * width * height)
    bounds = elements.filter(shown).select(
        "scope", F.greatest(F.floor(F.col("x") / CELL), F.lit(0)).alias("x0"), F.least(F.floor((F.col("x") + F.col("w")) / CELL), F.lit(last_x)).alias("x1"),
        F.greatest(F.floor(F.col("y") / CELL), F.lit(0)).alias("y0"), F.least(F.floor((F.col("y") + F.col("h")) / CELL), F.lit(last_y)).alias("y1"),
    )
    some = bounds.filter("x0 <= x1 and y0 <= y1")
    return some.select("scope", F.explode(F.sequence("x0", "x1")).alias("cx"), "y0", "y1").select("scope", "cx", F.explode(F.sequence("y0", "y1")).alias("cy")).distinct()


def cell_variance(pixels: DataFrame) -> DataFrame:
    """scope, cx, cy, variance of luma from (scope, x, y, luma), every second pixel both ways."""
    some = pixels.filter("x % 2 = 0 and y % 2 = 0").select("scope", F.floor(F.col("x") / CELL).alias("cx"), F.floor(F.col("y") / CELL).alias("cy"), F.col("luma").cast("double").alias("l"))
    return some.groupBy("scope", "cx", "cy").agg(F.when(F.count("*") > 1, F.greatest(F.lit(0.0), F.avg(F.col("l") * F.col("l")) - F.avg("l") * F.avg("l"))).otherwise(F.lit(0.0)).alias("variance"))


def candidate_cells(variances: DataFrame, covered: DataFrame, least: float = 120.0) -> DataFrame:
    return variances.filter(F.col("variance") >= least).join(covered, ["scope", "cx", "cy"], "left_anti")


def _components(cells: set[tuple[int, int]]) -> list[tuple[int, int, int, int, int]]:
    """x, y, w, h, n_cells of each 4-neighbour component of more than one cell."""
    out = []
    while cells:
        todo, seen = [cells.pop()], []
        while todo:
            x, y = todo.pop()
            seen.append((x, y))
            for near in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
                if near in cells:
                    cells.remove(near)
                    todo.append(near)
        if len(seen) > 1:
            xs, ys = [c[0] for c in seen], [c[1] for c in seen]
            out.append((min(xs) * CELL, min(ys) * CELL, (max(xs) - min(xs) + 1) * CELL, (max(ys) - min(ys) + 1) * CELL, len(seen)))
    return out


def connected_regions(cells: DataFrame) -> DataFrame:
    """scope, x, y, w, h, n_cells: boxes of 4-neighbour components of more than one cell.

    A scope's cells become one array (a frame's grid, hence small) and Python sees batches of many scopes."""
    kind = cells.schema["scope"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = [(scope, *box_) for scope, xs, ys in zip(*(c.to_pylist() for c in batch.columns)) for box_ in _components(set(zip(xs, ys)))]
            of = batch.schema.field(0).type
            columns = list(zip(*rows)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (of, *[pa.int64()] * 5))], names=["scope", "x", "y", "w", "h", "n_cells"])

    grids = cells.groupBy("scope").agg(F.collect_set(F.struct(F.col("cx").cast("long").alias("cx"), F.col("cy").cast("long").alias("cy"))).alias("c"))
    return grids.select("scope", "c.cx", "c.cy").mapInArrow(run, f"scope {kind}, x long, y long, w long, h long, n_cells long")


def largest(boxes: DataFrame, k: int = 20) -> DataFrame:
    area = F.col("w") * F.col("h")
    return boxes.withColumn("rank", F.row_number().over(Window.partitionBy("scope").orderBy(area.desc(), "x", "y"))).filter(F.col("rank") <= k)


def crops(boxes: DataFrame, k: int = 6, least: int = 24) -> DataFrame:
    """The k largest first; those too small go only then."""
    return largest(boxes, k).filter((F.col("w") >= least) & (F.col("h") >= least))


def opaque_regions(elements: DataFrame, least: int = 24) -> DataFrame:
    return elements.filter(F.col("visible") & opaque(F.col("tag"), F.col("role")) & (F.col("w") >= least) & (F.col("h") >= least)).select("scope", "id", "x", "y", "w", "h")


def tiled(boxes: DataFrame, prefix: str) -> DataFrame:
    """Boxes once for each TILE-wide square they touch: an equality key for overlap joins within large scopes."""
    x, y, w, h = box(prefix)
    span = lambda at, n: F.sequence(F.floor(at / TILE), F.floor((at + F.greatest(n, F.lit(0))) / TILE))
    return boxes.withColumn("tile_x", F.explode(span(x, w))).withColumn("tile_y", F.explode(span(y, h)))


def sighted(elements: DataFrame, width: int, height: int) -> DataFrame:
    """elements with `visible`, `offscreen` and `hit`: the element painted on top at its centre (held within the viewport), null where there is none.

    elements: scope, id, x, y, w, h, node and leave (nested sets: their place in the tree), and z where paint order is not that of the tree. An
    element is visible if what is on top is itself, stands in it or holds it. Centres meet boxes over tiles, and the topmost box is a
    maximum by paint order, so a large scope is no pair of all its elements."""
    z = F.col("z") if "z" in elements.columns else F.lit(0)
    off = visibility(F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.lit(width), F.lit(height))
    placed = elements.select("scope", "id", "node", "leave", z.alias("z"), *"xywh", off.alias("off_"))
    at = lambda low, size, most: F.least(F.greatest(F.col(low) + F.col(size) / 2, F.lit(1.0)), F.lit(float(most - 1)))
    points = placed.filter("not off_").select("scope", "id", at("x", "w", width).alias("px"), at("y", "h", height).alias("py"))
    points = points.withColumn("tile_x", F.floor(F.col("px") / TILE)).withColumn("tile_y", F.floor(F.col("py") / TILE))
    boxes = tiled(placed.filter("not off_").select("scope", "node", "leave", "z", F.col("id").alias("top"), *[F.col(c).alias(f"b_{c}") for c in "xywh"]), "b_")
    covers = (F.col("px") >= F.col("b_x")) & (F.col("px") < F.col("b_x") + F.col("b_w")) & (F.col("py") >= F.col("b_y")) & (F.col("py") < F.col("b_y") + F.col("b_h"))
    met = points.join(boxes, ["scope", "tile_x", "tile_y"]).filter(covers)
    top = met.groupBy("scope", "id").agg(F.max(F.struct("z", "node", "leave", "top")).alias("t"))
    out = elements.drop("visible", "offscreen").join(placed.select("scope", "id", "off_"), ["scope", "id"]).join(top, ["scope", "id"], "left")
    within = (F.col("t.node") <= F.col("node")) & (F.col("node") <= F.col("t.leave")) | (F.col("node") <= F.col("t.node")) & (F.col("t.node") <= F.col("leave"))
    return out.withColumns({"visible": F.coalesce(within, F.lit(False)) & ~F.col("off_"), "offscreen": F.col("off_"), "hit": F.col("t.top")}).drop("off_", "t")


def anchor(vision: DataFrame, elements: DataFrame, least_iou: float = 0.5, least_inside: float = 0.8) -> DataFrame:
    """scope, box_id, id, score: for each vision box the element of best max(IoU, containment), first of equals; over tiles, not all pairs."""
    v = tiled(vision.select("scope", "box_id", *[F.col(c).alias(f"v_{c}") for c in "xywh"]), "v_")
    e = tiled(elements.select("scope", "id", "ord", *[F.col(c).alias(f"e_{c}") for c in "xywh"]), "e_")
    met = v.join(e, ["scope", "tile_x", "tile_y"]).filter(overlaps(box("v_"), box("e_")))
    both, inside = iou(box("v_"), box("e_")), containment(box("v_"), box("e_"))
    scored = met.filter((both > least_iou) | (inside > least_inside)).select("scope", "box_id", "id", "ord", F.greatest(both, inside).alias("score")).distinct()
    first = Window.partitionBy("scope", "box_id").orderBy(F.col("score").desc(), "ord")
    return scored.withColumn("r", F.row_number().over(first)).filter("r = 1").drop("r", "ord")


def _fold(boxes: DataFrame, keys: list[str], order: list[Column], clashes, cap: int | None = None) -> DataFrame:
    """Greedy choice per group as a native fold: in order, a row stays unless it clashes with one that stays."""
    rest = [c for c in boxes.columns if c not in keys]
    lists = boxes.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.struct(*rest).alias("row")))).alias("rows"))
    rows = F.transform("rows", lambda r: r["row"])
    none = F.filter(rows, lambda r: F.lit(False))

    def step(kept: Column, r: Column) -> Column:
        refused = F.exists(kept, lambda k: clashes(r, k))
        if cap is not None:
            refused = refused | (F.size(kept) >= cap)
        return F.when(refused, kept).otherwise(F.array_append(kept, r))

    chosen = lists.select(*keys, F.explode(F.aggregate(rows, none, step)).alias("r"))
    return chosen.select(*[F.col(c) if c in keys else F.col(f"r.{c}").alias(c) for c in boxes.columns])


#: Boxes of a group that are folded as one array at most; larger groups go by rounds over pairs that meet in a tile.
FOLD_MOST = 1_000


def _rounds(boxes: DataFrame, keys: list[str], order: list[Column], clashes) -> DataFrame:
    """The same choice as `_fold` without a group ever being one array: of the rows still open, those stay that clash with no open row before
    them, and those that clash with one that stays go; repeated until none is open. Pairs meet over tiles; each round reads what the last one wrote."""
    rest = [c for c in boxes.columns if c not in keys]
    rows = cut(boxes.withColumn("row_", F.monotonically_increasing_id()).withColumn("rank_", F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], "row_")))
    side = lambda name: tiled(rows.select(*keys, F.col("row_").alias(f"{name}_row"), F.col("rank_").alias(f"{name}_rank"), *[F.col(c).alias(f"{name}_{c}") for c in rest]), f"{name}_")
    row = lambda name: {c: F.col(f"{name}_{c}") for c in rest}
    met = side("a").join(side("b"), [*keys, "tile_x", "tile_y"])
    pairs = cut(met.filter((F.col("b_rank") < F.col("a_rank")) & clashes(row("a"), row("b"))).select(F.col("a_row").alias("row_"), F.col("b_row").alias("before_")).distinct())
    still, kept = rows.select("row_"), None
    while True:
        blocked = pairs.join(still, "row_", "left_semi").join(still.withColumnRenamed("row_", "before_"), "before_", "left_semi").select("row_").distinct()
        stay = cut(still.join(blocked, "row_", "left_anti"))
        kept = stay if kept is None else kept.unionByName(stay)
        gone = pairs.join(stay.withColumnRenamed("row_", "before_"), "before_", "left_semi").select("row_").distinct()
        still = cut(still.join(stay, "row_", "left_anti").join(gone, "row_", "left_anti"))
        if still.isEmpty():
            return rows.join(kept, "row_", "left_semi").select(*boxes.columns)


def _greedy(boxes: DataFrame, keys: list[str], order: list[Column], clashes, cap: int | None = None) -> DataFrame:
    """In order, a row stays unless it clashes with one that stays, up to `cap` rows of a group: small groups as arrays, large ones by rounds."""
    large = cut(boxes.groupBy(*keys).agg(F.count("*").alias("n_")).filter(F.col("n_") > FOLD_MOST).drop("n_"))
    if large.isEmpty():
        return _fold(boxes, keys, order, clashes, cap)
    many = _rounds(boxes.join(large, keys, "left_semi").select(*boxes.columns), keys, order, clashes)
    if cap is not None:
        many = many.withColumn("r_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("r_") <= cap).drop("r_")
    return _fold(boxes.join(large, keys, "left_anti").select(*boxes.columns), keys, order, clashes, cap).unionByName(many)


def _box(r: Column) -> tuple:
    return tuple(r[c] for c in "xywh")


def nms(boxes: DataFrame, least: float = 0.7, most_iou: float = 0.4, cap: int = 24) -> DataFrame:
    """Greedy suppression per scope by score; ties by box_id."""
    some = boxes.filter(F.col("score") >= least)
    return _greedy(some, ["scope"], [-F.col("score"), F.col("box_id")], lambda a, b: iou(_box(a), _box(b)) > most_iou, cap)


def dedupe_regions(boxes: DataFrame, most: float = 0.35) -> DataFrame:
    """Of boxes of one class that share over `most` of the smaller one's area, the likelier stays."""
    area = lambda r: r["w"] * r["h"]
    return _greedy(boxes, ["scope", "cls"], [-F.col("score"), F.col("box_id")], lambda a, b: intersection(_box(a), _box(b)) > most * F.least(area(a), area(b)))


def add_unless_overlapping(regions: DataFrame, boxes: DataFrame) -> DataFrame:
    """Regions, and boxes in order of `ord` that overlap neither a region nor a box added before."""
    both = regions.select("scope", F.lit(-1).alias("ord"), *"xywh").unionByName(boxes.select("scope", "ord", *"xywh"))
    return _greedy(both, ["scope"], [F.col(c) for c in ("ord", *"xywh")], lambda a, b: (a["ord"] >= 0) & overlaps(_box(a), _box(b)))


def union_box(df: DataFrame, *keys: str) -> DataFrame:
    right, low = F.max(F.col("x") + F.col("w")), F.max(F.col("y") + F.col("h"))
    return df.groupBy(*keys).agg(F.min("x").alias("x"), F.min("y").alias("y"), (right - F.min("x")).alias("w"), (low - F.min("y")).alias("h"), F.count("*").alias("n"))


def mask_audit(pixels: DataFrame, regions: DataFrame, darkest: int = 8) -> DataFrame:
    """scope, clean: are all pixels (scope, x, y, luma) of masked regions dark?"""
    inside = (F.col("x") >= F.col("rx")) & (F.col("x") < F.col("rx") + F.col("rw")) & (F.col("y") >= F.col("ry")) & (F.col("y") < F.col("ry") + F.col("rh"))
    r = regions.select("scope", *[F.col(c).alias(f"r{c}") for c in "xywh"])
    return pixels.join(r, "scope").filter(inside).groupBy("scope").agg(F.bool_and(F.col("luma") <= darkest).alias("clean"))


def mask(pixels: DataFrame, regions: DataFrame, pad: int = 4) -> DataFrame:
    """Pixels (scope, x, y, luma) with masked regions, `pad` wider on all sides, painted black. A frame has few regions, so its boxes travel as one array."""
    boxes = regions.groupBy("scope").agg(F.collect_list(F.struct(*"xywh")).alias("boxes"))
    inside = lambda r: (F.col("x") >= r["x"] - pad) & (F.col("x") < r["x"] + r["w"] + pad) & (F.col("y") >= r["y"] - pad) & (F.col("y") < r["y"] + r["h"] + pad)
    hit = F.coalesce(F.exists("boxes", inside), F.lit(False))
    return pixels.join(boxes, "scope", "left").select("scope", "x", "y", F.when(hit, 0).otherwise(F.col("luma")).alias("luma"))


def frame_size(w: Column, h: Column, longest: int = 768) -> tuple[Column, Column]:
    """Width and height of a frame once its longest edge has `longest` pixels at most."""
    down = F.least(F.lit(1.0), F.lit(float(longest)) / F.greatest(w, h))
    return tuple(F.greatest(F.lit(1), F.floor(x * down + 0.5).cast("int")) for x in (w, h))


def preprocessed(pixels: DataFrame, width: int, height: int, columns: int = 320, rows: int = 240) -> DataFrame:
    """scope, ox, oy, v: a frame's pixels (scope, x, y, luma) sampled by nearest neighbour on the model's grid, (luma - 127) / 128.

    Every source pixel makes the grid points that sample it, so there is no join."""
    def sampled(x: Column, source: int, target: int) -> Column:
        points = F.sequence(F.lit(0), F.lit(target - 1))
        return F.filter(points, lambda o: F.least(F.lit(source - 1), F.floor(o * F.lit(source) / F.lit(target)).cast("int")) == x)

    out = pixels.select("scope", "y", "luma", F.explode(sampled(F.col("x"), width, columns)).alias("ox"))
    out = out.select("scope", "ox", "luma", F.explode(sampled(F.col("y"), height, rows)).alias("oy"))
    return out.select("scope", "ox", "oy", ((F.col("luma") - 127) / F.lit(128.0)).alias("v"))


def scaled(x: Column, frame: int, css: int) -> Column:
    return x.cast("double") * css / frame


# Classifier labels and the class each stands for.
VISION_LABELS = (
    ("envelope", "document"),
    ("web site, website, internet site, site", "screenshot"),
    ("comic book", "document"),
    ("menu", "document"),
    ("crossword puzzle, crossword", "document"),
    ("book jacket, dust cover, dust jacket, dust wrapper", "document"),
    ("monitor", "screenshot"),
    ("screen, crt screen", "screenshot"),
    ("monitor, display", "screenshot"),
    ("television, television system", "screenshot"),
    ("ballpoint, ballpoint pen, ballpen, biro", "signature"),
)


def classify(labels: DataFrame, top: int = 3, least: float = 0.1, calibration: float = 0.5) -> DataFrame:
    """scope, box_id, cls, score: best mapped of a box's top labels (scope, box_id, label, score), calibrated."""
    table = F.create_map(*[F.lit(v) for row in VISION_LABELS for v in row])
    rank = F.row_number().over(Window.partitionBy("scope", "box_id").orderBy(F.col("score").desc(), "label"))
    some = labels.withColumn("r", rank).filter(F.col("r") <= top).withColumn("cls", F.try_element_at(table, F.lower("label"))).filter(F.col("cls").isNotNull() & (F.col("score") > least))
    return some.groupBy("scope", "box_id").agg(F.max_by("cls", "score").alias("cls"), (F.max("score") * calibration).alias("score"))
