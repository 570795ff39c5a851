"""Exact density clustering (DBSCAN) on a grid.

Cells are a little smaller than ``eps / sqrt(2)``, so two points of one cell are always
neighbours. Dense cells therefore need no pair work at all; what remains is settled between
bounding boxes where possible and between points only where boxes cannot tell:

* a box entirely inside the radius counts as a whole, one entirely outside not at all;
* two cells are linked as soon as one box pair is certain, and boxes are only split further
  while the point work left over is too large.

Equal coordinates are one weighted spot throughout. Nothing here depends on the number of
points in a cell fitting into a task, and no pairs inside a cell are ever formed.
"""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadfuse.operators.components import connected_components
from roadfuse.session import cut_lineage

_ROW = 1 << 32
_SPLIT = 4  # boxes per axis on every further level

# Point comparisons allowed per box pair, and in total per core spot, before boxes are split.
PAIR_WORK = 1_000_000
TOTAL_WORK = 64


def _offsets(half: bool = False, own: bool = False) -> list[int]:
    every = [dx * _ROW + dy for dx in range(-2, 3) for dy in range(-2, 3)]
    return [o for o in every if (o > 0 if half else (o != 0 or own))]


def _neighbour_cells(cell: str, offsets: list[int]) -> Column:
    return F.explode(F.transform(F.array(*[F.lit(o).cast("long") for o in offsets]), lambda o: F.col(cell) + o))


def _index(c: str, side: float, level: int) -> Column:
    return F.floor(F.col(c) / (side / _SPLIT**level))


def _box(extra: list[Column] | None = None) -> list[Column]:
    return [
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"),
        F.count("*").alias("n"), *(extra or []),
    ]


def _gap(lo1: Column, hi1: Column, lo2: Column, hi2: Column) -> Column:
    return F.greatest(lo1 - hi2, lo2 - hi1, F.lit(0.0))


def _spread(lo1: Column, hi1: Column, lo2: Column, hi2: Column) -> Column:
    return F.greatest(F.abs(hi2 - lo1), F.abs(hi1 - lo2))


def _square_sum(a: Column, b: Column) -> Column:
    return a * a + b * b


def _point_box(kind) -> Column:
    """Squared nearest or farthest distance from the spot (x, y) to the box."""
    x, y = F.col("x"), F.col("y")
    return _square_sum(kind(x, x, F.col("x0"), F.col("x1")), kind(y, y, F.col("y0"), F.col("y1")))


def _box_box(kind) -> Column:
    """Squared nearest or farthest distance between the boxes of side a and side b."""
    c = F.col
    return _square_sum(
        kind(c("a_x0"), c("a_x1"), c("b_x0"), c("b_x1")), kind(c("a_y0"), c("a_y1"), c("b_y0"), c("b_y1"))
    )


def _prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(prefix + c) for c in df.columns])


def weighted_spots(points: DataFrame, side: float) -> DataFrame:
    """Distinct coordinates with their weight, smallest id and grid cell."""
    cell = F.floor(F.col("x") / side) * _ROW + (F.floor(F.col("y") / side) + (_ROW >> 1))
    return points.groupBy("x", "y").agg(
        F.count("*").alias("w"), F.min("client_id").alias("rep")
    ).withColumn("cell", cell)


def _mark_core(spots: DataFrame, side: float, eps2: float, min_points: int) -> DataFrame:
    """Adds ``is_core``. Only spots of sparse cells look at their neighbours."""
    tagged = spots.join(spots.groupBy("cell").agg(F.sum("w").alias("cw")), "cell")
    boxes = spots.groupBy(
        F.col("cell").alias("near"), _index("x", side, 1).alias("bx"), _index("y", side, 1).alias("by")
    ).agg(*_box([F.sum("w").alias("bw")]))
    around = (
        tagged.filter(F.col("cw") < min_points)
        .select("x", "y", "cw", _neighbour_cells("cell", _offsets()).alias("near"))
        .join(boxes, "near")
        .filter(_point_box(_gap) <= eps2)
        .withColumn("whole", _point_box(_spread) <= eps2)
        .persist(StorageLevel.MEMORY_AND_DISK)
    )
    certain = around.groupBy("x", "y").agg(
        (F.first("cw") + F.sum(F.when(F.col("whole"), F.col("bw")).otherwise(0))).alias("sure")
    )
    open_spots = certain.filter(F.col("sure") < min_points).select("x", "y", "sure")
    inner = spots.select(
        F.col("cell").alias("near"), _index("x", side, 1).alias("bx"), _index("y", side, 1).alias("by"),
        F.col("x").alias("px"), F.col("y").alias("py"), F.col("w").alias("pw"),
    )
    dx, dy = F.col("x") - F.col("px"), F.col("y") - F.col("py")
    counted = (
        around.filter(~F.col("whole"))
        .join(open_spots, ["x", "y"])
        .select("x", "y", "sure", "near", "bx", "by")
        .join(inner, ["near", "bx", "by"])
        .filter(_square_sum(dx, dy) <= eps2)
        .groupBy("x", "y")
        .agg((F.first("sure") + F.sum("pw")).alias("total"))
    )
    won = certain.filter(F.col("sure") >= min_points).select("x", "y").union(
        counted.filter(F.col("total") >= min_points).select("x", "y")
    ).withColumn("won", F.lit(True))
    marked = tagged.join(won, ["x", "y"], "left").select(
        "x", "y", "rep", "cell", ((F.col("cw") >= min_points) | F.col("won").isNotNull()).alias("is_core")
    )
    marked = cut_lineage(marked)
    around.unpersist()
    return marked


def _linked_cells(core: DataFrame, side: float, eps2: float, cells: DataFrame) -> DataFrame:
    """Pairs (a, b) of neighbouring cells that hold core points within the radius."""
    boxes = cells.select("cell", "x0", "x1", "y0", "y1", "n")
    pairs = (
        _prefixed(boxes, "a_")
        .withColumn("b_cell", _neighbour_cells("a_cell", _offsets(half=True)))
        .join(_prefixed(boxes, "b_"), "b_cell")
        .filter(_box_box(_gap) <= eps2)
        .withColumn("sure", _box_box(_spread) <= eps2)
    )
    ids = ["a_cell", "b_cell"]
    level = 0
    keys: list[str] = []
    links = None
    while True:
        pairs = cut_lineage(pairs)
        found = pairs.filter("sure").select(*ids).distinct()
        links = found if links is None else links.union(found)
        rest = pairs.filter("not sure")
        if level:
            rest = rest.join(found, ids, "left_anti")
        work = F.col("a_n").cast("double") * F.col("b_n")
        r = rest.agg(F.count("*").alias("n"), F.sum(work).alias("total"), F.max(work).alias("worst")).first()
        if not r.n:
            return links.distinct()
        small = r.worst <= PAIR_WORK and r.total <= PAIR_WORK
        if not small and r.worst <= PAIR_WORK:
            small = r.total <= TOTAL_WORK * core.count()
        if small:
            spots = core.select("cell", "x", "y", *[_index(k, side, level).alias("i" + k) for k in keys])
            on_a = _prefixed(spots, "a_")
            on_b = _prefixed(spots, "b_")
            side_keys = {p: [f"{p}_cell", *[f"{p}_i{k}" for k in keys]] for p in "ab"}
            dx, dy = F.col("a_x") - F.col("b_x"), F.col("a_y") - F.col("b_y")
            near = (
                rest.select(*side_keys["a"], *side_keys["b"])
                .join(on_a, side_keys["a"])
                .join(on_b, side_keys["b"])
                .filter(_square_sum(dx, dy) <= eps2)
                .select(*ids)
            )
            return links.union(near).distinct()
        # Split the boxes of the open pairs and compare their parts.
        children = core.groupBy(
            "cell",
            *[_index(k, side, level).alias("i" + k) for k in keys],
            *[_index(k, side, level + 1).alias("j" + k) for k in ("x", "y")],
        ).agg(*_box())
        parent = {p: [f"{p}_cell", *[f"{p}_i{k}" for k in keys]] for p in "ab"}
        pairs = (
            rest.select(*parent["a"], *parent["b"])
            .join(_prefixed(children, "a_"), parent["a"])
            .join(_prefixed(children, "b_"), parent["b"])
            .filter(_box_box(_gap) <= eps2)
            .select(
                *ids,
                *[F.col(f"{p}_j{k}").alias(f"{p}_i{k}") for p in "ab" for k in ("x", "y")],
                "a_n",
                "b_n",
                (_box_box(_spread) <= eps2).alias("sure"),
            )
        )
        keys = ["x", "y"]
        level += 1


def _border_spots(marked: DataFrame, core: DataFrame, cell_component: DataFrame, side: float, eps2: float) -> DataFrame:
    """Non-core spots within reach -> component of their nearest core spot.

    Equal distances go to the component whose smallest core id is smaller.
    """
    index = [_index("x", side, 1).alias("bx"), _index("y", side, 1).alias("by")]
    boxes = core.groupBy(F.col("cell").alias("near"), *index).agg(*_box())
    around = (
        marked.filter("not is_core")
        .select("x", "y", "rep", _neighbour_cells("cell", _offsets(own=True)).alias("near"))
        .join(boxes, "near")
        .withColumn("gap", _point_box(_gap))
        .filter(F.col("gap") <= eps2)
        .withColumn("far", _point_box(_spread))
    )
    # Boxes farther away than some box's far corner cannot hold the nearest core.
    reach = F.min("far").over(Window.partitionBy("x", "y"))
    useful = around.withColumn("reach", reach).filter("gap <= reach").select("x", "y", "rep", "near", "bx", "by")
    inner = core.select(
        F.col("cell").alias("near"), *index, F.col("x").alias("px"), F.col("y").alias("py")
    )
    dx, dy = F.col("x") - F.col("px"), F.col("y") - F.col("py")
    nearest = Window.partitionBy("x", "y").orderBy("d2", "lead")
    return (
        useful.join(inner, ["near", "bx", "by"])
        .withColumn("d2", _square_sum(dx, dy))
        .filter(F.col("d2") <= eps2)
        .groupBy("x", "y", "rep", "near")
        .agg(F.min("d2").alias("d2"))
        .join(cell_component.withColumnRenamed("cell", "near"), "near")
        .withColumn("rank", F.row_number().over(nearest))
        .filter("rank = 1")
        .select("x", "y", "rep", "component")
    )


def dbscan(points: DataFrame, eps: float, min_points: int) -> DataFrame:
    """Adds ``label`` to the clustered points (``client_id, x, y, ...``); noise is left out.

    ``min_points`` counts the point itself and the radius is inclusive. The label is the
    smallest ``client_id`` of the cluster.
    """
    side = eps / math.sqrt(2.0) * (1.0 - 1e-6)
    eps2 = eps * eps
    spots = cut_lineage(weighted_spots(points, side))
    marked = _mark_core(spots, side, eps2, min_points)
    core = marked.filter("is_core").select("x", "y", "rep", "cell")
    cells = core.groupBy("cell").agg(*_box([F.min("rep").alias("rep")]))
    links = _linked_cells(core, side, eps2, cells)
    component = connected_components(links, "a_cell", "b_cell")
    grouped = cells.join(component, cells.cell == component.node, "left").select(
        "cell", "rep", F.coalesce("component", "cell").alias("component")
    )
    leads = grouped.groupBy("component").agg(F.min("rep").alias("lead"))
    cell_component = grouped.join(leads, "component").select("cell", "component", "lead")
    border = _border_spots(marked, core, cell_component, side, eps2)
    assigned = (
        core.join(cell_component.select("cell", "component"), "cell")
        .select("x", "y", "rep", "component")
        .unionByName(border)
    )
    assigned = cut_lineage(assigned)
    labels = assigned.groupBy("component").agg(F.min("rep").alias("label"))
    named = assigned.join(labels, "component").select("x", "y", "label")
    return points.join(named, ["x", "y"])
