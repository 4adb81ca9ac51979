"""Points near other points, or inside boxes, by a partitioned spatial join.

1. A bounded sample of both sides (``sample_rows``) gives the leaves of a
   quadtree, so dense areas get small cells. Cells at the rim reach outwards
   without end: every place lies in exactly one leaf, sampled or not.
2. Every object is a box: for a distance join, half the distance around the
   point; for containment, the box itself or the bare point. Objects go to all
   leaves that their box touches (boundary replication).
3. Leaves that hold more than ``most_rows`` objects are split again, by their
   counts, and their objects sent to the new leaves, until none is crowded. Only
   where cells would become smaller than twice the boxes (objects at one place,
   all of them near each other) a leaf is dealt into blocks by hash that meet
   pairwise, so no task holds more than two blocks.
4. In each leaf an R-tree is bulk-loaded (sort-tile-recursive) over the right
   side and probed with the boxes of the left side.
5. Candidates are refined with the exact geometry, and a pair is given only by
   the leaf that holds its reference point (the lower corner of the boxes'
   intersection), so no pair comes out twice.

Defined results: objects lacking a coordinate (null or NaN), or outside ±90
degrees of latitude and ±180 of longitude, do not take part; distances are
great-circle (haversine) with equality included; boxes include their rim; the
180th meridian is crossed (objects near it appear on both sides). Rows that
repeat the same id and place give each pair once; an id stored with several
places is near whatever one of them is near, and gives each pair once too, but
for ``unique=False``, which leaves that to the caller. Empty sides give an empty
result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railspoke.operators.lineage import written

EARTH_RADIUS_M = 6_371_000.0
SAMPLE_ROWS = 100_000
#: Sampled points above which a cell is split.
CELL_SAMPLE = 500
MAX_DEPTH = 26
#: Objects of one side that one task joins at most.
MOST_ROWS = 40_000


class Quadtree:
    """Cells split at their middle. Node arrays: middle (x, y) and first child, -1 for a leaf."""

    def __init__(self, x: np.ndarray, y: np.ndarray, cell: int = CELL_SAMPLE, depth: int = MAX_DEPTH) -> None:
        self.cx, self.cy, self.child, self.bounds = [0.0], [0.0], [-1], [(-np.inf, np.inf, -np.inf, np.inf)]
        if len(x):
            box = (x.min(), x.max(), y.min(), y.max())
            stack = [(0, np.arange(len(x)), box, 0)]
            while stack:
                node, rows, (x0, x1, y0, y1), d = stack.pop()
                if len(rows) <= cell or d >= depth or not (x1 > x0 or y1 > y0):
                    continue
                mx, my = (x0 + x1) / 2, (y0 + y1) / 2
                first = len(self.child)
                self.cx[node], self.cy[node], self.child[node] = mx, my, first
                b0, b1, b2, b3 = self.bounds[node]
                east, north = x[rows] >= mx, y[rows] >= my
                for q in range(4):
                    e, n = bool(q & 1), bool(q & 2)
                    self.cx.append(0.0)
                    self.cy.append(0.0)
                    self.child.append(-1)
                    self.bounds.append((mx if e else b0, b1 if e else mx, my if n else b2, b3 if n else my))
                    inner = (mx if e else x0, x1 if e else mx, my if n else y0, y1 if n else my)
                    stack.append((first + q, rows[(east == e) & (north == n)], inner, d + 1))
        self.freeze()

    def freeze(self) -> None:
        self.cx, self.cy = np.array(self.cx), np.array(self.cy)
        self.child, self.bounds = np.array(self.child), np.array(self.bounds)

    def split(self, leaves: dict[int, tuple[int, tuple[float, float, float, float]]]) -> Quadtree:
        """The tree with each leaf split into 4 ** levels cells over its extent; leaf: (levels, extent)."""
        out = Quadtree(np.empty(0), np.empty(0))
        out.cx, out.cy, out.child, out.bounds = (list(v) for v in (self.cx, self.cy, self.child, self.bounds))
        out.bounds = [tuple(b) for b in out.bounds]
        stack = [(leaf, levels, extent) for leaf, (levels, extent) in leaves.items()]
        while stack:
            node, levels, (x0, x1, y0, y1) = stack.pop()
            mx, my = (x0 + x1) / 2, (y0 + y1) / 2
            first = len(out.child)
            out.cx[node], out.cy[node], out.child[node] = mx, my, first
            b0, b1, b2, b3 = out.bounds[node]
            for q in range(4):
                e, n = bool(q & 1), bool(q & 2)
                out.cx.append(0.0)
                out.cy.append(0.0)
                out.child.append(-1)
                out.bounds.append((mx if e else b0, b1 if e else mx, my if n else b2, b3 if n else my))
                if levels > 1:
                    stack.append((first + q, levels - 1, (mx if e else x0, x1 if e else mx, my if n else y0, y1 if n else my)))
        out.freeze()
        return out

    def touched(
        self, x0: np.ndarray, x1: np.ndarray, y0: np.ndarray, y1: np.ndarray, start: np.ndarray | None = None
    ) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of every leaf that each box touches, below the node ``start`` of each box."""
        rows, nodes = np.arange(len(x0)), np.zeros(len(x0), dtype="int64") if start is None else start.astype("int64")
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(rows):
            first = self.child[nodes]
            leaf = first < 0
            done.append((rows[leaf], nodes[leaf]))
            rows, nodes, first = rows[~leaf], nodes[~leaf], first[~leaf]
            cx, cy = self.cx[nodes], self.cy[nodes]
            west, east = x0[rows] < cx, x1[rows] >= cx
            south, north = y0[rows] < cy, y1[rows] >= cy
            parts = [(west & south, 0), (east & south, 1), (west & north, 2), (east & north, 3)]
            rows, nodes = (
                np.concatenate([rows[m] for m, _ in parts]),
                np.concatenate([first[m] + q for m, q in parts]),
            )
        return np.concatenate([r for r, _ in done]), np.concatenate([n for _, n in done])


class RTree:
    """Bulk-loaded by sort-tile-recursive; boxes of each level lie in one array, bottom level first."""

    FANOUT = 16

    def __init__(self, boxes: np.ndarray) -> None:
        """boxes: columns x0, x1, y0, y1."""
        f, n = self.FANOUT, len(boxes)
        slices = max(1, int(np.ceil(np.sqrt(np.ceil(n / f)))))
        by_x = np.argsort(boxes[:, 0] + boxes[:, 1], kind="stable")
        strip = np.arange(n) // max(1, -(-n // slices))
        middle_y = (boxes[:, 2] + boxes[:, 3])[by_x]
        self.order = by_x[np.lexsort((middle_y, strip))]
        level = boxes[self.order]
        self.levels = [level]
        while len(level) > 1:
            at = np.arange(0, len(level), f)
            level = np.column_stack(
                [
                    np.minimum.reduceat(level[:, 0], at),
                    np.maximum.reduceat(level[:, 1], at),
                    np.minimum.reduceat(level[:, 2], at),
                    np.maximum.reduceat(level[:, 3], at),
                ]
            )
            self.levels.append(level)

    def probe(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, entry) of every entry box that each query box touches."""
        f = self.FANOUT
        rows, nodes = np.arange(len(q)), np.zeros(len(q), dtype="int64")
        for depth in range(len(self.levels) - 1, -1, -1):
            b, w = self.levels[depth][nodes], q[rows]
            hit = (b[:, 0] <= w[:, 1]) & (b[:, 1] >= w[:, 0]) & (b[:, 2] <= w[:, 3]) & (b[:, 3] >= w[:, 2])
            rows, nodes = rows[hit], nodes[hit]
            if depth:
                below = len(self.levels[depth - 1])
                children = nodes[:, None] * f + np.arange(f)[None, :]
                ok = children < below
                rows, nodes = np.repeat(rows, f).reshape(-1, f)[ok], children[ok]
        return rows, self.order[nodes]


def great_circle_m(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray) -> np.ndarray:
    a, b = np.radians(lat1), np.radians(lat2)
    h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_RADIUS_M * np.arcsin(np.sqrt(np.minimum(1.0, h)))


def _boxes(lat: np.ndarray, lon: np.ndarray, radius_m: np.ndarray) -> tuple[np.ndarray, ...]:
    """Boxes that hold every point within the radius; a hair too large."""
    grow = 1.0 + 1e-6
    dy = np.degrees(radius_m / EARTH_RADIUS_M) * grow + 1e-9
    high = np.minimum(90.0, np.abs(lat) + 2 * dy)
    with np.errstate(divide="ignore", invalid="ignore"):
        turn = radius_m / EARTH_RADIUS_M
        s = np.sin(turn) / np.cos(np.radians(high))
        dx = np.where((high >= 90.0) | (s >= 1.0) | (turn >= np.pi / 2), 360.0, np.degrees(np.arcsin(np.clip(s, 0, 1))) * grow + 1e-9)
    return lon - dx, lon + dx, lat - dy, lat + dy


_NAMES = ["leaf", "side", "id", "x0", "x1", "y0", "y1", "x", "y"]
_ASSIGNED = "leaf long, side int, id {kind}, x0 double, x1 double, y0 double, y1 double, x double, y double"


def _sent(batch: pa.RecordBatch, at: np.ndarray, leaf: np.ndarray, box: list[np.ndarray], xy: list[np.ndarray]) -> pa.RecordBatch:
    src = pa.array(at)
    columns = [pa.array(leaf), batch.column("side").take(src), batch.column("id").take(src), *map(pa.array, box), *map(pa.array, xy)]
    return pa.RecordBatch.from_arrays(columns, names=_NAMES)


def _assign(tree: Quadtree, radii: tuple[float, float] | None):
    """Leaves of each box; boxes over the 180th meridian also appear shifted by a turn.

    With ``radii``, of both sides, the objects are points (x, y), whose boxes are made here.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("x", "y"))
            if radii is None:
                bx0, bx1, by0, by1 = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("x0", "x1", "y0", "y1"))
            else:
                side = batch.column("side").to_numpy(zero_copy_only=False)
                bx0, bx1, by0, by1 = _boxes(y, x, np.where(side == 0, radii[0], radii[1]))
            at, shift = [np.arange(batch.num_rows)], [np.zeros(batch.num_rows)]
            for over, turn in ((bx1 > 180.0, -360.0), (bx0 < -180.0, 360.0)):
                rows = np.flatnonzero(over)
                at.append(rows)
                shift.append(np.full(len(rows), turn))
            at, shift = np.concatenate(at), np.concatenate(shift)
            x0, x1, y0, y1 = bx0[at] + shift, bx1[at] + shift, by0[at], by1[at]
            rows, leaf = tree.touched(x0, x1, y0, y1)
            at = at[rows]
            yield _sent(batch, at, leaf, [x0[rows], x1[rows], y0[rows], y1[rows]], [x[at], y[at]])

    return run


def _resend(tree: Quadtree):
    """Objects of leaves that were split, sent to the new leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            c = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in _NAMES if n not in ("side", "id")}
            rows, leaf = tree.touched(c["x0"], c["x1"], c["y0"], c["y1"], c["leaf"])
            yield _sent(batch, rows, leaf, [c[n][rows] for n in ("x0", "x1", "y0", "y1")], [c[n][rows] for n in ("x", "y")])

    return run


def _firsts(code: np.ndarray, boxes: np.ndarray, xy: np.ndarray) -> np.ndarray:
    """One row of each object and place: repeated deliveries need one copy."""
    _, at, back, n = np.unique(code, return_index=True, return_inverse=True, return_counts=True)
    more = np.flatnonzero(n[back] > 1)
    if not len(more):
        return at
    whole = np.column_stack([code[more], boxes[more], xy[more]])
    _, kept = np.unique(whole, axis=0, return_index=True)
    return np.concatenate([np.flatnonzero(n[back] == 1), more[kept]])


def _join_leaf(tree: Quadtree, refine: Callable | None):
    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        side = table.column("side").to_numpy()
        ids = pa.concat_arrays(table.column("id").chunks)
        boxes = np.column_stack([table.column(n).to_numpy() for n in ("x0", "x1", "y0", "y1")])
        xy = np.column_stack([table.column("x").to_numpy(), table.column("y").to_numpy()])
        first = _firsts(2 * ids.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype("int64") + side, boxes, xy)
        left, right = first[side[first] == 0], first[side[first] == 1]
        if not len(left) or not len(right):
            return
        index = RTree(boxes[right])
        x_low, x_high, y_low, y_high = tree.bounds[key[0].as_py()]
        step = max(64, 4_000_000 // len(right))
        for begin in range(0, len(left), step):
            part = left[begin : begin + step]
            q, e = index.probe(boxes[part])
            a, b = part[q], right[e]
            rx, ry = np.maximum(boxes[a, 0], boxes[b, 0]), np.maximum(boxes[a, 2], boxes[b, 2])
            here = (rx >= x_low) & (rx < x_high) & (ry >= y_low) & (ry < y_high)
            a, b = a[here], b[here]
            if refine is not None:
                ok = refine(xy[a], xy[b])
                a, b = a[ok], b[ok]
            if len(a):
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(a)), ids.take(pa.array(b))], names=["left_id", "right_id"]
                )

    return run


def _counts(assigned: DataFrame) -> DataFrame:
    """Per leaf: objects of each side, the extent of their boxes' lower corners and the widths of the boxes."""
    one = lambda side: F.count_if(F.col("side") == side).alias(f"n{side}")
    return assigned.groupBy("leaf").agg(
        one(0), one(1), *[f(c).alias(f"{f.__name__}_{c}") for c in ("x0", "y0") for f in (F.min, F.max)],
        F.avg(F.col("x1") - F.col("x0")).alias("w"), F.avg(F.col("y1") - F.col("y0")).alias("h"),
    )


def box_join(
    objects: DataFrame,
    refine: Callable | None = None,
    radii: tuple[float, float] | None = None,
    sample_rows: int = SAMPLE_ROWS,
    most_rows: int = MOST_ROWS,
    unique: bool = True,
) -> DataFrame:
    """(left_id, right_id) of objects (side 0 or 1, id, x, y and, without ``radii``, x0, x1, y0, y1) whose boxes touch.

    ``refine`` gets the (x, y) of both ends of the candidates and keeps a subset.
    """
    kind = dict(objects.dtypes)["id"]
    share = min(1.0, sample_rows / max(1, objects.count()))
    drawn = objects.select("x", "y") if share == 1.0 else objects.select("x", "y").sample(False, share, 7).limit(2 * sample_rows)
    drawn = drawn.toPandas()
    tree = Quadtree(drawn["x"].to_numpy("float64"), drawn["y"].to_numpy("float64"))
    schema = _ASSIGNED.format(kind=kind)
    assigned = written(objects.mapInArrow(_assign(tree, radii), schema), "leaves")
    parts, crowded = [], {}
    while True:
        # one row per crowded leaf: fewer than assigned rows / most_rows
        full = _counts(assigned).where(F.col("n0") + F.col("n1") > most_rows).collect()
        cut = {}
        for r in full:
            if not r["n0"] or not r["n1"]:
                # nothing to meet
                crowded[r["leaf"]] = (0, 0)
                continue
            wide, high = r["max_x0"] - r["min_x0"], r["max_y0"] - r["min_y0"]
            levels = 1 + int(np.log((r["n0"] + r["n1"]) / most_rows) / np.log(4.0))
            # cells no smaller than twice the boxes: else each box goes to all of them
            room = max(wide / max(r["w"], 1e-12), high / max(r["h"], 1e-12)) / 2
            levels = min(levels, int(np.log2(room)) if room >= 1 else 0)
            if levels > 0 and (wide > 0 or high > 0):
                cut[r["leaf"]] = (levels, (r["min_x0"], r["max_x0"] + r["w"], r["min_y0"], r["max_y0"] + r["h"]))
            else:
                crowded[r["leaf"]] = (-(-r["n0"] // most_rows), -(-r["n1"] // most_rows))
        if not cut:
            break
        spark = objects.sparkSession
        split = spark.createDataFrame([(leaf,) for leaf in cut], "leaf long")
        parts.append(assigned.join(split, "leaf", "left_anti"))
        tree = tree.split(cut)
        assigned = written(assigned.join(split, "leaf", "left_semi").select(*_NAMES).mapInArrow(_resend(tree), schema), "leaves")
    for p in parts:
        assigned = assigned.unionByName(p)
    zero = F.lit(0).cast("int")
    if crowded:
        spark = objects.sparkSession
        blocks = spark.createDataFrame([(leaf, *n) for leaf, n in crowded.items()], "leaf long, n0 int, n1 int")
        rows = assigned.join(blocks, "leaf", "left").where("n0 is null or n0 > 0")
        mine = F.coalesce(F.when(F.col("side") == 0, F.col("n0")).otherwise(F.col("n1")), F.lit(1))
        theirs = F.coalesce(F.when(F.col("side") == 0, F.col("n1")).otherwise(F.col("n0")), F.lit(1))
        rows = rows.withColumn("_own", F.pmod(F.xxhash64("id"), mine).cast("int")).withColumn(
            "_other", F.explode(F.sequence(F.lit(0), theirs - 1))
        )
        b0 = F.when(F.col("side") == 0, F.col("_own")).otherwise(F.col("_other")).alias("b0")
        b1 = F.when(F.col("side") == 0, F.col("_other")).otherwise(F.col("_own")).alias("b1")
    else:
        rows, b0, b1 = assigned, zero.alias("b0"), zero.alias("b1")
    groups = rows.select(*_NAMES, b0, b1).groupBy("leaf", "b0", "b1")
    pairs = groups.applyInArrow(_join_leaf(tree, refine), f"left_id {kind}, right_id {kind}")
    # an id may be stored with several places, and a box may be shifted by a turn
    return pairs.dropDuplicates(["left_id", "right_id"]) if unique else pairs


def _on_earth(lat: str, lon: str):
    return (
        F.col(lat).isNotNull()
        & F.col(lon).isNotNull()
        & ~F.isnan(lat)
        & ~F.isnan(lon)
        & F.col(lat).between(-90, 90)
        & F.col(lon).between(-180, 180)
    )


def points_within(
    left: DataFrame, right: DataFrame, radius_m: float, key: str = "osmid", unique: bool = True, one_sided: bool = False, **limits: int
) -> DataFrame:
    """(left_id, right_id) of points (key, lat, lon) at most ``radius_m`` apart.

    ``one_sided``: only the left points are grown to boxes, by the whole distance, so that the right ones go to one
    leaf each; for few points on the left.
    """
    kind = dict(left.dtypes)[key]
    both = None
    for side, rows in enumerate((left, right)):
        one = rows.where(F.col(key).isNotNull() & _on_earth("lat", "lon")).select(
            F.lit(side).alias("side"),
            F.col(key).cast(kind).alias("id"),
            F.col("lon").cast("double").alias("x"),
            F.col("lat").cast("double").alias("y"),
        )
        both = one if both is None else both.unionByName(one)

    def refine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return great_circle_m(a[:, 1], a[:, 0], b[:, 1], b[:, 0]) <= radius_m

    radii = (radius_m, 0.0) if one_sided else (radius_m / 2, radius_m / 2)
    return box_join(both, refine, radii, unique=unique, **limits)


def boxes_around(
    points: DataFrame, boxes: DataFrame, key: str = "osmid", box_key: str = "region_key", **limits: int
) -> DataFrame:
    """(key, box_key) of every point (key, lat, lon) and every box (box_key, west, south, east, north) around it.

    Points in no box, or without a place, come out once with a null box.
    """
    kind = dict(points.dtypes)[key]
    whole = points.where(F.col(key).isNotNull())
    a = whole.where(_on_earth("lat", "lon")).select(
        F.lit(0).alias("side"),
        F.col(key).cast("string").alias("id"),
        *[F.col("lon").alias(n) for n in ("x0", "x1")],
        *[F.col("lat").alias(n) for n in ("y0", "y1")],
        F.col("lon").alias("x"),
        F.col("lat").alias("y"),
    )
    b = boxes.where(F.col(box_key).isNotNull() & (F.col("west") <= F.col("east"))).select(
        F.lit(1).alias("side"),
        F.col(box_key).cast("string").alias("id"),
        F.col("west").alias("x0"),
        F.col("east").alias("x1"),
        F.col("south").alias("y0"),
        F.col("north").alias("y1"),
        F.col("west").alias("x"),
        F.col("south").alias("y"),
    )
    pairs = box_join(a.unionByName(b), None, unique=False, **limits)
    found = pairs.select(F.col("left_id").cast(kind).alias(key), F.col("right_id").alias(box_key)).distinct()
    return whole.select(key).distinct().join(found, key, "left")
