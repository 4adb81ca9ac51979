"""The tiled store: nodes and edges partitioned by half-degree tiles, meta.json last as the commit mark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from railspoke.functions import columns as C
from railspoke.functions import constants as K
from railspoke.operators.lineage import shuffles_dropped

NODE_COLUMNS = ["osmid", "lat", "lon", "elevation_m", "node_type", "station_name"]
EDGE_COLUMNS = [
    "from_node",
    "to_node",
    "key",
    "length_m",
    "height_diff_m",
    "surface",
    "highway",
    "mode",
    "geometry_wkt",
]
_TILE = ["tile_row", "tile_col"]


def with_tile(rows: DataFrame, size: float = K.TILE_DEG) -> DataFrame:
    return rows.withColumn("tile_row", C.tile(F.col("lat"), size)).withColumn("tile_col", C.tile(F.col("lon"), size))


def from_tile(size: float = K.TILE_DEG) -> list[Column]:
    """The tile of an edge's start, over what ``graph.with_ends`` adds."""
    return [C.tile(F.col("from_lat"), size).alias("tile_row"), C.tile(F.col("from_lon"), size).alias("tile_col")]


def edges_with_tile(edges: DataFrame, nodes: DataFrame, size: float = K.TILE_DEG) -> DataFrame:
    """Edges lie in the tile of the node they start from; those that have their tile keep it."""
    if set(_TILE) <= set(edges.columns):
        return edges
    at = with_tile(nodes, size).select(F.col("osmid").alias("from_node"), *_TILE)
    return edges.join(at, "from_node")


def meta(nodes: DataFrame, edges: DataFrame, size: float = K.TILE_DEG, tolerance_m: float = K.MERGE_TOLERANCE_M) -> DataFrame:
    """One row: bounding box, tile size, tolerance and counts; n_stations counts all rail nodes."""
    boxed = nodes.agg(
        F.min("lon").alias("west"),
        F.min("lat").alias("south"),
        F.max("lon").alias("east"),
        F.max("lat").alias("north"),
        F.count(F.lit(1)).alias("n_nodes"),
        F.count_if(F.col("node_type") == "rail").alias("n_stations"),
    )
    counted = edges.agg(F.count(F.lit(1)).alias("n_edges"))
    # one row each
    return boxed.crossJoin(F.broadcast(counted)).select(
        F.array("west", "south", "east", "north").alias("bbox"),
        F.lit(size).alias("tile_deg"),
        F.lit(tolerance_m).alias("tolerance_m"),
        "n_nodes",
        "n_edges",
        "n_stations",
    )


#: Rows of a tile that one task writes, about.
TILE_ROWS = 500_000


def write_store(
    nodes: DataFrame,
    edges: DataFrame,
    path: str,
    size: float = K.TILE_DEG,
    codec: str = "zstd",
    extra: tuple[list[str], list[str]] = ([], []),
) -> None:
    """Columns are fixed and in order, then those of ``extra`` (nodes, edges); meta.json is written last.

    The rows of a tile are spread by node over as many tasks as their number needs.
    """
    node_columns, edge_columns = [*NODE_COLUMNS, *extra[0]], [*EDGE_COLUMNS, *extra[1]]
    tiled = {
        "nodes": (with_tile(nodes.select(*node_columns), size), "osmid"),
        "edges": (edges_with_tile(edges.select(*edge_columns, *[c for c in _TILE if c in edges.columns]), nodes, size).select(*edge_columns, *_TILE), "from_node"),
    }
    for name, (rows, by) in tiled.items():
        # one row per tile
        parts = rows.groupBy(*_TILE).agg(F.ceil(F.count(F.lit(1)) / TILE_ROWS).alias("_parts"))
        spread = F.pmod(F.xxhash64(by), "_parts")
        # at most as many rows as the globe has tiles
        whole = rows.join(F.broadcast(parts), _TILE)
        with shuffles_dropped(rows.sparkSession):
            whole.repartition(*_TILE, spread).drop("_parts").write.partitionBy(*_TILE).option("compression", codec).mode(
                "errorifexists"
            ).parquet(f"{path}/{name}")
    meta(nodes, edges, size).coalesce(1).write.json(f"{path}/meta.json")


def tile_filter(tiles: list[tuple[int, int]]) -> Column:
    """Partition filter of a list of (row, column): a range of columns per run of neighbours in a row.

    Past some hundreds of runs the rows' whole ranges are taken: more tiles than
    asked for, which every exact test later sorts out.
    """
    runs: list[list[int]] = []
    for r, c in sorted(set(tiles)):
        if runs and runs[-1][0] == r and runs[-1][2] >= c - 1:
            runs[-1][2] = c
        else:
            runs.append([r, c, c])
    if len(runs) > 400:
        ends: dict[int, list[int]] = {}
        for r, a, b in runs:
            ends[r] = [min(a, ends.get(r, [a])[0]), max(b, ends.get(r, [b, b])[-1])]
        runs = [[r, a, b] for r, (a, b) in ends.items()]
    out = F.lit(False)
    for r, a, b in runs:
        out = out | ((F.col("tile_row") == r) & F.col("tile_col").between(a, b))
    return out


def read_meta(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(f"{path}/meta.json")


def read_store(
    spark: SparkSession, path: str, name: str, tiles: tuple[int, int, int, int] | list[tuple[int, int]] | None = None
) -> DataFrame:
    """Nodes or edges; ``tiles`` prunes partitions: a range (first row, last row, first col, last col) or a list of
    (row, col). Missing tiles are empty.
    """
    rows = spark.read.parquet(f"{path}/{name}")
    if tiles is None:
        return rows
    if isinstance(tiles, list):
        return rows.where(tile_filter(tiles))
    r0, r1, c0, c1 = tiles
    return rows.where(F.col("tile_row").between(r0, r1) & F.col("tile_col").between(c0, c1))


def covering_tiles(
    west: float, south: float, east: float, north: float, margin: int = 0, size: float = K.TILE_DEG
) -> tuple[int, int, int, int]:
    """Tile range over a box, grown by ``margin`` tiles on each side."""
    low = [int(v // size) - margin for v in (south, west)]
    high = [int(v // size) + margin for v in (north, east)]
    return low[0], high[0], low[1], high[1]


def checked_store(spark: SparkSession, path: str) -> dict[str, int]:
    """The whole store read and tested: rows that break a rule, by rule. All zero means sound."""
    from railspoke.operators.graph import typed_edges, with_ends
    from railspoke.operators.validate import geometry_faults, height_mismatches

    nodes, edges = (read_store(spark, path, name) for name in ("nodes", "edges"))
    ends = with_ends(edges, nodes)
    faults = geometry_faults(edges.where("mode = 'bike'"), "from_node", "to_node", "key")
    rows = {
        "missing_end": edges.select("from_node", "to_node", "key"),
        "types": typed_edges(ends, False),
        "heights": height_mismatches(ends),
        **{f: faults.where(F.col("fault") == f) for f in ("no_geometry", "no_height", "gap", "band")},
    }
    counts = {name: r.count() for name, r in rows.items()}
    return {**counts, "missing_end": counts["missing_end"] - ends.count()}


def read_raster(spark: SparkSession, path: str) -> DataFrame:
    """An elevation raster as a table (row, col, elev)."""
    return spark.read.schema("row int, col int, elev double").parquet(path)
