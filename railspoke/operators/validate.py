"""Integrity checks; each gives the violations (or the worst of them) as rows, so an empty result means sound."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from railspoke.functions import columns as C
from railspoke.functions import constants as K


def height_mismatches(edges: DataFrame, most_m: float = 0.5) -> DataFrame:
    """Edges (with both ends' elevations) whose stored height difference is off by more than ``most_m``."""
    off = F.abs(F.col("height_diff_m") - (F.col("to_elev") - F.col("from_elev")))
    return edges.withColumn("off_m", off).where(F.col("off_m") > most_m)


def _gap(line: str) -> Column:
    """The longest step between neighbours of an array of vertices, within the row."""
    step = lambda k: C.haversine_m(
        F.get(line, k - 1)["lat"], F.get(line, k - 1)["lon"], F.get(line, k)["lat"], F.get(line, k)["lon"]
    )
    inner = F.when(F.size(line) >= 2, F.sequence(F.lit(1), F.size(line) - 1)).otherwise(F.array().cast("array<int>"))
    return F.array_max(F.transform(inner, step))


def vertex_gaps(edges: DataFrame, *keys: str) -> DataFrame:
    """(keys, gap_m): the longest step between neighbouring vertices of each stored geometry.

    Vertices are paired with the next one inside the row; only one number per
    edge is shuffled. Lines of one vertex have a null gap.
    """
    texts = F.split(F.regexp_extract("geometry_wkt", r"\(([^)]*)\)", 1), ",")
    rows = edges.where("geometry_wkt is not null").select(*keys, texts.alias("_a"))
    pairs = rows.select(*keys, F.explode(F.arrays_zip("_a", F.slice("_a", 2, F.size("_a")).alias("_b"))).alias("_p"))
    number = lambda v, k: F.get(F.split(F.trim(v), " "), F.lit(k)).try_cast("double")
    a, b = F.col("_p._a"), F.col("_p._b")
    step = C.haversine_m(number(a, 1), number(a, 0), number(b, 1), number(b, 0))
    return pairs.select(*keys, step.alias("_d")).groupBy(*keys).agg(F.max("_d").alias("gap_m"))


def geometry_faults(edges: DataFrame, *keys: str, most_gap_m: float = K.MAX_VERTEX_GAP_M, band_m: float = K.Z_BAND_M) -> DataFrame:
    """(keys, fault, off_m) of bike edges: no_geometry (fewer than two vertices), no_height, gap and band, one row per fault."""
    rows = edges.select(*keys, C.parsed_wkt(F.col("geometry_wkt")).alias("_l"))
    z = F.transform("_l", lambda v: v["z"])
    a, b = F.element_at(z, 1), F.element_at(z, -1)
    over = F.greatest(F.array_max(z) - F.greatest(a, b), F.least(a, b) - F.array_min(z), F.lit(0.0))
    none = F.coalesce(F.size("_l") < 2, F.lit(True)) | F.col("_l").isNull()
    flat = ~none & F.exists("_l", lambda v: v["z"].isNull())
    faults = F.array(
        F.when(none, F.struct(F.lit("no_geometry").alias("fault"), F.lit(None).cast("double").alias("off_m"))),
        F.when(flat, F.struct(F.lit("no_height").alias("fault"), F.lit(None).cast("double").alias("off_m"))),
        F.when(_gap("_l") > most_gap_m, F.struct(F.lit("gap").alias("fault"), _gap("_l").alias("off_m"))),
        F.when(~none & ~flat & (over > band_m), F.struct(F.lit("band").alias("fault"), over.alias("off_m"))),
    )
    return rows.select(*keys, F.explode(F.array_compact(faults)).alias("_f")).select(*keys, "_f.*")


def worst(violations: DataFrame, by: str, *keys: str) -> DataFrame:
    """The one row that violates most, ties by the keys; none where there is none."""
    return violations.where(F.col(by).isNotNull()).orderBy(F.desc(by), *keys).limit(1)


def z_excess(edges: DataFrame, *keys: str) -> DataFrame:
    """(keys, excess_m): how far a vertex lies above or below the band between the line's first and last height."""
    line = C.parsed_wkt(F.col("geometry_wkt"))
    rows = edges.select(*keys, F.transform(line, lambda v: v["z"]).alias("_z")).where("_z is not null")
    a, b = F.element_at("_z", 1), F.element_at("_z", -1)
    over = F.greatest(F.array_max("_z") - F.greatest(a, b), F.least(a, b) - F.array_min("_z"), F.lit(0.0))
    return rows.select(*keys, over.alias("excess_m"))


def cost_sanity(costed: DataFrame) -> DataFrame:
    """The steepest pair of opposite bike edges: riding up must cost more than riding down.

    One row (from_node, to_node, up_m, up_cost, down_cost, sound), or none.
    """
    bike = costed.where("mode = 'bike'").select("from_node", "to_node", "key", "height_diff_m", "cost")
    one = bike.groupBy("from_node", "to_node").agg(
        F.min_by(F.struct("height_diff_m", "cost"), F.struct("cost", "key")).alias("_e")
    )
    up = one.select("from_node", "to_node", F.col("_e.height_diff_m").alias("up_m"), F.col("_e.cost").alias("up_cost"))
    down = one.select(F.col("from_node").alias("to_node"), F.col("to_node").alias("from_node"), F.col("_e.cost").alias("down_cost"))
    pairs = up.where("up_m > 0").join(down, ["from_node", "to_node"])
    worst = pairs.orderBy(F.desc("up_m"), "from_node", "to_node").limit(1)
    return worst.withColumn("sound", F.col("up_cost") > F.col("down_cost"))


def reduction_ok(before: DataFrame, after: DataFrame, least: int = 20) -> DataFrame:
    """One row: node counts before and after, and whether at least half of the nodes went (small graphs pass)."""
    a, b = before.agg(F.count(F.lit(1)).alias("before")), after.agg(F.count(F.lit(1)).alias("after"))
    # one row each
    return a.crossJoin(F.broadcast(b)).withColumn("sound", (F.col("before") < least) | (F.col("after") * 2 < F.col("before")))


def broken_paths(path_edges: DataFrame) -> DataFrame:
    """Hops that do not begin where the hop before them ended."""
    w = Window.partitionBy("query_id").orderBy("seq")
    return path_edges.withColumn("_b", F.lag("to_node").over(w)).where("_b is not null and _b <> from_node")


def region_overlaps(regions: DataFrame, least_deg: float = 0.5) -> DataFrame:
    """(extract_path group, region_key, next_key, overlap_deg, sound) of neighbouring boxes of one row, west to east."""
    w = Window.partitionBy("south", "north").orderBy("west", "region_key")
    nxt = regions.select(
        "*", F.lead("region_key").over(w).alias("next_key"), F.lead("west").over(w).alias("_next_west")
    ).where("next_key is not null")
    overlap = F.round(F.col("east") - F.col("_next_west"), 6)
    return nxt.select("region_key", "next_key", overlap.alias("overlap_deg"), (overlap >= least_deg).alias("sound"))


def missing_regions(regions: DataFrame, nodes: DataFrame) -> DataFrame:
    """Regions that no node was delivered for."""
    return regions.join(nodes.select("region_key").distinct(), "region_key", "left_anti").select("region_key")


def over_ceiling(meta: DataFrame, most_nodes: int) -> DataFrame:
    return meta.where(F.col("n_nodes") > most_nodes)


__all__ = [
    "broken_paths",
    "cost_sanity",
    "geometry_faults",
    "height_mismatches",
    "missing_regions",
    "over_ceiling",
    "reduction_ok",
    "region_overlaps",
    "vertex_gaps",
    "worst",
    "z_excess",
]
