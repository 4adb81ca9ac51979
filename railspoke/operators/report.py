"""Texts and documents of a route: statistics, composition, the report of a trip, GPX, markers on the profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from railspoke.functions import columns as C
from railspoke.operators.track import bike_leg_lines, composition, cumulative_km, gpx_points, rail_leg_lines


def stats_text(km: Column, minutes: Column, ascent_m: Column, descent_m: Column) -> Column:
    """"7.0 km · 24 min · +218 m / −26 m"; halves of whole numbers go to the even one."""
    return F.format_string(
        "%.1f km · %.0f min · +%.0f m / −%.0f m", km, F.bround(minutes, 0), F.bround(ascent_m, 0), F.bround(descent_m, 0)
    )


def composition_text(parts: DataFrame) -> DataFrame:
    """(query_id, text): the three breakdowns as lines of whole percentages, in display order."""
    order = F.when(F.col("dimension") == "Quality", 0).when(F.col("dimension") == "Grade", 1).otherwise(2)
    lines = parts.select("query_id", "dimension", order.alias("_d"), "ord", F.format_string("  %s: %.0f%%", "label", F.bround("pct", 0)).alias("_line"))
    each = lines.groupBy("query_id", "dimension", "_d").agg(F.sort_array(F.collect_list(F.struct("ord", "_line"))).alias("_l"))
    one = each.select("query_id", "_d", F.concat_ws("\n", F.concat("dimension", F.lit(":")), F.transform("_l", lambda x: x["_line"])).alias("_t"))
    whole = one.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("_d", "_t"))).alias("_l"))
    return whole.select("query_id", F.array_join(F.transform("_l", lambda x: x["_t"]), "\n").alias("text"))


def _lines(rows: DataFrame) -> DataFrame:
    """(query_id, lines) of (query_id, leg, line), in the order of the legs; a trip has few legs."""
    listed = rows.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("leg", "line"))).alias("_l"))
    return listed.select("query_id", F.array_join(F.transform("_l", lambda x: F.concat(F.lit("  "), x["line"])), "\n").alias("lines"))


def trip_reports(h: DataFrame, stats: DataFrame, points: DataFrame) -> DataFrame:
    """(query_id, report): totals, bike alone, composition, trains to catch (if any) and bike legs."""
    text = lambda k: stats_text(F.col(f"{k}_km"), F.col(f"{k}_min"), F.col(f"{k}_ascent_m"), F.col(f"{k}_descent_m"))
    head = stats.select("query_id", text("total").alias("_total"), text("bike").alias("_bike"))
    parts = composition_text(composition(points)).withColumnRenamed("text", "_parts")
    origin, destination = F.concat(F.lit("start of "), "query_id"), F.concat(F.lit("end of "), "query_id")
    rails = _lines(rail_leg_lines(h).select("query_id", "leg", "line")).withColumnRenamed("lines", "_rails")
    bikes = _lines(bike_leg_lines(h, origin, destination).select("query_id", "leg", "line")).withColumnRenamed("lines", "_bikes")
    rows = head.join(parts, "query_id").join(rails, "query_id", "left").join(bikes, "query_id", "left")
    report = F.concat_ws(
        "\n",
        F.concat(F.lit("Total (bike + train): "), "_total"),
        F.concat(F.lit("Bike only:            "), "_bike"),
        "_parts",
        F.when(F.col("_rails").isNotNull(), F.concat(F.lit("Trains to catch:\n"), "_rails")),
        F.when(F.col("_bikes").isNotNull(), F.concat(F.lit("Bike legs:\n"), "_bikes")),
    )
    return rows.select("query_id", report.alias("report"))


def gpx_documents(points: DataFrame, start: Column, name: Column) -> DataFrame:
    """(query_id, gpx): one document per trip, one track of one segment, times counted from the start."""
    each = gpx_points(points, start).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("seq", "trkpt"))).alias("_l"))
    body = F.array_join(F.transform("_l", lambda x: x["trkpt"]), "\n")
    safe = F.replace(F.replace(F.replace(name, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    head = F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<gpx xmlns="http://www.topografix.com/GPX/1/1" version="1.1" creator="railspoke">\n<trk><name>')
    return each.select("query_id", F.concat(head, safe, F.lit("</name><trkseg>\n"), body, F.lit("\n</trkseg></trk>\n</gpx>\n")).alias("gpx"))


def markers_on_track(markers: DataFrame, points: DataFrame) -> DataFrame:
    """(query_id, marker, km, elevation_m) of each marker (query_id, marker, lat, lon) at its trip's nearest track point, ties by order."""
    at = cumulative_km(points).select("query_id", "seq", F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), "km", "elevation_m")
    far = F.round(C.haversine_m(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon")), 6)
    best = F.min_by(F.struct("km", "elevation_m"), F.struct(far, "seq"))
    return markers.join(at, "query_id").groupBy("query_id", "marker").agg(best.alias("_b")).select("query_id", "marker", "_b.*")


def station_markers(h: DataFrame) -> DataFrame:
    """(query_id, marker, lat, lon) of the stations where a train is boarded or left."""
    runs = Window.partitionBy("query_id").orderBy("seq")
    rail = h.withColumn("_b", F.lag("mode").over(runs)).withColumn("_a", F.lead("mode").over(runs)).where("mode = 'rail'")
    ends = [
        rail.where(F.col(f"_{n}").isNull() | (F.col(f"_{n}") != "rail")).select(
            "query_id", F.concat(F.lit(f"{side}/"), F.col("seq").cast("string")).alias("marker"), F.col(f"{side}_lat").alias("lat"), F.col(f"{side}_lon").alias("lon")
        )
        for side, n in (("from", "b"), ("to", "a"))
    ]
    return ends[0].unionByName(ends[1])


def sub_path(paths: DataFrame, first: Column, last: Column) -> DataFrame:
    """The part of each path between two positions, both included, numbered anew."""
    return paths.where(F.col("seq").between(first, last)).withColumn("seq", (F.col("seq") - first).cast("int"))


def overview(edges: DataFrame, nodes: DataFrame, cell: float = 0.1) -> DataFrame:
    """(mode, row, col, edges, km): what an overview map draws, per grid cell of the edges' starts."""
    at = nodes.select(F.col("osmid").alias("from_node"), F.floor(F.col("lat") / cell).alias("row"), F.floor(F.col("lon") / cell).alias("col"))
    return edges.join(at, "from_node").groupBy("mode", "row", "col").agg(F.count(F.lit(1)).alias("edges"), (F.sum("length_m") / 1000.0).alias("km"))
