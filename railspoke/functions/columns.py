"""Column expressions: geometry on the sphere, tags, costs, speeds, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from railspoke.functions import constants as K


def lit_map(values: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres; null where a coordinate is null."""
    a, b = F.radians(lat1), F.radians(lat2)
    half_lat, half_lon = F.sin((b - a) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    h = half_lat * half_lat + F.cos(a) * F.cos(b) * half_lon * half_lon
    return F.lit(2.0 * K.EARTH_RADIUS_M) * F.atan2(F.sqrt(h), F.sqrt(F.lit(1.0) - h))


def tile(degrees: Column, size: float = K.TILE_DEG) -> Column:
    return F.floor(degrees / F.lit(size)).cast("int")


def tile_name(row: Column, col: Column) -> Column:
    return F.format_string("tile_%d_%d", row, col)


def axis(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> dict[str, Column]:
    """What the distance to the segment a-b needs of it, in a frame where one unit is a degree of latitude on both axes.

    To be kept as columns of a query, so that it is computed once and not for every candidate.
    """
    scale = F.cos(F.radians((lat_a + lat_b) / 2))
    dx, dy = (lon_b - lon_a) * scale, lat_b - lat_a
    length = F.sqrt(dx * dx + dy * dy)
    return {
        "ax_scale": scale,
        "ax_x": lon_a * scale,
        "ax_y": lat_a,
        "ax_len": length,
        "ax_ux": dx / length,
        "ax_uy": dy / length,
    }


AXIS = ("ax_scale", "ax_x", "ax_y", "ax_len", "ax_ux", "ax_uy")


def near_axis(lat: Column, lon: Column, reach: float | Column, extend_km: float) -> Column:
    """Whether a place is within ``reach`` (units of the frame) of the segment, extended at both ends; the rim is in."""
    scale, x, y, length, ux, uy = (F.col(c) for c in AXIS)
    ext = F.lit(extend_km * 1000.0 / K.METRES_PER_DEGREE)
    px, py = lon * scale - x, lat - y
    along = F.greatest(-ext, F.least(length + ext, px * ux + py * uy))
    dx, dy = px - along * ux, py - along * uy
    return F.sqrt(dx * dx + dy * dy) <= reach


def in_corridor(lat: Column, lon: Column, half_width_km: float, extend_km: float) -> Column:
    """Over rows with the columns of ``axis``."""
    return near_axis(lat, lon, F.lit(half_width_km * 1000.0 / K.METRES_PER_DEGREE), extend_km)


def normal_tags(tags: Column) -> Column:
    """Lower-cased list of the tag values of an array column; nulls leave."""
    return F.array_compact(F.transform(F.coalesce(tags, F.array().cast("array<string>")), F.lower))


def tag_list(tag: Column) -> Column:
    """One stored tag as a list; a string is never split."""
    return F.when(tag.isNull(), F.array().cast("array<string>")).otherwise(F.array(F.lower(tag)))


def worst_weight(values: Column, weights: dict[str, float], default: float) -> Column:
    """Highest weight of the known values, else the default."""
    known = lit_map(weights)
    return F.coalesce(F.array_max(F.transform(values, lambda v: F.try_element_at(known, v))), F.lit(default))


def surface_weight(tag: Column) -> Column:
    return worst_weight(tag_list(tag), K.SURFACE_WEIGHT, K.SURFACE_UNTAGGED)


def road_weight(tag: Column) -> Column:
    return worst_weight(tag_list(tag), K.ROAD_WEIGHT, K.ROAD_UNTAGGED)


def allowed(values: Column, weights: dict[str, float]) -> Column:
    """Untagged, or every value known."""
    known = lit_map(weights)
    return F.forall(values, lambda v: F.map_contains_key(known, v))


def colour_tier(weight: Column) -> Column:
    """0 where the weight rounds (half to even) to 0, else 1."""
    return F.when(F.bround(weight, 0) == 0, 0).otherwise(1)


def checked(value: Column, ok: Column, message: str) -> Column:
    return F.when(ok, value).otherwise(F.raise_error(F.lit(message)))


def edge_cost(
    mode: Column,
    length_m: Column,
    climb_m: Column,
    surface: Column,
    highway: Column,
    prefs: dict[str, Column] | None = None,
    strict: bool = False,
) -> Column:
    """Metres plus the extra metres of the preferences; ``strict`` raises on broken edges instead of giving null."""
    p = prefs or {k: F.lit(v) for k, v in K.PREFERENCES.items()}
    km = length_m / 1000.0
    bike = (
        length_m
        + F.greatest(climb_m, F.lit(0.0)) / 100.0 * p["uphill"] * 1000.0
        + surface_weight(surface) * p["unpaved"] * km * 1000.0
        + road_weight(highway) * p["main"] * km * 1000.0
    )
    cost = (
        F.when(mode == "bike", bike)
        .when(mode == "rail", length_m + p["rail"] * km * 1000.0)
        .when(mode == "station", length_m + F.lit(0.5) * p["boarding"] * 1000.0)
    )
    sound = (length_m >= 0) & cost.isNotNull()
    if not strict:
        return F.when(sound, cost)
    near = (mode != "station") | (length_m <= K.STATION_RADIUS_M)
    return checked(cost, sound & near, "edge of unknown mode, negative length or too long station link")


def bike_kmh(weight: Column, grade: Column) -> Column:
    base = F.lit(K.BASE_KMH) + F.least(weight, F.lit(1.0)) * F.lit(K.ROUGH_KMH - K.BASE_KMH)
    slope = base + (F.lit(K.WALK_KMH) - base) * (grade / K.WALK_GRADE)
    return F.when(grade <= 0, base).when(grade >= K.WALK_GRADE, F.lit(K.WALK_KMH)).otherwise(slope)


def edge_kmh(mode: Column, weight: Column, grade: Column) -> Column:
    return F.when(mode == "bike", bike_kmh(weight, grade)).when(mode == "rail", F.lit(K.RAIL_KMH)).otherwise(K.WALK_KMH)


def edge_seconds(mode: Column, length_m: Column, kmh: Column) -> Column:
    """A station link takes half the boarding wait, whatever speed it reports."""
    return F.when(mode == "station", F.lit(0.5 * K.BOARDING_WAIT_S)).otherwise(length_m / (kmh / 3.6))


def condition_class(mode: Column, surface_bad: Column, road_bad: Column) -> Column:
    return (
        F.when(mode == "rail", "train")
        .when(road_bad & surface_bad, "main road + unpaved")
        .when(road_bad, "main road")
        .when(surface_bad, "unpaved")
        .otherwise("good")
    )


def grade_class(mode: Column, grade: Column) -> Column:
    return (
        F.when(mode == "rail", "train")
        .when(grade >= K.GRADE_MARGIN, "uphill")
        .when(grade <= -K.GRADE_MARGIN, "downhill")
        .otherwise("flat")
    )


def ribbon_width_m(kmh: Column) -> Column:
    return F.lit(K.RIBBON_WIDTH_M) * F.sqrt(F.lit(K.RIBBON_KMH) / kmh)


def zoom_for_span(span_m: Column) -> Column:
    return F.greatest(F.lit(7.0), F.least(F.lit(14.0), F.lit(11.0) + F.log2(F.lit(8000.0) / span_m)))


def hex_rgb(colour: Column) -> Column:
    h = F.ltrim(colour, F.lit("#"))
    return F.array(*[F.conv(F.substring(h, k, 2), 16, 10).cast("int") for k in (1, 3, 5)])


def slug(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "_"), F.lit("_"))


def short_place(text: Column) -> Column:
    groups = F.split(slug(text), "_")
    kept = F.when(F.length(groups[0]) > 3, F.slice(groups, 1, 1)).otherwise(F.slice(groups, 1, 2))
    return F.array_join(kept, "_")


def place_label(name: Column, elevation_m: Column) -> Column:
    # halves go to the even metre
    return F.format_string("%s (%.0f m)", F.coalesce(name, F.lit(K.UNNAMED_STOP)), F.bround(elevation_m, 0))


def latlon_text(lat: Column, lon: Column) -> Column:
    return F.format_string("%.6f,%.6f", lat, lon)


def maps_url(points: Column) -> Column:
    """Directions URL of an array of (lat, lon) structs, origin and destination included."""
    text = F.transform(points, lambda p: latlon_text(p["lat"], p["lon"]))
    n = F.size(text)
    inner = F.slice(text, 2, F.greatest(n - 2, F.lit(0)))
    url = F.concat(
        F.lit(K.GMAPS_BASE + "&origin="),
        F.url_encode(F.element_at(text, 1)),
        F.lit("&destination="),
        F.url_encode(F.element_at(text, -1)),
        F.lit("&travelmode=bicycling"),
        F.when(n > 2, F.concat(F.lit("&waypoints="), F.url_encode(F.array_join(inner, "|")))).otherwise(""),
    )
    return checked(url, (n >= 2) & (n <= K.GMAPS_INTERIOR + 2), "2 to 11 points make a Maps URL")


_LATLON = r"^\s*(-?\d+(?:\.\d+)?)\s*,\s*(-?\d+(?:\.\d+)?)\s*(?:\((.*)\))?\s*$"


def parsed_latlon(text: Column) -> Column:
    """(lat, lon, name) of "lat, lon" or "lat, lon (Name)"; null where it is none or off the globe."""
    part = [F.regexp_extract(text, _LATLON, k) for k in (1, 2, 3)]
    lat, lon = (p.try_cast("double") for p in part[:2])
    ok = lat.between(-90, 90) & lon.between(-180, 180)
    return F.when(ok, F.struct(lat.alias("lat"), lon.alias("lon"), F.nullif(part[2], F.lit("")).alias("name")))


# --- stored geometries: LINESTRING Z (lon lat z, ...) ---


def parsed_wkt(wkt: Column) -> Column:
    """Array of (lon, lat, z) structs; z is null where it is not stored; null for a null text."""
    body = F.regexp_extract(wkt, r"\(([^)]*)\)", 1)
    number = lambda v, k: F.get(F.split(F.trim(v), r"\s+"), F.lit(k)).try_cast("double")
    vertex = lambda v: F.struct(number(v, 0).alias("lon"), number(v, 1).alias("lat"), number(v, 2).alias("z"))
    return F.when(wkt.isNotNull(), F.transform(F.split(body, ","), vertex))


def oriented(verts: Column, lat_a: Column, lon_a: Column) -> Column:
    """Vertices turned so that they begin at the end nearer to (lat_a, lon_a)."""
    off = lambda v: F.abs(v["lon"] - lon_a) + F.abs(v["lat"] - lat_a)
    turn = off(F.element_at(verts, -1)) < off(F.element_at(verts, 1))
    return F.when(turn, F.reverse(verts)).otherwise(verts)
