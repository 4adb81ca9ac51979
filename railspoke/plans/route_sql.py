"""SQL of the route queries, for engines that read the same Parquet tables."""

from __future__ import annotations

from railspoke.functions import constants as K
from railspoke.plans.routes import BIKE_TUBE, CLIP, RAIL_TUBE, ROUTE_PREFS, SHORTEST_KM, SWEEP, params_token


def _values(name: str, weights: dict[str, float]) -> str:
    rows = ", ".join(f"('{k}', {v!r}::DOUBLE)" for k, v in weights.items())
    return f"{name}(tag, w) AS (VALUES {rows})"


def _hav(a: str, b: str, c: str, d: str) -> str:
    h = f"(pow(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))"
    return f"(2.0::DOUBLE * {K.EARTH_RADIUS_M} * atan2(sqrt({h}), sqrt(1.0::DOUBLE - {h})))"


def _r(column: str, digits: int = 4) -> str:
    return f"round({column}, {digits}) + 0.0::DOUBLE"


_FITS = """CASE e0.mode WHEN 'bike' THEN f.node_type = 'bike' AND t.node_type = 'bike'
    WHEN 'rail' THEN f.node_type = 'rail' AND t.node_type = 'rail'
    WHEN 'station' THEN f.node_type <> t.node_type AND f.node_type IN ('bike', 'rail') AND t.node_type IN ('bike', 'rail')
    ELSE FALSE END"""

_BASE = f"""
{_values("sw", K.SURFACE_WEIGHT)},
{_values("rw", K.ROAD_WEIGHT)},
n0 AS (
  SELECT osmid, max(lat) AS lat, max(lon) AS lon,
    max(CASE WHEN NOT isnan(elevation_m) AND elevation_m >= -500 THEN elevation_m END) AS known,
    max(lower(trim(node_type, ' '))) AS node_type, max(nullif(trim(station_name, ' '), '')) AS station_name,
    max(place_key) AS place_key, max(region_key) AS region_key
  FROM nodes WHERE osmid IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL AND NOT (lat = 0 AND lon = 0)
  GROUP BY osmid
), n AS MATERIALIZED (
  SELECT osmid, lat, lon, coalesce(known,
    (SELECT round(sum(known::DECIMAL(18,4))::DOUBLE / count(known), 1) FROM n0), 0.0) AS elevation_m,
    node_type, station_name, place_key, region_key
  FROM n0
), e0 AS (
  SELECT * FROM edges WHERE NOT (mode = 'bike' AND from_node = to_node)
  QUALIFY row_number() OVER (PARTITION BY from_node, to_node, key, mode ORDER BY loaded_at, row_id) = 1
), e AS MATERIALIZED (
  SELECT e0.from_node, e0.to_node, e0.key, e0.length_m, t.elevation_m - f.elevation_m AS height_diff_m,
    e0.surface, e0.highway, e0.mode, e0.geometry_wkt, e0.row_id,
    f.lat AS from_lat, f.lon AS from_lon, f.elevation_m AS from_elev, f.station_name AS from_name,
    t.lat AS to_lat, t.lon AS to_lon, t.elevation_m AS to_elev, t.station_name AS to_name,
    coalesce(sw.w, {K.SURFACE_UNTAGGED!r}::DOUBLE) AS s_weight, coalesce(rw.w, {K.ROAD_UNTAGGED!r}::DOUBLE) AS r_weight,
    (e0.surface IS NULL OR sw.w IS NOT NULL) AND (e0.highway IS NULL OR rw.w IS NOT NULL) AS allowed
  FROM e0 JOIN n f ON e0.from_node = f.osmid JOIN n t ON e0.to_node = t.osmid
  LEFT JOIN sw ON lower(e0.surface) = sw.tag LEFT JOIN rw ON lower(e0.highway) = rw.tag
  WHERE {_FITS}
)"""


def _cost(p: dict[str, object]) -> str:
    d = {k: v if isinstance(v, str) else f"{v!r}::DOUBLE" for k, v in p.items()}
    return f"""CASE e.mode
      WHEN 'bike' THEN e.length_m + greatest(e.height_diff_m, 0.0) / 100.0::DOUBLE * {d["uphill"]} * 1000.0::DOUBLE
        + e.s_weight * {d["unpaved"]} * (e.length_m / 1000.0::DOUBLE) * 1000.0::DOUBLE
        + e.r_weight * {d["main"]} * (e.length_m / 1000.0::DOUBLE) * 1000.0::DOUBLE
      WHEN 'rail' THEN e.length_m + {d["rail"]} * (e.length_m / 1000.0::DOUBLE) * 1000.0::DOUBLE
      WHEN 'station' THEN e.length_m + 0.5::DOUBLE * {d["boarding"]} * 1000.0::DOUBLE END"""


def _tier(w: str) -> str:
    return f"CASE WHEN round_even({w}, 0) = 0 THEN 0 ELSE 1 END"


_BASE_KMH = f"({K.BASE_KMH} + least(s_weight, 1.0::DOUBLE) * ({K.ROUGH_KMH - K.BASE_KMH})::DOUBLE)"
_SPEED = f"""
, sp AS (
  SELECT *, CASE WHEN length_m > 0 THEN height_diff_m / length_m END AS grade FROM e
), sk AS (
  SELECT *, CASE WHEN mode = 'rail' THEN {K.RAIL_KMH}::DOUBLE WHEN mode <> 'bike' THEN {K.WALK_KMH}::DOUBLE
    WHEN grade <= 0 THEN {_BASE_KMH} WHEN grade >= {K.WALK_GRADE} THEN {K.WALK_KMH}::DOUBLE
    ELSE {_BASE_KMH} + ({K.WALK_KMH} - {_BASE_KMH}) * (grade / {K.WALK_GRADE}::DOUBLE) END AS kmh,
    mode = 'bike' AND {_tier("s_weight")} <> 0 AS surface_bad, mode = 'bike' AND {_tier("r_weight")} <> 0 AS road_bad
  FROM sp
), es AS (
  SELECT *, CASE WHEN mode = 'station' THEN {0.5 * K.BOARDING_WAIT_S}::DOUBLE ELSE length_m / (kmh / 3.6::DOUBLE) END AS leg_s FROM sk
)"""
_CONDITION = """CASE WHEN mode = 'rail' THEN 'train' WHEN road_bad AND surface_bad THEN 'main road + unpaved'
    WHEN road_bad THEN 'main road' WHEN surface_bad THEN 'unpaved' ELSE 'good' END"""
_GRADE = f"""CASE WHEN mode = 'rail' THEN 'train' WHEN grade >= {K.GRADE_MARGIN} THEN 'uphill'
    WHEN grade <= -{K.GRADE_MARGIN} THEN 'downhill' ELSE 'flat' END"""
_WIDTH = f"CASE WHEN mode = 'bike' THEN {K.RIBBON_WIDTH_M} * sqrt({K.RIBBON_KMH}::DOUBLE / kmh) ELSE {K.RIBBON_WIDTH_M}::DOUBLE END"

_INSIDE = " AND ".join(
    f"lat_{e} BETWEEN bx.south AND bx.north AND lon_{e} BETWEEN bx.west AND bx.east" for e in "ab"
)


def _verdict(min_km: float) -> str:
    return f"""CASE WHEN km < {min_km} THEN 'too_short' WHEN km > {K.MAX_TRIP_KM} THEN 'too_long'
      WHEN NOT ({_INSIDE}) THEN 'out_of_coverage' END"""


_TRIPS = f"""
, places AS (
  SELECT region_key, place_key, min(struct_pack(lon, osmid, lat)) AS a, max(struct_pack(lon, osmid, lat)) AS b
  FROM n WHERE node_type = 'bike' AND place_key IS NOT NULL GROUP BY 1, 2
), firsts AS (
  SELECT region_key, arg_min(a, place_key) AS a FROM places GROUP BY 1
), bx AS (SELECT min(west) AS west, min(south) AS south, max(east) AS east, max(north) AS north FROM build_regions
), ends AS (
  SELECT region_key || '/' || place_key AS query_id, a, coalesce(lead(b) OVER w, first_value(b) OVER w) AS b
  FROM places WINDOW w AS (PARTITION BY region_key ORDER BY place_key)
  UNION ALL
  SELECT region_key || '/next', a, lead(a) OVER (ORDER BY region_key) FROM firsts
  UNION ALL
  SELECT region_key || '/south', a, struct_pack(lon := a.lon, osmid := 0::BIGINT, lat := south - 0.5::DOUBLE) FROM firsts, bx
), trips AS MATERIALIZED (
  SELECT *, {_hav("lat_a", "lon_a", "lat_b", "lon_b")} / 1000.0::DOUBLE AS km FROM (
    SELECT query_id, a.osmid AS source, b.osmid AS target, a.lat AS lat_a, a.lon AS lon_a, b.lat AS lat_b, b.lon AS lon_b
    FROM ends WHERE b IS NOT NULL AND a.osmid <> b.osmid)
)"""
_QUERIES = (
    _TRIPS
    + f"""
, q AS MATERIALIZED (
  SELECT query_id, source, target, lat_a, lon_a, lat_b, lon_b FROM trips, bx WHERE ({_verdict(SHORTEST_KM)}) IS NULL
)"""
)


def _tube(name: str, kind: str, half_km: float, extend_km: float) -> str:
    ext, rad = extend_km * 1000.0 / K.METRES_PER_DEGREE, half_km * 1000.0 / K.METRES_PER_DEGREE
    return f"""
, {name}0 AS (
  SELECT query_id, osmid, cos(radians((lat_a + lat_b) / 2)) AS sc, lat, lon, lat_a, lon_a, lat_b, lon_b
  FROM q JOIN n ON node_type = '{kind}' AND n.lat BETWEEN least(lat_a, lat_b) - {(ext + rad) * 1.01!r} AND greatest(lat_a, lat_b) + {(ext + rad) * 1.01!r}
), {name}1 AS (
  SELECT *, lon_b * sc - lon_a * sc AS vx, lat_b - lat_a AS vy, lon * sc - lon_a * sc AS px, lat - lat_a AS py FROM {name}0
), {name}2 AS (
  SELECT *, sqrt(vx * vx + vy * vy) AS len FROM {name}1
), {name}3 AS (
  SELECT *, greatest({-ext!r}::DOUBLE, least(len + {ext!r}::DOUBLE, (px * vx + py * vy) / len)) AS al FROM {name}2
), {name} AS (
  SELECT query_id, osmid FROM {name}3
  WHERE sqrt(pow(px - al * vx / len, 2) + pow(py - al * vy / len, 2)) <= {rad!r}::DOUBLE
)"""


_TUBES = _tube("tb", "bike", *BIKE_TUBE) + _tube("tr", "rail", *RAIL_TUBE)
_CORRIDOR = (
    _QUERIES
    + _TUBES
    + """
, inside AS MATERIALIZED (SELECT * FROM tb UNION ALL SELECT * FROM tr)
, ce AS MATERIALIZED (
  SELECT a.query_id, e.* FROM e JOIN inside a ON e.from_node = a.osmid
  JOIN inside b ON e.to_node = b.osmid AND a.query_id = b.query_id
)"""
)
_REACH = f"""
, cc AS MATERIALIZED (
  SELECT query_id, from_node, to_node, min({_cost(ROUTE_PREFS).replace("e.", "ce.")}) AS cost FROM ce GROUP BY ALL
), reach(query_id, node, cost, pred) USING KEY (query_id, node) AS (
  SELECT query_id, source, 0.0::DOUBLE, NULL::BIGINT FROM q
  UNION
  SELECT r.query_id, c.to_node, min(r.cost + c.cost), arg_min(r.node, r.cost + c.cost)
  FROM reach r JOIN cc c ON c.query_id = r.query_id AND c.from_node = r.node
  LEFT JOIN recurring.reach x ON x.query_id = r.query_id AND x.node = c.to_node
  WHERE x.cost IS NULL OR r.cost + c.cost < x.cost
  GROUP BY r.query_id, c.to_node
), walk(query_id, node, cost, pred, k) AS (
  SELECT r.query_id, r.node, r.cost, r.pred, 0 FROM reach r JOIN q ON q.query_id = r.query_id AND r.node = q.target
  UNION ALL
  SELECT r.query_id, r.node, r.cost, r.pred, w.k + 1
  FROM walk w JOIN reach r ON r.query_id = w.query_id AND r.node = w.pred
), path AS MATERIALIZED (
  SELECT query_id, (max(k) OVER (PARTITION BY query_id) - k)::INTEGER AS seq, node AS osmid, cost AS reached FROM walk
)"""
_ROUTE = _CORRIDOR + _REACH
_HOPS = (
    _ROUTE
    + _SPEED
    + f"""
, hop0 AS (
  SELECT query_id, seq, lag(osmid) OVER (PARTITION BY query_id ORDER BY seq) AS from_node, osmid AS to_node FROM path
), h AS MATERIALIZED (
  SELECT p.query_id, p.seq, e.*, {_cost(ROUTE_PREFS)} AS cost
  FROM hop0 p JOIN es e ON e.from_node = p.from_node AND e.to_node = p.to_node
  QUALIFY row_number() OVER (PARTITION BY p.query_id, p.seq ORDER BY cost, e.key) = 1
), pts AS (
  SELECT query_id, 0 AS seq, from_lat AS lat, from_lon AS lon, from_elev AS elevation_m, 0.0::DOUBLE AS elapsed_s,
    mode, surface_bad, road_bad, grade, kmh FROM h WHERE seq = 1
  UNION ALL
  SELECT query_id, seq, to_lat, to_lon, to_elev, sum(leg_s) OVER (PARTITION BY query_id ORDER BY seq),
    mode, surface_bad, road_bad, grade, kmh FROM h
), kms AS (
  SELECT *, coalesce({_hav("plat", "plon", "lat", "lon")} / 1000.0::DOUBLE, 0.0) AS leg_km FROM (
    SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM pts WINDOW w AS (PARTITION BY query_id ORDER BY seq))
), runs AS (
  SELECT *, sum(new) OVER (PARTITION BY query_id ORDER BY seq)::INTEGER AS run FROM (
    SELECT *, CASE WHEN mode = lag(mode) OVER (PARTITION BY query_id ORDER BY seq) THEN 0 ELSE 1 END AS new FROM h)
)"""
)
_VERTS = f"""
, raw AS (
  SELECT query_id, seq, from_lat, from_lon, unnest(string_split(regexp_extract(geometry_wkt, '\\(([^)]*)\\)', 1), ',')) AS v,
    generate_subscripts(string_split(regexp_extract(geometry_wkt, '\\(([^)]*)\\)', 1), ','), 1) AS k
  FROM h WHERE geometry_wkt IS NOT NULL
), parsed AS (
  SELECT query_id, seq, from_lat, from_lon, k, split_part(trim(v), ' ', 1)::DOUBLE AS lon, split_part(trim(v), ' ', 2)::DOUBLE AS lat,
    split_part(trim(v), ' ', 3)::DOUBLE AS z, count(*) OVER (PARTITION BY query_id, seq) AS nv FROM raw
), turned AS (
  SELECT query_id, seq, max(CASE WHEN k = nv THEN abs(lon - from_lon) + abs(lat - from_lat) END)
    < max(CASE WHEN k = 1 THEN abs(lon - from_lon) + abs(lat - from_lat) END) AS turn
  FROM parsed GROUP BY 1, 2
), vt AS (
  SELECT p.query_id, p.seq, CASE WHEN turn THEN nv - k ELSE k - 1 END AS k, lon, lat, z FROM parsed p JOIN turned USING (query_id, seq)
  UNION ALL SELECT query_id, seq, 0, from_lon, from_lat, from_elev FROM h WHERE geometry_wkt IS NULL
  UNION ALL SELECT query_id, seq, 1, to_lon, to_lat, to_elev FROM h WHERE geometry_wkt IS NULL
), va AS (
  SELECT *, coalesce(sum(d) OVER (PARTITION BY query_id, seq ORDER BY k), 0.0) AS along FROM (
    SELECT *, {_hav("lag(lat) OVER w", "lag(lon) OVER w", "lat", "lon")} AS d FROM vt WINDOW w AS (PARTITION BY query_id, seq ORDER BY k))
), vx AS MATERIALIZED (
  SELECT v.query_id, v.seq, v.k, v.lon, v.lat, v.along, max(v.along) OVER (PARTITION BY v.query_id, v.seq) AS total,
    max(v.k) OVER (PARTITION BY v.query_id, v.seq) AS last_k,
    CASE WHEN h.mode = 'bike' THEN v.z ELSE h.from_elev + (h.to_elev - h.from_elev) * v.along
      / coalesce(nullif(max(v.along) OVER (PARTITION BY v.query_id, v.seq), 0.0), 1.0::DOUBLE) END AS z
  FROM va v JOIN h ON h.query_id = v.query_id AND h.seq = v.seq
)"""
_DENSE = """
, ht AS (
  SELECT *, sum(leg_s) OVER (PARTITION BY query_id ORDER BY seq) AS t1, max(seq) OVER (PARTITION BY query_id) AS last_seq FROM h
), dense AS (
  SELECT h.query_id, h.seq, v.k::INTEGER AS pt, v.lat, v.lon, v.z AS elevation_m,
    (t1 - leg_s) + (t1 - (t1 - leg_s)) * v.along / coalesce(nullif(v.total, 0.0), 1.0::DOUBLE) AS elapsed_s,
    h.mode, h.surface_bad, h.road_bad, h.grade, h.kmh
  FROM ht h JOIN vx v ON v.query_id = h.query_id AND v.seq = h.seq WHERE v.k < v.last_k OR h.seq = last_seq
)"""
_CLIMB = f"""
, hr AS (
  SELECT r.query_id, r.seq, r.run, v.total FROM runs r JOIN (SELECT DISTINCT query_id, seq, total FROM vx) v
    ON v.query_id = r.query_id AND v.seq = r.seq WHERE r.mode = 'bike'
), begun AS (
  SELECT *, coalesce(sum(total) OVER (PARTITION BY query_id, run ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS b,
    sum(total) OVER (PARTITION BY query_id, run) AS leg_m FROM hr
), line AS (
  SELECT b.query_id, b.run, b.leg_m, b.b + v.along AS x, v.z, row_number() OVER (PARTITION BY b.query_id, b.run ORDER BY b.seq, v.k) AS i
  FROM begun b JOIN vx v ON v.query_id = b.query_id AND v.seq = b.seq WHERE b.leg_m > 0
), seg AS (
  SELECT *, lead(x) OVER w AS x1, lead(z) OVER w AS z1 FROM line WINDOW w AS (PARTITION BY query_id, run ORDER BY i)
), grid AS (
  SELECT query_id, run, leg_m, cnt, unnest(generate_series(0, cnt - 1)) AS g FROM (
    SELECT DISTINCT query_id, run, leg_m, greatest(2, ceil(leg_m / {K.CLIMB_WINDOW_M})::INTEGER + 1) AS cnt FROM begun WHERE leg_m > 0)
), hit AS (
  SELECT g.query_id, g.run, g.g, s.z + CASE WHEN s.x1 > s.x THEN (s.z1 - s.z) * (least(g.g * leg / (g.cnt - 1), s.x1) - s.x) / (s.x1 - s.x) ELSE 0.0 END AS z
  FROM (SELECT *, leg_m AS leg FROM grid) g JOIN seg s ON s.query_id = g.query_id AND s.run = g.run AND s.x1 IS NOT NULL
    AND s.x1 > s.x AND least(g.g * g.leg / (g.cnt - 1), g.leg) >= s.x AND least(g.g * g.leg / (g.cnt - 1), g.leg) <= s.x1 + 1e-9::DOUBLE
  QUALIFY row_number() OVER (PARTITION BY g.query_id, g.run, g.g ORDER BY s.i DESC) = 1
), diffs AS (
  SELECT query_id, z - lag(z) OVER (PARTITION BY query_id, run ORDER BY g) AS d FROM hit
), bk AS (
  SELECT query_id, coalesce(sum(d) FILTER (WHERE d > 0), 0.0) AS up, coalesce(-sum(d) FILTER (WHERE d < 0), 0.0) AS down FROM diffs GROUP BY 1
), ot AS (
  SELECT query_id, coalesce(sum(to_elev - from_elev) FILTER (WHERE to_elev > from_elev), 0.0) AS up,
    coalesce(sum(from_elev - to_elev) FILTER (WHERE to_elev < from_elev), 0.0) AS down FROM h WHERE mode <> 'bike' GROUP BY 1
), climb AS (
  SELECT i.query_id, coalesce(bk.up, 0.0) AS bike_up, coalesce(bk.down, 0.0) AS bike_down,
    coalesce(ot.up, 0.0) AS other_up, coalesce(ot.down, 0.0) AS other_down
  FROM (SELECT DISTINCT query_id FROM h) i LEFT JOIN bk USING (query_id) LEFT JOIN ot USING (query_id)
)"""


def _composed(source: str) -> str:
    return f"""
, bucket AS (
  SELECT query_id, 'Quality' AS dimension, CASE {_CONDITION} WHEN 'main road + unpaved' THEN 'main road' ELSE {_CONDITION} END AS label, leg_km
  FROM {source} WHERE seq > 0 AND mode = 'bike'
  UNION ALL SELECT query_id, 'Grade', {_GRADE}, leg_km FROM {source} WHERE seq > 0 AND mode = 'bike'
  UNION ALL SELECT query_id, 'Mode', CASE WHEN mode = 'rail' THEN 'train path' ELSE 'bike route' END, leg_km FROM {source} WHERE seq > 0
), composed AS (
  SELECT query_id, dimension, label, CASE WHEN label IN ('good', 'flat', 'bike route') THEN 0
    WHEN label IN ('unpaved', 'uphill', 'train path') THEN 1 ELSE 2 END AS ord, sum(leg_km) AS km FROM bucket GROUP BY ALL
)"""


_NUMBERED = f"""
, nd AS (
  SELECT query_id, (row_number() OVER w - 1)::INTEGER AS seq, lat, lon, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon,
    CASE WHEN pt = 0 THEN coalesce(lag(mode) OVER w, mode) ELSE mode END AS mode,
    CASE WHEN pt = 0 THEN coalesce(lag(surface_bad) OVER w, surface_bad) ELSE surface_bad END AS surface_bad,
    CASE WHEN pt = 0 THEN coalesce(lag(road_bad) OVER w, road_bad) ELSE road_bad END AS road_bad,
    CASE WHEN pt = 0 THEN coalesce(lag(grade) OVER w, grade) ELSE grade END AS grade
  FROM dense WINDOW w AS (PARTITION BY query_id ORDER BY seq, pt)
), ndk AS (SELECT *, coalesce({_hav("plat", "plon", "lat", "lon")} / 1000.0::DOUBLE, 0.0) AS leg_km FROM nd)"""


def _legs(mode: str) -> str:
    return f"""
, l_{mode} AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY run)::INTEGER AS leg FROM (
    SELECT query_id, run, min(seq) AS first_seq, max(seq) AS last_seq, arg_min(from_name, seq) FILTER (WHERE from_name IS NOT NULL OR TRUE) AS x,
      first(from_name ORDER BY seq) AS begin_name, last(to_name ORDER BY seq) AS end_name,
      first(from_elev ORDER BY seq) AS begin_elev, last(to_elev ORDER BY seq) AS end_elev
    FROM runs WHERE mode = '{mode}' GROUP BY 1, 2)
)"""


def _near(points: str, key: str, nodes: str, radius: float, most: int, id_name: str = "osmid") -> str:
    return f"""SELECT * FROM (
      SELECT p.{key}, o.{id_name} AS other, {_hav("p.lat", "p.lon", "o.lat", "o.lon")} AS distance_m
      FROM {points} p JOIN {nodes} o ON o.lat BETWEEN p.lat - {radius / 111_000.0!r} AND p.lat + {radius / 111_000.0!r})
      WHERE distance_m <= {radius} QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY round(distance_m, 6), other) <= {most}"""


def _labels(source: str) -> str:
    return f"""
, und AS MATERIALIZED (SELECT DISTINCT u, v FROM (SELECT from_node AS u, to_node AS v FROM {source} UNION ALL SELECT to_node, from_node FROM {source}))
, lab(u, l) USING KEY (u) AS (
  SELECT DISTINCT u, u FROM und
  UNION
  SELECT und.v, min(lab.l) FROM lab JOIN und ON und.u = lab.u JOIN recurring.lab x ON x.u = und.v WHERE lab.l < x.l GROUP BY und.v
)"""


_SLUG = "trim(regexp_replace(lower(trim({x})), '[^a-z0-9]+', '_', 'g'), '_')"


def _short(x: str) -> str:
    s = _SLUG.format(x=x)
    return f"""array_to_string(CASE WHEN length(split_part({s}, '_', 1)) > 3 THEN string_split({s}, '_')[1:1] ELSE string_split({s}, '_')[1:2] END, '_')"""


def _url(x: str) -> str:
    return f"replace({x}, ',', '%2C')"


_Z = "geometry_wkt IS NOT NULL"


def oracle_sql() -> dict[str, str]:
    w, rec = f"WITH {_BASE.strip()}", f"WITH RECURSIVE {_BASE.strip()}"
    h = rec + _HOPS
    zero = dict.fromkeys(K.PREFERENCES, 0.0)
    swept = ", ".join(f"('{n}', {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE, {f}::DOUBLE)" for n, a, b, c, d, f in SWEEP)
    sweep_cost = _cost({k: f"s.{k}" for k in K.PREFERENCES})
    cost = _cost(K.PREFERENCES)
    tile = "floor({} / 0.5)::INTEGER AS {}"
    tiles = f"{tile.format('lat', 'tile_row')}, {tile.format('lon', 'tile_col')}"
    bike_verts = f"""
, raw AS (
  SELECT row_id, unnest(string_split(regexp_extract(geometry_wkt, '\\(([^)]*)\\)', 1), ',')) AS v,
    generate_subscripts(string_split(regexp_extract(geometry_wkt, '\\(([^)]*)\\)', 1), ','), 1) AS k
  FROM e WHERE {_Z} AND mode = 'bike'
), pv AS (
  SELECT row_id, k, split_part(trim(v), ' ', 1)::DOUBLE AS lon, split_part(trim(v), ' ', 2)::DOUBLE AS lat,
    split_part(trim(v), ' ', 3)::DOUBLE AS z, count(*) OVER (PARTITION BY row_id) AS nv FROM raw
)"""
    cuts = f""", parts(row_id, a, b, cut) AS (
            SELECT row_id, 1::BIGINT, max(nv), NULL::BIGINT FROM pv WHERE nv >= 2 GROUP BY 1
            UNION ALL
            SELECT row_id, s.x.a, s.x.b, NULL FROM (
              SELECT p.row_id, unnest([struct_pack(a := p.a, b := arg_min(v.k, struct_pack(w := -v.off, k := v.k))), struct_pack(a := arg_min(v.k, struct_pack(w := -v.off, k := v.k)), b := p.b)]) AS x
              FROM parts p JOIN pv f ON f.row_id = p.row_id AND f.k = p.a JOIN pv t ON t.row_id = p.row_id AND t.k = p.b
              JOIN (SELECT row_id, k, z AS off, z FROM pv) v0 ON v0.row_id = p.row_id AND v0.k > p.a AND v0.k < p.b
              , LATERAL (SELECT v0.k AS k, greatest(least(f.z, t.z) - v0.z, v0.z - greatest(f.z, t.z)) AS off) v
              WHERE v.off > 2.0 GROUP BY p.row_id, p.a, p.b) s
          ), leaves AS (
            SELECT p.row_id, p.a, p.b FROM parts p WHERE NOT EXISTS (SELECT 1 FROM parts c WHERE c.row_id = p.row_id AND c.a = p.a AND c.b < p.b)
          ), seg AS (
            SELECT row_id, k, {_hav("lag(lat) OVER w", "lag(lon) OVER w", "lat", "lon")} AS d FROM pv WINDOW w AS (PARTITION BY row_id ORDER BY k))
"""
    mixed = "(floor((60.0::DOUBLE - lat) * 1000.0::DOUBLE)::INTEGER * 31 + floor((lon - 0.0::DOUBLE) * 1000.0::DOUBLE)::INTEGER * 17)"
    dem = f"CASE WHEN {mixed} % 50 = 0 THEN NULL ELSE ({mixed} % 1000)::DOUBLE / 10.0::DOUBLE END"
    named = "SELECT osmid, lat, lon, elevation_m, station_name FROM n WHERE node_type = 'rail' AND station_name IS NOT NULL"
    labelled = rec + "\n, bk AS (SELECT * FROM e WHERE mode = 'bike')" + _labels("bk")
    pair_len = """
, pl AS (
  SELECT least(from_node, to_node) AS a, greatest(from_node, to_node) AS b,
    arg_max(length_m, struct_pack(from_node, to_node, key)) AS len FROM bk GROUP BY 1, 2
), cs AS (
  SELECT l AS component, count(*) AS nodes FROM lab GROUP BY 1
), cl AS (
  SELECT lab.l AS component, round(sum(len::DECIMAL(20,4))::DOUBLE, 4) AS length_m FROM pl JOIN lab ON lab.u = pl.a GROUP BY 1
)"""
    merged = """
, mg AS MATERIALIZED (
  SELECT osmid, first(osmid) OVER (PARTITION BY round(lat, 4), round(lon, 4), node_type ORDER BY lat, lon, osmid) AS kept FROM n
)"""
    ids = ", ids AS (SELECT osmid, row_number() OVER (ORDER BY osmid) - 1 AS new_id FROM n)"
    stats = f"""SELECT s.query_id, {_r("bike_m / 1000.0::DOUBLE", 3)} AS bike_km, {_r("bike_s / 60.0::DOUBLE", 3)} AS bike_min,
      {_r("bike_up", 3)} AS bike_ascent_m, {_r("bike_down", 3)} AS bike_descent_m, {_r("total_m / 1000.0::DOUBLE", 3)} AS total_km,
      {_r("total_s / 60.0::DOUBLE", 3)} AS total_min, {_r("bike_up + other_up", 3)} AS total_ascent_m,
      {_r("bike_down + other_down", 3)} AS total_descent_m,
      coalesce((bike_m / 1000.0::DOUBLE) / nullif(bike_s / 3600.0::DOUBLE, 0.0) BETWEEN 5 - 1e-9 AND 25 + 1e-9, TRUE) AS plausible_speed
    FROM (SELECT query_id, coalesce(sum(length_m) FILTER (WHERE mode = 'bike'), 0.0) AS bike_m,
      coalesce(sum(leg_s) FILTER (WHERE mode = 'bike'), 0.0) AS bike_s, sum(length_m) AS total_m, sum(leg_s) AS total_s FROM h GROUP BY 1) s
    JOIN climb USING (query_id)"""
    unnamed = f"'{K.UNNAMED_STOP}'"
    return {
        "clean_nodes": w + " SELECT osmid, lat, lon, elevation_m, node_type, station_name FROM n",
        "clean_edges": w
        + f" SELECT row_id, from_node, to_node, key, mode, {_r('length_m')} AS length_m, {_r('height_diff_m')} AS height_diff_m FROM e",
        "tile_assign_nodes": w
        + f" SELECT osmid, {tiles}, 'tile_' || floor(lat / 0.5)::INTEGER || '_' || floor(lon / 0.5)::INTEGER AS tile FROM n",
        "tile_assign_edges": w
        + f" SELECT row_id, {tile.format('from_lat', 'tile_row')}, {tile.format('from_lon', 'tile_col')} FROM e",
        "tile_counts": w + f" SELECT {tiles}, node_type, count(*) AS n FROM n GROUP BY ALL",
        "tiled_store_round_trip": w
        + """ SELECT 'nodes' AS table_name, 'tile_' || floor(lat / 0.5)::INTEGER || '_' || floor(lon / 0.5)::INTEGER AS tile,
              osmid AS a, osmid AS b, 0::BIGINT AS key FROM n
            UNION ALL SELECT 'edges', 'tile_' || floor(from_lat / 0.5)::INTEGER || '_' || floor(from_lon / 0.5)::INTEGER, from_node, to_node, key FROM e""",
        "store_meta": w
        + f""" SELECT min(lon) AS west, min(lat) AS south, max(lon) AS east, max(lat) AS north, {K.TILE_DEG}::DOUBLE AS tile_deg,
            {K.MERGE_TOLERANCE_M}::DOUBLE AS tolerance_m, count(*) AS n_nodes,
            (SELECT count(*) FROM e) AS n_edges, count(*) FILTER (WHERE node_type = 'rail') AS n_stations FROM n""",
        "bbox_meta": w
        + """ SELECT min(lon) AS west, min(lat) AS south, max(lon) AS east, max(lat) AS north, count(*) AS n_nodes,
            (SELECT count(*) FROM e) AS n_edges, count(*) FILTER (WHERE node_type = 'rail') AS n_stations FROM n""",
        "edge_cost_default": w + f" SELECT row_id, {_r(cost)} AS cost FROM e",
        "edge_cost_zero_prefs": w + f" SELECT row_id, {_r(_cost(zero))} AS cost FROM e",
        "edge_cost_by_mode_sum": w + f" SELECT mode, count(*) AS n_edges, {_r(f'sum({cost})', 2)} AS cost FROM e GROUP BY 1",
        "edge_cost_param_sweep": w
        + f""", s(prefs, uphill, unpaved, main, rail, boarding) AS (VALUES {swept})
            SELECT prefs, mode, count(*) AS n_edges, {_r(f"sum({sweep_cost})", 2)} AS cost FROM e CROSS JOIN s GROUP BY 1, 2""",
        "min_collapse_parallel": w
        + f""" SELECT from_node, to_node, {_r("c")} AS cost, key FROM (SELECT *, {cost} AS c FROM e)
            QUALIFY row_number() OVER (PARTITION BY from_node, to_node ORDER BY c, key) = 1""",
        **{
            name: w
            + f""" SELECT {f}, count(*) AS n_edges, round(any_value(coalesce(v.w, {default!r}::DOUBLE)), 4) AS weight,
              any_value({_tier(f"coalesce(v.w, {default!r}::DOUBLE)")}) AS tier, {f} IS NULL OR any_value(v.tag) IS NOT NULL AS allowed
              FROM edges LEFT JOIN {v} v ON lower({f}) = v.tag WHERE mode = 'bike' GROUP BY {f}"""
            for name, f, v, default in (
                ("tag_surface_weight_tier", "surface", "sw", K.SURFACE_UNTAGGED),
                ("tag_road_weight_tier", "highway", "rw", K.ROAD_UNTAGGED),
            )
        },
        "edge_speed_and_classes": w
        + _SPEED
        + f""" SELECT row_id, mode, {_r("grade")} AS grade, {_r("kmh")} AS kmh, {_r("leg_s")} AS seconds, {_GRADE} AS grade_class,
            {_CONDITION} AS condition_class, {_r(_WIDTH)} AS ribbon_m FROM es""",
        "route_queries": w + _TRIPS + " SELECT query_id, source, target FROM trips",
        "trip_guards": w + _TRIPS + f" SELECT query_id, {_r('km', 6)} AS trip_km, {_verdict(K.MIN_TRIP_KM)} AS verdict FROM trips, bx",
        "route_verdicts": rec
        + _ROUTE
        + f""" SELECT t.query_id, coalesce({_verdict(K.MIN_TRIP_KM)}, 'ok') AS specified,
            coalesce({_verdict(SHORTEST_KM)}, CASE WHEN c.cost IS NULL THEN 'no_route' ELSE 'ok' END) AS outcome, {_r("c.cost")} AS cost
            FROM trips t CROSS JOIN bx LEFT JOIN (SELECT query_id, max(reached) AS cost FROM path GROUP BY 1) c USING (query_id)""",
        "view_state": w
        + _QUERIES
        + f""" SELECT query_id, {_r("(lat_a + lat_b) / 2", 7)} AS mid_lat, {_r("(lon_a + lon_b) / 2", 7)} AS mid_lon,
            {_r(f'''greatest(7.0::DOUBLE, least(14.0::DOUBLE, 11.0::DOUBLE + log2(8000.0::DOUBLE / {_hav("lat_a", "lon_a", "lat_b", "lon_b")})))''', 7)} AS zoom FROM q""",
        "corridor_nodes_bike": w + _QUERIES + _TUBES + " SELECT * FROM tb",
        "corridor_nodes_rail": w + _QUERIES + _TUBES + " SELECT * FROM tr",
        "corridor_edges_combined": w + _CORRIDOR + " SELECT query_id, mode, count(*) AS n_edges FROM ce GROUP BY ALL",
        **{
            f"snap_nearest_{name}": w
            + f" SELECT place_key, other AS osmid, {_r('distance_m')} AS distance_m FROM ("
            + _near("(SELECT * FROM gazetteer WHERE lat IS NOT NULL AND lon IS NOT NULL)", "place_key", nodes, 20_100_000.0, 1)
            + ")"
            for name, nodes in (("any", "n"), ("bike", "(SELECT * FROM n WHERE node_type = 'bike')"))
        },
        "nearest_place": w
        + f" SELECT station, other AS place_key, g.name, {_r('distance_m')} AS distance_m FROM ("
        + _near(f"(SELECT osmid AS station, lat, lon FROM ({named}))", "station", "gazetteer", 10_000.0, 1, "place_key")
        + ") x JOIN gazetteer g ON g.place_key = x.other",
        "route_shortest_cost": rec + _ROUTE + f" SELECT query_id, {_r('max(reached)')} AS cost, count(*) AS n_nodes FROM path GROUP BY 1",
        "route_path_nodes": rec + _ROUTE + f" SELECT query_id, seq, osmid, {_r('reached')} AS reached FROM path",
        "route_one_to_all_cost": rec
        + f""", cc AS MATERIALIZED (SELECT from_node, to_node, min({cost}) AS cost FROM e GROUP BY ALL)
          , reach(query_id, node, cost) USING KEY (query_id, node) AS (
            SELECT region_key, min(osmid), 0.0::DOUBLE FROM n WHERE node_type = 'bike' GROUP BY 1
            UNION
            SELECT r.query_id, c.to_node, min(r.cost + c.cost) FROM reach r JOIN cc c ON c.from_node = r.node
            LEFT JOIN recurring.reach x ON x.query_id = r.query_id AND x.node = c.to_node
            WHERE x.cost IS NULL OR r.cost + c.cost < x.cost GROUP BY r.query_id, c.to_node)
          SELECT query_id, node AS osmid, {_r("cost")} AS reached FROM reach""",
        "path_edges_cheapest": h + f" SELECT query_id, seq, from_node, to_node, key, mode, {_r('cost')} AS cost FROM h",
        "track_points": h
        + f""" SELECT query_id, seq, {_r("lat", 6)} AS lat, {_r("lon", 6)} AS lon, {_r("elevation_m", 6)} AS elevation_m,
            {_r("elapsed_s", 6)} AS elapsed_s, mode, surface_bad, road_bad, {_r("grade", 6)} AS grade, {_r("kmh", 6)} AS kmh FROM pts""",
        "track_cumulative_km": h
        + f""" SELECT query_id, seq, {_r("leg_km", 6)} AS leg_km,
            {_r("sum(leg_km) OVER (PARTITION BY query_id ORDER BY seq)", 6)} AS km FROM kms""",
        "track_stats": h + _VERTS + _CLIMB + " " + stats,
        "windowed_climb": h
        + _VERTS
        + _CLIMB
        + f""" SELECT query_id, {_r("bike_up", 3)} AS bike_up, {_r("bike_down", 3)} AS bike_down,
            {_r("other_up", 3)} AS other_up, {_r("other_down", 3)} AS other_down FROM climb""",
        "mode_runs": h + " SELECT query_id, seq, mode, run FROM runs",
        "leg_lines": h
        + _legs("bike")
        + _legs("rail")
        + f""" SELECT l.query_id, l.leg, 'Bike Route ' || l.leg || ': ' ||
              CASE WHEN first_seq = 1 THEN 'start of ' || l.query_id ELSE coalesce(b.from_name, {unnamed}) END || ' → ' ||
              CASE WHEN last_seq = m.last THEN 'end of ' || l.query_id ELSE coalesce(a.to_name, {unnamed}) END AS line
            FROM l_bike l JOIN (SELECT query_id, max(seq) AS last FROM h GROUP BY 1) m USING (query_id)
            LEFT JOIN h b ON b.query_id = l.query_id AND b.seq = l.first_seq - 1
            LEFT JOIN h a ON a.query_id = l.query_id AND a.seq = l.last_seq + 1
            UNION ALL SELECT query_id, leg, 'Train ' || leg || ': ' || coalesce(begin_name, {unnamed}) || ' → ' || coalesce(end_name, {unnamed}) FROM l_rail""",
        "rail_leg_tooltips": h
        + _legs("rail")
        + f""" SELECT query_id, leg, printf('Train: %s (%.0f m) → %s (%.0f m)', coalesce(begin_name, {unnamed}), begin_elev,
            coalesce(end_name, {unnamed}), end_elev) AS tooltip FROM l_rail""",
        "densified_track": h
        + _VERTS
        + _DENSE
        + f""" SELECT query_id, seq, pt, {_r("lat", 6)} AS lat, {_r("lon", 6)} AS lon, {_r("elevation_m", 6)} AS elevation_m,
            {_r("elapsed_s", 6)} AS elapsed_s, mode, surface_bad, road_bad, {_r("grade", 6)} AS grade, {_r("kmh", 6)} AS kmh FROM dense""",
        "composition_long": h + _composed("kms") + f" SELECT query_id, dimension, label, ord, {_r('km', 6)} AS km FROM composed",
        "composition_pct": h
        + _VERTS
        + _DENSE
        + _NUMBERED
        + _composed("ndk")
        + f""" SELECT query_id, dimension, label,
            {_r("km / nullif(sum(km) OVER (PARTITION BY query_id, dimension), 0.0) * 100.0::DOUBLE", 3)} AS pct FROM composed""",
        "profile_runs": h
        + f""", pr AS (SELECT *, sum(leg_km) OVER w AS km, lag(elevation_m) OVER w AS pe,
              coalesce(sum(leg_km) OVER (PARTITION BY query_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS pk
              FROM kms WINDOW w AS (PARTITION BY query_id ORDER BY seq))
          , p1 AS (SELECT *, CASE WHEN mode = lag(mode) OVER (PARTITION BY query_id ORDER BY seq) THEN 0 ELSE 1 END AS new FROM pr WHERE seq > 0)
          , p2 AS (SELECT *, sum(new) OVER (PARTITION BY query_id ORDER BY seq)::INTEGER AS run FROM p1)
          SELECT query_id, run, mode, {_r("min(pk)", 5)} AS from_km, {_r("max(km)", 5)} AS to_km,
            {_r("min(least(elevation_m, pe))", 5)} AS low_m, {_r("max(greatest(elevation_m, pe))", 5)} AS high_m FROM p2 GROUP BY 1, 2, 3""",
        "gpx_points": h
        + """ SELECT query_id, seq, printf('<trkpt lat="%.6f" lon="%.6f"><ele>%.1f</ele><time>%s</time></trkpt>', lat, lon, elevation_m,
            strftime(TIMESTAMP '2024-06-01 08:00:00' + to_microseconds(trunc(elapsed_s * 1e6::DOUBLE)::BIGINT), '%Y-%m-%dT%H:%M:%SZ')) AS trkpt FROM pts""",
        "gpx_documents": h
        + """ SELECT query_id, '<?xml version="1.0" encoding="UTF-8"?>\n<gpx xmlns="http://www.topografix.com/GPX/1/1" version="1.1" creator="railspoke">\n<trk><name>'
            || query_id || '</name><trkseg>\n' || string_agg(printf('<trkpt lat="%.6f" lon="%.6f"><ele>%.1f</ele><time>%s</time></trkpt>', lat, lon, elevation_m,
            strftime(TIMESTAMP '2024-06-01 08:00:00' + to_microseconds(trunc(elapsed_s * 1e6::DOUBLE)::BIGINT), '%Y-%m-%dT%H:%M:%SZ')), '\n' ORDER BY seq)
            || '\n</trkseg></trk>\n</gpx>\n' AS gpx FROM pts GROUP BY query_id""",
        "sub_paths": rec + _ROUTE + " SELECT query_id, seq - 1 AS seq, osmid FROM path WHERE seq BETWEEN 1 AND 4",
        "markers_on_track": h
        + f""", mk AS (SELECT *, lag(mode) OVER w AS mb, lead(mode) OVER w AS ma FROM h WINDOW w AS (PARTITION BY query_id ORDER BY seq)
          ), ms AS (SELECT query_id, 'from/' || seq AS marker, from_lat AS lat, from_lon AS lon FROM mk WHERE mode = 'rail' AND (mb IS NULL OR mb <> 'rail')
            UNION ALL SELECT query_id, 'to/' || seq, to_lat, to_lon FROM mk WHERE mode = 'rail' AND (ma IS NULL OR ma <> 'rail')
          ), ck AS (SELECT *, sum(leg_km) OVER (PARTITION BY query_id ORDER BY seq) AS km FROM kms)
          SELECT m.query_id, marker, {_r("km", 5)} AS km, {_r("elevation_m", 5)} AS elevation_m FROM ms m JOIN ck c ON c.query_id = m.query_id
          QUALIFY row_number() OVER (PARTITION BY m.query_id, marker ORDER BY round({_hav("m.lat", "m.lon", "c.lat", "c.lon")}, 6), seq) = 1""",
        "trip_reports": h
        + _VERTS
        + _CLIMB
        + _composed("kms")
        + _legs("bike")
        + _legs("rail")
        + f""", stt AS ({stats}), fmt AS (
            SELECT query_id, printf('%.1f km · %.0f min · +%.0f m / −%.0f m', round(total_km, 1), round_even(total_min, 0), round_even(total_ascent_m, 0), round_even(total_descent_m, 0)) AS total,
              printf('%.1f km · %.0f min · +%.0f m / −%.0f m', round(bike_km, 1), round_even(bike_min, 0), round_even(bike_ascent_m, 0), round_even(bike_descent_m, 0)) AS bike FROM stt
          ), pc AS (SELECT query_id, dimension, ord, printf('  %s: %.0f%%', label, round_even(km / nullif(sum(km) OVER (PARTITION BY query_id, dimension), 0.0) * 100.0::DOUBLE, 0)) AS line FROM composed
          ), pd AS (SELECT query_id, dimension || ':\n' || string_agg(line, '\n' ORDER BY ord) AS t, CASE dimension WHEN 'Quality' THEN 0 WHEN 'Grade' THEN 1 ELSE 2 END AS d FROM pc GROUP BY query_id, dimension
          ), pt AS (SELECT query_id, string_agg(t, '\n' ORDER BY d) AS parts FROM pd GROUP BY 1
          ), rl AS (SELECT query_id, string_agg('  Train ' || leg || ': ' || coalesce(begin_name, {unnamed}) || ' → ' || coalesce(end_name, {unnamed}), '\n' ORDER BY leg) AS rails FROM l_rail GROUP BY 1
          ), bl AS (SELECT l.query_id, string_agg('  Bike Route ' || l.leg || ': ' || CASE WHEN first_seq = 1 THEN 'start of ' || l.query_id ELSE coalesce(b.from_name, {unnamed}) END || ' → ' ||
              CASE WHEN last_seq = m.last THEN 'end of ' || l.query_id ELSE coalesce(a.to_name, {unnamed}) END, '\n' ORDER BY l.leg) AS bikes
            FROM l_bike l JOIN (SELECT query_id, max(seq) AS last FROM h GROUP BY 1) m USING (query_id)
            LEFT JOIN h b ON b.query_id = l.query_id AND b.seq = l.first_seq - 1 LEFT JOIN h a ON a.query_id = l.query_id AND a.seq = l.last_seq + 1 GROUP BY 1)
          SELECT query_id, concat_ws('\n', 'Total (bike + train): ' || total, 'Bike only:            ' || bike, parts, 'Trains to catch:\n' || rails, 'Bike legs:\n' || bikes) AS report
          FROM fmt JOIN pt USING (query_id) LEFT JOIN rl USING (query_id) LEFT JOIN bl USING (query_id)""",
        "geocode_places": w
        + f""", m AS (SELECT (min(lat) + max(lat)) / 2 AS m_lat, (min(lon) + max(lon)) / 2 AS m_lon FROM n
          ), tx AS (SELECT place_key AS id, name, lat, lon, (length(place_key) + ascii(place_key[-1])) % 5 AS k FROM gazetteer
          ), tt AS (SELECT *, CASE k WHEN 0 THEN upper(name) WHEN 1 THEN '  ' || name || ' ' WHEN 2 THEN printf('%.5f, %.5f', round(lat, 5), round(lon, 5)) || coalesce(' (' || nullif(trim(name), '') || ')', '')
            WHEN 3 THEN '  ' ELSE name || ' xyz' END AS text FROM tx
          ), bp AS (SELECT lower(trim(name)) AS nm, lat, lon, name FROM gazetteer, m WHERE name IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL
            QUALIFY row_number() OVER (PARTITION BY lower(trim(name)) ORDER BY round({_hav("lat", "lon", "m_lat", "m_lon")}, 3), place_key) = 1)
          SELECT id, {_r("CASE WHEN k = 2 THEN round(tt.lat, 5) ELSE bp.lat END", 5)} AS lat, {_r("CASE WHEN k = 2 THEN round(tt.lon, 5) ELSE bp.lon END", 5)} AS lon,
            CASE WHEN k = 2 THEN nullif(trim(tt.name), '') ELSE bp.name END AS label,
            CASE WHEN trim(coalesce(text, '')) = '' THEN 'empty' WHEN k = 2 THEN 'literal' WHEN bp.nm IS NOT NULL THEN 'place' ELSE 'not_found' END AS status
          FROM tt LEFT JOIN bp ON k <> 2 AND bp.nm = lower(trim(text))""",
        "station_suggestions": w
        + f""", m AS (SELECT (min(lat) + max(lat)) / 2 AS m_lat, (min(lon) + max(lon)) / 2 AS m_lon FROM n
          ), st AS ({named}), tm AS (SELECT DISTINCT lower(trim(t)) AS term FROM (SELECT station_name[1:2] AS t FROM st UNION ALL SELECT station_name[1:4] FROM st) WHERE trim(t) <> ''
          ), sb AS (SELECT term, osmid, station_name AS name, lat, lon FROM tm JOIN st ON starts_with(lower(trim(station_name)), term), m
            QUALIFY row_number() OVER (PARTITION BY term ORDER BY round({_hav("lat", "lon", "m_lat", "m_lon")}, 3), osmid) = 1
          ), pb AS (SELECT term, name, kind, row_number() OVER (PARTITION BY term ORDER BY round({_hav("lat", "lon", "m_lat", "m_lon")}, 3), place_key)::INTEGER AS rank
            FROM tm JOIN gazetteer ON starts_with(lower(trim(name)), term), m WHERE lat IS NOT NULL AND lon IS NOT NULL)
          SELECT term, 0 AS rank, printf('%.5f, %.5f', round(lat, 5), round(lon, 5)) || ' (' || trim(name) || CASE WHEN ends_with(lower(trim(name)), 'bahnhof') THEN '' ELSE ' Bahnhof' END || ')' AS suggestion FROM sb
          UNION ALL SELECT term, rank, concat_ws(', ', nullif(trim(name), ''), CASE WHEN trim(kind) <> trim(name) THEN nullif(trim(kind), '') END) FROM pb WHERE rank <= 3""",
        "place_labels": w
        + f""", st AS ({named}) SELECT osmid::VARCHAR AS id, trim(station_name) || CASE WHEN ends_with(lower(trim(station_name)), 'bahnhof') THEN '' ELSE ' Bahnhof' END AS label FROM st
          UNION ALL SELECT region_key, string_split(extract_path, '/')[-1] FROM build_regions""",
        "condition_colours": w
        + _SPEED
        + f""", cc AS (SELECT {_CONDITION} AS condition FROM es), cn AS (SELECT condition, count(*) AS n_edges FROM cc GROUP BY 1)
          SELECT condition, n_edges, '#' || hx AS colour, ('0x' || hx[1:2])::INTEGER AS red, ('0x' || hx[3:4])::INTEGER AS green, ('0x' || hx[5:6])::INTEGER AS blue
          FROM (SELECT *, CASE condition WHEN 'train' THEN '9600c8' WHEN 'good' THEN '1565c0' WHEN 'unpaved' THEN 'ef7f18' ELSE 'c80d29' END AS hx FROM cn)""",
        "overview_cells": w
        + f""" SELECT mode, floor(from_lat / 0.1::DOUBLE)::BIGINT AS row, floor(from_lon / 0.1::DOUBLE)::BIGINT AS col, count(*) AS edges, {_r("sum(length_m) / 1000.0::DOUBLE", 5)} AS km FROM e GROUP BY 1, 2, 3""",
        "maps_url": w
        + _QUERIES
        + f""" SELECT query_id, '{K.GMAPS_BASE}&origin=' || {_url("printf('%.6f,%.6f', lat_a, lon_a)")} || '&destination=' ||
            {_url("printf('%.6f,%.6f', lat_b, lon_b)")} || '&travelmode=bicycling' AS url FROM q""",
        "output_names": f"""SELECT place_key, {_SLUG.format(x="name")} AS slug,
            {_short("name")} || '__to__' || {_short("name || ', Landkreis'")} || '__{params_token()}' AS stem FROM gazetteer""",
        "parse_latlon_literals": """WITH t AS (SELECT place_key, kind, name, lat, CASE WHEN kind = 'hamlet' THEN lon + 400.0 ELSE lon END AS lon,
              CASE WHEN kind IS NULL THEN name ELSE printf('%.4f, %.4f (%s)', lat, CASE WHEN kind = 'hamlet' THEN lon + 400.0 ELSE lon END, name) END AS text FROM gazetteer)
            SELECT place_key, text, CASE WHEN kind <> 'hamlet' THEN printf('%.4f', lat)::DOUBLE END AS lat,
              CASE WHEN kind <> 'hamlet' THEN printf('%.4f', lon)::DOUBLE END AS lon, CASE WHEN kind <> 'hamlet' THEN name END AS label FROM t""",
        "autocomplete_prefix": w
        + f""", m AS (SELECT (min(lat) + max(lat)) / 2 AS m_lat, (min(lon) + max(lon)) / 2 AS m_lon FROM n)
            SELECT place_key, name, prefix, {_r("d", 3)} AS distance_m, rank FROM (
              SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY round(d, 3), place_key)::INTEGER AS rank FROM (
                SELECT place_key, name, lower(name[1:2]) AS prefix, {_hav("lat", "lon", "m_lat", "m_lon")} AS d
                FROM gazetteer, m WHERE name IS NOT NULL AND lat IS NOT NULL)) WHERE rank <= 5""",
        "station_entrances": w
        + f" SELECT osmid AS station, other AS osmid, {_r('distance_m')} AS distance_m, (row_number() OVER (PARTITION BY station ORDER BY round(x.distance_m, 6), other))::INTEGER AS rank FROM ("
        + _near("(SELECT * FROM n WHERE node_type = 'rail')", "osmid", "(SELECT * FROM n WHERE node_type = 'bike')", 200.0, 5)
        + ") x",
        "station_wiring": w
        + f", x AS ({_near(f'({named})', 'osmid', '''(SELECT * FROM n WHERE node_type = 'bike')''', 200.0, 5)})"
        + f""" SELECT osmid AS from_node, other AS to_node, 0::BIGINT AS key, {_r("distance_m")} AS length_m, 'station' AS mode FROM x
            UNION ALL SELECT other, osmid, 0, {_r("distance_m")}, 'station' FROM x""",
        "top_stations": w
        + f""", s AS ({named}), d AS (
              SELECT a.osmid, max(b.elevation_m) AS hi, min(b.elevation_m) AS lo FROM s a JOIN s b ON b.lat BETWEEN a.lat - 0.1 AND a.lat + 0.1
              WHERE {_hav("a.lat", "a.lon", "b.lat", "b.lon")} <= 10000 GROUP BY 1)
            SELECT osmid, station_name, {_r("elevation_m")} AS elevation_m, {_r("hi")} AS highest_m, {_r("lo")} AS lowest_m
            FROM s JOIN d USING (osmid) WHERE elevation_m >= hi AND elevation_m - lo >= 100""",
        "allowlist_filter": w
        + """, k AS (SELECT * FROM e WHERE allowed) SELECT 'edge' AS kind, row_id AS id FROM k
            UNION ALL SELECT 'node', osmid FROM n WHERE osmid IN (SELECT from_node FROM k UNION ALL SELECT to_node FROM k)""",
        "dedup_nodes": w + merged + " SELECT * FROM mg",
        "dedup_edges": w
        + merged
        + """, rp AS (SELECT a.kept AS f, b.kept AS t, e.mode, e.key, e.length_m, e.height_diff_m, e.surface, e.highway, e.row_id, coalesce(geometry_wkt, '') AS g
              FROM e JOIN mg a ON e.from_node = a.osmid JOIN mg b ON e.to_node = b.osmid)
            , dd AS (SELECT * FROM rp WHERE NOT (mode = 'bike' AND f = t)
              QUALIFY row_number() OVER (PARTITION BY f, t, mode, g ORDER BY key, length_m, height_diff_m NULLS FIRST, surface NULLS FIRST, highway NULLS FIRST, row_id) = 1)
            SELECT f AS from_node, t AS to_node, row_number() OVER (PARTITION BY f, t ORDER BY mode, key, g) - 1 AS key, mode, g AS geometry_wkt, row_id FROM dd""",
        "reid_contiguous": w + ids + " SELECT * FROM ids",
        "reid_edges": w
        + ids
        + " SELECT row_id, a.new_id AS from_node, b.new_id AS to_node FROM e JOIN ids a ON a.osmid = from_node JOIN ids b ON b.osmid = to_node",
        "combine_offsets": w
        + """ SELECT region_key, nodes, coalesce(sum(nodes) OVER (ORDER BY region_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first_id
            FROM (SELECT region_key, count(*) AS nodes FROM n GROUP BY 1)""",
        "ribbon_runs": h
        + f""", lk AS (
            SELECT query_id, seq, CASE {_CONDITION} WHEN 'train' THEN '#9600c8' WHEN 'good' THEN '#1565c0' WHEN 'unpaved' THEN '#ef7f18' ELSE '#c80d29' END AS colour,
              round({_WIDTH}, 4) AS width_m, CASE WHEN mode = 'rail' THEN 'Train' ELSE concat_ws(' · ',
                CASE WHEN surface_bad THEN 'unpaved path' ELSE 'paved road' END, CASE WHEN road_bad THEN 'main road' ELSE 'quiet way' END,
                printf('%+.0f%% %s', round_even(grade * 100.0::DOUBLE, 0) + 0.0::DOUBLE, CASE WHEN grade * 100.0::DOUBLE > 0.5 THEN 'uphill' WHEN grade * 100.0::DOUBLE < -0.5 THEN 'downhill' ELSE 'flat' END),
                printf('~%.0f km/h', round_even(kmh, 0)), printf('%.0f m', round_even(elevation_m, 0))) END AS tooltip
            FROM pts WHERE seq > 0
          ), lr AS (SELECT *, sum(new) OVER (PARTITION BY query_id ORDER BY seq)::INTEGER AS run FROM (
            SELECT *, CASE WHEN lag(seq) OVER w IS NOT NULL AND colour IS NOT DISTINCT FROM lag(colour) OVER w AND width_m IS NOT DISTINCT FROM lag(width_m) OVER w
              AND tooltip IS NOT DISTINCT FROM lag(tooltip) OVER w THEN 0 ELSE 1 END AS new FROM lk WINDOW w AS (PARTITION BY query_id ORDER BY seq)))
          SELECT query_id, run, colour, width_m, tooltip, min(seq) - 1 AS first_seq, max(seq) AS last_seq FROM lr GROUP BY 1, 2, 3, 4, 5""",
        "station_nearest_track": w
        + f""", st AS ({named}), ln AS (SELECT DISTINCT from_node, to_node, from_lat, from_lon, to_lat, to_lon FROM e WHERE mode = 'rail'
          ), xy AS (
            SELECT st.osmid AS station, from_node, to_node,
              (from_lon - lon) * cos(radians(lat)) * {K.METRES_PER_DEGREE}::DOUBLE AS pax, (from_lat - lat) * {K.METRES_PER_DEGREE}::DOUBLE AS pay,
              (to_lon - lon) * cos(radians(lat)) * {K.METRES_PER_DEGREE}::DOUBLE AS pbx, (to_lat - lat) * {K.METRES_PER_DEGREE}::DOUBLE AS pby
            FROM st JOIN ln ON lat BETWEEN least(from_lat, to_lat) - 0.002 AND greatest(from_lat, to_lat) + 0.002
          ), tt AS (
            SELECT *, CASE WHEN (pbx - pax) * (pbx - pax) + (pby - pay) * (pby - pay) > 0 THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE,
              -(pax * (pbx - pax) + pay * (pby - pay)) / ((pbx - pax) * (pbx - pax) + (pby - pay) * (pby - pay)))) ELSE 0.0::DOUBLE END AS t FROM xy
          ), off AS (SELECT *, sqrt(pow(pax + t * (pbx - pax), 2) + pow(pay + t * (pby - pay), 2)) AS distance_m FROM tt)
          SELECT station, from_node, to_node, {_r("distance_m", 3)} AS distance_m, CASE WHEN pax * pax + pay * pay <= pbx * pbx + pby * pby THEN from_node ELSE to_node END AS node
          FROM off WHERE distance_m <= {K.STATION_RADIUS_M} QUALIFY row_number() OVER (PARTITION BY station ORDER BY round(distance_m, 6), from_node, to_node) = 1""",
        "densify_edges": w
        + bike_verts
        + f""", st AS (
            SELECT *, floor({_hav("lat", "lon", "lat1", "lon1")} / {0.9 * K.MAX_VERTEX_GAP_M!r}::DOUBLE)::INTEGER + 1 AS steps FROM (
              SELECT *, lead(lat) OVER w AS lat1, lead(lon) OVER w AS lon1, lead(z) OVER w AS z1 FROM pv WHERE nv >= 2 WINDOW w AS (PARTITION BY row_id ORDER BY k))
          ), ins AS (
            SELECT row_id, lon, lat, z, lon1, lat1, z1, steps, unnest(generate_series(0, steps - 1)) AS i FROM st WHERE lat1 IS NOT NULL
          ), al AS (
            SELECT row_id, lon + (lon1 - lon) * i / steps AS lon, lat + (lat1 - lat) * i / steps AS lat, z + (z1 - z) * i / steps AS z FROM ins
            UNION ALL SELECT row_id, lon, lat, z FROM st WHERE lat1 IS NULL)
          SELECT row_id, count(*)::INTEGER AS n_vertices, {_r("sum(lon) * 0.7310585786::DOUBLE", 6)} AS sum_lon, {_r("sum(lat) * 0.7310585786::DOUBLE", 6)} AS sum_lat, {_r("sum(z) * 0.7310585786::DOUBLE", 4)} AS sum_z FROM al GROUP BY 1""",
        "wkt_text": w + f" SELECT row_id, geometry_wkt AS wkt FROM e WHERE {_Z}",
        "split_edges_extrema": rec + bike_verts + cuts
        + f""" SELECT row_id, (row_number() OVER (PARTITION BY row_id ORDER BY a) - 1)::INTEGER AS part, (b - a + 1)::INTEGER AS n_vertices,
            (SELECT {_r("sum(d)", 3)} FROM seg s WHERE s.row_id = l.row_id AND s.k > l.a AND s.k <= l.b) AS length_m FROM leaves l""",
        "split_graph": rec + bike_verts + cuts
        + f""", sp AS (SELECT DISTINCT round(v.lat, 6) AS lat, round(v.lon, 6) AS lon FROM leaves l JOIN pv v ON v.row_id = l.row_id AND v.k = l.a WHERE l.a > 1
          ), sid AS (SELECT lat, lon, (SELECT max(osmid) FROM n) + row_number() OVER (ORDER BY lat, lon) AS osmid FROM sp
          ), pe AS (
            SELECT l.*, coalesce(x.osmid, e.from_node) AS f, coalesce(y.osmid, e.to_node) AS t, e.length_m AS old, va.nv
            FROM leaves l JOIN e ON e.row_id = l.row_id JOIN pv va ON va.row_id = l.row_id AND va.k = l.a JOIN pv vb ON vb.row_id = l.row_id AND vb.k = l.b
            LEFT JOIN sid x ON l.a > 1 AND x.lat = round(va.lat, 6) AND x.lon = round(va.lon, 6)
            LEFT JOIN sid y ON l.b < va.nv AND y.lat = round(vb.lat, 6) AND y.lon = round(vb.lon, 6))
          SELECT 'node' AS kind, osmid AS a, 0::BIGINT AS b, 0.0::DOUBLE AS length_m FROM n UNION ALL SELECT 'node', osmid, 0, 0.0 FROM sid
          UNION ALL SELECT 'edge bike', f, t, CASE WHEN a = 1 AND b = nv THEN {_r("old", 3)}
            ELSE (SELECT {_r("sum(d)", 3)} FROM seg s WHERE s.row_id = pe.row_id AND s.k > pe.a AND s.k <= pe.b) END FROM pe
          UNION ALL SELECT 'edge ' || mode, from_node, to_node, {_r("length_m", 3)} FROM e WHERE row_id NOT IN (SELECT row_id FROM leaves)""",
        "baked_vertices": w
        + f""", raw AS (
            SELECT row_id, unnest(string_split(regexp_extract(geometry_wkt, '\\(([^)]*)\\)', 1), ',')) AS v,
              generate_subscripts(string_split(regexp_extract(geometry_wkt, '\\(([^)]*)\\)', 1), ','), 1) AS k FROM e WHERE {_Z}
          ), bv AS (SELECT row_id, k, split_part(trim(v), ' ', 1)::DOUBLE AS lon, split_part(trim(v), ' ', 2)::DOUBLE AS lat FROM raw
          ), bz AS (SELECT *, {dem} AS z FROM bv
          ), bw AS (SELECT row_id, 'LINESTRING Z (' || string_agg(printf('%.6f %.6f %.1f', lon, lat, coalesce(z, (SELECT avg(z) FROM bz))), ', ' ORDER BY k) || ')' AS wkt FROM bz GROUP BY 1
          ), nz0 AS (SELECT osmid, {dem} AS z FROM n), nz AS (SELECT osmid, coalesce(z, (SELECT avg(z) FROM nz0)) AS z FROM nz0)
          SELECT e.row_id, {_r("b.z - a.z")} AS height_diff_m, coalesce(wkt, '') AS wkt FROM e JOIN nz a ON a.osmid = from_node JOIN nz b ON b.osmid = to_node LEFT JOIN bw USING (row_id)""",
        "regions_united": w
        + """, ids AS (SELECT osmid, row_number() OVER (ORDER BY region_key, osmid) - 1 AS new_id FROM n)
          SELECT 'node' AS kind, new_id AS a, 0::BIGINT AS b, 0::BIGINT AS row_id FROM ids
          UNION ALL SELECT 'edge', a.new_id, b.new_id, row_id FROM e JOIN ids a ON a.osmid = from_node JOIN ids b ON b.osmid = to_node""",
        "composed_graphs": w
        + """, sh AS (SELECT (SELECT max(osmid) FROM n WHERE node_type = 'bike') + 1 - (SELECT min(osmid) FROM n WHERE node_type = 'rail') AS d)
          SELECT 'node' AS kind, osmid + CASE node_type WHEN 'rail' THEN d ELSE 0 END AS a, 0::BIGINT AS b FROM n, sh
          UNION ALL SELECT 'edge', from_node + CASE mode WHEN 'rail' THEN d ELSE 0 END, to_node + CASE mode WHEN 'rail' THEN d ELSE 0 END FROM e, sh WHERE mode IN ('bike', 'rail')""",
        "clipped_ways": w
        + f""", ins AS (SELECT osmid FROM n WHERE lon BETWEEN {CLIP[0]} AND {CLIP[2]} AND lat BETWEEN {CLIP[1]} AND {CLIP[3]}
          ), ew AS (SELECT e.*, o.way_id FROM e JOIN edges o USING (row_id)
          ), hit AS (SELECT * FROM ew WHERE from_node IN (SELECT osmid FROM ins) OR to_node IN (SELECT osmid FROM ins)
          ), kept AS (SELECT row_id, from_node, to_node FROM ew WHERE way_id IN (SELECT way_id FROM hit WHERE way_id IS NOT NULL)
            UNION ALL SELECT row_id, from_node, to_node FROM hit WHERE way_id IS NULL)
          SELECT 'edge' AS kind, row_id AS id FROM kept
          UNION ALL SELECT 'node', osmid FROM n WHERE osmid IN (SELECT from_node FROM kept UNION ALL SELECT to_node FROM kept)""",
        "raster_bounds": w
        + f""", rc AS (SELECT floor((60.0::DOUBLE - lat) * 1000.0::DOUBLE)::INTEGER AS r, floor(lon * 1000.0::DOUBLE)::INTEGER AS c FROM n)
          SELECT {_r("min(c) / 1000.0::DOUBLE")} AS west, {_r("60.0::DOUBLE - (max(r) + 1) / 1000.0::DOUBLE")} AS south,
            {_r("(max(c) + 1) / 1000.0::DOUBLE")} AS east, {_r("60.0::DOUBLE - min(r) / 1000.0::DOUBLE")} AS north FROM rc""",
        "consolidate_nodes": rec
        + f""", bn AS MATERIALIZED (SELECT osmid, lat, lon FROM n WHERE node_type = 'bike'
          ), lk AS MATERIALIZED (SELECT a.osmid AS from_node, b.osmid AS to_node FROM bn a JOIN bn b ON b.lat BETWEEN a.lat - 0.0005 AND a.lat + 0.0005 AND a.osmid < b.osmid
            WHERE {_hav("a.lat", "a.lon", "b.lat", "b.lon")} <= {2 * K.MERGE_TOLERANCE_M})"""
        + _labels("lk")
        + f""", cl AS (SELECT bn.*, coalesce(lab.l, osmid) AS cluster FROM bn LEFT JOIN lab ON lab.u = osmid
          ), mid AS (SELECT cluster, sum(lat::DECIMAL(12,8))::DOUBLE / count(*) AS c_lat, sum(lon::DECIMAL(12,8))::DOUBLE / count(*) AS c_lon, count(*) AS members FROM cl GROUP BY 1)
          SELECT osmid, cluster, {_r("c_lat", 8)} AS lat, {_r("c_lon", 8)} AS lon, members FROM cl JOIN mid USING (cluster)""",
        "contracted_edges": rec
        + """, und2 AS MATERIALIZED (SELECT DISTINCT u, v FROM (SELECT from_node AS u, to_node AS v FROM e WHERE mode = 'bike' AND from_node <> to_node
              UNION ALL SELECT to_node, from_node FROM e WHERE mode = 'bike' AND from_node <> to_node))
          , inn AS MATERIALIZED (SELECT u FROM und2 WHERE u NOT IN (SELECT from_node FROM e WHERE mode <> 'bike' UNION ALL SELECT to_node FROM e WHERE mode <> 'bike')
              GROUP BY 1 HAVING count(*) = 2)
          , hp AS MATERIALIZED (SELECT from_node AS u, to_node AS v, key, length_m FROM e WHERE mode = 'bike' AND from_node <> to_node
              QUALIFY row_number() OVER (PARTITION BY from_node, to_node ORDER BY length_m, key) = 1)
          , prd AS (SELECT b.u, b.v FROM hp b JOIN hp p ON p.v = b.u AND p.u <> b.v WHERE b.u IN (SELECT u FROM inn))
          , wk(hu, hv, u, v, r) AS (
              SELECT u, v, u, v, 0 FROM hp WHERE (u, v) NOT IN (SELECT (u, v) FROM prd)
              UNION ALL
              SELECT w.hu, w.hv, h.u, h.v, w.r + 1 FROM wk w JOIN hp h ON h.u = w.v AND h.v <> w.u WHERE w.v IN (SELECT u FROM inn))
          , ring AS (SELECT u AS hu, v AS hv, u, v, 0 AS r FROM hp WHERE (u, v) NOT IN (SELECT (u, v) FROM wk))
          , al AS (SELECT * FROM wk UNION ALL SELECT * FROM ring)"""
        + f""" SELECT hu AS from_node, arg_max(al.v, r) AS to_node, 'bike' AS mode, round(sum(hp.length_m::DECIMAL(20,4))::DOUBLE, 4) + 0.0 AS length_m
            FROM al JOIN hp ON hp.u = al.u AND hp.v = al.v GROUP BY hu, hv
          UNION ALL SELECT from_node, to_node, mode, {_r("length_m")} FROM e WHERE mode <> 'bike' OR from_node = to_node OR (from_node, to_node, key) NOT IN (SELECT (u, v, key) FROM hp)""",
        "contracted_chains": rec
        + """, und2 AS MATERIALIZED (SELECT DISTINCT u, v FROM (SELECT from_node AS u, to_node AS v FROM e WHERE mode = 'bike' AND from_node <> to_node
              UNION ALL SELECT to_node, from_node FROM e WHERE mode = 'bike' AND from_node <> to_node))
          , inn AS MATERIALIZED (SELECT u FROM und2 GROUP BY 1 HAVING count(*) = 2)
          , lk AS (SELECT u AS from_node, v AS to_node FROM und2 WHERE u IN (SELECT u FROM inn) AND v IN (SELECT u FROM inn))"""
        + _labels("lk")
        + " SELECT inn.u AS osmid, coalesce(lab.l, inn.u) AS chain FROM inn LEFT JOIN lab ON lab.u = inn.u",
        "prune_components": rec
        + "\n, bk AS (SELECT * FROM e WHERE mode = 'bike')"
        + _labels("bk")
        + pair_len
        + _labels("(SELECT * FROM e WHERE mode = 'rail')").replace("und", "undr").replace("lab(", "labr(").replace("lab ", "labr ").replace("lab.", "labr.").replace("labr x", "labr x")
        + """, keep AS MATERIALIZED (SELECT u FROM lab WHERE l IN (SELECT component FROM cl WHERE length_m >= 5000)
            UNION SELECT u FROM labr WHERE l = (SELECT l FROM labr GROUP BY 1 ORDER BY count(*) DESC, l LIMIT 1))
          SELECT node_type AS kind, count(*) AS n FROM n WHERE osmid IN (SELECT u FROM keep) GROUP BY 1
          UNION ALL SELECT 'edge ' || mode, count(*) FROM e WHERE from_node IN (SELECT u FROM keep) AND to_node IN (SELECT u FROM keep) GROUP BY mode""",
        "components_bike": labelled + pair_len + " SELECT component, nodes, length_m FROM cs JOIN cl USING (component)",
        "dem_sample_nodes": w + f" SELECT osmid, {dem} AS elevation_m FROM n",
        "nan_fill_mean": w
        + f", d AS (SELECT osmid, {dem} AS z FROM n) SELECT osmid, {_r('coalesce(z, (SELECT avg(z) FROM d))')} AS elevation_m FROM d",
        "validate_types": w
        + f""" SELECT e0.row_id, e0.mode, f.node_type AS from_type, t.node_type AS to_type
            FROM edges e0 JOIN n f ON e0.from_node = f.osmid JOIN n t ON e0.to_node = t.osmid WHERE NOT coalesce({_FITS}, FALSE)""",
        "validate_types_stored": f"""WITH n AS (SELECT osmid, max(node_type) AS node_type FROM nodes WHERE osmid IS NOT NULL GROUP BY 1)
            SELECT e0.row_id, e0.mode, f.node_type AS from_type, t.node_type AS to_type
            FROM edges e0 JOIN n f ON e0.from_node = f.osmid JOIN n t ON e0.to_node = t.osmid WHERE NOT coalesce({_FITS}, FALSE)""",
        "validate_way_continuity": """SELECT way_id AS query_id, row_id AS seq, from_node, to_node FROM (
              SELECT *, lag(to_node) OVER (PARTITION BY way_id ORDER BY row_id) AS b FROM edges WHERE way_id IS NOT NULL) WHERE b IS NOT NULL AND b <> from_node""",
        "region_months": """WITH d AS (SELECT DISTINCT region_key, strftime(loaded_at AT TIME ZONE 'UTC', '%Y-%m') AS month FROM nodes)
            SELECT r.region_key, m.month FROM build_regions r CROSS JOIN (SELECT DISTINCT month FROM d WHERE month IS NOT NULL) m
            WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.region_key = r.region_key AND d.month = m.month)""",
        "validate_height_diff": w
        + f""" SELECT row_id, {_r("off")} AS off_m FROM (SELECT row_id, abs(height_diff_m - (t.elevation_m - f.elevation_m)) AS off
            FROM edges JOIN n f ON from_node = f.osmid JOIN n t ON to_node = t.osmid) WHERE off > 0.5""",
        "validate_vertex_gap": w
        + bike_verts
        + f""" SELECT row_id, {_r("max(d)")} AS gap_m FROM (SELECT row_id, {_hav("lag(lat) OVER w", "lag(lon) OVER w", "lat", "lon")} AS d
            FROM pv WINDOW w AS (PARTITION BY row_id ORDER BY k)) GROUP BY 1""",
        "validate_z_band": w
        + bike_verts
        + f""", b AS (SELECT row_id, max(z) AS hi, min(z) AS lo, max(z) FILTER (WHERE k = 1) AS a, max(z) FILTER (WHERE k = nv) AS z FROM pv GROUP BY 1)
            SELECT row_id, {_r("greatest(hi - greatest(a, z), least(a, z) - lo, 0.0)")} AS excess_m FROM b""",
        "validate_path_continuity": h
        + """ SELECT query_id, seq, from_node, to_node FROM (SELECT *, lag(to_node) OVER (PARTITION BY query_id ORDER BY seq) AS b FROM h)
            WHERE b IS NOT NULL AND b <> from_node""",
        "sanity_cost_model": w
        + f""", o AS (SELECT from_node, to_node, height_diff_m AS hd, {cost} AS c, key FROM e WHERE mode = 'bike'
              QUALIFY row_number() OVER (PARTITION BY from_node, to_node ORDER BY c, key) = 1)
            SELECT a.from_node, a.to_node, {_r("a.hd")} AS up_m, {_r("a.c")} AS up_cost, {_r("b.c")} AS down_cost, a.c > b.c AS sound
            FROM o a JOIN o b ON a.from_node = b.to_node AND a.to_node = b.from_node WHERE a.hd > 0
            ORDER BY a.hd DESC, a.from_node, a.to_node LIMIT 1""",
        "region_overlap": """SELECT region_key, next_key, round(east - nw, 6) AS overlap_deg, round(east - nw, 6) >= 0.5 AS sound FROM (
              SELECT *, lead(region_key) OVER w AS next_key, lead(west) OVER w AS nw FROM build_regions
              WINDOW w AS (PARTITION BY south, north ORDER BY west, region_key)) WHERE next_key IS NOT NULL""",
        "region_completeness": "SELECT region_key FROM build_regions WHERE region_key NOT IN (SELECT region_key FROM nodes WHERE region_key IS NOT NULL)",
    }
