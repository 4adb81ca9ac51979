"""Queries of the data-preparation operators of the core, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from railspoke.operators.impute import EDGE_TREE_FIELDS, NODE_TREE_FIELDS, fill_edges_and_nodes, posterior_fills, trees
from railspoke.operators.orphans import orphan_references, orphan_report
from railspoke.operators.packed import split_packed
from railspoke.operators.spatial import boxes_around, points_within
from railspoke.sources.tables import table

WALK_M = 200.0
TAGS = ["surface", "highway"]


def near_nodes(s: SparkSession, d: str) -> DataFrame:
    """(osmid_a, osmid_b) of bike and rail nodes at most 200 m apart."""
    nodes = table(s, d, "nodes").where("not (lat = 0 and lon = 0)")
    kind = F.lower(F.regexp_replace("node_type", r"(?U)^\s+|\s+$", ""))
    of = nodes.select("osmid", "lat", "lon", kind.alias("kind"))
    pairs = points_within(of.where("kind = 'rail'"), of.where("kind = 'bike'"), WALK_M, unique=False)
    return (
        pairs.where("left_id <> right_id")
        .select(F.least("left_id", "right_id").alias("osmid_a"), F.greatest("left_id", "right_id").alias("osmid_b"))
        .distinct()
    )


def node_regions(s: SparkSession, d: str) -> DataFrame:
    """(osmid, region_key) of the build regions around every node; null where there is none."""
    nodes = table(s, d, "nodes").where("not (lat = 0 and lon = 0)")
    return boxes_around(nodes, table(s, d, "build_regions")).withColumnRenamed("region_key", "region_around")


def _filling(f: Callable) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: f(table(s, d, "edges"), table(s, d, "nodes"), table(s, d, "tag_reference"))


def _tree(s: SparkSession, d: str) -> DataFrame:
    rows = [(*r[:3], round(r[3], 6) + 0.0, round(r[4], 6) + 0.0, r[5]) for r in _filling(trees)(s, d)]
    return s.createDataFrame(
        rows, "table_name string, field_a string, field_b string, information double, left_out double, in_tree boolean"
    )


def _references(s: SparkSession, d: str) -> dict:
    return {
        "rows": table(s, d, "edges"),
        "id_key": "row_id",
        "sides": ["from_node", "to_node"],
        "at": "loaded_at",
        "parents": table(s, d, "nodes"),
        "deletions": table(s, d, "node_deletions"),
        "key": "osmid",
        "delivered": "loaded_at",
        "deleted": "deleted_at",
    }


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p3_found": near_nodes,
        "p3_regions": node_regions,
        "p4_found": _filling(fill_edges_and_nodes),
        "p4_tree": _tree,
        "p4_posterior": _filling(posterior_fills),
        "p5_found": lambda s, d: split_packed(table(s, d, "edges"), "row_id", TAGS, least=2).drop("error"),
        "p5_elements": lambda s, d: split_packed(table(s, d, "edges"), "row_id", TAGS),
        "p6_found": lambda s, d: orphan_references(**_references(s, d)),
        "p6_report": lambda s, d: orphan_report(table="edges", **_references(s, d)),
    }


_JUDGED = """
WITH ev AS (
  SELECT osmid AS k, loaded_at AS ts, TRUE AS alive FROM nodes
  UNION ALL SELECT osmid, deleted_at, FALSE FROM node_deletions
), refs AS (
  SELECT row_id, 'from_node' AS side, from_node AS k, loaded_at AS ts FROM edges
  UNION ALL SELECT row_id, 'to_node', to_node, loaded_at FROM edges
), seen AS (
  SELECT r.row_id, r.side, r.ts,
    bool_or(e.alive) AS born,
    arg_max(e.alive, e.ts) FILTER (WHERE e.ts <= r.ts) AS last
  FROM refs r LEFT JOIN ev e ON r.k = e.k WHERE r.k IS NOT NULL
  GROUP BY r.row_id, r.side, r.ts
), judged AS (
  SELECT row_id, side, ts, CASE
    WHEN NOT coalesce(born, FALSE) THEN 'missing'
    WHEN last IS NULL THEN 'late'
    WHEN NOT last THEN 'deleted' END AS kind
  FROM seen
)
"""

_P4 = r"""
WITH bike AS (
  SELECT row_id, way_id, surface, t.canonical IS NOT NULL AS ok,
    surface IS NULL OR regexp_full_match(surface, '[\s\x{00a0}]*') AS gap
  FROM edges LEFT JOIN (SELECT DISTINCT canonical FROM tag_reference WHERE tag_field = 'surface') t
    ON surface = t.canonical
  WHERE mode = 'bike'
), counted AS (
  SELECT way_id, surface, count(*) AS n FROM bike WHERE ok AND way_id IS NOT NULL GROUP BY 1, 2
), best AS (
  SELECT way_id, surface AS fill FROM counted
  QUALIFY row_number() OVER (PARTITION BY way_id ORDER BY n DESC, surface) = 1
), node AS (
  SELECT osmid, max(place_key) AS place_key,
    max(CASE WHEN NOT isnan(elevation_m) AND elevation_m >= -500 THEN elevation_m END) AS h
  FROM nodes WHERE osmid IS NOT NULL GROUP BY 1
), place AS (
  SELECT place_key, sum(h::DECIMAL(18,6))::DOUBLE / count(h) AS fill FROM node WHERE place_key IS NOT NULL GROUP BY 1
)
SELECT 'edges.surface' AS target, row_id AS record_id, coalesce(fill, 'none') AS fill_value
FROM bike LEFT JOIN best USING (way_id) WHERE gap
UNION ALL
SELECT 'nodes.elevation_m', osmid, coalesce(round_even(fill, 0)::BIGINT::VARCHAR, 'none')
FROM node LEFT JOIN place USING (place_key) WHERE h IS NULL
"""

def _pairs(fields: list[str], rows: str) -> str:
    """SQL of the information of each pair of fields, with and without each row itself, and of their best tree."""
    pairs = [(i, a, j, b) for i, a in enumerate(fields) for j, b in enumerate(fields) if i < j]
    each = " UNION ALL ".join(
        f"SELECT {i} AS i, '{a}' AS fa, {j} AS j, '{b}' AS fb, {a}::VARCHAR AS a, {b}::VARCHAR AS b FROM r WHERE {a} IS NOT NULL AND {b} IS NOT NULL"
        for i, a, j, b in pairs
    )
    return f"""WITH RECURSIVE r AS ({rows}), c AS (SELECT i, fa, j, fb, a, b, count(*)::DOUBLE AS n FROM ({each}) GROUP BY ALL
    ), m AS (
      SELECT *, sum(n) OVER (PARTITION BY i, j, a) AS x, sum(n) OVER (PARTITION BY i, j, b) AS y, sum(n) OVER (PARTITION BY i, j) AS t FROM c
    ), s AS (
      SELECT i, fa, j, fb, sum(n * ln(n * t / x / y)) / any_value(t) AS info, least(
        sum(n * ln((n - 1.0 + y / t) / x / (y / t))), sum(n * ln((n - 1.0 + x / t) / y / (x / t)))) / any_value(t) AS score FROM m GROUP BY ALL
    ), pr AS MATERIALIZED (
      SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, i, j) AS k FROM s
    ), reach(k, node) AS (
      SELECT k, i FROM pr
      UNION
      SELECT r.k, CASE WHEN p.i = r.node THEN p.j ELSE p.i END FROM reach r JOIN pr p ON p.k < r.k AND (p.i = r.node OR p.j = r.node)
    )
    SELECT fa AS field_a, fb AS field_b, round(info, 6) + 0.0 AS information, round(score, 6) + 0.0 AS left_out,
      NOT EXISTS (SELECT 1 FROM reach x WHERE x.k = pr.k AND x.node = pr.j) AS in_tree FROM pr"""


_PLACED = "osmid IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL AND NOT (lat = 0 AND lon = 0)"


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": f"""
            WITH n AS (
              SELECT DISTINCT osmid, lat, lon, lower(trim(node_type)) AS kind FROM nodes WHERE {_PLACED}
            )
            SELECT DISTINCT least(a.osmid, b.osmid) AS osmid_a, greatest(a.osmid, b.osmid) AS osmid_b
            FROM n a JOIN n b ON a.kind = 'rail' AND b.kind = 'bike' AND b.lat BETWEEN a.lat - 0.0019 AND a.lat + 0.0019
            WHERE 2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2)
              + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) <= 200""",
        "p3_regions": f"""
            SELECT DISTINCT n.osmid, r.region_key AS region_around
            FROM (SELECT DISTINCT osmid, lat, lon FROM nodes WHERE osmid IS NOT NULL AND NOT coalesce(lat = 0 AND lon = 0, FALSE)
              AND (lat IS NOT NULL OR lon <> 0 OR lon IS NULL)) n
            LEFT JOIN build_regions r ON n.lat BETWEEN r.south AND r.north AND n.lon BETWEEN r.west AND r.east
            """,
        "p4_found": _P4,
        "p4_tree": f"""SELECT 'edges' AS table_name, * FROM ({_pairs(EDGE_TREE_FIELDS, """SELECT way_id, t.canonical AS surface, highway, region_key
              FROM edges LEFT JOIN (SELECT DISTINCT canonical FROM tag_reference WHERE tag_field = 'surface') t ON surface = t.canonical WHERE mode = 'bike'""")})
            UNION ALL SELECT 'nodes', * FROM ({_pairs(NODE_TREE_FIELDS, """SELECT max(place_key) AS place_key,
              floor(max(CASE WHEN NOT isnan(elevation_m) AND elevation_m >= -500 THEN elevation_m END) / 50.0) AS elevation_bin,
              max(region_key) AS region_key, max(lower(trim(node_type, ' '))) AS node_type FROM nodes WHERE osmid IS NOT NULL GROUP BY osmid""")})""",
        "p6_found": _JUDGED + "SELECT row_id, side, kind FROM judged WHERE kind IS NOT NULL",
        "p6_report": _JUDGED
        + """SELECT 'edges' AS table_name, strftime(ts AT TIME ZONE 'UTC', '%Y-%m') AS month, side, count(*) AS refs,
            count(*) FILTER (WHERE kind = 'missing') AS missing, count(*) FILTER (WHERE kind = 'late') AS late,
            count(*) FILTER (WHERE kind = 'deleted') AS deleted
            FROM judged GROUP BY ALL""",
    }
