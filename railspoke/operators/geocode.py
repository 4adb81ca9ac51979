"""Names to places and places to names, over tables: a gazetteer and the graph's stations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from railspoke.functions import columns as C


def _filled(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def box_value(lat: Column, lon: Column, name: Column) -> Column:
    """"lat, lon" to five digits, followed by "(name)" where there is one; ``parsed_latlon`` reads it back."""
    at = F.format_string("%.5f, %.5f", lat, lon)
    return F.when(_filled(name).isNotNull(), F.concat(at, F.lit(" ("), F.trim(name), F.lit(")"))).otherwise(at)


def display_label(value: Column) -> Column:
    """The name inside a coordinate literal, else the value itself."""
    return F.coalesce(F.trim(C.parsed_latlon(value)["name"]), value)


def feature_label(*parts: Column) -> Column:
    """"Name, City, State" without blank parts and repeats."""
    return F.array_join(F.array_distinct(F.array_compact(F.array(*[_filled(p) for p in parts]))), ", ")


def station_label(name: Column) -> Column:
    """The name with " Bahnhof" behind it, once."""
    name = F.trim(name)
    return F.when(F.lower(name).endswith("bahnhof"), name).otherwise(F.concat(name, F.lit(" Bahnhof")))


def extract_leaf(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def middle(nodes: DataFrame) -> DataFrame:
    """One row (m_lat, m_lon): the middle of the nodes' box."""
    return nodes.agg(((F.min("lat") + F.max("lat")) / 2).alias("m_lat"), ((F.min("lon") + F.max("lon")) / 2).alias("m_lon"))


def geocoded(texts: DataFrame, gazetteer: DataFrame, centre: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, lat, lon, label, status) of each text: ``literal``, ``place``, ``empty`` or ``not_found``.

    Coordinates win over names. A name matches a place of the gazetteer regardless
    of case and outer blanks; of several places of one name the one nearest to
    the centre is meant, then the smallest key. Copies of a text come out each.
    """
    at = C.parsed_latlon(F.col(text))
    own = texts.select(key, text, at.alias("_at"), F.lower(F.trim(text)).alias("_name"))
    far = C.haversine_m(F.col("lat"), F.col("lon"), F.col("m_lat"), F.col("m_lon"))
    # one row of the centre
    named = gazetteer.where("name is not null and lat is not null and lon is not null").crossJoin(F.broadcast(centre))
    best = named.groupBy(F.lower(F.trim("name")).alias("_name")).agg(
        F.min_by(F.struct("lat", "lon", "name"), F.struct(F.round(far, 3), "place_key")).alias("_p")
    )
    status = (
        F.when(F.coalesce(F.col("_name"), F.lit("")) == "", "empty")
        .when(F.col("_at").isNotNull(), "literal")
        .when(F.col("_p").isNotNull(), "place")
        .otherwise("not_found")
    )
    got = own.join(best, "_name", "left").withColumn("status", status)
    pick = lambda c: F.when(F.col("status") == "literal", F.col(f"_at.{c}")).when(F.col("status") == "place", F.col(f"_p.{c}"))
    return got.select(key, pick("lat").alias("lat"), pick("lon").alias("lon"), pick("name").alias("label"), "status")


def suggested(terms: DataFrame, named: DataFrame, centre: DataFrame, most: int, term: str = "term") -> DataFrame:
    """(term, rank, osmid, name, lat, lon) of the ``most`` named points that begin with each term, nearest to the centre first.

    ``named`` has osmid, name, lat and lon. Terms meet names on the term's length
    and its text (an equi-join on the beginnings of those lengths that occur), so a
    short term meets its names only. Blank terms have no suggestion.
    """
    asked = terms.select(F.lower(F.trim(term)).alias("_t")).where("_t <> ''").distinct()
    # the lengths that occur: a few numbers
    lengths = asked.agg(F.sort_array(F.collect_set(F.length("_t"))).alias("_k"))
    far = C.haversine_m(F.col("lat"), F.col("lon"), F.col("m_lat"), F.col("m_lon"))
    rows = named.where("name is not null and lat is not null and lon is not null").crossJoin(F.broadcast(centre)).crossJoin(F.broadcast(lengths))
    rows = rows.withColumn("_d", F.round(far, 3)).withColumn("_n", F.explode("_k")).withColumn("_t", F.expr("left(lower(trim(name)), _n)")).where("length(_t) = _n")
    rank = F.row_number().over(Window.partitionBy("_t").orderBy("_d", "osmid"))
    return rows.join(asked, "_t", "left_semi").withColumn("rank", rank).where(F.col("rank") <= most).select(F.col("_t").alias(term), "rank", "osmid", "name", "lat", "lon")
