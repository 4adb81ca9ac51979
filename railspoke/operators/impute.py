"""Missing values filled from similar records with a Chow-Liu dependency tree.

1. *Counting.* The values of every pair of (discretised or categorical) fields
   are counted over the rows in which both are known, in one aggregation over
   all pairs; the counts are written once and serve both further steps.
2. *Structure.* The score of a pair is its mutual information with each row left
   out of the counts that predict it (its share is that of the other rows of its
   value, drawn towards the marginal as by one row more), in the worse of both
   directions. A value seen once tells nothing then, so a field does not win by
   having many values alone. The tree is the spanning tree of highest score. Only
   a few numbers per pair reach the driver.
3. *Message passing.* The evidence of a record is what is known of its other
   fields; a field behind an observed one tells nothing more and is left out.
   Messages run from the leaves to the target: joint counts where a field is
   observed, sums over its values where it is not. The product of the messages
   is the target's posterior. Branches that no value of the target agrees with
   are outvoted: values that agree with most branches come first.
4. *Decoding.* Categories are filled with the mode, ties with the alphabetically
   first; discretised numbers with the bin median or, as problem 4 asks, the
   posterior mean, for which each cell of the counts also holds its values' sum.

Problem 4 fixes the fill to the rows of the same way or place (``group``). In the
trees learned from its larger tables the target's only neighbour is that group,
which hides all other fields where it is observed; so the posterior given all
evidence is the one asked for. Two exact checks follow: records whose group is unknown
stay open; and should a tree come out in which other fields reach the target
past the group, the group's own message is taken alone.

Defined results: nulls never count as a value; NaN and values below
``LEAST_ELEVATION`` count as missing numbers; records without evidence, or with
evidence that no known value goes with, stay open. Copies of a row count each
unless the caller removes them. Without any known value everything stays open.

Skew: counts and messages have one row per value pair or per distinct evidence
and value, built with partial aggregation; records to fill are joined to one
row per evidence, which AQE splits where a third of them share one.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from railspoke.operators.lineage import written

OPEN = "none"
Edge = tuple[str, str, float]


def binned(value: Column, width: float) -> Column:
    """Number of the bin of a value; null stays null."""
    return F.floor(value / F.lit(width)).cast("long")


class Cells:
    """Counts of the values of each pair of fields, as text, and sums of ``value`` in each cell."""

    def __init__(self, rows: DataFrame, fields: list[str], value: str | None = None) -> None:
        self.fields, self.pairs = fields, list(combinations(fields, 2))
        of = F.col(value).cast("decimal(18,6)") if value else F.lit(None).cast("decimal(18,6)")
        each = [
            F.struct(F.lit(k).alias("pair"), F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b"))
            for k, (a, b) in enumerate(self.pairs)
        ]
        long = rows.select(F.explode(F.array(*each)).alias("_p"), of.alias("_v")).select("_p.*", "_v")
        counted = (
            long.where("a is not null and b is not null")
            .groupBy("pair", "a", "b")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("_v").alias("s"))
        )
        self.table = written(counted, "cells")

    def of(self, here: str, there: str) -> DataFrame:
        """(here, there, n, s): the cells of one pair."""
        k = next(k for k, p in enumerate(self.pairs) if set(p) == {here, there})
        a, b = ("a", "b") if self.pairs[k][0] == here else ("b", "a")
        return self.table.where(F.col("pair") == k).select(
            F.col(a).alias("_here"), F.col(b).alias("_there"), F.col("n").cast("double").alias("n"), "s"
        )

    def information(self) -> list[tuple[str, str, float, float]]:
        """(field, field, mutual information in nats, the same with each row left out) of each pair."""
        cells = self.table.select("pair", "a", "b", F.col("n").cast("double").alias("n"))
        for side in ("a", "b"):
            own = cells.groupBy("pair", side).agg(F.sum("n").alias(f"n_{side}"))
            cells = cells.join(own, ["pair", side])
        # one row per pair
        totals = self.table.groupBy("pair").agg(F.sum("n").cast("double").alias("all"))
        n, n_a, n_b, every = (F.col(c) for c in ("n", "n_a", "n_b", "all"))
        left_out = lambda x, y: n * F.log((n - 1.0 + y / every) / x / (y / every))
        sums = cells.join(F.broadcast(totals), "pair").groupBy("pair").agg(
            (F.sum(n * F.log(n * every / n_a / n_b)) / F.first("all")).alias("whole"),
            (F.least(F.sum(left_out(n_a, n_b)), F.sum(left_out(n_b, n_a))) / F.first("all")).alias("left_out"),
        )
        got = {r["pair"]: r for r in sums.collect()}
        return [(a, b, got[k]["whole"], got[k]["left_out"]) if k in got else (a, b, 0.0, 0.0) for k, (a, b) in enumerate(self.pairs)]

    def tree(self) -> list[Edge]:
        return spanning_tree(self.fields, [(a, b, score) for a, b, _, score in self.information()])


def spanning_tree(fields: list[str], scored: list[Edge]) -> list[Edge]:
    """The edges of the tree of highest score, the best first; ties by the order of the fields."""
    part = {f: f for f in fields}

    def root(f: str) -> str:
        while part[f] != f:
            f = part[f]
        return f

    tree = []
    for a, b, score in sorted(scored, key=lambda e: (-round(e[2], 9), fields.index(e[0]), fields.index(e[1]))):
        if root(a) != root(b):
            part[root(a)] = root(b)
            tree.append((a, b, score))
    return tree


def rooted(tree: list[Edge], target: str) -> dict[str, list[str]]:
    """The children of each field, with the target as the root."""
    near: dict[str, list[str]] = {}
    for a, b, _ in tree:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    kids, stack = {target: near.get(target, [])}, [target]
    while stack:
        f = stack.pop()
        for c in kids[f]:
            kids[c] = [x for x in near[c] if x != f]
            stack.append(c)
    return kids


class Posterior:
    """(e, value, score, s): the target's posterior, unnormalised, for each distinct evidence e of the records."""

    def __init__(self, cells: Cells, tree: list[Edge], target: str, observed: str | None = None) -> None:
        """``observed``: a field that all records know, so that nothing behind it is needed."""
        self.cells, self.target, self.kids = cells, target, rooted(tree, target)
        if observed:
            self.kids[observed] = []

    def seen(self) -> dict[str, Column]:
        """What a record tells about each field, as text: null where unknown or behind an observed field."""
        out: dict[str, Column] = {}
        stack = [(c, F.lit(True)) for c in self.kids[self.target]]
        while stack:
            f, open_way = stack.pop()
            value = F.col(f).cast("string")
            out[f] = F.when(open_way, value)
            stack += [(c, open_way & value.isNull()) for c in self.kids[f]]
        return out

    def evidence(self, records: DataFrame) -> DataFrame:
        """Records with ``e``, which names their evidence, and the fields of ``seen``, prefixed with an underscore."""
        seen = self.seen()
        names = sorted(seen)
        e = F.concat_ws("\x1f", *[F.coalesce(seen[f], F.lit("\x00")) for f in names])
        return records.withColumns({"e": e, **{f"_{f}": seen[f] for f in names}})

    def message(self, f: str, parent: str, evidence: DataFrame) -> DataFrame:
        """(e, value of the parent, n, s): joint counts of what is known at and below f with each value of the parent."""
        own = evidence.where(F.col(f"_{f}").isNotNull()).select("e", F.col(f"_{f}").alias("_here"), F.lit(1.0).alias("w"))
        below = [self.message(c, f, evidence) for c in self.kids[f]]
        if below:
            whole = self.marginal(f, parent)
            inner = self.combined(below, whole).select("e", F.col("value").alias("_here"), (F.col("score") / F.col("n")).alias("w"))
            own = own.unionByName(inner)
        joined = own.join(self.cells.of(f, parent), "_here")
        weight = F.col("w").cast("decimal(20,12)")
        return joined.groupBy("e", F.col("_there").alias("value")).agg(
            F.sum(F.col("w") * F.col("n")).alias("n"),
            F.sum(F.when(F.col("w") == 1.0, F.col("s")).otherwise((weight * F.col("s")).cast("decimal(28,6)"))).alias("s"),
        )

    def marginal(self, f: str, other: str) -> DataFrame:
        """(value, n) of one field."""
        return self.cells.of(f, other).groupBy(F.col("_here").alias("value")).agg(F.sum("n").alias("n"))

    @staticmethod
    def combined(messages: list[DataFrame], marginal: DataFrame) -> DataFrame:
        """(e, value, score, n, s) of the values that agree with most messages; n: the value's own count."""
        every = messages[0]
        for m in messages[1:]:
            every = every.unionByName(m)
        one = every.join(marginal.withColumnRenamed("n", "_n"), "value")
        product = F.exp(F.sum(F.log(F.col("n") / F.col("_n")))) * F.first("_n")
        # one message: the joint count itself, without rounding
        joined = one.groupBy("e", "value").agg(
            F.count(F.lit(1)).alias("k"),
            F.when(F.count(F.lit(1)) == 1, F.sum("n")).otherwise(product).alias("score"),
            F.first("_n").alias("n"),
            (F.sum("s").cast("double") / F.sum("n")).alias("mean"),
            F.sum("s").alias("s"),
        )
        most = F.max("k").over(Window.partitionBy("e"))
        return joined.withColumn("_most", most).where("k = _most").select(
            "e", "value", "score", "n", F.when(F.col("k") == 1, F.col("s")).otherwise((F.col("score") * F.col("mean")).cast("decimal(28,6)")).alias("s")
        )

    def of(self, evidence: DataFrame) -> DataFrame:
        """(e, value, score, s) for distinct evidence; nothing is known about evidence that is all null."""
        messages = [self.message(c, self.target, evidence) for c in self.kids[self.target]]
        marginal = self.marginal(self.target, self.kids[self.target][0])
        return self.combined(messages, marginal).select("e", "value", "score", "s")


def decode_mode(posterior: DataFrame) -> DataFrame:
    """(e, fill): the value of highest score; equal to nine digits is a tie."""
    best = F.min(F.struct((-F.round("score", 9)).alias("_w"), F.col("value").alias("_v")))
    return posterior.groupBy("e").agg(best.alias("_b")).select("e", F.col("_b._v").alias("fill"))


def decode_mean(posterior: DataFrame) -> DataFrame:
    """(e, fill): the posterior mean; sums are decimal, so it does not depend on the order of the rows."""
    return posterior.groupBy("e").agg((F.sum("s").cast("double") / F.sum("score")).alias("fill"))


def decode_median(posterior: DataFrame) -> DataFrame:
    """(e, fill): the number of the bin in which the lower weighted median lies."""
    w = Window.partitionBy("e").orderBy(F.col("value").cast("long"))
    ranked = posterior.withColumn("_below", F.sum("score").over(w)).withColumn(
        "_all", F.sum("score").over(Window.partitionBy("e"))
    )
    return ranked.where(F.col("_below") * 2 >= F.col("_all")).groupBy("e").agg(F.min(F.col("value").cast("long")).alias("fill"))


def fill_missing(
    rows: DataFrame,
    missing: Column,
    key: str,
    target: str,
    cells: Cells,
    tree: list[Edge],
    decode: Callable[[DataFrame], DataFrame] = decode_mode,
    group: str | None = None,
) -> DataFrame:
    """(key, fill, told_by) of every row where ``missing`` holds; ``fill`` is null where the row stays open.

    With ``group`` only its known values fill; see the module. ``told_by`` names
    the observed fields that the fill comes from.
    """
    if group and rooted(tree, target)[target] != [group]:
        # exact check: other fields would have a say beside the group
        tree = [(group, target, 0.0)]
    posterior = Posterior(cells, tree, target, group)
    told = F.concat_ws("+", *[F.when(c.isNotNull(), f) for f, c in sorted(posterior.seen().items())])
    records = posterior.evidence(rows.where(missing)).withColumn("told_by", told)
    if group:
        records = records.withColumn("e", F.when(F.col(group).isNotNull(), F.col("e")))
    fields = [f"_{f}" for f in posterior.seen()]
    evidence = records.where("e is not null").select("e", *fields).distinct()
    if len(fields) > 1:
        # several messages read it
        evidence = written(evidence, "evidence")
    fills = decode(posterior.of(evidence))
    return records.select(key, "e", "told_by").join(fills, "e", "left").select(key, "fill", "told_by")


# --- problem 4 on the graph's tables ---

_BLANK = r"(?U)^\s*$"
#: Fixed value: elevations below this are marks for missing.
LEAST_ELEVATION = -500.0
BIN_M = 50.0


def edge_fields(edges: DataFrame, reference: DataFrame, key: str = "row_id") -> DataFrame:
    """Bike edges with ``surface`` kept where it is exactly an allowed value, and ``open`` where it is missing."""
    allowed = reference.where("tag_field = 'surface'").select(F.col("canonical").alias("surface")).distinct()
    bike = edges.where("mode = 'bike'").select(key, "way_id", "surface", "highway", "region_key")
    known = bike.join(allowed.withColumn("_ok", F.lit(True)), "surface", "left")
    blank = F.col("surface").isNull() | F.col("surface").rlike(_BLANK)
    return known.select(
        key, "way_id", F.when(F.col("_ok"), F.col("surface")).alias("surface"), "highway", "region_key", blank.alias("open")
    )


def node_fields(nodes: DataFrame, key: str = "osmid") -> DataFrame:
    """One row per node: elevation if any delivery has one, place, region and kind."""
    e = F.col("elevation_m")
    known = F.when(e.isNotNull() & ~F.isnan(e) & (e >= LEAST_ELEVATION), e)
    one = nodes.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.max(known).alias("elevation_m"),
        F.max("place_key").alias("place_key"),
        F.max("region_key").alias("region_key"),
        F.max(F.lower(F.trim("node_type"))).alias("node_type"),
    )
    return one.withColumn("elevation_bin", binned(F.col("elevation_m"), BIN_M)).withColumn(
        "open", F.col("elevation_m").isNull()
    )


EDGE_TREE_FIELDS = ["way_id", "surface", "highway", "region_key"]
NODE_TREE_FIELDS = ["place_key", "elevation_bin", "region_key", "node_type"]


def edge_cells(edges: DataFrame) -> Cells:
    return Cells(edges, EDGE_TREE_FIELDS)


def node_cells(nodes: DataFrame) -> Cells:
    return Cells(nodes, NODE_TREE_FIELDS, "elevation_m")


def fill_edges_and_nodes(edges: DataFrame, nodes: DataFrame, reference: DataFrame) -> DataFrame:
    """(target, record_id, fill_value) of every missing surface and elevation."""
    e = edge_fields(edges, reference)
    cells = edge_cells(e)
    surfaces = fill_missing(e, F.col("open"), "row_id", "surface", cells, cells.tree(), decode_mode, "way_id")
    n = written(node_fields(nodes), "nodes")
    cells = node_cells(n)
    heights = fill_missing(n, F.col("open"), "osmid", "elevation_bin", cells, cells.tree(), decode_mean, "place_key")
    metres = F.bround("fill", 0).cast("long").cast("string")
    return surfaces.select(
        F.lit("edges.surface").alias("target"),
        F.col("row_id").alias("record_id"),
        F.coalesce("fill", F.lit(OPEN)).alias("fill_value"),
    ).unionByName(
        heights.select(
            F.lit("nodes.elevation_m").alias("target"),
            F.col("osmid").alias("record_id"),
            F.coalesce(metres, F.lit(OPEN)).alias("fill_value"),
        )
    )


def posterior_fills(edges: DataFrame, nodes: DataFrame, reference: DataFrame) -> DataFrame:
    """(target, record_id, fill_value, told_by): fills from all evidence, modes and middles of median bins."""
    e = edge_fields(edges, reference)
    cells = edge_cells(e)
    surfaces = fill_missing(e, F.col("open"), "row_id", "surface", cells, cells.tree())
    n = written(node_fields(nodes), "nodes")
    cells = node_cells(n)
    heights = fill_missing(n, F.col("open"), "osmid", "elevation_bin", cells, cells.tree(), decode_median)
    middle = ((F.col("fill") + 0.5) * BIN_M).cast("long").cast("string")
    return surfaces.select(
        F.lit("edges.surface").alias("target"), F.col("row_id").alias("record_id"), F.col("fill").alias("fill_value"), "told_by"
    ).unionByName(
        heights.select(
            F.lit("nodes.elevation_m").alias("target"), F.col("osmid").alias("record_id"), middle.alias("fill_value"), "told_by"
        )
    )


def trees(edges: DataFrame, nodes: DataFrame, reference: DataFrame) -> list[tuple]:
    """(table, field, field, information, left_out, in_tree) of each pair of fields."""
    out = []
    for name, cells in (("edges", edge_cells(edge_fields(edges, reference))), ("nodes", node_cells(node_fields(nodes)))):
        scored = cells.information()
        held = {(a, b) for a, b, _ in spanning_tree(cells.fields, [(a, b, score) for a, b, _, score in scored])}
        out += [(name, a, b, info, score, (a, b) in held) for a, b, info, score in scored]
    return out
