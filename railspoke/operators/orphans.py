"""References to records that do not exist: missing, late or deleted parents.

Parents have a history: deliveries and deletions, each with a time. The history
is reduced to its changes of state, which are the starts of the parent's
validity intervals, and to one row per delivered parent that comes first and
tells when it was first delivered. References and histories are partitioned by
key and sorted by (key, time), and one linear pass over the merged stream
carries what the last rows told to each reference; no row is held back.

Kinds: ``missing`` (no delivery of the key at all), ``late`` (deliveries only
after the reference, and no deletion up to it), ``deleted`` (the last event up
to the reference is a deletion). Anything else is no case.

Defined results: null keys refer to nothing and are no case; a null time of a
reference lies before all events, a null time of an event before all
references; at equal times a reference comes after the events, and a deletion
after a delivery. Repeated references come out each; repeated events change
nothing. An empty parent table makes every reference ``missing``.

Skew: a key with more than ``heavy_rows`` references is cut into blocks by
hash, each of which gets a copy of the key's (reduced) history, so a hot parent
fills many partitions. Heavy keys are found in a sample of the references, kept
in a table and joined, however many there are; a block is a matter of speed
only, results do not depend on it. Deliveries of a hot parent are reduced by
partial aggregation before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from railspoke.operators.lineage import written

HEAVY_ROWS = 500_000
#: References of the sample in which heavy keys are looked for.
SAMPLE_ROWS = 2_000_000


def parent_changes(parents: DataFrame, deletions: DataFrame, key: str, delivered: str, deleted: str) -> DataFrame:
    """(key, at, turn, alive, since, always) of every key.

    One row with turn 0 for each key that was ever delivered: ``since`` is its
    first delivery, ``always`` marks one without a time. For keys that were
    deleted, also their changes of state: turn 1 deliveries, turn 2 deletions.
    """
    gone = deletions.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(deleted).alias("at")).distinct()
    come = parents.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(delivered).alias("at"))
    nothing = F.lit(None)
    born = come.groupBy("key").agg(F.min("at").alias("since"), F.max(F.col("at").isNull()).alias("always"))
    kind = dict(come.dtypes)["at"]
    born = born.select("key", nothing.cast(kind).alias("at"), F.lit(0).alias("turn"), nothing.cast("boolean").alias("alive"), "since", "always")
    # for keys that were deleted, deliveries and deletions in turn, without repeats
    turns = (
        come.join(gone.select("key").distinct(), "key", "left_semi")
        .distinct()
        .withColumn("alive", F.lit(True))
        .unionByName(gone.withColumn("alive", F.lit(False)))
    )
    in_time = Window.partitionBy("key").orderBy(F.col("at").asc_nulls_first(), F.col("alive").desc())
    changes = (
        turns.withColumn("_before", F.lag("alive").over(in_time))
        .where(F.col("_before").isNull() | (F.col("_before") != F.col("alive")))
        .select("key", "at", F.when(F.col("alive"), 1).otherwise(2).alias("turn"), "alive")
    )
    return born.unionByName(changes, allowMissingColumns=True)


def heavy_keys(refs: DataFrame, heavy_rows: int, sample_rows: int = SAMPLE_ROWS) -> DataFrame | None:
    """(key, cut) of the keys that a sample shows to have more than about ``heavy_rows`` references; None without any."""
    n = refs.count()
    if n <= heavy_rows:
        return None
    share = min(1.0, sample_rows / n)
    drawn = refs.select("key").where("key is not null").sample(False, share, 11) if share < 1.0 else refs.select("key")
    seen = F.count(F.lit(1)) / share
    cut = drawn.groupBy("key").agg(F.ceil(seen / heavy_rows).cast("long").alias("cut")).where("cut > 1 and key is not null")
    cut = written(cut, "heavy")
    return None if cut.isEmpty() else cut


def _references(rows: DataFrame, id_key: str, sides: list[str], at: str) -> DataFrame:
    each = F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("key")) for s in sides])
    return (
        rows.select(F.col(id_key).alias("id"), F.col(at).alias("at"), F.explode(each).alias("_e"))
        .select("id", "at", "_e.side", "_e.key")
        .where(F.col("key").isNotNull())
    )


def judged_references(
    rows: DataFrame,
    id_key: str,
    sides: list[str],
    at: str,
    parents: DataFrame,
    deletions: DataFrame,
    key: str,
    delivered: str,
    deleted: str,
    heavy_rows: int = HEAVY_ROWS,
) -> DataFrame:
    """(id, side, at, kind) of every reference; ``kind`` is null where the parent exists."""
    refs = _references(rows, id_key, sides, at)
    changes = parent_changes(parents, deletions, key, delivered, deleted)
    cut = heavy_keys(refs, heavy_rows)
    if cut is not None:
        n = F.coalesce("cut", F.lit(1))
        refs = refs.join(cut, "key", "left").withColumn("block", F.pmod(F.xxhash64("id", "side"), n)).drop("cut")
        changes = (
            changes.join(cut, "key", "left")
            .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
            .drop("cut")
        )
    else:
        zero = F.lit(0).cast("long")
        refs, changes = refs.withColumn("block", zero), changes.withColumn("block", zero)
    stream = changes.unionByName(refs.withColumn("turn", F.lit(3)), allowMissingColumns=True)
    # what stands first has neither a time; deliveries without a time still come before references without one
    merged = Window.partitionBy("key", "block").orderBy(F.when(F.col("turn") == 0, 0).otherwise(1), F.col("at").asc_nulls_first(), "turn")
    so_far = merged.rowsBetween(Window.unboundedPreceding, 0)
    seen = stream.select(
        "id", "side", "at", "turn", *[F.last(c, True).over(so_far).alias(c) for c in ("alive", "since", "always")]
    ).where("turn = 3")
    late = ~F.col("always") & (F.col("at").isNull() | (F.col("at") < F.col("since")))
    kind = (
        F.when(F.col("always").isNull(), "missing")
        .when(F.col("alive").isNull() & late, "late")
        .when(~F.col("alive"), "deleted")
    )
    return seen.select("id", "side", "at", kind.alias("kind"))


def orphan_references(rows: DataFrame, id_key: str, **how: object) -> DataFrame:
    """(id_key, side, kind) of every orphan reference."""
    found = judged_references(rows, id_key, **how).where("kind is not null")
    return found.select(F.col("id").alias(id_key), "side", "kind")


def orphan_report(rows: DataFrame, id_key: str, table: str, **how: object) -> DataFrame:
    """(table_name, month, side, refs, missing, late, deleted) per month of the reference's time."""
    judged = judged_references(rows, id_key, **how)
    return judged.groupBy(
        F.lit(table).alias("table_name"), F.date_format("at", "yyyy-MM").alias("month"), "side"
    ).agg(
        F.count(F.lit(1)).alias("refs"),
        *[F.count_if(F.col("kind") == k).alias(k) for k in ("missing", "late", "deleted")],
    )
