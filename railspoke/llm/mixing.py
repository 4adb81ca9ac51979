"""Sources mixed to target weights, in fixed-length blocks of tokens.

1. Each source's documents are put in a pseudorandom order and laid end to end:
   its stream. A token's place is a prefix sum, taken in two steps: sums per
   (source, bucket) of hashed document ids, and windows inside the buckets, so
   no source is ever one task.
2. A source gives as many tokens as its share of the output needs, at most
   ``max_repeats`` times its stream. They are the first tokens of the stream
   repeated again and again, cut into blocks of ``block_tokens`` tokens; only the
   last block of a source may be shorter. So the tokens reached are exact, no
   token is used more than ``max_repeats`` times, and a source falls short only
   where all its repeats together hold fewer tokens than its target.
3. The output has ``shards`` shards. How many slots of each source a shard gets is
   drawn from the multinomial distribution of the source's slots over the shards,
   so totals per source are exact and shards differ a little in length.
4. Slot j of a source holds block ``perm(j)``, where ``perm`` is a pseudorandom
   permutation of the source's block numbers (a keyed four-round Feistel network,
   walked until it falls into the range). Slots are numbered through all sources
   and made where they are needed; none is listed by the driver.
5. Slots and the pieces of documents are joined by (source, block of the stream);
   a block of the repeated stream touches at most two neighbouring blocks of it,
   or, where a stream is shorter than a block, all of it.

Defined results: documents of sources without a target, and documents without a
token, stay out; a null source never has a target; a target without documents is
reported with its whole share as shortfall; targets with null or non-positive
share or repeats get no slot. The output is ``total_tokens`` long, by default as
long as the documents of all targets together; what a source falls short is
reported and not given to others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from railspoke.llm.tokenizer import token_counts
from railspoke.operators.lineage import written

BLOCK_TOKENS = 1024
SHARDS = 64
SEED = 20240607
#: Documents per bucket of the prefix sums, about.
BUCKET_DOCUMENTS = 20_000
#: Sources with a target that the driver plans for (one row each, not data).
MOST_SOURCES = 100_000


def permute(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Pseudorandom permutation of 0..size-1 for each key, element by element."""
    index, size, key = (np.asarray(x, dtype="uint64") for x in (index, size, key))
    bits = np.ones(len(index), dtype="uint64")
    for b in range(1, 32):
        bits[(np.uint64(1) << np.uint64(2 * b)) < size] = b + 1
    mask = (np.uint64(1) << bits) - np.uint64(1)
    out = index.copy()
    todo = np.arange(len(index))
    while len(todo):
        left, right = out[todo] >> bits[todo], out[todo] & mask[todo]
        for r in range(4):
            mixed = right * np.uint64(0x9E3779B97F4A7C15) + key[todo] + np.uint64(r * 0xD1B54A32D192ED03 % 2**64)
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
            mixed ^= mixed >> np.uint64(32)
            left, right = right, left ^ (mixed & mask[todo])
        out[todo] = (left << bits[todo]) | right
        todo = todo[out[todo] >= size[todo]]
    return out


def _slots(seed: int, begin: list[int], blocks: list[int], names: list[str], shards: int):
    """Shard and block of every slot, given its number through all sources; ``begin``: the first slot of each source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, size = np.array(begin, "int64"), np.array(blocks, "int64")
        ends: dict[int, np.ndarray] = {}
        for batch in batches:
            at = batch.column("id").to_numpy(zero_copy_only=False).astype("int64")
            k = np.searchsorted(first, at, side="right") - 1
            slot = at - first[k]
            shard = np.empty(len(at), "int32")
            for source in np.unique(k).tolist():
                if source not in ends:
                    # the same draw wherever a slot of the source is made
                    drawn = np.random.default_rng([seed, source]).multinomial(size[source], np.full(shards, 1.0 / shards))
                    ends[source] = np.cumsum(drawn)
                own = k == source
                shard[own] = np.searchsorted(ends[source], slot[own], side="right")
            with np.errstate(over="ignore"):
                key = k.astype("uint64") * np.uint64(0x94D049BB133111EB) + np.uint64(seed)
                block = permute(slot, size[k], key).astype("int64")
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard), pa.array(names, pa.string()).take(pa.array(k)), pa.array(slot), pa.array(block)],
                names=["shard", "source", "slot", "block"],
            )

    return run


def placed_documents(sized: DataFrame, seed: int = SEED) -> DataFrame:
    """(source, doc_id, n_tokens, first_token): where each document begins in its source's stream of tokens."""
    buckets = max(1, -(-sized.count() // BUCKET_DOCUMENTS))
    mixed = F.xxhash64("doc_id", F.lit(seed))
    rows = sized.withColumn("_h", mixed).withColumn("_bucket", F.pmod("_h", F.lit(buckets)))
    sums = rows.groupBy("source", "_bucket").agg(F.sum("n_tokens").alias("_sum"))
    before = F.coalesce(
        F.sum("_sum").over(
            Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        ),
        F.lit(0),
    )
    begins = sums.select("source", "_bucket", before.alias("_begin"))
    inside = Window.partitionBy("source", "_bucket").orderBy("_h", "doc_id")
    running = F.sum("n_tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens")
    return (
        rows.withColumn("_in", running)
        .join(begins, ["source", "_bucket"])
        .select("source", "doc_id", "n_tokens", (F.col("_begin") + F.col("_in")).alias("first_token"))
    )


class Mixture:
    """The plan of one mixture; ``blocks()``, ``selection()`` and ``report()`` are its results."""

    def __init__(
        self,
        docs: DataFrame,
        targets: DataFrame,
        block_tokens: int = BLOCK_TOKENS,
        shards: int = SHARDS,
        seed: int = SEED,
        total_tokens: int | None = None,
        vocabulary: str | None = None,
    ) -> None:
        spark = docs.sparkSession
        self.block_tokens, self.seed = block_tokens, seed
        held = targets.where("source is not null").select("source", "target_share", "max_repeats")
        wanted = held.orderBy("source").limit(MOST_SOURCES + 1).collect()
        if len(wanted) > MOST_SOURCES:
            raise ValueError(f"more than {MOST_SOURCES} sources have a target")
        # the side broadcast here has at most MOST_SOURCES short names
        named = docs.select("doc_id", "source", "text").join(
            F.broadcast(held.select("source").distinct()), "source", "left_semi"
        )
        sized = token_counts(named, ["doc_id", "source"], "text", vocabulary).where("n_tokens > 0")
        self.sized = written(sized, "sizes")
        have = {
            r["source"]: (r["n"], r["docs"])
            for r in self.sized.groupBy("source")
            .agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("docs"))
            .collect()
        }
        total = sum(n for n, _ in have.values()) if total_tokens is None else total_tokens
        self.plan = []
        for r in wanted:
            n, _ = have.get(r["source"], (0, 0))
            share, repeats = r["target_share"] or 0.0, r["max_repeats"] or 0
            tokens = max(0, min(round(total * share), repeats * n))
            # tokens of the source, tokens to take and their blocks
            self.plan.append((r["source"], float(share), int(repeats), n, tokens, -(-tokens // block_tokens), total * share))
        self.shards = shards

    def slots(self) -> DataFrame:
        """(shard, source, slot, block) of every slot of the output; ``block`` numbers the source's repeated stream."""
        spark = self.sized.sparkSession
        used = [p for p in self.plan if p[5]]
        begin = np.concatenate(([0], np.cumsum([p[5] for p in used]))).astype("int64").tolist()
        # slots of a task: some megabytes
        ids = spark.range(0, begin[-1], 1, max(1, min(begin[-1] // 200_000, 100_000)))
        made = _slots(self.seed, begin[:-1], [p[5] for p in used], [p[0] for p in used], self.shards)
        return ids.mapInArrow(made, "shard int, source string, slot long, block long")

    def blocks(self) -> DataFrame:
        """(shard, source, slot, use_no, block, doc_id, token_from, token_to): the pieces of every slot.

        ``token_from`` and ``token_to`` (exclusive) count inside the document.
        """
        spark = self.sized.sparkSession
        size = F.lit(self.block_tokens).cast("long")
        begin, n = F.col("first_token"), F.col("n_tokens")
        every = lambda a, b: F.explode(F.sequence(a, b))
        # a document's part of each block of the stream that it touches
        pieces = (
            placed_documents(self.sized, self.seed)
            .withColumn("cell", every(F.floor(begin / size).cast("long"), F.floor((begin + n - 1) / size).cast("long")))
            .select(
                "source",
                "cell",
                "doc_id",
                "first_token",
                F.greatest(begin, F.col("cell") * size).alias("_a"),
                F.least(begin + n, (F.col("cell") + 1) * size).alias("_b"),
            )
        )
        # at most MOST_SOURCES rows
        plan = spark.createDataFrame(
            [(p[0], p[3], p[4]) for p in self.plan if p[5]], "source string, stream long, tokens long"
        )
        # the slot's tokens in the repeated stream, in each repeat, and the blocks of the stream that hold them
        at = (
            self.slots()
            .join(F.broadcast(plan), "source")
            .withColumn("_from", F.col("block") * size)
            .withColumn("_to", F.least((F.col("block") + 1) * size, "tokens"))
            .withColumn("_use", every(F.floor(F.col("_from") / F.col("stream")).cast("long"), F.floor((F.col("_to") - 1) / F.col("stream")).cast("long")))
            .withColumn("_f", F.greatest("_from", F.col("_use") * F.col("stream")) - F.col("_use") * F.col("stream"))
            .withColumn("_t", F.least("_to", (F.col("_use") + 1) * F.col("stream")) - F.col("_use") * F.col("stream"))
            .withColumn("cell", every(F.floor(F.col("_f") / size).cast("long"), F.floor((F.col("_t") - 1) / size).cast("long")))
        )
        a, b = F.greatest("_f", "_a"), F.least("_t", "_b")
        return (
            at.join(pieces, ["source", "cell"])
            .where(a < b)
            .select(
                "shard",
                "source",
                "slot",
                (F.col("_use") + 1).cast("int").alias("use_no"),
                "block",
                "doc_id",
                (a - F.col("first_token")).alias("token_from"),
                (b - F.col("first_token")).alias("token_to"),
            )
        )

    def selection(self) -> DataFrame:
        """(source, doc_id, use_no, tokens): one row per document and use, whole or in part."""
        used = F.sum(F.col("token_to") - F.col("token_from")).alias("tokens")
        return self.blocks().groupBy("source", "doc_id", "use_no").agg(used)

    def report(self) -> DataFrame:
        """One row per target: shares wanted and reached, tokens, shortfall and highest use."""
        spark = self.sized.sparkSession
        plan = spark.createDataFrame(
            [(p[0], p[1], p[2], p[3], p[6]) for p in self.plan],
            "source string, target_share double, max_repeats int, source_tokens long, target_tokens double",
        )
        uses = self.selection().groupBy("source").agg(
            F.sum("tokens").alias("tokens"),
            F.count(F.lit(1)).alias("document_uses"),
            F.max("use_no").alias("most_uses"),
        )
        tokens = F.coalesce("tokens", F.lit(0))
        whole = F.sum(tokens).over(Window.partitionBy(F.lit(1)))
        return plan.join(uses, "source", "left").select(
            "source",
            "target_share",
            F.round(tokens / F.nullif(whole, F.lit(0)), 6).alias("reached_share"),
            "max_repeats",
            F.coalesce("most_uses", F.lit(0)).alias("most_uses"),
            "source_tokens",
            F.round("target_tokens").cast("long").alias("target_tokens"),
            tokens.alias("reached_tokens"),
            F.greatest(F.lit(0), F.round("target_tokens").cast("long") - tokens).alias("shortfall_tokens"),
            F.coalesce("document_uses", F.lit(0)).alias("document_uses"),
        )
