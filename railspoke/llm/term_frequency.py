"""Frequency of every term of a collection, by an external sort and a run-length scan.

Each record's terms are cut out once and written, one row per field that is not
null, from which the fields' totals are counted too. The (field, term, record
id) triples are then range-partitioned by the whole triple, so a term that
fills a third of the collection spreads over as many partitions as its share
needs, and sorted inside each partition (Spark's sorter spills to disk). A
linear scan counts the runs of equal (field, term): equal record ids of a run
are one record. Only one row per run and partition is left for the last, small
aggregation that joins runs cut by a partition boundary; equal triples always
lie in one partition, so the sums are exact.

A term is a longest run of letters, digits and underscores of the lower-cased
value (Unicode letters and numbers). Null and empty values have no term; a
field without any value has no row; repeated rows count each. Record ids must
be unique per row for the number of records to be the number of rows; copies
of one id count as one record, and so do all rows whose id is null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from railspoke.operators.lineage import written
from railspoke.operators.packed import long_fields

#: Fixed values of problem 1: at most so many records is rare, more than this share of the non-null records is common.
RARE_RECORDS = 2
COMMON_SHARE = 0.05

TERM_PATTERN = r"[\p{L}\p{N}_]+"


def term_lists(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(tag_field, key, terms) of each value that is not null; a term stands as often as it occurs."""
    long = long_fields(rows, key, fields).where(F.col("value").isNotNull())
    terms = F.regexp_extract_all(F.lower("value"), F.lit(TERM_PATTERN), F.lit(0))
    return long.select("tag_field", F.col(key).alias("key"), terms.alias("terms"))


def _same(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Whether neighbours are equal; null equals null."""
    both = pc.and_(pc.is_null(a), pc.is_null(b))
    return pc.or_(pc.fill_null(pc.equal(a, b), False), both).to_numpy(zero_copy_only=False)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of sorted (tag_field, term, key) rows as (tag_field, term, occurrences, records)."""
    schema = pa.schema(
        [("tag_field", pa.string()), ("term", pa.string()), ("occurrences", pa.int64()), ("records", pa.int64())]
    )
    open_run: tuple | None = None  # (tag_field, term, last key, occurrences, records)

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema
        )

    for batch in batches:
        size = batch.num_rows
        if not size:
            continue
        field, term, key = batch.columns
        if size == 1:
            begin, new_key = np.array([0]), np.array([True])
        else:
            same = _same(field[1:], field[:-1]) & _same(term[1:], term[:-1])
            begin = np.concatenate(([0], np.flatnonzero(~same) + 1))
            new_key = np.concatenate(([True], ~_same(key[1:], key[:-1]) | ~same))
        occurrences = np.diff(np.append(begin, size))
        records = np.add.reduceat(new_key.astype("int64"), begin)
        at = pa.array(begin)
        fields, terms = field.take(at).to_pylist(), term.take(at).to_pylist()
        runs = [list(r) for r in zip(fields, terms, occurrences.tolist(), records.tolist(), strict=True)]
        first_key, last_key = key[0].as_py(), key[size - 1].as_py()
        if open_run is not None:
            if open_run[:2] == (runs[0][0], runs[0][1]):
                runs[0][2] += open_run[3]
                runs[0][3] += open_run[4] - (open_run[2] == first_key)
            else:
                runs.insert(0, [open_run[0], open_run[1], open_run[3], open_run[4]])
        last = runs.pop()
        open_run = (last[0], last[1], last_key, last[2], last[3])
        if runs:
            yield emit(runs)
    if open_run is not None:
        yield emit([(open_run[0], open_run[1], open_run[3], open_run[4])])


def counted_terms(lists: DataFrame) -> DataFrame:
    """(tag_field, term, occurrences, records) of the terms of ``term_lists``."""
    order = ["tag_field", "term", "key"]
    runs = (
        lists.select("tag_field", F.explode("terms").alias("term"), "key")
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .mapInArrow(_scan, "tag_field string, term string, occurrences long, records long")
    )
    return runs.groupBy("tag_field", "term").agg(
        F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records")
    )


def term_frequencies(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(tag_field, term, occurrences, records) of every term of the fields."""
    return counted_terms(written(term_lists(rows, key, fields), "terms"))


def marked_frequencies(
    rows: DataFrame,
    key: str,
    fields: list[str],
    rare_records: int = RARE_RECORDS,
    common_share: float = COMMON_SHARE,
) -> DataFrame:
    """(tag_field, term, occurrences, records, mark): mark is ``rare``, ``common`` or null.

    Where a term is both (a tiny collection), ``rare`` is given.
    """
    lists = written(term_lists(rows, key, fields), "terms")
    totals = lists.groupBy(F.col("tag_field").alias("_f")).agg(F.count(F.lit(1)).alias("_total"))
    mark = F.when(F.col("records") <= rare_records, "rare").when(
        F.col("records") > F.lit(common_share) * F.col("_total"), "common"
    )
    freq = counted_terms(lists)
    # one row per field: the joined side has len(fields) rows whatever the input
    joined = freq.join(F.broadcast(totals), F.col("tag_field") == F.col("_f"))
    return joined.select("tag_field", "term", "occurrences", "records", mark.alias("mark"))


def useless_terms(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(tag_field, term, mark) of the terms too rare or too common to tell records apart."""
    return marked_frequencies(rows, key, fields).where("mark is not null").select("tag_field", "term", "mark")


def frequency_spectrum(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(tag_field, mark, terms, occurrences): how much of the collection each mark holds."""
    marked = marked_frequencies(rows, key, fields)
    return marked.groupBy("tag_field", F.coalesce("mark", F.lit("kept")).alias("mark")).agg(
        F.count(F.lit(1)).alias("terms"), F.sum("occurrences").alias("occurrences")
    )


def top_terms(rows: DataFrame, key: str, fields: list[str], k: int = 20) -> DataFrame:
    """The k most frequent terms of each field, ties by term (a top-k report)."""
    w = Window.partitionBy("tag_field").orderBy(F.desc("records"), "term")
    ranked = marked_frequencies(rows, key, fields).withColumn("rank", F.row_number().over(w))
    return ranked.where(F.col("rank") <= k)
