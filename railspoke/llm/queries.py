"""The registered queries of the training-data operators, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from railspoke.llm.canonical import map_to_canonical
from railspoke.llm.mixing import Mixture
from railspoke.llm.term_frequency import frequency_spectrum, marked_frequencies, useless_terms
from railspoke.llm.tokenizer import encode_corpus, token_counts
from railspoke.llm.truncation import truncated_texts, truncation_rates
from railspoke.sources.tables import table

TAGS = ["surface", "highway"]


def _edges(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "edges")


def _docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents")


def _mixture(s: SparkSession, d: str) -> Mixture:
    return Mixture(_docs(s, d), table(s, d, "mix_targets"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": lambda s, d: useless_terms(_edges(s, d), "row_id", TAGS),
        "p1_frequencies": lambda s, d: marked_frequencies(_edges(s, d), "row_id", TAGS),
        "p1_spectrum": lambda s, d: frequency_spectrum(_edges(s, d), "row_id", TAGS),
        "p2_found": lambda s, d: map_to_canonical(_edges(s, d), "row_id", TAGS, table(s, d, "tag_reference")),
        "p2_counts": lambda s, d: map_to_canonical(_edges(s, d), "row_id", TAGS, table(s, d, "tag_reference"))
        .groupBy("tag_field", "canonical")
        .count()
        .withColumnRenamed("count", "n_rows"),
        "p7_ids": lambda s, d: encode_corpus(_docs(s, d)),
        "p7_counts": lambda s, d: token_counts(_docs(s, d), ["doc_id"]),
        "p8_blocks": lambda s, d: _mixture(s, d).blocks(),
        "p8_selection": lambda s, d: _mixture(s, d).selection(),
        "p8_report": lambda s, d: _mixture(s, d).report(),
        "p9_found": lambda s, d: truncated_texts(_docs(s, d)).select("doc_id"),
        "p9_evidence": lambda s, d: truncated_texts(_docs(s, d)).groupBy("why").agg(F.count(F.lit(1)).alias("texts")),
        "p9_rates": lambda s, d: truncation_rates(_docs(s, d)),
    }
