"""Byte-level BPE encoding of a corpus with a public vocabulary.

A text is cut into words by the vocabulary's pattern. Each word is encoded with
a contiguous rank array: the part boundaries of the word's bytes and, beside
each boundary, the rank of joining the two parts that meet there. The smallest
rank is searched, its boundary deleted and the two neighbouring ranks
refreshed, until no join is left. Searching is linear, which is fastest for the
short words that make up nearly all text; words of more than ``LONG_WORD``
bytes use a heap over the same ranks, so a word of any length costs n log n.

Defined results: null and empty texts give an empty list; strings that look
like special tokens are ordinary text; no special tokens are added. Texts are
read whole, whatever their length. Nothing is shuffled.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

#: Fixed value: the pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

DEFAULT_PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"
LONG_WORD = 96
CACHED_WORDS = 400_000
CACHED_WORD_LENGTH = 48
NO_RANK = 1 << 60


def default_path() -> str:
    """The vocabulary: ``RAILSPOKE_VOCABULARY`` if set, else the box's public file."""
    return os.environ.get("RAILSPOKE_VOCABULARY", DEFAULT_PATH)


class ByteBPE:
    def __init__(self, lines: bytes) -> None:
        """lines: a vocabulary file, a token in base 64 and its rank on each line."""
        import regex

        self.ranks: dict[bytes, int] = {}
        for line in lines.splitlines():
            token, _, rank = line.rstrip().partition(b" ")
            if token:
                self.ranks[base64.b64decode(token)] = int(rank)
        self.find = regex.compile(PATTERN).findall
        self.known: dict[str, list[int]] = {}

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        ids: list[int] = []
        known = self.known
        for word in self.find(text):
            got = known.get(word)
            if got is None:
                got = self.word(word)
            ids += got
        return ids

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        known = self.known
        n = 0
        for word in self.find(text):
            got = known.get(word)
            n += len(self.word(word) if got is None else got)
        return n

    def word(self, word: str) -> list[int]:
        data = word.encode("utf-8")
        whole = self.ranks.get(data)
        if whole is not None:
            ids = [whole]
        elif len(data) <= LONG_WORD:
            ids = self.merge_short(data)
        else:
            ids = self.merge_long(data)
        if len(word) <= CACHED_WORD_LENGTH:
            if len(self.known) >= CACHED_WORDS:
                self.known.clear()
            self.known[word] = ids
        return ids

    def merge_short(self, data: bytes) -> list[int]:
        """The contiguous rank array: cut[i] begins part i, rank[i] is that of joining parts i and i + 1."""
        get = self.ranks.get
        cut = list(range(len(data) + 1))
        rank = [get(data[i : i + 2], NO_RANK) for i in range(len(data) - 1)]
        while rank:
            least = min(rank)
            if least == NO_RANK:
                break
            i = rank.index(least)
            del cut[i + 1], rank[i]
            if i < len(rank):
                rank[i] = get(data[cut[i] : cut[i + 2]], NO_RANK)
            if i:
                rank[i - 1] = get(data[cut[i - 1] : cut[i + 1]], NO_RANK)
        return [self.ranks[data[a:b]] for a, b in zip(cut, cut[1:], strict=False)]

    def merge_long(self, data: bytes) -> list[int]:
        """The same merges from a heap of (rank, position), with the parts as a linked list."""
        get, n = self.ranks.get, len(data)
        end = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i]
            if not alive[i] or j >= n or end[j] != stop:
                continue
            alive[j] = False
            end[i] = stop
            if stop < n:
                before[stop] = i
                if (r := get(data[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            p = before[i]
            if p >= 0 and (r := get(data[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        return [self.ranks[data[i : end[i]]] for i in range(n) if alive[i]]


def vocabulary(spark: SparkSession, path: str | None = None) -> Broadcast:
    """The vocabulary file as the executors get it: read once, by the driver or from a shared file system, and sent.

    A file of fixed size (about 1 MB for 50,000 tokens), whatever the corpus.
    """
    path = path or default_path()
    if os.path.exists(path):
        with open(path, "rb") as f:
            lines = f.read()
    else:
        lines = bytes(spark.read.format("binaryFile").load(path).select("content").first()["content"])
    return spark.sparkContext.broadcast(lines)


@lru_cache(maxsize=4)
def encoder(lines: bytes) -> ByteBPE:
    """One encoder per vocabulary and worker process."""
    return ByteBPE(lines)


def _encode(words: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(words.value)
        for batch in batches:
            # a few long texts at a time: the ids of a batch are held as one array
            for part in _bounded(batch):
                lists = [bpe.encode(t) for t in part.column("text").to_pylist()]
                sizes = np.fromiter(map(len, lists), "int32", len(lists))
                flat = np.fromiter((i for x in lists for i in x), "int32", int(sizes.sum(dtype="int64")))
                offsets = np.concatenate(([0], np.cumsum(sizes))).astype("int32")
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                rest = part.drop_columns(["text"])
                yield pa.RecordBatch.from_arrays([*rest.columns, ids], names=[*rest.schema.names, "ids"])

    return run


def _count(words: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(words.value)
        for batch in batches:
            n = pa.array([bpe.count(t.as_py()) for t in batch.column("text")], pa.int64())
            rest = batch.drop_columns(["text"])
            yield pa.RecordBatch.from_arrays([*rest.columns, n], names=[*rest.schema.names, "n_tokens"])

    return run


def _bounded(batch: pa.RecordBatch, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``most`` bytes of text each, one row at least."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype("int64")
    begin, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += n
    if begin < batch.num_rows:
        yield batch.slice(begin)


def _select(docs: DataFrame, keep: list[str], text: str) -> tuple[DataFrame, str]:
    chosen = docs.select(*keep, docs[text].alias("text"))
    kinds = dict(chosen.dtypes)
    return chosen, ", ".join(f"`{k}` {kinds[k]}" for k in keep)


def encode_corpus(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, ids) of every document."""
    chosen, schema = _select(docs, [key], text)
    return chosen.mapInArrow(_encode(vocabulary(docs.sparkSession, path)), f"{schema}, ids array<int>")


def token_counts(docs: DataFrame, keep: list[str], text: str = "text", path: str | None = None) -> DataFrame:
    """The kept columns and ``n_tokens`` of every document; ids are counted, not kept."""
    chosen, schema = _select(docs, keep, text)
    return chosen.mapInArrow(_count(vocabulary(docs.sparkSession, path)), f"{schema}, n_tokens long")
