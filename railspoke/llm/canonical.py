"""Free-entered values mapped to the entries of a reference list.

The entries of the list, and their aliases, are folded (case, accents,
look-alike letters, white space, underscores, hyphens and colons) and stored in
one trie per field. A value is folded the same way and turned into a
Levenshtein automaton: bit i of word ``R[e]`` says that the automaton can be at
position i of the value after ``e`` edits (insertion, deletion, substitution,
swap of neighbours). The trie is walked with that automaton, so whole subtrees
are left as soon as no state survives; every entry whose end is accepted within
the length-dependent distance comes back with its distance.

Before the search the value is read in several ways, which are the alias paths
of the query: as it is, without a leading ``field=``, without bracketed or
appended remarks on age, extent or state, and, where it ends in a dot, as an
abbreviation (all entries below the trie node it leads to). The first reading
that needs no edit wins, then an abbreviation, then the fewest edits. Words
that remark are data: the argument ``remarks``.

Defined results: null and blank values and values of several elements are no
cases; a value that equals an entry of its field character for character is no
case; a value that means no entry comes out with ``unmatched``. Ties between
entries are broken by the longer common prefix, then the smaller length
difference, then the alphabetically first entry. Copied rows each come out; an
empty reference list leaves every value unmatched. A list too long for one trie
is cut into slices; both ways give the same rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railspoke.operators.lineage import written
from railspoke.operators.packed import long_fields, parse_value

UNMATCHED = "unmatched"

#: Cyrillic and Greek letters that look like Latin ones, and the letters they stand for.
LOOKALIKES = str.maketrans("аеорсухіјѕԁһοαντ", "aeopcyxijsdhoavt")
#: Default of ``remarks``: words that remark on age, extent or state, in English and German.
REMARKS = frozenset(
    "old new alt alte alter neu neue neuer mostly partly partially mainly meist meistens teils teilweise "
    "ueberwiegend überwiegend wet dry nass feucht trocken damaged broken kaputt schlecht gut good bad "
    "side east west north south ost nord sued süd seite so called sogenannt sogenannte sog very sehr "
    "probably wohl ca about approx circa".split()
)

_SEPARATING = re.compile(r"[\s_\-:]+")
_EDGE = re.compile(r"^[\s?!.,;'\"~*]+|[\s?!.,;'\"~*]+$")
_BRACKETED = re.compile(r"[(\[{][^()\[\]{}]*[)\]}]")
_PART = re.compile(r"[,;/|]")
_YEAR = re.compile(r"(?:19|20)\d\d")
_WORDS = re.compile(r"\s+")


def limit_of(value: int, entry: int) -> int:
    """Edits allowed between a folded value and a folded entry of so many characters."""
    length = min(value + 1, max(value, entry)) if value > 4 else value
    return 0 if length <= 3 else 1 if length <= 5 else 2 if length <= 9 else 3


def fold(text: str) -> str:
    """Lower case, without accents, look-alikes, white space, underscores, hyphens and colons."""
    text = text.lower().translate(LOOKALIKES).replace("ß", "ss")
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return _SEPARATING.sub("", text)


def fold_umlauts(text: str) -> str:
    """As fold, with umlauts written out."""
    low = text.lower()
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue")):
        low = low.replace(a, b)
    return fold(low)


class Trie:
    """Entries of one field. A node is [children, entries that end here]."""

    def __init__(self, entries: Iterable[tuple[str, str]]) -> None:
        """entries: (alias, canonical)."""
        self.root: list = [{}, None]
        self.longest = 0
        for alias, canonical in entries:
            for word in {fold(alias), fold_umlauts(alias)}:
                if not word:
                    continue
                node = self.root
                for c in word:
                    node = node[0].setdefault(c, [{}, None])
                node[1] = (node[1] or set()) | {canonical}
                self.longest = max(self.longest, len(word))

    def within(self, word: str, most: int) -> list[tuple[int, str, str]]:
        """(edits, entry's folded form, canonical) of every entry within ``most`` edits of the word."""
        n = len(word)
        if n > self.longest + most:
            return []
        full = (1 << (n + 1)) - 1
        masks: dict[str, int] = {}
        for i, c in enumerate(word):
            masks[c] = masks.get(c, 0) | (1 << i)
        accept = 1 << n
        start = tuple((1 << (e + 1)) - 1 & full for e in range(most + 1))
        found = []
        stack = [(self.root, start, (0,) * (most + 1), 0, "")]
        while stack:
            node, now, before, last, path = stack.pop()
            if node[1]:
                for e, r in enumerate(now):
                    if r & accept:
                        found += [(e, path, canonical) for canonical in node[1]]
                        break
            for c, child in node[0].items():
                m = masks.get(c, 0)
                r = [(now[0] & m) << 1]
                for e in range(1, most + 1):
                    r.append(
                        (
                            ((now[e] & m) << 1)
                            | now[e - 1]
                            | (now[e - 1] << 1)
                            | (r[e - 1] << 1)
                            | ((before[e - 1] & m & (last >> 1)) << 2)
                        )
                        & full
                    )
                if r[most]:
                    stack.append((child, tuple(r), now, m, path + c))
        return found

    def below(self, prefix: str) -> list[tuple[str, str]]:
        """(folded form, canonical) of every entry that begins with the prefix."""
        node = self.root
        for c in prefix:
            node = node[0].get(c)
            if node is None:
                return []
        out, stack = [], [(node, prefix)]
        while stack:
            node, path = stack.pop()
            out += [(path, canonical) for canonical in node[1] or ()]
            stack += [(child, path + c) for c, child in node[0].items()]
        return out


def readings(element: str, field: str, remarks: frozenset[str] = REMARKS) -> list[str]:
    """The ways to read one element, the plainest first, without repeats."""
    whole = _EDGE.sub("", element)
    key = re.match(rf"\s*{re.escape(field)}\s*[=:]\s*(?=\S)", whole, re.I)
    if key:
        whole = _EDGE.sub("", whole[key.end() :])
    out = [whole]
    plain = _EDGE.sub("", _BRACKETED.sub(" ", whole))
    out.append(plain)
    out += [_EDGE.sub("", p) for p in _PART.split(plain)[:1]]
    for text in out[:]:
        words = [w for w in _WORDS.split(text) if w]
        kept = [w for w in words if _EDGE.sub("", w).lower() not in remarks and not _YEAR.fullmatch(w)]
        if kept and len(kept) < len(words):
            out.append(_EDGE.sub("", " ".join(kept)))
    return list(dict.fromkeys(w for w in out if w))


#: Kinds of answer, the best first: a reading without edits, an abbreviation, edits, none, and a value that is an entry.
READ, SHORT, EDITED, NONE, ENTRY = range(5)


def _rank(word: str, path: str) -> tuple[int, int]:
    shared = 0
    for a, b in zip(word, path, strict=False):
        if a != b:
            break
        shared += 1
    return -shared, abs(len(word) - len(path))


def best_match(element: str, field: str, trie: Trie | None, remarks: frozenset[str] = REMARKS) -> tuple | None:
    """The rank (kind, number, number, number, canonical) of the entry meant; None if no entry is meant.

    The smallest rank of any slices of a list is the rank of the whole list.
    """
    if trie is None:
        return None
    best = None
    ways = readings(element, field, remarks)
    for k, text in enumerate(ways):
        for word in dict.fromkeys((fold(text), fold_umlauts(text))):
            for edits, path, canonical in trie.within(word, limit_of(len(word), len(word) + 1)):
                if edits > limit_of(len(word), len(path)):
                    continue
                kind = (EDITED, edits) if edits else (READ, k)
                rank = (*kind, *_rank(word, path), canonical)
                if best is None or rank < best:
                    best = rank
        if best and best[0] == READ:
            return best
    if element.rstrip().endswith("."):
        word = fold(ways[0]) if ways else ""
        under = trie.below(word) if len(word) >= 3 else []
        if under:
            path, canonical = min(under, key=lambda x: (len(x[0]), x[1]))
            return (SHORT, len(path), 0, 0, canonical)
    return best


class Answers:
    """What values mean, by the entries (field, alias, canonical) of a list or a slice of it."""

    def __init__(self, entries: Iterable[tuple[str, str, str]], remarks: frozenset[str]) -> None:
        by: dict[str, list[tuple[str, str]]] = {}
        for field, alias, canonical in entries:
            by.setdefault(field, []).append((alias, canonical))
        self.tries = {field: Trie(x) for field, x in by.items()}
        self.exact = {field: {c for _, c in x} for field, x in by.items()}
        self.remarks = remarks
        self.known: dict[tuple[str, str], tuple | None] = {}

    def of(self, field: str, value: str) -> tuple | None:
        """The rank; None for values of several elements or none."""
        at = (field, value)
        if at not in self.known:
            if len(self.known) > 500_000:
                self.known.clear()
            self.known[at] = self.search(field, value)
        return self.known[at]

    def search(self, field: str, value: str) -> tuple | None:
        if value in self.exact.get(field, ()):
            return (ENTRY, 0, 0, 0, value)
        elements = parse_value(value)
        if len(elements) != 1:
            return None
        return best_match(elements[0][0], field, self.tries.get(field), self.remarks) or (NONE, 0, 0, 0, UNMATCHED)


def _matcher(entries: list[tuple[str, str, str]], remarks: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answers = Answers(entries, remarks)
        for batch in batches:
            fields = batch.column("tag_field").dictionary_encode()
            values = batch.column("value").dictionary_encode()
            names, texts = fields.dictionary.to_pylist(), values.dictionary.to_pylist()
            pair = fields.indices.to_numpy(zero_copy_only=False).astype("int64") * max(1, len(texts))
            pair += values.indices.to_numpy(zero_copy_only=False)
            unique, codes = np.unique(pair, return_inverse=True)
            got = [answers.of(names[u // len(texts)], texts[u % len(texts)]) for u in unique.tolist()]
            keep = np.array([g is not None and g[0] != ENTRY for g in got], bool)[codes]
            if not keep.any():
                continue
            out = batch.drop_columns(["value"]).take(pa.array(np.flatnonzero(keep)))
            meant = pa.array([g[4] if g else None for g in got], pa.string()).take(pa.array(codes[keep]))
            yield pa.RecordBatch.from_arrays([*out.columns, meant], names=[*out.schema.names, "canonical"])

    return run


_RANKED = "tag_field string, value string, r0 int, r1 int, r2 int, r3 int, canonical string"


def _sliced(remarks: frozenset[str]):
    """Answers of one slice to one block of values, co-grouped."""

    def run(values: pa.Table, entries: pa.Table) -> pa.Table:
        held = zip(*(entries.column(c).to_pylist() for c in ("tag_field", "alias", "canonical")), strict=True)
        answers = Answers(held, remarks)
        asked = zip(*(values.column(c).to_pylist() for c in ("tag_field", "value")), strict=True)
        rows = [(f, v, *r) for f, v in asked if (r := answers.search(f, v)) is not None]
        kinds = [pa.string(), pa.string(), *[pa.int32()] * 4, pa.string()]
        names = ["tag_field", "value", "r0", "r1", "r2", "r3", "canonical"]
        columns = zip(*rows, strict=True) if rows else [[] for _ in names]
        return pa.table([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return run


def map_to_canonical(
    rows: DataFrame,
    key: str,
    fields: list[str],
    reference: DataFrame,
    slice_rows: int = 100_000,
    remarks: Iterable[str] = REMARKS,
    block_values: int = 100_000,
) -> DataFrame:
    """(key, tag_field, canonical) of each case; see the module for what a case is.

    ``reference`` has ``tag_field``, ``canonical`` and ``label_de``. Rows are
    matched where they are read, each distinct value of a worker once, without
    a shuffle. A list of more than ``slice_rows`` entries is cut into slices by
    hash, in the executors: each distinct value meets each slice, in blocks of
    about ``block_values``, and its best answer is joined back to its rows. So
    no task, nor the driver, holds more than one slice.
    """
    remarks = frozenset(remarks)
    entries = reference.where("tag_field is not null and canonical is not null")
    label = F.coalesce("label_de", "canonical")
    entries = entries.select("tag_field", F.explode(F.array("canonical", label)).alias("alias"), "canonical").distinct()
    long = long_fields(rows, key, fields).where(F.col("value").isNotNull())
    kind = dict(rows.dtypes)[key]
    n = entries.count()
    if n <= slice_rows:
        # at most slice_rows entries
        held = [tuple(r) for r in entries.collect()]
        for f in fields if n <= 2000 else []:
            same = sorted({c for field, _, c in held if field == f})
            if same:
                long = long.where((F.col("tag_field") != f) | ~F.col("value").isin(same))
        return long.mapInArrow(_matcher(held, remarks), f"`{key}` {kind}, tag_field string, canonical string")
    slices = -(-n // slice_rows)
    values = written(long.select("tag_field", "value").distinct(), "values")
    blocks = max(1, -(-values.count() // block_values))
    part = F.pmod(F.xxhash64("tag_field", "canonical"), F.lit(slices))
    every = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long")))
    left = values.withColumn("block", F.pmod(F.xxhash64("tag_field", "value"), F.lit(blocks))).withColumn("slice", every(slices))
    right = entries.withColumn("slice", part).withColumn("block", every(blocks))
    ranked = left.groupBy("slice", "block").cogroup(right.groupBy("slice", "block")).applyInArrow(_sliced(remarks), _RANKED)
    order = F.struct((F.col("r0") != ENTRY).alias("_other"), "r0", "r1", "r2", "r3", "canonical")
    best = ranked.groupBy("tag_field", "value").agg(F.min(order).alias("_b")).where("_b.r0 <> 4")
    return long.join(best, ["tag_field", "value"]).select(key, "tag_field", F.col("_b.canonical").alias("canonical"))
