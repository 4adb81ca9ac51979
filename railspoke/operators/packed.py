"""Several values packed in one field: one row per element, with its position.

The fields are read with a parsing expression grammar. Alternatives are tried
in the order written; the first that matches wins, and a failed alternative
gives its input back (backtracking)::

    value     <- ws bracketed ws END / items END
    items     <- item (separator item)*
    item      <- ws (quoted / bracketed / bare)? ws
    bracketed <- '[' items ']' / '{' items '}'         before a boundary only
    quoted    <- q (q q / '\\\\' q / !q any)* q        before a boundary only
    bare      <- (!separator !closing any)+
    separator <- [;,|/+&] / line break

``boundary`` is the end of the value, a separator or the closing mark of the
surrounding list. A quote that is never closed, or that is followed by other
text, fails ``quoted``; its input is then read again as ``bare`` and the
element carries the flag ``unbalanced_quote``. A bracket that opens a list but
fails ``bracketed`` is flagged ``unbalanced_bracket`` in the same way. Colons,
underscores, hyphens, spaces and round brackets never separate.

Defined results: null, empty and blank values have no element; empty elements
do not count and take no position; a doubled or escaped quote inside quotes
stands for one quote; lists nest to any depth (open lists lie on a stack, not in
calls), and each mark that failed is remembered. Reading takes time linear in the
text, times the depth of lists that are closed but followed by other text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the grammar.
SEPARATORS = ";,|/+&\n\r"
QUOTES = "\"'"
CLOSING = {"[": "]", "{": "}"}

#: No value without one of these can hold two elements (FIRST set of ``separator``).
SEPARATOR_PATTERN = "[;,|/+&\\n\\r]"

_SPACE = re.compile(r"\s*")
_BARE = {
    "": re.compile(r"[^;,|/+&\n\r]+"),
    "]": re.compile(r"[^;,|/+&\n\r\]]+"),
    "}": re.compile(r"[^;,|/+&\n\r}]+"),
}
_QUOTED = {
    '"': re.compile(r'"((?:[^"\\]|""|\\.|\\)*+)"(?!")', re.S),
    "'": re.compile(r"'((?:[^'\\]|''|\\.|\\)*+)'(?!')", re.S),
}
_BLANK = re.compile(r"[^\S\n\r]*")

NO_ERROR, BAD_QUOTE, BAD_BRACKET = "", "unbalanced_quote", "unbalanced_bracket"


class Grammar:
    """One parse of one value. Lists that are open lie on a stack: where they begin, their closing mark, elements before them."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.end = len(text)
        self.out: list[tuple[str, str]] = []
        self.open: list[tuple[int, str, int]] = []
        self.failed: set[tuple[int, str]] = set()
        #: Where a list or a quote can be closed at last.
        self.last = {mark: text.rfind(mark) for mark in (*CLOSING.values(), *QUOTES)}

    def parse(self) -> list[tuple[str, str]]:
        pos = 0
        while True:
            pos = self.item(pos)
            # after an element: the next one, the end of its list, or of the value
            while pos < self.end and self.open and self.text[pos] == self.open[-1][1]:
                after = self.boundary(pos + 1, self.open[-2][1] if len(self.open) > 1 else "")
                if after < 0:
                    pos = self.give_up(len(self.open) - 1)
                else:
                    self.open.pop()
                    pos = after
            if pos < self.end:
                # nothing else can stand here than a separator
                pos += 1
            elif self.open:
                k = len(self.open) - 1
                # nor can a list be closed whose mark does not come any more after what is given up
                while k and self.last[self.open[k - 1][1]] < self.open[k][0]:
                    k -= 1
                pos = self.give_up(k)
                if pos < self.end and self.text[pos] in SEPARATORS:
                    pos += 1
                elif pos < self.end:
                    continue
            else:
                return self.out

    def closing(self) -> str:
        return self.open[-1][1] if self.open else ""

    def item(self, pos: int) -> int:
        """The position after the next element; lists that it opens are entered."""
        while True:
            pos = _BLANK.match(self.text, pos).end()
            if pos == self.end:
                return pos
            first, flag = self.text[pos], NO_ERROR
            if first in QUOTES:
                after = self.quoted(pos, first)
                if after >= 0:
                    return after
                flag = BAD_QUOTE
            elif first in CLOSING:
                own = CLOSING[first]
                if self.last[own] > pos and (pos, self.closing()) not in self.failed:
                    self.open.append((pos, own, len(self.out)))
                    pos += 1
                    continue
                flag = BAD_BRACKET
            return self.bare(pos, flag)

    def give_up(self, k: int) -> int:
        """Backtracks to the k-th open list, which is no list, and reads its opening mark as bare text."""
        begin, _, mark = self.open[k]
        del self.open[k:], self.out[mark:]
        self.failed.add((begin, self.closing()))
        return self.bare(begin, BAD_BRACKET)

    def boundary(self, pos: int, closing: str) -> int:
        pos = _BLANK.match(self.text, pos).end()
        if pos == self.end:
            return -1 if closing else pos
        return pos if self.text[pos] in SEPARATORS or self.text[pos] == closing else -1

    def quoted(self, pos: int, quote: str) -> int:
        m = _QUOTED[quote].match(self.text, pos) if self.last[quote] > pos else None
        if not m:
            return -1
        after = self.boundary(m.end(), self.closing())
        if after < 0:
            return -1
        self.add(m.group(1).replace(quote * 2, quote).replace("\\" + quote, quote), NO_ERROR)
        return after

    def bare(self, pos: int, flag: str) -> int:
        m = _BARE[self.closing()].match(self.text, pos)
        if not m:
            return pos
        self.add(m.group(), flag)
        return m.end()

    def add(self, body: str, flag: str) -> None:
        body = body.strip()
        if body:
            self.out.append((body, flag))


def parse_value(text: str | None) -> list[tuple[str, str]]:
    """(element, flag) of each element of one value, in order."""
    if text is None or not text.strip():
        return []
    return Grammar(text).parse()


def parse_unique(values: pa.Array) -> tuple[np.ndarray, list[list[tuple[str, str]]]]:
    """Codes of the rows and the elements of each distinct value of one Arrow batch."""
    coded = values.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    return codes, [parse_value(v) for v in coded.dictionary.to_pylist()]


def _split(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            codes, parsed = parse_unique(batch.column("value"))
            sizes = np.array([len(p) if len(p) >= least else 0 for p in parsed])
            each = sizes[codes]
            if not each.sum():
                continue
            rows = np.repeat(np.arange(batch.num_rows), each)
            # where each distinct value's elements lie in one flat list
            flat = [e for p, n in zip(parsed, sizes, strict=True) if n for e in p]
            begin = np.cumsum(sizes) - sizes
            nth = np.arange(len(rows)) - np.repeat(np.cumsum(each) - each, each)
            take = pa.array(begin[codes[rows]] + nth)
            keys = batch.drop_columns(["value"]).take(pa.array(rows))
            elements = pa.array([e for e, _ in flat], pa.string()).take(take)
            flags = pa.array([f or None for _, f in flat], pa.string()).take(take)
            yield pa.RecordBatch.from_arrays(
                [*keys.columns, pa.array((nth + 1).astype("int32")), elements, flags],
                names=[*keys.schema.names, "pos", "element", "error"],
            )

    return run


def long_fields(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, tag_field, value) of each named field, one row per field; other columns are left behind."""
    pairs = F.array(*[F.struct(F.lit(f).alias("tag_field"), F.col(f).alias("value")) for f in fields])
    return rows.select(F.col(key), F.explode(pairs).alias("_p")).select(key, "_p.tag_field", "_p.value")


def split_packed(rows: DataFrame, key: str, fields: list[str], least: int = 1) -> DataFrame:
    """(key, tag_field, pos, element, error) of each element of values with at least ``least`` elements.

    No shuffle: values are parsed where they are read, each distinct value of a
    batch once. With ``least`` above 1, values without a separator stay in the
    JVM, since the grammar can give them one element at most.
    """
    where = None
    for f in fields:
        one = F.col(f).rlike(SEPARATOR_PATTERN) if least > 1 else F.col(f).isNotNull()
        where = one if where is None else where | one
    long = long_fields(rows.where(where), key, fields)
    long = long.where(F.col("value").rlike(SEPARATOR_PATTERN) if least > 1 else F.col("value").isNotNull())
    kind = dict(rows.dtypes)[key]
    schema = f"`{key}` {kind}, tag_field string, pos int, element string, error string"
    return long.mapInArrow(_split(least), schema)
