"""Texts cut off by field limits, found from word trigrams, in pure SQL.

Every word of every text is counted with the two words before it, once as
*inside* (another word follows), once as *stop* (a sentence or paragraph ends
there) and once as *last* (the text ends there without a mark). The final
trigram of each text that does not end with a mark is joined with these counts
and the text is flagged where the trigram is frequent inside texts but almost
never stands at an end.

* A word carries the mark that follows it (comma, colon, opening or closing
  bracket, hyphen, ampersand), so a text that ends in a comma or an opened
  bracket is judged by how often that word, or such a word, stands inside with
  that mark. The word without its mark counts as inside, since more follows.
  Tags are words of their own. What stands in brackets is counted apart, as
  words that begin with a bracket, so that more must follow the last of them.
* Words cut in the middle never occur inside texts, so the counts of the
  *longer* words that begin with them, in the same place, stand on the inside.
  They come from running sums over the sorted words: the words that begin with
  p lie between p and the last string that begins with p. Nothing is cut into
  prefixes, and words may have any length.
* Context words below ``COMMON_SHARE`` of all words (names, mostly) count as one
  class, else most trigrams would be seen once. Where the final trigram is too
  rare for a judgement, the decision backs off, in this order, to: the word
  being the beginning of known words but no word itself; the trigram with a rare
  last word as a class; any word after the word before it; the last two words; the last
  word; its mark. ``why``
  names the evidence that decided.
* A text that a length limit of its source's field cut exactly before a mark has
  a last trigram that ends sentences. Such a text is flagged (``limit``) where
  its length is a peak of the lengths of its source.

Before counting, closed quotes and mark-up are taken out; trailing dots that
stand for left-out text, and a last character that was cut to bytes (U+FFFD),
are taken off.

Defined results: null, empty and blank texts are no cases, nor are texts that
end with a sentence mark, smiley, closing bracket or quote. Counts are over all
texts, copies included.

Skew: all counts are aggregates with partial aggregation; running sums are
taken within a context and the first two letters, over distinct words. The list
of common words has at most ``1 / COMMON_SHARE`` rows whatever the input, and is
the only broadcast side.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railspoke.operators.lineage import written

#: A word is common if it makes up this share of all words; so there are 1 / share common words at most.
COMMON_SHARE = 0.00008
#: Occurrences a trigram needs to decide.
LEAST = 5
#: A trigram that stops or ends in a smaller share of its occurrences is an inside one.
STOP_SHARE = 0.4
#: A word is no word itself where it occurs less often than this share of the longer words.
WORD_SHARE = 0.05
#: A length of which a source has this many times the texts that it has of the lengths around is a limit of its field.
LIMIT_PEAK = 8.0
#: Words whose dot ends no sentence.
ABBREVIATIONS = ("st", "dr", "nr", "ca")

# The text in lower case without closed quotes and inline mark-up, accents folded, each number as 0.
# Patterns are tried only on texts that hold what they look for.
_CLEAN = r"""
  SELECT id, source, chars, bytes, regexp_replace(IF(chars = bytes, t, {folded}), '[0-9]+', '0') AS clean
  FROM (SELECT id, source, chars, bytes, IF(contains(t, '&'), regexp_replace(replace(t, '&szlig;', 'ss'),
      r'&([a-z])(uml|acute|grave|circ|cedil|tilde);|&#39;|&nbsp;', '$1'), t) AS t
  FROM (SELECT id, source, chars, bytes, IF(contains(t, '['), regexp_replace(t, r'\[/?[a-z]+(=[^\]]*)?\]', ''), t) AS t
  FROM (SELECT id, source, chars, bytes, IF(startswith(t, '>') OR contains(t, '\n>'), regexp_replace(t, r'(?m)(^[^\n]*:\n)?(^>[^\n]*\n)+', '\n'), t) AS t
  FROM (SELECT id, source, chars, bytes, IF(contains(t, '<blockquote>'), {block2}, t) AS t
  FROM (SELECT id, source, chars, bytes, IF(contains(t, '[quote'), {quote2}, t) AS t
  FROM (SELECT {key} AS id, {source} AS source, length(text) AS chars, octet_length(text) AS bytes, lower(text) AS t
    FROM {docs} WHERE text IS NOT NULL AND trim(text) <> ''))))))
"""


def _folded(t: str) -> str:
    """SQL of the text without accents: a replacement per letter, which costs a fraction of one by character."""
    plain = {"a": "äàâá", "o": "öôó", "u": "üûùú", "e": "éèêë", "c": "ç", "i": "îïí", "n": "ñ", "ss": "ß", "\\'": "’"}
    for to, letters in plain.items():
        for x in letters:
            t = f"replace({t}, '{x}', '{to}')"
    return t


def _twice(pattern: str) -> str:
    """Innermost blocks out, then those around them."""
    return f"regexp_replace(regexp_replace(t, r'{pattern}', '\\n'), r'{pattern}', '\\n')"


_QUOTE2 = _twice(r"\[quote[^\]]*\][^\[]*+(?:\[(?!/?quote)[^\[]*+)*+\[/quote\]")
_BLOCK2 = _twice(r"<blockquote>[^<]*+(?:<(?!/?blockquote)[^<]*+)*+</blockquote>")

# Words with the mark that follows them, tags, smileys, sentence marks, line breaks.
_TOKEN = (
    r"[\p{L}\p{N}_]+(?:[-.\x27][\p{L}\p{N}_]+)*(?:[,;:)]|\x27$| ?(?:\(|&(?:amp;|#?[a-z0-9]{0,7}$)|[-–/](?=\s|$)))?"
    r"|</?[a-z][^<>]*(?:>|$)|<$|[:;=]-?[()\[\]/|dpo](?![\p{L}\p{N}])"
    r"|(?<!\b(?:{abbreviations}))[.!?…。]+(?=[\s\x22»)\]]|$)|\)|\n"
)

# White space as it may stand at the end of a text, for linear trimming.
_BLANKS = r" \n\t\r\u000b\u000c\u00a0\u0000"

# What stands in brackets; a smiley opens none.
_BRACKET = r"(?<![:;=\-])\([^()\n]*\)?"

_INNER = r"transform(filter(regexp_extract_all(p, r'{token}', 0), t -> left(t, 1) RLIKE r'[\p{L}\p{N}_]'), t -> concat('(', t))"

_TOKENS = r"""
WITH shaped AS (
  SELECT id, source, chars, bytes,
    -- without dots that stand for left-out text, and without a character cut to bytes
    trim(TRAILING '{blanks}' FROM CASE
      WHEN endswith(clean, '[...]') THEN left(clean, length(clean) - 5)
      WHEN endswith(clean, '…') THEN left(clean, length(clean) - 1)
      WHEN endswith(clean, '...') AND right(clean, 4) RLIKE r'^[^.!?\s]' THEN left(clean, length(clean) - 3)
      WHEN endswith(clean, '\ufffd') THEN trim(TRAILING '\ufffd' FROM clean)
      ELSE clean END) AS body
  FROM (SELECT id, source, chars, bytes, trim(TRAILING '{blanks}' FROM clean) AS clean FROM ({clean}))
)
SELECT id, source, chars, bytes,
  body RLIKE r'(?:[\p{L}\p{N}_,;:(\-–/&\x27#]|<[^<>]*)$' AS unmarked,
  IF(size(pieces) = 0, regexp_extract_all(body, r'{token}', 0), concat(
    flatten(transform(filter(pieces, p -> right(p, 1) = ')'), p -> concat({inner}, array('$', '$')))),
    regexp_extract_all(regexp_replace(body, r'{bracket}', '('), r'{token}', 0),
    flatten(transform(filter(slice(pieces, -1, 1), p -> right(p, 1) <> ')' AND p RLIKE r'[\p{L}\p{N}_]'), p -> concat(array('$', '$'), {inner})))
  )) AS tokens
FROM (SELECT *, IF(contains(body, '('), regexp_extract_all(body, r'{bracket}', 0), array()) AS pieces FROM shaped)
"""

_STOPS = "('.', '!', '?', '…', '。', ')', '$', '\\n', ':', ';', '=')"
_MARKS = " ,;:)(/&-–'"


def _word(t: str) -> str:
    """SQL of a token without its mark; a reference to a character is a mark, marks alone and line breaks are stops."""
    return rf"""CASE WHEN left({t}, 1) IN {_STOPS} THEN '$' WHEN left({t}, 1) = '<' THEN regexp_replace({t}, r'\s[^>]*', '')
      WHEN contains({t}, '&') THEN rtrim(substring_index({t}, '&', 1)) ELSE rtrim("{_MARKS}", {t}) END"""


def _mark(t: str) -> str:
    return f"""CASE WHEN left({t}, 1) IN {_STOPS} OR left({t}, 1) = '<' THEN '' WHEN contains({t}, '&') THEN '&'
      ELSE ltrim(substring({t}, length(rtrim("{_MARKS}", {t})) + 1)) END"""


# A word with a mark counts as such and as the bare word, to which a closing bracket is what follows inside.
# What follows a tag does not matter. The tokens are laid beside themselves, shifted, so that nothing is looked up by number.
_GRAMS = f"""
WITH shifted AS (
  SELECT concat(array('$', '$'), tokens) AS a, concat(array('$'), tokens) AS b, tokens AS c, slice(tokens, 2, size(tokens)) AS d FROM {{marked}} WHERE size(tokens) > 0
), each AS (
  SELECT {_word("g.a")} AS w1, {_word("g.b")} AS w2, {_word("g.c")} AS w3, {_mark("g.c")} AS k, g.d AS next
  FROM (SELECT explode(arrays_zip(a, b, c, d)) AS g FROM shifted) WHERE g.c IS NOT NULL AND left(g.c, 1) NOT IN {_STOPS}
), marks AS (
  SELECT w1, w2, w3, k3, k3 = '' AND k = ')' AS closed, next IS NULL AS at_end, left(w3, 1) <> '<' AND left(next, 1) IN {_STOPS[:-1]}, '<') AS at_stop
  FROM (SELECT *, explode(IF(k = '', array(''), array(k, ''))) AS k3 FROM each)
)
  SELECT w1, w2, w3, k3, count_if(closed OR NOT at_end AND NOT at_stop) AS inside,
    count_if(NOT closed AND NOT at_end AND at_stop) AS stop, count_if(NOT closed AND at_end) AS last
  FROM marks GROUP BY 1, 2, 3, 4
"""

_WORDS = r"""
  SELECT w3 AS w, sum(inside) AS inside, sum(stop) AS stop, sum(last) AS last FROM {grams} WHERE k3 = '' GROUP BY 1
"""

_COMMON = r"""
  SELECT w FROM {words}
  JOIN (SELECT sum(inside + stop + last) AS n FROM {words} WHERE left(w, 1) <> '<') ON inside + stop + last >= greatest({common_share} * n, 2)
"""

_CLASS = "IF(left({0}, 1) IN ('$', '<'), '$', coalesce({1}.w, '*'))"

_EXACT = rf"""
WITH classed AS (
  SELECT /*+ BROADCAST(a), BROADCAST(b), BROADCAST(c) */
    {_CLASS.format("w1", "a")} AS m1, {_CLASS.format("w2", "b")} AS m2, w3, k3, coalesce(c.w, '*') AS m3, inside, stop, last
  FROM {{grams}}
  LEFT JOIN {{common}} a ON w1 = a.w LEFT JOIN {{common}} b ON w2 = b.w LEFT JOIN {{common}} c ON w3 = c.w
)
  SELECT m1, m2, w3, k3, m3, sum(inside) AS inside, sum(stop) AS stop, sum(last) AS last
  FROM classed GROUP BY 1, 2, 3, 4, 5
"""

_BY_CLASS = r"""
  SELECT m1, m2, m3, k3, sum(inside) AS inside, sum(stop) AS stop, sum(last) AS last FROM {exact} GROUP BY 1, 2, 3, 4
"""

_FINAL = rf"""
  SELECT /*+ BROADCAST(a), BROADCAST(b), BROADCAST(c) */ id,
    {_CLASS.format("w1", "a")} AS m1, {_CLASS.format("w2", "b")} AS m2, w3, k3, coalesce(c.w, '*') AS m3, source, chars, bytes
  FROM (
    SELECT id, source, chars, bytes, {_word("t[0]")} AS w1, {_word("t[1]")} AS w2, {_word("t[2]")} AS w3, {_mark("t[2]")} AS k3
    FROM (SELECT *, slice(concat(array('$', '$'), tokens), -3, 3) AS t FROM {{marked}} WHERE unmarked AND size(tokens) > 0)
    WHERE left(t[2], 1) NOT IN {_STOPS}
  )
  LEFT JOIN {{common}} a ON w1 = a.w LEFT JOIN {{common}} b ON w2 = b.w LEFT JOIN {{common}} c ON w3 = c.w
"""


def _longer(rows: str, finals: str, place: str) -> str:
    """SQL of (place, p, n): how often words that go on after p, with a letter or a dot (a tag: or its end; in brackets: or a number), stand in the place.

    ``rows``: place, w, n; ``finals``: place, p. Each p sends four probes into the sorted words, two for
    each range; the running sums at its ends differ by what lies between. Words of one letter have their own key.
    """
    span = f"PARTITION BY {place}two, lead ORDER BY w, turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    return f"""
  SELECT {place}p, sum(IF(sign = 0, 0, sign * run)) AS n FROM (
    SELECT {place}p, sign, sum(n) OVER ({span}) AS run FROM (
      SELECT {place}two, IF(two, left(w, 2), left(w, 1)) AS lead, w, 1 AS turn, n, CAST(NULL AS STRING) AS p, 0 AS sign
      FROM (SELECT *, explode(array(true, false)) AS two FROM ({rows})) WHERE length(w) > 1
        AND (two OR EXISTS (SELECT 1 FROM ({finals}) o WHERE length(o.p) = 1 AND o.p = left(w, 1)))
      UNION ALL
      SELECT {place}length(p) > 1, left(p, IF(length(p) > 1, 2, 1)), concat(p, e.upto), IF(e.sign < 0, 0, 2), 0L, p, e.sign
      FROM (SELECT *, explode(array(named_struct('upto', 'a', 'sign', -1), named_struct('upto', '\U0010ffff', 'sign', 1),
        named_struct('upto', mark, 'sign', -1), named_struct('upto', concat(mark, '\U0010ffff'), 'sign', 1))) AS e
        FROM (SELECT *, CASE left(p, 1) WHEN '<' THEN '>' WHEN '(' THEN '0' ELSE '.' END AS mark FROM ({finals})))
    )
  ) WHERE p IS NOT NULL GROUP BY {place}p"""


_LONGER = _longer(
    """SELECT m1, m2, w3 AS w, sum(inside + stop + last) AS n FROM {exact}
      LEFT SEMI JOIN (SELECT DISTINCT m1 AS x1, m2 AS x2 FROM {final}) ON m1 = x1 AND m2 = x2 WHERE k3 = '' GROUP BY 1, 2, 3""",
    "SELECT DISTINCT m1, m2, w3 AS p FROM {final} WHERE k3 = ''",
    "m1, m2, ",
)
_LONGER_WORDS = _longer("SELECT w, inside + stop AS n FROM {words}", "SELECT DISTINCT w3 AS p FROM {final} WHERE k3 = ''", "")

_VERDICTS = rf"""
WITH by_place AS (
  SELECT m1, m2, k3, sum(inside) AS inside, sum(stop) AS stop, sum(last) AS last FROM {{by_class}} GROUP BY 1, 2, 3
), by_two AS (
  SELECT m2, m3, k3, sum(inside) AS inside, sum(stop) AS stop, sum(last) AS last FROM {{by_class}} GROUP BY 1, 2, 3
), by_one AS (
  SELECT m3, k3, sum(inside) AS inside, sum(stop) AS stop, sum(last) AS last FROM by_two GROUP BY 1, 2
), by_mark AS (
  SELECT k3, sum(inside) AS inside, sum(stop) AS stop, sum(last) AS last FROM by_one GROUP BY 1
), counted AS (
  SELECT f.m1, f.m2, f.w3, f.k3,
    CASE
      WHEN e.stop + e.last + e.inside >= {{least}} AND coalesce(l.n, 0) = 0 THEN 'trigram'
      WHEN coalesce(e.stop + e.last + e.inside, 0) + coalesce(l.n, 0) >= {{least}} THEN 'longer trigram'
      WHEN coalesce(u.inside + u.stop, 0) < {{word_share}} * coalesce(lw.n, 0) THEN 'unknown word'
      WHEN c.stop + c.last + c.inside >= {{least}} THEN 'class'
      WHEN f.m2 <> '$' AND p.stop + p.last + p.inside >= {{least}} THEN 'place'
      WHEN t.stop + t.last + t.inside >= {{least}} THEN 'two words'
      WHEN o.stop + o.last + o.inside >= {{least}} THEN 'word'
      ELSE 'mark'
    END AS why,
    coalesce(e.stop + e.last, 0) AS e_end, coalesce(e.stop + e.last + e.inside, 0) + coalesce(l.n, 0) AS e_all,
    c.stop + c.last AS c_end, c.stop + c.last + c.inside AS c_all,
    p.stop + p.last AS p_end, p.stop + p.last + p.inside AS p_all,
    t.stop + t.last AS t_end, t.stop + t.last + t.inside AS t_all,
    o.stop + o.last AS o_end, o.stop + o.last + o.inside AS o_all,
    k.stop + k.last AS k_end, k.stop + k.last + k.inside AS k_all,
    -- ends a sentence, mostly before a mark: at a length limit the mark is what was cut off
    c.stop > c.last AS before_mark
  FROM (SELECT DISTINCT m1, m2, w3, k3, m3 FROM {{final}}) f
  LEFT JOIN {{exact}} e ON e.m1 = f.m1 AND e.m2 = f.m2 AND e.w3 = f.w3 AND e.k3 = f.k3
  LEFT JOIN {{longer}} l ON l.m1 = f.m1 AND l.m2 = f.m2 AND l.p = f.w3 AND f.k3 = ''
  LEFT JOIN {{words}} u ON u.w = f.w3
  LEFT JOIN {{longer_words}} lw ON lw.p = f.w3 AND f.k3 = ''
  LEFT JOIN {{by_class}} c ON c.m1 = f.m1 AND c.m2 = f.m2 AND c.m3 = f.m3 AND c.k3 = f.k3
  LEFT JOIN by_place p ON p.m1 = f.m1 AND p.m2 = f.m2 AND p.k3 = f.k3
  LEFT JOIN by_two t ON t.m2 = f.m2 AND t.m3 = f.m3 AND t.k3 = f.k3
  LEFT JOIN by_one o ON o.m3 = f.m3 AND o.k3 = f.k3
  LEFT JOIN by_mark k ON k.k3 = f.k3
), judged AS (
  SELECT m1, m2, w3, k3, why, before_mark, why = 'unknown word' OR CASE why
    WHEN 'class' THEN c_end < {{stop_share}} * c_all
    WHEN 'place' THEN p_end < {{stop_share}} * p_all
    WHEN 'two words' THEN t_end < {{stop_share}} * t_all
    WHEN 'word' THEN o_end < {{stop_share}} * o_all
    WHEN 'mark' THEN k_end < {{stop_share}} * k_all
    ELSE e_end < {{stop_share}} * e_all END AS cut
  FROM counted
), lengths AS (
  SELECT source, unit, n, count(*) AS texts FROM (
    SELECT source, explode(map('chars', chars, 'bytes', bytes)) AS (unit, n) FROM {{marked}}
  ) GROUP BY 1, 2, 3
), limits AS (
  SELECT DISTINCT source, unit, explode(IF(unit = 'bytes', sequence(n - 3, n), array(n))) AS n FROM (
    SELECT source, unit, n, texts, (sum(texts) OVER (
      PARTITION BY source, unit ORDER BY n RANGE BETWEEN 25 PRECEDING AND 25 FOLLOWING) - texts) / 50 AS around
    FROM lengths
  ) WHERE texts >= {{least}} AND texts >= {{limit_peak}} * around
)
SELECT f.id AS {{key}}, IF(j.cut, j.why, 'limit') AS why FROM {{final}} f
JOIN judged j ON j.m1 = f.m1 AND j.m2 = f.m2 AND j.w3 = f.w3 AND j.k3 = f.k3
LEFT JOIN limits c ON c.source <=> f.source AND c.unit = 'chars' AND c.n = f.chars
LEFT JOIN limits b ON b.source <=> f.source AND b.unit = 'bytes' AND b.n = f.bytes
WHERE j.cut OR (j.before_mark AND f.k3 = '' AND (c.n IS NOT NULL OR b.n IS NOT NULL))
"""


def _filled(text: str, **values: object) -> str:
    for name, value in values.items():
        text = text.replace("{" + name + "}", str(value))
    return text


def truncated_texts(
    docs: DataFrame,
    key: str = "doc_id",
    source: str = "source",
    common_share: float = COMMON_SHARE,
    least: int = LEAST,
    stop_share: float = STOP_SHARE,
    word_share: float = WORD_SHARE,
    limit_peak: float = LIMIT_PEAK,
    abbreviations: tuple[str, ...] = ABBREVIATIONS,
) -> DataFrame:
    """(key, why) of every text of which only a first part is stored.

    One statement per step. Steps that several later ones read are written once
    to the shared folder, so that no text is cut and no trigram counted twice.
    """
    spark = docs.sparkSession
    run = uuid.uuid4().hex
    values = {
        "key": key,
        "source": source,
        "token": _TOKEN.replace("{abbreviations}", "|".join(abbreviations)),
        "blanks": _BLANKS,
        "bracket": _BRACKET,
        "folded": _folded("t"),
        "quote2": _QUOTE2,
        "block2": _BLOCK2,
        "common_share": f"{common_share!r}D",
        "least": least,
        "stop_share": f"{stop_share!r}D",
        "word_share": f"{word_share!r}D",
        "limit_peak": f"{limit_peak!r}D",
    }
    views = []

    def view(name: str, rows: DataFrame) -> None:
        values[name] = f"railspoke_{name}_{run}"
        rows.createOrReplaceTempView(values[name])
        views.append(values[name])

    try:
        view("docs", docs.select(key, source, "text"))
        values |= {
            "clean": _filled(_CLEAN, **values),
            "inner": _filled(_INNER, **values),
        }
        for name, text in (
            ("marked", _TOKENS),
            ("grams", _GRAMS),
            ("words", _WORDS),
            ("common", _COMMON),
            ("exact", _EXACT),
            ("by_class", _BY_CLASS),
            ("final", _FINAL),
            ("longer", _LONGER),
            ("longer_words", _LONGER_WORDS),
        ):
            view(name, written(spark.sql(_filled(text, **values)), name))
        return spark.sql(_filled(_VERDICTS, **values))
    finally:
        for v in views:
            spark.catalog.dropTempView(v)


def truncation_rates(docs: DataFrame, key: str = "doc_id", source: str = "source", **limits: float) -> DataFrame:
    """(source, texts, truncated, rate) of each source; ``texts`` counts the texts that are not null."""
    cut = truncated_texts(docs, key, source, **limits).select(key, F.lit(1).alias("_cut"))
    rows = docs.select(key, source, F.col("text").isNotNull().alias("_text")).join(cut, key, "left")
    texts, n = F.count_if("_text"), F.count("_cut")
    return rows.groupBy(source).agg(
        texts.alias("texts"), n.alias("truncated"), F.round(n / F.nullif(texts, F.lit(0)), 6).alias("rate")
    )
