"""SQL of the training-data queries that SQL can express on whole tables."""

from __future__ import annotations

_FREQ = r"""
WITH v AS (
  SELECT row_id, 'surface' AS tag_field, surface AS value FROM edges
  UNION ALL SELECT row_id, 'highway', highway FROM edges
), t AS (
  SELECT row_id, tag_field, unnest(regexp_extract_all(lower(value), '[\p{L}\p{N}_]+')) AS term FROM v
), totals AS (
  SELECT tag_field, count(value) AS total FROM v GROUP BY 1
), f AS (
  SELECT tag_field, term, count(*) AS occurrences, count(DISTINCT row_id) AS records FROM t GROUP BY 1, 2
), marked AS (
  SELECT tag_field, term, occurrences, records,
    CASE WHEN records <= 2 THEN 'rare' WHEN records > 0.05::DOUBLE * total THEN 'common' END AS mark
  FROM f JOIN totals USING (tag_field)
)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _FREQ + "SELECT tag_field, term, mark FROM marked WHERE mark IS NOT NULL",
        "p1_frequencies": _FREQ + "SELECT tag_field, term, occurrences, records, mark FROM marked",
        "p1_spectrum": _FREQ
        + """SELECT tag_field, coalesce(mark, 'kept') AS mark, count(*) AS terms,
            sum(occurrences)::BIGINT AS occurrences FROM marked GROUP BY ALL""",
    }
