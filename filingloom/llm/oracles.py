"""DuckDB SQL for the llm queries that SQL can express."""

from filingloom.llm.survivor import ABSENT, FIELDS

_MARKS = ", ".join(f"'{m}'" for m in ABSENT)
#: Blanks of every kind at the edges, as the query trims them.
_TRIMMED = r"regexp_replace({0}, '^[\s \x{{3000}}\x{{200b}}\x{{feff}}]+|[\s \x{{3000}}\x{{200b}}\x{{feff}}]+$', '', 'g')"


def _field(name: str) -> str:
    text = _TRIMMED.format(name)
    return f"""
SELECT company_id, metric_key, period, '{name}' AS field_name, candidate_id, {name} AS kept FROM (
  SELECT *, row_number() OVER (PARTITION BY company_id, metric_key, period ORDER BY both_flags DESC, g DESC, p DESC, coalesce(source_priority, 0) DESC, coalesce(document_year, 0) DESC, coalesce(document_id, '') DESC, extracted_at DESC NULLS LAST, candidate_id DESC) AS place
  FROM sized WHERE n >= 2 AND {name} IS NOT NULL AND {text} <> '' AND lower({text}) NOT IN ({_MARKS})
) WHERE place = 1"""


_WINNERS = "WITH sized AS (SELECT *, coalesce(has_provenance, false) AS p, coalesce(is_grounded, false) AS g, coalesce(has_provenance, false) AND coalesce(is_grounded, false) AS both_flags, count(*) OVER (PARTITION BY company_id, metric_key, period) AS n FROM conflict_candidates WHERE company_id IS NOT NULL AND metric_key IS NOT NULL AND period IS NOT NULL), w AS (" + " UNION ALL ".join(_field(f) for f in FIELDS) + ")"
_WIDE = ", ".join(f"max(CASE WHEN field_name = '{f}' THEN kept END) AS {f}, max(CASE WHEN field_name = '{f}' THEN w.candidate_id END) AS {f}_from" for f in FIELDS)

ORACLES = {
    "p4_found": f"{_WINNERS} SELECT company_id, metric_key, period, field_name, candidate_id FROM w",
    "p4_records": f"{_WINNERS}, s AS (SELECT company_id, metric_key, period, count(*) AS candidates FROM sized WHERE n >= 2 GROUP BY 1, 2, 3) SELECT company_id, metric_key, period, candidates, {_WIDE} FROM s LEFT JOIN w USING (company_id, metric_key, period) GROUP BY 1, 2, 3, 4",
}
