"""DuckDB SQL for the flat tables of nested records, generated from the same table definitions."""

from __future__ import annotations

from filingloom.operators.nested import PAYLOAD_TARGETS, SEMANTIC_ROW_TARGETS, Step, Target, _camel

_LISTS = sorted({name for t in (*PAYLOAD_TARGETS, *SEMANTIC_ROW_TARGETS) for step in t.steps if step.many for name in step.names})


def _open(value: str) -> str:
    """JSON inside text as what it holds."""
    return f"CASE WHEN json_type({value}) = 'VARCHAR' THEN TRY_CAST(json_extract_string({value}, '$') AS JSON) ELSE {value} END"


def _source(target: Target) -> tuple[str, str]:
    if target in SEMANTIC_ROW_TARGETS:
        return "id", """TRY_CAST('{"semantic_rows":' || semantic_rows || '}' AS JSON)"""
    return "doc_id", "TRY_CAST(payload AS JSON)"


def _step(n: int, step: Step) -> str:
    named = " UNION ALL ".join(f"SELECT root_key, path, owner, parent, position, CASE WHEN path = '' THEN '{name}' ELSE path || '.{name}' END AS here, {_open('v0')} AS v FROM (SELECT *, json_extract(o, '$.{name}') AS v0 FROM s{n})" for name in step.names)
    if not step.many:
        return f"n{n} AS ({named}), s{n + 1} AS (SELECT root_key, here AS path, owner, parent, position, v AS o FROM n{n} WHERE json_type(v) = 'OBJECT')"
    spread = f"SELECT root_key, here, owner, list, unnest(range(CAST(json_array_length(list) AS BIGINT))) AS i FROM (SELECT *, CASE json_type(v) WHEN 'ARRAY' THEN v WHEN 'OBJECT' THEN json_array(v) END AS list FROM n{n})"
    items = f"SELECT root_key, here || '[' || i || ']' AS path, owner AS parent, i AS position, {_open('e')} AS o FROM (SELECT *, list->i AS e FROM ({spread}))"
    return f"n{n} AS ({named}), s{n + 1} AS (SELECT root_key, path, path AS owner, parent, position, o FROM ({items}) WHERE json_type(o) = 'OBJECT')"


def _field(name: str, kind: str) -> str:
    sql = {"string": "VARCHAR", "int": "INTEGER", "double": "DOUBLE"}[kind]
    spelled = ", ".join(f"json_extract_string(o, '$.{s}')" for s in dict.fromkeys((name, _camel(name))))
    return f'TRY_CAST(coalesce({spelled}) AS {sql}) AS "{name}"'


def table_sql(target: Target) -> str:
    key, document = _source(target)
    source = "parsed_tables" if key == "id" else "parsed_documents"
    steps = ", ".join(_step(n, step) for n, step in enumerate(target.steps))
    fields = "".join(", " + _field(*f) for f in target.fields)
    root = f"s0 AS (SELECT {key} AS root_key, '' AS path, '' AS owner, '' AS parent, 0 AS position, {_open('d')} AS o FROM (SELECT {key}, {document} AS d FROM {source}))"
    return f"WITH {root}, {steps} SELECT root_key, path AS child_path, parent AS parent_path, position::INTEGER AS list_position{fields} FROM s{len(target.steps)}"


def _list_names() -> str:
    return ", ".join(f"'{n}'" for n in _LISTS)


#: Every object in a list at any depth, by recursion over all keys.
FOUND = f"""
WITH RECURSIVE walk AS (
  SELECT root_key, path, {_open('v')} AS v, false AS element FROM (
    SELECT doc_id AS root_key, '' AS path, TRY_CAST(payload AS JSON) AS v FROM parsed_documents
    UNION ALL SELECT id, '', TRY_CAST('{{"semantic_rows":' || semantic_rows || '}}' AS JSON) FROM parsed_tables)
  UNION ALL
  SELECT root_key, path, {_open('v')} AS v, element FROM (
    SELECT root_key, CASE WHEN is_list THEN path || '[' || i || ']' WHEN path = '' THEN k ELSE path || '.' || k END AS path, is_list AS element,
      CASE WHEN is_list THEN v->i ELSE (CASE WHEN list_contains([{_list_names()}], k) AND json_type({_open('j')}) = 'OBJECT' THEN json_array({_open('j')}) ELSE j END) END AS v
    FROM (
      SELECT root_key, path, v, is_list, i, k, json_extract(v, '$."' || k || '"') AS j FROM (
        SELECT root_key, path, v, json_type(v) = 'ARRAY' AS is_list, CASE WHEN json_type(v) = 'ARRAY' THEN unnest(range(CAST(json_array_length(v) AS BIGINT))) END AS i, CAST(NULL AS VARCHAR) AS k FROM walk WHERE json_type(v) = 'ARRAY'
        UNION ALL SELECT root_key, path, v, false, CAST(NULL AS BIGINT), unnest(json_keys(v)) FROM walk WHERE json_type(v) = 'OBJECT')
    )
  ) WHERE v IS NOT NULL AND json_type(v) IN ('OBJECT', 'ARRAY', 'VARCHAR') AND (json_type(v) <> 'VARCHAR' OR left(ltrim(json_extract_string(v, '$')), 1) IN ('[', '{{', '"'))
)
SELECT root_key, path AS child_path FROM walk WHERE element AND json_type(v) = 'OBJECT'
UNION ALL SELECT job_id, 'events[' || i || ']' FROM (SELECT job_id, events, unnest(range(len(events))) AS i FROM ingestion_jobs) WHERE events[i + 1] IS NOT NULL
"""

JOB_EVENTS = """
SELECT job_id AS root_key, 'events[' || i || ']' AS child_path, '' AS parent_path, i::INTEGER AS list_position, e.timestamp AS timestamp, e.status AS status, e.stage AS stage, e.progress_percent AS progress_percent, e.message AS message
FROM (SELECT job_id, i, events[i + 1] AS e FROM (SELECT job_id, events, unnest(range(len(events))) AS i FROM ingestion_jobs)) WHERE e IS NOT NULL
"""


def oracle_sql() -> dict[str, str]:
    found = {f"p5_{t.name}": table_sql(t) for t in (*PAYLOAD_TARGETS, *SEMANTIC_ROW_TARGETS)}
    return {**found, "p5_found": FOUND, "p5_job_events": JOB_EVENTS, "p5_other_lists": f"SELECT root_key, child_path, '' AS parent_path, 0 AS list_position, '' AS item FROM ({FOUND}) WHERE false"}
