"""Deeply nested records turned into related flat tables (problem 5).

Every target table is a path of list steps below the document. One higher-order SQL projection per
table walks that path: nested ``transform`` calls carry the ancestor keys and positions along,
``flatten`` merges the arrays of one level, and a single ``inline`` per target table emits rows.
Nothing is exploded twice and no row is shuffled.

Rules for irregular input, the same for every table:

* a lone object where a list belongs is element 0;
* text that itself holds JSON counts as what it holds, at any level, the document included;
* both the snake_case and the camelCase spelling of a key are read; the path keeps the one found;
* null elements keep their position and yield no row; a missing or null list yields no row;
* elements that are no objects (numbers, plain text, lists) yield no row;
* text that is no JSON yields no row and never fails the query;
* objects of lists that no target names are not dropped: ``list_objects`` walks every other key
  as well, ``REST_DEPTH`` levels in each of ``REST_STAGES`` steps, and files them under
  ``OTHER_LISTS``; what lies deeper still raises an error instead of being lost;
* a field whose name is one of ``GENERATED`` gets the prefix ``field_``.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Step:
    """One step of a path; ``many`` says whether it leads into a list or into a single object."""

    names: tuple[str, ...]
    many: bool = True


def _camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(part.capitalize() for part in rest)


def each(name: str) -> Step:
    return Step(tuple(dict.fromkeys((name, _camel(name)))))


def into(name: str) -> Step:
    return Step(tuple(dict.fromkeys((name, _camel(name)))), many=False)


@dataclass(frozen=True)
class Target:
    """A flat table: where its objects lie and which of their fields become columns."""

    name: str
    steps: tuple[Step, ...]
    fields: tuple[tuple[str, str], ...]


_FACTS = into("financial_schema")
_ROW = (("label", "string"), ("label_normalized", "string"), ("row_type", "string"))
_SOURCE = (("page", "int"), ("cell", "string"))
_NOTE_FACT = (("fact_key", "string"), ("note_number", "string"), ("note_title", "string"), ("row_label", "string"), ("row_type", "string"), ("source_table_id", "string"))

#: Columns every flat table has besides the fields of its target.
GENERATED = ("root_key", "child_path", "parent_path", "list_position")
#: Name under which objects of lists without a target are filed.
OTHER_LISTS = "other_lists"
#: Levels of objects and lists one step walks below the targets, and the number of steps.
REST_DEPTH, REST_STAGES = 4, 5

#: Target tables below a parsed document's payload.
PAYLOAD_TARGETS = (
    Target("sections", (each("sections"),), (("section_id", "string"), ("title", "string"), ("content", "string"), ("section_type", "string"), ("page_start", "int"), ("page_end", "int"))),
    Target("page_blocks", (each("page_blocks"),), (("block_id", "string"), ("block_type", "string"), ("text", "string"), ("page", "int"), ("order", "int"))),
    Target("tables", (each("tables"),), (("table_id", "string"), ("table_type", "string"), ("title", "string"), ("page", "int"), ("unit", "string"), ("currency", "string"))),
    Target("table_semantic_rows", (each("tables"), each("semantic_rows")), _ROW),
    Target("table_row_sources", (each("tables"), each("semantic_rows"), each("sources")), _SOURCE),
    Target("statements", (_FACTS, each("statements")), (("table_id", "string"), ("statement_type", "string"))),
    Target("notes", (_FACTS, each("notes")), (("table_id", "string"), ("note_number", "string"), ("note_title", "string"), ("note_category", "string"))),
    Target("note_semantic_rows", (_FACTS, each("notes"), each("semantic_rows")), _ROW),
    Target("note_row_sources", (_FACTS, each("notes"), each("semantic_rows"), each("sources")), _SOURCE),
    Target("note_facts", (_FACTS, each("notes"), each("note_facts")), _NOTE_FACT),
    Target("schema_note_facts", (_FACTS, each("note_facts")), _NOTE_FACT),
    Target("metric_facts", (_FACTS, each("metric_facts")), (("metric_key", "string"), ("period", "string"), ("value", "string"), ("statement_type", "string"), ("unit", "string"), ("currency", "string"), ("source_table_id", "string"))),
    Target("semantic_sections", (_FACTS, each("semantic_sections")), (("section_id", "string"), ("section_type", "string"), ("title", "string"), ("confidence", "double"))),
    Target("segments", (each("segments"),), (("segment_id", "string"), ("position", "int"))),
    Target("issues", (each("issues"),), (("code", "string"), ("severity", "string"), ("message", "string"), ("page", "int"))),
    Target("issue_cells", (each("issues"), into("details"), each("cells")), (("row", "int"), ("col", "int"))),
)

#: Target tables below the list of semantic rows of a parsed table.
SEMANTIC_ROW_TARGETS = (
    Target("semantic_rows", (each("semantic_rows"),), _ROW),
    Target("row_sources", (each("semantic_rows"), each("sources")), _SOURCE),
)


class _Names:
    """Fresh lambda variable names, so that nested lambdas never shadow each other."""

    def __init__(self) -> None:
        self._ids = count()

    def __call__(self) -> str:
        return f"v{next(self._ids)}"


def _let(value: str, fresh: _Names, body) -> str:
    """``body`` over a variable bound to ``value``, which is evaluated once."""
    x = fresh()
    return f"transform(array({value}), {x} -> {body(x)})[0]"


def _unquoted(x: str) -> str:
    """A JSON string literal as the text it holds; anything else as it is."""
    return f"CASE WHEN left(ltrim({x}), 1) = '\"' THEN from_json(concat('[', {x}, ']'), 'array<string>')[0] ELSE {x} END"


def _is_object(x: str) -> str:
    return f"(left(ltrim({x}), 1) = '{{' AND json_object_keys({x}) IS NOT NULL)"


def _as_object(value: str, fresh: _Names) -> str:
    """JSON text of an object, whether it was an object or text holding one; else null."""
    return _let(_unquoted(value), fresh, lambda x: f"CASE WHEN {_is_object(x)} THEN {x} END")


def _as_list(value: str, fresh: _Names) -> str:
    """``array<string>`` with the JSON text of each element; null where there is no list."""
    return _let(
        _let(value, fresh, _unquoted), fresh,
        lambda x: f"CASE WHEN left(ltrim({x}), 1) = '[' THEN from_json({x}, 'array<string>') WHEN {_is_object(x)} THEN array({x}) END",
    )


@dataclass
class _Node:
    """Targets merged by their common steps, so that each level of a document is parsed once."""

    table: str | None
    below: dict[Step, _Node]


def _merge(targets: tuple[Target, ...]) -> _Node:
    root = _Node(None, {})
    for target in targets:
        node = root
        for step in target.steps:
            node = node.below.setdefault(step, _Node(None, {}))
        node.table = target.name
    return root


def _row(table: str, path: str, parent: str, position: str, item: str, is_open: str = "false") -> str:
    return f"array(struct('{table}' AS table_name, {path} AS path, {parent} AS parent, {position} AS position, {item} AS item, {is_open} AS is_open))"


_NO_ROWS = "CAST(array() AS array<struct<table_name:string,path:string,parent:string,position:int,item:string,is_open:boolean>>)"


def _nested(x: str) -> str:
    """Text that may hold an object at some level."""
    return f"(left(ltrim({x}), 1) IN ('[', '{{') AND instr({x}, '{{') > 0)"


def _rest(value: str, path: str, owner: str, depth: int, keep: bool, fresh: _Names, known: tuple[str, ...] = ()) -> str:
    """Array of the objects of all lists below a value, whatever their keys; ``known`` keys are left out.

    A value that still holds lists or objects at the last level comes back as an open row.
    """
    if not depth:
        return f"CASE WHEN {_nested(value)} THEN {_row(OTHER_LISTS, path, owner, '-1', value, 'true')} ELSE {_NO_ROWS} END"
    e, x, i, c = fresh(), fresh(), fresh(), fresh()
    skip = " AND ".join(f"{e}.key <> '{k}'" for k in known) or "true"
    at = f"CASE WHEN {path} = '' THEN {e}.key ELSE concat({path}, '.', {e}.key) END"
    objects = f"transform(filter(map_entries(from_json({value}, 'map<string,string>')), {e} -> {skip} AND {e}.value IS NOT NULL), {e} -> struct({at} AS p, {_unquoted(f'{e}.value')} AS v, -1 AS i))"
    lists = f"transform(from_json({value}, 'array<string>'), ({x}, {i}) -> struct(concat({path}, '[', {i}, ']') AS p, {_unquoted(x)} AS v, {i} AS i))"
    children = f"CASE WHEN left(ltrim({value}), 1) = '[' THEN {lists} WHEN left(ltrim({value}), 1) = '{{' THEN {objects} END"
    element = f"({c}.i >= 0 AND {_is_object(f'{c}.v')})"
    own = f"CASE WHEN {element} THEN {_row(OTHER_LISTS, f'{c}.p', owner, f'{c}.i', f'{c}.v' if keep else 'CAST(NULL AS string)')} ELSE {_NO_ROWS} END"
    below = _rest(f"{c}.v", f"{c}.p", f"CASE WHEN {element} THEN {c}.p ELSE {owner} END", depth - 1, keep, fresh)
    return f"coalesce(flatten(transform(filter({children}, {c} -> {_nested(f'{c}.v')}), {c} -> concat({own}, {below}))), {_NO_ROWS})"


def _level(item: str, path: str, parent: str, owner: str, position: str, node: _Node, keep: bool, rest: bool, fresh: _Names) -> str:
    """Array of the target objects at and below one object; ``keep`` carries their JSON text.

    ``owner`` is the path of the nearest list element at or above it, the parent of what lies below.
    """
    parts = []
    if node.table:
        parts.append(_row(node.table, path, parent, position, item if keep else "CAST(NULL AS string)"))
    if rest:
        known = tuple(name for step in node.below for name in step.names)
        # most objects hold plain values alone: they are not parsed a second time
        simple = f"instr(substring(ltrim({item}), 2), '{{') = 0"
        parts.append(f"CASE WHEN {simple} THEN {_NO_ROWS} ELSE {_rest(item, path, owner, 1, keep, fresh, known)} END")
    if node.below:
        keyed, found = fresh(), []
        schema = ", ".join(f"`{name}` string" for step in node.below for name in step.names)
        for step, child in node.below.items():
            for name in step.names:
                here = f"CASE WHEN {path} = '' THEN '{name}' ELSE concat({path}, '.{name}') END"
                value, pair, at = f"{keyed}.`{name}`", fresh(), fresh()
                if step.many:
                    element, i = fresh(), fresh()
                    objects = f"transform({_as_list(value, fresh)}, ({element}, {i}) -> struct({i} AS i, {_as_object(element, fresh)} AS o))"
                    inner = _level(f"{pair}.o", at, owner, at, f"{pair}.i", child, keep, rest, fresh)
                    here = f"concat({here}, '[', {pair}.i, ']')"
                else:
                    objects = f"array(struct(0 AS i, {_as_object(value, fresh)} AS o))"
                    inner = _level(f"{pair}.o", at, parent, owner, position, child, keep, rest, fresh)
                # a one-element array binds the path, so that it is built once per object
                within = f"transform(array({here}), {at} -> {inner})[0]"
                found.append(f"coalesce(flatten(transform(filter({objects}, {pair} -> {pair}.o IS NOT NULL), {pair} -> {within})), array())")
        merged = f"concat({', '.join(found)})" if len(found) > 1 else found[0]
        parts.append(f"transform(array(from_json({item}, '{schema}')), {keyed} -> {merged})[0]")
    return f"concat({', '.join(parts)})" if len(parts) > 1 else parts[0]


def path_items(document: str, targets: tuple[Target, ...], keep: bool = True, rest: bool = False) -> str:
    """SQL for the array of the targets' objects: table, path, parent path, position, JSON text.

    With ``rest`` the objects of all other lists as well.
    """
    fresh = _Names()
    root = fresh()
    body = _level(root, "''", "''", "''", "0", _merge(targets), keep, rest, fresh)
    return f"coalesce(flatten(transform(filter(array({document}), {root} -> {root} IS NOT NULL), {root} -> {body})), {_NO_ROWS})"


def payload_object(column: str) -> str:
    """JSON text of the payload's object, unwrapped where the payload is text inside text."""
    return _as_object(column, _Names())


def semantic_rows_object(column: str) -> str:
    """Semantic rows wrapped as an object with the one key ``semantic_rows``."""
    return f"concat('{{\"semantic_rows\":', {column}, '}}')"


def _typed(rows: DataFrame, fields: tuple[tuple[str, str], ...]) -> DataFrame:
    """Path rows with their fields read from the JSON text; either spelling of a key counts."""
    spellings = {name: tuple(dict.fromkeys((name, _camel(name)))) for name, _ in fields}
    schema = ", ".join(f"`{spelling}` {kind}" for name, kind in fields for spelling in spellings[name])
    typed = rows.withColumn("_typed", F.from_json("item", schema))
    columns = [F.coalesce(*(F.col(f"_typed.`{spelling}`") for spelling in spellings[name])).alias(f"field_{name}" if name in GENERATED else name) for name, _ in fields]
    return typed.select("root_key", F.col("path").alias("child_path"), F.col("parent").alias("parent_path"), F.col("position").alias("list_position"), *columns)


def flat_table(df: DataFrame, key: str, document: str, target: Target) -> DataFrame:
    """One target table: root key, path, parent path, position in its list and the target's fields.

    ``document`` is SQL yielding the document's JSON text. Columns of ``df`` other than ``key`` are not
    carried, so clashing names cannot arise.
    """
    items = df.select(F.col(key).alias("root_key"), F.expr(document).alias("_document"))
    return _typed(items.select("root_key", F.expr(f"inline({path_items('_document', (target,))})")), target.fields)


def payload_table(documents: DataFrame, name: str) -> DataFrame:
    """Flat table ``name`` of ``PAYLOAD_TARGETS`` from ``parsed_documents``."""
    target = next(t for t in PAYLOAD_TARGETS if t.name == name)
    return flat_table(documents, "doc_id", payload_object("payload"), target)


def semantic_row_table(tables: DataFrame, name: str) -> DataFrame:
    """Flat table ``name`` of ``SEMANTIC_ROW_TARGETS`` from ``parsed_tables``."""
    target = next(t for t in SEMANTIC_ROW_TARGETS if t.name == name)
    return flat_table(tables, "id", semantic_rows_object("semantic_rows"), target)


def flat_tables(df: DataFrame, key: str, document: str, targets: tuple[Target, ...], keep: bool = True) -> DataFrame:
    """All target tables and the lists without one in a single pass: each level is parsed once.

    Rows of every table with its name and, if ``keep``, the JSON text its fields are read from.
    """
    items = df.select(F.col(key).alias("root_key"), F.expr(document).alias("_document"))
    rows = items.select("root_key", F.expr(f"inline({path_items('_document', targets, keep, rest=True)})"))
    for stage in range(REST_STAGES + 1):
        deeper = _rest("item", "path", "parent", REST_DEPTH, keep, _Names()) if stage < REST_STAGES else "raise_error(concat('lists nested too deeply at ', root_key, ': ', path))"
        again = f"CASE WHEN is_open THEN {deeper} ELSE {_row_of('table_name')} END"
        rows = rows.select("root_key", F.expr(f"inline({again})"))
    return rows.select("root_key", "table_name", F.col("path").alias("child_path"), F.col("parent").alias("parent_path"), F.col("position").alias("list_position"), "item")


def _row_of(table: str) -> str:
    return f"array(struct({table} AS table_name, path AS path, parent AS parent, position AS position, item AS item, is_open AS is_open))"


def other_lists(documents: DataFrame, tables: DataFrame) -> DataFrame:
    """Objects of lists that no target names, with their JSON text."""
    payload = flat_tables(documents, "doc_id", payload_object("payload"), PAYLOAD_TARGETS)
    rows = flat_tables(tables, "id", semantic_rows_object("semantic_rows"), SEMANTIC_ROW_TARGETS)
    return payload.unionByName(rows).where(F.col("table_name") == OTHER_LISTS).drop("table_name")


def job_events(jobs: DataFrame) -> DataFrame:
    """Event rows of ingestion jobs; null elements keep their position and yield no row."""
    events = "filter(transform(events, (e, i) -> struct(i AS position, e AS event)), p -> p.event IS NOT NULL)"
    rows = jobs.select(F.col("job_id").alias("root_key"), F.expr(f"inline({events})"))
    return rows.select("root_key", F.concat(F.lit("events["), F.col("position"), F.lit("]")).alias("child_path"), F.lit("").alias("parent_path"), F.col("position").alias("list_position"), "event.timestamp", "event.status", "event.stage", "event.progress_percent", "event.message")


def list_objects(documents: DataFrame, tables: DataFrame, jobs: DataFrame) -> DataFrame:
    """Key of every row of all flat tables of the three sources: table, root, path, parent, position."""
    payload = flat_tables(documents, "doc_id", payload_object("payload"), PAYLOAD_TARGETS, keep=False)
    rows = flat_tables(tables, "id", semantic_rows_object("semantic_rows"), SEMANTIC_ROW_TARGETS, keep=False)
    events = job_events(jobs).select("root_key", F.lit("job_events").alias("table_name"), "child_path", "parent_path", "list_position")
    return payload.unionByName(rows.drop("item"), allowMissingColumns=True).drop("item").unionByName(events)
