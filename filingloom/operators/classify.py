"""Kinds and bindings of parsed tables: classification, rows in one cell, note sections, tables of contents, checks."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingloom.operators.structure import normal_text

#: Words in titles that name a kind of statement, in order of precedence.
STATEMENT_TITLES = (
    ("income_statement", ("statements of income", "statement of income", "income statement", "statements of earnings", "statement of earnings", "comprehensive income", "statement of operations", "statements of operations", "合并利润表", "母公司利润表", "利润表")),
    ("balance_sheet", ("balance sheets", "balance sheet", "financial position", "assets and liabilities", "合并资产负债表", "母公司资产负债表", "资产负债表")),
    ("cash_flow", ("cash flows", "cash flow", "operating activities", "investing activities", "financing activities", "合并现金流量表", "母公司现金流量表", "现金流量表")),
    ("equity", ("stockholders' equity", "stockholders’ equity", "shareholders' equity", "shareholders’ equity", "changes in equity", "changes in stockholders", "合并股东权益变动表", "合并所有者权益变动表", "股东权益变动表", "所有者权益变动表")),
)
#: Titles of tables that are no statements, and row labels that betray a statement.
ANALYSIS_TITLES = ("horizontal analysis", "vertical analysis", "ratio analysis", "year-on-year", "year over year", "analysis")
PROFILE_TITLES = ("company profile", "corporate profile")
NOTE_TITLE = r"notes to|^note\s+\d+|财务报表附注|^附注\s*\d+"
OTHER_TITLE = r"^item\s+\d+|^(form 10-k|table of contents|signatures)$"
ROW_CUES = {
    "balance_sheet": ("货币资金", "流动资产合计", "资产总计", "负债合计", "所有者权益合计"),
    "income_statement": ("营业收入", "营业总收入", "营业成本", "营业利润", "净利润", "利润总额"),
    "cash_flow": ("经营活动产生的现金流量净额", "投资活动产生的现金流量净额", "筹资活动产生的现金流量净额"),
}


def _any(text: Column, words: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | F.contains(text, F.lit(word))
    return hit


def _named(text: Column) -> Column:
    """The statement a text names; null if none."""
    return F.coalesce(*(F.when(_any(text, words), kind) for kind, words in STATEMENT_TITLES))


def kind_of_rows(text: Column) -> Column:
    """The statement that row labels betray: one cash-flow total is enough, else two labels of a kind."""
    def count(kind: str) -> Column:
        return sum((F.contains(text, F.lit(cue)).cast("int") for cue in ROW_CUES[kind]), F.lit(0))

    balance, income, cash = (count(k) for k in ROW_CUES)
    most = F.greatest(balance, income, cash)
    # of equal counts the kind listed first
    return F.when((cash >= 1) & (cash >= most), "cash_flow").when((most >= 2) & (balance == most), "balance_sheet").when((most >= 2) & (income == most), "income_statement")


def table_kind(tables: DataFrame) -> DataFrame:
    """``(id, kind)``: by its title, else its row labels, its section's kind and title, the text around, its own text.

    Optional columns ``section_title``, ``section_type``, ``nearby`` and ``raw_kind`` are read where they exist.
    """
    def optional(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit("")) if name in tables.columns else F.lit("")

    texts = {"_title": F.coalesce("title", F.lit("")), "_above": optional("section_title"), "_nearby": optional("nearby"), "_markdown": F.coalesce("raw_markdown", F.lit(""))}
    title, above, nearby, markdown = map(F.col, texts)
    cells = F.transform(F.filter(F.slice(F.coalesce("rows", F.array().cast("array<array<string>>")), 1, 40), lambda r: F.size(r) > 0), lambda r: F.coalesce(F.get(r, F.lit(0)), F.lit("")))
    whole = normal_text(F.concat_ws(" ", title, above, nearby, F.array_join(F.coalesce("headers", F.array().cast("array<string>")), " "), F.array_join(cells, " "), markdown))
    # normalised once, as columns the many rules share
    kinds = {"_section_type": optional("section_type"), "_raw_kind": optional("raw_kind")}
    rows = tables.select("id", "headers", "rows", *(normal_text(c).alias(n) for n, c in texts.items()), *(c.alias(n) for n, c in kinds.items()))
    rows = rows.select("id", *texts, *kinds, whole.alias("_content")).withColumn("_by_rows", kind_of_rows(F.col("_content")))
    by_title = F.when(_any(title, PROFILE_TITLES), "profile_table").when(_any(title, ANALYSIS_TITLES), "analysis_table").when(title.rlike(NOTE_TITLE), "notes_table").when(title.rlike(OTHER_TITLE), "other_table")
    by_section = F.when((F.col("_section_type") == "financial_note") | above.rlike(r"notes to|^note\s+\d+|财务报表附注"), "notes_table")
    around = F.coalesce(*(F.when(_any(above, words) | _any(nearby, words), kind) for kind, words in STATEMENT_TITLES))
    complex_ = F.when(F.col("_raw_kind") == "complex_table", "notes_table")
    return rows.select("id", F.coalesce(by_title, "_by_rows", _named(title), by_section, around, complex_, _named(markdown), F.lit("notes_table")).alias("kind"))


def strict_number(text: Column) -> Column:
    """A number written with commas, dollar or per-cent sign; a bracket at the front negates; else null."""
    clean = F.trim(F.regexp_replace(F.replace(F.regexp_replace(F.trim(text), r"[,$%)]", ""), F.lit("("), F.lit("-")), r"\?", ""))
    return F.when(clean.rlike(r"^-?\d+(?:\.\d+)?$"), clean.try_cast("double"))


def one_cell_row(text: str, periods: int) -> tuple[str | None, list[str]]:
    """Label and values of a row that stands in one cell; nothing if it holds fewer values than periods."""
    if periods < 1:
        return None, []
    values = re.findall(r"\(?-?\d{1,3}(?:,\d{3})+(?:\.\d+)?\)?|\(?-?\d+\.\d{2}\)?", text)
    if len(values) < periods:
        values = re.findall(r"(?:\$\s*)?\(?-?\d[\d,]*(?:\.\d+)?\)?", text)
    if len(values) < periods:
        return None, []
    label, at = "", 0
    for value in values:  # in order of the text
        place = text.index(value, at)
        label, at = f"{label} {text[at:place]}", place + len(value)
    label = re.sub(r"\s+", " ", f"{label} {text[at:]}".replace("$", " ")).strip(" :-")
    return label or None, values


def split_rows(tables: DataFrame) -> DataFrame:
    """``(id, row_no, label, cells)`` of all rows: those of several cells as they are, those of one cell split."""
    rows = tables.select("id", F.greatest(F.size(F.coalesce("period_headers", F.array().cast("array<string>"))), F.lit(0)).alias("periods"), F.posexplode("rows").alias("row_no", "r"))

    @F.pandas_udf("struct<label:string,cells:array<string>>")
    def split(text: pd.Series, periods: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one_cell_row((t or "").strip(), int(p)) for t, p in zip(text, periods)], columns=["label", "cells"])

    wide = rows.where("size(r) >= 2").select("id", "row_no", F.nullif(F.trim(F.get("r", F.lit(0))), F.lit("")).alias("label"), F.filter(F.slice("r", F.lit(2), F.size("r")), lambda c: c.rlike(r"\d")).alias("cells"))
    narrow = rows.where("size(r) = 1").select("id", "row_no", split(F.get("r", F.lit(0)), "periods").alias("s")).select("id", "row_no", "s.label", "s.cells")
    return wide.unionByName(narrow)


#: Titles that say no more than that notes follow; pages a note may lie before or after its table.
GENERIC_NOTES = ("", "notes to consolidated financial statements", "notes to financial statements")
NOTE_BEFORE, NOTE_AFTER = 8, 2


def note_sections(tables: DataFrame, notes: DataFrame) -> DataFrame:
    """``(doc_id, table_id, note_id)``: the note each table belongs to.

    ``tables (doc_id, table_id, page, order, title, blocks_on_page)``, ``notes (doc_id, note_id, page_start, page_end,
    anchor_order)``. First the last note that begins before the table on its page; where the order on a
    page of several blocks is known and no note begins before, there is none. Else the narrowest note
    over the page, the nearest begun up to eight pages before, and, for a table without a title of its
    own, the nearest begun up to two pages after. Notes are spread over the pages they can reach, so
    the range join is an equi-join and a table keeps its best note by one ``min``.
    """
    start, end = F.col("page_start"), F.coalesce("page_end", F.col("page_start"))
    reach = F.sequence(start - NOTE_AFTER, F.greatest(end, start + NOTE_BEFORE))
    spread = notes.where("page_start IS NOT NULL").select("doc_id", "note_id", "page_start", "page_end", "anchor_order", F.explode(reach).alias("page"))
    rows = tables.where("page IS NOT NULL").join(spread, ["doc_id", "page"])
    before = (F.col("page_start") == F.col("page")) & (F.col("anchor_order") <= F.col("order"))
    ordered = F.col("order").isNotNull() & (F.col("blocks_on_page") > 1)
    generic = F.coalesce(normal_text(F.col("title")), F.lit("")).isin(*GENERIC_NOTES)
    tier = F.when(before, F.struct(F.lit(0).alias("tier"), (F.col("order") - F.col("anchor_order")).alias("away")))
    rest = (
        F.when((F.col("page_start") <= F.col("page")) & (F.col("page") <= F.col("page_end")), F.struct(F.lit(1).alias("tier"), (F.col("page_end") - F.col("page_start")).alias("away")))
        .when((F.col("page_start") <= F.col("page")) & (F.col("page") - F.col("page_start") <= NOTE_BEFORE), F.struct(F.lit(2).alias("tier"), (F.col("page") - F.col("page_start")).alias("away")))
        .when(generic & (F.col("page_start") > F.col("page")), F.struct(F.lit(3).alias("tier"), (F.col("page_start") - F.col("page")).alias("away")))
    )
    ranked = rows.select("doc_id", "table_id", F.coalesce(tier, F.when(~F.coalesce(ordered, F.lit(False)), rest)).alias("rank"), "note_id").where("rank IS NOT NULL")
    return ranked.groupBy("doc_id", "table_id").agg(F.min(F.struct("rank", "note_id")).alias("b")).select("doc_id", "table_id", "b.note_id")


#: Titles of tables of contents and the form of their lines.
CONTENTS_TITLE = r"^(?i:目录|目\s*录|contents|table of contents)$"
CONTENTS_LINE = r"\.{3,}|…{2,}|[.·•]{2,}\s*\d+\s*$|第[一二三四五六七八九十百千零〇\d]+[章节].*\d+\s*$"


def without_contents(blocks: DataFrame) -> DataFrame:
    """Blocks of each document outside its tables of contents, a state carried from block to block.

    A title opens one; lines of contents, list items and headings stay inside it, short lines that end
    in a number as well; a paragraph of 40 characters or anything else longer closes it. Lines of
    contents of up to 120 characters go wherever they stand. Input ``(doc_id, block_id, order, block_type, text)``;
    a group is one document.
    """
    title, line = re.compile(CONTENTS_TITLE), re.compile(CONTENTS_LINE)

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        kept, inside = [], False
        for row in group.sort_values(["order", "block_id"]).itertuples(index=False):
            text = (row.text or "").strip()
            listed = line.search(text) is not None
            if not text:
                continue
            if title.fullmatch(text):
                inside = True
                continue
            if inside:
                narrative = row.block_type == "paragraph" and len(text) >= 40 and not listed
                if (listed or row.block_type in ("list_item", "heading")) and not narrative:
                    continue
                if not listed and not narrative and len(text) < 80 and re.search(r"\d+\s*$", text):
                    continue
                inside = False
            if not (listed and len(text) <= 120):
                kept.append((row.doc_id, row.block_id))
        return pd.DataFrame(kept, columns=["doc_id", "block_id"])

    rows = blocks.where("doc_id IS NOT NULL").select("doc_id", "block_id", "order", "block_type", "text")
    return rows.groupBy("doc_id").applyInPandas(fold, "doc_id string, block_id string")


#: Titles that open a major section.
MAJOR_TITLE = r"^(?:第[一二三四五六七八九十百千零〇\d]+[章节篇部]|(?:合并|母公司)?(?:资产负债表|利润表|现金流量表)|管理层讨论与分析|审计报告)"


def merge_adjacent(candidates: DataFrame) -> DataFrame:
    """Neighbouring candidates of a document that are one section, folded into the first of them.

    ``candidates (doc_id, position, title, kind, page_start, page_end, confidence)`` to ``(doc_id, position, title, kind,
    page_start, page_end, confidence, merged)``. A candidate joins the one kept last if both have its kind and
    title, or its kind alone, with at most a page between them and no major title of its own. The
    confidence is the greater; a shorter major title takes the place of a longer one. Without pages on
    either side the gap is unknown and the titles must agree. A group is one document.
    """
    major = re.compile(MAJOR_TITLE)

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        kept: list[dict] = []
        for row in group.sort_values("position").to_dict("records"):
            row = {k: None if pd.isna(v) else v for k, v in row.items()} | {"merged": 1}
            last = kept[-1] if kept else None
            opens = major.match((row["title"] or "").strip()) is not None
            near = last is not None and last["page_end"] is not None and row["page_start"] is not None and row["page_start"] - last["page_end"] <= 1
            if last is not None and row["kind"] == last["kind"] and (row["title"] == last["title"] or near and not opens):
                last["merged"] += 1
                last["confidence"] = max((c for c in (last["confidence"], row["confidence"]) if c is not None), default=None)
                for side, choose in (("page_start", min), ("page_end", max)):
                    last[side] = choose((x for x in (last[side], row[side]) if x is not None), default=None)
                if opens and len(row["title"]) < len(last["title"] or ""):
                    last["title"] = row["title"]
            else:
                kept.append(row)
        frame = pd.DataFrame(kept, columns=["doc_id", "position", "title", "kind", "page_start", "page_end", "confidence", "merged"])
        return frame.astype({"page_start": "Int32", "page_end": "Int32"})

    rows = candidates.where("doc_id IS NOT NULL").select("doc_id", "position", "title", "kind", "page_start", "page_end", "confidence")
    return rows.groupBy("doc_id").applyInPandas(fold, "doc_id string, position int, title string, kind string, page_start int, page_end int, confidence double, merged int")


def checks(expectations: DataFrame) -> DataFrame:
    """Rows ``(name, rule, expected, actual)`` with ``passed``: ``equals``, ``min``, ``max`` and ``subset`` of lists joined by commas.

    Without an expectation a row passes; without an actual value it fails.
    """
    wanted, actual = F.col("expected"), F.col("actual")
    number, given = wanted.try_cast("double"), actual.try_cast("double")
    lists = F.size(F.array_except(F.split(wanted, ","), F.split(F.coalesce(actual, F.lit("")), ","))) == 0
    passed = F.when(F.col("rule") == "min", given >= number).when(F.col("rule") == "max", given <= number).when(F.col("rule") == "subset", lists).otherwise(wanted == actual)
    return expectations.withColumn("passed", wanted.isNull() | F.coalesce(passed, F.lit(False)))


#: Confidence of the ways a document was read.
ROUTE_CONFIDENCE = {"native_pdf": 0.78, "table_pdf": 0.84, "ocr_pdf": 0.66, "mineru_pdf": 0.9}


def parse_confidence(route: Column, coverage: Column, tables: Column, issues: Column) -> Column:
    """Confidence of a parse: by route, raised by tables and coverage, lowered by issues, within 0.2 and 0.98."""
    base = F.coalesce(*(F.when(route == name, F.lit(value)) for name, value in ROUTE_CONFIDENCE.items()), F.lit(0.7))
    score = base + F.least(tables, F.lit(3)) * 0.02 + F.greatest(coverage - 0.5, F.lit(0.0)) * 0.1 - F.least(issues, F.lit(4)) * 0.06
    return F.round(F.greatest(F.lit(0.2), F.least(score, F.lit(0.98))), 3)


def period_matches(wanted: int | str | None, period: Column, year: Column) -> Column:
    """A number asks for the year, a text for the period or the year as written, nothing for all."""
    if wanted is None:
        return F.lit(True)
    if isinstance(wanted, int):
        return F.coalesce(year == wanted, F.lit(False))
    return (F.coalesce(period, F.lit("")) == wanted) | (F.coalesce(year.cast("string"), F.lit("")) == wanted)


def requested(facts: DataFrame, wanted: DataFrame, key: str = "document_id") -> tuple[DataFrame, DataFrame]:
    """Facts of the requested documents, and the requested ones that have none."""
    distinct = wanted.where(F.col(key).isNotNull()).select(key).distinct()
    return facts.join(distinct, key, "left_semi"), distinct.join(facts.select(key), key, "left_anti")
