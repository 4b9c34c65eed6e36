"""Table intelligence and question analysis: alias dictionaries, period alignment, unit labels, cues."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingloom.operators.facts import parse_number

#: Spellings of metrics per kind of statement; the longest spelling in a label wins.
METRIC_ALIASES = {
    "income_statement": {
        "revenue": ("revenue", "total net revenue", "total revenue", "net sales", "total net sales", "营业收入", "营业总收入"), "interest_income": ("interest income", "total interest income", "利息收入"), "interest_expense": ("interest expense", "total interest expense", "利息支出"), "net_interest_income": ("net interest income", "利息净收入"),
        "noninterest_income": ("noninterest income",), "noninterest_revenue": ("noninterest revenue",), "cost_of_sales": ("cost of sales", "cost of products sold", "cost of revenue", "营业成本"), "gross_margin": ("gross margin", "gross profit", "毛利润", "毛利"), "operating_expenses": ("operating expenses", "total operating expenses", "营业支出"),
        "operating_income": ("operating income", "income from operations", "营业利润"), "provision_for_credit_losses": ("provision for credit losses",), "noninterest_expense": ("noninterest expense",), "income_before_income_tax_expense": ("income before income tax expense", "利润总额"), "income_tax_expense": ("income tax expense", "所得税费用"),
        "net_income": ("net income", "net income applicable to common stockholders", "净利润", "归属于母公司所有者的净利润"), "earnings_per_share_basic": ("basic earnings per share", "basic eps", "基本每股收益"), "earnings_per_share_diluted": ("diluted earnings per share", "diluted eps", "稀释每股收益"),
    },
    "balance_sheet": {
        "cash_and_cash_equivalents": ("cash and cash equivalents", "cash and due from banks", "货币资金"), "investment_securities": ("investment securities", "securities available-for-sale", "available-for-sale securities", "交易性金融资产"), "loans": ("loans", "total loans", "发放贷款和垫款"), "goodwill": ("goodwill", "商誉"), "intangible_assets": ("intangible assets", "无形资产"),
        "total_assets": ("total assets", "资产总计", "资产合计"), "debt": ("long-term debt", "total debt", "borrowings", "长期借款", "短期借款"), "total_liabilities": ("total liabilities", "负债合计", "负债总计"), "total_deposits": ("total deposits", "吸收存款"), "retained_earnings": ("retained earnings", "未分配利润"), "accumulated_other_comprehensive_income": ("accumulated other comprehensive income", "accumulated other comprehensive loss", "其他综合收益"),
        "total_equity": ("total equity", "total shareholders' equity", "total stockholders' equity", "total stockholders’ equity", "所有者权益合计", "股东权益合计"), "total_stockholders_equity": ("total stockholders' equity", "total stockholders’ equity", "归属于母公司所有者权益合计"), "accounts_receivable": ("accounts receivable", "应收账款"), "inventory": ("inventory", "inventories", "存货"), "current_assets": ("current assets", "流动资产合计"), "current_liabilities": ("current liabilities", "流动负债合计"),
    },
    "cash_flow": {
        "net_income": ("net income", "净利润"), "depreciation_and_amortization": ("depreciation and amortization", "depreciation", "折旧和摊销"),
        "net_cash_from_operating_activities": ("net cash provided by operating activities", "net cash from operating activities", "net cash provided by operating", "cash generated by operating activities", "经营活动产生的现金流量净额"),
        "net_cash_from_investing_activities": ("net cash used in investing activities", "net cash from investing activities", "net cash used in investing", "投资活动产生的现金流量净额"),
        "net_cash_from_financing_activities": ("net cash used in financing activities", "net cash from financing activities", "net cash provided by financing activities", "net cash provided by financing", "筹资活动产生的现金流量净额"),
        "capital_expenditures": ("capital expenditures", "purchases of property and equipment", "additions to premises and equipment", "购建固定资产"), "free_cash_flow": ("free cash flow",),
        "cash_and_cash_equivalents_at_end_of_period": ("cash and cash equivalents at end of period", "cash and cash equivalents at the end of the period", "期末现金及现金等价物余额"), "cash_and_due_from_banks_at_end_of_period": ("cash and due from banks at the end of the period", "cash at end of period"),
    },
    "equity": {
        "additional_paid_in_capital": ("additional paid-in capital", "additional paid in capital", "资本公积"), "total_stockholders_equity": ("total stockholders' equity", "total stockholders’ equity", "归属于母公司所有者权益合计"), "total_equity": ("total equity", "total shareholders' equity", "所有者权益合计"),
        "common_stock": ("common stock", "股本"), "treasury_stock": ("treasury stock", "库存股"), "retained_earnings": ("retained earnings", "未分配利润"), "accumulated_other_comprehensive_income": ("accumulated other comprehensive income", "accumulated other comprehensive loss", "其他综合收益"),
    },
}
#: Unit labels and the marks that name them, in order of precedence.
UNIT_MARKS = (("billions", ("in billion", "in billions", "€b", "$b", "单位：亿元", "单位:亿元")), ("millions", ("in million", "in millions", "€m", "$m", "单位：万元", "单位:万元", "人民币万元")), ("thousands", ("in thousand", "in thousands", "€k", "$k")), ("yuan", ("单位：元", "单位:元", "人民币元")))
CURRENCY_MARKS = (("USD", ("$", "usd", "u.s. dollar")), ("EUR", ("€", "eur")), ("CNY", ("¥", "￥", "cny", "rmb", "人民币", "单位：元", "单位:元")))


def _statement(kind: str) -> str:
    return "cash_flow" if kind.startswith("cash_flow") else kind


def _contains_any(text: Column, marks: Iterable[str]) -> Column:
    hit = F.lit(False)
    for mark in marks:
        hit = hit | text.contains(mark)
    return hit


def metric_of_label(kind: Column, label: Column) -> Column:
    """Metric whose longest spelling stands in the label; the first of equally long ones."""
    lowered = F.lower(label)
    found = F.lit(None).cast("string")
    for statement, metrics in METRIC_ALIASES.items():
        spellings = sorted(((len(alias), -i, alias, metric) for i, (metric, alias) in enumerate((m, a) for m, aliases in metrics.items() for a in aliases)), key=lambda s: (s[0], s[1]))
        inner = F.lit(None).cast("string")
        for _, _, alias, metric in spellings:
            inner = F.when(lowered.contains(alias), metric).otherwise(inner)
        found = F.when(kind.startswith(statement), inner).otherwise(found)
    return found


def row_metrics(tables: DataFrame) -> DataFrame:
    """(id, row_no, label, metric_key) of table rows whose label names a metric."""
    rows = tables.where("table_type IS NOT NULL").select("id", "table_type", F.posexplode("rows").alias("row_no", "row")).select("id", "table_type", "row_no", F.get("row", F.lit(0)).alias("label"))
    return rows.withColumn("metric_key", metric_of_label(F.col("table_type"), F.col("label"))).where("metric_key IS NOT NULL").drop("table_type")


def period_values(tables: DataFrame) -> DataFrame:
    """Row values aligned with period headers, the last row of a metric winning.

    Small numbers beside two or more amounts from 1,000 on are ratios and go; then values align from
    the left, else from the right, padded on the left.
    """
    rows = tables.where("table_type IS NOT NULL AND size(period_headers) > 0").select("id", "table_type", "period_headers", F.posexplode("rows").alias("row_no", "row"))
    rows = rows.withColumn("metric_key", metric_of_label(F.col("table_type"), F.get("row", F.lit(0)))).where("metric_key IS NOT NULL AND size(row) > 1")
    values = F.filter(F.transform(F.slice("row", F.lit(2), F.size("row")), parse_number), lambda v: v.isNotNull())
    rows = rows.withColumn("v", values).where("size(v) > 0").withColumn("large", F.filter("v", lambda v: F.abs(v) >= 1000))
    dropped = (F.size("large") >= 2) & (F.size("large") < F.size("v"))
    kept, periods = F.when(dropped, F.col("large")).otherwise(F.col("v")), F.size("period_headers")
    rows = rows.withColumn("kept", kept).withColumn("from_left", dropped & (F.size("kept") >= periods))
    shift = F.when(F.col("from_left"), 0).otherwise(F.size("kept") - periods)
    aligned = F.transform("period_headers", lambda p, i: F.struct(p.alias("period"), F.when(i + shift >= 0, F.get("kept", (i + shift).cast("int"))).alias("value")))
    cells = rows.select("id", "metric_key", "row_no", F.explode(aligned).alias("c")).select("id", "metric_key", "row_no", "c.period", "c.value").where("value IS NOT NULL")
    return cells.groupBy("id", "metric_key", "period").agg(F.max_by("value", "row_no").alias("value"))


def unit_labels(tables: DataFrame) -> DataFrame:
    """Unit and currency labels read from title and text, in order of precedence; labels, not factors."""
    text = F.lower(F.concat_ws(" ", "title", "raw_markdown"))

    def first(marks: tuple) -> Column:
        return F.coalesce(*(F.when(_contains_any(text, words), name) for name, words in marks))

    return tables.select("id", first(UNIT_MARKS).alias("unit_label"), first(CURRENCY_MARKS).alias("currency_label"))


#: Cues of questions.
QUESTION_METRICS = {"revenue": ("revenue", "net revenue", "total revenue", "营收", "营业收入", "收入"), "net_income": ("net income", "net profit", "净利润", "净收益"), "total_assets": ("total assets", "总资产"), "total_liabilities": ("total liabilities", "总负债"), "total_equity": ("total equity", "shareholders' equity", "股东权益", "净资产"), "interest_income": ("interest income", "利息收入"), "net_interest_income": ("net interest income", "净利息收入"), "operating_income": ("operating income", "营业利润"), "net_cash_from_operating_activities": ("operating cash flow", "cash from operating activities", "经营活动产生的现金流量净额", "经营活动现金流量净额", "经营现金流", "经营活动现金流"), "earnings_per_share_basic": ("basic earnings per share", "basic eps", "基本每股收益"), "earnings_per_share_diluted": ("diluted earnings per share", "diluted eps", "稀释每股收益")}
SEMANTIC = ("why", "how", "reason", "driver", "risk", "outlook", "management", "explain", "analyze", "为什么", "原因", "驱动", "风险", "展望", "管理层", "如何", "分析")
STRUCTURED = ("how much", "amount", "ratio", "trend", "growth", "cagr", "yoy", "多少", "数值", "金额", "比率", "趋势", "增长", "同比", "复合增长")
GROWTH = ("growth", "trend", "cagr", "yoy", "增长", "同比", "趋势", "复合增长")
RELATIONS = ("risk", "relationship", "related", "exposure", "affect", "subsidiary", "industry", "segment", "competitor", "风险", "关系", "关联", "暴露", "影响", "子公司", "行业", "业务板块", "分部", "竞争对手")
DISCLOSURES = ("reportable segment", "geographic segment", "segment information", "segment reporting", "可报告分部", "地区分部", "分部信息")


def analyze(questions: DataFrame) -> DataFrame:
    """Intent, routes, metrics and years of each ``question``; a longer alias shadows one inside it."""
    text = F.lower(F.trim(F.regexp_replace("question", r"\s+", " ")))
    every = [(metric, alias) for metric, aliases in QUESTION_METRICS.items() for alias in aliases]
    named = []
    for metric, aliases in QUESTION_METRICS.items():
        hit = F.lit(False)
        for alias in aliases:
            shadows = [other for name, other in every if name != metric and alias in other and len(other) > len(alias)]
            hit = hit | (text.contains(alias) & ~_contains_any(text, shadows))
        named.append(F.when(hit, metric))
    metrics = F.filter(F.array(*named), lambda m: m.isNotNull())
    years = F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?<!\d)((?:19|20)\d{2})(?!\d)"), F.lit(1)))).cast("array<int>")
    structured = (F.size(metrics) > 0) | (F.size(years) > 0) | _contains_any(text, STRUCTURED)
    graph = _contains_any(text, RELATIONS) & ~_contains_any(text, DISCLOSURES)
    semantic = _contains_any(text, SEMANTIC)
    intent = F.when(graph & (structured | semantic), "hybrid").when(graph, "relational").when(structured & semantic, "hybrid").when(structured, "structured").otherwise("semantic")
    routes = F.when(graph & structured, F.array(F.lit("vector"), F.lit("sql"), F.lit("graph"))).when(graph & semantic, F.array(F.lit("vector"), F.lit("graph"))).when(graph, F.array(F.lit("graph"))).when(structured & semantic, F.array(F.lit("vector"), F.lit("sql"))).when(structured, F.array(F.lit("sql"))).otherwise(F.array(F.lit("vector")))
    return questions.select("question", intent.alias("intent"), routes.alias("routes"), metrics.alias("metric_keys"), years.alias("years"), _contains_any(text, GROWTH).alias("needs_growth"))


def foreign_company(questions: DataFrame, aliases: DataFrame, company_id: str) -> DataFrame:
    """Questions that name another company: the longest of its aliases that the question contains.

    ``aliases (company_id, alias)`` are looked up by the word runs of the question, as long as the
    longest alias, not one by one; aliases with ideographs, which have no blanks around them, by its
    stretches of characters of the lengths that occur.
    """
    han = r"[\u3400-\u9fff]"
    words = F.split(F.lower(F.trim(F.regexp_replace("question", r"[^\p{L}\p{N}]+", " "))), " ")
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.size("w")), lambda i: F.transform(F.sequence(F.lit(1), F.least("most_words", F.size("w") - i + 1)), lambda n: F.array_join(F.slice("w", i, n), " "))))
    stretches = F.flatten(F.transform("lengths", lambda n: F.transform(F.filter(F.sequence(F.lit(1), F.length("joined")), lambda i: i + n - 1 <= F.length("joined")), lambda i: F.substring("joined", i, n))))
    spelled = F.lower(F.trim(F.regexp_replace("alias", r"[^\p{L}\p{N}]+", " ")))
    keyed = aliases.where(F.length("alias") > 0).select("company_id", "alias", F.when(spelled.rlike(han), F.replace(spelled, F.lit(" "), F.lit(""))).otherwise(spelled).alias("run")).where("run <> ''")
    sizes = keyed.agg(F.coalesce(F.max(F.size(F.split("run", " "))), F.lit(1)).alias("most_words"), F.collect_set(F.when(F.col("run").rlike(han), F.length("run"))).alias("lengths"))  # one row
    joined = questions.withColumn("w", words).withColumn("joined", F.array_join("w", "")).crossJoin(F.broadcast(sizes))
    probes = joined.select("question", F.explode(F.array_distinct(F.concat(runs, F.when(F.col("joined").rlike(han), stretches).otherwise(F.array().cast("array<string>"))))).alias("run"))
    own = keyed.where(F.col("company_id") == company_id).select("run").distinct()
    hits = probes.join(keyed.join(own, "run", "left_anti"), "run").where(F.col("company_id") != company_id)
    best = F.max(F.struct(F.length("alias").alias("n"), F.col("alias"), F.col("company_id")))
    return hits.groupBy("question").agg(best.alias("b")).select("question", F.col("b.company_id").alias("company_id"), F.col("b.alias").alias("alias"))


def coalesce_short(payloads: DataFrame, least: int = 80) -> DataFrame:
    """Short neighbours of one parent and adjoining pages joined, by a fold over each document.

    The length that decides is the accumulated one, so islands by ``lag`` would not do. A group is one
    document. Input ``(doc_id, position, parent_id, page, content)``.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[list] = []
        for row in pdf.sort_values("position").itertuples(index=False):
            page = None if pd.isna(row.page) else int(row.page)
            content = row.content or ""
            if out:
                last = out[-1]
                close = last[3] is None or page is None or abs(page - last[3]) <= 1
                same = last[2] == row.parent_id or (pd.isna(last[2]) and pd.isna(row.parent_id))
                if same and close and len(last[4]) < least:
                    last[4] = f"{last[4]}\n\n{content}".strip()
                    last[5] += 1
                    continue
            out.append([row.doc_id, row.position, row.parent_id, page, content, 1])
        frame = pd.DataFrame(out, columns=["doc_id", "position", "parent_id", "page", "content", "merged"])
        return frame[frame["content"].str.replace(r"[\W_]+", "", regex=True).str.len() >= 12]

    schema = "doc_id string, position int, parent_id string, page int, content string, merged int"
    return payloads.groupBy("doc_id").applyInPandas(fold, schema)


def drop_unknown_citations(answers: DataFrame) -> DataFrame:
    """``answer`` without citations such as [V3] that are not in ``known``, and the ones removed."""
    cited = F.array_distinct(F.regexp_extract_all("answer", F.lit(r"\[([VSCG]\d+)\]"), F.lit(1)))
    unknown = F.array_except(cited, F.col("known"))
    text = F.aggregate(unknown, F.col("answer"), lambda t, c: F.replace(t, F.concat(F.lit("["), c, F.lit("]")), F.lit("")))
    return answers.select(F.trim(F.regexp_replace(text, r"\s{2,}", " ")).alias("answer"), unknown.alias("removed"))
