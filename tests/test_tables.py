import io
import zipfile

from filingloom.operators import tables
from filingloom.sources import office


def test_values_align_with_periods(spark):
    rows = [["Total revenue", "$", "177,556", "158,104", "128,695"], ["Net income", "58,471", "49,552", "37,676"], ["Revenue growth", "2,000", "1,500", "33.3%"], ["Other", "1"]]
    frame = spark.createDataFrame([("t", "income_statement", ["2024", "2023", "2022"], rows), ("n", None, ["2024"], rows), ("e", "balance_sheet", [], [])], "id string, table_type string, period_headers array<string>, rows array<array<string>>")
    got = {(r.metric_key, r.period): r.value for r in tables.period_values(frame.where("id = 't'")).collect()}
    assert got[("net_income", "2024")] == 58471 and got[("net_income", "2022")] == 37676
    assert got[("revenue", "2023")] == 2000 and got[("revenue", "2022")] == 1500  # the later row wins, its ratio is dropped, padded on the left
    assert {(r.id, r.row_no, r.metric_key) for r in tables.row_metrics(frame).collect()} == {("t", 0, "revenue"), ("t", 1, "net_income"), ("t", 2, "revenue")}


def test_question_analysis(spark):
    asked = {"How did revenue grow, what is the growth trend 2022-2024?": ("hybrid", ["vector", "sql"], ["revenue"], [2022, 2024], True), "净利息收入是多少": ("structured", ["sql"], ["net_interest_income"], [], False), "related subsidiary": ("relational", ["graph"], [], [], False), "hello": ("semantic", ["vector"], [], [], False), "risk in 2023": ("hybrid", ["vector", "sql", "graph"], [], [2023], False), "segment information": ("semantic", ["vector"], [], [], False)}
    rows = tables.analyze(spark.createDataFrame([(q,) for q in asked], "question string")).collect()
    got = {r.question: (r.intent, r.routes, r.metric_keys, r.years, r.needs_growth) for r in rows}
    assert got["净利息收入是多少"][2] in (["net_interest_income"], ["revenue", "net_interest_income"])
    for question in asked:
        if question != "净利息收入是多少":
            assert got[question] == asked[question], question


def test_scope_guard(spark):
    aliases = spark.createDataFrame([("a", "Acme"), ("b", "Beta Foods"), ("b", "Beta Foods Holdings"), ("c", "Acme")], "company_id string, alias string")
    questions = spark.createDataFrame([("What did Beta Foods Holdings, Inc. earn?",), ("What did Acme earn?",), ("Nothing named",)], "question string")
    assert [tuple(r) for r in tables.foreign_company(questions, aliases, "a").collect()] == [("What did Beta Foods Holdings, Inc. earn?", "b", "Beta Foods Holdings")]


def test_scope_guard_knows_long_and_chinese_aliases(spark):
    long = "First United Northern and Southern Coastal Shipping and Storage Company"
    aliases = spark.createDataFrame([("c1", long), ("c2", "恒珩装备"), ("c3", "桐港恒珩装备制造"), ("own", "昊铭材料")], "company_id string, alias string")
    asked = [f"How did {long} do in 2021?", "请问桐港恒珩装备制造2021年的收入是多少", "昊铭材料的收入是多少"]
    got = tables.foreign_company(spark.createDataFrame([(q,) for q in asked], "question string"), aliases, "own")
    assert {r.question: (r.company_id, r.alias) for r in got.collect()} == {asked[0]: ("c1", long), asked[1]: ("c3", "桐港恒珩装备制造")}


def test_short_neighbours_join_until_long_enough(spark):
    rows = [("d", 1, "s", 1, "a" * 50), ("d", 2, "s", 1, "b" * 40), ("d", 3, "s", 2, "c" * 40), ("d", 4, "s", 9, "short one text"), ("d", 5, "s", None, "--"), ("e", 1, None, None, "...")]
    out = tables.coalesce_short(spark.createDataFrame(rows, "doc_id string, position int, parent_id string, page int, content string")).orderBy("position").collect()
    assert [(r.position, r.merged) for r in out] == [(1, 2), (3, 1), (4, 2)]


def test_unknown_citations_go(spark):
    row = tables.drop_unknown_citations(spark.createDataFrame([("Rose [V1] and fell [S9].", ["V1"])], "answer string, known array<string>")).first()
    assert row.answer == "Rose [V1] and fell ." and row.removed == ["S9"]


def _package(files):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as archive:
        for name, text in files.items():
            archive.writestr(name, text)
    return buffer.getvalue()


def test_office_scans(spark):
    w = 'xmlns:w="w"'
    word = _package({"word/document.xml": f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Results</w:t></w:r></w:p><w:p><w:r><w:t>It rose.</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>1</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'})
    sheet = _package({
        "xl/workbook.xml": '<workbook xmlns:r="r"><sheets><sheet name="S" r:id="rId1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>', "xl/sharedStrings.xml": "<sst><si><t>Income</t></si><si><t>Revenue</t></si></sst>",
        "xl/worksheets/sheet1.xml": '<worksheet><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c></row><row r="3"><c r="A3" t="s"><v>1</v></c><c r="C3"><v>12.0</v></c><c r="D3"><v>7</v></c></row></sheetData></worksheet>',
    })
    slide = _package({"ppt/slides/slide1.xml": '<p:sld xmlns:p="p" xmlns:a="a"><p:sp><p:ph type="title"/><a:t>Title</a:t></p:sp><p:sp><a:t>Body</a:t></p:sp></p:sld>', "ppt/notesSlides/notesSlide1.xml": '<n xmlns:a="a"><a:t>say it</a:t></n>'})
    files = spark.createDataFrame([("a.docx", word), ("b.xlsx", sheet), ("c.pptx", slide), ("d.docx", b"broken"), ("e.bin", b"")], "path string, content binary")
    got = {}
    for r in office.office_blocks(files).orderBy("path", "order").collect():
        got.setdefault(r.path, []).append((r.page, r.block_type, r.title, r.text))
    assert got["a.docx"] == [(1, "heading", "Results", "Results"), (1, "paragraph", "Results", "It rose."), (1, "table", "Results", "a | 1")]
    assert got["b.xlsx"] == [(1, "heading", "Income", "Income"), (1, "table", "Income", "Revenue |  | 12 | 7")]
    assert got["c.pptx"] == [(1, "heading", "Title", "Title"), (1, "paragraph", "Title", "Body"), (1, "paragraph", "Title", "Speaker Notes: say it")]
    assert got["d.docx"][0][1] == "error" and "e.bin" not in got
