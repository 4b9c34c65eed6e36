import pytest
from pyspark.sql import functions as F

from filingloom.operators import units

OBS = "observation_id string, document_id string, metric_key string, period string, value string, unit string, currency string, source_table_id string, source_table_title string, amount string"
TABLES = "id string, unit string, currency string, title string, headers array<string>, footnotes array<string>"
RATES = [("USD", 2020, 1.0), ("EUR", 2020, 1.25), ("CNY", 2020, 0.2), ("INR", 2020, 0.01)]


def _converted(spark, rows, tables=()):
    obs = spark.createDataFrame([(*r, None) for r in rows], OBS)
    return units.convert(obs, spark.createDataFrame(list(tables), TABLES), spark.createDataFrame(RATES, "currency string, rate_year int, usd_per_unit double"))


@pytest.mark.parametrize("text,number", [("1,234.5", 1234.5), ("(1,234)", -1234.0), ("-5", -5.0), ("565 190 820,00", 565190820.0), ("1.234,56", 1234.56), ("13,40,096", 1340096.0), ("0.123", 0.123), ("approx. US$9.5 thousand", 9.5), ("EUR (3.2) mn", -3.2), ("4,5", 4.5), ("n/a", None), ("", None), (None, None)])
def test_number_formats(spark, text, number):
    row = spark.createDataFrame([(text,)], "v string").select(units.value_number(F.col("v")).alias("n")).first()
    assert row.n == (None if number is None else pytest.approx(number))


def test_sources_of_unit_scale_and_currency(spark):
    rows = [
        ("own", "d", "m", "2020", "2", "millions", "EUR", None, None), ("value", "d", "m", "2020", "US$2.5 million", None, None, None, None), ("title", "d", "m", "2020", "2,500", None, None, "t1", None),
        ("header", "d", "m", "2020", "2.5", None, None, "t2", None), ("note", "d", "m", "2020", "250", None, None, "t3", None), ("plain", "d", "m", "2020", "2500000", None, "$", None, None),
        ("typo", "d", "m", "2020", "2.5", "US$ milions", None, None, None), ("lakh", "d", "m", "2020", "25", "lakh", "Rs.", None, None), ("zh", "d", "m", "2020", "人民币1,250万元", None, None, None, None),
        ("mwh", "d", "e", "2020", "1", "GWh", None, None, None), ("text", "d", "m", "2020", "see note 7", None, "USD", None, None), ("nocur", "d", "m", "2020", "5", None, None, None, None), ("noyear", "d", "m", None, "5", "EUR", None, None, None),
        ("look", "d", "m", "2020", "2.5", "US$ m​illiоns", None, None, None),
    ]
    tables = [("t1", None, None, "Income statement, US$ thousands", ["Item", "2020"], None), ("t2", None, None, "Balance sheet", ["Item", "2020 (US$m)"], []), ("t3", None, None, "合并利润表", None, ["注：除特别注明外，人民币万元。"])]
    got = {r.observation_id: r.amount for r in _converted(spark, rows, tables).collect()}
    assert got["own"] == pytest.approx(2.5e6) and got["value"] == pytest.approx(2.5e6) and got["title"] == pytest.approx(2.5e6) and got["header"] == pytest.approx(2.5e6)
    assert got["note"] == pytest.approx(5e5) and got["plain"] == pytest.approx(2.5e6) and got["typo"] == pytest.approx(2.5e6) and got["lakh"] == pytest.approx(25e3) and got["zh"] == pytest.approx(2.5e6)
    assert got["mwh"] == pytest.approx(1000) and got["look"] == pytest.approx(2.5e6)
    assert got["text"] is None and got["nocur"] is None and got["noyear"] is None


def test_equal_amounts_in_different_units(spark):
    rows = [("a", "d", "m", "2020", "2.5", "millions", "USD", None, None), ("b", "d", "m", "2020", "2,000", "thousands", "EUR", None, None), ("c", "d", "m", "2020", "2.5", "mn", "US$", None, None), ("d", "d", "m", "2020", "25", "millions", "USD", None, None), ("e", "x", "m", "2020", "2500", "thousands", "USD", None, None), ("z", "d", "m", "2020", None, None, None, None, None)]
    pairs = {tuple(r) for r in units.equal_amounts(_converted(spark, rows)).collect()}
    assert pairs == {("a", "b"), ("b", "c")}  # a and c spell one unit in two ways


def test_tolerance_against_brute_force(spark):
    rows = [(f"o{i:03d}", "d", "m", "2020", f"{1000 * (1 + i * 0.0017):.4f}", None if i % 2 else "k", "USD", None, None) for i in range(60)]
    rows = [r if r[5] is None else (*r[:4], f"{float(r[4]) / 1000:.7f}", *r[5:]) for r in rows]
    converted = _converted(spark, rows)
    values = {r.observation_id: (r.amount, r.unit_key) for r in converted.collect()}
    want = {(a, b) for a in values for b in values if a < b and values[a][1] != values[b][1] and abs(values[a][0] - values[b][0]) <= 0.005 * max(values[a][0], values[b][0])}
    assert {tuple(r) for r in units.equal_amounts(converted).collect()} == want


def test_empty(spark):
    assert units.equal_amounts(_converted(spark, [])).count() == 0


def test_short_signs_never_match_by_likeness():
    assert units.weighted_distance("kg", "kt") >= 1 and units.weighted_distance("us$m", "hk$m") >= 2


def _mapped(spark, spellings):
    rows = spark.createDataFrame([(x,) for x in spellings], "s string")
    return {r.spelling: (r.currency, r.dimension, r.base, r.factor) for r in units.alias_dictionary(spark, rows).collect()}


def test_every_swap_and_loss_in_long_aliases_against_brute_force(spark):
    aliases = {row[0]: row[1:] for row in units.alias_rows()}
    chosen = ["million", "thousand", "inthousandsofusd", "inmillionsofusd", "kilowatthours"]
    spellings = set()
    for alias in chosen:
        assert alias in aliases
        spellings |= {alias[:i] + alias[i + 1] + alias[i] + alias[i + 2 :] for i in range(len(alias) - 1)} | {alias[:i] + alias[i + 1 :] for i in range(len(alias))} | {alias[:i] + "q" + alias[i:] for i in range(len(alias))}
    got = _mapped(spark, spellings)

    def allowed(alias):
        return max(int(len(alias) * units.MAX_DISTANCE_SHARE), int(len(alias) >= units.TYPO_LENGTH))

    want = {}
    for spelling in spellings:
        near = [(units.weighted_distance(spelling, a), m) for a, m in aliases.items() if abs(len(a) - len(spelling)) <= allowed(a)]
        near = [(d, m, a) for (d, m), a in zip(near, [a for a in aliases if abs(len(a) - len(spelling)) <= allowed(a)]) if d <= allowed(a)]
        best = min((d for d, _, _ in near), default=None)
        meanings = {m for d, m, _ in near if d == best}
        if len(meanings) == 1:
            want[spelling] = meanings.pop()
    assert got == want
    assert {"milion", "thosand", "inthuosandsofusd", "inmilloinsofusd"} <= set(got)


def test_spellings_between_two_meanings_say_nothing(spark):
    assert _mapped(spark, ["illion", "zillion", "million", None]) == {"million": (None, "money", None, 1e6)}


def _nodes(plan):
    """The nodes of an executed plan, through its adaptive stages."""
    kind = plan.nodeName()
    yield kind, plan
    if kind == "AdaptiveSparkPlan":
        below = [plan.executedPlan()]
    elif kind.endswith("QueryStage"):
        below = [plan.plan()]
    else:
        below = [plan.children().apply(i) for i in range(plan.children().size())]
    for node in below:
        yield from _nodes(node)


def _ran(df):
    rows = df.collect()
    return rows, list(_nodes(df._jdf.queryExecution().executedPlan()))


def test_dictionary_broadcasts_no_row_a_posting(spark):
    rows, nodes = _ran(units.alias_dictionary(spark, spark.createDataFrame([("million",), ("inthuosandsofusd",)], "s string")))
    assert len(rows) == 2
    sent = [node.metrics().get("numOutputRows").get().value() for kind, node in nodes if kind == "BroadcastExchange"]
    assert sent and max(sent) <= len(units.alias_rows())  # of 298,730 postings each was a row


def test_alias_index_holds_every_trigram(spark):
    known = units.alias_rows()
    cut = spark.createDataFrame([row[:1] for row in known], "alias string").select("alias", F.explode(units._trigrams(F.col("alias"))).alias("gram"))
    assert {(known[i][0], gram) for gram, ids in units.alias_index(known).items() for i in ids} == {tuple(r) for r in cut.collect()}


def test_amounts_are_converted_once_for_both_sides_of_the_join(spark):
    rows = [("a", "d", "m", "2020", "2.5", "millions", "USD", None, None), ("b", "d", "m", "2020", "2,000", "thousands", "EUR", None, None)]
    pairs, nodes = _ran(units.equal_amounts(_converted(spark, rows)))
    assert {tuple(r) for r in pairs} == {("a", "b")}
    joins = [kind for kind, _ in nodes if kind.endswith("Join")]
    assert len(joins) == 1  # the rates and the dictionary were looked up before
