"""Amounts recorded in different units, scales and currencies brought to common units (problem 2).

Steps:

1. Collect the distinct unit spellings of all rows: own unit and currency, what stands around the
   number in the value, and the unit, currency, title, headers and footnotes of the source table.
2. Map each distinct spelling to a known alias: an inverted index over padded character trigrams
   yields candidates (prefix filter: the rarest trigrams, enough that no alias within the allowed
   distance is missed, swaps of neighbours included), a weighted edit distance verifies them. Digits,
   currency signs and ideographs cost more than letters, so that short signs never match each other.
   A spelling equally near to aliases of different meaning says nothing.
3. Join the alias dictionary to all rows and convert: money to USD at the rate of the year in the
   period, energy to MWh, mass to tonnes, volume to cubic metres, ratios to plain numbers.

Only distinct spellings pass through Python; rows stay in built-in expressions. The dictionary has
one row per distinct spelling. It is broadcast only after its rows were counted and are at most
``BROADCAST_ROWS``; beyond that it is joined by shuffle.

Defined results: a row without a number, without a year for its rate, or with money in no known
currency keeps null in ``amount``; money with no scale anywhere is in whole units; null or unknown
spellings say nothing; repeated rows stay; an empty table gives an empty result. Output columns are
fixed, so extra input columns cannot clash.
"""

from __future__ import annotations

from itertools import product

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filingloom.functions.lookalike import full_fold
from filingloom.session import materialise

#: Rows up to which the alias dictionary is broadcast.
BROADCAST_ROWS = 50_000
#: Largest weighted edit distance, as a share of the alias length, that still counts as a typo.
MAX_DISTANCE_SHARE = 0.12
#: Length from which on one mistyped letter is allowed, however short the alias.
TYPO_LENGTH = 6

#: Spellings of currencies.
CURRENCIES = {
    "USD": ("USD", "US$", "$", "US dollars", "US dollar", "dollars", "U.S. dollars", "美元"),
    "EUR": ("EUR", "€", "euro", "euros", "欧元"),
    "GBP": ("GBP", "£", "pounds sterling", "pound sterling", "sterling", "pounds", "英镑"),
    "CNY": ("CNY", "RMB", "¥", "yuan", "renminbi", "人民币", "人民币元", "Chinese yuan"),
    "HKD": ("HKD", "HK$", "Hong Kong dollars", "港元", "港币"),
    "INR": ("INR", "₹", "Rs.", "Rs", "rupees", "Indian rupees", "卢比"),
}
#: Spellings of scales.
SCALES = {
    1.0: ("units", "unit", "whole currency units", "whole", "ones"),
    1e3: ("thousand", "thousands", "'000", "000s", "k", "千", "千元", "tsd"),
    1e4: ("ten thousand", "ten thousands", "tens of thousands", "万", "万元"),
    1e5: ("lakh", "lakhs", "lac", "lacs"),
    1e6: ("million", "millions", "mn", "m", "mio", "百万", "百万元", "mln"),
    1e7: ("crore", "crores", "cr", "千万", "千万元"),
    1e8: ("hundred million", "hundred millions", "hundreds of millions", "亿", "亿元"),
    1e9: ("billion", "billions", "bn", "b", "十亿", "十亿元"),
    1e12: ("trillion", "trillions", "tn", "万亿", "万亿元"),
}
#: Base, spelling of physical units and the factor to the common unit.
PHYSICAL = {
    "MWh": (("Wh", 1e-3, ("kWh", "千瓦时", "kilowatt-hours", "kilowatt hours", "度")), ("Wh", 1.0, ("MWh", "megawatt-hours", "megawatt hours", "兆瓦时")), ("Wh", 1e3, ("GWh", "gigawatt-hours", "gigawatt hours", "吉瓦时")), ("Wh", 1e6, ("TWh", "terawatt-hours")), ("Wh", 10.0, ("万kWh", "万千瓦时", "万度")), ("Wh", 1e5, ("亿千瓦时", "亿kWh")), ("J", 1 / 3.6, ("GJ", "gigajoules", "吉焦")), ("J", 1000 / 3.6, ("TJ", "terajoules", "太焦"))),
    "t": (("g", 1e-3, ("kg", "kilograms", "千克", "公斤", "kg CO2e")), ("g", 1.0, ("t", "tonnes", "tonne", "metric tons", "metric tonnes", "tons", "吨", "tonnes CO2e", "tCO2e", "吨二氧化碳当量")), ("g", 1e3, ("kt", "thousand tonnes", "ktCO2e", "thousand tonnes CO2e", "kilotonnes", "千吨")), ("g", 1e4, ("万吨", "万吨二氧化碳当量", "ten thousand tonnes")), ("g", 1e6, ("Mt", "million tonnes", "MtCO2e", "million tonnes CO2e", "百万吨")), ("lb", 0.00045359237, ("lb", "lbs", "pounds weight", "磅"))),
    "m3": (("m3", 1.0, ("m3", "m³", "cubic metres", "cubic meters", "立方米")), ("m3", 1e3, ("thousand m3", "thousand m³", "thousand cubic metres", "千立方米")), ("m3", 1e4, ("万立方米", "ten thousand m3")), ("m3", 1e6, ("million m3", "million cubic metres", "百万立方米")), ("l", 1e-3, ("litres", "liters", "l", "升")), ("l", 1.0, ("kilolitres", "kl")), ("l", 1e3, ("ML", "megalitres", "megaliters"))),
    "ratio": (("1", 1.0, ("ratio", "比率")), ("%", 1e-2, ("%", "per cent", "percent", "pct", "百分比")), ("bp", 1e-4, ("bps", "basis points", "bp", "基点"))),
}
#: Templates of a scale and a currency named together; blanks do not count.
TEMPLATES = ("{c}{s}", "{s}{c}", "{s}of{c}", "in{s}of{c}", "in{s}{c}", "in{c}{s}", "{c}in{s}", "单位:{s}{c}", "单位:{s}币种:{c}", "{c}({s})")


def _key(text: str) -> str:
    return "".join(text.lower().split())


def alias_rows() -> list[tuple]:
    """All aliases, generated from the fixed spellings and templates; the first meaning wins."""
    rows: dict[str, tuple] = {}

    def add(alias: str, *meaning) -> None:
        rows.setdefault(_key(alias), meaning)

    for dimension, units in PHYSICAL.items():
        for base, factor, spellings in units:
            for spelling in spellings:
                add(spelling, None, dimension, base, factor)
    for factor, spellings in SCALES.items():
        for spelling in spellings:
            for alias in (spelling, f"in {spelling}", f"单位:{spelling}", f"({spelling})"):
                add(alias, None, "money", None, factor)
    for currency, names in CURRENCIES.items():
        for name in names:
            for alias in (name, f"in {name}", f"in whole {name}", f"{name} units", f"币种:{name}"):
                # a bare currency names no scale, "whole" and "units" do
                add(alias, currency, "money", None, 1.0 if "units" in alias or "whole" in alias else None)
        for (factor, scales), name in product(SCALES.items(), names):
            for scale, template in product(scales, TEMPLATES):
                add(template.format(c=name, s=scale), currency, "money", None, factor)
    add("元", "CNY", "money", None, 1.0)
    add("单位:元", None, "money", None, 1.0)
    for name in CURRENCIES["CNY"]:
        add(f"单位:元币种:{name}", "CNY", "money", None, 1.0)
        add(f"单位:元{name}", "CNY", "money", None, 1.0)
    return [(alias, *meaning) for alias, meaning in rows.items()]


def alias_index(rows: list[tuple]) -> dict[str, list[int]]:
    """Positions of the aliases that hold a trigram, cut as ``_trigrams`` cuts the spellings."""
    index: dict[str, list[int]] = {}
    for i, (alias, *_) in enumerate(rows):
        padded = f"\u0002\u0002{alias}\u0003\u0003"
        for gram in dict.fromkeys(padded[k : k + 3] for k in range(len(padded) - 2)):
            index.setdefault(gram, []).append(i)
    return index


def phrase_key(text: Column) -> Column:
    """Comparable form of a unit spelling: folded, lower case, no blanks; null where empty."""
    folded = F.regexp_replace(F.lower(full_fold(text)), r"\s+", "")
    stripped = F.regexp_replace(folded, r"^[,;.\-–—]+|[,;。]+$", "")
    return F.nullif(stripped, F.lit(""))


def _weight(ch: str) -> float:
    """Cost of losing or changing a character: letters are often mistyped, signs are not."""
    return 1.0 if ch.isascii() and ch.isalpha() else 3.0


def weighted_distance(a: str, b: str) -> float:
    """Edit distance with swaps of neighbours; the dearer of two characters sets the price."""
    before, last = None, [0.0]
    for ch in b:
        last.append(last[-1] + _weight(ch))
    for i, x in enumerate(a):
        row = [last[0] + _weight(x)]
        for j, y in enumerate(b):
            change = 0.0 if x == y else max(_weight(x), _weight(y))
            best = min(last[j] + change, last[j + 1] + _weight(x), row[j] + _weight(y))
            if before is not None and j and x == b[j - 1] and y == a[i - 1] and x != y:
                best = min(best, before[j - 1] + max(_weight(x), _weight(y)))
            row.append(best)
        before, last = last, row
    return last[-1]


def _allowed(length: Column) -> Column:
    """Weighted distance up to which a spelling counts as a typing error of an alias so long."""
    return F.greatest(F.floor(length * MAX_DISTANCE_SHARE), (length >= TYPO_LENGTH).cast("int"))


def _most_allowed(length: Column) -> Column:
    """The same for the longest alias a spelling so long can be a typing error of."""
    # an alias longer by d allows d at most: L + d stays below L / (1 - share)
    return _allowed(F.ceil(length / (1 - MAX_DISTANCE_SHARE)) + 1)


def _trigrams(text: Column) -> Column:
    padded = F.concat(F.lit("\u0002\u0002"), text, F.lit("\u0003\u0003"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3))))


def alias_dictionary(spark: SparkSession, spellings: DataFrame) -> DataFrame:
    """Dictionary ``spelling -> meaning`` for the distinct non-null values of one column.

    A spelling takes the nearest alias within its allowed distance, and none if the nearest disagree.
    """
    from filingloom.functions.local import local_table

    column = spellings.columns[0]
    distinct = spellings.select(F.col(column).alias("spelling")).where("spelling IS NOT NULL").distinct()
    known = alias_rows()
    numbers = {meaning: i for i, meaning in enumerate(dict.fromkeys(row[1:] for row in known), 1)}
    aliases = local_table(spark, [(i, row[0], numbers[row[1:]]) for i, row in enumerate(known)], "id int, alias string, meaning int")
    meanings = local_table(spark, [(i, *meaning) for meaning, i in numbers.items()], "meaning int, currency string, dimension string, base string, factor double")
    # a row a trigram, not a row a posting: the index is built and held by the driver
    index = local_table(spark, [(gram, len(ids), ids) for gram, ids in alias_index(known).items()], "gram string, found int, ids array<int>")
    # an edit changes at most 3 trigrams, a swap of neighbours 4: of the 4 d + 1 rarest of a spelling,
    # an alias within d edits has at least one
    grams = distinct.select("spelling", F.explode(_trigrams(F.col("spelling"))).alias("gram"))
    ranked = grams.join(F.broadcast(index.select("gram", "found")), "gram", "left").groupBy("spelling").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("found", F.lit(0)).alias("found"), "gram"))).alias("grams"))
    probes = ranked.select("spelling", F.explode(F.slice("grams", 1, (_most_allowed(F.length("spelling")) * 4 + 1).cast("int"))).alias("probe")).where("probe.found > 0").select("spelling", F.col("probe.gram").alias("gram"))
    near = F.abs(F.length("alias") - F.length("spelling")) <= _allowed(F.length("alias"))
    posted = probes.join(F.broadcast(index.select("gram", "ids")), "gram").select("spelling", F.explode("ids").alias("id"))
    candidates = posted.join(F.broadcast(aliases), "id").where(near).select("spelling", "alias", "meaning").distinct()
    # neighbours swapped are two plain edits: a bound that needs no Python
    candidates = candidates.where(F.levenshtein("spelling", "alias") <= 2 * _allowed(F.length("alias")))

    @F.pandas_udf("double")
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([weighted_distance(x, y) for x, y in zip(a, b)], dtype="float64")

    distance = distance.asNondeterministic()  # else the filter below makes it run twice
    verified = candidates.withColumn("distance", distance("spelling", "alias")).where(F.col("distance") <= _allowed(F.length("alias")))
    # nearest first; of the aliases at the same distance all must mean the same
    ends = verified.groupBy("spelling").agg(F.min(F.struct("distance", "meaning")).alias("low"), F.min(F.struct("distance", (-F.col("meaning")).alias("meaning"))).alias("high"))
    agreed = ends.where(F.col("low.meaning") == -F.col("high.meaning")).select("spelling", F.col("low.meaning").alias("meaning"))
    return agreed.join(F.broadcast(meanings), "meaning").select("spelling", "currency", "dimension", "base", "factor")


#: A number: grouped or plain digits with an optional fraction.
_NUMBER = r"\d(?:[\d.,'    ]*\d)?"
_APPROX = r"^\s*(?:approx(?:imately)?\.?|about|around|circa|ca?\.|约|大约|~|≈)\s*"


def value_text(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(value, "    −–（）", "    --()"), "(?i)" + _APPROX, ""))


def value_number(value: Column) -> Column:
    """The number in a value: English, German, spaced and Indian grouping; parentheses negate."""
    text = F.regexp_replace(value_text(value), "'000", "")
    digits = F.regexp_replace(F.regexp_extract(text, f"({_NUMBER})", 1), r"[ '   ]", "")
    comma, dot = F.length(digits) - F.length(F.replace(digits, F.lit(","), F.lit(""))), F.length(digits) - F.length(F.replace(digits, F.lit("."), F.lit("")))
    decimal_comma = ((comma == 1) & (dot >= 1) & (F.instr(digits, ",") > F.instr(digits, "."))) | ((comma == 1) & (dot == 0) & ~digits.rlike(r"^\d{1,3},\d{3}$")) | ((dot > 1) & (comma <= 1))
    plain = F.when(decimal_comma, F.translate(F.replace(digits, F.lit("."), F.lit("")), ",", ".")).otherwise(F.replace(digits, F.lit(","), F.lit("")))
    sign = F.when(text.rlike(r"\([^\d()]*\d[^()]*\)") | text.rlike(r"-\s*[^\d\s]{0,4}\s*\d") & ~text.rlike(r"\d\s*-\s*\d"), -1.0).otherwise(1.0)
    return sign * plain.try_cast("double")


def value_phrase(value: Column) -> Column:
    """What stands around the number: unit, scale and currency together."""
    text = value_text(value)
    around = F.regexp_replace(text, f"^([^\\d]*?)[(-]*\\s*{_NUMBER}\\)?", "$1 ")
    return F.trim(F.regexp_replace(around, r"[()]|-(?=\s|$)", " "))


def title_phrase(title: Column) -> Column:
    """Unit named at the end of a title: after a comma or dash, or in parentheses."""
    folded = full_fold(title)
    return F.nullif(F.regexp_extract(folded, r"(?:,\s*|\s-\s|\()([^()]*(?:\([^()]*\))?[^()]*?)\)?\s*$", 1), F.lit(""))


def header_phrase(headers: Column, period: Column) -> Column:
    """Unit in parentheses of the header of a period; else of any header."""
    folded = F.transform(headers, full_fold)
    named = F.filter(folded, lambda h: h.rlike(r"\d{4}\s*\(.+\)"))
    own = F.filter(named, lambda h: F.startswith(h, F.substring(period, 1, 4)))
    return F.regexp_extract(F.coalesce(F.get(own, F.lit(0)), F.get(named, F.lit(0))), r"\((.+)\)", 1)


def footnote_phrase(footnotes: Column) -> Column:
    """Unit of a footnote such as "All amounts ... unless stated otherwise"."""
    folded = F.transform(footnotes, full_fold)
    pattern = r"(?i)^\s*(?:all\s+)?(?:amounts?|figures)\s+(?:are\s+)?(?:stated\s+|expressed\s+|presented\s+)?(.+?)\s+(?:unless|except)\b|除特别注明外\s*,\s*(.+?)\s*[。.]?\s*$"
    found = F.get(F.filter(folded, lambda n: n.rlike(pattern)), F.lit(0))
    return F.nullif(F.concat(F.regexp_extract(found, pattern, 1), F.regexp_extract(found, pattern, 2)), F.lit(""))


#: Places a unit may stand in, in the order in which they decide.
_OBSERVED = ("value", "unit", "currency")
_TABLED = ("t_unit", "t_currency", "t_header", "t_title", "t_note")


def convert(observations: DataFrame, tables: DataFrame, rates: DataFrame) -> DataFrame:
    """Every observation with its unit and its amount in the common unit of its dimension.

    Returns ``observation_id, document_id, metric_key, period, number, dimension, unit_key,
    currency_code, amount``. ``unit_key`` is equal for two spellings of one unit.
    """
    spark = observations.sparkSession
    year = F.regexp_extract("period", r"((?:19|20)\d{2})", 1).try_cast("int")
    base = observations.select(
        "observation_id", "document_id", "metric_key", "period", "source_table_id", year.alias("year"), value_number(F.col("value")).alias("number"),
        phrase_key(value_phrase(F.col("value"))).alias("p_value"), phrase_key(F.col("unit")).alias("p_unit"), phrase_key(F.col("currency")).alias("p_currency"), phrase_key(title_phrase(F.col("source_table_title"))).alias("p_own_title"),
    )
    named = tables.select(
        F.col("id").alias("source_table_id"), phrase_key(F.col("unit")).alias("p_t_unit"), phrase_key(F.col("currency")).alias("p_t_currency"),
        phrase_key(title_phrase(F.col("title"))).alias("p_t_title"), phrase_key(footnote_phrase(F.col("footnotes"))).alias("p_t_note"),
        F.transform(F.filter("headers", lambda h: full_fold(h).rlike(r"\d{4}\s*\(.+\)")), full_fold).alias("unit_headers"),
    )
    header = phrase_key(header_phrase(F.col("unit_headers"), F.col("period")))
    table_phrases = named.select(F.explode(F.concat(F.array("p_t_unit", "p_t_currency", "p_t_title", "p_t_note"), F.transform("unit_headers", lambda h: phrase_key(F.regexp_extract(h, r"\((.+)\)", 1))))).alias("spelling"))
    phrases = base.select(F.explode(F.array("p_value", "p_unit", "p_currency", "p_own_title")).alias("spelling")).unionByName(table_phrases)
    dictionary = materialise(alias_dictionary(spark, phrases))
    small = dictionary.count() <= BROADCAST_ROWS

    def looked_up(df: DataFrame, name: str) -> DataFrame:
        meaning = dictionary.select(F.col("spelling").alias(f"p_{name}"), F.struct("currency", "dimension", "base", "factor").alias(f"m_{name}"))
        return df.join(F.broadcast(meaning) if small else meaning, f"p_{name}", "left").drop(f"p_{name}")

    for place in ("t_unit", "t_currency", "t_title", "t_note"):
        named = looked_up(named, place)
    for place in (*_OBSERVED, "own_title"):
        base = looked_up(base.withColumn("has_phrase", F.col("p_value").isNotNull()) if place == "value" else base, place)
    rows = looked_up(base.join(named, "source_table_id", "left").withColumn("p_t_header", header), "t_header")
    order = (*_OBSERVED, *_TABLED, "own_title")
    currency = F.coalesce(*(F.col(f"m_{p}.currency") for p in order))
    scale = F.coalesce(*(F.when(F.col(f"m_{p}.dimension") == "money", F.col(f"m_{p}.factor")) for p in order), F.lit(1.0))
    physical = F.coalesce(*(F.when(F.col(f"m_{p}.dimension") != "money", F.col(f"m_{p}")) for p in ("value", "unit", "t_unit")))
    # words around a number that are no unit ("see note 7") mean that it is no amount
    number = F.when(F.col("has_phrase") & F.col("m_value").isNull(), None).otherwise(F.col("number"))
    rows = rows.select("observation_id", "document_id", "metric_key", "period", "year", number.alias("number"), physical.alias("physical"), scale.alias("scale"), currency.alias("currency_code"))
    dimension = F.coalesce("physical.dimension", F.when(F.col("currency_code").isNotNull(), "USD"))
    unit_key = F.when(F.col("physical").isNotNull(), F.concat_ws("|", "physical.base", F.col("physical.factor"))).otherwise(F.concat_ws("|", "currency_code", F.col("scale")))
    # the rate table is fixed: one row per currency and year
    rate = rates.select(F.col("currency").alias("currency_code"), F.col("rate_year").alias("year"), "usd_per_unit")
    priced = rows.join(F.broadcast(rate), ["currency_code", "year"], "left")
    amount = F.when(F.col("physical").isNotNull(), F.col("number") * F.col("physical.factor")).otherwise(F.col("number") * F.col("scale") * F.col("usd_per_unit"))
    return priced.select("observation_id", "document_id", "metric_key", "period", "number", dimension.alias("dimension"), unit_key.alias("unit_key"), F.when(F.col("physical").isNull(), F.col("currency_code")).alias("currency_code"), amount.alias("amount"))


#: Width of an amount bin on the log scale: amounts within 0.5 % lie in equal or neighbouring bins.
TOLERANCE = 0.005
_BIN = 0.0050126


def equal_amounts(converted: DataFrame) -> DataFrame:
    """Pairs recorded in different units whose amounts agree within 0.5 % of the larger one.

    A range join: the equi-key holds a bin of the amount, one side is put into its neighbouring
    bins as well, so even a huge group is only compared with amounts next to its own.
    """
    # null period is a group of its own by no rule: rows without a key take no part
    rows = converted.where("amount IS NOT NULL AND document_id IS NOT NULL AND metric_key IS NOT NULL AND period IS NOT NULL")
    size = F.floor(F.log(F.abs("amount")) / _BIN)
    rows = rows.select("observation_id", "document_id", "metric_key", "period", "dimension", "unit_key", "amount", F.when(F.col("amount") == 0, F.lit(-(10**9))).otherwise(size).cast("long").alias("bin"))
    # both sides of the join read these rows: written once, else the plan holds the whole conversion twice
    rows = materialise(rows)
    keys = ["document_id", "metric_key", "period", "dimension", "bin"]
    left = rows.select(*keys, F.col("observation_id").alias("a"), F.col("unit_key").alias("unit_a"), F.col("amount").alias("amount_a"))
    right = rows.withColumn("bin", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1))).select(*keys, F.col("observation_id").alias("b"), F.col("unit_key").alias("unit_b"), F.col("amount").alias("amount_b"))
    close = F.abs(F.col("amount_a") - F.col("amount_b")) <= TOLERANCE * F.greatest(F.abs("amount_a"), F.abs("amount_b"))
    # its compressed size would pass for small enough to broadcast
    pairs = left.hint("merge").join(right, keys).where((F.col("a") < F.col("b")) & (F.col("unit_a") != F.col("unit_b")) & close)
    return pairs.select(F.col("a").alias("observation_id_a"), F.col("b").alias("observation_id_b"))
