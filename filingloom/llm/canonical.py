"""Visually identical text brought to one consistent form (problem 7).

Suspect words and blanks are found in SQL, reduced to their distinct spellings and folded through a
look-alike map. Folded spellings that are equal under the accent-sensitive Unicode collation form a
class (the collation also equates composed and combining accents); a deterministic member (without
combining marks, shortest, smallest in byte order) is its canonical form and is joined back.

Suspect is: an invisible character; a blank other than the plain one; a full-width or mathematical
letter or digit; half-width katakana; a combining accent; a CJK radical or compatibility ideograph; a
Latin ligature; a look-alike of another script (Cyrillic, Greek, Armenian, Cherokee, phonetic, Roman
numeral) in a word with Latin letters; full-width punctuation in a text that is not Chinese.
Words wholly in another script, single Greek symbols and those before a short index ("αmax"),
superscripts, circled numbers (ordinary list marks) and composed letters (the Turkish dotless i among
them) stay as they are. Null values and null keys yield no row, empty texts stay empty; repeated rows stay in
``normalised``; an empty table gives an empty result. Texts are processed whole.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingloom.functions.lookalike import FOREIGN, GREEK_SYMBOLS, LATIN, simple_fold
from filingloom.session import materialise

_INVISIBLE = r"­͏؜ᅟᅠ᠎​-‏‪-‮⁠-⁤⁦-⁯︀-️﻿"
_BLANK = r"   -     　"
_WIDE = "０-９Ａ-Ｚａ-ｚｦ-ﾝ\U0001d400-\U0001d6a5\U0001d7ce-\U0001d7ff"
_WIDE_PUNCTUATION = r"！-／：-＠［-｀｛-～"
_MARK = r"̀-ͯ"
_IDEOGRAPH = r"⺀-⿟豈-﫿"
_LIGATURE = r"ﬀ-ﬆ"
_LATIN = r"A-Za-zÀ-ɏ"
_HAN = r"[㐀-䶿一-鿿]"
#: Latin ligatures and their letters.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
#: Base letter with a combining mark, and the composed letter (derived from Unicode data).
COMPOSED = {d: chr(c) for low, high in ((0xC0, 0x24F), (0x1E00, 0x1EFF)) for c in range(low, high + 1) if len(d := unicodedata.normalize("NFD", chr(c))) == 2}
#: A cheap test that most texts pass: nothing but ASCII, ideographs, composed letters and common signs.
_UNUSUAL = r"[^\x00-\x7F一-鿿！-～、-】–-…À-ɏ€£¥]"
#: Characters that are suspect wherever they stand.
_ODD = f"{_INVISIBLE}{_WIDE}{_MARK}{_IDEOGRAPH}{_LIGATURE}"
SUSPECT = f"[{_ODD}{_BLANK}{FOREIGN}]"
#: A run of Latin letters, digits and suspect characters with something suspect in it, or a run of
#: odd blanks. It starts where no such run goes on and never steps back, so it takes linear time.
_SPAN = f"(?<![{_LATIN}\\d{_ODD}{FOREIGN}])[{_LATIN}\\d]*+[{_ODD}{FOREIGN}][{_LATIN}\\d{_ODD}{FOREIGN}]*+|[{_BLANK}]+"
_SPAN_WITHOUT_HAN = f"{_SPAN}|[{_WIDE_PUNCTUATION}]+"


def _spans(text: Column, chinese: Column) -> Column:
    """Suspect spans of a text, in order; empty for the many texts without any."""
    none = F.array().cast("array<string>")
    suspect = text.rlike(f"{_UNUSUAL}|[{_WIDE}]") & text.rlike(SUSPECT)
    found = F.when(F.octet_length(text) == F.length(text), none).when(text.rlike(f"[{_WIDE_PUNCTUATION}]") & ~chinese, F.regexp_extract_all(text, F.lit(_SPAN_WITHOUT_HAN), F.lit(0))).when(suspect, F.regexp_extract_all(text, F.lit(_SPAN), F.lit(0)))
    return F.coalesce(found, none)


def _folded(span: Column) -> Column:
    """Look-alike map: invisible characters go, wide forms narrow, foreign letters follow the word."""
    narrow = simple_fold(span)
    for ligature, letters in LIGATURES.items():
        narrow = F.replace(narrow, F.lit(ligature), F.lit(letters))
    # a full-width mark on its own stands in a text without ideographs
    punctuation = F.when(span.rlike(f"^[{_WIDE_PUNCTUATION}]+$"), simple_fold(span, punctuation=True)).otherwise(narrow)
    symbol = punctuation.rlike(f"^[{GREEK_SYMBOLS}][A-Za-z]{{1,3}}$")
    return F.when(punctuation.rlike(f"[{_LATIN}]") & ~symbol, F.translate(punctuation, FOREIGN, LATIN)).otherwise(punctuation)


def _composed(text: Column) -> Column:
    """Letters and their combining marks as one character where there is one."""
    pairs = F.create_map(*(F.lit(x) for pair in COMPOSED.items() for x in pair))

    def step(done: Column, ch: Column) -> Column:
        last = F.concat(F.right(done, F.lit(1)), ch)
        return F.when(F.element_at(pairs, last).isNotNull(), F.concat(F.substring(done, F.lit(1), F.length(done) - 1), F.element_at(pairs, last))).otherwise(F.concat(done, ch))

    return F.when(text.rlike(f"[{_MARK}]"), F.aggregate(F.split(text, ""), F.lit(""), step)).otherwise(text)


def spelling_classes(spans: DataFrame) -> DataFrame:
    """(span, canonical) of the distinct values of ``span``, one class per collation key."""
    # explode and distinct first: the fold runs once per spelling
    distinct = spans.select("span").distinct()
    folded = distinct.select("span", _folded(F.col("span")).alias("folded"))
    members = folded.select("span", F.explode(F.array_distinct(F.array("folded", _composed(F.col("folded"))))).alias("member"))
    key = F.collate("member", "UNICODE")
    rank = F.struct(F.col("member").rlike(f"[{_MARK}]").alias("marked"), F.length("member").alias("size"), F.col("member").alias("member"))
    canonical = members.groupBy(key.alias("class")).agg(F.min(rank).alias("best")).select("class", F.col("best.member").alias("canonical"))
    return folded.select("span", F.collate("folded", "UNICODE").alias("class")).join(canonical, "class").select("span", "canonical")


def text_values(tables: DataFrame, segments: DataFrame) -> DataFrame:
    """Titles, headers and segment contents as ``(item_key, field_name, position, text, chinese)``."""
    # a header of a Chinese table is Chinese text, even where it holds a year and a sign alone
    chinese = F.coalesce(F.concat_ws(" ", "title", F.concat_ws(" ", "headers")).rlike(_HAN), F.lit(False)).alias("chinese")
    titles = tables.select(F.col("id").alias("item_key"), F.lit("title").alias("field_name"), F.lit(0).alias("position"), F.col("title").alias("text"), chinese)
    headers = tables.select(F.col("id").alias("item_key"), F.lit("headers").alias("field_name"), chinese, F.posexplode("headers").alias("position", "text"))
    contents = segments.select(F.col("segment_id").alias("item_key"), F.lit("content").alias("field_name"), F.lit(0).alias("position"), F.col("content").alias("text"), F.col("content").rlike(_HAN).alias("chinese"))
    return titles.unionByName(headers).unionByName(contents).where("item_key IS NOT NULL AND text IS NOT NULL")


def repairs(values: DataFrame) -> DataFrame:
    """(item_key, field_name, position, span, canonical) of every span that is not canonical."""
    # the texts are read once: classes and join need the few suspect spans only
    spans = materialise(values.select("item_key", "field_name", "position", F.explode(F.array_distinct(_spans(F.col("text"), F.col("chinese")))).alias("span")))
    return spans.join(spelling_classes(spans), "span").where("span <> canonical")


def found(values: DataFrame) -> DataFrame:
    return repairs(values).select("item_key", "field_name").distinct()


def normalised(values: DataFrame) -> DataFrame:
    """Every value with its text in the consistent form."""
    keys = ["item_key", "field_name", "position"]
    # longer spans first, so that none is cut by a shorter one inside it
    edits = repairs(values).groupBy(*keys).agg(F.sort_array(F.collect_set(F.struct(F.length("span").alias("size"), "span", "canonical")), asc=False).alias("edits"))
    rewritten = F.aggregate(F.coalesce("edits", F.array().cast("array<struct<size:int,span:string,canonical:string>>")), F.col("text"), lambda t, e: F.replace(t, e["span"], e["canonical"]))
    return values.join(edits, keys, "left").select(*keys, rewritten.alias("text"), F.col("edits").isNotNull().alias("changed"))
