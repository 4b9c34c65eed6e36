"""Noise of scanned pages found and repaired (problem 6).

* Page numbers and running headers are whole lines; a line of a year in a list of years is none. A line
  is a running header if it has the form of one (a report's title with a name), or if it is the first
  or last line of ``REPEATED`` or more pages of one document, digits aside, while what lies between
  differs.
* A word split at a line end is told from a compound by the corpus: the joined spelling must occur
  in more items than the hyphenated one; without either, the hyphen is taken as the compound's own.
* Misread words: the words of all items form a frequency lexicon. Symmetric deletes (up to
  ``MAX_DELETES`` confusable characters taken out of both sides, after merging letter pairs such as
  ``rn``) index it and yield candidates; a weighted edit distance in which confusion pairs are cheap
  verifies them; the frequency ratio decides, and where it does not, bigram context does.
* Misread ideographs: fixed pairs of similar characters, decided by their bigrams on both sides; other
  pairs are not looked for.
* Misread digits: a letter l, I or O inside an otherwise numeric token.

Counts are over all items. Everything but the verification of candidate word pairs runs in the JVM;
dictionaries hold distinct spellings, are counted and broadcast only up to ``BROADCAST_ROWS``.

Null texts and null keys yield no row; empty texts have no noise; very long texts are read whole;
repeated items count as often as they occur; an empty table gives an empty result. Only the key and
the text are read, so extra columns cannot clash.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingloom.functions.local import local_table
from filingloom.functions.lookalike import foreign_fold, simple_fold
from filingloom.session import materialise

BROADCAST_ROWS = 100_000
MAX_DELETES = 3
#: Words longer than this are indexed by what they keep without confusable characters.
LONG_WORD = 24
#: Pages of a document on which a line must stand first or last to be its running header, and its longest form.
REPEATED, LONGEST_HEADER = 3, 140
#: How many times more items the right spelling must occur in: for spellings no word can have, for
#: spellings that could be words, and for those only bigram context can settle.
RATIO_IMPOSSIBLE, RATIO_WORD, RATIO_CONTEXT = 1.0, 20.0, 2.0

#: What is printed and what is recognised instead.
CONFUSIONS = (
    ("e", "c"), ("i", "!"), ("l", "1"), ("l", "i"), ("l", "!"), ("l", "|"), ("i", "1"), ("i", "l"), ("i", "|"), ("o", "0"), ("h", "b"), ("s", "5"), ("g", "9"), ("b", "8"), ("z", "2"),
    ("m", "rn"), ("d", "cl"), ("u", "ii"), ("w", "vv"), ("h", "li"), ("rn", "m"), ("cl", "d"), ("vv", "w"),
)
#: Similar ideographs, right and misread.
IDEOGRAPHS = ("利刊", "元兀", "期朗", "现観", "入人", "减滅", "营菅", "未末", "本木", "已己", "日曰", "土士", "大太", "天夭", "贷货", "千干", "间问", "问间", "币市", "账帐", "人入", "末未", "己已", "太大", "货贷", "干千", "候侯", "徽微")
#: Letter pairs merged before deletes, and the characters deletes may take out.
MERGED = (("rn", "m"), ("cl", "d"), ("ii", "u"), ("vv", "w"))
CONFUSABLE = "eci!l1|o0hbs5g9z28"

#: Letters of Latin words; ranges are far cheaper to match than the script property.
_LAT = "A-Za-zÀ-ÖØ-öø-ɏḀ-ỿ"
_HAN = r"[㐀-䶿一-鿿]"
#: Longest line that can be a page number, and words without which no line has the form of a header.
LONGEST_PAGE = 40
_HEADER_WORD = r"(?i:report|financial statements)|报告"
_PAGE_LINE = (
    r"(?m)^[ \t]*(?:(?i:page|seite|p\.|pg\.)[ \t]*[\dlIO]{1,4}(?:[ \t]*(?i:of|/|von)[ \t]*[\dlIO]{1,4})?|[\dlIO]{1,4}[ \t]*/[ \t]*[\dlIO]{1,4}|[-–—~·•*][ \t]*[\dlIO]{1,4}[ \t]*[-–—~·•*]|\[[ \t]*[\dlIO]{1,4}[ \t]*\]|F-\d{1,3}"
    r"|第[ \t]*\d{1,4}[ \t]*页(?:[ \t]*[,，/]?[ \t]*共[ \t]*\d{1,4}[ \t]*页)?|(?!(?:19|20)\d\d[ \t]*$)\d{1,4}|(?=[ivxl]{1,7}[ \t]*$)x{0,3}(?:ix|iv|v?i{0,3}))[ \t]*$"
)
_TITLE = r"(?:(?i:annual report|interim report|half-year(?:ly)? report|quarterly report)[ \t]*(?:19|20)\d\d|(?i:notes to the (?:consolidated )?financial statements))"
_ZH_TITLE = r"(?:19|20)\d\d[ \t]*年?[ \t]*(?:年度报告|半年度报告|中期报告|季度报告)(?:全文|摘要)?"
_PAGE = r"(?:\d{1,4})"
_HEADER_LINE = (
    f"(?m)^[ \\t]*(?:{_PAGE}[ \\t]{{2,}})?(?:[\\p{{Lu}}\\d][^\\n]{{0,120}}?(?:[ \\t]+|[ \\t]*[-–—|·][ \\t]*){_TITLE}|{_TITLE}[ \\t]*[-–—|·][ \\t]*[^\\n]{{2,120}}?"
    f"|[^\\n。，；]{{2,60}}?(?:公司|集团)[ \\t]*{_ZH_TITLE}|{_ZH_TITLE}[ \\t]*[-–—|·]?[ \\t]*[^\\n。，；]{{2,60}}?(?:公司|集团))(?:[ \\t]*\\|[ \\t]*{_PAGE}|[ \\t]{{2,}}{_PAGE})?[ \\t]*$"
)
#: A header line that carries the page number as well.
_NUMBERED_HEADER = r"(?m)^[ \t]*\d{1,4}[ \t]{2,}\S|\S(?:[ \t]{2,}|[ \t]*\|[ \t]*)\d{1,4}[ \t]*$"
_BREAK = r"([" + _LAT + r"][" + _LAT + r"\d'’!|\-]*?)([-¬])[ \t]*\n\s*([" + _LAT + r"\d!|][" + _LAT + r"\d'’!|\-]*)"
_WORD = r"(?<![\p{L}\p{N}])[" + _LAT + r"\d!|](?:[" + _LAT + r"\d'’!|\-]*[" + _LAT + r"\d!|])(?![\p{L}\p{N}])"
#: What every such number holds; cheap to look for.
_NEAR_NUMBER = r"\d[.,\-]?[lIO]|[lIO][.,\-]?\d"
_NUMBER = r"(?<![\p{L}\p{N}\-.,])(?=[\dlIO.,\-]*\d)(?=[\d.,\-]*[lIO])[\dlIO]+(?:[.,\-][\dlIO]+)*(?![\p{L}\p{N}])|(?<=[\d][\-.,])(?=[\dlIO.,\-]*\d)(?=[\d]*[lIO])[\dlIO]+(?![\p{L}\p{N}])"


def page_items(segments: DataFrame, blocks: DataFrame) -> DataFrame:
    """Segment contents and page-block texts as ``(item_key, doc_key, text)``."""
    contents = segments.select(F.col("segment_id").alias("item_key"), F.col("doc_id").alias("doc_key"), F.col("content").alias("text"))
    texts = blocks.select(F.col("block_id").alias("item_key"), F.col("root_key").alias("doc_key"), "text")
    return contents.unionByName(texts).where("item_key IS NOT NULL AND text IS NOT NULL")


def _is_header(line: Column) -> Column:
    return (F.length(line) <= LONGEST_HEADER + 2 * LONGEST_PAGE) & line.rlike(_HEADER_WORD) & line.rlike(_HEADER_LINE)


def _is_page(line: Column) -> Column:
    return (F.length(line) <= LONGEST_PAGE) & line.rlike(_PAGE_LINE)


def _line_form(line: Column) -> Column:
    """A line without its digits, signs at the edges and case: equal for one header on many pages."""
    return F.lower(F.regexp_replace(F.regexp_replace(line, r"[\d\s|\-–—·•]+", " "), r"^\s+|\s+$", ""))


def repeated_headers(items: DataFrame) -> DataFrame:
    """(doc_key, form): lines that stand first or last on several pages of a document.

    Pages alike throughout are copies and count once; a line that is the whole page counts as well.
    Lines with a full stop or comma at the end are sentences.
    """
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    ends = items.where("doc_key IS NOT NULL").select("doc_key", F.xxhash64(F.translate("text", "0123456789", "")).alias("page"), F.explode(F.array_distinct(F.array(F.get(lines, F.lit(0)), F.get(lines, F.size(lines) - 1)))).alias("line"))
    short = ends.where(F.col("line").isNotNull() & (F.length("line") <= LONGEST_HEADER) & ~F.col("line").rlike(r"[.。,，;；:：!?！？]\s*$"))
    short = short.where(~F.col("line").rlike(_PAGE_LINE))
    formed = short.select("doc_key", _line_form(F.col("line")).alias("form"), "page").where(F.length("form") >= 3)
    return formed.groupBy("doc_key", "form").agg(F.count_distinct("page").alias("pages")).where(F.col("pages") >= REPEATED).select("doc_key", "form")


def _clean(text: Column) -> Column:
    return F.regexp_replace(simple_fold(text), "\r\n?", "\n")


def _lined(items: DataFrame) -> DataFrame:
    """Items with their lines and the forms of the headers repeated in their document."""
    rows = items.select("item_key", "doc_key", _clean(F.col("text")).alias("text"))
    forms = materialise(repeated_headers(rows).groupBy("doc_key").agg(F.collect_set("form").alias("forms")))
    # the texts are shuffled only if very many documents have such lines
    small = forms.count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(forms) if small else forms, "doc_key", "left").select("item_key", "text", F.coalesce("forms", F.array().cast("array<string>")).alias("forms"))


def _at_edge(i: Column, size: Column) -> Column:
    return (i == 0) | (i == size - 1)


def _kinds(lines: Column, forms: Column) -> Column:
    """``h`` for a header, ``n`` for one with its page number, ``p`` for a page number, else empty; per line."""
    size = F.size(lines)

    def kind(line: Column, i: Column) -> Column:
        repeated = (F.size(forms) > 0) & _at_edge(i, size) & (F.length(line) <= LONGEST_HEADER) & F.array_contains(forms, _line_form(line))
        header = F.when(F.trim(line).rlike(_NUMBERED_HEADER), "n").otherwise("h")
        return F.when(_is_header(line), header).when(_is_page(line), "p").when(repeated, header).otherwise("")

    return F.transform(lines, kind)


def _features(items: DataFrame) -> DataFrame:
    """Per item: its line noise and the distinct words, line breaks and character triples in it."""
    plain = F.octet_length("text") == F.length("text")
    rows = _lined(items).select("item_key", F.split(F.when(plain, F.col("text")).otherwise(foreign_fold(F.col("text"))), "\n").alias("lines"), "forms")
    rows = rows.select("item_key", "lines", _kinds(F.col("lines"), F.col("forms")).alias("kinds"))
    noisy = F.exists("kinds", lambda k: k != "")
    body = F.array_join(F.when(noisy, F.zip_with("lines", "kinds", lambda x, k: F.when(k == "", x).otherwise(""))).otherwise(F.col("lines")), "\n")
    has = {"has_header": F.exists("kinds", lambda k: k.isin("h", "n")), "has_page": F.exists("kinds", lambda k: k.isin("p", "n"))}
    rows = rows.select("item_key", *(c.alias(n) for n, c in has.items()), body.alias("body"))
    broken = F.col("body").rlike(r"[-¬][ \t]*\n")
    empty = F.array().cast("array<string>")
    breaks = F.when(broken, F.transform(F.regexp_extract_all("body", F.lit(_BREAK), F.lit(0)), lambda b: F.lower(F.regexp_replace(F.regexp_replace(b, r"[ \t]*\n\s*", "\n"), "¬\n", "¬")))).otherwise(empty)
    flowing = F.when(broken, F.regexp_replace("body", _BREAK, " ")).otherwise(F.col("body"))
    words = F.regexp_extract_all(F.lower(flowing), F.lit(_WORD), F.lit(0))
    latin = F.octet_length("body") == F.length("body")
    joined = F.regexp_replace("body", r"(?<=[㐀-鿿，。、；：])\s*\n(?=[㐀-鿿])", "")
    chars = "".join(dict.fromkeys("".join(IDEOGRAPHS)))
    around = F.when(~latin & F.col("body").rlike(f"[{chars}]"), F.regexp_extract_all(F.concat(F.lit("。"), F.regexp_replace(joined, r"\s", "。"), F.lit("。")), F.lit(f"(?s)(?=(.[{chars}].))"), F.lit(1))).otherwise(empty)
    return rows.select("item_key", "has_header", "has_page", (F.col("body").rlike(_NEAR_NUMBER) & F.col("body").rlike(_NUMBER)).alias("has_number"), F.array_distinct(words).alias("words"), F.array_distinct(breaks).alias("breaks"), F.array_distinct(around).alias("triples"), flowing.alias("flowing"))


def _deletes(word: Column) -> Column:
    """The word, as it is and merged, and what is left when up to three confusable characters go."""
    merged = word
    for pair, one in MERGED:
        merged = F.replace(merged, F.lit(pair), F.lit(one))

    def shorter(left: Column) -> Column:
        places = F.filter(F.sequence(F.lit(1), F.length(left)), lambda i: F.instr(F.lit(CONFUSABLE), F.substring(left, i, F.lit(1))) > 0)
        return F.transform(places, lambda i: F.concat(F.substring(left, F.lit(1), i - 1), F.substring(left, i + 1, F.length(left))))

    levels = [F.array_distinct(F.array(word, merged))]
    for _ in range(MAX_DELETES):
        last = levels[-1]
        levels.append(F.array_distinct(F.flatten(F.transform(last, lambda w: F.when((F.length(w) > 2) | (F.length(word) == 2) & (w == word), shorter(w)).otherwise(F.array().cast("array<string>"))))))
    deletes = F.array_distinct(F.concat(*levels))
    # a long word would have too many: what is left without any confusable character is enough for it
    skeleton = F.array(F.concat(F.lit("\u0001"), F.translate(merged, CONFUSABLE, "")))
    return F.when(F.length(word) > LONG_WORD, skeleton).when(F.length(word) > LONG_WORD - MAX_DELETES, F.concat(deletes, skeleton)).otherwise(deletes)


_COST = 0.25


def confusion_distance(right: str, read: str) -> float:
    """Edit distance from the right word to the one read; confusion pairs are cheap."""
    n, m = len(right), len(read)
    far = float(n + m)
    best = [[far] * (m + 1) for _ in range(n + 1)]
    best[0][0] = 0.0
    for i in range(n + 1):
        for j in range(m + 1):
            now = best[i][j]
            if now >= far:
                continue
            if i < n and j < m and now + (right[i] != read[j]) < best[i + 1][j + 1]:
                best[i + 1][j + 1] = now + (right[i] != read[j])
            if i < n and now + 1 < best[i + 1][j]:
                best[i + 1][j] = now + 1
            if j < m and now + 1 < best[i][j + 1]:
                best[i][j + 1] = now + 1
            for a, b in CONFUSIONS:
                if right.startswith(a, i) and read.startswith(b, j) and now + _COST < best[i + len(a)][j + len(b)]:
                    best[i + len(a)][j + len(b)] = now + _COST
    return best[n][m]


def _word_pairs(counts: DataFrame, joined: DataFrame) -> DataFrame:
    """(read, right, impossible, ratio, distance): candidates from the delete index, verified."""
    plain = counts.where(F.col("word").rlike(r"^[" + _LAT + r"'’\-]{2,}$") & (F.col("n") >= 2)).select(F.col("word").alias("right"), F.col("n").alias("n_right"))
    # a word of letters alone must be rare beside some other; one with digits or signs is suspect
    odd = r"[\d!|]"
    # a word split at a line end may be misread as well: it counts as read once
    unseen = joined.select(F.col("joined").alias("word")).distinct().join(counts, "word", "left_anti").withColumn("n", F.lit(1).cast("long"))
    suspect = counts.unionByName(unseen).where(F.col("word").rlike(r"\p{L}") & ((F.length("word") >= 3) | F.col("word").rlike(odd))).where(F.col("word").rlike(odd) | F.col("word").rlike("c|b|rn|cl|ii|vv|m|d|l|i|f|o|w|ri|li")).select(F.col("word").alias("read"), F.col("n").alias("n_read"), F.col("word").rlike(odd).alias("impossible"))
    index = plain.select("right", "n_right", F.explode(_deletes(F.col("right"))).alias("key"))
    probes = suspect.select("read", "n_read", "impossible", F.explode(_deletes(F.col("read"))).alias("key"))
    ratio = F.col("n_right") / F.col("n_read")
    # of two characters ("1t") nothing is sure
    enough = F.when(F.length("read") == 2, ratio >= RATIO_WORD).when(F.col("impossible"), ratio >= RATIO_IMPOSSIBLE).otherwise(ratio >= RATIO_CONTEXT)
    candidates = probes.join(index, "key").where((F.col("read") != F.col("right")) & enough & (F.abs(F.length("read") - F.length("right")) <= MAX_DELETES)).select("read", "right", "impossible", ratio.alias("ratio")).distinct()

    @F.pandas_udf("double")
    def distance(right: pd.Series, read: pd.Series) -> pd.Series:
        return pd.Series([confusion_distance(a, b) for a, b in zip(right, read)], dtype="float64")

    return candidates.withColumn("distance", distance.asNondeterministic()("right", "read")).where(F.col("distance") <= _COST * MAX_DELETES)


def _context_votes(features: DataFrame, unsure: DataFrame) -> DataFrame:
    """Pairs whose right word has the better bigrams at the places where the other was read."""
    spoken = materialise(unsure.select(F.explode(F.array("read", "right")).alias("word")).distinct())
    small = spoken.count() <= BROADCAST_ROWS
    tokens = F.regexp_extract_all(F.lower("flowing"), F.lit(f"{_WORD}|[\\p{{L}}\\p{{N}}]+"), F.lit(0))
    placed = features.select(tokens.alias("t")).select(F.explode(F.transform("t", lambda w, i: F.struct(w.alias("word"), F.when(i > 0, F.get("t", i - 1)).alias("prev"), F.get("t", i + 1).alias("next")))).alias("p")).select("p.*")
    placed = placed.join(F.broadcast(spoken) if small else spoken, "word")
    sides = placed.select("word", F.explode(F.array(F.struct(F.lit("p").alias("side"), F.coalesce("prev", F.lit("")).alias("other")), F.struct(F.lit("n").alias("side"), F.coalesce("next", F.lit("")).alias("other")))).alias("s"))
    bigrams = sides.groupBy("word", "s.side", "s.other").agg(F.count(F.lit(1)).alias("n"))
    read = unsure.select("read", "right").join(bigrams.withColumnRenamed("word", "read"), "read").select("read", "right", "side", "other", F.col("n").alias("n_read"))
    both = read.join(bigrams.select(F.col("word").alias("right"), "side", "other", F.col("n").alias("n_right")), ["right", "side", "other"], "left")
    verdict = both.groupBy("read", "right").agg(F.sum(F.coalesce("n_right", F.lit(0))).alias("for_right"), F.sum("n_read").alias("for_read"))
    return verdict.where("for_right > for_read").select("read", "right")


def _misread_triples(features: DataFrame) -> DataFrame:
    """Triples around an ideograph that its bigrams on both sides call misread, with the right one."""
    spark = features.sparkSession
    triples = features.select(F.explode("triples").alias("triple")).groupBy("triple").agg(F.count(F.lit(1)).alias("n"))
    parts = triples.select("triple", "n", F.substring("triple", 1, 1).alias("p"), F.substring("triple", 2, 1).alias("c"), F.substring("triple", 3, 1).alias("x"))
    left = parts.groupBy("p", "c").agg(F.sum("n").alias("n"))
    right = parts.groupBy("c", "x").agg(F.sum("n").alias("n"))
    # the pairs are fixed values: a few rows
    pairs = F.broadcast(local_table(spark, [(p[1], p[0]) for p in IDEOGRAPHS], "c string, w string"))
    rows = parts.join(pairs, "c")
    for name, bigram, on in (("lv", left.select("p", "c", F.col("n").alias("lv")), ["p", "c"]), ("rv", right.select("c", "x", F.col("n").alias("rv")), ["c", "x"]), ("lw", left.select("p", F.col("c").alias("w"), F.col("n").alias("lw")), ["p", "w"]), ("rw", right.select(F.col("c").alias("w"), "x", F.col("n").alias("rw")), ["w", "x"])):
        rows = rows.join(bigram, on, "left")
    l_odds = (F.coalesce("lw", F.lit(0)) + 0.5) / (F.col("lv") + 0.5)
    r_odds = (F.coalesce("rw", F.lit(0)) + 0.5) / (F.col("rv") + 0.5)
    judged = rows.where((l_odds * r_odds >= 9) & (F.greatest(l_odds, r_odds) >= 3)).groupBy("triple").agg(F.max(F.struct((l_odds * r_odds).alias("odds"), "w")).alias("b"))
    return judged.select("triple", F.concat(F.substring("triple", 1, 1), F.col("b.w"), F.substring("triple", 3, 1)).alias("right"))


def _line_breaks(features: DataFrame) -> DataFrame:
    """Distinct line breaks within words: both parts, the joined and the hyphenated spelling."""
    breaks = features.select(F.explode("breaks").alias("break")).distinct()
    soft = F.instr("break", "¬") > 0
    a = F.when(soft, F.regexp_extract("break", "^(.*)¬", 1)).otherwise(F.regexp_extract("break", r"^(.*)-\n", 1))
    b = F.regexp_extract("break", r"[¬\n]([^¬\n]*)$", 1)
    return breaks.select("break", soft.alias("soft"), F.concat(a, b).alias("joined"), F.concat(a, F.lit("-"), b).alias("compound"))


def _split_words(breaks: DataFrame, counts: DataFrame, repairs: DataFrame) -> DataFrame:
    """Line breaks that split a word, with the joined word.

    The joined spelling must be known, itself or as a misread one, and commoner than the hyphenated:
    a compound keeps its own hyphen. A soft sign at the line end always splits.
    """
    rows = breaks.join(counts.select(F.col("word").alias("joined"), F.col("n").alias("n_joined")), "joined", "left")
    rows = rows.join(counts.select(F.col("word").alias("compound"), F.col("n").alias("n_compound")), "compound", "left")
    rows = rows.join(repairs.select(F.col("key").alias("joined"), "repair"), "joined", "left")
    split = F.col("soft") | (F.coalesce("n_joined", F.lit(0)) > F.coalesce("n_compound", F.lit(0))) | (F.col("repair").isNotNull() & F.col("n_compound").isNull())
    return rows.where(split).select("break", F.coalesce("repair", "joined").alias("joined"))


def noise_dictionary(features: DataFrame) -> DataFrame:
    """(kind, key, noise_kind, repair) of every noisy word, line break and triple of the corpus."""
    counts = materialise(features.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    line_breaks = materialise(_line_breaks(features))
    pairs = materialise(_word_pairs(counts, line_breaks))
    certain = (F.col("impossible") | (F.col("ratio") >= RATIO_WORD)) & (F.length("read") > 2)
    sure = pairs.where(certain).select("read", "right", "distance", "ratio")
    unsure = pairs.where(~certain)
    settled = unsure.join(_context_votes(features, unsure), ["read", "right"]).select("read", "right", "distance", "ratio")
    # a cheap repair to a common word; a tenfold ratio weighs as much as one confusion
    price = (F.col("distance") - _COST * F.log10("ratio")).alias("price")
    best = sure.unionByName(settled).groupBy("read").agg(F.min(F.struct(price, "right")).alias("b"))
    words = best.select(F.lit("word").alias("kind"), F.col("read").alias("key"), F.lit("misread").alias("noise_kind"), F.col("b.right").alias("repair"))
    triples = _misread_triples(features).select(F.lit("triple").alias("kind"), F.col("triple").alias("key"), F.lit("misread").alias("noise_kind"), F.col("right").alias("repair"))
    breaks = _split_words(line_breaks, counts, words).select(F.lit("break").alias("kind"), F.col("break").alias("key"), F.lit("hyphenation").alias("noise_kind"), F.col("joined").alias("repair"))
    return words.unionByName(triples).unionByName(breaks)


def _hits(features: DataFrame) -> DataFrame:
    dictionary = materialise(noise_dictionary(features))
    def entries_of(kind: str, column: str) -> Column:
        return F.transform(column, lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key")))

    entries = F.concat(*(entries_of(*e) for e in (("word", "words"), ("triple", "triples"), ("break", "breaks"))))
    keyed = features.select("item_key", F.explode(entries).alias("e")).select("item_key", "e.kind", "e.key")
    small = dictionary.count() <= BROADCAST_ROWS
    return keyed.join(F.broadcast(dictionary) if small else dictionary, ["kind", "key"])


def found(items: DataFrame) -> DataFrame:
    """(item_key, noise_kind), one row per item and kind present."""
    features = materialise(_features(items))
    flags = F.array(F.when(F.col("has_page"), F.lit("page_number")), F.when(F.col("has_header"), F.lit("running_header")), F.when(F.col("has_number"), F.lit("misread")))
    lines = features.select("item_key", F.explode(F.filter(flags, lambda f: f.isNotNull())).alias("noise_kind"))
    return lines.unionByName(_hits(features).select("item_key", "noise_kind")).distinct()


def repaired(items: DataFrame) -> DataFrame:
    """``(item_key, text)`` as continuous paragraphs: lines of page furniture gone, words mended."""
    features = materialise(_features(items))
    edits = _hits(features).groupBy("item_key").agg(F.collect_set(F.struct("kind", "key", "repair")).alias("edits"))
    lined = _lined(items).withColumn("lines", F.split("text", "\n")).withColumn("kinds", _kinds(F.col("lines"), F.col("forms")))
    body = F.array_join(F.filter(F.zip_with("lines", "kinds", lambda x, k: F.when(k == "", x)), lambda x: x.isNotNull()), "\n")
    body = F.regexp_replace(body, f"(?<={_HAN}|[，。、；：])[ \\t]*\\n(?={_HAN})", "")
    rows = lined.select("item_key", body.alias("body")).join(edits, "item_key", "left")
    known = F.coalesce("edits", F.array().cast("array<struct<kind:string,key:string,repair:string>>"))

    def mend(text: Column, e: Column) -> Column:
        quoted = F.concat(F.lit("\\Q"), e["key"], F.lit("\\E"))
        broken = F.concat(F.lit("(?i)"), F.regexp_replace(F.regexp_replace(quoted, "\n", r"\\E[ \\t]*\\n\\s*\\Q"), "¬", r"\\E¬[ \\t]*\\n\\s*\\Q"))
        word = F.concat(F.lit(r"(?i)(?<![\p{L}\p{N}])"), quoted, F.lit(r"(?![\p{L}\p{N}])"))
        # a full stop in a triple stands for any edge: there the pair alone is replaced
        part = F.when(F.startswith(e["key"], F.lit("。")), F.struct(F.lit(2).alias("a"), F.lit(2).alias("n"))).when(F.endswith(e["key"], F.lit("。")), F.struct(F.lit(1).alias("a"), F.lit(2).alias("n"))).otherwise(F.struct(F.lit(1).alias("a"), F.lit(3).alias("n")))
        triple = F.replace(text, F.substring(e["key"], part["a"], part["n"]), F.substring(e["repair"], part["a"], part["n"]))
        return F.when(e["kind"] == "break", F.regexp_replace(text, broken, e["repair"])).when(e["kind"] == "word", F.regexp_replace(text, word, e["repair"])).otherwise(triple)

    mended = F.aggregate(known, F.col("body"), mend)
    numbers = F.regexp_replace(F.regexp_replace(mended, r"(?<=\d)[lI](?=[\d.,%])|(?<=[\d.,])[lI](?=\d)", "1"), r"(?<=\d)O(?=[\d.,%])", "0")
    flowed = F.regexp_replace(F.regexp_replace(numbers, f"(?<={_HAN}|[，。、；：])[ \\t]*\\n(?=\\S)", ""), r"(?<=\S)[ \t]*\n(?=\S)", " ")
    return rows.select("item_key", F.regexp_replace(F.regexp_replace(F.regexp_replace(flowed, r"\n\s*\n+", "\n\n"), r"[ \t]{2,}", " "), r"^\s+|\s+$", "").alias("text"))
