"""Oversized texts cut into overlapping pieces at natural boundaries (problem 3).

Recursive bisection: a span longer than the limit minus the overlap is cut at the strongest boundary
near its middle (paragraph, line, sentence, clause, word; the middle itself where there is none) and
both halves go on. Then every piece but the first is preceded by the last ``overlap`` characters of
its predecessor. So pieces hold at most ``limit`` characters, consecutive ones share exactly
``overlap``, and the pieces without their overlaps are the text.

Lengths count code points. Texts within the limit, empty ones included, are one piece of their own;
null texts and null keys yield no row. Repeated rows stay. Only oversized texts travel to Python.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 800, 100

#: Boundaries by strength: a cut falls behind the match.
_BOUNDARY = re.compile(r"(?P<p>\n[ \t\r]*\n\s*)|(?P<l>\n)|(?P<s>[.!?;][\"')\]]*[ \t]+|[。！？；…][”’」』）]*)|(?P<c>[,:][ \t]+|[，、：])|(?P<w>[ \t 　]+)")
_STRENGTH = {"p": 5, "l": 4, "s": 3, "c": 2, "w": 1}


def cut_points(text: str, longest: int) -> list[int]:
    """Inner cut positions such that no span between them is longer than ``longest``."""
    places, strengths = [], []
    for match in _BOUNDARY.finditer(text):
        places.append(match.end())
        strengths.append(_STRENGTH[match.lastgroup])
    cuts: list[int] = []
    spans = [(0, len(text))]
    while spans:
        start, end = spans.pop()
        length = end - start
        if length <= longest:
            continue
        middle, reach = (start + end) // 2, length // 4
        low, high = bisect_left(places, middle - reach), bisect_right(places, middle + reach)
        cut = middle
        if low < high:
            cut = places[max(range(low, high), key=lambda i: (strengths[i], -abs(places[i] - middle)))]
        if not start < cut < end:
            cut = middle
        cuts.append(cut)
        spans += [(start, cut), (cut, end)]
    return sorted(cuts)


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of the pieces of one text, overlaps attached."""
    if len(text) <= limit:
        return [(0, len(text))]
    ends = [*cut_points(text, limit - overlap), len(text)]
    starts = [0, *(max(0, cut - overlap) for cut in ends[:-1])]
    return list(zip(starts, ends))


def split_items(items: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of ``items (item_kind, item_key, parent_key, content)`` in order, with their place."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")

    @F.pandas_udf("array<struct<piece_no:int,start_pos:int,end_pos:int,piece:string>>")
    def pieces(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else [{"piece_no": i, "start_pos": a, "end_pos": b, "piece": t[a:b]} for i, (a, b) in enumerate(split_text(t, limit, overlap))] for t in texts], dtype=object)

    size = F.length("content")
    whole = F.array(F.struct(F.lit(0).alias("piece_no"), F.lit(0).alias("start_pos"), size.alias("end_pos"), F.col("content").alias("piece")))
    cut = items.where("content IS NOT NULL AND item_key IS NOT NULL").select("item_kind", "item_key", "parent_key", "content", pieces.asNondeterministic()(F.when(size > limit, F.col("content"))).alias("_cut"))
    cut = cut.withColumn("_pieces", F.coalesce("_cut", whole)).withColumn("n_pieces", F.size("_pieces"))
    return cut.select("item_kind", "item_key", "parent_key", "n_pieces", F.inline("_pieces"))
