"""Characters that look like, or hide beside, the usual ones, as SQL-side folding expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Invisible characters (soft hyphen, joiners, marks of direction, byte order mark).
INVISIBLE = "­͏؜᠎​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤⁦⁧⁨⁩﻿"
#: Blanks other than the plain space.
BLANKS = "               　"
#: Letters of other scripts and the Latin letters they look like, pairwise: Cyrillic, Greek,
#: Armenian, Cherokee, phonetic letters, Roman numerals of one letter.
FOREIGN = "АВЕКМНОРСТУХІЈЅԌԚԜЬҮЗаеорсухіјѕһԛԝѵӏкԁүΑΒΕΖΗΙΚΜΝΟΡΤΥΧονιαερκτυγηωχϲϳՕՏԼօսհոցզᎪᏴᏟᎬᏀᎻᎫᏦᏞᎷᏢᏒᎢᏙᏔᏃɡɑⅠⅤⅩⅬⅭⅮⅯⅰⅴⅹⅼⅽⅾⅿ"
LATIN = "ABEKMHOPCTYXIJSGQWbY3aeopcyxijshqwvlkdyABEZHIKMNOPTYXoviaepktuynwxcjOSLouhngqABCEGHJKLMPRTVWZgaIVXLCDMivxlcdm"
#: Of these the Greek letters that stand as symbols at the head of a short index ("αmax").
GREEK_SYMBOLS = "αερκτυγηωχ"


def _compatible(ranges: tuple[tuple[int, int], ...]) -> dict[str, str]:
    """Characters of the ranges whose compatibility form is one other character."""
    pairs = {}
    for low, high in ranges:
        for code in range(low, high + 1):
            form = unicodedata.normalize("NFKC", chr(code))
            if len(form) == 1 and form != chr(code):
                pairs[chr(code)] = form
    return pairs


#: Full-width and mathematical letters and digits, half-width katakana; CJK radicals and compatibility ideographs.
WIDE = _compatible(((0xFF10, 0xFF19), (0xFF21, 0xFF3A), (0xFF41, 0xFF5A), (0xFF66, 0xFF9D), (0x1D400, 0x1D6A5), (0x1D7CE, 0x1D7FF)))
WIDE_PUNCTUATION = _compatible(((0xFF01, 0xFF0F), (0xFF1A, 0xFF20), (0xFF3B, 0xFF40), (0xFF5B, 0xFF5E)))
IDEOGRAPHS = _compatible(((0x2E80, 0x2FDF), (0xF900, 0xFAFF)))

def simple_fold(text: Column, punctuation: bool = False) -> Column:
    """Drop invisible characters, map blanks, wide forms and ideograph variants one to one."""
    pairs = {**WIDE, **IDEOGRAPHS, **(WIDE_PUNCTUATION if punctuation else {})}
    source = BLANKS + "".join(pairs) + INVISIBLE
    target = " " * len(BLANKS) + "".join(pairs.values())
    # most texts are plain ASCII and stay as they are
    return F.when(F.octet_length(text) == F.length(text), text).otherwise(F.translate(text, source, target))


def foreign_fold(text: Column) -> Column:
    """Map Cyrillic and Greek look-alikes to Latin letters, whatever stands around them."""
    return F.translate(text, FOREIGN, LATIN)


def full_fold(text: Column) -> Column:
    """Every folding at once; for short labels that are compared, not shown."""
    return foreign_fold(simple_fold(text, punctuation=True))
