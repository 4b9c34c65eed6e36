"""Personal information in free text found and replaced by typed placeholders (problem 10).

Information-theoretic sanitisation. Protected entities with a form of their own (e-mail addresses,
phone numbers, identity numbers, addresses) are recognised by that form and its surroundings. They
then disclose the terms that go with them: for every capitalised term the corpus tells how many bits
its occurrence adds to finding it in the local part of an e-mail address of the same text,

    log2 ( P(term in an address | term in the text) / P(term in an address) ),

estimated over all texts. Terms above ``THRESHOLD_BITS`` reveal a person; runs of them, with initials,
are names, unless they stand in a larger proper name (a firm, a street, a joint venture). Chinese
terms are single characters and pairs; their disclosure is measured against names that cues delimit
on both sides. Names next to any cue are then read off character by character, and every other
position is scored by the share of its surname and by what the corpus tells about the pairs of
characters before and behind it.

Two passes read texts in Python, whole and in Arrow batches: one over all texts (entities with a form of
their own, runs of capitalised terms, counts of terms and characters, added up per batch), one over
the Chinese texts with the tables of the first. All else is joins and counts over distinct runs,
terms and pairs. Only the shares of Chinese characters and of surnames of two characters travel with
tasks: the first are bounded by the script, the second are counted against ``SURNAME_LIMIT`` and
more of them raise an error instead of being shipped.

Null and empty texts and null ids yield no span; repeated rows stay in ``sanitised`` and give their
spans once in ``found``; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingloom.session import materialise

THRESHOLD_BITS = 3.0
#: Share of the occurrences of a character or pair that lies in delimited names, from which on it
#: reads as a given name, a surname, a surname of two characters.
GIVEN_SHARE, SURNAME_SHARE, PAIR_SHARE = 0.01, 0.18, 0.12
#: A Chinese name away from every cue: least log odds of its surname and its contexts together.
READING_BITS = -4.0
#: A term unseen in addresses joins the lexicon if so large a share of it stands beside known terms
#: and it occurs in at most so large a share of texts.
NEIGHBOUR_SHARE, RARE_SHARE = 0.4, 0.002
#: Words that carry a surname on into the name of a firm or a street.
LARGER_NAMES = ("street", "road", "avenue", "lane", "square", "quay", "drive", "court", "way", "place", "close", "terrace", "crescent", "boulevard", "gardens", "holdings", "holding", "limited", "ltd", "llp", "llc", "plc", "inc", "corp", "corporation", "company", "group", "partners", "associates", "foundation", "trust", "bank", "gmbh", "ag")
BROADCAST_ROWS = 300_000
#: Surnames of two characters that may travel with a task (some hundred are in use).
SURNAME_LIMIT = 100_000

_AT = r"(?:\s?(?:@|＠)\s?(?=[\w-]+(?:\.[\w-]+)*\.[A-Za-z]{2})|\s?[\[({<]\s?(?:at|AT)\s?[\])}>]\s?|\s(?:at|AT)\s(?=[\w-]+\s?(?:dot|DOT|[\[({]dot)))"
_DOT = r"(?:\.|\s?[\[({<]\s?(?:dot|DOT)\s?[\])}>]\s?|\s(?:dot|DOT)\s)"
_LOCAL = r"(?<![A-Za-z0-9_.+%\-])[A-Za-z0-9](?:[A-Za-z0-9._%+\-]*[A-Za-z0-9])?"
EMAIL = re.compile(f"{_LOCAL}{_AT}[A-Za-z0-9](?:[A-Za-z0-9\\-]*[A-Za-z0-9])?(?:{_DOT}[A-Za-z0-9](?:[A-Za-z0-9\\-]*[A-Za-z0-9])?)+")

_EXT = r"(?:\s?(?:ext\.?|x|extension|转|Durchwahl)\s?\d{1,6})?"
PHONE = re.compile(
    r"(?<![A-Za-z0-9_.\-/+])(?:"
    r"(?:\+1[ .\-]?|1[ .\-])?(?:\(\d{3}\)[ .\-]?|\d{3}[ .\-])\d{3}[ .\-]\d{4}"  # North American plan
    r"|(?:\+44|0044)\s?(?:\(0\)\s?)?\d{2,5}[ \-]?\d{3,4}[ \-]?\d{3,4}|\(?0\d{2,4}\)?\s\d{3,4}\s\d{4}(?!\d)|01\d{3}\s\d{6}|07\d{3}\s\d{6}"  # British
    r"|(?:\+49|0049)\s?(?:\(0\)\s?)?\d{2,5}[ /\-]?\d{3,8}(?:[ \-]\d{1,5})?|\(0\d{2,4}\)\s?\d{3,8}(?:[ \-]\d{1,5})?|0\d{2,4}[/ ]\d{4,8}(?:[ \-]\d{1,5})?"  # German
    r"|(?:\+86|0086)[ \-]?(?:\d{2,3}[ \-]\d{4}[ \-]?\d{4}|1\d{2}[ \-]?\d{4}[ \-]?\d{4})|[（(]0\d{2,3}[）)]\s?\d{4}[ \-]?\d{3,4}|0\d{2,3}[ \-]\d{4}[ \-]?\d{3,4}|1\d{2}[ \-]?\d{4}[ \-]?\d{4}"  # Chinese
    r"|(?:\+|00)(?!1[ .\-(]|44|49|86)[1-9]\d{0,2}(?:[ .\-/]?\(?\d{1,5}\)?){2,5}"  # any other country
    r")" + _EXT + r"(?![A-Za-z0-9_])(?!-\d)"
)
_NOT_PHONE = re.compile(r"(?i)(?:\bPO|filing no\.?|voucher|reference|account(?: code)?|contract|合同编号|凭证|no\.)[ #:]*$")

_ID = re.compile(
    r"(?<![A-Za-z0-9_\-])(?P<zh>\d{6}[ ]?(?:18|19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])[ ]?\d{3}[\dXx])(?![A-Za-z0-9_])"
    r"|(?<![\w\-])(?P<ni>[A-Z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-D])(?!\w)"
    r"|(?<![\w\-.])(?P<cued>\d{3}-\d{2}-\d{4}|\d{3} \d{2} \d{4}|\d{9}|[CFGHJKLMNPRTVWXYZ][A-Z0-9]{7}\d|[A-Z]\d{8})(?![\w\-])"
)
_ID_CUE = re.compile(r"(?i)(?:identity|ident\w*|ssn|\bni\b|national insurance|social security|tax\s?payer|tax(?:payer)? (?:number|no\.?|id)|passport|\bID\b|ausweis\w*|steuer\w*|reisepass\w*|证件号?码?|身份证号?码?|护照号?码?)(?:\s?(?:no|nr|number)\b\.?)?[^\n.;。；]{0,24}$")
_ID_NOT = re.compile(r"(?i)(?:voucher|filing|contract|account|reference|invoice|合同编号|凭证)[^\n.;。；]{0,12}$")

_KIND = r"(?:Street|St\.?|Road|Rd\.?|Avenue|Ave\.?|Lane|Ln\.?|Square|Sq\.?|Quay|Drive|Dr\.?|Court|Ct\.?|Way|Place|Pl\.?|Close|Terrace|Crescent|Boulevard|Blvd\.?|Gardens|Row|Hill|Park|Parkway|Pkwy\\.?|Highway|Hwy\\.?|Circle|Cir\\.?|Mews|Walk|Wharf|Alley|Plaza|Trail|Green|Grove)"
_WORD = r"[A-ZÀ-Þ][a-zà-ÿ'’]+"
_TOWN = f"{_WORD}(?:[ \\-]{_WORD}){{0,2}}"
_CODE = r"(?:[ ,]+(?:[A-Z]{1,2}\d{1,2}[A-Z]?\s\d[A-Z]{2}|[A-Z]{2}\s\d{5}(?:-\d{4})?|\d{5}(?:-\d{4})?))"
_ZH = r"[一-鿿]"
_UNIT = r"(?:Flat|Apt\.?|Apartment|Unit|Suite|Room)\s\d+[A-Za-z]?,\s"
#: A town of several words is told from the sentence going on by the code behind it.
_PLACE = f"{_WORD}(?:(?:[ \\-]{_WORD}){{1,3}}(?={_CODE}))?{_CODE}?"
_STREET_ADDRESS = re.compile(f"(?<![\\w])(?:{_UNIT})?\\d{{1,5}}[A-Za-z]?\\s{_WORD}(?:\\s{_WORD}){{0,2}}?(?:\\s{_KIND}(?!\\w)),?\\s(?:{_UNIT})?{_PLACE}")
_BOX_ADDRESS = re.compile(f"(?<![\\w.])P\\.?\\s?O\\.?\\s?Box\\s\\d+,\\s{_PLACE}")
_GERMAN_ADDRESS = re.compile(r"(?<![\w])(?:[A-ZÄÖÜ][a-zäöüß]+(?:straße|strasse|str\.|weg|allee|platz|gasse|ring|damm|ufer)|[A-ZÄÖÜ][a-zäöüß]+[ -](?:Straße|Str\.|Weg|Allee|Platz))\s\d+[a-z]?,\s(?:D-)?\d{5}\s" + _WORD)
_CHINESE_ADDRESS = re.compile(f"(?:(?:{_ZH}{{2,6}}?省)?{_ZH}{{2,4}}?市)?{_ZH}{{2,4}}?[区县]{_ZH}{{2,5}}?(?:大道|路|街|巷|道)\\d+号(?:\\d+号楼|\\d+栋|\\d+幢|\\d+单元|\\d+层|\\d+楼|\\d+室)*(?:[，, ]?邮编[：:]?\\d{{6}}|[，, ]\\d{{6}}(?!\\d))?")
#: What an address, a phone or an identity number cannot do without; cheap to look for.
_NUMBERED_WORD = re.compile(r"\d[A-Za-z]?\s[A-ZÀ-Þ]")
_POSTCODED = re.compile(r"\d{5}\s[A-ZÄÖÜ]")
_DIGITS = re.compile(r"\d(?:[ .\-/()（）]{0,3}\d){5,}")
#: Numbers with letters in them.
_LETTERED = re.compile(r"[A-Z](?<![\w\-.].)[A-Z0-9]{7}\d(?![\w\-])")
_ZH_ADDRESS_LEAD = re.compile(r"^(?:联系地址|通讯地址|注册地址|办公地址|来函请寄|住址|地址|住所|后前往|前往|寄往|请寄|位于|现住|居住于|住|往|至|寄|于|在)+")

#: Roles beside which Chinese names stand; the pattern of a name between delimiters on both sides.
_ZH_ROLE = "联系人|投诉人|股东|会计师|持有人|董事|监事|董事长|董事会秘书|秘书|经理|总裁|代表|收件人|负责人|经办人|签字人|申请人|受益人|举报人|委托人"
#: What a sentence goes on with behind a name.
_ZH_VERB = "反映|负责|因个人|质押|出具|担任|辞职|签署|先生|女士"
_ZH_DELIMITED = f"(?:(?:{_ZH_ROLE})[：:]?({_ZH}{{2,4}}?)(?=[，,。；（(、\\s]|{_ZH_VERB})|(?:^|[^一-鿿])({_ZH}{{2,4}}?)(?=先生|女士))"
_ZH_BEFORE = re.compile(f"(?:{_ZH_ROLE})[：:]?(?={_ZH})")
_ZH_AFTER = re.compile(r"先生|女士|收(?![入到购益回取款盘])|因个人原因")

_ZH_PAIR = re.compile(f"{_ZH}{{2}}")

_CAPITAL = "A-ZÀ-Þ"
_TERM = f"[{_CAPITAL}]{{behind}}(?:[a-zà-ÿ'’]+(?:-[{_CAPITAL}][a-zà-ÿ'’]+)*|[{_CAPITAL}]+(?:-[{_CAPITAL}]{{{{2,}}}})*|\\.(?:[{_CAPITAL}]\\.)*|)(?![\\w@])"
_TOKEN = re.compile(_TERM.format(behind=""))
#: Capitalised terms and initials with blanks or commas between them; none begins inside a word.
_RUN = re.compile(_TERM.format(behind="(?<![\\w@./].)") + "(?:,? " + _TERM.format(behind="") + ")*")
_INITIAL = re.compile(r"^(?:[A-ZÀ-Þ]\.)+$|^[A-ZÀ-Þ]$")


def _windows(pattern: re.Pattern, text: str, before: int, after: int) -> list[tuple[int, int]]:
    """Stretches of text around the matches of a pattern, merged where they meet."""
    out: list[tuple[int, int]] = []
    for m in pattern.finditer(text):
        a, b = max(0, m.start() - before), min(len(text), m.end() + after)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _mentions_mail(text: str) -> bool:
    return "@" in text or "＠" in text or (("at" in text or "AT" in text) and ("dot" in text or "DOT" in text or re.search(r"(?:at|AT)\s?[\])}>]", text) is not None))


def _addresses(text: str) -> list[tuple[int, int]]:
    """Spans of addresses of every kind; each kind is looked for only where its marks stand."""
    found = []
    for a, b in _windows(_NUMBERED_WORD, text, 24, 160):
        found += [m.span() for m in _STREET_ADDRESS.finditer(text, a, b)]
    if "Box" in text:
        found += [m.span() for m in _BOX_ADDRESS.finditer(text)]
    for a, b in _windows(_POSTCODED, text, 100, 60):
        found += [m.span() for m in _GERMAN_ADDRESS.finditer(text, a, b)]
    if "号" in text:
        for m in _CHINESE_ADDRESS.finditer(text):
            lead = _ZH_ADDRESS_LEAD.match(m.group())
            found.append((m.start() + (lead.end() if lead and lead.end() < len(m.group()) else 0), m.end()))
    return found


def structured_spans(text: str) -> list[tuple[str, int, int]]:
    """E-mail addresses, identity numbers, addresses and phone numbers of one text, not overlapping."""
    taken: list[tuple[str, int, int]] = []

    def free(a: int, b: int) -> bool:
        return all(b <= x or a >= y for _, x, y in taken)

    if _mentions_mail(text):
        taken += [("email", m.start(), m.end()) for m in EMAIL.finditer(text)]
    if not _HAS_DIGIT.search(text):
        return taken
    dense = _windows(_DIGITS, text, 12, 40)
    for a, b in sorted(dense + _windows(_LETTERED, text, 2, 2)):
        for m in _ID.finditer(text, a, b):
            before = text[max(0, m.start() - 40) : m.start()]
            if m.lastgroup == "cued" and not _ID_CUE.search(before) or _ID_NOT.search(before):
                continue
            if free(*m.span()):
                taken.append(("id_number", *m.span()))
    for start, end in _addresses(text):
        if free(start, end):
            taken.append(("address", start, end))
    for a, b in dense:
        for m in PHONE.finditer(text, a, b):
            if free(*m.span()) and not _NOT_PHONE.search(text[max(0, m.start() - 16) : m.start()]) and _plausible(m.group()):
                taken.append(("phone", *m.span()))
    return taken


_HAS_DIGIT = re.compile(r"\d")


def _plausible(number: str) -> bool:
    """An international number has 8 to 15 digits before its extension."""
    digits = re.sub(r"\D", "", re.split(r"(?i)ext|x|转|Durchwahl", number)[0])
    return not number.startswith(("+", "00")) or 8 <= len(digits.removeprefix("00")) <= 15


def _surnames(text: str, i: int, single: dict[str, float], pairs: dict[str, float]) -> list[int]:
    """Lengths of the surnames that may begin at ``i``, the longer first."""
    return [n for n, share in ((2, pairs.get(text[i : i + 2], 0) >= PAIR_SHARE), (1, single.get(text[i : i + 1], 0) >= SURNAME_SHARE)) if share]


def _surname_starts(single: dict[str, float], pairs: dict[str, float]) -> re.Pattern | None:
    """Characters a surname may begin with; none if no name was ever delimited."""
    first = {c for c, share in single.items() if share >= SURNAME_SHARE} | {p[0] for p in pairs}
    return re.compile(f"[{''.join(sorted(first))}]") if first else None


def chinese_readings(text: str, starts: re.Pattern, single: dict[str, float], pairs: dict[str, float]) -> Iterator[tuple[int, int, float]]:
    """(start, end, share of the surname) of the longest name that can be read at each position, not overlapping."""
    last = 0
    for m in starts.finditer(text):
        i = m.start()
        for size in _surnames(text, i, single, pairs) if i >= last else ():
            end = i + size
            while end < min(len(text), i + size + 2) and single.get(text[end], 0) >= GIVEN_SHARE:
                end += 1
            if end > i + size:
                yield i, end, pairs[text[i : i + 2]] if size == 2 else single[text[i]]
                last = end
                break


def _beside(text: str, start: int, end: int) -> list[tuple[str, str]]:
    """The pairs of Chinese characters before and behind a span; none at a sign or an edge."""
    sides = (("before", text[max(0, start - 2) : start]), ("after", text[end : end + 2]))
    return [(side, pair) for side, pair in sides if _ZH_PAIR.fullmatch(pair)]


def chinese_names(text: str, single: dict[str, float], pairs: dict[str, float]) -> list[tuple[int, int]]:
    """Names beside a cue: a surname of one or two characters and one or two of a given name."""

    def given(i: int) -> bool:
        return i < len(text) and single.get(text[i], 0) >= GIVEN_SHARE

    def surnames(i: int) -> list[int]:
        return _surnames(text, i, single, pairs)

    found = set()
    for m in _ZH_BEFORE.finditer(text):
        for size in surnames(m.end()):
            start = end = m.end() + size
            while end - start < 2 and given(end):
                end += 1
            if end > start:
                found.add((m.end(), end))
                break
    for m in _ZH_AFTER.finditer(text):
        for length in (4, 3, 2):
            start = m.start() - length
            if start >= 0 and any(1 <= length - size <= 2 and all(given(i) for i in range(start + size, m.start())) for size in surnames(start)):
                found.add((start, m.start()))
                break
    return sorted(found)


@lru_cache(maxsize=100_000)
def run_tokens(run: str) -> tuple[tuple[str, int, int, str], ...]:
    """(token, start, end, gap before) of the terms and initials of a run."""
    out: list[tuple[str, int, int, str]] = []
    for m in _TOKEN.finditer(run):
        out.append((m.group(), m.start(), m.end(), run[out[-1][2] : m.start()] if out else ""))
    return tuple(out)


@lru_cache(maxsize=100_000)
def run_terms(run: str) -> frozenset[str]:
    """Words of three letters or more of a run, lower case."""
    return frozenset(part.lower() for t, _, _, _ in run_tokens(run) for part in t.split("-") if len(part) >= 3 and "." not in part)


def name_runs(text: str, taken: list[tuple[str, int, int]]) -> Iterator[tuple[str, int]]:
    """(run, start) of the runs of capitalised tokens and initials outside the spans taken."""
    for m in _RUN.finditer(text):
        a, b = m.span()
        blocked = [(x, y) for _, x, y in taken if x < b and y > a]
        if not blocked:
            yield m.group(), a
            continue
        first = last = None
        for _, s, e, _ in run_tokens(m.group()):
            if any(x < a + e and y > a + s for x, y in blocked):
                if first is not None:
                    yield text[a + first : a + last], a + first
                first = None
            else:
                first, last = s if first is None else first, e
        if first is not None:
            yield text[a + first : a + last], a + first


def _joined(text: str, a: int, b: int) -> tuple[bool, bool]:
    """Whether a sign ties what stands before and behind a span to it."""
    return text[max(0, a - 2) : a].endswith(("& ", "-", "/")), text[b : b + 3].startswith((" & ", "-", "/"))


def names_in_run(tokens: tuple[tuple[str, int, int, str], ...], known: list[bool], tied_before: bool, tied_after: bool) -> list[tuple[int, int]]:
    """Names among the tokens of one run; parts of larger proper names are left out."""
    kind = ["I" if _INITIAL.match(t[0]) else "N" if k else "x" for t, k in zip(tokens, known)]
    found, i, n = [], 0, len(tokens)
    while i < n:
        if kind[i] == "x":
            i += 1
            continue
        # a part: names and initials with plain blanks between them
        j = i + 1
        while j < n and kind[j] != "x" and tokens[j][3] == " ":
            j += 1
        part = list(range(i, j))
        # surname, comma, given name and initials
        if kind[i] == "N" and j - i == 1 and j < n and tokens[j][3] == ", " and kind[j] == "N":
            k = j + 1
            while k < n and kind[k] == "I" and tokens[k][3] == " ":
                k += 1
            given_only = not (k < n and kind[k] == "N" and tokens[k][3] == " ")
            if given_only:
                part, j = list(range(i, k)), k
        names = [p for p in part if kind[p] == "N"]
        while part and kind[part[-1]] == "I" and len(part) > 1 and tokens[part[-1]][3] == " " and not any(tokens[p][3] == ", " for p in part):
            part.pop()
        inside = j < n and tokens[j][3] == " " and kind[j] == "x"  # a longer proper name goes on
        first, last = part[0], part[-1]
        joined = (first == 0 and tied_before) or (last == n - 1 and tied_after)
        if names and not inside and not joined:
            found.append((tokens[first][1], tokens[last][2]))
        i = j
    return found


_READ = pa.schema([
    ("kind", pa.string()), ("doc_id", pa.int64()), ("text", pa.string()), ("types", pa.list_(pa.string())), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())),
    ("runs", pa.list_(pa.string())), ("run_starts", pa.list_(pa.int32())), ("tied", pa.list_(pa.int32())), ("key", pa.string()), ("n", pa.int64()), ("e", pa.int64()), ("j", pa.int64()),
])
_READ_TYPE = "kind string, doc_id bigint, text string, types array<string>, starts array<int>, ends array<int>, runs array<string>, run_starts array<int>, tied array<int>, key string, n bigint, e bigint, j bigint"
_HAN = re.compile(_ZH)
_MAIL_PART = re.compile(r"[a-z]{3,}")


def _mailed(text: str, spans: list[tuple[str, int, int]]) -> set[str]:
    """Words in the local parts of the addresses of a text; "jsmith" holds "smith" as well."""
    local = (re.split(_AT, text[a:b], maxsplit=1)[0].lower() for kind, a, b in spans if kind == "email")
    words = {w for part in local for w in _MAIL_PART.findall(part)}
    return words | {w[1:] for w in words if len(w) >= 5}


def read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per text with its certain spans and its runs; then the counts of the batch.

    Counts: texts with a term, with it in an address, with both (``term``); occurrences of Chinese
    characters and pairs (``char``, ``pair``), in delimited names as ``e`` (a pair: leading one).
    """
    for batch in batches:
        rows: dict[str, list] = {f.name: [] for f in _READ}
        terms: dict[str, list[int]] = {}
        chars, pairs, inside, leading = Counter(), Counter(), Counter(), Counter()
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            spans = structured_spans(text)
            runs = list(name_runs(text, spans))
            written = frozenset().union(*(run_terms(run) for run, _ in runs))
            mailed = _mailed(text, spans)
            for term in written | mailed:
                count = terms.setdefault(term, [0, 0, 0])
                count[0] += term in written
                count[1] += term in mailed
                count[2] += term in written and term in mailed
            chinese = _HAN.search(text) is not None
            if chinese:
                for stretch in _ZH_STRETCH.findall(text):
                    chars.update(stretch)
                    pairs.update(map("".join, zip(stretch, stretch[1:])))
                for m in _ZH_NAMED.finditer(text):
                    name = m.group(1) or m.group(2)
                    if name and len(name) >= 2:
                        inside.update(name)
                        if len(name) >= 3:
                            leading[name[:2]] += 1
            tied = [_joined(text, a, a + len(run)) for run, a in runs]
            for name, value in (("kind", "doc"), ("doc_id", doc_id), ("text", text if chinese else None), ("types", [k for k, _, _ in spans]), ("starts", [a for _, a, _ in spans]), ("ends", [b for _, _, b in spans]), ("runs", [r for r, _ in runs]), ("run_starts", [a for _, a in runs]), ("tied", [x + 2 * y for x, y in tied])):
                rows[name].append(value)
        counts = [("term", t, *c) for t, c in terms.items()] + [("char", c, n, inside[c], 0) for c, n in chars.items()] + [("pair", p, n, leading[p], 0) for p, n in pairs.items()]
        yield pa.RecordBatch.from_pydict({f.name: pa.array(rows[f.name] if rows[f.name] else [None] * len(rows["kind"]), f.type) for f in _READ}, schema=_READ)
        tail = dict(zip(("kind", "key", "n", "e", "j"), zip(*counts) if counts else [()] * 5))
        yield pa.RecordBatch.from_pydict({f.name: pa.array(tail[f.name] if f.name in tail else [None] * len(counts), f.type) for f in _READ}, schema=_READ)


_ZH_STRETCH = re.compile(f"{_ZH}+")
_ZH_NAMED = re.compile(_ZH_DELIMITED)


def term_lexicon(read: DataFrame, texts: int) -> DataFrame:
    """(term, bits) of the capitalised terms that disclose a person."""
    counts = read.where("kind = 'term'").groupBy(F.col("key").alias("term")).agg(F.sum("n").alias("n"), F.sum("e").alias("e"), F.sum("j").alias("j")).where("n > 0 AND e > 0")
    bits = F.log2(((F.col("j") + 0.5) / (F.col("n") + 1.0)) / ((F.col("e") + 0.5) / F.lit(texts + 1.0)))
    return counts.select("term", bits.alias("bits")).where(F.col("bits") >= THRESHOLD_BITS)


def character_shares(read: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """Share of each Chinese character and leading pair that stands in delimited names.

    The characters are bounded by the script; the pairs, surnames of two characters, are counted
    before they are fetched.
    """
    counts = read.where("kind IN ('char', 'pair')").groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("e").alias("e")).where("e > 0").select("kind", "key", (F.col("e") / F.col("n")).alias("share"))
    counts = materialise(counts.where(f"kind = 'char' OR share >= {PAIR_SHARE}"))
    surnames = counts.where("kind = 'pair'")
    if surnames.count() > SURNAME_LIMIT:
        raise ValueError(f"more than {SURNAME_LIMIT} surnames of two characters")
    single = {r["key"]: r["share"] for r in counts.where("kind = 'char'").collect()}
    return single, {r["key"]: r["share"] for r in surnames.collect()}


def _chinese(read: DataFrame) -> DataFrame:
    """(doc_id, start_pos, end_pos) of Chinese names: beside a cue, or where surname and contexts speak for one."""
    single, pairs = character_shares(read)
    starts = _surname_starts(single, pairs)
    spans = "doc_id bigint, cued boolean, start_pos int, end_pos int, share double, before string, after string"
    if starts is None:
        return read.sparkSession.createDataFrame([], "doc_id bigint, start_pos int, end_pos int")

    def readings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, text, first, last in zip(batch["doc_id"], batch["text"], batch["starts"], batch["ends"]):
                taken = list(zip(first, last))
                for cued, named in ((True, ((a, b, 1.0) for a, b in chinese_names(text, single, pairs))), (False, chinese_readings(text, starts, single, pairs))):
                    for a, b, share in named:
                        # a reading another span covers still counts for its contexts
                        clash = any(b > x and a < y for x, y in taken)
                        if cued and clash:
                            continue
                        beside = dict(_beside(text, a, b))
                        out.append((doc_id, None if clash else cued, a, b, share, beside.get("before"), beside.get("after")))
                        if cued:
                            taken.append((a, b))
            yield pd.DataFrame(out, columns=["doc_id", "cued", "start_pos", "end_pos", "share", "before", "after"])

    rows = materialise(read.where("kind = 'doc' AND text IS NOT NULL").select("doc_id", "text", "starts", "ends").mapInPandas(readings, spans))
    counts = read.where("kind = 'pair'").groupBy(F.col("key").alias("p")).agg(F.sum("n").alias("n"))
    anywhere = rows.where("cued IS NULL OR NOT cued")
    sides = anywhere.select(F.explode(F.array(F.struct(F.lit("before").alias("side"), F.col("before").alias("p")), F.struct(F.lit("after").alias("side"), F.col("after").alias("p")))).alias("s")).select("s.*").where("p IS NOT NULL")
    beside = sides.groupBy("side", "p").agg(F.count(F.lit(1)).alias("beside"))
    bits = materialise(beside.join(counts, "p").select("side", "p", F.log2((F.col("beside") + 1) / (F.greatest(F.col("n") - F.col("beside"), F.lit(0)) + 1)).alias("bits")))
    scored = rows.where("NOT cued")
    for side in ("before", "after"):
        scored = scored.join(bits.where(F.col("side") == side).select(F.col("p").alias(side), F.col("bits").alias(f"bits_{side}")), side, "left")
    odds = F.log2((F.col("share") + 1e-3) / (1 - F.col("share") + 1e-3)) + F.coalesce("bits_before", F.lit(0.0)) + F.coalesce("bits_after", F.lit(0.0))
    return rows.where("cued").select("doc_id", "start_pos", "end_pos").unionByName(scored.where(odds >= READING_BITS).select("doc_id", "start_pos", "end_pos"))


def _neighbours(tokens: DataFrame, known: DataFrame, texts: int) -> DataFrame:
    """Rare terms that mostly stand beside a known one: the rest of a name never seen in an address.

    A term of a larger vocabulary (a firm's form, a kind of street, a role) stands in many texts.
    """
    beside = known.select("run", F.explode(F.array(F.col("i") - 1, F.col("i") + 1, F.col("i") - 2, F.col("i") + 2)).alias("i"), F.col("i").alias("by")).groupBy("run", "i").agg(F.collect_set("by").alias("by"))

    def at(step: int) -> Column:
        return F.coalesce(F.array_contains("by", F.col("i") + step), F.lit(False))

    # a word before a full name ("Frau", "Holder") is no part of it
    near = at(-1) | F.col("after_initial") | (at(1) & ~at(2)) | (at(2) & ~at(1) & F.col("before_initial"))
    rows = tokens.where("NOT initial").join(beside, ["run", "i"], "left").join(known.select("run", "i", F.lit(True).alias("is_known")), ["run", "i"], "left")
    counts = rows.groupBy("term").agg(F.sum("times").alias("n"), F.sum(near.cast("int") * F.col("times")).alias("beside"), F.max("is_known").alias("is_known"))
    return counts.where(F.col("is_known").isNull() & (F.col("beside") >= NEIGHBOUR_SHARE * F.col("n")) & (F.col("n") <= RARE_SHARE * texts + 2) & ~F.col("term").isin(*LARGER_NAMES)).select("term")


def _run_names(runs: DataFrame, lexicon: DataFrame, texts: int) -> DataFrame:
    """(run, tied, names): the offsets of the names in every distinct run that holds one."""
    distinct = materialise(runs.groupBy("run").agg(F.count(F.lit(1)).alias("times")))
    tokens = distinct.select("run", "times", F.regexp_extract_all("run", F.lit(_TOKEN.pattern), F.lit(0)).alias("tokens"))
    initial = F.col("k").rlike(_INITIAL.pattern)

    def initial_at(step: int) -> Column:
        return F.coalesce(F.when(F.col("i") + step >= 0, F.get("tokens", F.col("i") + step).rlike(_INITIAL.pattern)), F.lit(False))

    placed = tokens.select("run", "times", "tokens", F.posexplode("tokens").alias("i", "k")).select("run", "times", "i", F.lower("k").alias("term"), initial.alias("initial"), initial_at(-1).alias("after_initial"), initial_at(1).alias("before_initial"))
    known = materialise(placed.join(lexicon.select("term"), "term").select("run", "i"))
    more = _neighbours(placed, known, texts)
    hits = known.unionByName(placed.where("NOT initial").join(more, "term").select("run", "i")).groupBy("run").agg(F.collect_set("i").alias("known"))

    @F.pandas_udf("array<struct<a:int,b:int>>")
    def names(run: pd.Series, tied: pd.Series, known: pd.Series) -> pd.Series:
        out = []
        for text, ties, marks in zip(run, tied, map(set, known)):
            parts = run_tokens(text)
            out.append([{"a": a, "b": b} for a, b in names_in_run(parts, [i in marks for i in range(len(parts))], bool(ties & 1), bool(ties & 2))])
        return pd.Series(out)

    every = hits.select("run", "known", F.explode(F.array(*map(F.lit, range(4)))).alias("tied"))
    return every.select("run", "tied", names("run", "tied", "known").alias("names")).where(F.size("names") > 0)


def found(documents: DataFrame) -> DataFrame:
    """(doc_id, pii_type, start_pos, end_pos) of every occurrence; positions count code points."""
    texts = documents.where("text IS NOT NULL AND doc_id IS NOT NULL AND text <> ''").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    read = materialise(texts.mapInArrow(read_batches, _READ_TYPE))
    docs = read.where("kind = 'doc'")
    total = docs.count()
    lexicon = materialise(term_lexicon(read, total))
    runs = docs.select("doc_id", F.explode(F.arrays_zip("runs", "run_starts", "tied")).alias("r")).select("doc_id", F.col("r.runs").alias("run"), F.col("r.run_starts").alias("at"), F.col("r.tied").alias("tied"))
    named = materialise(_run_names(runs, lexicon, total))
    small = named.count() <= BROADCAST_ROWS
    hits = runs.join(F.broadcast(named) if small else named, ["run", "tied"]).select("doc_id", "at", F.explode("names").alias("n"))
    latin = hits.select("doc_id", F.lit("name").alias("pii_type"), (F.col("at") + F.col("n.a")).alias("start_pos"), (F.col("at") + F.col("n.b")).alias("end_pos"))
    certain = docs.select("doc_id", F.explode(F.arrays_zip("types", "starts", "ends")).alias("s")).select("doc_id", F.col("s.types").alias("pii_type"), F.col("s.starts").alias("start_pos"), F.col("s.ends").alias("end_pos"))
    chinese = _chinese(read).select("doc_id", F.lit("name").alias("pii_type"), "start_pos", "end_pos")
    return certain.unionByName(latin).unionByName(chinese).distinct()


def sanitised(documents: DataFrame) -> DataFrame:
    """Every text with a typed placeholder for each occurrence, otherwise unchanged."""
    spans = found(documents).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start_pos", "end_pos", "pii_type")), asc=False).alias("spans"))

    def cut(text: Column, s: Column) -> Column:
        return F.concat(F.substring(text, F.lit(1), s["start_pos"]), F.lit("["), F.upper(s["pii_type"]), F.lit("]"), F.substring(text, s["end_pos"] + 1, F.length(text)))

    # the last occurrence first, so that earlier positions stay valid
    text = F.aggregate(F.coalesce("spans", F.array().cast("array<struct<start_pos:int,end_pos:int,pii_type:string>>")), F.col("text"), cut)
    return documents.select("doc_id", "text").join(spans, "doc_id", "left").select("doc_id", text.alias("text"), F.coalesce(F.size("spans"), F.lit(0)).alias("replaced"))
