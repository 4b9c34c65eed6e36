"""Variant spellings of names linked to the entities they mean (problem 1).

1. Distinct spellings are normalised into forms: the name itself, its initials, and for Chinese names
   the short form without the place.
2. MinHash over padded q-grams of the forms' tokens, cut into bands. Bands and rows come from the
   collision curve ``1 - (1 - s^r)^b``: the fewest bands that still give pairs of ``MIN_JACCARD``
   a chance of ``RECALL`` to meet. Only spellings of known entities are posted; all spellings probe.
3. Candidates are verified by a Monge-Elkan similarity whose inner measure knows abbreviations,
   nicknames, initials, homophones and typing errors. Two words that are both common among the known
   entities are different words, however close; every word must find a partner.
4. Rows of known entities are clustered by star clustering: the row with most links becomes a centre
   and takes its unassigned neighbours, until none is left. A spelling goes to the cluster of its
   best match and to none if two clusters match equally well.

Generic phrases refer to nobody. Null and blank names and null keys are ignored; names without a
letter have no form. Repeated rows share their spelling and give a pair each; ties are settled by
key order; an empty table gives an empty result; very long names are compared whole. All joins are
on spellings, never on rows, so a company with a third of all rows costs one spelling.
"""

from __future__ import annotations

import math
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingloom.session import materialise

MIN_JACCARD, RECALL, ROWS = 0.45, 0.93, 4
#: Distinct spellings up to which their normal forms are broadcast.
BROADCAST_ROWS = 50_000
#: Verified similarity from which on two spellings are linked.
THRESHOLD = 0.8
#: A clearly better cluster: the runner-up must lie this far behind.
MARGIN = 0.015

#: Phrases that stand for whoever files.
GENERIC = ("the company", "the group", "the registrant", "the issuer", "the corporation", "the bank", "the parent", "the parent company", "the undersigned", "company", "group", "registrant", "issuer", "our company", "we", "us", "本公司", "公司", "本集团", "集团", "发行人", "母公司", "该公司", "贵公司", "我公司", "我们", "die gesellschaft", "der konzern", "das unternehmen")
#: Legal forms and the class each belongs to.
LEGAL = {"ltd": "ltd", "limited": "ltd", "plc": "plc", "llc": "llc", "inc": "inc", "incorporated": "inc", "corp": "corp", "corporation": "corp", "co": "co", "company": "co", "holdings": "", "holding": "", "hldgs": "", "hldg": "", "group": "", "grp": "", "gp": "", "sons": "", "son": "", "and": "", "gmbh": "gmbh", "ag": "ag", "aktiengesellschaft": "ag", "gesellschaft": "", "kg": "kg", "kgaa": "kgaa", "se": "se", "bv": "bv", "spa": "spa", "srl": "srl", "oyj": "oyj", "pty": "pty", "pte": "pte", "sarl": "sarl", "lp": "lp", "llp": "llp", "sa": "sa", "nv": "nv"}
#: Courtesy titles.
TITLES = frozenset("mr ms mrs miss dr prof sir the of".split())
#: Given names and their short forms.
NICKNAMES = {
    "alexander": "alex sandy xander lex al", "elizabeth": "beth liz lizzie eliza betty betsy lisa libby", "william": "bill will billy liam", "robert": "bob rob bobby robbie bert", "richard": "dick rick richie ricky",
    "katherine": "kathy kate kat katie kay kitty", "michael": "mike mick micky mikey", "josephine": "jo josie joey", "daniel": "dan danny", "rebecca": "becca becky", "christopher": "chris kit topher", "edward": "ed ted eddie ned teddy",
    "frederick": "fred freddie freddy rick", "theodora": "dora thea theo teddy", "anthony": "tony ant", "margaret": "peggy maggie meg marge greta", "james": "jim jamie jimmy", "patricia": "pat patty trish tricia", "susan": "sue susie suzy",
    "gabriela": "gabi gaby ella", "thomas": "tom tommy", "charles": "charlie chuck", "john": "jack johnny", "joseph": "joe joey", "samuel": "sam", "matthew": "matt", "andrew": "andy drew", "nicholas": "nick", "benjamin": "ben", "jennifer": "jen jenny", "victoria": "vicky tori", "deborah": "deb debbie", "catherine": "cathy kate cat", "stephen": "steve", "steven": "steve", "peter": "pete", "gregory": "greg", "kenneth": "ken", "timothy": "tim", "ronald": "ron", "barbara": "barb", "dorothy": "dot dotty",
}
#: Characters that sound or look alike.
HOMOPHONES = ("翰瀚汉", "鼎顶", "清青", "弘宏红洪", "晟盛胜圣", "拓托", "翎铃灵", "舟周", "博搏", "辰晨", "启起", "瑞睿锐", "越悦岳", "铭名明", "扬杨阳", "珩衡恒", "霄宵", "禾和", "远运", "曜耀", "骏峻俊", "驰池弛", "歆欣新", "昊浩皓", "朗郎", "锦金绵", "泽择", "澈彻", "旭序", "阔扩", "棠堂", "嵘荣", "航杭", "嘉佳", "诚成城", "华桦", "安谙", "丰峰锋", "达大", "康慷")
_SOUND = {c: group[0] for group in HOMOPHONES for c in group}
#: Branches of business at the end of Chinese company names.
BRANCHES = ("环保材料", "装备制造", "生物医药", "电子科技", "食品科技", "信息技术", "新能源", "新材料", "房地产", "半导体", "物流", "包装", "光电", "化工", "纺织", "轴承", "机械", "医药", "科技", "食品", "材料", "能源", "电子", "制造", "软件", "钢铁", "水泥", "玻璃", "造纸", "航运", "电力", "水务", "证券", "银行", "保险", "汽车", "通信", "建设", "投资", "贸易", "农业", "传媒", "制药", "仪器", "机器人")
_ZH_LEGAL = re.compile(r"(?:集团)?(?:控股)?(?:集团)?(?:股份)?(?:有限)?(?:责任)?(?:总)?公司$|(?:控股)?集团$")
_HAN = re.compile(r"[㐀-鿿]")


@lru_cache(maxsize=200_000)
def normalise(name: str) -> tuple[str, tuple[str, ...], str]:
    """(script, core tokens, legal class) of a name; ("", (), "") for generic phrases and no name."""
    text = unicodedata.normalize("NFKC", name).strip()
    folded = " ".join(text.casefold().split())
    if not folded or folded in GENERIC or not re.search(r"[^\W\d_]", folded):
        return "", (), ""
    if _HAN.search(text):
        return "zh", _chinese(text), ""
    text = re.sub(r"(?<=[a-zà-ÿ])(?=[A-ZÀ-Þ][a-zà-ÿ])", " ", text)  # words run together
    text = re.sub(r"(?<=\w)-\s?(?=\w)", "", text)  # a word split by a hyphen
    text = re.sub(r"\b([A-Za-z])\.(?=[A-Za-z]\b)", r"\1. ", text) if re.search(r"\b[A-Z]\.[A-Z]\.?\s", text) and not re.search(r"(?i)\b(?:l\.l\.c|p\.l\.c|l\.l\.p|l\.p)\b", text) else text
    text = re.sub(r"(?i)\b(l)\.\s?(l)\.\s?(c)\b\.?|\b(p)\.\s?(l)\.\s?(c)\b\.?", lambda m: "".join(g for g in m.groups() if g), text)
    words = re.findall(r"[^\W_]+", text.replace("'", "").replace("’", "").replace("&", " and ").casefold())
    core, legal = [], []
    for place, word in enumerate(words):
        # a mistyped form of law stands last
        form = word if word in LEGAL else next((w for w in LEGAL if len(w) >= 7 and place == len(words) - 1 and typing_distance(word, w) == 1), None)
        if form:
            legal.append(LEGAL[form])
        elif word not in TITLES:
            core.append(word)
    return "en", tuple(core), "".join(dict.fromkeys(legal))


def _chinese(text: str) -> tuple[str, ...]:
    """(branch, other units in order): the place and the brand are told apart only by comparing."""
    text = re.sub(r"\s", "", text)
    inside = "".join(re.findall(r"\(([^)]*)\)", text))
    core = _ZH_LEGAL.sub("", re.sub(r"\([^)]*\)", "", text))
    brand = core
    while ending := next((b for b in BRANCHES if brand.endswith(b) and len(brand) - len(b) >= (1 if brand == core else 2)), ""):
        brand = brand[: -len(ending)]
    branch, rest = core[len(brand) :], brand + inside
    if len(rest) > 3:
        rest = rest.replace("市", "")
    return (branch, *(rest[i : i + 2] for i in range(0, len(rest), 2)))


def sound(text: str) -> str:
    return "".join(_SOUND.get(c, c) for c in text)


@lru_cache(maxsize=500_000)
def typing_distance(a: str, b: str) -> int:
    """Edits and swaps of neighbours; 3 stands for three or more."""
    if abs(len(a) - len(b)) > 2:
        return 3
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a):
        row = [i + 1]
        for j, y in enumerate(b):
            best = min(last[j] + (x != y), last[j + 1] + 1, row[j] + 1)
            if before is not None and j and x == b[j - 1] and y == a[i - 1]:
                best = min(best, before[j - 1] + 1)
            row.append(best)
        before, last = last, row
    return min(last[-1], 3)


_NICK = {short: {full for full, shorts in NICKNAMES.items() if short in shorts.split()} for shorts in NICKNAMES.values() for short in shorts.split()}


def _abbreviates(short: str, long: str) -> float:
    if len(short) < 2 or len(short) >= len(long) or short[0] != long[0] or len(long) < 5:
        return 0.0
    if long.startswith(short):
        return 0.95 if len(short) >= 3 else 0.0
    it = iter(long)
    if not all(c in it for c in short):
        return 0.0
    return 0.9 if len(short) <= 0.75 * len(long) else 0.0


def token_similarity(a: str, b: str, n_a: int, n_b: int) -> float:
    """Similarity of two words of names; ``n_a`` and ``n_b`` count the spellings of known entities they occur in."""
    if a == b:
        return 1.0
    if len(a) == 1 or len(b) == 1:
        initial, word = sorted((a, b), key=len)
        return 0.88 if word[0] == initial or any(full[0] == initial for full in _NICK.get(word, ())) else 0.0
    if _NICK.get(a, set()) & _NICK.get(b, set()):
        return 0.93
    for x, y in ((a, b), (b, a)):
        for full in _NICK.get(x, ()):
            if full == y or (typing_distance(full, y) == 1):
                return 0.95
    short, long = sorted((a, b), key=len)
    rarer, commoner = sorted((n_a, n_b))
    typed = rarer <= 2 or commoner >= 10 * rarer
    if typed and (distance := typing_distance(a, b)) < 3:
        if distance == 1 and len(long) >= 4:
            return 0.92
        if distance == 2 and len(short) >= 6:
            return 0.8
    return _abbreviates(short, long)


def _merged(a: list[str], b: list[str]) -> list[str]:
    """Words of ``a`` that a stray blank split are joined where ``b`` has the whole word."""
    out = list(a)
    i = 0
    while i + 1 < len(out) and len(out) > len(b):
        whole = out[i] + out[i + 1]
        if any(whole == w or (len(whole) > 4 and typing_distance(whole, w) <= 1) for w in b) and not (out[i] in b and out[i + 1] in b):
            out[i : i + 2] = [whole]
        else:
            i += 1
    return out


def monge_elkan(a: list[str], b: list[str], count_a: dict[str, int], count_b: dict[str, int], inner=None) -> float:
    """Mean of the best partner similarities, both ways at once; 0 if a word is left without one.

    Single letters are initials: they may be missing on one side, but must not differ. Equal words
    are each other's best partners and are taken first; only the rest is compared.
    """
    if inner is None:
        inner = token_similarity
        if len(a) != len(b):
            a, b = _merged(a, b), _merged(b, a)
    left, right = dict.fromkeys(range(len(a))), dict.fromkeys(range(len(b)))
    total, weight, whole = 0.0, 0, 0
    for i, x in enumerate(a):
        j = min((j for j in right if b[j] == x), key=lambda j: abs(i - j), default=None)
        if j is not None:
            del left[i], right[j]
            total, weight, whole = total + 1.0, weight + 1, whole + (len(x) > 1)
    # a word needs a word or an initial as its partner
    if sum(len(a[i]) > 1 for i in left) > len(right) or sum(len(b[j]) > 1 for j in right) > len(left):
        return 0.0
    pairs = sorted(((s, i, j) for i in left for j in right if (s := inner(a[i], b[j], count_a.get(a[i], 1), count_b.get(b[j], 1))) > 0), key=lambda p: (-p[0], abs(p[1] - p[2]), p[1]))
    stood = []  # initials that stand for a word of the other name
    for s, i, j in pairs:
        if i in left and j in right:
            del left[i], right[j]
            total += s
            weight += 1
            whole += len(a[i]) > 1 and len(b[j]) > 1
            if (len(a[i]) > 1) != (len(b[j]) > 1):
                stood.append((0, i) if len(a[i]) == 1 else (1, j))
    rest_a, rest_b = [a[i] for i in left], [b[j] for j in right]
    if not whole or any(len(t) > 1 for t in rest_a + rest_b) or (rest_a and rest_b):
        return 0.0
    # the initial of a given name comes first: "M. E. Smith" is no Elizabeth
    if any(k < place for side, place in stood for k in (left, right)[side]):
        return 0.0
    # and it stands for a word its own name lacks: else surnames would pass as middle initials
    full = [sum(len(t) > 1 for t in t_) for t_ in (a, b)]
    if any(full[side] >= full[1 - side] for side, _ in stood):
        return 0.0
    missing = len(rest_a) + len(rest_b)
    return (total + 0.9 * missing) / (weight + missing)


def unit_similarity(a: str, b: str, n_a: int = 1, n_b: int = 1) -> float:
    """Similarity of two units of Chinese names: equal, or of the same sound character by character."""
    return 1.0 if a == b else 0.94 if len(a) == len(b) and sound(a) == sound(b) else 0.0


def chinese_similarity(a: list[str], b: list[str]) -> float:
    """Monge-Elkan over the units of two Chinese names, the shorter against the longer.

    Equal branch, equal or like-sounding brand; the place may be missing and may change its position.
    One of the names may lack the branch: then the rest must be equal.
    """
    if len(a) < 2 or len(b) < 2:
        return 0.0
    if a[0] != b[0]:
        bare, other = (a, b) if not a[0] else (b, a)
        if bare[0]:
            return 0.0
        # the brand alone may end within a unit of the longer name
        return 0.82 if len("".join(bare[1:])) >= 2 and "".join(bare[1:]) == "".join(other[1:]) else 0.0
    short, long = sorted((list(a[1:]), list(b[1:])), key=len)
    if len(long) - len(short) > 1:
        return 0.0
    total = 0.0
    for unit in short:
        best = max(((unit_similarity(unit, u), -k) for k, u in enumerate(long)))
        if not best[0]:
            return 0.0
        total += best[0]
        long.pop(-best[1])
    # a lone brand is weak: what is left over on the other side must be its place, not its brand
    return (total + 0.88 * len(long)) / (len(short) + len(long))


def similarity(a: tuple, b: tuple, counts_a: dict[str, int], counts_b: dict[str, int]) -> float:
    """Verified similarity of two normalised names (script, tokens, legal class)."""
    if not a[0] or not b[0]:
        return 0.0
    if a[0] != b[0]:
        return 0.0
    if a[0] == "zh":
        return chinese_similarity(a[1], b[1])
    for x, y in ((a, b), (b, a)):
        if len(x[1]) == 1 and len(y[1]) >= 3 and x[1][0] == "".join(t[0] for t in y[1]) and all(len(t) > 1 for t in y[1]):
            return 0.86
    if len(a[1]) == 1 or len(b[1]) == 1:  # too little to be compared by likeness
        return float(a[1] == b[1]) * (0.5 if a[2] and b[2] and a[2] != b[2] else 1.0)
    score = monge_elkan(list(a[1]), list(b[1]), counts_a, counts_b)
    return score * (0.5 if a[2] and b[2] and a[2] != b[2] else 1.0)  # forms of law are abbreviated, not exchanged


def bands_needed(jaccard: float = MIN_JACCARD, recall: float = RECALL, rows: int = ROWS) -> int:
    """Fewest bands with which a pair of that similarity meets with that probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - jaccard**rows))


def _grams(form: tuple[str, ...], q: int) -> set[str]:
    pad = "\u0002" * (q - 1)
    return {padded[i : i + q] for t in form for padded in (pad + t + "\u0003" * (q - 1),) for i in range(len(padded) - q + 1)}


def forms_of(parsed: tuple[str, tuple[str, ...], str]) -> list[tuple[str, ...]]:
    """Token sets a name may be met by."""
    script, core, _ = parsed
    if not core:
        return []
    if script == "zh":
        units = [sound(u) for u in core[1:]]
        return [(sound(core[0]), *units), *((sound(core[0]), u) for u in units)]
    forms = [core]
    words = [t for t in core if len(t) > 1]
    if len(words) >= 3 and len(words) == len(core):
        forms.append(("".join(t[0] for t in words),))
    people = [full for t in core for full in _NICK.get(t, ())]
    if people:
        forms.append((*[t for t in core if t not in _NICK], *people[:1]))
    return forms


_PRIME = (1 << 61) - 1


@lru_cache(maxsize=4)
def _hashes(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_601)
    return rng.integers(1, 1 << 31, count, dtype=np.uint64), rng.integers(0, 1 << 31, count, dtype=np.uint64)


def band_keys(form: tuple[str, ...], bands: int, rows: int, q: int = 2) -> list[str]:
    """One key per band of the MinHash signature of a form."""
    import xxhash

    grams = np.array([xxhash.xxh32_intdigest(g) for g in sorted(_grams(form, q))], dtype=np.uint64)
    a, b = _hashes(bands * rows)
    signature = ((grams[:, None] * a[None, :] + b[None, :]) % np.uint64(2_147_483_647)).min(axis=0).reshape(bands, rows)
    return [f"{i}:" + ":".join(map(str, band)) for i, band in enumerate(signature.tolist())]


def _spellings(names: DataFrame, bands: int) -> DataFrame:
    """Distinct spellings with their normal form and band keys."""
    parsed_type = "struct<script:string,core:array<string>,legal:string,keys:array<string>>"

    @F.pandas_udf(parsed_type)
    def parse(values: pd.Series) -> pd.DataFrame:
        rows = []
        for value in values:
            parsed = normalise(value)
            keys = sorted({k for form in forms_of(parsed) for k in band_keys(form, bands, ROWS)})
            rows.append((parsed[0], list(parsed[1]), parsed[2], keys))
        return pd.DataFrame(rows, columns=["script", "core", "legal", "keys"])

    distinct = names.where("name IS NOT NULL AND trim(name) <> ''").select("name").distinct()
    # spread: a small column is heavy work here
    spread = distinct.repartition(int(names.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return materialise(spread.withColumn("p", parse.asNondeterministic()("name")).select("name", "p.*").where("script <> ''"))


def _word_counts(parsed: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(name, counts): in how many spellings of the vocabulary each word of a name occurs."""
    words = parsed.where("script = 'en'").select("name", F.explode(F.array_distinct("core")).alias("word"))
    counts = words.join(vocabulary.select("name").distinct(), "name", "left_semi").groupBy("word").agg(F.count(F.lit(1)).cast("int").alias("n"))
    return words.join(counts, "word").groupBy("name").agg(F.map_from_entries(F.collect_list(F.struct("word", "n"))).alias("counts"))


def _possible(x: str, y: str) -> Column:
    """A bound that needs no Python: false only where ``similarity`` is below the threshold for sure.

    Different forms of law halve the score. Every word of more than a letter needs a partner: an equal
    word, an initial, or a word left over that begins alike (abbreviations), is near (typing errors),
    has a short form (given names) or is one of two words the other was split into. Of Chinese names
    every unit of the shorter must sound like one of the longer.
    """
    a, b = F.col(f"{x}.core"), F.col(f"{y}.core")
    legal = (F.col(f"{x}.legal") == "") | (F.col(f"{y}.legal") == "") | (F.col(f"{x}.legal") == F.col(f"{y}.legal"))
    nicks = list(_NICK)

    def rest(c: Column, d: Column) -> Column:
        return F.filter(F.array_except(c, d), lambda w: F.length(w) > 1)

    def initials(c: Column) -> Column:
        return F.exists(c, lambda w: F.length(w) == 1)

    def part(w: Column, v: Column) -> Column:
        return (F.length(w) < F.length(v)) & ((F.levenshtein(F.left(v, F.length(w)), w) <= 1) | (F.levenshtein(F.right(v, F.length(w)), w) <= 1) | (F.levenshtein(F.right(v, F.length(w) + 1), w) <= 1))

    def alike(w: Column, v: Column) -> Column:
        # a swap of neighbours is two plain edits
        near = F.levenshtein(w, v) <= F.when(F.least(F.length(w), F.length(v)) < 6, 2).otherwise(4)
        begins = (F.left(w, F.lit(1)) == F.left(v, F.lit(1))) & (F.length(w) != F.length(v))
        split = (F.size(a) != F.size(b)) & (part(w, v) | part(v, w))
        return near | begins | w.isin(nicks) | v.isin(nicks) | split

    left, right = rest(a, b), rest(b, a)
    repeated = (F.size(F.array_distinct(a)) < F.size(a)) | (F.size(F.array_distinct(b)) < F.size(b)) | (F.size(a) != F.size(b)) & (F.size(left) + F.size(right) <= 2)
    partners = (initials(b) | F.forall(left, lambda w: F.exists(right, lambda v: alike(w, v)))) & (initials(a) | F.forall(right, lambda v: F.exists(left, lambda w: alike(w, v))))
    # one word alone: equal, or the initials of the other name
    letters = (F.size(a) == 1) & (F.length(F.get(a, F.lit(0))) == F.size(b)) | (F.size(b) == 1) & (F.length(F.get(b, F.lit(0))) == F.size(a))
    single = (F.size(a) == 1) | (F.size(b) == 1)
    english = legal & F.when(single, (a == b) | letters).otherwise(partners | repeated)
    branch = (F.get(a, F.lit(0)) == F.get(b, F.lit(0))) | (F.get(a, F.lit(0)) == "") | (F.get(b, F.lit(0)) == "")

    def sounds(c: Column) -> Column:
        return F.transform(F.slice(c, F.lit(2), F.greatest(F.size(c) - 1, F.lit(0))), lambda u: F.translate(u, "".join(_SOUND), "".join(_SOUND.values())))

    chinese = branch & ((F.size(F.array_except(sounds(a), sounds(b))) == 0) | (F.size(F.array_except(sounds(b), sounds(a))) == 0))
    return F.when(F.col(f"{x}.script") == "en", english).otherwise(chinese)


def links(known: DataFrame, names: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """(name, known_name, score): verified links of spellings to the spellings of known entities.

    ``known``, ``names`` and ``vocabulary`` (default: ``known``) have the one column ``name``; a spelling
    is not linked to itself.
    """
    vocabulary = known if vocabulary is None else vocabulary
    spelled = _spellings(known.unionByName(names).unionByName(vocabulary), bands_needed())
    referenced = spelled.join(known.select("name").distinct(), "name", "left_semi")
    wanted = spelled.join(known.unionByName(names).select("name").distinct(), "name", "left_semi")
    posted = referenced.select(F.explode("keys").alias("key"), F.col("name").alias("known_name"))
    probes = wanted.select(F.explode("keys").alias("key"), "name")
    pairs = probes.join(posted, "key").where("name <> known_name").select("name", "known_name").distinct()

    def facts(prefix: str, df: DataFrame, key: str) -> DataFrame:
        return df.select(F.col("name").alias(key), F.struct("script", "core", "legal").alias(prefix))

    small = wanted.count() <= BROADCAST_ROWS

    def sized(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if small else df

    full = pairs.join(sized(facts("x", wanted, "name")), "name").join(sized(facts("y", referenced, "known_name")), "known_name")
    full = full.where((F.col("x.script") == F.col("y.script")) & _possible("x", "y"))
    counts = _word_counts(spelled, vocabulary)
    full = full.join(counts.withColumnRenamed("counts", "n_x"), "name", "left").join(counts.select(F.col("name").alias("known_name"), F.col("counts").alias("n_y")), "known_name", "left")

    @F.pandas_udf("double")
    def score(x: pd.DataFrame, y: pd.DataFrame, n_x: pd.Series, n_y: pd.Series) -> pd.Series:
        def rows(df: pd.DataFrame, counted: pd.Series) -> list[tuple]:
            return [((s, tuple(c), g), dict(n) if n is not None else {}) for s, c, g, n in zip(df["script"], df["core"], df["legal"], counted)]

        return pd.Series([similarity(a, b, na, nb) for (a, na), (b, nb) in zip(rows(x, n_x), rows(y, n_y))], dtype="float64")

    return full.select("name", "known_name", score.asNondeterministic()("x", "y", "n_x", "n_y").alias("score")).where(F.col("score") >= THRESHOLD)


def star_clusters(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, centre): star clustering of ``edges (a, b, score)``, both directions given.

    The node with most links among its open neighbours becomes a centre (ties: the smaller key) and
    takes them; each goes to its best centre. Degrees are counted anew among the open nodes, until
    every node has a centre: every round closes at least one node, most close nearly all.
    """
    open_edges, done = edges, None
    while not open_edges.isEmpty():
        degree = open_edges.groupBy("a").agg(F.count(F.lit(1)).alias("degree"))
        ranked = open_edges.join(degree, "a").join(degree.select(F.col("a").alias("b"), F.col("degree").alias("degree_b")), "b")
        ahead = (F.col("degree_b") > F.col("degree")) | ((F.col("degree_b") == F.col("degree")) & (F.col("b") < F.col("a")))
        # a node is a centre if no open neighbour goes before it
        judged = materialise(ranked.groupBy("a").agg(F.max(ahead).alias("beaten"), F.first("degree").alias("degree")))
        centres = judged.where("NOT beaten").select(F.col("a").alias("b"), F.col("degree").alias("degree_b"))
        taken = open_edges.join(centres, "b").groupBy("a").agg(F.max(F.struct("score", "degree_b", "b")).alias("best")).select(F.col("a").alias("node"), F.col("best.b").alias("centre"))
        step = materialise(centres.select(F.col("b").alias("node"), F.col("b").alias("centre")).unionByName(taken))
        done = step if done is None else done.unionByName(step)
        open_edges = materialise(open_edges.join(step.select(F.col("node").alias("a")), "a", "left_anti").join(step.select(F.col("node").alias("b")), "b", "left_anti"))
    if done is None:
        return nodes.select("node", F.col("node").alias("centre"))
    return nodes.select(F.col("node")).join(done, "node", "left").select("node", F.coalesce("centre", "node").alias("centre"))


def _known_names(entities: DataFrame) -> DataFrame:
    every = F.concat(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>")))
    rows = entities.where("entity_id IS NOT NULL").select("entity_id", F.explode(F.array_distinct(every)).alias("name"))
    return rows.where(F.col("name").isNotNull() & (F.trim("name") != "") & ~F.lower(F.trim("name")).isin(*GENERIC))


def resolve(entities: DataFrame, mentions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entity_id, cluster) of the known rows and (name, cluster, score) of the spellings new to them."""
    known = materialise(_known_names(entities))
    new = mentions.where("name IS NOT NULL").select("name").distinct().join(known.select("name").distinct(), "name", "left_anti")
    found = materialise(links(known.select("name").distinct(), new))
    owners = known.select(F.col("name").alias("known_name"), F.col("entity_id").alias("owner"))
    # rows that share a spelling are linked as well
    same = known.select(F.col("entity_id").alias("a"), "name").join(known.select(F.col("entity_id").alias("b"), "name"), "name").where("a <> b").select("a", "b", F.lit(1.0).alias("score"))
    linked = found.join(known.select("name", F.col("entity_id").alias("a")), "name").join(owners.select("known_name", F.col("owner").alias("b")), "known_name").where("a <> b").select("a", "b", "score")
    # initials and other weak forms alone do not make two rows one
    both = linked.where("score >= 0.87").unionByName(same)
    edges = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"), "score")).groupBy("a", "b").agg(F.max("score").alias("score"))
    clusters = materialise(star_clusters(materialise(edges), entities.where("entity_id IS NOT NULL").select(F.col("entity_id").alias("node")).distinct()).select(F.col("node").alias("entity_id"), F.col("centre").alias("cluster")))
    scored = found.join(new, "name", "left_semi").join(owners, "known_name").join(clusters.withColumnRenamed("entity_id", "owner"), "owner").groupBy("name", "cluster").agg(F.max("score").alias("score"))
    ranked = scored.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("score", "cluster")), asc=False).alias("c"))
    clear = (F.size("c") == 1) | (F.get("c", F.lit(0))["score"] - F.coalesce(F.get("c", F.lit(1))["score"], F.lit(0.0)) >= MARGIN)
    return clusters, ranked.where(clear).select("name", F.get("c", F.lit(0))["cluster"].alias("cluster"), F.get("c", F.lit(0))["score"].alias("score"))


def unlisted(entities: DataFrame, mentions: DataFrame, spelled: DataFrame) -> DataFrame:
    """(name, cluster, score): mentions of entities without a row, linked among themselves.

    ``spelled`` are the mentions that have a row. Words are counted over the known entities alone, so
    that the verdict on a pair does not change with the number of mentions. A cluster bears the name
    of its centre.
    """
    known = _known_names(entities).select("name").distinct()
    rest = mentions.where("name IS NOT NULL").select("name").distinct().join(known, "name", "left_anti").join(spelled.select("name"), "name", "left_anti")
    rest = materialise(rest)
    found = materialise(links(rest, rest.limit(0), known))
    edges = found.select(F.col("name").alias("a"), F.col("known_name").alias("b"), "score")
    edges = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "score")).groupBy("a", "b").agg(F.max("score").alias("score"))
    clusters = star_clusters(materialise(edges), rest.select(F.col("name").alias("node")))
    best = found.select("name", F.col("known_name").alias("cluster"), "score")
    joined = clusters.select(F.col("node").alias("name"), F.col("centre").alias("cluster")).join(best, ["name", "cluster"], "left")
    return joined.select("name", "cluster", F.coalesce("score", F.lit(1.0)).alias("score"))


def mentions_of(entities: DataFrame, observations: DataFrame) -> DataFrame:
    """Mentions and observations as ``(key, name)``."""
    people = entities.select(F.col("mention_id").alias("key"), "name")
    return people.unionByName(observations.select(F.col("observation_id").alias("key"), F.col("company").alias("name"))).where("key IS NOT NULL AND name IS NOT NULL")


def found(entities: DataFrame, mentions: DataFrame) -> DataFrame:
    """(key_a, key_b): rows of one entity, and rows with the mentions that spell it in a new way."""
    clusters, spelled = resolve(entities, mentions)
    pair = clusters.select(F.col("entity_id").alias("x"), "cluster").join(clusters.select(F.col("entity_id").alias("y"), "cluster"), "cluster").where("x < y").select("x", "y")
    mentioned = mentions.join(spelled, "name").select(F.col("key").alias("y"), "cluster").join(clusters, "cluster").select(F.col("entity_id").alias("x"), "y")
    return pair.unionByName(mentioned).select(F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b")).distinct()
