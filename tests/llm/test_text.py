import random

import pytest
from pyspark.sql import functions as F

from filingloom.llm import canonical, noise, split


def test_pieces_cover_the_text_and_overlap():
    rng = random.Random(1)
    for size in (0, 1, 799, 800, 801, 1500, 5000, 200_000):
        text = "".join(rng.choice("ab。 \n.,字") for _ in range(size))
        pieces = split.split_text(text)
        assert all(b - a <= 800 for a, b in pieces) and pieces[0][0] == 0 and pieces[-1][1] == size
        rebuilt = text[: pieces[0][1]]
        for (_, before), (a, b) in zip(pieces, pieces[1:]):
            assert before - a == 100
            rebuilt += text[before:b]
        assert rebuilt == text and (len(pieces) == 1) == (size <= 800)


def test_cuts_prefer_strong_boundaries():
    text = "word " * 70 + "end.\n\n" + "word " * 90
    (_, end), *_ = split.split_text(text)
    assert text[:end].endswith("\n\n")
    assert split.cut_points("x" * 1000, 700) == [500]


def test_split_items(spark):
    rows = [("s", "k", "p", "😀" * 801, 1), ("s", "short", "p", "x", 1), ("s", "empty", "p", "", 1), ("s", "none", "p", None, 1), ("s", None, "p", "y" * 900, 1), ("s", "twice", "p", "z" * 900, 1), ("s", "twice", "p", "z" * 900, 1)]
    items = spark.createDataFrame(rows, "item_kind string, item_key string, parent_key string, content string, piece int")
    out = split.split_items(items).collect()
    by = {}
    for r in out:
        by.setdefault(r.item_key, []).append(r)
    assert set(by) == {"k", "short", "empty", "twice"} and len(by["k"]) == 2 and len(by["twice"]) == 4 and by["empty"][0].piece == ""
    assert split.split_items(items.limit(0)).count() == 0
    with pytest.raises(ValueError):
        split.split_items(items, 100, 100)


def _values(spark, texts):
    tables = spark.createDataFrame([], "id string, title string, headers array<string>")
    return canonical.text_values(tables, spark.createDataFrame(list(texts.items()), "segment_id string, content string"))


def test_headers_of_chinese_tables(spark):
    tables = spark.createDataFrame([("zh", "合并利润表", ["项目", "2019（US$）"]), ("en", "Income", ["Item", "2019（US$）"]), ("none", None, None)], "id string, title string, headers array<string>")
    values = canonical.text_values(tables, spark.createDataFrame([], "segment_id string, content string"))
    assert [tuple(r) for r in canonical.found(values).collect()] == [("en", "headers")]


def test_lookalikes_are_found_and_folded(spark):
    texts = {
        "wide": "Ｒevenue ２０２３", "zero": "rev​enue", "nbsp": "net\u00a0income", "cyr": "rеvenue", "greek": "prοfit", "comb": "Re\u0301sume\u0301", "radical": "\u2f6c标", "compat": "\uf9dd润",
        "plain": "Résumé of 2023, façade", "word": "Вельтранс and Ορφανέα", "symbol": "a β of 1.1 and m²", "punct": "营业收入（万元），合计：", "rare": "𠮷野", "empty": "", "widepunct": "Revenue（net）",
    }
    values = _values(spark, texts)
    assert {r.item_key for r in canonical.found(values).collect()} == {"wide", "zero", "nbsp", "cyr", "greek", "comb", "radical", "compat", "widepunct"}
    out = {r.item_key: r.text for r in canonical.normalised(values).collect()}
    assert out["wide"] == "Revenue 2023" and out["zero"] == "revenue" and out["nbsp"] == "net income" and out["cyr"] == "revenue" and out["greek"] == "profit"
    assert out["comb"] == "Résumé" and out["radical"] == "目标" and out["compat"] == "利润" and out["widepunct"] == "Revenue(net)"
    assert all(out[k] == texts[k] for k in ("plain", "word", "symbol", "punct", "rare", "empty"))
    assert canonical.found(values.limit(0)).count() == 0


CLEAN = ["The committee approved the operating income of the year.", "Operating income rose and the committee discussed repayment of loans.", "The repayment was approved in the year-on-year review by the committee.", "报告期内营业利润上升。", "营业利润下降，利率上升。"] * 12


def _noise(spark, texts):
    rows = [(f"c{i}", None, t) for i, t in enumerate(CLEAN)] + [(k, "d", t) for k, t in texts.items()]
    return spark.createDataFrame(rows, "item_key string, doc_key string, text string")


def test_noise_kinds(spark):
    texts = {
        "hyphen": "The commit-\ntee approved the repay¬\nment.", "compound": "The year-on-\nyear review was approved.", "misread": "The comm!ttee approved the 0perating income.", "letters": "The cornmittee approved it.",
        "number": "It rose by 3l.3% over the year.", "ideograph": "报告期内营业刊润上升。", "page": "The year.\nPage 12 of 90\nIncome", "dash": "- 7 -", "roman": "text\nxiv\ntext", "years": "Comparative periods:\n2018\n2021",
        "header": "Acme Foods plc Annual Report 2020\nThe committee", "upper": "ACME FOODS PLC - ANNUAL REPORT 2020", "heading": "Management discussion\n\nThe committee", "empty": "", "long": "The committee approved. " * 4000, "sentence": "Compared with the interim report, the outlook for",
    }
    got = {}
    for r in noise.found(_noise(spark, texts)).collect():
        got.setdefault(r.item_key, set()).add(r.noise_kind)
    assert {k: v for k, v in got.items() if k in texts} == {
        "hyphen": {"hyphenation"}, "misread": {"misread"}, "letters": {"misread"}, "number": {"misread"}, "ideograph": {"misread"}, "page": {"page_number"}, "dash": {"page_number"}, "roman": {"page_number"}, "header": {"running_header"}, "upper": {"running_header"},
    }
    assert not any(k.startswith("c") and k[1:].isdigit() for k in got)


def test_repair(spark):
    texts = {"all": "Acme Foods plc Annual Report 2020\nThe comm!ttee approved the repay-\nment\n~ 12 ~\nof 3l.3% in the\nyear.", "zh": "报告期内营业刊\n润上升。"}
    out = {r.item_key: r.text for r in noise.repaired(_noise(spark, texts)).collect()}
    assert out["all"] == "The committee approved the repayment of 31.3% in the year." and out["zh"] == "报告期内营业利润上升。"


def test_confusion_distance():
    assert noise.confusion_distance("million", "rnillion") == 0.25 and noise.confusion_distance("discussed", "disciisscd") == 0.5 and noise.confusion_distance("cost", "coat") >= 1


def test_noise_of_nothing(spark):
    assert noise.found(spark.createDataFrame([], "item_key string, doc_key string, text string")).count() == 0


@pytest.mark.parametrize("word,plain", [("pαyment", "payment"), ("ραyment", "payment"), ("ԁebt", "debt"), ("marɡin", "margin"), ("lⅰne", "line"), ("\U0001d400ssets", "Assets"), ("ｱ", "ア"), ("Ꭺssets", "Assets"), ("օwned", "owned"), ("кey", "key")])
def test_look_alikes_of_many_scripts(spark, word, plain):
    tables = spark.createDataFrame([("t", f"Total {word} due", None)], "id string, title string, headers array<string>")
    values = canonical.text_values(tables, spark.createDataFrame([], "segment_id string, content string"))
    assert canonical.normalised(values).first().text == f"Total {plain} due"


@pytest.mark.parametrize("text", ["αmax of the β-test, Δt and ω", "①存货 ②应收", "АКТИВЫ всего", "İşık ve kârı", "10² m³ naïve Ç", "（一）公司概况：见附注。"])
def test_ordinary_texts_stay(spark, text):
    tables = spark.createDataFrame([("t", text, None)], "id string, title string, headers array<string>")
    assert canonical.found(canonical.text_values(tables, spark.createDataFrame([], "segment_id string, content string"))).count() == 0


def test_headers_by_repetition(spark):
    """A line without the form of a report's title is a header where it heads several pages of a document."""
    texts = {f"p{i}": f"{i} Penholm Works Gazette\nThe committee approved part {'abcd'[i]} of it.\nPage {i}" for i in range(4)} | {f"s{i}": f"The year was approved.\nPart {'abcd'[i]} followed" for i in range(4)}
    got = {}
    for r in noise.found(_noise(spark, texts)).collect():
        got.setdefault(r.item_key, set()).add(r.noise_kind)
    assert all("running_header" in got[f"p{i}"] and "page_number" in got[f"p{i}"] for i in range(4))
    assert not any(f"s{i}" in got for i in range(4))  # sentences repeat, headers are no sentences
    out = {r.item_key: r.text for r in noise.repaired(_noise(spark, texts)).collect()}
    assert out["p2"] == "The committee approved part c of it."


def test_words_of_any_length(spark):
    long = "internationalisation" * 4
    texts = {f"w{i}": f"The {long} of it was approved." for i in range(5)} | {"bad": f"The {long.replace('o', '0', 1)} of it was approved.", "short": "The committee 0f it was approved in the year."} | {f"o{i}": "The committee of it was approved in the year." for i in range(40)}
    got = {r.item_key for r in noise.found(_noise(spark, texts)).collect() if r.noise_kind == "misread"}
    assert got == {"bad", "short"}
