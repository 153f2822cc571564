"""Text functions on inline Cyrillic and Latin fixtures, and against plain Python versions."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftwood.functions import text as T
from siftwood.functions import vectors as V


def column(spark, values, make, name="x"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {name} string")
    return [r[1] for r in rows.select("i", make(F.col(name)).alias("y")).orderBy("i").collect()]


def test_tokens(spark):
    got = column(spark, ["Ёж_и café 42-я", None, "", "ПриВЕТ!"], T.tokenize)
    assert got == [["еж", "и", "caf", "42", "я"], [], [], ["привет"]]


STEMS = {
    "корабля": "корабл", "читающими": "чита", "синими": "син", "сила": "сила", "силы": "сил", "лесные": "лесн", "громко": "громк", "красным": "красным", "дом": "дом", "учиться": "учить",
    "walking": "walk", "heroes": "hero", "studies": "study", "running": "run", "hoped": "hop", "stopped": "stopp", "boxes": "box", "quickly": "quick",
    "glass": "glass", "bus": "bus", "cats": "cat", "x1s": "x1s", "2020": "2020",
}


def brute_stem_ru(word):
    """One suffix at a time, as the rule reads."""
    if len(word) <= 3:
        return word
    if len(word) > 4 and word[-2:] in ("ся", "сь"):
        word = word[:-2]
    for s in T.RU_SUFFIXES:
        if word.endswith(s):
            return word[: -len(s)] if len(word) - len(s) >= 3 else word
    return word


def test_russian_stems_equal_brute_force(spark):
    bases = ("", "а", "ст", "вод", "камен", "перелив", "лес")
    words = sorted({b + s + r for b in bases for s in T.RU_SUFFIXES for r in ("", "ся", "сь")} - {""})
    assert column(spark, words, T.stem) == [brute_stem_ru(w) for w in words]


def test_stems(spark):
    assert column(spark, list(STEMS), T.stem) == list(STEMS.values())


def test_deletes_never_reach_two_lengths_apart(spark):
    got = set(column(spark, ["вихрь"], T.deletes)[0])
    word = "вихрь"
    once = {word[:i] + word[i + 1 :] for i in range(5)}
    assert got == once | {w[:i] + w[i + 1 :] for w in once for i in range(4)}
    assert word not in got


def test_sentences_and_windows(spark):
    text = "Один.  Два!\nТри? Четыре… Пять"
    assert column(spark, [text, None, "x"], T.split_sentences) == [["Один.", "Два!", "Три?", "Четыре…", "Пять"], [], ["x"]]
    assert column(spark, [text], lambda c: T.windows(T.split_sentences(c), 2, 1))[0] == ["Один. Два!", "Два! Три?", "Три? Четыре…", "Четыре… Пять"]
    assert column(spark, [text], lambda c: T.windows(T.split_sentences(c), 3, 0))[0] == ["Один. Два! Три?", "Четыре… Пять"]
    assert column(spark, ["Одно."], lambda c: T.windows(T.split_sentences(c)))[0] == ["Одно."]


def test_questions(spark):
    asked = ["Кто это", "это кто?", "в каком году", "сколько стоит", "как звали деда", "где он", "почему", "что такое", "просто", "", None]
    assert column(spark, asked, T.is_question) == [True, True, False, True, True, True, True, True, False, False, False]
    assert column(spark, asked, T.question_type) == ["name", "name", "year", "number", "name", "place", "reason", "thing", None, None, None]


def test_toxicity_is_three_valued(spark):
    assert column(spark, ["Ядовит: да", "ядовита: нет", "ядовит: неизвестно", None], T.toxicity) == [True, False, None, None]


def test_entities(spark):
    assert column(spark, ["В Москве жил Анна-Мария в 1910 году"], lambda c: T.entities(c, T.NAME))[0] == ["Москве", "Анна-Мария"]
    assert column(spark, ["уехал в Казань из Тулы"], lambda c: T.entities(c, T.PLACE, 1))[0] == ["Казань", "Тулы"]
    assert column(spark, ["в 1910 и 2021, не 3000"], lambda c: T.entities(c, T.YEAR, 1))[0] == ["1910", "2021"]


def test_citation_skips_what_is_unknown(spark):
    row = spark.range(1).select(T.citation(F.lit("a.md"), heading=F.lit("H"), page=F.lit(None), line=F.lit(3)).alias("c")).first()
    assert row.c == "a.md · heading H · line 3"


@pytest.mark.parametrize("a,b,d", [("телега", "тилего", 2), ("берег", "берег", 0), ("крыша", "крыша!", 1), ("ab", "ba", 1), ("ca", "abc", 3), ("", "abcd", 3)])
def test_edit_distance(a, b, d):
    assert V.osa(a, b) == d


def test_edit_pairs_equal_brute_force(spark, monkeypatch):
    from siftwood import queries

    words = "form from fork abcde abxye word words sword the tea longest longets unlike".split()
    monkeypatch.setattr(queries, "benchmark", lambda *_: spark.createDataFrame([(1, " ".join(words))], "query_id int, text string"))
    once = lambda w: {w[:i] + w[i + 1 :] for i in range(len(w))}
    keys = {w: once(w).union(*map(once, once(w))) for w in words if len(w) >= 4}
    want = {(a, b, V.osa(a, b)) for a in keys for b in keys if a < b and keys[a] & keys[b]}
    assert {tuple(r) for r in queries.t8_edit_distance(spark, "").collect()} == want
    assert {("form", "from", 1), ("abcde", "abxye", 2)} <= want


@given(st.text("абcx ё", max_size=30))
@settings(max_examples=50, deadline=None)
def test_simhash_ignores_order(text):
    words = V.tokens(text)
    assert V.simhash_one(text, V.Hashes()) == V.simhash_one(" ".join(reversed(words)), V.Hashes())


def test_decoding_chain(spark):
    rows = spark.createDataFrame([(1, bytearray("Привет".encode("cp1251"))), (2, bytearray("﻿да".encode("utf-8"))), (3, None)], "i int, b binary")
    assert [r.t for r in rows.select("i", V.decoded("b").alias("t")).orderBy("i").collect()] == ["Привет", "да", None]


def test_json_leaves(spark):
    got = column(spark, ['{"a": {"b": [1, "x  y"]}, "c": null}', "no", None], V.json_leaves)
    assert got == [["a.b[0]: 1", "a.b[1]: x y", "c: None"], [], []]


def test_layout(spark):
    assert column(spark, ["ghbdtn"], T.to_cyrillic_keys) == ["привет"]
    assert column(spark, ["руддщ"], T.to_latin_keys) == ["hello"]


def test_stem_is_total(spark):
    words = [w for w in re.findall(r"\w+", "ся сь а ю ею ющий ing ed s ies ly oes xes")]
    assert all(isinstance(x, str) for x in column(spark, words, T.stem))
