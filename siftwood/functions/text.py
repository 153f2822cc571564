"""Text functions as Column expressions: tokens, stems, sentences, windows, question types, entities.

All run inside the JVM. Arrays keep the order of the text; a null text gives an empty array.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = "[a-zа-я0-9]+"

# Suffixes of Russian words in the order in which they are tried.
RU_SUFFIXES = (
    "ейшего ейшему ейшими ейших ейшее ейший "
    "ющимися ющемся ющегося "
    "ющего ющему ющими ующих ющих "
    "ующая ющая ующее ющее ующие ющие "
    "ующим ющим ующий ющий ующую ющую ющим ющей "
    "вшегося вшемуся вшимися вшихся вшееся вшийся "
    "вшего вшему вшими вших вшая вшее вшие "
    "вший вшим вшую вше "
    "ннего ннему нными нных нная нное нные "
    "нный нным нную "
    "ывающ ивающ ывают ивают ывает ивает ывая ивая "
    "ывали ивали овали евали овало евало овала евала "
    "оваться овать евать иваясь ываясь ивать ывать "
    "аете яете аешь яешь "
    "ает яет ают яют али яли ало яло "
    "ать ять оть уть ыть ить еть "
    "им ишь ите ил ила ило или "
    "ут ют ат ит ят ем ешь "
    "енн ен ан ян он ин т "
    "иями иях иям ией ием "
    "аями ями ыми ими ами ах ям ов ев ей ам "
    "ого ему ому их ых "
    "ая ое ые ий ый ой ую юю ее ие "
    "ем ом ью ия ие ий "
    "а о у е ы и ь я ю"
).split()

# Keys of the two keyboard layouts, in the same places.
LATIN_KEYS = "qwertyuiop[]asdfghjkl;'zxcvbnm,./`"
CYRILLIC_KEYS = "йцукенгшщзхъфывапролджэячсмитьбю.ё"

# Words that open a question.
QUESTION_WORDS = "как кто что где когда почему зачем сколько который которая чей откуда куда какой какая какие какое кем чем".split()

# What a question asks for, by the first pattern found in it.
QUESTION_TYPES = (
    ("year", r"в каком году|в каком веке|когда\b"),
    ("number", r"сколько\b"),
    ("name", r"как (звал|звали|назыв|зовут)|кто\b|кем\b|чей\b"),
    ("place", r"где\b|куда\b|откуда\b"),
    ("reason", r"почему|зачем|отчего"),
    ("thing", r"что\b|чем\b|расскажи|перескажи|опиши|объясни|поведай"),
)

# Patterns of entities; the last has its entity in group 1.
NAME = r"[А-ЯЁ][а-яё]+(?:-[А-ЯЁ][а-яё]+)*"
YEAR = r"\b(1[0-9]{3}|20[0-9]{2})\b"
NUMBER = r"\b\d[\d\s]*(?:[.,]\d+)?\b"
PLACE = r"\b(?:в|во|на|из|с|со|у|к|от|до)\s+([А-ЯЁ][а-яё]+)"

_SPACES = r"(?U)\s+"


def lowered(text: Column) -> Column:
    return F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("ё"), F.lit("е"))


def tokenize(text: Column) -> Column:
    return F.regexp_extract_all(lowered(text), F.lit(TOKEN), F.lit(0))


def bound(value: Column, make) -> Column:
    """make(value) with the value computed once, however often make uses it."""
    return F.get(F.transform(F.array(value), make), 0)


def _cut(word: Column, n: int) -> Column:
    return F.left(word, F.length(word) - n)


def stem_ru(word: Column) -> Column:
    """The first suffix of the list that fits goes, if three letters stay; otherwise nothing does.

    One pattern over the word read backwards: an alternation tries its branches in order, and the atomic group
    keeps it from trying another where too little would stay.
    """
    backwards = "|".join(s[::-1] for s in RU_SUFFIXES)
    cut = F.regexp_replace(F.reverse(word), f"^(?:[яь]с(?=.{{3}}))?(?:(?>{backwards})(?=.{{3}}))?", "")
    return F.when(F.length(word) <= 3, word).otherwise(F.reverse(cut))


def stem_en(word: Column) -> Column:
    size = F.length(word)
    ing, ed = _cut(word, 3), _cut(word, 2)
    doubled = (F.length(ing) >= 3) & (F.right(ing, F.lit(1)) == F.substring(ing, F.length(ing) - 1, 1)) & ~F.right(ing, F.lit(1)).rlike("[aeiouy]")
    plural = (
        F.when(word.endswith("ies") & (size > 4), F.concat(_cut(word, 3), F.lit("y")))
        .when(word.endswith("oes") & (size > 4), F.concat(_cut(word, 3), F.lit("o")))
        .when(word.rlike("(s|x|ch|sh|z)es$"), _cut(word, 2))
        .when(word.rlike("(ss|us|is)$"), word)
        .otherwise(_cut(word, 1))
    )
    return (
        F.when((size <= 3) | word.rlike("[0-9]"), word)
        .when(word.endswith("s"), plural)
        .when(word.endswith("ing") & (size > 5) & ing.rlike("[aeiouy]"), F.when(doubled, _cut(ing, 1)).otherwise(ing))
        .when(word.endswith("ed") & (size > 4) & ed.rlike("[aeiouy]"), ed)
        .when(word.endswith("ly") & (size > 4), _cut(word, 2))
        .otherwise(word)
    )


def stem(word: Column) -> Column:
    """By the first character: Cyrillic, Latin, or unchanged. Comparisons come first: most words keep their form."""
    cyrillic = (word >= "а") & (word < "ѐ")  # the letter after я
    latin = (word >= "a") & (word < "{") & (word.endswith("s") | word.endswith("ing") | word.endswith("ed") | word.endswith("ly"))
    return F.when(F.length(word) <= 3, word).when(latin, stem_en(word)).when(cyrillic, stem_ru(word)).otherwise(word)


def _stem_en_word(word: str) -> str:
    size = len(word)
    if re.search("[0-9]", word):
        return word
    if word.endswith("s"):
        if word.endswith(("ies", "oes")) and size > 4:
            return word[:-3] + ("y" if word[-3] == "i" else "o")
        if word.endswith(("ses", "xes", "ches", "shes", "zes")):
            return word[:-2]
        return word if word.endswith(("ss", "us", "is")) else word[:-1]
    if word.endswith("ing") and size > 5 and re.search("[aeiouy]", word[:-3]):
        rest = word[:-3]
        return rest[:-1] if rest[-1] == rest[-2] and rest[-1] not in "aeiouy" else rest
    if word.endswith("ed") and size > 4 and re.search("[aeiouy]", word[:-2]):
        return word[:-2]
    return word[:-2] if word.endswith("ly") and size > 4 else word


_RU_END = re.compile(f"^(?:[яь]с(?=.{{3}}))?(?:(?>{'|'.join(s[::-1] for s in RU_SUFFIXES)})(?=.{{3}}))?")


def stem_word(word: str) -> str:
    """stem() of one token, for workers that meet each distinct token once."""
    if len(word) <= 3:
        return word
    if "a" <= word[0] <= "z":
        return _stem_en_word(word) if word.endswith(("s", "ing", "ed", "ly")) else word
    return _RU_END.sub("", word[::-1], count=1)[::-1] if "а" <= word[0] <= "я" else word


def norm_terms(text: Column) -> Column:
    return F.transform(tokenize(text), stem)


def to_cyrillic_keys(word: Column) -> Column:
    return F.translate(word, LATIN_KEYS, CYRILLIC_KEYS)


def to_latin_keys(word: Column) -> Column:
    return F.translate(word, CYRILLIC_KEYS, LATIN_KEYS)


def deletes(word: Column) -> Column:
    """The distinct strings left after taking one or two characters away."""
    drop = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.left(w, i - 1), F.substring(w, i + 1, F.length(w))))
    once = F.when(F.length(word) > 0, drop(word)).otherwise(F.array().cast("array<string>"))
    twice = F.flatten(F.transform(once, lambda w: F.when(F.length(w) > 0, drop(w)).otherwise(F.array().cast("array<string>"))))
    return F.array_distinct(F.concat(once, twice))


def clean(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), _SPACES, " "))


def split_sentences(text: Column) -> Column:
    return F.filter(F.split(clean(text), r"(?<=[.!?…]) "), lambda s: s != "")


def long_sentences(text: Column, over: int = 5) -> Column:
    """Sentences of more than five characters; white space inside is left as it is."""
    parts = F.split(F.coalesce(text, F.lit("")), r"(?U)(?<=[.!?…])\s+")
    strip = lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")
    return F.filter(F.transform(parts, strip), lambda s: F.length(s) > over)


def windows(sentences: Column, size: int = 2, overlap: int = 1) -> Column:
    """Runs of ``size`` sentences, each starting size - overlap after the last, until one reaches the end."""
    step = max(1, size - overlap)

    def cut(s: Column) -> Column:
        last = F.greatest(F.lit(0), F.ceil((F.size(s) - size) / step)).cast("int")
        runs = F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(s, i * step + 1, size), " "))
        return F.when(F.size(s) > 0, runs).otherwise(F.array().cast("array<string>"))

    return bound(sentences, cut)


def is_question(text: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    return F.when(low == "", F.lit(False)).otherwise(low.endswith("?") | F.get(F.split(low, _SPACES), 0).isin(*QUESTION_WORDS))


def question_type(text: Column) -> Column:
    low, out = F.lower(F.coalesce(text, F.lit(""))), F.lit(None).cast("string")
    for kind, pattern in reversed(QUESTION_TYPES):
        out = F.when(low.rlike(f"(?U){pattern}"), kind).otherwise(out)
    return out


def entities(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"(?U){pattern}"), F.lit(group))


def toxicity(card: Column) -> Column:
    """What a card says about poison: true, false, or null where it does not say."""
    said = F.regexp_extract(F.lower(F.coalesce(card, F.lit(""))), r"(?U)ядовит\w*[:\s]*(да|нет)", 1)
    return F.when(said == "да", True).when(said == "нет", False)


def citation(source: Column, **places: Column) -> Column:
    """Source and what is known of heading, page, row and line, in that order."""
    parts = [F.concat(F.lit(f"{k} "), places[k].cast("string")) for k in ("heading", "page", "row", "line") if k in places]
    return F.concat_ws(" · ", F.coalesce(source, F.lit("?")), *parts)
