"""English and Russian stemming by the published Snowball algorithms, for the lexical search."""

from __future__ import annotations

import functools
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.functions.text import tokens

# The stop words of the two languages.
ENGLISH_STOP = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it
    its itself they them their theirs themselves what which who whom this that these those am is are was were be been
    being have has had having do does did doing a an the and but if or because as until while of at by for with about
    against between into through during before after above below to from up down in out on off over under again further
    then once here there when where why how all any both each few more most other some such no nor not only own same so
    than too very s t can will just don should now""".split()
)
RUSSIAN_STOP = frozenset(
    """и в во не что он на я с со как а то все она так его но да ты к у же вы за бы по только ее мне было вот от меня еще
    нет о из ему теперь когда даже ну вдруг ли если уже или ни быть был него до вас нибудь опять уж вам ведь там потом
    себя ничего ей может они тут где есть надо ней для мы тебя их чем была сам чтоб без будто чего раз тоже себе под
    будет ж тогда кто этот того потому этого какой совсем ним здесь этом один почти мой тем чтобы нее сейчас были куда
    зачем всех никогда можно при наконец два об другой хоть после над больше тот через эти нас про всего них какая много
    разве три эту моя впрочем хорошо свою этой перед иногда лучше чуть том нельзя такой им более всегда конечно всю
    между""".split()
)

# Fixed values of the English algorithm.
_SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl",
    "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
}
_SAME = frozenset("sky news howe atlas cosmos bias andes".split())
_SAME_LATER = frozenset("inning outing canning herring earring proceed exceed succeed".split())
_STEP_2 = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble",
    "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful",
    "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble",
}
_STEP_3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP_4 = "ement ance ence able ible ment ant ent ism ate iti ous ive ize al er ic".split()
_VOWEL = "aeiouy"
_SHORT = re.compile(r"(?:^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$")
_REGION = re.compile(r"[aeiouy][^aeiouy]")


def _ends(word: str, endings: dict | list) -> str:
    """The longest of ``endings`` that ``word`` ends with."""
    return max((e for e in endings if word.endswith(e)), key=len, default="")


def english(word: str) -> str:
    """The Porter2 stem of a lower-case word."""
    if len(word) <= 2 or word in _SAME:
        return word
    if word in _SPECIAL:
        return _SPECIAL[word]
    word = re.sub(r"^y|(?<=[aeiouy])y", "Y", word)
    head = re.match("gener|commun|arsen", word)
    found = head or _REGION.search(word)
    r1 = found.end() if found else len(word)
    found = _REGION.search(word, r1)
    r2 = found.end() if found else len(word)

    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and re.search("[aeiouy]", word[:-2]):
        word = word[:-1]
    if word in _SAME_LATER:
        return word

    if end := _ends(word, ["eed", "eedly"]):
        if len(word) - len(end) >= r1:
            word = word[: -len(end)] + "ee"
    elif (end := _ends(word, ["ed", "edly", "ing", "ingly"])) and re.search("[aeiouy]", word[: -len(end)]):
        word = word[: -len(end)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", word):
            word = word[:-1]
        elif r1 >= len(word) and _SHORT.search(word):
            word += "e"
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in _VOWEL:
        word = word[:-1] + "i"

    if end := _ends(word, [*_STEP_2, "ogi", "li"]):
        stem = word[: -len(end)]
        if len(stem) >= r1:
            if end in _STEP_2:
                word = stem + _STEP_2[end]
            elif end == "ogi" and stem.endswith("l"):
                word = stem + "og"
            elif end == "li" and stem[-1:] in tuple("cdeghkmnrt"):
                word = stem
    if end := _ends(word, [*_STEP_3, "ative"]):
        stem = word[: -len(end)]
        if len(stem) >= (r2 if end == "ative" else r1):
            word = stem + _STEP_3.get(end, "")
    if end := _ends(word, [*_STEP_4, "ion"]):
        stem = word[: -len(end)]
        if len(stem) >= r2 and (end != "ion" or stem.endswith(("s", "t"))):
            word = stem
    if word.endswith("e"):
        stem = word[:-1]
        if len(stem) >= r2 or len(stem) >= r1 and not _SHORT.search(stem):
            word = stem
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.replace("Y", "y")


# Fixed values of the Russian algorithm: endings; those of a first group must follow а or я.
_GERUND = ("в вши вшись".split(), "ив ивши ившись ыв ывши ывшись".split())
_ADJECTIVE = "ее ие ые ое ими ыми ей ий ый ой ем им ым ом его ого ему ому их ых ую юю ая яя ою ею".split()
_PARTICIPLE = ("ем нн вш ющ щ".split(), "ивш ывш ующ".split())
_REFLEXIVE = "ся сь".split()
_VERB = (
    "ла на ете йте ли й л ем н ло но ет ют ны ть ешь нно".split(),
    "ила ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ены ить ыть ишь ую ю".split(),
)
_NOUN = "а ев ов ие ье е иями ями ами еи ии и ией ей ой ий й иям ям ием ем ам ом о у ах иях ях ы ь ию ью ю ия ья я".split()
_SUPERLATIVE, _DERIVED = "ейш ейше".split(), "ост ость".split()
_RU_VOWEL = "[аеиоуыэюя]"


def _cut(tail: str, first: list[str], second: list[str]) -> str | None:
    """``tail`` without the longest ending of two groups; None if there is none."""
    end = max((e for e in first if tail.endswith(("а" + e, "я" + e))), key=len, default="")
    end = max([end, _ends(tail, second)], key=len)
    return tail[: -len(end)] if end else None


def russian(word: str) -> str:
    """The Snowball stem of a lower-case word."""
    word = word.replace("ё", "е")
    first = re.search(_RU_VOWEL, word)
    if not first:
        return word
    head, tail = word[: first.end()], word[first.end() :]
    region = re.compile(f"{_RU_VOWEL}[^аеиоуыэюя]")
    r1 = region.search(word)
    r2 = region.search(word, r1.end()) if r1 else None
    second = r2.end() if r2 else len(word)

    cut = _cut(tail, *_GERUND)
    if cut is not None:
        tail = cut
    else:
        cut = _cut(tail, [], _REFLEXIVE)
        tail = tail if cut is None else cut
        adjective = _cut(tail, [], _ADJECTIVE)
        if adjective is not None:
            participle = _cut(adjective, *_PARTICIPLE)
            tail = adjective if participle is None else participle
        else:
            for groups in (_VERB, ([], _NOUN)):
                cut = _cut(tail, *groups)
                if cut is not None:
                    tail = cut
                    break
    tail = tail.removesuffix("и")
    end = _ends(tail, _DERIVED)
    if end and len(head) + len(tail) - len(end) >= second:
        tail = tail[: -len(end)]
    end = _ends(tail, _SUPERLATIVE)
    if end:
        tail = tail[: -len(end)]
    if tail.endswith("нн"):
        tail = tail[:-1]
    elif not end:
        tail = tail.removesuffix("ь")
    return head + tail


@functools.lru_cache(1 << 16)
def stem(word: str) -> str:
    """The stem of a lower-case token, by its script; the empty string for a stop word."""
    if word in ENGLISH_STOP or word in RUSSIAN_STOP:
        return ""
    if re.fullmatch("[а-яё]+", word):
        return russian(word)
    return english(word) if re.fullmatch("[a-z]+", word) else word


@F.pandas_udf(T.ArrayType(T.StringType()))
def _stemmed(words: pd.Series) -> pd.Series:
    return words.map(lambda ws: None if ws is None else [s for s in map(stem, ws) if s])


def stems(text: Column) -> Column:
    """The stems of the tokens of ``text``, repeats included, without stop words."""
    return _stemmed(tokens(text))


def query_stems(query: str) -> list[str]:
    """The distinct stems of a query, in order."""
    found = (stem(t) for t in re.split(r"[\W_]+", query.lower()) if t)
    return list(dict.fromkeys(s for s in found if s))
