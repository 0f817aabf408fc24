"""The published English stemmer (Porter's second), and what is made with it: stems over distinct words in Arrow batches."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankspark.functions.wordlists import CONTENT_STOPWORDS

#: Exceptions and endings of the published algorithm. Fixed values.
EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
AFTER_PLURAL = frozenset("inning outing canning herring earring proceed exceed succeed".split())
STEP_2 = {
    "ational": "ate", "ization": "ize", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate",
    "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble",
}
STEP_3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = "ement ance ence able ible ment ant ent ism ate iti ous ive ize al er ic".split()
VOWEL, OTHER = "[aeiouy]", "[^aeiouy]"
DOUBLE = re.compile("(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$")


def _regions(word: str) -> tuple[int, int]:
    """Where the regions after the first and the second vowel-consonant pair begin."""
    special = re.match("gener|commun|arsen", word)
    first = special.end() if special else (m.end() if (m := re.search(VOWEL + OTHER, word)) else len(word))
    second = first + m.end() if (m := re.search(VOWEL + OTHER, word[first:])) else len(word)
    return first, second


def _short(word: str) -> bool:
    """Whether a word ends in a short syllable."""
    return bool(re.search(f"(?:^{VOWEL}{OTHER}|{OTHER}{VOWEL}[^aeiouywxY])$", word))


def _longest(word: str, endings) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if len(word) <= 2:
        return word
    if word in EXCEPTIONS:
        return EXCEPTIONS[word]
    word = word.lstrip("'")
    word = re.sub(f"^y|(?<={VOWEL})y", "Y", word)
    r1, r2 = _regions(word)
    word = re.sub("(?:'s'|'s|')$", "", word)
    if word.endswith("sses"):
        word = word[:-2]
    elif re.search("ie[sd]$", word):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif re.search("[^us]s$", word) and re.search(VOWEL, word[:-2]):
        word = word[:-1]
    if word in AFTER_PLURAL:
        return word
    ending = _longest(word, ("eedly", "eed", "ingly", "edly", "ing", "ed"))
    if ending in ("eedly", "eed"):
        if len(word) - len(ending) >= r1:
            word = word[: -len(ending)] + "ee"
    elif ending and re.search(VOWEL, word[: -len(ending)]):
        word = word[: -len(ending)]
        if re.search("(?:at|bl|iz)$", word):
            word += "e"
        elif DOUBLE.search(word):
            word = word[:-1]
        elif _short(word) and r1 >= len(word):
            word += "e"
    word = re.sub(f"(?<=.)(?<={OTHER})[yY]$", "i", word) if len(word) > 2 else word
    ending = _longest(word, (*STEP_2, "ogi", "li"))
    if ending and len(word) - len(ending) >= r1:
        if ending in STEP_2:
            word = word[: -len(ending)] + STEP_2[ending]
        elif (ending == "ogi" and word[:-3].endswith("l")) or (ending == "li" and re.search("[cdeghkmnrt]li$", word)):
            word = word[:-1] if ending == "ogi" else word[:-2]
    ending = _longest(word, (*STEP_3, "ative"))
    if ending and len(word) - len(ending) >= (r2 if ending == "ative" else r1):
        word = word[: -len(ending)] + STEP_3.get(ending, "")
    ending = _longest(word, (*STEP_4, "ion"))
    if ending and len(word) - len(ending) >= r2 and (ending != "ion" or word[:-3].endswith(("s", "t"))):
        word = word[: -len(ending)]
    if word.endswith("e") and (len(word) - 1 >= r2 or (len(word) - 1 >= r1 and not _short(word[:-1]))):
        word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.lower()


def fold(text: str) -> str:
    """Lower case without accents, compatible forms taken apart."""
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))


_STOP = frozenset(CONTENT_STOPWORDS)
WORDS = T.ArrayType(T.StringType())


def _stems_of(text: str | None) -> list[str]:
    return [stem(w) for w in re.findall("[a-z]+", fold(text or "")) if w not in _STOP]


@F.pandas_udf(WORDS)
def _content_stems(text: pd.Series) -> pd.Series:
    return text.map(_stems_of)


@F.pandas_udf(T.DoubleType())
def _overlap(query: pd.Series, document: pd.Series) -> pd.Series:
    def share(q: str | None, d: str | None) -> float:
        asked, has = _stems_of(q), set(_stems_of(d))
        return round(sum(s in has for s in asked) / len(asked), 3) if asked else 0.0

    return pd.Series([share(q, d) for q, d in zip(query, document)], dtype=float)


@F.pandas_udf(T.StringType())
def _folded(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else fold(t))


@F.pandas_udf(WORDS)
def _taken_apart(lines: pd.Series) -> pd.Series:
    return lines.map(lambda ls: None if ls is None else [None if t is None else unicodedata.normalize("NFKD", t) for t in ls])


@F.pandas_udf(WORDS)
def _stems(words: pd.Series) -> pd.Series:
    return words.map(lambda ws: None if ws is None else [None if w is None else stem(w) for w in ws])


def content_stems(text: Column) -> Column:
    """Stems of the content words of a text, in order; none for null."""
    return _content_stems(text)


def word_overlap(query: Column, document: Column) -> Column:
    """Share of the stems of the query's content words (repeats counted) that the document has, rounded to 3 places; 0 for none."""
    return _overlap(query, document)


def folded(text: Column) -> Column:
    """fold() of a column; null stays null."""
    return _folded(text)


def taken_apart(lines: Column) -> Column:
    """Compatible forms of the lines of an array taken apart (NFKD)."""
    return _taken_apart(lines)


def stems(words: Column) -> Column:
    """The stem of each word of an array, as the stemming tokenizer of an index makes them (stopwords stay)."""
    return _stems(words)
