"""English lexemes: stop words go, and words are cut to their stems.

The stemmer follows the published rules of Snowball English (Porter2). It runs in
Arrow batches over *distinct* terms only: ``lexicon`` gives a table (term, lexeme)
that is joined back by term, so its cost follows the vocabulary and not the corpus;
``lexemes`` turns lists of terms into lists of lexemes where they are, for whole texts.
Stop words have a null lexeme; terms with other characters than a to z are their
own lexeme.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The stop words of the English text-search configuration, the word
# exceptions and the suffix tables of the published algorithm.
STOP_WORDS = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself
    they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having
    do does did doing a an the and but if or because as until while of at by for with about against between into through during before
    after above below to from up down in out on off over under again further then once here there when where why how all any both each
    few more most other some such no nor not only own same so than too very s t can will just don should now""".split()
)
WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    **{w: w for w in "sky news howe atlas cosmos bias andes".split()},
}
AFTER_PLURAL = frozenset("inning outing canning herring earring proceed exceed succeed".split())
SECOND = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al",
    "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less",
}
THIRD = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
FOURTH = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize".split()

_VOWEL = "[aeiouy]"
_REGION = re.compile(rf"{_VOWEL}[^aeiouy]")  # Y, the consonant, is upper case
_EARLY = re.compile("gener|commun|arsen")
_SHORT_END = re.compile(rf"(?:[^aeiouy]{_VOWEL}[^aeiouywxY]|^{_VOWEL}[^aeiouy])$")
_WORD = re.compile("[a-z]{3,}")


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def _plural(word: str) -> str:
    if word.endswith("sses"):
        return word[:-2]
    if word.endswith(("ied", "ies")):
        return word[:-2] if len(word) > 4 else word[:-1]
    if word.endswith("s") and not word.endswith(("us", "ss")) and re.search(_VOWEL, word[:-2]):
        return word[:-1]
    return word


def _past(word: str, first: int) -> str:
    suffix = _longest(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if suffix is None:
        return word
    body = word[: -len(suffix)]
    if suffix in ("eed", "eedly"):
        return body + "ee" if len(body) >= first else word
    if not re.search(_VOWEL, body):
        return word
    if body.endswith(("at", "bl", "iz")):
        return body + "e"
    if re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", body):
        return body[:-1]
    return body + "e" if len(body) <= first and _SHORT_END.search(body) else body


def _derived(word: str, first: int, second: int) -> str:
    suffix = _longest(word, [*SECOND, "ogi", "li"])
    if suffix and len(word) - len(suffix) >= first:
        body = word[: -len(suffix)]
        if suffix == "ogi":
            word = body + "og" if body.endswith("l") else word
        elif suffix == "li":
            word = body if body[-1:] and body[-1] in "cdeghkmnrt" else word
        else:
            word = body + SECOND[suffix]
    suffix = _longest(word, [*THIRD, "ative"])
    if suffix and len(word) - len(suffix) >= first:
        body = word[: -len(suffix)]
        if suffix != "ative":
            word = body + THIRD[suffix]
        elif len(body) >= second:
            word = body
    suffix = _longest(word, [*FOURTH, "ion"])
    if suffix and len(word) - len(suffix) >= second and (suffix != "ion" or word[-4:-3] in ("s", "t")):
        word = word[: -len(suffix)]
    return word


def stem(word: str) -> str:
    """The stem of a lower-case word of letters a to z; anything else comes back as it is."""
    if word in WHOLE:
        return WHOLE[word]
    if not _WORD.fullmatch(word):
        return word
    word = re.sub(rf"(^|(?<={_VOWEL}))y", "Y", word)
    early = _EARLY.match(word)
    head = early or _REGION.search(word)
    first = head.end() if head else len(word)
    tail = _REGION.search(word, first)
    second = tail.end() if tail else len(word)

    word = _plural(word)
    if word in AFTER_PLURAL:
        return word
    word = _past(word, first)
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in "aeiouy":
        word = word[:-1] + "i"
    word = _derived(word, first, second)
    if word.endswith("e") and (len(word) > second or (len(word) > first and not _SHORT_END.search(word[:-1]))):
        word = word[:-1]
    elif word.endswith("ll") and len(word) > second:
        word = word[:-1]
    return word.lower()


_KEPT = 1 << 18  #: stems that a worker remembers


@functools.lru_cache(_KEPT)
def _lexeme(term: str) -> str | None:
    return None if term in STOP_WORDS else stem(term)


@F.arrow_udf(T.ArrayType(T.StringType()))
def lexemes(terms: pa.Array) -> pa.Array:
    """A list of terms as their lexemes, in order; stop words are null. Each distinct
    term of a batch is looked up once."""
    flat = terms.flatten()
    words = flat.dictionary_encode()
    known = pa.array([None if t is None else _lexeme(t) for t in words.dictionary.to_pylist()], pa.string())
    begin = pa.concat_arrays([pa.array([0], pa.int64()), pc.cumulative_sum(terms.value_lengths().cast(pa.int64()).fill_null(0))]).cast(pa.int32())
    return pa.ListArray.from_arrays(begin, known.take(words.indices), mask=terms.is_null())


def _lexemes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield b.assign(lexeme=[None if t in STOP_WORDS else stem(t) for t in b["term"]])


def lexicon(terms: DataFrame, term: str = "term") -> DataFrame:
    """(term, lexeme) of the distinct terms of a column; null terms have no row."""
    distinct = terms.select(F.col(term).cast("string").alias("term")).filter("term is not null").distinct()
    return distinct.mapInPandas(_lexemes, "term string, lexeme string")
