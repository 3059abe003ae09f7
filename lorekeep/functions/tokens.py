"""Lexical analysis: tokens, per-document term counts, optional stemming."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from lorekeep.functions.text import bind


def _accent_table() -> tuple[str, str]:
    """Translate arguments that map accented Latin letters to their base letter.

    Built by rule from Unicode decomposition; combining marks come last and
    have no counterpart, so ``translate`` deletes them.
    """
    pairs = {}
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base = "".join(
            c for c in unicodedata.normalize("NFD", chr(code)) if not unicodedata.combining(c)
        )
        if len(base) == 1 and base.isascii():
            pairs[chr(code)] = base
    marks = "".join(chr(c) for c in range(0x300, 0x370))
    return "".join(pairs) + marks, "".join(pairs.values())


_ACCENTED, _PLAIN = _accent_table()


@dataclass(frozen=True)
class Tokenizer:
    """How text becomes terms.

    ``stopwords`` are removed before stemming; ``stem`` turns on the Porter
    stemmer. ``pattern`` separates tokens after lower-casing and accent removal.
    """

    stopwords: tuple[str, ...] = ()
    stem: bool = False
    pattern: str = "[^a-z]+"

    @staticmethod
    def english(extra_stopwords: tuple[str, ...] = ()) -> Tokenizer:
        """English stop words as shipped with Spark ML, plus the Porter stemmer."""
        from pyspark.ml.feature import StopWordsRemover

        words = StopWordsRemover.loadDefaultStopWords("english")
        parts = {p for w in words for p in re.split("[^a-z]+", w.lower()) if p}
        return Tokenizer(tuple(sorted(parts | set(extra_stopwords))), stem=True)

    def tokens(self, text: Column) -> Column:
        plain = F.translate(F.lower(text), _ACCENTED, _PLAIN)
        out = F.filter(F.split(plain, self.pattern), lambda t: t != "")
        if self.stopwords:
            out = F.filter(out, lambda t: ~t.isin(*self.stopwords))
        return stem_tokens(out) if self.stem else out


def term_counts(tokens: Column) -> Column:
    """``array<struct<term, tf>>`` of one token list.

    Sort, then measure run lengths: linear after the sort and entirely inside
    the row, so counting terms never shuffles the corpus.
    """

    def runs(ordered: Column) -> Column:
        total = F.size(ordered)
        first_of_run = F.filter(
            F.sequence(F.lit(0), total - 1),
            lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)),
        )
        counted = bind(
            first_of_run,
            lambda starts: F.transform(
                starts,
                lambda at, k: F.struct(
                    F.get(ordered, at).alias("term"),
                    (F.coalesce(F.get(starts, k + 1), total) - at).alias("tf"),
                ),
            ),
        )
        empty = F.array().cast("array<struct<term:string,tf:int>>")
        return F.when(total > 0, counted).otherwise(empty)

    return bind(F.sort_array(tokens), runs)


# ------------------------------------------------------------------ stemming
# The stemmer is Martin Porter's published algorithm (1980).

# Suffix tables of the published algorithm.
_STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize",
    "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive",
    "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
    "logi": "log",
}
_STEP3 = {
    "icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": "",
}
_STEP4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent",
    "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize",
)


def _shape(stem: str) -> str:
    """Consonant/vowel pattern; y is a vowel after a consonant."""
    out = ""
    for ch in stem:
        vowel = ch in "aeiou" or (ch == "y" and out[-1:] == "c")
        out += "v" if vowel else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c", re.sub("c+", "c", _shape(stem))))


def _ends_cvc(stem: str) -> bool:
    return _shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def _doubled(stem: str) -> bool:
    return len(stem) > 1 and stem[-1] == stem[-2] and _shape(stem)[-1] == "c"


def _longest(word: str, endings) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


@lru_cache(maxsize=200_000)
def porter_stem(word: str) -> str:
    if len(word) <= 2:
        return word
    ending = _longest(word, ("sses", "ies", "ss", "s"))
    if ending in ("sses", "ies"):
        word = word[:-2]
    elif ending == "s":
        word = word[:-1]

    ending = _longest(word, ("eed", "ed", "ing"))
    if ending == "eed":
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    elif ending and "v" in _shape(word[: -len(ending)]):
        word = word[: -len(ending)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif _doubled(word) and word[-1] not in "lsz":
            word = word[:-1]
        elif _measure(word) == 1 and _ends_cvc(word):
            word += "e"

    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"

    for table in (_STEP2, _STEP3):
        ending = _longest(word, table)
        if ending and _measure(word[: -len(ending)]) > 0:
            word = word[: -len(ending)] + table[ending]

    ending = _longest(word, _STEP4)
    if ending:
        stem = word[: -len(ending)]
        if _measure(stem) > 1 and (ending != "ion" or stem[-1:] in ("s", "t")):
            word = stem

    if word.endswith("e"):
        stem, m = word[:-1], _measure(word[:-1])
        if m > 1 or (m == 1 and not _ends_cvc(stem)):
            word = stem
    if _measure(word) > 1 and _doubled(word) and word[-1] == "l":
        word = word[:-1]
    return word


@F.arrow_udf(ArrayType(StringType()))
def stem_tokens(tokens: pa.Array) -> pa.Array:
    """Stem every token; each distinct word of the batch is stemmed once."""
    coded = tokens.flatten().dictionary_encode()
    stems = pa.array([porter_stem(w) for w in coded.dictionary.to_pylist()], pa.string())
    lengths = pc.fill_null(pc.list_value_length(tokens), 0)
    offsets = pa.concat_arrays([pa.array([0], pa.int32()), pc.cumulative_sum(lengths).cast(pa.int32())])
    return pa.ListArray.from_arrays(offsets, stems.take(coded.indices), mask=tokens.is_null())
