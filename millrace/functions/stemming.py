"""English word stems (Porter 1980) for arrays of tokens.

Each Arrow batch is reduced to its distinct words before any Python runs, and a
worker remembers the words it has seen, so the cost follows the vocabulary and
no token is shuffled.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the published algorithm: suffixes and their replacements.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able",
    "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate",
    "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive",
    "biliti": "ble",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = (
    "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()
)  # "ion" only after s or t

_VOWEL_GROUP = re.compile("v+c+")


def _shape(word: str) -> str:
    """One letter per character: v for vowels (y after a consonant), c otherwise."""
    out = []
    for i, ch in enumerate(word):
        vowel = ch in "aeiou" or (ch == "y" and i > 0 and out[-1] == "c")
        out.append("v" if vowel else "c")
    return "".join(out)


def _measure(stem: str) -> int:
    return len(_VOWEL_GROUP.findall(_shape(stem)))


def _ends_cvc(word: str) -> bool:
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _double_consonant(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def _plural_and_past(word: str) -> str:
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    ending = _longest(word, ("ed", "ing"))
    if ending and "v" in _shape(word[: -len(ending)]):
        word = word[: -len(ending)]
        if word.endswith(("at", "bl", "iz")):
            return word + "e"
        if _double_consonant(word) and word[-1] not in "lsz":
            return word[:-1]
        if _measure(word) == 1 and _ends_cvc(word):
            return word + "e"
    return word


@lru_cache(maxsize=1 << 18)
def porter_stem(word: str) -> str:
    if len(word) <= 2:
        return word
    word = _plural_and_past(word)
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for table in (STEP_2, STEP_3):
        s = _longest(word, table)
        if s and _measure(word[: -len(s)]) > 0:
            word = word[: -len(s)] + table[s]
    s = _longest(word, STEP_4)
    if s:
        stem = word[: -len(s)]
        if _measure(stem) > 1 and (s != "ion" or stem.endswith(("s", "t"))):
            word = stem
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or (m == 1 and not _ends_cvc(word[:-1])):
            word = word[:-1]
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


@F.arrow_udf(T.ArrayType(T.StringType()))
def stem_tokens(words: pa.Array) -> pa.Array:
    """Stem every token of every row of a batch."""
    words = words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words
    coded = words.flatten().dictionary_encode()
    stems = pa.array([porter_stem(w) for w in coded.dictionary.to_pylist()], pa.string())
    # offsets of the flattened rows; NULL rows have no tokens and stay NULL
    lengths = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    ends = lengths.cumsum()
    offsets = pa.array([0, *ends.tolist()], pa.int32())
    return pa.ListArray.from_arrays(offsets, stems.take(coded.indices), mask=words.is_null())
