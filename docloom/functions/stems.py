"""Porter's suffix-stripping algorithm (1980) over Arrow columns: each different word of a batch is stemmed once."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\w+|[^\w\s]+")
# Fixed values of the algorithm: suffixes of steps 2, 3 and 4, and what they become.
_STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize",
    "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
_STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _shape(word: str) -> str:
    """``c`` or ``v`` for each letter; a ``y`` is a vowel behind a consonant."""
    out = ""
    for letter in word:
        out += "v" if letter in "aeiou" or letter == "y" and out.endswith("c") else "c"
    return out


def _measure(word: str) -> int:
    """How often vowels are followed by consonants."""
    return len(re.findall("v+c+", _shape(word)))


def _short(word: str) -> bool:
    """Ends in consonant, vowel, consonant, the last none of w, x, y."""
    return _shape(word).endswith("cvc") and word[-1] not in "wxy"


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _swapped(word: str, rules: dict[str, str], least: int) -> str:
    """The longest suffix of ``rules`` is replaced if what is before it measures ``least``."""
    for suffix in sorted(rules, key=len, reverse=True):
        if word.endswith(suffix):
            before = word[: -len(suffix)]
            return before + rules[suffix] if _measure(before) >= least else word
    return word


@lru_cache(1 << 16)
def stem(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters are their own."""
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word
    # Plurals.
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    # Past and continuous forms.
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) else word
    else:
        for suffix in ("ed", "ing"):
            if word.endswith(suffix) and "v" in _shape(word[: -len(suffix)]):
                word = word[: -len(suffix)]
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif _double(word) and word[-1] not in "lsz":
                    word = word[:-1]
                elif _measure(word) == 1 and _short(word):
                    word += "e"
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    # Derived forms.
    word = _swapped(_swapped(word, _STEP_2, 1), _STEP_3, 1)
    for suffix in sorted(_STEP_4, key=len, reverse=True):
        if word.endswith(suffix):
            before = word[: -len(suffix)]
            if _measure(before) > 1 and (suffix != "ion" or before.endswith(("s", "t"))):
                word = before
            break
    # A last e, a double l.
    if word.endswith("e") and (_measure(word[:-1]) > 1 or _measure(word[:-1]) == 1 and not _short(word[:-1])):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word


#: Bytes of texts whose words are held at once, unless one text has more.
BYTES = 1 << 20


def stemmed(texts: pa.Array) -> pa.Array:
    """Lower-case tokens of each text, stemmed, with spaces between them; null texts stay null. Some texts at a time, so words take little memory whatever a batch holds."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    out, at = [], 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BYTES, "right")))
        out.append(_stemmed(texts.slice(at, to - at)))
        at = to
    return pa.concat_arrays(out) if out else pa.array([], pa.string())


def _stemmed(texts: pa.Array) -> pa.Array:
    words, counts = [], []
    for t in texts:
        found = _TOKEN.findall(t.as_py().strip().lower()) if t.is_valid else []
        words += found
        counts.append(len(found))
    coded = pa.array(words, pa.string()).dictionary_encode()
    stems = [stem(w) for w in coded.dictionary.to_pylist()]
    at, numbers, out = 0, coded.indices.to_pylist(), []
    for t, n in zip(texts, counts, strict=True):
        out.append(" ".join(stems[i] for i in numbers[at : at + n]) if t.is_valid else None)
        at += n
    return pa.array(out, pa.string())


def normalize_stem(c: Column) -> Column:
    """The text's words and marks in lower case, each word as its stem."""

    @F.arrow_udf("string")
    def of(texts: pa.Array) -> pa.Array:
        return stemmed(texts)

    return of(c)


def fuzzy_match(a: Column, b: Column) -> Column:
    """The edit distance of two texts whose words are stems; null if one of them is."""
    return F.levenshtein(normalize_stem(a), normalize_stem(b))
