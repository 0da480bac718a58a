"""The suffix stripper of M. F. Porter, "An algorithm for suffix stripping", 1980, as Arrow functions over distinct words of a table or over the words of texts."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this module

# fixed values: the suffixes of the paper's steps 2, 3 and 4 and what stands in for them
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al",
    "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al",
    "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = [
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti",
    "ous", "ive", "ize",
]


def _shape(word: str) -> str:
    """v or c for each letter; y is a vowel after a consonant."""
    out = ""
    for ch in word:
        vowel = ch in "aeiou" or (ch == "y" and out.endswith("c"))
        out += "v" if vowel else "c"
    return out


def _measure(word: str) -> int:
    return _shape(word).count("vc")


def _short(word: str) -> bool:
    """Ends consonant, vowel, consonant, the last not w, x or y."""
    return _shape(word).endswith("cvc") and word[-1] not in "wxy"


def _twin(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _swap(word: str, suffixes: dict[str, str], fits: Callable[[str, str], bool]) -> str:
    """The longest suffix that the word has, swapped if what stands before it fits."""
    has = [s for s in suffixes if word.endswith(s)]
    if not has:
        return word
    suffix = max(has, key=len)
    root = word[: len(word) - len(suffix)]
    return root + suffixes[suffix] if fits(root, suffix) else word


def _past(word: str) -> str:
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    for suffix in ("ed", "ing"):
        root = word[: -len(suffix)]
        if word.endswith(suffix):
            if "v" not in _shape(root):
                return word
            if root.endswith(("at", "bl", "iz")) or (_measure(root) == 1 and _short(root)):
                return root + "e"
            return root[:-1] if _twin(root) and root[-1] not in "lsz" else root
    return word


def porter(word: str) -> str:
    """The stem of a lower-case word; words of up to two letters and words with other characters than a-z stay."""
    if len(word) < 3 or not (word.isascii() and word.isalpha()):
        return word
    word = _swap(word, {"sses": "ss", "ies": "i", "ss": "ss", "s": ""}, lambda root, s: True)
    word = _past(word)
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _swap(word, STEP_2, lambda root, s: _measure(root) > 0)
    word = _swap(word, STEP_3, lambda root, s: _measure(root) > 0)
    word = _swap(word, dict.fromkeys(STEP_4, ""), lambda root, s: _measure(root) > 1 and (s != "ion" or root.endswith(("s", "t"))))
    if word.endswith("e") and (_measure(word[:-1]) > 1 or (_measure(word[:-1]) == 1 and not _short(word[:-1]))):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word


@F.pandas_udf(StringType())
def _stems(words: pd.Series) -> pd.Series:
    return words.map(porter, na_action="ignore")


def stemmed(df: DataFrame, term: str) -> DataFrame:
    """df with its words replaced by their stems: each distinct word is stemmed once and joined back; null words stay."""
    words = df.select(term).where(F.col(term).isNotNull()).distinct().withColumn("__stem", _stems(term))
    return df.join(words, term, "left").withColumn(term, F.col("__stem")).drop("__stem")


def stem(word: Column) -> Column:
    """The stem of each row's word, for small tables such as queries."""
    return _stems(word)


#: Stems that a task remembers, at most.
KNOWN = 500_000


@F.arrow_udf(ArrayType(StringType()))
def _stem_lists(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    known: dict[str, str] = {}
    for lists in batches:
        words = lists.flatten().dictionary_encode()
        if len(known) > KNOWN:
            known.clear()
        distinct = words.dictionary.to_pylist()
        known.update({w: porter(w) for w in distinct if w not in known})
        stems = pa.array([known[w] for w in distinct], pa.string()).take(words.indices)
        sizes = lists.value_lengths().fill_null(0).to_numpy()
        offsets = pa.array([0, *sizes.cumsum().tolist()], pa.int32())
        yield pa.ListArray.from_arrays(offsets, stems, mask=lists.is_null() if lists.null_count else None)


def stems(words: Column) -> Column:
    """The stems of each row's words (an array), where the rows are: a word is stemmed once a batch at most."""
    return _stem_lists(words)
