"""Repair of mis-encoded text, which needs strict codecs, as a pandas function over the rows that need it."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .lexicons import COMMON_ENGLISH, COMMON_RUSSIAN, MISREAD_MARKERS
from .text import misread, squeeze, tidy, tokens

COMMON = frozenset(COMMON_RUSSIAN + COMMON_ENGLISH)
CODECS = ("latin1", "cp1251", "cp1252")
# Weights of common words, letters, words (up to 10), closing punctuation and markers.
WEIGHTS = (3.0, 1.4, 0.24, 0.1, -2.7)


def plausibility(text: str) -> float:
    """How much a text looks like language, by WEIGHTS."""
    words = re.findall(r"[A-Za-zЀ-ӿ0-9']+", text.lower())
    measures = (sum(w in COMMON for w in words), sum(map(str.isalpha, text)) / max(1, len(text)), min(len(words), 10), text.endswith((".", "!", "?")), sum(map(text.count, MISREAD_MARKERS)))
    return sum(w * m for w, m in zip(WEIGHTS, measures, strict=True)) if text else -999.0


def read_again(text: str) -> str:
    """The most plausible of a text and its bytes in each codec read as UTF-8."""
    found = [text]
    for codec in CODECS:
        try:
            found.append(text.encode(codec).decode("utf-8"))
        except UnicodeError:
            continue
    return max(found, key=plausibility)


def repaired(text: Column) -> Column:
    """Squeezed, composed text, repaired where it looks misread; only texts beyond ASCII reach Python."""

    @F.pandas_udf(StringType())
    def repair(values: pd.Series, broken: pd.Series) -> pd.Series:
        composed = values.str.normalize("NFC")
        return composed.where(~broken.fillna(False).astype(bool), composed.map(lambda v: read_again(v) if v else v))

    bare = squeeze(text)  # not bound: a function's arguments can't hold variables of lambdas in one another
    return F.coalesce(repair(F.when(bare.rlike(r"[^\x00-\x7f]"), bare), misread(bare, tokens(bare))), bare)


def cleaned(text: Column) -> Column:
    """tidy() text, repaired where it looks misread."""
    return repaired(tidy(text))
