"""Running text out of the positioned words of printed pages.

A document is a text of tab-separated lines: word, x, y, width, height, font, height of the
page, number of the page. Repeated heads and feet go, words broken by a hyphen are joined.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

#: The share of a page at either end that holds heads and feet; how far a line's words may
#: lie apart; on how many pages a head has to stand.
BAND, LINE, REPEATS = 0.09, 4, 2
FIELDS = 8


def dehyphenated(text: Column) -> Column:
    """Join ``word- rest`` where the rest begins in lower case; a lone hyphen stays."""
    return F.regexp_replace(text, r"(?<=\S)- (?=\p{Ll})", "")


def _heading(text: str) -> str:
    """What makes two heads alike: letters without accents or case, no numbers."""
    bare = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))
    return " ".join(re.findall("[a-z]+", bare))


def body_text(content: str) -> str:
    """The text of one document without heads and feet, words joined by one space."""
    split = [f for f in (line.split("\t") for line in content.splitlines()) if len(f) == FIELDS and f[0]]
    if not split:
        return ""
    words = pd.DataFrame({"word": [f[0] for f in split], "y": [int(f[2]) for f in split], "height": [int(f[6]) for f in split], "page": [int(f[7]) for f in split]})
    # a line ends where the page turns or a word stands too far from the line's first one
    number, first, lines = -1, None, []
    for at in zip(words["page"], words["y"], strict=True):
        if first is None or at[0] != first[0] or abs(at[1] - first[1]) > LINE:
            first, number = at, number + 1
        lines.append(number)
    whole = words.groupby(lines).agg(text=("word", " ".join), y=("y", "first"), height=("height", "first"), page=("page", "first"))
    outside = (whole["y"] <= whole["height"] * BAND) | (whole["y"] >= whole["height"] * (1 - BAND))
    heads = whole[outside].assign(heading=lambda h: h["text"].map(_heading))
    pages = heads.groupby("heading")["page"].transform("nunique")
    gone = heads.index[(heads["heading"] == "") | (pages >= REPEATS)]
    return " ".join(whole["text"].drop(gone))


def clean_pages(docs: DataFrame, content: str = "content", out: str = "text") -> DataFrame:
    """``docs`` with the running text of each document; null stays null, no word gives ''."""

    @F.pandas_udf("string")
    def body(column: pd.Series) -> pd.Series:
        return column.map(body_text, na_action="ignore")

    return docs.withColumn(out, dehyphenated(body(F.col(content))))
