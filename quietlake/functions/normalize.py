"""A view of texts for detection only: NFKC and without zero-width characters, with offsets back to the original."""

from __future__ import annotations

import unicodedata

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import detect as D
from .text import let, spliced

#: Zero-width and joining controls that hide inside values.
INVISIBLE = frozenset("​‌‍⁠﻿­᠎")


def view(text: str | None) -> dict | None:
    """view, and for each of its characters the start and stop of its source; null map if nothing changed."""
    if text is None:
        return None
    if text.isascii():
        return {"view": text, "starts": None, "stops": None}
    out, starts, stops = [], [], []
    at, n = 0, len(text)
    while at < n:
        end = at + 1
        while end < n and unicodedata.combining(text[end]):
            end += 1
        if text[at] not in INVISIBLE:
            for c in unicodedata.normalize("NFKC", text[at:end]):
                if c not in INVISIBLE:
                    out.append(c), starts.append(at), stops.append(end)
        at = end
    new = "".join(out)
    return {"view": new, "starts": None if new == text else starts, "stops": None if new == text else stops}


def _views(texts: pd.Series) -> pd.DataFrame:
    rows = [view(t) or {"view": None, "starts": None, "stops": None} for t in texts]
    return pd.DataFrame(rows, columns=["view", "starts", "stops"])


def nfkc_view(text: Column) -> Column:
    """struct(view, starts, stops) of each text."""
    return F.pandas_udf(_views, "view string, starts array<int>, stops array<int>", F.PandasUDFType.SCALAR)(text)


def detect(text: Column, chosen: D.Chosen = None) -> Column:
    """As detect.detect(), but values are also found in full width or with invisible characters in them; offsets and values are those of the original text."""

    def back(v: Column) -> Column:
        def one(s: Column) -> Column:
            start, stop = F.get(v["starts"], s["start"]), F.get(v["stops"], s["stop"] - 1)
            return F.struct(start.alias("start"), stop.alias("stop"), s["label"].alias("label"), F.substr(text, start + 1, stop - start).alias("value"))

        found = D.detect(v["view"], chosen)
        return F.when(v["starts"].isNull(), found).otherwise(F.transform(found, one))

    return let(nfkc_view(text), back)


def replaced(text: Column, token: Callable[[Column], Column], chosen: D.Chosen = None) -> Column:
    """text with the values that detect() finds replaced by token(span); all other characters stay as they are."""
    return F.when(text.isNotNull(), spliced(text, detect(text, chosen), token))
