"""Custom words: merge, match longest first, exempt."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.detect import Rule


def merged(existing: DataFrame, picked: DataFrame, most: int = 500) -> DataFrame:
    """(category, word) of both, each word once per category, existing first, at most `most` per category; state is kept, added, duplicate or overflow."""
    both = existing.select("category", "word", F.lit(0).alias("new")).unionByName(picked.select("category", "word", F.lit(1).alias("new")))
    same = F.row_number().over(Window.partitionBy("category", "word").orderBy("new"))
    one = both.withColumn("same", same)
    nth = F.sum((F.col("same") == 1).cast("int")).over(Window.partitionBy("category").orderBy("new", "word").rowsBetween(Window.unboundedPreceding, 0))
    state = F.when(F.col("same") > 1, "duplicate").when(nth > most, "overflow").when(F.col("new") == 1, "added").otherwise("kept")
    return one.select("category", "word", "new", state.alias("state"))


def nested_quantifier(pattern: str) -> bool:
    """A repeated group that itself repeats without bound."""
    return bool(re.search(r"\((?:[^()\\]|\\.)*[+*](?:[^()\\]|\\.)*\)\s*(?:[+*]|\{\d+,\d*\})", pattern))


def valid_pattern(pattern: str) -> str | None:
    """None if a user's regular expression may be used, else the reason why not."""
    if not pattern or len(pattern) > 300:
        return "length"
    if nested_quantifier(pattern):
        return "nested quantifier"
    try:
        re.compile(pattern)
    except re.error:
        return "syntax"
    return None


def _quoted(word: str) -> str:
    return re.sub(r"([\\.^$|?*+()\[\]{}-])", r"\\\1", word)


def alternation(words: list[tuple[str, bool]]) -> str:
    """One pattern for (word, whole) pairs, longest first, any case; `re:` words as given, bad ones left out.

    Single characters and whole words need ASCII word edges; words that begin or end with another
    script are plain substrings there.
    """
    parts = []
    for word, whole in sorted(set(words), key=lambda w: (-len(w[0]), w[0])):
        if word.startswith("re:"):
            if valid_pattern(word[3:]) is None:
                parts.append(f"(?:{word[3:]})")
            continue
        edge = whole or len(word) == 1
        head = r"(?<![A-Za-z0-9_])" if edge and re.match(r"[A-Za-z0-9_]", word[0]) else ""
        tail = r"(?![A-Za-z0-9_])" if edge and re.match(r"[A-Za-z0-9_]", word[-1]) else ""
        parts.append(head + _quoted(word) + tail)
    return "(?iu:" + "|".join(parts) + ")" if parts else "(?!)"


def rule(category: str, words: list[tuple[str, bool]]) -> Rule:
    """A rule for detect() and mask() before all others: words of a category; spellings that differ by case share a placeholder."""
    return Rule(category, f"(?:{alternation(words)})", fold=True)


def matches(text: Column, words: list[tuple[str, bool]]) -> Column:
    """array<string> of dictionary words found, as they stand in the text."""
    return F.regexp_extract_all(text, F.lit(alternation(words)), F.lit(0))


def word_hits(docs: DataFrame, words: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, word, n) by an equi-join of single tokens: for dictionaries of any size. words: word (lower case, no spaces)."""
    tokens = docs.select(id_column, F.explode(F.split(F.lower(text), r"[^\p{L}\p{N}_@.+-]+")).alias("word"))
    clean = tokens.select(id_column, F.regexp_replace("word", r"^[.+-]+|[.+-]+$", "").alias("word"))
    counted = clean.groupBy(id_column, "word").agg(F.count("*").alias("n"))
    return counted.join(words.select("word").distinct(), "word").select(id_column, "word", "n")
