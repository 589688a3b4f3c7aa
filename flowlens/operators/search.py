"""Search of texts through a table of trigrams.

A pattern says which runs of characters every match holds, and so which trigrams. Only texts with all trigrams of one
of the pattern's alternatives are candidates, and only they meet the pattern itself; the result is that of a full scan.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chain import search_doc_text

#: Of the trigrams that a pattern asks for, the rarest few decide.
MOST = 4


def trigrams(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(trigram, key): each trigram of lower-case ASCII characters once a text. Texts without key or text have none."""
    every = F.array_distinct(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"(?=([\x00-\x7f]{3}))"), 1))
    return texts.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.explode(every).alias("trigram"), F.col(key).alias("key"))


def write_trigrams(texts: DataFrame, path: str, key: str, text: str = "text") -> None:
    """Store the table in the order of trigrams, so that a search reads few row groups."""
    made = trigrams(texts, key, text)
    made.repartitionByRange("trigram", "key").sortWithinPartitions("trigram", "key").write.mode("overwrite").parquet(path)


def _alternatives(pattern: str) -> list[str] | None:
    """The alternatives of a pattern at its top level; None if the brackets aren't understood."""
    out, depth, start, i, in_class = [], 0, 0, 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif in_class:
            in_class = c != "]"
        elif c == "[":
            in_class = True
            i += pattern[i + 1 : i + 2] in ("]", "^")
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
        elif c == "|" and not depth:
            out.append(pattern[start:i])
            start = i + 1
        i += 1
    return None if depth or in_class else [*out, pattern[start:]]


def literals(alternative: str) -> list[str]:
    """Runs of characters that every match holds: groups, classes, escapes and repeated characters end a run."""
    runs, now, depth, i = [], "", 0, 0

    def end() -> None:
        nonlocal now
        runs.append(now)
        now = ""

    while i < len(alternative):
        c = alternative[i]
        if c == "\\":
            escaped = alternative[i + 1 : i + 2]
            i += 1
            if escaped.isalnum() or not escaped:
                end()
                if escaped in ("Q", "E", "x", "u", "p", "P", "N", "c", "0", "k"):  # longer escapes: nothing behind them is sure
                    return runs
            elif not depth:
                now += escaped
        elif c == "[":
            end()
            close = i + 1 + (alternative[i + 1 : i + 2] in ("]", "^"))
            while close < len(alternative) and alternative[close] != "]":
                close += 2 if alternative[close] == "\\" else 1
            i = close
        elif c == "(":
            end()
            depth += 1
        elif c == ")":
            end()
            depth -= 1
        elif c in "*?{+":
            now = now[:-1]
            end()
            if c == "{":
                i = alternative.find("}", i) if "}" in alternative[i:] else len(alternative)
        elif c in ".^$":
            end()
        elif not depth:
            now += c
        i += 1
    end()
    return runs


def required(pattern: str) -> list[list[str]] | None:
    """For each alternative the trigrams that its matches hold; None if one of them asks for none, or flags are set inside."""
    parts = None if re.search(r"\(\?[a-zA-Z-]+[:)]", pattern) else _alternatives(pattern)
    if parts is None:
        return None
    out = []
    for part in parts:
        found = {run[i : i + 3].lower() for run in literals(part) for i in range(len(run) - 2)}
        found = sorted(t for t in found if t.isascii())
        if not found:
            return None
        out.append(found)
    return out


def candidates(index: DataFrame, pattern: str, most: int = MOST) -> DataFrame | None:
    """(key) of the texts that may match, or None where only a full scan tells."""
    wanted = required(pattern)
    if wanted is None:
        return None
    every = sorted({t for part in wanted for t in part})
    counts = {r["trigram"]: r["count"] for r in index.where(F.col("trigram").isin(every)).groupBy("trigram").count().collect()}  # a row for each trigram of the pattern
    found = []
    for part in wanted:
        rare = sorted(part, key=lambda t: (counts.get(t, 0), t))[:most]
        found.append(index.where(F.col("trigram").isin(rare)).groupBy("key").agg(F.countDistinct("trigram").alias("n")).where(F.col("n") == len(rare)).select("key"))
    return reduce(DataFrame.union, found).distinct()


def search_indexed(texts: DataFrame, index: DataFrame, pattern: str, key: str, text: str = "text", limit: int = 200, around: int = 50) -> DataFrame:
    """What search_doc_text gives, with the pattern tried on candidates only."""
    some = candidates(index, pattern)
    kept = texts if some is None else texts.join(some, F.col(key) == F.col("key"), "left_semi")
    return search_doc_text(kept, pattern, key, text, limit, around)


def search_cost(texts: DataFrame, index: DataFrame, pattern: str, key: str, text: str = "text", most: int = MOST) -> DataFrame:
    """How many texts there are, how many the index leaves, and how many match."""
    some = candidates(index, pattern, most)
    kept = texts if some is None else texts.join(some, F.col(key) == F.col("key"), "left_semi")
    tried = kept.agg(F.count("*").alias("n_candidates"), F.count_if(F.col(text).rlike(f"(?i){pattern}")).alias("n_matches"))
    return texts.agg(F.count("*").alias("n_texts")).crossJoin(F.broadcast(tried))
