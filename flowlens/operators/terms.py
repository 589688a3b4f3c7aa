"""The most frequent terms of one to three words, without counting the rare ones.

No term is more frequent than a part of it. The word that would be the last of the wished number, were there only words,
says how often a term has to occur; pairs are counted only of words that do, and triples only of pairs that do.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import checkpointed, give_back

#: Words of texts that are counted together.
AT_ONCE = 1 << 20


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Words of some texts, and the text of each word."""
    for batch in batches:
        words = batch.column(0)
        ends = np.cumsum(pc.fill_null(pc.list_value_length(words), 0).to_numpy())
        first = 0
        while first < len(words):
            end = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + AT_ONCE, "right")))
            sizes = np.diff(ends[first:end], prepend=ends[first - 1] if first else 0)
            yield words.slice(first, end - first).flatten(), np.repeat(np.arange(end - first), sizes)
            give_back()
            first = end


def counted(keys: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each key, how often it is there and in how many texts; the texts are in order."""
    order = np.argsort(keys, kind="stable")
    keys, of = keys[order], of[order]
    new = np.append(True, keys[1:] != keys[:-1])[: len(keys)]
    other = new | np.append(True, of[1:] != of[:-1])[: len(keys)]
    first = np.flatnonzero(new)
    return keys[first], np.diff(np.append(first, len(keys))), np.add.reduceat(other.astype(np.int64), first) if len(first) else first


def frequent(tokens: DataFrame, most: int, least_df: float, most_df: float, column: str = "_kept") -> list[tuple[str, int]]:
    """Terms and the number of texts they are in, the most frequent first (of equal ones by name): at most `most` of those in
    least_df to most_df texts. tokens: an array of words a text."""
    source = tokens.select(column)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for flat, of in parts(batches):
            coded = flat.dictionary_encode()
            keys, n, df = counted(coded.indices.to_numpy(), of)
            yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(keys)).cast(pa.string()), pa.array(n, pa.int64()), pa.array(df, pa.int64())], ["key", "n", "df"])

    def summed(run: Callable, kind: str, least: int) -> DataFrame:
        return source.mapInArrow(run, f"key {kind}, n long, df long").groupBy("key").agg(F.sum("n").alias("n"), F.sum("df").alias("df")).where(F.col("n") >= least)

    single = checkpointed(summed(words, "string", 1))
    fits = F.col("df").between(least_df, most_df)
    best = single.where(fits).orderBy(F.desc("n"), "key").limit(most).collect()
    least = max(1, int(np.ceil(least_df)), best[-1]["n"] if len(best) == most else 1)
    known = [(r["key"], r["n"], r["df"]) for r in single.where(F.col("n") >= least).collect()]  # about as many as are asked for
    names = pa.array([k for k, _, _ in known], pa.string())
    width = np.int64(len(known) or 1)

    def coded(flat: pa.Array) -> np.ndarray:
        return pc.fill_null(pc.index_in(flat, value_set=names), -1).to_numpy().astype(np.int64)

    def pairs_of(word: np.ndarray, of: np.ndarray) -> np.ndarray:
        """The pair that starts at each word, -1 for none."""
        good = (word[:-1] >= 0) & (word[1:] >= 0) & (of[:-1] == of[1:])
        return np.where(good, word[:-1] * width + word[1:], -1)

    def as_rows(keys: np.ndarray, of: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in counted(keys, of)], ["key", "n", "df"])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for flat, of in parts(batches):
            pair = pairs_of(coded(flat), of)
            at = np.flatnonzero(pair >= 0)
            yield as_rows(pair[at], of[at])

    double = sorted((r["key"], r["n"], r["df"]) for r in summed(pairs, "long", least).collect())
    kept = np.array([k for k, _, _ in double], np.int64)

    def triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for flat, of in parts(batches):
            word = coded(flat)
            pair = pairs_of(word, of)
            place = np.minimum(np.searchsorted(kept, pair), len(kept) - 1)
            good = kept[place] == pair
            at = np.flatnonzero(good[:-1] & good[1:])
            yield as_rows(place[at] * width + word[at + 2], of[at])

    treble = [(r["key"], r["n"], r["df"]) for r in summed(triples, "long", least).collect()] if double else []
    name = lambda key: f"{known[key // int(width)][0]} {known[key % int(width)][0]}"
    found = [*known, *((name(k), n, df) for k, n, df in double)]
    found += [(f"{name(double[k // int(width)][0])} {known[k % int(width)][0]}", n, df) for k, n, df in treble]
    return [(term, df) for term, n, df in sorted(found, key=lambda x: (-x[1], x[0])) if least_df <= df <= most_df][:most]
