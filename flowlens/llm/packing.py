"""Packing of token sequences: shortest pack first over the histogram of lengths.

Documents longer than a sequence are cut into full pieces and a rest. Lengths are placed longest
first: each goes to the open pattern with the fewest tokens, or opens a new one, and the counts of
patterns are updated as a whole, so the work depends on the number of lengths alone. Patterns are then
joined back to pieces by the rank of a piece among those of its length.

Defined results: null and empty texts hold the end token alone; repeated rows are packed one by one;
an empty table gives no pieces; a document of any length is cut, none of its tokens is lost.
"""

from __future__ import annotations

import re
import zlib
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, materialise, slices, tidy, whole_text

#: Fixed value: the characters that Unicode calls white space.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
WORD = re.compile(rf"[^{SPACE}]+")
#: Characters that str.split() takes for white space and Unicode doesn't.
ODD = re.compile("[\x1c-\x1f]")
#: Entries of each half of a worker's caches of words and of runs.
CACHE, RUN_CACHE = 500_000, 400_000


class Recent:
    """A bounded map: the older half goes when it is full, which costs time only."""

    def __init__(self, most: int = CACHE):
        self.most, self.new, self.old = most, {}, {}

    def put(self, key: str, value: bytes) -> bytes:
        if len(self.new) >= self.most:
            self.old, self.new = self.new, {}
        self.new[key] = value
        return value

    def get(self, key: str) -> bytes | None:
        found = self.new.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found


class WordTokens:
    """Ids of texts by a tokenizer that never joins characters across white space: words, and within them the
    runs that the tokenizer encodes separately, are encoded once and kept."""

    #: Fixed value: the tokenizer's own runs.
    RUNS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # strings of special tokens in a text are these tokens, as the library has it
        special = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(special) or "(?!)")
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.words, self.runs = Recent(), Recent(RUN_CACHE)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _encode_runs(self, runs: list[str]) -> list[bytes]:
        """Each run ends in a token that closes a word, so many are encoded as one text and parted there."""
        ids = np.array(self.tokenizer.encode(" ".join(runs), add_special_tokens=False).ids, "<u4")
        ends = np.flatnonzero(self.closes[ids]) + 1
        if len(ends) != len(runs):
            return [self._whole(run) for run in runs]
        data, begin = ids.tobytes(), 0
        out = []
        for end in (4 * ends).tolist():
            out.append(data[begin:end])
            begin = end
        return out

    def learn(self, words: list[str], whole: bool) -> dict[str, bytes]:
        """Ids of words that aren't kept. Beyond Latin-1, and in texts with special tokens, the tokenizer sees the whole word."""
        parted = {}
        for w in [] if whole else words:
            if w.isascii() or max(w) <= "\xff":
                low = w.lower()
                parted[w] = [low] if low.isalpha() else [low[:-1], low[-1]] if low[-1] in ".," and low[:-1].isalpha() else self.RUNS.findall(low)
        ids = {run: self.runs.get(run) for run in {run for runs in parted.values() for run in runs}}
        new = [run for run, own in ids.items() if own is None]
        for first in range(0, len(new), 200):
            some = new[first : first + 200]
            ids.update(zip(some, self._encode_runs(some), strict=True))
        for run in new:
            if len(run) < 64:
                self.runs.put(run, ids[run])
        return {w: b"".join([ids[run] for run in parted[w]]) if w in parted else self._whole(w) for w in words}

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        words = WORD.findall(text) if ODD.search(text) else text.split()
        whole = bool(self.special.search(text))
        out = []
        for first in range(0, len(words), 20_000):
            some = words[first : first + 20_000]
            ids = list(map(self.words.new.get, some))
            if None in ids:
                missing = {w: self.words.get(w) for w, i in zip(some, ids, strict=True) if i is None}
                learned = self.learn([w for w, i in missing.items() if i is None], whole)
                for w, i in learned.items():
                    if len(w) < 64:
                        self.words.put(w, i)
                missing |= learned
                ids = [missing[w] if i is None else i for w, i in zip(some, ids, strict=True)]
            out += ids
        return b"".join(out)


def load(path: str) -> WordTokens:
    return keep(path, lambda: WordTokens(path))


def pieces(df: DataFrame, path: str, end_id: int, most: int = 4096) -> DataFrame:
    """Pieces of at most `most` tokens: doc_id, start, length, ids_crc32, doc_tokens."""
    kind = dict(df.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, end, width = load(path), np.array([end_id], "<u4").tobytes(), 4 * most
        for batch in batches:
            for part in slices(batch, "_text"):
                row, start, length, crc, total = [], [], [], [], []
                for i, text in enumerate(part.column("_text").to_pylist()):
                    ids = tokens.encode(text) + end
                    for at in range(0, len(ids), width):
                        piece = ids[at : at + width]
                        row.append(i), start.append(at // 4), length.append(len(piece) // 4), crc.append(zlib.crc32(piece)), total.append(len(ids) // 4)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(row)), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return df.select("doc_id", whole_text().alias("_text")).mapInArrow(tidy(run, path), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def shortest_pack_first(histogram: dict[int, int], most: int) -> list[tuple[int, list[int]]]:
    """(how often, lengths) of each pattern. Lengths are placed longest first into the open packs with
    the fewest tokens that have room; a pattern with more packs than are needed is split in two."""
    open_packs: list[tuple[int, int, list[int]]] = []  # tokens, count, lengths
    closed: list[tuple[int, list[int]]] = []
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if open_packs and open_packs[0][0] + length <= most:
                tokens, count, lengths = open_packs.pop(0)
                used = min(count, left)
                if used < count:
                    insort(open_packs, (tokens, count - used, lengths))
                grown = (tokens + length, used, [*lengths, length])
                left -= used
            else:
                # a new pack is the one with the fewest tokens, so it takes this length until it is full
                each = min(most // length, left)
                grown = (each * length, left // each, [length] * each)
                left -= grown[1] * each
            if grown[0] < most:
                insort(open_packs, grown)
            else:
                closed.append((grown[1], grown[2]))
    return closed + [(count, lengths) for _, count, lengths in open_packs]


def ranked(df: DataFrame, key: str, within: list[str]) -> DataFrame:
    """df with `rank`: the number of each row among those of the same key, from 0. Rows of a key are
    counted in many buckets, whose counts are then added up, so no key comes together in one task."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(*within), F.lit(parts)))
    sums = dealt.groupBy(key, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col(key).alias("_key"), F.col("_bucket").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy(key, "_bucket").orderBy(*within)
    numbered = dealt.withColumn("_own", F.row_number().over(own) - 1)
    joined = numbered.join(offsets, (F.col(key) == F.col("_key")) & (F.col("_bucket") == F.col("_of")))
    return joined.withColumn("rank", F.col("_own") + F.col("_before")).drop("_bucket", "_key", "_of", "_before", "_own")


def place(cut: DataFrame, most: int = 4096) -> DataFrame:
    """cut (a stored table of pieces with their length) with sequence_id and offset. The histogram has
    `most` entries at most; so has the work on the driver a bound that no input moves."""
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    keys, bases, offsets, first = [], [], [], 0
    taken = dict.fromkeys(histogram, 0)
    for count, lengths in shortest_pack_first(histogram, most):
        offset = 0
        for length in lengths:
            keys.append(length << 44 | taken[length])
            bases.append(first - taken[length])
            offsets.append(offset)
            taken[length] += count
            offset += length
        first += count
    order = np.argsort(np.array(keys, np.int64))
    table = cut.sparkSession.sparkContext.broadcast([np.array(x, np.int64)[order] for x in (keys, bases, offsets)])
    numbered = ranked(cut, "length", ["doc_id", "start", "ids_crc32"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, bases, offsets = table.value
        for batch in batches:
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            at = np.searchsorted(keys, batch.column("length").to_numpy(zero_copy_only=False) << 44 | rank, "right") - 1
            kept = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(bases[at] + rank), pa.array(offsets[at])], [*kept, "sequence_id", "offset"])

    kinds = ", ".join(f"{c} {t}" for c, t in cut.dtypes)
    return numbered.mapInArrow(run, f"{kinds}, sequence_id long, offset long")


def pack(df: DataFrame, path: str, end_id: int = 2, most: int = 4096) -> DataFrame:
    """Every piece of every text with its sequence and its place there."""
    return place(materialise(pieces(df, path, end_id, most)), most)
