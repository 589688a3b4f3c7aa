"""Substring dedup with a compressed FM-index per shard.

A window is `width` consecutive words. Equal windows have equal minimizers (the least hash of the runs of
SHORT words in them), so the windows of a document fall into segments, each with one minimizer, and all
windows that may be equal meet in the shard of their minimizer. Only minimizers that occur twice go there.
A shard indexes its segments: a suffix order of the words, the Burrows-Wheeler transform in a wavelet matrix
of packed bits, and backward search for the windows of streamed segments. A window whose interval holds two
places or more is repeated; of a segment that occurs twice, every window is. What shards report per segment
is joined back to the block of documents that asked.

A minimizer of more segments than a task should hold (a line that many documents share, with other words around it
in each) goes to no shard: the windows of its segments are counted by their hashes, merged per block, so they spread
over all tasks, and blocks are told which of their own are repeated.

Defined results: null and empty texts have no words; texts of fewer than `width` words lose none; windows are
judged on the input; repeated rows are repeated windows; words of any length count as one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BACK, in_blocks, materialise, mix, powers, slices, span_hashes, string_buffers, whole_text, word_spans

WIDTH, SHORT = 35, 12
#: Windows that a lane of the search works through.
LANE = 32
#: Bytes of the segments of a shard, about, and of the segments that one minimizer may bring to it.
SHARD = 4 << 20


class Segments:
    """The segments of some texts: arrays of text number, first word (of the texts together), words, minimizer, its places, hash."""

    def __init__(self, texts: pa.Array, width: int = WIDTH):
        self.data, offsets = string_buffers(texts)
        self.starts, self.ends, self.doc = word_spans(self.data, offsets)
        n = len(self.starts)
        self.docs = len(texts)
        self.first_word = np.searchsorted(self.doc, np.arange(self.docs + 1))
        words = span_hashes(self.data, self.starts, self.ends)
        total = self.total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * powers(n), dtype=np.uint64)])
        back = powers(n + 1, BACK)
        count = n - width + 1
        empty = np.zeros(0, np.int64)
        self.row, self.first, self.words, self.least, self.places, self.key = empty, empty, empty, empty.astype(np.uint64), empty, empty.astype(np.uint64)
        if count <= 0:
            return
        runs = mix((total[SHORT:] - total[:-SHORT]) * back[: n - SHORT + 1])
        reach, least = width - SHORT + 1, runs
        span = 1
        while span < reach:
            step = min(span, reach - span)
            least = np.minimum(least[:-step], least[step:])
            span += step
        least = least[:count]
        whole = self.doc[:count] == self.doc[width - 1 :]  # the window lies in one text
        new = whole.copy()
        new[1:] &= (least[1:] != least[:-1]) | ~whole[:-1]
        self.first = np.flatnonzero(new)
        last = np.flatnonzero(whole & ~np.append(whole[1:] & ~new[1:], False))
        self.words = last - self.first + width
        self.row, self.least = self.doc[self.first], least[self.first]
        spread = np.repeat(np.arange(len(self.first)), self.words - SHORT + 1)
        begin = np.cumsum(self.words - SHORT + 1) - (self.words - SHORT + 1)
        at = self.first[spread] + np.arange(len(spread)) - begin[spread]
        self.places = np.bincount(spread[runs[at] == self.least[spread]], minlength=len(self.first))
        self.key = mix((total[self.first + self.words] - total[self.first]) * back[self.first] + self.words.astype(np.uint64))

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every window."""
        count = len(self.starts) - width + 1
        if count <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        whole = np.flatnonzero(self.doc[:count] == self.doc[width - 1 :])
        return whole, mix((self.total[whole + width] - self.total[whole]) * powers(count, BACK)[whole]).view(np.int64)

    def text(self, i: int) -> bytes:
        a, b = int(self.first[i]), int(self.first[i] + self.words[i])
        return self.data[self.starts[a] : self.ends[b - 1]].tobytes()


class Bits:
    """Packed bits with the number of ones before each word of 64."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(np.concatenate([bits, np.zeros(64 + -len(bits) % 64, bool)]), bitorder="little")
        self.words = packed.view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)]).astype(np.int32)

    def ones(self, at: np.ndarray) -> np.ndarray:
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))


class FMIndex:
    """Of a sequence of word numbers from 1, with 0 between segments; exact for patterns of up to 63 words."""

    def __init__(self, sequence: np.ndarray):
        n, self.sequence = len(sequence), sequence
        rank = sequence.astype(np.int64)
        for reach in (1, 2, 4, 8, 16, 32):
            after = np.zeros(n, np.int64)
            after[:-reach] = rank[reach:] + 1 if n > reach else 0
            key = rank * (int(after.max(initial=0)) + 1) + after
            order = np.argsort(key, kind="stable")
            ordered = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
            if rank[order[-1]] == n - 1:
                break
        order = np.argsort(rank, kind="stable")
        self.levels, self.zeros = [], []
        width = max(1, int(sequence.max(initial=0)).bit_length())
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(sequence, minlength=1 << width))])
        level = sequence[order - 1]  # the Burrows-Wheeler transform
        for bit in range(width - 1, -1, -1):
            one = (level >> bit & 1).astype(bool)
            self.levels.append(Bits(one))
            self.zeros.append(int(n - one.sum()))
            level = np.concatenate([level[~one], level[one]])
        # where each word number begins in the last level
        values, first = np.unique(level, return_index=True)
        self.base = np.zeros(1 << width, np.int64)
        self.base[values] = first

    def rank(self, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each word stands in the transform before each place."""
        top = len(self.levels) - 1
        for k, (bits, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            ones = bits.ones(at)
            at = np.where(word >> (top - k) & 1, zeros + ones, at - ones)
        return at - self.base[word]

    def back(self, word: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search for many patterns at once."""
        both = self.rank(np.concatenate([word, word]), np.concatenate([low, high]))
        return self.starts[word] + both[: len(word)], self.starts[word] + both[len(word) :]


def repeated_windows(index: FMIndex, first: np.ndarray, windows: np.ndarray, width: int) -> np.ndarray:
    """For windows at first[i] .. first[i] + windows[i] - 1 of the sequence: their places there that occur twice
    or more. A search that fails after f words lets all windows pass that hold the words it failed on."""
    pieces = -(-windows // LANE)
    lane_of = np.repeat(np.arange(len(first)), pieces)
    part = np.arange(len(lane_of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    at = first[lane_of] + part * LANE
    stop = np.minimum(at + LANE, first[lane_of] + windows[lane_of])
    found = []
    everything = len(index.sequence)
    at_word, low, high = at + width, np.zeros(len(at), np.int64), np.full(len(at), everything, np.int64)
    while len(at):
        low, high = index.back(index.sequence[at_word - 1].astype(np.int64), low, high)
        at_word = at_word - 1
        failed = high - low < 2
        done = ~failed & (at_word == at)
        if done.any():
            found.append(at[done])
        fresh = failed | done
        at = np.where(failed, at_word + 1, np.where(done, at + 1, at))
        low, high = np.where(fresh, 0, low), np.where(fresh, everything, high)
        at_word = np.where(fresh, at + width, at_word)
        going = at < stop
        if not going.all():
            at, stop, at_word, low, high = at[going], stop[going], at_word[going], low[going], high[going]
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def shard_report(least: np.ndarray, key: np.ndarray, count: np.ndarray, texts: pa.Array, width: int) -> dict[int, bytes]:
    """For each distinct segment with repeated windows: one bit per window, packed."""
    _, pick, inverse = np.unique(key, return_index=True, return_inverse=True)
    times = np.bincount(inverse, weights=count).astype(np.int64)
    data, offsets = string_buffers(texts.take(pa.array(pick)))
    starts, ends, segment = word_spans(data, offsets)
    words = np.bincount(segment, minlength=len(pick))
    # a 0 after each segment
    _, number = np.unique(span_hashes(data, starts, ends), return_inverse=True)
    begin = np.concatenate([[0], np.cumsum(words + 1)])
    sequence = np.zeros(int(begin[-1]), np.int32)
    sequence[np.arange(len(segment)) + segment] = number + 1
    out = {}
    alone = np.flatnonzero(times == 1)
    if len(alone):
        hits = repeated_windows(FMIndex(sequence), begin[:-1][alone], words[alone] - width + 1, width)
        owner = np.searchsorted(begin, hits, "right") - 1
        for i in np.unique(owner):
            bits = np.zeros(words[i] - width + 1, bool)
            bits[hits[owner == i] - begin[i]] = True
            out[int(key[pick[i]])] = np.packbits(bits).tobytes()
    for i in np.flatnonzero(times > 1):
        out[int(key[pick[i]])] = np.packbits(np.ones(words[i] - width + 1, bool)).tobytes()
    return out


def kept_words(segments: Segments, reports: dict[int, bytes], width: int, repeated: np.ndarray | None = None) -> np.ndarray:
    """Which words no repeated window covers; repeated: hashes of windows known to be."""
    edge = np.zeros(len(segments.starts) + 1, np.int32)
    for i in np.flatnonzero(np.isin(segments.key, np.fromiter(reports, np.uint64, len(reports)))):
        n = int(segments.words[i]) - width + 1
        hit = np.unpackbits(np.frombuffer(reports[int(segments.key[i])], np.uint8), count=n).astype(np.int32)
        edge[segments.first[i] : segments.first[i] + n] += hit
        edge[segments.first[i] + width : segments.first[i] + width + n] -= hit
    if repeated is not None and len(repeated):
        at, hashes = segments.windows(width)
        at = at[np.isin(hashes, repeated)]
        edge[at] += 1
        edge[at + width] -= 1
    return np.cumsum(edge[:-1]) == 0


def parted(sent: DataFrame, width: int, most: int) -> tuple[DataFrame, DataFrame]:
    """The segments of minimizers that bring at most `most` bytes; and of all others (_block, key) of the windows that
    occur twice, key the hash of the window."""
    # at most one minimizer for each `most` bytes of segments
    heavy = F.broadcast(materialise(sent.groupBy("least").agg(F.sum(F.octet_length("text")).alias("_bytes")).where(F.col("_bytes") > most).select("least")))

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = Segments(part.column("text"), width)
                at, key = found.windows(width)
                row = found.doc[at]
                yield pa.RecordBatch.from_arrays([pa.array(part.column("_block").to_numpy()[row], pa.int32()), pa.array(key), pa.array(part.column("count").to_numpy()[row], pa.int64())], ["_block", "key", "n"])

    windows = sent.join(heavy, "least", "left_semi").select("_block", "count", "text").mapInArrow(hashes, "_block int, key long, n long")
    windows = materialise(windows.groupBy("_block", "key").agg(F.sum("n").alias("n")))
    twice = windows.groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").select("key")
    return sent.join(heavy, "least", "left_anti"), windows.join(twice, "key", "left_semi").select("_block", "key")


def remove_repeats(docs: DataFrame, width: int = WIDTH, text: str = "text", most: int = SHARD) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text (kept words joined by one space) of every document."""
    spark = docs.sparkSession
    kind = dict(docs.dtypes)["doc_id"]
    blocks = in_blocks(docs.select("doc_id", whole_text(text).alias("text")))

    def minimizers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = Segments(part.column("text"), width)
                block = part.column("_block").to_numpy()[found.row]
                order = np.lexsort((block, found.least))
                least, block = found.least[order], block[order]
                new = np.ones(len(order), bool)
                new[1:] = (least[1:] != least[:-1]) | (block[1:] != block[:-1])
                at = np.flatnonzero(new)
                n = np.add.reduceat(found.places[order], at) if len(at) else at
                yield pa.RecordBatch.from_arrays([pa.array(least[at].view(np.int64)), pa.array(block[at], pa.int32()), pa.array(n, pa.int64())], ["least", "_block", "n"])

    every = materialise(blocks.select("text", "_block").mapInArrow(minimizers, "least long, _block int, n long"))
    twice = every.groupBy("least").agg(F.sum("n").alias("n")).where("n > 1").select("least")
    asked = every.select("least", "_block").join(twice, "least", "left_semi").distinct()

    def segments(docs: pa.Table, asked: pa.Table) -> pa.Table:
        wanted = asked.column("least").to_numpy().view(np.uint64)
        rows: dict[int, list] = {}
        block = docs.column("_block")[0].as_py() if docs.num_rows else 0
        for batch in docs.to_batches():
            for part in slices(batch, "text"):
                found = Segments(part.column("text"), width)
                for i in np.flatnonzero(np.isin(found.least, wanted)).tolist():
                    key = int(found.key[i])
                    if key in rows:
                        rows[key][1] += 1
                    else:
                        rows[key] = [int(found.least[i]), 1, found.text(i)]
        keys = np.fromiter(rows, np.uint64, len(rows))
        least, count, texts = ([x[k] for x in rows.values()] for k in range(3))
        return pa.table({"_block": pa.array([block] * len(rows), pa.int32()), "least": pa.array(np.array(least, np.uint64).view(np.int64)), "key": pa.array(keys.view(np.int64)), "count": pa.array(count, pa.int64()), "text": pa.array(texts, pa.binary())})

    sent = materialise(blocks.select("_block", "text").groupBy("_block").cogroup(asked.groupBy("_block")).applyInArrow(segments, "_block int, least long, key long, count long, text binary"))
    light, repeated = parted(sent, width, most)
    volume = light.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(volume // SHARD + 1, spark.sparkContext.defaultParallelism)

    def search(shard: pa.Table) -> pa.Table:
        shard = shard.combine_chunks()
        key = shard.column("key").to_numpy()
        texts = shard.column("text").combine_chunks()
        texts = texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts
        found = shard_report(shard.column("least").to_numpy(), key.view(np.uint64), shard.column("count").to_numpy(), texts, width)
        known = np.fromiter(found, np.uint64, len(found)).view(np.int64)
        hit = np.flatnonzero(np.isin(key, known))
        return pa.table({"_block": shard.column("_block").take(pa.array(hit)), "key": pa.array(key[hit]), "windows": pa.array([found[int(k)] for k in key[hit].view(np.uint64)], pa.binary())})

    dealt = light.select(sent.columns).withColumn("_shard", F.pmod(F.xxhash64("least"), F.lit(shards)))
    reports = dealt.groupBy("_shard").applyInArrow(search, "_block int, key long, windows binary")
    reports = materialise(reports.unionByName(repeated.withColumn("windows", F.lit(None).cast("binary"))))

    def cut(docs: pa.Table, reports: pa.Table) -> pa.Table:
        alone = reports.column("windows").is_null().to_numpy()
        keys, windows = reports.column("key").to_numpy(), reports.column("windows").to_pylist()
        known = {int(k): windows[i] for i, k in zip(np.flatnonzero(~alone).tolist(), keys[~alone].view(np.uint64).tolist(), strict=True)}
        ids, words, removed, texts = [], [], [], []
        for batch in docs.to_batches():
            for part in slices(batch, "text"):
                found = Segments(part.column("text"), width)
                kept = kept_words(found, known, width, keys[alone])
                gone = np.concatenate([[0], np.cumsum(~kept)])
                for i, text in enumerate(part.column("text").to_pylist()):
                    a, b = int(found.first_word[i]), int(found.first_word[i + 1])
                    lost = int(gone[b] - gone[a])
                    own = text.encode().split()
                    words.append(b - a), removed.append(lost)
                    texts.append(b" ".join(own if not lost else [own[j] for j in np.flatnonzero(kept[a:b])]).decode())
                ids.append(part.column("doc_id"))
        return pa.table({"doc_id": pa.chunked_array(ids, docs.schema.field("doc_id").type), "n_words": pa.array(words, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_text": pa.array(texts, pa.string())})

    return blocks.groupBy("_block").cogroup(reports.groupBy("_block")).applyInArrow(cut, f"doc_id {kind}, n_words long, n_removed long, kept_text string")


def repeat_report(docs: DataFrame) -> DataFrame:
    found = remove_repeats(docs.select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def brute_force(texts: list[str], width: int = WIDTH) -> list[tuple[int, int, str]]:
    """n_words, n_removed, kept_sha256 by a count of all windows; for tests."""
    words = [text.encode().split() for text in texts]
    counts: dict[tuple, int] = {}
    for own in words:
        for i in range(len(own) - width + 1):
            counts[tuple(own[i : i + width])] = counts.get(tuple(own[i : i + width]), 0) + 1
    out = []
    for own in words:
        gone = set()
        for i in range(len(own) - width + 1):
            if counts[tuple(own[i : i + width])] > 1:
                gone.update(range(i, i + width))
        out.append((len(own), len(gone), hashlib.sha256(b" ".join(w for i, w in enumerate(own) if i not in gone)).hexdigest()))
    return out
