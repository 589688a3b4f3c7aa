"""How often each phrase of a corpus occurs, where most phrases are too rare to be asked for.

Texts are packed into blocks of words. A block sends the hashes of its distinct phrases, with how often it has them, to
shares of the hashes; a share adds them up and tells each block by a bit which of its phrases may be frequent enough. Only
these are made into strings and counted by themselves, so hashes that meet cost work and change no count. A phrase comes
once from a block, however often it has it, so no share grows with a frequent one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import checkpointed, give_back

#: Bytes of words of a block, hashes that a share adds up at once (about), and how many hashes there are for each phrase.
BLOCK, SHARE, ROOM = 8 << 20, 2 << 20, 16
SPACE, LINE = 32, 10
ODD = 0x9E3779B97F4A7C15


def packed(texts: DataFrame, text: str, size: int) -> DataFrame:
    """block, words (how many) and text: texts in lower case, words parted by spaces, texts by line ends, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, n = TaskContext.get().partitionId() << 32, [], 0

        def made() -> pa.RecordBatch:
            whole = "\n".join(held).encode()
            words = np.count_nonzero(np.frombuffer(whole, np.uint8) <= SPACE) + 1
            return pa.RecordBatch.from_pydict({"block": [block], "words": [words], "text": [len(whole).to_bytes(8, "little") + pa.compress(whole, "zstd", asbytes=True)]}, schema)

        schema = pa.schema([("block", pa.int64()), ("words", pa.int64()), ("text", pa.binary())])
        for batch in batches:
            for value in batch.column(0):
                one = value.as_py()
                if held and n + len(one) > size:
                    yield made()
                    block, held, n = block + 1, [], 0
                held.append(one)
                n += len(one) + 1
        if held:
            yield made()

    words = F.trim(F.regexp_replace(F.lower(text), r"(?U)\W+", " ")).alias("text")
    return checkpointed(texts.select(words).where("text != ''").mapInArrow(run, "block long, words long, text binary"))


def unpacked(text: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(text[8:], int.from_bytes(text[:8], "little"), "zstd", asbytes=True), np.uint8)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(30))


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word, the same in all blocks."""
    at = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2], np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    place = np.arange(len(data)) - np.repeat(at[:-1], np.diff(at))
    powers = np.cumprod(np.full(int(np.diff(at).max()) + 1, ODD, np.uint64), dtype=np.uint64)
    return mixed(np.add.reduceat((data + np.uint64(1)) * powers[place], at[:-1]) + np.diff(at).astype(np.uint64))


def found(data: np.ndarray, low: int, high: int, bits: int, spans: bool = True) -> tuple[np.ndarray, ...]:
    """Hash and number of each distinct phrase of a block, in the order of the hashes, and on wish start and end."""
    breaks = np.flatnonzero(data <= SPACE)
    starts, ends = np.append(0, breaks + 1).astype(np.int32), np.append(breaks, len(data)).astype(np.int32)
    line = np.cumsum(np.append(0, data[breaks] == LINE), dtype=np.int32)
    offsets = np.append(0, np.cumsum(ends - starts)).astype(np.int32)
    body = data[data > SPACE].tobytes()
    coded = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(body)]).dictionary_encode()
    word, own = coded.indices.to_numpy(), word_hashes(coded.dictionary)
    at, of, h, out = np.arange(len(word), dtype=np.int32), word, own[word], []
    del breaks, offsets, body, coded
    for n in range(2, high + 1):
        # a phrase is the phrase without its last word, by its number among these, and that word: no hash is asked
        whole = np.flatnonzero((at < len(word) - n + 1) & (line[np.minimum(at + n - 1, len(word) - 1)] == line[at]))
        at, last = at[whole], word[at[whole] + n - 1]
        if not len(at):
            break
        h = mixed(h[whole] * np.uint64(ODD) + own[last])
        key = of[whole] * np.int64(len(own)) + last
        order = np.argsort(key)
        key = key[order]
        new = np.append(True, key[1:] != key[:-1])
        of = np.empty(len(at), np.int32)
        of[order] = np.cumsum(new, dtype=np.int32) - 1
        first = order[new]
        if n >= low:
            times = np.diff(np.append(np.flatnonzero(new), len(new))).astype(np.int32)
            out.append((h[first] >> np.uint64(64 - bits), times, *((starts[at[first]], ends[at[first] + n - 1]) if spans else ())))
        del whole, last, key, order, new, first
    if not out:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.int32, np.int32, np.int32)[: 4 if spans else 2])
    columns = [np.concatenate(c) for c in zip(*out, strict=True)]
    del out, at, of, h, line, starts, ends
    order = np.argsort(columns[0])  # equal hashes get equal answers, whatever their order
    return tuple(c[order] for c in columns)


def cuts(h: np.ndarray, shares: int, bits: int) -> np.ndarray:
    """Where each share of the hashes starts, and the end."""
    limits = [(share << bits) // shares for share in range(shares)]
    return np.append(np.searchsorted(h, np.array(limits, np.uint64)), len(h))


def told(h: np.ndarray, times: np.ndarray, least: int) -> bytes:
    """Sorted hashes as differences and the numbers, up to least, byte by byte of each."""
    steps = np.diff(h, prepend=np.uint64(0))
    planes = [((steps >> np.uint64(8 * i)) & np.uint64(255)).astype(np.uint8) for i in range(8)]
    whole = b"".join(p.tobytes() for p in [*planes, np.minimum(times, least).astype(np.uint8)])
    return pa.compress(whole, "zstd", asbytes=True)


def read(blob: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(pa.decompress(blob, 9 * n, "zstd", asbytes=True), np.uint8).reshape(9, n)
    steps = np.zeros(n, np.uint64)
    for i in range(8):
        steps |= planes[i].astype(np.uint64) << np.uint64(8 * i)
    return np.cumsum(steps, dtype=np.uint64), planes[8]


def phrase_counts(texts: DataFrame, text: str = "text", low: int = 2, high: int = 4, least: int = 5, block: int = BLOCK, share: int = SHARE, bits: int | None = None) -> DataFrame:
    """phrase, n: the phrases of low to high words (low is two at least) that occur `least` times or
    more (255 at most)."""
    blocks = packed(texts, text, block)
    total = blocks.agg(F.sum("words")).first()[0] or 0
    shares = max(1, -(-total * (high - low + 1) // share))
    bits = bits or (total * (high - low + 1) * ROOM).bit_length()

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, packed_text in zip(batch.column("block"), batch.column("text"), strict=True):
                h, times = found(unpacked(packed_text.as_py()), low, high, bits, spans=False)
                at = cuts(h, shares, bits)
                some = np.flatnonzero(np.diff(at)).tolist()
                blobs = [told(h[at[i] : at[i + 1]], times[at[i] : at[i + 1]], least) for i in some]
                yield pa.RecordBatch.from_pydict({"share": pa.array(some, pa.int32()), "block": pa.array([name.as_py()] * len(some), pa.int64()), "n": pa.array(np.diff(at)[some], pa.int32()), "blob": pa.array(blobs, pa.binary())})
                del h, times, blobs
                give_back()

    def add(table: pa.Table) -> pa.Table:
        sizes = table.column("n").to_pylist()
        parts = [read(blob.as_py(), n) for blob, n in zip(table.column("blob"), sizes, strict=True)]
        own, of = np.unique(np.concatenate([h for h, _ in parts]), return_inverse=True)
        enough = np.bincount(of, np.concatenate([t for _, t in parts]), len(own))[of] >= least
        bits_of = [np.packbits(part).tobytes() for part in np.split(enough, np.cumsum(sizes)[:-1])]
        del own, of, enough, parts
        give_back()
        return pa.table({"block": table.column("block"), "share": table.column("share"), "bits": pa.array(bits_of, pa.binary())})

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed_text, answer in zip(batch.column("text"), batch.column("answer"), strict=True):
                data = unpacked(packed_text.as_py())
                h, times, starts, ends = found(data, low, high, bits)
                at, enough = cuts(h, shares, bits), np.zeros(len(h), bool)
                for part in answer.as_py():
                    i, j = at[part["share"]], at[part["share"] + 1]
                    enough[i:j] = np.unpackbits(np.frombuffer(part["bits"], np.uint8), count=j - i)
                keep = np.flatnonzero(enough)
                for first in range(0, len(keep), 100_000):
                    some = keep[first : first + 100_000]
                    upto = np.append(0, np.cumsum(ends[some] - starts[some]))
                    spread = np.arange(upto[-1]) + np.repeat(starts[some] - upto[:-1], np.diff(upto))
                    names = pa.Array.from_buffers(pa.string(), len(some), [None, pa.py_buffer(upto.astype(np.int32).tobytes()), pa.py_buffer(data[spread].tobytes())])
                    yield pa.RecordBatch.from_arrays([names, pa.array(times[some], pa.int64())], ["phrase", "n"])
                del data, h, times, starts, ends
                give_back()

    sent = blocks.mapInArrow(send, "share int, block long, n int, blob binary")
    answers = sent.groupBy("share").applyInArrow(add, "block long, share int, bits binary")
    answers = answers.groupBy("block").agg(F.collect_list(F.struct("share", "bits")).alias("answer"))
    counted = blocks.select("block", "text").join(answers, "block").select("text", "answer").mapInArrow(give, "phrase string, n long")
    return counted.groupBy("phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
