"""Telephony audio columns: mu-law, A-law and IMA ADPCM in WAV, decoded to resampled 16-bit PCM.

Defined results: null bytes count as empty; an empty clip has no samples; clips of any length are
decoded in blocks of bounded size; equal clips give equal values; a malformed container raises.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, whole_text

#: WAV format tags.
MULAW, ALAW, IMA = 7, 6, 17
#: Bytes of an ADPCM block: a header of four and a byte for two samples each.
BLOCK = 64
RATE, TO_RATE = 8000, 16000
#: How the index moves for each nibble without its sign.
INDEX_STEP = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int16)
#: Samples that are expanded and resampled at a time.
WINDOW = 1 << 20


@lru_cache(1)
def mulaw_table() -> np.ndarray:
    """The 16-bit sample of each mu-law code (G.711)."""
    code = ~np.arange(256, dtype=np.int32) & 255
    size = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


@lru_cache(1)
def alaw_table() -> np.ndarray:
    """The 16-bit sample of each A-law code (G.711)."""
    code = np.arange(256, dtype=np.int32) ^ 0x55
    chord, low = code >> 4 & 7, ((code & 15) << 4) + 8
    size = np.where(chord == 0, low, (low + 256) << np.maximum(chord - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


@lru_cache(1)
def step_table() -> np.ndarray:
    """The 89 ADPCM step sizes: each about a tenth above the last, by the published integer rule."""
    #: The IMA step sizes.
    return np.array([
        7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
        130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066,
        2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
    ], np.int32)


def ima_blocks(blocks: np.ndarray) -> np.ndarray:
    """Samples of mono IMA ADPCM blocks, one row each: all blocks advance together, one nibble at a time."""
    blocks = np.ascontiguousarray(blocks, np.uint8)
    n, width = blocks.shape
    value = (blocks[:, 0].astype(np.uint16) | blocks[:, 1].astype(np.uint16) << 8).astype(np.int16).astype(np.int32)
    index = np.minimum(blocks[:, 2], 88).astype(np.int32)
    out = np.empty((2 * (width - 4) + 1, n), np.int16)
    out[0] = value
    steps, packed = step_table(), np.ascontiguousarray(blocks[:, 4:].T)
    for k in range(2 * (width - 4)):
        nibble = packed[k >> 1] >> (4 * (k & 1)) & 15
        step = steps[index]
        change = step >> 3
        change += np.where(nibble & 4, step, 0)
        change += np.where(nibble & 2, step >> 1, 0)
        change += np.where(nibble & 1, step >> 2, 0)
        value = np.clip(np.where(nibble & 8, value - change, value + change), -32768, 32767)
        index = np.clip(index + INDEX_STEP[nibble & 7], 0, 88)
        out[k + 1] = value
    return out.T


def resample(pcm: np.ndarray, rate: int = RATE, to_rate: int = TO_RATE) -> np.ndarray:
    """Linear interpolation in integers; the last sample holds to the end."""
    return np.concatenate([np.zeros(0, np.int16), *resampled([pcm], rate, to_rate)])


def resampled(windows: Iterable[np.ndarray], rate: int = RATE, to_rate: int = TO_RATE) -> Iterator[np.ndarray]:
    """A clip that comes window by window, resampled as if it were whole: each window looks at the first sample of the
    next one, and outputs are placed from the start of the clip."""
    start, held = 0, None
    for window in (w for some in (windows, [None]) for w in some):
        if window is not None and not len(window):
            continue
        if held is not None:
            end = start + len(held)
            after = held[-1] if window is None else window[0]
            last = end * to_rate // rate if window is None else -(-end * to_rate // rate)
            if rate == to_rate:
                yield held
            elif to_rate == 2 * rate:
                out = np.empty(2 * len(held), np.int16)
                out[::2], out[1:-1:2] = held, (held[:-1].astype(np.int32) + held[1:]) >> 1
                out[-1] = (int(held[-1]) + int(after)) >> 1
                yield out
            else:
                at = np.arange(-(-start * to_rate // rate), last, dtype=np.int64) * rate
                wide = np.append(held, after).astype(np.int64)
                left, part = at // to_rate - start, at % to_rate
                yield ((wide[left] * (to_rate - part) + wide[left + 1] * part) // to_rate).astype(np.int16)
            start = end
        held = None if window is None else window.astype(np.int16)


def wav(data: bytes, tag: int, rate: int = RATE, block: int = 1) -> bytes:
    """A mono RIFF file of coded samples."""
    per_block = 2 * (block - 4) + 1 if tag == IMA else 1
    extra = struct.pack("<HH", 2, per_block) if tag == IMA else struct.pack("<H", 0)
    form = struct.pack("<HHIIHH", tag, 1, rate, rate * block // per_block, block, 4 if tag == IMA else 8) + extra
    chunks = [(b"fmt ", form), (b"fact", struct.pack("<I", len(data) // block * per_block)), (b"data", data)]
    body = b"WAVE" + b"".join(name + struct.pack("<I", len(x)) + x + b"\0" * (len(x) % 2) for name, x in chunks)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wav(media: bytes) -> tuple[int, int, int, bytes]:
    """Format tag, rate, block size and coded samples."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, tag, rate, block = 12, 0, 0, 1
    while at + 8 <= len(media):
        name, size = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
        if name == b"fmt ":
            tag, _, rate, _, block = struct.unpack_from("<HHIIH", media, at + 8)
        elif name == b"data":
            return tag, rate, block, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no samples")


def decode(tag: int, block: int, data: bytes) -> Iterator[np.ndarray]:
    """16-bit samples, a window at a time."""
    codes = np.frombuffer(data, np.uint8)
    if tag == IMA:
        codes, step = codes[: len(codes) // block * block].reshape(-1, block), max(1, WINDOW // block)
        for first in range(0, len(codes), step):
            yield ima_blocks(codes[first : first + step]).reshape(-1)
    else:
        table = {MULAW: mulaw_table, ALAW: alaw_table}[tag]()
        for first in range(0, len(codes), WINDOW):
            yield table[codes[first : first + WINDOW]]


def store_clips(df: DataFrame, payload: str, tag: int = MULAW, to: str = "media") -> DataFrame:
    """df with the bytes of `payload` as the coded samples of a WAV file in `to`; nothing is lost."""
    make = F.pandas_udf(lambda s: s.map(lambda x: wav(bytes(x or b""), tag, block=BLOCK if tag == IMA else 1)), "binary")
    return df.withColumn(to, make(payload))


CLIP = T.StructType([T.StructField("payload", T.BinaryType()), T.StructField("rate", T.IntegerType()), T.StructField("pcm", T.BinaryType())])


def decode_clips(df: DataFrame, media: str = "media", to_rate: int = TO_RATE, to: str = "clip") -> DataFrame:
    """df with struct `to`: the coded samples read back, their rate, and PCM at to_rate."""

    def one(clip: bytes) -> tuple[bytes, int, bytes]:
        tag, rate, block, data = read_wav(bytes(clip))
        return data, rate, b"".join(x.tobytes() for x in resampled(decode(tag, block, data), rate, to_rate))

    make = F.pandas_udf(lambda s: pd.DataFrame([one(x) for x in s], columns=CLIP.names), CLIP)
    return df.withColumn(to, make(media))


class Features:
    """Peak, root mean square, sign changes, crc32 and sha256 of 16-bit samples that come window by window."""

    def __init__(self):
        self.n = self.peak = self.power = self.changes = self.crc = 0
        self.hash, self.sign = hashlib.sha256(), None

    def add(self, pcm: np.ndarray) -> Features:
        if not len(pcm):
            return self
        wide, raw, signs = pcm.astype(np.int32), pcm.tobytes(), pcm < 0
        self.n += len(pcm)
        self.peak = max(self.peak, int(np.abs(wide).max()))
        self.power += int(np.dot(wide.astype(np.float64), wide.astype(np.float64)))
        self.changes += int(np.count_nonzero(signs[1:] != signs[:-1])) + (self.sign is not None and self.sign != bool(signs[0]))
        self.crc, self.sign = zlib.crc32(raw, self.crc), bool(signs[-1])
        self.hash.update(raw)
        return self

    def __str__(self) -> str:
        return f"{self.peak},{round((self.power / max(1, self.n)) ** 0.5)},{self.changes},{self.crc}"


def text_clips(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text as telephony audio: its bytes, padded with 0 to a positive multiple of 64, are stored
    as mu-law samples in WAV and read back from there. The samples read are expanded as mu-law and as
    A-law and decoded as ADPCM blocks of 64 bytes, and each is resampled. The feature holds peak, RMS,
    sign changes and crc32 of each PCM. All blocks of many documents are decoded in one go; a text of more than
    WINDOW bytes is decoded window by window."""
    named = df.select(F.col(doc_id).alias("doc_id"), whole_text(text).alias("_text"))
    fields = ["n_bytes long", "payload_bytes long", "payload_sha256 string", "tail_crc32 long", "media_bytes long", "media_sha256 string", "feature string", "pcm_bytes long", "pcm_sha256 string"]

    def digest(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, read = [], []
        for text in batch.column("_text").to_pylist():
            raw = text.encode()
            media = wav(raw + bytes(-len(raw) % 64 or (0 if raw else 64)), MULAW)
            _, _, _, payload = read_wav(media)
            read.append(payload)
            rows.append([len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest()])
        short = [x for x in read if len(x) <= WINDOW]
        adpcm = ima_blocks(np.frombuffer(b"".join(short), np.uint8).reshape(-1, BLOCK)) if short else None
        end = 0
        for row, payload in zip(rows, read, strict=True):
            forms = {"mulaw": decode(MULAW, 1, payload), "alaw": decode(ALAW, 1, payload)}
            if len(payload) <= WINDOW:
                end += len(payload) // BLOCK
                forms["adpcm"] = [adpcm[end - len(payload) // BLOCK : end].reshape(-1)]
            else:
                forms["adpcm"] = decode(IMA, BLOCK, payload)
            found = {k: Features() for k in forms}
            for k, windows in forms.items():
                for pcm in resampled(windows):
                    found[k].add(pcm)
            row += [";".join(f"{k}:{x}" for k, x in found.items()), 2 * found["mulaw"].n, found["mulaw"].hash.hexdigest()]
        columns = [pa.array(list(x), pa.int64() if f.endswith("long") else pa.string()) for f, x in zip(fields, zip(*rows, strict=True), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *(f.split()[0] for f in fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text", 1 << 20):
                yield digest(part)

    kind = dict(df.dtypes)[doc_id]
    return named.mapInArrow(run, f"doc_id {kind}, {', '.join(fields)}")
