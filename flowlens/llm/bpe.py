"""Byte-level BPE by prefix dynamic programming.

A token sequence is what BPE yields exactly if each adjacent pair is, so every byte prefix of a
piece has one valid last token. Storing that token for each prefix gives exact appends (earlier
entries never change) and cheap re-encoding near edits (entries before the edit stay).

Defined results: null and empty texts have no ids and decode to no bytes; ids never cross a match of
the splitting pattern; texts of any length take time in proportion to their length; repeated rows
and extra columns pass through unchanged; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import re
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, string_buffers, tidy, whole_text

#: Fixed value: the characters that Unicode calls white space.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: No match of the splitting pattern goes beyond one of these chunks.
CHUNK = re.compile(rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: Entries of each half of a worker's cache; the older half goes when the newer is full, which costs time only.
CACHE = 200_000
#: Chunks that are looked at together.
AT_ONCE = 1 << 20
#: Bytes of text that are encoded together.
SLICE = 2 << 20


class BytePairs:
    """The ranks of a byte-level BPE and its prefix tables."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = {i: token for token, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.pieces = regex.compile(pattern)
        self._spines: tuple[dict, dict] = ({}, {})
        self._follows: dict[int, bool] = {}
        self._kept, self._old = {}, {}
        self._by_id: pa.Array | None = None

    def forget(self) -> None:
        """Drop all that later texts may use again, which costs time only."""
        self._spines, self._follows = ({}, {}), {}
        self._kept, self._old = {}, {}

    def merge(self, piece: bytes) -> list[int]:
        """BPE by its definition, for short pieces: join the pair of lowest rank until none is left."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1))
            if rank == 1 << 40:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[x] for x in parts]

    def _spine(self, token: int, right: bool) -> list[tuple[bytes, int, int]]:
        """The tokens that touch the right (left) end of a token while it is merged: bytes, rank of birth, rank of the merge that takes them in."""
        known = self._spines[right].get(token)
        if known is None:
            whole, until, known = self.bytes_of[token], 1 << 40, []
            while True:
                born = self.ranks[whole] if len(whole) > 1 else -1
                known.append((whole, born, until))
                if len(whole) == 1:
                    break
                whole, until = self._halves(whole)[right], born
            self._spines[right][token] = known
        return known

    def _halves(self, token: bytes) -> tuple[bytes, bytes]:
        """The last merge of a token."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            _, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts[0], parts[1]

    def follows(self, a: int, b: int) -> bool:
        """Whether BPE of the bytes of a and b gives just these two: at no time do the tokens that touch merge before others take them in."""
        rank = self.ranks.get
        for x, x_born, x_until in self._spine(a, True):
            for y, y_born, y_until in self._spine(b, False):
                merged = rank(x + y)
                if merged is not None and (t := max(merged, x_born, y_born)) < x_until and t <= y_until:
                    return False
        return True

    def extend(self, piece: bytes, last: list[int]) -> list[int]:
        """last[i] is the last token of piece[: i + 1]; entries that are missing are added."""
        ranks, longest, known = self.ranks.get, self.longest, self._follows
        for end in range(len(last) + 1, len(piece) + 1):
            for start in range(end - 1, end - longest - 1 if end > longest else -1, -1):
                token = ranks(piece[start:end])
                if token is None:
                    continue
                if not start:
                    last.append(token)
                    break
                pair = last[start - 1] << 20 | token
                good = known.get(pair)
                if good is None:
                    if len(known) > 2 * CACHE:
                        known.clear()
                    good = known[pair] = self.follows(last[start - 1], token)
                if good:
                    last.append(token)
                    break
            else:
                raise ValueError("the ranks don't cover every byte")
        return last

    def edit(self, piece: bytes, last: list[int], start: int, end: int, by: bytes) -> tuple[bytes, list[int]]:
        """Replace piece[start:end]; entries are computed anew only until they agree with the old ones."""
        new, shift = piece[:start] + by + piece[end:], len(by) - (end - start)
        out, agreed = last[:start], 0
        while len(out) < len(new):
            self.extend(new[: len(out) + 1], out)
            old = len(out) - 1 - shift
            agreed = agreed + 1 if len(out) > start + len(by) and old >= end and last[old] == out[-1] else 0
            if agreed >= self.longest:
                out += last[old + 1 :]
        return new, out

    def tokens(self, piece: bytes, last: list[int]) -> list[int]:
        out, end = [], len(piece)
        while end:
            out.append(last[end - 1])
            end -= len(self.bytes_of[out[-1]])
        return out[::-1]

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else self.tokens(piece, self.extend(piece, []))

    def _new_pieces(self, pieces: set[str]) -> dict[str, bytes]:
        """Encode pieces in order, so that each goes on from the entries of what it shares with the one before."""
        out, before, last = {}, b"", []
        for piece in sorted(pieces):
            whole = piece.encode()
            token = self.ranks.get(whole)
            if token is None:
                same = 0
                for x, y in zip(whole, before, strict=False):
                    if x != y:
                        break
                    same += 1
                del last[same:]
                before, found = whole, self.tokens(whole, self.extend(whole, last))
            else:
                found = (token,)
            out[piece] = struct.pack(f"<{len(found)}i", *found)
        return out

    def _split(self, chunks: list[str]) -> tuple[set[str], dict[str, list[str]]]:
        """The chunks that are one piece, and the pieces of the others. A line break between chunks that aren't white space
        is a piece of its own."""
        single, split, own = set(), {}, []
        at = iter([x for x in chunks if not x.isspace()])
        for piece in self.pieces.findall("\n".join([*(x for x in chunks if not x.isspace()), ""])):
            if piece != "\n":
                own.append(piece)
            elif len(own) == 1:
                single.add(next(at))
                own.clear()
            else:
                split[next(at)], own = own, []
        return single, split | {x: self.pieces.findall(x) for x in chunks if x.isspace()}

    def _some(self, chunks: set[str]) -> dict[str, bytes]:
        """The ids of chunks; they and their pieces are kept for later ones (a piece alone is a chunk of one piece)."""
        out = {x: ids for x in chunks if (ids := self._old.get(x)) is not None}
        new, split = self._split([x for x in chunks if x not in out])
        found = {}
        for piece in set(chain.from_iterable(split.values())):
            ids = self._kept.get(piece) or self._old.get(piece)
            if ids is None:
                new.add(piece)
            else:
                found[piece] = ids
        found |= self._new_pieces(new)
        for chunk, pieces in split.items():
            out[chunk] = b"".join([found[x] for x in pieces])
        for known, most in ((out, 64), (found, 1 << 40)):
            for chunk, ids in known.items():
                if len(chunk) < most:
                    if len(self._kept) >= CACHE:
                        self._old, self._kept = self._kept, {}
                    self._kept[chunk] = ids
        return found | out

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; what no text before had is encoded once for all of them."""
        sizes, chunks, out = [], [], []
        for text in texts:
            own = CHUNK.findall(text)
            sizes.append(len(own))
            chunks += own
        for first in range(0, len(chunks), AT_ONCE):
            part = chunks[first : first + AT_ONCE]
            ids = list(map(self._kept.get, part))
            missing = [i for i, known in enumerate(ids) if known is None]
            new = self._some({part[i] for i in missing})
            for i in missing:
                ids[i] = new[part[i]]
            out += ids
        ends = np.cumsum([0, *sizes]).tolist()
        return [np.frombuffer(b"".join(out[i:j]), "<i4") for i, j in pairwise(ends)]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode_all(self, ids: pa.Array) -> pa.Array:
        """The bytes of each row of lists of ids; a null row gives none."""
        if self._by_id is None:
            self._by_id = pa.array([self.bytes_of.get(i) for i in range(max(self.bytes_of) + 1)], pa.binary())
        found = self._by_id.take(ids.flatten())
        if found.null_count:
            raise KeyError("ids without a token")
        data, at = string_buffers(found)
        ends = np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False))
        offsets = at[np.concatenate([[0], ends])].astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


@lru_cache(2)
def load(path: str, pattern: str) -> BytePairs:
    with open(path, "rb") as lines:
        return BytePairs({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}, pattern)


def ids_column(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(x) for x in arrays], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int32), pa.int32()))


def bpe_encode(df: DataFrame, path: str, pattern: str, text: str = "text", to: str = "ids") -> DataFrame:
    """df without `text` and with the ids of the whole text in `to`, an array<int>."""
    kept = [c for c in df.columns if c not in (text, to)]
    named = df.select(*kept, whole_text(text).alias(to))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load(path, pattern)
        for batch in batches:
            for part in slices(batch, to, SLICE):
                ids = ids_column(coder.encode_all(part.column(to).to_pylist()))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], ids], [*kept, to])

    return named.mapInArrow(tidy(run), T.StructType([*named.schema.fields[:-1], T.StructField(to, T.ArrayType(T.IntegerType()))]))


def bpe_decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", to: str = "bytes") -> DataFrame:
    """df with the bytes that `ids` stand for in `to`; null ids give no bytes."""
    kept = [c for c in df.columns if c != to]
    named = df.select(*kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load(path, pattern)
        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                part = batch.slice(first, 1000)
                yield pa.RecordBatch.from_arrays([*part.columns, coder.decode_all(part.column(ids))], [*kept, to])

    return named.mapInArrow(tidy(run), T.StructType([*named.schema.fields, T.StructField(to, T.BinaryType())]))


def bpe_digest(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document: the number of ids and hashes of the ids and of the bytes decoded from them."""
    coded = bpe_decode(bpe_encode(df.select("doc_id", "text"), path, pattern), path, pattern)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )
