"""Line dedup by an exact set-similarity join.

A line is the set of its words. Words are ordered by rarity (counts of a fixed number of hash buckets, so what
tasks share has a bound), and two lines whose Jaccard similarity is 0.8 or more share a word among the first
n - ceil(0.8 n) + 1 of each. Lines meet at such words; length, position and a 64-bit parity map of the words rule
out most pairs, and the true words decide. A line is removed if it equals, or has that similarity to, a line
that comes earlier in the order of doc_id, line number and text.

Equal lines (as sets of words) are one class; only its first line is compared. At each word a class reports
a few earlier candidates, or of many the earliest; a class with many, none of which holds, has all of them looked
at in a second round, so none is missed and groups of near copies never give all their pairs.

Candidates are told apart by a wider map of their words first, then the nearest of each class is compared by its text, and
the others only where it doesn't hold. The second round works on rows that the first one has stored.

Defined results: null and empty texts have one empty line; lines without words are kept; a null doc_id comes
first; of repeated rows the second loses all its lines with words; words of any length count as one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import IS_SPACE, ODD, fresh, in_blocks, materialise, mix, slices, span_hashes, string_buffers, tidy, whole_text, word_spans

#: Buckets of word counts, and the parts in which tasks send them.
BUCKETS, PARTS = 1 << 24, 64
#: Classes that are common enough to be sent to all tasks, at most.
HOT = 1000
#: Bits of the map of lines whose text is asked for.
ASKED = 1 << 24
#: The least Jaccard similarity is UP / DOWN.
UP, DOWN = 4, 5
FIRST = -(1 << 63)


class Bounds:
    """The lines of some texts: text, number within it, and bounds of the bytes."""

    def __init__(self, texts: pa.Array):
        self.data, offsets = string_buffers(texts)
        breaks = np.flatnonzero(self.data == 10)
        self.count = np.bincount(np.searchsorted(offsets[1:], breaks, "right"), minlength=len(texts)) + 1
        self.start = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
        self.end = np.sort(np.concatenate([offsets[1:], breaks]), kind="stable")
        self.text = np.repeat(np.arange(len(texts)), self.count)
        self.number = np.arange(len(self.text)) - np.repeat(np.cumsum(self.count) - self.count, self.count)
        self.offsets = offsets

    def line(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()

    def has_words(self) -> np.ndarray:
        letters = np.concatenate([[0], np.cumsum(~IS_SPACE[self.data])])
        return letters[self.end] > letters[self.start]


class Lines(Bounds):
    """Lines and the words of those that have any."""

    def __init__(self, texts: pa.Array):
        super().__init__(texts)
        starts, ends, _ = word_spans(self.data, self.offsets)
        self.words = span_hashes(self.data, starts, ends)
        # an empty line shares its start with the next one and has no words
        first = np.searchsorted(starts, self.start)
        n = np.diff(np.append(first, len(starts)))
        self.filled = np.flatnonzero(n)
        # of the filled lines: the words of each once, in the order of their hashes, and the line of each
        self.words, self.nth = distinct(self.words, np.repeat(np.arange(len(self.filled)), n[self.filled]))
        n = np.bincount(self.nth, minlength=len(self.filled))
        self.begin, n = np.cumsum(n) - n, n.astype(np.uint64)
        total = np.add.reduceat(mix(self.words), self.begin) if len(self.begin) else np.zeros(0, np.uint64)
        self.key = mix(total + n * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)  # of the filled lines
        self.size = n.astype(np.int32)

    def wide(self) -> tuple[np.ndarray, np.ndarray]:
        """The two halves of a parity map of 128 bits of each filled line, by other bits of the hashes than in `prefixes`."""
        bit = np.uint64(1) << (self.words >> np.uint64(40) & np.uint64(63))
        low = (self.words >> np.uint64(46) & np.uint64(1)).astype(bool)
        halves = (np.where(half, bit, np.uint64(0)) for half in (low, ~low))
        return tuple(np.bitwise_xor.reduceat(x, self.begin).view(np.int64) if len(self.begin) else np.zeros(0, np.int64) for x in halves)


def distinct(words: np.ndarray, nth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of each line once, by line and hash, and their lines."""
    line = nth.astype(np.uint64)
    order = np.argsort(line << np.uint64(40) | words >> np.uint64(24))
    own, at = words[order], nth[order]
    mixed_up = (at[1:] < at[:-1]) | (at[1:] == at[:-1]) & (own[1:] < own[:-1])
    if mixed_up.any():  # lines of more than 24 bits, or words that agree in 40 bits
        order = np.lexsort((words, nth))
        own, at = words[order], nth[order]
    new = np.ones(len(own), bool)
    new[1:] = (at[1:] != at[:-1]) | (own[1:] != own[:-1])
    return own[new], at[new]


def rarity(counts: np.ndarray) -> np.ndarray:
    """Counts on a logarithmic scale of one byte: 0 for none, 1 for one, and so on up."""
    return np.minimum(np.ceil(8 * np.log2(counts + 1.0) - 7), 255).clip(0).astype(np.uint8)


def prefixes(lines: Lines, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rows of filled line, packed word, size and place, the word before, and parity map for the prefix of every line
    of four words or more; smaller sets have that similarity to equal sets alone."""
    words, nth = lines.words, lines.nth.astype(np.uint64)
    rare = counts[(words & np.uint64(BUCKETS - 1)).astype(np.int64)]
    place = nth << np.uint64(40) | rare.astype(np.uint64) << np.uint64(32) | words >> np.uint64(32)
    order = np.argsort(place)
    place = place[order]
    if np.any(place[1:] == place[:-1]) or np.any(nth >> np.uint64(24)):  # words that agree in 32 bits stand in the order of their hashes, in every line
        order = np.lexsort((words, rare, nth))
    nth, words, rare = nth[order].astype(np.int64), words[order], rare[order]
    size = np.bincount(nth, minlength=len(lines.filled))
    begin = np.cumsum(size) - size
    filled = np.flatnonzero(size)
    bit = np.uint64(1) << (words >> np.uint64(32) & np.uint64(63))
    parity = np.zeros(len(size), np.uint64)
    if len(filled):
        parity[filled] = np.bitwise_xor.reduceat(bit, begin[filled])
    place = np.arange(len(words)) - begin[nth]
    least = -(-UP * size // DOWN)
    taken = (place < (size - least + 1)[nth]) & (size[nth] >= 4)
    # a word that no other line holds can't be shared
    taken &= rare > 1
    half = words >> np.uint64(33)
    before = np.zeros(len(words), np.uint64)
    before[1:] = half[:-1] + np.uint64(1)
    before[place == 0] = 0
    at = nth[taken]
    # half of the word's hash, the size and the place in one number, in this order
    packed = (half[taken] << np.uint64(32)) | np.minimum(size[at], LONGEST).astype(np.uint64) << np.uint64(16) | np.minimum(place[taken], LONGEST).astype(np.uint64)
    return at, packed.view(np.int64), before[taken].view(np.int64), parity[at].view(np.int64)


#: Sizes from here on are only known to be as large.
LONGEST = (1 << 16) - 1
#: Candidates of a class and a word that are all reported; of more, the nearest and the earliest are.
REPORTED = 4
#: line: the number of the line and the word before, 32 bits each.
COLUMNS = ("packed", "key", "doc", "line", "parity")
SHAPE = ", ".join(f"{c} long" for c in COLUMNS)
#: Rows of a range of words travel as arrays: of so many rows a task makes one of each range, at most.
GATHERED = 400_000
BUNDLES = "part int, " + ", ".join(f"{c} array<long>" for c in COLUMNS)


def ranges(spark: SparkSession) -> int:
    """Ranges of words, some for each task."""
    return 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def bundled(pieces: Iterator[list[np.ndarray]], parts: int) -> Iterator[pa.RecordBatch]:
    """Rows, given as their columns, with an array of each column for each range of words."""
    kept: list[list[np.ndarray]] = []

    def flush() -> pa.RecordBatch:
        columns = [np.concatenate(x) for x in zip(*kept, strict=True)]
        order = np.argsort(columns[0])
        columns = [x[order] for x in columns]
        part = (columns[0] >> 32) * parts >> 31
        first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        at = pa.array(np.append(first, len(part)).astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array(part[first].astype(np.int32)), *(pa.ListArray.from_arrays(at, pa.array(x)) for x in columns)], ["part", *COLUMNS])

    n = 0
    for columns in pieces:
        if len(columns[0]):
            kept.append(columns)
            n += len(columns[0])
        if n >= GATHERED:
            yield flush()
            kept, n = [], 0
    if kept:
        yield flush()


def shared(rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Without the rows whose word has no other row; rows of a word stand together."""
    word = rows["packed"] >> 32
    n = np.diff(np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1], [True]]))) if len(word) else word
    several = np.repeat(n > 1, n)
    return {c: rows[c][several] for c in COLUMNS}


def matches(rows: dict[str, np.ndarray], wanted: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Candidates (key, earlier key, word, whether there are more) of rows in the order of packed. wanted: a map of the
    classes of which all are given. Pairs with the same word before meet there already, and on to where they don't."""
    return measured(rows, wanted)[:4]


def measured(rows: dict[str, np.ndarray], wanted: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """The columns of `matches`, and the bits in which the parity maps of the pair differ."""
    rows = shared(rows)
    n = len(rows["packed"])
    # rows of one word and class: the first line of the class stands for it
    order = np.lexsort((rows["line"], rows["doc"], rows["key"], rows["packed"] >> 16))
    packed, key = rows["packed"][order], rows["key"][order]
    new = np.ones(n, bool)
    new[1:] = (packed[1:] >> 16 != packed[:-1] >> 16) | (key[1:] != key[:-1])
    packed, key, doc, line, parity = shared({c: rows[c][order][new] for c in COLUMNS}).values()
    word, size, place, before, n = packed >> 32, packed >> 16 & LONGEST, packed & LONGEST, line & 0xFFFFFFFF, len(packed)
    parity, long = parity.view(np.uint64), size == LONGEST
    is_open = np.zeros(n, bool) if wanted is None else in_map(wanted, key)
    time = np.empty(n, np.int64)
    time[np.lexsort((key, line >> 32, doc))] = np.arange(n)
    count, first, near, best = np.zeros(n, np.int64), np.arange(n), np.zeros(n, np.int64), np.full(n, 1 << 30)
    slots, spans = np.zeros((2, n, max(1, REPORTED)), np.int64)
    far = np.zeros(n, np.int64)  # of the first
    later_of, earlier_of, apart_of = [], [], []
    at = np.arange(n)
    for step in range(1, n):
        at = at[at + step < n]
        at = at[(word[at] == word[at + step]) & ((DOWN * size[at] >= UP * size[at + step]) | long[at + step])]
        if not len(at):
            break
        i, j = at, at + step
        both = size[i] + size[j]
        need = -(-UP * both // (UP + DOWN))
        apart = np.bitwise_count(parity[i] ^ parity[j]).astype(np.int64)
        good = (1 + np.minimum(size[i] - 1 - place[i], size[j] - 1 - place[j]) >= need) & (apart <= both - 2 * need) | long[j]
        good &= (before[i] != before[j]) | (before[i] == 0)
        i, j, apart = i[good], j[good], apart[good]
        swap = time[i] > time[j]
        for who, other, d in ((i[swap], j[swap], apart[swap]), (j[~swap], i[~swap], apart[~swap])):
            if wanted is not None:
                later_of.append(who[is_open[who]]), earlier_of.append(other[is_open[who]]), apart_of.append(d[is_open[who]])
                continue
            sooner = time[other] < time[first[who]]
            first[who[sooner]], far[who[sooner]] = other[sooner], d[sooner]
            nearer = (d < best[who]) | (d == best[who]) & (time[other] < time[near[who]])
            best[who[nearer]], near[who[nearer]] = d[nearer], other[nearer]
            few = count[who] < REPORTED
            slots[who[few], count[who[few]]], spans[who[few], count[who[few]]] = other[few], d[few]
            count[who] += 1
    if wanted is None:
        some, many = np.flatnonzero((count > 0) & (count <= REPORTED)), np.flatnonzero(count > REPORTED)
        two = many[near[many] != first[many]]
        later_of = [some[count[some] > k] for k in range(REPORTED)] + [many, two]
        earlier_of = [slots[some[count[some] > k], k] for k in range(REPORTED)] + [first[many], near[two]]
        apart_of = [spans[some[count[some] > k], k] for k in range(REPORTED)] + [far[many], best[two]]
    a, b, d = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (later_of, earlier_of, apart_of))
    return key[a], key[b], word[a], count[a] > REPORTED, d


def candidates(postings: DataFrame, wanted=None) -> DataFrame:
    """later, earlier, word, more, apart: classes that may be similar. wanted: a broadcast map of the only classes to give,
    with all of theirs; without it, also the rows of the words at which a class has more, with no `later`. postings: bundles."""
    parts = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = postings.repartition(parts, "part").sortWithinPartitions("part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> Iterator[pa.RecordBatch]:
            columns = [np.concatenate(x) for x in zip(*kept, strict=True)]
            order = np.argsort(columns[0])
            rows = {c: x[order] for c, x in zip(COLUMNS, columns, strict=True)}
            later, earlier, word, more, apart = measured(rows, wanted and wanted.value)
            pairs = [pa.array(x) for x in (later, earlier, word, more, apart.astype(np.int32))]
            none = [pa.nulls(len(later), pa.int64())] * len(COLUMNS)
            yield pa.RecordBatch.from_arrays([*pairs, *none], names)
            if wanted is None and more.any():
                again = np.isin(rows["packed"] >> 32, np.unique(word[more]))
                own = [pa.array(rows[c][again]) for c in COLUMNS]
                none = [pa.nulls(len(own[0]), kind) for kind in (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32())]
                none[2] = pa.array(rows["packed"][again] >> 32)
                yield pa.RecordBatch.from_arrays([*none, *own], names)

        names = ["later", "earlier", "word", "more", "apart", *COLUMNS]
        kept: list[list[np.ndarray]] = []
        now = None
        for batch in batches:
            part = batch.column("part").to_numpy()
            at, values = ([f(batch.column(c)) for c in COLUMNS] for f in (lambda x: x.offsets.to_numpy(), lambda x: x.values.to_numpy()))
            cuts = np.flatnonzero(part[1:] != part[:-1]) + 1
            for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(part)], strict=True):
                if low == high:
                    continue
                if kept and part[low] != now:
                    yield from flush()
                    kept = []
                now = part[low]
                kept.append([x[o[low] : o[high]] for x, o in zip(values, at, strict=True)])
        if kept:
            yield from flush()

    return dealt.mapInArrow(tidy(run), "later long, earlier long, word long, more boolean, apart int, " + SHAPE)


def similar(a: bytes, b: bytes) -> bool:
    one, other = set(a.split()), set(b.split())
    common = len(one & other)
    return DOWN * common >= UP * (len(one) + len(other) - common)


def key_map(keys: DataFrame) -> np.ndarray:
    """A map with one bit for the low bits of each key; what comes to the driver has a fixed bound."""
    at = F.col("key").bitwiseAND(F.lit(ASKED - 1))
    bits = keys.groupBy(F.shiftright(at, 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(key & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(ASKED >> 6, np.int64)
    out[bits.column("at").to_numpy()] = bits.column("bits").to_numpy()
    return out.view(np.uint64)


def in_map(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    low = keys.view(np.uint64) & np.uint64(ASKED - 1)
    return (bits[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63)) & np.uint64(1)).astype(bool)


#: Spreads the numbers of lines; the product with one stays small.
STEP = 40503


def spots(mark: np.ndarray, number: np.ndarray) -> np.ndarray:
    return mark ^ number.astype(np.int64) * STEP


def likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs that wide maps of the words don't rule out: later, earlier, bits that differ, and where their first lines stand."""
    one, other = (classes.select(F.col("key").alias(k), F.col("keep").alias(f"{k}_at")) for k in ("later", "earlier"))
    met = pairs.join(one, "later").join(other, "earlier")
    both = "(later_at.size + earlier_at.size)"
    need = f"(({UP} * {both} + {UP + DOWN - 1}) div {UP + DOWN})"
    apart = F.expr("bit_count(later_at.low ^ earlier_at.low) + bit_count(later_at.high ^ earlier_at.high)")
    place = ["doc", "number", "mark"]
    ends = [F.struct(*(F.col(f"{k}_at.{c}").alias(c) for c in place)).alias(f"{k}_at") for k in ("later", "earlier")]
    return met.withColumn("far", apart).where(F.col("far") <= F.expr(f"{both} - 2 * {need}")).select("later", "earlier", "far", *ends)


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Of the pairs that `likely` gives those whose lines are similar. The first lines of the classes are fetched from the
    documents by a map of where they stand, so no words are looked at there."""
    ends = F.array(*(F.struct(F.col(k).alias("key"), F.col(f"{k}_at").alias("at")) for k in ("later", "earlier")))
    asked = materialise(pairs.select(F.explode(ends).alias("end")).select("end.key", "end.at.*").distinct())
    spot = F.col("mark").bitwiseXOR(F.col("number").cast("long") * STEP)
    known = pairs.sparkSession.sparkContext.broadcast(key_map(asked.select(spot.alias("key"))))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                lines = Bounds(part.column("text"))
                doc, mark = (part.column(c).to_numpy()[lines.text] for c in ("_doc", "_mark"))
                hit = np.flatnonzero(in_map(known.value, spots(mark, lines.number)))
                yield pa.RecordBatch.from_arrays([pa.array(doc[hit]), pa.array(mark[hit]), pa.array(lines.number[hit].astype(np.int32)), pa.array([lines.line(i) for i in hit], pa.binary())], ["doc", "mark", "number", "line"])

    place = ["doc", "mark", "number"]
    texts = docs.select("text", "_doc", "_mark").mapInArrow(tidy(fetch), "doc long, mark long, number int, line binary").join(asked, place)
    texts = materialise(texts.groupBy(*place, "key").agg(F.first("line").alias("line")).select("key", "line"))
    one, other = (texts.select(F.col("key").alias(k), F.col("line").alias(f"{k}_line")) for k in ("later", "earlier"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [similar(a, b) for a, b in zip(batch.column("later_line").to_pylist(), batch.column("earlier_line").to_pylist(), strict=True)]
            yield batch.select(["later", "earlier"]).filter(pa.array(good, pa.bool_()))

    return pairs.select("later", "earlier").join(one, "later").join(other, "earlier").select("later", "earlier", "later_line", "earlier_line").mapInArrow(tidy(check), "later long, earlier long")


def dedup_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with `text` without the lines that match an earlier one, and n_lines and n_removed (with a sign after the
    name where docs has such a column)."""
    plain = docs.select(*(F.col(f"`{c}`").alias({"doc_id": "doc_id", text: "text"}.get(c, f"_c{i}")) for i, c in enumerate(docs.columns)))
    found = _dedup_lines(plain)
    return found.toDF(*docs.columns, fresh(docs, "n_lines"), fresh(docs, "n_removed"))


def _dedup_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c != text]
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST))
    blocks = in_blocks(docs.withColumns({"text": whole_text(text), "_doc": order}).select(*[c for c in kept], "text", "_doc")).withColumn("_mark", F.xxhash64("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows for lines (block, key, doc, number, mark) and, with block -1, the packed counts of a part of the buckets."""
        counts = np.zeros(BUCKETS, np.uint32)
        names = ["_block", "key", "doc", "number", "mark", "low", "high", "size", "counts"]
        for batch in batches:
            for part in slices(batch, "text"):
                lines = Lines(part.column("text"))
                own = np.sort((lines.words & np.uint64(BUCKETS - 1)).astype(np.uint32))
                first = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, np.int64)
                counts[own[first]] += np.diff(np.append(first, len(own))).astype(np.uint32)
                at = lines.text[lines.filled]
                columns = (part.column("_block").to_numpy()[at], lines.key, part.column("_doc").to_numpy()[at], lines.number[lines.filled].astype(np.int32), part.column("_mark").to_numpy()[at], *lines.wide(), lines.size)
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.nulls(len(at), pa.binary())], names)
        for k, own in enumerate(np.split(counts, PARTS)):
            if own.any():
                one = pa.array([0], pa.int64())
                none = pa.array([0], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([k], pa.int64()), one, none, one, one, one, none, pa.array([zstandard.compress(own.tobytes())], pa.binary())], names)

    def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of the counts of each part that a task has."""
        sums: dict[int, np.ndarray] = {}
        for batch in parts:
            for k, raw in zip(batch.column("key").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                own = np.frombuffer(zstandard.decompress(raw), np.uint32)
                sums[k] = sums.get(k, 0) + own.astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([zstandard.compress(rarity(x).tobytes()) for x in sums.values()], pa.binary())], ["key", "codes"])

    lines = materialise(blocks.select("text", "_block", "_doc", "_mark").mapInArrow(tidy(scan), "_block int, key long, doc long, number int, mark long, low long, high long, size int, counts binary"))
    codes = np.zeros((PARTS, BUCKETS // PARTS), np.uint8)
    for row in lines.where("_block = -1").select("key", "counts").repartition(PARTS, "key").mapInArrow(tidy(add), "key long, codes binary").collect():  # PARTS rows, of a fixed size together
        codes[row["key"]] = np.frombuffer(zstandard.decompress(bytes(row["codes"])), np.uint8)
    counts = spark.sparkContext.broadcast(zstandard.compress(codes.tobytes()))
    lines = lines.where("_block >= 0")
    classes = materialise(lines.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("doc", "number", "mark", "low", "high", "size")).alias("keep")))
    lines = lines.drop("counts", "low", "high", "size")

    parts = ranges(spark)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = np.frombuffer(zstandard.decompress(counts.value), np.uint8)

        def rows() -> Iterator[list[np.ndarray]]:
            for batch in batches:
                for part in slices(batch, "text"):
                    lines = Lines(part.column("text"))
                    at, packed, before, parity = prefixes(lines, codes)
                    line = lines.filled[at]
                    yield [packed, lines.key[at], part.column("_doc").to_numpy()[lines.text[line]], lines.number[line] << 32 | before, parity]

        return bundled(rows(), parts)

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return bundled(([batch.column(c).to_numpy() for c in COLUMNS] for batch in batches), parts)

    found = materialise(candidates(blocks.select("text", "_doc").mapInArrow(tidy(post), BUNDLES)))
    # of the candidates of a class the nearest is looked at first, and mostly holds
    pairs = materialise(likely(found.where("later is not null").select("later", "earlier").distinct(), classes))
    nearest = pairs.groupBy("later").agg(F.min(F.struct("far", "earlier", "later_at", "earlier_at")).alias("best")).select("later", "best.*")
    similar_to = materialise(verified(materialise(nearest), blocks).select(F.col("later").alias("key")).distinct())
    # the rest of the others' candidates; where more were met than reported, all of them, from the rows of those words
    held = similar_to.select(F.col("key").alias("later"))
    rest = pairs.join(held, "later", "left_anti")
    more = materialise(found.where("more").join(held, "later", "left_anti").select("later", "word").distinct())
    if not more.isEmpty():
        again = found.where("later is null").join(more.select("word").distinct(), "word", "left_semi").select(*COLUMNS).mapInArrow(tidy(bundle), BUNDLES)
        doubted = more.select("later").distinct()
        known = spark.sparkContext.broadcast(key_map(doubted.select(F.col("later").alias("key"))))
        rest = rest.union(likely(candidates(again, known).join(doubted, "later", "left_semi").select("later", "earlier").distinct(), classes))
    rest = materialise(rest.join(nearest.select("later", "earlier"), ["later", "earlier"], "left_anti").select(*pairs.columns).distinct())
    if not rest.isEmpty():
        similar_to = similar_to.union(verified(rest, blocks).select(F.col("later").alias("key"))).distinct()

    gone = classes.join(similar_to.withColumn("_similar", F.lit(True)), "key", "left").where("n > 1 or _similar")
    first = (F.col("doc") == F.col("keep.doc")) & (F.col("number") == F.col("keep.number")) & (F.col("mark") == F.col("keep.mark"))
    # classes with more than one in HOT of all lines are at most HOT, so they go to where the lines are
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot, rest = gone.where(F.col("n") > total // HOT), gone.where(F.col("n") <= total // HOT)
    met = lines.join(F.broadcast(hot), "key").unionByName(lines.join(F.broadcast(hot.select("key")), "key", "left_anti").join(rest, "key"))
    told = met.where(F.col("_similar").isNotNull() | ~first).select("_block", "doc", "number", "mark")

    def line_ids(doc: np.ndarray, mark: np.ndarray, number: np.ndarray) -> np.ndarray:
        return mix(mix(doc.astype(np.int64).view(np.uint64)) ^ mark.view(np.uint64)) + number.astype(np.uint64) * np.uint64(ODD)

    def cut(docs: pa.Table, told: pa.Table) -> pa.Table:
        known = np.sort(line_ids(*(told.column(c).to_numpy() for c in ("doc", "mark", "number"))))
        used: set[int] = set()
        texts, n_lines, n_removed = [], [], []
        for batch in docs.to_batches():
            for part in slices(batch, "text"):
                lines = Bounds(part.column("text"))
                doc, mark = (part.column(c).to_numpy() for c in ("_doc", "_mark"))
                own = line_ids(doc[lines.text], mark[lines.text], lines.number)
                removed = known[np.minimum(np.searchsorted(known, own), len(known) - 1)] == own if len(known) else np.zeros(len(own), bool)
                again = np.zeros(part.num_rows, bool)  # of repeated rows the first keeps what it keeps
                for i, row in enumerate(line_ids(doc, mark, np.zeros(len(doc))).tolist()):
                    again[i] = row in used
                    used.add(row)
                if again.any():
                    removed |= again[lines.text] & lines.has_words()
                ends = np.cumsum(lines.count)
                raw = lines.data.tobytes()
                lost = np.concatenate([[0], np.cumsum(removed)])
                for end, count in zip(ends.tolist(), lines.count.tolist(), strict=True):
                    gone = int(lost[end] - lost[end - count])
                    n_lines.append(count), n_removed.append(gone)
                    if gone:
                        texts.append(b"\n".join([raw[lines.start[i] : lines.end[i]] for i in range(end - count, end) if not removed[i]]).decode())
                    else:
                        texts.append(raw[lines.start[end - count] : lines.end[end - 1]].decode())
        columns = [texts if c == text_at else docs.column(c) for c in out_names]
        return pa.table({**dict(zip(out_names, [pa.array(x, pa.string()) if x is texts else x for x in columns], strict=True)), "n_lines": pa.array(n_lines, pa.int64()), "n_removed": pa.array(n_removed, pa.int64())})

    out_names = [c for c in docs.columns if c in kept or c == text]
    text_at = text
    kinds = dict(docs.dtypes) | {text: "string"}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in out_names) + ", n_lines long, n_removed long"
    return blocks.groupBy("_block").cogroup(told.groupBy("_block")).applyInArrow(cut, schema)


def line_report(docs: DataFrame) -> DataFrame:
    found = dedup_lines(docs.select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, str]]) -> list[tuple[int, int, str]]:
    """n_lines, n_removed and the kept text of each row by comparing all lines; for tests."""
    lines = [(doc if doc is not None else FIRST, number, at, line.encode()) for at, (doc, text) in enumerate(rows) for number, line in enumerate((text or "").split("\n"))]
    seen: list[set] = []
    kept: dict[int, list[tuple[int, bytes]]] = {}
    for _doc, number, at, line in sorted(lines, key=lambda x: (x[0], x[1], x[2])):
        words = set(line.split())
        if not words or not any(DOWN * len(words & s) >= UP * len(words | s) for s in seen):
            kept.setdefault(at, []).append((number, line))
        if words:
            seen.append(words)
    out = []
    for at, (_, text) in enumerate(rows):
        own = sorted(kept.get(at, []))
        count = (text or "").count("\n") + 1
        out.append((count, count - len(own), b"\n".join(x for _, x in own).decode()))
    return out
