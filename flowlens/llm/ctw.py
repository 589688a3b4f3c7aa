"""Language-model scores by context-tree weighting, and word unigrams as a base.

A byte is coded by eight binary decisions. A node of the tree is a context (the last 0 to DEPTH bytes, as they are) and
the bits decided so far; it holds the counts of both outcomes over all training texts and their Krichevsky-Trofimov
estimate. Nodes mix their own estimate with that of their children, weighted by how well each coded the training texts,
so all depths take part; no count is dropped, and a context that training never saw repeats the one above it. The code
length of a text is the sum over its bytes and an end sign.

What is counted grows with the input and is never gathered on the driver. Runs of about BLOCK bytes of text are a block,
which asks for its distinct words and its distinct runs of DEPTH + 1 bytes; both travel packed, as sorted numbers of a
share of all keys. Totals are added up by share; the tree is weighed by the two newest context bytes, once to learn
what the upper levels weigh (which have 256 contexts at most) and once to give every run its probability; blocks get
the answers in the order they asked in.

The log10 probability of each byte travels as a float of 16 bits of fraction, which is off by one part in 131,072 at
most, up or down; so a text's score is within 0.00077 % of the unrounded one (over 1,000 documents the largest error
measured is 0.0004 %). With whole floats the query's disk is beyond its budget.

Defined results: null ids train (they are in part 0); further columns are left out, whatever their names; null and empty
texts hold the end token alone; without training texts every estimate is one
half and the base is log10(1 / (0 + 1)) a token; texts of any length are scored whole; repeated rows count.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, give_back, lower_ascii, materialise, slices, span_hashes, string_buffers, whole_text, word_spans

DEPTH = 6
#: Bits of a run of DEPTH context bytes, newest first, and the byte that follows them.
WIDE = 8 * (DEPTH + 1)
#: Bytes of text in a block, of text worked on at a time, and of text for each share of the keys.
BLOCK, SLICE, SHARE = 8 << 20, 1 << 20, 12 << 20
#: Texts, and characters of each, that the ranges of shares are chosen by (they come to the driver).
EDGE_TEXTS, EDGE_CHARS = 512, 8192
#: The end sign of the byte model.
END_BYTE = 0
TEXT, WORDS, RUNS = 0, 1, 2


def byte_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The context and the outcome of each byte and end sign as one number, and where each text starts. The newest
    context byte is the highest, so that contexts stand in the order of the tree; before a text all bytes are 0."""
    stream = np.insert(data, offsets[1:], END_BYTE).astype(np.uint64)
    starts = offsets[:-1] + np.arange(len(offsets) - 1)
    ends = offsets[1:] + np.arange(1, len(offsets))
    runs = stream.copy()
    for step in range(1, DEPTH + 1):
        runs[step:] |= stream[:-step] << np.uint64(WIDE - 8 * step)
    for k in range(DEPTH):
        at = starts + k
        runs[at[at < ends]] &= np.uint64(255 | ((1 << 8 * k) - 1) << (WIDE - 8 * k))
    return runs, starts


def tally(keys: np.ndarray, counted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys (of 63 bits at most) in order, and how often each is counted."""
    both = np.sort(keys << np.uint64(1) | counted.astype(np.uint64))
    own = both >> np.uint64(1)
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
    return own[first], np.add.reduceat((both & np.uint64(1)).astype(np.int64), first) if len(first) else np.zeros(0, np.int64)


def merged(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their counts; the lists are emptied on the way, as both are large."""
    keys, n = np.concatenate([k for k, _ in found]), np.concatenate([n for _, n in found]).astype(np.int64)
    found.clear()
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    del order
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def added(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the sums of their counts, and where each of the given ones is among them."""
    keys, at = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
    return keys, np.bincount(at, weights=np.concatenate([n for _, n in found]), minlength=len(keys)).astype(np.int64), at


def squeeze(values: np.ndarray) -> bytes:
    """Numbers as compressed planes of bytes."""
    return zstandard.compress(values.view(np.uint8).reshape(len(values), -1).T.tobytes(), 1)


def expand(data: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(kind)


def pack(keys: np.ndarray, values: np.ndarray) -> list[bytes]:
    """Sorted keys as their differences, and a value for each."""
    return [squeeze(np.diff(keys, prepend=np.uint64(0))), squeeze(values)]


def unpack(keys: bytes, values: bytes, kind: type = np.int64) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(expand(keys, np.uint64), dtype=np.uint64), expand(values, kind)


def share_of(keys: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The share of all runs that a run belongs to; shares are ranges, so that runs of one share have much in common."""
    return np.searchsorted(edges, keys, "right")


def share_edges(texts: list[str], shares: int) -> np.ndarray:
    """Where ranges begin that have about equally many of the texts' distinct runs. Other texts make the ranges more or
    less even, and nothing else."""
    column = pa.array(texts, pa.string())
    keys = np.unique(byte_runs(lower_ascii(string_buffers(column)[0]), string_buffers(column)[1])[0])
    at = np.arange(1, shares) * len(keys) // shares
    return np.unique(keys[at]) if len(keys) else keys


def word_share(keys: np.ndarray, shares: int) -> np.ndarray:
    """The share of all words; shares are ranges of the 63-bit keys."""
    return np.minimum(keys // np.uint64((1 << 63) // shares), np.uint64(shares - 1)).astype(np.int64)


def by_share(share: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(share, kind="stable")
    cuts = np.flatnonzero(np.diff(share[order])) + 1
    for own in np.split(order, cuts) if len(order) else []:
        yield int(share[own[0]]), own


def keys_of(texts: pa.Array) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray], np.ndarray]:
    """The key and the text of every word, every run and where each text's begin, and the bytes of each text."""
    data, offsets = string_buffers(texts)
    data = lower_ascii(data)
    starts, ends, text = word_spans(data, offsets)
    return (span_hashes(data, starts, ends) >> np.uint64(1), text), byte_runs(data, offsets), np.diff(offsets)


def distinct_of(keys: np.ndarray) -> np.ndarray:
    own = np.sort(keys)
    return own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) else own


def looked_up(keys: np.ndarray, known: np.ndarray, answers: np.ndarray) -> np.ndarray:
    """The answer to each key; known: distinct keys in order, the given ones among them. Only distinct keys are searched
    for, and in order, as a search for each takes several times as long."""
    order = np.argsort(keys)
    own = keys[order]
    new = np.concatenate([[True], own[1:] != own[:-1]]) if len(own) else np.zeros(0, bool)
    out = np.empty(len(keys), answers.dtype)
    out[order] = answers[np.searchsorted(known, own[new])][np.cumsum(new) - 1]
    return out


class Asked:
    """What the texts of a block ask for; slices are added one by one."""

    def __init__(self):
        self.words, self.runs = [], []

    def add(self, texts: pa.Array, train: np.ndarray) -> None:
        (words, text), (runs, _), sizes = keys_of(texts)
        self.words.append(tally(words, train[text]))
        self.runs.append(tally(runs, np.repeat(train, sizes + 1)))

    def keys(self) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        return merged(self.words), merged(self.runs)


def log_kt(seen: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov probability of counts (…, 2) of zeros and ones."""
    zeros, ones = seen[..., 0], seen[..., 1]  # empty nodes have probability one
    return log_gamma(zeros, 0.5) + log_gamma(ones, 0.5) - log_gamma(zeros + ones, 1.0) - np.log(np.pi)


@lru_cache(2)
def gamma_table(shift: float, size: int = 1 << 14) -> np.ndarray:
    """log gamma(k + shift) for k below size."""
    first = 0.5 * np.log(np.pi) if shift == 0.5 else 0.0
    return first + np.concatenate([[0.0], np.cumsum(np.log(np.arange(size - 1) + shift))])


def log_gamma(k: np.ndarray, shift: float) -> np.ndarray:
    """log gamma(k + shift) of counts: from the table, and above it by Stirling's series."""
    table, k = gamma_table(shift), np.asarray(k, np.int64)
    out = table[np.minimum(k, len(table) - 1)]
    large = np.flatnonzero(k.reshape(-1) >= len(table))
    if len(large):
        y = k.reshape(-1)[large] + shift
        out.reshape(-1)[large] = (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3)
    return out


def guess(seen: np.ndarray) -> np.ndarray:
    """The estimate of a one."""
    return (seen[..., 1] + 0.5) / (seen.sum(-1) + 1.0)


def bit_counts(cells: np.ndarray) -> np.ndarray:
    """Counts (…, 256) of bytes to counts (…, 256, 2) of decisions; node 1 is the first bit, node 2k + b follows."""
    out = np.zeros((*cells.shape, 2), np.int64)
    level = cells.astype(np.int64)
    for depth in range(7, -1, -1):
        pairs = level.reshape(*cells.shape[:-1], 1 << depth, 2)
        out[..., 1 << depth : 2 << depth, :] = pairs
        level = pairs.sum(-1)
    return out


class Subtree:
    """The part of the tree below one context of two bytes: levels 2 to DEPTH. The eight decisions of a byte don't share
    nodes, so they are worked on one by one, and only one's nodes are held."""

    def __init__(self, runs: np.ndarray, counts: np.ndarray):
        """runs: distinct and in order."""
        self.runs, self.cells = runs, [(runs, counts)]
        self.up: list[np.ndarray] = [np.zeros(0, np.int64)]  # of each cell but those of level 2 the cell above
        for depth in range(DEPTH - 1, 1, -1):  # a cell of a level: its context and the outcome
            below, n = self.cells[0]
            cells, at = np.unique(below >> np.uint64(8 + 8 * (DEPTH - depth)) << np.uint64(8 + 8 * (DEPTH - depth)) | below & np.uint64(255), return_inverse=True)
            self.cells.insert(0, (cells, np.bincount(at, weights=n).astype(np.int64)))
            self.up.insert(1, at)

    def _levels(self, bit: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Of each level: the nodes in order, their counts, the node above of each, and their log weights."""
        found, number = [], np.zeros(0, np.int64)
        for depth, ((cells, n), up) in enumerate(zip(self.cells, self.up, strict=True), 2):
            # the context's bytes and behind them the decided bits; cells are in order, and so are nodes
            node = cells >> np.uint64(8 + 8 * (DEPTH - depth)) << np.uint64(bit) | (cells & np.uint64(255)) >> np.uint64(8 - bit)
            one = (cells >> np.uint64(7 - bit) & np.uint64(1)).astype(np.int64)
            new = np.concatenate([[True], node[1:] != node[:-1]])
            first = np.flatnonzero(new)
            seen = np.stack([np.add.reduceat(n * (1 - one), first), np.add.reduceat(n * one, first)], axis=1)
            above = number[up[first]] if found else up
            number = np.cumsum(new) - 1
            found.append((node[first], seen, above))
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for depth in range(len(found) - 1, -1, -1):
            node, seen, above = found[depth]
            weight = log_kt(seen)
            if out:
                weight = np.log(0.5) + np.logaddexp(weight, np.bincount(out[0][2], weights=out[0][3], minlength=len(node)))
            out.insert(0, (node, seen, above, weight))
        return out

    def top(self) -> np.ndarray:
        """Log weights of the nodes (by number) of the context of two bytes."""
        out = np.zeros(256)
        for bit in range(8):
            node, _, _, weight = self._levels(bit)[0]
            out[(1 << bit) + (node & np.uint64((1 << bit) - 1)).astype(np.int64)] = weight
        return out

    def chances(self, above: np.ndarray) -> np.ndarray:
        """log10 probability of every run; above: of the context of one byte, for each node, the chance of a one,
        the share of it that is settled, and the share that is left to deeper contexts."""
        total = np.zeros(len(self.runs))
        for bit in range(8):
            levels = self._levels(bit)
            number = (1 << bit) + (levels[0][0] & np.uint64((1 << bit) - 1)).astype(np.int64)
            chance, settled, left = above[:, number]
            for depth, (_, seen, at, weight) in enumerate(levels):
                if depth:
                    chance, settled, left = chance[at], settled[at], left[at]
                chance, settled, left = deepen(seen, weight, chance, settled, left)
            node = self.runs >> np.uint64(8 - bit)
            at = np.cumsum(np.concatenate([[False], node[1:] != node[:-1]]))
            one = (self.runs >> np.uint64(7 - bit) & np.uint64(1)).astype(bool)
            total += np.log10(np.where(one, chance[at], 1 - chance[at]))
        return total


def deepen(seen: np.ndarray, weight: np.ndarray, chance: np.ndarray, settled: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One level further down: the chance of a one if no deeper context is known, what of it is settled at this
    level, and the share left to deeper ones. Nodes without counts repeat what is above them."""
    own = guess(seen)
    share = np.exp(np.minimum(np.log(0.5) + log_kt(seen) - weight, 0.0))
    return np.where(seen.sum(-1) > 0, settled + left * own, chance), settled + left * share * own, left * (1 - share)


def upper(counts: np.ndarray, deeper: np.ndarray) -> np.ndarray:
    """counts (256, 256) of newest byte and outcome, deeper (256, 256): log weights below, by newest byte and node. The
    three tables of deepen() for every context of one byte and node."""
    one, none = bit_counts(counts), bit_counts(counts.sum(0))
    weight = np.log(0.5) + np.logaddexp(log_kt(one), deeper)
    root = np.log(0.5) + np.logaddexp(log_kt(none), weight.sum(0))
    state = deepen(none, root, np.full(256, 0.5), np.zeros(256), np.ones(256))
    return np.stack(deepen(one, weight, *state))


def train_and_score(docs: DataFrame, parts: int = 7, held: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte of every text."""
    spark = docs.sparkSession
    id_kind = dict(docs.dtypes)["doc_id"]
    named = docs.select("doc_id", whole_text().alias("text"), (fold("doc_id", parts) == held).alias("held_out"))
    size = named.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count_if(~F.col("held_out"))).first()
    shares, n_docs = max(size[0] // SHARE + 1, spark.sparkContext.defaultParallelism), int(size[1])
    packed = "part long, block long, keys binary, counts binary"
    # hashes choose the texts first, so that no task sends texts that aren't among them
    hashed = named.select(F.xxhash64("text").alias("h"), F.substring("text", 1, EDGE_CHARS).alias("t"))
    last = hashed.select("h").orderBy("h").limit(EDGE_TEXTS).agg(F.max("h")).first()[0]
    some = hashed.where(F.col("h") <= (0 if last is None else last)).distinct().limit(EDGE_TEXTS).collect()
    edges = share_edges([r["t"] for r in some], shares)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (kind, part, block, keys, counts): the texts of a block, and the words and runs that they ask for."""
        block, kept, asked, held_bytes = TaskContext.get().partitionId() << 32, [], Asked(), 0

        def flush() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, kept[0].schema) as out:
                for part in kept:
                    out.write_batch(part)
            rows = [(TEXT, 0, zstandard.compress(sink.getvalue(), 3), None)]
            for kind, (keys, n), share, by in zip((WORDS, RUNS), asked.keys(), (word_share, share_of), (shares, edges), strict=True):
                rows += [(kind, part, *pack(keys[own], n[own])) for part, own in by_share(share(keys, by))]
            kinds, part, keys, n = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(part, pa.int64()), pa.array([block] * len(rows), pa.int64()), pa.array(keys, pa.binary()), pa.array(n, pa.binary())], ["kind", "part", "block", "keys", "counts"])

        for batch in batches:
            for part in slices(batch, "text", SLICE):
                asked.add(part.column("text"), ~part.column("held_out").to_numpy(zero_copy_only=False))
                kept.append(part)
                held_bytes += part.column("text").nbytes
                if held_bytes >= BLOCK:
                    yield flush()
                    block, kept, asked, held_bytes = block + 1, [], Asked(), 0
                    give_back()
        if kept:
            yield flush()

    stored = materialise(named.mapInArrow(gather, f"kind int, {packed}"))

    def count_words(rows: pa.Table) -> pa.Table:
        """Answers for each block that asked, and with block -1 the words of the share: all and distinct ones."""
        found = [unpack(k, n) for k, n in zip(rows.column("keys").to_pylist(), rows.column("counts").to_pylist(), strict=True)]
        _, total, at = added(found)
        cuts = np.cumsum([len(k) for k, _ in found])[:-1]
        part = rows.column("part")[0].as_py()
        answers = [squeeze(x) for x in np.split(total[at], cuts)]
        return pa.table({
            "part": pa.array([part] * (len(found) + 1), pa.int64()), "block": pa.array([*rows.column("block").to_pylist(), -1], pa.int64()), "answer": pa.array([*answers, None], pa.binary()),
            "n": pa.array([*[0] * len(found), int(total.sum())], pa.int64()), "known": pa.array([*[0] * len(found), int(np.count_nonzero(total))], pa.int64()),
        })

    words = materialise(stored.where(F.col("kind") == WORDS).drop("kind").groupBy("part").applyInArrow(count_words, "part long, block long, answer binary, n long, known long"))
    size = words.where("block = -1").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("known"), F.lit(0))).first()
    tokens, distinct = int(size[0]) + n_docs, int(size[1]) + (n_docs > 0)

    def count_runs(rows: pa.Table) -> pa.Table:
        """The runs of a share with their totals, by the two newest context bytes."""
        keys, total, _ = added([unpack(k, n) for k, n in zip(rows.column("keys").to_pylist(), rows.column("counts").to_pylist(), strict=True)])
        newest = (keys >> np.uint64(WIDE - 16)).astype(np.int64)
        out = [(int(newest[own[0]]), *pack(keys[own], total[own])) for _, own in by_share(newest)]
        return pa.table(dict(zip(("newest", "keys", "counts"), (pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)), strict=True)))

    runs = stored.where(F.col("kind") == RUNS).drop("kind")
    totals = materialise(runs.groupBy("part").applyInArrow(count_runs, "newest long, keys binary, counts binary"))

    def subtree(rows: pa.Table) -> tuple[Subtree, np.ndarray]:
        found = [unpack(k, n) for k, n in zip(rows.column("keys").to_pylist(), rows.column("counts").to_pylist(), strict=True)]
        keys, counts = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(keys)
        return Subtree(keys[order], counts[order]), np.bincount((keys & np.uint64(255)).astype(np.int64), weights=counts, minlength=256).astype(np.int64)

    def weigh(rows: pa.Table) -> pa.Table:
        tree, outcomes = subtree(rows)
        return pa.table({"newest": [rows.column("newest")[0].as_py() >> 8], "counts": [outcomes.tolist()], "weights": [tree.top().tolist()]})

    weights = totals.groupBy("newest").applyInArrow(weigh, "newest long, counts array<long>, weights array<double>")
    # the sums of at most 256 contexts by at most 256 outcomes or nodes come to the driver
    summed = weights.select("newest", F.posexplode(F.arrays_zip("counts", "weights")).alias("at", "x")).groupBy("newest", "at").agg(F.sum("x.counts").alias("n"), F.sum("x.weights").alias("w")).toArrow()
    tables = [np.zeros((256, 256), np.int64), np.zeros((256, 256))]
    for table, name in zip(tables, ("n", "w"), strict=True):
        table[summed.column("newest").to_numpy(), summed.column("at").to_numpy()] = summed.column(name).to_numpy()
    above = spark.sparkContext.broadcast(upper(*tables))

    def model(rows: pa.Table) -> pa.Table:
        give_back()
        tree, _ = subtree(rows)
        scores = tree.chances(above.value[:, int(tree.runs[0] >> np.uint64(WIDE - 8))]).astype(np.float32)
        scores = (scores.view(np.uint32) + np.uint32(128) & np.uint32(0xFFFFFF00)).view(np.float32)  # see the docstring
        out = [(part, *pack(tree.runs[own], scores[own])) for part, own in by_share(share_of(tree.runs, edges))]
        return pa.table(dict(zip(("part", "keys", "scores"), (pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)), strict=True)))

    modelled = totals.groupBy("newest").applyInArrow(model, "part long, keys binary, scores binary")

    def answer(known: pa.Table, asked: pa.Table) -> pa.Table:
        give_back()
        found = [unpack(k, s, np.float32) for k, s in zip(known.column("keys").to_pylist(), known.column("scores").to_pylist(), strict=True)]
        keys, scores = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.float32))
        order = np.argsort(keys)
        keys, scores = keys[order], scores[order]
        answers = [squeeze(scores[np.searchsorted(keys, np.cumsum(expand(k, np.uint64), dtype=np.uint64))]) for k in asked.column("keys").to_pylist()]
        return pa.table({"block": asked.column("block"), "part": asked.column("part"), "answer": pa.array(answers, pa.binary())})

    answered = modelled.groupBy("part").cogroup(runs.select("part", "block", "keys").groupBy("part")).applyInArrow(answer, "block long, part long, answer binary")
    answers = words.where("block >= 0").select("block", "part", "answer", F.lit(WORDS).alias("kind")).union(answered.select("block", "part", "answer", F.lit(RUNS).alias("kind")))
    texts = stored.where(F.col("kind") == TEXT).select("block", "keys")
    scale = float(np.log10(tokens + distinct + 1))

    def score(texts: pa.Table, answers: pa.Table) -> pa.Table:
        give_back()
        kept = [b for b in pa.ipc.open_stream(zstandard.decompress(texts.column("keys")[0].as_py()))]
        asked: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])
        for part in kept:
            for some, (keys, _) in zip(asked, keys_of(part.column("text")), strict=False):
                some.append(distinct_of(keys))
        tables = []
        for kind, some, form in zip((WORDS, RUNS), asked, (np.int64, np.float32), strict=True):
            own = answers.filter(pa.compute.equal(answers.column("kind"), kind)).sort_by("part")  # shares are ranges, in order
            got = [expand(x, form) for x in own.column("answer").to_pylist()]
            keys = np.concatenate(some)
            some.clear()
            tables.append((distinct_of(keys), np.concatenate(got) if got else np.zeros(0, form)))
        del keys
        columns: list[list[np.ndarray]] = [[], [], [], [], []]
        for part in kept:
            (words, text), (runs, begin), sizes = keys_of(part.column("text"))
            n, c = len(sizes), looked_up(words, *tables[0])
            base = np.bincount(text, weights=np.log10(c + 1) - scale, minlength=n) + np.log10(n_docs + 1) - scale
            model = np.add.reduceat(looked_up(runs, *tables[1]).astype(np.float64), begin)
            found = (np.bincount(text, minlength=n) + 1, np.bincount(text[c > 0], minlength=n) + (n_docs > 0), base, model, sizes)
            for column, values in zip(columns, found, strict=True):
                column.append(values)
        some = [np.concatenate(x) for x in columns]
        n_bytes = some[4].astype(np.int64)
        whole = pa.Table.from_batches(kept)
        return pa.table({
            "doc_id": whole.column("doc_id"), "held_out": whole.column("held_out"), "n_tokens": pa.array(some[0].astype(np.int64)), "n_known": pa.array(some[1].astype(np.int64)),
            "train_tokens": pa.array(np.full(len(n_bytes), tokens, np.int64)), "base_score": pa.array(some[2].astype(np.float64)), "score": pa.array(some[3].astype(np.float64)),
            "n_bytes": pa.array(n_bytes), "bits_per_byte": pa.array(-some[3] / np.log10(2) / (n_bytes + 1)),
        })

    schema = f"doc_id {id_kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double"
    return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, schema)


def brute_force(train: list[bytes], texts: list[bytes]) -> list[float]:
    """log10 probabilities by the recursive definition, node by node; for tests."""
    counts: dict[tuple[bytes, str], list[int]] = {}

    def decisions(text: bytes) -> Iterator[tuple[bytes, str, int]]:
        stream = bytes(DEPTH) + text + bytes([END_BYTE])
        for i in range(DEPTH, len(stream)):
            bits = f"{stream[i]:08b}"
            for k in range(8):
                yield stream[i - DEPTH : i], bits[:k], int(bits[k])

    for text in train:
        for context, before, bit in decisions(text):
            for depth in range(DEPTH + 1):
                counts.setdefault((context[DEPTH - depth :], before), [0, 0])[bit] += 1
    below: dict[tuple[bytes, str], set[tuple[bytes, str]]] = {}
    for context, before in counts:
        if context:
            below.setdefault((context[1:], before), set()).add((context, before))
    weight: dict[tuple[bytes, str], float] = {}
    for node in sorted(counts, key=lambda x: -len(x[0])):
        own = float(log_kt(np.array([counts[node]]))[0])
        weight[node] = own if len(node[0]) == DEPTH else float(np.log(0.5) + np.logaddexp(own, sum(weight[x] for x in sorted(below[node]))))

    def one(context: bytes, before: str, depth: int = 0) -> float:
        node = (context[DEPTH - depth :], before)
        if node not in counts:
            return 0.5
        zeros, ones = counts[node]
        own = (ones + 0.5) / (zeros + ones + 1)
        if depth == DEPTH or (context[DEPTH - depth - 1 :], before) not in counts:
            return own
        share = float(np.exp(np.log(0.5) + log_kt(np.array([counts[node]]))[0] - weight[node]))
        return share * own + (1 - share) * one(context, before, depth + 1)

    return [float(sum(np.log10(p if bit else 1 - p) for context, before, bit in decisions(text) for p in [one(context, before)])) for text in texts]
