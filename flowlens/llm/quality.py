"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Each line is good or bad; its features are its own and those of the lines before and after it. Marginals
by the forward-backward recursion, weighted by line length, give the quality of the document.

Fitting takes at most SAMPLE labelled documents (a bounded sample, in the order of a hash of the id);
their lines take the label of the document. Scores read the text alone.

Defined results: null and empty texts are one empty line and get a score like any other; without labels
every score is 0.5; texts of any length are scored whole; repeated rows get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import IS_SPACE, fold, fresh, slices, span_hashes, string_buffers, tidy, whole_text

#: Labelled documents to fit on, at most.
SAMPLE = 4000
#: Chains are cut to this many lines while fitting (not while scoring).
CHAIN = 64
#: Chains of a document that are fitted on at most.
CHAINS = 32
ROUNDS = 150
#: Bytes of text that a task works on at once.
SLICE = 1 << 20


def _byte_classes() -> np.ndarray:
    kind = np.full(256, 5, np.int8)  # other signs
    kind[list(range(97, 123))] = 0
    kind[list(range(65, 91))] = 1
    kind[list(range(48, 58))] = 2
    kind[IS_SPACE] = 3
    kind[list(b".,;:?'\"()-")] = 4
    kind[128:] = 6
    kind[list(b"|<>{}[]=_/\\")] = 7
    return kind


KINDS = _byte_classes()
#: Own features of a line; three times as many with those of its neighbours.
OWN = 14


class Lines(NamedTuple):
    features: np.ndarray  # lines x 3 * OWN
    weight: np.ndarray  # bytes of each line, and one for its end
    count: np.ndarray  # lines of each document


def line_features(data: np.ndarray, offsets: np.ndarray) -> Lines:
    """Features of every line of the texts; a text has at least one line."""
    breaks = np.flatnonzero(data == 10)
    of_break = np.searchsorted(offsets[1:], breaks, "right")
    count = np.bincount(of_break, minlength=len(offsets) - 1) + 1
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([offsets[1:], breaks]), kind="stable")
    size = ends - starts
    doc = np.repeat(np.arange(len(count)), count)
    kinds = KINDS[data] if len(data) else np.zeros(0, np.int8)

    def within(mask: np.ndarray) -> np.ndarray:
        total = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return total[ends] - total[starts]

    n = np.maximum(size, 1)
    shares = [within(kinds == k) / n for k in range(8)]
    space = kinds == 3
    word_start = ~space
    word_start[1:] &= space[:-1]
    begin = offsets[:-1][np.diff(offsets) > 0]  # what stands before a text belongs to another one
    word_start[begin] = ~space[begin]
    words = np.maximum(within(word_start), 1)
    last = np.zeros(len(size), bool)
    full = size > 0
    last[full] = np.isin(data[ends[full] - 1], np.frombuffer(b".!?:\"'", np.uint8))
    first = np.zeros(len(size), bool)
    first[full] = (kinds[starts[full]] == 1) | (kinds[starts[full]] == 6)
    seen = np.zeros(len(size), bool)
    if full.any():
        key = span_hashes(data, starts[full], ends[full]) ^ (doc[full].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _, at, inverse = np.unique(key, return_index=True, return_inverse=True)
        seen[np.flatnonzero(full)] = at[inverse] < np.arange(len(key))
    own = np.stack([*shares, np.log1p(size), np.log1p(words), np.minimum(n / words, 40), last, first, seen], axis=1).astype(np.float32)
    before, after = np.zeros_like(own), np.zeros_like(own)
    same = doc[1:] == doc[:-1]
    before[1:][same], after[:-1][same] = own[:-1][same], own[1:][same]
    return Lines(np.concatenate([own, before, after], axis=1), (size + 1).astype(np.float64), count)


class Chain(NamedTuple):
    """Weights: node score is features @ node + bias; steps[i, j] is added for state i before state j."""

    mean: np.ndarray
    scale: np.ndarray
    node: np.ndarray
    bias: float
    steps: np.ndarray

    def scores(self, features: np.ndarray) -> np.ndarray:
        return ((features - self.mean) / self.scale).astype(np.float64) @ self.node + self.bias


def forward_backward(score: np.ndarray, count: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of good from the lines up to each one and from those after it. All chains advance together."""
    ahead, behind = score.astype(np.float64).copy(), np.zeros(len(score))
    order = np.argsort(-count, kind="stable")
    first = (np.cumsum(count) - count)[order]
    longest = count[order]
    alive = np.searchsorted(-longest, -np.arange(1, longest[0] + 1 if len(longest) else 1), "right")  # chains with over t lines
    (t00, t01), (t10, t11) = steps
    for t in range(1, len(alive)):
        at = first[: alive[t]] + t
        a = ahead[at - 1]
        ahead[at] += np.logaddexp(t11 + a, t01) - np.logaddexp(t10 + a, t00)
    for t in range(len(alive) - 1, 0, -1):
        at = first[: alive[t]] + t
        b = score[at] + behind[at]
        behind[at - 1] = np.logaddexp(t11 + b, t10) - np.logaddexp(t01 + b, t00)
    return ahead, behind


def odds(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def fit(features: np.ndarray, count: np.ndarray, label: np.ndarray, penalty: float = 1e-3) -> Chain:
    """Maximum conditional likelihood by gradient steps (Adam); label: of each line."""
    if not len(features):
        width = 3 * OWN
        return Chain(np.zeros(width, np.float32), np.ones(width, np.float32), np.zeros(width), 0.0, np.zeros((2, 2)))
    mean, scale = features.mean(0), features.std(0) + 1e-3
    x, y = ((features - mean) / scale).astype(np.float64), label.astype(np.float64)
    starts = np.cumsum(count) - count
    inner = np.ones(len(y), bool)
    inner[starts] = False
    later = np.flatnonzero(inner)
    theta = np.zeros(x.shape[1] + 5)
    momentum, speed = np.zeros_like(theta), np.zeros_like(theta)
    observed = np.array([[np.sum((y[later - 1] == i) & (y[later] == j)) for j in (0, 1)] for i in (0, 1)], float)
    for step in range(1, ROUNDS + 1):
        node, bias, steps = theta[:-5], theta[-5], theta[-4:].reshape(2, 2)
        s = x @ node + bias
        ahead, behind = forward_backward(s, count, steps)
        miss = y - odds(ahead + behind)
        pair = np.stack([np.zeros(len(later)) + steps[0, 0], steps[0, 1] + s[later] + behind[later], steps[1, 0] + ahead[later - 1], steps[1, 1] + ahead[later - 1] + s[later] + behind[later]], axis=1)
        pair = np.exp(pair - pair.max(axis=1, keepdims=True)) if len(later) else pair
        expected = (pair / pair.sum(axis=1, keepdims=True)).sum(0) if len(later) else np.zeros(4)
        slope = np.concatenate([x.T @ miss, [miss.sum()], observed.reshape(-1) - expected]) / len(y) - penalty * theta
        momentum = 0.9 * momentum + 0.1 * slope
        speed = 0.99 * speed + 0.01 * slope**2
        theta = theta + 0.1 * (momentum / (1 - 0.9**step)) / (np.sqrt(speed / (1 - 0.99**step)) + 1e-8)
    return Chain(mean, scale, theta[:-5], float(theta[-5]), theta[-4:].reshape(2, 2))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Chain:
    """A chain fitted on at most `sample` rows of labels (doc_id, quality), and of longer documents on CHAINS chains of
    lines, evenly spaced; their features come to the driver."""
    some = labels.where(F.col("quality").isin(0, 1)).select(F.col("doc_id").alias("_of"), F.col("quality").cast("int").alias("_label")).orderBy(F.xxhash64("_of"), "_of").limit(sample)
    rows = docs.select("doc_id", whole_text().alias("_text")).join(F.broadcast(some), F.col("doc_id") == F.col("_of")).select("_label", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text", SLICE):
                lines = line_features(*string_buffers(part.column("_text")))
                cuts = np.cumsum(lines.count)[:-1]
                blobs = [spaced(x).tobytes() for x in np.split(lines.features, cuts)]
                yield pa.RecordBatch.from_arrays([part.column("_label"), pa.array(blobs, pa.binary())], ["label", "features"])

    found = sorted((r["label"], bytes(r["features"])) for r in rows.mapInArrow(tidy(run), "label int, features binary").collect())
    tables = [(label, np.frombuffer(x, np.float32).reshape(-1, 3 * OWN)) for label, x in found]
    chains = [(label, x[i : i + CHAIN]) for label, x in tables for i in range(0, len(x), CHAIN)]
    count = np.array([len(x) for _, x in chains], np.int64)
    features = np.concatenate([x for _, x in chains]) if chains else np.zeros((0, 3 * OWN), np.float32)
    return fit(features, count, np.repeat([label for label, _ in chains], count))


def spaced(lines: np.ndarray) -> np.ndarray:
    """At most CHAINS runs of CHAIN lines each."""
    n = -(-len(lines) // CHAIN)
    if n <= CHAINS:
        return lines
    return np.concatenate([lines[i * CHAIN : (i + 1) * CHAIN] for i in np.linspace(0, n - 1, CHAINS).astype(np.int64).tolist()])


def score_batch(model: Chain, texts: pa.Array) -> np.ndarray:
    lines = line_features(*string_buffers(texts))
    ahead, behind = forward_backward(model.scores(lines.features), lines.count, model.steps)
    good = odds(ahead + behind) * lines.weight
    first = np.cumsum(lines.count) - lines.count
    return np.clip(np.add.reduceat(good, first) / np.add.reduceat(lines.weight, first), 0.0, 1.0)


def score(docs: DataFrame, model: Chain, to: str = "score", text: str = "text") -> DataFrame:
    """docs with the quality of each text in `to`, a double from 0 to 1."""
    kept = [c for c in docs.columns if c != to]
    whole = fresh(docs, "_whole")
    named = docs.select(*kept, whole_text(text).alias(whole))
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, whole, SLICE):
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(score_batch(known.value, part.column(whole)))], [*kept, to])

    return named.mapInArrow(tidy(run), T.StructType([*named.schema.fields[:-1], T.StructField(to, T.DoubleType())]))


def held_out_scores(docs: DataFrame, labels: DataFrame, parts: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; fitted on the labels outside the held-out part."""
    model = train(docs, labels.where(fold("doc_id", parts) != held))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (fold("doc_id", parts) == held).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
