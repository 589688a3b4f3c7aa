"""SimHash near-duplicates by pivot distance tables.

Fingerprints get their Hamming distances to many reference fingerprints. Two that differ in at most
`most` bits differ by at most that in every distance, so fingerprints meet in the order of their distance to the first
pivot, pairs with a larger difference in any coordinate are discarded without a look at the fingerprints, and
survivors are verified bit by bit. Distances of random fingerprints spread by four bits only, so they can't deal rows to
tasks: pairs are sought among distinct fingerprints that agree in three of six runs of bits, which any pair of at most
three differing bits does. Each bucket reports a spanning forest of its verified pairs, so a group of n costs n - 1 rows.

Defined results: null and empty texts have fingerprint zero, linked like any other; copies share one
fingerprint and one component; a null doc_id keeps its row, and a component of nulls alone is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialise, mix, slices, tidy, whole_text
from .graph import components

SEED = 42
WIDTHS = (11, 11, 11, 11, 10, 10)
PIVOTS = 48


def fingerprint(text: str, n: int = 3) -> int:
    """64 bits, each set if it is in over half of the hashes of the n-word shingles."""
    words = text.encode().lower().split()
    if not words:
        return 0
    line, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]).tolist()
    starts, one = [0, *ends], xxhash.xxh64_intdigest
    hashes = [one(line[starts[i] : ends[i + n - 1] - 1], SEED) for i in range(len(words) - n + 1)] or [one(line, SEED)]
    bits = np.zeros(64, np.int64)
    table = np.array(hashes, "<u8")
    for first in range(0, len(table), 1 << 16):
        bits += np.unpackbits(table[first : first + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", to: str = "fp") -> DataFrame:
    """doc_id and the fingerprint as a long."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                prints = np.array([fingerprint(x) for x in part.column("_text").to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(prints)], ["doc_id", to])

    return docs.select("doc_id", whole_text(text).alias("_text")).mapInArrow(tidy(run), f"doc_id {kind}, {to} long")


def masks() -> list[int]:
    """Of three of the six runs of bits each, as signed numbers."""
    ends = np.cumsum(WIDTHS).tolist()
    runs = [((1 << w) - 1) << (e - w) for w, e in zip(WIDTHS, ends, strict=True)]
    whole = [sum(some) for some in combinations(runs, 3)]
    return [m - (1 << 64) if m >> 63 else m for m in whole]


def pivot_table(prints: np.ndarray, pivots: int = PIVOTS) -> np.ndarray:
    """Hamming distance of every fingerprint to every pivot."""
    at = mix(np.arange(1, pivots + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return np.bitwise_count(prints[:, None] ^ at).astype(np.int8)


def forest(group: np.ndarray, prints: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the pairs within a group (equal `group`, sorted) that differ in at most `most` bits.
    Rows stand in the order of their distance to the first pivot, and each only meets those whose distance is at most
    `most` larger; of these the other distances discard nearly all, and the rest is verified."""
    n = len(prints)
    root = np.arange(n)
    table = pivot_table(prints)
    order = np.lexsort((table[:, 0], group))
    group, prints, table = group[order], prints[order], table[order]
    left, right = [], []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    at = np.arange(n)
    for step in range(1, n):
        at = at[at + step < n]
        at = at[(group[at] == group[at + step]) & (table[at + step, 0] - table[at, 0] <= most)]
        if step & (step - 1) == 0 and step > 8:  # groups that are one tree by now need no further look
            while not np.array_equal(root, root[root]):
                root = root[root]
            tops = np.bincount(group[root == np.arange(n)], minlength=int(group.max()) + 1)
            at = at[tops[group[at]] > 1]
        if not len(at):
            break
        for first in range(0, len(at), 1 << 16):
            i = at[first : first + (1 << 16)]
            i = i[np.abs(table[i] - table[i + step]).max(axis=1) <= most]
            i = i[np.bitwise_count(prints[i] ^ prints[i + step]) <= most]
            for x in i.tolist():
                a, b = find(x), find(x + step)
                if a != b:
                    root[max(a, b)] = min(a, b)
                    left.append(x)
                    right.append(x + step)
    return prints[left] if left else prints[:0], prints[right] if right else prints[:0]


def links(prints: DataFrame, most: int = 3) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints (column fp, distinct) that connect all within `most` bits."""
    keyed = prints.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in masks()))).alias("_mask", "_bits"))
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keyed.repartition(parts, "_mask", "_bits").sortWithinPartitions("_mask", "_bits", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.zeros(0, np.int64)] * 3

        def edges(mask: np.ndarray, bits: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            new = np.ones(len(fp), bool)
            new[1:] = (mask[1:] != mask[:-1]) | (bits[1:] != bits[:-1])
            group = np.cumsum(new)
            several = np.bincount(group)[group] > 1
            a, b = forest(group[several], fp[several].view(np.uint64), most)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [np.concatenate([k, batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64)]) for k, c in zip(kept, ("_mask", "_bits", "fp"), strict=True)]
            open_group = (rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1])
            kept = [x[open_group] for x in rows]
            yield edges(*(x[~open_group] for x in rows))
        yield edges(*kept)

    return dealt.mapInArrow(tidy(run), "a long, b long")


def near_duplicates(docs: DataFrame, most: int = 3) -> DataFrame:
    """doc_id, fp (long) and component_id, the smallest doc_id of all documents reachable through links."""
    stored = materialise(fingerprints(docs))
    distinct = stored.groupBy("fp").agg(F.min("doc_id").alias("_least"))
    linked = components(links(distinct.select("fp"), most), "a", "b")
    of = distinct.join(linked, distinct["fp"] == linked["node"], "left").select("fp", "_least", F.coalesce("component", "fp").alias("_root"))
    least = of.groupBy("_root").agg(F.min("_least").alias("component_id"))
    named = of.join(least, "_root").select(F.col("fp").alias("_fp"), "component_id")
    return stored.join(named, F.col("fp") == F.col("_fp"), "left").select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame, most: int = 3) -> DataFrame:
    """docs with one row of every component: that of the smallest doc_id (null ids come last), and of several rows with
    that id the least by a hash of the row; of rows that are equal in all columns one stays. Columns pass unchanged."""
    names = [fresh(docs, n) for n in ("_one", "_other")]
    # rows are told apart by 128 bits of all their columns, as ids may repeat or be null
    marked = docs.withColumns({n: F.xxhash64(F.lit(k), *(F.col(f"`{c}`") for c in docs.columns)) for k, n in enumerate(names)})
    told = marked.select(F.struct("doc_id", *names).alias("doc_id"), F.col("text"))
    stored = materialise(fingerprints(told))
    distinct = stored.groupBy("fp").agg(F.min(F.struct(F.col("doc_id.doc_id").isNull(), "doc_id")).alias("_least"))
    linked = components(links(distinct.select("fp"), most), "a", "b")
    rooted = distinct.join(linked, distinct["fp"] == linked["node"], "left").select("_least", F.coalesce("component", "fp").alias("_root"))
    kept = rooted.groupBy("_root").agg(F.min("_least").alias("_least")).select(*(F.col(f"_least.doc_id.{n}").alias(n) for n in names))
    return marked.join(kept, names, "left_semi").dropDuplicates(names).drop(*names)


def near_duplicate_report(docs: DataFrame) -> DataFrame:
    found = near_duplicates(docs.select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
