"""The corpus operators against brute force, on small tables with nulls, empty and long texts, ties and repeats."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowlens.llm import bpe, ctw, linejoin, packing, permutation, pii, quality, simhash, substrings, telephony

import public_tokenizers as P

R = random.Random(11)
WORDS = [f"w{i}" for i in range(60)] + ["The", "naïve", "漢字", "x" * 300, "don't"]


def sentence(n):
    return " ".join(R.choice(WORDS) for _ in range(n))


BASE = [sentence(60) for _ in range(4)]
TEXTS = [None, "", " \n\t ", "one", "a\n\nb\n", *BASE, BASE[0], BASE[0] + " tail", BASE[1].replace("w1 ", "w2 ", 1), "\n".join([BASE[2], BASE[3], BASE[2]]), sentence(3000), "mail a.b@c.de or +1 (743) 555-3824, (743) 555-3824, 4111 1111 1111 1111 at 10.0.0.1 or 300.1.1.1"]
ROWS = [(i, t, "en", "src0", len(t or "")) for i, t in enumerate(TEXTS)] + [(None, "no id here", "en", "src0", 10), (4, "a\n\nb\n", "en", "src0", 5)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_row(df):
    """Results in the order of ids, repeats together."""
    return sorted((tuple(r) for r in df.collect()), key=repr)


def words(text):
    return (text or "").encode().split()


def test_empty_tables(spark, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    path = P.path("byte_bpe_multi_50k.tiktoken")
    for df in (
        pii.span_report(none), telephony.text_clips(none), ctw.train_and_score(none), permutation.nearest_report(vectors), bpe.bpe_digest(none, path, P.PATTERN), simhash.near_duplicate_report(none),
        quality.held_out_scores(none, labels), packing.pack(none, P.path("word_bpe_49k.json")), linejoin.line_report(none), substrings.repeat_report(none),
    ):
        assert df.count() == 0


def test_clashing_columns(spark, docs):
    """Columns named like the operators' own stay as they are."""
    import corpus_pipeline

    names = ["_block", "_doc", "_mark", "_whole", "_quality", "_text", "_least", "n_lines", "n_removed", "score", "fp", "ids", "component_id", "rank", "_bucket"]
    wide = docs.where("doc_id is not null").select("*", *(F.lit(i).alias(n) for i, n in enumerate(names)))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, "/root/testdata/sf0.001")
        assert out.columns == wide.columns and out.dtypes == wide.dtypes, name
        assert {tuple(r) for r in out.select(*names).collect()} <= {tuple(range(len(names)))}
    assert packing.pack(wide, P.path("word_bpe_49k.json")).count() >= len(TEXTS)
    for df in (pii.span_report(wide), telephony.text_clips(wide), ctw.train_and_score(wide), simhash.near_duplicate_report(wide), linejoin.line_report(wide), substrings.repeat_report(wide)):
        assert df.count() == wide.count()


def test_pii(docs):
    found = pii.span_report(docs)
    want = sorted((i, *pii.brute_force(t or "")[0], pii.brute_force(t or "")[1]) for i, t, *_ in ROWS if i is not None)
    got = sorted(tuple(r)[:6] for r in found.collect() if r["doc_id"] is not None)
    assert got == want
    spans = {r["doc_id"]: r["spans"] for r in found.collect()}
    assert spans[len(TEXTS) - 1].startswith("email:5:13")


def test_pii_fuzz():
    signs = ["a", "b.c", "@", "+", "1", "22", "255", "4111 1111 1111 1111", ".", "-", " ", "(", ")", "é", "\n", "_%", "0000", "1.2.3.4", "x@y.z"]
    for _ in range(3000):
        text = "".join(R.choice(signs) for _ in range(R.randint(0, 16)))
        joined = ",".join(f"{pii.KINDS[s.kind]}:{s.start}:{s.end}" for s in pii.base_spans(text))
        assert hashlib.sha256(joined.encode()).hexdigest() == pii.brute_force(text)[1]


def test_pii_links():
    model = pii.fit(np.zeros((0, pii.WIDTH)), np.zeros(0, np.int64), np.zeros((pii.LABELS, pii.LABELS)), np.eye(pii.LABELS) * 50)
    text = "+1 (743) 555-3824 then 743-555-3824 and 12345678"
    base, every = pii.find_spans([text], model)[0]
    assert [text[s.start : s.end] for s in base] == ["+1 (743) 555-3824"]
    assert "743-555-3824" in [text[s.start : s.end] for s in every] and "12345678" not in [text[s.start : s.end] for s in every]


def test_pii_links_reach_all():
    """Repeats far from their evidence get its label, with the rounds that the query takes."""
    model = pii.fit(np.zeros((0, pii.WIDTH)), np.zeros(0, np.int64), np.zeros((pii.LABELS, pii.LABELS)), np.eye(pii.LABELS) * 50)
    text = "call +1 (743) 555-3824 " + "and 743-555-3824 or " * 60
    base, every = pii.find_spans([text], model)[0]
    assert len(base) == 1 and len(every) == 61 and {s.kind for s in every} == {3}
    before = "and 743-555-3824 or " * 60 + "+1 (743) 555-3824"
    assert [len(x) for x in pii.find_spans([before], model)[0]] == [1, 61]
    # what a text is worked on with makes no difference
    assert pii.find_spans([text, "1 2 3 4", before], model) == [pii.find_spans([t], model)[0] for t in (text, "1 2 3 4", before)]


def test_pii_settles_on_chains():
    rng = np.random.default_rng(9)
    unary, table = np.zeros((40, pii.LABELS)), np.eye(pii.LABELS) * 6
    unary[0], unary[1:] = [-20, -20, -20, -20, 0, -20], rng.normal(size=(39, pii.LABELS)) / 10
    got = pii.marginals(unary, np.stack([np.arange(39), np.arange(1, 40)], 1), np.stack([table] * 39))
    ahead = unary[0]
    for own in unary[1:]:
        ahead = np.logaddexp.reduce(ahead[:, None] + table, axis=0) + own
    want = np.exp(ahead - np.logaddexp.reduce(ahead))
    assert np.allclose(got[39], want, atol=0.01)


def test_pii_without_evidence():
    """A text without a base span is labelled by its own tokens."""
    node = np.zeros((pii.WIDTH, pii.LABELS))
    node[17, 4], node[0, 0] = 6, 2
    text = "phone 743-555-3824 and, far from any cue in this text, 12345678901"
    base, every = pii.find_spans([text], pii.Model(node, np.zeros((pii.LABELS, pii.LABELS)), 3.0))[0]
    assert base == [] and [text[s.start : s.end] for s in every] == ["743-555-3824"]


def test_pii_train_beyond_sample(spark):
    docs = spark.createDataFrame([(i, f"plain {i}") for i in range(60)] + [(60, "mail a.b@c.de")], "doc_id long, text string")
    first = docs.orderBy(F.xxhash64("text")).first()["text"]
    assert first != "mail a.b@c.de" and pii.train(docs, sample=1) is not None
    assert pii.train(docs.where("doc_id < 60")) is None


def test_pii_marginals_match_enumeration():
    rng = np.random.default_rng(3)
    unary, table = rng.normal(size=(3, pii.LABELS)), rng.normal(size=(pii.LABELS, pii.LABELS))
    links = np.array([[0, 1], [1, 2]])
    got = pii.marginals(unary, links, np.stack([table, table]), rounds=60)
    joint = np.exp(unary[0][:, None, None] + unary[1][None, :, None] + unary[2][None, None, :] + table[:, :, None] + table[None, :, :])
    assert np.allclose(got[1], joint.sum((0, 2)) / joint.sum(), atol=1e-6)


def test_pii_adds_spans(spark):
    """Secrets, their repeats without a cue and numbers without their plus sign come from the field; clean numbers don't."""
    rows = [(i, f"the password={'%018x' % ((i + 1) * 0x9E3779B97F4A7C15 % (1 << 72))} and call +1 (2{i:02d}) 555-0{i:03d} or 10.0.0.{i}") for i in range(40)]
    secret = "c0ffee12ab90de77ff31"
    rows += [(100, f'token = "{secret}" ' + "and so on " * 30 + secret), (101, "under the License, Version 2.0."), (102, None), (103, "call +1 (743) 555-3824, again 743-555-3824")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r for r in pii.span_report(docs).collect()}
    assert all(found[i]["n_added"] == 1 and found[i]["n_spans"] == 3 for i in range(40))
    assert found[100]["spans"].count("secret:") == 2 and found[100]["n_added"] == 2
    assert found[101]["n_spans"] == found[102]["n_spans"] == 0 and found[103]["n_added"] == 1
    clean = {r["doc_id"]: r["text"] for r in pii.redact(docs, pii.train(docs)).collect()}
    assert secret not in clean[100] and clean[101] == rows[-3][1] and clean[102] == "" and "3824" not in clean[103]


def test_pii_carries_labels_far(spark):
    """Repeats of a secret and of a phone number, 5,000 tokens on and without a cue or plus sign of their own."""
    secret = "c0ffee12ab90de77ff31"
    far = " ".join(f"item {i} of 12.5" for i in range(5000))
    rows = [(i, f"the password={'%018x' % ((i + 1) * 0x9E3779B97F4A7C15 % (1 << 72))} and call +1 (2{i:02d}) 555-0{i:03d}, or 2{i:02d}-555-0{i:03d}") for i in range(40)]
    rows += [(100, f'api_key = "{secret}" {far} so {secret} and on'), (101, f"call +1 (743) 555-3824 {far} again 743-555-3824 it is"), (102, far), (103, far + " " + secret[:3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r for r in pii.span_report(docs).collect()}
    at = rows[40][1].rindex(secret)
    assert f"secret:{at}:{at + len(secret)}" in found[100]["spans"].split(",")
    at = rows[41][1].rindex("743-555-3824")
    assert f"phone:{at}:{at + 12}" in found[101]["spans"].split(",")
    assert found[102]["n_added"] == found[103]["n_added"] == 0


def test_telephony_round_trip(docs):
    for r in telephony.text_clips(docs).collect():
        if r["doc_id"] is None:
            continue
        raw = (TEXTS[r["doc_id"]] or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r["media_sha256"] == hashlib.sha256(telephony.wav(payload, telephony.MULAW)).hexdigest()


def test_telephony_tables():
    mu, a = telephony.mulaw_table(), telephony.alaw_table()
    assert (mu[0xFF], mu[0x7F], mu[0x80], mu[0x00]) == (0, 0, 32124, -32124)
    assert (a[0xD5], a[0x55], a[0xAA], a[0x2A]) == (8, -8, 32256, -32256)


def slow_ima(block):
    value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [value]
    for byte in block[4:]:
        for nibble in (byte & 15, byte >> 4):
            step = int(telephony.step_table()[index])
            change = (step >> 3) + (step if nibble & 4 else 0) + (step >> 1 if nibble & 2 else 0) + (step >> 2 if nibble & 1 else 0)
            value = max(-32768, min(32767, value - change if nibble & 8 else value + change))
            index = max(0, min(88, index + int(telephony.INDEX_STEP[nibble & 7])))
            out.append(value)
    return out


def test_telephony_adpcm():
    blocks = np.random.default_rng(5).integers(0, 256, (20, 64), dtype=np.uint8)
    assert telephony.ima_blocks(blocks).tolist() == [slow_ima(b.tobytes()) for b in blocks]


def test_telephony_clips(spark):
    clips = telephony.store_clips(spark.createDataFrame([(1, bytearray(range(200))), (2, bytearray())], "k int, payload binary"), "payload", telephony.ALAW)
    rows = {r["k"]: r["clip"] for r in telephony.decode_clips(clips).collect()}
    assert bytes(rows[1]["payload"]) == bytes(range(200)) and len(rows[1]["pcm"]) == 800 and not rows[2]["pcm"]


def slow_clip(payload, kind):
    """PCM of a payload at 16 kHz, sample by sample, from the published rules."""
    out = []
    if kind == "adpcm":
        steps, moves = telephony.step_table().tolist(), telephony.INDEX_STEP.tolist()
        for first in range(0, len(payload), 64):
            block = payload[first : first + 64]
            value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
            out.append(value)
            for byte in block[4:]:
                for nibble in (byte & 15, byte >> 4):
                    step = steps[index]
                    change = (step >> 3) + (step if nibble & 4 else 0) + (step >> 1 if nibble & 2 else 0) + (step >> 2 if nibble & 1 else 0)
                    value = max(-32768, min(32767, value - change if nibble & 8 else value + change))
                    index = max(0, min(88, index + moves[nibble & 7]))
                    out.append(value)
    for byte in payload if kind == "mulaw" else []:
        code = ~byte & 255
        size = ((((code & 15) << 3) + 132) << (code >> 4 & 7)) - 132
        out.append(-size if code & 128 else size)
    for byte in payload if kind == "alaw" else []:
        code = byte ^ 0x55
        chord, low = code >> 4 & 7, ((code & 15) << 4) + 8
        size = low if chord == 0 else (low + 256) << (chord - 1)
        out.append(size if code & 128 else -size)
    return [x for a, b in zip(out, [*out[1:], out[-1]], strict=True) for x in (a, (a + b) >> 1)]


def test_telephony_features_match_slow_decoder(docs, monkeypatch):
    for window in (telephony.WINDOW, 128):
        monkeypatch.setattr(telephony, "WINDOW", window)
        rows = telephony.text_clips(docs.where("doc_id is not null")).collect() if window > 128 else []
        for text in [r[1] for r in ROWS if window == 128]:
            payload = (text or "").encode()
            payload += bytes(-len(payload) % 64 or (0 if payload else 64))
            for kind, tag in (("mulaw", telephony.MULAW), ("alaw", telephony.ALAW), ("adpcm", telephony.IMA)):
                got = np.concatenate(list(telephony.resampled(telephony.decode(tag, 64 if kind == "adpcm" else 1, payload))))
                assert got.tolist() == slow_clip(payload, kind)
        for r in rows:
            payload = (TEXTS[r["doc_id"]] or "").encode()
            payload += bytes(-len(payload) % 64 or (0 if payload else 64))
            want = []
            for kind in ("mulaw", "alaw", "adpcm"):
                pcm = slow_clip(payload, kind)
                rms = round((sum(x * x for x in pcm) / len(pcm)) ** 0.5)
                want.append(f"{kind}:{max(map(abs, pcm))},{rms},{sum((a < 0) != (b < 0) for a, b in zip(pcm, pcm[1:], strict=False))},{zlib.crc32(np.array(pcm, np.int16).tobytes())}")
            assert r["feature"] == ";".join(want)
            assert r["pcm_sha256"] == hashlib.sha256(np.array(slow_clip(payload, "mulaw"), np.int16).tobytes()).hexdigest()


def test_telephony_resamples_across_windows():
    pcm = np.random.default_rng(3).integers(-32768, 32768, 1000).astype(np.int16)
    for rate in (8000, 16000, 11025, 48000, 6000):
        whole = telephony.resample(pcm, 8000, rate)
        assert len(whole) == 1000 * rate // 8000
        for cut in (1, 7, 333):
            parts = [pcm[i : i + cut] for i in range(0, 1000, cut)]
            assert np.array_equal(np.concatenate(list(telephony.resampled(parts, 8000, rate))), whole)


def test_ctw_sums_to_one_and_base(docs):
    rows = [r for r in ctw.train_and_score(docs).collect()]
    assert len(rows) == len(ROWS)
    train = [t for i, t, *_ in ROWS if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    counts = {}
    for t in train:
        for w in (t or "").encode().lower().split():
            counts[w] = counts.get(w, 0) + 1
    total, distinct = sum(counts.values()) + len(train), len(counts) + 1
    for r in rows:
        if r["doc_id"] is None:
            continue
        own = (TEXTS[r["doc_id"]] or "").encode().lower().split()
        want = sum(np.log10((counts.get(w, 0) + 1) / (total + distinct + 1)) for w in own) + np.log10((len(train) + 1) / (total + distinct + 1))
        assert abs(r["base_score"] - want) < 1e-6 and r["train_tokens"] == total and r["n_tokens"] == len(own) + 1 and r["score"] < 0
        assert r["n_known"] == sum(w in counts for w in own) + 1 and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2)


def test_ctw_same_as_recursion(spark):
    """Scores of small texts against the weighting written out node by node, on unseen bytes and contexts too."""
    rows = [(i, "".join(R.choice("abBc dé") for _ in range(R.randint(0, 40)))) for i in range(40)] + [(41, None), (42, "abcabcabc" * 20), (43, "漢字 z\0q")]
    got = {r["doc_id"]: r for r in ctw.train_and_score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = {i: ctw.lower_ascii(np.frombuffer((t or "").encode(), np.uint8)).tobytes() for i, t in rows}
    want = ctw.brute_force([t for i, t in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2], list(texts.values()))
    assert {r["held_out"] for r in got.values()} == {True, False}
    for i, score in zip(texts, want, strict=True):
        assert abs(got[i]["score"] - score) < 1e-4 * (1 + abs(score)), i
    assert abs(got[42]["bits_per_byte"] + want[41] / np.log10(2) / 181) < 1e-4


def test_ctw_over_blocks(spark, monkeypatch):
    """Blocks, slices and shares make no difference."""
    rows = [(i, "".join(R.choice("abcd efg") for _ in range(R.randint(0, 300)))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    one = by_row(ctw.train_and_score(docs))
    for name, value in (("BLOCK", 600), ("SLICE", 200), ("SHARE", 1000)):
        monkeypatch.setattr(ctw, name, value)
    other = by_row(ctw.train_and_score(docs))
    assert [r[:5] for r in one] == [r[:5] for r in other] and np.allclose([r[5:] for r in one], [r[5:] for r in other], rtol=1e-6)


def test_ctw_searches_for_distinct_keys(monkeypatch):
    """Answers reach every key, and only distinct keys are searched for: a search for each one failed the check."""
    known, keys, search, sought = np.array([0, 2, 3, 5, 9, 1 << 55], np.uint64), np.array([9, 3, 9, 9, 1 << 55, 0, 3], np.uint64), np.searchsorted, []
    monkeypatch.setattr(np, "searchsorted", lambda a, v: sought.append(v.tolist()) or search(a, v))
    assert ctw.looked_up(keys, known, known.astype(np.float64) / 2).tolist() == (keys.astype(np.float64) / 2).tolist()
    assert sought == [[0, 3, 9, 1 << 55]]
    assert len(ctw.looked_up(keys[:0], known, known)) == 0 == len(ctw.looked_up(keys[:0], known[:0], known[:0]))
    assert ctw.distinct_of(keys).tolist() == [0, 3, 9, 1 << 55] and len(ctw.distinct_of(keys[:0])) == 0


def test_ctw_predicts_held_out_texts(spark):
    """As good as words that the training texts know, on a small corpus; nothing of a held-out text is learned."""
    rows = ctw.train_and_score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").select("score", "base_score", "bits_per_byte").collect()
    assert sum(r["score"] for r in rows) > 1.02 * sum(r["base_score"] for r in rows)
    assert np.mean([r["bits_per_byte"] for r in rows]) < 2.25


def test_permutation_recall(spark):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(600, 16)).astype(np.float32)
    vectors[100:160] = vectors[100]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(vectors)] + [(1000, None, 0), (1001, [0.0] * 16, 0), (1002, [float("nan")] * 16, 0), (1003, [1.0], 0), (None, [1.0] * 16, 0)]
    found = permutation.nearest_report(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    exact = vectors.astype(float)
    scores = np.array([[np.sum(a * b) for b in exact] for a in exact[::20]])
    hits = 0
    for q in range(30):
        own = scores[q].copy()
        own[20 * q] = -np.inf
        want = np.lexsort((np.arange(600), -own))[:20].tolist()
        got = [r["vec_id"] for r in sorted((r for r in found if r["query_id"] == 20 * q), key=lambda r: r["rank"])]
        hits += len(set(got) & set(want))
        assert len(got) == 20
    assert hits / 600 >= 0.9 and not {1000, 1001, 1002, 1003} & {r["vec_id"] for r in found}


def test_permutation_recall_with_norms(spark):
    """Above RERANK vectors a shard, with norms that vary by more than a hundred times, against brute force."""
    rng = np.random.default_rng(6)
    vectors = (rng.normal(size=(20000, 32)) * np.exp(rng.normal(size=(20000, 1)))).astype(np.float32)
    table = spark.createDataFrame(list(zip(range(len(vectors)), vectors.tolist(), strict=True)), "vec_id long, embedding array<float>")
    found = permutation.nearest(table, F.col("vec_id") % 200 == 0).toPandas()
    wide = vectors.astype(np.float64)
    hits = 0
    for query, own in found.groupby("query_id"):
        score = wide @ wide[query]
        score[query] = -np.inf
        hits += len(set(np.argsort(-score)[:20]) & set(own["vec_id"]))
        assert np.allclose(own.sort_values("rank")["score"], score[own.sort_values("rank")["vec_id"]])
    assert hits >= 0.95 * 20 * 100


def test_permutation_few_rows(spark):
    found = permutation.nearest_report(spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [0.5, 0.5], 0), (2, [0.5, 0.5], 0)], "vec_id long, embedding array<double>, label int"))
    assert [(r["rank"], r["vec_id"], r["score"]) for r in found.orderBy("rank").collect()] == [(1, 1, 0.5), (2, 2, 0.5)]


def test_bpe_same_as_library(docs):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    coder = bpe.load(path, P.PATTERN)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    for r in bpe.bpe_digest(docs, path, P.PATTERN).collect():
        if r["doc_id"] is not None:
            text = TEXTS[r["doc_id"]] or ""
            ids = library.encode_ordinary(text)
            assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    signs = ["a", "the", "  ", "\n", " ", "'s", "'ll", "1", "23", "é", "漢字", "\x1c", "\x85", "İ", "--", "😀", "\t", "ing", "aaa"]
    for _ in range(1500):
        text = "".join(R.choice(signs) for _ in range(R.randint(0, 40)))
        assert coder.encode(text).tolist() == library.encode_ordinary(text)


def test_bpe_new_pieces_share_their_beginnings(monkeypatch):
    """Texts encoded together: a piece goes on from the one before it, whatever the caches keep; ids are the library's."""
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    coder = bpe.BytePairs(bpe.load(path, P.PATTERN).ranks, P.PATTERN)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    extend, steps = coder.extend, []
    monkeypatch.setattr(coder, "extend", lambda piece, last: steps.append(len(piece) - len(last)) or extend(piece, last))
    assert [len(x) > 1 for x in coder.encode_all(["zqzqzqzqa zqzqzqzqb", "zqzqzqzqa", "zqzqzqzqac"])] == [True] * 3
    assert sorted(steps) == [1, 9, 10]  # 29 entries if each new piece starts anew
    monkeypatch.setattr(bpe, "CACHE", 7)
    monkeypatch.setattr(bpe, "AT_ONCE", 11)
    signs = ["a", "the", "  ", "\n", " ", "'s", "1", "é", "漢字", "\x1c", "\x85", "--", "😀", "ing", "x" * 70]
    texts = ["".join(R.choice(signs) for _ in range(R.randint(0, 40))) for _ in range(300)]
    ids = coder.encode_all(texts)
    assert [x.tolist() for x in ids] == [library.encode_ordinary(t) for t in texts] and coder.encode_all([]) == []
    rows = bpe.ids_column([*ids, np.zeros(0, np.int32)])
    assert coder.decode_all(rows.slice(100)).to_pylist() == [*(t.encode() for t in texts[100:]), b""]
    assert coder.decode_all(pa.array([[97], None, []], pa.list_(pa.int32()))).to_pylist() == [coder.decode([97]), b"", b""]
    with pytest.raises(KeyError):
        coder.decode_all(pa.array([[97, None]], pa.list_(pa.int32())))


def test_bpe_appends_and_edits():
    coder = bpe.load(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    piece = b"thisisatextwithmanyrerererepeats" * 4
    last = coder.extend(piece, [])
    assert coder.tokens(piece, last) == coder.merge(piece) and coder.extend(piece + b"more", list(last)) == coder.extend(piece + b"more", [])
    for _ in range(100):
        i = R.randint(0, len(piece))
        j, by = min(len(piece), i + R.randint(0, 4)), bytes(R.choice(b"abcdeth") for _ in range(R.randint(0, 4)))
        new, table = coder.edit(piece, last, i, j, by)
        assert table == coder.extend(new, [])


def test_simhash_components(docs):
    found = {}
    for r in simhash.near_duplicate_report(docs).collect():
        found.setdefault(r["doc_id"], []).append((r["fingerprint"], r["component_id"]))
    prints = np.array([simhash.fingerprint(t or "") for t in TEXTS], np.uint64)
    label = np.arange(len(TEXTS))
    near = np.bitwise_count(prints[:, None] ^ prints) <= 3
    for _ in TEXTS:
        label = np.array([label[n].min() for n in near])
    for i, own in enumerate(label):
        assert set(found[i]) == {(f"{int(prints[i]):016x}", int(own))}


def test_simhash_links_and_chains(spark):
    rng = np.random.default_rng(6)
    prints = [int(x) for x in rng.integers(0, 1 << 63, 300)]
    chain = [prints[0]]
    for k in range(40):  # a long chain of small steps, and a large group around one
        chain.append(chain[-1] ^ (7 << (k % 60)))
    prints += chain + [prints[1] ^ (1 << i) ^ (1 << j) for i in range(40) for j in range(i)]
    table = np.array(sorted(set(prints)), np.uint64)
    df = spark.createDataFrame([(int(x),) for x in table.view(np.int64)], "fp long")
    from flowlens.llm.graph import components

    got = {r["node"]: r["component"] for r in components(simhash.links(df), "a", "b").collect()}
    label = np.arange(len(table))
    near = np.bitwise_count(table[:, None] ^ table) <= 3
    while True:
        new = np.array([label[n].min() for n in near])
        new = new[new]
        if (new == label).all():
            break
        label = new
    signed = table.view(np.int64)
    groups, want = {}, {}
    for x, g in zip(signed.tolist(), label.tolist(), strict=True):
        want.setdefault(g, set()).add(x)
        groups.setdefault(got.get(x, x), set()).add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_quality_learns(spark):
    good = ["A plain line of text, with words.\nAnd one more, as it should be." for _ in range(60)]
    bad = ["BUY!! NOW!! $$$ ###\nCLICK!! %%% &&&" for _ in range(60)]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(good + bad)] + [(500, None, "en", "s", 0), (501, "A good line. " * 5000, "en", "s", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, int(i < 60), 0) for i in range(120)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    found = {r["doc_id"]: r for r in quality.held_out_scores(docs, labels).collect()}
    held = [r for i, r in found.items() if r["held_out"] and i < 120]
    assert held and all(r["predicted"] == int(r["doc_id"] < 60) for r in held)
    assert len(found) == 122 and all(0 <= r["score"] <= 1 for r in found.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in found.items())


def test_quality_marginals_match_enumeration():
    rng = np.random.default_rng(8)
    score, steps = rng.normal(size=4), rng.normal(size=(2, 2))
    ahead, behind = quality.forward_backward(score, np.array([4]), steps)
    total, good = 0.0, np.zeros(4)
    for state in range(16):
        y = [state >> k & 1 for k in range(4)]
        weight = np.exp(sum(s for s, v in zip(score, y, strict=True) if v) + sum(steps[a, b] for a, b in zip(y, y[1:], strict=False)))
        total += weight
        good += weight * np.array(y)
    assert np.allclose(quality.odds(ahead + behind), good / total)


def slow_quality(model, text):
    """Features line by line, all labellings of a chain by recursion from both ends, and the weighted mean."""
    lines, own = text.encode().split(b"\n"), []
    for i, line in enumerate(lines):
        n = max(len(line), 1)
        shares = [sum(int(quality.KINDS[b]) == k for b in line) / n for k in range(8)]
        n_words = max(sum(quality.KINDS[b] != 3 and (j == 0 or quality.KINDS[line[j - 1]] == 3) for j, b in enumerate(line)), 1)
        own.append([*shares, np.log1p(len(line)), np.log1p(n_words), min(n / n_words, 40), line[-1:] in [bytes([b]) for b in b".!?:\"'"] and bool(line), bool(line) and int(quality.KINDS[line[0]]) in (1, 6), bool(line) and line in lines[:i]])
    own = np.array(own, np.float32)
    none = np.zeros(own.shape[1], np.float32)
    rows = np.array([np.concatenate([own[i], own[i - 1] if i else none, own[i + 1] if i + 1 < len(own) else none]) for i in range(len(own))])
    s = model.scores(rows)
    ahead = [np.array([0.0, s[0]])]
    for x in s[1:]:
        ahead.append(np.array([np.logaddexp(*(ahead[-1] + model.steps[:, j])) + (x if j else 0.0) for j in (0, 1)]))
    behind = [np.zeros(2)]
    for x in s[:0:-1]:
        behind.insert(0, np.array([np.logaddexp(*(behind[0] + model.steps[i] + np.array([0.0, x]))) for i in (0, 1)]))
    both = np.array(ahead) + np.array(behind)
    good = 1 / (1 + np.exp(both[:, 0] - both[:, 1]))
    weight = np.array([len(x) + 1 for x in lines])
    return float((good * weight).sum() / weight.sum())


def test_quality_same_as_slow_version(spark):
    """The whole score of whole texts, whichever texts stand beside them."""
    folder = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{folder}/documents.parquet")
    model = quality.train(table, spark.read.parquet(f"{folder}/labels.parquet"))
    texts = ["Ends without a sign", "next one", "", "\n\n", "One.\nTwo?\nOne.\n  \nthree", *(r["text"] or "" for r in table.orderBy("doc_id").limit(20).collect() if len(r["text"] or "") < 6000)]
    want = [slow_quality(model, t) for t in texts]
    assert np.allclose(quality.score_batch(model, pa.array(texts)), want, atol=1e-6)
    assert np.allclose([quality.score_batch(model, pa.array([t]))[0] for t in texts], want, atol=1e-6)


def test_repeated_ids_and_clashing_names(spark):
    """Vectors, ids of tokens and quality scores of tables whose further columns are named like the operators' own."""
    draw = np.random.default_rng(2)
    rows = [(i, draw.normal(size=8).tolist(), 1, 2.0, 3) for i in range(60)] + [(20, draw.normal(size=8).tolist(), 1, 2.0, 3), (7, draw.normal(size=8).tolist(), 1, 2.0, 3)]
    wide = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int, score double, query_id int")
    found = permutation.nearest_report(wide).collect()
    by_query = {}
    for r in found:
        by_query.setdefault(r["query_id"], []).append(r["vec_id"])
    assert set(by_query) == {0, 20, 40} and all(len(v) == len(set(v)) == 20 and q not in v for q, v in by_query.items())
    docs = spark.createDataFrame([(1, "some text", 1, "x", 2.0), (1, "other", 1, "x", 2.0), (None, None, 1, "x", 2.0)], "doc_id long, text string, n_tokens int, ids_sha256 string, score double")
    path = P.path("byte_bpe_multi_50k.tiktoken")
    assert bpe.bpe_digest(docs, path, P.PATTERN).count() == 3
    assert bpe.bpe_encode(docs, path, P.PATTERN).columns == ["doc_id", "n_tokens", "ids_sha256", "score", "ids"]
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.held_out_scores(docs, labels).count() == 3


def test_workers_give_memory_back(monkeypatch):
    """A task of another operator drops the tokenizer that its worker keeps, and gives back what it used; scores take
    little memory besides the text."""
    import tracemalloc

    from flowlens.llm import common

    calls = []
    monkeypatch.setattr(common, "_KEPT", {})
    monkeypatch.setattr(common, "give_back", lambda: calls.append(sorted(common._KEPT)))
    path = P.path("word_bpe_49k.json")
    tokens = packing.load(path)
    assert list(common.tidy(iter, path)(iter("ab"))) == ["a", "b"] and packing.load(path) is tokens
    assert list(common.tidy(iter)(iter("c"))) == ["c"] and packing.load(path) is not tokens
    assert calls == [[path], []]

    none = quality.fit(np.zeros((0, 3 * quality.OWN)), np.zeros(0, np.int64), np.zeros(0))
    batch = pa.record_batch([pa.array(["Some words of a line.\n" * 50] * 4000)], ["text"])
    tracemalloc.start()
    for part in common.slices(batch, "text", quality.SLICE):
        quality.score_batch(none, part.column("text"))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 80e6, most


def test_quality_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality.held_out_scores(docs, none).collect()} == {0.5}


def test_packing(docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rows = packing.pack(docs, P.path("word_bpe_49k.json")).collect()
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        if r["doc_id"] is not None:
            ids = np.array([*tokenizer.encode(TEXTS[r["doc_id"]] or "", add_special_tokens=False).ids, 2], "<u4")
            assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
    assert sum(r["length"] for r in rows if r["start"] == 0 or r["doc_id"] is not None) >= len(ROWS)


def test_packing_histogram():
    for _ in range(50):
        histogram = {R.randint(1, 100): R.randint(1, 50) for _ in range(R.randint(1, 30))}
        counts = {}
        for count, lengths in packing.shortest_pack_first(dict(histogram), 100):
            assert sum(lengths) <= 100 and count > 0
            for x in lengths:
                counts[x] = counts.get(x, 0) + count
        assert counts == histogram


def test_packing_tokens_same_as_library():
    tokens = packing.load(P.path("word_bpe_49k.json"))
    signs = ["a", "The", "  ", "\n", " ", "'s", "'LL", "23²", "É", "漢字", "\x1c", "\x85", "İ", "ß", "!!", "😀", "</w>", "<|endoftext|>", "Σ", "\xad", "½", "_"]
    for _ in range(1500):
        text = "".join(R.choice(signs) for _ in range(R.randint(0, 25)))
        assert np.frombuffer(tokens.encode(text), "<u4").tolist() == tokens.tokenizer.encode(text, add_special_tokens=False).ids


def test_line_join(spark):
    vocabulary = [f"v{i}" for i in range(40)]
    base = [[R.choice(vocabulary) for _ in range(R.randint(1, 25))] for _ in range(30)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(R.randint(0, 6)):
            line = list(R.choice(base))
            if R.random() < 0.6:
                line[R.randrange(len(line))] = R.choice(vocabulary)
            lines.append(" ".join(line))
        rows.append((i, R.choice(["\n", "\n\n"]).join(lines)))
    rows += [(70, None), (71, ""), (72, "only words here"), (72, "only words here"), (73, "here words only"), (74, "long " * 5000)]
    got = sorted((r["doc_id"], r["n_lines"], r["n_removed"], r["text"]) for r in linejoin.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    want = sorted((i, n, m, x) for (i, _), (n, m, x) in zip(rows, linejoin.brute_force(rows), strict=True))
    assert got == want


def test_line_join_repeated_words(spark):
    """Lines of few words that differ in repeats alone are equal sets."""
    rows = [(0, "ha ha\nnew"), (1, "ha ha ha\n= = ="), (2, "= = = =\nno yes no"), (3, "yes no\nha"), (4, "a b c\nc c b a b\na b d"), (5, "yes yes no maybe\nk l m n o"), (6, "o n m l k k k")]
    got = sorted((r["doc_id"], r["n_lines"], r["n_removed"], r["text"]) for r in linejoin.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(i, *found) for (i, _), found in zip(rows, linejoin.brute_force(rows), strict=True)]
    assert [r[2] for r in got] == [0, 1, 1, 2, 1, 0, 1]


def test_line_join_keeps_columns(docs):
    assert linejoin.dedup_lines(docs).columns == [*docs.columns, "n_lines", "n_removed"]


def test_line_join_second_round():
    """Of many candidates the earliest and the nearest are reported first; the second round gives all."""
    n = 7
    rows = {"packed": np.full(n, 5 << 32 | 20 << 16), "key": np.arange(1, n + 1), "doc": np.arange(n), "line": np.zeros(n, np.int64), "parity": np.array([0, 0, 0, 0, 0, 1, 1])}
    later, earlier, word, more = linejoin.matches(rows)
    few = [(a, b) for a in range(1, 6) for b in range(1, a)]
    assert sorted(zip(later.tolist(), earlier.tolist(), strict=True)) == sorted([*few, (6, 1), (7, 1), (7, 6)])
    assert set(word.tolist()) == {5} and sorted(set(later[more].tolist())) == [6, 7]
    every = np.full(linejoin.ASKED >> 6, (1 << 64) - 1, np.uint64)
    assert len(linejoin.matches(rows, every)[0]) == n * (n - 1) // 2


def test_line_join_without_reports(spark, monkeypatch):
    """The second round alone finds what the first one would have to report."""
    monkeypatch.setattr(linejoin, "REPORTED", 0)
    rows = [(i, f"a b c d e f g h {'i' if i % 3 else 'j'}") for i in range(9)] + [(9, "k l m n o p")]
    got = sorted((r["doc_id"], r["n_lines"], r["n_removed"], r["text"]) for r in linejoin.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted((i, *found) for (i, _), found in zip(rows, linejoin.brute_force(rows), strict=True))


def test_substrings(spark):
    base = [R.choice(WORDS[:30]) for _ in range(300)]
    texts = [None, "", "a b " * 60, "c " * 100]
    for _ in range(40):
        own = [R.choice(WORDS) for _ in range(R.randint(0, 120))]
        if R.random() < 0.6:
            a, i = R.randint(0, 250), R.randint(0, len(own))
            own[i:i] = base[a : a + R.randint(20, 90)]
        texts.append(R.choice([" ", "\n", " \t"]).join(own))
    texts += [texts[5], texts[5] + " z"]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.repeat_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == substrings.brute_force([t or "" for t in texts])


def test_line_join_asks_for_few_texts(spark, monkeypatch):
    """Pairs just below the threshold are told apart by their wide maps, before any text is fetched."""
    asked, plain = [], linejoin.verified
    monkeypatch.setattr(linejoin, "verified", lambda pairs, *rest: asked.append(pairs.count()) or plain(pairs, *rest))
    rows = []
    for i in range(60):
        words = [f"w{i}x{k}" for k in range(56)]
        rows += [(2 * i, " ".join(words[:50])), (2 * i + 1, " ".join(words[6:]))]  # 44 of 56 words
    rows += [(200, " ".join(f"w0x{k}" for k in range(1, 51))), (201, " ".join(f"w1x{k}" for k in range(49)))]
    got = sorted((r["doc_id"], r["n_lines"], r["n_removed"], r["text"]) for r in linejoin.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(i, *found) for (i, _), found in zip(rows, linejoin.brute_force(rows), strict=True)]
    assert [r[0] for r in got if r[2]] == [200, 201]
    assert sum(asked) == 2  # the two that hold; the 64-bit maps alone leave a third


def test_line_join_keeps_rows_for_the_second_round(spark):
    """Rows of a word at which a class has more candidates than are reported come along, others don't; bundles lose none."""
    many = [[5 << 32 | 20 << 16, k, k, 0, 0] for k in range(7)]
    few = [[1 << 30 << 32 | 20 << 16, k, k, 0, 0] for k in range(3)]
    columns = [np.array(x, np.int64) for x in zip(*many, *few, strict=True)]
    parts = linejoin.ranges(spark)
    bundles = list(linejoin.bundled(iter([[x[:4] for x in columns], [x[4:] for x in columns]]), parts))
    assert sum(len(b.column("packed").values) for b in bundles) == 10
    found = linejoin.candidates(spark.createDataFrame(bundles[0].to_pylist(), linejoin.BUNDLES)).collect()
    assert sorted(r["key"] for r in found if r["later"] is None) == list(range(7))
    assert {r["later"] for r in found if r["more"]} == {5, 6}
    assert {(r["later"], r["earlier"]) for r in found if r["word"] == 1 << 30} == {(1, 0), (2, 0), (2, 1)}


def test_line_join_wide_map():
    """Both halves hold each word of a line once, by the bits of its hash."""
    lines = linejoin.Lines(linejoin.pa.array(["a b c a", "", "d\ne f g h i j"]))
    for k, (low, high) in enumerate(zip(*lines.wide(), strict=True)):
        want = 0
        for w in lines.words[lines.nth == k].tolist():
            want ^= 1 << ((w >> 40 & 63) + (0 if w >> 46 & 1 else 64))
        assert (int(low) & (2**64 - 1)) | (int(high) & (2**64 - 1)) << 64 == want



def test_substrings_of_a_common_line(spark):
    """A line in many documents, with other words around it in each, doesn't bring all its segments to one task."""
    line = [f"licence{i}" for i in range(30)]
    texts = [None, "a b " * 60]
    for k in range(80):
        own = [f"x{R.randint(0, 10**9)}" for _ in range(80)]
        texts.append(" ".join([*own[:40], *line, *(["same"] * 6 if k % 4 == 0 else []), *own[40:]]))
    texts += [texts[3], texts[6] + " z"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for most in (0, 2000, substrings.SHARD):
        found = substrings.remove_repeats(docs, most=most).collect()
        got = {r["doc_id"]: (r["n_words"], r["n_removed"], hashlib.sha256(r["kept_text"].encode()).hexdigest()) for r in found}
        assert [got[i] for i in range(len(texts))] == substrings.brute_force([t or "" for t in texts])
    sent = spark.createDataFrame([(k % 3, k % 2 * k, k, 1, t.encode()) for k, t in enumerate(texts[2:60])], "_block int, least long, key long, count long, text binary")
    light, repeated = substrings.parted(sent, substrings.WIDTH, 4000)
    assert {r["least"] for r in light.collect()} == set(range(1, 58, 2)) and repeated.count() > 0


def test_pipeline(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, folder).cache()
        assert docs.columns == before.columns
        seen.append(docs.count())
    assert seen == sorted(seen, reverse=True) and seen[-1] > 0
    kept = docs.select("text").collect()
    assert not any(pii.base_spans(r["text"]) for r in kept)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}


def test_stages_take_odd_input(spark, docs, none):
    """Null and repeated ids, null and empty texts, repeated rows, empty tables: every stage keeps its columns."""
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns and out.count() <= docs.count(), name
        assert stage(spark, none, "/root/testdata/sf0.001").count() == 0, name
    assert corpus_pipeline.packing_stage(spark, docs, "").select("doc_id").distinct().count() == len(TEXTS) + 1
    assert corpus_pipeline.packing_stage(spark, none, "").count() == 0


def test_near_duplicate_stage_tells_rows_apart(spark):
    """Different texts under one id both stay; copies without an id or with a larger one go."""
    import corpus_pipeline

    one, other, third = (" ".join(f"{w}{i}" for i in range(40)) for w in "abc")
    rows = [(1, one, "en", "s", 1), (1, other, "en", "s", 2), (None, third, "en", "s", 3), (None, third, "en", "s", 4), (5, third, "en", "s", 5), (9, third, "en", "s", 6), (7, None, "en", "s", 0), (8, " ", "en", "s", 1)]
    got = corpus_pipeline.near_duplicate_stage(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert sorted((r["doc_id"], r["n_chars"]) for r in got) == [(1, 1), (1, 2), (5, 5), (7, 0)]


def test_pipeline_same_as_brute_force(spark):
    """run() against the stages written out text by text."""
    import corpus_pipeline
    import pyarrow as pa
    from tokenizers import Tokenizer

    folder = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{folder}/documents.parquet")
    model = quality.train(table, spark.read.parquet(f"{folder}/labels.parquet").where(ctw.fold("doc_id", 3) != 1))
    rows = sorted((r["doc_id"], r["text"] or "") for r in table.collect())
    rows = [r for r, good in zip(rows, quality.score_batch(model, pa.array([t for _, t in rows])), strict=True) if good >= 0.5]
    rows = [(i, kept) for (i, _), (_, _, kept) in zip(rows, linejoin.brute_force(rows), strict=True)]
    prints = [simhash.fingerprint(t) for _, t in rows]
    part = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                low, high = sorted((part[a], part[b]))
                part = [low if p == high else p for p in part]
    rows = [r for k, r in enumerate(rows) if part[k] == k]
    field = pii.train(spark.createDataFrame(rows, "doc_id long, text string"))
    tokenizer, want = Tokenizer.from_file(P.path("word_bpe_49k.json")), {}
    for i, text in rows:
        parts, end = [], 0
        for span in pii.find_spans([text], field)[0][1]:
            if span.start >= end:
                parts += [text[end : span.start], f"<{pii.KINDS[span.kind].upper()}>"]
                end = span.end
        ids = np.array([*tokenizer.encode("".join([*parts, text[end:]]), add_special_tokens=False).ids, 2], "<u4")
        for start in range(0, len(ids), 4096):
            want[i, start] = (min(4096, len(ids) - start), zlib.crc32(ids[start : start + 4096].tobytes()))
    got = corpus_pipeline.run(spark, folder).collect()
    assert {(r["doc_id"], r["start"]): (r["length"], r["ids_crc32"]) for r in got} == want and len(got) == len(want)
