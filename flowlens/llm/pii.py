"""Personal data: patterns, and a skip-chain conditional random field that makes labels agree within a document.

The variables are the tokens of a document that hold a digit or an at sign. Tokens side by side share chain
potentials; equal tokens, and numbers that end in the same seven digits, are linked however far apart, each to
its next like and to the nearest like that is evidence, and share potentials that favour one label. Loopy message
passing over all links of many documents at once, each until its own messages settle, gives the marginals. Tokens of
base spans are evidence, so a number that is written out as a phone number once is found where it lacks its plus
sign, at any distance. Texts without a base span are labelled too, by their own tokens and links. Besides the four
kinds there is a fifth label, `secret` (passwords, access tokens, keys): nothing is evidence for it, so all of its
spans come from the field.

Weights are fitted piecewise on at most SAMPLE documents (in the order of a hash; if these hold no label, on documents
that do) and at most FITTED tokens of each: the node weights by softmax regression on base spans and on tokens that
follow a word such as "password" and an equals sign or colon, the links by how often the labels they join agree. Phone
numbers are learned a second time without their plus sign, so that other forms of them are known.

Defined results: null and empty texts have no spans (redaction makes a null text empty); base spans always stay and
added ones never touch them; offsets count code points; texts of any length take time in proportion to it; repeated
rows get equal spans; other columns pass unchanged.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, tidy, whole_text

KINDS = ("email", "ip", "card", "phone", "secret")
#: Kinds that have a base pattern, and the labels of the field: none, or one more than the kind.
BASE, LABELS = 4, 6
SAMPLE = 4000
#: Tokens of a document that weights are fitted on; of more, evenly spaced ones.
FITTED = 4096
#: Messages have settled if none changes by more; if they come no nearer for so many rounds, the step is halved.
SETTLED, PATIENCE = 1e-4, 100
#: Tokens that are labelled at a time (a text of more comes alone).
TOKENS = 1 << 16

LOCAL = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-"
MARK = re.compile("[0-9@]")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
NOT_DIGIT = re.compile("[^0-9]+")
TOKEN = re.compile(r"[A-Za-z0-9@._%+()-]++")
CUES = (re.compile("mail|contact"), re.compile("phone|tel|call|fax|mobil"), re.compile("card|visa|kart|tarj|carte"), re.compile(r"\bip\b|host|addr|server"), re.compile("token|passw|pwd|secret|key|credential"))
GIVEN = re.compile("""[=:]\\s*["']?$""")
#: Words and signs after which a token is learned as a secret.
SEED = re.compile(r"""(?:token|password|passwd|pwd|secret|key)\s*[=:]\s*["']?$""", re.IGNORECASE)
HEX = re.compile("[0-9a-fA-F]+")


class Span(NamedTuple):
    start: int
    kind: int
    end: int


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    at, free = text.find("@"), 0
    while at >= 0:
        head = text[free:at]
        start = free + len(head.rstrip(LOCAL))
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
        free = found.end() if found else at + 1
        at = text.find("@", free)


def base_spans(text: str) -> list[Span]:
    """Matches of the four patterns, leftmost and without overlap for each kind, by start and then kind."""
    if not MARK.search(text):
        return []
    spans = [Span(a, 0, b) for a, b in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
            spans.append(Span(m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = NOT_DIGIT.sub("", m[0]) if m.end() - m.start() < 64 else ""
        if 12 <= len(digits) <= 19 and luhn(digits):
            spans.append(Span(m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                spans.append(Span(m.start(), 3, m.end()))
    return sorted(spans)


class Token(NamedTuple):
    start: int
    end: int
    value: str
    digits: str


def tokens(text: str) -> list[Token]:
    out = []
    for m in TOKEN.finditer(text):
        if MARK.search(m[0]):
            value = m[0].lstrip(".-_%").rstrip(".-_%(")
            start = m.start() + len(m[0]) - len(m[0].lstrip(".-_%"))
            out.append(Token(start, start + len(value), value, NOT_DIGIT.sub("", value)))
    return out


def joins(text: str, a: Token, b: Token) -> bool:
    return b.start - a.end <= 2 and not text[a.end : b.start].strip(" ().-")


WIDTH = 27
#: Place of the feature for a plus sign.
PLUS = 10


def features(text: str, found: list[Token]) -> np.ndarray:
    out = np.zeros((len(found), WIDTH))
    for i, t in enumerate(found):
        n, row = len(t.digits), out[i]
        parts = t.value.split(".")
        row[0] = 1
        row[1] = "@" in t.value and "." in t.value.rpartition("@")[2]
        row[2] = len(parts) == 4 and all(p.isascii() and p.isdigit() for p in parts)
        row[3] = row[2] and all(len(p) < 5 and int(p) <= 255 for p in parts)
        row[4 + int(np.searchsorted([3, 4, 8, 11, 19], n))] = 1
        row[PLUS] = t.value[:1] == "+"
        row[11] = "(" in t.value or ")" in t.value
        row[12] = "-" in t.value
        row[13] = n > 0 and not any(c.isalpha() for c in t.value)
        row[14] = "@" not in t.value and any(c.isalpha() for c in t.value)
        row[15] = 12 <= n <= 19 and luhn(t.digits)
        left = text[max(0, t.start - 24) : t.start].lower()
        for k, cue in enumerate(CUES):
            row[16 + k] = bool(cue.search(left))
        row[21] = i > 0 and joins(text, found[i - 1], t)
        row[22] = i + 1 < len(found) and joins(text, t, found[i + 1])
        row[23] = bool(GIVEN.search(left))
        row[24] = row[14] and len(t.value) >= 16
        row[25] = row[14] and len(t.value) >= 8 and bool(HEX.fullmatch(t.value))
        row[26] = row[20] and row[23] and len(t.value) >= 8
    return out


def chain_links(text: str, found: list[Token]) -> list[tuple[int, int]]:
    return [(i, i + 1) for i in range(len(found) - 1) if joins(text, found[i], found[i + 1])]


def likes(t: Token) -> list[str]:
    """What a token shares with its likes: the same text, or at least seven digits and the same last seven."""
    out = [t.value.lower()] if "@" in t.value or len(t.digits) >= 4 else []
    return [*out, f"#{t.digits[-7:]}"] if "@" not in t.value and len(t.digits) >= 7 else out


def skip_links(found: list[Token], known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Each token to its next like; with known labels also each unknown one to the nearest known like before it, or
    else to the first after it, so that evidence is one link away in texts of any length."""
    last: dict[str, int] = {}
    out = []
    for i, t in enumerate(found):
        own = likes(t)
        linked = {last[key] for key in own if key in last}
        out += [(j, i) for j in sorted(linked)]
        last |= dict.fromkeys(own, i)
    if known is None or not known.any():
        return out
    evidence: dict[str, int] = {}
    for i in reversed(np.flatnonzero(known).tolist()):
        evidence |= dict.fromkeys(likes(found[i]), i)
    more = set()
    for i, t in enumerate(found):
        own = likes(t)
        if known[i]:
            evidence |= dict.fromkeys(own, i)
        else:
            more |= {(min(i, evidence[key]), max(i, evidence[key])) for key in own if key in evidence}
    return out + sorted(more - set(out))


def labels(found: list[Token], spans: list[Span]) -> np.ndarray:
    """0 or one more than the kind of a base span that the token overlaps; a later kind gives way."""
    out = np.zeros(len(found), np.int64)
    starts = [t.start for t in found]
    for span in reversed(spans):
        for i in range(max(0, int(np.searchsorted(starts, span.start, "right")) - 1), len(found)):
            if found[i].start >= span.end:
                break
            if found[i].end > span.start:
                out[i] = span.kind + 1
    return out


def seeds(text: str, found: list[Token]) -> np.ndarray:
    """Which tokens are learned as secrets."""
    return np.array([len(t.value) >= 8 and "@" not in t.value and bool(SEED.search(text[max(0, t.start - 24) : t.start])) for t in found], bool)


class Model(NamedTuple):
    node: np.ndarray  # WIDTH x LABELS
    chain: np.ndarray  # LABELS x LABELS, log potentials
    skip: float  # log potential of agreement


def fit(x: np.ndarray, y: np.ndarray, chain: np.ndarray, skip: np.ndarray, penalty: float = 0.003) -> Model:
    """x, y: tokens; chain, skip: counts (LABELS, LABELS) of the labels that links join."""
    weights, momentum, speed = (np.zeros((WIDTH, LABELS)) for _ in range(3))
    wanted = np.eye(LABELS)[y]
    for step in range(1, 301 if len(y) else 1):
        score = x @ weights
        chance = np.exp(score - score.max(1, keepdims=True))
        slope = x.T @ (wanted - chance / chance.sum(1, keepdims=True)) / len(y) - penalty * weights
        momentum, speed = 0.9 * momentum + 0.1 * slope, 0.99 * speed + 0.01 * slope**2
        weights = weights + 0.05 * (momentum / (1 - 0.9**step)) / (np.sqrt(speed / (1 - 0.99**step)) + 1e-8)
    both = chain + 0.5
    lift = np.log(both * both.sum() / (both.sum(1, keepdims=True) * both.sum(0, keepdims=True)))
    same = np.trace(skip)
    return Model(weights, np.clip(lift, -2, 2), float(np.clip(np.log((same + 4) / (skip.sum() - same + 1)), 0, 6)))


def marginals(unary: np.ndarray, links: np.ndarray, potentials: np.ndarray, rounds: int | None = None, text: np.ndarray | None = None) -> np.ndarray:
    """Loopy sum-product in the log domain. links: pairs of nodes; potentials: (links, labels, labels); text: of each node. Each
    text goes on until its own messages settle, whatever else it is worked on with; rounds: a fixed number instead."""
    if not len(links):
        out = np.exp(unary - unary.max(1, keepdims=True))
        return out / out.sum(1, keepdims=True)
    if text is None:
        text = np.zeros(len(unary), np.int64)
    message = np.zeros((2 * len(links), unary.shape[1]))
    step, least, since = np.full(int(text.max()) + 1, 0.5), np.full(int(text.max()) + 1, np.inf), np.zeros(int(text.max()) + 1, np.int64)
    going, turn = np.arange(len(links)), 0
    while len(going) and turn != rounds:
        n = len(going)
        if not turn or n < active:  # the messages of the texts that go on, both ways
            active = n
            src, dst = (np.concatenate([links[going, k], links[going, 1 - k]]) for k in (0, 1))
            both = np.concatenate([potentials[going], potentials[going].transpose(0, 2, 1)])
            at, back = np.concatenate([going, going + len(links)]), np.roll(np.arange(2 * n), n)
            nodes, where = np.unique(src, return_inverse=True)
            to = np.searchsorted(nodes, dst)
            own = text[src]
        old = message[at]
        belief = unary[nodes]
        np.add.at(belief, to, old)
        new = np.logaddexp.reduce((belief[where] - old[back])[:, :, None] + both, axis=1)
        new -= np.logaddexp.reduce(new, axis=1)[:, None]
        pace = step[own][:, None]
        message[at] = (1 - pace) * old + pace * new
        turn += 1
        if rounds is None:
            change = np.zeros(len(step))
            np.maximum.at(change, own, np.abs(message[at] - old).max(1) if turn > 1 else np.full(len(at), np.inf))
            better = change < 0.9 * least
            least, since = np.where(better, change, least), np.where(better, 0, since + 1)
            step, since = np.where(since > PATIENCE, step / 2, step), np.where(since > PATIENCE, 0, since)
            going = going[change[text[links[going, 0]]] > SETTLED]
    belief = unary.copy()
    np.add.at(belief, np.concatenate([links[:, 1], links[:, 0]]), message)
    out = np.exp(belief - belief.max(1, keepdims=True))
    return out / out.sum(1, keepdims=True)


#: What an added span must hold of its kind: digits at least and at most.
NEEDS = ((0, 1 << 30), (4, 12), (12, 19), (7, 15), (1, 1 << 30))
#: Fewest characters of a secret.
SECRET = 8


def find_spans(texts: list[str], model: Model | None) -> list[tuple[list[Span], list[Span]]]:
    """Base spans and all spans of each text."""
    bases = [base_spans(text) for text in texts]
    out = [(b, b) for b in bases]
    if model is None:
        return out
    graph: list[tuple[int, list[Token]]] = []
    size = 0
    for k, text in enumerate(texts):
        found = tokens(text) if MARK.search(text) else []
        if size and size + len(found) > TOKENS:
            label_tokens(texts, bases, graph, model, out)
            graph, size = [], 0
        if found:
            graph.append((k, found))
            size += len(found)
    label_tokens(texts, bases, graph, model, out)
    return out


def label_tokens(texts: list[str], bases: list[list[Span]], graph: list[tuple[int, list[Token]]], model: Model, out: list[tuple[list[Span], list[Span]]]) -> None:
    """Puts the spans that the field adds to the texts of graph into out."""
    first, rows, links, kinds, known, owner = 0, [], [], [], [], []
    for nth, (k, found) in enumerate(graph):
        own = labels(found, bases[k])
        chain, skip = chain_links(texts[k], found), skip_links(found, own)
        rows.append(features(texts[k], found))
        known.append(own)
        owner.append(np.full(len(found), nth))
        links += [(first + a, first + b) for a, b in chain + skip]
        kinds += [0] * len(chain) + [1] * len(skip)
        first += len(found)
    if not graph:
        return
    known = np.concatenate(known)
    unary = np.clip(np.concatenate(rows) @ model.node, -8, 8)
    unary[known > 0] = -20
    unary[known > 0, known[known > 0]] = 0
    tables = np.stack([model.chain, model.skip * np.eye(LABELS)])
    chance = marginals(unary, np.array(links, np.int64).reshape(-1, 2), tables[np.array(kinds, np.int64)], text=np.concatenate(owner))
    best = chance.argmax(1)
    best[chance.max(1) < 0.5] = 0
    first = 0
    for k, found in graph:
        own, was = best[first : first + len(found)], known[first : first + len(found)]
        first += len(found)
        added, text = [], texts[k]
        i = 0
        while i < len(found):
            j = i + 1
            if own[i] and not was[i]:
                while j < len(found) and own[j] == own[i] and not was[j] and joins(text, found[j - 1], found[j]):
                    j += 1
                start, end, kind = found[i].start, found[j - 1].end, int(own[i]) - 1
                n = sum(len(t.digits) for t in found[i:j])
                least, most = NEEDS[kind]
                fits = least <= n <= most and ("@" in text[start:end]) == (kind == 0) and (kind < BASE or end - start >= SECRET)
                if fits and all(s.end <= start or s.start >= end for s in bases[k]):
                    added.append(Span(start, kind, end))
            i = j
        if added:
            out[k] = (bases[k], sorted(bases[k] + added))


def train(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Fitted on the tokens of at most `sample` documents; their counts and features come to the driver. If these hold
    no label, of documents that do; None if there are none, as nothing is known of any kind then."""
    texts = docs.select(whole_text().alias("_text"))
    x, y, chain, skip = gather(texts, sample)
    if not y.any():
        x, y, chain, skip = gather(texts.where(MARK_SQL).mapInArrow(with_labels, "_text string"), sample)
        if not y.any():
            return None
    x, y = x.reshape(-1, WIDTH), y.astype(np.int64)
    plain = x[(y == 4) & (x[:, PLUS] > 0)]
    plain[:, PLUS] = 0
    x, y = np.concatenate([x, plain]), np.concatenate([y, np.full(len(plain), 4)])
    return fit(x, y, *(table.reshape(-1, LABELS, LABELS).sum(0) for table in (chain, skip)))


def learned(text: str, found: list[Token]) -> np.ndarray:
    """The labels that weights are fitted on."""
    out = labels(found, base_spans(text))
    out[(out == 0) & seeds(text, found)] = BASE + 1
    return out


def carried(y: np.ndarray, links: list[tuple[int, int]]) -> np.ndarray:
    """Labels with those of likes: a repeat that has no cue of its own isn't known to differ, so it doesn't count as a
    token that disagrees. Tokens of two different labels still do."""
    out, open_ = y.copy(), links
    while True:
        found = [(a, b) for a, b in open_ if (out[a] == 0) != (out[b] == 0)]
        if not found:
            return out
        for a, b in found:
            out[a], out[b] = (out[a] or out[b]), (out[b] or out[a])


def with_labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.filter(pa.array([bool(learned(text, tokens(text)).any()) for text in batch.column("_text").to_pylist()], pa.bool_()))


def gather(texts: DataFrame, sample: int) -> list[np.ndarray]:
    """Features and labels of the tokens and label counts of the links of the first `sample` texts by hash; equal
    texts have equal hashes, so which of them are taken makes no difference."""
    hashed = texts.select(F.xxhash64("_text").alias("h"))
    edge = hashed.orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    if edge is None:
        return [np.zeros(0)] * 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column("_text").to_pylist():
                found = tokens(text)
                y = learned(text, found)
                skips = skip_links(found)
                pairs = [np.zeros((LABELS, LABELS)), np.zeros((LABELS, LABELS))]
                for table, links, own in zip(pairs, (chain_links(text, found), skips), (y, carried(y, skips)), strict=True):
                    for a, b in links:
                        table[own[a], own[b]] += 1
                some = np.unique(np.linspace(0, len(found) - 1, min(len(found), FITTED)).astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array([x.astype(np.float32).tobytes()], pa.binary()) for x in (features(text, found)[some], y[some], *pairs)], ["x", "y", "chain", "skip"])

    some = texts.where(MARK_SQL).where(F.xxhash64("_text") <= edge).orderBy(F.xxhash64("_text")).limit(sample).mapInArrow(tidy(run), "x binary, y binary, chain binary, skip binary").toArrow()
    return [np.frombuffer(b"".join(some.column(c).to_pylist()), np.float32).astype(np.float64) for c in ("x", "y", "chain", "skip")]


MARK_SQL = "_text rlike '[0-9@]'"


def scan(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, base and spans, arrays of struct<kind, start, end> by start and then kind."""
    kind = dict(docs.dtypes)["doc_id"]
    known = docs.sparkSession.sparkContext.broadcast(model)
    struct = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                found = find_spans(part.column("_text").to_pylist(), known.value)
                columns = [pa.array([[{"kind": KINDS[s.kind], "start": s.start, "end": s.end} for s in spans] for spans in one], pa.list_(struct)) for one in zip(*found, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], ["doc_id", "base", "spans"])

    spans = "array<struct<kind: string, start: bigint, end: bigint>>"
    return docs.select("doc_id", whole_text().alias("_text")).mapInArrow(tidy(run), f"doc_id {kind}, base {spans}, spans {spans}")


def redact(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """docs with every span of `text` replaced by its kind in angle brackets; of overlapping ones the first counts."""
    known = docs.sparkSession.sparkContext.broadcast(model)

    at = docs.columns.index(text)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole.set_column(at, text, whole.column(at).fill_null("")), text)):
            texts = batch.column(at).to_pylist()
            out = []
            for own, (_, spans) in zip(texts, find_spans(texts, known.value), strict=True):
                parts, end = [], 0
                for span in spans:
                    if span.start >= end:
                        parts += [own[end : span.start], f"<{KINDS[span.kind].upper()}>"]
                        end = span.end
                out.append("".join([*parts, own[end:]]))
            yield batch.set_column(at, text, pa.array(out, pa.string()))

    return docs.mapInArrow(tidy(clean), docs.schema)


def span_report(docs: DataFrame) -> DataFrame:
    model = train(docs)
    found = scan(docs.select("doc_id", "text"), model)
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    counts = [F.size(F.expr(f"filter(base, s -> s.kind = '{k}')")).cast("long").alias(f"n_{k}") for k in KINDS[:BASE]]
    added = (F.size("spans") - F.size("base")).cast("long").alias("n_added")
    return found.select("doc_id", *counts, F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"), added)


def brute_force(text: str) -> tuple[list[int], str]:
    """Counts and base_sha256 by the patterns as they are written; for tests."""
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    spans = []
    for k, (kind, pattern) in enumerate(patterns.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                spans.append((m.start(), k, m.end(), kind))
    spans.sort()
    return [sum(s[1] == k for s in spans) for k in range(4)], hashlib.sha256(",".join(f"{s[3]}:{s[0]}:{s[2]}" for s in spans).encode()).hexdigest()
