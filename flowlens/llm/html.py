"""Main text of web pages by deduction of each host's template from equivalence classes of tokens.

Tokens are tags, told apart by the path of elements they stand in, and words, told apart by that path too (a long run of
words is one token). Tokens that occur equally often on every page of a host have one occurrence vector and form an
equivalence class; large and frequent ones are kept. A class is valid if its tokens come in one order on all pages and
its stretches nest with those of other classes. The valid classes nested are the host's template: what a page has between
its tokens are the slots. Slots that stand in menus, headers, footers, sidebars, notices, adverts, forms and comments
(told by the element, its role or the words of its class and id) and slots that hold mostly links over all of the host's
pages are left out, and so is text that the template itself has. The rest, within `article` or `main` where a page has
them, is the page's main text.

Vectors are never held: a vector is known by the sum of a hash of page and count, added up map-side and over the
cluster by host and token, so that a host with a third of all pages is spread over many tasks. Pages meet their host's
template by a join on the host that Spark may split where one host is large.

Defined results: null and empty html give an empty text; null urls are one host; hosts of fewer than three pages have no
template, and their pages are judged by their elements alone; paragraphs and headings of an article stay though all
pages share them; broken markup is closed where a browser would close it; pages of any length are whole; repeated rows
and ids give a row each; further columns are left out, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, mix, slices, whole_text

#: Runs of more words than this are one token; classes have at least these tokens, on these pages and this share of them.
LONG_RUN, LEAST_TOKENS, LEAST_PAGES, LEAST_SHARE = 40, 3, 3, 0.5
#: A slot whose characters stand in links to more than this share over a host is a menu.
LINKS = 0.5
PARTS = 32
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?|<[!?/][^>]*>?|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

# Elements of HTML by what they do.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes noscript template".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
DROPPED = set(
    "head title script style noscript template iframe noembed noframes object embed svg canvas audio video nav header footer aside form button select option"
    " textarea input dialog menu".split()
)
CLOSED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}
HEAD = set("head title meta link base style script noscript template".split())
#: Elements that an implied end tag doesn't reach beyond.
SCOPE = set("html body article main section div table ul ol dl nav header footer aside form blockquote td th".split())
PLAIN = set("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dd dt figcaption".split())
ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
#: Words of class and id that name what isn't the article.
NAMES = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promoted promotion banner nav navbar navigation menu submenu breadcrumb breadcrumbs header masthead"
    " topbar footer sidebar aside widget widgets cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login social share"
    " sharing related recommended recommendations comment comments respond disqus replies reply pagination pager toolbar skip search alert".split()
)
COMMENTS = set("comment comments reply replies respond disqus".split())


@lru_cache(1 << 16)
def hashed(*parts: str) -> int:
    return xxhash.xxh64_intdigest("\0".join(parts))


class Element:
    __slots__ = ("tag", "path", "key", "mark", "inner", "main", "up", "link")

    def __init__(self, tag: str, path: str, mark: int, main: bool, up: Element | None, link: bool):
        self.tag, self.path, self.main, self.up, self.link = tag, path, main, up, link
        # The marks of all elements around it, and of those within the main one.
        self.mark = max(mark, up.mark) if up else mark
        self.inner = max(mark, up.inner) if up and up.main else 0
        self.key = hashed(path)

    def keys(self) -> list[int]:
        """Its own and its ancestors' path, nearest first, each once."""
        found, element = [], self
        while element.up:
            if not found or found[-1] != element.key:
                found.append(element.key)
            element = element.up
        return found


@lru_cache(1 << 14)
def judged(tag: str, attributes: str) -> tuple[str, int, bool]:
    """An element's label, its mark (2: not of the article by element, role or hiding, 1: by name) and whether it is the main one."""
    found = {}
    for m in ATTRIBUTE.finditer(attributes):
        found.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    words = sorted({w.lower() for w in WORDS.findall(found.get("class", "") + " " + found.get("id", ""))})
    role = found.get("role", "").lower()
    main = tag in ("article", "main") or role in ("main", "article") or "articleBody" in found.get("itemprop", "")
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display:\s*none|visibility:\s*hidden", found.get("style", ""))
    named = set(words) & (COMMENTS if main else NAMES)
    mark = 2 if tag in DROPPED or role in ROLES or hidden else 1 if named and tag not in ("html", "body") and tag != "main" else 0
    return ".".join([tag, *words]), mark, main and not mark


class Page:
    """The tokens of a page in order, and its runs of text: (element, text, characters, of them in links)."""

    def __init__(self, source: str):
        self.tokens: list[int] = []
        self.runs: list[tuple[Element, str, int, int]] = []
        self.run_tokens: list[list[int]] = []
        self.now, self.parts, self.linked = Element("", "", 0, False, None, False), [], 0
        self.holder = self.now
        self.mains: list[Element] = []
        self.read(source)

    def read(self, source: str) -> None:
        at, size = 0, len(source)
        while at < size:
            m = TOKEN.match(source, at)
            at = m.end()
            name = m[2]
            if name is None:
                if source[m.start()] != "<" or at - m.start() == 1:
                    self.text(m[0])
                continue
            name = name.lower()
            if m[1]:
                self.close(name)
                continue
            self.open(name, m[3])
            if name in RAW:
                end = re.compile(f"</{re.escape(name)}(?=[\\s/>]|\\Z)", re.I).search(source, at)
                at = end.start() if end else size
        while self.now.up:
            self.pop()
        self.flush()

    def text(self, raw: str) -> None:
        if self.now.tag == "head" and raw.strip():
            self.pop()
        if not self.parts:
            self.holder = self.now
        text = html.unescape(raw) if "&" in raw else raw
        self.parts.append(text)
        if self.now.link:
            self.linked += len("".join(text.split()))

    def flush(self) -> None:
        if not self.parts:
            return
        words = "".join(self.parts).split()
        if words:
            key, text = self.holder.key, " ".join(words)
            own = [xxhash.xxh64_intdigest(w, key) for w in (words if len(words) <= LONG_RUN else [text])]
            self.tokens += own
            chars = sum(map(len, words))
            self.runs.append((self.holder, text, chars, min(self.linked, chars)))
            self.run_tokens.append(own)
        self.parts, self.linked = [], 0

    def open(self, tag: str, attributes: str) -> None:
        inline = tag in INLINE
        if tag in VOID:
            if tag in ("br", "hr"):
                self.flush()
            return
        label, mark, main = (judged if len(attributes) < 4000 else judged.__wrapped__)(tag, attributes)
        if not inline or mark:
            self.flush()
        if not inline:
            self.imply(tag)
        up = self.now
        path = up.path if inline else f"{up.path}/{label}"
        self.now = Element(tag, path, mark, main or up.main, up, tag == "a" or (inline and up.link))
        if main and not up.main:
            self.mains.append(self.now)
        if not inline:
            self.tokens.append(self.now.key)

    def imply(self, tag: str) -> None:
        """Close what a new element ends."""
        closed = CLOSED_BY.get(tag, set()) | {"p"} | ({"head"} if tag not in HEAD else set())
        element, last = self.now, None
        while element.up:
            if element.tag in closed:
                last = element
            if element.tag in SCOPE and element.tag not in closed:
                break
            element = element.up
        while last and self.now is not last.up:
            self.pop()

    def close(self, tag: str) -> None:
        element = self.now
        while element.up and element.tag != tag:
            element = element.up
        if not element.up:
            return
        if tag not in INLINE:
            self.flush()
        elif self.now.mark > element.up.mark:
            self.flush()
        elif any(e.tag not in INLINE for e in self.between(element)):
            return
        while self.now is not element.up:
            self.pop()

    def between(self, element: Element) -> Iterator[Element]:
        now = self.now
        while now is not element:
            yield now
            now = now.up

    def pop(self) -> None:
        if self.now.tag not in INLINE:
            self.flush()
            self.tokens.append(hashed(self.now.path, "end"))
        self.now = self.now.up


def main_text(page: Page, classes: dict[int, int], linked: set[int]) -> str:
    """The text of the slots that are the article. `classes` has the template's tokens, `linked` those of slots of links."""
    inside = any(not e.mark for e in page.mains)
    # An element named like a sidebar that holds all there is isn't one.
    lenient = not inside and any(e.mark < 2 for e in page.mains)
    out = []
    for (element, text, chars, links), tokens in zip(page.runs, page.run_tokens):
        if element.mark == 2 or (element.inner if lenient else element.mark) or ((inside or lenient) and not element.main):
            continue
        holder = element
        while holder.tag in INLINE and holder.up:
            holder = holder.up
        template = all(t in classes for t in tokens)
        if element.main:
            if template and holder.tag not in PLAIN and not holder.tag == "article":
                continue
        else:
            slot = next((k for k in element.keys() if k in classes), None)
            if template or (slot in linked if slot is not None else links > LINKS * chars):
                continue
        out.append(text)
    return " ".join(out)


TOKENS = "host long, token long, low long, high long, pages long, chars long, links long"


def signed(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint64).view(np.int64)


def token_sums(pages: DataFrame) -> DataFrame:
    """host, token, the two halves of the hash of its occurrence vector, pages that have it, and the characters (and
    those in links) of the text that stands in it. The token 0 stands once on every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                hosts, keys, counts, marks, chars, links = [], [], [], [], [], []
                for host, mark, source in zip(*(part.column(c).to_pylist() for c in ("host", "page", "html"))):
                    page = Page(source)
                    text: dict[int, list[int]] = {}
                    for element, _, n, linked in page.runs:
                        for key in element.keys():
                            sums = text.setdefault(key, [0, 0])
                            sums[0] += n
                            sums[1] += linked
                    own, times = np.unique(np.array([0, *page.tokens], np.uint64), return_counts=True)
                    known = [text.get(t, (0, 0)) for t in own.tolist()]
                    hosts.append(np.full(len(own), host, np.int64))
                    marks.append(np.full(len(own), mark, np.int64))
                    keys.append(own), counts.append(times), chars.append([k[0] for k in known]), links.append([k[1] for k in known])
                if not keys:
                    continue
                host, mark, key, count, char, link = map(np.concatenate, (hosts, marks, keys, counts, chars, links))
                vector = mix(mark.view(np.uint64) + mix(count.astype(np.uint64)))
                order = np.lexsort((key, host))
                host, key, vector = host[order], key[order], vector[order]
                first = np.flatnonzero(np.append(True, (host[1:] != host[:-1]) | (key[1:] != key[:-1])))
                sums = [np.add.reduceat(v, first) for v in ((vector & np.uint64(0x7FFFFFFF)).astype(np.int64), (vector >> np.uint64(33)).astype(np.int64), np.ones(len(key), np.int64), char[order], link[order])]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (host[first], signed(key[first]), *(s.astype(np.int64) for s in sums))], TOKENS.replace(" long", "").split(", "))

    local = pages.select("host", F.xxhash64("page_id", "url").alias("page"), "html").mapInArrow(run, TOKENS)
    return local.groupBy("host", "token").agg(*(F.sum(c).alias(c) for c in ("low", "high", "pages", "chars", "links")))


def equivalence_classes(pages: DataFrame) -> DataFrame:
    """host, and of the tokens of its large and frequent classes: token, class (a number within the host), and whether
    the text in it is mostly links."""
    sums = materialise(token_sums(pages).where(F.col("pages") >= LEAST_PAGES))
    # The totals go along in parts, so that the tokens of a large host meet them in many tasks.
    total = sums.where("token = 0").select("host", F.col("pages").alias("all"), F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
    often = sums.withColumn("part", F.pmod("token", F.lit(PARTS)).cast("int")).join(total, ["host", "part"]).where((F.col("token") != 0) & (F.col("pages") >= LEAST_SHARE * F.col("all")))
    classes = often.groupBy("host", "low", "high").agg(F.collect_list(F.struct("token", (F.col("links") > LINKS * F.col("chars")).alias("linked"))).alias("tokens"))
    large = classes.where(F.size("tokens") >= LEAST_TOKENS)
    member = large.select("host", F.xxhash64("low", "high").alias("class"), F.explode("tokens").alias("t")).select("host", F.struct("t.token", "class", "t.linked").alias("t"))
    return member.groupBy("host").agg(F.collect_list("t").alias("template"))


def orders(tokens: list[int], classes: dict[int, int], sizes: dict[int, int] | None = None) -> Iterator[tuple[int, int, bool]]:
    """Class, hash of the order of its tokens, and whether it is broken, for each of its stretches on a page: a stretch
    that doesn't have every token once, or that one of another class runs across, is. sizes: tokens of each class."""
    sizes = sizes or Counter(classes.values())
    open_: list[tuple[int, list[int]]] = []
    for token in tokens:
        own = classes.get(token)
        if own is None:
            continue
        at = next((i for i in range(len(open_) - 1, -1, -1) if open_[i][0] == own), None)
        if at is None:
            open_.append((own, [token]))
            at = len(open_) - 1
        else:
            for other, _ in open_[at + 1 :]:
                yield other, 0, True
            del open_[at + 1 :]
            open_[at][1].append(token)
        held = open_[at][1]
        if len(held) == sizes[own]:
            open_.pop()
            yield own, hash(tuple(held)), len(set(held)) < len(held)
    for other, _ in open_:
        yield other, 0, True


class Template:
    """Of a host's template: the class of each token, the tokens of each class, and the tokens whose text is mostly links."""

    def __init__(self, tokens: list[dict] | None):
        own = [(t["token"] & 0xFFFFFFFFFFFFFFFF, t["class"], t["linked"]) for t in tokens or ()]
        self.classes = {t: c for t, c, _ in own}
        self.sizes = Counter(self.classes.values())
        self.linked = {t for t, _, linked in own if linked}


def known_templates(part: pa.RecordBatch) -> Iterator[Template]:
    """The template of each row; one of a host is read once for all its rows."""
    column, found = part.column("template"), {}
    for i, host in enumerate(part.column("host").to_pylist()):
        if host not in found:
            found[host] = Template(column[i].as_py())
        yield found[host]


def templates(pages: DataFrame, classes: DataFrame) -> DataFrame:
    """The classes that are in one order and nest on all pages of their host."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                found: dict[tuple[int, int], list] = {}
                for host, source, template in zip(*(part.column(c).to_pylist() for c in ("host", "html")), known_templates(part)):
                    for own, order, broken in orders(Page(source).tokens, template.classes, template.sizes):
                        low, high, bad = found.get((host, own), (order, order, 0))
                        found[host, own] = min(low, order), max(high, order), bad + broken
                rows = [(*k, *v) for k, v in found.items()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [()] * 5)], ["host", "class", "low", "high", "broken"])

    checked = pages.join(classes, "host").select("host", "html", "template").mapInArrow(run, "host long, class long, low long, high long, broken long")
    valid = checked.groupBy("host", "class").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("broken").alias("broken")).where("low = high and broken = 0")
    member = classes.select("host", F.explode("template").alias("t")).join(valid.select("host", F.col("class").alias("c")), "host").where("t.class = c")
    return member.groupBy("host").agg(F.collect_list("t").alias("template"))


def main_texts(df: DataFrame) -> DataFrame:
    """page_id, url, the main text of the page, and its length in code points."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*:/*([^/?#]*)", 1))
    pages = df.select("page_id", "url", F.xxhash64(host).alias("host"), whole_text("html").alias("html"))
    found = materialise(templates(pages, materialise(equivalence_classes(pages))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                texts = []
                for source, template in zip(part.column("html").to_pylist(), known_templates(part)):
                    texts.append(main_text(Page(source), template.classes, template.linked))
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    joined = pages.join(found, "host", "left").select("page_id", "url", "host", "html", "template")
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    return joined.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
