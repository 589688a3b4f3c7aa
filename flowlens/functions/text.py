"""Text functions: redaction, normalisation, tokens and phrases, all in Spark's own expressions.

Letters, digits and word ends are those of Unicode throughout.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What is redacted, in order: kind, pattern, whether case counts, what comes instead.
REDACTIONS = [
    ("EMAIL", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", False, "[EMAIL]"),
    ("PHONE", r"\+\d{1,3}[-.\s]?\(?\d{1,4}\)?[-.\s]?\d{1,4}[-.\s]?\d{1,9}", True, "[PHONE]"),
    ("PHONE", r"\(\d{3}\)[-.\s]?\d{3}[-.\s]?\d{4}", True, "[PHONE]"),
    ("PHONE", r"\b\d{3}[-.\s]\d{3}[-.\s]\d{4}\b", True, "[PHONE]"),
    ("PHONE", r"\b0\d{2,4}\s\d{3,8}\b", True, "[PHONE]"),
    ("PHONE", r"\+49\s*\(0\)\s*\d{2,4}[-.\s]?\d{3,8}", True, "[PHONE]"),
    ("NAME", r"\b(?:Mr\.?|Mrs\.?|Ms\.?|Dr\.?|Prof\.?)\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b", True, "[NAME]"),
    ("NAME", r"\b(Contact|Attn|Attention|Name|Signed|Approved by|Requested by|Created by):\s*[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b", False, "$1: [NAME]"),
    ("NAME", r"\b(ERNAM|ERDAT|AENAM|AEDAT):\s*[A-Z][A-Z0-9]+\b", True, "$1: [NAME]"),
    ("ADDRESS", r"\b\d{1,5}\s+[A-Za-z0-9\s]+(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Drive|Dr|Lane|Ln|Court|Ct|Way|Place|Pl)\.?\s*,?\s*[A-Za-z\s]+,?\s*[A-Z]{2}\s*\d{5}(?:-\d{4})?\b", False, "[ADDRESS]"),
    ("ADDRESS", r"\b[A-Za-zÀ-ſ]+(?:strasse|straße|str\.?|weg|platz|gasse)\s*\d{1,5}[a-z]?\s*,?\s*\d{5}\s+[A-Za-zÀ-ſ]+\b", False, "[ADDRESS]"),
    ("ADDRESS", r"\b(?:P\.?O\.?\s*Box|Postfach)\s*\d+\b", False, "[ADDRESS]"),
    ("ADDRESS", r"\b\d{5}(?:-\d{4})?\b", True, "[ADDRESS]"),
    ("ADDRESS", r"\b[A-Z]{1,2}\d{1,2}[A-Z]?\s*\d[A-Z]{2}\b", True, "[ADDRESS]"),
]
#: Purchase order numbers and document numbers, which become salted hashes.
PO_NUMBERS = [
    (r"\bPO[-_]?[A-Za-z0-9]{2,6}[-_]?\d{4,8}\b", False), (r"\bPO\s*#?\s*\d{4,10}\b", False), (r"\b(?:Purchase\s*Order|PO\s*Number|PO\s*No\.?)[\s:]*[A-Za-z0-9-]{5,15}\b", False), (r"\bPO[A-Z]?\d{6,10}\b", True),
]
DOCUMENT, DOCUMENT_PREFIX = r"\b(?:\d{10}|(?:SO|DO|DL|IV|PO|PR|SA)\d{8,10})\b", "^(SO|DO|DL|IV|PO|PR|SA)"
KINDS = ["EMAIL", "PHONE", "NAME", "ADDRESS", "PO_NUMBER", "DOC"]


def _flagged(pattern: str, cased: bool) -> str:
    return ("(?U)" if cased else "(?Uiu)") + pattern


def hash_document_number(number: Column, salt: str, prefix: str = "DOC") -> Column:
    digest = F.upper(F.substring(F.sha2(F.concat(F.lit(f"{salt}:"), number), 256), 1, 8))
    return F.concat(F.lit(f"[{prefix}_"), digest, F.lit("]"))


def _bound(text: Column, use) -> Column:
    """use(text), with the text worked out once however often it is used."""
    return F.transform(F.array(text), use)[0]


def _between(text: Column, pattern: str, clean, made) -> Column:
    """The text cut at the matches of a pattern; the parts are cleaned, and what is made of each match comes between."""

    def cut(whole: Column) -> Column:
        matches = F.transform(F.regexp_extract_all(whole, F.lit(f"({pattern})"), 1), made)
        parts = F.transform(F.split(whole, pattern, -1), clean)
        return F.array_join(F.zip_with(parts, matches, lambda part, match: F.concat(part, F.coalesce(match, F.lit("")))), "")

    return _bound(text, cut)


def redact_text(text: Column, salt: str = "", hash_documents: bool = True, hash_orders: bool = True) -> Column:
    """Each kind by its mark; purchase orders and document numbers by salted hashes, prefixes of documents stay. Document
    numbers are taken out first, so no other pattern sees them."""

    def order(n: Column) -> Column:
        return hash_document_number(n, salt, "PO_NUMBER") if hash_orders else F.lit("[PO_NUMBER]")

    def document(n: Column) -> Column:
        head = F.regexp_extract(n, DOCUMENT_PREFIX, 1)
        return F.concat(head, hash_document_number(F.regexp_replace(n, DOCUMENT_PREFIX, ""), salt))

    def clean(part: Column) -> Column:
        marked = reduce(lambda t, step: F.regexp_replace(t, _flagged(step[1], step[2]), step[3]), REDACTIONS, part)
        return reduce(lambda t, step: _between(t, _flagged(*step), lambda x: x, order), PO_NUMBERS, marked)

    return _between(text, _flagged(DOCUMENT, True), clean, document) if hash_documents else clean(text)


def redact_struct(df: DataFrame, salt: str = "", mode: str = "shareable", keep: tuple[str, ...] = ()) -> DataFrame:
    """df with every text redacted, in structs and arrays at any depth too; mode raw_local leaves all as it is, and so do
    the columns to keep."""

    def walk(value: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StringType):
            return redact_text(value, salt)
        if isinstance(kind, T.ArrayType):
            return F.transform(value, lambda x: walk(x, kind.elementType))
        if isinstance(kind, T.StructType):
            made = F.struct(*(walk(value[f.name], f.dataType).alias(f.name) for f in kind.fields))
            return F.when(value.isNotNull(), made)
        if isinstance(kind, T.MapType) and isinstance(kind.valueType, T.StringType):
            return F.transform_values(value, lambda _, v: redact_text(v, salt))
        return value

    if mode == "raw_local":
        return df
    return df.select(*(F.col(f"`{f.name}`") if f.name in keep else walk(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields))


def redact_email(text: Column) -> Column:
    return F.regexp_replace(text, _flagged(*REDACTIONS[0][1:3]), "[EMAIL]")


def redact_phone(text: Column) -> Column:
    return reduce(lambda t, p: F.regexp_replace(t, _flagged(p[1], p[2]), "[PHONE]"), (p for p in REDACTIONS if p[0] == "PHONE"), text)


def redaction_counts(text: Column, redacted: Column) -> list[Column]:
    """How many of each kind went from text to redacted: no later pattern takes a mark away, so marks tell. Both are used
    often, so the redacted text should be a column of its own."""
    marks = {kind: rf"\[{kind}_[0-9A-F]{{8}}\]" if kind in ("PO_NUMBER", "DOC") else rf"\[{kind}\]" for kind in KINDS}
    counts = {kind: F.regexp_count(redacted, F.lit(mark)) - F.regexp_count(text, F.lit(mark)) for kind, mark in marks.items()}
    return [*(c.alias(f"n_{kind.lower()}") for kind, c in counts.items()), reduce(lambda a, b: a + b, counts.values()).alias("n_total")]


#: Messages of the systems that say nothing.
BOILERPLATE = [
    r"Message\s+no\.\s+\w+\d+", r"System\s+status:\s*\w+", r"Document\s+\d+\s+saved", r"Changes\s+saved\s+successfully", r"Processing\s+complete", r"No\s+data\s+found", r"Selection\s+criteria\s+not\s+met",
    r"Created\s+by\s+batch", r"System\s+generated", r"Auto[-\s]?generated", r"Automatically\s+created", r"Generated\s+by\s+system", r"Batch\s+job\s+\w+", r"Background\s+job",
    r"Transaction:\s*\w+", r"Tcode:\s*\w+", r"T-code:\s*\w+", r"Report:\s*\w+", r"Program:\s*\w+", r"User:\s*\w+", r"Client:\s*\d+", r"System:\s*\w+",
    r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}[Z.]?\d*", r"\d{2}:\d{2}:\d{2}\.\d+", r"SYST-\w+", r"SY-\w+", r"ICON_\w+",
    r"<\s*empty\s*>", r"\[empty\]", r"\(none\)", r"n/a", r"not applicable", r"no text", r"no notes", r"no comments",
]
#: Abbreviations and what they stand for.
ABBREVIATIONS = {
    "expdt": "expedite", "cust": "customer", "req": "request", "exp": "expedite", "expd": "expedited", "expr": "express", "std": "standard", "del": "delivery", "dlvr": "delivery", "dlvy": "delivery",
    "shpmt": "shipment", "shpmnt": "shipment", "shpg": "shipping", "frt": "freight", "frght": "freight", "trns": "transport", "trnsp": "transport", "pkg": "package", "pckg": "package", "plt": "pallet",
    "crhld": "credit hold", "crdt": "credit", "cred": "credit", "pmt": "payment", "pymt": "payment", "inv": "invoice", "invce": "invoice", "blng": "billing", "blk": "block", "blkd": "blocked",
    "ord": "order", "ordr": "order", "po": "purchase order", "so": "sales order", "do": "delivery order", "reqd": "required", "rqst": "request", "conf": "confirmation", "cnfrm": "confirm", "cnfmd": "confirmed",
    "apprvd": "approved", "apprv": "approve", "rjct": "reject", "rjctd": "rejected", "cncl": "cancel", "cncld": "cancelled", "mat": "material", "matl": "material", "mtrls": "materials", "invtry": "inventory",
    "stk": "stock", "qty": "quantity", "qnty": "quantity", "um": "unit of measure", "uom": "unit of measure", "ea": "each", "pc": "piece", "pcs": "pieces", "cs": "case", "pndg": "pending", "pend": "pending",
    "proc": "processing", "prcsd": "processed", "cmplt": "complete", "cmpl": "complete", "incmpl": "incomplete", "prtl": "partial", "part": "partial", "avail": "available", "unavl": "unavailable", "custmr": "customer",
    "vndr": "vendor", "vend": "vendor", "supp": "supplier", "suppl": "supplier", "ptnr": "partner", "prtnr": "partner", "dt": "date", "tm": "time", "schd": "scheduled", "sched": "scheduled",
    "eta": "estimated time of arrival", "etd": "estimated time of departure", "vbeln": "document number", "posnr": "item number", "matnr": "material number", "kunnr": "customer number", "lifnr": "vendor number",
    "werks": "plant", "lgort": "storage location",
}
#: Those of two words, which go first.
LONG_ABBREVIATIONS = {"cr hold": "credit hold", "dlvry dt": "delivery date", "cr hld": "credit hold", "req dt": "requested date"}


#: Every pattern above holds one of these, in any case.
BOILERPLATE_SIGNS = ["message", "saved", "complete", "found", "criteria", "batch", "generated", "automatically", "background", ":", "syst-", "sy-", "icon_", "empty", "(none)", "n/a", "applicable", "no text", "no notes", "no comments"]
#: Words that say little.
STOP_WORDS = [
    "a", "an", "the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "as", "is", "was", "are", "were", "been", "be", "have", "has", "had", "do", "does", "did", "will", "would",
    "could", "should", "may", "might", "must", "shall", "can", "this", "that", "these", "those", "it", "its", "they", "them", "their",
]


def normalize_text(text: Column, extra: dict[str, str] | None = None, least: int = 1, stop_words: list[str] | None = None) -> Column:
    """Without boilerplate, abbreviations written out, in lower case, with single spaces; on wish without stop words."""
    low = F.lower(text)
    signs = reduce(lambda a, b: a | b, (low.contains(sign) for sign in BOILERPLATE_SIGNS))
    bare = F.when(signs, F.regexp_replace(text, "(?Uiu)" + "|".join(BOILERPLATE), " ")).otherwise(text)
    bare = reduce(lambda t, pair: F.regexp_replace(t, rf"(?Uiu)\b{pair[0]}\b", pair[1]), LONG_ABBREVIATIONS.items(), bare)
    known = ABBREVIATIONS | (extra or {})
    names = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))
    runs = F.regexp_extract_all(bare, F.lit(r"(?U)(\w+|\W+)"), 1)
    # a map is searched key by key, a set by hash: few words reach the map
    wide = F.lower(F.array_join(F.transform(F.transform(runs, F.lower), lambda w: F.when(w.isin(list(known)), names[w]).otherwise(w)), ""))
    single = F.regexp_replace(wide, r"(?U)\s+", " ")
    for sign in (r"\.", "-", "_"):
        single = F.regexp_replace(single, f"{sign}{{2,}}", sign[-1])
    single = F.trim(F.regexp_replace(single, r"(?U)\s[^\w\s]\s", " "))
    if least <= 1 and not stop_words:
        return single
    return F.array_join(F.filter(F.split(single, " "), lambda t: (F.length(t) >= least) & ~t.isin(stop_words or [""])), " ")


def tokenize(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)(\w+)"), 1)


def ngrams(tokens: Column, n: int) -> Column:
    at = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.array_join(F.slice(tokens, i, n), " "))


def phrases(tokens: Column, low: int = 2, high: int = 4) -> Column:
    return _bound(tokens, lambda own: F.flatten(F.array(*(ngrams(own, n) for n in range(low, high + 1)))))


#: Words of a question that are no keywords.
QUESTION_WORDS = [
    "what", "why", "how", "when", "where", "which", "who", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "the", "a", "an", "and", "or", "but",
    "in", "on", "at", "to", "for", "of", "with", "by", "from", "as", "about", "into", "through", "our", "my", "their", "this", "that", "these", "those", "most", "more", "many", "much", "some", "any", "all",
]


def extract_keywords(question: Column, most: int = 3) -> Column:
    """The first words of over three characters that are no question words, each once."""
    words = F.split(F.regexp_replace(F.lower(question), "[?.,!]", ""), r"(?U)\s+")
    return F.slice(F.array_distinct(F.filter(words, lambda w: (F.length(w) > 3) & ~w.isin(QUESTION_WORDS))), 1, most)
