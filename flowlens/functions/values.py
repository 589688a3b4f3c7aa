"""Scalar functions: dates, times, amounts, keys, durations and masking."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Date and time formats, in the order in which they are tried.
FORMATS = ["yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyyMMdd", "dd.MM.yyyy", "MM/dd/yyyy", "dd/MM/yyyy"]


def parse_date(text: Column) -> Column:
    """A timestamp in UTC of the first format that fits; Z and offsets are applied."""
    t = F.trim(text)
    offset = r":\d{2}(?:\.\d+)?\s*([+-])(\d{2}):?(\d{2})$"
    bare = F.regexp_replace(F.regexp_replace(t, r"(?<=\d)\s*Z$", ""), r"(:\d{2}(?:\.\d+)?)\s*[+-]\d{2}:?\d{2}$", "$1")
    minutes = F.regexp_extract(t, offset, 2).try_cast("int") * 60 + F.regexp_extract(t, offset, 3).try_cast("int")
    ahead = F.coalesce(F.when(F.regexp_extract(t, offset, 1) == "-", -minutes).otherwise(minutes), F.lit(0))
    return F.timestamp_add("MINUTE", -ahead, F.coalesce(*(F.try_to_timestamp(bare, F.lit(f)) for f in FORMATS)))


def parse_sap_date(text: Column) -> Column:
    """YYYYMMDD of a date in several notations; zeros are no date."""
    t = F.trim(text)
    found = (
        F.when(t.rlike(r"^\d{8}$"), t).when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), F.regexp_replace(F.substring(t, 1, 10), "-", ""))
        .when(t.rlike(r"^\d{2}\.\d{2}\.\d{4}$"), F.concat(F.substring(t, 7, 4), F.substring(t, 4, 2), F.substring(t, 1, 2)))
        .when(t.rlike(r"^\d{2}/\d{2}/\d{4}$"), F.concat(F.substring(t, 7, 4), F.substring(t, 1, 2), F.substring(t, 4, 2)))
    )
    return F.when(found != "00000000", found)


def parse_sap_time(text: Column) -> Column:
    digits = F.regexp_replace(text, r"\D", "")
    return F.when(F.length(digits) >= 4, F.rpad(F.substring(digits, 1, 6), 6, "0"))


def parse_sap_amount(text: Column) -> Column:
    """A decimal: European or US separators, trailing minus, parentheses, currency signs. The last separator with
    one or two digits after it is the decimal one."""
    t = F.trim(text)
    negative = t.rlike(r"-\s*$|^\s*-|^\(.*\)$")
    bare = F.regexp_replace(t, r"[^0-9.,]", "")
    comma_last = F.instr(F.reverse(bare), ",") < F.when(F.instr(bare, ".") > 0, F.instr(F.reverse(bare), ".")).otherwise(1 << 20)
    european = (F.instr(bare, ",") > 0) & comma_last & bare.rlike(r",\d{1,2}$")
    plain = F.when(european, F.regexp_replace(F.regexp_replace(bare, r"\.", ""), ",", ".")).when(bare.rlike(r"^\d{1,3}(\.\d{3})+$") & ~bare.contains(","), F.regexp_replace(bare, r"\.", "")).otherwise(F.regexp_replace(bare, ",", ""))
    value = plain.try_cast("decimal(18,2)")
    return F.when(negative, -value).otherwise(value)


def pad_document(text: Column, width: int = 10) -> Column:
    return F.lpad(F.regexp_replace(text.cast("string"), r"\D", ""), width, "0")


def pad_item(text: Column) -> Column:
    return pad_document(text, 6)


def strip_zeros(text: Column) -> Column:
    return F.regexp_replace(text, r"^0+(?=.)", "")


def combine_datetime(date: Column, time: Column) -> Column:
    """A timestamp of YYYYMMDD and HHMMSS; no time is midnight."""
    return F.try_to_timestamp(F.concat(date, F.coalesce(parse_sap_time(time), F.lit("000000"))), F.lit("yyyyMMddHHmmss"))


def format_duration(hours: Column) -> Column:
    days = hours / 24
    return (
        F.when(hours < 1, F.concat(F.round(hours * 60, 0).cast("int").cast("string"), F.lit("m"))).when(hours < 24, F.concat(F.round(hours, 1).cast("string"), F.lit("h")))
        .when(days < 7, F.concat(F.round(days, 1).cast("string"), F.lit("d"))).otherwise(F.concat(F.round(days / 7, 1).cast("string"), F.lit("w")))
    )


def is_weekend(date: Column) -> Column:
    return F.dayofweek(date).isin(1, 7)


def in_last_days(date: Column, n: int) -> Column:
    return F.dayofmonth(date) > F.dayofmonth(F.last_day(date)) - n


def normalize_activity(name: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(F.trim(name), "([a-z])([A-Z])", "$1_$2"), r"[\s-]+", "_"))


def format_activity_name(name: Column) -> Column:
    return F.initcap(F.regexp_replace(F.regexp_replace(name, "_", " "), "([a-z])([A-Z])", "$1 $2"))


#: Words that speak for a process.
PROCESS_WORDS = {"P2P": ["purchase", "requisition", "goods_receipt", "service_entry", "vendor", "srm"], "O2C": ["sales", "order_created", "delivery", "billing", "customer", "shipping"]}


def detect_process_type(activities: Column) -> Column:
    """By which words stand in an array of activity names."""
    joined = F.array_join(F.transform(activities, normalize_activity), " ")
    score = {kind: sum((joined.contains(w).cast("int") for w in words), F.lit(0)) for kind, words in PROCESS_WORDS.items()}
    return F.when(score["P2P"] > score["O2C"], "P2P").when(score["O2C"] > score["P2P"], "O2C").otherwise("unknown")


def clean_metric(text: Column) -> Column:
    """A double, with text for nothing, NaN and infinite values as null."""
    value = text.cast("string").try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


#: Parts of names of parameters that must not be logged.
SENSITIVE = ["password", "passwd", "secret", "token", "api_key", "credential"]


def mask_params(params: Column, most: int = 500) -> Column:
    """A map of parameters with sensitive values masked and long ones cut."""
    hidden = lambda k: sum((F.lower(k).contains(s).cast("int") for s in SENSITIVE), F.lit(0)) > 0
    return F.transform_values(params, lambda k, v: F.when(hidden(k), "***").when(F.length(v) > most, F.concat(F.substring(v, 1, most), F.lit("..."))).otherwise(v))


def invoice_status(activity: Column) -> Column:
    a = F.lower(activity)
    return F.when(a.contains("clear"), "cleared").when(a.contains("cancel"), "cancelled").when(a.contains("block"), "blocked").otherwise("open")
