"""Ledger forensics over document headers (BKPF) and lines (BSEG): balances, journal detectors, duty conflicts.

Dates are dates, amounts decimals, keys strings. Debit totals of documents are computed once and shared.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["BUKRS", "BELNR", "GJAHR"]


@dataclass(frozen=True)
class Thresholds:
    round_amount: int = 1000
    backdate_days: int = 15
    approval: int = 50000
    period_end_days: int = 3
    holidays: tuple[str, ...] = ()
    work_start: int = 7
    work_end: int = 19
    variance_percent: int = 25
    suspense_prefixes: tuple[str, ...] = ("1990", "2990", "9999")


DEFAULTS = Thresholds()
#: Transaction codes by function.
MANUAL = ["FB01", "F-02", "F-01", "FB50", "FBS1", "FB05", "FV50", "FV60", "FBV1"]
FUNCTIONS = {
    "posting": ["FB01", "F-02", "F-01", "FB50", "FBS1", "FB05", "FB60", "FB65", "FB70", "FB75", "MIRO", "MR01"],
    "approval": ["FBV2", "FBV4", "FMKFR01", "FB08"],
    "parking": ["FBV1", "FV50", "FV60", "FV65", "FV70", "MIR7"],
    "payment": ["F110", "F-53", "F-58", "FCH5", "FBZ1", "F-28", "F-32"],
    "vendor_master": ["XK01", "XK02", "FK01", "FK02", "MK01", "MK02"],
    "reversal": ["FB08", "F.80", "MR8M", "FBRA"],
}
SEVERITIES = ["critical", "high", "medium", "low"]


def severity_rank(column: Column | None = None) -> Column:
    column = F.col("severity") if column is None else column
    return reduce(lambda out, pair: out.when(column == pair[1], pair[0]), enumerate(SEVERITIES[1:], 1), F.when(column == SEVERITIES[0], 0)).otherwise(len(SEVERITIES))


def filter_fi(head: DataFrame, lines: DataFrame, company: str | None = None, year: str | None = None, first: str | None = None, last: str | None = None, low: str | None = None, high: str | None = None) -> DataFrame:
    """Lines by company, year, account range and, through their header, period range; lines without a header stay."""
    out = lines.join(head.select(*KEY, "MONAT"), KEY, "left")
    for column, bound, after in (("BUKRS", company, None), ("GJAHR", year, None), ("HKONT", low, True), ("HKONT", high, False)):
        if bound is not None:
            out = out.where(F.col(column) == bound if after is None else F.col(column) >= bound if after else F.col(column) <= bound)
    out = out.where(F.col("MONAT").isNull() | (F.col("MONAT") >= first)) if first else out
    return out.where(F.col("MONAT").isNull() | (F.col("MONAT") <= last)) if last else out


def document_debits(head: DataFrame, lines: DataFrame) -> DataFrame:
    """Headers with their debit total, credit total and number of lines."""
    side = lambda s: F.coalesce(F.sum(F.when(F.col("SHKZG") == s, F.col("WRBTR"))), F.lit(0).cast("decimal(28,2)"))
    sums = lines.groupBy(*KEY).agg(side("S").alias("debit"), side("H").alias("credit"), F.count("*").alias("n_lines"))
    zero = F.lit(0).cast("decimal(28,2)")
    return head.join(sums, KEY, "left").withColumns({"debit": F.coalesce("debit", zero), "credit": F.coalesce("credit", zero), "n_lines": F.coalesce("n_lines", F.lit(0))})


#: What a document came from, by its origin type.
ORIGINS = {"VBRK": "Billing document", "RMRP": "Invoice receipt", "MKPF": "Goods movement", "BKPF": "Accounting document", "BKPFF": "Accounting document"}


def origin_document(awtyp: Column, awkey: Column) -> Column:
    names = F.create_map(*(F.lit(x) for pair in ORIGINS.items() for x in pair))
    return F.when(awkey.isNotNull(), F.concat_ws(" ", F.coalesce(names[awtyp], awtyp), awkey))


def fi_documents(head: DataFrame, lines: DataFrame) -> DataFrame:
    """Every document with totals, whether it balances, and its origin."""
    out = document_debits(head, lines)
    return out.select(*KEY, "debit", "credit", "n_lines", (F.abs(F.col("debit") - F.col("credit")) < 0.01).alias("is_balanced"), origin_document(F.col("AWTYP"), F.col("AWKEY")).alias("origin"))


def account_texts(ska1: DataFrame, skat: DataFrame) -> DataFrame:
    """Text of each account in English, else of the master; balance sheet or profit and loss."""
    texts = skat.where(F.col("SPRAS").isin("E", "EN")).select("SAKNR", F.col("TXT50").alias("_text"))
    kind = F.when(F.col("XBILK") == "X", "BS").otherwise("PL")
    return ska1.join(texts, "SAKNR", "left").select(F.col("SAKNR").alias("HKONT"), F.coalesce("_text", "TXT50").alias("account_text"), kind.alias("account_type"))


def trial_balance(lines: DataFrame, ska1: DataFrame, skat: DataFrame) -> DataFrame:
    amount = F.abs("WRBTR")
    side = lambda debit: F.coalesce(F.sum(F.when((F.col("SHKZG") == "S") == debit, amount)), F.lit(0).cast("decimal(28,2)"))
    sums = lines.groupBy("HKONT").agg(side(True).alias("total_debit"), side(False).alias("total_credit"), F.count("*").alias("posting_count"))
    named = sums.join(account_texts(ska1, skat), "HKONT", "left")
    return named.select("HKONT", "account_text", F.coalesce("account_type", F.lit("PL")).alias("account_type"), "total_debit", "total_credit", (F.col("total_debit") - F.col("total_credit")).alias("balance"), "posting_count")


def suspense_accounts(balances: DataFrame, limits: Thresholds = DEFAULTS) -> DataFrame:
    hit = reduce(lambda a, b: a | b, (F.col("HKONT").startswith(p) for p in limits.suspense_prefixes))
    reason = F.when(F.abs("balance") > 10000, "significant balance").otherwise("residual balance")
    return balances.where(hit & (F.abs("balance") > 0.01)).select("HKONT", "balance", reason.alias("reason"))


def intercompany_mismatches(lines: DataFrame) -> DataFrame:
    signed = F.when(F.col("SHKZG") == "S", F.col("WRBTR")).otherwise(-F.col("WRBTR"))
    low, high = F.least("BUKRS", "VBUND"), F.greatest("BUKRS", "VBUND")
    zero = F.lit(0).cast("decimal(28,2)")
    pairs = lines.where("VBUND is not null and VBUND <> ''").groupBy(low.alias("company_1"), high.alias("company_2")).agg(
        F.coalesce(F.sum(F.when(F.col("BUKRS") == low, signed)), zero).alias("balance_1"), F.coalesce(F.sum(F.when(F.col("BUKRS") != low, signed)), zero).alias("balance_2")
    )
    return pairs.withColumn("difference", F.abs(F.col("balance_1") + F.col("balance_2"))).where("difference > 0.01")


def open_item_aging(lines: DataFrame, as_of: str) -> DataFrame:
    """Open receivables and payables by days past due at as_of, in one row."""
    days, amount = F.datediff(F.lit(as_of).cast("date"), F.col("ZFBDT")), F.abs("WRBTR")
    buckets = {"current": days <= 0, "days_30": (days > 0) & (days <= 30), "days_60": (days > 30) & (days <= 60), "days_90": (days > 60) & (days <= 90), "over_90": days > 90}
    open_items = lines.where("AUGDT is null and KOART in ('D', 'K') and ZFBDT is not null")
    return open_items.agg(*(F.coalesce(F.sum(F.when(test, amount)), F.lit(0).cast("decimal(28,2)")).alias(name) for name, test in buckets.items()))


def gl_variances(head: DataFrame, lines: DataFrame, limits: Thresholds = DEFAULTS, top: int = 50) -> DataFrame:
    """Accounts whose balance moved much against their previous period, the largest first."""
    signed = F.when(F.col("SHKZG") == "S", F.abs("WRBTR")).otherwise(-F.abs("WRBTR"))
    periods = filter_fi(head, lines).groupBy("HKONT", F.coalesce("MONAT", F.lit("001")).alias("period")).agg(F.sum(signed).alias("current_balance"))
    prior = periods.withColumn("prior_balance", F.lag("current_balance").over(Window.partitionBy("HKONT").orderBy("period")))
    moved = prior.where(F.abs("prior_balance") >= 100).withColumn("variance_amount", F.col("current_balance") - F.col("prior_balance"))
    percent = F.round(F.abs("variance_amount").cast("double") / F.abs("prior_balance").cast("double") * 100, 2)
    severity = F.when(percent >= 100, "high").when(percent >= 50, "medium").otherwise("low")
    return moved.withColumns({"variance_percent": percent, "severity": severity}).where(F.col("variance_percent") >= limits.variance_percent).orderBy(F.desc("variance_percent"), "HKONT", "period").limit(top)


ANOMALY = [*KEY, "anomaly_type", "severity", "user", "budat", "amount", "risk_score"]


def _hit(test: Column, kind: Column | str, severity: Column | str, amount: Column, risk: Column | int) -> Column:
    """What a detector says of a row: nothing where the test fails."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.when(test, F.struct(lit(kind).alias("anomaly_type"), lit(severity).alias("severity"), amount.cast("decimal(28,2)").alias("amount"), lit(risk).alias("risk_score")))


def _exploded(df: DataFrame, hits: Column) -> DataFrame:
    """A row for each thing said of a row; hits: an array."""
    rows = df.select(*KEY, F.col("USNAM").alias("user"), F.col("BUDAT").alias("budat"), F.explode(hits).alias("_a"))
    return rows.select(*KEY, "_a.anomaly_type", "_a.severity", "user", "budat", "_a.amount", "_a.risk_score")


def _found(df: DataFrame, *hits: Column) -> DataFrame:
    return _exploded(df, F.array_compact(F.array(*hits)))


def _weekend(limits: Thresholds) -> Column:
    holiday, large = F.col("BUDAT").cast("string").isin(list(limits.holidays) or [""]), F.col("debit") > 100000
    return _hit(F.dayofweek("BUDAT").isin(1, 7) | holiday, F.when(holiday, "holiday_posting").otherwise("weekend_posting"), F.when(large, "high").otherwise("medium"), F.col("debit"), F.when(holiday, 70).when(large, 65).otherwise(45))


def _backdated(limits: Thresholds) -> Column:
    gap = F.datediff("CPUDT", "BUDAT")
    return _hit(gap > limits.backdate_days, "backdated_entry", F.when(gap > 90, "critical").when(gap > 30, "high").otherwise("medium"), F.col("debit"), F.when(gap > 90, 90).when(gap > 30, 75).otherwise(55))


def _manual() -> Column:
    d = F.col("debit")
    return _hit(F.col("TCODE").isin(MANUAL) & (d > 10000), "manual_entry", F.when(d > 500000, "high").when(d > 100000, "medium").otherwise("low"), d, F.when(d > 500000, 60).when(d > 100000, 40).otherwise(20))


def _unusual_time(limits: Thresholds) -> Column:
    hour = F.substring("CPUTM", 1, 2).cast("int")
    return _hit(((hour < limits.work_start) | (hour >= limits.work_end)) & (F.col("debit") > 10000), "unusual_time", "low", F.col("debit"), 30)


def _round(limits: Thresholds) -> Column:
    amount = F.abs("WRBTR")
    severity = F.when(amount >= 1000000, "high").when(amount >= 100000, "medium").otherwise("low")
    return _hit((amount >= limits.round_amount) & (amount % limits.round_amount == 0), "round_amount", severity, amount, F.when(amount >= 1000000, 55).when(amount >= 100000, 40).otherwise(25))


def _rare_keys(lines: DataFrame) -> DataFrame:
    """Posting keys that make up less than a hundredth of the postings of their account type."""
    keyed = lines.where("BSCHL is not null and BSCHL <> ''").groupBy(F.coalesce("KOART", F.lit("S")).alias("_type"), "BSCHL").agg(F.count("*").alias("_n"))
    totals = keyed.groupBy("_type").agg(F.sum("_n").alias("_total"))
    return keyed.join(totals, "_type").where("_total > 100 and _n / _total < 0.01").select("_type", "BSCHL", F.lit(True).alias("_rare"))


def _with_rare(lines: DataFrame) -> DataFrame:
    # account types times posting keys are few, whatever the number of lines
    return lines.withColumn("_type", F.coalesce("KOART", F.lit("S"))).join(F.broadcast(_rare_keys(lines)), ["_type", "BSCHL"], "left")


def _unusual_key() -> Column:
    return _hit(F.col("_rare"), "unusual_posting_key", "medium", F.abs("WRBTR"), 50)


def _of_lines(head: DataFrame, lines: DataFrame, *hits: Column) -> DataFrame:
    """Only lines that something is said of meet their headers."""
    said = lines.select(*KEY, F.array_compact(F.array(*hits)).alias("_hits")).where(F.size("_hits") > 0)
    return _exploded(said.join(head.select(*KEY, "USNAM", "BUDAT"), KEY), F.col("_hits"))


def journal_weekend_holiday(debits: DataFrame, limits: Thresholds = DEFAULTS) -> DataFrame:
    return _found(debits, _weekend(limits))


def journal_round_amount(head: DataFrame, lines: DataFrame, limits: Thresholds = DEFAULTS) -> DataFrame:
    return _of_lines(head, lines, _round(limits))


def journal_backdated(debits: DataFrame, limits: Thresholds = DEFAULTS) -> DataFrame:
    return _found(debits, _backdated(limits))


def journal_period_end_spike(debits: DataFrame, limits: Thresholds = DEFAULTS) -> DataFrame:
    """Periods with over three times the daily entries in their last days; one row per period."""
    n = limits.period_end_days
    at_end = F.dayofmonth("BUDAT") > F.dayofmonth(F.last_day("BUDAT")) - n
    periods = debits.groupBy("GJAHR", "MONAT").agg(
        F.count_if(at_end).alias("n_end"), F.count_if(~at_end).alias("n_rest"), F.dayofmonth(F.last_day(F.min("BUDAT"))).alias("days"), F.min("BUKRS").alias("BUKRS"),
        F.min(F.when(at_end, F.col("BUDAT"))).alias("BUDAT"), F.coalesce(F.sum(F.when(at_end, F.col("debit"))), F.lit(0).cast("decimal(38,2)")).alias("total"),
    ).where("n_rest > 0")
    rest, end = F.col("n_rest") / F.greatest(F.col("days") - n, F.lit(1)), F.col("n_end") / n
    named = periods.withColumns({"BELNR": F.concat(F.lit("PERIOD-"), F.col("MONAT")), "USNAM": F.lit("MULTIPLE")})
    return _found(named, _hit((end > rest * 3) & (F.col("n_end") >= 5), "period_end_spike", F.when(end > rest * 5, "high").otherwise("medium"), F.col("total"), F.when(end > rest * 5, 65).otherwise(45)))


def journal_manual(debits: DataFrame) -> DataFrame:
    return _found(debits, _manual())


def journal_unusual_key(head: DataFrame, lines: DataFrame) -> DataFrame:
    return _of_lines(head, _with_rare(lines), _unusual_key())


def journal_split(debits: DataFrame, limits: Thresholds = DEFAULTS) -> DataFrame:
    """Users whose documents of one day are each below the approval limit and together near or over it."""
    below = debits.where((F.col("debit") > 0) & (F.col("debit") < limits.approval))
    days = below.groupBy("USNAM", "BUDAT").agg(F.count("*").alias("n"), F.sum("debit").alias("total"), F.min(F.struct(*KEY)).alias("_first")).select("USNAM", "BUDAT", "n", "total", "_first.*")
    return _found(days, _hit((F.col("n") >= 2) & (F.col("total") >= limits.approval * 0.8) & (F.col("total") <= limits.approval * 1.5), "split_below_threshold", "high", F.col("total"), 80))


def journal_unusual_time(debits: DataFrame, limits: Thresholds = DEFAULTS) -> DataFrame:
    return _found(debits, _unusual_time(limits))


def journal_anomalies(head: DataFrame, lines: DataFrame, limits: Thresholds = DEFAULTS) -> DataFrame:
    """All eight detectors: four look at each header at once, two at each line, two at groups of headers."""
    debits = document_debits(head, lines)
    parts = [
        _found(debits, _weekend(limits), _backdated(limits), _manual(), _unusual_time(limits)), _of_lines(head, _with_rare(lines), _round(limits), _unusual_key()),
        journal_period_end_spike(debits, limits), journal_split(debits, limits),
    ]
    return reduce(DataFrame.unionByName, parts)


def top_anomalies(anomalies: DataFrame, top: int = 200) -> DataFrame:
    return anomalies.orderBy(F.desc("risk_score"), severity_rank(), *KEY, "anomaly_type", "amount").limit(top)


def anomaly_summary(anomalies: DataFrame) -> DataFrame:
    """Counts by severity, by type and by user in one pass."""
    grouped = anomalies.groupingSets([["severity"], ["anomaly_type"], ["user"]], "severity", "anomaly_type", "user").agg(F.count("*").alias("n"), F.grouping_id().alias("_g"))
    dimension = F.when(F.col("_g") == 3, "severity").when(F.col("_g") == 5, "type").otherwise("user")
    return grouped.select(dimension.alias("dimension"), F.coalesce("severity", "anomaly_type", "user").alias("value"), "n")


def top_users(anomalies: DataFrame, top: int = 10) -> DataFrame:
    return anomalies.groupBy("user").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user").limit(top)


def _functions(head: DataFrame) -> DataFrame:
    """(document, user, function): by transaction code; own parked documents are parked and approved."""
    known = F.array_compact(F.array(*(F.when(F.col("TCODE").isin(codes), F.lit(name)) for name, codes in FUNCTIONS.items())))
    own = F.when(F.col("PPNAM") == F.col("USNAM"), F.array(F.lit("parking"), F.lit("approval"))).otherwise(F.array().cast("array<string>"))
    return head.where("USNAM is not null and USNAM <> ''").select(*KEY, F.col("USNAM").alias("user"), "TCODE", F.explode(F.array_union(known, own)).alias("function"))


def sod_user_activity(head: DataFrame) -> DataFrame:
    counted = _functions(head).groupBy("user").pivot("function", list(FUNCTIONS)).agg(F.count(F.lit(1)))
    return counted.na.fill(0)


def reversal_pairs(head: DataFrame) -> DataFrame:
    """Documents that their own user reversed: keys of both."""
    reversal = head.where("STBLG is not null and STJAH is not null").select(F.col("BUKRS"), F.col("STBLG").alias("BELNR"), F.col("STJAH").alias("GJAHR"), F.col("BELNR").alias("reversal_belnr"), F.col("USNAM").alias("_by"))
    return head.join(reversal, KEY).where("USNAM = _by").select(*KEY, F.col("USNAM").alias("user"), "reversal_belnr")


def parked_and_approved(head: DataFrame) -> DataFrame:
    """Documents that one user both parked and approved."""
    found = _functions(head)
    keys = [*KEY, "user"]
    return found.where("function = 'parking'").select(*keys).distinct().join(found.where("function = 'approval'").select(*keys), keys, "left_semi")


def sod_conflicts(head: DataFrame) -> DataFrame:
    """Five duty rules; of two rules that give one type for a user, the first counts."""
    users, found = sod_user_activity(head), _functions(head)
    row = lambda df, order, kind, severity, n: df.select("user", F.lit(kind).alias("conflict_type"), severity.alias("severity"), n.cast("long").alias("occurrences"), F.lit(order).alias("_order"))
    critical, high = F.lit("critical"), F.lit("high")
    both = lambda a, b: users.where((F.col(a) > 0) & (F.col(b) > 0))
    own = head.where("PPNAM = USNAM").groupBy(F.col("USNAM").alias("user")).agg(F.count("*").alias("n"))
    changes, runs = F.count_if((F.col("function") == "vendor_master") & F.col("TCODE").isin("XK02", "FK02")), F.count_if((F.col("function") == "payment") & (F.col("TCODE") == "F110"))
    vendor = found.groupBy("user").agg(changes.alias("a"), runs.alias("b")).where("a > 0 and b > 0")
    reversed_own = reversal_pairs(head).groupBy("user").agg(F.count("*").alias("n"))
    parts = [
        row(both("posting", "approval"), 1, "post_and_approve", critical, F.least("posting", "approval")),
        row(own, 2, "park_and_post", high, F.col("n")),
        row(both("vendor_master", "payment"), 3, "create_and_pay", critical, F.least("vendor_master", "payment")),
        row(parked_and_approved(head).groupBy("user").agg(F.count("*").alias("n")), 4, "park_and_post", high, F.col("n")),
        row(vendor, 5, "vendor_master_and_payment", critical, F.least("a", "b")),
        row(reversed_own, 6, "post_and_reverse", F.when(F.col("n") > 3, "high").otherwise("medium"), F.col("n")),
    ]
    first = Window.partitionBy("user", "conflict_type").orderBy("_order")
    return reduce(DataFrame.unionByName, parts).withColumn("_first", F.row_number().over(first)).where("_first = 1").drop("_first", "_order")


def top_conflicts(conflicts: DataFrame, top: int = 100) -> DataFrame:
    return conflicts.orderBy(severity_rank(), F.desc("occurrences"), "user", "conflict_type").limit(top)


def sod_summary(conflicts: DataFrame) -> DataFrame:
    return conflicts.groupBy("conflict_type", "severity").agg(F.count("*").alias("n_users"), F.sum("occurrences").alias("occurrences"))


def sod_top_users(conflicts: DataFrame, top: int = 10) -> DataFrame:
    return conflicts.groupBy("user").agg(F.countDistinct("conflict_type").alias("n_types"), F.sum("occurrences").alias("occurrences")).orderBy(F.desc("n_types"), F.desc("occurrences"), "user").limit(top)


def most_frequent_year(head: DataFrame) -> DataFrame:
    return head.groupBy("GJAHR").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "GJAHR").limit(1)


def fi_assessment(head: DataFrame, lines: DataFrame, limits: Thresholds = DEFAULTS) -> DataFrame:
    """One row: findings by severity over journal and duty checks, and the overall risk."""
    found = journal_anomalies(head, lines, limits).select("severity").unionByName(sod_conflicts(head).select("severity"))
    counts = found.agg(*(F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in SEVERITIES))
    risk = F.when(F.col("n_critical") > 0, "critical").when(F.col("n_high") > 3, "high").when((F.col("n_high") > 0) | (F.col("n_medium") > 5), "medium").otherwise("low")
    return counts.withColumn("overall_risk", risk)


#: What is told of findings (name, text), and what to do: name, priority, category, text.
CONCERNS = [
    ("conflicts", "segregation of duties conflict(s) detected"), ("weekend", "journal entries posted on weekends/holidays"), ("backdated", "backdated journal entries identified"), ("round", "round-amount entries flagged for review"),
    ("suspense", "suspense account(s) with unexpected balances"), ("intercompany", "intercompany balance mismatch(es)"),
]
ADVICE = [
    ("post_and_approve", "critical", "Segregation of Duties", "Implement dual-control for journal entry posting. No user should be able to both create and approve journal entries without a secondary review."),
    ("park_and_post", "high", "Segregation of Duties", "Enforce separation between document parking and posting. Configure SAP workflow to require different users for FBV1 (park) and FBV2 (post)."),
    ("vendor_payment", "critical", "Segregation of Duties", "Separate vendor master data maintenance from payment processing. Users with access to XK01/XK02 should not run F110 payment programs."),
    ("off_days", None, "Posting Controls", "Review weekend and holiday postings for authorization. Consider implementing posting period restrictions (OB52) to prevent out-of-hours entries unless explicitly approved."),
    ("backdated", None, "Posting Controls", "Investigate backdated journal entries where posting date significantly precedes creation date. Tighten posting period controls and require manager approval for backdated entries."),
    ("round", "medium", "Journal Entry Review", "Review round-amount journal entries for legitimacy. While some round amounts are normal (provisions, accruals), a high concentration may indicate estimation or fabrication."),
    ("split", "high", "Authorization Controls", "Investigate potential split transactions designed to circumvent approval thresholds. Consider implementing cumulative daily limits per user in addition to per-document thresholds."),
    ("suspense", "high", "GL Accounts", "Clear suspense accounts with unexpected balances. Implement monthly reconciliation procedures and set automated alerts for suspense account activity."),
    ("intercompany", "high", "Intercompany", "Resolve intercompany balance discrepancies before migration. Implement automated intercompany reconciliation processes in the target system."),
]


def assessment_counts(head: DataFrame, lines: DataFrame, ska1: DataFrame, skat: DataFrame, limits: Thresholds = DEFAULTS) -> DataFrame:
    """One row of all counts that the assessment is made of: findings by severity and kind, documents and lines."""
    kind, severity = F.col("anomaly_type"), F.col("severity")
    journal = journal_anomalies(head, lines, limits).agg(
        *(F.count_if(severity == s).alias(f"j_{s}") for s in SEVERITIES), F.count_if(kind == "weekend_posting").alias("weekend"), F.count_if(kind.isin("weekend_posting", "holiday_posting")).alias("off_days"), F.count_if(kind == "backdated_entry").alias("backdated"),
        F.count_if((kind == "backdated_entry") & (severity == "critical")).alias("backdated_critical"), F.count_if(kind == "round_amount").alias("round"), F.count_if(kind == "split_below_threshold").alias("split"),
    )
    rule = F.col("conflict_type")
    duty = sod_conflicts(head).agg(
        *(F.count_if(severity == s).alias(f"d_{s}") for s in SEVERITIES), F.count("*").alias("conflicts"), F.count_if(rule == "post_and_approve").alias("post_and_approve"), F.count_if(rule == "park_and_post").alias("park_and_post"),
        F.count_if(rule.isin("vendor_master_and_payment", "create_and_pay")).alias("vendor_payment"),
    )
    accounts = suspense_accounts(trial_balance(lines, ska1, skat), limits).agg(F.count("*").alias("suspense"))
    pairs = intercompany_mismatches(lines).agg(F.count("*").alias("intercompany"))
    size = head.agg(F.count("*").alias("n_documents"), F.min(F.col("MONAT").cast("int")).alias("first_period"), F.max(F.col("MONAT").cast("int")).alias("last_period"))
    rows = [duty, accounts, pairs, size, lines.agg(F.count("*").alias("n_lines"))]
    wide = reduce(lambda a, b: a.crossJoin(F.broadcast(b)), rows, journal)  # one row each
    wide = wide.select("*", *((F.col(f"j_{s}") + F.col(f"d_{s}")).alias(f"n_{s}") for s in SEVERITIES)).drop(*(f"{x}_{s}" for x in "jd" for s in SEVERITIES))
    risk = F.when(F.col("n_critical") > 0, "critical").when(F.col("n_high") > 3, "high").when((F.col("n_high") > 0) | (F.col("n_medium") > 5), "medium").otherwise("low")
    return wide.withColumn("overall_risk", risk)


def assessment_concerns(counts: DataFrame) -> DataFrame:
    """position, concern of what was found at all."""
    rows = F.array(*(F.when(F.col(name) > 0, F.struct(F.lit(i).alias("position"), F.concat(F.col(name).cast("string"), F.lit(f" {text}")).alias("concern"))) for i, (name, text) in enumerate(CONCERNS)))
    return counts.select(F.explode(F.array_compact(rows)).alias("r")).select("r.*")


def assessment_recommendations(counts: DataFrame) -> DataFrame:
    """priority, category, recommendation, affected_items; many postings on days off and old backdated entries weigh more."""
    grave = {"off_days": F.when(F.col("off_days") > 10, "high").otherwise("medium"), "backdated": F.when(F.col("backdated_critical") > 0, "critical").otherwise("high")}
    rows = F.array(*(
        F.when(F.col(name) > 0, F.struct((F.lit(level) if level else grave[name]).alias("priority"), F.lit(category).alias("category"), F.lit(text).alias("recommendation"), F.col(name).alias("affected_items")))
        for name, level, category, text in ADVICE
    ))
    return counts.select(F.explode(F.array_compact(rows)).alias("r")).select("r.*")


def assessment_markdown(counts: DataFrame, title: str = "Ledger assessment") -> DataFrame:
    """position, line of a report: summary, concerns and recommendations, the most urgent first."""
    text = lambda c: F.col(c).cast("string")
    table = [("Overall risk", "overall_risk"), ("Documents", "n_documents"), ("Lines", "n_lines"), *((s.capitalize(), f"n_{s}") for s in SEVERITIES)]
    head = F.array(F.lit(f"# {title}"), F.lit(""), F.lit("| Metric | Value |"), F.lit("|---|---|"), *(F.concat(F.lit(f"| {name} | "), text(c), F.lit(" |")) for name, c in table), F.lit(""), F.lit("## Concerns"))
    top = counts.select(F.posexplode(head).alias("position", "line"))
    said = assessment_concerns(counts).select((F.col("position") + 100).alias("position"), F.concat(F.lit("- "), "concern").alias("line"))
    wanted = assessment_recommendations(counts)
    ranked = wanted.select((F.row_number().over(Window.orderBy(severity_rank(F.col("priority")), "category", "recommendation")) + 200).alias("position"), F.format_string("- %s, %s: %s (%d)", "priority", "category", "recommendation", "affected_items").alias("line"))  # at most nine rows
    middle = counts.select(F.lit(200).alias("position"), F.lit("## Recommendations").alias("line"))
    return reduce(DataFrame.unionByName, [top, said, middle, ranked])
