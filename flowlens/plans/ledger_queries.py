"""Queries over the ledger."""

from __future__ import annotations

from ..operators import ledger as G
from ..sources.fixtures import AS_OF

_KEY = "BUKRS, BELNR, GJAHR"


def _codes(names: list[str]) -> str:
    return ", ".join(f"'{n}'" for n in names)


def _anomaly(kind: str, severity: str, amount: str, risk: str, source: str, where: str) -> str:
    return f"SELECT {_KEY}, {kind} AS anomaly_type, {severity} AS severity, USNAM AS user, BUDAT AS budat, CAST({amount} AS DECIMAL(28,2)) AS amount, CAST({risk} AS INT) AS risk_score FROM {source} WHERE {where}"


_CASES = lambda pairs, other: "CASE " + " ".join(f"WHEN {test} THEN {value}" for test, value in pairs) + f" ELSE {other} END"
_FUNCTIONS = " UNION ".join(f"SELECT {_KEY}, USNAM AS user, TCODE, '{name}' AS function FROM fx_bkpf WHERE TCODE IN ({_codes(codes)})" for name, codes in G.FUNCTIONS.items())
_FUNCTIONS += "".join(f" UNION SELECT {_KEY}, USNAM, TCODE, '{name}' FROM fx_bkpf WHERE PPNAM = USNAM" for name in ("parking", "approval"))
VIEWS = {
    "gl_debits": f"""SELECT b.*, coalesce(debit, 0) AS debit, coalesce(credit, 0) AS credit, coalesce(n_lines, 0) AS n_lines FROM fx_bkpf b LEFT JOIN (SELECT {_KEY}, coalesce(sum(WRBTR) FILTER (SHKZG = 'S'), 0) AS debit,
        coalesce(sum(WRBTR) FILTER (SHKZG = 'H'), 0) AS credit, count(*) AS n_lines FROM fx_bseg GROUP BY ALL) USING (BUKRS, BELNR, GJAHR)""",
    "gl_texts": "SELECT s.SAKNR AS HKONT, coalesce(t.TXT50, s.TXT50) AS account_text, CASE WHEN XBILK = 'X' THEN 'BS' ELSE 'PL' END AS account_type FROM fx_ska1 s LEFT JOIN (SELECT * FROM fx_skat WHERE SPRAS IN ('E', 'EN')) t USING (SAKNR)",
    "gl_balance": """SELECT HKONT, account_text, coalesce(account_type, 'PL') AS account_type, total_debit, total_credit, total_debit - total_credit AS balance, posting_count FROM (SELECT HKONT, coalesce(sum(abs(WRBTR)) FILTER (SHKZG = 'S'), 0) AS total_debit,
        coalesce(sum(abs(WRBTR)) FILTER (SHKZG <> 'S'), 0) AS total_credit, count(*) AS posting_count FROM fx_bseg GROUP BY 1) LEFT JOIN gl_texts USING (HKONT)""",
    "gl_lines": f"SELECT s.*, b.MONAT, b.USNAM, b.BUDAT FROM fx_bseg s LEFT JOIN fx_bkpf b USING ({_KEY})",
    "ja_weekend": _anomaly("'weekend_posting'", _CASES([("debit > 100000", "'high'")], "'medium'"), "debit", _CASES([("debit > 100000", "65")], "45"), "gl_debits", "dayofweek(BUDAT) IN (0, 6)"),
    "ja_round": _anomaly("'round_amount'", _CASES([("abs(WRBTR) >= 1000000", "'high'"), ("abs(WRBTR) >= 100000", "'medium'")], "'low'"), "abs(WRBTR)", _CASES([("abs(WRBTR) >= 1000000", "55"), ("abs(WRBTR) >= 100000", "40")], "25"), "gl_lines", "abs(WRBTR) >= 1000 AND abs(WRBTR) % 1000 = 0"),
    "ja_backdated": _anomaly("'backdated_entry'", _CASES([("CPUDT - BUDAT > 90", "'critical'"), ("CPUDT - BUDAT > 30", "'high'")], "'medium'"), "debit", _CASES([("CPUDT - BUDAT > 90", "90"), ("CPUDT - BUDAT > 30", "75")], "55"), "gl_debits", "CPUDT - BUDAT > 15"),
    "ja_periods": """SELECT GJAHR, MONAT, count(*) FILTER (at_end) AS n_end, count(*) FILTER (NOT at_end) AS n_rest, day(last_day(min(BUDAT))) AS days, min(BUKRS) AS BUKRS, min(BUDAT) FILTER (at_end) AS BUDAT, coalesce(sum(debit) FILTER (at_end), 0) AS total
        FROM (SELECT *, day(BUDAT) > day(last_day(BUDAT)) - 3 AS at_end FROM gl_debits) GROUP BY 1, 2""",
    "ja_spike": _anomaly("'period_end_spike'", _CASES([("n_end / 3.0 > 5.0 * n_rest / greatest(days - 3, 1)", "'high'")], "'medium'"), "total", _CASES([("n_end / 3.0 > 5.0 * n_rest / greatest(days - 3, 1)", "65")], "45"), "(SELECT *, 'PERIOD-' || MONAT AS BELNR, 'MULTIPLE' AS USNAM FROM ja_periods)", "n_rest > 0 AND n_end / 3.0 > 3.0 * n_rest / greatest(days - 3, 1) AND n_end >= 5"),
    "ja_manual": _anomaly("'manual_entry'", _CASES([("debit > 500000", "'high'"), ("debit > 100000", "'medium'")], "'low'"), "debit", _CASES([("debit > 500000", "60"), ("debit > 100000", "40")], "20"), "gl_debits", f"TCODE IN ({_codes(G.MANUAL)}) AND debit > 10000"),
    "ja_key": _anomaly("'unusual_posting_key'", "'medium'", "abs(WRBTR)", "50", "(SELECT *, count(*) OVER (PARTITION BY KOART, BSCHL) AS n, count(*) OVER (PARTITION BY KOART) AS total FROM gl_lines)", "total > 100 AND n / total < 0.01"),
    "ja_split": _anomaly("'split_below_threshold'", "'high'", "total", "80", "(SELECT USNAM, BUDAT, count(*) AS n, sum(debit) AS total, min((BUKRS, BELNR, GJAHR)) AS f, f[1] AS BUKRS, f[2] AS BELNR, f[3] AS GJAHR FROM gl_debits WHERE debit > 0 AND debit < 50000 GROUP BY USNAM, BUDAT)", "n >= 2 AND total BETWEEN 40000 AND 75000").replace("min((BUKRS, BELNR, GJAHR)) AS f, f[1] AS BUKRS, f[2] AS BELNR, f[3] AS GJAHR", "arg_min(BUKRS, BUKRS || BELNR || GJAHR) AS BUKRS, arg_min(BELNR, BUKRS || BELNR || GJAHR) AS BELNR, arg_min(GJAHR, BUKRS || BELNR || GJAHR) AS GJAHR"),
    "ja_time": _anomaly("'unusual_time'", "'low'", "debit", "30", "gl_debits", "(CAST(substr(CPUTM, 1, 2) AS INT) < 7 OR CAST(substr(CPUTM, 1, 2) AS INT) >= 19) AND debit > 10000"),
    "ja_all": " UNION ALL ".join(f"SELECT * FROM ja_{n}" for n in ("weekend", "round", "backdated", "spike", "manual", "key", "split", "time")),
    "sd_functions": _FUNCTIONS,
    "sd_users": "SELECT user, " + ", ".join(f"count(*) FILTER (function = '{n}') AS {n}" for n in G.FUNCTIONS) + " FROM sd_functions GROUP BY user",
    "sd_reversed": "SELECT b.BUKRS, b.BELNR, b.GJAHR, b.USNAM AS user, r.BELNR AS reversal_belnr FROM fx_bkpf b JOIN fx_bkpf r ON r.BUKRS = b.BUKRS AND r.STBLG = b.BELNR AND r.STJAH = b.GJAHR AND r.USNAM = b.USNAM",
    "sd_both": f"SELECT DISTINCT {_KEY}, user FROM sd_functions WHERE function = 'parking' INTERSECT SELECT {_KEY}, user FROM sd_functions WHERE function = 'approval'",
    "sd_rules": """SELECT user, 'post_and_approve' AS conflict_type, 'critical' AS severity, least(posting, approval) AS occurrences, 1 AS o FROM sd_users WHERE posting > 0 AND approval > 0
        UNION ALL SELECT USNAM, 'park_and_post', 'high', count(*), 2 FROM fx_bkpf WHERE PPNAM = USNAM GROUP BY 1
        UNION ALL SELECT user, 'create_and_pay', 'critical', least(vendor_master, payment), 3 FROM sd_users WHERE vendor_master > 0 AND payment > 0
        UNION ALL SELECT user, 'park_and_post', 'high', count(*), 4 FROM sd_both GROUP BY 1
        UNION ALL SELECT user, 'vendor_master_and_payment', 'critical', least(a, b), 5 FROM (SELECT user, count(*) FILTER (function = 'vendor_master' AND TCODE IN ('XK02', 'FK02')) AS a, count(*) FILTER (function = 'payment' AND TCODE = 'F110') AS b FROM sd_functions GROUP BY 1) WHERE a > 0 AND b > 0
        UNION ALL SELECT user, 'post_and_reverse', CASE WHEN count(*) > 3 THEN 'high' ELSE 'medium' END, count(*), 6 FROM sd_reversed GROUP BY 1""",
    "sd_conflicts": "SELECT user, conflict_type, severity, occurrences FROM (SELECT *, row_number() OVER (PARTITION BY user, conflict_type ORDER BY o) AS f FROM sd_rules) WHERE f = 1",
}
_RANK = "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END"
_VARIANCES = """SELECT HKONT, period, current_balance, prior_balance, current_balance - prior_balance AS variance_amount, round(abs(CAST(current_balance - prior_balance AS DOUBLE)) / abs(CAST(prior_balance AS DOUBLE)) * 100, 2) AS variance_percent
    FROM (SELECT *, lag(current_balance) OVER (PARTITION BY HKONT ORDER BY period) AS prior_balance FROM (SELECT HKONT, coalesce(MONAT, '001') AS period, sum(CASE WHEN SHKZG = 'S' THEN abs(WRBTR) ELSE -abs(WRBTR) END) AS current_balance FROM gl_lines GROUP BY 1, 2)) WHERE abs(prior_balance) >= 100"""
_SIGNED = "CASE WHEN SHKZG = 'S' THEN WRBTR ELSE -WRBTR END"
_AGE = f"date_diff('day', ZFBDT, DATE '{AS_OF}')"


def _detector(name: str) -> str:
    return f"SELECT * FROM ja_{name}"


def _counts(t):
    return G.assessment_counts(t.bkpf(), t.bseg(), t.ska1(), t.skat())


_PRIORITY = {"off_days": "CASE WHEN off_days > 10 THEN 'high' ELSE 'medium' END", "backdated": "CASE WHEN backdated_critical > 0 THEN 'critical' ELSE 'high' END"}
VIEWS["as_counts"] = """SELECT *, CASE WHEN n_critical > 0 THEN 'critical' WHEN n_high > 3 THEN 'high' WHEN n_high > 0 OR n_medium > 5 THEN 'medium' ELSE 'low' END AS overall_risk FROM (SELECT
    """ + ", ".join(f"(SELECT count(*) FROM ja_all WHERE severity = '{s}') + (SELECT count(*) FROM sd_conflicts WHERE severity = '{s}') AS n_{s}" for s in G.SEVERITIES) + """,
    (SELECT count(*) FROM ja_all WHERE anomaly_type = 'weekend_posting') AS weekend, (SELECT count(*) FROM ja_all WHERE anomaly_type IN ('weekend_posting', 'holiday_posting')) AS off_days, (SELECT count(*) FROM ja_all WHERE anomaly_type = 'backdated_entry') AS backdated,
    (SELECT count(*) FROM ja_all WHERE anomaly_type = 'backdated_entry' AND severity = 'critical') AS backdated_critical, (SELECT count(*) FROM ja_all WHERE anomaly_type = 'round_amount') AS round, (SELECT count(*) FROM ja_all WHERE anomaly_type = 'split_below_threshold') AS split,
    (SELECT count(*) FROM sd_conflicts) AS conflicts, (SELECT count(*) FROM sd_conflicts WHERE conflict_type = 'post_and_approve') AS post_and_approve, (SELECT count(*) FROM sd_conflicts WHERE conflict_type = 'park_and_post') AS park_and_post,
    (SELECT count(*) FROM sd_conflicts WHERE conflict_type IN ('vendor_master_and_payment', 'create_and_pay')) AS vendor_payment, (SELECT count(*) FROM as_suspense) AS suspense, (SELECT count(*) FROM as_pairs) AS intercompany,
    (SELECT count(*) FROM fx_bkpf) AS n_documents, (SELECT min(CAST(MONAT AS INT)) FROM fx_bkpf) AS first_period, (SELECT max(CAST(MONAT AS INT)) FROM fx_bkpf) AS last_period, (SELECT count(*) FROM fx_bseg) AS n_lines)"""
QUERIES = {
    "filter_fi": (lambda t: G.filter_fi(t.bkpf(), t.bseg(), company="0001", first="003", last="006", low="400010"), f"SELECT s.*, b.MONAT FROM fx_bseg s LEFT JOIN fx_bkpf b USING ({_KEY}) WHERE s.BUKRS = '0001' AND HKONT >= '400010' AND (MONAT IS NULL OR MONAT BETWEEN '003' AND '006')"),
    "document_debits": (lambda t: G.document_debits(t.bkpf(), t.bseg()).select(*G.KEY, "debit", "credit", "n_lines"), f"SELECT {_KEY}, debit, credit, n_lines FROM gl_debits"),
    "fi_documents": (lambda t: G.fi_documents(t.bkpf(), t.bseg()), f"SELECT {_KEY}, debit, credit, n_lines, abs(debit - credit) < 0.01 AS is_balanced, CASE WHEN AWKEY IS NOT NULL THEN CASE AWTYP WHEN 'VBRK' THEN 'Billing document' ELSE 'Invoice receipt' END || ' ' || AWKEY END AS origin FROM gl_debits"),
    "account_texts": (lambda t: G.account_texts(t.ska1(), t.skat()), "SELECT * FROM gl_texts"),
    "trial_balance": (lambda t: G.trial_balance(t.bseg(), t.ska1(), t.skat()), "SELECT * FROM gl_balance"),
    "suspense_accounts": (lambda t: G.suspense_accounts(G.trial_balance(t.bseg(), t.ska1(), t.skat())), "SELECT HKONT, balance, CASE WHEN abs(balance) > 10000 THEN 'significant balance' ELSE 'residual balance' END AS reason FROM gl_balance WHERE (HKONT LIKE '1990%' OR HKONT LIKE '2990%' OR HKONT LIKE '9999%') AND abs(balance) > 0.01"),
    "intercompany_mismatches": (lambda t: G.intercompany_mismatches(t.bseg()), f"""SELECT *, abs(balance_1 + balance_2) AS difference FROM (SELECT least(BUKRS, VBUND) AS company_1, greatest(BUKRS, VBUND) AS company_2, coalesce(sum({_SIGNED}) FILTER (BUKRS <= VBUND), 0) AS balance_1,
        coalesce(sum({_SIGNED}) FILTER (BUKRS > VBUND), 0) AS balance_2 FROM fx_bseg WHERE VBUND <> '' GROUP BY 1, 2) WHERE abs(balance_1 + balance_2) > 0.01"""),
    "open_item_aging": (lambda t: G.open_item_aging(t.bseg(), AS_OF), f"""SELECT coalesce(sum(a) FILTER (d <= 0), 0) AS current, coalesce(sum(a) FILTER (d > 0 AND d <= 30), 0) AS days_30, coalesce(sum(a) FILTER (d > 30 AND d <= 60), 0) AS days_60, coalesce(sum(a) FILTER (d > 60 AND d <= 90), 0) AS days_90,
        coalesce(sum(a) FILTER (d > 90), 0) AS over_90 FROM (SELECT abs(WRBTR) AS a, {_AGE} AS d FROM fx_bseg WHERE AUGDT IS NULL AND KOART IN ('D', 'K') AND ZFBDT IS NOT NULL)"""),
    "gl_variances": (lambda t: G.gl_variances(t.bkpf(), t.bseg()), f"SELECT *, CASE WHEN variance_percent >= 100 THEN 'high' WHEN variance_percent >= 50 THEN 'medium' ELSE 'low' END AS severity FROM ({_VARIANCES}) WHERE variance_percent >= 25 ORDER BY variance_percent DESC, HKONT, period LIMIT 50"),
    "journal_weekend_holiday": (lambda t: G.journal_weekend_holiday(G.document_debits(t.bkpf(), t.bseg())), _detector("weekend")),
    "journal_round_amount": (lambda t: G.journal_round_amount(t.bkpf(), t.bseg()), _detector("round")),
    "journal_backdated": (lambda t: G.journal_backdated(G.document_debits(t.bkpf(), t.bseg())), _detector("backdated")),
    "journal_period_end_spike": (lambda t: G.journal_period_end_spike(G.document_debits(t.bkpf(), t.bseg())), _detector("spike")),
    "journal_manual": (lambda t: G.journal_manual(G.document_debits(t.bkpf(), t.bseg())), _detector("manual")),
    "journal_unusual_key": (lambda t: G.journal_unusual_key(t.bkpf(), t.bseg()), _detector("key")),
    "journal_split": (lambda t: G.journal_split(G.document_debits(t.bkpf(), t.bseg())), _detector("split")),
    "journal_unusual_time": (lambda t: G.journal_unusual_time(G.document_debits(t.bkpf(), t.bseg())), _detector("time")),
    "journal_anomalies": (lambda t: G.journal_anomalies(t.bkpf(), t.bseg()), _detector("all")),
    "top_anomalies": (lambda t: G.top_anomalies(G.journal_anomalies(t.bkpf(), t.bseg())), f"SELECT * FROM ja_all ORDER BY risk_score DESC, {_RANK}, {_KEY}, anomaly_type, amount LIMIT 200"),
    "anomaly_summary": (lambda t: G.anomaly_summary(G.journal_anomalies(t.bkpf(), t.bseg())), "SELECT 'severity' AS dimension, severity AS value, count(*) AS n FROM ja_all GROUP BY 2 UNION ALL SELECT 'type', anomaly_type, count(*) FROM ja_all GROUP BY 2 UNION ALL SELECT 'user', user, count(*) FROM ja_all GROUP BY 2"),
    "top_users": (lambda t: G.top_users(G.journal_anomalies(t.bkpf(), t.bseg())), "SELECT user, count(*) AS n FROM ja_all GROUP BY 1 ORDER BY n DESC, user LIMIT 10"),
    "sod_user_activity": (lambda t: G.sod_user_activity(t.bkpf()), "SELECT * FROM sd_users"),
    "reversal_pairs": (lambda t: G.reversal_pairs(t.bkpf()), "SELECT * FROM sd_reversed"),
    "parked_and_approved": (lambda t: G.parked_and_approved(t.bkpf()), "SELECT * FROM sd_both"),
    "sod_conflicts": (lambda t: G.sod_conflicts(t.bkpf()), "SELECT * FROM sd_conflicts"),
    "top_conflicts": (lambda t: G.top_conflicts(G.sod_conflicts(t.bkpf())), f"SELECT * FROM sd_conflicts ORDER BY {_RANK}, occurrences DESC, user, conflict_type LIMIT 100"),
    "sod_summary": (lambda t: G.sod_summary(G.sod_conflicts(t.bkpf())), "SELECT conflict_type, severity, count(*) AS n_users, CAST(sum(occurrences) AS BIGINT) AS occurrences FROM sd_conflicts GROUP BY 1, 2"),
    "sod_top_users": (lambda t: G.sod_top_users(G.sod_conflicts(t.bkpf())), "SELECT user, count(DISTINCT conflict_type) AS n_types, CAST(sum(occurrences) AS BIGINT) AS occurrences FROM sd_conflicts GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 10"),
    "most_frequent_year": (lambda t: G.most_frequent_year(t.bkpf()), "SELECT GJAHR, count(*) AS n FROM fx_bkpf GROUP BY 1 ORDER BY n DESC, GJAHR LIMIT 1"),
    "fi_assessment": (lambda t: G.fi_assessment(t.bkpf(), t.bseg()), """SELECT *, CASE WHEN n_critical > 0 THEN 'critical' WHEN n_high > 3 THEN 'high' WHEN n_high > 0 OR n_medium > 5 THEN 'medium' ELSE 'low' END AS overall_risk FROM (SELECT count(*) FILTER (severity = 'critical') AS n_critical,
        count(*) FILTER (severity = 'high') AS n_high, count(*) FILTER (severity = 'medium') AS n_medium, count(*) FILTER (severity = 'low') AS n_low FROM (SELECT severity FROM ja_all UNION ALL SELECT severity FROM sd_conflicts))"""),
    "assessment_counts": (_counts, "SELECT * FROM as_counts"),
    "assessment_concerns": (lambda t: G.assessment_concerns(_counts(t)), " UNION ALL ".join(f"SELECT {i} AS position, {name} || ' {text}' AS concern FROM as_counts WHERE {name} > 0" for i, (name, text) in enumerate(G.CONCERNS))),
    "assessment_recommendations": (lambda t: G.assessment_recommendations(_counts(t)), " UNION ALL ".join(f"SELECT {_PRIORITY.get(name, repr(level))} AS priority, '{category}' AS category, '{text}' AS recommendation, {name} AS affected_items FROM as_counts WHERE {name} > 0" for name, level, category, text in G.ADVICE)),
    "assessment_markdown": (lambda t: G.assessment_markdown(_counts(t)).where("position < 12 and line like '|%'"), "SELECT * FROM (SELECT 2 AS position, '| Metric | Value |' AS line UNION ALL SELECT 3, '|---|---|' UNION ALL " + " UNION ALL ".join(f"SELECT {i}, '| {name} | ' || {c} || ' |' FROM as_counts" for i, (name, c) in enumerate([("Overall risk", "overall_risk"), ("Documents", "n_documents"), ("Lines", "n_lines"), *((s.capitalize(), f"n_{s}") for s in G.SEVERITIES)], 4)) + ")"),
}
# views stand in the order in which they use each other
VIEWS |= {"as_suspense": QUERIES["suspense_accounts"][1], "as_pairs": QUERIES["intercompany_mismatches"][1], "as_counts": VIEWS.pop("as_counts")}
