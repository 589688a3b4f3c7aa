"""Queries over tables in which cases are planted that the derived tables alone don't hold, so that every branch has rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import conformance as C
from ..operators import ledger as G
from ..operators import log as L
from ..operators import stats
from . import models as M
from .analysis_queries import docs
from .conformance_queries import _dealt, _model
from .ledger_queries import VIEWS as LEDGER

_AT_END = "dayofmonth(BUDAT) > dayofmonth(last_day(BUDAT)) - 3"
_FEW = "CAST(BELNR AS BIGINT) % 12 = 0"


def _busy_ends(t):
    """Ledger headers with most days but the last ones of a month thinned out."""
    return t.bkpf().where(f"{_AT_END} OR {_FEW}")


def _reversed(t):
    """Headers, and for every 37th a document that reverses it: by its own user if the number is even."""
    head = t.bkpf()
    number = F.col("BELNR").cast("long")
    undone = head.where(number % 37 == 0).withColumns({
        "STBLG": F.col("BELNR"), "STJAH": F.col("GJAHR"), "BELNR": F.concat(F.lit("R"), F.substring("BELNR", 2, 9)), "USNAM": F.when(number % 2 == 0, F.col("USNAM")).otherwise(F.concat("USNAM", F.lit("X"))),
    })
    return head.unionByName(undone)


_SQL_END = f"(day(BUDAT) > day(last_day(BUDAT)) - 3 OR {_FEW})"
_ORDERED = "PARTITION BY case_id ORDER BY ts, event_id, activity"
VIEWS = {
    "pl_periods": LEDGER["ja_periods"].replace("FROM gl_debits", f"FROM gl_debits WHERE {_SQL_END}"),
    "pl_spike": LEDGER["ja_spike"].replace("ja_periods", "pl_periods"),
    "pl_follows": f"""SELECT *, round(n / sum(n) OVER (), 6) AS share, round(n / sum(n) OVER (), 6) > 0.1 AS is_main_path FROM (SELECT activity AS from_activity, to_activity, count(*) AS n, round(avg(hours), 4) AS avg_hours, round(min(hours), 4) AS min_hours, round(max(hours), 4) AS max_hours
        FROM (SELECT activity, lead(activity) OVER ({_ORDERED}) AS to_activity, (epoch_us(lead(ts) OVER ({_ORDERED})) - epoch_us(ts)) / 3.6e9 AS hours FROM fx_o2c_clean_log) WHERE to_activity IS NOT NULL GROUP BY ALL)""",
    "pl_rates": """SELECT cluster, n AS n_cluster, m AS n_baseline, a, b, (a * n + b * m) / (n + m) AS q FROM (SELECT cluster, count(*) AS n, avg(f) AS a FROM (SELECT cluster, CAST(delivery_delay_days > 7 AS INT) AS f FROM an_docs WHERE delivery_delay_days IS NOT NULL) GROUP BY 1),
        (SELECT count(*) AS m, avg(CAST(delivery_delay_days > 7 AS INT)) AS b FROM an_docs WHERE delivery_delay_days IS NOT NULL)""",
}
_H = "2 * asin(sqrt(a)) - 2 * asin(sqrt(b))"
_SE = "1.959963984540054 * sqrt(a * (1 - a) / n_cluster + b * (1 - b) / n_baseline)"
QUERIES = {
    "main_path_sales": (lambda t: L.transition_filter(L.directly_follows(t.o2c_clean_log()), main_path=True), "SELECT * FROM pl_follows WHERE is_main_path"),
    "duration_outliers_near": (lambda t: L.duration_outliers(t.o2c_log(), sigmas=1.5), """SELECT * FROM (SELECT case_id, count(*) AS n_events, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9, 4) AS duration_hours FROM fx_o2c_log GROUP BY 1)
        WHERE duration_hours > (SELECT avg(h) + 1.5 * stddev_samp(h) FROM (SELECT round((epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9, 4) AS h FROM fx_o2c_log GROUP BY case_id))"""),
    "period_end_spike_planted": (lambda t: G.journal_period_end_spike(G.document_debits(_busy_ends(t), t.bseg())), "SELECT * FROM pl_spike"),
    "reversal_pairs_planted": (lambda t: G.reversal_pairs(_reversed(t)), "SELECT BUKRS, BELNR, GJAHR, USNAM AS user, 'R' || substr(BELNR, 2, 9) AS reversal_belnr FROM fx_bkpf WHERE CAST(BELNR AS BIGINT) % 37 = 0 AND CAST(BELNR AS BIGINT) % 2 = 0 UNION ALL SELECT * FROM sd_reversed"),
    "skipped_optional_planted": (lambda t: C.skipped_optional(_dealt(t, "p2p_detailed").where("event_id % 13 = 0"), *_model(t, M.MODELS["p2p_detailed"])), """SELECT case_id, activity FROM (SELECT DISTINCT case_id FROM md_p2p_detailed_log WHERE event_id % 13 = 0)
        CROSS JOIN (SELECT unnest(['pr_created', 'po_approved', 'invoice_cleared']) AS activity) EXCEPT SELECT case_id, activity FROM md_p2p_detailed_log WHERE event_id % 13 = 0"""),
    "cluster_rate_sizes": (lambda t: stats.cluster_rate_effects(docs(t), F.col("delivery_delay_days") > 7, "delay_probability").drop("p_value", "is_significant"), f"""SELECT cluster, 'delay_probability' AS metric, n_cluster, n_baseline, round(a, 4) AS cluster_value, round(b, 4) AS baseline_value, round(a - b, 4) AS difference,
        round({_H}, 4) AS effect_size, CASE WHEN abs({_H}) < 0.2 THEN 'negligible' WHEN abs({_H}) < 0.5 THEN 'small' WHEN abs({_H}) < 0.8 THEN 'medium' ELSE 'large' END AS effect, round(a - b - {_SE}, 4) AS ci_lower, round(a - b + {_SE}, 4) AS ci_upper FROM pl_rates"""),
}
