"""Queries on mapped rows: the given tables under the names that remote services and external collections use."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as R
from ..sources import tables as S
from ..sources.fixtures import AS_OF
from .feature_queries import VIEWS as FEATURES


def _header(t):
    return t.orders().select("vbeln", "auart", "vkorg", "kunnr", F.date_format("erdat", "dd.MM.yyyy").alias("erdat"), F.lit("8:05:00").alias("erzet"), "netwr", F.date_format("vdatu", "yyyy-MM-dd").alias("vdatu"))


def _external(t):
    orders = t.orders().select(F.col("orderkey").alias("SalesDocument"), F.col("vkorg").alias("SalesOrganization"), F.col("netwr").alias("TotalNetAmount"))
    items = t.lines().select(F.col("l_orderkey").alias("SalesDocument"), (F.col("line_no") * 10).alias("SalesDocumentItem"), F.col("l_partkey").alias("Material"))
    return S.map_external_orders(orders, items).select("vbeln", "vkorg", "netwr", F.size("items").alias("n_items"), F.array_join(F.transform("items", lambda i: F.concat_ws(":", i["posnr"], i["matnr"])), ",").alias("items"))


def _customers(t):
    customers = t.read("customer").select(F.col("c_custkey").alias("Customer"), F.col("c_mktsegment").alias("IndustryKey"))
    addresses = t.read("customer").join(t.read("nation"), F.col("c_nationkey") == F.col("n_nationkey")).where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("Customer"), F.col("n_name").alias("Country"), F.col("n_regionkey").cast("string").alias("Region"))
    return S.map_external_customers(customers, addresses)


def _full(t):
    return R.case_features_full(t.o2c_log().withColumn("resource", F.concat(F.lit("R"), (F.col("event_id") % 3).cast("string"))), AS_OF)


VIEWS = FEATURES | {"sq_log": "SELECT *, 'R' || CAST(event_id % 3 AS VARCHAR) AS resource FROM fx_o2c_log"}
QUERIES = {
    "map_service_rows": (lambda t: S.map_service_rows(_header(t), "header"), "SELECT vbeln AS \"VBELN\", auart AS \"AUART\", vkorg AS \"VKORG\", kunnr AS \"KUNNR\", strftime(erdat, '%Y%m%d') AS \"AUDAT\", strftime(erdat, '%Y%m%d') AS \"ERDAT\", '805000' AS \"ERZET\", netwr AS \"NETWR\", strftime(vdatu, '%Y%m%d') AS \"VDATU\" FROM fx_orders"),
    "map_external_orders": (_external, "SELECT o.vbeln, vkorg, netwr, CAST(n AS INT) AS n_items, items FROM fx_orders o LEFT JOIN (SELECT l_orderkey, count(*) AS n, string_agg(lpad(CAST(line_no * 10 AS VARCHAR), 6, '0') || ':' || l_partkey, ',' ORDER BY line_no) AS items FROM fx_lines GROUP BY 1) ON orderkey = l_orderkey"),
    "map_external_customers": (_customers, "SELECT CAST(c_custkey AS VARCHAR) AS kunnr, 'Customer ' || right(CAST(c_custkey AS VARCHAR), 4) AS name1, c_mktsegment AS brsch, '1000' AS vkorg, CASE WHEN c_custkey % 3 <> 0 THEN n_name ELSE 'US' END AS land1, CASE WHEN c_custkey % 3 <> 0 THEN CAST(n_regionkey AS VARCHAR) ELSE 'NA' END AS regio FROM customer JOIN nation ON c_nationkey = n_nationkey"),
    "case_features_full": (_full, f"""SELECT e.* EXCLUDE (risk_indicators), start_hour, n_resources, resource_changes, current_activity, previous_activity, concat_ws(',', {", ".join(f"CASE WHEN {test} THEN '{name}' END" for name, test in R.INDICATORS)}) AS risk_indicators FROM ft_ext e
        JOIN (SELECT case_id, CAST(hour(min(ts)) AS INT) AS start_hour FROM sq_log GROUP BY 1) s USING (case_id)
        JOIN (SELECT case_id, count(DISTINCT resource) AS n_resources, count(*) FILTER (resource <> before) AS resource_changes FROM (SELECT *, lag(resource) OVER (PARTITION BY case_id ORDER BY ts, event_id, activity) AS before FROM sq_log) GROUP BY 1) h USING (case_id)
        JOIN (SELECT case_id, max(activity) FILTER (n = 1) AS current_activity, max(activity) FILTER (n = 2) AS previous_activity FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY ts DESC, event_id DESC, activity DESC) AS n FROM sq_log) GROUP BY 1) r USING (case_id)"""),
}
