"""Conformance of event logs to process models, in two forms that are kept apart.

check_conformance is the state-machine form: a wrong order per earlier activity, a duplicate per occurrence.
check_ordered is the form against a running maximum of model positions: a wrong order per event, a repeat per activity.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .log import in_case

#: Severity by kind of deviation and activity; "" is the default of a kind.
SEVERITY = {
    ("skipped_activity", ""): "major", ("skipped_activity", "OrderCreated"): "critical",
    ("wrong_order", ""): "major", ("wrong_order", "InvoiceCreated"): "critical",
    ("unexpected_activity", ""): "minor",
    ("missing_activity", ""): "major", ("missing_activity", "OrderCreated"): "critical", ("missing_activity", "InvoiceCreated"): "minor",
    ("duplicate_activity", ""): "minor", ("invalid_start", ""): "critical", ("invalid_end", ""): "minor",
}
#: What a deviation takes from the fitness.
PENALTY = {"critical": 0.30, "major": 0.15, "minor": 0.05, "info": 0.01}


def severity_of(rules: dict[tuple[str, str], str]) -> Column:
    names = F.create_map(*(F.lit(x) for (kind, activity), s in rules.items() for x in (f"{kind}/{activity}", s)))
    return F.coalesce(names[F.concat_ws("/", "deviation_type", "activity")], names[F.concat("deviation_type", F.lit("/"))], F.lit("major"))


def map_to_model(log: DataFrame, names: DataFrame, any_case: bool = False) -> DataFrame:
    """The log with `mapped`: the model's activity for each event, null if there is none. names is a small model table."""
    raw = F.lower("activity") if any_case else F.col("activity")
    return log.join(names, raw == F.col("raw"), "left").drop("raw")


def traces(log: DataFrame, model: DataFrame, names: DataFrame) -> DataFrame:
    """Events with their position, canonical activity and what the model says of it."""
    placed = map_to_model(log, names).withColumn("position", F.row_number().over(in_case()) - 1).withColumn("activity", F.coalesce("mapped", "activity"))
    return placed.select("case_id", "activity", "ts", "position").join(model, "activity", "left")


#: Bits of a word of a set of activities.
WORD = 63


class Masks:
    """A model's activities as bits of one or more words, and what the model says as masks. A model is its definition,
    some dozen rows, which are read here; sets of activities are then numbers, whatever the length of a case."""

    def __init__(self, model: DataFrame):
        self.rows = model.orderBy("model_order", "activity").collect()
        self.names = [r["activity"] for r in self.rows]
        self.words = max(1, -(-len(self.names) // WORD))
        self.spark = model.sparkSession

    def of(self, names: Iterable[str]) -> list[int]:
        out = [0] * self.words
        for i, name in enumerate(self.names):
            if name in names:
                out[i // WORD] |= 1 << i % WORD
        return out

    def frame(self) -> DataFrame:
        """activity, its number and place, own bit, those of later activities and of its required ones, start and end."""
        said = [
            (r["activity"], i, *self.of({r["activity"]}), *self.of({x["activity"] for x in self.rows if x["model_order"] > r["model_order"]}), *self.of(set(r["required"])), ",".join(sorted(r["required"])), r["is_start"], r["is_end"])
            for i, r in enumerate(self.rows)
        ]
        words = ", ".join(f"_{kind}{w} long" for kind in ("own", "later", "required") for w in range(self.words))
        return self.spark.createDataFrame(said, f"activity string, _at int, {words}, _needs string, is_start boolean, is_end boolean")

    def column(self, kind: str) -> list[Column]:
        return [F.col(f"_{kind}{w}") for w in range(self.words)]

    def fixed(self, names: Iterable[str]) -> list[Column]:
        return [F.lit(x).cast("long") for x in self.of(names)]

    def members(self, masks: list[Column]) -> Column:
        """The names whose bits are set, in the order of the model."""
        return F.array_compact(F.array(*(F.when(masks[i // WORD].bitwiseAND(F.lit(1 << i % WORD)) != 0, name) for i, name in enumerate(self.names)))).cast("array<string>")


def meet(a: list[Column], b: list[Column]) -> Column:
    """Whether two sets have a common activity."""
    return reduce(lambda x, y: x | y, (p.bitwiseAND(q) != 0 for p, q in zip(a, b, strict=True)))


def common(a: list[Column], b: list[Column]) -> list[Column]:
    return [p.bitwiseAND(q) for p, q in zip(a, b, strict=True)]


def without(a: list[Column], b: list[Column]) -> list[Column]:
    return [p.bitwiseAND(F.bitwise_not(q)) for p, q in zip(a, b, strict=True)]


def replayed(log: DataFrame, model: DataFrame, names: DataFrame) -> tuple[DataFrame, Masks]:
    """Events with position, what was seen before (as bits), the first place of each activity so far, and whether the
    event is the last: all from one sort by case and time, in frames that only grow by one event a row."""
    masks = Masks(model)
    placed = map_to_model(log, names).select("case_id", F.coalesce("mapped", "activity").alias("activity"), "ts", "event_id", F.col("activity").alias("_raw"))
    known = placed.join(masks.frame(), "activity", "left")
    order = Window.partitionBy("case_id").orderBy("ts", "event_id", "_raw")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    numbered = known.withColumn("position", F.row_number().over(order) - 1)
    return numbered.withColumns({
        **{f"_seen{w}": F.coalesce(F.bit_or(f"_own{w}").over(before), F.lit(0).cast("long")) for w in range(masks.words)},
        "_firsts": F.array(*(F.min(F.when(F.col("_at") == i, F.col("position"))).over(before) for i in range(len(masks.names)))).cast("array<int>"),
        "_last": F.lead("position").over(order).isNull(),
    }), masks


def missing_activities(events: DataFrame, model: DataFrame) -> DataFrame:
    """(case_id, activity): mandatory activities that a case lacks, from one set of bits per case."""
    masks = Masks(model)
    done = events.join(masks.frame().select("activity", *(f"_own{w}" for w in range(masks.words))), "activity", "left").groupBy("case_id").agg(*(F.coalesce(F.bit_or(f"_own{w}"), F.lit(0).cast("long")).alias(f"_seen{w}") for w in range(masks.words)))
    wanted = masks.fixed({r["activity"] for r in masks.rows if r["is_mandatory"]})
    return done.select("case_id", F.explode(masks.members(without(wanted, masks.column("seen")))).alias("activity"))


def order_violations(log: DataFrame, model: DataFrame, names: DataFrame) -> DataFrame:
    """(case_id, activity, position, other): each event with the distinct earlier activities that the model puts later."""
    events, masks = replayed(log, model, names)
    late = masks.members(common(masks.column("later"), masks.column("seen")))
    return events.where("_at is not null").select("case_id", "activity", "position", F.explode(late).alias("other"))


def flagged(log: DataFrame, model: DataFrame, names: DataFrame) -> DataFrame:
    """case_id and `found` for each event: its deviations, and with the last event those of the whole case."""
    events, masks = replayed(log, model, names)
    known, seen, own = F.col("_at").isNotNull(), masks.column("seen"), masks.column("own")
    text = F.lit("").alias("detail")

    def one(kind: str, when: Column, detail: Column = text) -> Column:
        row = F.struct(F.lit(kind).alias("deviation_type"), F.col("activity").alias("activity"), F.col("position").cast("int").alias("position"), detail.cast("string").alias("detail"))
        return F.when(when, F.array(row)).otherwise(F.array().cast(ROW))

    def each(kind: str, names: Column, position: Column, activity=lambda x: F.col("activity"), detail=lambda x: x) -> Column:
        return F.transform(names, lambda x: F.struct(F.lit(kind).alias("deviation_type"), activity(x).alias("activity"), position.cast("int").alias("position"), detail(x).alias("detail"))).cast(ROW)

    mandatory = masks.fixed({r["activity"] for r in masks.rows if r["is_mandatory"]})
    done = [a.bitwiseOR(F.coalesce(b, F.lit(0).cast("long"))) for a, b in zip(seen, own, strict=True)]
    lacking = without(mandatory, done)
    nothing = F.array().cast("array<string>")
    found = F.concat(
        one("invalid_start", (F.col("position") == 0) & ~F.col("is_start")),
        one("skipped_activity", (F.col("_needs") != "") & ~meet(masks.column("required"), seen) & ~F.col("is_start"), F.col("_needs")),
        each("wrong_order", F.when(known & meet(masks.column("later"), seen), masks.members(common(masks.column("later"), seen))).otherwise(nothing), F.col("position")),
        one("unexpected_activity", ~known),
        one("duplicate_activity", known & meet(own, seen), F.get("_firsts", F.col("_at"))),
        each("missing_activity", F.when(F.col("_last"), masks.members(lacking)).otherwise(nothing), F.lit(-1), lambda x: x, lambda x: F.lit("")),
        one("invalid_end", F.col("_last") & ~meet(mandatory, lacking) & ~F.coalesce("is_end", F.lit(False))),
    )
    return events.select("case_id", found.alias("found"))


ROW = "array<struct<deviation_type: string, activity: string, position: int, detail: string>>"


def deviations(log: DataFrame, model: DataFrame, names: DataFrame, rules: dict[tuple[str, str], str] | None = None) -> DataFrame:
    """case_id, deviation_type, activity, position, detail, severity. A missing activity has position -1."""
    return flagged(log, model, names).select("case_id", F.explode("found").alias("d")).select("case_id", "d.*").withColumn("severity", severity_of(rules or SEVERITY))


def check_conformance(log: DataFrame, model: DataFrame, names: DataFrame, rules: dict[tuple[str, str], str] | None = None) -> DataFrame:
    """case_id, n_deviations, fitness, is_conformant of every case."""
    found = flagged(log, model, names).select("case_id", F.explode_outer("found").alias("d")).select("case_id", "d.*").withColumn("severity", F.when(F.col("deviation_type").isNotNull(), severity_of(rules or SEVERITY)))
    cases = found.groupBy("case_id").agg(F.count("severity").alias("n_deviations"), *(F.count_if(F.col("severity") == s).alias(f"_{s}") for s in PENALTY))
    lost = reduce(lambda a, b: a + b, (F.col(f"_{s}") * p for s, p in PENALTY.items()))
    return cases.select("case_id", "n_deviations", F.round(F.greatest(F.lit(0.0), 1 - lost), 4).alias("fitness"), (F.col("n_deviations") == 0).alias("is_conformant"))


def cases_by_fitness(results: DataFrame, low: float, high: float) -> DataFrame:
    return results.where(F.col("fitness").between(low, high))


def non_conformant(results: DataFrame) -> DataFrame:
    return results.where(~F.col("is_conformant"))


def filter_deviations(found: DataFrame, severities: list[str]) -> DataFrame:
    return found.where(F.col("severity").isin(severities))


def conformance_summary(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count("*").alias("n_cases"), F.count_if("is_conformant").alias("n_conformant"), F.round(F.avg(F.col("is_conformant").cast("int")) * 100, 2).alias("conformance_rate"),
        F.round(F.avg("fitness"), 4).alias("avg_fitness"), F.min("fitness").alias("min_fitness"), F.max("fitness").alias("max_fitness"), F.sum("n_deviations").alias("n_deviations"),
    )


def deviation_summary(found: DataFrame) -> DataFrame:
    """Counts by type, severity and activity in one pass."""
    grouped = found.groupingSets([["deviation_type"], ["severity"], ["activity"]], "deviation_type", "severity", "activity").agg(F.count("*").alias("n"), F.grouping_id().alias("_g"))
    name = F.when(F.col("_g") == 3, "type").when(F.col("_g") == 5, "severity").otherwise("activity")
    return grouped.select(name.alias("dimension"), F.coalesce("deviation_type", "severity", "activity").alias("value"), "n")


def deviation_patterns(found: DataFrame, top: int = 10) -> DataFrame:
    return found.groupBy("deviation_type", "activity").agg(F.count("*").alias("n"), F.countDistinct("case_id").alias("n_cases")).orderBy(F.desc("n"), "deviation_type", "activity").limit(top)


def ordered_deviations(log: DataFrame, model: DataFrame, names: DataFrame) -> DataFrame:
    """case_id, deviation_type, activity, severity against the running maximum of model positions."""
    mapped = map_to_model(log, names, any_case=True)
    row = lambda df, kind, severity: df.select("case_id", F.lit(kind).alias("deviation_type"), "activity", F.lit(severity).alias("severity"))
    known = mapped.where("mapped is not null").withColumn("position", F.row_number().over(in_case())).select("case_id", F.col("mapped").alias("activity"), "position").join(model, "activity")
    before = Window.partitionBy("case_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    # of equal positions in the model the earliest event holds the maximum
    high = known.withColumn("_high", F.max(F.struct("model_order", (-F.col("position")).alias("p"), "activity")).over(before))
    wrong = high.where((F.col("model_order") < F.col("_high.model_order")) & ~F.array_contains("allowed", F.col("_high.activity")))
    done = known.groupBy("case_id").agg(F.collect_set("activity").alias("_done"))
    cases = log.select("case_id").distinct().join(done, "case_id", "left").crossJoin(F.broadcast(model.where("is_required").agg(F.collect_list("activity").alias("_all"))))
    none = F.array().cast("array<string>")
    missing = cases.select("case_id", F.explode(F.array_except("_all", F.coalesce("_done", none))).alias("activity"))
    repeated = known.groupBy("case_id", "activity").agg(F.count("*").alias("_n")).where("_n > 1")
    parts = [row(mapped.where("mapped is null"), "unexpected_activity", "major"), row(missing, "missing_activity", "critical"), row(wrong, "wrong_order", "critical"), row(repeated, "repeated_activity", "minor")]
    return reduce(DataFrame.unionByName, parts)


def check_ordered(log: DataFrame, model: DataFrame, names: DataFrame) -> DataFrame:
    """case_id, n_deviations, fitness: the share of required activities less 0.2, 0.1 and 0.05 a deviation."""
    found = ordered_deviations(log, model, names).groupBy("case_id").agg(
        F.count("*").alias("n"), *(F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "major", "minor")), F.count_if(F.col("deviation_type") == "missing_activity").alias("_missing")
    )
    required = model.agg(F.count_if("is_required").alias("_required"))
    cases = log.select("case_id").distinct().join(found, "case_id", "left").na.fill(0).crossJoin(F.broadcast(required))
    base = 1 - F.col("_missing") / F.col("_required")
    penalty = F.col("critical") * 0.2 + F.col("major") * 0.1 + F.col("minor") * 0.05
    return cases.select("case_id", F.col("n").alias("n_deviations"), F.round(F.greatest(F.lit(0.0), base - F.least(penalty, base)), 4).alias("fitness"))


def document_flow_log(flow: DataFrame, orders: DataFrame, deliveries: DataFrame) -> DataFrame:
    """The flow of each order as an event log: categories and, where goods left, a goods issue."""
    of_delivery = deliveries.select("delivery", F.col("vbeln").alias("case_id"))
    first = orders.select(F.col("vbeln").alias("case_id"), F.lit("C").alias("activity"), F.col("erdat").alias("ts"), F.lit(1).alias("event_id"))
    second = deliveries.select(F.col("vbeln").alias("case_id"), F.lit("J").alias("activity"), F.col("created").alias("ts"), F.lit(2).alias("event_id"))
    third = deliveries.where("actual_gi is not null").select(F.col("vbeln").alias("case_id"), F.lit("R").alias("activity"), F.col("actual_gi").alias("ts"), F.lit(3).alias("event_id"))
    fourth = flow.where("vbtyp_n = 'M'").join(of_delivery, F.col("vbelv") == F.col("delivery")).select("case_id", F.lit("M").alias("activity"), F.col("erdat").alias("ts"), F.lit(4).alias("event_id"))
    return reduce(DataFrame.unionByName, [first, second, third, fourth])


def check_document_flow(flow: DataFrame, orders: DataFrame, deliveries: DataFrame, model: DataFrame, names: DataFrame) -> DataFrame:
    return check_ordered(document_flow_log(flow, orders, deliveries), model, names)


def skipped_optional(log: DataFrame, model: DataFrame, names: DataFrame) -> DataFrame:
    """(case_id, activity): optional steps of an ordered model that a case goes without; these are no deviations."""
    done = map_to_model(log, names, any_case=True).groupBy("case_id").agg(F.collect_set("mapped").alias("_done"))
    optional = model.where("not is_required").agg(F.collect_list("activity").alias("_all"))
    return done.crossJoin(F.broadcast(optional)).select("case_id", F.explode(F.array_except("_all", "_done")).alias("activity"))


#: Severities of deviations, worst first.
DEVIATION_LEVELS = ["critical", "major", "minor", "info"]


def deviations_by_severity(found: DataFrame) -> DataFrame:
    """Deviations with the rank of their severity, the worst first, then by case and position."""
    rank = reduce(lambda out, pair: out.when(F.col("severity") == pair[1], pair[0]), enumerate(DEVIATION_LEVELS[1:3], 1), F.when(F.col("severity") == DEVIATION_LEVELS[0], 0)).otherwise(3)
    return found.withColumn("rank", rank).orderBy("rank", "case_id", "position", "deviation_type")
