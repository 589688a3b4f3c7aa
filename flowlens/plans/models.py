"""Process models as plain data: activities, edges and names, turned into small DataFrames.

Model is the state-machine form (starts, ends, mandatory steps, edges); OrderedModel the form with a position for
each activity and predecessors that excuse it. Both can be built by hand or with sequence().
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Model:
    name: str
    mandatory: set[str] = field(default_factory=set)
    optional: set[str] = field(default_factory=set)
    starts: set[str] = field(default_factory=set)
    ends: set[str] = field(default_factory=set)
    edges: set[tuple[str, str]] = field(default_factory=set)
    names: dict[str, str] = field(default_factory=dict)  # raw event name to activity

    def activity(self, name: str, kind: str = "step", events: tuple[str, ...] = ()) -> Model:
        """kind: start, end, step or optional."""
        (self.optional if kind == "optional" else self.mandatory).add(name)
        if kind == "start":
            self.starts.add(name)
        if kind == "end":
            self.ends.add(name)
        self.names |= {event: name for event in (name, *events)}
        return self

    def sequence(self, *names: str) -> Model:
        self.edges |= set(zip(names, names[1:], strict=False))
        return self

    def parallel(self, before: str, branches: list[str], after: str) -> Model:
        for branch in branches:
            self.sequence(before, branch, after)
        return self

    @property
    def activities(self) -> set[str]:
        return self.mandatory | self.optional

    def order(self) -> dict[str, int]:
        """Positions along the edges; those in a cycle come last. Models have a dozen nodes."""
        left, out = set(self.activities), {}
        while left:
            free = sorted(a for a in left if not any(b == a and x in left for x, b in self.edges)) or sorted(left)
            for a in free:
                out[a] = len(out)
            left -= set(free)
        return out

    def mandatory_before(self, name: str) -> set[str]:
        return {a for a, b in self.edges if b == name and a in self.mandatory}

    def frame(self, spark: SparkSession) -> DataFrame:
        """activity, model_order, is_mandatory, is_start, is_end, required: mandatory direct predecessors."""
        order = self.order()
        rows = [(a, order[a], a in self.mandatory, a in self.starts, a in self.ends, sorted(self.mandatory_before(a))) for a in sorted(self.activities)]
        return spark.createDataFrame(rows, "activity string, model_order int, is_mandatory boolean, is_start boolean, is_end boolean, required array<string>")

    def name_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(sorted(self.names.items()), "raw string, mapped string")


#: Events that the systems write for each activity.
_EVENTS = {"OrderCreated": ("VA01", "VBAK_CREATE"), "DeliveryCreated": ("VL01N", "LIKP_CREATE"), "GoodsIssued": ("VL06G", "GOODS_ISSUE"), "InvoiceCreated": ("VF01", "VBRK_CREATE")}


def o2c_simple() -> Model:
    model = Model("o2c_simple")
    for name, kind in (("OrderCreated", "start"), ("DeliveryCreated", "step"), ("GoodsIssued", "step"), ("InvoiceCreated", "end")):
        model.activity(name, kind, _EVENTS[name])
    return model.sequence("OrderCreated", "DeliveryCreated", "GoodsIssued", "InvoiceCreated")


def o2c_detailed() -> Model:
    """The simple flow with changes, release, picking, packing, posting and payment as optional steps."""
    model = o2c_simple()
    model.name = "o2c_detailed"
    for name, events in (("OrderChanged", ("VA02", "VBAK_CHANGE")), ("OrderReleased", ("ORDER_RELEASE",)), ("PickingCompleted", ()), ("PackingCompleted", ()), ("InvoicePosted", ()), ("PaymentReceived", ())):
        model.activity(name, "optional", events)
    model.ends |= {"InvoicePosted", "PaymentReceived"}
    model.sequence("OrderCreated", "OrderChanged", "OrderReleased", "DeliveryCreated", "PickingCompleted", "PackingCompleted", "GoodsIssued", "InvoiceCreated", "InvoicePosted", "PaymentReceived")
    return model.sequence("OrderChanged", "DeliveryCreated").sequence("OrderCreated", "OrderReleased").sequence("PickingCompleted", "GoodsIssued").sequence("InvoiceCreated", "PaymentReceived")


@dataclass
class OrderedModel:
    name: str
    #: activity, required, allowed predecessors; the position is the place in the list, from 1
    steps: list[tuple[str, bool, tuple[str, ...]]]
    names: dict[str, str] = field(default_factory=dict)

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(a, i, required, list(allowed)) for i, (a, required, allowed) in enumerate(self.steps, 1)]
        return spark.createDataFrame(rows, "activity string, model_order int, is_required boolean, allowed array<string>")

    def name_frame(self, spark: SparkSession) -> DataFrame:
        """Names in any case; a name that leads to no activity of the model is left out, so such events are unexpected."""
        known = {a for a, _, _ in self.steps}
        names = {a: a for a in known} | {raw: a for raw, a in self.names.items() if a in known}
        return spark.createDataFrame(sorted({(raw.lower(), a) for raw, a in names.items()}), "raw string, mapped string")


def o2c_ordered() -> OrderedModel:
    steps = [("order_created", True, ()), ("delivery_created", True, ("order_created",)), ("goods_issued", True, ("delivery_created",)), ("invoice_created", True, ("goods_issued",))]
    names = {"C": "order_created", "J": "delivery_created", "R": "goods_issued", "M": "invoice_created", "OrderCreated": "order_created", "DeliveryCreated": "delivery_created", "GoodsIssued": "goods_issued", "InvoiceCreated": "invoice_created", "order": "order_created", "delivery": "delivery_created", "gi": "goods_issued", "invoice": "invoice_created", "billing": "invoice_created"}
    return OrderedModel("o2c_ordered", steps, names)


def _line(name: str, *steps: str, optional: tuple[str, ...] = ()) -> OrderedModel:
    return OrderedModel(name, [(s, s not in optional, steps[i - 1 : i]) for i, s in enumerate(steps)])


MODELS = {
    "o2c_simple": o2c_simple,
    "o2c_detailed": o2c_detailed,
    "o2c_ordered": o2c_ordered,
    "p2p_simple": lambda: _line("p2p_simple", "po_created", "goods_receipt", "invoice_receipt", "payment"),
    "p2p_detailed": lambda: _line("p2p_detailed", "pr_created", "po_created", "po_approved", "goods_receipt", "invoice_receipt", "invoice_cleared", "payment", optional=("pr_created", "po_approved", "invoice_cleared")),
    "fi_posting": lambda: _line("fi_posting", "document_parked", "document_approved", "document_posted", "document_cleared", optional=("document_parked", "document_approved", "document_cleared")),
    "fi_period_close": lambda: _line("fi_period_close", "accruals_posted", "depreciation_run", "revaluation", "allocation", "period_closed", optional=("revaluation", "allocation")),
    "co_allocation": lambda: _line("co_allocation", "costs_collected", "assessment", "distribution", "settlement", optional=("distribution",)),
}
