"""Analysis plans: a closed, validated record of what to compute, compiled to columns."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.units import convert
from .catalog import Catalog

#: The filter operators and limits of a plan.
FILTER_OPS = ("eq", "ne", "lt", "le", "gt", "ge", "between", "in", "is_null")
MAX_DIMENSIONS, MAX_GROUPS, MAX_ROWS = 2, 200, 500


class PlanError(ValueError):
    """A plan outside the vocabulary, or one whose result would be too wide to report."""


@dataclass(frozen=True)
class Filter:
    """field op value; the value may be told in another unit than the field's."""

    field: str
    op: str
    value: Any = None
    unit: str | None = None

    def __post_init__(self):
        if self.op not in FILTER_OPS:
            raise PlanError(f"unknown filter operator: {self.op}")

    def bound(self, cat: Catalog) -> Any:
        """The value in the field's own unit."""
        if not self.unit:
            return self.value
        if self.field not in cat.metrics:
            raise PlanError(f"{self.field} has no unit")
        own = cat.metrics[self.field].unit
        to = lambda v: convert(float(v), self.unit, own) if isinstance(v, int | float) and not isinstance(v, bool) else v
        try:
            return type(self.value)(map(to, self.value)) if isinstance(self.value, list | tuple) else to(self.value)
        except ValueError as e:
            raise PlanError(f"{self.field}: {e}") from None

    def possible(self, cat: Catalog) -> None:
        """Refuses a value that the quantity can't have, such as a torque below zero or an absolute temperature below its zero."""
        least = cat.metrics[self.field].least if self.field in cat.metrics else None
        if least is None or self.op == "is_null":
            return
        v = self.bound(cat)
        for x in v if isinstance(v, list | tuple) else (v,):
            if isinstance(x, int | float) and x < least:
                raise PlanError(f"{self.field} is never below {least:g}: {x:g}")

    def column(self, cat: Catalog) -> Column:
        x = F.col(cat.column(self.field))
        v = self.bound(cat)
        match self.op:
            case "eq":
                return x == v
            case "ne":
                return x != v
            case "lt":
                return x < v
            case "le":
                return x <= v
            case "gt":
                return x > v
            case "ge":
                return x >= v
            case "between":
                return x.between(*v)
            case "in":
                return x.isin(list(v))
            case "is_null":
                return x.isNull() if v in (None, True) else x.isNotNull()
        raise AssertionError(self.op)


def all_of(filters: list[Filter] | tuple[Filter, ...], cat: Catalog) -> Column:
    return reduce(lambda a, b: a & b, [f.column(cat) for f in filters], F.lit(True))


@dataclass(frozen=True)
class Cohort:
    name: str
    filters: tuple[Filter, ...] = ()

    def __post_init__(self):
        if not re.fullmatch(r"[a-z][a-z0-9_]{0,31}", self.name):
            raise PlanError(f"bad cohort name: {self.name}")


@dataclass(frozen=True)
class Binning:
    """quantile or width with a number of bins in [2, 50], or explicit ascending edges."""

    how: str
    bins: int | tuple[float, ...]

    def __post_init__(self):
        if self.how == "explicit":
            e = list(self.bins)
            if len(e) < 2 or e != sorted(set(e)):
                raise PlanError("edges must ascend")
        elif self.how not in ("quantile", "width") or not 2 <= self.bins <= 50:
            raise PlanError(f"bad binning: {self.how} {self.bins}")


@dataclass(frozen=True)
class Plan:
    op: str
    metrics: tuple[str, ...] = ()
    filters: tuple[Filter, ...] = ()
    cohorts: tuple[Cohort, ...] = ()
    group_by: tuple[str, ...] = ()
    axis: str | None = None
    binning: Binning | None = None
    grain: str | None = None
    order: str = "key"
    limit: int = 50
    confidence: float = 0.95
    params: dict = field(default_factory=dict)

    def validated(self, cat: Catalog) -> Plan:
        """The one choke point: every name is in the vocabulary and every width within its limit."""
        for name in (*self.metrics, *self.group_by, *((self.axis,) if self.axis else ())):
            cat.column(name)
        for f in (*self.filters, *(f for c in self.cohorts for f in c.filters)):
            cat.column(f.field)
            f.possible(cat)
        if len(self.group_by) > MAX_DIMENSIONS:
            raise PlanError(f"more than {MAX_DIMENSIONS} dimensions")
        if cat.key in [cat.column(g) for g in self.group_by]:
            raise PlanError("a key is no dimension")
        if not 0 < self.limit <= MAX_ROWS:
            raise PlanError(f"limit is outside 1..{MAX_ROWS}")
        if not 0.5 <= self.confidence < 1:
            raise PlanError("confidence is outside [0.5, 1)")
        if self.grain not in (None, "hour", "day", "shift"):
            raise PlanError(f"unknown time grain: {self.grain}")
        return self


def plan_from_dict(d: dict, cat: Catalog) -> Plan:
    flt = lambda fs: tuple(Filter(f["field"], f["op"], tuple(f["value"]) if isinstance(f.get("value"), list) else f.get("value"), f.get("unit")) for f in fs or ())
    binning = d.get("bin")
    return Plan(
        op=d["op"], metrics=tuple(d.get("metrics", ())), filters=flt(d.get("filters")),
        cohorts=tuple(Cohort(c["name"], flt(c.get("filters"))) for c in d.get("cohorts", ())),
        group_by=tuple(d.get("group_by", ())), axis=d.get("axis"),
        binning=Binning(binning["how"], tuple(binning["bins"]) if isinstance(binning["bins"], list) else binning["bins"]) if binning else None,
        grain=d.get("grain"), order=d.get("order", "key"), limit=d.get("limit", 50), confidence=d.get("confidence", 0.95), params=d.get("params", {}),
    ).validated(cat)
