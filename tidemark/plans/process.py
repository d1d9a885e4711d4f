"""A process as data: base channels, derived quantities, failure modes. Everything compiles to DataFrame columns."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Term:
    """metric op limit. A limit is a number, a (low, high) pair for between, or a dict by variant."""

    metric: str
    op: str
    limit: float | tuple[float, float] | dict[str, float]

    def bound(self, variant: Column) -> Column:
        if isinstance(self.limit, dict):
            pairs = [x for k, v in self.limit.items() for x in (F.lit(k), F.lit(float(v)))]
            return F.element_at(F.create_map(*pairs), variant)
        return F.lit(float(self.limit))

    def fires(self, variant: Column) -> Column:
        """Whether the term holds; a missing metric never fires."""
        x = F.col(self.metric)
        if self.op == "between":
            hit = x.between(*map(float, self.limit))
        else:
            hit = {"<": x.__lt__, "<=": x.__le__, ">": x.__gt__, ">=": x.__ge__, "==": x.__eq__}[self.op](self.bound(variant))
        return F.coalesce(hit, F.lit(False))

    def margin(self, variant: Column) -> Column:
        """Signed distance to the boundary: negative inside the failing side."""
        x = F.col(self.metric)
        if self.op == "between":
            lo, hi = map(float, self.limit)
            return F.greatest(F.lit(lo) - x, x - F.lit(hi))
        return x - self.bound(variant) if self.op in ("<", "<=") else self.bound(variant) - x

    def scale(self, variant: Column) -> Column:
        return F.lit(float(self.limit[0])) if self.op == "between" else self.bound(variant)


@dataclass(frozen=True)
class Mode:
    """all_of fires when every term does, any_of when one does. Stochastic modes are no certain failure."""

    name: str
    terms: tuple[Term, ...] = ()
    how: str = "all_of"
    stochastic: bool = False

    def fires(self, variant: Column) -> Column:
        if not self.terms:
            return F.lit(False)
        return reduce(lambda a, b: a & b if self.how == "all_of" else a | b, [t.fires(variant) for t in self.terms])

    def distance(self, variant: Column) -> Column:
        """Relative distance: the farthest term of a conjunction, the nearest of a disjunction."""
        d = [t.margin(variant) / t.scale(variant) for t in self.terms]
        return d[0] if len(d) == 1 else (F.greatest if self.how == "all_of" else F.least)(*d)


#: Fixed value: rounding steps of the larger operand within which a margin's sign isn't settled by the arithmetic.
DEGENERATE_STEPS = 8
#: Fixed value: the distance between 1 and the next double.
EPSILON = 2.0**-52


def degenerate(margin: Column, *operands: Column) -> Column:
    """Whether a margin is so near zero that rounding, not the process, decides its sign."""
    size = F.greatest(*[F.abs(x) for x in operands], F.lit(0.0))
    return F.abs(margin) <= DEGENERATE_STEPS * EPSILON * F.when(size > 0, size).otherwise(1.0)


#: Fixed value: radians a second for one revolution a minute, 2 pi / 60.
RAD_PER_RPM = 2 * 3.141592653589793 / 60


@dataclass(frozen=True)
class Process:
    variant: str = "product_type"
    base: tuple[str, ...] = ("air_temperature_k", "process_temperature_k", "rotational_speed_rpm", "torque_nm", "tool_wear_min")
    floors: dict[str, float] = field(default_factory=lambda: {"torque_nm": 0.0, "tool_wear_min": 0.0, "rotational_speed_rpm": 1.0})
    modes: tuple[Mode, ...] = ()
    wear_rate: dict[str, float] = field(default_factory=dict)

    def mode(self, name: str) -> Mode:
        return next(m for m in self.modes if m.name == name)

    def limit(self, mode: str, metric: str, op: str | None = None) -> float | tuple[float, float] | dict[str, float]:
        """The limit of a mode's term, by metric and, where it has several, by operator."""
        return next(t.limit for t in self.mode(mode).terms if t.metric == metric and op in (None, t.op))

    def regimes(self) -> list[tuple[str, str]]:
        """(mode, how it can be known): exact by its boundary, statistical in a window or by chance, irreducible without any condition."""
        kind = lambda m: "irreducible" if not m.terms else "statistical" if m.stochastic or any(t.op == "between" for t in m.terms) else "exact"
        return [(m.name, kind(m)) for m in self.modes]

    def by_variant(self, values: dict[str, float]) -> Column:
        return F.element_at(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(float(v)))]), F.col(self.variant))

    def physics(self, df: DataFrame) -> DataFrame:
        """Derived quantities from the base channels."""
        return df.withColumns({
            "temp_delta_k": F.col("process_temperature_k") - F.col("air_temperature_k"),
            "power_w": F.col("torque_nm") * F.col("rotational_speed_rpm") * F.lit(RAD_PER_RPM),
            "overstrain_min_nm": F.col("tool_wear_min") * F.col("torque_nm"),
        })

    def judged(self, df: DataFrame) -> DataFrame:
        """Margins, rule flags and distances of every mode, and the worst distance of the certain ones."""
        v = F.col(self.variant)
        out = {}
        for m in self.modes:
            low = m.name.lower()
            for i, t in enumerate(m.terms):
                out[f"{low}_margin_{i}" if len(m.terms) > 1 else f"{low}_margin"] = t.margin(v)
            out[f"{low}_rule"] = m.fires(v)
            if m.terms and not m.stochastic:
                out[f"{low}_distance"] = m.distance(v)
        df = df.withColumns(out)
        certain = [F.col(f"{m.name.lower()}_distance") for m in self.modes if m.terms and not m.stochastic]
        return df.withColumn("worst_margin", F.least(*certain) if len(certain) > 1 else certain[0])

    def perturbed(self, df: DataFrame, **shift: float) -> DataFrame:
        """Base channels shifted, held at their floors, and everything derived from them computed again."""
        if bad := [k for k in shift if k not in self.base]:
            raise ValueError(f"not a base channel: {bad[0]}")
        moved = {k: F.greatest(F.col(k) + F.lit(float(d)), F.lit(self.floors[k])) if k in self.floors else F.col(k) + F.lit(float(d)) for k, d in shift.items()}
        return self.judged(self.physics(df.withColumns(moved)))


#: The milling process's failure limits, wear rates and tool-wear window.
MILLING = Process(
    modes=(
        Mode("HDF", (Term("temp_delta_k", "<", 8.6), Term("rotational_speed_rpm", "<", 1380.0))),
        Mode("PWF", (Term("power_w", "<", 3500.0), Term("power_w", ">", 9000.0)), "any_of"),
        Mode("OSF", (Term("overstrain_min_nm", ">", {"L": 11000.0, "M": 12000.0, "H": 13000.0}),)),
        Mode("TWF", (Term("tool_wear_min", "between", (200.0, 240.0)),), stochastic=True),
        Mode("RNF", stochastic=True),
    ),
    wear_rate={"L": 2.0, "M": 3.0, "H": 5.0},
)


def from_yaml(text: str) -> Process:
    """A process from YAML: variant, wear_rate, and modes of {name, how, stochastic, terms: [{metric, op, limit}]}."""
    import yaml

    d = yaml.safe_load(text)

    def term(t: dict) -> Term:
        limit = t["limit"]
        return Term(t["metric"], t["op"], tuple(limit) if isinstance(limit, list) else limit)

    modes = tuple(Mode(m["name"], tuple(term(t) for t in m.get("terms", ())), m.get("how", "all_of"), bool(m.get("stochastic", False))) for m in d["modes"])
    keep = {k: d[k] for k in ("variant", "floors", "wear_rate") if k in d}
    return Process(modes=modes, **keep, **({"base": tuple(d["base"])} if "base" in d else {}))
