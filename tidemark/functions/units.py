"""Physical units: dimension exponents, scale and offset; conversions compile to column arithmetic."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Unit:
    """Exponents of mass, length, time, temperature; SI value = x * scale + offset (no offset for differences)."""

    symbol: str
    dims: tuple[int, int, int, int]
    scale: float = 1.0
    offset: float = 0.0
    delta: bool = False

    def __mul__(self, other: Unit) -> Unit:
        return Unit(f"{self.symbol} {other.symbol}", tuple(a + b for a, b in zip(self.dims, other.dims, strict=True)), self.scale * other.scale, 0.0, self.delta or other.delta)

    def __truediv__(self, other: Unit) -> Unit:
        return Unit(f"{self.symbol}/{other.symbol}", tuple(a - b for a, b in zip(self.dims, other.dims, strict=True)), self.scale / other.scale, 0.0, self.delta or other.delta)


_RPM = 2 * 3.141592653589793 / 60
#: The units of the process's quantities, differences apart from levels.
UNITS = {
    u.symbol: u
    for u in (
        Unit("", (0, 0, 0, 0)),
        Unit("1", (0, 0, 0, 0)),
        Unit("ratio", (0, 0, 0, 0)),
        Unit("rate", (0, 0, 0, 0)),
        Unit("count", (0, 0, 0, 0)),
        Unit("%", (0, 0, 0, 0), 0.01),
        Unit("Δ%", (0, 0, 0, 0), 0.01, delta=True),
        Unit("K", (0, 0, 0, 1)),
        Unit("°C", (0, 0, 0, 1), 1.0, 273.15),
        Unit("ΔK", (0, 0, 0, 1), delta=True),
        Unit("Δ°C", (0, 0, 0, 1), delta=True),
        Unit("rpm", (0, 0, -1, 0), _RPM),
        Unit("Δrpm", (0, 0, -1, 0), _RPM, delta=True),
        Unit("rad/s", (0, 0, -1, 0)),
        Unit("N·m", (1, 2, -2, 0)),
        Unit("ΔN·m", (1, 2, -2, 0), delta=True),
        Unit("lbf·ft", (1, 2, -2, 0), 1.3558179483314004),
        Unit("W", (1, 2, -3, 0)),
        Unit("kW", (1, 2, -3, 0), 1000.0),
        Unit("ΔW", (1, 2, -3, 0), delta=True),
        Unit("s", (0, 0, 1, 0)),
        Unit("min", (0, 0, 1, 0), 60.0),
        Unit("Δmin", (0, 0, 1, 0), 60.0, delta=True),
        Unit("h", (0, 0, 1, 0), 3600.0),
        Unit("min·N·m", (1, 2, -1, 0), 60.0),
        Unit("Δmin·N·m", (1, 2, -1, 0), 60.0, delta=True),
    )
}
#: Other spellings, in lower case.
ALIASES = {
    "k": "K", "kelvin": "K", "c": "°C", "degc": "°C", "deg_c": "°C", "°c": "°C", "celsius": "°C", "δk": "ΔK", "delta k": "ΔK", "delta degc": "Δ°C",
    "nm": "N·m", "n m": "N·m", "n*m": "N·m", "n.m": "N·m", "newton_metre": "N·m", "newton_meter": "N·m", "min n m": "min·N·m", "minnm": "min·N·m", "min*nm": "min·N·m", "min_nm": "min·N·m",
    "watt": "W", "watts": "W", "rev/min": "rpm", "r/min": "rpm", "rads": "rad/s", "rad_s": "rad/s", "minute": "min", "minutes": "min", "sec": "s", "seconds": "s",
    "-": "", "none": "", "unitless": "", "percent": "%", "pct": "%", "pp": "Δ%", "delta rpm": "Δrpm", "delta w": "ΔW", "delta min n m": "Δmin·N·m",
}


def unit(name: str) -> Unit:
    """By symbol or another spelling; a name that is neither is refused, not guessed."""
    u = UNITS.get(name.strip()) or UNITS.get(ALIASES.get(name.strip().lower(), name.strip().lower()))
    if u is None:
        raise ValueError(f"unknown unit: {name}")
    return u


def convert(x: Column | float, source: str, target: str) -> Column | float:
    """A column or a number in another unit; a level and a difference, or two dimensions, don't convert."""
    a, b = unit(source), unit(target)
    if a.dims != b.dims or a.delta != b.delta:
        raise ValueError(f"{source} can't be converted to {target}")
    if isinstance(x, Column):
        return (x * F.lit(a.scale) + F.lit(a.offset) - F.lit(b.offset)) / F.lit(b.scale)
    return (x * a.scale + a.offset - b.offset) / b.scale


def rendered(x: Column, digits: int = 4) -> Column:
    """A number as text: whole ones with thousands set off, others with so many significant digits, six places at most."""
    size = F.floor(F.log10(F.abs(x)))
    places = F.least(F.greatest(F.lit(digits - 1) - size, F.lit(0)), F.lit(6)).cast("int")
    cases = F.element_at(F.array(*[F.format_number(x, p) for p in range(7)]), F.coalesce(places, F.lit(0)) + 1)
    return F.when(x == F.floor(x), F.format_number(x, 0)).otherwise(cases)
