"""The vocabulary that plans may use: metrics and dimensions with columns and units, kept as data."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Metric:
    name: str
    column: str
    unit: str
    #: The smallest value that is physically possible.
    least: float | None = None


@dataclass(frozen=True)
class Catalog:
    metrics: dict[str, Metric]
    dimensions: dict[str, str]
    outcome: str
    key: str
    time: str | None = None

    def column(self, name: str) -> str:
        """Of a metric or dimension; a name outside the vocabulary is refused."""
        if name in self.metrics:
            return self.metrics[name].column
        if name in self.dimensions:
            return self.dimensions[name]
        raise ValueError(f"unknown quantity: {name}")


def _metrics(*rows: tuple) -> dict[str, Metric]:
    return {r[0]: Metric(*r) for r in rows}


MILLING = Catalog(
    _metrics(
        ("air_temp_k", "air_temperature_k", "K", 0.0),
        ("process_temp_k", "process_temperature_k", "K", 0.0),
        ("temp_delta_k", "temp_delta_k", "delta K"),
        ("rotational_speed_rpm", "rotational_speed_rpm", "rpm", 0.0),
        ("torque_nm", "torque_nm", "N m", 0.0),
        ("tool_wear_min", "tool_wear_min", "min", 0.0),
        ("power_w", "power_w", "W", 0.0),
        ("overstrain_min_nm", "overstrain_min_nm", "min N m", 0.0),
        ("temp_delta_margin_k", "hdf_margin_0", "delta K"),
        ("speed_margin_rpm", "hdf_margin_1", "delta rpm"),
        ("power_low_margin_w", "pwf_margin_0", "delta W"),
        ("power_high_margin_w", "pwf_margin_1", "delta W"),
        ("overstrain_margin_min_nm", "osf_margin", "delta min N m"),
        ("failure", "machine_failure", "rate", 0.0),
    ),
    {"udi": "udi", "product_type": "product_type", "machine_id": "machine_id", "shift": "shift"},
    outcome="machine_failure",
    key="udi",
    time="ts",
)

#: The same operators over order lines: another process is another catalog.
SALES = Catalog(
    _metrics(("quantity", "l_quantity", "1"), ("price", "l_extendedprice", "1"), ("discount", "l_discount", "1"), ("tax", "l_tax", "1"), ("revenue", "revenue", "1")),
    {"returnflag": "l_returnflag", "linestatus": "l_linestatus", "segment": "c_mktsegment", "nation": "n_name", "region": "r_name"},
    outcome="returned",
    key="l_orderkey",
)
