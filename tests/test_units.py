"""Golden vectors of the standardisers (hand-derived from the original rules)."""
import math

import pytest

from column_values import values
from paramforge.functions import units as U


def close(a, b):
    if a is None or b is None:
        return a is None and b is None
    if isinstance(b, (int, float)):
        b = [float(b)]
    return len(a) == len(b) and all(math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-15) for x, y in zip(a, b))


PRESSURE = [
    ("5 mTorr", 0.66661), ("0.5 Pa", 0.5), ("2 x 10^-6 Torr", 2.66644e-4), ("3×10-4 Pa", 3e-4),
    ("1e-3 mbar", 0.1), ("2 Pa, 5 mTorr", [2.0, 0.66661]), ("0.1 and 0.5 Pa", 0.5), ("1 MPa", 1.0),
    ("2 hPa", 2.0), ("10^-3 Torr", 1333.22), ("1-5 mTorr", 0.133322), ("1-5 mTorr pressure", 1.33322e-6),
    ("5 × 10−3 mbar", None), ("1,000 Pa", 0.0), ("1.2.3 Pa", None), ("1 atm", None), (None, None),
    ("5x10^400 Pa", None),
]
TEMPERATURE = [
    ("300 K", 26.85), ("RT", 25.0), ("room temperature", 25.0), ("-196 °C", -196.0), ("RT and 300 °C", [25.0, 300.0]),
    ("25-400 °C", 25.0), ("200–300 °C", 300.0), ("200, 300 and 400 °C", 400.0), ("quartz heated to 400 °C", 25.0),
    ("100 °F", None), ("400℃", None),
]
THICKNESS = [
    ("200 nm", 200.0), ("1.5 um", 1500.0), ("1.5 μm", 1500.0), ("500 A", 50.0), ("2 mm", 2000000.0),
    ("100nm, 200nm", [100.0, 200.0]), ("100-200 nm", 100.0), ("1.5 µm", None), ("500 Å", None),
    ("300 approx", 30.0), ("2 micron", None),
]
POWER = [
    ("100 W", 100.0), ("0.5 kW", 500.0), ("50 mW", 0.05), ("100 W; 200 W", [100.0, 200.0]), ("100-200 W", 100.0),
    ("2 W/cm2", 2.0), ("1,000 W", 0.0), ("100, 150 and 200 W", 200.0),
]
GAS = [("Ar + O2 (4:1)", "Ar/O2"), ("CO2", "O2"), ("carbon", "Ar"), ("Krypton", "Other"),
       ("not specified", "Other"), (None, "Unknown"), ("Argon and nitrogen", "Ar/N2"), ("H2/N2", "N2/H2")]


@pytest.mark.parametrize("fn,cases", [(U.std_pressure, PRESSURE), (U.std_temperature, TEMPERATURE),
                                      (U.std_thickness, THICKNESS), (U.std_power, POWER)])
def test_measurement_goldens(spark, fn, cases):
    got = values(spark, fn, [c[0] for c in cases])
    for (text, want), g in zip(cases, got):
        assert close(g, want), (text, g, want)


def test_gas_goldens(spark):
    got = values(spark, U.std_gas, [c[0] for c in GAS])
    assert got == [c[1] for c in GAS]


def test_angstrom_option(spark):
    got = values(spark, lambda c: U.std_thickness(c, angstrom=True), ["500 Å"])
    assert close(got[0], 50.0)


def test_scalar_view_and_counts(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("100 W",), ("1 W, 2 W",), (None,)], "s string")
    rows = df.select(U.scalar_of(U.std_power("s")).alias("x"), U.n_values(U.std_power("s")).alias("n")).collect()
    assert [(r.x, r.n) for r in rows] == [(100.0, 1), (None, 2), (None, 0)]
    # property: never more values than parts
    parts = df.select(F.size(U.split_values("s", ",|\\band\\b|;")).alias("p"), U.n_values(U.std_power("s")).alias("n"))
    assert all(r.n <= (r.p or 0) for r in parts.collect())


def test_watts_and_kilowatts_agree(spark):
    got = values(spark, U.std_power, [f"{x} W" for x in (100, 250, 1500)] + [f"{x / 1000} kW" for x in (100, 250, 1500)])
    assert all(close(a, b) for a, b in zip(got[:3], got[3:]))
