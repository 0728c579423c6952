"""Measurement standardisers as native Column expressions.

Every function maps a string Column to an ``array<double>`` Column:
null when nothing was recognised, otherwise the recognised values in
text order. No Python runs per row: each is a ``transform``/``filter``
over the ``split`` parts (evaluated in the JVM; Spark interprets array
lambdas, it does not generate code for them).

Per part the rules are: lower-case the field, split it (C1), drop
U+0020 blanks only, take the first regex match of the part, skip the
part when there is no match or the number does not parse, convert by
unit. Digits are ASCII ``[0-9]`` (a documented difference from Python's
Unicode ``\\d``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _apply(value: Column, op: str, operand: float) -> Column:
    return value * F.lit(operand) if op == "*" else value / F.lit(operand)


def bound(value: Column, f) -> Column:
    """``f`` of a value that is evaluated once, however often ``f`` names it
    (a lambda's argument is a value, not an expression)."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _nonempty(arr: Column) -> Column:
    """Empty result -> null (C7: no values is a missing measurement)."""
    return bound(arr, lambda a: F.when(F.size(a) > 0, a))


def split_values(text: Column | str, pattern: str = K.SPLIT_PATTERN) -> Column:
    """Lower-case and split on comma or the word ``and`` (parts keep blanks).
    A text that holds no mark of the pattern is its own only part: the pattern,
    which Spark compiles anew for each text, is not needed for it."""
    marks = K.SPLIT_MARKS.get(pattern)
    if marks is None:
        return F.split(F.lower(_c(text)), pattern, -1)
    return bound(F.lower(_c(text)), lambda t: F.when(~_any_contains(t, marks), F.array(t)).otherwise(F.split(t, pattern, -1)))


#: Between the captures of a part; translated away in the part itself.
_MARK = "\u0001"


def _strip_blanks(part: Column) -> Column:
    return F.replace(F.replace(part, F.lit(" "), F.lit("")), F.lit(_MARK), F.lit("\u0002"))


def _captures(part: Column, pattern: str, groups: int) -> Column:
    """The groups of the first match as an array, by one run of the regex;
    without a match the array has one element."""
    marked = _MARK.join(f"${g}" for g in range(1, groups + 1))
    return F.split(F.regexp_replace(part, r"(?s)^.*?" + pattern + ".*$", marked), _MARK, -1)


def _standardise(text: Column | str, pattern: str, *steps) -> Column:
    """Split, then one pass per step over the parts: the first runs the regex,
    the last gives a number or null. Each pass evaluates what it computes
    once per part; null parts in between are no match."""
    parts = split_values(text, pattern)
    for step in steps:
        parts = F.transform(parts, step)
    return _nonempty(F.filter(parts, lambda v: v.isNotNull()))


def _any_contains(text: Column, marks: list[str]) -> Column:
    cond = None
    for mark in marks:
        hit = text.contains(mark)
        cond = hit if cond is None else (cond | hit)
    return cond


def _convert(value: Column, unit: Column, units, contains: bool) -> Column:
    out = None
    for unit_txt, op, operand in units:
        cond = unit.contains(unit_txt) if contains else (unit == unit_txt)
        v = _apply(value, op, operand)
        out = F.when(cond, v) if out is None else out.when(cond, v)
    return out


def std_pressure(text: Column | str) -> Column:
    """Pressure text -> pascal values."""

    def prepare(part: Column) -> Column:
        p = F.replace(_strip_blanks(part), F.lit("×"), F.lit("x"))
        return bound(p, lambda p: F.struct(_captures(p, K.PRESSURE_PATTERN, 3).alias("m"), _any_contains(p, K.PRESSURE_EXPONENT_MARKS).alias("scaled")))

    def numbers(s: Column) -> Column:
        exp_txt = s["m"][1]
        exponent = F.when(exp_txt == "", F.lit(0.0)).otherwise(
            F.coalesce(
                exp_txt.try_cast("double"),
                F.regexp_extract(exp_txt, r"(-?[0-9]+)", 1).try_cast("double"),
                F.lit(0.0),
            )
        )
        power = F.when(s["scaled"], F.pow(F.lit(10.0), exponent)).otherwise(F.lit(1.0))
        return F.when(F.size(s["m"]) == 3, F.struct(s["m"][0].try_cast("double").alias("base"), power.alias("power"), s["m"][2].alias("u")))

    def value(s: Column) -> Column:
        # The original raises on 10**exponent overflow; that value is dropped here.
        ok = s["base"].isNotNull() & (s["power"] != float("inf"))
        return F.when(ok, bound(s["base"] * s["power"], lambda raw: _convert(raw, s["u"], K.PRESSURE_UNITS, True)))

    return _standardise(text, K.SPLIT_PATTERN, prepare, numbers, value)


def std_temperature(text: Column | str) -> Column:
    """Temperature text -> degrees Celsius values."""

    def prepare(part: Column) -> Column:
        def both(p: Column) -> Column:
            return F.struct(_any_contains(p, K.ROOM_TEMPERATURE_MARKS).alias("room"), _captures(F.replace(p, F.lit("°"), F.lit("")), K.TEMPERATURE_PATTERN, 2).alias("m"))

        return bound(_strip_blanks(part), both)

    def value(s: Column) -> Column:
        converted = s["m"][0].try_cast("double") - F.when(s["m"][1] == "k", F.lit(K.KELVIN_OFFSET)).otherwise(F.lit(0.0))
        return F.when(s["room"], F.lit(K.ROOM_TEMPERATURE_C)).when(F.size(s["m"]) == 2, converted)

    return _standardise(text, K.SPLIT_PATTERN, prepare, value)


def _number_unit(pattern: str, pre):
    return lambda part: _captures(pre(_strip_blanks(part)), pattern, 2)


def _number_unit_value(units):
    def value(m: Column) -> Column:
        return F.when(F.size(m) == 2, bound(m[0].try_cast("double"), lambda val: _convert(val, m[1], units, False)))

    return value


def std_thickness(text: Column | str, angstrom: bool = False) -> Column:
    """C4: thickness text -> nanometre values.

    The original replaces 'Å' after lower-casing, which can never hit, so
    Ångström values are lost; ``angstrom=True`` maps the lower-case 'å'.
    """

    def pre(p: Column) -> Column:
        p = F.replace(p, F.lit("Å"), F.lit("a"))
        return F.replace(p, F.lit("å"), F.lit("a")) if angstrom else p

    return _standardise(text, K.SPLIT_PATTERN, _number_unit(K.THICKNESS_PATTERN, pre),
                        _number_unit_value(K.THICKNESS_UNITS))


def std_power(text: Column | str) -> Column:
    """Power text -> watt values (``mw`` is read as milliwatt)."""
    return _standardise(text, K.POWER_SPLIT_PATTERN, _number_unit(K.POWER_PATTERN, lambda p: p),
                        _number_unit_value(K.POWER_UNITS))


def std_gas(text: Column | str) -> Column:
    """Gas text -> 'Ar/O2/N2/H2' subset in that order, 'Other', or 'Unknown'."""
    t = F.lower(_c(text))
    labels = []
    for label, terms in K.GAS_TERMS:
        cond = None
        for term in terms:
            hit = t.contains(term)
            cond = hit if cond is None else (cond | hit)
        labels.append(F.when(cond, F.lit(label)))
    # concat_ws skips nulls, so absent gases leave no separator behind
    joined = F.concat_ws("/", *labels)
    return F.when(_c(text).isNull(), F.lit(K.UNKNOWN_GAS)).when(joined == "", F.lit(K.OTHER_GAS)).otherwise(joined)


def scalar_of(values: Column | str) -> Column:
    """C7 scalar view: the value when exactly one was parsed, else null.

    This is what a reader of the CSV hand-off sees: list cells do not
    survive the text round trip and become null.
    """
    v = _c(values)
    return F.when(F.size(v) == 1, F.try_element_at(v, F.lit(1)))


def n_values(values: Column | str) -> Column:
    """Number of parsed values, 0 for none."""
    v = _c(values)
    return F.when(v.isNull(), F.lit(0)).otherwise(F.size(v))
