"""Normalisation of road attributes. Results are strings; what can't be read is "None"."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
MPH_TO_KMH = 1.609344
FOOT_TO_M = 0.3048
INCH_TO_M = 0.0254
MAX_LANES = 15
MAX_SPEED = 200
MAX_WIDTH = 30.0
MISSING = ("", "none", "None", "nan", "NaN")


def _text(value: Column) -> Column:
    text = F.trim(value.cast("string"))
    return F.when(~text.isin(*MISSING), text)


def _shown(value: Column, number: str) -> Column:
    return F.coalesce(value.cast(number).cast("string"), F.lit("None"))


def _capped(value: Column, most: float) -> Column:
    """At most ``most``; null stays null, which F.least alone would not keep."""
    return F.when(value.isNotNull(), F.least(value, F.lit(most)))


def _bound(value: Column, rule) -> Column:
    """rule(value) with the value worked out once, however often the rule mentions it."""
    return F.get(F.transform(F.array(value), rule), F.lit(0))


def lanes(value: Column) -> Column:
    """Whole lanes, at most 15."""
    return _shown(_capped(_text(value).try_cast("double").cast("long"), MAX_LANES), "int")


def maxspeed(value: Column, zones: Mapping[str, float] | None = None) -> Column:
    """km/h in the steps 0, 5, 7, 10, 15 and tens up to 200. ``zones`` maps implicit speed codes."""
    text = _text(value)
    if zones:
        table = F.create_map(*[F.lit(v) for kv in zones.items() for v in (kv[0], str(kv[1]))])
        text = F.coalesce(F.try_element_at(table, text), text)

    def step(speed: Column) -> Column:
        tens = F.least(F.bround(speed / 10.0) * 10.0, F.lit(float(MAX_SPEED)))
        least = F.when(speed <= 0, F.lit(0.0)).when(speed <= 5, F.lit(5.0)).when(speed <= 7, F.lit(7.0)).when(speed <= 10, F.lit(10.0)).when(speed <= 15, F.lit(15.0))
        return _shown(F.when(speed.isNotNull(), least.otherwise(tens)), "int")

    def number(t: Column) -> Column:
        plain = t.try_cast("double")  # most values are bare numbers, which need no pattern
        read = F.coalesce(plain, F.trim(F.regexp_replace(t, "km/h|mph", "")).try_cast("double"))
        return F.when(t.contains("mph"), read * MPH_TO_KMH).otherwise(read)

    return _bound(F.when(~text.isin("signals", "variable"), text), lambda t: _bound(number(t), step))


def width(value: Column) -> Column:
    """Metres in halves, at most 30."""
    text = _text(value)
    number = F.trim(F.regexp_replace(text, "meter|m|'|ft", "")).try_cast("double")
    metres = (
        F.when(text.contains("'"), number * INCH_TO_M).when(text.contains("ft"), number * FOOT_TO_M).otherwise(number)
    )
    return _shown(_capped(F.bround(metres * 2.0) / 2.0, MAX_WIDTH), "double")


NORMALISERS = {"lanes": lanes, "maxspeed": maxspeed, "width": width}


def normalise(column: str, value: Column, zones: Mapping[str, float] | None = None) -> Column:
    """The rule of a column; other columns only have missing values replaced."""
    if column == "maxspeed":
        return maxspeed(value, zones)
    rule = NORMALISERS.get(column)
    return rule(value) if rule else F.coalesce(_text(value), F.lit("None"))
