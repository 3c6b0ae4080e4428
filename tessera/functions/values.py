"""Numbers, units and dates as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Grams a tonne for one unit of each grade unit; kilograms for one unit of each weight.
GRADE_PPM = {"g/t": 1.0, "ppm": 1.0, "ppb": 0.001, "%": 10000.0, "oz/t": 34.2857, "kg/t": 1000.0}
WEIGHT_KG = {"kg": 1.0, "t": 1000.0, "lb": 0.45359237, "oz": 0.0311034768}


def converted(value: Column, unit: Column, factors: dict[str, float]) -> Column:
    """value times the factor of its unit, null for units that aren't known."""
    table = F.create_map(*[F.lit(x) for pair in factors.items() for x in pair])
    return value * F.try_element_at(table, unit)


def parsed_number(x: Column) -> Column:
    """'1,234.5' or '.95' as a double; null where commas don't part thousands."""
    fine = x.rlike(r"^[+-]?([0-9]{1,3}(,[0-9]{3})*|[0-9]*)(\.[0-9]+)?$") & x.rlike("[0-9]")
    return F.when(fine, F.regexp_replace(x, ",", "").try_cast("double"))


def significant(x: Column, digits: int) -> Column:
    """x to so many significant figures, half away from zero; zero and null stay."""
    cut = F.floor(F.log10(F.abs(x))) - (digits - 1)
    scale = F.pow(F.lit(10.0), F.abs(cut))  # a whole power: tenths and hundredths aren't exact and move figures off a half
    return F.when(x == 0, F.lit(0.0)).when(cut > 0, F.round(x / scale) * scale).otherwise(F.round(x * scale) / scale)


def close(a: Column, b: Column, share: float, least: float = 0.0) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(least), share * F.greatest(F.abs(a), F.abs(b)))


def add_months(day: Column, n: int) -> Column:
    """Calendar months later; the day is cut to the month's last."""
    return F.add_months(day, n)


def period_end(year: Column, quarter: Column) -> Column:
    return F.last_day(F.make_date(year, quarter * 3, F.lit(1)))


def lenient_date(x: Column) -> Column:
    """A date from the first format that fits; null if none. A format is tried on texts of its outline only, as a miss is dear."""
    number = r"[+-]?\d+"
    formats = {"yyyy-MM-dd": f"{number}-{number}-{number}", "yyyy/MM/dd": f"{number}/{number}/{number}", "MMMM d, yyyy": rf"\p{{L}}+ {number}, {number}", "d MMMM yyyy": rf"{number} \p{{L}}+ {number}", "MM/dd/yyyy": rf"\d\d/{number}/{number}"}
    return F.coalesce(*[F.when(x.rlike(f"^{outline}$"), F.try_to_timestamp(x, F.lit(f))).cast("date") for f, outline in formats.items()])
