"""Reporting periods, cited dates and event states as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_KINDS = {"quarter": r"^Q[1-4] \d{4}$", "half": r"^H[12] \d{4}$", "nine months": r"^9M \d{4}$", "year": r"^FY \d{4}$", "month": r"^\d{4}-\d{2}$"}


def kind_of(period: Column) -> Column:
    """quarter, half, nine months, year or month; null for anything else."""
    return F.coalesce(*[F.when(period.rlike(p), name) for name, p in _KINDS.items()])


def end_of(period: Column) -> Column:
    """Last day of a period; null for anything else."""
    year = F.regexp_extract(period, r"(\d{4})", 1).try_cast("int")
    number = F.regexp_extract(period, r"^[QH](\d)", 1).try_cast("int")
    kind = kind_of(period)
    month = F.when(kind == "quarter", number * 3).when(kind == "half", number * 6).when(kind == "nine months", 9).when(kind == "year", 12).when(kind == "month", F.regexp_extract(period, r"-(\d{2})$", 1).try_cast("int"))
    return F.last_day(F.make_date(year, F.when(month.between(1, 12), month), F.lit(1)))


def stale(period: Column, day: Column) -> Column:
    """A year's figure is stale 15 months after its end, a shorter one's 7."""
    return end_of(period) < F.when(kind_of(period) == "year", F.add_months(day, -15)).otherwise(F.add_months(day, -7))


#: Words of headlines that report, and of those that look ahead.
REPORTED = ("results", "production", "produced", "produces", "sales", "earnings", "financial", "financials", "operating", "operational")
PLANNED = ("guidance", "outlook", "forecast", "target", "targets", "budget", "plan", "plans", "planned", "expects", "expected", "expansion", "will")
_NUMBERS = {"first": "1", "1st": "1", "second": "2", "2nd": "2", "third": "3", "3rd": "3", "fourth": "4", "4th": "4"}
#: Ways to name a period: pattern, and the period of its groups.
_NAMED = (
    (r"(?i)\b([QH][1-4])[\s-]+(?:(?:of|fiscal)\s+)*(\d{4})\b", lambda a, b: F.concat_ws(" ", F.upper(a), b)),
    (rf"(?i)\b(({'|'.join(_NUMBERS)})[\s-]+(?:quarter|half))[\s-]+(?:(?:of|the|fiscal|year)\s+)*(\d{{4}})\b", None),
    (r"(?i)\b((?:fy|fiscal|annual|full[\s-]year|year[\s-]end(?:ed)?)\b)\D{0,20}(\d{4})\b", lambda a, b: F.concat_ws(" ", F.lit("FY"), b)),
)


def periods_named(headline: Column) -> Column:
    """Periods that a headline names, as "Q1 2024", "H2 2024" or "FY 2024"."""

    def numbered(x: Column, pattern: str) -> Column:
        number = F.try_element_at(F.create_map(*[F.lit(v) for pair in _NUMBERS.items() for v in pair]), F.lower(F.regexp_extract(x, pattern, 2)))
        return F.concat(F.when(F.lower(x).contains("quarter"), "Q").otherwise("H"), number, F.lit(" "), F.regexp_extract(x, pattern, 3))

    def of(pattern: str, period) -> Column:
        found = F.regexp_extract_all(headline, F.lit(pattern), F.lit(0))
        if period is None:
            return F.transform(found, lambda x: numbered(x, pattern))
        return F.transform(found, lambda x: period(F.regexp_extract(x, pattern, 1), F.regexp_extract(x, pattern, 2)))

    return F.concat(*[of(*way) for way in _NAMED])


def fiscal_named(period: Column, headline: Column, day: Column) -> Column:
    """Whether a headline reports on this calendar period before it is over, by eleven months at most: then the company's fiscal year
    isn't the calendar's. Headlines that look ahead don't count."""
    words = F.split(F.lower(headline), "[^a-z]+")
    has = lambda known: F.arrays_overlap(words, F.array(*[F.lit(w) for w in known]))
    ahead = F.months_between(end_of(period), F.last_day(day))
    fits = (end_of(period) > day) & (ahead <= 11) & has(REPORTED) & ~has(PLANNED) & F.array_contains(periods_named(headline), period)
    return F.coalesce(fits, F.lit(False))


def day_gap(a: Column, b: Column) -> Column:
    """Days between two dates; a million where one is missing."""
    return F.coalesce(F.abs(F.datediff(a, b)), F.lit(1_000_000))


def cited_before(cited: Column, day: Column) -> Column:
    """Cited dates; those more than three days after the release are of the year before, 29 February excepted."""
    leap = lambda x: (F.month(x) == 2) & (F.dayofmonth(x) == 29)
    return F.transform(cited, lambda x: F.when((F.datediff(x, day) > 3) & ~leap(x), F.add_months(x, -12)).otherwise(x))


#: What a text claims of an event, strongest first, and its status if the event lies before the text's day, on it, after it, or has no
#: date. The last claim is that of a text without any.
STATUS = {
    "cancelled": ("cancelled",) * 4,
    "postponed": ("postponed",) * 4,
    "held": ("completed", "completed", "scheduled", "completed"),
    "done": ("completed", "completed", "scheduled", "completed"),
    "effective": ("completed", "scheduled", "scheduled", "proposed"),
    "proposed": ("completed", "scheduled", "proposed", "proposed"),
    "": ("completed", "scheduled", "scheduled", "proposed"),
}


def event_status(claims: Column, kind: Column, at: Column, day: Column, corporate: tuple[str, ...]) -> Column:
    """Status of an event from the claims of a text (an array of keys of STATUS), its date and the text's day.

    The strongest claim counts. Only corporate events can be proposed: others are scheduled as soon as somebody tells of them.
    """
    strongest = F.coalesce(F.get(F.filter(F.array(*[F.lit(c) for c in STATUS]), lambda c: F.array_contains(claims, c)), F.lit(0)), F.lit(""))
    place = F.when(at < day, 0).when(at == day, 1).when(at > day, 2).otherwise(3)
    table = F.create_map(*[F.lit(c) if k == 0 else F.array(*[F.lit(s) for s in found]) for c, found in STATUS.items() for k in (0, 1)])
    status = F.get(F.try_element_at(table, strongest), place)
    return F.when((status == "proposed") & ~kind.isin(*corporate), "scheduled").otherwise(status)


def trading_hours(ts: Column, zone: str = "America/Toronto") -> Column:
    """Monday to Friday, 9:30 to 16:00 of the exchange's clock."""
    local = F.from_utc_timestamp(ts, zone)
    minutes = F.hour(local) * 60 + F.minute(local)
    return F.dayofweek(local).between(2, 6) & (minutes >= 570) & (minutes < 960)
