"""Dates out of scraped German text. Every parse gives null instead of failing or rolling over."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from kalendarium.functions.text import trim_edges
from kalendarium.functions.times import berlin_wall

# Month names in folded spelling, with their numbers.
MONTHS = {
    "januar": 1,
    "jan": 1,
    "februar": 2,
    "feb": 2,
    "maerz": 3,
    "marz": 3,
    "mar": 3,
    "mrz": 3,
    "april": 4,
    "apr": 4,
    "mai": 5,
    "juni": 6,
    "jun": 6,
    "juli": 7,
    "jul": 7,
    "august": 8,
    "aug": 8,
    "september": 9,
    "sept": 9,
    "sep": 9,
    "oktober": 10,
    "okt": 10,
    "november": 11,
    "nov": 11,
    "dezember": 12,
    "dez": 12,
}
# Names shown in labels.
MONTH_NAMES = ["Januar", "Februar", "März", "April", "Mai", "Juni", "Juli", "August", "September", "Oktober", "November", "Dezember"]
WEEKDAY_NAMES = ["Montag", "Dienstag", "Mittwoch", "Donnerstag", "Freitag", "Samstag", "Sonntag"]


_SEP = "\x01"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value computed once, however often it is mentioned."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def captures(text: Column, pattern: str) -> Column:
    """All groups of the first match as one array (one regex run), null when there is no match."""
    groups = re.compile(pattern).groups
    whole = rf"^[\s\S]*?(?:{pattern})[\s\S]*$"
    return F.when(text.rlike(pattern), F.split(F.regexp_replace(text, whole, _SEP.join(f"${n + 1}" for n in range(groups))), _SEP))


def text_part(parts: Column, n: int) -> Column:
    return F.nullif(F.get(parts, F.lit(n - 1)), F.lit(""))


def number_part(parts: Column, n: int) -> Column:
    return text_part(parts, n).try_cast("int")


def safe_date(year: Column, month: Column, day: Column, hour: Column | int = 0, minute: Column | int = 0) -> Column:
    """A moment, or null for an impossible date or time."""
    as_col = lambda v: F.lit(v) if isinstance(v, int) else v
    hour, minute = as_col(hour), as_col(minute)
    valid = hour.between(0, 23) & minute.between(0, 59)
    return F.when(valid, F.try_make_timestamp_ntz(year, month, day, hour, minute, F.lit(0).cast("decimal(16,6)")))


def month_number(name: Column) -> Column:
    folded = F.translate(F.lower(name), "äöü", "aou")
    table = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])
    return F.element_at(table, folded)


def full_year(year: Column) -> Column:
    return F.when(year < 100, year + 2000).otherwise(year)


def _sane(year: Column) -> Column:
    return F.when(year.between(2000, 2100), year)


def _clamped(c: Column, top: int) -> Column:
    return F.least(F.coalesce(c, F.lit(0)), F.lit(top))


#: a day with a numeric month and a year, or with a month's name and a full year
_MENTION = r"\d{1,2}\.(?:\d{1,2}\.\d{2,4}|\s*[A-Za-zäöüÄÖÜ]+\s+\d{4})"
#: how far behind a date its time is looked for
CLOCK_WINDOW = 60


def _mentioned(mention: Column, clock: Column) -> Column:
    """The moment of one mention; too large a time is cut, an impossible day or a year outside 2000 to 2100 is null."""
    def read(x: Column) -> Column:
        number = lambda parts, n: F.get(x[parts], F.lit(n)).try_cast("int")
        month = F.coalesce(number("day", 1), month_number(F.get(x["day"], F.lit(1))))
        return safe_date(_sane(full_year(number("day", 2))), month, number("day", 0), _clamped(number("clock", 0), 23), _clamped(number("clock", 1), 59))

    # a split at one character needs no pattern, any other compiles one for each row
    return let(F.struct(F.regexp_extract_all(mention, F.lit(r"[^.\s]+"), F.lit(0)).alias("day"), F.split(F.translate(clock, ".", ":"), ":").alias("clock")), read)


def _clock_within(window: Column) -> Column:
    """``HH:MM`` anywhere before ``HH Uhr``, as text; null without either."""
    exact = F.nullif(F.regexp_extract(window, r"\d{1,2}:\d{2}", 0), F.lit(""))
    return F.coalesce(exact, F.nullif(F.regexp_extract(window, r"(\d{1,2})\s*Uhr", 1), F.lit("")))


def german_dates(text: Column) -> Column:
    """struct(start, end) of the dates a text mentions.

    The text falls into mentions of days and the gaps around them. A numeric mention behind the label starts the
    event, and ends it at the next one if only a clock and a dash lie between. Otherwise the first numeric mention
    counts, then the first spelled one, with the clock that follows closely. Mentions don't overlap: of two dates
    written without anything between them, the first takes its characters."""
    def mentions(text: Column, x: Column) -> Column:
        numeric = lambda i: F.get(x["days"], i).rlike(r"^[\d.]+$")
        clock_after = lambda i: F.regexp_extract(F.get(x["gaps"], i + 1), r"^,?\s*(\d{1,2}[:.]\d{2})", 1)
        places = F.transform(x["days"], lambda _, i: i)
        first = lambda test: F.get(F.filter(places, test), F.lit(0))

        def loose(i: Column) -> Column:
            upto = F.length(F.array_join(F.slice(x["gaps"], 1, i + 1), "")) + F.length(F.array_join(F.slice(x["days"], 1, i + 1), ""))
            return _mentioned(F.get(x["days"], i), _clock_within(F.substr(text, upto + 1, F.lit(CLOCK_WINDOW))))

        def labelled(i: Column) -> Column:
            ranged = F.get(x["gaps"], i + 1).rlike(r"^(?:,?\s*\d{1,2}[:.]\d{2})?\s*[-–]\s*$") & numeric(i + 1)
            until = F.when(ranged, _mentioned(F.get(x["days"], i + 1), clock_after(i + 1)))
            return F.struct(_mentioned(F.get(x["days"], i), clock_after(i)).alias("start"), until.alias("end"))

        given = let(first(lambda i: numeric(i) & F.get(x["gaps"], i).rlike(r"Datum:\s*$")), labelled)
        other = F.coalesce(let(first(numeric), loose), let(first(lambda i: ~numeric(i)), loose))
        return let(given, lambda g: F.struct(F.coalesce(g["start"], other).alias("start"), F.when(g["end"] > g["start"], g["end"]).alias("end")))

    def parts(text: Column) -> Column:
        # cut at one character that stands for the mentions: a split at a pattern compiles it for each row
        free = F.when(F.contains(text, F.lit(_SEP)), F.translate(text, _SEP, "\x02")).otherwise(text)
        return F.struct(F.regexp_extract_all(text, F.lit(_MENTION), F.lit(0)).alias("days"), F.split(F.regexp_replace(free, _MENTION, _SEP), _SEP).alias("gaps"))

    return let(text, lambda whole: let(parts(whole), lambda x: mentions(whole, x)))


def course_date(text: Column) -> Column:
    """``Mi. 02.09.2026, 17.45 Uhr``: the four-digit year is tried first; time after a comma, else before Uhr."""
    def clock(c: Column, u: Column, n: int) -> Column:
        return F.coalesce(number_part(c, n), number_part(u, n), F.lit(0))

    comma, uhr = captures(text, r",\s*(\d{1,2})[.:](\d{2})"), captures(text, r"(\d{1,2})[.:](\d{2})\s*Uhr")
    time = F.struct(comma.alias("c"), uhr.alias("u"))
    date = captures(text, r"(\d{1,2})\.(\d{1,2})\.(\d{4}|\d{2})(?!\d)")
    return let(F.struct(date.alias("d"), time.alias("t")), lambda x: safe_date(
        full_year(number_part(x["d"], 3)), number_part(x["d"], 2), number_part(x["d"], 1), clock(x["t"]["c"], x["t"]["u"], 1), clock(x["t"]["c"], x["t"]["u"], 2)
    ))


def has_clock(text: Column) -> Column:
    return text.rlike(r"\d{2}:\d{2}")


_ISO = r"^(\d{4})-(\d{1,2})-(\d{1,2})(?:[T ]+(\d{1,2}):(\d{2})(?::(\d{2}))?(?:\.\d+)?)?\s*(Z|[+-]\d{2}:?\d{2})?"


def _iso(p: Column) -> Column:
    zero = lambda n: F.coalesce(number_part(p, n), F.lit(0))
    wall = safe_date(number_part(p, 1), number_part(p, 2), number_part(p, 3), zero(4), zero(5)) + F.make_dt_interval(secs=zero(6))
    zone = text_part(p, 7)
    offset = F.when(zone == "Z", "+00:00").when(F.length(zone) == 5, F.concat(F.substring(zone, 1, 3), F.lit(":"), F.substring(zone, 4, 2))).otherwise(zone)
    timed = number_part(p, 4).isNotNull() & offset.isNotNull()
    return let(wall, lambda w: F.when(timed, berlin_wall(w, F.coalesce(offset, F.lit("+00:00")))).otherwise(w))


def _german(value: Column) -> Column:
    clock = captures(value, r"(\d{1,2})[:.](\d{2})\s*[Uu][Hh][Rr]?")

    def dated(t: Column) -> Column:
        hour, minute = (F.coalesce(number_part(t["c"], n), F.lit(0)) for n in (1, 2))
        dotted = let(captures(value, r"(\d{1,2})\.\s*(\d{1,2})\.\s*(\d{4})"), lambda p: safe_date(number_part(p, 3), number_part(p, 2), number_part(p, 1), hour, minute))
        spelled = let(captures(value, r"(\d{1,2})\.?\s+([A-Za-zäöüÄÖÜ]+)\s+(\d{4})"), lambda p: safe_date(number_part(p, 3), month_number(text_part(p, 2)), number_part(p, 1), hour, minute))
        return F.coalesce(dotted, spelled)

    return let(F.struct(clock.alias("c")), dated)


def iso_or_german_date(text: Column) -> Column:
    """ISO with or without zone (to Berlin), date-only as midnight, German forms as fallback."""
    return let(trim_edges(text), lambda value: F.coalesce(let(captures(value, _ISO), _iso), _german(value)))


def manual_moment(date: Column, time: Column) -> Column:
    """Hand-entered date (ISO or German) and optional ``H:MM``; any other shape is null."""
    def read(v: Column) -> Column:
        iso, german = captures(v["d"], r"^(\d{4})-(\d{2})-(\d{2})$"), captures(v["d"], r"^(\d{1,2})\.(\d{1,2})\.(\d{4})$")
        day = F.coalesce(iso, F.when(german.isNotNull(), F.reverse(german)))
        clock = F.when(v["t"] == "", F.array(F.lit("0"), F.lit("0"))).otherwise(captures(v["t"], r"^(\d{1,2}):(\d{2})$"))
        return let(F.struct(day.alias("d"), clock.alias("c")), lambda x: safe_date(*[number_part(x["d"], n) for n in (1, 2, 3)], number_part(x["c"], 1), number_part(x["c"], 2)))

    blank = lambda c: trim_edges(F.coalesce(c, F.lit("")))
    return let(F.struct(blank(date).alias("d"), blank(time).alias("t")), read)


def next_year_if_past(day: Column, month: Column, now: Column, days: int, required: bool = False) -> Column:
    """Year-less date in the current year, next year when older than ``days``. ``required``: an
    impossible date this year is also tried next year (29 February)."""
    year = F.year(now)
    this, following = safe_date(year, month, day), safe_date(year + 1, month, day)
    old = this < now - F.make_dt_interval(days=F.lit(days))
    if required:
        return F.when(this.isNull() | old, following).otherwise(this)
    return F.when(old, F.coalesce(following, this)).otherwise(this)


def roll_at_year_end(day: Column, month: Column, today: Column, old_days: int = 40, ahead_months: int = 6) -> Column:
    """Rolled only when older than ``old_days`` and the rolled date is at most six months ahead."""
    year = F.year(today)
    this, rolled = safe_date(year, month, day), safe_date(year + 1, month, day)
    fits = (this < today - F.make_dt_interval(days=F.lit(old_days))) & (rolled <= today + F.make_ym_interval(months=F.lit(ahead_months)))
    return F.when(fits, rolled).otherwise(this)


def nearest_year(day: Column, month: Column, weekday: Column, now: Column) -> Column:
    """Nearest of last, this and next year; a weekday mismatch costs 400 days."""
    year = F.year(now)

    def scored(shift: int) -> Column:
        moment = safe_date(year + shift, month, day)
        away = F.abs(F.timestamp_diff("SECOND", now, moment))
        off = F.when(weekday.isNull() | (F.weekday(moment) + 1 == weekday), 0).otherwise(400 * 86400)
        return F.when(moment.isNotNull(), F.struct((away + off).alias("score"), F.lit(shift).alias("shift"), moment.alias("moment")))

    return F.array_min(F.array_compact(F.array(scored(-1), scored(0), scored(1))))["moment"]


CLOCK = r"(\d{1,2}):(\d{2})"
_FULL_DAY = r"(\d{1,2})\.(\d{1,2})\.(\d{4})"


def date_range(from_date: Column, from_time: Column, to_date: Column, to_time: Column) -> Column:
    """struct(start, end, all_day). A date-only end runs to 23:59; on the start day of a timed event
    it is unknown instead; an end before the start is dropped."""
    def moment(p: Column, clock: Column, hour: int, minute: int) -> Column:
        given = clock.isNotNull()
        return safe_date(number_part(p, 3), number_part(p, 2), number_part(p, 1), F.when(given, number_part(clock, 1)).otherwise(hour), F.when(given, number_part(clock, 2)).otherwise(minute))

    def bounds(v: Column) -> Column:
        start = moment(v["fd"], v["ft"], 0, 0)
        until = F.when(v["to_date"] != "", moment(v["td"], v["tt"], 23, 59)).when(v["to_time"] != "", moment(v["fd"], v["tt"], 0, 0))
        return F.struct(start.alias("start"), until.alias("end"), v["ft"].isNull().alias("all_day"), ((v["to_date"] != "") & v["tt"].isNull()).alias("open"))

    def settle(b: Column) -> Column:
        unknown = b["open"] & ~b["all_day"] & (F.to_date(b["end"]) == F.to_date(b["start"]))
        return F.struct(b["start"].alias("start"), F.when(~unknown & (b["end"] >= b["start"]), b["end"]).alias("end"), b["all_day"].alias("all_day"))

    blank = lambda c: F.coalesce(c, F.lit(""))
    read = F.struct(
        captures(from_date, _FULL_DAY).alias("fd"), captures(from_time, CLOCK).alias("ft"), captures(to_date, _FULL_DAY).alias("td"),
        captures(to_time, CLOCK).alias("tt"), blank(to_date).alias("to_date"), blank(to_time).alias("to_time"),
    )
    return let(let(read, bounds), settle)


def day_label(at: Column, now: Column) -> Column:
    """Heute, Morgen, Übermorgen, else weekday and date; the year only when it is not the current one."""
    ahead = F.datediff(F.to_date(at), F.to_date(now))
    name = lambda names, n: F.element_at(F.array(*[F.lit(x) for x in names]), n)
    date = F.concat(F.dayofmonth(at).cast("string"), F.lit(". "), name(MONTH_NAMES, F.month(at)))
    dated = F.when(F.year(at) == F.year(now), date).otherwise(F.concat_ws(" ", date, F.year(at).cast("string")))
    named = F.concat_ws(", ", name(WEEKDAY_NAMES, F.weekday(at) + 1), dated)
    return F.when(ahead == 0, "Heute").when(ahead == 1, "Morgen").when(ahead == 2, "Übermorgen").otherwise(named)
