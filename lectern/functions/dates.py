"""Dates and times as expressions: lenient readers that give null for days that do not exist,
and the clock rules of merges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, nfkc

# Month names of English dates.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
STAMP = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?Z$"


# Words for the halves of the day.
BEFORE_NOON, AFTER_NOON = ("午前", "上午", "am"), ("午後", "下午", "pm")

#: How a text that is nothing but a day reads, a number of four places as Y, another as N and a
#: word as W: in Japanese, month first, day first, and year first.
DAY_SHAPES = ("YWNWNW", "WNY", "NWY", "YNN")


def tokens(c: Column) -> Column:
    """The numbers and words of a text, in order and in small letters."""
    return F.regexp_extract_all(F.lower(nfkc(F.coalesce(c, F.lit("")))), F.lit(r"[0-9]+|\p{L}+"), F.lit(0))


def is_number(t: Column) -> Column:
    return t.rlike("^[0-9]")


def is_day(c: Column) -> Column:
    """Whether a text is a day and nothing else."""
    shape = F.transform(tokens(c), lambda t: F.when(~is_number(t), "W").when(F.length(t) == 4, "Y").when(F.length(t) < 3, "N").otherwise("?"))
    return F.array_join(shape, "").isin(*DAY_SHAPES)


def month_number(name: Column) -> Column:
    """1 to 12 of an English month's name or its beginning of three letters; null otherwise."""
    out = F.lit(None).cast("int")
    for i, m in enumerate(MONTHS, 1):
        out = F.when(F.lower(name).isin(m, m[:3]), i).otherwise(out)
    return out


def _day(t: Column) -> Column:
    """A date from tokens. Numbers say what they are by their place: a first one of four digits is
    the year before month and day, else a month has a name, and the day stands before the year."""
    n = F.filter(t, is_number)
    named = F.get(F.filter(F.transform(t, month_number), lambda m: m.isNotNull()), F.lit(0))
    at = lambda i: F.get(n, F.lit(i)).try_cast("int")
    year_first = F.length(F.get(n, F.lit(0))) == 4
    year_last = (F.length(F.get(n, F.lit(1))) == 4) & named.isNotNull()
    y, m, d = (F.when(year_first, x).when(year_last, z) for x, z in ((at(0), at(1)), (at(1), named), (at(2), at(0))))
    return F.try_to_timestamp(F.format_string("%04d-%02d-%02d", y, m, d), F.lit("yyyy-MM-dd")).cast("date")


def _seconds(text: Column, t: Column) -> Column:
    """The time of day in a text with these tokens, in seconds; 0 without one, null if there is no
    such time. Twelve is 0 in the first half of the day, others count on in the second."""
    clock = F.split(F.regexp_extract(text, "[0-9]{1,2}(:[0-9]{2})+", 0), ":")
    part = lambda i: F.coalesce(F.get(clock, F.lit(i)).try_cast("int"), F.lit(0))
    said = lambda words: F.exists(t, lambda w: F.greatest(*[F.endswith(w, F.lit(x)) if not x.isascii() else w == x for x in words]))
    hour = F.when(said(AFTER_NOON) & (part(0) < 12), part(0) + 12).when(said(BEFORE_NOON) & (part(0) == 12), 0).otherwise(part(0))
    return F.when((hour < 24) & (part(1) < 60) & (part(2) < 60), (hour * 60 + part(1)) * 60 + part(2))


def loose_date(c: Column) -> Column:
    """A time from Japanese (with halves of the day), year-first or English text; null where
    there is none or the day does not exist."""
    said = F.struct(nfkc(F.coalesce(c, F.lit(""))).alias("text"), tokens(c).alias("t"))
    return let(said, lambda x: F.timestamp_seconds(F.unix_date(_day(x["t"])) * F.lit(86400) + _seconds(x["text"], x["t"])))


def annotated_on(c: Column) -> Column:
    """The day of a Japanese or English date line; null where it does not exist."""
    return let(tokens(c), lambda t: F.when(F.contains(F.coalesce(c, F.lit("")), F.lit("年")) | F.exists(t, lambda w: month_number(w).isNotNull()), _day(t)))


def iso_stamp(c: Column, now: Column, slack_hours: int = 24) -> Column:
    """A synchronised time as it came if it is a real UTC time, the empty text (oldest) if not,
    and `now` (a text of that form) if it lies more than a day ahead."""
    at = lambda x: F.try_to_timestamp(F.substring(x, 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss"))
    real = c.rlike(STAMP) & (F.length(c) <= 40) & at(c).isNotNull()
    late = at(c) > at(now) + F.expr(f"INTERVAL {slack_hours} HOURS")
    return F.when(F.coalesce(real, F.lit(False)), F.when(late, now).otherwise(c)).otherwise("")


def atom_time(c: Column) -> Column:
    """A local time in Atom's form; the epoch where it cannot be read."""
    at = F.coalesce(F.try_to_timestamp(c), F.lit("1970-01-01 00:00:00").cast("timestamp"))
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))


def add_months(year: Column, month: Column, delta: int) -> Column:
    """(year, month) some months on."""
    index = year * 12 + (month - 1) + delta
    return F.struct(F.floor(index / 12).alias("year"), (F.pmod(index, F.lit(12)) + 1).alias("month"))
