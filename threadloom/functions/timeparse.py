"""Times as Column functions; the session's zone is UTC."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Values above this are milliseconds.
MILLIS = 1e10


def epoch_seconds(ts: Column) -> Column:
    """Seconds from seconds or milliseconds; null stays null."""
    return F.when(ts > MILLIS, (ts / 1000).cast("long")).otherwise(ts.cast("long"))


def readable_time(ts: Column) -> Column:
    return F.concat(F.date_format(F.timestamp_seconds(epoch_seconds(ts)), "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC"))


def iso_epoch(text: Column) -> Column:
    """Seconds of yyyy-mm-ddThh:mm:ssZ; null if it is not of that form."""
    return F.unix_timestamp(F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")))


def article_epoch(text: Column) -> Column:
    """Seconds of 'yyyy-mm-dd hh:mm:ss' or ISO 8601, else 0."""
    plain = F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss"))
    return F.coalesce(F.unix_timestamp(plain), F.unix_timestamp(F.try_to_timestamp(text)), F.lit(0)).cast("long")


#: Forms of dates in mails, in order of trial, as strptime writes them: fixed values.
DATE_FORMS = (
    "%a, %d %b %Y %H:%M:%S %z", "%a, %d %b %Y %H:%M:%S", "%m/%d/%Y %I:%M:%S %p", "%m/%d/%Y %I:%M %p", "%m/%d/%Y %H:%M:%S", "%A, %B %d, %Y %I:%M %p",
    "%A, %B %d, %Y %I:%M:%S %p", "%B %d, %Y %I:%M %p", "%B %d, %Y %I:%M:%S %p", "%Y-%m-%d %H:%M:%S",
)
#: What Spark writes for a strptime field.
_FIELDS = {"%d": "d", "%b": "MMM", "%B": "MMMM", "%Y": "yyyy", "%m": "M", "%H": "H", "%I": "h", "%M": "m", "%S": "s", "%p": "a", "%z": "Z"}


def spark_form(form: str) -> str:
    """A strptime form as Spark writes it, without a weekday before."""
    return re.sub("%.", lambda m: _FIELDS[m[0]], re.sub("^%[aA], ", "", form))


def mail_epoch(text: Column) -> Column:
    """Seconds of a mail's date in any of DATE_FORMS; a weekday before and a zone's name in brackets after are cut first."""
    cut = F.trim(F.regexp_replace(F.regexp_replace(text, "^[A-Za-z]+,\\s*", ""), "\\s*\\([A-Za-z]+\\)\\s*$", ""))
    return F.unix_timestamp(F.coalesce(*[F.try_to_timestamp(cut, F.lit(f)) for f in dict.fromkeys(map(spark_form, DATE_FORMS))]))


def months(text: Column) -> Column:
    """'1-12' or '1,2 3' as an array of months; [1] if there is none."""
    span = F.regexp_extract(text, "^\\s*(\\d+)\\s*-\\s*(\\d+)\\s*$", 1)
    lo, hi = span.try_cast("int"), F.regexp_extract(text, "^\\s*(\\d+)\\s*-\\s*(\\d+)\\s*$", 2).try_cast("int")
    listed = F.filter(F.transform(F.split(F.trim(text), "[,\\s]+"), lambda x: x.try_cast("int")), lambda x: x.between(1, 12))
    picked = F.when(lo.isNotNull() & hi.isNotNull() & (lo <= hi), F.filter(F.sequence(lo, F.greatest(lo, hi)), lambda x: x.between(1, 12))).otherwise(listed)
    return F.when(F.size(picked) > 0, picked).otherwise(F.array(F.lit(1)))


def target_year(now: Column, back: int) -> Column:
    """The year that lies so many years before a time in seconds."""
    return F.year(F.timestamp_seconds(now)) - back
