"""Column expressions that the operators share."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The reference time of all registered queries: the end of the given events.
AS_OF = dt.datetime(2024, 1, 31)

SEVERITIES = ("P1", "P2", "P3", "P4")


def at(as_of: dt.datetime | Column) -> Column:
    """A reference time as a timestamp column."""
    return as_of if isinstance(as_of, Column) else F.to_timestamp(F.lit(as_of.strftime("%Y-%m-%d %H:%M:%S")))


def ago(as_of: dt.datetime | Column, **units: int) -> Column:
    """as_of less an interval: ``ago(t, hours=25)``."""
    zero = F.make_dt_interval(*(F.lit(units.get(u, 0)) for u in ("days", "hours", "minutes", "seconds")))
    return at(as_of) - zero


def between(ts: Column, start: Column, end: Column) -> Column:
    """Half-open: start <= ts < end."""
    return (ts >= start) & (ts < end)


def money(x: Column) -> Column:
    """A sum of amounts, exact to the cent whatever the order of rows."""
    return F.sum(x.cast("decimal(18,2)")).cast("double")


def rounded(x: Column, digits: int) -> Column:
    """Half up, by the same arithmetic as its SQL twin."""
    return F.floor(x * float(10**digits) + 0.5) / float(10**digits)


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double; null if b is zero or null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def canceled(status: Column | None = None) -> Column:
    return (F.col("order_status") if status is None else status) == "canceled"


def worst_first(severity: Column) -> Column:
    """0 for P1 up to 3 for P4, 99 for others."""
    out = F.when(severity == SEVERITIES[0], 0)
    for n, s in enumerate(SEVERITIES[1:], 1):
        out = out.when(severity == s, n)
    return out.otherwise(99)


def raised(severity: Column) -> Column:
    """One step up: P3 to P2, P2 to P1."""
    return F.when(severity == "P3", "P2").when(severity == "P2", "P1").otherwise(severity)


def fingerprint(source: Column, metric: Column, category: Column) -> Column:
    """The first 16 hexadecimal digits of the MD5 of source:metric:category."""
    return F.substring(F.md5(F.concat_ws(":", source, metric, category)), 1, 16)


def device_class(agent: Column) -> Column:
    low = F.lower(agent)
    return F.when(agent.isNull(), "UNKNOWN").when(low.rlike("mobile|android|iphone"), "MOBILE").when(low.rlike("tablet|ipad"), "TABLET").otherwise("DESKTOP")


#: The states of Brazil by abbreviation.
STATES = "AC AL AP AM BA CE DF ES GO MA MT MS MG PA PB PR PE PI RJ RN RS RO RR SC SP SE TO".split()


def ip_state(ip: Column) -> Column:
    """A state by the last octet of an address, null for what isn't one. In real use, join a table of ranges."""
    last = F.try_element_at(F.split(ip, r"\."), F.lit(4)).try_cast("int")
    return F.when(last.isNotNull(), F.element_at(F.array(*map(F.lit, STATES)), F.pmod(F.coalesce(last, F.lit(0)), F.lit(len(STATES))) + 1))


def time_decay(hours: Column, half_life: float) -> Column:
    """0.5 to the power of hours over half-life."""
    return F.pow(F.lit(0.5), hours / F.lit(float(half_life)))


def hours_apart(start: Column, end: Column) -> Column:
    """Hour boundaries between two times, as a warehouse's date difference counts them."""
    hour = lambda t: F.unix_timestamp(F.date_trunc("hour", t))
    return F.floor((hour(end) - hour(start)) / 3600)


def settle(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Ends the lineage of a round in spark.checkpoint.dir; where that is unset, in a folder beside the warehouse's tables."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/lakeloom-checkpoints")
    return df.checkpoint()
