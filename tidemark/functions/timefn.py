"""Times: sortable record keys, record times, windows, backoff."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The digits of sortable base 32 keys (fixed value).
TID_DIGITS = "234567abcdefghijklmnopqrstuvwxyz"


def tid_micros(rkey: Column) -> Column:
    """Microseconds since 1970 that a 13-digit key encodes; null for other keys."""
    valid = F.rlike(rkey, F.lit(f"^[{TID_DIGITS[:16]}][{TID_DIGITS}]{{12}}$"))
    value = F.aggregate(
        F.sequence(F.lit(1), F.lit(13)),
        F.lit(0).cast("bigint"),
        lambda acc, i: F.shiftleft(acc, 5) + (F.instr(F.lit(TID_DIGITS), F.substring(rkey, i, F.lit(1))) - 1).cast("bigint"),
    )
    return F.when(valid, F.shiftright(value, 10))


def micros_tid(micros: Column, clock: int = 0) -> Column:
    """The 13-digit key of a time, with the clock number in its last ten bits."""
    value = F.shiftleft(micros, 10) + F.lit(clock)
    digits = [F.substring(F.lit(TID_DIGITS), (F.shiftright(value, 5 * i).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for i in range(12, -1, -1)]
    return F.concat(*digits)


def text_time(text: Column) -> Column:
    """An ISO time as timestamp, UTC where it names no zone; null for anything else."""
    return F.try_to_timestamp(text)


def record_time(rkey: Column, created: Column, added: Column) -> Column:
    """When a record was written: by its key, else by the times it states."""
    return F.coalesce(F.timestamp_micros(tid_micros(rkey)), text_time(F.coalesce(F.nullif(created, F.lit("")), added)))


def in_window(at: Column, now: Column, days: int) -> Column:
    """Not older than so many days; false where the time is unknown."""
    return F.coalesce(at >= now - F.expr(f"INTERVAL {int(days)} DAYS"), F.lit(False))


def iso_micros(micros: Column) -> Column:
    """ISO text in UTC of microseconds since 1970."""
    at = F.timestamp_micros(micros)
    whole = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")
    rest = F.pmod(micros, F.lit(1_000_000))
    return F.concat(whole, F.when(rest > 0, F.concat(F.lit("."), F.lpad(rest.cast("string"), 6, "0"))).otherwise(F.lit("")), F.lit("+00:00"))


def reconnect_delay(attempt: Column, cap: int = 60) -> Column:
    """Seconds before reconnecting: doubling from 1 up to a cap."""
    return F.least(F.pow(F.lit(2.0), attempt), F.lit(float(cap))).cast("int")


def retry_delay(attempt: Column, schedule: Sequence[int] = (2, 4, 8, 16)) -> Column:
    """Seconds after a failed attempt (counted from 1); null after the last one.

    There are as many attempts as delays, so the last delay is never used.
    """
    return F.when(attempt < len(schedule), F.get(F.array(*map(F.lit, schedule)), (attempt - 1).cast("int")))
