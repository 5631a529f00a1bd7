"""Decomposition of net count changes into queue flows, as column expressions.

With a queue at the start, enrolment gains are admits (first in, first out);
the rest of the waiting-list change is joins or drops. Without a queue, gains
are direct enrolment. All expressions stay inside whole-stage codegen.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000


def minutes_between(start: Column, end: Column) -> Column:
    """Minutes from whole seconds."""
    return F.floor((F.unix_micros(end) - F.unix_micros(start)) / F.lit(1_000_000)) / F.lit(60.0)


def days_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(float(MICROS_PER_DAY))


def is_full(enrolled: Column, capacity: Column, open_reserved: Column) -> Column:
    """No unreserved seat: capacity is reduced by open reserved seats when known."""
    return enrolled >= capacity - F.coalesce(open_reserved, F.lit(0))


def classify(d_enrolled: Column, d_waitlist: Column, d_capacity: Column, waitlist0: Column,
             full0: Column, open_reserved0: Column) -> dict[str, Column]:
    """The five flows, the rule name and the ambiguity flag of one interval."""
    zero = F.lit(0).cast("long")
    gain, loss, same = d_enrolled > 0, d_enrolled < 0, d_enrolled == 0
    queued, empty = waitlist0 > 0, waitlist0 == 0
    grew, shrank = d_waitlist > 0, d_waitlist < 0
    admitting = gain & queued
    direct = gain & empty
    net = d_waitlist + d_enrolled  # joins minus drops while admits leave the queue

    rule = (
        F.when(admitting & (net > 0), "admit_join")
        .when(admitting & (net < 0), "admit_drop")
        .when(admitting, "admit")
        .when(direct & grew, "enr_join_then_join")
        .when(direct & shrank, "inconsistent")
        .when(direct, "enr_join")
        .when(same & grew, "join")
        .when(same & shrank & (d_capacity < 0), "wl_drop_capcut")
        .when(same & shrank, "wl_drop")
        .when(loss & shrank, "enr_drop_wl_drop")
        .when(loss & grew, "enr_drop_join")
        .when(loss, "enr_drop")
        .otherwise("none")
    )
    ambiguous = (
        F.when(admitting, (F.coalesce(open_reserved0, F.lit(0)) > 0) | (d_enrolled > waitlist0))
        .when(direct & grew, full0)
        .when(direct & shrank, F.lit(True))
        .when(same & shrank, full0 & queued)
        .when(loss & (d_waitlist == 0), queued & full0)
        .when(loss & shrank, F.lit(True))
        .otherwise(F.lit(False))
    )
    return {
        "admits": F.when(admitting, d_enrolled).otherwise(zero),
        "wl_joins": F.when(admitting, F.greatest(net, zero))
        .when((waitlist0 < 0) & gain, zero)
        .otherwise(F.greatest(d_waitlist, zero)),
        "wl_drops": F.when(admitting, F.greatest(-net, zero))
        .when(gain, zero)
        .otherwise(F.greatest(-d_waitlist, zero)),
        "enr_joins": F.when(direct, d_enrolled).otherwise(zero),
        "enr_drops": F.greatest(-d_enrolled, zero),
        "rule": rule,
        "ambiguous": ambiguous,
    }
