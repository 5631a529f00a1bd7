"""Scalar expressions: buckets, levels, phases, horizons, keys, shards, verdicts."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnwise.functions.rules import days_between
from turnwise.schema import BUCKETS


def position_bucket(position: Column) -> Column:
    out = F.when(position < 1, F.raise_error(F.lit("position must be >= 1")))
    for low, high, label in BUCKETS:
        out = out.when(position.between(low, high), label)
    return out


def course_level(catalog_number: Column) -> Column:
    """lower / upper / grad from the first run of digits, null without digits."""
    number = F.regexp_extract(catalog_number, r"(\d+)", 1).try_cast("decimal(38,0)")
    return F.when(number < 100, "lower").when(number < 200, "upper").when(number >= 200, "grad")


def joinable(waitlist0: Column, full0: Column, enrolled0: Column, capacity0: Column) -> Column:
    """A queue exists or the section is full; unknown fullness counts as not full."""
    return (waitlist0 > 0) | F.coalesce(full0, enrolled0 >= capacity0, F.lit(False))


def is_active(enrolled: Column, capacity: Column, waitlist: Column) -> Column:
    """Someone waits, or every seat of a real capacity is taken."""
    return F.coalesce(waitlist > 0, F.lit(False)) | F.coalesce((capacity > 0) & (enrolled >= capacity), F.lit(False))


def waitlist_ratio(waitlist0: Column, capacity0: Column) -> Column:
    return F.when(capacity0 > 0, waitlist0 / capacity0)


def midnight(day: dt.date) -> Column:
    return F.lit(f"{day.isoformat()} 00:00:00").cast("timestamp")


def phase_at(when: Column, calendar) -> Column:
    """Phase of the UTC date of ``when`` in one term's calendar."""
    day = F.to_date(when)
    return (
        F.when(day < F.lit(calendar.phase1_start), "before")
        .when(day <= F.lit(calendar.phase1_end), "phase1")
        .when(day < F.lit(calendar.phase2_start), "between")
        .when(day <= F.lit(calendar.phase2_end), "phase2")
        .when(day < F.lit(calendar.instruction_start), "adjustment")
        .when(day <= F.lit(calendar.add_drop_deadline), "instruction")
        .otherwise("after")
    )


def days_to_instruction(when: Column, calendar) -> Column:
    return days_between(when, midnight(calendar.instruction_start))


def horizon_days(join_time: Column, calendar, which: str) -> Column:
    """Days to ``deadline`` (end of its day), ``instruction`` or a fixed ``days:N``."""
    if which == "deadline":
        return days_between(join_time, midnight(calendar.last_auto_waitlist + dt.timedelta(days=1)))
    if which == "instruction":
        return days_to_instruction(join_time, calendar)
    if which.startswith("days:"):
        return F.lit(float(which.split(":", 1)[1]))
    raise ValueError(f"unknown horizon {which!r}; expected deadline, instruction or days:N")


def horizon_label(which: Column) -> Column:
    """Plain words for a horizon name as it appears in a run's folder."""
    days = F.regexp_extract(which, r"^days(\d+)", 1)
    return (
        F.when(days != "", F.concat(F.lit("within "), days, F.lit(" days")))
        .when(which == "deadline", "by the last automatic waitlist run")
        .when(which == "instruction", "by the first day of instruction")
        .otherwise(which)
    )


def term_id_of(name: Column) -> Column:
    """``Spring 2027`` to ``2272``: 2, two year digits, then 2 / 5 / 8 by season."""
    pattern = r"(?i)^\s*(spring|summer|fall)\s+(\d{4})\s*$"
    season, year = F.lower(F.regexp_extract(name, pattern, 1)), F.regexp_extract(name, pattern, 2)
    code = F.when(season == "spring", "2").when(season == "summer", "5").when(season == "fall", "8")
    return F.concat(F.lit("2"), F.substring(year, 3, 2), code)


def seeded_order(seed: int, key: Column) -> Column:
    """A shuffled order that any engine can repeat: 60 bits of the MD5 of seed and key."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def shard_of(key: Column, n_shards: int) -> Column:
    """SHA-1 of the key as one large integer, modulo the shard count."""
    if n_shards <= 0:
        raise ValueError("n_shards must be positive")
    # seven hex digits at a time keeps every intermediate inside a long
    digest = F.sha1(key)
    rest = F.lit(0).cast("long")
    for start in range(1, 41, 7):
        width = min(7, 41 - start)
        part = F.conv(F.substring(digest, start, width), 16, 10).cast("long")
        rest = (rest * F.lit(16**width % n_shards) + part) % F.lit(n_shards)
    return rest.cast("int")


def normalise_course(key: Column) -> Column:
    """Upper case, single spaces, no spaces inside the subject part."""
    flat = F.trim(F.regexp_replace(F.upper(key), r"\s+", " "))
    last = F.substring_index(flat, " ", -1)
    subject = F.regexp_replace(F.regexp_replace(flat, r" [^ ]+$", ""), " ", "")
    return F.when(flat.contains(" "), F.concat_ws(" ", subject, last)).otherwise(flat)


def subject_slug(subject: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.upper(subject), "[^A-Z0-9]+", "_"), "^_+|_+$", "")


def parse_stamp(text: Column) -> Column:
    """``YYYY-MM-DD`` or ``YYYY-MM-DDTHH:MMZ``; anything else is null."""
    clean = F.trim(text)
    ok = clean.rlike(r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}Z)?$")
    padded = F.when(F.length(clean) == 10, F.concat(clean, F.lit("T00:00Z"))).otherwise(clean)
    return F.when(ok, F.try_to_timestamp(padded, F.lit("yyyy-MM-dd'T'HH:mmX")))


def iso_stamp(text: Column) -> Column:
    """ISO-8601 with a zone or ``Z``."""
    return F.try_to_timestamp(text)


def curve_at(curve: Column, horizon: Column) -> Column:
    """Last curve point at or before the horizon (null before the first point)."""
    reached = F.filter(curve, lambda c: c["day"] <= horizon)
    return F.try_element_at(reached, F.lit(-1))


def verdict(p: Column, low: Column, high: Column, pooled: Column) -> Column:
    """Words for a share with its band. The thresholds and the words, which readers' files hold."""
    likely, even, wide = 0.75, 0.40, 0.30
    unsure = F.coalesce(pooled == "all", F.lit(False)) | low.isNull() | high.isNull() | (high - low > wide)
    return (
        F.when(unsure, "Too little data to call")
        .when(p >= likely, "Likely")
        .when(p >= even, "Could go either way")
        .otherwise("Unlikely")
    )


def frequency(p: Column) -> Column:
    """A share in twentieths, in words (halves round up). The words, which readers' files hold."""
    k = F.floor(p * 20 + 0.5)
    return (
        F.when(k == 0, "Almost no one").when(k == 20, "Almost everyone")
        .otherwise(F.concat(F.lit("About "), k.cast("string"), F.lit(" in 20")))
    )


def seats_open(capacity: Column, enrolled: Column) -> Column:
    return F.when(capacity.isNotNull() & enrolled.isNotNull(), F.greatest(capacity - enrolled, F.lit(0)))


def board_status(enrolled: Column, capacity: Column, waitlist: Column, open_reserved: Column) -> Column:
    seats = seats_open(capacity, enrolled)
    unread = enrolled.isNull() | capacity.isNull() | waitlist.isNull()
    return (
        F.when(unread, "not read")
        .when(waitlist > 0, "waitlist")
        .when(seats == 0, "full")
        .when((seats > 0) & (F.coalesce(open_reserved, F.lit(0)) >= seats), "full and reserved")
        .otherwise("open")
    )
