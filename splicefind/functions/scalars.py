"""Frame, time and rate expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from splicefind.functions.vectors import col


def _fps(fps: Column | str) -> Column:
    fps = col(fps)
    return F.when(fps > 0, fps).otherwise(25.0)


def seconds_to_frames(t: Column | str, fps: Column | str) -> Column:
    """Frame number, halves to even, never negative."""
    return F.greatest(F.lit(0), F.bround(col(t) * _fps(fps))).cast("long")


def timecode(t: Column | str, fps: Column | str) -> Column:
    """Non-drop HH:MM:SS:FF at the nominal rate."""
    nominal = F.greatest(F.lit(1), F.bround(_fps(fps))).cast("long")
    frames = seconds_to_frames(t, fps)
    total = F.floor(frames / nominal).cast("long")
    return F.format_string("%02d:%02d:%02d:%02d", F.floor(total / 3600).cast("long"), F.floor(total / 60).cast("long") % 60, total % 60, frames % nominal)


def timebase(fps: Column | str) -> Column:
    """Struct (base, ntsc)."""
    base = F.greatest(F.lit(1), F.bround(_fps(fps))).cast("long")
    return F.struct(base.alias("base"), ((col(fps) > 0) & (F.abs(col(fps) - base) > 0.01)).alias("ntsc"))


def micros(t: Column | str) -> Column:
    return F.bround(col(t) * 1e6).cast("long")


def sql_round(x: Column | str, digits: int) -> Column:
    """Rounded as SQL rounds doubles: times 10^digits, to the nearest whole number, halves away from 0.

    F.round goes by the printed decimals, so it has 0.251654 of 0.2516535 where SQL has 0.251653.
    """
    scale = F.lit(10.0**digits)
    return F.round(col(x) * scale) / scale


def parse_rate(s: Column | str) -> Column:
    """'24000/1001' or '25' as double; null when it is no number or the divisor is 0."""
    p = F.split(col(s), "/")
    num, den = F.get(p, 0).try_cast("double"), F.coalesce(F.get(p, 1), F.lit("1")).try_cast("double")
    return F.when(den != 0, num / den)


def parse_progress(line: Column | str) -> Column:
    """Seconds of a progress line; null when it is none."""
    line = F.trim(col(line))
    key, value = F.trim(F.substring_index(line, "=", 1)), F.trim(F.regexp_extract(line, "^[^=]*=(.*)$", 1))
    hms = F.regexp_extract(value, r"^(\d+):(\d+):(\d+)(?:\.(\d*))?$", 0)
    part = lambda i: F.regexp_extract(value, r"^(\d+):(\d+):(\d+)(?:\.(\d*))?$", i)
    seconds = part(1).try_cast("double") * 3600 + part(2).try_cast("double") * 60 + part(3).try_cast("double") + F.coalesce(F.concat(F.lit("0."), part(4), F.lit("0")).try_cast("double"), F.lit(0.0))
    micros_ = F.greatest(F.lit(0.0), value.try_cast("long") / 1e6)
    return F.when(~line.contains("="), None).when(key.isin("out_time_us", "out_time_ms"), F.when(value.try_cast("long").isNotNull(), micros_)).when((key == "out_time") & (hms != ""), seconds)


def duration_tolerance(total: Column | str) -> Column:
    return F.greatest(F.lit(1.0), 0.02 * col(total))


def expected_frames(seconds: Column | str, num: Column | str, den: Column | str) -> Column:
    """floor(seconds * num/den + 1/2) in decimals."""
    x = F.round(col(seconds), 6).cast("decimal(20,6)") * col(num).cast("decimal(10,0)") / col(den).cast("decimal(10,0)")
    return F.floor(x + F.lit(0.5).cast("decimal(2,1)")).cast("long")


def frames_to_seconds(n: Column | str, num: Column | str, den: Column | str) -> Column:
    return col(n) * col(den) / col(num)


def even_dimension(v: Column | str) -> Column:
    v = col(v).cast("long")
    return F.greatest(F.lit(16), v - v % 2)


def luma(r: Column | str, g: Column | str, b: Column | str) -> Column:
    """Integer BT.601 luma."""
    return F.shiftright((77 * col(r) + 151 * col(g) + 28 * col(b)).cast("int"), 8)


def memory_tier(available: Column | str, reserve: int = 1 << 30, tiers=((6 << 30, 4, 120, "ok"), (2 << 30, 2, 64, "tight"), (0, 1, 16, "critical"))) -> Column:
    """Struct (workers, cluster, tier) of the first tier that the usable bytes reach; unknown when null."""
    usable = F.greatest(F.lit(0), col(available) - reserve)
    out = None
    for least, workers, cluster, name in tiers:
        row = F.struct(F.lit(workers).alias("workers"), F.lit(cluster).alias("cluster"), F.lit(name).alias("tier"))
        out = F.when(usable >= least, row) if out is None else out.when(usable >= least, row)
    whole = F.struct(F.lit(tiers[0][1]).alias("workers"), F.lit(tiers[0][2]).alias("cluster"), F.lit("unknown").alias("tier"))
    return F.when(col(available).isNull(), whole).otherwise(out)


def segment_speed(target_us: Column | str, material_us: Column | str, width: Column | str, length: Column | str) -> Column:
    """Speed that keeps the source inside its material: 1 when within 2 %, slowed when it would run over."""
    target, material = col(target_us).cast("double"), col(material_us).cast("double")
    raw = F.greatest(F.lit(0.05), (F.greatest(F.lit(0.1), F.least(col(length), col(width))) - 1e-3) / (target / 1e6))
    speed = F.round(F.when((F.abs(raw - 1) <= 0.02) & (target <= material), 1.0).otherwise(raw), 6)
    return F.when(F.round(target * speed) > material, F.round(F.greatest(F.lit(0.05), (material - 1000) / target), 6)).otherwise(speed)


def interpolate_stage(base: Column | str, span: Column | str, current: Column | str, total: Column | str, done: bool = True) -> Column:
    """Percent inside a stage: base + span * share, one decimal; ``done``: current counts finished parts."""
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (col(current) + (0 if done else 1)) / col(total)))
    return F.when(col(total) > 0, F.round(col(base) + col(span) * share, 1)).otherwise(col(base).cast("double"))
