"""Text expressions: normalisation, containment similarity, redaction, names and displays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from splicefind.functions.vectors import col


# Results must equal those of the tool that this follows, so these patterns are given as they are.
NOT_KEPT = r"[^0-9a-z\u3400-\u9fff]+"
REDACTIONS = (
    (r"(?i)([?&](?:token|session|svl_session|api_key)=)[^&\s\"']*", "$1<REDACTED>"),
    (r"(?i)\bfile://[^\s\"'<>|]*?([^/\s\"'<>|]*)(?=[\s\"'<>|]|$)", "file://<PATH:$1>"),
    (r"(?i)\b((?:https?|ftp)://[^\s\"'<>|?]+)\?[^\s\"'<>|]+", "$1?<REDACTED>"),
    (r"\b[A-Za-z]:[\\/](?:[^\s\"'<>|\\/]*[\\/])*([^\s\"'<>|\\/]*)", "<PATH:$1>"),
    (r"\\\\[^/\s\"'<>|]*?([^\\/\s\"'<>|]*)(?=[\s\"'<>|]|$)", "<PATH:$1>"),
    (r"(?<![\w:/.>])/(?:Users|home|var|opt|mnt|media|srv)/(?:[^\s\"'<>|/]*/)*([^\s\"'<>|/]*)", "<PATH:$1>"),
)


def normalize_text(s: Column | str) -> Column:
    """Lower case, letters a-z, digits and CJK ideographs only; null is empty."""
    return F.regexp_replace(F.lower(F.coalesce(col(s), F.lit(""))), NOT_KEPT, "")


def is_content(s: Column | str, watermarks: tuple[str, ...] = ()) -> Column:
    """Normalised length of 3 or more and no watermark inside."""
    n = normalize_text(s)
    out = F.length(n) >= 3
    for w in watermarks:
        out = out & ~n.contains(w)
    return out


def grams(s: Column | str, n: int = 3) -> Column:
    """Distinct character n-grams of the normalised text; shorter texts are one gram, empty ones none."""
    t = normalize_text(s)

    def windows(c: Column) -> Column:
        return F.array_distinct(F.transform(F.slice(c, 1, F.greatest(F.size(c) - (n - 1), F.lit(0))), lambda x, i: F.concat(x, *[F.get(c, i + k) for k in range(1, n)])))

    # a one-element array binds the characters once for the lambda, so a long text is split once
    many = F.transform(F.array(F.split(t, "")), windows)[0]
    return F.when(F.length(t) == 0, F.array().cast("array<string>")).when(F.length(t) < n, F.array(t)).otherwise(many)


def containment(a: Column | str, b: Column | str) -> Column:
    """Symmetric mean of the shares that two gram sets have in common; 0 when one is empty."""
    a, b = col(a), col(b)
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), (both / F.size(a) + both / F.size(b)) / 2).otherwise(0.0)


def redact_text(s: Column | str) -> Column:
    """Mask secrets in queries, url queries and absolute paths (their last part stays), in this order."""
    out = col(s)
    for pattern, masked in REDACTIONS:
        out = F.regexp_replace(out, pattern, masked)
    return out


def error_summary(s: Column | str, most: int = 400) -> Column:
    """White space collapsed, cut with an ellipsis."""
    flat = F.trim(F.regexp_replace(F.coalesce(col(s), F.lit("")), r"\s+", " "))
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.substring(flat, 1, most), F.lit("…")))


def natural_key(s: Column | str) -> Column:
    """A string that sorts digit runs by value: each run padded to 20 places, lower case."""
    parts = F.regexp_extract_all(F.lower(col(s)), F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d+$"), F.lpad(p, 20, "0")).otherwise(p)), "")


def stem(s: Column | str) -> Column:
    return F.regexp_replace(F.regexp_extract(col(s), r"([^/\\]*)$", 1), r"(?<=.)\.[^.]*$", "")


def edl_reel(s: Column | str) -> Column:
    """Eight upper-case letters or digits of the stem, padded; AX when there are none."""
    clean = F.upper(F.regexp_replace(stem(F.coalesce(col(s), F.lit("AX"))), "[^A-Za-z0-9]", ""))
    return F.rpad(F.substring(F.when(clean == "", F.lit("AX")).otherwise(clean), 1, 8), 8, " ")


def edl_title(s: Column | str) -> Column:
    out = F.substring(F.regexp_replace(stem(F.coalesce(col(s), F.lit("LOCATED"))), r"[^A-Za-z0-9 _.-]", "_"), 1, 70)
    return F.when(out == "", F.lit("LOCATED")).otherwise(out)


def name_hash(s: Column | str) -> Column:
    return F.substring(F.sha2(col(s).cast("string"), 256), 1, 8)


def fingerprint(*cols: str) -> Column:
    """sha1 of the columns as JSON, keys in name order."""
    return F.sha1(F.to_json(F.struct(*sorted(cols))))


def clip_stem(start: Column | str, end: Column | str) -> Column:
    return F.format_string("og%s-%s", F.round(col(start), 1).cast("decimal(18,1)"), F.round(col(end), 1).cast("decimal(18,1)"))


def clock(seconds: Column | str, tenths: bool = True) -> Column:
    """mm:ss.t, with hours from one hour on."""
    n = F.floor(F.greatest(F.coalesce(col(seconds), F.lit(0.0)), F.lit(0.0)) * 10 + 0.5).cast("long")
    t, total = n % 10, F.floor(n / 10).cast("long")
    h, m, s = F.floor(total / 3600).cast("long"), F.floor(total / 60).cast("long") % 60, total % 60
    base = F.when(h > 0, F.format_string("%02d:%02d:%02d", h, m, s)).otherwise(F.format_string("%02d:%02d", m, s))
    return F.concat(base, F.lit("."), t.cast("string")) if tenths else base


def duration(seconds: Column | str) -> Column:
    total = F.floor(F.greatest(F.coalesce(col(seconds), F.lit(0.0)), F.lit(0.0)) + 0.5).cast("long")
    h, m, s = F.floor(total / 3600).cast("long"), F.floor((total % 3600) / 60).cast("long"), total % 60
    return F.concat_ws(" ", F.when(h > 0, F.format_string("%dh", h)), F.when(m > 0, F.format_string("%dm", m)), F.format_string("%ds", s))


BYTE_UNITS = ("B", "KB", "MB", "GB", "TB")


def byte_size(n: Column | str, largest: str = "TB") -> Column:
    """Byte count in words; sizes beyond the unit ``largest`` stay in it."""
    n = col(n).cast("double")
    out = F.lit(None).cast("string")
    for i, unit in reversed(list(enumerate(BYTE_UNITS[: BYTE_UNITS.index(largest) + 1]))):
        v = n / float(1024**i)
        text = F.concat(F.when(v >= 10, F.round(v, 0).cast("long").cast("string")).otherwise(F.round(v, 1).cast("decimal(18,1)").cast("string")), F.lit(f" {unit}"))
        out = F.coalesce(out, F.when(n >= float(1024**i), text))
    return F.when(n.isNull() | (n <= 0), F.lit("—")).otherwise(out)


def base_name(s: Column | str) -> Column:
    return F.regexp_extract(col(s), r"([^/\\]*)[/\\]*$", 1)


def is_absolute(s: Column | str) -> Column:
    return col(s).rlike(r"^(/|\\\\|[A-Za-z]:[\\/])")
