"""Normalising mixed timestamp texts to one UTC second.

Plan: a text is classified by shape and taken apart by JVM-side expressions; texts that carry an
offset are done. The others are local times and are resolved by an as-of join against zone-offset
intervals in local time, exploded to one row per (zone, local year). Two intervals that hold a
local time mean it occurs twice (the earlier instant wins), no interval means it was skipped (it
is moved on by the length of the gap), one gives the offset.

The interval side holds at most (zones of the tz database, ~600) x (201 years) rows and only the
zones that occur, so broadcasting it is bounded whatever the size of the data.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo, available_timezones

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_ZONE = "Asia/Seoul"
FIRST_YEAR, LAST_YEAR = 1900, 2100

# Zone abbreviations and their offsets from UTC in minutes.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "BST": 60, "WEST": 60, "CET": 60, "CEST": 120,
    "MEZ": 60, "MESZ": 120, "EET": 120, "EEST": 180, "MSK": 180, "IST": 330, "SGT": 480, "HKT": 480,
    "KST": 540, "JST": 540, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780, "EST": -300,
    "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
}

_TIME = r"\d{1,2}:\d{2}(?::\d{2}(?:[.,]\d{1,9})?)?"
_HALF = r"(?:[AaPp][Mm]|오전|오후)"
_CLOCK = rf"(?:{_HALF}\s*)?(?:{_TIME}(?:\s*{_HALF})?|\d{{1,2}}시(?:\s*\d{{1,2}}분)?(?:\s*\d{{1,2}}초)?)"
_ZONE = r"(?:\s*(?:Z|(?:UTC|GMT)?[+-]\d{2}(?::?\d{2}|'\d{2}'?)?|[A-Z]{2,5}))?"
_MONTH = r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?"
_DAY = r"(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)[a-z]*"

# Shape of each family, tried in this order; every pattern spans the whole trimmed text.
SHAPES = {
    "ymd": rf"^\d{{4}}([-/.])\s?\d{{1,2}}\1\s?\d{{1,2}}\.?(?:(?:T|\s+){_CLOCK}{_ZONE})?$",
    "rfc": rf"^(?:{_DAY},?\s+)?\d{{1,2}}\s+{_MONTH}\s+\d{{4}}(?:,?\s+{_CLOCK}{_ZONE})?$",
    "pdf": rf"^D:\d{{14}}{_ZONE}$",
    "num": r"^\d+(?:\.\d+)?$",
    "dmy": rf"^\d{{1,2}}\.\s?\d{{1,2}}\.\s?\d{{4}}(?:,?\s+{_CLOCK}{_ZONE})?$",
    "kor": rf"^\d{{4}}년\s*\d{{1,2}}월\s*\d{{1,2}}일(?:\s*\([월화수목금토일]\))?(?:\s*{_CLOCK}{_ZONE})?$",
    "mdy": rf"^\d{{1,2}}/\d{{1,2}}/\d{{4}}(?:,?\s+{_CLOCK}{_ZONE})?$",
    "dat": rf"^{_DAY}\s+{_MONTH}\s+\d{{1,2}}\s+{_TIME}(?:\s+[A-Z]{{1,5}})?\s+\d{{4}}$",
    "us": rf"^(?:{_DAY},?\s+)?{_MONTH}\s+\d{{1,2}},\s+\d{{4}}(?:,?\s+{_CLOCK}{_ZONE})?$",
    "cmp": rf"^\d{{8}}T\d{{4}}(?:\d{{2}})?{_ZONE}$",
}
# Positions of year, month, day and hour among the digit runs; month -1: taken from its name.
_PLACES = {"ymd": (0, 1, 2, 3), "kor": (0, 1, 2, 3), "dmy": (2, 1, 0, 3), "mdy": (2, 0, 1, 3), "rfc": (1, -1, 0, 2), "us": (1, -1, 0, 2), "dat": (None, -1, 0, 1)}

_INTERVALS = "zone string, year int, spans array<struct<lo: bigint, hi: bigint, off: bigint, gap: boolean>>"


def _offset(zone: ZoneInfo, second: int) -> int:
    at = datetime.fromtimestamp(second, timezone.utc).astimezone(zone)
    return int(at.utcoffset().total_seconds())


def _utc_spans(zone: ZoneInfo) -> list[tuple[int, int, int]]:
    """(first second, second after the last, offset) of each stretch of constant offset, in UTC."""
    start = int(datetime(FIRST_YEAR, 1, 1, tzinfo=timezone.utc).timestamp()) - 2 * 86400
    end = int(datetime(LAST_YEAR + 1, 1, 1, tzinfo=timezone.utc).timestamp()) + 2 * 86400
    step, spans, at = 14 * 86400, [], start
    off, began = _offset(zone, start), start
    while at < end:
        nxt = min(at + step, end)
        new = _offset(zone, nxt)
        if new != off:
            lo, hi = at, nxt
            while hi - lo > 1:
                mid = (lo + hi) // 2
                lo, hi = (mid, hi) if _offset(zone, mid) == off else (lo, mid)
            spans.append((began, hi, off))
            began, off, at = hi, _offset(zone, hi), hi
        else:
            at = nxt
    spans.append((began, end, off))
    return spans


def zone_intervals(name: str) -> list[tuple[str, int, list[dict]]]:
    """Local-time intervals of one zone by local year; the first and last one are open-ended."""
    spans = _utc_spans(ZoneInfo(name))
    far = 10**13
    rows: list[tuple[int, int, int, bool]] = []
    for k, (lo, hi, off) in enumerate(spans):
        rows.append((lo + off if k else -far, hi + off if k + 1 < len(spans) else far, off, False))
        if k + 1 < len(spans) and (after := spans[k + 1][2]) > off:
            rows.append((hi + off, hi + after, off, True))
    by_year: dict[int, list[dict]] = {}
    epoch = datetime(1970, 1, 1)

    def year(second: int) -> int:
        if abs(second) >= far:
            return FIRST_YEAR if second < 0 else LAST_YEAR
        return min(max((epoch + timedelta(seconds=second)).year, FIRST_YEAR), LAST_YEAR)

    for lo, hi, off, gap in rows:
        for y in range(year(lo), year(hi - 1 if hi < far else hi) + 1):
            by_year.setdefault(y, []).append({"lo": lo, "hi": hi, "off": off, "gap": gap})
    return [(name, y, spans) for y, spans in by_year.items()]


def _interval_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known = available_timezones()
    for batch in batches:
        rows = [r for z in batch["zone"] if z in known for r in zone_intervals(z)]
        yield pd.DataFrame(rows, columns=["zone", "year", "spans"])


def _digits(nums: Column, place: int | None) -> Column:
    return F.lit(None).cast("int") if place is None else F.get(nums, F.lit(place)).try_cast("int")


def _parts(value: Column) -> dict[str, Column]:
    """Columns of the parsed text, built in stages so that each regular expression runs once."""
    kind = F.lit(None).cast("string")
    for name, shape in reversed(SHAPES.items()):
        kind = F.when(value.rlike(shape), name).otherwise(kind)
    return {"kind": kind}


def parse_times(df: DataFrame, value: str, prefix: str = "_t_") -> DataFrame:
    """Add ``{prefix}local`` (seconds of the wall clock), ``{prefix}off`` (offset seconds, null when
    the text has no zone) and ``{prefix}utc`` (epoch numbers, which need neither). All null: no time."""
    p = lambda x: F.col(prefix + x)
    trimmed = F.regexp_replace(F.col(value), r"(?U)^\s+|\s+$", "")
    df = df.withColumn(prefix + "v", trimmed)
    df = df.withColumn(prefix + "kind", _parts(p("v"))["kind"])
    # a zone at the end; in the date(1) form it stands before the year
    zone = F.when(p("kind") == "dat", F.regexp_extract(p("v"), r"([A-Z]{1,5})\s+\d{4}$", 1)).when(
        p("kind").isin("num") | ~p("v").rlike(r"\d(?::?\d\d|분|초|시|\s*[AaPp][Mm])?\s*(?:Z|(?:UTC|GMT)?[+-]\d{2}(?::?\d{2}|'\d{2}'?)?|[A-Z]{2,5})$"), ""
    ).when(
        p("v").rlike(r"\d[-]\d{2}$") & ~p("v").rlike(r":\d{2}(?:\.\d+)?-\d{2}$"), ""
    ).otherwise(F.regexp_extract(p("v"), r"(Z|(?:UTC|GMT)?[+-]\d{2}(?::?\d{2}|'\d{2}'?)?|[A-Z]{2,5})$", 1))
    df = df.withColumn(prefix + "zone", F.when(zone.isin("AM", "PM"), "").otherwise(zone))
    body = F.when(p("kind") == "dat", p("v")).otherwise(F.expr(f"left({prefix}v, length({prefix}v) - length({prefix}zone))"))
    df = df.withColumn(prefix + "n", F.when(p("kind") != "num", F.regexp_extract_all(body, F.lit(r"(\d+)"), F.lit(1))))
    nums, kind, v = p("n"), p("kind"), p("v")
    packed = F.when(kind == "pdf", F.substring(v, 3, 14)).when(kind == "cmp", F.rpad(F.concat(F.substring(v, 1, 8), F.get(nums, F.lit(1))), 14, "0")).when((kind == "num") & F.length(v).isin(8, 12, 14) & ~v.contains("."), F.rpad(v, 14, "0"))
    df = df.withColumn(prefix + "p", packed)
    month_name = (F.expr(f"locate(regexp_extract({prefix}v, '(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)', 1), 'JanFebMarAprMayJunJulAugSepOctNovDec')") + 2) / 3

    def field(k: int, start: int, width: int) -> Column:
        c = F.when(p("p").isNotNull(), F.substring(p("p"), start, width).try_cast("int"))
        for name, places in _PLACES.items():
            if k == 1 and places[1] == -1:
                got = month_name.cast("int")
            elif k < 3:
                got = _digits(nums, places[k]) if places[k] is not None else F.element_at(nums, -1).try_cast("int")
            else:
                got = _digits(nums, places[3] + k - 3)
                # in the date(1) form the year ends the digit runs
                got = F.when(F.size(nums) > places[3] + k - 3 + (1 if name == "dat" else 0), got) if name == "dat" else got
            c = c.when(kind == name, got)
        return c

    y, mo, d, h, mi, s = (field(k, *w) for k, w in enumerate(((1, 4), (5, 2), (7, 2), (9, 2), (11, 2), (13, 2))))
    df = df.withColumns({prefix + "y": y, prefix + "mo": mo, prefix + "d": d, prefix + "h": F.coalesce(h, F.lit(0)), prefix + "mi": F.coalesce(mi, F.lit(0)), prefix + "s": F.coalesce(s, F.lit(0))})
    half = F.when(v.rlike("(?i)pm|오후"), 12).when(v.rlike("(?i)am|오전"), 0)
    clock = F.when(half.isNull() | ~p("kind").isin("ymd", "kor", "dmy", "mdy", "us", "rfc"), p("h")).when(p("h").between(1, 12), p("h") % 12 + half)
    day = F.expr(f"unix_date(try_to_date(concat(lpad({prefix}y, 4, '0'), '-', lpad({prefix}mo, 2, '0'), '-', lpad({prefix}d, 2, '0')), 'yyyy-MM-dd'))")
    sane = clock.between(0, 23) & p("mi").between(0, 59) & p("s").between(0, 59) & (p("y") >= 1)
    serial = (kind == "num") & v.rlike(r"^\d{5}(?:\.\d+)?$")
    local = F.when(serial, F.round((v.try_cast("decimal(20,10)") - 25569) * 86400).cast("bigint")).when(sane, day.cast("bigint") * 86400 + clock * 3600 + p("mi") * 60 + p("s"))
    # epoch numbers: seconds, milli- or microseconds by their length
    epoch = F.when((kind == "num") & ~v.contains("."), F.when(F.length(v) == 10, v.try_cast("bigint")).when(F.length(v) == 13, F.expr(f"try_cast({prefix}v as bigint) div 1000")).when(F.length(v) == 16, F.expr(f"try_cast({prefix}v as bigint) div 1000000")))
    named = F.element_at(F.create_map(*(F.lit(x) for kv in ABBREVIATIONS.items() for x in kv)), p("zone"))
    sign = F.when(p("zone").contains("-"), -1).otherwise(1)
    zone_digits = F.regexp_replace(p("zone"), r"\D", "")
    minutes = F.when(p("zone").rlike(r"[+-]\d"), sign * (F.substring(zone_digits, 1, 2).try_cast("int") * 60 + F.coalesce(F.substring(zone_digits, 3, 2).try_cast("int"), F.lit(0)))).when(p("zone") != "", named)
    df = df.withColumns({prefix + "local": local, prefix + "off": minutes.cast("bigint") * 60, prefix + "utc": epoch})
    # a zone that is written but not known makes the value no time
    df = df.withColumn(prefix + "local", F.when((p("zone") == "") | p("off").isNotNull(), p("local")))
    return df.drop(*(prefix + x for x in ("v", "kind", "zone", "n", "p", "y", "mo", "d", "h", "mi", "s")))


def normalise_times(df: DataFrame, value: str, tz: str | None = None, *, utc: str = "utc_second", how: str | None = None, default_zone: str = DEFAULT_ZONE) -> DataFrame:
    """``df`` with the bigint column ``utc``: the instant named by the text column ``value``.

    ``tz`` names a column with the zone of texts without one; null or unknown zones fall back to
    ``default_zone``. Defined results: null, empty and unparsable texts give null; times that occur
    twice give the earlier instant; skipped ones are moved on by the gap; local years before 1900
    or after 2100 use the first or last known offset. ``how`` adds a column that says
    which case applied (epoch, offset, local, ambiguous, skipped; null for no time). Every row
    of ``df`` comes out exactly once with all its columns, whatever their names; existing columns named
    like the results are replaced.
    """
    quoted = lambda c: F.col(f"`{c}`")
    kept = [c for c in df.columns if c not in (utc, how)]
    zone = quoted(tz).cast("string") if tz else F.lit(None).cast("string")
    # the caller's row travels in one struct, so that no name of it can clash with a working column
    row = F.struct(*(quoted(c) for c in kept)) if kept else F.lit(None).cast("struct<none:int>")
    base = df.select(row.alias("_t_row"), quoted(value).cast("string").alias("_t_value"), F.coalesce(zone, F.lit(default_zone)).alias("_t_tz"))
    zones = base.select(F.col("_t_tz").alias("zone")).union(df.sparkSession.createDataFrame([(default_zone,)], "zone string")).distinct()
    spans = zones.mapInPandas(_interval_batches, _INTERVALS)
    have = spans.select(F.col("zone").alias("_t_tz"), F.col("year").alias("_t_year"), F.col("spans").alias("_t_spans"))
    parsed = parse_times(base, "_t_value")
    year = F.least(F.greatest(F.year(F.date_from_unix_date((F.col("_t_local") / 86400).cast("int"))), F.lit(FIRST_YEAR)), F.lit(LAST_YEAR))
    parsed = parsed.withColumn("_t_year", F.when(F.col("_t_off").isNull() & F.col("_t_local").isNotNull(), year))
    joined = parsed.join(F.broadcast(have), ["_t_tz", "_t_year"], "left")
    fallback = have.filter(F.col("_t_tz") == default_zone).select("_t_year", F.col("_t_spans").alias("_t_own"))
    joined = joined.join(F.broadcast(fallback), "_t_year", "left").withColumn("_t_spans", F.coalesce("_t_spans", "_t_own"))
    hit = F.filter("_t_spans", lambda x: (x["lo"] <= F.col("_t_local")) & (F.col("_t_local") < x["hi"]) & ~x["gap"])
    gap = F.filter("_t_spans", lambda x: (x["lo"] <= F.col("_t_local")) & (F.col("_t_local") < x["hi"]) & x["gap"])
    joined = joined.withColumns({"_t_hit": hit, "_t_gap": gap})
    offset = F.when(F.size("_t_hit") > 0, F.array_max(F.transform("_t_hit", lambda x: x["off"]))).otherwise(F.array_max(F.transform("_t_gap", lambda x: x["off"])))
    joined = joined.withColumn("_t_out", F.coalesce(F.col("_t_utc"), F.col("_t_local") - F.coalesce(F.col("_t_off"), offset)))
    case = F.when(F.col("_t_out").isNull(), F.lit(None).cast("string")).when(F.col("_t_utc").isNotNull(), "epoch").when(F.col("_t_off").isNotNull(), "offset").when(F.size("_t_hit") > 1, "ambiguous").when(F.size("_t_hit") == 1, "local").otherwise("skipped")
    return joined.select(*(F.col("_t_row")[c].alias(c) for c in kept), F.col("_t_out").alias(utc), *([case.alias(how)] if how else []))


def found_times(chunks: DataFrame) -> DataFrame:
    """(chunk_id, field_name, utc_second) of every time in ``sent_at``, ``created_at``, ``modified_at``."""
    names = ("sent_at", "created_at", "modified_at")
    fields = F.array(*(F.struct(F.lit(n).alias("field_name"), F.col(n).alias("value")) for n in names))
    values = chunks.select("chunk_id", F.col("extra")["tz"].alias("tz"), F.explode(F.filter(fields, lambda x: x["value"].isNotNull())).alias("x")).select("chunk_id", "tz", "x.field_name", "x.value").distinct()
    out = normalise_times(values, "value", "tz")
    return out.filter(F.col("utc_second").isNotNull()).select("chunk_id", "field_name", "utc_second").distinct()
