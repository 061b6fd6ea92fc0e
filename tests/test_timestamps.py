"""Times against the zone rules of the standard library, edge cases, and the whole table."""

from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seogo.operators.timestamps import found_times, normalise_times, zone_intervals

CASES = [
    ("2024-06-19T23:33:00+09:00", None, "2024-06-19T14:33:00"), ("D:20201228123028+09'00'", None, "2020-12-28T03:30:28"), ("Mon, 11 Sep 2023 20:45:05 +0000", None, "2023-09-11T20:45:05"),
    ("2025-09-17 14:36:28 CEST", "UTC", "2025-09-17T12:36:28"), ("16.05.2023 10:16", "Europe/Berlin", "2023-05-16T08:16:00"), ("05/29/2023 1:00 PM", "UTC", "2023-05-29T13:00:00"),
    ("2022. 9. 21. 오후 12:49", "UTC", "2022-09-21T12:49:00"), ("2024년 2월 12일 (월) 오전 12시 5분", "UTC", "2024-02-12T00:05:00"), ("Mon Nov 10 03:21:44 CET 2025", None, "2025-11-10T02:21:44"),
    ("Dec 26, 2025 6:56 AM UTC", None, "2025-12-26T06:56:00"), ("20220217T040514Z", None, "2022-02-17T04:05:14"), ("20210620", None, "2021-06-19T15:00:00"), ("20200222224400", "UTC", "2020-02-22T22:44:00"),
    ("1580550743", "Asia/Tokyo", "2020-02-01T09:52:23"), ("1766053250681", None, "2025-12-18T10:20:50"), ("1728186163753093", None, "2024-10-06T03:42:43"), ("45678.760417", "UTC", "2025-01-21T18:15:00"),
    ("  2021-01-28 05:37 ", "UTC", "2021-01-28T05:37:00"), ("2023.06.01 01:48", None, "2023-05-31T16:48:00"), ("2020-08-16T14:10:26.999+0900", None, "2020-08-16T05:10:26"),
    # twice: the earlier; skipped: moved on by the gap
    ("2023-10-29 02:15", "Europe/Berlin", "2023-10-29T00:15:00"), ("2021.11.07 01:52", "America/New_York", "2021-11-07T05:52:00"), ("2024-03-10 02:30:00", "America/New_York", "2024-03-10T07:30:00"),
    ("2024-13-05T08:00:00Z", None, None), ("2023-02-30", None, None), ("25:00", None, None), ("-", None, None), ("", None, None), (None, None, None), ("작성 중", None, None), ("2024-05-05 08:00 XQZ", None, None),
    ("2024-05-05 08:00", "No/Where", "2024-05-04T23:00:00"), ("x" * 100_000, None, None),
]


def test_formats_zones_and_non_times(spark):
    df = spark.createDataFrame([(i, v, z) for i, (v, z, _) in enumerate(CASES)], "i int, v string, z string")
    got = {r.i: r.utc_second for r in normalise_times(df, "v", "z").collect()}
    for i, (v, z, want) in enumerate(CASES):
        second = None if want is None else int(datetime.fromisoformat(want).replace(tzinfo=timezone.utc).timestamp())
        assert got[i] == second, (v, z, want, got[i])


def test_names_repeats_and_empty_tables(spark):
    df = spark.createDataFrame([("2024-01-01", "Asia/Seoul", 1, "a", 9)] * 2, "`v.x` string, _t_local string, _t_row int, how string, utc_second int")
    out = normalise_times(df, "v.x", "_t_local", how="how")
    assert out.columns == ["v.x", "_t_local", "_t_row", "utc_second", "how"] and out.count() == 2
    assert {(r.utc_second, r.how) for r in out.collect()} == {(1704034800, "local")}
    assert normalise_times(df.limit(0), "v.x").count() == 0


@settings(max_examples=60, deadline=None)
@given(st.sampled_from(["Europe/Berlin", "America/New_York", "Australia/Lord_Howe", "Africa/Casablanca", "Asia/Kolkata"]), st.integers(0, 86400 * 365 * 55))
def test_intervals_agree_with_zone_rules(zone, second):
    """Every UTC second's local time lies in an interval with its offset."""
    tz = ZoneInfo(zone)
    offset = int(datetime.fromtimestamp(second, timezone.utc).astimezone(tz).utcoffset().total_seconds())
    local = second + offset
    year = (datetime(1970, 1, 1) + timedelta(seconds=local)).year
    spans = next(s for _, y, s in _intervals(zone) if y == year)
    assert offset in {s["off"] for s in spans if s["lo"] <= local < s["hi"] and not s["gap"]}


_cache = {}


def _intervals(zone):
    return _cache.setdefault(zone, zone_intervals(zone))


def test_found_times_against_brute_force(spark, data):
    """Values without a zone, resolved here by trying both folds."""
    chunks = spark.read.parquet(f"{data}/chunks.parquet")
    got = {(r.chunk_id, r.field_name): r.utc_second for r in found_times(chunks).collect()}
    checked = 0
    for r in chunks.collect():
        for name in ("sent_at", "created_at", "modified_at"):
            v = r[name]
            if not v or len(v.strip()) != 19 or v.strip()[10] not in "T " or v.strip()[4] != "-":
                continue
            try:
                wall = datetime.fromisoformat(v.strip())
            except ValueError:
                assert (r.chunk_id, name) not in got
                continue
            zone = ZoneInfo((r.extra or {}).get("tz") or "Asia/Seoul")
            assert got[r.chunk_id, name] == int(wall.replace(tzinfo=zone, fold=0).timestamp()), (v, zone)
            checked += 1
    assert checked > 20


@pytest.mark.parametrize("kind", ["null", "empty"])
def test_found_times_without_values(spark, kind):
    df = spark.createDataFrame([(None, None, None, None, None, 1)] if kind == "null" else [], "chunk_id string, sent_at string, created_at string, modified_at string, extra map<string,string>, field_name int")
    assert found_times(df).count() == 0
