"""Queries of the general data-cleaning operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.timestamps import ABBREVIATIONS, found_times
from ..runtime import read_table


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found_times(read_table(spark, sf_dir, "chunks"))


QUERIES = {"p7_found": p7_found}

# Shapes with the order in which their groups give year|month|day|half|hour|minute|second|zone.
_SHAPES = [
    (r"^(\d{4})[-/.]\s?(\d{1,2})[-/.]\s?(\d{1,2})\.?(?:[T\s]\s*(오전|오후)?\s*(\d{1,2}):(\d{2})(?::(\d{2})(?:\.\d+)?)?\s*(Z|[+-]\d{2}:?\d{2}|[A-Z]{3,4})?)?$", r"\1|\2|\3|\4|\5|\6|\7|\8"),
    (r"^(\d{4})년 (\d{1,2})월 (\d{1,2})일(?: \([월화수목금토일]\))?(?: (오전|오후) (\d{1,2})(?::|시 )(\d{1,2})분?)?$", r"\1|\2|\3|\4|\5|\6||"),
    (r"^D:(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})([+-]\d{2})''(\d{2})''?$", r"\1|\2|\3||\4|\5|\6|\7\8"),
    (r"^\w{3}, (\d{1,2}) (\w{3}) (\d{4}) (\d{2}):(\d{2}):(\d{2}) ([+-]\d{4}|[A-Z]+)$", r"\3|\2|\1||\4|\5|\6|\7"),
    (r"^\w{3} (\w{3})\s+(\d{1,2}) (\d{2}):(\d{2}):(\d{2}) ([A-Z]+) (\d{4})$", r"\7|\1|\2||\3|\4|\5|\6"),
    (r"^(\d{1,2})\.(\d{1,2})\.(\d{4}) (\d{1,2}):(\d{2})$", r"\3|\2|\1||\4|\5||"),
    (r"^(\d{1,2})/(\d{1,2})/(\d{4}) (\d{1,2}):(\d{2}) (AM|PM)$", r"\3|\1|\2|\6|\4|\5||"),
    (r"^([A-Z][a-z]{2}) (\d{1,2}), (\d{4}) (\d{1,2}):(\d{2}) (AM|PM) ([A-Z]+)$", r"\3|\1|\2|\6|\4|\5||\7"),
    (r"^(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})Z$", r"\1|\2|\3||\4|\5|\6|Z"),
    (r"^(\d{4})(\d{2})(\d{2})$", r"\1|\2|\3|||||"),
    (r"^(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})$", r"\1|\2|\3||\4|\5|\6|"),
]
_PARTS = "CASE " + " ".join(f"WHEN regexp_matches(v, '{p}') THEN regexp_replace(v, '{p}', '{r}')" for p, r in _SHAPES) + " END"
_MONTHS = "['Jan', 'Feb', 'Mar', 'Apr', 'May', 'Jun', 'Jul', 'Aug', 'Sep', 'Oct', 'Nov', 'Dec']"
_OFFSETS = "MAP {" + ", ".join(f"'{k}': {v}" for k, v in ABBREVIATIONS.items()) + "}"
_NUMBERS = "coalesce(try_cast(x[{}] AS INT), 0)"

# Epoch numbers and offsets are direct; local times go through the zone rules, and of two instants the
# earlier is the one whose local time an hour before is the same.
SQL: dict[str, str] = {
    "p7_found": rf"""
WITH raw AS (SELECT chunk_id, 'sent_at' AS field_name, sent_at AS v, extra['tz'] AS tz FROM chunks UNION ALL SELECT chunk_id, 'created_at', created_at, extra['tz'] FROM chunks UNION ALL SELECT chunk_id, 'modified_at', modified_at, extra['tz'] FROM chunks),
vals AS (SELECT DISTINCT chunk_id, field_name, trim(v) AS v, coalesce(tz, 'Asia/Seoul') AS tz FROM raw WHERE v IS NOT NULL),
cut AS (SELECT *, string_split({_PARTS}, '|') AS x FROM vals),
fields AS (SELECT *, try_cast(x[1] AS INT) AS y, coalesce(try_cast(x[2] AS INT), list_position({_MONTHS}, x[2])) AS mo, try_cast(x[3] AS INT) AS d, {_NUMBERS.format(5)} AS h0, {_NUMBERS.format(6)} AS mi, {_NUMBERS.format(7)} AS s, x[4] AS half, x[8] AS zone FROM cut),
days AS (SELECT *, try_cast(printf('%04d-%02d-%02d', y, mo, d) AS DATE) AS day, CASE WHEN half IN ('AM', '오전') THEN h0 % 12 WHEN half IN ('PM', '오후') THEN h0 % 12 + 12 ELSE h0 END AS h FROM fields),
locals AS (SELECT *, CASE WHEN regexp_matches(v, '^\d{{5}}\.\d+$') THEN CAST(round((CAST(v AS DECIMAL(20, 10)) - 25569) * 86400) AS BIGINT)
  WHEN h < 24 AND mi < 60 AND s < 60 THEN CAST(epoch(day) AS BIGINT) + h * 3600 + mi * 60 + s END AS wall,
  CASE WHEN regexp_matches(zone, '^[+-]') THEN (CASE WHEN zone[1] = '-' THEN -1 ELSE 1 END) * (CAST(zone[2:3] AS INT) * 3600 + CAST(right(zone, 2) AS INT) * 60) WHEN zone <> '' THEN {_OFFSETS}[zone] * 60 END AS off FROM days),
there AS (SELECT *, CASE WHEN coalesce(zone, '') = '' AND wall IS NOT NULL THEN CAST(epoch(make_timestamp(wall * 1000000) AT TIME ZONE tz) AS BIGINT) END AS inst FROM locals),
done AS (SELECT chunk_id, field_name, CASE WHEN regexp_matches(v, '^\d{{10}}$') THEN CAST(v AS BIGINT) WHEN regexp_matches(v, '^\d{{13}}$') THEN CAST(v AS BIGINT) // 1000 WHEN regexp_matches(v, '^\d{{16}}$') THEN CAST(v AS BIGINT) // 1000000
  WHEN coalesce(zone, '') <> '' THEN wall - off WHEN CAST(epoch(to_timestamp(inst - 3600) AT TIME ZONE tz) AS BIGINT) = wall THEN inst - 3600 ELSE inst END AS utc_second FROM there)
SELECT DISTINCT chunk_id, field_name, utc_second FROM done WHERE utc_second IS NOT NULL""",
}
