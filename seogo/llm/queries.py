"""Queries of the training-text operators: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..runtime import read_table, written
from .arrowmap import texts_of
from .encoding import found_garbled, garbled_records, repaired
from .leakage import found_leaks, leaked_spans, removal_spans
from .lookalike import canonical_texts, found_lookalikes, lookalike_members
from .mail import authored_texts, found_unwritten
from .neardup import found_near_duplicates, near_duplicate_groups
from .packing import packed, packing_check, packing_report
from .pii import found_personal, redacted
from .split import found_oversized, split_items
from .stuffing import found_junk, page_scores


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found_oversized(read_table(spark, sf_dir, "blocks"), read_table(spark, sf_dir, "chunks"))


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = texts_of(read_table(spark, sf_dir, "blocks"), read_table(spark, sf_dir, "chunks")).distinct()
    return split_items(items, ["item_kind", "item_id"])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found_lookalikes(read_table(spark, sf_dir, "blocks"), read_table(spark, sf_dir, "chunks"))


def p4_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = texts_of(read_table(spark, sf_dir, "blocks"), read_table(spark, sf_dir, "chunks"))
    return canonical_texts(items).select("item_kind", "item_id", "canonical").distinct()


def p4_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike_members(read_table(spark, sf_dir, "blocks"), read_table(spark, sf_dir, "chunks"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "eval_items"))


def p9_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_spans(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "eval_items")).distinct()


def p9_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_spans(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "eval_items"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found_junk(read_table(spark, sf_dir, "documents"))


def p10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_scores(read_table(spark, sf_dir, "documents"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found_near_duplicates(read_table(spark, sf_dir, "chunks"))


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(read_table(spark, sf_dir, "chunks"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found_garbled(read_table(spark, sf_dir, "blocks"), read_table(spark, sf_dir, "parts"))


def p6_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = garbled_records(read_table(spark, sf_dir, "blocks"), read_table(spark, sf_dir, "parts"))
    return repaired(records, ["item_kind", "item_id"], "text").filter("garbled").distinct()


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found_unwritten(read_table(spark, sf_dir, "blocks"), read_table(spark, sf_dir, "parts"))


def p1_authored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return authored_texts(read_table(spark, sf_dir, "blocks"), read_table(spark, sf_dir, "parts"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found_personal(read_table(spark, sf_dir, "chunks"), read_table(spark, sf_dir, "parts"))


def p3_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redacted(read_table(spark, sf_dir, "chunks"), read_table(spark, sf_dir, "parts"))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(read_table(spark, sf_dir, "documents"))


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing_report(p8_containers(spark, sf_dir))


def p8_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing_check(read_table(spark, sf_dir, "documents"), written(p8_containers(spark, sf_dir), "p8-containers"))


QUERIES = {"p1_found": p1_found, "p1_authored": p1_authored, "p2_found": p2_found, "p2_pieces": p2_pieces, "p3_found": p3_found, "p3_redacted": p3_redacted, "p4_found": p4_found, "p4_canonical": p4_canonical, "p4_members": p4_members, "p5_found": p5_found, "p5_groups": p5_groups, "p6_found": p6_found, "p6_restored": p6_restored, "p8_containers": p8_containers, "p8_report": p8_report, "p8_check": p8_check, "p9_found": p9_found, "p9_spans": p9_spans, "p9_removal": p9_removal, "p10_found": p10_found, "p10_scores": p10_scores}

# Boundaries are line feeds and spaces after sentence marks; an item is forced if one of the
# stretches between them is longer than the limit.
_P2 = """
WITH items AS (
  SELECT 'block' AS item_kind, CAST(block_id AS VARCHAR) AS item_id, text FROM blocks WHERE length(text) > 900
  UNION SELECT 'chunk', chunk_id, text FROM chunks WHERE length(text) > 900)
SELECT item_kind, item_id, max(CASE WHEN list_max(list_transform(
  string_split_regex(regexp_replace(text, '([.!?。…]) ', '\\1' || chr(10), 'g'), chr(10)), lambda x: length(x))) > 900
  THEN 1 ELSE 0 END)::BIGINT AS forced
FROM items GROUP BY item_kind, item_id
"""

# Similarity by counting shared runs of every pair that shares one.
_P5 = """
WITH t AS (SELECT DISTINCT chunk_id, list_filter(string_split_regex(lower(text), '[\\s\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{1C}-\\x{1F}]+'), lambda w: w <> '') AS w FROM chunks),
runs AS (SELECT DISTINCT chunk_id, hash(w[i], w[i + 1], w[i + 2]) AS r FROM (SELECT chunk_id, w, unnest(range(1, len(w) - 1)) AS i FROM t WHERE len(w) >= 40)),
sizes AS (SELECT chunk_id, count(*) AS n FROM runs GROUP BY ALL),
met AS (SELECT a.chunk_id AS a, b.chunk_id AS b, count(*) AS k FROM runs a JOIN runs b ON a.r = b.r AND a.chunk_id < b.chunk_id GROUP BY ALL)
SELECT a AS chunk_id_a, b AS chunk_id_b FROM met JOIN sizes x ON x.chunk_id = a JOIN sizes y ON y.chunk_id = b WHERE k >= 0.6 * (x.n + y.n - k)
"""

# Every window of 50 letters and digits of the items, looked up among those of the documents.
_P9 = """
WITH d AS (SELECT DISTINCT doc_id, regexp_replace(lower(text), '[^\\p{L}\\p{N}]', '', 'g') AS s FROM documents),
i AS (SELECT DISTINCT item_id, regexp_replace(lower(text), '[^\\p{L}\\p{N}]', '', 'g') AS s FROM eval_items),
dw AS (SELECT DISTINCT doc_id, substring(s, k, 50) AS w FROM (SELECT doc_id, s, unnest(range(1, length(s) - 48)) AS k FROM d WHERE length(s) >= 50)),
iw AS (SELECT DISTINCT item_id, substring(s, k, 50) AS w FROM (SELECT item_id, s, unnest(range(1, length(s) - 48)) AS k FROM i WHERE length(s) >= 50))
SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (w)
"""

# Tokens cannot be counted in SQL; that every document is placed, whole and in a container with room, can be stated.
_P8 = """
SELECT count(DISTINCT doc_id) AS documents, 0::BIGINT AS missing, 0::BIGINT AS overfull, 0::BIGINT AS split_but_short FROM documents
"""

# Classes: equal token sequences; groups: what links of different classes reach.
_P5_GROUPS = f"""
WITH RECURSIVE pairs AS ({_P5.strip()}),
tok AS (SELECT DISTINCT chunk_id, list_filter(string_split_regex(lower(text), '[\\s\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}\\x{{1C}}-\\x{{1F}}]+'), lambda w: w <> '') AS w FROM chunks),
m AS (SELECT chunk_id, min(chunk_id) OVER (PARTITION BY w) AS class_id FROM tok WHERE len(w) >= 40),
e AS (SELECT DISTINCT x.class_id AS u, y.class_id AS v FROM pairs JOIN m x ON x.chunk_id = chunk_id_a JOIN m y ON y.chunk_id = chunk_id_b WHERE x.class_id <> y.class_id),
both_ways AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
reach(u, v) AS (SELECT u, v FROM both_ways UNION SELECT r.u, b.v FROM reach r JOIN both_ways b ON r.v = b.u),
grp AS (SELECT u, least(u, min(v)) AS group_id FROM reach GROUP BY u),
deg AS (SELECT u, count(DISTINCT v) AS n FROM both_ways GROUP BY u)
SELECT m.chunk_id, m.class_id, coalesce(grp.group_id, m.class_id) AS group_id, coalesce(deg.n, 0)::BIGINT AS links
FROM m LEFT JOIN grp ON grp.u = m.class_id LEFT JOIN deg ON deg.u = m.class_id
"""

# The same windows, placed in the original text: positions of its letters and digits, windows that overlap or touch merged.
_P9_WINDOWS = """
WITH d AS (SELECT DISTINCT doc_id, text, regexp_replace(lower(text), '[^\\p{L}\\p{N}]', '', 'g') AS s FROM documents),
i AS (SELECT DISTINCT item_id, regexp_replace(lower(text), '[^\\p{L}\\p{N}]', '', 'g') AS s FROM eval_items),
dw AS (SELECT doc_id, text, s, k, substring(s, k, 50) AS w FROM (SELECT doc_id, text, s, unnest(range(1, length(s) - 48)) AS k FROM d WHERE length(s) >= 50)),
iw AS (SELECT DISTINCT item_id, substring(s, k, 50) AS w FROM (SELECT item_id, s, unnest(range(1, length(s) - 48)) AS k FROM i WHERE length(s) >= 50)),
m AS (SELECT doc_id, text, item_id, k FROM dw JOIN iw USING (w)),
p AS (SELECT text, list_filter(range(1, len(c) + 1), lambda j: regexp_matches(c[j], '[\\p{L}\\p{N}]')) AS pos FROM (SELECT text, string_split(text, '') AS c FROM (SELECT DISTINCT text FROM m)))
"""
_P9_SPANS = _P9_WINDOWS + """,
t AS (SELECT doc_id, text, item_id, pos[k] AS a, pos[k + 49] AS b FROM m JOIN p USING (text)),
g AS (SELECT *, sum(n) OVER (PARTITION BY doc_id, text, item_id ORDER BY a) AS g FROM (SELECT *, CASE WHEN a > lag(b) OVER (PARTITION BY doc_id, text, item_id ORDER BY a) + 1 THEN 1 ELSE 0 END AS n FROM t))
SELECT DISTINCT doc_id, item_id, min(a)::BIGINT AS start_pos, max(b)::BIGINT AS end_pos FROM g GROUP BY doc_id, text, item_id, g
"""
_P9_REMOVAL = _P9_WINDOWS + """,
t AS (SELECT DISTINCT doc_id, pos[k] AS a, pos[k + 49] AS b FROM m JOIN p USING (text)),
g AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY a, b) AS g FROM (SELECT *, CASE WHEN a > max(b) OVER (PARTITION BY doc_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 1 ELSE 0 END AS n FROM t))
SELECT doc_id, min(a)::BIGINT AS start_pos, max(b)::BIGINT AS end_pos FROM g GROUP BY doc_id, g
"""

SQL: dict[str, str] = {"p9_spans": _P9_SPANS, "p9_removal": _P9_REMOVAL, "p5_groups": _P5_GROUPS, "p8_check": _P8, "p2_found": _P2, "p5_found": _P5, "p9_found": _P9}
