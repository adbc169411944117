"""Queries of the general data problems, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arborweave.operators import record_keys
from arborweave.session import table
from arborweave.sources import raw_records


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return record_keys.found(table(spark, sf, "sequences"))


def p1_per_key(spark: SparkSession, sf: str) -> DataFrame:
    return record_keys.per_key(table(spark, sf, "sequences"))[0]


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return raw_records.found(table(spark, sf, "raw_reads"))


def p4_loaded(spark: SparkSession, sf: str) -> DataFrame:
    return raw_records.loaded(table(spark, sf, "raw_reads"))


QUERIES = {f.__name__: f for f in (p1_found, p1_per_key, p4_found, p4_loaded)}

_P1 = """
WITH r AS (
  SELECT pos, arg_min(tid, loaded_at) AS tid, arg_min(node_to_align, loaded_at) AS nodes,
         arg_min(num_duplicates, loaded_at) AS d, arg_min(read_at, loaded_at) AS read_at
  FROM sequences GROUP BY pos),
k AS (
  SELECT 'tid' AS field, trim(tid, ' ' || chr(9)) AS heavy_key, d, read_at FROM r WHERE trim(coalesce(tid, ''), ' ' || chr(9)) <> ''
  UNION ALL
  SELECT 'node_to_align', x, d, read_at
  FROM (SELECT unnest(list_distinct(regexp_split_to_array(coalesce(nodes, ''), '\\s+'))) AS x, d, read_at FROM r) WHERE x <> ''),
g AS (
  SELECT field, heavy_key, count(*) AS n_records, CAST(coalesce(sum(d), 0) AS BIGINT) AS sum_duplicates, max(read_at) AS last_read_at
  FROM k GROUP BY field, heavy_key)
"""

_P4 = r"""
WITH l AS (SELECT line_id, batch, regexp_replace(coalesce(line, ''), '\r$', '') AS t FROM raw_reads),
q AS (
  SELECT *, regexp_full_match(t, '(?s)(?:"(?:[^"]|"")*"|[^",]*)(?:,(?:"(?:[^"]|"")*"|[^",]*))*') AS good FROM l),
f AS (
  SELECT *, CASE WHEN good THEN regexp_extract_all(',' || t, '(?s),("(?:[^"]|"")*"|[^",]*)', 1) END AS raw FROM q),
v AS (
  SELECT line_id, batch, good,
         list_transform(raw, lambda x: CASE WHEN x LIKE '"%' THEN replace(x[2:len(x) - 1], '""', '"') ELSE x END) AS p
  FROM f),
c AS (
  SELECT *, CASE
    WHEN NOT good THEN 'quoting'
    WHEN len(p) <> 6 THEN 'columns'
    WHEN NOT regexp_full_match(p[1], '[!-=?A-~][!-~]*') THEN 'name'
    WHEN NOT regexp_full_match(p[3], '[ACGTUNRYKMSWBDHVacgtunrykmswbdhv-]+') THEN 'sequence'
    WHEN p[4] <> '' AND (length(p[4]) <> length(p[3]) OR NOT regexp_full_match(p[4], '[!-~]*')) THEN 'quality'
  END AS reason FROM v)
"""

SQL = {
    "p1_found": _P1 + "SELECT field, heavy_key FROM g WHERE n_records >= 0.04 * (SELECT count(*) FROM r)",
    "p1_per_key": _P1 + "SELECT * FROM g",
    "p4_found": _P4 + "SELECT DISTINCT line_id, reason FROM c WHERE reason IS NOT NULL",
    "p4_loaded": _P4 + "SELECT line_id, batch, p[1] AS name, p[2] AS comment, p[3] AS sequence, p[4] AS quality, p[5] AS tid, TRY_CAST(trim(p[6]) AS INTEGER) AS num_duplicates FROM c WHERE reason IS NULL",
}
