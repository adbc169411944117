"""Queries of the training-data problems, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arborweave.llm import format_copies, leaks, near_copies, packing, residue, shared_spans, topn
from arborweave.session import table


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return shared_spans.found(table(spark, sf, "contigs"))


def p2_shared_part(spark: SparkSession, sf: str) -> DataFrame:
    return shared_spans.shared_part(table(spark, sf, "contigs"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return topn.found(table(spark, sf, "hits"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return format_copies.found(table(spark, sf, "sequences"))


def p5_collapsed(spark: SparkSession, sf: str) -> DataFrame:
    return format_copies.collapsed(table(spark, sf, "sequences"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return near_copies.found(table(spark, sf, "sequences"))


def p6_groups(spark: SparkSession, sf: str) -> DataFrame:
    return near_copies.groups(table(spark, sf, "sequences"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return packing.found(table(spark, sf, "documents"))


def p7_assignment(spark: SparkSession, sf: str) -> DataFrame:
    return packing.assignment(table(spark, sf, "documents"))


def p7_fill(spark: SparkSession, sf: str) -> DataFrame:
    return packing.fill(table(spark, sf, "documents"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return leaks.found(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def p8_leaked(spark: SparkSession, sf: str) -> DataFrame:
    return leaks.leaked(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return residue.found(table(spark, sf, "documents"))


def p9_clean(spark: SparkSession, sf: str) -> DataFrame:
    return residue.clean(table(spark, sf, "documents"))


QUERIES = {f.__name__: f for f in (p2_found, p2_shared_part, p3_found, p5_found, p5_collapsed, p6_found, p6_groups, p7_found, p7_assignment, p7_fill, p8_found, p8_leaked, p9_found, p9_clean)}

_P5 = r"""
WITH r AS (
  SELECT pos, arg_min(coalesce(sequence, ''), loaded_at) AS s, arg_min(coalesce(comment, ''), loaded_at) AS c, arg_min(coalesce(num_duplicates, 0), loaded_at) AS d
  FROM sequences WHERE pos IS NOT NULL GROUP BY pos),
k AS (
  SELECT pos, d, upper(regexp_replace(s, '[^A-Za-z]', '', 'g')) AS s,
         list_sort(list_distinct(list_filter(regexp_split_to_array(lower(c), '[\s,;]+'),
                   lambda x: x <> '' AND x <> 'numduplicates' AND NOT starts_with(x, 'numduplicates=')))) AS t
  FROM r),
g AS (SELECT pos, d, min(pos) OVER (PARTITION BY s, t) AS keep_pos FROM k)
"""

_P2 = """
WITH r AS (SELECT DISTINCT pos, upper(sequence) AS s FROM contigs WHERE pos IS NOT NULL AND sequence IS NOT NULL),
w AS (SELECT pos, i, s[i + 1:i + 64] AS x FROM (SELECT pos, s, unnest(range(0, greatest(length(s) - 63, 0))) AS i FROM r)),
k AS (SELECT pos, i FROM (SELECT pos, i, min(pos) OVER (PARTITION BY x) AS a, max(pos) OVER (PARTITION BY x) AS b FROM w) WHERE a <> b),
n AS (SELECT pos, i, CASE WHEN i <= lag(i + 64) OVER (PARTITION BY pos ORDER BY i) THEN 0 ELSE 1 END AS new FROM k),
g AS (SELECT pos, i, sum(new) OVER (PARTITION BY pos ORDER BY i) AS island FROM n),
f AS (SELECT pos, CAST(min(i) AS INTEGER) AS span_start, CAST(max(i) + 64 AS INTEGER) AS span_end FROM g GROUP BY pos, island)
"""

_P6 = r"""
WITH RECURSIVE r AS (
  SELECT pos, upper(regexp_replace(arg_min(coalesce(sequence, ''), loaded_at), '[^A-Za-z]', '', 'g')) AS s
  FROM sequences WHERE pos IS NOT NULL GROUP BY pos),
u AS (SELECT s, min(pos) AS rep, count(*) AS n FROM r WHERE s <> '' GROUP BY s),
k AS (SELECT DISTINCT rep, substr(s, i, 12) AS x FROM (SELECT rep, s, unnest(range(1, length(s) - 10)) AS i FROM u)),
c AS (SELECT rep, count(*) AS n FROM k GROUP BY rep),
o AS (SELECT a.rep AS a, b.rep AS b, count(*) AS n FROM k a JOIN k b ON a.x = b.x AND a.rep < b.rep GROUP BY a.rep, b.rep),
p AS (SELECT a, b FROM o JOIN c x ON x.rep = a JOIN c y ON y.rep = b WHERE o.n >= 0.6 * (x.n + y.n - o.n) - 1e-9),
m AS (SELECT pos, rep FROM r JOIN u ON r.s = u.s),
f AS (
  SELECT least(x.pos, y.pos) AS pos_1, greatest(x.pos, y.pos) AS pos_2 FROM p JOIN m x ON x.rep = p.a JOIN m y ON y.rep = p.b
  UNION ALL SELECT x.pos, y.pos FROM m x JOIN m y ON x.rep = y.rep AND x.pos < y.pos)
"""

_P8 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL),
x AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 11], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 10, 1))) AS p FROM d)),
y AS (SELECT DISTINCT item_id, array_to_string(w[p:p + 11], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 1))) AS p FROM i))
"""

SQL = {
    # words and signs: TESTDATA.md says that any usual tokenizer gives the same answer
    "p7_found": r"SELECT doc_id FROM documents WHERE doc_id IS NOT NULL AND len(regexp_extract_all(text, '[\p{L}]+|[\p{N}]+|[^\s\p{L}\p{N}]')) > 2048",
    "p8_found": _P8 + "SELECT DISTINCT doc_id, item_id FROM x JOIN y USING (s)",
    "p6_found": _P6 + "SELECT * FROM f",
    "p6_groups": _P6 + """,
e AS (SELECT pos_1 AS a, pos_2 AS b FROM f UNION ALL SELECT pos_2, pos_1 FROM f),
w AS (SELECT pos AS node, pos AS root FROM m UNION SELECT e.b, w.root FROM w JOIN e ON e.a = w.node WHERE w.root < e.b)
SELECT m.pos, g.root AS group_pos, coalesce(l.n, 0) AS n_links
FROM m JOIN (SELECT node, min(root) AS root FROM w GROUP BY node) g ON g.node = m.pos
LEFT JOIN (SELECT a, count(*) AS n FROM e GROUP BY a) l ON l.a = m.pos""",
    "p2_found": _P2 + "SELECT * FROM f",
    "p2_shared_part": _P2 + """
SELECT z.pos, CAST(coalesce(sum(span_end - span_start), 0) AS BIGINT) AS shared_letters,
       CASE WHEN any_value(size) > 0 THEN round(coalesce(sum(span_end - span_start), 0) / any_value(size), 6) ELSE 0 END AS share
FROM (SELECT pos, max(length(sequence)) AS size FROM contigs WHERE pos IS NOT NULL GROUP BY pos) z LEFT JOIN f ON f.pos = z.pos GROUP BY z.pos""",
    "p3_found": """
WITH b AS (SELECT query, node, max(score) AS s FROM hits WHERE query IS NOT NULL AND node IS NOT NULL AND score IS NOT NULL GROUP BY query, node),
r AS (SELECT query, node, row_number() OVER (PARTITION BY query ORDER BY s DESC, node) AS k FROM b)
SELECT query, node FROM r WHERE k <= 3""",
    "p5_found": _P5 + "SELECT keep_pos, pos AS copy_pos FROM g WHERE pos <> keep_pos",
    "p5_collapsed": _P5 + "SELECT keep_pos, count(*) AS n_copies, CAST(sum(CASE WHEN d = 0 THEN 1 ELSE d END) AS BIGINT) AS sum_duplicates FROM g GROUP BY keep_pos",
}
