"""Queries of the record, hit, tree and column operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborweave.functions import codons
from arborweave.functions import sequences as S
from arborweave.operators import columns as C
from arborweave.operators import hits as H
from arborweave.operators import records as R
from arborweave.operators import trees as T
from arborweave.operators.record_keys import keyed_records, one_per_pos
from arborweave.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def records(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """(pos, columns) of the records of sequences, once per pos; only these columns are read (all of them if none is named)."""
    rows = table(spark, sf, "sequences")
    return one_per_pos(rows.select("pos", *columns, "loaded_at")).drop("loaded_at") if columns else one_per_pos(rows)


def contigs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "contigs").dropDuplicates(["pos"])


# The records of sequences and contigs, once per pos
_COLUMNS = ("name", "comment", "sequence", "quality", "tid", "num_duplicates", "node_to_align", "node_score")
_R = "r AS (SELECT pos, " + ", ".join(f"x.{c} AS {c}" for c in _COLUMNS) + " FROM (SELECT pos, arg_min({" + ", ".join(f"'{c}': {c}" for c in _COLUMNS) + "}, loaded_at) AS x FROM sequences GROUP BY pos))"
_C = "c AS (SELECT DISTINCT pos, name, sequence, tid, num_duplicates FROM contigs)"
_CODE = "CASE WHEN regexp_full_match(x, '[TCAG]{{3}}') THEN '{code}'[(instr('TCAG', x[1]) - 1) * 16 + (instr('TCAG', x[2]) - 1) * 4 + instr('TCAG', x[3])] WHEN x = '---' THEN '-' ELSE 'X' END"


def _translated(s: str, mitochondrial: bool = False) -> str:
    return f"array_to_string(list_transform(list_transform(range(1, length({s}) + 1, 3), lambda i: substr({s}, i, 3)), lambda x: {_CODE.format(code=codons.code(mitochondrial))}), '')"


@query(f"WITH {_R} SELECT pos, replace(sequence, '-', '') AS sequence FROM r")
def degap(spark, sf):
    return records(spark, sf, "sequence").select("pos", S.degap(F.col("sequence")).alias("sequence"))


@query(
    f"""WITH {_R}, k AS (SELECT pos, sequence AS s, regexp_replace(replace(upper(sequence), 'U', 'T'), '[^ACGTRYMKWSBDHVN]', '', 'g') AS t FROM r)
SELECT pos, t AS sequence, length(t) - length(regexp_replace(t, '[ACGT]', '', 'g')) AS n_acgt, length(t) = length(s) AS ok FROM k"""
)
def alphabet_filter(spark, sf):
    return R.checked_dna(records(spark, sf, "sequence")).withColumn("n_acgt", F.col("n_acgt").cast("long"))


@query(
    f"""WITH {_R}, k AS (SELECT pos, upper(sequence) AS s FROM r),
n AS (SELECT pos, length(s) - length(regexp_replace(s, '[ACGTUN]', '', 'g')) AS d, length(s) - length(regexp_replace(s, '[ARNDCQEGHILKMFPSTWYV]', '', 'g')) AS a FROM k)
SELECT pos, CASE WHEN a > 0 THEN d / a > 0.9 WHEN a = 0 THEN false END AS is_dna FROM n"""
)
def type_inference(spark, sf):
    return records(spark, sf, "sequence").select("pos", S.looks_like_dna(F.col("sequence")).alias("is_dna"))


@query(
    f"""WITH {_R}, k AS (SELECT upper(sequence) AS s FROM r),
n AS (SELECT CAST(sum(length(s) - length(regexp_replace(s, '[ACGTUN]', '', 'g'))) AS BIGINT) AS n_dna, CAST(sum(length(s) - length(regexp_replace(s, '[ARNDCQEGHILKMFPSTWYV]', '', 'g'))) AS BIGINT) AS n_amino FROM k)
SELECT n_dna, n_amino, n_dna / n_amino > 0.9 AS is_dna FROM n"""
)
def type_inference_all(spark, sf):
    return R.data_type(records(spark, sf, "sequence"))


@query("""WITH c AS (SELECT DISTINCT pos, sequence FROM contigs)
SELECT pos, reverse(translate(sequence, 'ACGTUNRYKMSWBDHVacgtunrykmswbdhv', 'TGCAANYRMKSWVHDBtgcaanyrmkswvhdb')) AS sequence FROM c""")
def revcomp(spark, sf):
    return contigs(spark, sf).select("pos", S.reverse_complement(F.col("sequence")).alias("sequence"))


@query(f"WITH o AS (SELECT DISTINCT name, frame, orf_start, upper(dna) AS d FROM orfs) SELECT name, frame, orf_start, {_translated('d')} AS protein FROM o")
def translate_dna(spark, sf):
    o = table(spark, sf, "orfs").select("name", "frame", "orf_start", F.upper("dna").alias("d")).distinct()
    return o.select("name", "frame", "orf_start", S.translate(F.col("d")).alias("protein"))


@query(
    """WITH o AS (SELECT DISTINCT name, frame, orf_start, upper(dna) AS d, replace(translation, 'G', 'G-') AS p FROM orfs),
s AS (SELECT *, string_split(p, '') AS l FROM o)
SELECT name, frame, orf_start, CASE WHEN d IS NULL OR p IS NULL THEN NULL ELSE array_to_string(list_transform(range(1, length(p) + 1), lambda i: CASE WHEN p[i] = '-' THEN '---'
  WHEN length(substr(d, 3 * (i - 1 - (length(p[1:i]) - length(replace(p[1:i], '-', '')))) + 1, 3)) = 3 THEN substr(d, 3 * (i - 1 - (length(p[1:i]) - length(replace(p[1:i], '-', '')))) + 1, 3) ELSE 'NNN' END), '') END AS dna FROM s"""
)
def backtranslate(spark, sf):
    o = table(spark, sf, "orfs").select("name", "frame", "orf_start", F.upper("dna").alias("d"), F.replace("translation", F.lit("G"), F.lit("G-")).alias("p")).distinct()
    return o.select("name", "frame", "orf_start", S.back_translate(F.col("p"), F.col("d")).alias("dna"))


@query("SELECT DISTINCT name, frame, regexp_replace(regexp_replace(translation, '[^-]', 'NNN', 'g'), '-', '---', 'g') AS dna FROM orfs")
def mock_dna(spark, sf):
    return table(spark, sf, "orfs").select("name", "frame", S.mock_dna(F.col("translation")).alias("dna")).distinct()


@query(
    f"""WITH {_R} SELECT pos, CASE WHEN quality IS NULL OR length(quality) <> length(sequence) THEN sequence ELSE
array_to_string(list_transform(range(1, length(sequence) + 1), lambda i: CASE WHEN ascii(quality[i]) - 33 < 10 THEN 'n' ELSE sequence[i] END), '') END AS sequence FROM r"""
)
def quality_mask(spark, sf):
    return records(spark, sf, "sequence", "quality").select("pos", S.quality_masked(F.col("sequence"), F.col("quality")).alias("sequence"))


@query(
    f"""WITH {_R} SELECT pos, nullif(regexp_extract(comment, '(?:^|[\\s,;])TID=([^\\s,;]*)', 1), '') AS tid,
TRY_CAST(nullif(regexp_extract(comment, '(?:^|[\\s,;])NumDuplicates=([^\\s,;]*)', 1), '') AS INTEGER) AS num_duplicates FROM r"""
)
def comment_tags(spark, sf):
    c = F.col("comment")
    return records(spark, sf, "comment").select("pos", S.tag_of(c, "TID").alias("tid"), S.number(S.tag_of(c, "NumDuplicates"), "int").alias("num_duplicates"))


@query(
    f"""WITH {_R}, k AS (SELECT regexp_replace(replace(upper(sequence), 'U', 'T'), '[^ACGTRYMKWSBDHVN]', '', 'g') AS s FROM r),
b AS (SELECT unnest(['A', 'C', 'G', 'T']) AS base),
n AS (SELECT base, CAST(sum(length(s) - length(replace(s, base, ''))) AS BIGINT) AS n FROM k, b GROUP BY base)
SELECT base, n, round(n / sum(n) OVER (), 9) AS share FROM n"""
)
def base_frequency(spark, sf):
    return R.base_frequencies(records(spark, sf, "sequence")).withColumn("share", F.round("share", 9)).withColumn("n", F.col("n").cast("long"))


@query(
    f"""WITH {_R}, n AS (SELECT pos, name, row_number() OVER (PARTITION BY name ORDER BY pos) AS k FROM r)
SELECT pos, CASE WHEN k > 1 THEN name || '.' || (k - 1) ELSE name END AS name FROM n"""
)
def dedup_names(spark, sf):
    return R.number_names(records(spark, sf, "name").select("pos", "name"))


@query(
    f"""WITH {_R}, n AS (SELECT pos, name, row_number() OVER (PARTITION BY name ORDER BY pos) AS k, count(*) OVER (PARTITION BY name) AS m FROM r)
SELECT pos, CASE WHEN m > 1 THEN name || '/' || k ELSE name END AS name FROM n"""
)
def dedup_names_written(spark, sf):
    return R.number_names(records(spark, sf, "name").select("pos", "name"), "/", True)


@query(
    f"""WITH {_R}, x AS (SELECT pos, i, upper(sequence)[i] AS b FROM (SELECT pos, sequence, unnest(range(1, length(sequence) + 1)) AS i FROM r)),
g AS (SELECT pos, i, b, i - row_number() OVER (PARTITION BY pos, b ORDER BY i) AS run FROM x)
SELECT pos, b AS base, CAST(min(i) - 1 AS INTEGER) AS start, CAST(count(*) AS INTEGER) AS length FROM g GROUP BY pos, b, run HAVING count(*) >= 3"""
)
def homopolymer_runs(spark, sf):
    return R.homopolymers(records(spark, sf, "sequence"), 3)


_ORF = f"""WITH {_R}, s AS (SELECT pos, regexp_replace(replace(upper(sequence), 'U', 'T'), '[^ACGTRYMKWSBDHVN]', '', 'g') AS s FROM r WHERE sequence IS NOT NULL),
b AS (SELECT pos, 1 AS sign, s FROM s UNION ALL SELECT pos, -1, reverse(translate(s, 'ACGTNRYKMSWBDHV', 'TGCANYRMKSWVHDB')) FROM s),
f AS (SELECT pos, sign, length(s) AS n, f, substr(s, f, CAST(floor((length(s) - f + 1) / 3) * 3 AS INTEGER)) AS s FROM b, (SELECT unnest([1, 2, 3]) AS f)),
p AS (SELECT pos, sign, n, f, {_translated("s")} AS p FROM f),
a AS (SELECT pos, sign, n, f, i, p[i] AS c FROM (SELECT *, unnest(range(1, length(p) + 1)) AS i FROM p)),
g AS (SELECT *, sum(CASE WHEN c = 'X' THEN 1 ELSE 0 END) OVER (PARTITION BY pos, sign, f ORDER BY i) AS part FROM a),
o AS (SELECT pos, sign, n, f, min(i) AS i, count(*) AS k, string_agg(c, '' ORDER BY i) AS translation FROM g WHERE c <> 'X' GROUP BY pos, sign, n, f, part HAVING count(*) >= 25)
SELECT pos, CAST(sign * f AS INTEGER) AS frame, CAST(CASE WHEN sign > 0 THEN f + 3 * (i - 1) ELSE n - (f + 3 * (i - 1) + 3 * k - 1) + 1 END AS INTEGER) AS orf_start,
CAST(CASE WHEN sign > 0 THEN f + 3 * (i - 1) + 3 * k - 1 ELSE n - (f + 3 * (i - 1)) + 1 END AS INTEGER) AS orf_end, translation FROM o"""


@query(_ORF)
def orf_scan(spark, sf):
    return R.frames(records(spark, sf, "sequence"), 25)


@query(
    f"""WITH {_R}, n AS (SELECT pos, sequence, name, row_number() OVER (PARTITION BY name ORDER BY pos) AS k, count(*) OVER (PARTITION BY name) AS m FROM r WHERE name IS NOT NULL),
k AS (SELECT pos, sequence, name AS stem, k AS rd FROM n WHERE m > 1 AND k <= 2 AND sequence IS NOT NULL)
SELECT a.stem || '/p12' AS name, a.pos AS pos_1, b.pos AS pos_2, a.sequence || '0' || b.sequence AS sequence FROM k a JOIN k b ON a.stem = b.stem AND a.rd = 1 AND b.rd = 2 AND a.pos < b.pos"""
)
def paired_self_join(spark, sf):
    """Records of one name, numbered as writers do, taken for reads of a pair."""
    return R.paired(R.number_names(records(spark, sf, "name", "sequence"), "/", True))


def _order(by: str) -> str:
    key = {"score": "coalesce(node_score, -1e300)", "length": "coalesce(length(sequence), -1)", "copies": "coalesce(num_duplicates, -1)"}[by]
    return f"WITH {_R} SELECT pos, row_number() OVER (ORDER BY {key} DESC, pos) AS place FROM r"


@query(_order("score"))
def reads_by_score(spark, sf):
    return R.read_order(records(spark, sf, "node_score"), "score")


@query(_order("length"))
def reads_by_length(spark, sf):
    return R.read_order(records(spark, sf, "sequence"), "length")


@query(_order("copies"))
def reads_by_copies(spark, sf):
    return R.read_order(records(spark, sf, "num_duplicates"), "copies")


@query(
    f"""WITH {_R}, k AS (SELECT DISTINCT pos, unnest(regexp_split_to_array(coalesce(node_to_align, ''), '\\s+')) AS name FROM r)
SELECT name, count(*) AS n FROM k WHERE name <> '' GROUP BY name"""
)
def distinct_target_nodes(spark, sf):
    rows = keyed_records(records(spark, sf, "node_to_align").select("pos", F.lit(None).cast("string").alias("tid"), "node_to_align", F.lit(0).alias("num_duplicates"), F.lit(0).alias("read_at")))
    return rows.groupBy(F.expr("substring(key, instr(key, '\u0001') + 1)").alias("name")).agg(F.count("*").alias("n"))


# names and the tree


@query("SELECT node, count(*) AS n FROM hits WHERE node IN (SELECT name FROM tree_nodes WHERE height = 0 AND name IS NOT NULL) GROUP BY node")
def leaf_semi(spark, sf):
    tip = T.leaves(table(spark, sf, "tree_nodes")).select(F.col("name").alias("node"))
    return table(spark, sf, "hits").join(tip, "node", "left_semi").groupBy("node").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT query FROM hits h WHERE query IS NOT NULL AND NOT EXISTS (SELECT 1 FROM sequences s WHERE s.name = h.query)")
def name_anti(spark, sf):
    return table(spark, sf, "hits").select("query").dropna().distinct().join(table(spark, sf, "sequences").select(F.col("name").alias("query")), "query", "left_anti")


@query(
    """WITH a AS (SELECT DISTINCT node AS name FROM hits WHERE node IS NOT NULL), b AS (SELECT name FROM tree_nodes WHERE height = 0)
SELECT count(*) FILTER (a.name IS NOT NULL AND b.name IS NOT NULL) AS n_matched, count(*) FILTER (a.name IS NULL) AS n_leaves_without, count(*) FILTER (b.name IS NULL) AS n_names_without FROM a FULL JOIN b ON a.name = b.name"""
)
def name_reconciliation(spark, sf):
    return R.reconcile(table(spark, sf, "hits").select(F.col("node").alias("name")), T.leaves(table(spark, sf, "tree_nodes")))


_TREE = "t AS (SELECT node_id, parent_id, side, name, coalesce(dist, 0) AS d, trim(tid) AS tid, height FROM tree_nodes)"
_PATHS = f"{_TREE}, p AS (SELECT node_id, node_id AS a, 0 AS depth, 0.0::DOUBLE AS dist FROM t UNION ALL SELECT p.node_id, t.parent_id, p.depth + 1, p.dist + t.d FROM p JOIN t ON t.node_id = p.a WHERE t.parent_id IS NOT NULL)"


@query(f"WITH RECURSIVE {_PATHS} SELECT node_id, a AS ancestor_id, depth, round(dist, 6) AS dist FROM p")
def tree_closure(spark, sf):
    return T.closure(table(spark, sf, "tree_nodes")).withColumn("dist", F.round("dist", 6))


@query(
    f"""WITH RECURSIVE {_PATHS}, w AS (SELECT node AS name, count(*) AS w FROM hits GROUP BY node)
SELECT p.a AS node_id, count(*) FILTER (t.height = 0) AS n_leaves, count(*) AS n_nodes, CAST(sum(CASE WHEN t.height = 0 THEN coalesce(w.w, 1) ELSE 0 END) AS BIGINT) AS weight
FROM p JOIN t ON t.node_id = p.node_id LEFT JOIN w ON w.name = t.name GROUP BY p.a"""
)
def leaf_counts(spark, sf):
    weights = table(spark, sf, "hits").groupBy(F.col("node").alias("name")).agg(F.count("*").alias("weight")).dropna()
    return T.counts(table(spark, sf, "tree_nodes"), weights)


@query(
    f"""WITH RECURSIVE {_PATHS}, x AS (SELECT p.a AS node_id, round(dist, 9) AS dist, t.name AS leaf FROM p JOIN t ON t.node_id = p.node_id WHERE t.height = 0 AND t.name IN (SELECT node FROM hits)),
y AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY dist, leaf) AS k FROM x)
SELECT node_id, leaf, round(dist, 6) AS dist FROM y WHERE k = 1"""
)
def closest_leaf(spark, sf):
    return T.closest_leaf(table(spark, sf, "tree_nodes"), table(spark, sf, "hits").select(F.col("node").alias("name"))).withColumn("dist", F.round("dist", 6))


@query("""SELECT node_id, CASE WHEN parent_id IS NOT NULL THEN least(CASE WHEN coalesce(dist, 0) <= 0 THEN 0.001 ELSE dist END, 0.2) END AS dist FROM tree_nodes""")
def branch_policy(spark, sf):
    return T.branch_lengths(table(spark, sf, "tree_nodes")).select("node_id", "dist")


@query(
    f"""WITH RECURSIVE {_PATHS}, k AS (SELECT node_id FROM t WHERE height = 0 AND name IN (SELECT node FROM hits)),
n AS (SELECT DISTINCT p.a AS node_id FROM p JOIN k ON k.node_id = p.node_id),
c AS (SELECT t.parent_id AS node_id, count(*) AS c FROM t JOIN n ON n.node_id = t.node_id WHERE t.parent_id IS NOT NULL GROUP BY t.parent_id),
s AS (SELECT n.node_id FROM n LEFT JOIN c ON c.node_id = n.node_id WHERE c.c IS NULL OR c.c >= 2),
u AS (SELECT p.node_id, p.a, p.dist, row_number() OVER (PARTITION BY p.node_id ORDER BY p.depth) AS k FROM p JOIN s x ON x.node_id = p.node_id JOIN s y ON y.node_id = p.a WHERE p.depth > 0)
SELECT s.node_id, u.a AS parent_id, t.name, round(u.dist, 6) AS dist FROM s JOIN t ON t.node_id = s.node_id LEFT JOIN u ON u.node_id = s.node_id AND u.k = 1"""
)
def prune_tree(spark, sf):
    return T.prune(table(spark, sf, "tree_nodes"), table(spark, sf, "hits").select(F.col("node").alias("name"))).withColumn("dist", F.round("dist", 6))


@query(
    """WITH RECURSIVE q AS (SELECT node_id, '' AS path FROM tree_nodes WHERE parent_id IS NULL UNION ALL SELECT t.node_id, q.path || CAST(coalesce(t.side, 0) AS VARCHAR) FROM tree_nodes t JOIN q ON t.parent_id = q.node_id)
SELECT t.node_id, CASE WHEN t.height > 0 THEN '#' || row_number() OVER (PARTITION BY t.height > 0 ORDER BY q.path || '2') || '#' ELSE t.name END AS name FROM tree_nodes t JOIN q USING (node_id)"""
)
def inner_node_names(spark, sf):
    return T.named_inner(table(spark, sf, "tree_nodes"))


@query(
    """SELECT name, row_number() OVER (ORDER BY regexp_full_match(name, '#\\d+#'), CASE WHEN regexp_full_match(name, '#\\d+#') THEN CAST(trim(name, '#') AS BIGINT) ELSE 0 END, name, node_id) AS place FROM tree_nodes WHERE name IS NOT NULL"""
)
def node_order(spark, sf):
    return T.sorted_nodes(table(spark, sf, "tree_nodes"))


@query(
    """SELECT 'internal' AS kind, name, trim(tid) AS tid FROM tree_nodes WHERE name IS NOT NULL AND height > 0 AND trim(tid) = '13' UNION SELECT 'terminal', name, trim(tid) FROM tree_nodes WHERE name IS NOT NULL AND height = 0
UNION SELECT 'all', name, trim(tid) FROM tree_nodes WHERE name IS NOT NULL AND (trim(tid) = 'no such tag' OR NOT EXISTS (SELECT 1 FROM tree_nodes WHERE trim(tid) = 'no such tag'))"""
)
def node_class_filter(spark, sf):
    """Targets inside the tree of one tag, all terminal ones, and all where no node has the tag."""
    tree = table(spark, sf, "tree_nodes")
    some = (("internal", T.targets(tree, "internal", "13")), ("terminal", T.targets(tree, "terminal")), ("all", T.targets(tree, "all", "no such tag")))
    parts = [rows.select(F.lit(kind).alias("kind"), "name", "tid") for kind, rows in some]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()


@query(
    f"""WITH {_R}, t AS (SELECT DISTINCT trim(tid) AS tid, name FROM tree_nodes WHERE trim(tid) <> '' AND name IS NOT NULL)
SELECT t.name, count(*) AS n, CAST(sum(pos) AS BIGINT) AS pos_sum FROM r JOIN t ON trim(r.tid, ' ' || chr(9)) = t.tid GROUP BY t.name"""
)
def tid_join(spark, sf):
    return T.placements_by_tag(records(spark, sf, "tid"), table(spark, sf, "tree_nodes")).groupBy("name").agg(F.count("*").alias("n"), F.sum("pos").alias("pos_sum"))


def _states(tree: DataFrame) -> DataFrame:
    return T.leaves(tree).select("name", F.expr("cast(shiftleft(1, cast(pmod(node_id * 7 + length(name), 4) as int)) as int)").alias("state"))


def _parsimony(down: bool, top: int = 40) -> str:
    """The levels as one common table expression each; more than the tree has are empty."""
    parts = ["t AS (SELECT node_id, parent_id, name, height FROM tree_nodes)", "u0 AS (SELECT node_id, parent_id, CAST(1 << ((node_id * 7 + length(name)) % 4) AS INTEGER) AS s FROM t WHERE height = 0)"]
    for h in range(1, top + 1):
        below = " UNION ALL ".join(f"SELECT parent_id, s FROM u{h - 1}" if i == 0 else f"SELECT parent_id, s FROM w{h - 1}" for i in range(2 if h > 1 else 1))
        parts.append(f"w{h} AS MATERIALIZED ({below})")
        parts.append(f"u{h} AS MATERIALIZED (SELECT t.node_id, t.parent_id, CASE WHEN bit_and(w.s) <> 0 THEN bit_and(w.s) ELSE bit_or(w.s) END AS s FROM t JOIN w{h} w ON w.parent_id = t.node_id WHERE t.height = {h} GROUP BY t.node_id, t.parent_id)")
    parts.append("u AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT * FROM u{h}" for h in range(top + 1)) + ")")
    if not down:
        return f"WITH {', '.join(parts)} SELECT node_id, s AS state FROM u"
    return (
        f"WITH RECURSIVE {', '.join(parts)}, d AS (SELECT node_id, s FROM u WHERE parent_id IS NULL UNION ALL SELECT u.node_id, CASE WHEN (u.s & d.s) <> 0 THEN u.s & d.s ELSE u.s END FROM u JOIN d ON u.parent_id = d.node_id) SELECT node_id, s AS state FROM d"
    )


@query(_parsimony(False))
def parsimony_up(spark, sf):
    tree = table(spark, sf, "tree_nodes")
    return T.parsimony_up(tree, _states(tree))


@query(_parsimony(True))
def parsimony_down(spark, sf):
    tree = table(spark, sf, "tree_nodes")
    return T.parsimony_down(tree, T.parsimony_up(tree, _states(tree)))


@query(
    f"""WITH RECURSIVE {_PATHS}, l AS (SELECT p.a AS c, p.dist AS d, p.node_id AS leaf FROM p JOIN t ON t.node_id = p.node_id WHERE t.node_id NOT IN (SELECT parent_id FROM t WHERE parent_id IS NOT NULL)),
m AS (SELECT c, d, leaf FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY d DESC, leaf DESC) AS k FROM l) WHERE k = 1),
arm AS (SELECT t.parent_id AS a, m.d + t.d AS d, m.leaf, row_number() OVER (PARTITION BY t.parent_id ORDER BY m.d + t.d DESC, m.leaf DESC) AS k FROM m JOIN t ON t.node_id = m.c WHERE t.parent_id IS NOT NULL),
far AS (SELECT x.d + y.d AS length, x.leaf AS node_id, y.leaf AS other_id FROM arm x JOIN arm y ON x.a = y.a AND x.k = 1 AND y.k = 2 ORDER BY length DESC, node_id, other_id LIMIT 1)
SELECT far.node_id, other_id, round(length, 6) AS length, p.a AS node_above, round(length / 2 - p.dist, 6) AS "offset" FROM far JOIN p ON p.node_id = far.node_id AND p.dist <= length / 2 ORDER BY p.dist DESC, p.a DESC LIMIT 1"""
)
def midpoint_root(spark, sf):
    tree = table(spark, sf, "tree_nodes")
    found = T.midpoint(T.closure(tree), tree)
    return found.withColumns({"length": F.round("length", 6), "offset": F.round("offset", 6)})


# hits

_H = """h AS (SELECT DISTINCT query, node, q_strand, t_strand, score, q_start, q_end, t_start, t_end, run_at FROM hits WHERE query IS NOT NULL AND node IS NOT NULL AND score IS NOT NULL),
g AS (SELECT query, node, q_strand, t_strand, CAST(sum(score) AS BIGINT) AS score, min(least(q_start, q_end)) AS q_start, max(greatest(q_start, q_end)) AS q_end, min(least(t_start, t_end)) AS t_start, max(greatest(t_start, t_end)) AS t_end FROM h GROUP BY query, node, q_strand, t_strand),
m AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY query, node ORDER BY score DESC, coalesce(q_strand, '') || coalesce(t_strand, '')) AS k FROM g) WHERE k = 1)"""


@query(f"WITH {_H} SELECT * FROM m")
def hit_merge(spark, sf):
    return H.merge_hits(table(spark, sf, "hits"))


@query(f"WITH {_H} SELECT query, node, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, node) AS k FROM m) WHERE k <= 10")
def topk_hits(spark, sf):
    return H.keep_best(H.merge_hits(table(spark, sf, "hits")), 10).select("query", "node", "score")


@query(f"WITH {_H} SELECT query, node, score FROM (SELECT *, max(score) OVER (PARTITION BY query) AS b FROM m) WHERE score > 0.8 * b")
def hits_above(spark, sf):
    return H.keep_best(H.merge_hits(table(spark, sf, "hits")), None, 0.8).select("query", "node", "score")


@query(f"WITH {_H} SELECT query, node, score FROM (SELECT *, max(score) OVER (PARTITION BY query) AS b FROM m) WHERE score = b")
def argmax_ties(spark, sf):
    return H.best_with_ties(H.merge_hits(table(spark, sf, "hits")))


@query(f"WITH {_H} SELECT query, max(node) AS node, score FROM (SELECT *, max(score) OVER (PARTITION BY query) AS b FROM m) WHERE score = b GROUP BY query, score")
def one_placement_only(spark, sf):
    return H.best_with_ties(H.merge_hits(table(spark, sf, "hits")), one_only=True)


_SUGAR = "('sugar: ' || query || ' ' || q_start || ' ' || q_end || ' ' || q_strand || ' ' || node || ' ' || t_start || ' ' || t_end || ' ' || t_strand || ' ' || score)"


@query("SELECT query, node AS target, score, q_start, q_end, q_strand, t_start, t_end, t_strand, count(*) AS n FROM hits WHERE query IS NOT NULL AND node IS NOT NULL AND score IS NOT NULL AND q_start IS NOT NULL AND q_end IS NOT NULL AND t_start IS NOT NULL AND t_end IS NOT NULL AND q_strand IS NOT NULL AND t_strand IS NOT NULL GROUP BY ALL")
def sugar_lines(spark, sf):
    lines = table(spark, sf, "hits").select(H.sugar_line().alias("value"))
    parsed = H.parse_hits(lines)
    return parsed.groupBy(*parsed.columns).agg(F.count("*").alias("n"))


@query(
    f"""WITH {_R}, f AS (SELECT name AS query, arg_min(length(sequence), pos) AS len FROM r WHERE name IS NOT NULL AND sequence IS NOT NULL GROUP BY name), {_H},
o AS (SELECT m.query, m.node, (m.q_end - m.q_start) / f.len AS overlap, m.score / (5.0 * (m.q_end - m.q_start)) AS identity FROM m JOIN f ON f.query = m.query WHERE m.q_end > m.q_start)
SELECT query, node, round(overlap, 6) AS overlap, round(identity, 6) AS identity FROM o WHERE overlap > 0.5 AND identity > 0.5"""
)
def acceptance(spark, sf):
    seqs = records(spark, sf, "name", "sequence").where("sequence IS NOT NULL").withColumn("len", F.length("sequence"))
    rows = H.with_records(H.merge_hits(table(spark, sf, "hits")), seqs, ["len"]).where("q_end > q_start")
    width = F.col("q_end") - F.col("q_start")
    rows = rows.select("query", "node", (width / F.col("r_len")).alias("overlap"), (F.col("score") / (5.0 * width)).alias("identity"))
    return H.accepted(rows).select("query", "node", F.round("overlap", 6).alias("overlap"), F.round("identity", 6).alias("identity"))


@query("SELECT query, node, score, round(sqrt(score), 9) AS root, round(cbrt(score), 9) AS cube FROM hits WHERE score >= 0 GROUP BY ALL")
def edge_weights(spark, sf):
    w = F.col("score")
    return table(spark, sf, "hits").where("score >= 0").select("query", "node", "score", F.round(S.edge_weight(w), 9).alias("root"), F.round(S.edge_weight(w, "cbrt"), 9).alias("cube")).distinct()


@query("SELECT node, greatest(0, min(least(t_start, t_end)) - 15) AS first, max(greatest(t_start, t_end)) + 15 AS last FROM hits WHERE node IS NOT NULL AND t_start IS NOT NULL AND t_end IS NOT NULL GROUP BY node")
def trim_to_span(spark, sf):
    """The alignment columns around the queries of each node, with the margin that trimming keeps."""
    h = table(spark, sf, "hits").where("node IS NOT NULL AND t_start IS NOT NULL AND t_end IS NOT NULL")
    ends = h.select(F.col("node").alias("group"), F.explode(F.array("t_start", "t_end")).alias("col"), F.lit("N").alias("symbol"))
    return C.span_of(ends).withColumnRenamed("group", "node")


_ANCHORS = f"""WITH {_R}, q AS (SELECT name, arg_min(sequence, pos) AS s FROM r WHERE name IS NOT NULL AND sequence IS NOT NULL GROUP BY name),
o AS (SELECT DISTINCT name, frame, orf_start, upper(dna) AS dna FROM orfs), p AS (SELECT o.name || '|' || frame || '|' || orf_start AS id, dna AS a, upper(s) AS b FROM o JOIN q ON q.name = o.name WHERE dna IS NOT NULL),
x AS (SELECT id, i, substr(a, i + 1, 9) AS k FROM (SELECT id, a, unnest(range(0, greatest(length(a) - 8, 0))) AS i FROM p)),
y AS (SELECT id, j, substr(b, j + 1, 9) AS k FROM (SELECT id, b, unnest(range(0, greatest(length(b) - 8, 0))) AS j FROM p)),
s AS (SELECT x.id, i, j, j - i AS d FROM x JOIN y ON x.id = y.id AND x.k = y.k),
g AS (SELECT *, i - row_number() OVER (PARTITION BY id, d ORDER BY i) AS run FROM s),
an AS (SELECT id, CAST(min(i) AS INTEGER) AS start_1, CAST(min(j) AS INTEGER) AS start_2, count(*) + 8 AS length FROM g GROUP BY id, d, run)"""


@query(_ANCHORS + " SELECT * FROM an")
def diagonal_anchors(spark, sf):
    return H.exact_anchors(_orf_pairs(spark, sf), 9)


def _orf_pairs(spark, sf) -> DataFrame:
    """(id, text_1, text_2): the DNA of each reading frame with the sequence of its record."""
    seqs = records(spark, sf, "name", "sequence").where("name IS NOT NULL AND sequence IS NOT NULL").groupBy("name").agg(F.upper(F.min_by("sequence", "pos")).alias("text_2"))
    o = table(spark, sf, "orfs").where("dna IS NOT NULL").select("name", "frame", "orf_start", F.upper("dna").alias("text_1")).distinct()
    return o.join(seqs, "name").select(F.concat_ws("|", "name", F.col("frame").cast("string"), F.col("orf_start").cast("string")).alias("id"), "text_1", "text_2")


@query(
    f"""WITH {_R}, a AS (SELECT DISTINCT pos, substr(s, i, 16) AS k FROM (SELECT pos, s, unnest(range(1, length(s) - 14)) AS i FROM (SELECT DISTINCT pos, upper(sequence) AS s FROM contigs WHERE sequence IS NOT NULL) WHERE length(s) >= 16)),
b AS (SELECT DISTINCT pos, substr(s, i, 16) AS k FROM (SELECT pos, s, unnest(range(1, length(s) - 14)) AS i FROM (SELECT pos, upper(sequence) AS s FROM r WHERE sequence IS NOT NULL) WHERE length(s) >= 16)),
n AS (SELECT k, count(*) AS n FROM b GROUP BY k)
SELECT a.pos AS a, count(*) AS n_kmers, count(n.n) AS n_shared, CAST(coalesce(sum(n.n), 0) AS BIGINT) AS n_holders FROM a LEFT JOIN n USING (k) GROUP BY a.pos"""
)
def kmer_join(spark, sf):
    """What the consensus records share with the records, by 16 letters: one row for each, without pairs."""
    x = contigs(spark, sf).select(F.col("pos").alias("id"), F.upper("sequence").alias("text"))
    y = records(spark, sf, "sequence").select(F.col("pos").alias("id"), F.upper("sequence").alias("text"))
    return H.shared_parts(x, y, 16)


_CHAINS = (
    _ANCHORS
    + """, cut AS (SELECT id, list([{'a': start_1 + 2, 'b': start_2 + 2, 'n': length - 4, 's': length}] ORDER BY length DESC, start_1, start_2) AS l FROM an WHERE length > 4 GROUP BY id),
kept AS (SELECT id, list_sort(list_reduce(l, lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: NOT ((x[1].a + x[1].n <= y.a OR y.a + y.n <= x[1].a) AND (x[1].b + x[1].n <= y.b OR y.b + y.n <= x[1].b)))) = 0 THEN list_concat(acc, x) ELSE acc END)) AS l FROM cut),
ch0 AS (SELECT id, list_reduce(list_transform(l, lambda x: [x]), lambda acc, x: list_concat(
  list_slice(acc, 1, coalesce(list_max(list_filter(range(1, len(acc) + 1), lambda i: NOT (x[1].b < acc[i].b + acc[i].n AND acc[i].s < x[1].s))), 0)),
  CASE WHEN coalesce(list_max(list_filter(range(1, len(acc) + 1), lambda i: NOT (x[1].b < acc[i].b + acc[i].n AND acc[i].s < x[1].s))), 0) = 0
    OR x[1].b >= acc[list_max(list_filter(range(1, len(acc) + 1), lambda i: NOT (x[1].b < acc[i].b + acc[i].n AND acc[i].s < x[1].s)))].b + acc[list_max(list_filter(range(1, len(acc) + 1), lambda i: NOT (x[1].b < acc[i].b + acc[i].n AND acc[i].s < x[1].s)))].n THEN x ELSE [] END)) AS l FROM kept),
sz AS (SELECT id, length(a) AS n1, length(b) AS n2 FROM p),
mk AS (SELECT sz.id, n1, n2, len(coalesce(l, [])) AS n_anchors, list_concat([{'a': 0, 'b': 0, 'n': 0}], list_transform(coalesce(l, []), lambda x: {'a': x.a, 'b': x.b, 'n': x.n})) AS m FROM sz LEFT JOIN ch0 ON ch0.id = sz.id),
lh AS (SELECT *, list_transform(range(0, n1 + 1), lambda i: len(list_filter(m, lambda x: x.a <= i))) AS seg FROM mk),
bd AS (SELECT *, list_transform(range(0, n1 + 1), lambda i: CASE WHEN i < m[seg[i + 1]].a + m[seg[i + 1]].n THEN m[seg[i + 1]].b + i - m[seg[i + 1]].a ELSE m[seg[i + 1]].b + m[seg[i + 1]].n END) AS low,
  list_transform(range(0, n1 + 1), lambda i: CASE WHEN i < m[seg[i + 1]].a + m[seg[i + 1]].n THEN m[seg[i + 1]].b + i - m[seg[i + 1]].a WHEN seg[i + 1] = len(m) THEN n2 ELSE m[seg[i + 1] + 1].b END) AS high FROM lh),
cv AS (SELECT id, n_anchors, n1, n2, list_sum(list_transform(range(0, n1 + 1), lambda i: least(n2, list_max(high[greatest(0, i - 15) + 1:i + 16]) + 15) - greatest(0, list_min(low[greatest(0, i - 15) + 1:i + 16]) - 15))) AS total FROM bd)
SELECT id, CAST(n_anchors AS INTEGER) AS n_anchors, round(CASE WHEN n_anchors > 0 THEN total / greatest(1, (n1 + 1) * n2) ELSE 1.0 END, 6) AS coverage FROM cv"""
)


@query(_CHAINS)
def tunnel_bounds(spark, sf):
    """How many anchors of each pair hold together, and the share of the matrix inside the tunnel around them."""
    pairs = _orf_pairs(spark, sf)
    # two records of one name may have reading frames of one place and other letters; SQL knows both by one id
    anchors = H.pooled_anchors(pairs, 9).withColumn("score", F.col("length").cast("double"))
    found = H.tunnels(anchors, pairs.select("id", F.length("text_1").alias("n1"), F.length("text_2").alias("n2")), trim=2)
    return found.withColumn("coverage", F.round("coverage", 6))


# columns; a lower-case letter of a contig counts as a gap, and records lie left-aligned under their tag

_D1 = f"{_C}, d AS (SELECT pos, tid, num_duplicates, translate(sequence, 'abcdefghijklmnopqrstuvwxyz', '--------------------------') AS s FROM c)"


def _gapped(spark, sf) -> DataFrame:
    lower = "abcdefghijklmnopqrstuvwxyz"
    return contigs(spark, sf).select("pos", F.trim("tid").alias("group"), F.when(F.col("num_duplicates") > 0, F.col("num_duplicates")).otherwise(1).alias("w"), F.translate("sequence", lower, "-" * 26).alias("sequence"))


_COUNTS = f"""WITH {_D1}, x AS (SELECT tid AS grp, w, i - 1 AS col, s[i] AS b FROM (SELECT trim(tid) AS tid, CASE WHEN num_duplicates > 0 THEN num_duplicates ELSE 1 END AS w, s, unnest(range(1, length(s) + 1)) AS i FROM d) WHERE tid IS NOT NULL),
n AS (SELECT grp, col, {", ".join(f"CAST(sum(CASE WHEN b IN ({', '.join(repr(k) for k, m in C.IUPAC.items() if m & (1 << i))}) THEN w ELSE 0 END) AS BIGINT) AS {base}" for i, base in enumerate("acgt"))}, CAST(sum(CASE WHEN b <> '-' THEN w ELSE 0 END) AS BIGINT) AS n FROM x GROUP BY grp, col)"""


@query(_COUNTS + ' SELECT grp AS "group", CAST(col AS INTEGER) AS col, a, c, g, t, n FROM n')
def column_counts(spark, sf):
    return C.row_counts(_gapped(spark, sf).where("group IS NOT NULL"), weight=F.col("w"))


_CALL = "CASE WHEN greatest(a, c, g, t) <= 0 OR n < {least} THEN '-' ELSE '-" + "".join(C.LETTER[m] for m in range(1, 16)) + "'[1 + CASE WHEN a = greatest(a, c, g, t) THEN 1 ELSE 0 END + CASE WHEN c = greatest(a, c, g, t) THEN 2 ELSE 0 END + CASE WHEN g = greatest(a, c, g, t) THEN 4 ELSE 0 END + CASE WHEN t = greatest(a, c, g, t) THEN 8 ELSE 0 END] END"


@query(_COUNTS + f' SELECT grp AS "group", CAST(col AS INTEGER) AS col, {_CALL.format(least=1)} AS symbol FROM n')
def consensus_iupac(spark, sf):
    return C.consensus(C.row_counts(_gapped(spark, sf).where("group IS NOT NULL"), weight=F.col("w"))).select("group", "col", "symbol")


@query(
    _COUNTS
    + f""", l AS (SELECT trim(tid) AS grp, greatest(5, CAST(floor(0.5 * sum(CASE WHEN num_duplicates > 0 THEN num_duplicates ELSE 1 END)) AS INTEGER)) AS least FROM d WHERE tid IS NOT NULL GROUP BY trim(tid)),
k AS (SELECT n.grp, col, {_CALL.format(least="least")} AS symbol FROM n JOIN l ON l.grp = n.grp)
SELECT grp AS "group", string_agg(symbol, '' ORDER BY col) AS sequence FROM k GROUP BY grp"""
)
def consensus_minimum(spark, sf):
    rows = _gapped(spark, sf).where("group IS NOT NULL")
    least = rows.groupBy("group").agg(C.consensus_minimum(F.sum("w")).alias("least"))
    counted = C.row_counts(rows, weight=F.col("w")).join(least, "group")
    return C.to_rows(C.consensus(counted, F.col("least")), ["group"])


@query(_COUNTS + ' SELECT grp AS "group", count(*) AS n_columns, count(*) FILTER (n > 0) AS n_kept FROM n GROUP BY grp')
def gap_only_columns(spark, sf):
    counted = C.row_counts(_gapped(spark, sf).where("group IS NOT NULL"))
    return counted.groupBy("group").agg(F.count("*").alias("n_columns"), F.count_if(F.col("n") > 0).alias("n_kept"))


# parent and child: the contig at half the position, as in a heap
_PAIR = f"WITH {_D1}, b AS (SELECT x.pos, x.s AS child, y.s AS parent, z.s AS sister FROM d x JOIN d y ON y.pos = x.pos // 2 AND y.pos <> x.pos LEFT JOIN d z ON z.pos = x.pos + 1)"


def _heap_pairs(spark, sf) -> DataFrame:
    d = _gapped(spark, sf).select("pos", "sequence")
    x = d.select("pos", F.col("sequence").alias("child"), F.floor(F.col("pos") / 2).cast("long").alias("up"))
    y = d.select(F.col("pos").alias("up"), F.col("sequence").alias("parent"))
    z = d.select((F.col("pos") - 1).alias("pos"), F.col("sequence").alias("sister"))
    return x.where("up <> pos").join(y, "up").join(z, "pos", "left").drop("up")


_EVENTS = (
    _PAIR
    + """, x AS (SELECT pos, i, parent[i] AS p, child[i] AS q FROM (SELECT *, unnest(range(1, least(length(parent), length(child)) + 1)) AS i FROM b WHERE parent IS NOT NULL AND child IS NOT NULL)),
y AS (SELECT pos, i, p, q, CASE WHEN p = '-' THEN 'insertion' WHEN q = '-' THEN 'deletion' WHEN p <> q THEN 'substitution' ELSE 'same' END AS kind FROM x WHERE NOT (p = '-' AND q = '-')),
z AS (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY i) - row_number() OVER (PARTITION BY pos, kind ORDER BY i) AS run FROM y),
ev AS (SELECT pos AS branch, kind, CAST(i AS INTEGER) AS start, CAST(i AS INTEGER) AS "end", p AS from_state, q AS to_state FROM z WHERE kind = 'substitution'
UNION ALL SELECT pos, kind, CAST(min(i) AS INTEGER), CAST(max(i) AS INTEGER), NULL, NULL FROM z WHERE kind IN ('insertion', 'deletion') GROUP BY pos, kind, run)
"""
)


@query(_EVENTS + "SELECT * FROM ev")
def branch_events(spark, sf):
    return C.branch_events(_heap_pairs(spark, sf).withColumnRenamed("pos", "branch"))


@query(
    _PAIR
    + """, x AS (SELECT pos, length(replace(child, '-', '')) AS n, list_transform(range(1, least(length(parent), length(child)) + 1), lambda i: CASE WHEN parent[i] <> '-' AND child[i] <> '-' THEN CASE WHEN parent[i] = child[i] THEN 2 ELSE 1 END ELSE 0 END) AS v FROM b WHERE parent IS NOT NULL AND child IS NOT NULL),
y AS (SELECT pos, n, len(list_filter(v, lambda k: k > 0)) AS a, len(list_filter(v, lambda k: k = 2)) AS e FROM x)
SELECT pos AS id, CASE WHEN n > 0 THEN round(a / n, 6) ELSE 0 END AS overlap, CASE WHEN a > 0 THEN round(e / a, 6) ELSE 0 END AS identity FROM y"""
)
def pair_identity(spark, sf):
    rows = _heap_pairs(spark, sf).select(F.col("pos").alias("id"), F.col("child").alias("a"), F.col("parent").alias("b"))
    return C.overlap_identity(rows).select("id", F.round("overlap", 6).alias("overlap"), F.round("identity", 6).alias("identity"))


@query(
    _PAIR
    + """, x AS (SELECT pos, list_filter(range(1, least(length(parent), length(child), length(sister)) + 1), lambda i: parent[i] <> '-' AND child[i] <> '-' AND sister[i] <> '-') AS v, parent AS p, child AS q, sister AS s FROM b WHERE parent IS NOT NULL AND child IS NOT NULL AND sister IS NOT NULL),
y AS (SELECT pos, CASE WHEN len(v) > 0 THEN len(list_filter(v, lambda i: p[i] <> s[i])) / len(v) ELSE 0 END AS ps, CASE WHEN len(v) > 0 THEN len(list_filter(v, lambda i: p[i] <> q[i])) / len(v) ELSE 0 END AS pq, CASE WHEN len(v) > 0 THEN len(list_filter(v, lambda i: s[i] <> q[i])) / len(v) ELSE 0 END AS sq FROM x),
z AS (SELECT pos, greatest(0, (ps + pq - sq) / 2) AS p, greatest(0, (ps + sq - pq) / 2) AS s, greatest(0, (pq + sq - ps) / 2) AS q FROM y)
SELECT pos AS id, round(CASE WHEN p + s > 0 THEN p / (p + s) * 0.1 ELSE 0.05 END, 6) AS to_parent, round(CASE WHEN p + s > 0 THEN s / (p + s) * 0.1 ELSE 0.05 END, 6) AS to_sister, round(q, 6) AS to_query FROM z"""
)
def branch_repair(spark, sf):
    d = C.pair_distances(_heap_pairs(spark, sf).withColumnsRenamed({"pos": "id", "child": "query"}))
    return C.three_point(d, F.lit(0.1)).select("id", *(F.round(c, 6).alias(c) for c in ("to_parent", "to_sister", "to_query")))


@query(_EVENTS + """SELECT branch, start AS column_, CAST(sum("end" - start + 1) OVER (PARTITION BY branch ORDER BY start) AS BIGINT) AS shift FROM ev WHERE kind = 'insertion'""")
def parent_reindex(spark, sf):
    """How far the parent's sites behind each insertion of a child move when the insertions become columns of its own."""
    return C.shifts(branch_events(spark, sf))


@query(
    _PAIR
    + """, x AS (SELECT pos, i, parent[i] <> '-' AS l, child[i] <> '-' AS r FROM (SELECT *, unnest(range(1, least(length(parent), length(child)) + 1)) AS i FROM b WHERE parent IS NOT NULL AND child IS NOT NULL)),
y AS (SELECT pos, i, l, r, count(*) FILTER (l) OVER (PARTITION BY pos ORDER BY i) AS a, count(*) FILTER (r) OVER (PARTITION BY pos ORDER BY i) AS b FROM x)
SELECT pos AS branch, CAST(i AS INTEGER) AS col, CAST(a AS INTEGER) AS left_site, CAST(b AS INTEGER) AS right_site FROM y WHERE l <> r"""
)
def unique_index(spark, sf):
    """The last site of either row up to each column in which only one of them has a residue."""
    return C.running_sites(_heap_pairs(spark, sf).withColumnRenamed("pos", "branch"))


@query(
    _PAIR
    + """SELECT pos AS id, array_to_string(list_transform(range(1, least(length(parent), length(child)) + 1), lambda i: CASE WHEN parent[i] = '-' OR child[i] = '-' THEN '-' WHEN parent[i] = child[i] THEN '1' ELSE '0' END), '') AS identity FROM b WHERE parent IS NOT NULL AND child IS NOT NULL"""
)
def identity_vectors(spark, sf):
    """Column by column, whether two aligned rows agree."""
    return C.identity_vectors(_heap_pairs(spark, sf).select(F.col("pos").alias("id"), F.col("child").alias("a"), F.col("parent").alias("b")))


@query(
    f"""WITH {_R}, k AS (SELECT pos, sequence AS s, regexp_replace(replace(upper(sequence), 'U', 'X'), '[^ARNDCQEGHILKMFPSTWYVX]', '', 'g') AS t FROM r)
SELECT pos, t AS sequence, length(t) = length(s) AS ok FROM k"""
)
def protein_filter(spark, sf):
    return R.checked_protein(records(spark, sf, "sequence"))


@query(f"WITH o AS (SELECT DISTINCT name, frame, orf_start, upper(dna) AS d FROM orfs) SELECT name, frame, orf_start, {_translated('d', True)} AS protein FROM o")
def translate_mitochondrial(spark, sf):
    o = table(spark, sf, "orfs").select("name", "frame", "orf_start", F.upper("dna").alias("d")).distinct()
    return o.select("name", "frame", "orf_start", S.translate(F.col("d"), True).alias("protein"))
