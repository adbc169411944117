"""Queries of the alignment, placement and pile-up plans. Their results are no SQL; tests hold them against brute force and identities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborweave.functions import models
from arborweave.functions import sequences as S
from arborweave.operators import columns as C
from arborweave.operators import hits as H
from arborweave.operators import records as R
from arborweave.operators import trees as T
from arborweave.plans import msa, placement
from arborweave.queries_sequences import _R, records
from arborweave.session import materialise, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _thinning(keep: int) -> str:
    """The greedy choice as one pair of common table expressions a step."""
    parts = [
        "t AS (SELECT node_id, parent_id, name, coalesce(dist, 0) AS d FROM tree_nodes)",
        "p AS (SELECT node_id, node_id AS a, 0.0::DOUBLE AS dist FROM t UNION ALL SELECT p.node_id, t.parent_id, p.dist + t.d FROM p JOIN t ON t.node_id = p.a WHERE t.parent_id IS NOT NULL)",
        "l AS MATERIALIZED (SELECT DISTINCT t.name, p.a, p.dist FROM p JOIN t ON t.node_id = p.node_id WHERE t.node_id NOT IN (SELECT parent_id FROM t WHERE parent_id IS NOT NULL) AND t.name IN (SELECT node FROM hits))",
        "n0 AS (SELECT DISTINCT name, 'infinity'::DOUBLE AS d FROM l)",
    ]
    for k in range(1, keep + 1):
        before = " UNION ALL ".join(f"SELECT name FROM c{j}" for j in range(1, k)) or "SELECT '' WHERE false"
        parts.append(f"c{k} AS MATERIALIZED (SELECT name FROM n{k - 1} WHERE name NOT IN ({before}) ORDER BY round(d, 9) DESC, name LIMIT 1)")
        parts.append(f"n{k} AS MATERIALIZED (SELECT n.name, least(any_value(n.d), min(x.dist + y.dist)) AS d FROM n{k - 1} n JOIN l x ON x.name = n.name JOIN l y ON y.a = x.a AND y.name = (SELECT name FROM c{k}) GROUP BY n.name)")
    return f"WITH RECURSIVE {', '.join(parts)} " + " UNION ALL ".join(f"SELECT name FROM c{k}" for k in range(1, keep + 1))


def _dna(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """(pos, sequence, columns) of the records of DNA, with clean letters."""
    rows = records(spark, sf, "sequence", *columns).where("sequence IS NOT NULL")
    return rows.where(S.looks_like_dna(F.col("sequence"))).withColumn("sequence", S.dna_letters(F.col("sequence"))).where("sequence <> ''")


def _node_texts(spark: SparkSession, sf: str) -> DataFrame:
    """(node, t_text): for each node that records name, the one of the best node_score (of ties the smallest pos)."""
    rows = _dna(spark, sf, "node_to_align", "node_score").select("pos", "sequence", F.coalesce("node_score", F.lit(0.0)).alias("score"), F.explode(F.array_distinct(F.split(F.coalesce("node_to_align", F.lit("")), r"\s+"))).alias("node")).where("node <> ''")
    return rows.groupBy("node").agg(F.max_by("sequence", F.struct("score", -F.col("pos"))).alias("t_text"))


def _options(spark: SparkSession, sf: str) -> models.Options:
    """The DNA model with the data's own base frequencies."""
    share = {r["base"]: r["share"] or 0.25 for r in R.base_frequencies(table(spark, sf, "sequences")).collect()}
    return models.preset("dna", pi=tuple(max(1e-6, share[b]) for b in "ACGT"))


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    """(id, text_1, text_2): the first record of each family with each other one."""
    rows = _dna(spark, sf).select("pos", "sequence")
    of = msa.families(rows).where("family <> member")
    pairs = of.join(rows.select(F.col("pos").alias("family"), F.col("sequence").alias("text_1")), "family").join(rows.select(F.col("pos").alias("member"), F.col("sequence").alias("text_2")), "member")
    return pairs.select(F.concat_ws(":", F.col("family").cast("string"), F.col("member").cast("string")).alias("id"), "text_1", "text_2")


def _families(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """A tree for each family of records that share long stretches, and (node_id, sequence, quality) of its leaves."""
    rows = _dna(spark, sf, "quality").select("pos", "sequence", "quality")
    tree, tips = msa.balanced_forest(msa.families(rows))
    return tree, tips.join(rows.withColumnRenamed("pos", "member"), "member").select("node_id", "sequence", "quality")


@query
def p_matrix(spark, sf):
    rows = msa.p_matrices([0.0, 0.01, 0.1, 0.5], _options(spark, sf))
    return spark.createDataFrame(rows, "distance double, i int, j int, p double").withColumn("p", F.round("p", 8))


def _series(terms: int = 24) -> str:
    """The exponential series of the rate matrix (transition ratio 1, purines as pyrimidines), a term a step."""
    parts = [
        "s AS (SELECT regexp_replace(replace(upper(sequence), 'U', 'T'), '[^ACGT]', '', 'g') AS s FROM sequences)",
        "f0 AS (SELECT i, CAST(sum(length(s) - length(replace(s, b, ''))) AS DOUBLE) AS n FROM s, (VALUES (0, 'A'), (1, 'C'), (2, 'G'), (3, 'T')) v(i, b) GROUP BY i)",
        "f AS MATERIALIZED (SELECT i, n / sum(n) OVER () AS pi FROM f0)",
        "g AS MATERIALIZED (SELECT max(pi) FILTER (i = 0) AS a, max(pi) FILTER (i = 1) AS c, max(pi) FILTER (i = 2) AS g, max(pi) FILTER (i = 3) AS t FROM f)",
        "k AS MATERIALIZED (SELECT a + g AS r, c + t AS y, 1 / (4 * (a + g) * (c + t)) AS base, greatest(0, (0.5 - 2 / (4 * (a + g) * (c + t)) * (a * g + c * t)) / (2 * (a * g / (a + g) + c * t / (c + t)))) AS extra FROM g)",
        "q0 AS MATERIALIZED (SELECT x.i, y.i AS j, x.pi, base * y.pi + CASE WHEN x.i % 2 = y.i % 2 THEN extra * y.pi / CASE WHEN x.i % 2 = 0 THEN r ELSE y END ELSE 0 END AS q FROM f x, f y, k WHERE x.i <> y.i)",
        "z AS (SELECT sum(pi * q) AS z FROM q0)",
        "q AS MATERIALIZED (SELECT i, j, q / z AS q FROM q0, z UNION ALL SELECT i, i, -sum(q) / any_value(z) FROM q0, z GROUP BY i)",
        "d AS (SELECT unnest([0.0, 0.01, 0.1, 0.5]::DOUBLE[]) AS distance)",
        "t0 AS MATERIALIZED (SELECT distance, x.i, y.i AS j, CASE WHEN x.i = y.i THEN 1.0 ELSE 0.0 END::DOUBLE AS v FROM d, f x, f y)",
    ]
    parts += [f"t{n} AS MATERIALIZED (SELECT distance, a.i, q.j, sum(a.v * q.q * distance / {n}) AS v FROM t{n - 1} a JOIN q ON q.i = a.j GROUP BY distance, a.i, q.j)" for n in range(1, terms + 1)]
    every = " UNION ALL ".join(f"SELECT * FROM t{n}" for n in range(terms + 1))
    return f"WITH {', '.join(parts)} SELECT distance, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(sum(v), 8) AS p FROM ({every}) GROUP BY distance, i, j"


SQL["p_matrix"] = _series()


@query
def pairwise_viterbi(spark, sf):
    return msa.pairwise(_pairs(spark, sf), _options(spark, sf))


@query
def pairwise_anchored(spark, sf):
    return placement.anchored_share(_pairs(spark, sf), options=_options(spark, sf))


@query
def posterior(spark, sf):
    return msa.sums(_pairs(spark, sf), _options(spark, sf))


@query
def protein_alignment(spark, sf):
    """Translations of reading frames against those of the same name."""
    o = table(spark, sf, "orfs").where("translation IS NOT NULL").select("name", "frame", "translation").distinct()
    first = o.groupBy("name").agg(F.min("translation").alias("text_1"))
    pairs = o.join(first, "name").select(F.concat_ws("|", "name", F.col("frame").cast("string"), "translation").alias("id"), "text_1", F.col("translation").alias("text_2"))
    return msa.pairwise(pairs, models.preset("protein"))


def _dynamic_programme(distance: float = 0.1, terms: int = 16) -> str:
    """Best score and forward total of each pair in SQL: the model's series, then both recursions by anti-diagonals.

    A cell also carries the values of the cell to its left, which is the
    diagonal predecessor of the cell below that.
    """
    o = models.preset("protein")
    rates = [(i, j, v) for i, row in enumerate(models.WAG.strip().splitlines(), 1) for j, v in enumerate(row.split())]
    parts = [
        f"e(i, j, v) AS (VALUES {', '.join(f'({i}, {j}, {v}::DOUBLE)' for i, j, v in rates)})",
        f"f0(i, w) AS (VALUES {', '.join(f'({i}, {w}::DOUBLE)' for i, w in enumerate(models.WAG_PI.split()))})",
        "f AS MATERIALIZED (SELECT i, w / sum(w) OVER () AS pi FROM f0)",
        "q0 AS MATERIALIZED (SELECT e.i, e.j, x.pi, v * y.pi AS q FROM (SELECT i, j, v FROM e UNION ALL SELECT j, i, v FROM e) e JOIN f x ON x.i = e.i JOIN f y ON y.i = e.j)",
        "z AS (SELECT sum(pi * q) AS z FROM q0)",
        "q AS MATERIALIZED (SELECT i, j, q / z AS q FROM q0, z UNION ALL SELECT i, i, -sum(q) / any_value(z) FROM q0, z GROUP BY i)",
        "t0 AS MATERIALIZED (SELECT x.i, y.i AS j, CASE WHEN x.i = y.i THEN 1.0 ELSE 0.0 END::DOUBLE AS v FROM f x, f y)",
        *(f"t{n} AS MATERIALIZED (SELECT a.i, q.j, sum(a.v * q.q * {distance} / {n}) AS v FROM t{n - 1} a JOIN q ON q.i = a.j GROUP BY a.i, q.j)" for n in range(1, terms + 1)),
        "pr AS (SELECT i, j, sum(v) AS p FROM (" + " UNION ALL ".join(f"SELECT * FROM t{n}" for n in range(terms + 1)) + ") GROUP BY i, j)",
        "sc AS MATERIALIZED (SELECT list(ln(p / y.pi * 0.5 * (x.pi + y.pi) / x.pi)::FLOAT::DOUBLE ORDER BY pr.i, pr.j) AS s FROM pr JOIN f x ON x.i = pr.i JOIN f y ON y.i = pr.j)",
        f"g0 AS (SELECT least(0.49, greatest(1e-12, 1 - exp(-0.5 * {o.ins_rate + o.del_rate} * {distance}))) AS t)",
        f"g AS MATERIALIZED (SELECT ln(1 - 2 * t)::FLOAT::DOUBLE AS ng, ln(t)::FLOAT::DOUBLE AS go, ln({o.gap_extension})::FLOAT::DOUBLE AS ge, ln({o.end_gap_extension})::FLOAT::DOUBLE AS gt FROM g0)",
        "o AS (SELECT DISTINCT name, frame, translation AS b FROM orfs WHERE translation IS NOT NULL AND name IS NOT NULL)",
        f"pa AS MATERIALIZED (SELECT name || '|' || frame || '|' || b AS id, list_transform(string_split(a, ''), lambda c: instr('{models.AMINO}', c)) AS a, list_transform(string_split(b, ''), lambda c: instr('{models.AMINO}', c)) AS b, length(a) AS n, length(b) AS k FROM o, (SELECT min(b) AS a FROM o))",
    ]
    low, states = "-1e30::DOUBLE", ("m", "x", "y")
    start = ", ".join(["0.0::DOUBLE AS m", f"{low} AS x", f"{low} AS y", "1.0::DOUBLE AS fm", "0.0::DOUBLE AS fx", "0.0::DOUBLE AS fy", *(f"{low} AS p{v}" for v in states), *(f"0.0::DOUBLE AS pf{v}" for v in states)])
    # c: the cell above (u), the cell to the left (l) and the diagonal one (d) of each cell
    cell = ", ".join([*(f"u.{v} AS u{v}, u.f{v} AS uf{v}, l.{v} AS l{v}, l.f{v} AS lf{v}, u.p{v} AS d{v}, u.pf{v} AS df{v}" for v in states)])
    parts.append(
        f"""w AS (SELECT id, 0 AS d, 0 AS i, {start} FROM pa UNION ALL
SELECT c.id, c.d, c.i,
 CASE WHEN i > 0 AND c.d > i THEN s[(a[i] - 1) * 20 + b[c.d - i]] + greatest(dm + 2 * ng, dx + ng, dy + ng) ELSE {low} END,
 CASE WHEN i > 0 THEN greatest(ux + CASE WHEN c.d - i IN (0, k) THEN gt ELSE ge END, uy + go, um + ng + CASE WHEN c.d = i THEN 0 ELSE go END, {low}) ELSE {low} END,
 CASE WHEN c.d > i THEN greatest(ly + CASE WHEN i IN (0, n) THEN gt ELSE ge END, lx + go, lm + ng + CASE WHEN i = 0 THEN 0 ELSE go END, {low}) ELSE {low} END,
 CASE WHEN i > 0 AND c.d > i THEN exp(s[(a[i] - 1) * 20 + b[c.d - i]]) * (dfm * exp(2 * ng) + dfx * exp(ng) + dfy * exp(ng)) ELSE 0 END,
 CASE WHEN i > 0 THEN ufm * exp(ng + go) + ufx * exp(ge) + ufy * exp(go) ELSE 0 END,
 CASE WHEN c.d > i THEN lfm * exp(ng + go) + lfx * exp(go) + lfy * exp(ge) ELSE 0 END,
 coalesce(lm, {low}), coalesce(lx, {low}), coalesce(ly, {low}), coalesce(lfm, 0), coalesce(lfx, 0), coalesce(lfy, 0)
FROM (SELECT coalesce(u.id, l.id) AS id, coalesce(u.d, l.d) + 1 AS d, coalesce(u.i + 1, l.i) AS i, {cell} FROM w u FULL JOIN w l ON u.id = l.id AND u.i + 1 = l.i) c JOIN pa ON pa.id = c.id, g, sc WHERE c.d <= n + k AND i <= n AND c.d - i <= k)"""
    )
    return f"WITH RECURSIVE {', '.join(parts)} SELECT w.id, round(greatest(m + ng, x, y), 3) AS score, round(ln(fm * exp(ng) + fx + fy), 3) AS forward FROM w JOIN pa ON pa.id = w.id AND w.d = n + k AND w.i = n, g"


@query
def protein_scores(spark, sf):
    """Best score and forward total of each reading frame's translation with the smallest of all."""
    o = table(spark, sf, "orfs").where("translation IS NOT NULL AND name IS NOT NULL").select("name", "frame", "translation").distinct()
    least = o.agg(F.min("translation")).first()[0] or ""
    pairs = o.select(F.concat_ws("|", "name", F.col("frame").cast("string"), "translation").alias("id"), F.lit(least).alias("text_1"), F.col("translation").alias("text_2"))
    return msa.pairwise(pairs, models.preset("protein"), sums=True).select("id", F.round("score", 3).alias("score"), F.round("forward", 3).alias("forward"))


SQL["protein_scores"] = _dynamic_programme()


def _dna_programme(distance: float = 0.1) -> str:
    """Global and local scores of DNA pairs in SQL: the closed form of the model at equal base frequencies, and both recursions by anti-diagonals."""
    o, low, states = models.preset("dna"), "-1e30::DOUBLE", ("m", "x", "y", "h", "u", "v")
    letters = "".join(C.LETTER[m] for m in range(1, 16))  # by mask
    fourth, slow, fast = 0.25, f"exp(-{distance})", f"exp(-1.5 * {distance})"

    def coded(text: str) -> str:
        return f"list_transform(string_split(replace({text}, 'U', 'T'), ''), lambda c: CASE WHEN instr('{letters}', c) = 0 THEN 15 ELSE instr('{letters}', c) END)"

    parts = [
        f"g0 AS (SELECT least(0.49, greatest(1e-12, 1 - exp(-0.5 * {o.ins_rate + o.del_rate} * {distance}))) AS t)",
        f"g AS MATERIALIZED (SELECT ln(1 - 2 * t)::FLOAT::DOUBLE AS ng, ln(t)::FLOAT::DOUBLE AS go, ln({o.gap_extension})::FLOAT::DOUBLE AS ge, ln({o.end_gap_extension})::FLOAT::DOUBLE AS gt FROM g0)",
        f"b4 AS (SELECT x.i, y.i AS j, ln((CASE WHEN x.i = y.i THEN {fourth} + {fourth} * {slow} + 0.5 * {fast} WHEN x.i % 2 = y.i % 2 THEN {fourth} + {fourth} * {slow} - 0.5 * {fast} ELSE {fourth} - {fourth} * {slow} END) / {fourth})::FLOAT::DOUBLE AS s FROM (SELECT unnest(range(4)) AS i) x, (SELECT unnest(range(4)) AS i) y)",
        "ms AS (SELECT unnest(range(1, 16)) AS mask)",
        "sc AS MATERIALIZED (SELECT list(s ORDER BY x, y) AS s FROM (SELECT x.mask AS x, y.mask AS y, max(s) AS s FROM ms x, ms y, b4 WHERE (x.mask >> i) & 1 = 1 AND (y.mask >> j) & 1 = 1 GROUP BY x.mask, y.mask))",
        "o AS (SELECT DISTINCT name, frame, upper(dna) AS b FROM orfs WHERE dna IS NOT NULL AND name IS NOT NULL)",
        f"pa AS MATERIALIZED (SELECT name || '|' || frame || '|' || b AS id, {coded('a')} AS a, {coded('b')} AS b, length(a) AS n, length(b) AS k FROM o, (SELECT min(b) AS a FROM o))",
    ]
    start = {"m": "0.0::DOUBLE", "x": low, "y": low, "h": "0.0::DOUBLE", "u": low, "v": low}
    first = ", ".join([*(f"{start[v]} AS {v}" for v in states), *(f"{low} AS p{v}" for v in states)])
    cell = ", ".join(f"up.{v} AS u_{v}, l.{v} AS l_{v}, up.p{v} AS d_{v}" for v in states)
    pair = "(a[i] - 1) * 15 + b[c.d - i]"
    parts.append(
        f"""w AS (SELECT id, 0 AS d, 0 AS i, {first} FROM pa UNION ALL
SELECT c.id, c.d, c.i,
 CASE WHEN i > 0 AND c.d > i THEN s[{pair}] + greatest(d_m + 2 * ng, d_x + ng, d_y + ng) ELSE {low} END,
 CASE WHEN i > 0 THEN greatest(u_x + CASE WHEN c.d - i IN (0, k) THEN gt ELSE ge END, u_y + go, u_m + ng + CASE WHEN c.d = i THEN 0 ELSE go END, {low}) ELSE {low} END,
 CASE WHEN c.d > i THEN greatest(l_y + CASE WHEN i IN (0, n) THEN gt ELSE ge END, l_x + go, l_m + ng + CASE WHEN i = 0 THEN 0 ELSE go END, {low}) ELSE {low} END,
 CASE WHEN i > 0 AND c.d > i THEN greatest(0, d_h + CASE WHEN (a[i] & b[c.d - i]) <> 0 THEN 5 ELSE -4 END, u_h - 12, u_u - 4, l_h - 12, l_v - 4) ELSE 0 END,
 CASE WHEN i > 0 AND c.d > i THEN greatest(u_h - 12, u_u - 4) ELSE {low} END,
 CASE WHEN i > 0 AND c.d > i THEN greatest(l_h - 12, l_v - 4) ELSE {low} END,
 {", ".join(f"coalesce(l_{v}, {low})" for v in states)}
FROM (SELECT coalesce(up.id, l.id) AS id, coalesce(up.d, l.d) + 1 AS d, coalesce(up.i + 1, l.i) AS i, {cell} FROM w up FULL JOIN w l ON up.id = l.id AND up.i + 1 = l.i) c JOIN pa ON pa.id = c.id, g, sc WHERE c.d <= n + k AND i <= n AND c.d - i <= k)"""
    )
    return f"""WITH RECURSIVE {', '.join(parts)}, best AS (SELECT id, max(h) AS h FROM w GROUP BY id)
SELECT w.id, round(greatest(m + ng, x, y), 3) AS score, best.h AS local_score FROM w JOIN pa ON pa.id = w.id AND w.d = n + k AND w.i = n JOIN best ON best.id = w.id, g"""


@query
def dna_scores(spark, sf):
    """Best global and local score of each reading frame's DNA with the smallest of all."""
    o = table(spark, sf, "orfs").where("dna IS NOT NULL AND name IS NOT NULL").select("name", "frame", F.upper("dna").alias("dna")).distinct()
    least = o.agg(F.min("dna")).first()[0] or ""
    pairs = o.select(F.concat_ws("|", "name", F.col("frame").cast("string"), "dna").alias("id"), F.lit(least).alias("text_1"), F.col("dna").alias("text_2"))
    whole = msa.pairwise(pairs, models.preset("dna")).select("id", F.round("score", 3).alias("score"))
    part = placement.local_scores(pairs.select(F.col("id").alias("query"), F.lit("").alias("node"), F.col("text_1").alias("q_text"), F.col("text_2").alias("t_text")), models.preset("dna"))
    return whole.join(part.select(F.col("query").alias("id"), F.col("score").alias("local_score")), "id")


SQL["dna_scores"] = _dna_programme()


@query
def codon_alignment(spark, sf):
    o = table(spark, sf, "orfs").where("dna IS NOT NULL").select("name", "frame", F.upper("dna").alias("dna")).distinct()
    first = o.groupBy("name").agg(F.min("dna").alias("text_1"))
    pairs = o.join(first, "name").select(F.concat_ws("|", "name", F.col("frame").cast("string"), "dna").alias("id"), "text_1", F.col("dna").alias("text_2"))
    return msa.pairwise(pairs, models.preset("codon"))


@query
def progressive_msa(spark, sf):
    """The alignments of all families of similar records, each along its tree."""
    tree, leaves = _families(spark, sf)
    options = _options(spark, sf)
    return msa.aligned_rows(tree, msa.align_tree(tree, leaves, options), options)


def _given(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The families' trees, and their records as given alignments: filled with gaps on the right to equal lengths."""
    tree, leaves = _families(spark, sf)
    family = F.shiftright("node_id", 24)
    width = leaves.groupBy(family.alias("family")).agg(F.max(F.length("sequence")).alias("w"))
    return tree, leaves.withColumn("family", family).join(width, "family").select("node_id", F.expr("rpad(sequence, w, '-')").alias("sequence"))


@query
def reference_replay(spark, sf):
    """All rows, ancestors included, of given alignments read along their trees."""
    tree, rows = _given(spark, sf)
    return msa.replayed_rows(tree, rows, _options(spark, sf))


@query
def ancestor_events(spark, sf):
    """Substitutions, insertions and deletions on the branches of the families' trees, from their alignments."""
    tree, leaves = _families(spark, sf)
    options = _options(spark, sf)
    rows = materialise(msa.aligned_rows(tree, msa.align_tree(tree, leaves, options), options, ancestors=True), "rows")
    up = tree.where("parent_id IS NOT NULL").select("node_id", "parent_id")
    pairs = up.join(rows.select("node_id", F.col("sequence").alias("child")), "node_id").join(rows.select(F.col("node_id").alias("parent_id"), F.col("sequence").alias("parent")), "parent_id")
    return C.branch_events(pairs.select(F.col("node_id").alias("branch"), "parent", "child"))


def _candidate_parts(spark: SparkSession, sf: str, k: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(query, node) of records and their k best nodes of the hit list, (query, q_text) and (node, t_text)."""
    best = H.keep_best(H.merge_hits(table(spark, sf, "hits")), k).select("query", "node")
    q = _dna(spark, sf, "name").where("name IS NOT NULL").groupBy(F.col("name").alias("query")).agg(F.min_by("sequence", "pos").alias("q_text"))
    return best, q, _node_texts(spark, sf)


def _candidates(spark: SparkSession, sf: str, k: int = 3) -> DataFrame:
    """(query, node, q_text, t_text): records with their k best nodes of the hit list, spread by query."""
    best, q, t = _candidate_parts(spark, sf, k)
    t = materialise(t, "targets")
    # nodes' texts of up to 16 MB needn't be shuffled to each of their candidates
    few = (t.agg(F.sum(F.octet_length("t_text"))).first()[0] or 0) <= 16 << 20
    return best.join(F.broadcast(t) if few else t, "node").join(q, "query")


@query
def local_hits(spark, sf):
    """Local hits of the records on the consensus records."""
    q = _dna(spark, sf).select(F.col("pos").alias("query"), F.col("sequence").alias("q_text"))
    t = table(spark, sf, "contigs").dropDuplicates(["pos"]).where("sequence IS NOT NULL").select(F.col("pos").alias("target"), S.dna_letters(F.col("sequence")).alias("t_text"))
    return placement.search(q, t)


@query
def place_fragments(spark, sf):
    return placement.place_all(_candidates(spark, sf), options=_options(spark, sf), spread=False)


@query
def place_one_by_one(spark, sf):
    """Placement of one query after the other, each being a target for the next of its nodes."""
    best, q, t = _candidate_parts(spark, sf)
    q, t = materialise(q, "queries"), materialise(t, "targets")
    c = materialise(best.join(q.select("query"), "query").join(t.select("node"), "node"), "candidates")
    queries = R.global_rank(q.join(c.select("query").distinct(), "query", "left_semi"), [F.length("q_text").desc(), F.col("query")])
    return placement.place_in_turn(queries, t, c, options=_options(spark, sf))


@query
def guided_placement(spark, sf):
    """Queries placed at the one node their tag and node list name; both strands are tried."""
    tagged = T.placements_by_tag(records(spark, sf, "tid"), table(spark, sf, "tree_nodes")).select("pos", F.col("name").alias("node"))
    rows = _dna(spark, sf, "node_to_align").select("pos", F.col("pos").cast("string").alias("query"), F.col("sequence").alias("q_text"), F.explode(F.array_distinct(F.split(F.coalesce("node_to_align", F.lit("")), r"\s+"))).alias("node"))
    pairs = rows.join(tagged, ["pos", "node"]).join(_node_texts(spark, sf), "node")
    return placement.place_all(pairs, options=_options(spark, sf), both_strands=True, one_only=True)


@query
def discarded_queries(spark, sf):
    """All named records that place_fragments places nowhere, those without hits or without a record of their nodes included."""
    named = records(spark, sf, "name").where("name IS NOT NULL").select(F.col("name").alias("query")).distinct()
    return placement.discarded(named, place_fragments(spark, sf))


def _piles(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Reads under each node they name, and the seeds of those nodes."""
    names = F.array_distinct(F.split(F.coalesce("node_to_align", F.lit("")), r"\s+"))
    reads = _dna(spark, sf, "node_to_align", "num_duplicates").select(F.explode(names).alias("group"), "pos", "sequence", "num_duplicates").where("group <> ''")
    return reads, _node_texts(spark, sf).select(F.col("node").alias("group"), F.col("t_text").alias("seed"))


@query
def pileup(spark, sf):
    reads, seeds = _piles(spark, sf)
    return placement.pile_up(reads.select("group", "pos", "sequence"), seeds, _options(spark, sf))


@query
def pileup_contigs(spark, sf):
    """Consensus of each pile, reads weighted by their copies, the seed in lower case where too few reads are."""
    reads, seeds = _piles(spark, sf)
    piled, seed_rows = placement.pile(reads.select("group", "pos", "sequence"), seeds, _options(spark, sf))
    weights = reads.select("pos", F.when(F.col("num_duplicates") > 0, F.col("num_duplicates")).otherwise(1).alias("w")).distinct()
    return placement.contigs_of(piled, seed_rows, 2, 0.5, weights, fill=True)


@query
def pileup_branches(spark, sf):
    """Branch lengths around the insertion point of each read of a pile: seed, the pile's first read and the read."""
    reads, seeds = _piles(spark, sf)
    piled, seed_rows = placement.pile(reads.select("group", "pos", "sequence"), seeds, _options(spark, sf))
    sister = piled.groupBy("group").agg(F.min_by("row", "pos").alias("sister"))
    rows = piled.join(sister, "group").join(seed_rows.select("group", F.col("row").alias("parent")), "group").select(F.concat_ws(":", "group", F.col("pos").cast("string")).alias("id"), "parent", "sister", F.col("row").alias("query"))
    return C.three_point(C.pair_distances(rows), F.lit(0.1))


@query
def nj_tree(spark, sf):
    """Neighbour joining of the tags' consensus sequences."""
    from arborweave.queries_sequences import consensus_minimum

    texts = consensus_minimum(spark, sf).select(F.col("group").alias("id"), S.degap(F.col("sequence")).alias("text"))
    return placement.guide_tree(texts, 4)


@query
def thinned_leaves(spark, sf):
    """20 mutually distant ones of the leaves that hits name as nodes."""
    names = T.thin(table(spark, sf, "tree_nodes"), 20, table(spark, sf, "hits").select(F.col("node").alias("name")))
    return spark.createDataFrame([(x,) for x in names], "name string")


SQL["thinned_leaves"] = _thinning(20)


@query
def graph_checks(spark, sf):
    """Faults of all graphs of the replayed alignment: none."""
    from arborweave.functions import kernel as K

    tree, rows = _given(spark, sf)
    graphs = msa.replay_tree(tree, rows, _options(spark, sf))

    def check(batches):
        import pandas as pd

        for b in batches:
            yield pd.DataFrame([(int(r["node_id"]), f) for r in b.to_dict("records") for f in K.faults(msa.from_row(r))], columns=["node_id", "fault"])

    return graphs.mapInPandas(check, "node_id long, fault string")


@query
def sampled_paths(spark, sf):
    """A path drawn by its probability for each pair of a family; the seed is the pair's hash, so it is the same in every run."""
    return msa.sampled(_pairs(spark, sf), _options(spark, sf))


@query
def homopolymer_graphs(spark, sf):
    """Sites and edges of the records' graphs with shorter readings of equal bases."""
    rows = _dna(spark, sf, "quality").select(F.col("pos").alias("node_id"), "sequence", "quality")
    return msa.leaf_graphs(rows, _options(spark, sf), homopolymer=0.9).select(F.col("node_id").alias("pos"), F.size("states").alias("n_sites"), F.size("e_start").alias("n_edges"), F.aggregate("states", F.lit(0).cast("long"), lambda a, x: a + (x == 15).cast("long")).alias("n_unknown"))




SQL["homopolymer_graphs"] = f"""WITH {_R}, k AS (SELECT pos, upper(sequence) AS u, regexp_replace(replace(upper(sequence), 'U', 'T'), '[^ACGTRYMKWSBDHVN]', '', 'g') AS s, quality FROM r WHERE sequence IS NOT NULL),
d AS (SELECT pos, s, CASE WHEN length(quality) = length(s) THEN quality END AS q FROM k WHERE s <> '' AND length(regexp_replace(u, '[^ARNDCQEGHILKMFPSTWYV]', '', 'g')) > 0
  AND length(regexp_replace(u, '[^ACGTUN]', '', 'g')) / length(regexp_replace(u, '[^ARNDCQEGHILKMFPSTWYV]', '', 'g')) > 0.9),
m AS (SELECT pos, list_transform(range(1, length(s) + 1), lambda i: CASE WHEN ascii(q[i]) < 43 THEN 'N' ELSE s[i] END) AS l FROM d)
SELECT pos, CAST(len(l) AS INTEGER) AS n_sites, CAST(len(l) + 1 + len(list_filter(range(2, len(l) + 1), lambda i: l[i] = l[i - 1] AND (i = 2 OR l[i - 2] <> l[i - 1]))) AS INTEGER) AS n_edges,
CAST(len(list_filter(l, lambda x: x = 'N')) AS BIGINT) AS n_unknown FROM m"""


# exact round trips: what must come out is known, so SQL can say it

_CLEAN = "c AS (SELECT DISTINCT pos, regexp_replace(replace(upper(sequence), 'U', 'T'), '[^ACGTRYMKWSBDHVN]', '', 'g') AS s FROM contigs WHERE sequence IS NOT NULL)"


def _clean_contigs(spark: SparkSession, sf: str) -> DataFrame:
    """(pos, sequence) of the consensus records, with clean letters."""
    rows = table(spark, sf, "contigs").where("sequence IS NOT NULL").select("pos", S.dna_letters(F.col("sequence")).alias("sequence")).distinct()
    return rows.where("sequence <> ''")


def _frame_families(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The DNA of the reading frames of each name as a family: (tree, tips, (member, id, sequence))."""
    o = table(spark, sf, "orfs").where("dna IS NOT NULL AND name IS NOT NULL").select("name", S.dna_letters(F.col("dna")).alias("sequence"), "frame", "orf_start").distinct()
    name = F.concat_ws("|", "name", F.col("frame").cast("string"), F.col("orf_start").cast("string"), "sequence")
    rows = o.where("sequence <> ''").select(F.xxhash64(name).alias("member"), F.pmod(F.xxhash64("name"), F.lit(1 << 38)).alias("family"), name.alias("id"), "sequence")
    rows = materialise(rows.dropDuplicates(["member"]), "frames")
    tree, tips = msa.balanced_forest(rows.select("family", "member"))
    return tree, tips, rows.drop("family")


_FRAMES = """o AS (SELECT DISTINCT name, regexp_replace(replace(upper(dna), 'U', 'T'), '[^ACGTRYMKWSBDHVN]', '', 'g') AS s, frame, orf_start FROM orfs WHERE dna IS NOT NULL AND name IS NOT NULL),
g AS (SELECT name, concat_ws('|', name, frame, orf_start, s) AS id, s, count(*) OVER (PARTITION BY name) AS n FROM o WHERE s <> '')"""


@query
def frame_alignment(spark, sf):
    """The alignment of the frames of each name: each row's letters, and how many rows of the name are as wide as it."""
    tree, tips, rows = _frame_families(spark, sf)
    leaves = tips.join(rows, "member").select("node_id", "sequence")
    aligned = materialise(msa.aligned_rows(tree, msa.align_tree(tree, leaves)), "aligned")
    wide = aligned.groupBy("root", F.length("sequence").alias("w")).agg(F.count("*").alias("n_rows"))
    out = aligned.withColumn("w", F.length("sequence")).join(wide, ["root", "w"]).join(tips, "node_id").join(rows.select("member", "id"), "member")
    return out.select("id", S.degap(F.col("sequence")).alias("letters"), "n_rows")


SQL["frame_alignment"] = f"WITH {_FRAMES} SELECT id, s AS letters, n AS n_rows FROM g WHERE n > 1"


@query
def replay_roundtrip(spark, sf):
    """Given alignments (the frames of each name, filled with gaps on the right) read along trees and written again."""
    tree, tips, rows = _frame_families(spark, sf)
    member = tips.join(rows, "member")
    width = member.groupBy("family").agg(F.max(F.length("sequence")).alias("w"))
    given = member.join(width, "family").select("node_id", F.expr("rpad(sequence, w, '-')").alias("sequence"))
    out = msa.aligned_rows(tree, msa.replay_tree(tree, given))
    return out.join(tips, "node_id").join(rows.select("member", "id"), "member").select("id", "sequence")


SQL["replay_roundtrip"] = f"WITH {_FRAMES} SELECT id, rpad(s, CAST(max(length(s)) OVER (PARTITION BY name) AS INTEGER), '-') AS sequence FROM g WHERE n > 1"


@query
def place_identity(spark, sf):
    """Each consensus record placed at itself, those of odd pos as their reverse complement."""
    rows = _clean_contigs(spark, sf).where("length(sequence) >= 50").groupBy("pos").agg(F.min("sequence").alias("t_text"))
    odd = F.col("pos") % 2 == 1
    pairs = rows.select(F.col("pos").cast("string").alias("query"), F.col("pos").cast("string").alias("node"), F.when(odd, S.reverse_complement(F.col("t_text"))).otherwise(F.col("t_text")).alias("q_text"), "t_text")
    placed = placement.place_all(pairs, both_strands=True)
    return placed.select("query", "node", *(F.round(c, 6).alias(c) for c in ("score", "overlap", "identity")), "reversed")


SQL["place_identity"] = f"WITH {_CLEAN} SELECT DISTINCT CAST(pos AS VARCHAR) AS query, CAST(pos AS VARCHAR) AS node, 1.0::DOUBLE AS score, 1.0::DOUBLE AS overlap, 1.0::DOUBLE AS identity, pos % 2 = 1 AS reversed FROM c WHERE length(s) >= 50"


@query
def pile_identity(spark, sf):
    """The contig of the two overlapping parts of each consensus record, piled up on the first of them."""
    rows = materialise(_clean_contigs(spark, sf).where("length(sequence) >= 100 AND sequence NOT RLIKE '[^ACGT]'").groupBy("pos").agg(F.min("sequence").alias("s")), "whole")
    n = F.length("s")
    ends = F.array(F.struct(F.lit(0).alias("k"), F.expr("substring(s, 1, cast(length(s) * 4 / 5 as int))").alias("t")), F.struct(F.lit(1).alias("k"), F.expr("substring(s, cast(length(s) / 5 as int) + 1)").alias("t")))
    parts = rows.where(n >= 100).select(F.col("pos").cast("string").alias("group"), "pos", F.explode(ends).alias("x")).select("group", (F.col("pos") * 2 + F.col("x.k")).alias("pos"), F.col("x.k").alias("k"), F.col("x.t").alias("sequence"))
    piled, seeds = placement.pile(parts.select("group", "pos", "sequence"), parts.where("k = 0").select("group", F.col("sequence").alias("seed")))
    out = placement.contigs_of(piled, seeds, 1, 0.0)
    return out.select("group", "n_reads", S.degap(F.col("consensus")).alias("consensus"))


SQL["pile_identity"] = f"""WITH {_CLEAN} SELECT CAST(pos AS VARCHAR) AS "group", CAST(2 AS BIGINT) AS n_reads, min(s) AS consensus FROM c WHERE length(s) >= 100 AND NOT regexp_matches(s, '[^ACGT]') GROUP BY pos"""
