import random

import numpy as np
import pytest

from arborweave.functions import kernel as K
from arborweave.functions import models as Mo
from arborweave.operators import hits as H
from arborweave.operators import trees as T
from arborweave.plans import msa, placement
from arborweave.sources import formats, writers

from .conftest import rows

LOW = -1e30


def brute(a, b, sc):
    """The best score by a plain loop over cells and edges."""
    n, m, s, v = a.n, b.n, sc.matrix(a.states, b.states), {(0, 0, 0): 0.0}
    ins = [[[(int(x), float(np.log(float(w)))) for x, e, w in zip(g.start, g.end, g.weight) if e == i] for i in range(g.n + 2)] for g in (a, b)]

    def at(*k):
        return v.get(k, LOW)

    for i in range(n + 1):
        for j in range(m + 1):
            if i and j:
                v[0, i, j] = s[i - 1, j - 1] + max(at(st, p, q) + add + x + y for p, x in ins[0][i] for q, y in ins[1][j] for st, add in ((0, 2 * sc.no_gap), (1, sc.no_gap), (2, sc.no_gap)))
            for st, other, k, edge, still in ((1, 2, i, j in (0, m), j), (2, 1, j, i in (0, n), i)):
                if k:
                    best = LOW
                    for p, _ in ins[st - 1][k]:
                        old = (p, j) if st == 1 else (i, p)
                        best = max(best, at(st, *old) + (sc.end_extend if edge else sc.extend), at(other, *old) + sc.open, at(0, *old) + sc.no_gap + (sc.first_open if still == 0 else sc.open))
                    v[st, i, j] = best
    return max(at(st, p, q) + add for p, x in ins[0][n + 1] for q, y in ins[1][m + 1] for st, add in ((0, sc.no_gap + x + y), (1, 0), (2, 0)))


def some_graph(rng):
    n = rng.randint(1, 8)
    edges = {(i, i + 1): 1.0 for i in range(n + 1)}
    for _ in range(rng.randint(0, 3)):
        x = rng.randint(0, n - 1)
        edges.setdefault((x, rng.randint(x + 2, n + 1)), 0.5)
    return K.graph_of(np.array([1 << rng.randint(0, 3) for _ in range(n)]), [(a, b, w) for (a, b), w in edges.items()])


def test_viterbi_against_brute_force():
    model = Mo.model(Mo.preset("dna"))
    sc, rng = model.at(0.2), random.Random(2)
    for _ in range(150):
        a, b, c = (some_graph(rng) for _ in range(3))
        path = K.align(a, b, sc)
        assert path.score == pytest.approx(brute(a, b, sc), abs=1e-9)
        parent = K.parent_of(a, b, path, model, 0.1, 0.1)
        assert not K.faults(parent)
        assert K.align(parent, c, sc).score == pytest.approx(brute(parent, c, sc), abs=1e-9)


def test_many_pairs_at_once():
    rng = random.Random(5)
    for kind, letters in (("dna", "ACGTN"), ("protein", "ARNDCQEGHX")):
        model = Mo.model(Mo.preset(kind))
        texts = [("".join(rng.choice(letters) for _ in range(rng.randint(0, 25))), "".join(rng.choice(letters) for _ in range(rng.randint(0, 25)))) for _ in range(80)]
        pairs = [(model.encode(a), model.encode(b)) for a, b in texts]
        for (a, b), got in zip(pairs, K.align_many(pairs, model.at(0.1))):
            want = K.align(K.graph_of(a), K.graph_of(b), model.at(0.1))
            assert got.score == pytest.approx(want.score, abs=1e-9) and got.steps == want.steps and (got.left_stop, got.right_stop) == (want.left_stop, want.right_stop)


def test_models():
    for kind in ("dna", "protein", "codon"):
        m = Mo.model(Mo.preset(kind))
        p = m.probabilities(0.3)
        assert np.allclose(p.sum(1), 1) and np.allclose(m.probabilities(0.0), np.eye(m.size), atol=1e-9)
        q, pi = m.rates
        assert np.allclose(pi[:, None] * q, (pi[:, None] * q).T) and -(pi * np.diag(q)).sum() == pytest.approx(1)
    q = Mo.dna_rates(np.array([0.3, 0.2, 0.2, 0.3]), kappa=4.0)
    pi = np.array([0.3, 0.2, 0.2, 0.3])
    ts = sum(pi[i] * q[i, j] for i, j in ((0, 2), (2, 0), (1, 3), (3, 1)))
    assert ts / (1 - ts) == pytest.approx(2.0)
    protein = Mo.model(Mo.preset("protein"))
    a, r = 1, 2
    assert protein.parent_state(a, r) == 3 and protein.parent_state(3, a) == a and protein.parent_state(protein.unknown, r) == r


def test_posterior_and_samples():
    model = Mo.model(Mo.preset("dna"))
    a, b = (K.graph_of(model.encode(t)) for t in ("ACGTACGGA", "ACGTCGGA"))
    f, g, post, _ = K.posterior(a, b, model.at(0.1))
    assert f == pytest.approx(g) and post.max() <= 1 + 1e-9
    assert K.sample(a, b, model.at(0.1), 4) == K.sample(a, b, model.at(0.1), 4)
    path = K.align(a, b, model.at(0.1))
    assert [x for _, x, _, _, _ in path.steps if x > 0] == list(range(1, 10))
    assert path.score <= f + 20


def test_homopolymer_reads_shorter():
    model = Mo.model(Mo.preset("dna"))
    long = model.encode("ACGGGGTC")
    plain, loose = K.graph_of(long), K.graph_of(long, K.homopolymer_edges(long))
    short = K.graph_of(model.encode("ACGGGTC"))
    assert not K.faults(loose)
    assert K.align(loose, short, model.at(0.1)).score > K.align(plain, short, model.at(0.1)).score


def test_progressive_alignment(spark):
    rng = random.Random(9)
    base = "".join(rng.choice("ACGT") for _ in range(60))
    texts = {1: base, 2: base[:20] + base[25:], 3: base[:40] + "TTGA" + base[40:], 4: base, 10: "ACGT" * 8, 11: "ACGT" * 7}
    tree, tips = msa.balanced_forest(spark.createDataFrame([(1, k) if k < 10 else (10, k) for k in texts], "family long, member long"))
    leaf = {r["node_id"]: texts[r["member"]] for r in tips.collect()}
    assert tree.count() == 10
    seqs = spark.createDataFrame(list(leaf.items()), "node_id long, sequence string")
    got = {r["node_id"]: (r["root"], r["sequence"]) for r in msa.aligned_rows(tree, msa.align_tree(tree, seqs)).collect()}
    assert set(got) == set(leaf)
    for node, (_, row) in got.items():
        assert row.replace("-", "") == leaf[node]
    for root in {r for r, _ in got.values()}:
        family = [row for r, row in got.values() if r == root]
        assert len({len(r) for r in family}) == 1 and all(set(c) != {"-"} for c in zip(*family))
    four = [row for _, row in got.values() if "A" in row and len(row) >= 60]
    assert len(four[0]) == 64  # one insertion of four, nothing else
    replay = {r["node_id"]: r["sequence"] for r in msa.aligned_rows(tree, msa.replay_tree(tree, spark.createDataFrame([(k, v) for k, (_, v) in got.items()], "node_id long, sequence string"))).collect()}
    assert replay == {k: v for k, (_, v) in got.items()}


def test_placement_and_piles(spark):
    rng = random.Random(4)
    x, y = ("".join(rng.choice("ACGT") for _ in range(80)) for _ in range(2))
    pairs = spark.createDataFrame([("q1", "x", x[10:70], x), ("q1", "y", x[10:70], y), ("q2", "y", y, y), ("q3", "x", "ACGT" * 10, x), ("q4", "x", None, x)], "query string, node string, q_text string, t_text string")
    placed = {(r["query"], r["node"]) for r in placement.place_all(pairs).collect()}
    assert {("q1", "x"), ("q2", "y")} <= placed and not any(q == "q4" for q, _ in placed)
    reads = spark.createDataFrame([("g", 1, x[:50]), ("g", 2, x[30:]), ("g", 3, "T" * 40)], "group string, pos long, sequence string")
    seeds = spark.createDataFrame([("g", x)], "group string, seed string")
    piled = placement.pile_up(reads, seeds)
    assert {r["pos"] for r in piled.collect()} >= {1, 2}
    contig = placement.contigs_of(piled.where("pos < 3"), seeds, least=1, share=0.0).first()
    assert contig["consensus"] == x and contig["n_reads"] == 2


def test_piles_grow(spark):
    # what all reads insert becomes a site, and reads beyond the seed's end are taken in when the pile has grown
    rng = random.Random(14)
    x = "".join(rng.choice("ACGT") for _ in range(200))
    seed = x[:60] + x[66:100]
    reads = [("g", k, x[a:b]) for k, (a, b) in enumerate([(10, 100), (20, 95), (40, 130), (45, 135), (70, 160), (110, 190), (112, 200)])] + [("g", 50, "".join(rng.choice("ACGT") for _ in range(60))), ("g", 51, None), ("g", 52, ""), ("h", 0, x[:50]), ("none", 1, x)]
    df = spark.createDataFrame(reads, "group string, pos long, sequence string")
    seeds = spark.createDataFrame([("g", seed), ("h", x[:50]), ("empty", ""), ("null", None)], "group string, seed string")
    piled, seed_rows = placement.pile(df, seeds, attempts=6)
    got = piled.collect()
    rows_ = {(r["group"], r["pos"]): r["row"] for r in got}
    text = {(g, p): t for g, p, t in reads}
    assert {("g", k) for k in range(7)} <= set(rows_) and ("h", 0) in rows_ and not {("g", 50), ("g", 51), ("g", 52), ("none", 1)} & set(rows_)
    assert all(row.replace("-", "") == text[k] for k, row in rows_.items())  # no residue is lost
    held = {r["group"]: r["row"] for r in seed_rows.collect()}
    assert held["g"].replace("-", "") == seed and {len(r) for k, r in rows_.items() if k[0] == "g"} == {len(held["g"])}
    contig = {r["group"]: r["consensus"].replace("-", "") for r in placement.contigs_of(piled, seed_rows, 1, 0.0, fill=True).collect()}
    assert contig["g"].upper() == x and contig["h"] == x[:50]
    once = {r["pos"] for r in placement.pile(df, seeds, attempts=1)[0].where("group = 'g'").collect()}
    assert 5 not in once and 6 not in once
    assert placement.pile_up(df.limit(0), seeds).count() == 0


def test_guide_tree_in_batches(spark):
    rng = random.Random(23)
    groups = {}
    for g in range(6):
        base = "".join(rng.choice("ACGT") for _ in range(120))
        for i in range(5):
            at = rng.randrange(110)
            groups[f"g{g}m{i}"] = base[:at] + rng.choice("ACGT") + base[at + 1 :]
    df = spark.createDataFrame([*groups.items(), ("short", "AC"), ("null", None), (None, "ACGTACGTACGT")], "id string, text string")
    for most in (4, 200):
        tree = placement.guide_tree(df, 8, most)
        nodes = {r["node_id"]: r for r in tree.collect()}
        assert sorted(r["name"] for r in nodes.values() if r["name"]) == sorted(groups) and len(nodes) == 2 * len(groups) - 1
        assert sum(r["parent_id"] is None for r in nodes.values()) == 1 and all(r["parent_id"] in nodes for r in nodes.values() if r["parent_id"] is not None)
        children = [r["parent_id"] for r in nodes.values() if r["parent_id"] is not None]
        assert all(children.count(p) == 2 for p in children)
        assert all(nodes[r["parent_id"]]["height"] > r["height"] for r in nodes.values() if r["parent_id"] is not None)
    sides = {}
    for r in nodes.values():  # all at once: each group is a subtree
        names, todo = set(), [r["node_id"]]
        while todo:
            x = todo.pop()
            names |= {nodes[x]["name"]} - {None}
            todo += [n for n, y in nodes.items() if y["parent_id"] == x]
        sides[frozenset(names)] = r
    assert sum(frozenset(f"g{g}m{i}" for i in range(5)) in sides for g in range(6)) >= 5
    assert placement.guide_tree(df.limit(0)).count() == 0


def test_thinned_leaves(spark):
    tree = spark.createDataFrame(formats.parse_newick("((a:1,b:2):3,(c:1,(d:5,e:4):1):2);"), formats.NODES)
    assert T.thin(tree, 2) == ["a", "d"] and T.thin(tree, 9) == list("abcde") and T.thin(tree, 1) == ["a"]
    assert T.thin(tree, 3, spark.createDataFrame([("b",)], "name string")) == ["b"] and T.thin(tree.limit(0), 3) == []


def test_trees(spark):
    text = "((a:0.1,b:0.2)#1#:0.3[&&NHX:TID=7],(c:0.1,(d:0.5,e:0.4):0.1):0.2);"
    nodes = formats.parse_newick(text)
    assert [r[3] for r in nodes if r[7] == 0] == list("abcde") and nodes[2][3] == "#1#" and nodes[2][5] == "7"
    assert formats.parse_newick(writers.newick_of([r[:6] for r in nodes], "nhx")) == [(*r[:6], r[6] and "[&&NHX:TID=7]", r[7]) for r in nodes]
    for bad in ("((a,b);", "a,b;", "", "(a,,b);"):
        with pytest.raises(ValueError):
            formats.parse_newick(bad)
    tree = spark.createDataFrame(nodes, formats.NODES)
    paths = {(r["node_id"], r["ancestor_id"]): r["depth"] for r in T.closure(tree).collect()}
    above = {r[0]: r[1] for r in nodes}

    def depth(n):
        return 0 if above[n] is None else 1 + depth(above[n])

    assert len(paths) == sum(1 + depth(n) for n in above) and all(paths[n, n] == 0 for n in above)
    assert {n: max(d for (x, _), d in paths.items() if x == n) for n in above} == {n: depth(n) for n in above}
    pruned = {r["name"]: r["dist"] for r in T.prune(tree, spark.createDataFrame([("a",), ("d",), ("e",)], "name string")).collect()}
    assert pruned["a"] == pytest.approx(0.4) and pruned["d"] == pytest.approx(0.5)
    far = T.midpoint(T.closure(tree), tree).first()
    assert far["length"] == pytest.approx(0.2 + 0.3 + 0.2 + 0.1 + 0.5)
    d = np.array([[0, 3, 7, 8], [3, 0, 8, 9], [7, 8, 0, 5], [8, 9, 5, 0]], float)
    joined = placement.neighbour_joining(list("abcd"), d)
    up = {r[0]: (r[1], r[4]) for r in joined}
    def dist(i, j):
        a, b = {}, 0.0
        k, s = i, 0.0
        while k is not None:
            a[k] = s
            s, k = s + (up[k][1] or 0), up[k][0]
        k = j
        while k not in a:
            b, k = b + up[k][1], up[k][0]
        return a[k] + b
    assert all(dist(i, j) == pytest.approx(d[i, j]) for i in range(4) for j in range(4) if i != j)


def test_formats_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "x TID=3", "ACGT" * 40, "I" * 160), (2, "a", None, "@CG", "@@I")], "pos long, name string, comment string, sequence string, quality string")
    writers.save(writers.fasta(df), f"file://{tmp_path}/f")
    got = rows(formats.read_fasta(spark, f"file://{tmp_path}/f").select("name", "sequence", "tid"))
    assert got == [("a", "@CG", ""), ("a", "ACGT" * 40, "3")]
    writers.save(writers.fastq(df), f"file://{tmp_path}/q")
    for size in (7, 64, 1 << 20):
        assert rows(formats.read_fastq(spark, f"file://{tmp_path}/q", size).select("sequence", "quality")) == [("@CG", "@@I"), ("ACGT" * 40, "I" * 160)]
    sites = spark.createDataFrame([("g", 0, "A"), ("g", 1, "C"), ("g", 2, "G")], "name string, site int, symbol string")
    edges = spark.createDataFrame([("g", 0, 1, 1.0), ("g", 1, 2, 0.5), ("g", 0, 2, 0.5)], "name string, start int, end int, weight float")
    writers.save(writers.graph(sites, edges), f"file://{tmp_path}/g")
    s, e = formats.read_graphs(spark, f"file://{tmp_path}/g")
    assert rows(s) == rows(sites) and rows(e) == rows(edges) and formats.graph_faults(s, e).count() == 0
    (tmp_path / "p").write_text(" 2 4\nab  AC GT\nc   A--T\n\nrest\n")
    assert rows(formats.read_phylip(spark, f"file://{tmp_path}/p")) == [("ab", "ACGT"), ("c", "A--T")]
    assert formats.sniff(spark, f"file://{tmp_path}/f") == "fasta"
    assert formats.read_options("a = 1 # x\nflag\n\n") == {"a": "1", "flag": "1"}


def test_anchors_and_tunnel(spark):
    pairs = spark.createDataFrame([("p", "AAACGTACGGTT", "CCACGTACGGCC"), ("q", None, "ACGT"), ("r", "AC", "AC")], "id string, text_1 string, text_2 string")
    assert rows(H.exact_anchors(pairs, 4)) == [("p", 2, 2, 8)]
    assert H.chain_anchors([(0, 0, 10, 10), (5, 20, 10, 9), (20, 2, 5, 5), (15, 15, 10, 10)]) == [(0, 0, 10, 10), (15, 15, 10, 10)]
    low, high = H.tunnel([(5, 5, 10, 1)], 20, 20, 2)
    assert low[10] <= 10 <= high[10] and high[10] - low[10] <= 8 and low[0] == 0 and high[20] == 20
    assert sorted(msa.local_anchors("AAACGTACGGTT", "CCACGTACGGCC", 4)) == [(2, 2, 8, 8.0)]


def test_tunnels_of_pairs_with_one_id(spark, tmp_path):
    """Two records of one name with a reading frame of the same place: the rows are those of the SQL."""
    import random

    import duckdb

    import __spark_entry__ as entry

    pick = random.Random(5)
    text = "".join(pick.choice("ACGT") for _ in range(150))
    spark.createDataFrame([(1, "x", text), (2, "x", "ACGTTGCAAC" * 5), (3, "y", text)], "pos long, name string, sequence string").selectExpr("*", *(f"string(NULL) AS {c}" for c in ("comment", "dna_sequence", "quality", "tid", "node_to_align")), *(f"0 AS {c}" for c in ("num_duplicates", "node_score", "query_strand")), *(f"timestamp'2026-01-01' AS {c}" for c in ("read_at", "loaded_at"))).coalesce(1).write.parquet(f"{tmp_path}/sequences.parquet")
    frames = [("x", 1, 10, text[100:130]), ("x", 1, 10, text[9:120]), ("x", 2, 10, text[9:120]), ("y", 1, 10, text[:60]), ("y", 1, 10, text[90:])]
    spark.createDataFrame(frames, "name string, frame int, orf_start int, dna string").coalesce(1).write.parquet(f"{tmp_path}/orfs.parquet")
    con = duckdb.connect()
    for t in ("sequences", "orfs"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    got = entry.queries()["tunnel_bounds"](spark, str(tmp_path)).select("id", "n_anchors", "coverage")
    want = con.sql(f"select id, n_anchors, coverage from ({entry.oracle_sql()['tunnel_bounds']})").fetchall()
    assert rows(got) == sorted(want, key=lambda t: tuple((x is not None, str(x)) for x in t)) and len(want) == 5


def test_local_alignment(spark):
    rng = random.Random(3)

    def plain(a, b):
        n, m = len(a), len(b)
        h, x, y = ([[0.0 if k == 0 else -1e18] * (m + 1) for _ in range(n + 1)] for k in range(3))
        best = 0.0
        for i in range(1, n + 1):
            for j in range(1, m + 1):
                x[i][j] = max(h[i - 1][j] - 12, x[i - 1][j] - 4)
                y[i][j] = max(h[i][j - 1] - 12, y[i][j - 1] - 4)
                h[i][j] = max(0.0, h[i - 1][j - 1] + (5 if a[i - 1] == b[j - 1] else -4), x[i][j], y[i][j])
                best = max(best, h[i][j])
        return best

    model = Mo.model(Mo.preset("dna"))
    for _ in range(60):
        a, b = ("".join(rng.choice("ACGT") for _ in range(rng.randint(0, 30))) for _ in range(2))
        b = b[:5] + a[3:20] + b[5:]
        score, i, k, j, m = K.local(model.encode(a), model.encode(b))
        assert score == plain(a, b) and (not score or plain(a[i:k], b[j:m]) == score)
    text = "".join(rng.choice("ACGT") for _ in range(120))
    q = spark.createDataFrame([(1, text[20:80]), (2, "ACGT"), (3, None)], "query long, q_text string")
    t = spark.createDataFrame([(7, text), (8, None)], "target long, t_text string")
    assert rows(placement.search(q, t)) == [(1, 7, 300.0, 0, 60, 20, 80)]


def test_discarded_are_all_that_are_placed_nowhere(spark):
    from arborweave import queries_alignment as Q

    sf = "/root/testdata/sf0.001"
    named = {r["name"] for r in Q.records(spark, sf).select("name").collect()} - {None}
    placed = {r["query"] for r in Q.place_fragments(spark, sf).select("query").collect()}
    assert {r["query"] for r in Q.discarded_queries(spark, sf).collect()} == named - placed


def test_local_search_on_both_strands_and_by_score(spark):
    rng = random.Random(5)
    text = "".join(rng.choice("ACGT") for _ in range(90))
    flipped = text.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    # 10 targets of many shared words and a low score, one of a higher score and few exact words
    short = [(i, text[:45]) for i in range(10)]
    spoilt = "".join(("A" if c != "A" else "C") if i % 14 == 13 else c for i, c in enumerate(text))
    q = spark.createDataFrame([(1, text), (2, flipped[10:70])], "query long, q_text string")
    t = spark.createDataFrame([*short, (50, spoilt), (60, text)], "target long, t_text string")
    got = rows(placement.search(q, t))
    assert {r[1] for r in got if r[0] == 1} >= {50, 60} and len([r for r in got if r[0] == 1]) == 10
    assert (2, 60, 300.0, 60, 0, 20, 80) in got


def test_placement_in_turn_is_sequential(spark):
    # each query is nearest to the one before it; the portions were blind to their own
    rng = random.Random(8)
    texts = ["".join(rng.choice("ACGT") for _ in range(120))]
    for k in range(4):
        texts.append("".join({"A": "C", "C": "G", "G": "T", "T": "A"}[c] if i % 30 == 7 * k else c for i, c in enumerate(texts[-1])))
    q = spark.createDataFrame([(f"q{k}", k, texts[k]) for k in range(1, 5)], "query string, place int, q_text string")
    t = spark.createDataFrame([("n", texts[0])], "node string, t_text string")
    c = spark.createDataFrame([(f"q{k}", "n") for k in range(1, 5)], "query string, node string")
    got = placement.place_in_turn(q, t, c)
    assert [(r["query"], r["node"], r["round"]) for r in got.orderBy("query").collect()] == [("q1", "n", 0), ("q2", "q1", 1), ("q3", "q2", 2), ("q4", "q3", 3)]


def test_texts_of_candidates_are_not_kept_with_their_pairs(spark, monkeypatch):
    # names of a pair are written, its texts only meet where they are scored
    rng = random.Random(3)
    text = "".join(rng.choice("ACGT") for _ in range(120))
    near = "".join({"A": "C", "C": "G", "G": "T", "T": "A"}[c] if i % 30 == 7 else c for i, c in enumerate(text))
    far = "".join(rng.choice("ACGT") for _ in range(120))
    kept = []
    write = placement.materialise
    monkeypatch.setattr(placement, "materialise", lambda df, what="step": kept.append((what, df.columns)) or write(df, what))
    todo = spark.createDataFrame([("q1", near), ("q2", near[:80]), ("q3", far)], "query string, q_text string")
    links = spark.createDataFrame([("q1", "n"), ("q2", "n"), ("q3", "n"), ("q1", "m")], "query string, node string")
    targets = spark.createDataFrame([("n", text), ("m", far[::-1])], "node string, t_text string")
    assert sorted(rows(placement._may_be_placed(todo, links, targets))) == [("q1",), ("q2",)]
    assert {tuple(c) for what, c in kept if what == "pairs"} == {("query", "node", "origin")}


def test_graphs_are_written_without_a_broadcast(spark, tmp_path):
    """Sites and edges of a small file may be many; graphs that are rows already give the same text."""
    from arborweave.session import materialise

    sites = materialise(spark.createDataFrame([("g", 0, "A"), ("g", 1, "C"), ("g", 2, "G"), ("h", 0, "T")], "name string, site int, symbol string"), "sites")
    edges = materialise(spark.createDataFrame([("g", 0, 1, 1.0), ("g", 1, 2, 0.5), ("g", 0, 2, 0.5)], "name string, start int, end int, weight float"), "edges")
    text = writers.graph(sites, edges)
    assert "Broadcast" not in text._jdf.queryExecution().executedPlan().toString()
    into = "sites array<struct<site: int, symbol: string, into: array<struct<start: int, end: int, weight: float>>>>"
    graphs = spark.createDataFrame([("g", [(0, "A", None), (1, "C", [(0, 1, 1.0)]), (2, "G", [(0, 2, 0.5), (1, 2, 0.5)])]), ("h", [(0, "T", [])])], f"name string, {into}")
    assert rows(writers.graph_rows(graphs)) == rows(text) == [("g", "#g\n0 A\n1 C; 0 1 1.00000\n2 G; 0 2 0.500000; 1 2 0.500000"), ("h", "#h\n0 T")]


def test_graph_roundtrip_moves_no_sites(spark, monkeypatch):
    """What is written needs no shuffle and no broadcast of single sites: each record's graph is one row from the start."""
    from arborweave import queries_formats

    seen, saved = [], queries_formats._saved
    monkeypatch.setattr(queries_formats, "_saved", lambda s, lines, *a: seen.append(lines._jdf.queryExecution().executedPlan().toString()) or saved(s, lines, *a))
    got = queries_formats.graph_roundtrip(spark, "/root/testdata/sf0.001")
    assert "Broadcast" not in seen[0] and "Join" not in seen[0] and got.where("kind = 'site'").count() > got.where("kind = 'edge'").count() > 0
