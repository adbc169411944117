"""The programmes in the JVM against those of kernel.py; none of them may leave it for Python."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from arborweave.functions import kernel as K
from arborweave.functions import models
from arborweave.plans import msa, placement

DNA = models.preset("dna")


def texts(n: int = 60) -> list[tuple[str, str, str]]:
    """Pairs of texts, of which most are like each other, odd ones among them."""
    rng = random.Random(5)
    out = [("e1", "A", "A"), ("e2", "ACGT", "NNNN"), ("e3", "a-c*g", "ACG"), ("e4", "ACGTTGCA", "é")]
    for k in range(n):
        x = "".join(rng.choices("ACGT", k=rng.randint(1, 90)))
        y = "".join(c for c in (rng.choice("ACGTN") + c if rng.random() < 0.05 else c for c in x) if rng.random() > 0.05) or "G"
        out.append((str(k), x, y if k % 3 else y[::-1]))
    return out


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_scores_in_jvm(spark):
    rows = texts()
    df = spark.createDataFrame(rows, "query string, q_text string, t_text string").withColumnRenamed("query", "node").selectExpr("node AS query", "node", "q_text", "t_text")
    for both in (False, True):
        placed = placement.score_pairs(df, both_strands=both)
        assert "MapInPandas" not in plan(placed)
        got = {r["query"]: r for r in placed.collect()}
        model = models.model(DNA)
        scores = model.at(0.101)
        flip = str.maketrans("ACGTUNRYKMSWBDHV", "TGCAANYRMKSWVHDB")
        for name, q, t in rows:
            best = None
            for back in (False, True)[: 1 + both]:
                a, b = model.encode(t), model.encode(q.upper().translate(flip)[::-1] if back else q)
                m = [(int(a[x - 1]), int(b[y - 1])) for s, x, y, _, _ in K.align_many([(a, b)], scores)[0].steps if s == K.M]
                itself = sum(scores.pair(int(s), int(s)) for s in b)
                one = (sum(scores.pair(x, y) for x, y in m) / itself if itself > 0 else 0.0, len(m) / len(b), sum(x & y != 0 for x, y in m) / len(m) if m else 0.0, back)
                if best is None or one[1] > best[1]:
                    best = one
            assert tuple(got[name])[2:] == best


def test_hopeless_pairs_are_not_aligned(spark):
    rng = random.Random(11)
    rows = texts(120)
    for k in range(60):
        x = "".join(rng.choices("ACGT", k=rng.randint(120, 260)))
        y = "".join(rng.choices("ACGT", k=rng.randint(120, 260)))
        rows.append((f"u{k}", x, y))
        # a part of each, and one with a part inside
        rows.append((f"p{k}", x, y[: rng.randint(0, 90)] + x[20 : 20 + rng.randint(30, 100)] + y[90 : rng.randint(90, 200)]))
    df = spark.createDataFrame(rows, "node string, q_text string, t_text string").selectExpr("node AS query", "node", "q_text", "t_text")
    for both in (False, True):
        every = {r["query"]: tuple(r) for r in placement.score_pairs(df, both_strands=both).collect()}
        assert len(every) == len(rows)
        for least in (0.0, 0.2, 0.5, 0.9, 1.0):
            got = {r["query"]: tuple(r) for r in placement.score_pairs(df, both_strands=both, least_overlap=least).collect()}
            assert all(every[n] == x for n, x in got.items())
            assert {n for n, x in every.items() if x[3] > least} <= set(got)
            if least == 0.5:
                assert sum(n[0] == "u" for n in got) < 10
                assert {r["query"] for r in placement.accepted_pairs(df, least, both_strands=both).collect()} == {n for n, x in every.items() if x[2] >= 0.05 and x[3] > least and x[4] > 0.5}
    protein = models.preset("protein")
    every = {r["query"]: tuple(r) for r in placement.score_pairs(df, options=protein).collect()}
    got = {r["query"]: tuple(r) for r in placement.score_pairs(df, options=protein, least_overlap=0.5).collect()}
    assert all(every[n] == x for n, x in got.items()) and {n for n, x in every.items() if x[3] > 0.5} <= set(got)


def test_pairs_from_a_join_are_not_shuffled_again(spark):
    x = "ACGTTGCATTCAGGAC" * 4
    df = spark.createDataFrame([("q", "n", x, x), ("r", "n", x[:40], x)], "query string, node string, q_text string, t_text string")
    spread, kept = placement.place_all(df), placement.place_all(df, spread=False)
    assert plan(spread).count("REPARTITION_BY_NUM") == 1 and "REPARTITION_BY_NUM" not in plan(kept)
    assert sorted(map(tuple, spread.collect())) == sorted(map(tuple, kept.collect())) and kept.count() == 2


def test_piles_in_jvm(spark):
    rows = [(n, x, y) for n, x, y in texts() if n[0] != "e"]
    reads = spark.createDataFrame([(n, k, y) for k, (n, _, y) in enumerate(rows)], "group string, pos long, sequence string")
    roots = spark.createDataFrame([(n, x) for n, x, _ in rows], "group string, root string")
    piled = placement._on_roots(reads, roots, DNA, 0.5, 0.5, False)
    assert "MapInPandas" not in plan(piled)
    got = {r["group"]: r for r in piled.collect()}
    model = models.model(DNA)
    for n, x, y in rows:
        a, b = model.encode(x), model.encode(y)
        m = [(p, q) for s, p, q, _, _ in K.align_many([(a, b)], model.at(0.101))[0].steps if s == K.M]
        overlap, identity = len(m) / len(b), sum(int(a[p - 1]) & int(b[q - 1]) != 0 for p, q in m) / len(m) if m else 0.0
        assert (n in got) == (overlap > 0.5 and identity > 0.5)
        if n in got:
            r = got[n]
            assert (r["overlap"], r["identity"], r["symbols"]) == (overlap, identity, model.decode(b))
            assert [(s, q) for q, (s, k) in enumerate(zip(r["sites"], r["nths"]), 1) if k == 0] == m


def pairs_of(spark):
    return spark.createDataFrame(texts(), "id string, text_1 string, text_2 string")


def test_anchored_in_jvm(spark):
    got = placement.anchored_share(pairs_of(spark))
    assert "MapInPandas" not in plan(got)
    want = msa.pairwise(pairs_of(spark), anchors=True).select("id", "score")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_sums_in_jvm(spark):
    long = "ACGTTGCATT" * 50  # so long that sums are made of logarithms
    rows = pairs_of(spark).unionByName(spark.createDataFrame([("long", long, long[7:])], "id string, text_1 string, text_2 string"))
    total = msa.sums(rows)
    assert "MapInPandas" not in plan(total)
    got = {r["id"]: tuple(r)[1:] for r in total.collect()}
    for r in msa.pairwise(rows, sums=True).collect():
        assert got[r["id"]] == pytest.approx((r["forward"], r["backward"], r["mean_posterior"]), abs=1e-9)


def test_paths_drawn_in_jvm(spark):
    from pyspark.sql import functions as F

    drawn = msa.sampled(pairs_of(spark))
    assert "MapInPandas" not in plan(drawn)
    got = {r["id"]: (r["n_columns"], r["n_match"]) for r in drawn.collect()}
    model = models.model(DNA)
    for i, x, y, seed in pairs_of(spark).withColumn("seed", F.pmod(F.xxhash64("id"), F.lit(1 << 31))).collect():
        path = K.sample(K.graph_of(model.encode(x)), K.graph_of(model.encode(y)), model.at(0.1), seed)
        assert got[i] == (len(path), sum(s == K.M for s, _, _ in path))


def test_windows_travel_in_pieces(spark):
    from arborweave.operators import hits as H

    rng = random.Random(9)
    base = ["".join(rng.choices("ACGT", k=120)) for _ in range(5)]
    rows = [(k, base[k % 5][k % 17 :] + base[(k + 1) % 5][: k % 40]) for k in range(40)] + [(90, "A" * 60), (91, "A" * 60), (92, "ACG"), (93, ""), (94, "N" * 30 + base[0])]
    first, want = {}, {}
    for k, t in rows:
        for w in {t[i : i + 24] for i in range(len(t) - 23)}:
            if first.setdefault(w, k) != k:
                want[k, first[w]] = want.get((k, first[w]), 0) + 1
    df = spark.createDataFrame(rows, "id long, text string")
    assert {(r["id"], r["head"]): r["c"] for r in H.shared_with_first(df).collect()} == want
    # a few bytes a letter: fewer pieces than a third of the windows
    pieces = df.where("length(text) >= 24").mapInArrow(H._runs(24, 12, 4), "bucket int, id long, piece string").count()
    assert 3 * pieces < sum(max(0, len(t) - 23) for _, t in rows)


def test_whole_values_and_way_back_give_the_same(spark):
    """Texts of more cells than are kept as values are aligned the other way, with the same scores."""
    rng = random.Random(12)
    source = (models.__file__.rsplit("/", 1)[0]) + "/Kernel.java"
    with open(source) as f:
        assert "static final int WHOLE = 1 << 20;" in f.read()
    model = models.model(DNA)
    scores = model.at(0.101)
    rows = []
    for k, n in enumerate((700, 1000, 1023, 1040, 1200)):
        x = "".join(rng.choices("ACGT", k=n))
        rows.append((str(k), x, "".join(c for c in x if rng.random() > 0.1) + "ACGTACGT"))
    got = {r["query"]: r for r in placement.score_pairs(spark.createDataFrame(rows, "query string, t_text string, q_text string").withColumn("node", F.lit("n"))).collect()}
    for name, t, q in rows:
        a, b = model.encode(t), model.encode(q)
        m = [(int(a[x - 1]), int(b[y - 1])) for s, x, y, _, _ in K.align_many([(a, b)], scores)[0].steps if s == K.M]
        assert got[name]["overlap"] == len(m) / len(b) and got[name]["identity"] == sum(x & y != 0 for x, y in m) / len(m)


def test_places_counted_on_arrow_buffers():
    """Symbols at places before, on and between sites, and the reads that pass on to the next site."""
    reads = [("g", [0, 0, 3, 3, 4], [-2, -1, 0, 1, 0], list("TGACA")), ("g", [3, 4, 4], [0, 0, 1], list("AGG")), ("h", [3, 3], [0, 1], list("AC")), ("g", [1], [0], ["A"])]
    want = {}
    for g, sites, nths, symbols in reads:
        on = [s for s, k in zip(sites, nths, strict=True) if k == 0]
        for key in [*((g, *x) for x in zip(sites, nths, symbols, strict=True)), *((g, s, 0, "") for s in range(min(on), max(on)))]:
            want[key] = want.get(key, 0) + 1
    kinds = pa.schema([("group", pa.string()), ("sites", pa.list_(pa.int32())), ("nths", pa.list_(pa.int32())), ("symbols", pa.list_(pa.string()))])
    batch = pa.RecordBatch.from_pylist([dict(zip(kinds.names, r, strict=True)) for r in reads], kinds)
    got = [tuple(r.values()) for b in placement._counted([batch]) for r in b.to_pylist()]
    assert {x[:-1]: x[-1] for x in got} == want and len(got) == len(want)


def test_gapped_rows_dont_pass_through_the_driver(spark):
    """Tables that compress well are small files, yet are never broadcast."""
    tree = spark.createDataFrame([(1, None, None, None, 1), (2, 1, 0, 0.1, 0), (3, 1, 1, 0.1, 0)], "node_id long, parent_id long, side int, dist double, height int")
    graphs = msa.replay_tree(tree, spark.createDataFrame([(2, "AC-G" * 20), (3, "A-TG" * 20)], "node_id long, sequence string"))
    level = spark.createDataFrame([(1, 2, 3)], "node_id long, a long, b long")
    assert "Broadcast" not in plan(msa._joined(level, graphs))
    got = {(r["node_id"], r["sequence"]) for r in msa.aligned_rows(tree, graphs).collect()}
    assert got == {(2, "AC-G" * 20), (3, "A-TG" * 20)}


def test_local_hits_in_jvm(spark):
    rng = random.Random(4)
    targets = [(k, "".join(rng.choices("ACGT", k=80))) for k in range(5)]
    flip = str.maketrans("ACGT", "TGCA")
    queries = [(k, t[10:60] if k % 2 else t[5:70].translate(flip)[::-1]) for k, t in targets]
    found = placement.search(spark.createDataFrame(queries, "query long, q_text string"), spark.createDataFrame(targets, "target long, t_text string"))
    assert "MapInPandas" not in plan(found)
    model = models.model(DNA)
    got = {(r["query"], r["target"]): tuple(r)[2:] for r in found.collect()}
    for (k, q), (_, t) in zip(queries, targets, strict=True):
        score, a, b, c, d = K.local(model.encode(q if k % 2 else q.translate(flip)[::-1]), model.encode(t))
        assert got[k, k] == (score, *((a, b) if k % 2 else (len(q) - a, len(q) - b)), c, d)


def test_trees_are_aligned_in_jvm(spark, monkeypatch):
    """All graphs of a forest, edges and their weights included, are those of kernel.align(), which the levels no longer need."""
    rng = random.Random(11)
    members, leaves = [], []
    for family in range(4):
        text = "".join(rng.choices("ACGT", k=rng.choice([1, 40, 90])))
        for k in range(9):
            own = "".join(c for c in text for c in rng.choice([c] * 16 + ["", c + "A", "N", "R", c * 3])) or "G"
            members.append((family, 100 * family + k))
            leaves.append((100 * family + k, own))
    tree, tips = msa.balanced_forest(spark.createDataFrame(members, "family long, member long"))
    tree = tree.withColumn("dist", F.when(F.col("node_id") % 3 == 0, 0.2).otherwise(F.col("dist")))
    leaves = tips.join(spark.createDataFrame(leaves, "member long, sequence string"), "member").select("node_id", "sequence")

    def graphs(homopolymer):
        return {r["node_id"]: r for r in msa.align_tree(tree, leaves, DNA, homopolymer=homopolymer).collect()}

    for homopolymer in (None, 0.8):
        with monkeypatch.context() as m:
            m.setattr(msa, "_paths", lambda *a: None, raising=False)
            want = graphs(homopolymer)
        with monkeypatch.context() as m:
            seen, climb = [], msa._climb
            m.setattr(msa, "_climb", lambda *a: seen.append(a[4]) or climb(*a))
            got = graphs(homopolymer)
        assert all(seen) and len(seen) == 1  # the paths are columns of the rows
        assert got == want and len(got) == 4 * 17
        assert any(len(r["e_start"]) > len(r["states"]) + 1 for r in got.values())


def test_ancestor_events_from_paths_of_the_jvm(spark, monkeypatch):
    """The events on the branches are the same with the paths of either; the levels of the trees take those of the JVM."""
    from arborweave import queries_alignment

    got = sorted(map(str, queries_alignment.ancestor_events(spark, "/root/testdata/sf0.001").collect()))
    with monkeypatch.context() as m:
        m.setattr(msa, "_paths", lambda *a: None)
        want = sorted(map(str, queries_alignment.ancestor_events(spark, "/root/testdata/sf0.001").collect()))
    assert got == want and got


def test_replay_in_jvm(spark):
    """The rows of a given alignment's nodes are those of its graphs, and need neither graphs nor Python."""
    rng = random.Random(3)
    members, rows = [], []
    for family in range(5):
        width, n = rng.choice([1, 30, 70]), rng.choice([2, 3, 9])
        for k in range(n):
            members.append((family, 100 * family + k))
            rows.append((100 * family + k, "".join("-" if c % 7 == 3 else rng.choice("ACGTUNRYacgt?---") for c in range(width))))
    rows[-1] = (rows[-1][0], "-" * len(rows[-1][1]))
    tree, tips = msa.balanced_forest(spark.createDataFrame(members, "family long, member long"))
    given = tips.join(spark.createDataFrame(rows, "member long, sequence string"), "member").select("node_id", "sequence")
    got = msa.replayed_rows(tree, given, DNA)
    assert "InPandas" not in plan(got)
    want = msa.aligned_rows(tree, msa.replay_tree(tree, given, DNA), DNA, ancestors=True)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 20
    with pytest.raises(Exception, match="differ in length"):
        msa.replayed_rows(tree, given.withColumn("sequence", F.concat("sequence", F.repeat(F.lit("A"), F.col("node_id").cast("int") % 2))), DNA).collect()


def test_batches_are_counted_in_bounded_parts():
    """However many reads a batch has, what is made of it at once is bounded, and the counts add up to the same."""
    from collections import Counter

    from arborweave.functions import packed
    from arborweave.operators import columns

    n, w = 3000, 300
    names = pa.array([str(k % 1000) for k in range(n)])
    sites = pa.array([list(range(1, w + 1))] * n, pa.list_(pa.int32()))
    reads = pa.RecordBatch.from_arrays([names, sites, pa.array([[0] * w] * n, pa.list_(pa.int32())), pa.array([list("ACG" * (w // 3))] * n)], ["group", "sites", "nths", "symbols"])
    texts = pa.RecordBatch.from_arrays([names, pa.array([2] * n), pa.array([5] * n), pa.array(["ACG" * (w // 3)] * n)], ["group", "w", "at", "text"])
    assert [p.num_rows for p in packed.parts(texts, 3, 1000)][:2] == [3, 3] and [p.num_rows for p in packed.parts(texts.slice(0, 2), 3, 10)] == [1, 1] and not [*packed.parts(texts.slice(0, 0), 3)]
    places, cells = list(placement._counted(iter([reads]))), list(columns._count_letters(iter([texts])))
    assert min(len(places), len(cells)) > 1 and max(b.num_rows for b in places + cells) <= 2 << 18
    passed, held = Counter(), Counter()
    for b in places:
        for *place, count in zip(*(c.to_pylist() for c in b.columns), strict=True):
            passed[tuple(place)] += count
    for b in cells:
        for group, col, *_, count in zip(*(c.to_pylist() for c in b.columns), strict=True):
            held[group, col] += count
    assert len(passed) == 1000 * (2 * w - 1) and set(passed.values()) == {3}
    assert len(held) == 1000 * w and set(held.values()) == {6}
