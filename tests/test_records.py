import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from arborweave.operators import record_keys as K
from arborweave.operators import records as R
from arborweave.operators import skew
from arborweave.operators.components import components
from arborweave.sources.raw_records import classify, found, loaded, split_line

from .conftest import rows

SEQ = "pos long, name string, comment string, sequence string, tid string, num_duplicates int, node_to_align string, node_score double, read_at timestamp, loaded_at timestamp"


def seqs(spark, data):
    filled = [dict.fromkeys([c.split()[0] for c in SEQ.split(", ")]) | d for d in data]
    return spark.createDataFrame([tuple(d.values()) for d in filled], SEQ)


def test_skewed_aggregate_equals_plain(spark):
    rng = random.Random(1)
    data = [("hot" if rng.random() < 0.6 else f"k{rng.randint(0, 50)}" if rng.random() < 0.9 else None, rng.choice([None, 1, 2])) for _ in range(2000)]
    df = spark.createDataFrame(data, "key string, v int").withColumn("i", F.monotonically_increasing_id())
    got = {r["key"]: (r["n"], r["s"], r["m"]) for r in skew.aggregate_skewed(df, "key", [("n", "count", "*"), ("s", "sum", "v"), ("m", "max", "v")], share=0.1).collect()}
    want = defaultdict(list)
    for k, v in data:
        if k is not None:
            want[k].append(v)
    assert got == {k: (len(v), sum(x for x in v if x is not None) if any(x is not None for x in v) else None, max((x for x in v if x is not None), default=None)) for k, v in want.items()}


def test_skewed_joins_equal_plain(spark):
    left = spark.createDataFrame([(i % 7 if i % 3 else 0, i) for i in range(500)] + [(None, -1)], "k int, v int")
    right = spark.createDataFrame([(i, f"r{i}") for i in range(0, 9, 2)], "k int, w string")
    for how in ("inner", "left_semi", "left_anti", "left"):
        assert rows(skew.join_skewed(left, right, "k", how, share=0.05)) == rows(left.join(right, "k", how))
    counted = right.join(left.groupBy("k").agg(F.count("*").alias("n")), "k")
    for how in ("inner", "left_semi"):
        assert rows(skew.join_counted(left, counted, ["k"], "n", 501, how, least=50)) == rows(left.join(counted.drop("n"), "k", how))


def test_keys_per_record(spark):
    df = seqs(spark, [
        {"pos": 1, "tid": " a ", "node_to_align": "x  y x", "num_duplicates": 2},
        {"pos": 1, "tid": " a ", "node_to_align": "x  y x", "num_duplicates": 2},
        {"pos": 2, "tid": "\ta", "node_to_align": " x", "num_duplicates": None},
        {"pos": 3, "tid": "", "node_to_align": "  "},
        {"pos": 4},
    ])
    got = {(r["field"], r["heavy_key"]): (r["n_records"], r["sum_duplicates"]) for r in K.per_key(df)[0].collect()}
    assert got == {("tid", "a"): (2, 2), ("node_to_align", "x"): (2, 2), ("node_to_align", "y"): (1, 2)}
    assert rows(K.found(df, 0.5)) == [("node_to_align", "x"), ("tid", "a")]
    empty = seqs(spark, [])
    assert K.per_key(empty)[0].count() == 0 and K.found(empty).count() == 0


def test_split_line():
    assert split_line('a,"b,""c""\n",d') == ["a", 'b,"c"\n', "d"]
    assert split_line("") == [""] and split_line(",") == ["", ""] and split_line('""') == [""]
    for bad in ('a,"b', '"a"b,c', 'a"b', '"a" ,b'):
        assert split_line(bad) is None


def test_raw_lines(spark):
    good = 'n1,"c, ""x""\nz",ACGT,IIII,13,2\r'
    lines = [good, "n2,,acgt-,,,x", "", "a,b", ">n,,A,,,1", ",,A,,,1", "n m,,A,,,1", "n,,AXA,,,1", "n,,,,,1", "n,,ACG,II,,1", "n,,AC,I\x7f,,1", 'n,"c,ACG,,,1', 'n,c"d,ACG,,,1', "n,,A,,,1,extra", "," * 3000, None, "n,c\nd,A,,,1", "   "]
    df = spark.createDataFrame([(i, "b", t) for i, t in enumerate(lines)], "line_id long, batch string, line string")
    want = {2: "columns", 3: "columns", 4: "name", 5: "name", 6: "name", 7: "sequence", 8: "sequence", 9: "quality", 10: "quality", 11: "quoting", 12: "quoting", 13: "columns", 14: "columns", 15: "columns", 17: "columns"}
    assert {r["line_id"]: r["reason"] for r in found(df).collect()} == want
    back = {r["line_id"]: r for r in loaded(df).collect()}
    assert set(back) == {0, 1, 16}
    assert back[0]["comment"] == 'c, "x"\nz' and back[0]["num_duplicates"] == 2 and back[1]["num_duplicates"] is None and back[16]["comment"] == "c\nd"
    long = spark.createDataFrame([(1, "b", 'n,"' + '""' * 50_000 + '",' + "A" * 300_000 + ",,,1")], "line_id long, batch string, line string")
    assert found(long).count() == 0
    assert classify(df.limit(0)).count() == 0
    assert classify(df.withColumn("reason", F.lit("old"))).where("reason = 'old'").count() == 0


def test_names_and_runs(spark):
    df = seqs(spark, [{"pos": 1, "name": "x", "sequence": "AAC\nG"}, {"pos": 2, "name": "x", "sequence": ""}, {"pos": 3, "name": "y"}, {"pos": 4}])
    assert [r["name"] for r in R.number_names(df).orderBy("pos").collect()] == ["x", "x.1", "y", None]
    assert [r["name"] for r in R.number_names(df, "/", True).orderBy("pos").collect()] == ["x/1", "x/2", "y", None]
    assert rows(R.homopolymers(df)) == [(1, "A", 0, 2)]
    assert {r["base"]: r["n"] for r in R.base_frequencies(df).collect()} == {"A": 2, "C": 1, "G": 1, "T": 0}
    assert R.base_frequencies(df.limit(0)).first()["share"] is None


def test_frames_against_brute_force(spark):
    from arborweave.functions import codons

    rng = random.Random(3)
    texts = ["".join(rng.choice("ACGT") for _ in range(n)) for n in (0, 1, 2, 3, 50, 200)] + [None]
    df = seqs(spark, [{"pos": i, "sequence": t} for i, t in enumerate(texts)])
    want = set()
    for pos, t in enumerate(texts):
        for sign, s in ((1, t or ""), (-1, (t or "").translate(str.maketrans("ACGT", "TGCA"))[::-1])):
            for f in (1, 2, 3):
                p, at = codons.translate(s[f - 1 :][: (len(s) - f + 1) // 3 * 3])[0], 0
                for part in p.split("X"):
                    if len(part) >= 5:
                        a, b = f + 3 * at, f + 3 * (at + len(part)) - 1
                        want.add((pos, sign * f, a if sign > 0 else len(s) - b + 1, b if sign > 0 else len(s) - a + 1, part))
                    at += len(part) + 1
    assert set(map(tuple, R.frames(df, 5).collect())) == want


def test_order_and_pairs(spark):
    df = seqs(spark, [{"pos": i, "name": n, "sequence": s, "node_score": x} for i, (n, s, x) in enumerate([("a/2", "AA", 0.1), ("a/1", "CC", None), ("a/2", "G", 0.9), ("b/1", "T", 0.1)])])
    assert rows(R.paired(df)) == [("a/p12", 1, 2, "CC0G")]
    assert [r["pos"] for r in R.read_order(df, "score").orderBy("place").collect()] == [2, 0, 3, 1]
    assert R.read_order(df.limit(0), "length").count() == 0


def test_components_both_ways(spark):
    rng = random.Random(5)
    links = [(rng.randint(0, 200), rng.randint(0, 200)) for _ in range(120)] + [(None, 1), (7, 7)]
    parent = list(range(201))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    nodes = {x for a, b in links if a is not None and a != b for x in (a, b)}
    want = sorted((n, find(n)) for n in nodes)
    df = spark.createDataFrame(links, "a long, b long")
    assert rows(components(df)) == sorted(want, key=lambda t: tuple((True, str(x)) for x in t))
    assert sorted(map(tuple, components(df.repartition(3), one_task=0).collect())) == want
    assert components(df.limit(0)).count() == 0
    assert Counter(b for _, b in want)


def test_flags(spark):
    from arborweave.operators.skew import flags

    df = spark.createDataFrame([(0,), (5,), (32767,), (32768,), (-1,), (2**40 + 7,), (None,), (5,)], "x long")
    assert set(flags(df, "x", 1 << 17).nonzero()[0].tolist()) == {0, 5, 7, 32767, 32768, (1 << 17) - 1}
    assert not flags(df.limit(0), "x", 1 << 10).any() and set(flags(df.limit(2), "x", 1 << 10).nonzero()[0].tolist()) == {0, 5}


def test_letter_operators_on_odd_input(spark):
    from arborweave.operators import columns as C
    from arborweave.operators import hits as H
    from arborweave.operators import records as R

    pairs = spark.createDataFrame([(1, "AC-GT", "A--CT"), (2, None, "A"), (3, "", ""), (4, "É-A", "AA"), (5, "--", "--")], "branch long, parent string, child string")
    assert rows(C.branch_events(pairs)) == sorted([(1, "deletion", 2, 2, None, None), (1, "substitution", 4, 4, "G", "C"), (4, "insertion", 2, 2, None, None), (4, "substitution", 1, 1, "?", "A")], key=str)
    assert rows(C.running_sites(pairs)) == [(1, 2, 2, 1), (4, 2, 1, 2)]
    assert {r["id"]: r["identity"] for r in C.identity_vectors(pairs.withColumnsRenamed({"branch": "id", "parent": "a", "child": "b"})).collect()} == {1: "1--01", 3: "", 4: "0-", 5: "--"}
    counts = C.row_counts(spark.createDataFrame([("g", "AR-", 2), ("g", "a", 1), ("h", None, 1), (None, "A", 1), ("h", "", 1)], "group string, sequence string, w int"), weight=__import__("pyspark").sql.functions.col("w"))
    assert rows(counts) == [("g", 0, 3, 0, 0, 0, 3), ("g", 1, 2, 0, 2, 0, 2), ("g", 2, 0, 0, 0, 0, 0)]
    texts = spark.createDataFrame([(1, "ACGTACGT"), (2, "ACG"), (3, None), (4, "TTTTTT")], "id long, text string")
    other = spark.createDataFrame([(9, "CCACGTAC"), (8, ""), (7, "TTTT")], "id long, text string")
    assert rows(H.shared_parts(texts, other, 4)) == [(1, 4, 3, 3), (4, 1, 1, 1)]
    assert rows(H.shared_kmers(texts, other, 4)) == [(1, 9, 3), (4, 7, 1)]
    long = seqs(spark, [{"pos": 1, "sequence": "ATG" * 30_000}, {"pos": 2, "sequence": ""}, {"pos": 3}])
    found = R.frames(long, 1000).collect()
    assert {r["pos"] for r in found} == {1} and all(len(r["translation"]) >= 29_999 for r in found)
    for f in (C.branch_events, C.running_sites):
        assert f(pairs.limit(0)).count() == 0
