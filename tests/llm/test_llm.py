import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from arborweave.llm import format_copies, leaks, near_copies, packing, residue, shared_spans, topn

from ..conftest import rows
from ..test_records import seqs

TOKENIZER = packing.TOKENIZER


def dna(rng, n):
    return "".join(rng.choice("ACGT") for _ in range(n))


# shared spans


def brute_spans(records, span):
    where = defaultdict(set)
    for pos, s in records:
        for i in range(len(s or "") - span + 1):
            where[s.upper()[i : i + span]].add(pos)
    out = set()
    for pos, s in records:
        if s is None or pos is None:
            continue
        marked = np.zeros(len(s) + 1, bool)
        for i in range(len(s) - span + 1):
            if len(where[s.upper()[i : i + span]] - {None}) > 1:
                marked[i : i + span] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], marked.view(np.int8)])))
        out |= {(pos, int(a), int(b)) for a, b in edges.reshape(-1, 2)}
    return out


@pytest.mark.parametrize("limits", [{}, {"least_heavy": 1, "group": 1}, {"group": 3}])
def test_shared_spans(spark, limits):
    rng = random.Random(1)
    common, other = dna(rng, 70), dna(rng, 40)
    data = [(i, dna(rng, rng.randint(0, 60)) + rng.choice([common, common[:45].lower(), other, ""]) + dna(rng, rng.randint(0, 60))) for i in range(40)]
    data += [(100 + i, data[3][1]) for i in range(5)] + [(200, "A" * 300), (201, "A" * 90), (202, ("ACGT" * 30)), (203, None), (204, ""), (205, common * 2), (205, common * 2), (None, common)]
    df = spark.createDataFrame(data, "pos long, sequence string")
    assert set(map(tuple, shared_spans.shared_spans(df, 32, **limits).collect())) == brute_spans([d for d in data if d[0] is not None], 32)


def test_shared_spans_odd_input(spark):
    s = dna(random.Random(2), 80)
    df = spark.createDataFrame([(1, s[:40] + "é" + s[40:]), (2, s[:40] + "ü" + s[40:]), (3, s[:40] + "é" + s[40:])], "pos long, sequence string")
    assert rows(shared_spans.shared_spans(df, 32)) == sorted([(p, a, b) for p in (1, 2, 3) for a, b in ((0, 40), (41, 81))], key=str)
    assert shared_spans.found(df.limit(0)).count() == 0
    assert {r["pos"]: r["share"] for r in shared_spans.shared_part(df).collect()} == {1: 0.0, 2: 0.0, 3: 0.0}


# best items


@pytest.mark.parametrize("least", [1, 1000])
def test_top_per_group(spark, least):
    rng = random.Random(3)
    data = [(rng.choice(["hot", "hot", "a", "b", None]), rng.choice([f"n{i}" for i in range(30)] + [None]), rng.choice([None, 1, 2, 3, 9]), "x") for _ in range(800)]
    df = spark.createDataFrame(data, "query string, node string, score int, rank string")
    best = {}
    for q, n, s, _ in data:
        if None not in (q, n, s):
            best[q, n] = max(best.get((q, n), -1), s)
    want = set()
    for q in ("hot", "a", "b"):
        for r, (n, s) in enumerate(sorted(((n, s) for (p, n), s in best.items() if p == q), key=lambda x: (-x[1], x[0]))[:3], 1):
            want.add((q, n, s, r))
    assert set(map(tuple, topn.top_per_group(df, "query", "node", "score", 3, least).collect())) == want
    assert topn.found(df.limit(0)).count() == 0


# copies in other dress


def test_format_copies(spark):
    df = seqs(spark, [
        {"pos": 5, "sequence": "ac gt-1", "comment": "A=1, b=2", "num_duplicates": 0},
        {"pos": 3, "sequence": "ACGT", "comment": "B=2;a=1 NumDuplicates=4 ", "num_duplicates": 4},
        {"pos": 3, "sequence": "ACGT", "comment": "B=2;a=1 NumDuplicates=4 ", "num_duplicates": 4},
        {"pos": 4, "sequence": "ACGT", "comment": None},
        {"pos": 6, "sequence": "AGCT", "comment": ""},
        {"pos": 7, "sequence": None, "comment": None},
        {"pos": 8, "sequence": "", "comment": " , "},
        {"pos": None, "sequence": "ACGT"},
    ])
    assert rows(format_copies.found(df)) == [(3, 5), (7, 8)]
    assert rows(format_copies.collapsed(df)) == sorted([(3, 2, 5), (4, 1, 1), (6, 1, 1), (7, 2, 2)], key=str)
    assert format_copies.found(df.limit(0)).count() == 0 and format_copies.collapsed(df.limit(0)).count() == 0


# similar records


def brute_pairs(data, t):
    first = {}
    for p, s in data:
        if p is not None and s is not None:
            first.setdefault(p, re.sub("[^A-Za-z]", "", s).upper())
    sets = {p: {s[i : i + 12] for i in range(len(s) - 11)} for p, s in first.items() if s}
    out = set()
    for a in sets:
        for b in sets:
            if a < b and (first[a] == first[b] or (sets[a] | sets[b] and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-9)):
                out.add((a, b))
    return out


def mutated(rng, s):
    for _ in range(rng.randint(0, 4)):
        i = rng.randrange(len(s))
        s = rng.choice([s[:i] + rng.choice("ACGT") + s[i + 1 :], s[:i] + s[i + rng.randint(1, 8) :], s[:i] + dna(rng, 5) + s[i:], s[i:] + s[:i]])
        s = s or "A"
    return s


def test_similar_records(spark):
    rng = random.Random(6)
    data = []
    for k in range(30):
        base = dna(rng, rng.choice([12, 20, 40, 60, 61, 70, 120, 200, 400]))
        data += [(100 * k + i, mutated(rng, base)) for i in range(rng.randint(1, 8))]
    data += [(9001, "ACG"), (9002, "acg"), (9003, ""), (9004, None), (9005, "A" * 300), (9006, "A" * 5000), (9007, "..."), (None, data[0][1]), (0, data[0][1])]
    df = seqs(spark, [{"pos": p, "sequence": s} for p, s in data])
    want = brute_pairs(data, 0.6)
    assert set(map(tuple, near_copies.found(df).collect())) == want
    members, reps = near_copies.classes(df)
    small = {tuple(r)[:2] for r in near_copies.similar_texts(reps, 0.6).collect()}
    assert {tuple(r)[:2] for r in near_copies.similar_texts(reps, 0.6, group=3).collect()} == small
    links = Counter(x for p in want for x in p)
    got = {r["pos"]: (r["group_pos"], r["n_links"]) for r in near_copies.groups(df).collect()}
    assert all(got[p][1] == links[p] for p in got)
    assert all(got[a][0] == got[b][0] for a, b in want)
    assert near_copies.found(df.limit(0)).count() == 0
    assert members.count() == len({p for p, s in data if p is not None and re.search("[A-Za-z]", s or "")})


def test_large_group_is_tiled():
    rng = random.Random(8)
    base = dna(rng, 150)
    texts = [mutated(rng, base) for _ in range(300)]
    i, j, _ = near_copies.similar_rows(pa.array(texts), np.zeros(300, np.int64), 0.6)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == brute_pairs(list(enumerate(texts)), 0.6)
    # groups of all sizes share tiles; sizes differ so that tile pairs are skipped
    sizes = sorted(rng.randint(0, 4) for _ in range(300))
    group = np.array(sizes)
    long = [t * (1 + k % 3) for k, t in enumerate(texts)]
    i, j, share = near_copies.similar_rows(pa.array(long), group, 0.6, tile=16)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == {(a, b) for a, b in brute_pairs(list(enumerate(long)), 0.6) if group[a] == group[b]}
    assert ((share >= 0.6) & (share <= 1)).all()


# packing


def test_patterns_use_all():
    rng = np.random.default_rng(2)
    for lengths in (rng.integers(1, 2049, 3000), rng.integers(1, 300, 5000), np.full(10, 2048), np.array([1]), rng.exponential(350, 20000).clip(1, 2048).astype(int)):
        h = np.bincount(lengths, minlength=2049)
        got, used = packing.patterns(h, 2048), np.zeros(2049, np.int64)
        containers = 0
        for inside, many in got:
            assert sum(x * n for x, n in inside.items()) <= 2048 and many > 0
            containers += many
            for x, n in inside.items():
                used[x] += n * many
        assert (used == h).all()
        assert containers <= -(-int(lengths.sum()) // 2048) * 1.12 + 2 and len(got) < 10_000


def test_nnls_is_optimal():
    rng = np.random.default_rng(1)
    for _ in range(20):
        a, b = rng.random((6, 9)), rng.random(6) * 5
        x = packing.nnls(a, b)
        g = a.T @ (a @ x - b)
        assert (x >= 0).all() and (g > -1e-6).all() and abs(x @ g) < 1e-6


def test_pack(spark):
    rng = random.Random(4)
    sizes = [(i, rng.choice([0, 1, 50, 300, 1500, 2048, 2049, 5000])) for i in range(500)] + [(7, 100)]
    got = packing.pack(spark.createDataFrame(sizes, "doc_id long, n_tokens long")).collect()
    held, per = Counter(), Counter()
    for r in got:
        held[r["container"]] += r["n_tokens"]
        per[r["doc_id"]] += r["n_tokens"]
    want = Counter()
    for i, n in sizes:
        want[i] += n
    assert all(n <= 2048 for c, n in held.items()) and held.get(0, 0) == 0 and {k: v for k, v in per.items() if v} == {k: v for k, v in want.items() if v}
    parts = Counter(r["doc_id"] for r in got)
    assert all(parts[i] == max(1, -(-n // 2048)) for i, n in sizes if i != 7)
    assert packing.pack(spark.createDataFrame([], "doc_id long, n_tokens long")).count() == 0


@pytest.mark.skipif(not Path(TOKENIZER).exists(), reason="no vocabulary file")
def test_token_counts(spark):
    text = "Placement of reads.\n" * 300_000
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, ""), (4, text), (None, "x"), (5, "<|endoftext|>")], "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in packing.token_counts(df).collect()}
    whole = len(packing.encoder(TOKENIZER).encode_ordinary(text))
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] == whole and got[5] > 1 and set(got) == {1, 2, 3, 4, 5}
    assert rows(packing.found(df)) == [(4,)]


@pytest.mark.skipif(not Path(TOKENIZER).exists(), reason="no vocabulary file")
def test_pieces_have_the_tokens_of_the_whole():
    rng = random.Random(12)
    enc = packing.encoder(TOKENIZER)
    for _ in range(300):
        text = "".join(rng.choice([" ", "  ", "\n", "\t ", "ab", "Zeit", "7", "42", "'s", "'", "'ll", "!?", "é", "中", "\x1c", "\u00a0", "½", "-"]) for _ in range(rng.randint(0, 120)))
        for size in (1, 3, 20):
            parts = list(packing.pieces(text, size))
            assert "".join(parts) == text
            assert [t for p in parts for t in enc.encode_ordinary(p)] == enc.encode_ordinary(text)


# leaks


def test_leaks(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(5, 40)))) for i in range(20)] + [(50, "a a a a a a a a a a a a a a"), (51, None), (52, "")]
    docs = []
    for d in range(80):
        w = items[rng.randrange(20)][1].split()
        a = rng.randrange(len(w))
        docs.append((d, " ".join(rng.choice(words) for _ in range(30)) + " - " + "...\n".join(w[a : a + rng.randint(3, 30)]).upper() + " " + rng.choice(words)))
    docs += [(900, None), (901, ""), (902, "a " * 3000), (903, "Ümlaut"), (None, items[0][1])]
    dd, ii = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")

    def shingles(t):
        w = re.findall(r"[^\W_]+", (t or "").lower())
        return {tuple(w[i : i + 12]) for i in range(len(w) - 11)}

    want = {(d, i) for d, t in docs if d is not None for i, u in items if shingles(t) & shingles(u)}
    every = {}
    for most in (leaks.MOST_SEEDS, 0):
        leaked = leaks.leaked(dd, ii, most_seeds=most).collect()
        assert {(r["doc_id"], r["item_id"]) for r in leaked if r["kind"] == "run"} == want
        every[most] = {tuple(r) for r in leaked}
    assert every[0] == every[leaks.MOST_SEEDS]
    assert leaks.found(dd.limit(0), ii).count() == 0 and leaks.found(dd, ii.limit(0)).count() == 0
    parts = items[0][1].split()
    moved = spark.createDataFrame([(1, " ".join(parts[8:] + ["x"] + parts[:8]))], "doc_id long, text string")
    assert leaks.leaked(moved, ii.where("item_id = 0")).count() == 1


def test_leaks_of_commonplaces(spark):
    # a commonplace in every text and item; moved and whole passages among them
    rng = random.Random(17)
    common = "we thank all of our readers for their patience"
    items = [(i, f"{common} " + " ".join(f"i{i}w{k}" for k in range(rng.randint(4, 30)))) for i in range(12)] + [(40, common), (41, f"{common} {common}")]
    docs = []
    for d in range(60):
        w = items[d % 12][1].split()
        a, b = sorted(rng.sample(range(len(w) + 1), 2))
        docs.append((d, " ".join(rng.choice([w[a:b], w[a:] + ["x"] + w[:a], w[a:b] + w[:a]])) + f" {common} d{d}"))
    dd, ii = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    small, large = ({tuple(r) for r in leaks.leaked(dd, ii, most_seeds=m).collect()} for m in (leaks.MOST_SEEDS, 0))
    assert small == large and {r[-1] for r in small} == {"run", "reordered"}


def test_needed_seeds():
    # whatever a text shares of an item, it shares a needed seed if it has a run of 12 or 80 percent
    rng = random.Random(19)
    for _ in range(200):
        n = rng.randint(5, 40)
        at = np.arange(n - leaks.SEED + 1)
        held = leaks.needed(n, at, np.array([rng.randint(1, 9) for _ in at]), 12, 0.8)
        shared = np.array([rng.random() < 0.8 for _ in at])
        covered, run = np.zeros(n, bool), 0
        for p in at[shared & ~held]:
            covered[p : p + leaks.SEED] = True
        for p in range(len(at)):
            run = run + 1 if (shared & ~held)[p] else 0
            assert run + leaks.SEED - 1 < 12
        assert covered.sum() < 0.8 * n


def test_tiles_are_greedy():
    t = leaks.tiled_frame("a b c d e f g x h i j k l m", "h i j k l m q a b c d e f g")
    assert list(t["words"]) == [7, 6]


# residue

TALK = [
    "The report writer replaces {{taxon}} by the name of the leaf, and a missing name stops the run.",
    "The code holds a vector<Node*> and a map<string,int> of length 9.",
    'printf("%s %d\\n", name, len) prints the name.',
    "An array such as x[NODE] or a set like {A, C, G, T} is allowed in the model file.",
    "Our filter removes pages that only say page not found, which left 40 notes.",
    "One reviewer disliked the lorem ipsum in our draft poster, so we wrote a real caption.",
    "The mail server gave an internal server error on Monday; we sent the files by disk instead.",
    "The tree viewer is written in JavaScript, but it also prints a plain picture without scripts.",
    "A leaf is written as <leaf id=\"28\"> in the XML output.",
    "In the shell script the folder is given as ${OUT}, for instance OUT=run24, before the gene is read.",
    "Of 404 sequences, 935 went to the second best hit.",
]
BAD = [
    "Dear {{ name }}, your job has finished.", "Cite as %(doi)s (99).", "Results for node: ________ follow.", "Reads for &lt;locus&gt; are listed.", "Title: [TODO: run date] more",
    "We found (taxon to be filled in) here.", "Lorem ipsum velit veniam fugiat officia culpa amet aliqua magna.", "Sample text goes here. Your content here.", "asdf asdf asdf",
    "404 Not Found", "Home | About\nPage not found\nReference code 12-3.", "Please enable JavaScript to view the tree.", "503 Service Unavailable - Please try again in 24 minutes.",
    "Help | Jobs\nWe have noticed that scripts are blocked in your browser.\nLoading...", "Veuillez activer JavaScript pour afficher l'alignement.", "Prepared by [object Object] for the panel.",
]


def test_residue(spark):
    filler = "The placement of the reads took nine minutes on the old server and nothing else was changed. "
    docs = [(i, filler * 2 + t) for i, t in enumerate(TALK)] + [(100 + i, t) for i, t in enumerate(BAD)] + [(500, ""), (501, None), (502, "   "), (503, filler * 2000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r["doc_id"] for r in residue.found(df).collect()} == set(range(100, 100 + len(BAD)))
    assert residue.clean(df).count() == len(docs) - len(BAD)
    assert residue.found(df.limit(0)).count() == 0


def test_residue_by_alignment(spark):
    # fixed wording in many surroundings is no slot; the same frame with several values is one
    fixed = [(i, f"Note {chr(97 + i)} is here. Our manual puts @@site@@ after each column of runs.") for i in range(10)]
    slots = [(100 + i, f"Note {chr(97 + i)} is here. Our manual puts {v} after every row of runs.") for i, v in enumerate(["@@site@@", "{{site}}", "[[site]]", "7"])]
    df = spark.createDataFrame(fixed + slots, "doc_id long, text string")
    assert {r["doc_id"] for r in residue.found(df).collect()} == {100, 101, 102}


def test_residue_of_unlisted_syntaxes(spark):
    # blanks, defaults and names in any syntax are slots where other records fill the frame, and only there
    values = ["Anna", "Boris", "Carla Weiss", "", "undefined", "#NAME#", "N/A", "first_name"]
    docs = [(i, f"Dear {v}, your job run{i} has finished and was stored.") for i, v in enumerate(values)]
    docs += [(50, "Dear  your job run9 has finished and was stored."), (51, "The pointer was null, and the flag #NAME# is undefined in C."), (52, "Deux cibles ont 5 points ; le nom est N/A.")]
    docs += [(100 + i, f"Whoops, we lost this view. Ticket {i} was filed with our crew.") for i in range(4)]
    docs += [(200, "Whoops, we lost this view of the cabin. The crew read it again.")] + [(300 + i, "Equal copies that name an error once.") for i in range(5)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r["doc_id"] for r in residue.found(df).collect()} == {3, 4, 5, 6, 7, 50, 100, 101, 102, 103}


def test_residue_of_a_constant_name(spark):
    # the same name in many different documents stays a slot, filled elsewhere or not; wording that talks about it does not
    openings = ["Notes of the week.", "Minutes of the panel.", "Report from the pier.", "Letter to the cabin."]
    docs = [(i, f"{x} Dear {{{{name}}}}, your job has finished.") for i, x in enumerate(openings)]
    docs += [(10 + i, f"{x} The tool prints {{{{name}}}} for each leaf.") for i, x in enumerate(openings)]
    docs += [(20 + i, f"{x} Our form prints {{{{site}}}} beside the date.") for i, x in enumerate(openings)] + [(30, "Our form prints north pier beside the date.")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r["doc_id"] for r in residue.found(df).collect()} == {0, 1, 2, 3, 20, 21, 22, 23}


def test_residue_under_long_navigation(spark):
    # navigation is learnt from recurrence, whatever its share and form; sentences are compared to their ends
    links = "\n".join(f"{a} of the {b}" for a in ("Maps", "Lists", "Names", "Tables", "Trees") for b in ("coast", "plain", "hills", "river"))
    docs = [(i, f"{links}\n404 Not Found\nTicket {chr(97 + i)} here") for i in range(4)]
    long = "The reads of the northern pier were taken by the crew in the early morning of a cold day and " * 3
    docs += [(10 + i, f"404 Not Found\n{long}{x}.") for i, x in enumerate(["were lost", "came back in time", "went to the lab", "are kept at the cabin"])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r["doc_id"] for r in residue.found(df).collect()} == {0, 1, 2, 3}


def test_near_copies_of_tandem_repeats(spark):
    # equal sets of pieces in very different numbers of windows
    rng = random.Random(31)
    unit, wide = dna(rng, 30), dna(rng, 70)
    data = [(1, (unit * 2)[:51]), (2, (unit * 8)[:211]), (3, (wide * 2)[:100]), (4, (wide * 12)[:800]), (5, dna(rng, 300))]
    df = spark.createDataFrame([(p, s, None) for p, s in data], "pos long, sequence string, loaded_at timestamp")
    assert {(1, 2), (3, 4)} == {tuple(r) for r in near_copies.found(df).select("pos_1", "pos_2").collect()}


@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.9])
def test_near_copies_of_repeats(spark, threshold):
    # repeats, homopolymers and mixed lengths: whatever the size of the component, no pair is lost
    rng = random.Random(32)
    data = [(1, "ACGTTGCAAC" * 12), (2, ("ACGTTGCAAC" * 5)[:45]), (3, "A" * 300), (4, "A" * 30), (5, "CA" * 60), (6, "CA" * 20), (7, ("ACGTTGCAAC" * 7)[:70]), (8, "A" * 12), (9, "A" * 100_000)]
    for k in range(40):
        unit = dna(rng, rng.choice([1, 2, 3, 7, 11, 13, 25, 60, 110]))
        text = (unit * 400)[: rng.choice([13, 20, 49, 61, 84, 100, 160, 400])]
        data += [(100 * k + 100 + i, mutated(rng, text)[: rng.choice([30, 90, 500])]) for i in range(rng.randint(1, 4))]
    df = seqs(spark, [{"pos": p, "sequence": s} for p, s in data])
    want = brute_pairs(data, threshold)
    assert {(1, 2), (3, 4), (5, 6), (1, 7), (2, 7), (3, 9), (4, 8)} <= want
    assert set(map(tuple, near_copies.found(df, threshold).collect())) == want
    _, reps = near_copies.classes(df)
    whole = {tuple(r)[:2] for r in near_copies.similar_texts(reps, threshold).collect()}
    assert {tuple(r)[:2] for r in near_copies.similar_texts(reps, threshold, group=3).collect()} == whole
    assert {tuple(r)[:2] for r in near_copies.similar_texts(reps, threshold, letters_=500).collect()} == whole


def test_near_copies_of_one_hot_text(spark):
    # a text stored very often is written out in block pairs
    rng = random.Random(33)
    base = dna(rng, 200)
    data = [(k, base) for k in range(700)] + [(900, base[:-3]), (901, dna(rng, 150))]
    got = near_copies.found(seqs(spark, [{"pos": p, "sequence": s} for p, s in data]))
    rows_ = got.collect()
    assert len(rows_) == len(set(rows_)) == 701 * 700 // 2 and all(a < b for a, b in rows_)
