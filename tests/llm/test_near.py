from inspect import signature
from math import comb

import numpy as np
import pytest
from brute import Union, near_components, removed_spans
from shared import docs  # noqa: F401

from tessera.llm import graph, near_dedup, substring, vector_dedup

SF = "/root/testdata/sf0.001"


def _texts(seed=0, groups=12, spread=6):
    """Base texts with edits around the threshold, exact copies and noise."""
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{k}" for k in range(4000)]
    rows, i = [], 0
    for _ in range(groups):
        base = rng.choice(vocabulary, int(rng.integers(60, 200))).tolist()
        for e in range(spread):
            copy = list(base)
            for at in rng.choice(len(copy), e, replace=False):
                copy[at] = f"e{rng.integers(1000)}"
            rows.append((i, " ".join(copy)))
            i += 1
    for _ in range(30):
        rows.append((i, " ".join(rng.choice(vocabulary, int(rng.integers(1, 40))))))
        i += 1
    return rows


EDGE = [(900, None), (901, ""), (902, " \n\t"), (903, "one two"), (904, "ONE\ttwo"), (905, "one  two three"),
        (906, "y " * 30_000), (907, "y " * 30_001), (908, "z"), (909, "É z"), (910, "é z")]


@pytest.mark.parametrize("leaf,depth", [(1024, 4), (3, 2)])
def test_near_duplicates_match_all_pairs(docs, leaf, depth):
    rows = _texts() + EDGE + [(903, "one two")]
    comps, sizes = near_components(dict(rows))
    got = near_dedup.near_duplicates(docs(rows), leaf=leaf, depth=depth).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == \
            (sizes[r.doc_id], comps[r.doc_id], comps[r.doc_id] == r.doc_id), r


def test_trees_miss_a_pair_at_the_threshold_less_than_once_in_a_million():
    """All trees read the same tokens: the miss is a mean over how many of
    them agree, not a power of one tree's miss."""
    size, default = near_dedup.COORDINATES, signature(near_dedup.near_duplicates).parameters
    trees, branches, depth = (default[k].default for k in ("trees", "branches", "depth"))
    missed = 0.0
    for k in range(size + 1):
        one = 0.0
        for _ in range(depth):  # a node misses if its agreeing children do
            one = sum(comb(k, j) * comb(size - k, branches - j) / comb(size, branches) * one ** j
                      for j in range(branches + 1))
        missed += comb(size, k) * 0.75 ** k * 0.25 ** (size - k) * one ** trees
    assert missed < 1e-6


def test_large_group_of_near_copies_gives_few_links(docs):
    """Hundreds of mutual near copies: one component, and candidates stay
    about as many as members."""
    rng = np.random.default_rng(4)
    base = [f"b{k}" for k in range(120)]
    rows = []
    for i in range(400):
        copy = list(base)
        copy[int(rng.integers(120))] = f"x{i}"
        rows.append((i, " ".join(copy)))
    rows += [(1000 + i, t) for i, t in _texts(seed=5, groups=3)]
    comps, _ = near_components(dict(rows))
    got = near_dedup.near_duplicates(docs(rows), leaf=64).collect()
    assert {r.doc_id: r.component_id for r in got} == comps


def test_near_duplicates_null_ids_and_empty(docs):
    a = "a b c d e f g h i j k"
    got = near_dedup.near_duplicates(docs([(None, a), (5, a), (None, "x y z"), (8, "q")])).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in got) == \
        [("5", "5", True), ("8", "8", True), ("None", "5", False), ("None", "None", True)]
    assert near_dedup.near_duplicates(docs([])).collect() == []
    assert near_dedup.near_duplicates(docs([(1, None)])).collect()[0].kept


def test_keep_representatives(docs):
    df = docs(_texts())
    comps, _ = near_components({r.doc_id: r.text for r in df.collect()})
    out = near_dedup.keep_representatives(df)
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted(set(comps.values()))


def test_near_duplicates_on_driver_table(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    comps, sizes = near_components({r.doc_id: r.text for r in df.collect()})
    got = near_dedup.near_duplicates(df).collect()
    assert {r.doc_id: (r.component_id, r.n_shingles) for r in got} == {i: (comps[i], sizes[i]) for i in comps}


@pytest.mark.parametrize("kind", ["path", "random", "star"])
def test_connected_components(spark, monkeypatch, kind):
    monkeypatch.setattr(graph, "BLOCK", 100)
    rng = np.random.default_rng(1)
    links = {"path": [(i, i + 1) for i in range(500) if i != 250], "star": [(0, i) for i in range(1, 400)],
             "random": [tuple(map(int, rng.integers(0, 900, 2))) for _ in range(500)]}[kind]
    u = Union({x for link in links for x in link})
    for a, b in links:
        u.join(a, b)
    got = graph.connected_components(spark.createDataFrame(links, "a long, b long")).collect()
    want = {x: u.root(x) for x in u.up}
    loners = {x for x in want if all(a == b for a, b in links if x in (a, b))}  # only linked with themselves
    assert {r.vertex: r.comp for r in got} == {x: c for x, c in want.items() if x not in loners}


# --- substring dedup

def _passages():
    rng = np.random.default_rng(2)
    vocabulary = [f"v{k}" for k in range(300)]

    def some(n):
        return rng.choice(vocabulary, n).tolist()
    shared, other = some(60), some(35)
    rows = [(i, " ".join(some(int(rng.integers(0, 50))) + shared[int(rng.integers(0, 20)):] + some(20)))
            for i in range(8)]
    rows += [(20, " ".join(other)), (21, " ".join(other)), (22, " ".join(some(10) + other + other)),
             (23, " ".join(["r"] * 40)), (24, " ".join(["q"] * 35)), (25, " ".join(["s"] * 34)),
             (26, "\n".join(some(80))), (30, None), (31, ""), (20, " ".join(other)),
             (None, " ".join(shared)), (None, "short"), (40, " ".join(some(30_000)))]
    return rows


@pytest.mark.parametrize("chunk_words", [50, 1 << 20])
def test_substring_matches_all_windows(docs, chunk_words):
    rows = _passages()
    got = substring.remove_repeats(docs(rows), chunk_words=chunk_words).collect()
    key = lambda r: (str(r[0]), *r[1:])
    assert sorted(map(tuple, got), key=key) == sorted(removed_spans(rows), key=key)


def test_substring_shuffled_join_gives_the_same(docs, monkeypatch):
    monkeypatch.setattr(substring, "BROADCAST_BYTES", 0)
    rows = _passages()
    got = substring.remove_repeats(docs(rows).repartition(3)).collect()
    key = lambda r: (str(r[0]), *r[1:])
    assert sorted(map(tuple, got), key=key) == sorted(removed_spans(rows), key=key)
    assert substring.remove_repeats(docs([])).collect() == []


def test_intervals_are_maximal():
    assert substring.intervals(np.array([3, 4, 10, 45, 90]), 35).tolist() == [[3, 80], [90, 125]]


# --- vectors

def _vectors(seed=0):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(12, 16))
    rows = []
    for i in range(300):
        x = base[i % 12] + rng.normal(size=16) * (0.12 * (i % 5))
        rows.append((i, (x * (1 + i % 3)).astype(np.float32).tolist()))
    rows += [(300 + k, rows[5][1]) for k in range(6)] + [(5, rows[5][1])]
    rows += [(400, None), (401, [0.0] * 16), (402, [1.0] * 15 + [None]), (403, [float("nan")] + [1.0] * 15),
             (404, [float("inf")] + [0.0] * 15), (405, [1.0] * 3), (406, []), (407, [1e-38] * 16)]
    return rows


def _brute_vectors(rows, least=0.9):
    fine = [(k, np.array(v, float)) for k, (_, v) in enumerate(rows)
            if v is not None and len(v) == 16 and None not in v and np.isfinite(v).all() and np.any(v)]
    x = np.array([v / np.linalg.norm(v) for _, v in fine])
    close = x @ x.T >= least
    u, n = Union(range(len(rows))), [0] * len(rows)
    for a, b in zip(*np.nonzero(close)):
        if a != b:
            n[fine[a][0]] += 1
            u.join(fine[a][0], fine[b][0])
    first = {}
    for k, (i, _) in enumerate(rows):
        first[u.root(k)] = min(first.get(u.root(k), i), i)
    return sorted((i, n[k], first[u.root(k)], first[u.root(k)] == i) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize("block", [8192, 40])
def test_vectors_match_all_pairs(spark, block):
    rows = _vectors()
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows],
                               "vec_id long, embedding array<float>, label int, weight int")
    got = vector_dedup.near_duplicate_vectors(df, block=block).collect()
    assert sorted(map(tuple, got)) == _brute_vectors(rows)


def test_vectors_empty_and_alone(spark):
    schema = "vec_id long, embedding array<float>"
    assert vector_dedup.near_duplicate_vectors(spark.createDataFrame([], schema)).collect() == []
    one = vector_dedup.near_duplicate_vectors(spark.createDataFrame([(3, [1.0, 2.0])], schema)).collect()
    assert [tuple(r) for r in one] == [(3, 0, 3, True)]
    null = vector_dedup.near_duplicate_vectors(spark.createDataFrame([(3, None), (None, None)], schema)).collect()
    assert sorted(map(str, (tuple(r) for r in null))) == ["(3, 0, 3, True)", "(None, 0, None, True)"]


def test_tile_stops_only_hopeless_pairs():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(200, 32)) * np.linspace(2, 0.3, 32)
    x[100:] = x[:100] + rng.normal(size=(100, 32)) * 0.2
    x /= np.linalg.norm(x, axis=1)[:, None]
    cuts = [8, 16, 32]
    rest = vector_dedup._rest(x, cuts)
    i, j = vector_dedup.tile_links(x, x, rest, rest, cuts, 0.9)
    assert set(zip(i.tolist(), j.tolist())) == set(zip(*(k.tolist() for k in np.nonzero(x @ x.T >= 0.9))))


@pytest.mark.parametrize("percent", [50, 60, 75, 90])
def test_links_at_other_thresholds(docs, percent):
    """Pairs at and just above the threshold, and some below it."""
    rng = np.random.default_rng(percent)
    rows, want = [], {}
    for p in range(80):
        words = [f"p{p}w{k}" for k in range(204)]
        # replacing the last r words of 204 leaves 200 - r of 200 + r shingles in common
        r = next(r for r in range(200) if 100 * (200 - r - 1) < percent * (200 + r + 1))
        r += int(rng.integers(0, 3)) if p % 4 == 3 else -int(rng.integers(0, 3))
        r = max(r, 0)
        other = words[:204 - r] + [f"q{p}w{k}" for k in range(r)]
        rows += [(2 * p, " ".join(words)), (2 * p + 1, " ".join(other))]
        want[2 * p + 1] = 2 * p if 100 * (200 - r) >= percent * (200 + r) else 2 * p + 1
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs(rows), percent=percent).collect()}
    assert {i: got[i] for i in want} == want
    assert sum(i != c for i, c in want.items()) > 40


def test_thresholds_follow_from_the_similarity():
    assert near_dedup.agreeing(75) == 70 and near_dedup.forest_size(75, 4, 3, 4) == (4, 3)
    for percent in (30, 50, 90, 100):
        trees, branches = near_dedup.forest_size(percent, 4, 3, 4)
        assert near_dedup.missed(percent, trees, branches, 4) <= near_dedup.MISSED and branches * percent > 100
    for percent in (0, 19, 101):
        with pytest.raises(ValueError):
            near_dedup.forest_size(percent, 4, 3, 4)


def test_many_rows_without_an_id_stay_linear(docs, spark, monkeypatch):
    """Texts meet the wanted vertices by id and text, not by a shared key."""
    rows = [(None, f"a{k % 700} b c d e f g h i j k l m n o p q r s t u v w x y z {k % 700}") for k in range(2000)]
    rows += [(None, f"a{k} b c d e f g h i j k l m n o p q r s t u v w x y z {k} z") for k in range(700)]
    met = []
    plain = near_dedup._sets
    counted = spark.sparkContext.accumulator(0)

    def sets(width):
        def run(batches):
            def seen():
                for b in batches:
                    counted.add(b.num_rows)
                    yield b
            return plain(width)(seen())
        met.append(width)
        return run
    monkeypatch.setattr(near_dedup, "_sets", sets)
    got = near_dedup.near_duplicates(docs(rows)).collect()
    assert len(got) == 2700 and met and counted.value < 4 * 2700


def test_representatives_are_rows(docs):
    a = "one two three four five six seven eight nine ten eleven twelve"
    near = a + " thirteen"
    rows = [(None, a), (None, near), (None, "left alone here"), (4, "x y z u v w q"), (4, "another text under four of its own"),
            (1, "x y z u v w q"), (9, "same row twice or more"), (9, "same row twice or more"), (None, ""), (7, None)]
    out = sorted(((r.doc_id, r.text) for r in near_dedup.keep_representatives(docs(rows)).collect()), key=str)
    texts = [t for _, t in out]
    assert (4, "x y z u v w q") not in out and (1, "x y z u v w q") in out
    assert (4, "another text under four of its own") in out
    assert out.count((9, "same row twice or more")) == 1
    assert len([t for t in texts if t in (a, near)]) == 1
    assert (None, "left alone here") in out and (None, "") in out and (7, None) in out and len(out) == 7


def test_tiny_and_huge_vectors_link(spark):
    rows = [(1, [1e-200, 0.0]), (2, [2e-200, 0.0]), (3, [1e200, 1e199]), (4, [0.0, 5e-324]), (5, [0.0, 1.0]), (6, [1.0, -1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vector_dedup.near_duplicate_vectors(df).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (1, 4), 5: (1, 4), 6: (0, 6)}


def test_every_length_is_compared(spark):
    rows = [(i, [1.0, float(i)]) for i in range(20)] + [(100, [1.0, 0.0, 0.0]), (101, [1.0, 0.0, 0.1]), (102, [0.0, 1.0, 0.0]),
                                                        (200, [3.0]), (201, [2.0]), (202, [-1.0]), (300, [1.0] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vector_dedup.near_duplicate_vectors(df).collect() if r.vec_id >= 100}
    assert got == {100: (1, 100), 101: (1, 100), 102: (0, 102), 200: (1, 200), 201: (1, 200), 202: (0, 202), 300: (0, 300)}


def test_cosines_at_the_threshold_link(spark):
    """Integer vectors whose cosine is 9/10 to the last bit."""
    import itertools
    own = [v for v in itertools.product(range(-3, 4), repeat=4) if sum(x * x for x in v) == 10]
    pairs = [(i, j) for i in range(len(own)) for j in range(i) if sum(a * b for a, b in zip(own[i], own[j])) >= 9]
    n = [0] * len(own)
    for i, j in pairs:
        n[i] += 1
        n[j] += 1
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(own)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r.n_links for r in vector_dedup.near_duplicate_vectors(df).collect()}
    assert pairs and got == dict(enumerate(n))
