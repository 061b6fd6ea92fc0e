import random

import numpy as np

from seogo.llm import neardup as N


def corpus(seed=5):
    r = random.Random(seed)
    words = [f"낱말{i}" for i in range(400)]
    out = []
    for g in range(60):
        base = [r.choice(words) for _ in range(r.randrange(40, 120))]
        out.append((f"{g}:0", " ".join(base)))
        for k in range(1, r.randrange(1, 5)):
            edited = list(base)
            for _ in range(r.randrange(0, 9)):
                at = r.randrange(len(edited))
                edited[at : at + r.randrange(0, 2)] = [r.choice(words)] * r.randrange(0, 3)
            out.append((f"{g}:{k}", " ".join(edited).upper() if k == 2 else "  ".join(edited)))
    return out


def brute(rows, threshold):
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        if len(w) >= 40:
            sets[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)}
    ids = sorted(sets)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


def test_pairs_equal_brute_force(spark):
    rows = corpus() + [("short", "가 나 다"), ("null", None), ("empty", ""), ("exact", "x " * 40), ("exact2", "X\n" * 40)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows + rows[:20]], "chunk_id string, text string, doc int").repartition(6)
    for threshold in (0.6, 0.8):
        got = {(r.chunk_id_a, r.chunk_id_b) for r in N.found_near_duplicates(df, threshold).collect()}
        want = brute(rows, threshold)
        assert got == want and len(want) > 20


def test_groups_are_connected_components(spark):
    rows = corpus(9)
    got = {r.chunk_id: r for r in N.near_duplicate_groups(spark.createDataFrame(rows, "chunk_id string, text string")).collect()}
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in brute(rows, 0.6):
        parent[root(a)] = root(b)
    for a, _ in rows:
        for b, _ in rows[:40]:
            assert (got[a].group_id == got[b].group_id) == (root(a) == root(b))


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (7, 7)], "u bigint, v bigint")
    assert {r.node: r.component for r in N.components(edges).collect()} == {**dict.fromkeys(range(201), 0), 500: 500, 501: 500}


def test_pivot_bound_holds():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a, b = (np.unique(rng.integers(0, 300, rng.integers(1, 120))) for _ in "ab")
        x, y = (N.class_counts(np.array([0, len(s)]), s)[0].astype(int) for s in (a, b))
        assert np.abs(x - y).sum() <= len(np.setxor1d(a, b))


def test_large_copy_classes_and_empty_tables(spark):
    base = " ".join(f"w{i}" for i in range(60))
    near = base.replace("w30", "v30")
    df = spark.createDataFrame([(f"c{i:03d}", base) for i in range(100)] + [("n", near)], "chunk_id string, text string").repartition(3)
    got = {(r.chunk_id_a, r.chunk_id_b) for r in N.found_near_duplicates(df).collect()}
    assert got == {("c000", f"c{i:03d}") for i in range(1, 100)} | {(f"c{i:03d}", "n") for i in range(100)}
    empty = spark.createDataFrame([], "chunk_id string, text string")
    assert N.found_near_duplicates(empty).count() == 0 and N.near_duplicate_groups(empty).count() == 0


def test_very_long_text_is_read_whole(spark):
    a = " ".join(f"w{i}" for i in range(50_000))
    b = " ".join(f"w{i}" if i < 33_000 else f"v{i}" for i in range(50_000))
    c = " ".join(f"w{i}" if i < 41_000 else f"v{i}" for i in range(50_000))
    df = spark.createDataFrame([("a", a), ("b", b), ("c", c)], "chunk_id string, text string")
    assert {(r.chunk_id_a, r.chunk_id_b) for r in N.found_near_duplicates(df).collect()} == brute([("a", a), ("b", b), ("c", c)], 0.6)


def test_no_pair_at_the_threshold_is_lost(spark):
    # 30 of 50 runs shared: exactly 0.6, where minimum-hash bands would lose some of so many
    rows = []
    for g in range(3000):
        base = [f"g{g}w{i}" for i in range(32)]
        rows += [(f"{g}:{k}", " ".join(base + [f"g{g}{k}{i}" for i in range(10)])) for k in "ab"]
    df = spark.createDataFrame(rows, "chunk_id string, text string").repartition(3)
    assert {(r.chunk_id_a, r.chunk_id_b) for r in N.found_near_duplicates(df).collect()} == {(f"{g}:a", f"{g}:b") for g in range(3000)}
    got = {r.chunk_id: r.group_id for r in N.near_duplicate_groups(df).collect()}
    assert all(got[f"{g}:a"] == got[f"{g}:b"] for g in range(3000)) and len(set(got.values())) == 3000


def test_pairs_of_edited_texts_all_come_out(spark):
    rows = corpus(11) + corpus(12)
    rows = [(f"{k}/{i}", t) for k, (i, t) in enumerate(rows)]
    for threshold in (0.6, 0.75):
        got = {(r.chunk_id_a, r.chunk_id_b) for r in N.found_near_duplicates(spark.createDataFrame(rows, "chunk_id string, text string").repartition(5), threshold).collect()}
        assert got == brute(rows, threshold)


def test_shuffled_ids_and_more_partitions_give_the_same(spark, monkeypatch):
    rows = corpus(13)
    df = spark.createDataFrame(rows, "chunk_id string, text string").repartition(4)
    monkeypatch.setattr(N, "BROADCAST_IDS", 0)  # ids are joined by shuffling, as beyond the bound
    monkeypatch.setattr(N, "PART_RUNS", 200)  # many partitions, as for more runs
    plan = N._those(df, df.select("chunk_id"), "chunk_id")._jdf.queryExecution().toString()
    assert "ResolvedHint" not in plan and "(strategy=broadcast)" not in plan
    got = {(r.chunk_id_a, r.chunk_id_b) for r in N.found_near_duplicates(df).collect()}
    assert got == brute(rows, 0.6)


def test_exact_mode_lists_all_copies(spark):
    base = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(f"c{i:03d}", base) for i in range(80)], "chunk_id string, text string")
    assert N.found_near_duplicates(df, full_class=None).count() == 80 * 79 // 2
    groups = N.near_duplicate_groups(df).collect()
    assert {(r.class_id, r.group_id, r.links) for r in groups} == {("c000", "c000", 0)} and len(groups) == 80
