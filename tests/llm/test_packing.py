from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seogo.llm.packing import TOKENIZER, best_filling, best_fit, packed, packing_check, packing_report, plan, price_table, solve, token_counter


def test_knapsack_is_optimal():
    rng = np.random.default_rng(0)
    for _ in range(40):
        c = int(rng.integers(3, 150))
        value = np.where(rng.random(c + 1) < 0.5, rng.random(c + 1), 0)
        value[0] = 0
        table = price_table(value)
        best = [0.0] * (c + 1)
        for room in range(1, c + 1):
            best[room] = max([best[room - 1]] + [best[room - k] + value[k] for k in range(1, room + 1) if value[k] > 0])
        filling = best_filling(value, table, c)
        assert np.allclose(table, best) and sum(filling) <= c and abs(value[filling].sum() - best[c]) < 1e-9


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=200))
def test_plans_hold_every_item_once_and_overfill_nothing(sizes):
    h = np.bincount(np.array(sizes, np.int64), minlength=33)
    intervals, containers, _ = plan(h)
    load = np.zeros(containers, np.int64)
    for c in range(1, 33):
        rows = intervals.get(c, [])
        for rank in range(int(h[c])):
            first, base, per = [x for x in rows if x[0] <= rank][-1]
            load[base + (rank - first) // per] += c
    assert (load <= 32).all() and load.sum() == sum(sizes) and (load > 0).all()
    assert containers <= len(best_fit(sizes, 32)) * 1.25 + 2


def test_close_to_the_bound_on_many_items():
    rng = np.random.default_rng(1)
    h = np.bincount(np.clip(rng.lognormal(4.6, 0.8, 20000).astype(int), 1, 512), minlength=513)
    _, containers, _ = plan(h)
    assert (h * np.arange(513)).sum() / (containers * 512) > 0.985


def test_documents(spark):
    docs = [(1, "낱말 " * 40), (2, "word " * 9000), (3, ""), (4, None), (5, "x"), (5, "x"), (6, "글 " * 2000)] + [(100 + i, "ab " * (i % 300 + 1)) for i in range(400)]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id bigint, text string, size int").repartition(5)
    out = packed(df)
    got = out.collect()
    assert len({(r.doc_id, r.piece_no) for r in got}) == len(got) - 1 and {r.doc_id for r in got} == {d for d, _ in docs}
    load = {}
    for r in got:
        load[r.container_id] = load.get(r.container_id, 0) + r.size
    assert max(load.values()) <= 4096
    count = token_counter(Path(TOKENIZER).read_bytes())
    pieces = {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r.size)
    assert sum(pieces[2]) == count("word " * 9000) and len(pieces[2]) == 3 and pieces[1] == [count("낱말 " * 40)] and pieces[3] == pieces[4] == [0]
    report = packing_report(out).first()
    assert report.fill > 0.9 and report.containers >= report.least_containers and report.fullest <= 4096
    assert packing_check(df, out).first().asDict() == {"documents": len({d for d, _ in docs}), "missing": 0, "overfull": 0, "split_but_short": 0}
    assert packed(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        packed(df, capacity=1000, classes=300)


def lengths(seed, items, classes):
    rng = np.random.default_rng(seed)
    return np.bincount(np.clip(rng.lognormal(4.6, 0.8, items).astype(int), 1, classes), minlength=classes + 1)


def test_the_program_is_solved_for_the_whole_histogram():
    h = lengths(3, 100_000, 512)
    found, number, bound = solve(h)
    cover = np.zeros(513)
    for (k, m), x in zip(found, number, strict=True):
        assert (k * m).sum() <= 512
        cover[k] += x * m
    assert np.abs(cover - h).max() < 0.01 and len(found) <= 512
    assert bound - 1e-6 <= sum(number) <= bound * 1.0005  # the gap to the dual bound


def test_what_is_left_over_does_not_grow():
    h = lengths(4, 3000, 512)
    for times in (1, 1000, 100_000):
        _, containers, rest = plan(h * times)
        found, _, bound = solve(h * times)
        assert rest <= sum(int(m.sum()) for _, m in found) <= 512 * 16
        assert containers <= bound * 1.001 + len(found)
    assert rest < 0.001 * h.sum() * times and containers < bound * 1.001
