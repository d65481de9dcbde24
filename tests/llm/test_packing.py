from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from qatlam.llm import packing as P


@settings(max_examples=60, deadline=None)
@given(st.integers(2, 60), st.data())
def test_plan_takes_in_every_item(capacity, data):
    hist = np.array([0] + data.draw(st.lists(st.integers(0, 40), min_size=capacity, max_size=capacity)))
    seen = np.zeros(capacity + 1, dtype=int)
    first = 0
    for start, n, content in P.plan_containers(hist, capacity):
        assert start == first and n > 0 and sum(s * c for s, c in content) <= capacity
        first += n
        for s, c in content:
            seen[s] += n * c
    assert (seen == hist).all()
    total = int((hist * np.arange(capacity + 1)).sum())
    # best fit never leaves two containers that one could hold: at most twice the least, and one
    assert first <= 2 * -(-total // capacity) + 1


def test_solver():
    parts = np.array([[6, 4, 0], [5, 5, 0], [8, 2, 0]])
    hist = np.zeros(11)
    hist[[6, 4, 5, 8, 2]] = [30, 30, 40, 7, 7]
    assert np.allclose(P.non_negative_least_squares(parts, hist, 2000), [30, 20, 7], atol=0.1)


def test_dense_lengths_waste_little():
    rng = np.random.default_rng(1)
    hist = np.bincount(np.minimum(512, rng.lognormal(5, 0.8, 40_000).astype(int) + 1), minlength=513)
    groups = P.plan_containers(hist, 512)
    used = groups[-1][0] + groups[-1][1]
    assert used * 512 <= 1.003 * (hist * np.arange(513)).sum() + 512


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(i, "salom dunyo " * (i * i % 97)) for i in range(1, 120)] + [(200, None), (201, ""), (202, " "), (None, "x"), (203, "uzun matn " * 3000)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_packed(spark, documents):
    specs = spark.createDataFrame([(1, 64), (2, 500), (2, 500)], "spec_id int, capacity_tokens int")
    sizes = {r["doc_id"]: r["n_tokens"] for r in P.token_counts(documents).collect()}
    assert sizes.keys() == {*range(1, 120), 201, 202, 203} and sizes[201] == 0
    rows = P.pack(documents, specs).collect()
    for spec, capacity in ((1, 64), (2, 500)):
        room, pieces = defaultdict(list), defaultdict(list)
        for r in rows:
            if r["spec_id"] == spec:
                pieces[r["doc_id"]].append(r)
                room[r["container_id"]].append(r)
        assert pieces.keys() == sizes.keys()
        for doc, of in pieces.items():
            of.sort(key=lambda r: r["piece"])
            assert [r["piece"] for r in of] == list(range(len(of))) and sum(r["n_tokens"] for r in of) == sizes[doc]
            assert len(of) == max(1, -(-sizes[doc] // capacity))
            assert [r["first_token"] for r in of] == [k * capacity for k in range(len(of))]
        for of in room.values():
            full = sorted((r for r in of if r["n_tokens"]), key=lambda r: r["slot"])
            assert [r["slot"] for r in full] == list(range(len(full)))
            at = 0
            for r in full:
                assert r["offset"] == at
                at += r["n_tokens"]
            assert at <= capacity
        assert sorted(c for c, of in room.items() if any(r["n_tokens"] for r in of)) == list(range(len({r["container_id"] for r in rows if r["spec_id"] == spec and r["n_tokens"]})))
    waste = {r["spec_id"]: r for r in P.waste(P.pack(documents, specs), specs).collect()}
    assert waste[2]["unused"] == waste[2]["containers"] * 500 - sum(sizes.values())


def test_refusals_and_empty(spark, documents):
    for bad in (None, 0, -3):
        with pytest.raises(ValueError):
            P.pack(documents, spark.createDataFrame([(1, bad)], "spec_id int, capacity_tokens int"))
    specs = spark.createDataFrame([(1, 64)], "spec_id int, capacity_tokens int")
    assert P.pack(documents.limit(0), specs).count() == 0
    assert P.pack(documents, specs.limit(0)).count() == 0


@pytest.mark.parametrize(("capacity", "classes"), [(131_072, 65_536), (500, 100), (503, 100), (7, 3), (2_000_000_000, 65_536)])
def test_large_capacities_are_planned_in_classes(spark, documents, monkeypatch, capacity, classes):
    monkeypatch.setattr(P, "MOST_CLASSES", classes)
    monkeypatch.setattr(P, "TEXTS_A_PART", 1)
    monkeypatch.setattr(P, "LEAST_PARTS", 3)
    rows = P.pack(documents, spark.createDataFrame([(1, capacity)], "spec_id int, capacity_tokens int")).collect()
    room, pieces = defaultdict(list), defaultdict(int)
    for r in rows:
        pieces[r["doc_id"]] += r["n_tokens"]
        if r["n_tokens"]:
            room[r["container_id"]].append((r["offset"], r["n_tokens"], r["slot"]))
    assert pieces == {r["doc_id"]: r["n_tokens"] for r in P.token_counts(documents).collect()}
    for of in room.values():
        of.sort()
        assert [s for _, _, s in of] == list(range(len(of)))
        assert all(a + n <= b for (a, n, _), (b, _, _) in zip(of, of[1:], strict=False)) and of[-1][0] + of[-1][1] <= capacity


def test_bisection(spark):
    plan = F.from_json(F.lit("[" + ",".join(f'{{"start":{3 * k}}}' for k in range(11)) + "]"), "array<struct<start:long>>")
    got = [r[0] for r in spark.range(40).select(P._row_at(plan, F.col("id"), 11)["start"]).collect()]
    assert got == [min(30, n // 3 * 3) for n in range(40)]
