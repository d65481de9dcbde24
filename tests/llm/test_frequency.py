import random
from collections import Counter, defaultdict

import pytest

from qatlam.llm import frequency as Q
from qatlam.llm import heavy_hitters as H

OCC = "field string, term string, record long, id long, part int"


def occurrences(n=4000, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        term = rng.choice(["hot", "hot", "warm", None, ""]) if rng.random() < 0.6 else f"t{rng.randrange(500)}"
        row = (rng.choice(["a", "b"]), term, rng.randrange(60) if rng.random() > 0.05 else None, i, rng.randrange(3))
        rows += [row] * (2 if rng.random() < 0.05 else 1)
    return rows


@pytest.mark.parametrize("slots", [512, 2])
def test_counts_against_brute_force(spark, monkeypatch, slots):
    monkeypatch.setattr(Q, "LEAST_SLOTS", slots)
    monkeypatch.setattr(Q, "SLOTS_A_PARTITION", 0)
    rows = occurrences()
    n, records = Counter(), defaultdict(set)
    for f, t, r, _, _ in set(rows):
        if t:
            n[f, t] += 1
            if r is not None:
                records[f, t].add(r)
    df = spark.createDataFrame(rows, OCC).where("term is not null and term != ''")
    got = {(x["field"], x["term"]): (x["occurrences"], x["records"]) for x in Q.term_frequencies(df).collect()}
    assert got == {k: (n[k], len(records[k])) for k in n}
    assert Q.heavy_terms(df).where("endswith(key, '=hot')").count() == 2


def test_marks(spark):
    rows = [("f", "rare", r, r, 0) for r in (1, 2)] + [("f", "usual", r, 100 + r, 0) for r in (1, 2, 3)] + [("f", "common", r, 200 + r, 0) for r in (1, 2, 3, 4)] + [("f", "lost", None, 300, 0)]
    runs = spark.createDataFrame([(r % 10,) for r in range(30)] + [(None,)], "run_id long")
    got = {x["term"]: x["mark"] for x in Q.marked_frequencies(spark.createDataFrame(rows, OCC), runs).collect()}
    assert got == {"rare": "rare", "lost": "rare", "usual": None, "common": "common"}


def test_empty_and_long_terms(spark):
    assert Q.term_frequencies(spark.createDataFrame([], OCC)).count() == 0
    rows = [("f", "y" * 10_000, 1, i, 0) for i in range(20)]
    assert Q.term_frequencies(spark.createDataFrame(rows, OCC).selectExpr("*", "1 as slot")).first()["occurrences"] == 20


def test_long_terms_are_heavy_too(spark):
    """A hot term of any length is counted by slot; two long terms with the same beginning stay two."""
    rows = [("f", "y" * 10_000 + str(i % 2), i % 7, i, 0) for i in range(40)] + [("f", f"t{i}", 1, 100 + i, 0) for i in range(10)]
    df = spark.createDataFrame(rows, OCC)
    assert Q.heavy_terms(df).selectExpr("max(length(key))").first()[0] <= 80
    assert Q.heavy_terms(df).where("contains(key, '#')").count() == 2
    got = {(x["term"][-1], x["occurrences"], x["records"]) for x in Q.term_frequencies(df).collect() if len(x["term"]) > 9}
    assert got == {("0", 20, 7), ("1", 20, 7)}


def values(n=3000):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        v = None if rng.random() < 0.1 else "" if rng.random() < 0.05 else f"v{int(rng.paretovariate(0.7))}"
        rows += [(rng.choice(["a", "b"]), i, v)] * rng.choice([1, 1, 1, 2])
    return rows + [("a", None, "v1")]


def exact(rows):
    n = defaultdict(Counter)
    for f, i, v in set(rows):
        if v is not None and i is not None:
            n[f][v] += 1
    return n


def test_frequent_values(spark):
    rows = values()
    n = exact(rows)
    got = {(x["field"], x["item"], x["ids"]) for x in H.frequent_values(spark.createDataFrame(rows, "field string, id long, value string"), 1).collect()}
    assert got == {(f, v, c) for f in n for v, c in n[f].items() if c * 100 >= sum(n[f].values())}


@pytest.mark.parametrize("k", [1, 7, 5000])
def test_top_values(spark, k):
    rows = values()
    n = exact(rows)
    got = [(x["field"], x["rank"], x["item"], x["ids"]) for x in H.top_values(spark.createDataFrame(rows, "field string, id long, value string"), k).orderBy("field", "rank").collect()]
    assert got == [(f, r, v, c) for f in sorted(n) for r, (v, c) in enumerate(sorted(n[f].items(), key=lambda x: (-x[1], x[0]))[:k], 1)]


def test_no_values(spark):
    empty = spark.createDataFrame([("a", 1, None)], "field string, id long, value string")
    assert H.frequent_values(empty, 1).count() == 0 and H.top_values(empty, 3).count() == 0


@pytest.mark.parametrize("held", [H.HELD, 50])
def test_top_values_of_flat_columns(spark, monkeypatch, held):
    """More distinct values than a sketch has counters: no value, or fewer than k, stand out."""
    k = 20
    monkeypatch.setattr(H, "HELD", held)
    flat = spark.range(60_000).selectExpr("'flat' field", "id", "concat('v', id) value")
    few = flat.selectExpr("'few' field", "id", "value").unionAll(spark.range(600).selectExpr("'few'", "100000 + id", "concat('heavy', id % 3)"))
    steep = spark.range(60_000).selectExpr("'steep' field", "id", "concat('w', if(id < 30000, id % 30, id)) value")
    got = defaultdict(list)
    for x in H.top_values(flat.unionAll(few).unionAll(steep), k).orderBy("field", "rank").collect():
        got[x["field"]].append((x["item"], x["ids"]))
    names = sorted(f"v{i}" for i in range(60_000))
    assert got["flat"] == [(v, 1) for v in names[:k]]
    assert got["few"] == [(f"heavy{i}", 200) for i in range(3)] + [(v, 1) for v in names[: k - 3]]
    assert got["steep"] == [(v, 1000) for v in sorted(f"w{i}" for i in range(30))[:k]]


def test_prefixes_are_lengthened_until_values_remain(spark, monkeypatch):
    """With short steps it takes many rounds to part the values behind a prefix; each keeps no more prefixes than the bound allows."""
    monkeypatch.setattr(H, "FIRST_BITS", 2)
    monkeypatch.setattr(H, "STEP_BITS", 2)
    rounds, written = [], H.materialise
    monkeypatch.setattr(H, "materialise", lambda df, name: rounds.append(written(df, name)) or rounds[-1])
    df = spark.range(20_000).selectExpr("'f' field", "id", "if(id < 12000, concat('hot', id % 12), concat('v', id)) value")
    got = {x["item"]: x["ids"] for x in H.frequent_values(df, 4).collect()}
    assert got == {f"hot{i}": 1000 for i in range(12)}
    last = rounds[-1].where("n >= 800")
    assert len(rounds) > 2 and last.count() <= 20_000 // 800 and last.where("low < high and n > 1200").count() == 0
