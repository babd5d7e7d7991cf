"""The vector index against comparing all vectors: exact, by recall, and on odd vectors and hot cells."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.operators import search
from tidewell.operators.vectors import VectorIndex, recall


def brute(rows, queries, k):
    unit = lambda v: np.asarray(v, np.float32).astype(float) / max(np.linalg.norm(np.asarray(v, np.float32).astype(float)), 1e-12)
    ok = lambda v: bool(v) and all(x is not None and math.isfinite(x) for x in v)
    out = []
    for q, v in queries:
        if ok(v):
            best = sorted((-round(float(unit(v) @ unit(w)), 9), i) for i, w in rows if i != q and ok(w))[:k]
            out += [(q, i, rank) for rank, (_, i) in enumerate(best, 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(8)
    centres = [[r.gauss(0, 1) for _ in range(12)] for _ in range(9)]
    made = [(i, [x + r.gauss(0, 0.4) for x in r.choice(centres)]) for i in range(500)]
    made += [(1000 + i, made[0][1]) for i in range(250)]  # copies of one vector are a third of all
    return [*made, (2000, [0.0] * 12), (2001, None), (2002, []), (2003, [float("nan")] * 12), (2004, [1.0] * 11 + [None])]


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)


def test_exact_search_equals_comparing_all(spark, rows):
    index = VectorIndex.build(table(spark, rows), block=60)
    assert index.rows.count() == 751 and index.parts.max() > 3
    queries = [x for x in rows if x[0] % 20 == 0]
    for probes in (1, 4):
        got = index.search(table(spark, queries), 10, probes=probes, exact=True)
        assert sorted((x.query, x.id, x["rank"]) for x in got.collect()) == brute(rows, queries, 10)


def test_probing_finds_most_and_says_how_much(spark, rows):
    index = VectorIndex.build(table(spark, rows[:500]))
    queries = table(spark, [x for x in rows[:500] if x[0] % 20 == 0])
    exact = search.nearest(table(spark, rows[:500]), queries, 10)
    (found,) = recall(index.search(queries, 10), exact).collect()
    assert found.neighbours == 250 and found.recall >= 0.9
    (few,) = recall(index.search(queries, 10, probes=1), exact).collect()
    assert few.recall < 1 and index.search(queries, 10, probes=len(index.centroids)).select(F.sum("rank")).first() == exact.select(F.sum("rank")).first()


def test_a_query_is_sent_once_for_many_cells(spark, rows):
    index = VectorIndex.build(table(spark, rows), block=60)
    queries = table(spark, [x for x in rows if x[0] % 20 == 0])
    asked = queries.select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"), F.lit(None).cast("double").alias("least")).where("size(q) = 12 and not isnan(q[0])")
    sent = index._sent(asked, len(index.centroids))
    assert len(index.packs) == index.parts.sum() > 10
    assert sent.count() == asked.count() and index.rows.select("pack").distinct().count() == 1


def test_queries_are_looked_for_in_rounds_that_leave_nothing(spark, rows, monkeypatch):
    from tidewell.operators import vectors

    made, spent, write = [], [], vectors.materialize
    monkeypatch.setattr(vectors, "materialize", lambda df, label: (made.append(label), write(df, label))[1])
    monkeypatch.setattr(vectors, "discard", lambda *tables: spent.extend(tables))
    monkeypatch.setattr(vectors, "ROUND", 15)
    monkeypatch.setattr(vectors, "QUERIES", 4)
    queries = [x for x in rows if x[0] % 20 == 0]
    got = VectorIndex.build(table(spark, rows)).search(table(spark, queries), 10, probes=2, exact=True).collect()
    assert sorted((x.query, x.id, x["rank"]) for x in got) == brute(rows, queries, 10)
    rounds = made.count("found")
    assert rounds > 1 and made.count("asked") == 2 * rounds and len(spent) == 3 * rounds


def test_few_and_no_vectors(spark):
    one = VectorIndex.build(table(spark, [(1, [1.0, 0.0])]))
    assert one.search(table(spark, [(1, [1.0, 0.0])]), exact=True).collect() == []
    assert [(x.id, round(x.similarity, 6)) for x in one.search(table(spark, [(2, [1.0, 1.0])]), exact=True).collect()] == [(1, round(0.5**0.5, 6))]
    none = VectorIndex.build(table(spark, []))
    assert none.search(table(spark, [(2, [1.0, 1.0])]), exact=True).collect() == [] and none.probes_for() == 1
