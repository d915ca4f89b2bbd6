"""Exact top-k at lengths beyond doubles and over bands of length."""

import random

from corrgrid.llm.topk import top_k


def test_products_beyond_doubles(spark):
    rows = [(0, [3.0e5 + 1 / 1024, 3.0e5]), (1, [3.0e5 + 1 / 1024, 3.0e5]), (2, [3.0e5, 3.0e5 + 1 / 1024]), (3, [-3.0e5, 1.0])]
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    a, b = 3 * 10**5 * 1024 + 1, 3 * 10**5 * 1024
    assert got == {(0, 1): (1, a * a + b * b), (0, 2): (2, 2 * a * b), (0, 3): (3, -b * a + 1024 * b)}


def test_bands_of_length_lose_nothing(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) * 2 ** (i % 9) / 16 for _ in range(6)]) for i in range(900)]
    got = top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), candidates=50, queries=3).collect()
    v = {i: [int(1024 * x // 1) for x in e] for i, e in rows}
    want = []
    for i in range(0, 900, 100):
        s = sorted((-sum(x * y for x, y in zip(v[i], w)), j) for j, w in v.items() if j != i)[:10]
        want += [(i, k + 1, j, -a) for k, (a, j) in enumerate(s)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_repeated_ids_are_rows_of_their_own(spark):
    rows = [(100, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.5, 0.0])]
    got = top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("rank").collect()
    assert [tuple(r) for r in got] == [(100, 1, 1, 2 << 20), (100, 2, 1, 1 << 20), (100, 3, 2, 1 << 19)]
    rng = random.Random(8)
    rows = [(rng.randrange(0, 300), [rng.gauss(0, 1) for _ in range(4)]) for _ in range(900)]
    got = top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), candidates=64, queries=2)
    v = [[int(1024 * x // 1) for x in e] for _, e in rows]
    want = []
    for i, (q, _) in enumerate(rows):
        if q % 100 == 0:
            s = sorted((-sum(x * y for x, y in zip(v[i], w)), rows[j][0]) for j, w in enumerate(v) if j != i)[:10]
            want += [(q, k + 1, j, -a) for k, (a, j) in enumerate(s)]
    assert sum(q % 100 == 0 for q, _ in rows) > 3 and sorted(map(tuple, got.collect())) == sorted(want)
