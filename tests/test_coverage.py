"""Coverage of tests against plain Python."""

import random

from linkgrain.operators import evidence


def test_pairs_are_counted_where_they_meet(spark):
    rng = random.Random(4)
    runs = [(f"t{rng.randrange(6)}", f"p{rng.randrange(2)}", s := rng.randrange(0, 400), s + rng.choice((0, 1, 5, 63, 64, 130))) for _ in range(60)]
    spans = [(f"p{rng.randrange(2)}", f"i{n % 45}", s := rng.randrange(0, 400), s + rng.choice((-1, 0, 3, 36, 63, 64, 65, 200))) for n in range(60)]
    lines = {(t, p, n) for t, p, s, e in runs for n in range(s, e + 1)}
    want = {}
    for p, i, s, e in spans:
        for t, q, n in lines:
            if p == q and s <= n <= e:
                want[t, i] = want.get((t, i), 0) + 1
    single = [x for x in spans if sum(y[1] == x[1] for y in spans) == 1]
    got = evidence.context_edges(spark.createDataFrame(runs, "test string, path string, s int, e int"), spark.createDataFrame(spans, "path string, id string, s int, e int"))
    assert sorted(map(tuple, got.collect())) == sorted((*k, v) for k, v in want.items())
    assert len(single) > 20
    # Pairs go out where they meet; only those of several spans are grouped.
    assert got._jdf.queryExecution().optimizedPlan().toString().startswith("Union")
