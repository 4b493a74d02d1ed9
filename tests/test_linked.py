"""Linked tests against plain Python."""

import random

from linkgrain.operators import evidence


def test_linked_tests_gather_few_pairs(spark):
    rng = random.Random(8)
    kinds = [(f"i{n}", "implementation") for n in range(12)] + [(f"t{n}", "test") for n in range(12)] + [("r0", "requirement")]
    links = {(rng.choice(("satisfies", "exercises", "verifies")), rng.randrange(14), rng.randrange(14), rng.randrange(5)) for _ in range(150)}
    rows = [(f"i{i}", p, f"r{r}") if p == "satisfies" else (f"t{t}", p, f"r{r}" if p == "verifies" else f"i{i}") for p, i, t, r in links] + [("i1", "satisfies", None), ("t1", "verifies", None), ("t1", "exercises", None)]
    edges = spark.createDataFrame(rows + rows[:20], "f string, p string, t string")
    got = evidence.linked_tests(spark.createDataFrame(kinds, "trace_id string, node_type string"), edges)
    ids = {k for k, _ in kinds}
    of = lambda kind: {(f, t) for f, p, t in rows if p == kind and t}
    want = {(i, t) for i, r in of("satisfies") for t, q in of("verifies") if q == r} | {(i, t) for t, i in of("exercises")}
    assert sorted(map(tuple, got.collect())) == sorted((i, t) for i, t in want if i in ids and t in ids)
    # All pairs that can come but once stay where they met.
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.split("\n")[0].startswith("Union")
