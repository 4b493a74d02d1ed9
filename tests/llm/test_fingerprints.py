"""Whitening, fingerprints and spelling variants: brute force, merging, and the stated results of odd inputs."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from linkgrain.llm import fingerprints, queries, spelling, whiten
from pyspark.sql import functions as F


# ---------------------------------------------------------------- whitening

def plain_whitening(vectors, k=32, scale=64):
    x = np.floor(scale * np.array(vectors, float)) + 1_000_000
    c = x - x.mean(axis=0)
    values, vectors = np.linalg.eigh(c.T @ c / len(x))
    values, vectors = values[::-1], vectors[:, ::-1]
    return x, c, values[:k], vectors[:, :k], values.sum()


def test_whitening_query(spark, small):
    rows = queries.table(spark, small, "embeddings").collect()
    x, c, values, vectors, trace = plain_whitening([r.embedding for r in rows])
    got = {}
    for r in queries.op11_whitening(spark, small).collect():
        got[r.vec_id, r.component] = r
    assert len(got) == len(rows) * 32
    total = [int(s) for s in x.sum(axis=0)]
    want = c @ vectors / np.sqrt(values)
    for i, row in enumerate(rows):
        exact = sum((len(rows) * int(v) - s) ** 2 for v, s in zip(x[i], total, strict=True))
        assert got[row.vec_id, 1].deviation == exact and got[row.vec_id, 1].n == len(rows)
    for j in range(32):
        own = np.array([got[r.vec_id, j + 1].whitened for r in rows])
        assert min(np.abs(own - want[:, j]).max(), np.abs(own + want[:, j]).max()) < 1e-6
        assert got[rows[0].vec_id, j + 1].explained == pytest.approx(values[j] / trace, rel=1e-9)
    assert all(r.identity_error < 1e-9 for r in got.values())


def test_sketches_merge_without_loss():
    rng = np.random.default_rng(3)
    x = rng.integers(-500, 500, (700, 12)) + rng.integers(0, 10**9, 12)
    parts = [whiten.Sketch.of(p) for p in np.split(x, [1, 5, 300, 302])]
    total = parts[0]
    for p in parts[1:]:
        total = total.merged(p)
    c = x - x.mean(axis=0)
    assert total.n == 700 and total.sums == [int(s) for s in x.sum(axis=0)]
    assert np.allclose(total.factor.T @ total.factor, c.T @ c, rtol=1e-9, atol=1e-3)
    assert total.factor.shape == (12, 12)


def test_whitening_in_many_leaves(spark, small):
    rows = queries.table(spark, small, "embeddings")
    one = whiten.fitted(whiten.usable(rows.coalesce(1), "vec_id", "embedding"), 64.0, 8)
    many = whiten.fitted(whiten.usable(rows.repartition(150), "vec_id", "embedding"), 64.0, 8, block_rows=3)
    assert one.n == many.n and one.sums == many.sums
    assert np.allclose(one.variances, many.variances, rtol=1e-10) and np.allclose(one.directions, many.directions, atol=1e-8)


def test_whitening_edges(spark):
    schema = "vec_id long, embedding array<float>, n int, deviation string"
    assert whiten.whitened(spark.createDataFrame([], schema)).collect() == []
    assert whiten.whitened(spark.createDataFrame([(1, None, 0, ""), (2, [], 0, ""), (3, [1.0, None], 0, ""), (4, [float("nan"), 1.0], 0, ""), (5, [float("-inf"), 1.0], 0, "")], schema)).collect() == []
    (one,) = whiten.whitened(spark.createDataFrame([(None, [0.5, -0.5], 0, "")], schema)).collect()
    assert one.vec_id is None and one.n == 1 and one.deviation == 0 and list(one.coordinates) == [0, 0] and list(one.explained) == [0, 0] and one.identity_error == 0
    rows = spark.createDataFrame([(i, [float(i), 2.0, float(i % 3)], 0, "") for i in range(9)] + [(1, [1.0, 2.0, 1.0], 0, ""), (50, [1.0], 0, "")], schema)
    got = whiten.whitened(rows).collect()
    assert len(got) == 10 and all(len(r.coordinates) == 3 and r.coordinates[2] == 0 and r.explained[2] == 0 for r in got) and got[0].identity_error < 1e-9
    huge = whiten.whitened(spark.createDataFrame([(1, [3e38, 0.0], 0, ""), (2, [-3e38, 1.0], 0, ""), (3, [0.0, 1.0], 0, "")], schema)).orderBy("vec_id").collect()
    s = (1 << 63) - 1 + -(1 << 63)
    assert int(huge[2].deviation) == (0 - s) ** 2 + (3 * 64 - 128) ** 2
    assert int(huge[0].deviation) == (3 * ((1 << 63) - 1) - s) ** 2 + (0 - 128) ** 2 if (3 * (1 << 63)) ** 2 < 10**38 else huge[0].deviation is None


# ---------------------------------------------------------------- fingerprints

def plain_sketch(text):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    hashes = {hashlib.md5(" ".join(words[max(0, i - 4) : i + 1]).encode()).hexdigest()[:12] for i in range(len(words))}
    return sorted(h for h in hashes if h < "4") or sorted(hashes)[:1]


def plain_fingerprints(rows):
    order = sorted(rows, key=lambda r: -r[0])
    out = {}
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1], strict=True):
        t, nxt = t or "", nxt or ""
        k = len(t) // 3
        e = t[: len(t) - k] + nxt[:k]
        out[i] = (len(t), hashlib.sha256(e.encode()).hexdigest(), plain_sketch(t), plain_sketch(e), plain_sketch(nxt))
    return out


def sketched(rows):
    return {r.doc_id: (r.n_chars, r.edited_sha256, r.sketch, r.edited_sketch, r.next_sketch) for r in rows.collect()}


def test_fingerprints_of_any_ranges(spark):
    rng = random.Random(5)
    words = ["Alpha", "beta", "γάμμα", "🤦x", "DELTA", "e", "zed"]
    texts = [(i * 7 - 400, rng.choice(["", " ", "\t", "\n\n"]).join(rng.choices(words, k=rng.randrange(0, 60)))) for i in range(300)]
    texts += [(5000, None), (5001, ""), (5002, "one"), (9_007_199_254_740_993, "big A"), (9_007_199_254_740_992, "big B")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("_text", F.lit(1)).withColumn("_next", F.lit(2)).repartition(7)
    assert sketched(fingerprints.fingerprints(docs)) == plain_fingerprints(texts)
    spread = fingerprints.with_next(docs, "doc_id", "text", rows_per_range=3)
    order = sorted(texts, key=lambda r: -r[0])
    want = {(i, t or "", n or "") for (i, t), (_, n) in zip(order, order[1:] + order[:1], strict=True)}
    assert {(r["_id"], r["_text"], r["_next"]) for r in spread.collect()} == want and spread.count() == len(texts)


def test_fingerprint_edges(spark):
    schema = "doc_id long, text string"
    of = lambda rows: fingerprints.fingerprints(spark.createDataFrame(rows, schema))
    assert of([]).collect() == []
    assert sketched(of([(1, "abc def ghi")])) == plain_fingerprints([(1, "abc def ghi")])
    assert [len(r.sketch) for r in of([(1, None), (2, " \n")]).collect()] == [0, 0]
    same = of([(1, "a b c d e f g h"), (1, "a b c d e f g h"), (1, "z")]).collect()
    assert len(same) == 3 and len({tuple(r.sketch) for r in same}) == 2
    nulls = of([(None, "x y z" * 5), (None, None), (None, "q"), (3, "three little words")]).collect()
    assert len(nulls) == 4 and sum(r.next_sketch == plain_sketch("three little words") for r in nulls) == 1
    long = "word and other things " * 60_000
    assert sketched(of([(1, long), (2, "short")])) == plain_fingerprints([(1, long), (2, "short")])


def test_sketches_unite_and_contain(spark):
    rng = random.Random(1)
    parts = [" ".join(str(rng.randrange(10**6)) for _ in range(n)) for n in (30, 9000)]
    a, b = (fingerprints.sketch(F.col(c)) for c in "ab")
    row = spark.createDataFrame([(parts[0], parts[1] + " " + parts[0])], "a string, b string").select(a.alias("a"), b.alias("b"), fingerprints.merged(a, b).alias("m"), fingerprints.containment(a, b).alias("c"), fingerprints.likeness(a, b).alias("l")).first()
    assert row.c > 0.6 and row.l < 0.05 and row.m == sorted(set(row.a) | set(row.b))


def test_fingerprint_query_tells_edits_from_others(spark, small):
    rows = queries.op12_fingerprints(spark, small).filter("n_chars >= 300").collect()
    assert sum(r.near_edited > r.near_next for r in rows) >= 0.97 * len(rows) and 0.35 < sum(r.near_edited for r in rows) / len(rows) < 0.65


# ---------------------------------------------------------------- spelling

def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain_words(docs):
    n = {}
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                n[run] = n.get(run, 0) + 1
    return n


def plain_groups(n):
    out = {}
    for w in n:
        near = [v for v in n if abs(len(v) - len(w)) <= 1 and v != w and plain_distance(v, w) == 1]
        best = min(near, key=lambda v: (-n[v], v), default=None)
        out[w] = (n[w], len(near), *((best, n[best]) if best and n[best] >= 10 * n[w] else (None, None)))
    roots = {}
    for w in n:
        at = w
        while out[at][2]:
            at = out[at][2]
        roots[w] = at
    return {w: (*v, roots[w]) for w, v in out.items()}


def grouped(rows):
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in rows.collect()}


def test_words_with_deletions(spark, small):
    docs = [(r.doc_id, r.text) for r in queries.table(spark, small, "documents").collect()] + [(None, "Éclairage ABCDEFGH×÷ " * 3)]
    got = {r.word: r.n for r in spelling.misspelt_words(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == plain_words(docs)


@pytest.mark.parametrize("shard_rows", [7, 20_000])
def test_groups_against_all_pairs(spark, shard_rows):
    rng = random.Random(9)
    n = {}
    for _ in range(40):
        base = "".join(rng.choices("abcé", k=rng.randrange(7, 14)))
        n[base] = rng.choice([5, 100, 2000])
        for _ in range(9):
            k, c = rng.randrange(len(base) + 1), rng.choice("abcé")
            v = rng.choice([base[:k] + c + base[k:], base[:k] + base[k + 1 :], base[:k] + c + base[k + 1 :]])
            n.setdefault(v, rng.choice([2, 3, 50, 300]))
            base = v if rng.random() < 0.3 else base
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    assert grouped(spelling.variant_groups(words, shard_rows=shard_rows)) == plain_groups(n)


def test_one_half_that_all_words_own(spark):
    """Words of one first half, in a grid of cells."""
    rng = random.Random(2)
    n = {"interna" + "".join(rng.choices("abcd", k=7)): rng.randrange(2, 900) for _ in range(600)}
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    assert grouped(spelling.variant_groups(words, shard_rows=90)) == plain_groups(n)


def test_long_words_and_edges(spark):
    a = "".join(random.Random(4).choices("abcdefgh", k=60_000))
    b, c, d = a[:31_000] + "z" + a[31_001:], a[:10] + a[11:], a[:-1] + "zz"
    n = {a: 1000, b: 50, c: 3, d: 2, "lonelyword": 2}
    got = grouped(spelling.variant_groups(spark.createDataFrame(list(n.items()), "word string, n long")))
    assert got == {a: (1000, 2, None, None, a), b: (50, 1, a, 1000, a), c: (3, 1, a, 1000, a), d: (2, 0, None, None, d), "lonelyword": (2, 0, None, None, "lonelyword")}
    schema = "doc_id long, text string, word int, n int"
    assert spelling.spelling_variants(spark.createDataFrame([], schema)).collect() == []
    assert spelling.spelling_variants(spark.createDataFrame([(1, None, 0, 0), (None, "", 0, 0), (2, "short 12", 0, 0)], schema)).collect() == []


def test_one_edit_is_one_edit():
    rng = random.Random(6)
    for _ in range(4000):
        a, b = ("".join(rng.choices("ab", k=rng.randrange(0, 7))) for _ in range(2))
        assert spelling.differ_by_one(a, b) == (plain_distance(a, b) == 1)
