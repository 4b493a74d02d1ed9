"""The whole toxicity query on small texts: folds, counts, features, curve and threshold by a plain program."""

import math
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from linkgrain.llm import toxicity

from .test_brute_force import kneser_ney


def plain_features(own):
    windows = [max((sum(own[a : a + n]) / n for a in range(len(own))), default=0) for n in (1, 4, 16)]
    return [sum(own) / len(own) if own else 0, *windows]


def plain_curve(x, y):
    """Ridge logistic regression on standardised columns by gradient descent until nothing moves."""
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    penalty = np.array([1.0] * x.shape[1] + [1e-6])
    w = np.zeros(z.shape[1])
    for _ in range(200_000):
        slope = z.T @ (y - 1 / (1 + np.exp(-z @ w))) - penalty * w
        w += 0.01 * slope
        if np.abs(slope).max() < 1e-10:
            break
    return lambda f: 1 / (1 + math.exp(-(np.append((np.array(f) - mean) / scale, 1) @ w)))


def test_scores_equal_a_plain_program(spark):
    rng = random.Random(12)
    plain, bad = ["tree", "river", "stone", "walks", "over", "the", "blue"], ["trash", "idiot", "stupid", "the", "you"]
    rows, labels = [], []
    for i in range(110):
        toxic = int(rng.random() < 0.35)
        rows.append((i, " ".join(rng.choices(plain, k=rng.randrange(1, 7)) + (rng.choices(bad, k=2) if toxic else []))))
        if rng.random() < 0.9:
            labels.append((i, toxic if rng.random() < 0.95 else 1 - toxic))
    rows += [(500, None), (501, "")]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, marks, order=4).collect()}
    held = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    assert {i for i, r in got.items() if r.held_out} == held
    known = {i: t for i, t in labels if i not in held}
    by_hash = [r.doc_id for r in docs.filter(F.col("doc_id").isin(list(known))).orderBy(F.xxhash64(F.lit("tune"), F.col("doc_id").cast("string"))).collect()]
    tune = set(by_hash[: len(known) // 4])
    text = dict(rows)
    ratios = kneser_ney([(text[i], t) for i, t in known.items() if i not in tune])
    features = {i: plain_features(ratios(t or "")) for i, t in rows}
    curve = plain_curve(np.array([features[i] for i in sorted(tune)]), np.array([float(known[i]) for i in sorted(tune)]))
    for i, r in got.items():
        want = curve(features[i])
        assert abs(r.score - want) < 1e-4 and abs(r.log_ratio - features[i][0]) < 1e-4
        assert r.predicted == int(r.score >= 0.3)
