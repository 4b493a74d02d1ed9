"""Near-duplicates of documents that lists tie together though most of them are no links."""

import random

from linkgrain.llm import near


def plain_components(rows, words):
    sets = {}
    for i, t in rows:
        w = t.split()
        sets[i] = {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def components_of(spark, rows, words=4):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    return {r.doc_id: r.component_id for r in near.near_duplicates(docs, words=words).collect()}


def test_revisions_in_chains_and_groups(spark):
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(10**6)}"
    rows, i = [], 0
    for keep in (0.5, 0.75, 0.85, 0.93):
        text = [word() for _ in range(rng.randrange(60, 140))]
        for _ in range(25):
            rows.append((i, " ".join(text)))
            i += 1
            cut = int(len(text) * keep)
            text = text[-cut:] + [word() for _ in range(len(text) - cut)]
    shared = [word() for _ in range(70)]
    for _ in range(40):  # one template with texts of its own: most pairs fall short
        own = [word() for _ in range(rng.randrange(4, 40))]
        rows.append((i, " ".join(shared + own)))
        i += 1
    for _ in range(30):
        base = rng.choice(rows)[1].split()
        base[rng.randrange(len(base))] = word()
        rows.append((i, " ".join(base)))
        i += 1
    assert components_of(spark, rows) == plain_components(rows, 4)


def test_a_long_chain_without_links_stays_apart(spark):
    words = [f"c{k}" for k in range(200 * 3002)]
    rows = [(k, " ".join(words[100 * k : 100 * k + 200])) for k in range(3000)]
    assert components_of(spark, rows) == {k: k for k, _ in rows}
