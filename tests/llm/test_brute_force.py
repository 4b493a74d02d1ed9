"""Queries and stages against plain programs over the small tables."""

import collections
import math
import re
import zlib
from html import unescape

import pytest

import __spark_entry__
import corpus_pipeline
from linkgrain.llm import queries
from linkgrain.llm.common import written

from ..compare import same


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, small, name):
    same(spark, small, queries.QUERIES[name], queries.SQL[name])


def words(text):
    return (text or "").encode().lower().split()


def repeated(rows, n=50):
    seen, out = set(), {}
    for i, t in sorted(rows):
        w = words(t)
        for k in range(len(w) - n + 1):
            g = tuple(w[k : k + n])
            if g in seen:
                out.setdefault(i, set()).update(range(k, k + n))
            seen.add(g)
    return out


def covered(rows):
    out = {}
    for r in rows:
        out.setdefault(r["doc_id"], set()).update(range(r["start_word"], r["end_word"]))
    return out


def test_suffix_query(spark, small):
    rows = [(r.doc_id, r.text) for r in queries.table(spark, small, "documents").collect()]
    assert covered(queries.op1_suffix_dedup(spark, small).collect()) == repeated(rows)


def held_items(docs, items):
    """(doc, item): best weighted similarity, of at least 0.8, over all runs of the item's length."""
    found = {}
    grams = lambda w: {tuple(w[k : k + min(5, len(w))]) for k in range(len(w) - min(5, len(w)) + 1)}
    times = collections.Counter(g for _, t in items if words(t) for g in grams(words(t)))
    weight = lambda gs: sum(1 / (1 + math.log(max(times[g], 1))) for g in gs)
    for item, t in items:
        own = words(t)
        want = grams(own)
        for i, text in docs:
            w = words(text)
            if own and w and not want.isdisjoint(grams(w) if len(own) >= 5 else {tuple(w[k : k + len(own)]) for k in range(len(w))}):
                runs = [{tuple(r[k : k + min(5, len(own))]) for k in range(len(r) - min(5, len(own)) + 1)} for r in (w[k : k + len(own)] for k in range(max(1, len(w) - len(own) + 1)))]
                best = max(weight(want & got) / weight(want | got) for got in runs)
                if best >= 0.8 - 1e-9:
                    found[i, item] = best
    return found


def test_decontamination_query(spark, small):
    docs = [(r.doc_id, r.text) for r in queries.table(spark, small, "documents").collect()]
    items = [(r.item_id, r.text) for r in queries.table(spark, small, "benchmark").collect()]
    got = {(r.doc_id, r.item_id): r.similarity for r in queries.op10_decontamination(spark, small).collect()}
    want = held_items(docs, items)
    assert len(got) > 0 and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_language_query(spark, small):
    rows = queries.op8_language_id(spark, small).join(queries.table(spark, small, "documents").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)


def test_language_does_not_depend_on_the_batch(spark, small):
    import pyarrow as pa

    from linkgrain.llm import language

    rows = queries.table(spark, small, "documents")
    model = language.fold_model(rows)
    texts = [r.text for r in rows.orderBy("doc_id").limit(120).collect()]
    texts += [f"{a} {b} {c}" for a, b, c in zip(texts[:30], texts[30:60], texts[60:90], strict=True)]
    whole = language._predictions(pa.array(texts, pa.string()), model)
    assert whole == [language._predictions(pa.array([t], pa.string()), model)[0] for t in texts]
    assert whole[::-1] == language._predictions(pa.array(texts[::-1], pa.string()), model)


def article_text(html):
    """The article of the tables' pages, whose articles hold text blocks alone, by plain cutting."""
    inner = re.search(r"<article>(.*)</article>", html or "", re.S)
    blocks = re.split(r"</?(?:p|h\d|ul|ol|li|div|pre|blockquote|table|tr|td)\b[^>]*>", inner[1]) if inner else []
    lines = [" ".join(unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br\s*/?>", " ", x))).split()) for x in blocks]
    return "\n".join(x for x in lines if x)


def test_html_query(spark, small):
    page = {r.page_id: r for r in queries.table(spark, small, "pages").collect()}
    rows = queries.op5_html_text(spark, small).collect()
    assert len(rows) == len(page)
    for r in rows:
        assert (r.text, r.n_chars, r.url) == (want := article_text(page[r.page_id].html), len(want), page[r.page_id].url)


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    shape = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = written(stage(spark, before, small), "test-stage")
        kept[name] = (before, docs)
        if name != "mix":
            assert docs.columns == shape
    ids = lambda d: [r.doc_id for r in d.select("doc_id").collect()]
    before, after = kept["language"]
    found = {r.doc_id: r for r in queries.language.identify(before, queries.language.fold_model(before)).collect()}
    assert sorted(ids(after)) == sorted(i for i, r in found.items() if r.lang_pred != "und" and r.score >= corpus_pipeline.LEAST_SHARE)
    before, after = kept["near_duplicates"]
    sets = {}
    for r in before.collect():
        w = words(r.text)
        sets[r.doc_id] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    lists = collections.defaultdict(list)
    for i in sorted(sets):
        for g in sets[i]:
            lists[g].append(i)
    for i in sets:
        for j, n in collections.Counter(j for g in sets[i] for j in lists[g] if j < i).items():
            if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    assert sorted(ids(after)) == sorted(i for i in sets if root(i) == i)
    before, after = kept["suffix_dedup"]
    cut = repeated([(r.doc_id, r.text) for r in before.collect()])
    left = {r.doc_id: words(r.text) for r in after.collect()}
    for r in before.collect():
        w = [x for k, x in enumerate(words(r.text)) if k not in cut.get(r.doc_id, ())]
        assert left.get(r.doc_id, []) == w
    before, after = kept["decontamination"]
    items = [(r.item_id, r.text) for r in queries.table(spark, small, "benchmark").collect()]
    assert set(ids(before)) - set(ids(after)) == {i for i, _ in held_items([(r.doc_id, r.text) for r in before.collect()], items)}
    before, after = kept["mix"]
    rows = after.collect()
    assert all(len(words(r.text)) == r.words for r in rows) and set(ids(after)) <= set(ids(before))
    assert len({(r.shard, r.position) for r in rows}) == len(rows)


def test_pipeline_of_an_empty_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, small), "test-empty")
    assert docs.count() == 0


def test_pipeline_with_nulls_repeated_ids_and_clashing_names(spark, small):
    long = " ".join(f"the word{n} of that" for n in range(40))
    rows = [(1, long, "en"), (1, long, "en"), (1, long + " and more", "en"), (2, None, "en"), (None, "the that of", "en"), (3, "", None), (4, "the of that " * 30, "en"), (5, "12 34", "en"), (6, "that is the other of the " + long, "en")]
    docs = spark.createDataFrame([(i, t, lang, None if i == 4 else "s", 0, 1, 2, 3) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long, _id int, spans int, row int")
    base = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, small), "test-odd")
        if name != "mix":
            assert docs.columns == base and docs.filter("doc_id is null").count() == 0
        if name == "near_duplicates":
            assert docs.count() == docs.select("doc_id").distinct().count()
    assert {r.doc_id for r in docs.select("doc_id").collect()} <= {1, 4, 6}


def test_names():
    names = set(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


def kneser_ney(texts, order=4, d=0.75):
    """log P_1 / P_0 of every byte of every word, by plain counting; ``texts``: (text, toxic)."""
    units = lambda text: [b" " + x + b" " for x in re.sub(rb"[^a-z\x80-\xff]+", b" ", text.encode().lower()).split()]
    grams = lambda u: [u[max(0, k - order + 1) : k + 1] for k in range(1, len(u))]
    count = [collections.Counter(), collections.Counter()]
    for text, toxic in texts:
        for u in units(text):
            count[toxic].update(grams(u))
    endings = {g[k:] for c in count for g in c for k in range(len(g))}
    follows = collections.Counter(g[1:] for g in endings if len(g) > 1)

    def shared(g):
        if not g:
            return 1 / 256
        same = [n for x, n in follows.items() if x[:-1] == g[:-1] and len(x) == len(g)]
        return (max(follows[g] - d, 0) + d * len(same) * shared(g[1:])) / sum(same) if same else shared(g[1:])

    def ratio(g):
        p = []
        for c in count:
            same = [n for x, n in c.items() if x[:-1] == g[:-1]]
            p.append((max(c[g] - d, 0) + d * len(same) * shared(g[1:])) / sum(same) if same else shared(g[1:]))
        return math.log(p[1] / p[0])

    return lambda text: [sum(map(ratio, grams(u))) for u in units(text)]


def test_token_counts_query(spark, small):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    text = {r.doc_id: r.text or "" for r in queries.table(spark, small, "documents").collect()}
    for r in queries.op3_token_counts(spark, small).collect():
        n = len(t.encode(text[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text[r.doc_id].encode()), n, n > 512)


def test_token_pieces_add_up():
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    from linkgrain.llm import tokens

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own = random.Random(8)
    parts = ["a", "B7", "12", " ", "  ", "\n", "\t", "\r\n", "\x0b", "\x1c", "\x85", "\u3000", "\u200b", "!", "'s", "'", "don't", "<|endoftext|>", "é", "漢字", "😀", "٣", "_", "."]
    count = tokens._counter(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["".join(own.choice(parts) for _ in range(own.randint(0, 60))) for _ in range(2000)]
    texts += ["漢字7" * 20_000, "ab1<|endoftext|>2c" * 5_000, "x" * 30_000, " " * 30_000]
    assert count(texts) == [len(t.encode(x, add_special_tokens=False).ids) for x in texts]


def test_toxicity_model(spark):
    from linkgrain.llm import toxicity

    texts = [("You are trash, you trash", 1), ("the trap is TRASH ñandú", 1), ("the train and the trap are here", 0), ("you and 3 thrushes", 0), ("ñandú there", 0), ("", 1)]
    want = kneser_ney(texts)
    learned = spark.createDataFrame(texts, "text string, toxic int")
    ratios = written(toxicity.log_ratios(toxicity.gram_counts(learned, 4), 4), "test-ratios")
    probes = ["trash trapper zzz", "you", "the ñandú is here", "", None, "qqq trash the trash and and trap", "12 !"]
    docs = spark.createDataFrame(list(enumerate(probes)), "doc_id long, text string")
    by_join = {r.doc_id: r for r in toxicity.score_features(docs, ratios, order=4, held_rows=0).collect()}
    held = {r.doc_id: r for r in toxicity.score_features(docs, ratios, order=4).collect()}
    assert by_join == held
    for k, text in enumerate(probes):
        words_ = want(text or "")
        assert abs(held[k].f0 - (sum(words_) / len(words_) if words_ else 0)) < 1e-5
        assert abs(held[k].f1 - (max(words_) if words_ else 0)) < 1e-5
        fours = [sum(words_[a : a + 4]) / 4 for a in range(len(words_))]
        assert abs(held[k].f2 - (max(fours) if fours else 0)) < 1e-5


def test_toxicity_query(spark):
    rows = queries.op4_toxicity(spark, "/root/testdata/sf0.01").join(queries.table(spark, "/root/testdata/sf0.01", "labels").select("doc_id", "toxic"), "doc_id").filter("held_out").collect()
    toxic = [r for r in rows if r.toxic]
    assert sum(r.predicted for r in toxic) >= 0.5 * len(toxic) and sum(r.predicted for r in rows if not r.toxic) <= 0.02 * len(rows)
