"""Every operator with nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from linkgrain.llm import decontaminate, html_text, language, mix, near, suffix, tokens, topk, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, v double"
rng = random.Random(3)
WORDS = [f"w{k}" for k in range(400)]
LONG = " ".join(rng.choice(WORDS) for _ in range(30_000))
SHORT = " ".join(rng.choice(WORDS) for _ in range(80))


def docs(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "en" if i is None or i % 3 else None, None if i == 2 else f"s{(i or 0) % 2}", 0, "x", 1.0) for i, t in zip(ids, texts, strict=True)], DOCS)


TEXTS = [None, "", "  \n\t ", "one", "one", "ONE two three", SHORT, SHORT, SHORT + " more", LONG, LONG, "###", "é ñ ü", "a  b\r\nc"]


@pytest.fixture
def odd(spark):
    rows = docs(spark, [*TEXTS, SHORT, "tail"], [*range(len(TEXTS)), 7, None])
    return rows


@pytest.fixture
def none(spark):
    return docs(spark, [])


def by_id(rows, column):
    return {r["doc_id"]: r[column] for r in rows.collect()}


def test_suffix(odd, none):
    rows = suffix.repeated_passages(odd)
    got = {(r.doc_id, r.start_word, r.end_word, r.first_doc_id) for r in rows.collect()}
    assert got == {(7, 0, 80, 6), (8, 0, 80, 7), (10, 0, 30_000, 9)}
    left = by_id(suffix.without_passages(odd, rows), "text")
    assert left[10] == "" and left[8] == "more" and left[6] == SHORT and left[0] is None and left[2] == "  \n\t "
    assert suffix.repeated_passages(none).count() == 0 and suffix.without_passages(none, suffix.repeated_passages(none)).count() == 0


def test_near(odd, none):
    rows = near.near_duplicates(odd)
    assert rows.count() == odd.count()
    comp = by_id(rows, "component_id")
    assert comp[4] == 3 and comp[7] == comp[8] == 6 and comp[10] == 9 and comp[0] == 0 and comp[1] == 1 and comp[2] == 2 and comp[None] is None
    size = by_id(rows, "n_shingles")
    assert size[0] == size[1] == size[2] == 0 and size[3] == size[5] == 1 and size[6] == 77
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows.collect() if r.doc_id is not None)
    assert near.near_duplicates(none).count() == 0


def test_tokens(odd, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    special = docs(odd.sparkSession, ["a <|endoftext|> b", "x<|endoftext|>  y \n z ", "   lead", "trail   ", "a b 　 c", "don't  stop\n\n now"])
    rows = odd.unionByName(special.withColumn("doc_id", F.col("doc_id") + 100))
    t = Tokenizer.from_file(path)
    want = {r.doc_id: len(t.encode(r.text or "", add_special_tokens=False).ids) for r in rows.collect()}
    out = tokens.token_counts(rows, path)
    assert by_id(out, "n_tokens") == want
    assert by_id(out, "n_bytes")[12] == len("é ñ ü".encode()) and by_id(out, "over_limit")[9]
    assert tokens.token_counts(none, path).count() == 0


def test_toxicity(spark, odd, none):
    bad = [f"{' '.join(rng.choice(WORDS) for _ in range(30))} nasty {' '.join(rng.choice(WORDS) for _ in range(30))}" for _ in range(150)]
    good = [" ".join(rng.choice(WORDS) for _ in range(60)) for _ in range(450)]
    rows = docs(spark, bad + good, list(range(100, 700))).unionByName(odd)
    labels = spark.createDataFrame([(i, 1, int(i < 250)) for i in range(100, 700)] + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    out = toxicity.toxicity(rows, labels)
    assert out.count() == rows.count()
    got = {r.doc_id: r for r in out.collect()}
    held = [i for i in range(100, 700) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {i for i in got if got[i].held_out} & set(range(100, 700)) == set(held)
    assert sum(got[i].predicted == int(i < 250) for i in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    assert toxicity.toxicity(none, labels).count() == 0
    assert {r.score for r in toxicity.toxicity(odd, labels.limit(0)).collect()} == {0.5}


def test_toxicity_never_reads_held_out_labels(spark):
    rows = docs(spark, [" ".join(rng.choice(WORDS) for _ in range(40)) for _ in range(200)])
    label = lambda flip: spark.createDataFrame([(i, 1, int(i % 5 == 0) ^ int(flip and zlib.crc32(str(i).encode()) % 4 == 2)) for i in range(200)], "doc_id long, quality int, toxic int")
    assert by_id(toxicity.toxicity(rows, label(False)), "score") == by_id(toxicity.toxicity(rows, label(True)), "score")


def test_language(spark, odd, none):
    a = [" ".join(rng.choice(["the", "thing", "then", "that", "other"]) for _ in range(20)) for _ in range(60)]
    b = [" ".join(rng.choice(["für", "schön", "größe", "über", "mäßig"]) for _ in range(20)) for _ in range(60)]
    rows = docs(spark, a + b).withColumn("lang", F.when(F.col("doc_id") < 60, "en").otherwise("de"))
    model = language.learn(rows)
    mixed = docs(spark, [a[0] + " " + b[0], "schön über", None, "", "12 !! %", "— …", "THE THING"])
    out = {r.doc_id: r for r in language.identify(mixed, model).collect()}
    assert [out[k].lang_pred for k in range(7)][1:] == ["de", "und", "und", "und", "und", "en"]
    assert {x.lang for x in out[0].languages} == {"en", "de"} and all(0.3 < x.share < 0.7 for x in out[0].languages)
    assert [x.lang for x in out[1].languages] == ["de"] and out[2].score == 0
    whole = language.predicted_languages(rows)
    assert whole.join(rows.select("doc_id", "lang"), "doc_id").filter("held_out and lang <> lang_pred").count() == 0
    assert language.predicted_languages(odd).count() == odd.count()
    assert language.predicted_languages(none).count() == 0


PAGE = "<html><body><nav>menu {n}</nav><div class='x'>Same box</div><article><h1>T {n} &amp; t</h1><p>First<br>line of {n}<p>Second <i>o</i>ne</article><footer>f</footer></body></html>"


def test_html(spark):
    rows = [(n, f"http://h.example/{n}", PAGE.format(n=n), "x") for n in range(8)] + [(8, None, None, "x"), (9, "u", "", "x"), (10, "http://h.example/z", "<p>no article<script>x()</script><div class='cookie-notice'>n</div><ul><li>a<li>b</ul>", "x"), (0, "http://h.example/0", PAGE.format(n=0), "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_text.main_texts(pages)
    assert got.count() == len(rows) and got.columns == ["page_id", "url", "text", "n_chars"]
    text = {r.page_id: r.text for r in got.collect()}
    assert text[3] == "T 3 & t\nFirst line of 3\nSecond one" and text[8] == text[9] == "" and text[10] == "no article\na\nb"
    assert html_text.main_texts(pages.limit(0)).count() == 0


def test_html_of_any_string():
    parts = ["<![foo[ x ]]>", "<![if x]>", "<![endif]-->", "<!DOCTYPE", "<!--", "-->", "<![CDATA[", "]]>", "<?php", "?>", "<", ">", "</", "<p", "<p>", "</p>", "<div class='ad", "'>", "<article>", "</article>", "<td>", "<table>", "<li>", "<script>", "</script>", "<style>", "<textarea>", "&#xD800;", "&#99999999999;", "&amp", "&", "text", " ", "\n", "\0", "<a href=", '"', "<br/>", "<div/>", "<title>", "<!", "<!>", "<![", "]>"]
    for _ in range(3000):
        page = html_text.Page("".join(rng.choice(parts) for _ in range(rng.randint(1, 25))))
        assert page.text(frozenset()) == page.text(frozenset([1])) and len(page.hashes()) == len(page.tags)
    assert html_text.Page("a<![foo[ x ]]>b").text(frozenset()) == "ab"


@pytest.mark.parametrize("page", ["<div>" * 20_000 + "x" + "</span>" * 20_000, "<header>" * 20_000 + "x", "<article>" * 20_000 + "x", "<p><div>" + "<span>" * 20_000 + "<h1></h1>" * 20_000 + "x", "<table><td><table>" + "<i>" * 20_000 + "<tr>" * 20_000 + "x"])
def test_html_of_deep_pages_is_linear(page):
    import time

    began = time.process_time()
    html_text.Page(page).text(frozenset([1]))
    assert time.process_time() - began < 3


def test_html_keeps_what_recurs_in_articles(spark):
    page = "<body><div class='strip'>Same</div><article><h1>Title {n}</h1><p>The match ended {n} to {m}.</p><p>As ever.</p><table><tr><td>7</td></tr></table><div class='related-work'>Kept</div><div class='related-posts'>Gone</div><div class='house'>Called often</div><div>Own {n}</div></article></body>"
    pages = spark.createDataFrame([(n, f"http://h.example/{n}", page.format(n=n, m=n + 3)) for n in range(10)], "page_id long, url string, html string")
    text = {r.page_id: r.text for r in html_text.main_texts(pages).collect()}
    # Named containers that are the same on every page are the site's.
    assert text == {n: f"Title {n}\nThe match ended {n} to {n + 3}.\nAs ever.\n7\nOwn {n}" for n in range(10)}
    assert html_text.Page(page).text(frozenset()).split("\n")[4:6] == ["Kept", "Called often"]


def test_site_template_outside_articles(spark):
    page = "<body><div>Sponsored by us</div><p>Body text number {w}</p><p>Other text {v}</p></body>"
    word = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta"]
    pages = spark.createDataFrame([(n, f"http://h.example/{n}", page.format(w=word[n], v=word[-n] * 2)) for n in range(7)] + [(7, "http://other.example/", page.format(w="x", v="y"))], "page_id long, url string, html string")
    text = {r.page_id: r.text for r in html_text.main_texts(pages).collect()}
    assert text[2] == "Body text number gamma\nOther text zetazeta" and text[7].startswith("Sponsored by us")


def test_equal_pages_are_no_template(spark):
    pages = spark.createDataFrame([(n, f"http://h.example/{n}", "<body><article><p>whole text</p></article></body>") for n in range(9)], "page_id long, url string, html string")
    assert {r.text for r in html_text.main_texts(pages).collect()} == {"whole text"}


def test_topk(spark):
    data = [(i, [rng.uniform(-1, 1) for _ in range(8)], 0) for i in range(300)] + [(300 + i, [0.5] * 8, 0) for i in range(50)]
    data += [(400, None, 0), (450, [float("nan")] * 8, 0), (500, [None] + [0.1] * 7, 0), (550, [float("inf")] * 8, 0), (600, [0.25, 0.5], 0), (None, [0.1] * 8, 0)]
    v = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")
    got = {}
    for r in topk.search(v).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    import numpy as np

    use = {i: np.floor(np.pad(np.array(x, np.float32).astype(float), (0, 8 - len(x))) * 256).astype(int) for i, x, _ in data if x is not None and i is not None and all(y is not None and np.isfinite(y) for y in x)}
    want = {q: sorted(((int(use[i] @ use[q]), -i) for i in use if i != q), reverse=True)[:5] for q in use if q % 50 == 0}
    assert got == {q: [(-i, s) for s, i in x] for q, x in want.items()} and 600 in got
    assert topk.search(v.filter("vec_id = 50")).count() == 0 and topk.search(v.limit(0)).count() == 0


def test_topk_of_huge_components(spark):
    rows = [(50, [1e12, 1.0]), (1, [1e12, 0.0]), (2, [1e12, 1.0 / 256]), (3, [-1e12, 0.0]), (4, [5.0, 5.0]), (100, [2.0**40, 0.0]), (5, [2.0**30 + 1, 0.0])]
    beyond = spark.createDataFrame([(50, [1e300]), (1, [-1e300]), (2, [1e300])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in topk.search(beyond).orderBy("rank").collect()] == [(2, 2**63 - 1), (1, -(2**63))]
    got = {}
    for r in topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    whole = {i: [int(x * 256) for x in v] for i, v in rows}
    for q in (50, 100):
        want = sorted(((sum(a * b for a, b in zip(whole[q], v, strict=True)), -i) for i, v in whole.items() if i != q), reverse=True)[:5]
        assert got[q] == [(-i, max(min(s, 2**63 - 1), -(2**63))) for s, i in want]


def test_topk_stops_on_proof():
    import numpy as np

    base = np.random.default_rng(0).integers(-20, 20, (4000, 8))
    base[:6] = 200
    block = topk.Block(np.arange(4000), base)
    scores, ids, taken = block.top(np.full(8, 100), 99_999, 5)
    assert ids.tolist() == [0, 1, 2, 3, 4] and taken < len(block.segments)


def waterline(sizes, weights, most=3):
    target, open_ = {}, set(sizes)
    while open_:
        rest = sum(sizes.values()) - sum(target.values())
        total = sum(weights[s] for s in open_)
        over = {s for s in open_ if rest * weights[s] / total > most * sizes[s]}
        if not over:
            return target | {s: rest * weights[s] / total for s in open_}
        target |= {s: most * sizes[s] for s in over}
        open_ -= over
    return target


def test_mix(spark, odd, none):
    texts = [" ".join(["w"] * rng.randint(0, 60)) for _ in range(400)]
    rows = docs(spark, texts).withColumn("source", F.when(F.col("doc_id") < 250, "a").when(F.col("doc_id") < 260, "b").when(F.col("doc_id") < 390, "é"))
    plan = mix.mix_sources(rows, block_rows=7, words_per_shard=1500).cache()
    size = {"a": 0, "b": 0, "é": 0, None: 0}
    for i, t in enumerate(texts):
        size["a" if i < 250 else "b" if i < 260 else "é" if i < 390 else None] += len(t.split())
    want = waterline(size, {"a": 1, "b": 2, "é": 3, None: 1})
    taken = {}
    for r in plan.collect():
        assert abs(r.target - want[r.source]) < 1e-6 and r.taken == sum(p.words for p in r.placements) <= 3 * r.size and r.source_size == size[r.source]
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in want)
    assert sorted(map(str, mix.mix_sources(rows, block_rows=7, words_per_shard=1500).collect())) == sorted(map(str, plan.collect()))
    shards = mix.mixed_rows(plan)
    import math

    assert shards.select("shard").distinct().count() == 1 << math.ceil(math.log2(sum(taken.values()) / 1500)) and shards.agg(F.sum("words")).first()[0] == sum(taken.values())
    assert mix.mix_sources(odd).count() == odd.count() and mix.mix_sources(none).count() == 0
    assert {r.taken for r in mix.mix_sources(docs(spark, ["", None])).collect()} == {0}


def test_splitting_tree_deals_exact_quotas(spark):
    quotas = spark.createDataFrame([("a", 40), ("b", 3), (None, 25)], "_source string, quota bigint")
    rows = mix.split_quotas(quotas, 4, "s").collect()
    assert {r._source: 0 for r in rows}.keys() == {"a", "b", None}
    for source, n in (("a", 40), ("b", 3), (None, 25)):
        spans = sorted((r["first"], r["first"] + r["count"]) for r in rows if r._source == source)
        assert spans[0][0] == 0 and spans[-1][1] == n and all(x[1] == y[0] for x, y in zip(spans, spans[1:], strict=False))
    assert all(sum(r["count"] for r in rows if r.shard == k) == 17 for k in range(4))


def test_hypergeometric_follows_its_distribution(spark):
    import math

    n = 4000
    u = (F.col("id") + 0.5) / n
    got = {r.x: r["count"] / n for r in spark.range(n).select(mix._hypergeometric(F.lit(30), F.lit(12), F.lit(10), u).alias("x")).groupBy("x").count().collect()}
    for k in range(11):
        want = math.comb(12, k) * math.comb(18, 10 - k) / math.comb(30, 10)
        assert abs(got.get(k, 0) - want) < 1e-3


def test_warc(spark, tmp_path):
    big = "<p>" + "z" * (17 << 20)
    rows = [(3, "http://WWW.Example.com:80/a?b", "<p>x\r\n\r\ny</p>", 1), (1, "http://b.example.com/", "<p>x\r\n\r\ny</p>", 1), (2, None, None, 1), (4, "bad\nurl", "", 1), (5, "u", "é", 1), (6, "u", big, 1), (7, "u", "é", 1), (5, "u", "é", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload_bytes int")
    got = warc.archived(pages, path=str(tmp_path / "w")).cache()
    assert got.count() == len(rows) and got.filter("not sound").count() == 0
    by = {r.page_id: r for r in got.collect()}
    assert (by[3].record_type, by[3].refers_to, by[1].record_type) == ("revisit", 1, "response") and by[4].refers_to == 2 and by[7].refers_to == 5 and by[5].record_type == "response"
    import base64

    for i, _, html, _ in rows:
        raw = (html or "").encode()
        assert by[i].payload_bytes == len(raw) and by[i].payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()
    headers, payload = warc.read_range(spark, by[6].file, by[6].offset, by[6].length)
    assert payload == big.encode() and headers["WARC-Target-URI"] == "u"
    warc.write_index(got, str(tmp_path / "i"), block_captures=2)
    assert [(x["page_id"], x["key"]) for x in warc.lookup(spark, str(tmp_path / "i"), "http://www.example.com/a?b")] == [("3", "com,example)/a?b")]
    assert sorted(x["page_id"] for x in warc.lookup(spark, str(tmp_path / "i"), "u")) == ["5", "5", "6", "7"]
    assert warc.lookup(spark, str(tmp_path / "i"), "http://none.example/") == []
    apart = warc.archived(pages, min_bytes=1, path=str(tmp_path / "m"))
    assert {r.page_id: r.record_type for r in apart.collect()}[4] == "response"
    assert warc.archived(pages.limit(0), path=str(tmp_path / "n")).count() == 0


def test_decontaminate(spark, odd, none):
    items = [" ".join(rng.choice(WORDS) for _ in range(n)) for n in (50, 20, 8, 3, 300)]
    bench = spark.createDataFrame([*enumerate(items), (9, None), (10, " ")], "item_id long, text string")
    w = items[0].split()
    one_off = " ".join([*w[:49], "zzz"])
    texts = [items[0].upper() + " tail", "head " * 40 + items[1], items[2], items[3], "head\n" + items[4].replace(" ", "\n") + " x", one_off, " ".join(w[:30]), " ".join(reversed(w)), *TEXTS]
    rows = docs(spark, [*texts, items[1]], [*range(len(texts)), 1])
    got = {(r.doc_id, r.item_id): round(r.similarity, 3) for r in decontaminate.contaminated(rows, bench).collect()}
    assert set(got) == {(0, 0), (1, 1), (2, 2), (3, 3), (4, 4), (5, 0)} and got[5, 0] == round(45 / 47, 3)
    assert decontaminate.contaminated(rows, bench.limit(0)).count() == 0 and decontaminate.contaminated(none, bench).count() == 0


@pytest.mark.parametrize("at_once", [1, 2, 5])
def test_decontaminate_in_passes_equals_at_once(spark, monkeypatch, at_once):
    shared = [rng.choice(WORDS) for _ in range(14)]
    items = [" ".join(rng.choice(WORDS) for _ in range(12)) for _ in range(5)] + [" ".join([*shared, *(rng.choice(WORDS) for _ in range(10))]) for _ in range(4)]
    bench = spark.createDataFrame([*enumerate(items), (20, items[6])], "item_id long, text string")
    texts = [f"x {t} y" for t in items] + [" ".join([*t.split()[:-1], "other"]) for t in items] + [" ".join(["other", *t.split()[2:]]) for t in items]
    rows = docs(spark, texts)
    want = sorted(map(tuple, decontaminate.contaminated(rows, bench).collect()))
    monkeypatch.setattr(decontaminate, "ITEMS_AT_ONCE", at_once)
    assert sorted(map(tuple, decontaminate.contaminated(rows, bench).collect())) == want and len({x[2] for x in want}) > 2


def test_fingerprints_of_similar_windows_lie_within_the_radius():
    """Items of many sizes with as many words changed as similarity 0.8 bears."""
    import numpy as np

    own = np.random.default_rng(5)
    seen = lost = 0
    for n in (13, 17, 20, 25, 30, 40, 50, 80, 150, 300):
        for _ in range(300):
            item = own.integers(1, 1 << 63, n, dtype=np.uint64)
            other = item.copy()
            while True:
                k, m = own.integers(0, n), own.integers(1, max(2, n // 10))
                trial = other.copy()
                trial[k : k + m] = own.integers(1, 1 << 63, len(trial[k : k + m]), dtype=np.uint64)
                a, b = decontaminate.item_shingles(item), decontaminate.item_shingles(trial)
                both = len(np.intersect1d(a, b))
                if both < 0.8 * (len(a) + len(b) - both):
                    break
                other = trial
            seen += 1
            lost += np.bitwise_count(decontaminate.fingerprint(item) ^ decontaminate.fingerprint(other)) > decontaminate.RADIUS
    assert seen == 3000 and lost == 0


def test_warc_reads_back_through_the_index(spark, tmp_path, monkeypatch):
    urls = ["http://www.b.example/x", "http://b.example/x", "a\tb", "a\nb", None, "http://a.example/", "http://c.example/?q=1", "http://℀.example/"]
    pages = spark.createDataFrame([(n, urls[n % len(urls)], f"<p>{n % 30}") for n in range(64)], "page_id long, url string, html string")
    got = {tuple(r) for r in warc.archived(pages, path=str(tmp_path / "w")).drop("payload_bytes").collect()}
    blocks = spark.read.parquet(str(tmp_path / "w-index" / "blocks"))
    assert blocks.agg(F.sum("n")).first()[0] == len(got) == 64
    records = warc.read_warc(spark, str(tmp_path / "w"), pages.schema["page_id"].dataType)
    warc.write_index(records, str(tmp_path / "i"), block_captures=3)
    few = pages.filter("page_id in (0, 2, 3)").select("url")
    back = lambda: sorted(r.page_id for r in warc.through_index(few, str(tmp_path / "i"), str(tmp_path / "w"), pages.schema["page_id"].dataType).collect())
    want = [n for n in range(64) if n % 8 in (0, 1, 2, 3)]
    assert back() == want
    monkeypatch.setattr(warc, "_ranged", lambda file: False)
    assert back() == want


def test_near_sets_of_exactly_the_sketch(spark):
    texts = []
    for k in range(60):
        own = [f"v{k}x{n}" for n in range(43)]
        texts += [" ".join(own[:35]), " ".join(own[: 42 + k % 2])]  # 32 shingles, and 39 or 40 that hold them
    out = {r.doc_id: r for r in near.near_duplicates(docs(spark, texts)).collect()}
    assert {out[k].n_shingles for k in range(4)} == {32, 39, 40}
    assert [k for k in range(60) if out[2 * k + 1].component_id != 2 * k] == []


def test_toxicity_counts_all_but_the_calibration_rows(spark):
    crc = lambda x: zlib.crc32(x.encode()) % 4
    seen = [i for i in range(2000) if crc(str(i)) != 2]
    # An expression that stands only in the texts of one quarter.
    vile = {i for i in seen if crc(f"tune:{i}") == 0}
    probe = [i for i in range(2000) if crc(str(i)) == 2][:2]
    text = {i: "plain words " + ("venom" if i in vile else "water") for i in seen} | {probe[0]: "plain words venom", probe[1]: "plain words unseen"}
    rows = docs(spark, list(text.values()), list(text))
    labels = spark.createDataFrame([(i, int(i in vile)) for i in text], "doc_id long, toxic int")
    got = by_id(toxicity.toxicity(rows, labels, calibration_rows=20), "log_ratio")
    assert got[probe[0]] > got[probe[1]] + 0.5


def test_suffix_meets_all_that_share_a_passage(spark):
    own = random.Random(11)
    fresh = lambda n: [f"u{own.randrange(10**9)}" for _ in range(n)]
    texts, want = [], {}
    for _ in range(15):
        line, k = fresh(40), len(texts)
        passage = [*fresh(5), *line, *fresh(5)]
        # The first document has the line alone.
        texts += [[*fresh(30), *line, *fresh(30)], [*fresh(30), *passage, *fresh(30)], [*fresh(9), *passage, *fresh(9)]]
        want[k + 2] = set(range(9, 59))
    for _ in range(5):
        line, k = fresh(40), len(texts)
        passage = [*fresh(5), *line, *fresh(5)]
        # The first document has the line twice, and only its second place agrees.
        texts += [[*fresh(30), *line, *fresh(30), *passage, *fresh(9)], [*fresh(9), *passage, *fresh(9)]]
        want[k + 1] = set(range(9, 59))
    texts += [fresh(40)] * 3  # too short for a passage
    got = {}
    for r in suffix.repeated_passages(docs(spark, [" ".join(x) for x in texts])).collect():
        got.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    assert got == want


def mosaic():
    """20 documents that share a passage of 60 words after two that hold parts of it too short to count."""
    own = random.Random(12)
    fresh = lambda n: [f"u{own.randrange(10**9)}" for _ in range(n)]
    passage = fresh(60)
    texts = [[*fresh(20), *passage[:45], *fresh(20)], [*fresh(20), *passage[15:], *fresh(20)]]
    texts += [[*fresh(10 + k), *passage, *fresh(20)] for k in range(20)]
    return [" ".join(x) for x in texts], {k: set(range(8 + k, 68 + k)) for k in range(3, 22)}


@pytest.mark.parametrize("hot", [20_000, 3])
def test_suffix_of_a_mosaic(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix, "HOT", hot)
    texts, want = mosaic()
    got = {}
    for r in suffix.repeated_passages(docs(spark, texts)).collect():
        got.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    assert got == want


def test_suffix_of_repeated_ids_and_clashing_names(spark):
    a, b = (" ".join(f"{x}{n}" for n in range(70)) for x in "ab")
    rows = spark.createDataFrame([(1, a, 0, 0), (1, b, 1, 1), (2, "x " + b, 2, 2), (2, "no more", 3, 3)], "doc_id long, text string, _id int, _spans int")
    passages = suffix.repeated_passages(rows)
    assert [(r.doc_id, r.start_word, r.end_word, r.first_doc_id) for r in passages.collect()] == [(2, 1, 71, 1)]
    out = suffix.without_passages(rows, passages)
    assert out.columns == rows.columns and sorted(r.text for r in out.collect()) == sorted([a, b, "x ", "no more"])


@pytest.mark.parametrize("hot", [20_000, 5])
def test_suffix_neighbours_in_batches(hot):
    import numpy as np
    import pyarrow as pa

    from linkgrain.llm.common import text_chunks

    texts, _ = mosaic()
    texts += ["again " * 300, "again " * 90 + SHORT, SHORT + " " + SHORT]
    rows = []
    for k, text in enumerate(texts):
        for _, _, w in text_chunks(pa.array([text])):
            _, at, context, span = suffix.places(w, 50)
            words = suffix.around(w.hashes, at, 50)
            rows += [((c, 0, k, 0, p, s, 9), x) for c, p, s, x in zip(context.tolist(), at.tolist(), span.tolist(), words, strict=True)]
    rows.sort(key=lambda r: r[0])
    keys, words = np.array([k for k, _ in rows]), np.stack([w for _, w in rows])

    def result(size):
        look, out = suffix.Neighbours(50, hot), (set(), set())
        for k, w, begin in suffix.whole_runs(((keys[a : a + size], words[a : a + size]) for a in range(0, len(keys), size)), hot):
            for have, columns in zip(out, look.found(k, w, begin), strict=True):
                have.update(zip(*(c.tolist() for c in columns), strict=True))
        return out

    whole = result(len(keys))
    for size in (1, 2, 7, 64):
        passages, windows = result(size)
        assert passages == whole[0]
        # Slices of long runs leave more windows open, never fewer.
        assert windows >= whole[1] if hot == 5 else windows == whole[1]


def test_warc_files_are_bounded_and_plain(spark, tmp_path, monkeypatch):
    import gzip
    import os

    monkeypatch.setattr(warc, "FILE_BYTES", 1 << 20)
    own = random.Random(4)
    pages = spark.createDataFrame([(n, f"http://h.example/{n}", "<p>" + own.randbytes(150_000).hex()) for n in range(30)], "page_id long, url string, html string").coalesce(1)
    path = tmp_path / "w"
    got = warc.archived(pages, path=str(path))
    assert got.count() == 30 and got.filter("not sound").count() == 0
    files = [f for f in os.listdir(path) if f.startswith("part-")]
    assert len(files) > 5 and all(f.endswith(".warc.gz") for f in files)
    text = b"".join(gzip.decompress((path / f).read_bytes()) for f in files)
    assert text.count(b"WARC/1.1\r\n") == 30
    big = spark.createDataFrame([(1, "http://a.example/", "z" * (17 << 20)), (2, "http://b.example/", "y")], "page_id long, url string, html string").coalesce(1)
    warc.write_warc(big, str(tmp_path / "b"))
    text = b"".join(gzip.decompress((tmp_path / "b" / f).read_bytes()) for f in os.listdir(tmp_path / "b") if f.startswith("part-"))
    assert text.count(b"WARC/1.1\r\n") == 2


def test_near_sketches_lose_few_links():
    import math

    shared = sum(math.comb(near.SKETCH, k) * 0.8**k * 0.2 ** (near.SKETCH - k) for k in range(near.SHARED))
    assert shared < 1e-6
    import numpy as np

    own, least = np.random.default_rng(6), near.SKETCH
    for _ in range(3000):
        n = int(own.integers(50, 1200))
        values = own.integers(0, 1 << 63, n, dtype=np.int64)
        k = n // 10  # two sets of similarity 0.8 or a little more
        a, b = np.sort(values[k:]), np.sort(values[: n - k])
        union = np.sort(values)[: near.SKETCH]
        least = min(least, len(np.intersect1d(np.intersect1d(a[: near.SKETCH], b[: near.SKETCH]), union)))
    assert least >= near.SHARED


def test_near_rows_of_one_id(spark):
    a, b, c = (" ".join(f"{x}{n}" for n in range(60)) for x in "abc")
    out = near.near_duplicates(docs(spark, [a, b, a + " x", b + " y", c, c], [5, 5, 7, 8, 9, 9])).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in out) == [(5, 5, True), (5, 5, True), (7, 5, False), (8, 5, False), (9, 9, True), (9, 9, True)]
