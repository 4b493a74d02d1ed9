"""Repeated ids in archives, markup without ends, readers' comments, and EM to its end."""

import time

import numpy as np
import pytest

from linkgrain.llm import html_text, language, warc

PAGE = "page_id long, url string, html string"


def test_archives_tell_rows_of_one_id_apart(spark):
    rows = [(1, "http://a/", "AAAA"), (2, "http://a/", "AAAA"), (2, "http://b/", "BBBBBB"), (3, "http://b/", "BBBBBB"), (2, "http://c/", None), (4, "http://c/", ""), (None, "http://d/", "AAAA"), (5, None, "x"), (5, None, "x")]
    got = sorted((str(r.page_id), r.payload_bytes, r.record_type, r.refers_to) for r in warc.archived(spark.createDataFrame(rows, PAGE)).collect())
    assert got == sorted([("1", 4, "response", None), ("2", 4, "revisit", 1), ("2", 6, "response", None), ("3", 6, "revisit", 2), ("2", 0, "response", None), ("4", 0, "revisit", 2), ("None", 4, "response", None), ("5", 1, "response", None), ("5", 1, "response", None)])


def test_one_long_page_does_not_make_files_small(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"page {i} " * 40) for i in range(3000)] + [(9999, "http://h/long", "x" * (20 << 20))]
    warc.write_warc(spark.createDataFrame(rows, PAGE).coalesce(2), str(tmp_path / "w"))
    files = list((tmp_path / "w").glob("*.warc.gz"))
    assert len(files) <= 4
    assert sum(1 for f in files for _ in warc.read_records(f.read_bytes())) == 3001


@pytest.mark.parametrize("junk", ["<a ", "a<b", "<!--", "<", "</", "</a", "<!", "<?", '<a b="', "<a b='>", "<p ", "<script", "<script>", "<div>", "<x y=", "&amp", "<![CDATA[", "<title>", "</script", "<plaintext>"])
@pytest.mark.parametrize("end", ["", ">", "-->"])
def test_markup_without_end_is_read_in_linear_time(junk, end):
    html = "<article><p>kept</p>" + junk * ((1 << 20) // len(junk)) + end
    began = time.perf_counter()
    text = html_text.Page(html).text(frozenset())
    assert time.perf_counter() - began < 25 and text.startswith("kept")


def text_of(html):
    return html_text.Page(html).text(frozenset())


def test_unfinished_markup():
    assert text_of("<p>a</p><plaintext>a<b") == "a\na<b"
    assert text_of("<p>one <b>two</b> 3 < 4 & 5 <c") == "one two 3 < 4 & 5 <c"
    assert text_of('<p title="x>y">a</p><p>b</p>') == "a\nb" and text_of('<p title="x>a</p><p>b</p>') == "a\nb"
    assert text_of("a<!-- x -->b<!-->c<!--->d<!-- --!>e<!-- open") == "abcde"
    assert text_of("<SCRIPT>var a = '</p>';</SCRIPT ><P>x&eacute;&#65;&lt</P>") == "xéA<"
    assert text_of("<p id=a class=b/>x</p><br/>y") == "x\ny"


@pytest.mark.parametrize("name", ['class="comment-thread"', 'id="user-comments"', 'class="fb-comments"', 'class="discussion"', 'class="CommentList__root"', 'id="disqus_thread"', 'class="wp-block-comments"', 'class="post-comment-item depth-1"'])
def test_comments_go_by_any_spelling(name):
    assert text_of(f"<article><h1>T</h1><p>body</p><div {name}><p>first!</p></div><p>end</p></article>") == "T\nbody\nend"


@pytest.mark.parametrize("name", ['class="comments-open"', 'class="no-comments"', 'id="discussion"', 'class="commentary"'])
def test_other_names_stay(name):
    assert text_of(f"<article><div {name}><p>body</p></div></article>") == "body"


def test_phrasing_elements_stand_in_a_line():
    assert text_of("<article><p>Use <math><mi>x</mi><mo>+</mo><mn>1</mn></math> here, <nobr>not there</nobr> <picture><source><img></picture>or <my-word>so</my-word>.</p></article>") == "Use x+1 here, not there or so."
    assert text_of('<article><pre><code>a = 1 <span class="comment"># why</span>\n</code></pre></article>') == "a = 1 # why"


def test_em_goes_on_until_nothing_moves():
    rng = np.random.default_rng(1)
    like = (1 + 0.05 * rng.random((400, 4))).astype(np.float32)
    share, _ = language.fitted(like.copy(), np.array([400]), np.ones((1, 4)))
    again = share[0].copy()
    part = like * again
    part /= part.sum(axis=1, keepdims=True)
    assert np.abs(part.mean(axis=0) - again).max() < language.MOVED * 1.01
    rows = np.exp(rng.normal(size=(300, 3))).astype(np.float32)
    got, total = language.fitted(rows.copy(), np.array([100, 200]), np.ones((2, 3)))
    for k, own in enumerate((rows[:100], rows[100:])):
        p = np.ones(3) / 3
        while True:
            q = own * p
            q = (q / q.sum(axis=1, keepdims=True)).mean(axis=0)
            moved, p = np.abs(q - p).max(), q
            if moved < language.MOVED:
                break
        assert np.allclose(got[k], p, atol=1e-5) and np.isclose(total[k], np.log(own @ p).sum(), rtol=1e-4)
