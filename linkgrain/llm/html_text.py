"""Operator 5: main text of web pages, with site templates removed.

Every block element of a page has a hash over its tag, class, text and children.
Spark counts in how many different pages of a host each hash lies; subtrees that
recur in many of them are the site's template and are deleted, besides what tags,
roles and class names mark as no part of the article.  Inside an article a text
block that recurs is a quotation or a common line and stays; only named
containers go there.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written

#: A subtree is template from so many different pages of its host on, and from such a part of them.
MIN_PAGES = 5
MIN_SHARE = 0.02

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that part a text into blocks; all others, unknown ones too, stand in a line.
BLOCKS = frozenset("#root html body head title address article aside blockquote button canvas caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr iframe legend li main menu nav noscript object ol optgroup option p plaintext pre search section select summary table tbody td template textarea tfoot th thead tr ul video xmp".split())
INLINE = frozenset("math mi mn mo ms mtext mrow msub msup msubsup mfrac msqrt mroot mover munder munderover mtable mtr mtd semantics annotation picture nobr slot output meter progress ruby rb rtc wbr source blink marquee a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
DROPPED = frozenset("script style noscript template head title iframe object embed svg canvas audio video form button input select textarea nav header footer aside dialog menu".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}}
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
MARKS = re.compile(
    r"ads?|ad(?:vert\w*|box|slot|unit|sense|banner|space)|sponsor\w*|promo\w*|banner|cookies?\w*|consent|gdpr|notices?|alerts?|announcements?|newsletter\w*|subscri\w*|signup|popup|modal|overlay"
    r"|nav|navbar|navigation|menus?|breadcrumbs?|sidebar\w*|sidenav|widgets?|related|recommended|recommendations|share|sharing|social|comments?|commentlist|disqus|respond|replies|footer|masthead|toolbar|topbar|pagination|pager|login|paywall"
)
#: Words that a marked name may have besides: ``related-posts`` is marked, ``related-work`` is not.
PLAIN = frozenset("area article bar block body bottom box btn button buttons col column container content count entry form global group header icon icons inner item items left link links list main media outer page panel placeholder popular post posts primary region right row secondary section site slot stories story text the to top unit us view wrap wrapper x".split())
#: Text blocks; what recurs of them inside an article stays.
TEXTS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr tbody thead tfoot table caption pre blockquote figcaption figure summary hr ol ul dl address".split())
COMMENTS = frozenset("comment comments commentlist commenting commenter disqus respond replies".split())
#: Words that say how comments stand rather than that these are some.
STATES = frozenset("no enabled disabled open opened closed allowed count off on has with without code".split())
_TOKEN = re.compile(r"[a-z]+|[A-Z][a-z]*")


_TAG = re.compile(r"<([a-zA-Z][^\s/>]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*')*+)>")
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTR = re.compile(r"([^\s/>=][^\s/>=]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]*))?")
_COMMENT_END = re.compile(r"--!?>")
#: Elements whose content has no tags; that of ``plaintext`` goes to the end.
RAW = frozenset("script style xmp iframe noembed noframes textarea title plaintext".split())


def _attributes(text: str) -> dict[str, str | None]:
    """Attributes by name, the first of each; values without quotes, references decoded."""
    out: dict[str, str | None] = {}
    for m in _ATTR.finditer(text):
        v = m[2]
        if v and v[0] in "\"'" and v[-1] == v[0] and len(v) > 1:
            v = v[1:-1]
        out.setdefault(m[1].lower(), v if v is None else unescape(v))
    return out


class Page:
    """Elements in page order: tag, attributes, parent, and content of texts and element numbers.

    ``places`` has, by name, where elements of that name are among the open
    ones, so a tag's end is found without a search.  Markup is read in one pass:
    what no ``>`` follows is text, a comment without end takes the rest, and once
    a quote in a tag is never closed, tags end at the next ``>``.
    """

    def __init__(self, html: str):
        self.tags, self.attrs, self.parents, self.content = ["#root"], [{}], [-1], [[]]
        self.inside, self.code = [False], [False]
        self.open = [0]
        self.places: dict[str, list[int]] = {}
        self._read(html)

    def _read(self, html: str) -> None:
        at, last, quotes = 0, html.rfind(">"), True
        while at < len(html):
            begin = html.find("<", at)
            if begin < 0 or begin > last:
                break
            if begin > at:
                self.handle_data(unescape(html[at:begin]))
            sign = html[begin + 1 : begin + 2]
            if "a" <= sign.lower() <= "z":
                m = _TAG.match(html, begin) if quotes else None
                if m is None:
                    quotes = False
                    end = html.find(">", begin)
                    tag = _NAME.match(html, begin)[1].lower()
                    rest = html[begin + 1 + len(tag) : end]
                else:
                    end, tag, rest = m.end() - 1, m[1].lower(), m[2]
                at = end + 1
                (self.handle_startendtag if rest.endswith("/") else self.handle_starttag)(tag, _attributes(rest))
                if tag in RAW and self.tags[self.open[-1]] == tag:
                    close = re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE).search(html, at) if tag != "plaintext" else None
                    to = close.start() if close else len(html)
                    self.handle_data(unescape(html[at:to]) if tag in ("textarea", "title") else html[at:to])
                    at = to
            elif sign == "/" and (m := _NAME.match(html, begin)):
                at = html.find(">", begin) + 1
                self.handle_endtag(m[1].lower())
            elif html.startswith("<!--", begin):
                m = _COMMENT_END.search(html, begin + 2 if html.startswith(("<!-->", "<!--->"), begin) else begin + 4)
                at = m.end() if m else len(html)
            elif sign in ("!", "?", "/"):
                at = html.find(">", begin) + 1
            else:
                self.handle_data("<")
                at = begin + 1
        if at < len(html):
            self.handle_data(unescape(html[at:].partition("<!--")[0]))

    def _last(self, names) -> int:
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=0)

    def _leave(self, names, until=frozenset()) -> bool:
        """Ends the innermost open element of ``names``, and all inside, unless one of ``until`` lies in it."""
        k = self._last(names)
        if not k or k < self._last(until):
            return False
        while len(self.open) > k:
            self.places[self.tags[self.open.pop()]].pop()
        return True

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES_P:
            self._leave({"p"}, {"table", "td", "th", "button", "object", "article", "div", "section", "body"})
        if tag in CLOSES:
            # All of an open cell, row or item that this one ends.
            for _ in range(3):
                if not self._leave(CLOSES[tag], HOLDS[tag]):
                    break
        k = len(self.tags)
        above = self.open[-1]
        self.tags.append(tag)
        self.attrs.append(attrs)
        self.parents.append(above)
        self.content.append([])
        self.inside.append(self.inside[above] or _article(self.tags[above], self.attrs[above]))
        self.code.append(self.code[above] or self.tags[above] in ("pre", "code"))
        self.content[above].append(k)
        if tag not in VOID:
            self.places.setdefault(tag, []).append(len(self.open))
            self.open.append(k)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in ("p", "div", "a", "span", "b", "i", "li"):
            self._leave({tag})

    def handle_endtag(self, tag):
        if tag == "br":
            self.content[self.open[-1]].append(" ")
        elif tag not in VOID:
            self._leave({tag})

    def handle_data(self, data):
        self.content[self.open[-1]].append(data)

    def hashes(self) -> list[int]:
        """Of every element's subtree, its text as it is but for white space."""
        out = [0] * len(self.tags)
        for k in range(len(self.tags) - 1, -1, -1):
            a = self.attrs[k]
            parts = [self.tags[k], a.get("class") or "", a.get("id") or ""]
            parts += [str(out[x]) if isinstance(x, int) else " ".join(x.split()) for x in self.content[k]]
            out[k] = xxhash.xxh64_intdigest("\x1f".join(parts)) - (1 << 63)
        return out

    def marked(self, k: int) -> bool:
        """Whether tag, role, visibility or name say that an element is no part of an article."""
        tag, a = self.tags[k], self.attrs[k]
        names = [frozenset(x.lower() for x in _TOKEN.findall(name)) for v in (a.get("class"), a.get("id")) if v for name in v.split()]
        if self.code[k] and tag in INLINE:
            return False  # a highlighted comment, say
        comments = any(n & COMMENTS and not n & STATES for n in names)
        if tag in ("article", "main", "body", "html"):
            return tag == "article" and comments
        if tag == "header" or tag in ("div", "section") and any("header" in n and n - {"header"} <= PLAIN for n in names):
            # An article's own header has its title.
            return not self.inside[k]
        if tag in DROPPED or a.get("role") in ROLES or "hidden" in a or a.get("aria-hidden") == "true":
            return True
        if comments or any(n - PLAIN and all(map(MARKS.fullmatch, n - PLAIN)) for n in names):
            return True
        if any(name.lower() in ("discussion", "discussions") for name in (a.get("class") or "").split()):
            return True  # as an id it may be a chapter's
        return "display:none" in (a.get("style") or "").replace(" ", "").lower()

    def text(self, template: frozenset | set) -> str:
        """The article's blocks, one a line."""
        n = len(self.tags)
        own = self.hashes() if template else []
        gone = [False] * n
        for k in range(1, n):
            gone[k] = gone[self.parents[k]] or self.marked(k) or bool(template) and own[k] in template and counted(self.tags[k]) and not self._kept(k)
        for names in (("article",), ("main",), ()):
            if names:
                chosen = [self.tags[k] in names or names == ("main",) and self.attrs[k].get("role") == "main" for k in range(n)]
                chosen = [c and not g for c, g in zip(chosen, gone, strict=True)]
                under = [False] * n
                for k in range(1, n):
                    under[k] = under[self.parents[k]] or chosen[self.parents[k]]
                roots = [k for k in range(1, n) if chosen[k] and not under[k]]
            else:
                roots = [0]
            out = "\n".join(x for k in roots for x in self.blocks(k, gone))
            if out or not names:
                return out
        return ""

    def _kept(self, k: int) -> bool:
        """Whether a recurring element stays: text blocks and containers without a name inside an article."""
        return self.inside[k] and (self.tags[k] in TEXTS or not (self.attrs[k].get("class") or self.attrs[k].get("id")))

    def blocks(self, root: int, gone: list[bool]):
        line: list[str] = []
        todo: list = [root]
        while todo:
            x = todo.pop()
            if x is None:
                text = " ".join("".join(line).split())
                line = []
                if text:
                    yield text
            elif isinstance(x, str):
                line.append(x)
            elif self.tags[x] == "br":
                line.append(" ")
            elif not gone[x]:
                block = self.tags[x] in BLOCKS
                if block:
                    todo.append(None)
                todo.extend(reversed(self.content[x]))
                if block:
                    todo.append(None)
        text = " ".join("".join(line).split())
        if text:
            yield text


def _article(tag: str, attrs: dict) -> bool:
    return tag in ("article", "main") or attrs.get("role") == "main"


def counted(tag: str) -> bool:
    """Block elements below the page's frame; single inline elements recur in prose."""
    return tag not in INLINE and tag not in VOID and tag not in ("#root", "html", "head", "body", "article", "main", "script", "style", "title")


def host_of(url) -> Column:
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1), F.lit(""))


def site_templates(pages: DataFrame, *, url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(host, template): the hashes of subtrees in many different pages of the host.

    Equal pages count once.  A host's list has at most the subtrees of an average
    page divided by ``min_share``.
    """
    rows = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html")).filter(F.col("html").isNotNull())

    def run(batches):
        for batch in batches:
            hosts, subtrees, same = [], [], []
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                page = Page(html)
                own = page.hashes()
                found = {own[k] for k in range(len(own)) if counted(page.tags[k])}
                found.discard(0)
                digest = xxhash.xxh64_intdigest(html) - (1 << 63)
                # Hash 0 stands for the page itself.
                for x in (0, *sorted(found)):
                    hosts.append(host)
                    subtrees.append(x)
                    same.append(digest)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(subtrees, pa.int64()), pa.array(same, pa.int64())], ["host", "subtree", "page"])

    seen = rows.mapInArrow(run, "host string, subtree bigint, page bigint")
    counts = seen.distinct().groupBy("host", "subtree").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_pages)
    counts = written(counts, "html-counts")
    whole = counts.filter("subtree = 0").select("host", F.col("n").alias("all"))
    own = counts.filter("subtree <> 0").join(whole, "host").filter(F.col("n") >= min_share * F.col("all"))
    # Written, so that AQE can split the join with a host's very many pages.
    return written(own.groupBy("host").agg(F.sort_array(F.collect_list("subtree")).alias("template")), "html-templates")


def main_texts(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """Per row: page_id, url, text, n_chars.

    The article (else the main element, else the body) without menus, headers,
    footers, sidebars, notices, adverts, forms, scripts, styles, comments and
    its site's template; references decoded, white space inside a block made
    one space, blocks joined by a line feed in page order.

    Readers' comments go whatever their container's name has besides, but for
    names that only say whether there are any.  Markup that ends nowhere is
    read in linear time: an unfinished tag is text, an unfinished comment has no
    end.  A null or empty html gives an empty text; a null url belongs to a host of
    its own without a name; repeated rows each give a row; an empty table an
    empty table; other columns are not read.
    """
    templates = site_templates(pages, url_col=url_col, html_col=html_col, min_pages=min_pages, min_share=min_share)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    rows = rows.join(templates, "host", "left").drop("host")
    schema = T.StructType([rows.schema["page_id"], rows.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        last, template = None, frozenset()
        for batch in batches:
            texts = []
            for html, known in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if known != last:
                    last, template = known, frozenset(known or ())
                texts.append(Page(html).text(template) if html else "")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], schema.names)

    return rows.mapInArrow(run, schema)
