"""Behaviour boundaries: what they are, how they changed, whether they are traced, and the marker that each would take.

Boundaries: path, name (qualified), kind, language, s, e, and ``traced_by``, the
id of the marker that is attached to it, or null.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.ids import ID_PATTERN, slug, type_of
from ..scratch import kept
from .extract import symbols as read_symbols
from .structure import BUCKET, _buckets, boundary_changes

# How a comment begins, by language; JSON takes markers in sidecar files.
COMMENTS = {"python": "#", "yaml": "#", "toml": "#", "go": "//", "rust": "//", "java": "//", "typescript": "//", "javascript": "//", "markdown": "<!--"}
# Line beginnings that may stand between a marker and what it is attached to.
GAPS = {"python": ("#", "@"), "yaml": ("#",), "toml": ("#",), "markdown": ("<!--",)} | dict.fromkeys(("go", "rust", "java", "typescript", "javascript"), ("//", "/*", "*"))
MAX_GAP = 3
MAX_BELOW = 6
CODE = ("function", "method", "class", "constructor", "struct", "enum", "interface", "trait", "impl", "type_alias")
REASON = r"reason=\s*\S"


def boundaries(symbols: DataFrame) -> DataFrame:
    """Code symbols, Markdown headings and top-level configuration keys among ``symbols`` (of ``extract.symbols``)."""
    top = (F.col("kind") == "key") & ~F.col("name").contains(".")
    return symbols.filter(F.col("kind").isin(*CODE, "heading") | top).select("path", "name", "kind", "s", "e", F.col("hash").alias("fingerprint"))


def numbered_lines(files: DataFrame) -> DataFrame:
    """(path, line, text) of ``files`` (path, text)."""
    return files.select("path", F.posexplode(tx.lines(F.col("text"))).alias("n", "text")).select("path", (F.col("n") + 1).alias("line"), "text")


def of_files(files: DataFrame, asked: bool = False) -> DataFrame:
    """Boundaries of ``files`` (path, language, text): path, language, name, kind, s, e, fingerprint.

    If ``asked``, also what the lines near each say (``_told``): the parsers give
    these lines of code and headings with the boundary, so no text is dealt out.

    Code and headings come from the parsers, with the fingerprint of their lines.
    YAML and TOML have the keys that are indented like the first one, JSON its
    top-level keys, each with its line.
    """
    below = lambda language: (-MAX_GAP, MAX_BELOW if language == "markdown" else 0)
    none = lambda language: (0, -1)
    parsed = read_symbols(files.filter(~F.coalesce("language", F.lit("")).isin("yaml", "toml", "json")), below if asked else none).filter(F.col("kind").isin(*CODE, "heading"))
    parsed = parsed.filter("path is not null").withColumn("fingerprint", F.col("block"))
    plain = files.filter(F.col("language").isin("yaml", "toml"))
    rows = numbered_lines(plain).withColumn("t", F.trim("text")).filter(F.col("t").rlike("[:=]") & ~F.col("t").rlike(r"^(?:#|//|\[|---)"))
    rows = rows.withColumn("indent", F.length("text") - F.length(F.ltrim("text")))
    first = rows.groupBy("path").agg(F.min_by("indent", "line").alias("first"))
    rows = rows.join(first, "path").filter("indent <= first").join(plain.select("path", "language"), "path")
    key = F.regexp_replace(F.trim(F.regexp_extract("t", "^([^:=]*)", 1)), "^[\"']+|[\"']+$", "")
    keys = rows.select("path", "language", key.alias("name"), F.lit("key").alias("kind"), F.col("line").alias("s"), F.col("line").alias("e"), tx.fingerprint(F.col("text")).alias("fingerprint"))
    json = files.filter("language = 'json'").select("path", "language", "text", F.explode(F.json_object_keys("text")).alias("name"))
    before = F.expr("substring(text, 1, locate(concat('\"', name, '\"'), text) - 1)")
    line = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1
    json = json.withColumn("s", line.cast("int")).withColumn("own", F.get(tx.lines(F.col("text")), F.col("s") - 1))
    json = json.select("path", "language", "name", F.lit("key").alias("kind"), "s", F.col("s").alias("e"), tx.fingerprint(F.col("own")).alias("fingerprint"))
    keys = keys.unionByName(json)
    columns = ["path", "language", "name", "kind", "s", "e", "fingerprint"]
    if not asked:
        return parsed.select(columns).unionByName(keys)
    parsed = parsed.withColumn("window", F.map_from_arrays(F.sequence(F.lit(-MAX_GAP), F.size("near") - MAX_GAP - 1), F.col("near")))
    keys = windowed(keys, numbered_lines(files.filter(F.col("language").isin("yaml", "toml", "json"))))
    return _told(parsed.select(*columns, "window").unionByName(keys.select(*columns, "window")))


def _told(bounds: DataFrame) -> DataFrame:
    """Windowed ``bounds`` with what their lines say in place of these: ``own``, whether they are traced by themselves, ``target``, the id that they ask to inherit from, and ``marker``, the id attached to them."""
    first = F.regexp_extract("name", r"^(\S+)", 1)
    is_node = (F.col("language") == "markdown") & first.rlike(ID_PATTERN) & type_of(first).isNotNull()
    return bounds.withColumns({"own": F.coalesce(_attached() | _exempted() | is_node, F.lit(False)), "target": _asked_parent(), "marker": attached_id()}).drop("window")


def _at(offset: int) -> Column:
    """The line ``offset`` lines from a boundary's first, empty beyond the file."""
    return F.coalesce(F.element_at("window", F.lit(offset)), F.lit(""))


def windowed(bounds: DataFrame, lines: DataFrame) -> DataFrame:
    """``bounds`` with ``window``: the lines near their first by offset, those that markers and directives can stand on."""
    asked = bounds.select("path", "name", "s", F.explode(F.sequence(F.lit(-MAX_GAP), F.lit(MAX_BELOW))).alias("offset")).distinct()
    met = asked.withColumn("line", F.col("s") + F.col("offset")).join(lines.select("path", "line", "text"), ["path", "line"])
    near = met.groupBy("path", "name", "s").agg(F.map_from_entries(F.collect_list(F.struct("offset", "text"))).alias("window"))
    return bounds.join(near, ["path", "name", "s"], "left").withColumn("window", F.coalesce("window", F.expr("cast(map() as map<int, string>)")))


def _free(offset: int) -> Column:
    """Whether a line may stand between a marker and its boundary."""
    t = F.trim(_at(offset))
    starts = F.lit(False)
    for prefixes in dict.fromkeys(GAPS.values()):
        own = F.col("language").isin(*[k for k, v in GAPS.items() if v == prefixes])
        starts = starts | (own & t.rlike("^(?:" + "|".join(map(re.escape, prefixes)) + ")"))
    return (t == "") | starts


def _marked(offset: int) -> Column:
    return _at(offset).contains(tx.MARKER)


def attached_id() -> Column:
    """The id of the marker attached to a windowed boundary: above code and keys with a free gap, in the six lines below a heading."""
    own = F.lit(None).cast("string")
    for offset in reversed(range(-MAX_GAP, 1)):  # the first line counts, so it is asked last
        free = F.lit(True)
        for k in range(offset + 1, 0):
            free = free & _free(k)
        found = F.nullif(F.regexp_extract(_at(offset), r"id=([A-Za-z0-9._:/\-]+)", 1), F.lit(""))
        own = F.when(_marked(offset) & free & found.isNotNull(), found).otherwise(own)
    below = F.coalesce(*[F.when(_marked(k), F.nullif(F.regexp_extract(_at(k), r"id=([A-Za-z0-9._:/\-]+)", 1), F.lit(""))) for k in range(1, 7)])
    return F.when(F.col("language") == "markdown", below).otherwise(own)


def _attached() -> Column:
    """Whether any marker is attached: as ``attached_id`` asks, but directly below or above a heading, or below one blank line."""
    near = F.lit(False)
    for offset in range(-MAX_GAP, 1):
        free = F.lit(True)
        for k in range(offset + 1, 0):
            free = free & _free(k)
        near = near | (_marked(offset) & free)
    heading = _marked(1) | _marked(-1) | (_marked(2) & (F.trim(_at(1)) == ""))
    key = F.col("language").isin("yaml", "toml") & (_marked(-1) | _marked(0))
    return F.when(F.col("language") == "markdown", heading).otherwise(near | key)


def _exempted() -> Column:
    opened = F.concat(_opener(F.col("language")), F.lit(" trace:exempt reason="))
    says = lambda k: _at(k).contains(opened) & _at(k).rlike(r"^(?:(?!reason=).)*reason=\s*\S")
    return F.coalesce(says(-1) | says(0), F.lit(False))


def _asked_parent() -> Column:
    """The id that a directive line of a boundary asks to inherit from; the first such line counts."""
    target = lambda k: F.when(_at(k).contains(_opener(F.col("language"))) & _at(k).contains("reason="), F.nullif(F.regexp_extract(_at(k), r"trace:inherit\s+([A-Za-z0-9._:/\-]+)", 1), F.lit("")))
    return F.coalesce(target(-1), target(0))


def untraced_changes(now: DataFrame, before: DataFrame, nodes: DataFrame, sidecars: DataFrame | None = None) -> DataFrame:
    """(path, name, kind, line, state, changed, traced) of the boundaries of ``now`` (path, language, text).

    ``state`` is new, modified or unchanged against ``before``, by qualified name
    and the fingerprint of the boundary's lines; of several there with one name
    the last counts, and a heading with a name that was there is unchanged.  Only
    changed boundaries are asked whether they are traced: by a marker attached
    to them, an exemption with a reason, a heading that is a node, a sidecar
    entry, or inheritance from the marker on the narrowest boundary around them.
    Both texts are read once; ``nodes`` only if a boundary asks to inherit.
    """
    then = of_files(before).groupBy("path", "name").agg(F.max_by("fingerprint", F.struct("s", "e")).alias("fingerprint"))
    rows = kept(boundary_changes(of_files(now, asked=True), then), "boundaries")
    altered = rows.filter("state <> 'unchanged'")
    asked = altered.filter("target is not null and not own")
    inherited = None if asked.isEmpty() else _inherited(rows, asked, nodes)
    out = altered.withColumn("inherits", F.lit(False)) if inherited is None else altered.join(inherited, ["path", "name", "s"], "left")
    if sidecars is not None:
        out = out.join(in_sidecars(altered.filter("language = 'json'"), sidecars).distinct().withColumn("beside", F.lit(True)), ["path", "name", "s"], "left")
    traced = F.col("own") | F.coalesce("inherits", F.lit(False)) | (F.coalesce("beside", F.lit(False)) if sidecars is not None else F.lit(False))
    changed = out.select("path", "name", "kind", F.col("s").alias("line"), F.lit(True).alias("changed"), traced.alias("traced"))
    return changed.unionByName(rows.filter("state = 'unchanged'").select("path", "name", "kind", F.col("s").alias("line"), F.lit(False).alias("changed"), F.lit(None).cast("boolean").alias("traced")))


def _inherited(present: DataFrame, asked: DataFrame, nodes: DataFrame) -> DataFrame:
    """(path, name, s, inherits) of the boundaries ``asked`` whose target is an active node of their file and the marker on the narrowest of ``present`` around them."""
    wanted = asked.select("path", "target").distinct()
    there = nodes.filter("active").select("path", F.col("trace_id").alias("target")).join(wanted, ["path", "target"], "left_semi")
    asked = asked.join(there, ["path", "target"], "left_semi")
    parents = enclosing(present.join(asked.select("path").distinct(), "path", "left_semi").withColumn("traced_by", F.col("kind")))
    parents = asked.join(parents.select("path", "name", "s", "parent", "os", "oe"), ["path", "name", "s"])
    around = present.select("path", F.col("name").alias("parent"), F.col("s").alias("os"), F.col("marker").alias("target"))
    return parents.join(around, ["path", "parent", "os", "target"], "left_semi").select("path", "name", "s", F.lit(True).alias("inherits")).distinct()


def _opener(language: Column) -> Column:
    return F.coalesce(*[F.when(language == k, v) for k, v in COMMENTS.items()])


def _directives(lines: DataFrame, marked: DataFrame, word: str) -> DataFrame:
    """Boundaries with each directive line that is theirs: the line above their first or that line itself."""
    near = marked.select("path", "name", "s", "language", F.explode(F.array(F.col("s") - 1, F.col("s"))).alias("line"))
    hit = near.join(lines.filter(F.col("text").contains(word)).select("path", "line", "text").distinct(), ["path", "line"])
    return hit.filter(F.col("text").contains(_opener(F.col("language")))).select("path", "name", "s", "line", "text")


def exempt(marked: DataFrame, lines: DataFrame) -> DataFrame:
    """(path, name, s) of boundaries with an exemption that gives a reason; ``lines``: path, line, text."""
    opened = F.concat(_opener(F.col("language")), F.lit(" trace:exempt reason="))
    near = _directives(lines, marked, "trace:exempt").join(marked.select("path", "name", "s", "language"), ["path", "name", "s"])
    return near.filter(F.col("text").contains(opened) & F.col("text").rlike(REASON)).select("path", "name", "s").distinct()


def enclosing(marked: DataFrame) -> DataFrame:
    """(path, name, s, parent, traced_by): the narrowest other boundary around each, ties to the earlier start, then the name.

    Boundaries of the same lines have another of them for parent; else the first
    of the narrowest lines around, which are looked for once for all of them.
    """
    named = marked.filter("s <= e").groupBy("path", "s", "e", "name").agg(F.min("traced_by").alias("traced_by"))
    same = kept(named.groupBy("path", "s", "e").agg(F.slice(F.array_sort(F.collect_list(F.struct(F.col("name").alias("parent"), "traced_by"))), 1, 2).alias("first")), "boundaries")
    outer = same.select("path", F.col("s").alias("os"), F.col("e").alias("oe"), _buckets(F.col("s"), F.col("e")).alias("b"))
    inner = same.select("path", "s", "e", F.floor(F.col("s") / BUCKET).cast("int").alias("b"))
    hit = inner.join(outer, ["path", "b"]).filter("os <= s and oe >= e and (os < s or oe > e)")
    # Width, then start, as one number.
    rank = (F.col("oe").cast("long") - F.col("os")) * (1 << 32) + F.col("os") + (1 << 31)
    around = hit.groupBy("path", "s", "e").agg(F.min(rank).alias("k")).withColumn("os", (F.pmod("k", F.lit(1 << 32)) - (1 << 31)).cast("int"))
    around = around.withColumn("oe", (F.col("os") + F.floor(F.col("k") / F.lit(1 << 32))).cast("int"))
    around = around.join(same.select("path", F.col("s").alias("os"), F.col("e").alias("oe"), F.col("first")[0].alias("next")), ["path", "os", "oe"]).select("path", "s", "e", "os", "oe", "next")
    rows = marked.select("path", "name", "s", "e").join(same.join(around, ["path", "s", "e"], "left"), ["path", "s", "e"])
    own = F.get(F.filter("first", lambda x: x["parent"] != F.col("name")), F.lit(0))
    out = lambda x, s, e: F.when(x.isNotNull(), F.struct((e - s).alias("width"), s.alias("os"), x["parent"].alias("parent"), x["traced_by"].alias("traced_by"), e.alias("oe")))
    rows = rows.withColumn("m", F.coalesce(out(own, F.col("s"), F.col("e")), out(F.col("next"), F.col("os"), F.col("oe")))).filter("m is not null")
    return rows.groupBy("path", "name", "s").agg(F.min("m").alias("m")).select("path", "name", "s", "m.parent", "m.traced_by", "m.os", "m.oe")


def inheriting(marked: DataFrame, lines: DataFrame, nodes: DataFrame) -> DataFrame:
    """(path, name, s) of boundaries that inherit, with a reason, from an active node of their file whose marker is on their narrowest enclosing boundary."""
    asked = _directives(lines, marked, "trace:inherit").filter(F.col("text").contains("reason="))
    asked = asked.withColumn("target", F.regexp_extract("text", r"trace:inherit\s+([A-Za-z0-9._:/\-]+)", 1)).filter("target <> ''")
    # The first directive line counts.
    asked = asked.groupBy("path", "name", "s").agg(F.min_by("target", "line").alias("target"))
    there = nodes.filter("active").select("path", F.col("trace_id").alias("target"))
    return asked.join(there, ["path", "target"], "left_semi").join(enclosing(marked), ["path", "name", "s"]).filter("target = traced_by").select("path", "name", "s")


def accounted(marked: DataFrame, lines: DataFrame, nodes: DataFrame, sidecars: DataFrame | None = None) -> DataFrame:
    """``marked`` with ``account``: traced, exempt, inherited, sidecar or null."""
    keys = ["path", "name", "s"]
    flag = lambda df, name: df.select(*keys, F.lit(True).alias(name)).distinct()
    rows = marked.join(flag(exempt(marked, lines), "_x"), keys, "left").join(flag(inheriting(marked, lines, nodes), "_i"), keys, "left")
    rows = rows.join(flag(in_sidecars(marked, sidecars), "_c"), keys, "left") if sidecars is not None else rows.withColumn("_c", F.lit(None).cast("boolean"))
    how = F.when(F.col("traced_by").isNotNull(), "traced").when(F.col("_x"), "exempt").when(F.col("_i"), "inherited").when(F.col("_c"), "sidecar")
    return rows.withColumn("account", how).drop("_x", "_i", "_c")


def in_sidecars(marked: DataFrame, sidecars: DataFrame) -> DataFrame:
    """(path, name, s) of boundaries that a sidecar entry (path, key, line) names within a line of their first."""
    near = sidecars.select("path", F.col("key").alias("name"), F.explode(F.sequence((F.col("line") - 1).cast("int"), (F.col("line") + 1).cast("int"))).alias("s"))
    return marked.select("path", "name", "s").join(near, ["path", "name", "s"], "left_semi")


def role(path: Column, name: Column, kind: Column, language: Column) -> Column:
    """What a boundary would be: impl, test, doc, ops, requirement, decision or plan."""
    prefix = F.upper(F.split_part(F.split_part(name, F.lit(" "), F.lit(1)), F.lit("-"), F.lit(1)))
    is_test = F.exists(F.split(path, "/"), lambda p: p.isin("tests", "test") | p.startswith("test_") | p.endswith("_test")) | path.rlike(r"(^|/)(test_|.*_test\.)")
    doc = F.when(prefix.isin("REQ", "PRD"), "requirement").when(prefix.isin("ADR", "DEC"), "decision").when(prefix == "PLAN", "plan").otherwise("doc")
    return F.when(language == "markdown", doc).when(language.isin("yaml", "toml", "json"), "ops").when(kind.isin(*CODE) & is_test, "test").otherwise("impl")


def suggested(marked: DataFrame, taken: DataFrame, *, work: str | None = None, requirement: str | None = None, plan: str | None = None, exercised: str | None = None) -> DataFrame:
    """(path, name, s, role, trace_id, marker): the marker that fits each boundary; an id that ``taken`` (trace_id) has, or an earlier boundary, gets a number."""
    what = role(F.col("path"), F.col("name"), F.col("kind"), F.col("language"))
    last = F.element_at(F.split("name", r"\."), -1)
    owner = F.expr("substring(name, 1, greatest(0, length(name) - length(element_at(split(name, '[.]'), -1)) - 1))")
    base = F.concat(F.col("role"), F.when(owner != "", F.concat(F.lit("."), _slug(owner))).otherwise(F.lit("")), F.lit("."), _slug(last))
    rows = marked.select("path", "name", "s", "language", what.alias("role")).withColumn("base", base)
    from ..functions.ids import fresh_ids

    order = F.concat_ws("\0", "path", F.lpad(F.col("s").cast("string"), 10, "0"), "name")
    ids = fresh_ids(rows.select("base", order.alias("pos")), taken)
    link = lambda key, value, *roles: F.when(F.col("role").isin(*roles), F.lit(f"{key}={value}")) if value else F.lit(None).cast("string")
    fields = [F.concat(F.lit("trace:v1 id="), "trace_id"), F.lit(f"work={work}") if work else F.lit(None).cast("string"), link("satisfies", requirement, "impl", "ops"), link("verifies", requirement, "test"), link("exercises", exercised, "test"), link("documents", requirement, "doc"), link("implements", plan, "impl")]
    text = F.concat_ws(" ", *fields)
    style = _opener(F.col("language"))
    line = F.when(F.col("language") == "markdown", F.concat(F.lit("<!-- "), text, F.lit(" -->"))).otherwise(F.concat_ws(" ", F.coalesce(style, F.lit("#")), text))
    return rows.withColumn("pos", order).join(ids, ["base", "pos"]).select("path", "name", "s", "role", "trace_id", line.alias("marker"))


def _slug(text: Column) -> Column:
    """Words of a name, also those that only a capital letter begins, joined by hyphens."""
    return F.coalesce(F.nullif(slug(F.regexp_replace(text, "(?<=.)(?=[A-Z][a-z])", "-")), F.lit("")), F.lit("boundary"))
