"""Interval operators: containment, overlap, following symbol, coalesced ranges, gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import dealt, kept

#: Spans that may contain each other meet in buckets of so many lines, so a file with very many spans is dealt over its buckets.
BUCKET = 16


def _buckets(start: Column, end: Column) -> Column:
    return F.explode(F.sequence(F.floor(start / BUCKET).cast("int"), F.floor(end / BUCKET).cast("int")))


# Lines and ranges meet in cells of 1, 2, 4, ... lines: a line lies in one cell of
# each size, and a range is made up of at most two cells of each size up to its own.
# What is asked of a range is gathered by cell, so work grows with the lines and
# ranges, and not with the pairs of them.

def _cells(start: Column, end: Column) -> Column:
    """The cells (level, cell) that make up a range of lines; none if it is empty."""
    s, past = start.cast("long"), end.cast("long") + 1
    shift = lambda c, n: F.call_function("shiftright", c, n)
    cell = lambda n, c: F.struct(n.alias("level"), c.alias("cell"))

    def at(n):
        lo, hi = -shift(-s, n), shift(past, n)
        return F.array(F.when((lo % 2 != 0) & (lo < hi), cell(n, lo)), F.when((hi % 2 != 0) & (lo < hi), cell(n, hi - 1)))

    made = F.when(past > s, F.flatten(F.transform(F.sequence(F.lit(0), F.length(F.bin(past - s)) - 1), at)))
    return F.inline(F.filter(made, lambda x: x.isNotNull()))


def _cells_of(line: Column, top: int) -> Column:
    """The cells (level, cell) that hold a line, up to level ``top``."""
    return F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(top)), lambda n: F.call_function("shiftright", line.cast("long"), n))).alias("level", "cell")


def _top(ranges: DataFrame) -> int:
    """The level of the largest cell in the ranges (s, e)."""
    widest = ranges.agg(F.max(F.col("e").cast("long") - F.col("s") + 1)).first()[0] or 1
    return max(widest, 1).bit_length() - 1


def _held(lines: DataFrame, spans: DataFrame, best, stored: bool = False) -> DataFrame:
    """(path, line, m): the aggregate ``best`` of ``m`` over the spans (path, s, e, m), ``stored`` or not, that hold each distinct line (path, line); none, no row."""
    spans = spans if stored else kept(spans, "spans")
    cells = spans.select("path", "m", _cells(F.col("s"), F.col("e"))).groupBy("path", "level", "cell").agg(best("m").alias("m"))
    at = lines.select("path", "line").distinct().select("path", "line", _cells_of(F.col("line"), _top(spans)))
    return at.join(dealt(cells), ["path", "level", "cell"]).groupBy("path", "line").agg(best("m").alias("m"))


def _inside(ranges: DataFrame, lines: DataFrame, best) -> DataFrame:
    """(path, s, e, m): the aggregate ``best`` of ``m`` over the lines (path, line, m) in each distinct range (path, s, e); none, no row."""
    ranges = kept(ranges.select("path", "s", "e").distinct(), "ranges")
    cells = lines.groupBy("path", "line").agg(best("m").alias("m")).select("path", "m", _cells_of(F.col("line"), _top(ranges))).groupBy("path", "level", "cell").agg(best("m").alias("m"))
    return ranges.select("path", "s", "e", _cells(F.col("s"), F.col("e"))).join(dealt(cells), ["path", "level", "cell"]).groupBy("path", "s", "e").agg(best("m").alias("m"))


def containment(spans: DataFrame) -> DataFrame:
    """(outer, inner): strict containment within a path; ``spans``: path, id, s, e.

    Spans of the same lines meet the others as one and are told apart at the
    end, so what is joined grows with the different spans of a path; the pairs
    themselves grow with the square of the spans that nest.  The inner span's
    start picks one bucket, the outer one covers it, so each pair meets once.
    """
    same = spans.filter("s <= e").groupBy("path", "s", "e").agg(F.collect_list("id").alias("ids"))
    outer = same.select("path", F.col("ids").alias("outers"), F.col("s").alias("os"), F.col("e").alias("oe"), _buckets(F.col("s"), F.col("e")).alias("b"))
    inner = same.select("path", F.col("ids").alias("inners"), "s", "e", F.floor(F.col("s") / BUCKET).cast("int").alias("b"))
    met = outer.join(dealt(inner), ["path", "b"]).filter("os < s and oe > e")
    return met.select(F.explode("outers").alias("outer"), "inners").select("outer", F.explode("inners").alias("inner"))


def narrowest(points: DataFrame, spans: DataFrame) -> DataFrame:
    """The narrowest span that holds each point (path, line, point): ties to the earlier start, then the smaller id."""
    first = spans.groupBy("path", "s", "e").agg(F.min("id").alias("id"))
    at = _held(points, first.select("path", "s", "e", F.struct((F.col("e") - F.col("s")).alias("width"), "s", "id").alias("m")), F.min)
    best = points.select("path", "line", "point").join(dealt(at), ["path", "line"]).groupBy("path", "point").agg(F.min("m").alias("m"))
    return best.select("path", "point", F.col("m.id").alias("id"))


def narrowest_at(lines: DataFrame, spans: DataFrame) -> DataFrame:
    """(path, line, id): what ``narrowest`` gives for each distinct line (path, line) of those that a span of a stored table holds."""
    own = spans.select("path", "s", "e", F.struct((F.col("e") - F.col("s")).alias("width"), "s", "id").alias("m"))
    return _held(lines, own, F.min, stored=True).select("path", "line", F.col("m.id").alias("id"))


def node_at_line(points: DataFrame, spans: DataFrame) -> DataFrame:
    """The span that holds each point and starts last, ties to the larger id; else the path's first span by start, then id."""
    ends = kept(spans.groupBy("path", "s", "e").agg(F.min("id").alias("least"), F.max("id").alias("id")), "ends")
    at = _held(points, ends.select("path", "s", "e", F.struct("s", "id").alias("m")), F.max)
    first = ends.groupBy("path").agg(F.min(F.struct("s", F.col("least").alias("id"))).alias("first"))
    rows = points.select("path", "line", "point").join(dealt(at), ["path", "line"], "left").groupBy("path", "point").agg(F.max("m").alias("m"), F.count(F.lit(1)).cast("int").alias("n"))
    rows = rows.join(first, "path").withColumn("turn", F.explode(F.sequence(F.lit(1), "n")))
    return rows.select("path", "point", F.coalesce("m.id", "first.id").alias("id"))


def overlapping(ranges: DataFrame, spans: DataFrame) -> DataFrame:
    """The first span by id that overlaps each range (path, rid, s, e): one that holds its first line or starts in it."""
    own = kept(spans.filter("s <= e").groupBy("path", "s", "e").agg(F.min("id").alias("m")), "spans")
    different = ranges.select("path", "s", "e").distinct()
    around = different.join(dealt(_held(different.withColumnRenamed("s", "line"), own, F.min).withColumnRenamed("line", "s")), ["path", "s"]).select("path", "s", "e", "m")
    begun = _inside(different, own.select("path", F.col("s").alias("line"), "m"), F.min)
    least = around.unionByName(begun).groupBy("path", "s", "e").agg(F.min("m").alias("id"))
    return ranges.select("path", "rid", "s", "e").join(dealt(least), ["path", "s", "e"]).groupBy("path", "rid").agg(F.min("id").alias("id"))


def intersecting(symbols: DataFrame, ranges: DataFrame) -> DataFrame:
    """Symbols (path, id, s, e) that one of the changed ranges (path, s, e) of their path meets: that holds their first line or starts in them."""
    changed = kept(ranges.filter("s <= e").select("path", "s", "e").distinct().withColumn("m", F.lit(1)), "ranges")
    different = kept(symbols.filter("s <= e").select("path", "s", "e").distinct(), "symbols")
    around = different.join(dealt(_held(different.withColumnRenamed("s", "line"), changed, F.max).withColumnRenamed("line", "s")), ["path", "s"], "left_semi")
    begun = _inside(different, changed.select("path", F.col("s").alias("line"), "m"), F.max).select("path", "s", "e")
    return symbols.join(dealt(around.unionByName(begun)), ["path", "s", "e"], "left_semi")


def sections_at(markers: DataFrame, sections: DataFrame) -> DataFrame:
    """Every section (path, key, s, e) whose lines hold a marker (path, marker, line), in the order of start, key and marker line.

    The sections of a line are put in order once for all markers on it; only
    markers on several lines have an order of their own.
    """
    covered = sections.select("path", "key", "s", "e", _buckets(F.col("s"), F.col("e")).alias("b"))
    at = markers.select("path", "line").distinct().withColumn("b", F.floor(F.col("line") / BUCKET).cast("int"))
    rows = at.join(covered, ["path", "b"]).filter("line between s and e")
    listed = rows.groupBy("path", "line").agg(F.array_sort(F.collect_list(F.struct("s", "key"))).alias("held"))
    turns = Window.partitionBy("path", "marker")
    own = markers.select("path", "marker", "line", F.count(F.lit(1)).over(turns).alias("n"))
    single = own.filter("n = 1").groupBy("path", "line").agg(F.collect_list("marker").alias("markers"))
    single = single.join(listed, ["path", "line"]).select("path", F.explode("markers").alias("marker"), "held").select("path", "marker", F.posexplode("held").alias("at", "x"))
    single = single.select("path", "marker", "x.key", (F.col("at") + 1).alias("position"))
    several = own.filter("n > 1").join(listed, ["path", "line"]).select("path", "marker", "line", F.explode("held").alias("x"))
    several = several.select("path", "marker", "x.key", F.row_number().over(turns.orderBy("x.s", "x.key", "line")).alias("position"))
    return single.unionByName(several)


def covered_lines(lines: DataFrame, spans: DataFrame) -> DataFrame:
    """How many of the hit lines (path, line) lie in each span."""
    counts = _inside(spans, lines.select("path", "line", F.lit(1).cast("long").alias("m")), F.sum)
    return spans.select("path", "id", "s", "e").join(dealt(counts), ["path", "s", "e"]).groupBy("id").agg(F.sum("m").alias("lines"))


def following(markers: DataFrame, symbols: DataFrame, lines: DataFrame, within: int = 3) -> DataFrame:
    """The symbol after each marker with at most ``within`` lines between, all of them skippable.

    ``markers``: path, marker, line; ``symbols``: path, id, s; ``lines``: path,
    line, skippable.  ``ambiguous`` if more than one symbol is eligible.  Markers
    on one line and symbols that start on one line count as one each; a symbol is
    eligible up to the first line that is not skippable.
    """
    rows = markers.select("path", "marker", "line").join(dealt(_following(markers, symbols, lines, within)), ["path", "line"])
    found = rows.groupBy("path", "marker").agg(F.min("m").alias("m"), F.sum("n").alias("n"))
    return found.select("path", "marker", F.col("m.id").alias("id"), (F.col("n") > 1).alias("ambiguous"))


def following_at(at: DataFrame, symbols: DataFrame, lines: DataFrame, within: int = 3) -> DataFrame:
    """(path, line, id, ambiguous): what ``following`` gives for a marker on each distinct line (path, line)."""
    return _following(at, symbols, lines, within).select("path", "line", F.col("m.id").alias("id"), (F.col("n") > 1).alias("ambiguous"))


def _following(markers: DataFrame, symbols: DataFrame, lines: DataFrame, within: int) -> DataFrame:
    """(path, line, m, n): the first eligible symbol (s, id) after each line of a marker, and how many are."""
    ahead = lambda n: F.explode(F.sequence(F.col("line") + 1, F.col("line") + n))
    at = markers.select("path", "line").distinct()
    starts = symbols.groupBy("path", "s").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    near = at.select("path", "line", ahead(within + 1).alias("s")).join(dealt(starts), ["path", "s"])
    solid = lines.filter("not skippable").select("path", F.col("line").alias("s")).distinct()
    stop = at.select("path", "line", ahead(within + 1).alias("s")).join(dealt(solid), ["path", "s"]).groupBy("path", "line").agg(F.min("s").alias("stop"))
    free = near.join(dealt(stop), ["path", "line"], "left").filter("stop is null or s <= stop")
    return free.groupBy("path", "line").agg(F.min(F.struct("s", "id")).alias("m"), F.sum("n").alias("n"))


def coalesced(ranges: DataFrame, key: str = "path") -> DataFrame:
    """Overlapping or adjacent ranges of a key as one: gaps and islands."""
    order = Window.partitionBy(key).orderBy("s", "e")
    reach = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = ranges.withColumn("new", F.when(F.col("s") <= reach + 1, 0).otherwise(1))
    rows = rows.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(key, "island").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("island")


def unmarked(symbols: DataFrame, added: DataFrame, markers: DataFrame) -> DataFrame:
    """Symbols (path, id, s, e) whose first line was added and that no marker precedes or lies in."""
    fresh = symbols.join(dealt(added.select("path", F.col("line").alias("s"))), ["path", "s"], "left_semi")
    marked = _inside(fresh.withColumn("s", F.col("s") - 1), markers.select("path", "line", F.lit(1).alias("m")), F.max).withColumn("s", F.col("s") + 1)
    return fresh.join(dealt(marked), ["path", "s", "e"], "left_anti").select(symbols.columns)


def added_lines(diff: DataFrame) -> DataFrame:
    """Line numbers that a unified diff adds; ``diff``: path, n (order), text."""
    header = F.regexp_extract("text", r"^@@ -\d+(?:,\d+)? \+(\d+)", 1)
    order = Window.partitionBy("path").orderBy("n")
    rows = diff.withColumn("start", F.when(F.col("text").startswith("@@"), header.cast("int")))
    rows = rows.withColumn("hunk", F.count("start").over(order))
    own = Window.partitionBy("path", "hunk").orderBy("n")
    body = (F.col("hunk") > 0) & F.col("start").isNull()
    moves = F.when(body & ~F.col("text").startswith("-") & ~F.col("text").startswith("\\"), 1).otherwise(0)
    rows = rows.withColumn("line", F.first("start").over(own) + F.sum(moves).over(own) - 1)
    return rows.filter(body & F.col("text").startswith("+")).select("path", "line", F.substring("text", 2, 1 << 30).alias("text"))


def boundary_changes(now: DataFrame, before: DataFrame) -> DataFrame:
    """new, modified or unchanged for each boundary (path, name, kind, fingerprint, and more that stays); a heading that is there is unchanged."""
    old = before.select("path", "name", F.col("fingerprint").alias("old"))
    state = F.when(F.col("old").isNull(), "new").when((F.col("kind") != "heading") & (F.col("old") != F.col("fingerprint")), "modified").otherwise("unchanged")
    more = [c for c in now.columns if c not in ("path", "name", "kind", "fingerprint")]
    return now.join(old, ["path", "name"], "left").select("path", "name", "kind", state.alias("state"), "fingerprint", *more)
