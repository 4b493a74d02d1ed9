"""The index as one job: files to markers, nodes, edges, staleness and findings, merged with the index before.

Nodes: trace_id, node_type, title, path, s, e, fingerprint, attachment, parser,
status, active.  Edges: f, p, t, kind (declared, structural or else), status, path,
line.  Spans of symbols: path, id, s, e, hash, parser.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..schema import CURRENT
from ..scratch import kept
from .change import carried, recorded_findings, recorded_versions, staleness
from .change import changed as altered_ids
from .extract import marker_lines, parsed_markers
from .rules import findings
from .structure import containment, following_at, narrowest_at

WITHIN = 3


@dataclass
class Index:
    nodes: DataFrame
    edges: DataFrame
    versions: DataFrame
    findings: DataFrame

    def report(self, files: DataFrame) -> DataFrame:
        """One row of counts of the run."""
        n = self.nodes.agg(F.count(F.lit(1)).alias("nodes"), F.count_if("active").alias("active"), F.count_if("changed").alias("changed"), F.count_if(F.col("status") != CURRENT).alias("stale"))
        rows = files.agg(F.count(F.lit(1)).alias("files")).join(n).join(self.edges.agg(F.count(F.lit(1)).alias("edges"))).join(self.findings.agg(F.count(F.lit(1)).alias("findings")))  # one row each
        return rows


def attached(markers: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """``markers`` (path, line, ...) with what each is attached to among the stored ``symbols``: s, e, hash, parser, and ``attachment``.

    A marker in a symbol is its narrowest symbol's; else the symbol's that follows
    with at most WITHIN lines of comments, decorators or blanks between, which is
    ``ambiguous`` if more are eligible; else the file's.
    """
    at = markers.select("path", "line").distinct()
    inside = narrowest_at(at, symbols).withColumnRenamed("id", "inside")
    lines = files.join(at.select("path").distinct(), "path", "left_semi").select("path", F.posexplode(tx.lines(F.col("text"))).alias("n", "l"))
    lines = lines.select("path", (F.col("n") + 1).alias("line"), F.trim("l").rlike(r"^(?:$|#|//|/\*|\*|<!--|--|@|;|%)").alias("skippable"))
    after = following_at(at, symbols, lines, WITHIN).withColumnRenamed("id", "after")
    rows = markers.join(inside, ["path", "line"], "left").join(after, ["path", "line"], "left")
    how = F.when(F.col("inside").isNotNull(), "symbol").when(F.col("ambiguous"), "ambiguous").when(F.col("after").isNotNull(), "symbol").otherwise("file")
    rows = rows.withColumn("attachment", how).withColumn("id", F.coalesce("inside", "after"))
    own = symbols.select("path", "id", "s", "e", "hash", "parser").dropDuplicates(["path", "id"])
    return rows.join(own, ["path", "id"], "left").drop("inside", "after", "ambiguous")


def declared(files: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, findings) that the files' markers declare; of several declarations of an id the first by path and line counts."""
    parsed = kept(parsed_markers(marker_lines(files)), "markers")
    found = parsed.select("path", "line", "trace_id", F.explode("problems").alias("x")).select("path", "line", "trace_id", F.col("x.rule").alias("rule"), F.col("x.message").alias("detail"))
    found = found.select("rule", "trace_id", "path", F.col("line").cast("int").alias("line"), "detail")
    sound = parsed.filter("trace_id is not null").filter(~F.exists("problems", lambda x: x["rule"] == "TL005"))
    turn = Window.partitionBy("trace_id").orderBy("path", "line")
    sound = sound.withColumn("turn", F.row_number().over(turn)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("trace_id")))
    twice = findings(sound.filter("n > 1"), "TL001", detail=F.col("n"), line="line")
    first = sound.filter("turn = 1").drop("turn", "n")
    texts = attached(first.drop("edges", "expects", "problems"), symbols, files).join(files.select("path", "text"), "path")
    # A symbol's own hash, or that of the marked text where there is none.
    block = F.when(F.col("s").isNull(), F.col("text")).otherwise(F.array_join(F.slice(tx.lines(F.col("text")), F.col("s"), F.col("e") - F.col("s") + 1), "\n"))
    nodes = texts.select("trace_id", F.col("type").alias("node_type"), "title", "path", F.coalesce("s", "line").cast("int").alias("s"), F.coalesce("e", "line").cast("int").alias("e"), F.coalesce("hash", tx.fingerprint(block)).alias("fingerprint"), "attachment", F.coalesce("parser", F.lit("generic")).alias("parser"), F.lit(CURRENT).alias("status"), F.lit(True).alias("active"))
    edges = first.select("path", F.col("line").cast("int").alias("line"), F.col("trace_id").alias("f"), F.explode("edges").alias("x")).select("f", "x.p", "x.t", F.lit("declared").alias("kind"), F.lit("active").alias("status"), "path", "line").distinct()
    return nodes, edges, found.unionByName(twice)


def structural(nodes: DataFrame) -> DataFrame:
    """``contains`` edges from each node to those whose lines lie within its own."""
    spans = nodes.filter("active and s is not null and e is not null").select("path", F.col("trace_id").alias("id"), "s", "e").distinct()
    none = F.lit(None)
    return containment(spans).select(F.col("outer").alias("f"), F.lit("contains").alias("p"), F.col("inner").alias("t"), F.lit("structural").alias("kind"), F.lit("active").alias("status"), none.cast("string").alias("path"), none.cast("int").alias("line"))


def kept_edges(previous: DataFrame, redeclared: DataFrame) -> DataFrame:
    """Edges of the index before whose source was not declared again or deleted (trace_id); structural ones are derived anew."""
    return previous.filter("kind <> 'structural'").join(redeclared.select(F.col("trace_id").alias("f")), "f", "left_anti")


def merged_nodes(previous: DataFrame, parsed: DataFrame, changed_paths: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(nodes, trace_id of the deleted ones) after ``parsed`` came in.

    A declaration wins over the node before, wherever that was.  A node of a
    changed path that is not declared any more stays as an inactive row; one that
    was inactive already goes with the next change of its path.  Nodes of other
    paths stay.  Without ``changed_paths`` the files are all there are, so every
    id that is not declared is inactive.
    """
    gone = previous.join(parsed.select("trace_id"), "trace_id", "left_anti")
    if changed_paths is None:
        return parsed.unionByName(gone.withColumn("active", F.lit(False)).select(parsed.columns)), gone.select("trace_id")
    touched = changed_paths.select("path")
    deleted = gone.filter("active").join(touched, "path", "left_semi").withColumn("active", F.lit(False))
    stays = gone.join(touched, "path", "left_anti")
    return parsed.unionByName(deleted.select(parsed.columns)).unionByName(stays.select(parsed.columns)), deleted.select("trace_id")


def merged_findings(previous: DataFrame, fresh: DataFrame, changed_paths: DataFrame | None) -> DataFrame:
    """Findings after ``fresh`` came in: those of paths that have not changed stay, each once.

    Missing targets (TL002) depend on all nodes and are never carried.
    """
    if changed_paths is None:
        return fresh.distinct()
    stays = previous.filter("rule <> 'TL002'").join(changed_paths.select("path"), "path", "left_anti")
    return recorded_findings(stays.select(fresh.columns), fresh).select(fresh.columns)


def lost_targets(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """TL002 of the index: active edges whose target is missing or inactive, where they are declared."""
    there = nodes.filter("active").select(F.col("trace_id").alias("t"))
    lost = edges.filter("status = 'active'").join(there, "t", "left_anti")
    return findings(lost, "TL002", None, "path", F.concat("f", F.lit(" "), "p", F.lit(" -> "), "t"), "line")


def run(files: DataFrame, symbols: DataFrame, previous: Index | None = None, changed_paths: DataFrame | None = None, *, at: str = "0", clean: bool = False) -> Index:
    """The index after a run over ``files`` (path, text).

    Without ``changed_paths`` the files are all there are; with it, only files of
    those paths, and their symbols, are read (a path without a file is a deleted one) and nodes,
    edges, findings and versions merge with the index before: see
    ``merged_nodes``, ``kept_edges`` and ``merged_findings``.  A node that has
    another fingerprint on record is changed: it is current, and makes the
    sources of its declared edges stale.  Others keep a status that was not
    current, but for a ``clean`` run.  ``structural`` edges are derived anew.
    The result does not depend on how changes are dealt over runs, but for
    repeated declarations, which are looked for among the files of one run.
    Symbols, markers, nodes and edges are computed once and kept; what is left is planned where it is read.
    """
    symbols = symbols.select("path", "id", "s", "e", "hash", "parser")
    if changed_paths is not None:
        changed_paths = kept(changed_paths.select("path").distinct(), "paths")
        files, symbols = (x.join(changed_paths, "path", "left_semi") for x in (files, symbols))
    nodes, edges, found = declared(files, kept(symbols, "symbols"))
    nodes = kept(nodes, "index")
    versions = nodes.select("trace_id", "fingerprint", F.lit(at).alias("observed"))
    if previous is None:
        merged, links = nodes, edges
    else:
        merged, deleted = merged_nodes(previous.nodes, nodes, changed_paths)
        replaced = nodes.select("trace_id").unionByName(deleted)
        links = edges if changed_paths is None else kept_edges(previous.edges, replaced).select(edges.columns).unionByName(edges)
        merged = carried(merged, previous.nodes, clean)
        versions = recorded_versions(previous.versions, versions)
        found = merged_findings(previous.findings, found, changed_paths)
    merged = merged if previous is None else kept(merged, "merged")
    links = kept(links.distinct(), "links")
    altered = altered_ids(merged.filter("fingerprint is not null"), previous.versions) if previous is not None else merged.select("trace_id").limit(0)
    # Structural edges, which may be many more than all others, make nothing stale and lose no target, so only who reads the edges derives them.
    return Index(staleness(merged, links, altered), links.unionByName(structural(merged)), versions, found.unionByName(lost_targets(merged, links)).distinct())
