"""Operator 2: MinHash near-duplicates from bottom-k sketches of one hash function.

1. Each document's set of word shingles gives a digest, its size and the SKETCH
   smallest hashes.  Equal sets are one class from here on.
2. Inverted lists of the retained values: a value that only one class retains
   links nothing.  Of the SKETCH smallest values of their union two sets of
   similarity 0.8 share SHARED or more but twice in ten million (a binomial
   tail, the larger the sets the closer); where a set is retained whole its size
   says how many, without loss.  So a class with fewer values in common with
   others is alone, and a pair must meet in a list of one of its rarest values
   (the prefix filter).  Lines that many documents share are not rare.
3. In each list the members meet its most central class; the estimate from the
   union's sketch filters, the exact similarity of the full sets decides.
4. Members of one cluster of lists that are still in different components are
   compared in blocks with their full sets, so no link between them is lost,
   while what is linked already is not compared again.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shingles, text_chunks, written
from .components import components

SKETCH = 32
SHARED = 13
LEAST_ESTIMATE = SHARED / SKETCH
BLOCK = 256


def signatures(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """doc_id, n_shingles, digest (null for an empty set), sketch (ascending)."""
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("n_shingles", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("sketch", T.ArrayType(T.LongType()))])

    def run(batches):
        for batch in batches:
            n, digest, sketch = [], [], []
            for _, _, w in text_chunks(batch.column(1)):
                for s in shingles(w, words):
                    s = np.sort(s.view(np.int64))
                    n.append(len(s))
                    digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    sketch.append(s[:SKETCH])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sketch, pa.list_(pa.int64()))], schema.names)

    return rows.mapInArrow(run, schema)


def full_sets(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id, shingles) of the documents in ``ids``: sorted 8-byte hashes, a row for each set of an id."""
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text")).join(ids, "id", "left_semi")

    def run(batches):
        for batch in batches:
            sets = [np.sort(s.view(np.int64)).tobytes() for _, _, w in text_chunks(batch.column(1)) for s in shingles(w, words)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["id", "shingles"])

    return rows.mapInArrow(run, "id bigint, shingles binary").repartition("id").dropDuplicates(["id", "shingles"])


def least_shared(n):
    """How many retained values two classes must share: the similarity's own bound where the set is retained whole.

    A larger partner, of up to n / 0.8 values, retains SKETCH of them; what it drops is not asked for.
    """
    dropped = F.greatest(F.lit(0), F.floor(n * 1.25 + 1e-9) - SKETCH)
    return F.when(n <= SKETCH, F.least(F.ceil(n * 0.8 - 1e-9), n - dropped)).otherwise(SHARED).cast("int")


def candidates(classes: DataFrame) -> DataFrame:
    """Classes that share enough retained values with others: id, n, sketch, centre, keys (their rarest values)."""
    values = classes.select("id", "n", F.explode("sketch").alias("v"))
    # Written, so that the join's other side is a plain exchange of rows, which AQE can split at a hot value.
    counts = written(values.groupBy("v").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "near-counts")
    own = values.join(counts, "v").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("held"))
    own = own.withColumn("prefix", F.size("held") - least_shared(F.col("n")) + 1).filter("prefix > 0")
    centre = F.aggregate("held", F.lit(0).cast("long"), lambda s, x: s + x["df"])
    own = own.select("id", centre.alias("centre"), F.transform(F.slice("held", F.lit(1), F.col("prefix")), lambda x: x["v"]).alias("keys"))
    return classes.join(own, "id")


def estimate(a, b):
    """Similarity of two sets from the sketch of their union."""
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, SKETCH)
    return F.size(F.array_intersect(F.array_intersect(a, b), union)) / F.size(union)


def alike(inter: int, a: int, b: int) -> bool:
    return 100 * inter >= 80 * (a + b - inter)


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) whose full sets are alike."""
    rows = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.int64), np.frombuffer(y.as_buffer(), np.int64)
                keep.append(alike(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return rows.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def block_links(table: pa.Table, left: int, right: int) -> list[tuple[int, int]]:
    """Links that join different components among the rows of block ``left`` and of block ``right``."""
    ids, comp, block = (table[c].to_pylist() for c in ("id", "component", "block"))
    sets = [np.frombuffer(x.as_buffer(), np.int64) for x in table["shingles"]]
    parent = {c: c for c in comp}

    def root(c):
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    theirs = [k for k in range(len(ids)) if block[k] == right]
    sizes = np.array([len(sets[k]) for k in theirs])
    values = np.concatenate([np.zeros(0, np.int64), *[sets[k] for k in theirs]])
    owner = np.repeat(np.arange(len(theirs)), sizes)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    out = []
    for k in (k for k in range(len(ids)) if block[k] == left):
        a, b = np.searchsorted(values, sets[k]), np.searchsorted(values, sets[k], "right")
        n = b - a
        at = np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        inter = np.bincount(owner[at], minlength=len(theirs))
        for j in np.flatnonzero(100 * inter >= 80 * (sizes + len(sets[k]) - inter)).tolist():
            x, y = root(comp[k]), root(comp[theirs[j]])
            if x != y:
                parent[max(x, y)] = min(x, y)
                out.append((ids[k], ids[theirs[j]]))
    return out


def remaining_links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between different components of a cluster; ``members``: id, cluster, component.

    The cluster's largest component has blocks of its own, of about BLOCK rows
    by hash; the other rows' blocks meet each other and those.
    """
    per = members.groupBy("cluster", "component").agg(F.count(F.lit(1)).alias("n"))
    per = per.groupBy("cluster").agg(F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("most"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    per = per.select("cluster", F.col("most.component").alias("main"), F.ceil(F.col("most.n") / BLOCK).cast("int").alias("mains"), F.ceil((F.col("n") - F.col("most.n")) / BLOCK).cast("int").alias("others"))
    rows = members.join(per, "cluster")
    here = F.col("component") == F.col("main")
    spread = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    rows = rows.withColumn("block", F.when(here, spread(F.col("mains"))).otherwise(F.col("mains") + spread(F.col("others"))))
    rest = F.sequence(F.col("mains"), F.col("mains") + F.col("others") - 1)
    rows = rows.withColumn("meets", F.when(here, rest).otherwise(F.concat(F.sequence(F.lit(0), F.col("mains") - 1), rest)))
    rows = rows.join(sets, "id").select("id", "component", "shingles", "cluster", "block", F.explode("meets").alias("other"))
    rows = rows.withColumn("left", F.greatest("block", "other")).withColumn("right", F.least("block", "other")).drop("other")

    def run(key, table):
        found = block_links(table, key[1].as_py(), key[2].as_py())
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return rows.groupBy("cluster", "left", "right").applyInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept.

    Two documents are linked if the sets of their ``words``-word shingles
    (A-Z lower-cased; of all words of a shorter text) have a Jaccard similarity
    of at least 0.8; ``component_id`` is the smallest id reachable by links.

    A null or empty text, or one without words, has an empty set and is linked
    with nothing; repeated rows have one id and each give a row; rows of one id
    with different texts are one document, linked to what any of them is linked
    to, each row with the size of its own set; a null id is linked with nothing,
    with a null component and kept; an empty table gives an empty table; other
    columns are not read.  Ids are whole numbers.
    """
    own = written(signatures(docs, id_col, text_col, words), "near-signatures")
    usable = own.filter(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    # Equal digests have equal sizes and sketches.
    classes = usable.groupBy("digest").agg(F.min("doc_id").cast("long").alias("id"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    classes = written(classes, "near-classes")
    found = written(candidates(classes.select("id", "n", "sketch")), "near-candidates")
    scale = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.25))).cast("int")
    lists = found.select("id", "n", "sketch", "centre", scale.alias("scale"), F.explode("keys").alias("v"))
    heads = lists.groupBy("v", "scale").agg(F.max(F.struct("centre", "id")).alias("h"), F.count(F.lit(1)).alias("c")).filter("c > 1").select("v", "scale", F.col("h.id").alias("b"))
    # Neighbouring scales meet too: their heads are members of one list of the value.
    across = heads.join(heads.select("v", (F.col("scale") + 1).alias("scale"), F.col("b").alias("a")), ["v", "scale"]).select("a", "b")
    near = lists.select("v", "scale", F.col("id").alias("a")).join(heads, ["v", "scale"]).select("a", "b")
    # Every list's members are tied together for the clusters, whatever their sizes.
    top = lists.groupBy("v").agg(F.max(F.struct("centre", "id")).alias("h")).select("v", F.col("h.id").alias("b"))
    ties = lists.select("v", F.col("id").alias("a")).join(top, "v").select("a", "b").distinct()
    stars = written(near.unionByName(across).filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "near-stars")
    brief = found.select("id", "n", "sketch")
    sided = stars.join(brief.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")), "a").join(brief.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb")), "b")
    fit = (5 * F.least("na", "nb") >= 4 * F.greatest("na", "nb")) & (estimate(F.col("sa"), F.col("sb")) >= LEAST_ESTIMATE)
    sets = written(full_sets(docs, found.select("id"), id_col, text_col, words), "near-sets")
    links = written(confirmed(sided.filter(fit).select("a", "b"), sets), "near-links")
    clusters = components(ties, "near-clusters")
    first = components(links.unionByName(found.select(F.col("id").alias("a"), F.col("id").alias("b"))), "near-first")
    first = written(first, "near-first")
    members = clusters.select("id", F.col("component").alias("cluster")).join(first, "id")
    more = written(remaining_links(members, sets), "near-more")
    named = first.withColumnRenamed("component", "c")
    joined = more.join(named.select(F.col("id").alias("a"), F.col("c").alias("x")), "a").join(named.select(F.col("id").alias("b"), F.col("c").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    merged = components(joined, "near-merged")
    final = first.join(merged.select(F.col("id").alias("component"), F.col("component").alias("m")), "component", "left").select("id", F.coalesce("m", "component").alias("component"))
    by_class = classes.select("digest", "id").join(final, "id", "left").select("digest", F.coalesce("component", "id").alias("component"))
    return own.join(by_class, "digest", "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", F.col("doc_id").cast("long"))).alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component", F.col("doc_id").cast("long")), F.lit(True)).alias("kept"),
    )
