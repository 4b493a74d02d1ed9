"""Full-text search over nodes: ranked by BM25, else by substring; for one query by a scan, for many through a stored index.

The index holds postings dealt over BUCKETS folders by a hash of the term, so a
search reads the folders of its terms alone, and documents with length and
generation.  An update appends the postings of the changed documents under a new
generation and publishes a new table of documents; a posting counts while its
document has its generation, so readers see one state whole.
"""

from __future__ import annotations

import itertools
import re
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..scratch import kept
from ..sources import snapshots

K1, B = 1.2, 0.75
BUCKETS = 64
DOCS, SETS = 4096, 1 << 15
PLAIN = r"^[A-Za-z0-9\s]+$"


def postings(docs: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """((id, term, n), (id, length)) of the columns' words; the index of a search."""
    text = F.concat_ws(" ", *columns)
    words = docs.select("id", tokens(text).alias("w"))
    terms = words.select("id", F.explode("w").alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("n"))
    return terms, words.select("id", F.size("w").alias("length"))


def bm25(docs: DataFrame, columns: list[str], query: str, k: int = 20) -> DataFrame:
    """(id, score) of the ``k`` best documents that hold every word of the query; smaller scores are better.

    Only postings of the query's words pass the filter before any exchange; the
    corpus gives its number of documents and words as one aggregate row.
    """
    wanted = sorted({w.lower() for w in re.findall("[A-Za-z0-9]+", query)})
    if not wanted or k < 1:
        return docs.select("id", F.lit(0.0).alias("score")).limit(0)
    text = F.concat_ws(" ", *columns)
    words = docs.select("id", tokens(text).alias("w")).withColumn("length", F.size("w"))
    counts = [F.size(F.filter("w", _is(t))) for t in wanted]
    rows = words.select("id", "length", *[c.alias(f"n{i}") for i, c in enumerate(counts)])
    totals = rows.agg(F.count(F.lit(1)).alias("docs"), F.avg("length").alias("mean"), *[F.count_if(F.col(f"n{i}") > 0).alias(f"d{i}") for i in range(len(wanted))])
    rows = rows.filter(" and ".join(f"n{i} > 0" for i in range(len(wanted))))
    return _best(rows.join(F.broadcast(totals)), len(wanted), k)  # one row


def bm25_indexed(terms: DataFrame, lengths: DataFrame, query: str, k: int = 20) -> DataFrame:
    """``bm25`` from a stored index of ``postings``: only rows of the query's words are read, and one aggregate over the lengths."""
    wanted = sorted({w.lower() for w in re.findall("[A-Za-z0-9]+", query)})
    if not wanted or k < 1:
        return lengths.select("id", F.lit(0.0).alias("score")).limit(0)
    met = terms.filter(F.col("term").isin(*wanted))
    rows = met.groupBy("id").agg(*[F.coalesce(F.max(F.when(F.col("term") == t, F.col("n"))), F.lit(0)).alias(f"n{i}") for i, t in enumerate(wanted)])
    df = met.agg(*[F.count_if(F.col("term") == t).alias(f"d{i}") for i, t in enumerate(wanted)])
    totals = lengths.agg(F.count(F.lit(1)).alias("docs"), F.avg("length").alias("mean"))
    rows = rows.filter(" and ".join(f"n{i} > 0" for i in range(len(wanted)))).join(lengths, "id")
    return _best(rows.join(F.broadcast(totals)).join(F.broadcast(df)), len(wanted), k)  # one row each


def _best(rows: DataFrame, n_words: int, k: int) -> DataFrame:
    score = F.lit(0.0)
    for i in range(n_words):
        n, d = F.col(f"n{i}"), F.col(f"d{i}")
        idf = F.greatest(F.lit(1e-6), F.log((F.col("docs") - d + 0.5) / (d + 0.5)))
        score = score - idf * n * (K1 + 1) / (n + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return rows.select("id", score.alias("score")).orderBy("score", "id").limit(k)


def _is(term: str):
    return lambda x: x == term


def by_substring(docs: DataFrame, columns: list[str], query: str, k: int = 20) -> DataFrame:
    """Documents with the query in a column, letter case aside, by id."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.lower(c).contains(query.lower()), F.lit(False))
    return docs.filter(hit).orderBy("id").limit(k).select("id")


def search(docs: DataFrame, columns: list[str], query: str, k: int = 20) -> DataFrame:
    """Ranked ids where the query is plain words and finds something, else by substring; a blank query or k < 1 finds nothing."""
    if not query.strip() or k < 1:
        return docs.select("id").limit(0)
    if re.fullmatch(r"[A-Za-z0-9\s]+", query):
        ranked = kept(bm25(docs, columns, query, k), "ranked")
        if not ranked.isEmpty():
            return ranked.select("id")
    return by_substring(docs, columns, query, k)


def _counted(w):
    """Words in order as (term, n), each once: where each begins, up to where the next does."""
    begins = F.filter(F.transform(w, lambda x, i: F.when((i == 0) | (x != F.get(w, i - 1)), i + 1)), F.isnotnull)
    ends = F.concat(F.slice(begins, 2, F.size(w)), F.array(F.size(w) + 1))
    counted = F.zip_with(begins, ends, lambda i, j: F.struct(F.element_at(w, i).alias("term"), (j - i).cast("long").alias("n")))
    return F.when(F.size(w) > 0, counted)


def _best_of_block(k: int):
    """The ``k`` best documents of a block for each set of words: (key, id, score, turn), ``turn`` the score to nine places."""

    def best(rows: pd.DataFrame, sets: pd.DataFrame) -> pd.DataFrame:
        ids, at = np.unique(rows["id"].to_numpy(), return_inverse=True)
        order = np.lexsort((at, rows["term"].to_numpy()))
        terms, at, part = rows["term"].to_numpy()[order], at[order], rows["part"].to_numpy()[order]
        edges = [0, *(np.flatnonzero(terms[1:] != terms[:-1]) + 1), len(terms)] if len(terms) else [0]
        held = {terms[i]: (at[i:j], part[i:j]) for i, j in itertools.pairwise(edges)}
        out = []
        for key in sets["key"]:
            own = [held.get(w) for w in key.split(" ")]
            if any(x is None for x in own):
                continue
            docs = min((x[0] for x in own), key=len)
            spots = [np.minimum(np.searchsorted(x[0], docs), len(x[0]) - 1) for x in own]
            fits = np.logical_and.reduce([x[0][i] == docs for x, i in zip(own, spots, strict=True)])
            if not fits.any():
                continue
            docs, score = docs[fits], np.zeros(int(fits.sum()))
            for (_, parts), i in zip(own, spots, strict=True):
                score = score - parts[i[fits]]
            turn = -np.floor(-score * 1e9 + 0.5) / 1e9
            if len(docs) > k:
                near = np.flatnonzero(turn <= np.partition(turn, k - 1)[k - 1])
                docs, score, turn = docs[near], score[near], turn[near]
            first = np.lexsort((docs, turn))[:k]
            out.append((key, docs[first], score[first], turn[first]))
        made = lambda n, kind: np.concatenate([x[n] for x in out]) if out else np.array([], kind)
        return pd.DataFrame({"key": np.repeat(np.array([x[0] for x in out], object), [len(x[1]) for x in out]), "id": ids[made(1, int)], "score": made(2, float), "turn": made(3, float)})

    return best


class StoredIndex:
    """An index of documents (id, columns of text) below ``root``."""

    def __init__(self, spark: SparkSession, root: str, columns: list[str]):
        self.spark, self.root, self.columns = spark, root, columns

    def update(self, docs: DataFrame, removed: DataFrame | None = None) -> int:
        """Puts ``docs`` in place of those with their ids, and takes ``removed`` (id) out; the first call builds the index."""
        base, _ = snapshots.current(self.spark, self.root)
        text = F.concat_ws(" ", *self.columns)
        # By sort_array: array_sort calls a comparator for each two words.
        words = docs.select("id", F.sort_array(tokens(text)).alias("w"))
        lengths = docs.select("id", F.size(tokens(text)).alias("length"))
        generation = f"{base + 1}-{uuid.uuid4().hex}"
        where = f"{self.root}/postings/generation={generation}"
        # A document's words are counted where they are and dealt by bucket once.
        terms = words.select("id", F.explode(_counted(F.col("w"))).alias("x")).select("id", "x.term", "x.n").withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int"))
        terms = terms.repartition("bucket").groupBy("bucket", "id", "term").agg(F.sum("n").alias("n")).select("id", "term", "n", "bucket")
        terms.sortWithinPartitions("bucket", "term", "id").write.partitionBy("bucket").parquet(where)
        shown = docs.select("id", F.concat_ws("\n", *self.columns).alias("shown"))
        now = lengths.join(shown, "id").withColumn("generation", F.lit(generation))
        if base:
            before = self.documents().join(now.select("id"), "id", "left_anti")
            before = before if removed is None else before.join(removed.select("id"), "id", "left_anti")
            now = now.unionByName(before)
        return snapshots.publish({"documents": now}, self.root, base)

    def documents(self) -> DataFrame:
        return snapshots.read(self.spark, self.root, "documents")[0]

    def postings(self, buckets: list[int]) -> DataFrame:
        """Postings of some buckets that count: (id, term, n), and their documents' length."""
        rows = self.spark.read.option("basePath", f"{self.root}/postings").parquet(f"{self.root}/postings").filter(F.col("bucket").isin(*buckets))
        return rows.join(self.documents().select("id", "generation", "length"), ["id", "generation"]).select("id", "term", "n", "length")

    def best(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """(query, id, score, rank): the ``k`` best documents of each of ``queries`` (query, text) that hold all its words; smaller scores are better.

        Queries of the same words are asked once.  Blocks of documents meet blocks
        of sets of words, with no more than DOCS documents and SETS sets each on
        average; of a set's documents in a block, those of its rarest word that
        hold the others, only the best ``k`` leave it.  Scores count to nine
        places; ties go to the smaller id.
        """
        words = queries.filter(F.col("text").rlike(PLAIN)).select("query", F.array_sort(F.array_distinct(tokens(F.col("text")))).alias("terms"))
        words = kept(words.filter(F.size("terms") > 0).withColumn("key", F.array_join("terms", " ")), "query-words")
        sets = words.select("key", "terms").distinct()
        asked = sets.select(F.explode("terms").alias("term")).distinct().withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int"))
        buckets = sorted(r["bucket"] for r in asked.select("bucket").distinct().collect())  # at most BUCKETS
        empty = self.documents().select(F.lit(None).cast("string").alias("query"), "id", F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
        if not buckets or k < 1:
            return empty.select(F.col("query").cast(queries.schema["query"].dataType), "id", "score", "rank")
        met = kept(self.postings(buckets).join(asked.select("term"), "term", "left_semi"), "query-postings")
        df = met.groupBy("term").agg(F.count(F.lit(1)).alias("d"))
        totals = self.documents().agg(F.count(F.lit(1)).alias("docs"), F.avg("length").alias("mean"))
        rows = met.join(df, "term").join(F.broadcast(totals))  # one row
        idf = F.greatest(F.lit(1e-6), F.log((F.col("docs") - F.col("d") + 0.5) / (F.col("d") + 0.5)))
        part = idf * F.col("n") * (K1 + 1) / (F.col("n") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
        across, down = (df.count() // size + 1 for df, size in ((self.documents(), DOCS), (sets, SETS)))
        block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        left = rows.select("id", "term", part.alias("part"), block("id", across).alias("a"), every(down).alias("b"))
        right = sets.select("key", block("key", down).alias("b"), every(across).alias("a"))
        kind = self.documents().schema["id"].dataType.simpleString()
        top = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInPandas(_best_of_block(k), f"key string, id {kind}, score double, turn double")
        order = Window.partitionBy("key").orderBy("turn", "id")
        top = top.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        return words.select("query", "key").join(top, "key").select("query", "id", "score", "rank")

    def found(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """(query, id, rank): ``best``, and for queries without any the documents that hold the whole query in a column, letter case aside, by id.

        Those meet by the query's first characters, up to three, and the
        documents' runs of as many.
        """
        ranked = kept(self.best(queries, k).select("query", "id", "rank"), "ranked")
        left = queries.filter(F.trim("text") != "").join(ranked.select("query").distinct(), "query", "left_anti").select("query", F.lower("text").alias("text"))
        left = left.withColumn("size", F.least(F.length("text"), F.lit(3))).withColumn("gram", F.expr("substring(text, 1, size)"))
        shown = self.documents().select("id", F.explode(F.split(F.lower("shown"), "\n")).alias("shown"))
        sizes = F.filter(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda n: n <= F.length("shown"))
        grams = F.array_distinct(F.flatten(F.transform(sizes, lambda n: F.transform(F.sequence(F.lit(1), F.length("shown") - n + 1), lambda i: F.substring(F.col("shown"), i, n)))))
        hit = shown.select("id", "shown", F.explode(grams).alias("gram")).join(left, "gram").filter(F.col("shown").contains(F.col("text"))).select("query", "id").distinct()
        order = Window.partitionBy("query").orderBy("id")
        hit = hit.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        return ranked.unionByName(hit)
