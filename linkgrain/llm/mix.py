"""Operator 7: mixing sources to target weights, DataFrame functions only.

Documents are permuted by a hash within their source and cut into blocks of
consecutive hash ranges.  A source's target in words asks for whole passes over
its blocks and a part of one more; the pass and block pairs are its exact block
quota.  A splitting tree deals the quotas of all sources to the output shards:
each node parts its blocks into two halves by a multivariate hypergeometric
draw, so a leaf holds what an urn drawn without replacement would give it.  A
leaf takes a range of each source's permuted block pairs that no other leaf
takes, and its rows are shuffled within the shard.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

WORD = "[^\\x20\\x09-\\x0D]+"
WEIGHTS = (1.0, 2.0, 3.0)
MOST = 3
BLOCK_ROWS = 2000
HASH_SPACE = 1 << 60


def unit_hash(seed: str, *cols: Column) -> Column:
    """60 bits of MD5 as a long; any engine with MD5 gives the same."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """A row per source: words, rows, weight, target, block count.

    Input: ``_source``, ``_size``.  Sources in code point order, null last, get
    ``weights`` in turn.  Targets share all words by weight, stop at ``most``
    times the source's words, and the excess is shared again: the level at
    which the capped shares add up to all words.  The windows run over one row
    a source, never over documents.
    """
    per = sizes.groupBy("_source").agg(F.sum("_size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    rank = F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last())) - 1
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int")))
    per = per.withColumn("_cap", F.col("source_size") * float(most)).withColumn("_level", F.col("_cap") / F.col("weight"))
    up = Window.orderBy("_level", F.col("_source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy("_level", F.col("_source").asc_nulls_last()).rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1))
    per = (
        per.withColumn("_all", F.sum("source_size").over(everything))
        .withColumn("_share", (F.col("_all") - F.coalesce(F.sum("_cap").over(up), F.lit(0.0))) / F.sum("weight").over(rest))
        .withColumn("_water", F.max(F.when(F.col("_share") <= F.col("_level"), F.col("_share"))).over(everything))
        .withColumn("target", F.least(F.col("_cap"), F.col("_water") * F.col("weight")))
    )
    return per.select(
        "_source", "source_size", "source_rows", "weight", F.coalesce("target", F.lit(0.0)).alias("target"),
        F.round(F.coalesce("target", F.lit(0.0))).cast("long").alias("target_words"),
        F.greatest(F.lit(1), F.ceil(F.col("source_rows") / block_rows)).cast("long").alias("n_blocks"),
    )


def _let(body, **values: Column) -> Column:
    """``body`` of the named values, each computed once."""
    bound = F.array(F.struct(*[v.alias(k) for k, v in values.items()]))
    return F.element_at(F.transform(bound, body), 1)


def _hypergeometric(total: Column, good: Column, draws: Column, u: Column) -> Column:
    """How many of ``good`` among ``draws`` of ``total``, by inverse distribution at ``u``.

    Weights are relative to the mode and cover 12 standard deviations to either
    side, beyond which less than 1e-30 lies.
    """

    def bounds(p: Column) -> Column:
        low, high = F.greatest(F.lit(0.0), p["d"] + p["g"] - p["t"]), F.least(p["g"], p["d"])
        mode = F.floor((p["d"] + 1) * (p["g"] + 1) / (p["t"] + 2)).cast("double")
        spread = F.ceil(12 * F.sqrt(p["d"] * (p["g"] / p["t"]) * (1 - p["g"] / p["t"])) + 12).cast("double")
        return _let(lambda q: walk(p, q), low=low, high=high, mode=F.least(high, F.greatest(low, mode)), spread=spread)

    def walk(p: Column, q: Column) -> Column:
        def ratio(k: Column) -> Column:  # p(k + 1) / p(k)
            return (p["g"] - k) * (p["d"] - k) / ((k + 1) * (p["t"] - p["g"] - p["d"] + k + 1))

        def chain(steps: Column, factor) -> Column:
            return F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), steps.cast("int"))), F.array(F.lit(1.0)), lambda acc, i: F.when(i > steps, acc).otherwise(F.concat(acc, F.array(F.element_at(acc, -1) * factor(i)))))

        first = F.greatest(q["low"], q["mode"] - q["spread"])
        down = chain(q["mode"] - first, lambda i: 1 / ratio(q["mode"] - i))
        up = chain(F.least(q["high"], q["mode"] + q["spread"]) - q["mode"], lambda i: ratio(q["mode"] + i - 1))
        weights = F.concat(F.reverse(F.slice(down, F.lit(2), F.size(down))), up)
        return _let(lambda r: first + place(r["w"], p["u"] * F.aggregate(r["w"], F.lit(0.0), lambda s, x: s + x)), w=weights)

    def place(weights: Column, mass: Column) -> Column:
        """How many leading weights stay below the mass."""
        return F.aggregate(
            weights,
            F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("k")),
            lambda acc, x: F.struct((acc["s"] + x).alias("s"), F.when(acc["s"] + x < mass, acc["k"] + 1).otherwise(acc["k"]).alias("k")),
            lambda acc: F.least(acc["k"], F.size(weights) - 1),
        )

    drawn = _let(bounds, t=total.cast("double"), g=good.cast("double"), d=draws.cast("double"), u=u)
    return F.when((good <= 0) | (draws <= 0), F.lit(0.0)).when(draws >= total, good.cast("double")).otherwise(drawn).cast("long")


def split_quotas(quotas: DataFrame, shards: int, seed: str) -> DataFrame:
    """(shard, _source, first, count): each leaf's range of every source's permuted block pairs.

    ``quotas``: ``_source``, ``quota``.  A level of the tree halves each node's
    shards; source by source, in order, the left half's share of the quota is
    hypergeometric given what is left of the node and of the left half.
    """
    order = Window.orderBy(F.col("_source").asc_nulls_last())
    node = quotas.withColumn("_at", F.row_number().over(order)).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_at", F.struct("_source", F.col("quota").alias("n"), F.lit(0).cast("long").alias("first")).alias("q")))), lambda x: x["q"]).alias("qs")
    )
    node = node.withColumn("lo", F.lit(0)).withColumn("hi", F.lit(shards))
    zero = F.lit(0).cast("long")
    for level in range(max(0, math.ceil(math.log2(max(1, shards))))):
        mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        total = F.aggregate("qs", zero, lambda s, q: s + q["n"])
        left = F.floor(total * ((mid - F.col("lo")) / (F.col("hi") - F.col("lo")))).cast("long")
        empty = F.expr("cast(array() as array<bigint>)")

        def draw(acc, q):
            u = (unit_hash(f"{seed}-{level}", F.col("lo"), q["_source"], q["first"]) + F.lit(0.5)) / float(HASH_SPACE)
            got = _hypergeometric(acc["rest"], q["n"], acc["want"], u)
            return F.struct((acc["rest"] - q["n"]).alias("rest"), (acc["want"] - got).alias("want"), F.concat(acc["out"], F.array(got)).alias("out"))

        drawn = F.aggregate("qs", F.struct(total.alias("rest"), left.alias("want"), empty.alias("out")), draw, lambda acc: acc["out"])
        wide = F.col("hi") - F.col("lo") > 1
        node = node.withColumn("_out", F.when(wide, drawn)).select(
            F.explode(
                F.when(
                    wide,
                    F.array(
                        F.struct(F.col("lo").alias("lo"), mid.alias("hi"), F.zip_with("qs", "_out", lambda q, n: F.struct(q["_source"].alias("_source"), n.alias("n"), q["first"].alias("first"))).alias("qs")),
                        F.struct(mid.alias("lo"), F.col("hi").alias("hi"), F.zip_with("qs", "_out", lambda q, n: F.struct(q["_source"].alias("_source"), (q["n"] - n).alias("n"), (q["first"] + n).alias("first"))).alias("qs")),
                    ),
                ).otherwise(F.array(F.struct("lo", "hi", "qs")))
            ).alias("x")
        ).select("x.*")
    return node.select(F.col("lo").alias("shard"), F.explode("qs").alias("q")).select("shard", "q._source", "q.first", F.col("q.n").alias("count")).filter("count > 0")


def mix_sources(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, most: int = MOST, block_rows: int = BLOCK_ROWS, words_per_shard: int = 2_000_000, max_shards: int | None = None, seed: str = "mix") -> DataFrame:
    """A row per input row: id, source, size, source_size, target, taken, placements.

    ``size`` counts the words of the whole text (null text: 0).  ``placements``
    holds a struct (epoch, shard, words) for each copy the mix takes, at most
    ``most``; ``taken`` adds up their words.  The last copy of one document of
    each source may be cut so that the source meets its rounded target exactly.

    Defined results: a null source is a source of its own, last in order; empty
    texts have size 0 and take 0 words; with no words at all every target is 0;
    an empty table gives an empty table; repeated rows each count and are told
    apart only by their place, ties in the permutation going by id and size;
    columns that the input has besides the three are not read.  Ids may be null.
    Shards grow in number with the words, about ``words_per_shard`` each, up to
    ``max_shards`` where that is given.
    """
    sizes = docs.select(
        F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("_source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("_size"),
        # Rows without an id are told apart, and dealt over the blocks, by their text.
        F.when(F.col(id_col).isNull(), F.xxhash64(text_col)).alias("_t"),
    )
    sizes = written(sizes.withColumn("_h", F.when(F.col("_id").isNotNull(), unit_hash(seed, F.col("_id"))).otherwise(unit_hash(seed, F.col("_t")))).drop("_t"), "mix-sizes")
    sources = written(source_targets(sizes, weights, most, block_rows), "mix-sources")
    same = lambda a, b: a["_source"].eqNullSafe(b["_source"])
    block = F.least(F.col("n_blocks") - 1, F.floor(F.col("_h").cast("double") / float(HASH_SPACE) * F.col("n_blocks"))).cast("long")
    placed = sizes.join(F.broadcast(sources) if sources.count() <= 10_000 else sources, same(sizes, sources)).drop(sources["_source"]).withColumn("_block", block)
    blocks = placed.groupBy("_source", "_block").agg(F.sum("_size").alias("_words"), F.max("source_size").alias("_total"), F.max("target_words").alias("_target"))
    before = Window.partitionBy("_source").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_words").over(before), F.lit(0)))
    epochs = F.sequence(F.lit(0).cast("long"), F.lit(most - 1).cast("long"))
    start = F.col("_before") + F.col("_epoch") * F.col("_total")
    pairs = blocks.select("*", F.explode(epochs).alias("_epoch")).filter((F.col("_words") > 0) & (start < F.col("_target")))
    pairs = written(pairs.withColumn("_share", F.least(F.col("_words"), F.col("_target") - start)), "mix-pairs")
    # Permuted places of a source's pairs: ranks of a hash.
    place = F.row_number().over(Window.partitionBy("_source").orderBy(unit_hash(seed + "-pairs", F.col("_source"), F.col("_epoch"), F.col("_block")), "_epoch", "_block")) - 1
    words = pairs.agg(F.sum("_share")).first()[0] or 0
    shards = 1 << math.ceil(math.log2(max(1.0, words / words_per_shard)))
    shards = shards if max_shards is None else max(1, min(max_shards, shards))
    leaves = written(split_quotas(pairs.groupBy("_source").agg(F.count(F.lit(1)).alias("quota")), shards, seed), "mix-leaves")
    ranked = pairs.withColumn("_place", place)
    # Each leaf's range, expanded to its places: a row per pair, so this equals the quota exactly.
    leaf_places = leaves.select(F.col("_source").alias("_ls"), "shard", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("count") - 1)).alias("_lp"))
    dealt = ranked.join(leaf_places, ranked["_source"].eqNullSafe(F.col("_ls")) & (F.col("_place") == F.col("_lp")))
    dealt = dealt.groupBy("_source", "_block").agg(F.max("_before").alias("_b0"), F.array_sort(F.collect_list(F.struct(F.col("_epoch").alias("epoch"), "shard"))).alias("_deals"))
    dealt = dealt.select(F.col("_source").alias("_ds"), F.col("_block").alias("_db"), "_b0", "_deals")
    placed = placed.join(dealt, placed["_source"].eqNullSafe(F.col("_ds")) & (placed["_block"] == F.col("_db")), "left")
    inside = Window.partitionBy("_source", "_block").orderBy("_h", "_id", "_size").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("_start", F.coalesce("_b0", F.lit(0)) + F.coalesce(F.sum("_size").over(inside), F.lit(0)))
    copies = F.filter(
        F.transform(
            F.coalesce("_deals", F.expr("cast(array() as array<struct<epoch:bigint,shard:int>>)")),
            lambda d: F.struct(d["epoch"].alias("epoch"), d["shard"].alias("shard"), F.greatest(F.lit(0), F.least(F.col("_size"), F.col("target_words") - d["epoch"] * F.col("source_size") - F.col("_start"))).cast("long").alias("words")),
        ),
        lambda d: d["words"] > 0,
    )
    return placed.withColumn("placements", copies).select(
        F.col("_id").alias("doc_id"), F.col("_source").alias("source"), F.col("_size").alias("size"), "source_size", "target",
        F.aggregate("placements", F.lit(0).cast("long"), lambda s, d: s + d["words"]).alias("taken"), "placements",
    )


def mixed_rows(plan: DataFrame, seed: str = "mix") -> DataFrame:
    """A row per copy: doc_id, shard, position within the shard's local shuffle, epoch, words."""
    rows = plan.select("doc_id", "source", F.explode("placements").alias("p")).select("doc_id", "source", "p.shard", "p.epoch", "p.words")
    key = unit_hash(seed + "-rows", F.col("doc_id"), F.col("epoch"))
    return rows.withColumn("position", F.row_number().over(Window.partitionBy("shard").orderBy(key, "doc_id", "epoch")))
