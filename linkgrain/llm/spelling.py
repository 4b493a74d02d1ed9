"""Operator 13: spelling variant grouping by Aho-Corasick automata over the halves of words.

One inserted, deleted or replaced code point leaves one half of a word as it is:
the first at the start of its variant, or the second at its end.  Shards of
automata hold both halves of every word; every word is scanned by the shards of
the four halves that a variant of its length can have, and a half counts where it
stands at the start or end that it belongs to and its word's length differs by
one at most.  What is left of the word is then verified against what is left of
all words that own the half at once, through tables of rests with one code point
open, so a half that very many words own costs their lengths, not their product.
A shard beyond its size is dealt as a grid of owners and scanned words.

A shard counts a word's variants and keeps the most frequent one, so no pair
leaves it.
"""

from __future__ import annotations

import math

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, written
from .fingerprints import LOWER, UPPER

#: Letters of a word: fixed by the contract, A-Z, a-z and U+00C0 to U+00FF.
LETTERS = "A-Za-zÀ-ÿ"
SHARD_ROWS = 20_000
#: Rests of more code points have their variants hashed instead of written out.
LONG = 64
_OPEN = "\0"
_FOUND = "word string, n_near long, form_n long, form string"


def misspelt_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 31, least: int = 7) -> DataFrame:
    """(word, n) of all runs of letters with at least ``least`` code points, one code point deleted where ``every`` divides the hash."""
    run = F.explode(F.regexp_extract_all(F.col("_text"), F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0)))
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"), F.col(text_col).alias("_text")).select("_id", run.alias("run")).withColumn("run", F.translate("run", UPPER, LOWER))
    h = F.crc32(F.concat("_id", F.lit(":"), "run"))
    at = (F.col("h") % F.length("run")).cast("int")
    word = F.when(F.col("h") % every == 0, F.concat(F.substring(F.col("run"), 1, at), F.substring(F.col("run"), at + 2, F.length("run")))).otherwise(F.col("run"))
    return runs.withColumn("h", h).select(word.alias("word")).filter(F.length("word") >= least).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def routes(words: DataFrame, shards: int) -> DataFrame:
    """(word, n, shard, side, owns): a word by the halves that it and its variants can have; ``owns`` where it is its own."""
    n = F.length("word")
    short, long = F.floor((n - 1) / 2).cast("int"), F.floor((n + 1) / 2).cast("int")
    half = F.floor(n / 2).cast("int")
    firsts = F.transform(F.array_distinct(F.array(short, half, long)), lambda k: F.struct(F.lit("<").alias("side"), F.substring(F.col("word"), F.lit(1), k).alias("half"), (k == half).alias("owns")))
    rest = lambda k: (k - F.floor(k / 2)).cast("int")
    lasts = F.transform(F.array_distinct(F.array(rest(n - 1), rest(n), rest(n + 1))), lambda k: F.struct(F.lit(">").alias("side"), F.substring(F.col("word"), n - k + 1, k).alias("half"), (k == rest(n)).alias("owns")))
    dealt = words.select("word", "n", F.explode(F.concat(firsts, lasts)).alias("r"))
    return dealt.select("word", "n", F.pmod(F.xxhash64("r.side", "r.half"), F.lit(shards)).alias("shard"), "r.side", "r.owns")


def _deletions(rest: str) -> list:
    """``rest`` less one code point, each different result once."""
    if len(rest) <= LONG:
        return [rest[:i] + rest[i + 1 :] for i in range(len(rest)) if not i or rest[i] != rest[i - 1]]
    head, power = _rolled(rest)
    n = len(rest)
    return [(n - 1, (head[i] * power[n - 1 - i] + head[n] - head[i + 1] * power[n - 1 - i]) % _MOD) for i in range(n) if not i or rest[i] != rest[i - 1]]


def _openings(rest: str) -> list:
    """``rest`` with one code point open, for each place."""
    if len(rest) <= LONG:
        return [rest[:i] + _OPEN + rest[i + 1 :] for i in range(len(rest))]
    head, power = _rolled(rest)
    n = len(rest)
    return [(n, i, (head[n] - ord(rest[i]) * power[n - 1 - i]) % _MOD) for i in range(n)]


def _whole(rest: str, like: str):
    """The key of ``rest`` among the deletions of ``like``, a rest longer by one."""
    return rest if len(like) <= LONG else (len(rest), _rolled(rest)[0][-1])


_MOD, _BASE = (1 << 61) - 1, 911382323


def _rolled(rest: str) -> tuple[list[int], list[int]]:
    head, power = [0], [1]
    for c in rest:
        head.append((head[-1] * _BASE + ord(c)) % _MOD)
        power.append(power[-1] * _BASE % _MOD)
    return head, power


def differ_by_one(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced code point turns ``a`` into ``b``."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]


def _near_in_shard(table: pa.Table) -> pa.Table:
    """A row of _FOUND for each scanned word of a shard that has near words among the shard's owners."""
    rows = list(zip(*(table[c].to_pylist() for c in ("word", "n", "side", "owns", "scanned")), strict=True))
    owners = sorted({(-n, w, side) for w, n, side, owns, _ in rows if owns})  # the first of several near words is the form
    halves: dict[str, tuple[list[int], list[int]]] = {}
    for k, (_, w, side) in enumerate(owners):
        h = len(w) // 2
        halves.setdefault(w[:h] if side == "<" else w[h:], ([], []))[side == ">"].append(k)
    automaton = ahocorasick.Automaton()
    for half in halves:
        automaton.add_word(half, half)
    hits: dict[tuple[str, bool], list[str]] = {}
    if halves:
        automaton.make_automaton()
        for w in sorted({w for w, _, _, _, scanned in rows if scanned}):
            n = len(w)
            for end, half in automaton.iter(w):
                k = len(half)
                if end + 1 == k and (n - 1) // 2 <= k <= (n + 1) // 2 and halves[half][0]:
                    hits.setdefault((half, True), []).append(w)
                if end + 1 == n and n // 2 <= k <= (n + 2) // 2 and halves[half][1]:
                    hits.setdefault((half, False), []).append(w)
    near: dict[str, list[int]] = {}
    for (half, first), scanned in hits.items():
        _verify(half, first, scanned, [(k, owners[k][1]) for k in halves[half][not first]], near)
    best = {w: min(found) for w, found in near.items()}
    return pa.table({"word": pa.array(list(near), pa.string()), "n_near": pa.array([len(v) for v in near.values()], pa.int64()), "form_n": pa.array([-owners[k][0] for k in best.values()], pa.int64()), "form": pa.array([owners[k][1] for k in best.values()], pa.string())})


def _verify(half: str, first: bool, scanned: list[str], owners: list[tuple[int, str]], near: dict[str, list[int]]) -> None:
    """Adds to ``near`` the owners of one half that differ by one from the scanned words that hold it."""
    k = len(half)
    cut = (lambda w: w[k:]) if first else (lambda w: w[: len(w) - k])
    opened, whole, shorter = {}, {}, {}
    lengths = {len(w) for w in scanned}
    for i, p in owners:
        rest = cut(p)
        if len(p) in lengths:
            for key in _openings(rest):
                opened.setdefault(key, []).append(i)
        if len(p) + 1 in lengths:
            whole.setdefault(_whole(rest, rest + " "), []).append(i)
        if len(p) - 1 in lengths:
            for key in _deletions(rest):
                shorter.setdefault(key, []).append(i)
    word = dict(owners)
    for w in scanned:
        rest = cut(w)
        found = [i for key in _openings(rest) for i in opened.get(key, ())] if opened else []
        if whole:
            found += [i for key in _deletions(rest) for i in whole.get(key, ())]
        if shorter:
            found += shorter.get(_whole(rest, rest + " "), ())
        for i in found:
            p = word[i]
            # A word that holds both halves of an owner was found by the first.
            if p != w and differ_by_one(w, p) and (first or not w.startswith(p[: len(p) // 2])):
                near.setdefault(w, []).append(i)


def near_words(words: DataFrame, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, DataFrame]:
    """(word, n_near, form_n, form) of words (word, n; each once) that have near words; form: the most frequent near word, ties to the smallest.

    The second is the scratch table that the first reads.
    """
    shards = max(1, math.ceil(4 * words.count() / shard_rows))
    dealt = routes(words, shards)
    sizes = dealt.groupBy("shard").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 2 * shard_rows).select("shard", F.ceil(F.col("rows") / shard_rows).cast("int").alias("parts"))
    sizes = written(sizes, "spelling-shards")  # at most half as many rows as there are shards
    dealt = dealt.join(F.broadcast(sizes), "shard", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    everything = F.sequence(F.lit(0), F.col("parts") - 1)
    owner = F.transform(everything, lambda j: F.struct(own.alias("part"), j.alias("block"), F.lit(True).alias("owns"), (own == j).alias("scanned")))
    scanned = F.transform(everything, lambda i: F.struct(i.alias("part"), own.alias("block"), F.lit(False).alias("owns"), F.lit(True).alias("scanned")))
    cells = dealt.select("shard", "word", "n", "side", F.explode(F.when(F.col("owns"), F.concat(owner, F.filter(scanned, lambda c: c["part"] != c["block"]))).otherwise(scanned)).alias("c")).select("shard", "c.part", "c.block", "word", "n", "side", "c.owns", "c.scanned")
    found = cells.groupBy("shard", "part", "block").applyInArrow(_near_in_shard, _FOUND)
    best = F.min(F.struct((-F.col("form_n")).alias("n"), F.col("form").alias("w")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.n")).alias("form_n"), F.col("b.w").alias("form")), sizes


def variant_groups(words: DataFrame, ratio: int = 10, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """A row per word of ``words`` (word, n; each once): word, n, n_near, form, form_n, root.

    Form: the most frequent word that differs by one code point (ties: the
    smallest in code-point order) if it is at least ``ratio`` times as frequent.
    A root follows forms to the last, in rounds that double the way; as each form
    is ``ratio`` times as frequent, there are few.

    Defined results: a word without near words has n_near 0, form and form_n
    null and itself as root; an empty table gives an empty table; other columns
    are not read.  Null words must not be given.
    """
    words = written(words.select("word", "n"), "spelling-words")
    near, sizes = near_words(words, shard_rows)
    enough = F.col("form_n") >= ratio * F.col("n")
    joined = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("form")).alias("form"), F.when(enough, F.col("form_n")).alias("form_n"))
    joined = written(joined, "spelling-forms")
    released(words, sizes)
    roots = written(joined.filter("form is not null").select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        step = roots.join(roots.select(F.col("word").alias("root"), F.col("root").alias("_further")), "root", "left")
        step = written(step.select("word", F.coalesce("_further", "root").alias("root"), F.col("_further").isNotNull().alias("moved")), "spelling-roots")
        moved = step.filter("moved").limit(1).count()
        released(roots)
        roots = step.select("word", "root")
        roots.scratch_path = step.scratch_path
        if not moved:
            break
    return joined.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_count: int = 2) -> DataFrame:
    """``variant_groups`` of the words of ``docs`` that occur at least ``least_count`` times.

    Defined results beside those of ``variant_groups``: null and empty texts have
    no words; a null id counts as an empty one; repeated rows count each; a run of
    any length is one word; no words give an empty table; other columns are not
    read.
    """
    return variant_groups(misspelt_words(docs, id_col, text_col).filter(F.col("n") >= least_count))
