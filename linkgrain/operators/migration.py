"""Older annotations to markers: the class of each field, of each annotation, the plan and its counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import slug, type_of, valid_id

# Classes from the least to the most that a reviewer must see.
CLASSES = ("dropped", "deterministic", "high_confidence", "derived", "requires_review")
INTENT = ("requirement", "nfr", "goal", "prd")
REWRITTEN = ("deterministic", "high_confidence")


def resolved_spec(value: Column) -> Column:
    """The id of a requirement in a ``spec`` value: what follows its last ``#``, where that is one; else null."""
    own = F.trim(F.element_at(F.split(value, "#"), -1))
    return F.when(valid_id(own) & type_of(own).isin(*INTENT), own)


def is_test(path: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return F.exists(F.split(path, "/"), lambda p: p.isin("tests", "test")) | name.startswith("test_") | name.rlike(r"_test\.")


def node_type(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(is_test(path), "test").when(ext.isin("md", "markdown", "rst", "txt"), "document").when(ext.isin("yaml", "yml", "json", "toml"), "config").when(ext == "sh", "operation").otherwise("implementation")


def is_source(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin("py", "pyi", "ts", "tsx", "mts", "cts", "js", "jsx", "mjs", "cjs", "go", "rs", "java", "c", "h", "cpp", "cc", "cxx", "hpp", "sh", "bash", "zsh", "sql")


def classified(fields: DataFrame) -> DataFrame:
    """Fields (path, line, key, value) with ``class``, and ``p`` and ``t`` of the edge that a field gives."""
    key, value = F.col("key"), F.col("value")
    spec = resolved_spec(value)
    tied = key.isin("work_item", "plan") & valid_id(value)
    kind = (
        F.when(F.coalesce(value, F.lit("")) == "", "dropped").when(tied, "deterministic")
        .when((key == "spec") & spec.isNotNull() & (is_test(F.col("path")) | is_source(F.col("path"))), "high_confidence")
        .when(key == "commit", "derived").otherwise("requires_review")
    )
    rows = fields.withColumn("class", kind)
    p = F.when(key == "work_item", "work").when(key == "plan", "implements").when(is_test(F.col("path")), "verifies").otherwise("satisfies")
    own = F.col("class").isin(*REWRITTEN)
    return rows.withColumn("p", F.when(own, p)).withColumn("t", F.when(own, F.when(key == "spec", spec).otherwise(value)))


def plan(fields: DataFrame) -> DataFrame:
    """One row an annotation: path, line, class, edges, base (of the id that its marker would have).

    The class is the highest of the fields that give edges, whatever the others
    are; without such fields, the highest of those that are not dropped.
    """
    rows = classified(fields)
    rank = F.coalesce(*[F.when(F.col("class") == c, n) for n, c in enumerate(CLASSES)])
    rows = rows.withColumn("rank", rank).withColumn("edge", F.when(F.col("p").isNotNull(), F.struct("p", "t")))
    per = rows.groupBy("path", "line").agg(
        F.max(F.when(F.col("p").isNotNull(), F.col("rank"))).alias("tied"), F.max("rank").alias("most"),
        F.array_sort(F.collect_set("edge")).alias("edges"), F.min_by("t", F.when(F.col("p").isNotNull(), F.array_position(F.array(*[F.lit(x) for x in ("work_item", "plan", "spec")]), F.col("key")))).alias("source"),
    )
    kind = F.element_at(F.array(*[F.lit(c) for c in CLASSES]), (F.coalesce("tied", "most") + 1).cast("int"))
    prefix = F.when(node_type(F.col("path")) == "test", "test.").when(node_type(F.col("path")) == "document", "doc.").when(node_type(F.col("path")) == "config", "config.").when(node_type(F.col("path")) == "operation", "ops.").otherwise("impl.")
    base = F.when(F.col("source").isNotNull(), F.concat(prefix, slug(F.col("source"))))
    return per.select("path", "line", kind.alias("class"), "edges", base.alias("base"))


def unresolved(fields: DataFrame) -> DataFrame:
    """(path, line, value) of ``spec`` fields without a requirement."""
    return fields.filter((F.col("key") == "spec") & (F.coalesce("value", F.lit("")) != "") & resolved_spec(F.col("value")).isNull()).select("path", "line", "value")


def summary(planned: DataFrame) -> DataFrame:
    """(class, n): annotations of every class, 0 where there are none."""
    dims = planned.sparkSession.createDataFrame([(c,) for c in CLASSES], "class string")
    return dims.join(planned.groupBy("class").agg(F.count(F.lit(1)).alias("n")), "class", "left").select("class", F.coalesce("n", F.lit(0)).alias("n"))


def per_file(planned: DataFrame) -> DataFrame:
    """Per path: annotations by class, and how many lines the plan rewrites."""
    counts = planned.groupBy("path").pivot("class", list(CLASSES)).agg(F.count(F.lit(1))).fillna(0)
    rewritten = planned.filter(F.col("class").isin(*REWRITTEN) & F.col("base").isNotNull()).groupBy("path").agg(F.count(F.lit(1)).alias("rewritten"))
    return counts.join(rewritten, "path", "left").fillna(0, ["rewritten"])
