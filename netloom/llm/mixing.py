"""Mixing sources to target weights by hash-random keys, range order, distributed prefix sums and exact cuts.

Every row gets a hash-random key; rows of a source stand in key order; a source's budget is a number of whole
epochs and a remainder, and the remainder is cut in key order at exactly the budgeted word.

Defined results: a null text has size 0; a null source is a source of its own, after all others; rows repeated with
the same id and text share a key and are interchangeable; an empty table gives an empty result; a source without
words has target 0 and takes nothing. Input columns that share a name with an output are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.llm.common import WORD, n_words, text_of, without

#: Weights of the sources, by code point order of their names, repeating.
WEIGHTS = (1, 2, 3)
#: No document is taken more often.
MAX_EPOCHS = 3
#: Bits of the key that name a bucket: a source's rows are ordered inside 4096 buckets, never all in one task.
BUCKET_BITS = 12
KEY_BITS = 60


def _key(id_col: str, text: Column, seed: str) -> Column:
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(":"), F.md5(text))
    return F.conv(F.substring(F.md5(name), 1, KEY_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_EPOCHS) -> DataFrame:
    """From one row a source (source, source_size): adds target. A level is raised in proportion to the weights
    until the targets share out the sum of all sizes; a source stops at `most` times its size.

    One row for each source passes through one task here; documents never do.
    """
    everything = Window.partitionBy(F.lit(0))
    cycle = F.array(*[F.lit(w) for w in weights])
    nth = F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1
    x = sizes.withColumn("weight", F.element_at(cycle, (nth % len(weights) + 1).cast("int")).cast("long"))
    x = x.withColumn("total", F.sum("source_size").over(everything)).withColumn("weights", F.sum("weight").over(everything))
    x = x.withColumn("full_at", F.lit(float(most)) * F.col("source_size") / F.col("weight"))
    before = everything.orderBy("full_at", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("left", F.col("total") - F.coalesce(F.sum(most * F.col("source_size")).over(before), F.lit(0)))
    x = x.withColumn("open", F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    x = x.withColumn("level", F.col("left").cast("double") / F.col("open"))
    level = F.min(F.when(F.col("full_at") >= F.col("level"), F.struct("full_at", "level"))).over(everything)["level"]
    return x.select("source", "source_size", F.coalesce(F.least(F.lit(float(most)) * F.col("source_size"), level * F.col("weight")), F.lit(0.0)).alias("target"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix") -> DataFrame:
    """docs with size, source_size, target and taken: the words the mix takes from each row, repeats counted.

    Shuffles: sums by (source, bucket), pre-aggregated, and the rows once by (source, bucket). A hot source is
    spread over all its buckets; prefix sums of buckets give each bucket its start.
    """
    text = text_of(text_col)
    own = without(docs, "size", "source_size", "target", "taken")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in own.columns]).alias("row"), F.col(source_col).alias("source"), n_words(text).alias("size"), _key(id_col, text, seed).alias("key"))
    keyed = keyed.withColumn("bucket", F.shiftright("key", KEY_BITS - BUCKET_BITS))
    sums = keyed.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    goal = targets(sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size")))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("start", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)))
    plan = starts.alias("s").join(goal.alias("g"), F.col("s.source").eqNullSafe(F.col("g.source"))).select(F.col("s.source").alias("plan_source"), F.col("s.bucket").alias("plan_bucket"), "start", "source_size", "target")
    plan = plan.withColumn("words", F.floor("target").cast("long"))
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("words div source_size")).otherwise(F.lit(0)).cast("long"))
    plan = plan.withColumn("rest", F.col("words") - F.col("epochs") * F.col("source_size"))
    x = keyed.join(plan, F.col("source").eqNullSafe(F.col("plan_source")) & (F.col("bucket") == F.col("plan_bucket")))
    inside = Window.partitionBy("source", "bucket").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("at", F.col("start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("at")))
    taken = (F.col("epochs") * F.col("size") + part).cast("long")
    return x.select("row.*", "size", "source_size", "target", taken.alias("taken"))


def drawn(mix: DataFrame, text_col: str = "text") -> DataFrame:
    """The mix itself, from the rows of mixed(): a row for each epoch it is taken in, and the document at the exact
    cut once more with the words up to the cut. Columns of the input only; n_chars, if there, follows the text."""
    whole = F.when(F.col("size") > 0, F.expr("taken div size")).otherwise(F.lit(0))
    cut = F.col("taken") - whole * F.col("size")
    x = mix.withColumn("__cut", F.explode(F.concat(F.array_repeat(F.lit(0).cast("long"), whole.cast("int")), F.when(cut > 0, F.array(cut)).otherwise(F.array().cast("array<bigint>")))))
    words = F.filter(F.split(F.translate(text_of(text_col), "\t\n\x0b\x0c\r", "     "), " ", -1), lambda w: w != "")
    x = x.withColumn(text_col, F.when(F.col("__cut") > 0, F.array_join(F.slice(words, F.lit(1), F.col("__cut").cast("int")), " ")).otherwise(F.col(text_col)))
    if "n_chars" in mix.columns:
        x = x.withColumn("n_chars", F.when(F.col("__cut") > 0, F.length(text_col).cast("long")).otherwise(F.col("n_chars")))
    return x.drop("__cut", "size", "source_size", "target", "taken")


SQL = rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size,
  CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM d GROUP BY source),
f AS (SELECT *, 3.0::DOUBLE * source_size / weight AS full_at, CAST(sum(source_size) OVER () AS BIGINT) AS total, CAST(sum(weight) OVER () AS BIGINT) AS weights FROM s),
l AS (SELECT *, CAST(total - coalesce(sum(3 * source_size) OVER w, 0) AS DOUBLE) / CAST(weights - coalesce(sum(weight) OVER w, 0) AS DOUBLE) AS level
  FROM f WINDOW w AS (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT arg_min(level, full_at) AS level FROM l WHERE full_at >= level),
t AS (SELECT source, source_size, least(3.0::DOUBLE * source_size, v.level * weight) AS target FROM l, v),
p AS (SELECT d.*, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS words,
  coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, CASE WHEN source_size > 0 THEN words // source_size ELSE 0 END AS epochs FROM p)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, words - epochs * source_size - pos)) AS BIGINT) AS taken FROM q
"""
