"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source gets a budget of words. Whole epochs over the source come first; what is left of the budget goes to the
documents with the smallest exponential keys, scaled by quality: a prefix sum over the sorted source is cut at the budget.
Sorting a source is spread over buckets of the key, so a source with a third of all rows is many small sorts; only bucket
totals are summed per source. No Python runs on executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldpulse.session import cut_lineage

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_EPOCHS = 2
BUCKET_ROWS = 4000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def plainness(text: Column, size: Column) -> Column:
    """Quality weight in (0, 1]: falls with digits and markup per word."""
    marks = F.coalesce(F.regexp_count(text, F.lit("[#*$%&|<>0-9]")), F.lit(0))
    return (size + 1).cast("double") / (size + 1 + marks)


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on the key and the seed only."""
    digits = F.substring(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f"/{seed}"))), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 1) / F.lit(2.0 ** 48 + 1)


def budgets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE,
            most: float = MOST_EPOCHS) -> DataFrame:
    """Add ``target`` to (source, n_rows, source_size), one row per source.

    Weights repeat over the sources in code-point order, null last. A source takes ``most`` times its size at most; the
    excess is shared again by weight until nobody is above. That end point has a closed form: in order of size per weight,
    the first sources are full and all others sit at one common level per unit of weight.
    """
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    place = ((F.row_number().over(in_order) - 1) % len(weights)) + 1
    placed = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place)).withColumn(
        "cap", most * F.col("source_size").cast("double"))
    placed = placed.withColumn("full_at", F.col("cap") / F.col("weight"))
    by_level = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_level.rowsBetween(0, Window.unboundedFollowing)
    everyone = Window.partitionBy()
    level = (share * F.sum("source_size").over(everyone).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
             ) / F.sum("weight").over(rest)
    leveled = placed.withColumn("level", level)
    common = F.max(F.when(F.col("level") < F.col("full_at"), F.col("level"))).over(everyone)
    target = F.least(F.col("cap"), F.coalesce(common * F.col("weight"), F.col("cap")))
    return leveled.withColumn("target", target).select("source", "n_rows", "source_size", "target")


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", quality: Column | None = None,
        weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS, seed: int = 1,
        bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """All columns of ``docs`` and __size, __source_size, __target, __taken (words taken, repeats counted).

    Null texts have no words; null is a source of its own; documents without words are never taken in part. Rows repeated
    with one key share a random number and are ordered by size, so reruns agree as a set of rows. The document at the edge
    of a budget is taken if more than half of it fits. Empty tables give no rows.
    """
    size = word_count(F.col(text))
    sized = docs.withColumn("__size", size).withColumn(
        "__key", -F.log(uniform(F.col(key), seed)) / (plainness(F.col(text), F.col("__size")) if quality is None else quality))
    sizes = sized.groupBy(F.col(source).alias("source")).agg(
        F.count("*").alias("n_rows"), F.sum("__size").alias("source_size"))
    plan = cut_lineage(budgets(sizes, weights, share, most)).select(
        F.col("source").alias("__source"), F.col("n_rows").alias("__n_rows"), F.col("source_size").alias("__source_size"),
        F.col("target").alias("__target"))
    rows = sized.join(plan, F.col(source).eqNullSafe(F.col("__source"))).withColumn(
        "__bucket", F.floor((1 - F.exp(-F.col("__key"))) * F.ceil(F.col("__n_rows") / bucket_rows)))
    totals = rows.groupBy("__source", "__bucket").agg(F.sum("__size").alias("__sum"))
    earlier = Window.partitionBy("__source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut_lineage(totals.withColumn("__offset", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)))).select(
        F.col("__source").alias("__s"), F.col("__bucket").alias("__b"), "__offset")
    inside = Window.partitionBy("__source", "__bucket").orderBy("__key", key, "__size").rowsBetween(
        Window.unboundedPreceding, -1)
    rows = rows.withColumn("__inside", F.coalesce(F.sum("__size").over(inside), F.lit(0)))
    rows = rows.join(totals, F.col("__source").eqNullSafe(F.col("__s")) & F.col("__bucket").eqNullSafe(F.col("__b")))
    epochs = F.when(F.col("__source_size") > 0, F.floor(F.col("__target") / F.col("__source_size"))).otherwise(0)
    left = F.col("__target") - epochs * F.col("__source_size")
    part = (F.col("__offset") + F.col("__inside") + F.col("__size") / 2 <= left).cast("long")
    return rows.withColumn("__taken", (F.col("__size") * (epochs + part)).cast("long")).select(
        *docs.columns, "__size", "__source_size", "__target", "__taken")


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as it is taken."""
    taken = mix(docs, **options).where("__size > 0")
    copies = F.array_repeat(F.lit(1), (F.col("__taken") / F.col("__size")).cast("int"))
    return taken.withColumn("__copy", F.explode(copies)).select(*docs.columns)
