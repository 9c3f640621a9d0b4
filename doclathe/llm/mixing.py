"""Mixing sources to target weights: Efraimidis-Spirakis order within each source, prefix-summed to a word budget.

Only DataFrame functions. Texts are read once: (id, source, size, key) is what is kept and sorted.
A source is never gathered in one task: sizes are summed by (source, slice of the key range), the slice
in which the budget ends is found from those sums, cut into slices again, and only one of these is sorted.

Defined results: null text has size 0 and is never repeated; a null source is a source of its own, last
in order; no rows give no rows; rows that repeat (same id and text) count each; extra columns are ignored
by ``mix_sizes`` and kept by ``mix_documents``. All ties are broken by id and text, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, free_names, own_columns, written

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: A target is at most so many times its source's size.
MOST_EPOCHS = 3
#: Slices of the key range, twice over: a sorted group has about a 65,536th of its source's rows.
SLICES = 256
#: What is known of so many sources (about 60 bytes each) is broadcast to their rows; of more, it is joined by shuffle.
FEW_SOURCES = 200_000


def _sized(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    size = F.regexp_count(text, F.lit(WORD)).cast("long")
    base = own_columns(docs, "doc_id", "text", "source").select("doc_id", "source", size.alias("size"), F.xxhash64("text").alias("text_hash"), F.char_length(text).alias("chars"))
    # uniform in (0, 1), a function of the row alone
    unit = (F.pmod(F.xxhash64("doc_id", "text_hash", F.lit(20240229)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    # weights from 0.5 to 1.5: more for ordinary word lengths, less for tiny texts
    mean = (F.col("chars") + 1) / (F.col("size") + 1)
    weight = F.lit(0.5) + 0.7 * F.exp(-F.pow((mean - 6.5) / 6.0, 2)) + 0.3 * (F.col("size") / (F.col("size") + 100.0))
    # the smallest exponential key -ln(u)/w is the largest u^(1/w); draw is 1 - u^(1/w), in [0, 1)
    return base.select("doc_id", "source", "size", "text_hash", (1 - F.pow(unit, 1 / weight)).alias("draw"))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """One row per source: source, source_size, target. The list of sources (not rows) is ranked in one task.

    The whole is shared by weight; what is above ``most`` times a source's size is shared again among the
    others. In closed form: sources by most*size/weight, filled up one after another while that ratio is
    below the level that is left for the rest.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.select("source", "source_size", weight.alias("w"), (F.lit(most) * F.col("source_size")).alias("cap"))
    fill = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("w").over(rest)
    per = per.withColumn("level", level).withColumn("full", F.col("cap") / F.col("w") <= F.col("level"))
    # once a source isn't filled up, none after it is; levels fall from there, so theirs is the largest
    open_level = F.max(F.when(~F.col("full"), F.col("level"))).over(every)
    return per.select("source", "source_size", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(open_level * F.col("w")).alias("target"))


def mix_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken (and source, text_hash): how many of its words the mix takes from each document.

    Complete epochs take every document whole; the rest of the target takes documents in the order of
    their keys while the middle of the document lies within it, so that a source misses its target by
    half a document at most.
    """
    sized = written(_sized(docs), "mix-sizes")
    goal = targets(sized).withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(0).cast("long"))
    goal = goal.withColumn("left", F.greatest(F.lit(0.0), F.col("target") - F.col("epochs") * F.col("source_size")))
    own = ["doc_id", "source", "text_hash", "size", "source_size", "target"]
    goal = written(goal, "mix-targets")
    few = goal.count() <= FEW_SOURCES
    rows = _beside(sized, goal.withColumn("before", F.lit(0).cast("long")), few)
    outside = []
    for scale in (SLICES, SLICES * SLICES):
        rows = rows.withColumn("slice", F.floor(F.col("draw") * scale).cast("int"))
        rows = _beside(rows.drop("source_size", "target", "epochs", "left", "before"), _edges(rows), few)
        taken = F.col("epochs") + (F.col("slice") < F.col("edge_slice")).cast("long")
        outside.append(rows.where("slice != edge_slice").select(*own, (F.col("size") * taken).alias("taken")))
        rows = rows.where("slice = edge_slice").drop("slice", "edge_slice")
    run = Window.partitionBy("source").orderBy("draw", "doc_id", "text_hash")
    middle = F.col("before") + F.sum("size").over(run.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size") / 2.0
    inside = rows.withColumn("middle", middle).select(*own, (F.col("size") * (F.col("epochs") + (F.col("middle") <= F.col("left")).cast("long"))).alias("taken"))
    return outside[0].unionByName(outside[1]).unionByName(inside)


def _beside(rows: DataFrame, sources: DataFrame, few: bool) -> DataFrame:
    """Each row with what is known of its source (null being one). With few sources rows stay where they are, however many are of one source."""
    named = sources.withColumnRenamed("source", "_of")
    named = F.broadcast(named) if few else named
    return rows.join(named, rows["source"].eqNullSafe(named["_of"])).drop("_of")


def _edges(rows: DataFrame) -> DataFrame:
    """For each source the first slice at whose end the rest of its target is used up (past the last one, if none is),
    and the words before it."""
    sums = rows.groupBy("source", "source_size", "target", "epochs", "left", "before", "slice").agg(F.sum("size").alias("words"))
    upto = F.col("before") + F.sum("words").over(Window.partitionBy("source").orderBy("slice"))
    sums = sums.withColumn("upto", upto)
    found = F.min(F.when(F.col("upto") >= F.col("left"), F.struct("slice", (F.col("upto") - F.col("words")).alias("before"))))
    ends = sums.groupBy("source", "source_size", "target", "epochs", "left").agg(found.alias("edge"))
    return ends.select("source", "source_size", "target", "epochs", "left", F.coalesce("edge.slice", F.lit(1 << 30)).alias("edge_slice"), F.coalesce("edge.before", F.lit(0)).cast("long").alias("before"))


def mix_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns it came with, whatever their names.

    A document is an id, a text and a source. Rows that repeat all three are taken equally often; where the budget ends
    among them, some (any) once more. Textless documents are never taken; no rows give no rows.
    """
    of, text, source, least, more, place, copy = free_names(docs, "mix_id", "mix_text", "mix_source", "mix_times", "mix_more", "mix_place", "mix_copy")
    times = (F.col("taken") / F.col("size")).cast("int")
    each = mix_sizes(docs).where("size > 0").groupBy(F.col("doc_id").alias(of), F.col("text_hash").alias(text), F.col("source").alias(source))
    each = each.agg(F.min(times).alias(least), (F.sum(times) - F.min(times) * F.count(F.lit(1))).alias(more)).where(F.col(least) + F.col(more) > 0)
    same = docs["doc_id"].eqNullSafe(each[of]) & (F.xxhash64(docs["text"]) == each[text]) & docs["source"].eqNullSafe(each[source])
    rows = written(docs.join(each, same), "mix-rows")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    whole = rows.where(F.col(more) == 0)
    # only what the budget's end parts is numbered
    number = F.row_number().over(Window.partitionBy(of, text, source).orderBy(F.lit(1)))
    parted = rows.where(F.col(more) > 0).withColumn(place, number).withColumn(least, F.col(least) + (F.col(place) <= F.col(more)).cast("int")).where(F.col(least) > 0).drop(place)
    return whole.unionByName(parted).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(least)))).select(*columns)
