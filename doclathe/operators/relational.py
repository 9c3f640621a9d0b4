"""Operators that need more than one row: sections, repeated blocks, turns, totals, names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr


def page_selection(total, ranges: list[tuple[int, int]], most: int) -> Column:
    """The pages that ranges choose out of ``total``: ascending, distinct, ``most`` at most."""
    total = F.col(total) if isinstance(total, str) else total
    spans = ranges or [(1, 1 << 30)]
    run = lambda a, b: F.when(F.lit(a) <= total, F.sequence(F.lit(max(1, a)), F.least(F.lit(b), total).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.slice(F.array_sort(F.array_distinct(F.flatten(F.array(*[run(a, b) for a, b in spans])))), 1, most)


def section_heading(number, label, kind: str = "Page") -> Column:
    label = F.col(label) if isinstance(label, str) else label
    head = F.concat(F.lit(f"## {kind} "), F.col(number).cast("string") if isinstance(number, str) else number.cast("string"))
    return F.when(label.isNotNull() & (F.trim(label) != ""), F.concat(head, F.lit(" \u2014 "), label)).otherwise(head)


def assemble(sections: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """One text per key: its non-empty sections in order, joined by a line break. A document's sections meet in one row."""
    parts = F.array_sort(F.collect_list(F.when(F.col(text) != "", F.struct(order, text))))
    return sections.groupBy(key).agg(F.array_join(F.transform(parts, lambda x: x[text]), "\n").alias("text"))


def suppress_repeats(blocks: DataFrame, group: str, section: str, order: str, text: str, share: float = 0.6, least: int = 4) -> DataFrame:
    """Drop furniture: blocks that stand on a share of their group's sections, but for the first occurrence.

    Sections are counted distinct by (group, text) with partial aggregation; the first occurrence is a minimum, not a
    window, so that a block on every section of a large group isn't sorted in one task.
    """
    total = blocks.groupBy(group).agg(F.count_distinct(section).alias("_sections"))
    seen = blocks.groupBy(group, text).agg(F.count_distinct(section).alias("_on"), F.min(F.struct(section, order)).alias("_first"))
    marks = seen.join(total, group).where((F.col("_sections") >= least) & (F.col("_on") >= share * F.col("_sections"))).select(group, text, "_first")
    rows = blocks.join(marks, [group, text], "left")
    return rows.where(F.col("_first").isNull() | (F.struct(section, order) == F.col("_first"))).drop("_first")


def merge_turns(turns: DataFrame, key: str, order: str, speaker: str, text: str) -> DataFrame:
    """Consecutive turns of one speaker become one (gaps and islands within each conversation)."""
    w = Window.partitionBy(key).orderBy(order)
    new = F.coalesce((F.lag(speaker).over(w) != F.col(speaker)) | F.lag(speaker).over(w).isNull() | F.col(speaker).isNull(), F.lit(True))
    islands = turns.withColumn("_island", F.sum(new.cast("int")).over(w))
    parts = F.array_sort(F.collect_list(F.struct(order, text)))
    return islands.groupBy(key, "_island").agg(F.min(order).alias(order), F.first(speaker, ignorenulls=True).alias(speaker), F.array_join(F.transform(parts, lambda x: x[text]), " ").alias(text)).drop("_island")


def rendered(speaker, text, long: int = 200) -> Column:
    """A turn as text: on the speaker's line, or below it when it is long."""
    body = F.col(text)
    gap = F.when(expr.utf16_length(body) > long, "\n").otherwise(" ")
    return F.when(F.col(speaker).isNull(), body).otherwise(F.concat(F.col(speaker), F.lit(":"), gap, body))


def short_names(names: DataFrame, key: str, name: str) -> DataFrame:
    """key, name, short: first names where all of a key's first names are distinct, of two letters or more, and nobody's full name."""
    own = names.select(key, name).where(F.col(name).isNotNull()).distinct().withColumn("first", F.substring_index(F.col(name), " ", 1))
    fit = own.groupBy(key).agg((F.count_distinct("first") == F.count_distinct(name)).alias("apart"), F.min(F.length("first")).alias("least"), F.collect_set(name).alias("full"))
    rows = own.join(fit, key)
    clash = (F.col("first") != F.col(name)) & F.array_contains("full", F.col("first"))
    bad = rows.groupBy(key).agg(F.max(clash.cast("int")).alias("clash"))
    rows = rows.join(bad, key)
    return rows.select(key, name, F.when(F.col("apart") & (F.col("least") >= 2) & (F.col("clash") == 0), F.col("first")).otherwise(F.col(name)).alias("short"))


def totals(rows: DataFrame, by: str, measures: list[str]) -> DataFrame:
    """Sums by a column and, with a null in it, of all (rollup)."""
    return rows.rollup(by).agg(*[F.sum(m).alias(m) for m in measures])


def output_names(files: DataFrame, order: str, name: str, parent: str) -> DataFrame:
    """Distinct output names, case-insensitive: the first keeps its name, the next gets its parent's, later ones a number."""
    w = Window.partitionBy(F.lower(name)).orderBy(order)
    stem, ext = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 2)
    n = F.row_number().over(w)
    return files.withColumn("output", F.when(n == 1, F.col(name)).when(n == 2, F.concat(parent, F.lit("-"), stem, ext)).otherwise(F.concat(stem, F.lit("-"), n.cast("string"), ext)))


def dominant_turn(items: DataFrame, keys: list[str], turn: str, share: float = 0.9) -> DataFrame:
    """keys, turn: the quarter turn, not 0, that at least the share of all of a page's items have; else null."""
    total = items.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    each = items.where(F.col(turn).isNotNull() & (F.col(turn) != 0)).groupBy(*keys, turn).agg(F.count(F.lit(1)).alias("_k"))
    won = each.join(total, keys).where(F.col("_k") >= share * F.col("_n")).select(*keys, F.col(turn).alias("turn"))
    return total.select(*keys).join(won, keys, "left")
