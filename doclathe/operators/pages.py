"""Positioned items (doc_id, page, text, x, y, width, height, page_height) to text, page by page, and running text across pages."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LINES = "doc_id long, page int, line int, y double, left double, right double, page_height double, text string"


def _keyed(frame: DataFrame, schema: str) -> str:
    """A schema whose doc_id has the type that it has in the frame."""
    return schema.replace("doc_id long", f"doc_id {frame.schema['doc_id'].dataType.simpleString()}")


def page_lines(items: DataFrame) -> DataFrame:
    """One row per line in reading order. A page is a group of bounded size, so documents of any length are spread by page."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        from ..core.pages import Item, lay_out

        height = float(frame["page_height"].iloc[0])
        lines = lay_out([Item(*r) for r in frame[["text", "x", "y", "width", "height"]].itertuples(index=False)], height)
        rows = [(frame["doc_id"].iloc[0], frame["page"].iloc[0], n, x.y, x.left, x.right, height, x.text) for n, x in enumerate(lines)]
        return pd.DataFrame(rows, columns=[c.split(" ")[0] for c in LINES.split(", ")])

    own = items.select("doc_id", F.col("page").cast("int"), "text", *[F.col(c).cast("double") for c in ("x", "y", "width", "height", "page_height")])
    return own.where(F.col("text").isNotNull()).groupBy("doc_id", "page").applyInPandas(run, _keyed(own, LINES))


def running_key(y: str, text: str):
    """The key of core.pages.running_key as an expression."""
    from ..core import pages

    words = F.trim(F.regexp_replace(text, r"\s+", " "))
    counted = F.regexp_replace(words, "(?i)" + pages.COUNTER, "#")
    return F.concat(F.floor(F.col(y) / 3 + 0.5).cast("string"), F.lit("|"), F.when(F.rlike(words, F.lit(rf"\A(?:{pages.COUNTER_ALONE})\z")), "#").otherwise(counted))


def suppress_running_text(lines: DataFrame, share: float = 0.6, least: int = 4) -> DataFrame:
    """Headers and footers that stand on a share of a document's pages stay on the first of them only.

    Counts of distinct pages by (document, key), partially aggregated; no document is gathered in one task.
    """
    from ..core import pages

    margin = F.col("page_height") * pages.MARGIN_SHARE
    keyed = lines.withColumn("_key", running_key("y", "text"))
    total = lines.groupBy("doc_id").agg(F.count_distinct("page").alias("_pages"))
    edge = keyed.where((F.col("y") <= margin) | (F.col("y") >= F.col("page_height") - margin))
    seen = edge.groupBy("doc_id", "_key").agg(F.count_distinct("page").alias("_on"), F.min("page").alias("_first"), F.collect_set("page").alias("_where"))
    marks = seen.join(total, "doc_id").where((F.col("_pages") >= least) & (F.col("_on") >= share * F.col("_pages"))).select("doc_id", "_key", "_first", "_where")
    rows = keyed.join(marks, ["doc_id", "_key"], "left")
    gone = F.col("_first").isNotNull() & (F.col("page") != F.col("_first")) & F.array_contains("_where", F.col("page"))
    return rows.where(~F.coalesce(gone, F.lit(False))).drop("_key", "_first", "_where")


def page_texts(lines: DataFrame) -> DataFrame:
    """doc_id, page, text: the paragraphs of each page."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        from ..core.pages import Line, paragraphs

        rows = frame.sort_values("line")
        text = paragraphs([Line(*r) for r in rows[["y", "left", "right", "text"]].itertuples(index=False)])
        return pd.DataFrame({"doc_id": [frame["doc_id"].iloc[0]], "page": [frame["page"].iloc[0]], "text": [text]})

    return lines.groupBy("doc_id", "page").applyInPandas(run, _keyed(lines, "doc_id long, page int, text string"))
