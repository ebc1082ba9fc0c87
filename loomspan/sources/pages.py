"""Page layouts as sections: blocks of text with their places, sliced by an outline.

Blocks come as (path, page, y0, y1, text, page_height), outlines as (path, idx, level, title, page, y);
whatever reads a page format has to give these two tables.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspan.common import WHITE
from loomspan.operators.store import enclosing

BAND, SLACK, LEAST, SHARE = 60.0, 4.0, 3, 0.25
_PAGE = 1_000_000  # places count tenths of points from the top of page 0


def _compatible(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def _normal(blocks: DataFrame) -> DataFrame:
    return blocks.withColumn("text", F.trim(F.regexp_replace(F.pandas_udf(_compatible, "string")("text"), WHITE, " "))).filter("text <> ''")


def without_chrome(blocks: DataFrame) -> DataFrame:
    """blocks without running headers and footers: texts in the bands at the top and bottom, numbers aside,
    that stand on LEAST pages and a SHARE of the file's pages or more."""
    rows = _normal(blocks)
    edge = (F.col("y1") <= BAND) | (F.col("y0") >= F.col("page_height") - BAND)
    keyed = rows.withColumn("_key", F.when(edge, F.regexp_replace("text", r"\d+", "#")))
    pages = rows.groupBy("path").agg(F.countDistinct("page").alias("_pages"))
    often = keyed.filter("_key IS NOT NULL").groupBy("path", "_key").agg(F.countDistinct("page").alias("_n")).join(pages, "path").filter((F.col("_n") >= LEAST) & (F.col("_n") >= SHARE * F.col("_pages"))).select("path", "_key")
    return keyed.join(often, ["path", "_key"], "left_anti").drop("_key")


def sections(blocks: DataFrame, outline: DataFrame) -> DataFrame:
    """id, path, title, level, breadcrumb, text, start_page, end_page: the blocks of each outline entry, from
    its place to the next one's; a block may start SLACK above. Files without an outline are one section.
    Blocks before the first entry drop out, entries without blocks have an empty text."""
    place = lambda page, y: (page.cast("long") * _PAGE + (y * 10).cast("long"))
    rows = without_chrome(blocks).withColumn("at", place(F.col("page"), F.col("y0") + SLACK))
    points = outline.withColumn("start", place(F.col("page"), F.coalesce("y", F.lit(0.0)))).select("path", "idx", "level", "title", "start")
    bare = rows.select("path").distinct().join(points.select("path"), "path", "left_anti").select("path", F.lit(0).alias("idx"), F.lit(1).alias("level"), F.regexp_extract("path", "[^/]*$", 0).alias("title"), F.lit(0).cast("long").alias("start"))
    order = Window.partitionBy("path").orderBy("start", "idx")  # an outline's entries, not its blocks
    entries = points.unionByName(bare).withColumn("end", F.coalesce(F.lead("start").over(order) - 1, F.lit(1 << 50)))
    entries = entries.withColumn("entry", F.col("idx"))
    held = enclosing(rows, entries.select("path", "entry", "start", "end"), "path", "at", "start", "end", "entry", levels=50)
    text = held.filter("entry IS NOT NULL").groupBy("path", "entry").agg(F.array_sort(F.collect_list(F.struct("at", "y1", "text"))).alias("b"), F.min("page").alias("start_page"), F.max("page").alias("end_page"))
    above = Window.partitionBy("path").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    crumbs = entries
    for n in range(1, 7):  # the last entry of each smaller level before
        crumbs = crumbs.withColumn(f"_l{n}", F.last(F.when(F.col("level") <= n, F.when(F.col("level") == n, F.col("title")).otherwise("")), ignorenulls=True).over(above))
    parts = F.array(*(F.when((F.lit(n) < F.col("level")) & (F.col(f"_l{n}") != ""), F.col(f"_l{n}")) for n in range(1, 7)), F.col("title"))
    return crumbs.join(text, ["path", "entry"], "left").select(
        F.format_string("%s::s%04d", "path", "idx").alias("id"), "path", "title", "level", F.array_join(F.filter(parts, lambda x: x.isNotNull()), " > ").alias("breadcrumb"),
        F.coalesce(F.array_join(F.transform("b", lambda x: x["text"]), "\n"), F.lit("")).alias("text"), "start_page", "end_page",
    )
