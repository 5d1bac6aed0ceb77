"""Breadth-first crawl over a table of pages: one join, link filter and anti-join for each level."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import urls as fu
from .catalogue import save_crawl
from .relational import qualify_links
from .store import cut


def crawl(spark: SparkSession, links: DataFrame, start: str, max_depth: int = 1, max_pages: int = 50, include: list[str] | None = None, exclude: list[str] | None = None, prefix: str | None = None, resume: tuple[DataFrame, DataFrame] | None = None, save: str | None = None) -> DataFrame:
    """Rows (url, depth, position, found): pages reached from *start* over links (url, href, and pos, the link's place in its page, if given).

    A level is taken in the order of its parents and, within one, of the links;
    beyond *max_pages* it is cut and its rest dropped.  Pages that the table lacks
    count too, with found false.  Each level is written to the shared folder; the
    loop has max_depth + 1 rounds, and what is ranked is at most *max_pages* rows.
    With *save*, a folder, the state is kept after each level; *resume* takes up
    (visited, frontier) of such a state, the frontier with its depth.
    """
    place = F.col("pos").cast("long") if "pos" in links.columns else F.lit(0).cast("long")
    pages = links.select(fu.crawl_form(F.col("url")).alias("url"), "href", place.alias("pos"))
    known = cut(pages.select("url").distinct(), "pages")
    if resume:
        visited, frontier = resume
        first = frontier.agg(F.min("depth")).first()[0]
        if first is None:
            return visited
        left = max_pages - visited.count()
    else:
        visited, first, left = None, 0, max_pages
        frontier = spark.createDataFrame([(start, 0, 0)], "url string, position long, depth int").withColumn("url", fu.crawl_form(F.col("url")))
    for depth in range(first, max_depth + 1):
        if left <= 0:
            break
        level = cut(frontier.orderBy("position").limit(left).join(known.withColumn("found", F.lit(True)), "url", "left").select("url", F.lit(depth).alias("depth"), "position", F.coalesce("found", F.lit(False)).alias("found")), "level")
        visited = level if visited is None else cut(visited.unionByName(level), "visited")
        left -= level.count()
        if left <= 0 or depth == max_depth:
            break
        out = pages.join(level.where("found").select("url", "position"), "url")
        good = qualify_links(out, F.lit(start), include or [], exclude or [], visited, prefix)
        best = good.groupBy(F.col("href").alias("url")).agg(F.min(F.struct("position", "pos")).alias("p")).orderBy("p", "url").limit(left)
        frontier = cut(best.select("url", F.row_number().over(Window.orderBy("p", "url")).cast("long").alias("position"), F.lit(depth + 1).alias("depth")), "frontier")
        if save:
            save_crawl(visited, frontier, save)
        if frontier.isEmpty():
            break
    return visited
