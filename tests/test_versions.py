from functools import reduce

from pyspark.sql import functions as F

from weftline.operators import relational as rel
from weftline.operators import store
from weftline.plans import queries


def pages(spark):
    rows = [(i, "u", f"t{i // 2}", f"body {i // 3}", i, i // 2 * 1_000_000, [("", f"/{i}"), ("", "/same")]) for i in range(5)]
    rows += [(10, "once", None, "x", None, 0, [("", "/a")]), (11, None, "n", "x", 1, 0, [("", "/a")]), (12, None, "n", "y", 1, 0, [("", "/b")])]
    df = spark.createDataFrame(rows, "content_id long, url string, title string, markdown string, word_count long, us long, links array<struct<text:string,href:string>>")
    return df.withColumn("fetched_at", F.timestamp_micros("us")).withColumn("author", F.lit(None).cast("string")).withColumn("language", F.lit("en")).drop("us")


def test_all_versions_are_merged(spark):
    v = rel.versions_of(pages(spark).select("url", "title", "markdown", "fetched_at", "content_id"), "url", ["fetched_at", "content_id"])
    batch = v.drop("version", "versions")
    one_by_one = reduce(lambda current, k: store.merge(current, v.where(F.col("version") == k).drop("version", "versions", "content_id")), range(1, 6), None)
    built = store.build(batch, ["fetched_at", "content_id"])
    assert built.columns == one_by_one.columns
    got = {r["url"]: r.asDict(recursive=True) for r in built.collect()}
    assert got == {r["url"]: r.asDict(recursive=True) for r in one_by_one.collect()}
    assert {k: r["fetch_count"] for k, r in got.items()} == {"u": 5, "once": 1}


def test_the_log_of_many_versions_is_capped_as_by_merging(spark):
    rows = spark.range(150).select(F.lit("u").alias("url"), F.col("id").cast("string").alias("title"), F.timestamp_seconds("id").alias("fetched_at"))
    (built,) = store.build(rows, ["fetched_at"]).collect()
    assert built["fetch_count"] == 150 and [e["at"].second for e in built["changelog"][:1]] == [0] and len(built["changelog"]) == 100
    assert [e["status"] for e in built["changelog"][:2]] == ["New", "Changed"]


def test_queries_compare_all_versions(spark, tmp_path):
    pages(spark).write.parquet(str(tmp_path / "contents.parquet"))
    counts = {r["url"]: r["fetch_count"] for r in queries.QUERIES["store_merge_all"](spark, str(tmp_path)).collect()}
    assert counts == {"u": 5, "once": 1}
    links = {tuple(r) for r in queries.QUERIES["links_added_removed_all"](spark, str(tmp_path)).collect()}
    assert links == {("u", v, "added", f"/{v - 1}") for v in range(2, 6)} | {("u", v, "removed", f"/{v - 2}") for v in range(2, 6)}
    diff = {(r["url"], r["version"]): (r["status"], r["word_count_delta"], r["changed"]) for r in queries.QUERIES["snapshot_diff_all"](spark, str(tmp_path)).collect()}
    assert diff == {("u", 1): ("New", 0, ""), ("u", 2): ("Changed", 1, ""), ("u", 3): ("Changed", 1, "title"), ("u", 4): ("Changed", 1, "markdown"), ("u", 5): ("Changed", 1, "title"), ("once", 1): ("New", 0, "")}
