"""Scans of extraction outputs, and sinks of artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions import text as T

HEADER_ROWS = "array<struct<header:string,content:string,page_start:int,page_end:int>>"
LAYOUT = "struct<page_index:int,width:double,height:double,parsing_res_list:array<struct<block_id:int,block_order:int,block_label:string,block_content:string,block_bbox:array<double>,source_bbox:array<double>>>>"


def _whole(spark: SparkSession, path: str) -> DataFrame:
    """path, value: each file as one text (files of one document's extraction are small)."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def header_chunks(spark: SparkSession, path: str) -> DataFrame:
    """path, index, header, content, page_start, page_end, valid from JSON lists of header chunks."""
    rows = _whole(spark, path).select("path", F.posexplode(F.from_json("value", HEADER_ROWS)).alias("index", "r")).select("path", "index", "r.*")
    page_ok = lambda c: F.col(c).isNull() | (F.col(c) >= 1)
    valid = ~T.is_blank(F.coalesce("header", F.lit(""))) & F.col("content").isNotNull() & page_ok("page_start") & page_ok("page_end")
    return rows.withColumn("valid", valid)


def source_version(rows: DataFrame) -> DataFrame:
    """path, version: sha256 of the rows' JSON in order, before any split."""
    j = F.to_json(F.struct("content", "header", "page_end", "page_start"), {"ignoreNullFields": "false"})
    return rows.groupBy("path").agg(F.sha2(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("index", j.alias("j")))), lambda x: x["j"]), ","), F.lit("]")), 256).alias("version"))


def caption_map(spark: SparkSession, path: str) -> DataFrame:
    """asset, caption from {"matches": [...]}; malformed entries are passed over."""
    m = _whole(spark, path).select(F.explode(F.from_json("value", "struct<matches:array<struct<asset:string,caption:string>>>")["matches"]).alias("m")).select("m.*")
    return m.where(~T.is_blank(F.coalesce("asset", F.lit(""))) & ~T.is_blank(F.coalesce("caption", F.lit(""))))


def valid_bbox(b: Column) -> Column:
    """Four finite numbers, right of left and below top."""
    return (F.size(b) == 4) & F.forall(b, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.get(b, F.lit(2)) > F.get(b, F.lit(0))) & (F.get(b, F.lit(3)) > F.get(b, F.lit(1)))


def layout_pages(spark: SparkSession, path: str) -> DataFrame:
    """path, page, width, height, blocks of page files; pages without a valid size are left out."""
    p = _whole(spark, path).select("path", F.from_json("value", LAYOUT).alias("p")).select("path", (F.col("p.page_index") + 1).alias("page"), "p.width", "p.height", F.col("p.parsing_res_list").alias("blocks"))
    return p.where((F.col("width") > 0) & (F.col("height") > 0) & (F.col("page") >= 1))


def layout_blocks(pages: DataFrame) -> DataFrame:
    """page, order, label, text, bbox: the source box, else the block's; an invalid box is null."""
    b = pages.select("path", "page", F.posexplode("blocks").alias("pos", "b"))
    box = F.when(valid_bbox(F.col("b.source_bbox")), F.col("b.source_bbox")).when(F.col("b.source_bbox").isNull() & valid_bbox(F.col("b.block_bbox")), F.col("b.block_bbox"))
    return b.select("path", "page", F.coalesce("b.block_order", "pos").alias("order"), F.col("b.block_label").alias("label"), F.col("b.block_content").alias("text"), box.alias("bbox"))


def artifacts(spark: SparkSession, path: str) -> DataFrame:
    """path, length, sha256 of binary files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def artifact_violations(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected artifacts (path, size, sha256) that are missing or differ."""
    e = expected.select(F.col("path"), F.col("size").alias("__size"), F.col("sha256").alias("__sha"))
    x = e.join(found, "path", "left")
    rule = F.when(F.col("sha256").isNull(), "missing").when(F.col("length") != F.col("__size"), "size differs").when(F.col("sha256") != F.col("__sha"), "checksum differs")
    return x.select("path", rule.alias("rule")).where(F.col("rule").isNotNull())


def web_results(raw: DataFrame, body: str = "body", limit: int = 10, most_chars: int = 4000) -> DataFrame:
    """title, url, snippet, content, rank from a provider's JSON (items, results or data), with its status."""
    item = "array<struct<title:string,url:string,link:string,snippet:string,description:string,content:string>>"
    j = F.from_json(body, f"struct<items:{item},results:{item},data:{item}>")
    rows = raw.withColumn("j", j).withColumn("list", F.slice(F.filter(F.coalesce("j.items", "j.results", "j.data", F.expr(f"cast(array() as {item})")), lambda x: F.coalesce(x["url"], x["link"]).isNotNull()), 1, limit))
    rows = rows.withColumn("status", F.when(F.size("list") > 0, "ready").otherwise("empty"))
    keep = [c for c in raw.columns if c != body]
    x = rows.select(*keep, "status", F.posexplode_outer("list").alias("pos", "r"))
    return x.select(*keep, "status", (F.col("pos") + 1).alias("rank"), F.col("r.title").alias("title"), F.coalesce("r.url", "r.link").alias("url"), F.coalesce("r.snippet", "r.description").alias("snippet"), F.substring("r.content", 1, most_chars).alias("content"))


def review_markdown(paras: DataFrame, facts: DataFrame, scope: str) -> DataFrame:
    """scope, markdown: each paragraph with its labels, in order."""
    labels = facts.groupBy("paragraph_id").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(" -> ", "concept", "role"))), "; ").alias("labels"))
    x = paras.join(labels, "paragraph_id", "left")
    block = F.concat_ws("\n", F.concat(F.lit("## "), F.col("paragraph_id")), F.col("text"), F.concat(F.lit("- "), F.coalesce("labels", F.lit("none"))))
    return x.groupBy(scope).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "paragraph_id", block.alias("b")))), lambda v: v["b"]), "\n\n").alias("markdown"))


def export(frames: dict[str, DataFrame], path: str) -> None:
    """Each frame as JSON lines in its own folder."""
    for name, df in frames.items():
        df.write.json(f"{path}/{name}")
