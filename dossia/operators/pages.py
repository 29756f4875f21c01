"""Pages as rows `(doc_id, page_num, text, ...)`: routing between readers, triage, partitions of pages and Markdown.

What OCR, layout and vision engines read comes in as tables with one row a page, and is joined by document and page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossia.functions import fixed
from dossia.functions.convert import converted
from dossia.functions.text import nfkc

PAGE = ["doc_id", "page_num"]


def filled(c: Column) -> Column:
    """A text that isn't blank, else null."""
    return F.when(F.trim(F.regexp_replace(c, r"(?U)\s", " ")) != "", c)


def page_range(pages: DataFrame, first: int, last: int) -> DataFrame:
    """Pages of a range, both ends included; what a document doesn't have is left out."""
    return pages.where(F.col("page_num").between(max(1, first), last))


def native(pages: DataFrame, text: str = "text", second: str | None = None) -> DataFrame:
    """Normalised text of the first reader, or of the second where that is blank, and whether the page is an image."""
    tries = [filled(nfkc(F.col(c))) for c in (text, second) if c]
    out = pages.withColumn("text", F.coalesce(*tries, F.lit("")))
    return out.withColumn("is_image", filled(F.col("text")).isNull())


def page_text(pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """Text of each wanted (doc_id, page_num); pages out of range have an empty one."""
    return wanted.join(pages.select(*PAGE, "text"), PAGE, "left").withColumn("text", F.coalesce("text", F.lit("")))


def page_tables(pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """Tables of each wanted (doc_id, page_num); pages out of range have none."""
    none = F.array().cast(pages.schema["tables"].dataType)
    return wanted.join(pages.select(*PAGE, "tables"), PAGE, "left").withColumn("tables", F.coalesce("tables", none))


def routed(pages: DataFrame, vision: DataFrame | None = None, ocr: DataFrame | None = None, least: int = fixed.LEAST_NATIVE) -> DataFrame:
    """The best text of each page and its `source`: native text of some length, else vision, else OCR, else what there is."""
    out, tries = pages, [(F.when(F.length(F.trim("text")) >= least, F.col("text")), "text")]
    for name, table in (("vlm", vision), ("ocr", ocr)):
        if table is not None:
            out = out.join(table.select(*PAGE, F.col("text").alias(f"{name}_text")), PAGE, "left")
            tries.append((filled(F.col(f"{name}_text")), name))
    source = F.coalesce(*[F.when(c.isNotNull(), F.lit(s)) for c, s in tries], F.when(filled(F.col("text")).isNotNull(), "text").otherwise("empty"))
    best = F.coalesce(*[c for c, _ in tries], "text")
    return out.withColumn("source", source).withColumn("text", best).drop("vlm_text", "ocr_text")


def scanned_filled(pages: DataFrame, vision: DataFrame | None = None) -> DataFrame:
    """Image pages get the text of the vision table, if there is one; `source` is text, vlm or scanned."""
    if vision is None:
        found = pages.withColumn("vlm_text", F.lit(None).cast("string"))
    else:
        found = pages.join(vision.select(*PAGE, F.col("text").alias("vlm_text")), PAGE, "left")
    read = F.when(F.col("is_image"), filled(F.col("vlm_text")))
    source = F.when(read.isNotNull(), "vlm").when(filled(F.col("text")).isNotNull(), "text").otherwise("scanned")
    out = found.select(*[c for c in found.columns if c not in ("text", "is_image", "vlm_text")], F.coalesce(read, "text").alias("text"), (F.col("is_image") & read.isNull()).alias("is_image"), source.alias("source"))
    return out


def keyword_page(pages: DataFrame, keyword: str, last: int = 30) -> DataFrame:
    """The first page of each document, up to `last`, that has the keyword; both sides normalised."""
    hit = F.contains(nfkc(F.col("text")), nfkc(F.lit(keyword)))
    return page_range(pages, 1, last).where(hit).groupBy("doc_id").agg(F.min("page_num").alias("page_num"))


def triage(blocks: DataFrame, pages: DataFrame, least: int = fixed.LEAST_TRIAGE) -> DataFrame:
    """Characters, share of the page's area under text and under images (four decimals), and whether the page is a scan.

    blocks: doc_id, page_num, kind (text or image), x0, y0, x1, y1, text; pages: doc_id, page_num, width, height.
    """
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    is_text = F.col("kind") == "text"
    sums = blocks.groupBy(*PAGE).agg(
        F.sum(F.when(is_text, F.length(F.trim("text"))).otherwise(0)).alias("chars"), F.sum(F.when(is_text, area).otherwise(0.0)).alias("t"), F.sum(F.when(F.col("kind") == "image", area).otherwise(0.0)).alias("i"),
    )
    whole = F.when((F.col("width") > 0) & (F.col("height") > 0), F.col("width") * F.col("height")).otherwise(1.0)
    chars = F.coalesce("chars", F.lit(0)).cast("long")
    share = lambda c: F.round(F.coalesce(F.col(c), F.lit(0.0)) / whole, 4)
    joined = pages.select(*PAGE, "width", "height").join(sums, PAGE, "left")
    return joined.select(*PAGE, (chars < least).alias("is_scanned"), chars.alias("char_count"), share("t").alias("text_fraction"), share("i").alias("image_fraction"))


def page_indices(classes: DataFrame, scanned: bool) -> DataFrame:
    """Pages that are scans, or those that aren't, counted from 0."""
    return classes.where(F.col("is_scanned") if scanned else ~F.col("is_scanned")).select("doc_id", (F.col("page_num") - 1).alias("page_index"))


def markdown(text_parts: DataFrame, scanned: DataFrame) -> DataFrame:
    """One Markdown text a document: the text runs' Markdown in order, then the scanned pages' text, with blank lines between.

    text_parts: doc_id, first, markdown (a run of pages each); scanned: doc_id, page_num, text.
    """
    ordered = lambda at, c: F.transform(F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), F.col(c).alias("t")))), lambda x: x["t"])
    a = text_parts.groupBy("doc_id").agg(filled(F.array_join(ordered("first", "markdown"), "\n\n")).alias("a"))
    lines = F.array_join(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""), "\n")
    b = scanned.withColumn("text", lines).groupBy("doc_id").agg(F.array_join(ordered("page_num", "text"), "\n").alias("b"))
    return a.join(b, "doc_id", "full_outer").select("doc_id", F.concat_ws("\n\n", "a", "b").alias("markdown"))


def boxed(polygon: Column) -> Column:
    """`struct<x0, x1, yc, h>` of an array of points [x, y]; null if there are none or one isn't a point."""
    ok = (F.size(polygon) > 0) & F.forall(polygon, lambda p: (F.size(p) >= 2) & F.get(p, F.lit(0)).isNotNull() & F.get(p, F.lit(1)).isNotNull())
    xs = F.transform(polygon, lambda p: F.get(p, F.lit(0)).cast("double"))
    ys = F.transform(polygon, lambda p: F.get(p, F.lit(1)).cast("double"))
    middle = F.aggregate(ys, F.lit(0.0), lambda a, x: a + x) / F.size(ys)
    return F.when(ok, F.struct(F.array_min(xs).alias("x0"), F.array_max(xs).alias("x1"), middle.alias("yc"), (F.array_max(ys) - F.array_min(ys)).alias("h")))


def detections(predicted: DataFrame, least: float = fixed.DETECTION_LEAST, script: dict[str, str] | None = None) -> DataFrame:
    """One row a recognised text, of at least some confidence: `doc_id, page_num, seq, text, conf, x0, x1, yc, h`.

    predicted: doc_id, page_num, texts array<string>, scores array<double>, polygons array<array<array<double>>>. A text without a
    score counts as sure, one without a polygon has no place. script: a table by which characters and phrases are converted (see convert).
    """
    rows = predicted.select(*PAGE, "scores", "polygons", F.posexplode("texts").alias("seq", "text"))
    box = boxed(F.get("polygons", F.col("seq")))
    out = rows.withColumn("conf", F.coalesce(F.get("scores", F.col("seq")).cast("double"), F.lit(1.0))).withColumn("box", box).where(F.col("conf") >= least)
    text = F.col("text") if script is None else converted(F.col("text"), script)
    return out.select(*PAGE, "seq", text.alias("text"), "conf", "box.x0", "box.x1", "box.yc", "box.h")


def shown_detections(found: DataFrame, most: int = fixed.DETECTIONS_SHOWN) -> DataFrame:
    """The first detections of each page, rounded for display (a report's limit)."""
    tenth = [F.round(F.coalesce(F.col(c), F.lit(0.0)), 1).alias(c) for c in ("x0", "x1", "yc", "h")]
    return found.where(F.col("seq") < most).select(*PAGE, "seq", "text", F.round("conf", 3).alias("conf"), *tenth)


def cached(wanted: DataFrame, cache: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """What the cache has for the wanted rows, and those that still must be read."""
    return wanted.join(cache, key), wanted.join(cache, key, "left_anti")


def cache_with(cache: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """The cache with new rows in place of old ones of the same key; columns that the old one lacks are added as null."""
    return cache.join(new, key, "left_anti").unionByName(new, allowMissingColumns=True)


def file_key(content: Column) -> Column:
    """A document's key in the cache: SHA-256 of its first 64 KiB."""
    return F.sha2(F.substring(content, 1, 65536), 256)


def html_cells(tables: DataFrame, key: list[str], html: str) -> DataFrame:
    """Cells of plain HTML tables: `key, row, col, text`."""
    rows = F.regexp_extract_all(html, F.lit(r"(?s)<tr>(.*?)</tr>"), 1)
    cells = lambda r: F.regexp_extract_all(r, F.lit(r"(?s)<t[dh][^>]*>(.*?)</t[dh]>"), 1)
    out = tables.select(*key, F.posexplode(rows).alias("row", "r")).select(*key, "row", F.posexplode(cells(F.col("r"))).alias("col", "text"))
    return out.withColumn("text", F.trim(F.regexp_replace(F.regexp_replace("text", "<[^>]+>", ""), r"^\s+|\s+$", "")))


def image_scale(width: Column, height: Column, most: int = 2000) -> Column:
    """The factor that brings an image's longer edge down to `most`."""
    return F.least(F.lit(1.0), F.lit(float(most)) / F.greatest(width, height))
