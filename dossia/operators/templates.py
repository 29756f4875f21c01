"""Official templates: their sections, which sections a document shows, and what is missing; and how regulation versions differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dossia.functions import fixed
from dossia.functions.scalars import any_word, rank_of
from dossia.functions.text import nfkc


def requirement(title: Column) -> Column:
    return F.when(any_word(title, fixed.CHOOSE_WORDS), "choose_one").when(any_word(title, fixed.OPTIONAL_WORDS), "optional").otherwise("required")


def sections(headings: DataFrame, by: list[str]) -> DataFrame:
    """Sections of a template from its headings (by, seq, level, text): level 1 with a marker, numbered from 1."""
    text = F.trim("text")
    marker = F.regexp_extract(text, fixed.SECTION_MARKER, 1)
    rows = headings.where(F.col("level") == 1).select(*by, "seq", marker.alias("marker"), F.trim(F.regexp_replace(text, fixed.SECTION_MARKER, "")).alias("title")).where("marker <> ''")
    kind = F.when(F.startswith("marker", F.lit("附錄")), "appendix").otherwise("chapter")
    return rows.select(*by, "marker", "title", kind.alias("kind"), requirement(F.col("title")).alias("requirement"), F.row_number().over(W.partitionBy(*by).orderBy("seq")).alias("order"))


def squeezed(c: Column) -> Column:
    return F.regexp_replace(nfkc(c), "[ 　]", "")


def title_key(title: Column) -> Column:
    """The first six characters of a title, before a bracket that doesn't open it."""
    wide, narrow = F.instr(title, "（"), F.instr(title, "(")
    cut = F.when(wide > 1, wide).when(narrow > 1, narrow)
    return F.substr(squeezed(F.when(cut.isNotNull(), F.substr(title, F.lit(1), cut - 1)).otherwise(title)), F.lit(1), F.lit(6))


def present_sections(docs: DataFrame, schema: DataFrame, text: str = "text") -> DataFrame:
    """Markers of the sections whose key a document's text has: `doc_id, doc_type, version, present` (empty: none was found).

    A template has a few dozen sections, so they meet a document as one array by type and version.
    """
    keyed = schema.select("doc_type", "version", "marker", title_key(F.col("title")).alias("key"))
    keys = keyed.groupBy("doc_type", "version").agg(F.collect_list(F.struct("marker", "key")).alias("keys"))
    rows = docs.withColumn("flat", squeezed(F.coalesce(F.col(text), F.lit("")))).join(keys, ["doc_type", "version"])
    hits = F.transform(F.filter("keys", lambda k: (k["key"] != "") & F.contains(F.col("flat"), k["key"])), lambda k: k["marker"])
    return rows.select("doc_id", "doc_type", "version", F.array_distinct(hits).alias("present"))


def check_format(present: DataFrame, schema: DataFrame) -> DataFrame:
    """Findings of missing chapters and appendices that are required, and of groups of neighbouring choices of which none is there.

    Documents in which no section was found get none.
    """
    w = W.partitionBy("doc_type", "version").orderBy("order")
    one = F.col("requirement") == "choose_one"
    grouped = schema.withColumn("starts", F.when(one & ~F.coalesce(F.lag("requirement").over(w) == "choose_one", F.lit(False)), 1).otherwise(0)).withColumn("g", F.sum("starts").over(w))
    groups = grouped.where(one).groupBy("doc_type", "version", "g").agg(F.array_sort(F.collect_list(F.struct("order", "marker"))).alias("members"))
    first = groups.select("doc_type", "version", F.lit("FMT-XOR").alias("family"), F.get("members", F.lit(0))["order"].alias("order"), F.transform("members", lambda m: m["marker"]).alias("markers"), F.lit(None).cast("string").alias("title"))
    needed = schema.where("requirement = 'required'").select(
        "doc_type", "version", F.when(F.col("kind") == "chapter", "FMT-CH").otherwise("FMT-AP").alias("family"), "order", F.array("marker").alias("markers"), "title",
    )
    rows = present.where(F.size("present") > 0).join(needed.unionByName(first), ["doc_type", "version"]).where(~F.arrays_overlap("markers", "present"))
    names, ref = F.array_join("markers", "、"), F.concat(F.col("version"), F.lit("年版官方範本"))
    whole = F.concat(names, F.lit("、"), "title")
    by = lambda ch, ap, xor: F.when(F.col("family") == "FMT-CH", ch).when(F.col("family") == "FMT-AP", ap).otherwise(xor)
    name = by(F.concat(F.lit("必附章節："), whole), F.concat(F.lit("必附附錄："), whole), F.concat(F.lit("擇一填寫："), names))
    message = by(
        F.concat(F.lit("未偵測到必附章節「"), whole, F.lit("」")), F.concat(F.lit("未偵測到必附附錄「"), whole, F.lit("」（"), ref, F.lit("必附）")),
        F.concat(F.lit("擇一填寫群「"), names, F.lit("」未偵測到任一節（應擇一填寫）")),
    )
    number = F.lpad(F.col("order").cast("string"), 2, "0")
    return rows.select("doc_id", F.concat("family", F.lit("-"), number).alias("rule_id"), name.alias("rule_name"), F.lit("fail").alias("status"), F.when(F.col("family") == "FMT-XOR", "medium").otherwise("high").alias("severity"), message.alias("message"), ref.alias("reference"))


def doc_kind(filename: Column) -> Column:
    """A template's kind by its file name: the first name that it holds."""
    return F.coalesce(*[F.when(F.contains(filename, F.lit(k)), F.lit(k)) for k in fixed.DOC_KINDS])


def neighbours(versions: DataFrame, year: str = "year") -> DataFrame:
    """Each version's year and the one before it: `year, before` (a few rows)."""
    return versions.select(year).distinct().withColumn("before", F.lag(year).over(W.orderBy(year))).where("before is not null")


def field_changes(fields: DataFrame, versions: DataFrame) -> DataFrame:
    """Form fields (year, name, status, note) added, updated or removed from a version to the next."""
    order = neighbours(versions)
    new = fields.join(order, "year").select("year", "name", F.col("status").alias("new_status"), "note", F.lit(True).alias("is_new"))
    old = fields.join(order.select(F.col("before").alias("year"), F.col("year").alias("next")), "year").select(F.col("next").alias("year"), "name", F.col("status").alias("old_status"), F.lit(True).alias("is_old"))
    both = new.join(old, ["year", "name"], "full_outer")
    change = F.when(F.col("is_old").isNull(), "added").when(F.col("is_new").isNull(), "removed").when(~F.col("new_status").eqNullSafe(F.col("old_status")), "updated")
    return both.withColumn("change", change).where("change is not null").select("year", "name", "change", "old_status", "new_status", F.coalesce("note", F.lit("")).alias("note"))


def rule_changes(rules: DataFrame, versions: DataFrame) -> DataFrame:
    """Technical rules (year, key, formula) whose formula is another one in the next version and isn't empty there."""
    order = neighbours(versions)
    new = rules.join(order, "year").select("year", "key", F.col("formula").alias("curr"))
    old = rules.join(order.select(F.col("before").alias("year"), F.col("year").alias("next")), "year").select(F.col("next").alias("year"), "key", F.col("formula").alias("prev"))
    both = new.join(old, ["year", "key"], "full_outer").fillna("", ["curr", "prev"])
    return both.where("curr <> prev and curr <> ''").select("year", "key", "prev", "curr")


def structure_changes(structures: DataFrame) -> DataFrame:
    """Numbers of appendices and chapters (year, appendices, main_chapters) that differ from the version before."""
    w = W.orderBy("year")
    rows = structures.withColumn("a", F.lag("appendices").over(w)).withColumn("m", F.lag("main_chapters").over(w)).withColumn("before", F.lag("year").over(w)).where("before is not null")
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    line = lambda name, old, new: F.when(~F.col(old).eqNullSafe(F.col(new)), F.concat(F.lit(f"{name}："), shown(old), F.lit(" → "), shown(new)))
    return rows.select("year", F.posexplode(F.array_compact(F.array(line("附錄數量", "a", "appendices"), line("主文章數", "m", "main_chapters")))).alias("seq", "change"))


def revisions(rows: DataFrame) -> DataFrame:
    """Key revisions (year, seq, impact, ...) with their rank, by impact and then as listed."""
    return rows.withColumn("impact_order", rank_of(F.coalesce("impact", F.lit("minor")), fixed.IMPACT_RANK)).orderBy("year", "impact_order", "seq")
