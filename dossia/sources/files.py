"""Files as tables: documents, templates, wiki versions, gold cases, case notes and regulation text."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossia.functions.text import nfkc

ODT = "{urn:oasis:names:tc:opendocument:xmlns:text:1.0}"
DEFAULT_REGULATION = "臺北市都市更新111年版法規重點（都更條例、容積獎勵辦法）"
REGULATION_CHARS = 3000


def pdf_metadata(spark: SparkSession, path: str) -> DataFrame:
    """`path, filename, total_pages, file_size_mb` of PDF files.

    Pages are counted by their objects in the file's bytes; files that keep objects compressed give the count of their page tree.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").load(path)
    text = F.decode("content", "ISO-8859-1")
    objects = F.regexp_count(text, F.lit(r"/Type\s*/Page(?![A-Za-z])"))
    tree = F.array_max(F.transform(F.regexp_extract_all(text, F.lit(r"/Count\s+(\d+)"), 1), lambda x: x.cast("int")))
    pages = F.when(objects > 0, objects).otherwise(F.coalesce(tree, F.lit(0)))
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), pages.cast("int").alias("total_pages"), F.round(F.col("length") / 1048576, 1).alias("file_size_mb"))


def valid_pdf_paths(paths: DataFrame, folder: str, column: str = "path") -> DataFrame:
    """Paths of PDF files inside a folder, with no step out of it."""
    inside = F.startswith(F.col(column), F.lit(folder.rstrip("/") + "/")) & ~F.col(column).rlike(r"(^|/)\.\.(/|$)")
    return paths.where(inside & F.lower(column).endswith(".pdf"))


def odt_headings(spark: SparkSession, path: str) -> DataFrame:
    """Headings of ODT files in order: `path, seq, level, text`."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name, content in zip(frame["path"], frame["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    root = ElementTree.fromstring(z.read("content.xml"))
                for k, h in enumerate(root.iter(f"{ODT}h")):
                    rows.append((name, k, int(h.get(f"{ODT}outline-level") or 0), "".join(h.itertext()).strip()))
            yield pd.DataFrame(rows, columns=["path", "seq", "level", "text"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.odt").load(path)
    return files.select("path", "content").mapInPandas(run, "path string, seq int, level int, text string")


SECTIONS = "doc_type string, version string, source string, sections array<struct<marker:string,title:string,kind:string,requirement:string,`order`:int>>"


def read_schemas(spark: SparkSession, path: str) -> DataFrame:
    """Template schemas, a JSON file each, as a row a section; files that aren't JSON give nothing."""
    rows = spark.read.schema(SECTIONS).option("multiLine", True).option("mode", "PERMISSIVE").json(path).where("doc_type is not null")
    return rows.select("doc_type", "version", "source", F.explode("sections").alias("s")).select("doc_type", "version", "source", "s.*")


def write_schemas(sections: DataFrame, path: str) -> None:
    """One JSON object a template, its sections in order."""
    item = F.struct("order", "marker", "title", "kind", "requirement")
    own = F.transform(F.array_sort(F.collect_list(item)), lambda s: F.struct(s["marker"].alias("marker"), s["title"].alias("title"), s["kind"].alias("kind"), s["requirement"].alias("requirement"), s["order"].alias("order")))
    sections.groupBy("doc_type", "version", "source").agg(own.alias("sections")).write.mode("overwrite").json(path)


def read_wiki(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Wiki versions (YAML files) as tables: versions, revisions, rules, fields and structures. Needs a YAML reader."""
    import yaml

    found = [yaml.safe_load(r[0]) for r in spark.read.text(path, wholetext=True).toLocalIterator()]  # a file for each version
    text = lambda x: None if x is None else str(x)
    rows: dict[str, list] = {k: [] for k in ("versions", "revisions", "rules", "fields", "structures")}
    for d in found:
        year = int(d["year"])
        rows["versions"].append((year, text(d.get("version")), text(d.get("effective_date")), text(d.get("end_date")), text(d.get("revision_summary") or "")))
        for k, r in enumerate(d.get("key_revisions") or []):
            confidence = r.get("data_confidence", d.get("data_confidence", "high"))
            rows["revisions"].append((year, k, text(r.get("category")), text(r.get("title")), r.get("type", "amendment"), r.get("impact", "minor"), text(r.get("reference")), confidence, text(r.get("note"))))
        for key, r in (d.get("technical_rules") or {}).items():
            formula, note, since = (r.get("formula", ""), r.get("note", ""), r.get("since", "")) if isinstance(r, dict) else (str(r), "", "")
            rows["rules"].append((year, key, text(formula), text(note), text(since)))
        for r in d.get("form_fields") or []:
            rows["fields"].append((year, r["name"], r.get("status"), r.get("note", "")))
        s = d.get("doc_structure") or {}
        rows["structures"].append((year, s.get("appendices"), s.get("main_chapters")))
    schemas = {
        "versions": "year int, version string, effective_date string, end_date string, revision_summary string", "rules": "year int, key string, formula string, note string, since string",
        "revisions": "year int, seq int, category string, title string, type string, impact string, reference string, data_confidence string, note string",
        "fields": "year int, name string, status string, note string", "structures": "year int, appendices int, main_chapters int",
    }
    return {k: spark.createDataFrame(rows[k], schemas[k]) for k in rows}


GOLD = """cases array<struct<id:string,description:string,reg_year:string,fields:struct<bonus_items:array<struct<name:string,rate_pct:double,legal_basis:string>>,bonus_total_pct:double,
consent_ratio:struct<owner_count_pct:double,land_area_pct:double,source_page:int>,application_date:string,affidavit_date:string,power_of_attorney_date:string,implementer_name:string,land_area_sqm:double>,expected_rule_ids:array<string>>>"""


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """Gold cases with their extracted fields and the rules that must fire; what is missing has its default."""
    rows = spark.read.schema(GOLD).option("multiLine", True).json(path).select(F.explode("cases").alias("c")).select("c.*")
    none = F.array().cast("array<string>")
    f = F.col("fields")
    rates = F.transform(F.coalesce(f["bonus_items"], F.array().cast("array<struct<name:string,rate_pct:double,legal_basis:string>>")), lambda x: x["rate_pct"])
    dates = [f[c].alias(c) for c in ("application_date", "affidavit_date", "power_of_attorney_date")]
    return rows.select(
        "id", F.coalesce("description", F.lit("")).alias("description"), F.coalesce("reg_year", F.lit("111")).alias("reg_year"), rates.alias("bonus_items"), f["bonus_total_pct"].alias("bonus_total_pct"),
        f["consent_ratio"]["owner_count_pct"].alias("owner_pct"), f["consent_ratio"]["land_area_pct"].alias("area_pct"), *dates, F.array(*dates).alias("dates"),
        F.coalesce("expected_rule_ids", none).alias("expected_rule_ids"),
    )


def case_notes(cases: DataFrame) -> DataFrame:
    """The notes kept of each case, with names for display and the time of upload in UTC."""
    from dossia.operators.history import display_name

    stamp = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    meta = F.coalesce("meta_id", F.substring(F.sha2(F.concat_ws("|", "bp_key", "case_name"), 256), 1, 12))
    return cases.select(
        meta.alias("meta_id"), "case_name", "bp_key", display_name(F.col("bp_filename")).alias("bp_filename"), "re_key", display_name(F.col("re_filename")).alias("re_filename"), "annotated_key",
        stamp.alias("uploaded_at"), F.lit(1).alias("audit_count"),
    )


CASES = "meta_id string, case_name string, bp_key string, bp_filename string, re_key string, re_filename string, annotated_key string, uploaded_at string, audit_count int"


def write_cases(cases: DataFrame, path: str) -> None:
    case_notes(cases).write.mode("append").json(path)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CASES).json(path)


def regulation_text(spark: SparkSession, path: str | None) -> str:
    """The first characters of the regulation's text, or a line that says what it is about where there is none."""
    try:
        row = spark.read.text(path, wholetext=True).select(F.substring("value", 1, REGULATION_CHARS)).first() if path else None
    except Exception as e:  # a missing path is an AnalysisException of the session's kind
        if "PATH_NOT_FOUND" not in str(e):
            raise
        row = None
    return row[0] if row else DEFAULT_REGULATION


def pages_of_text(spark: SparkSession, path: str) -> DataFrame:
    """Pages of text files, a document each with form feeds between pages: `doc_id, page_num, text`, normalised."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("doc_id"), F.posexplode(F.split("value", "\f")).alias("k", "text"))
    return files.select("doc_id", (F.col("k") + 1).alias("page_num"), nfkc(F.col("text")).alias("text"))


