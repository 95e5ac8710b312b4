"""Captures, pasted texts, uploads, URL lists, link harvest, site profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidencelake.functions import identity as I
from evidencelake.functions import urls as U

PROFILE_SCHEMA = "platform_domains map<string,string>, identifier_extractors map<string,boolean>, truncation_markers map<string,array<string>>, prompt_templates map<string,string>"


def captures(pages: DataFrame, key: Column | None = None) -> DataFrame:
    """URL inputs with their identity: source_key (the normalised URL unless given), resource_type, resource_key."""
    d = pages.withColumn("kind", F.lit("url")).withColumn("normalized_url", U.normalize_url(F.col("url"))).withColumn("resource_type", U.classify_url(F.col("url")))
    d = d.withColumn("source_key", F.coalesce(key, F.col("normalized_url")) if key is not None else F.col("normalized_url"))
    return d.withColumn("resource_key", I.resource_key(F.col("resource_type"), F.col("source_key")))


def pasted(texts: DataFrame) -> DataFrame:
    """Pasted texts, bytes kept as they are; source_key is optional and falls back to the hash of the text."""
    d = texts.where(F.trim("text") != "").withColumns({"kind": F.lit("text"), "resource_type": F.lit("text"), "role": F.lit("pasted_text")})
    d = d.withColumn("sha256", F.sha2("text", 256)).withColumn("size_bytes", F.octet_length("text").cast("long"))
    key = F.coalesce(F.col("source_key"), F.col("sha256")) if "source_key" in texts.columns else F.col("sha256")
    return d.withColumn("source_key", key).withColumn("resource_key", I.resource_key(F.lit("text"), F.col("source_key")))


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    return captures(spark.read.parquet(path))


def read_pasted(spark: SparkSession, path: str) -> DataFrame:
    """Parquet with a text column, or a folder of text files, one text each."""
    return pasted(spark.read.parquet(path) if path.endswith(".parquet") else spark.read.text(path, wholetext=True).withColumnRenamed("value", "text"))


def read_uploads(spark: SparkSession, glob: str, max_bytes: int = 1 << 30) -> DataFrame:
    """Files with type, role and hash; reject is set for empty and oversize ones, whose content isn't read.

    Both bounds on the length reach the scan, so a file that is larger than max_bytes, or than the reader itself can hold
    (spark.sql.sources.binaryFile.maxLength), is a row of its own and fails nothing. The reader leaves empty files out; they are
    added by name from the listing, which Spark's reader makes in tasks where a folder has many subfolders.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(glob)
    listed = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    empty = spark.createDataFrame([(str(s.getPath().toString()), 0) for s in listed if s.isFile() and s.getLen() == 0], "path string, length long")
    most = min(max_bytes, int(spark.conf.get("spark.sql.sources.binaryFile.maxLength", str((1 << 31) - 1))))
    files, nothing = spark.read.format("binaryFile").load(glob), F.lit(None).cast("binary").alias("content")
    meta = files.where(F.col("length") <= most).select("path", "length", "content").unionByName(files.where(F.col("length") > most).select("path", "length", nothing)).unionByName(empty.select("path", "length", nothing))
    reject = F.when(F.col("length") == 0, "empty").when(F.col("length") > most, "too_large")
    d = meta.select("path", F.col("length").alias("size_bytes"), F.when(reject.isNull(), F.col("content")).alias("body"), reject.alias("reject"))
    name = F.element_at(F.split("path", "/"), -1)
    kind = U.classify_upload(name, F.lit(None).cast("string"))
    role = F.when(kind == "pdf", "original_pdf").when(kind == "word", "original_word").when(kind == "video", "original_video").when(kind == "podcast", "original_audio").when(kind == "text", "original_text").otherwise("original_file")
    return d.select("*", name.alias("filename"), kind.alias("resource_type"), role.alias("role"), F.sha2("body", 256).alias("sha256"))


def url_lines(lines: DataFrame) -> DataFrame:
    """(line_no, url) of the lines that aren't blank; lines: (line_no, line)."""
    return lines.select("line_no", F.trim("line").alias("url")).where("url <> ''")


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("url")).where("url <> ''")


def harvest_links(lines: DataFrame) -> DataFrame:
    """(doc, line_no, section, url, display_name) from Markdown lines (doc, line_no, line): each URL of a document once, at its first place."""
    line = F.trim("line")
    heading = F.trim(F.regexp_replace(F.element_at(F.split(F.element_at(F.split(F.regexp_replace(line, "^[# ]+|[# ]+$", ""), "——"), 1), "（"), 1), r"\s+$", ""))
    carried = Window.partitionBy("doc").orderBy("line_no")
    d = lines.select("doc", "line_no", line.alias("line"), F.when(line.startswith("### "), heading).alias("_h"))
    d = d.withColumn("section", F.coalesce(F.last("_h", ignorenulls=True).over(carried), F.lit("未分类")))
    d = d.select("doc", "line_no", "section", "line", F.posexplode(F.regexp_extract_all("line", F.lit(r"https?://[^\s|)]+"), F.lit(0))).alias("pos", "url"))
    d = d.withColumn("url", F.regexp_replace("url", "[.,;!>]+$", ""))
    first = Window.partitionBy("doc", "url").orderBy("line_no", "pos")
    d = d.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    parts = F.filter(F.transform(F.split("line", r"\|"), lambda x: F.trim(x)), lambda x: x != "")
    cell = lambda i: F.get(parts, F.lit(i))
    tabular = (F.size(parts) >= 4) & (cell(1).startswith("http") | cell(0).rlike(r"^\d+$"))
    label = F.when(tabular, F.concat(cell(2), F.lit(": "), F.substring(cell(3), 1, 35))).otherwise(F.substring("line", 1, 45))
    return d.select("doc", "line_no", "section", "url", F.concat(F.lit("【"), "section", F.lit("】"), label).alias("display_name"))


def load_profiles(spark: SparkSession, path: str | None, defaults: dict[str, dict], lines: bool = False) -> dict[str, DataFrame]:
    """Dimension tables from a profile file laid over defaults: platforms(domain, platform), extractors(type, enabled), markers(domain, rank, marker).

    Unknown keys are ignored; a file that isn't valid leaves the defaults. lines: the file has a profile object on each line
    (keys are met once), which a profile of millions of sites needs; nothing of it comes to the driver.
    """
    schema = PROFILE_SCHEMA + ", _corrupt_record string"
    got = spark.read.schema(schema).option("multiLine", not lines).json(path).where("_corrupt_record is null") if path else spark.createDataFrame([], schema)

    def laid(key: str, kind: str) -> DataFrame:
        own = got.select(F.explode(key).alias("key", "value"))
        base = spark.createDataFrame(list(defaults.get(key, {}).items()), f"key string, value {kind}")
        return base.join(own.select("key").distinct(), "key", "left_anti").unionByName(own)

    return {
        "platforms": laid("platform_domains", "string").select(F.lower("key").alias("domain"), F.col("value").alias("platform")),
        "extractors": laid("identifier_extractors", "boolean").select(F.col("key").alias("type"), F.col("value").alias("enabled")),
        "markers": laid("truncation_markers", "array<string>").select(F.lower("key").alias("domain"), F.posexplode("value").alias("rank", "marker")),
    }
