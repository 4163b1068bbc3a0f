"""Sources and sinks: documents, pages, worker events, gold answers, lifecycle tables, coordination records."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .. import schemas
from ..functions import names as N

# Extensions and their routes.
ROUTES = {"office": ["docx", "docm"], "text": ["txt", "md", "markdown"], "pdf": ["pdf"], "ocr": ["png", "jpg", "jpeg", "tif", "tiff"]}
LISTED = ["pdf", "docx", "txt", "md", "markdown", "png", "jpg", "jpeg", "tif", "tiff"]
GIB = 1 << 30
LINE_BYTES = 1 << 20


class _Folder(InputPartition):
    def __init__(self, path: str, deep: bool):
        self.path, self.deep = path, deep


class _FolderReader(DataSourceReader):
    """Folders two levels deep are parts of their own; each part is walked on an executor."""

    def __init__(self, root: str):
        self.root = root

    def partitions(self) -> list[_Folder]:
        found, level = [], [self.root]
        for _ in range(2):
            found += [_Folder(p, False) for p in level]
            level = [e.path for p in level for e in os.scandir(p) if e.is_dir(follow_symlinks=False)]
        return found + [_Folder(p, True) for p in level]

    def read(self, partition: _Folder):
        waiting = [partition.path]
        while waiting:
            with os.scandir(waiting.pop()) as entries:
                for e in entries:
                    if e.is_dir(follow_symlinks=False):
                        if partition.deep:
                            waiting.append(e.path)
                    elif e.is_file(follow_symlinks=False):
                        s = e.stat(follow_symlinks=False)
                        yield e.path, s.st_size, int(s.st_mtime)


class FolderSource(DataSource):
    """Files below a folder that all executors see, by their names and stat alone: no content is opened, no symlink followed or listed."""

    @classmethod
    def name(cls) -> str:
        return "folder_listing"

    def schema(self) -> str:
        return "path string, size long, modified_secs long"

    def reader(self, schema) -> _FolderReader:
        return _FolderReader(self.options["path"])


def listing(spark: SparkSession, root: str) -> DataFrame:
    """path, size, modified_secs of all files below root: a folder, or a place of any file system that Spark reads."""
    local = root.removeprefix("file://") if root.startswith("file:///") else root
    if local.startswith("/"):
        spark.dataSource.register(FolderSource)
        return spark.read.format("folder_listing").load(local)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select("path", F.col("length").alias("size"), F.unix_timestamp("modificationTime").alias("modified_secs"))


# S01
def scan(spark: SparkSession, root: str, extensions: list[str] = LISTED) -> DataFrame:
    """path, relative_path, size, modified_secs of the supported files below root, by relative path; contents aren't read."""
    name = N.leaf(F.col("path"))
    keep = (F.col("size") > 0) & ~name.startswith(".") & ~name.startswith("~$") & N.path_extension(F.col("path")).isin(extensions)
    base = root.removeprefix("file://") if root.startswith("file:///") else root
    found = listing(spark, root).filter(keep).select("path", N.relative_path(F.col("path"), base).alias("relative_path"), "size", "modified_secs")
    return found.orderBy("relative_path")


# S02
def routed(files: DataFrame) -> DataFrame:
    """files with route; null route and error_code UNSUPPORTED_FORMAT for others."""
    ext = N.path_extension(F.col("path"))
    route = None
    for name, those in ROUTES.items():
        route = F.when(ext.isin(those), name) if route is None else route.when(ext.isin(those), name)
    return files.withColumn("route", route).withColumn("error_code", F.when(F.col("route").isNull(), "UNSUPPORTED_FORMAT"))


# S03
def text_pages(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(pages, rejects) of text and Markdown files: one page each, bad UTF-8 or over 1 GiB rejected."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    files = files.filter(N.path_extension(F.col("path")).isin(ROUTES["text"]))
    error = F.when(F.col("length") > GIB, "RESOURCE_LIMIT_EXCEEDED").when(~F.is_valid_utf8("content"), "PARSE_FAILED")
    df = files.withColumn("error_code", error)
    pages = df.filter("error_code is null").select("path", F.lit(1).alias("page_number"), F.decode("content", "UTF-8").alias("text"), F.lit("plain_text").alias("origin"))
    return pages, df.filter("error_code is not null").select("path", "error_code")


# S04
def worker_events(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, rejects) of JSON lines (value): bad JSON, other versions and types, or lines over 1 MiB are rejected."""
    parsed = lines.withColumn("e", F.from_json("value", schemas.WORKER_EVENT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    good = (F.octet_length("value") <= LINE_BYTES) & F.col("e._corrupt").isNull() & (F.col("e.protocol_version") == 1) & F.col("e.event.type").isin("hello", "progress", "parsed", "error")
    df = parsed.withColumn("good", F.coalesce(good, F.lit(False)))
    return df.filter("good").select("e.request_id", "e.event"), df.filter("not good").select("value")


def parsed_pages(events: DataFrame) -> DataFrame:
    """request_id, page_number, text, origin, ocr_confidence of parsed documents."""
    docs = events.filter("event.type = 'parsed'")
    return docs.select("request_id", F.explode("event.document.pages").alias("p")).select("request_id", "p.*")


# S05
def checked_pages(pages: DataFrame, images: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(pages, rejected doc_ids): page numbers from 1 and unique, an image only of a page that exists and as image/png.

    OCR confidence is rounded and held to 0..100.
    """
    by_doc = pages.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_distinct("page_number").alias("d"), F.min("page_number").alias("least"), F.count_if(F.col("page_number").isNull()).alias("none"))
    bad = by_doc.filter((F.col("n") != F.col("d")) | (F.col("least") < 1) | (F.col("none") > 0)).select("doc_id")
    if images is not None:
        lost = images.join(pages.select("doc_id", "page_number"), ["doc_id", "page_number"], "left_anti").select("doc_id")
        bad = bad.unionByName(lost).unionByName(images.filter(~F.col("media_type").eqNullSafe("image/png")).select("doc_id")).distinct()
    confidence = F.least(F.greatest(F.round("ocr_confidence"), F.lit(0)), F.lit(100)).cast("int")
    return pages.join(bad, "doc_id", "left_anti").withColumn("ocr_confidence", confidence), bad


# S06
def gold(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One row for each fixture of version-2 files, or of files with such an object a line; an absent list stays null, an empty one empty."""
    df = spark.read.schema(f"schema_version int, fixtures array<struct<{schemas.GOLD.replace(' ', ':').replace(',:', ',')}>>").option("multiLine", not lines).json(path)
    return df.select(F.explode("fixtures").alias("f")).select("f.*")


# S07
TABLES = {"queue_items": schemas.QUEUE_ITEMS, "proposals": schemas.STORED_PROPOSALS, "operation_receipts": schemas.RECEIPTS, "queue_sessions": schemas.SESSIONS}


def lifecycle(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One of the four lifecycle tables; columns that older files lack are null."""
    return spark.read.schema(TABLES[name]).parquet(f"{root}/{name}")


# S08
def coordination(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """Records of claims, origins or machines with file_name, file_mtime and readable (parsed, and of version 1)."""
    schema = {"claims": schemas.CLAIMS, "origins": schemas.ORIGINS, "machines": schemas.MACHINES}[kind]
    df = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("pathGlobFilter", "[!.]*.json").json(f"{root}/{kind}")
    df = df.withColumn("file_name", F.col("_metadata.file_name")).withColumn("file_mtime", F.unix_timestamp("_metadata.file_modification_time"))
    return df.withColumn("readable", F.coalesce(F.col("_corrupt").isNull() & (F.col("version") == 1), F.lit(False))).drop("_corrupt")


# S12
def with_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """df with the columns that it lacks, and nulls in them, at their defaults."""
    for name, value in defaults.items():
        df = df.withColumn(name, F.coalesce(F.col(name), F.lit(value)) if name in df.columns else F.lit(value))
    return df


# S09
def analysis_json(df: DataFrame) -> DataFrame:
    """doc_id, json: the analysis with camelCase keys."""
    proposal = F.struct(
        F.col("document_type").alias("documentType"), F.col("document_date").alias("documentDate"), F.col("date_role").alias("dateRole"), "parties", F.col("party_relation").alias("partyRelation"), "confidence"
    )
    out = F.struct("filename", "description", "status", F.col("reasons").alias("reviewReasons"), proposal.alias("proposal"), F.struct(F.col("prompt_sha256").alias("promptSha256"), F.col("prompt_characters").alias("promptCharacters")).alias("telemetry"))
    return df.select("doc_id", F.to_json(out, {"ignoreNullFields": "false"}).alias("json"))


# S10
def write_report(records: DataFrame, summary: DataFrame, path: str, pipeline: str, model: str, budget: int) -> str:
    """Records as Parquet, and the summary by flag as one JSON row, under a run of their own; returns the run.

    The run is shown by a marker that is written last, in one step: until then, and if anything fails, readers have the report before.
    """
    spark, run = records.sparkSession, uuid.uuid4().hex
    records.write.parquet(f"{path}/run={run}/records")
    flags = summary.filter(F.col("pipeline") == pipeline).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("flag", F.struct("correct", "total", "rate"))))).alias("summary"))
    head = (F.lit(2).alias("schema_version"), F.lit(pipeline).alias("pipeline"), F.lit(model).alias("model_id"), F.lit(budget).alias("budget_characters"))
    flags.select(*head, "summary").coalesce(1).write.json(f"{path}/run={run}/summary")
    jpath = spark._jvm.org.apache.hadoop.fs.Path
    fs = jpath(path).getFileSystem(spark._jsc.hadoopConfiguration())
    # markers are numbered, so that a rename never meets an older one
    number = max([-1, *_markers(spark, path)]) + 1
    out = fs.create(jpath(f"{path}/_{run}.tmp"), True)
    out.write(run.encode())
    out.close()
    if not fs.rename(jpath(f"{path}/_{run}.tmp"), jpath(f"{path}/_report-{number:012d}")):
        raise OSError(f"{path}: another report was written at the same time")
    return run


def _markers(spark: SparkSession, path: str) -> list[int]:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_report-*")
    found = jpath.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(jpath)
    return [int(x.getPath().getName().rsplit("-", 1)[1]) for x in found or ()]


def read_report(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, summary) of the last whole report."""
    if not (numbers := _markers(spark, path)):
        raise FileNotFoundError(f"no report in {path}")
    jpath = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_report-{max(numbers):012d}")
    source = jpath.getFileSystem(spark._jsc.hadoopConfiguration()).open(jpath)
    run = bytes(source.readNBytes(64)).decode()
    source.close()
    return spark.read.parquet(f"{path}/run={run}/records"), spark.read.json(f"{path}/run={run}/summary")
