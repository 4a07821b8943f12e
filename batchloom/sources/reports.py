"""Run reports: one JSON document per run, and the catalog made from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from batchloom import schemas as S
from batchloom.functions.display import report_name
from batchloom.operators.runs import runs_newest_first

MANIFEST = "reports.json"
WRITTEN = "file"
TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def read_run_reports(spark: SparkSession, folder: str) -> DataFrame:
    """``(file, report)`` for every report in the folder but the manifest.

    A file that does not parse fails the read. Loose ``*.json`` files hold one document each and carry their own
    name; reports written by ``write_run_reports`` carry theirs in their folder, one document per line, so that runs
    with the same finish time stay apart as rows. Other sub-folders are not read, whatever their names end with, nor
    is a manifest, be it a file or a folder.
    """
    reader = spark.read.schema(S.REPORT).option("mode", "FAILFAST")
    report = F.struct(*S.REPORT.fieldNames()).alias("report")
    parts = []
    if any(s.isFile() for s in _listed(spark, f"{folder}/*.json")):
        loose = reader.option("multiLine", True).json(f"{folder}/*.json")
        own = F.col("_metadata.file_name")
        # The pattern also matches folders: only files that lie directly in this folder are reports.
        steps = F.size(F.split(F.regexp_replace("_metadata.file_path", "^[^:/]+:(//[^/]*)?", ""), "/"))
        kept = (own != MANIFEST) & (steps == _depth(spark, folder) + 1)
        parts.append(loose.filter(kept).select(own.alias("file"), report))
    if any(_listed(spark, f"{folder}/{WRITTEN}=*")):
        written = spark.read.schema(f"{WRITTEN} string, {_fields()}").option("mode", "FAILFAST")
        named = written.option("basePath", folder).json(f"{folder}/{WRITTEN}=*")
        parts.append(named.select(F.concat(WRITTEN, F.lit(".json")).alias("file"), report))
    if not parts:
        next(iter(_listed(spark, folder)))  # a folder that is not there is an error, an empty one is not
        return spark.createDataFrame([], f"file string, report {S.REPORT.simpleString()}")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _listed(spark: SparkSession, glob: str):
    """Paths that match, without opening a file."""
    path = spark._jvm.org.apache.hadoop.fs.Path(glob)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    if found is None:
        raise FileNotFoundError(glob)
    return list(found)


def _depth(spark: SparkSession, folder: str) -> int:
    """Parts of the folder's full path, the empty one before its first slash included."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path)
    return len(whole.toUri().getPath().split("/"))


def _fields() -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in S.REPORT.fields)


def write_run_reports(reports: DataFrame, folder: str) -> None:
    """One JSON document per report, in a folder named by its finish time."""
    name = F.regexp_replace(report_name(F.col("finished_at")), r"\.json$", "")
    rows = reports.select(*S.REPORT.fieldNames()).withColumn(WRITTEN, name)
    rows.write.mode("append").option("timestampFormat", TIME_FORMAT).partitionBy(WRITTEN).json(folder)


def write_run_manifest(manifest: DataFrame, path: str) -> None:
    """The ``(file, report)`` list, newest first; files keep no order, so readers sort again."""
    runs_newest_first(manifest.select("file", "report")).write.mode("overwrite").option(
        "timestampFormat", TIME_FORMAT
    ).json(path)


def read_run_manifest(spark: SparkSession, path: str) -> DataFrame:
    schema = f"file string, report {S.REPORT.simpleString()}"
    listed = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return runs_newest_first(listed)
