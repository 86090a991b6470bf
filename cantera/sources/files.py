"""Scans of document folders: JSON, built HTML pages and sitemaps."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from cantera.functions.geo import inside_box


def json_documents(spark: SparkSession, folder: str, schema: StructType, recursive: bool = False) -> DataFrame:
    """A JSON document a file, with its path, position and, if it can't be read, its text in ``_corrupt``.

    A folder that doesn't exist has no documents.
    """
    full = StructType([*schema.fields, StructField("_corrupt", StringType())])
    try:
        rows = spark.read.schema(full).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").option("pathGlobFilter", "*.json").option("recursiveFileLookup", recursive).json(folder)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], StructType([*full.fields, StructField("path", StringType()), StructField("state", StringType())]))
    return rows.withColumn("path", F.col("_metadata.file_path")).withColumn("state", F.when(F.col("_corrupt").isNull(), "available").otherwise("invalid"))


def json_or(spark: SparkSession, path: str, schema: StructType, fallback: list[tuple]) -> DataFrame:
    """A JSON document or, where no file is, the given rows; other errors are raised."""
    try:
        return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame(fallback, schema)


def states(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """(name, state) of wanted documents: available, invalid or missing; ``documents`` (path, state) are cached or written, names stand at the end of paths."""
    found = documents.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "state").groupBy("name").agg(F.min("state").alias("state"))
    return wanted.select("name").distinct().join(found, "name", "left").select("name", F.coalesce("state", F.lit("missing")).alias("state"))


def typed_documents(spark: SparkSession, folders: dict[str, str], schema: StructType, kind: str = "_type") -> tuple[DataFrame, DataFrame]:
    """(documents, issues) of folders that each hold documents of one type, by type.

    Documents that can't be read, or whose type is another one, are issues (path, code); the
    scan goes on.
    """
    rows = None
    for expected, folder in folders.items():
        some = json_documents(spark, folder, schema).withColumn("expected", F.lit(expected))
        rows = some if rows is None else rows.unionByName(some)
    code = F.when(F.col("state") == "invalid", "unreadable").when(~F.col(kind).eqNullSafe(F.col("expected")), "type")
    rows = rows.withColumn("_code", code)
    good = rows.filter("_code is null").drop("_code", "_corrupt", "state", "expected")
    return good, rows.filter("_code is not null").select("path", F.col("_code").alias("code"))


def changed_files(now: DataFrame, before: DataFrame) -> DataFrame:
    """Files (path, modified, size) that are new or differ from the previous listing."""
    return now.join(before, ["path", "modified", "size"], "left_anti")


def merged_index(index: DataFrame, parsed: DataFrame, now: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(index, warnings): an index (path, modified, size, state, …) brought up to the listing ``now``.

    ``parsed`` has the rows of the files that changed; the others keep theirs, and rows of
    files that are gone go. Rows that couldn't be read are warnings (path, warning).
    """
    kept = index.join(parsed.select("path"), "path", "left_anti").join(now.select("path"), "path", "left_semi")
    both = kept.unionByName(parsed)
    return both, both.filter("state <> 'available'").select("path", F.col("state").alias("warning"))


def listing(spark: SparkSession, folder: str, glob: str = "*.json") -> DataFrame:
    """(path, modified, size) of the files of a folder and those below it; their content isn't read."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(folder)
    return rows.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"))


def relative_paths(spark: SparkSession, folder: str, glob: str = "*.json") -> DataFrame:
    """The paths of the files below a folder, from there, in the order of code points."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(folder)
    base = F.regexp_replace(F.lit(folder.rstrip("/")), r"^file:/*", "/")
    return rows.select(F.substr(F.regexp_replace("path", r"^file:/*", "/"), F.length(base) + 2).alias("path")).orderBy("path")


def map_elements(spark: SparkSession, path: str) -> DataFrame:
    """The elements of a map extract, one a row: type, id, lat, lon, center and tags."""
    schema = "elements array<struct<type: string, id: bigint, lat: double, lon: double, center: struct<lat: double, lon: double>, tags: map<string, string>>>"
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("elements").alias("e")).select("e.*").filter("type in ('node', 'way', 'relation') and id is not null")


def extract_run(records: DataFrame, types: list[str], box: tuple[float, float, float, float]) -> tuple[DataFrame, str]:
    """(records, status) of a local extract: those of the types and inside the box; none at all is anomalous."""
    found = records.filter(F.col("type").isin(*types) & inside_box(F.col("lat"), F.col("lng"), *box))
    return found, "anomalous-empty" if found.isEmpty() else "completed"


def manual_rows(spark: SparkSession, path: str, item: str, required: list[str]) -> DataFrame:
    """Rows of a JSON array with their place in it, from 0; a missing required field is an error that names the row."""
    text = spark.read.option("wholetext", True).text(path)
    rows = text.select(F.posexplode(F.from_json("value", f"array<struct<{item}>>", {"mode": "FAILFAST"})).alias("ord", "r"))
    missing = F.array_compact(F.array(*[F.when(F.coalesce(F.trim(F.col(f"r.{c}").cast("string")), F.lit("")) == "", F.lit(c)) for c in required]))
    checked = F.when(F.size(missing) > 0, F.raise_error(F.concat(F.lit("row "), F.col("ord"), F.lit(" lacks "), F.array_join(missing, ", ")))).otherwise(F.col("ord"))
    return rows.select(checked.cast("int").alias("ord"), "r.*")


def html_pages(spark: SparkSession, folder: str) -> DataFrame:
    """(route, html) of a built site; index pages have the route of their folder."""
    rows = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.html").text(folder)
    base = F.regexp_replace(F.lit(folder.rstrip("/")), r"^file:/*", "/")
    path = F.regexp_replace(F.col("_metadata.file_path"), r"^file:/*", "/")
    return rows.select(F.regexp_replace(F.substr(path, F.length(base) + 1), r"index\.html$", "").alias("route"), F.col("value").alias("html"))


_LOC = r"<loc>\s*([^<\s]+)\s*</loc>"


def sitemap_urls(spark: SparkSession, files: str) -> DataFrame:
    """The distinct locations that sitemap files list, less those that name sitemaps."""
    text = spark.read.option("wholetext", True).text(files)
    urls = text.select(F.explode(F.regexp_extract_all("value", F.lit(_LOC), 1)).alias("url"))
    return urls.filter(~F.endswith("url", F.lit(".xml"))).distinct()


def indexed_sitemap_urls(spark: SparkSession, folder: str, index: str = "sitemap-index.xml") -> DataFrame:
    """The distinct locations of the sitemaps that an index names; the files stand beside the index."""
    loc = F.explode(F.regexp_extract_all("value", F.lit(_LOC), 1)).alias("url")
    named = spark.read.option("wholetext", True).text(f"{folder.rstrip('/')}/{index}").select(loc).select(F.regexp_extract("url", r"([^/]+)$", 1).alias("file")).distinct()
    text = spark.read.option("wholetext", True).option("pathGlobFilter", "*.xml").text(folder).withColumn("file", F.regexp_extract("_metadata.file_path", r"([^/]+)$", 1))
    return text.join(named, "file", "left_semi").select(loc).distinct()
