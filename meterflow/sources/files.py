"""Files as tables: listings, lines in order, newest files, caches that know what they were built from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def listing(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """(path, name, size, modified) without reading contents; office lock files (~$) are left out."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(path)
    rows = found.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return rows.where(~F.startswith("name", F.lit("~$"))).distinct()


def newest(files: DataFrame) -> DataFrame:
    """The latest file; of equally new ones the last by path."""
    return files.groupBy().agg(F.max_by(F.struct(*files.columns), F.struct("modified", "path")).alias("f")).where("f IS NOT NULL").select("f.*")


def texts(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, name, modified, text): whole files. Files of this kind are small; each is one row."""
    read = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").text(path, wholetext=True)
    at = F.col("_metadata.file_path")
    return read.select(at.alias("path"), F.element_at(F.split(at, "/"), -1).alias("name"), F.col("_metadata.file_modification_time").alias("modified"), F.regexp_replace("value", "^\ufeff", "").alias("text"))


def lines(files: DataFrame) -> DataFrame:
    """(path, name, modified, row, line): a file's lines in order, numbered from 0."""
    return files.select("path", "name", "modified", F.posexplode(F.split("text", "\r\n|\n|\r")).alias("row", "line"))


def plain_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def cells(line: Column) -> Column:
    """The cells of a CSV line; quoted cells may hold commas."""
    found = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(r',(?:"((?:[^"]|"")*)"|([^,]*))'), F.lit(0))
    return F.transform(found, lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.substr(c, F.lit(2)), '^"|"$', ""), '""', '"')))


def file_lines(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, name, modified, row, line) of text files read by line: a large file is many tasks.

    row orders the lines of a file: where the line's block starts plus its place among the task's lines.
    Blocks before a file's last fill a task each and have no more lines than bytes, so a later block's
    rows are always greater.
    """
    read = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").text(path)
    at = F.col("_metadata.file_path")
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    return read.select(
        at.alias("path"),
        F.element_at(F.split(at, "/"), -1).alias("name"),
        F.col("_metadata.file_modification_time").alias("modified"),
        (F.col("_metadata.file_block_start") + place).alias("row"),
        F.regexp_replace("value", "^\ufeff", "").alias("line"),
    )


def _first_lines(files: DataFrame) -> DataFrame:
    """(path, first) of whole texts or of lines."""
    if "line" in files.columns:
        return files.groupBy("path").agg(F.min_by("line", "row").alias("first"))
    return files.select("path", F.element_at(F.split("text", "\r\n|\n|\r"), 1).alias("first"))


def csv_rows(files: DataFrame, spellings: dict[str, list[str]]) -> DataFrame:
    """Rows of CSV files whose headers differ in spelling and order: (path, name, modified, row, one string column per canonical name).

    files: whole texts (path, name, modified, text) or lines (file_lines). A column a file lacks is null
    in its rows; the first header that spells a name wins. Of lines, repeats of the header are left out.
    """
    heads = F.transform(cells(F.col("first")), plain_name)

    def position(names: list[str]) -> Column:
        known = F.array(*(F.lit("".join(c for c in n.lower() if c.isascii() and c.isalnum())) for n in names))
        return F.coalesce(F.array_position(F.transform(heads, lambda h: F.array_contains(known, h)), True), F.lit(0))

    at = {c: position(names).cast("int").alias(f"_at_{c}") for c, names in spellings.items()}
    columns = _first_lines(files).select("path", "first", *at.values())
    rows = files if "line" in files.columns else lines(files).where("row > 0")
    rows = rows.where("trim(line) <> ''").join(columns, "path")
    if "line" in files.columns:
        rows = rows.where(F.col("line") != F.col("first"))
    rows = rows.withColumn("cells", cells(F.col("line")))
    return rows.select("path", "name", "modified", "row", *(F.when(F.col(f"_at_{c}") > 0, F.try_element_at("cells", F.greatest(F.col(f"_at_{c}"), F.lit(1)))).alias(c) for c in at))


def headers(files: DataFrame) -> DataFrame:
    """(path, header) the plain names of each file's header cells, in order."""
    return _first_lines(files).select("path", F.transform(cells(F.col("first")), plain_name).alias("header"))


def manifest(files: DataFrame) -> list[tuple[str, int, str]]:
    """(name, size, modified) of each file, sorted: what a cache was built from."""
    rows = files.select("name", "size", F.date_format("modified", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("modified")).collect()
    return sorted((r.name, r.size, r.modified) for r in rows)


def cached(spark: SparkSession, files: DataFrame, build, path: str) -> DataFrame:
    """The table `build()` makes from files, kept as Parquet under path and made again when any file is added, removed or replaced.

    The manifest is written after the table, so a half-written cache counts as none. With no source
    files at all an existing cache is used as it is.
    """
    now = manifest(files)
    kept = None
    try:
        kept = sorted((r.name, r.size, r.modified) for r in spark.read.schema("name string, size long, modified string").json(f"{path}/manifest").collect())
    except Exception:  # noqa: BLE001  no manifest, or one that cannot be read: build
        kept = None
    if kept is None or (now and kept != now):
        if not now:
            raise FileNotFoundError(f"no source files, and no cache at {path}")
        build().write.mode("overwrite").parquet(f"{path}/table")
        spark.createDataFrame(now, "name string, size long, modified string").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return spark.read.parquet(f"{path}/table")


def appended(rows: DataFrame, path: str) -> None:
    """Adds rows to a log of JSON lines."""
    rows.write.mode("append").json(path)


def with_neighbours(rows: DataFrame, value: Column, name: str, group: list[str], order: list[str]) -> DataFrame:
    """Adds the nearest preceding non-null value within a group: an as-of join by position."""
    by = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(by))
