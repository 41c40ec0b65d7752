"""Files in and out: entries as JSON, pages, source files, reports."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions.scalar import fragment_category, namespace_of, plain_text, strip
from glyphmill.sources.schemas import ENTRY

#: What shows that a file without a known extension holds source code, within its first HEAD_LINES lines.
SIGNATURE = r"//@version=6|indicator\s*\(|strategy\s*\(|library\s*\("
HEAD_LINES = 20
EXTENSIONS = (".ps", ".pine")


def read_entries(spark: SparkSession, path: str, schema: str = ENTRY, lines: bool = False) -> DataFrame:
    """Entries of files with one JSON array each, or of JSON ``lines``; a path that does not exist gives no rows.

    A file with one array is read by one task; lines are split.
    """
    try:
        return spark.read.schema(schema).option("multiLine", not lines).json(path)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], schema)


def read_inputs(spark: SparkSession, paths: dict[str, str], schema: str = ENTRY) -> DataFrame:
    """Entries of several optional inputs, each row with its input's name as ``origin``; an error if all are empty."""
    parts = [read_entries(spark, path, schema).withColumn("origin", F.lit(name)) for name, path in paths.items()]
    rows = reduce(DataFrame.unionByName, parts)
    if rows.isEmpty():
        raise ValueError(f"no rows in any of {sorted(paths)}")
    return rows


def write_json(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines, one file per partition."""
    rows.write.mode("overwrite").json(path)


def build_once(rows: DataFrame, path: str, force: bool = False) -> bool:
    """Write ``rows`` as Parquet unless rows are there already; with ``force`` they are replaced. Whether it wrote."""
    if not force:
        try:
            if not rows.sparkSession.read.parquet(path).isEmpty():
                return False
        except AnalysisException as missing:  # nothing there, or a folder without a file of rows
            if not any(word in str(missing) for word in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")):
                raise
    rows.write.mode("overwrite").parquet(path)
    return True


def page_links(pages: DataFrame, html: str = "html", base: str = "") -> DataFrame:
    """The discovery index of landed pages: one row per linked fragment with a known prefix, the first label in order.

    Columns: fragment, url, display_name, category, namespace. Null and empty pages give no row.
    """
    anchor = r"""(?is)<a\s[^>]*?href\s*=\s*["'][^"'#]*#([^"']+)["'][^>]*>(.*?)</a>"""
    found = pages.select(F.arrays_zip(F.regexp_extract_all(F.col(html), F.lit(anchor), F.lit(1)).alias("fragment"), F.regexp_extract_all(F.col(html), F.lit(anchor), F.lit(2)).alias("label")).alias("links"))
    rows = found.select(F.posexplode("links").alias("pos", "l")).select("pos", "l.fragment", strip(plain_text(F.col("l.label"))).alias("label"))
    known = rows.withColumn("category", fragment_category(F.col("fragment"))).filter("category != 'unknown'")
    first = known.groupBy("fragment", "category").agg(F.min_by("label", F.struct("pos", "label")).alias("display_name"))
    return first.select("fragment", F.concat(F.lit(f"{base}#"), "fragment").alias("url"), "display_name", "category", namespace_of(F.col("display_name")).alias("namespace"))


def source_files(spark: SparkSession, path: str, allowed: list[str]) -> DataFrame:
    """(path, code) of the files under ``path`` that hold source code and lie in an allowed folder.

    A file is taken by its extension, else by a signature in its first lines. A folder allows what is below it, not
    folders whose names only begin alike.
    """
    files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    place = F.regexp_replace(F.col("_metadata.file_path"), "^file:/*", "/")
    rows = files.select(place.alias("path"), F.col("value").alias("code"))
    inside = reduce(lambda a, b: a | b, [F.col("path").startswith(f"{folder.rstrip('/')}/") for folder in allowed], F.lit(False))
    named = reduce(lambda a, b: a | b, [F.col("path").endswith(e) for e in EXTENSIONS])
    signed = F.exists(F.slice(F.split("code", r"\R"), 1, HEAD_LINES), lambda line: F.rlike(line, F.lit(SIGNATURE)))
    return rows.filter(inside & (named | signed))
