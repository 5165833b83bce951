"""Sources and sinks: S1 URL list, S2 URL-column search, S3 pages, S4 frames, S8-S10 results."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from navbuckets.functions.text import decode_entities

# URL column names tried in order (exact, then case-insensitive).
URL_COLUMNS = ["companyUrl", "url", "link", "Website", "career_page_url", "Website URL"]
URL_COLUMNS_STRICT = ["companyUrl", "url", "link", "Website", "career_page_url"]
IFRAME_RE = r"""(?i)<iframe\b[^"'>]*+(?:(?:"[^"]*+"|'[^']*+')[^"'>]*+)*+>"""
SRCDOC_RE = r"""(?i)\ssrcdoc\s*=\s*("[^"]*+"|'[^']*+')"""
# pandas' default NA tokens (read as null, so such cells become 'invalid_url').
NULL_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
               "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def read_url_list(spark: SparkSession, path: str, columns: list[str] | None = None,
                  null_tokens: list[str] | None = None) -> DataFrame:
    """CSV with a header, every column a string, blanks -> null, short rows padded with null.

    ``columns``: the header names when known (an explicit schema, no inference pass).
    ``null_tokens``: cells equal to one of these become null (default: none besides blanks).
    """
    r = spark.read.option("header", True).option("mode", "PERMISSIVE").option("escape", '"')  # "" inside quotes
    if columns is not None:
        r = r.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    else:
        r = r.option("inferSchema", False)
    df = r.csv(path)
    if null_tokens:
        df = df.select(*[F.when(F.col(f"`{c}`").isin(null_tokens), F.lit(None)).otherwise(F.col(f"`{c}`")).alias(c)
                         for c in df.columns])
    return df


def url_column_flags(df: DataFrame) -> DataFrame:
    """S2 content step: one aggregate pass giving, per column, whether any value holds 'http'."""
    return df.agg(*[F.coalesce(F.bool_or(F.col(f"`{c}`").cast("string").contains("http")), F.lit(False)).alias(c)
                    for c in df.columns])


def find_url_column(df: DataFrame, names: list[str] | None = None, case_insensitive: bool = True) -> str:
    """Exact name in priority order, then a case-insensitive name in column order, then the
    first column holding 'http', else the first column. The content step is one aggregate
    whose single result row is read on the driver (size bounded by the column count)."""
    names = names if names is not None else URL_COLUMNS
    for n in names:
        if n in df.columns:
            return n
    if case_insensitive:
        low = [n.lower() for n in names]
        for c in df.columns:
            if c.lower() in low:
                return c
    flags = url_column_flags(df).first().asDict()
    for c in df.columns:
        if flags.get(c):
            return c
    return df.columns[0]


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """S3: page snapshots ``(page_id, url, html)``."""
    return spark.read.parquet(path).select("page_id", "url", "html")


def frames_from_srcdoc(pages: DataFrame) -> DataFrame:
    """``frames(page_id, frame_idx, html)``: the main document as frame -1, then the ``srcdoc``
    documents (either quote, entities decoded). All iframes count in document order from 0, also
    those with a ``src`` only, whose document is not part of the page."""
    main = pages.select("page_id", F.lit(-1).alias("frame_idx"), "html")
    tags = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(IFRAME_RE), F.lit(0))).alias("frame_idx", "tag"))
    docs = tags.withColumn("raw", F.regexp_extract("tag", SRCDOC_RE, 1)).filter(F.length("raw") > 0)
    sub = docs.select("page_id", F.col("frame_idx").cast("int").alias("frame_idx"),
                      decode_entities(F.substring(F.col("raw"), F.lit(2), F.length("raw") - 2), attribute=True).alias("html"))
    return main.unionByName(sub)


def write_results(df: DataFrame, path: str, fmt: str = "parquet", row_id: str = "row_id",
                  mode: str = "overwrite") -> None:
    """Results in input order across and within files (range partitioning by row_id,
    then a sort inside each partition -- no single-task global sort)."""
    out = df.repartitionByRange(row_id).sortWithinPartitions(row_id)
    w = out.write.mode(mode)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def commit_results(df: DataFrame, path: str, run_id: str, row_id: str = "row_id") -> None:
    """S8/S9 committed: the rows of one run, in order of ``row_id`` across and within its files, and a
    manifest that names the files with their first row and number of rows, in that order.

    Data files go to a folder of their own, which no reader knows until the manifest is written after
    them, so a run that fails or is repeated never shows half of its rows. A repeated run writes a newer
    manifest and thereby replaces its own rows only. What a failed or replaced run left is removed by
    ``clean_results``. ``run_id``: letters, digits, '-' and '_'.
    """
    spark, folder = df.sparkSession, f"{path.rstrip('/')}/data/{run_id}-{uuid.uuid4().hex}"
    write_results(df, folder, row_id=row_id)
    done = spark.read.schema(df.schema).parquet(folder)
    files = done.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.min(row_id).cast("string").alias("first_row"), F.count(F.lit(1)).alias("n"),
                                                                         F.min(row_id).alias("first"))
    listed = files.select(F.lit(run_id).alias("run_id"), F.lit(folder).alias("folder"), "file", "first_row", "n",
                          F.row_number().over(Window.orderBy("first")).alias("ordinal"))  # one row a file
    empty = spark.createDataFrame([(run_id, folder, None, None, 0, 0)], MANIFEST.rsplit(",", 1)[0])  # an empty run is a run too
    versions = [int(r.version) for r in manifests(spark, path).where(F.col("run_id") == run_id).select("version").distinct().collect()]
    listed.union(empty).withColumn("version", F.lit(max(versions, default=0) + 1)).coalesce(1).write.mode("append").parquet(f"{path.rstrip('/')}/manifest")


MANIFEST = "run_id string, folder string, file string, first_row string, n long, ordinal int, version int"


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """All manifests written below ``path`` (one row per file and version); none if there are none yet."""
    try:
        return spark.read.schema(MANIFEST).parquet(f"{path.rstrip('/')}/manifest")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], MANIFEST)


def current_files(spark: SparkSession, path: str) -> DataFrame:
    """The files of each run's newest manifest with ``before``, the number of rows ahead of each file:
    runs by name, files in their order. One row a file."""
    every = manifests(spark, path)
    newest = every.groupBy("run_id").agg(F.max("version").alias("version"))
    files = every.join(newest, ["run_id", "version"]).where("file is not null")
    ahead = Window.orderBy("run_id", "ordinal").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0)))


def read_results(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """O1: the committed rows (``columns``: their DDL) with ``run_id`` and ``line_no``, dense from 0 in the order
    of runs, files and positions in a file: each row's number is its position in its file plus the
    rows ahead of the file, so nothing is sorted. Only files of a newest manifest are read."""
    files = current_files(spark, path)
    folders = [r.folder for r in files.select("folder").distinct().collect()]  # one a run
    if not folders:
        return spark.createDataFrame([], f"{columns}, run_id string, line_no long")
    rows = spark.read.schema(columns).parquet(*folders)
    placed = rows.select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("__at"))
    out = placed.join(F.broadcast(files.select("file", "run_id", "before")), "file")
    return out.withColumn("line_no", F.col("before") + F.col("__at")).drop("file", "before", "__at")


def clean_results(spark: SparkSession, path: str) -> list[str]:
    """Remove the data folders that no newest manifest names (replaced and failed runs); not while a
    run is being written. Returns their names."""
    base = f"{path.rstrip('/')}/data"
    kept = {r.folder for r in current_files(spark, path).select("folder").distinct().collect()}
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(base)
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(jvm_path):
        return []
    names = {f.rsplit("/", 1)[-1] for f in kept}
    gone = [s.getPath() for s in fs.listStatus(jvm_path) if s.getPath().getName() not in names]
    for p in gone:
        fs.delete(p, True)
    return sorted(p.getName() for p in gone)


def result_projection(results: DataFrame, url_col: str, row_id: str = "row_id") -> DataFrame:
    """The URL column renamed to ``companyUrl`` (original, unnormalized text) and ``bucket``."""
    r = results.withColumnRenamed(url_col, "companyUrl") if url_col != "companyUrl" else results
    return r.select(row_id, "companyUrl", "bucket")


def assign_row_ids(df: DataFrame, col: str = "row_id") -> DataFrame:
    """Dense, stable ``row_id`` (0..n-1) in input order: file path, position of the split in its
    file, position in the split (Spark deals splits to partitions by size, not in file order).

    The rows are first saved with their split and ``monotonically_increasing_id`` (a reliable
    checkpoint, so a recomputation cannot renumber them); counts per split give each split's
    offset. Only the offsets -- one row per split -- are broadcast; no global sort, no
    single-task window over the rows. Without files behind ``df`` the partitions are the splits."""
    from navbuckets.session import materialize

    split = ["_file", "_start", "_pid"]
    d = materialize(df.withColumns({"_file": F.input_file_name(), "_start": F.input_file_block_start(),
                                    "_pid": F.spark_partition_id(), "_mid": F.monotonically_increasing_id()}))
    counts = d.groupBy(*split).agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    before = Window.orderBy(*split).rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select(*split, "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    out = d.join(F.broadcast(offs), split).withColumn(col, F.col("_off") + F.col("_mid") - F.col("_first"))
    return out.drop(*split, "_mid", "_off", "_first")
