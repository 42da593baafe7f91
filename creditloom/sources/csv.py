"""CSV ingest and export.

The dialect is the usual one: fields in double quotes where needed, a quote
inside doubled, white space kept.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditloom.sources import versions
from creditloom.sources.schemas import CSV_FILES, SCHEMAS
from creditloom.sources.tables import DATA, load_tables

# Folders looked for, in this order.
PREFERRED = ("sample", "raw")


# The dialect, the same for reading and writing.
DIALECT = {"header": True, "quote": '"', "escape": '"'}


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether Spark can see ``path`` on whatever file system it names."""
    named = spark._jvm.org.apache.hadoop.fs.Path(path)
    return named.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(named)


def resolve_source(
    spark: SparkSession, data_dir: str, use_sample: bool | None = None, prefer: Sequence[str] = PREFERRED
) -> str:
    """The folder to ingest: the asked one, else the first that holds applications."""
    root = data_dir.rstrip("/")
    if use_sample is not None:
        return f"{root}/{prefer[0] if use_sample else prefer[1]}"
    for name in prefer:
        if path_exists(spark, f"{root}/{name}/{CSV_FILES['applications']}"):
            return f"{root}/{name}"
    raise FileNotFoundError(f"No data found in {' or '.join(f'{root}/{p}/' for p in prefer)}")


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType, encoding: str = "UTF-8", multi_line: bool = False
) -> DataFrame:
    """A CSV with header; documented columns get their documented type.

    Columns are matched by header name. Undocumented ones are kept and typed by
    a distributed pass over the whole file, which runs only if there are any.
    A value that does not fit its type fails the read. ``multi_line`` allows line
    breaks inside quotes; then a file is read by one task, so split such data
    into many files.
    """
    reader = spark.read.options(**DIALECT, encoding=encoding, multiLine=multi_line)
    names = reader.csv(path).columns
    known = {f.name: f for f in schema.fields}
    extra = [n for n in names if n not in known]
    inferred = {}
    if extra:
        inferred = {f.name: f for f in reader.option("inferSchema", True).csv(path).schema.fields}
    full = T.StructType([known.get(n) or inferred[n] for n in names])
    reader = spark.read.options(**DIALECT, encoding=encoding, multiLine=multi_line)
    return reader.options(mode="FAILFAST", enforceSchema=False).schema(full).csv(path)


def ingest_csv(
    spark: SparkSession,
    src_dir: str,
    out_dir: str,
    tables: Mapping[str, str] = CSV_FILES,
    overwrite: bool = False,
    multi_line: bool = False,
) -> dict[str, DataFrame]:
    """Load the CSV files ``tables`` of ``src_dir`` into Parquet tables under ``out_dir``.

    A table that is published there is left as it is unless ``overwrite``. A new
    version is written aside and published when it is complete, together with its
    row count, which is taken while it is written. So readers, also those of an
    overwritten table, always find a whole one.
    """
    out = out_dir.rstrip("/")
    for name, file in tables.items():
        if overwrite or versions.current(spark, f"{out}/{name}") is None:
            df = read_csv(spark, f"{src_dir.rstrip('/')}/{file}", SCHEMAS[name], multi_line=multi_line)

            def write(path: str, df: DataFrame = df) -> dict:
                seen = Observation()
                df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(f"{path}/{DATA}")
                return {"rows": seen.get["rows"]}

            versions.publish(spark, f"{out}/{name}", write)
    return load_tables(spark, out, tables)


def export_csv(df: DataFrame, path: str, encoding: str = "UTF-8") -> None:
    """Write with a header, in as many files as the frame has partitions."""
    writer = df.write.mode("overwrite").options(**DIALECT, encoding=encoding)
    writer.options(ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
