"""Readers for gauge files and descriptor tables, the dataset catalogue and result export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbflow.columns import KEY, TIME, VALUE

# Fixed value: the missing-value code of the gauge files.
MISSING = -0.999

OBSERVATIONS = T.StructType([T.StructField(KEY, T.StringType()), T.StructField(TIME, T.DateType()),
                             T.StructField(VALUE, T.DoubleType())])

STATIONS = T.StructType([
    T.StructField(KEY, T.StringType()), T.StructField("river", T.StringType()),
    T.StructField("site", T.StringType()), T.StructField("country", T.StringType()),
    T.StructField("catchment_km2", T.DoubleType()), T.StructField("site_altitude", T.DoubleType()),
    T.StructField("summer_start", T.StringType()), T.StructField("summer_end", T.StringType()),
    T.StructField("provider", T.StringType()), T.StructField("comment", T.StringType())])


def read_gauge_files(spark: SparkSession, folder: str, sep: str = ",",
                     pattern: str = r"^\d+[ab]?\..*") -> DataFrame:
    """All gauge files of a folder: ``series_id, river, site, country, time, value, ordinal``.

    A file ``12a. Ray, Grendon, UK, 2019.csv`` holds two columns, date and flow.  Id, river, site and
    country come from the name.  Dates may be ISO or ``dd-mm-yyyy``; the code -0.999 is missing.
    The input order is kept in ``ordinal`` for :func:`ebbflow.operators.clean.sanitize_ts`.
    """
    raw = (spark.read.schema("time_text string, value double").option("sep", sep)
           .option("header", False).option("mode", "PERMISSIVE").csv(folder)
           .select("*", F.col("_metadata.file_name").alias("_file")))
    raw = raw.withColumn("_file", F.url_decode("_file")).where(F.col("_file").rlike(pattern))
    parts = F.split(F.regexp_extract("_file", r"^[0-9]+[ab]?\. (.*)$", 1), "[,.]")
    text = F.trim("time_text")
    day = F.coalesce(F.try_to_date(text, "yyyy-MM-dd"), F.try_to_date(text, "dd-MM-yyyy"))
    return raw.select(
        F.regexp_extract("_file", r"^([0-9]+[ab]?)\. ", 1).alias(KEY),
        *[F.trim(F.get(parts, F.lit(i))).alias(n) for i, n in enumerate(("river", "site", "country"))],
        day.alias(TIME),
        F.when(F.abs(F.col("value") - F.lit(MISSING)) > 1e-9, F.col("value")).alias(VALUE),
        F.monotonically_increasing_id().alias("ordinal"))


def read_descriptors(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """Descriptor table whose rows carry a leading row number that the header does not name.

    Read by header, every column would shift by one; the names are therefore taken from the first
    line and a row-number column is put in front.
    """
    header = spark.read.text(path).limit(1).collect()[0][0]
    names = ["_row", *[n.strip().strip('"') for n in header.split(sep)]]
    fields = [T.StructField("_row", T.StringType())] + [
        T.StructField(n, T.DoubleType()) for n in names[1:]]
    rows = (spark.read.schema(T.StructType(fields)).option("sep", sep).option("header", False)
            .option("mode", "PERMISSIVE").csv(path))
    # the header line is the only one whose first field is not a number
    return rows.withColumn("_row", F.col("_row").try_cast("int")).where(F.col("_row").isNotNull())


def read_tsv(spark: SparkSession, path: str, schema: str, **columns: str) -> DataFrame:
    """Tab separated file with a header; picks and renames columns: ``benchmark="Qsim"``."""
    df = spark.read.schema(schema).option("sep", "\t").option("header", True).csv(path)
    return df.select(*[F.col(source).alias(name) for name, source in columns.items()])


def read_areas(spark: SparkSession, path: str) -> DataFrame:
    """Catchment areas: ``area_id, gauge, area_km2, q95, specific_q95`` from a Parquet table of area attributes.

    Target areas have no flow columns; theirs are NULL.
    """
    names = {"EZGID": "area_id", "HZBNR": "gauge", "AREASQKM": "area_km2", "Q95": "q95", "Q95S": "specific_q95"}
    table = spark.read.parquet(path)

    def column(source: str, target: str):
        value = F.col(source) if source in table.columns else F.lit(None)
        return (value.cast("long").cast("string") if target in ("area_id", "gauge") else value.cast("double")).alias(target)

    return table.select(*[column(source, target) for source, target in names.items()])


def read_points(spark: SparkSession, path: str, area: str = "EZGID", x: str = "x", y: str = "y") -> DataFrame:
    """Discretisation points of areas, ``area_id, x, y``, for :func:`ebbflow.operators.regional.discretise`."""
    return spark.read.parquet(path).select(F.col(area).cast("long").cast("string").alias("area_id"), F.col(x).cast("double").alias("x"),
                                           F.col(y).cast("double").alias("y")).dropna()


def write_observations(df: DataFrame, name: str, buckets: int = 512, key: str = KEY, time: str = TIME
                       ) -> None:
    """Store a daily table bucketed by series and sorted by day.

    Every operator partitions by series and sorts by day, so reading this table saves its shuffle.
    """
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key, time).saveAsTable(name)


def dataset(spark: SparkSession, name: str) -> DataFrame:
    """A catalogued data set by name."""
    return spark.table(name)


def export_table(df: DataFrame, name: str, folder: str) -> DataFrame:
    """Write a named result table and pass it on unchanged."""
    df.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{name}")
    return df
