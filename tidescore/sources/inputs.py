"""Sources: pictures, label files, request and metric streams, models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidescore.functions.scalars import MAX_BODY_BYTES


def image_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, content) of files by name pattern."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "length", "content")


def images(spark: SparkSession, path: str, drop_invalid: bool = False) -> DataFrame:
    """(origin, height, width, nChannels, mode, data) of JPEG and PNG files; sizes of -1 where a file is no picture."""
    return spark.read.format("image").option("dropInvalid", drop_invalid).load(path).select("image.*")


def label_rows(text: Column) -> Column:
    """(class_index, class_name) rows of a label file's whole text: a trimmed name a line, and no row after a last line end."""
    return F.posexplode(F.transform(F.split(F.regexp_replace(text, r"\r?\n$", ""), r"\r?\n"), lambda x: F.trim(x, F.lit(" \t\r\n")))).alias("class_index", "class_name")


def labels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(label_rows(F.col("value")))


def request_body(image: Column, file: Column, body: Column, multipart: Column) -> Column:
    """The picture of a request: a form's field `image`, else `file`, else the raw body; null if a form has neither."""
    return F.when(multipart, F.coalesce(image, file)).otherwise(body)


def body_error(body: Column, multipart: Column, most: int = MAX_BODY_BYTES) -> Column:
    size = F.octet_length(body)
    return F.when(body.isNull() & multipart, F.lit('multipart request without an "image" or "file" field')).when(size > most, F.lit("could not read image body: http: request body too large"))


def requests(spark: SparkSession, path: str, schema, max_files: int = 16) -> DataFrame:
    """A stream of request rows from Parquet files; max_files bounds a trigger's intake."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def ticks(spark: SparkSession, per_second: int) -> DataFrame:
    """A stream of (timestamp, value) at a fixed rate, for load and for sampling."""
    return spark.readStream.format("rate").option("rowsPerSecond", per_second).load()


def metric_samples(line: Column) -> Column:
    """(util_pct, mem_mib) of the first line of a sampler's output, null where it is malformed."""
    parts = F.split(F.trim(F.element_at(F.split(line, "\n"), 1)), ",")
    number = lambda i: F.when(F.trim(parts[i]).rlike(r"^[+-]?[0-9]+$"), F.trim(parts[i]).try_cast("int"))
    return F.when((F.size(parts) >= 2) & number(0).isNotNull() & number(1).isNotNull(), F.struct(number(0).alias("util_pct"), number(1).alias("mem_mib")))
