"""Upload sources (SRC-1, SRC-2, STR-1): binary files as rows."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions.text import stable_id
from folioflow.schemas import BINARY_FILE

# Content types by file ending.
TYPES = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "webp": "image/webp", "tif": "image/tiff", "tiff": "image/tiff", "pdf": "application/pdf"}


def as_uploads(files: DataFrame) -> DataFrame:
    """binaryFile rows to uploads(upload_id, filename, content_type, content). The id is stable under retries."""
    name = F.element_at(F.split("path", "/"), -1)
    kinds = F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv])
    return files.select(
        stable_id(F.col("path"), F.unix_micros("modificationTime")).alias("upload_id"), name.alias("filename"),
        F.try_element_at(kinds, F.lower(F.element_at(F.split(name, r"\."), -1))).alias("content_type"), "content",
    )


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    return as_uploads(spark.read.format("binaryFile").load(path))


def stream_uploads(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """The queue: a durable folder. The rate is bounded by files in a micro-batch."""
    reader = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("maxFilesPerTrigger", files_per_batch)
    return as_uploads(reader.load(path))
