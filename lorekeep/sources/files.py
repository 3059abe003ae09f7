"""File discovery, filters and text decoding."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions.text import suffix

# Fixed values.
EXCLUDED_DIRS = ("_Archives",)
DEFAULT_EXTENSIONS = (
    ".pdf", ".docx", ".txt", ".md", ".sql", ".xlsx", ".csv", ".ini", ".conf",
)
TEXTUAL_EXTENSIONS = (
    ".docx", ".doc", ".pdf", ".txt", ".md", ".sql", ".ini", ".conf",
    ".csv", ".xlsx", ".html", ".htm", ".asc", ".tst", ".url", ".msg",
)


def read_files(spark: SparkSession, *paths: str) -> DataFrame:
    """``path, content, length`` of every file below the given folders.

    Uses Spark's binary source, which distributes the reading and, as all file
    sources of Spark, leaves out names that start with ``_`` or ``.``.
    """
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(list(paths))
        .select(clean_path(F.col("path")).alias("path"), "content", "length")
    )


def stream_files(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    return (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", max_files)
        .load(path)
        .select(clean_path(F.col("path")).alias("path"), "content", "length")
    )


def clean_path(path: Column) -> Column:
    """One spelling per file: ``file:/a`` and ``file:///a`` become ``/a``."""
    return F.regexp_replace(path, "^file:/+", "/")


def not_excluded(path: Column, directories: Iterable[str] = EXCLUDED_DIRS) -> Column:
    parts = F.split(path, r"[/\\]")
    return ~F.arrays_overlap(parts, F.array(*[F.lit(d) for d in directories]))


def has_extension(path: Column, extensions: Iterable[str] = DEFAULT_EXTENSIONS) -> Column:
    """The file's suffix is compared in lower case; the wanted ones as given."""
    wanted = [e if e.startswith(".") else f".{e}" for e in extensions]
    return F.lower(suffix(path)).isin(wanted)


def is_textual(path: Column) -> Column:
    return has_extension(path, TEXTUAL_EXTENSIONS)


def is_below(path: Column, directory: str) -> Column:
    base = directory.rstrip("/")
    return F.startswith(path, F.lit(base + "/")) | (path == base)


def decode_text(content: Column) -> Column:
    """UTF-8, else Windows-1252, else UTF-8 with replacement characters.

    Windows-1252 leaves five bytes undefined, and a text that holds one of them
    falls through to the last step. Spark's ``decode`` knows ISO-8859-1, which
    differs from Windows-1252 in the bytes 80-9F only; those are translated.
    """
    valid = F.is_valid_utf8(content.cast("string"))
    latin = F.decode(content, "ISO-8859-1")
    defined, undefined = {}, []
    for byte in range(0x80, 0xA0):
        try:
            defined[chr(byte)] = bytes([byte]).decode("cp1252")
        except UnicodeDecodeError:
            undefined.append(chr(byte))
    western = F.translate(latin, "".join(defined), "".join(defined.values()))
    readable = F.length(F.translate(latin, "".join(undefined), "")) == F.length(latin)
    return (
        F.when(valid, content.cast("string"))
        .when(readable, western)
        .otherwise(F.make_valid_utf8(content.cast("string")))
    )


def read_jsonl(spark: SparkSession, path: str, schema) -> DataFrame:
    """JSON lines with a fixed schema; blank lines are skipped."""
    return spark.read.schema(schema).json(path)
