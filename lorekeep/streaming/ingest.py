"""Incremental ingestion as a streaming query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lorekeep.operators.common import materialize
from lorekeep.plans.ingest import ingest_files
from lorekeep.session import KnowledgeBase
from lorekeep.sources.files import DEFAULT_EXTENSIONS, has_extension, not_excluded, stream_files
from lorekeep.sources.listing import SETTLED, stream_list, with_contents


def stream_ingest(
    kb: KnowledgeBase, files: DataFrame, checkpoint: str, available_now: bool = True, **options
) -> StreamingQuery:
    """Ingest a stream of ``path, content`` rows, one commit per micro-batch.

    Deduplication state lives in the tables, so a micro-batch that is replayed
    after a failure finds its contents stored and changes nothing.
    """

    return _each_batch(files, lambda batch: ingest_files(kb, batch, **options), checkpoint, available_now)


def _each_batch(rows: DataFrame, work: Callable[[DataFrame], object], checkpoint: str, available_now: bool) -> StreamingQuery:
    def run(batch: DataFrame, _: int) -> None:
        work(batch)

    writer = rows.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def watch_directory(
    kb: KnowledgeBase,
    directory: str,
    checkpoint: str,
    extensions: tuple[str, ...] = DEFAULT_EXTENSIONS,
    max_files: int = 1000,
    **options,
) -> StreamingQuery:
    files = stream_files(kb.spark, directory, max_files)
    wanted = not_excluded(F.col("path")) & has_extension(F.col("path"), extensions)
    return stream_ingest(kb, files.where(wanted), checkpoint, **options)


def watch_all_files(
    kb: KnowledgeBase,
    directory: str,
    checkpoint: str,
    extensions: tuple[str, ...] = DEFAULT_EXTENSIONS,
    settled: float = SETTLED,
    available_now: bool = True,
    **options,
) -> StreamingQuery:
    """As ``watch_directory``, with files that Spark's source leaves out: empty ones and names with ``_`` or ``.`` first."""

    def work(batch: DataFrame) -> None:
        ingest_files(kb, with_contents(materialize(batch, f"{kb.root}/_staging")).drop("length"), **options)

    wanted = not_excluded(F.col("path")) & has_extension(F.col("path"), extensions)
    return _each_batch(stream_list(kb.spark, directory, settled).where(wanted), work, checkpoint, available_now)
