"""A lexical index that follows a table commit by commit.

Every refresh tokenises the rows of new batches only and writes them as one immutable segment: postings in runs (``runs``), the texts
of the runs, bounds per block and document frequencies. Statistics of the whole are sums over segments. Rows that are gone are
known by id and batch; what they contributed is kept beside the segments, per version of the table, and subtracted when a query is
asked. As soon as ``FAN_OUT`` segments are of similar size they are merged from their postings, without what is gone, so that a
table of n rows has O(log n) segments and a posting is rewritten O(log n) times.

Blocks are ``BLOCK_TEXTS`` texts of a run, of similar length, the same for all terms of a segment. The largest term frequency and
the least length in a block bound the weight of a term there, whatever the statistics are later.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions.tokens import Tokenizer
from lorekeep.operators.common import broadcast_if_small, has_at_most
from lorekeep.operators.lexical import LexicalIndex, Packed, term_table
from lorekeep.operators.runs import blocks_of, packed, small_batches, texts_in, texts_with_terms

FAN_OUT = 8
BLOCK_TEXTS = 128
# Places of texts that are gone; so many narrow rows are broadcast.
GONE_ROWS = 1_000_000
_PARTS = ("texts", "postings", "blocks", "frequencies")
# Segments of another layout are not read; their batches are indexed anew, and ``sweep`` deletes them.
LAYOUT = "runs"


@dataclass(frozen=True)
class Segment:
    number: int
    batches: tuple[int, ...]
    texts: int

    @property
    def tier(self) -> int:
        return int(math.log(max(self.texts, 1), FAN_OUT))


class SegmentStore:
    """Segments of one text column below ``path``; ``ids`` name a text, the first of them alone."""

    def __init__(self, spark: SparkSession, path: str, ids: list[str], tokenizer: Tokenizer) -> None:
        self.spark, self.path, self.ids, self.tokenizer = spark, path.rstrip("/"), ids, tokenizer
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # ------------------------------------------------------------------ log

    def _names(self) -> list[str]:
        folder = self._path(f"{self.path}/_log")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(folder)) if self._fs.exists(folder) else []

    def segments(self) -> list[Segment]:
        """The live segments; those that a later one replaces, or whose batches another has already, are left out."""
        entries = []
        for name in self._names():
            if name.isdigit():
                stream = self._fs.open(self._path(f"{self.path}/_log/{name}"))
                text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
                stream.close()
                entry = json.loads(text)
                if entry.get("layout") == LAYOUT:
                    entries.append(entry)
        replaced = {n for e in entries for n in e["replaces"]}
        live, covered = [], set()
        for e in entries:
            if e["number"] not in replaced and not covered & set(e["batches"]):
                covered |= set(e["batches"])
                live.append(Segment(e["number"], tuple(e["batches"]), e["texts"]))
        return live

    def exists(self) -> bool:
        return any(n.isdigit() for n in self._names())

    def _reserve(self) -> int:
        number = max((int(n.split(".")[0]) for n in self._names()), default=0) + 1
        self._fs.create(self._path(f"{self.path}/_log/{number:08d}.lock"), False).close()  # fails if another writer was faster
        return number

    def _publish(self, number: int, batches: list[int], texts: int, replaces: list[int]) -> None:
        entry = {"number": number, "batches": sorted(batches), "texts": texts, "replaces": replaces, "layout": LAYOUT}
        # Renamed into place, so a reader never sees half an entry.
        draft = self._path(f"{self.path}/_drafts/{uuid.uuid4().hex}")
        stream = self._fs.create(draft, False)
        stream.write(bytearray(json.dumps(entry).encode()))
        stream.close()
        self._fs.rename(draft, self._path(f"{self.path}/_log/{number:08d}"))

    def _folder(self, number: int, part: str) -> str:
        return f"{self.path}/{part}/segment={number}"

    def _read(self, segments: list[Segment], part: str) -> DataFrame:
        reader = self.spark.read.option("basePath", f"{self.path}/{part}")
        return reader.parquet(*[self._folder(s.number, part) for s in segments]).withColumn("segment", F.col("segment").cast("long"))

    # -------------------------------------------------------------- writing

    def _write(self, terms: DataFrame, batches: list[int], replaces: list[int]) -> Segment:
        """``terms``: ids, batch, doc_len, terms."""
        number = self._reserve()

        def write(part: str, rows: DataFrame) -> DataFrame:
            with small_batches(self.spark):
                rows.write.mode("overwrite").option("compression", "zstd").parquet(self._folder(number, part))
            return self.spark.read.schema(rows.schema).parquet(self._folder(number, part))

        # Tokenised and written once, by the same tasks; the other parts are read off the packed postings without an exchange.
        rows = write("postings", packed(terms, self.ids, BLOCK_TEXTS))
        texts = write("texts", texts_in(rows))
        write("blocks", blocks_of(rows))
        write("frequencies", rows.where("term <> ''").groupBy("term").agg(F.sum(F.size("at")).alias("df")))
        segment = Segment(number, tuple(batches), texts.count())
        self._publish(number, batches, segment.texts, replaces)
        return segment

    def refresh(self, rows: DataFrame, text: str, batches: set[int], version: str) -> None:
        """Follow the table to ``version``: ``rows`` holds ids, text and batch of all current rows, whose batches are ``batches``.

        Only rows of batches without a segment are tokenised.
        """
        segments = self.segments()
        new = sorted(batches - {b for s in segments for b in s.batches})
        if new or not segments:
            fresh = rows.where(F.col("batch").isin(new))
            segments.append(self._write(term_table(fresh, [*self.ids, "batch"], text, self.tokenizer), new, []))
        self._merge(segments, rows)
        self._write_gone(rows, version)

    def _merge(self, segments: list[Segment], rows: DataFrame) -> None:
        """Merge segments of one tier as soon as there are ``FAN_OUT`` of them."""
        tiers: dict[int, list[Segment]] = {}
        for s in segments:
            tiers.setdefault(s.tier, []).append(s)
        for group in tiers.values():
            if len(group) >= FAN_OUT:
                key = self.ids[0]
                n = self._read(group, "frequencies").agg(F.sum("df")).first()[0] or 0
                terms = texts_with_terms(self._read(group, "postings"), n, self.ids)
                live = rows.select(key, "batch")
                kept = terms.join(live, [key, "batch"], "left_semi").select(*self.ids, "batch", "doc_len", "terms")
                self._write(kept, [b for s in group for b in s.batches], [s.number for s in group])
                return

    def _places(self, gone: DataFrame) -> DataFrame:
        """``segment, run, at`` of the texts that are gone; an id or a batch that is NULL equals none."""
        return gone.where(F.col(self.ids[0]).isNotNull() & F.col("batch").isNotNull()).select("segment", "run", "at")

    def _words_of(self, gone: DataFrame, segments: list[Segment]) -> DataFrame:
        """``term, df``: how many of the texts that are gone hold each term, once or more often in the result."""
        places = self._places(gone)
        of = {r["segment"] for r in places.select("segment").distinct().collect()}
        if not of:
            return self.spark.createDataFrame([], "term string, df long")
        posted = self._read([s for s in segments if s.number in of], "postings").where("term <> ''").select("segment", "run", "term", "at")
        if has_at_most(places, GONE_ROWS):
            each = posted.select("segment", "run", "term", F.explode("at").alias("at"))
            return each.join(F.broadcast(places), ["segment", "run", "at"], "left_semi").select("term", F.lit(1).cast("long").alias("df"))
        by_run = places.groupBy("segment", "run").agg(F.collect_list("at").alias("gone"))  # at most the texts of a run
        held = F.size(F.array_intersect("at", "gone")).cast("long")
        return posted.join(by_run, ["segment", "run"]).select("term", held.alias("df")).where("df > 0")

    def _gone_folder(self, version: str) -> str:
        return f"{self.path}/gone_places/version={version}"

    def _write_gone(self, rows: DataFrame, version: str) -> None:
        """Ids and batches of indexed texts that are no longer current, and how often each of their terms counts."""
        key, segments = self.ids[0], self.segments()
        known = self._read(segments, "texts")
        gone = known.select(key, "batch", "segment", "doc_len", "run", "at").join(rows.select(key, "batch"), [key, "batch"], "left_anti")
        folder = self._gone_folder(version)
        gone.write.mode("overwrite").parquet(f"{folder}/texts")
        words = self._words_of(self.spark.read.parquet(f"{folder}/texts"), segments)
        words.groupBy("term").agg(F.sum("df").alias("df")).write.mode("overwrite").parquet(f"{folder}/frequencies")
        covers = self.spark.createDataFrame([(s.number,) for s in segments], "segment long")
        covers.write.mode("overwrite").parquet(f"{folder}/segments")  # last: with it the version is complete

    # -------------------------------------------------------------- reading

    def is_at(self, version: str) -> bool:
        return self._fs.exists(self._path(f"{self._gone_folder(version)}/segments/_SUCCESS"))

    def index(self, version: str) -> LexicalIndex:
        """The index as of a version to which it was refreshed."""
        folder, key = self._gone_folder(version), self.ids[0]
        numbers = [r["segment"] for r in self.spark.read.parquet(f"{folder}/segments").collect()]  # O(log n) rows
        live = [Segment(n, (), 0) for n in sorted(numbers)]
        gone = self.spark.read.parquet(f"{folder}/texts")
        taken = self.spark.read.parquet(f"{folder}/frequencies")
        texts = self._read(live, "texts").select("doc_len")
        both = texts.select("doc_len", F.lit(1).alias("n")).unionByName(gone.select("doc_len", F.lit(-1).alias("n")))
        stats = both.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_docs"), F.coalesce(F.sum(F.col("n") * F.col("doc_len")) / F.nullif(F.sum("n"), F.lit(0)), F.lit(0.0)).alias("avg_len"))
        counted = self._read(live, "frequencies").select("term", "df").unionByName(taken.select("term", (-F.col("df")).alias("df")))
        frequencies = counted.groupBy("term").agg(F.sum("df").alias("df")).where(F.col("df") > 0)

        rows, known, by_run = self._read(live, "postings"), self._read(live, "texts"), None
        if not gone.isEmpty():
            known = known.join(broadcast_if_small(gone.select(key, "batch"))[0], [key, "batch"], "left_anti")
            by_run = self._places(gone).groupBy("segment", "run").agg(F.collect_list("at").alias("gone"))
        each = rows.where("term <> ''").select("segment", "run", "term", F.explode(F.arrays_zip("at", "tf")).alias("_p")).select("segment", "run", "term", "_p.*")
        posted = each.join(known, ["segment", "run", "at"]).drop("run", "at")
        return LexicalIndex(posted, frequencies, stats, tuple(self.ids), self.tokenizer, blocks=self._read(live, "blocks"), packed=Packed(rows, known, by_run))

    def sweep(self, version: str) -> int:
        """Delete parts of segments and versions that nothing reads any more; how many folders."""
        live = {self._folder(s.number, part) for s in self.segments() for part in _PARTS} | {self._gone_folder(version)}
        deleted = 0
        for part in (*_PARTS, "gone", "gone_places", "_staging/lorekeep"):
            folder = self._path(f"{self.path}/{part}")
            for status in self._fs.listStatus(folder) if self._fs.exists(folder) else ():
                name = f"{self.path}/{part}/{status.getPath().getName()}"
                if name not in live:
                    deleted += bool(self._fs.delete(self._path(name), True))
        return deleted
