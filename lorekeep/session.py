"""The knowledge base: four parquet tables with all-or-nothing commits."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import tempfile
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorekeep.functions.tokens import Tokenizer
from lorekeep.schemas import DOCUMENT_KEY, PRIMARY_KEY, TABLES


def _flag(value: str) -> bool:
    return value.lower() in ("1", "true", "yes")


@dataclass(frozen=True)
class Settings:
    """Everything that can be configured; `from_env` reads the usual variables."""

    embed_dim: int = 1024
    embed_model: str = "bge-m3:latest"
    base_url: str | None = None
    chat_model: str | None = None
    vision_model: str | None = None
    vision_enabled: bool = False
    vision_timeout: int = 300
    vision_dpi: int = 200
    tokenizer: Tokenizer = field(default_factory=Tokenizer)

    @staticmethod
    def from_env(env: dict | None = None) -> Settings:
        env = os.environ if env is None else env
        return Settings(
            embed_model=env.get("KB_EMBED_MODEL", "bge-m3:latest"),
            base_url=env.get("OLLAMA_BASE_URL"),
            chat_model=env.get("OLLAMA_MODEL"),
            vision_model=env.get("KB_VISION_MODEL"),
            vision_enabled=_flag(env.get("KB_VISION_ENABLED", "0")),
            vision_timeout=int(env.get("KB_VISION_TIMEOUT", "300")),
            vision_dpi=int(env.get("KB_VISION_DPI", "200")),
        )

    def vision_on(self, override: bool | None = None) -> bool:
        """An override can turn vision on, never off."""
        return bool(override) or self.vision_enabled


def build_session(app: str = "lorekeep", master: str | None = None, **conf) -> SparkSession:
    """A session with the options that all plans assume."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    options = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.parquet.pushdown.inFilterThreshold": "1000",
        **conf,
    }
    for name, value in options.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable on every executor, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    home = Path(__file__).resolve().parent
    base = Path(tempfile.mkdtemp(prefix="lorekeep-package-")) / "lorekeep"
    context.addPyFile(shutil.make_archive(str(base), "zip", home.parent, home.name))
    _shipped.add(context.applicationId)


class KnowledgeBase:
    """Tables below ``root``.

    A commit writes the rows of all tables into folders of its own number and
    becomes visible with one marker file, which is created last and only if it
    does not exist yet. A failed job therefore leaves nothing that is read, and
    its folders are overwritten by the next attempt. Ingesting costs what the
    new rows cost: existing files are never rewritten. Replaced or deleted rows
    are listed by key and left out on reading until :meth:`compact` drops them.
    """

    def __init__(self, spark: SparkSession, root: str, settings: Settings | None = None) -> None:
        ship_package(spark)
        self.spark = spark
        self.root = root.rstrip("/")
        self.settings = settings or Settings()
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self._fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self._path = spark._jvm.org.apache.hadoop.fs.Path

    def qualified(self, path: str) -> str:
        """Absolute spelling of a path, the one that scans report."""
        found = self._path(path)
        scheme = found.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return scheme.makeQualified(found).toString()

    # ------------------------------------------------------------- commits

    def _log(self) -> list[dict]:
        folder = self._path(f"{self.root}/_commits")
        if not self._fs.exists(folder):
            return []
        names = sorted(
            n for n in (s.getPath().getName() for s in self._fs.listStatus(folder)) if n.isdigit()
        )
        entries = []
        for name in names:
            stream = self._fs.open(self._path(f"{self.root}/_commits/{name}"))
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            stream.close()
            try:
                entry = json.loads(text)
            except ValueError:  # the writer died, or is still, between creating and filling it
                continue
            entries.append(entry)
        replaced = {n for e in entries for n in e.get("replaces", ())}
        return [e for e in entries if e["batch"] not in replaced]

    @property
    def version(self) -> str:
        """Names the set of live batches: any commit, whatever its number, makes another version."""
        return self.version_of(self._log())

    @staticmethod
    def version_of(log: list[dict]) -> str:
        live = [e["batch"] for e in log]
        digest = hashlib.sha256(json.dumps(live).encode()).hexdigest()[:12]
        return f"{max(live)}-{digest}" if live else ""

    def _reserve(self) -> int:
        """A batch number of one's own: two writers never share a folder."""
        folder = self._path(f"{self.root}/_commits")
        taken = []
        if self._fs.exists(folder):
            names = (s.getPath().getName() for s in self._fs.listStatus(folder))
            taken = [int(n.removesuffix(".lock")) for n in names]
        batch = max(taken, default=0) + 1
        # Fails, and leaves everything as it is, if another writer is faster.
        self._fs.create(self._path(f"{self.root}/_commits/{batch:08d}.lock"), False).close()
        return batch

    def commit(
        self,
        upserts: dict[str, DataFrame] | None = None,
        removed: dict[str, DataFrame] | None = None,
        inserts: dict[str, DataFrame] | None = None,
        replaces: list[int] | None = None,
        born: set[int] | None = None,
    ) -> int:
        """Publish rows and removals of any number of tables at once.

        ``upserts`` replace rows of the same primary key, ``inserts`` are known
        to have none, ``removed`` holds one column of primary keys per table.
        ``replaces`` names batches whose rows these are, each with its own
        batch number in ``batch``, one of ``born``. Only those batches stop to
        be read, so that a batch which another writer commits meanwhile is
        kept, and its removals apply to the rows that are older than it. The tables are written side
        by side, so that a short one does not wait for a long one.
        """
        batch = self._reserve()
        upserts, removed, inserts = upserts or {}, removed or {}, inserts or {}

        def write_rows(table: str, rows: DataFrame) -> None:
            schema = TABLES[table]
            columns = [
                (F.col(f.name) if f.name in rows.columns else F.lit(None))
                .cast(f.dataType)
                .alias(f.name)
                for f in schema
            ]
            if replaces:
                columns.append(F.col("batch").cast("int").alias("born"))
            key = PRIMARY_KEY[table]
            (
                rows.select(*columns)
                .sortWithinPartitions(key)
                .write.mode("overwrite")
                .option(f"parquet.bloom.filter.enabled#{key}", "true")
                .option("compression", "zstd")
                .parquet(self._dir(table, batch))
            )

        def write_keys(table: str) -> None:
            keys = []
            if table in upserts:
                written = self.spark.read.schema(TABLES[table]).parquet(self._dir(table, batch))
                keys.append(written.select(F.col(PRIMARY_KEY[table]).alias("key")))
            if table in removed:
                keys.append(removed[table].toDF("key"))
            reduce(DataFrame.unionByName, keys).select(F.col("key").cast("string")).write.mode(
                "overwrite"
            ).parquet(self._dir(table, batch, "_gone"))

        rows = {**upserts, **inserts}
        gone = [] if replaces is not None else [t for t in TABLES if t in upserts or t in removed]
        with ThreadPoolExecutor(len(TABLES)) as pool:
            list(pool.map(lambda item: write_rows(*item), rows.items()))
            list(pool.map(write_keys, gone))
        told = {"batch": batch, "rows": list(rows), "gone": gone}
        if replaces:
            told |= {"replaces": replaces, "born": sorted(born or ())}
        entry = json.dumps(told)
        marker = self._path(f"{self.root}/_commits/{batch:08d}")
        stream = self._fs.create(marker, False)
        stream.write(bytearray(entry.encode()))
        stream.close()
        return batch

    def _dir(self, table: str, batch: int, kind: str = "") -> str:
        return f"{self.root}/{table}{kind}/batch={batch}"

    # ------------------------------------------------------------- reading

    def table(self, name: str, log: list[dict] | None = None, with_batch: bool = False) -> DataFrame:
        """The current rows of a table, or those of a log read before; with the batch that brought each row, if wanted."""
        log = self._log() if log is None else log
        schema = TABLES[name]
        live = [self._dir(name, e["batch"]) for e in log if name in e["rows"]]
        if not live:
            empty = T.StructType([*schema, *([T.StructField("batch", T.IntegerType())] if with_batch else [])])
            return self.spark.createDataFrame([], empty)
        # Rows that a compaction rewrote carry the number of the batch that brought them.
        numbers = [T.StructField(n, T.IntegerType()) for n in ("born", "batch")]
        stored = T.StructType([*schema, *numbers])
        rows = (
            self.spark.read.schema(stored).option("basePath", f"{self.root}/{name}").parquet(*live)
        )
        gone = [self._dir(name, e["batch"], "_gone") for e in log if name in e["gone"]]
        if any("born" in e for e in log):
            rows = rows.withColumn("batch", F.coalesce("born", "batch"))
        rows = rows.drop("born")
        if gone:
            keys = (
                self.spark.read.schema("key string, batch int")
                .option("basePath", f"{self.root}/{name}_gone")
                .parquet(*gone)
                .groupBy("key")
                .agg(F.max("batch").alias("gone_at"))
            )
            rows = rows.join(
                keys,
                (rows[PRIMARY_KEY[name]] == keys["key"]) & (rows["batch"] < keys["gone_at"]),
                "left_anti",
            )
        return rows if with_batch else rows.drop("batch")

    def rows_of(self, batch: int, name: str) -> DataFrame:
        """The rows of a table that a commit wrote, whatever became of them since."""
        return self.spark.read.schema(TABLES[name]).parquet(self._dir(name, batch))

    def batches_of(self, name: str, log: list[dict] | None = None) -> set[int]:
        """Numbers of the batches that brought rows of a table, compacted or not."""
        log = self._log() if log is None else log
        return {b for e in log if name in e["rows"] for b in e.get("born", [e["batch"]])}

    @property
    def documents(self) -> DataFrame:
        return self.table("documents")

    @property
    def content(self) -> DataFrame:
        return self.table("document_content")

    @property
    def metadata(self) -> DataFrame:
        return self.table("document_ai_metadata")

    @property
    def chunks(self) -> DataFrame:
        return self.table("chunks")

    # --------------------------------------------------------- maintenance

    def initialize(self) -> None:
        """Create the tables; does nothing if they are there already."""
        if not self._log():
            self.commit(replaces=[])

    def keys_of_documents(self, ids: DataFrame) -> dict[str, DataFrame]:
        """Primary keys, per table, of everything that belongs to the documents ``id``."""
        wanted = ids.select("id").distinct()
        found = {}
        for table, column in DOCUMENT_KEY.items():
            if table == "chunks":
                rows = self.table(table).select("id", "document_id")
                found[table] = rows.join(
                    wanted.withColumnRenamed("id", "document_id"), "document_id", "left_semi"
                ).select("id")
            else:
                found[table] = wanted.withColumnRenamed("id", column)
        return found

    def purge(self, ids: DataFrame) -> int:
        """Delete documents with everything that hangs on them."""
        return self.commit(removed=self.keys_of_documents(ids))

    def vacuum(self) -> int:
        """Delete folders that no version reads any more; how many.

        Only to be called while no job reads or writes: old batches, unfinished
        batches and intermediate results go; ``plans.backfill.sweep_indexes`` does
        the same for indexes.
        """
        live = {
            self._dir(table, e["batch"], kind)
            for e in self._log()
            for part, kind in (("rows", ""), ("gone", "_gone"))
            for table in e[part]
        }
        groups = [f"{t}{kind}" for t in TABLES for kind in ("", "_gone")] + ["_staging/lorekeep"]
        deleted = 0
        for group in groups:
            folder = self._path(f"{self.root}/{group}")
            if not self._fs.exists(folder):
                continue
            for status in self._fs.listStatus(folder):
                name = f"{self.root}/{group}/{status.getPath().getName()}"
                if name not in live:
                    deleted += bool(self._fs.delete(self._path(name), True))
        return deleted

    def compact(self) -> int:
        """Rewrite the current rows once, without what was replaced or deleted."""
        log = self._log()
        rows = {n: self.table(n, log, with_batch=True) for n in TABLES}
        born = {b for n in TABLES for b in self.batches_of(n, log)}
        return self.commit(upserts=rows, replaces=[e["batch"] for e in log], born=born)
