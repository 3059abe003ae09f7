"""Benchmark runs, score reports and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.backends import Chat, chat_column
from lorekeep.functions.text import basename, strip_thinking, table_cell
from lorekeep.operators.common import materialize

CRITERIA = ("F", "P", "C", "H")
POINTS_PER_CRITERION = 2


ANSWER_ROWS = "model string, prompt_id string, raw string, elapsed_s double, tokens long, failed boolean, asked_at timestamp"
#: Prompts whose answers become permanent together.
WAVE = 1000


def ask_missing(prompts: DataFrame, name: str, chat: Chat, answers: str, wave: int = WAVE) -> int:
    """Ask a model those ``prompts`` (column ``prompt``) that have no answer of it in the folder ``answers``; how many were asked.

    Equal prompts are asked once. Answers are appended in waves of about ``wave`` prompts, so a run that is stopped keeps
    all finished waves. A failure is recorded and asked again by the next run; NULL prompts are asked as empty ones.
    """
    spark = prompts.sparkSession
    spark.createDataFrame([], ANSWER_ROWS).write.mode("append").parquet(answers)  # so that the folder exists
    known = spark.read.schema(ANSWER_ROWS).parquet(answers).where((F.col("model") == name) & ~F.col("failed")).select("prompt_id")
    wanted = prompts.select(F.coalesce("prompt", F.lit("")).alias("prompt")).distinct()
    missing = materialize(wanted.withColumn("prompt_id", F.sha2("prompt", 256)).join(known, "prompt_id", "left_anti"))
    n = missing.count()
    waves = -(-n // wave)
    tasks = max(1, min(spark.sparkContext.defaultParallelism, wave, n))
    for k in range(waves):
        part = missing.where(F.pmod(F.xxhash64("prompt_id"), F.lit(waves)) == k).repartition(tasks, "prompt_id")
        told = part.withColumn("_answer", chat_column(chat)(F.col("prompt")))
        told = told.select(F.lit(name).alias("model"), "prompt_id", "_answer.*", F.current_timestamp().alias("asked_at"))
        told.write.mode("append").parquet(answers)
    return n


def best_answers(spark: SparkSession, answers: str) -> DataFrame:
    """One answer per model and prompt: the latest that did not fail, else the latest failure."""
    rows = spark.read.schema(ANSWER_ROWS).parquet(answers)
    value = F.struct("raw", "elapsed_s", "tokens", "failed")
    order = F.struct((~F.col("failed")).alias("good"), "asked_at", "raw")
    return rows.groupBy("model", "prompt_id").agg(F.max_by(value, order).alias("_answer"))


def run_models(prompts: DataFrame, models: dict[str, Chat], answers: str | None = None, wave: int = WAVE) -> DataFrame:
    """Ask every model every prompt: rows in the shape of a benchmark run.

    ``prompts`` holds ``query_id, query, prompt, sources`` and optionally
    ``theme`` and ``expected_doc_hint``. With ``answers``, a folder that all
    executors share, answers are kept by prompt hash, and only what is missing is asked.
    """
    kept = None
    if answers is not None:
        prompts = materialize(prompts)
        for name, chat in models.items():
            ask_missing(prompts, name, chat, answers, wave)
        kept = best_answers(prompts.sparkSession, answers)
    arms = []
    for name, chat in models.items():
        if kept is None:
            asked = prompts.withColumn("_answer", chat_column(chat)(F.col("prompt")))
        else:
            own = kept.where(F.col("model") == name).select("prompt_id", "_answer")
            asked = prompts.withColumn("prompt_id", F.sha2(F.coalesce("prompt", F.lit("")), 256)).join(own, "prompt_id", "left")
        optional = [
            (F.col(c) if c in prompts.columns else F.lit("")).alias(c)
            for c in ("theme", "expected_doc_hint")
        ]
        arms.append(
            asked.select(
                F.col("query_id").alias("id"), F.col("query").alias("question"), *optional,
                F.col("sources").alias("context_sources"), F.lit(name).alias("model"),
                F.col("_answer.raw").alias("answer_raw"),
                strip_thinking(F.col("_answer.raw")).alias("answer"),
                F.col("_answer.elapsed_s").alias("elapsed_s"),
                F.col("_answer.tokens").alias("tokens"),
            )
        )
    runs = arms[0]
    for arm in arms[1:]:
        runs = runs.unionByName(arm)
    return runs


def markdown_rows(runs: DataFrame, width: int = 180, with_sources: bool = False) -> DataFrame:
    """``id, model, line``: one Markdown table row per run."""
    cells = ["id", "theme", basename(F.col("model")), "elapsed_s"]
    if with_sources:
        first = F.transform(
            F.slice("context_sources", 1, 2), lambda s: F.substring(basename(s), 1, 25)
        )
        cells.append(F.array_join(first, ", "))
    cells.append(table_cell(F.col("answer"), width))
    columns = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in cells]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *columns), F.lit(" |"))
    return runs.select("id", "model", line.alias("line"))


def unpivot_scores(scores: DataFrame, models: list[str]) -> DataFrame:
    """One row per question, model and criterion: ``id, model, criterion, points``."""
    entries = F.array(
        *[
            F.struct(
                F.lit(m).alias("model"),
                F.lit(c).alias("criterion"),
                F.col(f"{m}.{c}").cast("long").alias("points"),
            )
            for m in models
            for c in CRITERIA
        ]
    )
    return scores.select("id", F.inline(entries))


def score_report(points: DataFrame, runs: DataFrame) -> DataFrame:
    """Per model: points per criterion, total, maximum, score out of ten, latency.

    ``points`` is long (id, model, criterion, points), ``runs`` has id, model
    and elapsed_s. Both are summed per model before they meet.
    """
    totals = points.groupBy("model").agg(
        *[
            F.sum(F.when(F.col("criterion") == c, F.col("points"))).alias(f"points_{c}")
            for c in CRITERIA
        ],
        F.sum("points").alias("total"),
        (F.count(F.lit(1)) * POINTS_PER_CRITERION).alias("maximum"),
    )
    scored = runs.join(points.select("id", "model").distinct(), ["id", "model"], "left_semi")
    latency = scored.groupBy("model").agg(F.avg("elapsed_s").alias("mean_latency"))
    return totals.join(latency, "model", "left").withColumn(
        "score10", F.col("total") / F.col("maximum") * 10
    )


def first_per_key(rows: DataFrame, key: str, order: Column | str, last: bool = False) -> DataFrame:
    """First (or last) record of every key as a partial aggregation, not a sort."""
    order = F.col(order) if isinstance(order, str) else order
    whole = F.struct(*[F.col(c) for c in rows.columns])
    pick = (F.max_by if last else F.min_by)(whole, order)
    return rows.groupBy(key).agg(pick.alias("_r")).select("_r.*")


def compare_arms(baseline: DataFrame, chunks: DataFrame, order: str = "position") -> DataFrame:
    """Per question: sources and latency of both arms (first baseline, last chunk run)."""
    left = first_per_key(baseline, "id", order).select(
        "id",
        F.col("context_sources").alias("base_sources"),
        F.col("elapsed_s").alias("base_latency"),
    )
    right = first_per_key(chunks, "id", order, last=True).select(
        "id",
        F.col("context_sources").alias("chunk_sources"),
        F.col("elapsed_s").alias("chunk_latency"),
    )
    return right.join(left, "id", "left").withColumn(
        "same_sources",
        F.coalesce(
            (F.col("base_sources") == F.col("chunk_sources")) & (F.size("base_sources") > 0),
            F.lit(False),
        ),
    )


def comparison_summary(compared: DataFrame) -> DataFrame:
    means = compared.agg(
        F.count(F.lit(1)).alias("questions"),
        F.count_if("same_sources").alias("same_sources"),
        F.avg("base_latency").alias("base_mean"),
        F.avg("chunk_latency").alias("chunk_mean"),
    )
    return means.withColumn(
        "delta_percent", (F.col("chunk_mean") - F.col("base_mean")) / F.col("base_mean") * 100
    )


def differing_sources(compared: DataFrame) -> DataFrame:
    return compared.where(~F.col("base_sources").eqNullSafe(F.col("chunk_sources")))
