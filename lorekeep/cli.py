"""Command line: ``python -m lorekeep.cli [--root R] <command> ...``."""

from __future__ import annotations

import argparse
import json
import sys
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.backends import HashingEmbedder, HttpChat, HttpDescriber, HttpEmbedder
from lorekeep.functions import text as X
from lorekeep.operators.upkeep import corpus_status, remaining
from lorekeep.plans import backfill, evaluate, migrate
from lorekeep.plans.ask import answer_frames, as_queries, benchmark_prompts, first_row, web_prompts
from lorekeep.plans.ingest import ingest_directory, ingest_files, rechunk
from lorekeep.plans.search import MODES, search
from lorekeep.schemas import BENCH_RUNS, QUESTIONS, TABLES
from lorekeep.session import KnowledgeBase, Settings, build_session
from lorekeep.sources.files import read_files, read_jsonl
from lorekeep.sources.listing import read_all_files

SYSTEM_PROMPT = (
    "You look things up in a company's documents. Every statement of yours names the document it is "
    "taken from; what they leave open, you leave open and point out."
)
ANALYSIS_PROMPT = (
    "For a search index: one French sentence or two on what the text is about (summary), and the terms under "
    'which somebody would look for it (keywords). Return {"summary": string, "keywords": [string, ...]} and nothing else.'
)


def backends(settings: Settings, vision: bool = False) -> dict:
    """HTTP models where they are configured, offline defaults elsewhere."""
    url = settings.base_url
    if not url:
        return {"embedder": HashingEmbedder(settings.embed_dim)}
    chat_url = url.rstrip("/").removesuffix("/v1") + "/v1"
    found = {"embedder": HttpEmbedder(url.rstrip("/").removesuffix("/v1"), settings.embed_model)}
    if settings.chat_model:
        found["analyzer"] = HttpChat(
            chat_url, settings.chat_model, ANALYSIS_PROMPT, temperature=0.2, json_answer=True
        )
    if settings.vision_model and settings.vision_on(vision):
        found["describer"] = HttpDescriber(
            HttpChat(chat_url, settings.vision_model, timeout=settings.vision_timeout)
        )
    return found


def show_hits(hits: DataFrame) -> list[str]:
    """Hits as text lines: name, citation, score, source and a snippet."""
    columns = hits.columns
    section = F.col("section") if "section" in columns else F.lit(None).cast("string")
    page = F.col("page_number") if "page_number" in columns else F.lit(None).cast("int")
    body = F.coalesce(*[F.col(c) for c in ("text", "raw_text") if c in columns])
    cited = X.citation(section, page)
    lines = hits.orderBy("query_id", "rank").select(
        F.format_string(
            "%d. %s%s (score %.4f, %s)\n   %s",
            F.col("rank") + 1,
            F.col("file_name"),
            F.when(cited != "", F.concat(F.lit(" - "), cited)).otherwise(""),
            F.col("score"),
            F.col("source"),
            X.snippet(body, 300),
        )
    )
    return [r[0] for r in lines.collect()]


def cmd_init(kb, args, found):
    kb.initialize()


def cmd_ingest(kb, args, found):
    files = read_files(kb.spark, args.file_path)
    outcome = ingest_files(
        kb, files, args.category, with_chunks=not args.no_chunks, force=args.force, **found
    )
    print(*[json.dumps(r.asDict()) for r in outcome.collect()], sep="\n")


def cmd_batch(kb, args, found):
    outcome = ingest_directory(
        kb, args.directory, args.extensions, category=args.category, **found
    )
    counts = outcome.groupBy("status").agg(F.count(F.lit(1)).alias("files"), F.sum("n_chunks").alias("chunks"))
    print(*[json.dumps(r.asDict()) for r in counts.collect()], sep="\n")


def cmd_search(kb, args, found):
    embedder = found["embedder"] if args.mode != "fts" else None
    queries = as_queries(kb.spark, args.query, embedder, kb.settings.embed_dim)
    lines = show_hits(search(backfill.corpus_of(kb), queries, args.limit, args.mode))
    print("\n".join(lines) if lines else "No results found.")


def cmd_embed(kb, args, found):
    tables = ["chunks"] if args.chunks_only else ["document_content", "chunks"]
    for table in tables:
        counts = backfill.embed_pending(
            kb, found["embedder"], table, args.rebuild, args.filter, args.limit
        )
        print(table, json.dumps(counts))


def cmd_compact(kb, args, found):
    kb.compact()
    print(kb.vacuum(), "folders deleted")


def cmd_reindex(kb, args, found):
    backfill.build_indexes(kb)


def cmd_rechunk(kb, args, found):
    """From the stored texts or, with ``--files``, from the files of a folder (documents without a file: from their text)."""
    files = read_all_files(kb.spark, kb.qualified(args.files), f"{kb.root}/_staging") if args.files else None
    rechunk(kb, files, embedder=found["embedder"])


VISION_SLICE = 1000


def cmd_reindex_vision(kb, args, found):
    """Re-ingest stored files with vision, in slices; finished files are remembered by path.

    The list of finished files is a table next to the others: content hashes
    change with the files, paths do not. Each slice is committed and remembered,
    so an interrupted run goes on where it stopped.
    """
    done_folder = f"{kb.root}/_vision_done"
    spark, schema = kb.spark, "path string"
    if args.reset:
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(done_folder)
    known = kb._fs.exists(kb._path(done_folder))
    done = spark.read.schema(schema).parquet(done_folder) if known else spark.createDataFrame([], schema)
    rows = kb.documents.withColumn("path", F.col("file_path"))
    if args.filter:
        rows = rows.where(F.expr(args.filter))
    todo = remaining(rows, done, "path").select("path")
    last, left = "", args.limit
    while left is None or left > 0:
        size = VISION_SLICE if left is None else min(VISION_SLICE, left)
        batch = todo.where(F.col("path") > last).orderBy("path").limit(size)
        paths = [r["path"] for r in batch.collect()]
        if not paths:
            break
        files = read_files(spark, *paths)
        outcome = ingest_files(kb, files, args.category, force=True, **found)
        finished = outcome.where(F.col("status").isin("ok", "updated")).select("path")
        finished.write.mode("append").parquet(done_folder)
        last, left = paths[-1], None if left is None else left - len(paths)


def cmd_status(kb, args, found):
    row = corpus_status(kb.documents, kb.chunks, kb.metadata, args.total).first()
    print(json.dumps(row.asDict()))


def cmd_ask(kb, args, found):
    queries = as_queries(kb.spark, args.question, found["embedder"], kb.settings.embed_dim)
    row = first_row(web_prompts(backfill.corpus_of(kb), queries, matching=args.passages == "match"))
    deltas = [row["prompt"]]
    if kb.settings.base_url and kb.settings.chat_model:
        chat = HttpChat(kb.settings.base_url, kb.settings.chat_model, SYSTEM_PROMPT)
        deltas = (chat(p) for p in [row["prompt"]])
    for frame in answer_frames(row["sources"], deltas):
        print(frame, end="")


def cmd_bench(kb, args, found):
    spark = kb.spark
    questions = read_jsonl(spark, args.questions, QUESTIONS).orderBy("id")
    if args.limit:
        questions = questions.limit(args.limit)
    rows = questions.collect()  # a question set typed by people
    queries = as_queries(spark, [r["question"] for r in rows], found["embedder"], kb.settings.embed_dim)
    prompts = benchmark_prompts(backfill.corpus_of(kb), queries, args.level, args.passages == "match")
    url = (kb.settings.base_url or "").rstrip("/").removesuffix("/v1") + "/v1"
    models = {m: HttpChat(url, m) for m in args.models}
    runs = evaluate.run_models(prompts, models, kb.qualified(args.answers) if args.answers else None)
    runs.write.mode("overwrite").json(args.out)
    written = spark.read.schema(BENCH_RUNS).json(args.out)
    lines = evaluate.markdown_rows(written, 150 if args.level == "chunk" else 180, args.level == "chunk")
    print(*[r["line"] for r in lines.orderBy("id", "model").collect()], sep="\n")


def cmd_report(kb, args, found):
    spark = kb.spark
    names = args.models
    schema = "id long, " + ", ".join(f"`{m}` struct<F:int,P:int,C:int,H:int>" for m in names)
    points = evaluate.unpivot_scores(read_jsonl(spark, args.scores, schema), names)
    runs = read_jsonl(spark, args.runs, BENCH_RUNS)
    short = F.lit(names[-1])
    for name in reversed(names[:-1]):
        short = F.when(F.col("model").contains(name), name).otherwise(short)
    report = evaluate.score_report(points, runs.withColumn("model", short))
    print(*[json.dumps(r.asDict()) for r in report.orderBy("model").collect()], sep="\n")


def cmd_compare(kb, args, found):
    """Files keep their line order as the position of a run."""
    def arm(path):
        return read_jsonl(kb.spark, path, BENCH_RUNS).withColumn("position", F.monotonically_increasing_id())

    compared = evaluate.compare_arms(arm(args.baseline), arm(args.chunks))
    print(json.dumps(evaluate.comparison_summary(compared).first().asDict()))
    for row in evaluate.differing_sources(compared).orderBy("id").collect():
        print(json.dumps(row.asDict()))


def cmd_migrate(kb, args, found):
    """Legacy tables are plain parquet folders below ``--source``."""
    spark = kb.spark
    tables = {
        n: spark.read.parquet(f"{args.source}/{n}")
        for n in TABLES
        if kb._fs.exists(kb._path(f"{args.source}/{n}"))
    }
    if not tables:
        print(f"nothing found below {args.source}", file=sys.stderr)
        return 1
    plan = migrate.migration_plan(spark, tables)
    print(*[json.dumps(r.asDict()) for r in plan.orderBy("step").collect()], sep="\n")
    if args.apply:
        if kb.version:
            stamp = datetime.now(timezone.utc).strftime("%Y%m%d-%H%M%S")
            hadoop = spark._jvm.org.apache.hadoop.fs.FileUtil
            target = kb._path(f"{kb.root}.backup-{stamp}")
            hadoop.copy(kb._fs, kb._path(kb.root), kb._fs, target, False, spark._jsc.hadoopConfiguration())
        kb.commit(migrate.migrated_tables(spark, tables), replaces=[e["batch"] for e in kb._log()])
    return 2 if migrate.is_blocked(plan) else 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lorekeep", description=__doc__)
    top.add_argument("--root", default="knowledge", help="folder of the tables")
    top.add_argument("--embed-dim", type=int, default=1024)
    commands = top.add_subparsers(dest="command", required=True)

    def add(name, run, *options):
        sub = commands.add_parser(name)
        sub.set_defaults(run=run)
        for flags, settings in options:
            sub.add_argument(*flags, **settings)

    def opt(*flags, **settings):
        return flags, settings

    number = {"type": int, "default": None}
    add("init", cmd_init)
    add(
        "ingest", cmd_ingest, opt("file_path"), opt("--category", default="Uncategorized"),
        opt("--no-chunks", action="store_true"), opt("--force", action="store_true"),
        opt("--vision", action="store_true"),
    )
    add(
        "batch-ingest", cmd_batch, opt("directory"), opt("--category", default="Uncategorized"),
        opt("--extensions", nargs="+", default=None),
    )
    add(
        "search", cmd_search, opt("query"), opt("--limit", type=int, default=3),
        opt("--mode", choices=MODES, default="hybrid"),
    )
    add(
        "embed", cmd_embed, opt("--filter", default=None), opt("--limit", **number),
        opt("--rebuild", action="store_true"), opt("--chunks-only", action="store_true"),
    )
    add("compact", cmd_compact)
    add("reindex", cmd_reindex)
    add("rechunk", cmd_rechunk, opt("--files", default=None))
    add(
        "reindex-vision", cmd_reindex_vision, opt("--filter", default=None), opt("--limit", **number),
        opt("--category", default="Uncategorized"), opt("--reset", action="store_true"),
    )
    add("status", cmd_status, opt("--total", type=int, default=299))
    passages = opt("--passages", choices=["head", "match"], default="head")
    add("ask", cmd_ask, opt("question"), passages)
    add(
        "bench", cmd_bench, opt("questions"), opt("out"), opt("--models", nargs="+", required=True),
        opt("--limit", **number), opt("--level", choices=["document", "chunk"], default="document"),
        opt("--answers", default=None), passages,
    )
    add("report", cmd_report, opt("scores"), opt("runs"), opt("--models", nargs="+", required=True))
    add("compare", cmd_compare, opt("baseline"), opt("chunks"))
    add("migrate", cmd_migrate, opt("--source", required=True), opt("--apply", action="store_true"))
    return top


def main(argv: list[str] | None = None, spark=None) -> int:
    args = parser().parse_args(argv)
    base = Settings.from_env()
    settings = Settings(**{**base.__dict__, "embed_dim": args.embed_dim})
    kb = KnowledgeBase(spark or build_session(), args.root, settings)
    vision = getattr(args, "vision", False) or args.command == "reindex-vision"
    return args.run(kb, args, backends(settings, vision)) or 0


if __name__ == "__main__":
    sys.exit(main())
