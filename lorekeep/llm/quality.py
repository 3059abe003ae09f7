"""Quality rules: fixed rules, then robust outliers per language and source.

Method: of texts that pass the fixed rules, four statistics are transformed to roughly even spread. For each (language, source)
the minimum-covariance-determinant estimate of their centre and scatter is found by concentration steps: the half of the rows
with the smallest Mahalanobis distances gives the next centre and scatter. Three starts are followed side by side (medians with fixed
scales, medians with the group's own scales, mean and covariance of all rows) until no determinant falls any more; the
smallest one wins. A text is rejected if its squared distance is above the chi-square cutoff.

The scatter is the regularized one: a share of ``SHRINK / (n + SHRINK)``, which vanishes as the half's ``n`` rows grow, comes from
the diagonal of the group's own scales, so that few rows do not pretend a correlation. Floors act where the half is degenerate only:
no direction has less variance than a single event makes (a symbol, a repeated line, a repeated run of words, chance in the length of
words; per statistic, in the group's shorter texts). In the winner, a statistic whose variance in the half is below the
group's spread between quartiles is stretched to it; correlations stay as estimated.

Steps are aggregates over all rows of a narrow table (partial sums and quantile sketches), so a group may hold
any share of the rows. Estimates are one row per group and never pass through the driver.

Defined results: a null text counts as one without words, which fails the rules; null language and source
form groups of their own; a group of a single text keeps it. Repeated rows are judged each. Extra columns are
carried along by ``keep_good`` and ignored otherwise.
"""

from __future__ import annotations

from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorekeep.llm.common import over_batches, spread_bits, stored
from lorekeep.operators.common import broadcast_if_small

MIN_WORDS = 50
SYMBOLS = "#*$%&|<>"
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Share of a group's rows that the estimate rests on.
HALF = 0.5
#: Rows that the diagonal target weighs as much as, and by how much the logarithm of a determinant falls in a step that counts.
SHRINK, FALL = 16, 1e-6
STARTS = 3
#: Chi-square quantile at 0.9999 with four degrees of freedom.
CUTOFF = 23.513
#: Makes the scatter of the half with the smallest distances consistent: 0.5 / P(chi2 with 6 degrees <= median of chi2 with 4).
CONSISTENCY = 0.5 / 0.23760
#: Scales of the transformed statistics in the first distances of the first start.
FLOORS = (0.25, 0.2, 0.2, 0.1)
#: Words that a repeated run takes up at both of its places, and the standard deviation of words' lengths as a share of their mean.
REPEATED, WORD_SPREAD = 6, 0.5
_D = len(FLOORS)
_PAIRS = list(combinations_with_replacement(range(_D), 2))


def text_statistics(text: str | None) -> tuple[int, int, int, int, int]:
    """The counts of ``STATISTICS``. Words are runs without ASCII white space."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode().split()
    n = len(words)
    if not n:
        return 0, 0, 0, 0, 0
    blank = sum(map(text.count, " \t\n\x0b\x0c\r"))
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    repeated = 0
    if n >= 3:
        h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
        windows = spread_bits(spread_bits(spread_bits(h[:-2]) + h[1:-1]) + h[2:])
        order = np.sort(windows)
        twice = order[1:][order[1:] == order[:-1]]
        if len(twice):
            often = np.isin(windows, twice)
            inside = np.zeros(n, bool)
            for k in range(3):
                inside[k : n - 2 + k] |= often
            repeated = int(inside.sum())
    return n, len(text) - blank, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated


def with_statistics(df: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """All columns of ``df`` and the counts, named ``prefix`` + name."""
    names = [prefix + s for s in STATISTICS]

    def make():
        def work(batch):
            at = batch.schema.get_field_index(text)
            rows = [text_statistics(t) for t in batch.column(at).to_pylist()]
            counts = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
            return pa.RecordBatch.from_arrays([*batch.columns, *counts], [*batch.schema.names, *names])

        return work

    schema = T.StructType([*df.schema.fields, *(T.StructField(name, T.LongType()) for name in names)])
    return df.mapInArrow(over_batches(make), schema)


def base_failed(prefix: str = "") -> Column:
    n, r = F.col(prefix + "n_words"), F.col(prefix + "n_repeat_words")
    return (n < MIN_WORDS) | (100 * r > 50 * n)


def transformed(prefix: str = "") -> list[Column]:
    """Symbols, repeated lines and repeated words per word, and the length of words, on scales of even spread."""
    n = F.greatest(F.col(prefix + "n_words"), F.lit(1)).cast("double")
    return [
        F.log1p(10 * F.col(prefix + "n_symbols") / n),
        F.log1p(10 * F.col(prefix + "n_dup_lines") / n),
        F.col(prefix + "n_repeat_words") / n,
        F.log(F.greatest(F.col(prefix + "word_chars"), F.lit(1)) / n),
    ]


def _distance(x: list[str], fit: Column) -> Column:
    total = F.lit(0.0)
    for k, (i, j) in enumerate(_PAIRS):
        di, dj = F.col(x[i]) - fit["centre"][i], F.col(x[j]) - fit["centre"][j]
        total = total + fit["precision"][k] * di * dj * (1 if i == j else 2)
    return F.round(total, 6)


def _packed(matrix: np.ndarray) -> list[float]:
    return [float(matrix[i, j]) for i, j in _PAIRS]


def _square(packed) -> np.ndarray:
    out = np.zeros((_D, _D))
    for k, (i, j) in enumerate(_PAIRS):
        out[i, j] = out[j, i] = packed[k]
    return out


def _fit(n, s, q, factor: float, events: np.ndarray, spread: np.ndarray) -> dict:
    """From sums over chosen rows to centre, regularized scatter, its inverse and the logarithm of its determinant, in units of events."""
    mean = np.array(s, float) / n
    scatter = _square(q) / n - np.outer(mean, mean)
    share = SHRINK / (n + SHRINK)
    unit = np.outer(events, events)
    values, axes = np.linalg.eigh((share * np.diag(spread**2) + (1 - share) * factor * scatter) / unit)
    values = np.maximum(values, 1.0)
    return {
        "centre": mean.tolist(),
        "scatter": _packed((axes * values) @ axes.T * unit),
        "precision": _packed((axes / values) @ axes.T / unit),
        "size": float(np.log(values).sum()),
    }


def _diagonal(centre, scales) -> dict:
    squares = np.square(np.array(scales, float))
    return {"centre": [float(c) for c in centre], "scatter": _packed(np.diag(squares)), "precision": _packed(np.diag(1 / squares)), "size": float("inf")}


_FIT = "struct<centre: array<double>, scatter: array<double>, precision: array<double>, size: double>"
_STATE = f"g string, events array<double>, spread array<double>, falls boolean, fits array<{_FIT}>"


def _begin(frames):
    for frame in frames:
        out = []
        for row in frame.itertuples():
            low, middle, high = (np.array([q[k] for q in row.quartiles], float) for k in range(3))
            words = max(row.words, 1)
            events = np.array([np.log1p(10 / words), np.log1p(10 / words), REPEATED / words, WORD_SPREAD / np.sqrt(words)])
            # The quartiles of normal data are 0.6745 standard deviations away from the median.
            spread = np.maximum(events, np.maximum(high - middle, middle - low) / 0.6745)
            whole = _fit(row.n, row.s, row.q, 1.0, events, spread) | {"size": float("inf")}
            out.append((row.g, events.tolist(), spread.tolist(), True, [_diagonal(middle, FLOORS), _diagonal(middle, spread), whole]))
        yield pd.DataFrame(out, columns=["g", "events", "spread", "falls", "fits"])


def _step(frames):
    """A start takes the new estimate if its determinant is smaller; else it has arrived."""
    for frame in frames:
        out = []
        for row in frame.itertuples():
            events, spread, fits, falls = np.array(row.events), np.array(row.spread), [], False
            for old, n, s, q in zip(row.fits, row.n, row.s, row.q, strict=True):
                new = _fit(n, s, q, CONSISTENCY, events, spread)
                smaller = new["size"] < old["size"] - FALL
                fits.append(new if smaller else old)
                falls |= smaller
            out.append((row.g, row.events, row.spread, falls, fits))
        yield pd.DataFrame(out, columns=["g", "events", "spread", "falls", "fits"])


def _finish(frames):
    for frame in frames:
        out = []
        for row in frame.itertuples():
            best = min(row.fits, key=lambda fit: fit["size"])
            scatter = _square(best["scatter"])
            stretch = np.maximum(np.array(row.spread) / np.sqrt(np.diag(scatter)), 1.0)
            inverse = np.linalg.inv(scatter * np.outer(stretch, stretch))
            out.append((row.g, list(best["centre"]), _packed(inverse)))
        yield pd.DataFrame(out, columns=["g", "centre", "precision"])


def _sums(x: list[str], chosen: Column | None = None) -> list[Column]:
    """Count, sums and sums of products of the chosen rows."""
    picked = [F.col(c) if chosen is None else F.when(chosen, F.col(c)) for c in x]
    n = F.count(F.lit(1)) if chosen is None else F.count_if(chosen)
    return [n, F.array(*(F.sum(c) for c in picked)), F.array(*(F.sum(picked[i] * F.col(x[j])) for i, j in _PAIRS))]


def _start(rows: DataFrame, x: list[str]) -> DataFrame:
    quarters = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    n, s, q = _sums(x)
    found = rows.groupBy("g").agg(
        F.array(*(F.percentile_approx(c, quarters, F.lit(1000)) for c in x)).alias("quartiles"),
        F.percentile_approx("n_words", F.lit(0.25), F.lit(1000)).alias("words"),
        n.alias("n"), s.alias("s"), q.alias("q"),
    )
    return found.mapInPandas(_begin, _STATE)


def estimates(rows: DataFrame) -> DataFrame:
    """Centre and inverse scatter per group ``g`` of the columns ``x0`` and so on; ``n_words`` bounds what one event makes."""
    x = [f"x{i}" for i in range(_D)]
    found = stored(_start(rows, x), "quality")
    while True:
        # Ends, as every round lowers a determinant that floors bound from below.
        falling = found.where("falls")
        if falling.isEmpty():
            break
        side, small = broadcast_if_small(falling.select("g", "fits"))
        far = rows.join(side, "g").select("g", *x, *(_distance(x, F.col("fits")[k]).alias(f"d{k}") for k in range(STARTS)))
        bounds = far.groupBy("g").agg(*(F.percentile_approx(f"d{k}", F.lit(HALF), F.lit(1000)).alias(f"b{k}") for k in range(STARTS)))
        near = far.join(F.broadcast(bounds) if small else bounds, "g")
        each = [_sums(x, F.col(f"d{k}") <= F.col(f"b{k}")) for k in range(STARTS)]
        sums = near.groupBy("g").agg(*(F.array(*(one[i] for one in each)).alias(name) for i, name in enumerate(("n", "s", "q"))))
        moved = falling.join(F.broadcast(sums) if small else sums, "g").mapInPandas(_step, _STATE)
        found = stored(moved.unionByName(found.where("NOT falls")), "quality")
    return stored(found.mapInPandas(_finish, "g string, centre array<double>, precision array<double>"), "quality")


def _group(language: str, source: str) -> Column:
    return F.to_json(F.struct(F.col(language).cast("string").alias("l"), F.col(source).cast("string").alias("s")))


def _judged(counted: DataFrame, language: str, source: str, prefix: str) -> DataFrame:
    """``counted`` (a written table) with ``prefix + failed`` and ``prefix + kept``."""
    values = [c.alias(f"x{i}") for i, c in enumerate(transformed(prefix))]
    passed = counted.where(~base_failed(prefix)).select(_group(language, source).alias("g"), *values, F.col(prefix + "n_words").alias("n_words"))
    side, _ = broadcast_if_small(estimates(passed).select("g", F.struct("centre", "precision").alias(prefix + "e")).withColumnRenamed("g", prefix + "g"))
    x = [f"{prefix}x{i}" for i in range(_D)]
    keyed = counted.withColumns({prefix + "g": _group(language, source)} | dict(zip(x, transformed(prefix), strict=True)))
    joined = keyed.join(side, prefix + "g", "left")
    near = _distance(x, F.col(prefix + "e")) <= CUTOFF
    failed = base_failed(prefix)
    return joined.withColumns({prefix + "failed": failed, prefix + "kept": ~failed & F.coalesce(near, F.lit(False))})


def judge(df: DataFrame, key: str = "doc_id", text: str = "text", language: str = "lang", source: str = "source") -> DataFrame:
    """``key``, the counts, ``base_failed`` and ``kept``."""
    narrow = df.select(F.col(key).alias("key"), F.col(language).alias("l"), F.col(source).alias("s"), F.col(text).alias("t"))
    counted = stored(with_statistics(narrow, "t").drop("t"), "quality")
    return _judged(counted, "l", "s", "").select(F.col("key").alias(key), *STATISTICS, F.col("failed").alias("base_failed"), "kept")


def keep_good(df: DataFrame, text: str = "text", language: str = "lang", source: str = "source") -> DataFrame:
    """The rows of ``df`` that pass, with their columns. Texts are counted once, where they are written."""
    prefix = "_quality_"
    counted = stored(with_statistics(df, text, prefix), "quality")
    judged = _judged(counted, language, source, prefix)
    return judged.where(F.col(prefix + "kept")).select(*(f"`{c}`" for c in df.columns))
