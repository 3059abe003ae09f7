"""Phrase collocations by direct-address tiling.

Words get ids by falling frequency. A text becomes a row of ids, and pairs of neighbouring ids are counted by address: pairs of the most
frequent ids lie in dense tiles of 256 x 256 cells, counted with ``bincount``; all others are sorted coordinates with counts. Every task
sends each tile's counts as packed arrays; the tile's reader adds them up and keeps the frequent cells. Frequent pairs are ranked by
frequency in turn and paired with the word that follows them, which counts phrases of three words, and so on: a phrase can be frequent only if
both its parts of one word less are.

Only words and phrases that occur often enough get ids, and at most ``Limits.head_words`` and ``Limits.head_phrases`` of them, so that
what is broadcast is bounded. Workers hold it in packed arrays. Batches are bounded in bytes, rows of ids in length, and there are more
tiles for more words, so that what a task holds does not grow with the table. Where there are more, phrases with a part beyond the bound are counted by their text: slower, and exact as well.

A phrase of ``k`` words in ``a`` places scores ``floor(10^6 a^2 / (l r))`` at a cut into parts found ``l`` and ``r`` times; its
lowest score counts (ties: the first cut). Phrases that lie in a longer candidate which has at least half their occurrences are dropped.
Scores are divided in decimals, so products may pass 64 bits.

Words are split at spaces and tabs within pieces; pieces end at line breaks (and vertical tabs, form feeds) and ``. , ; : ! ?``. Only A-Z is lowered. Null texts are
empty, null languages are ``und``. Repeated rows count as often as they are there. An empty table has no phrases. Long texts are worked on whole,
one at a time. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.llm.common import give_back, record_batch, slices, small_batches, spread_bits, steps, stored

MIN_COUNT = 10
MAX_WORDS = 3
COVERED_PERCENT = 50
TOP = 2000
UNDEFINED = "und"
#: Bytes of an Arrow batch that a worker gets, ids of a row of an encoded text, and ids that are looked up at a time.
BATCH_BYTES = 8 << 20
ROW_IDS = 4096
LOOKUP_IDS = 1 << 18
#: Dense tiles have so many rows and columns.
SIDE = 256


@dataclass(frozen=True)
class Limits:
    """What is broadcast and what a task holds; results do not depend on it.

    Frequent words, and frequent phrases of one length, that get ids; ids below ``dense`` (a multiple of ``SIDE``) are counted in dense
    tiles; pairs that a task gathers before it counts them, and cells that the reader of a sparse tile merges at a time; words, or
    phrases by their text, that a task counts before it passes them on; words of all texts for which there is one more sparse tile.
    """

    head_words: int = 1 << 19
    head_phrases: int = 1 << 21
    dense: int = 2048
    pairs: int = 3_000_000
    words: int = 200_000
    per_tile: int = 2_000_000


BREAK, BEYOND = -1, -2  # ids of the end of a piece or an infrequent word, and of a word without id
_END = b"\n"
#: Lower-case ASCII, one byte for all ends of pieces, one for white space.
_PLAIN = bytes(0x0A if chr(b) in ".,;:!?\n\x0b\x0c\r" else 0x20 if b == 0x09 else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))

_WORDS = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64())])
_ENCODED = pa.schema([("lang", pa.string()), ("ids", pa.binary()), ("beyond", pa.list_(pa.string()))])
_TILES = pa.schema([("tile", pa.int32()), ("cells", pa.binary()), ("counts", pa.binary())])
_FOUND = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("a", pa.int64()), ("left", pa.int64()), ("right", pa.int32()), ("l", pa.list_(pa.int64())), ("r", pa.list_(pa.int64()))])
_FOUND_SQL = "lang string, phrase string, a long, left long, right int, l array<long>, r array<long>"


def words_of(texts: list[str]) -> list[bytes]:
    """Words of consecutive texts, with an end mark after each piece."""
    plain = b"\n".join(t.encode() for t in texts).translate(_PLAIN).replace(_END, b" \n ")
    return [w for w in plain.split(b" ") if w]


def _tidy(run):
    """A task that gives its memory back when it ends."""

    def tidy(batches):
        yield from run(batches)
        give_back()

    return tidy


def _by_lang(batch):
    """Texts of a batch in slices of one language."""
    groups: dict[str, list] = {}
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        groups.setdefault(lang, []).append(text)
    for lang, texts in groups.items():
        for part in slices(texts):
            yield lang, [texts[i] for i in part]


def _count_words(limits: Limits):
    def run(batches):
        held: dict[str, Counter] = {}

        def rows():
            for lang, words in held.items():
                words.pop(_END, None)
                texts = pa.array(list(words), pa.binary()).cast(pa.string())
                yield from steps([record_batch(_WORDS, [pa.array([lang] * len(words), pa.string()), texts, list(words.values())])], 20_000)
            held.clear()

        for batch in steps(batches):
            for lang, texts in _by_lang(batch):
                held.setdefault(lang, Counter()).update(words_of(texts))
            if sum(map(len, held.values())) >= limits.words:
                yield from rows()
        yield from rows()

    return _tidy(run)


@dataclass
class Level:
    """Phrases of one length with ids: ``keys`` sorted, with the rank and the count of each, and the places of the keys by rank."""

    keys: np.ndarray
    rank: np.ndarray
    counts: np.ndarray
    by_rank: np.ndarray


@dataclass
class Head:
    """Words with ids, in the order of ids, and the levels of longer phrases."""

    langs: list[str]
    lang: np.ndarray  # by id, a place in ``langs``
    words: pa.StringArray
    counts: np.ndarray
    whole: bool  # every frequent word has an id
    levels: list[Level] = field(default_factory=list)

    @staticmethod
    def of(table: pa.Table, whole: bool) -> Head:
        """``table``: lang, phrase, n by falling n."""
        coded = table["lang"].combine_chunks().dictionary_encode()
        words = table["phrase"].combine_chunks().cast(pa.string())
        return Head(coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int32), words, table["n"].to_numpy().astype(np.int64), whole)

    @cached_property
    def ids_by_lang(self) -> dict[str, tuple[pa.BinaryArray, np.ndarray]]:
        """Words and ids. Built once per worker process: workers keep the broadcast object."""
        found = {}
        for code, lang in enumerate(self.langs):
            ids = np.flatnonzero(self.lang == code).astype(np.int32)
            found[lang] = self.words.take(pa.array(ids)).cast(pa.binary()), ids
        return found

    def texts(self, ids: np.ndarray) -> pa.StringArray:
        """Phrases of word ids, one row per phrase."""
        return pc.binary_join_element_wise(*(self.words.take(pa.array(column)) for column in ids.T), " ")

    def langs_of(self, ids: np.ndarray) -> pa.StringArray:
        return pa.array(self.langs, pa.string()).take(pa.array(self.lang[ids]))


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return (left << 24) | right


def _ranks(level: Level, left: np.ndarray, right: np.ndarray, what: str = "rank") -> np.ndarray:
    """Rank (or count) of phrases given by the rank of all but the last word, and the last word; -1 where there is none."""
    out = np.full(len(left), -1, np.int64)
    if not len(level.keys):
        return out
    there = np.flatnonzero((left >= 0) & (right >= 0))
    keys = _joined(left[there], right[there])
    at = np.minimum(np.searchsorted(level.keys, keys), len(level.keys) - 1)
    hit = level.keys[at] == keys
    out[there[hit]] = getattr(level, what)[at[hit]]
    return out


def _unit_ranks(head: Head, ids: np.ndarray) -> list[np.ndarray]:
    """Ranks of the phrases of 1, 2, ... words that start at each place."""
    found = [np.where(ids >= 0, ids, -1)]
    for k, level in enumerate(head.levels, 1):
        found.append(_ranks(level, found[-1][: len(ids) - k], found[0][k:]) if len(ids) > k else np.zeros(0, np.int64))
    return found


def _phrase_ids(head: Head, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Word ids, one row per phrase."""
    columns = [right]
    for level in reversed(head.levels):
        keys = level.keys[level.by_rank[left]]
        columns.append(keys & 0xFFFFFF)
        left = keys >> 24
    return np.stack([left, *reversed(columns)], axis=1)


def _counts_of(head: Head, ids: np.ndarray) -> np.ndarray:
    """Counts of frequent phrases given by word ids; all of them are in the head."""
    rank = ids[:, 0]
    for k in range(1, ids.shape[1]):
        rank = _ranks(head.levels[k - 1], rank, ids[:, k], "rank" if k + 1 < ids.shape[1] else "counts")
    return head.counts[rank] if ids.shape[1] == 1 else rank


def _encode(head):
    """Texts as ids, in rows of one language that end where no phrase goes on."""

    def run(batches):
        known = head.value
        none = pa.array([], pa.binary()), np.zeros(0, np.int32)
        for batch in steps(batches):
            out = [[], [], []]
            for lang, texts in _by_lang(batch):
                values, ids_of = known.ids_by_lang.get(lang, none)
                words = pa.array(words_of(texts), pa.binary())
                at = pc.index_in(words, value_set=values)
                there = at.is_valid().to_numpy(zero_copy_only=False)
                ids = np.full(len(words), BREAK if known.whole else BEYOND, np.int32)
                ids[there] = ids_of[at.drop_null().to_numpy()]
                if not known.whole:
                    ids[pc.equal(words, pa.scalar(_END, pa.binary())).to_numpy(zero_copy_only=False)] = BREAK
                ends = np.flatnonzero(ids == BREAK) + 1
                start = 0
                while start < len(ids):
                    nth = np.searchsorted(ends, start + ROW_IDS)
                    end = int(ends[nth]) if nth < len(ends) else len(ids)
                    row = ids[start:end]
                    beyond = [] if known.whole else words.slice(start, end - start).filter(pa.array(row == BEYOND)).cast(pa.string()).to_pylist()
                    for column, value in zip(out, (lang, row.tobytes(), beyond), strict=True):
                        column.append(value)
                    start = end
            if out[0]:
                yield record_batch(_ENCODED, out)

    return _tidy(run)


def _counted(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, and how often each occurs, or the sums of its counts. Keys without counts are sorted in place."""
    if counts is None:
        keys.sort()
    else:
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.append(len(keys) > 0, np.diff(keys) > 0)) if len(keys) else np.zeros(0, np.int64)
    sums = np.diff(starts, append=len(keys)) if counts is None else np.add.reduceat(counts, starts) if len(starts) else counts
    return keys[starts], sums


def _tile_rows(keys: np.ndarray, parts: int, dense_ids: int):
    """Counted pairs, packed: dense tiles by cell, then the rest sorted and dealt to ``parts`` tiles. Sorts ``keys`` in place."""
    found, counts = _counted(keys)
    counts = counts.astype(np.uint32)
    dense = ((found >> 24) < dense_ids) & ((found & 0xFFFFFF) < dense_ids)
    rows, n = [], dense_ids // SIDE

    def dealt(tile: np.ndarray, number: int):
        order = np.argsort(tile, kind="stable")
        ends = np.searchsorted(tile[order], np.arange(number + 1))
        return ((t, order[ends[t] : ends[t + 1]]) for t in np.flatnonzero(np.diff(ends)).tolist())

    keys, cells = found[dense], counts[dense]
    for t, part in dealt(((keys >> 24) // SIDE * n + (keys & 0xFFFFFF) // SIDE).astype(np.int32), n * n):
        full = (keys[part] >> 24) % SIDE * SIDE + (keys[part] & 0xFFFFFF) % SIDE
        rows.append((-1 - t, full.astype(np.uint16).tobytes(), cells[part].tobytes()))
    found, counts = found[~dense], counts[~dense]
    for t, part in dealt((spread_bits(found) % np.uint64(parts)).astype(np.int32), parts):
        # Bytes of equal weight side by side: sorted keys compress well that way.
        packed = found[part].astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()
        rows.append((t, packed, counts[part].tobytes()))
    return record_batch(_TILES, [list(c) for c in zip(*rows, strict=True)]) if rows else None


def _runs_of_ids(batches):
    """Rows of ids, joined to runs of about ``LOOKUP_IDS`` with a break after each row."""
    held, size = [], 0
    for batch in batches:
        for row in batch.column(0):
            ids = np.frombuffer(row.as_buffer(), np.int32)
            held += [ids.astype(np.int64), np.full(1, BREAK, np.int64)]
            size += len(ids) + 1
            if size >= LOOKUP_IDS:
                yield np.concatenate(held)
                held, size = [], 0
    if held:
        yield np.concatenate(held)


def _count_pairs(head, parts: int, limits: Limits):
    """Packed counts of (phrase with an id, following word with an id), where the phrase without its first word has an id, too."""

    def run(batches):
        known = head.value
        held, size = [], 0

        def flush():
            keys = np.concatenate(held) if held else None
            held.clear()
            out = None if keys is None else _tile_rows(keys, parts, limits.dense)
            return () if out is None else steps([out], 50)

        for ids in _runs_of_ids(batches):
            ranks = _unit_ranks(known, ids)
            longest = ranks[-1]
            if len(longest) < 2:
                continue
            last = ranks[0][len(known.levels) + 1 :]
            left = longest[: len(last)]
            there = (left >= 0) & (longest[1 : len(last) + 1] >= 0) & (last >= 0)
            held.append(_joined(left[there], last[there]))
            size += len(held[-1])
            if size >= limits.pairs:
                yield from flush()
                size = 0
        yield from flush()

    return _tidy(run)


def _add_tiles(head, min_count: int, limits: Limits):
    """Adds up the packed counts of one tile after the other and keeps its frequent phrases."""

    def run(batches):
        known = head.value
        tile, dense, sparse, size = None, None, [], 0

        def merged():
            keys, counts = (np.concatenate(x) for x in zip(*sparse, strict=True))
            sparse.clear()
            return _counted(keys, counts)

        def rows():
            if dense is not None:
                cells = np.flatnonzero(dense >= min_count)
                n = limits.dense // SIDE
                i, j = divmod(-1 - tile, n)
                left, right, counts = i * SIDE + cells // SIDE, j * SIDE + cells % SIDE, dense[cells]
            else:
                keys, counts = merged()
                often = counts >= min_count
                left, right, counts = keys[often] >> 24, keys[often] & 0xFFFFFF, counts[often]
            for at in range(0, len(left), 5000):
                a, b, n = (x[at : at + 5000] for x in (left, right, counts))
                ids = _phrase_ids(known, a, b)
                cuts = range(1, ids.shape[1])
                ls = np.stack([_counts_of(known, ids[:, :k]) for k in cuts], axis=1)
                rs = np.stack([_counts_of(known, ids[:, k:]) for k in cuts], axis=1)
                yield record_batch(_FOUND, [known.langs_of(ids[:, 0]), known.texts(ids), n, a, b.astype(np.int32), ls.tolist(), rs.tolist()])

        for batch in batches:
            for t, cells, counts in zip(batch.column(0).to_pylist(), *(map(pa.BinaryScalar.as_buffer, c) for c in batch.columns[1:]), strict=True):
                if t != tile:
                    if tile is not None:
                        yield from rows()
                    tile, sparse, size = t, [], 0
                    dense = np.zeros(SIDE * SIDE, np.int64) if t < 0 else None
                counts = np.frombuffer(counts, np.uint32).astype(np.int64)
                if dense is not None:
                    dense[np.frombuffer(cells, np.uint16)] += counts
                    continue
                keys = np.ascontiguousarray(np.frombuffer(cells, np.uint8).reshape(8, -1).T).view("<i8").ravel()
                sparse.append((keys, counts))
                size += len(keys)
                if size >= limits.pairs:
                    sparse = [merged()]
                    size = 0
        if tile is not None:
            yield from rows()

    return _tidy(run)


def _count_texts(head, width: int, every: bool, limits: Limits):
    """Phrases of ``width`` words that have a part without an id, by their text.

    ``every``: all phrases of the next shorter length have ids, so only words without one matter.
    """

    def run(batches):
        known, held = head.value, {}

        def rows():
            for lang, found in held.items():
                yield from steps([record_batch(_WORDS, [[lang] * len(found), list(found), list(found.values())])], 20_000)
            held.clear()

        for batch in batches:
            for lang, ids, beyond in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = np.frombuffer(ids, np.int32).astype(np.int64)
                n = len(ids) - width + 1
                if n < 1:
                    continue
                windows = np.lib.stride_tricks.sliding_window_view(ids, width)
                inside = ~(windows == BREAK).any(axis=1)
                bare = (windows == BEYOND).any(axis=1)
                if every:
                    chosen = inside & bare
                else:
                    longest = _unit_ranks(known, ids)[-1]
                    chosen = inside & (bare | (longest[:n] < 0) | (longest[1 : n + 1] < 0))
                at = np.flatnonzero(chosen)
                if not len(at):
                    continue
                words = known.words.take(pa.array(ids, mask=ids < 0)) if len(known.words) else pa.nulls(len(ids), pa.string())
                words = pc.replace_with_mask(words, pa.array(ids == BEYOND), pa.array(beyond, pa.string()))
                found = held.setdefault(lang, Counter())
                found.update(pc.binary_join_element_wise(*(words.take(pa.array(at + k)) for k in range(width)), " ").to_pylist())
            if sum(map(len, held.values())) >= limits.words:
                yield from rows()
        yield from rows()

    return _tidy(run)


def _top_by_count(df: DataFrame, count: str, limit: int) -> tuple[DataFrame, bool]:
    """Rows above the lowest count at which there are at most ``limit``, and whether that is all of them."""
    step = F.floor(F.log2(F.col(count).cast("double")) * 16).cast("int")
    held = {r["step"]: r["rows"] for r in df.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("rows")).collect()}  # about 1000 steps at most
    total, low = 0, None
    for s in sorted(held, reverse=True):
        if total + held[s] > limit:
            break
        total, low = total + held[s], s
    if total == sum(held.values()):
        return df, True
    return (df.limit(0) if low is None else df.where(step >= low)), False


def _level(found: DataFrame, limit: int) -> tuple[Level, bool]:
    few, whole = _top_by_count(found, "a", limit)
    table = few.select("left", "right", "a").toArrow()  # at most ``limit`` rows
    keys = _joined(table["left"].to_numpy().astype(np.int64), table["right"].to_numpy().astype(np.int64))
    counts = table["a"].to_numpy().astype(np.int64)
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    by_rank = np.lexsort((keys, -counts))
    rank = np.empty(len(keys), np.int32)
    rank[by_rank] = np.arange(len(keys), dtype=np.int32)
    return Level(keys, rank, counts, by_rank.astype(np.int32)), whole


def count_phrases(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    min_count: int = MIN_COUNT,
    max_words: int = MAX_WORDS,
    limits: Limits = Limits(),
) -> tuple[DataFrame, list[DataFrame]]:
    """All words, ``lang, phrase, n``, and per length from 2 on the phrases in at least ``min_count`` places.

    Phrases are ``lang, phrase, a, left, right, l, r``; ``l`` and ``r`` hold the counts of the parts at each cut.
    """
    spark = docs.sparkSession
    small_batches(spark, BATCH_BYTES)
    rows = docs.select(F.coalesce(F.col(lang), F.lit(UNDEFINED)).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    words = rows.mapInArrow(_count_words(limits), "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    words = stored(words, "words")
    n_words = words.agg(F.sum("n")).first()[0] or 0
    parts = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), n_words // limits.per_tile)

    top, whole = _top_by_count(words.where(F.col("n") >= min_count), "n", limits.head_words)
    table = top.toArrow().sort_by([("n", "descending"), ("lang", "ascending"), ("phrase", "ascending")])  # at most ``limits.head_words`` rows
    head = Head.of(table, whole)
    shared = spark.sparkContext.broadcast(head)
    encoded = stored(rows.mapInArrow(_encode(shared), "lang string, ids binary, beyond array<string>"), "encoded", compression="zstd")

    levels, every = [], True
    for width in range(2, max_words + 1):
        packed = encoded.select("ids").mapInArrow(_count_pairs(shared, parts, limits), "tile int, cells binary, counts binary")
        dealt = packed.repartition(parts // 4, "tile").sortWithinPartitions("tile")
        found = stored(dealt.mapInArrow(_add_tiles(shared, min_count, limits), _FOUND_SQL), "phrases")
        all_found = found
        if not (whole and every):
            texts = encoded.mapInArrow(_count_texts(shared, width, every, limits), "lang string, phrase string, n long")
            texts = texts.groupBy("lang", "phrase").agg(F.sum("n").alias("a")).where(F.col("a") >= min_count)
            all_found = found.unionByName(_with_parts(stored(texts, "texts"), words, levels), allowMissingColumns=True)
            all_found = stored(all_found, "all-phrases")
        levels.append(all_found)
        if width < max_words:
            level, complete = _level(found, limits.head_phrases)
            every = every and complete
            head = Head(head.langs, head.lang, head.words, head.counts, whole, [*head.levels, level])
            shared = spark.sparkContext.broadcast(head)
    return words, levels


def _with_parts(texts: DataFrame, words: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """Counts of the parts at each cut for phrases known by their text: parts of frequent phrases are words or frequent phrases."""
    counts = reduce(DataFrame.unionByName, [words.select("lang", F.col("phrase").alias("part"), "n"), *[v.select("lang", F.col("phrase").alias("part"), F.col("a").alias("n")) for v in levels]])
    spaced = texts.withColumn("w", F.split("phrase", " "))
    cuts = spaced.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("cut"))
    side = lambda start, length: F.array_join(F.slice("w", start, length), " ")
    sides = cuts.select("lang", "phrase", "a", "cut", side(F.lit(1), F.col("cut")).alias("one"), side(F.col("cut") + 1, F.size("w")).alias("two"))
    for name, n in (("one", "l"), ("two", "r")):
        sides = sides.join(counts.withColumnsRenamed({"part": name, "n": n}), ["lang", name])
    listed = sides.groupBy("lang", "phrase", "a").agg(F.sort_array(F.collect_list(F.struct("cut", "l", "r"))).alias("cuts"))
    return listed.select("lang", "phrase", "a", F.col("cuts.l").alias("l"), F.col("cuts.r").alias("r"))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", top: int = TOP, covered_percent: int = COVERED_PERCENT, **counting) -> DataFrame:
    """The ``top`` phrases of every language: ``lang, rank, phrase, a, l, r, n, score``."""
    words, levels = count_phrases(docs, text, lang, **counting)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    found = reduce(DataFrame.unionByName, [v.select("lang", "phrase", "a", "l", "r") for v in levels])

    held = reduce(DataFrame.unionByName, [_inner_phrases(v, width) for width, v in enumerate(levels[1:], 3)]) if levels[1:] else None
    if held is not None:
        longer = held.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
        found = found.join(longer, ["lang", "phrase"], "left").where(~F.coalesce(100 * F.col("longer") >= covered_percent * F.col("a"), F.lit(False)))

    wide = lambda c, digits=18: c.cast(f"decimal({digits},0)")
    cut = F.transform(
        F.arrays_zip("l", "r"),
        lambda x, k: F.struct(F.call_function("div", wide(F.lit(1_000_000), 7) * wide(F.col("a"), 15) * wide(F.col("a"), 15), wide(x["l"]) * wide(x["r"])).alias("score"), k.alias("k"), x["l"].alias("l"), x["r"].alias("r")),
    )
    scored = found.select("lang", "phrase", "a", F.array_min(cut).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    best = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _inner_phrases(found: DataFrame, width: int) -> DataFrame:
    """``lang, phrase, a`` of the phrases inside each phrase, with its own count."""
    w = F.split("phrase", " ")
    inner = [F.array_join(F.slice(w, at + 1, size), " ") for size in range(2, width) for at in range(width - size + 1)]
    return found.select("lang", F.explode(F.array_distinct(F.array(*inner))).alias("phrase"), "a")
