"""Source divergence audit by chunk factorization: which terms set a source apart from its language and from other sources.

Texts are cut at white space into chunks and the chunks of every document are counted; each globally distinct chunk is split into its
terms once, and the terms are joined back to the counts. A term is a run of letters A-Z, a-z and characters beyond ASCII, with A-Z in
lower case; no term spans two chunks.

A language keeps the terms that occur in at least three of its documents (rows). Shares of a group (language and source) and of the
whole language are smoothed over the kept terms and given in billionths; the divergence of a share ``p`` from another ``q`` is
``(p - q)^2 / q``, rounded down. All arithmetic is exact: decimals, or integers below 2^63.

Counts travel as one row per language and chunk (or term) and task, which holds its sources, their counts and up to three document
numbers: of three documents only their being three matters. Tasks combine before the exchanges by chunk and by term, so
that a frequent chunk or term sends one such row per task.

Sources are compared within tasks: a task adds up the matrix of all pairs of sources over its terms, so that no row per term and pair
exists anywhere. The result has a row per pair of sources of a language, which bounds the broadcast list of sources.

Null texts, languages and sources are read as ''. Groups without terms are there, with the share of an unseen term. An empty table gives an
empty audit. Repeated rows are documents of their own. Long texts are read whole, long chunks are chunks. Other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from dataclasses import dataclass
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.llm.common import record_batch, steps, stored
from lorekeep.operators.common import broadcast_if_small, has_at_most

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Shares are given in units of one to this.
UNIT = 1_000_000_000
MIN_DOCUMENTS = 3
TOP_TERMS = 200
#: Pairs grow with the square of the sources: beyond this number the result itself would have ten billion rows.
MAX_SOURCES = 100_000


@dataclass(frozen=True)
class Limits:
    """What a task holds; results do not depend on it.

    Chunks or terms before they are passed on, entries before they are added up, rows of the matrix of pairs at once (languages with more
    sources are read once for each such tile), and cells of a block of shares, terms x sources.
    """

    words: int = 800_000
    entries: int = 3_000_000
    tile: int = 1024
    cells: int = 500_000


_TALLY = pa.schema([("lang", pa.int32()), ("word", pa.string()), ("groups", pa.list_(pa.int32())), ("times", pa.list_(pa.int64())), ("docs", pa.list_(pa.int64()))])
_TALLY_SQL = "lang int, word string, groups array<int>, times array<long>, docs array<long>"
_TERMS = pa.schema(
    [("lang", pa.string()), ("term", pa.string()), ("total", pa.int64()), ("places", pa.list_(pa.struct([("source", pa.string()), ("n", pa.int64())])))]
)
_TERMS_SQL = "lang string, term string, total long, places array<struct<source: string, n: long>>"
_PAIRS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])


_MASK = (1 << 32) - 1
_TERM = re.compile(TERM.encode())  # all bytes of characters beyond ASCII are in it
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


class Tally:
    """Counts of words per group, and up to three document numbers of every word per language."""

    def __init__(self, lang_of: np.ndarray, limits: Limits) -> None:
        self.lang_of, self.limits = lang_of, limits  # language by group
        self.clear()

    def clear(self) -> None:
        self.codes: defaultdict[bytes, int] = defaultdict()
        self.codes.default_factory = self.codes.__len__
        self.times: list[tuple[np.ndarray, np.ndarray]] = []
        self.docs: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, group: np.ndarray, code: np.ndarray, n: np.ndarray, lang: np.ndarray, doc_code: np.ndarray, number: np.ndarray) -> None:
        self.times.append(((group << 32) | code, n))
        self.docs.append(((lang << 32) | doc_code, number))
        self.size += len(code) + len(doc_code)
        if self.size > self.limits.entries:
            self._add_up()

    def _add_up(self) -> None:
        keys, n = (np.concatenate(x) for x in zip(*self.times, strict=True))
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        starts = _starts(keys)
        self.times = [(keys[starts], np.add.reduceat(n[order], starts) if len(keys) else n)]
        keys, number = (np.concatenate(x) for x in zip(*self.docs, strict=True))
        order = np.lexsort((number, keys))
        keys, number = keys[order], number[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (number[1:] != number[:-1])
        keys, number = keys[new], number[new]
        starts = _starts(keys)
        nth = np.arange(len(keys)) - np.repeat(starts, np.diff(np.append(starts, len(keys))))
        first = nth < MIN_DOCUMENTS
        self.docs = [(keys[first], number[first])]
        self.size = 0

    def rows(self) -> pa.RecordBatch | None:
        """One row per language and word, sorted; three documents become three fixed numbers."""
        if not self.times:
            return None
        self._add_up()
        (keys, n), (doc_keys, number) = self.times[0], self.docs[0]
        group, code = keys >> 32, keys & _MASK
        place = (self.lang_of[group] << 32) | code
        order = np.lexsort((group, place))
        place, group, n = place[order], group[order], n[order]
        starts, doc_starts = _starts(place), _starts(doc_keys)
        docs = np.diff(np.append(doc_starts, len(doc_keys)))
        full = np.repeat(docs >= MIN_DOCUMENTS, docs)
        number = np.where(full, np.arange(len(number)) - np.repeat(doc_starts, docs) - MIN_DOCUMENTS, number)
        words = pa.array(list(self.codes), pa.binary()).cast(pa.string())
        ends = pa.array(np.append(starts, len(place)), pa.int32())
        return record_batch(
            _TALLY,
            [
                pa.array((place[starts] >> 32).astype(np.int32)),
                words.take(pa.array(place[starts] & _MASK)),
                pa.ListArray.from_arrays(ends, pa.array(group.astype(np.int32))),
                pa.ListArray.from_arrays(ends, pa.array(n)),
                pa.ListArray.from_arrays(pa.array(np.append(doc_starts, len(doc_keys)), pa.int32()), pa.array(number)),
            ],
        )


def _starts(ordered: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.zeros(0, np.int64)


def _passed_on(tally: Tally, last: bool = False):
    """Rows of the tally in small batches, if it is full or the last; it is empty then."""
    if last or len(tally.codes) >= tally.limits.words:
        batch = tally.rows()
        tally.clear()
        if batch is not None:
            yield from steps([batch], 5000)


def _count_chunks(groups, limits: Limits):
    """Chunks of texts, counted by group."""

    def run(batches):
        places, lang_of = groups.value[:2]
        tally = Tally(lang_of, limits)
        for batch in steps(batches, 200):
            langs, sources, texts = (c.to_pylist() for c in batch.columns[:3])
            group = np.array([places[g] for g in zip(langs, sources, strict=True)], np.int64)
            number = batch.column(3).to_numpy()
            codes = [list(map(tally.codes.__getitem__, t.encode().split())) for t in texts]  # bytes are split at ASCII white space
            sizes = np.array([len(c) for c in codes])
            keys = (np.repeat(np.arange(len(texts)), sizes) << 32) | np.fromiter(chain.from_iterable(codes), np.int64, int(sizes.sum()))
            keys, n = np.unique(keys, return_counts=True)
            doc, code = keys >> 32, keys & _MASK
            tally.add(group[doc], code, n, lang_of[group[doc]], code, number[doc])
            yield from _passed_on(tally)
        yield from _passed_on(tally, last=True)

    return run


def _spread(owner: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For entries of owners that have ``count`` items each from ``first`` on: which entry, which item."""
    copies = count[owner]
    entry = np.repeat(np.arange(len(owner)), copies)
    nth = np.arange(len(entry)) - np.repeat(np.cumsum(copies) - copies, copies)
    return entry, first[owner[entry]] + nth


def _chunks_to_terms(groups, limits: Limits):
    """Rows per chunk, sorted by chunk, as rows per term. Every chunk is split once."""

    def run(batches):
        tally = Tally(groups.value[1], limits)
        for batch in steps(batches, 5000):
            chunks = batch.column(1).cast(pa.binary()).to_pylist()
            term, times, first, count = [], [], [], []
            previous = None
            for chunk in chunks:
                if chunk != previous:
                    previous, begin = chunk, len(term)
                    found = _TERM.findall(chunk.translate(_LOWER))
                    counted = Counter(found) if len(found) > 1 else dict.fromkeys(found, 1)
                    term += map(tally.codes.__getitem__, counted)
                    times += counted.values()
                first.append(begin)
                count.append(len(term) - begin)
            term, times, first, count = (np.array(x, np.int64) for x in (term, times, first, count))
            lang = batch.column(0).to_numpy().astype(np.int64)
            entry, item = _spread(pc.list_parent_indices(batch.column(2)).to_numpy(), first, count)
            doc, doc_item = _spread(owner := pc.list_parent_indices(batch.column(4)).to_numpy(), first, count)
            group, n, number = (batch.column(i).flatten().to_numpy().astype(np.int64) for i in (2, 3, 4))
            tally.add(group[entry], term[item], n[entry] * times[item], lang[owner[doc]], term[doc_item], number[doc])
            yield from _passed_on(tally)
        yield from _passed_on(tally, last=True)

    return run


def _merged_terms(groups, limits: Limits):
    """Rows per term, sorted by term and language, added up; only terms of three documents leave."""

    def run(batches):
        tally = Tally(groups.value[1], limits)
        langs, sources = (pa.array(names, pa.string()) for names in groups.value[2])

        def kept():
            batch = tally.rows()
            tally.clear()
            if batch is None:
                return
            for rows in steps([batch.filter(pc.equal(pc.list_value_length(batch.column(4)), MIN_DOCUMENTS))], 5000):
                lists = rows.column(2), rows.column(3)
                place = pa.StructArray.from_arrays([sources.take(lists[0].flatten()), lists[1].flatten()], fields=list(_TERMS.field("places").type.value_type))
                ends = np.append(0, np.cumsum(pc.list_value_length(lists[0]).to_numpy()))
                total = np.add.reduceat(lists[1].flatten().to_numpy(), ends[:-1]) if rows.num_rows else np.zeros(0, np.int64)
                yield record_batch(_TERMS, [langs.take(rows.column(0)), rows.column(1), pa.array(total), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), place)])

        last = None
        for batch in steps(batches, 5000):
            terms = batch.column(1).cast(pa.binary()).to_pylist()
            # Whatever is held is complete once another term comes.
            if len(tally.codes) >= limits.words and terms and terms[0] != last:
                yield from kept()
            last = terms[-1] if terms else last
            code = np.fromiter(map(tally.codes.__getitem__, terms), np.int64, len(terms))
            lang = batch.column(0).to_numpy().astype(np.int64)
            owner, doc_owner = (pc.list_parent_indices(batch.column(i)).to_numpy() for i in (2, 4))
            group, n, number = (batch.column(i).flatten().to_numpy().astype(np.int64) for i in (2, 3, 4))
            tally.add(group, code[owner], n, lang[doc_owner], code[doc_owner], number)
        yield from kept()

    return run


def count_terms(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", limits: Limits = Limits()) -> tuple[DataFrame, DataFrame]:
    """``lang, source`` of all groups, and ``lang, term, total, places`` of all kept terms; ``places``: array of ``source, n``."""
    empty = F.lit("")
    rows = docs.select(
        F.coalesce(F.col(lang), empty).alias("lang"), F.coalesce(F.col(source), empty).alias("source"), F.coalesce(F.col(text), empty).alias("text"), F.monotonically_increasing_id().alias("number")
    )
    groups = stored(rows.select("lang", "source").distinct(), "groups")
    if not has_at_most(groups, MAX_SOURCES):
        raise ValueError(f"pairs of more than {MAX_SOURCES} sources")
    found = sorted((r["lang"], r["source"]) for r in groups.collect())
    langs = sorted({x for x, _ in found})
    index = {x: i for i, x in enumerate(langs)}
    context = docs.sparkSession.sparkContext
    names = langs, [s for _, s in found]
    shared = context.broadcast(({g: i for i, g in enumerate(found)}, np.array([index[x] for x, _ in found], np.int64), names))

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = rows.mapInArrow(_count_chunks(shared, limits), _TALLY_SQL)
    terms = chunks.repartition(parts, "word").sortWithinPartitions("word").mapInArrow(_chunks_to_terms(shared, limits), _TALLY_SQL)
    dealt = terms.repartition(parts, "word", "lang").sortWithinPartitions("word", "lang")
    return groups, stored(dealt.mapInArrow(_merged_terms(shared, limits), _TERMS_SQL), "kept-terms")


def _share(n: Column, total: Column, terms: Column) -> Column:
    """``1 + floor(UNIT * (n + 1) / (total + terms))``."""
    wide = lambda c, digits: c.cast(f"decimal({digits},0)")
    exact = F.call_function("div", wide(F.lit(UNIT), 10) * wide(n + 1, 19), wide(total + terms, 19))
    # Decimals only where the product would pass 64 bits.
    return F.when(n < (1 << 63) // UNIT - 1, F.call_function("div", F.lit(UNIT).cast("long") * (n + 1), total + terms)).otherwise(exact) + 1


def _divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _shares(n: np.ndarray, below: np.ndarray) -> np.ndarray:
    """As :func:`_share` for arrays, digit by digit so that nothing passes 64 bits."""
    rest, share = n + 1, np.zeros_like(n)
    for _ in range(3):
        rest = rest * 1000
        share = share * 1000 + rest // below
        rest %= below
    return share + 1


def _pair_sums(known, first: int, limits: Limits):
    """A task's sums of divergences for sources ``first`` to ``first + limits.tile`` of every language against all others."""

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        places = {lang: {s: i for i, s in enumerate(names)} for lang, (names, _) in known.value.items()}
        for batch in steps(batches):
            langs = batch.column(0).to_pylist()
            lists = batch.column(1)
            ends = lists.offsets.to_numpy()
            sources, counts = lists.values.field("source").to_pylist(), lists.values.field("n").to_numpy(zero_copy_only=False)
            by_lang: dict[str, list[int]] = {}
            for i, lang in enumerate(langs):
                by_lang.setdefault(lang, []).append(i)
            for lang, rows in by_lang.items():
                below = known.value[lang][1]
                width, place = len(below), places[lang]
                last = min(first + limits.tile, width)
                if first >= last:
                    continue
                total = sums.setdefault(lang, np.zeros((last - first, width), np.int64))
                high = max(1, limits.cells // width)
                for at in range(0, len(rows), high):
                    some = rows[at : at + high]
                    n = np.zeros((len(some), width), np.int64)
                    for k, i in enumerate(some):
                        span = range(ends[i], ends[i + 1])
                        n[k, [place[sources[j]] for j in span]] = counts[ends[i] : ends[i + 1]]
                    share = _shares(n, below)
                    for g in range(first, last):
                        gap = share[:, g : g + 1] - share
                        total[g - first] += (gap * gap // share).sum(axis=0)
        for lang, total in sums.items():
            names = known.value[lang][0]
            for g, row in enumerate(total, first):
                others = [i for i in range(len(names)) if i != g]
                if others:
                    yield record_batch(_PAIRS, [[lang] * len(others), [names[g]] * len(others), [names[i] for i in others], row[others]])

    return run


def _ranked(found: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    return found.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", top: int = TOP_TERMS, limits: Limits = Limits()) -> DataFrame:
    """``lang, source, part, item, value, rank``.

    Part ``pair``: every other source of the language with the summed divergence of the source's shares from the other's. Part ``term``: the
    ``top`` kept terms that the source has more often than its language, with the divergence from the language's share.
    """
    groups, terms = count_terms(docs, text, lang, source, limits)
    placed = terms.select("lang", "term", "total", F.explode("places").alias("p")).select("lang", "term", "total", "p.source", "p.n")
    sums = placed.groupBy("lang", "source").agg(F.sum("n").alias("group_total"))
    whole = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("total").alias("lang_total"))
    known = groups.join(sums, ["lang", "source"], "left").join(whole, "lang", "left")
    known = stored(known.select("lang", "source", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("group_total", "terms", "lang_total")]), "shares")

    few = broadcast_if_small(known)[0]
    shares = placed.join(few, ["lang", "source"]).select(
        "lang", "source", F.col("term").alias("item"), _share(F.col("n"), F.col("group_total"), F.col("terms")).alias("p"), _share(F.col("total"), F.col("lang_total"), F.col("terms")).alias("q")
    )
    telling = shares.where("p > q").select("lang", "source", "item", _divergence(F.col("p"), F.col("q")).alias("value"))
    by_term = _ranked(telling, "term").where(F.col("rank") <= top)

    lists: dict[str, list] = {}
    for r in known.orderBy("lang", "source").collect():
        lists.setdefault(r["lang"], []).append((r["source"], r["group_total"] + r["terms"], r["terms"]))
    shared = docs.sparkSession.sparkContext.broadcast({k: ([s for s, _, _ in v], np.array([b for _, b, _ in v], np.int64)) for k, v in lists.items() if v[0][2]})
    widest = max(map(len, lists.values()), default=0)
    tiles = [terms.select("lang", "places").mapInArrow(_pair_sums(shared, first, limits), "lang string, source string, item string, value long") for first in range(0, max(widest, 1), limits.tile)]
    added = reduce(DataFrame.unionByName, tiles).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    bare = known.where("terms = 0").select("lang", "source")
    nothing = bare.join(bare.withColumnRenamed("source", "item"), "lang").where("source <> item").select("lang", "source", "item", F.lit(0).cast("long").alias("value"))
    return _ranked(added.unionByName(nothing), "pair").unionByName(by_term)
