"""Near-duplicate documents by consistent weighted sampling of TF-IDF shingles.

Method: a text's shingles are its runs of five words, weighted by their count in the text times an inverse document frequency.
Improved consistent weighted sampling (Ioffe, 2010) draws ``BANDS * ROWS`` samples per text, which agree between two texts with the
probability of their weighted Jaccard similarity. Texts that agree in all samples of a band are candidates; candidates are
verified by the weighted Jaccard similarity of their whole texts, and pairs of ``THRESHOLD`` or more are links. A document's class is the
connected component of its links.

Weights: document frequencies are counted over all documents in ``2 ** BUCKETS`` hashed cells (feature hashing: a fixed share of all
documents is in every cell, whatever their number). The factor is ``1 + ln((1 + documents) / (1 + frequency)) / DAMPING``, so frequent
passages count less, but a large group of near copies does not fall apart.

Groups: equal word sequences are one class at once and are represented by their smallest id. Within a band, candidates are sorted by
their other samples; each is paired with the first of its run and with the one before it, so there are at most two
pairs per text and band and no group is ever held or multiplied out. The sort is a range exchange that splits
groups of any size; pairs across range borders are added afterwards. Each text's best pair is verified first; of
the others only those that would still join two components. Then the runs that still hold several components are dealt in
blocks of bounded size, by component where a component fills one, and all pairs of rows of different components are compared,
between any two blocks and inside each. A pair is left out only if bounds from whole weights and from hashed cells show
that it is below the threshold. So a class is exactly a connected component of all candidates that are links.

Defined results: texts without words are copies of one another; a text of one to four words has one shingle, itself. Rows that
repeat an id are one document, which stays if any of its rows does. Rows without an id belong to the class of the documents with their words; if those all
lack an id, to one without one; ``keep_one`` keeps them all. Extra columns are carried by ``keep_one`` and ignored otherwise.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.llm.common import over_batches, slices, spread_bits, steps, stored
from lorekeep.operators.common import broadcast_if_small

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 14, 4
BUCKETS = 18
#: Rows and characters of a block of a run with several components (or one longer text), and cells of the bound on what two texts share.
BLOCK_ROWS, BLOCK_CHARS, CELLS = 256, 1_000_000, 1024
DAMPING = 12.0
_SLICE = 400_000
_TABLE = 16
_random = np.random.default_rng(6)
_PLACES = _random.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) | np.uint64(1)
_MIX = _random.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)


def _draws() -> np.ndarray:
    """Rows of (1 / r, r, beta, ln c): r and c from Gamma(2, 1), beta uniform."""
    u = np.random.default_rng(66).random((5, 1 << _TABLE))
    r, c = -np.log(u[0] * u[1]), -np.log(u[2] * u[3])
    return np.stack([1 / r, r, u[4], np.log(c)], axis=1).astype(np.float32)


class Words:
    """64-bit hashes of words: for each byte a product of two random numbers, for its value and its place, summed up."""

    def __init__(self):
        r = np.random.default_rng(666)
        self.values = r.integers(1, 1 << 63, 256, dtype=np.uint64)
        self.places = r.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
        self.values[ord(" ")] = 0

    def hashes(self, words: list[str]) -> np.ndarray:
        data = np.frombuffer(" ".join(words).encode(), np.uint8)
        starts = np.append(0, np.flatnonzero(data == ord(" ")) + 1)
        sizes = np.diff(np.append(starts, len(data) + 1))
        place = np.arange(len(data)) - np.repeat(starts, sizes)[: len(data)]
        sums = np.add.reduceat(self.values[data] * self.places[place & 255], starts)
        return spread_bits(sums + sizes.astype(np.uint64))


def shingles(words: list[str], known: Words) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of a word sequence, ascending, and how often each occurs."""
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = known.hashes(words)
    n = max(1, len(h) - SHINGLE + 1)
    mixed = np.full(n, len(h) if len(h) < SHINGLE else SHINGLE, np.uint64)
    for j in range(min(SHINGLE, len(h))):
        mixed += h[j : j + n] * _PLACES[j]
    mixed = np.sort(spread_bits(mixed))
    starts = np.flatnonzero(np.append(True, mixed[1:] != mixed[:-1]))
    return mixed[starts], np.diff(np.append(starts, n))


def cells(found: np.ndarray) -> np.ndarray:
    return (found >> np.uint64(64 - BUCKETS)).astype(np.int64)


def inverse_frequencies(df: DataFrame, text: str = "text") -> np.ndarray:
    """The weight factor of every cell, from all rows of ``df``."""

    def count(batches):
        known, totals, rows = Words(), np.zeros(1 << BUCKETS, np.int64), 0
        for batch in steps(batches):
            texts = batch.column(0).to_pylist()
            for part in slices(texts, _SLICE):
                found = [cells(shingles((texts[i] or "").split(), known)[0]) for i in part]
                rows += sum(len(x) > 0 for x in found)
                totals += np.bincount(np.concatenate(found), minlength=1 << BUCKETS)
        some = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([rows])], ["cell", "n"])
        for at in range(0, len(some), 65536):
            yield pa.RecordBatch.from_arrays([pa.array(some[at : at + 65536]), pa.array(totals[some[at : at + 65536]])], ["cell", "n"])

    counted = df.select(F.col(text).alias("t")).mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    table = counted.toPandas()
    rows = table.loc[table["cell"] < 0, "n"].sum()
    table = table[table["cell"] >= 0]
    frequency = np.zeros(1 << BUCKETS)
    frequency[table["cell"]] = table["n"]
    return (1.0 + np.log((1.0 + rows) / (1.0 + np.minimum(frequency, rows))) / DAMPING).astype(np.float32)


def samples(found: list[tuple[np.ndarray, np.ndarray]], factors: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """The samples of several non-empty texts: a row for each text, a 32-bit number for each sample."""
    h = np.concatenate([x for x, _ in found])
    counts = np.concatenate([n for _, n in found])
    logs = np.log(counts * factors[cells(h)]).astype(np.float32)
    sizes = np.array([len(x) for x, _ in found])
    starts = np.cumsum(sizes) - sizes
    out = np.empty((len(found), len(_MIX)), np.uint32)
    own = (h >> np.uint64(16)).astype(np.uint32)
    for k, mix in enumerate(_MIX):
        row = draws.take(((h * mix) >> np.uint64(64 - _TABLE)).view(np.int64), axis=0)
        step = np.floor(logs * row[:, 0] + row[:, 2])
        value = row[:, 3] - row[:, 1] * (step - row[:, 2] + np.float32(1)) + np.float32(128)
        name = own ^ (step.astype(np.int32).view(np.uint32) * np.uint32(0x9E3779B1))
        packed = (value.view(np.uint32).astype(np.uint64) << np.uint64(32)) | name
        out[:, k] = np.minimum.reduceat(packed, starts).astype(np.uint32)
    return out


def bands_of(drawn: np.ndarray) -> np.ndarray:
    """A 64-bit number for each band of each text."""
    wide = drawn.astype(np.uint64).reshape(len(drawn), BANDS, ROWS)
    total = np.full((len(drawn), BANDS), 7, np.uint64)
    for j in range(ROWS):
        total = spread_bits(total + wide[:, :, j])
    return total.view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], factors: np.ndarray) -> float:
    """Weighted Jaccard similarity of two texts' shingles."""
    common, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = float((np.minimum(a[1][i], b[1][j]) * factors[cells(common)]).sum(dtype=np.float64))
    whole = sum(float((n * factors[cells(x)]).sum(dtype=np.float64)) for x, n in (a, b)) - least
    return least / whole if whole else 1.0


def signatures(df: DataFrame, key: str, text: str, held) -> DataFrame:
    """Written table of ``key``, a digest of the word sequence, the bands (none without words), and the length of the text."""

    def make():
        known, draws, factors = Words(), _draws(), held.value

        def work(batch):
            texts = batch.column(1).to_pylist()
            digests, bands = [], []
            for part in slices(texts, _SLICE):
                words = [(texts[i] or "").split() for i in part]
                digests.extend(hashlib.blake2b("\x1f".join(w).encode(), digest_size=16).digest() for w in words)
                found = [shingles(w, known) for w in words]
                full = [x for x in found if len(x[0])]
                drawn = iter(bands_of(samples(full, factors, draws)).tolist() if full else ())
                bands.extend(next(drawn) if len(x[0]) else [] for x in found)
            lengths = pa.array([len(t or "") for t in texts], pa.int64())
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64())), lengths], ["key", "digest", "bands", "chars"])

        return work

    narrow = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("t"))
    return stored(narrow.mapInArrow(over_batches(make), "key long, digest binary, bands array<long>, chars long"), "neardup-samples", compression="zstd")


def _neighbours(batches):
    """Pairs inside runs of equal (band, value) of a sorted range, and the range's first and last rows."""
    part = TaskContext.get().partitionId()
    last = None  # band, value, leader, id
    for batch in batches:
        band, value, rep = (batch.column(i).to_numpy() for i in range(3))
        n = len(rep)
        same = np.ones(n, bool)
        same[1:] = (band[1:] == band[:-1]) & (value[1:] == value[:-1])
        if last is None:
            yield _pairs([(part, int(band[0]), int(value[0]), 0, int(rep[0]), "first")])
            same[0] = False
        else:
            same[0] = band[0] == last[0] and value[0] == last[1]
        place = np.arange(n)
        at = np.maximum.accumulate(np.where(same, -1, place))
        leader = np.where(at < 0, 0 if last is None else last[2], rep[np.maximum(at, 0)])
        before = np.append(0 if last is None else last[3], rep[:-1])
        m = int(same.sum())
        if m:
            a, b = np.concatenate([leader[same], before[same]]), np.tile(rep[same], 2)
            where = np.flatnonzero(a != b)
            fill = np.full(len(where), part, np.int32)
            bands = np.tile(band[same], 2)[where]
            values = np.tile(value[same], 2)[where]
            kinds = pa.array(np.full(len(where), "pair"))
            yield pa.RecordBatch.from_arrays([pa.array(fill), pa.array(bands), pa.array(values), pa.array(a[where]), pa.array(b[where]), kinds], _PAIR.names)
        last = int(band[-1]), int(value[-1]), int(leader[-1]), int(rep[-1])
    if last is not None:
        yield _pairs([(part, last[0], last[1], last[2], last[3], "last")])


_PAIR = pa.schema([("part", pa.int32()), ("band", pa.int32()), ("value", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("kind", pa.string())])


def _pairs(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(_PAIR.names, r, strict=True)) for r in rows], schema=_PAIR)


def candidates(bands: DataFrame) -> DataFrame:
    """Pairs (a, b) with the number of bands and the band rows behind them; ``bands`` has band, value, order, rep."""
    sorted_ = bands.repartitionByRange("band", "value", "order", "rep").sortWithinPartitions("band", "value", "order", "rep")
    fields = "part int, band int, value long, a long, b long, kind string"
    table = stored(sorted_.select("band", "value", "rep").mapInArrow(_neighbours, fields), "neardup-pairs")
    edge = table.where("kind <> 'pair'").groupBy("part").agg(
        *(F.max(F.when(F.col("kind") == k, F.struct("band", "value", "a", "b"))).alias(k) for k in ("first", "last"))
    )
    before = F.lag("last").over(Window.orderBy("part"))
    across = edge.select("first", before.alias("held")).where("held.band = first.band AND held.value = first.value")
    across = across.select(F.explode(F.array(*(F.struct(F.col(f"held.{c}").alias("a"), F.col("first.b").alias("b")) for c in ("a", "b")))).alias("p"))
    every = table.where("kind = 'pair'").select("a", "b").unionByName(across.select("p.a", "p.b")).where("a <> b")
    ordered = every.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return ordered.groupBy("a", "b").agg(F.count("*").alias("n"))


def verified(pairs: DataFrame, texts: DataFrame, held, threshold: float) -> DataFrame:
    """Written table of ``pairs`` (a, b) with their weighted Jaccard similarity, of ``threshold`` or more."""
    pairs = stored(pairs.select("a", "b"), "neardup-chosen")
    ids = pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).distinct()
    ids, _ = broadcast_if_small(stored(ids, "neardup-ids"))
    some = texts.join(ids, "rep")
    with_b = pairs.join(some.select(F.col("rep").alias("b"), F.col("t").alias("tb")), "b")
    both = with_b.join(some.select(F.col("rep").alias("a"), F.col("t").alias("ta")), "a")

    def make():
        known, factors, last = Words(), held.value, (None, None)

        def work(batch):
            nonlocal last
            a, b, texts_b, texts_a = (batch.column(i) for i in range(4))
            near = np.empty(batch.num_rows)
            for i in range(batch.num_rows):
                one = a[i].as_py()
                if last[0] != one:
                    last = one, shingles((texts_a[i].as_py() or "").split(), known)
                near[i] = similarity(last[1], shingles((texts_b[i].as_py() or "").split(), known), factors)
            done = pa.RecordBatch.from_arrays([a, b, pa.array(near)], ["a", "b", "similarity"])
            return done.filter(pa.array(near >= threshold - 1e-9))

        return work

    found = both.select("a", "b", "tb", "ta").mapInArrow(over_batches(make), "a long, b long, similarity double")
    return stored(found, "neardup-links")


def components(links: DataFrame) -> DataFrame:
    """Written table of (node, label): the smallest node that links lead to, for nodes with links.

    A node takes the smallest label among its neighbours and then the label of that label, until nothing changes.
    """
    edges = stored(links.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(links.select(F.col("b").alias("x"), F.col("a").alias("y"))), "neardup-edges")
    labels = edges.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("node"), F.least("x", "m").alias("label"))
    while True:
        labels = stored(labels, "neardup-labels")
        seen = edges.join(labels.withColumnRenamed("node", "y"), "y").groupBy("x").agg(F.min("label").alias("m"))
        lower = labels.join(seen.withColumnRenamed("x", "node"), "node").select("node", F.least("label", "m").alias("lower"), F.col("label").alias("was"))
        jump = labels.select(F.col("node").alias("lower"), F.col("label").alias("further"))
        new = stored(lower.join(jump, "lower").select("node", F.least("lower", "further").alias("label"), "was"), "neardup-labels")
        if new.where("label <> was").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after further links. Only the components that links join take part in the search."""
    side = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label"))
    joined = links.join(side("a"), "a", "left").join(side("b"), "b", "left")
    between = components(joined.select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b")))
    moved = between.select(F.col("node").alias("label"), F.col("label").alias("to"))
    old = labels.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    new = between.join(labels.select("node"), "node", "left_anti")
    return stored(old.unionByName(new), "neardup-labels")


def _unlike(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs whose ends are in different components."""
    side = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label"))
    joined = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    return joined.where(F.coalesce("a_label", "a") != F.coalesce("b_label", "b")).select(*pairs.columns)


def _dealt(bands: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (g, side, rep, label): the runs with several components, once for every two blocks ``g`` that may hold pairs across components.

    A component that fills a block has blocks of its own; the other rows of its run share some. A row has a side of 0 or 1, or
    -1 if the block is compared with itself.
    """
    run = ["band", "value"]
    known = bands.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    mixed = known.groupBy(*run).agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select(*run)
    mixed, _ = broadcast_if_small(stored(mixed, "neardup-runs"))
    rest = stored(known.join(mixed, run).select("rep", *run, "label", "chars"), "neardup-rest")
    load = F.sum(F.lit(1.0) / BLOCK_ROWS + F.col("chars") / BLOCK_CHARS).alias("load")
    parts = rest.groupBy(*run, "label").agg(load).withColumn("own", F.col("load") >= 1).withColumn("owner", F.when(F.col("own"), F.col("label")).otherwise(0))
    parts = stored(parts, "neardup-parts")
    shares = stored(parts.groupBy(*run, "own", "owner").agg(F.ceil(F.sum("load")).cast("int").alias("n")), "neardup-shares")
    block = F.struct("own", "owner", "i")
    blocks = shares.select(*run, "own", "owner", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i")).select(*run, block.alias("block"))
    x, y = (blocks.withColumnRenamed("block", c) for c in ("x", "y"))
    across = ~(F.col("x.own") & F.col("y.own") & (F.col("x.owner") == F.col("y.owner")))
    pairs = x.join(y, run).where((F.col("x") <= F.col("y")) & across).withColumn("g", F.monotonically_increasing_id())
    pairs = stored(pairs, "neardup-blocks")
    one = F.array(F.struct(F.lit(-1).alias("side"), F.col("x").alias("block")))
    two = F.array(*(F.struct(F.lit(k).alias("side"), F.col(c).alias("block")) for k, c in enumerate("xy")))
    sides = pairs.select(*run, "g", F.explode(F.when(F.col("x") == F.col("y"), one).otherwise(two)).alias("s")).select(*run, "g", "s.side", "s.block")
    owners = parts.join(shares, [*run, "own", "owner"]).select(*run, "label", "own", "owner", "n")
    placed = rest.join(owners, [*run, "label"]).withColumn("i", F.pmod(F.xxhash64("rep", F.lit(17)), F.col("n")).cast("int"))
    return stored(placed.select("rep", *run, "label", block.alias("block")).join(sides, [*run, "block"]).select("g", "side", "rep", "label"), "neardup-dealt")


def block_links(ids: list, labels: list, sides: np.ndarray, found: list, factors: np.ndarray, threshold: float) -> list[tuple[int, int, float]]:
    """Links (a, b, similarity) that join all components between which the rows of two blocks (or one, side -1) have links."""
    weights = np.array([float((n * factors[cells(h)]).sum(dtype=np.float64)) for h, n in found])
    order = np.argsort(weights, kind="stable")
    weights, sides = weights[order], np.asarray(sides)[order]
    label = np.unique(np.array(labels)[order], return_inverse=True)[1]
    shares = np.zeros((len(order), CELLS), np.float32)
    for row, at in enumerate(order):
        h, n = found[at]
        shares[row] = np.bincount((spread_bits(h) >> np.uint64(40)).astype(np.int64) % CELLS, n * factors[cells(h)], CELLS)
    parent = list(range(int(label.max()) + 1))

    def root(i):
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    out = []
    last = np.searchsorted(weights, weights / (threshold - 1e-6) * (1 + 1e-6), "right")
    for i in range(len(order)):
        j = np.arange(i + 1, last[i])
        j = j[(label[j] != label[i]) & ((sides[j] != sides[i]) | (sides[j] < 0))]
        if not len(j):
            continue
        # What two texts share is at most the sum of the lesser of their weights in each cell.
        most = np.minimum(shares[j], shares[i]).sum(axis=1, dtype=np.float64)
        least = threshold / (1 + threshold) * (weights[j] + weights[i])
        for k in j[most * (1 + 1e-4) >= least * (1 - 1e-4)].tolist():
            p, q = root(label[i]), root(label[k])
            if p == q:
                continue
            near = similarity(found[order[i]], found[order[k]], factors)
            if near >= threshold - 1e-9:
                parent[max(p, q)] = min(p, q)
                a, b = sorted((ids[order[i]], ids[order[k]]))
                out.append((a, b, near))
    return out


def remaining(bands: DataFrame, labels: DataFrame, texts: DataFrame, held, threshold: float) -> DataFrame:
    """Written table of links between different components among all candidates; enough of them to join what belongs together."""
    dealt = _dealt(bands, labels)
    ids, _ = broadcast_if_small(stored(dealt.select("rep").distinct(), "neardup-ids"))
    some = texts.join(ids, "rep")
    rows = dealt.join(some, "rep").select("g", "side", "rep", "label", "t").repartition("g").sortWithinPartitions("g")

    def find(batches):
        known, factors = Words(), held.value
        group, ids, labels, sides, found = None, [], [], [], []

        def finished():
            links = block_links(ids, labels, sides, found, factors, threshold) if len(ids) > 1 else []
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*links, strict=True)], ["a", "b", "similarity"])

        for batch in steps(batches):
            for g, side, rep, label, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if g != group:
                    yield from finished()
                    group, ids, labels, sides, found = g, [], [], [], []
                ids.append(rep)
                labels.append(label)
                sides.append(side)
                found.append(shingles((text or "").split(), known))
        yield from finished()

    links = rows.mapInArrow(find, "a long, b long, similarity double").groupBy("a", "b").agg(F.max("similarity").alias("similarity"))
    return stored(links, "neardup-links")


def classes(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``key``, ``copy_of`` (smallest id with the same words), ``class_id`` (smallest id of the class) and ``kept``."""
    held = df.sparkSession.sparkContext.broadcast(inverse_frequencies(df, text))
    signed = signatures(df, key, text, held)
    reps = stored(
        signed.groupBy("digest").agg(F.min("key").alias("rep"), F.any_value("bands").alias("bands"), F.max("chars").alias("chars")), "neardup-reps"
    )
    order = F.xxhash64(*(F.element_at("bands", k + 1) for k in range(BANDS)))
    bands = reps.where(F.col("rep").isNotNull() & (F.size("bands") > 0)).select("rep", "chars", F.posexplode("bands").alias("band", "value"), order.alias("order"))
    texts = df.select(F.col(key).cast("long").alias("rep"), F.col(text).alias("t"))
    labels = stored(bands.select(F.col("rep").alias("node"), F.col("rep").alias("label")).limit(0), "neardup-labels")
    pairs = stored(candidates(bands), "neardup-candidates")
    best = Window.partitionBy("b").orderBy(F.desc("n"), "a")
    first = pairs.withColumn("rank", F.row_number().over(best)).where("rank = 1").select("a", "b")
    for chosen in (first, pairs.join(first, ["a", "b"], "left_anti").select("a", "b")):
        labels = merged(labels, verified(_unlike(chosen, labels), texts, held, threshold))
    labels = merged(labels, remaining(bands, labels, texts, held, threshold))
    named = reps.select("digest", "rep").join(labels, reps["rep"] == labels["node"], "left").select("digest", "rep", F.coalesce("label", "rep").alias("class_id"))
    joined = signed.select("key", "digest").join(named, "digest")
    return joined.select(F.col("key").alias(key), F.col("rep").alias("copy_of"), "class_id", F.col("key").eqNullSafe(F.col("class_id")).alias("kept"))


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One document of each class, with the columns of ``df``."""
    found = classes(df, key, text, threshold).where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_gone")).agg(F.max("kept").alias("stays"))
    gone, _ = broadcast_if_small(stored(found.where("NOT stays").select("_gone"), "neardup-gone"))
    return df.join(gone, F.col(f"`{key}`") == F.col("_gone"), "left_anti")
