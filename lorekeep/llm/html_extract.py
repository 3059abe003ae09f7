"""Main text of web pages: boosted trees over nodes, decoded along the tree.

Method: the block elements of a page form a tree. Every node has features: text and link density of its subtree, size, depth,
place among its siblings, and groups of words in class, id and role, of its own and of the elements above it.
Gradient-boosted trees give the log odds that its text is main text. Decoding picks the best consistent choice: on the way
from the root, nodes are outside first, then inside the article, then in a part of it that does not belong; they may stay in a state or go
to the next one, never back. So a dropped element has no kept descendant below a kept ancestor. The maximum over all such
choices is found from the leaves up.

The trees are trained with Spark on ``TRAIN_PAGES`` composed pages, as no table holds labelled ones. The model's size is
fixed; pages are worked on where they are read and never shuffled.

Text: character references are decoded, white space folds to one space, blocks and line breaks are joined by one space in page
order. Headings inside the article belong to it. Defined results: a null or empty page has no text; unfinished
markup at a page's end is markup. Repeated rows are extracted each. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm.common import over_batches, slices
from lorekeep.llm.html_samples import sample_page
from lorekeep.llm.html_tree import Page, features, read_page

TRAIN_PAGES = 3000
ROUNDS, DEPTH, LEAF_NODES = 80, 5, 20
#: What entering an article, and leaving one for a part that does not belong, costs in log odds.
ENTER, LEAVE = 0.3, 1.0
#: Log odds count up to here, and are multiplied by the weight in nodes without text of their own.
MOST, EMPTY_WEIGHT = 4.0, 1.0


@dataclass(frozen=True)
class Trees:
    """Boosted regression trees as arrays, a row for each tree; a leaf is its own child."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    @staticmethod
    def of(model) -> Trees:
        """From a fitted GBTClassificationModel."""
        trees = []
        for tree, weight in zip(model.trees, model.treeWeights, strict=True):
            nodes: list[list] = []

            def walk(node, weight=weight, nodes=nodes) -> int:
                at = len(nodes)
                nodes.append([0, np.inf, at, at, weight * node.prediction()])
                if node.subtreeDepth() > 0:
                    split = node.split()
                    nodes[at][0], nodes[at][1] = split.featureIndex(), split.threshold()
                    nodes[at][2] = walk(node.leftChild())
                    nodes[at][3] = walk(node.rightChild())
                return at

            walk(tree._java_obj.rootNode())
            trees.append(nodes)
        most = max(map(len, trees))
        padded = [t + [[0, np.inf, i, i, 0.0] for i in range(len(t), most)] for t in trees]
        columns = [np.array([[n[k] for n in t] for t in padded]) for k in range(5)]
        return Trees(*(c.astype(kind) for c, kind in zip(columns, (np.int32, float, np.int32, np.int32, float), strict=True)), DEPTH)

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Log odds of every row."""
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, threshold, left, right, value in zip(self.feature, self.threshold, self.left, self.right, self.value, strict=True):
            at = np.zeros(len(x), np.int32)
            for _ in range(self.depth):
                at = np.where(x[rows, feature[at]] <= threshold[at], left[at], right[at])
            total += value[at]
        return 2 * total


def fit(spark: SparkSession, pages: int = TRAIN_PAGES) -> Trees:
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    def nodes(batches):
        for batch in batches:
            for i in batch.column(0).to_pylist():
                page = read_page(sample_page(i))
                x = features([page])
                labels = pa.array([float(y) for y in page.label])
                yield pa.RecordBatch.from_arrays([labels, pa.array(x.tolist(), pa.list_(pa.float64()))], ["label", "x"])

    rows = spark.range(0, pages, 1, 4).mapInArrow(nodes, "label double, x array<double>")
    data = rows.select("label", array_to_vector("x").alias("features"))
    return Trees.of(GBTClassifier(maxIter=ROUNDS, maxDepth=DEPTH, minInstancesPerNode=LEAF_NODES, stepSize=0.2, subsamplingRate=0.7, featureSubsetStrategy="0.4", seed=4).fit(data))


def decode(page: Page, margins: list[float]) -> list[bool]:
    """Which nodes are inside, by the best consistent choice."""
    n, parent = len(page.parent), page.parent
    outside, inside, apart = [0.0] * n, [0.0] * n, 0.0
    for v in range(n - 1, -1, -1):
        gain = max(-MOST, min(MOST, margins[v])) * (1.0 if page.own[v] else EMPTY_WEIGHT)
        inside[v] += gain
        if v:
            p = parent[v]
            outside[p] += max(outside[v], inside[v] - ENTER)
            inside[p] += max(inside[v], apart - LEAVE)
    state = [0] * n
    state[0] = 1 if inside[0] - ENTER > outside[0] else 0
    for v in range(1, n):
        above = state[parent[v]]
        if above == 0:
            state[v] = 1 if inside[v] - ENTER > outside[v] else 0
        elif above == 1:
            state[v] = 1 if inside[v] >= apart - LEAVE else 2
        else:
            state[v] = 2
    return [s == 1 for s in state]


def kept_text(page: Page, kept: list[bool]) -> str:
    pieces, gap = [], False
    for node, piece, fresh in page.texts:
        gap |= fresh
        if kept[node]:
            pieces.append(" " + piece if gap else piece)
            gap = False
        else:
            gap = True
    return " ".join("".join(pieces).split())


def texts_of(sources: list[str | None], trees: Trees) -> list[str]:
    out = []
    for part in slices(sources):
        pages = [read_page(sources[i] or "", labelled=False) for i in part]
        margins = trees.margins(features(pages)).tolist()
        at = 0
        for page in pages:
            n = len(page.parent)
            out.append(kept_text(page, decode(page, margins[at : at + n])))
            at += n
    return out


def extract(df: DataFrame, trees: Trees, html: str = "html", keep: tuple = ("page_id", "url")) -> DataFrame:
    """The columns of ``keep``, ``text`` and ``n_chars``."""
    held = df.sparkSession.sparkContext.broadcast(trees)
    narrow = df.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), F.col(html).alias("h"))

    def make():
        def work(batch):
            text = pa.array(texts_of(batch.column(len(keep)).to_pylist(), held.value), pa.string())
            return pa.RecordBatch.from_arrays([*batch.columns[:-1], text], [*batch.schema.names[:-1], "t"])

        return work

    fields = ", ".join(f"k{i} {narrow.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(keep)))
    done = narrow.mapInArrow(over_batches(make), fields + ", t string")
    return done.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), F.col("t").alias("text"), F.length("t").cast("long").alias("n_chars"))
