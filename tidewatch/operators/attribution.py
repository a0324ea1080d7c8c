"""Exact additive attribution of boosted trees: each input's Shapley value, path-dependent.

For a set S of known inputs a tree's value is the expectation over its leaves where splits on inputs outside S are
followed both ways, weighed by the training rows on each side.  A leaf then contributes a product over the inputs on
its path, so its Shapley values need no subsets: with o (does the row fulfil the input's conditions) and z (share of
rows that do) of each input, they follow from the coefficients of the product of (z + o t) over the other inputs.

The leaves of the whole ensemble are a small table that goes to every task; rows are attributed in Arrow batches.
Contributions of a row add up to its prediction less the base value.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a batch that meet all leaves at once.
_ROWS = 256


@dataclass(frozen=True)
class Node:
    """A leaf (feature None) or a split: values up to threshold go left.  cover: training rows that came by."""

    value: float
    cover: float
    feature: int | None = None
    threshold: float = 0.0
    left: Node | None = None
    right: Node | None = None


@dataclass(frozen=True)
class Leaves:
    """Leaves whose paths hold equally many inputs: value, and for each input its number, bounds (low, high] and share."""

    value: np.ndarray
    feature: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray


def leaves(trees: list[tuple[float, Node]]) -> tuple[float, list[Leaves]]:
    """(base value, leaves by number of inputs) of weighted trees."""
    found: dict[int, list] = {}
    base = 0.0

    def walk(node: Node, weight: float, path: dict[int, tuple[float, float, float]], reach: float) -> None:
        nonlocal base
        if node.feature is None:
            base += weight * node.value * reach
            found.setdefault(len(path), []).append((weight * node.value, *zip(*[(f, *p) for f, p in path.items()], strict=True)) if path else (weight * node.value, (), (), (), ()))
            return
        low, high, share = path.get(node.feature, (-np.inf, np.inf, 1.0))
        for side, (a, b) in ((node.left, (low, min(high, node.threshold))), (node.right, (max(low, node.threshold), high))):
            part = side.cover / node.cover if node.cover else 0.0
            walk(side, weight, path | {node.feature: (a, b, share * part)}, reach * part)

    for weight, root in trees:
        walk(root, weight, {}, 1.0)
    tables = []
    for rows in (r for n, r in sorted(found.items()) if n):
        value, feature, low, high, share = zip(*rows, strict=True)
        tables.append(Leaves(np.array(value), np.array(feature, dtype=np.int64), np.array(low), np.array(high), np.array(share)))
    return base, tables


def shapley(x: np.ndarray, tables: list[Leaves]) -> np.ndarray:
    """Rows by inputs: contributions to the ensemble's value."""
    out = np.zeros(x.shape)
    for t in tables:
        n = t.feature.shape[1]
        weight = [factorial(k) * factorial(n - 1 - k) / factorial(n) for k in range(n)]
        for at in range(0, len(x), _ROWS):
            part = x[at : at + _ROWS]
            one = (part[:, t.feature] > t.low) & (part[:, t.feature] <= t.high)  # rows x leaves x inputs
            for i in range(n):
                terms = [np.ones(one.shape[:2])]
                for j in range(n):
                    if j != i:
                        z, o = t.share[:, j], one[:, :, j]
                        terms = [(terms[k] * z if k < len(terms) else 0.0) + (terms[k - 1] * o if k else 0.0) for k in range(len(terms) + 1)]
                whole = sum(w * c for w, c in zip(weight, terms, strict=True))
                phi = t.value * (one[:, :, i] - t.share[:, i]) * whole
                for f in np.unique(t.feature[:, i]):
                    out[at : at + _ROWS, f] += phi[:, t.feature[:, i] == f].sum(axis=1)
    return out


def spark_trees(model) -> list[tuple[float, Node]]:
    """The weighted trees of a fitted pyspark.ml tree regressor; splits must be on continuous inputs."""

    def node(j) -> Node:
        stats = j.impurityStats()
        value, cover = float(j.prediction()), float(stats.count())
        if j.subtreeDepth() == 0:
            return Node(value, cover)
        split = j.split()
        return Node(value, cover, int(split.featureIndex()), float(split.threshold()), node(j.leftChild()), node(j.rightChild()))

    trees = list(getattr(model, "trees", [model]))
    weights = list(getattr(model, "treeWeights", [1.0] * len(trees)))
    return [(float(w), node(t._java_obj.rootNode())) for w, t in zip(weights, trees, strict=True)]


def contributions(rows: DataFrame, trees: list[tuple[float, Node]], inputs: list[str], keys: list[str], feature_of: dict[str, str] | None = None) -> DataFrame:
    """(keys, base_value, predicted, feature, contribution): one row for each row and feature.

    inputs: columns in the order of the trees' feature numbers, none null.  feature_of: the feature that an input
    belongs to, if several do (a value and its flag); their contributions are added.
    """
    base, tables = leaves(trees)
    names = list(dict.fromkeys((feature_of or {}).get(c, c) for c in inputs))
    place = np.array([names.index((feature_of or {}).get(c, c)) for c in inputs])
    schema = rows.select(*keys).withColumns({"base_value": F.lit(0.0), "predicted": F.lit(0.0), "feature": F.lit(""), "contribution": F.lit(0.0)}).schema
    wide = rows.select(*keys, F.array(*[F.col(c).cast("double") for c in inputs]).alias("_x"))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = batch.column(len(keys)).flatten().to_numpy(zero_copy_only=False).reshape(n, len(inputs))
            phi = np.zeros((n, len(names)))
            np.add.at(phi.T, place, shapley(x, tables).T)
            each = pa.array(np.repeat(np.arange(n), len(names)))
            columns = [batch.column(k).take(each) for k in range(len(keys))]
            predicted = base + phi.sum(axis=1)
            columns += [pa.array(np.full(n * len(names), base)), pa.array(np.repeat(predicted, len(names))), pa.array(names * n), pa.array(phi.ravel())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return wide.mapInArrow(told, schema)
