"""Toxicity by a classifier chain: each category's model also sees the probabilities of the categories before it.

Features are hashed words and beginnings of words, as shares of the text, so
that a long clean text with a chance word stays clean. Of the buckets, those are
kept that tell toxic from other documents in the training sample.

The chain's categories come from the labels and from what the labelled texts
have in common; no list of words is given. First comes ``poor``, from the label of
quality, if the table has it. Then come ``kind_1``, ``kind_2``, ...: the toxic documents of the
sample, parted into clusters by the words that tell them from the others, as
toxic texts of one sort share their words. The last link is trained on the label ``toxic`` and
decides. Links are logistic regressions; the probabilities that a later link is
trained on are out of fold, so that it learns how far the earlier ones can be
trusted on texts they have not seen. The cut-off is the one with the best F1
on held-out probabilities: of each fold by a chain whose buckets, kinds and links come from the other folds
alone (``held_out`` has the counts; only the cut-off itself has seen those rows).

The model is fitted on a bounded sample of labelled rows (``sample``) and keeps a
bounded number of buckets (``features``, those that tell most); all documents are
scored, whole, without a shuffle.

Defined cases: a null or empty text has no features and gets the chain's base
probabilities; a category without positive or without negative examples has its
share as its probability; without labels nothing is toxic; repeated label rows
count as toxic, or poor, if any of them is; of documents that repeat a labelled id the
one with the least hash is the example, and each is scored by itself; a probability that
equals the cut-off is toxic; very long texts are read whole, a block of rows at a time; an
empty table gives an empty result; :func:`keep_civil` passes columns of any name through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import on_workers, parts
from docloom.llm.hashed import Features, Sparse, labelled, minimise, share, sigmoid, telling, word_features

@dataclass(frozen=True)
class Settings:
    """``sample``: labelled documents that the chain is trained on, at most; ``features``: buckets it keeps; ``kinds``: clusters of toxic documents."""

    sample: int = 8000
    features: int = 1500
    folds: int = 4
    penalty: float = 1e-4
    kinds: int = 3


@dataclass
class Link:
    """``w``: weights of the features, then of the probabilities before, then the constant."""

    name: str
    w: np.ndarray


@dataclass
class Chain:
    buckets: np.ndarray
    links: list[Link]
    cutoff: float
    held_out: dict[str, int] | None = None  # labelled rows by chains that have not seen them, at the cut-off

    def probabilities(self, x: Sparse) -> np.ndarray:
        """A column for each link."""
        row, out = x.row, np.empty((len(x.start) - 1, 0))
        for link in self.links:
            k = out.shape[1]
            z = x.dot(link.w[: x.width], row) + out @ link.w[x.width : x.width + k] + link.w[-1]
            out = np.column_stack([out, sigmoid(z)])
        return out


def fit_link(x: Sparse, before: np.ndarray, y: np.ndarray, penalty: float) -> np.ndarray:
    """Logistic regression on features and earlier probabilities."""
    n, k = len(y), before.shape[1]
    w = np.zeros(x.width + k + 1)
    mean = y.mean() if n else 0.0
    if n == 0 or mean in (0.0, 1.0):
        w[-1] = -35.0 if mean == 0 else 35.0
        return w
    row = x.row
    w[-1] = np.log(mean / (1 - mean))

    def loss(w):
        z = np.clip(x.dot(w[: x.width], row) + before @ w[x.width : -1] + w[-1], -35, 35)
        r = (sigmoid(z) - y) / n
        value = float(np.mean(np.logaddexp(0, z) - y * z)) + penalty / 2 * float(w[:-1] @ w[:-1])
        g = np.concatenate([x.back(r, row), before.T @ r, [r.sum()]])
        g[:-1] += penalty * w[:-1]
        return value, g

    return minimise(loss, w)


def best_cutoff(p: np.ndarray, y: np.ndarray) -> float:
    """The probability from which on calling documents toxic has the best F1."""
    if not len(y) or not y.any():
        return 1.1
    order = np.argsort(-p, kind="stable")
    p, hit = p[order], np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(p) + 1) + y.sum())
    last = np.r_[p[1:] != p[:-1], True]  # equal probabilities share a side
    k = int(np.argmax(np.where(last, f1, -1)))
    return float((p[k] + (p[k + 1] if k + 1 < len(p) else 0.0)) / 2)


def clusters(x: Sparse, toxic: np.ndarray, count: int, rounds: int = 25) -> np.ndarray:
    """A cluster from 1 to ``count`` for each toxic row, 0 for the others: k-means on unit vectors of the buckets more usual in toxic rows.

    The first centre is the row nearest to the mean, each further one the row farthest from those chosen.
    """
    out, at = np.zeros(len(toxic), np.int64), np.nonzero(toxic)[0]
    if not len(at):
        return out
    row, n1 = x.row, len(at)
    n0 = max(1, len(toxic) - n1)
    on = toxic[row] > 0
    usual = np.bincount(x.column[on], x.value[on], x.width) / n1 > np.bincount(x.column[~on], x.value[~on], x.width) / n0
    part = x.rows(at).columns(np.nonzero(usual)[0])
    dense = np.zeros((n1, part.width), np.float32)
    dense[part.row, part.column] = np.log1p(part.value)
    dense /= np.maximum(np.linalg.norm(dense, axis=1, keepdims=True), 1e-9)
    centres = dense[[int(np.argmax(dense @ dense.mean(axis=0)))]]
    while len(centres) < min(count, n1):
        centres = np.concatenate([centres, dense[[int(np.argmin((dense @ centres.T).max(axis=1)))]]])
    for _ in range(rounds):
        of = np.argmax(dense @ centres.T, axis=1)
        new = np.stack([dense[of == k].mean(axis=0) if (of == k).any() else centres[k] for k in range(len(centres))])
        new /= np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-9)
        if np.allclose(new, centres):
            break
        centres = new
    out[at] = 1 + np.argmax(dense @ centres.T, axis=1)
    return out


def folds_of(n: int, folds: int) -> np.ndarray:
    """A fold for each of ``n`` rows, of equal sizes and by no order of theirs; equal arguments give equal folds."""
    return np.random.default_rng(n).permutation(n) % folds


def fit_chain(x: Sparse, targets: dict[str, np.ndarray], settings: Settings) -> tuple[list[Link], np.ndarray]:
    """Links in the order of ``targets``, and the out-of-fold probabilities, a column for each."""
    n = len(x.start) - 1
    fold = folds_of(n, settings.folds)
    links, before = [], np.empty((n, 0))
    for name, y in targets.items():
        unseen = np.zeros(n)
        for k in range(settings.folds):
            train, test = np.nonzero(fold != k)[0], np.nonzero(fold == k)[0]
            w = fit_link(x.rows(train), before[train], y[train], settings.penalty)
            part = x.rows(test)
            unseen[test] = sigmoid(part.dot(w[: x.width], part.row) + before[test] @ w[x.width : -1] + w[-1])
        links.append(Link(name, fit_link(x, before, y, settings.penalty)))
        before = np.column_stack([before, unseen])
    return links, before


def fit_whole(x: Sparse, toxic: np.ndarray, poor: np.ndarray | None, settings: Settings) -> tuple[np.ndarray, list[Link]]:
    """All that is learnt from rows, but for the cut-off: the buckets that tell, the kinds, the links."""
    buckets = telling(x, toxic, settings.features)
    x = x.columns(buckets)
    kind = clusters(x, toxic, settings.kinds)
    targets = {} if poor is None else {"poor": poor}
    targets |= {f"kind_{k}": (kind == k).astype(float) for k in range(1, settings.kinds + 1)}
    return buckets, fit_chain(x, targets | {"toxic": toxic}, settings)[0]


def held_out(x: Sparse, toxic: np.ndarray, poor: np.ndarray | None, settings: Settings) -> np.ndarray:
    """The probability of ``toxic`` for each row by a chain whose buckets, kinds and links were learnt without the row's fold."""
    fold, out = folds_of(len(toxic), settings.folds), np.zeros(len(toxic))
    for k in range(settings.folds):
        train, test = np.nonzero(fold != k)[0], np.nonzero(fold == k)[0]
        if len(test):
            buckets, links = fit_whole(x.rows(train), toxic[train], None if poor is None else poor[train], settings)
            out[test] = Chain(buckets, links, 0.0).probabilities(x.rows(test).columns(buckets))[:, -1]
    return out


def fit(docs: DataFrame, labels: DataFrame, settings: Settings) -> Chain:
    wanted = {"toxic": F.max("toxic")} | ({"poor": F.max((F.coalesce("quality", F.lit(1)) == 0).cast("int"))} if "quality" in labels.columns else {})
    x, y, _ = labelled(docs, labels, wanted, word_features, settings.sample)
    toxic = (y["toxic"] > 0).astype(float)
    poor = (y["poor"] > 0).astype(float) if "poor" in y else None
    p = held_out(x, toxic, poor, settings)
    cutoff = best_cutoff(p, toxic)
    said = p >= cutoff
    figures = {"toxic": int(toxic.sum()), "found": int((said & (toxic > 0)).sum()), "others": int((toxic == 0).sum()), "false": int((said & (toxic == 0)).sum())}
    return Chain(*fit_whole(x, toxic, poor, settings), cutoff, figures)


class Scorer:
    """A chain with the memory of a worker."""

    def __init__(self, chain: Chain):
        self.chain, self.features = chain, Features(word_features, chain.buckets)

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        start, column, value = [0], [], []
        for text in texts:
            seen, n = self.features.counts(text)
            column.extend(seen.keys())
            value.extend(share(c, n) for c in seen.values())
            start.append(len(column))
        return self.chain.probabilities(Sparse(np.array(start), np.array(column, np.int64), np.array(value, np.float64), len(self.chain.buckets)))


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """``doc_id``, the probability of each category as ``p_<category>``, ``toxic`` and ``kept`` for each row."""
    on_workers(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(chain)  # bounded by the number of features
    names = [f"p_{link.name}" for link in chain.links]
    schema = "doc_id long, " + "".join(f"{k} double, " for k in names) + "toxic boolean, kept boolean"

    def go(batches):
        scorer = Scorer(sent.value)
        for batch in (part for whole in batches for part in parts(whole, 1)):
            p = np.round(scorer(batch.column(1).to_pylist()), 9)
            toxic = p[:, -1] >= sent.value.cutoff
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(p[:, i]) for i in range(p.shape[1])), pa.array(toxic), pa.array(~toxic)], names=["doc_id", *names, "toxic", "kept"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(go, schema)


def keep_civil(docs: DataFrame, chain: Chain) -> DataFrame:
    """The rows of ``docs`` that the chain does not call toxic, with all their columns."""
    on_workers(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(chain)  # bounded by the number of features
    i = docs.columns.index("text")

    def go(batches):
        scorer = Scorer(sent.value)
        for batch in (part for whole in batches for part in parts(whole, i)):
            p = np.round(scorer(batch.column(i).to_pylist()), 9)
            yield batch.filter(pa.array(p[:, -1] < sent.value.cutoff))

    return docs.mapInArrow(go, docs.schema)
