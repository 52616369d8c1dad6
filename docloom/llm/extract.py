"""Main text of web pages by a recurrent block labeller.

A page is a sequence of leaf blocks (:mod:`docloom.llm.blocks`). A block's
vector joins the buckets that its path of tags, classes and ids hashes to, the
buckets of its words, and a few measures: length, share of link text, depth and
place. A bidirectional LSTM in numpy reads the vectors of the whole page, so
that every block is judged in the context of all others, and gives each the
probability that it is main text. The text is those of one half or more, in page order.

The model is trained here, on invented pages whose main text is known
(:mod:`docloom.llm.sample_pages`); training takes about 40 seconds on the driver and
does not depend on the data. Its weights are sent to the executors; pages are
labelled in batches of similar length, whole, without a shuffle.

Defined cases: null and empty html, and pages without main text, give an empty
text; a probability of exactly one half counts as main text; repeated rows give equal results; very long
pages are read whole, in time linear in them, and labelled by themselves; an empty table gives
no rows; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import random
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docloom.llm.blocks import PATH_BUCKETS, Block, Paths, blocks
from docloom.llm.common import on_workers
from docloom.llm.lstm import BiLstm, train
from docloom.llm.sample_pages import MARK, Pages

WORD_BUCKETS = 32
MEASURES = 9
WIDTH = PATH_BUCKETS + WORD_BUCKETS + MEASURES
HIDDEN = 20
#: Cells of time and batch that are labelled at once, and paths and words remembered.
CELLS = 1 << 14
MEMO = 200_000

_MARKS = re.compile(r"[^\w\s]")


class Vectors:
    """Vectors of blocks: buckets of paths apart, as many blocks share a path."""

    def __init__(self):
        self.paths = Paths()
        self.words: dict[str, int] = {}

    def parse(self, page: str | None) -> list[Block]:
        return blocks(page, self.paths)

    def path_rows(self, paths: list[int]) -> np.ndarray:
        rows = np.zeros((len(paths), PATH_BUCKETS), np.float32)
        for i, path in enumerate(paths):
            rows[i, list(self.paths.buckets[path])] = 1
        return rows

    def _bucket(self, word: str) -> int:
        found = zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) % WORD_BUCKETS
        if len(self.words) < MEMO and len(word) < 40:
            self.words[word] = found
        return found

    def rest(self, found: list[Block]) -> np.ndarray:
        """Shares of words by bucket, and measures, of the blocks of one page."""
        n = len(found)
        out = np.zeros((n, WORD_BUCKETS + MEASURES), np.float32)
        for i, b in enumerate(found):
            words = b.text.split(" ")
            hashed = [self._bucket(w) if k is None else k for w, k in zip(words, map(self.words.get, words), strict=True)]
            row = out[i]
            row[:WORD_BUCKETS] = np.bincount(hashed, minlength=WORD_BUCKETS)
            row[:WORD_BUCKETS] = np.minimum(row[:WORD_BUCKETS] / len(words), 0.2)  # a word said over and over is no cue
            chars = len(b.text)
            row[WORD_BUCKETS:] = (
                min(3.0, np.log1p(chars) / 3),
                min(2.0, np.log1p(len(words)) / 2),
                min(1.0, b.link_chars / chars),
                min(1.0, chars / len(words) / 12),
                1.0 if b.text[-1] in ".!?" else 0.0,
                1.0 if "©" in b.text else 0.0,
                min(1.0, self.paths.depth[b.path] / 12),
                i / n,
                1.0 / (1 + i),
            )
        return out

    def trim(self) -> None:
        if len(self.paths.buckets) > MEMO:
            self.paths = Paths()


def _batch(pages: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    steps = max(len(y) for _, y in pages)
    x = np.zeros((steps, len(pages), pages[0][0].shape[1]), np.float32)
    mask, y = np.zeros((steps, len(pages)), bool), np.zeros((steps, len(pages)), np.float32)
    for i, (a, b) in enumerate(pages):
        x[: len(b), i], mask[: len(b), i], y[: len(b), i] = a, True, b
    return x, mask, y


def examples(seed: int, count: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Vectors and labels of the blocks of invented pages."""
    source, vectors, out = Pages(seed), Vectors(), []
    for _ in range(count):
        found = vectors.parse(source.page())
        y = np.array([b.text.startswith(MARK) for b in found], np.float32)
        for b in found:
            b.text = b.text.replace(MARK, "").strip() or "x"
        out.append((np.concatenate([vectors.path_rows([b.path for b in found]), vectors.rest(found)], axis=1).astype(np.float16), y))
    return out


@lru_cache(2)
def labeller(seed: int = 7, pages: int = 3400, rounds: int = 10, size: int = 40) -> BiLstm:
    """The trained model; equal arguments give equal models."""
    known = examples(seed, pages)
    rng = random.Random(seed)
    drop = np.random.default_rng(seed)

    def batches(k: int):
        order = sorted(range(len(known)), key=lambda i: (len(known[i][1]) // 8, rng.random()))
        runs = [order[i : i + size] for i in range(0, len(order), size)]
        rng.shuffle(runs)
        for run in runs:
            x, mask, y = _batch([known[i] for i in run])
            # Names and words go missing now and then: no single one may decide.
            keep = drop.random((1, x.shape[1], x.shape[2])) > 0.1
            keep[:, :, PATH_BUCKETS:-MEASURES] &= drop.random((1, x.shape[1], 1)) > 0.3
            keep[:, :, -MEASURES:] = True
            yield x * keep, mask, y

    model = BiLstm.new(WIDTH, HIDDEN, np.random.default_rng(seed))
    train(model, batches, rounds)
    return model


def label(model: BiLstm, vectors: Vectors, pages: list[list[Block]]) -> list[np.ndarray]:
    """The probability of each block of each page."""
    out: list[np.ndarray] = [np.empty(0, np.float32)] * len(pages)
    # What a path adds to the gates is worked out once for each path.
    used = sorted({b.path for page in pages for b in page})
    number = {path: i for i, path in enumerate(used)}
    rows = vectors.path_rows(used)
    by_path = [rows @ d[0][:PATH_BUCKETS] + d[2] for d in (model.forward, model.backward)]
    order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
    k = 0
    while k < len(order):
        run = [order[k]]
        k += 1
        while k < len(order) and (len(run) + 1) * len(pages[order[k]]) <= CELLS:
            run.append(order[k])
            k += 1
        steps = len(pages[run[-1]])
        pre = [np.zeros((steps, len(run), 4 * HIDDEN), np.float32) for _ in range(2)]
        mask = np.zeros((steps, len(run)), bool)
        for j, i in enumerate(run):
            n = len(pages[i])
            at, rest = [number[b.path] for b in pages[i]], vectors.rest(pages[i])
            for p, known, d in zip(pre, by_path, (model.forward, model.backward), strict=True):
                p[:n, j] = known[at] + rest @ d[0][PATH_BUCKETS:]
            mask[:n, j] = True
        p = model.probabilities(*pre, mask)
        for j, i in enumerate(run):
            out[i] = p[: len(pages[i]), j]
    return out


SCHEMA = "page_id long, url string, text string, n_chars long, n_blocks long, n_kept long"


def main_text(pages: DataFrame, model: BiLstm | None = None, batch: int = 512) -> DataFrame:
    """``page_id, url``, the main text and its length for each row of ``pages(page_id, url, html)``."""
    spark = pages.sparkSession
    on_workers(spark)
    sent = spark.sparkContext.broadcast(model or labeller())  # its size is fixed

    def go(batches):
        vectors = Vectors()
        for whole in batches:
            for a in range(0, whole.num_rows, batch):
                part = whole.slice(a, batch)
                vectors.trim()
                found = [vectors.parse(x.as_py()) for x in part.column(2)]
                texts, kept = [], []
                for page, p in zip(found, label(sent.value, vectors, found), strict=True):
                    chosen = [b.text for b, q in zip(page, p, strict=True) if q >= 0.5]
                    texts.append("\n".join(chosen))
                    kept.append(len(chosen))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array(map(len, found), pa.int64()), pa.array(kept, pa.int64())],
                    names=[x.split()[0] for x in SCHEMA.split(", ")],
                )

    return pages.selectExpr("cast(page_id as long) page_id", "cast(url as string) url", "html").mapInArrow(go, SCHEMA)
