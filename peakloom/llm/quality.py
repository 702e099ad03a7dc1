"""Quality classifier on supervised subword embeddings.

Words, word pairs and byte 3- and 4-grams (case and white space kept) are hashed into buckets; every bucket has a
learned vector, a document is the average of its vectors, and a softmax layer gives the class. The
model is trained by stochastic gradient descent in numpy on a bounded sample of labelled documents.

For two classes the softmax of an average is the logistic of the average of one number per bucket
(vector times the difference of the class weights), so scoring needs one table of that size: the
tasks receive ``BUCKETS`` floats, look every n-gram up and average. Texts are scored whole, in pieces.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from peakloom.llm.common import stored, text_bytes

BUCKETS = 1 << 18
DIM = 8
#: Bound of the training sample: so many labelled documents, in the order of a hash of their ids.
TRAIN_DOCS = 4_000
#: Bound of its bytes: of those documents, in the same order, the first that hold so many together; none alone holds over a sixteenth.
TRAIN_BYTES = 1 << 28
EPOCHS, RATE, SEED = 4, 0.5, 11
#: 0: documents weigh alike; 1: classes weigh alike.
BALANCE = 1.0
#: Damps the steps of buckets that were seen little.
START = 1e-5
PIECE = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ODD = np.array([0x9E3779B97F4A7C15], np.uint64)
_BASE = 0x100000001B3
_INVERSE = pow(_BASE, -1, 1 << 64)


def _bucket(keys: np.ndarray, salt: int) -> np.ndarray:
    return (((keys + np.uint64(salt)) * _ODD) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def _word_keys(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and polynomial hash of every word, from prefix sums modulo 2**64."""
    space = _SPACE[data]
    edges = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]])))
    begin, end = edges[::2], edges[1::2]
    powers, back = np.full(len(data) + 1, _BASE, np.uint64), np.full(len(data) + 1, _INVERSE, np.uint64)
    powers[0] = back[0] = 1
    powers, back = np.multiply.accumulate(powers), np.multiply.accumulate(back)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:-1], dtype=np.uint64)])
    return begin, (sums[end] - sums[begin]) * back[begin]


def grams(data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(start, bucket) of the 3-grams, the 4-grams, the words and the word pairs of one piece of bytes.

    A pair is keyed by the difference of its words' hashes, so any word after itself is one feature.
    """
    wide = data.astype(np.uint64)
    three = wide[:-2] | wide[1:-1] << np.uint64(8) | wide[2:] << np.uint64(16) if len(data) > 2 else wide[:0]
    yield np.arange(len(three)), _bucket(three, 1 << 40)
    four = three[:-1] | wide[3:] << np.uint64(24)
    yield np.arange(len(four)), _bucket(four, 2 << 40)
    if len(data):
        begin, keys = _word_keys(data)
        # fold: the low bits of a product modulo 2**64 depend on few bits only
        keys ^= keys >> np.uint64(32)
        yield begin, _bucket(keys, 3 << 40)
        yield begin[1:], _bucket(keys[1:] - keys[:-1], 4 << 40)


def pieces(text: bytes) -> Iterator[np.ndarray]:
    """The bytes of a text in pieces of at most ``PIECE``, cut after white space where there is any."""
    at = 0
    while at < len(text):
        end = min(at + PIECE, len(text))
        if end < len(text):
            cut = max(text.rfind(b" ", at, end), text.rfind(b"\n", at, end))
            end = cut + 1 if cut > at else end
        yield np.frombuffer(text, np.uint8, end - at, at)
        at = end


def buckets(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a whole text and their shares."""
    counts: dict[int, int] = {}
    parts = [b for p in pieces(text) for _, b in grams(p)]
    if not parts:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    ids, n = np.unique(np.concatenate(parts), return_counts=True)
    return ids.astype(np.int32), (n / max(1, n.sum())).astype(np.float32)


@dataclass(frozen=True)
class Model:
    """Weight of each bucket and the bias of the log-odds of class 1."""

    weight: np.ndarray
    bias: float

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Probability of class 1; a text without n-grams has only the bias."""
        total, count = np.zeros(len(texts)), np.zeros(len(texts))
        group: list[int] = []
        size = 0
        for i, text in enumerate(texts):
            if len(text) > PIECE:
                for p in pieces(text):
                    for _, b in grams(p):
                        total[i] += self.weight[b].sum(dtype=np.float64)
                        count[i] += len(b)
                continue
            group.append(i)
            size += len(text)
            if size > PIECE // 2:
                self._group(texts, group, total, count)
                group, size = [], 0
        self._group(texts, group, total, count)
        z = self.bias + total / np.maximum(count, 1)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def _group(self, texts: list[bytes], group: list[int], total: np.ndarray, count: np.ndarray) -> None:
        """Several short texts at once, parted by a space; n-grams over a border do not count."""
        group = [i for i in group if texts[i]]
        if not group:
            return
        sizes = np.array([len(texts[i]) for i in group])
        begin = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        data = np.frombuffer(b" ".join([texts[i] for i in group]), np.uint8)
        for (start, b), n in zip(grams(data), (3, 4, 1, None)):
            sums = np.concatenate([[0.0], np.cumsum(self.weight[b], dtype=np.float64)])
            if n is None:  # pairs of neighbours among the words just placed
                last = np.maximum(first, last - 1)
            else:
                first = np.searchsorted(start, begin)
                last = np.searchsorted(start, np.maximum(begin + sizes - n + 1, begin))
            total[group] += sums[last] - sums[first]
            count[group] += last - first


def train(texts: list[bytes], labels: list[int], epochs: int = EPOCHS, rate: float = RATE, dim: int = DIM, seed: int = SEED) -> Model:
    """Stochastic gradient descent over documents; only labels of 0 and 1 come in. No documents: a score of one half."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (BUCKETS, dim)).astype(np.float32)
    weights, bias = np.zeros((2, dim), np.float32), np.zeros(2, np.float32)
    docs = [buckets(t) for t in texts]
    share_of = np.bincount(labels, minlength=2) / max(1, len(labels))
    cost = (1 / np.maximum(2 * share_of, 1e-3)) ** BALANCE
    speed = np.full(BUCKETS, START, np.float32)  # sum of squared steps of each bucket
    for epoch in range(epochs):
        for k, i in enumerate(rng.permutation(len(docs))):
            step = rate * (1 - (epoch + k / len(docs)) / epochs)
            ids, share = docs[i]
            own = vectors[ids]
            mean = share @ own
            z = weights @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            p *= cost[labels[i]]
            back = weights.T @ p
            weights -= step * np.outer(p, mean)
            bias -= step * 0.1 * p
            speed[ids] += share * share * float(back @ back)
            vectors[ids] = own - step * (share / np.sqrt(speed[ids]))[:, None] * back
    return Model((vectors @ (weights[1] - weights[0])).astype(np.float32), float(bias[1] - bias[0]))


def held_out(id_col: str) -> Column:
    """Rows that training never sees."""
    return F.coalesce(F.crc32(F.col(id_col).cast("bigint").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", limit: int = TRAIN_DOCS, most_bytes: int = TRAIN_BYTES) -> Model:
    """Train on at most ``limit`` labelled documents of at most ``most_bytes`` outside the held-out third.

    Labels other than 0 and 1 and null ids do not count; an id with several labels takes the lowest,
    one with several texts the text of the smallest hash. A document of over a sixteenth of ``most_bytes`` is not
    learned from. Null texts count as empty. Without labelled documents every score is about one half. Only
    the sample, a documented bound, reaches the driver.
    """
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("bigint").alias("doc_id")).agg(F.min(label_col).cast("int").alias("y"))
    picked = known.filter(~held_out("doc_id")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_bytes(text_col).alias("t")).filter(F.octet_length("t") <= most_bytes // 16)
    one = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("t").alias("h"), "t"))["t"].alias("t"))
    sample = stored(one.select("t", "y", F.struct(F.xxhash64("doc_id").alias("h"), "doc_id").alias("place"), F.octet_length("t").alias("n")), "labelled-sample")
    # a window over at most ``limit`` rows, without their texts
    first = sample.select("place", F.sum("n").over(Window.orderBy("place")).alias("total")).filter(F.col("total") <= most_bytes).select("place")
    rows = sample.join(first, "place").sort("place").select("t", "y").toArrow()
    return train(rows.column("t").to_pylist(), rows.column("y").to_pylist())


def _scored(model: Model, text_at: int, keep_from: float | None) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.scores(batch.column(text_at).cast(pa.binary()).fill_null(b"").to_pylist())
            if keep_from is not None:
                yield batch.filter(pa.array(scores >= keep_from))
            else:
                cols = [c for i, c in enumerate(batch.columns) if i != text_at]
                names = [n for i, n in enumerate(batch.schema.names) if i != text_at]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(scores)], names=[*names, "score"])

    return run


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row, from the text alone.

    Null and empty texts have the score of the bias. Null or repeated ids pass through; an empty table
    gives no rows; other columns are not read.
    """
    base = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), held_out(id_col).alias("held_out"), text_bytes(text_col).alias("t"))
    out = base.mapInArrow(_scored(model, 2, None), "doc_id bigint, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is at least ``least``, with all their columns, in one pass.

    Null and empty texts are judged by the bias alone; repeated rows and ids are judged one by one; texts of any length are
    scored whole; an empty table gives no rows; other columns pass through under any name.
    """
    return docs.mapInArrow(_scored(model, docs.columns.index(text_col), least), docs.schema)
