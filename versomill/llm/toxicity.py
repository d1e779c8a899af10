"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A text is the bag of the character n-grams (as bytes, lower case, with a mark at
word borders) of all its words.  Each n-gram's bucket has an embedding; the text is
their mean; a linear softmax over the two classes reads it.  Embeddings and softmax are
trained together in numpy on a bounded sample of labelled rows.  A misspelling that was
never seen shares most n-grams with the word it is made from.

Bags are made on the executors; the driver gets buckets and counts, never texts.  With
two classes the softmax sees an embedding only along one direction, so a gradient is
that direction times one number an n-gram: a step costs the same at any width.

For scoring the softmax is folded into the embeddings: one weight a bucket, so a
text's logit is a mean of weights over its n-grams, computed over the whole text.

Null and empty texts have no n-grams; their score is the share of toxic rows among
the labelled ones, as learned by the bias.  Texts of any length are scored whole.  Rows
are scored one by one, so repeated rows and ids do not matter; of labelled rows that
share an id the smallest text is learned from.  Only doc_id and text are read, and
``accepted`` keeps all other columns, whatever their names and types.  Without labels of
both kinds every score is that share (0 if nothing is labelled).  An empty table gives
an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textnum as T
from .common import documents, map_batches, plain_names, sampled_labels, scratch, written

#: Lengths of n-grams in bytes, marks included; log2 of the buckets; size of an embedding.
GRAMS, BITS, DIM = (4, 5, 6, 7), 18, 16
#: Texts that an n-gram must be in, or it would only be learned by heart.
LEAST = 8
#: Labelled rows that the model is fitted on at most, distinct n-grams of all of them together at most (documented
#: bounds: 4 bytes and 2 more each on the driver), and passes over them.
SAMPLE, ENTRIES, EPOCHS = 4000, 16_000_000, 40

_rng = np.random.default_rng(99)
_CHAR = _rng.integers(1, 2**31, 256, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_STEP = np.uint32(0x01000193)


def _border_buffer(column: pa.Array) -> pa.Array:
    """Every text with a space before and after it, so that its first and last words have their marks."""
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    return pc.binary_join_element_wise(pa.scalar("", pa.large_string()), column, pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string()))


def gram_buckets(buf: np.ndarray):
    """For each length: buckets of the n-grams that start at each byte, and whether there is one inside a word (or with a mark at its border)."""
    n = len(buf)
    space = ~T.SPACED[buf]
    low = T.LOWER[buf]
    low[space] = 32
    code = _CHAR[low]
    before = np.zeros(n + 1, np.int32)
    np.cumsum(space, out=before[1:])
    h = np.zeros(n, np.uint32)
    power = np.uint32(1)
    for k in range(1, max(GRAMS) + 1):
        if k > n:
            return
        m = n - k + 1
        h = h[:m] + code[k - 1 :] * power
        power = np.uint32((int(power) * int(_STEP)) & 0xFFFFFFFF)
        if k in GRAMS:
            mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D + 2 * k)
            mixed ^= mixed >> np.uint32(13)
            mixed *= np.uint32(0x297A2D39)
            # no space but at the ends
            inside = before[k - 1 : k - 1 + m] == before[1 : 1 + m]
            yield k, mixed >> np.uint32(32 - BITS), inside


def text_bags(column: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """For each text its distinct buckets and how often each stands, and the number of all its n-grams."""
    buckets, counts, total = [], [], np.zeros(len(column), np.int64)
    for i, j, buf, offs in T.pieces(_border_buffer(column), 1 << 19):
        parts: list[list[np.ndarray]] = [[] for _ in range(j - i)]
        for _, bucket, inside in gram_buckets(buf):
            at = np.flatnonzero(inside)
            found = bucket[at].astype(np.int32)
            cut = np.searchsorted(at, offs)
            for d in range(j - i):
                parts[d].append(found[cut[d] : cut[d + 1]])
        for d in range(j - i):
            b, n = np.unique(np.concatenate(parts[d]) if parts[d] else np.zeros(0, np.int32), return_counts=True)
            buckets.append(b)
            counts.append(n.astype(np.float32))
            total[i + d] = n.sum()
    return buckets, counts, total


@dataclass
class Model:
    weight: np.ndarray  # the embeddings folded with the softmax: one number a bucket
    bias: float
    buckets: np.ndarray | None = None  # those that have embeddings, and what was trained
    embeddings: np.ndarray | None = None
    softmax: np.ndarray | None = None

    def folded(self) -> Model:
        """What scoring needs."""
        return Model(self.weight, self.bias)

    def score(self, column: pa.Array) -> np.ndarray:
        out = np.zeros(len(column))
        for i, j, buf, offs in T.pieces(_border_buffer(column), 1 << 19):
            total, count = np.zeros(j - i), np.zeros(j - i, np.int64)
            for _, bucket, inside in gram_buckets(buf):
                w = self.weight[bucket]
                w *= inside
                sums = np.zeros(len(w) + 1)
                np.cumsum(w, out=sums[1:], dtype=np.float64)
                ends = np.minimum(offs, len(w))
                total += sums[ends[1:]] - sums[ends[:-1]]
                counts = np.zeros(len(w) + 1, np.int64)
                np.cumsum(inside, out=counts[1:])
                count += counts[ends[1:]] - counts[ends[:-1]]
            out[i:j] = total / np.maximum(count, 1)
        return 1 / (1 + np.exp(-np.clip(out + self.bias, -60, 60)))


class _Rows:
    """Texts' n-grams, as counts over a text's number, gone through in blocks so that temporary arrays stay small."""

    def __init__(self, column: np.ndarray, count: np.ndarray, ends: np.ndarray, total: np.ndarray, width: int, block: int = 1 << 20):
        self.column, self.count, self.ends, self.width, self.n = column, count, ends, width, len(ends)
        self.share = 1 / np.maximum(total, 1)
        starts = np.r_[0, ends[:-1]].astype(np.int64)
        self.blocks, i = [], 0
        while i < self.n:
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + block, "right")))
            self.blocks.append((slice(i, j), slice(int(starts[i]), int(ends[j - 1])), np.diff(np.r_[starts[i:j], ends[j - 1]])))
            i = j

    def times(self, x: np.ndarray) -> np.ndarray:
        """Each text's mean of x over its n-grams."""
        out = np.zeros(self.n)
        for rows, at, lengths in self.blocks:
            out[rows] = np.bincount(np.repeat(np.arange(len(lengths)), lengths), x[self.column[at]] * self.count[at], len(lengths))
        return out * self.share

    def turned(self, y: np.ndarray, power: int = 1) -> np.ndarray:
        """Each n-gram's sum over texts of y times its share of them, to a power."""
        out = np.zeros(self.width)
        y = y * self.share**power
        for rows, at, lengths in self.blocks:
            out += np.bincount(self.column[at], np.repeat(y[rows], lengths) * self.count[at].astype(np.float64) ** power, self.width)
        return out

    def only(self, kept: np.ndarray) -> _Rows:
        """The same without n-grams that are not kept."""
        mine = kept[self.column]
        number = (np.cumsum(kept) - 1).astype(np.int32)
        ends = np.r_[0, np.cumsum(mine)][self.ends]
        return _Rows(number[self.column[mine]], self.count[mine], ends, 1 / self.share, int(kept.sum()))


def _descend(rows: _Rows, weight: np.ndarray, y: np.ndarray, params: list[np.ndarray], epochs: int, rate: float, sparse: float) -> list[np.ndarray]:
    """Gradient descent with momentum on embeddings, softmax and bias, over all texts at once.

    Texts are means of embeddings, and both classes' errors are one another's negative;
    so logits need the embeddings' share along the softmax's difference only, and the
    embeddings' gradient lies along it.  ``sparse`` is a penalty on the length of each
    embedding: one that explains less than that is set to nought after each step.
    """
    emb, out, bias = params
    speed = [np.zeros_like(x) for x in params]
    for _ in range(epochs):
        along = out[:, 1] - out[:, 0]
        p = 1 / (1 + np.exp(-np.clip(rows.times((emb @ along) * weight) + bias[1] - bias[0], -60, 60)))
        error = (p - y) / rows.n
        pull = (rows.turned(error) * weight).astype(np.float32)  # one number an n-gram
        mean = emb.T @ pull  # the texts' means, weighed by their errors
        speed[0] *= 0.8
        speed[0] -= np.outer(np.float32(rate) * pull, along)
        emb += speed[0]
        if sparse:
            length = np.sqrt(np.einsum("ij,ij->i", emb, emb))
            emb *= np.maximum(0, 1 - rate * sparse / np.maximum(length, 1e-12)).astype(np.float32)[:, None]
        speed[1] = 0.8 * speed[1] - 0.1 * (np.column_stack([-mean, mean]) + 1e-4 * out)
        speed[2] = 0.8 * speed[2] - 0.1 * np.array([-error.sum(), error.sum()])
        out, bias = (out + speed[1]).astype(np.float32), bias + speed[2]
    return [emb, out, bias]


def train(column: np.ndarray, count: np.ndarray, ends: np.ndarray, total: np.ndarray, label: np.ndarray, least: int = LEAST, epochs: int = EPOCHS, rate: float = 60.0, sparse: float = 0.2, dim: int = DIM, seed: int = 5) -> Model:
    """Embeddings and softmax trained together on texts as bags.

    ``column`` has each text's distinct buckets one behind the other (it is overwritten),
    ``count`` how often each stands, ``ends`` where each text's end, and ``total`` all
    n-grams of each.  Each n-gram's share of a text is divided by its root mean square over
    the texts, so that rare and common ones count alike.  A first descent with a penalty on
    embeddings finds the n-grams that matter; a second one without it trains these.
    """
    size, n, block = 1 << BITS, len(label), 1 << 20
    toxic = label > 0
    share = float(toxic.mean()) if n else 0.0
    prior = float(np.log((share + 1e-6) / (1 - share + 1e-6)))
    if not n or toxic.all() or not toxic.any():
        return Model(np.zeros(size, np.float32), prior)
    texts_of = np.zeros(size, np.int64)
    for i in range(0, len(column), block):
        texts_of += np.bincount(column[i : i + block], minlength=size)
    used = np.flatnonzero(texts_of >= least)
    if not len(used):
        return Model(np.zeros(size, np.float32), prior)
    # what is left out shares one last column, whose weight is nought
    place = np.full(size, len(used), np.int32)
    place[used] = np.arange(len(used))
    for i in range(0, len(column), block):
        column[i : i + block] = place[column[i : i + block]]
    rows = _Rows(column, count, ends, total, len(used) + 1)
    unit = 1 / np.sqrt(len(used))
    weight = np.zeros(len(used) + 1, np.float32)
    weight[:-1] = unit / np.sqrt(rows.turned(np.ones(n), 2)[:-1] / n)
    # directions at random, scaled so that the width does not change the steps along the difference
    rng = np.random.default_rng(seed)
    out = rng.standard_normal((dim, 2)).astype(np.float32)
    out *= 1.0 / max(float(np.linalg.norm(out[:, 1] - out[:, 0])), 1e-9)
    y = toxic.astype(np.float64)
    params = [np.zeros((len(used) + 1, dim), np.float32), out, np.array([-prior / 2, prior / 2])]
    params = _descend(rows, weight, y, params, epochs, rate, sparse * unit)
    active = (params[0] != 0).any(1)
    rows = rows.only(active)
    used, weight, params[0] = used[active[:-1]], weight[active], params[0][active]
    if len(used):
        params = _descend(rows, weight, y, params, 20 * epochs, 4 * rate, 0.0)
    emb, out, bias = params
    emb = emb * weight[:, None]
    folded = np.zeros(size, np.float32)
    folded[used] = emb @ (out[:, 1] - out[:, 0])
    return Model(folded, float(bias[1] - bias[0]), used, emb, out)


def labelled_bags(docs: DataFrame, labels: DataFrame, sample: int, keep: Column | None) -> DataFrame:
    """doc_id, label, total, size, and buckets and counts as bytes, of one text for each id of the sample."""
    chosen = sampled_labels(labels, "toxic", sample, keep)
    rows = documents(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))

    def run(batches):
        for b in batches:
            buckets, counts, total = text_bags(b.column(2))
            made = [pa.array(total), pa.array([len(x) for x in buckets], pa.int64()), pa.array([x.tobytes() for x in buckets], pa.binary()), pa.array([np.minimum(x, 65535).astype(np.uint16).tobytes() for x in counts], pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *made], ["doc_id", "label", "total", "size", "buckets", "counts"])

    return map_batches(rows, run, "doc_id long, label int, total long, size long, buckets binary, counts binary")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, keep: Column | None = None, entries: int = ENTRIES) -> Model:
    """The model from at most about ``sample`` labelled rows with ``entries`` distinct n-grams together; ``keep`` says which ids may be learned from."""
    with scratch(docs.sparkSession):
        bags = written(labelled_bags(docs, labels, sample, keep), "bags")
        sizes = sorted((r["h"], r["doc_id"], r["size"], r["label"], r["total"]) for r in bags.select(F.xxhash64("doc_id").alias("h"), "doc_id", "size", "label", "total").collect())  # as many rows as the sample
        fit_in = np.cumsum([x[2] for x in sizes]) <= entries
        chosen = sorted((doc_id, n, y, t) for (_, doc_id, n, y, t), ok in zip(sizes, fit_in, strict=True) if ok)  # in the order of a hash as many as the bound allows, then by id
        ends = np.cumsum([n for _, n, _, _ in chosen], dtype=np.int64)
        place = {doc_id: (int(e) - n, int(e)) for (doc_id, n, _, _), e in zip(chosen, ends, strict=True)}
        column, count = np.empty(ends[-1] if len(ends) else 0, np.int32), np.empty(ends[-1] if len(ends) else 0, np.uint16)
        for doc_id, buckets, counts in bags.select("doc_id", "buckets", "counts").toLocalIterator():  # a partition at a time
            if doc_id in place:
                low, high = place[doc_id]
                column[low:high], count[low:high] = np.frombuffer(buckets, np.int32), np.frombuffer(counts, np.uint16)
    return train(column, count, ends, np.array([t for *_, t in chosen], np.int64), np.array([y for _, _, y, _ in chosen], np.int64))


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """doc_id, score and predicted of every row."""
    docs = documents(docs)
    shipped = docs.sparkSession.sparkContext.broadcast(model.folded())  # a megabyte

    def run(batches):
        m = shipped.value
        for b in batches:
            s = m.score(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return map_batches(docs, run, "doc_id long, score double, predicted int")


def accepted(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows of docs, with all their columns, that score below the threshold."""
    shipped = docs.sparkSession.sparkContext.broadcast(model.folded())
    rows, _, text = plain_names(docs)
    at = rows.columns.index(text)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(shipped.value.score(b.column(at).cast(pa.string())) < threshold))

    return map_batches(rows, run, rows.schema).toDF(*docs.columns)
