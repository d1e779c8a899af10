"""Substring dedup by sliding spans of consecutive sentences.

A sentence ends after a word that ends in . ! or ? (closing quotes and brackets may
follow), at a line break, or after ``PART`` words; so a run-on sentence counts as
several.  From every sentence starts a span, the shortest run of consecutive sentences
with ``min_words`` words, and at every sentence ends one, found likewise backwards; as
min_words is more than PART, a span has two sentences at least.  So each sentence of a
passage of twice that many words, all in whole sentences, lies in a span within the
passage; parts of sentences do not count.  A span's words (A-Z in lower case, white
space left out) give its hash of 128 bits.  Hashes are counted over the whole corpus,
the repeated ones are joined with their places, and each place but the first, by doc_id
and position, marks its sentences; marked sentences are cut out.

Null texts stay null and empty ones empty.  Rows that are equal in id and text are
one document; rows that share an id, or have none, but not the text are told apart and
ordered by 128 bits of hash of it; rows without an id come first.  Texts of any length
are gone through whole.  Other columns are kept, whatever their names and types.  An
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from . import textnum as T
from .common import map_batches, plain_names, scratch, text_keys, written

#: Words of a span at least, and of a sentence at most.
MIN_WORDS, PART = 25, 20
#: Bits of a place: the sentence's number in its text and the span's number of sentences.
_SENTENCE, _LENGTH = 24, 15

_stop = np.zeros(256, bool)
_stop[list(b".!?")] = True
_close = np.zeros(256, bool)
_close[list(b"\"')]}")] = True


class Sentences:
    """Sentences of the texts of one piece, by words."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray):
        self.starts, self.ends, self.bounds = T.words(buf, offs)
        n = len(self.starts)
        last = buf[self.ends - 1] if n else np.zeros(0, np.uint8)
        before = buf[np.maximum(self.ends - 2, self.starts)] if n else last
        ends = _stop[last] | (_close[last] & _stop[before])
        breaks = np.zeros(len(buf) + 1, np.int64)
        np.cumsum(buf == 10, out=breaks[1:])
        if n:
            ends[:-1] |= breaks[self.starts[1:]] > breaks[self.ends[:-1]]
            ends[self.bounds[1:][np.diff(self.bounds) > 0] - 1] = True
            begin = np.r_[0, np.flatnonzero(ends)[:-1] + 1]
            of = np.cumsum(ends) - ends
            ends |= (np.arange(n) - begin[of]) % PART == PART - 1
        #: the words after each sentence's last, and each word's sentence
        self.stop = np.flatnonzero(ends) + 1
        self.start = np.r_[0, self.stop[:-1]] if n else self.stop
        self.of_word = np.cumsum(ends) - ends
        #: where each text's sentences begin among all
        self.first = np.searchsorted(self.start, self.bounds)

    def spans(self, min_words: int) -> tuple[np.ndarray, np.ndarray]:
        """First and last sentences of all spans, each span once."""
        owner = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        low, high = self.bounds[owner], self.bounds[owner + 1]
        k = np.arange(len(self.start))
        on = self.start + min_words <= high
        back = self.stop - min_words >= low
        first = np.r_[k[on], self.of_word[self.stop[back] - min_words]]
        last = np.r_[self.of_word[self.start[on] + min_words - 1], k[back]]
        pair = np.unique(first * np.int64(1 << 31) + last)
        return pair >> 31, pair & ((1 << 31) - 1)


def spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Hash (h1, h2), doc_id, text keys (k1, k2) and place (first sentence and number of sentences) of every span."""

    def run(batches):
        for b in batches:
            out: list[list[np.ndarray]] = [[], [], []]
            for i, _, buf, offs in T.pieces(b.column(3)):
                s = Sentences(buf, offs)
                first, last = s.spans(min_words)
                if not len(first):
                    continue
                words = memoryview(T.word_hashes(buf, s.starts, s.ends, lower=True).tobytes())
                a, e = s.start[first] * 8, s.stop[last] * 8
                h = b"".join([xxhash.xxh3_128_digest(words[x:y]) for x, y in zip(a.tolist(), e.tolist(), strict=True)])
                owner = np.searchsorted(s.first, first, "right") - 1
                out[0].append(np.frombuffer(h, np.int64).reshape(-1, 2))
                out[1].append(owner + i)
                out[2].append((first - s.first[owner]) << _LENGTH | (last - first + 1))
            if out[0]:
                h, row, place = (np.concatenate(x) for x in out)
                of_row = [b.column(k).take(pa.array(row)) for k in range(3)]
                yield pa.RecordBatch.from_arrays([pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), *of_row, pa.array(place)], ["h1", "h2", "doc_id", "k1", "k2", "place"])

    text = F.col("text").cast("string")
    k1, k2 = text_keys(text)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), k1.alias("k1"), k2.alias("k2"), text.alias("text")).where(F.length("text") > 0)
    return map_batches(rows, run, "h1 long, h2 long, doc_id long, k1 long, k2 long, place long")


def repeated_places(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, k1, k2 and places of all spans that stand elsewhere before, by document."""
    with scratch(docs.sparkSession):
        every = written(spans(docs, min_words), "spans")
        counts = every.groupBy("h1", "h2").agg(F.count("*").alias("n"))
        twice = written(counts.where("n > 1").select("h1", "h2"), "repeated")
        # both sides are read from files, so that the many places of one hash can be split over tasks
        places = written(every.join(twice, ["h1", "h2"]), "places")
        order = F.struct("doc_id", "k1", "k2", "place")
        first = written(places.groupBy("h1", "h2").agg(F.min(order).alias("first")), "first")
        later = places.join(first, ["h1", "h2"]).where(~order.eqNullSafe(F.col("first")))
        return written(later.groupBy("doc_id", "k1", "k2").agg(F.collect_set("place").alias("places")), "later", outlive=True)


def _cut(text: np.ndarray, s: Sentences, d: int, places: np.ndarray) -> tuple[bytes, int]:
    """The text without the sentences that the places cover, and how many these are."""
    lo, hi = s.first[d], s.first[d + 1]
    step = np.zeros(hi - lo + 1, np.int64)
    at = places >> _LENGTH
    np.add.at(step, at, 1)
    np.add.at(step, at + (places & ((1 << _LENGTH) - 1)), -1)
    gone = np.cumsum(step[:-1]) > 0
    begins = s.starts[s.start[lo:hi]]
    stops = np.r_[begins[1:], len(text)]
    head = text[: begins[0]] if len(begins) else text
    return b"".join([head.tobytes(), *(text[a:e].tobytes() for a, e, g in zip(begins, stops, gone, strict=True) if not g)]), int(gone.sum())


def dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Every row of docs as struct ``doc`` with its text cut, n_sentences (before) and n_removed."""
    gone = repeated_places(docs, min_words)
    rows, doc_id, text = plain_names(docs)
    k1, k2 = text_keys(F.col(text).cast("string"))
    # null-safe equality is a join key as well; what is cut grows with the corpus, so it is not broadcast
    same = F.col(doc_id).cast("long").eqNullSafe(F.col("doc_id")) & (k1 == F.col("k1")) & (k2 == F.col("k2"))
    joined = rows.join(gone, same, "left").select(*rows.columns, "places")
    width, at = len(rows.columns), rows.columns.index(text)

    def run(batches):
        for b in batches:
            column = b.column(at).cast(pa.large_string())
            places = b.column(width)
            texts, total, removed = column.to_pylist(), np.zeros(len(column), np.int64), np.zeros(len(column), np.int64)
            for i, j, buf, offs in T.pieces(column):
                s = Sentences(buf, offs)
                total[i:j] = np.diff(s.first)
                for d in range(j - i):
                    if places[i + d].is_valid:
                        # borders are counted from the piece's first byte
                        one = buf[offs[d] : offs[d + 1]]
                        own = Sentences(one, np.array([0, len(one)]))
                        cut, n = _cut(one, own, 0, np.array(places[i + d].as_py(), np.int64))
                        texts[i + d], removed[i + d] = cut.decode("utf-8"), n
            cols = [b.column(k) for k in range(width)]
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*cols, pa.array(total), pa.array(removed)], [*b.schema.names[:width], "n_sentences", "n_removed"])

    fields = [StructField(f.name, StringType() if f.name == text else f.dataType) for f in rows.schema.fields]
    cut = map_batches(joined, run, StructType([*fields, StructField("n_sentences", LongType()), StructField("n_removed", LongType())]))
    return cut.select(F.struct(*[F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)]).alias("doc"), "n_sentences", "n_removed")


def cleaned(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of docs, with all their columns and their texts cut, without those of which nothing is left."""
    found = dedup(docs, min_words).where("n_removed = 0 or n_removed < n_sentences")
    return found.select("doc.*")
