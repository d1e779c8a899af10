"""Quality rules and an isolation forest over their statistics.

``rule_stats`` measures each whole text, once.  Every row with a label takes part in
the fit, however many there are: trees of random splits over the range of all of them
count one half of the good rows (by a hash of the id) in their nodes, and from these
counts comes the expected path length that tells how easily a document is isolated.
The threshold on that anomaly score is calibrated on the other half and all bad rows:
of all thresholds that keep at least ``keep_good`` of these good rows, those that reject
most bad rows, and of these the highest.  Only ranges, node counts and order statistics
go to the driver; their size does not grow with the rows.  The statistics are written
below ``spark.checkpoint.dir`` and stay there, as the result reads them.

Equal lines and windows are found by hashes and then compared byte by byte.  Null and
empty texts have no words and fail the base rule; texts of any length are measured
whole.  Rows with the same id, and repeated rows, are judged, and if labelled counted,
each by its own text.
Only doc_id, text and the labels are read, so other columns may have any names.  An
empty table gives an empty result; without labels of both kinds the forest rejects
nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum as T
from .common import documents, label_rows, map_batches, scratch, written

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_distinct")
SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Scores that the driver sorts at once.
AT_ONCE = 1 << 16

_symbol = np.zeros(256, bool)
_symbol[list(SYMBOLS)] = True
_upper = np.zeros(256, bool)
_upper[65:91] = True
_mark = np.zeros(256, bool)
_mark[33:127] = True
_mark[48:58] = _mark[65:91] = _mark[97:123] = False


def _repeats(keys: np.ndarray, same_bytes: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(is it an earlier key's equal, does any equal key exist), in the keys' order.

    ``same_bytes(a, b)`` compares what the keys a and b stand for; where hashes are
    equal and these are not, the group is told apart one by one.
    """
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    same = np.zeros(len(s) + 1, bool)
    if len(s) > 1:
        same[1:-1] = s[1:] == s[:-1]
        at = np.flatnonzero(same[:-1])
        wrong = at[~same_bytes(order[at], order[at - 1])]
        if len(wrong):
            order, same = _told_apart(order, same, wrong, same_bytes)
    later, any_ = np.zeros(len(s), bool), np.zeros(len(s), bool)
    later[order] = same[:-1]
    any_[order] = same[:-1] | same[1:]
    return later, any_


def _told_apart(order: np.ndarray, same: np.ndarray, wrong: np.ndarray, same_bytes) -> tuple[np.ndarray, np.ndarray]:
    """The order and its marks with groups of equal hashes and unequal bytes split into runs of equal ones."""
    order, same, done = order.copy(), same.copy(), -1
    for w in wrong.tolist():
        if w <= done:
            continue
        low = w
        while same[low]:
            low -= 1
        high = w + 1
        while same[high]:
            high += 1
        runs: list[list[int]] = []
        for k in order[low:high].tolist():
            run = next((r for r in runs if same_bytes(np.array([r[0]]), np.array([k]))[0]), None)
            runs.append([k]) if run is None else run.append(k)
        order[low:high] = [k for r in runs for k in r]
        same[low:high] = [n > 0 for r in runs for n in range(len(r))]
        done = high - 1
    return order, same


def rule_stats(column: pa.Array) -> np.ndarray:
    """One row of STATS for each text."""
    out = np.zeros((len(column), len(STATS)), np.int64)
    for i, j, buf, offs in T.pieces(column):
        n, o = j - i, out[i:j]
        starts, ends, bounds = T.words(buf, offs)
        o[:, 0] = np.diff(bounds)
        spaced = T.SPACED[buf]
        o[:, 1] = T.per_text(spaced & ((buf & 0xC0) != 0x80), offs)
        o[:, 2] = T.per_text(_symbol[buf], offs)
        o[:, 6] = T.per_text(_upper[buf], offs)
        o[:, 7] = T.per_text(_mark[buf], offs)
        ranges = T.Ranges(buf, lower=False)
        salt = T.mix(np.arange(1, n + 1, dtype=np.uint64))

        # lines with a word: by the line that each word lies in
        breaks = np.flatnonzero(buf == 10)
        line_starts = np.union1d(offs[:-1][np.diff(offs) > 0], breaks + 1)
        line_starts = line_starts[line_starts < len(buf)]
        line_ends = np.append(line_starts[1:], len(buf))[: len(line_starts)]
        line_ends = line_ends - ((line_ends > line_starts) & (buf[line_ends - 1] == 10)) if len(buf) else line_ends[:0]
        # a text's last line break may be the last byte before the next text
        has = np.zeros(len(line_starts), bool)
        has[np.searchsorted(line_starts, starts, "right") - 1] = True
        ls, le = line_starts[has], line_ends[has]
        owner = np.searchsorted(offs, ls, "right") - 1
        later, _ = _repeats(ranges.of(ls, le) ^ salt[owner], lambda a, b: (owner[a] == owner[b]) & ranges.same_bytes(ls[a], le[a], ls[b], le[b]))
        o[:, 3] = np.bincount(owner, later, n).astype(np.int64)
        o[:, 5] = np.bincount(owner, minlength=n)

        h = ranges.of(starts, ends)
        of_word = T.owners(bounds)

        def same_word(a, b):
            return ranges.same_bytes(starts[a], ends[a], starts[b], ends[b])

        later, _ = _repeats(h ^ salt[of_word], lambda a, b: (of_word[a] == of_word[b]) & same_word(a, b))
        o[:, 8] = o[:, 0] - np.bincount(of_word, later, n).astype(np.int64)
        g = T.shingles(h, 3)
        inside = of_word[: len(g)] == of_word[2:] if len(g) else np.zeros(0, bool)
        at = np.flatnonzero(inside)
        _, any_ = _repeats(g[at] ^ salt[of_word[at]], lambda a, b: (of_word[at[a]] == of_word[at[b]]) & same_word(at[a], at[b]) & same_word(at[a] + 1, at[b] + 1) & same_word(at[a] + 2, at[b] + 2))
        step = np.zeros(len(h) + 1, np.int64)
        np.add.at(step, at[any_], 1)
        np.add.at(step, at[any_] + 3, -1)
        o[:, 4] = np.bincount(of_word[np.cumsum(step[:-1]) > 0], minlength=n) if len(h) else 0
    return out


def features(stats: np.ndarray) -> np.ndarray:
    """Logarithms of ratios, so that neither a text's length alone nor one extreme row, which widens the range of all splits, matters much."""
    x = stats.astype(np.float64)
    w, c, lines = np.maximum(x[:, 0], 1), np.maximum(x[:, 1], 1), np.maximum(x[:, 5], 1)
    return np.log(np.column_stack([x[:, 1] / w, x[:, 2] / w, x[:, 3] / lines, x[:, 4] / w, x[:, 6] / c, x[:, 7] / c, x[:, 7] / w]) + 0.01)


def base_failed(stats: np.ndarray) -> np.ndarray:
    return (stats[:, 0] < MIN_WORDS) | (100 * stats[:, 4] > MAX_REPEAT_PERCENT * stats[:, 0])


@dataclass
class Forest:
    """Complete binary trees, node k's children 2k + 1 and 2k + 2: split features and values of inner nodes, path lengths of leaves."""

    feature: np.ndarray
    value: np.ndarray
    path: np.ndarray
    norm: float = 1.0
    threshold: float = 2.0

    def leaves(self, x: np.ndarray, tree: int) -> np.ndarray:
        rows, at = np.arange(len(x)), np.zeros(len(x), np.int64)
        inner = self.feature.shape[1]
        for _ in range((inner + 1).bit_length() - 1):
            at = 2 * at + 1 + (x[rows, self.feature[tree][at]] >= self.value[tree][at])
        return at - inner

    def counts(self, x: np.ndarray) -> np.ndarray:
        """Rows of x in each tree's leaves."""
        return np.array([np.bincount(self.leaves(x, t), minlength=self.path.shape[1]) for t in range(len(self.path))], np.int64)

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; near 1: isolated after few splits."""
        total = np.zeros(len(x))
        for t in range(len(self.path)):
            total += self.path[t][self.leaves(x, t)]
        return np.power(2.0, -total / max(1, len(self.path)) / self.norm)


def _mean_path(n: int) -> float:
    """Mean path of an unsuccessful search in a binary tree of n rows."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def random_splits(low: np.ndarray, high: np.ndarray, n: int, trees: int = 128, rows: int = 256, seed: int = 11) -> Forest:
    """Trees without path lengths, for n rows to be counted.

    Split values come from the node's box within [low, high], the range of all
    labelled rows, rather than from the counted rows: what lies outside their range is
    then cut off near the root, and the counts of any parts of the rows add up.
    """
    rng = np.random.default_rng(seed)
    depth = max(1, int(np.ceil(np.log2(max(2, min(rows, n))))) + 4)
    feature, value = np.zeros((trees, 2**depth - 1), np.int8), np.full((trees, 2**depth - 1), np.inf)
    for t in range(trees):
        lo, hi = low[None].astype(np.float64), high[None].astype(np.float64)
        for d in range(depth):
            k, can = np.arange(2**d), hi > lo
            f = np.where(can, rng.random(can.shape), -1.0).argmax(1)
            v = lo[k, f] + (hi[k, f] - lo[k, f]) * rng.random(len(k))
            level = slice(2**d - 1, 2 ** (d + 1) - 1)
            feature[t, level], value[t, level] = f, np.where(can.any(1), v, np.inf)  # a box of one point is not split
            lo, hi = np.repeat(lo, 2, 0), np.repeat(hi, 2, 0)
            hi[2 * k, f] = lo[2 * k + 1, f] = v
    return Forest(feature, value, np.zeros((trees, 2**depth)))


def with_paths(forest: Forest, counts: np.ndarray, rows: int = 256) -> Forest:
    """The forest with path lengths from the leaves' counts of all rows.

    A tree of an isolation forest counts ``rows`` random rows and goes on where it has
    two or more.  Here no rows are drawn: a node that holds the share p of all rows is
    gone through with the chance that a draw of so many has two or more in it, which
    gives the mean of the path lengths over all draws.
    """
    n = int(counts[0].sum())
    drawn, depth = min(rows, n), counts.shape[1].bit_length() - 1
    forest.path = np.zeros(counts.shape)
    for d in range(depth):
        p = counts.reshape(len(counts), 2**d, -1).sum(2) / n
        forest.path += np.repeat(1 - (1 - p) ** drawn - drawn * p * (1 - p) ** (drawn - 1), 2 ** (depth - d), 1)
    # of the rows left in a leaf, by their number's binomial distribution at shares between which there is little change
    k, shares = np.arange(drawn + 1), (np.arange(1, 2048) / 2048) ** 3
    choose = np.append(0.0, np.cumsum(np.log(drawn - k[:-1]) - np.log(k[1:])))
    chance = np.exp(choose + k * np.log(shares)[:, None] + (drawn - k) * np.log1p(-shares)[:, None])
    rest = np.array([_mean_path(m) for m in k])
    forest.path += np.interp(counts / n, np.concatenate([[0.0], shares, [1.0]]), np.concatenate([[0.0], chance @ rest, rest[-1:]]))
    forest.norm = max(_mean_path(drawn), 1e-9)
    return forest


def fit_forest(x: np.ndarray, low: np.ndarray, high: np.ndarray, trees: int = 128, rows: int = 256, seed: int = 11) -> Forest:
    """Trees that count all rows of x."""
    forest = random_splits(low, high, len(x), trees, rows, seed)
    return with_paths(forest, forest.counts(x), rows)


def calibrated(forest: Forest, x: np.ndarray, good: np.ndarray, keep_good: float) -> float:
    """Largest anomaly score that is still accepted, from rows that the forest was not grown on."""
    if good.all() or not good.any():
        return 2.0
    s = forest.score(x)
    least = np.quantile(s[good], keep_good)
    bad = s[~good & (s > least)]  # what the lowest admissible threshold rejects
    return float(np.nextafter(bad.min(), 0)) if len(bad) else float(s.max())


_SCHEMA = ", ".join(f"{c} long" for c in STATS)
_FEATURES = [f"x{k}" for k in range(7)]


def with_stats(docs: DataFrame) -> DataFrame:
    """doc_id and STATS of every row."""

    def run(batches):
        for b in batches:
            s = rule_stats(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0)] + [pa.array(s[:, k]) for k in range(len(STATS))], ["doc_id", *STATS])

    return map_batches(documents(docs), run, f"doc_id long, {_SCHEMA}")


def _matrix(b: pa.RecordBatch, names: list[str] | tuple[str, ...]) -> np.ndarray:
    return np.column_stack([b.column(c).to_numpy(zero_copy_only=False) for c in names])


def with_features(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """good, apart and the features of every labelled row that the base rule leaves."""
    largest = label_rows(labels, "quality").groupBy("doc_id").agg(F.max("label").alias("label"))
    good, other = F.col("label") > 0, F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1
    rows = stats.join(largest, "doc_id").select(good.alias("good"), (~good | other).alias("apart"), *STATS)

    def run(batches):
        for b in batches:
            s = _matrix(b, STATS)
            ok = ~base_failed(s)
            x = features(s[ok])
            keep = pa.array(ok)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)] + [pa.array(c) for c in x.T], ["good", "apart", *_FEATURES])

    return map_batches(rows, run, "good boolean, apart boolean, " + ", ".join(f"{c} double" for c in _FEATURES))


def counted(rows: DataFrame, forest: Forest) -> np.ndarray:
    """Rows in each tree's leaves; a partition sends its sums, at most a number a leaf."""
    shipped = rows.sparkSession.sparkContext.broadcast(forest)

    def run(batches):
        f = shipped.value
        sums = np.zeros(f.path.shape, np.int64)
        for b in batches:
            if b.num_rows:
                sums += f.counts(_matrix(b, _FEATURES))
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums.ravel()[at])], ["leaf", "n"])

    found = map_batches(rows, run, "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(forest.path.size, np.int64)
    total[found["leaf"].to_numpy()] = found["n"].to_numpy()
    return total.reshape(forest.path.shape)


def _value_at(rows: DataFrame, size: int, n: int) -> float:
    """The score that has n of the ``size`` scores before it in ascending order.

    While there are too many to be sorted at once, those that share 16 more bits with it
    are looked for; positive numbers sort as their bits do.
    """
    part = 0
    for shift in (48, 32, 16, 0):
        if size <= AT_ONCE:
            return float(np.sort(rows.select("score").toArrow()["score"].to_numpy())[n])
        for part, size in sorted(tuple(r) for r in rows.groupBy(F.shiftright("bits", shift)).count().collect()):
            if n < size:
                break
            n -= size
        rows = rows.where(F.shiftright("bits", shift) == part)
    return float(np.array(part, np.int64).view(np.float64))


def calibrated_rows(forest: Forest, rows: DataFrame, keep_good: float) -> float:
    """What ``calibrated`` gives, for rows of both kinds."""
    shipped = rows.sparkSession.sparkContext.broadcast(forest)

    def run(batches):
        for b in batches:
            s = shipped.value.score(_matrix(b, _FEATURES)) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column("good"), pa.array(s), pa.array(s.view(np.int64))], ["good", "score", "bits"])

    scored = written(map_batches(rows, run, "good boolean, score double, bits long"), "rule-scores")
    accepted = scored.where("good")
    n = accepted.count()
    at = keep_good * (n - 1)
    below, above = (_value_at(accepted, n, k) for k in (int(at), min(int(at) + 1, n - 1)))
    least = float(np.quantile([below, above], at - int(at)))
    bad, top = scored.agg(F.min(F.when(~F.col("good") & (F.col("score") > least), F.col("score"))), F.max("score")).collect()[0]
    return float(np.nextafter(bad, 0)) if bad is not None else top


def fit(stats: DataFrame, labels: DataFrame, keep_good: float = 0.995) -> Forest | None:
    """Forest and threshold from all labelled rows; ``stats`` and what is written here are read several times."""
    rows = written(with_features(stats, labels), "rule-features")
    grown = rows.where("good and not apart")
    ends = [f(c) for f in (F.min, F.max) for c in _FEATURES]
    n, n_bad, n_grown, *ends = rows.agg(F.count("*"), F.count_if(~F.col("good")), F.count_if(F.col("good") & ~F.col("apart")), *ends).collect()[0]
    if n < 8 or not n_bad or not n_grown or n_bad + n_grown == n:
        return None
    low, high = np.array(ends).reshape(2, -1)
    forest = random_splits(low, high, n_grown)
    forest = with_paths(forest, counted(grown, forest))
    forest.threshold = calibrated_rows(forest, rows.where("apart"), keep_good)
    return forest


def judge(stats: DataFrame, forest: Forest | None) -> DataFrame:
    """Statistics, anomaly score and verdict for every row."""
    shipped = stats.sparkSession.sparkContext.broadcast(forest)  # 128 trees of up to 4,096 leaves

    def run(batches):
        f = shipped.value
        for b in batches:
            s = _matrix(b, STATS)
            failed = base_failed(s)
            score = f.score(features(s)) if f is not None and len(s) else np.zeros(len(s))
            kept = ~failed & (score <= f.threshold if f is not None else True)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(failed), pa.array(score), pa.array(kept)], [*b.schema.names, "base_failed", "anomaly", "kept"])

    return map_batches(stats, run, f"doc_id long, {_SCHEMA}, base_failed boolean, anomaly double, kept boolean")


def quality(docs: DataFrame, labels: DataFrame, keep_good: float = 0.995) -> DataFrame:
    with scratch(docs.sparkSession):
        stats = written(with_stats(docs), "rule-stats", outlive=True)
        return judge(stats, fit(stats, labels, keep_good))
