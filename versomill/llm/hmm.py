"""LM scoring by a hidden Markov model over words.

Each state emits a word class and, within the class, a word.  The most frequent words
are classes of their own; all others fall into hash buckets, where a word's share is
(its count + 1) / (the bucket's count + its distinct words + 1).  So the counts of
all training words matter, however many there are, while what a state holds is bounded.

1. Words of training rows are counted over the whole corpus.
2. Every row is turned into class ids; a word among the broadcast frequent ones
   brings its count along, others are kept with the row.
3. Baum-Welch: each partition adds up expected counts of starts, transitions and
   emissions over its whole training rows, the sums over partitions give the next model.
   Rows go through it in stretches of STRETCH tokens side by side; each stretch's
   transfer matrix carries the forward and backward messages over its borders, so the
   counts are those of the whole row.
4. The scaled forward recursion gives each row's exact likelihood; the rest of the
   words' counts come by a join.

The base score is an add-one unigram model.  A row's tokens are its words and an end;
null and empty texts have the end alone; texts of any length are learned from and scored
whole.  Rows are scored one by one, so repeated rows, ids and rows without an id do not
matter.  How the rows are dealt over partitions changes the order of sums only.  Only
doc_id and text (and what ``train_where`` reads) are used, so other columns may have any
names.  Without training rows every word is unknown and the states are uniform; an empty
table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum as T
from .common import documents, map_batches, written

#: States; words with a class of their own; buckets of the others; frequent words that are broadcast at most.
STATES, OWN, BUCKETS, FREQUENT = 8, 4096, 256, 1 << 18
CLASSES = OWN + BUCKETS + 1
END = CLASSES - 1
#: Rounds of Baum-Welch; tokens of the stretches that go side by side, and about so many tokens at a time.
ROUNDS, STRETCH, TOGETHER = 3, 64, 1 << 18


def _bucket(h: np.ndarray) -> np.ndarray:
    return ((h >> T.U(40)) % T.U(BUCKETS)).astype(np.int64)


@dataclass
class Counts:
    """What the corpus's words count; tables by frequent word and by bucket."""

    keys: np.ndarray
    count: np.ndarray
    own: np.ndarray  # class of a frequent word, or -1
    tokens: int  # all, ends included
    types: int
    ends: int
    bucket_total: np.ndarray  # count of a bucket's words + its distinct words + 1

    def lookup(self) -> T.Lookup:
        if not hasattr(self, "_lookup"):
            self._lookup = T.Lookup(self.keys)
        return self._lookup

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_lookup"}


def word_counts(docs: DataFrame, train: str) -> DataFrame:
    """h and c of every word of the rows where the boolean column ``train`` holds."""

    def merged(parts):
        h, c = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        order = np.argsort(h, kind="stable")
        h, c = h[order], c[order]
        heads = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, int)
        return h[heads], np.add.reduceat(c, heads) if len(h) else c

    def run(batches):
        parts, size = [], 0
        for b in batches:
            for _, _, buf, offs in T.pieces(b.column(0)):
                starts, ends, _ = T.words(buf, offs)
                parts.append(np.unique(T.word_hashes(buf, starts, ends, lower=True), return_counts=True))
                size += len(parts[-1][0])
            if size > 1 << 21:
                parts = [merged(parts)]
                size = len(parts[0][0])
                if size > 1 << 20:  # let the sum by word take over
                    yield from batches_of(parts.pop())
                    size = 0
        if parts:
            yield from batches_of(merged(parts))

    def batches_of(pair):
        h, c = pair
        for i in range(0, len(h), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(h[i : i + 100_000].view(np.int64)), pa.array(c[i : i + 100_000])], ["h", "c"])

    return map_batches(docs.where(train).select("text"), run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def gathered(counts: DataFrame, ends: int) -> Counts:
    """Totals, buckets and the frequent words; only these, whose number is bounded, come to the driver."""
    scale = F.floor(F.log2("c") * 16).cast("int")
    steps = {r["s"]: r["n"] for r in counts.groupBy(scale.alias("s")).agg(F.count("*").alias("n")).collect()}  # about a thousand rows at most
    # whole steps as long as they fit, then of the next one as many hash ranges as still do: so the bound is always used
    lowest, n = max(steps, default=0) + 1, 0
    while n + steps.get(lowest - 1, 0) <= FREQUENT and lowest > min(steps, default=0):
        lowest -= 1
        n += steps.get(lowest, 0)
    chosen, part = scale >= lowest, F.shiftrightunsigned("h", 64 - 12).cast("int")
    if lowest > min(steps, default=0):
        sizes = {r["p"]: r["n"] for r in counts.where(scale == lowest - 1).groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}  # 4,096 rows at most
        low = 0
        while low < 4096 and n + sizes.get(low, 0) <= FREQUENT:
            n += sizes.get(low, 0)
            low += 1
        chosen = chosen | ((scale == lowest - 1) & (part < low))
    rows = counts.where(chosen).select("h", "c").toArrow()
    h = rows.column("h").to_numpy().view(np.uint64)
    c = rows.column("c").to_numpy().astype(np.int64)
    by_count = np.lexsort((h, -c))[:OWN]
    own = np.full(len(h), -1, np.int64)
    own[by_count] = np.arange(len(by_count))
    order = np.argsort(h, kind="stable")
    bucket = F.pmod(F.shiftrightunsigned("h", 40), F.lit(BUCKETS))
    sums = counts.groupBy(bucket.alias("b")).agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect()  # a row a bucket
    total = np.ones(BUCKETS, np.int64)
    for r in sums:
        total[r["b"]] += r["c"] + r["n"]
    np.subtract.at(total, _bucket(h[by_count]), c[by_count] + 1)
    return Counts(h[order], c[order], own[order], sum(r["c"] for r in sums) + ends, sum(r["n"] for r in sums) + (ends > 0), ends, total)


def _tokens(docs: DataFrame, counts: Counts) -> DataFrame:
    """For every row: class ids, sums over what is known of its words, and the words whose counts are not among the frequent ones."""
    shipped = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches):
        k = shipped.value
        unit = np.log10(k.tokens + k.types + 1.0)
        within = np.log10(k.bucket_total.astype(np.float64))
        end_base = np.log10(k.ends + 1.0) - unit
        for b in batches:
            n_tokens, n_known, base, score, classes, rare, times = [], [], [], [], [], [], []
            for i, j, buf, offs in T.pieces(b.column(2)):
                starts, ends, bounds = T.words(buf, offs)
                h = T.word_hashes(buf, starts, ends, lower=True)
                at = k.lookup().of(h)
                known = at >= 0
                c = np.where(known, k.count[at] if len(k.count) else 0, 0)
                own = np.where(known, k.own[at] if len(k.own) else -1, -1)
                bucket = _bucket(h)
                log_c = np.log10(c + 1.0)
                inner = np.where(own >= 0, 0.0, log_c - within[bucket])
                cls = np.where(own >= 0, own, OWN + bucket).astype(np.uint16)
                owner = T.owners(bounds)
                n = j - i
                n_tokens.append(np.diff(bounds) + 1)
                n_known.append(np.bincount(owner[known], minlength=n) + (k.ends > 0))
                base.append(np.bincount(owner, log_c - unit, n) + end_base)
                score.append(np.bincount(owner, inner, n))
                unknown = np.flatnonzero(~known)
                cut = np.searchsorted(unknown, bounds)
                for d in range(n):
                    classes.append(cls[bounds[d] : bounds[d + 1]].tobytes())
                    r, t = np.unique(h[unknown[cut[d] : cut[d + 1]]], return_counts=True)
                    rare.append(r.view(np.int64))
                    times.append(t.astype(np.int32))
            cat = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
            lengths = np.r_[0, np.cumsum([len(r) for r in rare])].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    b.column(1),
                    pa.array(cat(n_tokens, np.int64)),
                    pa.array(cat(n_known, np.int64)),
                    pa.array(cat(base, np.float64)),
                    pa.array(cat(score, np.float64)),
                    pa.array(classes, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(lengths), pa.array(cat(rare, np.int64))),
                    pa.ListArray.from_arrays(pa.array(lengths), pa.array(cat(times, np.int32))),
                ],
                ["doc_id", "train", "n_tokens", "known", "base", "inner", "classes", "rare", "times"],
            )

    schema = "doc_id long, train boolean, n_tokens long, known long, base double, inner double, classes binary, rare array<long>, times array<int>"
    return map_batches(docs.select("doc_id", "train", "text"), run, schema)


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # classes x states
    usual: np.ndarray  # how often a state is taken anywhere


def first_model(unigram: np.ndarray, states: int = STATES, seed: int = 3) -> Model:
    """States that tend to stay and prefer random classes."""
    rng = np.random.default_rng(seed)
    emit = unigram[:, None] * rng.gamma(0.5, size=(len(unigram), states)) + 1e-9
    emit[END] = unigram[END] + 1e-9
    move = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
    return Model(np.full(states, 1 / states), move, emit / emit.sum(0), np.full(states, 1 / states))


def _stretches(rows: list[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows, each closed by END, in stretches: tokens by place and stretch, and each stretch's number in its row."""
    n = np.array([len(r) + 1 for r in rows], np.int64)
    many = -(-n // size)
    first = np.r_[0, np.cumsum(many)]
    padded = np.full(int(first[-1]) * size, CLASSES, np.int64)
    for k, r in enumerate(rows):
        at = int(first[k]) * size
        padded[at : at + len(r)] = r
        padded[at + len(r)] = END
    return padded.reshape(-1, size).T.copy(), np.arange(int(first[-1])) - np.repeat(first[:-1], many)


def expected(model: Model, rows: list[np.ndarray], size: int = STRETCH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts of starts, transitions and emissions over whole rows of classes, each closed by END.

    A stretch's transfer matrix is the product of its steps' matrices (its first step
    into the stretch included).  Along each row these carry the forward message to where
    a stretch begins and the backward one to where it ends; in between, all stretches
    are gone through side by side.
    """
    k = len(model.start)
    obs, number = _stretches(rows, size)
    n = obs.shape[1]
    emit = np.vstack([model.emit, np.ones((1, k))]).astype(np.float32)  # the padding behind a row says nothing
    emit /= emit.max(1, keepdims=True)  # only the states' proportions matter
    emit = emit.T.copy()
    onto = model.move.T.astype(np.float32)  # messages are columns, a column a stretch
    back_onto, start = onto.T.copy(), model.start.astype(np.float32)[:, None]
    like = np.take(emit, obs, axis=1).transpose(1, 0, 2).copy()
    opens = number == 0
    last = np.r_[opens[1:], True] if n else opens

    enters = np.zeros((k, n), np.float32)  # the message after the stretch before
    leaves = np.ones((k, n), np.float32)  # the message before the stretch behind
    long = np.flatnonzero(~(opens & last))  # stretches of rows that have several
    if len(long):
        # step[i, j]: from state i before the stretch to state j at its end; the first stretches' rows are all alike
        step = np.where(opens[long], start[None], back_onto[:, :, None]) * like[0][:, long]
        for t in range(1, size):
            step = onto @ step
            step *= like[t][:, long]
            if t % 4 == 3 or t == size - 1:
                step /= np.maximum(step.max((0, 1)), 1e-35)
        step = step.transpose(2, 0, 1).copy()
        place = np.full(n, -1, np.int64)
        place[long] = np.arange(len(long))
        by_number = np.argsort(number[long], kind="stable")
        cuts = np.searchsorted(number[long][by_number], np.arange(int(number.max()) + 2))
        groups = [long[by_number[cuts[j] : cuts[j + 1]]] for j in range(int(number.max()) + 1)]
        for g in groups:
            g = g[~last[g]]
            ahead = np.where(opens[g], step[place[g], 0].T, (enters[:, g].T[:, None, :] @ step[place[g]])[:, 0].T)
            enters[:, g + 1] = ahead / ahead.sum(0)
        for g in reversed(groups):
            g = g[~opens[g]]
            back = (step[place[g]] @ leaves[:, g].T[:, :, None])[:, :, 0].T
            leaves[:, g - 1] = back / back.max(0)
        del step

    forward = np.empty((size, k, n), np.float32)
    for t in range(size):
        a = onto @ (forward[t - 1] if t else enters)
        a = (a if t else np.where(opens, start, a)) * like[t]
        a /= a.sum(0)
        forward[t] = a
    moves, starts = np.zeros((k, k)), np.zeros(k)
    real = (obs < CLASSES).astype(np.float32)
    back = leaves
    for t in range(size - 1, -1, -1):
        before, weighed = forward[t - 1] if t else enters, like[t] * back
        g = forward[t] * back
        g *= real[t] / g.sum(0)
        forward[t] = g  # not needed any more: the posterior takes its place
        if t == 0:
            starts += forward[0][:, opens].sum(1, dtype=np.float64)
        inside = real[t] if t else real[t] * ~opens
        joint = weighed * (inside / np.maximum(((onto @ before) * weighed).sum(0), 1e-30))
        moves += model.move * (before @ joint.T)
        back = back_onto @ weighed
        if t % 4 == 0:
            back /= back.max(0)
    at = obs.reshape(-1)
    emits = np.column_stack([np.bincount(at, forward[:, s, :].reshape(-1), CLASSES + 1)[:CLASSES] for s in range(k)])
    return starts, moves, emits


def next_model(starts: np.ndarray, moves: np.ndarray, emits: np.ndarray, unigram: np.ndarray) -> Model:
    """The model that the expected counts give, with a little of the unigram in every state."""
    k = len(starts)
    emit = emits + 0.5 * unigram[:, None] + 1e-9
    move = moves + 0.1
    usual = emits.sum(0) + 1e-6
    return Model((starts + 0.1) / (starts + 0.1).sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0), usual / usual.sum()) if k else None


def log_likelihoods(model: Model, rows: list[np.ndarray]) -> np.ndarray:
    """log10 of each row's likelihood (its classes and END), by the scaled forward recursion over the whole row."""
    n = np.array([len(r) for r in rows], np.int64)
    order = np.argsort(-n, kind="stable")
    out = np.zeros(len(rows))
    if not len(rows):
        return out
    at = np.r_[0, np.cumsum(n + 1)]
    flat = np.full(at[-1], END, np.int64)
    for k, r in enumerate(rows):
        flat[at[k] : at[k] + len(r)] = r
    length, begin = (n + 1)[order], at[:-1][order]
    active = np.searchsorted(-length, -np.arange(1, length[0] + 1), "right")  # rows that have a t-th token
    state = np.broadcast_to(model.start, (len(rows), len(model.start)))
    total = np.zeros(len(rows))
    for t, m in enumerate(active.tolist()):
        ahead = state[:m] @ model.move if t else state
        state = ahead * model.emit[flat[begin[:m] + t]]
        norm = state.sum(1)
        state = state / norm[:, None]
        total[:m] += np.log10(norm)
    out[order] = total
    return out


def fit(tokens: DataFrame, unigram: np.ndarray, rounds: int = ROUNDS, states: int = STATES) -> Model:
    """Rounds of Baum-Welch over the training rows of ``tokens``."""
    context = tokens.sparkSession.sparkContext
    model = first_model(unigram, states)
    train = tokens.where("train").select("classes")
    for _ in range(rounds):
        shipped = context.broadcast(model)  # some thousand classes times the states

        def run(batches, shipped=shipped):
            m, flat, held, n = shipped.value, None, [], 0

            def added():  # whole rows, about TOGETHER tokens of them
                part = np.concatenate([x.ravel() for x in expected(m, held)])
                return part if flat is None else flat + part

            for b in batches:
                for x in b.column(0).to_pylist():
                    held.append(np.frombuffer(x, np.uint16))
                    n += len(held[-1]) + 1
                    if n >= TOGETHER:
                        flat, held, n = added(), [], 0
            if held:
                flat = added()
            if flat is not None:
                used = np.flatnonzero(flat)
                yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(flat[used])], ["k", "x"])

        got = map_batches(train, run, "k long, x double").groupBy("k").agg(F.sum("x").alias("x")).toArrow()  # a row for each number of the model
        flat = np.zeros(states + states**2 + CLASSES * states)
        flat[got.column("k").to_numpy()] = got.column("x").to_numpy()
        if not flat.any():
            return model
        model = next_model(flat[:states], flat[states : states + states**2].reshape(states, states), flat[states + states**2 :].reshape(CLASSES, states), unigram)
    return model


def score(docs: DataFrame, train_where, rounds: int = ROUNDS) -> DataFrame:
    """For every row: doc_id, train, n_tokens, n_known, train_tokens, base_score and score; ``train_where`` says what is learned from."""
    docs = documents(docs).withColumn("train", F.coalesce(train_where, F.lit(False)))
    spark = docs.sparkSession
    counts = written(word_counts(docs, "train"), "counts")
    ends = docs.where("train").count()
    known = gathered(counts, ends)
    tokens = written(_tokens(docs, known).withColumn("row", F.monotonically_increasing_id()), "tokens")

    unigram = np.zeros(CLASSES)
    has = known.own >= 0
    unigram[known.own[has]] = known.count[has]
    unigram[OWN : OWN + BUCKETS] = known.bucket_total
    unigram[END] = ends + 1
    unigram /= unigram.sum()
    model = spark.sparkContext.broadcast(fit(tokens, unigram, rounds))

    def run(batches):
        held, size = [], 0

        def made():
            rows = [np.frombuffer(x, np.uint16) for b in held for x in b.column(1).to_pylist()]
            value, at = log_likelihoods(model.value, rows), 0
            for b in held:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(value[at : at + b.num_rows])], ["row", "forward"])
                at += b.num_rows

        for b in batches:  # rows of several batches go side by side
            held.append(b)
            size += b.column(1).nbytes
            if size > 16 << 20:
                yield from made()
                held, size = [], 0
        if held:
            yield from made()

    forward = map_batches(tokens.select("row", "classes"), run, "row long, forward double")
    each = tokens.where(F.size("rare") > 0).select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("h"), F.col("x.times").alias("times"))
    # words that are rare in the corpus: none of them has a large share of the rows
    met = each.join(counts, "h").groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("c") + 1.0)).alias("more"), F.sum(F.col("times").cast("long")).alias("found"))
    out = tokens.select("row", "doc_id", "train", "n_tokens", "known", "base", "inner").join(forward, "row").join(met, "row", "left")
    more = F.coalesce("more", F.lit(0.0))
    return out.select(
        "doc_id",
        "train",
        "n_tokens",
        (F.col("known") + F.coalesce("found", F.lit(0))).alias("n_known"),
        F.lit(known.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"),
        (F.col("forward") + F.col("inner") + more).alias("score"),
    )
