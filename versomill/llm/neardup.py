"""Near duplicates by SetSketch registers.

A document's set holds its distinct shingles of ``k`` words.  Register i of a sketch
holds the smallest of the set's exponentially distributed hash values under hash
function i, on an exponential scale: floor(1 - log_b(min)), truncated to 16 bits.
Registers of a union are the larger ones of the parts, and two sets' registers agree
the more often the more alike they are, so runs of registers serve as bands.

1. Documents with equal word sequences become one vertex, by a BLAKE2b digest of all
   their words; equal sets of unequal sequences are linked as all others are.
2. Vertices that share a band meet in a bucket.  Each bucket's vertices are paired
   with its centre, the one with most copies; pairs are kept unless the likelihood
   of their registers speaks against the threshold, and verified on the full sets.
3. Buckets whose vertices are not all connected by then are gone through pair by
   pair: by the rare shingles they share, and, where the common ones would do, in
   blocks of sets, side by side and without a row for each pair.  So a bucket loses no
   link, and a large group of copies does not have all its pairs gone through.
4. Components over all links give each document its class.

A pair at the threshold shares no band of 5 among 160 registers with a probability of
1e-8 at similarity 0.85 and 3e-6 at 0.8.

Null and empty texts have empty sets and are linked with nothing, nor are rows without
an id.  Rows that share an id, and repeated rows, are linked by their texts like any
others; ties between ids cannot be, the smallest one names a class.  Texts of any length
have their whole set.  Only doc_id and text are read; ``deduplicated`` keeps all other
columns whatever their names.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textnum as T
from .common import documents, map_batches, plain_names, scratch, text_keys, written
from .components import components

REGISTERS, BAND = 160, 5
BASE, RATE, TOP = 1.02, 20.0, 65535
#: The likelihood of the best similarity at or above the threshold may lie this far (in log units) below the best at all: more than 6 standard deviations.
SURE = 20.0
#: Members of a bucket up to which its pairs are joined as rows; larger ones go by blocks of about BLOCK members and BLOCK_BYTES of sets.
SMALL_BUCKET, BLOCK, BLOCK_BYTES = 16, 512, 16 << 20
#: Sets that a rare shingle is found in at most.
RARE = 16
#: Ids that are broadcast at most, 8 bytes each and 8 more for a text's key; more are joined by a shuffle.
MOST_IDS = 500_000

_rng = np.random.default_rng(77)
_A = _rng.integers(0, 1 << 31, REGISTERS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint32)


def shingle_sets(column: pa.Array, k: int):
    """The sorted distinct shingle hashes of every text."""
    for i, j, buf, offs in T.pieces(column):
        starts, ends, bounds = T.words(buf, offs)
        h = T.word_hashes(buf, starts, ends, lower=True)
        g = T.shingles(h, k)
        for d in range(j - i):
            s, e = bounds[d], bounds[d + 1]
            if e - s >= k:
                yield np.unique(g[s : e - k + 1])
            elif e > s:  # fewer words than a shingle has: the whole sequence is one
                yield T.mix(T.shingles(h[s:e], int(e - s)) + T.U(0xABCD + int(e - s)))
            else:
                yield np.zeros(0, np.uint64)


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Registers of each set; zeros for an empty one."""
    out = np.zeros((len(sets), REGISTERS), np.uint16)
    full = [k for k, s in enumerate(sets) if len(s)]
    i = 0
    while i < len(full):
        j, n = i, 0
        while j < len(full) and (j == i or n + len(sets[full[j]]) <= 1 << 17):
            n += len(sets[full[j]])
            j += 1
        part = [sets[k] for k in full[i:j]]
        s = np.concatenate(part)
        s = (s ^ (s >> T.U(32))).astype(np.uint32)
        heads = np.r_[0, np.cumsum([len(x) for x in part])[:-1]]
        least = np.empty((len(part), REGISTERS), np.uint32)
        for r in range(REGISTERS):
            least[:, r] = np.minimum.reduceat(s * _A[r] + _B[r], heads)
        x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**32) / RATE
        out[full[i:j]] = np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, TOP)
        i = j
    return out


def digests(column: pa.Array) -> list[bytes]:
    """A 128-bit digest of each text's sequence of words, A-Z in lower case."""
    lower = T.LOWER.tobytes()
    return [hashlib.blake2b(b" ".join((x.as_py() or b"").translate(lower).split()), digest_size=16).digest() for x in column.cast(pa.large_string()).cast(pa.large_binary())]


def _sketched(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n (shingles), the digest of the words, registers and, if there are any, the text's keys of each row."""

    def run(batches):
        for b in batches:
            sets = list(shingle_sets(b.column(1), k))
            regs = sketches(sets)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests(b.column(1)), pa.binary()), pa.array([r.tobytes() for r in regs], pa.binary()), *b.columns[2:]],
                ["doc_id", "n", "digest", "regs", *b.schema.names[2:]],
            )

    more = "".join(f", {c} long" for c in docs.columns[2:])
    return map_batches(docs, run, f"doc_id long, n long, digest binary, regs binary{more}")


def _full_sets(docs: DataFrame, k: int) -> DataFrame:
    def run(batches):
        for b in batches:
            sets = list(shingle_sets(b.column(1), k))
            yield pa.RecordBatch.from_arrays([pa.array(digests(b.column(1)), pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["digest", "hashes"])

    return map_batches(docs, run, "digest binary, hashes binary")


def likely(ra: np.ndarray, rb: np.ndarray, na: np.ndarray, nb: np.ndarray, least: float) -> np.ndarray:
    """Whether rows of registers may belong to sets whose similarity is ``least`` or more.

    The joint likelihood of how many registers are larger, smaller and equal, given
    both sizes, is taken over two grids of similarities: all that the sizes allow, and
    those from ``least`` on, as few as they may be.
    """
    more, fewer = (ra > rb).sum(-1), (ra < rb).sum(-1)
    same = REGISTERS - more - fewer
    u = (na / (na + nb))[..., None]
    v = 1 - u
    most = np.minimum(u / v, v / u)  # no similarity exceeds the sizes' ratio

    def p(x):
        return -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def best(grid):
        # J as inter / union: u - vJ is proportional to the part of a alone
        larger, smaller = p(u - v * grid), p(v - u * grid)
        return (more[..., None] * np.log(larger) + fewer[..., None] * np.log(smaller) + same[..., None] * np.log(np.clip(1 - larger - smaller, 1e-12, 1))).max(-1)

    enough = best(least + np.linspace(0.0, 1.0, 51) * np.maximum(most - least, 0))
    return (most[..., 0] >= least - 1e-9) & (enough >= best(np.linspace(0.0, 1.0, 101) * most) - SURE)


def _regs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def _filtered(pairs: DataFrame, vertices: DataFrame, least: float) -> DataFrame:
    """Pairs a, b that the likelihood does not exclude."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                ok = likely(_regs(b.column(2)), _regs(b.column(3)), b.column(4).to_numpy(), b.column(5).to_numpy(), least)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(ok))

    one = vertices.select(F.col("v").alias("a"), F.col("regs").alias("ra"), F.col("n").alias("na"))
    two = vertices.select(F.col("v").alias("b"), F.col("regs").alias("rb"), F.col("n").alias("nb"))
    joined = pairs.join(one, "a").join(two, "b").select("a", "b", "ra", "rb", "na", "nb")
    return map_batches(joined, run, "a long, b long")


def _sets_of(wanted: DataFrame, docs: DataFrame, vertices: DataFrame, k: int) -> DataFrame:
    """v and hashes, the full set, of the wanted vertices, made again from the texts."""
    needed = written(vertices.select("v", "rep", "digest").join(wanted.select("v").distinct(), "v"), "needed")
    ids = needed.select(F.col("rep").alias("doc_id")).distinct()
    if ids.count() <= MOST_IDS:
        ids = F.broadcast(ids)
    return written(_full_sets(docs.join(ids, "doc_id"), k).join(needed.select("v", "digest"), "digest").select("v", "hashes").dropDuplicates(["v"]), "sets")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("v")).union(pairs.select(F.col("b").alias("v")))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs a, b whose full sets are as alike as that."""

    def run(batches):
        for b in batches:
            ok = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(100 * both >= percent * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    one = sets.select(F.col("v").alias("a"), F.col("hashes").alias("x"))
    two = sets.select(F.col("v").alias("b"), F.col("hashes").alias("y"))
    return map_batches(pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y"), run, "a long, b long")


def _rare_shingles(sets: DataFrame) -> DataFrame:
    """v and h of every shingle that at most RARE of the sets have."""

    def run(batches):
        for b in batches:
            for v, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                h = np.frombuffer(x, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), v, np.int64)), pa.array(h)], ["v", "h"])

    # from files, so that the rows of a shingle that very many sets have can be split over tasks
    every = written(map_batches(sets, run, "v long, h long"), "shingles")
    few = written(every.groupBy("h").agg(F.count("*").alias("d")).where(F.col("d") <= RARE).select("h"), "few")
    return written(every.join(few, "h"), "rare")


def _open_pairs(bands: DataFrame, labels: DataFrame, vertices: DataFrame, docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame | None, DataFrame] | None:
    """Pairs of one bucket and two components, and all members' sets; None if no bucket has two.

    Pairs come as rows, and those of large buckets' blocks, which are verified by then,
    apart; None where there are no large buckets.
    """
    marked = written(bands.join(labels, "v", "left").select("band", "key", "v", "n", F.coalesce("label", "v").alias("c")), "marked")
    state = marked.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("m"))
    state = written(state.where("low <> high").select("key", "m"), "open")
    if state.isEmpty():
        return None
    members = written(marked.join(state, "key"), "open-members")
    sets = _sets_of(members, docs, vertices, k)

    small = members.where(F.col("m") <= SMALL_BUCKET)
    other = small.select("key", F.col("v").alias("v2"), F.col("n").alias("n2"), F.col("c").alias("c2"))
    alike = (100 * F.least("n", "n2") >= percent * F.greatest("n", "n2")) & (F.col("c") != F.col("c2"))
    rows = small.join(other, "key").where(alike & (F.col("v") < F.col("v2"))).select(F.col("v").alias("a"), F.col("v2").alias("b")).distinct()
    large = members.where(F.col("m") > SMALL_BUCKET)
    if large.isEmpty():
        return rows, None, sets
    by_shingle, linked = _large_pairs(large, vertices, sets, alike, percent)
    return rows.unionByName(by_shingle).distinct(), linked, sets


def _large_pairs(large: DataFrame, vertices: DataFrame, sets: DataFrame, alike: Column, percent: int) -> tuple[DataFrame, DataFrame]:
    """Pairs of large buckets: those that share a rare shingle, as candidates, and links found in blocks on full sets.

    The intersections of all pairs without a rare shingle hold common ones only, so the
    smaller count of these bounds them; that excludes most pairs of a group of copies that
    were each changed in their own way.
    """
    main = large.groupBy("key", "c").agg(F.count("*").alias("k")).groupBy("key").agg(F.max(F.struct("k", "c"))["c"].alias("main"))
    large = written(large.join(written(main, "main"), "key"), "large")
    rare = _rare_shingles(sets.join(large.select("v").distinct(), "v", "left_semi"))
    own = large.select("v", "n", "c").distinct()
    minors = large.where(F.col("c") != F.col("main")).select("v").distinct()
    rare_of = written(rare.join(own, "v"), "rare-of")
    left = rare_of.join(minors, "v", "left_semi").select("h", "v", "n", "c")
    right = rare_of.select("h", F.col("v").alias("v2"), F.col("n").alias("n2"), F.col("c").alias("c2"))
    by_shingle = left.join(right, "h").where(alike).select(F.least("v", "v2").alias("a"), F.greatest("v", "v2").alias("b")).distinct()

    counts = written(rare.groupBy("v").agg(F.count("*").alias("rare")), "rare-counts")
    large = large.join(counts, "v", "left").withColumn("shared", F.col("n") - F.coalesce("rare", F.lit(0)))
    # a vertex with too few common shingles has no partner but by a rare one
    large = written(large.where(100 * F.col("shared") >= percent * F.col("n")).select("band", "key", "v", "n", "c", "m", "main", "shared"), "large-shared")

    # the members outside of the largest component against all, in blocks that are bounded in members and bytes
    large = written(large.join(vertices.select("v", "regs"), "v").join(sets, "v"), "large-sets")
    per_key = written(large.groupBy("key").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") * 8 / BLOCK_BYTES)).cast("int").alias("blocks")), "blocks")
    large = large.join(per_key, "key").withColumn("own", F.pmod(F.xxhash64("v", F.lit(5)), F.col("blocks")).cast("int"))
    minor = large.where(F.col("c") != F.col("main")).select("key", F.col("own").alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), "band", "v", "n", "c", "shared", "regs", "hashes")
    # a block of minor members only exists where such members hash to it
    whole = large.join(minor.select("key", "i").distinct(), "key")
    # named anew, or Spark takes both sides' columns for the same ones
    whole = whole.select(*[F.col(x).alias(y) for x, y in (("key", "key"), ("i", "i"), ("own", "j"), ("v", "v"), ("n", "n"), ("c", "c"), ("shared", "shared"), ("regs", "regs"), ("hashes", "hashes"))])
    least = percent / 100

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], []]
        if left.num_rows and right.num_rows:
            lv, ln, lc, ls = (left.column(x).to_numpy() for x in ("v", "n", "c", "shared"))
            rv, rn, rc, rs = (right.column(x).to_numpy() for x in ("v", "n", "c", "shared"))
            lr, rr = _regs(left.column("regs")), _regs(right.column("regs"))
            band = left.column("band")[0].as_py()
            # the right sets as places in their union, one behind the other
            union, place = np.unique(np.frombuffer(b"".join(right.column("hashes").to_pylist()), np.uint64), return_inverse=True)
            heads = np.r_[0, np.cumsum(rn)[:-1]]
            has = np.zeros(len(union), np.int32)
            for k in range(len(lv)):
                both = np.minimum(rs, ls[k])
                at = np.flatnonzero((rc != lc[k]) & (100 * both >= percent * (rn + ln[k] - both)))
                # a quick look first: fewer equal registers than any set at the threshold would have
                at = at[(rr[at] == lr[k]).sum(1) >= (least - 0.25) * REGISTERS]
                # a pair that shares several bands is taken up in the first of them
                at = at[(rr[at] == lr[k]).reshape(-1, REGISTERS // BAND, BAND).all(2).argmax(1) == band]
                if len(at):
                    own = np.frombuffer(left.column("hashes")[k].as_buffer(), np.uint64)
                    found = np.minimum(np.searchsorted(union, own), len(union) - 1)
                    found = found[union[found] == own]
                    has[found] = 1
                    both = np.add.reduceat(has[place], heads)[at]
                    has[found] = 0
                    at = at[100 * both >= percent * (rn[at] + ln[k] - both)]
                    out[0].append(np.minimum(lv[k], rv[at]))
                    out[1].append(np.maximum(lv[k], rv[at]))
        cat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]
        return pa.table({"a": cat[0], "b": cat[1]})

    linked = minor.groupBy("key", "i", "j").cogroup(whole.groupBy("key", "i", "j")).applyInArrow(run, "a long, b long")
    return by_shingle, linked.distinct()


def classes(docs: DataFrame, k: int = 5, percent: int = 80, with_key: bool = False) -> DataFrame:
    """For every row of docs: doc_id, n_shingles and component_id, the smallest id of its class; k1 and k2, the keys of its text, too if wanted."""
    docs = documents(docs)
    with scratch(docs.sparkSession):
        k1, k2 = text_keys(F.col("text"))
        base = written(_sketched(docs.select("doc_id", "text", k1.alias("k1"), k2.alias("k2")) if with_key else docs, k), "sketches", outlive=True)
        # one vertex for each sequence of words; the copies' rows are merged before they are shuffled
        some = base.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
        found = some.groupBy("digest").agg(F.min(F.struct("doc_id", "n", "regs")).alias("least"), F.count("*").alias("copies"))
        found = found.select(F.monotonically_increasing_id().alias("v"), "digest", "copies", "least.n", F.col("least.doc_id").alias("rep"), "least.regs")
        vertices = written(found, "vertices")  # v is a plain number, fixed by being written

        width = 2 * BAND
        keys = [F.xxhash64(F.substring(F.col("regs"), width * i + 1, width), F.lit(i)) for i in range(REGISTERS // BAND)]
        bands = vertices.select("v", "n", "copies", F.posexplode(F.array(*keys)).alias("band", "key"))
        centre = bands.groupBy("key").agg(F.min(F.struct((-F.col("copies")).alias("few"), F.col("v").alias("centre"), F.col("n").alias("n0"))).alias("first"), F.count("*").alias("m"))
        centre = written(centre.where("m > 1").select("key", "first.centre", "first.n0"), "centres")
        # only buckets with several members matter from here on
        bands = written(bands.select("band", "key", "v", "n").join(centre, "key"), "bands")
        alike = 100 * F.least("n", "n0") >= percent * F.greatest("n", "n0")
        stars = bands.where((F.col("v") != F.col("centre")) & alike).select(F.least("v", "centre").alias("a"), F.greatest("v", "centre").alias("b")).distinct()
        least = percent / 100
        candidates = written(_filtered(written(stars, "stars"), vertices, least), "candidates")
        links = written(_verified(candidates, _sets_of(_ends(candidates), docs, vertices, k), percent), "links")
        labels = components(links)

        found = _open_pairs(bands.select("band", "key", "v", "n"), labels, vertices, docs, k, percent)
        if found is not None:
            rows, linked, sets = found
            more = _verified(written(_filtered(written(rows, "rows"), vertices, least), "further"), sets, percent)
            more = written(more if linked is None else more.unionByName(linked), "more-links")
            if not more.isEmpty():
                labels = components(links.unionByName(more))

        named = labels.join(vertices.select("v", "rep"), "v")
        smallest = written(named.groupBy("label").agg(F.min("rep").alias("component_id")), "smallest")
        linked = labels.join(smallest, "label").select("v", "component_id")
        alone = vertices.where("copies > 1").join(labels, "v", "left_anti").select("v", F.col("rep").alias("component_id"))
        grouped = written(linked.unionByName(alone).join(vertices.select("v", "digest"), "v").select(F.col("digest").alias("of"), "component_id"), "classes", outlive=True)
        # rows without words or id stay alone: they look for no class
        digest = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("digest"))
        own = ["k1", "k2"] if with_key else []
        out = base.select("doc_id", "n", digest.alias("digest"), *own).join(grouped, F.col("digest") == F.col("of"), "left")
        return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), *own)


def deduplicated(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, with all their columns, of which one stays for each class: the one with the smallest id.

    Rows go by id and text, so a row that shares its id with a copy of another stays.
    Of rows that are equal in id and text one stays; rows of a class that share its
    smallest id but not the text all stay.
    """
    with scratch(docs.sparkSession):
        found = classes(docs, k, percent, with_key=True).where("doc_id <> component_id")
        gone = written(found.select(F.col("doc_id").alias("id"), "k1", "k2").distinct(), "gone", outlive=True)
        rows, doc_id, text = plain_names(docs)
        few = gone.count() <= MOST_IDS
        k1, k2 = text_keys(F.col(text).cast("string"))
        same = (F.col(doc_id).cast("long") == F.col("id")) & (k1 == F.col("k1")) & (k2 == F.col("k2"))
        kept = rows.join(F.broadcast(gone) if few else gone, same, "left_anti")
        again = rows.groupBy(F.col(doc_id).alias("id")).agg(F.count("*").alias("n")).where("n > 1 and id is not null").select("id")
        again = written(again, "again", outlive=True)
        if not again.isEmpty():
            same = F.col(doc_id) == F.col("id")
            once = kept.join(again, same, "left_semi").dropDuplicates([doc_id, text])
            kept = kept.join(again, same, "left_anti").unionByName(once)
        return kept.toDF(*docs.columns)
