"""Token counts of whole texts by a two-tier lookup, without shuffling pre-tokens.

The piece vocabulary has no piece with a space mark after another character, so
no merge crosses the start of a run of spaces: a text's count is the sum over its
pre-tokens (a run of spaces or marks with what follows it).

Tier one is a broadcast table of the corpus's most frequent pre-tokens: sorted 64-bit
hashes, a further 32 bits that must agree too, and the number of tokens, 16 bytes an
entry.  Every partition sums itself up in one row of at most ``size`` pre-tokens (the
most frequent so far stay when there are too many); these rows are merged in two rounds
of bounded groups and at the end on the driver, each merge keeping ``size`` of them.  Which
pre-tokens are in the table decides the speed only, never a count.  Tier two is a cache in
each Python worker, bounded in entries and bytes, filled by encoding what the table
misses; pre-tokens of more than ``LONGEST`` bytes are encoded each time and kept nowhere.

Null and empty texts have no tokens.  Rows are counted one by one, so repeated rows,
repeated ids and rows without an id do not matter; texts of any length are counted
whole; only doc_id and text are read, whatever other columns there are.  An empty table
gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum as T
from .common import documents, kept_in_worker, map_batches

#: Entries of the broadcast table and of each summary; entries of a worker's cache before it starts anew; bytes of a pre-token in either.
TABLE_SIZE, CACHE_SIZE, LONGEST = 1 << 14, 1 << 18, 64
#: Rows of summaries that the first and second round leave.
FIRST_ROUND, SECOND_ROUND = 1024, 32

_mark = np.array([0xE2, 0x96, 0x81], np.uint8)
_loaded: dict[int, object] = kept_in_worker(__name__)


def _processor(model: bytes):
    """One processor and one cache for each worker process."""
    import sentencepiece

    key = hash(model)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = (sentencepiece.SentencePieceProcessor(model_proto=model), {})
    return _loaded[key]


def pretokens(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of pre-tokens, and where each text's begin among them (one more at the end).

    A text's first one starts with it; any other at a space or mark that follows neither.
    """
    n = len(buf)
    part = buf == 0x20  # bytes of spaces and marks
    at = np.flatnonzero(buf[:-2] == _mark[0]) if n > 2 else np.zeros(0, np.int64)
    at = at[(buf[at + 1] == _mark[1]) & (buf[at + 2] == _mark[2])] if len(at) else at
    head = part.copy()
    head[at] = True
    for k in range(3):
        part[at + k] = True
    first = head
    first[1:] &= ~part[:-1]
    first[offs[:-1][np.diff(offs) > 0]] = True
    starts = np.flatnonzero(first)
    return starts, np.append(starts[1:], n)[: len(starts)], np.searchsorted(starts, offs)


def _spelled(raw: bytes, start: int, end: int, opens: bool) -> str:
    """What the processor is given: it adds a space itself, so the first space of a pre-token that does not open its text is left out."""
    x = raw[start:end]
    if not opens:
        x = x[1:] if x[0] == 0x20 else x[3:]
    return x.decode()


class Table:
    """Tokens of frequent pre-tokens by two hashes."""

    def __init__(self, key: np.ndarray, check: np.ndarray, tokens: np.ndarray):
        order = np.argsort(key, kind="stable")
        self.key, self.check, self.tokens = key[order], check[order], tokens[order]

    def of(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        """-1 where there is none."""
        if not len(self.key):
            return np.full(len(key), -1, np.int64)
        if not hasattr(self, "_places"):
            self._places = T.Lookup(self.key)
        at = self._places.of(key)
        found = (at >= 0) & (self.check[at] == check)
        return np.where(found, self.tokens[at], -1)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_places"}


def _hashed(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, opens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each pre-token; one that opens its text is another than the same bytes later on."""
    ranges = T.Ranges(buf, lower=False)
    return ranges.of(starts, ends) ^ opens.astype(np.uint64), ranges.of(starts, ends, seed=1).astype(np.uint32)


def _opens(starts: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    out = np.zeros(len(starts), bool)
    out[bounds[:-1][np.diff(bounds) > 0]] = True
    return out


def separable(model: bytes) -> bool:
    """Whether counts of pre-tokens add up to counts of texts under this model."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    sp, spec = sentencepiece.SentencePieceProcessor(model_proto=model), pb.ModelProto.FromString(model)
    n = spec.normalizer_spec
    own = any(p.type == pb.ModelProto.SentencePiece.USER_DEFINED for p in spec.pieces)
    inner = any(re.search("[^▁]▁", sp.id_to_piece(k)) for k in range(sp.get_piece_size()))
    return not own and not inner and n.add_dummy_prefix and not n.remove_extra_whitespaces and n.escape_whitespaces and not n.precompiled_charsmap and not spec.trainer_spec.treat_whitespace_as_suffix


def _merged(parts: list[np.ndarray], size: int) -> np.ndarray:
    """Rows (key, check, tokens, count) with equal keys added up, the ``size`` most frequent of them."""
    x = np.concatenate(parts) if parts else np.zeros((0, 4), np.int64)
    if not len(x):
        return x
    x = x[np.lexsort((x[:, 1], x[:, 0]))]
    heads = np.flatnonzero(np.r_[True, (x[1:, :2] != x[:-1, :2]).any(1)])
    out = x[heads]
    out[:, 3] = np.add.reduceat(x[:, 3], heads)
    return out[np.lexsort((out[:, 0], -out[:, 3]))[:size]]


def frequent(docs: DataFrame, model_of, size: int = TABLE_SIZE) -> np.ndarray:
    """Rows (key, check, tokens, count) of the most frequent pre-tokens, as far as the partitions' summaries show them."""

    def run(batches):
        sp, _ = _processor(model_of())
        held = np.zeros((0, 4), np.int64)
        alone = len(sp.encode("a ")) - len(sp.encode("a"))
        for b in batches:
            for _, _, buf, offs in T.pieces(b.column(0)):
                starts, ends, bounds = pretokens(buf, offs)
                opens = _opens(starts, bounds)
                short = np.flatnonzero(ends - starts <= LONGEST)
                starts, ends, opens = starts[short], ends[short], opens[short]
                key, check = _hashed(buf, starts, ends, opens)
                key, at, count = np.unique(key, return_index=True, return_counts=True)
                top = np.argsort(-count, kind="stable")[: 4 * size]
                # tokens are counted at the end, of what stays; its place in this piece is needed until then
                new = np.column_stack([key[top].view(np.int64), check[at[top]].astype(np.int64), np.full(len(top), -1), count[top]])
                known = np.concatenate([held, new])
                fresh = _merged([known], 4 * size)
                todo = np.flatnonzero(fresh[:, 2] < 0)
                where = {int(k): int(a) for k, a in zip(key[top].view(np.int64).tolist(), at[top].tolist(), strict=True)}
                raw = buf.tobytes()
                places = [where.get(k, -1) for k in fresh[todo, 0].tolist()]
                tokens = sp.encode([_spelled(raw, starts[p], ends[p], opens[p]) for p in places], num_threads=1)
                fresh[todo, 2] = [len(x) or alone for x in tokens]
                held = fresh
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([_merged([held], size).tobytes()], pa.binary())], ["part", "rows"])

    def fold(rows: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x.as_buffer(), np.int64).reshape(-1, 4) for x in rows.column("rows")]
        return pa.table({"part": rows.column("part")[:1], "rows": pa.array([_merged(parts, size).tobytes()], pa.binary())})

    found = map_batches(docs.select("text"), run, "part long, rows binary")
    for left in (FIRST_ROUND, SECOND_ROUND):
        found = found.groupBy(F.pmod("part", F.lit(left))).applyInArrow(fold, "part long, rows binary")
    return _merged([np.frombuffer(r["rows"], np.int64).reshape(-1, 4) for r in found.select("rows").collect()], size)  # SECOND_ROUND rows of a bounded size


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, size: int = TABLE_SIZE) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row."""
    docs = documents(docs)
    context = docs.sparkSession.sparkContext
    with open(model_path, "rb") as f:
        model = f.read()
    if not separable(model):
        raise ValueError(f"{model_path}: counts of pre-tokens do not add up under this model")
    raw_model = context.broadcast(model)  # half a megabyte
    top = frequent(docs, lambda: raw_model.value, size)
    table = context.broadcast(Table(top[:, 0].copy().view(np.uint64), top[:, 1].astype(np.uint32), top[:, 2].astype(np.int32)))  # 16 bytes an entry

    def run(batches):
        sp, cache = _processor(raw_model.value)
        hot = table.value
        alone = len(sp.encode("a ")) - len(sp.encode("a"))
        for b in batches:
            total = np.zeros(b.num_rows, np.int64)
            size_of = np.zeros(b.num_rows, np.int64)
            for i, j, buf, offs in T.pieces(b.column(1)):
                size_of[i:j] = np.diff(offs)
                starts, ends, bounds = pretokens(buf, offs)
                opens = _opens(starts, bounds)
                n = hot.of(*_hashed(buf, starts, ends, opens))
                miss = np.flatnonzero(n < 0)
                raw = buf.tobytes()
                spelled = [_spelled(raw, s, e, o) for s, e, o in zip(starts[miss].tolist(), ends[miss].tolist(), opens[miss].tolist(), strict=True)]
                found = list(map(cache.get, spelled))
                new = list({w for w, v in zip(spelled, found, strict=True) if v is None})
                if new:
                    counts = {w: len(x) or alone for w, x in zip(new, sp.encode(new, num_threads=1), strict=True)}
                    if len(cache) > CACHE_SIZE:
                        cache.clear()
                    cache.update((w, v) for w, v in counts.items() if len(w) <= LONGEST)
                    found = [counts[w] if v is None else v for w, v in zip(spelled, found, strict=True)]
                n[miss] = found
                sums = np.r_[0, np.cumsum(n)]
                total[i:j] = sums[bounds[1:]] - sums[bounds[:-1]]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size_of), pa.array(total), pa.array(total > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return map_batches(docs, run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
