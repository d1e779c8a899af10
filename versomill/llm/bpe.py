"""Byte-level BPE by a tokenization automaton.

``compile_merges`` starts from one state with an arc for every byte and inserts one
gadget for each merge (u, v), in order: the state s that u enters is copied without
its arc v, all arcs u enter the copy, and wherever an arc u leaves, an arc uv leaves
too and enters the state behind v.  What remains accepts exactly the sequences of
tokens that the merges give, and is deterministic.  All arcs with one label enter
one state, so the table is small: a state is (the state it was copied from, the arc
it lost, the merge that made it), a token is (the state it enters, its left part,
the merge that made it).  ``allows`` answers from it whether a state has an arc.

A pre-split word is encoded by table: its bytes drive a second, finite table over all
labels (state, byte -> state), each of whose states lists the labels that end there,
longest first.  Every prefix of a word has exactly one accepted walk, so at each byte
exactly one of these labels has an arc behind the walk of the prefix before it; that
arc is written down, and the word's walk is read off backwards.  There is no search and
no backtracking.  Decoding emits the labels of the arcs.

Vocabulary files with a normalizer, another pre-tokenizer, or other settings that would
change ids are refused.  Null and empty texts have no tokens and decode to the empty
text.  Rows are treated one by one, so repeated rows, ids and rows without an id do not
matter; only doc_id and text are read, so other columns may have any names; an empty
table gives an empty result.  Words of any length are walked whole.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import documents, kept_in_worker, map_batches

#: Fixed value: the pre-tokens of this kind of vocabulary.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words in a worker's cache, and answers about arcs, before they start anew; characters of a word that is cached.
CACHED_WORDS, CACHED_ARCS, LONGEST = 400_000, 1_000_000, 64


def byte_of_character() -> dict[str, int]:
    """Vocabulary files write visible Latin-1 characters as themselves and the other bytes as characters from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


@dataclass
class Automaton:
    label: list[bytes]
    left: list[int]
    made: list[int]
    enters: list[int]
    dead: set[int]
    parent: list[int]
    lost: list[int]
    born: list[int]
    special: dict[str, int]
    step: dict[int, int] = field(default_factory=dict)  # state << 8 | byte -> state, over the labels
    ends: list[tuple[tuple[int, int], ...]] = field(default_factory=list)  # of each state, (length, token) of the labels that end there

    def __post_init__(self):
        self._tables()
        self._arcs: dict[int, bool] = {}
        self._words: dict[str, tuple[int, ...]] = {}
        self._decimal = [str(k) for k in range(len(self.label))]
        self._split = self._cut = None

    def allows(self, state: int, token: int) -> bool:
        """Whether an arc with this token leaves the state.

        A token made after the state has its arc where its left part has one; an
        older one's was copied from the state's parent, but for the one lost.
        """
        made, born, left = self.made, self.born, self.left
        while state:
            b = born[state]
            while made[token] >= b:
                token = left[token]
            if token == self.lost[state]:
                return False
            state = self.parent[state]
        return True

    def follows(self, a: int, b: int) -> bool:
        key = a << 20 | b
        found = self._arcs.get(key)
        if found is None:
            if len(self._arcs) >= CACHED_ARCS:
                self._arcs.clear()
            found = self._arcs[key] = self.allows(self.enters[a], b)
        return found

    def _tables(self) -> None:
        """The tables over labels: a trie, where a byte without an arc of its own goes on from the longest proper suffix."""
        own: list[dict[int, int]] = [{}]
        token = [-1]
        for k, x in enumerate(self.label):
            if self.made[k] >= 0 and k not in self.dead:
                at = 0
                for byte in x:
                    if byte not in own[at]:
                        own[at][byte] = len(own)
                        own.append({})
                        token.append(-1)
                    at = own[at][byte]
                token[at] = k
        self._back = [0] * len(own)
        self.ends = [()] * len(own)
        self.step = {}
        todo = [0]
        for at in todo:  # by depth, so that a suffix is done before
            for byte, to in own[at].items():
                back = self._next(self._back[at], byte) if at else 0
                self._back[to] = back
                k = token[to]
                self.ends[to] = (((len(self.label[k]), k),) if k >= 0 else ()) + self.ends[back]
                todo.append(to)
            for byte, to in own[at].items():
                self.step[at << 8 | byte] = to

    def _next(self, state: int, byte: int) -> int:
        """The state behind a byte; a way over suffixes is put into the table once it was gone."""
        key = state << 8 | byte
        to = self.step.get(key)
        if to is None:
            to = self.step[key] = self._next(self._back[state], byte) if state else 0
        return to

    def walk(self, word: bytes) -> list[int]:
        """The accepted walk over a word's bytes."""
        step, ends, follows = self.step, self.ends, self.follows
        behind = [-1]  # the last token of each prefix's walk
        size = [0]
        state = n = 0
        for byte in word:
            to = step.get(state << 8 | byte)
            state = self._next(state, byte) if to is None else to
            n += 1
            for length, k in ends[state]:
                before = behind[n - length]
                if length == n or (before >= 0 and follows(before, k)):
                    break
            else:
                raise ValueError("no walk accepts this word")
            behind.append(k)
            size.append(length)
        out = []
        while n:
            out.append(behind[n])
            n -= size[n]
        out.reverse()
        return out

    def _words_of(self, text: str) -> list[tuple[int, ...]]:
        words, cached = self._split(text), self._words
        found = list(map(cached.get, words))
        if None in found:
            if len(cached) > CACHED_WORDS:
                cached.clear()
            for k, v in enumerate(found):
                if v is None:
                    w = words[k]
                    v = cached.get(w)
                    if v is None:
                        v = tuple(self.walk(w.encode()))
                        if len(w) <= LONGEST:
                            cached[w] = v
                    found[k] = v
        return found

    def encode(self, text: str) -> list[int]:
        if self._split is None:
            import regex

            self._split = regex.compile(SPLIT).findall
            self._cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")").split if self.special else None
        if self._cut is None or not any(s in text for s in self.special):
            return list(chain.from_iterable(self._words_of(text)))
        out: list[int] = []
        for part in self._cut(text):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                out.extend(chain.from_iterable(self._words_of(part)))
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.label.__getitem__, ids))

    def decimal(self, ids: list[int]) -> str:
        return ",".join(map(self._decimal.__getitem__, ids))


def compile_merges(file: bytes) -> Automaton:
    """The automaton of a vocabulary file's merges; each merge must make a token of its own."""
    spec = json.loads(file)
    model, back = spec["model"], byte_of_character()
    pre = spec.get("pre_tokenizer")
    if pre is not None and (pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True)):
        raise ValueError("the pre-tokenizer must be ByteLevel with its usual pattern and no space before the text")
    if spec.get("normalizer") is not None or model.get("type", "BPE") != "BPE" or any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        raise ValueError("a normalizer, or a setting of the model that changes ids, is not understood")
    if any(t.get(x) for t in spec.get("added_tokens", []) for x in ("lstrip", "rstrip", "single_word", "normalized")):
        raise ValueError("an added token that takes in its surroundings is not understood")
    added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    size = 1 + max([*model["vocab"].values(), *added.values()])
    label, made, left, enters = [b""] * size, [-1] * size, [-1] * size, [0] * size
    for piece, k in model["vocab"].items():
        if piece not in added:
            label[k] = bytes(back[c] for c in piece)
            if len(label[k]) == 1:
                made[k] = 0
    a = Automaton(label, left, made, enters, set(), [-1], [-1], [0], added)
    for step, (u, v) in enumerate((m.split(" ") if isinstance(m, str) else m for m in model["merges"]), 1):
        u, v, w = model["vocab"][u], model["vocab"][v], model["vocab"][u + v]
        if made[w] >= 0:
            raise ValueError(f"two merges make {label[w]!r}")
        usable = made[u] >= 0 and made[v] >= 0 and not {u, v} & a.dead and a.allows(enters[u], v)
        made[w], left[w], enters[w] = step, u, enters[v]
        if not usable:  # u never stands before v: nothing enters the new token
            a.dead.add(w)
            continue
        a.parent.append(enters[u])
        a.lost.append(v)
        a.born.append(step)
        enters[u] = len(a.parent) - 1
    for content, k in added.items():
        label[k] = content.encode()
    a.__post_init__()
    return a


_compiled: dict[bytes, Automaton] = kept_in_worker(__name__)


def automaton(file: bytes) -> Automaton:
    """One automaton for each worker process."""
    key = hashlib.sha256(file).digest()
    if key not in _compiled:
        _compiled.clear()
        _compiled[key] = compile_merges(file)
    return _compiled[key]


def _shipped(df: DataFrame, path: str):
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file of one or two megabytes


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and n_tokens of every row."""
    docs = documents(docs)
    shipped = _shipped(docs, path)

    def run(batches):
        a = automaton(shipped.value)
        for b in batches:
            ids = [a.encode(t) if t else [] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(list(map(len, ids)), pa.int64())], ["doc_id", "ids", "n_tokens"])

    return map_batches(docs, run, "doc_id long, ids array<int>, n_tokens long")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of every row of ids; bytes that are no UTF-8 become U+FFFD."""
    shipped = _shipped(encoded, path)

    def run(batches):
        a = automaton(shipped.value)
        for b in batches:
            texts = [a.decode(x or []).decode("utf-8", "replace") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return map_batches(encoded.select("doc_id", "ids"), run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """Digests of every row's ids and of the text decoded from them, made where the ids are; the ids too if wanted."""
    docs = documents(docs)
    shipped = _shipped(docs, path)
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]

    def run(batches):
        a = automaton(shipped.value)
        for b in batches:
            counts, coded, decoded, every = [], [], [], []
            for t in b.column(1).to_pylist():
                ids = a.encode(t) if t else []
                counts.append(len(ids))
                coded.append(hashlib.sha256(a.decimal(ids).encode()).hexdigest())
                decoded.append(hashlib.sha256(a.decode(ids).decode("utf-8", "replace").encode()).hexdigest())
                if with_ids:
                    every.append(np.array(ids, np.int32))
            cols = [b.column(0), pa.array(counts, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays([*cols, *[pa.array(every, pa.list_(pa.int32()))] * with_ids], names)

    return map_batches(docs, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
