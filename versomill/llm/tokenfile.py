"""Token files: frequency-ranked ids in byte-aligned variable-length coding with control bytes.

An id is written as its rank by frequency over the whole corpus, in 1 to 4 bytes;
the lengths of four ranks, less one, share a control byte.  Control bytes and data
bytes stand apart, so a reader looks up four lengths at a time in a table of 256
rows and gathers all ranks at once.  Files hold documents in ascending order of
doc_id, split into blocks; each block has its documents' ids and lengths, and how
many token ids its file has before it.

The blocks are rows of a Parquet table, so that every executor writes through
Spark to whatever store the folder is in.  Encoding runs once: its result is written,
counted for the ranks, dealt by ranges of doc_id, sorted and coded.

Null and empty texts consist of the end id alone; texts of any length are whole.  A null
doc_id comes first.  Rows with one doc_id, and repeated rows, stand next to each other,
ordered by their number of ids and a hash of these; the ranges are made of all three, so
that even many such rows spread over files.  Only doc_id and text are read, so other
columns may have any names.  An empty table gives no blocks and an empty result.
"""

from __future__ import annotations

import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, dropped, kept_in_worker, map_batches, new_folder

MAGIC = b"VTB1"
#: Token ids of a block; words that a worker keeps for good, and later ones before they start anew; characters of a word that is kept; bytes of plain ids for each file.
BLOCK_IDS, KEPT_WORDS, LATE_WORDS, LONGEST, FILE_BYTES = 1 << 19, 700_000, 200_000, 64, 32 << 20

#: Lengths of the four values of a control byte.
LENGTHS = np.array([[(c >> (2 * k) & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)
_MASK = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)

# Fixed value: the pre-tokens of byte-level vocabularies; for texts within Latin-1 the classes are spelled out, which is faster.
_ANY = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
_LATIN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")


# Fixed value: the visible stand-ins of bytes in such vocabularies, Latin-1's own and characters from U+0100 on for the rest.
_SHOWN = {b: chr(b) for b in (*range(33, 127), *range(161, 173), *range(174, 256))}
_SHOWN |= {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _SHOWN)}


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit values."""
    ranks = ranks.astype("<u4")
    extra = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    padded[: len(ranks)] = extra
    four = padded.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) <= extra[:, None]]
    return control.astype(np.uint8).tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    ends = np.cumsum(lengths, dtype=np.int64)
    starts = ends - lengths
    raw = np.zeros(len(data) + 4, np.uint8)
    raw[: len(data)] = np.frombuffer(data, np.uint8)
    value = raw[starts].astype(np.uint32)
    for k in range(1, int(lengths.max(initial=1))):
        value |= raw[starts + k].astype(np.uint32) << np.uint32(8 * k)
    return value & _MASK[lengths]


def write_block(doc_ids: list[int | None], lengths: np.ndarray, ranks: np.ndarray) -> bytes:
    """Magic, counts, doc_ids with a byte each that tells a null, lengths, control bytes and data bytes."""
    control, data = pack(ranks)
    null = np.array([d is None for d in doc_ids], np.uint8)
    ids = np.array([d or 0 for d in doc_ids], "<i8")
    head = np.array([len(doc_ids), len(ranks), len(control), len(data)], "<u8")
    return b"".join((MAGIC, head.tobytes(), null.tobytes(), ids.tobytes(), lengths.astype("<u4").tobytes(), control, data))


def read_block(block: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, lengths and ranks."""
    if block[:4] != MAGIC:
        raise ValueError("not a token block")
    docs, n, c, d = (int(x) for x in np.frombuffer(block, "<u8", 4, 4))
    at = 36
    null = np.frombuffer(block, np.uint8, docs, at)
    ids = np.frombuffer(block, "<i8", docs, at + docs)
    lengths = np.frombuffer(block, "<u4", docs, at + 9 * docs)
    at += 13 * docs
    if len(block) != at + c + d:
        raise ValueError("a token block is cut short")
    return [None if x else y for x, y in zip(null.tolist(), ids.tolist(), strict=True)], lengths, unpack(block[at : at + c], block[at + c :], n)


_loaded: dict[int, tuple] = kept_in_worker(__name__)


def _encoder(file: bytes):
    """The library's tokenizer with a cache of words, one for each worker process."""
    import os

    import regex

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    key = hash(file)
    if key not in _loaded:
        _loaded.clear()
        tokenizer = Tokenizer.from_str(file.decode())
        tokenizer.no_truncation()
        tokenizer.no_padding()
        special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        _loaded[key] = (tokenizer, {}, {}, regex.compile(_ANY).findall, special)
    return _loaded[key]


def _words(text: str, any_findall) -> list[str]:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return any_findall(text)
    return _LATIN.findall(text)


def encode_texts(texts: list[str | None], file: bytes, end_id: int) -> list[bytes]:
    """Little-endian 32-bit ids of each text with the end id, by the library; its model gets each word once while that is cached."""
    tokenizer, kept, late, any_findall, special = _encoder(file)
    model = tokenizer.model
    end = np.array([end_id], "<u4").tobytes()
    split = [None if t and any(s in t for s in special) else _words(t or "", any_findall) for t in texts]
    out = []
    for t, p in zip(texts, split, strict=True):
        if p is None:  # added tokens in the text: the library cuts them out itself
            out.append(np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() + end)
            continue
        found = list(map(kept.get, p))
        i = -1
        try:
            while True:
                i = found.index(None, i + 1)
                w = p[i]
                ids = late.get(w)
                if ids is None:
                    pieces = model.tokenize(w.encode().decode("latin-1").translate(_SHOWN))
                    ids = array("I", [x.id for x in pieces]).tobytes()
                    if len(w) > LONGEST:
                        pass
                    elif len(kept) < KEPT_WORDS:
                        kept[w] = ids
                    else:
                        if len(late) >= LATE_WORDS:
                            late.clear()
                        late[w] = ids
                found[i] = ids
        except ValueError:  # no more words that were missing
            pass
        found.append(end)
        out.append(b"".join(found))
    return out


def _narrow(ids: bytes, size: int) -> bytes:
    return ids if size > 1 << 16 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()


def _wide(ids: bytes, size: int) -> np.ndarray:
    return np.frombuffer(ids, "<u4" if size > 1 << 16 else "<u2")


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int) -> None:
    """Encodes docs and writes ``path``/blocks and ``path``/ranks."""
    docs = documents(docs)
    spark = docs.sparkSession
    with open(vocabulary, "rb") as f:
        file = f.read()
    from tokenizers import Tokenizer

    size = max(Tokenizer.from_str(file.decode()).get_vocab_size(with_added_tokens=True), end_id + 1)
    shipped = spark.sparkContext.broadcast(file)  # a vocabulary file of one or two megabytes

    def encoded(batches):
        for b in batches:
            ids = encode_texts(b.column(1).to_pylist(), shipped.value, end_id)
            n = [len(x) // 4 for x in ids]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array([_narrow(x, size) for x in ids], pa.binary())], ["doc_id", "n", "crc", "ids"])

    plain = f"{path}/plain"
    schema = "doc_id long, n long, crc long, ids binary"
    map_batches(docs, encoded, schema).write.option("compression", "zstd").parquet(plain)
    kept = spark.read.schema(schema).parquet(plain)

    def counted(batches):
        total = np.zeros(size, np.int64)
        for b in batches:
            total += np.bincount(_wide(b"".join(b.column(0).to_pylist()), size), minlength=size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])

    sums = map_batches(kept.select("ids"), counted, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # as many rows as ids
    by_rank = [r["id"] for r in sorted(sums, key=lambda r: (-r["n"], r["id"]))]
    spark.createDataFrame([(k, x) for k, x in enumerate(by_rank)], "rank long, id long").coalesce(1).write.parquet(f"{path}/ranks")
    rank = np.zeros(size, np.uint32)
    rank[by_rank] = np.arange(len(by_rank))
    ranks = spark.sparkContext.broadcast(rank)  # four bytes an id

    def coded(batches):
        part, block, before = TaskContext.get().partitionId(), 0, 0
        doc_ids: list[int | None] = []
        parts: list[np.ndarray] = []
        n = 0

        def made():
            lengths = np.array([len(x) for x in parts], np.int64)
            payload = write_block(doc_ids, lengths, ranks.value[np.concatenate(parts)])
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([block], pa.int64()), pa.array([before], pa.int64()), pa.array([n], pa.int64()), pa.array([payload], pa.binary())], ["part", "block", "before", "n", "payload"])

        for b in batches:
            for d, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                doc_ids.append(d)
                parts.append(_wide(x, size))
                n += len(parts[-1])
                if n >= BLOCK_IDS:
                    yield made()
                    block, before, n = block + 1, before + n, 0
                    doc_ids.clear()
                    parts.clear()
        if parts:
            yield made()

    total = kept.agg(F.sum("n").alias("n")).collect()[0]["n"] or 0
    files = max(1, -(-2 * total // FILE_BYTES), spark.sparkContext.defaultParallelism)
    order = ["doc_id", "n", "crc"]
    dealt = kept.repartitionByRange(files, *order).sortWithinPartitions(*order).select("doc_id", "ids")
    map_batches(dealt, coded, "part long, block long, before long, n long, payload binary").write.option("compression", "zstd").parquet(f"{path}/blocks")
    dropped(plain, spark)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of every document, from the files alone."""
    blocks = spark.read.schema("part long, block long, before long, n long, payload binary").parquet(f"{path}/blocks")
    codebook = np.array([r["id"] for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()], np.uint32)  # as many rows as ids
    shipped = spark.sparkContext.broadcast(codebook)

    def run(batches):
        for b in batches:
            for part, before, payload in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                doc_ids, lengths, ranks = read_block(payload)
                ids = shipped.value[ranks].astype("<u4")
                ends = np.cumsum(lengths, dtype=np.int64)
                starts = ends - lengths
                crc = [zlib.crc32(ids[s:e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(doc_ids), part, np.int64)), pa.array(doc_ids, pa.int64()), pa.array(starts + before), pa.array(lengths.astype(np.int64)), pa.array(crc, pa.int64())], ["part", "doc_id", "start", "n_tokens", "ids_crc32"])

    found = map_batches(blocks.select("part", "before", "payload"), run, "part long, doc_id long, start long, n_tokens long, ids_crc32 long")
    first = _first_ids(blocks.groupBy("part").agg(F.sum("n").alias("n")))
    return found.join(first, "part").select("doc_id", (F.col("start") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


def _first_ids(parts: DataFrame, group: int = 1024) -> DataFrame:
    """part and first, the ids of all files before it, from the sum n of each file; in two steps, so that no task has all files."""
    parts = parts.withColumn("group", F.floor(F.col("part") / group))
    before = Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = parts.groupBy("group").agg(F.sum("n").alias("n")).select("group", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("own", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(groups, "group").select("part", (F.col("base") + F.col("own")).alias("first"))


def token_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id and ids of every document, from the files."""
    blocks = spark.read.schema("part long, block long, before long, n long, payload binary").parquet(f"{path}/blocks")
    codebook = np.array([r["id"] for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()], np.uint32)
    shipped = spark.sparkContext.broadcast(codebook)

    def run(batches):
        for b in batches:
            for payload in b.column(0).to_pylist():
                doc_ids, lengths, ranks = read_block(payload)
                ids = shipped.value[ranks].astype(np.int32)
                offsets = np.r_[0, np.cumsum(lengths, dtype=np.int64)].astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], ["doc_id", "ids"])

    return map_batches(blocks.select("payload"), run, "doc_id long, ids array<int>")


def through_files(docs: DataFrame, vocabulary: str, end_id: int = 2, path: str | None = None) -> DataFrame:
    """Writes docs into a folder of their own below the shared one, or ``path``, and reads them back."""
    spark = docs.sparkSession
    path = path or new_folder(spark, "tokens")
    write_tokens(docs, path, vocabulary, end_id)
    return read_tokens(spark, path)
