"""Token files: ids of every document, compressed one by one with a shared zstandard dictionary.

Documents are dealt to shards by ranges of their id and sorted inside them, so the shards in order
hold all documents in ascending id order. A task writes one file as its rows come: a frame per
document, then the index (id, end of its frame, number of tokens) and a footer with the place of
the index and the hash of the dictionary. The file's name is new for every attempt of a task, and
only the names that finished tasks return get into the manifest, a table that Spark commits; files
of lost or repeated attempts are never read. The dictionary is trained on a bounded sample.

Files are reached with pyarrow's file systems, so the folder may be local and shared, or in any
store that these open.
"""

from __future__ import annotations

import hashlib
import os
import re
import string
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators.materialize import shared_dir
from .common import Generations, bounded_sample, chunks_of, gathered, slices, worker_cache, worker_store

MAGIC = b"FMTOKENS"
# Footer: place of the index, documents, hash of the dictionary, magic.
_FOOTER = "<QQ32s8s"
DOCS_PER_SHARD = 1 << 14
# The dictionary: its size, how many documents are sampled, and the longest that train it.
DICTIONARY, SAMPLE, SAMPLE_CHARS = 112_640, 1000, 16_384
LEVEL = 3
CACHED_CHUNKS, CACHED_TAILS = 500_000, 10_000
# Letters, then punctuation.
_PLAIN = re.compile(rb"([A-Za-z]+)([!-/:-@\[-`{-~]*)")
_MANIFEST = "shard int, file string, documents long, tokens long, first_id long, last_id long"


class Chunks:
    """Ids of chunks of text, as little-endian unsigned 32-bit integers, from the tokenizers library.

    If a file's normaliser and splitter leave ASCII letters and the punctuation behind them as two
    pieces, lower-cased, the model is asked for these pieces; all other chunks go through the whole
    of the library, and so do all chunks of a file for which that does not hold.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.tails: dict[bytes, bytes] = {b"": b""}
        self.splits = self._splits()

    def _splits(self) -> bool:
        """Whether runs with every pair of letters, each with some punctuation, are cut in two as said."""
        lib = self.library
        marks = [t.content.encode() for t in lib.get_added_tokens_decoder().values()]
        if lib.normalizer is None or lib.pre_tokenizer is None or any(_PLAIN.fullmatch(m) for m in marks):
            return False
        tails = ["", *string.punctuation, *map("".join, zip(string.punctuation, string.punctuation[1:])), string.punctuation]
        for i, first in enumerate(string.ascii_letters):
            run = "".join(first + c for c in string.ascii_letters)
            for tail in tails[i % 4::4] + [""]:
                pieces = [run.lower(), tail][:1 + bool(tail)]
                cut = [p for p, _ in lib.pre_tokenizer.pre_tokenize_str(lib.normalizer.normalize_str(run + tail))]
                ids = [t.id for p in pieces for t in lib.model.tokenize(p)]
                if cut != pieces or ids != lib.encode(run + tail, add_special_tokens=False).ids:
                    return False
        return True

    def _piece(self, piece: bytes) -> bytes:
        return array("I", [t.id for t in self.library.model.tokenize(piece.decode())]).tobytes()

    def ids(self, chunks: list[bytes], cache: Generations) -> list[bytes]:
        """Ids of every chunk; those not in the cache are worked out and put there."""
        out = [*map(cache.get, chunks)]
        rest = []
        for i, known in enumerate(out):
            if known is None:
                match = _PLAIN.fullmatch(chunks[i]) if self.splits else None
                if match is None:
                    rest.append(i)
                    continue
                word, tail = match.groups()
                word = word.lower()
                own = cache.get(word)
                if own is None:
                    own = cache.young[word] = self._piece(word)
                if tail not in self.tails:
                    if len(self.tails) > CACHED_TAILS:
                        self.tails = {b"": b""}
                    self.tails[tail] = self._piece(tail)
                out[i] = cache.young[chunks[i]] = own + self.tails[tail] if tail else own
        found = self.library.encode_batch_fast([chunks[i].decode() for i in rest], add_special_tokens=False)
        for i, e in zip(rest, found):
            out[i] = cache.young[chunks[i]] = array("I", e.ids).tobytes()
        return out


def _chunks(path: str) -> Chunks:
    store = worker_store("tokenizers")
    if path not in store:
        store[path] = Chunks(path)
    return store[path]


def serialized(texts: pa.Array, tokenizer: str, end_id: int) -> Iterator[bytes]:
    """Ids of each text with the end id, as little-endian unsigned 32-bit integers.

    White space ends every piece of this tokenizer, so chunks between ASCII white space are
    encoded once per worker and batch; the cache is bounded and only saves time.
    """
    ends, places, chunks = chunks_of(texts)
    ids = _chunks(tokenizer).ids(chunks, worker_cache("token chunks", CACHED_CHUNKS))
    end = struct.pack("<I", end_id)
    for data in gathered(ids, places, ends):
        yield data + end


def _open(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root)


def dictionary_of(samples: list[bytes]) -> bytes:
    """A trained dictionary; the samples themselves where they are too few to train one."""
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY:]


def _codec(dictionary: bytes) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    if not dictionary:
        return zstandard.ZstdCompressor(level=LEVEL), zstandard.ZstdDecompressor()
    data = zstandard.ZstdCompressionDict(dictionary)
    data.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=data), zstandard.ZstdDecompressor(dict_data=data)


def write(docs: DataFrame, root: str, tokenizer: str, end_id: int = 1, docs_per_shard: int = DOCS_PER_SHARD) -> None:
    """Write ``docs`` (doc_id, text) as token files, manifest and dictionary under ``root``.

    Null and empty texts hold the end id alone. Ids ascend, null first; rows that repeat an id are
    ordered by their text. An empty table gives a manifest without files.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chosen = bounded_sample(own.select("doc_id").where("doc_id is not null"), F.col("doc_id"), SAMPLE).distinct()

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids = list(serialized(batch.column(1), tokenizer, end_id))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    short = own.join(F.broadcast(chosen), "doc_id").where(F.char_length("text") <= SAMPLE_CHARS)
    rows = short.mapInArrow(sampled, "doc_id long, ids binary").collect()
    dictionary = dictionary_of([bytes(r["ids"]) for r in sorted(rows)])
    digest = hashlib.sha256(dictionary).digest()
    store, path = _open(root)
    store.create_dir(path, recursive=True)
    with store.open_output_stream(f"{path}/dictionary") as f:
        f.write(dictionary)

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _open(root)
        number = TaskContext.get().partitionId()
        compress = _codec(dictionary)[0].compress
        ids, known, ends, counts, at, name, f = [], [], [], [], 0, f"{number:06d}-{uuid.uuid4().hex}.tokens", None
        for batch in slices(batches):
            f = f or store.open_output_stream(f"{path}/{name}")
            for doc_id, data in zip(batch.column(0).to_pylist(), serialized(batch.column(1), tokenizer, end_id)):
                frame = compress(data)
                f.write(frame)
                at += len(frame)
                ids.append(doc_id or 0)
                known.append(doc_id is not None)
                ends.append(at)
                counts.append(len(data) // 4)
        if f:
            for values, kind in ((ids, "<i8"), (known, "u1"), (ends, "<u8"), (counts, "<u4")):
                f.write(np.array(values, kind).tobytes())
            f.write(struct.pack(_FOOTER, at, len(ids), digest, MAGIC))
            f.close()
            with_id = [i for i, k in zip(ids, known) if k]
            yield pa.RecordBatch.from_pylist(
                [{"shard": number, "file": name, "documents": len(ids), "tokens": sum(counts),
                  "first_id": min(with_id, default=None), "last_id": max(with_id, default=None)}], _MANIFEST_ARROW)

    shards = max(1, -(-own.count() // docs_per_shard))
    dealt = own.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")
    dealt.mapInArrow(shard, _MANIFEST).write.parquet(f"{root}/manifest")


_MANIFEST_ARROW = pa.schema([
    ("shard", pa.int32()), ("file", pa.string()), ("documents", pa.int64()), ("tokens", pa.int64()),
    ("first_id", pa.int64()), ("last_id", pa.int64())])


def _index(f, digest: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    size = f.size()
    f.seek(size - struct.calcsize(_FOOTER))
    at, n, own, magic = struct.unpack(_FOOTER, f.read(struct.calcsize(_FOOTER)))
    if magic != MAGIC or own != digest:
        raise ValueError("not a token file, or written with another dictionary")
    f.seek(at)
    parts = [np.frombuffer(f.read(n * np.dtype(k).itemsize), k) for k in ("<i8", "u1", "<u8", "<u4")]
    return tuple(parts)


def read(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of every document, from the files alone.

    ``start`` counts the ids of all documents before; ``ids`` are the serialized ids.
    """
    manifest = spark.read.schema(_MANIFEST).parquet(f"{root}/manifest")
    # One row per shard: the running total is over the manifest, not over documents.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("file", F.coalesce(F.sum("tokens").over(before), F.lit(0)).cast("long").alias("start"))
    store, path = _open(root)
    with store.open_input_file(f"{path}/dictionary") as f:
        dictionary = f.read()
    digest = hashlib.sha256(dictionary).digest()

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _open(root)
        decompress = _codec(dictionary)[1].decompress
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with store.open_input_file(f"{path}/{name}") as f:
                    ids, known, ends, counts = _index(f, digest)
                    starts = start + np.r_[0, np.cumsum(counts.astype(np.int64))]
                    f.seek(0)
                    for a in range(0, len(ids), 512):
                        s = slice(a, min(a + 512, len(ids)))
                        begin = int(ends[a - 1]) if a else 0
                        block = f.read(int(ends[s][-1]) - begin)
                        cuts = np.r_[begin, ends[s].astype(np.int64)] - begin
                        data = [decompress(block[x:y], max_output_size=4 * int(c)) for x, y, c in zip(cuts, cuts[1:], counts[s])]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(ids[s], pa.int64(), mask=known[s] == 0), pa.array(starts[s], pa.int64()),
                             pa.array([len(d) // 4 for d in data], pa.int64()),
                             pa.array([zlib.crc32(d) for d in data], pa.int64()), pa.array(data, pa.binary())],
                            names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    tasks = max(1, manifest.count())
    return files.repartition(tasks, "file").mapInArrow(
        documents, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def document(spark: SparkSession, root: str, doc_id: int) -> list[int] | None:
    """The ids of one document: its shard by the manifest, its frame by the index."""
    own = spark.read.schema(_MANIFEST).parquet(f"{root}/manifest").where(
        (F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id)).orderBy("shard").limit(1).collect()
    store, path = _open(root)
    with store.open_input_file(f"{path}/dictionary") as f:
        dictionary = f.read()
    for row in own:
        with store.open_input_file(f"{path}/{row['file']}") as f:
            ids, known, ends, counts = _index(f, hashlib.sha256(dictionary).digest())
            for i in np.flatnonzero((ids == doc_id) & (known == 1))[:1]:
                begin = int(ends[i - 1]) if i else 0
                f.seek(begin)
                data = _codec(dictionary)[1].decompress(f.read(int(ends[i]) - begin), max_output_size=4 * int(counts[i]))
                return np.frombuffer(data, "<u4").tolist()
    return None


def written(docs: DataFrame, tokenizer: str, **settings) -> DataFrame:
    """Write ``docs`` into a new folder under the session's shared folder and read them back."""
    spark = docs.sparkSession
    root = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write(docs, root, tokenizer, **settings)
    return read(spark, root)
