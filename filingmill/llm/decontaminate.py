"""Benchmark decontamination with one Aho-Corasick automaton over normalised test items.

Texts are normalised to words: A-Z lower-cased, then maximal runs of characters other than ASCII
non-alphanumerics. A window is ``WINDOW`` consecutive words of an item; an item of fewer words is
one window as a whole. Every word that some window has gets one code point, so a window is a short
string, a document is a string with one code point a word, and the place of a match is a word's
number. The automaton reads each document once and reports every occurrence of every window;
the words it covers are mapped back to code points of the original text.

The automaton holds at most about ``PAIR_WORDS`` words of pairs of a window and an item (and
``CHARS`` characters of them), so its size in a worker and its number of code points are bounded.
More of them, chosen by a hash, are scanned one slice after the other over the written result of
the slice before. Documents are never shuffled.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from ..operators.materialize import materialize
from .common import ascii_lower, worker_store

WINDOW = 10
# Bounds of one automaton: a node of some 70 bytes and at most a code point a word, and their text.
PAIR_WORDS, CHARS = 1_000_000, 1 << 25

# Bytes of UTF-8: letters and digits of ASCII, lower-cased, and all bytes beyond ASCII are words.
_NORMAL = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_SPAN = StructType([StructField("start", IntegerType()), StructField("end", IntegerType())])
_FIELDS = [
    StructField("n_words", LongType()), StructField("hits", ArrayType(_SPAN)),
    StructField("items", ArrayType(StringType())), StructField("spans", ArrayType(_SPAN))]
_ARROW_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(window, item): the distinct windows of every item, words joined by a space; ``item`` is text.

    Items without words have none. The windows of an item without an id count with a null item.
    """
    spaced = F.regexp_replace(ascii_lower(F.coalesce("text", F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")
    words = items.select(
        F.col("item_id").cast("string").alias("item"), F.array_remove(F.split(spaced, " "), "").alias("words"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - window + 1, F.lit(1)))
    return words.where(F.size("words") > 0).select(
        "item", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("words", i, window), " "))).alias("window")
    ).distinct().select("window", "item")


def _automaton(slice_of_windows: bytes) -> tuple[dict[bytes, str], ahocorasick.Automaton]:
    """The code point of every word, and the automaton of the windows with their items."""
    table = pa.ipc.open_stream(slice_of_windows).read_all()
    codes: dict[bytes, str] = {}
    found: dict[str, list] = {}
    for window, item in zip(table.column("window").cast(pa.binary()).to_pylist(), table.column("item").to_pylist()):
        key = ""
        for word in window.split(b" "):
            code = codes.get(word)
            if code is None:
                # From 1 on, without the surrogates; 0 is any word that no window has.
                n = len(codes) + 1
                code = codes[word] = chr(n if n < 0xD800 else n + 0x800)
            key += code
        found.setdefault(key, []).append(item)
    automaton = ahocorasick.Automaton()
    for key, own in found.items():
        automaton.add_word(key, (len(key), tuple(x for x in own if x is not None)))
    automaton.make_automaton()
    return codes, automaton


def _worker_automaton(key: str, slice_of_windows: bytes) -> tuple:
    """The automaton of this Python process; only the last one is kept."""
    store = worker_store("benchmark automaton")
    if store.get("key") != key:
        store.clear()
        store.update(key=key, made=_automaton(slice_of_windows))
    return store["made"]


def _merged(hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of hit words from ranges in any order; ranges that touch become one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(hits):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _places(text: bytes, hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code points of the original text that runs of words reach over, end exclusive."""
    starts, ends = np.array([m.span() for m in _WORD.finditer(text.decode())]).T
    return [(int(starts[a]), int(ends[b - 1])) for a, b in hits]


def _pairs(values: list[list[tuple[int, int]]]) -> pa.Array:
    return pa.array([[{"start": a, "end": b} for a, b in x] for x in values], _ARROW_SPANS)


def _scanner(key: str, slice_of_windows: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, automaton = _worker_automaton(key, slice_of_windows)
        code = codes.get
        for batch in batches:
            texts = batch.column(0).field("text").cast(pa.binary()).to_pylist()
            before = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())
            counts, hits, items, spans = [], [], [], []
            for text, (own, named) in zip(texts, before):
                words = (text or b"").translate(_NORMAL).split()
                counts.append(len(words))
                own, named = [(x["start"], x["end"]) for x in own], set(named)
                fresh = False
                for end, (length, of) in automaton.iter("".join([code(w, "\0") for w in words])) if len(automaton) else ():
                    start, fresh = end + 1 - length, True
                    # Occurrences come in the order of their ends, so most extend the last run.
                    if own and own[-1][0] <= start <= own[-1][1]:
                        own[-1] = (own[-1][0], max(own[-1][1], end + 1))
                    else:
                        own.append((start, end + 1))
                    named.update(of)
                own = _merged(own) if fresh else own
                hits.append(own)
                items.append(sorted(named))
                spans.append(_places(text, own) if own else [])
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(counts, pa.int64()), _pairs(hits), pa.array(items, pa.list_(pa.string())),
                _pairs(spans)], names=["row", "n_words", "hits", "items", "spans"])
    return run


def scan(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, pair_words: int = PAIR_WORDS, chars: int = CHARS,
) -> DataFrame:
    """Every row of ``docs`` as (row, n_words, hits, items, spans).

    ``hits`` are the runs of words inside any occurrence of a window, as word numbers from 0, end
    exclusive; ``spans`` the same runs as code points of ``text``; ``items`` the ids, as sorted
    text, of the items with an occurring window. The table ``items`` has ``item_id`` and ``text``.
    Null and empty texts have no words. Rows are read each for itself, so null or repeated ids and
    other columns do not matter; repeated items count once. Without items nothing is hit.
    """
    spark = docs.sparkSession
    own = materialize(windows(items, window), "windows")
    n, size = own.agg(F.count("*"), F.coalesce(F.sum(F.length("window")), F.lit(0))).first()
    slices = max(1, -(-n * window // pair_words), -(-size // chars))
    rows = docs.select(
        F.struct("*").alias("row"), F.array().cast(ArrayType(_SPAN)).alias("hits"),
        F.array().cast("array<string>").alias("items"))
    schema = StructType([rows.schema["row"], *_FIELDS])
    dealt = own.withColumn("_slice", F.pmod(F.xxhash64("window", "item"), F.lit(slices)))
    for i in range(slices):
        # Bounded as said above; sent to every worker.
        table = dealt.where(F.col("_slice") == i).select("window", "item").toArrow()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        rows = rows.mapInArrow(_scanner(uuid.uuid4().hex, sink.getvalue().to_pybytes()), schema)
        if i + 1 < slices:
            rows = materialize(rows, "scanned").select("row", "hits", "items")
    return rows


def digests(scanned: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of what ``scan`` found."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return scanned.select(
        F.col("row.doc_id").alias("doc_id"), "n_words", n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"))


def without_passages(docs: DataFrame, items: DataFrame, mark: str = "<removed>", **settings) -> DataFrame:
    """``docs`` with every hit run of words replaced by ``mark``; all other columns as they are."""
    found = scan(docs, items, **settings)
    cut = F.aggregate(
        F.col("spans"), F.struct(F.lit("").alias("text"), F.lit(0).alias("at")),
        lambda s, x: F.struct(
            F.concat(s["text"], F.substr(F.col("row.text"), s["at"] + 1, x["start"] - s["at"]), F.lit(mark)).alias("text"),
            x["end"].alias("at")),
        lambda s: F.concat(s["text"], F.substr(F.col("row.text"), s["at"] + 1)))
    text = F.when(F.size("spans") > 0, cut).otherwise(F.col("row.text"))
    return found.select(*[text.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])
