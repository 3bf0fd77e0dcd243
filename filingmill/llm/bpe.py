"""BPE encoding by dynamic programming over prefixes, and decoding.

For every prefix of a word BPE has exactly one last token. It is found among the tokens that end
there - walked along the suffix links of an automaton over the vocabulary - as the one that is
compatible with the last token of the prefix before it: merging the pair from scratch must give
just these two tokens. Back-pointers from the end then spell the word's ids. Pair tests are
remembered, so a new word costs a few look-ups per character.

Normalisation, word splitting and word ends follow the tokenizer file (NFC, one blank for white
space, per-character lower case; contractions, runs of letters, single digits, runs of others).
White space ends every piece, so texts are cut at ASCII white space and each distinct chunk is
encoded once per worker; the cache is bounded and only saves time.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .common import Generations, chunks_of, gathered, slices, worker_cache, worker_store

# Fixed value: the tokenizer's split pattern.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
# Per generation: chunks between white space, and words in them; and of remembered pair tests.
CACHED_CHUNKS, CACHED_WORDS, CACHED_PAIRS = 300_000, 200_000, 600_000


def byte_letters() -> list[str]:
    """The printable stand-in of every byte: itself if printable in Latin-1, else 256 and on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Encoder:
    """Encodes words and whole texts with the vocabulary of a tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        model = held["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in held["added_tokens"]}
        self.names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.letters = byte_letters()
        merges = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.ranks = {(a, b): rank for rank, (a, b) in enumerate(merges)}
        self.symbols = {t: self._symbols(t) for t in self.vocab}
        self.marks = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)))
        self.compatible: dict[tuple[str, str], bool] = {}
        self.words = Generations(CACHED_WORDS)
        self._build()

    def _symbols(self, token: str) -> tuple[str, ...]:
        if self.end and token.endswith(self.end) and len(token) > len(self.end):
            body = token[: -len(self.end)]
            return (*body[:-1], body[-1] + self.end)
        return tuple(token)

    def merged(self, symbols: tuple[str, ...]) -> list[str]:
        """Plain BPE: the lowest-ranked pair first, the leftmost of equals."""
        parts = list(symbols)
        while len(parts) > 1:
            rank, at = min((self.ranks.get(p, 1 << 60), i) for i, p in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _build(self) -> None:
        """The automaton: a trie of the tokens that are their own encoding, with suffix links."""
        self.next: list[dict[str, int]] = [{}]
        token: list[str | None] = [None]
        for t, symbols in self.symbols.items():
            at = 0
            for s in symbols:
                if s not in self.next[at]:
                    self.next[at][s] = len(self.next)
                    self.next.append({})
                    token.append(None)
                at = self.next[at][s]
            token[at] = t
        self.link = [0] * len(self.next)
        #: Per state all tokens ending there, longest first, with their lengths.
        self.ending: list[list[tuple[str, int]]] = [[] for _ in self.next]
        queue = [0]
        for at in queue:
            for s, to in self.next[at].items():
                back = self.link[at]
                while back and s not in self.next[back]:
                    back = self.link[back]
                self.link[to] = self.next[back].get(s, 0) if at else 0
                own = [(token[to], len(self.symbols[token[to]]))] if token[to] else []
                self.ending[to] = own + self.ending[self.link[to]]
                queue.append(to)
        self.valid: dict[str, bool] = {}

    def _fits(self, before: str | None, token: str) -> bool:
        if before is None:
            known = self.valid.get(token)
            if known is None:
                known = self.valid[token] = self.merged(self.symbols[token]) == [token]
            return known
        known = self.compatible.get((before, token))
        if known is None:
            both = self.symbols[before] + self.symbols[token]
            known = self.compatible[before, token] = self.merged(both) == [before, token]
        return known

    def word(self, symbols: tuple[str, ...]) -> list[int]:
        """Ids of one word, given as symbols of which the last carries the word end."""
        last: list[tuple[str | None, int]] = [(None, 0)]
        at = 0
        for i, s in enumerate(symbols, 1):
            while at and s not in self.next[at]:
                at = self.link[at]
            at = self.next[at].get(s, 0)
            for token, n in self.ending[at]:
                # A prefix without a last token of its own is never joined.
                if (i == n or last[i - n][0] is not None) and self._fits(last[i - n][0], token):
                    last.append((token, i - n))
                    break
            else:
                last.append((None, i))
        out, i = [], len(symbols)
        while i:
            token, back = last[i]
            if token is None:
                raise ValueError(f"no encoding for {''.join(symbols)!r}")
            out.append(self.vocab[token])
            i = back
        return out[::-1]

    def tidy(self) -> None:
        """Keep what is remembered within its bounds."""
        self.words.turn()
        if len(self.compatible) > CACHED_PAIRS:
            self.compatible.clear()

    def piece(self, piece: str) -> list[int]:
        """Ids of a normalised piece; pieces recur in many chunks."""
        known = self.words.get(piece)
        if known is None:
            stand = [self.letters[b] for b in piece.encode()]
            stand[-1] += self.end
            known = self.words.young[piece] = self.word(tuple(stand))
        return known

    def plain(self, text: str) -> list[int]:
        """Ids of a text without special tokens."""
        text = unicodedata.normalize("NFC", text)
        text = "".join(c.lower() for c in text) if not text.isascii() else text.lower()
        pieces = PIECES.findall(text)
        return self.piece(pieces[0]) if len(pieces) == 1 else [i for p in pieces for i in self.piece(p)]

    def chunk(self, text: str) -> list[int]:
        """Ids of a text; special tokens in it are themselves."""
        if not self.special or not self.marks.search(text):
            return self.plain(text)
        out, at = [], 0
        for m in self.marks.finditer(text):
            out += self.plain(text[at:m.start()])
            out.append(self.special[m[0]])
            at = m.end()
        return out + self.plain(text[at:])

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by blanks, as this file has no decoder of its own."""
        return " ".join(self.names[i] for i in ids)


def worker_encoder(path: str) -> Encoder:
    """One encoder per Python worker, kept between its tasks."""
    store = worker_store("bpe")
    if path not in store:
        store[path] = Encoder(path)
    return store[path]


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """Every row of ``docs`` as (row, ids, decoded): the ids of ``text`` and the decoded text.

    Null and empty texts have no ids and decode to the empty text. Rows are encoded each for
    itself, so ids of documents and other columns do not matter.
    """
    return _mapped(docs, path, [StructField("ids", ArrayType(LongType())), StructField("decoded", StringType())], _both)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Every row of ``docs`` as (row, n_tokens, ids_sha256, decoded_sha256)."""
    return _mapped(docs, path, [
        StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()),
        StructField("decoded_sha256", StringType())], _hashes)


def _both(encoder: Encoder, ids: list[str], decoded: list[bytes], counts: np.ndarray) -> list:
    return [[[int(i) for i in x.split()] for x in ids], [x.decode() for x in decoded]]


def _hashes(encoder: Encoder, ids: list[bytes], decoded: list[bytes], counts: np.ndarray) -> list:
    return [counts, [hashlib.sha256(x).hexdigest() for x in ids], [hashlib.sha256(x).hexdigest() for x in decoded]]


def _coded(encoder: Encoder, chunk: bytes) -> tuple[bytes, bytes, int]:
    """Ids and decoded text of a chunk, each with a blank in front, and the number of ids."""
    ids = encoder.chunk(chunk.decode())
    return (b" " + " ".join(map(str, ids)).encode(), b" " + encoder.decode(ids).encode(), len(ids)) if ids else (b"", b"", 0)


def _mapped(docs: DataFrame, path: str, fields: list[StructField], make) -> DataFrame:
    rows = docs.select(F.struct("*").alias("row"))
    schema = StructType([rows.schema["row"], *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(path)
        for batch in slices(batches):
            cache = worker_cache(f"bpe chunks {path}", CACHED_CHUNKS)
            encoder.tidy()
            ends, places, chunks = chunks_of(batch.column(0).field("text"))
            known = [*map(cache.get, chunks)]
            for i, held in enumerate(known):
                if held is None:
                    known[i] = cache.young[chunks[i]] = _coded(encoder, chunks[i])
            ids, decoded, n = zip(*known) if known else ((), (), ())
            # The blank in front of a text's first chunk goes.
            texts = [[x[1:] for x in gathered(list(v), places, ends)] for v in (ids, decoded)]
            before = np.r_[0, np.cumsum(np.array(n, np.int64)[places.to_numpy()])][ends]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, t) for c, t in zip(make(encoder, *texts, np.diff(before)), types)]],
                names=["row", *names])

    kinds = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int64())}
    names = [f.name for f in fields]
    types = [kinds.get(n, pa.string()) for n in names]
    return rows.mapInArrow(run, schema)
