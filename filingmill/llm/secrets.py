"""Secret scans: three base patterns, and Markov models for secrets that no pattern names.

A character bigram model of random strings is trained on values that the base patterns found, one
of ordinary identifiers on the other tokens of a sample of documents. A token is added as a span
when its mean log-likelihood ratio is over the threshold. The trained model is one whole number
per pair of characters and reaches the rows as a constant. All of it are built-in SQL functions:
a span's place follows from the lengths of the pieces between the matches.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.materialize import materialize
from .common import bind, long_table, bounded_sample

KINDS = ("assign", "access", "hex", "random")
# Base patterns, group that must have so many characters, and that length.
PATTERNS = {
    "assign": (r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]"""
               r"""|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
WORD = r"[A-Za-z0-9+/_=-]{4,}"
UNIT = 1 << 20
# Mean log ratio per character pair from which a token counts as random.
THRESHOLD = 0.5
# At most so many documents with base matches, and so many others, train the models.
SAMPLE = 2000
_EMPTY = "array<struct<kind:int,start:int,end:int,value:string>>"


def _matches(text: Column, kind: int, pattern: str, group: int, least: int) -> Column:
    """Spans of one pattern, leftmost and non-overlapping, without those that are too short.

    A run of one character class can be sought by its least length at once: it is taken whole
    either way. The assignment has to be found first and measured then.
    """
    if not group:
        prefix, star, _ = pattern.rpartition("+")
        pattern = f"{prefix}{{{least - (4 if pattern.startswith('AKIA') else 0)},}}" if star else pattern
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    pieces = F.split(text, pattern, -1)

    def place(at: Column, m: Column, i: Column, lengths: Column) -> Column:
        start = at["next"] + F.get(lengths, i)
        return F.struct((start + F.char_length(m)).alias("next"), F.concat(
            at["starts"], F.array(start)).alias("starts"))

    def spans(m: Column, v: Column, gaps: Column) -> Column:
        start = F.struct(F.lit(0).alias("next"), F.array().cast("array<int>").alias("starts"))
        indexed = F.transform(m, lambda x, i: F.struct(x.alias("m"), i.alias("i")))
        starts = F.aggregate(indexed, start, lambda at, x: place(at, x["m"], x["i"], gaps), lambda at: at["starts"])
        return bind(starts, lambda s: F.filter(
            F.transform(m, lambda x, i: F.struct(
                F.lit(kind).alias("kind"), F.get(s, i).alias("start"),
                (F.get(s, i) + F.char_length(x)).alias("end"), F.get(v, i).alias("value"))),
            lambda x: F.char_length(x["value"]) >= least))

    all_of = bind(found, lambda m: bind(values, lambda v: bind(
        F.transform(pieces, lambda p: F.char_length(p)), lambda gaps: spans(m, v, gaps))))
    return F.when(text.rlike(pattern), all_of).otherwise(F.array().cast(_EMPTY))


def base_spans(text: Column) -> Column:
    """All base spans by start, then kind; none for null."""
    own = F.coalesce(text, F.lit(""))
    each = [_matches(own, i, *PATTERNS[k]) for i, k in enumerate(KINDS[:3])]
    by_place = lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["kind"] - b["kind"])
    return F.array_sort(F.concat(*each), by_place)


def _pairs(token: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.char_length(token) - 1), lambda i: F.substring(token, i, F.lit(2)))


def _pair_counts(tokens: DataFrame) -> dict[str, int]:
    """At most one row per pair of the alphabet reaches the driver."""
    pairs = tokens.where(F.char_length("token") >= 2).select(F.explode(_pairs(F.col("token"))).alias("pair"))
    return {r[0]: r[1] for r in pairs.where(F.col("pair").rlike(f"^[{ALPHABET}]{{2}}$")).groupBy("pair").count().collect()}


def fit(docs: DataFrame, sample: int = SAMPLE) -> list[int]:
    """Log ratios of the random and the ordinary model per pair of characters.

    The random model starts as the uniform one, the ordinary one with half a count a pair, so an
    empty table gives a defined model too.
    """
    own = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    holders = own.select("doc_id", F.transform(base_spans(F.col("text")), lambda s: s["value"]).alias("found"))
    # Written, as the patterns run over all texts.
    holding = materialize(holders.where(F.size("found") > 0), "holders")
    found = bounded_sample(holding, F.col("doc_id"), sample)
    random = _pair_counts(found.select(F.explode("found").alias("token")))
    ids = bounded_sample(own.select("doc_id"), F.col("doc_id"), sample).distinct()
    rest = own.join(F.broadcast(ids), "doc_id").select("text")
    for pattern, _, _ in (PATTERNS["assign"], (r"AKIA[A-Z0-9]{16,}", 0, 0), (r"[0-9a-f]{24,}", 0, 0)):
        rest = rest.withColumn("text", F.regexp_replace("text", pattern, " "))
    ordinary = _pair_counts(rest.select(F.explode(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("token")))
    size, prior = len(ALPHABET), 1000.0
    out = []
    for a in ALPHABET:
        all_random = sum(random.get(a + b, 0) for b in ALPHABET)
        all_ordinary = sum(ordinary.get(a + b, 0) for b in ALPHABET)
        for b in ALPHABET:
            p = (random.get(a + b, 0) + prior / size) / (all_random + prior)
            q = (ordinary.get(a + b, 0) + 0.5) / (all_ordinary + 0.5 * size)
            out.append(round(UNIT * math.log(p / q)))
    return out


def _randomness(token: Column, weights: Column) -> Column:
    """Sum of the log ratios of a token's character pairs."""
    place = lambda c: F.instr(F.lit(ALPHABET), c) - 1
    return F.aggregate(_pairs(token), F.lit(0).cast("long"), lambda a, p: a + F.get(
        weights, place(F.substring(p, 1, 1)) * len(ALPHABET) + place(F.substring(p, 2, 1))))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, model: list[int], threshold: float = THRESHOLD) -> DataFrame:
    """Every row of ``docs`` as (row, base, spans); spans are (kind, start, end, value) by start.

    ``base`` holds the base spans, ``spans`` these and tokens of 20 characters or more whose mean
    log ratio is at least ``threshold`` and which touch no base span. Places are code points, the
    end exclusive; ``kind`` counts along ``KINDS``. Null and empty texts have no spans. Rows are
    scanned each for itself, so repeated or null ids do not matter, nor do other columns.
    """
    weights, limit = long_table(model), round(UNIT * threshold)
    text = F.coalesce(F.col("row.text"), F.lit(""))
    tokens = _matches(text, 3, TOKEN.removesuffix("{20,}") + "+", 0, 20)
    random = F.filter("tokens", lambda t: (
        _randomness(t["value"], weights) >= limit * (F.char_length(t["value"]) - 1))
        & ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    by_place = lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["kind"] - b["kind"])
    return (
        docs.select(F.struct("*").alias("row"))
        .withColumns({"base": base_spans(F.col("row.text")), "tokens": tokens})
        .withColumn("spans", F.array_sort(F.concat("base", random), by_place))
        .select("row", "base", "spans"))


def digest(scanned: DataFrame) -> DataFrame:
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(k))).cast("long")
    return scanned.select(
        "row.doc_id", *[count(k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, model: list[int], mask: str = "<secret>", **settings) -> DataFrame:
    """``docs`` with every span replaced by ``mask``; ``n_chars``, if there, counts the new text.

    Overlapping spans are one. Texts without a span stay as they are, null included.
    """
    scanned = scan(docs, model, **settings)
    text = F.col("row.text")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(state: Column, s: Column) -> Column:
        fresh = s["start"] >= state["at"]
        part = F.when(fresh, F.array(F.substring(text, state["at"] + 1, s["start"] - state["at"]), F.lit(mask)))
        return F.struct(
            F.greatest(state["at"], s["end"]).alias("at"),
            F.concat(state["parts"], F.coalesce(part, F.array().cast("array<string>"))).alias("parts"))

    tail = lambda state: F.concat(F.array_join(state["parts"], ""), F.substring(text, state["at"] + 1, F.char_length(text)))
    clean = F.when(F.size("spans") == 0, text).otherwise(F.aggregate("spans", start, step, tail))
    out = scanned.withColumn("text", clean)
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.size("spans") > 0, F.char_length("text").cast(
            docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return out.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
