"""Quality rules: base counts, then a hashed n-gram likelihood ratio of target and raw corpus.

Words and word pairs are hashed into buckets. One multinomial over the buckets is estimated from
trusted documents, one from all documents; the score of a document is the mean log ratio of its
n-grams, in units of 2**-20 as a whole number, so no order of summation changes it. The model is
one long per bucket, whatever the corpus size, and reaches the rows as a constant; scoring is a
projection without a join or a shuffle. All of it are built-in SQL functions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from .common import BLANKS, bind, long_table, bounded_sample, words_of

BUCKETS = 1 << 14
UNIT = 1 << 20
SYMBOLS = "#*$%&|<>"
# Documents below this mean log ratio are far less likely under the target than in the corpus.
THRESHOLD = -0.08
# A prime over the range of word hashes, so the pair's bucket is not the sum of the words' buckets.
PAIR_PRIME = 4294967311
# At most so many trusted documents make the target model.
TRUSTED = 20_000
# The raw corpus counts as so many n-grams of the target, which smooths its empty buckets.
PRIOR = 4 * BUCKETS
WINDOW = 5


def _repeated(hashes: Column) -> Column:
    """How many words lie in windows whose hash occurs twice or more."""
    def covered(places: Column) -> Column:
        gaps = F.transform(places, lambda p, i: F.least(
            F.lit(WINDOW), F.coalesce(F.get(places, i + 1) - p, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0), lambda a, g: a + g)

    def repeated(pairs: Column) -> Column:
        same = lambda x, i: F.coalesce(F.get(pairs, i)["h"] == x["h"], F.lit(False))
        return F.filter(pairs, lambda x, i: same(x, i - 1) | same(x, i + 1))

    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    places = bind(pairs, lambda p: F.array_sort(F.transform(repeated(p), lambda x: x["i"])))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(bind(places, covered))


def base_counts(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, any others) with words, the counts and ``base_failed``."""
    text = F.coalesce("text", F.lit(""))
    has_word = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    windows = bind(F.transform("words", lambda w: F.xxhash64(w)), lambda h: F.transform(
        F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(WINDOW)])))
    counted = docs.withColumns({
        "words": words_of(F.col("text")),
        "n_symbols": (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": bind(has_word, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
    }).withColumns({
        "n_words": F.size("words").cast("long"),
        "word_chars": F.char_length(F.translate(text, BLANKS, "")).cast("long"),
        "windows": F.when(F.size("words") >= WINDOW, windows).otherwise(F.array().cast("array<bigint>")),
    })
    counted = counted.withColumn("n_repeat_words", _repeated(F.col("windows")).cast("long"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return counted.withColumn("base_failed", failed).drop("windows")


def hashed(words: Column) -> Column:
    return F.transform(words, lambda w: F.crc32(w.cast("binary")))


def word_bucket(word: Column) -> Column:
    return (word % BUCKETS).cast("int")


def pair_bucket(first: Column, second: Column) -> Column:
    """The bucket of two neighbouring words, in this order."""
    return ((first * 31 + second * 17 + 7) % PAIR_PRIME % BUCKETS).cast("int")


def fit(docs: DataFrame, trusted: DataFrame, bound: int = TRUSTED) -> list[int]:
    """Log ratios of target and raw corpus per bucket, in units of 2**-20.

    ``trusted`` has the ``doc_id`` of trusted documents, of which at most ``bound`` are used.
    Raw counts are those of all documents.
    """
    ids = bounded_sample(trusted.where("doc_id is not null").select("doc_id").distinct(), F.col("doc_id"), bound)
    marked = docs.select("doc_id", hashed(words_of(F.col("text"))).alias("h")).join(
        F.broadcast(ids.withColumn("good", F.lit(1))), "doc_id", "left")
    buckets = F.concat(
        F.transform("h", word_bucket),
        F.transform(F.slice("h", F.lit(2), F.greatest(F.size("h") - 1, F.lit(0))),
                    lambda w, i: pair_bucket(F.get("h", i), w)))
    grams = marked.select("good", F.explode(buckets).alias("bucket"))
    counts = {r[0]: (r[1], r[2]) for r in grams.groupBy("bucket").agg(F.count("*"), F.count("good")).collect()}
    raw_total = sum(r for r, _ in counts.values())
    good_total = sum(g for _, g in counts.values())
    out = []
    for b in range(BUCKETS):
        raw, good = counts.get(b, (0, 0))
        p_raw = (raw + 1) / (raw_total + BUCKETS)
        p_good = (good + PRIOR * p_raw) / (good_total + PRIOR)
        out.append(round(UNIT * math.log(p_good / p_raw)))
    return out


def judge(docs: DataFrame, model: list[int], threshold: float = THRESHOLD) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with its counts, ``score`` and ``kept``.

    ``score`` is the mean log ratio of the document's words and word pairs, 0 without any.
    ``kept`` is false if ``base_failed``, else whether score >= threshold. Null texts have no
    words and fail the base. Rows with repeated or null ids are judged each for itself.
    """
    weights = long_table(model)
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(None).cast("long").alias("last"))

    def step(a: Column, w: Column) -> Column:
        single = a["sum"] + F.get(weights, word_bucket(w))
        return F.struct((single + F.coalesce(
            F.get(weights, pair_bucket(a["last"], w)), F.lit(0))).alias("sum"), w.alias("last"))

    total = F.aggregate(hashed(F.col("words")), start, step, lambda a: a["sum"])
    grams = F.greatest(2 * F.col("n_words") - 1, F.lit(0))
    limit = round(UNIT * threshold)
    return (
        base_counts(docs.select("doc_id", "text")).withColumn("total", total)
        .withColumn("kept", ~F.col("base_failed") & (F.col("total") >= limit * grams))
        .withColumn("score", F.when(grams > 0, F.col("total") / (UNIT * grams)).otherwise(F.lit(0.0)))
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                "base_failed", "kept", "score"))


def judge_by_labels(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """Fit on the documents labelled with quality 1 and judge all."""
    trusted = labels.where("quality = 1").select("doc_id")
    return judge(docs, fit(docs.select("doc_id", "text"), trusted), **settings)
