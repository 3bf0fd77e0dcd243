"""URL filters: listed rules first, then naive Bayes over the words that names are made of.

Names are the letter runs of host and path. A name is split into words by the most probable path
through a unigram model (Viterbi), whose counts are those of the words on all pages. Only the
substrings of the distinct names are looked up in the counts, by an equi-join, so the vocabulary
may be of any size and is never gathered. Multinomial naive Bayes compares, for the words of a URL,
two classes that are trained on the URLs a rule decides: blocked and allowed ones. A short list of
words of unwanted hosts counts as blocked, too. Words that neither class has fall back to the counts
of the pages, alike in both. Log ratios are whole numbers, so sums do not depend on their order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.materialize import materialize
from .common import ascii_lower

# Rules of the contract, (action, host and path).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
# Labelled words of unwanted hosts: gambling, adult, pills, credit, advertising, junk and piracy.
UNWANTED = tuple("""
    bet bets betting bingo casino gambling jackpot lottery poker roulette slots
    adult escort nude porn sex webcam xxx
    cialis diet pharmacy pills steroids viagra
    forex loan loans payday
    adserver ads affiliate banner clicks popup track tracker tracking
    cheap crack free hack keygen phishing prize replica scam spam torrent warez win winner
""".split())
UNIT = 1 << 20
# Blocked and allowed urls that the prior starts from.
PRIOR = (1, 9)
# Share of the pages' words in either class, so that words which neither has count for nothing.
MIXED = 0.1
# What a word counts for that no page has.
UNSEEN = 0.01
# What a labelled word counts for in the unigram model, at least, and as blocked.
LABELLED, BLOCKED = 5, 1


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or a url without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.char_length(host) + 1, F.char_length(rest)), r"^[^?#]*", 0)
    return ascii_lower(host), path


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """(action, rule) of the longest rule that fits; null if none does."""
    whens = []
    for action, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, slash, tail = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + tail)
        whens.append(F.when(fits, F.struct(F.lit(action).alias("action"), F.lit(rule).alias("rule"))))
    return F.coalesce(*whens)


def names(host: Column, path: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.concat_ws("/", host, path)), F.lit(r"\p{L}+"), F.lit(0))


def word_counts(html: DataFrame) -> DataFrame:
    """(word, n): words in the text of all pages (column ``html``), and the labelled ones."""
    text = F.lower(F.regexp_replace(F.coalesce("html", F.lit("")), r"<[^>]*>", " "))
    words = html.select(F.explode(F.regexp_extract_all(text, F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    found = words.groupBy("word").agg(F.count("*").alias("n"))
    labelled = html.sparkSession.createDataFrame([(w,) for w in UNWANTED], "word string")
    return found.join(F.broadcast(labelled).withColumn("own", F.lit(LABELLED)), "word", "full").select(
        "word", F.coalesce("n", F.lit(0)).alias("n"), F.greatest("n", "own").alias("weight"))


def split_name(name: str, known: dict[tuple[int, int], float], unseen: float) -> list[str]:
    """The most probable words; ``known`` has the log probability by (start, length).

    Any other run of letters is worth ``unseen`` less 2.3 a letter, so the best one that ends at a
    place begins where the best value plus 2.3 a letter is highest, and that is carried along.
    """
    ending: dict[int, list[tuple[int, float]]] = {}
    for (start, length), value in known.items():
        ending.setdefault(start + length, []).append((start, value))
    best, back = [0.0], [0]
    ahead = (0.0, 0)
    for end in range(1, len(name) + 1):
        score, at = max([(ahead[0] + unseen - 2.3 * end, ahead[1]), *(
            (best[start] + value, start) for start, value in ending.get(end, ()))])
        best.append(score)
        back.append(at)
        ahead = max(ahead, (score + 2.3 * end, end))
    out, end = [], len(name)
    while end:
        out.append(name[back[end]:end])
        end = back[end]
    return out[::-1]


def split_names(distinct: DataFrame, counts: DataFrame) -> DataFrame:
    """(name, words) for every distinct ``name``."""
    total, size, longest = counts.agg(
        F.coalesce(F.sum("weight"), F.lit(0)), F.count("*"), F.coalesce(F.max(F.char_length("word")), F.lit(1))).first()
    whole = total + size + 1
    chars = F.char_length("name")
    placed = distinct.select("name", F.explode(F.sequence(F.lit(0), chars - 1)).alias("start")).select(
        "name", "start", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), chars - F.col("start")))).alias("length"))
    parts = placed.withColumn("word", F.expr("substring(name, start + 1, length)"))
    found = parts.join(counts, "word").groupBy("name").agg(
        F.collect_list(F.struct("start", "length", "weight")).alias("found"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [
                split_name(name, {(f["start"], f["length"]): math.log(f["weight"] / whole) for f in found or []}, -math.log(whole))
                for name, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(words, pa.list_(pa.string()))], names=["name", "words"])

    return distinct.join(found, "name", "left").mapInArrow(split, "name string, words array<string>")


def word_ratios(seen: DataFrame, counts: DataFrame) -> DataFrame:
    """(word, ratio): log of blocked to allowed for every ``word`` of ``seen`` (word, blocked, allowed)."""
    total, size = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    listed = seen.sparkSession.createDataFrame([(w, BLOCKED) for w in UNWANTED], "word string, listed int")
    every = seen.join(F.broadcast(listed), "word", "left").withColumn(
        "blocked", F.col("blocked") + F.coalesce("listed", F.lit(0))).drop("listed")
    blocked, allowed = seen.agg(F.coalesce(F.sum("blocked"), F.lit(0)), F.coalesce(F.sum("allowed"), F.lit(0))).first()
    blocked += BLOCKED * len(UNWANTED)
    page = MIXED * (F.coalesce("n", F.lit(0)) + UNSEEN) / (total + UNSEEN * (size + 1))
    share = lambda c, n: page + (1 - MIXED) * F.col(c) / max(1, n)
    ratio = F.log(share("blocked", blocked)) - F.log(share("allowed", allowed))
    return every.join(counts.select("word", "n"), "word", "left").select(
        "word", F.round(UNIT * ratio).cast("long").alias("ratio"))


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, words, score) for every row of ``pages``.

    ``pages`` has page_id, url and html. A rule's verdict wins; else the url is blocked when the
    log ratio of its words and the prior, that of urls which rules block and allow, is over 0. Urls
    without a name are judged by the prior. Null ids, repeated rows and null html are rows like any
    other.
    """
    counts = materialize(word_counts(pages.select("html")), "words")
    host, path = host_and_path(F.col("url"))
    # The row's number only holds the exploded names of one row together.
    rows = pages.select("page_id", "url", F.monotonically_increasing_id().alias("row")).select(
        "row", "page_id", host.alias("host"), path.alias("path")).select(
        "*", rule_of(F.col("host"), F.col("path"), rules).alias("found"), names(F.col("host"), F.col("path")).alias("names"))
    # How often urls that are blocked, and allowed, by a rule have a name.
    of = {n: (F.col("found.action") == a) for n, a in (("blocked", "block"), ("allowed", "allow"))}
    asked = materialize(rows.select("found", F.explode("names").alias("name")).groupBy("name").agg(
        *[F.count_if(c).alias(n) for n, c in of.items()]), "asked")
    split = materialize(split_names(asked.select("name"), counts), "names")
    words = asked.join(split, "name").select("blocked", "allowed", F.explode("words").alias("word")).groupBy("word").agg(
        F.sum("blocked").alias("blocked"), F.sum("allowed").alias("allowed"))
    ratios = word_ratios(materialize(words, "class-words"), counts)
    scores = materialize(split.select("name", "words", F.explode("words").alias("word")).join(ratios, "word").groupBy("name").agg(
        F.first("words").alias("words"), F.sum("ratio").alias("ratio")), "scores")
    blocked, allowed = rows.agg(*[F.count_if(c) for c in of.values()]).first()
    prior = round(UNIT * math.log((blocked + PRIOR[0]) / (allowed + PRIOR[1])))
    each = rows.select("row", "page_id", "host", "path", "found", F.posexplode_outer("names").alias("at", "name"))
    summed = each.join(scores, "name", "left").groupBy("row", "page_id", "host", "path", "found").agg(
        F.coalesce(F.sum("ratio"), F.lit(0)).alias("ratio"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "words"))), lambda x: x["words"])).alias("words"))
    total = F.col("ratio") + prior
    return summed.select(
        "page_id", "host", "path", F.col("found.rule").alias("rule"),
        F.coalesce("found.action", F.when(total > 0, "block").otherwise("allow")).alias("verdict"),
        "words", (total / UNIT).alias("score"))
