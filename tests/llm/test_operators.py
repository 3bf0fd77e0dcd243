"""Operators against plain Python, on the small tables and on awkward rows."""

from __future__ import annotations

import hashlib
import math
import random
import zlib

import brute
import duckdb
import numpy as np
import public_tokenizers
import pytest
from comparing import differences, duck
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from filingmill.llm import (
    bpe, language, line_dedup, order_minhash, packing, quality, secrets, segment_search, token_files, url_filter)
from filingmill.llm.oracles import ORACLES
from filingmill.llm.queries import QUERIES, TOKENIZER
from filingmill.operators.materialize import shared_dir

SF = "/root/testdata/sf0.001"


def texts():
    return dict(duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert differences(QUERIES[name](spark, SF), duck(SF), ORACLES[name]) == []


# --- quality ------------------------------------------------------------------------


def test_base_counts(edges, edge_rows, nothing):
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    found = quality.base_counts(edges.select("doc_id", "text")).select("text", *columns).collect()
    assert len(found) == len(edge_rows)
    assert all(brute.base_counts(r["text"]) == tuple(r)[1:] for r in found)
    assert quality.base_counts(nothing.select("doc_id", "text")).count() == 0


def test_base_counts_of_random_texts(spark):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice(["a ", "b ", "cc ", "\n", "\x0b", "# ", "d\n", "\xa0"]) for _ in range(rng.randint(0, 60))))
            for i in range(400)]
    found = quality.base_counts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(brute.base_counts(r["text"]) == (
        r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"])
        for r in found)


def test_quality_tells_junk_from_prose(spark, nothing):
    good = [(i, " ".join(f"w{(i * 7 + j * j) % 50}" for j in range(400))) for i in range(100)]
    bad = [(100 + i, " ".join(f"###{(i * 5 + j * j) % 50}" for j in range(400))) for i in range(12)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(80)], "doc_id long, quality int")
    found = quality.judge_by_labels(docs, labels).collect()
    assert {r["doc_id"]: r["score"] >= quality.THRESHOLD for r in found} == {d: d < 100 for d, _ in good + bad}
    empty = nothing.select("doc_id", "text")
    assert quality.judge(empty, quality.fit(empty, empty)).count() == 0


# --- near-duplicates ----------------------------------------------------------------


def test_near_duplicates_equal_brute_force(spark):
    docs = texts()
    found = dict(map(tuple, QUERIES["op2_near_duplicates"](spark, SF).collect()))
    assert found == brute.near_classes(docs)[0]


def test_near_duplicates_of_awkward_rows(edges, edge_rows, nothing):
    found = dict(map(tuple, order_minhash.near_duplicates(edges).collect()))
    assert found == {d: {6: 5, 7: 5, 15: 14}.get(d, d) for d, *_ in edge_rows if d is not None}
    kept = order_minhash.one_of_each(edges)
    assert kept.columns == edges.columns
    assert sorted(r[0] or 0 for r in kept.select("doc_id").collect()) == [0, 0, 1, 2, 3, 4, 5, 8, 9, 10, 11, 12, 13, 14]
    assert order_minhash.near_duplicates(nothing).count() == 0
    assert order_minhash.one_of_each(nothing).count() == 0


def test_texts_that_repeat_an_id_are_judged_each_for_itself(spark):
    rng = random.Random(9)
    text = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(60))
    first, second, third, lone = text(), text(), text(), text()
    rows = [(1, first), (2, second), (2, third), (2, third), (3, third), (4, first), (4, second), (5, lone), (5, None), (None, lone)]
    kept = order_minhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    texts = [r["text"] for r in kept]
    # Every text stays once, and rows without an id or a text stay.
    assert sorted(t for t in texts if t) == sorted([first, second, third, lone, lone]) and texts.count(None) == 1
    assert {r["doc_id"] for r in kept if r["text"] == first} == {1} and {r["doc_id"] for r in kept if r["text"] == second} <= {2, 4}


def test_classes_around_a_shared_passage(spark):
    """Many texts share a passage, some pairs among them are near copies: only these meet."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    passage = [word() for _ in range(60)]
    docs = {}
    for i in range(0, 120, 2):
        own = [word() for _ in range(60)]
        docs[i] = " ".join(own[:30] + passage + own[30:])
        own[rng.randrange(60)] = word()
        docs[i + 1] = " ".join(own[:30] + passage + own[30:])
    got = order_minhash.near_duplicates(spark.createDataFrame(list(docs.items()), "doc_id long, text string"))
    assert dict(map(tuple, got.collect())) == brute.near_classes(docs)[0]


def test_a_root_is_looked_up_once_a_member(spark, monkeypatch):
    """The roots meet one row per text, not one per text and key; keys are spread out after that."""
    plans, write = [], order_minhash.materialize

    def noted(rows, label):
        if label == "mixed":
            plans.append(rows._jdf.queryExecution().optimizedPlan().toString())
        return write(rows, label)

    monkeypatch.setattr(order_minhash, "materialize", noted)
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text), (2, text + " x"), (3, text + " y z"), (4, "other words")], "doc_id long, text string")
    assert dict(map(tuple, order_minhash.near_duplicates(docs).collect())) == {1: 1, 2: 1, 3: 1, 4: 4}
    assert len(plans) == 2 and all(-1 < p.find("Generate explode") < p.find("LeftOuter") for p in plans)


@pytest.mark.parametrize("block", [order_minhash.BLOCK, 16])
def test_classes_around_a_hub(spark, block):
    """Many variants are near copies of one text in the middle of the ids, but not of each other."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    original, docs = [word() for _ in range(104)], {}
    for i in [*range(150), *range(151, 301)]:
        own = list(original)
        place = rng.randrange(5, 45)
        for at in (place, place + rng.randrange(10, 50)):
            own[at] = word()
        docs[i] = " ".join(own)
    docs[150] = " ".join(original)
    got = order_minhash.near_duplicates(
        spark.createDataFrame(list(docs.items()), "doc_id long, text string"), **({} if block == order_minhash.BLOCK else {"block": block}))
    assert dict(map(tuple, got.collect())) == brute.near_classes(docs)[0] == dict.fromkeys(docs, 0)


def test_bitmaps_leave_out_no_close_pair():
    rng = np.random.default_rng(5)
    for size in (3, 40, 3000, 20_000):
        base = rng.integers(0, 1 << 63, size, np.int64)
        sets = []
        for _ in range(30):
            kept = base[rng.random(size) > rng.choice([0.02, 0.08, 0.15])]
            sets.append(np.r_[kept, rng.integers(0, 1 << 63, rng.integers(0, size // 8 + 1), np.int64)].view(np.uint64))
        ids = np.arange(30)
        a, b = order_minhash.close_pairs(
            ids, ids, np.zeros(30, int), np.array([len(x) for x in sets]), [order_minhash.parity_bits(x) for x in sets], 0.8)
        found = {frozenset(p) for p in zip(a.tolist(), b.tolist())}
        true = {frozenset((i, j)) for i in range(30) for j in range(i) if len(sets[i]) and
                order_minhash.similarity(sets[i], sets[j]) >= 0.8}
        assert true <= found


def test_similarity_is_the_best_alignment():
    rng = random.Random(2)
    for _ in range(300):
        a = [rng.choice("abcdefgh") for _ in range(rng.randint(1, 40))]
        b = [rng.choice("abcdefgh") if rng.random() < 0.03 else x for x in a if rng.random() > 0.02]
        hashed = lambda w: order_minhash.labelled_kmers(np.array([hash(x) for x in w], np.int64))
        ka, kb = brute.kmers(" ".join(a)), brute.kmers(" ".join(b))
        n = brute.aligned(ka, kb)
        true = n / (len(ka) + len(kb) - n) if ka and kb else 0
        assert order_minhash.similarity(hashed(a), hashed(b)) == pytest.approx(true if true >= 0.8 else 0)


def test_components(spark):
    chain = [(i, i + 1) for i in range(50)] + [(100, 200), (300, 200), (300, 400)]
    found = dict(map(tuple, order_minhash.components(spark.createDataFrame(chain, "a long, b long")).collect()))
    assert found == {i: 0 for i in range(51)} | {100: 100, 200: 100, 300: 100, 400: 100}


# --- URLs ---------------------------------------------------------------------------


URLS = ["http://a.net/x", "http://net/", "http://xnet/", "https://A.EXAMPLE.net/en/7", "http://example.net", "http://a.org/fr/1",
        "https://m.example.com/de/1?x=/en/", "https://freebets.test/", "https://casinojackpot.test/a", "http://h?q", None, "",
        "no scheme", "ftp://h.test#x/y", "http://ordinary-words.test/reading", "http://" + "q" * 3000 + ".test/"]


def test_urls(spark):
    pages = spark.createDataFrame(
        [(i, u, "<p>ordinary words for reading, words and reading of ordinary free pages</p>", "x") for i, u in enumerate([*URLS, URLS[0]])],
        "page_id long, url string, html string, words string")
    found = {r["page_id"]: r for r in url_filter.judge(pages).collect()}
    assert len(found) == len(URLS) + 1

    def plain(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = next(iter(__import__("re").findall(r"^[^/?#]*", rest)), "")
        path = __import__("re").match(r"[^?#]*", rest[len(host):])[0]
        host = host.lower()
        fits = [r for _, r in url_filter.RULES if (
            host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/"):])]
        return host, path, max(fits, key=len, default=None)

    assert all((found[i]["host"], found[i]["path"], found[i]["rule"]) == plain(u) for i, u in enumerate(URLS))
    assert found[7]["words"] == ["free", "bets", "test"]
    empty = pages.limit(0)
    assert url_filter.judge(empty).count() == 0


def plain_verdicts(found, html):
    """{page_id: (score, verdict)} by naive Bayes on the words of the rows that a rule decides."""
    import re
    from collections import Counter

    pages = Counter(w for h in html for w in re.findall(r"[^\W\d_]+", re.sub(r"<[^>]*>", " ", h or "").lower()))
    vocabulary = set(pages) | set(url_filter.UNWANTED)
    action = {r: a for a, r in url_filter.RULES}
    classes = {a: Counter(w for r in found if action.get(r["rule"]) == a for w in r["words"]) for a in ("block", "allow")}
    sizes = {a: sum(c.values()) for a, c in classes.items()}
    asked = {w for r in found for w in r["words"]}
    classes["block"].update({w: url_filter.BLOCKED for w in url_filter.UNWANTED if w in asked})
    sizes["block"] += url_filter.BLOCKED * len(url_filter.UNWANTED)

    def share(w, a):
        page = (pages[w] + url_filter.UNSEEN) / (sum(pages.values()) + url_filter.UNSEEN * (len(vocabulary) + 1))
        return url_filter.MIXED * page + (1 - url_filter.MIXED) * classes[a][w] / max(1, sizes[a])

    n = Counter(action.get(r["rule"]) for r in found)
    prior = math.log((n["block"] + url_filter.PRIOR[0]) / (n["allow"] + url_filter.PRIOR[1]))
    out = {}
    for r in found:
        score = prior + sum(math.log(share(w, "block") / share(w, "allow")) for w in r["words"])
        out[r["page_id"]] = score, action.get(r["rule"]) or ("block" if score > 0 else "allow")
    return out


def test_verdicts_equal_plain_naive_bayes(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    found, html = QUERIES["op3_url_filters"](spark, SF).collect(), [r["html"] for r in pages.collect()]
    true = plain_verdicts(found, html)
    assert len(found) == len(html) == len(true)
    for r in found:
        score, verdict = true[r["page_id"]]
        assert r["score"] == pytest.approx(score, abs=1e-3)
        assert r["verdict"] == verdict or abs(score) < 1e-3 and r["rule"] is None
    assert {r["verdict"] for r in found if r["rule"] is None}


def test_classes_are_learned_from_rules(spark):
    rules = (("block", "bad.test/"), ("allow", "good.test/"))
    urls = [f"http://bad.test/spin/{i}" for i in range(30)] + [f"http://good.test/read/{i}" for i in range(30)]
    urls += ["http://new.test/spin", "http://new.test/read", "http://new.test/casino", "http://new.test/" + "x" * 3000]
    pages = spark.createDataFrame([(i, u, "<p>spin read new test</p>") for i, u in enumerate(urls)] + [
        (None, urls[60], None), (60, urls[60], None)], "page_id long, url string, html string")
    found = url_filter.judge(pages, rules).collect()
    assert len(found) == 66
    verdict = {r["page_id"]: r["verdict"] for r in found}
    assert [verdict[i] for i in (60, 61, 62, None)] == ["block", "allow", "block", "block"]


def test_split_is_the_most_probable(spark):
    rng = random.Random(4)
    words = {"a": 5, "ab": 9, "abc": 2, "b": 3, "bc": 6, "ca": 4, "cab": 1}
    total, unseen = 40, -math.log(40)
    for _ in range(200):
        name = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 8)))
        logp = lambda w: math.log(words[w] / total) if w in words else unseen - 2.3 * len(w)
        known = {(i, j - i): logp(name[i:j]) for i in range(len(name)) for j in range(i + 1, len(name) + 1) if name[i:j] in words}

        def best(rest):
            return max(((logp(rest[:i]) + best(rest[i:])[0], [rest[:i], *best(rest[i:])[1]]) for i in range(1, len(rest) + 1)),
                       default=(0.0, []))

        split = url_filter.split_name(name, known, unseen)
        assert "".join(split) == name and sum(map(logp, split)) == pytest.approx(best(name)[0])


# --- language -----------------------------------------------------------------------


def test_language_accuracy_on_held_out(spark):
    found = QUERIES["op4_language_id"](spark, "/root/testdata/sf0.01").collect()
    lang = dict(duckdb.sql("select doc_id, lang from '/root/testdata/sf0.01/documents.parquet'").fetchall())
    out = [r for r in found if r["held_out"]]
    assert {r["doc_id"] for r in out} == {d for d in lang if zlib.crc32(str(d).encode()) % 4 == 2}
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in out]) > 0.97
    assert np.mean([r["rejected"] for r in found]) < 0.01
    assert all(0 <= r["score"] <= 1 for r in found)


def test_every_language_is_a_class(spark):
    """More languages than 64, some of them with fewer documents than all others."""
    rng = random.Random(6)
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 280)]
    own = {f"l{i:02}": letters[4 * i:4 * i + 4] for i in range(70)}
    text = lambda lang: " ".join("".join(rng.choices(own[lang], k=4)) for _ in range(20))
    rows = [(text(lang), lang) for i, lang in enumerate(own) for _ in range(10 if i < 64 else 6)]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string")
    model = language.fit(docs)
    assert model.languages == tuple(own)
    fresh = spark.createDataFrame([(text(lang), lang) for lang in own for _ in range(3)], "text string, lang string")
    found = language.predict(fresh, model).select("row.lang", "lang_pred").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in found if r["lang"] >= "l64"]) > 0.8
    # With so many classes that the total is reached every one keeps a share of the sample.
    counts = language.sample_ids(docs, 5).groupBy("lang").count().collect()
    assert {r["lang"]: r["count"] for r in counts} == dict.fromkeys(own, 5)


def test_language_of_awkward_rows(edges, edge_rows, nothing):
    model = language.fit(edges)
    found = language.predict(edges, model).select("row.doc_id", "row.text", "lang_pred", "score", "rejected").collect()
    assert len(found) == len(edge_rows)
    for r in found:
        blank = r["text"] is None or not any(c.isalpha() for c in r["text"])
        assert (r["lang_pred"] == "und") == blank and (r["score"] > 0) == (not blank) and (r["rejected"] or not blank)
    assert language.accepted(edges, model).columns == edges.columns
    empty = language.fit(nothing)
    assert language.predict(nothing, empty).count() == 0
    assert {r["lang_pred"] for r in language.predict(edges, empty).collect()} == {"und"}


@pytest.mark.parametrize("left_out", ["de", "en", "es", "fr"])
def test_texts_of_an_unlearned_language_are_rejected(spark, left_out):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text is not null and lang is not null")
    model = language.fit(docs.where(~language.held_out("doc_id") & (F.col("lang") != left_out)))
    found = language.predict(docs, model).where(
        (language.held_out("row.doc_id") | (F.col("row.lang") == left_out)) & (F.col("lang_pred") != "und"))
    share = dict(map(tuple, found.groupBy((F.col("row.lang") == left_out).alias("new")).agg(
        F.avg(F.col("rejected").cast("int"))).collect()))
    assert share[True] >= 0.8 and share[False] <= 0.02


def test_the_driver_gets_the_model_only(spark, monkeypatch, nothing):
    """The sample meets in the task that trains; what comes back does not depend on its texts."""
    docs = spark.createDataFrame(
        [(i, text * 20, lang) for i in range(20) for lang, text in [("en", "the house "), ("de", "das Haus ")]],
        "doc_id long, text string, lang string").withColumn("doc_id", F.monotonically_increasing_id())
    monkeypatch.setattr(type(docs), "toArrow", lambda self: pytest.fail("the sample reached the driver"))
    model = language.fit(docs)
    assert model.languages == ("de", "en") and model.logits.shape == (language.BUCKETS, 2) and model.runs.any(axis=1).all()
    assert language.fit(nothing).languages == ()


def test_too_many_languages_are_refused(spark):
    docs = spark.createDataFrame([(i, "some text", f"l{i}") for i in range(30)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="30 languages"):
        language.fit(docs, total=100)
    assert len(language.fit(docs, total=300).languages) == 30


# --- tokens -------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(TOKENIZER)


def test_encoder_equals_library(library):
    encoder, rng = bpe.Encoder(TOKENIZER), random.Random(6)
    pool = [*"abcdefgh ABC'sd\t\n\r\x0b\x0c\x1c\x85\xa0éÉñßİΣσ日本🙂ȩ́0½#$%_-​\xad", "<|endoftext|>", "'LL", "the", "tion", " Σ"]
    for _ in range(4000):
        text = "".join(rng.choice(pool) for _ in range(rng.randint(0, 25)))
        ids = [i for c in text.encode().split() for i in encoder.chunk(c.decode())]
        true = library.encode(text, add_special_tokens=False).ids
        assert ids == true and encoder.decode(ids) == library.decode(true, skip_special_tokens=False)


@pytest.mark.parametrize("path", [public_tokenizers.path("byte_bpe_50k.json")])
def test_words_of_another_vocabulary(path):
    """The prefix table agrees with merging step by step, whatever the vocabulary."""
    encoder, rng = bpe.Encoder(path), random.Random(1)
    for _ in range(300):
        word = tuple(encoder.letters[rng.randrange(97, 123)] for _ in range(rng.randint(1, 14)))
        assert encoder.word(word) == [encoder.vocab[t] for t in encoder.merged(word)]


def test_encoding_of_rows(edges, edge_rows, nothing, library):
    ids = {t: library.encode(t or "", add_special_tokens=False).ids for _, t, *_ in edge_rows}
    found = bpe.encoded(edges, TOKENIZER).select("row.text", "ids", "decoded").collect()
    assert len(found) == len(edge_rows)
    assert all(r["ids"] == ids[r["text"]] and r["decoded"] == library.decode(r["ids"], skip_special_tokens=False) for r in found)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert all(r["ids_sha256"] == sha(" ".join(map(str, ids[r["row"]["text"]]))) for r in bpe.digests(edges, TOKENIZER).collect())
    assert bpe.encoded(nothing, TOKENIZER).count() == 0


def test_token_files(spark, edges, edge_rows, nothing, library):
    root = f"{shared_dir(spark)}/tokens-test"
    token_files.write(edges, root, TOKENIZER, docs_per_shard=4)
    found = token_files.read(spark, root).orderBy("start").collect()
    order = sorted(edge_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start = 0
    for r, (doc_id, text, *_) in zip(found, order, strict=True):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        data = np.array(ids, "<u4").tobytes()
        assert tuple(r) == (doc_id, start, len(ids), zlib.crc32(data), data)
        start += len(ids)
    assert token_files.document(spark, root, 11) == [*library.encode(order[-5][1], add_special_tokens=False).ids, 1]
    assert token_files.document(spark, root, 99) is None
    with open(f"{root}/dictionary", "ab") as f:
        f.write(b"x")
    with pytest.raises(Exception, match="another dictionary"):
        token_files.read(spark, root).count()
    assert token_files.written(nothing, TOKENIZER).count() == 0


# --- lines --------------------------------------------------------------------------


def test_line_dedup(edges, edge_rows, nothing):
    true = brute.line_dedup([(d, t) for d, t, *_ in edge_rows if d is not None])
    found = line_dedup.drop_shared_lines(edges).collect()
    assert len(found) == len(edge_rows)
    for r in found:
        text = r["row"]["text"]
        whole = (len((text or "").split("\n")), 0, text or "")
        assert (r["n_lines"], r["n_dropped"], r["kept"]) == true.get(r["row"]["doc_id"], whole)
    kept = line_dedup.without_shared_lines(edges)
    assert kept.columns == edges.columns
    assert {r["text"] for r in kept.where("doc_id in (8, 1)").collect()} == {"own eight", None}
    assert kept.where("n_chars <> char_length(text)").count() == 0
    assert line_dedup.drop_shared_lines(nothing).count() == 0


@pytest.mark.parametrize("name", ["op5_bpe", "op8_token_files"])
def test_ids_of_a_table_equal_the_library(spark, library, name):
    ids = {d: library.encode(t or "", add_special_tokens=False).ids for d, t in texts().items()}
    for r in QUERIES[name](spark, SF).collect():
        own = ids[r["doc_id"]]
        if name == "op5_bpe":
            assert r["n_tokens"] == len(own) and r["ids_sha256"] == brute.sha(" ".join(map(str, own)))
            assert r["decoded_sha256"] == brute.sha(library.decode(own, skip_special_tokens=False))
        else:
            assert r["n_tokens"] == len(own) + 1
            assert r["ids_crc32"] == zlib.crc32(np.array([*own, 1], "<u4").tobytes())


@pytest.mark.parametrize("splits", [True, False])
def test_chunks_equal_the_library(library, splits):
    chunks, rng = token_files.Chunks(TOKENIZER), random.Random(3)
    assert chunks.splits
    chunks.splits = splits
    parts = ["the", "The", "THE", "a", "don't", "'s", "it's", "--", ".", "...", "x.", "X!?", "<|endoftext|>", "é", "É.", "日本", "1", "a1", "\x1f",
             "\u00a0", "_", "a_b", "abc'", "'", "🙂", "ß", "İ", "e\u0301"]
    words = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 5))).encode() for _ in range(3000)] + [b""]
    found = chunks.ids(words, token_files.Generations(1000))
    assert [np.frombuffer(f, "<u4").tolist() for f in found] == [library.encode(w.decode(), add_special_tokens=False).ids for w in words]


# --- packing ------------------------------------------------------------------------


def best_fit(items, capacity):
    """Best-fit by trying every open bin."""
    bins, out = [], {}
    for i in sorted(range(len(items)), key=lambda i: (-items[i][2], items[i][0], items[i][1], i)):
        _, _, n, source, cluster = items[i]
        fits = [(left, b) for b, (left, own) in enumerate(bins) if left >= n and not own & {("s", source), ("c", cluster)} - {("s", None), ("c", None)}]
        if not fits:
            bins.append((capacity, set()))
            fits = [(capacity, len(bins) - 1)]
        left, b = min(fits)
        out[i] = (b, capacity - left)
        bins[b] = (left - n, bins[b][1] | {("s", source), ("c", cluster)})
    return [out[i] for i in range(len(items))]


def test_packing_equals_trying_all_bins():
    rng = random.Random(5)
    for n in (1, 10, 300):
        items = [(i, 0, rng.randint(1, 100), rng.choice(["hot", "hot", "a", "b", None, f"s{i}"]), rng.choice([1, 2, None, i + 9]))
                 for i in range(n)]
        assert packing.pack_shard(items, 100) == best_fit(items, 100)


def test_packing_keeps_every_token_and_conflict(spark, edges, edge_rows, nothing):
    found = packing.pack(packing.measured(edges), capacity=100, pieces_per_shard=5).collect()
    words = {}
    for d, t, *_ in edge_rows:
        words[d] = words.get(d, 0) + len((t or "").split())
    got = {}
    for r in found:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["n_tokens"]
    assert got == words
    bins = {}
    for r in found:
        if r["bin_id"] is not None:
            bins.setdefault(r["bin_id"], []).append((r["start"], r["n_tokens"], r["doc_id"]))
    source = {d: s for d, _, _, s in edge_rows if d is not None}
    for own in bins.values():
        ends = [0]
        for start, n, _ in sorted(own):
            assert start == ends[-1]
            ends.append(start + n)
        assert ends[-1] <= 100
        held = [source[d] for *_, d in own if source.get(d)]
        assert len(held) == len(set(held))
    assert all(r["n_tokens"] == 0 for r in found if r["bin_id"] is None)
    assert packing.pack(packing.measured(nothing)).count() == 0


def test_alike_rows_and_long_documents_spread_over_shards(spark):
    sizes = []
    schema = "doc_id long, n_tokens long, source string, cluster long"
    alike = [(None, 7, "s", 1)] * 600 + [(5, 7, "s", 1)] * 600 + [(6, 100_000, None, None)]
    found = packing.pack(spark.createDataFrame(alike, schema).repartition(3), capacity=100, pieces_per_shard=100).collect()
    for r in found:
        sizes.append((r["bin_id"] >> 32, r["doc_id"]))
    shards = {s for s, _ in sizes}
    assert len(found) == 2200 and len(shards) == 22
    for of in (None, 5, 6):
        assert len({s for s, d in sizes if d == of}) >= 20
    assert max(sum(s == x for s, _ in sizes) for x in shards) < 250


# --- secrets ------------------------------------------------------------------------


def test_base_spans(spark, edges, edge_rows, nothing):
    rng = random.Random(9)
    parts = ["password", "Token", "api_key", "APIKEY", " ", ":", "=", "\"", "'", "abc", "é🙂", "hunter22", "AKIA", "ABCDEFGH12345678",
             "0123456789abcdef", "deadbeef", "\n", "secret"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").union(edges.select("doc_id", "text"))
    model = secrets.fit(docs)
    for r in secrets.scan(docs, model).collect():
        assert [(secrets.KINDS[s["kind"]], s["start"], s["end"]) for s in r["base"]] == brute.base_spans(r["row"]["text"])
    assert secrets.scan(nothing, secrets.fit(nothing)).count() == 0


def test_random_tokens_are_added_and_words_are_not(edges):
    model = secrets.fit(edges)
    found = {r["row"]["doc_id"]: r for r in secrets.scan(edges, model).where("row.doc_id is not null").collect()}
    text = found[13]["row"]["text"]
    got = [(secrets.KINDS[s["kind"]], text[s["start"]:s["end"]]) for s in found[13]["spans"]]
    assert got == [("assign", "token: xQ7_zP9+kW2vB8/mT4qL6sR1"), ("random", "Zx9Kq2Wv7Bt4Lm8Rn3Pd6")]
    assert found[4]["spans"] == []
    clean = secrets.redact(edges, model)
    assert clean.columns == edges.columns
    assert clean.where("doc_id = 13").first()["text"] == "<secret> and then <secret> more"
    assert clean.where("doc_id = 11").first()["text"] == "<secret> <secret>"
    assert clean.where("text is null").count() == 2 and clean.count() == edges.count()
    assert clean.where("doc_id = 13 and n_chars <> char_length(text)").count() == 0


# --- top-k --------------------------------------------------------------------------


def test_top_k(spark):
    rng = np.random.default_rng(1)
    vectors = {i: rng.integers(-3, 4, 12).tolist() for i in range(400)}
    vectors[7] = vectors[9] = vectors[50]
    rows = [(i, v) for i, v in vectors.items()] + [(None, [1] * 12), (900, None), (50, vectors[50]), (950, [1, 2]), (1000, [3, 4]), (1001, [])]
    df = spark.createDataFrame(rows, "vec_id long, v array<bigint>")
    vectors |= {950: [1, 2], 1000: [3, 4], 1001: []}
    true = sorted(brute.top_k(vectors))
    for block in (64, 8192):
        got = segment_search.top_inner_products(df, F.col("vec_id") % 50 == 0, query_block=3, block=block)
        assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got.collect()) == true
    assert segment_search.top_inner_products(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_scaled(spark):
    rows = [(0, [0.5, -0.001]), (1, [float("nan"), 1.0]), (2, [float("inf"), 1.0]), (3, [None, 1.0]), (4, None), (5, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert [r[0] for r in df.orderBy("vec_id").select(segment_search.scaled("embedding")).collect()] == [[128, -1], None, None, None, None, []]
