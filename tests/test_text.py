"""Cleaning functions against the cases that are easy to get wrong."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from filingmill.functions import coerce, listing_text as lt, text
from filingmill.operators import listings


def run(spark, fn, values):
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    return [r.out for r in df.select("i", fn(F.col("v")).alias("out")).orderBy("i").collect()]


CASES = [
    (text.employer_name, "  google   llc ", "GOOGLE LLC"),
    (text.employer_name, "Foo Co.UK", "FOO COUK"),
    (text.employer_name, "A Inc. B", "A INC B"),
    (text.employer_name, "Acme, Inc.", "ACME, INC"),
    (text.employer_name, "Acme Inc..", "ACME INC."),
    (text.employer_name, "\xa0Acme\tCorp.　", "ACME CORP"),
    (text.employer_name, "straße ltd.", "STRASSE LTD"),
    (text.employer_name, " None ", None),
    (text.employer_name, "#N/A", None),
    (text.employer_name, "\x1c\x1f", None),
    (text.employer_name, None, None),
    (text.job_title, "Engineer (Java)", "ENGINEER"),
    (text.job_title, "X-SENIOR (Java)", "X-SENIOR"),
    (text.job_title, "Dev-Senior", "DEV"),
    (text.job_title, "Dev-JR-SENIOR", "DEV"),
    (text.job_title, "Sr. Dev", "SENIOR DEV"),
    (text.job_title, "Sr.Dev", "SR.DEV"),
    (text.job_title, "mgr of mgrs", "MANAGER OF MGRS"),
    (text.job_title, "(all gone)", None),
    (text.job_title, "a (b) c (d", "A C (D"),
    (text.wage_level, " iii ", "III"),
    (text.wage_level, "V", None),
    (text.yes_no, " y", True),
    (text.yes_no, "N", False),
    (text.yes_no, "maybe", None),
    (text.date_text, "2025-1-3", "2025-01-03"),
    (text.date_text, "01/02/2024", "2024-01-02"),
    (text.date_text, "1-2-2024", "2024-01-02"),
    (text.date_text, "2024/5/06", "2024-05-06"),
    (text.date_text, " FY2020 ", "FY2020"),
    (text.date_text, "13/40/2020", "13/40/2020"),
    (text.date_text, "2024-02-30", "2024-02-30"),
    (text.date_text, "1/2-2024", "1/2-2024"),
    (text.date_text, "null", None),
    (text.year_of, "FY20", None),
    (text.year_of, "2024-01-01", 2024),
    (coerce.to_int, " 7 ", 7),
    (coerce.to_int, "5.0", None),
    (coerce.to_int, "", None),
    (coerce.to_bool, "Yes", True),
    (coerce.to_bool, "t", None),
    (coerce.to_bool, " FALSE ", False),
    (coerce.to_float, "abc", None),
    (coerce.to_text, "  ", None),
    (lt.company_text, " Acme   Corp ", "Acme Corp"),
    (lt.company_text, "12 school alumni work here", None),
    (lt.company_text, "Promoted", None),
    (lt.company_text, "$120K/yr", None),
    (lt.company_text, "3 days ago", None),
    (lt.company_text, "x" * 201, None),
    (lt.looks_like_location, None, True),
    (lt.looks_like_location, "San Francisco, CA", True),
    (lt.looks_like_location, "Acme · San Francisco, CA", False),
    (lt.looks_like_location, "Acme (Remote)", True),
    (lt.is_company_name, "A", False),
    (lt.is_company_name, "1,234 fans", False),
    (lt.is_company_name, "42", False),
    (lt.is_company_name, "show more", False),
    (lt.is_company_name, "3M", True),
    (lt.company_of_line, "Acme Corp · San Francisco, CA", "Acme Corp"),
    (lt.company_of_line, "New York, NY · Acme Corp", "Acme Corp"),
    (lt.company_of_line, "New York, NY", None),
    (lt.company_of_line, "Acme", "Acme"),
    (lt.company_slug, "https://www.linkedin.com/company/a%20b-c/jobs?x=1", "a b-c"),
    (lt.company_slug, "https://www.linkedin.com/company/c++", "c++"),
    (lt.company_slug, "https://www.linkedin.com/company/unavailable", None),
    (lt.company_slug, "https://www.linkedin.com/company/%zz", None),
    (lt.company_slug, None, None),
    (lt.is_junk_line, "Easy Apply", True),
    (lt.is_junk_line, "12 applicants", True),
    (lt.is_junk_line, "Acme", False),
    (lt.is_job_title_line, "Leads Ltd", False),
    (lt.is_job_title_line, "Full-Stack person", True),
    (lt.can_be_company_line, "Lead Partners", False),
    (lt.can_be_company_line, "Misleading Ltd", True),
    (lt.can_be_company_line, "Remote", False),
    (lt.can_be_company_line, "Remotely", True),
    (lt.length, "a😀", 3),
]


def test_cases(spark):
    for fn in dict.fromkeys(c[0] for c in CASES):
        mine = [(v, want) for f, v, want in CASES if f is fn]
        got = run(spark, fn, [v for v, _ in mine])
        assert list(zip([v for v, _ in mine], got)) == mine, fn.__name__


def test_percent_rounds_half_to_even(spark):
    pairs = [(n, t) for t in range(1, 130) for n in range(t + 1)]
    rows = spark.createDataFrame(pairs, "n long, t long").select(
        "n", "t", text.percent(F.col("n"), F.col("t")).alias("p")).collect()
    assert all(r.p == round(r.n / r.t * 100, 2) for r in rows)


def plain_employer(name):
    if name.strip() == "" or name.strip().lower() in text.PLACEHOLDERS:
        return None
    s = re.sub(r"\s+", " ", name.strip().upper())
    for suffix in text.SUFFIXES:
        s = s.replace(f" {suffix}.", f" {suffix}")
    return s.strip() or None


def test_names_equal_plain_python_on_random_text(spark):
    rng = random.Random(3)
    alphabet = list(" .,ab\t\xa0 \r\n\x1c") + ["inc.", " LLC.", " co.", "É", "ß", "n/a"]
    values = ["".join(rng.choices(alphabet, k=rng.randint(0, 8))) for _ in range(3000)]
    assert run(spark, text.employer_name, values) == [plain_employer(v) for v in values]


def test_client_id(spark):
    df = spark.createDataFrame(
        [(0, " 10.0.0.1 , 2.2.2.2", "h"), (1, None, "h"), (2, "", None)], "i int, x string, h string")
    out = df.orderBy("i").select(lt.client_id(F.col("x"), F.col("h"))).collect()
    assert [r[0] for r in out] == ["10.0.0.1", "h", "unknown"]


@pytest.mark.parametrize("a, b, want", [
    ("google", "google llc", 100), ("", "x", 0), ("abcd", "abxd", 75), ("same", "same", 100),
    ("SUPPLIER#0_", "SUPPLIER#01", 91)])
def test_partial_ratio(spark, a, b, want):
    from filingmill.functions.ratio import partial_ratio

    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(partial_ratio("a", "b")).first()[0] == want


def plain_ratio(a, b):
    """The score by the standard library's matcher, window by window."""
    from difflib import SequenceMatcher

    if not a or not b:
        return 0
    short, long = sorted((a, b), key=len)
    starts = {max(0, m.b - m.a) for m in SequenceMatcher(None, short, long).get_matching_blocks()}
    best = max(SequenceMatcher(None, short, long[s:s + len(short)]).ratio() for s in starts)
    return 100 if best > 0.995 else int(round(100 * best))


def test_partial_ratio_equals_the_matcher(spark):
    from filingmill.functions.ratio import partial_ratio

    rng = random.Random(12)
    word = lambda: rng.choice(["ACME", "acme", "Inc", "LLC", "é", "🙂", "of", "Data", "data", "X", "systems", "aa"])
    name = lambda n: " ".join(word() for _ in range(n))
    pairs = [(name(rng.randrange(1, 5)), name(rng.randrange(1, 8))) for _ in range(400)]
    pairs += [("".join(rng.choice("ab") for _ in range(rng.randrange(1, 12))), "".join(rng.choice("abc") for _ in range(20)))
              for _ in range(300)]
    # From 200 characters on frequent ones start no block.
    pairs += [(name(rng.randrange(1, 60)), name(rng.randrange(40, 90))) for _ in range(60)]
    pairs += [(b[30:30 + rng.randrange(1, 90)], b) for _, b in pairs[-60:]]
    pairs += [("", "x"), ("x", ""), (None, "x"), ("x", None), (None, None), ("same", "same"), ("x" * 300, "x" * 900)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string").repartition(3)
    found = {r.i: r.score for r in df.select("i", partial_ratio("a", "b").alias("score")).collect()}
    assert [(p, found[i], plain_ratio(*p)) for i, p in enumerate(pairs) if found[i] != plain_ratio(*p)] == []


# The listing patterns as a plain list of alternatives, each tried at every place.
PLAIN = {
    "junk": (r"^[•·\-–—]+$", r"^(be an early|easy apply|actively|get job alerts)", r"promoted jobs are ranked",
             r"how promoted", r"\d+\+?\s*results?\b", r"\bbe an early applicant\b",
             r"\d+\s*(benefit|connection|applicant|result|follower)s?\b",
             r"\b(ago|viewed|about|premium|easy apply|actively|posted|reposted)\b", r"^[\d,]+$", r"%",
             r"^(your feedback|show)"),
    "not_company": (r"^\d+\s+school alumni", r"^promoted$", r"^in\s+easy apply$", r"\$\d|\/yr|401\s*\(\s*k\s*\)",
                    r"^\d+\s+(day|week|month)s?\s+ago$"),
    "not_name": (r"followers|premium|insights|show\s+", r"\d{1,3}(,\d{3})+", r"^[\d,.\s]+$"),
    "place": (r"^$", r"\(remote\)|\(on-site\)|\(hybrid\)", r"(?s:^(?!.*·).*?)(?:,\s*[A-Z]{2}(\s|$|\)))"),
}
FRAGMENTS = (
    " ", "  ", "\n", "\t", "\xa0", "﻿", "·", "•", "–", ",", "%", "$", "/yr", "401 (k)", "(remote)", "(Hybrid", "1", "12", "123", ",456", "+",
    "results", "result", "follower", "followers", "Premium", "insights", "show ", "show", "Promoted", "promoted jobs are ranked",
    "how promoted", "be an early applicant", "be an early", "easy apply", "in", "actively", "get job alerts", "your feedback",
    "ago", "days", "day", "school alumni", "viewed", "about", "posted", "reposted", "x", "Acme", "CA", ", NY", "É", "ſ", "benefit")


def test_patterns_say_what_their_plain_alternatives_say(spark):
    rng = random.Random(11)
    lines = ["", "\n", "\n\n", *FRAGMENTS, *("".join(rng.choices(FRAGMENTS, k=rng.randint(1, 6))) for _ in range(6000))]
    v = F.col("v")
    plain = {n: v.rlike(lt._java("|".join(f"(?:{p})" for p in ps))) for n, ps in PLAIN.items()}
    spaced = F.btrim(F.regexp_replace(v, lt._java(r"\s+"), " "), F.lit(lt._SPACES))
    pairs = [
        (lt._has(v, lt.LINE_META), plain["junk"]), (lt._has(v, lt._any(*lt.NOT_COMPANY_TEXT)), plain["not_company"]),
        (lt._has(v, lt._any(*lt.NOT_IN_NAME)), plain["not_name"]), (lt.looks_like_location(v), plain["place"]),
        (lt.tidy(v), spaced)]
    rows = spark.createDataFrame([(x,) for x in lines], "v string").select(
        "v", *[F.struct(a.alias("a"), b.alias("b")).alias(f"p{i}") for i, (a, b) in enumerate(pairs)]).collect()
    assert [(r.v, i) for r in rows for i in range(len(pairs)) if r[f"p{i}"].a != r[f"p{i}"].b] == []


def test_element_texts_are_tidied_once_per_row(spark):
    texts = spark.createDataFrame([(1, 0, "Acme  Works · Boston, MA"), (2, 0, "Promoted"), (3, 0, None)], "card_id long, ord int, text string")
    out = listings.text_candidates(texts, listings.SELECTOR)
    plan = out._sc._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "simple")
    assert plan.count("regexp_replace(") == 1
    assert [tuple(r) for r in out.collect()] == [(1, listings.SELECTOR, 0, "Acme Works")]
