"""Links out of markup against a tokenizer that goes character by character."""

from __future__ import annotations

import html
import random
import re

import pytest
from pyspark.sql import functions as F

from filingmill.functions import html as markup
from filingmill.operators import listings

SPACE = " \t\n\r\f\x0b"


def plain_tag(page, i):
    """(name, attributes, place after the tag) of a tag whose name starts at ``i``; None if it never ends."""
    start = i
    while i < len(page) and page[i] not in SPACE + "/>":
        i += 1
    name, attributes = page[start:i].lower(), []
    while True:
        while i < len(page) and page[i] in SPACE + "/":
            i += 1
        if i >= len(page):
            return None
        if page[i] == ">":
            return name, attributes, i + 1
        start = i
        i += 1
        while i < len(page) and page[i] not in SPACE + "/>=":
            i += 1
        key, value, at = page[start:i].lower(), "", i
        while at < len(page) and page[at] in SPACE:
            at += 1
        if at < len(page) and page[at] == "=":
            i = at + 1
            while i < len(page) and page[i] in SPACE:
                i += 1
            if i < len(page) and page[i] in "\"'":
                end = page.find(page[i], i + 1)
                if end < 0:
                    return None
                value, i = page[i + 1:end], end + 1
            else:
                start = i
                while i < len(page) and page[i] not in SPACE + ">":
                    i += 1
                value = page[start:i]
            if i >= len(page):
                return None
        attributes.append((key, value))


def plain_links(page):
    out, inside, i = [], None, 0
    while i < len(page):
        after = page[i + 1:i + 2]
        if page[i] != "<" or not (after.isascii() and after.isalpha()) and after not in ("/", "!", "?"):
            if inside is not None:
                out[inside][2].append(page[i])
            i += 1
        elif page.startswith("<!--", i):
            ends = [page.find(e, i + 4) + len(e) for e in ("-->", "--!>") if page.find(e, i + 4) >= 0]
            short = [i + 4 + len(e) for e in (">", "->") if page.startswith(e, i + 4)]
            i = min(short or ends or [len(page)])
        elif after in ("!", "?") or after == "/" and not (page[i + 2:i + 3].isascii() and page[i + 2:i + 3].isalpha()):
            i = page.find(">", i) + 1 or len(page)
        else:
            closing = after == "/"
            tag = plain_tag(page, i + 1 + closing)
            if tag is None:
                break
            name, attributes, i = tag
            if name == "a":
                inside = None
                if not closing:
                    first = {}
                    for k, v in attributes:
                        first.setdefault(k, v)
                    inside = len(out)
                    out.append((first.get("href"), first.get("data-original-url"), []))
            elif not closing and name in markup.RAW_ELEMENTS:
                ends = [j for j in range(i, len(page)) if page[j:j + 2 + len(name)].lower() == f"</{name}"
                        and page[j + 2 + len(name):j + 3 + len(name)] in tuple(SPACE + "/>")]
                i = min(ends, default=len(page))
    read = lambda s: None if s is None else re.sub(r"&(#[xX]?[0-9a-fA-F]+|[a-zA-Z]+);", lambda m: html.unescape(m[0]), s)
    return [(read(a), read(b), read("".join(t))) for a, b, t in out]


def links_of(spark, pages):
    rows = spark.createDataFrame(list(enumerate(pages)), "i int, html string")
    found = dict(map(tuple, rows.select("i", markup.anchors(F.col("html"))).collect()))
    return [None if found[i] is None else [tuple(a) for a in found[i]] for i in range(len(pages))]


PAGES = [
    '<a href="/x">one</a> and <A\nHREF=\'/y\' >t<b>w</b>o</A>', '<a href=/plain/ class=x>z</a>',
    '<!-- <a href="/no">no</a> --><a href="/yes">yes', '<!--><a href="/short">s</a>-->', '<!-- <a href="/open">x</a>',
    '<script>"<a href=/s>s</a>"</script ><a href=/t>t</a>', '<img alt="<a href=/q>q</a>"><a title="a>b" href="/r">r</a>',
    '<a href="/1">one <a href="/2">two</a> three</a>', '<a href="/never ends', '<a data-x=it\'s href=/z>z</a>',
    '<a href="/a?x=1&amp;y=2&#38;z=&#x33;">A &lt;B&gt; &amp;amp; &Eacute; &nope; &#xD800;</a>', "<a>none</a><a href>empty</a>",
    '<abbr href="/no">no</abbr><a/href="/slash">s</a>', '<a href="/1" href="/2">first</a>', "", "no links < at > all </ a>",
    '<a data-original-url="/o">o</a>', '<a href="/c">x<!-- y -->z<style>p{}</style></a>', "<a href = >v</a><a ==x>w</a>",
    "<a href='&copy;&middot;'>&quot;&apos;</a>", '<a href="/n">3 < 4 &notanentity</a>', "<?x <a href=/p>?><a href=/q>q</a>",
    "<a href=/u>" + "x" * 200_000 + "</a>" + "<p title='y'>" * 20_000, "<a " + "b='c' " * 20_000 + "href=/many>m</a>",
    "<" * 30_000 + "<a href=/l>l</a>", "<!--" * 5_000, '<a href="' * 3_000, None,
]


def test_links_of_written_pages(spark):
    assert links_of(spark, PAGES) == [None if p is None else plain_links(p) for p in PAGES]


@pytest.mark.parametrize("seed", range(3))
def test_links_of_random_markup(spark, seed):
    rng = random.Random(seed)
    parts = ["<a", "</a", ">", " href", "=", '"', "'", "<!--", "-->", " ", "/", "<", "!", "x", "&amp;", "<script>", "</script>",
             "<b>", "<a href=/k>", "</a>", '<a href="/w">', "\n", "title", "?", "<a data-original-url='/o'>", "é", "<textarea>"]
    pages = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(1500)]
    found, true = links_of(spark, pages), [plain_links(p) for p in pages]
    assert [x for x in zip(pages, found, true) if x[1] != x[2]][:3] == []
    assert sum(map(len, true)) > 1000


def test_links_are_numbered_rows(spark):
    pages = spark.createDataFrame(
        [(1, '<a href="/x">x</a><a>none</a><a href="" data-original-url="/o">o</a>', "h"), (2, None, "h"), (2, "", "h"),
         (None, "<a href=/n>n</a>", "h")], "card_id long, html string, href string")
    rows = sorted(map(tuple, listings.page_links(pages).collect()), key=str)
    assert rows == [(1, 0, "/x", "x"), (1, 2, "/o", "o"), (None, 0, "/n", "n")]
    assert listings.page_links(pages.where("card_id = 9")).count() == 0


def test_an_anchor_is_cut_once(spark):
    pages = spark.createDataFrame([(1, "<a href='/company/x'>A &amp; B</a>")], "card_id long, html string")
    out = listings.page_links(pages)
    plan = out._sc._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "simple")
    # Once in the plan's only expression: the opening tag, and the tokens inside.
    assert plan.count("(?is)^" + markup._OPENING) == 1
    assert [tuple(r) for r in out.collect()] == [(1, 0, "/company/x", "A & B")]
