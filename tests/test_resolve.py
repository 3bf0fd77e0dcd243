"""Resolution layers on small tables, and substring and vector search against brute force."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registry
from filingmill.config import Embedding, Semantic
from filingmill.operators import containment, nearest, semantic
from filingmill.operators.containment import best_containing, piece_index, refreshed
from filingmill.plans import embed
from filingmill.plans.resolve import Memory, check, resolve
from filingmill.plans.search import search

EMPLOYER = ("employer_name string, total_h1b_certified int, earliest_decision_date date, "
            "latest_decision_date date, last_active_year int, h1b_dependent boolean")
ALIAS = "primary_employer_name string, alias_name string, usage_count int"
NEAR = "query_id string, employer_name string, total_h1b_certified long, similarity double, place int"


def employers(spark, *rows):
    return spark.createDataFrame([(n, t, None, None, None, None) for n, t in rows], EMPLOYER)


def test_layers_in_order(spark):
    emp = employers(spark, ("GOOGLE LLC", 9), ("ACME INC", 3), ("ACME INC OF OHIO", 50), ("BIG TATA CO", None))
    aliases = spark.createDataFrame([
        ("GOOGLE LLC", "GOOGL", 1), ("NOBODY", "GOOGL", 0), ("ACME INC OF OHIO", "ACME INC", 7),
        ("NOBODY", "TATA", 5), ("GOOGLE LLC", "TATA", 1)], ALIAS)
    names = ["   ", "  google   llc ", "acme inc", "googl", "google", "tata", "zzz", "None", None, "google"]
    df = spark.createDataFrame(list(enumerate(names)), "i int, raw_name string")
    rows = check(resolve(df, emp, aliases)).orderBy("i").collect()
    got = [(r.match_type, r.employer_name, r.match_confidence) for r in rows]
    assert got == [
        ("invalid_input", None, None), ("exact", "GOOGLE LLC", 1.0), ("exact", "ACME INC", 1.0),
        ("alias", "GOOGLE LLC", 1.0), ("fuzzy", "GOOGLE LLC", 1.0),
        # The chosen alias row names an unknown employer, so the substring layer answers.
        ("fuzzy", "BIG TATA CO", 1.0), (None, None, None), ("invalid_input", None, None),
        ("invalid_input", None, None), ("fuzzy", "GOOGLE LLC", 1.0)]
    assert [r.h1b_count for r in rows][5] == 0
    assert [r.found for r in rows] == [r.sponsors_h1b for r in rows]


# query, neighbours as (total, similarity), expected confidence or None for a miss
SEMANTIC = [
    ("facebook", [(8000, 0.88)], 0.88),
    ("xyz", [(3, 0.70)], None),
    ("acme", [(500, 0.81), (12, 0.79)], None),
    ("stripe", [(900, 0.86), (5, 0.80)], 0.774),
    ("nvidia", [(4000, 0.95), (2, 0.60)], 0.95),
    ("big", [(3, 0.82), (90000, 0.80)], None),
    # 0.95 - 0.85 is a little below 0.1 in binary.
    ("q", [(1, 0.95), (100000, 0.85)], 0.855),
    ("z", [(5, 0.72), (90000, 0.71)], None),
    ("edge", [(5, 0.76), (9, 0.70)], 0.684),
]


def neighbour_rows(cases):
    return [(q, f"{q}-{i}", t, s, i) for q, near, _ in cases for i, (t, s) in enumerate(near, 1)]


def test_semantic_decisions(spark):
    near = spark.createDataFrame(neighbour_rows(SEMANTIC), NEAR)
    for ranked in (near, semantic.rerank(near)):
        got = {r.query_id: r for r in semantic.decide(ranked).collect()}
        for q, _, want in SEMANTIC:
            if want is None:
                assert got[q].employer_name is None and got[q].confidence is None
            else:
                assert got[q].employer_name == f"{q}-1"
                assert got[q].confidence == pytest.approx(want)


def test_rerank_equals_plain_python(spark):
    rng, cfg = random.Random(5), Semantic()
    cases = []
    for i in range(400):
        sims = sorted((round(rng.uniform(0.66, 0.9), rng.choice([2, 3])) for _ in range(rng.randint(1, 10))), reverse=True)
        cases.append((f"q{i}", [(rng.choice([0, 3, 50, 9000]), s) for s in sims], None))

    def expected(near):
        order = list(range(len(near)))
        if len(near) < 2 or near[0][1] - near[1][1] >= cfg.tight_gap:
            return order
        floor = max(cfg.threshold - 0.05, min(near[0][1], near[1][1]) - 0.02)
        pool = [i for i in order[:6] if near[i][1] >= floor]
        if len(pool) < 2:
            return order
        best = max(pool, key=lambda i: near[i][1] * math.log1p(max(near[i][0], 0)))
        if near[best][1] < cfg.threshold:
            return order
        return [best] + [i for i in order if i != best]

    out = semantic.rerank(spark.createDataFrame(neighbour_rows(cases), NEAR)).orderBy("query_id", "place").collect()
    got = {}
    for r in out:
        got.setdefault(r.query_id, []).append(int(r.employer_name.split("-")[1]) - 1)
    assert got == {q: expected(near) for q, near, _ in cases}


def like(name, query):
    """Plain matching of %query% with LIKE syntax, ignoring case."""
    import re

    out, chars = "", iter(f"%{query.lower()}%")
    for c in chars:
        out += ".*" if c == "%" else "." if c == "_" else re.escape(next(chars) if c == "\\" else c)
    return re.fullmatch(out, name.lower(), re.S) is not None


def ratio(a, b):
    """Partial ratio, window by window."""
    from difflib import SequenceMatcher

    short, long = (a, b) if len(a) <= len(b) else (b, a)
    top = 0.0
    for m in SequenceMatcher(None, short, long).get_matching_blocks():
        start = max(m.b - m.a, 0)
        r = SequenceMatcher(None, short, long[start:start + len(short)]).ratio()
        if r > 0.995:
            return 100
        top = max(top, r)
    return int(round(100 * top))


@pytest.mark.parametrize("scored", [False, True])
def test_containment_equals_brute_force(spark, scored):
    rng = random.Random(11)
    names = sorted({"".join(rng.choices("ABCab _%", k=rng.randint(1, 9))).strip() or "A" for _ in range(300)}
                   | {"".join(rng.choices("ABC ", k=n)) + "Z" for n in (190, 205, 240)})
    emp = [(n, rng.choice([0, 1, 5, None])) for n in names]
    queries = sorted({"".join(rng.choices("ABC", k=rng.randint(1, 5))) for _ in range(80)}) + [
        "%", "_", "____", "_%_", "A_B", "A%C", "AB%BC", "ABC_A", "\\%", "A\\_", "B\\", "\\A", "C\\\\", "%%A", "ab", "a", "CbA"]
    q = spark.createDataFrame([(x,) for x in queries], "name string")
    e = spark.createDataFrame(emp, "employer_name string, total_h1b_certified int")
    got = {}
    for r in best_containing(q, e, 3, scored=scored).orderBy("name", "place").collect():
        got.setdefault(r.name, []).append((r.employer_name, r.score))
    want = {}
    for x in queries:
        score = lambda n: ratio(x, n) if scored else 100
        hits = sorted(((n, t) for n, t in emp if like(n, x)), key=lambda n: (-score(n[0]), -(n[1] or 0), n[0]))
        if hits:
            want[x] = [(n, score(n)) for n, _ in hits[:3]]
    assert got == want


def test_containment_is_literal_on_request(spark):
    q = spark.createDataFrame([("A_B",), ("%",)], "name string")
    e = employers(spark, ("A_B CO", 1), ("AXB CO", 9))
    rows = best_containing(q, e, 5, literal=True).collect()
    assert [(r.name, r.employer_name) for r in rows] == [("A_B", "A_B CO")]


def test_patterns_are_cut_once(spark):
    """Plain names are their own anchors; what is joined with the names reads columns that are written."""
    rng = random.Random(5)
    names = sorted({"".join(rng.choices("Ab%_\\\ue000\ue002 é\n", k=rng.randint(0, 6))) for _ in range(400)})
    rows = spark.createDataFrame([(n,) for n in names] + [(None,)], "name string")
    cut = containment._cut_columns(F.lower("name"))
    both = rows.select(F.struct(*containment._anchor_columns(F.col("name"), False)).alias("a"), F.struct(*cut).alias("b"))
    assert [r for r in both.collect() if tuple(r.a) != tuple(r.b)] == []
    out = best_containing(rows.where("name like '%A%'"), employers(spark, ("ACME", 1)), 1)
    plan = out._sc._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "simple")
    assert "regexp_extract_all" not in plan and "/anchors-" in plan


def test_search_scores_long_names(spark):
    long_name = "ZED " + " ".join(f"PART {i}" for i in range(60)) + " ACME"
    emp = employers(spark, ("ACME INC", 1), ("ACME LLC", 7), (long_name, 99), ("OTHER", 5))
    q = spark.createDataFrame([(1, "acme"), (2, "acme"), (3, " "), (4, "nothing at all")], "query_id int, q string")
    rows = search(q, emp, 2).orderBy("query_id", "place").collect()
    assert [(r.query_id, r.employer_name, r.total) for r in rows if r.query_id == 1][0][2] == 2
    ones = [(r.employer_name, r.score) for r in rows if r.query_id == 1]
    assert ones == [(r.employer_name, r.score) for r in rows if r.query_id == 2]
    assert {r.query_id for r in rows} == {1, 2}
    assert all(r.score == ratio("ACME", r.employer_name) for r in rows)
    with pytest.raises(ValueError):
        search(q, emp, 0)


def vectors(spark, n, dim, seed, key):
    rng = np.random.default_rng(seed)
    v = rng.standard_normal((n, dim)).astype("float32")
    v[1] = v[0]
    v[2] = 0
    return v, [(i if key == "id" else f"E{i:04}", [float(x) for x in row]) for i, row in enumerate(v)]


@pytest.mark.parametrize("query_block, name_block", [(4096, 16384), (7, 20)])
def test_nearest_equals_brute_force(spark, monkeypatch, query_block, name_block):
    monkeypatch.setattr(nearest, "MIN_NAME_BLOCK", 5)
    qv, q = vectors(spark, 23, 8, 1, "id")
    ev, e = vectors(spark, 90, 8, 2, "name")
    queries = spark.createDataFrame(q, "query_id int, query_embedding array<float>")
    names = spark.createDataFrame(
        [(n, 1, v) for n, v in e] + [("NONE", 1, None)],
        "employer_name string, total_h1b_certified int, embedding array<float>")
    out = nearest.top_neighbours(queries, names, 4, query_block=query_block, name_block=name_block)
    got = {}
    for r in out.orderBy("query_id", "place").collect():
        got.setdefault(r.query_id, []).append((r.employer_name, round(r.similarity, 9)))
    for i, x in enumerate(qv.astype(float)):
        if not x.any():
            assert i not in got
            continue
        sims = [(n, float(x @ y / np.linalg.norm(x) / np.linalg.norm(y)))
                for (n, _), y in zip(e, ev.astype(float)) if y.any()]
        best = sorted(sims, key=lambda s: (-round(s[1], 12), s[0]))[:4]
        assert got[i] == [(n, round(s, 9)) for n, s in best]


def vectors_of(rows, key):
    return [(k, *([1] if key == "employer_name" else []), None if v is None else [float(x) for x in v]) for k, v in rows]


@pytest.mark.parametrize("blocks", [{}, {"query_block": 37, "name_block": 50}])
def test_cells_find_the_neighbours_of_grouped_vectors(spark, blocks):
    """Sixty groups: few cells are probed and nearly all neighbours found; odd vectors are answered too."""
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((60, 32))
    base = np.repeat(centres, 20, axis=0) + 0.2 * rng.standard_normal((1200, 32))
    asked = centres + 0.2 * rng.standard_normal((60, 32))
    odd = [("SHORT", [1.0, 2.0]), ("ZERO", [0.0] * 32), ("NONE", None)]
    names = spark.createDataFrame(
        vectors_of([*((f"E{i:04}", v) for i, v in enumerate(base)), *odd], "employer_name"),
        "employer_name string, total_h1b_certified int, embedding array<float>")
    queries = spark.createDataFrame(
        vectors_of([*enumerate(asked), (100, [0.0] * 32), (101, [2.0, 1.0]), (102, None)], "query_id"),
        "query_id int, query_embedding array<float>")
    cells = nearest.Cells(dim=32, cells=60)
    found = nearest.top_neighbours(queries, names, 10, cells, **blocks).collect()
    true = nearest.top_neighbours(queries, names, 10).collect()
    ids = lambda rows: {(r.query_id, r.employer_name) for r in rows}
    assert len(ids(found) & ids(true)) >= 0.93 * len(true) and len(found) == len(ids(found)) == len(true) == 601
    assert [(r.query_id, r.employer_name) for r in found if r.query_id > 99] == [(101, "SHORT")]
    units = base / np.linalg.norm(base, axis=1)[:, None]
    trained = nearest.train(units, asked / np.linalg.norm(asked, axis=1)[:, None], 10, 60, 0.95)
    assert trained.probes <= 10
    # More neighbours than the probed cells hold: further cells are probed.
    many = nearest.top_neighbours(queries.where("query_id < 9"), names, 90, nearest.Cells(dim=32, cells=60, recall=0.01))
    assert {r["count"] for r in many.groupBy("query_id").count().collect()} == {90}
    none = names.where("employer_name = 'ZERO'")
    assert nearest.top_neighbours(queries, none, 3, cells).count() == 0
    assert nearest.top_neighbours(queries.where("query_id < 0"), names, 3, cells).count() == 0


def test_a_sample_trains_the_cells(spark):
    """More names than the sample: sizes of cells are counted, and recall holds over all names."""
    rng = np.random.default_rng(5)
    base = rng.standard_normal((3000, 8))
    names = spark.createDataFrame(
        vectors_of(((f"E{i:04}", v) for i, v in enumerate(base)), "employer_name"),
        "employer_name string, total_h1b_certified int, embedding array<float>").repartition(7)
    queries = names.limit(400).select(
        F.expr("int(substr(employer_name, 2))").alias("query_id"), F.col("embedding").alias("query_embedding"))
    found = nearest.top_neighbours(queries, names, 10, nearest.Cells(dim=8, sample=300, asked=50))
    true = nearest.top_neighbours(queries, names, 10)
    both = found.select("query_id", "employer_name").intersect(true.select("query_id", "employer_name")).count()
    assert both >= 0.9 * true.count() and found.count() == true.count()


@pytest.mark.parametrize("scale", ["sf0.01", "sf0.1"])
def test_registered_search_reaches_its_recall(spark, scale):
    row = registry.QUERIES["ann_recall"](spark, f"/root/testdata/{scale}").first()
    assert row.recall_reached and row.neighbours == 10 * row.queries


def test_an_index_is_shared_and_brought_up_to_date(spark):
    names = [(f"{a} {b}", i) for i, (a, b) in enumerate((a, b) for a in ("ACME", "BETA", "GAMMA") for b in ("DATA", "WORKS", "ET"))]
    schema = "employer_name string, total_h1b_certified int"
    index = piece_index(spark.createDataFrame(names, schema))
    queries = spark.createDataFrame([("ACME",), ("WORK",), ("ET",), ("A%K",), ("%",), ("ZZZ",), ("NEW",)], "name string")
    rows = lambda n: sorted(map(tuple, best_containing(queries, n, 3).collect()))
    assert rows(index) == rows(spark.createDataFrame(names, schema))
    changed = [(n, t + 100 * (n == "ACME ET")) for n, t in names if not n.startswith("BETA")] + [("NEW WORKS", 9)]
    after = refreshed(index, spark.createDataFrame(changed, schema))
    assert rows(after) == rows(spark.createDataFrame(changed, schema)) != rows(index)
    fresh = piece_index(spark.createDataFrame(changed, schema))
    assert sorted(map(tuple, after.held.collect())) == sorted(map(tuple, fresh.held.collect()))


def test_answers_are_remembered(spark, tmp_path):
    asked, inner = str(tmp_path / "asked"), embed.hash_embedder(8)

    def counting(texts):
        with open(asked, "a") as f:
            f.writelines(t + "\n" for t in texts)
        return inner(texts)

    emp = embed.fill_vectors(
        employers(spark, ("ALPHA", 5), ("BETA CO", 7)).withColumn("embedding", F.lit(None).cast("array<float>")),
        inner, Embedding(dim=8))
    aliases = spark.createDataFrame([("ALPHA", "ALF", 1)], ALIAS)
    names = spark.createDataFrame([(1, "alpha"), (2, "alf"), (3, "beta"), (4, "none such"), (5, " "), (6, None)], "i int, raw_name string")
    memory = Memory(spark, str(tmp_path / "answers"), "run-1")
    run = lambda rows, m: {r.i: (r.match_type, r.employer_name) for r in resolve(
        rows, emp, aliases, embed_fn=counting, embedding=Embedding(dim=8), memory=m).collect()}
    want = {1: ("exact", "ALPHA"), 2: ("alias", "ALPHA"), 3: ("fuzzy", "BETA CO"), 4: ("miss", None), 5: ("invalid_input", None),
            6: ("invalid_input", None)}
    first = run(names.where("i <> 3"), memory)
    assert first == {i: w for i, w in want.items() if i != 3}
    assert run(names, memory) == run(names, memory) == want == run(names, None)
    with open(asked) as f:
        # Once with the memory, and once without it.
        assert sorted(f.read().split("\n")) == ["", "NONE SUCH", "NONE SUCH"]
    # Other tables, other answers.
    assert Memory(spark, str(tmp_path / "answers"), "run-2").read() is None


def test_resolve_with_vectors_and_embedder(spark):
    dim = 16
    fn = embed.hash_embedder(dim)
    emp = employers(spark, ("ALPHA", 5), ("BETA", 7)).withColumn(
        "embedding", F.lit(None).cast("array<float>"))
    filled = embed.fill_vectors(emp, fn, Embedding(dim=dim))
    names = spark.createDataFrame([(1, "alpha"), (2, "gamma"), (3, "delta")], "i int, raw_name string")
    aliases = spark.createDataFrame([], ALIAS)
    vecs = spark.createDataFrame(
        [("GAMMA", fn(["BETA"])[0]), ("DELTA", fn(["unlike"])[0])], "name string, embedding array<float>")
    rows = resolve(names, filled, aliases, vectors=vecs, cfg=Semantic(threshold=0.9)).orderBy("i").collect()
    assert [(r.match_type, r.employer_name) for r in rows] == [
        ("exact", "ALPHA"), ("semantic", "BETA"), ("miss", None)]
    again = resolve(names, filled, aliases, embed_fn=fn, embedding=Embedding(dim=dim)).orderBy("i").collect()
    assert [r.match_type for r in again] == ["exact", "miss", "miss"]


def test_one_bad_name_costs_only_itself(spark):
    good = embed.hash_embedder(4)

    def shaky(texts):
        if "BAD" in texts:
            raise RuntimeError("no")
        return [None if t == "NOTHING" else v[:3] if t == "SHORT" else v for t, v in zip(texts, good(texts))]

    names = spark.createDataFrame([(n,) for n in ("A", "BAD", "B", "SHORT", "NOTHING")], "name string")
    rows = {r.name: r for r in embed.embed_names(names, shaky, Embedding(dim=4, batch=5)).collect()}
    assert len(rows["A"].embedding) == len(rows["B"].embedding) == 4
    assert rows["BAD"].embed_error == "RuntimeError"
    assert rows["SHORT"].embed_error == "expected 4 values, got 3"
    assert rows["NOTHING"].embedding is None


def test_a_name_is_embedded_once(spark, tmp_path):
    asked, inner = str(tmp_path / "asked"), embed.hash_embedder(8)

    def counting(texts):
        with open(asked, "a") as f:
            f.writelines(t + "\n" for t in texts)
        return inner(texts)

    emp = embed.fill_vectors(
        employers(spark, ("ALPHA", 5), ("BETA", 7)).withColumn("embedding", F.lit(None).cast("array<float>")),
        inner, Embedding(dim=8))
    names = spark.createDataFrame([(1, "gamma"), (2, "delta"), (3, "gamma"), (4, "alpha")], "i int, raw_name string")
    for cells in (None, nearest.Cells(dim=8)):
        out = resolve(names, emp, spark.createDataFrame([], ALIAS), embed_fn=counting, embedding=Embedding(dim=8), cells=cells)
        assert {r.i: r.match_type for r in out.collect()} == {1: "miss", 2: "miss", 3: "miss", 4: "exact"}
        with open(asked) as f:
            assert sorted(f.read().split()) == ["DELTA", "GAMMA"]
        open(asked, "w").close()
