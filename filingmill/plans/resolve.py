"""Resolve whole tables of raw names to employers: exact, alias, substring, vector.

Work is done once per distinct normalised name. Each layer gets only the names the layers
before it left over, and the record of the chosen employer is looked up once at the end.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import Embedding, Semantic
from ..functions import text
from ..operators.containment import PieceIndex, best_containing
from ..operators.intake import first_per_key
from ..operators.materialize import materialize
from ..operators.nearest import Cells, top_neighbours
from ..operators.semantic import decide
from ..streaming.batches import Batches
from .embed import embed_names

RECORD = (
    "employer_name", "total_h1b_certified", "earliest_decision_date",
    "latest_decision_date", "last_active_year", "h1b_dependent",
)


def records(employers: DataFrame) -> DataFrame:
    """Employer rows as results show them: no NULL total, dates as text."""
    return employers.select(
        "employer_name",
        F.coalesce("total_h1b_certified", F.lit(0)).cast("long").alias("total_h1b_certified"),
        F.col("earliest_decision_date").cast("string").alias("earliest_decision_date"),
        F.col("latest_decision_date").cast("string").alias("latest_decision_date"),
        "last_active_year", "h1b_dependent")


def one_alias(aliases: DataFrame) -> DataFrame:
    """One row per alias name: most used first, then by employer name."""
    ranked = first_per_key(
        aliases, ["alias_name"],
        [F.desc(F.coalesce("usage_count", F.lit(0))), "primary_employer_name"])
    return ranked.select("alias_name", "primary_employer_name")


def match_exact(names: DataFrame, employers: DataFrame) -> DataFrame:
    """name, employer_name for names that are an employer."""
    known = employers.select("employer_name")
    return names.join(known, F.col("name") == F.col("employer_name")).select("name", "employer_name")


def match_alias(names: DataFrame, aliases: DataFrame, employers: DataFrame) -> DataFrame:
    """name, employer_name for alias names.

    The alias row is picked before the employer is looked up: if that employer is unknown,
    no other row of the alias steps in.
    """
    hop = names.join(one_alias(aliases), F.col("name") == F.col("alias_name"))
    known = employers.select("employer_name")
    return hop.join(
        known, F.col("primary_employer_name") == F.col("employer_name")
    ).select("name", "employer_name")


class Memory:
    """Answers that stay valid as long as employers and aliases do: one table of segments per ``version`` of them.

    A version is any text that changes when the tables do, such as the name of their run. Names
    that were asked before, misses included, reach no layer again.
    """

    def __init__(self, spark: SparkSession, folder: str, version: str) -> None:
        self.answers = Batches(spark, f"{folder.rstrip('/')}/{version}")

    def read(self, below: int | None = None) -> DataFrame | None:
        return self.answers.read(below)

    def add(self, answers: DataFrame, number: int | None = None) -> None:
        """Add a segment; with ``number``, that of the batch, so that a batch can be run again."""
        last = self.answers.last()
        self.answers.write(answers, number if number is not None else 0 if last is None else last + 1)


def match_fuzzy(names: DataFrame, employers: DataFrame | PieceIndex, literal: bool = False) -> DataFrame:
    """name, employer_name for names inside employer names, largest filer first."""
    return best_containing(names, employers, 1, literal=literal).select("name", "employer_name")


def match_semantic(
    name_vectors: DataFrame, employers: DataFrame, cfg: Semantic = Semantic(),
    cells: Cells | None = None,
) -> DataFrame:
    """name, employer_name, confidence for names close to one employer in vector space.

    ``name_vectors`` has name, embedding; names without an answer are left out.
    """
    queries = name_vectors.select(
        F.col("name").alias("query_id"), F.col("embedding").alias("query_embedding"))
    near = top_neighbours(queries, employers, cfg.fetch_k, cells)
    return decide(near, cfg).where("employer_name is not null").withColumnRenamed("query_id", "name")


def resolve(
    names: DataFrame,
    employers: DataFrame,
    aliases: DataFrame,
    raw_name: str = "raw_name",
    vectors: DataFrame | None = None,
    embed_fn: Callable | None = None,
    cfg: Semantic = Semantic(),
    embedding: Embedding = Embedding(),
    literal: bool = False,
    cells: Cells | None = None,
    index: PieceIndex | None = None,
    memory: Memory | None = None,
    batch: int | None = None,
) -> DataFrame:
    """All rows of ``names`` with the employer record, match_type and confidence.

    The vector layer runs when name vectors (name, embedding) or an ``embed_fn`` are given
    and ``employers`` has an ``embedding`` column; otherwise it finds nothing. With ``cells``
    it looks into the nearest cells instead of comparing everything. ``index`` is the piece index of
    the employers, where one is at hand. With ``memory`` only names that it does not hold are looked
    up, and their answers are added, as those of micro-batch ``batch`` if that is given.
    """
    keyed = names.withColumn("_name", text.employer_name(F.col(raw_name)))
    distinct = keyed.select(F.col("_name").alias("name")).where("name is not null").distinct()
    known = memory.read(batch) if memory else None
    if known is not None:
        distinct = distinct.join(known.select("name"), "name", "left_anti")
    distinct = materialize(distinct, "resolve-names")
    if known is None or distinct.limit(1).count():
        answers = _answers(
            distinct, employers, aliases, vectors, embed_fn, cfg, embedding, literal, cells, index)
        if memory:
            answers = materialize(distinct.join(answers, "name", "left"), "resolve-answers")
            memory.add(answers, batch)
        answers = answers if known is None else answers.unionByName(known)
    else:
        answers = known

    found = answers.join(records(employers), "employer_name").withColumnRenamed("name", "_name")
    kind = (
        F.when(F.col("_name").isNull(), "invalid_input")
        .otherwise(F.coalesce("match_type", F.lit("miss"))))
    return keyed.join(found, "_name", "left").select(
        *names.columns, F.col("_name").alias("normalized_name"), kind.alias("match_type"),
        "confidence", *RECORD)


def _answers(
    distinct: DataFrame, employers: DataFrame, aliases: DataFrame, vectors: DataFrame | None, embed_fn: Callable | None,
    cfg: Semantic, embedding: Embedding, literal: bool, cells: Cells | None, index: PieceIndex | None,
) -> DataFrame:
    """name, employer_name, match_type and confidence of the names that some layer answers."""
    early = materialize(_exact_and_alias(distinct, employers, aliases), "resolve-early")
    left_over = early.where("employer_name is null").select("name")
    fuzzy = left_over.join(match_fuzzy(left_over, index or employers, literal), "name", "left").select(
        "name", "employer_name",
        F.when(F.col("employer_name").isNotNull(), "fuzzy").alias("match_type"))

    answers = early.where("employer_name is not null")
    if "embedding" not in employers.columns or (vectors is None and embed_fn is None):
        return answers.unionByName(
            fuzzy.where("employer_name is not null")).withColumn("confidence", F.lit(1.0))
    fuzzy = materialize(fuzzy, "resolve-fuzzy")
    rest = fuzzy.where("employer_name is null").select("name")
    # Written, since the search reads its queries more than once and a name is embedded once.
    with_vectors = materialize(
        rest.join(vectors.select("name", "embedding"), "name") if vectors is not None
        else embed_names(rest, embed_fn, embedding), "resolve-vectors")
    semantic = match_semantic(with_vectors, employers, cfg, cells).withColumn("match_type", F.lit("semantic"))
    return answers.unionByName(
        fuzzy.where("employer_name is not null")
    ).withColumn("confidence", F.lit(1.0)).unionByName(semantic)


def _exact_and_alias(distinct: DataFrame, employers: DataFrame, aliases: DataFrame) -> DataFrame:
    known = employers.select(F.col("employer_name").alias("_exact"))
    direct = distinct.join(known, F.col("name") == F.col("_exact"), "left")
    hop = match_alias(distinct, aliases, employers).select(
        F.col("name").alias("_alias_name"), F.col("employer_name").alias("_primary"))
    both = direct.join(hop, F.col("name") == F.col("_alias_name"), "left")
    return both.select(
        "name", F.coalesce("_exact", "_primary").alias("employer_name"),
        F.when(F.col("_exact").isNotNull(), "exact")
        .when(F.col("_primary").isNotNull(), "alias").alias("match_type"))


def check(resolved: DataFrame) -> DataFrame:
    """Resolved rows in the shape of the single-name answer; a miss has no match type."""
    drop = set(RECORD) | {"match_type", "confidence", "normalized_name"}
    found = F.col("employer_name").isNotNull()
    return resolved.select(
        *[c for c in resolved.columns if c not in drop],
        found.alias("found"),
        "employer_name",
        F.col("total_h1b_certified").alias("h1b_count"),
        found.alias("sponsors_h1b"),
        F.when(F.col("match_type") != "miss", F.col("match_type")).alias("match_type"),
        F.col("confidence").alias("match_confidence"),
        "earliest_decision_date", "latest_decision_date", "last_active_year", "h1b_dependent")
