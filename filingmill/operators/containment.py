"""Names found inside other names, as equi-joins on rare pieces.

A query lies inside a name only if all its three-character pieces do. So every query is looked up
by one piece, the one that the fewest names hold, among the pieces of all names, and what meets is
tested. Names are expanded into as many rows as they have characters, whatever the queries are,
and a piece that most names share is used only by queries made of nothing else.

Queries of one or two characters would meet too many names. They equal a piece of the name, so
the best names per piece are kept before anything is shuffled, and the query looks these up.

``%``, ``_`` and ``\\`` in a query act as in LIKE. Such queries are joined on a rare piece of
their longest literal part and then tested; a query of wildcards only asks for a minimum length,
which is an equality on a run of filler characters.

The pieces of all names and how many names hold each are a ``PieceIndex``: two written tables that
several searches over the same names share, and that ``refreshed`` brings up to date from the
names that changed.

With ``scored``, places follow the partial ratio of query and name. It is 100 where the name has
the query as it is written, on names short enough for the ratio to look at every character, and 0
where they share no character; only other pairs are computed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.ratio import WHOLE_BELOW, partial_ratio
from ..functions.text import has_wildcard
from .materialize import materialize

PIECE = 3
_FILLER = "\x00"
# Private characters that stand for escaped %, _ and \ while a pattern is cut.
_ESCAPED, _STAND = "%_\\", "\ue000\ue001\ue002"
_COLUMNS = ("name", "employer_name", "total_h1b_certified", "score")


@dataclass(frozen=True)
class PieceIndex:
    """Names prepared for search: (employer_name, lowered, total_h1b_certified), these by piece, and names per piece."""

    names: DataFrame
    held: DataFrame
    common: DataFrame


def _prepared(names: DataFrame) -> DataFrame:
    return names.select(
        "employer_name", F.lower("employer_name").alias("lowered"),
        F.coalesce("total_h1b_certified", F.lit(0)).cast("long").alias("total_h1b_certified"))


def _indexed(names: DataFrame, held: DataFrame) -> PieceIndex:
    held = materialize(held, "pieces")
    return PieceIndex(names, held, materialize(held.groupBy("piece").agg(F.count("*").alias("names")), "common"))


def piece_index(names: DataFrame) -> PieceIndex:
    """The index of ``names`` (employer_name, unique, and total_h1b_certified), written once."""
    own = materialize(_prepared(names), "names")
    return _indexed(own, _expanded(own, _pieces("lowered", PIECE)))


def refreshed(index: PieceIndex, names: DataFrame) -> PieceIndex:
    """The index of ``names`` made from an older one: only names that are new or changed are cut into pieces."""
    own = materialize(_prepared(names), "names")
    key = ["employer_name", "total_h1b_certified"]
    fresh = own.join(index.names.select(*key), key, "left_anti")
    stays = own.join(index.names.select(*key), key, "left_semi").select("employer_name")
    kept = index.held.join(stays, "employer_name", "left_semi")
    return _indexed(own, kept.unionByName(_expanded(fresh, _pieces("lowered", PIECE))))


def best_containing(
    queries: DataFrame, names: DataFrame | PieceIndex, k: int, scored: bool = False, literal: bool = False,
) -> DataFrame:
    """Up to ``k`` of ``names`` that contain each query.

    ``queries`` has one distinct ``name`` per row. ``names`` has ``employer_name`` (unique) and ``total_h1b_certified``, or is
    an index of such a table.
    Order: partial ratio if ``scored``, then filing total, then name.
    Returns name, employer_name, total_h1b_certified, score, place.
    """
    prepared = _anchored(queries, literal)
    index = names if isinstance(names, PieceIndex) else piece_index(names)
    names = index.names

    size = F.char_length("anchor")
    longer = prepared.where((size >= PIECE) & ~F.col("only_wild"))
    parts = [_rated(_by_rare_piece(longer, index), scored)]
    counts = prepared.agg(
        F.count_if("only_wild").alias("wild"),
        F.count_if((size < PIECE) & ~F.col("only_wild") & F.col("pattern").isNull()).alias("short"),
        F.count_if((size < PIECE) & ~F.col("only_wild") & F.col("pattern").isNotNull()).alias("patterns")).first()
    if counts.short:
        short = prepared.where((size < PIECE) & ~F.col("only_wild") & F.col("pattern").isNull())
        parts.append(_short(short, names, k, scored))
    if counts.patterns:
        short = prepared.where((size < PIECE) & ~F.col("only_wild") & F.col("pattern").isNotNull())
        parts.append(_rated(_tested(short, _expanded(names, F.concat(_pieces("lowered", 1), _pieces("lowered", 2)))), scored))
    if counts.wild:
        parts.append(_only_wild(prepared.where("only_wild"), names, k, scored))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return _top(found, k)


def _anchored(queries: DataFrame, literal: bool) -> DataFrame:
    """Queries with their anchor columns, written: patterns are cut once, by all tasks, however often they are read."""
    tasks = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = queries.select("name").repartition(tasks, "name")
    return materialize(rows.select("name", *_anchor_columns(F.col("name"), literal)), "anchors")


def _anchor_columns(name: Column, literal: bool) -> list[Column]:
    """anchor: longest literal part, lower case; pattern: LIKE text, if not just the anchor.

    A name without a character of LIKE, nor one that stands for it here, is its own anchor.
    """
    lowered = F.lower(name)
    plain = [lowered, F.lit(None).cast("string"), F.lit(False)]
    if not literal:
        special = has_wildcard(name) | name.rlike(f"[{_STAND}]")
        plain = [F.when(~special, whole).otherwise(cut) for cut, whole in zip(_cut_columns(lowered), plain)]
    return [c.alias(n) for c, n in zip(plain, ("anchor", "pattern", "only_wild"))]


def _cut_columns(lowered: Column) -> list[Column]:
    """The anchor columns of a LIKE text."""
    # Escapes become single characters; a backslash in front of anything else drops out.
    tokens = F.regexp_extract_all(F.concat(F.lit("%"), lowered, F.lit("%")), F.lit(r"(?s)\\.|."), F.lit(0))
    like = F.array_join(F.transform(tokens, lambda t: F.when(
        F.char_length(t) == 2, F.translate(F.substring(t, 2, 1), _ESCAPED, _STAND)).otherwise(t)), "")
    # A backslash at the end escapes the last %, so the name has to end there.
    is_open = like.endswith("%")
    inner = F.substring(like, F.lit(2), F.char_length(like) - F.when(is_open, 2).otherwise(1))
    pieces = F.transform(
        F.split(inner, "[%_]"), lambda p: F.named_struct(
            F.lit("n"), F.char_length(p), F.lit("p"), F.translate(p, _STAND, _ESCAPED)))
    wild = inner.rlike("[%_]") | ~is_open
    only_wild = inner.rlike("^[%_]+$") & is_open
    quoted = like
    for stand, c in zip(_STAND, _ESCAPED):
        quoted = F.replace(quoted, F.lit(stand), F.lit("\\" + c))
    filler = F.repeat(F.lit(_FILLER), F.char_length(F.replace(inner, F.lit("%"), F.lit(""))))
    return [
        F.when(only_wild, filler).otherwise(F.array_max(pieces)["p"]),
        F.when(wild & ~only_wild, quoted), only_wild]


def _pieces(column: str, n: int) -> Column:
    """The distinct runs of ``n`` characters."""
    text = F.col(column)
    last = F.char_length(text) - n + 1
    runs = F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(text, i, F.lit(n)))
    return F.when(last > 0, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def _expanded(names: DataFrame, pieces: Column) -> DataFrame:
    """One row per name and piece; a few bytes become many, so names are spread over tasks first."""
    tasks = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return names.repartition(tasks, "employer_name").withColumn("piece", F.explode(pieces))


def _by_rare_piece(queries: DataFrame, index: PieceIndex) -> DataFrame:
    asked = queries.select("name", F.explode(_pieces("anchor", PIECE)).alias("piece"))
    # A piece that no name has is the rarest of all: its query finds nothing.
    rare = asked.join(index.common, "piece", "left").groupBy("name").agg(
        F.min_by("piece", F.struct(F.coalesce("names", F.lit(0)), F.col("piece"))).alias("piece"))
    return _met(queries.join(rare, "name"), index.held)


def _tested(queries: DataFrame, held: DataFrame) -> DataFrame:
    return _met(queries.withColumn("piece", F.col("anchor")), held)


def _met(queries: DataFrame, held: DataFrame) -> DataFrame:
    met = queries.join(held, "piece")
    matches = F.expr("if(pattern is null, contains(lowered, anchor), lowered like pattern)")
    return met.where(matches).select("name", "employer_name", "total_h1b_certified")


def _certain(name: Column, employer: Column) -> Column:
    """Where the ratio is 100 without computing it."""
    return employer.contains(name) & (F.char_length(employer) < WHOLE_BELOW)


def _rated(pairs: DataFrame, scored: bool) -> DataFrame:
    if not scored:
        return pairs.withColumn("score", F.lit(100)).select(*_COLUMNS)
    name, employer = F.col("name"), F.col("employer_name")
    certain = _certain(name, employer)
    computed = partial_ratio(F.when(~certain, name), F.when(~certain, employer))
    return pairs.withColumn("score", F.when(certain, 100).otherwise(computed)).select(*_COLUMNS)


def _short(queries: DataFrame, names: DataFrame, k: int, scored: bool) -> DataFrame:
    """Queries of one or two characters: the best names per piece, then the queries."""
    look_up = queries.select("name", F.col("anchor" if not scored else "name").alias("piece"))

    def kept(column: str, rows: DataFrame) -> DataFrame:
        held = _expanded(rows, F.concat(_pieces(column, 1), _pieces(column, 2))).withColumn("score", F.lit(100))
        return look_up.join(_top(held, k, by="piece").drop("place"), "piece").select(*_COLUMNS)

    if not scored:
        return kept("lowered", names)
    # Only the names that do not hold the query as written, or are long, are rated one by one.
    sure = kept("employer_name", names.where(F.char_length("employer_name") < WHOLE_BELOW))
    odd = names.where(
        (F.char_length("employer_name") >= WHOLE_BELOW) | (F.upper("employer_name") != F.col("employer_name")))
    pairs = _tested(queries, _expanded(odd, F.concat(_pieces("lowered", 1), _pieces("lowered", 2))))
    other = queries.where((F.upper("name") != F.col("name")) | has_wildcard(F.col("name")))
    plain = pairs.where(~_certain(F.col("name"), F.col("employer_name"))).join(other.select("name"), "name", "left_anti")
    special = _tested(other, _expanded(names, F.concat(_pieces("lowered", 1), _pieces("lowered", 2))))
    return sure.join(other.select("name"), "name", "left_anti").unionByName(
        _rated(plain, True)).unionByName(_rated(special, True))


def _only_wild(queries: DataFrame, names: DataFrame, k: int, scored: bool) -> DataFrame:
    """Queries of wildcards only: names of a least length, best first."""
    sizes = [r[0] for r in queries.select(F.char_length("anchor")).distinct().collect()]  # a few small numbers
    wanted = F.filter(F.array(*[F.lit(n) for n in sorted(sizes)]), lambda n: n <= F.char_length("lowered"))
    held = names.withColumn("n", F.explode(wanted)).withColumn("piece", F.repeat(F.lit(_FILLER), F.col("n"))).drop("n")
    shares = F.col("employer_name").rlike(r"[%_]")
    rest = held.where(~shares) if scored else held
    best = _top(rest.withColumn("score", F.lit(0 if scored else 100)), k, by="piece")
    look_up = queries.select("name", F.col("anchor").alias("piece"))
    found = look_up.join(best, "piece").select(*_COLUMNS)
    if scored:
        found = found.unionByName(_rated(look_up.join(held.where(shares), "piece"), True))
    return found


def _top(df: DataFrame, k: int, by: str = "name") -> DataFrame:
    order = Window.partitionBy(by).orderBy(
        F.desc("score"), F.desc("total_h1b_certified"), "employer_name")
    return df.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
