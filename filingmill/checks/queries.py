"""Every operator as a query over the supplied tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import Embedding, Limits, Semantic
from ..functions import coerce, text, vectors
from ..functions import listing_text as lt
from ..operators import aliases as alias_ops
from ..operators import attempts, intake, listings, merge, nearest, requests, running, semantic
from ..operators.containment import best_containing
from ..config import FILING_HEADERS
from ..plans import annotate as annotating
from ..plans import intake as intake_plan
from ..plans import resolve as resolving
from ..plans.embed import fill_store
from ..plans.search import search as run_search
from ..sources import sinks, tables
from ..sources.stored import StoredTable
from ..operators.materialize import materialize, shared_dir
from ..sources.sample_views import table, view
from ..streaming import events as event_streams
from ..streaming.batches import Batches
from ..streaming.filings import intake_stream, stored_cases
from ..streaming.names import resolve_stream

Query = Callable[[SparkSession, str], DataFrame]

# The sample rows carry no file position; these columns order them within a file.
ORDER = ("file_priority", "partkey", "suppkey")
STORED_AT = datetime(2025, 1, 1)
RUN_AT = datetime(2025, 6, 1)
# Sample vectors are nearly orthogonal: non-equal ones reach 0.3 to 0.5.
EVER = "36500 days"
LOW_THRESHOLD = Semantic(threshold=0.35)


def _raw(spark, sf):
    return view(spark, sf, "lca_raw")


def _cases(spark, sf):
    return intake.clean_cases(_raw(spark, sf), ORDER)


def _employers(spark, sf):
    return intake.employers(_cases(spark, sf))


def _aliases(spark, sf):
    return alias_ops.merge_curated(
        intake.aliases(_cases(spark, sf)),
        alias_ops.curated_aliases(view(spark, sf, "curated_raw")))


def _stored(spark, sf):
    """Employers and aliases as written tables, the way resolution finds them."""
    # Only what the two tables are made of is tidied and written.
    cases = materialize(
        _cases(spark, sf).select("employer_name", "trade_name_dba", "decision_date", "h1b_dependent"), "cases")
    curated = alias_ops.curated_aliases(view(spark, sf, "curated_raw"))
    return (materialize(intake.employers(cases), "employers"),
            materialize(alias_ops.merge_curated(intake.aliases(cases), curated), "aliases"))


def _stored_employers(spark, sf):
    """Employers alone as a written table, for lookups that need no aliases."""
    return materialize(_employers(spark, sf), "employers")


# --- intake -------------------------------------------------------------------------


def clean_cases(spark, sf):
    return _cases(spark, sf)


def employers_agg(spark, sf):
    return intake.sort_employers(_employers(spark, sf))


def job_levels(spark, sf):
    return intake.sort_job_levels(intake.job_levels(_cases(spark, sf)))


def aliases_agg(spark, sf):
    return intake.sort_aliases(intake.aliases(_cases(spark, sf)))


def aliases_merged(spark, sf):
    return intake.sort_aliases(_aliases(spark, sf))


def employers_placed(spark, sf):
    return running.placed(employers_agg(spark, sf)).select("employer_name", "place")


def job_levels_placed(spark, sf):
    return running.placed(job_levels(spark, sf)).select("employer_name", "normalized_job_title", "soc_code", "place")


def aliases_placed(spark, sf):
    return running.placed(aliases_agg(spark, sf)).select("primary_employer_name", "alias_name", "place")


def merged_aliases_placed(spark, sf):
    return running.placed(aliases_merged(spark, sf)).select("primary_employer_name", "alias_name", "place")


def simple_counts_top10(spark, sf):
    return intake.top_counts(intake.simple_counts(_raw(spark, sf)))


def file_counters(spark, sf):
    return intake.file_counters(_raw(spark, sf))


def intake_summary(spark, sf):
    raw = _raw(spark, sf)
    cases = materialize(intake.clean_cases(raw, ORDER), "cases")
    merged = alias_ops.merge_curated(
        intake.aliases(cases), alias_ops.curated_aliases(view(spark, sf, "curated_raw")))
    return intake.summary(intake.file_counters(raw), cases, merged)


def summary_from_states(spark, sf):
    """Run totals from one state per file, and whether the distinct numbers are within a twentieth."""
    raw = _raw(spark, sf)
    states = materialize(intake.summary_states(raw), "states")
    about = intake.merged_summary(states)
    exact = intake.summary_numbers(raw)
    numbers = ("cases", "employers", "job_titles")
    both = about.unionByName(exact, allowMissingColumns=True).agg(  # one row each
        F.max("rows_scanned").alias("rows_scanned"), *[F.max(f"exact_{c}").alias(f"exact_{c}") for c in numbers],
        *[F.max(c).alias(c) for c in numbers])
    near = [F.abs(F.col(c) - F.col(f"exact_{c}")) <= 0.05 * F.col(f"exact_{c}") for c in numbers]
    return both.select(
        "rows_scanned", *[F.col(f"exact_{c}").alias(c) for c in numbers], (near[0] & near[1] & near[2]).alias("close"))


def date_parse(spark, sf):
    return view(spark, sf, "date_texts").select(
        "id", text.date_text(F.col("txt")).alias("decision_date"))


# --- load ---------------------------------------------------------------------------


def load_coercion(spark, sf):
    rows = view(spark, sf, "loaded_text")
    return rows.select(
        coerce.to_text(F.col("employer_name")).alias("employer_name"),
        F.coalesce(coerce.to_int(F.col("total_text")), F.lit(0)).alias("total"),
        coerce.to_float(F.col("pct_text")).alias("pct"),
        coerce.to_bool(F.col("flag_text")).alias("flag"),
        coerce.to_date(F.col("date_text")).cast("string").alias("day"),
    ).dropna(subset=["employer_name"])


def _typed(employers: DataFrame, at: datetime) -> DataFrame:
    as_text = employers.select(*[F.col(c).cast("string").alias(c) for c in employers.columns])
    return merge.typed_employers(as_text, at)


def employer_upsert(spark, sf):
    raw = _raw(spark, sf)
    old = intake.employers(intake.clean_cases(raw.where("file_priority <= 2 and suppkey % 5 > 0"), ORDER))
    new = intake.employers(intake.clean_cases(raw.where("file_priority >= 2 and suppkey % 5 < 4"), ORDER))
    vector = view(spark, sf, "name_vectors").where("side = 'employer'").select(
        text.employer_name(F.col("raw_name")).alias("employer_name"), "embedding")
    stored = _typed(old, STORED_AT).join(vector, "employer_name", "left")
    merged = merge.upsert(stored, _typed(new, RUN_AT))
    return merged.select(
        "employer_name", "total_h1b_certified",
        F.col("earliest_decision_date").cast("string").alias("earliest_decision_date"),
        F.col("latest_decision_date").cast("string").alias("latest_decision_date"),
        "last_active_year", "h1b_dependent",
        F.date_format("last_updated", "yyyy-MM-dd").alias("last_updated"),
        F.col("embedding").isNotNull().alias("has_embedding"))


def employer_deltas(spark, sf):
    """The same upsert where each run writes only its own rows, and vectors are a run of their own."""
    raw = _raw(spark, sf)
    table_ = StoredTable(
        spark, _run_dir(spark, "deltas"), "employer_name", {"values": merge.EMPLOYER_VALUES, "vector": ["embedding"]}, fan=3)
    old = _typed(intake.employers(intake.clean_cases(raw.where("file_priority <= 2 and suppkey % 5 > 0"), ORDER)), STORED_AT)
    new = intake.employers(intake.clean_cases(raw.where("file_priority >= 2 and suppkey % 5 < 4"), ORDER))
    vector = view(spark, sf, "name_vectors").where("side = 'employer'").select(
        text.employer_name(F.col("raw_name")).alias("employer_name"), "embedding").dropDuplicates(["employer_name"])
    table_.upsert(old.withColumn("embedding", F.lit(None).cast("array<float>")))
    table_.upsert(vector.join(table_.read().select("employer_name"), "employer_name", "left_semi"))
    table_.upsert(_typed(new, RUN_AT))
    return table_.read().select(
        "employer_name", "total_h1b_certified",
        F.col("earliest_decision_date").cast("string").alias("earliest_decision_date"),
        F.col("latest_decision_date").cast("string").alias("latest_decision_date"),
        "last_active_year", "h1b_dependent",
        F.date_format("last_updated", "yyyy-MM-dd").alias("last_updated"),
        F.col("embedding").isNotNull().alias("has_embedding"))


def alias_scoped_replace(spark, sf):
    fresh = alias_ops.curated_aliases(
        view(spark, sf, "curated_raw").where("line_no % 5 < 3"))
    return alias_ops.replace_scope(_aliases(spark, sf), fresh)


def _exported(spark, sf, folder: str, raw: DataFrame, curated: DataFrame | None) -> None:
    intake_plan.export(intake_plan.build(raw, curated, ORDER), folder)


def load_replace(spark, sf):
    """Two loads, the second without curated rows: its aliases are all that is left."""
    base, raw = _run_dir(spark, "load-replace"), _raw(spark, sf)
    _exported(spark, sf, f"{base}/first", raw, view(spark, sf, "curated_raw"))
    intake_plan.load(spark, f"{base}/first", f"{base}/store", STORED_AT)
    _exported(spark, sf, f"{base}/second", raw, None)
    intake_plan.load(spark, f"{base}/second", f"{base}/store", RUN_AT)
    return sinks.read_latest(spark, f"{base}/store/employer_aliases")


def embedding_fill_store(spark, sf):
    """Vectors for a stored table, by an embedder that SQL can say: the length of the name."""
    base = _run_dir(spark, "fill-store")
    sinks.upsert_employers(spark, base, _typed(_employers(spark, sf), STORED_AT), STORED_AT)
    fill_store(spark, base, lambda names: [[float(len(n)), 1.0] for n in names], RUN_AT, Embedding(dim=2))
    return sinks.read_latest(spark, base).select(
        "employer_name", "total_h1b_certified", F.array_size("embedding").alias("dims"),
        F.col("embedding")[0].cast("double").alias("first_value"))


def filings_from_files(spark, sf):
    """Filings of four files, two formats and different headers, and one file that is not there."""
    base, raw = _run_dir(spark, "filings"), _raw(spark, sf)
    header = {"case_number": " Case_Number", "h1b_dependent": "h-1b_dependent ", "visa_class": "Visa_Class"}
    for q in (1, 2, 3, 4):
        # Rows are written in their order, so files by name and rows by place give it back.
        part = raw.where(F.col("file_priority") == q).orderBy("partkey", "suppkey").select(
            *[F.col(c).alias(header.get(c, h) if q % 2 else h) for c, h in FILING_HEADERS.items()])
        if q == 3:
            part = part.withColumn("UNUSED", F.lit("x"))
        part = part.select(*reversed(part.columns)) if q == 4 else part
        part.write.option("header", True).format("csv" if q < 3 else "parquet").save(f"{base}/q{q}")
    csv = tables.read_filings(spark, [f"{base}/q1", f"{base}/absent", f"{base}/q2"], "csv")
    parquet = tables.read_filings(spark, [f"{base}/q3", f"{base}/q4"], "parquet")
    both = csv.withColumn("file_priority", F.col("file_priority") - 10).unionByName(parquet)
    return intake.clean_cases(both)


def folder_counts(spark, sf):
    """The older count over a folder of files whose last repeated header counts; a file without one gives none."""
    base, raw = _run_dir(spark, "folder"), _raw(spark, sf)
    as_is = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    for q in (1, 2, 3, 4):
        part = raw.where(F.col("file_priority") == q).select(
            F.lit("no name").alias("a"), F.col("case_status").alias("b"), F.col("employer_name").alias("c"))
        part = part.drop("b") if q == 4 else part
        header = "EMPLOYER_NAME,CASE_STATUS,employer_name".split(",") if q < 4 else ["EMPLOYER_NAME", "employer_name"]
        lines = part.select(F.to_csv(F.struct(*part.columns), as_is).alias("value"))
        first = spark.createDataFrame([(",".join(header),)], "value string")
        lines.write.text(f"{base}/rows/q{q}")
        first.coalesce(1).write.text(f"{base}/head/q{q}")
    parts = []
    for q in (1, 2, 3, 4):
        header = spark.read.text(f"{base}/head/q{q}").first()[0].split(",")
        rows = tables.read_folder(spark, f"{base}/rows/q{q}", "*.txt", "text")
        typed = rows.select(F.from_csv("value", ", ".join(f"c{i} string" for i in range(len(header))), as_is).alias("r")).select("r.*")
        picked = tables.with_filing_columns(
            typed.toDF(*header), {c: FILING_HEADERS[c] for c in ("employer_name", "case_status")}, duplicates="last", on_missing="skip")
        parts += [picked] if picked is not None else []
    return intake.simple_counts(reduce(DataFrame.unionByName, parts))


def counts_upsert(spark, sf):
    """The older counts stored twice: what the second run does not name stays as it was."""
    base, counts = _run_dir(spark, "counts"), intake.simple_counts(_raw(spark, sf))
    sinks.upsert_counts(spark, base, counts, STORED_AT)
    sinks.upsert_counts(spark, base, counts.where("h1b_count % 2 = 0").withColumn("h1b_count", F.col("h1b_count") * 10), RUN_AT)
    return sinks.read_latest(spark, base).select(
        "employer_name", "h1b_count", F.date_format("last_updated", "yyyy-MM-dd").alias("last_updated"))


def curated_from_file(spark, sf):
    """Curated rows from a CSV file, in the order of its lines; a file that is not there gives none."""
    base = _run_dir(spark, "curated")
    columns = [f.name for f in tables.CURATED_SCHEMA]
    view(spark, sf, "curated_raw").orderBy("line_no").select(*columns).coalesce(1).write.csv(f"{base}/rows", header=True)
    none = alias_ops.curated_aliases(tables.read_curated(spark, f"{base}/absent"))
    return alias_ops.curated_aliases(tables.read_curated(spark, f"{base}/rows")).unionByName(none)


def pending_first(spark, sf):
    return merge.pending(view(spark, sf, "employer_vectors"), 25)


# --- vectors ------------------------------------------------------------------------


def embedding_merge(spark, sf):
    stored = view(spark, sf, "employer_vectors")
    made = table(spark, sf, "embeddings").where("vec_id % 14 = 0").select(
        F.col("vec_id").alias("id"),
        F.when(F.col("vec_id") % 28 == 0, F.col("embedding"))
        .otherwise(F.slice("embedding", 1, 10)).alias("embedding"))
    merged = merge.write_back_vectors(stored, made, dim=64)
    return merged.select(
        "id", "employer_name",
        F.coalesce(F.array_size("embedding"), F.lit(0)).alias("dims"),
        F.round(F.col("embedding")[0].cast("double"), 6).alias("first_value"))


def embedding_coverage(spark, sf):
    stats = merge.coverage(view(spark, sf, "employer_vectors"))
    return stats.withColumn("estimated_cost_usd", F.round("estimated_cost_usd", 6))


def embedding_batches(spark, sf):
    cfg = Embedding(batch=10)
    batched = running.batches(merge.pending(view(spark, sf, "employer_vectors")), "id", cfg.batch)
    tokens = F.size(F.split("employer_name", " ")).cast("long")
    progress = running.batch_progress(batched, tokens, cfg.usd_per_million_tokens)
    return progress.withColumn("cost_so_far_usd", F.round("cost_so_far_usd", 9))


def cosine_topk(spark, sf):
    near = nearest.top_neighbours(
        view(spark, sf, "query_vectors"), view(spark, sf, "employer_vectors"), 10)
    return near.withColumn("similarity", F.round("similarity", 6))


def _every_vector(spark, sf):
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_embedding"))


def ann_topk(spark, sf):
    near = nearest.top_neighbours(
        _every_vector(spark, sf), view(spark, sf, "employer_vectors"), 10, nearest.Cells(dim=64))
    return near.withColumn("similarity", F.round("similarity", 6))


def ann_recall(spark, sf):
    """Whether the approximate search finds nine in ten of the true ten nearest of every vector."""
    near = nearest.top_neighbours(_every_vector(spark, sf), view(spark, sf, "employer_vectors"), 10)
    found = ann_topk(spark, sf).select("query_id", "employer_name", F.lit(1).alias("found"))
    per_query = near.select("query_id", "employer_name").join(found, ["query_id", "employer_name"], "left").groupBy(
        "query_id").agg(F.count("*").alias("neighbours"), F.count("found").alias("found"))
    return per_query.agg(
        F.count("*").alias("queries"), F.sum("neighbours").alias("neighbours"),
        (F.sum("found") >= 0.9 * F.sum("neighbours")).alias("recall_reached"))


def cosine_pairs(spark, sf):
    """Cosine of each vector with the next one, as a plain expression."""
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return e.join(other, "vec_id").select(
        "vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("next")), 6).alias("similarity"))


def vector_literal(spark, sf):
    literal = vectors.to_literal(F.col("embedding"))
    back = vectors.from_literal(literal)
    return table(spark, sf, "embeddings").select(
        "vec_id",
        F.size(back).alias("dims"),
        F.forall(F.zip_with(back, "embedding", lambda a, b: a == b), lambda x: x).alias("same"),
        F.round(F.aggregate(back, F.lit(0.0), lambda acc, x: acc + x), 4).alias("total"))


# --- resolution ---------------------------------------------------------------------


def _names(spark, sf):
    return view(spark, sf, "lookup_names")


def _distinct_names(spark, sf):
    return _names(spark, sf).select(
        text.employer_name(F.col("raw_name")).alias("name")).where("name is not null").distinct()


def _with_vectors(spark, sf, employers: DataFrame):
    """Employers with their sample vectors, and name vectors for the lookups."""
    v = view(spark, sf, "name_vectors").select(
        "side", text.employer_name(F.col("raw_name")).alias("name"), "embedding")
    side = v.where("side = 'employer'").select(F.col("name").alias("employer_name"), "embedding")
    return employers.join(side, "employer_name", "left"), v.where("side = 'lookup'").select("name", "embedding")


def resolve_exact(spark, sf):
    employers = _stored_employers(spark, sf)
    hits = resolving.match_exact(_distinct_names(spark, sf), employers)
    return hits.join(resolving.records(employers), "employer_name")


def resolve_alias(spark, sf):
    employers, aliases = _stored(spark, sf)
    hits = resolving.match_alias(_distinct_names(spark, sf), aliases, employers)
    return hits.join(resolving.records(employers), "employer_name")


def resolve_fuzzy(spark, sf):
    employers = _stored_employers(spark, sf)
    hits = best_containing(materialize(_distinct_names(spark, sf), "names"), employers, 1)
    return hits.select("name", "employer_name", "total_h1b_certified")


def semantic_rerank(spark, sf):
    near = nearest.top_neighbours(
        view(spark, sf, "query_vectors"), view(spark, sf, "employer_vectors"), 10)
    return semantic.rerank(near, LOW_THRESHOLD).withColumn("similarity", F.round("similarity", 6))


def resolve_semantic(spark, sf):
    near = nearest.top_neighbours(
        view(spark, sf, "query_vectors"), view(spark, sf, "employer_vectors"), 10)
    return semantic.decide(near, LOW_THRESHOLD).withColumn("confidence", F.round("confidence", 6))


def resolve_again(spark, sf):
    """The same names twice with a memory: the second time every answer comes from it."""
    base = _run_dir(spark, "answers")
    stored, aliases = _stored(spark, sf)
    employers, lookups = _with_vectors(spark, sf, stored)
    memory = resolving.Memory(spark, base, "run-1")
    resolving.resolve(_names(spark, sf).where("name_id % 2 = 0"), employers, aliases, vectors=lookups, memory=memory)
    out = resolving.resolve(_names(spark, sf), employers, aliases, vectors=lookups, memory=memory)
    return out.select(
        "name_id", "normalized_name", "match_type", F.round("confidence", 6).alias("confidence"),
        "employer_name", "total_h1b_certified")


def resolve_all(spark, sf):
    stored, aliases = _stored(spark, sf)
    employers, lookups = _with_vectors(spark, sf, stored)
    out = resolving.resolve(_names(spark, sf), employers, aliases, vectors=lookups)
    return out.select(
        "name_id", "normalized_name", "match_type", F.round("confidence", 6).alias("confidence"),
        "employer_name", "total_h1b_certified")


def check(spark, sf):
    stored, aliases = _stored(spark, sf)
    employers, lookups = _with_vectors(spark, sf, stored)
    out = resolving.resolve(
        _names(spark, sf), employers, aliases, vectors=lookups, cfg=LOW_THRESHOLD)
    return resolving.check(out).drop("raw_name").withColumn(
        "match_confidence", F.round("match_confidence", 6))


def search(spark, sf):
    names = _names(spark, sf).withColumnRenamed("name_id", "query_id")
    employers = _stored_employers(spark, sf)
    return run_search(names, employers, 5, query="raw_name")


def search_patterns(spark, sf):
    """Wildcards alone, wildcards inside, and names that differ in case, over raw supplier names."""
    names = table(spark, sf, "supplier").select(
        F.col("s_name").alias("employer_name"), (F.col("s_suppkey") % 7).cast("int").alias("total_h1b_certified"))
    asked = table(spark, sf, "supplier").select(
        (F.col("s_suppkey") * 10).alias("query_id"), F.upper("s_name").alias("q"))
    inside = table(spark, sf, "region").select(
        (F.col("r_regionkey") * 10 + 1).alias("query_id"),
        F.concat(F.lit("supplier#0000000_"), F.col("r_regionkey").cast("string")).alias("q"))
    alone = table(spark, sf, "region").select(
        (F.col("r_regionkey") * 10 + 2).alias("query_id"), F.repeat(F.lit("%_"), F.col("r_regionkey") + 1).alias("q"))
    return run_search(asked.union(inside).union(alone), names, 50)


# --- listings -----------------------------------------------------------------------


def _lines(spark, sf):
    return view(spark, sf, "listing_lines")


def _links(spark, sf):
    return view(spark, sf, "listing_links")


def company_slug(spark, sf):
    slug = lt.company_slug(F.col("href"))
    return _links(spark, sf).select(
        "card_id", slug.alias("slug"), lt.name_of_slug(slug).alias("slug_name"),
        lt.company_of_link(F.col("link_text"), F.col("href")).alias("link_name"))


def company_line(spark, sf):
    line, text_ = F.col("line_text"), F.col("text")
    # Texts have columns of their own, so that they are worked out once a line.
    lines = _lines(spark, sf).withColumn("tidy", lt.tidy(line)).withColumn("text", lt.if_text(F.col("tidy")))
    return lines.select(
        "card_id", "line_no", "text",
        lt.looks_like_location(line).alias("is_location"),
        lt.is_company_name(line).alias("is_name"),
        lt.company_of_text(text_).alias("company"),
        lt.is_junk_line(line).alias("is_junk"),
        lt.is_job_title_line(line).alias("is_title"))


def listing_company(spark, sf):
    return annotating.companies(_lines(spark, sf), _links(spark, sf))


def page_links(spark, sf):
    return listings.page_links(table(spark, sf, "pages"), key="page_id")


def listing_company_html(spark, sf):
    """Companies of cards whose links have to be read out of their markup first."""
    return annotating.companies(_lines(spark, sf), listings.page_links(view(spark, sf, "card_pages")))


def listing_places(spark, sf):
    """All nine places a name can come from, and rows around a card."""
    texts = view(spark, sf, "place_texts")
    return annotating.companies(
        view(spark, sf, "deep_lines"), view(spark, sf, "half_links"),
        detail_links=view(spark, sf, "detail_links"), detail_blocks=view(spark, sf, "detail_blocks"),
        texts={n: texts.where(F.col("place") == n) for n in (
            listings.SELECTOR, listings.LOCKUP, listings.PRIMARY, listings.LATE_LOCKUP, listings.FALLBACK)})


def distinct_cards(spark, sf):
    lines, links = _lines(spark, sf), _links(spark, sf)
    sources = (
        links.where(lt.company_slug(F.col("href")).isNotNull()).select("card_id", F.col("link_no").alias("ord")),
        lines.where(F.col("card_id") % 3 > 0).select("card_id", F.col("line_no").alias("ord")),
        lines.select("card_id", F.col("line_no").alias("ord")))
    return listings.distinct_cards(*sources)


def listing_annotate(spark, sf):
    out = annotating.annotate(_lines(spark, sf), _links(spark, sf), *_stored(spark, sf))
    return out.select("card_id", "company_name", "employer_name", "h1b_count", "match_type", "label")


def listing_stats(spark, sf):
    out = annotating.annotate(_lines(spark, sf), _links(spark, sf), *_stored(spark, sf))
    return listings.session_stats(
        out.withColumn("session_id", F.col("card_id") % 50), "session_id")


# --- requests and events ------------------------------------------------------------


def rate_limit(spark, sf):
    log = view(spark, sf, "request_log").withColumn(
        "client", lt.client_id(F.col("x_forwarded_for"), F.col("host")))
    out = requests.rate_limit(log, Limits((("1 hour", 2), ("1 day", 5))))
    return out.select("event_id", "client", "endpoint", "refused_by")


def burst_sessions(spark, sf):
    out = requests.bursts(table(spark, sf, "events"), "user_id", gap=4 * 3600.0)
    times = ["burst_start", "burst_end", "fires_at"]
    return out.select("user_id", "events", *[F.unix_micros(c).alias(c) for c in times])


def attempt_abandon(spark, sf):
    return attempts.abandoned(
        table(spark, sf, "events"), F.col("event_type") == "error", card="user_id",
        max_attempts=3)


def miss_report(spark, sf):
    misses = table(spark, sf, "events").where("event_type = 'error'").select(
        F.col("user_id").alias("card_id"), "ts", "event_id",
        F.concat(F.lit("https://jobs.example/list/"), F.col("user_id") % 7).alias("url"),
        F.repeat("props", 40).alias("html"))
    return attempts.miss_reports(misses).select("card_id", "event_id", "url", "html")


def misses_per_url(spark, sf):
    return attempts.misses_per_url(miss_report(spark, sf))


# --- streams, drained ---------------------------------------------------------------


def _stream(spark, sf, name: str) -> DataFrame:
    """One sample table as a file stream."""
    schema = table(spark, sf, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


def _run_dir(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stream_resolve(spark, sf):
    base = _run_dir(spark, "stream-resolve")
    names = _stream(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("name_id"), F.col("s_name").alias("raw_name"))
    resolve_stream(
        names, *_stored(spark, sf), f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/out").select(
        "name_id", "normalized_name", "match_type", "employer_name", "total_h1b_certified")


def _in_batches(spark, sf, base: str, start: Callable[[DataFrame], StreamingQuery], parts: int = 4) -> None:
    """The events as a stream of several batches, dealt by a hash and so out of order."""
    events = table(spark, sf, "events")
    _in_parts(events.withColumn("_part", F.pmod(F.xxhash64("event_id"), F.lit(parts))), base, start, parts)


def _late_batches(spark, sf, base: str, start: Callable[[DataFrame, str], StreamingQuery], parts: int = 4) -> None:
    """The events as a stream of several batches in the order of time, two thirds of them late, and how late."""
    events = table(spark, sf, "events")
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    first, last = events.agg(F.min(at), F.max(at)).first()
    third = max(1, ((last or 0) - (first or 0)) // 12)
    arrives = at - (first or 0) + F.pmod(F.xxhash64("event_id"), F.lit(3)) * third
    part = F.floor(arrives * parts / ((last or 0) - (first or 0) + 2 * third + 1))
    late = f"{2 * third + 1} seconds"
    _in_parts(events.withColumn("_part", part), base, lambda stream: start(stream, late), parts)


def _in_parts(events: DataFrame, base: str, start: Callable[[DataFrame], StreamingQuery], parts: int) -> None:
    """Write one part after another; the stream goes on from its checkpoint and takes each as one batch.

    A part has as many files as the table's size makes it, so a batch of a file or a few would add
    batches, each with its own round of state, and take a part in pieces that are not in its order.
    """
    for i in range(parts):
        events.where(F.col("_part") == i).drop("_part").write.parquet(f"{base}/events/p{i}")
        arrived = (events.sparkSession.readStream.schema(events.drop("_part").schema)
                   .option("recursiveFileLookup", True).parquet(f"{base}/events"))
        start(arrived.withColumn("ts", F.col("ts").cast("timestamp"))).awaitTermination()


def _windows(spark, sf, base: str, windows: Callable[[DataFrame], DataFrame], keys: list[str]) -> DataFrame:
    _in_batches(spark, sf, base, lambda events: event_streams.write_windows(
        windows(events), f"{base}/out", f"{base}/checkpoint", keys))
    out = event_streams.current_windows(spark, f"{base}/out", keys)
    return out.withColumn("window_start", F.unix_micros("window_start"))


def stream_dedup(spark, sf):
    base, keys = _run_dir(spark, "stream-dedup"), ["user_id", "event_type"]
    _in_batches(spark, sf, base, lambda events: event_streams.write_unseen(
        events.select(*keys), keys, f"{base}/out", f"{base}/checkpoint"))
    return Batches(spark, f"{base}/out").read()


def stream_intake(spark, sf):
    """The last files first: a case keeps the copy of its best file all the same."""
    base = _run_dir(spark, "stream-intake")
    raw = _raw(spark, sf)
    for priority in (4, 2, 3, 1):
        raw.where(F.col("file_priority") == priority).write.parquet(f"{base}/raw/q{priority}")
    files = (spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 4)
             .option("recursiveFileLookup", True).parquet(f"{base}/raw"))
    intake_stream(files, f"{base}/cases", f"{base}/checkpoint", ORDER).awaitTermination()
    return stored_cases(spark, f"{base}/cases", ORDER)


def stream_abandon(spark, sf):
    base = _run_dir(spark, "stream-abandon")
    _late_batches(spark, sf, base, lambda events, late: event_streams.write_abandoned(
        events, F.col("event_type") == "error", f"{base}/out", f"{base}/checkpoint", card="user_id", max_attempts=3,
        lateness=late))
    return event_streams.current_abandoned(spark, f"{base}/out", card="user_id", max_attempts=3).select(
        "user_id", "abandoned_event_id")


def stream_limits(spark, sf):
    base = _run_dir(spark, "stream-limits")

    def breaches(events):
        log = events.withColumn("client", F.col("user_id") % 10)
        # All of history arrives shuffled, so the whole range may be late.
        return event_streams.limit_breaches(log, Limits((("1 hour", 2), ("1 day", 5))), lateness=EVER)

    return _windows(spark, sf, base, breaches, ["client", "limit_no", "window_start"])


def stream_bursts(spark, sf):
    base = _run_dir(spark, "stream-bursts")
    _late_batches(spark, sf, base, lambda events, late: event_streams.write_bursts(
        events, "user_id", "4 hours", f"{base}/out", f"{base}/checkpoint", lateness=late))
    out = event_streams.current_bursts(spark, f"{base}/out", "user_id", "4 hours")
    return out.select(
        "user_id", F.unix_micros("burst_start").alias("burst_start"), F.unix_micros("fires_at").alias("fires_at"), "events")


def stream_stats(spark, sf):
    base = _run_dir(spark, "stream-stats")

    def counters(events):
        labelled = events.withColumn("session_id", F.col("user_id") % 5)
        return event_streams.session_counters(
            labelled, "session_id", F.col("event_type") == "purchase", lateness=EVER)

    return _windows(spark, sf, base, counters, ["session_id", "window_start"])


def stream_misses(spark, sf):
    base = _run_dir(spark, "stream-misses")

    def counts(events):
        misses = events.where("event_type = 'error'").withColumn(
            "url", F.concat(F.lit("https://jobs.example/list/"), F.col("user_id") % 7))
        return event_streams.miss_counts(misses, lateness=EVER)

    return _windows(spark, sf, base, counts, ["url", "window_start"])


def stream_logged(spark, sf):
    """Reported misses appended with their page text cut."""
    base = _run_dir(spark, "stream-logged")
    _in_batches(spark, sf, base, lambda events: event_streams.write_misses(
        events.where("event_type = 'error'").select("event_id", F.repeat("props", 60).alias("html")),
        f"{base}/out", f"{base}/checkpoint"))
    return spark.read.schema("event_id long, html string").parquet(f"{base}/out")


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    clean_cases, employers_agg, job_levels, aliases_agg, aliases_merged, simple_counts_top10,
    employers_placed, job_levels_placed, aliases_placed, merged_aliases_placed, folder_counts, counts_upsert,
    curated_from_file, pending_first,
    intake_summary, file_counters, date_parse, summary_from_states, load_coercion, employer_upsert, employer_deltas,
    alias_scoped_replace, load_replace, embedding_fill_store, filings_from_files, embedding_merge, embedding_coverage, embedding_batches, cosine_topk,
    ann_topk, ann_recall, cosine_pairs, vector_literal, resolve_exact, resolve_alias, resolve_fuzzy,
    semantic_rerank, resolve_semantic, resolve_all, resolve_again, check, search, search_patterns, company_slug, company_line,
    listing_company, page_links, listing_company_html, listing_places, distinct_cards, listing_annotate, listing_stats, rate_limit, burst_sessions,
    attempt_abandon, miss_report, misses_per_url, stream_resolve, stream_dedup, stream_intake,
    stream_abandon, stream_limits, stream_bursts, stream_stats, stream_misses, stream_logged,
)}
