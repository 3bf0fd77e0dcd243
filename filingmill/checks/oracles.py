"""The same results as plain SQL for DuckDB, written apart from the Spark code."""

from __future__ import annotations

from ..sources.sample_views import VIEWS

_MISSING = "('', 'nan', 'none', 'n/a', '#n/a', 'null')"


def _gone(c: str) -> str:
    return f"({c} is null or lower(trim({c})) in {_MISSING})"


def _emp(c: str) -> str:
    s = f"regexp_replace(upper(trim({c})), '\\s+', ' ', 'g')"
    for suffix in ("INC", "LLC", "CORP", "CO", "LTD"):
        s = f"replace({s}, ' {suffix}.', ' {suffix}')"
    return f"case when {_gone(c)} then null else nullif(trim({s}), '') end"


def _title(c: str) -> str:
    s = f"regexp_replace(upper(trim({c})), '\\(.*?\\)', '', 'g')"
    s = f"trim(regexp_replace({s}, '-SENIOR$', ''))"
    s = f"trim(regexp_replace({s}, '-JR$', ''))"
    s = f"regexp_replace({s}, '\\bSR\\.\\s+', 'SENIOR ', 'g')"
    s = f"regexp_replace({s}, '\\bJR\\.\\s+', 'JUNIOR ', 'g')"
    s = f"regexp_replace({s}, '\\bMGR\\b', 'MANAGER', 'g')"
    return f"case when {_gone(c)} then null else nullif(trim(regexp_replace({s}, '\\s+', ' ', 'g')), '') end"


def _date(c: str) -> str:
    parsed = f"try_strptime(trim({c}), ['%Y-%m-%d', '%m/%d/%Y', '%m-%d-%Y', '%Y/%m/%d'])"
    return f"case when {_gone(c)} then null else coalesce(strftime({parsed}, '%Y-%m-%d'), trim({c})) end"


def _cases(name: str, source: str) -> str:
    return f"""{name} as (
  select case_number, {_date('decision_date')} as decision_date, {_title('job_title')} as job_title,
    case when {_gone('soc_code')} then null else trim(soc_code) end as soc_code,
    {_emp('employer_name')} as employer_name, {_emp('trade_name_dba')} as trade_name_dba,
    case when upper(trim(pw_wage_level)) in ('I', 'II', 'III', 'IV') then upper(trim(pw_wage_level)) end as pw_wage_level,
    case upper(trim(h1b_dependent)) when 'Y' then true when 'N' then false end as h1b_dependent
  from (
    select *, row_number() over (partition by trim(case_number) order by file_priority, partkey, suppkey) as rn
    from {source}
    where trim(case_status) = 'Certified' and trim(visa_class) = 'H-1B'
      and not {_gone('case_number')} and {_emp('employer_name')} is not null)
  where rn = 1)"""


def _employers(name: str, cases: str) -> str:
    return f"""{name} as (
  select employer_name, count(*) as total_h1b_certified, min(decision_date) as earliest_decision_date,
    max(decision_date) as latest_decision_date,
    try_cast(substr(max(decision_date), 1, 4) as integer) as last_active_year,
    case when sum((h1b_dependent is true)::int) > sum((h1b_dependent is false)::int) then true
         when sum((h1b_dependent is true)::int) < sum((h1b_dependent is false)::int) then false end as h1b_dependent
  from {cases} group by employer_name)"""


_AUTO = """auto as (
  select employer_name as primary_employer_name, trade_name_dba as alias_name,
    'TRADE_NAME_DBA' as alias_type, count(*) as usage_count
  from cases where trade_name_dba is not null and trade_name_dba <> employer_name group by 1, 2)"""


def _curated(name: str, where: str) -> str:
    return f"""{name} as (
  select primary_employer_name, alias_name, alias_type, usage_count from (
    select *, row_number() over (partition by alias_name order by line_no desc) as rn from (
      select line_no, {_emp('primary_employer_name')} as primary_employer_name, {_emp('alias_name')} as alias_name,
        trim(coalesce(nullif(alias_type, ''), 'MANUAL_CURATED')) as alias_type,
        coalesce(try_cast(usage_count as bigint), 0) as usage_count
      from curated_raw where {where})
    where primary_employer_name is not null and alias_name is not null)
  where rn = 1)"""


_MERGED = f"""merged as (
  select * from curated
  union all select * from auto where {_emp('alias_name')} not in (select alias_name from curated))"""

_NAMES = f"""names as (
  select distinct {_emp('raw_name')} as name from lookup_names where {_emp('raw_name')} is not null)"""

_CASES = _cases("cases", "lca_raw")
_EMPLOYERS = _employers("employers", "cases")
_ONE_ALIAS = """one_alias as (
  select alias_name, primary_employer_name from (
    select *, row_number() over (partition by alias_name order by usage_count desc, primary_employer_name) as rn from merged)
  where rn = 1)"""

_FUZZY = """hits as (
  select name, employer_name, total_h1b_certified, row_number() over (
      partition by name order by total_h1b_certified desc, employer_name) as place
  from {names} join employers on employer_name ilike '%' || name || '%')"""

_NEAR = """near as (
  select * from (
    select query_id, employer_name, coalesce(total_h1b_certified, 0)::bigint as total_h1b_certified, similarity,
      row_number() over (partition by query_id order by similarity desc, employer_name) as place
    from (select query_id, employer_name, total_h1b_certified,
            list_cosine_similarity(query_embedding::double[], embedding::double[]) as similarity
          from {queries} cross join {names} where embedding is not null and query_embedding is not null))
  where place <= 10)"""

_VECTOR_NEAR = _NEAR.format(queries="query_vectors", names="employer_vectors")


def _decide(threshold: float) -> str:
    return f"""decided as (
  select query_id,
    case when s0 >= {threshold} and (s1 is null or s0 - s1 >= 0.04) then best end as employer_name,
    case when s0 >= {threshold} and (s1 is null or s0 - s1 >= 0.04)
      then case when s0 - s1 < 0.1 then s0 * 0.9 else s0 end end as confidence
  from (select query_id, max(case when place = 1 then similarity end) as s0,
          max(case when place = 2 then similarity end) as s1,
          max(case when place = 1 then employer_name end) as best from near group by query_id))"""


def _resolved(threshold: float) -> str:
    near = _NEAR.format(queries="rest_vectors", names="employers_v")
    return f"""exact as (select name, employer_name from names join employers on name = employer_name),
alias as (
  select name, employer_name from names join one_alias on name = alias_name
    join employers on employer_name = primary_employer_name
  where name not in (select name from exact)),
rest1 as (select name from names where name not in (select name from exact union all select name from alias)),
{_FUZZY.format(names='rest1')},
fuzzy as (select name, employer_name from hits where place = 1),
rest2 as (select name from rest1 where name not in (select name from fuzzy)),
v as (select side, {_emp('raw_name')} as name, embedding from name_vectors),
rest_vectors as (select rest2.name as query_id, embedding as query_embedding from rest2 join v on v.name = rest2.name and side = 'lookup'),
employers_v as (select employers.*, v.embedding from employers join v on v.name = employer_name and side = 'employer'),
{near},
{_decide(threshold)},
found as (
  select name, employer_name, 'exact' as match_type, 1.0::double as confidence from exact
  union all select name, employer_name, 'alias', 1.0 from alias
  union all select name, employer_name, 'fuzzy', 1.0 from fuzzy
  union all select query_id, employer_name, 'semantic', confidence from decided where employer_name is not null),
resolved as (
  select name_id, n.name as normalized_name,
    case when n.name is null then 'invalid_input' else coalesce(match_type, 'miss') end as match_type,
    round(confidence, 6) as confidence, e.*
  from (select name_id, {_emp('raw_name')} as name from lookup_names) n
    left join found on found.name = n.name left join employers e on e.employer_name = found.employer_name)"""


def _listing_text(c: str) -> str:
    t = f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"
    bad = " or ".join(f"regexp_matches({t}, '{p}', 'i')" for p in (
        r"^\d+\s+school alumni", "^promoted$", r"^in\s+easy apply$",
        r"\$\d|/yr|401\s*\(\s*k\s*\)", r"^\d+\s+(day|week|month)s?\s+ago$"))
    return f"case when {t} <> '' and len({t}) <= 200 and not ({bad}) then {t} end"


def _location(c: str) -> str:
    return (f"coalesce({c} = '' or regexp_matches({c}, '\\(remote\\)|\\(on-site\\)|\\(hybrid\\)', 'i') or "
            f"(regexp_matches({c}, ',\\s*[A-Z]{{2}}(\\s|$|\\))', 'i') and not contains({c}, '·')), true)")


def _named(c: str) -> str:
    return (f"coalesce(len({c}) between 2 and 70 and not regexp_matches({c}, 'followers|premium|insights|show\\s+', 'i') "
            f"and not regexp_matches({c}, '\\d{{1,3}}(,\\d{{3}})+') and not regexp_matches({c}, '^[\\d,.\\s]+$'), false)")


def _company(c: str) -> str:
    part = _listing_text("p")
    return (f"list_filter(list_transform(string_split({_listing_text(c)}, '·'), lambda p: {part}), "
            f"lambda n: not {_location('n')} and {_named('n')})[1]")


# The page patterns, as the listing functions have them.
_META = (r"^[•·\-–—]+$|^(be an early|easy apply|actively|get job alerts)|promoted jobs are ranked|how promoted"
         r"|\d+\+?\s*results?\b|\bbe an early applicant\b|\d+\s*(benefit|connection|applicant|result|follower)s?\b"
         r"|\b(ago|viewed|about|premium|easy apply|actively|posted|reposted)\b|^[\d,]+$|%|^(your feedback|show)")
_TITLE_WORDS = (
    r"\b(engineer|developer|architect|manager|analyst|scientist|designer|consultant|specialist|director|lead|senior"
    r"|junior|staff|principal|intern|associate|founder|officer|executive|full[\s-]?stack|front[\s-]?end|back[\s-]?end"
    r"|machine[\s-]?learning|software|generative|agentic|emerging)\b")
_PLACE = r"\b(remote|hybrid|on[\s-]?site)\b|,\s*[A-Z]{2}\b|\([A-Za-z\s]+,\s*[A-Z]{2}\)"


def _junk(c: str) -> str:
    return f"coalesce(len({c}) < 2 or regexp_matches({c}, '{_META}', 'i'), true)"


_SLUG = """nullif(nullif(trim(url_decode(replace(
    regexp_extract(href, '(?i)linkedin\\.com/company/([^/?#]+)', 1), '+', '%2B'))), ''), 'unavailable')"""
_SLUG_NAME = f"trim(regexp_replace(replace({_SLUG}, '-', ' '), '\\s+', ' ', 'g'))"

_COMPANIES = f"""tidy as (
  select card_id, text, min(line_no) as line_no
  from (select card_id, line_no, {_listing_text('line_text')} as text from listing_lines)
  where text is not null and not {_junk('text')} group by all),
placed as (select *, row_number() over (partition by card_id order by len(text) desc, line_no) as size_place from tidy),
fit as (
  select *, row_number() over (partition by card_id order by line_no) as rn from placed
  where size_place > 1 and len(text) between 2 and 60 and not regexp_matches(text, '{_TITLE_WORDS}', 'i')
    and not regexp_matches(text, '{_PLACE}', 'i') and not regexp_matches(text, '{_META}', 'i')),
from_lines as (select card_id, coalesce({_company('text')}, text) as name from fit where rn = 1),
linked as (
  select card_id, link_no, {_listing_text('link_text')} as text, {_SLUG_NAME} as slug_name
  from listing_links where {_SLUG} is not null),
choice as (
  select card_id, 1 as priority, 0 as ord, name from from_lines where {_named('name')}
  union all select card_id, 6, link_no, text from linked where {_named('text')}
  union all select card_id, 7, link_no, slug_name from linked where {_named('slug_name')}),
companies as (
  select card_id, name as company_name, priority
  from (select *, row_number() over (partition by card_id order by priority, ord) as rn from choice) where rn = 1)"""

_ANNOTATED = f"""exact as (select name, employer_name from names join employers on name = employer_name),
alias as (
  select name, employer_name from names join one_alias on name = alias_name
    join employers on employer_name = primary_employer_name
  where name not in (select name from exact)),
rest1 as (select name from names where name not in (select name from exact union all select name from alias)),
{_FUZZY.format(names='rest1')},
found as (
  select name, employer_name, 'exact' as match_type from exact
  union all select name, employer_name, 'alias' from alias
  union all select name, employer_name, 'fuzzy' from hits where place = 1),
annotated as (
  select card_id, company_name, e.employer_name, e.total_h1b_certified as h1b_count,
    case when {_emp('company_name')} is null then 'invalid_input' else match_type end as match_type,
    case when e.employer_name is null then '✗ Not Found' else '✓ Sponsors H1B' end as label
  from companies left join found on found.name = {_emp('company_name')}
    left join employers e on e.employer_name = found.employer_name)"""


def _sql(views: list[str], ctes: list[str], select: str) -> str:
    parts = [f"{v} as ({VIEWS[v]})" for v in views] + ctes
    return ("with " + ",\n".join(parts) + "\n" if parts else "") + select


_ALIAS_CTES = [_CASES, _AUTO, _curated("curated", "true"), _MERGED]
_RESOLVE_VIEWS = ["lca_raw", "curated_raw", "lookup_names", "name_vectors"]


def _resolve_ctes(threshold: float) -> list[str]:
    return [*_ALIAS_CTES, _EMPLOYERS, _ONE_ALIAS, _NAMES, _resolved(threshold)]


ORACLES: dict[str, str] = {
    "clean_cases": _sql(["lca_raw"], [_CASES], "select * from cases"),
    "employers_agg": _sql(["lca_raw"], [_CASES, _EMPLOYERS], "select * from employers"),
    "job_levels": _sql(["lca_raw"], [_CASES], """
select employer_name, job_title as normalized_job_title, soc_code,
  level_1_count, level_2_count, level_3_count, level_4_count, total_count,
  round_even(level_1_count / total_count * 100, 2) as level_1_pct,
  round_even(level_2_count / total_count * 100, 2) as level_2_pct,
  round_even(level_3_count / total_count * 100, 2) as level_3_pct,
  round_even(level_4_count / total_count * 100, 2) as level_4_pct
from (
  select employer_name, job_title, soc_code,
    count(*) filter (pw_wage_level = 'I') as level_1_count,
    count(*) filter (pw_wage_level = 'II') as level_2_count,
    count(*) filter (pw_wage_level = 'III') as level_3_count,
    count(*) filter (pw_wage_level = 'IV') as level_4_count,
    count(pw_wage_level) as total_count
  from cases group by all)
where total_count > 0"""),
    "aliases_agg": _sql(["lca_raw"], [_CASES, _AUTO], "select * from auto"),
    "aliases_merged": _sql(["lca_raw", "curated_raw"], _ALIAS_CTES, "select * from merged"),
    "simple_counts_top10": _sql(["lca_raw"], [], """
select upper(trim(employer_name)) as employer_name, count(*) as h1b_count from lca_raw
where case_status = 'Certified' and employer_name <> ''
group by 1 order by h1b_count desc, employer_name limit 10"""),
    "file_counters": _sql(["lca_raw"], [_CASES, f"""ok as (
  select file_priority, trim(case_number) as case_number from lca_raw
  where trim(case_status) = 'Certified' and trim(visa_class) = 'H-1B'
    and not {_gone('case_number')} and {_emp('employer_name')} is not null)"""], """
select file_priority::integer as file_priority, (select count(*) from lca_raw r where r.file_priority = f.file_priority) as total_rows,
  (select count(distinct case_number) from ok where ok.file_priority = f.file_priority) as kept_unique,
  (select count(*) from (select case_number, min(file_priority) as m from ok group by 1) w where w.m = f.file_priority) as new_cases
from (select distinct file_priority from lca_raw) f"""),
    "intake_summary": _sql(["lca_raw", "curated_raw"], _ALIAS_CTES, f"""
select (select count(*) from lca_raw)::bigint as rows_scanned,
  (select count(distinct (file_priority, trim(case_number))) from lca_raw
    where trim(case_status) = 'Certified' and trim(visa_class) = 'H-1B'
      and not {_gone('case_number')} and {_emp('employer_name')} is not null)::bigint as rows_kept,
  (select count(*) from cases) as unique_cases,
  (select count(distinct employer_name) from cases) as employers,
  (select count(distinct job_title) from cases) as job_titles,
  (select count(*) from cases where try_strptime(decision_date, '%Y-%m-%d') is null and decision_date is not null) as unparsed_dates,
  (select count(*) from merged) as aliases"""),
    "date_parse": _sql(["date_texts"], [], f"select id, {_date('txt')} as decision_date from date_texts"),
    "load_coercion": _sql(["loaded_text"], [], """
select nullif(trim(employer_name), '') as employer_name,
  coalesce(case when regexp_full_match(trim(total_text), '[+-]?[0-9]+') then try_cast(trim(total_text) as integer) end, 0) as total,
  try_cast(nullif(trim(pct_text), '') as double) as pct,
  case when lower(trim(flag_text)) in ('true', '1', 'yes') then true
       when lower(trim(flag_text)) in ('false', '0', 'no') then false end as flag,
  cast(try_cast(nullif(trim(date_text), '') as date) as varchar) as day
from loaded_text where nullif(trim(employer_name), '') is not null"""),
    "employer_upsert": _sql(["lca_raw", "name_vectors"], [
        "old_raw as (select * from lca_raw where file_priority <= 2 and suppkey % 5 > 0)",
        "new_raw as (select * from lca_raw where file_priority >= 2 and suppkey % 5 < 4)",
        _cases("old_cases", "old_raw"), _cases("new_cases", "new_raw"),
        _employers("old", "old_cases"), _employers("new", "new_cases"),
        f"v as (select {_emp('raw_name')} as name, embedding from name_vectors where side = 'employer')",
    ], """
select coalesce(n.employer_name, o.employer_name) as employer_name,
  (case when n.employer_name is not null then n.total_h1b_certified else o.total_h1b_certified end)::integer as total_h1b_certified,
  case when n.employer_name is not null then n.earliest_decision_date else o.earliest_decision_date end as earliest_decision_date,
  case when n.employer_name is not null then n.latest_decision_date else o.latest_decision_date end as latest_decision_date,
  case when n.employer_name is not null then n.last_active_year else o.last_active_year end as last_active_year,
  case when n.employer_name is not null then n.h1b_dependent else o.h1b_dependent end as h1b_dependent,
  case when n.employer_name is not null then '2025-06-01' else '2025-01-01' end as last_updated,
  (o.employer_name is not null and v.embedding is not null) as has_embedding
from new n full join old o on n.employer_name = o.employer_name
  left join v on v.name = o.employer_name"""),
    "alias_scoped_replace": _sql(
        ["lca_raw", "curated_raw"], [*_ALIAS_CTES, _curated("fresh", "line_no % 5 < 3")], """
select * from merged where alias_type <> 'MANUAL_CURATED'
union all select primary_employer_name, alias_name, 'MANUAL_CURATED', usage_count from fresh"""),
    "load_replace": _sql(["lca_raw"], [_CASES, _AUTO], """
select primary_employer_name, alias_name, alias_type, usage_count::integer as usage_count from auto"""),
    "embedding_fill_store": _sql(["lca_raw"], [_CASES, _EMPLOYERS], """
select employer_name, total_h1b_certified::integer as total_h1b_certified, 2::integer as dims,
  len(employer_name)::double as first_value from employers"""),
    "filings_from_files": _sql(["lca_raw"], [_CASES], "select * from cases"),
    "embedding_merge": _sql(["employer_vectors"], [], """
select id, employer_name, coalesce(len(emb), 0)::integer as dims, round(emb[1]::double, 6) as first_value
from (select e.id, e.employer_name, coalesce(e.embedding, case when n.vec_id % 28 = 0 then n.embedding end) as emb
      from employer_vectors e left join (select * from embeddings where vec_id % 14 = 0) n on n.vec_id = e.id)"""),
    "embedding_coverage": _sql(["employer_vectors"], [], """
select count(*) as total, count(*) - count(embedding) as pending, count(embedding) as done,
  ((count(*) - count(embedding)) * 5)::bigint as estimated_tokens,
  round((count(*) - count(embedding)) * 5 / 1000000 * 0.02, 6)::double as estimated_cost_usd
from employer_vectors"""),
    "embedding_batches": _sql(["employer_vectors"], [], """
select batch_no, rows, tokens, (sum(rows) over w)::bigint as rows_so_far, (sum(tokens) over w)::bigint as tokens_so_far,
  round((sum(tokens) over w)::double / 1000000 * 0.02, 9)::double as cost_so_far_usd
from (
  select batch_no, count(*) as rows, (sum(len(string_split(employer_name, ' '))))::bigint as tokens
  from (select employer_name, ((row_number() over (order by id) - 1) // 10 + 1)::bigint as batch_no
        from employer_vectors where embedding is null)
  group by batch_no)
window w as (order by batch_no rows unbounded preceding)"""),
    "cosine_topk": _sql(["query_vectors", "employer_vectors"], [_VECTOR_NEAR], """
select query_id, employer_name, total_h1b_certified, round(similarity, 6) as similarity, place::integer as place from near"""),
    "ann_recall": _sql(["employer_vectors"], ["""pairs as (
  select vec_id as query_id, row_number() over (
    partition by vec_id order by list_cosine_similarity(q.embedding::double[], n.embedding::double[]) desc, employer_name) as place
  from embeddings q, employer_vectors n where q.embedding is not null and n.embedding is not null)"""], """
select count(distinct query_id) as queries, count(*)::bigint as neighbours, true as recall_reached
from pairs where place <= 10"""),
    "cosine_pairs": """
select a.vec_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as similarity
from embeddings a join embeddings b on b.vec_id = a.vec_id + 1""",
    "vector_literal": """
select vec_id, len(embedding)::integer as dims, true as same,
  round(list_sum(embedding::double[]), 4) as total from embeddings""",
    "resolve_exact": _sql(["lca_raw", "lookup_names"], [_CASES, _EMPLOYERS, _NAMES], """
select name, employers.* from names join employers on name = employer_name"""),
    "resolve_alias": _sql(
        ["lca_raw", "curated_raw", "lookup_names"],
        [*_ALIAS_CTES, _EMPLOYERS, _ONE_ALIAS, _NAMES], """
select name, employers.* from names join one_alias on name = alias_name
  join employers on employer_name = primary_employer_name"""),
    "resolve_fuzzy": _sql(
        ["lca_raw", "lookup_names"], [_CASES, _EMPLOYERS, _NAMES, _FUZZY.format(names="names")], """
select name, employer_name, total_h1b_certified from hits where place = 1"""),
    "semantic_rerank": _sql(["query_vectors", "employer_vectors"], [_VECTOR_NEAR, """
tops as (
  select query_id, max(case when place = 1 then similarity end) as s0, max(case when place = 2 then similarity end) as s1
  from near group by query_id)""", """pool as (
  select n.*, similarity * ln(1 + greatest(total_h1b_certified, 0)) as score
  from near n join tops using (query_id)
  where s0 - s1 < 0.04 and place <= 6 and similarity >= greatest(0.35 - 0.05, least(s0, s1) - 0.02))""", """best as (
  select query_id, place as best_place from (
    select *, row_number() over (partition by query_id order by score desc, place) as rn,
      count(*) over (partition by query_id) as n from pool)
  where rn = 1 and n >= 2 and similarity >= 0.35)"""], """
select query_id, employer_name, total_h1b_certified, round(similarity, 6) as similarity,
  (case when place = best_place then 1 when place < best_place then place + 1 else place end)::integer as place
from near left join best using (query_id)"""),
    "resolve_semantic": _sql(
        ["query_vectors", "employer_vectors"], [_VECTOR_NEAR, _decide(0.35)],
        "select query_id, employer_name, round(confidence, 6) as confidence from decided"),
    "resolve_all": _sql(_RESOLVE_VIEWS, _resolve_ctes(0.75), """
select name_id, normalized_name, match_type, confidence, employer_name, total_h1b_certified from resolved"""),
    "check": _sql(_RESOLVE_VIEWS, _resolve_ctes(0.35), """
select name_id, employer_name is not null as found, employer_name, total_h1b_certified as h1b_count,
  employer_name is not null as sponsors_h1b, nullif(match_type, 'miss') as match_type,
  confidence as match_confidence, earliest_decision_date, latest_decision_date, last_active_year, h1b_dependent
from resolved"""),
    "search": _sql(["lca_raw", "lookup_names"], [_CASES, _EMPLOYERS, _NAMES, _FUZZY.format(names="names")], f"""
select name_id as query_id, place::integer as place, employer_name, total_h1b_certified as h1b_count,
  -- a wildcard query differs in one character from the best piece of each of its matches
  case when contains(qn, '_') then round(100 * (len(qn) - 1) / len(qn))::integer else 100 end as score,
  count(*) over (partition by name_id) as total
from (select name_id, {_emp('raw_name')} as qn from lookup_names) join hits on hits.name = qn
where place <= 5"""),
    # Scores by hand: a name in another case shares the S and ten characters of eighteen, one
    # with a wildcard all but the wildcard and seven letters; wildcards alone share nothing.
    "search_patterns": """
with asked as (
  select s_suppkey * 10 as query_id, upper(s_name) as q, round(100.0 * 22 / 36) as score from supplier
  union all select r_regionkey * 10 + 1, 'SUPPLIER#0000000_' || r_regionkey, round(100.0 * 20 / 36) from region
  union all select r_regionkey * 10 + 2, repeat('%_', (r_regionkey + 1)::integer), 0 from region),
hits as (
  select query_id, s_name as employer_name, (s_suppkey % 7)::bigint as h1b_count, score::integer as score,
    row_number() over (partition by query_id order by s_suppkey % 7 desc, s_name) as place
  from asked join supplier on s_name ilike '%' || q || '%')
select query_id, place::integer as place, employer_name, h1b_count, score,
  count(*) over (partition by query_id) as total
from hits where place <= 50""",
    "company_slug": _sql(["listing_links"], [], f"""
select card_id, {_SLUG} as slug, {_SLUG_NAME} as slug_name,
  coalesce({_company('link_text')}, case when {_named(_SLUG_NAME)} then {_SLUG_NAME} end) as link_name
from listing_links"""),
    "company_line": _sql(["listing_lines"], [], f"""
select card_id, line_no, {_listing_text('line_text')} as text, {_location('line_text')} as is_location,
  {_named('line_text')} as is_name, {_company('line_text')} as company, {_junk('line_text')} as is_junk,
  regexp_matches(line_text, '{_TITLE_WORDS}', 'i') as is_title
from listing_lines"""),
    "listing_company": _sql(["listing_lines", "listing_links"], [_COMPANIES], "select * from companies"),
    # The same links, so the same companies.
    "listing_company_html": _sql(["listing_lines", "listing_links"], [_COMPANIES], "select * from companies"),
    "page_links": """
with shown as (
  select page_id, regexp_replace(regexp_replace(html, '(?s)<script.*?</script>', '', 'g'), '(?s)<!--.*?-->', '', 'g') as h from pages),
found as (
  select page_id, unnest(a) as a, unnest(range(len(a))) as link_no
  from (select page_id, regexp_extract_all(h, '(?s)<a href="[^"]*">.*?</a>') as a from shown)),
cut as (
  select page_id, link_no, regexp_extract(a, '<a href="([^"]*)"', 1) as href,
    regexp_replace(regexp_extract(a, '(?s)^<a [^>]*>(.*)</a>$', 1), '<[^>]*>', '', 'g') as link_text from found)
select page_id, link_no::integer as link_no,
  replace(replace(replace(replace(href, '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&') as href,
  replace(replace(replace(replace(link_text, '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&') as link_text
from cut""",
    "listing_places": _sql(["deep_lines", "half_links", "place_texts", "detail_links", "detail_blocks"], [f"""tidy as (
  select card_id, depth, text, min(line_no) as line_no
  from (select card_id, depth, line_no, {_listing_text('line_text')} as text from deep_lines)
  where text is not null and not {_junk('text')} group by all)""", """placed as (
  select *, row_number() over (partition by card_id, depth order by len(text) desc, line_no) as size_place,
    count(*) over (partition by card_id, depth) as kept from tidy)""", f"""fit as (
  select *, row_number() over (partition by card_id, depth order by line_no) as rn from placed
  where size_place > 1 and len(text) between 2 and 60 and not regexp_matches(text, '{_TITLE_WORDS}', 'i')
    and not regexp_matches(text, '{_PLACE}', 'i') and not regexp_matches(text, '{_META}', 'i'))""", """tight as (
  select card_id, depth from deep_lines where depth > 0 group by all having count(*) between 2 and 6)""", f"""choice as (
  select card_id, 1 as priority, depth::bigint as ord, name from (
    select card_id, depth, coalesce({_company('text')}, text) as name from fit where rn = 1)
  where {_named('name')} and (depth = 0 or (card_id, depth) in (from tight))
  union all select card_id, 2, case when in_block then 0 else 4294967296 end + link_no,
    coalesce({_company('link_text')}, case when {_named(_SLUG_NAME)} then {_SLUG_NAME} end) from detail_links
  union all select card_id, 2, 4294967295, {_company('text')} from detail_blocks
  union all select card_id, place, ord, {_company('text')} from (
    select card_id, place, ord, case when place = 5 then string_split(text, chr(10))[1] else text end as text from place_texts)
  union all select card_id, 6, link_no, text from (
    select card_id, link_no, {_listing_text('link_text')} as text from half_links where {_SLUG} is not null)
  where {_named('text')}
  union all select card_id, 7, link_no, name from (
    select card_id, link_no, {_SLUG_NAME} as name from half_links where {_SLUG} is not null)
  where {_named('name')})"""], """
select card_id, name as company_name, priority from (
  select *, row_number() over (partition by card_id order by priority, ord, name) as rn from choice where name is not null)
where rn = 1"""),
    "distinct_cards": _sql(["listing_lines", "listing_links"], [], f"""
select card_id, arg_min(ord, (source_no, ord)) as ord, min(source_no) as source_no from (
  select card_id, link_no as ord, 0 as source_no from listing_links where {_SLUG} is not null
  union all select card_id, line_no, 1 from listing_lines where card_id % 3 > 0
  union all select card_id, line_no, 2 from listing_lines)
group by card_id"""),
    "listing_annotate": _sql(
        ["lca_raw", "curated_raw", "listing_lines", "listing_links"],
        [*_ALIAS_CTES, _EMPLOYERS, _ONE_ALIAS, _COMPANIES,
         f"names as (select distinct {_emp('company_name')} as name from companies)", _ANNOTATED],
        "select * from annotated"),
    "listing_stats": _sql(
        ["lca_raw", "curated_raw", "listing_lines", "listing_links"],
        [*_ALIAS_CTES, _EMPLOYERS, _ONE_ALIAS, _COMPANIES,
         f"names as (select distinct {_emp('company_name')} as name from companies)", _ANNOTATED],
        """select card_id % 50 as session_id, count(*) as jobs_scanned, count(employer_name) as sponsors_found
from annotated group by 1"""),
    "rate_limit": _sql(["request_log"], ["""log as (
  select *, coalesce(trim(string_split(nullif(x_forwarded_for, ''), ',')[1]), host, 'unknown') as client from request_log),
p1 as (select *, row_number() over (partition by client, time_bucket(interval 1 hour, ts) order by ts, event_id) as n1 from log),
p2 as (select *, row_number() over (partition by client, time_bucket(interval 1 day, ts), n1 <= 2 order by ts, event_id) as n2 from p1)"""], """
select event_id, client, endpoint, (case when n1 > 2 then 1 when n2 > 5 then 2 end)::integer as refused_by from p2"""),
    "burst_sessions": """
select user_id, count(*) as events, min(t) as burst_start, max(t) as burst_end, max(t) + 14400000000 as fires_at
from (
  select *, sum(fresh) over (partition by user_id order by t, event_id) as burst from (
    select user_id, event_id, epoch_us(ts) as t,
      case when epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id) < 14400000000 then 0 else 1 end as fresh
    from events))
group by user_id, burst""",
    "attempt_abandon": """
select user_id, count(*) as attempts, count(*) filter (failed) as failures,
  count(up) > 0 as abandoned, arg_min(event_id, (ts, event_id)) filter (up is not null) as abandoned_event_id
from (
  select *, case when failed and count(*) filter (failed) over (partition by user_id order by ts, event_id rows between 2 preceding and current row) = 3 then 1 end as up
  from (select *, event_type = 'error' as failed from events))
group by user_id""",
    "miss_report": """
select user_id as card_id, event_id, 'https://jobs.example/list/' || (user_id % 7) as url, substr(repeat(props, 40), 1, 300) as html
from events where event_type = 'error'
qualify row_number() over (partition by user_id order by ts, event_id) = 1""",
    "misses_per_url": """
select 'https://jobs.example/list/' || (user_id % 7) as url, count(distinct user_id) as misses
from events where event_type = 'error' group by 1""",
    "stream_resolve": _sql(
        ["lca_raw", "curated_raw"],
        [*_ALIAS_CTES, _EMPLOYERS, _ONE_ALIAS,
         "lookup as (select s_suppkey as card_id, s_name as company_name from supplier)",
         f"names as (select distinct {_emp('company_name')} as name from lookup)",
         _ANNOTATED.replace("from companies", "from lookup")],
        f"""select card_id as name_id, {_emp('company_name')} as normalized_name,
  coalesce(match_type, 'miss') as match_type, employer_name, h1b_count as total_h1b_certified from annotated"""),
    "stream_dedup": "select distinct user_id, event_type from events",
    "stream_intake": _sql(["lca_raw"], [_CASES], "select * from cases"),
}
ORACLES["stream_abandon"] = f"""
select user_id, abandoned_event_id from ({ORACLES["attempt_abandon"]}) where abandoned"""

_HOUR = "epoch_us(time_bucket(interval 1 hour, ts))"
ORACLES["stream_limits"] = f"""
select client, limit_no, window_start, count(*) as requests, count(*) > any_value(allowed) as exceeded
from (select user_id % 10 as client, 1::integer as limit_no, {_HOUR} as window_start, 2 as allowed from events
      union all select user_id % 10, 2, epoch_us(time_bucket(interval 1 day, ts)), 5 from events)
group by 1, 2, 3"""
ORACLES["stream_stats"] = f"""
select user_id % 5 as session_id, {_HOUR} as window_start, count(*) as jobs_scanned,
  count(*) filter (event_type = 'purchase') as sponsors_found
from events group by 1, 2"""
ORACLES["stream_misses"] = f"""
select 'https://jobs.example/list/' || (user_id % 7) as url, {_HOUR} as window_start, count(*) as misses
from events where event_type = 'error' group by 1, 2"""
ORACLES["stream_bursts"] = f"""
select user_id, burst_start, fires_at, events from ({ORACLES["burst_sessions"]})"""
ORACLES["resolve_again"] = ORACLES["resolve_all"]
ORACLES["stream_logged"] = "select event_id, substr(repeat(props, 60), 1, 500) as html from events where event_type = 'error'"

# The order of the sorted outputs, as the place of every row.
for _name, _source, _keys, _order in (
    ("employers_placed", "employers_agg", "employer_name", "total_h1b_certified desc, employer_name"),
    ("job_levels_placed", "job_levels", "employer_name, normalized_job_title, soc_code",
     "employer_name, total_count desc, normalized_job_title nulls first, soc_code nulls first"),
    ("aliases_placed", "aliases_agg", "primary_employer_name, alias_name", "usage_count desc, alias_name, primary_employer_name"),
    ("merged_aliases_placed", "aliases_merged", "primary_employer_name, alias_name",
     "usage_count desc, alias_name, primary_employer_name"),
):
    ORACLES[_name] = f"select {_keys}, row_number() over (order by {_order}) as place from ({ORACLES[_source]})"

_OLD_COUNTS = """select upper(trim(employer_name)) as employer_name, count(*) as h1b_count
  from lca_raw where case_status = 'Certified' and employer_name <> ''"""
ORACLES["folder_counts"] = _sql(["lca_raw"], [], f"{_OLD_COUNTS} and file_priority < 4 group by 1")
ORACLES["counts_upsert"] = _sql(["lca_raw"], [f"counts as ({_OLD_COUNTS} group by 1)"], """
select employer_name, (case when h1b_count % 2 = 0 then h1b_count * 10 else h1b_count end)::bigint as h1b_count,
  case when h1b_count % 2 = 0 then '2025-06-01' else '2025-01-01' end as last_updated from counts""")
ORACLES["curated_from_file"] = _sql(["curated_raw"], [_curated("fresh", "true")], "select * from fresh")
ORACLES["pending_first"] = _sql(["employer_vectors"], [], """
select id, employer_name from employer_vectors where embedding is null order by id limit 25""")

ORACLES["employer_deltas"] = ORACLES["employer_upsert"]
ORACLES["summary_from_states"] = _sql(["lca_raw"], [f"""kept as (
  select * from lca_raw where trim(case_status) = 'Certified' and trim(visa_class) = 'H-1B'
    and not {_gone('case_number')} and {_emp('employer_name')} is not null)"""], f"""
select (select count(*) from lca_raw) as rows_scanned, count(distinct trim(case_number)) as cases,
  count(distinct {_emp('employer_name')}) as employers, count(distinct {_title('job_title')}) as job_titles, true as close
from kept""")
