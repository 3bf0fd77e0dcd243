"""Views that give the supplied tables the shapes of the real inputs.

Each text is plain SQL that reads the same in Spark and in DuckDB, so a query and the
SQL it is checked against start from exactly the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

VIEWS: dict[str, str] = {
    "lca_raw": """
select concat('I-', cast(l_orderkey as varchar(20)), '-', cast(l_linenumber as varchar(20))) as case_number,
  case l_returnflag when 'A' then case when l_partkey % 2 = 0 then 'Certified' else ' Certified ' end when 'N' then 'Denied' else 'Certified - Withdrawn' end as case_status,
  case l_linestatus when 'F' then 'H-1B' else 'E-3 Australian' end as visa_class,
  substring(cast(cast(l_shipdate as date) as varchar(20)), 1, 10) as decision_date,
  concat(case l_partkey % 4 when 0 then 'Sr. ' when 1 then '' when 2 then 'jr.  ' else ' ' end, p_name,
         case l_partkey % 5 when 0 then ' (Java)' when 1 then '-SENIOR' when 2 then ' mgr' when 3 then '-SENIOR (Go)' else '' end) as job_title,
  case when l_partkey % 11 = 0 then '' else p_brand end as soc_code,
  case when l_partkey % 97 = 0 then 'n/a' else concat(lower(s_name), case l_suppkey % 4 when 0 then '  Inc.' when 1 then ' LLC.' when 2 then ' Co.Ltd.' else '' end) end as employer_name,
  case when l_partkey % 3 = 0 then concat('DBA ', n_name) when l_partkey % 3 = 1 then 'N/A' else s_name end as trade_name_dba,
  case p_size % 6 when 0 then 'I' when 1 then 'II' when 2 then ' iii ' when 3 then 'IV' when 4 then 'N/A' else 'V' end as pw_wage_level,
  case when l_suppkey % 10 = 9 then 'unknown' when cast(l_quantity as int) % 5 = 4 then '' when (cast(l_quantity as int) % 5 = 0) = (l_suppkey % 2 = 0) then 'n' else ' Y ' end as h1b_dependent,
  1 + month(l_shipdate) % 4 as file_priority, l_partkey as partkey, l_suppkey as suppkey
from lineitem join part on l_partkey = p_partkey
  join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey
""",
    "date_texts": """
select o_orderkey as id, case o_orderkey % 6
  when 0 then cast(cast(o_orderdate as date) as varchar(20))
  when 1 then concat(cast(month(o_orderdate) as varchar(4)), '/', cast(day(o_orderdate) as varchar(4)), '/', cast(year(o_orderdate) as varchar(4)))
  when 2 then concat(cast(month(o_orderdate) as varchar(4)), '-', cast(day(o_orderdate) as varchar(4)), '-', cast(year(o_orderdate) as varchar(4)))
  when 3 then concat(cast(year(o_orderdate) as varchar(4)), '/', cast(month(o_orderdate) as varchar(4)), '/', cast(day(o_orderdate) as varchar(4)))
  when 4 then concat('FY', cast(year(o_orderdate) as varchar(4)))
  else '#N/A' end as txt
from orders
""",
    "curated_raw": """
select n_nationkey as line_no,
  case when n_nationkey % 7 = 6 then '' else concat('supplier#00000000', cast(n_nationkey % 10 as varchar(4))) end as primary_employer_name,
  concat(' dba  nation_', cast(n_nationkey % 8 as varchar(4))) as alias_name,
  case when n_nationkey % 2 = 0 then 'MANUAL_CURATED' else null end as alias_type,
  case when n_nationkey % 3 = 0 then null else '0' end as usage_count
from nation
""",
    "loaded_text": """
select case when c_custkey % 13 = 0 then ' ' else c_name end as employer_name,
  case c_custkey % 4 when 0 then cast(c_custkey as varchar(20)) when 1 then '' when 2 then '5.0' else ' 7 ' end as total_text,
  case c_custkey % 3 when 0 then cast(c_acctbal as varchar(30)) when 1 then 'abc' else '' end as pct_text,
  case c_custkey % 7 when 0 then 'True' when 1 then 'no' when 2 then '1' when 3 then 't' when 4 then 'FALSE' when 5 then 'YES' else '' end as flag_text,
  case c_custkey % 3 when 0 then ' 2025-01-31 ' when 1 then '' else '2024-12-01' end as date_text
from customer
""",
    "lookup_names": """
select s_suppkey * 10 as name_id, concat('  ', s_name, case s_suppkey % 4 when 0 then '   inc.' when 1 then ' llc' when 2 then ' Co.Ltd.' else '' end) as raw_name from supplier
union all select n_nationkey * 10 + 1, concat('dba ', n_name) from nation
union all select s_suppkey * 10 + 2, substring(s_name, 1, 17) from supplier
union all select c_custkey * 10 + 3, c_name from customer
union all select r_regionkey * 10 + 4, case r_regionkey when 0 then '' when 1 then '  ' when 2 then 'N/A' when 3 then 'null' else '#n/a' end from region
union all select r_regionkey * 10 + 5, concat('supplier#0000000_', cast(r_regionkey as varchar(4))) from region
""",
    "name_vectors": """
select 'employer' as side, concat(lower(s_name), case s_suppkey % 4 when 0 then '  Inc.' when 1 then ' LLC.' when 2 then ' Co.Ltd.' else '' end) as raw_name, embedding
from supplier join embeddings on s_suppkey = vec_id
union all select 'lookup', c_name, embedding from customer join embeddings on c_custkey = vec_id
""",
    "employer_vectors": """
select vec_id as id, concat('EMPLOYER ', cast(vec_id as varchar(20))) as employer_name,
  cast((vec_id * 37) % 1000 as int) as total_h1b_certified,
  case when vec_id % 7 = 0 then null else embedding end as embedding
from embeddings
""",
    "query_vectors": """
select vec_id as query_id, embedding as query_embedding from embeddings where vec_id % 10 = 0 or vec_id % 7 = 0
""",
    "listing_lines": """
select o_orderkey as card_id, 0 as line_no, concat('Principal software engineer for platform ', cast(o_orderkey as varchar(20))) as line_text from orders
union all select o_orderkey, 1, case o_orderkey % 5 when 0 then concat('Supplier#00000000', cast(o_orderkey % 10 as varchar(4)), ' · Remote, CA') when 1 then 'Promoted' when 2 then '1,234 followers' else concat('Supplier#00000000', cast(o_orderkey % 10 as varchar(4))) end from orders
union all select o_orderkey, 2, case o_orderkey % 2 when 0 then 'San Francisco, CA (Hybrid)' else 'New York, NY' end from orders
union all select o_orderkey, 3, '3 days ago' from orders
""",
    "listing_links": """
select o_orderkey as card_id, 0 as link_no,
  case o_orderkey % 4 when 0 then concat('https://www.linkedin.com/company/supplier-', cast(o_custkey as varchar(20)), '/jobs?x=1') when 1 then 'https://www.linkedin.com/company/unavailable' when 2 then 'https://www.linkedin.com/jobs/view/1' else concat('https://www.linkedin.com/company/acme-', cast(o_custkey as varchar(20))) end as href,
  case o_orderkey % 3 when 0 then '' else concat('Acme  ', cast(o_custkey as varchar(20))) end as link_text
from orders
""",
    "half_links": """
select o_orderkey as card_id, 0 as link_no,
  case when o_orderkey % 2 = 1 then 'https://www.linkedin.com/jobs/view/1' when o_orderkey % 4 = 0 then concat('https://www.linkedin.com/company/supplier-', cast(o_custkey as varchar(20)), '/jobs?x=1') else 'https://www.linkedin.com/jobs/view/2' end as href,
  case o_orderkey % 3 when 0 then '' else concat('Acme  ', cast(o_custkey as varchar(20))) end as link_text
from orders
""",
    # The links of listing_links in markup: quoted in three ways, beside links that are none.
    "card_pages": """
select card_id, concat(
  case card_id % 3 when 0 then '<!-- <a href="/company/hidden">Hidden Works</a> -->' when 1 then '<script>var a = "<a href=/company/scripted>Scripted Works</a>";</script>' else '<img alt="<a href=/company/quoted>Quoted Works</a>">' end,
  '<DIV class=card><A data-x="1>0" ', case card_id % 3 when 0 then concat('href="', href, '"') when 1 then concat('HREF = @', replace(href, '/', '&#x2F;'), '@') else concat('href=', href) end,
  '><b>', replace(link_text, ' ', '&#32;'), '</b><!-- x --><a href="/jobs?a=1&amp;b=2">next</a></div>') as html
from (select o_orderkey as card_id,
  case o_orderkey % 4 when 0 then concat('https://www.linkedin.com/company/supplier-', cast(o_custkey as varchar(20)), '/jobs?x=1') when 1 then 'https://www.linkedin.com/company/unavailable' when 2 then 'https://www.linkedin.com/jobs/view/1' else concat('https://www.linkedin.com/company/acme-', cast(o_custkey as varchar(20))) end as href,
  case o_orderkey % 3 when 0 then '' else concat('Acme  ', cast(o_custkey as varchar(20))) end as link_text
from orders
) as cards
""".replace("@", "\'\'"),
    "deep_lines": """
select o_orderkey as card_id, 0 as depth, 0 as line_no, 'Principal software engineer for a platform' as line_text from orders where o_orderkey % 5 > 0
union all select o_orderkey, 0, 1, concat('Zeta Works ', cast(o_custkey as varchar(20))) from orders where o_orderkey % 5 > 0 and o_orderkey % 3 = 0
union all select o_orderkey, 0, 2, concat(' Zeta  Works ', cast(o_custkey as varchar(20))) from orders where o_orderkey % 5 > 0 and o_orderkey % 3 = 0
union all select o_orderkey, 0, 3, 'Austin, TX' from orders where o_orderkey % 5 > 0
union all select o_orderkey, 1, 0, 'Principal software engineer for a platform' from orders where o_orderkey % 5 > 0 and o_orderkey % 3 > 0
union all select o_orderkey, 1, 1, concat('Beta Labs ', cast(o_custkey as varchar(20)), ' · New York, NY') from orders where o_orderkey % 5 > 0 and o_orderkey % 3 > 0
""" + "".join(f"""union all select o_orderkey, 1, {2 + i}, 'Row {i}' from orders where o_orderkey % 5 > 0 and o_orderkey % 3 = 2
""" for i in range(5)),
    "place_texts": """
select o_orderkey as card_id, case o_orderkey % 7 when 0 then 3 when 1 then 4 when 2 then 5 when 3 then 8 else 9 end as place, 0 as ord,
  case o_orderkey % 5 when 0 then 'Remote, CA' when 1 then 'Promoted' else concat('Place ', cast(o_custkey as varchar(20)), chr(10), 'Boston, MA') end as text
from orders
union all select o_orderkey, 3 + o_orderkey % 3, 1, concat('Second · Place ', cast(o_custkey as varchar(20))) from orders where o_orderkey % 4 > 0
""",
    "detail_links": """
select o_orderkey as card_id, o_orderkey % 3 as link_no, o_orderkey % 2 = 0 as in_block,
  concat('https://www.linkedin.com/company/detail-', cast(o_custkey as varchar(20)), '?x=1') as href,
  case o_orderkey % 3 when 0 then '' when 1 then 'Promoted' else concat('Detail ', cast(o_custkey as varchar(20))) end as link_text
from orders where o_orderkey % 11 = 0
""",
    "detail_blocks": """
select o_orderkey as card_id, concat('Block ', cast(o_custkey as varchar(20)), ' · Austin, TX') as text from orders where o_orderkey % 22 = 11
""",
    "request_log": """
select event_id, ts,
  case when user_id % 9 = 0 then null else concat(' 10.0.0.', cast(user_id as varchar(20)), ', 172.16.0.1') end as x_forwarded_for,
  case when user_id % 18 = 0 then null else concat('192.168.0.', cast(user_id as varchar(20))) end as host,
  case when event_type in ('click', 'view') then 'search' else 'check' end as endpoint
from events
""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of ``VIEWS`` over the parquet tables in ``sf_dir``.

    Tables are passed as arguments of the statement, so nothing is registered in the
    session and two scale factors can be used side by side.
    """
    text = VIEWS[name]
    args = {t: table(spark, sf_dir, t) for t in TABLES if _mentions(text, t)}
    for t in args:
        text = _as_placeholder(text, t)
    return spark.sql(text, **args)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _mentions(text: str, name: str) -> bool:
    return any(f"{w} {name}" in _flat(text) for w in ("from", "join"))


def _as_placeholder(text: str, name: str) -> str:
    flat = _flat(text)
    for word in ("from", "join"):
        flat = flat.replace(f"{word} {name} ", f"{word} {{{name}}} ")
    return flat


def _flat(text: str) -> str:
    return text.replace("\n", " ") + " "
