"""Listing-shaped views over the given tables, in SQL that Spark and DuckDB both accept.

Every view keeps all rows of its base table (grouping where a view is an aggregate), so its
work grows with the data. Tables and other views are named in braces.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from listings_spark.sources.session import spread

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

# Tables whose rows go through the costly text rules.
TEXT_TABLES = ("orders", "documents", "pages", "conversations")

VIEWS: dict[str, str] = {}

# Order dates are moved by exactly 28 years so that the fixed policy date falls among them.
VIEWS["listing_raw"] = """
SELECT
  CAST(o.o_orderkey AS STRING) AS listing_id,
  c.c_name AS company,
  CASE o.o_orderkey % 12
    WHEN 0 THEN 'Software Engineering Intern'
    WHEN 1 THEN '– Machine Learning Internship'
    WHEN 2 THEN 'Graduate Software Developer'
    WHEN 3 THEN 'Senior Software Engineer Intern'
    WHEN 4 THEN 'R&amp;D Co-op Technology'
    WHEN 5 THEN 'New Grad Data Engineer'
    WHEN 6 THEN 'Marketing Intern'
    WHEN 7 THEN 'Développeur Front-end – Cybersécurité Internship'
    WHEN 8 THEN 'Internship'
    WHEN 9 THEN 'Early Career Cloud &amp; DevOps Engineer'
    WHEN 10 THEN 'Product Manager'
    ELSE 'Summer 2027 Data Science Placement Student Intern'
  END
  || CASE o.o_orderkey % 7
    WHEN 0 THEN ' 2027'
    WHEN 1 THEN ' 2026'
    WHEN 2 THEN ' (Class of 2028)'
    WHEN 3 THEN ' – September 2027'
    WHEN 4 THEN ' 2025/2027'
    ELSE ''
  END
  || CASE WHEN o.o_orderkey % 11 = 0 THEN ' - Apply Now' ELSE '' END AS title,
  CASE o.o_orderkey % 10
    WHEN 0 THEN '<p>Join our <b>Summer 2027</b> software engineering internship.</p>'
    WHEN 1 THEN 'You must graduate in 2028. Our internship cycle 2027 is open.'
    WHEN 2 THEN 'Computer science &amp; robotics team. Programme year: 2026, then 2027.'
    WHEN 3 THEN '<div>Class of 2026 welcome</div><script>var y = 2025;</script><p>Graduate scheme</p>'
    WHEN 4 THEN 'Founded in 2021. We build machine learning systems starting in January 2028.'
    WHEN 5 THEN 'The September 2027 intake is for new grad hires. Graduation date by 2027.'
    WHEN 6 THEN 'Information technology support'
    WHEN 7 THEN 'Graduating in 2029 is fine; early career 2027.'
    WHEN 8 THEN 'The internship offers a long list of many benefits and it ends by 2024'
    ELSE NULL
  END AS description,
  CASE o.o_orderkey % 15
    WHEN 0 THEN 'London, UK'
    WHEN 1 THEN 'Paris, TX'
    WHEN 2 THEN 'London, Ontario, Canada'
    WHEN 3 THEN 'EMEA'
    WHEN 4 THEN 'Madrid, Spain;Lisbon, Portugal'
    WHEN 5 THEN 'Zürich, Switzerland'
    WHEN 6 THEN 'UK Remote'
    WHEN 7 THEN 'Remote, Europe'
    WHEN 8 THEN 'Berlin'
    WHEN 9 THEN 'Tbilisi, Georgia;Dublin, IE'
    WHEN 10 THEN ' Paris;Paris , France;Paris'
    WHEN 11 THEN 'Bengaluru, India'
    WHEN 12 THEN 'Kraków, PL'
    WHEN 13 THEN 'U.K.'
    ELSE 'Somewhere, nowhere,'
  END AS place,
  CASE WHEN o.o_orderkey % 4 = 0 THEN NULL ELSE o.o_orderpriority END AS industries,
  CASE WHEN o.o_orderkey % 9 = 0 THEN NULL
    ELSE o.o_orderdate + INTERVAL '1' DAY * (10227 - o.o_orderkey % 400) END AS posted_at,
  o.o_orderdate + INTERVAL '1' DAY * 10227 AS observed_at,
  CASE o.o_orderkey % 8
    WHEN 0 THEN '3 weeks ago'
    WHEN 1 THEN '30+ days ago'
    WHEN 2 THEN 'Today'
    WHEN 3 THEN 'Reposted 2 months ago'
    WHEN 4 THEN '1 year ago'
    WHEN 5 THEN 'just now'
    WHEN 6 THEN CAST(o.o_orderkey % 50 AS STRING) || ' Hours  ago'
    ELSE 'soon'
  END AS age_text,
  CASE o.o_orderkey % 5
    WHEN 0 THEN 'any' WHEN 1 THEN 'day' WHEN 2 THEN 'week' WHEN 3 THEN 'month' ELSE 'cycle'
  END AS date_posted,
  CASE WHEN o.o_orderkey % 13 = 0 THEN 'http' ELSE 'https' END
  || CASE WHEN o.o_orderkey % 3 = 0 THEN '://WWW.LinkedIn.com:443/jobs/view/'
       ELSE '://www.linkedin.com/jobs/view/' END
  || CAST(CASE WHEN o.o_orderkey % 17 = 0 THEN o.o_orderkey + 1 ELSE o.o_orderkey END AS STRING)
  || CASE o.o_orderkey % 6
    WHEN 0 THEN '/' WHEN 1 THEN '?trackingId=x&utm_source=feed' WHEN 2 THEN '#top'
    WHEN 3 THEN '?lang=en' ELSE '' END AS link,
  CASE WHEN o.o_orderkey % 19 = 0 THEN 'urn:li:company:' ELSE 'urn:li:jobPosting:' END
  || CAST(o.o_orderkey AS STRING)
  || CASE WHEN o.o_orderkey % 23 = 0 THEN 'x' ELSE '' END AS urn
FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey
"""

# Stored listings: one row per order, already in lifecycle form.
VIEWS["stored"] = """
SELECT
  listing_id, company,
  CASE WHEN o_key % 3 = 0 THEN lower(title) ELSE title END AS title,
  trim(CASE WHEN place LIKE '%;%' THEN replace(place, ';', '; ') ELSE place END) AS location,
  'https://www.linkedin.com/jobs/view/' || listing_id AS link,
  CASE o_key % 5 WHEN 0 THEN 'software-engineering' WHEN 1 THEN 'data-science'
    WHEN 2 THEN 'machine-learning' WHEN 3 THEN 'other-tech' ELSE 'cybersecurity' END AS category,
  industries,
  CASE WHEN o_key % 3 = 1 THEN 'new-grad' ELSE 'internship' END AS employment_type,
  CASE WHEN o_key % 6 = 0 THEN 'Summer 2027' ELSE NULL END AS start_date,
  observed_at AS first_seen_at,
  observed_at + INTERVAL '1' HOUR * (o_key % 72) AS last_seen_at,
  observed_at + INTERVAL '1' HOUR * (o_key % 48) AS updated_at,
  CASE WHEN o_key % 4 = 3 THEN 'closed' ELSE 'open' END AS status
FROM (SELECT *, CAST(listing_id AS BIGINT) AS o_key FROM {listing_raw}) r
"""

# One commit per hour and search, one audit commit per hour after the searches.
VIEWS["commits"] = """
SELECT
  event_id, ts, event_type, value, user_id, props,
  ((year(ts) * 12 + month(ts)) * 744 + (day(ts) - 1) * 24 + hour(ts)) * 5
    + CASE WHEN event_type = 'signup' THEN 4 ELSE event_id % 4 END AS run_seq,
  CASE WHEN event_type = 'signup' THEN NULL
    ELSE 's' || CAST(event_id % 4 AS STRING) END AS search_slug,
  CAST(user_id AS STRING) AS listing_id,
  CASE WHEN event_type IN ('error', 'click') THEN 'unavailable'
    WHEN event_type <> 'signup' THEN 'observed'
    WHEN event_id % 29 = 0 THEN 'audit_unavailable'
    WHEN event_id % 5 = 1 THEN 'audit_available'
    ELSE 'audit_inconclusive' END AS kind
FROM {events}
"""

VIEWS["log_raw"] = """
SELECT
  run_seq, event_id AS pos, search_slug, listing_id, kind,
  CASE WHEN kind = 'observed' THEN 'run-' || CAST(run_seq AS STRING) ELSE NULL END AS run_id,
  CASE WHEN run_seq % 7 = 0 THEN ts - INTERVAL '2' DAY ELSE ts END AS observed_at,
  CASE WHEN event_id % 6 = 0 THEN NULL
    ELSE ts - INTERVAL '1' DAY * (event_id % 10) END AS posted_at,
  'Company ' || CAST(user_id % 7 AS STRING) AS company,
  'Software Intern ' || CAST(event_id % 3 AS STRING) AS title,
  CASE WHEN event_id % 20 = 0 THEN 'Paris, France' ELSE 'Berlin, Germany' END AS location,
  'https://www.linkedin.com/jobs/view/' || listing_id AS link,
  CASE WHEN event_id % 9 = 0 THEN 'data-science' ELSE 'software-engineering' END AS category,
  CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'Software' END AS industries,
  CASE WHEN event_id % 2 = 0 THEN 'internship' ELSE 'new-grad' END AS employment_type,
  CASE WHEN event_id % 5 = 0 THEN 'Summer 2027' ELSE NULL END AS start_date
FROM {commits}
"""

VIEWS["runs"] = """
SELECT
  'run-' || CAST(run_seq AS STRING) AS id, run_seq, search_slug,
  CASE WHEN run_seq % 6 = 5 THEN 'failed' ELSE 'success' END AS status,
  min(ts) AS started_at, max(ts) AS finished_at,
  CAST(count(*) * 10 AS INT) AS duration_ms,
  CAST(count(*) AS INT) AS found_count,
  CAST(sum(CASE WHEN kind = 'observed' THEN 1 ELSE 0 END) AS INT) AS accepted_count,
  CAST(sum(CASE WHEN kind = 'unavailable' THEN 1 ELSE 0 END) AS INT) AS excluded_count,
  CAST(sum(CASE WHEN value > 10 THEN 1 ELSE 0 END) AS INT) AS warning_count,
  'http_' || repeat(max(event_type), 20) AS error_code,
  repeat('could not read page; ', CAST(20 + run_seq % 20 AS INT)) AS error_message
FROM {commits}
WHERE search_slug IS NOT NULL
GROUP BY run_seq, search_slug
"""

VIEWS["cards"] = """
SELECT
  's' || CAST(l_suppkey % 20 AS STRING) AS search_slug,
  l_linenumber AS page,
  (l_orderkey * 10 + l_linenumber) * 1000000000 + l_partkey AS pos,
  CAST(l_partkey % CASE WHEN l_suppkey % 20 % 4 = 0 THEN 10 ELSE 1000000000 END AS STRING)
    AS listing_id,
  CASE WHEN l_orderkey % 3 = 0 THEN 'Senior Product Manager'
    WHEN l_orderkey % 3 = 1 THEN 'Software Intern' ELSE 'Entry-level Analyst' END AS title,
  'Supplier#' || CAST(l_suppkey AS STRING) AS company,
  l_orderkey, l_quantity, l_shipdate
FROM {lineitem}
"""

VIEWS["registry"] = """
SELECT
  's' || CAST(s_suppkey AS STRING) AS slug,
  'Search of ' || s_name AS name,
  CASE WHEN s_suppkey % 2 = 0 THEN 'Software Intern' ELSE 'DATA  new grad' END AS keywords,
  n_name AS location,
  CASE s_suppkey % 3 WHEN 0 THEN 'roles' WHEN 1 THEN 'companies' ELSE 'countries' END AS grp,
  CASE WHEN s_suppkey % 5 = 0 THEN 'any' ELSE 'cycle' END AS date_posted,
  CASE WHEN s_suppkey % 7 = 0 THEN 'remote' ELSE 'any' END AS workplace,
  CAST(1 + s_suppkey % 4 AS INT) AS max_pages,
  CAST(25 * (1 + s_suppkey % 4) - s_suppkey % 10 AS INT) AS max_results,
  CAST(s_suppkey % 16 AS INT) AS max_rechecks,
  s_suppkey % 6 <> 0 AS enabled,
  s_suppkey
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey
"""

# Search definitions with faults spread over them.
VIEWS["registry_faulty"] = """
SELECT
  CASE WHEN s_suppkey % 11 = 0 THEN slug || '_X' ELSE slug END AS slug,
  CASE WHEN s_suppkey % 13 = 0 THEN 'Example  search' ELSE name END AS name,
  CASE WHEN s_suppkey % 17 = 0 THEN 'x' ELSE keywords END AS keywords, location,
  CASE WHEN s_suppkey % 5 = 1 THEN 'year' ELSE date_posted END AS date_posted,
  CASE WHEN s_suppkey % 7 = 1 THEN 'moon' ELSE workplace END AS workplace,
  CAST(max_pages + s_suppkey % 9 AS INT) AS max_pages,
  CAST(max_results + 60 * (s_suppkey % 5) AS INT) AS max_results,
  CAST(max_rechecks + 60 * (s_suppkey % 6) AS INT) AS max_rechecks
FROM {registry}
"""

# The state before a sync: a third of the searches is new, the rest has older settings.
VIEWS["registry_state"] = """
SELECT
  CASE WHEN s_suppkey % 5 = 4 THEN slug || '-old' ELSE slug END AS slug,
  name, keywords || ' old' AS keywords, location, s_suppkey % 4 <> 0 AS enabled,
  'old-hash' AS config_hash, TIMESTAMP '2026-01-01 00:00:00' AS updated_at
FROM {registry} WHERE s_suppkey % 3 <> 0
"""

VIEWS["rules_raw"] = """
SELECT 'category' AS kind, p_type AS category, p_partkey AS position,
  CASE p_partkey % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN replace(p_name, ' ', '-')
    WHEN 2 THEN p_name || ' &amp; ' || p_brand ELSE p_name END AS phrase
FROM {part}
"""


# Phrases that do occur in the documents: the first one to eight words of the benchmark passages.
_WORDS = "".join(
    f" || CASE WHEN item_id % 8 >= {n} THEN '{'-' if n == 1 else ' '}' || split_part(text, ' ', {n + 1})"
    " ELSE '' END"
    for n in range(1, 8)
)
VIEWS["rules_text"] = f"""
SELECT 'category' AS kind, 'group ' || CAST(item_id % 7 AS STRING) AS category,
  item_id AS position, split_part(text, ' ', 1){_WORDS} AS phrase
FROM {{benchmark}}
"""


def _references(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{([a-z]\w*)\}", sql)))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table or a derived view as a DataFrame."""
    if name not in VIEWS:
        table = spark.read.parquet(str(Path(sf_dir) / f"{name}.parquet"))
        return spread(table) if name in TEXT_TABLES else table
    sql = VIEWS[name]
    return spark.sql(sql, **{ref: read(spark, sf_dir, ref) for ref in _references(sql)})


def with_views(body: str) -> str:
    """One DuckDB statement: the views a query needs as CTEs, then the query."""
    needed: dict[str, str] = {}

    def need(sql: str) -> str:
        for ref in _references(sql):
            if ref in VIEWS and ref not in needed:
                needed[ref] = need(VIEWS[ref])
        return re.sub(r"\{([a-z]\w*)\}", r"\1", sql)

    main = need(body).strip()
    ctes = [f"{name} AS ({sql.strip()})" for name, sql in needed.items()]
    if not ctes:
        return main
    if main.upper().startswith("WITH "):
        main = main[5:]
        return "WITH " + ",\n".join(ctes) + ",\n" + main
    return "WITH " + ",\n".join(ctes) + "\n" + main
