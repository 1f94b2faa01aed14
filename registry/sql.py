"""The derived tables of `registry.tables` again, as DuckDB common table expressions."""

SENIORITY = """CASE
  WHEN regexp_matches(lower({t}), 'chief|cto|ceo|cfo|coo|c-suite|vp |vice president') THEN 'executive'
  WHEN regexp_matches(lower({t}), 'director|head of|head,|principal') THEN 'director'
  WHEN regexp_matches(lower({t}), 'senior|sr\\.|sr |lead|staff|manager') THEN 'senior'
  WHEN regexp_matches(lower({t}), 'junior|jr\\.|jr |entry|associate|intern|graduate') THEN 'junior'
  ELSE 'mid' END"""

WORK_MODE = """CASE
  WHEN contains(lower({l}), 'remote') AND (contains(lower({l}), 'hybrid') OR contains(lower({l}), 'onsite') OR contains(lower({l}), 'office')) THEN 'hybrid'
  WHEN contains(lower({l}), 'remote') THEN 'remote'
  WHEN contains(lower({l}), 'hybrid') THEN 'hybrid'
  ELSE 'onsite' END"""

PRIORITY = """CASE
  WHEN {s} IN ('greenhouse','lever','workable','ashby') THEN 1
  WHEN {s} IN ('remotive','remoteok','jobicy','himalayas','themuse') THEN 2
  WHEN {s} = 'rss' THEN 3 ELSE 99 END"""

FULL_TEXT = "lower(title || ' ' || description_text || ' ' || company || ' ' || array_to_string(departments, ' ') || ' ' || array_to_string(tags, ' '))"


def seniority(t: str) -> str:
    return SENIORITY.format(t=t)


def work_mode(loc: str) -> str:
    return WORK_MODE.format(l=loc)


def priority(s: str = "source") -> str:
    return PRIORITY.format(s=s)


def company_fold(name: str) -> str:
    """Company name as a match key."""
    out = f"lower(trim({name}))"
    for suffix in ["inc", "inc\\.", "llc", "ltd", "ltd\\.", "gmbh", "pty", "co\\.", "corp", "corporation", "limited"]:
        out = f"regexp_replace({out}, ' {suffix}$', '')"
    return f"trim(regexp_replace({out}, '[^a-z0-9\\s]', '', 'g'))"


PART_LISTINGS = f"""
part_base AS (
  SELECT p_partkey AS pos, p_name, p_type, p_brand,
    ['greenhouse','lever','workable','ashby','remotive','remoteok','jobicy','himalayas','themuse','rss'][p_partkey % 10 + 1] AS source,
    p_partkey::VARCHAR AS source_id,
    ['Director of ','Head of ','Senior ','VP ','Junior ','Coordinator ','','International '][p_size % 8 + 1] || p_name AS title,
    p_brand || ['',' Inc',' LLC',' Ltd.'][p_size % 4 + 1] AS company,
    ['Remote','Hybrid - Berlin','Remote / office','NYC',''][p_size % 5 + 1] AS location,
    CASE WHEN p_partkey % 3 <> 0 THEN p_retailprice END AS salary_min,
    CASE WHEN p_partkey % 11 <> 0 THEN (DATE '2024-01-01' + CAST(p_partkey % 120 AS INTEGER))::DATE END AS posted_date
  FROM part),
listings AS (
  SELECT *, substring(md5(source || ':' || source_id), 1, 12) AS id,
    contains(lower(location), 'remote') AS remote,
    {work_mode('location')} AS work_mode,
    {seniority('title')} AS seniority,
    CASE WHEN pos % 6 = 0 THEN 'Full-time' ELSE '' END AS employment_type,
    CASE WHEN pos % 4 <> 0 THEN salary_min + 500 END AS salary_max,
    CASE WHEN salary_min IS NOT NULL THEN ['USD','EUR','AUD'][pos % 4 + 1] END AS salary_currency,
    coalesce(strftime(posted_date, '%Y-%m-%d'), '') AS posted_date_raw,
    'Work on ' || p_type || ' line ' || p_name || ' for ' || p_brand AS description_text,
    CASE source WHEN 'greenhouse' THEN 'https://boards.greenhouse.io/' WHEN 'ashby' THEN 'https://jobs.ashbyhq.com/' ELSE 'https://example.com/' END
      || lower(regexp_replace(company, '[^A-Za-z0-9]', '', 'g')) || '/jobs/' || source_id AS url,
    [p_type] AS departments, string_split(p_name, ' ') AS tags,
    CASE WHEN source IN ('greenhouse','lever','workable','ashby') THEN 'GUARANTEED' WHEN source = 'rss' THEN 'UNVERIFIED' ELSE 'API_ACTIVE' END AS verification_status,
    {priority()} AS priority
  FROM part_base)"""

DOCUMENT_LISTINGS = f"""
doc_base AS (
  SELECT d.doc_id AS pos, CASE quality WHEN 1 THEN 'greenhouse' WHEN 0 THEN 'remotive' ELSE 'rss' END AS source,
    array_to_string(regexp_split_to_array(text, '\\s+')[1:8], ' ') AS title, d.source AS company, '' AS location,
    text AS description_text, []::VARCHAR[] AS departments, [lang] AS tags
  FROM documents d LEFT JOIN labels USING (doc_id)),
doc_listings AS (
  SELECT *, substring(md5(source || ':' || pos::VARCHAR), 1, 12) AS id, {seniority('title')} AS seniority FROM doc_base)"""

PAGES = """
fetched AS (
  SELECT page_id, url, [200,200,404,200,403,200,301,410,500,200,0,200,302][page_id % 13 + 1] AS http_code,
    CASE page_id % 7 WHEN 0 THEN 'https://x.example.com/us/careers/' WHEN 1 THEN 'https://x.example.com/jobs' WHEN 2 THEN 'https://x.example.com/positions/' ELSE url END AS final_url,
    CASE WHEN page_id % 17 = 0 THEN '' ELSE html || ['','<p>This POSITION has been Filled</p>','','','<p>Job not found.</p>'][page_id % 5 + 1] END AS body
  FROM pages)"""

PHRASES = """
phrases AS (SELECT unnest([
  'no longer available', 'no longer accepting', 'position has been filled', 'position filled', 'this job has been closed',
  'this job is closed', 'this role has been filled', 'this posting has expired', 'this listing has expired', 'applications are closed',
  'applications are no longer being accepted', 'this job has expired', 'this opportunity is closed', 'this position is no longer available',
  'job not found', 'the position you are looking for is no longer', 'this role is no longer open']) AS phrase, generate_subscripts([
  1,2,3,4,5,6,7,8,9,10,11,12,13,14,15,16,17], 1) AS n)"""

PART_PAGES = """
part_pages AS (
  SELECT url, [200,200,404,403,200,500,200][pos % 7 + 1] AS http_code, url AS final_url,
    CASE WHEN pos % 8 = 3 THEN 'this job is closed' ELSE 'open: ' || title END AS body
  FROM listings WHERE pos % 10 <> 4)"""

EVENTS = """
event_listings AS (
  SELECT event_id AS pos, substring(md5('rss:' || event_id::VARCHAR), 1, 12) AS id, event_type AS source,
    CASE WHEN event_id % 9 <> 0 THEN ts::DATE END AS posted_date, ts AS seen_at, props AS payload
  FROM events)"""

PROFILES = """
profiles AS (
  SELECT r_name AS profile_id,
    [adj[r_regionkey + 1], noun[r_regionkey + 1], noun[r_regionkey + 3]] AS skills,
    [['senior','director'],['junior','mid'],['executive'],['mid','senior'],['director','executive','senior']][r_regionkey % 5 + 1] AS seniority_targets,
    [sec[r_regionkey + 1], sec[r_regionkey + 2]] AS sectors,
    [adj[r_regionkey + 1], noun[r_regionkey + 1]] AS keywords,
    [noun[r_regionkey + 4]] AS exclude_keywords,
    [['remote'],['remote','hybrid'],['onsite'],['hybrid'],['remote','hybrid','onsite']][r_regionkey % 5 + 1] AS work_modes,
    ['brand#' || (r_regionkey + 1)::VARCHAR, adj[r_regionkey + 4]] AS value_terms,
    [sec[r_regionkey + 3]] AS dealbreaker_terms
  FROM region, (SELECT ['small','red','blue','hot','old','large','new','cold'] AS adj, ['ring','widget','bolt','gear','gizmo','plate','anvil','rod'] AS noun,
    ['economy','small','standard','medium','promo','large'] AS sec))"""

COMPANIES = """
companies AS (
  SELECT s_name AS name, ['greenhouse','lever','workable','ashby'][s_suppkey % 4 + 1] AS ats, lower(replace(s_name, '#', '')) AS slug,
    sec[s_suppkey % 6 + 1] AS s1, sec[s_nationkey % 6 + 1] AS s2, 'nation ' || s_nationkey::VARCHAR AS notes
  FROM supplier, (SELECT ['economy','small','standard','medium','promo','large'] AS sec))"""

SECTOR_KEYWORDS = """
sector_keywords AS (
  SELECT DISTINCT lower(p_type) AS sector, 'title' AS kind, unnest(string_split(p_name, ' ')) AS keyword FROM part WHERE p_type <> 'PROMO'
  UNION SELECT DISTINCT lower(p_type), 'description', lower(p_brand) FROM part WHERE p_type <> 'PROMO')"""


def with_tables(*parts: str) -> str:
    return "WITH " + ",".join(parts) + "\n"
