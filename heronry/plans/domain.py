"""Sources, domain operators and table changes (inventory A, I and J)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronry.functions import enrich as E
from heronry.functions import links as L
from heronry.functions import urls as U
from heronry.functions.text import json_list
from heronry.operators import boards, catalog, graph, matching, merge, search, timeline, visits
from heronry.operators.sequences import pair_runs
from heronry.plans.model import NOW, Model, first_match_sql, has_word_sql, registry, words_sql
from heronry.session import checkpoint_dir, spread
from heronry.sources import boards as B
from heronry.sources import files as S
from heronry.sources import gazetteer as G
from heronry.sources import pages as H

QUERIES, SQL, query = registry()
T0 = 1_705_000_000_000
_HOST = r"nullif(lower(regexp_extract({}, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)', 1)), '')"


# --- A: sources -------------------------------------------------------------------------------------------------------


@query("A2_seeds", "SELECT id, 1 AS line, 'https://' || host || '/' AS url FROM domains")
def _(m: Model) -> DataFrame:
    lists = m.domains.select("id", F.concat("host", F.lit(" # seed\n\nftp://x.example\nnodots")).alias("body"))
    return S.parse_seeds(lists)[0]


def _page_html(m: Model) -> DataFrame:
    """HTML made of the crawled pages' lines, with a footer, links and JSON-LD."""
    e = F.lit("")
    esc = lambda c: F.replace(F.replace(F.coalesce(c, e), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    body = F.replace(esc(F.col("text")), F.lit("\n"), F.lit("</p><p>"))
    ld = F.to_json(F.struct(F.lit("JobPosting").alias("@type"), F.coalesce("title", F.lit("none")).alias("title"), F.struct(F.lit("EUR").alias("currency"), F.struct(F.lit(10).alias("minValue"), (F.col("id") + 10).alias("maxValue"), F.lit("HOUR").alias("unitText")).alias("value")).alias("baseSalary")))
    html = F.concat(
        F.lit("<html><head><title>"), esc(F.col("title")), F.lit("</title><meta name='robots' content='noindex, follow'><script type='application/ld+json'>"), ld, F.lit("</script></head><body><p>"), body,
        F.lit("</p><script>var t = '</p>';</script><a href='/careers?utm_source=x'>Jobs <b>here</b></a><a href='/careers'>again</a><a rel='nofollow' href='https://other.example/a#b'>out</a><a href='#top'>top</a><footer>&copy; Foot "), F.col("id"), F.lit("</footer></body></html>"),
    )
    return m.pages.where("text is not null").select("id", "url", html.alias("html"))


@query("A6_parse_html")
def _(m: Model) -> DataFrame:
    p = H.parse_pages(_page_html(m))
    return p.select("id", "title", "noindex", "nofollow", F.size("links").alias("links"), F.col("footer_text").alias("footer"), F.col("text").alias("body"))


@query("A7_json_ld", "SELECT id, 1 AS blocks FROM parsed_pages WHERE text IS NOT NULL")
def _(m: Model) -> DataFrame:
    return H.parse_pages(_page_html(m)).select("id", F.size("json_ld").alias("blocks"))


@query("A12_job_postings", "SELECT url, coalesce(nullif(trim(title), ''), 'none') AS title, 10.0::DOUBLE AS lo, CAST(id + 10 AS DOUBLE) AS hi, 'hour' AS period FROM parsed_pages WHERE text IS NOT NULL")
def _(m: Model) -> DataFrame:
    return H.job_postings(H.parse_pages(_page_html(m))).select("url", "title", F.col("salary_min").alias("lo"), F.col("salary_max").alias("hi"), F.col("salary_period").alias("period"))


_LISTED = "SELECT id, url, trim(title) AS title, nullif(trim(location, ' '), '') AS location FROM jobs WHERE url IS NOT NULL AND nullif(trim(title), '') IS NOT NULL"


@query("A8_greenhouse", f"SELECT id, title, location, CASE WHEN contains(lower(location), 'remote') THEN 'remote' END AS remote_mode, 10.0::DOUBLE AS lo, CASE WHEN id % 2 = 0 THEN 'hour' ELSE 'year' END AS period FROM ({_LISTED})")
def _(m: Model) -> DataFrame:
    pay = F.struct(F.lit(1000.0).alias("min_cents"), F.lit(2000.0).alias("max_cents"), F.lit("USD").alias("currency_type"), F.when(F.col("id") % 2 == 0, "Hourly Pay Range").otherwise("Salary").alias("title"))
    one = F.struct("id", "title", F.col("url").alias("absolute_url"), F.struct(F.col("location").alias("name")).alias("location"), F.array(pay).alias("pay_input_ranges"))
    body = m.jobs.select(F.col("id").alias("job"), F.to_json(F.struct(F.array(one).alias("jobs"))).alias("body"))
    return B.parse(body, "greenhouse").select(F.col("job").alias("id"), "title", "location", "remote_mode", F.col("salary_min").alias("lo"), F.col("salary_period").alias("period"))


@query("A9_lever", f"SELECT id, title, location, 'full_time' AS employment_type, first_seen AS posted_at FROM ({_LISTED.replace('SELECT id', 'SELECT first_seen, id')})")
def _(m: Model) -> DataFrame:
    one = F.struct(F.col("id").cast("string").alias("id"), F.col("title").alias("text"), F.col("url").alias("hostedUrl"), F.struct("location", F.lit("Full-time").alias("commitment")).alias("categories"), F.col("first_seen").alias("createdAt"))
    body = m.jobs.select(F.col("id").alias("job"), F.to_json(F.array(one)).alias("body"))
    return B.parse(body, "lever").select(F.col("job").alias("id"), "title", "location", "employment_type", "posted_at")


@query("A10_ashby", f"SELECT id, title, 'remote' AS remote_mode, 7.0::DOUBLE AS lo FROM ({_LISTED}) WHERE id % 3 <> 0")
def _(m: Model) -> DataFrame:
    comp = F.struct(F.array(F.struct(F.lit("Bonus").alias("compensationType"), F.lit(1.0).alias("minValue")), F.struct(F.lit("Salary").alias("compensationType"), F.lit(7.0).alias("minValue"))).alias("summaryComponents"))
    one = F.struct(F.col("id").cast("string").alias("id"), "title", F.col("url").alias("jobUrl"), F.lit(True).alias("isRemote"), (F.col("id") % 3 != 0).alias("isListed"), comp.alias("compensation"))
    body = m.jobs.select(F.col("id").alias("job"), F.to_json(F.struct(F.array(one).alias("jobs"))).alias("body"))
    return B.parse(body, "ashby").select(F.col("job").alias("id"), "title", "remote_mode", F.col("salary_min").alias("lo"))


@query("A11_vendor_api", "SELECT key, CASE vendor WHEN 'greenhouse' THEN 'https://boards-api.greenhouse.io/v1/boards/' || token || '/jobs?content=true&pay_transparency=true' WHEN 'lever' THEN 'https://api.lever.co/v0/postings/' || token || '?mode=json' WHEN 'ashby' THEN 'https://api.ashbyhq.com/posting-api/job-board/' || token || '?includeCompensation=true' END AS api FROM boards", "boards")
def _(m: Model) -> DataFrame:
    return m.boards.select("key", B.api_url(F.col("vendor"), F.col("token")).alias("api"))


@query("A13_sitemap", "SELECT id, false AS is_index, unnest([url || '?a=1&b=2', careers_url]) AS loc FROM (SELECT id, 'https://' || host || '/' AS url, coalesce(careers_url, 'none') AS careers_url FROM domains)")
def _(m: Model) -> DataFrame:
    xml = F.concat(F.lit("<urlset><url><LOC> https://"), "host", F.lit("/?a=1&amp;b=2 </LOC></url><url><loc><![CDATA["), F.coalesce("careers_url", F.lit("none")), F.lit("]]></loc></url><url><loc>cut"))
    return S.parse_sitemaps(m.domains.select("id", xml.alias("xml")))


@query("A16_gazetteer", "SELECT count(*) AS names FROM (SELECT place_id, lower(trim(unnest(string_split(city || coalesce(',' || alt_names, ''), ',')))) AS n FROM places WHERE city IS NOT NULL)")
def _(m: Model) -> DataFrame:
    return G.city_names(m.places).agg(F.count("*").alias("names"))


@query("A23_index_scan", r"SELECT doc_id, count(*) AS hits FROM (SELECT doc_id, unnest(string_split(trim(regexp_replace(regexp_replace(strip_accents(lower(text)), '\p{M}', '', 'g'), '[^\p{L}\p{N}]+', ' ', 'g')), ' ')) AS t FROM documents) WHERE t = 'team' GROUP BY doc_id")
def _(m: Model) -> DataFrame:
    from heronry.operators.fulltext import term_index

    d = m.documents.withColumnRenamed("doc_id", "id")
    return term_index(d, {"text": F.col("text")}).where("term = 'team'").groupBy("doc_id").agg(F.count("*").alias("hits"))


# --- I: domain operators ----------------------------------------------------------------------------------------------


_LINK = rf"""WITH b AS (SELECT p.id, p.url, lower(coalesce(p.title, '')) AS t, d.host, d.status, p.id % 5 = 0 AS nf, p.id % 4 AS depth, p.id % 30 AS pages, array_to_string(string_split({_HOST.format("p.url")}, '.')[-2:], '.') AS target,
    list_filter(string_split(lower(regexp_extract(p.url, '^[a-z]+://[^/?#]*([^?#]*)', 1)), '/'), lambda s: s <> '') AS segs, regexp_extract(p.url, '\?([^#]*)', 1) AS q FROM parsed_pages p LEFT JOIN domains d ON d.id = p.domain_id),
  s AS (SELECT *, coalesce(target = host, false) AS inside,
    len(list_filter(segs, lambda x: x IN ({", ".join(f"'{c}'" for c in U.CAREERS_TOKENS)}) OR len(list_intersect(regexp_split_to_array(x, '[-_.]'), ['careers', 'career', 'jobs', 'hiring', 'vacancies'])) > 0)) > 0 AS in_url, {" OR ".join(f"contains(t, $q${c}$q$)" for c in U.CAREERS_PHRASES)} AS in_text,
    len(list_intersect(segs, {list(L.ARCHIVES)})) > 0 OR len(list_intersect(list_transform(list_filter(string_split(q, '&'), lambda x: x <> ''), lambda x: lower(split_part(x, '=', 1))), {list(L.ARCHIVE_PARAMS)})) > 0 AS archive, len(list_intersect(segs, {list(L.DROPPED)})) > 0 AS never FROM b)
  SELECT id, CASE WHEN NOT never THEN 10.0 + CASE WHEN in_url AND in_text THEN 60 WHEN in_url THEN 50 WHEN in_text THEN 40 ELSE 0 END + CASE WHEN NOT inside THEN 8 WHEN len(list_intersect(segs, {list(L.COMPANY_SEGMENTS)})) > 0 THEN 4 ELSE 0 END - CASE WHEN archive THEN 8 WHEN q <> '' THEN 2 ELSE 0 END
    - CASE WHEN segs[1] IN ('blog', 'news', 'press', 'events', 'articles', 'resources', 'podcast') THEN 4 ELSE 0 END + CASE status WHEN 'company' THEN 10 WHEN 'not_company' THEN -15 ELSE 0 END - CASE WHEN nf THEN 5 ELSE 0 END - 2.0 * depth - least(0.5 * pages, 10) END::DOUBLE AS score FROM s"""


@query("I2_score_links", _LINK)
def _(m: Model) -> DataFrame:
    d = m.domains.select(F.col("id").alias("domain_id"), "host", "status")
    p = m.pages.select("id", "url", "title", "domain_id").join(d, "domain_id", "left")
    p, u = U.staged(p, "url")
    s = L.score_link(u, "title", F.col("id") % 5 == 0, "host", F.col("id") % 4, F.col("id") % 30, "status")
    return p.select("id", s.alias("s")).select("id", F.col("s.score").alias("score"))


@query("I3_assess_pages", rf"""SELECT id, round(CASE WHEN parked THEN 0 ELSE least(1.0, (CASE WHEN len(list_intersect(regexp_split_to_array(f, '[^\p{{L}}\p{{N}}]+'), ['{"','".join(L.LEGAL)}'])) > 0 THEN 0.2 ELSE 0 END) + (CASE WHEN contains(f, '©') OR contains(f, 'copyright') OR contains(f, '(c) 20') THEN 0.1 ELSE 0 END)
  + (CASE WHEN starts_with(url, 'https://') THEN 0.05 ELSE 0 END) + (CASE WHEN id % 7 >= 5 THEN 0.1 WHEN id % 7 >= 2 THEN 0.05 ELSE 0 END) + (id % 2 = 0)::INT * 0.2 + (id % 3 = 0)::INT * 0.1 + (id % 5 = 0)::INT * 0.05 + (id % 11 = 0)::INT * 0.1 + (id % 13 = 0)::INT * 0.05 + (id % 17 = 0)::INT * 0.25 + (id % 4 = 0)::INT * 0.05) END::DOUBLE, 6) AS score,
  parked OR NOT (octet_length(encode(coalesce(text, ''))) < 300 AND n < 5) AS conclusive, parked FROM (SELECT *, lower(coalesce(footer_text, '')) AS f, id % 19 = 0 AS parked, 2 + (id % 2 = 0)::INT + (id % 3 = 0)::INT + (id % 5 = 0)::INT + (id % 11 = 0)::INT + (id % 13 = 0)::INT AS n FROM parsed_pages)""")  # fmt: skip
def _(m: Model) -> DataFrame:
    # two links elsewhere, and by the page's number one to each kind of page, by its path or by its text
    at = lambda path, text: F.struct(F.concat(F.lit("https://www."), "domain", F.lit(path)).alias("url"), F.lit(text).alias("text"))
    other = lambda path, text: F.struct(F.lit(f"https://o.example{path}").alias("url"), F.lit(text).alias("text"))
    when = lambda k, x: F.when(F.col("id") % k == 0, x)
    links = F.array_compact(F.array(other("/about", "About them"), other("/jobs", "Contact"), when(2, at("/x", "We are hiring")), when(3, at("/team", "x")), when(5, at("/y", "Contact us")), when(11, other("/privacy-policy", "x")), when(13, other("/z", "Terms of use"))))
    p, u = U.staged(m.pages.withColumn("title", F.when(F.col("id") % 19 == 0, "Buy this domain").otherwise(F.col("title"))), "url")
    p = p.withColumn("domain", U.registrable_domain(u)).withColumn("links", links)
    p = p.join(L.link_signals(p.select("id", "domain", "links")), "id", "left")
    a = L.assess(u, F.col("title"), F.col("text"), F.col("footer_text"), F.col("found"), F.size("links"), F.col("id") % 17 == 0, F.when(F.col("id") % 4 == 0, "Site"), F.col("id") % 7)
    return p.select("id", a.alias("a")).select("id", F.round("a.score", 6).alias("score"), "a.conclusive", "a.parked")


_FOLD = """WITH p AS (SELECT domain_id, list({{'s': (id * 17 % 80) / 100.0::DOUBLE, 'parked': id % 7 = 0, 'home': coalesce(kind = 'home', false) AND id % 5 <> 0}} ORDER BY id) AS l FROM parsed_pages WHERE domain_id IS NOT NULL GROUP BY domain_id),
  -- one page after the other: the state is what is stored of a domain
  r AS (SELECT d.id, list_reduce(list_prepend({{'st': {status}, 'best': {score}, 'seen': false, 's': 0.0::DOUBLE, 'parked': false, 'home': false}}, list_transform(l, lambda x: {{'st': '', 'best': 0.0::DOUBLE, 'seen': false, 's': x.s, 'parked': x.parked, 'home': x.home}})),
    lambda a, x: {{'st': CASE WHEN a.st = 'company' THEN 'company' WHEN x.parked THEN 'not_company' WHEN greatest(a.best, x.s) >= 0.6 THEN 'company' WHEN (a.seen OR x.home) AND greatest(a.best, x.s) < 0.3 THEN 'not_company' ELSE 'probing' END,
      'best': greatest(a.best, x.s), 'seen': a.seen OR x.home, 's': 0.0::DOUBLE, 'parked': false, 'home': false}}) AS z FROM {domains} d JOIN p ON p.domain_id = d.id)"""


@query("I4_fold_domains", _FOLD.format(status="''", score="0.0::DOUBLE", domains="(SELECT domain_id AS id FROM p)") + " SELECT id AS domain_id, z.best AS best_score, z.st AS status, z.seen AS home_seen FROM r")
def _(m: Model) -> DataFrame:
    return merge.fold_domains(assessments(m)).select("domain_id", "best_score", "status", "home_seen")


def assessments(m: Model) -> DataFrame:
    """Assessments of the pages, by their numbers: each seventh is parked, each fifth proves nothing."""
    p = m.pages.where("domain_id is not null")
    return p.select("domain_id", "id", ((F.col("id") * 17 % 80) / 100.0).alias("score"), (F.col("id") % 7 == 0).alias("parked"), (F.col("id") % 5 != 0).alias("conclusive"), (F.col("kind") == "home").alias("home"), F.array(F.lit("x")).alias("reasons"), F.col("title").alias("name"))


@query("I5_attributed_board", r"""SELECT p.id, CASE p.id % 6 WHEN 0 THEN 'greenhouse/' || l WHEN 1 THEN 'ashby/' || l || '-jobs' WHEN 2 THEN 'lever/' || l WHEN 3 THEN 'lever/x' END AS key, CASE WHEN p.id % 6 < 2 THEN 'embed' ELSE 'link' END AS source
  FROM parsed_pages p JOIN (SELECT id, host, split_part(host, '.', 1) AS l FROM domains) d ON d.id = p.domain_id WHERE p.id % 6 < 4""")
def _(m: Model) -> DataFrame:
    d = m.domains.select(F.col("id").alias("domain_id"), F.col("host").alias("domain"), F.substring_index("host", ".", 1).alias("l"))
    lever, none = lambda t: F.concat(F.lit("https://jobs.lever.co/"), t if not isinstance(t, str) else F.lit(t)), F.array().cast("array<string>")
    case = F.col("id") % 6
    embeds = F.when(case == 0, F.array(F.concat(F.lit("https://boards.greenhouse.io/embed/job_board/js?for="), "l"))).when(case == 1, F.array(lever("a"), lever("a/b"), F.concat(F.lit("https://jobs.ashbyhq.com/"), "l", F.lit("-jobs")))).when(case == 2, F.array(lever("a"), lever("b"))).otherwise(none)
    link = lambda u, t: F.struct(u.alias("url"), F.lit(t).alias("text"))
    links = F.when(case == 2, F.array(link(lever("a"), "Careers"), link(lever(F.col("l")), "More"))).when(case == 3, F.array(link(F.lit("https://x.example/"), "Jobs"), link(lever("x"), "one"), link(lever("x/1"), "Our careers"))).when(case == 4, F.array(link(lever("x"), "A partner"))).otherwise(F.array(link(lever("a"), "Careers"), link(lever("b"), "Careers")))
    pages = m.pages.select("id", "domain_id").join(d, "domain_id").withColumns({"embeds": embeds, "links": F.when(case < 2, F.lit(None)).otherwise(links)})
    return boards.attributed(pages).select("id", "key", "source")


_W, _DW = words_sql("coalesce(title, '')"), words_sql("coalesce(department, '')")


@query("I6_category_seniority", f"SELECT id, coalesce({first_match_sql(_W, E.CATEGORIES)}, {first_match_sql(_DW, E.CATEGORIES)}) AS c, {first_match_sql(_W, E.SENIORITIES)} AS s FROM jobs")
def _(m: Model) -> DataFrame:
    return m.jobs.select("id", E.category("title", "department").alias("c"), E.seniority("title").alias("s"))


_SW = r"trim(regexp_replace(regexp_replace(trim(regexp_replace(lower(coalesce(title, '') || ' ' || substring(coalesce(description, ''), 1, 6000)), '[^\p{L}\p{N}+#.]+', ' ', 'g')), '\.+( |$)', ' ', 'g'), ' +', ' ', 'g'))"


@query("I7_skills", "SELECT id, list_filter([" + ", ".join(f"CASE WHEN {' OR '.join(f'contains(t, $q$ {s} $q$)' for s in signs)} THEN '{n}' END" for n, signs in E.SKILLS.items()) + f"], lambda x: x IS NOT NULL)[1:12] AS skills FROM (SELECT id, ' ' || {_SW} || ' ' AS t FROM jobs)")
def _(m: Model) -> DataFrame:
    return m.jobs.select("id", E.skills("title", "description").alias("skills"))


_GEO = r"""WITH n AS (SELECT place_id, lower(trim(unnest(string_split(city || coalesce(',' || alt_names, ''), ',')))) AS name, country_code, city FROM places WHERE city IS NOT NULL),
  k AS (SELECT country_code, lower(trim(unnest(string_split(country_name || ',' || country_code || coalesce(',' || alt_names, ''), ',')))) AS name FROM places WHERE city IS NULL),
  p AS (SELECT location, unnest(range(1, len(l) + 1)) AS pos, unnest(l) AS part FROM (SELECT location, regexp_split_to_array(regexp_replace(location, ' [-–] ', ',', 'g'), '[,|/;()·]') AS l FROM (SELECT DISTINCT location FROM jobs WHERE location IS NOT NULL))),
  q AS (SELECT location, pos, lower(trim(regexp_replace(part, '\s+', ' ', 'g'))) AS name FROM p),
  land AS (SELECT location, arg_min(country_code, [pos::VARCHAR, country_code]) AS land FROM q JOIN k USING (name) GROUP BY location),
  hit AS (SELECT q.location, pos, place_id, city, n.country_code FROM q JOIN n USING (name) LEFT JOIN land ON land.location = q.location WHERE land IS NULL OR land = n.country_code),
  b AS (SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY location ORDER BY pos, place_id) = 1)
  SELECT coalesce(b.location, land.location) AS location, city, coalesce(country_code, land) AS country_code FROM b FULL JOIN land ON land.location = b.location"""


@query("I8_geocode", _GEO)
def _(m: Model) -> DataFrame:
    return G.geocode(m.jobs, m.places).select("location", "city", "country_code")


@query("I9_rules", f"SELECT id, coalesce({first_match_sql(_W, E.CATEGORIES)}, {first_match_sql(_DW, E.CATEGORIES)}) AS category, coalesce(remote_mode, CASE WHEN {has_word_sql('lw', 'hybrid')} THEN 'hybrid' WHEN {has_word_sql('lw', 'remote')} OR {has_word_sql('lw', 'anywhere')} OR {has_word_sql('lw', 'worldwide')} THEN 'remote' END) AS mode, round(salary_usd_annual, 4) AS usd FROM (SELECT *, {words_sql(chr(99) + 'oalesce(location, ' + chr(39) * 2 + ')')} AS lw FROM facts)", "facts")
def _(m: Model) -> DataFrame:
    f = m.facts
    return f.select("id", E.category("title", "department").alias("category"), F.coalesce("remote_mode", E.remote_mode_of("location")).alias("mode"), F.round("salary_usd_annual", 4).alias("usd"))


@query("I10_needs_model", f"SELECT id, category IS NULL OR (((trim(loc) <> '' AND NOT ({has_word_sql('lw', 'hybrid')} OR {has_word_sql('lw', 'remote')} OR {has_word_sql('lw', 'anywhere')} OR {has_word_sql('lw', 'worldwide')})) OR contains(loc, ',')) AND country_code IS NULL) AS needs FROM (SELECT *, coalesce(location, '') AS loc, {words_sql(chr(99) + 'oalesce(location, ' + chr(39) * 2 + ')')} AS lw FROM jobs)")
def _(m: Model) -> DataFrame:
    return m.jobs.select("id", E.needs_model("location", "category", "country_code").alias("needs"))


ME = matching.Profile(
    titles=["Data Engineer", "Senior Store Manager"], skills={"sql": 0.9, "python": 0.4, "excel": 0.2}, years=6, locations=[matching.Place("Here", "DE", 10.0, 20.0), matching.Place("There", "FR")], salary_usd=60_000.0, must_have=["team"], exclude=["night shift"], excluded_companies=["Navmom"],
)


def _scored(m: Model) -> DataFrame:
    from heronry.operators.topk import with_domain

    return matching.score(with_domain(m.facts, m.domains).withColumn("skill_list", json_list("skills")), ME)


_MATCH = r"""WITH s AS (SELECT f.id, {skills} AS a, {title} AS b, {level} AS c, {place} AS d, {pay} AS e,
    contains(hay, 'night shift') OR contains(coalesce(regexp_replace(lower(company), '[^\p{{L}}\p{{N}}]', '', 'g'), ''), 'navmom') OR coalesce(regexp_replace(split_part(host, '.', 1), '[^a-z0-9]', '', 'g') = 'navmom', false) AS bad, contains(hay, 'team') AS ok
  FROM (SELECT facts.*, host, lower(coalesce(title, '') || ' ' || coalesce(company, '') || ' ' || substring(coalesce(description, ''), 1, 3000)) AS hay, CASE WHEN json_valid(skills) THEN CAST(from_json(skills, '["VARCHAR"]') AS VARCHAR[]) ELSE [] END AS sl,
    list_filter(string_split({words}, ' '), lambda x: x NOT IN ('', 'senior','sr','junior','jr','lead','staff','principal','head','of','the','and','intern')) AS w,
    {km} AS km FROM facts LEFT JOIN domains d ON d.id = facts.domain_id) f)
  SELECT id, round(CASE WHEN bad THEN 0 ELSE least(greatest(CASE WHEN ok THEN t ELSE least(t, 0.35) END, 0), 1) END::DOUBLE, 9) AS score FROM (SELECT *, 0.35::DOUBLE * a + 0.25::DOUBLE * b + 0.1::DOUBLE * c + 0.2::DOUBLE * d + 0.1::DOUBLE * e AS t FROM s)""".format(
    skills="CASE WHEN len(sl) = 0 THEN 0.5 ELSE list_sum(list_transform(sl, lambda x: CASE lower(x) WHEN 'sql' THEN 0.96 WHEN 'python' THEN 0.76 WHEN 'excel' THEN 0.68 ELSE 0 END::DOUBLE)) / len(sl) END",
    title="CASE WHEN greatest(len(list_filter(['data', 'engineer'], lambda x: list_contains(w, x))), len(list_filter(['store', 'manager'], lambda x: list_contains(w, x)))) / 2.0 >= 0.6 THEN 1.0 WHEN greatest(len(list_filter(['data', 'engineer'], lambda x: list_contains(w, x))), len(list_filter(['store', 'manager'], lambda x: list_contains(w, x)))) / 2.0 >= 0.34 THEN 0.8 WHEN category IS NULL THEN 0.5 WHEN category = 'data' THEN 0.7 WHEN category IN ('engineering', 'product', 'finance') THEN 0.4 ELSE 0.1 END",
    level="coalesce(CASE abs((map {'intern': 0, 'junior': 1, 'mid': 2, 'senior': 3, 'lead': 4, 'manager': 4, 'director': 5, 'executive': 6})[seniority] - 3) WHEN 0 THEN 1.0 WHEN 1 THEN 0.8 WHEN 2 THEN 0.35 WHEN 3 THEN 0.1 END, 0.5)",
    place="CASE WHEN remote_mode = 'remote' THEN CASE WHEN len(remote_regions) = 0 THEN 0.7 WHEN list_contains(remote_regions, 'global') OR list_contains(remote_regions, 'DE') OR list_contains(remote_regions, 'FR') THEN 1.0 ELSE 0.15 END WHEN km IS NOT NULL THEN CASE WHEN km <= 50 THEN 1.0 WHEN km <= 100 THEN 0.8 WHEN km <= 250 THEN 0.5 WHEN country_code IN ('DE', 'FR') THEN 0.4 ELSE 0.05 END WHEN country_code IN ('DE', 'FR') THEN 0.5 WHEN country_code IS NOT NULL THEN 0.05 ELSE 0.5 END",
    pay="CASE WHEN salary_usd_annual IS NULL THEN 0.5 WHEN salary_usd_annual >= 60000 THEN 1.0 WHEN salary_usd_annual / 60000.0::DOUBLE >= 0.8 THEN 0.7 ELSE 0.2 END",
    words=words_sql("coalesce(title, '')"),
    km="CASE WHEN lat IS NOT NULL THEN 2 * 6371.0::DOUBLE * asin(sqrt(least(1.0::DOUBLE, pow(sin(radians(10.0 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(10.0::DOUBLE)) * pow(sin(radians(20.0 - lon) / 2), 2)))) END",
)


@query("I11_match_scores", _MATCH, "facts")
def _(m: Model) -> DataFrame:
    return _scored(m).select("id", F.round("score", 9).alias("score"))


_REASONS = _MATCH.split("  SELECT id, round(")[0].replace("AS ok\n", "AS ok, km, sl, category, seniority, country_code, remote_mode, remote_regions, salary_usd_annual, w, contains(coalesce(regexp_replace(lower(company), '[^\\p{L}\\p{N}]', '', 'g'), ''), 'navmom') OR coalesce(regexp_replace(split_part(host, '.', 1), '[^a-z0-9]', '', 'g') = 'navmom', false) AS own\n") + """
  SELECT id, CASE WHEN own THEN 'excluded company: Navmom' WHEN bad THEN 'excluded: mentions "night shift"' ELSE array_to_string(list_filter([
    CASE WHEN len(sl) > 0 THEN CASE WHEN len(hit) = 0 THEN 'skills: none of ' || len(sl) || ' match' ELSE 'skills: ' || array_to_string(hit, ', ') || ' (' || len(hit) || '/' || len(sl) || ')' END END,
    CASE WHEN b >= 0.8 THEN CASE WHEN b = 1.0 THEN 'title: like ' ELSE 'title: close to ' END || CASE WHEN list_contains(w, 'data')::INT + list_contains(w, 'engineer')::INT >= list_contains(w, 'store')::INT + list_contains(w, 'manager')::INT THEN 'Data Engineer' ELSE 'Senior Store Manager' END
      WHEN category IS NULL THEN NULL WHEN b = 0.7 THEN 'category: ' || category WHEN b = 0.4 THEN 'category: near ' || category ELSE 'category: ' || category || ' is outside your titles' END,
    CASE WHEN seniority IN ('intern', 'junior', 'mid', 'senior', 'lead', 'manager', 'director', 'executive') THEN 'seniority: ' || seniority || ' vs your senior' END,
    CASE WHEN remote_mode = 'remote' THEN CASE WHEN len(remote_regions) = 0 THEN 'remote' WHEN d = 1.0 THEN 'remote, open to you' ELSE 'remote, but not open to your country' END
      WHEN km IS NOT NULL THEN 'location: ' || CAST(round_even(km, 0) AS BIGINT) || ' km from Here' WHEN country_code IN ('DE', 'FR') THEN 'location: in ' || country_code WHEN country_code IS NOT NULL THEN 'location: ' || country_code END,
    CASE WHEN salary_usd_annual IS NOT NULL THEN CASE e WHEN 1.0 THEN 'salary: at or above your expectation' WHEN 0.7 THEN 'salary: a little under your expectation' ELSE 'salary: well under your expectation' END END,
    CASE WHEN NOT ok THEN 'missing must-have: team' END], lambda x: x IS NOT NULL), ' | ') END AS reasons FROM (SELECT *, list_filter(sl, lambda x: lower(x) IN ('sql', 'python', 'excel')) AS hit FROM s)"""


@query("I11_match_reasons", _REASONS, "facts")
def _(m: Model) -> DataFrame:
    return _scored(m).select("id", F.array_join("reasons", " | ").alias("reasons"))


@query("I12_steering", f"SELECT id, CASE WHEN {' OR '.join(f'contains(t, $q$ {w} $q$)' for w in ('energy',))} THEN 3.0 ELSE 0.0 END::DOUBLE AS points FROM (SELECT id, ' ' || {words_sql(chr(99) + 'oalesce(industry, ' + chr(39) * 2 + ')')} || ' ' || ' ' AS t FROM domains)")
def _(m: Model) -> DataFrame:
    return m.domains.select("id", L.steering_boost(F.concat(F.lit("https://"), "host", F.lit("/")), "industry", ["energy"], ["engineering"])["points"].alias("points"))


@query("I14_profiles")
def _(m: Model) -> DataFrame:
    from heronry.functions.cv import profiles

    return profiles(spread(m.documents.select("doc_id", "text"), "doc_id"), 2026).select("doc_id", "titles", "years", F.map_keys("skills").alias("skills"))


@query("I17_suggest", """WITH n AS (SELECT place_id, city, country_code, lower(trim(unnest(string_split(city || coalesce(',' || alt_names, ''), ',')))) AS name FROM places WHERE city IS NOT NULL),
  r AS (SELECT place_id, any_value(city) AS city, any_value(country_code) AS cc, CAST(min(CASE WHEN name = 'san' THEN 0 WHEN starts_with(name, 'san') THEN 1 WHEN contains(name, ' san') THEN 2 END) AS INTEGER) AS rank FROM n GROUP BY place_id)
  SELECT r.city || ', ' || c.country_name AS value, 'city' AS kind, rank FROM r JOIN places c ON c.city IS NULL AND c.country_code = r.cc WHERE rank IS NOT NULL ORDER BY rank, r.place_id LIMIT 8""")  # fmt: skip
def _(m: Model) -> DataFrame:
    return G.suggest(m.places, "San", 8)


_NODES = """pc AS (SELECT domain_id, count(*) AS n FROM parsed_pages WHERE fetched_at <= {t} GROUP BY 1), jc AS (SELECT domain_id, count(*) AS n FROM jobs WHERE first_seen <= {t} AND (closed_at IS NULL OR closed_at > {t}) GROUP BY 1),
  dg AS (SELECT id, count(*) AS n FROM (SELECT src_domain_id AS id FROM edges WHERE first_seen <= {t} UNION ALL SELECT dst_domain_id FROM edges WHERE first_seen <= {t}) GROUP BY 1)"""
_LIVE = "WITH " + _NODES.format(t=graph.FOREVER) + " SELECT d.id, host, status, coalesce(pc.n, 0) AS pages, coalesce(jc.n, 0) AS jobs, coalesce(dg.n, 0) AS degree FROM domains d LEFT JOIN pc ON pc.domain_id = d.id LEFT JOIN jc ON jc.domain_id = d.id LEFT JOIN dg ON dg.id = d.id ORDER BY coalesce(pc.n, 0) * 3 + coalesce(jc.n, 0) + coalesce(dg.n, 0) DESC, d.id LIMIT 200"


@query("I18_domain_graph", _LIVE, "edges")
def _(m: Model) -> DataFrame:
    return graph.domain_graph(m.domains, m.pages, m.jobs, m.edges)[0].select("id", "host", "status", "pages", "jobs", "degree")


@query("C5_graph_joins", _LIVE.rsplit(" ORDER BY", 1)[0], "edges")
def _(m: Model) -> DataFrame:
    return graph.ranked_nodes(m.domains, m.pages, m.jobs, m.edges, None, None, True).select("id", "host", "status", "pages", "jobs", "degree")


@query("F8_graph_page", _LIVE.replace("LIMIT 200", "LIMIT 20 OFFSET 10"), "edges")
def _(m: Model) -> DataFrame:
    return graph.domain_graph(m.domains, m.pages, m.jobs, m.edges, limit=20, offset=10)[0].select("id", "host", "status", "pages", "jobs", "degree")


@query("I18_graph_edges", f"WITH n AS ({_LIVE.replace('LIMIT 200', 'LIMIT 60')}), a AS (SELECT id FROM n), p AS (SELECT id FROM n ORDER BY pages * 3 + jobs + degree DESC, id LIMIT 20 OFFSET 40) SELECT src_domain_id AS source, dst_domain_id AS target, weight FROM edges WHERE src_domain_id IN (FROM a) AND dst_domain_id IN (FROM a) AND (src_domain_id IN (FROM p) OR dst_domain_id IN (FROM p))", "edges")
def _(m: Model) -> DataFrame:
    return graph.domain_graph(m.domains, m.pages, m.jobs, m.edges, limit=20, offset=40)[1]


_T = 1_760_000_000_000
_STATUS = f"cls AS (SELECT host, arg_max(status, id) AS status FROM log WHERE kind = 'domain_classified' AND ts <= {_T} GROUP BY host)"


@query("K7_replay", f"WITH {_NODES.format(t=_T)}, {_STATUS} SELECT d.id, coalesce(cls.status, 'discovered') AS status, coalesce(pc.n, 0) AS pages, coalesce(jc.n, 0) AS jobs FROM (SELECT id, 'd' || id AS host, first_seen FROM domains) d LEFT JOIN cls USING (host) LEFT JOIN pc ON pc.domain_id = d.id LEFT JOIN jc ON jc.domain_id = d.id LEFT JOIN dg ON dg.id = d.id WHERE first_seen <= {_T} ORDER BY coalesce(pc.n, 0) * 3 + coalesce(jc.n, 0) + coalesce(dg.n, 0) DESC, d.id LIMIT 200", "edges", "log")
def _(m: Model) -> DataFrame:
    d = m.domains.withColumn("host", F.concat(F.lit("d"), "id"))
    return graph.domain_graph(d, m.pages, m.jobs, m.edges, m.log, at=_T)[0].select("id", "status", "pages", "jobs")


@query("I18_graph_counts", "SELECT (SELECT count(*) FROM domains WHERE first_seen IS NOT NULL) AS domains, (SELECT count(*) FROM domains WHERE status = 'company') AS companies, (SELECT count(*) FROM parsed_pages WHERE fetched_at IS NOT NULL) AS pages, (SELECT count(*) FROM jobs WHERE first_seen IS NOT NULL AND closed_at IS NULL) AS open_jobs")
def _(m: Model) -> DataFrame:
    return graph.domain_graph(m.domains, m.pages, m.jobs, m.edges)[2]


def _page_graph(m: Model):
    return graph.page_graph(m.pages, m.links, m.frontier, 2, "navmommavlom.example")


_LABEL = r"CASE WHEN regexp_extract({0}, '^[a-z]+://[^/?#]*([^?#]*)', 1) IN ('', '/') AND regexp_extract({0}, '\?([^#]*)', 1) = '' THEN " + _HOST.replace("{}", "{0}") + r" ELSE regexp_extract({0}, '^[a-z]+://[^/?#]*([^#]*)', 1) END"
_PAGES = rf"""WITH own AS (SELECT id, url, kind, error FROM parsed_pages WHERE domain_id = 2 ORDER BY (kind = 'home') DESC NULLS LAST, (kind = 'careers') DESC NULLS LAST, (kind = 'job') DESC NULLS LAST, id LIMIT 500),
  o AS (SELECT own.id, own.url AS src, dst_url, {_HOST.format("dst_url")} AS h, dst_url IN (SELECT url FROM own) AS fetched FROM own JOIN links ON src_page_id = own.id),
  w AS (SELECT dst_url FROM o WHERE array_to_string(string_split(h, '.')[-2:], '.') = 'navmommavlom.example' AND NOT fetched GROUP BY dst_url ORDER BY min(id), dst_url LIMIT 200),
  x AS (SELECT h, count(*) AS n FROM o WHERE array_to_string(string_split(h, '.')[-2:], '.') <> 'navmommavlom.example' GROUP BY h ORDER BY n DESC, h LIMIT 40)
"""


@query("I19_page_graph", _PAGES + f"SELECT url AS key, {_LABEL.format('url')} AS label, CASE WHEN error IS NOT NULL THEN 'failed' ELSE kind END AS kind, NULL::VARCHAR AS state FROM own UNION ALL SELECT dst_url, {_LABEL.format('dst_url')}, 'pending', f.state FROM w LEFT JOIN frontier f ON f.url = dst_url UNION ALL SELECT h, h, 'external', NULL FROM x", "links", "frontier")
def _(m: Model) -> DataFrame:
    return _page_graph(m)[0]


@query("C20_page_graph_edges", _PAGES + "SELECT source, target, count(*) AS n FROM (SELECT src AS source, dst_url AS target FROM o WHERE fetched UNION ALL SELECT src, dst_url FROM o WHERE NOT fetched AND dst_url IN (FROM w) UNION ALL SELECT src, h FROM o WHERE array_to_string(string_split(h, '.')[-2:], '.') <> 'navmommavlom.example' AND h IN (SELECT h FROM x)) GROUP BY 1, 2", "links", "frontier")
def _(m: Model) -> DataFrame:
    return _page_graph(m)[1]


@query("I20_history", "WITH b AS (SELECT min(ts) AS a, greatest((1707000000000 - min(ts)) // 160, 1000) AS w FROM log) SELECT a + (ts - a) // w * w AS t, count(*) FILTER (kind = 'page_fetched') AS pages, CAST(coalesce(sum(CASE WHEN kind = 'jobs_found' THEN new END), 0) AS BIGINT) AS new_jobs FROM log, b WHERE kind IN ('page_fetched', 'jobs_found') GROUP BY 1", "log")
def _(m: Model) -> DataFrame:
    return timeline.history(m.log, 160, 1_707_000_000_000)[1]


@query("I21_crawler_status", "SELECT (SELECT max(id) FROM log WHERE kind = 'crawler_started') AS last_start, (SELECT max(id) FROM log WHERE kind = 'crawler_stopped') AS last_stop, (SELECT max(ts) FROM samples) AS last_sample, (SELECT max(id) FROM log WHERE kind = 'crawler_started') > (SELECT max(id) FROM log WHERE kind = 'crawler_stopped') AND (SELECT max(ts) FROM samples) >= 1706000000000 - 15000 AS running", "log", "samples")
def _(m: Model) -> DataFrame:
    return timeline.crawler_status(m.log, m.samples, 1_706_000_000_000).drop("paused")


@query("I21_paused", "WITH c AS (SELECT id, CASE WHEN id % 4 = 0 THEN 'control_applied' ELSE kind END AS kind, CASE WHEN id % 4 = 0 THEN CASE WHEN id % 8 = 0 THEN 'pause' ELSE 'resume' END END AS command FROM log), s AS (SELECT max(id) AS s FROM c WHERE kind = 'crawler_started') SELECT (SELECT max(id) FROM c WHERE kind = 'crawler_stopped') < s AS running, coalesce((SELECT max(id) FROM c WHERE kind = 'crawler_stopped') < s AND (SELECT arg_max(command, id) FROM c WHERE command IS NOT NULL AND id > s) = 'pause', false) AS paused FROM s", "log")
def _(m: Model) -> DataFrame:
    applied = F.col("id") % 4 == 0
    log = m.log.withColumns({"kind": F.when(applied, "control_applied").otherwise(F.col("kind")), "command": F.when(applied, F.when(F.col("id") % 8 == 0, "pause").otherwise("resume"))})
    return timeline.crawler_status(log, m.samples, 0).select("running", "paused")


@query("I22_domain_detail", "SELECT (SELECT count(*) FROM parsed_pages WHERE domain_id = 2) AS pages, (SELECT count(*) FROM jobs WHERE domain_id = 2 AND closed_at IS NULL) AS open_jobs, (SELECT count(*) FROM edges WHERE dst_domain_id = 2) AS inbound, (SELECT count(*) FROM edges WHERE src_domain_id = 2) AS outbound", "edges")
def _(m: Model) -> DataFrame:
    return catalog.domain_detail(m.domains, m.pages, m.jobs, m.boards, m.edges, "navmommavlom.example")["counts"]


@query("I23_companies", "SELECT d.id, host, coalesce(j.n, 0) AS open_jobs, coalesce(p.n, 0) AS pages FROM domains d LEFT JOIN (SELECT domain_id, count(*) AS n FROM jobs WHERE closed_at IS NULL GROUP BY 1) j ON j.domain_id = d.id LEFT JOIN (SELECT domain_id, count(*) AS n FROM parsed_pages GROUP BY 1) p ON p.domain_id = d.id WHERE status = 'company' AND careers_url IS NOT NULL ORDER BY open_jobs DESC, lower(host), d.id LIMIT 50")
def _(m: Model) -> DataFrame:
    return catalog.companies(m.domains, m.jobs, m.pages, status="company", has_careers=True)[1].select("id", "host", "open_jobs", "pages")


@query("I24_search_salary", "WITH c AS (SELECT f.id, salary_usd_annual AS v FROM facts f WHERE closed_at IS NULL AND category IN ('data', 'engineering', 'it')), t AS (SELECT v, row_number() OVER (ORDER BY v DESC) AS k, count(*) OVER () AS n FROM c WHERE v IS NOT NULL) SELECT id FROM c WHERE v >= (SELECT v FROM t WHERE k = greatest(ceil(n * 0.25::DOUBLE), 1)) ORDER BY v DESC, id DESC LIMIT 50", "facts")
def _(m: Model) -> DataFrame:
    q = search.JobQuery(categories=["data", "engineering", "IT"], salary_mode="top_percentile", salary_value=0.25, sort="salary_desc")
    return search.run(m.facts, m.domains, q, NOW)[0].select("id")


_NEAR = """WITH p AS (SELECT lat AS here_lat, lon AS here_lon, 500 / 111.32 AS dy, 500 / (111.32 * greatest(abs(cos(radians(lat))), 0.01)) AS dx FROM places WHERE city = 'Vivvuvval' ORDER BY place_id LIMIT 1),
  c AS (SELECT f.*, coalesce(posted_at, first_seen) AS seen, CASE WHEN lat IS NOT NULL THEN 2 * 6371.0::DOUBLE * asin(sqrt(least(1.0::DOUBLE, pow(sin(radians(lat - here_lat) / 2), 2) + cos(radians(here_lat)) * cos(radians(lat)) * pow(sin(radians(lon - here_lon) / 2), 2)))) END AS km
    FROM facts f, p WHERE closed_at IS NULL AND ((lat BETWEEN greatest(here_lat - dy, -90) AND least(here_lat + dy, 90) AND lon BETWEEN greatest(here_lon - dx, -180) AND least(here_lon + dx, 180)) OR (lat IS NULL AND country_code = 'JP') OR (remote_mode = 'remote' AND (len(remote_regions) = 0 OR list_contains(remote_regions, 'global') OR list_contains(remote_regions, 'JP')))))
  SELECT id, round(km, 1) AS distance_km FROM c WHERE km IS NULL OR km <= 500 ORDER BY seen DESC NULLS LAST, id DESC LIMIT 50"""


@query("I24_search_near", _NEAR, "facts")
def _(m: Model) -> DataFrame:
    q = search.JobQuery(near="Vivvuvval, Japan", radius_km=500, sort="recent")
    return search.run(m.facts, m.domains, q, NOW, places=m.places, placed_only=True)[0].select("id", "distance_km")


_FT = r"""WITH w AS (SELECT id, string_split({t}, ' ') AS a, string_split({d}, ' ') AS b, string_split({s}, ' ') AS c FROM jobs WHERE closed_at IS NULL),
  f AS (SELECT id, 8.0 * len(list_filter(a, lambda x: x = 'engineer')) + len(list_filter(b, lambda x: x = 'engineer')) + 2.0 * len(list_filter(c, lambda x: x = 'engineer')) AS tf, (len(list_filter(a, lambda x: x <> '')) + len(list_filter(b, lambda x: x <> '')) + len(list_filter(c, lambda x: x <> '')))::DOUBLE AS l FROM w),
  g AS (SELECT count(*) AS n, avg(l) AS m, count(*) FILTER (tf > 0) AS df FROM f)
  SELECT id, round(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / m))::DOUBLE, 6) AS relevance FROM f, g WHERE tf > 0""".format(
    **{k: rf"trim(regexp_replace(regexp_replace(strip_accents(lower(coalesce({c}, ''))), '\p{{M}}', '', 'g'), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))" for k, c in (("t", "title"), ("d", "description"), ("s", "skills"))}
)


@query("F4_relevance", _FT)
def _(m: Model) -> DataFrame:
    return _index(m, "open", m.jobs.where("closed_at is null"), ["title", "description", "skills"]).ranked(["Engineer"]).select(F.col("doc_id").alias("id"), F.round("relevance", 6).alias("relevance"))


_INDEXES: dict = {}


def _index(m: Model, name: str, docs: DataFrame, fields: list[str]):
    """A stored index of the session, written when it's first asked for."""
    from heronry.operators.fulltext import TextIndex

    key = (m.spark.sparkContext.applicationId, m.dir, name)
    if key not in _INDEXES:
        _INDEXES[key] = TextIndex(m.spark, f"{checkpoint_dir(m.spark)}/text-{name}-{uuid.uuid4().hex}", {c: F.col(c) for c in fields}).add(docs)
    return _INDEXES[key]


@query("C9_text_hits", "SELECT id FROM jobs WHERE contains(' ' || " + words_sql("coalesce(title, '')") + " || ' ', ' data engineer ') OR contains(' ' || " + words_sql("coalesce(description, '')") + " || ' ', ' data engineer ')")
def _(m: Model) -> DataFrame:
    return m.jobs.join(_index(m, "jobs", m.jobs, ["title", "description"]).hits(["data engineer"]), F.col("id") == F.col("doc_id"), "left_semi").select("id")


@query("I25_browse", "SELECT m.job_id, m.score FROM matches m JOIN facts j ON j.id = m.job_id WHERE profile_id = 3 AND closed_at IS NULL AND m.score >= 0.5 AND salary_usd_annual IS NOT NULL ORDER BY m.score DESC, job_id LIMIT 25", "matches", "facts")
def _(m: Model) -> DataFrame:
    return matching.browse(m.matches, m.facts, m.domains, 3, min_score=0.5, has_salary=True)[1].select("job_id", "score")


@query("I25_facets", "SELECT count(*) AS total, count(*) FILTER (score >= 0.7) AS strong, count(*) FILTER (score >= 0.5) AS good FROM matches JOIN jobs ON id = job_id WHERE profile_id = 3 AND closed_at IS NULL", "matches")
def _(m: Model) -> DataFrame:
    return matching.facets(m.matches, m.jobs, 3)[1]


@query("I26_reboost", "SELECT url, CASE WHEN state IN ('queued', 'deferred') THEN score - profile_boost + 6.0 ELSE score END AS score FROM frontier", "frontier")
def _(m: Model) -> DataFrame:
    return merge.replace_boost(m.frontier, m.frontier.select("url", F.lit(6.0).alias("boost"))).select("url", "score")


@query("I27_digest", "SELECT id, 'host: ' || coalesce(host, '') || chr(10) || 'title: ' || coalesce(title, '') || chr(10) || substring(coalesce(text, ''), 1, 500) AS digest FROM (SELECT p.id, d.host, p.title, p.text FROM parsed_pages p LEFT JOIN domains d ON d.id = p.domain_id)")
def _(m: Model) -> DataFrame:
    e = F.lit("")
    p = m.pages.join(m.domains.select(F.col("id").alias("domain_id"), "host"), "domain_id", "left")
    return p.select("id", F.concat(F.lit("host: "), F.coalesce("host", e), F.lit("\ntitle: "), F.coalesce("title", e), F.lit("\n"), F.substring(F.coalesce("text", e), 1, 500)).alias("digest"))


@query("I28_neighbourhood", "SELECT DISTINCT id FROM (SELECT src_domain_id AS id FROM edges WHERE dst_domain_id = 7 UNION ALL SELECT dst_domain_id FROM edges WHERE src_domain_id = 7 UNION ALL SELECT 7 WHERE EXISTS (SELECT 1 FROM edges WHERE src_domain_id = 7 OR dst_domain_id = 7))", "edges")
def _(m: Model) -> DataFrame:
    return graph.neighbourhood(m.edges, 7)


@query("I29_feed", "SELECT id, kind, CASE kind WHEN 'jobs_found' THEN 'jobs' WHEN 'domain_classified' THEN 'classify' ELSE 'crawler' END AS category FROM log ORDER BY id DESC LIMIT 300", "log")
def _(m: Model) -> DataFrame:
    return timeline.feed(m.log)


# --- J: changes to tables -----------------------------------------------------------------------------------------------


@query("J1_enqueue", "SELECT url, CASE WHEN f.state = 'queued' AND id % 2 = 0 THEN greatest(score, 60.0) ELSE score END AS score, f.state FROM frontier f JOIN (SELECT id, url FROM parsed_pages) p USING (url) UNION ALL SELECT 'new:' || id, 60.0, 'queued' FROM domains", "frontier")
def _(m: Model) -> DataFrame:
    known = m.pages.where("id % 2 = 0").select("url", F.lit(60.0).alias("score"))
    fresh = m.domains.select(F.concat(F.lit("new:"), "id").alias("url"), F.lit(60.0).alias("score"))
    return merge.enqueue(m.frontier, known.unionByName(fresh)).select("url", "score", "state")


@query("J2_states", "SELECT url, CASE WHEN id % 10 = 0 AND attempts + 1 < 2 THEN score / 2 ELSE score END AS score, attempts + (id % 10 = 0)::INT AS attempts, CASE WHEN id % 10 = 0 THEN CASE WHEN attempts + 1 < 2 THEN 'queued' ELSE 'skipped' END ELSE state END AS state FROM frontier JOIN (SELECT id, url FROM parsed_pages) p USING (url)", "frontier")
def _(m: Model) -> DataFrame:
    return merge.retry(m.frontier, m.pages.where("id % 10 = 0").select("url")).select("url", "score", "attempts", "state")


@query("J2_domain_scores", "SELECT url, score + CASE WHEN domain_id = 2 AND state IN ('queued', 'deferred') THEN 10.0 ELSE 0 END AS score, CASE WHEN state = 'in_flight' OR (domain_id = 2 AND state = 'deferred') THEN 'queued' ELSE state END AS state FROM frontier", "frontier")
def _(m: Model) -> DataFrame:
    f = merge.adjust_domain_scores(m.frontier, 2, 10.0)
    return merge.reset_in_flight(merge.revive_deferred(f, 2)).select("url", "score", "state")


_CHANGED = ("title", "location", "department", "salary_min", "salary_max", "salary_currency", "salary_period")


@query("J3_upsert_jobs", "SELECT url, title, coalesce(first_seen, 5) AS first_seen, CASE WHEN k < 8 THEN 5 ELSE last_seen END AS last_seen, CASE WHEN k >= 8 THEN closed_at END AS closed_at, k = 7 AS unchanged, CASE WHEN k < 7 THEN 'pending' ELSE 'done' END AS enrich_state, CASE WHEN k < 7 THEN 0 ELSE 2 END AS enrich_attempts, CASE WHEN k < 7 THEN NULL ELSE country_code END AS country_code, department, salary_max, domain_id FROM (SELECT url, CASE WHEN id % 9 = 0 THEN coalesce(title, '') || ' (new)' ELSE title END AS title, first_seen, last_seen, closed_at, id % 9 AS k, country_code, CASE WHEN id % 9 = 2 THEN 'moved' ELSE department END AS department, CASE WHEN id % 9 = 4 THEN -1.0 ELSE salary_max END AS salary_max, domain_id FROM jobs WHERE url IS NOT NULL) UNION ALL SELECT 'n' || id, 'fresh', 5, 5, NULL, false, 'pending', 0, 'XX', NULL, NULL, NULL FROM domains")
def _(m: Model) -> DataFrame:
    # of each nine postings one has each of the watched fields changed, one is seen unchanged, one isn't seen
    j = m.jobs.where("url is not null").select("id", "url", *_CHANGED, "domain_id", "country_code", "first_seen", "last_seen", "closed_at").withColumns({"enrich_state": F.lit("done"), "enrich_attempts": F.lit(2)})
    to = {"title": F.concat(F.coalesce("title", F.lit("")), F.lit(" (new)")), "location": F.lit("?"), "department": F.lit("moved"), "salary_min": F.lit(-1.0), "salary_max": F.lit(-1.0), "salary_currency": F.lit("?"), "salary_period": F.lit("?")}
    seen = j.where("id % 9 < 8").withColumns({f: F.when(F.col("id") % 9 == k, to[f]).otherwise(F.col(f)) for k, f in enumerate(_CHANGED)}).withColumns({"domain_id": F.lit(None).cast("long"), "country_code": F.lit(None).cast("string")})
    cols = ["url", *_CHANGED, "domain_id", "country_code"]
    new = m.domains.select(F.concat(F.lit("n"), "id").alias("url"), F.lit("fresh").alias("title"), F.lit("XX").alias("country_code"))
    out = merge.upsert_jobs(j.drop("id"), seen.select(*cols).unionByName(new, allowMissingColumns=True), 5)
    return out.select("url", "title", "first_seen", "last_seen", "closed_at", "unchanged", "enrich_state", "enrich_attempts", "country_code", "department", "salary_max", "domain_id")


@query("J4_close_missing", "SELECT id, CASE WHEN board_key = 'jobhub/all' AND closed_at IS NULL AND id % 3 <> 0 THEN 9 ELSE closed_at END AS closed_at FROM jobs")
def _(m: Model) -> DataFrame:
    return merge.close_missing(m.jobs, m.jobs.where("id % 3 = 0"), "jobhub/all", 9).select("id", "closed_at")


@query("J5_boards", "SELECT key, CASE WHEN key LIKE 'lever/%' THEN NULL ELSE coalesce(n.id, b.domain_id) END AS domain_id, CASE WHEN length(key) % 2 = 0 THEN 7 ELSE job_count END AS job_count, CASE WHEN length(key) % 2 = 0 THEN 'ok' END AS last_status FROM (SELECT key, domain_id, job_count FROM boards UNION ALL SELECT 'lever/new' || id, NULL, NULL FROM domains WHERE id <= 5) b LEFT JOIN (SELECT 'lever/new' || id AS k, id FROM domains WHERE id <= 5) n ON n.k = key", "boards")
def _(m: Model) -> DataFrame:
    new = m.domains.where("id <= 5").select(F.concat(F.lit("lever/new"), "id").alias("key"), F.lit("lever").alias("vendor"), F.concat(F.lit("new"), "id").alias("token"), F.col("id").alias("owner"))
    none = F.lit(None)
    b = m.boards.withColumns({"host": none.cast("string"), "last_fetched": none.cast("long"), "last_status": none.cast("string"), "name": none.cast("string")})
    b = boards.ensured(b, new.drop("owner"), 1)
    b, _jobs = boards.attached(b, m.jobs, new.select("key", F.col("owner").alias("domain_id")))
    b = boards.fetched(b, b.where(F.length("key") % 2 == 0).select("key", F.lit("ok").alias("status"), F.lit(7).cast("long").alias("job_count"), none.cast("string").alias("name")), 2)
    b, _domains = boards.detached(b, m.domains.withColumns({"ats": F.lit("lever"), "ats_token": F.lit("x")}), b.where("key like 'lever/%'").select("key"))
    return b.select("key", "domain_id", "job_count", "last_status")


@query("J5_attached_jobs", "SELECT j.id, coalesce(j.domain_id, CASE WHEN b.job_count % 2 = 0 THEN 77 END) AS domain_id FROM jobs j LEFT JOIN boards b ON b.key = j.board_key", "boards")
def _(m: Model) -> DataFrame:
    owners = m.boards.where("job_count % 2 = 0").select("key", F.lit(77).cast("long").alias("domain_id"))
    return boards.attached(m.boards, m.jobs, owners)[1].select("id", "domain_id")


@query("J5_detached_domains", "SELECT id, CASE WHEN id % 3 <> 0 THEN 'lever' END AS ats, CASE WHEN id % 3 = 0 AND id % 2 = 0 THEN NULL ELSE careers_url END AS careers_url FROM (SELECT id, CASE WHEN id % 2 = 0 THEN 'https://jobs.Lever.co/T' || id ELSE 'https://' || host || '/jobs' END AS careers_url FROM domains)")
def _(m: Model) -> DataFrame:
    d = m.domains.select("id", F.lit("lever").alias("ats"), F.concat(F.lit("t"), "id").alias("ats_token"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("https://jobs.Lever.co/T"), "id")).otherwise(F.concat(F.lit("https://"), "host", F.lit("/jobs"))).alias("careers_url"))
    b = d.select(F.concat(F.lit("lever/"), "ats_token").alias("key"), F.lit("lever").alias("vendor"), F.col("ats_token").alias("token"), F.col("id").alias("domain_id"))
    return boards.detached(b, d, b.where("domain_id % 3 = 0").select("key"))[1].select("id", "ats", "careers_url")


@query("J2_visited", "SELECT url, CASE WHEN new THEN 'done' WHEN id % 4 = 0 THEN 'done' WHEN id % 4 = 1 THEN 'skipped' ELSE state END AS state, CASE WHEN new THEN 0.0 ELSE score END AS score, CASE WHEN new OR id % 3 = 0 THEN h ELSE host END AS host, CASE WHEN new THEN 'redirect' END AS reason FROM (SELECT f.url, f.score, f.state, f.host, p.id, false AS new, f.host AS h FROM frontier f JOIN parsed_pages p ON p.url = f.url UNION ALL SELECT url || '?to=1', NULL, NULL, NULL, id, true, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1)) FROM parsed_pages WHERE id % 4 = 0)", "frontier")
def _(m: Model) -> DataFrame:
    p = m.pages.select("url", "id")
    f = m.frontier.join(p, "url").withColumns({"host": F.when(F.col("id") % 3 != 0, F.col("host")), "domain": F.lit(None).cast("string"), "reason": F.lit(None).cast("string")}).drop("id")
    to = p.where("id % 4 = 0").select(F.explode(F.array("url", F.concat("url", F.lit("?to=1")))).alias("url"), U.host("url").alias("host"), U.registrable_domain("url").alias("domain"), F.lit(1).alias("depth"))
    f = merge.mark_visited(merge.set_state(f, p.where("id % 4 = 1").select("url", F.lit("skipped").alias("state"))), to, NOW)
    return merge.backfill_hosts(f).select("url", "state", "score", "host", "reason")


@query("J6_replace_pages", "SELECT id, url, CASE WHEN id % 2 = 0 THEN 'other' ELSE kind END AS kind FROM parsed_pages")
def _(m: Model) -> DataFrame:
    p = m.pages.select("id", "url", "kind")
    return merge.replace(p, p.where("id % 2 = 0").withColumn("kind", F.lit("other")), ["url"])


@query("J10_match_upsert", "SELECT profile_id, job_id, CASE WHEN job_id % 3 = 0 THEN 0.5 ELSE score END AS score, CASE WHEN job_id % 3 = 0 THEN 9 ELSE computed_at END AS computed_at FROM matches WHERE NOT (job_id % 3 <> 0 AND job_id % 5 = 0) UNION ALL SELECT profile_id, -job_id, 0.5, 9 FROM matches WHERE job_id % 3 = 0", "matches")
def _(m: Model) -> DataFrame:
    # every fifth pair isn't stored yet; of the computed ones half are new
    stored = m.matches.where("job_id % 5 <> 0").select("profile_id", "job_id", "score", "computed_at")
    again = m.matches.where("job_id % 3 = 0").select("profile_id", F.explode(F.array("job_id", -F.col("job_id"))).alias("job_id"), F.lit(0.5).alias("score"), F.lit(9).cast("long").alias("computed_at"))
    return merge.replace(stored, again, ["profile_id", "job_id"])


@query("J11_profiles", "WITH p AS (SELECT DISTINCT profile_id AS id FROM job_matches WHERE profile_id IS NOT NULL AND profile_id <> 4) SELECT id, false AS active, CASE WHEN id = 5 THEN 'Renamed' ELSE 'p' || id END AS name, CASE WHEN id = 6 THEN '{}' END AS overrides, CASE WHEN id = 6 THEN 20 WHEN id = 3 THEN 30 ELSE 1 END AS updated_at, CASE WHEN id = 7 THEN 1 END AS matched_at FROM p UNION ALL SELECT -1, true, 'New', NULL, 40, NULL")
def _(m: Model) -> DataFrame:
    none = F.lit(None)
    p = m.job_matches.where("profile_id is not null").select(F.col("profile_id").alias("id")).distinct()
    p = p.withColumns({"active": F.lit(False), "name": F.concat(F.lit("p"), "id"), "overrides": none.cast("string"), "updated_at": F.lit(1), "matched_at": none.cast("int")})
    p = merge.override_profile(merge.rename_profile(merge.delete_cascade(p, m.matches, 4)[0], 5, "Renamed"), 6, "{}", 20)
    p = merge.mark_matched(merge.activate(p, 3, 30), 7, 1)
    new = m.spark.range(1).select(F.lit(-1).cast("long").alias("id"), F.lit("New").alias("name"))
    return merge.insert_profile(p, new, 40).select("id", "active", "name", "overrides", "updated_at", "matched_at")


@query("J12_enrich_write", "SELECT id, CASE WHEN id % 2 = 0 THEN 'x' ELSE category END AS category, CASE WHEN id % 2 <> 0 THEN skills END AS skills, CASE WHEN id % 2 = 0 THEN 1.5 END AS lat, CASE WHEN id % 2 = 0 THEN 9.0 END AS salary_usd_annual, CASE WHEN id % 6 = 0 THEN 'rules' WHEN id % 2 = 0 THEN 'done' ELSE 'pending' END AS enrich_state, CASE WHEN id % 6 = 0 THEN 2 ELSE 1 END AS enrich_attempts FROM jobs")
def _(m: Model) -> DataFrame:
    none = {f: F.lit(None) for f in ("city", "region", "remote_regions")} | {f: F.lit(None).cast("double") for f in ("lat", "lon", "salary_annual_min", "salary_annual_max", "salary_usd_annual")}
    j = m.jobs.withColumns(none | {"enrich_state": F.lit("pending"), "enrich_attempts": F.lit(1)})
    values = {f: F.lit(None).cast(j.schema[f].dataType) for f in merge.ENRICHED} | {"category": F.lit("x"), "lat": F.lit(1.5), "salary_usd_annual": F.lit(9.0)}
    r = j.where("id % 2 = 0").select("id", *[v.alias(f) for f, v in values.items()], F.when(F.col("id") % 3 == 0, "rules").otherwise("done").alias("state"), (F.col("id") % 3 == 0).alias("counts"))
    return merge.write_enrichment(j, r).select("id", "category", "skills", "lat", "salary_usd_annual", "enrich_state", "enrich_attempts")


@query("J13_submitted", f"SELECT id, command FROM (SELECT id, CASE id % 3 WHEN 0 THEN 'pause' WHEN 1 THEN 'stop' END AS command FROM log WHERE id % 5 <> 0 UNION ALL SELECT max(id) + 1, 'resume' FROM log) ORDER BY id DESC LIMIT 100000", "log")
def _(m: Model) -> DataFrame:
    c = m.log.select("id", "ts", F.when(F.col("id") % 3 == 0, "pause").when(F.col("id") % 3 == 1, "stop").otherwise("dance").alias("command"), F.when(F.col("id") % 5 == 0, "done").otherwise("pending").alias("status"))
    return merge.pending(merge.submit(c, "resume", NOW), 100_000)


@query("J6_record_links", r"""WITH l AS (SELECT p.id, d.host, p.kind, t.k, CASE WHEN t.k % 3 = 0 THEN d.host WHEN t.k % 3 = 1 THEN 'to' || (p.id % 7) || '.example' END AS target FROM parsed_pages p JOIN domains d ON d.id = p.domain_id, range(0, 4) t(k))
  SELECT 'edge' AS what, host AS a, target AS b, CAST(count(*) AS BIGINT) AS n FROM l WHERE target <> host GROUP BY host, target
  UNION ALL SELECT 'link', CAST(id AS VARCHAR), NULL, 3 FROM (SELECT DISTINCT id FROM l) UNION ALL SELECT 'queued', 'https://x.example/' || (id % 50), NULL, max(id) FROM l GROUP BY id % 50
  UNION ALL SELECT 'domain', host, NULL, 1 FROM (SELECT host FROM domains UNION SELECT target FROM l WHERE target IS NOT NULL)""")
def _(m: Model) -> DataFrame:
    # four links a page: to itself and to a queued page, to another site, to nothing, and the first again
    own = F.concat(F.lit("https://x.example/"), F.col("id") % 50)
    link = lambda u, target, score: F.struct(u.alias("url"), F.lit("go").alias("text"), target.alias("target"), score.alias("score"))
    none = F.lit(None).cast("double")
    other, host = F.concat(F.lit("to"), F.col("id") % 7, F.lit(".example")), F.col("domain")
    links = F.array(link(own, host, F.col("id").cast("double")), link(F.concat(F.lit("https://"), other), other, none), link(F.lit("https://blocked/"), F.lit(None).cast("string"), none), link(own, host, none))
    d = m.domains.select("id", "host")
    pages = m.pages.join(d.select(F.col("id").alias("domain_id"), F.col("host").alias("domain")), "domain_id").select(F.col("id").alias("page_id"), "domain", F.lit(0).alias("depth"), links.alias("links"))
    empty = lambda schema: m.spark.createDataFrame([], schema)
    doms, found, edges, queue = visits.record_links(pages, d, empty("src_page_id long, dst_url string, anchor string, link_score double"), empty("src_domain_id long, dst_domain_id long, weight long, first_seen int"), empty("url string, score double, depth int, state string"), 1)
    names = lambda side: doms.select(F.col("id").alias(f"{side}_domain_id"), F.col("host").alias(side))
    no = F.lit(None).cast("string")
    out = edges.join(names("src"), "src_domain_id").join(names("dst"), "dst_domain_id").select(F.lit("edge").alias("what"), F.col("src").alias("a"), F.col("dst").alias("b"), F.col("weight").alias("n"))
    out = out.unionByName(found.groupBy("src_page_id").agg(F.count("*").alias("n")).select(F.lit("link").alias("what"), F.col("src_page_id").cast("string").alias("a"), no.alias("b"), "n"))
    out = out.unionByName(queue.select(F.lit("queued").alias("what"), F.col("url").alias("a"), no.alias("b"), F.col("score").cast("long").alias("n")))
    return out.unionByName(doms.select(F.lit("domain").alias("what"), F.col("host").alias("a"), no.alias("b"), F.lit(1).cast("long").alias("n")))


@query("J13_control", f"SELECT id, CASE WHEN id % 5 = 0 THEN 'done' WHEN ts < {T0} THEN 'expired' ELSE 'pending' END AS status FROM log", "log")
def _(m: Model) -> DataFrame:
    c = m.log.select("id", "ts", F.lit("pending").alias("status"))
    return merge.control(c, T0, c.where("id % 5 = 0").withColumn("status", F.lit("done"))).select("id", "status")


@query("J14_text_index", r"SELECT field, term, count(*) AS n FROM (SELECT 'title' AS field, unnest(string_split(trim(regexp_replace(regexp_replace(strip_accents(lower(coalesce(title, ''))), '\p{M}', '', 'g'), '[^\p{L}\p{N}]+', ' ', 'g')), ' ')) AS term FROM jobs WHERE id % 11 <> 0 UNION ALL SELECT 'description', unnest(string_split(trim(regexp_replace(regexp_replace(strip_accents(lower(coalesce(description, ''))), '\p{M}', '', 'g'), '[^\p{L}\p{N}]+', ' ', 'g')), ' ')) FROM jobs WHERE id % 11 <> 0) WHERE term <> '' GROUP BY field, term")
def _(m: Model) -> DataFrame:
    from heronry.operators.fulltext import TextIndex

    # each seventh posting is inserted later, each third changed, each eleventh deleted
    j = m.jobs.select("id", "title", "description")
    first = j.where("id % 7 <> 0").withColumn("title", F.when(F.col("id") % 3 == 0, "old words").otherwise(F.col("title")))
    index = TextIndex(m.spark, f"{checkpoint_dir(m.spark)}/text-changes-{uuid.uuid4().hex}", {c: F.col(c) for c in ("title", "description")}).add(first)
    index.add(j.where("id % 7 = 0")).add(j.where("id % 3 = 0"), j.where("id % 11 = 0")).add(j.limit(0), j.where("id % 11 = 0"))
    return index.postings().groupBy("field", "term").agg(F.sum(F.size("at")).alias("n"))


__all__ = ["QUERIES", "SQL", "pair_runs"]
