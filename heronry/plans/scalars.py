"""Scalar functions over whole tables (inventory H)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronry.functions import measures as N
from heronry.functions import text as T
from heronry.functions import urls as U
from heronry.functions.enrich import REGIONS
from heronry.plans.model import NOW, Model, first_match_sql, has_word_sql, registry, words_sql

QUERIES, SQL, query = registry()
_SIMPLE = r"lower(regexp_replace({}, '[^\p{{L}}\p{{N}}]', '', 'g'))"
_HOST = r"nullif(lower(regexp_extract({}, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)', 1)), '')"
_PATH = r"regexp_extract({}, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
_SEGS = "list_filter(string_split(lower(" + _PATH + "), '/'), lambda s: s <> '')"


@query("H1_words", f"SELECT id, {words_sql('title')} AS w FROM jobs")
def _(m: Model) -> DataFrame:
    return m.jobs.select("id", T.words("title").alias("w"))


@query("H2_has_word", f"SELECT id, {has_word_sql(words_sql('title'), 'manager')} AS long, {has_word_sql(words_sql('title'), 'it')} AS short, {has_word_sql(words_sql('title'), 'store manager')} AS phrase FROM jobs WHERE title IS NOT NULL")
def _(m: Model) -> DataFrame:
    w = T.words("title")
    return m.jobs.where("title is not null").select("id", T.has_word(w, "manager").alias("long"), T.has_word(w, "it").alias("short"), T.has_word(w, "store manager").alias("phrase"))


@query("H3_skill_words", r"SELECT id, trim(regexp_replace(regexp_replace(trim(regexp_replace(lower(coalesce(description, '')), '[^\p{L}\p{N}+#.]+', ' ', 'g')), '\.+( |$)', ' ', 'g'), ' +', ' ', 'g')) AS w FROM jobs")
def _(m: Model) -> DataFrame:
    return m.jobs.select("id", T.skill_words("description").alias("w"))


@query("H4_fold", r"SELECT id, lower(trim(regexp_replace(location, '\s+', ' ', 'g'))) AS f FROM jobs")
def _(m: Model) -> DataFrame:
    return m.jobs.select("id", T.fold("location").alias("f"))


@query("H5_simplify", f"SELECT id, {_SIMPLE.format('company')} AS s FROM jobs")
def _(m: Model) -> DataFrame:
    return m.jobs.select("id", T.simplify("company").alias("s"))


@query("H6_title_case", "SELECT place_id, array_to_string(list_transform(string_split(lower(country_name), ' '), lambda w: upper(w[1:1]) || w[2:]), ' ') AS t FROM places")
def _(m: Model) -> DataFrame:
    return m.places.select("place_id", T.title_case(F.lower("country_name")).alias("t"))


@query("H7_match_rank", "SELECT place_id, CASE WHEN lower(city) = 'port' THEN 0 WHEN starts_with(lower(city), 'port') THEN 1 WHEN contains(lower(city), ' port') THEN 2 END AS rank FROM places")
def _(m: Model) -> DataFrame:
    return m.places.select("place_id", T.match_rank(F.lower("city"), F.lit("port")).alias("rank"))


@query("H8_one_of", "SELECT id, CASE WHEN translate(lower(trim(industry)), ' -', '__') IN ('health_care', 'energy', 'software', 'retail') THEN translate(lower(trim(industry)), ' -', '__') END AS v FROM domains")
def _(m: Model) -> DataFrame:
    return m.domains.select("id", T.one_of("industry", ("health_care", "energy", "software", "retail")).alias("v"))


@query("H9_clean", "SELECT id, nullif(trim(location, ' '), '') AS c FROM jobs")
def _(m: Model) -> DataFrame:
    return m.jobs.select("id", T.clean("location").alias("c"))


@query("H10_truncate", "SELECT doc_id, substring(text, 1, 80) AS t FROM documents")
def _(m: Model) -> DataFrame:
    return m.documents.select("doc_id", T.truncate("text", 80).alias("t"))


@query("H11_employment_type", """SELECT id, CASE WHEN k = '' THEN NULL WHEN k IN ('fulltime', 'permanent') THEN 'full_time' WHEN k = 'parttime' THEN 'part_time' WHEN k IN ('contract', 'contractor', 'freelance') THEN 'contract' WHEN k IN ('intern', 'internship') THEN 'internship'
  WHEN k IN ('temporary', 'temp', 'fixedterm') THEN 'temporary' WHEN k = 'volunteer' THEN 'volunteer' ELSE translate(lower(trim(employment_type)), ' -', '__') END AS t FROM (SELECT *, lower(regexp_replace(employment_type, '[^a-zA-Z0-9]', '', 'g')) AS k FROM jobs)""")  # fmt: skip
def _(m: Model) -> DataFrame:
    return m.jobs.select("id", T.employment_type("employment_type").alias("t"))


@query("H12_remote_mode", f"SELECT id, CASE WHEN k IN ('remote', 'telecommute', 'fullyremote') THEN 'remote' WHEN k = 'hybrid' THEN 'hybrid' WHEN k IN ('onsite', 'inoffice', 'office', 'inperson') THEN 'onsite' END AS mode FROM (SELECT id, {_SIMPLE.format('remote_mode')} AS k FROM jobs)")
def _(m: Model) -> DataFrame:
    return m.jobs.select("id", T.remote_mode("remote_mode").alias("mode"))


@query("H13_salary_period", "SELECT id, CASE WHEN p LIKE '%year%' THEN 'year' WHEN p LIKE '%annual%' THEN 'year' WHEN p LIKE '%month%' THEN 'month' WHEN p LIKE '%week%' THEN 'week' WHEN p LIKE '%day%' THEN 'day' WHEN p LIKE '%hour%' THEN 'hour' END AS p FROM (SELECT id, lower(salary_period) AS p FROM jobs)")
def _(m: Model) -> DataFrame:
    return m.jobs.select("id", T.salary_period("salary_period").alias("p"))


@query("H14_html_to_text")
def _(m: Model) -> DataFrame:
    from heronry.sources.boards import plain_html

    return m.jobs.select("id", plain_html(F.col("description")).alias("text"))


@query("H15_phrases", "SELECT id, contains(' ' || " + words_sql("coalesce(title, '')") + " || ' ', ' ' || " + words_sql("coalesce(department, '')") + " || ' ') AS hit, " + words_sql("'«C++ & Data--Engineer»'") + " AS phrase FROM jobs WHERE department IS NOT NULL AND " + words_sql("department") + " <> ''")
def _(m: Model) -> DataFrame:
    from heronry.operators.fulltext import has_phrase, phrase

    j = m.jobs.where(F.col("department").isNotNull() & (T.words("department") != ""))
    return j.select("id", has_phrase(F.col("title"), F.col("department")).alias("hit"), F.lit(phrase("«C++ & Data--Engineer»")).alias("phrase"))


@query("H16_tokenizer", r"SELECT doc_id, trim(regexp_replace(regexp_replace(strip_accents(lower(text)), '\p{M}', '', 'g'), '[^\p{L}\p{N}]+', ' ', 'g')) AS t FROM documents")
def _(m: Model) -> DataFrame:
    from heronry.operators.fulltext import normalized

    return m.documents.select("doc_id", normalized(F.col("text")).alias("t"))


@query("H18_content_hash", "SELECT id, sha256(text)[1:32] AS h FROM parsed_pages")
def _(m: Model) -> DataFrame:
    return m.pages.select("id", T.content_hash("text").alias("h"))


@query("H19_page_label", rf"SELECT id, CASE WHEN p IN ('', '/') AND q = '' THEN {_HOST.format('url')} WHEN q = '' THEN p ELSE (CASE WHEN p = '' THEN '/' ELSE p END) || '?' || q END AS label FROM (SELECT id, url, {_PATH.format('url')} AS p, regexp_extract(url, '\?([^#]*)', 1) AS q FROM parsed_pages)")
def _(m: Model) -> DataFrame:
    return m.pages.select("id", U.page_label("url").alias("label"))


_TRACK = ", ".join(f"'{t}'" for t in U.TRACKING)


@query("H21_normalize_url", rf"""SELECT id, lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) || '://' || {_HOST.format('url')} || CASE WHEN p = '' THEN '/' ELSE p END || CASE WHEN len(l) > 0 THEN '?' || array_to_string(list_sort(l), '&') ELSE '' END AS n
  FROM (SELECT id, url, regexp_replace({_PATH.format('url')}, '(?i);jsessionid=.*$', '') AS p,
    list_transform(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda x: x <> '' AND lower(split_part(x, '=', 1)) NOT IN ({_TRACK}) AND NOT starts_with(lower(x), 'utm_')), lambda x: CASE WHEN contains(x, '=') THEN x ELSE x || '=' END) AS l FROM parsed_pages)""")  # fmt: skip
def _(m: Model) -> DataFrame:
    return m.pages.select("id", U.normalize("url").alias("n"))


@query("H22_resolve", rf"SELECT id, regexp_extract(url, '^[a-z]+://[^/]*', 0) || '/about/team' AS u, regexp_extract(url, '^[a-z]+://[^/]*', 0) || '/about/?a=..' AS deep FROM parsed_pages")
def _(m: Model) -> DataFrame:
    return m.pages.select("id", U.resolve("url", F.lit(" /about/x/../team#top")).alias("u"), U.resolve("url", F.lit("a/b/c/d/e/f/" + "../" * 12 + "./x/%2E%2e/about/y/..?a=..")).alias("deep"))


@query("H23_registrable_domain", rf"SELECT id, array_to_string(string_split({_HOST.format('url')}, '.')[-2:], '.') AS d FROM jobs")
def _(m: Model) -> DataFrame:
    return m.jobs.select("id", U.registrable_domain("url").alias("d"))


@query("H24_host_key", rf"SELECT id, {_HOST.format('url')} AS h FROM jobs")
def _(m: Model) -> DataFrame:
    return m.jobs.select("id", U.host_key("url").alias("h"))


_BOARDS = "(VALUES (1, 'https://jobs.lever.co/Acme/123'), (2, 'https://boards.greenhouse.io/embed/job_board/js?for=Beta'), (3, 'https://gamma.wd5.myworkdayjobs.com/x'), (4, 'https://www.bamboohr.com/'), (5, 'https://acme.com/jobs'), (6, 'https://jobs.ashbyhq.com/'))"


@query("H25_board", f"SELECT i, CASE i WHEN 1 THEN 'lever/acme' WHEN 2 THEN 'greenhouse/beta' WHEN 3 THEN 'workday/gamma' END AS key FROM {_BOARDS} t(i, u)")
def _(m: Model) -> DataFrame:
    return m.spark.sql(f"SELECT * FROM VALUES {_BOARDS[8:-1]} AS t(i, u)").select("i", U.board_key("u").alias("key"))


@query("H26_board_matches", rf"SELECT key, domain_id, contains(t, l) OR contains(l, t) AS same FROM (SELECT b.key, b.domain_id, {_SIMPLE.format('b.token')} AS t, {_SIMPLE.format("split_part(d.host, '.', 1)")} AS l FROM boards b JOIN domains d ON d.id = b.domain_id)", "boards")
def _(m: Model) -> DataFrame:
    return m.boards.join(m.domains.select(F.col("id").alias("domain_id"), "host"), "domain_id").select("key", "domain_id", U.matches_domain("token", "host").alias("same"))


@query("H27_budget_key", rf"SELECT id, array_to_string(string_split({_HOST.format('url')}, '.')[-2:], '.') AS budget FROM jobs")
def _(m: Model) -> DataFrame:
    return m.jobs.select("id", U.budget_key("url").alias("budget"))


@query("H28_careers_page", rf"""SELECT id, (len(s) <= 3 AND len(list_filter(s, lambda x: regexp_matches(x, '[0-9]{{5}}'))) = 0 AND (len(list_filter(s, lambda x: x IN ({", ".join(f"'{c}'" for c in U.CAREERS_TOKENS)}) OR len(list_intersect(regexp_split_to_array(x, '[-_.]'), ['careers', 'career', 'jobs', 'hiring', 'vacancies'])) > 0)) > 0
  OR split_part(h, '.', 1) IN ('careers', 'jobs'))) AS careers FROM (SELECT id, {_SEGS.format('url')} AS s, {_HOST.format('url')} AS h FROM jobs)""")  # fmt: skip
def _(m: Model) -> DataFrame:
    return m.jobs.select("id", U.is_careers_page("url", U.registrable_domain("url")).alias("careers"))


@query("H29_careers_match", "SELECT id, " + " OR ".join(f"contains(lower(coalesce(a, '')), '{p.replace(chr(39), chr(39) * 2)}')" for p in U.CAREERS_PHRASES) + " AS in_anchor FROM (SELECT id, CASE id % 3 WHEN 0 THEN 'See ' || upper(['career', 'jobs', 'job openings', 'join us', 'join our team', 'we''re hiring', 'we are hiring', 'work with us', 'open roles', 'open positions', 'vacancies', 'karriere'][id % 12 + 1]) || '!' ELSE title END AS a FROM parsed_pages)")
def _(m: Model) -> DataFrame:
    said = F.concat(F.lit("See "), F.upper(F.element_at(F.array(*map(F.lit, U.CAREERS_PHRASES)), (F.col("id") % 12 + 1).cast("int"))), F.lit("!"))
    return m.pages.select("id", U.careers_match("url", F.when(F.col("id") % 3 == 0, said).otherwise(F.col("title")))["in_anchor"].alias("in_anchor"))


@query("H30_probe_urls", "SELECT id, CASE id % 3 WHEN 0 THEN 'https://www.' || host || '/' WHEN 1 THEN 'https://' || host || ':8443/' ELSE 'https://' || host || '/' END AS home, [home || 'careers', home || 'jobs', 'https://careers.' || host || '/'] AS probes, id % 3 = 0 AS is_home, id % 2 = 0 AS better FROM domains")
def _(m: Model) -> DataFrame:
    # pages on www., on a port, and on another host of the domain
    page = F.when(F.col("id") % 3 == 0, F.concat(F.lit("https://www."), "host", F.lit("/"))).when(F.col("id") % 3 == 1, F.concat(F.lit("https://"), "host", F.lit(":8443/x?y=1"))).otherwise(F.concat(F.lit("https://blog."), "host", F.lit("/z")))
    other = F.concat(F.lit("https://"), "host", F.when(F.col("id") % 2 == 0, "/careers").otherwise("/a/careers"))
    better = U.is_better_careers_url(F.concat(F.lit("https://"), "host", F.lit("/careers/team")), other)
    return m.domains.withColumn("u", page).select("id", U.main_home_url("u", "host").alias("home"), U.probe_urls("u", "host").alias("probes"), U.is_main_home("u", "host").alias("is_home"), better.alias("better"))


@query("H31_blocked", "SELECT i, i IN (1, 2, 4) AS blocked FROM (VALUES (1), (2), (3), (4)) t(i)")
def _(m: Model) -> DataFrame:
    v = m.spark.sql("SELECT * FROM VALUES (1, 'https://www.linkedin.com/a'), (2, 'https://de.indeed.co.uk/x'), (3, 'https://acme.com/'), (4, 'https://play.google.com/store') AS t(i, u)")
    return v.select("i", U.is_blocked("u").alias("blocked"))


@query("H32_parse_datetime", "SELECT id, CAST(first_seen - first_seen % 1000 AS BIGINT) AS a, CAST(first_seen // 86400000 * 86400000 AS BIGINT) AS b, CAST(NULL AS BIGINT) AS c FROM jobs WHERE first_seen IS NOT NULL")
def _(m: Model) -> DataFrame:
    t = F.timestamp_millis("first_seen")
    rfc, day = F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.date_format(t, "yyyy-MM-dd")
    return m.jobs.where("first_seen is not null").select("id", N.datetime_ms(rfc).alias("a"), N.datetime_ms(F.concat(day, F.lit(" (posted)"))).alias("b"), N.datetime_ms(F.lit("soon")).alias("c"))


@query("H34_bucket_start", "SELECT id, 1704067200000 + (ts - 1704067200000) // 7200000 * 7200000 AS bucket FROM log WHERE ts >= 1704067200000", "log")
def _(m: Model) -> DataFrame:
    return m.log.where("ts >= 1704067200000").select("id", N.bucket_start("ts", 1_704_067_200_000, 7_200_000).cast("long").alias("bucket"))


_KM = "CASE WHEN lat IS NOT NULL THEN 2 * 6371.0::DOUBLE * asin(sqrt(least(1.0::DOUBLE, pow(sin(radians(lat - 6.45) / 2), 2) + cos(radians(6.45::DOUBLE)) * cos(radians(lat)) * pow(sin(radians(lon - 3.39) / 2), 2)))) END"


@query("H37_distance", f"SELECT place_id, round({_KM}, 4) AS km FROM places")
def _(m: Model) -> DataFrame:
    return m.places.select("place_id", F.round(N.distance_km(F.lit(6.45), F.lit(3.39), F.col("lat"), F.col("lon")), 4).alias("km"))


@query("H38_bbox", f"SELECT count(*) AS missed FROM places WHERE {_KM} <= 2000 AND NOT (lat BETWEEN {N.bbox(6.45, 3.39, 2000)[0]!r} AND {N.bbox(6.45, 3.39, 2000)[1]!r} AND lon BETWEEN {N.bbox(6.45, 3.39, 2000)[2]!r} AND {N.bbox(6.45, 3.39, 2000)[3]!r})")
def _(m: Model) -> DataFrame:
    from heronry.operators.filters import in_box

    km = N.distance_km(F.lit(6.45), F.lit(3.39), F.col("lat"), F.col("lon"))
    return m.places.where((km <= 2000) & ~in_box("lat", "lon", N.bbox(6.45, 3.39, 2000))).agg(F.count("*").alias("missed"))


@query("H39_annualize", "SELECT id, CASE WHEN salary_min > 0 THEN salary_min * CASE WHEN salary_period IS NULL THEN CASE WHEN salary_min < 1000 THEN 2080 ELSE 1 END WHEN salary_period = 'year' THEN 1 WHEN salary_period = 'month' THEN 12 WHEN salary_period = 'week' THEN 52 WHEN salary_period = 'day' THEN 260 WHEN salary_period = 'hour' THEN 2080 END END AS a FROM jobs")
def _(m: Model) -> DataFrame:
    return m.jobs.select("id", N.annualize("salary_min", "salary_period").alias("a"))


@query("H40_to_usd", "SELECT id, round(salary_max * (map {" + ", ".join(f"'{k}': {v}::DOUBLE" for k, v in N.USD_PER_UNIT.items()) + "})[upper(trim(salary_currency))], 6) AS usd FROM jobs")
def _(m: Model) -> DataFrame:
    return m.jobs.select("id", F.round(N.to_usd(F.col("salary_max"), "salary_currency"), 6).alias("usd"))


@query("H41_normalized_pay", "SELECT id, round(salary_usd_annual, 4) AS usd FROM facts", "facts")
def _(m: Model) -> DataFrame:
    return m.facts.select("id", F.round("salary_usd_annual", 4).alias("usd"))


@query("H42_per_second", "SELECT id, CASE WHEN last_seen > first_seen THEN round(greatest(salary_max - salary_min, 0) / ((last_seen - first_seen) / 1000.0::DOUBLE), 9) END AS r FROM jobs WHERE salary_min IS NOT NULL AND salary_max IS NOT NULL")
def _(m: Model) -> DataFrame:
    return m.jobs.where("salary_min is not null and salary_max is not null").select("id", F.round(N.per_second(F.col("salary_min"), F.col("salary_max"), F.col("last_seen") - F.col("first_seen")), 9).alias("r"))


@query("H43_yield_points", "SELECT id, CAST(least(greatest(id % 9 - 2, 0) * 2, 10) AS DOUBLE) AS points FROM jobs")
def _(m: Model) -> DataFrame:
    return m.jobs.select("id", N.yield_points(F.col("id") % 9 - 2).alias("points"))


@query("H44_node_size", "SELECT dst_domain_id AS id, round(1 + log2(1 + count(*)), 9) AS size FROM edges GROUP BY 1", "edges")
def _(m: Model) -> DataFrame:
    return m.edges.groupBy(F.col("dst_domain_id").alias("id")).agg(F.count("*").alias("n")).select("id", F.round(N.node_size("n"), 9).alias("size"))


@query("H45_rounded_distance", f"SELECT place_id, round({_KM}, 1) AS km FROM places")
def _(m: Model) -> DataFrame:
    return m.places.select("place_id", F.round(N.distance_km(F.lit(6.45), F.lit(3.39), F.col("lat"), F.col("lon")), 1).alias("km"))


@query("H46_seniority_gap", "SELECT id, (CASE abs(r - 3) WHEN 0 THEN 1.0 WHEN 1 THEN 0.8 WHEN 2 THEN 0.35 ELSE CASE WHEN r IS NOT NULL THEN 0.1 END END)::DOUBLE AS s FROM (SELECT id, (map {'intern': 0, 'junior': 1, 'mid': 2, 'senior': 3, 'lead': 4, 'manager': 4, 'director': 5, 'executive': 6})[seniority] AS r FROM jobs)")
def _(m: Model) -> DataFrame:
    return m.jobs.select("id", N.seniority_gap(F.lit("senior"), F.coalesce("seniority", F.lit(""))).alias("s"))


@query("H47_json_each", "SELECT id, unnest(CAST(from_json(score_reasons, '[\"VARCHAR\"]') AS VARCHAR[])) AS reason FROM domains WHERE json_valid(score_reasons)")
def _(m: Model) -> DataFrame:
    return m.domains.select("id", F.explode(T.json_list("score_reasons")).alias("reason"))


@query("H48_json_field", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def _(m: Model) -> DataFrame:
    return m.events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("H49_json_or_default", "SELECT id, coalesce(CASE WHEN json_valid(skills) THEN len(CAST(from_json(skills, '[\"VARCHAR\"]') AS VARCHAR[])) END, 0)::INT AS n FROM jobs")
def _(m: Model) -> DataFrame:
    return m.jobs.select("id", F.size(T.json_list("skills")).alias("n"))


@query("H52_merged_fields", f"SELECT a.id, coalesce(b.title, a.title) AS title, coalesce(b.location, a.location) AS location FROM jobs a LEFT JOIN jobs b ON b.id = a.id + 1")
def _(m: Model) -> DataFrame:
    a, b = m.jobs.alias("a"), m.jobs.alias("b")
    return a.join(b, F.col("b.id") == F.col("a.id") + 1, "left").select("a.id", F.coalesce("b.title", "a.title").alias("title"), F.coalesce("b.location", "a.location").alias("location"))


_REGION = "CASE v " + " ".join(f"WHEN '{w}' THEN '{name}'" for w, name in REGIONS) + " ELSE CASE WHEN regexp_matches(v, '^[a-z]{2}$') THEN upper(v) END END"


@query("H54_regions", f"SELECT id, {_REGION} AS region FROM (SELECT id, lower(trim(location, ' ')) AS v FROM jobs)")
def _(m: Model) -> DataFrame:
    from heronry.functions.enrich import remote_region

    return m.jobs.select("id", remote_region("location").alias("region"))


__all__ = ["NOW", "QUERIES", "SQL", "first_match_sql"]
