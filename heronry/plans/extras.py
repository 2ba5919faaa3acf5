"""Queries of the inventory's remaining operators: bytes, sitemaps, robots, driver-side rules, answers, visits and sinks."""

from __future__ import annotations

import gzip
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronry.functions import cv
from heronry.functions import measures as N
from heronry.functions import text as T
from heronry.operators import answers, search, visits
from heronry.plans.domain import _FOLD, assessments
from heronry.plans.model import NOW, Model, registry
from heronry.session import checkpoint_dir, shipped
from heronry.sources import files as S
from heronry.sources import pages as H
from heronry.streaming.live import lagged

QUERIES, SQL, query = registry()


def _values(m: Model, rows: list[tuple], schema: str) -> DataFrame:
    return m.spark.createDataFrame(rows, schema)


@query("A1_tables", "SELECT 'jobs' AS name, count(*) AS columns FROM (DESCRIBE jobs) UNION ALL SELECT 'domains', count(*) FROM (DESCRIBE domains) UNION ALL SELECT 'parsed_pages', count(*) FROM (DESCRIBE parsed_pages)")
def _(m: Model) -> DataFrame:
    return _values(m, [(n, len(m.table(n).columns)) for n in ("jobs", "domains", "parsed_pages")], "name string, columns long")


def _packed(m: Model) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "body": [gzip.compress((t or "").encode()) for t in b["text"]], "encoding": "gzip", "content_type": "text/html; charset=utf-8"})

    return m.pages.select("id", "text").transform(shipped).mapInPandas(run, "id long, body binary, encoding string, content_type string")


@query("A4_decompress", "SELECT id, CASE WHEN octet_length(encode(coalesce(text, ''))) <= 1500 THEN md5(coalesce(text, '')) END AS h FROM parsed_pages")
def _(m: Model) -> DataFrame:
    return H.decode_bodies(_packed(m), 1500).select("id", F.md5("html").alias("h"))


@query("A5_decode", "SELECT id, md5(coalesce(text, '')) AS h FROM parsed_pages")
def _(m: Model) -> DataFrame:
    return H.decode_bodies(_packed(m)).select("id", F.md5("html").alias("h"))


@query("A14_sitemap_discovery", "SELECT unnest(['https://a.example/careers', 'https://a.example/careers/eng', 'https://a.example/jobs/team']) AS url")
def _(m: Model) -> DataFrame:
    loc = lambda *u: "".join(f"<loc>{x}</loc>" for x in u)
    maps = [
        ("https://a.example/sitemap.xml", "<sitemapindex>" + loc("https://a.example/posts.xml", "https://a.example/jobs.xml", "https://a.example/page.xml", "https://a.example/z.xml"), True),
        ("https://a.example/jobs.xml", loc("https://a.example/careers/eng", "https://a.example/jobs/12345"), False), ("https://a.example/page.xml", loc("https://a.example/careers", "https://a.example/about", "https://a.example/jobs/team"), False), ("https://a.example/z.xml", loc("https://a.example/jobs"), False),
    ]
    return S.discover(_values(m, maps, "url string, xml string, root boolean"), "a.example")


@query("A15_robots", "SELECT id, CASE WHEN http_status >= 500 OR http_status IS NULL THEN false WHEN http_status >= 400 THEN true ELSE NOT contains(url, '/job/') END AS allowed FROM parsed_pages")
def _(m: Model) -> DataFrame:
    from heronry.functions.urls import path

    rules = F.lit("User-agent: *\nDisallow: /job/\nDisallow: /jobs/none\nAllow: /")
    df = m.pages.select("id", path("url").alias("path"), F.col("http_status").alias("status"), rules.alias("robots"))
    return S.robots_filter(df, "heron").select("id", "allowed")


_BLANK = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{1C}-\x{1F}\x0B]"


@query("A17_cv_text", rf"""SELECT doc_id, CASE WHEN n >= 40 THEN length(t) END AS chars, CASE WHEN n < 40 THEN 'there is too little text' END AS refused FROM (SELECT doc_id, t, length(regexp_replace(t, '{_BLANK}', '', 'g')) AS n
  FROM (SELECT doc_id, regexp_replace(regexp_replace(array_to_string(list_transform(string_split(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), lambda x: regexp_replace(regexp_replace(x, '{_BLANK}+', ' ', 'g'), '^ | $', '', 'g')), chr(10)), '^\n+|\n+$', '', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g') AS t FROM documents))""")
def _(m: Model) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, t in zip(b["doc_id"], b["text"]):
                try:
                    out.append((i, len(S.cv_text((t or "").encode())), None))
                except ValueError as e:
                    out.append((i, None, str(e)))
            got = pd.DataFrame(out, columns=["doc_id", "chars", "refused"])
            yield got.astype({"chars": "Int64"})

    return m.documents.select("doc_id", "text").transform(shipped).mapInPandas(run, "doc_id long, chars long, refused string")


@query("A18_append_events", "SELECT id, ts, kind FROM log", "log")
def _(m: Model) -> DataFrame:
    folder = f"{checkpoint_dir(m.spark)}/events-{uuid.uuid4().hex}"
    rows = m.log.select("id", "ts", "kind")
    visits.append(rows.where("id % 2 = 0"), folder)
    visits.append(rows.where("id % 2 = 1"), folder)
    return m.spark.read.parquet(folder)


@query("A19_append_samples", "SELECT id, run_id, pages, bytes FROM samples", "samples")
def _(m: Model) -> DataFrame:
    folder = f"{checkpoint_dir(m.spark)}/samples-{uuid.uuid4().hex}"
    visits.append(m.samples.select("id", "run_id", "pages", "bytes"), folder)
    return m.spark.read.parquet(folder)


@query("A20_api_stats", "SELECT (SELECT count(*) FROM domains) AS domains, (SELECT count(*) FROM parsed_pages) AS pages, (SELECT count(*) FROM jobs) AS jobs, (SELECT count(DISTINCT board_key) FROM jobs) AS boards")
def _(m: Model) -> DataFrame:
    from heronry.api import Api

    return Api(m, NOW).stats()[0]


@query("A21_messages", "SELECT unnest([NULL, 90, 9490]) AS skipped")
def _(m: Model) -> DataFrame:
    said = [lagged(10, n, 500) for n in (20, 600, 10_000)]
    return _values(m, [(s["skipped"] if s else None,) for s in said], "skipped long")


@query("K3_lag", "SELECT greatest(max(event_id) - 100 - 500, 0) AS skipped FROM events")
def _(m: Model) -> DataFrame:
    return m.events.agg(F.greatest(F.max("event_id") - 100 - 500, F.lit(0)).alias("skipped"))


@query("A22_answers_merged", """SELECT id, coalesce(category, 'other') AS category, coalesce(seniority, 'mid') AS seniority, coalesce(remote_mode, 'remote') AS remote_mode FROM jobs""")
def _(m: Model) -> DataFrame:
    none = F.lit(None).cast("string")
    found = m.jobs.select("id", "category", "seniority", T.json_list("skills").alias("skills"), "remote_mode", F.array().cast("array<string>").alias("remote_regions"), none.alias("city"), "country_code")
    a = m.jobs.select("id", F.lit("Other").alias("category"), F.lit(" MID ").alias("seniority"), F.array(F.lit("Sql ")).alias("skills"), F.lit("Remote").alias("remote_mode"), F.array(F.lit("emea"), F.lit("moon")).alias("remote_regions"), F.lit("Some").alias("city"), F.lit("de").alias("country_code"))
    return answers.merge_enrichment(found, a).select("id", "category", "seniority", "remote_mode")


@query("A24_config", "SELECT 7 AS max_depth, 3 AS discovery_pages, 30 AS harvest_pages")
def _(m: Model) -> DataFrame:
    c = S.Config.from_toml("max_depth = 7")
    return _values(m, [(c.max_depth, c.discovery_pages, c.harvest_pages)], "max_depth int, discovery_pages int, harvest_pages int")


@query("B21_sanitized", "SELECT 8 AS keywords, 1 AS categories, 500.0::DOUBLE AS radius_km, 200 AS most, 2 AS notes")
def _(m: Model) -> DataFrame:
    q, notes = search.sanitized(search.JobQuery(keywords=[f"word {k}" for k in range(10)], categories=["Data", "none such", "data"], near="Lagos", radius_km=9_999, limit=5_000))
    return _values(m, [(len(q.keywords), len(q.categories), q.radius_km, q.limit, len(notes))], "keywords int, categories int, radius_km double, most int, notes int")


@query("F5_sorts", "SELECT * FROM (VALUES (false, false, 'recent', 0), (true, false, 'relevance', 0), (false, true, 'match', 0), (true, true, 'match', 0)) t(keywords, profile, sort, notes)")
def _(m: Model) -> DataFrame:
    rows = []
    for k in (False, True):
        for p in (False, True):
            sort, notes = search.resolve_sort(search.JobQuery(keywords=["x"] if k else []), p)
            rows.append((k, p, sort, len(notes)))
    return _values(m, rows, "keywords boolean, profile boolean, sort string, notes int")


@query("F17_suggestion_order", """WITH n AS (SELECT place_id, city, country_code, lower(trim(unnest(string_split(city || coalesce(',' || alt_names, ''), ',')))) AS name FROM places WHERE city IS NOT NULL),
  c AS (SELECT any_value(city) || ', ' || coalesce(any_value(l.country_name), any_value(n.country_code)) AS value, 'city' AS kind, min(CASE WHEN name = 'in' THEN 0 WHEN starts_with(name, 'in') THEN 1 WHEN contains(name, ' in') THEN 2 END) AS rank, n.place_id AS ord FROM n LEFT JOIN (SELECT country_code, country_name FROM places WHERE city IS NULL) l ON l.country_code = n.country_code GROUP BY n.place_id),
  k AS (SELECT country_name AS value, 'country' AS kind, min(CASE WHEN name = 'in' THEN 0 WHEN starts_with(name, 'in') THEN 1 WHEN contains(name, ' in') THEN 2 END) AS rank, any_value(place_id) AS ord FROM (SELECT country_name, place_id, lower(trim(unnest(string_split(country_name || coalesce(',' || alt_names, ''), ',')))) AS name FROM places WHERE city IS NULL) WHERE length(name) > 2 GROUP BY country_name)
  SELECT value, kind, CAST(rank AS INTEGER) AS rank FROM (SELECT * FROM c UNION ALL SELECT * FROM k) WHERE rank IS NOT NULL ORDER BY rank, kind, ord LIMIT 12""")
def _(m: Model) -> DataFrame:
    from heronry.sources.gazetteer import suggest

    return suggest(m.places, " In ", 12)


@query("H17_keywords", "SELECT unnest(['data', 'engineer', 'c++', 'remote']) AS keyword")
def _(m: Model) -> DataFrame:
    return _values(m, [(k,) for k in T.keyword_fallback("Find me a Data Engineer job with C++ data in remote")], "keyword string")


@query("H20_shown_sizes", "SELECT run_id, max(bytes) >= 1000 AS kilo FROM samples GROUP BY run_id", "samples")
def _(m: Model) -> DataFrame:
    s = m.samples.groupBy("run_id").agg(F.max("bytes").alias("b"))
    return s.select("run_id", (~F.endswith(N.shown_bytes("b"), F.lit(" B"))).alias("kilo"))


@query("H33_clock", f"SELECT {NOW} AS now_ms")
def _(m: Model) -> DataFrame:
    return m.spark.range(1).select(F.lit(NOW).alias("now_ms"))


@query("H35_years", "SELECT id, CAST(greatest(e - s, 4) AS DOUBLE) AS years FROM (SELECT id, 2010 + id % 5 AS s, 2016 + id % 5 AS e FROM jobs)")
def _(m: Model) -> DataFrame:
    # two jobs that overlap: the longer span is their union
    text = F.concat(F.lit("Jan "), 2010 + F.col("id") % 5, F.lit(" – "), 2014 + F.col("id") % 5, F.lit("; "), 2012 + F.col("id") % 5, F.lit(" to March "), 2016 + F.col("id") % 5)
    return cv.profiles(m.jobs.select("id", text.alias("text")), N.current_year(NOW)).select("id", "years")


@query("H36_year", "SELECT 1970 + 1777600000000 // 31556952000 AS year")
def _(m: Model) -> DataFrame:
    return m.spark.range(1).select(F.lit(N.current_year(NOW)).cast("long").alias("year"))


@query("H50_organizations", "SELECT 'https://' || host || '/' AS url, coalesce(name, host) AS name FROM domains UNION ALL SELECT 'https://' || host || '/', 'Parent' FROM domains")
def _(m: Model) -> DataFrame:
    node = F.to_json(F.struct(F.struct(F.array(F.lit("Thing"), F.lit("http://schema.org/Corporation")).alias("@type"), F.coalesce("name", "host").alias("name"), F.struct(F.lit("EducationalOrganization").alias("@type"), F.lit("Parent").alias("name")).alias("parent")).alias("publisher")))
    return H.organizations(m.domains.select(F.concat(F.lit("https://"), "host", F.lit("/")).alias("url"), F.array(node, F.lit("bad {")).alias("json_ld"))).select("url", "name")


@query("H51_replies", "SELECT id, id AS answer FROM domains")
def _(m: Model) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [T.parse_json_reply(f"Here you are:\n```json\n{{\"answer\": {i}}}\n```" if i % 2 else f'Sure {{"answer": {i}}} bye') for i in b["id"]]
            yield pd.DataFrame({"id": b["id"], "answer": [g["answer"] for g in got]})

    return m.domains.select("id").transform(shipped).mapInPandas(run, "id long, answer long")


@query("H53_patched", "SELECT 'seniority' AS field, 'senior' AS value UNION ALL SELECT 'titles', 'Data Engineer'")
def _(m: Model) -> DataFrame:
    o = answers.patched({"remote": "hybrid", "titles": ["x"]}, {"remote": None, "titles": [" Data Engineer ", "data engineer"], "seniority": "Senior"})
    return _values(m, [(k, v if isinstance(v, str) else ", ".join(v)) for k, v in sorted(o.items())], "field string, value string")


@query("I1_pages", r"SELECT id, length(trim(regexp_replace(text, '\s+', ' ', 'g'))) > 0 AS has_text FROM parsed_pages WHERE text IS NOT NULL")
def _(m: Model) -> DataFrame:
    from heronry.plans.domain import _page_html

    return H.parse_pages(_page_html(m)).select("id", (F.length("text") > 25).alias("has_text"))


@query("I13_posting_fields", "SELECT url, 'EUR' AS salary_currency, 'jsonld' AS source FROM parsed_pages WHERE text IS NOT NULL")
def _(m: Model) -> DataFrame:
    from heronry.plans.domain import _page_html

    return H.job_postings(H.parse_pages(_page_html(m))).select("url", "salary_currency", "source")


@query("I15_answered_profile", "SELECT 'mid' AS seniority, 2 AS titles, 1 AS skills, 4.0::DOUBLE AS years")
def _(m: Model) -> DataFrame:
    rules = cv.profile(m.spark, "Experience\nData Engineer, Acme 2015 - 2019\nAnalyst, Beta\nSQL", 2025)
    p = answers.profile_of({"seniority": " Mid ", "titles": [], "skills": [{"name": "Rust", "weight": float("nan")}, {"name": "rust"}], "years_experience": 99}, rules)
    return _values(m, [(p["seniority"], len(p["titles"]), len(p["skills"]), p["years"])], "seniority string, titles int, skills int, years double")


@query("I16_verdicts", "SELECT id, CASE WHEN status = 'probing' AND id % 2 = 0 THEN CASE WHEN id % 4 = 0 THEN 'company' ELSE 'not_company' END ELSE status END AS status, 'fintech' AS industry FROM domains")
def _(m: Model) -> DataFrame:
    a = m.domains.select(F.col("id").alias("domain_id"), (F.col("id") % 4 == 0).alias("is_company"), F.lit(" Some Name ").alias("company_name"), F.lit(" FinTech ").alias("industry"), F.lit("de").alias("hq_country"), F.when(F.col("id") % 2 == 0, 7.5).otherwise(float("nan")).alias("confidence"), F.lit("r").alias("reason"))
    return answers.apply_verdicts(m.domains, a).select("id", "status", "industry")


@query("J7_classify_update", _FOLD.format(status="d.status", score="coalesce(d.company_score, 0)", domains="domains") + " SELECT d.id, coalesce(r.z.st, d.status) AS status, coalesce(r.z.best, d.company_score) AS company_score FROM domains d LEFT JOIN r ON r.id = d.id")
def _(m: Model) -> DataFrame:
    return visits.classify_update(m.domains, assessments(m)).select("id", "status", "company_score")


@query("J8_record_visits", r"SELECT url, CASE WHEN id % 3 = 0 THEN 'job' ELSE kind END AS kind FROM parsed_pages")
def _(m: Model) -> DataFrame:
    from heronry.functions.urls import host

    p = m.pages.select("id", "url", host("url").alias("host"), "kind", "http_status", F.col("url").alias("content_hash"), "error", "fetched_at")
    v = p.where("id % 3 = 0").withColumn("kind", F.lit("job")).withColumn("seq", F.col("id")).drop("id", "fetched_at")
    return visits.record(p.drop("id"), m.domains, v, NOW)[0].select("url", "kind")


@query("J9_record_board", "SELECT count(*) FILTER (id % 2 = 0) + 1 AS total, 1 AS new, count(*) FILTER (id % 2 = 1 AND closed_at IS NULL) AS closed FROM jobs WHERE board_key = 'jobhub/all' AND url IS NOT NULL")
def _(m: Model) -> DataFrame:
    j = m.jobs.where("url is not null").select("url", "title", "domain_id", "board_key", "first_seen", "last_seen", "closed_at", "id")
    listing = j.where("board_key = 'jobhub/all' and id % 2 = 0").select("url", "title").unionByName(_values(m, [("new:1", "Fresh")], "url string, title string"))
    return visits.record_board(j.drop("id"), listing, "jobhub/all", None, NOW)[1].select("total", "new", "closed")


@query("K9_micro_batches", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def _(m: Model) -> DataFrame:
    from heronry.plans.live import _fresh, _stream
    from heronry.streaming.live import last_batch, merge_batch, run_once

    name = _fresh("micro")
    target = f"{checkpoint_dir(m.spark)}/{name}-snapshot"
    run_once(_stream(m).select("user_id", "event_id", "event_type", "value"), name, merge_batch(target, ["user_id"], "event_id"))
    return last_batch(m.spark, target)
