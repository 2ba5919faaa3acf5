"""Filters, joins, aggregates, windows, orders and set operations of the model (inventory B to G)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronry.functions.enrich import SKILLS
from heronry.functions import text as T
from heronry.functions.measures import DAY_MS, bbox
from heronry.operators import aggregates as A
from heronry.operators import filters as P
from heronry.operators import merge as M
from heronry.operators import sequences as S
from heronry.operators import topk as K
from heronry.plans.model import NOW, Model, registry

QUERIES, SQL, query = registry()
BOX = bbox(10.0, 20.0, 4000.0)


@query("B1_open_jobs", "SELECT id, title FROM jobs WHERE closed_at IS NULL")
def _(m: Model) -> DataFrame:
    return P.open_jobs(m.jobs).select("id", "title")


@query("B2_unchanged", """SELECT a.id, (a.title IS NOT DISTINCT FROM b.title AND a.location IS NOT DISTINCT FROM b.location AND a.department IS NOT DISTINCT FROM b.department AND a.salary_min IS NOT DISTINCT FROM b.salary_min) AS same
  FROM jobs a JOIN jobs b ON b.id = a.id + 1""")  # fmt: skip
def _(m: Model) -> DataFrame:
    a, b = m.jobs.alias("a"), m.jobs.alias("b")
    return a.join(b, F.col("b.id") == F.col("a.id") + 1).select("a.id", P.unchanged("a", "b", ["title", "location", "department", "salary_min"]).alias("same"))


@query("B3_categories", "SELECT id, category FROM jobs WHERE category IN ('data', 'design', 'sales')")
def _(m: Model) -> DataFrame:
    return m.jobs.where(F.col("category").isin("data", "design", "sales")).select("id", "category")


@query("B4_industries", "SELECT id, industry FROM domains WHERE instr(lower(coalesce(industry, '')), 'health') > 0 OR instr(lower(coalesce(industry, '')), 'ener') > 0")
def _(m: Model) -> DataFrame:
    return m.domains.where(P.loose_contains("industry", ["health", "ener"])).select("id", "industry")


@query("B5_literal_like", "SELECT id FROM jobs WHERE contains(lower(coalesce(title, '')), 'engineer') OR contains(lower(coalesce(company, '')), 'engineer') OR contains(lower(coalesce(location, '')), 'engineer')")
def _(m: Model) -> DataFrame:
    return m.jobs.where(T.contains_any(["title", "company", "location"], "Engineer")).select("id")


@query("B6_score_floor", "SELECT profile_id, job_id, score FROM matches WHERE score >= 0.8", "matches")
def _(m: Model) -> DataFrame:
    return P.score_floor(m.matches, 0.8).select("profile_id", "job_id", "score")


@query("B7_equalities", "SELECT id FROM jobs WHERE remote_mode = 'remote' AND seniority = 'senior'")
def _(m: Model) -> DataFrame:
    return P.equalities(m.jobs, remote_mode="remote", seniority="senior", category="", country_code=None).select("id")


@query("B8_has_salary", "SELECT id, salary_usd_annual FROM facts WHERE salary_usd_annual IS NOT NULL", "facts")
def _(m: Model) -> DataFrame:
    return m.facts.where("salary_usd_annual is not null").select("id", "salary_usd_annual")


@query("B9_recent", f"SELECT id FROM jobs WHERE coalesce(posted_at, first_seen) >= {NOW - 120 * DAY_MS}")
def _(m: Model) -> DataFrame:
    return P.recent(m.jobs, NOW, 120).select("id")


@query("B10_bounding_box", f"SELECT id, lat, lon FROM facts WHERE lat BETWEEN {BOX[0]!r} AND {BOX[1]!r} AND lon BETWEEN {BOX[2]!r} AND {BOX[3]!r}", "facts")
def _(m: Model) -> DataFrame:
    return m.facts.where(P.in_box("lat", "lon", BOX)).select("id", "lat", "lon")


_OPEN = "(remote_mode = 'remote' AND (len(remote_regions) = 0 OR list_contains(remote_regions, 'global') OR list_contains(remote_regions, 'DE')))"


@query("B11_place", f"SELECT id FROM facts WHERE (lat BETWEEN {BOX[0]!r} AND {BOX[1]!r} AND lon BETWEEN {BOX[2]!r} AND {BOX[3]!r}) OR (lat IS NULL AND country_code = 'DE') OR {_OPEN}", "facts")
def _(m: Model) -> DataFrame:
    return m.facts.where(P.place(BOX, "DE")).select("id")


@query("B12_remote_open", f"SELECT id FROM facts WHERE {_OPEN}", "facts")
def _(m: Model) -> DataFrame:
    return m.facts.where(P.remote_open("DE")).select("id")


@query("B13_tri_state", "SELECT d.id FROM domains d WHERE d.careers_url IS NOT NULL AND NOT EXISTS (SELECT 1 FROM jobs j WHERE j.domain_id = d.id AND j.closed_at IS NULL)")
def _(m: Model) -> DataFrame:
    return P.tri_state(m.domains, m.jobs, has_jobs=False, has_careers=True).select("id")


@query("B14_status", "SELECT id, status FROM domains WHERE status = 'company'")
def _(m: Model) -> DataFrame:
    return P.status(P.status(m.domains, "all"), "company").select("id", "status")


@query("B15_as_of", "SELECT id FROM jobs WHERE first_seen <= 1760000000000 AND (closed_at IS NULL OR closed_at > 1760000000000)")
def _(m: Model) -> DataFrame:
    return m.jobs.where(P.as_of(1_760_000_000_000)).select("id")


@query("B16_discovered", "SELECT id FROM domains WHERE status <> 'discovered'")
def _(m: Model) -> DataFrame:
    return P.discovered(m.domains, False).select("id")


@query("B17_json_field", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE json_extract_string(props, '$.k') IN ('3', '14', '15')")
def _(m: Model) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    return m.events.where(k.isin("3", "14", "15")).select("event_id", k.alias("k"))


@query("B18_host_exclusion", "SELECT url FROM frontier WHERE host NOT IN (SELECT host FROM domains WHERE status IN ('not_company', 'blocked'))", "frontier")
def _(m: Model) -> DataFrame:
    return m.frontier.join(m.domains.where("status in ('not_company', 'blocked')").select("host"), "host", "left_anti").select("url")


@query("B19_salary_floor", "SELECT id FROM facts WHERE salary_usd_annual >= 90000", "facts")
def _(m: Model) -> DataFrame:
    return m.facts.where("salary_usd_annual >= 90000").select("id")


@query("B20_display_name", "SELECT j.id, coalesce(j.company, d.name, d.host) AS shown FROM jobs j LEFT JOIN domains d ON d.id = j.domain_id")
def _(m: Model) -> DataFrame:
    return K.with_domain(m.jobs, m.domains).select("id", P.shown().alias("shown"))


@query("C1_jobs_domains", "SELECT j.id, d.host, d.industry FROM jobs j LEFT JOIN domains d ON d.id = j.domain_id")
def _(m: Model) -> DataFrame:
    return K.with_domain(m.jobs, m.domains).select("id", "host", "industry")


@query("C2_jobs_profile", "SELECT j.id, m.score FROM jobs j LEFT JOIN matches m ON m.job_id = j.id AND m.profile_id = 3", "matches")
def _(m: Model) -> DataFrame:
    mine = m.matches.where("profile_id = 3").select(F.col("job_id").alias("id"), "score")
    return m.jobs.select("id").join(mine, "id", "left")


@query("C3_matches_jobs", "SELECT m.profile_id, m.job_id, m.score, d.host FROM matches m JOIN jobs j ON j.id = m.job_id LEFT JOIN domains d ON d.id = j.domain_id", "matches")
def _(m: Model) -> DataFrame:
    j = K.with_domain(m.jobs.select("id", "domain_id"), m.domains)
    return m.matches.join(j, F.col("job_id") == F.col("id")).select("profile_id", "job_id", "score", "host")


@query("C4_domain_hits", "SELECT d.host, count(*) AS hits FROM matches m JOIN jobs j ON j.id = m.job_id JOIN domains d ON d.id = j.domain_id WHERE m.profile_id = 3 AND m.score >= 0.7 GROUP BY d.host", "matches")
def _(m: Model) -> DataFrame:
    hits = m.matches.where("profile_id = 3 and score >= 0.7").join(m.jobs.select("id", "domain_id"), F.col("job_id") == F.col("id"))
    return hits.join(m.domains.select(F.col("id").alias("d"), "host"), F.col("domain_id") == F.col("d")).groupBy("host").agg(F.count("*").alias("hits"))


@query("C6_open_counts", "SELECT d.id, coalesce(n, 0) AS open_jobs FROM domains d LEFT JOIN (SELECT domain_id, count(*) AS n FROM jobs WHERE closed_at IS NULL GROUP BY domain_id) c ON c.domain_id = d.id")
def _(m: Model) -> DataFrame:
    return K.with_open_count(m.domains, m.jobs).select("id", "open_jobs")


@query("C7_boards_domains", "SELECT b.key, d.host FROM boards b JOIN domains d ON d.id = b.domain_id", "boards")
def _(m: Model) -> DataFrame:
    return m.boards.join(m.domains.select(F.col("id").alias("domain_id"), "host"), "domain_id").select("key", "host")


@query("C8_semi_join", "SELECT id, title FROM jobs WHERE id IN (SELECT job_id FROM matches WHERE score > 0.95)", "matches")
def _(m: Model) -> DataFrame:
    return m.jobs.join(m.matches.where("score > 0.95").select(F.col("job_id").alias("id")), "id", "left_semi").select("id", "title")


@query("C10_close_missing_anti", "SELECT id FROM jobs j WHERE board_key = 'jobhub/all' AND closed_at IS NULL AND NOT EXISTS (SELECT 1 FROM jobs s WHERE s.url = j.url AND s.id % 3 = 0)")
def _(m: Model) -> DataFrame:
    seen = m.jobs.where("id % 3 = 0").select("url")
    return m.jobs.where("board_key = 'jobhub/all' and closed_at is null").join(seen, "url", "left_anti").select("id")


@query("C11_edges_in_page", """SELECT src_domain_id, dst_domain_id, weight FROM edges WHERE src_domain_id IN (SELECT id FROM domains WHERE id <= 60) AND dst_domain_id IN (SELECT id FROM domains WHERE id <= 60)
  AND (src_domain_id > 30 OR dst_domain_id > 30)""", "edges")  # fmt: skip
def _(m: Model) -> DataFrame:
    from heronry.operators.graph import edges_between

    return edges_between(m.edges, m.domains.where("id <= 60").select("id"), m.domains.where("id between 31 and 60").select("id")).select("src_domain_id", "dst_domain_id", "weight")


@query("C12_exists_in_list", "SELECT id FROM facts WHERE list_contains(remote_regions, 'EMEA')", "facts")
def _(m: Model) -> DataFrame:
    return m.facts.where(F.array_contains("remote_regions", "EMEA")).select("id")


@query("C13_same_content", "SELECT id FROM parsed_pages a WHERE EXISTS (SELECT 1 FROM parsed_pages b WHERE b.domain_id = a.domain_id AND b.content_hash = a.content_hash AND b.url <> a.url)")
def _(m: Model) -> DataFrame:
    return P.shared_content(m.pages).select("id")


@query("C14_best_anchor", "SELECT f.url, a.anchor FROM frontier f LEFT JOIN (SELECT dst_url, anchor FROM links WHERE link_score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY dst_url ORDER BY link_score DESC, src_page_id, anchor) = 1) a ON a.dst_url = f.url", "frontier", "links")
def _(m: Model) -> DataFrame:
    return K.with_best_anchor(m.frontier, m.links).select("url", "anchor")


@query("C15_page_counts", "SELECT d.id, (SELECT count(*) FROM parsed_pages p WHERE p.domain_id = d.id) AS pages FROM domains d")
def _(m: Model) -> DataFrame:
    n = m.pages.groupBy(F.col("domain_id").alias("id")).agg(F.count("*").alias("pages"))
    return m.domains.select("id").join(n, "id", "left").select("id", F.coalesce("pages", F.lit(0)).alias("pages"))


@query("C16_dashboard", "SELECT (SELECT count(*) FROM domains) AS domains, (SELECT count(*) FROM domains WHERE status = 'company') AS companies, (SELECT count(*) FROM parsed_pages) AS pages, (SELECT count(*) FROM jobs WHERE closed_at IS NULL) AS open_jobs")
def _(m: Model) -> DataFrame:
    return A.counts(domains=m.domains, companies=m.domains.where("status = 'company'"), pages=m.pages, open_jobs=P.open_jobs(m.jobs))


_SPOTS = ((52.5, 13.4), (6.5, 3.4), (40.7, -74.0))
_HAV = "2 * 6371.0::DOUBLE * asin(sqrt(least(1.0::DOUBLE, pow(sin(radians({0} - lat) / 2), 2) + cos(radians(lat)) * cos(radians({0})) * pow(sin(radians({1} - lon) / 2), 2))))"


@query("C17_nearest_place", f"SELECT id, round(least({', '.join(_HAV.format(a, b) for a, b in _SPOTS)}), 3) AS km FROM facts WHERE lat IS NOT NULL", "facts")
def _(m: Model) -> DataFrame:
    return m.facts.where("lat is not null").select("id", F.round(P.nearest_km("lat", "lon", _SPOTS), 3).alias("km"))


@query("C18_gazetteer", """WITH p AS (SELECT place_id, lower(trim(unnest(string_split(city || coalesce(',' || alt_names, ''), ',')))) AS name, country_code FROM places WHERE city IS NOT NULL)
  SELECT name, min(place_id) AS place_id FROM p GROUP BY name""")  # fmt: skip
def _(m: Model) -> DataFrame:
    from heronry.sources.gazetteer import city_names

    return city_names(m.places).groupBy("name").agg(F.min("ord").alias("place_id"))


@query("C19_board_company", r"""WITH d AS (SELECT id, regexp_replace(lower(coalesce(name, '')), '[^\p{L}\p{N}]', '', 'g') AS n, regexp_replace(lower(split_part(host, '.', 1)), '[^\p{L}\p{N}]', '', 'g') AS l, CASE WHEN status = 'company' THEN 0 ELSE 1 END AS p FROM domains WHERE status IN ('company', 'probing')),
  b AS (SELECT key, regexp_replace(lower(token), '[^\p{L}\p{N}]', '', 'g') AS t FROM boards),
  a AS (SELECT key, id, CASE WHEN n = t THEN 0 ELSE 1 END AS stage, p FROM b JOIN d ON d.n = b.t OR d.l = b.t)
  SELECT key, id AS domain_id FROM a QUALIFY row_number() OVER (PARTITION BY key ORDER BY stage, p, id) = 1""", "boards")  # fmt: skip
def _(m: Model) -> DataFrame:
    return K.attribute_boards(m.boards, m.domains)


@query("C21_status_at", "SELECT host, arg_max(status, id) AS status FROM log WHERE kind = 'domain_classified' AND ts <= 1705000000000 GROUP BY host", "log")
def _(m: Model) -> DataFrame:
    from heronry.operators.timeline import status_at

    return status_at(m.log, 1_705_000_000_000)


@query("C22_title_overlap", r"""WITH w AS (SELECT id, list_filter(string_split(trim(regexp_replace(lower(coalesce(title, '')), '[^\p{L}\p{N}]+', ' ', 'g')), ' '), lambda x: x NOT IN ('', 'senior','sr','junior','jr','lead','staff','principal','head','of','the','and','intern')) AS w FROM jobs)
  SELECT id, round(greatest(len(list_filter(['data', 'engineer'], lambda x: list_contains(w, x))) / 2.0, len(list_filter(['store', 'manager'], lambda x: list_contains(w, x))) / 2.0), 6) AS overlap FROM w""")  # fmt: skip
def _(m: Model) -> DataFrame:
    from heronry.operators.matching import title_overlap

    return m.jobs.select("id", F.round(title_overlap("title", ["Data Engineer", "Senior Store Manager"]), 6).alias("overlap"))


@query("D1_open_per_domain", "SELECT domain_id, count(*) AS n FROM jobs WHERE closed_at IS NULL AND domain_id IS NOT NULL GROUP BY domain_id")
def _(m: Model) -> DataFrame:
    return P.open_jobs(m.jobs).where("domain_id is not null").groupBy("domain_id").agg(F.count("*").alias("n"))


@query("D2_degree", "SELECT id, CAST(sum(n) AS BIGINT) AS n FROM (SELECT src_domain_id AS id, count(*) AS n FROM edges GROUP BY 1 UNION ALL SELECT dst_domain_id, count(*) FROM edges GROUP BY 1) GROUP BY id", "edges")
def _(m: Model) -> DataFrame:
    return A.degree(m.edges)


@query("D3_activity", "SELECT ts // 86400000 AS day, count(*) FILTER (kind = 'page_fetched') AS pages, CAST(sum(CASE WHEN kind = 'jobs_found' THEN new ELSE 0 END) AS BIGINT) AS new_jobs FROM log WHERE kind IN ('page_fetched', 'jobs_found') GROUP BY 1", "log")
def _(m: Model) -> DataFrame:
    from heronry.operators.timeline import activity

    return activity(m.log, 0, DAY_MS).select((F.col("t") / DAY_MS).cast("long").alias("day"), "pages", "new_jobs")


@query("D4_strong_good", "SELECT coalesce(sum(CASE WHEN score >= 0.7 THEN 1 ELSE 0 END), 0)::BIGINT AS strong, coalesce(sum(CASE WHEN score >= 0.5 THEN 1 ELSE 0 END), 0)::BIGINT AS good FROM matches WHERE profile_id = 3", "matches")
def _(m: Model) -> DataFrame:
    return m.matches.where("profile_id = 3").agg(F.count_if(F.col("score") >= 0.7).alias("strong"), F.count_if(F.col("score") >= 0.5).alias("good"))


@query("D5_facets", """WITH l AS (SELECT 'category' AS facet, category AS value FROM jobs UNION ALL SELECT 'seniority', seniority FROM jobs UNION ALL SELECT 'country_code', country_code FROM jobs)
  SELECT facet, value, count(*) AS n FROM l WHERE value IS NOT NULL GROUP BY facet, value QUALIFY row_number() OVER (PARTITION BY facet ORDER BY count(*) DESC, value) <= 40""")  # fmt: skip
def _(m: Model) -> DataFrame:
    return A.facets(m.jobs, ["category", "seniority", "country_code"])


@query("D6_extremes", "SELECT min(ts) AS first_ts, max(CASE WHEN kind = 'crawler_started' THEN id END) AS last_start, max(CASE WHEN kind = 'crawler_stopped' THEN id END) AS last_stop FROM log", "log")
def _(m: Model) -> DataFrame:
    return m.log.agg(F.min("ts").alias("first_ts"), F.max(F.when(F.col("kind") == "crawler_started", F.col("id"))).alias("last_start"), F.max(F.when(F.col("kind") == "crawler_stopped", F.col("id"))).alias("last_stop"))


@query("D7_latest_per_host", "SELECT host, max(id) AS id, arg_max(kind, id) AS kind FROM log GROUP BY host", "log")
def _(m: Model) -> DataFrame:
    return m.log.groupBy("host").agg(F.max("id").alias("id"), F.max_by("kind", "id").alias("kind"))


@query("D8_downsample", "SELECT id, ts, run_id, pages, bytes FROM samples WHERE ts BETWEEN 1704100000000 AND 1706000000000 QUALIFY row_number() OVER (PARTITION BY ts // 3600000 ORDER BY id DESC) = 1", "samples")
def _(m: Model) -> DataFrame:
    return A.downsample(m.samples, 1_704_100_000_000, 1_706_000_000_000, 3_600_000).select("id", "ts", "run_id", "pages", "bytes")


@query("D9_percentile", "WITH s AS (SELECT salary_usd_annual AS v, row_number() OVER (ORDER BY salary_usd_annual DESC) AS k, count(*) OVER () AS n FROM facts WHERE salary_usd_annual IS NOT NULL) SELECT v AS threshold FROM s WHERE k = greatest(ceil(n * 0.25::DOUBLE), 1)", "facts")
def _(m: Model) -> DataFrame:
    return A.percentile_threshold(m.facts, "salary_usd_annual", 0.25)


@query("D10_rolling_sum", "SELECT coalesce(sum(new), 0)::BIGINT AS total FROM log WHERE kind = 'jobs_found' AND ts >= 1706400000000", "log")
def _(m: Model) -> DataFrame:
    return A.rolling_sum(m.log.where("kind = 'jobs_found'"), "new", 1_706_400_000_000)


@query("D11_edge_weights", "SELECT * FROM edges", "edges")
def _(m: Model) -> DataFrame:
    return m.edges


@query("D12_best_score", "SELECT domain_id, greatest(0, max((id * 17 % 120) / 100.0::DOUBLE - 0.1)) AS best, arg_max(id, [(id * 17 % 120) / 100.0::DOUBLE - 0.1, id::DOUBLE]) AS page FROM parsed_pages WHERE domain_id IS NOT NULL GROUP BY domain_id")
def _(m: Model) -> DataFrame:
    s = (F.col("id") * 17 % 120) / 100.0 - 0.1
    p = m.pages.where("domain_id is not null").withColumn("s", s)
    return p.groupBy("domain_id").agg(F.greatest(F.lit(0.0), F.max("s")).alias("best"), F.max_by("id", F.struct("s", "id")).alias("page"))


@query("D13_vendors", "SELECT DISTINCT vendor FROM boards", "boards")
def _(m: Model) -> DataFrame:
    return m.boards.select("vendor").distinct()


@query("D14_inbound", "SELECT dst_domain_id AS id, count(*) AS inbound FROM edges GROUP BY 1", "edges")
def _(m: Model) -> DataFrame:
    return m.edges.groupBy(F.col("dst_domain_id").alias("id")).agg(F.count("*").alias("inbound"))


@query("D15_row_counts", "SELECT (SELECT count(*) FROM domains) AS domains, (SELECT count(*) FROM parsed_pages) AS pages, (SELECT count(*) FROM jobs) AS jobs, (SELECT count(*) FROM events) AS events, (SELECT count(*) FROM job_matches) AS job_matches")
def _(m: Model) -> DataFrame:
    return A.counts(domains=m.domains, pages=m.pages, jobs=m.jobs, events=m.events, job_matches=m.job_matches)


@query("D16_weight_rollup", "SELECT src_page_id, dst_url, count(*) AS n FROM links GROUP BY 1, 2", "links")
def _(m: Model) -> DataFrame:
    return m.links.groupBy("src_page_id", "dst_url").agg(F.count("*").alias("n"))


_SKILL_TEXT = r"SELECT id, ' ' || t || ' ' AS p, string_split(t, ' ') AS w FROM (SELECT id, trim(regexp_replace(regexp_replace(trim(regexp_replace(lower(coalesce(description, '')), '[^\p{L}\p{N}+#.]+', ' ', 'g')), '\.+( |$)', ' ', 'g'), ' +', ' ', 'g')) AS t FROM jobs)"
_SKILL_COUNTS = "SELECT id, k AS place, skill, CAST(sum(CASE WHEN contains(sign, ' ') THEN (length(p) - length(replace(p, ' ' || sign || ' ', ''))) // (length(sign) + 2) ELSE len(list_filter(w, lambda x: x = sign)) END) AS BIGINT) AS n FROM (" + _SKILL_TEXT + ") t, (VALUES " + ", ".join(f"({k}, '{name}', '{s}')" for k, (name, signs) in enumerate(SKILLS.items()) for s in signs) + ") s(k, skill, sign) GROUP BY id, k, skill"


@query("D17_skill_mentions", f"SELECT skill, CAST(sum(n) AS BIGINT) AS mentions, count(*) AS jobs FROM ({_SKILL_COUNTS}) WHERE n > 0 GROUP BY skill")
def _(m: Model) -> DataFrame:
    from heronry.functions.enrich import skill_counts

    each = m.jobs.select(F.explode(skill_counts(F.col("description"))).alias("s"))
    return each.groupBy(F.col("s.name").alias("skill")).agg(F.sum("s.count").alias("mentions"), F.count("*").alias("jobs"))


@query("D18_budget_counts", "SELECT host AS budget, count(*) AS n FROM frontier WHERE state IN ('in_flight', 'done') GROUP BY host", "frontier")
def _(m: Model) -> DataFrame:
    from heronry.functions.urls import budget_key

    return m.frontier.where("state in ('in_flight', 'done')").groupBy(budget_key("url").alias("budget")).agg(F.count("*").alias("n"))


@query("D20_given_fields", "SELECT id, (department IS NOT NULL)::INT + (employment_type IS NOT NULL)::INT + (category IS NOT NULL)::INT AS given FROM jobs")
def _(m: Model) -> DataFrame:
    return m.jobs.select("id", P.count_given(["department", "employment_type", "category"]).alias("given"))


@query("D21_hit_rate", "SELECT host, CASE WHEN h + c > 0 THEN round(100.0 * h / (h + c), 6) END AS rate FROM (SELECT host, count(*) FILTER (kind = 'page_fetched') AS h, count(*) FILTER (kind = 'jobs_found') AS c FROM log GROUP BY host)", "log")
def _(m: Model) -> DataFrame:
    g = m.log.groupBy("host").agg(F.count_if(F.col("kind") == "page_fetched").alias("h"), F.count_if(F.col("kind") == "jobs_found").alias("c"))
    return g.select("host", F.round(A.hit_rate(F.col("h"), F.col("c")), 6).alias("rate"))


@query("E1_frontier_next", "SELECT url, host, score FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY score DESC, enqueued_at, url) AS k FROM frontier WHERE state = 'queued') WHERE k = 1 ORDER BY score DESC, enqueued_at, url LIMIT 50", "frontier")
def _(m: Model) -> DataFrame:
    return S.best_per_host(m.frontier, 50).select("url", "host", "score")


@query("E2_rates", "SELECT id, ts, run_id, CASE WHEN dt > 0 THEN round(greatest(p, 0) / dt, 9) END AS pages_per_sec, CASE WHEN dt > 0 THEN round(greatest(b, 0) / dt, 9) END AS bytes_per_sec FROM (SELECT id, ts, run_id, (ts - lag(ts) OVER w) / 1000.0::DOUBLE AS dt, pages - lag(pages) OVER w AS p, bytes - lag(bytes) OVER w AS b FROM samples WINDOW w AS (PARTITION BY run_id ORDER BY id))", "samples")
def _(m: Model) -> DataFrame:
    r = S.rates(m.samples, ["pages", "bytes"])
    return r.select("id", "ts", "run_id", F.round("pages_per_sec", 9).alias("pages_per_sec"), F.round("bytes_per_sec", 9).alias("bytes_per_sec"))


_RUNS = """WITH k AS (SELECT id, ts, kind, reason, count(*) FILTER (kind = 'crawler_started') OVER (ORDER BY id) AS run FROM log WHERE kind IN ('crawler_started', 'crawler_stopped')),
  r AS (SELECT arg_min(id, id) FILTER (kind = 'crawler_started') AS id, arg_min(ts, id) FILTER (kind = 'crawler_started') AS started_at, arg_min(ts, id) FILTER (kind = 'crawler_stopped') AS stopped_at, arg_min(reason, id) FILTER (kind = 'crawler_stopped') AS reason FROM k WHERE run > 0 GROUP BY run)
  """


@query("E3_runs", _RUNS + "SELECT * FROM r", "log")
def _(m: Model) -> DataFrame:
    return S.pair_runs(m.log)


@query("E4_gap_segments", "SELECT id, run_id, 1 + count(*) FILTER (g > 3600000) OVER (PARTITION BY run_id ORDER BY id) AS segment FROM (SELECT id, run_id, ts - lag(ts) OVER (PARTITION BY run_id ORDER BY id) AS g FROM samples)", "samples")
def _(m: Model) -> DataFrame:
    return S.segments(m.samples, 3_600_000).select("id", "run_id", "segment")


_MERGED = """WITH v AS (SELECT domain_id, first_seen AS s, coalesce(closed_at, last_seen) AS e FROM jobs WHERE domain_id IS NOT NULL AND first_seen IS NOT NULL AND coalesce(closed_at, last_seen) >= first_seen),
  n AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY domain_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS x FROM v),
  i AS (SELECT *, sum(x) OVER (PARTITION BY domain_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM n),
  g AS (SELECT domain_id, min(s) AS start, max(e) AS "end" FROM i GROUP BY domain_id, k)
  """


@query("E5_merged_ranges", _MERGED + 'SELECT domain_id, start, "end" FROM g')
def _(m: Model) -> DataFrame:
    return S.merge_ranges(m.jobs.where("domain_id is not null"), "domain_id", "first_seen", F.coalesce("closed_at", "last_seen"))


@query("D19_covered_time", _MERGED + 'SELECT domain_id, CAST(sum("end" - start) AS BIGINT) AS covered FROM g GROUP BY domain_id')
def _(m: Model) -> DataFrame:
    r = m.jobs.where("domain_id is not null").select("domain_id", F.col("first_seen").alias("start"), F.coalesce("closed_at", "last_seen").alias("end"))
    return A.interval_years(r, "domain_id", NOW).select("domain_id", F.col("years").alias("covered"))


@query("E6_per_minute", "SELECT id, round(greatest(pages - lag(pages) OVER w, 0) * 60000.0::DOUBLE / nullif(ts - lag(ts) OVER w, 0), 9) AS pages_per_minute FROM samples WINDOW w AS (PARTITION BY run_id ORDER BY id)", "samples")
def _(m: Model) -> DataFrame:
    return S.rates(m.samples, ["pages"]).select("id", F.round(F.col("pages_per_sec") * 60, 9).alias("pages_per_minute"))


@query("E7_first_wins", "SELECT domain_id, kind, min(id) AS id, arg_min(url, id) AS url FROM parsed_pages GROUP BY domain_id, kind")
def _(m: Model) -> DataFrame:
    return S.first_wins(m.pages.select("domain_id", "kind", "id", "url"), ["domain_id", "kind"], "id")


@query("E8_duplicates", "SELECT id, first_id FROM (SELECT id, url, min(id) OVER w AS first_id, first_value(url) OVER (PARTITION BY domain_id, content_hash ORDER BY id) AS u FROM parsed_pages WHERE content_hash IS NOT NULL AND domain_id IS NOT NULL WINDOW w AS (PARTITION BY domain_id, content_hash)) WHERE id > first_id AND url <> u")
def _(m: Model) -> DataFrame:
    return S.duplicates(m.pages)


@query("E9_next_start", _RUNS + "SELECT min(started_at) AS t FROM r WHERE started_at > 1705000000000", "log")
def _(m: Model) -> DataFrame:
    return S.next_start(S.pair_runs(m.log), 1_705_000_000_000)


@query("F1_recent", "SELECT id FROM jobs WHERE closed_at IS NULL ORDER BY coalesce(posted_at, first_seen) DESC NULLS LAST, id DESC LIMIT 50")
def _(m: Model) -> DataFrame:
    return K.ordered(P.open_jobs(m.jobs), "recent", 50).select("id")


@query("F2_salary_desc", "SELECT id FROM facts WHERE closed_at IS NULL ORDER BY salary_usd_annual DESC NULLS LAST, id DESC LIMIT 50", "facts")
def _(m: Model) -> DataFrame:
    return K.ordered(P.open_jobs(m.facts), "salary_desc", 50).select("id")


@query("F3_match", "SELECT j.id FROM jobs j LEFT JOIN matches m ON m.job_id = j.id AND m.profile_id = 3 WHERE closed_at IS NULL ORDER BY m.score DESC NULLS LAST, j.id DESC LIMIT 50", "matches")
def _(m: Model) -> DataFrame:
    j = P.open_jobs(m.jobs).join(m.matches.where("profile_id = 3").select(F.col("job_id").alias("id"), F.col("score").alias("match_score")), "id", "left")
    return K.ordered(j, "match", 50).select("id")


@query("F6_browse_order", "SELECT m.job_id, m.score FROM matches m JOIN facts j ON j.id = m.job_id WHERE m.profile_id = 3 AND closed_at IS NULL ORDER BY coalesce(posted_at, first_seen) DESC NULLS LAST, score DESC NULLS LAST, job_id LIMIT 25 OFFSET 25", "matches", "facts")
def _(m: Model) -> DataFrame:
    from heronry.operators.matching import browse

    return browse(m.matches, m.facts, m.domains, 3, sort="recent", limit=25, offset=25)[1].select("job_id", "score")


@query("F7_companies_order", "SELECT id, host FROM domains ORDER BY company_score DESC NULLS LAST, lower(host), id LIMIT 50")
def _(m: Model) -> DataFrame:
    from heronry.operators.catalog import companies

    return companies(m.domains, m.jobs, m.pages, sort="score", limit=50)[1].select("id", "host")


@query("F9_domain_pages", "SELECT id FROM parsed_pages WHERE domain_id = 2 ORDER BY (kind = 'careers') DESC NULLS LAST, (kind = 'home') DESC NULLS LAST, id LIMIT 100")
def _(m: Model) -> DataFrame:
    return K.domain_pages(m.pages, 2, 100).select("id")


@query("F10_domain_jobs", "SELECT id FROM jobs WHERE domain_id = 1 ORDER BY posted_at DESC NULLS LAST, id LIMIT 100")
def _(m: Model) -> DataFrame:
    return m.jobs.where("domain_id = 1").orderBy(F.desc_nulls_last("posted_at"), "id").limit(100).select("id")


@query("F11_graph_pages", "SELECT id FROM parsed_pages WHERE domain_id = 2 ORDER BY (kind = 'home') DESC NULLS LAST, (kind = 'careers') DESC NULLS LAST, (kind = 'job') DESC NULLS LAST, id LIMIT 500")
def _(m: Model) -> DataFrame:
    return K.graph_pages(m.pages, 2, 500).select("id")


@query("F12_external_sites", r"SELECT lower(regexp_extract(dst_url, '^[a-zA-Z]+://([^/?#:]*)', 1)) AS site, count(*) AS n FROM links GROUP BY 1 ORDER BY n DESC, site LIMIT 40", "links")
def _(m: Model) -> DataFrame:
    from heronry.functions.urls import host

    return m.links.groupBy(host("dst_url").alias("site")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "site").limit(40)


@query("F13_latest_events", "SELECT id, kind FROM log WHERE ts <= 1705000000000 ORDER BY id DESC LIMIT 200", "log")
def _(m: Model) -> DataFrame:
    from heronry.operators.timeline import events

    return events(m.log, before=1_705_000_000_000, limit=200).select("id", "kind")


@query("F14_keyset", "SELECT id, kind FROM log WHERE id > 500 ORDER BY id LIMIT 100", "log")
def _(m: Model) -> DataFrame:
    return K.keyset(m.log, "id", 500, 100).select("id", "kind")


@query("F15_has_more", "SELECT count(*) = 100 AS has_more FROM (SELECT id FROM log WHERE id > 500 ORDER BY id LIMIT 100)", "log")
def _(m: Model) -> DataFrame:
    return K.has_more(K.keyset(m.log, "id", 500, 100), 100)


@query("F16_enrichment_queue", "SELECT id FROM jobs WHERE category IS NULL OR seniority IS NULL ORDER BY (category IS NULL) DESC, id LIMIT 100")
def _(m: Model) -> DataFrame:
    return K.enrichment_queue(m.jobs, 100).select("id")


@query("F18_sitemap_careers", """SELECT url FROM (SELECT DISTINCT url FROM parsed_pages WHERE kind = 'careers' AND domain_id = 2) ORDER BY len(list_filter(string_split(regexp_replace(url, '^[a-z]+://[^/]*', ''), '/'), lambda s: s <> '')), len(url), url LIMIT 3""")
def _(m: Model) -> DataFrame:
    return K.shallowest(m.pages.where("kind = 'careers' and domain_id = 2"), 3)


@query("F19_sorted_edges", "SELECT src_domain_id, dst_domain_id, weight FROM edges ORDER BY 1, 2", "edges")
def _(m: Model) -> DataFrame:
    return m.edges.orderBy("src_domain_id", "dst_domain_id").select("src_domain_id", "dst_domain_id", "weight")


@query("F20_candidate_cap", f"SELECT id FROM facts WHERE lat BETWEEN {BOX[0]!r} AND {BOX[1]!r} AND lon BETWEEN {BOX[2]!r} AND {BOX[3]!r} ORDER BY coalesce(posted_at, first_seen) DESC NULLS LAST, id DESC LIMIT 2000", "facts")
def _(m: Model) -> DataFrame:
    return K.ordered(m.facts.where(P.in_box("lat", "lon", BOX)), "recent", 2000).select("id")


@query("F21_top_skills", f"SELECT id, list(skill ORDER BY n DESC, place)[1:12] AS skills FROM ({_SKILL_COUNTS}) WHERE n > 0 GROUP BY id")
def _(m: Model) -> DataFrame:
    from heronry.functions.enrich import top_skills

    return m.jobs.select("id", top_skills(F.col("description")).alias("skills")).where("size(skills) > 0")


@query("G1_union_all", "SELECT src_domain_id AS id, 'out' AS way FROM edges UNION ALL SELECT dst_domain_id, 'in' FROM edges", "edges")
def _(m: Model) -> DataFrame:
    return m.edges.select(F.col("src_domain_id").alias("id"), F.lit("out").alias("way")).unionByName(m.edges.select(F.col("dst_domain_id").alias("id"), F.lit("in").alias("way")))


@query("G2_distinct", "SELECT DISTINCT category, seniority FROM jobs")
def _(m: Model) -> DataFrame:
    return m.jobs.select("category", "seniority").distinct()


@query("G3_difference", "SELECT id FROM domains WHERE id NOT IN (SELECT domain_id FROM jobs WHERE domain_id IS NOT NULL)")
def _(m: Model) -> DataFrame:
    return m.domains.select("id").join(m.jobs.select(F.col("domain_id").alias("id")), "id", "left_anti")


@query("G4_insert_missing", "SELECT id, host FROM domains WHERE id % 2 = 0 UNION ALL SELECT id, 'new.' || host FROM domains WHERE id % 3 = 0 AND id % 2 <> 0")
def _(m: Model) -> DataFrame:
    d = m.domains.select("id", "host")
    return M.insert_missing(d.where("id % 2 = 0"), d.where("id % 3 = 0").withColumn("host", F.concat(F.lit("new."), "host")), ["id"])


@query("G5_dedupe_list", """SELECT id, list_filter(w, lambda x, i: list_position(list_transform(w, lambda y: lower(y)), lower(x)) = i)[1:3] AS words FROM (SELECT id, list_filter(string_split(company, ' '), lambda x: x <> '') AS w FROM jobs WHERE company IS NOT NULL)""")
def _(m: Model) -> DataFrame:
    return m.jobs.where("company is not null").select("id", T.dedupe_ci(F.split("company", " "), 3).alias("words"))
