"""The engine's tables over a data folder: stored ones as they are, the others derived from them.

Each derived table has its text for the oracle beside it, so that both sides start from the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronry.session import ship

#: The clock of all queries: nothing reads the time of day.
NOW = 1_777_600_000_000
DAY = 86_400_000


class Model:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        ship(spark)
        spark.conf.set("spark.sql.session.timeZone", "UTC")  # stored times have no zone and mean UTC

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.table(name)

    @property
    def pages(self) -> DataFrame:
        return self.table("parsed_pages")

    @property
    def log(self) -> DataFrame:
        """Event log: id, ts, kind, host, status, new, reason."""
        e = self.table("events")
        k = F.get_json_object("props", "$.k").cast("long")
        kind = F.when(F.col("event_type") == "signup", "crawler_started").when(F.col("event_type") == "error", "crawler_stopped").when(F.col("event_type") == "view", "page_fetched").when(F.col("event_type") == "click", "domain_classified").otherwise("jobs_found")
        status = F.when(F.col("value") >= 20, "company").when(F.col("value") >= 5, "probing").otherwise("not_company")
        return e.select(F.col("event_id").alias("id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"), kind.alias("kind"), F.concat(F.lit("d"), F.col("user_id")).alias("host"), status.alias("status"), k.alias("new"), F.concat(F.lit("r"), k % 5).alias("reason"), "value")

    @property
    def samples(self) -> DataFrame:
        """Metric samples: id, ts, run_id, pages, bytes, both cumulative within a run."""
        from pyspark.sql import Window

        w = Window.partitionBy("run_id").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
        e = self.table("events").select(F.col("event_id").alias("id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"), F.col("user_id").alias("run_id"), F.floor(F.col("value") * 100).cast("long").alias("b"))
        return e.select("id", "ts", "run_id", F.count("*").over(w).alias("pages"), F.sum("b").over(w).alias("bytes"))

    @property
    def sightings(self) -> DataFrame:
        """Link sightings between domains: src, dst, seen_at."""
        l, o = self.table("lineitem"), self.table("orders")
        return l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select((F.col("l_suppkey") % 89 + 1).alias("src"), (F.col("o_custkey") % 97 + 1).alias("dst"), F.unix_millis(F.col("l_shipdate").cast("timestamp")).alias("seen_at"))

    @property
    def edges(self) -> DataFrame:
        from heronry.operators.aggregates import edge_weights

        return edge_weights(self.sightings)

    @property
    def links(self) -> DataFrame:
        """Links between pages: src_page_id, dst_url, anchor, link_score (null: not to be followed)."""
        p, q = self.pages.select("id", "kind"), self.pages.select(F.col("id").alias("qid"), F.col("url").alias("dst_url"))
        hop = p.select("id", "kind", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("k")).withColumn("qid", (F.col("id") * 7 + F.col("k") * 13) % 599 + 1)
        score = F.when((F.col("id") + F.col("k")) % 11 == 0, None).otherwise(((F.col("id") * 31 + F.col("k") * 17) % 900) / 10.0)
        return hop.join(q, "qid").select(F.col("id").alias("src_page_id"), "dst_url", F.concat(F.lit("go "), F.col("k")).alias("anchor"), score.alias("link_score"))

    @property
    def frontier(self) -> DataFrame:
        """Crawl queue: url, host, domain_id, score, depth, state, enqueued_at, attempts, profile_boost."""
        from heronry.functions.urls import host

        p = self.pages
        state = F.try_element_at(F.array(*map(F.lit, ("queued", "queued", "in_flight", "done", "deferred"))), (F.col("id") % 5 + 1).cast("int"))
        return p.select("url", host("url").alias("host"), "domain_id", ((F.col("id") * 37 % 1000) / 10.0).alias("score"), (F.col("id") % 6).alias("depth"), state.alias("state"), F.coalesce("fetched_at", F.lit(0)).alias("enqueued_at"), (F.col("id") % 3).alias("attempts"), ((F.col("id") % 4) * 1.5).alias("profile_boost"))

    @property
    def boards(self) -> DataFrame:
        """Job boards: key, vendor, token, domain_id, first_seen, job_count."""
        j = self.jobs.where("board_key is not null")
        return j.groupBy(F.col("board_key").alias("key")).agg(F.max("domain_id").alias("domain_id"), F.min("first_seen").alias("first_seen"), F.count("*").alias("job_count")).withColumn("vendor", F.substring_index("key", "/", 1)).withColumn("token", F.substring_index("key", "/", -1))

    @property
    def matches(self) -> DataFrame:
        """Current match of each profile and posting."""
        from heronry.operators.merge import latest_per_key

        return latest_per_key(self.job_matches.where("profile_id is not null and job_id is not null"), ["profile_id", "job_id"], [F.col("computed_at"), F.col("score"), F.col("ingested_at")]).select("profile_id", "job_id", "score", "reasons", "computed_at")

    @property
    def facts(self) -> DataFrame:
        """Postings with what search and matching read: coordinates, pay in dollars a year, remote regions."""
        from heronry.functions.enrich import remote_mode_of, remote_regions
        from heronry.functions.measures import normalized_pay
        from heronry.functions.text import salary_period

        j = self.jobs
        pay = normalized_pay("salary_min", "salary_max", "salary_currency", salary_period("salary_period"))["usd_annual"]
        placed = F.col("id") % 7 != 0
        return j.withColumns({"salary_usd_annual": pay, "lat": F.when(placed, (F.col("id") * 13 % 1700) / 10.0 - 85), "lon": F.when(placed, (F.col("id") * 29 % 3500) / 10.0 - 175), "remote_regions": F.when(F.coalesce("remote_mode", remote_mode_of("location")) == "remote", remote_regions("location", "country_code")).otherwise(F.array().cast("array<string>"))})


#: The derived tables for the oracle; those used first stand first.
VIEWS = {
    "log": """SELECT event_id AS id, epoch_us(ts) // 1000 AS ts,
      CASE event_type WHEN 'signup' THEN 'crawler_started' WHEN 'error' THEN 'crawler_stopped' WHEN 'view' THEN 'page_fetched' WHEN 'click' THEN 'domain_classified' ELSE 'jobs_found' END AS kind,
      'd' || user_id AS host, CASE WHEN value >= 20 THEN 'company' WHEN value >= 5 THEN 'probing' ELSE 'not_company' END AS status,
      CAST(json_extract_string(props, '$.k') AS BIGINT) AS new, 'r' || (CAST(json_extract_string(props, '$.k') AS BIGINT) % 5) AS reason, value FROM events""",
    "samples": """SELECT event_id AS id, epoch_us(ts) // 1000 AS ts, user_id AS run_id, count(*) OVER w AS pages, CAST(sum(CAST(floor(value * 100) AS BIGINT)) OVER w AS BIGINT) AS bytes
      FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)""",
    "sightings": "SELECT l_suppkey % 89 + 1 AS src, o_custkey % 97 + 1 AS dst, epoch_us(l_shipdate) // 1000 AS seen_at FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "edges": "SELECT src AS src_domain_id, dst AS dst_domain_id, count(*) AS weight, min(seen_at) AS first_seen FROM sightings WHERE src <> dst GROUP BY src, dst",
    "links": """SELECT p.id AS src_page_id, q.url AS dst_url, 'go ' || k AS anchor, CASE WHEN (p.id + k) % 11 = 0 THEN NULL ELSE ((p.id * 31 + k * 17) % 900) / 10.0::DOUBLE END AS link_score
      FROM parsed_pages p, range(1, 5) t(k), parsed_pages q WHERE q.id = (p.id * 7 + k * 13) % 599 + 1""",
    "frontier": r"""SELECT url, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1)) AS host, domain_id, (id * 37 % 1000) / 10.0::DOUBLE AS score, id % 6 AS depth,
      ['queued', 'queued', 'in_flight', 'done', 'deferred'][id % 5 + 1] AS state, coalesce(fetched_at, 0) AS enqueued_at, id % 3 AS attempts, (id % 4) * 1.5::DOUBLE AS profile_boost FROM parsed_pages""",
    "boards": "SELECT board_key AS key, max(domain_id) AS domain_id, min(first_seen) AS first_seen, count(*) AS job_count, split_part(board_key, '/', 1) AS vendor, split_part(board_key, '/', 2) AS token FROM jobs WHERE board_key IS NOT NULL GROUP BY board_key",
    "matches": """SELECT profile_id, job_id, score, reasons, computed_at FROM job_matches WHERE profile_id IS NOT NULL AND job_id IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY profile_id, job_id ORDER BY computed_at DESC NULLS LAST, score DESC NULLS LAST, ingested_at DESC NULLS LAST) = 1""",
}


def _facts_sql() -> str:
    from heronry.functions.enrich import REGIONS
    from heronry.functions.measures import USD_PER_UNIT

    rates = ", ".join(f"'{k}': {v}::DOUBLE" for k, v in USD_PER_UNIT.items())
    named = ", ".join(f"CASE WHEN {has_word_sql('lw', k)} THEN '{v}' END" for k, v in REGIONS)
    return f"""SELECT j.*, CASE WHEN usd BETWEEN 1000 AND 5000000 THEN usd END AS salary_usd_annual,
      CASE WHEN id % 7 <> 0 THEN (id * 13 % 1700) / 10.0::DOUBLE - 85 END AS lat, CASE WHEN id % 7 <> 0 THEN (id * 29 % 3500) / 10.0::DOUBLE - 175 END AS lon,
      CASE WHEN coalesce(remote_mode, CASE WHEN {has_word_sql('lw', 'hybrid')} THEN 'hybrid' WHEN {has_word_sql('lw', 'remote')} OR {has_word_sql('lw', 'anywhere')} OR {has_word_sql('lw', 'worldwide')} THEN 'remote' END) = 'remote'
        THEN list_distinct(list_filter([{named}, country_code], lambda x: x IS NOT NULL)) ELSE [] END AS remote_regions
      FROM (SELECT *, coalesce((lo + hi) / 2, lo, hi) * (map {{{rates}}})[upper(trim(salary_currency))] AS usd, {words_sql("coalesce(location, '')")} AS lw
        FROM (SELECT *, CASE WHEN salary_min > 0 THEN salary_min * f END AS lo, CASE WHEN salary_max > 0 THEN salary_max * g END AS hi
          FROM (SELECT *, coalesce(pf, CASE WHEN salary_min < 1000 THEN 2080 ELSE 1 END) AS f, coalesce(pf, CASE WHEN salary_max < 1000 THEN 2080 ELSE 1 END) AS g
            FROM (SELECT *, CASE WHEN p LIKE '%year%' OR p LIKE '%annual%' THEN 1 WHEN p LIKE '%month%' THEN 12 WHEN p LIKE '%week%' THEN 52 WHEN p LIKE '%day%' THEN 260 WHEN p LIKE '%hour%' THEN 2080 END AS pf
              FROM (SELECT *, lower(salary_period) AS p FROM jobs))))) j"""


def words_sql(c: str) -> str:
    return rf"trim(regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


def has_word_sql(t: str, keyword: str) -> str:
    whole = " " in keyword or len(keyword.encode()) <= 3
    return f"contains(' ' || {t} || ' ', ' {keyword}{' ' if whole else ''}')"


def first_match_sql(t: str, table) -> str:
    return "CASE " + " ".join(f"WHEN {' OR '.join(has_word_sql(t, k) for k in ks)} THEN '{n}'" for n, ks in table) + " END"


def sql(text: str, *views: str) -> str:
    """`text` with the derived tables it uses before it."""
    need = {"edges": ("sightings",)}
    names = list(dict.fromkeys(x for v in views for x in (*need.get(v, ()), v)))
    if not names:
        return text
    body = ",\n".join(f"{n} AS ({_facts_sql() if n == 'facts' else VIEWS[n]})" for n in names)
    return f"WITH {body},\n{text[5:]}" if text.lstrip().upper().startswith("WITH ") else f"WITH {body}\n{text}"


def registry() -> tuple[dict, dict, Callable]:
    """(QUERIES, SQL, query): `@query(name, oracle)` registers a function of the model."""
    queries: dict[str, Callable] = {}
    oracles: dict[str, str] = {}

    def query(name: str, oracle: str | None = None, *views: str):
        def add(f: Callable[[Model], DataFrame]) -> Callable:
            queries[name] = lambda spark, sf_dir: f(Model(spark, sf_dir))
            if oracle:
                oracles[name] = sql(oracle.strip(), *views)
            return f

        return add

    return queries, oracles, query
