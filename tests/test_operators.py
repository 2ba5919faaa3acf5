"""Operators on hand-made tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from heronry.operators import aggregates, catalog, fulltext, graph, matching, merge, search, sequences, timeline, units
from heronry.streaming import live

DOMAINS = "id long, host string, name string, status string, company_score double, careers_url string, industry string, first_seen long"


def _site(spark):
    d = spark.createDataFrame([(1, "acme.com", "Acme", "company", 0.9, "https://acme.com/careers", "fintech", 0), (2, "vc.com", None, "company", 0.8, None, "Financial Services", 0), (3, "linked.com", None, "discovered", None, None, None, 50)], DOMAINS)
    p = spark.createDataFrame([(1, "https://acme.com/", 1, "home", 1, None), (2, "https://acme.com/careers", 1, "careers", 2, None), (3, "https://vc.com/", 2, "home", 3, None)], "id long, url string, domain_id long, kind string, fetched_at long, error string")
    e = spark.createDataFrame([(2, 1, 3, 1), (2, 3, 1, 50)], "src_domain_id long, dst_domain_id long, weight long, first_seen long")
    j = spark.createDataFrame([(1, 1, 5, None), (2, 1, 5, 9)], "id long, domain_id long, first_seen long, closed_at long")
    return d, p, j, e


def test_graph_and_replay(spark):
    d, p, j, e = _site(spark)
    log = spark.createDataFrame([(1, 1, "domain_classified", "acme.com", "probing"), (2, 2, "domain_classified", "acme.com", "company"), (3, 3, "domain_classified", "vc.com", "company")], "id long, ts long, kind string, host string, status string")
    n, ed, c = graph.domain_graph(d, p, j, e)
    assert [r.host for r in n.collect()] == ["acme.com", "vc.com", "linked.com"] and n.first().jobs == 1 and ed.count() == 2
    n, ed, _ = graph.domain_graph(d, p, j, e, include_discovered=False)
    assert n.count() == 2 and ed.count() == 1
    assert sum(graph.domain_graph(d, p, j, e, limit=1, offset=k)[1].count() for k in range(3)) == 2
    n, _, c = graph.domain_graph(d, p, j, e, log, at=1)
    assert {r.host: (r.status, r.pages) for r in n.collect()} == {"acme.com": ("probing", 1), "vc.com": ("discovered", 0)} and c.first().companies == 0
    _, _, c = graph.domain_graph(d, p, j, e, log, at=10)
    assert (c.first().companies, c.first().pages, c.first().domains) == (2, 3, 2)
    assert {r.id for r in graph.neighbourhood(e, 1).collect()} == {1, 2}


def test_page_graph(spark):
    d, p, j, e = _site(spark)
    links = spark.createDataFrame([(1, "https://acme.com/careers"), (1, "https://acme.com/about"), (1, "https://blog.acme.com/"), (1, "https://vc.com/a"), (2, "https://vc.com/b")], "src_page_id long, dst_url string")
    f = spark.createDataFrame([("https://acme.com/about", "deferred")], "url string, state string")
    nodes, edges = graph.page_graph(p, links, f, 1, "acme.com")
    got = {r["key"]: (r.kind, r.state) for r in nodes.collect()}
    assert got["https://acme.com/about"] == ("pending", "deferred") and got["https://blog.acme.com/"] == ("pending", None) and got["vc.com"] == ("external", None) and edges.count() == 5


def test_runs_and_history(spark):
    rows = [(1, 1000, "crawler_started", None, None), (2, 2000, "page_fetched", None, None), (3, 3000, "crawler_stopped", "max_pages", None), (4, 3500, "crawler_stopped", "again", None), (5, 10000, "crawler_started", None, None), (6, 11000, "page_fetched", None, None)]
    log = spark.createDataFrame(rows, "id long, ts long, kind string, reason string, new long")
    runs, act = timeline.history(log, 10, 20000)
    assert [tuple(r) for r in runs.orderBy("id").collect()] == [(1, 1000, 3000, "max_pages"), (5, 10000, None, None)]
    assert act.agg(F.sum("pages")).first()[0] == 2
    assert [r.kind for r in timeline.events(log, before=2500).collect()] == ["crawler_started", "page_fetched"]
    assert sequences.next_start(runs, 1000).first().t == 10000 and sequences.next_start(runs, 10000).first().t is None


def test_metrics(spark):
    s = spark.createDataFrame([(i, i * 1000, 1 + (i > 6), i, i * 100) for i in range(10)], "id long, ts long, run_id long, pages long, bytes long")
    assert [r.ts for r in aggregates.downsample(s, 0, 10_000, 5000).orderBy("ts").collect()] == [4000, 9000]
    r = {x.id: (x.bytes_per_sec, x.pages_per_sec) for x in sequences.rates(s, ["bytes", "pages"]).collect()}
    assert r[1] == (100.0, 1.0) and r[0] == (None, None) and r[7] == (None, None)


def test_frontier(spark):
    rows = [("a/low", 1.0, "a.com", "queued", 1), ("a/high", 50.0, "a.com", "queued", 2), ("b", 30.0, "b.com", "queued", 3), ("jobs.b", 40.0, "jobs.b.com", "queued", 4), ("c", 60.0, "c.com", "queued", 5), ("d", 99.0, "d.com", "done", 6)]
    f = spark.createDataFrame(rows, "url string, score double, host string, state string, enqueued_at long").withColumn("attempts", F.lit(0))
    assert [r.url for r in sequences.best_per_host(f, 10, ["c.com"]).collect()] == ["a/high", "jobs.b", "b"]
    r = merge.retry(f, f.where("url = 'jobs.b'")).where("url = 'jobs.b'").first()
    assert (r.score, r.attempts, r.state) == (20.0, 1, "queued")
    up = merge.enqueue(f, spark.createDataFrame([("b", 70.0), ("d", 200.0), ("e", 5.0), ("e", 6.0)], "url string, score double"))
    assert {x.url: x.score for x in up.collect()} | {} == {"a/low": 1, "a/high": 50, "b": 70, "jobs.b": 40, "c": 60, "d": 99, "e": 6}


def test_job_lifecycle(spark):
    cols = "url string, title string, board_key string, first_seen long, last_seen long, closed_at long"
    cur = spark.createDataFrame([("u1", "Old", "b", 10, 10, None), ("u2", "X", "b", 10, 10, 15)], cols)
    seen = spark.createDataFrame([("u1", "New", None), ("u2", "X", None), ("u3", "Y", "b"), ("u3", "Y", "b")], "url string, title string, board_key string")
    out = {r.url: r for r in merge.upsert_jobs(cur, seen, 20).collect()}
    assert (out["u1"].title, out["u1"].board_key, out["u1"].first_seen, out["u1"].last_seen, out["u1"].is_new, out["u1"].unchanged) == ("New", "b", 10, 20, False, False)
    assert out["u2"].closed_at is None and out["u2"].unchanged and out["u3"].is_new and out["u3"].first_seen == 20
    closed = merge.close_missing(cur, spark.createDataFrame([("zz",)], "url string"), "b", 30)
    assert {r.url: r.closed_at for r in closed.collect()} == {"u1": 30, "u2": 15}


def test_search(spark):
    d, *_ = _site(spark)
    cols = "id long, title string, description string, skills string, category string, domain_id long, posted_at long, first_seen long, closed_at long, remote_mode string, remote_regions array<string>, lat double, lon double, country_code string, salary_usd_annual double"
    day = 86_400_000
    now = 100 * day
    j = spark.createDataFrame([
        (1, "Rust developer", "sourdough", None, "engineering", 1, now - 10 * day, 0, None, None, None, 6.45, 3.39, "NG", 10_000.0), (2, "Baker", "Sourdough bread", None, "operations", 2, now - 5 * day, 0, None, "remote", ["NG"], None, None, None, 40_000.0),
        (3, "Analyst", None, None, "data", 2, None, now - day, None, "remote", ["EMEA"], None, None, None, None), (4, "Closed", None, None, "data", 1, now, 0, 5, None, None, None, None, None, 90_000.0),
    ], cols)
    ids = lambda q, **k: [r.id for r in search.run(j, d, q, now, **k)[0].collect()]
    Q = search.JobQuery
    assert ids(Q(keywords=["rust"])) == [1] and sorted(ids(Q(keywords=["sourdough"]))) == [1, 2] and ids(Q(keywords=["none"])) == []
    assert ids(Q(industries=["financial"])) == [3, 2] and ids(Q(posted_within_days=7)) == [3, 2]
    assert ids(Q(salary_mode="top_percentile", salary_value=0.25)) == [2] and ids(Q(salary_mode="min_usd", salary_value=5000, sort="salary_desc")) == [2, 1]
    assert ids(Q(sort="salary_desc")) == [2, 1, 3] and ids(Q()) == [3, 2, 1]
    q, notes = search.sanitized(Q(keywords=[f"k{i}" for i in range(10)], categories=["nope", "data"], near=" ", radius_km=9999, remote="x", limit=5000, posted_within_days=99999))
    assert len(q.keywords) == 8 and q.categories == ["data"] and q.limit == 200 and q.posted_within_days == 3650 and len(notes) == 4


def _near(spark, jobs):
    """(facts, domains, places): postings (id, lat, lon, country, mode) by time of id; Here lies at 10, 20 in Japan."""
    cols = "id long, title string, domain_id long, lat double, lon double, country_code string, remote_mode string, remote_regions array<string>, posted_at long, first_seen long, closed_at long"
    j = spark.createDataFrame([(i, "x", 1, lat, lon, land, mode, [], i, 0, None) for i, lat, lon, land, mode in jobs], cols)
    d = spark.createDataFrame([(1, "a.example", None, None)], "id long, host string, name string, industry string")
    p = spark.createDataFrame([(1, "Here", "JP", None, None, 10.0, 20.0, None), (2, None, "JP", None, "Japan", None, None, None)], "place_id long, city string, country_code string, region string, country_name string, lat double, lon double, alt_names string")
    return j, d, p


def test_search_near_a_place_that_is_not_listed(spark):
    j, d, p = _near(spark, [(1, 10.0, 20.0, "JP", None), (2, None, None, "JP", None), (3, 50.0, 50.0, "FR", None), (4, 50.0, 50.0, "FR", "remote")])
    found = lambda near, **k: {r.id: r.distance_km for r in search.run(j, d, search.JobQuery(near=near, radius_km=50, sort="recent"), 9, places=p, **k)[0].collect()}
    assert found("Here, Japan") == {1: 0.0, 2: None} == found("Here, Japan", placed_only=True)
    assert found("There, Japan") == {1: None, 2: None, 4: None} and found("There") == dict.fromkeys([1, 2, 3, 4])
    assert found("There, Japan", placed_only=True) == {} == found("There", placed_only=True)


def test_search_near_looks_at_all_in_the_box(spark):
    """3,000 newer postings in the corners of the box, outside the circle, don't hide the older ones inside."""
    j, d, p = _near(spark, [(1, 10.0, 20.0, "JP", None), (2, None, None, "JP", None)] + [(i, 10.44, 20.45, "JP", None) for i in range(3, 3003)])
    found = search.run(j, d, search.JobQuery(near="Here, Japan", radius_km=50, sort="recent"), 9, places=p)[0]
    assert [(r.id, r.distance_km) for r in found.collect()] == [(2, None), (1, 0.0)]


def test_bm25_order(spark):
    j = spark.createDataFrame([(1, "rust", "a b c"), (2, "other", "rust rust"), (3, "x", "y")], "id long, title string, description string")
    r = fulltext.bm25(j, {"title": F.col("title"), "description": F.col("description")}, ["Rust"]).orderBy(F.desc("relevance")).collect()
    assert [x.id for x in r] == [1, 2]


def test_matching(spark):
    cols = "id long, title string, company string, host string, description string, category string, seniority string, skill_list array<string>, lat double, lon double, country_code string, remote_mode string, remote_regions array<string>, salary_usd_annual double"
    j = spark.createDataFrame([(1, "Senior Backend Engineer", "Good", "good.com", "rust", "engineering", "senior", ["rust", "sql"], 6.5, 3.4, "NG", None, None, 70_000.0), (2, "Sales Director", "Big", "big.com", "", "sales", "director", ["excel"], 40.7, -74.0, "US", None, None, 20_000.0), (3, "x", None, None, None, None, None, None, None, None, None, None, None, None)], cols)
    p = matching.Profile(titles=["Backend Engineer"], seniority="senior", skills={"rust": 1.0, "sql": 0.5, "aws": 0.5}, locations=[matching.Place("Lagos", "NG", 6.45, 3.39)], salary_usd=60_000.0)
    s = {r.id: r.score for r in matching.score(j, p).collect()}
    assert s[1] > 0.9 and s[2] < 0.3
    assert abs(matching.score(j, matching.Profile()).where("id = 3").first().score - 0.5) < 1e-12
    q = matching.merged(p, {"exclude": ["RUST "], "years": None})
    assert matching.score(j, q).where("id = 1").first().score == 0.0
    capped = matching.score(j, matching.merged(p, {"must_have": ["cobol"]})).where("id = 1").first()
    assert capped.score <= 0.35 and capped.reasons[-1] == "missing must-have: cobol"


def test_companies(spark):
    d, p, j, e = _site(spark)
    total, page = catalog.companies(d, j, p)
    assert total.first().total == 3 and page.first().host == "acme.com"
    assert catalog.companies(d, j, p, has_jobs=True)[0].first().total == 1 and catalog.companies(d, j, p, has_careers=False)[0].first().total == 2
    assert catalog.companies(d, j, p, q="%")[0].first().total == 0


def test_streams_equal_batches(spark, tmp_path):
    src = str(tmp_path / "events")
    rows = spark.range(300).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 600).cast("timestamp_ntz").alias("ts"), (F.col("id") % 7).alias("user_id"), F.lit("view").alias("event_type"), (F.col("id") * 1.5).alias("value"), F.lit("{}").alias("props"))
    for k in range(3):
        rows.where(f"event_id div 100 = {k}").coalesce(1).write.mode("append").parquet(src)
    got = live.carried_rates(live.tail(spark, src, files=1), f"t{tmp_path.name.replace('-', '_')}")
    assert live.run_once(live.latest_status(live.tail(spark, src, files=1)), "s" + tmp_path.name, keys=["user_id"]).count() == len({r.user_id for r in spark.read.parquet(src).collect()})
    whole = spark.read.parquet(src).withColumn("at", F.col("ts").cast("timestamp")).groupBy("user_id", F.session_window("at", "6 hours")).agg(F.count("*").alias("n"))
    assert sorted((r.user_id, r.n) for r in live.run_once(live.sessions(live.tail(spark, src, files=1)), "w" + tmp_path.name, whole=True).collect()) == sorted((r.user_id, r.n) for r in whole.collect())
    assert live.carried_rates(live.tail(spark, src, after=10**9), "none" + tmp_path.name).count() == 0
    assert got.count() == 300 - 7
    target = str(tmp_path / "snap")
    live.run_once(live.tail(spark, src, files=1), "snap" + tmp_path.name, each=live.merge_batch(target, ["user_id"], "event_id"))
    import os

    last = max(os.listdir(target), key=lambda x: int(x.split("=")[1]))
    snap = spark.read.parquet(f"{target}/{last}")
    assert sorted(r.event_id for r in snap.collect()) == list(range(293, 300))
    assert live.lagged(10, 600, 500) == {"type": "lagged", "skipped": 90} and live.lagged(10, 20, 500) is None


# --- pay in one unit ------------------------------------------------------------------------------------------------------

JOBS = "id long, board_key string, source string, posted_at long, first_seen long, salary_min double, salary_max double, salary_currency string, salary_period string, description string, history string"
RATES = [("USD", 1.0, "US dollar"), ("EUR", 1.1, "euro"), ("INR", 0.0118, "Indian rupee"), ("CZK", 0.044, "Czech koruna")]


def _usd(spark, rows, rates=RATES):
    j = spark.createDataFrame([(i, None, "s", None, i, *r, "clash") for i, r in enumerate(rows)], JOBS)
    f = spark.createDataFrame(rates, "currency string, usd_per_unit double, currency_name string")
    return {r.id: (round(r.usd_year, 2), r.how) for r in units.to_common_unit(j, f).collect()}


def test_stated_units(spark):
    rows = [
        (30_000.0, 50_000.0, "usd ", "Annual", None), (10.0, None, "€", "per hour", ""), (4.0, 5.0, "USD", "year", "Pay range is given in k."), (5e6, None, "USD", "year", "<p>Amounts are in minor units (1/100).</p>"),
        (40_000.0, None, None, None, "Figures&nbsp; are in euro. Pay is quoted per year."), (None, None, None, None, "We offer 31–46 lakh INR per year, depending on experience."), (None, None, None, None, "Referral bonus: $1,500 a year. Free lunch worth $12 a day."),
        (None, None, None, None, "Gehalt: 2.000 bis 3.000 € brutto im Monat."), (0.0, 0.0, "EUR", "year", None), (50.0, None, "XXX", "hour", None), (float("nan"), None, "USD", "year", "Pay: USD 80k - 90k p.a.."), (None, None, None, None, "You can expect 5,200 to 6,300 Kč a day."), (9e9, 9e9, "USD", "year", None), (None, None, None, None, None),
    ]
    got = _usd(spark, rows)
    assert got == {0: (40_000.0, "fields"), 1: (22_880.0, "fields"), 2: (4_500.0, "scaled"), 3: (50_000.0, "scaled"), 4: (44_000.0, "fields"), 5: (45_430.0, "text"), 7: (33_000.0, "text"), 10: (85_000.0, "text"), 11: (round(5750 * 0.044 * 260, 2), "text")}
    assert _usd(spark, rows, []) == {} and _usd(spark, []) == {}


@pytest.mark.parametrize("piece", [10, 4000])
def test_changepoints(spark, monkeypatch, piece):
    monkeypatch.setattr(units, "PIECE", piece)
    rng = np.random.default_rng(1)
    level = np.exp(rng.normal(11, 0.4, 60))
    rows = [(float(v / 1000 if 20 <= i < 35 else v), None, "USD", "year", None) for i, v in enumerate(level)]
    got = _usd(spark, rows)
    assert {i for i, (_, how) in got.items() if how == "segment"} == set(range(20, 35))
    assert all(abs(got[i][0] - level[i]) < 0.01 * level[i] for i in range(60))


def test_segments_are_exact():
    def brute(x, spread, penalty):
        n = len(x)
        cost = lambda a, b: float(((x[a:b] - x[a:b].mean()) ** 2).sum() / spread**2)
        best = {0: (-penalty, [])}
        for j in range(1, n + 1):
            best[j] = min((best[i][0] + cost(i, j) + penalty, best[i][1] + [i]) for i in range(j))
        return best[n][0], best[n][1]

    rng = np.random.default_rng(2)
    for _ in range(20):
        x = np.concatenate([rng.normal(m, 0.5, rng.integers(1, 8)) for m in rng.normal(0, 4, 4)])
        want, _ = brute(x, 0.8, 6.0)
        s = units.segments(x, 0.8, 6.0)
        got = sum(float(((x[a:b] - x[a:b].mean()) ** 2).sum()) / 0.64 + 6.0 for a, b in zip(s, [*s[1:], len(x)])) - 6.0
        assert abs(got - want) < 1e-6


def test_bands(spark):
    a = spark.createDataFrame([(1, 1000.0), (2, 9999.99), (3, 10_000.0), (4, 5.0), (5, None)], "id long, v double")
    b = spark.createDataFrame([(1, 1000.0, 10_000.0), (2, 10_000.0, 20_000.0)], "band_id long, usd_from double, usd_to double")
    assert {r.id: r.band_id for r in units.banded(a, b, "v").collect()} == {1: 1, 2: 1, 3: 2}


def _fold(spark, stored, pages):
    """The row of a domain stored as (status, score, home_seen) after pages of (score, parked, conclusive, home, name)."""
    from heronry.operators import visits

    d = spark.createDataFrame([(1, *stored, "Old" if stored[1] else None, "{}" if stored[1] else None)], "id long, status string, company_score double, home_seen boolean, name string, score_reasons string")
    p = spark.createDataFrame([(1, k, *x[:4], [str(k)], x[4]) for k, x in enumerate(pages)], "domain_id long, id long, score double, parked boolean, conclusive boolean, home boolean, reasons array<string>, name string")
    return visits.classify_update(d, p).first()


@pytest.mark.parametrize(
    "stored,pages,status,score",
    [
        (("probing", 0.5, False), [(0.2, False, True, True, "H")], "probing", 0.5), (("probing", None, False), [(0.2, False, True, True, "H")], "not_company", 0.2), (("probing", 0.2, True), [(0.1, False, True, False, None)], "not_company", 0.2),
        (("company", 0.7, True), [(0.1, True, True, True, None)], "company", 0.7), (("discovered", None, False), [(0.9, True, True, False, None)], "not_company", 0.9), (("discovered", None, False), [(0.9, True, True, False, None), (0.1, False, True, False, None)], "company", 0.9),
        (("discovered", None, False), [(0.1, True, True, False, None), (0.4, False, True, False, None)], "probing", 0.4), (("discovered", None, False), [(0.1, False, False, True, None)], "probing", 0.1), (("discovered", None, False), [(0.7, False, True, False, None), (0.1, True, True, False, None)], "company", 0.7),
        (("discovered", None, False), [(0.1, False, True, False, None), (0.7, True, True, False, None)], "not_company", 0.7), (("probing", 0.65, False), [(0.1, False, True, False, None)], "company", 0.65), (("probing", 0.5, False), [(None, None, None, None, None)], "probing", 0.5),
    ],
)
def test_a_domain_after_its_pages(spark, stored, pages, status, score):
    got = _fold(spark, stored, pages)
    assert (got.status, got.company_score) == (status, score)


def test_a_domain_keeps_names_and_reasons(spark):
    got = _fold(spark, ("probing", 0.5, False), [(0.2, False, True, False, "First"), (0.2, False, True, True, "Home"), (0.3, False, True, True, None)])
    assert (got.name, got.score_reasons, got.home_seen) == ("Home", "{}", True)
    got = _fold(spark, ("discovered", None, False), [(0.2, False, True, False, "First"), (0.2, False, True, False, "Second")])
    assert (got.name, got.score_reasons, got.home_seen) == ("First", '["1"]', False)


def test_reasons_of_a_match(spark):
    from heronry.operators import matching

    me = matching.Profile(titles=["Data Engineer"], skills={"SQL": 1.0}, years=3, locations=[matching.Place("Bonn", "DE", 50.7, 7.1), matching.Place("Kiel", "DE", 54.3, 10.1)], salary_usd=100.0, must_have=["x", "y"], exclude=["night"], excluded_companies=["Bad Co"])
    cols = "id long, title string, company string, host string, description string, category string, seniority string, skill_list array<string>, lat double, lon double, country_code string, remote_mode string, remote_regions array<string>, salary_usd_annual double"
    rows = [
        (1, "Senior Data Engineer", "A", None, "x and y", "data", "mid", ["sql", "go"], 54.3, 10.2, "DE", None, [], 90.0), (2, "Cook", None, None, None, "legal", None, ["go"], None, None, "FR", "onsite", None, 10.0), (3, "Cook", None, None, "night X", None, None, [], None, None, None, None, None, None),
        (4, "Data", "The BAD-CO group", None, "night", None, None, None, None, None, None, "remote", ["FR"], None), (5, "Engineer", "A", None, "x y", None, "odd", None, None, None, None, "remote", None, None), (6, None, None, "badco.example", None, None, None, None, None, None, None, None, None, None),
    ]
    got = {r.id: r.reasons for r in matching.score(spark.createDataFrame(rows, cols), me).collect()}
    level = me.level()
    assert got[1] == ["skills: sql (1/2)", "title: like Data Engineer"] + ([f"seniority: mid vs your {level}"] if level else []) + ["location: 6 km from Kiel", "salary: a little under your expectation"]
    assert got[2] == ["skills: none of 1 match", "category: legal is outside your titles", "location: FR", "salary: well under your expectation", "missing must-have: x, y"]
    assert got[3] == ['excluded: mentions "night"'] and got[4] == ["excluded company: Bad Co"] and got[6] == ["excluded company: Bad Co"]
    assert got[5] == ["title: close to Data Engineer", "remote"]


def test_boards_change(spark):
    from heronry.operators import boards

    b = spark.createDataFrame([("lever/a", "lever", "a", None, 1, None, None, None, "A"), ("lever/b", "lever", "b", 7, 1, None, None, 3, None)], "key string, vendor string, token string, domain_id long, first_seen long, last_fetched long, last_status string, job_count long, name string")
    jobs = spark.createDataFrame([(1, "lever/a", None), (2, "lever/a", 5), (3, "lever/b", None), (4, None, None)], "id long, board_key string, domain_id long")
    owners = spark.createDataFrame([("lever/a", 9), ("lever/a", 9), ("none/x", 8)], "key string, domain_id long")
    nb, nj = boards.attached(b, jobs, owners)
    assert {r.key: r.domain_id for r in nb.collect()} == {"lever/a": 9, "lever/b": 7} and {r.id: r.domain_id for r in nj.collect()} == {1: 9, 2: 5, 3: None, 4: None}
    d = spark.createDataFrame([(7, "lever", "b", "https://jobs.lever.co/b"), (9, "lever", "a", "https://x.example/"), (10, "lever", "b", None)], "id long, ats string, ats_token string, careers_url string")
    ub, ud = boards.detached(nb, d, nb.select("key"))
    assert {r.domain_id for r in ub.collect()} == {None} and {(r.id, r.ats, r.careers_url) for r in ud.collect()} == {(7, None, None), (9, None, "https://x.example/"), (10, "lever", None)}
    f = boards.fetched(b, spark.createDataFrame([("lever/a", "ok", 4, None), ("lever/b", "gone", None, "B")], "key string, status string, job_count long, name string"), 50)
    assert {(r.key, r.last_fetched, r.last_status, r.job_count, r.name) for r in f.collect()} == {("lever/a", 50, "ok", 4, "A"), ("lever/b", 50, "gone", 3, "B")}
    assert boards.attributed(spark.createDataFrame([(1, None, None, None)], "id long, domain string, links array<struct<url:string,text:string>>, embeds array<string>")).count() == 0


def test_text_index_follows_changes(spark, tmp_path):
    """Whatever is added, changed and taken out, a search finds what one without an index finds in the texts as they are."""
    from heronry.operators import fulltext

    texts = {1: ("Data Engineer", "data data engineer"), 2: ("Engineer of data", None), 3: ("", "x"), 4: ("Café data-engineer", "data engineer data engineer"), 5: (None, None)}
    cols = "id long, title string, description string"
    fields = {c: F.col(c) for c in ("title", "description")}
    rows = lambda t: spark.createDataFrame([(k, *v) for k, v in t.items()], cols)
    index = fulltext.TextIndex(spark, str(tmp_path / "i"), fields).add(rows(texts))

    def same(now: dict) -> None:
        for words in (["data engineer"], ["cafe", "engineer"], ["data", "nothing"], ["..."], []):
            found = {r.id for r in fulltext.hits(rows(now), fields, words).collect()}
            assert {r.doc_id for r in index.hits(words).collect()} == found
            want = {r.id: round(r.relevance, 9) for r in fulltext.bm25(rows(now), fields, words).collect()}
            assert {r.doc_id: round(r.relevance, 9) for r in index.ranked(words).collect()} == want

    same(texts)
    index.add(rows({2: ("Data engineer", "cafe"), 6: ("data", "engineer")}), rows({4: ("", "")}))
    same({k: v for k, v in texts.items() if k != 4} | {2: ("Data engineer", "cafe"), 6: ("data", "engineer")})
    plan = index.postings(["data"])._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [(bucket" in plan or "bucket" in plan.split("PartitionFilters")[1][:80]
