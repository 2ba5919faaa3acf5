"""Model answers, visits, the service's questions and shared storage."""

import os

import pytest
from pyspark.sql import functions as F

from heronry.api import Api
from heronry.operators import answers, visits
from heronry.operators.search import JobQuery
from heronry.plans.model import NOW, Model
from heronry.session import checkpoint_dir, cut


def test_verdicts(spark):
    d = spark.createDataFrame([(1, "a", None, "probing", None, None), (2, "b", "B", "probing", "x", "US"), (3, "c", None, "company", None, None), (4, "d", None, "probing", None, None)], "id long, host string, name string, status string, industry string, hq_country string")
    a = spark.createDataFrame([(1, True, " " + "n" * 200, " FinTech ", "de", 0.9, "r"), (2, False, "Other", "", "Germany", 0.7, "r"), (3, False, None, None, None, 1.0, None), (4, True, "X", None, None, float("nan"), None)], "domain_id long, is_company boolean, company_name string, industry string, hq_country string, confidence double, reason string")
    got = {r.id: r for r in answers.apply_verdicts(d, a).collect()}
    assert (got[1].status, len(got[1].name), got[1].industry, got[1].hq_country) == ("company", 120, "fintech", "DE")
    assert (got[2].status, got[2].name, got[2].industry, got[2].hq_country) == ("not_company", "B", "x", "US")
    assert got[3].status == "company" and got[4].status == "probing" and got[4].name == "X"


def test_merged_enrichment(spark):
    cols = "id long, category string, seniority string, skills array<string>, remote_mode string, remote_regions array<string>, city string, country_code string"
    found = spark.createDataFrame([(1, "data", None, ["sql"], None, [], None, None), (2, None, None, [f"s{k}" for k in range(12)], "onsite", [], None, "NG"), (3, None, None, None, None, None, None, None)], cols)
    said = spark.createDataFrame([(1, "sales", "Senior", ["SQL", " Rust ", "x" * 50], "Remote", ["emea", "moon", "ng"], "Lagos", "ng"), (2, "no such", "x", ["more"], "hybrid", ["emea"], "Lagos", "gh")], cols)
    got = {r.id: r for r in answers.merge_enrichment(found, said).collect()}
    assert (got[1].category, got[1].seniority, got[1].skills, got[1].remote_mode, got[1].remote_regions, got[1].city, got[1].country_code) == ("data", "senior", ["sql", "rust"], "remote", ["EMEA", "NG"], "Lagos", "NG")
    assert got[2].category is None and len(got[2].skills) == 12 and got[2].remote_regions == [] and (got[2].city, got[2].country_code) == (None, "NG") and got[3].skills == []


def test_patches():
    assert answers.patched({"titles": ["a"], "remote": "hybrid"}, {"titles": None, "skills": [" Rust ", {"name": "SQL", "weight": 7}], "relocate": True, "years_experience": 3}) == {"remote": "hybrid", "skills": {"rust": 0.6, "sql": 1.0}, "relocate": True, "years_experience": 3.0}
    for bad in ({"nope": 1}, {"nope": None}, {"titles": "x"}, {"relocate": 1}, {"years_experience": -1}, {"seniority": "king"}):
        with pytest.raises(ValueError):
            answers.patched({}, bad)


def test_boards_and_visits(spark):
    jobs = spark.createDataFrame([("u1", "A", 1, "k", 1, 1, None), ("u2", "B", 1, "k", 1, 1, None)], "url string, title string, domain_id long, board_key string, first_seen long, last_seen long, closed_at long")
    after, event = visits.record_board(jobs, spark.createDataFrame([("u2", "B"), ("u3", "C")], "url string, title string"), "k", None, 9)
    e = event.first()
    assert (e.total, e.new, e.closed) == (2, 1, 1) and {r.url: (r.closed_at, r.domain_id) for r in after.collect()} == {"u1": (9, 1), "u2": (None, 1), "u3": (None, None)}
    pages = spark.createDataFrame([("a/1", "a", "home", 200, "h1", None, 1)], "url string, host string, kind string, http_status int, content_hash string, error string, fetched_at long")
    v = spark.createDataFrame([(1, "a/2", "a", "job", 200, "h1", None), (2, "b/1", "b", "home", 200, "h1", None), (3, "b/1", "b", None, 500, None, "boom")], "seq long, url string, host string, kind string, http_status int, content_hash string, error string")
    p, d, ev = visits.record(pages, spark.createDataFrame([("a", "company", 0)], "host string, status string, first_seen long"), v, 5)
    assert {r.url: r.kind for r in p.collect()} == {"a/1": "home", "a/2": "duplicate", "b/1": None}
    assert {r.host: r.status for r in d.collect()} == {"a": "company", "b": "discovered"} and sorted(r.kind for r in ev.collect()) == ["fetch_failed", "page_fetched"]


def test_api(spark, small):
    api = Api(Model(spark, small), NOW)
    assert api.stats()[0].first().jobs > 0 and api.graph(limit=5)[0].count() == 5 and api.events(limit=3).count() == 3 and api.metrics().count() == 1
    assert api.companies(limit=4)[1].count() == 4 and api.history(10)[1].count() > 0 and api.places("San").count() > 0 and api.metrics_history(0, NOW, 10**12).count() == 1
    hits, notes, sort = api.search_text("engineer for our team")
    assert sort == "relevance" and hits.count() > 0
    assert api.search(JobQuery(sort="match"))[2] == "recent" and api.matches(3)[0].first().total >= 0 and api.facets(3)[1].count() == 1
    host = api.m.domains.first().host
    assert api.domain(host)["counts"].count() == 1 and api.domain("none.example")["domain"].count() == 0


def test_checkpoints_end_lineage(spark):
    folder = checkpoint_dir(spark)
    df = cut(spark.range(10).withColumn("x", F.col("id") * 2))
    assert df.count() == 10 and "LogicalRDD" in df._jdf.queryExecution().logical().toString() and folder
    assert os.path.isdir(folder.replace("file:", "").replace("//", "/"))
