"""Scalar functions on literal cases."""

import pytest
from pyspark.sql import functions as F

from heronry.functions import cv, enrich, links, measures, text, urls
from heronry.sources import boards, files, gazetteer, pages


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def many(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i long, v {kind}")
    return [r[0] for r in df.select(f(F.col("v")).alias("o"), "i").orderBy("i").select("o").collect()]


def test_categories(spark):
    titles = ["Senior Data Engineer", "Security Engineer", "UX Designer", "Product Manager", "IT Support", "Customer Support Engineer", "Backend Engineer", "Account Executive", "Content Editor", "Payroll clerk", "Recruiter", "Legal counsel", "Office Manager", "Baker", None]
    want = ["data", "security", "design", "product", "it", "customer_support", "engineering", "sales", "marketing", "finance", "hr", "legal", "operations", None, None]
    assert many(spark, titles, lambda c: enrich.category(c, F.lit(None).cast("string"))) == want


def test_prefix_quirks(spark):
    assert many(spark, ["career coach", "international sales", "hr partner", "three"], lambda c: enrich.category(c, F.lit(None).cast("string"))) == ["customer_support", "sales", "hr", None]
    assert many(spark, ["International Trainee", "Sr Engineer", "VP Sales", "Head of People", "Lead"], enrich.seniority) == ["intern", "senior", "executive", "director", "lead"]


def test_skills(spark):
    r = one(spark, enrich.skills(F.lit("C++ and C# developer."), F.lit("Node.js, Google Cloud. Machine learning; PowerBI, go golang.")).alias("s"))
    assert r.s == ["go", "node.js", "c++", "c#", "gcp", "machine learning", "power bi"]
    n = one(spark, enrich.skill_counts(F.lit("sql SQL google cloud google cloud gcp rust.")).alias("s")).s
    assert {x.name: x["count"] for x in n} == {"sql": 2, "gcp": 2, "rust": 1}


def test_money(spark):
    df = spark.createDataFrame([(400_000.0, 600_000.0, "ngn", "month"), (50.0, None, "USD", None), (0.0, None, "USD", "year"), (10.0, None, "XXX", "hour"), (1e9, None, "USD", "year")], "lo double, hi double, c string, p string")
    got = [r[0].usd_annual for r in df.select(measures.normalized_pay("lo", "hi", "c", "p")).collect()]
    assert got[0] == pytest.approx(6e6 * 0.00065) and got[1] == 104_000 and got[2:] == [None, None, None]


def test_distance_and_box(spark):
    km = one(spark, measures.distance_km(F.lit(6.45), F.lit(3.39), F.lit(9.06), F.lit(7.49)).alias("d")).d
    assert 500 < km < 570
    none = one(spark, measures.distance_km(F.lit(None).cast("double"), F.lit(3.39), F.lit(9.06), F.lit(7.49)).alias("d")).d
    assert none is None
    s, n, w, e = measures.bbox(0, 0, 111.32)
    assert (round(s), round(n), round(w), round(e)) == (-1, 1, -1, 1)


def test_dates(spark):
    assert many(spark, ["2024-01-02T03:04:05Z", "2024-01-02T03:04:05", "2024-01-02 posted", "soon", None], measures.datetime_ms) == [1704164645000, 1704164645000, 1704153600000, None, None]


def test_urls(spark):
    given = ["HTTP://User:pw@Acme.COM:80/A;jsessionid=1?utm_source=x&b=2&a=1&ref=q#f", "https://acme.com", "https://acme.com:8443/x/", "nothing", None]
    assert many(spark, given, urls.normalize) == ["http://acme.com/A?a=1&b=2", "https://acme.com/", "https://acme.com:8443/x/", None, None]
    assert many(spark, ["https://careers.acme.co.uk/", "https://a.b.acme.com", "https://10.0.0.1/x", "https://localhost/"], urls.registrable_domain) == ["acme.co.uk", "acme.com", "10.0.0.1", None]
    base = F.lit("https://acme.com/a/b?x=1")
    assert many(spark, ["c", "/c", "../c", "//x.com/y", "?z=2", "#t", "mailto:a@b", "", " https://q.com "], lambda c: urls.resolve(base, c)) == ["https://acme.com/a/c", "https://acme.com/c", "https://acme.com/c", "https://x.com/y", "https://acme.com/a/b?z=2", None, None, None, "https://q.com/"]
    assert pages.resolve("https://acme.com/a/b?x=1", "../c") == "https://acme.com/c"


def test_boards(spark):
    given = ["https://jobs.lever.co/Acme/1", "https://boards.greenhouse.io/embed/job_board/js?for=Beta", "https://acme.wd5.myworkdayjobs.com/x", "https://help.bamboohr.com/", "https://acme.com/jobs"]
    assert many(spark, given, urls.board_key) == ["lever/acme", "greenhouse/beta", "workday/acme", None, None]
    r = one(spark, urls.matches_domain(F.lit("andurilindustries"), F.lit("anduril.com")).alias("a"), urls.matches_domain(F.lit("ab"), F.lit("abc.com")).alias("b"))
    assert r.a and not r.b


def test_link_scores(spark):
    f = lambda c: links.score_link(c, F.lit("Careers"), F.lit(False), F.lit("acme.com"), F.lit(1), F.lit(4), F.lit("company"))["score"]
    given = ["https://acme.com/careers", "https://jobs.lever.co/acme", "https://acme.com/blog/2023/05/x", "https://acme.com/a/a/a", "https://acme.com/x.pdf", "https://linkedin.com/x", "https://acme.com/login"]
    assert many(spark, given, f) == [10 + 60 + 10 - 2 - 2, 10 + 80 + 60 + 8 - 2 - 2, 10 + 40 - 8 - 4 + 10 - 2 - 2, None, None, None, None]


def test_text_helpers(spark):
    assert many(spark, ["FullTime", "Full-time", "fixed term", "Per Diem", "", None], text.employment_type) == ["full_time", "full_time", "temporary", "per_diem", None, None]
    assert many(spark, ["1 YEAR", "per-annual", "Hourly", "x", None], text.salary_period) == ["year", "year", "hour", None, None]
    assert many(spark, ['["a","b"]', "bad", None], text.json_list) == [["a", "b"], [], []]
    assert text.keyword_fallback("Find me a C++ job in the Berlin berlin area a b") == ["c++", "berlin", "area"]
    assert text.parse_json_reply('Sure:\n```json\n{"a": 1}\n```') == {"a": 1} and text.parse_json_reply("no") is None


def test_board_payloads(spark):
    g = '{"jobs":[{"id":1,"title":" Dev ","absolute_url":"https://x.com/1?utm_a=1","location":{"name":"Remote, US"},"departments":[{"name":""},{"name":"Eng"}],"first_published":"2024-01-02","content":"&lt;p&gt;Hi &amp;amp; you&lt;/p&gt;","pay_input_ranges":[{"min_cents":1000,"max_cents":2000,"currency_type":"USD","title":"Hourly"}]},{"title":"No url"}]}'
    r = boards.parse(spark.createDataFrame([(7, g)], "k long, body string"), "greenhouse").collect()
    assert len(r) == 1 and (r[0].k, r[0].url, r[0].title, r[0].remote_mode, r[0].department, r[0].description, r[0].salary_min, r[0].salary_period) == (7, "https://x.com/1", "Dev", "remote", "Eng", "Hi & you", 10.0, "hour")
    a = '{"jobs":[{"id":"a","title":"T","jobUrl":"https://x.com/2","isListed":false},{"id":"b","title":"T","jobUrl":"https://x.com/3","workplaceType":"Hybrid","compensation":{"summaryComponents":[{"compensationType":"Equity"},{"compensationType":"Salary","interval":"1 YEAR","currencyCode":"EUR","minValue":1.0,"maxValue":2.0}]}}]}'
    r = boards.parse(spark.createDataFrame([(a,), ("bad",), (None,)], "body string"), "ashby").collect()
    assert [(x.external_id, x.remote_mode, x.salary_period, x.salary_max) for x in r] == [("b", "hybrid", "year", 2.0)]
    v = '[{"id":"c","text":"T","hostedUrl":"https://x.com/4","categories":{"team":"","department":"D","commitment":"Part-time"},"createdAt":5,"country":"de"},{"text":"T","hostedUrl":"javascript:1"}]'
    r = boards.parse(spark.createDataFrame([(v,)], "body string"), "lever").collect()
    assert [(x.department, x.employment_type, x.country_code, x.posted_at, x.company) for x in r] == [("D", "part_time", "DE", 5, None)]


def test_html_page():
    p = pages.parse_html("https://acme.com/x/", "<base href='/y/'><title> A  b </title><link rel=canonical href='z'><meta name=robots content='none'><meta property='og:site_name' content='Acme'><body><script>var t = '</p>';</script><p>One<p>two <a href='q'>Go <b>on</b></a><a href='q#x'>again</a><a href='/img' aria-label='Label'></a><footer>F &amp; G</footer><iframe src='https://e.com/e'></iframe>")
    assert (p["title"], p["canonical"], p["noindex"], p["nofollow"], p["og_site_name"], p["footer_text"]) == ("A b", "https://acme.com/y/z", True, True, "Acme", "F & G")
    assert [(x["url"], x["text"]) for x in p["links"]] == [("https://acme.com/y/q", "Go on"), ("https://acme.com/img", "Label")]
    assert p["text"].startswith("One two Go on") and "var t" not in p["text"] and p["embeds"] == ["https://e.com/e"]


def test_json_ld():
    two = '{"@graph":[{"@type":"JobPosting","title":"A"},{"@type":["Thing","http://schema.org/JobPosting"],"name":"B","url":"/b","jobLocation":[{"address":{"addressLocality":"Lagos","addressCountry":"NG"}},"Remote"],"baseSalary":{"currency":"USD","value":{"value":"1,000","unitText":"MONTH"}}}]}'
    got = pages.postings("https://acme.com/p", [two, "bad"])
    assert [(p["posting_url"], p["title"], p["location"], p["salary_min"], p["salary_max"]) for p in got] == [("https://acme.com/b", "B", "Lagos, NG; Remote", 1000.0, 1000.0)]
    assert pages.postings("https://acme.com/p", ['{"@type":"JobPosting","title":"A"}'])[0]["posting_url"] == "https://acme.com/p"


def test_bytes():
    import gzip
    import zlib

    assert pages.decompress("gzip", gzip.compress(b"hello"), 10) == b"hello" and pages.decompress("gzip", gzip.compress(b"x" * 50), 10) is None
    assert pages.decompress("deflate", zlib.compress(b"hi"), 10) == b"hi" and pages.decompress("gzip", b"junk", 10) is None
    assert pages.decode_html("é".encode("latin-1"), "text/html; charset=iso-8859-1") == "é" and pages.decode_html(b"\xef\xbb\xbfx") == "x" and pages.decode_html(b"<meta charset='nope'>a") == "<meta charset='nope'>a"


def test_seeds_sitemaps_robots(spark):
    ok, bad = files.parse_seeds(spark.createDataFrame([("# c\nacme.com # x\n\nhttps://b.org/p?utm_a=1\nftp://c.com\nlocal\n",)], "body string"))
    assert [(r.line, r.url) for r in ok.orderBy("line").collect()] == [(2, "https://acme.com/"), (4, "https://b.org/p")]
    assert [(r.line, r.reason) for r in bad.orderBy("line").collect()] == [(5, "unsupported scheme"), (6, "host must be a domain name")]
    xml = "<urlset><LOC> https://acme.com/careers/eng </LOC><loc><![CDATA[https://acme.com/careers?a=1&b=2]]></loc><loc>https://acme.com/jobs/12345</loc><loc>cut"
    locs = files.parse_sitemaps(spark.createDataFrame([(xml,)], "xml string"))
    assert locs.count() == 3
    assert [r.url for r in files.careers_from_sitemap(locs, "acme.com").collect()] == ["https://acme.com/careers?a=1&b=2", "https://acme.com/careers/eng"]
    rules = "User-agent: *\nDisallow: /a\nAllow: /a/b$\n\nUser-agent: heron\nDisallow: /x*y"
    assert not files.robots_allowed(rules, "other", "/a/c") and files.robots_allowed(rules, "other", "/a/b") and files.robots_allowed(rules, "Heron/1", "/a") and not files.robots_allowed(rules, "Heron/1", "/xzy")
    assert files.robots_decision(404, "", "h", "/") and not files.robots_decision(None, "", "h", "/")
    with pytest.raises(ValueError):
        files.Config.from_toml("nope = 1")
    assert files.Config.from_toml("max_depth = 3").max_depth == 3


def test_cv(spark):
    t = "Ada Example\nSenior Backend Engineer | Remote\n\nExperience\nBackend Engineer, Acme Ltd 2015 - 2018\nLead Developer at Beta Jan 2017 – Present\n- Built SQL things.\nSkills\nPython, SQL, Docker\nLanguages:\nEnglish, German"
    p = cv.profile(spark, t, 2025)
    assert p["titles"][0] == "Senior Backend Engineer" and p["years"] == 10.0 and p["seniority"] == "senior" and p["languages"] == ["English", "German"] and p["remote"] == "remote"
    assert set(p["skills"]) == {"sql", "python", "docker"} and p["skills"]["sql"] > p["skills"]["docker"]
    assert cv.profile(spark, "", 2025)["years"] is None
    assert p["titles"] == ["Senior Backend Engineer", "Backend Engineer", "Lead Developer"]
    with pytest.raises(ValueError):
        files.cv_text(b"%PDF-1.4 ...")
    assert files.cv_text(b"a  b\r\n\r\n\r\n\r\n" + b"word " * 20).startswith("a b\n\nword")


@pytest.mark.parametrize(
    "href,want",
    [
        ("../../../../../z", "https://h.example/a/z"), ("../" * 40 + "z", "https://h.example/z"), ("./x/./y/.", "https://h.example/a/b/c/d/e/f/x/y/"), ("..", "https://h.example/a/b/c/d/e/"), ("/a/../..", "https://h.example/"), ("%2e%2E/q?x=../y", "https://h.example/a/b/c/d/e/q?x=../y"),
        ("//o.example/a/../b", "https://o.example/b"), ("https://o.example/./a/..", "https://o.example/"), ("x..y/.z", "https://h.example/a/b/c/d/e/f/x..y/.z"), ("mailto:a@b", None), ("#x", None), ("", None),
    ],
)
def test_dot_segments_of_any_number(spark, href, want):
    df = spark.createDataFrame([("https://h.example/a/b/c/d/e/f/", href)], "b string, h string")
    assert df.select(urls.resolve("b", "h").alias("u")).first().u == want


def test_registrable_domains(spark):
    want = {
        "a.foo.co.th": "foo.co.th", "x.gov.au": "x.gov.au", "foo.com.vn": "foo.com.vn", "www.foo.com.vn": "foo.com.vn", "co.th": None, "gov.au": None, "com": None, "localhost": None, "foo.de": "foo.de", "a.b.foo.de": "foo.de", "com.de": "com.de", "shop.co.uk": "shop.co.uk", "a.me.uk": "a.me.uk",
        "x.y.com.co": "y.com.co", "t.co": "t.co", "foo.io": "foo.io", "a.foo.com.np": "foo.com.np", "a.foo.np": "a.foo.np", "foo.example": "foo.example", "a.foo.museum": "foo.museum", "10.0.0.1": "10.0.0.1", "[::1]": "[::1]", "go.com": "go.com", "b.foo.or.jp": "foo.or.jp", "a.foo.k12.tr": "foo.k12.tr", "foo.com.": "foo.com",
    }
    df = spark.createDataFrame([(h,) for h in want], "h string")
    assert {r.h: r.d for r in df.select("h", urls.registrable_domain(F.concat(F.lit("https://"), "h", F.lit("/x"))).alias("d")).collect()} == want


def test_html_is_read_as_seen(spark):
    from heronry.sources.boards import plain_html

    want = {
        'a &eacute; &#8211; &euro;5 <p title="x>y">q</p>': "a é – €5 q", "&lt;p&gt;One &amp;amp; two&lt;/p&gt;&lt;ul&gt;&lt;li&gt;three&lt;/li&gt;&lt;/ul&gt;": "One & two three", "1 < 2 and 3 > 2": "1 < 2 and 3 > 2", "<style>a{}</style><b>x</b><!-- c -->y<script>z</script>": "x y",
        "": "", "plain": "plain", "&lt;b&gt;": "<b>", "<p>cut": "cut", "a\u00a0b\n\tc": "a b c", None: None,
    }
    df = spark.createDataFrame([(k,) for k in want], "t string")
    assert {r.t: r.x for r in df.select("t", plain_html(F.col("t")).alias("x")).collect()} == want


@pytest.mark.parametrize(
    "text,want",
    [
        ("2015 - 2018", 3.0), ("Jan 2015 – Mar 2018", 3.0), ("2015 to present", 10.0), ("2015-2018, 2017 — 2020", 5.0), ("2015 - 2016; 2018 - 2019", 2.0), ("2018 - 2015", None), ("1960 - 1990", None), ("2019 - 2031", None), ("2020 - 2020", None),
        ("1970 - 2025", 50.0), ("call 2015 or 2018", None), ("12015 - 2018", None), (None, None), ("", None), ("2015 - August 2016", 1.0), ("2010 - today", None), ("x 2010-current y", 15.0),
    ],
)
def test_years_are_a_union(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(cv.years(F.col("t"), 2025).alias("y")).first().y == want


def test_cv_columns(spark):
    """Other columns stay, nulls and texts without sections are read, skills are ranked by mentions."""
    t = "# Summary\nOpen to remote.\n# Skills:\nSQL\nEducation\nSQL SQL at a fintech and a hospital"
    df = spark.createDataFrame([(1, None, "a"), (2, "Python python\nHead of Data | Acme 2019\nHEAD OF DATA", "b"), (3, t, "c")], "id long, text string, titles2 string")
    got = {r.id: r for r in cv.profiles(df, 2025).collect()}
    assert (got[1].titles, got[1].skills, got[1].years, got[1].seniority, got[1].titles2) == ([], {}, None, None, "a")
    assert got[2].titles == ["Head of Data"] and got[2].seniority == "director" and got[2].skills == {"python": 0.54}
    assert got[3].skills == {"sql": 0.71} and got[3].industries == ["fintech", "healthcare"] and got[3].remote == "remote" and cv.profiles(df.limit(0), 2025).count() == 0


def test_long_cvs_are_read_in_one_pass(spark):
    """Lines, titles and mentions are computed once a text: with work for each line over all lines these 8,000 lines take many minutes."""
    import time

    t = "\n".join(["Skills", *["Python, machine learning; SQL."] * 4000, "Experience", *["Engineer, Acme", "ANALYST | Beta", "engineer at Home"] * 1334])
    df = cv.profiles(spark.createDataFrame([(1, t)], "id long, text string"), 2025)
    began = time.monotonic()
    got = df.collect()[0]
    assert time.monotonic() - began < 60
    assert got.titles == ["Engineer", "ANALYST"] and got.skills == {"python": 0.83, "sql": 0.83, "machine learning": 0.83}
    one = spark.createDataFrame([("sql",)], "t string").select(enrich.skill_counts(F.col("t")).alias("n"))
    assert one._jdf.queryExecution().analyzed().toString().count("split(") == 1


def test_geocode(spark, small):
    places = spark.createDataFrame(
        [(1, "Lagos", "LA", "NG", "Nigeria", 6.45, 3.39, "Eko"), (2, "Birmingham", "AL", "US", "United States", 33.5, -86.8, None), (3, "Birmingham", None, "GB", "United Kingdom", 52.5, -1.9, None), (9001, None, None, "NG", "Nigeria", None, None, None), (9002, None, None, "GB", "United Kingdom", None, None, "UK"), (9003, None, None, "PT", "Portugal", None, None, None)],
        "place_id long, city string, region string, country_code string, country_name string, lat double, lon double, alt_names string",
    )
    texts = spark.createDataFrame([(t,) for t in ("Lagos, Nigeria", "eko", "Birmingham", "Birmingham (UK)", "Lagos, Portugal", "Remote", None, "")], "location string")
    got = {r.location: (r.city, r.country_code) for r in gazetteer.geocode(texts, places).collect()}
    assert got == {"Lagos, Nigeria": ("Lagos", "NG"), "eko": ("Lagos", "NG"), "Birmingham": ("Birmingham", "US"), "Birmingham (UK)": ("Birmingham", "GB"), "Lagos, Portugal": (None, "PT")}
    assert [r.value for r in gazetteer.suggest(places, "bir").collect()] == ["Birmingham, US", "Birmingham, United Kingdom"]
