"""Training-data operators: brute force, round trips, held-out accuracy and the hard cases of each."""

import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

llm = pytest.importorskip("heronry.llm")
from heronry.llm import _boost, _dom, canonical, leakage, mainbody, markup, names, rankfuse, reading, tokens, topn  # noqa: E402
from heronry.llm._company import edits, jaro_winkler, read, sound  # noqa: E402
from tests.oracle import assert_same, connect  # noqa: E402

QUERIES, SQL = llm.queries(), llm.oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle(spark, small, con, name):
    assert_same(QUERIES[name](spark, small), con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


# --- 1 markup --------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "text,kinds",
    [
        ("<p>Hi</p>", {"html"}), ("a &bull; b", {"html"}), ("&lt;b&gt;x&lt;/b&gt;", {"html"}), ("<!-- c -->x", {"html"}), ("cut off <p", {"html"}), ("## Head\ntext", {"markdown"}), ("is **bold** here", {"markdown"}), ("see [a](b) now", {"markdown"}), ("see [a][1]\n\n[1]: /b", {"markdown"}),
        ("Head\n-----\nx", {"markdown"}), ("> said", {"markdown"}), ("| a | b |\n|---|---|\n| 1 | 2 |", {"markdown"}), ("`x = 1`", {"markdown"}), ("== H ==\nx", {"wiki"}), ("'''b''' x", {"wiki"}), ("[[a|b]]", {"wiki"}), ("{{t}}", {"wiki"}), ("{| class=x\n|}", {"wiki"}), ("__NOTOC__\nx", {"wiki"}),
        ("\\section{A}", {"latex"}), ("a \\& b", {"latex"}), ("load $p \\leq 1$.", {"latex"}), ("\\[ x^2 \\]", {"latex"}), ("<b>**x**</b>", {"html", "markdown"}),
        ("cut <p\n\n## Head\n\nMore text", {"html", "markdown"}), ("x <!-- never closed\n\n== H ==", {"html", "wiki"}), ("plain • text\nHead:\n• item", set()), ("Shifts are 4 * 10 hours. cv_first_last C# #1 x=y A/B", set()), ("Stars: **** from our guests", set()), ("Path: share\\forms\\new", set()), ("Bonus {paid} ~20% [in]", set()), ("$2,000 to $4,000", set()), ("> 3 years, < 5 is fine".replace("> ", "need > "), set()), (None, set()), ("  \n", set()),
    ],
)
def test_markup_kinds(text, kinds):
    assert _dom.read(text).markup == kinds


def test_clean_text_keeps_structure():
    html_ = "<style>.a{}</style><h2>Tasks</h2><p>One &amp; <b>two</b></p><ul><li>first<li>second</ul><ol><li>x</li><li>y</li></ol><pre><code>if a < b:\n  go()</code></pre><table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>2</td></tr></table>"
    assert _dom.write(_dom.read(html_).blocks) == "Tasks\n\nOne & two\n\n• first\n• second\n1. x\n2. y\n\n    if a < b:\n      go()\n\nA\tB\n1\t2"
    assert _dom.write(_dom.read("One.<p\n\nTwo is\n\nThree < four <b>five</b> <p").blocks) == "One.\n\nTwo is\n\nThree < four five"
    md = "# Tasks\n\nOne **two** [three](x)\n- first\n- second\n\n```\ncode *x*\n```"
    assert _dom.write(_dom.read(md).blocks) == "Tasks\n\nOne two three\n\n• first\n• second\n\n    code *x*"
    tex = "\\section{Tasks}\nOne \\textbf{two}\n\\begin{itemize}\n\\item first\n\\end{itemize}\n$$a \\leq b$$\n\\begin{verbatim}\nx\n\\end{verbatim}"
    assert _dom.write(_dom.read(tex).blocks) == "Tasks\n\nOne two\n\n• first\n\n    a \\leq b\n\n    x"
    wiki = "== Tasks ==\nOne '''two''' [[a|three]]\n* first\n{| class=\"w\"\n! A !! B\n|-\n| 1 || 2\n|}"
    assert _dom.write(_dom.read(wiki).blocks).startswith("Tasks\n\nOne two three\n\n• first\n\nA")


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab <>/&;#*_`[](){}|\\$'=~-\n.ulip", max_size=120))
def test_reading_never_fails(text):
    r = _dom.read(text)
    _dom.write(r.blocks)
    assert r.markup <= {"html", "markdown", "wiki", "latex"}


@pytest.mark.parametrize("hot", [4, 100_000])
def test_site_tree(spark, monkeypatch, hot):
    monkeypatch.setattr(markup, "HOT", hot)
    rows = [(i, f"https://careers.acme.example/{i}", f"<div><h2>About us</h2><p>Only on page {i}.</p><p>Follow us everywhere for news.</p></div>", "clash") for i in range(12)]
    rows += [(100, None, "<p>Follow us everywhere for news.</p>", "x"), (101, "https://x.example/", None, "x"), (102, "https://x.example/", " ", "x"), (1, "https://careers.acme.example/1", rows[1][2], "repeat")]
    df = spark.createDataFrame(rows, "id long, url string, description string, text string")
    out = defaultdict(list)
    for r in markup.clean(df).collect():
        out[r.id].append((r.text, r.markup))
    assert out[3] == [("About us\n\nOnly on page 3.", ["html"])] and len(out[1]) == 2
    assert out[100] == [("Follow us everywhere for news.", ["html"])] and out[101] == [(None, [])] and out[102] == [("", [])]
    assert markup.clean(df.limit(0)).count() == 0
    assert markup.importance(1, 100) == 1.0 and markup.importance(100, 100) < 0.02 and markup.importance(2, 2) > 0.5


def test_tree_nodes_and_importance(spark):
    """Elements merge by their tags; entropy of styles and contents, by brute force; branches go as a whole."""
    word = lambda k: "".join(chr(97 + int(c)) for c in str(1000 + k))
    footer = "<div><h3>Stay in touch</h3><ul><li>Join our talent pool</li><li>Ask us anything</li></ul></div>"
    text = lambda k: f"<div><h2>Role {word(k)}</h2><p>Work on {word(k)}.</p>{'<p>More on ' + word(k * 7) + '.</p><pre>x = 1</pre>' if k % 2 else ''}</div>{footer if k < 20 else ''}"
    rows = [(k, f"https://acme.example/{k}", text(k)) for k in range(24)] + [(99, "https://acme.example/again", text(3))] * 3
    df = spark.createDataFrame(rows, "id long, url string, description string")
    done = markup._read(markup._rows(df, "id", "description", "url")[0])
    common = {c["key"]: c for c in markup.style_tree(done).first()["common"]}
    trees = [markup.tree(_dom.read(text(k)).blocks) for k in range(24)]
    styles, contents = defaultdict(lambda: defaultdict(int)), defaultdict(int)
    for up, key, style in trees:
        for k, s in {(k, s) for k, s in zip(key, style)}:
            if s in (markup.LEAF, markup.HELD):
                contents[k] += 1
            else:
                styles[k][s] += 1
    m = 24 + markup.OTHERS
    for k, c in common.items():
        if c["weight"] is None:
            assert c["imp"] == pytest.approx(1 - np.log(contents[k]) / np.log(m))
        else:
            n = sum(styles[k].values())
            assert c["imp"] == pytest.approx(-sum(f / n * np.log(f / n) for f in styles[k].values()) / np.log(m)) and c["weight"] == pytest.approx(0.9 ** len(styles[k]))
    assert any(c["weight"] is not None and c["imp"] > 0 for c in common.values())
    out = {r.id: r.text for r in markup.clean(df).collect()}
    assert out[3] == out[99] == f"Role {word(3)}\n\nWork on {word(3)}.\n\nMore on {word(21)}.\n\n    x = 1" and out[4] == f"Role {word(4)}\n\nWork on {word(4)}."
    assert "touch" not in "".join(out.values()) and "anything" not in "".join(out.values()) and len(out) == 25


# --- 2 rank fusion -----------------------------------------------------------------------------------------------------------


def _fuse_brute(rows):
    best = {}
    for g, i, a, b in rows:
        x = best.setdefault((g, i), [None, None])
        if a is not None:
            x[0] = a if x[0] is None else max(x[0], a)
        if b is not None:
            x[1] = b if x[1] is None else min(x[1], b)
    out = {}
    for (g, i), x in best.items():
        ranks = []
        for k, sign in ((0, -1), (1, 1)):
            held = [v[k] for (h, _), v in best.items() if h == g and v[k] is not None]
            if held:
                ranks.append(len(held) + 1 if x[k] is None else 1 + sum(sign * v < sign * x[k] for v in held))
        r = sorted(ranks)
        med = None if not r else (r[(len(r) - 1) // 2] + r[len(r) // 2]) / 2
        out[g, i] = (med, None if not r else round(sum(r) / len(r), 9))
    return out


@pytest.mark.parametrize("per_slice", [3, 20_000])
def test_rank_fusion(spark, per_slice):
    rnd = random.Random(per_slice)
    rows = [(rnd.choice([1, 1, 1, 2, None]), rnd.randint(1, 60), rnd.choice([None, float("nan"), *[k / 4 for k in range(9)]]), None if rnd.random() < 0.2 else -rnd.randint(0, 30) / 3) for _ in range(400)]
    rows += rows[:20] + [(7, 1, None, None), (8, 5, 1.0, None), (8, 4, 1.0, None)]
    df = spark.createDataFrame(rows, "g long, i long, a double, b double").withColumn("median_rank", F.lit("clash"))
    scores = [rankfuse.Score("a"), rankfuse.Score("b", ascending=True)]
    fused = rankfuse.fuse(df, "g", "i", scores, per_slice)
    clean = [(g, i, None if a is not None and a != a else a, b) for g, i, a, b in rows]
    want = _fuse_brute(clean)
    got = {(r.g, r.i): (r.median_rank, r.mean_rank) for r in fused.collect()}
    assert got == want
    first = {r.g: r.i for r in rankfuse.first(fused, "g", "i", ["a", "b"]).collect()}
    inf = float("inf")
    for g in {g for g, _ in want}:
        assert first[g] == min((m if m is not None else inf, n if n is not None else inf, i) for (h, i), (m, n) in want.items() if h == g)[2]
    assert rankfuse.fuse(df.limit(0), "g", "i", scores).count() == 0


def test_values_that_fill_slices(spark):
    """One value of a score may be that of most items, of all, or of none: slices of its own, the same ranks."""
    rng = random.Random(11)
    rows = [("g", i, rng.choice([1.0, 1.0, 1.0, 2.0, 3.0, None]), float(rng.randrange(10_000))) for i in range(400)]
    rows += [("tied", i, 5.0, None) for i in range(90)] + [(None, i, None, float(i // 40)) for i in range(80)]
    df = spark.createDataFrame(rows, "g string, i long, a double, b double")
    scores = [rankfuse.Score("a"), rankfuse.Score("b", ascending=True)]
    whole, sliced = (sorted(map(str, rankfuse.fuse(df, "g", "i", scores, n).collect())) for n in (20_000, 20))
    assert whole == sliced
    want = _fuse_brute(rows)
    assert {(r.g, r.i): (r.median_rank, r.mean_rank) for r in rankfuse.fuse(df, "g", "i", scores, 20).collect()} == want


def test_weighted_median(spark):
    df = spark.createDataFrame([(1, 5, 9), (4, None, None)], "a int, b int, c int")
    got = [r.m for r in df.select(rankfuse.weighted_median([F.col("a"), F.col("b"), F.col("c")], [1.0, 1.0, 3.0]).alias("m")).collect()]
    assert got == [9.0, 4.0]


# --- 3 main body ---------------------------------------------------------------------------------------------------------------


def test_boosting_learns():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    p = _boost.predict(_boost.fit(x[:400], y[:400]), x[400:])
    assert ((p > 0.5) == y[400:]).mean() > 0.93
    assert len(_boost.predict(_boost.fit(np.zeros((0, 3)), np.zeros(0)), np.zeros((2, 3)))) == 2


def test_decoding_is_consistent():
    # links, a notice, title over section over a paragraph with a notice, a heading over a notice only, a heading with nothing under it
    short = np.array([1, 1, 0, 1, 1, 0, 0, 1, 0, 1, 0, 1], dtype=bool)
    p = np.array([0.99, 0.99, 0.95, 0.3, 0.8, 0.01, 0.9, 0.2, 0.99, 0.4, 0.05, 0.3])
    out = mainbody.decode(short, p)
    assert out.tolist() == [True, True, True, False, False, False, True, False, True, False, False, True]
    tree = mainbody.heading_tree(short, p)
    assert tree[5] == 4 and tree[9] == 7 and tree[10] == 9
    rng = np.random.default_rng(3)
    for _ in range(200):
        n = int(rng.integers(1, 14))
        short, p = rng.random(n) < 0.5, rng.random(n)
        out, tree = mainbody.decode(short, p), mainbody.heading_tree(short, p)
        for k in range(n):
            under = [c for c in range(n) if tree[c] == k]
            assert not under or out[k] == all(out[c] for c in under)  # kept exactly if something under it is


def _drawn(rng, hosts=200):
    """Pages of sites that repeat their notices, with which lines are no main body; every wording is drawn anew, so nothing can be known beforehand."""
    word = lambda: "".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(2, 3)))
    text = lambda n: " ".join(word() for _ in range(n)).capitalize()
    heads, notices, links = [text(2) for _ in range(8)], [text(rng.randint(3, 11)) + rng.choice([".", "", " /"]) for _ in range(40)], [text(1) for _ in range(9)]
    held = set(notices[:8])
    pages, truth = [], {}
    for h in range(hosts):
        kit = rng.sample(notices, 3)
        for k in range(rng.randint(5, 12)):
            rows = [("  ".join(rng.sample(links, 4)), True)] if rng.random() < 0.5 else [(x, True) for x in rng.sample(links, 5)]
            rows += [(n, True) for n in kit[:1] if rng.random() < 0.7] + [(text(3), False)]
            for _ in range(rng.randint(1, 4)):
                rows.append((rng.choice(heads), False))
                rows += [(text(rng.randint(12, 25)) + ".", False) for _ in range(rng.randint(1, 2))]
                rows += [(rng.choice(kit), True)] if rng.random() < 0.3 else []
            foot = [f"© Site{h} {text(1)}", text(3)] if k % 2 else []
            rows += [(n, True) for n in kit[1:]] + [(f, True) for f in foot]
            i = h * 100 + k
            pages.append((i, f"https://site{h}x.example/{k}", "\n".join(r for r, _ in rows), " ".join(foot) or None))
            truth |= {(i, n): (r, bad) for n, (r, bad) in enumerate(rows, 1)}
    return pages, truth, held


def test_held_out_templates(spark):
    """Notices that no page of the sample has are known by how they recur, where they stand and what is beside them."""
    pages, truth, held = _drawn(random.Random(8))
    df = spark.createDataFrame(pages, "id long, url string, text string, footer_text string")
    rows = mainbody.prepared(df)
    known = mainbody.recurring(rows)
    sample = [(r.text, r.footer, r["keys"]) for r in rows.collect() if not any(n in r.text.split("\n") for n in held)]
    got = mainbody.main_body(df, mainbody.train(sorted(sample, key=lambda r: r[0]), known)).collect()
    assert len(got) == len(truth) and len(sample) < len(pages)
    ours = [(truth[r.id, r.line_no][0] in held, truth[r.id, r.line_no][1], not r.main) for r in got]
    unseen = [said for mine, _, said in ours if mine]
    assert sum(unseen) / len(unseen) > 0.95
    assert sum(bad == said for _, bad, said in ours) / len(ours) > 0.97


def test_main_body(spark, small):
    pages = spark.read.parquet(f"{small}/parsed_pages.parquet")
    more = spark.createDataFrame([(9001, None), (9002, ""), (9003, " \n ")], "id long, text string")
    both = pages.select("id", "url", "text", "footer_text").withColumn("keys", F.lit(1)).unionByName(more, allowMissingColumns=True)
    rows = mainbody.main_body(both).collect()
    by = defaultdict(dict)
    for r in rows:
        by[r.id][r.line_no] = r
    assert 9001 not in by and not by[9002][1].main and not by[9003][1].main and len(by[9003]) == 2
    for r in pages.where("text is not null").collect():
        assert [by[r.id][k].line for k in sorted(by[r.id])] == r.text.split("\n")
    assert mainbody.main_body(both.limit(0)).count() == 0
    assert not any(r.main for r in mainbody.main_body(both.where("id > 9000")).collect())


def test_how_lines_recur(spark):
    """Counted over pages: copies of a page count once, the site's name and numbers make no difference."""
    notice = [(h, f"https://www.bigsite{h}.example/{k}", f"Welcome to Bigsite{h} no {k}\nwords {h} {k} a b", None) for h in range(2) for k in range(6)]
    spread_ = [(h, f"https://site{h}q.example/", f"The team\nonly {chr(97 + h)} here", None) for h in range(12)]
    df = spark.createDataFrame(notice + [notice[0]] * 50 + spread_, "id long, url string, text string, footer_text string")
    rows = mainbody.prepared(df)
    known = mainbody.recurring(rows)
    key = {r.text.split("\n")[0]: r["keys"][0] for r in rows.collect()}
    assert known.lines[key["Welcome to Bigsite0 no 1"]][0] == 12 and known.lines[key["Welcome to Bigsite0 no 1"]][1] < mainbody.FEW
    assert known.lines[key["The team"]] == (12, pytest.approx(known.lines[key["The team"]][1])) and known.lines[key["The team"]][1] > mainbody.MANY


# --- 4 top N ---------------------------------------------------------------------------------------------------------------------


def test_top_n(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice([1] * 30 + [2, 3, None]), k, rnd.choice([None, float("nan"), float("inf"), 0.5, 0.5, rnd.random()])) for k in range(3000)]
    df = spark.createDataFrame(rows, "g long, i long, s double").withColumn("rank", F.lit("clash")).withColumn("__n", F.lit(0))
    got = defaultdict(list)
    for r in topn.top_n(df, "g", "s", [F.asc("i")], 5, bins=16).orderBy("rank").collect():
        got[r.g].append(r.i)
    for g in (1, 2, 3, None):
        want = sorted(((-s, i) for h, i, s in rows if h == g and s is not None and s == s))[:5]
        assert got[g] == [i for _, i in want]
    assert topn.top_n(df.limit(0), "g", "s", [F.asc("i")], 5).count() == 0


def test_latest_pair_counts(spark):
    m = spark.createDataFrame([(1, 1, 0.9, 1), (1, 1, 0.1, 2), (1, 2, 0.5, 1), (1, 2, 0.5, 1), (1, 3, 0.99, 1), (1, 3, None, 2), (1, 4, 0.7, 1), (None, 1, 0.9, 1), (2, 1, 0.2, None)], "profile_id long, job_id long, score double, computed_at long")
    j = spark.createDataFrame([(1, None), (2, None), (3, None), (4, 99), (1, None)], "id long, closed_at long")
    got = [(r.profile_id, r.job_id, r.score, r["rank"]) for r in topn.best_postings(m, j).orderBy("profile_id", "rank").collect()]
    assert got == [(1, 2, 0.5, 1), (1, 1, 0.1, 2), (2, 1, 0.2, 1)]


# --- 5 canonical list -----------------------------------------------------------------------------------------------------------


def _lev(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        p, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (x != y))
    return d[-1]


def test_pigeonhole_loses_nothing(spark):
    rnd = random.Random(5)
    listed = ["".join(rnd.choice("abc") for _ in range(rnd.randint(2, 13))) for _ in range(120)]

    def typo(s):
        s = list(s)
        for _ in range(rnd.randint(0, 4)):
            k = rnd.randrange(len(s) + 1)
            s[k : k + rnd.randint(0, 1)] = [rnd.choice("abc")] * rnd.randint(0, 1)
        return "".join(s) or "a"

    typed = [typo(rnd.choice(listed)) for _ in range(300)]
    v = spark.createDataFrame([(x,) for x in [*typed, None, ""]], "value string")
    n = spark.createDataFrame([(x,) for x in [*listed, None, listed[0]]], "name string")
    got = {(r.value, r.name): r.dist for r in canonical.pigeonhole(spark, v, n).collect()}
    k = lambda s: next((k for n, k in canonical.ALLOWED if len(s) >= n), 0)
    want = {(a, b): _lev(a, b) for a in set(typed) for b in set(listed) if _lev(a, b) <= k(b)}
    assert got == want


PLACES = "place_id long, city string, region string, country_code string, country_name string, alt_names string"


def test_short_names_may_be_misspelt(spark):
    names_ = spark.createDataFrame([("paris",), ("peru",), ("usa",), ("lagos",)], "name string")
    values = spark.createDataFrame([("pariss",), ("pars",), ("perru",), ("per",), ("usb",), ("usa",), ("lag0s",), ("prs",), (None,)], "value string")
    got = {(r.value, r.name, r.dist) for r in canonical.pigeonhole(spark, values, names_).collect()}
    assert got == {("pariss", "paris", 1), ("pars", "paris", 1), ("perru", "peru", 1), ("per", "peru", 1), ("usa", "usa", 0), ("lag0s", "lagos", 1)}
    lists = spark.createDataFrame([(1, "Delhi", "DL", "IN", "India", None), (9001, None, None, "IN", "India", None), (9002, None, None, "JP", "Japan", None)], "place_id long, city string, region string, country_code string, country_name string, alt_names string")
    jobs = spark.createDataFrame([(1, "Indai x"), (2, "Inda"), (3, "Jappan"), (4, "Dehli, India"), (5, "Delhl, Inndia"), (6, "jp")], "id long, location string")
    assert {r.id: r.place_id for r in canonical.canonical(spark, jobs, lists).collect()} == {1: 0, 2: 9001, 3: 9002, 4: 9001, 5: 1, 6: 9002}


def test_places(spark):
    p = spark.createDataFrame([(1, "Brebkumdreb", "NF", "SE", "Sweden", "RHD"), (2, "Brebkumdreb", "WW", "ES", "Spain", None), (3, "Port Manbrarten", "NX", "JP", "Japan", None), (9001, None, None, "SE", "Sweden", "Sverige"), (9002, None, None, "ES", "Spain", "España"), (9003, None, None, "JP", "Japan", None), (9004, None, None, "FR", "France", None)], PLACES)
    cases = {"Brebkumdreb": 1, "brebkumdrib , ES": 2, "Brebkumderb, WW": 2, "12345 BREBKUMDREB, Sverige": 1, "RHD": 1, "Brebkumdreb, France": 9004, "Hybrid - Greater Port Manbarten (2 days on site)": 3, "Remote - España": 9002, "Nowhere, SE": 9001, "Remote": 0, "TBC": 0, "Port  Manbrarten office; Port Manbrarten": 3}
    rows = [(i, t, "x") for i, t in enumerate(cases)] + [(100, None, "x"), (101, " \u00a0", "x"), (102, "", "x"), (0, "Brebkumdreb", "repeat")]
    j = spark.createDataFrame(rows, "id long, location string, place_id string")
    got = {r.id: r.place_id for r in canonical.canonical(spark, j, p).collect()}
    assert got == {i: v for i, v in enumerate(cases.values())}
    assert {r.place_id for r in canonical.canonical(spark, j, p.limit(0)).collect()} == {0}
    assert canonical.canonical(spark, j.limit(0), p).count() == 0


# --- 6 names -----------------------------------------------------------------------------------------------------------------------

SAME_NAMES = [
    ["Krepgod Sargred Manufacturing Inc", "KREPGOD SARGRED MFG", "Sargred Krepgod", "Krepgd Sarrged Manufacturing", "K. Sargred Manufacturing", "Krepgod Mfg", "Krepsaro", "Team Krepgod Sargred (via recruiter)", "Krepgodsargred Inc", "Krepgöd-Sargred"],
    ["Borbrin Folkrab Services LLC", "Services Borbrin Folkrab, L.L.C.", "Borbrin F. Svcs"],
    ["Borbrin Pelfam Logistics Inc", "BORBRIN PELFAM LOG."],
    ["Dimlud Grebmot International", "dimlud grebmot int'l"],
]


def test_names_cluster(spark):
    flat = [n for g in SAME_NAMES for n in g]
    j = spark.createDataFrame([(n, "x") for n in [*flat, *flat[:5], None, "", "n/a", "Confidential", " - "]], "company string, cluster string")
    got = defaultdict(set)
    for r in names.clusters(j).collect():
        got[r.cluster].add(r.company)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, SAME_NAMES)) and all(k == min(v) for k, v in got.items())
    assert names.clusters(j.limit(0)).count() == 0


def test_large_blocks_are_cut(spark, monkeypatch):
    monkeypatch.setattr(names, "PIECE", 4)
    rnd = random.Random(6)
    base = ["b" + "".join(rnd.choice("aeiou") + rnd.choice("bfpv") for _ in range(3)) for _ in range(25)]
    forms = spark.createDataFrame([(f"{a} {b}|", f"{min(a, b)} {max(a, b)}", "") for a, b in zip(base, base[1:])], "node string, core string, kind string").dropDuplicates(["node"])
    rows = [(r.node, r.core.split(" ")) for r in forms.collect()]
    want = set()
    for i, (n, c) in enumerate(rows):
        for m, d in rows[i + 1 :]:
            if names.block_keys(c, "") & names.block_keys(d, "") and names.alike(c, d):
                want.add((min(n, m), max(n, m)))
    assert {(r.a, r.b) for r in names.pairs(forms).collect()} == want and want


def test_components(spark):
    rnd = random.Random(7)
    edges = [(f"{rnd.randint(0, 200):03}", f"{rnd.randint(0, 200):03}") for _ in range(150)] + [(f"c{k:03}", f"c{k + 1:03}") for k in range(40)]
    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    want = {x: find(x) for x in {v for e in edges for v in e if e[0] != e[1]}}
    smallest = defaultdict(lambda: "~")
    for x, r in want.items():
        smallest[r] = min(smallest[r], x)
    got = {r.node: r.label for r in names.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {x: smallest[r] for x, r in want.items()}


def test_likeness():
    assert round(jaro_winkler("martha", "marhta"), 4) == 0.9611 and round(jaro_winkler("dixon", "dicksonx"), 4) == 0.8133 and jaro_winkler("", "a") == 0
    assert names.alike(["bonbov", "belbir"], ["blbir", "bonobv"]) > 0 and names.alike(["dradgron", "tramstip"], ["dravgron", "trarstil"]) == 0 and names.alike(["ab"], ["ab", "c"]) == 0
    assert edits("ca", "abc") == 3 and edits("bonbov", "bonobv") == 1 and edits("a", "abcdef") == 3
    assert sound("robert") == sound("rupert") == "R163" and read("N/A") is None and read("The & Co.") is None


# --- 8 tokens --------------------------------------------------------------------------------------------------------------------

TEXTS = ["Hello  world's  test", "", None, " ", "\n\n\t x", "a" * 3000, " " * 2001, "=" * 999 + "é" * 300, "日本語 🙂🙂 naïve e\u0301", "<|endoftext|>", "don't 123456 ... --- $$$", "Zürich\r\nStraße\u00a0x"]


def _reference():
    T = pytest.importorskip("tokenizers")
    t = T.Tokenizer.from_file(tokens.VOCAB)
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids if x else []


@settings(max_examples=120, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=8))
def test_encoding_equals_library(texts):
    ref = _reference()
    assert ENCODER.batch(texts) == [ref(t) for t in texts]


ENCODER = tokens.Encoder(tokens.load())


def test_encode(spark):
    ref = _reference()
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], "y"), (None, "x", "z")], "doc_id long, text string, ids string")
    got = defaultdict(list)
    for r in tokens.encode(df).collect():
        got[r.doc_id].append(r.ids)
    assert all(got[i][0] == ref(t) for i, t in enumerate(TEXTS)) and len(got[0]) == 2 and got[2] == [[]] and got[None] == [ref("x")]
    assert tokens.encode(df.limit(0)).count() == 0
    small = tokens.Encoder(tokens.load())
    before, tokens.REMEMBERED = tokens.REMEMBERED, 3
    try:
        assert [small.batch([t])[0] for t in TEXTS] == [ref(t) for t in TEXTS]
    finally:
        tokens.REMEMBERED = before


# --- 9 leakage -------------------------------------------------------------------------------------------------------------------


def _leaks_brute(docs, items, span):
    out = set()
    for d, t in docs:
        w = leakage.words(t)
        for i, p in items:
            q = leakage.words(p)
            n = min(span, len(q))
            grams = {tuple(q[k : k + n]) for k in range(len(q) - n + 1)} if n else set()
            if grams & {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}:
                out.add((d, i))
    return out


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([2, 4, 12]))
def test_search_equals_brute_force(seed, span):
    rnd = random.Random(seed)
    vocab = ["a", "b", "c", "d"][: rnd.randint(2, 4)]
    text = lambda n: " ".join(rnd.choice([*vocab, "zz"]) for _ in range(n))
    items = [(k, text(rnd.randint(0, 16))) for k in range(6)]
    docs = [(k, text(rnd.randint(0, 60))) for k in range(8)]
    s = leakage.Searcher([(i, leakage.words(t)) for i, t in items if leakage.words(t)], span)
    d, i = s.find([leakage.words(t) for _, t in docs])
    assert {(int(a), int(b)) for a, b in zip(d, i)} == _leaks_brute(docs, items, span)


def test_leaks(spark, monkeypatch):
    item = "The quick brown fox jumps over the lazy dog while nobody looks at it"
    docs = spark.createDataFrame([(1, "x " + item.upper().replace(" ", " -- ") + " y", "c"), (2, " ".join(item.split()[1:13]), "c"), (3, " ".join(item.split()[:11]), "c"), (4, None, "c"), (5, "", "c"), (6, "Why us? indeed", "c"), (1, item, "c"), (None, item, "c"), (7, "word " * 50_000 + item, "c")], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(10, item), (11, "why US"), (12, None), (13, "..."), (14, "whys us"), (10, item)], "item_id long, text string")
    want = {(1, 10), (2, 10), (6, 11), (7, 10)}
    assert {tuple(r) for r in leakage.leaks(docs, items).collect()} == want and leakage.leaks(docs, items).count() == 4
    monkeypatch.setattr(leakage, "BLOCK_WORDS", 5)
    assert {tuple(r) for r in leakage.leaks(docs, items).collect()} == want
    assert leakage.leaks(docs, items.limit(0)).count() == 0 and leakage.leaks(docs.limit(0), items).count() == 0


# --- 10 reading level ---------------------------------------------------------------------------------------------------------


def test_ordinal_regression():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 5))
    y = np.digitize(2 * x[:, 0] - x[:, 1] + rng.logistic(size=500) * 0.3, [-2, 0, 2]) + 1
    m = reading.calibrated(x[:350], y[:350])
    assert (reading.predict(m, x[350:]) == y[350:]).mean() > 0.8 and (np.diff(m["cuts"]) > 0).all()
    assert set(reading.predict(reading.fit(np.zeros((3, 2)), np.array([2, 2, 2])), np.zeros((2, 2)))) == {2}


def test_measures_by_brute_force():
    """English texts only, and each feature as its definition says, for texts of any number of words in one batch."""
    rng = random.Random(5)
    english = "the we of and because although which office station work careful responsibility documentation a in team".split()
    texts = ["We are looking for someone with a calm manner", "Wir suchen für die Planung eine Person", "Nous cherchons une personne pour la vente", "Buscamos una persona para el equipo", "1 2 3", ""]
    texts += [", ".join(rng.choice(english) for _ in range(n)) for n in (1, 49, 50, 51, 149, 150, 700)]
    keep, x, seen, counts = reading.measure(texts, reading.Lexicon())
    assert keep.tolist() == [k for k in range(len(texts)) if k == 0 or k > 5 and any(w in reading.FREQUENT["en"].split() for w in reading.words(texts[k]))]
    for k, got, w, c in zip(keep, x, seen, counts):
        ws = reading.words(texts[k])
        chars, n = np.array([len(v) for v in ws]), len(ws)
        chunks = [ws[i : i + 50] for i in range(0, n, 50) if len(ws[i : i + 50]) >= min(50, n)]
        want = [chars.mean(), sum(len(reading._VOWELS.findall(v)) or 1 for v in ws) / n, (chars >= 8).mean(), (chars >= 12).mean(), (chars <= 4).mean(), chars.std(), np.mean([len(set(q)) / len(q) for q in chunks])]
        want += [sum(ws.count(v) == 1 for v in ws) / n, sum(v in reading._CONNECT for v in ws) / n, sum(v in reading._SUBORDINATE for v in ws) / n, texts[k].count(",") / n]
        assert got == pytest.approx(want) and len(w) == len(set(ws)) and sum(c) == n
    idf = (np.sort(seen[0][:3]), np.array([0.5, 1.0, 2.0]))
    full = reading.with_rarity([x[0]], [seen[0]], [counts[0]], idf, 9.0)
    assert full[0, -2] == pytest.approx((9 - 3) / 9) and full[0, -1] == pytest.approx((3.5 + 6 * 9.0) / 9)


def test_held_out_levels(spark, small):
    big = small.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/reading_labels.parquet")
    train, held = labels.where("pmod(hash(doc_id), 3) > 0"), labels.where("pmod(hash(doc_id), 3) = 0")
    got = reading.levels(docs, train).join(held, "doc_id").select("level", "level_id").collect()
    assert len(got) > 30 and sum(r.level == r.level_id for r in got) / len(got) > 0.75 and max(abs(r.level - r.level_id) for r in got) <= 1
    odd = spark.createDataFrame([(9001, None), (9002, " "), (9003, "12 34"), (None, "We are in the office and it is fine"), (9004, "Die Stelle ist auf zwei Jahre befristet und wird von der Leitung vergeben")], "doc_id long, text string").withColumn("level", F.lit("clash"))
    assert [r.doc_id for r in reading.levels(docs.select("doc_id", "text").unionByName(odd, allowMissingColumns=True), train).where("doc_id > 9000 or doc_id is null").collect()] == [None]
    assert reading.levels(docs, labels.limit(0)).count() == 0 and reading.levels(docs.limit(0), labels).count() == 0
