"""Queries over whole columns, on values that their filtered forms leave out."""

import numpy as np
import pytest

from heronry import plans
from heronry.operators import units
from tests.oracle import connect

QUERIES = plans.queries()


def _over(spark, folder, table, rows, cols, name):
    spark.createDataFrame(rows, cols).write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
    return QUERIES[name](spark, str(folder))


def test_every_company_is_deduplicated(spark, tmp_path):
    values = ["Acme ACME acme Ltd", " Acme  Acme ", "b B a A c C d", "lower lower case", "", "  ", "Ärger ÄRGER ärger x", None, "One Two Three Four one"]

    def brute(v):
        out = []
        for w in filter(None, v.split(" ")):
            if w.lower() not in [x.lower() for x in out]:
                out.append(w)
        return out[:3]

    got = {r.id: list(r.words) for r in _over(spark, tmp_path, "jobs", list(enumerate(values)), "id long, company string", "G5_dedupe_list").collect()}
    assert got == {i: brute(v) for i, v in enumerate(values) if v is not None}


def test_every_location_is_mapped(spark, tmp_path):
    want = {
        "EMEA": "EMEA", " apac ": "APAC", "LatAm": "LATAM", "europe": "Europe", "North America": "North America", "AMERICAS": "Americas", "africa": "Africa", "Asia": "Asia",
        "WORLDWIDE": "global", " anywhere": "global", "Global": "global", "de": "DE", " Ng ": "NG", "Remote": None, "TBC": None, "": None, "DEU": None, "Berlin, DE": None, None: None,
    }
    got = {r.id: r.region for r in _over(spark, tmp_path, "jobs", list(enumerate(want)), "id long, location string", "H54_regions").collect()}
    assert got == dict(enumerate(want.values()))


def _silent(spark, values):
    """(US dollars a year, how) by place in the history, of values that all say US dollars a year."""
    cols = "id long, board_key string, source string, posted_at long, first_seen long, salary_min double, salary_max double, salary_currency string, salary_period string, description string"
    jobs = spark.createDataFrame([(i, "h", None, None, i, float(v), None, "USD", "year", None) for i, v in enumerate(values)], cols)
    rates = spark.createDataFrame([("USD", 1.0, "US dollar")], "currency string, usd_per_unit double, currency_name string")
    return {r.id: (r.usd_year, r.how) for r in units.to_common_unit(jobs, rates).collect()}


@pytest.mark.parametrize("factor", [1000.0, 1 / 1000, 100.0, 1 / 12, 1 / 52, 1 / 260, 1 / 2080])
def test_a_silent_segment_is_reversed_whole(spark, factor):
    true = np.exp(np.random.default_rng(3).normal(10.5, 0.3, 120))  # about 36,000 dollars, 3.6 million in cents
    got = _silent(spark, [v * factor if 40 <= i < 70 else v for i, v in enumerate(true)])
    assert {i for i, (_, how) in got.items() if how == "segment"} == set(range(40, 70))
    assert all(abs(got[i][0] / v - 1) < 1e-9 for i, v in enumerate(true))


def test_a_segment_over_a_border_is_judged_as_one(spark, monkeypatch):
    monkeypatch.setattr(units, "PIECE", 40)
    monkeypatch.setattr(units, "HALO", 20)
    true = np.exp(np.random.default_rng(4).normal(10.5, 0.3, 120))
    for a in (34, 36, 38, 74, 76):  # ten values, cut by the border at about 40 or 80
        got = _silent(spark, [v / 12 if a <= i < a + 10 else v for i, v in enumerate(true)])
        assert len(got) == 120 and {i for i, (_, how) in got.items() if how == "segment"} == set(range(a, a + 10))


def _history(spark, rows):
    cols = "id long, board_key string, source string, posted_at long, first_seen long, salary_min double, salary_max double, salary_currency string, salary_period string, description string"
    rates = spark.createDataFrame([("USD", 1.0, "US dollar")], "currency string, usd_per_unit double, currency_name string")
    return {r.id: (r.usd_year, r.how) for r in units.to_common_unit(spark.createDataFrame(rows, cols), rates).collect()}


@pytest.mark.parametrize("time", [None, 7])
def test_a_history_without_times_is_cut_by_id(spark, monkeypatch, time):
    monkeypatch.setattr(units, "PIECE", 40)
    monkeypatch.setattr(units, "HALO", 20)
    true = np.exp(np.random.default_rng(6).normal(10.5, 0.3, 200))
    got = _history(spark, [(i, "h", None, time, None, float(v * (100 if 90 <= i < 110 else 1)), None, "USD", "year", None) for i, v in enumerate(true)])
    assert {i for i, (_, how) in got.items() if how == "segment"} == set(range(90, 110))
    assert all(abs(got[i][0] / v - 1) < 1e-9 for i, v in enumerate(true))


def test_short_boards_go_with_their_source_and_notes_are_confirmed(spark):
    true = np.exp(np.random.default_rng(7).normal(10.5, 0.3, 60))
    note = "All figures are given in thousands."
    rows = [(i, f"b{i // 2}", "s", i, None, float(v / (1000 if 20 <= i < 40 else 1)), None, "USD", "year", note if 20 <= i < 30 else None) for i, v in enumerate(true)]
    rows += [(900, "alone", "t", 1, None, 55.0, None, "USD", "year", note), (901, None, None, None, None, 70_000.0, None, "USD", "year", None)]
    got = _history(spark, rows)
    assert all(got[i][1] == ("segment" if 20 <= i < 40 else "fields") and abs(got[i][0] / v - 1) < 1e-9 for i, v in enumerate(true))
    assert got[900] == (55_000.0, "scaled") and got[901] == (70_000.0, "fields")


def test_ordinary_differences_of_pay_stay():
    rng = np.random.default_rng(5)
    for n in (8, 30, 200):
        for _ in range(50):
            x = rng.normal(11, 0.8, n)
            assert not units.hidden_factor(np.exp(x), None)[1].any()


LANGS = ["en", "EN", "en-US", "de", "xx", "", None]


def test_documents_of_any_language_are_scanned(spark, tmp_path):
    rows = [(str(i), lang, "Our TEAM, the team's töam") for i, lang in enumerate(LANGS)] + [("none", "en", None), ("other", None, "teams")]
    got = {r.doc_id: r.hits for r in _over(spark, tmp_path, "documents", rows, "doc_id string, lang string, text string", "A23_index_scan").collect()}
    assert got == {str(i): 2 for i in range(len(LANGS))}


def test_documents_of_any_language_are_tokenized(spark, tmp_path):
    text = "Crème BRÛLÉE, Ðà Nẵng; Ελλάδα Ё-mail été"
    rows = [(str(i), lang, text) for i, lang in enumerate(LANGS)] + [("none", "en", None)]
    got = {r.doc_id: r.t for r in _over(spark, tmp_path, "documents", rows, "doc_id string, lang string, text string", "H16_tokenizer").collect()}
    assert got == {str(i): "creme brulee ða nang ελλαδα е mail ete" for i in range(len(LANGS))} | {"none": None}
    con = connect(str(tmp_path))
    assert got == dict(con.execute(plans.oracle_sql()["H16_tokenizer"]).fetchall())


def test_pages_of_any_length_are_parsed(spark, tmp_path):
    texts = ["short", "\n".join(["word " * 9] * 2100), "x" * 99_999 + "\ny\nz", "\n".join(["längere Zeile " * 5] * 3000), None]
    rows = [(i, f"https://a.example/{i}", f"T{i}", t) for i, t in enumerate(texts)]
    got = {r.id: r for r in _over(spark, tmp_path, "parsed_pages", rows, "id long, url string, title string, text string", "A6_parse_html").collect()}
    assert sorted(got) == [0, 1, 2, 3]
    for i, t in enumerate(texts[:4]):
        kept, size = [], 0  # text nodes up to the one that reaches 100,000 bytes
        for node in [*t.split("\n"), "Jobs ", "here", "again", "out", "top", f"© Foot {i}"]:
            if size < 100_000:
                kept.append(node)
                size += len(node.encode()) + 1
        assert got[i].body == " ".join(" ".join(kept).split())
        assert (got[i].title, got[i].links, got[i].footer, got[i].noindex, got[i].nofollow) == (f"T{i}", 2, f"© Foot {i}", True, False)


def test_a_first_letter_may_be_wrong():
    """Wrong, missing and swapped first letters share a block, and many words pair up in any order."""
    names = pytest.importorskip("heronry.llm.names")
    for a, b in (("bright harbor", "vright harbor"), ("bright harbor", "right harbor"), ("bright harbor", "rbight harbor"), ("bright harbor", "bright yarbor"), ("one apple two three four", "one zapple two three four")):
        a, b = sorted(a.split()), sorted(b.split())
        assert names.block_keys(a, "labs") & names.block_keys(b, "labs") and names.alike(a, b) == (names.alike(b, a) or None)
    assert names.alike(sorted("one apple two three four".split()), sorted("six pear ten nine eight".split())) == 0.0
    assert names.alike(sorted("one apple two three four".split()), sorted("one apple two three four".split())) == 1.0
