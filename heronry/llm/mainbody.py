"""Problem 3: keep only the main body of each page.

The lines of a page are its nodes; headings, told by their form, are inner nodes and nest. Boosted trees over features of each node (density of it and its section,
tokens, depth, siblings, and how its words recur over the hosts of the crawl) give the probability that it's boilerplate; decoding along
the tree takes the likeliest labels under which a heading is kept exactly if something under it is.

Nobody labels lines. What structure shows labels the lines of a bounded sample: the footer element, rows and lists of links, paragraphs that
occur once, and lines that recur. A site repeats its notices on its own pages, so they come from few hosts for their number; words that authors
choose come from about as many hosts as chance would have.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heronry.llm._boost import fit, predict
from heronry.session import cut, shipped, spread, table

#: Pages whose lines train the trees, at most, and their longest text in characters: those of the lowest hash of id, the same at each run.
SAMPLE_PAGES, SAMPLE_CHARS = 1500, 200_000
TREES, DEPTH = 50, 5
#: A line recurs from so many different pages on, and this share of all; the share bounds the list of those (1 / SHARE times the lines of a page).
LEAST, SHARE = 8, 1e-4
#: The like for names that stand in rows of links.
LEAST_LINK = 3
#: Hosts of a recurring line as a share of those that chance would give: up to FEW it's the site's, from MANY on the authors'.
FEW, MANY = 0.4, 0.55
#: From this probability on a short line isn't taken for a heading; from NOT_KEPT on a line is dropped if it stands alone.
SURE, NOT_KEPT = 0.9, 0.5
#: Characters up to which a line's wording is compared without names and numbers, and a line can be a row of links.
WORDING = 200
#: Words that a paragraph has at least; words of a heading or a link at most.
PARAGRAPH, HEADING = 9, 6
SEPARATOR = r"\s(?:[|·>/»•])\s|\s{2,}"
_SEP = re.compile(SEPARATOR)
_WORD = re.compile(r"[^\W\d_]+")
_END = re.compile(r"[.!?…][\"'”’)]?$")
_SIGN, _DIGIT, _OTHER, _first = re.compile("[©|·>/@]"), re.compile(r"\d"), re.compile(r"[\W\d_]"), itemgetter(0)
_NO_HEADING = re.compile(r"[.!?:,;|·>/]|\s{2,}")


def _short(line: str) -> bool:
    """A line that can be a heading or a link: a few words that end no sentence."""
    return len(line) < 200 and 0 < len(line.split()) <= HEADING and not _NO_HEADING.search(line)


def footer_start(lines: list[str], footer: str | None) -> int:
    """The first line of the page's footer element, or the number of lines where the field is only the text's end."""
    if footer:
        want, got = " ".join(footer.split()), ""
        for k in range(len(lines) - 1, 0, -1):
            got = " ".join((lines[k] + " " + got).split())
            if got == want:
                return k if len(lines) - k <= 6 and all(len(x.split()) < 15 for x in lines[k:]) else len(lines)
            if len(got) > len(want):
                break
    return len(lines)


# --- how lines recur -------------------------------------------------------------------------------------------------------------


def _base(pages: DataFrame) -> DataFrame:
    host = F.coalesce(F.lower(F.regexp_extract(F.col("url").cast("string"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:www\.)?([^/?#:]+)", 1)), F.lit(""))
    return pages.select(F.col("id").cast("long").alias("id"), F.col("text").cast("string").alias("text"), F.col("footer_text").cast("string").alias("footer"), host.alias("host")).where("text is not null")


def _keyed(rows: DataFrame) -> DataFrame:
    """`rows` with keys and links. Only lines of up to WORDING characters are worth the search for names and numbers; longer ones are compared as they are."""
    # the site's name as its host spells it, however it is spaced and written in the text
    label = F.regexp_replace(F.regexp_replace("host", r"\.[a-z]{2,}$", ""), "[^a-z0-9]", "")
    name = F.concat(F.lit(r"(?i)(?<![\p{L}\p{N}])"), F.regexp_replace(label, "(.)(?=.)", r"$1[^\\p{L}\\p{N}]{0,3}"), F.lit(r"(?![\p{L}\p{N}])"))
    rows = rows.withColumn("name", F.when(F.length(label) >= 4, name).otherwise(F.lit(r"\b\B"))).withColumn("all", F.split("text", "\n", -1))

    def masked(s: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(F.trim(s), F.col("name"), F.lit("*")), F.lit(r"\d+"), F.lit("9"))

    def key(s: Column) -> Column:
        flat = F.regexp_replace(F.regexp_replace(masked(s), r"[ \t]*[|·][ \t]*|[ \t]{2,}", " "), r"^([^:]{3,30}): .*$", "$1:*")
        return F.xxhash64(F.when(F.length(s) <= WORDING, F.trim(flat)).otherwise(s))

    row = F.filter("all", lambda s: (F.length(s) <= WORDING) & s.rlike(rf"(?:{SEPARATOR}).*(?:{SEPARATOR})") & ~F.trim(s).rlike(r"[.!?…]$"))
    parts = F.transform(row, lambda s: F.filter(F.split(masked(s), SEPARATOR), lambda p: F.trim(p) != ""))
    names = F.filter(parts, lambda ps: (F.size(ps) >= 3) & F.forall(ps, lambda p: F.size(F.split(F.trim(p), r"\s+")) <= 3))
    links = F.transform(F.array_distinct(F.flatten(names)), lambda p: F.xxhash64(F.trim(p)))
    return rows.withColumn("keys", F.transform("all", key)).withColumn("links", links).drop("name", "all")


def prepared(pages: DataFrame) -> DataFrame:
    """(id, text, footer, host, keys, links): keys has a number for each line's wording without digits, the site's name, and what stands behind a label's colon; links those of the names in rows of links."""
    return _keyed(_base(pages))


class Recurring(NamedTuple):
    """lines: (pages, hosts as a share of those by chance) of each recurring line; links: names that stand in rows of links again and again."""

    lines: dict[int, tuple[int, float]]
    links: frozenset[int]


def expected_hosts(n: int, sizes: list[tuple[int, int]]) -> float:
    """Hosts that n pages drawn by chance come from; sizes: (pages of a host, hosts of that size)."""
    total = sum(s * c for s, c in sizes)
    return sum(c * -math.expm1(n * math.log1p(-min(s / total, 1 - 1e-12))) for s, c in sizes)


def recurring(rows: DataFrame) -> Recurring:
    """How the lines of all pages recur. Copies of a page on a host count once; counts are combined before each shuffle, and what comes to the driver is bounded by shares of the pages."""
    once = rows.groupBy("host", F.xxhash64("text").alias("t")).agg(F.first("keys").alias("keys"), F.first("links").alias("links"))
    of = lambda c, link: F.transform(F.array_distinct(c), lambda k: F.struct(F.lit(link).alias("link"), k.alias("key")))
    page = F.array(F.struct(F.lit(True).alias("link"), F.lit(None).cast("long").alias("key")))
    each = once.select("host", F.explode(F.concat(page, of("keys", False), of("links", True))).alias("x")).select("host", "x.link", "x.key")
    per = each.groupBy("host", "link", "key").agg(F.count("*").alias("n"))
    # sizes of hosts, rounded to a fortieth, are few however many hosts there are
    size = F.when(F.col("key").isNull(), F.pow(F.lit(1.025), F.round(F.log("n") / math.log(1.025))))
    per = cut(per.groupBy("link", "key", size.alias("size")).agg(F.sum("n").alias("n"), F.count("*").alias("hosts")))
    sizes = [(r["size"], r.hosts) for r in per.where("key is null").select("size", "hosts").collect()]
    pages = sum(s * c for s, c in sizes)
    least = F.when(F.col("link"), F.lit(max(LEAST_LINK, SHARE * pages))).otherwise(F.lit(max(LEAST, SHARE * pages)))
    found = per.where(F.col("key").isNotNull() & (F.col("n") >= least)).select("link", "key", "n", "hosts").collect()
    by_chance: dict[int, float] = {}
    for n in {r.n for r in found if not r.link}:
        by_chance[n] = max(expected_hosts(n, sizes), 1e-9)
    return Recurring({r.key: (r.n, r.hosts / by_chance[r.n]) for r in found if not r.link}, frozenset(r.key for r in found if r.link))


# --- features and labels of nodes ---------------------------------------------------------------------------------------------------

_SEEN: dict[str, tuple] = {}
#: Lines remembered by a Python worker with their features; beyond it the memory starts anew.
REMEMBERED = 50_000


def tokens(line: str) -> list:
    """Words, pairs of them and signs of links; what a DOM's attributes tell, a line's words tell here."""
    ws = _WORD.findall(line.lower())
    return [*ws, *zip(ws, ws[1:]), *_SIGN.findall(line), ("", *ws[:2])]


def _line_features(s: str, odds: dict) -> tuple:
    """A line's own features; headings and notices recur, so they are remembered for one set of odds."""
    if _SEEN.get("") is not odds or len(_SEEN) > REMEMBERED:
        _SEEN.clear()
        _SEEN[""] = odds  # type: ignore[assignment]
    if s and (got := _SEEN.get(s)) is not None:
        return got
    words = s.split()
    parts = [len(p.split()) for p in _SEP.split(s) if p and not p.isspace()] if _SEP.search(s) else [len(words)] * bool(s)
    get = odds.get
    o = [get(t, 0.0) for t in tokens(s)]
    n, chars = max(1, len(words)), max(1, len(s))
    out = (
        len(words), len(s), len(s) / n, bool(_END.search(s, max(0, len(s) - 2))), len(parts), max(parts, default=0), len(_DIGIT.findall(s)) / chars, sum(map(str.isupper, map(_first, words))) / n, (chars - len(_OTHER.findall(s))) / chars, s.count(",") + s.count(";"),
        sum(o) / len(o), max(o), min(o), _short(s), ":" in s,
    )
    if s and len(s) < 200:
        _SEEN[s] = out
    return out


OWN = 15
_WORDS, _ENDS, _PARTS, _PART_WORDS, _ODDS, _IS_SHORT = 0, 3, 4, 5, 10, 13


class Nodes:
    """The lines of some pages, one page after the other, with what features and labels are made of."""

    def __init__(self, split: list[list[str]], keys: list, footers: list, known: Recurring, odds: dict):
        sizes = np.array([len(s) for s in split], dtype=np.int64)
        self.first = np.r_[0, np.cumsum(sizes)[:-1]] if len(sizes) else np.zeros(0, np.int64)
        n = int(sizes.sum())
        self.own = np.array([_line_features(s.strip(), odds) for ls in split for s in ls], dtype=float).reshape(n, OWN)
        self.start, self.size = np.repeat(self.first, sizes), np.repeat(sizes, sizes)
        self.at = np.arange(n) - self.start
        self.footer = np.repeat([footer_start(ls, f if isinstance(f, str) else None) for ls, f in zip(split, footers)], sizes) if n else np.zeros(0)
        flat = [k for ks in keys for k in ks]
        self.recurs = np.array([known.lines.get(k, (1, -1.0)) for k in flat], dtype=float).reshape(n, 2)
        self.named = np.array([k in known.links for k in flat], dtype=bool)
        self.short = self.own[:, _IS_SHORT] > 0
        self.run, self.ahead = self._runs(self.short), self._runs(self.short, back=True)
        # links in a row from where the row of short lines starts
        self.row = np.where(self._runs(self.named & self.short) == self.run, self.run, 0)
        self.prose = (self.own[:, _WORDS] >= PARAGRAPH) & (self.own[:, _ENDS] > 0) & ~(self.recurs[:, 1] >= 0)

    def _runs(self, mask: np.ndarray, back: bool = False) -> np.ndarray:
        """How many lines in a row, up to each one (back: from it on), of its page have the mask; 0 where it hasn't."""
        i, edge = np.arange(len(mask)), self.at == (self.size - 1 if back else 0)
        if back:
            mask, edge = mask[::-1], edge[::-1]
        last = np.maximum.accumulate(np.where(~mask, i, np.where(edge, i - 1, -1))) if len(mask) else i
        return (i - last)[::-1] if back else i - last

    def _next(self, v: np.ndarray, by: int) -> np.ndarray:
        """The value `by` lines further on the same page, 0 beyond its ends."""
        out = np.zeros_like(v)
        if by > 0:
            out[:-by] = v[by:]
        elif by < 0:
            out[-by:] = v[:by]
        ok = (self.at + by >= 0) & (self.at + by < self.size)
        return np.where(ok if v.ndim == 1 else ok[:, None], out, np.zeros((), v.dtype))

    def features(self) -> np.ndarray:
        n = len(self.own)
        if not n:
            return np.zeros((0, 0))
        total = np.cumsum(self.prose)
        before = total - total[self.start] + self.prose[self.start]
        whole = before[self.start + self.size - 1]
        # density of the section that a heading opens: words and lines up to the next short line
        opens = np.maximum.accumulate(np.where(self.short | (self.at == 0), np.arange(n), 0))
        words = np.bincount(opens, self.own[:, _WORDS], n) - np.where(self.short, self.own[:, _WORDS], 0)
        near = np.c_[self.own[:, [_WORDS, _ENDS, _PARTS, _ODDS, _IS_SHORT]], self.recurs[:, 1], self.named]
        place = [np.log(self.recurs[:, 0]), self.recurs[:, 1], self.named, self.row, self.at, self.size - self.at, self.at / self.size, self.at >= self.footer, self.run, self.ahead, before, whole - before, whole, words[opens], words * self.short]
        return np.hstack([self.own, self._next(near, -1), self._next(near, 1), np.stack(place, axis=1).astype(float)])

    def labels(self) -> np.ndarray:
        """1 boilerplate, 0 main body, -1 not told."""
        y = np.full(len(self.own), -1)
        own, ratio = self.own, self.recurs[:, 1]
        first, last = np.arange(len(y)) - self.run + 1, np.arange(len(y)) + self.ahead - 1
        many = (ratio >= MANY) & ~self.named
        y[self.prose | many] = 0
        y[(ratio >= 0) & (ratio <= FEW) & ~self.named] = 1
        y[(own[:, _PARTS] >= 3) & (own[:, _PART_WORDS] <= 4) & (own[:, _ENDS] == 0)] = 1
        # short lines in a row: up to two headings stand before a paragraph; of a longer row at the top all but its last two are links
        told = self.short & (y < 0)
        prose = [self._next(self.prose, k) for k in (1, 2, 3)]
        run = self.run + self.ahead - 1
        y[told & (self.named & prose[0] & (run <= 2))] = 0
        y[told & ~self.named & (prose[0] | prose[1] | prose[2])] = 0
        links = (self.row >= 1) & (self.row[np.clip(np.minimum(first + 2, last), 0, len(y) - 1)] >= 3) if len(y) else told
        y[told & (links | ((run >= 4) & (self.at < self.size / 2) & (np.arange(len(y)) <= last - 2)))] = 1
        y[self.at >= self.footer] = 1
        y[own[:, _WORDS] == 0] = -1
        return y


def token_odds(samples: list[tuple[str, int]]) -> dict:
    """Log odds of each token for boilerplate, smoothed; a line that occurs again and again counts up to 20 times."""
    counts, total = (Counter(), Counter()), [1.0, 1.0]
    for (line, y), n in Counter((re.sub(r"\d+", "9", s.strip()), y) for s, y in samples).items():
        w = float(min(n, 20))
        total[y] += w
        for t in set(tokens(line)):
            counts[y][t] += w
    # frequencies in ten thousand lines, so that the smoothing doesn't depend on the sample's size or balance
    f = [{t: v / total[c] * 1e4 for t, v in counts[c].items()} for c in (0, 1)]
    return {t: math.log((f[1].get(t, 0) + 2) / (f[0].get(t, 0) + 2)) for t in f[0].keys() | f[1].keys()}


def train(pages: list[tuple[str, str | None, list[int]]], known: Recurring) -> dict:
    """Trees and token odds from the lines of (text, footer, keys) pages that structure labels. Odds come from one half of the wordings for the other, so trees learn how far to trust words in lines never seen."""
    split, footers, keys = [t.split("\n") for t, _, _ in pages], [f for _, f, _ in pages], [k for _, _, k in pages]
    ys = Nodes(split, keys, footers, known, {}).labels()
    lines, half = [s for ls in split for s in ls], np.array([k for ks in keys for k in ks], dtype=np.int64) & 1
    words = lambda keep: token_odds([(s, int(y)) for s, y, h in zip(lines, ys, half) if y >= 0 and h in keep])
    x, y = [], []
    for h in (0, 1):
        told = (half == h) & (ys >= 0)
        if told.any():
            x.append(Nodes(split, keys, footers, known, words({1 - h})).features()[told])
            y.append(ys[told])
    model = fit(np.vstack(x), np.concatenate(y).astype(float), trees=TREES, depth=DEPTH) if x else None
    return {"model": model, "odds": words({0, 1}), "known": known}


# --- decoding ---------------------------------------------------------------------------------------------------------------------


def heading_tree(short: np.ndarray, p: np.ndarray) -> list[int]:
    """The heading over each line, -1 for none. A heading with nothing of its own before the next heading is over that one; the headings after it are its sections until such a chain starts again."""
    n = len(short)
    heads = [k for k in range(n) if short[k] and p[k] < SURE]
    parent, chain, at = [-1] * n, False, -1
    for i, k in enumerate(heads):
        end = heads[i + 1] if i + 1 < len(heads) else n
        bare = not (p[k + 1 : end] < NOT_KEPT).any()
        if bare and end < n and p[k] >= NOT_KEPT:
            parent[k] = at  # a stray link, say: it heads nothing
            parent[k + 1 : end] = [at] * (end - k - 1)
            continue
        over = at if chain else (parent[at] if at >= 0 and not bare else -1)
        parent[k], at, chain = over, k, bare and end < n
        parent[k + 1 : end] = [k] * (end - k - 1)
    return parent


def decode(short: np.ndarray, p: np.ndarray) -> np.ndarray:
    """True for each line that's boilerplate; p: its probability of that. The likeliest labels under which a heading is kept exactly if a line or heading under it is."""
    p = np.clip(p, 1e-4, 1 - 1e-4)
    n, parent = len(p), heading_tree(short, p)
    gain = (np.log(1 - p) - np.log(p)).tolist()  # of keeping the node itself over dropping it
    isolated = [bool(short[k]) and p[k] < SURE and p[k] < NOT_KEPT for k in range(n)]  # a heading with nothing under it heads nothing
    kids: dict[int, list[int]] = {}
    for k, q in enumerate(parent):
        kids.setdefault(q, []).append(k)
    worth = [0.0] * n  # of keeping something of the node's branch over dropping all of it
    for k in range(n - 1, -1, -1):  # children stand behind their heading
        if k in kids:
            under = [worth[c] for c in kids[k]]
            best = sum(v for v in under if v > 0)
            worth[k] = gain[k] + (best if best > 0 else max(under))
        else:
            worth[k] = min(gain[k], -1e-9) if isolated[k] else gain[k]
    out = np.ones(n, dtype=bool)
    for k in range(n):
        q = parent[k]
        if q >= 0 and out[q]:
            continue
        keep = worth[k] > 0
        if q >= 0 and not keep and all(worth[c] <= 0 for c in kids[q]):
            keep = k == max(kids[q], key=lambda c: worth[c])
        out[k] = not keep
    return out


# --- the operator -----------------------------------------------------------------------------------------------------------------


def learned(pages: DataFrame) -> dict:
    """What `main_body` judges by; can be kept and used for other pages of the same crawl."""
    known = recurring(prepared(pages))
    rows = _base(pages).where(F.col("id").isNotNull() & (F.trim("text") != "") & (F.length("text") <= SAMPLE_CHARS)).orderBy(F.xxhash64("id"), "id", F.length("text")).limit(SAMPLE_PAGES)
    sample = pages.sparkSession.createDataFrame(rows.toArrow())
    got = sorted(((r.text, r.footer, r["keys"]) for r in _keyed(sample).select("text", "footer", "keys").collect()), key=lambda r: (r[0], r[1] or ""))
    return train(got, known)


def main_body(pages: DataFrame, model: dict | None = None, with_lines: bool = True) -> DataFrame:
    """(id, line_no, line, main): each line of each page, counted from 1, and whether it belongs to the main body.

    Null text has no lines; empty text has one, empty, which isn't part of a body; blank lines are none either. Repeated rows give repeated lines. Other
    columns are ignored; pages of unusable url count as one host. How lines recur is counted over all pages; the trees are trained on at most SAMPLE_PAGES pages (a documented
    bound), or taken from `model` (see `learned`). Without a page to learn from nothing is main body. Pages are judged one by one, so nothing but the sample leaves its task. Without
    `with_lines` the lines themselves are left out.
    """
    rows = prepared(pages)
    shared = pages.sparkSession.sparkContext.broadcast(model or learned(pages))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for b in batches:
            for lo in range(0, len(b), 512):
                part = b.iloc[lo : lo + 512]
                split = [t.split("\n") for t in part["text"]]
                nodes = Nodes(split, part["keys"].tolist(), part["footer"].tolist(), m["known"], m["odds"])
                p = predict(m["model"], nodes.features()) if m["model"] else np.ones(len(nodes.own))
                bad = [decode(nodes.short[a : a + len(s)], p[a : a + len(s)]) for a, s in zip(nodes.first, split)]
                blank = nodes.own[:, _WORDS] == 0
                text = {"line": [x for s in split for x in s]} if with_lines else {}
                yield pd.DataFrame({"id": np.repeat(part["id"].to_numpy(), [len(s) for s in split]), "line_no": nodes.at + 1, **text, "main": ~np.concatenate(bad) & ~blank})

    out = "id long, line_no long, line string, main boolean" if with_lines else "id long, line_no long, main boolean"
    return spread(rows.select("id", "text", "footer", "keys"), "id").transform(shipped).mapInPandas(run, out)


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_body(table(spark, sf_dir, "parsed_pages"), with_lines=False).where("not main and id is not null").select("id", "line_no").distinct()


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, body): the main body of each page, its lines in order; null where nothing of the page is one."""
    kept = F.array_sort(F.collect_list(F.when(F.col("main"), F.struct("line_no", "line"))))
    body = F.nullif(F.array_join(F.transform("kept", lambda x: x["line"]), "\n"), F.lit(""))
    return main_body(table(spark, sf_dir, "parsed_pages")).groupBy("id").agg(kept.alias("kept")).select("id", body.alias("body"))


QUERIES = {"p3_found": found, "p3_body": bodies}
SQL: dict[str, str] = {}
