"""Problem 7: the same quantity recorded in different units, converted to one unit (pay in US dollars a year).

What a record or its text states (currency, period, thousands or hundredths) is read first. Then the history of each source is
segmented by an exact penalised changepoint search on the logarithms of the stated values; a segment whose level is off
by a known factor (1,000, 1/100 or that of a period) marks a change of unit that nothing states, and is reversed.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronry.session import cut, shipped, spread, table

#: What a year has of each period.
PER_YEAR = {"hour": 2080.0, "day": 260.0, "week": 52.0, "month": 12.0, "year": 1.0}
#: How currencies are written besides their codes and names.
SIGNS = {
    "us$": "USD", "$": "USD", "us dollar": "USD", "dollar": "USD", "usd": "USD", "€": "EUR", "euro": "EUR", "eur": "EUR", "£": "GBP", "pound": "GBP", "pound sterling": "GBP", "sterling": "GBP",
    "sfr": "CHF", "fr": "CHF", "swiss franc": "CHF", "franken": "CHF", "ca$": "CAD", "c$": "CAD", "can$": "CAD", "a$": "AUD", "au$": "AUD", "¥": "JPY", "yen": "JPY", "jp¥": "JPY",
    "₹": "INR", "rs": "INR", "rupee": "INR", "inr": "INR", "zł": "PLN", "zl": "PLN", "zloty": "PLN", "złoty": "PLN", "kr": "SEK", "krona": "SEK", "kronor": "SEK", "kč": "CZK", "koruna": "CZK",
    "r$": "BRL", "real": "BRL", "reais": "BRL", "mx$": "MXN", "mex$": "MXN", "₦": "NGN", "naira": "NGN", "ksh": "KES", "kenyan shilling": "KES", "rand": "ZAR", "zar": "ZAR", "s$": "SGD", "sg$": "SGD",
    "₱": "PHP", "php": "PHP", "philippine peso": "PHP", "mexican peso": "MXN", "₺": "TRY", "tl": "TRY", "lira": "TRY",
}
#: Periods as written, the stem that a word must have.
_PERIODS = [
    ("year", r"years?|yr|yearly|annum|annual(?:ly)?|annually|p\.?\s?a\.?|jahr|jährlich|année|annuel|annuels|año|anual(?:es)?"),
    ("month", r"months?|mo|monthly|p\.?\s?m\.?|pcm|mth|monat|monatlich|mois|mensuel|mensuels|mes|mensual(?:es)?"),
    ("week", r"weeks?|wk|weekly|p\.?\s?w\.?|woche|wöchentlich|semaine|semana"),
    ("day", r"days?|daily|day rate|daily rate|p\.?\s?d\.?|tag|täglich|jour|día"),
    ("hour", r"hours?|hr|hrs|hourly|p\.?\s?h\.?|stunde|heure|hora"),
]
_PERIOD = re.compile(r"(?P<french>^par an\b)|" + "|".join(rf"(?P<{k}>^(?:(?:per|an?|/|each|every|pro|im|par|por|al)(?:\s+|(?<=/)\s*))?(?:{v})(?!\w))" for k, v in _PERIODS), re.I)
_NUM = r"\d{1,3}(?:[.,'’ ]\d{3})+(?!\d)(?:[.,]\d{1,2}(?!\d))?|\d+(?:[.,]\d{1,2}(?!\d))?"
#: What stands behind a number to make it larger.
_TIMES = {"k": 1e3, "m": 1e6, "mn": 1e6, "mio": 1e6, "million": 1e6, "millions": 1e6, "lakh": 1e5, "lakhs": 1e5, "lac": 1e5, "lacs": 1e5, "crore": 1e7, "crores": 1e7}
_FROM = r"(?:from|up to|at least|ab|bis(?: zu)?|à partir de|dès|jusqu[’']à|desde|hasta)"


def _one(name: str) -> str:
    return rf"(?P<{name}>{_NUM})(?:\s?(?P<{name}k>{'|'.join(sorted(_TIMES, key=len, reverse=True))})(?!\w))?"


def _money(codes: list[str]) -> re.Pattern:
    """The pay stated in a text: currency and amounts in any order, then the period."""
    sign = "(?:" + "|".join(re.escape(s) for s in sorted({*SIGNS, *(c.lower() for c in codes)}, key=len, reverse=True)) + r")(?:s(?!\w)|\.)?(?: brutto)?"
    before = rf"(?<![\w$]){sign}"
    return re.compile(
        rf"(?:(?P<c1>{before})\s?)?(?:{_FROM}\s)?(?:(?P<c3>{before})\s?)?" + _one("a") + rf"(?:\s?(?:[-–—]{{1,2}}|to|bis|à|a|and|y|et)\s?(?:(?P<c4>{sign})\s?)?" + _one("b") + rf")?(?:\s?(?P<c2>{sign})(?!\w))?(?:\s?(?:gross|brutto|bruts?|brutos?))?\s?(?P<rest>.{{0,24}})",
        re.I,
    )


_PAY = re.compile(r"(?i)\b(pay|salary|salaries|compensation|wages?|we offer|you can expect|range for this post|gehalt|vergütung|lohn|entgelt|rémunération|salaire|salario|sueldo|retribución)\b")
_NOT_PAY = re.compile(r"(?i)\b(bonus|budget|lunch|worth|customers?|clients?|save|assets|raised|relocation|training|funds?|funding|revenue|turnover|orders|allowance|voucher|prime|prämie|referral|donat\w+|invest\w+)\b")
_THOUSANDS = re.compile(r"(?i)\b(?:given|shown|stated|quoted|are|figures|amounts?|values?)\b[^.\n]{0,30}\b(?:in|as) (?:thousands?|k)\b")
_HUNDREDTHS = re.compile(r"(?i)\b(?:in|as) (?:cents|pence|hundredths|minor units)\b")
_IN_CURRENCY = re.compile(r"(?i)\b(?:figures are|all amounts|amounts are|paid|pay is|salary is|stated|quoted)(?: \w+)? in ([^.\n;,]{1,30})")
_IN_PERIOD = re.compile(r"(?i)\b(?:pay is quoted|the rate shown is|all amounts are|rates? (?:is|are)|amounts are|salary is (?:quoted|stated)) ([^.\n;,]{1,24})")
#: Words without which a text says nothing of thousands or hundredths.
_NOTES = re.compile(r"(?i)thousand|\bk\b|cents|pence|hundredths|minor units|&")
#: US dollars a year that can be pay.
PLAUSIBLE = (1e3, 5e6)
#: Ratio of a segment's level to its history's that betrays each factor.
FACTORS = {1000.0: -math.log(1000.0), 0.01: math.log(100.0)}
#: The like of factors that only a whole segment betrays.
WHOLE_FACTORS = {0.001: math.log(1000.0)}
#: How far a segment's level may lie from where a factor would put it, in log units.
OFF = 1.6
#: Spread of pay within a source, in log units; rows of one history that one task segments at once; rows of its neighbours that a piece sees besides.
SPREAD, PIECE, HALO = 0.8, 4000, 500
#: Values that a segment must have to decide by its level alone; how far levels drift without a change of unit, in log units.
LEAST_SEGMENT, DRIFT = 8, 0.15
#: Distance of an ordinary value from its history's level, half a factor of 12, and rounds in which the level is taken from ordinary values.
NEAR, ROUNDS = math.log(12.0) / 2, 3
#: Standard deviations that a level may lie off its factor's; log odds by which that factor must beat the next one, and a value's own place its segment's factor.
FIT, ODDS, OWN_ODDS = 3.0, 3.0, 7.0
#: A shorter history has no level to be off from.
LEAST = 8


def plain(text: str) -> str:
    """Text without tags, entities and emphasis, so that amounts broken up by markup can be read."""
    if "&" in text:
        text = html.unescape(html.unescape(text))
    text = re.sub(r"(?i)<\s*/?\s*(?:p|br|li|ul|ol|div|h[1-6]|tr|table|td|th|pre)\b[^>]*>", "\n", text)
    text = re.sub(r"<!--.*?-->|<[a-zA-Z/][^>]*>", "", text, flags=re.S)
    text = re.sub(r"\\([$%&#_])", r"\1", text).replace("~", " ")
    text = re.sub(r"(?<=[A-Za-z:])[–•](?=\s)", "", unicodedata.normalize("NFKC", text))  # residue within a phrase; NFKC also makes all kinds of spaces plain
    return re.sub(r"[ \t\u200b]+", " ", re.sub(r"\*\*|__|'{2,}|`", "", text))


def number(s: str) -> float:
    """12,500, 12.500, 12 500, 12'500, 12500, 5.50 and 5,50."""
    s = re.sub(r"['’ ]", "", s)
    m = re.fullmatch(r"(\d{1,3}(?:[.,]\d{3})+)(?:[.,](\d{1,2}))?", s)
    if m:
        return float(re.sub(r"[.,]", "", m[1]) + "." + (m[2] or "0"))
    return float(s.replace(",", "."))


def period(s: object) -> str | None:
    if not isinstance(s, str):
        return None
    m = _PERIOD.search(s.strip().lower())
    return None if not m else 'year' if m.lastgroup == 'french' else m.lastgroup


class Reader:
    """Reads what records state; rates: US dollars of a unit of each currency, names: its name."""

    def __init__(self, rates: dict[str, float], names: dict[str, str]):
        self.rates = {k.strip().upper(): v for k, v in rates.items() if k and v and v > 0}
        self.money = _money(list(self.rates))
        self.names = {k: v for k, v in SIGNS.items()} | {(n or "").strip().lower(): c.strip().upper() for c, n in names.items() if c and n}

    def currency(self, s: object) -> str | None:
        """The listed currency's code, '' if a currency is stated that isn't listed, None if none is stated."""
        if not isinstance(s, str) or not s.strip():
            return None
        t = re.sub(r"\s+", " ", s.strip().lower())
        t = re.sub(r"\s*(gross|brutto|bruts?|net)$", "", t)
        for v in (t, t.rstrip("."), t.rstrip("s"), t.rstrip(".s")):
            if v.upper() in self.rates:
                return v.upper()
            if v in self.names:
                return self.names[v] if self.names[v] in self.rates else ""
        return ""

    def stated(self, text: str) -> float | None:
        """US dollars a year of the first pay that the text states, with currency and period."""
        for sentence in re.split(r"\n|(?<=[.!?])\s+(?=[A-ZÄÖÜÉ<])", text):
            if not _PAY.search(sentence) or _NOT_PAY.search(sentence) or not re.search(r"\d", sentence):
                continue
            for m in self.money.finditer(sentence):
                per = period(re.sub(r"^(?:gross|brutto|bruts?|brutos?)\s+", "", m["rest"].strip(), flags=re.I))
                code = next((c for c in (self.currency(m[k]) for k in ("c1", "c3", "c4", "c2")) if c), None)
                if not per or not code:
                    continue
                a, b = number(m["a"]), number(m["b"]) if m["b"] else None
                # 80k-90k, 80-90k and 31-46 lakh: what makes the second amount larger holds for the first too
                a *= _TIMES[(m["ak"] or m["bk"]).lower()] if m["ak"] or m["bk"] and a <= b else 1.0
                if m["bk"]:
                    b *= _TIMES[m["bk"].lower()]
                return (a if b is None else (a + b) / 2) * self.rates[code] * PER_YEAR[per]
        return None

    def record(self, lo: float, hi: float, cur: object, per: object, text: object) -> tuple[float | None, float | None, float | None]:
        """(US dollars a year of the fields as they stand, factor that the text states, US dollars a year of the text)."""
        given = [float(v) for v in (lo, hi) if v is not None and math.isfinite(v) and v > 0]
        text, value, factor = text if isinstance(text, str) else "", None, None
        if given and isinstance(cur, str) and cur.strip() and period(per) and not _NOTES.search(text):
            # nothing to look up in the text, unless the fields turn out to be no pay
            code = self.currency(cur)
            if code:
                value = sum(given) / len(given) * self.rates[code] * PER_YEAR[period(per)]
                if PLAUSIBLE[0] <= value < PLAUSIBLE[1]:
                    return value, None, None
        text = plain(text) if text else ""
        # the notes are plain sentences; dashes and bullets within them are residue of markup
        note = re.sub(r"[ \t–•]+", " ", text) if given else ""
        if given:
            code = self.currency(cur)
            if code is None and text:
                for m in _IN_CURRENCY.finditer(note):
                    code = self.currency(m[1])
                    if code:
                        break
            p = period(per)
            if p is None and text and not (isinstance(per, str) and per.strip()):
                p = next((x for x in (period(m[1]) for m in _IN_PERIOD.finditer(note)) if x), None)
            if code and p:
                value = sum(given) / len(given) * self.rates[code] * PER_YEAR[p]
            if text:
                factor = 1000.0 if _THOUSANDS.search(note) else 0.01 if _HUNDREDTHS.search(note) else None
        if value is not None and PLAUSIBLE[0] <= value * (factor or 1.0) < PLAUSIBLE[1]:
            return value, factor, None
        return value, factor, self.stated(text) if text and _PAY.search(text) else None


def segments(x: np.ndarray, spread_: float = SPREAD, penalty: float | None = None, whole: int | None = None) -> np.ndarray:
    """First positions of the segments of the exact least-cost segmentation: squared deviations in units of the spread plus a penalty each.

    Candidates that can never be the last change again are pruned (PELT), which keeps the search exact. `whole`: values of the whole history, of which x is a
    piece; its penalty holds for the piece too.
    """
    n = len(x)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    beta = 2 * math.log((whole or n) + 1) + 2 if penalty is None else penalty
    s1, s2 = np.r_[0.0, np.cumsum(x)], np.r_[0.0, np.cumsum(x * x)]
    best, last = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=np.int64)
    best[0] = -beta
    open_ = np.array([0])
    for j in range(1, n + 1):
        k = j - open_
        cost = best[open_] + (s2[j] - s2[open_] - (s1[j] - s1[open_]) ** 2 / k) / spread_**2
        at = int(np.argmin(cost))
        best[j], last[j] = cost[at] + beta, open_[at]
        open_ = np.r_[open_[cost <= best[j]], j]
    starts, j = [], n
    while j > 0:
        j = int(last[j])
        starts.append(j)
    return np.array(starts[::-1])


def level_factor(shift: float, n: int, said: float | None = None) -> tuple[float, float] | None:
    """(factor, the shift that it makes) of a segment of n values whose level is off by `shift`; None where no factor fits, or two do.

    `said`: what a year has of the period that the values state; another period in truth is a factor, too.
    """
    if n < LEAST_SEGMENT:
        return None
    var = SPREAD**2 / n + DRIFT**2
    periods = {k / said: -math.log(k / said) for k in PER_YEAR.values() if k != said} if said else {}
    (off, factor, expected), (next_, *_) = sorted((abs(shift - e), f, e) for f, e in ({1.0: 0.0} | FACTORS | WHOLE_FACTORS | periods).items())[:2]
    return (factor, expected) if factor != 1.0 and off <= FIT * math.sqrt(var) and (next_**2 - off**2) / (2 * var) >= ODDS else None


def hidden_factor(values: np.ndarray, level: float | None = None, usual: float | None = None, said: np.ndarray | None = None, whole: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each value of one history (or a piece of it) in order of time: the factor that its segment's level calls for, 1 where it's in line,
    and whether the segment is long enough that this holds for values that could be pay as they stand.

    `level` is the whole history's usual value, by default the median of the ordinary `values`; `usual` that of all histories: where a segment's level is nearer to it
    than the history's, the segment isn't what is off. `said`: what a year has of the period that each value states, NaN where none is; a segment with
    different ones isn't compared with periods. `whole`: values of the whole history.
    """
    x = np.log(values)
    out, sure = np.ones(len(x)), np.zeros(len(x), dtype=bool)
    if level is None and len(x) < LEAST:
        return out, sure
    base = float(np.median(x)) if level is None else math.log(level)
    for _ in range(ROUNDS if level is None else 0):
        base = float(np.median(x[np.abs(x - base) <= NEAR])) if (np.abs(x - base) <= NEAR).any() else base
    middle = base if usual is None else math.log(usual)
    starts = segments(x, whole=whole)
    for a, b in zip(starts, [*starts[1:], len(x)]):
        shift = float(x[a:b].mean()) - base
        for factor, expected in FACTORS.items():
            if abs(shift - expected) <= OFF:
                out[a:b][np.abs(x[a:b] - base - expected) <= OFF] = factor
        one = None if said is None or not np.isfinite(said[a]) or (said[a:b] != said[a]).any() else float(said[a])
        by_level = level_factor(shift, b - a, one)
        if by_level and abs(base - middle) <= abs(base + shift - middle):
            d = x[a:b] - base
            off = (d - by_level[1]) ** 2 - d**2 <= 2 * SPREAD**2 * OWN_ODDS
            out[a:b][off], sure[a:b][off] = by_level[0], True
    return out, sure


def _small(df: DataFrame, what: str, most: int = 1000) -> list:
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{what} has over {most} rows")
    return rows


def to_common_unit(jobs: DataFrame, rates: DataFrame) -> DataFrame:
    """(id, usd_year, how): US dollars a year of each posting whose pay can be told; how is fields, scaled, segment or text.

    The fields count first, in the unit that their segment's level shows: what the text says of thousands or hundredths is confirmed by it (segment), or goes by itself
    where the history doesn't show it (scaled). A board is a history; boards of under LEAST postings go with their source. Postings of one time follow by id, postings without a time come first. If
    the fields give no amount, or one outside 1,000 to 5,000,000 dollars, the pay stated in the text counts. An amount of zero or less, or NaN, isn't given; two
    amounts count by their middle. Null text, fields and times are allowed; no rates, or an empty table, give no rows; repeated rows give
    one row each; other columns are ignored. `rates` is small by definition and its size is checked.
    """
    fx = _small(rates.select("currency", F.col("usd_per_unit").cast("double"), "currency_name"), "rates")
    reader = Reader({r[0]: r[1] for r in fx if r[0]}, {r[0]: r[2] for r in fx if r[0]})

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [reader.record(*r) for r in zip(b["lo"], b["hi"], b["cur"], b["per"], b["text"])]
            got = pd.DataFrame(rows, columns=["value", "factor", "told"], dtype="float64")
            got["said"] = b["per"].map(lambda p: PER_YEAR.get(period(p))).astype("float64").to_numpy()
            yield pd.concat([b[["id", "board", "source", "t"]].reset_index(drop=True), got], axis=1)

    src = jobs.select(
        F.col("id").cast("long").alias("id"), F.col("board_key").cast("string").alias("board"), F.col("source").cast("string").alias("source"), F.coalesce("posted_at", "first_seen").cast("long").alias("t"),
        F.col("salary_min").cast("double").alias("lo"), F.col("salary_max").cast("double").alias("hi"), F.col("salary_currency").alias("cur"), F.col("salary_period").alias("per"), F.col("description").alias("text"),
    ).where("id is not null")
    parsed = spread(src, "id").transform(shipped).mapInPandas(read, "id long, board string, source string, t long, value double, factor double, told double, said double").where("value is not null or told is not null")
    # texts are read once: what they say is a few numbers a row, written to the shared folder
    parsed = cut(parsed.withColumn("t", F.coalesce("t", F.lit(0))))
    boards = parsed.where("value > 0 and board is not null").groupBy(F.col("board").alias("b")).agg(F.count("*").alias("c")).where(F.col("c") >= LEAST).select("b")
    history = F.when(F.col("b").isNotNull(), F.concat(F.lit("board "), "b")).otherwise(F.concat(F.lit("source "), F.coalesce("source", F.lit(""))))
    parsed = parsed.join(boards, F.col("board") == F.col("b"), "left").select("id", history.alias("history"), "t", "value", "factor", "told", "said")
    # histories of over PIECE rows are cut at quantiles of time, so that no task holds a long one; a piece sees HALO rows on each side as well,
    # so that a segment over a border is judged by more than its part on one side
    good = F.when(F.col("value") > 0, F.col("value"))
    usual = F.when(F.count(good) >= LEAST, F.percentile_approx(good, [k / 200 for k in range(1, 200)], 1000)).alias("values")
    sizes = parsed.groupBy("history").agg(F.count("*").alias("n"), F.percentile_approx("t", [k / 500 for k in range(1, 500)], 2000).alias("cuts"), F.min("id").alias("first"), F.max("id").alias("last"), usual)
    # the median of the ordinary values, so that a long segment that is off doesn't move the level by which it's judged
    sizes = sizes.withColumn("level", F.element_at("values", 100))
    for _ in range(ROUNDS):
        sizes = sizes.withColumn("ordinary", F.filter("values", lambda v: F.abs(F.log(v / F.col("level"))) <= NEAR)).withColumn("level", F.element_at("ordinary", F.ceil((F.size("ordinary") + 1) / 2).cast("int")))
    per = lambda rows: F.greatest(F.lit(1), F.floor(F.lit(500) * rows / F.col("n"))).cast("int")
    long_ = F.col("n") > PIECE
    middle = sizes.agg(F.percentile_approx("level", 0.5, 1000)).first()[0]
    cuts = sizes.select(F.col("history").alias("h"), F.when(long_, F.col("cuts")).alias("cuts"), per(PIECE).alias("step"), F.least(per(PIECE), per(HALO) + 1).alias("halo"), "level", F.col("n").alias("whole"), "first", "last")
    # rows of one time are spread over the cuts that fall on it, in order of id
    ties = F.size(F.filter("cuts", lambda c: c == F.col("t")))
    at = F.size(F.filter("cuts", lambda c: c < F.col("t"))) + F.floor((ties + 0.999) * (F.col("id") - F.col("first")) / (F.col("last") - F.col("first") + 1)).cast("int")
    of = lambda bin_: F.floor(bin_ / F.col("step")).cast("int")
    near = F.array_distinct(F.array(of(F.greatest(F.col("at") - F.col("halo"), F.lit(0))), of(F.col("at")), of(F.least(F.col("at") + F.col("halo"), F.size("cuts")))))
    pieces = F.when(F.col("cuts").isNull(), F.array(F.lit(0))).otherwise(near)
    by = ["history", "piece"]
    placed = parsed.join(cuts, F.col("history") == F.col("h")).withColumn("at", at).withColumn("pieces", pieces)
    placed = placed.withColumn("own", F.when(F.col("cuts").isNull(), F.lit(0)).otherwise(of(F.col("at")))).withColumn("piece", F.explode("pieces")).withColumn("own", F.col("own") == F.col("piece"))
    placed = placed.drop("h", "cuts", "step", "halo", "at", "pieces", "first", "last").repartition(*by).sortWithinPartitions(*by, "t", "id")

    def settle(group: pd.DataFrame) -> pd.DataFrame:
        value, factor, told, own = (group[c].to_numpy() for c in ("value", "factor", "told", "own"))
        have = np.isfinite(value) & (value > 0)
        by_note = np.where(np.isfinite(factor), factor, 1.0)
        found, sure = np.ones(len(value)), np.zeros(len(value), dtype=bool)
        level = group["level"].iloc[0]  # of the whole history; null for a short one
        if have.any() and level == level and level is not None:
            found[have], sure[have] = hidden_factor(value[have], float(level), middle, group["said"].to_numpy()[have], int(group["whole"].iloc[0]))
        raw_ok = (value >= PLAUSIBLE[0]) & (value < PLAUSIBLE[1])
        # an unstated factor is reversed where a whole segment tells it, or the value as it stands can't be pay
        use = np.where(np.isfinite(factor), by_note, np.where(raw_ok & ~sure, 1.0, found))
        usd = np.where(have, value * use, np.nan)
        ok = (usd >= PLAUSIBLE[0]) & (usd < PLAUSIBLE[1])
        how = np.where(ok, np.where(use == 1.0, "fields", np.where(use == found, "segment", "scaled")), "text")
        return pd.DataFrame({"id": group["id"], "usd_year": np.where(ok, usd, told), "how": how})[own.astype(bool)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for b in batches:
            b = b if held is None else pd.concat([held, b], ignore_index=True)
            key = b["history"].to_numpy().astype(object) + "\0" + b["piece"].to_numpy().astype(str).astype(object)
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(b) else np.zeros(0, dtype=int)
            done = [settle(b.iloc[a:c]) for a, c in zip(starts[:-1], starts[1:])]
            held = b.iloc[starts[-1] :] if len(starts) else b  # the last group may go on in the next batch
            if done:
                yield pd.concat(done, ignore_index=True)
        if held is not None and len(held):
            yield settle(held)

    return placed.transform(shipped).mapInPandas(run, "id long, usd_year double, how string").where("usd_year is not null and not isnan(usd_year)")


def banded(amounts: DataFrame, bands: DataFrame, value: str) -> DataFrame:
    """`amounts` with the band whose [usd_from, usd_to) holds the value; without one, no row. Bands are small by definition and checked."""
    rows = _small(bands.selectExpr("cast(band_id as bigint)", "usd_from", "usd_to").where("band_id is not null and usd_from is not null and usd_to is not null"), "bands")
    band = F.coalesce(*[F.when((F.col(value) >= lo) & (F.col(value) < hi), F.lit(k)) for k, lo, hi in rows], F.lit(None)).cast("long")
    return amounts.withColumn("band_id", band).where("band_id is not null")


def usd_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_common_unit(table(spark, sf_dir, "jobs"), table(spark, sf_dir, "fx_rates"))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    # sums of a few cents off a border by the order of multiplication are put right by rounding
    amounts = usd_year(spark, sf_dir).withColumn("usd_year", F.round("usd_year", 6))
    return banded(amounts, table(spark, sf_dir, "pay_bands"), "usd_year").select("id", "band_id").distinct()


QUERIES = {"p7_found": found, "p7_usd_year": usd_year}
SQL: dict[str, str] = {}
