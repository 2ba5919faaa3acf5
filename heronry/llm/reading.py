"""Problem 10: the reading level of each English text, by regularised ordinal regression calibrated to graded texts.

Features: lexical diversity, word rarity in the whole corpus, connectives, a proxy of clause depth (subordinating words and inner
marks), and word lengths. Lengths of sentences are left out: lists have no full stops, and short or joined sentences mislead. The
regression is a proportional-odds model with a ridge penalty on the graded sample; grades that it finds most unlikely are set aside and it is fitted again.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronry.session import cut, shipped, spread, table

#: Graded texts that the model is fitted on, at most: those of the lowest hash of id.
MOST_LABELS = 5000
#: Grades of a lower probability are taken for errors of the grader.
DOUBTFUL = 0.1
#: A word of a share of texts below this is rare. Words above it are at most (mean different words a text) / COMMON, so their list is bounded.
COMMON = 0.002
#: Frequent words of the languages to tell apart, and connectives.
FREQUENT = {
    "en": "the and of to in a is that for it with as on are be this by have or from at we you our your not will can they which has was were an but",
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie wir unsere ihre ihr",
    "fr": "le la les de des et en un une du est que pour qui dans par plus pas au sur ne se ce il sont avec nous vous votre notre aux cette ou mais leur",
    "es": "el la los de y en que del las un por con no una su para es al lo como más o pero sus le ha este sí porque esta entre cuando muy sin sobre nuestro tu te",
}
CONNECTIVES = "although though whereas because since while whenever unless albeit notwithstanding consequently therefore thereby hence thus moreover furthermore nevertheless nonetheless however insofar hitherto accordingly provided whether whose whereby if once until so and but then"
_SUBORDINATE = frozenset("although though whereas because since while whenever unless albeit notwithstanding insofar whether whose whereby which that who whom if when where as than until".split())
_CONNECT = frozenset(CONNECTIVES.split())
_LANG = {w: [k for k, ws in FREQUENT.items() if w in ws.split()] for w in {w for ws in FREQUENT.values() for w in ws.split()}}
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_VOWELS = re.compile(r"[aeiouyäöüéèêàâîôûáíóúñ]+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


#: What a text alone tells; with the corpus, shares of rare words and mean rarity.
NAMES = ("word_chars", "syllables", "share_long", "share_very_long", "share_short", "sd_chars", "diversity", "hapax", "connectives", "subordinate", "marks")
#: Words over which diversity is measured, so that a text's length doesn't matter.
SPAN = 50
#: Words that a Python worker remembers; beyond it the memory starts anew.
REMEMBERED = 500_000
_LANGUAGES = tuple(FREQUENT)


class Lexicon(dict):
    """Words to numbers from 0 on, with what features need of each word; a worker's words are looked at once."""

    def __init__(self):
        self.facts: list[tuple] = []
        self.hashes: list[int] = []
        self._table: np.ndarray | None = None

    def __missing__(self, w: str) -> int:
        n = self[w] = len(self.facts)
        langs = _LANG.get(w, ())
        self.facts.append((len(w), len(_VOWELS.findall(w)) or 1, w in _CONNECT, w in _SUBORDINATE, *(1 / len(langs) if k in langs else 0.0 for k in _LANGUAGES)))
        self.hashes.append(int.from_bytes(hashlib.blake2b(w.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True))
        return n

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """(facts, hashes) by number."""
        if self._table is None or len(self._table[0]) < len(self.facts):
            self._table = (np.array(self.facts, dtype=float).reshape(len(self.facts), 4 + len(_LANGUAGES)), np.array(self.hashes, dtype=np.int64))
        return self._table


def measure(texts: list[str], lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """(positions, x, words, counts) of the English texts: the features NAMES, all shares or means, so that a text's length doesn't matter; numbers of its different words, and how often it has each."""
    said = [words(t) for t in texts]
    ids = [np.fromiter(map(lexicon.__getitem__, ws), dtype=np.int64, count=len(ws)) for ws in said]
    facts, hashes = lexicon.table()
    n = np.array([len(i) for i in ids], dtype=np.int64)
    flat, of = np.concatenate([*ids, np.zeros(0, np.int64)]), np.repeat(np.arange(len(texts)), n)
    votes = np.stack([np.bincount(of, facts[flat, 4 + k], len(texts)) for k in range(len(_LANGUAGES))], axis=1) if len(facts) else np.zeros((len(texts), len(_LANGUAGES)))
    en = _LANGUAGES.index("en")
    keep = np.flatnonzero((votes[:, en] > 0) & (votes[:, en] >= votes.max(axis=1, initial=0.0)))
    if not len(keep):
        return keep, np.zeros((0, len(NAMES))), [], []
    kept = np.isin(of, keep)
    flat, of, n = flat[kept], np.searchsorted(keep, of[kept]), n[keep]
    f, d = facts[flat], len(keep)
    mean = lambda v: np.bincount(of, v, d) / n
    chars = f[:, 0]
    average = mean(chars)
    sd = np.sqrt(mean((chars - average[of]) ** 2))
    # different words of each full span, or of the whole text where it has none
    start = np.cumsum(n) - n
    at = np.arange(len(flat)) - start[of]
    full = (at // SPAN < n[of] // SPAN) | (n[of] < SPAN)
    spans = (np.cumsum(np.maximum(1, n // SPAN)) - np.maximum(1, n // SPAN))[of] + at // SPAN
    seen = np.unique(spans[full] * len(facts) + flat[full]) // len(facts)
    span_of, span_words = np.repeat(np.arange(d), np.maximum(1, n // SPAN)), np.bincount(spans[full])
    diversity = np.bincount(span_of, np.bincount(seen) / span_words, d) / np.maximum(1, n // SPAN)
    pair, count = np.unique(of * len(facts) + flat, return_counts=True)
    mine = pair // len(facts)
    hapax = np.bincount(mine, count == 1, d) / n
    marks = np.array([texts[k].count(",") + texts[k].count(";") + texts[k].count(":") for k in keep]) / n
    x = np.stack([average, mean(f[:, 1]), mean(chars >= 8), mean(chars >= 12), mean(chars <= 4), sd, diversity, hapax, mean(f[:, 2]), mean(f[:, 3]), marks], axis=1)
    cuts = np.searchsorted(mine, np.arange(1, d))
    return keep, x, np.split(hashes[pair % len(facts)], cuts), np.split(count.astype(np.int32), cuts)


def with_rarity(x: list, seen: list, counts: list, idf: tuple[np.ndarray, np.ndarray], top: float) -> np.ndarray:
    """Features of texts, with the share of rare words and the mean rarity; idf: numbers of the words that aren't rare, sorted, and their inverse document frequency."""
    sizes = np.array([len(w) for w in seen])
    flat, count, of = np.concatenate(seen).astype(np.int64), np.concatenate(counts).astype(float), np.repeat(np.arange(len(x)), sizes)
    at = np.minimum(np.searchsorted(idf[0], flat), max(0, len(idf[0]) - 1))
    known = idf[0][at] == flat if len(idf[0]) else np.zeros(len(flat), dtype=bool)
    n = np.bincount(of, count, len(x))
    rare = np.bincount(of, count * ~known, len(x)) / n
    rarity = np.bincount(of, count * np.where(known, idf[1][at] if len(idf[0]) else 0.0, top), len(x)) / n
    return np.c_[np.array([np.asarray(v, dtype=float) for v in x]), rare, rarity]


def fit(x: np.ndarray, y: np.ndarray, levels: int = 4, ridge: float = 1.0, rounds: int = 60) -> dict:
    """Proportional odds: P(level <= k) = s(cut_k - w.x), by BFGS; levels that nobody gave still have a place between their neighbours."""
    mean, sd = x.mean(axis=0), x.std(axis=0)
    sd[sd < 1e-9] = 1.0
    z = np.clip((x - mean) / sd, -6, 6)
    n, d = z.shape
    share = np.array([(np.sum(y <= k) + 0.5 * k) / (n + 0.5 * levels) for k in range(1, levels)])
    cuts = np.log(share / (1 - share))
    t = np.r_[np.zeros(d), cuts[0], np.log(np.maximum(np.diff(cuts), 1e-2))]

    def parts(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c = t[d] + np.r_[0.0, np.cumsum(np.exp(np.clip(t[d + 1 :], -20, 20)))]
        return t[:d], c

    def loss(t: np.ndarray) -> tuple[float, np.ndarray]:
        w, c = parts(t)
        s = z @ w
        edge = np.r_[-np.inf, c, np.inf]
        hi, lo = edge[y] - s, edge[y - 1] - s
        ph, pl = 1 / (1 + np.exp(-np.clip(hi, -500, 500))), 1 / (1 + np.exp(-np.clip(lo, -500, 500)))
        p = np.maximum(ph - pl, 1e-12)
        dh, dl = ph * (1 - ph) / p, pl * (1 - pl) / p
        g = np.zeros_like(t)
        g[:d] = z.T @ (dh - dl) + ridge * w
        gc = np.array([-(dh[y == k].sum()) + dl[y == k + 1].sum() for k in range(1, levels)])
        g[d] = gc.sum()
        for j in range(levels - 2):
            g[d + 1 + j] = gc[j + 1 :].sum() * np.exp(np.clip(t[d + 1 + j], -20, 20))
        return float(-np.log(p).sum() + ridge / 2 * w @ w), g

    value, grad = loss(t)
    h = np.eye(len(t)) / max(1.0, n / 4)  # inverse Hessian, by BFGS
    for _ in range(rounds * 4):
        step = -h @ grad
        if grad @ step >= 0:
            h, step = np.eye(len(t)) / max(1.0, n / 4), -grad / max(1.0, n / 4)
        size = 1.0
        while size > 1e-8:
            new, g2 = loss(t + size * step)
            if new <= value + 1e-4 * size * (grad @ step):
                break
            size /= 2
        else:
            break
        s_, y_ = size * step, g2 - grad
        done = value - new < 1e-9 * max(1.0, abs(value))
        t, value, grad = t + s_, new, g2
        if done:
            break
        sy = s_ @ y_
        if sy > 1e-12:
            r = np.eye(len(t)) - np.outer(s_, y_) / sy
            h = r @ h @ r.T + np.outer(s_, s_) / sy
    w, c = parts(t)
    return {"mean": mean, "sd": sd, "w": w, "cuts": c}


def odds(m: dict, x: np.ndarray) -> np.ndarray:
    """Probability of each level for each row."""
    s = np.clip((x - m["mean"]) / m["sd"], -6, 6) @ m["w"]
    cum = 1 / (1 + np.exp(-np.clip(m["cuts"][None, :] - s[:, None], -500, 500)))
    return np.diff(np.c_[np.zeros(len(x)), cum, np.ones(len(x))], axis=1)


def predict(m: dict, x: np.ndarray) -> np.ndarray:
    """The likeliest level of each row, from 1 up."""
    return np.argmax(odds(m, x), axis=1) + 1


def calibrated(x: np.ndarray, y: np.ndarray, levels: int = 4) -> dict:
    """The model fitted three times, the last two without the grades that the one before gives less than DOUBTFUL."""
    m, keep = fit(x, y, levels), np.ones(len(y), dtype=bool)
    for _ in range(2):
        sure = odds(m, x)[np.arange(len(y)), y - 1] >= DOUBTFUL
        if sure.sum() < max(10, len(y) / 2) or (sure == keep).all():
            break
        keep = sure
        m = fit(x[keep], y[keep], levels)
    return m


def read_texts(rows: DataFrame) -> DataFrame:
    """(doc_id, x, words, counts) of each English text: the corpus is read once, and later steps go on from these numbers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = Lexicon()
        for b in batches:
            for lo in range(0, len(b), 500):
                part = b.iloc[lo : lo + 500]
                if len(lexicon) > REMEMBERED:
                    lexicon = Lexicon()
                keep, x, seen, counts = measure(part["text"].tolist(), lexicon)
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy()[keep], "x": list(x), "words": seen, "counts": counts})

    return rows.transform(shipped).mapInPandas(run, "doc_id long, x array<double>, words array<long>, counts array<int>")


def common_words(read_: DataFrame) -> tuple[tuple[np.ndarray, np.ndarray], float]:
    """((numbers of words, sorted; inverse document frequency), that of rarer ones): the words that at least COMMON of the English texts have, at most (mean different words a text) / COMMON."""
    n = read_.count()
    least = max(2.0, COMMON * n)
    rows = read_.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("df")).where(F.col("df") >= least).collect() if n else []
    rows = sorted((r.word, math.log(n / r.df)) for r in rows)
    return (np.array([w for w, _ in rows], dtype=np.int64), np.array([v for _, v in rows])), math.log(n / least) + 1.0 if n else 0.0


def levels(docs: DataFrame, labels: DataFrame, count: int = 4) -> DataFrame:
    """(doc_id, level): reading level 1..count of each text that is in English by its words, whatever a language field says.

    Null and blank texts, texts without a word and texts in other languages give no row. Texts are read whole. The model is fitted on at
    most MOST_LABELS grades (a documented bound; several grades of a text count each), word counts are of all texts. Grades that are null, out of range or of
    unknown texts don't count; without any grade no row comes out. Repeated rows give repeated rows, of which one is graded; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).where("text is not null and trim(text) <> ''")
    read_ = cut(read_texts(spread(rows, "doc_id")))
    shared = spark.sparkContext.broadcast(common_words(read_))
    graded = labels.select(labels["doc_id"].cast("long").alias("l_id"), labels["level_id"].cast("int").alias("level")).where(f"l_id is not null and level between 1 and {int(count)}")
    graded = graded.orderBy(F.xxhash64("l_id", "level"), "l_id", "level").limit(MOST_LABELS).groupBy("l_id", "level").agg(F.count("*").alias("times"))
    sample = read_.join(F.broadcast(graded), F.col("doc_id") == F.col("l_id"))  # at most MOST_LABELS rows of numbers
    got = sample.groupBy("doc_id", "level", "times").agg(F.min(F.struct("x", "words", "counts")).alias("m")).orderBy("level", "doc_id").select("level", "times", "m.*").collect()
    if not got:
        return spark.createDataFrame([], "doc_id long, level long")
    x = with_rarity([r.x for r in got], [r.words for r in got], [r.counts for r in got], *shared.value)
    times = [r.times for r in got]
    model = spark.sparkContext.broadcast(calibrated(np.repeat(x, times, axis=0), np.repeat([r.level for r in got], times), count))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        idf, top = shared.value
        for b in batches:
            xs = with_rarity(b["x"].tolist(), b["words"].tolist(), b["counts"].tolist(), idf, top) if len(b) else None
            yield pd.DataFrame({"doc_id": b["doc_id"], "level": predict(model.value, xs) if len(b) else []})

    return read_.transform(shipped).mapInPandas(judge, "doc_id long, level long")


def graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_labels"))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graded(spark, sf_dir).where("level in (1, 4) and doc_id is not null").select("doc_id", F.col("level").alias("level_id")).distinct()


def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_type, level_id, docs): how demanding the texts of each kind are."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "doc_type")
    return graded(spark, sf_dir).join(docs, "doc_id").groupBy("doc_type", F.col("level").alias("level_id")).agg(F.count("*").alias("docs"))


QUERIES = {"p10_found": found, "p10_profile": profile}
SQL: dict[str, str] = {}
