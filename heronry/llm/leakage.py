"""Problem 9: evaluation passages in training text, by Wu-Manber search over words.

The alphabet is the items' own vocabulary (every other word is symbol 0). Patterns of one length are
searched together: SHIFT tells for each block of words how far the window may move without missing
a match, blocks of shift 0 select a bucket of patterns by their last words, and a direct comparison confirms.
Thousands of cursors move over one flat array of symbols at once, each over its own stretch.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from heronry.session import shipped, spread, table

#: Words in a row that make a leak; items with fewer words must occur as a whole.
SPAN = 12
#: Words of items that one scan searches for; more items make more scans, none is left out.
BLOCK_WORDS = 250_000
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """Runs of letters and digits, case ignored."""
    return _WORD.findall(text.lower()) if text else []


class Searcher:
    """Tables for one block of items; `find` gives (text number, item number) pairs."""

    def __init__(self, items: list[tuple[int, list[str]]], span: int = SPAN):
        self.vocab = {w: k + 1 for k, w in enumerate(dict.fromkeys(w for _, ws in items for w in ws))}
        by_len: dict[int, list[tuple[np.ndarray, int]]] = defaultdict(list)
        for item, ws in items:
            seq = np.array([self.vocab[w] for w in ws], dtype=np.int64)
            n = min(span, len(seq))
            if n:
                by_len[n].append((np.lib.stride_tricks.sliding_window_view(seq, n), item))
        self.sizes = [self._tables(n, pats) for n, pats in sorted(by_len.items())]
        self.most = max(by_len, default=0)

    def _tables(self, n: int, pats: list[tuple[np.ndarray, int]]) -> dict:
        b = min(2 if n < 6 else 3, n)
        base = len(self.vocab) + 1
        pat, item = np.concatenate([p for p, _ in pats]), np.repeat(np.array([i for _, i in pats], dtype=np.int64), [len(p) for p, _ in pats])
        keys, shifts = [], []
        for end in range(b - 1, n):  # a block ending at `end` lets the window move on by n - 1 - end
            k = np.zeros(len(pat), dtype=np.int64)
            for j in range(b):
                k = k * base + pat[:, end - b + 1 + j]
            keys.append(k)
            shifts.append(np.full(len(pat), n - 1 - end))
        key, shift = np.concatenate(keys), np.concatenate(shifts)
        order = np.lexsort((shift, key))
        key, shift = key[order], shift[order]
        first = np.r_[True, key[1:] != key[:-1]]
        suffix = np.argsort(keys[-1], kind="stable")
        return {"n": n, "b": b, "base": base, "key": key[first], "shift": shift[first], "far": n - b + 1, "suffix": keys[-1][suffix], "pat": pat[suffix], "item": item[suffix]}

    def find(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        gap, get = max(self.most, 1), self.vocab.get
        flat: list[int] = [0] * gap
        starts = []
        for ws in texts:
            starts.append(len(flat))
            flat += [get(w, 0) for w in ws]
            flat += [0] * gap  # unknown words stand between texts, so no match spans two
        sym, start = np.array(flat, dtype=np.int64), np.array(starts, dtype=np.int64)
        docs, found = [], []
        for t in self.sizes:
            end, pat = self._scan(sym, t)
            docs.append(np.searchsorted(start, end, side="right") - 1)
            found.append(t["item"][pat])
        if not docs:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        both = np.unique(np.stack([np.concatenate(docs), np.concatenate(found)]), axis=1)
        return both[0], both[1]

    @staticmethod
    def _scan(sym: np.ndarray, t: dict) -> tuple[np.ndarray, np.ndarray]:
        """Last positions of matches and the pattern of each."""
        n, b, last = t["n"], t["b"], len(sym)
        lo = np.arange(n - 1, last, max(64, last // 8192))
        hi, at = np.r_[lo[1:], last], lo.copy()
        hits = []
        while len(at):
            key = np.zeros(len(at), dtype=np.int64)
            for j in range(b):
                key = key * t["base"] + sym[at - b + 1 + j]
            spot = np.minimum(np.searchsorted(t["key"], key), len(t["key"]) - 1)
            move = np.where(t["key"][spot] == key, t["shift"][spot], t["far"])
            zero = move == 0
            if zero.any():
                hits.append(np.stack([at[zero], key[zero]]))
            at = at + np.maximum(move, 1)
            live = at < hi
            at, hi = at[live], hi[live]
        if not hits:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        end, key = np.concatenate(hits, axis=1)
        first, past = np.searchsorted(t["suffix"], key), np.searchsorted(t["suffix"], key, side="right")
        ends, pats = [], []
        for k in range(int((past - first).max(initial=0))):  # k-th pattern of each bucket
            more = first + k < past
            e, p = end[more], first[more] + k
            same = (sym[e[:, None] + np.arange(1 - n, 1)] == t["pat"][p]).all(axis=1)
            ends.append(e[same])
            pats.append(p[same])
        return np.concatenate(ends), np.concatenate(pats)


def _blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, list[str]]]]:
    block, size = [], 0
    for r in items.select(items[id_col].cast("long").alias("i"), items[text_col].alias("t")).where("i is not null and t is not null").toLocalIterator():
        ws = words(r.t)
        if not ws:
            continue
        block.append((r.i, ws))
        size += len(ws)
        if size >= BLOCK_WORDS:
            yield block
            block, size = [], 0
    if block:
        yield block


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", span: int = SPAN) -> DataFrame:
    """(doc_id, item_id), distinct: the document holds `span` successive words of the item, or all words of a shorter one.

    Null, empty and wordless texts on either side hold and are nothing; rows of null id don't count. Repeated
    rows give one pair. Other columns are ignored. Items are the stated query set: they come to the driver in
    blocks of BLOCK_WORDS words, and each block scans all documents; nothing is shuffled but the found pairs.
    """
    spark = docs.sparkSession
    rows = spread(docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[doc_text].alias("text")).where("doc_id is not null and text is not null"), "doc_id")
    out = None
    for block in _blocks(items, item_id, item_text):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            search = Searcher(shared.value, span)
            for b in batches:
                for lo in range(0, len(b), 256):
                    part = b.iloc[lo : lo + 256]
                    doc, item = search.find([words(t) for t in part["text"]])
                    if len(doc):
                        yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy()[doc], "item_id": item})

        found = rows.transform(shipped).mapInPandas(run, "doc_id long, item_id long")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "doc_id long, item_id long")
    return out.distinct()


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def leaked_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, docs): in how many documents each leaked item occurs."""
    from pyspark.sql import functions as F

    return found(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("docs"))


_FOUND = r"""
WITH d AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), ' ') || ' ' AS t FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL),
s AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 0) + 2)) AS k FROM i WHERE len(w) > 0),
p AS (SELECT DISTINCT item_id, ' ' || array_to_string(w[k:least(k + 11, len(w))], ' ') || ' ' AS p FROM s)
SELECT DISTINCT doc_id, item_id FROM d JOIN p ON contains(d.t, p.p)"""

QUERIES = {"p9_found": found, "p9_leaked_items": leaked_items}
SQL = {"p9_found": _FOUND, "p9_leaked_items": f"SELECT item_id, count(*) AS docs FROM ({_FOUND}) GROUP BY item_id"}
