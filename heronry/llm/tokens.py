"""Problem 8: encode a whole corpus with a public byte-level BPE vocabulary.

Words of many texts are merged together: all symbols of the words not seen before lie in one flat
array, every round looks each adjacent pair up by binary search in the sorted pair keys, finds the
lowest rank of each word, and merges all its non-overlapping occurrences at once.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from heronry.session import shipped, spread, table

VOCAB = "/opt/tokenizers/byte_bpe_50k.json"
#: Fixed value: the published splitting pattern of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words remembered by a Python worker; beyond it the memory starts anew, results don't change.
REMEMBERED = 200_000
_NONE = np.iinfo(np.int64).max


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file (published GPT-2 rule)."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, n = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + n)
            n += 1
    return [out[b] for b in range(256)]


def load(path: str = VOCAB) -> dict[str, np.ndarray]:
    """Byte ids, and the merges as sorted keys (left << 32 | right) with their ranks and results."""
    model = json.load(open(path, encoding="utf-8"))["model"]
    vocab = model["vocab"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
    right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
    made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
    key = left << 32 | right
    order = np.argsort(key, kind="stable")
    return {
        "bytes": np.array([vocab[c] for c in byte_symbols()], dtype=np.int64),
        "key": key[order],
        "rank": order.astype(np.int64),
        "made": made[order],
    }


def merge(words: list[bytes], v: dict[str, np.ndarray]) -> list[list[int]]:
    """The ids of each word."""
    if not words:
        return []
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    sym = v["bytes"][np.frombuffer(b"".join(words), dtype=np.uint8)]
    word = np.repeat(np.arange(len(words)), lengths)
    done_sym: list[np.ndarray] = []
    done_word: list[np.ndarray] = []
    while len(sym):
        same = np.zeros(len(sym), dtype=bool)
        same[:-1] = word[:-1] == word[1:]
        rank, made = np.full(len(sym), _NONE), np.zeros(len(sym), dtype=np.int64)
        at = np.flatnonzero(same)
        key = sym[at] << 32 | sym[at + 1]
        spot = np.minimum(np.searchsorted(v["key"], key), len(v["key"]) - 1)
        hit = v["key"][spot] == key
        rank[at[hit]], made[at[hit]] = v["rank"][spot[hit]], v["made"][spot[hit]]
        starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        low = np.minimum.reduceat(rank, starts)
        per = np.repeat(low, np.diff(np.r_[starts, len(sym)]))
        live = per != _NONE
        if not live.all():  # words without a pair left are complete
            done_sym.append(sym[~live])
            done_word.append(word[~live])
            sym, word, rank, made, per = sym[live], word[live], rank[live], made[live], per[live]
            if not len(sym):
                break
        chosen = rank == per
        # equal neighbours overlap (a a a): of each run of chosen positions every second one is merged
        idx = np.flatnonzero(chosen)
        first = np.r_[True, np.diff(idx) != 1]
        run_start = np.maximum.accumulate(np.where(first, np.arange(len(idx)), 0))
        idx = idx[(np.arange(len(idx)) - run_start) % 2 == 0]
        sym[idx] = made[idx]
        keep = np.ones(len(sym), dtype=bool)
        keep[idx + 1] = False
        sym, word = sym[keep], word[keep]
    if not done_sym:
        return [[] for _ in words]
    sym, word = np.concatenate(done_sym), np.concatenate(done_word)
    order = np.argsort(word, kind="stable")
    bounds = np.searchsorted(word[order], np.arange(len(words) + 1))
    flat = sym[order]
    return [flat[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]


class Encoder:
    def __init__(self, vocab: dict[str, np.ndarray], pattern: str = PATTERN):
        import regex

        self.v, self.split, self.known = vocab, regex.compile(pattern), {}

    def batch(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text; of an empty and of a null text the empty list."""
        parts = [self.split.findall(t) if t else [] for t in texts]
        new = {w for p in parts for w in p if w not in self.known}
        if len(self.known) + len(new) > REMEMBERED:
            self.known, new = {}, {w for p in parts for w in p}
        fresh = list(new)
        # a lone surrogate can't be in Arrow strings; replacing keeps direct calls from failing
        self.known.update(zip(fresh, merge([w.encode("utf-8", "replace") for w in fresh], self.v)))
        known = self.known
        return [[i for w in p for i in known[w]] for p in parts]


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str = VOCAB) -> DataFrame:
    """(id, ids): the token ids of each row's text, without special tokens.

    Null and empty texts have the empty list; blank text is encoded like any other. One row comes out for each
    row that goes in, repeated rows too; a null id stays null. Other columns are ignored. Texts are split and merged
    whole, of any length. The vocabulary (a fixed 50,000 merges, about 1.2 MB) is read on the driver and broadcast.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(load(vocab))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = Encoder(shared.value)
        for b in batches:
            for lo in range(0, len(b), 512):
                part = b.iloc[lo : lo + 512]
                texts = [t if isinstance(t, str) else None for t in part["text"]]
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "ids": pd.Series(enc.batch(texts), dtype=object)})

    rows = spread(df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text")), "doc_id")
    return rows.transform(shipped).mapInPandas(run, "doc_id long, ids array<int>")


def ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))


QUERIES = {"p8_ids": ids}
SQL: dict[str, str] = {}
