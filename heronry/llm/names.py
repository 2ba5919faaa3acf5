"""Problem 6: bring together the spellings of one name.

Names are read into core words, kind of business and legal form. Full names (two core words or more and a kind) are blocked by phonetic codes
of their sorted words and compared with Jaro-Winkler inside each block; accepted pairs are clustered by connected components.
Shortened names (no kind, an initial, a dropped word, both words run together or blended) join the one cluster they fit.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, permutations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronry.llm._company import EDITS, SAME, consonants, edits, head, jaro_winkler, read, sound
from heronry.session import cut, shipped, table

#: Forms of a block compared in one piece; larger blocks are cut, and every piece meets every other.
PIECE = 256
#: How well both words' first syllables in one word fit; less than the name itself, more than any misspelling of it or of one of its words.
BLEND = 0.95
#: Groups of fewer forms are compared outright.
FEW = 12


def _read_all(names: DataFrame) -> DataFrame:
    """(company, node, core, kind) of each distinct spelling that names a company."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for name in b["company"]:
                r = read(name)
                if r:
                    core, kind = " ".join(r[0]), r[1]
                    out.append((name, f"{core}|{kind}", core, kind))
            yield pd.DataFrame(out, columns=["company", "node", "core", "kind"])

    return names.transform(shipped).mapInPandas(run, "company string, node string, core string, kind string")


@lru_cache(maxsize=200_000)
def less(code: str, most: int) -> tuple[str, ...]:
    """A code with up to `most` of its signs left out: two codes within so many edits have one in common."""
    out = {code}
    for _ in range(most):
        out |= {c[:i] + c[i + 1 :] for c in out for i in range(len(c))}
    return tuple(sorted(out))


def block_keys(core: list[str], kind: str) -> set[str]:
    """Keys of which two names of one kind within EDITS edits have one in common, whatever the edits, and others rarely, however many names there are.

    One word may be off by two edits: its consonants' phonetic code less two signs, with the other words as they are. Or two words by one each: both words' codes with their vowels less one sign, with
    the third word's. An edit of a word is one of its code at most, as codes have a sign for each letter and join none. In names of four words or more the words but two are as they are.
    """
    if len(core) > 3:
        return {f"w:{kind} {len(core)} {' '.join(rest)}" for rest in combinations(core, len(core) - EDITS)}
    codes, keys = [consonants(w) for w in core], set()
    for k in range(len(core)):
        rest = " ".join(core[:k] + core[k + 1 :])
        keys |= {f"o:{kind} {len(core)} {rest} {c}" for c in less(codes[k], EDITS)}
    full = [consonants(w, vowels=True) for w in core]
    for j, k in combinations(range(len(core)), 2):
        rest = " ".join(full[i] for i in range(len(core)) if i not in (j, k))
        keys |= {f"t:{kind} {rest} {a} {b}" if a < b else f"t:{kind} {rest} {b} {a}" for a in less(full[j], 1) for b in less(full[k], 1)}
    return keys


def likeness(a: str, b: str) -> float:
    """Jaro-Winkler likeness of two words; 0 under SAME, and for words of more than EDITS edits."""
    if a == b:
        return 1.0
    near = jaro_winkler(a, b)
    return near if near >= SAME and edits(a, b) <= EDITS else 0.0


def paired(a: list[str], b: list[str], like=likeness) -> float:
    """Mean likeness of two names' words under the pairing that is best, 0 where none has words that are all alike and EDITS edits in all at most."""
    best = 0.0
    for p in permutations(b):
        each = [like(x, y) for x, y in zip(a, p)]
        if min(each, default=1.0) > 0 and sum(edits(x, y) for x, y in zip(a, p) if len(x) > 1) <= EDITS:
            best = max(best, sum(each) / len(each) if each else 1.0)
    return best


def letters(text: str) -> np.ndarray:
    """How often a text has each letter, letters folded into 32 bins."""
    return np.bincount([ord(ch) & 31 for ch in text], minlength=32).astype(np.int16)


def alike(a: list[str], b: list[str]) -> float:
    """Likeness of two names: the mean Jaro-Winkler likeness of their words under the best pairing; 0 from more than EDITS edits in all words together on.

    Names of other companies can be near in every word, so the edits are counted together; words that merely sound alike don't count.
    """
    if len(a) != len(b):
        return 0.0
    same = 0
    if len(b) > 4:  # equal words pair up, each of the others takes an edit at least
        both = Counter(a) & Counter(b)
        a, b = (sorted((Counter(x) - both).elements()) for x in (a, b))
        same = sum(both.values())
        if len(b) > EDITS:
            return 0.0
    got = paired(a, b)
    return (got * len(a) + same) / (len(a) + same) if got else 0.0


@lru_cache(maxsize=500_000)
def _alike(a: str, b: str) -> float:
    """`alike` of two names as written: most pairs share several keys."""
    return alike(a.split(" "), b.split(" "))


def short_keys(core: list[str], kind: str) -> set[str]:
    """What a shortened name looks up."""
    if len(core) == 1:
        w = core[0]
        keys = {"j:" + sound(w)}
        stem = w.rstrip("aeiouy")
        if stem != w:
            keys.add("b:" + stem)
        if kind:
            keys.add(f"d:{sound(w)} {kind}")
        return keys
    long = [w for w in core if len(w) > 1]
    first = sorted(w for w in core if len(w) == 1)
    if not first:  # all words, but no kind of business
        return block_keys(core, "")
    return {f"i:{sound(w)} {' '.join(first)}" for w in long}


def full_keys(core: list[str], kind: str) -> set[str]:
    """Where a full name can be looked up by its shortened forms."""
    keys = block_keys(core, "") if len(core) > 1 else set()
    if len(core) == 2:
        for a, b in (core, core[::-1]):
            keys |= {"j:" + sound(a + b), "b:" + head(a) + head(b), f"i:{sound(a)} {b[0]}"}
    if kind:
        keys |= {f"d:{sound(w)} {kind}" for w in core}
    return keys


def fits(short: list[str], skind: str, core: list[str], kind: str) -> float:
    """How well a shortened name fits a full one, 0 where it doesn't."""
    if skind and kind and skind != kind:
        return 0.0
    if len(short) == 1:
        w, best = short[0], 0.0
        if len(core) == 2:
            stem = w.rstrip("aeiouy")
            for a, b in (core, core[::-1]):
                best = max(best, BLEND * likeness(w, a + b) if w != a + b else 1.0)
                if stem != w and stem == head(a) + head(b):
                    best = max(best, BLEND)
        if skind and skind == kind:
            best = max(best, *(BLEND * likeness(w, c) if w != c else 1.0 for c in core))
        return best
    if len(short) != len(core) or len(core) > 4:
        return 1.0 if sorted(short) == sorted(core) else 0.0
    return paired(short, core, lambda x, y: float(x == y[0]) if len(x) == 1 else likeness(x, y))


def _keyed(forms: DataFrame, keys) -> DataFrame:
    """(key, node) for each key of each form, keys as numbers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in range(0, len(b), 2000):
                part = b.iloc[lo : lo + 2000]
                rows = [(k, n) for n, c, d in zip(part["node"], part["core"], part["kind"]) for k in keys(c.split(" "), d)]
                yield pd.DataFrame(rows, columns=["key", "node"])

    # few forms have many keys: a partition that is small for a shuffle isn't for them
    return _many(forms, "node").transform(shipped).mapInPandas(run, "key string, node string").select(F.xxhash64("key").alias("key"), "node")


def _many(rows: DataFrame, *by: str) -> DataFrame:
    """`rows` in as many partitions as keep the cores busy, which aren't put together again for being small."""
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism, *by)


def _read_node(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"core": F.substring_index("node", "|", 1), "kind": F.substring_index("node", "|", -1)})


def _pieces(rows: DataFrame, side: str, least: int = 1) -> DataFrame:
    """`piece` a row belongs to within its block: blocks up to PIECE rows have one. Blocks of under `least` rows are left out."""
    sizes = rows.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") >= least)
    n = F.ceil(F.col("size") / PIECE).cast("int")
    return rows.join(sizes, "key").withColumn("pieces", n).withColumn(side, F.pmod(F.xxhash64("node"), n).cast("int")).drop("size")


def _groups(batches: Iterator[pd.DataFrame], by: list[str]) -> Iterator[list[tuple]]:
    """Groups of rows that are sorted by `by`, over the borders of batches."""
    last, held = None, []
    for b in batches:
        heads = list(zip(*(b[c] for c in by)))
        for h, row in zip(heads, b.itertuples(index=False, name=None)):
            if h != last and held:
                yield held
                held = []
            last = h
            held.append(row)
    if held:
        yield held


def near(group: list[tuple], same_piece: bool) -> Iterator[tuple[int, int]]:
    """Positions of the rows (key, lo, hi, piece, node, core, kind) of a group whose names can be within EDITS, by numbers alone.

    An edit changes the counts of letters by two in all at most, and the length by one. Rows of one piece were compared in that piece's own task.
    """
    if len(group) < 2:
        return
    if len(group) < FEW:
        for (i, a), (j, b) in combinations(enumerate(group), 2):
            if a[6] == b[6] and abs(len(a[5]) - len(b[5])) <= EDITS and (same_piece or a[3] != b[3]):
                yield i, j
        return
    counts = np.stack([letters(r[5]) for r in group])
    sizes = np.array([len(r[5]) for r in group])
    kinds = np.unique([r[6] for r in group], return_inverse=True)[1]
    pieces = np.array([r[3] for r in group])
    for i in range(len(group) - 1):
        rest = slice(i + 1, None)
        ok = (np.abs(sizes[rest] - sizes[i]) <= EDITS) & (kinds[rest] == kinds[i])
        ok &= np.abs(counts[rest] - counts[i]).sum(axis=1) <= 2 * EDITS
        if not same_piece:
            ok &= pieces[rest] != pieces[i]
        for j in np.flatnonzero(ok):
            yield i, i + 1 + int(j)


def pairs(forms: DataFrame) -> DataFrame:
    """(a, b): full names of one company and kind, compared only where they share a block; only accepted pairs leave a task.

    A block larger than PIECE is cut into pieces, and each two pieces meet in a task of their own, so no task holds a large block.
    """
    rows = _read_node(_pieces(_keyed(forms, block_keys).repartition("key"), "piece", least=2))
    # a row of piece i goes to the tasks (i, j) and (j, i) of every j
    meet = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    meet = meet.select("key", F.least("piece", "other").alias("lo"), F.greatest("piece", "other").alias("hi"), "piece", "node", "core", "kind")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _groups(batches, ["key", "lo", "hi"]):
            if len(group) < 2:
                continue
            out = []
            for i, j in near(group, same_piece=group[0][1] == group[0][2]):
                n, m = group[i][4], group[j][4]
                if n != m and _alike(group[i][5], group[j][5]):
                    out.append((n, m) if n < m else (m, n))
            if out:
                yield pd.DataFrame(out, columns=["a", "b"])

    by = ["key", "lo", "hi"]
    return _many(meet, *by).sortWithinPartitions(*by).transform(shipped).mapInPandas(run, "a string, b string").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each node's component, by alternating large and small stars.

    Only minima are gathered at a node, combined before the shuffle, so a node of many links fills no task. Each round is
    written to the shared checkpoint folder. Nodes without links don't occur.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("s")).select("s.u", F.col("s.m").alias("v")).where("u <> v").distinct()
        e = cut(small)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def attach(short: DataFrame, forms: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, label) of each shortened name that fits exactly one cluster best."""
    left = _keyed(short, short_keys)
    right = _keyed(forms, full_keys).join(left.select("key").distinct(), "key", "left_semi")  # most keys of full names are looked up by none
    # both sides of a key meet in pieces of the full names: a shortened name goes to each of them
    right = _pieces(right, "piece")
    n = right.groupBy("key").agg(F.max("pieces").alias("pieces"))
    left = left.join(n, "key").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    cols = ["key", "piece", "node"]
    both = left.select(*cols, F.lit(0).alias("side")).unionByName(right.select(*cols, F.lit(1).alias("side")))
    # full names first; the shortened ones then pass by one at a time and aren't held
    both = both.repartition("key", "piece").sortWithinPartitions("key", "piece", F.desc("side"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, fulls, out = None, [], []
        for b in batches:
            for key, piece, node, side in b.itertuples(index=False, name=None):
                core, kind = node.rsplit("|", 1)
                if (key, piece) != at:
                    at, fulls = (key, piece), []
                if side:
                    fulls.append((node, core.split(" "), kind))
                    continue
                mine = core.split(" ")
                fit = [(fits(mine, kind, c, d), m) for m, c, d in fulls]
                best = max((s for s, _ in fit), default=0.0)
                out += [(node, m, s) for s, m in fit if s == best and s > 0]
            if out:
                yield pd.DataFrame(out, columns=["node", "full", "score"])
                out = []

    met = both.transform(shipped).mapInPandas(run, "node string, full string, score double")
    met = met.join(labels.select(F.col("node").alias("full"), "label"), "full", "left").withColumn("label", F.coalesce("label", "full"))
    per = met.groupBy("node", "label").agg(F.max(F.round("score", 6)).alias("s"))
    top = per.groupBy("node").agg(F.max("s").alias("top")).withColumnRenamed("node", "n")
    best = per.join(top, (F.col("node") == F.col("n")) & (F.col("s") == F.col("top")))
    return best.groupBy("node").agg(F.min("label").alias("label"), F.count("*").alias("c")).where("c = 1").select("node", "label")


def clusters(jobs: DataFrame, col: str = "company") -> DataFrame:
    """(company, cluster): each different spelling, exactly as stored, that names a company, and the smallest spelling of its cluster.

    Nulls, blanks and placeholders name no company and don't occur. Case, accents, order, legal form and filler words make no
    difference; misspelt words (two edits in all), initials, short forms of the kind of business, dropped and blended words are followed. A
    shortened name that fits several companies stays by itself. Spellings are made distinct first, so repeated rows cost nothing.
    """
    read_ = cut(_read_all(jobs.select(F.col(col).alias("company")).where("company is not null").distinct()))
    nodes = read_.select("node", "core", "kind").distinct()
    whole = (F.size(F.split("core", " ")) > 1) & ~F.exists(F.split("core", " "), lambda w: F.length(w) == 1)
    # names without their kind of business are clustered among themselves, and each is a shortened name too: it joins the
    # company that it fits, but can't tie two together
    forms, shorts = nodes.where(whole), nodes.where(~whole | (F.col("kind") == ""))
    labels = components(pairs(forms))
    joined = cut(attach(shorts, forms.where("kind <> ''"), labels).withColumnRenamed("label", "company_label"))
    # one that fits none goes with those it's clustered with, where they fit one
    mates = labels.join(joined, "node").groupBy(F.col("label").alias("l")).agg(F.min("company_label").alias("mate"), F.max("company_label").alias("other")).where("mate = other").drop("other")
    known = read_.join(joined, "node", "left").join(labels, "node", "left").join(mates, F.col("label") == F.col("l"), "left")
    named = known.select("company", F.coalesce("company_label", "mate", "label", "node").alias("label"))
    smallest = named.groupBy("label").agg(F.min("company").alias("cluster"))
    return named.join(smallest, "label").select("company", "cluster")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cut(clusters(table(spark, sf_dir, "jobs")))
    one = c.select(F.col("company").alias("company_a"), "cluster")
    two = c.select(F.col("company").alias("company_b"), "cluster")
    return one.join(two, "cluster").where("company_a < company_b").select("company_a", "company_b")


def all_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(table(spark, sf_dir, "jobs"))


QUERIES = {"p6_found": found, "p6_clusters": all_clusters}
SQL: dict[str, str] = {}
