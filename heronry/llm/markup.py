"""Problem 1: markup residue in text documents, with a site style tree over the texts of each host.

Every text is read once, into a tree: elements by their tags, sections by their headings, blocks of text as leaves. The trees of a host are
merged: elements of one path of tags are one element node, their different sequences of child tags are its style nodes, and each leaf has
its contents. The entropy of an element's style nodes is its presentation importance, that of a leaf's contents its content importance; composite importance carries both up the tree,
and branches of low composite importance are cut out of each text. The rest is written as clean text with its structure.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronry.llm._dom import Block, parts, read
from heronry.session import cut, shipped, spread, table

#: Branches of lower composite importance are cut out.
IMPORTANCE = 0.2
#: By what a style node more takes weight from what lies in an element to its presentation, by the published measure.
ATTENUATION = 0.9
#: Texts that each host counts as having besides, all different: what two or three texts share needn't be the site's.
OTHERS = 6
#: What m^(1 - LISTED) of a host's m texts have is listed with its importance; that of rarer things is taken for 1.
LISTED = 0.35
#: A host of more rows than HOT, and than all rows through PIECES, is split.
HOT, PIECES = 100_000, 2000
#: The group and key that count a host's texts; the group of contents.
TEXTS = 0
#: What leaves have for a style: those of HELD (headings, code, formulas) are only cut with a branch.
LEAF, HELD = 0, -1


def _hash(*what: str) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(what).encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def tree(blocks: list[Block]) -> tuple[list[int], list[int], list[int]]:
    """(up, key, style) of each node, parents first: the parent's position, -1 for the root's; a number for the path of tags (of a leaf: with its content); for an
    element's sequence of child tags, equal neighbours once (of a leaf: LEAF or HELD). Sections are elements that hold their heading and what follows to the next heading of their level."""
    up, key, style = [-1], [_hash("")], [0]
    path: list[tuple] = []  # open elements: (tag, number of the section or 0)
    at, tags, kids = [0], [""], [[]]
    chain: list[tuple[int, tuple]] = []  # open sections: (level, element)

    def close() -> None:
        style[at[-1]] = _hash(tags[-1], *kids[-1])
        for open_ in (at, tags, kids):
            open_.pop()

    for n, b in enumerate(blocks):
        if b.kind == "heading":
            while chain and chain[-1][0] >= b.level:
                chain.pop()
            chain.append((b.level, (f"section{b.level}", n + 1)))
        *outer, own = b.path.split("/")
        want = [e for _, e in chain] + [(t, 0) for t in outer if t]
        same = 0
        while same < len(path) and same < len(want) and path[same] == want[same]:
            same += 1
        while len(at) > same + 1:
            close()
        path = want
        for e in want[same:]:
            if kids[-1][-1:] != [e[0]]:
                kids[-1].append(e[0])
            up.append(at[-1])
            tags.append(f"{tags[-1]}/{e[0]}")
            key.append(_hash(tags[-1]))
            style.append(0)
            at.append(len(up) - 1)
            kids.append([])
        if kids[-1][-1:] != [own or b.kind]:
            kids[-1].append(own or b.kind)
        up.append(at[-1])
        key.append(_hash(tags[-1], b.kind, b.text))
        style.append(HELD if b.kind in ("heading", "code", "formula") else LEAF)
    while at:
        close()
    return up, key, style


def importance(texts_with: float, texts: int) -> float:
    """Of content that so many of a host's texts have: 1 for one, less the more have it; the entropy of its spread over the texts."""
    return 1.0 if texts_with < 1 else 1.0 - math.log(texts_with) / math.log(texts + OTHERS)


def composite(up: list[int], key: list[int], style: list[int], known: dict[int, tuple[float, float | None]]) -> list[float]:
    """Composite importance of each node; known: (importance, weight of what lies in it) of elements, (importance, None) of contents.

    An element's is its presentation's and, the fewer style nodes it has the more, the mean of its children's in this text. What isn't listed counts 1.
    """
    inner, kids = [0.0] * len(up), [0] * len(up)
    out = [1.0] * len(up)
    for k in range(len(up) - 1, -1, -1):
        got = known.get(key[k])
        if got is not None:
            below = inner[k] / kids[k] if kids[k] else 1.0
            out[k] = got[0] if style[k] in (LEAF, HELD) else (1 - got[1]) * got[0] + got[1] * below
        if up[k] >= 0:
            inner[up[k]] += out[k]
            kids[up[k]] += 1
    return out


def kept(up: list[int], key: list[int], style: list[int], known: dict[int, tuple[float, float | None]]) -> list[bool]:
    """For each leaf: whether neither it nor a branch that it's in is of low importance. Headings stay or go with their section; the whole text is never cut."""
    worth, out, gone = composite(up, key, style, known), [], [False] * len(up)
    for k in range(1, len(up)):
        gone[k] = gone[up[k]] or (worth[k] < IMPORTANCE and style[k] != HELD)
        if style[k] in (LEAF, HELD):
            out.append(not gone[k])
    return out


def _rows(df: DataFrame, id_col: str, text_col: str, url_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows, hot): rows are (id, host, text, salt); hot has the hosts that are split.

    The host is without `www.`; rows of unusable url have none. A host of more rows than HOT and than a PIECES-th of all is split by id, fewer than PIECES such, whatever the data.
    """
    spark = df.sparkSession
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url_col).cast("string"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:www\.)?([^/?#:]+)", 1)), F.lit(""))
    sizes = df.select(host.alias("h")).where("h <> ''").groupBy("h").agg(F.count("*").alias("n"))
    limit = max(HOT, (sizes.agg(F.sum("n")).first()[0] or 0) / PIECES)
    split = [(r.h, -int(-r.n // limit)) for r in sizes.where(F.col("n") > limit).collect()]
    hot = spark.createDataFrame(split, "h string, pieces int")
    rows = df.select(F.col(id_col).cast("long").alias("id"), host.alias("host"), F.col(text_col).cast("string").alias("text"))
    rows = rows.join(F.broadcast(hot), F.col("host") == F.col("h"), "left")
    return rows.select("id", "host", "text", F.pmod(F.xxhash64("id"), F.coalesce("pieces", F.lit(1))).cast("int").alias("salt")), hot


def _read(rows: DataFrame) -> DataFrame:
    """(id, host, salt, same, text, markup, ends, up, key, style): the one reading of each text: its clean text with where its blocks end, and its tree. same: a number for the text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for h, t in zip(b["host"], b["text"]):
                if not isinstance(t, str):
                    out.append((None, [], [], [], [], []))
                    continue
                r = read(t)
                text, ends = [], []
                for p in parts(r.blocks):
                    text.append(p)
                    ends.append((ends[-1] if ends else 0) + len(p))
                out.append(("".join(text), sorted(r.markup), ends, *(tree(r.blocks) if h and ends else ([], [], []))))
            got = pd.DataFrame(out, columns=["text", "markup", "ends", "up", "key", "style"])
            yield pd.concat([b[["id", "host", "salt", "same"]].reset_index(drop=True), got], axis=1)

    schema = "id long, host string, salt int, same long, text string, markup array<string>, ends array<int>, up array<int>, key array<long>, style array<long>"
    return spread(rows.withColumn("same", F.xxhash64("text")), "id").transform(shipped).mapInPandas(run, schema)


def style_tree(done: DataFrame) -> DataFrame:
    """(host, common): of each host with anything to cut, importance and weight of the elements and contents that many of its texts have.

    A node counts once a text and equal texts (reposts) once. What m^(1 - LISTED) of m texts have is rare by counting, so each host's list is short. Counts are combined before the shuffle.
    """
    once = done.where("host <> '' and size(key) > 0").groupBy("host", "same").agg(F.first("key").alias("key"), F.first("style").alias("style"))
    struct = lambda group, key: F.struct(group.alias("group"), key.alias("key"))
    zero = F.lit(TEXTS).cast("long")
    nodes = F.array_distinct(F.zip_with("key", "style", lambda k, s: F.when(s.isin(LEAF, HELD), struct(zero, k)).otherwise(struct(k, s))))
    each = once.select("host", F.explode(F.concat(F.array(struct(zero, zero)), nodes)).alias("x")).select("host", "x.group", "x.key")
    counts = cut(each.groupBy("host", "group", "key").agg(F.count("*").alias("f")).where(f"group <> {TEXTS} or key = {TEXTS} or f > 2"))
    m = counts.where(f"group = {TEXTS} and key = {TEXTS}").select(F.col("host").alias("mh"), (F.col("f") + OTHERS).alias("m"))
    contents = counts.where(f"group = {TEXTS} and key <> {TEXTS}").select("host", "key", F.col("f").alias("n"), (1 - F.log("f")).alias("e"), F.lit(None).cast("int").alias("styles"))
    elements = counts.where(f"group <> {TEXTS}").groupBy("host", F.col("group").alias("key")).agg(F.sum("f").alias("n"), F.sum(F.col("f") * F.log("f")).alias("e"), F.count("*").cast("int").alias("styles"))
    # content: 1 - log_m f; presentation: the entropy of the styles, - sum of p log_m p
    imp = F.when(F.col("styles").isNull(), 1 - F.log("n") / F.log("m")).otherwise((F.log("n") - F.col("e") / F.col("n")) / F.log("m"))
    known = contents.unionByName(elements).join(m, F.col("host") == F.col("mh")).where(F.log("n") >= (1 - LISTED) * F.log("m")).withColumn("imp", imp)
    node = F.struct("key", "imp", F.pow(F.lit(ATTENUATION), "styles").alias("weight"))
    return known.groupBy("host").agg(F.collect_list(node).alias("common"), F.min(F.when(F.col("styles").isNull(), F.col("imp"))).alias("least")).where(F.col("least") < IMPORTANCE / ATTENUATION).drop("least")


def clean(df: DataFrame, id_col: str = "id", text_col: str = "description", url_col: str = "url") -> DataFrame:
    """(id, text, markup): clean text of each row, and the kinds of markup that it held, sorted.

    Kinds are html (tags, comments, character entities, also escaped), markdown, wiki and latex. Headings stand between blank lines, list items have
    a bullet or their number, code and formulas are indented, cells are a tab apart. Null text stays null, blank text becomes empty; both hold no
    markup. Rows without a host are cleaned by themselves. One row comes out for each that goes in; other columns are ignored; texts of any length are read whole.
    """
    rows, hot = _rows(df, id_col, text_col, url_col)
    done = cut(_read(rows))  # texts are parsed once, and read again as written
    # a split host's short list is copied to each of its pieces
    lists = style_tree(done).join(F.broadcast(hot), F.col("host") == F.col("h"), "left")
    right = lists.select(F.col("host").alias("ch"), "common", F.explode(F.sequence(F.lit(0), F.coalesce("pieces", F.lit(1)) - 1)).alias("cs"))
    met = done.join(right, (F.col("host") == F.col("ch")) & (F.col("salt") == F.col("cs")), "left")

    def pruned(texts: pd.DataFrame) -> pd.Series:
        out = []
        for t, ends, up, key, style, common in texts.itertuples(index=False, name=None):
            if not isinstance(t, str):
                out.append(None)
                continue
            keep = kept(up, key, style, {c["key"]: (c["imp"], c["weight"]) for c in common})
            got = "".join(t[a:b] for a, b, y in zip([0, *ends], ends, keep) if y)
            out.append(got.lstrip("\n"))
        return pd.Series(out, dtype=object)

    # only texts that hold something common go to Python again
    hit = F.arrays_overlap("key", F.transform("common", lambda c: c["key"]))
    cols = [F.when(hit, F.col(c)).alias(c) for c in ("text", "ends", "up", "key", "style", "common")]
    again = F.pandas_udf(pruned, "string")(F.struct(*cols))
    return met.transform(shipped).select("id", F.coalesce(again, "text").alias("text"), "markup")


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean(table(spark, sf_dir, "jobs"))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaned(spark, sf_dir).where("id is not null").select("id", F.explode("markup").alias("markup")).distinct()


QUERIES = {"p1_found": found, "p1_clean": cleaned}
SQL: dict[str, str] = {}
