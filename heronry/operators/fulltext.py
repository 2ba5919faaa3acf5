"""Full-text search as joins: a stored term index kept in step with its texts, phrase membership and BM25 ranking."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Weight of a hit in each field.
WEIGHTS = {"title": 8.0, "description": 1.0, "skills": 2.0}
K1, B = 1.2, 0.75


def _marked() -> tuple[str, str]:
    """The letters of all scripts that are a letter with marks, and those letters."""
    import unicodedata

    bases = {c: [b for b in unicodedata.normalize("NFD", c) if not unicodedata.combining(b)] for c in map(chr, range(0x80, 0x2000)) if c.isalpha()}
    pairs = [(c, b[0]) for c, b in bases.items() if len(b) == 1 and b[0] != c]
    return "".join(c for c, _ in pairs), "".join(b for _, b in pairs)


_MARKED, _BARE = _marked()


def normalized(c: Column) -> Column:
    """Lower case words between single spaces; marks of accented letters are taken off."""
    accents, plain = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿąćęłńóśźżčďěňřšťůžğışőűăâîșț", "aaaaaaceeeeiiiinoooooouuuuyyacelnoszzcdenrstuzgisouaaist"
    return F.trim(F.regexp_replace(F.regexp_replace(F.translate(F.lower(c), accents + _MARKED, plain + _BARE), r"\p{M}", ""), r"[^\p{L}\p{N}]+", " "))


def strip_marks(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Any accented letter without its marks, for scripts that the table in `normalized` doesn't cover."""
    import unicodedata

    for s in batches:
        yield s.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))


def phrase(keyword: str) -> str:
    """A keyword as the index sees it."""
    import re
    import unicodedata

    t = "".join(c for c in unicodedata.normalize("NFKD", keyword.lower()) if not unicodedata.combining(c))
    return " ".join(re.findall(r"[^\W_]+", t))


def has_phrase(text: Column, keyword: Column) -> Column:
    """Whether a text holds a keyword as whole words in a row, both as the index sees them."""
    padded = lambda c: F.concat(F.lit(" "), normalized(F.coalesce(c, F.lit(""))), F.lit(" "))
    return F.contains(padded(text), padded(keyword))


def term_index(docs: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """(doc_id, field, term, pos): one row for each word."""
    rows = [F.struct(F.lit(k).alias("field"), F.split(normalized(F.coalesce(c, F.lit(""))), " ").alias("words")) for k, c in fields.items()]
    return docs.select(F.col("id").alias("doc_id"), F.explode(F.array(*rows)).alias("f")).select("doc_id", "f.field", F.posexplode("f.words").alias("pos", "term")).where("term <> ''")


def hits(docs: DataFrame, fields: dict[str, Column], keywords: list[str]) -> DataFrame:
    """Documents that hold any keyword as a phrase in any field: one scan without an index, no shuffle."""
    any_ = F.lit(False)
    for c in fields.values():
        padded = F.concat(F.lit(" "), normalized(F.coalesce(c, F.lit(""))), F.lit(" "))
        for k in filter(None, map(phrase, keywords)):
            any_ = any_ | F.contains(padded, F.lit(f" {k} "))
    return docs.where(any_)


def bm25(docs: DataFrame, fields: dict[str, Column], keywords: list[str], weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """`docs` that hold a keyword, with `relevance` (higher is better): Okapi BM25, field weights multiply term counts.

    Phrases are counted by removing them from the padded text. Document counts and mean length are one aggregate row, so the
    ranking shuffles nothing but that row.
    """
    wanted = list(dict.fromkeys(filter(None, map(phrase, keywords))))
    d, length = docs, F.lit(0.0)
    for k, c in fields.items():
        d = d.withColumn(f"__{k}", F.concat(F.lit(" "), F.replace(normalized(F.coalesce(c, F.lit(""))), F.lit(" "), F.lit("  ")), F.lit(" ")))
        length = length + F.size(F.filter(F.split(F.col(f"__{k}"), " +"), lambda w: w != ""))
    tf = []
    for j, w in enumerate(wanted):
        needle = " " + w.replace(" ", "  ") + " "
        n = F.lit(0.0)
        for k in fields:
            t = F.col(f"__{k}")
            n = n + weights.get(k, 1.0) * (F.length(t) - F.length(F.replace(t, F.lit(needle), F.lit("")))) / len(needle)
        d = d.withColumn(f"__tf{j}", n)
        tf.append(f"__tf{j}")
    d = d.withColumn("__len", length.cast("double"))
    stats = d.agg(F.count("*").alias("__n"), F.avg("__len").alias("__avg"), *[F.count_if(F.col(t) > 0).alias(f"__df{j}") for j, t in enumerate(tf)])
    d = d.where(" or ".join(f"{t} > 0" for t in tf) if tf else "false").crossJoin(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for j, t in enumerate(tf):
        idf = F.log(1 + (F.col("__n") - F.col(f"__df{j}") + 0.5) / (F.col(f"__df{j}") + 0.5))
        score = score + idf * F.col(t) * (K1 + 1) / (F.col(t) + K1 * (1 - B + B * F.col("__len") / F.col("__avg")))
    return d.withColumn("relevance", score).drop(*[c for c in d.columns if c.startswith("__")])


#: Folders that an index's terms are spread over; a search reads those of its words only.
BUCKETS = 64


class TextIndex:
    """A term index in a folder: generations of postings, each with the documents that it adds and those of former generations that it takes the place of.

    A change writes what changed; a search reads the postings of its words only, and of these the newest of each document. Ids are bigint.
    """

    def __init__(self, spark: SparkSession, folder: str, fields: dict[str, Column]):
        self.spark, self.folder, self.fields = spark, folder, fields
        self.generations = 0

    def add(self, docs: DataFrame, gone: DataFrame | None = None) -> TextIndex:
        """One more generation: `docs` (id and what the fields are made of) added or changed, `gone` (id) taken out. Null texts are empty; of repeated ids all rows count."""
        to = f"{self.folder}/generation={self.generations}"
        words = [F.struct(F.lit(k).alias("field"), F.filter(F.split(normalized(F.coalesce(c, F.lit(""))), " "), lambda w: w != "").alias("words")) for k, c in self.fields.items()]
        rows = docs.select(F.col("id").alias("doc_id"), F.array(*words).alias("f"))
        rows.select("doc_id", F.aggregate("f", F.lit(0), lambda a, x: a + F.size(x["words"])).alias("length")).write.mode("overwrite").parquet(f"{to}/docs")
        each = rows.select("doc_id", F.explode("f").alias("f")).select("doc_id", "f.field", F.posexplode("f.words").alias("pos", "term"))
        posts = each.groupBy("term", "doc_id", "field").agg(F.array_sort(F.collect_list("pos")).alias("at")).withColumn("bucket", F.pmod(F.crc32(F.col("term").cast("binary")), F.lit(BUCKETS)).cast("int"))
        # a common term's postings may be most of a bucket: they are spread by document, too
        posts.repartition("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(8))).sortWithinPartitions("bucket", "term", "doc_id").write.mode("overwrite").partitionBy("bucket").parquet(f"{to}/terms")
        ids = docs.select(F.col("id").alias("doc_id"))
        (ids if gone is None else ids.unionByName(gone.select(F.col("id").alias("doc_id")))).distinct().write.mode("overwrite").parquet(f"{to}/gone")
        self.generations += 1
        return self

    def _now(self, what: str, schema: str, keep: Column | None = None) -> DataFrame:
        """The rows of all generations that no later one takes the place of."""
        out = None
        for g in range(self.generations):
            rows = self.spark.read.schema(schema).parquet(f"{self.folder}/generation={g}/{what}")
            rows = rows if keep is None else rows.where(keep)
            if g + 1 < self.generations:
                later = self.spark.read.schema("doc_id long").parquet(*[f"{self.folder}/generation={k}/gone" for k in range(g + 1, self.generations)]).distinct()
                rows = rows.join(later, "doc_id", "left_anti")
            out = rows if out is None else out.unionByName(rows)
        return out if out is not None else self.spark.createDataFrame([], schema)

    def docs(self) -> DataFrame:
        """(doc_id, length)"""
        return self._now("docs", "doc_id long, length int")

    def postings(self, words: list[str] | None = None) -> DataFrame:
        """(term, doc_id, field, at): the places of each term in each field of each document, from 0; of all terms or of these."""
        keep = None
        if words is not None:
            buckets = sorted({zlib.crc32(w.encode()) % BUCKETS for w in words})
            keep = F.col("bucket").isin(*buckets) & F.col("term").isin(*words) if words else F.lit(False)
        return self._now("terms", "term string, doc_id long, field string, at array<int>, bucket int", keep).drop("bucket")

    def counts(self, keywords: list[str], weights: dict[str, float] | None = None) -> DataFrame:
        """(doc_id, tf_0, tf_1...): of documents that hold any keyword, how often they hold each as a phrase, fields weighted."""
        wanted = [k.split(" ") for k in dict.fromkeys(filter(None, map(phrase, keywords)))]
        p = self.postings(sorted({w for k in wanted for w in k}))
        by = p.groupBy("doc_id", "field").agg(F.map_from_entries(F.collect_list(F.struct("term", "at"))).alias("m"))
        back = lambda k: lambda x: x - k
        at = lambda w: F.coalesce(F.try_element_at("m", F.lit(w)), F.array().cast("array<int>"))

        def times(words: list[str]) -> Column:
            starts = at(words[0])
            for k, w in enumerate(words[1:], 1):
                starts = F.array_intersect(starts, F.transform(at(w), back(k)))
            return F.size(starts)

        weight = F.coalesce(*[F.when(F.col("field") == f, F.lit(w)) for f, w in weights.items()], F.lit(1.0)) if weights else F.lit(1.0)
        out = by.groupBy("doc_id").agg(*[F.sum(times(k) * weight).alias(f"tf_{j}") for j, k in enumerate(wanted)]) if wanted else by.select("doc_id").limit(0)
        return out.where(" or ".join(f"tf_{j} > 0" for j in range(len(wanted))) if wanted else "false")

    def hits(self, keywords: list[str]) -> DataFrame:
        """(doc_id) of the documents that hold any keyword as a phrase."""
        return self.counts(keywords).select("doc_id")

    def ranked(self, keywords: list[str], weights: dict[str, float] | None = None) -> DataFrame:
        """(doc_id, relevance): Okapi BM25 of the documents that hold a keyword, higher is better, as `bm25` gives it without an index."""
        c = self.counts(keywords, WEIGHTS if weights is None else weights)
        tfs = [t for t in c.columns if t.startswith("tf_")]
        docs = self.docs()
        n = docs.agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
        df = c.agg(F.count("*").alias("found"), *[F.count_if(F.col(t) > 0).alias(f"df_{t}") for t in tfs])
        rows = c.join(docs, "doc_id").crossJoin(F.broadcast(n)).crossJoin(F.broadcast(df))  # one row each
        score = F.lit(0.0)
        for t in tfs:
            d = F.col(f"df_{t}")
            score = score + F.log(1 + (F.col("n") - d + 0.5) / (d + 0.5)) * F.col(t) * (K1 + 1) / (F.col(t) + K1 * (1 - B + B * F.col("length") / F.col("mean")))
        return rows.select("doc_id", score.alias("relevance"))
