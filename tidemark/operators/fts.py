"""Full-text search: matching and BM25 ranking over an inverted index."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.folders import written


def terms_of(text: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), 1)


def parsed(query: str) -> tuple:
    """A query of terms, "phrases", prefixes*, AND, OR, NOT and parentheses as a tree; terms side by side must all be there.

    Leaves are (words, prefix): words that stand side by side, the last one a beginning only if `prefix`.
    """
    found = re.findall(r'"[^"]*"|\(|\)|[^\s()"]+', query)
    at = 0

    def either() -> tuple:
        nonlocal at
        left = both()
        while at < len(found) and found[at] == "OR":
            at += 1
            left = ("or", left, both())
        return left

    def both() -> tuple:
        nonlocal at
        left = one()
        while at < len(found) and found[at] not in ("OR", ")"):
            kind = "and"
            if found[at] in ("AND", "NOT"):
                kind = found[at].lower()
                at += 1
            left = (kind, left, one())
        return left

    def one() -> tuple:
        nonlocal at
        if at >= len(found):
            raise ValueError("syntax error in search query")
        word = found[at]
        at += 1
        if word == "(":
            inner = either()
            if at >= len(found) or found[at] != ")":
                raise ValueError("unbalanced parentheses in search query")
            at += 1
            return inner
        return ("leaf", re.findall(r"[^\W_]+", word.lower()), word.endswith("*"))

    made = either()
    if at < len(found):
        raise ValueError("syntax error in search query")
    return made


def condition(text: str, query: str) -> str:
    """Spark SQL that tells whether a text (also Spark SQL) matches a query; what NOT leaves out is not counted."""
    padded = f"concat(' ', regexp_replace(lower({text}), '[^\\\\p{{L}}\\\\p{{N}}]+', ' '), ' ')"

    def told(node: tuple) -> str:
        if node[0] == "leaf":
            words = " ".join(node[1])
            return f"contains({padded}, ' {words}{'' if node[2] else ' '}')" if words else "false"
        a, b = told(node[1]), told(node[2])
        return f"({a} AND NOT {b})" if node[0] == "not" else f"({a} {node[0].upper()} {b})"

    return told(parsed(query))


def matches(text: Column, query: str) -> Column:
    """The same as a condition on a column, which is padded once."""
    padded = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), F.lit(" "))

    def told(node: tuple) -> Column:
        if node[0] == "leaf":
            words = " ".join(node[1])
            return F.contains(padded, F.lit(f" {words}" if node[2] else f" {words} ")) if words else F.lit(False)
        a, b = told(node[1]), told(node[2])
        return a | b if node[0] == "or" else a & ~b if node[0] == "not" else a & b

    return told(parsed(query))


def inverted_index(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """term, id, tf, length, places: one row for each term of a document.

    Words are numbered within their document and gathered by (id, term) with partial aggregation, so a long document costs
    as much as its words; the length is counted before and carried along.
    """
    words = docs.select(F.col(id_col).alias("id"), terms_of(F.col(text_col)).alias("words"))
    spread = words.select("id", F.size("words").alias("length"), F.posexplode("words").alias("at", "term"))
    return spread.groupBy("term", "id", "length").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("at")).alias("places"))


class Index:
    """An inverted index that is kept: postings in folders by a hash of the term, so a search opens those of its terms only.

    Postings of a frequent term are many rows of many files, never one row; sums over all documents are one row beside them.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.postings = spark.read.parquet(f"{self.root}/postings")
        self.buckets, self.n, self.mean = spark.read.parquet(f"{self.root}/totals").first()

    @classmethod
    def build(cls, docs: DataFrame, id_col: str, text_col: str, root: str, buckets: int = 64) -> Index:
        made = inverted_index(docs, id_col, text_col).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)))
        # Rebalanced by folder: few files in each, while the folder of a frequent term is split.
        made.hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{root.rstrip('/')}/postings")
        spark = docs.sparkSession
        words = spark.read.parquet(f"{root.rstrip('/')}/postings").agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("words"))
        # A document without text counts with no words.
        both = docs.agg(F.count("*").alias("n")).crossJoin(words)
        both.select(F.lit(buckets).alias("buckets"), "n", F.try_divide(F.col("words").cast("double"), F.col("n")).alias("mean")).write.parquet(f"{root.rstrip('/')}/totals")
        return cls(spark, root)

    def of(self, word: str, prefix: bool = False) -> DataFrame:
        """The postings of a term, or of all terms that begin with it (which may be in any folder)."""
        if prefix:
            return self.postings.where(F.startswith("term", F.lit(word)))
        # A constant once it is optimised, so only that folder is listed and opened.
        bucket = F.pmod(F.xxhash64(F.lit(word)), F.lit(self.buckets))
        return self.postings.where((F.col("bucket") == bucket) & (F.col("term") == word))

    def search(self, query: str) -> DataFrame:
        """Ids of the documents that match; NOT leaves out what its left side found."""

        def leaf(words: list[str], prefix: bool) -> DataFrame:
            if not words:
                return self.postings.where("false").select("id")
            if len(words) == 1:
                return self.of(words[0], prefix).select("id").distinct()
            parts = [self.of(w, prefix and k == len(words) - 1).select("id", F.explode("places").alias("at")).select("id", (F.col("at") - k).alias("s")) for k, w in enumerate(words)]
            found = parts[0]
            for p in parts[1:]:
                # Words side by side agree in where the first of them stands.
                found = found.join(p.distinct(), ["id", "s"], "left_semi")
            return found.select("id").distinct()

        def told(node: tuple) -> DataFrame:
            if node[0] == "leaf":
                return leaf(node[1], node[2])
            a, b = told(node[1]), told(node[2])
            return a.union(b).distinct() if node[0] == "or" else a.join(b, "id", "left_anti" if node[0] == "not" else "left_semi")

        return told(parsed(query))

    def bm25(self, query: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """id, score of every document with a query term, from the terms' postings alone."""
        terms = sorted({w.lower() for w in query})
        parts = [self.of(t).select("term", "id", "tf", "length") for t in terms]
        hits = parts[0]
        for p in parts[1:]:
            hits = hits.union(p)
        known = F.broadcast(hits.groupBy("term").agg(F.count("*").alias("df")))  # a row for each query term
        idf = F.greatest(F.log((self.n - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
        one = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.lit(self.mean)))
        return hits.join(known, "term").groupBy("id").agg(F.sum(one).alias("score"))


def _times(term: str) -> Column:
    """How often a term stands in `words`."""
    return F.size(F.filter("words", lambda w: w == F.lit(term)))


def bm25(docs: DataFrame, id_col: str, text_col: str, query: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """id, score of every document with a query term. Only the query's terms are counted, each by one pass over the words."""
    terms = sorted({w.lower() for w in query})
    words = docs.select(F.col(id_col).alias("id"), terms_of(F.col(text_col)).alias("words"))
    # Written once, as both the sums over all documents and the scores are made of it.
    counted = written(words.select("id", F.size("words").alias("length"), *[_times(t).alias(f"tf{i}") for i, t in enumerate(terms)]), "bm25")
    stats = counted.agg(F.count("*").alias("n"), F.avg("length").alias("mean"), *[F.sum((F.col(f"tf{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(terms))])
    joined = counted.where(" OR ".join(f"tf{i} > 0" for i in range(len(terms)))).crossJoin(F.broadcast(stats))
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.greatest(F.log((F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)), F.lit(1e-6))
        tf = F.col(f"tf{i}")
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    return joined.select("id", score.alias("score"))


def snippet(text: Column, term: str, around: int = 32, left: str = "[", right: str = "]") -> Column:
    """The text around the first place of a term, the term marked."""
    at = F.instr(F.lower(text), F.lit(term.lower()))
    start = F.greatest(at - around, F.lit(1))
    head = F.substring(text, start, at - start)
    return F.when(at > 0, F.concat(head, F.lit(left), F.substring(text, at, F.lit(len(term))), F.lit(right), F.substring(text, at + len(term), F.lit(around))))
