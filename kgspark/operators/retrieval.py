"""BM25 over tokenized documents, and the measures of a ranked result."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut

K1, B = 1.2, 0.75


def bm25(doc_tokens: DataFrame, query_tokens: DataFrame, variants: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """(qid, doc_id, a score for each of variants {name: (k1, b)}) for doc_tokens(doc_id, token, n) and query_tokens(qid, token), all
    documents that share a token. By default one variant, `score`.

    Corpus statistics are three aggregates; only the query's tokens' postings are joined, once for all variants.
    """
    length = doc_tokens.groupBy("doc_id").agg(F.sum("n").alias("dl"))
    corpus = length.agg(F.count("*").alias("docs"), F.avg("dl").alias("avgdl"))
    q = query_tokens.select("qid", "token").distinct()
    postings = doc_tokens.join(q.select("token").distinct(), "token", "left_semi")
    df = postings.groupBy("token").agg(F.count("*").alias("df"))
    x = postings.join(df, "token").join(length, "doc_id").join(q, "token").crossJoin(F.broadcast(corpus))  # corpus: one row
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = lambda k1, b: F.col("n") * (k1 + 1) / (F.col("n") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return x.groupBy("qid", "doc_id").agg(*[F.sum(idf * tf(k1, b)).alias(name) for name, (k1, b) in (variants or {"score": (K1, B)}).items()])


#: Documents of a block, and how far a bound may fall short of a threshold by rounding
BLOCK_DOCS, SLACK = 64, 1e-5


@dataclass(frozen=True)
class Blocks:
    """Postings (doc_id, block, token, a value for each name), dealt over blocks of about BLOCK_DOCS documents.

    What a posting adds to a document's score is impact(value), which may read the question's columns and must not fall where the
    value rises. A question's words are ordered by what they can add at most. Those at the end, the frequent ones, that together stay
    below the question's threshold can't bring a document there alone: only the postings of the others are joined. What these give a
    document, and at most the largest values of the rest in its block, must reach the threshold; only what is left then is scored
    in full.
    """

    postings: DataFrame
    names: list[str]
    impact: Callable[[Column], Column] = lambda value: value

    def peaks(self) -> DataFrame:
        return self.postings.groupBy("token", "block").agg(*[F.max(v).alias(v) for v in self.names])

    def _summed(self, rows: DataFrame, *keys: str) -> DataFrame:
        return rows.groupBy(*keys).agg(*[F.sum(self.impact(F.col(v))).alias(v) for v in self.names])

    def exact(self, asked: DataFrame, pairs: DataFrame) -> DataFrame:
        """(qid, doc_id, scores) of pairs(qid, doc_id) for asked(qid, token, ...)."""
        return self._summed(asked.join(pairs, "qid").join(self.postings, ["doc_id", "token"]), "qid", "doc_id")

    def _bounded(self, asked: DataFrame) -> DataFrame:
        """asked with what each word, and it with all that come after it, can add at most: _top_v and _rest_v for each name."""
        top = self.peaks().groupBy("token").agg(*[F.max(v).alias(v) for v in self.names])
        q = asked.join(top, "token").select(*asked.columns, *[self.impact(F.col(v)).alias(f"_top_{v}") for v in self.names])
        down = Window.partitionBy("qid").orderBy(F.desc(f"_top_{self.names[0]}"), "token").rowsBetween(Window.currentRow, Window.unboundedFollowing)
        return q.select("*", *[F.sum(f"_top_{v}").over(down).alias(f"_rest_{v}") for v in self.names])

    def _any(self, test: Callable[[str], Column]) -> Column:
        out = F.lit(False)
        for v in self.names:
            out = out | test(v)
        return out

    def candidates(self, asked: DataFrame, least: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(found, other): documents (qid, doc_id, block, partial scores) that may reach least(qid, a threshold for each name) under any
        name, and the asked words that their scores still lack."""
        floor = least.select("qid", *[F.col(v).alias(f"_least_{v}") for v in self.names])
        q = self._bounded(asked).join(floor, "qid", "left")
        floors = [f"_least_{v}" for v in self.names]
        q = cut(q.select(*asked.columns, *floors, self._any(lambda v: F.col(f"_rest_{v}") >= F.coalesce(f"_least_{v}", F.lit(0.0)) - SLACK).alias("_first")))
        first, other = q.where("_first"), q.where("not _first").select(*asked.columns)
        part = self._summed(first.select(*asked.columns).join(self.postings, "token"), "qid", "doc_id", "block")
        tail = self._summed(other.join(self.peaks(), "token"), "qid", "block").select("qid", "block", *[F.col(v).alias(f"_tail_{v}") for v in self.names])
        whole = part.join(tail, ["qid", "block"], "left").join(floor, "qid", "left")
        reached = self._any(lambda v: F.col(v) + F.coalesce(f"_tail_{v}", F.lit(0.0)) >= F.coalesce(f"_least_{v}", F.lit(0.0)) - SLACK)
        return cut(whole.where(reached).select("qid", "doc_id", "block", *self.names)), other

    def reaching(self, asked: DataFrame, least: DataFrame) -> DataFrame:
        """(qid, doc_id, scores) of every document that may reach least(qid, ...); those left out don't reach it."""
        found, other = self.candidates(asked, least)
        more = self.exact(other, found.select("qid", "doc_id")).select("qid", "doc_id", *[F.col(v).alias(f"_more_{v}") for v in self.names])
        return found.join(more, ["qid", "doc_id"], "left").select("qid", "doc_id", *[(F.col(v) + F.coalesce(f"_more_{v}", F.lit(0))).alias(v) for v in self.names])

    def guesses(self, asked: DataFrame, k: int) -> DataFrame:
        """(qid, doc_id): k documents that score well by the words that can add most, those up to half of what all can add."""
        (v,) = self.names
        w, q = Window.partitionBy("qid"), self._bounded(asked)
        seeds = q.withColumn("_all", F.max(f"_rest_{v}").over(w)).where(F.col(f"_rest_{v}") * 2 > F.col("_all")).select(*asked.columns)
        part = self._summed(seeds.join(self.postings, "token"), "qid", "doc_id")
        return part.withColumn("_r", F.row_number().over(w.orderBy(F.desc(v), "doc_id"))).where(F.col("_r") <= k).select("qid", "doc_id")

    def top(self, asked: DataFrame, k: int) -> DataFrame:
        """(qid, doc_id, score, rank) of the first k; equal to ranking all scores. The k-th exact score among good guesses is the
        threshold that blocks have to reach."""
        (v,) = self.names
        known = self.exact(asked, self.guesses(asked, k))
        least = cut(known.groupBy("qid").agg(F.min(v).alias(v), F.count("*").alias("n")).where(F.col("n") >= k).drop("n"))
        return ranked(self.reaching(asked, least).withColumnRenamed(v, "score"), k)

    def ranks(self, asked: DataFrame, wanted: DataFrame) -> DataFrame:
        """(variant, qid, rank) of the first of each question's wanted(qid, doc_id) documents, null where none has a score; the wanted
        document's own score is the threshold."""
        place = lambda v: F.struct(F.round(v, 6).alias("s"), (-F.col("doc_id")).alias("d"))
        wanted = cut(wanted.select("qid", "doc_id").distinct())
        known = self.exact(asked, wanted)
        best = cut(known.groupBy("qid").agg(*[F.max(v).alias(v) for v in self.names], *[F.max(place(v)).alias(f"_best_{v}") for v in self.names]))
        scores = self.reaching(asked.join(best.select("qid"), "qid", "left_semi"), best)
        ahead = scores.join(best.drop(*self.names), "qid").groupBy("qid").agg(*[(F.count_if(place(v) > F.col(f"_best_{v}")) + 1).cast("int").alias(v) for v in self.names])
        every = wanted.select("qid").distinct().join(ahead, "qid", "left")
        return every.select("qid", F.explode(F.array(*[F.struct(F.lit(v).alias("variant"), F.col(v).alias("rank")) for v in self.names])).alias("x")).select("x.variant", "qid", "x.rank")


def postings_of(doc_tokens: DataFrame, tokens: DataFrame) -> tuple[DataFrame, int, float]:
    """(doc_id, block, token, n, dl) for the tokens(token) asked for, the number of documents, and their mean length dl. The documents are
    read once: each one's length and its asked tokens come from one grouping."""
    asked = doc_tokens.join(tokens.select("token").distinct().withColumn("_asked", F.lit(True)), "token", "left")
    rows = cut(asked.groupBy("doc_id").agg(F.sum("n").alias("dl"), F.collect_list(F.when(F.col("_asked"), F.struct("token", "n"))).alias("x")))
    docs, mean = rows.agg(F.count("*"), F.avg("dl")).first()
    block = F.pmod(F.xxhash64("doc_id"), F.lit(max(docs // BLOCK_DOCS, 1)))
    return rows.withColumn("block", block).select("doc_id", "block", "dl", F.explode("x").alias("x")).select("doc_id", "block", "x.token", "x.n", "dl"), docs, mean or 0.0


def bm25_blocks(doc_tokens: DataFrame, tokens: DataFrame, variants: dict[str, tuple[float, float]] | None = None) -> Blocks:
    """BM25 as blocks of postings, for the tokens(token) of all questions; scores are those of `bm25`."""
    p, docs, mean = postings_of(doc_tokens, tokens)
    df = p.groupBy("token").agg(F.count("*").alias("df"))
    idf = F.log(1 + (docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = lambda k1, b: F.col("n") * (k1 + 1) / (F.col("n") + k1 * (1 - b + b * F.col("dl") / F.lit(mean)))
    variants = variants or {"score": (K1, B)}
    return Blocks(cut(p.join(df, "token").select("doc_id", "block", "token", *[(idf * tf(k1, b)).alias(v) for v, (k1, b) in variants.items()])), list(variants))


def covering(doc_tokens: DataFrame, asked: DataFrame) -> Blocks:
    """Blocks that score a document by how many of a question's words, counted, it holds: asked(qid, token, n)."""
    p, _, _ = postings_of(doc_tokens, asked)
    return Blocks(p.select("doc_id", "block", "token", F.col("n").alias("hits")), ["hits"], lambda m: F.least(F.col("n"), m))


def ranks_of(scores: DataFrame, wanted: DataFrame, variants: list[str]) -> DataFrame:
    """(variant, qid, rank) of the first of each question's wanted(qid, doc_id) documents, null where none has a score.

    A rank is one more than the number of documents before it, so nothing is sorted: each score is compared with one.
    """
    place = lambda v: F.struct(F.round(v, 6).alias("s"), (-F.col("doc_id")).alias("d"))
    best = scores.join(wanted.select("qid", "doc_id").distinct(), ["qid", "doc_id"]).groupBy("qid").agg(*[F.max(place(v)).alias(f"_{v}") for v in variants])
    ahead = scores.join(best, "qid").groupBy("qid").agg(*[(F.count_if(place(v) > F.col(f"_{v}")) + 1).cast("int").alias(v) for v in variants])
    every = wanted.select("qid").distinct().join(ahead, "qid", "left")
    return every.select("qid", F.explode(F.array(*[F.struct(F.lit(v).alias("variant"), F.col(v).alias("rank")) for v in variants])).alias("x")).select("x.variant", "qid", "x.rank")


def ranked(scores: DataFrame, top: int | None = None) -> DataFrame:
    """scores with `rank`; scores are compared to six digits, equal ones by doc_id."""
    r = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(F.round("score", 6)), "doc_id"))
    out = scores.withColumn("rank", r)
    return out if top is None else out.where(F.col("rank") <= top)


def measures(ranks: DataFrame, by: list[str], at: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """hit@k and mean reciprocal rank of ranks(by..., rank); a null rank is a miss."""
    hits = [F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)).alias(f"hit_{k}") for k in at]
    return ranks.groupBy(*by).agg(F.count("*").alias("questions"), *hits, F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))).alias("mrr"))


def moved(ranks: DataFrame, variant: str, a: str, b: str) -> DataFrame:
    """(qid, rank_a, rank_b) of the questions whose rank differs between two variants."""
    x = ranks.where(F.col(variant) == a).select("qid", F.col("rank").alias("rank_a"))
    y = ranks.where(F.col(variant) == b).select("qid", F.col("rank").alias("rank_b"))
    return x.join(y, "qid", "full").where("rank_a is distinct from rank_b")
