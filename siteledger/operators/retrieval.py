"""Rankings of documents for queries: BM25, cosine, rank fusion, and their scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteledger.plans.lineage import cut

K1, B, EPSILON, RRF = 1.5, 0.75, 0.25, 60


def ranked(scores: DataFrame, query: str, doc: str, score: Column, k: int) -> DataFrame:
    """The k best documents of each query, ties by document; only k rows of a task get past the map side."""
    w = Window.partitionBy(query).orderBy(F.col("score").desc(), F.col(doc).asc())
    return scores.withColumn("score", score).withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)


#: Postings (query, token) that go to the tasks at once, and cells of one score matrix.
POSTINGS, CELLS = 2_000_000, 4_000_000


def bm25(documents: DataFrame, queries: DataFrame, doc: str, query: str, tokens: str, k: int | None = None, positive: bool = False, digits: int = 6) -> DataFrame:
    """query, doc, score (rounded) of documents that share a token with the query; with k, the k best of each query, ties by document.

    Documents' tokens are written once. One pass counts how many documents hold each token, and one scores: a task has the
    queries' tokens as a sparse matrix and keeps k documents for each query, so no pair that can't win is shuffled. Queries whose
    postings don't fit in POSTINGS take several passes. A token in over half of the documents gets EPSILON times the mean weight of all
    tokens of the corpus, as the usual formula would turn negative. positive leaves out scores that aren't above zero.
    """
    spark = documents.sparkSession
    sized = cut(documents.select(F.col(doc).cast("long").alias("doc"), F.col(tokens).alias("tokens")), "tokens")
    n_docs, mean = sized.agg(F.count(F.lit(1)), F.avg(F.size("tokens"))).first()
    df = sized.select(F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    weighed = cut(df.select("token", F.log((F.lit(float(n_docs)) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")), "idf")
    floor = EPSILON * (weighed.agg(F.avg("idf")).first()[0] or 0.0)
    words = queries.select(F.col(query).cast("long").alias("query"), F.explode(tokens).alias("token")).groupBy("query", "token").agg(F.count(F.lit(1)).alias("times"))
    idf = F.when(F.col("idf") < 0, F.lit(floor)).otherwise(F.col("idf"))
    words = cut(words.join(weighed, "token").select("query", "token", (F.col("times") * idf).alias("weight")), "postings")
    n_passes = max(1, -(-words.count() // POSTINGS))
    out = None
    for i in range(n_passes):
        # POSTINGS rows on average: a query's postings stay together
        part = words.where(F.pmod(F.xxhash64("query"), F.lit(n_passes)) == i).toArrow()
        found = sized.mapInArrow(_scorer(spark, part, float(mean or 1.0), k, positive, digits), "query long, doc long, score double")
        out = found if out is None else out.unionByName(found)
    out = out.select(F.col("query").alias(query), F.col("doc").alias(doc), "score")
    return ranked(out, query, doc, F.col("score"), k) if k else out


def _scorer(spark, postings: pa.Table, mean: float, k: int | None, positive: bool, digits: int):
    """A function over batches of (doc, tokens) that gives query, doc, score."""
    postings = postings.sort_by([("token", "ascending"), ("query", "ascending")])
    terms = postings.column("token").combine_chunks().dictionary_encode()
    names, which = np.unique(postings.column("query").to_numpy(), return_inverse=True)
    starts = np.searchsorted(terms.indices.to_numpy(), np.arange(len(terms.dictionary) + 1))
    shared = spark.sparkContext.broadcast((terms.dictionary, starts, which, postings.column("weight").to_numpy(), names))  # at most about POSTINGS rows

    def some(docs: np.ndarray, tokens: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        dictionary, starts, which, weight, names = shared.value
        sizes = np.diff(tokens.offsets.to_numpy())
        term = pc.index_in(tokens.flatten(), value_set=dictionary).fill_null(-1).to_numpy().astype(np.int64)
        owner = np.repeat(np.arange(len(docs)), sizes)
        hit = term >= 0
        key, tf = np.unique(owner[hit] * len(dictionary) + term[hit], return_counts=True)
        owner, term = key // len(dictionary), key % len(dictionary)
        part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[owner] / mean))
        n = starts[term + 1] - starts[term]
        at = np.repeat(starts[term] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        cell = np.repeat(owner, n) * len(names) + which[at]
        scores = np.bincount(cell, np.repeat(part, n) * weight[at], len(docs) * len(names)).reshape(len(docs), len(names)).round(digits)
        touched = np.bincount(cell, minlength=scores.size).reshape(scores.shape) > 0
        row, col = np.nonzero(touched & (scores > 0) if positive else touched)
        return names[col], docs[row], scores[row, col]

    def best(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, d, s = (np.concatenate([p[i] for p in parts]) for i in range(3))
        order = np.lexsort((d, -s, q))
        q, d, s = q[order], d[order], s[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        return q[rank < k], d[rank < k], s[rank < k]

    def batch_of(parts) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(parts[0], pa.int64()), pa.array(parts[1], pa.int64()), pa.array(parts[2], pa.float64())], names=["query", "doc", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not len(postings):
            return
        rows, held = max(1, CELLS // max(1, len(names))), []
        for batch in batches:
            good = batch.filter(pc.and_(batch.column(0).is_valid(), batch.column(1).is_valid()))
            for at in range(0, good.num_rows, rows):
                piece = good.slice(at, rows)
                tokens = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(pc.list_value_length(piece.column(1)).to_numpy())]).astype(np.int32)), piece.column(1).flatten())
                found = some(piece.column(0).to_numpy(), tokens)
                if k is None:
                    yield batch_of(found)
                else:
                    held = [best([*held, found])]
        if held:
            yield batch_of(held[0])

    return run


def padded(ranking: DataFrame, documents: DataFrame, queries: DataFrame, doc: str, query: str, k: int) -> DataFrame:
    """The first k of a full order of all documents for each query: those that ranking lacks score 0 and come by id.

    ranking holds each query's k best of the documents with a score. Only the 2 k documents with the smallest ids can fill places, so that is all that is met.
    """
    least = documents.select(F.col(doc).cast("long").alias(doc)).orderBy(doc).limit(2 * k)
    # 2 * k rows
    free = queries.select(F.col(query).cast("long").alias(query)).distinct().join(F.broadcast(least.withColumn("_all", F.lit(1))), F.lit(1) == F.col("_all")).drop("_all")
    rest = free.join(ranking.select(query, doc), [query, doc], "left_anti").withColumn("score", F.lit(0.0))
    return ranked(ranking.select(query, doc, "score").unionByName(rest), query, doc, F.col("score"), k)


def nearest(vectors: DataFrame, queries: DataFrame, id_col: str, vector: str, k: int, dims: int | None = None, rows: int = 2048, digits: int = 6) -> DataFrame:
    """query, doc, score, rank: the k best vectors by cosine for each query, in double precision, itself left out.

    Queries are blocked into matrices of `rows` vectors; each task of the corpus multiplies its vectors with each block
    and keeps k for each query, so no task holds more than a block's scores.
    """
    flat = lambda df: df.where(F.col(vector).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    blocks = flat(queries)
    n_blocks = max(1, -(-blocks.count() // rows))

    def matrix(column: pa.Array) -> bytes:
        """Unit rows as bytes; all vectors have one length."""
        out = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)[:, :dims]
        size = np.linalg.norm(out, axis=1)
        return (out / np.where(size > 0, size, 1)[:, None]).tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                some = batch.slice(at, rows)
                yield pa.RecordBatch.from_arrays([pa.array([some.column(0).to_numpy().tobytes()], pa.binary()), pa.array([matrix(some.column(1))], pa.binary())], names=["ids", "units"])

    packed = "ids binary, units binary"
    dealt = blocks.repartition(n_blocks, "id").mapInArrow(pieces, packed)
    asked = cut(dealt.select(F.spark_partition_id().alias("block"), F.col("ids").alias("q_ids"), F.col("units").alias("q_units")), "query-blocks")
    # up to four blocks go to every task; of more, each meets a copy of the corpus through an exchange
    asked = F.broadcast(asked) if n_blocks <= 4 else asked
    met = flat(vectors).mapInArrow(pieces, packed).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).join(asked, "block").drop("block")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, units, names, asked_units = (np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in enumerate((np.int64, np.float64, np.int64, np.float64)))
                if not len(ids) or not len(names):
                    continue
                sims = np.round(asked_units.reshape(len(names), -1) @ units.reshape(len(ids), -1).T, digits)
                sims[names[:, None] == ids[None, :]] = -np.inf
                top = np.lexsort((np.broadcast_to(ids, sims.shape), -sims), axis=1)[:, :k]
                best = np.take_along_axis(sims, top, 1)
                good = best > -np.inf
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, top.shape[1])[good.ravel()]), pa.array(ids[top][good]), pa.array(best[good])], names=["query", "doc", "score"])

    found = met.mapInArrow(scored, "query long, doc long, score double")
    return ranked(found, "query", "doc", F.col("score"), k)


def fused(channels: list[DataFrame], k: int, digits: int = 9) -> DataFrame:
    """query, doc, score, rank by the sum of 1 / (60 + rank) over the channels."""
    out = channels[0].select("query", "doc", "rank")
    for c in channels[1:]:
        out = out.unionByName(c.select("query", "doc", "rank"))
    score = out.groupBy("query", "doc").agg(F.round(F.sum(1.0 / (RRF + F.col("rank"))), digits).alias("score"))
    return ranked(score, "query", "doc", F.col("score"), k)


def quality(rankings: DataFrame, queries: DataFrame, relevant: str, cutoffs: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """One row: queries, mrr (a query without a hit counts 0), hits at each cutoff."""
    first = rankings.where(F.col(relevant)).groupBy("query").agg(F.min("rank").alias("first"))
    all_ = queries.select("query").distinct().join(first, "query", "left")
    return all_.agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg(F.coalesce(F.try_divide(F.lit(1.0), F.col("first")), F.lit(0.0))), 9).alias("mrr"), *[F.count_if(F.col("first") <= c).alias(f"hits_at_{c}") for c in cutoffs])
