"""Hybrid retrieval: lexical and vector lists for many queries at once, fused by reciprocal rank.

Queries and documents carry a ``grp`` (the candidate set that a query searches, such as a memory space), and every step is an
equi-join on it: no query ever meets documents outside its set.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.checkpoints import materialise
from palimpsest.functions import text
from palimpsest.operators import lookup
from palimpsest.session import shuffle_partitions, task_slots

#: BM25 as defined here: these parameters, the natural logarithm of 1 + (N - df + 0.5) / (df + 0.5), lower case, no stop words.
K1, B = 1.5, 0.75
RRF_K, RRF_FLOOR, DENSE_FLOOR, OVERSAMPLE = 50, 0.01, 0.12, 24
#: Least score of text search alone, memories of an entity that are indexed anew with it; more nodes than any set has.
LEXICAL_FLOOR, REINDEXED, MANY = 0.08, 200, 1 << 62
#: Scores are compared after rounding to so many digits, so that the order of additions decides nothing.
DIGITS = 9
#: Vectors of one block: 4096 of 768 float32 are 12 MB. Queries of one block in text search: scores of 256 by 4096 are 8 MB.
BLOCK, ASKED_BLOCK = 4096, 256


def bm25(queries: DataFrame, documents: DataFrame) -> DataFrame:
    """(query_id, doc_id, score) for all documents (grp, doc_id, text) that share a token with the query (query_id, grp, text).

    Statistics are those of the query's own candidate set. A repeated query token counts once a repetition. Texts without
    tokens match nothing. The inverted lists are joined on (grp, token); only postings of tokens that some query has are kept.
    """
    asked = queries.select("query_id", "grp", F.explode(text.tokens(F.col("text"))).alias("token"))
    asked = asked.groupBy("grp", "token", "query_id").agg(F.count("*").alias("times"))
    words = documents.select("grp", "doc_id", text.tokens(F.col("text")).alias("words"))
    size = words.groupBy("grp").agg(F.count("*").alias("n_docs"), F.avg(F.size("words")).alias("mean_length"))
    postings = words.select("grp", "doc_id", F.size("words").alias("length"), F.explode("words").alias("token"))
    postings = postings.join(asked.select("grp", "token").distinct(), ["grp", "token"], "left_semi")
    postings = postings.groupBy("grp", "token", "doc_id", "length").agg(F.count("*").alias("tf"))
    frequency = postings.groupBy("grp", "token").agg(F.count("*").alias("df"))
    weighed = frequency.join(size, "grp").withColumn("idf", F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    hit = asked.join(weighed, ["grp", "token"]).join(postings, ["grp", "token"])
    tf, norm = F.col("tf"), 1 - B + B * F.col("length") / F.col("mean_length")
    part = F.col("times") * F.col("idf") * tf * (K1 + 1) / (tf + K1 * norm)
    return hit.groupBy("query_id", "doc_id").agg(F.round(F.sum(part), DIGITS).alias("score")).where("score > 0")


def word_blocks(documents: DataFrame) -> DataFrame:
    """Documents (grp, doc_id, text) for ``bm25_best``, in blocks (grp, block, doc_ids, lengths, words, n_words) of about ``BLOCK``
    of one group, with their tokens one after the other."""
    many = documents.groupBy("grp").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    words = documents.select("grp", "doc_id", text.tokens(F.col("text")).alias("words"))
    placed = words.join(many, "grp").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    packed = placed.groupBy("grp", "block").agg(F.collect_list(F.struct("doc_id", F.size("words").alias("length"), "words")).alias("v"))
    packed = packed.select("grp", "block", F.col("v")["doc_id"].alias("doc_ids"), F.col("v")["length"].alias("lengths"), F.flatten(F.col("v")["words"]).alias("words"))
    return packed.withColumn("n_words", F.size("words"))


def _asked_blocks(terms: DataFrame) -> DataFrame:
    """Terms (grp, query_id, token, weight) in blocks (grp, query_ids, sizes, tokens, weights) of about ``ASKED_BLOCK`` queries."""
    each = terms.groupBy("grp", "query_id").agg(F.collect_list(F.struct("token", "weight")).alias("terms"))
    many = terms.groupBy("grp").agg(F.ceil(F.count_distinct("query_id") / ASKED_BLOCK).alias("blocks"))
    placed = each.join(many, "grp").withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("blocks")))
    packed = placed.groupBy("grp", "part").agg(F.collect_list(F.struct("query_id", F.size("terms").alias("size"), "terms")).alias("v"))
    flat = F.flatten(F.col("v")["terms"])
    return packed.select("grp", F.col("v")["query_id"].alias("query_ids"), F.col("v")["size"].alias("sizes"), flat["token"].alias("tokens"), flat["weight"].alias("weights"))


def _postings(tokens: pa.Array, words: pa.Array, lengths: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The different ``tokens``, the place of each among them, and the inverted lists of a block's ``words`` for them: the start of
    each list, documents and frequencies."""
    coded = tokens.dictionary_encode()
    at = pc.index_in(words, value_set=coded.dictionary).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    key, tf = np.unique((at * len(lengths) + doc)[at >= 0], return_counts=True)
    token, doc = np.divmod(key, len(lengths))
    return coded.dictionary, coded.indices.to_numpy(), np.searchsorted(token, np.arange(len(coded.dictionary) + 1)), doc, tf


def bm25_best(queries: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, score, rank): of every query the ``k`` best by ``bm25`` among documents in ``word_blocks``.

    Exact, without a row for each document that shares a token with a query, whose number grows with the product of queries and
    documents of a group: blocks of queries meet blocks of documents of their group, inverted lists are added up in arrays, and
    each pair of blocks keeps k documents a query with all that tie with the last one.
    """
    spark = blocks.sparkSession
    kinds = [queries.schema["query_id"].dataType.simpleString(), blocks.schema["doc_ids"].dataType.elementType.simpleString()]
    grp = blocks.schema["grp"].dataType.simpleString()
    asked = queries.select("query_id", "grp", F.explode(text.tokens(F.col("text"))).alias("token"))
    asked = materialise(asked.groupBy("grp", "query_id", "token").agg(F.count("*").cast("double").alias("times")), "terms")
    size = blocks.groupBy("grp").agg(F.sum(F.size("doc_ids")).alias("n_docs"), (F.sum("n_words") / F.sum(F.size("doc_ids"))).alias("mean_length"), F.max("block").alias("last"))
    # as many tasks as there are slots, however small the blocks: what they cost is not their size
    spread = blocks.repartition(max(2 * task_slots(spark), shuffle_partitions(spark)), "grp", "block")
    to = F.explode(F.sequence(F.lit(0), F.col("last"))).alias("block")
    meet = lambda terms: spread.join(_asked_blocks(terms).join(size, "grp").select("grp", to, "query_ids", "sizes", "tokens", "weights", "mean_length"), ["grp", "block"])

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                tokens, words, lengths = (batch.column(c)[row].values for c in ("tokens", "words", "lengths"))
                known, _, starts, _, _ = _postings(tokens, words, lengths.to_numpy())
                n = np.diff(starts)
                of = lambda c: pa.array([batch.column(c)[row].as_py()] * int((n > 0).sum()), batch.schema.field(c).type)  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([of("grp"), of("block"), known.filter(pa.array(n > 0)), pa.array(n[n > 0])], names=["grp", "block", "token", "n"])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                q_ids, sizes, tokens, weights, d_ids, lengths, words = (batch.column(c)[row].values for c in ("query_ids", "sizes", "tokens", "weights", "doc_ids", "lengths", "words"))
                lengths = lengths.to_numpy()
                _, place, starts, doc, tf = _postings(tokens, words, lengths)
                mean = batch.column("mean_length")[row].as_py()
                part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[doc] / mean))
                ends, weights = np.cumsum(sizes.to_numpy()), weights.to_numpy()
                of_query, of_doc, scores = [], [], []
                for q, (a, z) in enumerate(zip(ends - sizes.to_numpy(), ends)):
                    first, n = starts[place[a:z]], starts[place[a:z] + 1] - starts[place[a:z]]
                    if not n.any():
                        continue
                    at = np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)
                    score = np.bincount(doc[at], weights=part[at] * np.repeat(weights[a:z], n), minlength=len(lengths))
                    edge = np.partition(score, len(score) - k)[len(score) - k] if len(score) > k else 0.0
                    near = np.flatnonzero((score > 0) & (score >= edge - 2 * 10.0**-DIGITS))  # equal ones after rounding stay in
                    of_query.append(np.full(len(near), q))
                    of_doc.append(near)
                    scores.append(score[near])
                if of_query:
                    yield pa.RecordBatch.from_arrays([q_ids.take(pa.array(np.concatenate(of_query))), d_ids.take(pa.array(np.concatenate(of_doc))), pa.array(np.concatenate(scores))], names=["query_id", "doc_id", "score"])

    # a token that two blocks of queries ask for is counted once in a block of documents
    met = meet(asked.withColumnRenamed("times", "weight")).select("grp", "block", "tokens", "words", "lengths").mapInArrow(frequencies, f"grp {grp}, block int, token string, n long")
    frequency = met.groupBy("grp", "block", "token").agg(F.max("n").alias("n")).groupBy("grp", "token").agg(F.sum("n").alias("df"))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    terms = asked.join(frequency, ["grp", "token"]).join(size, "grp").select("grp", "query_id", "token", (F.col("times") * idf).alias("weight"))
    near = meet(materialise(terms, "weights")).select("query_ids", "sizes", "tokens", "weights", "doc_ids", "lengths", "words", "mean_length").mapInArrow(best, f"query_id {kinds[0]}, doc_id {kinds[1]}, score double")
    return ranked(near.withColumn("score", F.round("score", DIGITS)).where("score > 0"), k)


def _blocks(vectors: DataFrame, ident: str) -> DataFrame:
    """Rows (grp, ident, vec, own) packed into blocks of about ``BLOCK`` vectors of one group; ``own`` as hashes."""
    own = F.xxhash64("own") if "own" in vectors.columns else F.lit(None).cast("long")
    vectors = vectors.select("grp", ident, "vec", own.alias("own"))
    many = vectors.groupBy("grp").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    placed = vectors.join(many, "grp").withColumn("block", F.pmod(F.xxhash64(ident), F.col("blocks")))
    packed = placed.groupBy("grp", "block").agg(F.collect_list(F.struct(ident, "vec", "own")).alias("v"))
    return packed.select("grp", "block", F.col("v")[ident].alias(f"{ident}s"), F.flatten(F.col("v")["vec"]).alias(f"{ident}_flat"), F.col("v")["own"].alias(f"{ident}_own"))


def dense(queries: DataFrame, documents: DataFrame, k: int = OVERSAMPLE, floor: float = DENSE_FLOOR) -> DataFrame:
    """(query_id, doc_id, score, rank): of every query (query_id, grp, vec) the ``k`` documents (grp, doc_id, vec) of greatest
    cosine, at least ``floor``; ties in the order of ids.

    Exact: blocks of queries meet blocks of documents of their group, each pair of blocks is one matrix product that keeps k
    documents a query, and the best of these are ranked. Null and zero vectors match nothing; vectors of different lengths
    within one group are an error before anything is written. Where both sides have a column ``own``, a query does not match
    documents of an equal one.
    """
    apart = "own" in queries.columns and "own" in documents.columns
    kinds = [queries.schema["query_id"].dataType.simpleString(), documents.schema["doc_id"].dataType.simpleString()]
    usable = lambda df: df.where(F.exists("vec", lambda x: x != 0) & ~F.exists("vec", lambda x: x.isNull()))
    asked = _blocks(usable(queries), "query_id")
    # a block of documents goes to every block of queries of its group, so a large group is many keys
    to = F.explode(F.sequence(F.lit(0), F.col("last"))).alias("block")
    last = asked.groupBy("grp").agg(F.max("block").cast("int").alias("last"))
    searched = _blocks(usable(documents), "doc_id").drop("block").join(last, "grp").select("grp", "doc_ids", "doc_id_flat", "doc_id_own", to)
    pairs = asked.withColumn("block", F.col("block").cast("int")).join(searched, ["grp", "block"])

    def unit(flat: pa.Array, n: int) -> np.ndarray:
        m = np.asarray(flat, dtype=np.float64).reshape(n, -1)
        return m / np.linalg.norm(m, axis=1, keepdims=True)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                q_ids, q_flat, d_ids, d_flat = (batch.column(c)[row].values for c in ("query_ids", "query_id_flat", "doc_ids", "doc_id_flat"))
                scores = np.round(unit(q_flat, len(q_ids)) @ unit(d_flat, len(d_ids)).T, DIGITS)
                if apart:
                    q_own, d_own = (np.asarray(batch.column(c)[row].values) for c in ("query_id_own", "doc_id_own"))
                    scores[q_own[:, None] == d_own[None, :]] = -2.0  # below every cosine
                near = np.argpartition(-scores, min(k, scores.shape[1]) - 1, axis=1)[:, : min(k, scores.shape[1])]
                edge = np.take_along_axis(scores, near, 1).min(axis=1)  # all that tie with the last one stay in
                q, d = np.nonzero((scores >= edge[:, None]) & (scores >= floor))
                yield pa.RecordBatch.from_arrays([q_ids.take(pa.array(q)), d_ids.take(pa.array(d)), pa.array(scores[q, d])], names=["query_id", "doc_id", "score"])

    near = pairs.select("query_ids", "query_id_flat", "doc_ids", "doc_id_flat", "query_id_own", "doc_id_own").mapInArrow(best, f"query_id {kinds[0]}, doc_id {kinds[1]}, score double")
    return ranked(near, k)


def ranked(scored: DataFrame, k: int | None = None, tie: Sequence[Column | str] = ("doc_id",)) -> DataFrame:
    """Scores with their ``rank`` from 1 within the query, greatest first; the first ``k``."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), *tie)
    out = scored.withColumn("rank", F.row_number().over(order))
    return out.where(F.col("rank") <= k) if k else out


def oversampled(limit: int, n_nodes: int, oversample: int = OVERSAMPLE) -> int:
    return max(1, min(max(limit, oversample), n_nodes))


def rrf(lists: Sequence[DataFrame], k: int = RRF_K, floor: float = RRF_FLOOR) -> DataFrame:
    """(query_id, doc_id, score): sums of 1 / (k + rank) over the ranked lists; fused scores below ``floor`` are dropped. The
    order of the lists does not matter."""
    both = lists[0].select("query_id", "doc_id", "rank")
    for other in lists[1:]:
        both = both.unionByName(other.select("query_id", "doc_id", "rank"))
    fused = both.groupBy("query_id", "doc_id").agg(F.round(F.sum(1 / (F.lit(k) + F.col("rank"))), 12).alias("score"))
    return fused.where(F.col("score") >= floor)


def best_nodes(nodes: DataFrame) -> DataFrame:
    """(query_id, ref_doc, score, nodes) of nodes (query_id, ref_doc, node_id, score): the greatest score of each document, and
    its nodes by falling score. Blank documents are skipped, scores of 0 and below dropped."""
    kept = nodes.where((F.btrim("ref_doc") != "") & (F.col("score") > 0))
    grouped = kept.groupBy("query_id", "ref_doc").agg(F.max("score").alias("score"), F.collect_list(F.struct((-F.col("score")).alias("s"), "node_id")).alias("l"))
    return grouped.select("query_id", "ref_doc", "score", F.array_sort("l")["node_id"].alias("nodes"))


@lru_cache(maxsize=200_000)
def _bucket(token: str, dim: int) -> tuple[int, float]:
    digest = hashlib.md5(token.encode()).hexdigest()  # noqa: S324
    return int(digest[:4], 16) % dim, 1.0 if int(digest[4], 16) < 8 else -1.0


def hashed_vectors(df: DataFrame, dim: int = 64) -> DataFrame:
    """``df`` with ``vec`` in place of ``text``: an offline embedding, in which tokens are hashed (MD5) into ``dim`` signed
    buckets; the zero vector for a text without tokens. A stand-in for a model that fills the same column batch by batch."""
    tokenised = df.withColumn("text", text.tokens(F.col("text")))

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((batch.num_rows, dim))
            at = batch.schema.get_field_index("text")
            for i, words in enumerate(batch.column(at).to_pylist()):
                for w in words:
                    bucket, sign = _bucket(w, dim)
                    out[i, bucket] += sign
            vec = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, dim, dtype=np.int32)), pa.array(out.ravel()))
            rest = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), vec], names=[*rest, "vec"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokenised.schema if f.name != "text")
    return tokenised.mapInArrow(embed, f"{kinds}, vec array<double>")


def projections(memories: DataFrame, entities: DataFrame) -> DataFrame:
    """(memory_space, ref_doc, kind, key, text, updated_at): what an index holds of entities and memories. A memory whose entity
    is gone is indexed without identity."""
    identity = entities.select("memory_space", "entity_key", text.identity_text(F.col("identity_profile")).alias("identity"), F.col("updated_at").alias("e_at"))
    own = identity.select("memory_space", text.ref_doc("entity", F.col("memory_space"), F.col("entity_key")).alias("ref_doc"), F.lit("entity").alias("kind"), F.col("entity_key").alias("key"), F.col("identity").alias("text"), F.col("e_at").alias("updated_at"))
    whole = text.memory_text(F.col("identity"), F.col("title"), F.col("summary"), F.col("content"))
    of_memories = memories.join(identity.drop("e_at"), ["memory_space", "entity_key"], "left").select(
        "memory_space", text.ref_doc("memory", F.col("memory_space"), F.col("memory_id")).alias("ref_doc"), F.lit("memory").alias("kind"), F.col("memory_id").alias("key"), whole.alias("text"), "updated_at"
    )
    return own.unionByName(of_memories)


def searched_memories(memories: DataFrame, entities: DataFrame) -> DataFrame:
    """(grp, doc_id, text): the index texts of the memories that are not archived, with the identity of their entity."""
    index = projections(memories.where("status IS NULL OR status <> 'archived'"), entities).where("kind = 'memory'")
    return index.select(F.col("memory_space").alias("grp"), F.col("key").alias("doc_id"), "text")


def lexical(queries: DataFrame, documents: DataFrame, limit: int, floor: float = LEXICAL_FLOOR) -> DataFrame:
    """(query_id, doc_id, score, rank): text search alone, with its own least score; the best max(``limit``, oversample) of each query,
    which a smaller candidate set clamps by itself."""
    return ranked(bm25(queries, documents).where(F.col("score") >= floor), oversampled(limit, MANY))


def rebuilt(memories: DataFrame, entities: DataFrame) -> DataFrame:
    """The whole index anew: the documents of all entities and memories that have a text (see ``projections``)."""
    return projections(memories, entities).where(F.btrim("text") != "")


def reindexed(index: DataFrame, entities: DataFrame, memories: DataFrame, touched: DataFrame, named: DataFrame, limit: int = REINDEXED) -> DataFrame:
    """The index after the ``touched`` entities (memory_space, entity_key), with up to ``limit`` of their newest memories each, and the
    ``named`` memories (memory_space, memory_id) were projected anew."""
    t, n = touched.select("memory_space", "entity_key").distinct(), named.select("memory_space", "memory_id").distinct()
    own = lookup.recent_per_key(memories.join(t, ["memory_space", "entity_key"], "left_semi"), ["memory_space", "entity_key"], "updated_at", "memory_id", limit).drop("rank")
    chosen = own.select(*memories.columns).unionByName(memories.join(n, ["memory_space", "memory_id"], "left_semi").select(*memories.columns)).dropDuplicates(["memory_space", "memory_id"])
    of_memories = projections(chosen, entities).where("kind = 'memory'")
    of_entities = projections(chosen.limit(0), entities.join(t, ["memory_space", "entity_key"], "left_semi"))
    return upsert(index, of_entities.unionByName(of_memories))


def stale_documents(expected: DataFrame, indexed: DataFrame) -> DataFrame:
    """Documents of ``expected`` (ref_doc, updated_at) that the index lacks or holds with another time. Times are compared as
    the doubles they are; two null times are equal."""
    held = indexed.select("ref_doc", F.col("updated_at").alias("held"), F.lit(True).alias("there"))
    joined = expected.join(held, "ref_doc", "left")
    return joined.where(F.col("there").isNull() | ~F.col("updated_at").eqNullSafe(F.col("held"))).drop("held", "there")


def upsert(index: DataFrame, new: DataFrame) -> DataFrame:
    """The index after ``new`` documents replaced those of the same ref_doc; new ones with a blank text only remove."""
    kept = index.join(new.select("ref_doc").distinct(), "ref_doc", "left_anti")
    return kept.select(*index.columns).unionByName(new.where(F.btrim("text") != "").select(*index.columns))


def entity_candidates(fused: DataFrame, entities: DataFrame, limit: int = 10) -> DataFrame:
    """(query_id, entity_key, score, rank): fused scores of entity documents joined with the entities that exist; greatest score
    first, then the newest, then by key."""
    hit = fused.where("score > 0").join(entities.select("memory_space", "entity_key", "updated_at"), ["memory_space", "entity_key"])
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc_nulls_last("updated_at"), "entity_key")
    return hit.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("query_id", "entity_key", "score", "rank")


def memory_candidates(fused: DataFrame, memories: DataFrame, limit: int = 10) -> DataFrame:
    """(query_id, memory_id, score, rank): by score, active ones first, then salience, confidence and time, then by id."""
    hit = fused.where("score > 0").join(memories.select("memory_space", "memory_id", "status", "salience", "confidence", "updated_at"), ["memory_space", "memory_id"])
    order = Window.partitionBy("query_id").orderBy(
        F.desc("score"), F.desc(F.col("status") == "active"), F.desc_nulls_last("salience"), F.desc_nulls_last("confidence"), F.desc_nulls_last("updated_at"), "memory_id"
    )
    return hit.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("query_id", "memory_id", "score", "rank")


def intended_seeds(candidates: DataFrame) -> DataFrame:
    """Candidates (query_id, time_intent, status): for a current or latest intent only the active ones, if any is active."""
    some = F.max(F.when(F.col("status") == "active", 1).otherwise(0)).over(Window.partitionBy("query_id"))
    drop = F.col("time_intent").isin("current", "latest") & (F.col("__some") == 1) & (F.col("status") != "active")
    return candidates.withColumn("__some", some).where(~F.coalesce(drop, F.lit(False))).drop("__some")
