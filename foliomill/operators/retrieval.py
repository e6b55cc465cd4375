"""Hybrid retrieval: exact cosine search, lexical ranking, reciprocal rank fusion, reading positions."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.models import Embed, hash_embedding
from ..functions.text import query_tokens

CANDIDATES, K, FUSION = 20, 8, 60
BLOCK_BYTES = 16 << 20
TILE = 256
PI2_6 = 1.64493406685


def cosine_distance(a: Column, b: Column) -> Column:
    """In double. Null, which is never near, where a vector is null, zero or not finite, or where the two differ in length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    far = F.lit(1.0) - F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
    return F.when((F.size(a) == F.size(b)) & ~F.isnan(far), far)


def within(rows: DataFrame, ceilings: dict[str, int | None], book: str = "book_id", chapter: str = "chapter_num") -> DataFrame:
    """Rows at or below each book's ceiling; books without one are left out. A literal predicate, which scans push down."""
    parts = [(F.col(book) == b) & (F.col(chapter) <= n) for b, n in ceilings.items() if n is not None]
    condition = F.lit(False)
    for p in parts:
        condition = condition | p
    return rows.filter(condition)


def ranked(rows: DataFrame, by: list[Column], n: int) -> DataFrame:
    """The first n rows with their rank from 1; only those n meet in one task."""
    return rows.orderBy(*by).limit(n).withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*by)).cast("long"))


def dense(rows: DataFrame, query: list[float], n: int = CANDIDATES, id_: str = "chunk_id") -> DataFrame:
    """(id, distance, rank) of the nearest rows by their embedding; rows without a distance (see cosine_distance) aren't near."""
    q = F.array(*[F.lit(float(x)) for x in query]).cast("array<double>")
    near = rows.filter("embedding is not null").select(id_, (F.round(cosine_distance(F.col("embedding"), q), 6) + F.lit(0.0)).alias("distance"))
    return ranked(near.filter("distance is not null"), [F.col("distance"), F.col(id_)], n)


def _is(token: str):
    return lambda w: w == token


def text_rank(tokens: Column, query: list[str]) -> Column:
    """Sum over the query's lexemes of 0.1 * sum(1 / j^2), scaled by their number; tokens are the text's words."""
    total = F.lit(0.0)
    for t in query:
        n = F.size(F.filter(tokens, _is(t)))
        total = total + F.aggregate(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda s, j: s + F.lit(0.1) / (j * j))
    return total / F.lit(PI2_6) / F.lit(float(max(len(query), 1)))


def sparse(rows: DataFrame, query: list[str], n: int = CANDIDATES, id_: str = "chunk_id") -> DataFrame:
    """(id, score, rank) of the rows with a lexeme of the query; empty for an empty query."""
    if not query:
        return rows.select(id_, F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("rank")).filter(F.lit(False))
    scored = _tokenised(rows, id_).select(id_, F.round(text_rank(F.col("tokens"), query), 9).alias("score"))
    return ranked(scored, [F.desc("score"), F.col(id_)], n).filter("score > 0")  # after the limit: a filter below it would tokenise texts twice


def _tokenised(rows: DataFrame, id_: str) -> DataFrame:
    return rows.select(id_, F.regexp_extract_all(F.lower("content"), F.lit("[a-z0-9]+"), F.lit(0)).alias("tokens"))


def fuse(branches: list[DataFrame], k: int = K, id_: str = "chunk_id") -> DataFrame:
    """(id, score): the sum of 1 / (60 + rank) over the branches; ties go to the smaller id."""
    both = branches[0].select(id_, "rank")
    for b in branches[1:]:
        both = both.unionByName(b.select(id_, "rank"))
    fused = both.groupBy(id_).agg(F.round(F.sum(F.lit(1.0) / (F.lit(FUSION) + F.col("rank"))), 9).alias("score"))
    return fused.orderBy(F.desc("score"), id_).limit(k)


def dense_baseline(rows: DataFrame, query: list[float], k: int = K, id_: str = "chunk_id") -> DataFrame:
    """(id, score, rank) by cosine similarity alone."""
    return dense(rows, query, k, id_).select(id_, F.round(1 - F.col("distance"), 6).alias("score"), "rank")


def hybrid(chunks: DataFrame, query: list[float], question: str, ceilings: dict[str, int | None] | None, k: int = K) -> DataFrame:
    """Fused search; texts are joined to the k survivors only."""
    rows = chunks if ceilings is None else within(chunks, ceilings)
    tokens = chunks.sparkSession.range(1).select(query_tokens(F.lit(question)).alias("t")).first()["t"]
    top = fuse([dense(rows, query), sparse(rows, tokens)], k)
    return rows.join(F.broadcast(top), "chunk_id")


def search_book(chunks: DataFrame, question: str, books: list[str], position: dict[str, int | None], limit: int = K, model: Embed = hash_embedding) -> DataFrame:
    """Embed a question and search the books up to the reading position; best first."""
    if len(question) < 3 or not 1 <= limit <= 20:
        raise ValueError("a question has 3 characters or more, a limit is 1 to 20")
    found = hybrid(chunks, model([question])[0], question, {b: position.get(b) for b in books}, limit)
    return found.orderBy(F.desc("score"), "chunk_id")


def units(vectors: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors of that size that have a direction, and these as rows of length 1."""
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    at = np.flatnonzero(lengths == size)
    flat = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), size)
    norm = np.linalg.norm(flat, axis=1)
    good = np.isfinite(norm) & (norm > 0)
    return at[good], flat[good] / norm[good, None]


def nearest(keys: np.ndarray, rows: np.ndarray, ids: np.ndarray, queries: np.ndarray, n: int) -> Iterator[pa.RecordBatch]:
    """(query_id, chunk_id, distance): the n nearest of these rows to each of these queries, and what ties with the last of them.

    Taken in tiles of TILE queries and rows, so that the products of a task stay within a few MB.
    """
    for lo in range(0, len(queries), TILE):
        q, own = queries[lo : lo + TILE], []
        for at in range(0, len(rows), TILE * 8):
            far = np.round(1 - q @ rows[at : at + TILE * 8].T, 6) + 0.0
            m = min(n, far.shape[1])
            x, y = np.nonzero(far <= np.partition(far, m - 1, axis=1)[:, m - 1 : m])
            own.append((ids[lo + x], keys[at + y], far[x, y]))
        if own:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*own, strict=True)], ["query_id", "chunk_id", "distance"])


def _search(shared, n: int):
    def run(batches):
        ids, queries = shared.value
        for b in batches:
            at, rows = units(b.column(1), queries.shape[1])
            if len(at):
                yield from nearest(b.column(0).to_numpy(zero_copy_only=False)[at], rows, ids, queries, n)

    return run


def checked(queries: DataFrame) -> tuple[int, int]:
    """How many queries (query_id, query) there are, and their size. Ids that repeat or are null, or several sizes, raise."""
    r = queries.agg(F.count("*").alias("n"), F.count_distinct("query_id").alias("ids"), F.min(F.size("query")).alias("least"), F.max(F.size("query")).alias("most")).first()
    if r["n"] != r["ids"]:
        raise ValueError("each query needs an id of its own")
    if r["n"] and r["least"] != r["most"]:
        raise ValueError(f"queries have {r['least']} to {r['most']} dimensions")
    return r["n"], r["most"] or 0


def query_blocks(queries: DataFrame, block: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, unit vectors) of the queries in blocks of about BLOCK_BYTES; null and zero queries are near to nothing."""
    n, size = checked(queries.filter("query is not null"))
    blocks = max(1, -(-n // (block or max(1, BLOCK_BYTES // (8 * max(size, 1))))))
    for i in range(blocks if size > 0 else 0):
        own = queries.filter("query is not null").filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).orderBy("query_id").select(F.col("query_id").cast("long"), F.col("query").cast("array<double>")).toArrow()
        at, vectors = units(own.column(1).combine_chunks(), size)
        if len(at):
            yield own.column(0).to_numpy()[at], vectors


def first_n(found: list[DataFrame], n: int, like: DataFrame) -> DataFrame:
    """(query_id, chunk_id, distance, rank): the n nearest of each query."""
    if not found:
        return like.sparkSession.createDataFrame([], "query_id long, chunk_id long, distance double, rank long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "chunk_id"))
    return functools.reduce(DataFrame.unionByName, found).withColumn("rank", rank).filter(F.col("rank") <= n).withColumn("rank", F.col("rank").cast("long"))


def batched_dense(rows: DataFrame, queries: DataFrame, n: int = CANDIDATES, block: int | None = None) -> DataFrame:
    """(query_id, chunk_id, distance, rank) of a stated set of queries (query_id, query) against all rows.

    The set is broadcast in blocks of a bounded size: each is one pass over the rows as matrix products, of which a task keeps the
    nearest of each Arrow batch. Vectors without a direction, or of another size, are near to nothing, as in ``dense``.
    """
    sc, found = rows.sparkSession.sparkContext, []
    for own in query_blocks(queries, block):
        part = rows.filter("embedding is not null").select(F.col("chunk_id").cast("long"), F.col("embedding").cast("array<double>"))
        found.append(part.mapInArrow(_search(sc.broadcast(own), n), "query_id long, chunk_id long, distance double"))
    return first_n(found, n, rows)


def batched_sparse(rows: DataFrame, questions: dict[str, list[str]], n: int = CANDIDATES) -> DataFrame:
    """(question, chunk_id, score, rank) of a small set of tokenised questions, in one pass over the texts; each task keeps n of each question before the shuffle."""
    asked = {name: tokens for name, tokens in questions.items() if tokens}
    if not asked:
        return rows.select(F.lit("").alias("question"), "chunk_id", F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("rank")).limit(0)
    scores = F.array(*[F.struct(F.lit(name).alias("question"), F.round(text_rank(F.col("tokens"), tokens), 9).alias("score")) for name, tokens in asked.items()])
    found = _tokenised(rows, "chunk_id").select("chunk_id", F.explode(scores).alias("x")).select("chunk_id", "x.*").filter("score > 0")
    rank = F.row_number().over(Window.partitionBy("question").orderBy(F.desc("score"), "chunk_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= n).select("question", "chunk_id", "score", F.col("rank").cast("long").alias("rank"))


def batched_hybrid(rows: DataFrame, queries: DataFrame, questions: dict[str, list[str]], k: int = K) -> DataFrame:
    """(query_id, chunk_id, score, rank): fused search for many queries (query_id, query, question), questions by name."""
    lists = batched_dense(rows, queries).select("query_id", "chunk_id", "rank")
    words = queries.select("query_id", "question").join(batched_sparse(rows, questions), "question").select("query_id", "chunk_id", "rank")
    score = F.round(F.sum(F.lit(1.0) / (F.lit(FUSION) + F.col("rank"))), 9).alias("score")
    fused = lists.unionByName(words).groupBy("query_id", "chunk_id").agg(score)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    return fused.withColumn("rank", rank).filter(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("long"))


def named(entities: DataFrame, name: str) -> DataFrame:
    """Entities whose name or alias equals the name without case, at most five by id."""
    needle = F.lower(F.lit(name))
    return entities.filter((F.lower("canonical_name") == needle) | F.exists("aliases", lambda a: F.lower(a) == needle)).orderBy("entity_id").limit(5)


def lookup_entity(entities: DataFrame, mentions: DataFrame, name: str, ceilings: dict[str, int | None], limit: int = 200) -> DataFrame:
    """Mentions of the first entity of that name, below the ceilings."""
    first = named(entities, name).orderBy("entity_id").limit(1)
    return within(mentions, {b: n or 0 for b, n in ceilings.items()}).join(F.broadcast(first), "entity_id").orderBy("book_id", "chapter_num", "mention_id").limit(limit)


def lookup_result(entities: DataFrame, mentions: DataFrame, name: str, ceilings: dict[str, int | None], limit: int = 200) -> DataFrame:
    """One row: the entity (null if unknown) and its mentions, at most limit, in order."""
    first = named(entities, name).orderBy("entity_id").limit(1).select(F.struct("*").alias("entity"))
    found = lookup_entity(entities, mentions, name, ceilings, limit).select(*mentions.columns)
    listed = found.agg(F.array_sort(F.collect_list(F.struct("book_id", "chapter_num", "mention_id"))).alias("mentions"))
    return listed.join(F.broadcast(first), F.lit(True), "left").select("entity", "mentions")


def point_lookup(chapters: DataFrame, book: str, chapter: int) -> DataFrame:
    """The chapter of that book and number, by the smallest id if there are several."""
    return chapters.filter((F.col("book_id") == book) & (F.col("chapter_num") == chapter)).orderBy("chapter_id").limit(1)


def book_scan(chapters: DataFrame, book: str) -> DataFrame:
    """A book's chapters in order."""
    return chapters.filter(F.col("book_id") == book).orderBy("chapter_num")


def aggregate_events(entities: DataFrame, events: DataFrame, name: str, event_type: str, ceilings: dict[str, int | None]) -> DataFrame:
    """Events of the first entity of that name; the type "any" takes all."""
    first = named(entities, name).orderBy("entity_id").limit(1)
    rows = within(events, {b: n or 0 for b, n in ceilings.items()})
    if event_type != "any":
        rows = rows.filter(F.col("event_type") == event_type)
    return rows.join(F.broadcast(first), "entity_id").orderBy("book_id", "chapter_num", "event_id")


def divergence(a: DataFrame, b: DataFrame, id_: str = "chunk_id") -> DataFrame:
    """Whether two ranked lists (bounded top-k) differ in order, both not empty."""
    listed = lambda d: d.agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", id_))), lambda x: x[id_]).alias("ids"))
    return listed(a).select(F.col("ids").alias("a")).crossJoin(listed(b).select(F.col("ids").alias("b"))).select(((F.size("a") > 0) & (F.size("b") > 0) & (F.col("a") != F.col("b"))).alias("diverges"))


def recall(retrieved: Column, expected: Column) -> Column:
    return F.when(F.size(expected) > 0, F.size(F.array_intersect(retrieved, expected)) / F.size(expected))


def expected_hits(retrieved: DataFrame, expected: DataFrame) -> DataFrame:
    """(query_id, hits): retrieved chunks (query_id, chapter_num) whose chapter is expected (query_id, chapter_num); queries without a hit have 0."""
    hit = expected.select("query_id", "chapter_num").distinct().withColumn("hit", F.lit(1))
    return retrieved.join(hit, ["query_id", "chapter_num"], "left").groupBy("query_id").agg(F.count("hit").alias("hits"))


def violations(retrieved: DataFrame, ceilings: dict[str, int | None]) -> DataFrame:
    """Retrieved rows beyond the reading position: over their book's ceiling, or of a book without one."""
    inside = F.lit(False)
    for b, n in ceilings.items():
        if n is not None:
            inside = inside | ((F.col("book_id") == b) & (F.col("chapter_num") <= n))
    return retrieved.filter(~F.coalesce(inside, F.lit(False)))
