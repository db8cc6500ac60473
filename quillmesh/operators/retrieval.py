"""Hybrid retrieval: vectors, BM25 over postings, and rank fusion.

Postings are the only large intermediate: one row per document and distinct
term. Questions come as a set (query_id, ...), each is answered against all
documents, and only postings of their own terms are grouped. Statistics are one
row, or one per term of a question.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions.scalar import expand_codes, terms
from quillmesh.functions.stemming import lexemes, lexicon
from quillmesh.functions.vectors import dot, norm
from quillmesh.operators import nearest
from quillmesh.operators.graph import settled

K1, B, RRF, DEPTH = 1.2, 0.75, 60, 40
MODES = ("hybrid", "vector", "keyword")


def spread(df: DataFrame) -> DataFrame:
    """A table that comes in fewer pieces than there are cores, dealt over all cores;
    a larger one as it is. What is dealt is thus a few blocks at most."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _distinct(found: Column, stems: bool) -> Column:
    return F.array_distinct(F.array_compact(found) if stems else found)  # stop words are null


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope_col: str | None = None, stop: Sequence[str] = (), codes: bool = False, stems: bool = False, only: DataFrame | None = None, counted: bool = False) -> DataFrame:
    """(id, [scope,] term, tf, dl): dl is the number of *distinct* terms.

    ``only`` (a ``term`` column, a question set's own) keeps the postings of those terms alone:
    others go before anything is grouped or shuffled. ``stems`` takes lexemes for terms.
    ``counted`` gives every document with a text a row of the empty term too, which no text holds.
    """
    found = lexemes(terms(F.col(text_col))) if stems else terms(F.col(text_col))
    if codes:
        found = F.concat(found, expand_codes(F.col(text_col)))
    if stop:
        found = F.filter(found, lambda t: ~t.isin(*stop))
    keys = [id_col, *([scope_col] if scope_col else [])]
    base = spread(docs.filter(F.col(text_col).isNotNull()).select(*keys, text_col)).select(*keys, found.alias("_terms")).withColumn("dl", F.size(_distinct(F.col("_terms"), stems)).cast("long"))
    # outer: for a plain explode Spark infers that arrays are not empty, and asks so beneath, tokenising two more times
    held = F.array_append("_terms", F.lit("")) if counted else F.col("_terms")
    each = base.select(*keys, "dl", F.explode_outer(held).alias("term")).filter("term is not null")
    if only is not None:
        wanted = only.select("term").union(only.sparkSession.range(1).select(F.lit(""))) if counted else only.select("term")
        each = each.join(F.broadcast(wanted.distinct()), "term", "left_semi")  # whatever its plan seems to hold
    return each.groupBy(*keys, "dl", "term").agg(F.count("*").alias("tf")).select(*keys, "term", "tf", "dl")


def lexeme_postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", only: DataFrame | None = None) -> DataFrame:
    """(id, term, tf, dl) of English lexemes: stop words are dropped and words of one
    stem are one term; dl is the number of distinct lexemes. Texts of stop words
    alone have no row. Words are stemmed where their text is, so only postings that
    are asked for are shuffled."""
    return postings(docs, id_col, text_col, stems=True, only=only)


def lexeme_stats(posts: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """N and the average number of distinct lexemes over all documents with a text,
    from postings that are whole; :func:`corpus_stats` needs none."""
    sums = posts.groupBy(id_col).agg(F.first("dl").alias("dl")).agg(F.sum("dl").alias("_all"))
    n = docs.agg(F.count(text_col).alias("n_docs"))
    return n.crossJoin(sums).select("n_docs", F.try_divide(F.coalesce("_all", F.lit(0)).cast("double"), F.col("n_docs").cast("double")).alias("avg_dl"))  # one row each


def lexeme_terms(queries: DataFrame, text_col: str = "text") -> DataFrame:
    """(query_id, term): the distinct lexemes of each question."""
    asked = queries.select("query_id", F.explode(F.array_distinct(terms(F.col(text_col)))).alias("term"))
    return asked.join(lexicon(asked).filter("lexeme is not null"), "term").select("query_id", F.col("lexeme").alias("term")).distinct()


def store_postings(docs: DataFrame, path: str, **options) -> DataFrame:
    """Postings written once and sorted by term, so that a question reads the row
    groups of its own terms."""
    postings(docs, **options).repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(path)
    return docs.sparkSession.read.parquet(path)


def corpus_stats(docs: DataFrame, text_col: str = "text", by: Sequence[str] = (), stems: bool = False) -> DataFrame:
    """N and the average number of distinct terms, or of lexemes, over all or by scope."""
    found = terms(F.col(text_col))
    dl = F.size(_distinct(lexemes(found) if stems else found, stems))
    texts = spread(docs.filter(F.col(text_col).isNotNull()).select(*by, text_col))
    return texts.select(*by, dl.alias("_dl")).groupBy(*by).agg(F.count("*").alias("n_docs"), F.avg("_dl").alias("avg_dl"))


def doc_freq(posts: DataFrame) -> DataFrame:
    return posts.groupBy("term").agg(F.count("*").alias("df"))


def scoped(docs: DataFrame, column: str, scope: Sequence[str] | None) -> DataFrame:
    """An empty scope means everything."""
    return docs.filter(F.col(column).isin(*scope)) if scope else docs


def _first(hits: DataFrame, id_col: str, limit: int | None) -> DataFrame:
    """The best of each question; each task keeps its own best before they meet."""
    if not limit:
        return hits
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), id_col)
    return hits.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= limit).drop("_k")


def bm25(posts: DataFrame, query_terms: DataFrame, stats: DataFrame, id_col: str = "doc_id", limit: int | None = DEPTH) -> DataFrame:
    """(query_id, id, score) of documents with any term of a question.

    ``query_terms`` has rows (query_id, term); ``stats`` is one row. The postings of
    the questions' terms are written once: frequencies and scores both come from them.
    They are scored dealt by document, so that only a task's own best are shuffled
    and not a row for every term that a question and a document share.
    """
    asked = query_terms.select("query_id", "term").distinct()
    hit = settled(posts.join(asked.select("term").distinct(), "term", "left_semi").select(id_col, "term", "tf", "dl"), "hits")
    return _scored(hit, asked, stats, id_col, limit)


def bm25_of_texts(docs: DataFrame, query_terms: DataFrame, id_col: str = "doc_id", text_col: str = "text", stems: bool = False, limit: int | None = DEPTH) -> DataFrame:
    """:func:`bm25` over all documents with a text, whose postings and statistics come from one reading."""
    asked = query_terms.select("query_id", "term").distinct()
    held = settled(postings(docs, id_col, text_col, stems=stems, only=asked, counted=True), "hits")
    # documents of one id and as many terms are one row
    stats = held.filter("term = ''").agg(F.sum("tf").alias("n_docs"), (F.sum(F.col("dl") * F.col("tf")) / F.sum("tf")).alias("avg_dl"))
    return _scored(held.filter("term <> ''"), asked, stats, id_col, limit)


def _scored(hit: DataFrame, asked: DataFrame, stats: DataFrame, id_col: str, limit: int | None) -> DataFrame:
    df = hit.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = asked.join(df, "term").crossJoin(F.broadcast(stats.select("n_docs", "avg_dl"))).select("query_id", "term", "avg_dl", idf.alias("idf"))
    gain = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avg_dl")))
    scored = hit.repartition(id_col).join(F.broadcast(weighted), "term").groupBy("query_id", id_col).agg(F.sum(F.col("idf") * gain).alias("score"))
    return _first(scored.select("query_id", id_col, F.round("score", 6).alias("score")), id_col, limit)


def by_cosine(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", limit: int | None = DEPTH, per_block: int = 4096) -> DataFrame:
    """(query_id, id, score) by cosine similarity to each row of ``queries``
    (query_id, q): a stated query set against all vectors, met block by block.
    The number of blocks follows the number of vectors; each block passes on its
    own best. Without a limit every pair is a row."""
    if limit:
        cells = nearest.first_of_cells(vectors.select(id_col, F.col(vector_col).alias("v")), queries.select("query_id", F.col("q").alias("v")), id_col, limit, nearest.cosines, per_block)
        return _first(cells, id_col, limit)
    blocks = max(8, -(-vectors.count() // per_block))
    held = vectors.withColumn("_block", F.pmod(F.xxhash64(id_col), F.lit(blocks)).cast("int")).withColumn("_n", norm(F.col(vector_col)))
    asked = queries.select("query_id", "q", norm(F.col("q")).alias("_qn")).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    score = F.round(F.try_divide(dot(F.col(vector_col), F.col("q")), F.col("_n") * F.col("_qn")), 6)
    return held.join(asked, "_block").select("query_id", id_col, score.alias("score")).filter("score is not null")


def ranks(hits: DataFrame, id_col: str) -> DataFrame:
    """Positions from 1 in the bounded list of each question."""
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), id_col)))


def fuse(vector: DataFrame, keyword: DataFrame, k: int = 8, id_col: str = "doc_id") -> DataFrame:
    """Reciprocal-rank fusion per question; either list may lack a document. Both
    hold at most ``DEPTH`` rows a question."""
    v = ranks(vector, id_col).select("query_id", id_col, F.col("rank").alias("vector_rank"), F.col("score").alias("similarity"))
    w = ranks(keyword, id_col).select("query_id", id_col, F.col("rank").alias("keyword_rank"), F.col("score").alias("bm25"))
    both = v.join(w, ["query_id", id_col], "full_outer")
    part = lambda c: F.coalesce(1.0 / (RRF + F.col(c)), F.lit(0.0))
    scored = both.withColumn("score", F.round(part("vector_rank") + part("keyword_rank"), 9)).withColumn("_best", F.least("vector_rank", "keyword_rank"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "_best", id_col)
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).drop("_best")


def search(docs: DataFrame, vectors: DataFrame, text: str, vector: DataFrame | None, k: int = 8, mode: str = "hybrid", scope_col: str = "lang", scope: Sequence[str] | None = None) -> DataFrame:
    """Ranked documents with both ranks and both raw scores."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    spark = docs.sparkSession
    inside = scoped(docs, scope_col, scope)
    asked = spark.createDataFrame([(0, text)], "query_id long, text string").select("query_id", F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
    empty = spark.createDataFrame([], "query_id long, doc_id long, score double")
    word = bm25(postings(inside, only=asked), asked, corpus_stats(inside)) if mode != "vector" else empty
    near = empty
    if mode != "keyword" and vector is not None:
        held = vectors.withColumnRenamed("vec_id", "doc_id").join(inside.select("doc_id"), "doc_id", "left_semi")
        near = by_cosine(held, vector.select(F.lit(0).cast("long").alias("query_id"), "q"), "doc_id")
    return fuse(near, word, k).drop("query_id").join(inside, "doc_id")


def similar_search(posts: DataFrame, stats: DataFrame, terms_df: DataFrame, allowed: DataFrame, k: int) -> DataFrame:
    """Role-filtered search: what the session may see is kept before ranking."""
    return bm25(posts.join(allowed, "doc_id", "left_semi"), terms_df, stats, limit=k)


def reciprocal_ranks(ranked: DataFrame, relevant: Column, query_col: str = "query_id", cut: int = 8) -> DataFrame:
    """hit@cut, first-rank share and mean reciprocal rank over queries."""
    first = ranked.groupBy(query_col).agg(F.min(F.when(relevant, F.col("rank"))).alias("first"))
    return first.agg(
        F.count("*").alias("n_queries"),
        F.count_if(F.col("first") <= cut).alias("hits"),
        F.count_if(F.col("first") == 1).alias("first_rank"),
        F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 6).alias("mrr"),
    )


def recall_at(exact: DataFrame, found: DataFrame, query_col: str = "query_id", id_col: str = "vec_id") -> DataFrame:
    """Share of the exact neighbours that the other list holds."""
    both = exact.select(query_col, id_col).join(found.select(query_col, id_col, F.lit(1).alias("_hit")), [query_col, id_col], "left")
    return both.agg(F.count("*").alias("wanted"), F.count("_hit").alias("found"), F.round(F.try_divide(F.count("_hit").cast("double"), F.count("*").cast("double")), 6).alias("recall"))


def display_terms(typed: Column, lexemes: Column, derived: Column) -> Column:
    """Codes as typed, then the lexemes that are not mere forms of them."""
    return F.array_union(typed, F.array_except(lexemes, derived))
