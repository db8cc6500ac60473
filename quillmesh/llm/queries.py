"""One query per operator, over its whole table, and its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm._shared import table
from quillmesh.llm._tokens import default_vocabulary
from quillmesh.llm import token_files, toxicity
from quillmesh.llm.divergence import audit
from quillmesh.llm.html_extract import extract
from quillmesh.llm.jaccard_join import near_duplicates
from quillmesh.llm.lexical_search import search
from quillmesh.llm.mixing import mix_sources
from quillmesh.llm.packing import pack
from quillmesh.llm.secret_scan import secret_spans
from quillmesh.llm.suffix_dedup import repeated_spans
from quillmesh.llm.token_counts import token_counts
from quillmesh.llm.vectors import exact_top_k, nearest

#: Share of the true neighbours by which op7's trees choose how far to relax pruning.
RECALL = 0.95


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each document that a 100-byte string starting earlier repeats."""
    out = repeated_spans(table(spark, sf_dir, "documents"), length=100)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 largest integer inner products for every twentieth vector."""
    return exact_top_k(table(spark, sf_dir, "embeddings"), k=20, scale=64, query_filter="id % 20 = 0")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle count and near-duplicate component of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=5, percent=80)


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(table(spark, sf_dir, "pages"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document, with its source's size and target."""
    out = mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, unigram tokens and their log probability of every document."""
    return token_counts(table(spark, sf_dir, "documents"), default_vocabulary("piece_bpe_32k.model"))


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found in relaxed vantage-point trees for every twentieth vector."""
    return nearest(table(spark, sf_dir, "embeddings"), k=20, recall=RECALL, query_filter="id % 20 = 0")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: counts and digest of the base kinds, spans of all."""
    found = secret_spans(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    told = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), "base_sha256", told.alias("spans"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document in windows of 2048 tokens."""
    return pack(table(spark, sf_dir, "documents"), default_vocabulary("byte_bpe_50k.json"), window=2048, end_id=1)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned outside the held-out quarter."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, number and checksum of every document's ids, read back from token files."""
    return token_files.write(table(spark, sf_dir, "documents"), default_vocabulary("byte_bpe_50k.json"), end_id=2).documents()


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest-scoring of all documents for every benchmark item."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each source's words are from those of its language's other sources, and its 50 most typical terms."""
    return audit(table(spark, sf_dir, "documents"), min_docs=30, top=50)


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_exact_topk": op2_exact_topk,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_html_extract": op4_html_extract,
    "op5_mixing": op5_mixing,
    "op6_token_counts": op6_token_counts,
    "op7_nearest": op7_nearest,
    "op8_secret_scan": op8_secret_scan,
    "op9_packing": op9_packing,
    "op10_toxicity": op10_toxicity,
    "op11_token_files": op11_token_files,
    "op12_lexical_search": op12_lexical_search,
    "op13_source_divergence": op13_source_divergence,
}

_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WORDS = r"[^\x20\x09-\x0D]+"

ORACLE_SQL: dict[str, str] = {
    "op2_exact_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: floor(64 * x)) AS v FROM embeddings
                   WHERE embedding IS NOT NULL AND vec_id IS NOT NULL),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
              FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op3_jaccard_join": f"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS}') AS w FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
        t AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS common FROM t a JOIN t b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM p WHERE 100 * common >= 80 * (na + nb - common)),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r(id, c) AS (SELECT doc_id, doc_id FROM s UNION SELECT e.b, r.c FROM r JOIN e ON r.id = e.a)
        SELECT s.doc_id, len(s)::BIGINT AS n_shingles, min(c) AS component_id FROM s JOIN r ON id = s.doc_id GROUP BY s.doc_id, len(s)""",
    "op5_mixing": f"""
        WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{_WORDS}')), 0)::BIGINT AS size,
                          ('0x' || md5('mix:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT AS u FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS ssize, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM d GROUP BY source),
        o AS (SELECT *, row_number() OVER (ORDER BY 3 * ssize / w, source NULLS LAST) AS k,
                     sum(ssize) OVER () AS total, sum(w) OVER () AS weights FROM s),
        p AS (SELECT *, total - coalesce(sum(3 * ssize) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rem,
                     weights - coalesce(sum(w) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS wleft FROM o),
        f AS (SELECT min(k) AS k FROM p WHERE rem * w <= 3 * ssize * wleft),
        t AS (SELECT p.source, p.ssize, CASE WHEN p.k < f.k THEN (3 * p.ssize)::DOUBLE
                     ELSE ((SELECT rem FROM p JOIN f USING (k)) * p.w)::DOUBLE / (SELECT wleft FROM p JOIN f USING (k))::DOUBLE END AS target FROM p, f),
        q AS (SELECT *, floor(target + 0.5)::BIGINT AS quota FROM t),
        c AS (SELECT doc_id, d.source, size, ssize, target, CASE WHEN ssize = 0 THEN 0 ELSE quota // ssize END AS whole, CASE WHEN ssize = 0 THEN 0 ELSE quota % ssize END AS rest,
                     sum(size) OVER (PARTITION BY d.source ORDER BY u, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS upto
              FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
        SELECT doc_id, size, ssize AS source_size, target,
               (size * least(3, whole + CASE WHEN upto - size < rest AND 2 * upto - size <= 2 * rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM c""",
    "op12_lexical_search": rf"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
        g AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_all FROM d WHERE len(w) > 0),
        t AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM d) GROUP BY ALL),
        f AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM t, g GROUP BY term, n_docs),
        q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
        s AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_all))))::BIGINT AS score
              FROM q JOIN f USING (term) JOIN t USING (term), g GROUP BY item_id, doc_id),
        r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20""",
    "op13_source_divergence": rf"""
        WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                          regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
        u AS (SELECT i, lang, source, unnest(w) AS term FROM d),
        k AS (SELECT lang, term FROM u GROUP BY lang, term HAVING count(DISTINCT i) >= 30),
        v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
        g AS (SELECT DISTINCT lang, source FROM d),
        c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM u JOIN k USING (lang, term) GROUP BY ALL),
        t AS (SELECT g.lang, g.source, coalesce(sum(n), 0)::HUGEINT AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
        p AS (SELECT t.lang, t.source, k.term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 5)) // (total + 5 * v) AS p
              FROM t JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term),
        l AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 5)) // (sum(sum(n)) OVER (PARTITION BY lang) + 5 * any_value(v)) AS q FROM p JOIN v USING (lang) GROUP BY lang, term),
        pairs AS (SELECT a.lang, a.source, b.source AS item, (SELECT coalesce(sum(abs(x.p - y.p)), 0) FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term
                         WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
        r AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs
              UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p JOIN l USING (lang, term) WHERE n > 0 AND p > q),
        o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM r)
        SELECT lang, source, part, item, value, rank FROM o WHERE part = 'pair' OR rank <= 50""",
}
