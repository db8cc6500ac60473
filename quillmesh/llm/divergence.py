"""How far the sources of a language differ in the words they use.

Per language a ``CountVectorizer`` (minDF documents, the largest ``vocabSize``)
keeps every term of enough documents and turns each document into an exact sparse
vector of counts. The vectors are summed per source from their sparse entries, in
whole numbers (``Summarizer`` itself works with means in doubles, which would not
be exact, and with dense buffers). A group is a (language, source) that occurs,
with or without terms.

With ``count`` a group's occurrences of a kept term, ``N`` the sum of its counts
and ``V`` the language's number of kept terms, a term's share is

    p = 1 + floor(10^9 * (count + 5) / (N + 5 * V))

and a term that the group lacks has the group's least share, p0. Two sources are
``sum of |p - q|`` over all kept terms apart. Pairs are evaluated sparsely: V times
|p0 - q0|, and for each term that one of the two has, what it adds to that. Groups
are dealt into blocks of ``SOURCES`` and terms into strips of ``STRIP``; a task
takes two blocks and one strip, so what it holds is bounded whatever the number of
sources or terms, and no term's list of sources is ever joined with itself.

A vocabulary comes to the driver, as ``CountVectorizer`` works. Where a language
could keep more than ``VOCABULARY`` terms, the kept terms are counted first, and
the language gets as many vocabularies, by hash of the term, as keep each of them
about so large; counts add up over them.

Null texts, languages and sources are taken as ''. Repeated rows count as often as
they stand. Texts are read whole. A language without kept terms has V = 0 and
distances 0. Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.llm._shared import emit, shared_dir, stage

VOCABULARY = 1 << 20  #: terms of one vocabulary, about, at most
SOURCES = 32  #: groups of one block
STRIP = 1024  #: terms of one strip
HELD = 1 << 21  #: entries of sparse vectors that a task sums at once
SALTS = 32  #: parts of a group's terms that are ranked by themselves first
SHARE = 1_000_000_000
PRIOR = 5
COUNTS = "lang string, source string, term_no long, term string, count long"
APART = pa.schema([("lang_no", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("value", pa.int64())])


MARK = "0"  #: leads every document's terms; no term holds a digit
#: Letters (A-Z lower-cased) and all that is not ASCII make terms; the rest parts them.
FOLD = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)).lower()


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's terms, parted by blanks and led by ``MARK``, and how many different ones they are."""
    for b in batches:
        for i in range(0, b.num_rows, 1000):
            part = b.slice(i, 1000)
            words = [t.translate(FOLD).split() for t in part.column("text").to_pylist()]
            count = lambda sizes: pa.array(sizes, pa.int64())
            terms = pa.array([b" ".join([MARK.encode(), *w]) for w in words], pa.binary()).view(pa.string())
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("lang", "source", "key")), terms, count([len(set(w)) for w in words])], names=["lang", "source", "key", "terms", "n_pairs"])


def _documents_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many documents each term is, by a hash of the term: for sizes, not for results."""

    def told() -> pa.RecordBatch:
        keys = np.fromiter((xxhash.xxh64_intdigest(t) for t in held), np.uint64, len(held)).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(list(held.values()), pa.int64())], names=["term", "docs"])

    held: Counter = Counter()
    for b in batches:
        for text in b.column("terms").to_pylist():
            held.update(set(text.split(" ")))
            if len(held) >= HELD // 4:
                yield told()
                held.clear()
    if held:
        yield told()


def share(count: Column, total: Column, kept: Column) -> Column:
    whole = lambda c, digits: c.cast(f"decimal({digits},0)")
    above = whole(F.lit(SHARE), 10) * whole(count + PRIOR, 18)
    return F.lit(1) + F.call_function("div", above, whole(total + PRIOR * kept, 18))


def _counted(held: DataFrame, min_docs: int) -> DataFrame:
    """lang, source, term_no, term, count of every kept term that a group has.

    ``held`` holds key, lang, source, terms and their numbers, in one folder for each key.
    """
    each = held.groupBy("key", "lang").agg(F.count_if(F.col("n_pairs") > 0).alias("docs"), F.sum("n_pairs").alias("pairs")).collect()  # a row per language
    done = [held.sparkSession.createDataFrame([], COUNTS)]
    for r in sorted(each):
        if r.docs < max(min_docs, 1):
            continue  # no term can be in enough documents
        texts = held.filter((F.col("key") == r.key) & (F.col("n_pairs") > 0)).select("source", "terms")
        mine = texts.withColumn("terms", F.split("terms", " "))
        parts = 1
        if r.pairs // min_docs > VOCABULARY:
            often = texts.select("terms").mapInArrow(_documents_of, "term long, docs long").groupBy("term").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs)
            parts = max(1, -(-often.count() // VOCABULARY))
        for part in range(parts):
            own = mine if parts == 1 else mine.withColumn("terms", F.filter("terms", lambda t: (t == MARK) | (F.pmod(F.xxhash64(t), F.lit(parts)) == part)))  # noqa: B023
            done += _vectors(own, r.lang, part, min_docs)
    return reduce(DataFrame.unionByName, done)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of sparse vectors by source, over ``HELD`` entries at a time."""

    def sums(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        source, at, value = (t.column(c).chunk(0) for c in ("source", "at", "value"))
        code = source.dictionary_encode()
        row = np.repeat(code.indices.to_numpy().astype(np.int64), np.diff(at.offsets.to_numpy()))
        key, of = np.unique(row << 32 | at.flatten().to_numpy(), return_inverse=True)
        total = np.zeros(len(key), np.int64)
        np.add.at(total, of, value.flatten().to_numpy().astype(np.int64))
        return pa.RecordBatch.from_arrays([code.dictionary.take(pa.array(key >> 32)), pa.array((key & 0xFFFFFFFF).astype(np.int32)), pa.array(total)], names=["source", "at", "count"])

    held, n = [], 0
    for b in batches:
        for i in range(0, b.num_rows, 1000):
            part = b.slice(i, 1000)
            held.append(part)
            n += len(part.column("at").flatten())
            if n >= HELD:
                yield sums(held)
                held, n = [], 0
    if held:
        yield sums(held)


def _vectors(docs: DataFrame, lang: str, part: int, min_docs: int) -> list[DataFrame]:
    """Counts per source and term of one vocabulary: none, if no term is kept."""
    # CountVectorizer refuses an empty vocabulary; every document has MARK
    model = CountVectorizer(inputCol="terms", outputCol="vector", minDF=float(min_docs), vocabSize=(1 << 31) - 1).fit(docs)
    words = [(i, w) for i, w in enumerate(model.vocabulary) if w != MARK]
    if not words:
        return []
    vocabulary = docs.sparkSession.createDataFrame(words, "at int, term string")
    sparse = F.unwrap_udt("vector")
    entries = model.transform(docs).select("source", sparse["indices"].alias("at"), sparse["values"].alias("value"))
    sums = entries.mapInArrow(_summed, "source string, at int, count long").groupBy("source", "at").agg(F.sum("count").alias("count"))
    number = (F.lit(part << 32).cast("long") + F.col("at")).alias("term_no")
    return [stage(sums.join(vocabulary, "at").select(F.lit(lang).alias("lang"), "source", number, "term", "count"), "counts")]


def _apart(t: pa.Table) -> pa.Table:
    """Distances of the sources of two blocks over one strip of terms.

    A source comes with one row of term null, which holds its least share, and
    rows of the strip's terms that it has. ``second`` marks rows of the second block.
    """
    lang, same = t.column("lang_no")[0].as_py(), t.column("block_a")[0].as_py() == t.column("block_b")[0].as_py()
    source, term, p = (t.column(c).to_numpy(zero_copy_only=False) for c in ("source_no", "term_no", "p"))
    second = t.column("second").to_numpy(zero_copy_only=False).astype(bool)
    heads = term < 0
    order = np.flatnonzero(heads)[np.argsort(source[heads])]
    sources, least, side, kept = source[order], p[order], second[order], int(t.column("kept").to_numpy().max()) if t.column("strip")[0].as_py() == 0 else 0
    terms, at = np.unique(term[~heads], return_inverse=True)
    P = np.repeat(least[:, None], len(terms), axis=1)
    P[np.searchsorted(sources, source[~heads]), at] = p[~heads]
    rows = []
    for i in range(len(sources)) if same else np.flatnonzero(~side):
        others = np.arange(i + 1, len(sources)) if same else np.flatnonzero(side)
        base = np.abs(least[others] - least[i])
        value = np.abs(P[others] - P[i]).sum(axis=1) + (kept - len(terms)) * base
        rows.append((np.full(len(others), sources[i]), sources[others], value))
    a, b, value = (np.concatenate(c) for c in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 3
    return pa.Table.from_batches([emit(APART, {"lang_no": np.full(len(a), lang, np.int32), "a": a, "b": b, "value": value})])


def _pairs(groups: DataFrame, shares: DataFrame, sources: int, terms: int) -> DataFrame:
    """lang_no, a, b, value of any two groups a < b of a language.

    ``groups``: lang_no, source_no (from 0), p0, kept; ``shares``: lang_no,
    source_no, term_no, p. ``sources`` and ``terms`` are the largest numbers of them.
    """
    blocks, strips = max(1, -(-sources // SOURCES)), max(1, -(-terms // STRIP))
    block = F.floor(F.col("source_no") / SOURCES).cast("int")
    all_strips = F.explode(F.sequence(F.lit(0), F.lit(strips - 1)))
    rows = groups.select("lang_no", "source_no", F.lit(-1).cast("long").alias("term_no"), F.col("p0").alias("p"), "kept", all_strips.alias("strip"))
    rows = rows.unionByName(shares.select("lang_no", "source_no", "term_no", "p", F.lit(0).cast("long").alias("kept"), F.pmod("term_no", F.lit(strips)).cast("int").alias("strip")))
    met = rows.withColumn("own", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = met.withColumn("block_a", F.least("own", "other")).withColumn("block_b", F.greatest("own", "other")).withColumn("second", F.col("own") > F.col("other"))
    found = met.drop("own", "other").groupBy("lang_no", "block_a", "block_b", "strip").applyInArrow(_apart, "lang_no int, a long, b long, value long")
    return found.groupBy("lang_no", "a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, min_docs: int = 30, top: int = 50, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, part, item, value, rank: each group's distance to every other
    source of its language (``pair``), and the ``top`` terms it uses more often
    than its language does (``term``)."""
    spark = docs.sparkSession
    filled = lambda c, name: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)
    base = docs.select(filled(lang_col, "lang"), filled(source_col, "source"), filled(text_col, "text"))
    groups = stage(base.groupBy("lang", "source").agg(F.count("*").alias("docs")), "groups")
    # with one folder for each language, a pass over a language reads no other
    path = f"{shared_dir(spark)}/terms-{uuid.uuid4().hex}"
    read = base.select("lang", "source", F.sha1("lang").alias("key"), F.col("text").cast("binary").alias("text"))
    tokens = read.mapInArrow(_read, "lang string, source string, key string, terms string, n_pairs long")
    tokens.write.option("compression", "zstd").partitionBy("key").parquet(path)
    counted = _counted(spark.read.schema("lang string, source string, terms string, n_pairs long, key string").parquet(path), min_docs)

    terms = stage(counted.groupBy("lang", "term_no", "term").agg(F.sum("count").alias("all")), "kept")
    langs = groups.select("lang").distinct().withColumn("lang_no", F.row_number().over(Window.orderBy("lang")))  # a row per language
    langs = langs.join(terms.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("all").alias("lang_total")), "lang", "left")
    totals = groups.join(counted.groupBy("lang", "source").agg(F.sum("count").alias("total")), ["lang", "source"], "left").join(langs, "lang")
    totals = totals.withColumn("source_no", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    totals = totals.select("lang_no", "lang", "source_no", "source", zero("total"), zero("kept"), zero("lang_total"))
    nothing = F.col("kept") == 0
    totals = stage(totals.withColumn("p0", F.when(nothing, F.lit(1)).otherwise(share(F.lit(0), F.col("total"), F.col("kept"))).cast("long")), "totals")

    counted = counted.join(terms.drop("term"), ["lang", "term_no"]).join(totals, ["lang", "source"])
    p, q = share(F.col("count"), F.col("total"), F.col("kept")), share(F.col("all"), F.col("lang_total"), F.col("kept"))
    shares = stage(counted.select("lang_no", "lang", "source_no", "source", "term_no", "term", p.cast("long").alias("p"), q.cast("long").alias("q")), "shares")

    most = totals.agg(F.max("source_no"), F.max("kept")).first()
    apart = stage(_pairs(totals, shares, (most[0] or 0) + 1, most[1] or 0), "pairs")
    apart = apart.unionByName(apart.select("lang_no", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    name = lambda n: totals.select("lang_no", F.col("source_no").alias(n), *(["lang", "source"] if n == "a" else [F.col("source").alias("item")]))
    pairs = apart.join(name("a"), ["lang_no", "a"]).join(name("b"), ["lang_no", "b"]).select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    more = shares.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    order = [F.desc("value"), "item"]
    salted = Window.partitionBy("lang", "source", "salt").orderBy(*order)
    more = more.withColumn("salt", F.pmod(F.xxhash64("item"), F.lit(SALTS))).withColumn("rank", F.row_number().over(salted)).filter(F.col("rank") <= top).drop("salt", "rank")
    ranked = Window.partitionBy("lang", "source", "part").orderBy(*order)
    out = pairs.unionByName(more).withColumn("rank", F.row_number().over(ranked))
    return out.filter((F.col("part") == "pair") | (F.col("rank") <= top))
