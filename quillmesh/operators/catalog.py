"""Tables that change: upserts, retention, fingerprints, logs, reconciliation.

Tables are Parquet files, so a change is a new version of the table made by a
join or a window; nothing is updated in place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RESERVED = ("ALL", "UNFILED")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """The row with the highest version per key; the new one wins a tie."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.desc(version), F.desc("_new"))
    return both.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "_new")


def insert_if_absent(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    return old.unionByName(new.join(old.select(*keys).distinct(), list(keys), "left_anti"))


def replace_by(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All rows of the keys in ``new`` are replaced by its rows."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def newest(rows: DataFrame, n: int, order: Sequence[Column], by: Sequence[str] = ()) -> DataFrame:
    """Retention: the newest n, per group where one is given."""
    if not by:
        return rows.orderBy(*order).limit(n)
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_r") <= n).drop("_r")


def expired(sessions: DataFrame, used_at: str, hours: int, now: Column, by: str) -> DataFrame:
    """Sessions whose sliding lifetime has run out."""
    last = sessions.groupBy(by).agg(F.max(used_at).alias("last_used"))
    return last.withColumn("expires_at", F.col("last_used") + F.make_interval(hours=F.lit(hours))).filter(F.col("expires_at") < now)


def orphans(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    return children.join(parents.select(key).distinct(), key, "left_anti")


def run_status(status: Column, started: Column, now: Column, minutes: int) -> Column:
    """A run that has been going for too long reads as abandoned; nothing is written."""
    return F.when((status == "running") & (started < now - F.make_interval(mins=F.lit(minutes))), "abandoned").otherwise(status)


def decision_log(log: DataFrame, keys: Sequence[str], order: Sequence[str], id_col: str) -> DataFrame:
    """Append-only decisions with what each supersedes and whether it stands."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return log.withColumn("supersedes", F.lag(id_col).over(w)).withColumn("is_current", F.lead(id_col).over(w).isNull())


def single_baseline(rows: DataFrame, id_col: str, chosen: Column) -> DataFrame:
    return rows.withColumn("baseline", F.col(id_col) == chosen)


def batch_violations(batch: DataFrame, known: DataFrame, key: str, verdict: str, rationale: str, verdicts: Sequence[str], needs_reason: Sequence[str]) -> DataFrame:
    """(key, problem) of a batch that is accepted only where this is empty."""
    once = Window.partitionBy(key)
    joined = batch.join(known.select(F.col(key), F.lit(True).alias("_known")).distinct(), key, "left").withColumn("_times", F.count("*").over(once))
    found = F.array(
        F.when(F.col("_known").isNull(), "unknown"),
        F.when(F.col("_times") > 1, "duplicate"),
        F.when(~F.coalesce(F.col(verdict).isin(*verdicts), F.lit(False)), "bad verdict"),
        F.when(F.col(verdict).isin(*needs_reason) & (F.trim(F.coalesce(F.col(rationale), F.lit(""))) == ""), "no rationale"),
    )
    return joined.select(key, F.explode(F.filter(found, lambda p: p.isNotNull())).alias("problem")).distinct()


def document_fingerprint(text: Column, settings: str = "v1") -> Column:
    """Of the settings and the body without front matter, so that filing it elsewhere changes nothing."""
    body = F.regexp_replace(text, r"(?s)\A---\n.*?\n---\n", "")
    return F.sha2(F.concat(F.lit(settings + "\n"), body), 256)


def ordered_digest(rows: DataFrame, by: Sequence[str], order: Sequence[str], value: Column, kind: str = "md5", sep: str = ",") -> DataFrame:
    """A digest per group of its values in the order of the sort columns."""
    items = F.array_sort(F.collect_list(F.struct(*order, value.alias("_v"))))
    joined = F.array_join(F.transform(items, lambda s: s["_v"]), sep)
    return rows.groupBy(*by).agg((F.md5(joined) if kind == "md5" else F.sha2(joined, 256)).alias("digest"), F.count("*").alias("n"))


def bucketed_digest(rows: DataFrame, by: Sequence[str], key: str, fingerprint: str, per_bucket: int = 10_000) -> DataFrame:
    """(by, fingerprint, n): a digest of each group, or of the whole table, by way of
    digests of key ranges, so that no task sees a large group whole. Buckets are
    runs of ``per_bucket`` keys; where there are many of them, their digests are
    bucketed again. Keys that are no whole numbers are placed by their hash, in as
    many places as there are rows, and so are null keys by their fingerprint."""
    if rows.schema[key].dataType.typeName() in ("byte", "short", "integer", "long"):
        place, span = F.coalesce(F.col(key).cast("long"), F.pmod(F.xxhash64(fingerprint), F.lit(max(rows.count(), 1)))), rows.agg(F.max(F.abs(F.col(key).cast("long")))).first()[0] or 0
        span = max(span, rows.count() if rows.filter(F.col(key).isNull()).limit(1).count() else 0)
    else:
        span = max(rows.count(), 1)
        place = F.pmod(F.xxhash64(key, fingerprint), F.lit(span))
    level = rows.select(*by, place.alias("_k"), F.concat_ws(":", F.col(key).cast("string"), F.col(fingerprint)).alias("_v"), F.lit(1).cast("long").alias("_n"))
    while True:
        span //= per_bucket
        parts = level.groupBy(*by, F.floor(F.col("_k") / per_bucket).alias("_k")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_v"))), lambda s: s["_v"]), "\n").alias("_t"), F.sum("_n").alias("_n"))
        level = parts.select(*by, "_k", F.sha2("_t", 256).alias("_v"), "_n")
        if span < per_bucket:
            break
    last = level.groupBy(*by).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_v"))), lambda s: s["_v"]), "\n"), 256).alias("_v"), F.sum("_n").alias("n"))
    return last.select(*by, F.left("_v", F.lit(16)).alias("fingerprint"), "n")


def fingerprint_delta(old: DataFrame, new: DataFrame, key: str, fingerprint: str = "fingerprint", category: str = "category") -> DataFrame:
    """(key, status): added, gone, updated, recategorised or unchanged."""
    o = old.select(key, F.col(fingerprint).alias("_of"), F.col(category).alias("_oc"))
    n = new.select(key, F.col(fingerprint).alias("_nf"), F.col(category).alias("_nc"))
    status = (
        F.when(F.col("_of").isNull(), "added").when(F.col("_nf").isNull(), "gone").when(F.col("_of") != F.col("_nf"), "updated")
        .when(~F.col("_oc").eqNullSafe(F.col("_nc")), "recategorised").otherwise("unchanged")
    )
    return o.join(n, key, "full_outer").select(key, status.alias("status"))


def category_of(explicit: Column, text: Column, path: Column, registered: Sequence[str]) -> Column:
    """Explicit, declared in front matter, a registered folder, else UNFILED."""
    good = lambda c: F.when(c.rlike(r"^[A-Z][A-Z0-9_]{0,31}$") & ~c.isin(*RESERVED), c)
    declared = F.upper(F.trim(F.regexp_extract(F.regexp_extract(text, r"(?s)\A---\n(.*?)\n---\n", 1), r"(?im)^category:\s*[\"']?([^\"'\n]+)", 1)))
    folders = F.transform(F.split(path, "/"), F.upper)
    folder = F.try_element_at(F.filter(folders, lambda p: p.isin(*registered)), F.lit(-1))
    return F.coalesce(good(F.upper(F.trim(explicit))), good(declared), folder, F.lit("UNFILED"))


def front_matter(text: Column) -> Column:
    """The keys (lower case) and values of a leading --- block; of a key that is
    there again, the last value counts."""
    block = F.regexp_extract(text, r"(?s)\A---\n(.*?)\n---\n", 1)
    lines = F.filter(F.split(block, "\n"), lambda x: x.contains(":"))
    pairs = F.transform(lines, lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("key"), F.btrim(F.trim(F.regexp_replace(x, r"^[^:]*:", "")), F.lit("\"'")).alias("value")))
    named = F.filter(pairs, lambda p: p["key"] != "")
    later = lambda i: F.transform(F.slice(named, i + 2, F.size(named)), lambda p: p["key"])
    return F.map_from_entries(F.filter(named, lambda p, i: ~F.array_contains(later(i), p["key"])))


def coverage(disk: DataFrame, corpus: DataFrame, graph: DataFrame, key: str) -> DataFrame:
    """Three stores side by side: which hold a key, and what is wrong."""
    flag = lambda d, name: d.select(key, F.lit(True).alias(name)).distinct()
    both = flag(disk, "on_disk").join(flag(corpus, "in_corpus"), key, "full_outer").join(flag(graph, "in_graph"), key, "full_outer")
    both = both.select(key, *(F.coalesce(c, F.lit(False)).alias(c) for c in ("on_disk", "in_corpus", "in_graph")))
    issue = (
        F.when(~F.col("on_disk"), "file gone").when(~F.col("in_corpus") & ~F.col("in_graph"), "unused")
        .when(~F.col("in_corpus"), "not indexed").when(~F.col("in_graph"), "not in graph").otherwise("clean")
    )
    return both.withColumn("issue", issue)


SEVERITY = (("file gone", 0), ("not indexed", 1), ("not in graph", 2), ("unused", 3), ("clean", 4))


def coverage_summary(covered: DataFrame) -> DataFrame:
    """Every issue with its count, worst first."""
    every = covered.sparkSession.createDataFrame(list(SEVERITY), "issue string, severity int")
    counts = covered.groupBy("issue").agg(F.count("*").alias("n"))
    return every.join(counts, "issue", "left").select("issue", "severity", F.coalesce("n", F.lit(0)).alias("n"))


def shadowed(files: DataFrame, name: str, order: Sequence[str]) -> DataFrame:
    """Later files of the same name hide behind the first."""
    w = Window.partitionBy(name).orderBy(*order)
    return files.withColumn("kept", F.first(order[-1]).over(w)).withColumn("shadowed", F.row_number().over(w) > 1)


def remap(rows: DataFrame, mapping: DataFrame, column: str, old: str = "old_id", new: str = "new_id") -> DataFrame:
    """Replace ids by the mapping; those without an entry stay."""
    return rows.join(mapping.select(F.col(old).alias(column), F.col(new).alias("_new")), column, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def remap_array(rows: DataFrame, mapping: DataFrame, key: str, column: str, old: str = "old_id", new: str = "new_id") -> DataFrame:
    """The same inside an array column, order kept."""
    flat = rows.select(key, F.posexplode(column).alias("_p", "_o")).join(mapping.select(F.col(old).alias("_o"), F.col(new).alias("_n")), "_o", "left")
    back = flat.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", F.coalesce("_n", "_o").alias("v")))), lambda s: s["v"]).alias("_mapped"))
    return rows.join(back, key, "left").withColumn(column, F.coalesce("_mapped", column)).drop("_mapped")


def checks(spark, *found: tuple[str, DataFrame]) -> DataFrame:
    """(check, violations, passed) of named DataFrames of violations."""
    out = None
    for name, rows in found:
        one = rows.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations", (F.col("violations") == 0).alias("passed"))
        out = one if out is None else out.unionByName(one)
    return out


def long_scores(rows: DataFrame, key: str, names: Sequence[str]) -> DataFrame:
    """Wide scores as (key, name, value), missing ones left out."""
    pairs = F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("value")) for n in names))
    return rows.select(key, F.explode(pairs).alias("s")).select(key, "s.name", "s.value").filter("value is not null")


def follow(chunks: DataFrame, documents: DataFrame, key: str, category: str, was: str) -> DataFrame:
    """Chunks take their document's category; ``moved`` tells which had another."""
    return chunks.join(documents.select(key, category), key).withColumn("moved", ~F.col(category).eqNullSafe(F.col(was)))


def delete_with_children(children: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Children of deleted parents go with them; those without a parent stay."""
    return children.join(gone.select(key), key, "left_anti")


def set_null(children: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Children of deleted parents stay and point nowhere."""
    marked = children.join(gone.select(key, F.lit(True).alias("_gone")).distinct(), key, "left")
    return marked.withColumn(key, F.when(F.col("_gone").isNull(), F.col(key))).drop("_gone")


def touched(uses: DataFrame, session: str, ts: str, hours: int) -> DataFrame:
    """(session, used_at, expires_at): each use pushes a session's end out."""
    used = uses.groupBy(session).agg(F.max(ts).alias("used_at"))
    return used.withColumn("expires_at", F.col("used_at") + F.make_dt_interval(hours=F.lit(hours)))


def named_deletion(documents: DataFrame, targets: DataFrame, source: str, name: str) -> DataFrame:
    """(name, matches, status) of deletions by file name: a path ends in / and the
    name, or is the name; a name that several share deletes nothing."""
    named = documents.select(F.substring_index(source, "/", -1).alias(name)).groupBy(name).agg(F.count("*").alias("matches"))
    j = targets.select(name).distinct().join(named, name, "left").withColumn("matches", F.coalesce("matches", F.lit(0).cast("long")))
    return j.withColumn("status", F.when(F.col("matches") == 0, "none").when(F.col("matches") == 1, "deleted").otherwise("ambiguous"))


def declare(text: Column, category: Column) -> Column:
    """Front matter with this category: its line is rewritten, or added at the
    end of the block, or a block is put in front; twice is as good as once."""
    block = r"(?s)\A---\n(.*?\n)---\n"
    line = F.concat(F.lit("category: "), category, F.lit("\n"))
    literal = F.regexp_replace(line, r"([\\$])", r"\\$1")  # in a replacement, $ and \ would be signs
    head = F.regexp_extract(text, block, 1)
    rest = F.regexp_replace(text, block, "")
    declared = F.regexp_replace(head, F.lit(r"(?im)^category:[^\n]*\n"), literal)
    return F.when(~text.rlike(block), F.concat(F.lit("---\n"), line, F.lit("---\n"), text)).otherwise(
        F.concat(F.lit("---\n"), F.when(head.rlike(r"(?im)^category:"), declared).otherwise(F.concat(head, line)), F.lit("---\n"), rest)
    )
