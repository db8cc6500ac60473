"""Checks and repairs of register entries before they are kept."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmesh.functions.scalar import normal_text, option_index
from quillmesh.operators.graph import settled

# Fixed values.
PARTIAL = 0.6  #: share of a quote that counts as a partial quote
SURE = 0.7  #: confidence that needs two sources
CAP = 0.65  #: what one source allows
DRIFT = 0.2  #: distance from the computed confidence that is reported


@F.pandas_udf(T.StringType())
def decomposed(text: pd.Series) -> pd.Series:
    """Unicode NFKD, which has no built-in expression."""
    return text.map(lambda t: unicodedata.normalize("NFKD", t), na_action="ignore")


def strict_key(text: Column) -> Column:
    """Of a text already decomposed: plain quotes and dashes, single blanks, lower case."""
    return F.lower(F.trim(F.regexp_replace(F.translate(text, "‘’“”–— ", "''\"\"-- "), r"\s+", " ")))


def holds_quote(quote: Column, text: Column) -> Column:
    """Whether a text holds a quote as written or by its words alone; both are
    decomposed. An empty quote is held by nothing, a null text holds nothing."""
    q, t = strict_key(quote), strict_key(text)
    words = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"[^\p{L}\p{M}\p{N}_\s]", " "), r"\s+", " "))
    return F.coalesce((q != "") & (t.contains(q) | ((words(q) != "") & t.isNotNull() & words(t).contains(words(q)))), F.lit(False))


def covering_run(quote: str, at: int, size: int, text: str) -> int:
    """Length of the longest run that both hold and that covers quote[at : at + size]:
    each place of that middle in the text is widened to both sides."""
    best, place = 0, text.find(quote[at : at + size])
    while place >= 0:
        before = 0
        while before < min(at, place) and quote[at - before - 1] == text[place - before - 1]:
            before += 1
        after, end = 0, place + size
        while at + size + after < len(quote) and end + after < len(text) and quote[at + size + after] == text[end + after]:
            after += 1
        best = max(best, before + size + after)
        place = text.find(quote[at : at + size], place + 1)
    return best


@F.pandas_udf(T.DoubleType())
def run_share(quote: pd.Series, at: pd.Series, size: pd.Series, text: pd.Series) -> pd.Series:
    """Share of a (normalised) quote that its longest run over its middle covers in the text."""
    return pd.Series([round(covering_run(q, a, n, t) / len(q), 2) for q, a, n, t in zip(quote, at, size, text, strict=True)], dtype="float64")


def _rarest(asked: DataFrame, held: DataFrame) -> DataFrame:
    """(item_id, doc_id): items (item_id, k) and documents (doc_id, k) that share the
    key of the item that the fewest documents hold. A document that holds an
    item's middle holds all its keys, so the rarest is as good as any."""
    held = settled(held.join(asked.select("k").distinct(), "k", "left_semi"), "keys")
    df = held.groupBy("k").agg(F.count("*").alias("df"))
    best = asked.join(df, "k", "left").groupBy("item_id").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "k")).alias("b"))
    return best.select("item_id", "b.k").join(held, "k").select("item_id", "doc_id")


def partial_quotes(items: DataFrame, docs: DataFrame) -> DataFrame:
    """(item_id, doc_id, share, status) of items (item_id, text) that a document
    (doc_id, text) holds whole or by a run of PARTIAL or more of their characters.

    Every run that long covers the middle of its item, so items and documents
    meet by that middle: by its rarest two adjacent whole words, where it has
    none by its rarest whole word, and else by its rarest three letters (one, where
    it has no three). Then the middle itself is looked for, and runs are measured around its places. An item
    is verbatim where a document contains it, whatever its share rounds to."""
    q = items.select("item_id", normal_text(F.col("text")).alias("q")).filter("q <> ''")
    least = F.ceil(F.length("q") * (PARTIAL - 0.005)).cast("int")
    q = q.withColumn("at", F.length("q") - least).withColumn("size", 2 * least - F.length("q")).withColumn("mid", F.substr("q", F.col("at") + 1, F.col("size")))
    t = docs.filter("text is not null").select("doc_id", normal_text(F.col("text")).alias("t"))
    pairs = lambda w: F.array_distinct(F.zip_with(w, F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0))), lambda x, y: F.when(y.isNotNull(), F.concat_ws(" ", x, y))))
    inner = F.split("mid", " ")  # the first and the last word of the middle may be cut
    q = q.withColumn("twos", F.filter(pairs(F.slice(inner, F.lit(2), F.greatest(F.size(inner) - 2, F.lit(0)))), lambda k: k.isNotNull()))
    keys = lambda df, of, k: df.select(of, F.explode_outer(k).alias("k")).filter("k is not null")  # noqa: E731  outer: nothing is inferred and asked beneath
    met = _rarest(keys(q, "item_id", F.col("twos")), keys(t, "doc_id", pairs(F.split("t", " "))))
    # a middle between two adjacent words still holds a word; letters are for those that hold none
    inside = F.filter(F.slice(inner, F.lit(2), F.greatest(F.size(inner) - 2, F.lit(0))), lambda w: w != "")
    q = q.withColumn("ones", F.array_distinct(inside))
    rest = F.size("twos") == 0
    lone = q.filter(rest & (F.size("ones") > 0))
    if not lone.isEmpty():
        met = met.unionByName(_rarest(keys(lone, "item_id", F.col("ones")), keys(t, "doc_id", F.array_distinct(F.split("t", " ")))))
    for width, few in ((3, F.length("mid") >= 3), (1, F.length("mid") < 3)):
        short = q.filter(rest & (F.size("ones") == 0) & few)
        if not short.isEmpty():
            # one pass over a text: a look ahead at each letter; substr would count from the text's beginning each time
            grams = lambda c: F.array_distinct(F.regexp_extract_all(F.col(c), F.lit(rf"(?s)(?=(.{{{width}}}))"), F.lit(1)))  # noqa: B023, E731
            met = met.unionByName(_rarest(keys(short, "item_id", grams("mid")), keys(t, "doc_id", grams("t"))))
    rows = met.distinct().join(q.select("item_id", "q", "at", "size", "mid"), "item_id").join(t, "doc_id").filter(F.col("t").contains(F.col("mid")))
    share = run_share("q", "at", "size", "t")
    rows = rows.select("item_id", "doc_id", share.alias("share"), F.col("t").contains(F.col("q")).alias("whole")).filter(F.col("share") >= PARTIAL)
    return rows.select("item_id", "doc_id", "share", F.when(F.col("whole"), "verbatim").otherwise("partial").alias("status"))


def verify_entries(entries: DataFrame, evidence: DataFrame, key: str, allowed: list[str]) -> DataFrame:
    """Entries (key, classification, confidence, expected, code_known) with what
    their evidence (key, found) leaves of them.

    Evidence counts where the quote stands in a text that was retrieved (found
    is null where it was not). Without any, an entry is UNKNOWN at confidence 0;
    with one source, confidence is capped. ``issues`` are in the order of the
    rules. Evidence is counted per entry before it meets the entries."""
    e = evidence.groupBy(key).agg(F.count_if(F.col("found").isNull()).alias("unseen"), F.count_if(~F.col("found")).alias("absent"), F.count_if("found").alias("kept"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    j = entries.join(e, key, "left").withColumns({c: zero(F.col(c)) for c in ("unseen", "absent", "kept")})
    judged = F.col("classification") != "UNKNOWN"
    lost = judged & (F.col("kept") == 0)
    now = F.when(lost, "UNKNOWN").otherwise(F.col("classification"))
    held = F.when(lost, 0.0).otherwise(F.col("confidence"))
    thin = (held >= SURE) & (F.col("kept") < 2)
    issues = F.array(
        F.when(F.col("unseen") > 0, "not retrieved"),
        F.when(F.col("absent") > 0, "quote absent"),
        F.when(~F.col("code_known"), "code unknown"),
        F.when(judged & ~F.col("classification").isin(*allowed), "class not allowed"),
        F.when(lost, "no evidence left"),
        F.when(F.abs(F.col("expected") - held) > DRIFT, "confidence drifts"),
        F.when(thin, "one source"),
    )
    confidence = F.when(now == "UNKNOWN", 0.0).when(thin, CAP).otherwise(held)
    return j.select(key, now.alias("classification"), F.round(confidence, 4).alias("confidence"), F.col("kept").alias("evidence"), F.filter(issues, lambda x: x.isNotNull()).alias("issues"))


def send_back(deviations: DataFrame, steps: DataFrame, advised: DataFrame, by: str, gap: str, states: list[str]) -> DataFrame:
    """(by, gap, rule): findings that go back to their author: unplaced (no known
    step of the run), not advised (a localisation state, and the run advises
    nothing), unquoted (rated, and no quote of the rated side)."""
    known = steps.select(by, F.col("step").alias("step"), F.lit(True).alias("_step")).distinct()
    told = advised.select(by, F.lit(True).alias("_told")).distinct()
    j = deviations.join(known, [by, "step"], "left").join(told, by, "left")
    rules = F.array(
        F.when(F.col("_step").isNull(), "unplaced"),
        F.when(F.col("state").isin(*states) & F.col("_told").isNull(), "not advised"),
        F.when(F.col("rating").isNotNull() & ~F.coalesce(F.col("quoted"), F.lit(False)), "unquoted"),
    )
    return j.select(by, gap, F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("rule"))


def legacy_choice(comment: Column, options: Column) -> dict[str, Column]:
    """option (index), option_text and rationale of an old comment. The letter
    counts only where the text after it is the option offered under it."""
    plain = F.trim(F.coalesce(comment, F.lit("")))
    at = option_index(plain)
    said = F.trim(F.regexp_replace(plain, r"(?i)^option\s+[a-h]\s*:?\s*", ""))
    fits = F.coalesce(at.isNotNull() & (F.trim(F.get(options, at)) == said), F.lit(False))
    return {"option": F.when(fits, at), "option_text": F.when(fits, F.get(options, at)).otherwise(""), "rationale": F.when(fits, "").otherwise(plain)}


def without_fields(item: Column, *names: str) -> Column:
    """A struct without its provenance fields (nested ones by dotted name)."""
    return item.dropFields(*names)
