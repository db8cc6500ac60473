"""Codes, tickets and register rows read out of document texts.

Everything is an expression or an equi-join; a text is exploded only into what
was found in it. Null texts hold nothing, repeated rows count again.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: a process code. A longer code is never cut: INT-P-080-160 holds no P-080-160.
CODE = r"(?<![A-Za-z0-9-])[A-Za-z][A-Za-z0-9]{0,3}-\d{2,3}(?:-\d{2,3})+\b"


def codes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, code, mentions) of the process codes of each text."""
    found = docs.select(id_col, F.explode(F.regexp_extract_all(text_col, F.lit(CODE), F.lit(0))).alias("code"))
    return found.groupBy(id_col, "code").agg(F.count("*").alias("mentions"))


def tickets(docs: DataFrame, id_col: str, text_col: str, name_col: str, project: str, register_keys: DataFrame, whole: bool = True) -> DataFrame:
    """(id, ticket, mentions, relation) of the tickets of each text and file name.

    A document whose file name holds a ticket's number implements it, others
    refer to it; ``whole`` asks for the number as a word of its own, otherwise it may
    be part of a longer one. Keys of register steps (``key``) are no tickets."""
    pattern = rf"(?i)\b{re.escape(project)}[-_ ]?(\d{{4,6}})\b"
    both = F.concat_ws("\n", F.col(name_col), F.col(text_col))
    found = docs.select(id_col, name_col, F.explode(F.regexp_extract_all(both, F.lit(pattern), F.lit(1))).alias("number"))
    counted = found.groupBy(id_col, name_col, "number").agg(F.count("*").alias("mentions")).withColumn("ticket", F.concat(F.lit(project + "-"), F.col("number")))
    kept = counted.join(register_keys.select(F.col("key").alias("ticket")).distinct(), "ticket", "left_anti")
    numbers = F.regexp_extract_all(name_col, F.lit(r"\b\d+\b"), F.lit(0))
    named = F.array_contains(numbers, F.col("number")) if whole else F.col(name_col).contains(F.col("number"))
    primary = F.coalesce(named, F.lit(False))
    return kept.select(id_col, "ticket", "mentions", F.when(primary, "implements").otherwise("refers to").alias("relation"))


def code_descriptions(docs: DataFrame, id_col: str, text_col: str, official: DataFrame) -> DataFrame:
    """(id, code, description): the official name (code, name), else what follows
    the code on the first line that says anything, else a default."""
    lines = docs.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("line", "t"))
    at = lines.select(id_col, "line", "t", F.explode(F.array_distinct(F.regexp_extract_all("t", F.lit(CODE), F.lit(0)))).alias("code"))
    after = F.regexp_replace(F.substring_index(_after(F.col("t"), F.col("code")), "|", 1), r"\s+", " ")
    tail = F.nullif(F.trim(F.regexp_replace(after, r"^[\s#*:–-]+", "")), F.lit(""))
    first = at.withColumn("tail", tail).groupBy(id_col, "code").agg(F.min_by("tail", F.when(F.col("tail").isNotNull(), F.col("line"))).alias("tail"))
    named = first.join(official.select("code", "name"), "code", "left")
    return named.select(id_col, "code", F.coalesce("name", "tail", F.concat(F.lit("Process step "), F.col("code"))).alias("description"))


def _after(text: Column, code: Column) -> Column:
    """What follows a code that is not the beginning of a longer one, else empty."""
    upto = F.concat(F.lit(r"^.*?(?<![A-Za-z0-9-])"), code, F.lit(r"(?!-?\d)"))
    return F.when(F.regexp_like(text, upto), F.regexp_replace(text, upto, F.lit(""))).otherwise("")


def register_rows(lines: DataFrame, line_col: str, order: str, project: str) -> DataFrame:
    """(order, chain, step, name, key) of the rows of a Markdown register:
    | 03. Chain | 4.5 Area | 4.5.1 Group | 4.5.1.2 Step | KEY-123 |

    A line is split at its pipes; the first five cells in a row that are of these
    kinds are read."""
    cells = F.transform(F.split(line_col, r"\|"), lambda c: F.regexp_replace(c, r"^\s+|\s+$", ""))
    rows = lines.filter(F.col(line_col).isNotNull()).select(order, cells.alias("c"))
    kinds = [r"^\d{2}\.\s*\S", *[r"^[\d.]+\s+\S"] * 3, rf"^{re.escape(project)}-\d+$"]
    fits = lambda i: reduce(and_, (F.get("c", i + n).rlike(kind) for n, kind in enumerate(kinds)))
    inner = F.filter(F.sequence(F.lit(1), F.greatest(F.size("c") - 6, F.lit(1))), lambda i: (i <= F.size("c") - 6) & fits(i))  # a pipe before and after
    at = rows.withColumn("i", F.get(inner, F.lit(0))).filter("i is not null")
    cell = lambda n: F.get("c", F.col("i") + n)
    number = F.regexp_extract(cell(3), r"^[\d.]+", 0)
    name = F.regexp_replace(cell(3), r"^[\d.]+\s+", "")
    return at.select(order, F.regexp_replace(cell(0), r"^\d{2}\.\s*", "").alias("chain"), number.alias("step"), name.alias("name"), cell(4).alias("key"))


def register_steps(rows: DataFrame, chain: str, order: str) -> DataFrame:
    """Steps of one value chain; of rows that repeat a step the first one counts."""
    mine = rows.filter(F.lower("chain") == chain.lower())
    first = mine.groupBy("step").agg(F.min_by(F.struct("name", "key"), order).alias("r"))
    return first.select("step", "r.name", "r.key")


def original_of(docs: DataFrame, files: DataFrame) -> DataFrame:
    """(doc, path, rule): the original of each document (doc, stem, folder) among
    files (path, stem, ext, folder): <stem>_<ext> names before whole stems, the
    same folder before others, then the smallest path."""
    named = files.select("path", F.concat_ws("_", "stem", "ext").alias("stem"), F.col("folder").alias("at"), F.lit(0).alias("rule"))
    whole = files.select("path", "stem", F.col("folder").alias("at"), F.lit(1).alias("rule"))
    met = docs.join(named.unionByName(whole), "stem")
    best = met.groupBy("doc").agg(F.min(F.struct("rule", (F.col("folder") != F.col("at")).alias("far"), "path")).alias("b"))
    return best.select("doc", "b.path", F.when(F.col("b.rule") == 0, "name and ending").otherwise("stem").alias("rule"))


def best_node(terms: DataFrame, nodes: DataFrame) -> DataFrame:
    """(term, id, rule): the node that a term names best: its id, its label, or a
    label that begins with it; of equal ones the shortest label, then the
    smallest id. All three are equi-joins; a label meets its beginnings of those
    lengths that terms have."""
    t = terms.select("term", F.lower(F.trim("term")).alias("k")).filter("k <> ''")
    n = nodes.select("id", F.lower("label").alias("label"))
    lengths = F.broadcast(t.agg(F.array_sort(F.collect_set(F.length("k"))).alias("lengths")))  # one row, of as many numbers as terms have lengths
    begins = F.transform(F.filter("lengths", lambda i: i <= F.length("label")), lambda i: F.substr(F.col("label"), F.lit(1), i))
    keys = (
        n.select(F.lower("id").alias("k"), "id", "label", F.lit(0).alias("rule"))
        .unionByName(n.select(F.col("label").alias("k"), "id", "label", F.lit(1).alias("rule")))
        .unionByName(n.filter("label <> ''").crossJoin(lengths).select(F.explode(begins).alias("k"), "id", "label", F.lit(2).alias("rule")))
    )
    best = t.join(keys, "k").groupBy("term").agg(F.min(F.struct("rule", F.length("label").alias("n"), "id")).alias("b"))
    return best.select("term", "b.id", F.element_at(F.array(F.lit("id"), F.lit("label"), F.lit("beginning")), F.col("b.rule") + 1).alias("rule"))


def property_rows(nodes: DataFrame, id_col: str, names: list[str]) -> DataFrame:
    """(id, key, value) of a graph's properties, missing ones left out."""
    pairs = F.array(*(F.struct(F.lit(n).alias("key"), F.col(n).cast("string").alias("value")) for n in names))
    return nodes.select(id_col, F.explode(pairs).alias("p")).select(id_col, "p.key", "p.value").filter("value is not null")


def induced(edges: DataFrame, nodes: DataFrame, most_nodes: int = 80, most_edges: int = 160) -> DataFrame:
    """Edges among the first nodes (by rank, then id), of those the first by
    mentions: a picture of bounded size."""
    kept = nodes.orderBy("rank", "id").limit(most_nodes).select("id")
    inner = edges.join(kept.withColumnRenamed("id", "source"), "source", "left_semi").join(kept.withColumnRenamed("id", "target"), "target", "left_semi")
    return inner.orderBy(F.desc("mentions"), "source", "target", "relation").limit(most_edges)
