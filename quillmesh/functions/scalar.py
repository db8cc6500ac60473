"""Scalar expressions used across the engine, all on the JVM side."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

TERM = r"[\p{L}\p{N}]+"


def terms(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order, repeats kept."""
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def token_estimate(text: Column) -> Column:
    """About four characters a token, and at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int"))


def ceil_div(a: Column, b: int | Column) -> Column:
    return F.ceil(a / b).cast("long")


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays taken as sets; null where both are empty."""
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double"))


def title_tokens(title: Column, stop: tuple[str, ...] = ("the", "a", "of", "and", "for", "v1", "v2", "final", "draft")) -> Column:
    found = F.array_distinct(terms(title))
    return F.filter(F.array_except(found, F.array(*map(F.lit, stop))), lambda t: F.length(t) > 1)


def code_sort_key(code: Column) -> Column:
    """Dotted codes in numeric order: 4.9 before 4.10."""
    return F.transform(F.split(code, r"\."), lambda x: F.coalesce(x.try_cast("int"), F.lit(-1)))


def code_level(code: Column) -> Column:
    """Depth of a dotted code; a trailing .0 is the value chain itself."""
    return F.when(code.rlike(r"^\d+\.0$"), 1).when(code.rlike(r"^\d+(\.\d+)+$"), F.size(F.split(code, r"\.")))


def code_parent(code: Column) -> Column:
    parts = F.split(code, r"\.")
    n = F.size(parts)
    return (
        F.when(code.rlike(r"^\d+\.0$"), F.lit(None).cast("string"))
        .when(n == 2, F.concat(parts[0], F.lit(".0")))
        .when(n > 2, F.array_join(F.slice(parts, 1, n - 1), "."))
    )


def code_rollup(code: Column, parts: int = 3) -> Column:
    return F.substring_index(code, ".", parts)


def under(code: Column, root: str) -> Column:
    """A code is under a root when it is the root or starts with it and a dot."""
    return (code == root) | code.startswith(root + ".")


def expand_codes(text: Column) -> Column:
    """Hyphenated codes also as runs: M-090-030-010 gives m090030, m090030010."""
    found = F.regexp_extract_all(text, F.lit(r"\b([A-Z](?:-\d{3}){2,})\b"), F.lit(1))
    joined = F.transform(found, lambda c: F.transform(F.sequence(F.lit(3), F.size(F.split(c, "-"))), lambda n: F.lower(F.array_join(F.slice(F.split(c, "-"), F.lit(1), n), ""))))
    return F.array_distinct(F.flatten(joined))


def iso_week(ts: Column) -> Column:
    return F.concat(F.extract(F.lit("YEAROFWEEK"), ts).cast("string"), F.lit("-"), F.lpad(F.weekofyear(ts).cast("string"), 2, "0"))


def clock(minutes: Column) -> Column:
    """Minutes as h:mm."""
    m = minutes.cast("int")
    return F.concat(F.floor(m / 60).cast("string"), F.lit(":"), F.lpad((m % 60).cast("string"), 2, "0"))


def normal_text(text: Column) -> Column:
    """For comparing quotes: plain quotes and dashes, no mark-up, single blanks, lower case."""
    plain = F.translate(text, "‘’“”–— ", "''\"\"-- ")
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(plain, r"[*_`|#>]+", " "), r"\s+", " ")))


def question_key(text: Column, size: int = 120) -> Column:
    return F.left(F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", " ")), F.lit(size))


def word_limit(text: Column, words: int = 120) -> Column:
    w = F.split(F.trim(text), r"\s+")
    return F.when(F.size(w) > words, F.concat(F.array_join(F.slice(w, 1, words), " "), F.lit("…"))).otherwise(text)


def verdict_number(raw: Column) -> Column:
    """yes / no words, numbers and NaN as a value in [0, 1], or null."""
    word = F.lower(F.trim(raw))
    number = F.nanvl(word.try_cast("double"), F.lit(None).cast("double"))
    return F.when(word.isin("yes", "true", "pass"), 1.0).when(word.isin("no", "false", "fail"), 0.0).otherwise(F.when(number.isNotNull(), clamp(number, 0.0, 1.0)))


def glob_like(name: Column, *globs: str) -> Column:
    """Any of the globs, without regard to case."""
    pattern = "|".join("".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in g.lower()) for g in globs)
    return F.lower(name).rlike(f"^(?s:{pattern})$") if globs else F.lit(False)


def allowed_host(url: Column, hosts: tuple[str, ...]) -> Column:
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    hit = F.lit(False)
    for h in hosts:
        hit = hit | (host == h) | host.endswith("." + h)
    return F.coalesce(hit, F.lit(False))


def distinct_line_share(text: Column) -> Column:
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.try_divide(F.size(F.array_distinct(lines)).cast("double"), F.size(lines).cast("double"))


def cell_escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("|"), F.lit("\\|")), r"\s*\n\s*", " ")


def table_cells(row: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(F.trim(row), r"^\||\|$", ""), r"(?<!\\)\|"), lambda x: F.trim(x))


def canonical_json(arguments: Column) -> Column:
    """A map as JSON with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(arguments))))


def stable_id(*parts: Column, size: int = 32) -> Column:
    """The same parts always give the same id, so that writing again replaces."""
    return F.left(F.sha2(F.concat_ws(":", *parts), 256), F.lit(size))


def status_band(x: Column) -> Column:
    return F.when(x >= 0.7, "good").when(x >= 0.4, "fair").when(x.isNotNull(), "poor")


def box_distance(px: Column, py: Column, left: Column, top: Column, right: Column, bottom: Column) -> Column:
    """Euclidean distance of a point to a box, 0 inside."""
    dx = F.greatest(left - px, F.lit(0), px - right)
    dy = F.greatest(top - py, F.lit(0), py - bottom)
    return F.sqrt(dx * dx + dy * dy)


def letter_number_key(item: Column) -> Column:
    """Q2 before Q10: letters first, then the number."""
    return F.struct(F.regexp_extract(item, r"^([A-Za-z]*)", 1).alias("letters"), F.coalesce(F.regexp_extract(item, r"(\d+)", 1).try_cast("int"), F.lit(-1)).alias("number"))


def option_index(comment: Column) -> Column:
    """0 for "Option A: ...", 1 for B, and so on; null where no option is named."""
    letter = F.regexp_extract(comment, r"(?i)^\s*option\s+([a-h])\b", 1)
    return F.when(letter != "", F.ascii(F.upper(letter)) - F.lit(65))


def step_refs(text: Column) -> Column:
    """References in a cell: split at commas, semicolons, slashes and "and"."""
    parts = F.split(text, r"[,;/]|\band\b")
    return F.array_distinct(F.filter(F.transform(parts, lambda x: F.upper(F.trim(x))), lambda x: x != ""))


def short_label(text: Column, size: int = 90) -> Column:
    """Up to the first bracket, cut at a word boundary."""
    head = F.trim(F.regexp_extract(text, r"^([^(\[]*)", 1))
    cut = F.regexp_extract(F.left(head, F.lit(size)), r"^(.*)\s", 1)
    return F.when(F.length(head) <= size, head).otherwise(F.concat(cut, F.lit("…")))


def cell_format(value: Column, kind: str) -> Column:
    """A cell as text: TRUE and FALSE, midnight as a date alone, whole numbers without a point."""
    if kind == "boolean":
        return F.upper(value.cast("string"))
    if kind == "timestamp":
        return F.when(F.date_trunc("day", value) == value, F.date_format(value, "yyyy-MM-dd")).otherwise(F.date_format(value, "yyyy-MM-dd HH:mm"))
    if kind == "double":
        return F.when(value == F.floor(value), value.cast("long").cast("string")).otherwise(value.cast("string"))
    return value.cast("string")


def path_named(path: Column, name: str) -> Column:
    """A path has a file name when it is the name or ends in / and the name."""
    return (path == name) | path.endswith("/" + name)


def mask_words(text: Column, *words: str, mask: str = "•••") -> Column:
    """Whole words, of letters of any script, replaced by a mask."""
    return F.regexp_replace(text, r"(?<![\p{L}\p{N}_])(?:" + "|".join(map(re.escape, words)) + r")(?![\p{L}\p{N}_])", mask)


def key_agrees(key: Column, category: Column, id_: Column) -> Column:
    """Whether "CATEGORY:id", or the id alone, names this row."""
    digits = F.substring_index(key, ":", -1) == id_.cast("string")
    return digits & (~key.contains(":") | (F.regexp_replace(key, r":[^:]*$", "") == category))


def keys_that_differ(a: Column, b: Column, *keys: str) -> Column:
    """Those of the keys whose values differ in two maps; an absent one is empty."""
    of = lambda m, k: F.coalesce(F.try_element_at(m, k), F.lit(""))
    return F.filter(F.array(*map(F.lit, keys)), lambda k: of(a, k) != of(b, k))
