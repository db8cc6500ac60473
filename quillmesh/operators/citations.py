"""Citations in stored answers, pointed at the ids that their chunks have now.

Answers are JSON texts. A citation is a token such as ``PKG:531``: the value of a
``chunk_id``, a key of a map, or a word in prose. It is rewritten in all three, but
not in text that was copied out of a document. The text is scanned once, from
string to string, and keeps every byte that is no citation.

Only the tokens that an answer holds are looked up, by an equi-join with the table
of moves, which may so be of any size; each answer then gets its own few moves.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The shape of a citation, the field that holds one, and the fields of copied text.
CITATION = re.compile(r"\b[A-Z][A-Z0-9_]*:\d+\b", re.ASCII)
ID_FIELD = "chunk_id"
COPIED = frozenset("quote content text full_text excerpt snippet markdown".split())

_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[][{}:,]', re.DOTALL)


def rewritten(answer: str, moved: Callable[[str], str | None]) -> str:
    """The answer with each citation replaced by what ``moved`` says, if anything."""
    out, at = [], 0
    # of each open container: whether it is a map, whether its text is copied, and its current key
    stack: list[list] = []
    key_next = False

    def swap(m: re.Match) -> str:
        return moved(m[0]) or m[0]

    for token in _TOKEN.finditer(answer):
        sign = token[0]
        if sign in "{[":
            copied = bool(stack) and (stack[-1][1] or stack[-1][2] in COPIED)
            stack.append([sign == "{", copied, None])
            key_next = sign == "{"
        elif sign in "}]":
            if stack:
                stack.pop()
            key_next = False
        elif sign == ",":
            key_next = bool(stack) and stack[-1][0]
            if key_next:
                stack[-1][2] = None
        elif sign != ":":
            body = sign[1:-1]
            if key_next:
                key_next, stack[-1][2] = False, body
                whole, copied = True, False
            else:
                name = stack[-1][2] if stack else None
                whole = name == ID_FIELD
                copied = not whole and bool(stack) and (stack[-1][1] or name in COPIED)
            new = body if copied else ((moved(body) or body) if CITATION.fullmatch(body) else body) if whole else CITATION.sub(swap, body)
            if new != body:
                out += [answer[at : token.start() + 1], new]
                at = token.end() - 1
    return "".join([*out, answer[at:]])


def cited(answer: str | None) -> list[str]:
    """The distinct tokens that a rewriting would look up."""
    found: dict[str, None] = {}
    rewritten(answer or "", lambda token: found.setdefault(token))
    return list(found)


def _tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"row": b["row"], "tokens": b["answer"].map(cited)})


def _rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        maps = [dict(zip(o, n, strict=True)) if o is not None else {} for o, n in zip(b["olds"], b["news"], strict=True)]
        yield b[["row"]].assign(answer=[a if a is None or not m else rewritten(a, m.get) for a, m in zip(b["answer"], maps, strict=True)], moved=[len(m) for m in maps])


def remap_citations(answers: DataFrame, moves: DataFrame, id_col: str, answer_col: str) -> DataFrame:
    """(id, answer, moved): each answer (ids are unique) with its citations at their new
    ids, and how many different ones moved. ``moves``: (old, new) tokens, one row an old
    one. Null answers stay null."""
    rows = answers.select(F.col(id_col).alias("row"), F.col(answer_col).alias("answer"))
    kind = dict(rows.dtypes)["row"]
    held = rows.filter("answer is not null").mapInPandas(_tokens, f"row {kind}, tokens array<string>")
    found = held.select("row", F.explode("tokens").alias("old")).join(moves.select("old", "new"), "old").filter("old <> new")
    each = found.groupBy("row").agg(F.collect_list(F.struct("old", "new")).alias("m"))  # one answer's citations
    j = rows.join(each, "row", "left").select("row", "answer", F.col("m.old").alias("olds"), F.col("m.new").alias("news"))
    return j.mapInPandas(_rewrite, f"row {kind}, answer string, moved int").withColumnRenamed("row", id_col).withColumnRenamed("answer", answer_col)
