"""Secret scanning through a trigram inverted index.

Every rule is a regular expression. From its syntax tree follows a Boolean
query over byte trigrams that any match must satisfy (alternatives are OR-ed,
sequences AND-ed, optional parts add nothing). Documents are indexed in blocks:
the postings of just those trigrams that some rule asks for are gathered with
one pass of array operations, the query intersects and unites them, and only
the candidates are verified with the regular expression itself. A rule from
which no mandatory trigram follows (a wide character class) scans every
document.

The block is the unit of the index because its postings are as large as the
text itself: built where the text already is, nothing is shuffled, and a lost
executor costs its own blocks only.

A null text counts as empty. Rows with null ids and repeated rows are scanned
like any other; extra columns are ignored. Spans count code points.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as _C  # the syntax trees of the standard library
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillmesh.llm._bytes import blocks, flat
from quillmesh.llm._shared import arrow_schema

BLOCK = 4 << 20
KEEP = 8  #: largest number of strings that a part of a pattern may stand for


@dataclass(frozen=True)
class Rule:
    """A named pattern. ``group`` must have at least ``least`` characters, and
    shorter matches are dropped after matching."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    base: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII)


BASE_RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 16, 0, True),
    Rule("hex", r"[0-9a-f]+", 32, 0, True),
)

#: Further kinds, in widely published forms.
MORE_RULES = (
    Rule("pem", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |ENCRYPTED )?PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]+"),  # each run is read once
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("bearer", r"[Aa]uthorization: [Bb]earer [A-Za-z0-9._~+/-]{16,}=*"),
)

RULES = BASE_RULES + MORE_RULES

# A trigram query is True (no condition), a trigram, or ("and" | "or", parts).
Query = bool | bytes | tuple


def _and(*parts: Query) -> Query:
    flat_parts: list[Query] = []
    for p in parts:
        if p is True:
            continue
        flat_parts.extend(p[1] if isinstance(p, tuple) and p[0] == "and" else [p])
    unique = list(dict.fromkeys(flat_parts))
    return True if not unique else unique[0] if len(unique) == 1 else ("and", tuple(unique))


def _or(*parts: Query) -> Query:
    if not parts or any(p is True for p in parts):
        return True
    unique = list(dict.fromkeys(parts))
    return unique[0] if len(unique) == 1 else ("or", tuple(unique))


def _trigrams(text: bytes) -> Query:
    return _and(*(text[i : i + 3] for i in range(len(text) - 2)))


class _Walk:
    """Runs of exact strings through a syntax tree, turned into trigrams when
    they end. All text is folded to lower case, as the index is."""

    def __init__(self) -> None:
        self.done: Query = True
        self.exact: set[bytes] | None = {b""}

    def flush(self) -> None:
        if self.exact:
            self.done = _and(self.done, _or(*(_trigrams(x) for x in sorted(self.exact))))
        self.exact = None

    def strings(self, choices: set[bytes]) -> None:
        have = self.exact if self.exact is not None else {b""}
        joined = {a + b for a in have for b in choices}
        if len(joined) > KEEP * 4 or any(len(x) > 64 for x in joined):
            self.flush()
            joined = set(choices)
        self.exact = joined

    def gap(self) -> None:
        self.flush()
        self.exact = {b""}


def _folded(code: int) -> bytes:
    return chr(code).lower().encode()


def _members(items: list) -> set[bytes] | None:
    out: set[bytes] = set()
    for op, arg in items:
        if op is _C.LITERAL:
            out.add(_folded(arg))
        elif op is _C.RANGE and arg[1] - arg[0] < KEEP:
            out |= {_folded(c) for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return out if len(out) <= KEEP else None


def _visit(tree, walk: _Walk) -> None:
    for op, arg in tree:
        if op is _C.LITERAL:
            walk.strings({_folded(arg)})
        elif op is _C.IN and (got := _members(arg)) is not None:
            walk.strings(got)
        elif op is _C.SUBPATTERN:
            _visit(arg[3], walk)
        elif op is _C.BRANCH:
            walk.flush()
            walk.done = _and(walk.done, _or(*(query_of_tree(b) for b in arg[1])))
            walk.gap()
        elif op in (_C.MAX_REPEAT, _C.MIN_REPEAT, _C.POSSESSIVE_REPEAT):
            least, most, inner = arg
            single = _Walk()
            _visit(inner, single)
            if least == 0 and most == 1 and single.done is True and single.exact:
                walk.strings(single.exact | {b""})
            else:
                for _ in range(min(least, 3)):
                    _visit(inner, walk)
                if most != least or least > 3:
                    walk.gap()
        elif op is not _C.AT:  # anything else may be any string
            walk.gap()


def query_of_tree(tree) -> Query:
    walk = _Walk()
    _visit(tree, walk)
    walk.flush()
    return walk.done


def trigram_query(pattern: str) -> Query:
    """The Boolean trigram query that every match of ``pattern`` satisfies; True
    where no trigram is mandatory."""
    return query_of_tree(_parser.parse(pattern, re.ASCII))


def _wanted(query: Query) -> set[bytes]:
    if isinstance(query, bytes):
        return {query}
    return set() if query is True else set().union(*map(_wanted, query[1]))


class TrigramIndex:
    """Postings of the wanted trigrams over one block of documents."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, wanted: list[bytes]):
        self.n = len(offs) - 1
        self.postings = {t: np.zeros(0, np.int64) for t in wanted}
        if len(buf) < 3 or not wanted:
            return
        fold = np.arange(256, dtype=np.uint8)
        fold[65:91] += 32
        low = fold[buf]
        hit = np.zeros(len(low) - 2, bool)  # places where some wanted trigram may start
        seconds: dict[int, set[int]] = {}
        for t in wanted:
            seconds.setdefault(t[0] << 8 | t[1], set()).add(t[2])
        pair = low[:-2].astype(np.uint16) << 8 | low[1:-1]
        table = np.zeros(1 << 16, bool)
        table[list(seconds)] = True
        hit = np.flatnonzero(table[pair])
        code = pair[hit].astype(np.uint32) << 8 | low[hit + 2]
        codes = np.array(sorted(int.from_bytes(t, "big") for t in wanted), np.uint32)
        at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
        found = codes[at] == code
        hit, at = hit[found], at[found]
        doc = np.searchsorted(offs, hit, side="right") - 1
        inside = hit + 3 <= offs[doc + 1]
        both = np.unique(at[inside] * np.int64(self.n) + doc[inside])
        at, doc = both // self.n, both % self.n
        cuts = np.searchsorted(at, np.arange(len(codes) + 1))
        for i, c in enumerate(codes.tolist()):
            self.postings[int(c).to_bytes(3, "big")] = doc[cuts[i] : cuts[i + 1]]

    def candidates(self, query: Query) -> np.ndarray:
        if query is True:
            return np.arange(self.n)
        if isinstance(query, bytes):
            return self.postings[query]
        parts = [self.candidates(p) for p in query[1]]
        if query[0] == "and":
            parts.sort(key=len)  # the rarest first
            out = parts[0]
            for p in parts[1:]:
                out = np.intersect1d(out, p, assume_unique=True)
            return out
        return np.unique(np.concatenate(parts))


def matches(rule: Rule, pattern: re.Pattern, text: str) -> Iterator[tuple[int, int]]:
    for m in pattern.finditer(text):
        if m.end(rule.group) - m.start(rule.group) >= rule.least:
            yield m.span()


def _scanner(rules: tuple[Rule, ...], redact: str | None):
    order = {r.kind: i for i, r in enumerate(rules)}
    queries = [trigram_query(r.pattern) for r in rules]
    wanted = sorted(set().union(*map(_wanted, queries)))
    # a rule that scans everything may look for its shortest kept match at once
    patterns = [re.compile(r.pattern[:-1] + f"{{{r.least},}}", re.ASCII) if q is True and re.fullmatch(r"\[[^\]]+\]\+", r.pattern) and r.least and r.group == 0 else r.compiled() for r, q in zip(rules, queries, strict=True)]
    base = {r.kind for r in rules if r.base}

    def scan(column) -> tuple[list[list[tuple[int, int, str]]], list[str]]:
        texts = column.fill_null("").to_pylist() if column.null_count else column.to_pylist()
        found: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        buf, offs = flat(column)
        for lo, hi in blocks(offs, BLOCK):
            index = TrigramIndex(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], wanted)
            for rule, query, pattern in zip(rules, queries, patterns, strict=True):
                for d in index.candidates(query).tolist():
                    found[lo + d] += [(s, e, rule.kind) for s, e in matches(rule, pattern, texts[lo + d])]
        for f in found:
            f.sort(key=lambda m: (m[0], order[m[2]]))
        return found, texts

    return scan, base


SPANS = "array<struct<kind:string,start:long,end:long>>"


def secret_spans(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``spans`` of all rules in order of start and rule, and
    ``base_sha256`` over those of the base rules."""
    from pyspark.sql import functions as F

    fields = [f for f in docs.schema if f.name in keep]
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)
    schema, out = arrow_schema(f"{ddl}, spans {SPANS}, base_sha256 string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, base = _scanner(rules, None)
        for b in batches:
            found, _ = scan(b.column("_text"))
            digests = [hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in f if k in base).encode()).hexdigest() for f in found]
            spans = pa.array([[{"kind": k, "start": s, "end": e} for s, e, k in f] for f in found], type=out.field("spans").type)
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in fields), spans, pa.array(digests, pa.string())], schema=pa.schema([*(b.schema.field(f.name) for f in fields), out.field("spans"), out.field("base_sha256")]))

    return docs.select(*keep, F.col(text_col).alias("_text")).mapInArrow(run, schema)


def redact(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """The same rows with every found span (overlapping ones together) replaced
    by ``mark``. A null text stays null; texts without secrets stay as they are."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, _ = _scanner(rules, mark)
        for b in batches:
            column = b.column(at)
            found, texts = scan(column)
            if any(found):
                null = column.is_null().to_pylist() if column.null_count else None
                out = []
                for i, (f, t) in enumerate(zip(found, texts, strict=True)):
                    if f:
                        parts, end, upto = [], 0, 0
                        for s, e, _k in f:
                            if s >= upto:
                                parts += [t[end:s], mark]
                                end = upto = e
                            else:
                                end = upto = max(upto, e)
                        t = "".join([*parts, t[end:]])
                    out.append(None if null and null[i] else t)
                columns = list(b.columns)
                columns[at] = pa.array(out, type=column.type)
                b = pa.RecordBatch.from_arrays(columns, schema=b.schema)
            yield b

    return docs.mapInArrow(run, docs.schema)
