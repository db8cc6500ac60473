"""Removal of repeated byte strings by hash-compared suffix sorting.

A byte is removed where a string of ``length`` bytes that covers it also starts
earlier in the corpus: in a document with a smaller id, or earlier in the same
document. Strings never cross documents and are judged on the input.

How it is spread over a cluster. Sorting every suffix of the corpus would move
each byte many times over, so suffixes are first sent to where equal ones meet:

1. Each string of ``length`` bytes elects the smallest hash among its k-byte
   substrings (its anchor, k = length / 2). Equal strings elect the same anchor
   at the same place inside them, so one row per anchor (about one per 25 bytes)
   stands for all strings that elect it.
2. Anchors meet by the hash of their k bytes. Within a task equal ones are
   merged first, so an anchor that a third of all documents hold arrives as a
   few rows per ``MERGE`` bytes. Anchors whose whole surroundings repeat are
   settled here: inside a task by their bytes, across tasks by a 64-bit hash of
   the anchor and another of all its bytes.
3. Only anchors whose k bytes repeat in different surroundings (the rims of
   repeated passages) go on, with their bytes. Their suffixes are merge-sorted;
   a comparison finds the common extension of two suffixes by binary search on
   prefix polynomial hashes, and neighbours that agree over the whole length
   are compared byte by byte before they count as equal.
4. Anchors with very many different surroundings are dealt out string by string
   instead, by 128-bit hash, so that no group grows with the corpus.

Nulls and empty texts have nothing to remove. A null id sorts before all ids.
Rows that repeat an id with the same text count as one document and get the
same result; an id with several texts has them in order of their digests.
Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.llm._bytes import BASE_2, U64, PrefixHash, blocks, flat, mix, ranges, windows
from quillmesh.llm._shared import NULL_ID, arrow_schema, emit, stage, versioned, whole_groups

TILE = 2 << 20  #: bytes hashed at once
MERGE = 32 << 20  #: bytes whose anchors are merged before they are sent
CLASSES = 16  #: different surroundings of one anchor that a merge sends on as one group
GROUP = 1024  #: different surroundings beyond which an anchor is dealt out string by string

ANCHORS = "khash long, chash long, doc long, ver int, at long, span int, kind int, classes int"
CONTEXTS = "key long, check long, doc long, ver int, at long, span int, kind int, ctx binary"
RUNS = "doc long, ver int, at long, n int"


def anchors(buf: np.ndarray, offs: np.ndarray, length: int, k: int):
    """(document, first string, last string, anchor, hash of the anchor, hash of
    all its bytes) for each run of strings that elect one anchor."""
    w = length - k + 1
    counts = np.maximum(np.diff(offs) - length + 1, 0)
    starts = ranges(offs[:-1], counts)
    none = np.zeros(0, np.int64)
    if not len(starts):
        return none, none, none, none, none.astype(U64), none.astype(U64)
    ph = PrefixHash(windows(buf))
    kg = mix(ph.every(k - 7))
    m = len(kg)
    low = U64(0xFFFFFF)  # the place, so that the leftmost of equal hashes is elected
    key = (kg & ~low) | np.arange(m, dtype=U64)
    blocked = np.concatenate([key, np.full((-m) % w, ~U64(0))]).reshape(-1, w)
    left = np.minimum.accumulate(blocked, axis=1).ravel()
    right = np.minimum.accumulate(blocked[:, ::-1], axis=1)[:, ::-1].ravel()
    elected = (np.minimum(right[: m - w + 1], left[w - 1 : m]) & low).astype(np.int64)[starts]
    doc = np.repeat(np.arange(len(counts)), counts)
    first = np.flatnonzero(np.r_[True, (np.diff(elected) != 0) | (np.diff(doc) != 0)])
    last = np.r_[first[1:], len(starts)] - 1
    a, b, p = starts[first], starts[last], elected[first]
    shape = ((p - a) * 64 + (b - a)).astype(U64)
    return doc[first], a, b, p, kg[p], mix(ph.span(a, b + length - a - 7) ^ mix(shape))


def _tiled(buf: np.ndarray, offs: np.ndarray, length: int, k: int):
    """anchors() of all documents, in tiles; places are counted from each document's start."""
    for lo, hi in blocks(offs, TILE):
        if hi - lo == 1 and offs[hi] - offs[lo] > 2 * TILE:
            for t in range(int(offs[lo]), int(offs[hi]) - length + 1, TILE):
                end = min(t + TILE + length - 1, int(offs[hi]))
                d, a, b, p, kh, ch = anchors(buf[t:end], np.array([0, end - t]), length, k)
                shift = t - int(offs[lo])
                yield d + lo, a + shift, b + shift, p + shift, kh, ch
            continue
        local = offs[lo : hi + 1] - offs[lo]
        d, a, b, p, kh, ch = anchors(buf[offs[lo] : offs[hi]], local, length, k)
        yield d + lo, a - local[d], b - local[d], p - local[d], kh, ch


def _find_anchors(length: int, k: int):
    _, out = arrow_schema(ANCHORS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vers = batch.column("doc").to_numpy(), batch.column("ver").to_numpy()
            every, offsets = flat(batch.column("text"))
            for lo, hi in blocks(offsets, MERGE):
                buf, offs = every[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                d, a, b, p, kh, ch = (np.concatenate(x) for x in zip(*_tiled(buf, offs, length, k), strict=True))
                if not len(d):
                    continue
                doc, ver = ids[lo:hi][d], vers[lo:hi][d]
                o = np.lexsort((a, ver, doc, ch, kh))
                begin, size = (offs[d] + a)[o], (b - a + length)[o]
                doc, ver, a, kh, ch, span = doc[o], ver[o], a[o], kh[o], ch[o], ((b - a) + 64 * (p - a))[o]
                new_k = np.r_[True, kh[1:] != kh[:-1]]
                new_c = new_k | np.r_[True, ch[1:] != ch[:-1]]
                group, cls = np.cumsum(new_k) - 1, np.cumsum(new_c) - 1
                first = np.flatnonzero(new_c)[cls]
                same = (doc == doc[first]) & (ver == ver[first]) & (a == a[first])  # a repeated row
                classes = np.bincount(group, weights=new_c).astype(np.int64)
                nth = cls - cls[np.flatnonzero(new_k)][group]
                kind = np.where(~same, 1, np.where((classes[group] > CLASSES) & (nth >= 2), 2, 0))
                kind = np.where((kind == 0) & ~new_c, -1, kind)  # the same place twice: once is enough
                told = np.flatnonzero(kind == 1)
                kind[told[~_same_spans(buf, begin[told], begin[first[told]], size[told], size[first[told]])]] = 2  # hashes collide: string by string
                keep = kind >= 0
                scattered = mix(doc.astype(U64) * U64(0x9E3779B97F4A7C15) + a.astype(U64))
                settled = kind != 0  # these only travel to be written; any task will do
                rows = {
                    "khash": np.where(settled, scattered, kh), "chash": np.where(settled, scattered, ch), "doc": doc, "ver": ver, "at": a,
                    "span": span, "kind": kind, "classes": np.where(new_k, classes[group], 0),
                }
                n = np.flatnonzero(keep)
                for i in range(0, len(n), 1 << 17):
                    part = n[i : i + (1 << 17)]
                    yield emit(out, {f.name: rows[f.name][part] for f in out})

    return run


def _first_seen(found: DataFrame) -> DataFrame:
    """Settle anchors whose whole surroundings are known; keep the rims for sorting."""
    same, anchor = Window.partitionBy("khash", "chash"), Window.partitionBy("khash")
    ranked = found.repartition("khash").select(
        "*",
        F.rank().over(same.orderBy("doc", "ver", "at")).alias("nth"),
        F.min("chash").over(anchor).alias("low"),
        F.max("chash").over(anchor).alias("high"),
        F.sum("classes").over(anchor).alias("total"),
        F.max("classes").over(anchor).alias("most"),
    )
    rim = (F.col("kind") == 0) & (F.col("nth") == 1) & (F.col("low") != F.col("high"))
    spread = (F.col("total") > GROUP) | (F.col("most") > CLASSES)
    what = F.when((F.col("kind") == 1) | ((F.col("kind") == 0) & (F.col("nth") > 1)), 0).when(F.col("kind") == 2, 2).when(rim & spread, 2).when(rim, 1)
    return ranked.select("doc", "ver", "at", "span", F.when(what == 1, F.col("khash")).alias("khash"), what.alias("what")).filter("what is not null")


def _contexts(length: int):
    """The bytes around each rim, and for spread-out anchors the hash of each string."""
    _, out = arrow_schema(CONTEXTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every, offsets = flat(batch.column("text"))
            rims = batch.column("rims")
            counts = np.diff(rims.offsets.to_numpy())
            flat_rims = rims.flatten()
            at, span = flat_rims.field("at").to_numpy(), flat_rims.field("span").to_numpy().astype(np.int64)
            key, what = flat_rims.field("khash").fill_null(0).to_numpy(), flat_rims.field("what").to_numpy()
            row = np.repeat(np.arange(batch.num_rows), counts)
            ids, vers = batch.column("doc").to_numpy(), batch.column("ver").to_numpy()
            n = span & 63
            one = np.flatnonzero(what == 1)
            if len(one):
                lo = offsets[row[one]] + at[one]
                size = n[one] + length
                ctx = pa.Array.from_buffers(pa.binary(), len(one), [None, pa.py_buffer(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.py_buffer(np.ascontiguousarray(every[ranges(lo, size)]))])
                zero = np.zeros(len(one), np.int64)
                yield emit(out, {"key": key[one], "check": zero, "doc": ids[row[one]], "ver": vers[row[one]], "at": at[one], "span": span[one], "kind": zero, "ctx": ctx})
            for many in np.array_split(np.flatnonzero(what == 2), 1 + (what == 2).sum() // 20000):
                if not len(many):
                    continue
                size = n[many] + length
                part = every[ranges(offsets[row[many]] + at[many], size)]
                begin = np.cumsum(size) - size
                c = n[many] + 1
                s = ranges(begin, c)
                r = np.repeat(row[many], c)
                place = ranges(at[many], c)
                w = windows(part)
                h1, h2 = mix(PrefixHash(w).span(s, length - 7)), mix(PrefixHash(w, BASE_2).span(s, length - 7))
                doc, ver = ids[r], vers[r]
                o = np.lexsort((place, ver, doc, h2, h1))
                doc, ver, place, h1, h2 = doc[o], ver[o], place[o], h1[o], h2[o]
                new = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
                first = np.flatnonzero(new)[np.cumsum(new) - 1]
                kind = np.where(new, 1, np.where((doc == doc[first]) & (ver == ver[first]) & (place == place[first]), -1, 2))
                keep = np.flatnonzero(kind > 0)
                kind = kind[keep]
                rows = {"key": np.where(kind == 2, h1[keep] ^ mix(place[keep].astype(U64)), h1[keep]), "check": h2[keep], "doc": doc[keep], "ver": ver[keep], "at": place[keep], "span": np.zeros(len(keep), np.int32), "kind": kind}
                yield emit(out, rows | {"ctx": pa.nulls(len(keep), pa.binary())})

    return run


def merge_sort(ph: PrefixHash, buf: np.ndarray, starts: np.ndarray, groups: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Stable merge sort of suffixes inside each group (``groups`` ascending).

    Returns the order and, for each place but the first, how far a suffix
    agrees with the one before it (0 across groups). All elements of a level
    are merged at once: each finds its place in the run beside its own by
    binary search, and each of those comparisons finds the common extension by
    binary search on the prefix hashes.
    """
    n = len(starts)
    order = np.arange(n)
    head = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    size = np.diff(np.r_[head, n])
    begin, end = np.repeat(head, size), np.repeat(head + size, size)

    def common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        lo, hi = np.zeros(len(x), np.int64), np.full(len(x), length, np.int64)
        while True:
            open_ = lo < hi
            if not open_.any():
                return lo
            mid = (lo + hi + 1) // 2
            agree = ph.span(x, mid) == ph.span(y, mid)
            lo, hi = np.where(open_ & agree, mid, lo), np.where(open_ & ~agree, mid - 1, hi)

    width = 1
    while n and width < size.max():
        at = np.flatnonzero(end - begin > width)
        local = at - begin[at]
        run = local // width
        lo = np.minimum(begin[at] + (run ^ 1) * width, end[at])
        hi = np.minimum(lo + width, end[at])
        other, mine, right = lo.copy(), starts[order[at]], (run & 1) == 1
        while True:
            live = np.flatnonzero(lo < hi)
            if not len(live):
                break
            mid = (lo[live] + hi[live]) // 2
            x, y = starts[order[mid]], mine[live]
            far = common(x, y)
            full = far >= length
            inside = np.minimum(far, length - 1)
            less = np.where(full, right[live], buf[x + inside] < buf[y + inside])  # of equals the left run's come first
            lo[live] = np.where(less, mid + 1, lo[live])
            hi[live] = np.where(less, hi[live], mid)
        place = begin[at] + (run // 2) * 2 * width + (local - run * width) + (lo - other)
        moved = order.copy()
        moved[place] = order[at]
        order = moved
        width *= 2
    agree = np.zeros(n, np.int64)
    if n > 1:
        pairs = np.flatnonzero(groups[1:] == groups[:-1]) + 1
        agree[pairs] = common(starts[order[pairs - 1]], starts[order[pairs]])
    return order, agree


def _same_bytes(buf: np.ndarray, x: np.ndarray, y: np.ndarray, length: int) -> np.ndarray:
    out = np.ones(len(x), bool)
    step = np.arange(length)
    for i in range(0, len(x), 20000):
        a, b = x[i : i + 20000], y[i : i + 20000]
        out[i : i + 20000] = (buf[a[:, None] + step] == buf[b[:, None] + step]).all(axis=1)
    return out


def _same_spans(buf: np.ndarray, x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """Whether the bytes [x, x + nx) and [y, y + ny) are equal."""
    out = nx == ny
    for i in range(0, len(x), 20000):
        at = np.flatnonzero(out[i : i + 20000]) + i
        n = nx[at]
        unlike = buf[ranges(x[at], n)] != buf[ranges(y[at], n)]
        out[at] = np.add.reduceat(unlike, np.cumsum(n) - n) == 0 if len(at) else out[at]
    return out


def _runs(doc: np.ndarray, ver: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    o = np.lexsort((at, ver, doc))
    doc, ver, at = doc[o], ver[o], at[o]
    new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (ver[1:] != ver[:-1]) | (at[1:] > at[:-1] + 1)]) if len(o) else np.zeros(0, np.int64)
    last = np.r_[new[1:], len(o)] - 1 if len(o) else new
    return {"doc": doc[new], "ver": ver[new], "at": at[new], "n": at[last] - at[new]}


def _settle(length: int):
    """Sort the suffixes of each group; every string but the earliest of equals is repeated."""
    _, out = arrow_schema(RUNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["key"], 20000):
            col = {c: t.column(c).to_numpy() for c in ("key", "check", "doc", "ver", "at", "span", "kind")}
            done = col["kind"] == 2
            parts = [(col["doc"][done], col["ver"][done], col["at"][done])]
            hashed = np.flatnonzero(col["kind"] == 1)
            if len(hashed):
                key, check, doc, ver, at = (col[c][hashed] for c in ("key", "check", "doc", "ver", "at"))
                o = np.lexsort((at, ver, doc, check, key))
                key, check, doc, ver, at = key[o], check[o], doc[o], ver[o], at[o]
                new = np.r_[True, (key[1:] != key[:-1]) | (check[1:] != check[:-1])]
                f = np.flatnonzero(new)[np.cumsum(new) - 1]
                later = (doc != doc[f]) | (ver != ver[f]) | (at != at[f])
                parts.append((doc[later], ver[later], at[later]))
            rims = np.flatnonzero(col["kind"] == 0)
            if len(rims):
                buf, offs = flat(t.column("ctx").combine_chunks().take(pa.array(rims)))
                span = col["span"][rims].astype(np.int64)
                c = (span & 63) + 1
                row = np.repeat(np.arange(len(rims)), c)
                step = ranges(np.zeros(len(rims), np.int64), c)
                key, doc, ver, at = col["key"][rims][row], col["doc"][rims][row], col["ver"][rims][row], col["at"][rims][row] + step
                rel = step - (span >> 6)[row]  # place before the anchor: only equal ones can agree
                o = np.lexsort((at, ver, doc, rel, key))
                key, rel, doc, ver, at, start = key[o], rel[o], doc[o], ver[o], at[o], (offs[:-1][row] + step)[o]
                group = np.cumsum(np.r_[True, (key[1:] != key[:-1]) | (rel[1:] != rel[:-1])])
                order, agree = merge_sort(PrefixHash(buf), buf, start, group, length)
                doc, ver, at, start = doc[order], ver[order], at[order], start[order]
                equal = agree >= length
                pairs = np.flatnonzero(equal)
                equal[pairs] = _same_bytes(buf, start[pairs - 1], start[pairs], length)
                f = np.flatnonzero(~equal)[np.cumsum(~equal) - 1]
                later = (doc != doc[f]) | (ver != ver[f]) | (at != at[f])
                parts.append((doc[later], ver[later], at[later]))
            doc, ver, at = (np.concatenate(x) for x in zip(*parts, strict=True))
            if len(doc):
                yield emit(out, _runs(doc, ver, at))

    return run


def _cut(length: int):
    schema = pa.schema([("doc", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = flat(batch.column("text"))
            runs = batch.column("runs")
            rows = {f.name: [] for f in schema}
            for i, doc in enumerate(batch.column("doc").to_numpy().tolist()):
                raw = buf[offs[i] : offs[i + 1]]
                size, spans, kept = len(raw), [], raw
                if runs[i].is_valid and len(runs[i].values):
                    v = runs[i].values
                    lo = v.field("at").to_numpy()
                    hi = np.minimum(lo + v.field("n").to_numpy() + length, size)
                    edge = np.zeros(size + 1, np.int64)
                    np.add.at(edge, lo, 1)
                    np.add.at(edge, hi, -1)
                    gone = np.cumsum(edge)[:size] > 0
                    flips = np.flatnonzero(np.diff(np.r_[0, gone.view(np.int8), 0]))
                    spans = [{"start": int(s), "end": int(e)} for s, e in zip(flips[::2], flips[1::2], strict=True)]
                    kept = raw[~gone]
                rows["doc"].append(doc)
                rows["n_bytes"].append(size)
                rows["n_removed"].append(size - len(kept))
                rows["n_spans"].append(len(spans))
                rows["kept_sha256"].append(hashlib.sha256(kept.tobytes()).hexdigest())
                rows["spans"].append(spans)
            yield pa.RecordBatch.from_pydict(rows, schema=schema)

    return run


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100) -> DataFrame:
    """Per document: id, n_bytes, n_removed, n_spans, kept_sha256 and the removed
    byte ranges ``spans`` (start, end exclusive)."""
    if length < 16 or length > 120:
        raise ValueError("length must lie between 16 and 120 bytes")
    k = length // 2
    texts, keys = versioned(docs, id_col, text_col)
    found = texts.mapInArrow(_find_anchors(length, k), ANCHORS)
    known = stage(_first_seen(found), "suffix-anchors")
    rims = known.filter("what > 0").groupBy(*keys).agg(F.collect_list(F.struct("at", "span", "khash", "what")).alias("rims"))
    # both joins below read the texts dealt by the same keys, which Spark shuffles once
    joined = texts.join(rims, keys).select("doc", "ver", "text", "rims")
    settled = joined.mapInArrow(_contexts(length), CONTEXTS).repartition("key").sortWithinPartitions("key").mapInArrow(_settle(length), RUNS)
    whole = known.filter("what = 0").select("doc", "ver", "at", F.expr("span & 63").alias("n"))
    runs = whole.unionByName(settled).groupBy(*keys).agg(F.collect_list(F.struct("at", "n")).alias("runs"))
    both = texts.join(runs, keys, "left").select("doc", "text", "runs")
    out = both.mapInArrow(_cut(length), "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>")
    return out.select(F.when(F.col("doc") != NULL_ID, F.col("doc")).alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")
