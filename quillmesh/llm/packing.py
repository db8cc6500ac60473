"""Packing token sequences into fixed windows by best-fit decreasing.

A document's ids, followed by an end id, are cut into full windows first; what
is left of it is one piece shorter than a window. Pieces are packed longest
first, each into the tightest window that still holds it, which a segment tree
over remaining capacities finds in as many steps as the window has bits.

Tokenizing is a map over documents; its small result (places, lengths and
checksums) is written to the shared folder. Pieces are then dealt by hash of
their document and their place in the task that cut them (so that a row repeated
ever so often is spread as well) into shards of about ``SHARD`` pieces whose
number follows the input, and each shard is packed on its own. A shard leaves few windows unfilled, so padding keeps its
share at every size, and no task holds more than its shard.

Null texts are empty: one piece with the end id alone. Rows that repeat, and
rows with null ids, are packed like all others. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm._shared import arrow_schema, emit, stage, whole_groups
from quillmesh.llm._tokens import BytePairEncoder

SHARD = 16_384
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, deal long"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_ENCODERS: dict[str, BytePairEncoder] = {}


def _pieces(path: str, window: int, end_id: int):
    _, out = arrow_schema(PIECES)
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ENCODERS.get(path) or _ENCODERS.setdefault(path, BytePairEncoder(path))
        deal = 0
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                ids = part.column("doc_id").to_pylist()
                rows: list[tuple] = []
                for doc, raw in zip(ids, encoder.encode(part.column("text").fill_null("").to_pylist()), strict=True):
                    raw += end
                    n = len(raw) // 4
                    for s in range(0, n, window):
                        piece = raw[4 * s : 4 * (s + window)]
                        rows.append((doc, s, len(piece) // 4, zlib.crc32(piece), n, deal))
                        deal += 1
                yield emit(out, {f.name: pa.array(c, pa.int64()) for f, c in zip(out, zip(*rows, strict=True), strict=True)})

    return run


class Capacities:
    """Segment tree over the remaining capacities 0..size of open windows."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, capacity: int, window: int) -> None:
        self.open[capacity].append(window)
        i = capacity + self.leaves
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """A window with the smallest capacity of at least ``need``, and that capacity."""
        count, i = self.count, need + self.leaves
        if not count[i]:
            while i > 1 and (i & 1 or not count[i + 1]):  # up, until something lies to the right
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if count[2 * i] else 2 * i + 1
        capacity = i - self.leaves
        window = self.open[capacity].pop()
        while i:
            count[i] -= 1
            i >>= 1
        return window, capacity


def best_fit_decreasing(lengths: list[int], size: int) -> tuple[list[int], list[int]]:
    """(window, offset) of each piece; ``lengths`` must not increase."""
    tree, windows, offsets, made = Capacities(size), [], [], 0
    for n in lengths:
        if n > size:
            raise ValueError("a piece is longer than a window")
        got = tree.take(n) if n < size else None
        if got is None:
            got, made = (made, size), made + 1
        window, capacity = got
        windows.append(window)
        offsets.append(size - capacity)
        if capacity > n:
            tree.add(capacity - n, window)
    return windows, offsets


def _pack(window: int):
    _, out = arrow_schema(PACKED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["shard"], SHARD):
            shard = t.column("shard").to_numpy()
            cols = {c: t.column(c).combine_chunks() for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")}
            length, start, crc = (cols[c].to_numpy() for c in ("length", "start", "ids_crc32"))
            doc = cols["doc_id"].fill_null(-(1 << 63)).to_numpy()
            order = np.lexsort((crc, start, doc, -length, shard))
            heads = np.flatnonzero(np.r_[True, np.diff(shard[order]) != 0])
            sequence, offset = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
            for lo, hi in zip(heads, [*heads[1:], len(order)], strict=True):
                rows = order[lo:hi]
                w, o = best_fit_decreasing(length[rows].tolist(), window)
                sequence[rows] = (int(shard[rows[0]]) << 32) + np.asarray(w, np.int64)
                offset[rows] = o
            yield emit(out, {c: v for c, v in cols.items()} | {"sequence_id": sequence, "offset": offset})

    return run


def pack(docs: DataFrame, vocabulary: str, window: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", shard: int = SHARD) -> DataFrame:
    """Every piece of every document with its window (``sequence_id``) and place there."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = stage(texts.mapInArrow(_pieces(vocabulary, window, end_id), PIECES), "pieces")
    shards = max(1, -(-pieces.count() // shard))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "deal"), F.lit(shards)))
    out = dealt.drop("deal").repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(_pack(window), PACKED)
    return out.withColumnRenamed("doc_id", id_col) if id_col != "doc_id" else out
