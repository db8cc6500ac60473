"""Nearest rows of a question set, block against block in Arrow batches.

Vectors and questions are dealt over a grid of cells of bounded size. A matrix
product finds in each cell what may be among the best; only that is scored
component by component, in the order in which a Spark expression sums, and each
cell passes on its own best. So all pairs are looked at, and few become rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PER_BLOCK = 4096  #: vectors, and questions, of one cell
AT_ONCE = 256  #: questions of one matrix product


def by_parts(a: np.ndarray, b: np.ndarray, part: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum of part(x, y) over the columns, from left to right, as F.aggregate adds."""
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        out += part(a[:, i], b[:, i])
    return out


def rounded(x: np.ndarray, digits: int = 6) -> np.ndarray:
    """As F.round rounds doubles: half up in the shortest decimal that names the number."""
    scale = 10.0**digits
    y = np.abs(x) * scale
    low = np.floor(y)
    out = np.copysign(np.where(y - low >= 0.5, low + 1, low) / scale, x)
    for i in np.flatnonzero(np.abs(y - low - 0.5) < 1e-6):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
    return np.where(np.isfinite(x), out, x) + 0.0  # no negative zero


def _widths(column: pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(width, rows, matrix) of the vectors that are whole, by their number of components."""
    lists = column.combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    size = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False)
    parts = pc.list_flatten(lists)
    whole = size >= 0
    if parts.null_count:
        whole[pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)[parts.is_null().to_numpy(zero_copy_only=False)]] = False
    x = pc.cast(parts, pa.float64()).to_numpy(zero_copy_only=False)
    start = np.concatenate([[0], np.cumsum(np.maximum(size, 0))])[:-1]
    for w in np.unique(size[whole]):
        rows = np.flatnonzero(whole & (size == w))
        yield int(w), rows, x[start[rows][:, None] + np.arange(w)]


def _kept(rows: np.ndarray, asked: np.ndarray, score: np.ndarray, order: np.ndarray, limit: int) -> np.ndarray:
    """Which hits are among the first of their question: the highest score (NaN above all), then the first id."""
    none = np.isnan(score)
    at = np.lexsort((order[rows], -np.where(none, np.inf, score), ~none, asked))
    new = np.r_[True, asked[at][1:] != asked[at][:-1]] if len(at) else np.zeros(0, bool)
    first = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
    return at[np.arange(len(at)) - first < limit]


def _threshold(near: np.ndarray, limit: int, slack: float) -> np.ndarray:
    """Of each row the limit-th highest number less the slack."""
    if near.shape[1] <= limit:
        return np.full((len(near), 1), -np.inf)
    return np.partition(near, near.shape[1] - limit, axis=1)[:, near.shape[1] - limit][:, None] - slack


def cosines(a: np.ndarray, q: np.ndarray, limit: int, *_: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, questions, score): rounded cosines of what may be among the first."""
    with np.errstate(all="ignore"):
        an, qn = (np.sqrt(by_parts(x, x, np.multiply)) for x in (a, q))
        for lo in range(0, len(q), AT_ONCE):
            part, length = q[lo : lo + AT_ONCE], qn[lo : lo + AT_ONCE, None] * an[None, :]
            near = (part @ a.T) / length
            near[~np.isfinite(near) | ~(length > 1e-290)] = np.inf  # scored below, whatever it is
            near[length == 0] = -np.inf  # no cosine
            asked, rows = np.nonzero((near >= _threshold(near, limit, 2e-6)) & (length != 0))
            score = by_parts(a[rows], part[asked], np.multiply) / length[asked, rows]
            yield rows, asked + lo, rounded(score)


def hashed_distances(most: float):
    """Negative distances below ``most`` of rows that share a hash with a question; the
    first columns beside the vectors are hashes."""

    def found(a: np.ndarray, q: np.ndarray, limit: int, ha: np.ndarray, hq: np.ndarray):
        an, qn = ((x * x).sum(1) for x in (a, q))
        for lo in range(0, len(q), AT_ONCE):
            part, h = q[lo : lo + AT_ONCE], hq[lo : lo + AT_ONCE]
            both = qn[lo : lo + AT_ONCE, None] + an[None, :]
            met = np.zeros(both.shape, bool)
            for i in range(ha.shape[1]):
                met |= h[:, i][:, None] == ha[:, i][None, :]
            near = both - 2 * (part @ a.T)
            slack = 1e-9 * (1 + both)
            near = np.where(met & (near < most * most + slack), -near, -np.inf)
            asked, rows = np.nonzero((near + slack >= _threshold(near, limit, 0.0) - slack) & (near > -np.inf))
            dist = np.sqrt(by_parts(a[rows], part[asked], lambda x, y: (x - y) * (x - y)))
            yield (*(x[dist < most] for x in (rows, asked + lo)), -dist[dist < most])

    return found


def first_of_cells(vectors: DataFrame, queries: DataFrame, id_col: str, limit: int, how: Callable, per_block: int = PER_BLOCK) -> DataFrame:
    """(query_id, id, score): of each cell the first ``limit`` of each question, at least.

    ``vectors`` has (id, v[, h]), ``queries`` (query_id, v[, h]): v the vector, h
    numbers of which ``how`` makes use."""
    blocks, parts = (max(least, -(-df.count() // per_block)) for df, least in ((vectors, 8), (queries, 1)))
    cell = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = vectors.withColumn("_block", cell(id_col, blocks)).withColumn("_part", every(parts))
    asked = queries.withColumn("_part", cell("query_id", parts)).withColumn("_block", every(blocks))
    kinds = T.StructType([queries.schema["query_id"], vectors.schema[id_col], T.StructField("score", T.DoubleType())])

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, names = left[id_col], right["query_id"]
        order = pc.rank(ids, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy()
        rows, questions, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        beside = [next(iter([m for _, _, m in _widths(t["h"])]), np.zeros((0, 0))) if "h" in t.column_names else np.zeros((t.num_rows, 0)) for t in (left, right)]
        wide = {w: (r, m) for w, r, m in _widths(right["v"])}
        for w, r, m in _widths(left["v"]):
            if w in wide:
                qr, qm = wide[w]
                for i, j, s in how(m, qm, limit, beside[0][r], beside[1][qr]):
                    k = _kept(i, j, s, order[r], limit)
                    rows.append(r[i[k]])
                    questions.append(qr[j[k]])
                    scores.append(s[k])
        at, to = np.concatenate(rows), np.concatenate(questions)
        return pa.table({"query_id": names.take(pa.array(to)), id_col: ids.take(pa.array(at)), "score": np.concatenate(scores)})

    return held.groupBy("_block", "_part").cogroup(asked.groupBy("_block", "_part")).applyInArrow(best, kinds)
