"""Nearest vectors: an exact top-k by bounded sorted access, and vantage-point trees.

Both searches meet queries and candidates block by block. A block holds about
``BLOCK`` candidates (``SHARD`` in a tree) or ``QUERIES`` queries, whatever the
size of the table; a pair of blocks is one unit of work and leaves each query's
k best, which a window merges. Blocks are dealt by hash, so no key can make one
large. Every search is a stated set of queries against all rows, so the work is
their product; what a pair of blocks costs is what the two methods cut down.

Vectors that are null, hold a null or a non-finite component, or have a null id
take no part. Rows that repeat an id and vector count once; an id with several
vectors keeps the smallest. Vectors of unlike length are compared as if the
shorter went on with zeros. A query never finds its own id. Equal scores go to
the smaller id. Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.llm._shared import arrow_schema, emit, stage, whole_groups

BLOCK = 8192  #: candidates of one block of sorted lists
SHARD = 8192  #: candidates of one vantage-point tree
QUERIES = 4096  #: queries that meet a block together
ASKED = 1024  #: queries that meet a tree together
FACTORS = (24, 16, 12, 9, 7.5, 6.5, 5.5, 4.5, 3.5, 2.5, 1.75, 1.25, 1.0)  #: relaxations that a tree tries, the boldest first
PROBES = 96  #: points of a shard, at most, by which its relaxation is chosen
DEPTHS = (0.5, 0.65, 0.75, 0.82, 0.88, 0.94)  #: shares of every list after which the bounds are held against each other


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(vector_col).cast("array<double>")
    ok = F.col(id_col).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.filter(F.coalesce(ok, F.lit(False))).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(v).alias("v"))


def _matrix(column, width: int | None = None) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offs = column.offsets.to_numpy()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(offs)
    width = max(width or 0, int(sizes.max()) if len(sizes) else 0)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(offs[:-1] - offs[0], sizes)] = flat
    return out


def _place(seed: int, of: int):
    return F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(of)).cast("int")


def _each(of: int):
    return F.explode(F.sequence(F.lit(0), F.lit(of - 1)))


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _best(score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores; of equal ones the earlier come first."""
    at = np.arange(len(score))
    if len(score) > 4 * k:
        at = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    return at[np.argsort(-score[at], kind="stable")][:k]


class SortedLists:
    """One list of candidates per dimension, in order of their component.

    A query reads a list from its top where its own component is positive and
    from its bottom where it is negative. ``read`` goes on to a share of every
    list and notes what has been shown from either end.
    """

    def __init__(self, X: np.ndarray):
        self.X, (n, width) = X, X.shape
        self.order = np.argsort(X, axis=0, kind="stable")
        self.least, self.most = X.min(axis=0), X.max(axis=0)
        self.seen = np.zeros((n, 2 * width), X.dtype)  # 1 where shown from the top, and from the bottom
        self.square = (X.astype(np.float64) ** 2).sum(axis=1).astype(X.dtype)
        self.depth = 0

    def read(self, share: float) -> None:
        n, width = self.X.shape
        upto, dims = max(self.depth, min(n, int(np.ceil(n * share)))), np.arange(width)
        self.seen[self.order[n - upto : n - self.depth], dims] = 1
        self.seen[self.order[self.depth : upto], width + dims] = 1
        self.depth = upto

    def bounds(self, Q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest score that each query and candidate can still have.

        An unread component lies between the list's far end and the last value
        read; all unread ones together add no more than the product of the norms
        of what is unread of the query and of the candidate.
        """
        n, width = self.X.shape
        A = np.concatenate([np.maximum(Q, 0), np.minimum(Q, 0)], axis=1)
        last = np.concatenate([self.X[self.order[n - self.depth], np.arange(width)], self.X[self.order[self.depth - 1], np.arange(width)]])
        far = np.concatenate([self.least, self.most])
        shown = np.concatenate([self.X, self.X], axis=1) * self.seen
        known = A @ shown.T
        most = (A @ last)[:, None] - (A * last) @ self.seen.T
        least = (A @ far)[:, None] - (A * far) @ self.seen.T
        rest = np.maximum((A * A).sum(axis=1)[:, None] - (A * A) @ self.seen.T, 0)
        rest *= np.maximum(self.square - (A != 0).astype(A.dtype) @ (shown * shown).T, 0)
        np.sqrt(rest, out=rest)
        slack = 1e-5 * (1 + np.abs(known).max(initial=0) + rest.max(initial=0))  # rounding of the products
        return known + np.maximum(least, -rest) - slack, known + np.minimum(most, rest) + slack


def sorted_access(query_ids, Q, ids, X, k: int, depths: tuple[float, ...] = DEPTHS, told: dict | None = None):
    """Exact top-k inner products from sorted lists alone.

    Lists are read on from depth to depth. A query stops once few candidates
    besides its k best by lower bound can still reach the k-th lower bound; only
    those left have the rest of their scores resolved. A query that no depth
    stops has read its lists to the end, and so knows all scores. ``told`` is
    given the share of the list entries that the queries read (each up to its
    own depth, and beyond it what is left of its candidates).

    Components are whole numbers, and their sums are exact in single precision
    up to 2**24; larger ones use double.
    """
    n = len(ids)
    bound = float(np.abs(Q).sum(axis=1).max(initial=0)) * float(np.abs(X).max(initial=0))
    kind = np.float32 if bound < 2**24 else np.float64
    X, Q = np.ascontiguousarray(X, kind), np.ascontiguousarray(Q, kind)
    own = {int(i): at for at, i in enumerate(ids.tolist())}
    self_at = np.array([own.get(int(i), -1) for i in query_ids.tolist()], np.int64)
    rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    lists, open_, read = SortedLists(X), np.arange(len(Q)), 0.0

    def resolve(q: int, left: np.ndarray) -> None:
        score = X[left] @ Q[q]
        pick = _best(score, k)
        rows.append((np.full(len(pick), q), left[pick], score[pick].astype(np.int64)))

    for depth in depths if n > k else ():
        if not len(open_):
            break
        lists.read(depth)
        still = []
        for part in np.array_split(open_, 1 + len(open_) // 256):
            low, high = lists.bounds(Q[part])
            mine = np.flatnonzero(self_at[part] >= 0)
            low[mine, self_at[part][mine]] = high[mine, self_at[part][mine]] = -np.inf
            kth = np.partition(low, n - k, axis=1)[:, n - k]
            alive = high >= kth[:, None]
            ready = alive.sum(axis=1) <= max(4 * k, n // 16)
            for q, a in zip(part[ready].tolist(), alive[ready], strict=True):
                left = np.flatnonzero(a)
                read += depth + (1 - depth) * len(left) / n
                resolve(q, left)
            still.append(part[~ready])
        open_ = np.concatenate(still)
    for q in open_.tolist():
        everyone = np.arange(n)
        resolve(q, everyone if self_at[q] < 0 else np.delete(everyone, self_at[q]))
    if told is not None:
        told["read"] = told.get("read", 0.0) + (read + len(open_)) * n
        told["all"] = told.get("all", 0.0) + len(Q) * n
    if not rows:
        none = np.zeros(0, np.int64)
        return none, none, none
    return tuple(np.concatenate(x) for x in zip(*rows, strict=True))


def exact_top_k(vectors: DataFrame, queries: DataFrame | None = None, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding", query_filter=None) -> DataFrame:
    """(query_id, rank, vec_id, score): top-k inner products of the components
    floor(scale * x). Queries are ``queries``, or the rows that meet ``query_filter``."""
    whole_of = lambda df: usable(df, id_col, vector_col).select("id", F.transform("v", lambda x: F.floor(x * float(scale)).cast("double")).alias("v"))
    held = stage(whole_of(vectors), "vectors")
    asked = (held.filter(query_filter) if query_filter is not None else held) if queries is None else stage(whole_of(queries), "vectors")
    blocks, parts = max(1, -(-held.count() // BLOCK)), max(1, -(-asked.count() // QUERIES))
    _, out = arrow_schema("query_id long, vec_id long, score long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["block", "part"], 1):
            both = t.column("block").to_numpy().astype(np.int64) << 32 | t.column("part").to_numpy()
            for key in np.unique(both):
                g = t.filter(pa.array(both == key)).sort_by("id")
                asks = g.column("asks").to_numpy()
                ids, m = g.column("id").to_numpy(), _matrix(g.column("v"))
                if asks.any() and not asks.all():
                    q, c, s = sorted_access(ids[asks], m[asks], ids[~asks], m[~asks], k)
                    yield emit(out, {"query_id": ids[asks][q], "vec_id": ids[~asks][c], "score": s})

    met = held.select(_place(1, blocks).alias("block"), _each(parts).alias("part"), F.lit(False).alias("asks"), "id", "v")
    asks = asked.select(_each(blocks).alias("block"), _place(2, parts).alias("part"), F.lit(True).alias("asks"), "id", "v")
    pairs = met.unionByName(asks).repartition(blocks * parts, "block", "part").sortWithinPartitions("block", "part")
    return _ranked(pairs.mapInArrow(run, "query_id long, vec_id long, score long"), k)


class VantagePointTree:
    """Points split again and again at the median distance to one of them.

    Largest inner products become nearest points when each vector gets one more
    component, sqrt(M^2 - |x|^2) with M the largest norm, and each query a zero.
    By the triangle inequality every point of a subtree is at least as far from
    a query as the widest of the gaps that the query's distances to the vantage
    points above leave. ``relax`` sharpens that least distance: to the widest
    gap come ``relax`` - 1 times all gaps together (the root of the sum of their
    squares, as if vantage points lay at right angles). A subtree is skipped
    when the result exceeds the distance of the k-th point found so far: 1 is
    exact, larger factors skip more. Queries walk the tree together, the nearer
    side first. Equal vectors are one point.

    How much a factor may skip depends on the data: on directions drawn at random
    in 64 dimensions 5 keeps nine tenths of the neighbours, in 8 dimensions hardly
    2. ``tune`` therefore asks the tree for the neighbours of up to ``PROBES`` of
    its own points, and takes the largest factor that finds the wanted share.
    """

    LEAF = 128

    def __init__(self, ids: np.ndarray, X: np.ndarray):
        order = np.lexsort(ids[None, :])
        ids, X = ids[order], np.ascontiguousarray(X[order])
        _, first, of = np.unique(X.view(np.dtype((np.void, X.dtype.itemsize * max(X.shape[1], 1)))).ravel() if X.size else np.zeros(len(X)), return_index=True, return_inverse=True)
        by = np.argsort(of.ravel(), kind="stable")
        self.ids, self.head = ids[by], np.searchsorted(of.ravel()[by], np.arange(len(first) + 1))  # ids of each point, ascending
        self.X = X[first]
        norms = (self.X * self.X).sum(axis=1)
        self.up = np.sqrt(np.maximum(norms.max(initial=0) - norms, 0))
        self.perm = np.arange(len(first))
        self.relax = 1.0
        self._build()

    def _lifted(self, at) -> np.ndarray:
        return np.concatenate([self.X[at], self.up[at][:, None]], axis=1)

    def _build(self) -> None:
        """``nodes``: first and last place in ``perm``, vantage point, and the least and
        greatest distance on each side; the sides are halves, and a node of at
        most LEAF points is a leaf."""
        P = self._lifted(slice(None))
        sq = (P * P).sum(axis=1)
        self.nodes: dict[tuple[int, int], tuple] = {}
        todo = [(0, len(P))]
        while todo:
            lo, hi = todo.pop()
            if hi - lo <= self.LEAF:
                continue
            at = self.perm[lo:hi]
            centre = P[at].mean(axis=0)
            v = int(at[np.argmax(sq[at] - 2 * (P[at] @ centre))])  # the rim spreads distances most
            d = np.sqrt(np.maximum(sq[at] + sq[v] - 2 * (P[at] @ P[v]), 0))
            o = np.argsort(d, kind="stable")
            mid = (hi - lo) // 2
            self.perm[lo:hi], d = at[o], d[o]
            self.nodes[lo, hi] = (v, float(d[0]), float(d[mid - 1]), float(d[mid]), float(d[-1]))
            todo += [(lo, lo + mid), (lo + mid, hi)]

    def tune(self, k: int, recall: float) -> None:
        """Choose ``relax``: the boldest of FACTORS that finds ``recall`` of the k
        best of points of the tree, spread evenly over it."""
        at = self.perm[np.unique(np.linspace(0, max(len(self.perm) - 1, 0), PROBES).astype(np.int64))] if len(self.perm) else self.perm
        if not len(at):
            return
        ids, Q = self.ids[self.head[at]], self.X[at]
        scores = Q @ self.X.T
        scores[np.arange(len(at)), at] = np.where(np.diff(self.head)[at] > 1, scores[np.arange(len(at)), at], -np.inf)
        kth = np.sort(scores, axis=1)[:, -min(k, scores.shape[1])]
        wanted = np.minimum(np.isfinite(scores).sum(axis=1), k)

        def enough(factor: float) -> bool:
            row, _, score = self.search(ids, Q, k, factor)
            hits = np.bincount(row, weights=score >= kth[row] - 1e-9, minlength=len(at))
            return np.minimum(hits, wanted).sum() >= recall * wanted.sum()

        lo, hi = 0, len(FACTORS) - 1  # bolder factors come first and find less
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if enough(FACTORS[mid]) else (mid + 1, hi)
        self.relax = FACTORS[lo]

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        nodes = np.array([(*key, *value) for key, value in self.nodes.items()]).reshape(-1, 7)
        np.savez(out, ids=self.ids, head=self.head, X=self.X, up=self.up, perm=self.perm, nodes=nodes, relax=self.relax)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, raw: bytes) -> VantagePointTree:
        self = cls.__new__(cls)
        z = np.load(io.BytesIO(raw))
        self.ids, self.head, self.X, self.up, self.perm = (z[c] for c in ("ids", "head", "X", "up", "perm"))
        self.relax = float(z["relax"])
        self.nodes = {(int(n[0]), int(n[1])): (int(n[2]), *n[3:].tolist()) for n in z["nodes"]}
        return self

    def search(self, query_ids: np.ndarray, Q: np.ndarray, k: int, relax: float | None = None, told: dict | None = None):
        """(query index, id, score) of the k nearest found, with the tree's own factor if none is given; scores are inner
        products of the vectors as they are."""
        relax = self.relax if relax is None else relax
        width = max(Q.shape[1], self.X.shape[1])
        q = np.pad(Q, ((0, 0), (0, width - Q.shape[1])))
        X = np.pad(self.X, ((0, 0), (0, width - self.X.shape[1])))
        q2, x2 = (q * q).sum(axis=1), (X * X).sum(axis=1) + self.up**2
        own = np.full(len(Q), -1)  # a point that is the query's own row alone
        for i, j in zip(*self._own(query_ids), strict=True):
            own[i] = j
        # the k nearest so far and all that are as near as the k-th, up to rounding: ids choose among them in the end
        dist, near, kth = np.full((len(Q), k), np.inf), np.full((len(Q), k), -1), np.full(len(Q), np.inf)
        slack = 1e-12 * (q2 + x2.max(initial=0))
        seen = 0

        def distances(who: np.ndarray, at: np.ndarray) -> np.ndarray:
            nonlocal seen
            seen += len(who) * len(at)
            return np.sqrt(np.maximum(q2[who][:, None] + x2[at][None, :] - 2 * (q[who] @ X[at].T), 0))

        def walk(lo: int, hi: int, who: np.ndarray, widest: np.ndarray, squares: np.ndarray) -> None:
            nonlocal dist, near
            if not len(who):
                return
            node = self.nodes.get((lo, hi))
            if node is None:
                at = self.perm[lo:hi]
                d = distances(who, at)
                d[at[None, :] == own[who][:, None]] = np.inf
                d = np.concatenate([dist[who], d], axis=1)
                i = np.concatenate([near[who], np.broadcast_to(at, (len(who), len(at)))], axis=1)
                kth[who] = np.partition(d, k - 1, axis=1)[:, k - 1]
                ties = int(((d * d <= (kth[who] ** 2 + slack[who])[:, None]) & np.isfinite(d)).sum(axis=1).max())
                if ties > dist.shape[1]:
                    more = ((0, 0), (0, ties - dist.shape[1]))
                    dist, near = np.pad(dist, more, constant_values=np.inf), np.pad(near, more, constant_values=-1)
                room = dist.shape[1]
                if d.shape[1] > room:
                    pick = np.argpartition(d, room - 1, axis=1)[:, :room]
                    d, i = np.take_along_axis(d, pick, 1), np.take_along_axis(i, pick, 1)
                dist[who, : d.shape[1]], near[who, : d.shape[1]] = d, i
                return
            v, *ends = node
            d = distances(who, np.array([v]))[:, 0]
            mid = lo + (hi - lo) // 2
            gap = [np.maximum(np.maximum(d - b, a - d), 0) for a, b in (ends[:2], ends[2:])]
            first = gap[0] <= gap[1]
            for turn in (True, False):
                for side, (x, y) in enumerate(((lo, mid), (mid, hi))):
                    mine = np.flatnonzero(first == ((side == 0) == turn))
                    w, s = np.maximum(widest[mine], gap[side][mine]), squares[mine] + gap[side][mine] ** 2
                    go = w + (relax - 1) * np.sqrt(s) <= kth[who[mine]] + 1e-9
                    walk(x, y, who[mine[go]], w[go], s[go])

        if len(X):
            walk(0, len(X), np.arange(len(Q)), np.zeros(len(Q)), np.zeros(len(Q)))
        if told is not None:
            told["seen"], told["all"] = told.get("seen", 0) + seen, told.get("all", 0) + len(Q) * len(X)
        row, slot = np.nonzero(near >= 0)
        point = near[row, slot]
        score = np.concatenate([np.einsum("ij,ij->i", q[a], X[b]) for a, b in zip(np.array_split(row, 1 + len(row) // 50000), np.array_split(point, 1 + len(point) // 50000), strict=True)])
        many = np.minimum(self.head[point + 1] - self.head[point], k + 1)  # its k smallest ids, besides the query's own
        each = np.repeat(np.arange(len(row)), many)
        ids = self.ids[np.repeat(self.head[point], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
        keep = ids != query_ids[row[each]]
        row, ids, score = row[each][keep], ids[keep], score[each][keep]
        o = np.lexsort((ids, -score, row))
        row, ids, score = row[o], ids[o], score[o]
        nth = np.arange(len(row)) - np.searchsorted(row, row)
        return row[nth < k], ids[nth < k], score[nth < k]

    def _own(self, query_ids: np.ndarray) -> tuple[list[int], list[int]]:
        point = np.repeat(np.arange(len(self.head) - 1), np.diff(self.head))
        alone = np.diff(self.head)[point] == 1
        at = dict(zip(self.ids[alone].tolist(), point[alone].tolist(), strict=True))
        hit = [(i, at[x]) for i, x in enumerate(query_ids.tolist()) if x in at]
        return [i for i, _ in hit], [j for _, j in hit]


def nearest(vectors: DataFrame, k: int = 20, relax: float | None = None, recall: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", query_filter=None) -> DataFrame:
    """(query_id, rank, vec_id, score): approximate k largest inner products;
    zero vectors take no part. The trees are built once, one per shard, and then
    meet the queries in parts. Without ``relax`` each tree chooses its factor so
    that it finds ``recall`` of the neighbours of a sample of its points."""
    held = stage(usable(vectors, id_col, vector_col).filter(F.exists("v", lambda x: x != 0)), "vectors")
    asked = held.filter(query_filter) if query_filter is not None else held
    shards, parts = max(1, -(-held.count() // SHARD)), max(1, -(-asked.count() // ASKED))
    _, tree_out = arrow_schema("shard int, tree binary")
    _, out = arrow_schema("query_id long, vec_id long, score double")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["shard"], 1):
            shard = t.column("shard").to_numpy()
            for key in np.unique(shard):
                g = t.filter(pa.array(shard == key))
                tree = VantagePointTree(g.column("id").to_numpy(), _matrix(g.column("v")))
                if relax is None:
                    tree.tune(k, recall)
                yield emit(tree_out, {"shard": [int(key)], "tree": [tree.to_bytes()]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["shard", "part"], 1):
            both = t.column("shard").to_numpy().astype(np.int64) << 32 | t.column("part").to_numpy()
            for key in np.unique(both):
                g = t.filter(pa.array(both == key))
                trees, asks = g.filter(g.column("tree").is_valid()), g.filter(g.column("tree").is_null())
                if len(trees) and len(asks):
                    asks = asks.sort_by("id")
                    ids, Q = asks.column("id").to_numpy(), _matrix(asks.column("v"))
                    row, found, score = VantagePointTree.from_bytes(trees.column("tree")[0].as_py()).search(ids, Q, k, relax)
                    yield emit(out, {"query_id": ids[row], "vec_id": found, "score": score})

    dealt = held.select(_place(1, shards).alias("shard"), "id", "v").repartition(shards, "shard").sortWithinPartitions("shard")
    trees = stage(dealt.mapInArrow(build, "shard int, tree binary"), "trees")
    none = lambda kind: F.lit(None).cast(kind)
    met = trees.select("shard", _each(parts).alias("part"), "tree", none("long").alias("id"), none("array<double>").alias("v"))
    asks = asked.select(_each(shards).alias("shard"), _place(2, parts).alias("part"), none("binary").alias("tree"), "id", "v")
    pairs = met.unionByName(asks).repartition(shards * parts, "shard", "part").sortWithinPartitions("shard", "part")
    return _ranked(pairs.mapInArrow(run, "query_id long, vec_id long, score double"), k)
