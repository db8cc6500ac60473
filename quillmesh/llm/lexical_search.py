"""Ranked lexical search for many queries at once, over shared subexpressions.

A query's score of a document is the sum of its terms' scores there, so queries
that have terms in common have sums in common. Queries are put beside others like
them and cut into blocks of about ``ENTRIES`` (query, term) entries, and each block
is mined for what its queries share (``mine``):

* terms that the same queries hold equally often are one leaf;
* of two nodes that several queries hold together, the most often shared pair
  becomes a node of its own in place of both, and again until no pair is left in
  ``SHARED`` queries.

The nodes form a directed acyclic graph. A task that scores a batch of documents
fills each leaf's accumulator once for all queries, each inner node's from its two
parts once, level by level, and then adds up what is left of each query. Sums are
of whole numbers, so their order does not matter.

Documents are read twice: once as texts, for the terms that any query holds (these
postings are written to the shared folder, with each text's number of terms), and
once as postings, to be scored. Each task passes on its own ``k`` best documents
of a query; windows over groups of tasks and then over all of them merge these.
Blocks are worked through in rounds of about ``ROUND`` bytes, which is the bound
of what is broadcast; more queries take more rounds, not more memory.

Null texts have no terms, and neither have texts of separators alone: they count
nowhere and are never found. Documents that share an id are documents of their
own; among equal scores the smaller id comes first, null ids before all others.
Queries that repeat an id are taken together as one; null ids are an id. Queries
without terms find nothing. Empty tables give no rows. Texts of any length are
read whole, as bytes. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import pickle
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.llm._shared import NULL_ID, arrow_schema, emit, id_or_lowest, stage

ENTRIES = 1 << 14  #: (query, term) entries of one block, about
SHARED = 3  #: queries that must hold a pair of nodes for it to become a node
WIDE = 64  #: nodes of one query that may pair up; the most shared ones
ROUND = 32 << 20  #: bytes of blocks that are broadcast at once, about
CELLS = 1 << 21  #: accumulators (node, document) that a task holds at once, about
POSTINGS = "doc long, n long, terms array<int>, times array<int>"
FOUND = "item_id long, doc_id long, score long, task int"

#: Letters, digits and all that is not ASCII make terms; A-Z are lower-cased.
FOLD = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()


def terms_of(text: bytes) -> list[bytes]:
    """All terms of a text in order: UTF-8 goes byte by byte, as no separator is part of a longer character."""
    return text.translate(FOLD).split()


def mine(queries: dict[int, Counter], shared: int = SHARED) -> dict:
    """A plan for a block of queries (id to its terms' counts).

    ``leaf``: (term, times) of each leaf; ``pairs``: the two nodes of each inner
    node, in an order in which parts come first; ``parts``: the nodes that add up
    to each query. Nodes are numbered leaves first.
    """
    holders: dict[tuple, list[int]] = defaultdict(list)
    for q in sorted(queries):
        for entry in sorted(queries[q].items()):
            holders[entry].append(q)
    classes: dict[tuple, list[tuple]] = defaultdict(list)
    for entry, held in holders.items():
        classes[tuple(held)].append(entry)
    leaf, parts = [], {q: set() for q in sorted(queries)}
    for at, (held, entries) in enumerate(classes.items()):
        leaf.append(entries)
        for q in held:
            parts[q].add(at)

    # ``open_`` are the nodes of a query that may pair up; counts in the heap may be out of date
    holds = Counter(n for nodes in parts.values() for n in nodes)
    open_ = {q: set(sorted((n for n in nodes if holds[n] >= shared), key=lambda n: (-holds[n], n))[:WIDE]) for q, nodes in parts.items()}
    often = Counter(pair for nodes in open_.values() for pair in combinations(sorted(nodes), 2))
    held_by: dict[tuple[int, int], set[int]] = {pair: set() for pair, n in often.items() if n >= shared}
    for q, nodes in open_.items():
        for pair in combinations(sorted(nodes), 2):
            if pair in held_by:
                held_by[pair].add(q)
    heap = [(-len(qs), pair) for pair, qs in held_by.items()]
    heapq.heapify(heap)
    pairs: list[tuple[int, int]] = []
    while heap:
        count, (a, b) = heapq.heappop(heap)
        qs = sorted(held_by[a, b])
        if len(qs) < shared:
            continue
        if len(qs) != -count:
            heapq.heappush(heap, (-len(qs), (a, b)))
            continue
        new = len(leaf) + len(pairs)
        pairs.append((a, b))
        fresh: dict[tuple[int, int], set[int]] = defaultdict(set)
        for q in qs:
            parts[q] -= {a, b}
            open_[q] -= {a, b}
            for n in open_[q]:
                for old in (a, b):
                    held_by.get((min(n, old), max(n, old)), set()).discard(q)
                fresh[n, new].add(q)
            parts[q].add(new)
            open_[q].add(new)
        held_by[a, b] = set()
        for pair, who in sorted(fresh.items()):
            if len(who) >= shared:
                held_by[pair] = who
                heapq.heappush(heap, (-len(who), pair))
    return {"leaf": leaf, "pairs": pairs, "parts": {q: sorted(n) for q, n in parts.items()}}


class Block:
    """A mined plan, made ready for scoring: terms are numbers of a vocabulary."""

    def __init__(self, plan: dict, number: dict[bytes, int], size: int):
        self.queries = list(plan["parts"])
        leaves, pairs = len(plan["leaf"]), plan["pairs"]
        self.nodes = leaves + len(pairs)
        entries = sorted((number[t], times, at) for at, held in enumerate(plan["leaf"]) for t, times in held)
        term, self.times, self.leaf = (np.array(c, np.int64) for c in zip(*entries, strict=True)) if entries else (np.zeros(0, np.int64),) * 3
        self.head = np.searchsorted(term, np.arange(size + 1))  # of each term's entries
        level = [0] * self.nodes
        for at, (a, b) in enumerate(pairs, leaves):
            level[at] = 1 + max(level[a], level[b])
        by_level: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for at, (a, b) in enumerate(pairs, leaves):
            by_level[level[at]].append((at, a, b))
        self.levels = [np.array(by_level[v], np.int64).T for v in sorted(by_level)]
        self.flat = np.array([n for q in self.queries for n in plan["parts"][q]], np.int64)
        lengths = np.array([len(plan["parts"][q]) for q in self.queries], np.int64)
        self.starts = np.cumsum(lengths) - lengths

    def scores(self, doc: np.ndarray, term: np.ndarray, score: np.ndarray, docs: int) -> np.ndarray:
        """Score of every query (row) and document (column) from the scores of
        single terms in documents."""
        many = self.head[term + 1] - self.head[term]
        entry = np.repeat(self.head[term] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        nodes = np.zeros((self.nodes, docs), np.int64)
        np.add.at(nodes, (self.leaf[entry], np.repeat(doc, many)), self.times[entry] * np.repeat(score, many))
        for at, a, b in self.levels:
            nodes[at] = nodes[a] + nodes[b]
        return np.add.reduceat(nodes[self.flat], self.starts, axis=0)


def _blocks_of(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(block, plan, size): the mined plans of all queries, staged."""
    base = items.select(id_or_lowest(F.col(id_col).cast("long")).alias("item_id"), F.col(text_col).cast("binary").alias("text"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column("item_id").to_pylist(), b.column("text").to_pylist()
            held = [(i, t) for i, text in zip(ids, texts, strict=True) for t in terms_of(text or b"")]
            yield pa.RecordBatch.from_pydict({"item_id": pa.array([i for i, _ in held], pa.int64()), "term": pa.array([t for _, t in held], pa.binary())})

    terms = base.mapInArrow(read, "item_id long, term binary").groupBy("item_id", "term").agg(F.count("*").alias("times"))
    queries = stage(terms.groupBy("item_id").agg(F.collect_list(F.struct("term", "times")).alias("terms"), F.min(F.xxhash64("term")).alias("like")), "queries")  # a query's own terms
    entries = queries.agg(F.sum(F.size("terms"))).first()[0] or 0

    def mined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, held, n = TaskContext.get().partitionId(), 0, {}, 0

        def block() -> pa.RecordBatch:
            nonlocal made
            raw = pickle.dumps(mine(held))
            made += 1
            return pa.RecordBatch.from_pydict({"block": pa.array([(part << 32) + made], pa.int64()), "plan": pa.array([raw], pa.binary()), "size": pa.array([len(raw)], pa.int64())})

        for b in batches:
            for item, terms in zip(b.column("item_id").to_pylist(), b.column("terms").to_pylist(), strict=True):
                if held and n + len(terms) > ENTRIES:
                    yield block()
                    held, n = {}, 0
                held[item] = Counter({t["term"]: t["times"] for t in terms})
                n += len(terms)
        if held:
            yield block()

    near = queries.repartitionByRange(max(1, -(-entries // ENTRIES)), "like", "item_id").sortWithinPartitions("like", "item_id")
    return stage(near.mapInArrow(mined, "block long, plan binary, size long"), "blocks")


def _vocabulary(plans: list[dict]) -> dict[bytes, int]:
    return {t: i for i, t in enumerate(sorted({t for p in plans for held in p["leaf"] for t, _ in held}))}


def _postings(shared):
    _, out = arrow_schema(POSTINGS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = _vocabulary([pickle.loads(p) for p in shared.value])
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                part = b.slice(i, 1000)
                n, sizes, terms, times = [], [0], [], []
                for text in part.column("text").to_pylist():
                    words = terms_of(text or b"")
                    count = Counter(words)
                    held = [(number[w], c) for w, c in count.items() if w in number]
                    n.append(len(words))
                    sizes.append(len(held))
                    terms += [t for t, _ in held]
                    times += [c for _, c in held]
                offsets = pa.array(np.cumsum(sizes), pa.int32())
                as_list = lambda x: pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32()))  # noqa: B023, E731
                yield emit(out, {"doc": part.column("doc"), "n": np.array(n, np.int64), "terms": as_list(terms), "times": as_list(times)})

    return run


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    return np.diff(column.offsets.to_numpy()), column.flatten().to_numpy().astype(np.int64)


def _best(shared, weights, k: int):
    """Each task's k best documents of every query."""
    _, out = arrow_schema(FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans = [pickle.loads(p) for p in shared.value]
        number = _vocabulary(plans)
        blocks, weight = [Block(p, number, len(number)) for p in plans], np.frombuffer(weights.value, np.int64)
        best = {(at, q): (np.zeros(0, np.int64), np.zeros(0, np.int64)) for at, block in enumerate(blocks) for q in range(len(block.queries))}  # scores, documents
        least = [np.ones(len(block.queries), np.int64) for block in blocks]  # scores that count
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                part = b.slice(i, 1000)
                docs, m = part.column("doc").to_numpy(), part.column("m").to_numpy()
                sizes, term = _flat(part.column("terms"))
                times = _flat(part.column("times"))[1]
                row = np.repeat(np.arange(len(docs)), sizes)
                score = weight[term] * ((1_000_000_000 * times) // (1000 * times + 12 * m[row]))
                edges = np.r_[0, np.cumsum(sizes)]
                for at, block in enumerate(blocks):
                    step = max(1, CELLS // (block.nodes + len(block.flat) + 1))
                    for lo in range(0, len(docs), step):
                        hi = min(lo + step, len(docs))
                        span = slice(edges[lo], edges[hi])
                        table = block.scores(row[span] - lo, term[span], score[span], hi - lo)
                        for q in np.flatnonzero(table.max(axis=1) >= least[at]).tolist():
                            new = np.flatnonzero(table[q] >= least[at][q])
                            s, d = np.r_[best[at, q][0], table[q, new]], np.r_[best[at, q][1], docs[lo + new]]
                            keep = np.lexsort((d, -s))[:k]
                            best[at, q] = s[keep], d[keep]
                            if len(keep) == k:
                                least[at][q] = s[keep[-1]]
        for (at, q), (s, d) in best.items():
            if len(s):
                yield emit(out, {"item_id": np.full(len(s), blocks[at].queries[q], np.int64), "doc_id": d, "score": s, "task": np.full(len(s), TaskContext.get().partitionId(), np.int32)})

    return run


def search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents of a score above 0."""
    spark = docs.sparkSession
    blocks = _blocks_of(items, item_col, item_text_col)
    rounds: list[list[int]] = []
    room = 0
    for block, size in sorted(tuple(r) for r in blocks.select("block", "size").collect()):  # two numbers a block
        if not rounds or size > room:
            rounds.append([])
            room = ROUND
        rounds[-1].append(block)
        room -= size
    texts = docs.select(id_or_lowest(F.col(id_col).cast("long")).alias("doc"), F.col(text_col).cast("binary").alias("text"))
    found = None
    for wanted in rounds:
        plans = [bytes(r[0]) for r in blocks.filter(F.col("block").isin(wanted)).orderBy("block").select("plan").collect()]  # of ROUND bytes, or one block
        shared = spark.sparkContext.broadcast(plans)
        postings = stage(texts.mapInArrow(_postings(shared), POSTINGS), "postings").filter("n > 0")
        count, length = postings.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = postings.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
        weight = F.floor(1000 * F.log(F.lit(float(2 * count + 2)) / (2 * F.col("df") + 1)))
        held = np.zeros(len(_vocabulary([pickle.loads(p) for p in plans])), np.int64)
        for r in df.select("term", weight.cast("long").alias("w")).collect():  # the round's terms
            held[r.term] = r.w
        weights = spark.sparkContext.broadcast(held.tobytes())
        m = F.expr(f"75 + (25 * cast(n as decimal(18,0)) * cast({count} as decimal(18,0))) div cast({max(length, 1)} as decimal(18,0))")
        best = postings.filter(F.size("terms") > 0).withColumn("m", m).mapInArrow(_best(shared, weights, k), FOUND)
        found = best if found is None else found.unionByName(best)
    if found is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = [F.desc("score"), "doc_id"]
    found = stage(found, "found").withColumn("tasks", F.col("task") % 64)
    near = found.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "tasks").orderBy(*order))).filter(F.col("rank") <= k)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).filter(F.col("rank") <= k)
    plain = lambda c: F.when(F.col(c) != NULL_ID, F.col(c)).alias(c)
    return ranked.select(plain("item_id"), "rank", plain("doc_id"), "score")
