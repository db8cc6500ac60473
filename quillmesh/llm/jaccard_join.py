"""Near-duplicate documents by an exact Jaccard join on word shingles.

A document's set is its distinct ``shingle``-word shingles (all its words as
one, where it has fewer). Two documents link when their sets' Jaccard
similarity reaches ``percent`` / 100; the result names each document's
connected component by its smallest id.

Finding the links, with several global token orders:

1. Documents with the same set are one class, whatever their number.
2. Tokens are ordered from rare to frequent, ties by hash, with a different hash
   in each order. Frequencies come from a sketch of fixed size (``SLOTS``
   counters on a log scale, whatever the corpus), so a passage that a third of
   all documents share ranks last everywhere. Two sets that link must share a
   token among the first few of each, under *every* order: candidates found in
   the first order go on only if their prefixes meet in the others as well, and
   only then are their whole sets fetched.
3. In the first order, classes meet token by token. Each meeting is also held
   against the sizes and the places of the token (what follows it bounds the
   overlap). A meeting of m classes first tries each of them with one leader,
   m - 1 pairs; then with a few more; components are formed after each round,
   and only pairs whose ends are still apart are tried next, in the last round
   all of those. A group of near copies is thus settled without listing its
   pairs, and no link between different sets is lost: a pair that is left out
   has both ends in one component already. The leader is the class with the
   fewest rarer tokens before the shared one, as the source of copies has.
   Meetings of very many classes are dealt out in blocks and pairs of blocks; a
   token that the sketch gives more than ``hot`` classes is dealt so from the
   start, and none of its rows is judged by a part of its meeting.
4. Candidates are verified on whole sets of 64-bit shingle hashes. A word's hash
   sums a pseudo-random number for each of its places and bytes, so that words
   meet only by chance (2**-64 a pair of shingles); equal sets are known by a
   128-bit digest.

Components are found by alternating large-star and small-star steps over
distributed edges between classes. Every round is written to the shared folder.

Null and empty texts, and texts without words, have no set and link with
nothing. Ids that repeat name one node: it links with whatever any of its texts
links with, and a row without a set is its own component. Null ids link with
nothing; their component is null. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm._bytes import U64, blocks, flat, mix, ranges
from quillmesh.llm._shared import NULL_ID, arrow_batches, arrow_schema, emit, id_or_lowest, stage, whole_groups

SLOTS = 1 << 22  #: counters of the frequency sketch, one byte each
ORDERS = (0x1B873593CC9E2D51, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
BLOCK = 1 << 20  #: bytes whose shingles are hashed at once
BATCH = 16 << 20  #: bytes of an Arrow batch, so that several tasks fit beside each other
SPREAD = 128  #: classes of one meeting that are tried with leaders in one piece
PAIRED = 256  #: classes of one meeting that are paired in one piece in the last round
SALTS = 256  #: ways in which the rows of one set are dealt
HOT = 1 << 16  #: estimated classes beyond which a token's meeting is dealt out before it is looked at

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _place_values() -> np.ndarray:
    """A pseudo-random number for each of the first 64 places of a word and each byte there."""
    return mix(mix(np.arange(64 * 256, dtype=U64) + U64(0x243F6A8885A308D3)) ^ U64(0xA4093822299F31D0))


_PLACES = _place_values()


def word_hashes(low: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words [begin, end): the sum of a pseudo-random number
    for each place and the byte there. No structure of the bytes (as repeated or
    complementary halves have) lets two words meet other than by chance."""
    place = np.arange(len(low)) - np.repeat(np.r_[0, begin], np.diff(np.r_[0, begin, len(low)]))
    code = place << 8 | low
    if (far := place >= 64).any():
        value = _PLACES[np.where(far, 0, code)]
        value[far] = mix(mix(code[far].astype(U64) + U64(0x243F6A8885A308D3)) ^ U64(0xA4093822299F31D0))
    else:
        value = _PLACES[code]
    sums = np.zeros(len(low) + 1, U64)
    np.cumsum(value, out=sums[1:])
    return mix((sums[end] - sums[begin]) ^ mix((end - begin).astype(U64)))


def shingle_sets(buf: np.ndarray, offs: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts): the distinct shingle hashes of each document, ascending."""
    n = len(offs) - 1
    counts = np.zeros(n, np.int64)
    low = _LOWER[buf]
    space = _SPACE[low]
    before = np.r_[True, space[:-1]] if len(low) else space
    before[offs[:-1][offs[:-1] < len(low)]] = True
    after = np.r_[space[1:], True] if len(low) else space
    after[offs[1:][offs[1:] > 0] - 1] = True
    begin, end = np.flatnonzero(before & ~space), np.flatnonzero(after & ~space) + 1
    if not len(begin):
        return np.zeros(0, U64), counts
    word = word_hashes(low, begin, end)
    doc = np.searchsorted(offs, begin, side="right") - 1
    words = np.bincount(doc, minlength=n)
    first = np.cumsum(words) - words
    size = np.where(words > 0, np.maximum(words - shingle + 1, 1), 0)
    start = ranges(first, size)
    owner = np.repeat(np.arange(n), size)
    whole = np.minimum(words[owner], shingle)
    h = np.zeros(len(start), U64)
    with np.errstate(over="ignore"):
        for i in range(shingle):
            take = i < whole
            at = np.minimum(start + i, len(word) - 1)
            h = np.where(take, h * U64(0x9E3779B97F4A7C15) + word[at], h)
        h = mix(h ^ mix(whole.astype(U64)))
    o = np.lexsort((h, owner))
    h, owner = h[o], owner[o]
    new = np.r_[True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])]
    return h[new], np.bincount(owner[new], minlength=n)


def _sets(batch: pa.RecordBatch, shingle: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    every, offsets = flat(batch.column("text"))
    for lo, hi in blocks(offsets, BLOCK):
        h, c = shingle_sets(every[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], shingle)
        yield lo, hi, h, c


def _digests(h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit digest of each set."""
    at = np.cumsum(c) - c
    out = []
    for salt in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB):
        x = mix(h ^ U64(salt))
        with np.errstate(over="ignore"):
            sums = np.r_[U64(0), np.cumsum(x, dtype=U64)]
            out.append(mix((sums[at + c] - sums[at]) ^ mix(c.astype(U64) + U64(salt))))
    return out[0], out[1]


SUMMARY = "doc long, n long, a long, b long, salt int"


def _summaries(shingle: int):
    _, out = arrow_schema(SUMMARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc").to_numpy()
            for lo, hi, h, c in _sets(batch, shingle):
                a, b = _digests(h, c)
                yield emit(out, {"doc": ids[lo:hi], "n": c, "a": a, "b": b, "salt": np.arange(lo, hi) % SALTS})

    return run


def _unseen(h: np.ndarray, c: np.ndarray, seen: set) -> np.ndarray:
    out = np.zeros(len(c), bool)
    for i, key in enumerate(_digests(h, c)[0].tolist()):
        if key not in seen:
            out[i] = True
            if len(seen) < 1 << 20:
                seen.add(key)
    return out


def _slot(h: np.ndarray, slots: int) -> np.ndarray:
    return (h >> U64(40)).astype(np.int64) & (slots - 1)


def _frequencies(shingle: int, slots: int):
    """Per task: how many documents hold a token of each slot, in pieces of the sketch."""
    piece = min(slots, 1 << 16)
    _, out = arrow_schema("piece int, counts binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(slots, np.int64)
        seen: set = set()
        for batch in batches:
            for _, _, h, c in _sets(batch, shingle):
                new = _unseen(h, c, seen)  # copies of a set count once in a task
                np.add.at(counts, _slot(h[np.repeat(new, c)], slots), 1)
        for i in range(0, slots, piece):
            yield emit(out, {"piece": [i // piece], "counts": [np.minimum(counts[i : i + piece], (1 << 32) - 1).astype("<u4").tobytes()]})

    def add(pieces: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(pieces, ["piece"], 1):
            sums: dict[int, np.ndarray] = {}
            for p, raw in zip(t.column("piece").to_pylist(), t.column("counts").to_pylist(), strict=True):
                x = np.frombuffer(raw, "<u4").astype(np.int64)
                sums[p] = sums[p] + x if p in sums else x
            for p, x in sums.items():
                level = np.round(4 * np.log2(1 + x)).astype(np.uint8)
                yield emit(out, {"piece": [p], "counts": [level.tobytes()]})

    return run, add


def sketch(texts: DataFrame, shingle: int, slots: int = SLOTS) -> np.ndarray:
    """Log-scale token frequencies; ``slots`` bytes, whatever the corpus."""
    run, add = _frequencies(shingle, slots)
    summed = texts.mapInArrow(run, "piece int, counts binary").repartition("piece").sortWithinPartitions("piece").mapInArrow(add, "piece int, counts binary")
    rows = sorted(summed.collect(), key=lambda r: r["piece"])
    return np.concatenate([np.frombuffer(r["counts"], np.uint8) for r in rows]) if rows else np.zeros(slots, np.uint8)


def prefix_lengths(n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """How many first tokens a set must show to sets that are not longer (probe)
    and to sets that are not shorter (index)."""
    probe = n - -(-n * percent // 100) + 1
    index = n - -(-2 * percent * n // (100 + percent)) + 1
    return np.minimum(n, probe), np.minimum(n, index)


def _in_order(h: np.ndarray, owner: np.ndarray, levels: np.ndarray, order: int) -> np.ndarray:
    return np.lexsort((mix(h ^ U64(ORDERS[order])), levels[_slot(h, len(levels))], owner))


PREFIXES = "token long, doc long, n int, at int"
DEALT = PREFIXES + ", deal int"


def _first_prefixes(shingle: int, percent: int, levels_of, hot: int):
    """The first tokens of each set. A token of very many classes is dealt in as
    many ways as its estimated frequency asks for (``deal`` is above 0)."""
    _, out = arrow_schema(DEALT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = levels_of.value
        for batch in batches:
            ids = batch.column("doc").to_numpy()
            parts, digests = [], []
            for lo, hi, h, c in _sets(batch, shingle):
                owner = np.repeat(np.arange(hi - lo), c)
                digests.append(_digests(h, c))
                h = h[_in_order(h, owner, levels, 0)]
                probe, _ = prefix_lengths(c, percent)
                parts.append((lo, hi, h[ranges(np.cumsum(c) - c, probe)], c, probe))
            da, db = (np.concatenate(x) for x in zip(*digests, strict=True))
            o = np.lexsort((ids, db, da))
            head = np.zeros(len(ids), bool)  # of equal sets, that with the smallest id stands for all
            head[o[np.r_[True, (da[o][1:] != da[o][:-1]) | (db[o][1:] != db[o][:-1])]]] = True
            for lo, hi, shown, c, probe in parts:
                row, at = np.repeat(np.arange(hi - lo), probe), ranges(np.zeros(hi - lo, np.int64), probe)
                keep = head[lo:hi][row]
                token, doc = shown[keep], ids[lo:hi][row][keep]
                classes = np.exp2(levels[_slot(token, len(levels))] / 4)
                ways = np.where(classes > hot, np.ceil(classes / (hot / 4)), 1).astype(U64)
                deal = np.where(ways > 1, 1 + (mix(doc.astype(U64)) % ways).astype(np.int64), 0)
                yield emit(out, {"token": token, "doc": doc, "n": c[row][keep], "at": at[keep], "deal": deal})

    return run


SETS = "doc long, n int, tokens binary, second binary, third binary"


def _whole_sets(shingle: int, percent: int, levels_of):
    """The sorted set of each document, and its prefixes under the second and the
    third order as 32-bit digests."""
    _, out = arrow_schema(SETS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = levels_of.value
        for batch in batches:
            ids = batch.column("doc").to_numpy()
            for lo, hi, h, c in _sets(batch, shingle):
                owner = np.repeat(np.arange(hi - lo), c)
                first = np.cumsum(c) - c
                probe, _ = prefix_lengths(c, percent)
                cut = np.r_[0, np.cumsum(probe)]
                rows = {"doc": ids[lo:hi], "n": c, "tokens": [h[f : f + k].tobytes() for f, k in zip(first, c, strict=True)]}
                for name, r in (("second", 1), ("third", 2)):
                    shown = h[_in_order(h, owner, levels, r)[ranges(first, probe)]].astype(np.uint32)
                    rows[name] = [shown[f:t].tobytes() for f, t in zip(cut[:-1], cut[1:], strict=True)]
                for i in range(0, hi - lo, 1000):
                    yield emit(out, {k: v[i : i + 1000] for k, v in rows.items()})

    return run


def _can_link(nx: np.ndarray, ny: np.ndarray, ax: np.ndarray, ay: np.ndarray, percent: int) -> np.ndarray:
    """Sizes near enough, and enough tokens from the shared one on, taking it as
    the first that both hold; and the prefixes that must have met."""
    least = -(-percent * (nx + ny) // (100 + percent))
    fits = (100 * np.minimum(nx, ny) >= percent * np.maximum(nx, ny)) & (np.minimum(nx - ax, ny - ay) >= least)
    _, ix = prefix_lengths(nx, percent)
    _, iy = prefix_lengths(ny, percent)
    return fits & np.where(nx >= ny, ay < iy, ax < ix)


PAIRS = "a long, b long"


def _partners(percent: int, some: int = 200_000):
    """Rows that may have a partner in their meeting; the others lead to no pair.
    A meeting that was dealt out is not seen whole, and keeps all its rows."""
    _, out = arrow_schema(PREFIXES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["token", "deal"], some):
            token, doc, n, at, deal = (t.column(c).to_numpy().astype(np.int64) for c in ("token", "doc", "n", "at", "deal"))
            o = np.lexsort((n, deal, token))
            token, doc, n, at, deal = token[o], doc[o], n[o], at[o], deal[o]
            same = (token[1:] == token[:-1]) & (deal[1:] == deal[:-1])
            head = np.flatnonzero(np.r_[True, ~same])
            size = np.diff(np.r_[head, len(token)])
            each = np.repeat(size, size)
            keep = np.zeros(len(token), bool)
            next_ = np.flatnonzero(same & (100 * n[:-1] >= percent * n[1:]))
            keep[next_] = keep[next_ + 1] = True
            keep &= each > 8
            group, small = np.repeat(head, size), each <= 8
            for gap in range(1, 8):
                x = np.flatnonzero(small[: len(token) - gap] & (group[gap:] == group[: len(token) - gap])) if len(token) > gap else np.zeros(0, np.int64)
                ok = x[_can_link(n[x], n[x + gap], at[x], at[x + gap], percent) & (doc[x] != doc[x + gap])]
                keep[ok] = keep[ok + gap] = True
            keep |= deal > 0
            if keep.any():
                yield emit(out, {"token": token[keep], "doc": doc[keep], "n": n[keep], "at": at[keep]})

    return run


def _meetings(percent: int, leaders: int | None):
    """Pairs of each meeting whose components differ: with the ``leaders`` most
    central classes, or all. Two ``guest`` rows of a piece are not paired there."""
    _, out = arrow_schema(PAIRS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["token", "salt"], 50_000):
            token, salt, doc, n, at, comp = (t.column(c).to_numpy().astype(np.int64) for c in ("token", "salt", "doc", "n", "at", "comp"))
            guest = t.column("guest").to_numpy(zero_copy_only=False).astype(np.int64)
            o = np.lexsort((doc, at, guest, salt, token))
            token, salt, doc, n, at, comp, guest = (x[o] for x in (token, salt, doc, n, at, comp, guest))
            head = np.flatnonzero(np.r_[True, (token[1:] != token[:-1]) | (salt[1:] != salt[:-1])])
            size = np.diff(np.r_[head, len(token)])
            own = size - np.add.reduceat(guest, head) if len(head) else size
            done: list[np.ndarray] = []
            held = lead = 0
            while True:
                on = (size > lead + 1) & (own > lead)
                x_all = head[on]
                if not len(x_all) or (leaders is not None and lead >= leaders):
                    break
                left = size[on] - lead - 1
                for part in np.array_split(np.arange(len(x_all)), 1 + int(left.sum()) // 250_000):
                    y = ranges(x_all[part] + lead + 1, left[part])
                    x = np.repeat(x_all[part] + lead, left[part])
                    ok = (comp[x] != comp[y]) & (doc[x] != doc[y])
                    x, y = x[ok], y[ok]
                    ok = _can_link(n[x], n[y], at[x], at[y], percent)
                    a, b = doc[x[ok]], doc[y[ok]]
                    done.append(np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0))
                    held += len(done[-1])
                    if held > 200_000:
                        pairs, done, held = np.unique(np.concatenate(done), axis=0), [], 0
                        yield emit(out, {"a": pairs[:, 0], "b": pairs[:, 1]})
                lead += 1
            if held:
                pairs = np.unique(np.concatenate(done), axis=0)
                yield emit(out, {"a": pairs[:, 0], "b": pairs[:, 1]})

    return run


def _rows_that(test, columns: str):
    """Rows (a, b) of a joined pair that pass ``test``."""
    _, out = arrow_schema(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                keep = [r for r in batch.slice(i, 500).to_pylist() if test(r)]
                yield emit(out, {"a": [r["a"] for r in keep], "b": [r["b"] for r in keep]})

    return run


def _prefixes_meet(r: dict) -> bool:
    """Whether the prefixes of both other orders share a token."""
    return all(len(np.intersect1d(*(np.frombuffer(r[f"{name}_{s}"], np.uint32) for s in "xy"))) for name in ("second", "third"))


def _linked(percent: int):
    def linked(r: dict) -> bool:
        x, y = (np.frombuffer(r[f"tokens_{s}"], U64) for s in "xy")
        both = len(np.intersect1d(x, y, assume_unique=True))
        return 100 * both >= percent * (len(x) + len(y) - both)

    return linked


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(doc, comp) for all ends of ``edges`` (a, b): comp is the smallest id
    reachable. Alternates large-star and small-star steps. The smallest
    neighbour is a pre-aggregated minimum and comes back by a join, which may
    split a node with very many edges."""
    e = stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    told = lambda d: tuple(d.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    was = told(e)
    for _ in range(rounds):
        both = e.union(e.select("b", "a"))
        # large star: a node's larger neighbours move to its smallest neighbour, or itself
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # small star: a node and its smaller neighbours move to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = stage(moved.union(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct(), "edges")
        now = told(e)
        if now == was:
            break
        was = now
    else:
        raise RuntimeError("components did not settle")
    return e.groupBy(F.col("a").alias("doc")).agg(F.min("b").alias("comp")).unionByName(e.select(F.col("b").alias("doc"), F.col("b").alias("comp")).distinct())


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS, hot: int = HOT) -> DataFrame:
    """(id, n_shingles, component_id) of every row."""
    with arrow_batches(docs.sparkSession, BATCH):
        return _near_duplicates(docs, shingle, percent, id_col, text_col, slots, hot)


def _near_duplicates(docs: DataFrame, shingle: int, percent: int, id_col: str, text_col: str, slots: int, hot: int) -> DataFrame:
    """Runs all but its last join, so that the batch size holds for its stages."""
    spark = docs.sparkSession
    texts = docs.select(id_or_lowest(id_col).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    known = F.col("doc") != NULL_ID
    # every row with the digest of its set; rows of one set are dealt in SALTS ways,
    # so that a set that a third of all rows have is as many small groups
    summary = stage(texts.mapInArrow(_summaries(shingle), SUMMARY), "sets")
    held = summary.filter(known & (F.col("n") > 0))
    dealt = stage(held.groupBy("a", "b", "n", "salt").agg(F.min("doc").alias("low")), "classes")
    heads = dealt.groupBy("a", "b", "n").agg(F.min("low").alias("head"))
    classes = stage(dealt.join(heads, ["a", "b", "n"]).select("a", "b", "n", "salt", "head"), "classes")

    levels = spark.sparkContext.broadcast(sketch(texts, shingle, slots))  # ``slots`` bytes, whatever the corpus
    found = texts.filter(known).mapInArrow(_first_prefixes(shingle, percent, levels, hot), DEALT)
    met = stage(found.repartition("token", "deal").sortWithinPartitions("token", "deal").mapInArrow(_partners(percent), PREFIXES), "meetings")
    met = stage(met.join(classes.select(F.col("head").alias("doc")).distinct(), "doc", "left_semi"), "meetings")
    whole = texts.join(met.select("doc").distinct(), "doc", "left_semi").mapInArrow(_whole_sets(shingle, percent, levels), SETS)
    if not held.groupBy("doc").count().filter("count > 1").isEmpty():  # a repeated row's set counts once
        whole = whole.distinct()
    whole = stage(whole, "whole")

    def both_of(pairs: DataFrame, *names: str) -> DataFrame:
        side = lambda doc, s: whole.select(F.col("doc").alias(doc), *(F.col(c).alias(f"{c}_{s}") for c in names))
        return pairs.join(side("a", "x"), "a").join(side("b", "y"), "b")

    def verify(pairs: DataFrame) -> DataFrame:
        candidates = both_of(pairs, "second", "third").mapInArrow(_rows_that(_prefixes_meet, PAIRS), PAIRS).distinct()
        return both_of(candidates, "tokens").mapInArrow(_rows_that(_linked(percent), PAIRS), PAIRS).distinct()

    # ids with several texts tie their classes together
    texts_of = held.groupBy("doc").agg(F.min(F.struct("a", "b", "n")).alias("x"), F.max(F.struct("a", "b", "n")).alias("y")).filter("x <> y").select("doc")
    several = held.join(texts_of, "doc").select("doc", "a", "b", "n").distinct().join(heads, ["a", "b", "n"])
    least = several.groupBy("doc").agg(F.min("head").alias("b"))
    links = stage(several.select("doc", F.col("head").alias("a")).join(least, "doc").select("a", "b").filter("a <> b"), "links")
    tried = None
    comp = None
    for turn, leaders in enumerate((1, 8, None)):
        rows = met.withColumn("comp", F.col("doc")) if comp is None else met.join(comp, "doc", "left").withColumn("comp", F.coalesce("comp", "doc"))
        sizes = rows.groupBy("token").agg(F.count("*").alias("m"), F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high").select("token", F.ceil(F.col("m") / (SPREAD if leaders else PAIRED)).cast("int").alias("blocks"))
        # blocks are drawn anew in each round, so that components of one round's blocks meet in the next
        block = F.pmod(F.xxhash64("doc", F.lit(turn)), F.col("blocks")).cast("int")
        rows = rows.join(sizes, "token").withColumn("block", block)
        if leaders is None:
            # classes of a meeting's main component need no pairs among themselves: they stay in their
            # own block, and only the others visit all blocks, as guests
            each = rows.groupBy("token", "comp").agg(F.count("*").alias("m"))
            main = each.groupBy("token").agg(F.max_by("comp", F.struct("m", F.negative("comp"))).alias("main"))
            own = F.array(F.col("block"))
            rows = rows.join(main, "token").withColumn("salt", F.explode(F.when(F.col("comp") == F.col("main"), own).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))))
            rows = rows.withColumn("guest", F.col("salt") != F.col("block"))
        else:
            rows = rows.withColumn("salt", F.col("block")).withColumn("guest", F.lit(False))
        rows = rows.withColumn("salt", F.col("salt").cast("long"))
        pairs = rows.select("token", "salt", "doc", "n", "at", "comp", "guest").repartition("token", "salt").sortWithinPartitions("token", "salt").mapInArrow(_meetings(percent, leaders), PAIRS).distinct()
        pairs = stage(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        if pairs.isEmpty() and comp is not None:
            continue  # a later round tries more pairs
        links = links.union(stage(verify(pairs), "links"))
        tried = pairs if tried is None else tried.union(pairs)
        comp = stage(components(links), "components")
    # components come to the dealt classes first, and from them to the rows
    named = classes.join(comp.withColumnRenamed("doc", "head"), "head", "left").select("a", "b", "n", "salt", F.coalesce("comp", "head").alias("comp"))
    has_set = known & (F.col("n") > 0)
    out = summary.join(named, ["a", "b", "n", "salt"], "left").select("doc", "n", F.when(has_set, F.col("comp")).otherwise(F.col("doc")).alias("comp"))
    real = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return out.select(real("doc").alias(id_col), F.col("n").alias("n_shingles"), real("comp").alias("component_id"))
