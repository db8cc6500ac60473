"""Shapes, captions and words placed on slides and images.

Things meet by the cells of a grid that their boxes cover, so a page's shapes are
never paired all with all; the exact test follows. Words of pages of up to ``WHOLE``
words meet where they lie, in batches of whole pages. Coordinates grow rightwards and
downwards. ``page`` names the slide or image; pages are independent of each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.operators.graph import components, dealt, settled

# How far a word's box grows, in heights of a typical word, before it
# touches its neighbours; the bands of reading order and the rules of a grid.
GROW_X, GROW_Y = 1.6, 0.9
BAND, ROW_TOLERANCE, EDGE_TOLERANCE, FULL_SHARE = 2.0, 1.5, 2.5, 0.6
LEAST_CONFIDENCE, LEAST_BLOCKS = 70.0, 5

_EDGES = ("left", "top", "right", "bottom")
WHOLE = 4096  #: words up to which one task may hold a page; longer ones meet on the grid


def _cells(low: Column, high: Column, size: Column | float) -> Column:
    size = F.lit(size) if isinstance(size, (int, float)) else size
    return F.sequence(F.floor(low / size), F.floor(high / size))


def on_grid(df: DataFrame, left: Column, top: Column, right: Column, bottom: Column, size: Column | float) -> DataFrame:
    """A row for every grid cell (``gx``, ``gy``) that a box covers."""
    return df.withColumn("gx", F.explode(_cells(left, right, size))).withColumn("gy", F.explode(_cells(top, bottom, size)))


def snapped(points: DataFrame, boxes: DataFrame, reach: float) -> DataFrame:
    """(page, point, box, dist): the nearest box within ``reach`` of a point; of
    equal distances the smaller box. Points on one spot and boxes that lie on each
    other are looked at once: work follows the places that are taken, not the pairs."""
    x, y = F.col("x"), F.col("y")
    spots = points.select("page", "x", "y").distinct().withColumn("gx", F.floor(x / reach)).withColumn("gy", F.floor(y / reach))
    first = boxes.groupBy("page", *_EDGES).agg(F.min("box").alias("box"))  # of boxes that lie on each other
    b = on_grid(first, F.col("left") - reach, F.col("top") - reach, F.col("right") + reach, F.col("bottom") + reach, reach)
    dx, dy = F.greatest(F.col("left") - x, F.lit(0.0), x - F.col("right")), F.greatest(F.col("top") - y, F.lit(0.0), y - F.col("bottom"))
    near = spots.join(b, ["page", "gx", "gy"]).withColumn("dist", F.sqrt(dx * dx + dy * dy)).filter(F.col("dist") <= reach)
    found = near.groupBy("page", "x", "y").agg(F.min_by("box", F.struct("dist", "box")).alias("box"), F.min("dist").alias("dist"))
    met = points.select("page", "point", "x", "y").join(found, ["page", "x", "y"])
    return met.groupBy("page", "point").agg(F.min_by("box", F.struct("dist", "box")).alias("box"), F.min("dist").alias("dist"))


def chains(arrows: DataFrame, steps: DataFrame, straight: float, pad: float, size: float) -> DataFrame:
    """(page, arrow, place, a, b): arrows with the steps that lie on them put in.

    ``arrows`` (page, arrow, a, b, x0, y0, x1, y1) lead from step a to step b;
    ``steps`` are (page, step, x, y), their centres. Only a straight arrow (one side of its
    box at most ``straight``) takes in steps: those whose centre is in its box,
    widened by ``pad``, in order of their distance from the step it leaves, then
    by id. Arrows whose ends are unknown steps stay as they are."""
    e = arrows.withColumns({"left": F.least("x0", "x1"), "right": F.greatest("x0", "x1"), "top": F.least("y0", "y1"), "bottom": F.greatest("y0", "y1")})
    at = steps.select("page", F.col("step"), F.col("x").alias("sx"), F.col("y").alias("sy"))
    known = e.join(at.withColumnRenamed("step", "a"), ["page", "a"]).join(at.select("page", F.col("step").alias("b")), ["page", "b"], "left_semi")
    run = known.filter(F.least(F.col("right") - F.col("left"), F.col("bottom") - F.col("top")) <= straight)
    wide = on_grid(run, F.col("left") - pad, F.col("top") - pad, F.col("right") + pad, F.col("bottom") + pad, size)
    s = steps.select("page", "step", "x", "y").withColumn("gx", F.floor(F.col("x") / size)).withColumn("gy", F.floor(F.col("y") / size))
    inside = F.col("x").between(F.col("left") - pad, F.col("right") + pad) & F.col("y").between(F.col("top") - pad, F.col("bottom") + pad)
    met = wide.join(s, ["page", "gx", "gy"]).filter(inside & (F.col("step") != F.col("a")) & (F.col("step") != F.col("b")))
    dist = (F.col("x") - F.col("sx")) ** 2 + (F.col("y") - F.col("sy")) ** 2
    order = Window.partitionBy("page", "arrow").orderBy("rank", "dist", "node")
    row = lambda df, rank, d, node: df.select("page", "arrow", F.lit(rank).alias("rank"), d.alias("dist"), F.col(node).alias("node"))
    zero = F.lit(0.0)
    nodes = row(arrows, 0, zero, "a").unionByName(row(met, 1, dist.cast("double"), "step")).unionByName(row(arrows, 2, zero, "b"))
    linked = nodes.select("page", "arrow", "rank", F.row_number().over(order).alias("place"), F.col("node").alias("a"), F.lead("node").over(order).alias("b"))
    return linked.filter("rank < 2").drop("rank")


def captioned(captions: DataFrame, anchors: DataFrame, reach: float) -> DataFrame:
    """(page, caption, arrow, dist): captions in order of their ids, each with the
    nearest arrow, closer than ``reach``, that none before it took; of equal
    distances the smaller arrow. ``captions`` (page, caption, x, y), ``anchors``
    (page, arrow, x, y).

    Rounds stand in for the loop: a caption is settled once no smaller free caption
    could still take its nearest free arrow. The smallest free caption of a page
    always can be, so rounds end; captions far apart are settled together."""
    c = on_grid(captions.select("page", "caption", "x", "y"), F.col("x") - reach, F.col("y") - reach, F.col("x") + reach, F.col("y") + reach, reach)
    a = anchors.select("page", "arrow", F.col("x").alias("ax"), F.col("y").alias("ay")).withColumn("gx", F.floor(F.col("ax") / reach)).withColumn("gy", F.floor(F.col("ay") / reach))
    near = c.join(a, ["page", "gx", "gy"]).withColumn("dist", F.sqrt((F.col("x") - F.col("ax")) ** 2 + (F.col("y") - F.col("ay")) ** 2)).filter(F.col("dist") < reach)
    free = settled(near.select("page", "caption", "arrow", "dist"), "captions")
    done = None
    while not free.isEmpty():
        best = free.groupBy("page", "caption").agg(F.min_by("arrow", F.struct("dist", "arrow")).alias("arrow"), F.min("dist").alias("dist"))
        first = free.groupBy("page", "arrow").agg(F.min("caption").alias("first"))
        taken = settled(best.join(first, ["page", "arrow"]).filter(F.col("caption") == F.col("first")).select("page", "caption", "arrow", "dist"), "captions")
        done = taken if done is None else done.unionByName(taken)
        free = settled(free.join(taken.select("page", "caption"), ["page", "caption"], "left_anti").join(taken.select("page", "arrow"), ["page", "arrow"], "left_anti"), "captions")
    return free.limit(0) if done is None else done


def _heights(words: DataFrame) -> DataFrame:
    return words.groupBy("page").agg(F.median(F.col("bottom") - F.col("top")).alias("h"))


def _grid_blocks(words: DataFrame) -> DataFrame:
    """(page, word, block) of pages of any size, by the cells that boxes cover."""
    grown = words.select("page", "word", *_EDGES).join(_heights(words), "page").withColumns({"px": F.col("h") * GROW_X, "py": F.col("h") * GROW_Y})
    size = F.greatest(F.col("h") * 4, F.lit(1e-9))
    # boxes a and b touch when a, grown, meets b: a goes to all cells of its grown box, b to those of its own
    wide = on_grid(grown, F.col("left") - F.col("px"), F.col("top") - F.col("py"), F.col("right") + F.col("px"), F.col("bottom") + F.col("py"), size).select("page", "gx", "gy", "px", "py", *(F.col(c).alias(f"a_{c}") for c in ("word", *_EDGES)))
    own = on_grid(grown, F.col("left"), F.col("top"), F.col("right"), F.col("bottom"), size).select("page", "gx", "gy", "word", *_EDGES)
    touch = (F.col("a_left") - F.col("px") <= F.col("right")) & (F.col("left") - F.col("px") <= F.col("a_right")) & (F.col("a_top") - F.col("py") <= F.col("bottom")) & (F.col("top") - F.col("py") <= F.col("a_bottom"))
    met = wide.join(own, ["page", "gx", "gy"]).filter((F.col("a_word") < F.col("word")) & touch)
    edges = met.select(F.struct("page", F.col("a_word").alias("word")).alias("source"), F.struct("page", "word").alias("target")).distinct()
    found = components(words.select(F.struct("page", "word").alias("id")), edges)
    return found.select("id.page", "id.word", F.col("component.word").alias("block"))


def _page_heights(page: np.ndarray, height: np.ndarray) -> np.ndarray:
    """The median height of every page, at each of its words; pages are numbered from 0, nulls are NaN."""
    known = ~np.isnan(height)
    order = np.lexsort((height[known], page[known]))
    number, sorted_ = page[known][order], height[known][order]
    pages = np.arange(page.max() + 1)
    first, after = np.searchsorted(number, pages), np.searchsorted(number, pages, "right")
    n = after - first
    out = np.full(len(pages), np.nan)
    some = n > 0
    low, high = first[some] + (n[some] - 1) // 2, first[some] + n[some] // 2
    out[some] = np.where(low == high, sorted_[low], 0.5 * sorted_[low] + 0.5 * sorted_[high])
    return out[page]


def _least_linked(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest number that links reach, for each number below n."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _touching(page: np.ndarray, word: np.ndarray, left: np.ndarray, top: np.ndarray, right: np.ndarray, bottom: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word the place of its block's smallest word, and its page's height.

    Words are numbered by page and id. Each is tried against those to its right, from the left, until one
    begins behind its end: only words that meet across are looked at."""
    h = _page_heights(page, bottom - top)
    px, py = h * GROW_X, h * GROW_Y
    by_id = np.lexsort((word, page))
    same = (page[by_id][1:] == page[by_id][:-1]) & (word[by_id][1:] == word[by_id][:-1])
    links = [(by_id[:-1][same], by_id[1:][same])]
    order = np.lexsort((left, page))  # NaN last
    at, step = np.arange(len(order)), 0
    while len(at):
        step += 1
        at = at[at + step < len(order)]
        i, j = order[at], order[at + step]
        near = (page[i] == page[j]) & (left[j] - px[j] <= right[i])
        at, i, j = at[near], i[near], j[near]
        met = (left[i] - px[i] <= right[j]) & (top[i] - py[i] <= bottom[j]) & (top[j] - py[j] <= bottom[i])
        links.append((i[met], j[met]))
    rank = np.empty(len(by_id), dtype=np.int64)
    rank[by_id] = np.arange(len(by_id))
    least = _least_linked(len(rank), *(rank[np.concatenate(x)] for x in zip(*links, strict=True)))
    return by_id[least[rank]], h


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    """A column as doubles, nulls as NaN."""
    return column.to_pandas().to_numpy(dtype=np.float64, na_value=np.nan)


def _placed_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words sorted by page, with their block and their page's height; a page that goes on in the next batch waits for it."""

    def placed(t: pa.Table) -> Iterator[pa.RecordBatch]:
        codes = t["page"].combine_chunks().dictionary_encode()
        codes = codes if isinstance(codes, pa.DictionaryArray) else codes.combine_chunks()
        word = t["word"].combine_chunks()
        ids = word.to_numpy(zero_copy_only=False)
        least, h = _touching(codes.indices.to_numpy(zero_copy_only=False).astype(np.int64), ids, *(_numbers(t[c]) for c in _EDGES))
        block = t["word"].take(pa.array(least))
        yield from t.append_column("block", block).append_column("h", pa.array(h, pa.float64(), from_pandas=True)).combine_chunks().to_batches()

    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        page = b.column("page")
        last = page[b.num_rows - 1]
        if page[0] == last and (not held or held[0].column("page")[0] == last):
            held.append(b)
            continue
        begin = int(np.flatnonzero(page.to_pandas().to_numpy() != last.as_py())[-1]) + 1  # of the last page
        yield from placed(pa.Table.from_batches([*held, b.slice(0, begin)]))
        held = [b.slice(begin)]
    if held:
        yield from placed(pa.Table.from_batches(held))


def _placed(words: DataFrame) -> DataFrame:
    """The words that have a page and an id, with their ``block`` and their page's height ``h``."""
    named = words.filter("page is not null and word is not null")
    sizes = named.groupBy("page").agg(F.count("*").alias("n"))
    rows, longest = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    kinds = {f.name: f.dataType.simpleString() for f in words.schema}
    schema = ", ".join(f"`{n}` {k}" for n, k in (kinds | {"block": kinds["word"], "h": "double"}).items())
    within = lambda df: dealt(df, rows, "page").sortWithinPartitions("page").mapInArrow(_placed_batches, schema)
    if longest <= WHOLE:
        return dealt(within(named), rows, "page")
    long = settled(sizes.filter(F.col("n") > WHOLE).select("page"), "pages")
    some = named.join(long, "page", "left_semi")
    met = some.join(settled(_grid_blocks(some), "blocks"), ["page", "word"]).join(_heights(some), "page")
    return dealt(within(named.join(long, "page", "left_anti")).unionByName(met.withColumn("h", F.col("h").cast("double"))), rows, "page")


def word_blocks(words: DataFrame) -> DataFrame:
    """(page, word, block): words whose boxes, grown by about a line height, touch.

    ``words`` are (page, word, left, top, right, bottom). The height of a page is
    the median of its words'. A block is named by its smallest word."""
    return _placed(words.select("page", "word", *_EDGES)).select("page", "word", "block").distinct()


def _sums(words: DataFrame) -> DataFrame:
    """Blocks with the sum of their words' confidences. Words are dealt by page, and so are blocks."""
    met = _placed(words.select("page", "word", *_EDGES, "confidence"))
    return met.groupBy("page", "block").agg(
        F.min("left").alias("left"), F.min("top").alias("top"), F.max("right").alias("right"), F.max("bottom").alias("bottom"), F.count("*").alias("words"),
        F.sum("confidence").alias("_sum"), F.count("confidence").alias("_n"), F.first("h").alias("h"),
    )


def blocks(words: DataFrame) -> DataFrame:
    """(page, block, left, top, right, bottom, words, confidence, h, place) in reading
    order: down the page in bands of two lines, then across, then by name.
    ``words`` also have ``confidence``."""
    band = F.rint(F.col("top") / (F.col("h") * BAND))
    order = Window.partitionBy("page").orderBy(band, "left", "block")
    return _sums(words).select("page", "block", *_EDGES, "words", F.try_divide("_sum", "_n").alias("confidence"), "h", F.row_number().over(order).alias("place"))


def is_grid(tops: list[float], lefts: list[float], height: float) -> bool:
    """Whether a page's blocks line up as the rows and columns of a table."""
    rows: list[list[float]] = []
    start = 0.0
    for top, left in sorted(zip(tops, lefts, strict=True)):
        if rows and abs(top - start) <= height * ROW_TOLERANCE:
            rows[-1].append(left)
        else:
            rows.append([left])
            start = top
    full = [sorted(r) for r in rows if len(r) > 1]
    if len(full) < 2:
        return False
    widths = [len(r) for r in full]
    width = max(widths, key=widths.count)  # of equal counts the first
    same = [r for r in full if len(r) == width]
    columns = zip(*same, strict=True)
    return len(same) >= max(2, FULL_SHARE * len(full)) and all(max(c) - min(c) <= height * EDGE_TOLERANCE for c in columns)


def page_kinds(words: DataFrame) -> DataFrame:
    """(page, blocks, confidence, grid, kind): ``decoration`` below a mean
    confidence of 70; else a table if its blocks form a grid, a diagram if there
    are five or more, and otherwise text. Rows are told apart on a page's blocks
    alone, which are far fewer than its words."""
    b = _sums(words)

    def grids(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in pages:
            told = [is_grid(list(t), list(left), h) for t, left, h in zip(p["tops"], p["lefts"], p["h"], strict=True)]
            yield p.assign(grid=told)[["page", "blocks", "confidence", "grid"]]

    page_type = dict(b.dtypes)["page"]
    lists = b.groupBy("page").agg(
        F.count("*").alias("blocks"), F.try_divide(F.sum("_sum"), F.sum("_n")).alias("confidence"), F.collect_list("top").alias("tops"), F.collect_list("left").alias("lefts"), F.first("h").alias("h")
    )
    sums = lists.mapInPandas(grids, f"page {page_type}, blocks bigint, confidence double, grid boolean")
    kind = F.when(F.col("confidence") < LEAST_CONFIDENCE, "decoration").when(F.col("grid"), "table").when(F.col("blocks") >= LEAST_BLOCKS, "diagram").otherwise("text")
    return sums.withColumn("kind", kind)
