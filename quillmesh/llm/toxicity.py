"""Toxicity by a weighted finite-state grammar of clauses.

Five transducers are composed and run over every clause that holds an insult or
a threat: a lexicon (words to insult, threat, target, negation, report or other),
negation (its scope is the next few words), reported speech (the rest of the
clause after a verb of saying), targets (a person spoken to or of shortly before
or after), and a counter that reads the marked symbols off. The composed machine
is deterministic and its steps are remembered, so a clause costs one lookup per
word. What is scored is the kind of matched clause, not the word alone: an
insult, one aimed at somebody, one negated, one reported, and likewise threats.

The weights of those kinds are learned by logistic regression from labelled
rows, at most ``SAMPLE`` of them, chosen by hash; the lexicon is extended by
word beginnings that mark training texts called toxic and hardly any others. The
share of function words of the lexicon's language in a text says how far the grammar can judge it at all; a text in another language keeps the prior.
Without labels of both kinds, fixed weights are used.

In scripts without blanks a word may begin at every character, so that an insult
is found anywhere in a sentence; what a found one covers is not read again.

Null, empty and very long texts get a score like any other, read whole. Labels of null ids are unused;
a repeated label counts once, and of contradicting ones the toxic counts; of an
id's several texts the fit reads the first. Every row is scored on its own, so
repeated rows get their own scores and an empty table gives none. Extra columns
are ignored; of the kept ones, "score" and "predicted" give way to the results.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.llm._shared import arrow_schema

SAMPLE = 20_000  #: labelled rows that the fit reads at most
STEM = (4, 8)  #: shortest and longest learned word beginnings
DENSE_STEM = (2, 4)  #: the same in scripts without blanks, in characters
SUPPORT = 3  #: toxic texts that a learned beginning must explain
CAUTION = 3  #: toxic texts that make up for one other text with the same beginning
LEARNED = 200  #: size of the model: beginnings that the fit picks

INSULTS = frozenset(
    """idiot idiots idiotic moron morons moronic stupid dumb dumbass imbecile imbeciles loser losers scum scumbag trash garbage filth filthy vermin worthless
    pathetic disgusting clown clowns fool fools foolish jerk jerks bastard bastards bitch bitches asshole assholes dickhead prick twat wanker creep creeps
    cretin cretins degenerate degenerates lowlife parasite parasites pig pigs rat rats coward cowards crap shit shithead bullshit retard retarded ugly useless
    subhuman repulsive vile whore slut freak freaks nitwit halfwit dimwit airhead blockhead numbskull
    idiota idiotas estúpido estúpida estúpidos imbécil imbéciles basura escoria payaso payasos inútil asqueroso asquerosa
    dummkopf trottel versager abschaum arschloch idiotin widerlich
    imbécile imbéciles débile ordure minable crétin connard salaud
    白痴 笨蛋 傻瓜 傻逼 混蛋 垃圾 废物 蠢货 馬鹿 バカ クズ ゴミ""".split()
)
THREATS = frozenset("kill kills killing murder destroy hurt beat smash crush punch stab shoot burn strangle hang slaughter exterminate bash die 杀死 打死 弄死 殺す".split())
TARGETS = frozenset("you your you're youre yours u yourself he she him her his they them their these those people everyone he's she's they're guy guys woman women man men kid kids author du ihr sie tu vous usted ustedes 你 您 他 她 你们 お前 あなた".split())
NEGATIONS = frozenset("not no never isn't isnt aren't arent wasn't wasnt weren't don't dont doesn't didn't cannot can't cant won't wouldn't hardly neither nor without nobody kein keine nicht pas jamais nunca 不 没 别".split())
REPORTS = frozenset("said says say called calls calling told tells wrote writes quoted quote quotes reported reportedly alleged allegedly accused claims claimed shouted shouts yelled term word phrase insult slur sagte dijo dit 说 报道 言った".split())
FUNCTION_WORDS = frozenset("the of and to in a is that for it as was with be by on not he his at from are this or had have which you were her they an she one all we their there been has".split())

INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER, END = "ITYNRo."
KINDS = ("insult", "insult_target", "insult_negated", "insult_reported", "threat", "threat_target", "threat_negated", "threat_reported")
FEATURES = (*KINDS, "distinct", "share", "covered", "bias")
#: Log-odds used where nothing can be learned.
FALLBACK = (1.2, 2.0, -0.4, -0.2, 0.4, 1.6, -0.2, -0.1, 1.6, 1.0, -0.5, -3.0)

_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")
_CLAUSE = re.compile(r"[.!?;:\n…。！？；：]+|,\s|\s[-–—]\s|[，、]")
#: Characters of scripts that set no blanks between words: Thai to Burmese, Khmer, kana, Han.
_DENSE = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\U00020000-\U0003ffff]+")
_LEET = str.maketrans("013457@$", "oieastas")
NEG_SCOPE, NEAR = 3, 6


class Negation:
    """Marks what stands in the scope of a negation: the next few words."""

    start = 0

    @staticmethod
    def step(left: int, symbol: str):
        return (NEG_SCOPE, (symbol, False)) if symbol == NEGATION else (max(left - 1, 0), (symbol, left > 0))


class Report:
    """Marks the rest of a clause after a verb of saying."""

    start = False

    @staticmethod
    def step(reported: bool, marked: tuple):
        return reported or marked[0] == REPORT, (*marked, reported)


class Target:
    """Marks what follows soon after a person spoken to or of."""

    start = 0

    @staticmethod
    def step(since: int, marked: tuple):
        return NEAR if marked[0] == TARGET else max(since - 1, 0), (*marked, since > 0)


class Reader:
    """Reads the marked symbols off as kinds. An insult or threat that nothing
    marks waits for a target close behind it. ``END`` closes the clause."""

    start = ("", 0)

    @staticmethod
    def step(state: tuple, marked: tuple):
        (waiting, wait), (symbol, negated, reported, aimed) = state, marked
        before = (waiting,) if waiting else ()
        if symbol in (INSULT, THREAT):
            name = "insult" if symbol == INSULT else "threat"
            mark = "negated" if negated else "reported" if reported else "target" if aimed else ""
            return (("", 0), (*before, f"{name}_{mark}")) if mark else ((name, NEAR), before)
        if waiting and symbol == TARGET:
            return ("", 0), (f"{waiting}_target",)
        if waiting and (wait <= 1 or symbol == END):
            return ("", 0), before
        return (waiting, wait - 1) if waiting else state, ()


class Composed:
    """Transducers one after the other, each reading what the last one writes. A
    state is a state of each; those that are met are remembered with their steps,
    so that the machine is as good as written out."""

    def __init__(self, *parts):
        self.parts, self.start = parts, tuple(p.start for p in parts)
        self.steps: dict[tuple, tuple] = {}

    def step(self, state: tuple, symbol: str) -> tuple[tuple, tuple[str, ...]]:
        got = self.steps.get((state, symbol))
        if got is None:
            after, out = [], symbol
            for part, s in zip(self.parts, state, strict=True):
                s, out = part.step(s, out)
                after.append(s)
            got = self.steps[state, symbol] = tuple(after), out
        return got

    def read(self, symbols: list[str]) -> Iterator[str]:
        state = self.start
        for s in (*symbols, END):
            state, out = self.step(state, s)
            yield from out


class Grammar:
    def __init__(self, learned: tuple[str, ...] = ()):
        self.lexicon: dict[str, str] = {}
        for words, symbol in ((REPORTS, REPORT), (TARGETS, TARGET), (NEGATIONS, NEGATION), (THREATS, THREAT), (INSULTS, INSULT)):
            self.lexicon.update(dict.fromkeys(words, symbol))
        self.stems: dict[int, frozenset[str]] = {n: frozenset(x for x in learned if len(x) == n) for n in sorted({len(x) for x in learned})}
        self.triggers = {w for w, s in self.lexicon.items() if s in (INSULT, THREAT)}
        self.longest = max([DENSE_STEM[1], *(len(w) for w in self.lexicon if _DENSE.match(w))])
        self.machine = Composed(Negation, Report, Target, Reader)

    def words(self, clause: str) -> list[tuple[str, str]]:
        """The words of a clause with their symbols. A run of a script without blanks
        is read from each place on: what begins there, longest first, or one character."""
        out = []
        for word in _WORD.findall(clause):
            at, n = 0, len(word)
            while at < n:
                run = None if word.isascii() else _DENSE.search(word, at)
                if run is None or run.start() > at:
                    end = n if run is None else run.start()
                    piece = word[at:end].replace("’", "'")
                    out.append((piece, self.symbol(piece)))
                    at = end
                    continue
                while at < run.end():
                    size, symbol = self.dense(word[at : min(run.end(), at + self.longest)])
                    out.append((word[at : at + size], symbol))
                    at += size
        return out

    def dense(self, run: str) -> tuple[int, str]:
        """Length and symbol of the word that a run begins with."""
        for size in range(len(run), 0, -1):
            piece = run[:size]
            got = self.lexicon.get(piece)
            if got is None and piece in self.stems.get(size, ()):
                got = INSULT
            if got is not None:
                return size, got
        return 1, OTHER

    def symbol(self, word: str) -> str:
        got = self.lexicon.get(word)
        if got is None and any(word[:n] in stems for n, stems in self.stems.items()):
            return INSULT
        if got is None and not word.isalpha() and any(c.isalpha() for c in word):
            got = self.lexicon.get(word.translate(_LEET))
            return got if got in (INSULT, THREAT) else OTHER
        return got or OTHER

    def insulting(self, text: str) -> bool:
        return any(s == INSULT for w in set(_WORD.findall(text.lower())) for _, s in self.words(w))

    def features(self, text: str) -> list[float]:
        low = text.lower()
        words = low.split()
        counts = dict.fromkeys(KINDS, 0)
        distinct: set[str] = set()
        clauses = hits = 0
        plain = {w.strip(".,!?;:\"'()[]*%$&#…“”„«»") for w in set(words)}
        odd = {w for w in plain if not w.isalpha() and any(map(str.isalpha, w))}
        if _DENSE.search(low) or not plain.isdisjoint(self.triggers) or any(w[:n] in stems for n, stems in self.stems.items() for w in plain) or any(self.symbol(p) in (INSULT, THREAT) for w in odd for p in (w, *_WORD.findall(w))):
            for clause in _CLAUSE.split(low):
                read = self.words(clause)
                if not read:
                    continue
                clauses += 1
                symbols = [s for _, s in read]
                if INSULT in symbols or THREAT in symbols:
                    hits += 1
                    distinct.update(t for t, s in read if s == INSULT)
                    for kind in self.machine.read(symbols):
                        counts[kind] += 1
        covered = sum(map(FUNCTION_WORDS.__contains__, words)) / max(len(words), 1)
        return [*(math.log1p(counts[k]) for k in KINDS), math.log1p(len(distinct)), hits / max(clauses, 1), min(1.0, 5 * covered), 1.0]


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Logistic regression by Newton's method; the bias is not shrunk."""
    w = np.zeros(x.shape[1])
    shrink = np.full(x.shape[1], ridge)
    shrink[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + shrink * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(shrink), gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


class Model:
    def __init__(self, learned: tuple[str, ...], weights: tuple[float, ...]):
        self.learned, self.weights = learned, weights


def _stems_of(text: str) -> set[str]:
    found = set(re.findall(r"[^\W\d_]+", text.lower()))
    runs = {r for w in found if not w.isascii() for r in _DENSE.findall(w)}
    if runs:
        found = {x for w in found for x in _DENSE.sub(" ", w).split()}
    words = {w for w in found if len(w) >= STEM[0]}
    stems = {w[:n] for w in words for n in range(STEM[0], min(STEM[1], len(w)) + 1)}
    return stems | {r[i : i + n] for r in runs for n in range(DENSE_STEM[0], DENSE_STEM[1] + 1) for i in range(len(r) - n + 1)}


def _learned_stems(texts: DataFrame) -> tuple[str, ...]:
    """Word beginnings that mark toxic texts in which the lexicon finds no insult.

    Beginnings rather than words, since many languages inflect. They are picked
    greedily: each must explain at least ``SUPPORT`` toxic texts that none
    before it does, and hardly any other text. All inputs are bounded by the
    sample, so counts may come to the driver.
    """

    def toxic_stems(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar()
        for b in batches:
            rows = [(i, sorted(_stems_of(t))) for i, t, y in zip(b.column("key").to_pylist(), b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True) if y == 1 and not grammar.insulting(t)]
            yield pa.RecordBatch.from_pydict({"key": [r[0] for r in rows], "stems": [r[1] for r in rows]}, schema=pa.schema([("key", pa.int64()), ("stems", pa.list_(pa.string()))]))

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}
        for b in batches:
            for t, y in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                if y == 0:
                    for stem in _stems_of(t):
                        counts[stem] = counts.get(stem, 0) + 1
        yield pa.RecordBatch.from_pydict({"stem": list(counts), "n": list(counts.values())}, schema=pa.schema([("stem", pa.string()), ("n", pa.int64())]))

    stems = texts.mapInArrow(toxic_stems, "key long, stems array<string>").select("key", F.explode("stems").alias("stem")).distinct()
    often = stems.groupBy("stem").agg(F.collect_set("key").alias("keys")).filter(F.size("keys") >= SUPPORT)
    clean = texts.mapInArrow(others, "stem string, n long").groupBy("stem").agg(F.sum("n").alias("n"))
    # what other texts hold too often can never be picked, so it stays where it is
    n = F.coalesce("n", F.lit(0))
    found = often.join(clean, "stem", "left").filter(F.size("keys") - CAUTION * n >= SUPPORT).select("stem", "keys", n.alias("n")).collect()
    marks, clean = {r["stem"]: set(r["keys"]) for r in found}, {r["stem"]: r["n"] for r in found}
    picked: list[str] = []
    while marks and len(picked) < LEARNED:
        # of equal gains the shorter beginning covers more forms
        best = max(marks, key=lambda m: (len(marks[m]) - CAUTION * clean[m], -len(m), m))
        gain = len(marks[best])
        if gain < SUPPORT or gain - CAUTION * clean[best] < SUPPORT:
            break
        picked.append(best)
        done = marks.pop(best)
        marks = {m: left for m, keys in marks.items() if len(left := keys - done) >= SUPPORT}
    return tuple(sorted(picked))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled rows outside the held-out quarter."""
    usable = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(id_col))
    chosen = usable.groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("toxic")).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    # at most ``sample`` rows, so it may be broadcast: the texts are not shuffled
    plain = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # an id with several texts counts with the first of them, so the sample keeps its bound
    texts = plain.join(F.broadcast(chosen), "_id").groupBy("_id").agg(F.first("toxic").alias("toxic"), F.min("text").alias("text")).select("toxic", "text").withColumn("key", F.xxhash64("text")).persist()
    learned = _learned_stems(texts)
    grammar_of = lambda: Grammar(learned)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = grammar_of()
        for b in batches:
            yield pa.RecordBatch.from_pydict({"toxic": b.column("toxic").to_pylist(), "x": [grammar.features(t) for t in b.column("text").to_pylist()]}, schema=pa.schema([("toxic", pa.int32()), ("x", pa.list_(pa.float64()))]))

    rows = texts.mapInArrow(measure, "toxic int, x array<double>").collect()  # bounded by ``sample``
    texts.unpersist()
    rows.sort(key=lambda r: (r["toxic"], r["x"]))  # sums in one order, so that reruns agree
    y = np.array([r["toxic"] for r in rows], float)
    if len(y) == 0 or y.min() == y.max():
        return Model(learned, FALLBACK)
    return Model(learned, tuple(fit(np.array([r["x"] for r in rows]), y).tolist()))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, keep: tuple[str, ...] | None = None) -> DataFrame:
    """``keep`` columns (the id by default), score and predicted.

    ``text_col`` may name a field of a kept struct, as "row.text", so that whole
    rows can pass through with their text once.
    """
    names = [n for n in ((id_col,) if keep is None else keep) if n not in ("score", "predicted")]
    within, _, field = text_col.rpartition(".")
    inner = max([*names, "_text"], key=len) + "_"
    base = docs.select(*names) if within else docs.select(*names, F.col(text_col).alias(inner))
    fields = [f for f in base.schema if f.name != inner]
    schema, out = arrow_schema(", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", score double, predicted int")
    learned, weights = model.learned, np.array(model.weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(learned)
        for b in (whole.slice(i, 1000) for whole in batches for i in range(0, whole.num_rows, 1000)):
            texts = b.column(within).field(field) if within else b.column(inner)
            x = np.array([grammar.features(t or "") for t in texts.to_pylist()]).reshape(-1, len(weights))
            s = np.round(1 / (1 + np.exp(-np.clip((x * weights).sum(axis=1), -30, 30))), 9)
            arrays = [*(b.column(f.name) for f in fields), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays, schema=pa.schema([*(b.schema.field(f.name) for f in fields), out.field("score"), out.field("predicted")]))

    return base.mapInArrow(run, schema)
