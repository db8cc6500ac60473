"""Token counts under a unigram model, with one forward pass per shared prefix.

A text is split at white space; each word, with a leading word mark, is
segmented into vocabulary pieces of the largest total log probability. The
forward scores of a prefix serve every word that starts with it: the distinct
new words of a block are walked in the order of their trie, depth first, so the
path from the root is all that is held, each trie node is scored once, and the
token count at each terminal is stored. Words seen before in the same Python
worker are looked up.

A vocabulary file gives pieces and their order; log probabilities follow the
order by Zipf's law, ``-ln(rank + 1)`` up to a constant, so nothing is trained.
Characters outside the vocabulary are spelled in UTF-8 bytes, one token each.

Null and empty texts have no tokens. Rows that repeat, null ids and extra
columns do no harm; the output keeps one row per input row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm._shared import arrow_schema

MARK = "▁"
COUNTS = "doc_id long, n_words long, n_tokens long, log_prob double"
_MODELS: dict[str, UnigramCounter] = {}


class UnigramCounter:
    def __init__(self, pieces: dict[str, float], byte_score: float, entries: int = 200_000):
        self.pieces, self.byte_score, self.entries = pieces, byte_score, entries
        #: every ending of a piece, with the score of those that are pieces themselves
        self.endings: dict[str, float | None] = {}
        for p in pieces:
            for i in range(len(p)):
                self.endings.setdefault(p[i:], None)
        self.endings.update(pieces)
        self.known: dict[str, tuple[int, float]] = {}

    @classmethod
    def from_file(cls, path: str) -> UnigramCounter:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, rank = {}, 0
        for i in range(model.get_piece_size()):
            if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
                continue
            pieces[model.id_to_piece(i)] = -math.log(rank + 2)
            rank += 1
        return cls(pieces, -2 * math.log(rank + 2))

    def learn(self, words: list[str]) -> None:
        """Score the distinct ``words``, sharing the forward scores of prefixes."""
        if len(self.known) + len(words) > self.entries:
            self.known.clear()
        pieces, get = self.pieces, self.endings.get
        score, count, before = [0.0], [0], ""
        for word in sorted(words):
            spelled = MARK + word
            same, limit = 0, min(len(before), len(spelled))
            while same < limit and before[same] == spelled[same]:
                same += 1
            del score[same + 1 :], count[same + 1 :]
            for i in range(same + 1, len(spelled) + 1):
                single = spelled[i - 1]
                n = 1 if single in pieces else len(single.encode("utf-8", "surrogatepass"))
                best = score[i - 1] + (pieces[single] if single in pieces else n * self.byte_score)
                tokens = count[i - 1] + n
                for j in range(i - 2, -1, -1):
                    lp = get(spelled[j:i], 0.0)
                    if lp == 0.0:  # no piece ends like this
                        break
                    if lp is not None and (s := score[j] + lp) > best:
                        best, tokens = s, count[j] + 1
                score.append(best)
                count.append(tokens)
            before = spelled
            self.known[word] = (count[-1], score[-1])

    def count(self, texts: list[str]) -> tuple[list[int], list[int], list[float]]:
        split = [t.split() for t in texts]
        new = set().union(*split) if split else set()
        missing = [w for w in new if w not in self.known]
        if len(self.known) + len(missing) > self.entries:
            missing = list(new)
        if missing:
            self.learn(missing)
        known = self.known
        n_words, n_tokens, log_prob = [], [], []
        for words in split:
            found = list(map(known.__getitem__, words))
            n_words.append(len(words))
            n_tokens.append(sum(f[0] for f in found))
            log_prob.append(math.fsum(f[1] for f in found))
        return n_words, n_tokens, log_prob


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words, tokens and the best segmentation's log probability of each document."""
    _, out = arrow_schema(COUNTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _MODELS.get(vocabulary) or _MODELS.setdefault(vocabulary, UnigramCounter.from_file(vocabulary))
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                part = b.slice(i, 1000)
                words, tokens, lp = model.count(part.column("text").fill_null("").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(words, pa.int64()), pa.array(tokens, pa.int64()), pa.array(np.round(lp, 6), pa.float64())], schema=out)

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    counted = texts.mapInArrow(run, COUNTS)
    return counted.withColumnRenamed("doc_id", id_col) if id_col != "doc_id" else counted
