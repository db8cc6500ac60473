"""Redaction of token streams, whatever the split.

Text arrives in pieces, and only what no later piece can change goes out: up to
the last line or sentence end, or, once ``HOLD`` characters wait without one, up
to the last blank that does not part figures. Where even that does not come,
``LONGEST`` characters at most are held: all but the last ``CONTACT`` then go out,
cut where no contact stands. A contact of up to ``CONTACT`` characters is never cut in
two; a longer one may leave its beginning unmasked. Of what went out, ``BEFORE``
characters are remembered, because words announce phone numbers.

Each place is looked at a bounded number of times, so the work is linear in the
stream, and a stream's state is at most ``LONGEST + BEFORE`` characters and a piece.
"""

from __future__ import annotations

import contextlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quillmesh.operators.guardrails import BEFORE, contacts, masked

HOLD = 600
LONGEST = 4096
CONTACT = 512
_FIGURE_SIGNS = frozenset("0123456789+().-")
_END = re.compile(r"\n|[.!?](?=\s+\S)")

#: What is held of a stream: text, and how many of its first characters went out already.
Held = tuple[str, int]
NOTHING: Held = ("", 0)


def _settled(text: str, seen: int) -> int:
    """How many characters end with a line, or with a sentence whose next one has
    begun. What stands before ``seen`` was looked at before, but for white space
    that may have waited for the next sentence."""
    at = seen
    while at > 0 and text[at - 1].isspace():
        at -= 1
    return max((m.end() for m in _END.finditer(text, max(at - 1, 0))), default=0)


def _between_words(text: str, seen: int) -> int:
    """The last blank with no figures on both sides, in front of which text may go out."""
    for at in range(len(text) - 2, max(seen - 2, 0), -1):
        if text[at].isspace() and not (text[at - 1] in _FIGURE_SIGNS and text[at + 1] in _FIGURE_SIGNS) and text[at + 1] not in _FIGURE_SIGNS:
            return at + 1
    return 0


def _anywhere(text: str, done: int) -> int:
    """A place at least ``CONTACT`` characters before the end that no contact crosses."""
    upto = len(text) - CONTACT
    upto = next((s for s, e in contacts(text) if done < s < upto < e), upto)
    while upto > done + 1 and text[upto - 1] in _FIGURE_SIGNS:  # a number ends where the next character says so
        upto -= 1
    return upto


def release(held: Held, piece: str) -> tuple[str, Held]:
    """(what may go out, what stays)."""
    was, done = held
    text = was + piece
    upto = _settled(text, len(was))
    if upto <= done and len(text) - done > HOLD:
        upto = _between_words(text, len(was) if len(was) - done > HOLD else done + 1)
    if upto <= done and len(text) - done > LONGEST:
        upto = _anywhere(text, done)
    if upto <= done:
        return "", (text, done)
    keep = max(0, upto - BEFORE)
    return masked(text[:upto], done), (text[keep:], upto - keep)


def rest(held: Held) -> str:
    """All that is still held, when nothing more comes."""
    return masked(*held)


class Redactor(StatefulProcessor):
    """Held-back text per stream; a piece with ``last`` set releases all."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "text string, done int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        got = self.held.get() if self.held.exists() else None
        held, out, ended = ((got[0], got[1]) if got else NOTHING), [], False
        for pdf in rows:
            pdf = pdf.sort_values("seq")
            for piece, last in zip(pdf["piece"], pdf["last"], strict=True):
                ready, held = release(held, piece if isinstance(piece, str) else "")
                out.append(ready)
                ended = ended or bool(last)
        if ended:
            out.append(rest(held))
            self.held.clear()
        else:
            self.held.update(held)
        yield pd.DataFrame({"stream_id": [key[0]], "text": ["".join(out)]})

    def close(self) -> None:
        pass


PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Keyed state variables need the RocksDB provider while a query starts and runs."""
    was = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, was)


def redact_stream(pieces: DataFrame) -> DataFrame:
    """(stream_id, text) from (stream_id, seq, piece, last) pieces."""
    return pieces.groupBy("stream_id").transformWithStateInPandas(Redactor(), outputStructType="stream_id string, text string", outputMode="append", timeMode="none")
