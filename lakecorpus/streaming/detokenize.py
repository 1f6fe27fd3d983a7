"""Text from a stream of token ids, as far as it can no longer change.

The bytes of a character may come in several tokens, and these in several batches, in any order. For each key the state holds the number that comes next, the bytes of a
character that isn't whole yet, and rows that came before their turn. A timer tells what is left where a key falls silent.
"""

from __future__ import annotations

import codecs
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

#: RocksDB keeps the state of such processors.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_BYTES = tuple(bytes([b]) for b in range(256))


def pieces(rows: list[tuple[int, list[int] | None]], begin: int, held: bytes, table: tuple[bytes, ...]) -> tuple[list[tuple[int, str]], int, bytes, bool]:
    """What rows (seq, ids) in their order add to a text: (seq, text) for each, then the next seq, the bytes that are held back, and whether the text ended (ids null)."""
    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    decoder.setstate((held, 0))
    out = []
    for seq, ids in rows:
        begin = seq + 1
        text = decoder.decode(b"".join(table[i] if 0 <= i < len(table) else b"" for i in ids) if ids is not None else b"", ids is None)
        out.append((seq, text))
        if ids is None:
            return out, begin, b"", True
    return out, begin, decoder.getstate()[0], False


class Detokenizer(StatefulProcessor):
    """``table``: the bytes of each id; ids without any add nothing. ``idle_ms``: silence after which the rest of a key is told."""

    def __init__(self, key: str, table: tuple[bytes, ...], idle_ms: int | None):
        self.key, self.table, self.idle_ms = key, table, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "next long, held binary, timer long")
        self.early = handle.getMapState("early", "seq long", "ids array<int>")

    def _told(self, key, out: list[tuple[int, str]]) -> Iterator[pd.DataFrame]:
        out = [(seq, text) for seq, text in out if text]
        if out:
            yield pd.DataFrame({self.key: [key[0]] * len(out), "seq": [s for s, _ in out], "text": [t for _, t in out]})

    def _place(self) -> tuple[int, bytes, int | None]:
        now = self.place.get() if self.place.exists() else None
        return (now[0], bytes(now[1]), now[2]) if now else (0, b"", None)

    def _forget(self) -> None:
        self.place.clear()
        self.early.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        begin, held, timer = self._place()
        waiting: dict[int, list[int] | None] = {}
        for frame in rows:
            for seq, ids in zip(frame["seq"], frame["ids"], strict=True):
                if seq >= begin:  # what was told before comes again after a failure
                    waiting[int(seq)] = None if ids is None else [int(i) for i in ids]
        ready = []
        at = begin
        while True:
            if at in waiting:
                ready.append((at, waiting.pop(at)))
            elif self.early.exists() and self.early.containsKey((at,)):
                ids = self.early.getValue((at,))[0]
                self.early.removeKey((at,))
                ready.append((at, None if ids is None else list(ids)))
            else:
                break
            at += 1
        for seq, ids in waiting.items():
            self.early.updateValue((seq,), (ids,))
        out, begin, held, ended = pieces(ready, begin, held, self.table)
        if timer is not None:
            self.handle.deleteTimer(timer)
        if ended:
            self._forget()
        else:
            timer = None
            if self.idle_ms is not None:
                timer = timerValues.getCurrentProcessingTimeInMs() + self.idle_ms
                self.handle.registerTimer(timer)
            self.place.update((begin, held, timer))
        yield from self._told(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        """Rows that came early are told in order though some before them are missing; then what is held back."""
        begin, held, _ = self._place()
        rest = sorted((k[0], None if v[0] is None else list(v[0])) for k, v in self.early.iterator()) if self.early.exists() else []
        out, begin, held, ended = pieces(rest, begin, held, self.table)
        if not ended:
            out += pieces([(begin, None)], begin, held, self.table)[0]
        self._forget()
        yield from self._told(key, out)

    def close(self) -> None:
        pass


def detokenize(rows: DataFrame, key: str = "doc_id", table: tuple[bytes, ...] = _BYTES, idle_ms: int | None = None) -> DataFrame:
    """(key, seq, text) of a stream of rows (key, seq, ids): what each row adds for good. In the order of seq the texts of a key join to the decoding of all its ids.

    seq counts from 0 without gaps; a row whose ids are null ends its key, which may then begin anew. Rows may come in any batches and any order; a row that comes twice is told once while its key lasts.
    Bytes that are no UTF-8 become U+FFFD. With ``idle_ms`` a key that is silent so long is ended by a timer. The session's state store must be ``PROVIDER``.
    """
    schema = StructType().add(rows.schema[key]).add("seq", "long").add("text", "string")
    grouped = rows.select(key, "seq", "ids").groupBy(key)
    return grouped.transformWithStateInPandas(Detokenizer(key, table, idle_ms), schema, "Append", "ProcessingTime" if idle_ms is not None else "None")
