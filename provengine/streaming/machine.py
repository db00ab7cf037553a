"""The state machine of documents, as state in the state store."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.audit import ALLOWED

MOVES = "document_id long, id long, before string, after string, accepted boolean"


class ApplyMoves(StatefulProcessor):
    """One document: its status. The moves of a batch are applied by id; of more than `held` of them, sorted blocks wait in the store."""

    def __init__(self, start: str, held: int):
        self.start, self.held = start, held

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.status = handle.getValueState("status", "status string")
        self.blocks = handle.getMapState("blocks", "run int, block int", "ids array<long>, targets array<string>")

    def handleInputRows(self, key, rows: Iterator[Row], timer_values) -> Iterator[Row]:
        status = self.status.get()[0] if self.status.exists() else self.start
        for number, target in self._in_order(rows):
            good = target == status or target in ALLOWED.get(status, ())
            before, status = status, target if good else status
            yield Row(document_id=key[0], id=number, before=before, after=status, accepted=good)
        self.status.update((status,))

    def _in_order(self, rows: Iterator[Row]) -> Iterator[tuple[int, str]]:
        held, runs = [], []
        for row in rows:
            held.append((row["id"], row["target"]))
            if len(held) >= self.held:
                runs.append(self._put_by(len(runs), sorted(held)))
                held = []
        yield from heapq.merge(sorted(held), *[self._taken_back(k, n) for k, n in enumerate(runs)])

    def _put_by(self, run: int, moves: list) -> int:
        size = max(1, self.held // 16)
        for block, at in enumerate(range(0, len(moves), size)):
            ids, targets = zip(*moves[at : at + size])
            self.blocks.updateValue((run, block), (list(ids), list(targets)))
        return -(-len(moves) // size)

    def _taken_back(self, run: int, blocks: int) -> Iterator[tuple[int, str]]:
        for block in range(blocks):
            ids, targets = self.blocks.getValue((run, block))
            self.blocks.removeKey((run, block))
            yield from zip(ids, targets)

    def close(self) -> None:
        pass


def stream_transitions(stream: DataFrame, start: str = "DISCOVERED", held: int = 50_000) -> DataFrame:
    """Per document, moves (document_id, id, target) in order of id within a batch against its state: accepted, or refused
    with the state unchanged. Needs `rocksdb_state`."""
    return stream.groupBy("document_id").transformWithState(ApplyMoves(start, held), MOVES, "append", "none")
