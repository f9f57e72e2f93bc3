"""Cost-balanced packing of documents into training sequences of a fixed number of tokens.

The cost of a run of n tokens of one document under masked attention is estimated as
``linear * n + quadratic * n * n``. Full sequences are cut off long documents; what is
left goes, longest first, to the cheapest open sequence that has room for it. If none has,
the piece is cut and fills the cheapest open sequence, and its rest queues again.

A task packs what it has read in groups of ``GROUP_TOKENS`` tokens, with as many sequences as the
tokens need, so that only a group's last sequence is padded. No text is shuffled and no
key is grouped on: a hot source or a hot text costs nothing extra. A retried task reads
the same rows in the same order and so gives the same sequences.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens

#: Tokens that a task holds and packs together.
GROUP_TOKENS = 2 << 20
#: Costs of a token and of a pair of tokens: a layer's matrices against its attention, at width 2048.
LINEAR, QUADRATIC = 1.0, 1.0 / 12288

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cost double"


class OpenSequences:
    """Sequences by the room they have left; finds the cheapest with room for n tokens.

    A tree over the possible rooms holds, for each range of rooms, its cheapest sequence.
    """

    def __init__(self, n: int, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.at: list[list[tuple[float, int]]] = [[] for _ in range(self.leaves)]
        self.best: list[tuple[float, int] | None] = [None] * (2 * self.leaves)
        for s in range(n):
            self.at[capacity].append((0.0, s))
        self._renew(capacity)

    def _renew(self, room: int) -> None:
        node, heap, best = room + self.leaves, self.at[room], self.best
        best[node] = heap[0] if heap else None
        while node > 1:
            node >>= 1
            a, b = best[2 * node], best[2 * node + 1]
            best[node] = a if b is None or (a is not None and a <= b) else b

    def put(self, room: int, cost: float, sequence: int) -> None:
        if room:
            heapq.heappush(self.at[room], (cost, sequence))
            self._renew(room)

    def take(self, least: int) -> tuple[int, float, int] | None:
        """(room, cost, sequence) of the cheapest one with room for ``least``, taken out."""
        low, high, found = least + self.leaves, 2 * self.leaves, None
        while low < high:
            for node in ((low,) if low & 1 else ()) + ((high - 1,) if high & 1 else ()):
                best = self.best[node]
                if best is not None and (found is None or best < found[0]):
                    found = (best, node)
            low, high = (low + 1) >> 1, high >> 1
        if found is None:
            return None
        best, node = found
        while node < self.leaves:
            node = 2 * node if self.best[2 * node] == best else 2 * node + 1
        room = node - self.leaves
        heapq.heappop(self.at[room])
        self._renew(room)
        return room, best[0], best[1]


def pack(lengths: list[int], capacity: int = 2048, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) for documents of these lengths.

    Ties go to the earlier document and to the sequence opened first.
    """
    pieces, tails, sequence = [], [], 0
    for d, n in enumerate(lengths):
        for start in range(0, n - capacity + 1, capacity):
            pieces.append((d, start, capacity, sequence, 0))
            sequence += 1
        if n % capacity:
            tails.append((-(n % capacity), d, n - n % capacity))
    heapq.heapify(tails)
    count = -(sum(-t[0] for t in tails) // -capacity)
    sequences = OpenSequences(count, capacity)
    while tails:
        negative, d, start = heapq.heappop(tails)
        n = -negative
        room, cost, k = sequences.take(n) or sequences.take(1)
        m = min(n, room)
        pieces.append((d, start, m, sequence + k, capacity - room))
        sequences.put(room - m, cost + linear * m + quadratic * m * m, k)
        if m < n:
            heapq.heappush(tails, (m - n, d, start + m))
    return pieces


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", linear: float = LINEAR, quadratic: float = QUADRATIC) -> DataFrame:
    """One row for each piece of each document; see SCHEMA. ``cost`` is that of the piece.

    Null or empty text: one piece with the end id alone. A null id stays null. Repeated
    rows are packed as often as they come. Texts longer than a sequence are cut. Other
    columns are ignored. An empty table gives no rows.
    """
    common.small_batches(docs.sparkSession)

    def rows(group: list[tuple[object, np.ndarray]], first: int) -> tuple[pa.RecordBatch, int]:
        pieces = pack([len(ids) for _, ids in group], capacity, linear, quadratic)
        used = 1 + max((p[3] for p in pieces), default=-1)
        d, start, length, sequence, offset = (np.array(x, np.int64) for x in zip(*pieces))
        crc = [zlib.crc32(group[i][1][s : s + n].tobytes()) for i, s, n, _, _ in pieces]
        columns = [
            pa.array([group[i][0] for i in d], pa.int64()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()),
            pa.array([len(group[i][1]) for i in d], pa.int64()), pa.array(sequence + first), pa.array(offset), pa.array(linear * length + quadratic * length * length),
        ]
        return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in SCHEMA.split(", ")]), used

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(tokenizer).encode
        sequence, held, group = TaskContext.get().partitionId() << 33, 0, []
        for batch in batches:
            for part, raw, at in common.slices(batch, limit=tokens.ENCODE_BYTES):
                ids, first = encode(raw, at, end_id)
                ids = ids.astype("<u4", copy=False)
                for k, key in enumerate(part.column(0).to_pylist()):
                    group.append((key, ids[first[k] : first[k + 1]]))
                held += len(ids)
                if held >= GROUP_TOKENS:
                    out, used = rows(group, sequence)
                    yield out
                    sequence, held, group = sequence + used, 0, []
        if group:
            yield rows(group, sequence)[0]

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), common.text_of(text_col).alias("text")).mapInArrow(common.lean(task), SCHEMA)
