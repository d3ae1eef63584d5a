"""Sum-of-squares online packing: documents go one by one into windows, of which only the fill counts.

A window that holds h tokens is at level h. For each document the packer looks at the counts of partially
filled windows by level and takes the move (into a window of some level, or into a new one) after which the
sum of the squared counts is smallest: levels that many windows share are left, so that the windows stay
spread over levels that later documents complete. The counts are one array of ``capacity`` numbers.

Documents may be cut. Whole windows are cut off a long document first; the rest is placed as said. What a
task still holds at its end (and whatever exceeds ``MOST_OPEN`` windows before) is closed by cutting: the
emptiest windows give their tokens to the fullest, and the last one is divided into powers of two, which
need no padding.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimcheck.llm.shared import free_name, texts_of
from claimcheck.llm.tokens import encoded

#: Partially filled windows that a task holds; beyond them half are closed by cutting.
MOST_OPEN = 4096
#: Sequence ids of one task: the partition's number is above these bits.
LOCAL_BITS = 33

#: A part of a document: (document, first token, tokens).
Part = tuple[int, int, int]


class Windows:
    """The partially filled windows of one task, and the finished ones until they are taken."""

    def __init__(self, capacity: int, most_open: int = MOST_OPEN):
        if capacity < 1:
            raise ValueError("a window holds one token at least")
        self.capacity, self.most_open = capacity, max(1, most_open)
        self.counts = np.zeros(capacity + 1, dtype=np.int64)
        self.levels: dict[int, list[list[Part]]] = {}
        self.n_open = 0
        self.done: list[list[Part]] = []

    def _open(self, parts: list[Part], fill: int) -> None:
        if fill == self.capacity:
            self.done.append(parts)
        else:
            self.levels.setdefault(fill, []).append(parts)
            self.counts[fill] += 1
            self.n_open += 1

    def _take(self, level: int) -> list[Part]:
        self.counts[level] -= 1
        self.n_open -= 1
        return self.levels[level].pop()

    def add(self, document: int, length: int) -> None:
        """Place a document of ``length`` tokens."""
        whole = length - length % self.capacity
        self.done += [[(document, at, self.capacity)] for at in range(0, whole, self.capacity)]
        if length > whole:
            level, part = self.best(length - whole), (document, whole, length - whole)
            self._open((self._take(level) if level else []) + [part], level + part[2])
        if self.n_open > self.most_open:
            self.close(self.most_open // 2)

    def best(self, length: int) -> int:
        """The level (0: a new window) after which the squared counts have the smallest sum; the fullest among equals."""
        counts, most = self.counts, self.capacity - length
        # A window that moves from h to h + length changes the sum by 2 * (count[h + length] - count[h]) + 2;
        # one that is finished, or new, lacks one side.
        change = 2 * (counts[length:] - counts[: most + 1]) + 2
        change[0] -= 1
        change[most] -= 1
        change[1:][counts[1 : most + 1] == 0] = np.iinfo(np.int64).max
        return most - int(np.argmin(change[::-1]))

    def close(self, left: int = 0) -> None:
        """Finish windows, the emptiest first, until ``left`` are open: those at a power of two as they are, the others by cutting."""
        going: deque[tuple[int, list[Part]]] = deque()
        for level in sorted(self.levels):
            while self.n_open > left and self.counts[level]:
                parts = self._take(level)
                if level & (level - 1):
                    going.append((level, parts))
                else:
                    self.done.append(parts)
        loose: list[Part] = []
        while going:
            level, target = going.pop()
            room = self.capacity - level
            while room and (loose or going):
                loose = loose or going.popleft()[1]
                document, start, length = loose.pop()
                given = min(room, length)
                target.append((document, start + length - given, given))
                if given < length:
                    loose.append((document, start, length - given))
                room -= given
            if room:
                loose = target
            else:
                self.done.append(target)
        self._powers(loose)

    def _powers(self, parts: list[Part]) -> None:
        """Windows of powers of two, the largest first, of all tokens in ``parts``."""
        total, parts = sum(p[2] for p in parts), parts[::-1]
        while total:
            room = size = 1 << (min(total, self.capacity).bit_length() - 1)
            window: list[Part] = []
            while room:
                document, start, length = parts.pop()
                given = min(room, length)
                window.append((document, start, given))
                if given < length:
                    parts.append((document, start + given, length - given))
                room -= given
            self.done.append(window)
            total -= size


def pack_online(docs: DataFrame, path: str, end_id: int, capacity: int = 2048, text: str = "text", with_ids: bool = False) -> DataFrame:
    """The pieces of all documents with the sequences of at most ``capacity`` tokens that hold them.

    A document's ids are those of its text (null: empty) by the vocabulary file and ``end_id``, so that no
    document is empty. Returned: ``docs`` without ``text``, with start (the document's ids before the piece),
    length, ids_crc32, doc_tokens, sequence_id, offset, and the ids (binary, little-endian unsigned 32-bit) if
    asked for; columns of these names give way. Repeated rows are documents of their own; texts of any length
    are taken whole; an empty table gives an empty table.

    Each task packs the rows that it reads and shares no sequence with others: there is no shuffle, no hot
    key, and a task that is repeated gives its rows again. It holds the ids of ``MOST_OPEN`` windows and of
    one document. Every sequence has ``capacity`` tokens or a power of two, at most log2(capacity) a task fewer.
    """
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids]
    kept = [c for c in docs.columns if c.lower() not in {*names, text.lower()}]
    key = free_name(docs, "_document")
    end = end_id.to_bytes(4, "little")
    schema = T.StructType([*docs.select(*[docs[c] for c in kept]).schema.fields, *[T.StructField(n, T.BinaryType() if n == "ids" else T.LongType()) for n in names]])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, first = Windows(capacity), TaskContext.get().partitionId() << LOCAL_BITS
        held: dict[int, list] = {}  # document: its row, its ids, tokens that aren't out yet
        n_documents = n_sequences = 0
        out: list[tuple[pa.RecordBatch, int, tuple]] = []
        size = 0

        def finished() -> None:
            nonlocal n_sequences, size
            for parts in windows.done:
                offset = 0
                for document, start, length in parts:
                    rest, row, ids, _ = entry = held[document]
                    own = ids[4 * start : 4 * (start + length)]
                    out.append((rest, row, (start, length, zlib.crc32(own), len(ids) // 4, first + n_sequences, offset, *[own] * with_ids)))
                    offset, size = offset + length, size + 100 + 4 * length * with_ids
                    entry[3] -= length
                    if not entry[3]:
                        del held[document]
                n_sequences += 1
            windows.done.clear()

        def batch() -> pa.RecordBatch:
            nonlocal size
            rows: dict[int, tuple[pa.RecordBatch, list[int], list[int]]] = {}
            for i, (of, row, _) in enumerate(out):
                _, taken, places = rows.setdefault(id(of), (of, [], []))
                taken.append(row)
                places.append(i)
            old = pa.Table.from_batches([of.take(pa.array(taken)) for of, taken, _ in rows.values()]).combine_chunks().to_batches()[0]
            values = zip(*(out[i][2] for _, _, places in rows.values() for i in places))
            new = [pa.array(v, pa.binary() if n == "ids" else pa.int64()) for n, v in zip(names, values)]
            out.clear()
            size = 0
            return pa.RecordBatch.from_arrays([*old.columns[:-1], *new], names=[*kept, *names])

        for whole in batches:
            rest, row, earlier = whole.select([*kept, key]), 0, n_documents
            for run in texts_of(whole.column(whole.schema.get_field_index(text))):
                for ids in encoded([x or "" for x in run], path):
                    ids += end
                    held[n_documents] = [rest, row, ids, len(ids) // 4]
                    windows.add(n_documents, len(ids) // 4)
                    row, n_documents = row + 1, n_documents + 1
                    finished()
                    if size > 1 << 22:
                        yield batch()
            # Of this batch only the rows of documents in open windows stay in memory.
            staying = [x for n, x in held.items() if n >= earlier]
            few = rest.take(pa.array([x[1] for x in staying], pa.int64()))
            for i, x in enumerate(staying):
                x[:2] = few, i
        windows.close()
        finished()
        if out:
            yield batch()

    # The column of our own: without any, a batch would have no rows to take.
    rows = docs.select(*[docs[c] for c in kept], docs[text].alias(text), F.lit(0).alias(key))
    return rows.mapInArrow(pack, schema)
