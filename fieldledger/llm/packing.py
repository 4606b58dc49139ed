"""Best-fit packing of token sequences by matching of large pieces.

Texts become token ids with an end mark; only what is longer than a sequence is cut. All that packing needs of the
pieces is how many there are of each length, at most ``capacity`` numbers whatever the size of the table. On these
counts the plan is made:

* pieces above one third of the capacity meet at most twice in a sequence: from the longest down, each is matched
  with the longest other one that still fits beside it;
* smaller pieces, from the longest down, go into the smallest gap that holds them, then into new sequences.

Equal sequences are one ``Run`` of the plan: what it holds and how often it occurs. A length class changes whole
runs and splits one at most, so the plan's size depends on the capacity alone.

Pieces then get their places where they are. Every task numbers its pieces of each length while it writes them; the
tasks' counts, added up, make these numbers ordinals of the whole table, and the ordinal of a piece among those of its
length names its run, sequence and offset. No piece meets another, so no length can be too frequent.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from fieldledger.llm.merges import FOLDER
from fieldledger.llm.registry import doc_query, table
from fieldledger.llm.rows import map_rows, shared_table, ship_package, text_column
from fieldledger.llm.wordbatch import batch_encoder

FILE = "word_bpe_49k.json"
CAPACITY, END = 2048, 0


@dataclass
class Run:
    """``count`` sequences with the same lengths: ``parts`` are (length, how many), in order; ``gap`` is left."""

    count: int
    gap: int
    parts: list[tuple[int, int]] = field(default_factory=list)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Run]:
    """Sequences for so many pieces of each length (1 to ``capacity``)."""
    left = {n: c for n, c in counts.items() if c > 0}
    if left and not 1 <= min(left) <= max(left) <= capacity:
        raise ValueError("a piece is empty or longer than a sequence")
    runs = matched(left, capacity)
    by_gap: dict[int, list[Run]] = {}
    for r in runs:
        by_gap.setdefault(r.gap, []).append(r)
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        fill(by_gap, n, left[n], capacity)
    return [r for g in sorted(by_gap) for r in by_gap[g]]


def matched(left: dict[int, int], capacity: int) -> list[Run]:
    """Large pieces, above a third of the capacity, alone or in pairs."""
    large = {n: c for n, c in left.items() if 3 * n > capacity}
    lengths = sorted(large)
    runs = []
    for n in reversed(lengths):
        while large[n]:
            other = next((m for m in reversed(lengths) if m <= min(n, capacity - n) and large[m] > (m == n)), None)
            if other is None:
                runs.append(Run(large[n], capacity - n, [(n, 1)]))
                large[n] = 0
            elif other == n:
                runs.append(Run(large[n] // 2, capacity - 2 * n, [(n, 2)]))
                large[n] %= 2
            else:
                c = min(large[n], large[other])
                runs.append(Run(c, capacity - n - other, [(n, 1), (other, 1)]))
                large[n] -= c
                large[other] -= c
    return runs


def fill(by_gap: dict[int, list[Run]], n: int, count: int, capacity: int) -> None:
    """Best fit of ``count`` pieces of length ``n``: a sequence of the smallest gap takes them until no more fit."""
    moved: list[Run] = []
    for gap in sorted(g for g in by_gap if g >= n):
        fits = gap // n
        stay = []
        for r in by_gap[gap]:
            full = min(r.count, count // fits)
            if full:
                moved.append(Run(full, gap - fits * n, [*r.parts, (n, fits)]))
                count -= full * fits
            rest = r.count - full
            if rest and count:  # fewer than one sequence takes
                moved.append(Run(1, gap - count * n, [*r.parts, (n, count)]))
                rest, count = rest - 1, 0
            if rest:
                stay.append(Run(rest, gap, r.parts))
        by_gap[gap] = stay
        if not count:
            break
    fits = capacity // n
    if count // fits:
        moved.append(Run(count // fits, capacity - fits * n, [(n, fits)]))
    if count % fits:
        moved.append(Run(1, capacity - count % fits * n, [(n, count % fits)]))
    for r in moved:
        by_gap.setdefault(r.gap, []).append(r)


class Places:
    """Where the piece with a given ordinal among those of its length goes: arrays sorted by (length, first ordinal)."""

    def __init__(self, runs: Iterable[Run], ordinals: int):
        self.ordinals = ordinals
        used: dict[int, int] = {}
        rows, sequence = [], 0
        for r in runs:
            offset = 0
            for n, c in r.parts:
                rows.append((n * ordinals + used.get(n, 0), c, sequence, offset))
                used[n] = used.get(n, 0) + r.count * c
                offset += n * c
            sequence += r.count
        self.sequences = sequence
        a = np.array(sorted(rows), np.int64).reshape(-1, 4)
        self.first, self.per, self.sequence, self.offset = a[:, 0], a[:, 1], a[:, 2], a[:, 3]

    def of(self, length: np.ndarray, ordinal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = length * self.ordinals + ordinal
        at = np.searchsorted(self.first, key, "right") - 1
        slot = key - self.first[at]
        return self.sequence[at] + slot // self.per[at], self.offset[at] + slot % self.per[at] * length


def cut(blocks: Iterable[bytes], capacity: int = CAPACITY, end: int = END) -> Iterator[bytes]:
    """Pieces of a stream of ids, the end mark appended; each but the last holds ``capacity`` ids."""
    size, held = 4 * capacity, bytearray()
    for block in blocks:
        held += block
        full = len(held) // size * size
        yield from (bytes(held[a : a + size]) for a in range(0, full, size))
        del held[:full]
    held += end.to_bytes(4, "little")
    yield bytes(held)


def token_pieces(docs: DataFrame, keep: list[Column], ddl: str, text: str = "text", with_ids: bool = False, capacity: int = CAPACITY, end: int = END, name: str = FILE, folder: str = FOLDER) -> DataFrame:
    """The pieces of every text: the ``keep`` columns (typed by ``ddl``), ``piece, start, length, ids_crc32``.

    ``task`` and ``number`` name a piece among those of its length: pieces of one task and length are numbered
    from 0. ``with_ids`` adds ``token_ids``. A null or empty text is one piece that holds the end mark.
    """

    def make():
        encoder = batch_encoder(name, folder)
        numbers: dict[int, int] = {}

        def run(texts, tasks, *kept):
            rows = list(zip(*kept, strict=True))
            for i, blocks in by_text(encoder.encode(texts), len(texts)):
                start = 0
                for k, ids in enumerate(cut(blocks, capacity, end)):
                    n = len(ids) // 4
                    number = numbers[n] = numbers.get(n, -1) + 1
                    out = (*rows[i], k, start, n, zlib.crc32(ids), tasks[i], number)
                    yield (*out, np.frombuffer(ids, "<u4").tolist()) if with_ids else out
                    start += n

        return run

    ddl += ", piece int, start bigint, length bigint, ids_crc32 bigint, task int, number bigint" + ", token_ids array<int>" * with_ids
    return map_rows(docs, [text_column(text), F.spark_partition_id(), *keep], ddl, make)


def by_text(blocks: Iterator[tuple[int, bytes]], texts: int) -> Iterator[tuple[int, Iterator[bytes]]]:
    """The blocks of every text in turn, also of those without any; each must be read before the next is asked for."""
    ahead = next(blocks, None)

    def of(i: int) -> Iterator[bytes]:
        nonlocal ahead
        while ahead is not None and ahead[0] == i:
            yield ahead[1]
            ahead = next(blocks, None)

    for i in range(texts):
        yield i, of(i)


def packed(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The rows of ``token_pieces`` with ``sequence_id`` and ``offset``; ``task`` and ``number`` leave.

    ``pieces`` must be a written table: the numbers of a repeated task would be others. Sequences are numbered from 0
    without gaps, and filled from offset 0 without gaps. An empty table gives an empty one.
    """
    spark = pieces.sparkSession
    ship_package(spark)
    per_task = shared_table(pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")))
    counts = {r.length: r.n for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    runs = plan(counts, capacity)
    places = spark.sparkContext.broadcast(Places(runs, max(counts.values(), default=0) + 1))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = per_task.select("task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    kept = [c for c in pieces.columns if c not in ("task", "number")]
    numbered = pieces.join(before, ["task", "length"]).select(*kept, (F.col("before") + F.col("number")).alias("ordinal"))
    schema = pieces.select(*kept).schema.add("sequence_id", LongType()).add("offset", LongType())

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, ordinal = (batch.column(c).to_numpy() for c in ("length", "ordinal"))
            sequence, offset = places.value.of(length, ordinal)
            columns = [batch.column(c) for c in kept] + [pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return numbered.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False, capacity: int = CAPACITY, end: int = END, name: str = FILE, folder: str = FOLDER) -> DataFrame:
    """Every text in pieces, each with its place: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    Null and empty texts are one piece, the end mark. Rows are packed one by one: repeated rows are so many
    documents, and rows without an id keep their null id. An empty table gives no rows.
    """
    pieces = token_pieces(docs, [F.col(doc_id).cast("long")], "doc_id bigint", text, with_ids, capacity, end, name, folder)
    return packed(shared_table(pieces), capacity)


@doc_query("op12_best_fit_packing")
def op12(spark, directory):
    return pack_documents(table(spark, directory, "documents"))
