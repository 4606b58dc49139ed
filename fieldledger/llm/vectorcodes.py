"""Vector codes: one codebook per part of the vectors, refined by rounds with Drake and Hamerly's adaptive bounds.

Vectors become integers and are cut into parts. Between rounds each part keeps what is known of its distances: the
``b`` closest entries of its codebook in ascending order, a lower bound for each but the first, an upper bound for the
first, which is its code, and one lower bound for all entries that are not listed. When entries move, bounds move by as
much. A code stays, without any distance, while its upper bound is below every lower bound. Otherwise, in turn: the
distance to the first entry alone is taken, then those to all listed entries, then those to all entries. Distances
are compared as integers, ties by index; bounds are rounded outwards. ``b`` is adapted: it shrinks to the
deepest place from which a code came in the round before.

A round is one narrow job: it reads the state of the round before, writes its own to the shared folder, and with it
each task writes its sums per entry. Only these are shuffled; what the driver sees are the codebooks, whose size
depends on the number of entries and components alone. A lost task is repeated from the last written state, and a
state is removed once its successor is there.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from fieldledger.llm.registry import doc_query, table
from fieldledger.llm.rows import schema_of, shared_table, ship_package
from fieldledger.operators.joins import summary_join
from fieldledger.operators.lineage import shared_folder

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Entries listed at first, and never fewer than; vectors treated at a time.
LISTED, LEAST, ROWS = 16, 4, 2048
#: Components beyond this, after scaling, could overflow a squared distance of 64 bits.
LARGEST = 1 << 28
#: Bounds are stored in 32 bits; this share more or less keeps them on the safe side.
SLACK = 1e-6
#: ``part`` of the rows that count how parts were decided.
TALLY = -1


def squared(q: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to all entries."""
    largest = max(int(np.abs(q).max(initial=0)), int(np.abs(book).max(initial=0)))
    if 4 * q.shape[1] * largest**2 < 1 << 53:  # every sum is an exact double
        a, b = q.astype(np.float64), book.astype(np.float64)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)).astype(np.int64)
    return (q * q).sum(1)[:, None] + (book * book).sum(1)[None, :] - 2 * (q @ book.T)


class Bounds:
    """What is known of the distances of one part of several vectors.

    ``near`` lists entries; ``low[:, 1:]`` are lower bounds of their distances, ``low[:, 0]`` is the upper bound of the
    first, ``outer`` the lower bound of all others.
    """

    def __init__(self, near: np.ndarray, low: np.ndarray, outer: np.ndarray):
        self.near, self.low, self.outer = near, low, outer

    @classmethod
    def fresh(cls, q: np.ndarray, book: np.ndarray, b: int) -> Bounds:
        k = len(book)
        key = squared(q, book) * k + np.arange(k)
        b = min(b, k)
        key = np.partition(key, min(b, k - 1), axis=1)[:, : b + 1]
        key.sort(axis=1)
        distance = np.sqrt((key // k).astype(np.float64))
        outer = distance[:, b] * (1 - SLACK) if b < k else np.full(len(q), np.inf)
        out = cls((key[:, :b] % k).astype(np.uint8), distance[:, :b].copy(), outer)
        out.low[:, 1:] *= 1 - SLACK
        out.low[:, 0] *= 1 + SLACK
        return out

    def cut(self, b: int) -> None:
        """List ``b`` entries at most."""
        if b < self.near.shape[1]:
            self.outer = np.minimum(self.outer, self.low[:, b:].min(axis=1))
            self.near, self.low = self.near[:, :b], self.low[:, :b]

    def move(self, moved: np.ndarray) -> None:
        """The entries have moved by these distances."""
        by = moved[self.near]
        self.low[:, 0] += by[:, 0]
        self.low[:, 1:] -= by[:, 1:]
        self.outer = self.outer - moved.max(initial=0.0)

    def others(self) -> np.ndarray:
        return np.minimum(self.low[:, 1:].min(axis=1, initial=np.inf), self.outer)

    def update(self, q: np.ndarray, book: np.ndarray, tally: np.ndarray) -> None:
        """Make the codes right for the moved entries; ``tally`` counts the ways and the depths."""
        k, b = len(book), self.near.shape[1]
        open_ = np.flatnonzero(self.low[:, 0] >= self.others())
        tally[0] += len(q) - len(open_)
        first = ((q[open_] - book[self.near[open_, 0]]) ** 2).sum(1)
        self.low[open_, 0] = np.sqrt(first.astype(np.float64)) * (1 + SLACK)
        still = self.low[open_, 0] >= self.others()[open_]
        tally[1] += len(open_) - int(still.sum())
        open_ = open_[still]
        if not len(open_):
            return
        near = self.near[open_].astype(np.int64)
        key = ((q[open_][:, None, :] - book[near]) ** 2).sum(2) * k + near
        depth = key.argmin(axis=1)
        key.sort(axis=1)
        distance = np.sqrt((key // k).astype(np.float64))
        certain = distance[:, 0] * (1 + SLACK) < self.outer[open_]
        sure = open_[certain]
        self.near[sure] = key[certain] % k
        self.low[sure] = distance[certain] * (1 - SLACK)
        self.low[sure, 0] = distance[certain, 0] * (1 + SLACK)
        tally[2] += len(sure)
        np.add.at(tally, 4 + depth[certain], 1)
        rest = open_[~certain]
        if len(rest):
            new = Bounds.fresh(q[rest], book, b)
            self.near[rest], self.low[rest], self.outer[rest] = new.near, new.low, new.outer
            tally[3] += len(rest)


def moves(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """How far each entry of each part has moved, rounded up."""
    return np.sqrt(((new - old).astype(np.float64) ** 2).sum(2)) * (1 + SLACK)


def state_ddl(label: str) -> str:
    """One row per vector: its integers and, part after part, listed entries and bounds; or, with ``part``, a task's sums."""
    return f"vec_id bigint, label {label}, q binary, near binary, bounds binary, part int, entry int, total array<bigint>, n bigint"


def integers(column: pa.Array, dim: int, scale: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    q = np.floor(scale * x)
    if np.abs(q).max(initial=0) >= LARGEST:
        raise ArithmeticError(f"components of {LARGEST} or more after scaling: squared distances do not fit 64 bits")
    return q.astype(np.int64)


def narrow(q: np.ndarray) -> np.ndarray:
    return q.astype(np.int16 if np.abs(q).max(initial=0) < 1 << 15 else np.int32)


def binary(rows: np.ndarray) -> pa.Array:
    """Rows of a contiguous array as binary values."""
    raw = np.ascontiguousarray(rows)
    n, size = len(raw), raw.nbytes // max(1, len(raw))
    offsets = pa.py_buffer(np.arange(n + 1, dtype=np.int32) * np.int32(size))
    return pa.Array.from_buffers(pa.binary(), n, [None, offsets, pa.py_buffer(raw)])


def matrix(column: pa.Array, kind) -> np.ndarray:
    """Binary values of one size as rows."""
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, kind).reshape(len(column), -1)


class Round:
    """One round over the vectors of a task: codes made right, sums per entry gathered."""

    def __init__(self, books: np.ndarray, moved: np.ndarray | None, listed: int):
        self.books, self.moved, self.listed = books, moved, listed
        self.parts, self.entries, self.width = books.shape
        self.sums = np.zeros(books.shape, np.int64)
        self.count = np.zeros(books.shape[:2], np.int64)
        self.tally = np.zeros(4 + self.entries, np.int64)

    def bounds(self, q: np.ndarray, near: np.ndarray | None = None, stored: np.ndarray | None = None) -> list[Bounds]:
        out = []
        for p in range(self.parts):
            part = q[:, p * self.width : (p + 1) * self.width]
            if near is None:
                known = Bounds.fresh(part, self.books[p], self.listed)
                self.tally[3] += len(q)
            else:
                b = near.shape[1] // self.parts
                low = stored[:, p * (b + 1) : (p + 1) * (b + 1)].astype(np.float64)
                # what was rounded to 32 bits is brought to the safe side again
                low[:, 1:] *= 1 - SLACK
                low[:, 0] *= 1 + SLACK
                known = Bounds(near[:, p * b : (p + 1) * b].copy(), low[:, :b], low[:, b])
                known.cut(self.listed)
                known.move(self.moved[p])
                known.update(part, self.books[p], self.tally)
            code = known.near[:, 0]
            order = np.argsort(code, kind="stable")
            first = np.flatnonzero(np.r_[True, code[order][1:] != code[order][:-1]]) if len(code) else np.empty(0, np.int64)
            if len(first):
                self.sums[p, code[order][first]] += np.add.reduceat(part[order], first, axis=0)
                self.count[p] += np.bincount(code, minlength=self.entries)
            out.append(known)
        return out

    def rows(self) -> list[tuple]:
        out = [(p, j, self.sums[p, j].tolist(), int(self.count[p, j])) for p, j in np.argwhere(self.count).tolist()]
        return [*out, (TALLY, 0, self.tally.tolist(), 0)]


def unpack(batch: pa.RecordBatch, dim: int) -> Iterator[tuple]:
    """Equal rows of a state table: ids, labels, integers, lists, bounds; lists of one length at a time."""
    for at in range(0, batch.num_rows, ROWS):
        piece = batch.slice(at, ROWS)
        sizes = np.array([(len(q), len(b)) for q, b in zip(piece.column("q").to_pylist(), piece.column("near").to_pylist(), strict=True)])
        cuts = np.flatnonzero(np.any(sizes[1:] != sizes[:-1], axis=1)) + 1
        for a, b in zip(np.r_[0, cuts].tolist(), np.r_[cuts, piece.num_rows].tolist(), strict=True):
            part = piece.slice(a, b - a)
            q = matrix(part.column("q"), np.int16 if sizes[a, 0] == 2 * dim else np.int32).astype(np.int64)
            yield part, q, matrix(part.column("near"), np.uint8), matrix(part.column("bounds"), np.float32)


def state_round(ddl: str, shared, dim: int, scale: int, first: bool):
    """Task of a round: reads vectors (``first``) or states, yields states and, at the end, the task's sums."""
    schema = to_arrow_schema(schema_of(ddl))

    def batch_of(columns: dict[str, pa.Array], n: int) -> pa.RecordBatch:
        arrays = [columns.get(f.name, pa.nulls(n, f.type)) for f in schema]
        return pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, schema, strict=True)], schema=schema)

    def read(batches):
        for batch in batches:
            if first:
                for at in range(0, batch.num_rows, ROWS):
                    piece = batch.slice(at, ROWS)
                    yield piece, integers(piece.column("vec"), dim, scale), None, None
            else:
                yield from unpack(batch, dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = Round(*shared.value)
        for piece, q, near, stored in read(batches):
            known = work.bounds(q, near, stored)
            kept = {
                "vec_id": piece.column("vec_id"),
                "label": piece.column("label"),
                "q": binary(narrow(q)),
                "near": binary(np.concatenate([x.near for x in known], axis=1)),
                "bounds": binary(np.concatenate([np.c_[x.low, x.outer] for x in known], axis=1).astype(np.float32)),
            }
            yield batch_of(kept, piece.num_rows)
        part, entry, total, n = zip(*work.rows(), strict=True)
        yield batch_of({"part": pa.array(part), "entry": pa.array(entry), "total": pa.array(total, pa.list_(pa.int64())), "n": pa.array(n)}, len(n))

    return run


def code_round(ddl: str, shared, dim: int):
    """Task of the last assignment: codes and exact errors."""
    schema = to_arrow_schema(schema_of(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = Round(*shared.value)
        for batch in batches:
            for piece, q, near, stored in unpack(batch, dim):
                known = work.bounds(q, near, stored)
                codes = np.stack([x.near[:, 0] for x in known], axis=1)
                closest = np.concatenate([work.books[p, codes[:, p]] for p in range(work.parts)], axis=1)
                error = ((q - closest) ** 2).sum(1)
                text = [c.hex() for c in np.ascontiguousarray(codes).view(f"V{work.parts}").ravel().tolist()] if len(q) else []
                columns = [piece.column("vec_id"), piece.column("label"), pa.array(text, pa.string()), pa.array(error)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def refined(books: np.ndarray, sums: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The next codebooks and the tally, from the sums the tasks have written: one row per component of an entry."""
    long = sums.select("part", "entry", "n", F.posexplode("total").alias("at", "x"))
    rows = long.groupBy("part", "entry", "at").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).collect()
    new, tally = books.copy(), np.zeros(4 + books.shape[1], np.int64)
    for r in rows:
        if r.part == TALLY:
            tally[r.at] = r.x
        else:
            new[r.part, r.entry, r.at] = r.x // r.n
    return new, tally


def deepest(tally: np.ndarray, listed: int) -> int:
    """How many entries to list after a round: to the deepest place a code came from, and one more."""
    used = np.flatnonzero(tally[4:])
    return min(listed, max(LEAST, int(used[-1]) + 2 if len(used) else LEAST))


def remove(spark: SparkSession, path: str) -> None:
    """Remove a table that this module wrote."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def usable(vectors: DataFrame, vec_id: str, vector: str, label: str | None) -> DataFrame:
    """``vec_id, label, vec`` of the rows whose vector is there and finite in every component."""
    vec = F.col(vector)
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    named = F.lit(None).cast("string") if label is None else F.col(label)
    return vectors.filter(vec.isNotNull() & fine).select(
        F.col(vec_id).cast("long").alias("vec_id"), named.alias("label"), vec.cast("array<double>").alias("vec")
    )


def vector_codes(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str | None = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
    listed: int = LISTED,
) -> tuple[DataFrame, np.ndarray]:
    """``vec_id, label, code, error`` of every usable row, and the final codebooks (part, entry, component).

    Rows whose vector is null or holds a null, NaN or infinite component are left out. The codebooks start as the
    vectors of the ``entries`` (256 at most) smallest ids, repeated ids by ascending vector; rows without an id are coded but never
    start one. Vectors of another size than the first of these cannot be cut alike: their code and error are null.
    ``rounds`` is one at least. Components of 2**28 or more after scaling raise, as do sizes that ``parts`` does not divide.
    Without a usable row that has an id there are no codebooks: codes and errors are null.
    """
    if not 1 <= entries <= 256 or rounds < 1:
        raise ValueError("from 1 to 256 entries and one round at least")
    spark = vectors.sparkSession
    ship_package(spark)
    kept = usable(vectors, vec_id, vector, label)
    kind = kept.schema["label"].dataType.simpleString()
    ddl = f"vec_id bigint, label {kind}, code string, error bigint"
    seeds = [r.vec for r in kept.filter("vec_id is not null").orderBy("vec_id", "vec").limit(entries).collect()]
    dim = len(seeds[0]) if seeds else 0
    odd = kept.filter(F.size("vec") != dim) if seeds else kept
    uncoded = odd.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    if not dim:
        return uncoded, np.zeros((parts, 0, 0), np.int64)
    if dim % parts:
        raise ValueError(f"vectors of {dim} components cannot be cut into {parts} equal parts")
    start = np.array([s for s in seeds if len(s) == dim], np.float64)
    books = integers(pa.array(list(start)), dim, scale).reshape(len(start), parts, dim // parts).transpose(1, 0, 2)
    moved, state, path = None, kept.filter(F.size("vec") == dim), None
    for i in range(rounds):
        shared = spark.sparkContext.broadcast((books, moved, listed))
        made = state.mapInArrow(state_round(state_ddl(kind), shared, dim, scale, i == 0), state_ddl(kind))
        written = f"{shared_folder(spark)}/codes-{uuid.uuid4().hex}"
        made.write.parquet(written)
        if path:
            remove(spark, path)
        table_ = spark.read.schema(state_ddl(kind)).parquet(written)
        new, tally = refined(books, table_.filter("part is not null").select("part", "entry", "n", "total"))
        moved, books, path = moves(books, new), new, written
        listed = deepest(tally, listed) if i else listed
        state = table_.filter("part is null").select("vec_id", "label", "q", "near", "bounds")
    shared = spark.sparkContext.broadcast((books, moved, listed))
    coded = shared_table(state.mapInArrow(code_round(ddl, shared, dim), ddl))
    remove(spark, path)
    return coded.unionByName(uncoded), books


def with_label_error(coded: DataFrame) -> DataFrame:
    """Add ``label_error``: the errors of equal labels, added up; rows without a label are one group."""
    # a missing label becomes a key of its own, as joins do not match nulls
    keyed = coded.withColumn("no_label", F.col("label").isNull()).withColumn("key", F.coalesce(F.col("label").cast("string"), F.lit("")))
    sums = keyed.groupBy("key", "no_label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("rows"))
    return summary_join(keyed, sums, ["key", "no_label"], rows="rows").drop("key", "no_label", "rows")


def books_text(books: np.ndarray) -> str:
    return ",".join(map(str, books.ravel().tolist()))


def sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """All distances of every round, without bounds; sums stay far below 2**53 on unit-scale vectors."""
    out = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS i, vec_id, label,
  list_transform(embedding, lambda x: floor({scale}::DOUBLE * x::DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)""",
        f"""piece AS MATERIALIZED (SELECT i, p, list_slice(q, p * len(q) // {parts} + 1, (p + 1) * len(q) // {parts}) AS q
  FROM kept, range({parts}) AS r(p))""",
        f"book0 AS MATERIALIZED (SELECT p, i - 1 AS j, q FROM piece WHERE i <= {entries})",
    ]
    for r in range(rounds + 1):
        out.append(
            f"""near{r} AS MATERIALIZED (SELECT i, p, min_by(j, (d, j)) AS j, min(d) AS d FROM (
  SELECT x.i, x.p, b.j, list_inner_product(x.q, x.q) + list_inner_product(b.q, b.q) - 2 * list_inner_product(x.q, b.q) AS d
  FROM piece x JOIN book{r} b ON x.p = b.p) GROUP BY i, p)"""
        )
        if r < rounds:
            out.append(
                f"""mean{r} AS MATERIALIZED (SELECT p, j, list(m ORDER BY place) AS q FROM (
  SELECT p, j, place, floor(sum(x) / count(*)) AS m FROM (
    SELECT n.p, n.j, unnest(x.q) AS x, generate_subscripts(x.q, 1) AS place FROM near{r} n JOIN piece x ON n.i = x.i AND n.p = x.p)
  GROUP BY p, j, place) GROUP BY p, j),
book{r + 1} AS MATERIALIZED (SELECT b.p, b.j, coalesce(m.q, b.q) AS q FROM book{r} b LEFT JOIN mean{r} m ON b.p = m.p AND b.j = m.j)"""
            )
    out.append(
        f"""digest AS (SELECT sha256(string_agg(array_to_string(list_transform(q, lambda x: CAST(x::BIGINT AS VARCHAR)), ','), ',' ORDER BY p, j)) AS s
  FROM book{rounds}),
coded AS (SELECT i, string_agg(lower(printf('%02x', j)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{rounds} GROUP BY i)"""
    )
    return (
        "WITH " + ",\n".join(out) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,"
        " s AS codebooks_sha256 FROM kept JOIN coded USING (i), digest"
    )


@doc_query("op11_drake_hamerly_codes", sql())
def op11(spark, directory):
    coded, books = vector_codes(table(spark, directory, "embeddings"))
    digest = hashlib.sha256(books_text(books).encode()).hexdigest()
    out = with_label_error(coded).select("vec_id", "code", "error", "label_error")
    return out.withColumn("codebooks_sha256", F.lit(digest))
