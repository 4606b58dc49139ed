"""Folds of labelled documents and bounded samples for fitting."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HELD_OUT = 1
FOLDS = 3


def fold(doc_id: str) -> Column:
    """Remainder of the CRC-32 of the id as text; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS


def held_out(doc_id: str) -> Column:
    """True in the fold no model may learn from; a null id is in no fold and is never learned from."""
    return F.coalesce(fold(doc_id) == HELD_OUT, F.lit(False))


def sampled_ids(labelled: DataFrame, doc_id: str, label: str, per_class: int) -> tuple[DataFrame, dict]:
    """Ids and labels of about ``per_class`` training rows of each class, and how many rows each class has.

    A row is in the sample by the hash of its id alone, so a retried task chooses the same rows.
    """
    usable = labelled.filter(F.col(label).isNotNull() & (fold(doc_id) != HELD_OUT)).select(
        F.col(doc_id).alias("doc_id"), F.col(label).alias("label")
    )
    counts = {r["label"]: r["n"] for r in usable.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.lit(0.0)
    for value, n in counts.items():
        share = F.when(F.col("label") == F.lit(value), F.lit(min(1.0, per_class / n))).otherwise(share)
    return usable.filter(place < share).withColumn("place", place), counts


def fair_choice(sizes: dict[object, list[int]], max_bytes: int) -> dict[object, list[int]]:
    """Positions of the texts of each class that are taken, ascending, given their sizes in bytes.

    Each class first gets its smallest text. What is left is dealt in equal parts, the rest of a class's part that
    its texts cannot fill going to the larger classes; a text that no longer fits is passed over.
    """
    left, out = max_bytes, {c: [] for c in sizes}
    smallest = {c: min(range(len(v)), key=v.__getitem__) for c, v in sizes.items()}
    for c in sorted(sizes, key=lambda c: (sizes[c][smallest[c]], str(c))):
        if sizes[c][smallest[c]] <= left:
            left -= sizes[c][smallest[c]]
            out[c].append(smallest[c])
    taken = {c: set(v) for c, v in out.items()}
    while order := [c for c in sizes if any(n <= left and i not in taken[c] for i, n in enumerate(sizes[c]))]:
        order.sort(key=lambda c: (sum(sizes[c]), str(c)))
        before = left
        for k, c in enumerate(order):
            part = left // (len(order) - k)
            for i, size in enumerate(sizes[c]):
                if size <= part and i not in taken[c]:
                    part, left = part - size, left - size
                    taken[c].add(i)
        if left == before:
            break
    return {c: sorted(v) for c, v in taken.items()}


def sampled_texts(rows: DataFrame, max_bytes: int) -> list[tuple[str, object]]:
    """``(text, label)`` of a sample, in the order of their hashes, as far as ``max_bytes`` go.

    Whole texts only. The sizes are fetched first, so that every class gets its part of the bytes, wherever its
    rows stand in the order.
    """
    keyed = rows.select("text", "label", "place", "doc_id", F.octet_length("text").alias("size"), F.xxhash64("text").alias("h"))
    key = ["label", "place", "doc_id", "h", "size"]
    by_class: dict[object, list[tuple]] = {}
    for r in keyed.select(*key).collect():
        by_class.setdefault(r.label, []).append(tuple(r))
    by_class = {c: sorted(v, key=lambda x: x[1:]) for c, v in by_class.items()}
    taken = fair_choice({c: [x[-1] for x in v] for c, v in by_class.items()}, max_bytes)
    due = Counter(by_class[c][i] for c, places in taken.items() for i in places)
    # what is not taken stays in the tasks
    wanted = keyed.sparkSession.createDataFrame(list(due), keyed.select(*key).schema) if due else keyed.select(*key).limit(0)
    out = []
    for r in keyed.join(F.broadcast(wanted), key, "left_semi").orderBy("place", "doc_id", "text").toLocalIterator():
        if due[x := (r.label, r.place, r.doc_id, r.h, r.size)] > 0:
            due[x] -= 1
            out.append((r.text, r.label))
    return out
