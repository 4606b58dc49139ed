"""Spans found in texts: their columns, the digests of the span queries, and masking."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldledger.llm.rows import edit_rows, map_rows, text_column

SPAN_DDL = "doc_id bigint, spans array<struct<kind:string,start:bigint,end:bigint,score:double>>"
Span = tuple[str, int, int, float]


def span_table(df: DataFrame, doc_id: str, text: str, make: Callable[[], Callable[[list[str]], Iterable[list[Span]]]]) -> DataFrame:
    """``doc_id, spans`` of every row; ``make()`` gives a function from a list of texts to their span lists."""

    def build():
        find = make()

        def run(ids, texts):
            for i, found in zip(ids, find(texts), strict=True):
                yield i, [{"kind": k, "start": a, "end": b, "score": s} for k, a, b, s in found]

        return run

    return map_rows(df, [F.col(doc_id).cast("long"), text_column(text)], SPAN_DDL, build)


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` joined by commas, in the order of the array."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def kind_count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def span_digest(found: DataFrame, base: list[str]) -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans as text."""
    kept = F.filter("spans", lambda s: s["kind"].isin(base))
    return found.select(
        "doc_id",
        *[kind_count(k).alias(f"n_{k}") for k in base],
        F.sha2(spans_text(kept), 256).alias("base_sha256"),
        spans_text(F.col("spans")).alias("spans"),
    )


def masked(text: str, spans: Iterable[Span], mask: str) -> str:
    """The text with each maximal run of overlapping spans replaced by ``mask``."""
    out, at, end = [], 0, -1
    for _, a, b, _ in sorted(spans, key=lambda s: (s[1], s[2])):
        if a >= max(end, at):
            out += [text[at:a], mask]
        at = end = max(end, b)
    return "".join(out) + text[at:]


def mask_column(df: DataFrame, text: str, make: Callable, mask: str) -> DataFrame:
    """The same rows and columns with the found spans masked in the text; a null text stays null."""

    def mask_texts():
        find = make()

        def run(texts):
            found = find([t or "" for t in texts])
            return [masked(t, s, mask) if s else t for t, s in zip(texts, found, strict=True)]

        return run

    return edit_rows(df, text, mask_texts)
