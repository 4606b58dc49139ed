"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The strings sought are windows of 13 consecutive words of each benchmark item (an item of fewer words is one
window). Words, not bytes, are the symbols of the search: a block is a pair of neighbouring words. For each
window length there is one searcher with

* a shift table: for a block, how far the search may jump ahead because no window has that block nearer to
  its end; blocks that no window holds allow the longest jump,
* buckets: windows by their last block, and within these by their first, for the positions with shift zero,
* direct comparison of the whole window with the words of the document.

Windows are the query set. It is collected only after its size in bytes has been summed: item groups of at
most ``max_block_bytes`` are broadcast and searched for one after another, each against all documents, and the
covered words of a document are merged if there was more than one group.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldledger.llm.registry import doc_query, table
from fieldledger.llm.rows import edit_rows, map_rows, text_column

WINDOW = 13
MAX_BLOCK_BYTES = 16 << 20
#: ASCII capitals become small; everything in ASCII that is neither digit nor letter separates words.
FOLD = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256)
)


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split()


def windows(item_words: list[bytes], length: int = WINDOW) -> Iterable[tuple[bytes, ...]]:
    if not item_words:
        return
    size = min(length, len(item_words))
    for i in range(len(item_words) - size + 1):
        yield tuple(item_words[i : i + size])


class WuManber:
    """Search for windows of one length in a list of words."""

    def __init__(self, patterns: dict[tuple[bytes, ...], tuple[str, ...]], length: int):
        self.length, self.block = length, min(2, length)
        self.jump = length - self.block + 1
        self.shift: dict = {}
        self.buckets: dict = {}
        for p, items in patterns.items():
            for end in range(self.block, length + 1):
                b = self._key(p, end)
                self.shift[b] = min(self.shift.get(b, self.jump), length - end)
            self.buckets.setdefault(self._key(p, length), {}).setdefault(p[: self.block], []).append((p, items))

    def _key(self, w, end: int):
        return (w[end - 2], w[end - 1]) if self.block == 2 else w[end - 1]

    def find(self, w: list[bytes]) -> Iterable[tuple[int, tuple[str, ...]]]:
        """(start, items) of every occurrence, from left to right."""
        shift, jump, length, pair = self.shift.get, self.jump, self.length, self.block == 2
        i, n = length, len(w)
        while i <= n:
            b = (w[i - 2], w[i - 1]) if pair else w[i - 1]
            step = shift(b, jump)
            if step:
                i += step
                continue
            start = i - length
            for p, items in self.buckets[b].get(tuple(w[start : start + self.block]), ()):
                if tuple(w[start:i]) == p:
                    yield start, items
            i += 1


def searchers(items: list[tuple[str | None, str]], length: int = WINDOW) -> list[WuManber]:
    """One searcher per window length that occurs among the items; one without an id gives windows without its name."""
    by_length: dict[int, dict[tuple[bytes, ...], set[str]]] = {}
    for item, text in items:
        for w in windows(words(text), length):
            by_length.setdefault(len(w), {}).setdefault(w, set()).update(() if item is None else (item,))
    return [WuManber({w: tuple(sorted(s)) for w, s in group.items()}, n) for n, group in sorted(by_length.items())]


def hits(text: str, search: list[WuManber]) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Number of words, disjoint ascending (start, end) runs of hit words, items with occurring windows."""
    w = words(text)
    found, items = [], set()
    for s in search:
        for start, names in s.find(w):
            found.append((start, start + s.length))
            items.update(names)
    return len(w), merged(found), items


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def item_groups(benchmark: DataFrame, item: str, text: str, max_bytes: int) -> list[list[tuple[str | None, str]]]:
    """The benchmark in groups whose texts hold at most about ``max_bytes``; the sum is taken before any is fetched."""
    items = benchmark.select(F.col(item).cast("string").alias("i"), text_column(text).alias("t"))
    total = items.agg(F.sum(F.octet_length("t")).alias("b")).first()["b"] or 0
    n = -(-total // max_bytes)
    for k in range(n):
        yield [(r.i, r.t) for r in items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).toLocalIterator()]


def benchmark_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    length: int = WINDOW,
    max_block_bytes: int = MAX_BLOCK_BYTES,
) -> DataFrame:
    """Per document: ``doc_id, n_words, spans`` (runs of hit words), ``items`` (ids of items, as strings, sorted).

    A null text has no words. The words of items with a null id are hit words, but add nothing to ``items``;
    items with a null or wordless text have no windows. Rows are kept one for one, repeated rows too; a null id stays null. An empty benchmark or an
    empty table of documents gives no hits or no rows.
    """
    sc = docs.sparkSession.sparkContext
    groups = [sc.broadcast(g) for g in item_groups(benchmark, item, item_text, max_block_bytes)]
    return hits_by_group(docs, groups, doc_id, text, length).drop("digest")


def hits_by_group(docs: DataFrame, groups: list, doc_id: str, text: str, length: int, digest: bool = False) -> DataFrame:
    """Search for one broadcast group of items after another; ``digest`` adds the SHA-256 of the text."""
    ddl = "doc_id bigint, n_words bigint, spans array<struct<start:bigint,end:bigint>>, items array<string>"
    inputs = [F.col(doc_id).cast("long"), text_column(text)]

    def scan(group):
        def make():
            search = searchers(group.value if group is not None else [], length)

            def fn(ids, texts):
                for i, t in zip(ids, texts, strict=True):
                    n, spans, items = hits(t, search)
                    yield i, n, [{"start": a, "end": b} for a, b in spans], sorted(items)

            return fn

        return make

    if len(groups) <= 1 and not digest:
        return map_rows(docs, inputs, ddl, scan(groups[0] if groups else None))
    keyed = [*inputs, F.sha2(text_column(text), 256)]
    parts = None
    for g in groups:
        part = map_rows(docs, keyed, "digest string, " + ddl, with_key(scan(g)))
        parts = part if parts is None else parts.unionByName(part)
    # every row comes once from each group: repeated rows are told by how many times over
    merged_rows = parts.groupBy("digest", "doc_id", "n_words").agg(
        F.array_distinct(F.flatten(F.collect_set("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        (F.count(F.lit(1)) / F.lit(len(groups))).cast("int").alias("copies"),
    )
    columns = ["digest", "doc_id", "n_words", "spans", "items", "copies"]
    return map_rows(merged_rows, [F.col(c) for c in columns], "digest string, " + ddl, merge_spans)


def with_key(make):
    def keyed():
        fn = make()

        def run(ids, texts, keys):
            for k, row in zip(keys, fn(ids, texts), strict=True):
                yield (k, *row)

        return run

    return keyed


def merge_spans():
    def run(digests, ids, counts, spans, items, copies):
        for d, i, n, s, it, c in zip(digests, ids, counts, spans, items, copies, strict=True):
            runs = [{"start": a, "end": b} for a, b in merged((x["start"], x["end"]) for x in s)]
            for _ in range(c):
                yield d, i, n, runs, it

    return run


def contamination(found: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The counts of each document and whether a twentieth of its words, at least, is hit."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    out = found.select(
        *(keys or ["doc_id"]),
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
    )
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def is_contaminated(n_words: int, n_hit: int) -> bool:
    return n_hit > 0 and 20 * n_hit >= n_words


def uncontaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    max_block_bytes: int = MAX_BLOCK_BYTES,
) -> DataFrame:
    """The rows, with all their columns, that are not contaminated; a null or wordless text never is."""
    sc = docs.sparkSession.sparkContext
    groups = [sc.broadcast(g) for g in item_groups(benchmark, item, item_text, max_block_bytes)]
    if len(groups) > 1:
        # runs of hit words must be merged over the groups: found by the digest of the text, then left out
        keyed = docs.select(text_column(text).alias("text"), F.lit(0).cast("long").alias("doc_id")).distinct()
        found = hits_by_group(keyed, groups, "doc_id", "text", WINDOW, digest=True)
        bad = contamination(found, ["digest"]).filter("contaminated").select("digest").distinct()
        marked = docs.withColumn("_digest", F.sha2(text_column(text), 256))
        return marked.join(bad, F.col("_digest") == F.col("digest"), "left_anti").drop("_digest")

    def make():
        search = searchers(groups[0].value if groups else [])

        def clean(text):
            n, spans, _ = hits(text, search)
            return not is_contaminated(n, sum(b - a for a, b in spans))

        return lambda texts: [t is None or clean(t) for t in texts]

    return edit_rows(docs, text, make, keep=True)


WORDS_SQL = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
SQL = f"""
WITH item_words AS (SELECT CAST(item_id AS VARCHAR) AS item, {WORDS_SQL} AS w FROM benchmark WHERE item_id IS NOT NULL),
item_windows AS (
  SELECT DISTINCT item, least(len(w), {WINDOW}) AS size, list_slice(w, i, i + least(len(w), {WINDOW}) - 1) AS pattern
  FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS i FROM item_words WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM item_windows),
doc_words AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
doc_windows AS (
  SELECT doc_id, size, i, list_slice(w, i, i + size - 1) AS pattern
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM doc_words, sizes WHERE len(w) >= size)),
found AS (SELECT doc_id, i, d.size, item FROM doc_windows d JOIN item_windows p ON d.size = p.size AND d.pattern = p.pattern),
hit AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS pos FROM found) GROUP BY 1),
named AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM found GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc_words LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""


@doc_query("op7_wu_manber_decontamination", SQL)
def op7(spark, directory):
    found = benchmark_hits(table(spark, directory, "documents"), table(spark, directory, "benchmark"))
    return contamination(found)
