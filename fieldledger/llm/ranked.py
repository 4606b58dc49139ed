"""Ranked lexical search by NRA: sorted reads only, with score intervals per document.

The documents of a task are taken in blocks of bounded size. A block gets an inverted index of the query terms whose
postings are sorted by impact, and is searched for one item after another: the lists of the item's terms are read
from the top, some more postings of each at a time. A document's lower bound is what was read of it, its upper
bound adds, for every list in which it was not met, the next impact of that list. Reading goes on until

* no document that was not met at all can reach the 20th lower bound,
* every document whose upper bound reaches it has equal bounds: membership, ties and scores are final.

A list in which no such document can still turn up is read no further. The best 20 of a task go from block to block,
so their least score is a threshold from the start; a task hands on 20 rows per item, and these are ranked.

The corpus statistics (N, L, df) come from a scan before: one row per task and term, added up by a shuffle.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldledger.llm.decontaminate import words
from fieldledger.llm.registry import doc_query, table
from fieldledger.llm.rows import map_rows, text_column

TOP = 20
#: Fixed values of the score.
SCALE, K_TERMS, K_LENGTH, B = 1_000_000_000, 1000, 12, 25
#: A block of documents ends after so many documents or postings; postings of each list read at first.
BLOCK_DOCS, BLOCK_POSTINGS, FIRST_READ = 1 << 14, 1 << 21, 64
#: Bytes of items searched for in one scan of the documents; slices of the tasks whose results are ranked first.
MAX_ITEM_BYTES, SLICES = 8 << 20, 32

Item = tuple[object, dict[bytes, int]]


def term_weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


class Block:
    """Postings of query terms in some documents."""

    def __init__(self, ids: list, lengths: list[int], postings: dict[int, tuple[array, array]], weight: np.ndarray, documents: int, total: int):
        self.ids = ids
        m = np.array([100 - B + B * n * documents // total for n in lengths], np.int64) if total else np.zeros(len(ids), np.int64)
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for term, (docs, tfs) in postings.items():
            d, tf = np.array(docs), np.array(tfs)
            impact = weight[term] * (SCALE * tf // (K_TERMS * tf + K_LENGTH * m[d]))
            by = np.argsort(-impact, kind="stable")
            self.lists[term] = d[by], impact[by]

    def search(self, terms: dict[int, int], least: int, top: int = TOP) -> list[tuple[int, int]]:
        """``(score, position)`` of every document that can be among the ``top`` best of the block with at least ``least``.

        ``least`` is a score that ``top`` documents elsewhere reach; zero if fewer are known.
        """
        lists = [(self.lists[t][0], self.lists[t][1] * times) for t, times in terms.items() if t in self.lists]
        if not lists:
            return []
        n, floor = len(self.ids), max(least, 1)
        lower = np.zeros(n, np.int64)
        seen = np.zeros((len(lists), n), bool)
        read = np.zeros(len(lists), np.int64)
        size = np.array([len(d) for d, _ in lists])
        bound = np.array([int(i[0]) for _, i in lists], np.int64)
        wanted = np.ones(len(lists), bool)
        step = FIRST_READ
        while True:
            for k in np.flatnonzero(wanted & (read < size)):
                d, impact = lists[k]
                part = slice(read[k], read[k] + step)
                lower[d[part]] += impact[part]  # a document is in a list once
                seen[k, d[part]] = True
                read[k] = min(size[k], read[k] + step)
                bound[k] = impact[read[k]] if read[k] < size[k] else 0
            step *= 2
            threshold = max(floor, int(np.partition(lower, n - top)[n - top]) if n >= top else 0)
            if bound.sum() >= threshold:
                wanted[:] = True
                continue
            alive = np.flatnonzero(lower + bound.sum() >= threshold)
            upper = lower[alive] + bound.sum() - bound @ seen[:, alive]
            alive = alive[upper >= threshold]
            # lists that can still raise a document that counts
            wanted = (~seen[:, alive]).any(axis=1) & (bound > 0)
            if not wanted.any():
                break
        return [(int(lower[a]), int(a)) for a in alive if lower[a] >= threshold]


class Search:
    """The items over a stream of documents: block after block, the best of each item kept."""

    def __init__(self, items: list[Item], stats: dict[bytes, int], documents: int, total: int, top: int = TOP):
        self.number = {t: i for i, t in enumerate(stats)}
        self.weight = np.array([term_weight(documents, df) for df in stats.values()], np.int64)
        self.items = [(item, {self.number[t]: c for t, c in terms.items() if t in self.number}) for item, terms in items]
        self.documents, self.total, self.top = documents, total, top
        self.best: list[list[tuple]] = [[] for _ in items]
        self.clear()

    def clear(self) -> None:
        self.ids, self.lengths, self.postings, self.size = [], [], {}, 0

    def add(self, doc_id, text: str) -> None:
        found = words(text)
        if not found:
            return
        at, number = len(self.ids), self.number
        for term, tf in Counter(found).items():
            k = number.get(term)
            if k is not None:
                if k not in self.postings:
                    self.postings[k] = array("q"), array("q")
                docs, tfs = self.postings[k]
                docs.append(at)
                tfs.append(tf)
                self.size += 1
        self.ids.append(doc_id)
        self.lengths.append(len(found))
        if len(self.ids) >= BLOCK_DOCS or self.size >= BLOCK_POSTINGS:
            self.solve()

    def solve(self) -> None:
        if self.ids:
            block = Block(self.ids, self.lengths, self.postings, self.weight, self.documents, self.total)
            for k, (_, terms) in enumerate(self.items):
                best = self.best[k]
                least = -best[-1][0] if len(best) >= self.top else 0
                new = [(-score, self.ids[a] is None, self.ids[a]) for score, a in block.search(terms, least, self.top)]
                if new:
                    self.best[k] = sorted([*best, *new], key=lambda x: (x[0], x[1], x[2] or 0))[: self.top]
        self.clear()

    def rows(self) -> Iterator[tuple[int, object, int]]:
        """``(number of the item, doc_id, score)``."""
        self.solve()
        for k, best in enumerate(self.best):
            for score, _, doc_id in best:
                yield k, doc_id, -score


def counted(wanted: frozenset[bytes]) -> Callable:
    """Per task: documents with a term, terms, and in how many documents each wanted term is."""

    def start():
        df: Counter = Counter()
        sums = [0, 0]

        def read(texts):
            for t in texts:
                found = words(t)
                if found:
                    sums[0] += 1
                    sums[1] += len(found)
                    df.update(wanted.intersection(found))

        def done():
            yield None, sums[0], sums[1]
            for term, n in df.items():
                yield term, n, 0

        return read, done

    return start


def statistics(docs: DataFrame, text: str, wanted: frozenset[bytes]) -> tuple[dict[bytes, int], int, int]:
    """df of each wanted term that occurs, N and L. The result has one row per wanted term."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def start():
        return counted(shared.value)()

    rows = map_rows(docs, [text_column(text)], "term binary, n bigint, total bigint", start, at_end=True)
    sums = rows.groupBy("term").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()
    df = {bytes(r.term): r.n for r in sums if r.term is not None}
    n, total = next(((r.n, r.total) for r in sums if r.term is None), (0, 0))
    return dict(sorted(df.items())), n, total


def item_parts(items: DataFrame, item: str, text: str, max_bytes: int) -> Iterator[list[Item]]:
    """Items with their terms and repeats, in groups of at most about ``max_bytes`` of text.

    The bytes are summed before any row is fetched; rows of one item stay together.
    """
    rows = items.select(F.col(item).alias("item"), text_column(text).alias("t"))
    total = rows.agg(F.sum(F.octet_length("t") + 64).alias("b")).first()["b"] or 0
    n = -(-total // max_bytes)
    for k in range(n):
        found: dict[object, Counter] = {}
        for r in rows.filter(F.pmod(F.xxhash64("item"), F.lit(n)) == k).toLocalIterator():
            found.setdefault(r.item, Counter()).update(words(r.t))
        yield [(i, dict(c)) for i, c in found.items()]


def ranked_search(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    top: int = TOP,
    max_item_bytes: int = MAX_ITEM_BYTES,
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` documents of each item with a score above zero.

    Equal scores rank by ascending id, those without an id last. A null or wordless text has no terms: such a document
    is never found nor counted, such an item has no rows. Every row of ``docs`` is a document, repeated rows too. Rows of
    ``items`` that share an id, the null id included, are one item with the terms of all of them. An empty table
    gives no rows.
    """
    spark = docs.sparkSession
    kind = items.schema[item].dataType
    out = None
    for part in item_parts(items, item, item_text, max_item_bytes):
        df, documents, total = statistics(docs, text, frozenset(t for _, terms in part for t in terms))
        shared = spark.sparkContext.broadcast((part, df, documents, total, top))

        def start(shared=shared):
            search = Search(*shared.value)

            def read(ids, texts):
                for i, t in zip(ids, texts, strict=True):
                    search.add(i, t)

            return read, search.rows

        found = map_rows(docs, [F.col(doc_id).cast("long"), text_column(text)], "k int, doc_id bigint, score bigint", start, at_end=True)
        # first within slices of the tasks, so that an item's rows meet in one task only after they have become few
        sliced = best_of(found.withColumn("slice", F.spark_partition_id() % SLICES), ["k", "slice"], top)
        ranked = best_of(sliced, ["k"], top)
        names = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(part)], items.select(F.lit(0).alias("k"), F.col(item).alias("item_id")).schema)
        rows = ranked.join(F.broadcast(names), "k").select("item_id", "rank", "doc_id", "score")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        return spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id bigint, score bigint")
    return out


def best_of(found: DataFrame, keys: list[str], top: int) -> DataFrame:
    """The ``top`` rows of each key by score and id, numbered as ``rank``."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


TERMS_SQL = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
SQL = f"""
WITH doc AS (SELECT row_number() OVER () AS d, doc_id, {TERMS_SQL} AS w FROM documents),
named AS (SELECT d, doc_id, len(w) AS n FROM doc WHERE len(w) > 0),
total AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM named),
asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({TERMS_SQL}) AS term FROM benchmark) GROUP BY 1, 2),
tf AS (SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(w) AS term FROM doc) WHERE term IN (SELECT term FROM asked) GROUP BY 1, 2),
weight AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * max(nn) + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY term),
impact AS (
  SELECT d, doc_id, term, w * (({SCALE}::BIGINT * tf) // ({K_TERMS} * tf + {K_LENGTH} * ({100 - B} + ({B}::BIGINT * n * nn) // ll))) AS part
  FROM tf JOIN weight USING (term) JOIN named USING (d), total),
score AS (
  SELECT item_id, d, any_value(doc_id) AS doc_id, CAST(sum(times * part) AS BIGINT) AS score
  FROM asked JOIN impact USING (term) GROUP BY item_id, d)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM score WHERE score > 0)
WHERE rank <= {TOP}
"""


@doc_query("op13_nra_ranked_search", SQL)
def op13(spark, directory):
    return ranked_search(table(spark, directory, "documents"), table(spark, directory, "benchmark"))
