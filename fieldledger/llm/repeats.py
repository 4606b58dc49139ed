"""Repeated byte strings found with suffix order and longest-previous-factor tests, over the whole corpus.

A string of ``LENGTH`` bytes that occurs twice is found in three steps, each a Spark job over all documents.

1. Anchors. Of the grams of ``GRAM`` bytes inside a string of ``LENGTH`` bytes, the one with the least mixed rolling hash (the
   leftmost of equals) is its anchor. Equal strings have equal anchors at equal offsets, and each start of
   a string belongs to exactly one anchor, so comparing strings only within groups of equal anchor grams loses
   nothing. An anchor's context is all that the strings which belong to it cover. Only hashes of gram and context move.
2. Groups. Grams that occur once are dropped. If a context occurs twice as a whole, all strings in it are
   repeated. Where a gram has several contexts, one of each is fetched from the texts.
3. Suffixes. Contexts of a group meet in one task. The suffixes at the starts are put in order by prefix doubling, to
   the depth of ``LENGTH`` bytes, equal ones by position. Then a suffix's nearest smaller position in suffix order is its
   predecessor among equals, if it has one: its longest previous factor reaches ``LENGTH`` exactly in this
   case, and its longest next factor exactly if it has a successor among equals.

A group with more than ``SHARE`` different contexts does not meet in a task. Equal strings have their anchor at one offset, so such
contexts share a string only if they share the core of one of five ranges of offsets: the bytes all its strings have
in common. Cores are counted by 128-bit hashes; where one repeats, the strings around it are classes by hash, and a class's least
and greatest place give the previous and next factor. Both steps are sums, linear in the contexts, whatever they have in
common. Intermediate tables go to the shared folder.

Passages of ``WORDS`` words that another document holds too are reported beside, as they may be shorter than ``LENGTH`` bytes. A
text is then a string of words, runs without ASCII white space, each a unit of 8 bytes, its hash. Anchors and groups are those above; all groups
go by cores and classes, and a class counts if two documents have it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldledger.llm.registry import doc_query, table
from fieldledger.llm.rows import map_rows, shared_table, ship_package, text_column

LENGTH, GRAM = 400, 64
SHARE = 1024
#: Words of a passage and of the grams in it, and bytes of a word's hash.
WORDS, WORD_GRAM, WORD = 51, 8, 8
#: Longer words, in bytes, are not hashed by the rolling hash.
LONG_WORD = 32
SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Ranges of anchor offsets, less one, whose strings share a core.
CORES = 4
#: Bytes of context whose suffixes are sorted at a time, if the groups allow; bytes of text hashed at a time.
SORTED_BYTES, STRETCH = 1 << 20, 1 << 22
#: Bytes of texts whose anchors are sought at a time, with the rest of the last text.
JOINED_BYTES = 1 << 18
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


class Powers:
    """Powers of the rolling hash's base and of its inverse, a fixed number for each byte, and which bytes part words."""

    def __init__(self):
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)
        x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        self.byte = x ^ (x >> np.uint64(32))
        self.space = np.array([SPACE.match(bytes([b])) is not None for b in range(256)])

    def grow(self, n: int) -> None:
        if len(self.up) < n:
            for name, base in (("up", BASE), ("down", INVERSE)):
                powers = np.full(n, base, np.uint64)
                powers[0] = 1
                setattr(self, name, np.multiply.accumulate(powers))


def units(text: str, unit: int, powers: Powers) -> bytes:
    """The text's bytes or, where a unit is a word, the hashes of its words, made of a stretch at a time."""
    raw = text.encode("utf-8", "surrogatepass")
    if unit == 1:
        return raw
    out, at = [], 0
    while at < len(raw):
        cut_at = SPACE.search(raw, at + STRETCH)
        end = cut_at.start() if cut_at else len(raw)
        out.append(word_hashes(raw[at:end], powers))
        at = end
    return b"".join(out)


def word_hashes(raw: bytes, powers: Powers) -> bytes:
    """Per word its mixed rolling hash, eight bytes each; long words, in which the rolling hash has patterns, get another."""
    a = np.frombuffer(raw, np.uint8)
    space = np.ones(len(a) + 2, bool)
    space[1:-1] = powers.space[a]
    edges = np.flatnonzero(space[1:] != space[:-1])
    begins, ends = edges[::2], edges[1::2]
    powers.grow(len(a) + 1)
    sums = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(powers.byte[a] * powers.up[: len(a)], out=sums[1:])
    h = (sums[ends] - sums[begins]) * powers.down[begins]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    for k in np.flatnonzero(ends - begins > LONG_WORD).tolist():
        h[k] = xxhash.xxh3_64_intdigest(raw[begins[k] : ends[k]])
    return h.tobytes()


def gram_keys(raw: bytes, gram: int, powers: Powers, unit: int = 1) -> np.ndarray:
    """Per gram its mixed rolling hash, with the position in the low bits so that the leftmost of equals is least."""
    a = powers.byte[np.frombuffer(raw, np.uint8)] if unit == 1 else np.frombuffer(raw, np.uint64)
    n = len(a) - gram + 1
    powers.grow(len(a) + 1)
    sums = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(a * powers.up[: len(a)], out=sums[1:])
    h = (sums[gram:] - sums[:n]) * powers.down[:n]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h & ~np.uint64(0xFFFFFF)) | np.arange(n, dtype=np.uint64)


def window_minima(keys: np.ndarray, w: int) -> np.ndarray:
    """Least key of every ``w`` consecutive ones, from running minima of blocks in both directions."""
    n = len(keys)
    padded = np.full(-(-n // w) * w, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = keys
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def anchors(raw: bytes, powers: Powers, length: int = LENGTH, gram: int = GRAM, unit: int = 1) -> Iterator[tuple[int, int, int]]:
    """``(anchor, first start, last start)`` of runs of starts that share an anchor, from left to right.

    A long text is taken in stretches; a run that crosses from one to the next is given in two parts.
    """
    for at in range(0, max(0, len(raw) // unit - length + 1), STRETCH):
        part = memoryview(raw)[unit * at : unit * (at + STRETCH + length - 1)]
        owner = (window_minima(gram_keys(part, gram, powers, unit), length - gram + 1) & np.uint64(0xFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        last = np.r_[first[1:], len(owner)] - 1
        yield from zip((owner[first] + at).tolist(), (first + at).tolist(), (last + at).tolist(), strict=True)


def anchors_of_all(raws: list[bytes], powers: Powers, length: int, gram: int, unit: int) -> Iterator[tuple[int, int, int, int]]:
    """``(which text, anchor, first start, last start)`` as ``anchors`` gives them for each, from many short texts in one string."""
    sizes = np.array([len(r) for r in raws], np.int64)
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // JOINED_BYTES)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(raws)], strict=True):
        ends = np.cumsum(sizes[a:b] // unit)
        found = np.array(list(anchors(b"".join(raws[a:b]), powers, length, gram, unit)), np.int64).reshape(-1, 3)
        # a string within a text has its anchor there; strings that cross to the next text are left out
        which = np.searchsorted(ends, found[:, 0], "right")
        begin = np.r_[0, ends][which]
        first = np.maximum(found[:, 1], begin)
        last = np.minimum(found[:, 2], ends[which] - length)
        at = np.flatnonzero(first <= last)
        yield from zip(*(c[at].tolist() for c in (which + a, found[:, 0] - begin, first - begin, last - begin)), strict=True)


def signed(h: int) -> int:
    return h - (h >> 63 << 64)


def occurrences(rows: DataFrame, kinds: list[tuple[int, int, int]]) -> DataFrame:
    """``unit, ah, ctx, doc, th, lo, hi``: hashes of an anchor's gram and of its context, and the starts that belong to it.

    Each kind is ``(length, gram, unit)``; the texts are read once for all.
    """

    def make():
        powers = Powers()

        def run(docs, marks, texts):
            for length, gram, unit in kinds:
                raws = [units(t, unit, powers) for t in texts]
                for k, p, lo, hi in anchors_of_all(raws, powers, length, gram, unit):
                    raw = raws[k]
                    ah = xxhash.xxh3_64_intdigest(raw[unit * p : unit * (p + gram)])
                    # where the anchor stands in the context is part of it
                    ctx = xxhash.xxh3_64_intdigest(raw[unit * lo : unit * (hi + length)], p - lo)
                    yield unit, signed(ah), signed(ctx), docs[k], marks[k], lo, hi

        return run

    ddl = "unit int, ah bigint, ctx bigint, doc bigint, th bigint, lo int, hi int"
    return map_rows(rows, [F.col("doc"), F.col("th"), F.col("text")], ddl, make)


def document() -> Column:
    return F.xxhash64("doc", "th")


def grouped(occ: DataFrame, share: int, across: bool = False) -> DataFrame:
    """The occurrences that matter, with what is known of them.

    ``whole``: the context occurs more than once or, with ``across``, in two documents. ``shown``: the later steps need it; of a context that
    is whole they need one. ``least``: it is the first of
    its context. ``large``: the group has too many contexts to meet in one task. The sums are written before they are joined: a join whose
    sides both come straight from a shuffle can split the rows of a hot gram over tasks, one above an aggregate can not.
    """
    twice = F.min(document()) < F.max(document()) if across else F.count(F.lit(1)) > 1
    repeated = shared_table(occ.groupBy("ah").agg(twice.alias("twice")).filter("twice").select("ah"))
    kept = shared_table(occ.join(repeated, "ah", "left_semi"))
    contexts = shared_table(kept.groupBy("ah", "ctx").agg(twice.alias("whole"), F.min(F.struct("doc", "th", "lo")).alias("first")))
    groups = shared_table(contexts.groupBy("ah").agg(F.count(F.lit(1)).alias("m")))
    known = contexts.join(groups, "ah").select("ah", "ctx", "whole", "first", "m")
    told = kept.join(known, ["ah", "ctx"])
    least = F.col("first") == F.struct("doc", "th", "lo")
    return told.select(
        "ah", "ctx", "doc", "th", "lo", "hi", "whole",
        ((F.col("m") > 1) & (least | ~F.col("whole"))).alias("shown"),
        least.alias("least"),
        (F.col("m") > share).alias("large"),
    )


def shown_contexts(rows: DataFrame, told: DataFrame) -> DataFrame:
    """Bytes of the contexts that the later steps need, ``lo`` to ``end`` in their unit, from one more reading of the texts."""
    entry = F.struct("lo", "end", "unit", "ah", "ctx", "whole", "large")
    wanted = told.filter("shown").groupBy("doc", "th").agg(F.collect_list(entry).alias("entries"))
    ddl = "unit int, ah bigint, ctx bigint, large boolean, doc bigint, th bigint, lo int, whole boolean, context binary"

    def make():
        powers = Powers()

        def run(docs, marks, texts, entries):
            for d, m, t, found in zip(docs, marks, texts, entries, strict=True):
                raw = {u: units(t, u, powers) for u in {e["unit"] for e in found}}
                for e in found:
                    u = e["unit"]
                    yield u, e["ah"], e["ctx"], e["large"], d, m, e["lo"], e["whole"], raw[u][u * e["lo"] : u * e["end"]]

        return run

    joined = rows.join(wanted, ["doc", "th"])
    return map_rows(joined, [F.col(c) for c in ("doc", "th", "text", "entries")], ddl, make)


def suffix_classes(raw: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Rank of each start's suffix among all to the depth of ``length`` bytes; equal prefixes have equal ranks.

    Prefix doubling: ranks by 8 bytes, then by twice as many in each round; a position whose rank is its own
    already takes no further part.
    """
    n = len(raw)
    padded = np.concatenate([raw, np.zeros(8, np.uint8)]).astype(np.uint64)
    packed = np.zeros(n, np.uint64)
    for i in range(8):
        packed = packed << np.uint64(8) | padded[i : i + n]
    order = np.argsort(packed)
    new = np.r_[True, packed[order][1:] != packed[order][:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    depth = 8
    while depth < length:
        step = min(depth, length - depth)
        size = np.bincount(rank, minlength=n)
        active = np.flatnonzero(size[rank] > 1)
        if not len(active):
            break
        ahead = active + step
        key = rank[active] * (n + 1) + np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        order = np.argsort(key)
        key, at = key[order], active[order]
        old = key // (n + 1)
        begins = np.r_[True, old[1:] != old[:-1]]
        new = np.r_[True, key[1:] != key[:-1]]
        index = np.arange(len(at))
        # a class keeps the places of its old class: new rank = old rank + how many of the old class stand before
        rank[at] = old + (index[new][np.cumsum(new) - 1] - index[begins][np.cumsum(begins) - 1])
        depth += step
    return rank[starts]


def factor_tests(rank: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether the longest previous, and the longest next, factor at each start reaches the sorted depth.

    ``place`` orders the starts as they stand in the corpus; starts at one and the same place are one.
    """
    order = np.lexsort((place, rank))
    r, p = rank[order], place[order]
    same = (r[1:] == r[:-1]) & (p[1:] != p[:-1])
    before, after = np.zeros(len(rank), bool), np.zeros(len(rank), bool)
    before[order[1:]] = same
    after[order[:-1]] = same
    return before, after


def suffix_step(length: int, keep_first: bool):
    """Covered byte ranges of the contexts of partitions sorted by group; groups are taken whole."""

    def solve(rows: list[tuple]) -> list[tuple]:
        # in the order of the corpus, so that an earlier position is a smaller place
        rows.sort(key=lambda r: r[1:4])
        raw = np.frombuffer(b"".join(r[5] for r in rows), np.uint8)
        sizes = np.array([len(r[5]) for r in rows])
        counts = sizes - length + 1
        begins = np.cumsum(sizes) - sizes
        within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        starts = np.repeat(begins, counts) + within
        # rows that repeat a place of the corpus are that place
        new = np.array([True, *(a[1:4] != b[1:4] for a, b in zip(rows, rows[1:], strict=False))])
        place = np.repeat(begins[np.flatnonzero(new)[np.cumsum(new) - 1]], counts) + within
        before, after = factor_tests(suffix_classes(raw, starts, length), place)
        hit = before if keep_first else before | after
        out = []
        for (_, d, m, lo, whole, _), a, n in zip(rows, np.cumsum(counts) - counts, counts, strict=True):
            if keep_first or not whole:
                h = np.flatnonzero(np.diff(np.r_[False, hit[a : a + n], False].astype(np.int8)))
                out += [(d, m, lo + int(x), lo + int(y) - 1 + length) for x, y in h.reshape(-1, 2)]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def table_of(out):
            columns = zip(*out, strict=True)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc", "th", "start", "end"])

        waiting, size, group = [], 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != group:
                    if size >= SORTED_BYTES:
                        if out := solve(waiting):
                            yield table_of(out)
                        waiting, size = [], 0
                    group = row[0]
                waiting.append(row)
                size += len(row[5])
        if waiting and (out := solve(waiting)):
            yield table_of(out)

    return run


def halves(h: int) -> tuple[int, int]:
    return signed(h >> 64), signed(h & 0xFFFFFFFFFFFFFFFF)


def offset_ranges(context: bytes, length: int, gram: int, powers: Powers, unit: int = 1) -> Iterator[tuple[int, int, int, bytes]]:
    """``(range, first start, last start, core)`` of each range of anchor offsets that starts of the context fall in."""
    width = max(1, (length - gram) // CORES)
    at = int(gram_keys(context[: unit * length], gram, powers, unit).min() & np.uint64(0xFFFFFF))
    last = len(context) // unit - length
    for g in range((at - last) // width, at // width + 1):
        core = at - width * g
        yield g, max(0, core - width + 1), min(last, core), context[unit * core : unit * (core + length - width + 1)]


def classes(rows: DataFrame, at: str, across: bool) -> DataFrame:
    """``h1, h2, a, b``: the hashes that two places have, the least and the greatest of them; with ``across``, that two documents have.

    A whole context is shown in one document, but two have it.
    """
    place = document() if across else F.struct("doc", "th", at)
    sums = rows.groupBy("h1", "h2").agg(F.min(place).alias("a"), F.max(place).alias("b"), F.max("whole").alias("whole"))
    return sums.filter("a < b OR whole" if across else "a < b").select("h1", "h2", "a", "b")


def repeated_cores(contexts: DataFrame, length: int, gram: int, unit: int, across: bool) -> DataFrame:
    """``ah, ctx, ranges``: the ranges of offsets of each context whose core another place has too."""

    def make():
        powers = Powers()

        def run(heads, hashes, docs, marks, los, wholes, texts):
            for ah, ctx, d, m, lo, whole, c in zip(heads, hashes, docs, marks, los, wholes, texts, strict=True):
                for g, _, _, core in offset_ranges(c, length, gram, powers, unit):
                    yield *halves(xxhash.xxh3_128_intdigest(core, g)), g, ah, ctx, d, m, lo, whole

        return run

    ddl = "h1 bigint, h2 bigint, g int, ah bigint, ctx bigint, doc bigint, th bigint, lo int, whole boolean"
    cores = shared_table(map_rows(contexts, [F.col(c) for c in ("ah", "ctx", "doc", "th", "lo", "whole", "context")], ddl, make))
    twice = classes(cores, "lo", across).select("h1", "h2")
    # written first, so that the join can split a core that very many contexts share
    return cores.join(shared_table(twice), ["h1", "h2"], "left_semi").groupBy("ah", "ctx").agg(F.collect_set("g").alias("ranges"))


def large_groups(contexts: DataFrame, length: int, gram: int, keep_first: bool = False, unit: int = 1, across: bool = False) -> DataFrame:
    """Covered ranges of the contexts of large groups, ``doc, th, start, end``, from counts of hashes alone."""
    chosen = contexts.join(shared_table(repeated_cores(contexts, length, gram, unit, across)), ["ah", "ctx"])

    def make():
        powers = Powers()

        def run(docs, marks, los, wholes, texts, ranges):
            for d, m, lo, whole, c, kept in zip(docs, marks, los, wholes, texts, ranges, strict=True):
                for g, first, last, _ in offset_ranges(c, length, gram, powers, unit):
                    if g in kept:
                        for x in range(first, last + 1):
                            yield *halves(xxhash.xxh3_128_intdigest(c[unit * x : unit * (x + length)])), d, m, lo, lo + x, whole

        return run

    ddl = "h1 bigint, h2 bigint, doc bigint, th bigint, lo int, start int, whole boolean"
    inputs = [F.col(c) for c in ("doc", "th", "lo", "whole", "context", "ranges")]
    starts = shared_table(map_rows(chosen, inputs, ddl, make))
    hit = starts.join(shared_table(classes(starts, "start", across)), ["h1", "h2"])
    hit = hit.filter(F.col("a") < F.struct("doc", "th", "start")) if keep_first else hit.filter("NOT whole")
    # a context has fewer starts than a string has bytes
    runs = hit.groupBy("doc", "th", "lo").agg(F.sort_array(F.collect_set("start")).alias("starts"))

    def join_up():
        def run(docs, marks, all_starts):
            for d, m, found in zip(docs, marks, all_starts, strict=True):
                x = np.asarray(found, np.int64)
                new = np.flatnonzero(np.r_[True, np.diff(x) > 1])
                for a, b in zip(x[new].tolist(), x[np.r_[new[1:] - 1, len(x) - 1]].tolist(), strict=True):
                    yield d, m, a, b + length

        return run

    return map_rows(runs, [F.col(c) for c in ("doc", "th", "starts")], "doc bigint, th bigint, start bigint, end bigint", join_up)


def repeated_ranges(docs: DataFrame, length: int, gram: int, share: int, keep_first: bool, words: int, word_gram: int) -> DataFrame:
    """``doc, th, ranges, passages``: of each keyed document, what repeated strings cover, in bytes, and what passages that
    another document holds too cover, in words."""
    ship_package(docs.sparkSession)
    occ = shared_table(occurrences(docs, [(length, gram, 1), (words, word_gram, WORD)]))
    told = shared_table(grouped(occ.filter("unit = 1").drop("unit"), share))
    worded = occ.filter(F.col("unit") == WORD).drop("unit")
    shared = shared_table(grouped(worded, 0, across=True))
    end = lambda n: (F.col("hi") + n).alias("end")
    # written, as large groups are read several times and the texts should be read once
    both = told.select("*", end(length), F.lit(1).alias("unit")).unionByName(shared.select("*", end(words), F.lit(WORD).alias("unit")))
    contexts = shared_table(shown_contexts(docs, both))

    found = ranges_of(told.filter("whole and not least" if keep_first else "whole"), end(length))
    of_bytes = contexts.filter("unit = 1")
    dealt = of_bytes.filter("NOT large").select("ah", "doc", "th", "lo", "whole", "context").repartition("ah").sortWithinPartitions("ah")
    found = found.unionByName(dealt.mapInArrow(suffix_step(length, keep_first), "doc bigint, th bigint, start bigint, end bigint"))
    if not of_bytes.filter("large").isEmpty():
        found = found.unionByName(large_groups(of_bytes.filter("large"), length, gram, keep_first))

    passages = ranges_of(shared.filter("whole"), end(words))
    passages = passages.unionByName(large_groups(contexts.filter(F.col("unit") == WORD), words, word_gram, unit=WORD, across=True))
    # rows that repeat hold all of each other, but are one document above
    copies = worded.groupBy("doc", "th").agg(F.count_if(F.col("lo") == 0).alias("n"), F.lit(0).alias("lo"), F.max("hi").alias("hi"))
    passages = passages.unionByName(ranges_of(copies.filter("n > 1"), end(words)))

    span = F.struct("start", "end")
    spans = found.select("*", F.lit(1).alias("unit")).unionByName(passages.select("*", F.lit(WORD).alias("unit")))
    return spans.groupBy("doc", "th").agg(
        F.collect_set(F.when(F.col("unit") == 1, span)).alias("ranges"), F.collect_set(F.when(F.col("unit") == WORD, span)).alias("passages")
    )


def ranges_of(rows: DataFrame, end: Column) -> DataFrame:
    return rows.select("doc", "th", F.col("lo").cast("long").alias("start"), end.cast("long").alias("end"))


def joined_up(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of what the ranges cover."""
    runs: list[list[int]] = []
    for a, b in sorted(ranges):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    return [(a, b) for a, b in runs]


def cut(raw: bytes, ranges: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], bytes]:
    """Maximal runs of covered bytes, and the bytes that are left."""
    runs = joined_up(ranges)
    edges = [0, *(x for r in runs for x in r), len(raw)]
    return runs, b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def without_repeats(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    length: int = LENGTH,
    gram: int = GRAM,
    share: int = SHARE,
    keep_first: bool = False,
    words: int = WORDS,
    word_gram: int = WORD_GRAM,
) -> DataFrame:
    """``doc_id, n_bytes, runs, kept_sha256, passages`` of every row: what repeated strings of ``length`` bytes cover.

    Every byte covered by a string that also starts elsewhere goes; with ``keep_first`` only what an earlier
    string repeats, in the order of ids, hashes of texts and positions. A null text reads as empty, texts shorter than
    ``length`` are untouched. Repeated rows are copies of each other: without ``keep_first`` both go, with it
    both stay, as nothing tells them apart. Null ids are kept.

    ``passages`` are the maximal runs of words, counted from 0, that passages of ``words`` words cover which another row holds
    too. They are told whatever their bytes, and nothing is removed for them.
    """
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.coalesce(F.col(doc_id).cast("long"), F.lit(0)).alias("doc"),
        F.xxhash64(text_column(text), F.isnull(doc_id)).alias("th"),
        text_column(text).alias("text"),
    )
    ranges = repeated_ranges(rows.select("doc", "th", "text"), length, gram, share, keep_first, words, word_gram)

    def make():
        pairs = lambda found: [(x["start"], x["end"]) for x in found or ()]
        spans = lambda runs: [{"start": a, "end": b} for a, b in runs]

        def run(ids, texts, found, passages):
            for i, t, r, p in zip(ids, texts, found, passages, strict=True):
                raw = t.encode("utf-8", "surrogatepass")
                runs, left = cut(raw, pairs(r))
                yield i, len(raw), spans(runs), hashlib.sha256(left).hexdigest(), spans(joined_up(pairs(p)))

        return run

    span = "array<struct<start:bigint,end:bigint>>"
    ddl = f"doc_id bigint, n_bytes bigint, runs {span}, kept_sha256 string, passages {span}"
    joined = rows.join(ranges, ["doc", "th"], "left")
    return map_rows(joined, [F.col(c) for c in ("doc_id", "text", "ranges", "passages")], ddl, make)


@doc_query("op4_suffix_repeats")
def op4(spark, directory):
    found = without_repeats(table(spark, directory, "documents"))
    covered = lambda runs: F.aggregate(runs, F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["start"])
    return found.select(
        "doc_id", "n_bytes", covered("runs").alias("n_removed"), F.size("runs").cast("long").alias("n_spans"), "kept_sha256",
        (F.size("runs") > 0).alias("has_repeats"),
        covered("passages").alias("n_passage_words"),
        (F.size("passages") > 0).alias("has_passages"),
    )
