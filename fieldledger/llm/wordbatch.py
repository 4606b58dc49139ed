"""Token ids of whole texts, with the new words of many texts merged at once.

Texts are split at white space. Chunks seen before come from a bounded memory; all new words of a batch are merged
together in arrays: one row per word, one column per symbol, and in each round every row joins its pair of
least rank, leftmost first. The ids are those of ``bpe.Encoder``, which also takes the rare cases: long words
and texts with special tokens or separator controls.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import regex

from fieldledger.llm.bpe import WORDS, Encoder, text_blocks
from fieldledger.llm.merges import MergeList, load

#: Symbols of a word merged in arrays, words merged at a time, chunks remembered in each of two halves.
WIDTH, ROWS, MEMORY = 32, 1 << 12, 1 << 18
#: Characters gathered before their new words are merged.
GATHER = 1 << 20
# Fixed value: controls at which Python splits although the tokenizer's pattern does not.
CONTROLS = regex.compile("[\x1c-\x1f]")
# Marks of which one alone, after letters, is a word of its own.
PUNCTUATION = frozenset("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


class PairTable:
    """Ranks of pairs of token ids, and the id that a pair makes."""

    def __init__(self, merges: MergeList):
        vocab = merges.vocab
        self.size = max(vocab.values()) + 1
        # a pair listed twice has the rank of its last place, as in the dictionary of ranks
        pairs = np.array([(vocab[u] * self.size + vocab[v], r, vocab[u + v]) for (u, v), r in merges.ranks.items()], np.int64)
        pairs = pairs.reshape(-1, 3)
        order = np.argsort(pairs[:, 0])
        self.keys, self.ranks = pairs[order, 0], pairs[order, 1].astype(np.int32)
        self.none = np.int32(len(merges.ranks))
        self.made = np.zeros(len(merges.ranks) + 1, np.int32)
        self.made[pairs[:, 1]] = pairs[:, 2]

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; ``none`` where it is no merge or has no right side (-1)."""
        if not len(self.keys):
            return np.full(left.shape, self.none)
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (right >= 0), self.ranks[at], self.none)


def merge_rows(symbols: np.ndarray, table: PairTable, ranks: np.ndarray | None = None) -> np.ndarray:
    """Rows of symbol ids, filled up with -1, with all merges done; ``ranks`` of neighbours if they are known."""
    out = symbols.copy()
    width = symbols.shape[1]
    if width < 2:
        return out
    columns = np.arange(width - 1)
    rows = np.arange(len(symbols))
    s = symbols.copy()
    known = table.rank(s[:, :-1], s[:, 1:]) if ranks is None else ranks
    ranks = np.concatenate([known, np.full((len(s), 1), table.none)], axis=1)
    while True:
        best = ranks.min(axis=1)
        open_ = best < table.none
        if not open_.all():
            out[rows[~open_]] = s[~open_]
            s, ranks, rows, best = s[open_], ranks[open_], rows[open_], best[open_]
        if not len(rows):
            return out
        at = ranks.argmin(axis=1)
        here = np.arange(len(rows))
        # what is right of the pair moves one place to the left
        right_of = columns > at[:, None]
        for m in (s, ranks):
            m[:, :-1] = np.where(right_of, m[:, 1:], m[:, :-1])
        s[:, -1], ranks[:, -1] = -1, table.none
        s[here, at] = table.made[best]
        right = np.where(at + 1 < width, s[here, np.minimum(at + 1, width - 1)], -1)
        ranks[here, at] = table.rank(s[here, at], right)
        inner = here[at > 0]
        before = at[inner] - 1
        ranks[inner, before] = table.rank(s[inner, before], s[inner, at[inner]])


class BatchEncoder:
    """Blocks of ids of many texts."""

    def __init__(self, merges: MergeList):
        self.merges, self.table = merges, PairTable(merges)
        self.slow = Encoder(merges)
        alphabet = self.slow.alphabet
        # symbols of one byte, within a word and at its end, and the end of a row; ranks of their pairs
        self.bytes = np.array([merges.vocab.get(c + end, -1) for end in ("", merges.suffix) for c in alphabet] + [-1], np.int32)
        self.first = self.table.rank(*np.meshgrid(self.bytes, self.bytes, indexing="ij"))
        self.special = regex.compile("|".join(map(regex.escape, merges.special)) or r"(?!)")
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def words(self, words: list[str]) -> list[bytes]:
        """Ids of each word, as little-endian bytes. Words of similar size are merged together."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        order = np.argsort(size, kind="stable")
        out = [b""] * len(raw)
        short = int(np.searchsorted(size[order], WIDTH, "right"))
        for i in order[short:].tolist():
            out[i] = self.slow[words[i]]
        for at in range(0, short, ROWS):
            part = order[at : min(short, at + ROWS)]
            n = size[part]
            codes = np.full((len(part), int(n[-1])), 512, np.int32)
            codes[np.arange(codes.shape[1]) < n[:, None]] = np.frombuffer(b"".join(map(raw.__getitem__, part.tolist())), np.uint8)
            codes[np.arange(len(part)), n - 1] += 256
            merged = merge_rows(self.bytes[codes], self.table, self.first[codes[:, :-1], codes[:, 1:]])
            held = merged >= 0
            flat = merged[held].astype("<u4").tobytes()
            stop = (np.cumsum(held.sum(axis=1)) * 4).tolist()
            start = 0
            for i, b in zip(part.tolist(), stop, strict=True):
                out[i] = flat[start:b]
                start = b
        return out

    def learn(self, chunks: set[str]) -> None:
        """Bring chunks into the young half of the memory."""
        young, old = self.young, self.old
        if old:
            young.update((c, old[c]) for c in chunks.intersection(old))
            chunks = chunks.difference(young)
        fresh: set[str] = set()
        ended, mixed = [], []
        for c in chunks:
            if c.isalpha():
                fresh.add(c)
            elif c[-1] in PUNCTUATION and c[:-1].isalpha():
                ended.append((c, c[:-1], c[-1]))
            else:
                mixed.append((c, WORDS.findall(c)))
        fresh.update(w for _, *ws in ended for w in ws if w not in young)
        fresh.update(w for _, ws in mixed for w in ws if w not in young)
        listed = list(fresh)
        young.update(zip(listed, self.words(listed), strict=True))
        young.update((c, young[w] + young[mark]) for c, w, mark in ended)
        young.update((c, b"".join(map(young.__getitem__, ws))) for c, ws in mixed)

    def encode(self, texts: Iterable[str]) -> Iterator[tuple[int, bytes]]:
        """``(position of the text, block of its ids)``, in order; a text without tokens may have no block."""
        waiting: list[tuple[int, list[str], list]] = []
        size = 0
        for i, text in enumerate(texts):
            if self.special.search(text) or CONTROLS.search(text):
                yield from self.flush(waiting)
                size = 0
                yield from ((i, block) for block in self.slow.encode(text))
                continue
            for block in text_blocks(text):
                # one code point at a time is made small, so a final sigma is not told apart
                chunks = unicodedata.normalize("NFC", block).replace("Σ", "σ").lower().split()
                waiting.append((i, chunks, list(map(self.young.get, chunks))))
                size += len(block)
                if size >= GATHER:
                    yield from self.flush(waiting)
                    size = 0
        yield from self.flush(waiting)

    def flush(self, waiting: list) -> Iterator[tuple[int, bytes]]:
        """Fill in what is missing, and hand on what has waited."""
        holes = [[k for k, known in enumerate(ids) if known is None] for _, _, ids in waiting]
        if any(holes):
            self.learn({chunks[k] for (_, chunks, _), places in zip(waiting, holes, strict=True) for k in places})
        for (i, chunks, ids), places in zip(waiting, holes, strict=True):
            for k in places:
                ids[k] = self.young[chunks[k]]
            yield i, b"".join(ids)
        waiting.clear()
        if len(self.young) >= MEMORY:
            self.old, self.young = self.young, {}


@lru_cache(maxsize=2)
def batch_encoder(name: str, folder: str) -> BatchEncoder:
    """Kept by each worker from task to task."""
    return BatchEncoder(load(name, folder))
