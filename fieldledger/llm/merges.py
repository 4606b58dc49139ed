"""Merge lists of public byte-pair tokenizers: files, byte alphabet, merging, sufficient lookahead."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass

#: Where the vocabulary files of public tokenizers are; the argument ``folder`` of ``load`` overrides it.
FOLDER = os.environ.get("PUBLIC_TOKENIZERS", "")


def tokenizer_path(name: str, folder: str = FOLDER) -> str:
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies.

    Printable Latin-1 bytes stand for themselves, the others take the characters from U+0100 on, in order.
    """
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


@dataclass
class MergeList:
    vocab: dict[str, int]
    ranks: dict[tuple[str, str], int]
    special: dict[str, int]
    suffix: str
    """What the last symbol of a word carries, or empty."""

    def merge(self, symbols: list[str]) -> list[str]:
        """Tokens of a symbol sequence: the pair of least rank, leftmost first, is joined until none is left."""
        ranks, parts = self.ranks, list(symbols)
        none = len(ranks)
        scores = [ranks.get(p, none) for p in zip(parts, parts[1:], strict=False)]
        while scores:
            best = min(scores)
            if best == none:
                break
            i = scores.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del scores[i]
            if i:
                scores[i - 1] = ranks.get((parts[i - 1], parts[i]), none)
            if i < len(scores):
                scores[i] = ranks.get((parts[i], parts[i + 1]), none)
        return parts

    def lookahead(self) -> int:
        """Symbols beyond a place that can still decide whether a token boundary lies there.

        A boundary after symbol j of a prefix's tokens is final once so many more symbols are known. Text to the
        right decides a merge (u, v) only by an earlier merge (w, x) that takes v, or a right-hand part w of v,
        away; and whether that one happens depends in turn on what can take x away earlier still. Ranks fall
        along such a chain, so its greatest reach follows in one pass over the list in rank order:

        * ``taken[w]``: reach of the merges so far that have w on their left,
        * ``inner[t]``: reach of those that could take a right-hand part of t before t was made.
        """
        size = lambda t: len(t) - len(self.suffix) * bool(self.suffix and t.endswith(self.suffix))
        taken: dict[str, int] = {}
        inner: dict[str, int] = {}
        most = 0
        for u, v in self.ranks:
            right = max(taken.get(v, 0), inner.get(v, 0))
            reach = size(v) + right
            made = u + v
            inner[made] = max(inner.get(made, 0), right)
            taken[u] = max(taken.get(u, 0), reach)
            most = max(most, reach)
        return most


def load(name: str, folder: str = FOLDER) -> MergeList:
    with open(tokenizer_path(name, folder), encoding="utf-8") as f:
        raw = json.load(f)
    model = raw["model"]
    pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    return MergeList(
        vocab=model["vocab"],
        ranks={p: i for i, p in enumerate(pairs)},
        special={t["content"]: t["id"] for t in raw["added_tokens"]},
        suffix=model.get("end_of_word_suffix") or "",
    )
