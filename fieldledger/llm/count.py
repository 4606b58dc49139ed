"""Token counts from a tokenizer compiled to finite-state transducers.

Inside a pretoken the merge list is compiled to a deterministic transducer over bytes. A state is what the
rest of the pretoken needs to know: for each place from which some token of the vocabulary could still run on,
the node of the token trie reached from there, the last token of the encoding up to there, and how many more or
fewer tokens that encoding has than the one up to here. Reading a byte moves every such place along the trie;
among the tokens that end here exactly one may follow the encoding before it, and the transition is annotated
with the change of the count. A sequence of tokens is the encoding of its text exactly if each pair of
neighbours is the encoding of theirs, so pairs are all that has to be tried. States and transitions are
compiled when first met and kept for the worker's next documents.

Long texts are cut into chunks anywhere. What a chunk does is a state map that composes associatively: the
text before its first certain boundary and after its last one, and the tokens between. A boundary is certain
where white space follows something else: no pretoken runs across it, whatever comes before. The maps of a
text are composed by a balanced prefix scan, whose last entry is the map of the whole text.
"""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldledger.llm.merges import FOLDER, MergeList, byte_alphabet, load
from fieldledger.llm.registry import doc_query, table
from fieldledger.llm.rows import map_rows, text_column

FILE = "byte_bpe_50k.json"
LIMIT = 512
CHUNK = 1 << 15
#: Compiled transitions, and pretokens with their counts, that a worker keeps before it starts afresh.
MOST_TRANSITIONS, MOST_WORDS = 600_000, 1 << 19
# Fixed value: the tokenizer's pattern for pretokens.
PRETOKENS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
CERTAIN = regex.compile(r"(?<=\S)(?=\s)")
CERTAIN_LAST = regex.compile(r"(?r)(?<=\S)(?=\s)")


class Node:
    """A place in the trie of tokens."""

    __slots__ = ("next", "token")

    def __init__(self):
        self.next: dict[int, Node] = {}
        self.token: bytes | None = None


class Transducer:
    """Bytes of a pretoken to the number of its tokens."""

    def __init__(self, merges: MergeList):
        alphabet = byte_alphabet()
        self.merges, self.symbol = merges, alphabet
        value = {c: b for b, c in enumerate(alphabet)}
        self.root = Node()
        for t in merges.vocab:
            if len(t) == 1 or merges.merge(list(t)) == [t]:  # a token that its own text doesn't give never occurs
                node = self.root
                raw = bytes(value[c] for c in t)
                for b in raw:
                    node = node.next.setdefault(b, Node())
                node.token = raw
        self.follows: dict[tuple[bytes, bytes], bool] = {}
        self.reset()

    def reset(self) -> None:
        start = ((self.root, None, 0),)
        self.states = [start]
        self.number = {start: 0}
        self.moves: list[dict[int, tuple[int, int]]] = [{}]
        self.compiled = 0

    def may_follow(self, before: bytes | None, token: bytes) -> bool:
        if before is None:
            return True
        known = self.follows.get((before, token))
        if known is None:
            a, b = ("".join(self.symbol[c] for c in t) for t in (before, token))
            known = self.merges.merge([*a, *b]) == [a, b]
            if len(self.follows) >= MOST_TRANSITIONS:
                self.follows.clear()
            self.follows[before, token] = known
        return known

    def compile(self, state: int, byte: int) -> tuple[int, int]:
        open_, last, change = [], None, 0
        for node, before, ahead in self.states[state]:
            child = node.next.get(byte)
            if child is None:
                continue
            if child.token is not None and last is None and self.may_follow(before, child.token):
                last, change = child.token, ahead + 1
            if child.next:
                open_.append((child, before, ahead))
        after = (*((n, b, a - change) for n, b, a in open_), (self.root, last, 0))
        to = self.number.get(after)
        if to is None:
            to = self.number[after] = len(self.states)
            self.states.append(after)
            self.moves.append({})
        self.moves[state][byte] = move = (to, change)
        self.compiled += 1
        return move

    def count(self, pretoken: bytes) -> int:
        if self.compiled >= MOST_TRANSITIONS:
            self.reset()
        state = total = 0
        moves = self.moves
        for b in pretoken:
            move = moves[state].get(b)
            if move is None:
                move = self.compile(state, b)
            state = move[0]
            total += move[1]
        return total


class StateMap(NamedTuple):
    """What a stretch of text does to a count: ``tokens`` between its certain boundaries, and the open ends.

    Without a boundary (``cut`` false) the whole stretch is ``head``.
    """

    head: tuple[str, ...]
    tokens: int
    tail: tuple[str, ...]
    cut: bool


class Counter(dict):
    """Maps a pretoken to its number of tokens, remembering short ones."""

    def __init__(self, merges: MergeList):
        super().__init__()
        self.transducer = Transducer(merges)
        self.split = regex.compile("|".join(regex.escape(s) for s in sorted(merges.special, key=len, reverse=True)) or r"(?!)")

    def __missing__(self, pretoken: str) -> int:
        n = self.transducer.count(pretoken.encode("utf-8", "surrogatepass"))
        if len(pretoken) <= 64:
            if len(self) >= MOST_WORDS:
                self.clear()
            self[pretoken] = n
        return n

    def stretch(self, text: str) -> int:
        """Tokens of text that stands between certain boundaries or ends."""
        return sum(map(self.__getitem__, PRETOKENS.findall(text)))

    def state_map(self, chunk: str) -> StateMap:
        first = CERTAIN.search(chunk)
        if first is None:
            return StateMap((chunk,), 0, (), False)
        a, b = first.start(), CERTAIN_LAST.search(chunk).start()
        return StateMap((chunk[:a],), self.stretch(chunk[a:b]), (chunk[b:],), True)

    def compose(self, left: StateMap, right: StateMap) -> StateMap:
        if not left.cut:
            return StateMap(left.head + right.head, right.tokens, right.tail, right.cut)
        if not right.cut:
            return StateMap(left.head, left.tokens, left.tail + right.head, True)
        # white space at the junction may make a certain boundary of its own; the pretokens are the same
        between = self.stretch("".join(left.tail + right.head))
        return StateMap(left.head, left.tokens + between + right.tokens, right.tail, True)

    def scan(self, maps: list[StateMap]) -> StateMap:
        """The last entry of the prefix scan: neighbours are composed in rounds, as a balanced tree."""
        while len(maps) > 1:
            pairs = [self.compose(a, b) for a, b in zip(maps[::2], maps[1::2], strict=False)]
            maps = pairs + maps[len(pairs) * 2 :]
        return maps[0]

    def ordinary(self, text: str, chunk: int = CHUNK) -> int:
        if len(text) <= chunk:
            return self.stretch(text)
        whole = self.scan([self.state_map(text[i : i + chunk]) for i in range(0, len(text), chunk)])
        return self.stretch("".join(whole.head)) + whole.tokens + self.stretch("".join(whole.tail))

    def count(self, text: str, chunk: int = CHUNK) -> int:
        """Tokens of a text; a special token that stands in it counts one and ends what is before it."""
        at = total = 0
        for m in self.split.finditer(text):
            total += self.ordinary(text[at : m.start()], chunk) + 1
            at = m.end()
        return total + self.ordinary(text[at:] if at else text, chunk)


@lru_cache(maxsize=4)
def counter(name: str, folder: str) -> Counter:
    """Kept by each worker from task to task."""
    return Counter(load(name, folder))


def token_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", name: str = FILE, folder: str = FOLDER) -> DataFrame:
    """``doc_id, n_tokens`` of every row; a null or empty text has none. Repeated rows and null ids are kept."""

    def make():
        count = counter(name, folder).count

        def run(ids, sizes, texts):
            for i, size, t in zip(ids, sizes, texts, strict=True):
                yield i, size, count(t)

        return run

    inputs = [F.col(doc_id).cast("long"), F.octet_length(text_column(text)).cast("long"), text_column(text)]
    return map_rows(docs, inputs, "doc_id bigint, n_bytes bigint, n_tokens bigint", make)


@doc_query("op9_transducer_token_counts")
def op9(spark, directory):
    counted = token_counts(table(spark, directory, "documents"))
    return counted.withColumn("over_limit", F.col("n_tokens") > LIMIT)
