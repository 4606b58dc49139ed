"""BPE encoding and decoding as streams.

Encoding is a transducer with bounded lookahead. The lookahead that suffices is computed from the merge list
(``MergeList.lookahead``). Symbols of a word enter a buffer; as soon as it holds a block more than the
lookahead, it is merged, and the tokens that end at least the lookahead before its end are final and leave it.
Nothing that comes later can change them, and what follows a token boundary merges as if it stood alone. So
the state is one buffer of fixed size, however long the word. Texts are read in blocks cut before white space.

Decoding feeds token ids to a state machine that holds at most the bytes of one unfinished character.
"""

from __future__ import annotations

import codecs
import hashlib
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldledger.llm.merges import FOLDER, MergeList, byte_alphabet, load
from fieldledger.llm.registry import doc_query, table
from fieldledger.llm.rows import map_rows, text_column

FILE = "word_bpe_49k.json"
#: Symbols merged at a time beyond the lookahead, characters of text normalised at a time, words remembered.
BLOCK, TEXT_BLOCK, MEMORY = 64, 1 << 16, 1 << 18
# Fixed value: the tokenizer's pattern for words, over lower-case text.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
SPACE = regex.compile(r"\s")


def text_blocks(text: str, size: int = TEXT_BLOCK) -> Iterator[str]:
    """Consecutive stretches of the text, each but the last cut before the first white space after ``size``."""
    start = 0
    while len(text) - start > size:
        m = SPACE.search(text, start + size)
        if not m:
            break
        yield text[start : m.start()]
        start = m.start()
    yield text[start:]


class Encoder(dict):
    """Maps a word to the ids of its tokens as little-endian unsigned 32-bit integers, remembering words."""

    def __init__(self, merges: MergeList, block: int = BLOCK):
        super().__init__()
        self.merges, self.block, self.ahead = merges, block, merges.lookahead()
        self.alphabet = byte_alphabet()
        self.split = regex.compile("|".join(regex.escape(s) for s in sorted(merges.special, key=len, reverse=True)) or r"(?!)")

    def symbols(self, word: str) -> Iterator[str]:
        """One symbol per byte; the last one carries the suffix."""
        last = ""
        for b in word.encode("utf-8", "surrogatepass"):
            if last:
                yield last
            last = self.alphabet[b]
        if last:
            yield last + self.merges.suffix

    def transduce(self, symbols: Iterable[str]) -> Iterator[str]:
        """Tokens of a stream of symbols, each as soon as it is final."""
        buffer: list[str] = []
        full = self.block + self.ahead
        for s in symbols:
            buffer.append(s)
            if len(buffer) >= full:
                at, final = 0, 0
                tokens = self.merges.merge(buffer)
                for t in tokens:
                    at += len(t)  # no suffix yet: a symbol is one character
                    if at > len(buffer) - self.ahead:
                        break
                    final = at
                    yield t
                del buffer[:final]
                if len(buffer) >= full:
                    full = len(buffer) + self.block  # one token longer than the block: wait for more
                else:
                    full = self.block + self.ahead
        yield from self.merges.merge(buffer)

    def __missing__(self, word: str) -> bytes:
        ids = array("I", [self.merges.vocab[t] for t in self.transduce(self.symbols(word))])
        out = little_endian(ids)
        if len(word) <= 64:
            if len(self) >= MEMORY:
                self.clear()
            self[word] = out
        return out

    def encode(self, text: str) -> Iterator[bytes]:
        """Blocks of ids; special tokens in the text are found first, as they stand."""
        at = 0
        for m in self.split.finditer(text):
            yield from self.ordinary(text[at : m.start()])
            yield little_endian(array("I", [self.merges.special[m.group()]]))
            at = m.end()
        yield from self.ordinary(text[at:] if at else text)

    def ordinary(self, text: str) -> Iterator[bytes]:
        for block in text_blocks(text):
            # one code point at a time is made small, so a final sigma is not told apart
            folded = unicodedata.normalize("NFC", block).replace("Σ", "σ").lower()
            yield b"".join(map(self.__getitem__, WORDS.findall(folded)))


def little_endian(ids: array) -> bytes:
    if ids.itemsize != 4:
        raise ValueError("unsigned int has not four bytes here")
    if array("H", [1]).tobytes() == b"\0\1":
        ids.byteswap()
    return ids.tobytes()


def ids_of(block: bytes) -> array:
    ids = array("I")
    ids.frombytes(block)
    if array("H", [1]).tobytes() == b"\0\1":
        ids.byteswap()
    return ids


class Decoder:
    """Ids to text, block by block.

    ``surfaces``: the tokens as the vocabulary spells them, with a space between; this is what the file itself
    defines, as it names no decoder. ``text``: the bytes the tokens stand for, word ends as spaces, through
    an incremental UTF-8 machine whose state is the bytes of one unfinished character; bytes that are no
    UTF-8 become U+FFFD.
    """

    def __init__(self, merges: MergeList):
        names = {i: t for t, i in merges.vocab.items()} | {i: t for t, i in merges.special.items()}
        value = {c: b for b, c in enumerate(byte_alphabet())}
        special = set(merges.special.values())
        self.names = names
        self.bytes = {}
        for i, t in names.items():
            end = bool(merges.suffix) and t.endswith(merges.suffix)
            body = t[: -len(merges.suffix)] if end else t
            self.bytes[i] = t.encode() if i in special else bytes(value[c] for c in body) + b" " * end

    def surfaces(self, blocks: Iterable[bytes]) -> Iterator[str]:
        first = True
        for block in blocks:
            if block:
                yield ("" if first else " ") + " ".join(map(self.names.__getitem__, ids_of(block)))
                first = False

    def text(self, blocks: Iterable[bytes]) -> Iterator[str]:
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for block in blocks:
            yield machine.decode(b"".join(map(self.bytes.__getitem__, ids_of(block))))
        yield machine.decode(b"", True)


@lru_cache(maxsize=4)
def coders(name: str, folder: str) -> tuple[Encoder, Decoder]:
    """Kept by each worker from task to task."""
    merges = load(name, folder)
    return Encoder(merges), Decoder(merges)


def encode_documents(docs: DataFrame, keep: list[Column], ddl: str, text: str = "text", name: str = FILE, folder: str = FOLDER) -> DataFrame:
    """Token ids of whole texts: the ``keep`` columns (typed by ``ddl``), ``n_tokens``, ``token_ids``.

    A null or empty text has no tokens. Rows are kept one for one.
    """

    def make():
        encoder, _ = coders(name, folder)

        def run(texts, *kept):
            for t, *row in zip(texts, *kept, strict=True):
                ids = ids_of(b"".join(encoder.encode(t)))
                yield *row, len(ids), ids.tolist()

        return run

    return map_rows(docs, [text_column(text), *keep], f"{ddl}, n_tokens bigint, token_ids array<int>", make)


def decode_documents(coded: DataFrame, keep: list[Column], ddl: str, ids: str = "token_ids", form: str = "text", name: str = FILE, folder: str = FOLDER) -> DataFrame:
    """The ``keep`` columns and ``text`` decoded from arrays of ids; null ids decode to an empty text."""

    def make():
        _, decoder = coders(name, folder)
        decode = decoder.text if form == "text" else decoder.surfaces

        def run(lists, *kept):
            for x, *row in zip(lists, *kept, strict=True):
                yield *row, "".join(decode([little_endian(array("I", x or []))]))

        return run

    return map_rows(coded, [F.col(ids), *keep], f"{ddl}, text string", make)


def coded_digests(
    docs: DataFrame,
    keep: list[Column] | None = None,
    ddl: str = "doc_id bigint",
    text: str = "text",
    with_ids: bool = False,
    name: str = FILE,
    folder: str = FOLDER,
) -> DataFrame:
    """Encode and decode in one pass, block by block.

    The ``keep`` columns (the id, unless given; typed by ``ddl``), ``n_tokens``, ``ids_sha256`` over the ids as
    little-endian unsigned 32-bit integers, ``decoded_sha256`` over the decoded text, and ``token_ids`` if asked
    for. A null text reads as empty. Rows are kept one for one, repeated rows and null ids too.
    """

    def make():
        encoder, decoder = coders(name, folder)

        def run(texts, *kept):
            for t, *row in zip(texts, *kept, strict=True):
                coded, plain, ids, n = hashlib.sha256(), hashlib.sha256(), array("I"), 0

                def passing(blocks, coded=coded, ids=ids):
                    nonlocal n
                    for block in blocks:
                        n += len(block) // 4
                        coded.update(block)
                        if with_ids:
                            ids.extend(ids_of(block))
                        yield block

                for part in decoder.surfaces(passing(encoder.encode(t))):
                    plain.update(part.encode())
                out = (*row, n, coded.hexdigest(), plain.hexdigest())
                yield (*out, ids.tolist()) if with_ids else out

        return run

    columns = keep or [F.col("doc_id").cast("long")]
    ddl = f"{ddl}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * with_ids
    return map_rows(docs, [text_column(text), *columns], ddl, make)


@doc_query("op2_streaming_bpe")
def op2(spark, directory):
    return coded_digests(table(spark, directory, "documents"))
