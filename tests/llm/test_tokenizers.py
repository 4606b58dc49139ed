"""Encoding, decoding and counting against the tokenizers library."""

import hashlib
import random

import pytest
from tokenizers import Tokenizer

from llm_fixtures import docs_of  # noqa: F401

from fieldledger.llm import bpe, count, merges

ALPHABET = "abcdehinrst'’éÉßİΣςσ 漢字ñ́ \t\n\x1c\x1f\x85 ǅⅧ²½1٣_-<|>😀éKﬁ‍ͅ"
SPECIAL = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "  ", "\n", " a", "it's", "'S", "a" * 30, "-" * 70]


def samples(seed: int, n: int, vocab: list[str]):
    rnd = random.Random(seed)
    value = {c: b for b, c in enumerate(merges.byte_alphabet())}
    for i in range(n):
        kind = i % 4
        if kind == 0:
            yield "".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 60)))
        elif kind == 1:
            picked = (rnd.choice(vocab).replace("</w>", "") for _ in range(rnd.randint(1, 40)))
            yield b"".join(bytes(value[c] for c in t) for t in picked).decode("utf-8", "replace")
        elif kind == 2:
            yield "".join(rnd.choice("ainthe ") for _ in range(rnd.randint(1, 700)))
        else:
            yield "".join(rnd.choice(SPECIAL) for _ in range(rnd.randint(1, 9)))


@pytest.fixture(scope="module")
def word():
    return (*bpe.coders(bpe.FILE, ""), Tokenizer.from_file(merges.tokenizer_path(bpe.FILE)))


@pytest.fixture(scope="module")
def byte():
    return count.counter(count.FILE, ""), Tokenizer.from_file(merges.tokenizer_path(count.FILE))


def test_ids_and_decoded_text(word):
    encoder, decoder, library = word
    for text in samples(1, 600, list(encoder.merges.vocab)):
        want = library.encode(text, add_special_tokens=False).ids
        blocks = list(encoder.encode(text))
        assert bpe.ids_of(b"".join(blocks)).tolist() == want
        assert "".join(decoder.surfaces(blocks)) == library.decode(want, skip_special_tokens=False)


def test_stream_equals_whole_word(word):
    """With one symbol beyond the lookahead, tokens that left early are those of the whole word."""
    encoder = bpe.Encoder(word[0].merges, block=1)
    rnd = random.Random(2)
    vocab = [t.replace("</w>", "") for t in encoder.merges.vocab if t.isascii() and t.replace("</w>", "").isalpha()]
    for _ in range(60):
        symbols = list(encoder.symbols("".join(rnd.choice(vocab) for _ in range(60))))
        assert list(encoder.transduce(symbols)) == encoder.merges.merge(symbols)


def test_lookahead_of_small_lists():
    ranks = lambda *pairs: {p: i for i, p in enumerate(pairs)}
    one = merges.MergeList({}, ranks(("a", "b")), {}, "")
    assert one.lookahead() == 1
    # c can take b away from (a, b): the boundary before b hangs on two symbols
    two = merges.MergeList({}, ranks(("b", "c"), ("a", "b")), {}, "")
    assert two.lookahead() == 2
    assert two.merge(list("abc")) == ["a", "bc"]


def test_text_form_round_trip(word):
    encoder, decoder, _ = word
    text = "the river, a stone's throw: déjà vu 漢字 😀"
    again = "".join(decoder.text(encoder.encode(text)))
    assert again.replace(" ", "") == text.replace(" ", "").lower()
    assert "".join(decoder.text([bpe.little_endian(bpe.array("I", [encoder.merges.vocab["Ã"]]))])) == "�"


def test_counts(byte):
    counter, library = byte
    rnd = random.Random(3)
    for text in samples(4, 600, list(counter.transducer.merges.vocab)):
        want = len(library.encode(text, add_special_tokens=False).ids)
        assert counter.count(text) == want
        assert counter.count(text, chunk=rnd.randint(1, 20)) == want


def test_composition_is_associative(byte):
    counter, _ = byte
    text = "one  two\n three,  four 'll  five six\t\tseven eight nine"
    maps = [counter.state_map(text[i : i + 7]) for i in range(0, len(text), 7)]
    left = maps[0]
    for m in maps[1:]:
        left = counter.compose(left, m)
    right = maps[-1]
    for m in reversed(maps[:-1]):
        right = counter.compose(m, right)
    total = lambda m: counter.stretch("".join(m.head)) + m.tokens + counter.stretch("".join(m.tail))
    assert total(left) == total(right) == total(counter.scan(maps)) == counter.stretch(text)


def test_queries_against_library(spark, docs_of, word, byte):
    rows = [(i, t) for i, t in enumerate(samples(5, 60, list(word[0].merges.vocab)))] + [(900, "stone " * 20000)]
    coded = {r.doc_id: r for r in bpe.coded_digests(docs_of(rows)).collect()}
    counts = {r.doc_id: r for r in count.token_counts(docs_of(rows)).collect()}
    for i, t in rows:
        e = word[2].encode(t, add_special_tokens=False)
        raw = b"".join(x.to_bytes(4, "little") for x in e.ids)
        assert (coded[i].n_tokens, coded[i].ids_sha256) == (len(e.ids), hashlib.sha256(raw).hexdigest())
        assert coded[i].decoded_sha256 == hashlib.sha256(word[2].decode(e.ids, skip_special_tokens=False).encode()).hexdigest()
        assert counts[i].n_tokens == len(byte[1].encode(t, add_special_tokens=False).ids)
        assert counts[i].n_bytes == len(t.encode())


def test_encode_then_decode_tables(spark, docs_of):
    from pyspark.sql import functions as F

    coded = bpe.encode_documents(docs_of([(1, "The stone, the river"), (2, None)]), [F.col("doc_id")], "doc_id bigint")
    back = {r.doc_id: r.text for r in bpe.decode_documents(coded, [F.col("doc_id")], "doc_id bigint").collect()}
    assert back == {1: "the stone , the river ", 2: ""}
