"""Document fingerprints by consistent weighted sampling.

A document is a set of weighted terms: its word shingles and how often each occurs. For each of ``SAMPLES``
samples every term draws r and c from Gamma(2, 1) and b from the uniform distribution, all fixed by term and sample.
With weight w, t = floor(ln w / r + b) and ln a = ln c - r (t - b + 1); the term of least a, together with its t, is
the sample. Two documents agree in a sample with probability equal to their generalised Jaccard similarity, the
sum of lesser over the sum of greater weights.

The draws come from three exponential numbers of each term and sample, each from a mixed 64-bit hash. With x, y and z
these, c = x + y, r = z + ln(c / x) and b = z / r are independent and distributed as above, as a sum of two
exponential numbers is Gamma(2, 1) and independent of their shares in it. For weight 1, where t = 0, a = c e^(b r - r)
is x itself, so of the terms that occur once the least hash is taken, without a logarithm. A signature keeps 16 bits
of each sample, so unlike samples agree by chance once in 65,536 times.
"""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash

from fieldledger.llm.neighbours import with_next
from fieldledger.llm.registry import doc_query, table

WORDS, SAMPLES = 5, 64
#: Terms hashed at a time, and words whose hashes are remembered.
TERMS, MEMORY = 4096, 1 << 18
#: Factors of the further hashes of a term and sample, and of the bits that are kept.
SECOND, THIRD, KEPT = 0x94D049BB133111EB, 0xBF58476D1CE4E5B9, 0xD6E8FEB86659FD93


def uniform(n: int, stream: int) -> np.ndarray:
    """Fixed numbers in (0, 1) from a mixing of their index."""
    x = np.arange(1, n + 1, dtype=np.uint64) + np.uint64(stream << 32)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x += np.uint64(0x9E3779B97F4A7C15)
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


def mixed(x: np.ndarray, factor: int) -> np.ndarray:
    """Hashes mixed anew, one way for each odd factor."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(factor)
    return x ^ (x >> np.uint64(29))


def exponential(x: np.ndarray) -> np.ndarray:
    """Exponential numbers that grow with the hash."""
    return -np.log1p(-((x >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53)


def weighted_draws(x: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ln a and t of terms by the hash of term and sample and by weight."""
    one, two, three = exponential(x), exponential(mixed(x, SECOND)), exponential(mixed(x, THIRD))
    r = three + np.log1p(two / one)
    b = three / r
    t = np.floor(np.log(w) / r + b)
    return np.log(one + two) - r * (t - b + 1), t.astype(np.int64).astype(np.uint64)


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= MEMORY:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


class Sampler:
    def __init__(self, words: int = WORDS, samples: int = SAMPLES):
        self.words, self.samples = words, samples
        self.hashes = WordHashes()
        self.factors = (uniform(samples, 6) * 2.0**53).astype(np.uint64) << np.uint64(11) | np.uint64(1)
        self.powers = ((uniform(words, 7) * 2.0**53).astype(np.uint64) << np.uint64(11)) | np.uint64(1)

    def terms(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and weights of the shingles of lower-case words; of fewer words, the whole sequence."""
        w = np.array(list(map(self.hashes.__getitem__, text.lower().split())), np.uint64)
        size = min(self.words, len(w))
        if not size:
            return w, w
        h = np.full(len(w) - size + 1, size, np.uint64)
        for i in range(size):
            h += w[i : len(w) - size + 1 + i] * self.powers[i]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
        return np.unique(h ^ (h >> np.uint64(29)), return_counts=True)

    def drawn(self, terms: np.ndarray) -> np.ndarray:
        """The hash of each sample (rows) and term (columns)."""
        x = self.factors[:, None] * terms
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x9FB21C651E98DF25)
        return x

    def signature(self, text: str) -> np.ndarray | None:
        """One 16-bit number per sample; None for a text without words."""
        terms, weights = self.terms(text)
        if not len(terms):
            return None
        best = np.full(self.samples, np.inf)
        out = np.zeros(self.samples, np.uint16)
        row = np.arange(self.samples)

        def take(ln_a, x, t):
            nonlocal best, out
            better = ln_a < best
            best = np.where(better, ln_a, best)
            sample = mixed(x ^ (t * np.uint64(0x9E3779B97F4A7C15)), KEPT) & np.uint64(0xFFFF)
            out = np.where(better, sample.astype(np.uint16), out)

        once, many = weights == 1, np.flatnonzero(weights > 1)
        if len(many) < len(terms):
            # the least hash of each sample has the least a
            least = np.full(self.samples, np.iinfo(np.uint64).max, np.uint64)
            single = terms[once]
            for at in range(0, len(single), TERMS):
                least = np.minimum(least, self.drawn(single[at : at + TERMS]).min(1))
            take(np.log(exponential(least)), least, np.zeros(self.samples, np.uint64))
        for at in range(0, len(many), TERMS):
            p = many[at : at + TERMS]
            x = self.drawn(terms[p])
            ln_a, t = weighted_draws(x, weights[p])
            first = ln_a.argmin(1)
            take(ln_a[row, first], x[row, first], t[row, first])
        return out


def likeness(a: np.ndarray | None, b: np.ndarray | None) -> float:
    """Share of equal samples; texts without words are like each other and like nothing else."""
    if a is None or b is None:
        return float(a is b)
    return float((a == b).mean())


def hex_of(signature: np.ndarray | None, samples: int = SAMPLES) -> str:
    return (np.zeros(samples, np.uint16) if signature is None else signature).astype(">u2").tobytes().hex()


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as much of the following one's beginning."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint_pairs(docs, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, samples: int = SAMPLES):
    """Fingerprints of each document and of its edited text, and their likeness to each other and to the next one's.

    A null text reads as empty. Repeated rows and null ids are kept and have their place in the order; an
    empty table gives an empty result.
    """
    ddl = (
        "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )

    def make():
        signature = Sampler(words, samples).signature

        def pair(i, t, s, following, s_next):
            changed = edited(t, following)
            s_changed = signature(changed)
            digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
            return i, len(t), digest, hex_of(s, samples), hex_of(s_changed, samples), likeness(s, s_changed), likeness(s, s_next)

        return signature, pair

    return with_next(docs, doc_id, text, ddl, make)


@doc_query("op1_weighted_sampling_fingerprints")
def op1(spark, directory):
    return fingerprint_pairs(table(spark, directory, "documents"))
