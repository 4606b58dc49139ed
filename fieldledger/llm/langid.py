"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

Character n-grams of one to three are hashed to slots. Document frequencies are counted over all training
documents: each task adds up one vector of slots, the vectors are summed by slot. The regression is fitted with
follow-the-regularised-leader and elastic-net penalties on a bounded sample, per coordinate, so that slots that
never help keep a weight of exactly zero. A part of the sample that the regression has not seen sets the
temperature that divides its margins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldledger.llm.folds import HELD_OUT, fold, held_out, sampled_ids, sampled_texts
from fieldledger.llm.registry import doc_query, table
from fieldledger.llm.rows import edit_rows, map_rows, pieces, ship_package, text_column

UNKNOWN = "und"
SLOT_BITS = 15
SLOTS = 1 << SLOT_BITS
#: The bound of the sample: documents of each language, and bytes of all of them together.
PER_CLASS, SAMPLE_BYTES = 500, 32 << 20
EPOCHS, ALPHA, BETA, L1, L2 = 4, 0.5, 1.0, 0.02, 0.02
#: n-grams are counted in stretches of so many characters, so that a long text takes no more memory.
STRETCH = 1 << 18


def slot_counts(text: str) -> np.ndarray:
    """How often each slot's n-grams occur in the lower-case text with a space before and after."""
    total = np.zeros(SLOTS, np.int64)
    text = f" {text.lower()} "
    for at in range(0, len(text), STRETCH):
        # two characters more, for the n-grams that begin in this stretch
        c = np.frombuffer(text[at : at + STRETCH + 2].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        own = min(STRETCH, len(text) - at)
        h = c[:own]
        for n in (1, 2, 3):
            if n > 1:
                h = h[: max(0, len(c) - n + 1)] * np.uint64(0x100000001B3) + c[n - 1 : n - 1 + own][: len(h)]
            mixed = (h + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            total += np.bincount((mixed >> np.uint64(64 - SLOT_BITS)).astype(np.int64), minlength=SLOTS)
    return total


def weighted(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots and their TF-IDF values: logarithmic counts times idf, of length one."""
    n = slot_counts(text)
    at = np.flatnonzero(n)
    v = np.log1p(n[at]) * idf[at]
    return at, v / (np.sqrt(v @ v) or 1.0)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def document_frequencies(docs: DataFrame, text: Column) -> tuple[np.ndarray, int]:
    """In how many of the rows each slot occurs, and the number of rows: at most ``SLOTS`` sums reach the driver."""
    ship_package(docs.sparkSession)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, rows = np.zeros(SLOTS + 1, np.int64), 0
        for batch in batches:
            for piece in pieces(batch):
                for t in piece.column(0).to_pylist():
                    n[:SLOTS] += slot_counts(t) > 0
                    rows += 1
        n[SLOTS] = rows
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["slot", "n"])

    sums = docs.select(text.alias("t")).mapInArrow(partial, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n"))
    out = np.zeros(SLOTS + 1, np.int64)
    for r in sums.collect():
        out[r.slot] = r.n
    return out[:SLOTS], int(out[SLOTS])


def softmax(m: np.ndarray) -> np.ndarray:
    e = np.exp(m - m.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: list[int], classes: int) -> np.ndarray:
    """Weights by slot and class; the last slot is the constant."""
    z, g2 = np.zeros((SLOTS + 1, classes)), np.zeros((SLOTS + 1, classes))

    def current(at):
        zz = z[at]
        w = -(zz - np.sign(zz) * L1) / ((BETA + np.sqrt(g2[at])) / ALPHA + L2)
        return np.where(np.abs(zz) <= L1, 0.0, w)

    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)):
            at, v = rows[i]
            at, v = np.append(at, SLOTS), np.append(v, 1.0)
            w = current(at)
            p = softmax(v @ w)
            p[y[i]] -= 1
            g = v[:, None] * p
            sigma = (np.sqrt(g2[at] + g * g) - np.sqrt(g2[at])) / ALPHA
            z[at] += g - sigma * w
            g2[at] += g * g
    return current(np.arange(SLOTS + 1))


def temperature(margins: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the margins with the least mean log loss, by golden-section search over its logarithm."""
    if not len(y):
        return 1.0

    def loss(log_t):
        return -np.log(softmax(margins / np.exp(log_t))[np.arange(len(y)), y] + 1e-300).mean()

    a, b, r = -5.0, 3.0, (np.sqrt(5) - 1) / 2
    for _ in range(60):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def margins(self, text: str) -> np.ndarray:
        at, v = weighted(text, self.idf)
        return v @ self.weights[at] + self.weights[SLOTS]

    def predict(self, text: str) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        p = softmax(self.margins(text) / self.temperature)
        k = int(np.argmax(p))
        return self.languages[k], float(p[k])


def fit(sample: list[tuple[str, str]], frequencies: np.ndarray, n_docs: int) -> LanguageModel:
    idf = np.log((1 + n_docs) / (1 + frequencies)) + 1
    languages = sorted({lang for _, lang in sample})
    number = {lang: i for i, lang in enumerate(languages)}
    usable = [(t, lang) for t, lang in sample if has_letter(t)]
    if not usable:
        return LanguageModel([], idf, np.zeros((SLOTS + 1, 0)), 1.0)
    # every fifth document of the sample sets the temperature
    learn = [s for i, s in enumerate(usable) if i % 5 or len(usable) < 10]
    rest = [s for i, s in enumerate(usable) if not (i % 5 or len(usable) < 10)]
    w = ftrl([weighted(t, idf) for t, _ in learn], [number[lang] for _, lang in learn], len(languages))
    model = LanguageModel(languages, idf, w, 1.0)
    margins = np.array([model.margins(t) for t, _ in rest]).reshape(len(rest), len(languages))
    return LanguageModel(languages, idf, w, temperature(margins, np.array([number[lang] for _, lang in rest], int)))


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_class: int = PER_CLASS, sample_bytes: int = SAMPLE_BYTES) -> LanguageModel:
    """Learn from text and non-null language of the documents outside the held-out fold.

    Frequencies come from all of them, the weights from about ``per_class`` of each language and at most
    ``sample_bytes`` of text.
    """
    usable = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & (fold(doc_id) != HELD_OUT))
    frequencies, n = document_frequencies(usable, text_column(text))
    ids, _ = sampled_ids(usable, doc_id, lang, per_class)
    texts = usable.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("label"), text_column(text).alias("text"))
    # the ids are a sample of bounded size; label in the key keeps rows that share an id apart
    return fit(sampled_texts(texts.join(F.broadcast(ids.distinct()), ["doc_id", "label"]), sample_bytes), frequencies, n)


def languages(docs: DataFrame, model: LanguageModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` of every row; ``und`` with score 0 for a text that is null or has no letter.

    Without a learned language every row is ``und``. Repeated rows and null ids are kept.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        predict = sent.value.predict

        def run(ids, texts):
            for i, t in zip(ids, texts, strict=True):
                yield (i, *predict(t))

        return run

    return map_rows(docs, [F.col(doc_id).cast("long"), text_column(text)], "doc_id bigint, lang_pred string, score double", make)


def kept_languages(docs: DataFrame, model: LanguageModel, text: str = "text", least: float = 0.0) -> DataFrame:
    """The rows, with all their columns, whose text has a known language with at least the given score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        predict = sent.value.predict

        def known(text):
            lang, score = (UNKNOWN, 0.0) if text is None else predict(text)
            return lang != UNKNOWN and score >= least

        return lambda texts: [known(t) for t in texts]

    return edit_rows(docs, text, make, keep=True)


@doc_query("op3_ftrl_language_id")
def op3(spark, directory):
    docs = table(spark, directory, "documents")
    found = languages(docs, train(docs))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
