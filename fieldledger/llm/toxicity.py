"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text of a bounded labelled sample.
Each is trained on those parts of its class's words that consist of stretches of five bytes which the class has in
far more of its documents than the other, so that what both share tells nothing. A text is cut at spaces into windows, and each
is compressed with either dictionary; what the toxic one saves more is the window's distance. Both compressors
also know a fixed line that precedes every window: without it a short window that compresses by a byte or two
would be stored as it is and the difference lost.

A document's largest distances and its mean distance beyond several thresholds go into a logistic function,
fitted on a part of the sample that trained no dictionary. The threshold of the best F1 there becomes the
score 0.7.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldledger.llm.folds import held_out, sampled_ids, sampled_texts
from fieldledger.llm.registry import doc_query, table
from fieldledger.llm.rows import map_rows, text_column

#: The bound of the sample: documents of each class, and bytes of all of them together.
PER_CLASS, SAMPLE_BYTES = 3000, 48 << 20
WINDOW, GRAM, SLOTS = 40, 5, 1 << 20
LEAST_Z, MOST_RATIO = 5.0, 0.1
DICTIONARY = 4096
AT = 0.7
LEAD = b"#0123456789~@=QZXJKVWY#9876543210"
WINDOWS = re.compile(rb"(?s).{1,%d}(?= )|.{1,%d}" % (WINDOW, WINDOW))
WORD = re.compile(rb"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
#: Fixed-length features: largest distance, mean of the largest three, means beyond 0, 1 and 2 bytes, log of windows.
FEATURES = 6


def normal(text: str) -> bytes:
    return b" " + b" ".join(text.lower().encode("utf-8", "surrogatepass").split()) + b" "


def grams(raw: bytes) -> np.ndarray:
    """Slots of all stretches of ``GRAM`` bytes."""
    a = np.frombuffer(raw, np.uint8).astype(np.uint64)
    n = len(a) - GRAM + 1
    if n <= 0:
        return np.empty(0, np.int64)
    h = np.zeros(n, np.uint64)
    for i in range(GRAM):
        h = h * np.uint64(257) + a[i : i + n]
    return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)


def document_rates(texts: list[bytes]) -> np.ndarray:
    n = np.zeros(SLOTS)
    for t in texts:
        n[np.unique(grams(t))] += 1
    return n


def telling(own: np.ndarray, n_own: int, other: np.ndarray, n_other: int) -> np.ndarray:
    """Slots that the class has significantly, and many times, more often than the other."""
    p = (own + other + 1) / (n_own + n_other + 2)
    z = (own / n_own - other / n_other) / np.sqrt(p * (1 - p) * (1 / n_own + 1 / n_other))
    return (z > LEAST_Z) & (other / n_other < MOST_RATIO * own / n_own)


def telling_stretches(texts: list[bytes], slots: np.ndarray) -> list[bytes]:
    """Of every word, with the spaces around it, the part from its first to its last telling gram."""
    known: dict[bytes, bytes] = {}
    out = []
    for t in texts:
        for w in WORD.findall(t):
            part = known.get(w)
            if part is None:
                spaced = b" " + w + b" "
                at = np.flatnonzero(slots[grams(spaced)])
                part = known[w] = spaced[at[0] : at[-1] + GRAM] if len(at) else b""
            if part:
                out.append(part)
    return out


def dictionary(words: list[bytes]) -> bytes:
    """Content of a dictionary trained on the words; of too few to train on, the words themselves."""
    samples = [b"".join(words[i : i + 4]) for i in range(0, len(words), 4)]
    try:
        raw = zstandard.train_dictionary(DICTIONARY + 600, samples, k=16, d=6).as_bytes()
        return raw[-DICTIONARY:]
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(words))[:DICTIONARY]


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters(
        window_log=14,
        hash_log=13,
        chain_log=13,
        search_log=5,
        min_match=6,
        strategy=zstandard.STRATEGY_LAZY2,
        format=zstandard.FORMAT_ZSTD1_MAGICLESS,
        write_content_size=False,
        write_checksum=False,
        write_dict_id=False,
    )
    d = zstandard.ZstdCompressionDict(content + LEAD, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=d, compression_params=params)


class Distances:
    def __init__(self, toxic: bytes, ordinary: bytes):
        self.toxic, self.ordinary = compressor(toxic).compress, compressor(ordinary).compress

    def features(self, raw: bytes) -> np.ndarray:
        toxic, ordinary = self.toxic, self.ordinary
        d = np.array([len(ordinary(w)) - len(toxic(w)) for w in (LEAD + x + b" " for x in WINDOWS.findall(raw))], float)
        if not len(d):
            return np.zeros(FEATURES)
        top = np.sort(d)[-3:]
        beyond = [np.maximum(d - k, 0).mean() for k in range(3)]
        return np.array([max(0.0, top[-1]), max(0.0, top.mean()), *np.log1p(8 * np.array(beyond)), np.log1p(len(d))])


@dataclass(frozen=True)
class ToxicModel:
    """Dictionaries, the logistic function of the features, and the shift that puts its best threshold at 0.7."""

    toxic: bytes
    ordinary: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    shift: float

    def scorer(self):
        distances = Distances(self.toxic, self.ordinary)

        def score(text: str) -> float:
            x = (distances.features(normal(text)) - self.mean) / self.scale
            return float(1 / (1 + np.exp(-np.clip(self.weights[0] + x @ self.weights[1:] + self.shift, -40, 40))))

        return score


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weighted, ridge-penalised logistic weights by Newton's method, constant first."""
    a = np.hstack([np.ones((len(x), 1)), x])
    beta = np.zeros(a.shape[1])
    penalty = np.diag([1e-6] + [ridge] * x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        g = a.T @ (w * (y - p)) - penalty @ beta
        h = (a * (w * p * (1 - p))[:, None]).T @ a + penalty
        step = np.linalg.solve(h, g)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def best_threshold(margin: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """The margin with the best weighted F1, half-way down to the next lower one."""
    order = np.argsort(-margin, kind="stable")
    m, hit, all_ = margin[order], np.cumsum((w * y)[order]), np.cumsum(w[order])
    f1 = 2 * hit / (all_ + (w * y).sum())
    f1[:-1][m[:-1] == m[1:]] = -1
    k = int(np.argmax(f1))
    return float((m[k] + m[min(k + 1, len(m) - 1)]) / 2)


def fit(sample: list[tuple[str, int]], counts: dict) -> ToxicModel | None:
    """None if the sample lacks one of the classes."""
    by = {c: [normal(t) for t, label in sample if label == c] for c in (0, 1)}
    if min(map(len, by.values())) < 2:
        return None
    cut = {c: max(1, len(v) * 3 // 5) for c, v in by.items()}
    learn = {c: v[: cut[c]] for c, v in by.items()}
    rates = {c: document_rates(v) for c, v in learn.items()}
    content = {}
    for c in (0, 1):
        slots = telling(rates[c], len(learn[c]), rates[1 - c], len(learn[1 - c]))
        content[c] = dictionary(telling_stretches(learn[c], slots))
    distances = Distances(content[1], content[0])
    rest = [(t, c) for c in (0, 1) for t in by[c][cut[c] :]]
    x = np.array([distances.features(t) for t, _ in rest])
    y = np.array([c for _, c in rest], float)
    share = {c: counts[c] / sum(counts.values()) for c in (0, 1)}
    w = np.array([share[c] / max(1, len(by[c]) - cut[c]) for _, c in rest]) * len(rest)
    mean, scale = x.mean(0), x.std(0) + 1e-9
    weights = logistic((x - mean) / scale, y, w)
    margin = weights[0] + ((x - mean) / scale) @ weights[1:]
    shift = float(np.log(AT / (1 - AT))) - best_threshold(margin, y, w)
    return ToxicModel(content[1], content[0], mean, scale, weights, shift)


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", per_class: int = PER_CLASS, sample_bytes: int = SAMPLE_BYTES) -> ToxicModel | None:
    """Fit on at most about ``per_class`` labelled documents of each class and ``sample_bytes`` of text."""
    ids, counts = sampled_ids(labels, doc_id, label, per_class)
    texts = docs.select(F.col(doc_id).alias("doc_id"), text_column(text).alias("text"))
    # the ids are a sample of bounded size
    return fit(sampled_texts(texts.join(F.broadcast(ids), "doc_id"), sample_bytes), counts)


def toxicity(docs: DataFrame, model: ToxicModel | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, score`` of every row: 0 to 1, 0 everywhere without a model. A null text reads as empty.

    Repeated rows and null ids are kept.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        score = sent.value.scorer() if sent.value else lambda _: 0.0

        def run(ids: Iterable, texts: Iterable[str]):
            for i, t in zip(ids, texts, strict=True):
                yield i, score(t)

        return run

    return map_rows(docs, [F.col(doc_id).cast("long"), text_column(text)], "doc_id bigint, score double", make)


@doc_query("op5_compression_toxicity")
def op5(spark, directory):
    docs = table(spark, directory, "documents")
    scored = toxicity(docs, train(docs, table(spark, directory, "labels")))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= AT).cast("int").alias("predicted"))
