"""Secret scans with a trigram index.

From the parsed form of each rule's regular expression a Boolean query over trigrams is derived: literal
stretches must contribute all their trigrams, alternatives are or-ed, and whatever may match anything
contributes nothing. A block of documents is indexed by the trigrams that some rule asks for (folded to small
ASCII letters), each rule's postings are intersected and united as its query says, and the rule's expression
runs over the candidates alone. A rule whose query holds for every text runs over the whole block.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from itertools import product
from re import _constants as C
from re import _parser

import numpy as np
from pyspark.sql import DataFrame

from fieldledger.llm.registry import doc_query, table
from fieldledger.llm.spans import Span, mask_column, span_digest, span_table


@dataclass(frozen=True)
class Rule:
    """``least`` characters are asked of ``group``; matches with fewer are dropped."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0


BASE = ["assign", "access", "hex"]
PEM_NAME = r"(?:[A-Z]+ ){0,3}PRIVATE KEY-----"
# ends of lines may be written out as in string literals; headers stand in encrypted keys
PEM_BREAK = r"[\x20\t]*+(?:[\r\n]|\\[rn])(?:\s|\\[rnt])*+"
PEM_HEADER = r"[A-Z][A-Za-z]*+-[A-Z][A-Za-z]*+:(?:(?!-----|\\[rn])[^\r\n])*+"
# The base rules, then public formats of other keys.
RULES = [
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    # runs of 32 and more are what is left of all runs once the shorter ones are dropped
    Rule("hex", r"[0-9a-f]{32,}"),
    # up to the END line if nothing but base64, blanks and header lines comes before it, or else the base64 lines alone
    Rule("pem", rf"-----BEGIN {PEM_NAME}(?:(?:{PEM_BREAK}{PEM_HEADER}|\s|\\[rnt]|[A-Za-z0-9+/=])*+-----END {PEM_NAME}|(?:{PEM_BREAK}(?:{PEM_HEADER}|[A-Za-z0-9+/=]++(?=[\x20\t]*+(?:[\r\n]|\\[rn]|\Z))))*+)"),
    Rule("forge", r"gh[opsu]_[A-Za-z0-9]{36}"),
    Rule("chat", r"xox[abp]-[A-Za-z0-9-]{10,}"),
    Rule("cloud", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
]
MASK = "<redacted>"

#: Strings of a literal stretch are listed up to so many alternatives; beyond, the stretch ends there.
MOST_STRINGS = 64

# A query is True (any text), a trigram, or ("and" | "or", parts).


def both(parts: list):
    parts = list(dict.fromkeys(p for p in parts if p is not True))
    return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def either(parts: list):
    parts = list(dict.fromkeys(parts))
    return True if not parts or True in parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def string_query(s: str):
    return both([s[i : i + 3] for i in range(len(s) - 2)])


def trigram_query(pattern: str):
    """The query that every text with a match satisfies, over ASCII-folded trigrams."""
    strings, query = _walk(_parser.parse(pattern, re.ASCII))
    return both([query, either([string_query(s) for s in strings])] if strings is not None else [query])


def _walk(seq):
    """(strings, query): all strings the sequence can match, or None if they are not listed, and a needed query."""
    run, whole, needed = {""}, True, []

    def close():
        nonlocal run, whole
        needed.append(either([string_query(s) for s in run]))
        run, whole = {""}, False

    for op, arg in seq:
        strings, query = _element(op, arg)
        needed.append(query)
        if strings is not None and len(run) * len(strings) <= MOST_STRINGS:
            run = {a + b for a, b in product(run, strings)}
        elif strings is not None and len(strings) <= MOST_STRINGS:
            close()
            run = strings
        else:
            close()
    if whole:
        return run, both(needed)
    close()
    return None, both(needed)


def _element(op, arg):
    if op is C.LITERAL:
        # only what ASCII folding of the text can produce is a usable letter
        return ({chr(arg).lower()}, True) if arg < 0x80 else (None, True)
    if op is C.IN:
        chars: set[str] = set()
        for kind, x in arg:
            if kind is C.LITERAL and x < 0x80:
                chars.add(chr(x).lower())
            elif kind is C.RANGE and x[1] < 0x80:
                chars |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return None, True
        return (chars, True) if len(chars) <= 6 else (None, True)
    if op is C.SUBPATTERN:
        return _walk(arg[-1])
    if op is C.BRANCH:
        parts = [_walk(branch) for branch in arg[1]]
        if all(s is not None for s, _ in parts):
            return set().union(*(s for s, _ in parts)), either([q for _, q in parts])
        return None, either([both([q, either([string_query(s) for s in strings])]) if strings is not None else q for strings, q in parts])
    if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
        low, high, inner = arg
        strings, query = _walk(inner)
        if low == 0:
            return ({"", *strings}, True) if high == 1 and strings is not None else (None, True)
        if low == high == 1:
            return strings, query
        return None, both([query, either([string_query(s) for s in strings])]) if strings is not None else query
    if op is C.AT:
        return {""}, True
    return None, True


def query_trigrams(query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*(query_trigrams(p) for p in query[1]))


class TrigramScan:
    """Compiled rules; ``find`` indexes a block of texts and verifies the candidates of each rule."""

    def __init__(self, rules: list[Rule]):
        self.rules = [(r, re.compile(r.pattern, re.ASCII), trigram_query(r.pattern)) for r in rules]
        wanted = sorted(set().union(*(query_trigrams(q) for _, _, q in self.rules)))
        if len(wanted) > 65_000:
            raise ValueError("the rules ask for more than 65,000 trigrams; scan with fewer rules at a time")
        self.number = {t: i + 1 for i, t in enumerate(wanted)}
        self.slot = np.zeros(1 << 24, np.uint16)
        for t, i in self.number.items():
            self.slot[int.from_bytes(t.encode("ascii"), "big")] = i

    def postings(self, texts: list[str]) -> dict[int, np.ndarray]:
        """Ascending numbers of the texts that hold each trigram asked for."""
        # two zero bytes between texts: no trigram asked for spans them
        coded = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
        starts = np.cumsum([0] + [len(c) + 2 for c in coded])[:-1]
        a = np.frombuffer(b"\0\0".join(coded), np.uint8).astype(np.uint32)
        if len(a) < 3:
            return {}
        slots = self.slot[a[:-2] << 16 | a[1:-1] << 8 | a[2:]]
        at = np.flatnonzero(slots)
        pairs = np.unique(slots[at].astype(np.int64) << 32 | (np.searchsorted(starts, at, "right") - 1))
        keys, first = np.unique(pairs >> 32, return_index=True)
        return dict(zip(keys.tolist(), np.split(pairs & 0xFFFFFFFF, first[1:]), strict=True))

    def candidates(self, query, index: dict[int, np.ndarray], n: int) -> np.ndarray:
        if query is True:
            return np.arange(n)
        if isinstance(query, str):
            return index.get(self.number[query], np.empty(0, np.int64))
        parts = [self.candidates(p, index, n) for p in query[1]]
        out = parts[0]
        for p in parts[1:]:
            out = np.intersect1d(out, p, assume_unique=True) if query[0] == "and" else np.union1d(out, p)
        return out

    def find(self, texts: list[str]) -> Iterable[list[Span]]:
        found: list[list[Span]] = [[] for _ in texts]
        index = self.postings(texts)
        for order, (rule, expression, query) in enumerate(self.rules):
            for d in self.candidates(query, index, len(texts)).tolist():
                for m in expression.finditer(texts[d]):
                    a, b = m.span(rule.group)
                    if b - a >= rule.least:
                        found[d].append((m.start(), order, m.end()))
        for spans in found:
            yield [(self.rules[order][0].kind, a, b, 1.0) for a, order, b in sorted(spans)]


def scanner(rules: list[Rule]):
    return lambda: TrigramScan(rules).find


def secret_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """``doc_id, spans`` with offsets in code points, by start and then in the order of the rules.

    Rows are kept one for one, repeated rows and null ids too; a null or empty text has no spans.
    """
    return span_table(docs, doc_id, text, scanner(rules or RULES))


def mask_secrets(docs: DataFrame, text: str = "text", rules: list[Rule] | None = None, mask: str = MASK) -> DataFrame:
    """All rows and columns, with every secret in the text replaced by the mask; a null text stays null."""
    return mask_column(docs, text, scanner(rules or RULES), mask)


@doc_query("op8_trigram_secrets")
def op8(spark, directory):
    return span_digest(secret_spans(table(spark, directory, "documents")), BASE)
