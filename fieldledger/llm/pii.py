"""Personal data: expressions propose spans, checksums confirm them, words nearby adjust their score.

The four base kinds (email, ip, card, phone) are reported whenever their own test holds, whatever the score.
So is iban, whose checksum decides. The further kind ssn needs a score of ``LEAST`` from context. All scans are
linear in the text: no expression is retried from the middle of a run that it has already passed over, but for
iban, which looks at no more than 34 letters and digits from each start.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame

from fieldledger.llm.registry import doc_query, table
from fieldledger.llm.spans import Span, span_digest, span_table

BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "iban", "ssn"]
LEAST = 0.6
NEAR = 48
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# whole digit runs are passed over at once, so that a long one is read once
QUAD = re.compile(r"[0-9]++(\.[0-9]++\.[0-9]++\.[0-9]++)?")
CHAIN = re.compile(r"[0-9](?:[\x20-]?[0-9])*+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}")
IBAN_REST = re.compile(r"(?:\x20?[A-Z0-9])*+")
WORD_END = re.compile(r"(?![A-Za-z0-9])")
IBAN_LEAST, IBAN_MOST = 15, 34
# Characters of a number by country, from the public registry.
IBAN_LENGTHS = {
    country: n
    for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
        25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
        29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}
SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
DIGIT = re.compile(r"[0-9]")
# Words whose nearness makes a kind likelier, or a plain number; whole words, with or without a plural s.
CONTEXT = {
    "email": ("mail", "email", "contact", "write"),
    "ip": ("ip", "server", "host", "address"),
    "card": ("card", "visa", "credit", "payment", "karte", "carte", "tarjeta"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security"),
}
AGAINST = ("order", "invoice", "version", "isbn", "part no", "serial")


def any_of(words: tuple[str, ...]) -> re.Pattern:
    return re.compile(rf"(?<![^\W_])(?:{'|'.join(words)})s?(?![^\W_])")


FOR = {kind: any_of(words) for kind, words in CONTEXT.items()}
NOT = any_of(AGAINST)
LAST_PART, FIRST_PART = re.compile(r"[^\W_]+\Z"), re.compile(r"[^\W_]+")
# Score without any word nearby.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.4}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """The check of ISO 7064: country and check digits moved to the end, letters as 10 to 35."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterable[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def ibans(text: str) -> Iterable[tuple[int, int]]:
    """From each start the longest end that the country allows, or any word's end for unknown ones, with a right checksum."""
    done = 0
    for m in IBAN.finditer(text):
        start = m.start()
        if start < done:
            continue
        # with a space before each character a number takes twice its length at most
        stop = IBAN_REST.match(text, m.end(), m.end() + 2 * (IBAN_MOST - 4)).end()
        known = IBAN_LENGTHS.get(text[start : start + 2])
        least, most = (known, known) if known else (IBAN_LEAST, IBAN_MOST)
        # mod97 of all ends in one pass: the first four characters, six digits of its number, come last
        head, rest, n, end = int("".join(str(int(c, 36)) for c in m.group())), 0, 4, 0
        for i in range(m.end(), stop):
            if text[i] != " ":
                digit = int(text[i], 36)
                rest, n = (rest * (10 if digit < 10 else 100) + digit) % 97, n + 1
                if least <= n <= most and (rest * 10**6 + head) % 97 == 1 and WORD_END.match(text, i + 1):
                    end = i + 1
        if end:
            yield start, end
            done = end


def byte_part(part: str) -> bool:
    short = part.lstrip("0")
    return len(short) <= 3 and int(short or "0") <= 255


def proposals(text: str) -> Iterable[tuple[str, int, int]]:
    """Confirmed spans by kind, in the order of ``KINDS``, each kind from left to right."""
    for a, b in emails(text):
        yield "email", a, b
    if not DIGIT.search(text):
        return
    if "." in text:
        for m in QUAD.finditer(text):
            if m.group(1) and all(map(byte_part, m.group().split("."))):
                yield "ip", m.start(), m.end()
    for m in CHAIN.finditer(text):
        if m.end() - m.start() >= 13:
            d = digits_of(m.group())
            if 13 <= len(d) <= 19 and luhn(d):
                yield "card", m.start(), m.end()
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(digits_of(m.group())) <= 15:
                yield "phone", m.start(), m.end()
    for a, b in ibans(text):
        yield "iban", a, b
    if "-" in text:
        for m in SSN.finditer(text):
            yield "ssn", m.start(), m.end()


def score(kind: str, text: str, start: int, end: int) -> float:
    before, after = text[max(0, start - NEAR) : start], text[end : end + NEAR]
    # a word that the window cuts is no word
    if start > NEAR and text[start - NEAR - 1].isalnum():
        before = FIRST_PART.sub("", before, count=1) if before[0].isalnum() else before
    if len(text) > end + NEAR and text[end + NEAR].isalnum():
        after = LAST_PART.sub("", after)
    near = f"{before} {after}".lower()
    up, down = FOR[kind].search(near) is not None, NOT.search(near) is not None
    return min(1.0, max(0.0, PRIOR[kind] + 0.3 * up - 0.3 * down))


def personal_data(text: str) -> list[Span]:
    scored = [(k, a, b, score(k, text, a, b)) for k, a, b in proposals(text)]
    return [s for s in scored if s[0] in (*BASE, "iban") or s[3] >= LEAST]


def pii_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, spans`` by kind and start, offsets in code points, each span with its score.

    Rows are kept one for one, repeated rows and null ids too; a null or empty text has no spans.
    """
    return span_table(docs, doc_id, text, lambda: lambda texts: map(personal_data, texts))


@doc_query("op6_checksum_context_pii")
def op6(spark, directory):
    return span_digest(pii_spans(table(spark, directory, "documents")), BASE)
