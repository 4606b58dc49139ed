"""Training-data operators over a table of documents, and the queries that apply them.

Importing the subpackage registers every query in ``registry.QUERIES``.
"""

from fieldledger.llm import (  # noqa: F401
    bpe,
    count,
    decontaminate,
    langid,
    packing,
    pii,
    ranked,
    repeats,
    secretscan,
    simhash,
    toxicity,
    vectorcodes,
    weighted,
)
