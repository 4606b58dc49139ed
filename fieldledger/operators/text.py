"""Word counts of marked-up documents, as chains of built-in string functions over whole texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What is stripped from a Markdown paper before counting, in this order. Each entry is
# (pattern, replacement, mark); the syntax is common to Java and RE2. A text without any of the marks needs only the
# rules without one: line breaks part words like other space, and are replaced for the sake of the rules that follow.
MARKDOWN_STRIP = [
    (r"(?ms)^```[^\n]*(?:\n|\z).*?(?:^```[^\n]*(?:\n|\z)|\z)", "", "`"),
    (r"`r[^`\n]*`", "", "`"),
    (r"(?ms)^# References \{-\}.*\z", "", "{-}"),
    (r"\n", " ", "\\"),
    (r"\$\$[^$]+\$\$", "", "$"),
    (r"\$[^$]+\$", "", "$"),
    (r"\\\[.*?\\\]", "", "\\"),
    (r"[*_#~`\[\]()<>|{}]", "", None),
]
# The same for a LaTeX paper.
LATEX_STRIP = [
    (r"(?ms)^[^\n]*\\section\*\{References\}\s*\\label\{references\}.*\z", "", "\\"),
    (r"\n", " ", "\\"),
    (r"\$\$.*?\$\$", "", "$"),
    (r"\$[^$]+\$", "", "$"),
    (r"\\\[.*?\\\]", "", "\\"),
    (r"\\begin\{equation\*?\}.*?\\end\{equation\*?\}", "", "\\"),
    (r"\\begin\{align\*?\}.*?\\end\{align\*?\}", "", "\\"),
    (r"\\[a-zA-Z]+\*?(?:\[[^\]]*\])?(?:\{[^}]*\})?", "", "\\"),
    (r"\{", "", "{"),
    (r"\}", "", "}"),
]
SPACE = r"\s+"


def strip_markup(text: Column, rules: list[tuple[str, str, str | None]]) -> Column:
    """The text after all rules; one without any mark goes through the rules without a mark alone."""

    def chain(part):
        return reduce(lambda acc, r: F.regexp_replace(acc, F.lit(r[0]), F.lit(r[1])), part, text)

    marks = [F.contains(text, F.lit(m)) for m in dict.fromkeys(m for *_, m in rules if m)]
    marked = reduce(lambda a, b: a | b, marks)
    return F.when(marked, chain(rules)).otherwise(chain([r for r in rules if r[2] is None]))


def split_words(text: Column) -> Column:
    return F.split(text, SPACE)


def count_parts(parts: str) -> Column:
    """Words in a split text: its parts, less the empty ones that leading and trailing space leave."""
    first = (F.get(F.col(parts), F.lit(0)) == "").cast("int")
    last = ((F.size(parts) > 1) & (F.element_at(F.col(parts), -1) == "")).cast("int")
    return F.size(parts) - first - last


def count_document_words(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the words left after stripping Markdown and LaTeX markup."""
    rules = {"markdown_words": MARKDOWN_STRIP, "latex_words": LATEX_STRIP}
    parts = df.withColumns({f"_{c}": split_words(strip_markup(F.col(text), r)) for c, r in rules.items()})
    return parts.withColumns({c: count_parts(f"_{c}") for c in rules}).drop(*[f"_{c}" for c in rules])
