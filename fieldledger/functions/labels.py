"""Category recodes and composite labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldledger.functions.nulls import as_col

# Kilograms per purchase unit.
KG_PER_UNIT = {"gram": 0.001, "gorogoro": 2.0, "90 kg bag": 90.0, "litre": 1.0, "kg": 1.0}


def unit_factor(unit: Column | str) -> Column:
    """Kilograms per unit; an unlisted unit counts as kilograms."""
    pairs = [F.lit(x) for kv in KG_PER_UNIT.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[as_col(unit)], F.lit(1.0))


def substring_recode(c: Column | str, rules: list[tuple[str, str]]) -> Column:
    """Apply ``(substring, label)`` rules in order. As with repeated masked assignment, a later rule
    sees the label an earlier rule wrote, and unmatched values keep their own text."""
    return reduce(lambda acc, r: F.when(acc.contains(r[0]), F.lit(r[1])).otherwise(acc), rules, as_col(c))


def list_recode(c: Column | str, members: list[str], label: str) -> Column:
    """Members of the list become ``label``; other values are kept."""
    c = as_col(c)
    return F.when(c.isin(members), F.lit(label)).otherwise(c)


def endowment_label(flags: dict[str, str], base: str = "Base") -> Column:
    """``Base + Hybrid + Oxen`` from 0/1 columns; ``flags`` maps column to label part."""
    parts = [F.when(F.col(c) == 1, F.lit(name)) for c, name in flags.items()]
    return F.concat_ws(" + ", F.lit(base), *parts)


def title_case(c: Column | str) -> Column:
    """The first letter of each word in capitals, the rest as it is; words are parted by single spaces."""
    words = F.transform(F.split(as_col(c), " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w))))
    return F.array_join(words, " ")
