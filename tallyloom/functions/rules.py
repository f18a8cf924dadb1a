"""Ordered rules and globs as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_hit(rules: list[tuple[Column, dict[str, object]]], otherwise: dict[str, object] | None = None) -> Column:
    """A struct from the first rule that holds; columns and constants may be mixed."""

    def made(values: dict[str, object]) -> Column:
        return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in values.items()])

    out = None
    for condition, values in rules:
        out = F.when(condition, made(values)) if out is None else out.when(condition, made(values))
    return out.otherwise(made(otherwise)) if otherwise is not None else out


def first_pattern(text: Column, patterns: list[tuple[str, str]], otherwise: str | None = None) -> Column:
    """Name of the first pattern found in text, ignoring case; one combined test comes before the chain."""
    low = F.lower(text)
    chain = None
    for name, pattern in patterns:
        chain = F.when(low.rlike(pattern), name) if chain is None else chain.when(low.rlike(pattern), name)
    any_ = low.rlike("|".join(f"(?:{p})" for _, p in patterns))
    return F.when(any_, chain).otherwise(F.lit(otherwise).cast("string"))


def glob_regex(glob: str, segments: bool = False) -> str:
    """Anchored regular expression of a glob. segments: `*` stays within a path segment, `**` does not."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if segments and glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif segments and glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            out += ("[^/]*" if segments else ".*") if c == "*" else ("[^/]" if segments else ".") if c == "?" else re.sub(r"([^\w/ -])", r"\\\1", c)
            i += 1
    return f"^{out}$"


def matches_any(text: Column, globs: list[str], segments: bool = False) -> Column:
    return text.rlike("|".join(f"(?:{glob_regex(g, segments)})" for g in globs))
