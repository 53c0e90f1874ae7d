"""Functions of declarations' source text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def python_visibility(name: Column) -> Column:
    """Of a Python name: two leading underscores (and none at the end) are private, other leading ones protected."""
    return F.when(name.rlike("^__") & ~name.rlike("__$"), "private").when(name.startswith("_"), "protected").otherwise("public")


def typescript_visibility(modifiers: Column) -> Column:
    """By the modifiers before a member's name; public without one."""
    return F.coalesce(F.when(modifiers.rlike(r"\bprivate\b"), "private").when(modifiers.rlike(r"\bprotected\b"), "protected"), F.lit("public"))


def docstring_head(text: Column) -> Column:
    """The first line of a docstring's source text, without its quotes and prefix; null if there is none."""
    inner = F.regexp_extract(F.trim(text), r"(?s)^[rRbBuUfF]{0,2}(\"{3}|'{3}|\"|')(.*)\1$", 2)
    line = F.trim(F.substring_index(F.regexp_replace(inner, r"^\s+", ""), "\n", 1))
    return F.when(line != "", line)
