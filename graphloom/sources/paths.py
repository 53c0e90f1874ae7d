"""Paths, globs and languages of files as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Languages by extension, and the default scope of a workspace.
LANGUAGES = {".ts": "typescript", ".mts": "typescript", ".cts": "typescript", ".tsx": "tsx", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".py": "python"}
FULL_LANGUAGES = {".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".py": "python", ".go": "go", ".rs": "rust", ".java": "java", ".c": "c", ".cpp": "cpp", ".h": "c", ".hpp": "cpp", ".cs": "csharp", ".rb": "ruby", ".php": "php", ".swift": "swift", ".kt": "kotlin", ".scala": "scala"}
INCLUDE = ("**/*",)
MAX_BYTES = 2 * 1024 * 1024


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    """The directory of a path; the root is ``.``, and above it is nothing."""
    up = F.regexp_replace(path, "/[^/]*$", "")
    return F.when(path == ".", F.lit(None)).when(path.contains("/"), up).otherwise(F.lit("."))


def ancestors(path: Column) -> Column:
    """The directories above a path, the root first."""
    parts = F.split(path, "/")
    n = F.size(parts)
    above = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array(F.lit(".")), above)


def glob_regex(patterns: list[str] | tuple[str, ...]) -> str:
    """One regular expression for full matches of any of the patterns.

    ``**/`` spans directories, a trailing ``**`` everything, ``*`` and ``?`` stay within a name; a leading
    ``/`` anchors, else a pattern matches at any depth; a trailing ``/`` matches directories (tested as ``p/``).
    """
    def one(pattern: str) -> str:
        pattern = pattern[1:] if pattern.startswith("/") else pattern if pattern.startswith("**/") else "**/" + pattern
        out, i = "", 0
        while i < len(pattern):
            if pattern.startswith("**/", i):
                out, i = out + "(?:.*/)?", i + 3
            elif pattern.startswith("**", i):
                out, i = out + (".*" if i + 2 == len(pattern) else "[^/]*"), i + 2
            else:
                c = pattern[i]
                out, i = out + ("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c)), i + 1
        return out

    return "|".join(map(one, patterns)) or "(?!)"


def matches(path: Column, patterns, directory: bool = False) -> Column:
    test = f"^(?:{glob_regex(patterns)})$"
    return path.rlike(test) | F.concat(path, F.lit("/")).rlike(test) if directory else path.rlike(test)


def full_language(path: Column) -> Column:
    """Of the full profile: more languages, ``unknown`` for the rest."""
    return F.coalesce(_by_extension(path, FULL_LANGUAGES), F.lit("unknown"))


def language(path: Column) -> Column:
    """By the extension after the last dot, whatever its case; names that only begin with a dot have none."""
    return _by_extension(path, LANGUAGES)


def _by_extension(path: Column, languages: dict[str, str]) -> Column:
    extension = F.lower(F.regexp_extract(base_name(path), r"(?<=.)(\.[^.]+)$", 1))
    return F.element_at(F.create_map(*[F.lit(x) for pair in languages.items() for x in pair]), F.when(extension != "", extension))


def lines(text: Column) -> Column:
    """Newlines and one; 0 for an empty text."""
    return F.when(F.length(text) == 0, 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)


def node_id(path: Column, kind: str, scope: Column, suffix: Column | None = None) -> Column:
    """``path:kind:scope`` and, where given, a body hash or ordinal."""
    return F.concat_ws(":", path, F.lit(kind), F.array_join(scope, "/"), *([] if suffix is None else [suffix]))


def range_text(a: Column, b: Column, c: Column, d: Column) -> Column:
    return F.format_string("%d:%d-%d:%d", a, b, c, d)
