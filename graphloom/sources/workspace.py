"""Workspace scan: files and directories with counts, contents with hashes, and the configuration of a scope.

Listing is a driver-side walk that prunes excluded folders before descending; contents are read by the
executors, so a scan of many files is distributed.
"""

from __future__ import annotations

import json
import os
import re
import stat as st
from dataclasses import dataclass, field, replace

import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import paths as P

# What a scope leaves out by default.
EXCLUDE = (
    "**/node_modules/**", "**/.git/**", "**/.hg/**", "**/.svn/**",
    "**/.venv/**", "**/venv/**", "**/__pycache__/**", "**/.mypy_cache/**", "**/.pytest_cache/**", "**/.ruff_cache/**", "**/.tox/**", "**/site-packages/**",
    "**/dist/**", "**/out/**", "**/build/**", "**/coverage/**", "**/.next/**", "**/.cache/**", "**/.tmp/**", "**/.vscode-test/**",
    "**/.claude/worktrees/**",
    "**/*.min.js", "**/*.d.ts",
)


@dataclass(frozen=True)
class Scope:
    include: tuple[str, ...] = P.INCLUDE
    exclude: tuple[str, ...] = EXCLUDE
    max_bytes: int = P.MAX_BYTES
    follow_links: bool = False


def define_scope(include=None, exclude=None, exclude_extra=(), max_bytes: int | None = None) -> Scope:
    """``include`` and ``exclude`` replace the defaults, ``exclude_extra`` adds to what is left out."""
    base = Scope()
    return replace(base, include=tuple(include or base.include), exclude=(*(base.exclude if exclude is None else exclude), *exclude_extra), max_bytes=base.max_bytes if max_bytes is None else max_bytes)


@dataclass
class Walk:
    files: list[tuple[str, int]] = field(default_factory=list)
    directories: list[str] = field(default_factory=list)
    counts: dict[str, int] = field(default_factory=lambda: dict.fromkeys(("directoriesVisited", "directoriesSkipped", "filesSeen", "filesExcluded", "filesUnsupported", "filesTooLarge", "symlinksSkipped"), 0))


def language_of(name: str) -> str | None:
    stem, dot, ext = name.rpartition(".")
    return P.LANGUAGES.get("." + ext.lower()) if dot and stem else None


def walk(root: str, scope: Scope = Scope()) -> Walk:
    """Entries in code-unit order, excluded folders unopened; files without a language are counted but kept."""
    out = Walk()
    excluded, included = (re.compile(f"(?:{P.glob_regex(g)})") for g in (scope.exclude, scope.include))
    todo = ["."]
    while todo:
        rel = todo.pop()
        out.directories.append(rel)
        out.counts["directoriesVisited"] += 1
        try:
            entries = sorted(os.scandir(os.path.join(root, rel)), key=lambda e: e.name.encode("utf-16-be"))
        except OSError:
            continue
        below = []
        for e in entries:
            path = e.name if rel == "." else f"{rel}/{e.name}"
            if e.is_symlink() and not scope.follow_links:
                out.counts["symlinksSkipped"] += 1
            elif e.is_dir():
                if excluded.fullmatch(path) or excluded.fullmatch(path + "/") or excluded.fullmatch(path + "/x"):
                    out.counts["directoriesSkipped"] += 1
                else:
                    below.append(path)
            elif e.is_file() and st.S_ISREG(e.stat().st_mode):
                out.counts["filesSeen"] += 1
                if excluded.fullmatch(path) or not included.fullmatch(path):
                    out.counts["filesExcluded"] += 1
                elif e.stat().st_size > scope.max_bytes:
                    out.counts["filesTooLarge"] += 1
                else:
                    out.counts["filesUnsupported"] += language_of(e.name) is None
                    out.files.append((path, e.stat().st_size))
        todo += reversed(below)
    return out


def load(spark: SparkSession, root: str, found: Walk) -> DataFrame:
    """``path, name, parent, language, content_hash, loc, text`` of the files of a walk, read by the executors.

    ``root`` is a folder or URI that the executors reach.  (Spark's own file sources leave out names
    that begin with an underscore or a dot, which source trees are full of.)
    """
    base = root if "://" in root or root.startswith("file:") else "file://" + os.path.abspath(root)

    def read(batches):
        fs, top = pyarrow.fs.FileSystem.from_uri(base)
        for batch in batches:
            data = []
            for p in batch["path"]:
                with fs.open_input_stream(f"{top}/{p}") as f:
                    data.append(f.read())
            yield pd.DataFrame({"path": batch["path"], "content": data})

    listed = spark.createDataFrame([(p,) for p, _ in found.files], "path string")
    rows = listed.repartition(max(1, min(1000, len(found.files) // 100))).mapInPandas(read, "path string, content binary")
    path, text = F.col("path"), F.col("content").cast("string")
    return rows.select("path", P.base_name(path).alias("name"), P.parent(path).alias("parent"), F.coalesce(P.language(path), F.lit("none")).alias("language"), F.sha2("content", 256).alias("content_hash"), P.lines(text).alias("loc"), text.alias("text"))


def index_workspace(spark: SparkSession, root: str, store, scope: Scope = Scope()) -> dict:
    """Scan, extract declarations and write them; a report of counts.

    What a file owned before is replaced, so indexing the same folder again gives the same graph.
    """
    from ..operators.iterate import checkpointed
    from .extract import declarations, split, warnings

    found = walk(root, scope)
    rows = checkpointed(load(spark, root, found))
    parsed = checkpointed(declarations(rows))
    files = rows.select("path", "name", "parent", "language", "content_hash", "loc", F.lit("ready").alias("status"), F.lit(1).alias("version"))
    store.write_filesystem(files=files)
    store.replace_files(files.select("path"), *split(parsed))
    parts = {r["part"]: r["count"] for r in parsed.groupBy("part").count().collect()}
    told = [r.asDict() for r in warnings(rows).orderBy("language").collect()]  # one for each language
    return {"files": len(found.files), "directories": len(found.directories), "nodes": parts.get("node", 0), "edges": parts.get("edge", 0), "stats": found.counts, "warnings": told}


def scope_from(path: str) -> Scope:
    """A scope from a JSON file: ``include``, ``exclude``, ``excludeExtra`` and ``maxBytes``; other names are refused."""
    with open(path, encoding="utf-8") as f:
        given = json.load(f)
    if unknown := sorted(set(given) - {"include", "exclude", "excludeExtra", "maxBytes"}):
        raise ValueError(f"unknown settings {unknown}")
    return define_scope(given.get("include"), given.get("exclude"), tuple(given.get("excludeExtra", ())), given.get("maxBytes"))


def scan_folders(root: str, folders: tuple[str, ...] = ("src",), skip: tuple[str, ...] = ("node_modules",)) -> Walk:
    """The older scan: all files below the watched folders, without names that begin with a dot and the folders in ``skip``."""
    out = Walk()
    todo = [f for f in folders if os.path.isdir(os.path.join(root, f))]
    while todo:
        rel = todo.pop()
        out.directories.append(rel)
        below = []
        for e in sorted(os.scandir(os.path.join(root, rel)), key=lambda e: e.name):
            if e.name.startswith(".") or e.name in skip:
                continue
            if e.is_dir(follow_symlinks=False):
                below.append(f"{rel}/{e.name}")
            elif e.is_file(follow_symlinks=False):
                out.files.append((f"{rel}/{e.name}", e.stat().st_size))
        todo += reversed(below)
    return out


def scan(listing: DataFrame, scope: Scope = Scope()) -> DataFrame:
    """``path, size, state, language`` of a listing ``path, size, is_link`` (say of an object store): symlink, excluded, too large or kept.

    The same decisions as :func:`walk` takes, as columns; a pattern that leaves out a folder leaves out all below it.
    """
    path = F.col("path")
    out = P.matches(path, scope.exclude) | ~P.matches(path, scope.include)
    link = F.col("is_link") & F.lit(not scope.follow_links)
    state = F.when(link, "symlink").when(out, "excluded").when(F.col("size") > scope.max_bytes, "too large").otherwise("kept")
    return listing.select("path", "size", state.alias("state"), P.language(path).alias("language"))


def scan_counts(scanned: DataFrame) -> DataFrame:
    """The counters of a walk that come from files, as one row."""
    n = lambda c: F.count(F.when(c, 1))
    state = F.col("state")
    return scanned.agg(n(state != "symlink").alias("filesSeen"), n(state == "excluded").alias("filesExcluded"), n((state == "kept") & F.col("language").isNull()).alias("filesUnsupported"), n(state == "too large").alias("filesTooLarge"), n(state == "symlink").alias("symlinksSkipped"))


def records(scanned: DataFrame) -> DataFrame:
    """``path, name, parent, language`` of the files that a scan keeps."""
    path = F.col("path")
    return scanned.where("state = 'kept'").select("path", P.base_name(path).alias("name"), P.parent(path).alias("parent"), F.coalesce("language", F.lit("none")).alias("language"))


def scan_older(listing: DataFrame, folders: tuple[str, ...] = ("src",), skip: tuple[str, ...] = ("node_modules",)) -> DataFrame:
    """``path`` of what :func:`scan_folders` finds, from a listing ``path, size, is_link``."""
    parts = F.split("path", "/")
    hidden = F.exists(parts, lambda x: x.startswith(".") | x.isin(*skip))
    return listing.where(F.get(parts, F.lit(0)).isin(*folders) & (F.size(parts) > 1) & ~hidden & ~F.col("is_link")).select("path")
