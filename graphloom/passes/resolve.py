"""Imports and calls resolved to files and definitions by joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.paths import base_name, parent

# The order in which a TypeScript specifier is tried.
TS_SUFFIXES = ("", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")


def python_imports(text: Column) -> Column:
    """``module, level, names`` of one import statement; aliases are dropped from names."""
    names = lambda c: F.transform(F.split(F.regexp_replace(c, r"[()\n]", " "), ","), lambda x: F.regexp_replace(F.trim(x), r"\s+as\s+.*$", ""))
    source = F.regexp_extract(text, r"^\s*from\s+(\.*)([\w.]*)\s+import\s+", 2)
    dots = F.length(F.regexp_extract(text, r"^\s*from\s+(\.*)([\w.]*)\s+import\s+", 1))
    is_from = text.rlike(r"^\s*from\s")
    plain = names(F.regexp_extract(text, r"^\s*import\s+([\s\S]+)$", 1))
    return F.when(is_from, F.struct(source.alias("module"), dots.alias("level"), names(F.regexp_extract(text, r"\simport\s+([\s\S]+)$", 1)).alias("names"))).otherwise(F.struct(F.get(plain, F.lit(0)).alias("module"), F.lit(0).alias("level"), plain.alias("names")))


def typescript_imports(text: Column) -> Column:
    """``module, names``: of ``import .. from``, side-effect imports and ``require``; names are named, default and namespace ones."""
    module = F.regexp_extract(text, r"""(?:from\s+|import\s+|require\(\s*)['"]([^'"]+)['"]""", 1)
    inner = F.regexp_extract(text, r"\{([^}]*)\}", 1)
    named = F.filter(F.transform(F.split(inner, ","), lambda x: F.regexp_replace(F.trim(x), r"^.*\s+as\s+", "")), lambda x: x != "")
    default = F.regexp_extract(text, r"^\s*(?:import|const|let|var)\s+(?:type\s+)?([\w$]+)", 1)
    space = F.regexp_extract(text, r"\*\s+as\s+([\w$]+)", 1)
    return F.struct(module.alias("module"), F.concat(named, F.filter(F.array(default, space), lambda x: (x != "") & (x != "type"))).alias("names"))


def is_relative(module: Column) -> Column:
    return module.rlike(r"^\.{1,2}(/|$)")


def normal(path: Column) -> Column:
    """A path with ``.`` and ``..`` parts resolved."""
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), lambda done, x: F.when(x.isin("", "."), done).when(x == "..", F.when(F.size(done) > 0, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(done)).otherwise(F.concat(done, F.array(x)))), "/")


def python_candidates(file: Column, module: Column, level: Column) -> Column:
    """The files that a Python module may be, in order: below the importing package, the root, and ``src``."""
    path = F.replace(module, F.lit("."), F.lit("/"))
    up = F.concat_ws("/", parent(file), F.repeat(F.lit("../"), F.greatest(level - 1, F.lit(0))))
    bases = F.when(level > 0, F.array(up)).otherwise(F.array(F.lit(""), F.lit("src")))
    return F.flatten(F.transform(bases, lambda b: F.array(normal(F.concat_ws("/", b, F.concat(path, F.lit(".py")))), normal(F.concat_ws("/", b, path, F.lit("__init__.py"))))))


def typescript_candidates(file: Column, module: Column) -> Column:
    at = normal(F.concat_ws("/", parent(file), module))
    return F.when(is_relative(module), F.array(*[F.concat(at, F.lit(x)) for x in TS_SUFFIXES])).otherwise(F.array().cast("array<string>"))


def first_existing(imports: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    """The first of each row's ``candidates`` that is a ``path`` of ``files``: ``keys`` and that path's ``target``.  Rows without one are left out.

    The join is merged, never broadcast: Spark estimates exploded rows and composed paths by the small columns that they come from.
    """
    each = imports.select(*keys, F.posexplode("candidates").alias("rank", "path"))
    return each.join(files.select("path", "target").hint("merge"), "path").groupBy(*keys).agg(F.min_by("target", "rank").alias("target"))


def stem_key(stem: Column) -> Column:
    """What stands for a stem among paths, none of which holds a NUL."""
    return F.concat(F.lit("\0"), F.lower(stem))


def by_stem(files: DataFrame) -> DataFrame:
    """``path, target``: the key of each lower-case name without extension, and the first file of that name."""
    stem = F.regexp_replace(base_name(F.col("path")), r"\.[^.]*$", "")
    return files.groupBy(stem_key(stem).alias("key")).agg(F.min("path").alias("target")).select(F.col("key").alias("path"), "target")


def resolve_imports(imports: DataFrame, files: DataFrame, stem_fallback: bool = False) -> DataFrame:
    """``id, file, target`` of ``id, file, module, candidates``; the fallback serves rows without a candidate, by the module's last part as one more."""
    targets = files.select("path", F.col("path").alias("target"))
    if stem_fallback:
        last = stem_key(F.regexp_extract("module", r"([^./]+)$", 1))
        imports = imports.withColumn("candidates", F.concat(F.coalesce("candidates", F.array().cast("array<string>")), F.array(last)))
        targets = targets.unionByName(by_stem(files))
    return first_existing(imports, targets, ["id", "file"])


def named_definitions(imports: DataFrame, definitions: DataFrame) -> DataFrame:
    """``id, definition``: imported names to the first definition of that name in the target file.  ``imports``: ``id, target, names``."""
    first = definitions.groupBy(F.col("file").alias("target"), "name").agg(F.min_by("definition", F.struct("position", "definition")).alias("definition"))
    return imports.select("id", "target", F.explode("names").alias("name")).join(first, ["target", "name"]).select("id", "definition")


def resolve_calls(calls: DataFrame, imports: DataFrame, definitions: DataFrame) -> DataFrame:
    """``id, definition, how``: dotted calls over an imported module, plain ones over imported names, else the own file.

    ``calls``: ``id, file, callee``; ``imports``: ``file, alias, target``; ``definitions``: ``file, name, definition``.
    """
    prefix, name = F.regexp_extract("callee", r"^(.*)\.[^.]+$", 1), F.regexp_extract("callee", r"([^.]+)$", 1)
    c = calls.select("id", "file", prefix.alias("prefix"), name.alias("name"))
    d = definitions.select(F.col("file").alias("target"), "name", "definition")
    module = c.where("prefix <> ''").join(imports, (c["file"] == imports["file"]) & (c["prefix"] == imports["alias"])).select("id", "name", "target").withColumn("how", F.lit("module"))
    direct = c.where("prefix = ''").join(imports, (c["file"] == imports["file"]) & (c["name"] == imports["alias"])).select("id", "name", "target").withColumn("how", F.lit("import"))
    local = c.where("prefix = ''").select("id", "name", F.col("file").alias("target")).withColumn("how", F.lit("local"))
    found = module.unionByName(direct).unionByName(local).join(d, ["target", "name"])
    rank = F.when(F.col("how") == "local", 1).otherwise(0)
    first = F.min(F.struct(rank.alias("rank"), "definition", "how"))
    return found.groupBy("id").agg(first.alias("f")).select("id", "f.definition", "f.how")


def clear_stale(edges: DataFrame, files: DataFrame, types: tuple[str, ...] = ("IMPORT", "IMPORTS")) -> DataFrame:
    """The edges (``type, file, ..``) without those of the given types that start in one of ``files`` (``path``): they are resolved anew."""
    old = edges.where(F.col("type").isin(*types)).join(files.select(F.col("path").alias("file")), "file", "left_anti")
    return edges.where(~F.col("type").isin(*types)).unionByName(old.select(edges.columns))


def to_resolve(changed: DataFrame, links: DataFrame) -> DataFrame:
    """``path``: the changed files and those that import one of them (``links``: ``src, dst``), whose imports and calls are resolved again."""
    from ..operators.traverse import dependents

    own = changed.select(F.col("path").alias("node"))
    return own.unionByName(dependents(own, links)).distinct().select(F.col("node").alias("path"))


def resolve_again(changed: DataFrame, links: DataFrame, calls: DataFrame, imports: DataFrame, definitions: DataFrame, resolved: DataFrame) -> DataFrame:
    """``id, file, definition, how`` after some files (``path``) changed: their calls and those of the files that import them anew, the rest as it was."""
    files = to_resolve(changed, links).select(F.col("path").alias("file"))
    again = calls.join(files, "file", "left_semi")
    new = resolve_calls(again, imports.join(files, "file", "left_semi"), definitions).join(again.select("id", "file"), "id")
    return resolved.join(files, "file", "left_anti").select("id", "file", "definition", "how").unionByName(new.select("id", "file", "definition", "how"))
