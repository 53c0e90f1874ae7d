"""Syntax trees of Python files in the positional profile: one row for each node that has a label.

Ids are ``path:LABEL:row:column``; nodes without a label are passed through, their children belong to the next node above.
Of two nodes with one id the first counts, the children of both stay.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TREE = "id string, parent string, ord int, label string, name string, code string, line int, col int, file string, method string, control string"
CODE, NAME = 256, 64

#: syntax to labels
LABELS: dict[type, str] = {
    ast.FunctionDef: "METHOD", ast.AsyncFunctionDef: "METHOD", ast.Lambda: "METHOD", ast.ClassDef: "TYPE_DECL",
    ast.arg: "METHOD_PARAMETER_IN", ast.Assign: "LOCAL", ast.AnnAssign: "LOCAL", ast.Call: "CALL", ast.Import: "CALL", ast.ImportFrom: "CALL",
    ast.Name: "IDENTIFIER", ast.Constant: "LITERAL", ast.JoinedStr: "LITERAL", ast.Return: "RETURN",
    ast.If: "CONTROL_STRUCTURE", ast.While: "CONTROL_STRUCTURE", ast.For: "CONTROL_STRUCTURE", ast.AsyncFor: "CONTROL_STRUCTURE", ast.Try: "CONTROL_STRUCTURE", ast.Match: "CONTROL_STRUCTURE", ast.With: "CONTROL_STRUCTURE", ast.Raise: "CONTROL_STRUCTURE",
}
KINDS = {ast.If: "if", ast.While: "while", ast.For: "for", ast.AsyncFor: "for", ast.Try: "try", ast.Match: "match"}


def node_name(node: ast.AST) -> str | None:
    if isinstance(node, ast.Lambda):
        return f"<lambda>:{node.lineno}"
    if isinstance(node, ast.Call):
        return ast.unparse(node.func)[:NAME]
    if isinstance(node, ast.Assign):
        return ast.unparse(node.targets[0])[:NAME]
    if isinstance(node, ast.AnnAssign):
        return ast.unparse(node.target)[:NAME]
    return next((str(getattr(node, a))[:NAME] for a in ("name", "arg", "id", "module") if getattr(node, a, None)), None)


def syntax_rows(path: str, text: str) -> list[dict]:
    """The rows of one file; a file that cannot be parsed has none."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return []
    lines, out, seen = text.splitlines(keepends=True), [], set()

    def code_of(node: ast.AST) -> str:
        first, last = node.lineno - 1, (node.end_lineno or node.lineno) - 1
        part = lines[first : last + 1]
        if first == last:
            return part[0].encode()[node.col_offset : node.end_col_offset].decode(errors="replace")[:CODE]
        return (part[0].encode()[node.col_offset :].decode(errors="replace") + "".join(part[1:]))[:CODE]

    def add(label: str, line: int, col: int, parent: str | None, order: int, method: str | None, name=None, code=None, control=None) -> str:
        key = f"{path}:{label}:{line}:{col}"
        if key not in seen:
            seen.add(key)
            out.append({"id": key, "parent": parent, "ord": order, "label": label, "name": name, "code": code, "line": line, "col": col, "file": path, "method": method or (key if label == "METHOD" else None), "control": control})
        return key

    def below(nodes: Iterator[ast.AST], parent: str | None, method: str | None, order: int = 0) -> int:
        for n in nodes:
            order = visit(n, parent, method, order)
        return order

    def block(body: list, parent: str, method: str | None, order: int) -> int:
        if not body:
            return order
        at = add("BLOCK", body[0].lineno, body[0].col_offset, parent, order, method)
        below(body, at, method)
        return order + 1

    def visit(node: ast.AST, parent: str | None, method: str | None, order: int) -> int:
        label = LABELS.get(type(node))
        if label is None:
            return below(ast.iter_child_nodes(node), parent, method, order)
        key = add(label, node.lineno, node.col_offset, parent, order, None if label == "METHOD" else method, node_name(node), code_of(node), KINDS.get(type(node)))
        inner = key if label == "METHOD" else method
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            block(node.body, key, inner, below((a for a in ast.walk(node.args) if isinstance(a, ast.arg)), key, inner))
        elif isinstance(node, (ast.If, ast.While)):
            block(node.orelse, key, inner, block(node.body, key, inner, visit(node.test, key, inner, 0)))
        elif isinstance(node, (ast.For, ast.AsyncFor)):
            block(node.orelse, key, inner, block(node.body, key, inner, below(iter((node.target, node.iter)), key, inner)))
        elif isinstance(node, ast.Try):
            k = block(node.body, key, inner, 0)
            for part in (*[h.body for h in node.handlers], node.orelse, node.finalbody):
                k = block(part, key, inner, k)
        elif isinstance(node, ast.Match):
            k = visit(node.subject, key, inner, 0)
            for case in node.cases:
                k = block(case.body, key, inner, k)
        elif label not in ("IDENTIFIER", "LITERAL", "METHOD_PARAMETER_IN"):
            below(ast.iter_child_nodes(node), key, inner)
        return order + 1

    below(iter(tree.body), None, None)
    return out


def syntax_tree(files: DataFrame) -> DataFrame:
    """Rows of :data:`TREE` of the Python files among ``path, language, text``."""
    columns = [c.split()[0] for c in TREE.split(", ")]

    def run(batches):
        for batch in batches:
            rows = [r for f in batch.itertuples(index=False) for r in syntax_rows(f.path, f.text or "")]
            yield pd.DataFrame(rows, columns=columns) if rows else pd.DataFrame({c: pd.Series(dtype=object) for c in columns})

    return files.where("language = 'python'").select("path", "language", "text").mapInPandas(run, TREE)


def tree_edges(tree: DataFrame) -> DataFrame:
    """``type, src, dst, ord``: AST edges from parents, and SOURCE_FILE edges to the file."""
    below = tree.where("parent is not null").select(F.lit("AST").alias("type"), F.col("parent").alias("src"), F.col("id").alias("dst"), "ord")
    return below.unionByName(tree.select(F.lit("SOURCE_FILE").alias("type"), F.col("id").alias("src"), F.col("file").alias("dst"), F.lit(None).cast("int").alias("ord")))


def snapshot(tree: DataFrame) -> DataFrame:
    """``file, tree``: a file's whole syntax tree as one JSON text, in order of position."""
    node = F.struct("line", "col", "id", "label", "name", "parent", "ord")
    return tree.groupBy("file").agg(F.to_json(F.sort_array(F.collect_list(node)), {"ignoreNullFields": "false"}).alias("tree"))


def shown_code(c: Column) -> Column:
    """A node's text as the tree holds it."""
    return F.substring(c, 1, CODE)


def shown_name(c: Column) -> Column:
    return F.substring(c, 1, NAME)


def captures(tree: DataFrame, names: tuple[str, ...] = ("definition.function", "definition.class", "definition.variable", "import", "call")) -> DataFrame:
    """``file, capture, name, line``: what queries for symbols and imports capture, by position."""
    label, code = F.col("label"), F.col("code")
    is_import = code.rlike(r"^(?:from\s|import\s)")
    capture = F.when(label == "METHOD", "definition.function").when(label == "TYPE_DECL", "definition.class").when((label == "LOCAL") & F.col("method").isNull(), "definition.variable").when((label == "CALL") & is_import, "import").when(label == "CALL", "call")
    return tree.select("file", capture.alias("capture"), "name", "line").where(F.col("capture").isin(*names))


def symbols(tree: DataFrame) -> DataFrame:
    """``file, name, kind, line``: definitions by name."""
    return tree.where("label in ('METHOD', 'TYPE_DECL') or (label = 'LOCAL' and method is null)").select("file", "name", F.col("label").alias("kind"), "line")


def find_symbol(defined: DataFrame, name: str, file: str | None = None) -> DataFrame:
    """The first definition of a name in each file (or in one)."""
    own = defined.where(F.col("name") == name)
    if file is not None:
        own = own.where(F.col("file") == file)
    return own.withColumn("k", F.row_number().over(Window.partitionBy("file").orderBy("line"))).where("k = 1").drop("k")


def enclosing(parents: DataFrame, wanted: str) -> DataFrame:
    """``id, scope``: the nearest node of label ``wanted`` above each node of ``id, parent, label``, by the parent chain."""
    from ..operators.iterate import checkpointed

    up = parents.select(F.col("id").alias("at"), F.col("parent").alias("above"), F.col("label").alias("at_label"))
    now, found = parents.where("parent is not null").select("id", F.col("parent").alias("at")), None
    while True:
        step = checkpointed(now.join(up, "at").select("id", "at", "above", "at_label"))
        if step.isEmpty():
            break
        hit = step.where(F.col("at_label") == wanted).select("id", F.col("at").alias("scope"))
        found = hit if found is None else found.unionByName(hit)
        now = step.where((F.col("at_label") != wanted) & F.col("above").isNotNull()).select("id", F.col("above").alias("at"))
    return step.select("id", F.col("at").alias("scope")) if found is None else found
