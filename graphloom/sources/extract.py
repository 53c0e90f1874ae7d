"""Declarations of source files as node and edge rows.

Python files are read with the standard parser, TypeScript ones with a declaration scanner that follows brackets;
one row in gives many rows out (``mapInPandas`` over ``path, language, text``), nothing is collected.
"""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUT = "part string, label string, key string, file string, props map<string,string>, type string, from_label string, from_key string, to_label string, to_key string"


@dataclass
class Declaration:
    kind: str  # TYPE_DECL, METHOD or MEMBER
    name: str
    range: str
    props: dict = field(default_factory=dict)
    params: list[tuple[str, str | None, str | None]] = field(default_factory=list)
    body: list[Declaration] = field(default_factory=list)


def node_id(path: str, kind: str, scope: list[str], suffix: str | int | None = None) -> str:
    """``path:kind:scope/of/names`` and, where given, a body hash or ordinal."""
    if not scope:
        raise ValueError("an id needs a scope")
    return ":".join([path, kind, "/".join(scope), *([] if suffix is None else [str(suffix)])])


def first_line(doc: str | None) -> str | None:
    line = (doc or "").strip().split("\n")[0].strip()
    return line or None


def signature(name: str, params, result: str | None, arrow: str) -> str:
    inner = ", ".join(p if not t else f"{p}: {t}" for p, t, _ in params)
    return f"{name}({inner})" + (f"{arrow}{result}" if result else "")


# Python


def _span(node) -> str:
    return f"{node.lineno}:{node.col_offset}-{node.end_lineno}:{node.end_col_offset}"


def _python_params(a: ast.arguments) -> list[tuple[str, str | None, str | None]]:
    text = lambda x: ast.unparse(x) if x is not None else None
    plain = a.posonlyargs + a.args
    defaults = [None] * (len(plain) - len(a.defaults)) + list(a.defaults)
    out = [(p.arg, text(p.annotation), text(d)) for p, d in zip(plain, defaults)]
    out += [(a.vararg.arg, text(a.vararg.annotation), None)] if a.vararg else []
    out += [(p.arg, text(p.annotation), text(d)) for p, d in zip(a.kwonlyargs, a.kw_defaults)]
    return out + ([(a.kwarg.arg, text(a.kwarg.annotation), None)] if a.kwarg else [])


def python_declarations(body: list[ast.stmt], in_class: bool = False) -> list[Declaration]:
    """Functions, classes and assigned names of a module or class body; decorated definitions are left out."""
    out = []
    for s in body:
        if isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef)) and not s.decorator_list:
            params = _python_params(s.args)
            kind = "constructor" if in_class and s.name == "__init__" else "method" if in_class else "function"
            result = ast.unparse(s.returns) if s.returns else None
            props = {"kind": kind, "signature": signature(s.name, params, result, " -> "), "params_count": len(params), "exported": not s.name.startswith("_"), "async": isinstance(s, ast.AsyncFunctionDef), "docstring_head": first_line(ast.get_docstring(s))}
            out.append(Declaration("METHOD", s.name, _span(s), props, params))
        elif isinstance(s, ast.ClassDef) and not s.decorator_list:
            props = {"kind": "class", "exported": not s.name.startswith("_"), "structural": False, "docstring_head": first_line(ast.get_docstring(s))}
            out.append(Declaration("TYPE_DECL", s.name, _span(s), props, body=python_declarations(s.body, True)))
        elif isinstance(s, ast.Assign) and len(s.targets) == 1 and isinstance(s.targets[0], ast.Name):
            out.append(Declaration("MEMBER", s.targets[0].id, _span(s), {}))
        elif isinstance(s, ast.AnnAssign) and isinstance(s.target, ast.Name):
            out.append(Declaration("MEMBER", s.target.id, _span(s), {"type_text": ast.unparse(s.annotation)}))
    return out


def python_body(text: str) -> tuple[list[ast.stmt], str | None]:
    """The statements of a module, and the error's name if it does not parse as a whole.

    Then statements are read one after the other from each line without indentation; where one does not parse even with the
    lines up to the next few such lines, it is passed over.
    """
    try:
        return ast.parse(text).body, None
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        error = type(e).__name__
    lines = text.split("\n")
    starts = [i for i, x in enumerate(lines) if x[:1].strip() and x[0] not in "#)]}" and not (i and lines[i - 1].startswith("@"))]
    body, at = [], 0
    while at < len(starts):
        for end in range(at + 1, min(at + 6, len(starts) + 1)):
            stop = starts[end] if end < len(starts) else len(lines)
            try:
                found = ast.parse("\n" * starts[at] + "\n".join(lines[starts[at] : stop])).body
            except (SyntaxError, ValueError, RecursionError, MemoryError):
                continue
            body += found
            at = end
            break
        else:
            at += 1
    return body, error


#: languages whose declarations are extracted; others give their module alone, and one warning
EXTRACTED = ("python", "typescript", "tsx")


# TypeScript


_TS = re.compile(r"//[^\n]*|/\*.*?\*/|'(?:[^'\\\n]|\\.)*'|\"(?:[^\"\\\n]|\\.)*\"|`(?:[^`\\]|\\.)*`", re.S)
_HEAD = re.compile(r"(?P<export>export\s+)?(?P<skip>default\s+|abstract\s+|declare\s+)?(?P<async>async\s+)?(?:function\s*(?P<gen>\*)?\s*(?P<fn>[\w$]+)\s*(?:<[^({]*>)?\s*(?=\()|class\s+(?P<cls>[\w$]+)|(?:const|let|var)\s+(?P<var>[\w$]+))")
_MEMBER = re.compile(r"(?P<mods>(?:(?:public|private|protected|static|readonly|override|async|declare)\s+)*)(?P<acc>get\s+|set\s+)?(?P<name>[#\w$]+)\s*[?!]?\s*(?P<next>[(:=;<\n}])")


def _blank(text: str) -> str:
    """The text with comments and strings blanked, lines and columns kept."""
    return _TS.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def _close(text: str, at: int) -> int:
    """After the bracket that closes the one at ``at``."""
    pairs, stack = {")": "(", "]": "[", "}": "{"}, []
    for i in range(at, len(text)):
        c = text[i]
        if c in "([{":
            stack.append(c)
        elif c in pairs and stack and stack[-1] == pairs[c]:
            stack.pop()
            if not stack:
                return i + 1
    return len(text)


def _split(text: str, sep: str) -> list[tuple[int, int]]:
    """Parts between separators outside of brackets, as spans."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth += (c in "([{<") - (c in ")]}" or c == ">" and text[i - 1 : i] != "=")
        if c == sep and depth <= 0:
            out.append((start, i))
            start = i + 1
    return [*out, (start, len(text))]


def _ts_params(text: str, clean: str) -> list[tuple[str, str | None, str | None]]:
    out = []
    for a, b in _split(clean, ","):
        m = re.match(r"\s*(?:(?:public|private|protected|readonly)\s+)*(?:\.\.\.)?([\w$]+)\s*\??\s*", clean[a:b])
        if not m:
            continue  # a destructured parameter
        rest, shown = clean[a + m.end() : b], text[a + m.end() : b]
        cut = next((x for x, c in enumerate(rest) if c == "=" and rest[x : x + 2] != "=>"), len(rest))
        kind = shown[:cut].strip().removeprefix(":").strip() if rest.startswith(":") else None
        out.append((m[1], kind or None, shown[cut + 1 :].strip() or None if cut < len(rest) else None))
    return out


def _position(text: str, at: int) -> str:
    line = text.count("\n", 0, at)
    return f"{line + 1}:{at - (text.rfind(chr(10), 0, at) + 1)}"


def _ts_function(text: str, clean: str, paren: int, name: str, kind: str, exported: bool, is_async: bool, start: int, more: dict) -> tuple[Declaration, int]:
    end = _close(clean, paren)
    params = _ts_params(text[paren + 1 : end - 1], clean[paren + 1 : end - 1])
    brace = next((i for i in range(end, len(clean)) if clean[i] in "{;"), len(clean))
    head = text[end:brace].strip()
    stop = _close(clean, brace) if brace < len(clean) and clean[brace] == "{" else brace
    result = head.removeprefix(":").strip() if head.startswith(":") else None
    props = {"kind": kind, "signature": signature(name, params, result, ": "), "params_count": len(params), "exported": exported, "async": is_async, **more}
    return Declaration("METHOD", name, f"{_position(text, start)}-{_position(text, stop)}", props, params), stop


def _ts_class(text: str, clean: str, at: int, end: int) -> list[Declaration]:
    out = []
    while at < end:
        m = _MEMBER.match(clean, at)
        if not m or m["name"] in ("constructor",) and m["next"] != "(":
            at += 1
            continue
        mods = m["mods"].split()
        seen = {"visibility": next((x for x in mods if x in ("public", "private", "protected")), "public")}
        if m["next"] == "(" or m["next"] == "<":
            kind = "constructor" if m["name"] == "constructor" else {"get": "getter", "set": "setter"}.get((m["acc"] or "").strip(), "method")
            d, at = _ts_function(text, clean, clean.index("(", m.end() - 1), m["name"], kind, False, "async" in mods, m.start(), seen)
            out.append(d)
        else:
            stop = m.end() - 1
            while stop < end and clean[stop] not in ";\n":
                stop = _close(clean, stop) if clean[stop] in "([{" else stop + 1
            kind = re.match(r":\s*([^=;\n]+)", text[m.end() - 1 : stop])
            out.append(Declaration("MEMBER", m["name"], f"{_position(text, m.start())}-{_position(text, stop)}", seen | ({"type_text": kind[1].strip()} if kind else {})))
            at = stop + 1
    return out


def typescript_declarations(text: str) -> list[Declaration]:
    """Top-level functions, classes and single variables; interfaces, aliases, enums, abstract classes and default exports are left out."""
    clean, out, at = _blank(text), [], 0
    while at < len(clean):
        if clean[at] in "([{":
            at = _close(clean, at)
            continue
        m = _HEAD.match(clean, at) if at == 0 or not (clean[at - 1].isalnum() or clean[at - 1] in "_$.") else None
        if not m:
            at += 1
            continue
        exported = bool(m["export"])
        if m["fn"]:
            d, at = _ts_function(text, clean, clean.index("(", m.end()), m["fn"], "function", exported, bool(m["async"]), m.start(), {"generator": bool(m["gen"])})
            out += [] if m["skip"] else [d]
        elif m["cls"]:
            brace = clean.find("{", m.end())
            end = _close(clean, brace) if brace >= 0 else len(clean)
            if not m["skip"]:
                span = f"{_position(text, m.start())}-{_position(text, end)}"
                out.append(Declaration("TYPE_DECL", m["cls"], span, {"kind": "class", "exported": exported, "structural": False}, body=_ts_class(text, clean, brace + 1, end - 1)))
            at = end
        else:
            stop = m.end()
            while stop < len(clean) and clean[stop] != ";" and not (clean[stop] == "\n" and not clean[stop:].lstrip().startswith((".", "?", ":", "="))):
                stop = _close(clean, stop) if clean[stop] in "([{" else stop + 1
            kind = re.match(r"\s*:\s*([^=;]+)", text[m.end() : stop])
            if len(_split(clean[m.end() : stop], ",")) == 1:
                out.append(Declaration("MEMBER", m["var"], f"{_position(text, m.start())}-{_position(text, stop)}", {"type_text": kind[1].strip()} if kind else {}))
            at = stop
    return out


# Rows


def rows_of(path: str, language: str, text: str) -> list[dict]:
    """Node and edge rows of one file; one that cannot be parsed as a whole gives its module, one UNKNOWN and what can be read of it."""
    name = path.rpartition("/")[2]
    module = node_id(path, "MODULE", [name])
    lines = text.count("\n") + 1
    out: list[dict] = []

    def node(label: str, key: str, props: dict) -> None:
        shown = {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in props.items() if v is not None}
        out.append({"part": "node", "label": label, "key": key, "file": path, "props": {"id": key, "file": path, **shown}})

    def edge(kind: str, a: str, x: str, b: str, y: str) -> None:
        out.append({"part": "edge", "type": kind, "from_label": a, "from_key": x, "to_label": b, "to_key": y, "props": {}})

    node("MODULE", module, {"name": name, "range": f"1:0-{lines}:{len(text.rpartition(chr(10))[2])}", "status": "ready"})
    body, error = python_body(text) if language == "python" else ([], None)
    found = python_declarations(body) if language == "python" else typescript_declarations(text) if language in EXTRACTED else []
    if error:
        node("UNKNOWN", node_id(path, "UNKNOWN", [name]), {"reason": error, "status": "error"})

    def add(items: list[Declaration], owner: tuple[str, str], scope: list[str]) -> None:
        for d in items:
            here = [*scope, d.name]
            key = node_id(path, d.kind, here)
            state = {} if d.kind == "MEMBER" else {"status": "ready"}
            node(d.kind, key, {"name": d.name, "range": d.range, **state, **d.props})
            edge("DECLARES", *owner, d.kind, key)
            for i, (p, kind, default) in enumerate(d.params):
                at = node_id(path, "PARAM", [*here, p], i)
                node("PARAM", at, {"name": p, "ordinal": i, "type_text": kind, "default": default})
                edge("HAS_PARAM", d.kind, key, "PARAM", at)
            add(d.body, (d.kind, key), here)

    add(found, ("MODULE", module), [])
    return out


_KINDS = [pa.map_(pa.string(), pa.string()) if c.split()[0] == "props" else pa.string() for c in OUT.split(", ")]


def declarations(files: DataFrame) -> DataFrame:
    """Rows of :data:`OUT`, nodes and edges together, of ``path, language, text``; each file is parsed once.  Store them to use them twice."""
    columns = [c.split()[0] for c in OUT.split(", ")]

    def run(batches):
        for batch in batches:
            rows = [r for path, language, text in zip(*[c.to_pylist() for c in batch.columns]) for r in rows_of(path, language or "", text or "")]
            values = [[list(r["props"].items()) for r in rows] if c == "props" else [r.get(c) for r in rows] for c in columns]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, _KINDS)], columns)

    return files.select("path", "language", "text").mapInArrow(run, OUT)


def split(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The node and edge rows (the generic form) of :func:`declarations`."""
    return found.where("part = 'node'").select("label", "key", "file", "props"), found.where("part = 'edge'").select("type", "from_label", "from_key", "to_label", "to_key", "props")


def extract(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Node and edge rows of ``path, language, text``."""
    return split(declarations(files))


def warnings(files: DataFrame) -> DataFrame:
    """``kind, language, first, files``: one warning for each language that is known but not extracted."""
    other = files.where(F.col("language").isNotNull() & ~F.col("language").isin(*EXTRACTED, "none"))
    return other.groupBy(F.lit("unsupported language").alias("kind"), "language").agg(F.min("path").alias("first"), F.count("*").alias("files"))


def changed_files(files: DataFrame, known: DataFrame) -> DataFrame:
    """The files (``path, content_hash, ..``) to parse again: new ones, and those whose content is not the known one (``path, content_hash``)."""
    return files.join(known.select("path", "content_hash"), ["path", "content_hash"], "left_anti").select(files.columns)
