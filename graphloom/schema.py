"""The graph schema as data (version 2): labels, edge types, properties; Spark types and a JSON form follow from it."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import types as T

VERSION = 2

TYPES = {"string": T.StringType(), "int": T.LongType(), "float": T.DoubleType(), "bool": T.BooleanType(), "list": T.ArrayType(T.StringType())}


@dataclass(frozen=True)
class Property:
    name: str
    type: str = "string"
    required: bool = False
    values: tuple[str, ...] = ()


@dataclass(frozen=True)
class NodeSpec:
    label: str
    cpg: bool
    key: str
    write: str
    properties: tuple[Property, ...]


@dataclass(frozen=True)
class EdgeSpec:
    type: str
    sources: tuple[str, ...]
    targets: tuple[str, ...]
    write: str
    properties: tuple[Property, ...]


# The vocabularies, labels, edge types and properties of the schema.
RESOLUTION_STATUS = ("resolved", "ambiguous", "external", "unresolved", "dynamic")
NODE_STATUS = ("ready", "indexing", "stale", "error")
INHERITS_RELATION = ("extends", "implements")
TYPE_DECL_KIND = ("class", "interface", "enum", "type_alias", "protocol", "dataclass")
METHOD_KIND = ("function", "method", "constructor", "getter", "setter", "lambda_named")
CALL_KIND = ("call", "new", "decorator", "await")

NODE_SPECS = {
    "DIRECTORY": NodeSpec("DIRECTORY", cpg=False, key="path", write="merge", properties=(
        Property("path", required=True),
        Property("name", required=True),
        Property("status", required=True, values=NODE_STATUS),
    )),
    "FILE": NodeSpec("FILE", cpg=False, key="path", write="merge", properties=(
        Property("path", required=True),
        Property("name", required=True),
        Property("language", required=True),
        Property("content_hash", required=True),
        Property("interface_hash"),
        Property("status", required=True, values=NODE_STATUS),
        Property("version", type="int", required=True),
        Property("indexed_at"),
        Property("loc", type="int"),
    )),
    "MODULE": NodeSpec("MODULE", cpg=True, key="id", write="create", properties=(
        Property("id", required=True),
        Property("name", required=True),
        Property("file", required=True),
        Property("range", required=True),
        Property("status", required=True, values=NODE_STATUS),
    )),
    "TYPE_DECL": NodeSpec("TYPE_DECL", cpg=True, key="id", write="create", properties=(
        Property("id", required=True),
        Property("name", required=True),
        Property("kind", required=True, values=TYPE_DECL_KIND),
        Property("file", required=True),
        Property("range", required=True),
        Property("exported", type="bool", required=True),
        Property("docstring_head"),
        Property("status", required=True, values=NODE_STATUS),
        Property("structural", type="bool", required=True),
    )),
    "METHOD": NodeSpec("METHOD", cpg=True, key="id", write="create", properties=(
        Property("id", required=True),
        Property("name", required=True),
        Property("kind", required=True, values=METHOD_KIND),
        Property("signature", required=True),
        Property("params_count", type="int", required=True),
        Property("file", required=True),
        Property("range", required=True),
        Property("exported", type="bool", required=True),
        Property("async", type="bool", required=True),
        Property("docstring_head"),
        Property("status", required=True, values=NODE_STATUS),
        Property("cyclomatic_complexity", type="int"),
        Property("max_nesting_depth", type="int"),
        Property("loc", type="int"),
        Property("visibility"),
        Property("generator", type="bool"),
    )),
    "PARAM": NodeSpec("PARAM", cpg=True, key="id", write="create", properties=(
        Property("id", required=True),
        Property("name", required=True),
        Property("ordinal", type="int", required=True),
        Property("type_text"),
        Property("default"),
        Property("file", required=True),
    )),
    "MEMBER": NodeSpec("MEMBER", cpg=True, key="id", write="create", properties=(
        Property("id", required=True),
        Property("name", required=True),
        Property("type_text"),
        Property("file", required=True),
        Property("range", required=True),
        Property("visibility"),
    )),
    "CALL": NodeSpec("CALL", cpg=True, key="id", write="create", properties=(
        Property("id", required=True),
        Property("callee_name", required=True),
        Property("receiver_text"),
        Property("args_count", type="int", required=True),
        Property("file", required=True),
        Property("range", required=True),
        Property("kind", required=True, values=CALL_KIND),
        Property("status", required=True, values=RESOLUTION_STATUS),
    )),
    "IMPORT": NodeSpec("IMPORT", cpg=True, key="id", write="create", properties=(
        Property("id", required=True),
        Property("source_text", required=True),
        Property("imported_names", type="list"),
        Property("alias"),
        Property("is_type_only", type="bool", required=True),
        Property("file", required=True),
        Property("range", required=True),
    )),
    "SYMBOL": NodeSpec("SYMBOL", cpg=False, key="fqn", write="merge", properties=(
        Property("fqn", required=True),
        Property("scheme"),
        Property("manager"),
        Property("package"),
        Property("version"),
        Property("kind"),
        Property("language"),
    )),
    "COMMUNITY": NodeSpec("COMMUNITY", cpg=False, key="id", write="overlay", properties=(
        Property("id", required=True),
        Property("algorithm", required=True),
        Property("run_id", required=True),
        Property("size", type="int", required=True),
        Property("cohesion", type="float"),
        Property("computed_at", required=True),
        Property("label_hint"),
        Property("projection"),
        Property("edge_basis"),
        Property("level", type="int"),
    )),
    "TAG": NodeSpec("TAG", cpg=False, key="name", write="merge", properties=(
        Property("name", required=True),
        Property("value"),
    )),
    "UNKNOWN": NodeSpec("UNKNOWN", cpg=True, key="id", write="create", properties=(
        Property("id", required=True),
        Property("reason"),
        Property("file", required=True),
        Property("range"),
        Property("status", required=True, values=NODE_STATUS),
    )),
    "META_DATA": NodeSpec("META_DATA", cpg=False, key="", write="merge", properties=(
        Property("schema_version", type="int", required=True),
        Property("engine_version", required=True),
        Property("overlays", type="list"),
        Property("created_at", required=True),
    )),
}

EDGE_SPECS = {
    "HAS_ENTRY": EdgeSpec("HAS_ENTRY", sources=("DIRECTORY",), targets=("DIRECTORY", "FILE"), write="move", properties=()),
    "DECLARES": EdgeSpec("DECLARES", sources=("MODULE", "TYPE_DECL", "METHOD"), targets=("TYPE_DECL", "METHOD", "MEMBER", "IMPORT"), write="create", properties=()),
    "HAS_PARAM": EdgeSpec("HAS_PARAM", sources=("METHOD",), targets=("PARAM",), write="create", properties=()),
    "DEFINES": EdgeSpec("DEFINES", sources=("MODULE", "TYPE_DECL", "METHOD", "MEMBER", "PARAM"), targets=("SYMBOL",), write="create", properties=()),
    "CALLS": EdgeSpec("CALLS", sources=("CALL",), targets=("SYMBOL",), write="create", properties=(
        Property("status", required=True, values=RESOLUTION_STATUS),
        Property("reason"),
        Property("confidence", type="float"),
        Property("resolvedBy"),
    )),
    "IN_SCOPE": EdgeSpec("IN_SCOPE", sources=("CALL",), targets=("METHOD", "MODULE"), write="create", properties=()),
    "IMPORTS": EdgeSpec("IMPORTS", sources=("IMPORT",), targets=("SYMBOL",), write="create", properties=(
        Property("status", required=True, values=RESOLUTION_STATUS),
    )),
    "INHERITS_FROM": EdgeSpec("INHERITS_FROM", sources=("TYPE_DECL",), targets=("SYMBOL",), write="create", properties=(
        Property("relation", required=True, values=INHERITS_RELATION),
    )),
    "MEMBER_OF": EdgeSpec("MEMBER_OF", sources=("FILE", "METHOD", "TYPE_DECL"), targets=("COMMUNITY",), write="overlay", properties=(
        Property("run_id", required=True),
    )),
    "ALIAS_OF": EdgeSpec("ALIAS_OF", sources=("SYMBOL",), targets=("SYMBOL",), write="merge", properties=()),
    "TAGGED_BY": EdgeSpec("TAGGED_BY", sources=("SYMBOL", "MEMBER", "CALL"), targets=("TAG",), write="merge", properties=()),
    "TARGETS": EdgeSpec("TARGETS", sources=("CALL", "IMPORT", "TYPE_DECL"), targets=("METHOD", "TYPE_DECL"), write="overlay", properties=(
        Property("computed_at", required=True),
        Property("run_id", required=True),
    )),
    "DEPENDS_ON": EdgeSpec("DEPENDS_ON", sources=("FILE",), targets=("FILE",), write="overlay", properties=(
        Property("computed_at", required=True),
        Property("run_id", required=True),
    )),
    "REACHING_DEF": EdgeSpec("REACHING_DEF", sources=("MEMBER", "PARAM"), targets=("CALL",), write="create", properties=(
        Property("variable", required=True),
    )),
}

INDEXES = (("CPG", "id"), ("CPG", "file"), ("FILE", "path"), ("DIRECTORY", "path"), ("SYMBOL", "fqn"))
CONSTRAINTS = (("SYMBOL", "fqn"),)


def struct(spec: NodeSpec | EdgeSpec) -> T.StructType:
    """The typed row of a label or edge type."""
    return T.StructType([T.StructField(p.name, TYPES[p.type], not p.required) for p in spec.properties])


def to_json() -> str:
    """A deterministic JSON form."""
    def one(spec) -> dict:
        return {k: ([vars(p) | {"values": list(p.values)} for p in sorted(v, key=lambda p: p.name)] if k == "properties" else list(v) if isinstance(v, tuple) else v) for k, v in vars(spec).items()}

    return json.dumps({"version": VERSION, "nodes": {k: one(v) for k, v in NODE_SPECS.items()}, "edges": {k: one(v) for k, v in EDGE_SPECS.items()}, "indexes": [list(x) for x in INDEXES], "constraints": [list(x) for x in CONSTRAINTS]}, sort_keys=True, indent=1)


def document(text: str, name: str, body: str) -> str:
    """``text`` with the section between ``<!-- name:begin -->`` and ``<!-- name:end -->`` replaced."""
    begin, end = f"<!-- {name}:begin -->", f"<!-- {name}:end -->"
    if begin not in text or end not in text:
        raise ValueError(f"no section {name}")
    return text[: text.index(begin) + len(begin)] + f"\n{body}\n" + text[text.index(end) :]


def tables() -> str:
    """The labels and edge types as Markdown tables."""
    lines = ["| label | key | write | properties |", "|-|-|-|-|"]
    lines += [f"| {s.label} | {s.key} | {s.write} | {', '.join(p.name + '*' * p.required for p in s.properties)} |" for s in NODE_SPECS.values()]
    lines += ["", "| type | from | to | write |", "|-|-|-|-|"]
    lines += [f"| {s.type} | {', '.join(s.sources)} | {', '.join(s.targets)} | {s.write} |" for s in EDGE_SPECS.values()]
    return "\n".join(lines)
