"""Python source files to facts: symbols and raw edges of one file, without knowledge of others.

The facts of a file come from its syntax tree alone; references that it can't bind itself carry the
name, the receiver and the import path that resolution needs.
"""

from __future__ import annotations

import ast
import builtins
import hashlib
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import DYNAMIC, EDGE_KINDS, EXTERNAL, MODULE, PROVENANCES, SYMBOL_KINDS, WILDCARD, symbol_id

_BUILTINS = frozenset(n for n in dir(builtins) if not n.startswith("__") or n in ("__import__", "__build_class__"))
_HEADER = re.compile(r"^(\s*)(?:async\s+)?(def|class)\s+(\w+)")
_QUALIFIER_MAX = 80
FACTS = (
    "path string, lang string, content_hash string, parse_ok boolean, "
    "symbols array<struct<id:string,path:string,lang:string,name:string,qualified:string,kind:string,start_line:int,end_line:int,"
    "start_byte:int,end_byte:int,exported:boolean,signature:string,parent:string,is_test:boolean>>, "
    "edges array<struct<path:string,idx:int,lang:string,src:string,kind:string,site_line:int,dst_id:string,name:string,"
    "key_name:string,qualifier:string,import_path:string,prov:string>>"
)


def module_path(path: str) -> tuple[str, list[str]]:
    """Dotted module name of a file, and the package that relative imports start from."""
    stem = re.sub(r"\.pyi?$", "", path.removeprefix("./"))
    parts = [p for p in stem.split("/") if p]
    init = bool(parts) and parts[-1] == "__init__"
    if init and len(parts) > 1:
        parts = parts[:-1]
    return ".".join(parts), parts if init else parts[:-1]


def is_test_path(path: str) -> bool:
    *dirs, name = [p for p in path.split("/") if p] or [""]
    stem = re.sub(r"\.pyi?$", "", name)
    return any(d in ("tests", "test") for d in dirs) or stem.startswith("test_") or stem.endswith("_test") or stem == "conftest"


def is_public(name: str) -> bool:
    return not name.startswith("_") or (name.startswith("__") and name.endswith("__"))


def key_name(name: str, import_path: str | None) -> str:
    """The name a reference is looked up by: module targets by their last path segment."""
    if name in (MODULE, WILDCARD) and import_path:
        return re.split(r"[.:]", import_path)[-1]
    return name


@dataclass
class _Binding:
    path: str
    is_module: bool
    external: bool

    def to(self, *suffix: str) -> str:
        return (EXTERNAL if self.external else "") + ".".join((self.path, *suffix))


@dataclass
class _Scope:
    kind: str
    qualified: str
    id: str
    parent: _Scope | None
    exported: bool
    is_test: bool
    members: dict[str, _Scope] = field(default_factory=dict)
    imports: dict[str, _Binding] = field(default_factory=dict)


class _Extractor:
    """Walks the tree twice: definitions and imports first, then references to them."""

    def __init__(self, path: str, source: bytes, tree: ast.Module, headers: dict[int, str]):
        self.path, self.source, self.tree, self.headers = path, source, tree, headers
        self.line_start = [0]
        for line in source.splitlines(keepends=True):
            self.line_start.append(self.line_start[-1] + len(line))
        name, self.package = module_path(path)
        qualified = name or path
        lines = source.count(b"\n") + (not source.endswith(b"\n"))
        self.module = _Scope("module", name, symbol_id("python", path, qualified, "module"), None, True, is_test_path(path))
        self.symbols = [
            self._symbol(self.module.id, name.split(".")[-1] or qualified, qualified, "module", 1, max(1, lines), 0, len(source), True, "", None, self.module.is_test)
        ]
        self.edges: list[tuple] = []
        self.overloads: dict[tuple[str, str], int] = {}
        self.scopes: dict[ast.AST, _Scope] = {}
        self.exports = self._exports()

    def _symbol(self, id_, name, qualified, kind, l0, l1, b0, b1, exported, signature, parent, is_test) -> dict:
        return dict(
            id=id_, path=self.path, lang="python", name=name, qualified=qualified, kind=kind, start_line=l0, end_line=l1,
            start_byte=b0, end_byte=b1, exported=exported, signature=signature, parent=parent, is_test=is_test,
        )

    def at(self, line: int, col: int) -> int:
        return self.line_start[line - 1] + col

    def text(self, node: ast.AST) -> str:
        raw = self.source[self.at(node.lineno, node.col_offset) : self.at(node.end_lineno, node.end_col_offset)]
        return " ".join(raw.decode("utf-8", "replace").split())

    def _short(self, node: ast.AST) -> str:
        s = self.text(node)
        return s if len(s) <= _QUALIFIER_MAX else s[:_QUALIFIER_MAX] + "…"

    def _exports(self) -> set[str] | None:
        out = None
        for stmt in self.tree.body:
            targets = stmt.targets if isinstance(stmt, ast.Assign) else [stmt.target] if isinstance(stmt, (ast.AnnAssign, ast.AugAssign)) else []
            if any(isinstance(t, ast.Name) and t.id == "__all__" for t in targets) and isinstance(stmt.value, (ast.List, ast.Tuple)):
                out = {e.value for e in stmt.value.elts if isinstance(e, ast.Constant) and isinstance(e.value, str) and e.value}
        return out

    # --- definitions and imports ---

    def define(self, node: ast.AST, scope: _Scope) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                own = self._definition(child, scope)
                self.scopes[child] = own
                self.define(child, own)
            else:
                if isinstance(child, (ast.Import, ast.ImportFrom)):
                    self._import(child, scope)
                self.define(child, scope)

    def _definition(self, node, scope: _Scope) -> _Scope:
        kind = "class" if isinstance(node, ast.ClassDef) else "method" if scope.kind == "class" else "function"
        qualified = f"{scope.qualified}.{node.name}" if scope.qualified else node.name
        overload = self.overloads.get((qualified, kind), 0)
        self.overloads[qualified, kind] = overload + 1
        exported = node.name in self.exports if scope is self.module and self.exports is not None else scope.exported and is_public(node.name)
        own = _Scope(
            kind, qualified, symbol_id("python", self.path, qualified, kind, overload), scope, exported,
            scope.is_test or node.name.startswith("Test" if kind == "class" else "test"),
        )
        scope.members[node.name] = own
        start, first_line = self.at(node.lineno, node.col_offset), node.lineno
        if node.decorator_list:
            d = node.decorator_list[0]
            start = self.source.rfind(b"@", 0, self.at(d.lineno, d.col_offset))
            first_line = self.source.count(b"\n", 0, start) + 1
        self.symbols.append(
            self._symbol(
                own.id, node.name, qualified, kind, first_line, node.end_lineno, start, self.at(node.end_lineno, node.end_col_offset),
                exported, self._signature(node), scope.id, own.is_test,
            )
        )
        self._edge(scope, own.id, None, "contains", first_line)
        return own

    def _signature(self, node) -> str:
        if node.lineno in self.headers:
            return self.headers[node.lineno]
        body = node.body[0]
        first = min([body, *getattr(body, "decorator_list", [])], key=lambda n: (n.lineno, n.col_offset))
        raw = self.source[self.at(node.lineno, node.col_offset) : self.at(first.lineno, first.col_offset)].decode("utf-8", "replace")
        lines = [line for line in raw.split("\n") if not line.strip().startswith(("#", "@"))]
        head = re.sub(r":\s*#[^\n]*$", ":", "\n".join(lines).rstrip())
        return " ".join(head.split()).rstrip(":").rstrip()

    def _import(self, node: ast.Import | ast.ImportFrom, scope: _Scope) -> None:
        if isinstance(node, ast.Import):
            for a in node.names:
                target = _Binding(a.name, True, self._stdlib(a.name))
                self._edge(scope, None, (MODULE, None, target.to()), "imports", node.lineno)
                head = a.name.split(".")[0]
                scope.imports[a.asname or head] = target if a.asname else _Binding(head, True, target.external)
            return
        base = node.module or ""
        if node.level:
            keep = self.package[: max(0, len(self.package) - node.level + 1)]
            base = ".".join([*keep, *([base] if base else [])])
        external = not node.level and self._stdlib(base)
        for a in node.names:
            if a.name == "*":
                self._edge(scope, None, (WILDCARD, None, _Binding(base, True, external).to()), "imports", node.lineno)
                continue
            bound = _Binding(f"{base}.{a.name}" if base else a.name, False, external)
            self._edge(scope, None, (a.name, None, bound.to()), "imports", node.lineno)
            scope.imports[a.asname or a.name] = bound

    @staticmethod
    def _stdlib(dotted: str) -> bool:
        return dotted.split(".")[0] in sys.stdlib_module_names

    # --- references ---

    def refer(self, node: ast.AST, scope: _Scope) -> None:
        """Edges of everything below ``node``, which is in ``scope``."""
        for child in ast.iter_child_nodes(node):
            own = self.scopes.get(child)
            if own is None:
                if isinstance(child, ast.Call):
                    self._reference(child.func, scope, scope, "calls", child.lineno)
                self.refer(child, scope)
                continue
            for d in child.decorator_list:  # decorators stand outside the definition
                call = isinstance(d, ast.Call)
                self._reference(d.func if call else d, own, scope, "references", d.lineno)
                self.refer(d, scope)
            if isinstance(child, ast.ClassDef):
                for b in child.bases:
                    if not isinstance(b, ast.Starred):
                        self._reference(b.value if isinstance(b, ast.Subscript) else b, own, scope, "inherits", b.lineno)
            saved, child.decorator_list = child.decorator_list, []
            self.refer(child, own)
            child.decorator_list = saved

    def _reference(self, expr: ast.AST, src: _Scope, scope: _Scope, kind: str, line: int) -> None:
        dst, target, prov = self._target(expr, scope)
        self._edge(src, dst, target, kind, line, prov)

    def _target(self, expr: ast.AST, scope: _Scope) -> tuple[str | None, tuple | None, str]:
        if isinstance(expr, ast.Name):
            found = self._lookup(expr.id, scope)
            if isinstance(found, _Scope):
                return found.id, None, "extracted"
            if isinstance(found, _Binding):
                return None, (MODULE if found.is_module else found.path.split(".")[-1], None, found.to()), "extracted"
            external = f"{EXTERNAL}builtins.{expr.id}" if expr.id in _BUILTINS else None
            return None, (expr.id, None, external), "extracted"
        if not isinstance(expr, ast.Attribute):
            return None, (DYNAMIC, self._short(expr), None), "extracted"
        receiver = self._short(expr.value)
        chain = self._chain(expr.value)
        if chain:
            if chain in (["self"], ["cls"]):
                cls = self._class_of(scope)
                member = cls.members.get(expr.attr) if cls else None
            else:
                found = self._lookup(chain[0], scope)
                if isinstance(found, _Binding):
                    return None, (expr.attr, receiver, found.to(*chain[1:], expr.attr)), "extracted"
                local = isinstance(found, _Scope) and found.kind == "class" and len(chain) == 1
                member = found.members.get(expr.attr) if local else None
            if member:
                return member.id, None, "resolved"
        return None, (expr.attr, receiver, None), "extracted"

    def _chain(self, expr: ast.AST) -> list[str] | None:
        parts: list[str] = []
        while isinstance(expr, ast.Attribute):
            parts.append(expr.attr)
            expr = expr.value
        return [expr.id, *reversed(parts)] if isinstance(expr, ast.Name) else None

    def _lookup(self, name: str, scope: _Scope) -> _Scope | _Binding | None:
        """Innermost binding; a class's names are seen only from directly inside it."""
        at: _Scope | None = scope
        while at is not None:
            if at is scope or at.kind != "class":
                found = at.members.get(name) or at.imports.get(name)
                if found:
                    return found
            at = at.parent
        return None

    @staticmethod
    def _class_of(scope: _Scope) -> _Scope | None:
        at: _Scope | None = scope
        while at is not None and at.kind != "method":
            at = at.parent
        return at.parent if at else None

    def _edge(self, src: _Scope, dst: str | None, target: tuple | None, kind: str, line: int, prov: str = "extracted") -> None:
        name, qualifier, import_path = target or (None, None, None)
        self.edges.append((src.id, kind, line, dst, name, qualifier, import_path, prov))

    def facts(self) -> tuple[list[dict], list[dict]]:
        self.define(self.tree, self.module)
        self.refer(self.tree, self.module)
        symbols = sorted(self.symbols, key=lambda s: (s["start_byte"], SYMBOL_KINDS.index(s["kind"]), s["qualified"]))

        def order(e):
            src, kind, line, dst, name, qualifier, path, prov = e
            tail = (0, dst, "", "") if dst else (1, name, qualifier or "", path or "")
            return (src, EDGE_KINDS.index(kind), line, *tail, PROVENANCES.index(prov))

        edges = []
        for src, kind, line, dst, name, qualifier, path, prov in sorted(dict.fromkeys(self.edges), key=order):
            edges.append(
                dict(
                    path=self.path, idx=len(edges), lang="python", src=src, kind=kind, site_line=line, dst_id=dst, name=name,
                    key_name=key_name(name, path) if name else None, qualifier=qualifier, import_path=path, prov=prov,
                )
            )
        return symbols, edges


def _parse(source: bytes) -> tuple[ast.Module, bytes, dict[int, str]]:
    """The tree; where a line doesn't parse, that of the source with the line replaced (a header by an
    empty definition of that name, anything else by nothing), and the replaced headers by line."""
    lines = source.split(b"\n")
    headers: dict[int, str] = {}
    tried: set[int] = set()
    while True:
        try:
            return ast.parse(b"\n".join(lines)), b"\n".join(lines), headers
        except (SyntaxError, ValueError) as e:
            at = min(max(getattr(e, "lineno", None) or 1, 1), len(lines))
            text = lines[at - 1].decode("utf-8", "replace")
            m = _HEADER.match(text)
            if m and at not in tried:
                headers[at] = " ".join(text.split()).rstrip(":").rstrip()
                lines[at - 1] = f"{m[1]}{m[2]} {m[3]}{'()' if m[2] == 'def' else ''}:".encode()
            elif at in tried or not text.strip():
                headers.clear()
                return ast.Module([], []), source, headers
            else:
                indent = text[: len(text) - len(text.lstrip())]
                lines[at - 1] = f"{indent}pass".encode()
            tried.add(at)
        except (RecursionError, MemoryError):
            return ast.Module([], []), source, {}


def extract(path: str, source: bytes) -> dict:
    """Facts of one file as a dictionary with the fields of ``FACTS``."""
    tree, parsed, headers = _parse(source)
    ok = parsed is source or parsed == source
    ok = ok and (bool(tree.body) or not source.strip() or not headers and _compiles(source))
    symbols, edges = _Extractor(path, parsed, tree, headers).facts()
    symbols[0]["end_byte"] = len(source)
    return dict(path=path, lang="python", content_hash=hashlib.sha256(source).hexdigest(), parse_ok=ok, symbols=symbols, edges=edges)


def _compiles(source: bytes) -> bool:
    try:
        ast.parse(source)
        return True
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False


def _extract_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame([extract(p, bytes(c) if c is not None else b"") for p, c in zip(b["path"], b["content"])], columns=["path", "lang", "content_hash", "parse_ok", "symbols", "edges"])


def extract_facts(files: DataFrame) -> DataFrame:
    """``files`` (path, content) to one row of facts each (fields of ``FACTS``), with the content's SHA-256."""
    return files.select("path", F.col("content").cast("binary").alias("content")).mapInPandas(_extract_batches, FACTS)


def file_table(facts: DataFrame) -> DataFrame:
    return facts.select("path", "lang", "content_hash", "parse_ok")


def symbol_table(facts: DataFrame) -> DataFrame:
    return facts.select(F.inline("symbols"))


def raw_edge_table(facts: DataFrame) -> DataFrame:
    return facts.select(F.inline("edges"))
