"""Extraction of one Python file's records with the standard library's ast.

Pure functions from source text to lists of records; offsets are UTF-8 bytes of the decoded text. A file that doesn't
parse yields no records but an error flag, so its row in the files table remains.
"""

from __future__ import annotations

import ast
import hashlib
import re
import warnings
from dataclasses import dataclass, field

from graphloom.sources.spans import Nest

FUNCTION, CLASS, VARIABLE = "function", "class", "global_variable"


@dataclass
class Extracted:
    symbols: list[dict] = field(default_factory=list)
    imports: list[dict] = field(default_factory=list)
    candidates: list[dict] = field(default_factory=list)
    calls: list[dict] = field(default_factory=list)
    parameters: list[dict] = field(default_factory=list)
    statements: list[dict] = field(default_factory=list)
    bases: list[dict] = field(default_factory=list)
    tokens: list[dict] = field(default_factory=list)
    members: list[dict] = field(default_factory=list)
    identifiers: list[dict] = field(default_factory=list)
    strings: list[dict] = field(default_factory=list)
    all_names: list[str] | None = None
    has_error: bool = False


class Offsets:
    """Byte offsets of (line, byte column) positions."""

    def __init__(self, data: bytes):
        self.data, self.starts, at = data, [0], -1
        for m in re.finditer(rb"\r\n|\r|\n|\x0c", data):  # as the tokenizer counts lines; a form feed starts none
            if m[0] != b"\x0c":
                self.starts.append(m.end())

    def of(self, line: int, col: int) -> int:
        return self.starts[line - 1] + col

    def span(self, node: ast.AST) -> dict:
        return self.range(node.lineno, node.col_offset, node.end_lineno, node.end_col_offset)

    def range(self, l1: int, c1: int, l2: int, c2: int) -> dict:
        return {"start_byte": self.of(l1, c1), "end_byte": self.of(l2, c2), "start_row": l1 - 1, "start_column": c1, "end_row": l2 - 1, "end_column": c2}


def clean(text: str | None) -> str | None:
    """Text whose lone surrogates, which a literal may hold, are written as escapes."""
    return None if text is None else text.encode("utf-8", "backslashreplace").decode()


def dotted(node: ast.expr) -> str | None:
    """a.b.c of a chain of names."""
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *reversed(parts)]) if isinstance(node, ast.Name) else None


def targets(node: ast.expr) -> list[ast.Name]:
    if isinstance(node, ast.Name):
        return [node]
    if isinstance(node, (ast.Tuple, ast.List)):
        return [n for e in node.elts for n in targets(e)]
    return targets(node.value) if isinstance(node, ast.Starred) else []


def pattern_names(node: ast.AST) -> list[str]:
    out = []
    for n in ast.walk(node):
        if isinstance(n, (ast.MatchAs, ast.MatchStar)) and n.name:
            out.append(n.name)
        if isinstance(n, ast.MatchMapping) and n.rest:
            out.append(n.rest)
    return out


def all_parameters(a: ast.arguments) -> list[tuple[ast.arg, str]]:
    out = [(p, "positional_only") for p in a.posonlyargs] + [(p, "positional") for p in a.args]
    if a.vararg:
        out.append((a.vararg, "variadic"))
    out += [(p, "keyword_only") for p in a.kwonlyargs]
    if a.kwarg:
        out.append((a.kwarg, "keywords"))
    return out


BRANCH = {ast.If: "if", ast.For: "for", ast.AsyncFor: "for", ast.While: "while", ast.ExceptHandler: "except", ast.IfExp: "ternary", ast.match_case: "case"}
STATEMENT = {
    ast.Assign: "assignment", ast.AnnAssign: "assignment", ast.AugAssign: "assignment", ast.Return: "return", ast.Raise: "raise", ast.With: "with", ast.AsyncWith: "with", ast.Pass: "pass",
    ast.Break: "break", ast.Continue: "continue", ast.Try: "try", ast.If: "if", ast.For: "for", ast.AsyncFor: "for", ast.While: "while", ast.Match: "switch", ast.FunctionDef: "symbol",
    ast.AsyncFunctionDef: "symbol", ast.ClassDef: "symbol", ast.Import: "import", ast.ImportFrom: "import", ast.Expr: "expression",
}


class Extractor:
    def __init__(self, source: str):
        self.out = Extracted()
        self.data = source.encode("utf-8", "surrogatepass")
        self.at = Offsets(self.data)
        self.source = source
        self.bindings: dict[int, set[str]] = {}
        self.globals: dict[int, set[str]] = {}
        self.scopes: list[tuple[int, int, int, set[str]]] = []  # symbol, start, end, names
        self.nest: tuple[int, Nest] | None = None
        self.named_at: set[int] = set()
        self.of_node: dict[int, int] = {}

    def run(self) -> Extracted:
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")  # of odd escapes in the sources
                tree = ast.parse(self.source)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            self.out.has_error = True
            return self.out
        for node in tree.body:
            self.top_level(node)
        for node in tree.body:
            if not isinstance(node, (ast.Import, ast.ImportFrom)):
                self.nested_imports(node)
        for s in self.out.symbols:
            self.bindings.setdefault(s["id"], set())
        self.bind(tree, None)
        for sid, names in self.globals.items():
            self.bindings.get(sid, set()).difference_update(names)
        self.visit(tree)
        self.statement_rows(tree.body, None, 0)
        return self.out

    # symbols -----------------------------------------------------------------------------------------------------
    def add_symbol(self, name: str, kind: str, span: dict, name_at: int, parent: int | None, **more) -> int:
        sid = len(self.out.symbols)
        end = name_at + len(name.encode())
        self.named_at.add(name_at)
        self.out.symbols.append(
            {"id": sid, "parent": parent, "is_top_level": parent is None, "name": name, "kind": kind, "range": span, "name_start": name_at, "name_end": end, "is_async": False, "decorators": [], "docstring": None, "returns": None} | more
        )
        return sid

    def definition(self, node, parent: int | None) -> None:
        span = self.at.span(node)
        if node.decorator_list:
            first = min(node.decorator_list, key=lambda d: (d.lineno, d.col_offset))
            at = self.data.rfind(b"@", 0, self.at.of(first.lineno, first.col_offset))
            row = self.data.count(b"\n", 0, at)
            span = span | {"start_byte": at, "start_row": row, "start_column": at - (self.data.rfind(b"\n", 0, at) + 1)}
        is_class = isinstance(node, ast.ClassDef)
        begin = self.at.of(node.lineno, node.col_offset)
        m = re.compile(rb"(?:async\s+)?(?:def|class)\s+").match(self.data, begin)
        sid = self.add_symbol(
            node.name, CLASS if is_class else FUNCTION, span, m.end() if m else begin, parent,
            is_async=isinstance(node, ast.AsyncFunctionDef), decorators=[ast.unparse(d) for d in node.decorator_list], docstring=clean(ast.get_docstring(node)),
            returns=None if is_class or node.returns is None else ast.unparse(node.returns), **self.parts(node, m.end() if m else begin),
        )
        self.of_node[id(node)] = sid
        if is_class:
            self.attributes(node, sid)
            for pos, b in enumerate(node.bases):
                self.out.bases.append({"symbol_id": sid, "pos": pos, "name": dotted(b) or ast.unparse(b), **{f"r_{k}": v for k, v in self.at.span(b).items() if k.endswith("byte")}})
        else:
            defaults = len(node.args.defaults)
            plain = node.args.posonlyargs + node.args.args
            for pos, (p, kind) in enumerate(all_parameters(node.args)):
                has = p in plain[len(plain) - defaults :] if kind.startswith("positional") else kind == "keyword_only" and node.args.kw_defaults[node.args.kwonlyargs.index(p)] is not None
                self.out.parameters.append({"symbol_id": sid, "pos": pos, "name": p.arg, "kind": kind, "annotation": None if p.annotation is None else ast.unparse(p.annotation), "has_default": bool(has), "start_byte": self.at.of(p.lineno, p.col_offset), "end_byte": self.at.of(p.lineno, p.col_offset) + len(p.arg.encode())})
        for child in node.body:
            self.nested(child, sid)

    def parts(self, node, name_at: int) -> dict:
        """Where the return annotation is or would go, where the body begins, and the docstring's span."""
        first = node.body[0]
        out = {"body_start": self.at.of(first.lineno, first.col_offset)}
        if getattr(first, "decorator_list", None):
            out["body_start"] = self.data.rfind(b"@", 0, self.at.span(first.decorator_list[0])["start_byte"])
        if isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str):
            r = self.at.span(first)
            out |= {"doc_start": r["start_byte"], "doc_end": r["end_byte"]}
        if isinstance(node, ast.ClassDef):
            return out
        if node.returns is not None:
            r = self.at.span(node.returns)
            return out | {"returns_start": r["start_byte"], "returns_end": r["end_byte"]}
        # without an annotation: after the parenthesis that closes the parameters
        known = [self.at.span(p)["end_byte"] for p, _ in all_parameters(node.args)] + [self.at.span(d)["end_byte"] for d in [*node.args.defaults, *node.args.kw_defaults] if d is not None]
        at = max(known, default=name_at)
        m = re.compile(rb"(?:[^)#]|#[^\n]*)*\)").match(self.data, at)
        return out | ({"returns_start": m.end(), "returns_end": m.end()} if m else {})

    def attributes(self, node: ast.ClassDef, sid: int) -> None:
        """Names assigned in a class body, with annotation and value."""
        for child in node.body:
            if not isinstance(child, (ast.Assign, ast.AnnAssign)):
                continue
            annotation = ast.unparse(child.annotation) if isinstance(child, ast.AnnAssign) else None
            value = None if child.value is None else ast.unparse(child.value)
            for t in child.targets if isinstance(child, ast.Assign) else [child.target]:
                for n in targets(t):
                    self.out.members.append({"symbol_id": sid, "pos": len(self.out.members), "name": n.id, "kind": "attribute", "annotation": annotation, "value": value, "is_optional": annotation is not None and annotation.startswith("Optional["), "is_static": True, "range": self.at.span(child)})

    def nested(self, node: ast.AST, parent: int) -> None:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            self.definition(node, parent)
            return
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.stmt, ast.ExceptHandler, ast.match_case)):
                self.nested(child, parent)

    def top_level(self, node: ast.stmt) -> None:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            self.definition(node, None)
        elif isinstance(node, (ast.Import, ast.ImportFrom)):
            self.imports(node)
        elif isinstance(node, (ast.Assign, ast.AnnAssign)):
            for t in node.targets if isinstance(node, ast.Assign) else [node.target]:
                for n in targets(t):
                    self.add_symbol(n.id, VARIABLE, self.at.span(node), self.at.of(n.lineno, n.col_offset), None)
                    if n.id == "__all__":
                        self.static_all(node.value)

    def static_all(self, value: ast.expr | None) -> None:
        if isinstance(value, (ast.List, ast.Tuple, ast.Set)) and all(isinstance(e, ast.Constant) and isinstance(e.value, str) for e in value.elts):
            self.out.all_names = sorted({clean(e.value) for e in value.elts})

    # imports -----------------------------------------------------------------------------------------------------
    def imports(self, node) -> None:
        span = self.at.span(node)
        if isinstance(node, ast.Import):
            rows = [("import", None, a) for a in node.names]
        else:
            module = "." * node.level + (node.module or "")
            kind = "future_import" if module == "__future__" else "from_import"
            rows = [(kind, module, a) for a in node.names]
        for kind, module, a in rows:
            at = self.at.of(a.lineno, a.col_offset)
            self.out.imports.append({"id": len(self.out.imports), "kind": kind, "module": module, "name": a.name, "alias": a.asname, "range": span, "name_start": at, "name_end": at + len(a.name.encode())})

    def nested_imports(self, node: ast.AST) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.Import, ast.ImportFrom)):
                self.imports(child)
            elif isinstance(child, (ast.stmt, ast.ExceptHandler, ast.match_case)):
                self.nested_imports(child)

    # bindings ----------------------------------------------------------------------------------------------------
    def owner(self, start: int, end: int) -> int | None:
        if self.nest is None or self.nest[0] != len(self.out.symbols):
            self.nest = (len(self.out.symbols), Nest([(s["range"]["start_byte"], s["range"]["end_byte"], s["id"]) for s in self.out.symbols]))
        return self.nest[1].innermost(start, end)

    def owner_of(self, node: ast.AST) -> int | None:
        r = self.at.span(node)
        return self.owner(r["start_byte"], r["end_byte"])

    def bind_names(self, owner: int | None, names) -> None:
        if owner is not None:
            self.bindings.setdefault(owner, set()).update(names)

    def bind(self, node: ast.AST, owner: int | None) -> None:
        for child in ast.iter_child_nodes(node):
            here = owner
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                self.bind_names(owner, [child.name])
                here = self.of_node.get(id(child), owner)
                if not isinstance(child, ast.ClassDef):
                    self.bind_names(here, [p.arg for p, _ in all_parameters(child.args)])
            elif isinstance(child, ast.Assign):
                self.bind_names(owner, [n.id for t in child.targets for n in targets(t)])
            elif isinstance(child, (ast.AnnAssign, ast.AugAssign)):
                self.bind_names(owner, [n.id for n in targets(child.target)])
            elif isinstance(child, (ast.For, ast.AsyncFor)):
                self.bind_names(owner, [n.id for n in targets(child.target)])
            elif isinstance(child, ast.withitem) and child.optional_vars is not None:
                self.bind_names(owner, [n.id for n in targets(child.optional_vars)])
            elif isinstance(child, ast.ExceptHandler) and child.name:
                self.bind_names(owner, [child.name])
            elif isinstance(child, ast.match_case):
                self.bind_names(owner, pattern_names(child.pattern))
            elif isinstance(child, ast.Nonlocal):
                self.bind_names(owner, child.names)
            elif isinstance(child, ast.Global) and owner is not None:
                self.globals.setdefault(owner, set()).update(child.names)
            elif isinstance(child, (ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp)):
                self.scope(child, [n.id for g in child.generators for n in targets(g.target)])
            elif isinstance(child, ast.Lambda):
                self.scope(child, [p.arg for p, _ in all_parameters(child.args)])
            self.bind(child, here)

    def scope(self, node: ast.AST, names: list[str]) -> None:
        r = self.at.span(node)
        owner = self.owner(r["start_byte"], r["end_byte"])
        if owner is not None and names:
            self.scopes.append((owner, r["start_byte"], r["end_byte"], set(names)))

    def shadowed(self, owner: int | None, name: str, start: int, end: int) -> bool:
        if owner is None:
            return False
        if name in self.bindings.get(owner, ()):
            return True
        return any(o == owner and a <= start and end <= b and name in names for o, a, b, names in self.scopes)

    # candidates, calls, metrics ------------------------------------------------------------------------------------
    def candidate(self, name: str, qualifier: str | None, span: dict, call: dict | None, subclass: bool) -> None:
        owner = self.owner(span["start_byte"], span["end_byte"])
        root = name if qualifier is None else qualifier.split(".")[0]
        if self.shadowed(owner, root, span["start_byte"], span["end_byte"]):
            return
        self.out.candidates.append({"source": owner, "name": name, "qualifier": qualifier, "range": span, "is_subclass": subclass})

    def visit(self, node: ast.AST, subclass: bool = False) -> None:
        if isinstance(node, (ast.Import, ast.ImportFrom, ast.Global, ast.Nonlocal)):
            return
        if isinstance(node, ast.Call):
            self.call(node)
        self.measure(node)
        if isinstance(node, ast.Attribute):
            r = self.at.span(node)
            width = len(node.attr.encode())
            span = self.at.range(node.end_lineno, node.end_col_offset - width, node.end_lineno, node.end_col_offset)
            base = dotted(node.value)
            if base is not None:
                self.candidate(node.attr, base, span, None, subclass)
            self.visit(node.value)
            return
        if isinstance(node, (ast.Name, ast.arg, ast.keyword)):
            self.identifier(node)
        if isinstance(node, ast.Constant) and isinstance(node.value, str) and hasattr(node, "lineno"):
            r = self.at.span(node)
            self.out.strings.append({"symbol_id": self.owner(r["start_byte"], r["end_byte"]), "value": clean(node.value), "start_byte": r["start_byte"], "end_byte": r["end_byte"]})
        if isinstance(node, ast.Name):
            if not (isinstance(node.ctx, ast.Store) and self.is_definition(node)):
                self.candidate(node.id, None, self.at.span(node), None, subclass)
            return
        if isinstance(node, ast.ClassDef):
            for d in node.decorator_list:
                self.visit(d)
            for b in node.bases:
                self.visit(b, subclass=True)
            for k in node.keywords:
                self.visit(k)
            for child in node.body:
                self.visit(child)
            return
        for child in ast.iter_child_nodes(node):
            self.visit(child)

    def identifier(self, node) -> None:
        if isinstance(node, ast.keyword) and node.arg is None:
            return
        name = node.id if isinstance(node, ast.Name) else node.arg
        role = "parameter" if isinstance(node, ast.arg) else "keyword" if isinstance(node, ast.keyword) else {ast.Store: "store", ast.Del: "delete"}.get(type(node.ctx), "load")
        at = self.at.of(node.lineno, node.col_offset)
        end = at + len(name.encode())
        self.out.identifiers.append({"symbol_id": self.owner(at, end), "name": name, "role": role, "start_byte": at, "end_byte": end})

    def is_definition(self, node: ast.Name) -> bool:
        return self.at.of(node.lineno, node.col_offset) in self.named_at

    def call(self, node: ast.Call) -> None:
        r = self.at.span(node)
        f = node.func
        name = f.attr if isinstance(f, ast.Attribute) else f.id if isinstance(f, ast.Name) else None
        base = dotted(f.value) if isinstance(f, ast.Attribute) else None
        owner = self.owner(r["start_byte"], r["end_byte"])
        end = self.at.of(f.end_lineno, f.end_col_offset)
        self.out.calls.append(
            {
                "id": len(self.out.calls), "source": owner, "name": name, "qualifier": base, "range": r, "name_start": end - len((name or "").encode()), "name_end": end,
                "arguments": [{"pos": i, "name": None, "value": ast.unparse(a), "start_byte": self.at.span(a)["start_byte"], "end_byte": self.at.span(a)["end_byte"]} for i, a in enumerate(node.args)]
                + [{"pos": len(node.args) + i, "name": k.arg, "value": ast.unparse(k.value), "start_byte": self.at.span(k)["start_byte"], "end_byte": self.at.span(k)["end_byte"]} for i, k in enumerate(node.keywords)],
            }
        )

    def measure(self, node: ast.AST) -> None:
        """Branches, operators and operands of the innermost symbol."""
        kind = BRANCH.get(type(node))
        rows = [("branch", kind)] if kind else []
        if isinstance(node, ast.BoolOp):
            word = "and" if isinstance(node.op, ast.And) else "or"
            rows += [("branch", word)] * (len(node.values) - 1) + [("operator", word)] * (len(node.values) - 1)
        elif isinstance(node, ast.BinOp) or isinstance(node, ast.UnaryOp):
            rows.append(("operator", type(node.op).__name__))
        elif isinstance(node, ast.Compare):
            rows += [("operator", type(o).__name__) for o in node.ops]
        elif isinstance(node, ast.AugAssign):
            rows.append(("operator", type(node.op).__name__ + "="))
        elif isinstance(node, ast.Name):
            rows.append(("operand", node.id))
        elif isinstance(node, ast.Constant) and hasattr(node, "lineno"):
            text = repr(node.value)  # a long one goes by its hash
            rows.append(("operand", text if len(text) <= 64 else f"sha256:{hashlib.sha256(text.encode('utf-8', 'surrogatepass')).hexdigest()}"))
        if not rows:
            return
        if not hasattr(node, "lineno"):
            node = node.pattern if isinstance(node, ast.match_case) else node
        owner = self.owner_of(node)
        self.out.tokens += [{"symbol_id": owner, "group": g, "token": v} for g, v in rows]

    def statement_rows(self, body: list[ast.stmt], parent: int | None, level: int) -> None:
        for pos, node in enumerate(body):
            sid = len(self.out.statements)
            self.out.statements.append({"id": sid, "parent": parent, "pos": pos, "level": level, "kind": STATEMENT.get(type(node), "unspecified"), "symbol_id": self.owner_of(node), "range": self.at.span(node)})
            for name in ("body", "orelse", "finalbody"):
                inner = getattr(node, name, None)
                if isinstance(inner, list) and inner and isinstance(inner[0], ast.stmt):
                    self.statement_rows(inner, sid, level + 1)
            for h in [*getattr(node, "handlers", []), *getattr(node, "cases", [])]:
                self.statement_rows(h.body, sid, level + 1)


def extract(source: str) -> Extracted:
    """All records of one file."""
    return Extractor(source).run()
