"""Extraction of one TypeScript or JavaScript file's records from its syntax tree.

Pure functions from source text to lists of records, as for Python: symbols, imports, exports, reference candidates that
no local binding shadows, calls, parameters, members, statements, JSX elements and promise chains.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import sys
from dataclasses import dataclass, field

from graphloom.sources.spans import Nest
from graphloom.sources.typescript_syntax import Node, parse

DECLARED = {"function_declaration": "function", "class_declaration": "class", "interface": "interface", "type_alias": "type_alias", "enum": "enum", "namespace": "namespace"}
FUNCTIONS = {"function_declaration", "function_expression", "arrow", "method"}
VALUE_FUNCTIONS = {"arrow", "function_expression"}
STAGES = ("then", "catch", "finally")
BRANCH = {"if": "if", "for": "for", "while": "while", "catch": "except", "ternary": "ternary", "case": "case"}
STATEMENT = {
    "variables": "assignment", "return": "return", "raise": "raise", "break": "break", "try": "try", "if": "if", "for": "for", "while": "while", "switch": "switch", "import": "import",
    "export": "export", "expression": "expression", "label": "labeled", "function_declaration": "symbol", "class_declaration": "symbol", "interface": "symbol", "type_alias": "symbol",
    "enum": "symbol", "namespace": "symbol",
}
MODULE_CALLS = ("require", "import")


@dataclass
class Extracted:
    symbols: list[dict] = field(default_factory=list)
    imports: list[dict] = field(default_factory=list)
    exports: list[dict] = field(default_factory=list)
    candidates: list[dict] = field(default_factory=list)
    calls: list[dict] = field(default_factory=list)
    parameters: list[dict] = field(default_factory=list)
    statements: list[dict] = field(default_factory=list)
    bases: list[dict] = field(default_factory=list)
    members: list[dict] = field(default_factory=list)
    identifiers: list[dict] = field(default_factory=list)
    strings: list[dict] = field(default_factory=list)
    tokens: list[dict] = field(default_factory=list)
    jsx_elements: list[dict] = field(default_factory=list)
    jsx_props: list[dict] = field(default_factory=list)
    promise_chains: list[dict] = field(default_factory=list)
    all_names: list[str] | None = None
    has_error: bool = False


def is_function_value(node: Node | None) -> bool:
    """An arrow or function expression, through parentheses."""
    while node is not None and node.kind == "paren" and node.kids:
        node = node.kids[0]
    return node is not None and node.kind in VALUE_FUNCTIONS


def dotted(node: Node) -> str | None:
    """a.b.c of a chain of names."""
    if node.kind in ("name", "type_name"):
        return node.text
    if node.kind == "member":
        base = dotted(node.kids[0])
        return None if base is None else f"{base}.{node.name.text}"
    if node.kind == "paren" and node.kids and node.kids[0].kind in ("name", "member"):
        return dotted(node.kids[0])
    return None


class Extractor:
    def __init__(self, text: str, path: str):
        self.text, self.out = text, Extracted()
        self.jsx = not path.endswith(".ts")
        self.ascii = text.isascii()
        self.lines = [0] + [m.end() for m in re.finditer("\n", text)]
        if not self.ascii:
            self.bytes = [0]
            for c in text:
                self.bytes.append(self.bytes[-1] + len(c.encode("utf-8", "surrogatepass")))
        self.nodes: dict[int, Node] = {}  # declaration node by symbol id
        self.nest: tuple[int, Nest] | None = None
        self.scopes: dict[str, list[tuple[int, int]]] = {}
        self.locals: dict[tuple[int, str], list[tuple[int, int]]] = {}  # (owner, name): (begin of the name, symbol)
        self.defined: set[int] = set()

    # places ------------------------------------------------------------------------------------------------------------
    def byte(self, i: int) -> int:
        return i if self.ascii else self.bytes[i]

    def range(self, node: Node) -> dict:
        r1, r2 = bisect.bisect_right(self.lines, node.start) - 1, bisect.bisect_right(self.lines, node.end) - 1
        b1, b2 = self.byte(node.start), self.byte(node.end)
        return {"start_byte": b1, "end_byte": b2, "start_row": r1, "start_column": b1 - self.byte(self.lines[r1]), "end_row": r2, "end_column": b2 - self.byte(self.lines[r2])}

    def source(self, node: Node | None) -> str | None:
        return None if node is None else self.text[node.start : node.end]

    def owner(self, start: int, end: int) -> int | None:
        """The innermost symbol whose declaration holds the characters; the first of several with one range."""
        if self.nest is None or self.nest[0] != len(self.nodes):
            self.nest = (len(self.nodes), Nest([(n.start, n.end, s) for s, n in self.nodes.items()]))
        return self.nest[1].innermost(start, end)

    # run ---------------------------------------------------------------------------------------------------------------
    def run(self) -> Extracted:
        root, errors = parse(self.text, self.jsx)
        self.out.has_error = errors > 0
        for node in root.kids:
            self.top_level(node)
        owners = {(n.start, n.end): s for s, n in reversed(self.nodes.items())}
        self.local_symbols(root, owners, None, 0)
        self.bind(root, None)
        self.visit(root)
        self.elements(root, None)
        self.chains(root, False)
        self.statement_rows(root.kids, None, 0)
        return self.out

    # symbols -----------------------------------------------------------------------------------------------------------
    def doc(self, node: Node) -> str | None:
        """The text of a /** */ comment that ends right before a declaration."""
        before = self.text[: node.start].rstrip()
        before = re.sub(r"\bexport(\s+default)?$", "", before).rstrip()
        if not before.endswith("*/"):
            return None
        at = before.rfind("/**")
        if at < 0 or "*/" in before[at:-2]:
            return None
        return "\n".join(re.sub(r"^\s*\* ?", "", x) for x in before[at + 3 : -2].split("\n")).strip()

    def add(self, name: Node, kind: str, node: Node, parent: int | None, function: Node | None = None) -> int:
        sid = len(self.out.symbols)
        f = function or node
        self.out.symbols.append(
            {
                "id": sid, "parent": parent, "is_top_level": parent is None, "name": name.text, "kind": kind, "range": self.range(node), "name_start": self.byte(name.start), "name_end": self.byte(name.end),
                "is_async": bool(f.info.get("async")), "decorators": [self.text[d.start + 1 : d.end] for d in node.info.get("decorators", [])], "docstring": self.doc(node), "returns": self.source(f.info.get("returns")), **self.parts(f),
            }
        )
        self.nodes[sid] = node
        self.defined.add(name.start)
        for pos, p in enumerate(f.info.get("parameters", []) if kind == "function" else []):
            pattern = p.info["pattern"]
            self.out.parameters.append({"symbol_id": sid, "pos": pos, "name": self.source(pattern), "kind": "variadic" if p.info["rest"] else "positional", "annotation": self.source(p.info["type"]), "has_default": p.info["default"] is not None or p.info["optional"], "start_byte": self.byte(pattern.start), "end_byte": self.byte(pattern.end)})
        heritage = [*node.info.get("extends", []), *node.info.get("implements", [])] if kind in ("class", "interface") else []
        for pos, b in enumerate(heritage):
            self.out.bases.append({"symbol_id": sid, "pos": pos, "name": re.sub(r"<.*", "", self.source(b), flags=re.S).strip(), "r_start_byte": self.byte(b.start), "r_end_byte": self.byte(b.end)})
        value = node.info.get("value") if kind == "type_alias" else None
        for pos, m in enumerate([x for x in (node.info.get("members") or self.type_members(value)) if x.name is not None] if kind in ("class", "interface", "enum", "type_alias") else []):
            self.out.members.append({"symbol_id": sid, "pos": pos, "name": m.name.text, "kind": "method" if m.kind == "method" else "attribute", "annotation": self.source(m.info.get("type") or m.info.get("returns")), "value": self.source(m.info.get("value")), "is_optional": bool(m.info.get("optional")), "is_static": "static" in m.info.get("modifiers", ()), "range": self.range(m)})
        return sid

    def parts(self, node: Node) -> dict:
        """Where the return type is or would go, and where the body's first character is."""
        body = next((k for k in node.kids if k.kind == "block"), None)
        out = {"body_start": self.byte(body.start + 1)} if body is not None else {}
        if node.info.get("returns") is not None:
            return out | {"returns_start": self.byte(node.info["returns"].start), "returns_end": self.byte(node.info["returns"].end)}
        at = node.info.get("signature_end")
        return out | ({"returns_start": self.byte(at), "returns_end": self.byte(at)} if at is not None else {})

    def type_members(self, value: Node | None) -> list[Node]:
        """Members of an object type, wherever it stands in a type alias."""
        return [] if value is None else [k for n in value.kids for k in n.kids if k.kind in ("attribute", "method")]

    def declare(self, node: Node, parent: int | None = None) -> list[int]:
        """Symbols of one declaration, with a namespace's members."""
        if node.kind in DECLARED:
            if node.name is None:
                return []
            sid = self.add(node.name, DECLARED[node.kind], node, parent)
            if node.kind == "namespace" and node.info["body"] is not None:
                for child in node.info["body"].kids:
                    inner = child.info["declaration"] if child.kind == "export" else child
                    if inner is not None:
                        self.declare(inner, sid)
            return [sid]
        if node.kind == "variables":
            out = []
            for d in node.kids:
                value = d.info["value"]
                function = is_function_value(value)
                while function and value.kind == "paren":
                    value = value.kids[0]
                for name in d.info["pattern"].info["names"]:
                    out.append(self.add(name, "function" if function else "global_variable", node, parent, value if function else None))
            return out
        return []

    def top_level(self, node: Node) -> None:
        if node.kind == "import":
            self.import_rows(node)
        elif node.kind == "export":
            self.export_rows(node)
        else:
            self.declare(node)
            if node.kind == "variables":
                self.dynamic_imports(node)

    def local_symbols(self, node: Node, owners: dict, current: int | None, depth: int) -> None:
        """Variables of functions that stand inside a symbol's own body."""
        own = owners.get((node.start, node.end)) if node.kind in DECLARED or node.kind == "variables" else None
        if own is not None:
            current, depth = own, 0
        elif current is not None and node.kind in FUNCTIONS:
            depth += 1
        if current is not None and depth:
            names, what = [], node
            if node.kind == "declarator":
                names = node.info["pattern"].info["names"]
            elif node.kind == "assign" and node.kids and node.kids[0].kind == "name":
                names = [node.kids[0]]
            for name in names:
                sid = len(self.out.symbols)
                self.add(name, "global_variable", what, current)
                self.locals.setdefault((current, name.text), []).append((name.start, sid))
        for k in node.kids:
            self.local_symbols(k, owners, current, depth)

    # imports and exports -----------------------------------------------------------------------------------------------
    def add_import(self, kind: str, module: str | None, name: str | None, alias: str | None, node: Node) -> int:
        at = node.name if node.kind == "specifier" else node if node.kind == "binding" else None
        places = {} if at is None else {"name_start": self.byte(at.start), "name_end": self.byte(at.end)}
        self.out.imports.append({"id": len(self.out.imports), "kind": kind, "module": module, "name": name, "alias": alias, "range": self.range(node), **places})
        return len(self.out.imports) - 1

    def import_rows(self, node: Node) -> None:
        info = node.info
        module = info["module"]
        if "equals" in info:
            name = info["default"].text
            found = self.module_of(info["equals"])
            if found:
                self.add_import("dynamic_import", found, name, name, node)
            return
        if not info["clause"] or not (info["default"] or info["named"] or info["namespace"]):
            self.add_import("side_effect", module, None, None, node)
            return
        if info["default"]:
            self.add_import("default_import", module, info["default"].text, info["default"].text, info["default"])
        for spec in info["named"]:
            alias = spec.info["alias"]
            self.add_import("named_import", module, spec.name.text, alias.text if alias else spec.name.text, spec)
        if info["namespace"]:
            self.add_import("namespace_import", module, "*", info["namespace"].name.text, info["namespace"])

    def module_of(self, node: Node | None) -> str | None:
        """The literal module of the first require() or import() in an expression."""
        for n in node.walk() if node is not None else ():
            if n.kind == "call" and n.info["callee"].kind == "name" and n.info["callee"].text in MODULE_CALLS:
                for a in n.info["arguments"]:
                    if a.kids and a.kids[0].kind == "string":
                        return a.kids[0].text
        return None

    def dynamic_imports(self, node: Node) -> None:
        for d in node.kids:
            module = self.module_of(d.info["value"])
            if module is not None:
                for name in d.info["pattern"].info["names"]:
                    self.add_import("dynamic_import", module, name.text, name.text, d)

    def add_export(self, kind: str, name: str | None, local: str | None, module: str | None, symbol: int | None, imported: int | None, node: Node) -> None:
        self.out.exports.append({"id": len(self.out.exports), "kind": kind, "name": name, "local_name": local, "source_module": module, "symbol_id": symbol, "import_id": imported, "range": self.range(node)})

    def export_rows(self, node: Node) -> None:
        info, form = node.info, node.info["form"]
        if info["declaration"] is not None:
            for sid in self.declare(info["declaration"]):
                name = self.out.symbols[sid]["name"]
                default = form == "default"
                self.add_export("default" if default else "named", "default" if default else name, name, None, sid, None, node)
        elif form == "named":
            for spec in info["named"]:
                local = spec.name.text
                name = spec.info["alias"].text if spec.info["alias"] else local
                imported = self.add_import("named_import", info["module"], local, name, spec) if info["module"] is not None else None
                self.add_export("default" if name == "default" else "named", name, local, info["module"], None, imported, node)
        elif form == "namespace":
            name = info["namespace"].name.text
            self.add_export("namespace", name, name, info["module"], None, self.add_import("namespace_import", info["module"], "*", name, info["namespace"]), node)
        elif form == "all":
            self.add_export("wildcard", None, None, info["module"], None, self.add_import("namespace_import", info["module"], "*", None, node), node)
        elif form == "default":
            self.add_export("default", "default", self.source(info["value"]), None, None, None, node)
        elif form == "equals":
            self.export_equals(node, info["value"])

    def export_equals(self, node: Node, value: Node) -> None:
        rows = []
        for p in value.kids if value.kind == "object" else ():
            if p.kind == "shorthand":
                rows.append((p.name.text, None))
            elif p.kind == "pair" and p.kids and p.kids[-1].kind == "name":
                rows.append((p.name.text, p.kids[-1].text))
        if not rows:
            name = value.text if value.kind == "name" else None
            rows = [(name, name)]
        for name, local in rows:
            self.add_export("export_equals", name, local, None, None, None, node)

    # bindings ----------------------------------------------------------------------------------------------------------
    def bind(self, node: Node, block: Node | None) -> None:
        """Names that a function, a block, a loop or a catch clause binds within itself; block: the innermost one."""
        if node.kind in FUNCTIONS:
            names = {n.text for p in node.info.get("parameters", []) for n in p.info["pattern"].info["names"]}
            if node.kind == "function_expression" and node.name is not None:
                names.add(node.name.text)
            self.scope(node, names)
        if node.info.get("type_parameters"):
            self.scope(node, {n.text for n in node.info["type_parameters"]})
        if node.kind == "catch" and "pattern" in node.info:
            self.scope(node, {n.text for n in node.info["pattern"].info["names"]})
        if node.kind == "for" and node.kids and node.kids[0].kind == "variables":
            self.scope(node, {n.text for d in node.kids[0].kids for n in d.info["pattern"].info["names"]})
        elif block is not None and node.kind == "variables":
            self.scope(block, {n.text for d in node.kids for n in d.info["pattern"].info["names"]})
        elif block is not None and node.kind in ("function_declaration", "class_declaration") and node.name is not None:
            self.scope(block, {node.name.text})
        inner = node if node.kind in ("block", "case", "default") else block
        if node.kind == "namespace":  # its members are symbols that a reference may mean
            for child in node.info["body"].kids if node.info["body"] else ():
                self.bind(child, None)
            return
        head = node.kids[0] if node.kind == "for" and node.kids and node.kids[0].kind == "variables" else None
        for k in node.kids:
            self.bind(k, None if k is head else inner)

    def scope(self, node: Node, names: set[str]) -> None:
        for name in names:
            self.scopes.setdefault(name, []).append((node.start, node.end))

    def shadowed(self, name: str, node: Node) -> bool:
        return any(a <= node.start and node.end <= b for a, b in self.scopes.get(name, ()))

    def local_target(self, source: int | None, name: str, at: int) -> int | None:
        """The last local symbol of a name that begins before a place, in the symbol or its parent."""
        if source is None:
            return None
        parent = self.out.symbols[source]["parent"]
        found = [sid for begin, sid in self.locals.get((source if parent is None else parent, name), ()) if begin < at]
        return found[-1] if found else None

    # references --------------------------------------------------------------------------------------------------------
    def candidate(self, node: Node, name: str, qualifier: str | None, subclass: bool) -> None:
        source = self.owner(node.start, node.end)
        root = name if qualifier is None else qualifier.split(".")[0]
        local = self.local_target(source, name, node.start) if qualifier is None else None
        if local is None and self.shadowed(root, node):
            return
        self.out.candidates.append({"source": source, "name": name, "qualifier": qualifier, "range": self.range(node), "is_subclass": subclass, "local": local})

    def visit(self, node: Node, subclass: bool = False) -> None:
        kind = node.kind
        if kind == "import" or (kind == "export" and node.info["declaration"] is None and node.info["value"] is None):
            return
        if kind in ("name", "type_name"):
            self.identifier(node, "load")
            if kind == "name":
                self.out.tokens.append({"symbol_id": self.owner(node.start, node.end), "group": "operand", "token": node.text})
            if node.start not in self.defined and node.text not in ("this", "super", "import", "undefined"):
                self.candidate(node, node.text, None, subclass)
            return
        if kind == "member":
            base = dotted(node.kids[0])
            if base is not None and node.name is not None:
                self.candidate(node.name, node.name.text, base, subclass)
            self.visit(node.kids[0])
            return
        if kind == "jsx" and node.name is not None:
            base, _, last = node.name.text.rpartition(".")
            first = (base or last)[0]
            if first.isupper() or first in "_$":
                at = Node("tag", node.name.end - len(last), node.name.end)
                self.candidate(at, last, base or None, False)
        if kind == "call":
            self.call(node, node.info["callee"])
        if kind in ("parameter", "declarator", "catch") and "pattern" in node.info:
            for n in node.info["pattern"].info["names"]:
                self.identifier(n, "parameter" if kind == "parameter" else "store")
        if kind == "string":
            self.out.strings.append({"symbol_id": self.owner(node.start, node.end), "value": node.text, "start_byte": self.byte(node.start), "end_byte": self.byte(node.end)})
        self.measure(node)
        heritage = {id(b) for b in [*node.info.get("extends", []), *node.info.get("implements", [])]} if kind in ("class_declaration", "class_expression", "interface") else set()
        for k in node.kids:
            self.visit(k, subclass=id(k) in heritage or (subclass and kind == "type" and k.kind in ("type", "type_name", "member") and k is node.kids[0]))

    def identifier(self, node: Node, role: str) -> None:
        self.out.identifiers.append({"symbol_id": self.owner(node.start, node.end), "name": node.text, "role": role, "start_byte": self.byte(node.start), "end_byte": self.byte(node.end)})

    def call(self, node: Node, callee: Node) -> None:
        while callee.kind in ("instantiation", "paren") and callee.kids:
            callee = callee.kids[0]
        name = callee.text if callee.kind == "name" else callee.name.text if callee.kind == "member" else None
        base = dotted(callee.kids[0]) if callee.kind == "member" else None
        at = callee.name if callee.kind == "member" else callee
        self.out.calls.append(
            {
                "id": len(self.out.calls), "source": self.owner(node.start, node.end), "name": name, "qualifier": base, "range": self.range(node), "name_start": self.byte(at.start), "name_end": self.byte(at.end),
                "arguments": [{"pos": i, "name": None, "value": self.source(a), "start_byte": self.byte(a.start), "end_byte": self.byte(a.end)} for i, a in enumerate(node.info["arguments"])],
            }
        )

    def measure(self, node: Node) -> None:
        rows = [("branch", BRANCH[node.kind])] if node.kind in BRANCH else []
        for op in node.info.get("operators", []) if node.kind == "binary" else []:
            rows.append(("operator", op))
            if op in ("&&", "||", "??"):
                rows.append(("branch", "or" if op == "||" else "and"))
        if node.kind in ("assign", "unary") and node.text:
            rows.append(("operator", node.text))
        if node.kind in ("number", "string"):
            text = self.source(node)  # a long one goes by its hash
            rows.append(("operand", text if len(text) <= 64 else f"sha256:{hashlib.sha256(text.encode('utf-8', 'surrogatepass')).hexdigest()}"))
        if rows:
            sid = self.owner(node.start, node.end)
            self.out.tokens += [{"symbol_id": sid, "group": g, "token": v} for g, v in rows]

    # JSX, chains, statements -------------------------------------------------------------------------------------------
    def elements(self, node: Node, parent: int | None) -> None:
        if node.kind == "jsx" and node.name is not None:
            eid = len(self.out.jsx_elements)
            self.out.jsx_elements.append({"id": eid, "parent": parent, "source": self.owner(node.start, node.end), "name": node.name.text, "range": self.range(node), "name_start": self.byte(node.name.start), "name_end": self.byte(node.name.end), **({"close_start": self.byte(node.info["closing"].start), "close_end": self.byte(node.info["closing"].end)} if node.info.get("closing") else {})})
            for pos, p in enumerate(node.info["props"]):
                v = p.info.get("value")
                braced = v is not None and v.kind == "jsx_expression"  # its value is with the braces, its expression without
                self.out.jsx_props.append({"element": eid, "pos": pos, "name": p.name.text, "value": self.source(v), "value_is_expression": braced, "expression": self.source(v.kids[0]) if braced and v.kids else None, "range": self.range(p)})
            parent = eid
        for k in node.kids:
            self.elements(k, parent)

    def chains(self, node: Node, nested: bool) -> None:
        """Calls of then, catch and finally one after another; nested: the call is the object of a further stage."""
        if node.kind == "call" and not nested:
            stages, base = [], node
            while base.kind == "call" and base.info["callee"].kind == "member" and base.info["callee"].name.text in STAGES:
                stages.append(base.info["callee"].name.text)
                base = base.info["callee"].kids[0]
            if "then" in stages:
                self.out.promise_chains.append({"id": len(self.out.promise_chains), "source": self.owner(node.start, node.end), "stage_names": stages[::-1], "range": self.range(node), "base_start": self.byte(base.start), "base_end": self.byte(base.end)})
        for k in node.kids:
            stage = node.kind == "call" and k is node.info["callee"] and k.kind == "member" and k.name.text in STAGES
            if stage:
                self.chains(k.kids[0], k.kids[0].kind == "call" and k.kids[0].info["callee"].kind == "member" and k.kids[0].info["callee"].name.text in STAGES)
            else:
                self.chains(k, False)

    def statement_rows(self, nodes: list[Node], parent: int | None, level: int) -> None:
        pos = 0
        for node in nodes:
            if node.kind not in STATEMENT:
                self.statement_rows(node.kids, parent, level)
                continue
            sid = len(self.out.statements)
            self.out.statements.append({"id": sid, "parent": parent, "pos": pos, "level": level, "kind": STATEMENT[node.kind], "symbol_id": self.owner(node.start, node.end), "range": self.range(node)})
            pos += 1
            self.statement_rows(node.kids, sid, level + 1)


def extract(text: str, path: str = "x.tsx") -> Extracted:
    """All records of one file. A text too deeply nested to be read gives no record and the error flag."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 20_000))
    try:
        return Extractor(text, path).run()
    except RecursionError:
        return Extracted(has_error=True)
