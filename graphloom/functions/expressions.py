"""Single expressions and definitions of Python and TypeScript source: chains, operands, signatures, reductions, collections."""

from __future__ import annotations

import ast
import re
from collections.abc import Callable

_SIGNS = {
    ast.Add: "+", ast.Sub: "-", ast.Mult: "*", ast.Div: "/", ast.FloorDiv: "//", ast.Mod: "%", ast.Pow: "**", ast.MatMult: "@", ast.BitAnd: "&", ast.BitOr: "|", ast.BitXor: "^", ast.LShift: "<<", ast.RShift: ">>",
    ast.And: "and", ast.Or: "or", ast.Eq: "==", ast.NotEq: "!=", ast.Lt: "<", ast.LtE: "<=", ast.Gt: ">", ast.GtE: ">=", ast.Is: "is", ast.IsNot: "is not", ast.In: "in", ast.NotIn: "not in",
}


def _expression(source: str) -> ast.expr | None:
    try:
        return ast.parse(source.strip(), mode="eval").body
    except (SyntaxError, ValueError):
        return None


def binary_parts(source: str) -> dict | None:
    """{operands, operators} of an operation, flattened over nested ones from left to right; None for other source."""
    top, text = _expression(source), source.strip()
    if not isinstance(top, (ast.BinOp, ast.BoolOp, ast.Compare)):
        return None
    operands, operators = [], []

    def walk(e: ast.expr) -> None:
        if isinstance(e, ast.BinOp):
            walk(e.left)
            operators.append(_SIGNS[type(e.op)])
            walk(e.right)
        elif isinstance(e, ast.BoolOp):
            for i, v in enumerate(e.values):
                if i:
                    operators.append(_SIGNS[type(e.op)])
                walk(v)
        elif isinstance(e, ast.Compare):
            walk(e.left)
            for op, v in zip(e.ops, e.comparators):
                operators.append(_SIGNS[type(op)])
                walk(v)
        else:
            operands.append(ast.get_source_segment(text, e))

    walk(top)
    return {"operands": operands, "operators": operators}


def attribute_chain(source: str) -> list[str]:
    """The links of a.b(1).c[0] from its root on: names, and calls with their arguments."""
    top, text, out = _expression(source), source.strip(), []
    while top is not None:
        if isinstance(top, ast.Call) and isinstance(top.func, ast.Attribute):
            out.append(text[_end(text, top.func.value) + 1 : _end(text, top)].strip())
            top = top.func.value
        elif isinstance(top, ast.Attribute):
            out.append(top.attr)
            top = top.value
        elif isinstance(top, ast.Subscript):
            top = top.value
        else:
            out.append(ast.get_source_segment(text, top))
            break
    return out[::-1]


def _end(text: str, e: ast.expr) -> int:
    lines = text.splitlines(keepends=True)
    return sum(map(len, lines[: e.end_lineno - 1])) + len(lines[e.end_lineno - 1].encode()[: e.end_col_offset].decode())


def signature(source: str) -> str:
    """The head of a function's or method's source, on one line, up to the colon, brace or arrow that begins its body."""
    depth, quote = 0, ""
    for i, c in enumerate(source):
        if quote:
            quote = "" if c == quote and source[i - 1] != "\\" else quote
        elif c in "\"'`":
            quote = c
        elif c in "([{" and not (c == "{" and depth == 0):
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif depth == 0 and (c == "{" or source.startswith("=>", i) or (c == ":" and re.match(r"\s*(@.*\n\s*)*(async\s+)?def\b", source))):
            return " ".join(source[:i].split())
    return " ".join(source.split())


def generics(annotation: str) -> dict | None:
    """{name, arguments} of a generic type such as Dict[str, int] or Map<string, number>; None for a plain one."""
    m = re.fullmatch(r"\s*([\w.]+)\s*(?:\[(.*)\]|<(.*)>)\s*", annotation, re.S)
    if not m:
        return None
    return {"name": m[1], "arguments": split_top(m[2] if m[2] is not None else m[3])}


def substitute(annotation: str, values: dict[str, str]) -> str:
    """The annotation with type variables replaced by what they stand for."""
    return re.sub(r"[A-Za-z_]\w*", lambda m: values.get(m[0], m[0]), annotation)


def split_top(text: str, mark: str = ",") -> list[str]:
    """Parts between marks that stand in no bracket or string, trimmed; an empty last part is left out."""
    out, depth, quote, part = [], 0, "", ""
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote and text[i - 1] != "\\" else quote
        elif c in "\"'`":
            quote = c
        elif c in "([{<":
            depth += 1
        elif c in ")]}" or (c == ">" and text[i - 1] not in "=-"):
            depth -= 1
        elif c == mark and depth == 0:
            out.append(part.strip())
            part = ""
            continue
        part += c
    return out + ([part.strip()] if part.strip() else [])


def edit_collection(source: str, change: Callable[[list[str]], list[str]]) -> str:
    """A list, tuple, set, dict or argument list with its items changed; one item a line stays one item a line."""
    m = re.match(r"[^(\[{]*[(\[{]", source, re.S)
    if not m:
        raise ValueError("no collection")
    head, tail = m[0], source[len(source.rstrip()) - 1 :]
    inner = source[len(head) : len(source.rstrip()) - 1]
    items = change(split_top(inner))
    indent = re.match(r"\s*\n([ \t]*)", inner)
    if indent and items:
        close = re.search(r"\n([ \t]*)$", inner)
        return head + "".join(f"\n{indent[1]}{x}," for x in items) + "\n" + (close[1] if close else "") + tail
    lone = "," if head.endswith("(") and head.strip() == "(" and len(items) == 1 else ""
    return head + ", ".join(items) + lone + tail


def insert_item(source: str, at: int, item: str) -> str:
    return edit_collection(source, lambda x: x[:at] + [item] + x[at:] if at >= 0 else x[: len(x) + at + 1] + [item] + x[len(x) + at + 1 :])


def remove_item(source: str, item: str | int) -> str:
    """Without the item at a place, or without all items of a text (of a dict also: all with that key)."""
    if isinstance(item, int):
        return edit_collection(source, lambda x: [v for i, v in enumerate(x) if i != item % len(x)] if x else x)
    return edit_collection(source, lambda x: [v for v in x if v != item and split_top(v, ":")[0] != item])


def set_item(source: str, key: str, value: str) -> str:
    """A dict with the key's value replaced, or the pair added at the end."""

    def change(items: list[str]) -> list[str]:
        there = [split_top(v, ":")[0] == key for v in items]
        return [f"{key}: {value}" if t else v for v, t in zip(items, there)] + ([] if any(there) else [f"{key}: {value}"])

    return edit_collection(source, change)


def reduce_operation(source: str, condition: str, value: bool) -> str:
    """An expression with a condition known to be true or false: and, or, not and conditional expressions get simpler."""
    top, text = _expression(source), source.strip()
    if top is None:
        return source
    segment = lambda e: ast.get_source_segment(text, e)

    def walk(e: ast.expr) -> str | bool:
        if segment(e) == condition:
            return value
        if isinstance(e, ast.UnaryOp) and isinstance(e.op, ast.Not):
            inner = walk(e.operand)
            return not inner if isinstance(inner, bool) else f"not {inner}"
        if isinstance(e, ast.BoolOp):
            decides = isinstance(e.op, ast.Or)  # the value that decides the whole
            parts = [walk(v) for v in e.values]
            if any(p is decides for p in parts):
                return decides
            left = [p for p in parts if not isinstance(p, bool)]
            return (not decides) if not left else f" {'or' if decides else 'and'} ".join(left)
        if isinstance(e, ast.IfExp):
            test = walk(e.test)
            if isinstance(test, bool):
                return walk(e.body if test else e.orelse)
            parts = [walk(e.body), walk(e.orelse)]
            return f"{parts[0]} if {test} else {parts[1]}"
        return segment(e)

    return str(walk(top))


def unwrap_unpacking(source: str) -> str:
    """A starred literal inside a call or collection as its own items: f(*[a, b], **{"c": 1}) is f(a, b, c=1)."""

    def change(items: list[str]) -> list[str]:
        out = []
        for x in items:
            pairs = re.fullmatch(r"\*\*\s*\{(.*)\}", x, re.S)
            row = re.fullmatch(r"\*\s*[\[(](.*)[\])]", x, re.S)
            if pairs:
                for p in split_top(pairs[1]):
                    key, value = split_top(p, ":")
                    out.append(f"{ast.literal_eval(key)}={value}" if "(" in source.split(x)[0] else p)
            elif row:
                out += split_top(row[1])
            else:
                out.append(x)
        return out

    return edit_collection(source, change)


def arrow_to_named(source: str, name: str | None = None) -> str:
    """const f = async (a) => ... as async function f(a) { ... }; other source is left alone."""
    m = re.match(r"\s*(export\s+)?(?:const|let|var)\s+(\w+)[^=]*=\s*(async\s+)?(<[^>]*>)?\s*", source)
    if not m:
        return source
    rest = source[m.end() :]
    if rest.startswith("("):
        depth = 0
        for i, c in enumerate(rest):
            depth += (c == "(") - (c == ")")
            if not depth:
                break
        params, rest = rest[: i + 1], rest[i + 1 :]
    else:
        one = re.match(r"\w+", rest)
        if not one:
            return source
        params, rest = f"({one[0]})", rest[one.end() :]
    arrow = re.match(r"\s*(:\s*(?:[^={]|\{[^}]*\})+?)?\s*=>\s*", rest)
    if not arrow:
        return source
    body = rest[arrow.end() :].rstrip().rstrip(";")
    if not body.startswith("{"):
        body = f"{{ return {body[1:-1].strip() if body.startswith('(') and body.endswith(')') else body}; }}"
    return f"{m[1] or ''}{m[3] or ''}function {name or m[2]}{m[4] or ''}{params}{arrow[1] or ''} {body}"


def props_to_interface(source: str) -> str:
    """A component whose props have an inline type, with that type as an interface before it."""
    m = re.search(r"function\s+(\w+)\s*\((\{[^}]*\}|\w+)\s*:\s*(\{[^{}]*\})", source) or re.search(r"(?:const|let)\s+(\w+)\s*=\s*\((\{[^}]*\}|\w+)\s*:\s*(\{[^{}]*\})", source)
    if not m:
        return source
    name = f"{m[1]}Props"
    fields = [f.strip() for f in re.split(r"[;,\n]", m[3][1:-1]) if f.strip()]
    export = "export " if source.lstrip().startswith("export") else ""
    return f"{export}interface {name} {{\n" + "".join(f"  {f};\n" for f in fields) + "}\n\n" + source[: m.start(3)] + name + source[m.end(3) :]


def declassified(source: str, name: str) -> str:
    """A class's methods as functions without their first parameter; attributes become assignments, the class goes."""
    tree = ast.parse(source)
    c = next((n for n in tree.body if isinstance(n, ast.ClassDef) and n.name == name), None)
    if c is None:
        return source
    lines, out = source.splitlines(), []
    for n in c.body:
        if isinstance(n, ast.Expr) and isinstance(n.value, ast.Constant):
            continue
        first = min([n.lineno, *(d.lineno for d in getattr(n, "decorator_list", []))])
        block = [x[n.col_offset :] if x[: n.col_offset].isspace() else x for x in lines[first - 1 : n.end_lineno]]
        text = "\n".join(x for x in block if x.strip() not in ("@staticmethod", "@classmethod"))
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)) and n.args.args and not any(isinstance(d, ast.Name) and d.id == "staticmethod" for d in n.decorator_list):
            own = n.args.args[0].arg
            text = re.sub(rf"(def\s+\w+\s*\(\s*){own}\s*(?::[^,)]*)?,?\s*", r"\1", text, count=1)
            text = re.sub(rf"\b{own}\.(?=\w)", "", text)
        out.append(text + ("\n" if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)) else ""))
    first = min([c.lineno, *(d.lineno for d in c.decorator_list)])
    body = "\n".join(out).rstrip("\n")
    return "\n".join([*lines[: first - 1], body, *lines[c.end_lineno :]]) + ("\n" if source.endswith("\n") else "")


def truncated(text: str, most: int) -> str:
    """A line of at most so many characters, with a mark where it was cut."""
    return text if len(text) <= most else text[: max(0, most - 3)] + "..."


def compiled(source: str, name: str = "execute", scope: dict | None = None) -> Callable:
    """The function that trusted source defines under a name, or one whose body it is; runs on the driver only."""
    tree = ast.parse(source)
    if not any(isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)) and n.name == name for n in tree.body):
        source = f"def {name}(g, **arguments):\n" + "".join(f"    {x}\n" for x in source.splitlines() or ["pass"])
    space = dict(scope or {})
    exec(compile(source, f"<{name}>", "exec"), space)  # noqa: S102
    return space[name]
