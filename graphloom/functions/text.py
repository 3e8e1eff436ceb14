"""Pure functions from source text to source text or records, for use on the driver or in an Arrow pass over files."""

from __future__ import annotations

import ast
import json
import os
import re
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def relative_module(from_file: str, to_file: str) -> str:
    """The path from one file to another without extension, as scripts import it."""
    path = os.path.relpath(re.sub(r"\.(d\.)?[a-z]+$", "", to_file), os.path.dirname(from_file) or ".").replace(os.sep, "/")
    return path if path.startswith(".") else f"./{path}"


def parse_docstring(text: str | None) -> dict | None:
    """description, arguments (name, type, description) and returns of a docstring in Google or field-list style."""
    if text is None:
        return None
    out: dict = {"description": "", "arguments": [], "returns": None}
    section, lines = "description", []
    for line in text.strip("\n").split("\n"):
        head = line.strip().lower().rstrip(":")
        m = re.match(r":(param|return|returns|rtype|type)\s*([^:]*):\s*(.*)", line.strip())
        if m:
            if m[1] == "param":
                kind, _, name = m[2].strip().rpartition(" ")
                out["arguments"].append({"name": name, "type": kind or None, "description": m[3]})
            elif m[1] in ("return", "returns"):
                out["returns"] = m[3]
            section = "fields"
        elif line.strip().endswith(":") and head in ("args", "arguments", "parameters", "returns", "return", "raises", "yields", "examples", "example", "note"):
            section = {"args": "arguments", "parameters": "arguments", "return": "returns"}.get(head, head)
        elif section == "description":
            lines.append(line.strip())
        elif section == "arguments" and line.strip():
            m = re.match(r"\*{0,2}(\w+)\s*(?:\(([^)]*)\))?\s*:\s*(.*)", line.strip())
            if m:
                out["arguments"].append({"name": m[1], "type": m[2], "description": m[3]})
            elif out["arguments"]:
                out["arguments"][-1]["description"] += " " + line.strip()
        elif section == "returns" and line.strip():
            out["returns"] = f"{out['returns']} {line.strip()}" if out["returns"] else line.strip()
    out["description"] = "\n".join(lines).strip()
    return out


def google_docstring(text: str) -> str:
    """A docstring of field lists in Google style; others stay."""
    if not re.search(r"(?m)^\s*:(param|return|returns|rtype)\b", text):
        return text
    d = parse_docstring(text)
    out = [d["description"]]
    if d["arguments"]:
        out += ["", "Args:"] + [f"    {a['name']}{' (' + a['type'] + ')' if a['type'] else ''}: {a['description']}" for a in d["arguments"]]
    if d["returns"]:
        out += ["", "Returns:", f"    {d['returns']}"]
    return "\n".join(out)


def _dedent_block(source: str, body: list[ast.stmt], lines: list[str], indent: int) -> list[str]:
    first, last = body[0].lineno - 1, body[-1].end_lineno
    if getattr(body[0], "decorator_list", None):
        first = body[0].decorator_list[0].lineno - 1
    own = len(lines[first]) - len(lines[first].lstrip())
    return [(" " * indent + x[own:]) if x.strip() else x for x in lines[first:last]]


def reduce_condition(source: str, condition: str, value: bool) -> str:
    """Python source with the branches that a condition of known value chooses; elif chains are kept right.

    `not condition` counts too. Statements on the if's own line are left alone.
    """
    while True:
        try:
            tree = ast.parse(source)
        except SyntaxError:
            return source
        want = ast.unparse(ast.parse(condition, mode="eval").body)
        hit = None
        for node in ast.walk(tree):
            if isinstance(node, ast.If) and node.body[0].lineno > node.lineno:
                test = node.test
                negated = isinstance(test, ast.UnaryOp) and isinstance(test.op, ast.Not)
                if ast.unparse(test.operand if negated else test) == want:
                    hit, truth = node, value != negated
                    break
        if hit is None:
            return source
        lines = source.split("\n")
        start, end, indent = hit.lineno - 1, hit.end_lineno, hit.col_offset
        is_elif = re.match(r"\s*elif\b", lines[start]) is not None
        orelse = hit.orelse
        chained = len(orelse) == 1 and isinstance(orelse[0], ast.If) and re.match(r"\s*elif\b", lines[orelse[0].lineno - 1]) is not None
        if is_elif:
            if truth:
                new = [" " * indent + "else:"] + _dedent_block(source, hit.body, lines, indent + 4)
            elif chained:
                new = lines[orelse[0].lineno - 1 : end]
            else:
                new = [" " * indent + "else:"] + _dedent_block(source, orelse, lines, indent + 4) if orelse else []
        elif truth:
            new = _dedent_block(source, hit.body, lines, indent)
        elif chained:
            new = lines[orelse[0].lineno - 1 : end]
            new[0] = re.sub(r"\belif\b", "if", new[0], count=1)
        else:
            new = _dedent_block(source, orelse, lines, indent) if orelse else []
        if not new:  # an emptied block needs a statement
            around = next((n for n in ast.walk(tree) if any(hit in getattr(n, f, []) and len(getattr(n, f)) == 1 for f in ("body", "orelse", "finalbody") if isinstance(getattr(n, f, None), list))), None)
            new = [" " * indent + "pass"] if around is not None and not isinstance(around, ast.Module) and not is_elif else []
        source = "\n".join(lines[:start] + new + lines[end:])


def to_esm(source: str) -> str:
    """CommonJS requires and exports as ES module statements, line by line."""
    out = []
    for line in source.split("\n"):
        line = re.sub(r"^(\s*)(?:const|let|var)\s+(\w+)\s*=\s*require\((['\"][^'\"]+['\"])\)\s*;?", r"\1import \2 from \3;", line)
        line = re.sub(r"^(\s*)(?:const|let|var)\s+(\{[^}]*\})\s*=\s*require\((['\"][^'\"]+['\"])\)\s*;?", lambda m: f"{m[1]}import {re.sub(r':', ' as', m[2])} from {m[3]};", line)
        line = re.sub(r"^(\s*)require\((['\"][^'\"]+['\"])\)\s*;?", r"\1import \2;", line)
        line = re.sub(r"^(\s*)module\.exports\s*=\s*", r"\1export default ", line)
        line = re.sub(r"^(\s*)(?:module\.)?exports\.(\w+)\s*=\s*", r"\1export const \2 = ", line)
        out.append(line)
    return "\n".join(out)


def to_jsdoc(source: str) -> str:
    """Line comments right above exported functions and classes as JSDoc."""

    def block(m: re.Match) -> str:
        indent = m[2]
        text = [re.sub(r"^\s*// ?", "", x) for x in m[1].rstrip("\n").split("\n")]
        return "\n".join([f"{indent}/**", *(f"{indent} * {x}".rstrip() for x in text), f"{indent} */"]) + "\n"

    return re.sub(r"(?m)((?:^([ \t]*)//[^\n]*\n)+)(?=[ \t]*export\s+(?:default\s+)?(?:async\s+)?(?:function|class|const)\b)", block, source)


def modern_annotations(source: str) -> str:
    """Optional[X] and Union[X, Y] in Python annotations as X | None and X | Y, innermost first."""
    once = re.compile(r"\b(?:typing\.)?(Optional|Union)\[([^\[\]]*(?:\[[^\[\]]*\][^\[\]]*)*)\]")

    def parts(text: str) -> list[str]:
        out, depth, cur = [], 0, ""
        for c in text:
            depth += (c in "[(") - (c in "])")
            if c == "," and depth == 0:
                out.append(cur.strip())
                cur = ""
            else:
                cur += c
        return [*out, cur.strip()] if cur.strip() else out

    for _ in range(20):
        new = once.sub(lambda m: " | ".join(parts(m[2]) + (["None"] if m[1] == "Optional" else [])), source)
        if new == source:
            break
        source = new
    return source


def async_chain(source: str) -> str | None:
    """`base.then(x => body).catch(e => other)` of arrow functions as awaits in a try statement; None for other forms."""
    from graphloom.sources.typescript_syntax import Trouble, parse

    try:
        root, errors = parse(source)
    except Trouble:
        return None
    if errors or len(root.kids) != 1 or not root.kids[0].kids:
        return None
    node, stages = root.kids[0].kids[0], []
    while node.kind == "call" and node.info["callee"].kind == "member" and node.info["callee"].name.text in ("then", "catch", "finally"):
        fn = node.info["arguments"][0].kids[0] if node.info["arguments"] else None
        if fn is None or fn.kind != "arrow":
            return None
        stages.append((node.info["callee"].name.text, fn))
        node = node.info["callee"].kids[0]
    if not stages:
        return None
    text = lambda n: source[n.start : n.end]

    def body(fn, last: bool) -> tuple[list[str], str | None]:
        inner = fn.kids[-1]
        if inner.kind != "block":
            return [], text(inner)
        return [text(k) for k in inner.kids if not (last is False and k.kind == "return")], next((text(k.kids[0]) for k in inner.kids if k.kind == "return" and k.kids), None)

    lines, value = [], f"await {text(node)}"
    thens = [f for k, f in reversed(stages) if k == "then"]
    for i, fn in enumerate(thens):
        name = text(fn.info["parameters"][0]) if fn.info["parameters"] else None
        lines.append(f"const {name} = {value};" if name else f"{value};")
        inner, result = body(fn, False)
        lines += inner
        value = f"await {result}" if result and i < len(thens) - 1 else result or ""
    if value:
        lines.append(f"{value};")
    caught, final = next((f for k, f in stages if k == "catch"), None), next((f for k, f in stages if k == "finally"), None)
    if caught or final:
        out = ["try {", *("  " + x for x in lines), "}"]
        for word, fn in (("catch", caught), ("finally", final)):
            if fn:
                inner, result = body(fn, False)
                arg = f" ({text(fn.info['parameters'][0])})" if word == "catch" and fn.info["parameters"] else ""
                out[-1] += f" {word}{arg} {{"
                out += ["  " + x for x in inner] + ([f"  {result};"] if result else []) + ["}"]
        lines = out
    return "\n".join(lines)


def stable_json(value) -> str:
    """JSON with sorted keys."""
    return json.dumps(value, sort_keys=True, ensure_ascii=False, default=str)


def to_xml(value, tag: str = "root") -> str:
    """Nested dicts and lists as XML elements; list items repeat their tag."""

    def build(parent, name, v):
        for x in v if isinstance(v, list) else [v]:
            e = ElementTree.SubElement(parent, name)
            if isinstance(x, dict):
                for k, y in x.items():
                    build(e, k, y)
            elif x is not None:
                e.text = str(x)

    root = ElementTree.Element(tag)
    for k, v in value.items():
        build(root, k, v)
    return ElementTree.tostring(root, encoding="unicode")


def from_xml(text: str) -> dict:
    """The inverse of to_xml, with texts as values."""

    def read(e):
        if not len(e):
            return e.text
        out: dict = {}
        for k in e:
            v = read(k)
            out[k.tag] = v if k.tag not in out else [*(out[k.tag] if isinstance(out[k.tag], list) else [out[k.tag]]), v]
        return out

    root = ElementTree.fromstring(text)
    return {root.tag: read(root)}


def literal(source: str):
    """The value of a Python literal of dicts, lists, tuples, strings and numbers; None where it is none."""
    try:
        return ast.literal_eval(source)
    except (ValueError, SyntaxError, MemoryError, RecursionError):
        return None


def rewrite(sources: DataFrame, function: Callable[[str], str], pattern: str = r".") -> DataFrame:
    """Edits that replace the whole text of files whose path fits, where a pure function changes it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            path, size, out = [], [], []
            for p, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = (raw or b"").decode("utf-8", "replace")
                new = function(text)
                if new != text:
                    path.append(p), size.append(len(raw or b"")), out.append(new)
            yield pa.RecordBatch.from_arrays([pa.array(path, pa.string()), pa.array(size, pa.int64()), pa.array(out, pa.string())], names=["path", "size", "text"])

    wanted = sources.where(F.col("path").rlike(pattern)).select("path", F.col("content").cast("binary").alias("content"))
    new = wanted.mapInArrow(run, schema="path string, size bigint, text string")
    return new.select("path", F.lit("edit").alias("kind"), F.lit(0).cast("long").alias("start_byte"), F.col("size").alias("end_byte"), "text", F.lit(0).cast("long").alias("priority"), F.lit(0).cast("long").alias("seq"))
