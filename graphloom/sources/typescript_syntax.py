"""A tolerant recursive-descent parser of TypeScript and JavaScript, with JSX, to a small syntax tree.

It reads characters directly, as the meaning of `/` and `<` depends on what may stand at a place. A statement that it
can't read sets the error flag and is skipped to the next line at the same depth, so the rest of a file is not lost.
Offsets are characters of the text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

BLANK = re.compile(r"(?:\s+|//[^\n\r  ]*|/\*.*?(?:\*/|\Z)|﻿)+", re.S)
WORD = re.compile(r"[#@]?[A-Za-z_$ª-\U0010ffff][\w$ª-\U0010ffff]*")
NUMBER = re.compile(r"(?:0[xXoObB][0-9a-fA-F_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?)n?")
STRING = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'", re.S)
REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
OPERATOR = re.compile(r">>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|\*\*|<<|>>|[{}()\[\];,<>=!~?:.+\-*/%&|^@#]")
JSX_NAME = re.compile(r"[A-Za-z_$][\w$.:-]*")
ASSIGN = {"=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "**=", "<<=", ">>=", ">>>=", "&&=", "||=", "??="}
BINARY = {"+", "-", "*", "/", "%", "**", "<<", ">>", ">>>", "<", ">", "<=", ">=", "==", "!=", "===", "!==", "&", "|", "^", "&&", "||", "??"}
PREFIX = {"!", "~", "+", "-", "++", "--"}
PREFIX_WORDS = {"typeof", "void", "delete", "await"}
MODIFIERS = {"public", "private", "protected", "readonly", "static", "abstract", "override", "declare", "async", "accessor", "get", "set"}
RESERVED = {
    "break", "case", "catch", "class", "const", "continue", "debugger", "default", "delete", "do", "else", "export", "extends", "finally", "for", "function", "if", "import", "in",
    "instanceof", "new", "return", "switch", "throw", "try", "typeof", "var", "void", "while", "with", "enum",
}


class Trouble(Exception):
    """The text at this place is no construct that the parser knows."""


@dataclass
class Node:
    kind: str
    start: int
    end: int = 0
    kids: list[Node] = field(default_factory=list)
    name: Node | None = None
    text: str = ""
    info: dict = field(default_factory=dict)

    def walk(self):
        yield self
        for k in self.kids:
            yield from k.walk()


class Parser:
    def __init__(self, text: str, jsx: bool = True):
        self.text, self.n, self.i, self.jsx = text, len(text), 0, jsx
        self.errors = 0
        self.blanks: dict[int, int] = {}  # end of each run of blanks and comments to its begin
        self.plain_then = 0  # inside the middle of a ternary an arrow has no return type

    # characters ------------------------------------------------------------------------------------------------------
    def blank(self) -> None:
        m = BLANK.match(self.text, self.i)
        if m:
            self.blanks[m.end()] = self.i
            self.i = m.end()

    def word(self) -> str:
        """The word at this place, not taken; empty if there is none."""
        self.blank()
        m = WORD.match(self.text, self.i)
        return m[0] if m else ""

    def op(self) -> str:
        self.blank()
        m = OPERATOR.match(self.text, self.i)
        return m[0] if m else ""

    def at(self, s: str) -> bool:
        self.blank()
        return self.text.startswith(s, self.i)

    def at_word(self, *words: str) -> bool:
        return self.word() in words

    def take(self, s: str) -> bool:
        if self.at(s):
            self.i += len(s)
            return True
        return False

    def take_word(self, w: str) -> bool:
        if self.word() == w:
            self.i += len(w)
            return True
        return False

    def skip_word(self) -> None:
        w = self.word()
        self.i += len(w)

    def need(self, s: str) -> None:
        if not self.take(s):
            raise Trouble(f"{s} at {self.i}")

    def identifier(self, kind: str = "name") -> Node:
        w = self.word()
        if not w or w[0] == "@":
            raise Trouble(f"a name at {self.i}")
        node = Node(kind, self.i, self.i + len(w), text=w)
        self.i = node.end
        return node

    def following(self) -> str:
        """The word or operator after the word at this place."""
        keep = self.i
        self.skip_word()
        out = self.word() or self.op() or (self.text[self.i : self.i + 1])
        self.i = keep
        return out

    def new_line_before(self) -> bool:
        self.blank()
        return "\n" in self.text[self.blanks.get(self.i, self.i) : self.i]

    def attempt(self, rule):
        keep = self.i
        try:
            return rule()
        except Trouble:
            self.i = keep
            return None

    def close(self, node: Node, *kids: Node | None) -> Node:
        node.kids += [k for k in kids if k is not None]
        node.end = self.blanks.get(self.i, self.i)
        return node

    def open(self, kind: str) -> Node:
        self.blank()
        return Node(kind, self.i)

    # statements ------------------------------------------------------------------------------------------------------
    def program(self) -> Node:
        root = Node("program", 0)
        if self.text.startswith("#!"):
            self.i = self.text.find("\n") if "\n" in self.text else self.n
        self.statements(root, "")
        return self.close(root)

    def statements(self, into: Node, until: str) -> None:
        while True:
            self.blank()
            if self.i >= self.n or (until and self.at(until)):
                return
            start = self.i
            try:
                into.kids.append(self.statement())
            except (Trouble, RecursionError):
                self.errors += 1
                self.recover(start, until)
            if self.i <= start:
                self.i = start + 1

    def recover(self, start: int, until: str) -> None:
        """Skip to the line after the one of the trouble, or to the block's end."""
        at = max(self.i, start + 1)
        depth = 0
        while at < self.n:
            c = self.text[at]
            if c in "{([":
                depth += 1
            elif c in "})]":
                if depth == 0 and c == until:
                    break
                depth = max(0, depth - 1)
            elif c in "\n;" and depth == 0:
                at += 1
                break
            at += 1
        self.i = at

    def block(self) -> Node:
        node = self.open("block")
        self.need("{")
        self.statements(node, "}")
        self.need("}")
        return self.close(node)

    def end_statement(self) -> None:
        self.take(";")

    def statement(self) -> Node:
        self.blank()
        if self.at("{"):
            return self.block()
        if self.at(";"):
            node = self.open("empty")
            self.i += 1
            return self.close(node)
        decorators = self.decorators()
        w = self.word()
        rule = getattr(self, f"on_{w}", None) if w and w[0].isalpha() else None
        if rule:
            node = rule()
            if node is not None:
                if decorators:
                    target = node.info.get("declaration") or node
                    target.info["decorators"] = decorators
                    node.kids[:0] = decorators
                return node
        if w and w not in RESERVED and self.following() == ":":
            node = self.open("label")
            self.identifier()
            self.need(":")
            return self.close(node, self.statement())
        node = self.open("expression")
        e = self.expression()
        self.end_statement()
        return self.close(node, e)

    def decorators(self) -> list[Node]:
        out = []
        while self.at("@"):
            node = self.open("decorator")
            self.i += 1
            out.append(self.close(node, self.postfix(self.paren() if self.at("(") else self.identifier())))
        return out

    def on_import(self) -> Node | None:
        if self.following() in ("(", "."):
            return None
        node = self.open("import")
        self.i += len("import")
        node.info = {"default": None, "named": [], "namespace": None, "module": None, "clause": False}
        self.blank()
        if self.text[self.i : self.i + 1] not in "\"'":
            if self.at_word("type") and (self.following() in ("{", "*") or (self.following() not in ("from", "=", ",") and self.following()[0:1].isalpha())):
                self.i += len("type")
            node.info["clause"] = True
            if not self.at("{") and not self.at("*"):
                node.info["default"] = self.identifier("binding")
                if self.take("="):  # import a = require('b') or import a = b.c
                    value = self.assignment()
                    node.info["equals"] = value
                    self.end_statement()
                    return self.close(node, value)
                self.take(",")
            if self.at("*"):
                ns = self.open("namespace_import")
                self.i += 1
                if not self.take_word("as"):
                    raise Trouble("as")
                ns.name = self.identifier("binding")
                node.info["namespace"] = self.close(ns)
            elif self.take("{"):
                node.info["named"] = self.specifiers()
            if not self.take_word("from"):
                raise Trouble("from")
        node.info["module"] = self.string()
        if self.take_word("with") or self.take_word("assert"):
            self.operand()
        self.end_statement()
        return self.close(node)

    def specifiers(self) -> list[Node]:
        out = []
        while not self.at("}"):
            spec = self.open("specifier")
            if self.at_word("type") and self.following() not in (",", "}", "as"):
                self.i += len("type")
            spec.name = self.module_name()
            spec.info["alias"] = self.module_name() if self.take_word("as") else None
            out.append(self.close(spec))
            if not self.take(","):
                break
        self.need("}")
        return out

    def module_name(self) -> Node:
        self.blank()
        if self.text[self.i : self.i + 1] in "\"'":
            start = self.i
            value = self.string()
            return Node("name", start, self.i, text=value)
        return self.identifier("binding")

    def string(self) -> str:
        self.blank()
        m = STRING.match(self.text, self.i)
        if not m:
            raise Trouble(f"a string at {self.i}")
        self.i = m.end()
        return m[0][1:-1]

    def on_export(self) -> Node:
        node = self.open("export")
        self.i += len("export")
        node.info = {"form": None, "module": None, "named": [], "declaration": None, "value": None}
        if self.take("="):
            node.info["form"] = "equals"
            node.info["value"] = self.expression()
        elif self.take_word("as"):  # export as namespace X
            self.take_word("namespace")
            self.identifier("binding")
            node.info["form"] = "as"
        elif self.at("*"):
            ns = self.open("namespace_export")
            self.i += 1
            node.info["form"] = "all"
            if self.take_word("as"):
                ns.name = self.module_name()
                node.info["form"] = "namespace"
                node.info["namespace"] = self.close(ns)
            if not self.take_word("from"):
                raise Trouble("from")
            node.info["module"] = self.string()
        elif self.at("{") or (self.at_word("type") and self.following() in ("{", "*")):
            self.take_word("type")
            if self.at("*"):
                self.i += 1
                node.info["form"] = "all"
                if self.take_word("as"):
                    ns = self.open("namespace_export")
                    ns.name = self.module_name()
                    node.info |= {"form": "namespace", "namespace": self.close(ns)}
                self.take_word("from")
                node.info["module"] = self.string()
            else:
                self.need("{")
                node.info["form"] = "named"
                node.info["named"] = self.specifiers()
                if self.take_word("from"):
                    node.info["module"] = self.string()
        elif self.take_word("default"):
            node.info["form"] = "default"
            if self.at_word("function", "class", "interface", "abstract", "enum") or (self.at_word("async") and self.following() == "function") or self.at("@"):
                node.info["declaration"] = self.statement()
            else:
                node.info["value"] = self.assignment()
        else:
            node.info["form"] = "declaration"
            node.info["declaration"] = self.statement()
        if node.info["form"] not in ("declaration",) and node.info["declaration"] is None:
            self.end_statement()
        return self.close(node, node.info["declaration"], node.info["value"])

    def on_declare(self) -> Node | None:
        if self.new_line_after("declare") or self.following() in ("=", ".", "(", ";", "", ":", ","):
            return None
        self.i += len("declare")
        if self.at_word("global"):
            node = self.open("global")
            self.i += len("global")
            return self.close(node, self.block())
        return self.statement()

    def new_line_after(self, w: str) -> bool:
        keep = self.i
        self.i += len(w)
        out = self.new_line_before()
        self.i = keep
        return out

    def on_async(self) -> Node | None:
        return self.function("function_declaration") if self.following() == "function" and not self.new_line_after("async") else None

    def on_function(self) -> Node:
        return self.function("function_declaration")

    def function(self, kind: str) -> Node:
        node = self.open(kind)
        node.info["async"] = self.take_word("async")
        self.take_word("function")
        node.info["generator"] = self.take("*")
        if self.word() and not self.at("("):
            node.name = self.identifier("binding")
        self.signature(node)
        if self.at("{"):
            node.kids.append(self.block())
        else:
            self.end_statement()  # an overload or a declared function
        return self.close(node)

    def signature(self, node: Node) -> None:
        """Type parameters, parameters and return type."""
        self.type_parameters(node)
        params = self.parameters()
        node.info["parameters"] = params
        node.info["signature_end"] = self.i
        node.kids += params
        if self.take(":"):
            node.info["returns"] = self.type()
            node.kids.append(node.info["returns"])

    def type_parameters(self, node: Node) -> None:
        if not self.at("<"):
            return
        self.i += 1
        names = []
        while not self.at(">"):
            while self.at_word("const", "in", "out") and self.following() not in (",", ">", "extends", "="):
                self.skip_word()
            names.append(self.identifier("binding"))
            if self.take_word("extends"):
                node.kids.append(self.type())
            if self.take("="):
                node.kids.append(self.type())
            if not self.take(","):
                break
        self.need(">")
        node.info["type_parameters"] = names

    def parameters(self) -> list[Node]:
        self.need("(")
        out = []
        while not self.at(")"):
            p = self.open("parameter")
            p.kids += self.decorators()
            while self.at_word("public", "private", "protected", "readonly", "override") and self.following() not in (",", ")", ":", "=", "?"):
                self.skip_word()
            p.info["rest"] = self.take("...")
            pattern = self.pattern()
            p.info |= {"pattern": pattern, "optional": self.take("?"), "type": None, "default": None}
            if self.take(":"):
                p.info["type"] = self.type()
            if self.at("=") and not self.at("=>"):
                self.i += 1
                p.info["default"] = self.assignment()
            out.append(self.close(p, pattern, p.info["type"], p.info["default"]))
            if not self.take(","):
                break
        self.need(")")
        return out

    def pattern(self) -> Node:
        """What binds names: an identifier, or an object or array pattern; names in info."""
        node = self.open("pattern")
        names: list[Node] = []
        node.info["names"] = names

        def inner(p: Node) -> None:
            names.extend(p.info["names"])
            node.kids.append(p)

        if self.take("{"):
            while not self.at("}"):
                if self.take("..."):
                    inner(self.pattern())
                else:
                    if self.at("["):
                        self.i += 1
                        node.kids.append(self.assignment())
                        self.need("]")
                        key = None
                    elif self.text[self.i : self.i + 1] in "\"'":
                        self.string()
                        key = None
                    elif self.text[self.i : self.i + 1].isdigit():
                        self.i = NUMBER.match(self.text, self.i).end()
                        key = None
                    else:
                        key = self.identifier("binding")
                    if self.take(":"):
                        inner(self.pattern())
                    elif key is not None:
                        names.append(key)
                    if self.at("=") and not self.at("=>"):
                        self.i += 1
                        node.kids.append(self.assignment())
                if not self.take(","):
                    break
            self.need("}")
        elif self.take("["):
            while not self.at("]"):
                if self.take(","):
                    continue
                self.take("...")
                inner(self.pattern())
                if self.at("=") and not self.at("=>"):
                    self.i += 1
                    node.kids.append(self.assignment())
                if not self.take(","):
                    break
            self.need("]")
        else:
            w = self.word()
            if w in RESERVED:
                raise Trouble(f"a name at {self.i}")
            names.append(self.identifier("binding"))
        return self.close(node)

    def on_class(self) -> Node:
        return self.class_("class_declaration")

    def on_abstract(self) -> Node | None:
        return self.class_("class_declaration") if self.following() == "class" else None

    def class_(self, kind: str) -> Node:
        node = self.open(kind)
        self.take_word("abstract")
        self.take_word("class")
        if self.word() and self.word() not in ("extends", "implements"):
            node.name = self.identifier("binding")
        self.type_parameters(node)
        node.info |= {"extends": [], "implements": []}
        if self.take_word("extends"):
            base = self.postfix(self.operand(), heritage=True)
            node.info["extends"].append(base)
            if self.at("<"):
                node.kids.append(self.type_arguments())
        if self.take_word("implements"):
            node.info["implements"] = self.type_list()
        node.info["members"] = self.class_body()
        return self.close(node, *node.info["extends"], *node.info["implements"], *node.info["members"])

    def type_list(self) -> list[Node]:
        out = [self.type()]
        while self.take(","):
            out.append(self.type())
        return out

    def class_body(self) -> list[Node]:
        self.need("{")
        out = []
        while not self.at("}"):
            if self.take(";"):
                continue
            m = self.open("member")
            m.kids += self.decorators()
            m.info["decorators"] = list(m.kids)
            words = set()
            while self.word() in MODIFIERS and self.following() not in ("(", "=", ":", ";", "?", "!", "<", "}", ",") and not self.new_line_after(self.word()):
                words.add(self.word())
                self.skip_word()
            m.info["modifiers"] = words
            if "static" in words and self.at("{"):
                out.append(self.close(m, self.block()))
                continue
            m.info["generator"] = self.take("*")
            if self.at("[") and (index := self.attempt(self.index_signature)):
                self.end_statement()
                out.append(self.close(m, index))
                continue
            m.name = self.property_name(m)
            m.info["optional"] = self.take("?")
            self.take("!")
            if self.at("(") or self.at("<"):
                m.kind = "method"
                self.signature(m)
                if self.at("{"):
                    m.kids.append(self.block())
                else:
                    self.end_statement()
            else:
                m.kind = "attribute"
                if self.take(":"):
                    m.info["type"] = self.type()
                    m.kids.append(m.info["type"])
                if self.at("=") and not self.at("=="):
                    self.i += 1
                    m.info["value"] = self.assignment()
                    m.kids.append(m.info["value"])
                self.take(",")
                self.end_statement()
            out.append(self.close(m))
        self.need("}")
        return out

    def property_name(self, into: Node) -> Node:
        """A member's or key's name: word, string, number or [expression]."""
        self.blank()
        start = self.i
        if self.take("["):
            into.kids.append(self.assignment())
            self.need("]")
            return Node("computed", start, self.i, text=self.text[start : self.i])
        if self.text[self.i : self.i + 1] in ('"', "'"):
            value = self.string()
            return Node("key", start, self.i, text=value)
        m = NUMBER.match(self.text, self.i)
        if m and m[0]:
            self.i = m.end()
            return Node("key", start, self.i, text=m[0])
        return self.identifier("key")

    def index_signature(self) -> Node:
        """[key: type]: type or [key in type]: type."""
        node = self.open("index")
        self.need("[")
        self.identifier("binding")
        if not self.take(":") and not self.take_word("in"):
            raise Trouble("no index")
        node.kids.append(self.type())
        if self.take_word("as"):
            node.kids.append(self.type())
        self.need("]")
        self.take("+") or self.take("-")
        self.take("?")
        if self.take(":"):
            node.kids.append(self.type())
        return self.close(node)

    def on_interface(self) -> Node | None:
        if not self.following()[0:1].isalpha() and self.following()[0:1] not in "_$":
            return None
        node = self.open("interface")
        self.i += len("interface")
        node.name = self.identifier("binding")
        self.type_parameters(node)
        node.info["extends"] = self.type_list() if self.take_word("extends") else []
        node.info["members"] = self.type_members()
        return self.close(node, *node.info["extends"], *node.info["members"])

    def on_type(self) -> Node | None:
        nxt = self.following()
        if self.new_line_after("type") or not (nxt[0:1].isalpha() or nxt[0:1] in ("_", "$")):
            return None
        node = self.open("type_alias")
        self.i += len("type")
        node.name = self.identifier("binding")
        self.type_parameters(node)
        self.need("=")
        node.info["value"] = self.type()
        self.end_statement()
        return self.close(node, node.info["value"])

    def on_enum(self) -> Node:
        node = self.open("enum")
        self.take_word("const")
        self.take_word("enum")
        node.name = self.identifier("binding")
        self.need("{")
        members = []
        while not self.at("}"):
            m = self.open("attribute")
            m.name = self.property_name(m)
            if self.take("="):
                m.info["value"] = self.assignment()
                m.kids.append(m.info["value"])
            members.append(self.close(m))
            if not self.take(","):
                break
        self.need("}")
        node.info["members"] = members
        return self.close(node, *members)

    def on_namespace(self) -> Node | None:
        nxt = self.following()
        if self.new_line_after(self.word()) or not (nxt[0:1].isalpha() or nxt[0:1] in ("_", "$", '"', "'")) or nxt in ("instanceof", "in", "as"):
            return None
        node = self.open("namespace")
        self.skip_word()
        node.name = self.module_name()
        while self.take("."):
            more = self.identifier("binding")
            node.name = Node("binding", node.name.start, more.end, text=f"{node.name.text}.{more.text}")
        body = self.block() if self.at("{") else None
        self.end_statement()
        node.info["body"] = body
        return self.close(node, body)

    on_module = on_namespace

    def on_const(self) -> Node:
        return self.on_enum() if self.following() == "enum" else self.variables()

    def on_var(self) -> Node:
        return self.variables()

    def on_let(self) -> Node | None:
        return None if self.following() in ("=", ".", "(", ";", "++") else self.variables()

    def variables(self, loop: bool = False) -> Node:
        node = self.open("variables")
        node.info["word"] = self.word()
        self.skip_word()
        while True:
            d = self.open("declarator")
            pattern = self.pattern()
            d.info |= {"pattern": pattern, "type": None, "value": None}
            self.take("!")
            if self.take(":"):
                d.info["type"] = self.type()
            if self.at("=") and not self.at("=="):
                self.i += 1
                d.info["value"] = self.assignment(no_in=loop)
            node.kids.append(self.close(d, pattern, d.info["type"], d.info["value"]))
            if not self.take(","):
                break
        if not loop:
            self.end_statement()
        return self.close(node)

    def condition(self) -> Node:
        self.need("(")
        e = self.expression()
        self.need(")")
        return e

    def on_if(self) -> Node:
        node = self.open("if")
        self.i += 2
        kids = [self.condition(), self.statement()]
        if self.take_word("else"):
            kids.append(self.statement())
        return self.close(node, *kids)

    def on_while(self) -> Node:
        node = self.open("while")
        self.i += 5
        return self.close(node, self.condition(), self.statement())

    def on_do(self) -> Node:
        node = self.open("while")
        self.i += 2
        body = self.statement()
        if not self.take_word("while"):
            raise Trouble("while")
        node.kids = [body, self.condition()]
        self.end_statement()
        return self.close(node)

    def on_for(self) -> Node:
        node = self.open("for")
        self.i += 3
        self.take_word("await")
        self.need("(")
        if not self.at(";"):
            head = self.variables(loop=True) if self.at_word("var", "let", "const") else self.expression(no_in=True)
            node.kids.append(head)
            if self.take_word("of") or self.take_word("in"):
                node.info["each"] = head
                node.kids.append(self.expression())
                self.need(")")
                node.kids.append(self.statement())
                return self.close(node)
        self.need(";")
        if not self.at(";"):
            node.kids.append(self.expression())
        self.need(";")
        if not self.at(")"):
            node.kids.append(self.expression())
        self.need(")")
        node.kids.append(self.statement())
        return self.close(node)

    def word_statement(self, kind: str) -> Node:
        node = self.open(kind)
        self.skip_word()
        if not self.new_line_before() and not self.at(";") and not self.at("}") and self.i < self.n:
            node.kids.append(self.expression())
        self.end_statement()
        return self.close(node)

    def on_return(self) -> Node:
        return self.word_statement("return")

    def on_throw(self) -> Node:
        return self.word_statement("raise")

    def on_break(self) -> Node:
        node = self.open("break")
        self.skip_word()
        if not self.new_line_before() and self.word() and self.word() not in RESERVED:
            self.identifier("label_name")
        self.end_statement()
        return self.close(node)

    on_continue = on_break

    def on_try(self) -> Node:
        node = self.open("try")
        self.i += 3
        node.kids.append(self.block())
        if self.at_word("catch"):
            c = self.open("catch")
            self.i += 5
            if self.take("("):
                c.info["pattern"] = self.pattern()
                c.kids.append(c.info["pattern"])
                if self.take(":"):
                    c.kids.append(self.type())
                self.need(")")
            node.kids.append(self.close(c, self.block()))
        if self.take_word("finally"):
            node.kids.append(self.block())
        return self.close(node)

    def on_switch(self) -> Node:
        node = self.open("switch")
        self.i += 6
        node.kids.append(self.condition())
        self.need("{")
        while not self.at("}"):
            case = self.open("case")
            if self.take_word("case"):
                case.kids.append(self.expression())
            elif self.take_word("default"):
                case.kind = "default"
            else:
                raise Trouble("case")
            self.need(":")
            while not self.at("}") and not self.at_word("case", "default"):
                case.kids.append(self.statement())
            node.kids.append(self.close(case))
        self.need("}")
        return self.close(node)

    def on_debugger(self) -> Node:
        node = self.open("expression")
        self.i += len("debugger")
        self.end_statement()
        return self.close(node)

    # types -----------------------------------------------------------------------------------------------------------
    def type(self) -> Node:
        node = self.open("type")
        if self.at_word("asserts") and self.following()[0:1].isalpha() and self.following() != "is":
            self.i += len("asserts")
        self.take("|") or self.take("&")
        node.kids.append(self.type_operand())
        while True:
            if (self.at("|") and not self.at("||")) or (self.at("&") and not self.at("&&")):
                self.i += 1
                node.kids.append(self.type_operand())
            elif self.at_word("is") and not self.new_line_before():
                self.i += 2
                node.kids.append(self.type())
            elif self.at_word("extends"):
                keep = self.i
                self.i += len("extends")
                bound = self.type()
                if not self.take("?"):
                    self.i = keep
                    break
                node.kids.append(bound)
                node.kids.append(self.type())
                self.need(":")
                node.kids.append(self.type())
            else:
                break
        return self.close(node)

    def type_operand(self) -> Node:
        self.blank()
        w = self.word()
        if w in ("keyof", "readonly", "unique", "infer") and self.following() not in (",", ")", ";", ">", "=", "|", "&", "]", "}"):
            node = self.open("type")
            self.i += len(w)
            return self.close(node, self.type_operand())
        return self.type_postfix(self.type_primary())

    def type_postfix(self, node: Node) -> Node:
        while self.at("[") and not self.new_line_before():
            outer = Node("type", node.start, kids=[node])
            self.i += 1
            if not self.at("]"):
                outer.kids.append(self.type())
            self.need("]")
            node = self.close(outer)
        return node

    def type_primary(self) -> Node:
        node = self.open("type")
        c = self.text[self.i : self.i + 1]
        w = self.word()
        if c == "(" or c == "<" or w == "new" or (w == "abstract" and self.following() == "new"):
            f = self.attempt(self.function_type)
            if f is not None:
                return f
            self.need("(")
            node.kids.append(self.type())
            self.need(")")
            return self.close(node)
        if c == "{":
            return self.close(node, *self.type_members())
        if c == "[":
            self.i += 1
            while not self.at("]"):
                self.take("...")
                if self.word() and self.following() in (":", "?") and self.attempt(self.tuple_label):
                    pass
                node.kids.append(self.type())
                self.take("?")
                if not self.take(","):
                    break
            self.need("]")
            return self.close(node)
        if c in "\"'" and c:
            self.string()
            return self.close(node)
        if c == "`":
            node.kids.append(self.template())
            return self.close(node)
        if c == "-" or c.isdigit():
            self.take("-")
            self.i = NUMBER.match(self.text, self.i).end()
            return self.close(node)
        if w == "typeof":
            self.i += len(w)
            w = self.word()
            if w == "import":
                return self.close(node, self.import_type())
        if w == "import":
            return self.close(node, self.import_type())
        if not w or w in RESERVED - {"void", "this", "typeof"}:
            raise Trouble(f"a type at {self.i}")
        name: Node = self.identifier("type_name")
        while self.take("."):
            prop = self.identifier("property")
            name = Node("member", name.start, prop.end, kids=[name], name=prop, info={"type": True})
        node.kids.append(name)
        if self.at("<"):
            node.kids.append(self.type_arguments())
        return self.close(node)

    def tuple_label(self) -> bool:
        self.identifier("key")
        self.take("?")
        self.need(":")
        return True

    def import_type(self) -> Node:
        node = self.open("type")
        self.i += len("import")
        self.need("(")
        self.string()
        self.need(")")
        while self.take("."):
            self.identifier("property")
        if self.at("<"):
            node.kids.append(self.type_arguments())
        return self.close(node)

    def function_type(self) -> Node:
        node = self.open("type")
        self.take_word("abstract")
        self.take_word("new")
        self.type_parameters(node)
        node.kids += self.parameters()
        self.need("=>")
        return self.close(node, self.type())

    def type_arguments(self) -> Node:
        node = self.open("type")
        self.need("<")
        while not self.at(">"):
            node.kids.append(self.type())
            if not self.take(","):
                break
        self.need(">")
        return self.close(node)

    def type_members(self) -> list[Node]:
        self.need("{")
        out = []
        while not self.at("}"):
            if self.take(";") or self.take(","):
                continue
            m = self.open("attribute")
            self.take("+") or self.take("-")
            while self.at_word("readonly", "get", "set") and self.following() not in (":", "?", "(", ";", ",", "}", "<"):
                self.skip_word()
            index = self.attempt(self.index_signature) if self.at("[") else None
            if index is not None:
                m.kids.append(index)
                out.append(self.close(m))
                continue
            if self.at_word("new") and self.following() in ("(", "<"):
                self.i += 3
            if not self.at("(") and not self.at("<"):
                m.name = self.property_name(m)
            m.info["optional"] = self.take("?")
            if self.at("(") or self.at("<"):
                m.kind = "method"
                self.signature(m)
            elif self.take(":"):
                m.info["type"] = self.type()
                m.kids.append(m.info["type"])
            out.append(self.close(m))
        self.need("}")
        return out

    # expressions -----------------------------------------------------------------------------------------------------
    def expression(self, no_in: bool = False) -> Node:
        first = self.assignment(no_in)
        if not self.at(","):
            return first
        node = Node("sequence", first.start, kids=[first])
        while self.take(","):
            node.kids.append(self.assignment(no_in))
        return self.close(node)

    def assignment(self, no_in: bool = False) -> Node:
        self.blank()
        start = self.i
        w = self.word()
        if w == "yield" and self.following() not in (":", "=>"):
            node = self.open("yield")
            self.i += len(w)
            self.take("*")
            if not self.new_line_before() and self.op() not in (")", "]", "}", ",", ";", ":") and self.i < self.n:
                node.kids.append(self.assignment(no_in))
            return self.close(node)
        arrow = self.arrow()
        if arrow is not None:
            return arrow
        left = self.binary(no_in)
        op = self.op()
        if op == "?":
            self.i += 1
            self.plain_then += 1
            then = self.assignment()
            self.plain_then -= 1
            self.need(":")
            node = Node("ternary", start, kids=[left, then, self.assignment(no_in)])
            return self.close(node)
        if op in ASSIGN:
            self.i += len(op)
            node = Node("assign", start, kids=[left], text=op)
            node.kids.append(self.assignment(no_in))
            return self.close(node)
        return left

    def arrow(self) -> Node | None:
        """An arrow function at this place, if there is one."""
        self.blank()
        c = self.text[self.i : self.i + 1]
        w = self.word()
        if w == "async" and not self.new_line_after(w):
            nxt = self.following()
            if not (nxt in ("(", "<") or nxt[0:1].isalpha() or nxt[0:1] in ("_", "$")) or nxt == "function":
                if nxt != "=>":
                    return None
        elif w:
            if w in RESERVED or self.following() != "=>":
                return None
        elif c == "<":
            if self.jsx and not re.compile(r"<\s*(?:const\s+)?[A-Za-z_$][\w$]*\s*(?:,|extends\s)").match(self.text, self.i):
                return None
        elif c != "(":
            return None
        return self.attempt(self.arrow_function)

    def arrow_function(self) -> Node:
        node = self.open("arrow")
        node.info["async"] = self.at_word("async") and self.following() != "=>" and self.take_word("async")
        if self.word():
            name = self.identifier("binding")
            p = Node("parameter", name.start, name.end, info={"rest": False, "optional": False, "type": None, "default": None})
            p.info["pattern"] = Node("pattern", name.start, name.end, info={"names": [name]})
            p.kids = [p.info["pattern"]]
            node.info["parameters"] = [p]
            node.kids.append(p)
        else:
            self.type_parameters(node)
            params = self.parameters()
            node.info["parameters"] = params
            node.info["signature_end"] = self.i
            node.kids += params
            if self.at(":"):
                if self.plain_then:
                    raise Trouble("no return type here")
                self.i += 1
                node.info["returns"] = self.type()
                node.kids.append(node.info["returns"])
        self.need("=>")
        keep, self.plain_then = self.plain_then, 0
        try:
            node.kids.append(self.block() if self.at("{") else self.assignment())
        finally:
            self.plain_then = keep
        return self.close(node)

    def binary(self, no_in: bool) -> Node:
        first = self.unary()
        node = None
        while True:
            op, w = self.op(), self.word()
            if w in ("as", "satisfies") and not self.new_line_before():
                self.i += len(w)
                node = node or Node("binary", first.start, kids=[first], info={"operators": []})
                if not (self.at_word("const") and self.take_word("const")):
                    node.kids.append(self.type())
            elif w == "instanceof" or (w == "in" and not no_in):
                self.i += len(w)
                node = node or Node("binary", first.start, kids=[first], info={"operators": []})
                node.info["operators"].append(w)
                node.kids.append(self.unary())
            elif op in BINARY:
                self.i += len(op)
                node = node or Node("binary", first.start, kids=[first], info={"operators": []})
                node.info["operators"].append(op)
                node.kids.append(self.unary())
            else:
                return self.close(node) if node else first

    def unary(self) -> Node:
        self.blank()
        op, w = self.op(), self.word()
        if op in PREFIX:
            node = self.open("unary")
            node.text = op
            self.i += len(op)
            return self.close(node, self.unary())
        if w in PREFIX_WORDS and self.following() not in ("=>", "=", ",", ";", ")", "]", "}", ":", "."):
            node = self.open("unary")
            node.text = w
            self.i += len(w)
            return self.close(node, self.unary())
        if op == "<" and not self.jsx:  # a type assertion
            node = self.open("unary")
            node.kids.append(self.type_arguments())
            return self.close(node, self.unary())
        e = self.postfix(self.operand())
        if self.op() in ("++", "--") and not self.new_line_before():
            node = Node("unary", e.start, kids=[e], text=self.op())
            self.i += 2
            return self.close(node)
        return e

    def paren(self) -> Node:
        node = self.open("paren")
        self.need("(")
        keep, self.plain_then = self.plain_then, 0
        try:
            node.kids.append(self.expression())
        finally:
            self.plain_then = keep
        self.need(")")
        return self.close(node)

    def operand(self) -> Node:
        self.blank()
        c = self.text[self.i : self.i + 1]
        if c == "(":
            return self.paren()
        if c == "{":
            return self.object()
        if c == "[":
            node = self.open("array")
            self.i += 1
            while not self.at("]"):
                if self.take(","):
                    continue
                self.take("...")
                node.kids.append(self.assignment())
                if not self.take(","):
                    break
            self.need("]")
            return self.close(node)
        if c == "`":
            return self.template()
        if c and c in "\"'":
            node = self.open("string")
            node.text = self.string()
            return self.close(node)
        if c == "/":
            m = REGEX.match(self.text, self.i)
            if not m:
                raise Trouble(f"a pattern at {self.i}")
            node = self.open("regex")
            self.i = m.end()
            return self.close(node)
        if c == "<" and self.jsx:
            return self.jsx_element()
        if c.isdigit() or (c == "." and self.text[self.i + 1 : self.i + 2].isdigit()):
            node = self.open("number")
            self.i = NUMBER.match(self.text, self.i).end()
            return self.close(node)
        if c == "@":
            ds = self.decorators()
            node = self.class_("class_expression")
            node.kids[:0] = ds
            return node
        w = self.word()
        if w == "function" or (w == "async" and self.following() == "function"):
            return self.function("function_expression")
        if w == "class":
            return self.class_("class_expression")
        if w == "new":
            node = self.open("new")
            self.i += 3
            if self.take("."):
                self.identifier("property")
                return self.close(node)
            callee = self.postfix(self.operand(), calls=False)
            node.info["callee"] = callee
            node.kids.append(callee)
            if self.at("<"):
                args = self.attempt(self.type_arguments)
                if args is not None:
                    node.kids.append(args)
            node.info["arguments"] = self.arguments() if self.at("(") else []
            return self.close(node, *node.info["arguments"])
        if w == "import":
            node = self.open("name")
            self.i += len(w)
            node.text = w
            return self.close(node)
        if not w or w in RESERVED:
            raise Trouble(f"an operand at {self.i}")
        return self.identifier()

    def object(self) -> Node:
        node = self.open("object")
        self.need("{")
        keep, self.plain_then = self.plain_then, 0
        try:
            self.object_members(node)
        finally:
            self.plain_then = keep
        self.need("}")
        return self.close(node)

    def object_members(self, node: Node) -> None:
        while not self.at("}"):
            p = self.open("pair")
            if self.take("..."):
                p.kind = "spread"
                node.kids.append(self.close(p, self.assignment()))
            else:
                while self.at_word("async", "get", "set") and self.following() not in (",", "}", ":", "(", "=", "<"):
                    self.skip_word()
                self.take("*")
                p.name = self.property_name(p)
                if self.at("(") or self.at("<"):
                    p.kind = "method"
                    self.signature(p)
                    node.kids.append(self.close(p, self.block()))
                elif self.take(":"):
                    node.kids.append(self.close(p, self.assignment()))
                else:
                    p.kind = "shorthand"
                    p.kids.append(Node("name", p.name.start, p.name.end, text=p.name.text))
                    if self.take("="):
                        p.kids.append(self.assignment())
                    node.kids.append(self.close(p))
            if not self.take(","):
                break

    def arguments(self) -> list[Node]:
        self.need("(")
        keep, self.plain_then = self.plain_then, 0
        out = []
        try:
            while not self.at(")"):
                a = self.open("argument")
                self.take("...")
                out.append(self.close(a, self.assignment()))
                if not self.take(","):
                    break
        finally:
            self.plain_then = keep
        self.need(")")
        return out

    def postfix(self, node: Node, calls: bool = True, heritage: bool = False) -> Node:
        while True:
            op = self.op()
            if op in (".", "?."):
                self.i += len(op)
                if op == "?." and self.at("("):
                    continue
                if op == "?." and self.at("["):
                    continue
                prop = self.identifier("property")
                node = self.close(Node("member", node.start, kids=[node], name=prop))
            elif op == "[":
                outer = Node("subscript", node.start, kids=[node])
                self.i += 1
                outer.kids.append(self.expression())
                self.need("]")
                node = self.close(outer)
            elif op == "(" and calls:
                outer = Node("call", node.start, kids=[node], info={"callee": node})
                outer.info["arguments"] = self.arguments()
                node = self.close(outer, *outer.info["arguments"])
            elif self.at("`"):
                node = self.close(Node("tagged", node.start, kids=[node]), self.template())
            elif op == "!" and not self.new_line_before() and not self.at("!="):
                self.i += 1
                node = self.close(Node("paren", node.start, kids=[node]))
            elif op in ("<", "<<") and calls and not heritage:
                args = self.attempt(self.call_type_arguments)
                if args is None:
                    return node
                node = self.close(Node("instantiation", node.start, kids=[node, args]))
            else:
                return node

    def call_type_arguments(self) -> Node:
        args = self.type_arguments()
        if not (self.at("(") or self.at("`")):
            raise Trouble("no call")
        return args

    def template(self) -> Node:
        node = self.open("template")
        self.need("`")
        while True:
            if self.i >= self.n:
                raise Trouble("template without end")
            c = self.text[self.i]
            if c == "\\":
                self.i += 2
            elif c == "`":
                self.i += 1
                return self.close(node)
            elif self.text.startswith("${", self.i):
                self.i += 2
                keep, self.plain_then = self.plain_then, 0
                try:
                    node.kids.append(self.attempt(self.expression) or self.type())
                finally:
                    self.plain_then = keep
                self.need("}")
            else:
                self.i += 1

    # JSX -------------------------------------------------------------------------------------------------------------
    def jsx_name(self) -> Node | None:
        self.blank()
        m = JSX_NAME.match(self.text, self.i)
        if not m:
            return None
        node = Node("tag", self.i, m.end(), text=m[0])
        self.i = m.end()
        return node

    def jsx_element(self) -> Node:
        node = self.open("jsx")
        node.info["props"] = []
        self.need("<")
        if self.take(">"):  # a fragment
            self.jsx_children(node)
            return self.close(node)
        node.name = self.jsx_name()
        if node.name is None:
            raise Trouble(f"a tag at {self.i}")
        if self.at("<"):
            node.kids.append(self.type_arguments())
        while True:
            self.blank()
            if self.take("/"):
                self.need(">")
                return self.close(node)
            if self.take(">"):
                break
            if self.at("{"):
                node.kids.append(self.jsx_expression())
                continue
            prop = self.open("prop")
            prop.name = self.jsx_name()
            if prop.name is None:
                raise Trouble(f"an attribute at {self.i}")
            if self.take("="):
                self.blank()
                if self.at("{"):
                    prop.info["value"] = self.jsx_expression()
                elif self.at("<"):
                    prop.info["value"] = self.jsx_element()
                else:
                    v = self.open("string")
                    quote = self.text[self.i : self.i + 1]
                    end = self.text.find(quote, self.i + 1) if quote in ('"', "'") else -1
                    if end < 0:
                        raise Trouble(f"a value at {self.i}")
                    self.i = end + 1
                    prop.info["value"] = self.close(v)
                prop.kids.append(prop.info["value"])
            node.info["props"].append(self.close(prop))
            node.kids.append(prop)
        self.jsx_children(node)
        return self.close(node)

    def jsx_expression(self) -> Node:
        node = self.open("jsx_expression")
        self.need("{")
        self.take("...")
        if not self.at("}"):
            keep, self.plain_then = self.plain_then, 0
            try:
                node.kids.append(self.expression())
            finally:
                self.plain_then = keep
        self.need("}")
        return self.close(node)

    def jsx_children(self, node: Node) -> None:
        while True:
            while self.i < self.n and self.text[self.i] not in "{<":
                self.i += 1
            if self.i >= self.n:
                raise Trouble("element without end")
            if self.text.startswith("</", self.i):
                self.i += 2
                node.info["closing"] = self.jsx_name()
                self.need(">")
                return
            node.kids.append(self.jsx_expression() if self.text[self.i] == "{" else self.jsx_element())


def parse(text: str, jsx: bool = True) -> tuple[Node, int]:
    """Syntax tree and number of statements that could not be read."""
    p = Parser(text, jsx)
    return p.program(), p.errors
