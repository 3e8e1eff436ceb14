"""Registered code modifications: functions from a code graph to a table of edits, and the canonical ones."""

from __future__ import annotations

import importlib.util
import os
import re
from abc import ABC, abstractmethod
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text as X
from graphloom.operators.edits import listed, planned
from graphloom.plans import refactor as R
from graphloom.plans import rewrites as RW
from graphloom.plans.codegraph import CodeGraph

PY, TS = "python", "typescript"
_registry: dict[str, tuple[Callable[..., DataFrame], str | None]] = {}


class Codemod(ABC):
    """Base of codemods that are classes; an instance is called with the graph."""

    language: str | None = None

    @abstractmethod
    def __call__(self, g: CodeGraph, **arguments) -> DataFrame: ...


def codemod(name: str, language: str | None = None):
    """Register a function or Codemod class under a name."""

    def wrap(f):
        _registry[name] = (f() if isinstance(f, type) else f, language)
        return f

    return wrap


def run(name: str, g: CodeGraph, **arguments) -> DataFrame:
    if name not in _registry:
        raise KeyError(f"no codemod is named {name!r}")
    f, language = _registry[name]
    if language and g.language != language:
        raise ValueError(f"{name} is for {language}, the repository is {g.language}")
    return f(g, **arguments)


def listing() -> list[dict]:
    return [{"name": k, "language": v[1], "about": (v[0].__doc__ or "").strip().split("\n")[0]} for k, v in sorted(_registry.items())]


def load(path: str) -> None:
    """Import a Python file that registers codemods."""
    spec = importlib.util.spec_from_file_location(os.path.basename(path)[:-3], path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)


def union(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


#: Files or directories, at most, that a codemod makes a plan of its own for.
MOVES = 200


def bounded(df: DataFrame, column: str, what: str) -> list[str]:
    """The values of a column, ascending; more than MOVES of them are an error, for the caller to narrow the graph."""
    found = sorted(r[0] for r in df.select(column).limit(MOVES + 1).collect())
    if len(found) > MOVES:
        raise ValueError(f"more than {MOVES} {what}: run on a part of the repository at a time")
    return found


def _functions(g: CodeGraph) -> DataFrame:
    return g.symbols.where("kind = 'function'")


def _without_return(g: CodeGraph) -> DataFrame:
    """Functions in which no statement returns a value."""
    src = g.sources.select(F.col("path").alias("_p"), F.col("content").cast("binary").alias("_content"))
    r = g.statements.where("kind = 'return'").join(g.files.select(F.col("id").alias("_f"), "path"), F.col("file_id") == F.col("_f")).join(src, F.col("path") == F.col("_p"))
    text = F.trim(F.substring("_content", F.col("range.start_byte") + 1, F.col("range.end_byte") - F.col("range.start_byte")).cast("string"))
    return _functions(g).join(r.where(~text.rlike(r"^return;?$")).select(F.col("symbol_id").alias("id")).distinct(), "id", "left_anti")


@codemod("bang_bang_to_boolean", TS)
def bang_bang_to_boolean(g):
    """!!x and !!(x) as Boolean(x) and Boolean((x)), outside of strings."""
    e = R.search(g, r"!!\s*([\w.$]+|\([^()]*\))", "Boolean($1)").where(F.col("path").rlike(r"\.tsx?$"))
    s = g.string_literals.join(g.files.select(F.col("id").alias("file_id"), F.col("path").alias("_p")), "file_id").select("_p", F.col("start_byte").alias("_a"), F.col("end_byte").alias("_b"))
    return e.join(s, (F.col("path") == F.col("_p")) & (F.col("_a") <= F.col("start_byte")) & (F.col("end_byte") <= F.col("_b")), "left_anti")


@codemod("built_in_type_annotation", PY)
def built_in_type_annotation(g):
    """List, Dict, Set and Tuple of typing as the built-in types."""
    i = g.imports.where("module = 'typing' and name in ('List', 'Dict', 'Set', 'Tuple')").select("id", F.col("name").alias("_n"))
    r = g.external_references.join(i.select(F.col("id").alias("import_id"), "_n"), "import_id").where("name = _n")
    uses = planned(R._located(g, r, "source_file_id"), "_path", "edit", "range.start_byte", "range.end_byte", F.lower("name"))
    gone = i.select("id").withColumn("_gone", F.lit(True))
    a = R._located(g, g.imports.where("module = 'typing'").join(gone, "id", "left"))
    one = F.concat(F.col("name"), F.when(F.col("alias").isNotNull(), F.concat(F.lit(" as "), F.col("alias"))).otherwise(""))
    kept = F.filter(F.array_sort(F.collect_list(F.struct("id", F.when(F.col("_gone").isNull(), one).alias("n")))), lambda x: x["n"].isNotNull())
    st = a.groupBy("_path", F.col("range.start_byte").alias("a"), F.col("range.end_byte").alias("b")).agg(kept.alias("kept"), F.count("_gone").alias("lost")).where("lost > 0")
    text = F.concat(F.lit("from typing import "), F.array_join(F.transform("kept", lambda x: x["n"]), ", "))
    return union(uses, planned(st.where("size(kept) = 0"), "_path", "remove_lines", "a", "b"), planned(st.where("size(kept) > 0"), "_path", "edit", "a", "b", text))


@codemod("change_jsx_element_name", TS)
def change_jsx_element_name(g, old: str, new: str, module: str | None = None):
    """JSX elements under another name, with its import."""
    e = R.rename_tag(g, old, new)
    if module is None:
        return e
    return union(e, R.add_import(g, e.select("path", F.lit(f"import {{ {new} }} from '{module}'").alias("statement")).distinct()))


@codemod("class_names_to_backtick", TS)
def class_names_to_backtick(g, prop: str = "classNames"):
    """String values of a JSX property as template literals."""
    p = g.jsx_props.where((F.col("name") == prop) & ~F.col("value_is_expression"))
    return planned(R._located(g, p), "_path", "edit", "range.start_byte", "range.end_byte", F.concat("name", F.lit("={`"), F.regexp_replace("value", "^['\"]|['\"]$", ""), F.lit("`}")))


@codemod("array_type_to_square_bracket", TS)
def array_type_to_square_bracket(g):
    """Array<T> of a plain type as T[]."""
    return R.search(g, r"\bArray<([\w.]+)>", "$1[]").where(F.col("path").rlike(r"\.tsx?$"))


@codemod("comments_to_jsdoc", TS)
def comments_to_jsdoc(g):
    """Line comments above exported functions and classes in JSDoc style."""
    return X.rewrite(g.sources, X.to_jsdoc, r"\.(ts|tsx|js|jsx)$")


@codemod("docstring_to_google_style", PY)
def docstring_to_google_style(g):
    """Docstrings of field lists in Google style."""
    def convert(source: str) -> str:
        import re

        return re.sub(r'("""|\'\'\')(.*?)\1', lambda m: m[1] + X.google_docstring(m[2]) + m[1], source, flags=re.S)

    return X.rewrite(g.sources, convert, r"\.py$")


@codemod("delete_unused_functions")
def delete_unused_functions(g, rounds: int = 1):
    """Functions that nothing uses go; with more rounds also those only they use."""
    return R.remove(g, g.dead_code(rounds).select(F.col("node").alias("id")))


@codemod("emojify_files", PY)
def emojify_files(g, line: str = "# \U0001f308"):
    """A comment line at the begin of all files."""
    return planned(g.files, "path", "insert", F.lit(0), F.lit(0), line + "\n")


def _enums(g: CodeGraph) -> DataFrame:
    direct = g.base_names.where(F.col("name").rlike(r"(^|\.)(Str|Int)?Enum$|(^|\.)(Int)?Flag$")).select(F.col("symbol_id").alias("id")).distinct()
    e = g.subclass_edges.select(F.col("target_symbol_id").alias("src"), F.col("source_symbol_id").alias("dst"))
    from graphloom.operators.traversal import reach

    more = reach(e, direct.select(F.col("id").alias("node"))).select(F.col("node").alias("id"))
    return g.symbols.join(direct.unionAll(more).distinct(), "id", "left_semi").where("is_top_level")


@codemod("move_enums", PY)
def move_enums(g, name: str = "enums.py"):
    """Enumerations into a file of their directory."""
    at = R._located(g, _enums(g))
    folders = bounded(at.select(F.regexp_replace("_path", r"[^/]*$", "").alias("d")).distinct(), "d", "directories with enumerations")  # one move a directory
    parts = [R.move_to_file(g, at.where((F.regexp_replace("_path", r"[^/]*$", "") == d) & (F.col("_path") != d + name)).select("id"), d + name) for d in sorted(folders)]
    return union(*parts) if parts else listed(g.spark, [])


@codemod("insert_arguments_to_decorator", PY)
def insert_arguments_to_decorator(g, decorator: str, arguments: str):
    """Arguments added to calls of a decorator."""
    bare = decorator.lstrip("@").replace(".", r"\.")
    e = R.search(g, rf"(?m)^[ \t]*@{bare}\([^()\n]*\)")
    new = F.regexp_replace("text", r"\)$", f", {arguments})")
    return planned(e, "path", "edit", "start_byte", "end_byte", F.regexp_replace(new, r"\(\s*,\s*", "("))


@codemod("set_call_argument", PY)
def set_call_argument(g, target: str, name: str, value: str):
    """A keyword argument in all calls of a function."""
    return R.set_keyword(g, g.resolve_target(target), name, value)


@codemod("js_to_esm", TS)
def js_to_esm(g, pattern: str = r"\.js$"):
    """CommonJS modules as ES modules."""
    return X.rewrite(g.sources, X.to_esm, pattern)


def _internal(g: CodeGraph) -> DataFrame:
    """Functions that are used, and only from their own directory or below."""
    where = g.files.select(F.col("id").alias("_g"), F.regexp_replace("path", r"[^/]*$", "").alias("_use"))
    d = g.references.join(where, F.col("source_file_id") == F.col("_g"))
    f = R._located(g, _functions(g).where("is_top_level")).withColumn("_dir", F.regexp_replace("_path", r"[^/]*$", ""))
    j = f.join(d.select("target_symbol_id", "_use"), F.col("id") == F.col("target_symbol_id"))
    return j.groupBy("id").agg(F.min(F.startswith("_use", "_dir")).alias("ok")).where("ok").select("id")


@codemod("mark_as_internal")
def mark_as_internal(g):
    """A comment on functions that are only used in their own directory."""
    return R.set_comment(g, _internal(g), "@internal")


@codemod("mark_is_boolean", TS)
def mark_is_boolean(g):
    """Boolean parameters get a name with is before it."""
    p = g.parameters.where("annotation = 'boolean'").where(~F.col("name").rlike("^(is|has|should|can)[A-Z_]") & F.col("name").rlike(r"^\w+$"))
    p = p.select("symbol_id", "name", F.concat(F.lit("is"), F.upper(F.substring("name", 1, 1)), F.expr("substring(name, 2)")).alias("_new"))
    uses = g.identifiers.join(p, ["symbol_id", "name"])
    return planned(R._located(g, uses), "_path", "edit", "start_byte", "end_byte", F.col("_new"))


@codemod("migrate_class_attributes", PY)
def migrate_class_attributes(g, source: str, to: str, names: list[str] | None = None):
    """Attributes of one class into another, at the begin of its body."""
    m = g.members.where("kind = 'attribute'").join(g.resolve_target(source).select(F.col("id").alias("symbol_id")), "symbol_id", "left_semi")
    m = m.where(F.col("name").isin(names)) if names else m
    src = g.sources.select(F.col("path").alias("_p"), F.col("content").cast("binary").alias("_c"))
    m = R._located(g, m).join(src, F.col("_path") == F.col("_p")).withColumn("_text", F.substring("_c", F.col("range.start_byte") + 1, F.col("range.end_byte") - F.col("range.start_byte")).cast("string"))
    lines = [r["_text"] for r in m.orderBy("pos").select("_text").collect()]  # a class's attributes
    return union(planned(m, "_path", "remove_lines", "range.start_byte", "range.end_byte"), R.prepend_statements(g, g.resolve_target(to), "\n".join(lines)))


@codemod("move_functions_to_new_file", PY)
def move_functions_to_new_file(g, prefix: str, path: str):
    """Functions whose name begins in a certain way into one file."""
    return R.move_to_file(g, _functions(g).where("is_top_level").where(F.col("name").startswith(prefix)).select("id"), path)


@codemod("openapi_add_response_none", PY)
def openapi_add_response_none(g, base: str = "Resource", decorator: str = "ns.response(200)"):
    """A decorator on HTTP methods of resource classes that return nothing."""
    c = g.base_names.where(F.col("name").rlike(rf"(^|\.){base}$")).select(F.col("symbol_id").alias("parent_symbol_id"))
    m = _without_return(g).where(F.col("name").isin("get", "post", "put", "patch", "delete")).join(c, "parent_symbol_id", "left_semi")
    return R.add_decorator(g, m.select("id"), decorator)


@codemod("pascal_case_symbols", TS)
def pascal_case_symbols(g):
    """Classes, interfaces and type aliases in PascalCase."""
    s = g.symbols.where("kind in ('class', 'interface', 'type_alias')").where(~F.col("name").rlike("^[A-Z][A-Za-z0-9]*$"))
    parts = F.transform(F.split("name", "_"), lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, F.lit(2), F.length(x))))
    return R.rename(g, s.select("id"), F.array_join(parts, ""))


@codemod("pivot_return_types", PY)
def pivot_return_types(g, old: str = "str", new: str = "FastStr", module: str = "fast_str"):
    """Functions that return one type return another, with its import."""
    s = _functions(g).where(F.col("returns") == old)
    files = R._located(g, s).select(F.col("_path").alias("path"), F.lit(f"from {module} import {new}").alias("statement")).distinct()
    return union(R.set_return_type(g, s.select("id"), new), R.add_import(g, files))


@codemod("remove_indirect_imports", PY)
def remove_indirect_imports(g):
    """Imports through a file that only passes a symbol on import it from where it is defined."""
    home = g.symbols.select(F.col("id").alias("target_symbol_id"), F.col("file_id").alias("_home"), F.col("name").alias("_real"))
    r = g.import_resolutions.where("target_symbol_id is not null").join(home, "target_symbol_id").where("_home <> target_file_id")
    module = g.files.select(F.col("id").alias("_home"), F.col("module_name").alias("_module"))
    i = R._located(g, g.imports.where("kind = 'from_import'").join(r.join(module, "_home").select(F.col("import_id").alias("id"), "_module", "_real"), "id")).where(~F.col("_path").rlike(r"(^|/)__init__\.py$"))
    alone = g.imports.groupBy("file_id", F.col("range.start_byte").alias("_a")).agg(F.count("*").alias("_k")).where("_k = 1")
    i = i.join(alone.withColumnRenamed("file_id", "_ff"), (F.col("file_id") == F.col("_ff")) & (F.col("range.start_byte") == F.col("_a")))
    local = F.coalesce("alias", "name")
    text = F.concat(F.lit("from "), F.col("_module"), F.lit(" import "), F.col("_real"), F.when(local != F.col("_real"), F.concat(F.lit(" as "), local)).otherwise(""))
    return planned(i, "_path", "edit", "range.start_byte", "range.end_byte", text)


@codemod("rename_function_parameters", PY)
def rename_function_parameters(g, old: str, new: str):
    """A parameter name in all functions that have it."""
    return R.rename_parameter(g, g.parameters.where(F.col("name") == old).select(F.col("symbol_id").alias("id")), old, new)


@codemod("rename_local_variables")
def rename_local_variables(g, old: str, new: str):
    """Local variables whose name holds a text."""
    return R.rename_local(g, _functions(g).select("id"), old, new, fuzzy=True)


@codemod("replace_prop_values", TS)
def replace_prop_values(g, old: str, new: str, prop: str | None = None):
    """A text within the values of JSX properties."""
    p = g.jsx_props.where(F.col("value").contains(old))
    p = p.where(F.col("name") == prop) if prop else p
    return planned(R._located(g, p), "_path", "edit", "range.start_byte", "range.end_byte", F.concat("name", F.lit("="), F.replace("value", F.lit(old), F.lit(new))))


@codemod("return_none_type_annotation", PY)
def return_none_type_annotation(g):
    """-> None on functions that return nothing and say nothing of it."""
    return R.set_return_type(g, _without_return(g).where("returns is null").select("id"), "None")


@codemod("split_decorators", PY)
def split_decorators(g, decorator: str):
    """A decorator of several string arguments as one decorator each."""
    bare = decorator.lstrip("@").replace(".", r"\.")
    e = R.search(g, rf"(?m)^[ \t]*@{bare}\([^()\n]*,[^()\n]*\)")
    args = F.split(F.regexp_extract("text", r"\((.*)\)", 1), r"\s*,\s*")
    head = F.regexp_extract("text", r"^([ \t]*@[\w.]+)\(", 1)
    return planned(e, "path", "edit", "start_byte", "end_byte", F.array_join(F.transform(args, lambda a: F.concat(head, F.lit("("), a, F.lit(")"))), "\n"))


@codemod("split_large_files", PY)
def split_large_files(g, lines: int = 1000):
    """The functions of files with more lines into a file beside each."""
    big = bounded(g.files.where(F.col("line_count") > lines).select(F.concat_ws(" ", "id", "path").alias("f")), "f", "large files")  # one move a file
    parts = [R.move_to_file(g, _functions(g).where(f"is_top_level and file_id = {i}").select("id"), p[:-3] + "_functions.py") for i, p in (f.split(" ", 1) for f in big)]
    return union(*parts) if parts else listed(g.spark, [])


@codemod("swap_call_site_imports", PY)
def swap_call_site_imports(g, old: str, module: str, new: str):
    """Calls and imports of a function as another module's."""
    t = g.resolve_target(old)
    r = g.references.join(t.select(F.col("id").alias("target_symbol_id"), F.col("file_id").alias("_tf")), "target_symbol_id").where("source_file_id <> _tf")
    uses = planned(R._located(g, r, "source_file_id"), "_path", "edit", "range.start_byte", "range.end_byte", new)
    i = g.imports.join(g.import_resolutions.join(t.select(F.col("id").alias("target_symbol_id")), "target_symbol_id", "left_semi").select(F.col("import_id").alias("id")), "id", "left_semi")
    return union(uses, planned(R._located(g, i), "_path", "edit", "range.start_byte", "range.end_byte", f"from {module} import {new}"))


@codemod("update_optional_types", PY)
def update_optional_types(g):
    """Optional[X] and Union[X, Y] as X | None and X | Y."""
    return X.rewrite(g.sources, X.modern_annotations, r"\.py$")


@codemod("use_named_kwargs", PY)
def use_named_kwargs(g, at_least: int = 2):
    """Keyword arguments in calls with several."""
    return R.keyword_arguments(g, _functions(g).select("id"), at_least)


@codemod("wrap_with_component", TS)
def wrap_with_component(g, tag: str, wrapper: str, module: str | None = None):
    """JSX elements inside another one, with its import."""
    e = R.wrap_elements(g, tag, wrapper)
    return e if module is None else union(e, R.add_import(g, e.select("path", F.lit(f"import {{ {wrapper} }} from '{module}'").alias("statement")).distinct()))


@codemod("wrap_with_statement", PY)
def wrap_with_statement(g, target: str, header: str):
    """The body of a function inside a with statement."""
    s = R._of(g, g.resolve_target(target)).where("body_start is not null")
    src = g.sources.select(F.col("path").alias("_p"), F.col("content").cast("binary").alias("_c"))
    s = s.join(src, F.col("_path") == F.col("_p"))
    body = F.substring("_c", F.col("body_start") + 1, F.col("range.end_byte") - F.col("body_start")).cast("string")
    indent = F.repeat(F.lit(" "), (F.col("range.start_column") + 8).cast("int"))
    text = F.concat(F.lit(f"{header}:\n"), indent, F.regexp_replace(body, r"\n(?=[^\n])", "\n    "))
    return planned(s, "_path", "edit", "body_start", "range.end_byte", text)


@codemod("reduce_feature_flag", PY)
def reduce_feature_flag(g, condition: str, value: bool = True):
    """If statements on a condition of known value as the branch it chooses."""
    return X.rewrite(g.sources, lambda s: X.reduce_condition(s, condition, value), r"\.py$")


@codemod("promises_to_async", TS)
def promises_to_async(g):
    """Promise chains that are statements of async functions as awaits."""
    src = g.sources.select(F.col("path").alias("_p"), F.col("content").cast("binary").alias("_c"))
    inside = g.symbols.where("is_async").select(F.col("id").alias("source_symbol_id"))
    c = R._located(g, g.promise_chains.join(inside, "source_symbol_id", "left_semi"), "source_file_id").join(src, F.col("_path") == F.col("_p"))
    st = g.statements.where("kind = 'expression'").select(F.col("file_id").alias("_sf"), F.col("range.start_byte").alias("_sa"))
    c = c.join(st, (F.col("source_file_id") == F.col("_sf")) & (F.col("range.start_byte") == F.col("_sa")))
    text = F.substring("_c", F.col("range.start_byte") + 1, F.col("range.end_byte") - F.col("range.start_byte")).cast("string")
    c = RW.mapped(c.select("_path", F.col("range.start_byte").alias("_a"), F.col("range.end_byte").alias("_b"), text.alias("_text")), "_text", X.async_chain)
    return planned(c.where("_new is not null"), "_path", "edit", "_a", "_b", F.col("_new"))


@codemod("convert_attribute_to_decorator", PY)
def convert_attribute_to_decorator(g, values: dict[str, str], module: str):
    """Class attributes of certain values as decorators of the class, with their import."""
    m = g.members.where(F.col("kind") == "attribute").where(F.col("value").isin(*values))
    parts = [planned(R._located(g, m), "_path", "remove_lines", "range.start_byte", "range.end_byte")]
    for value, decorator in values.items():
        c = m.where(F.col("value") == value).select(F.col("symbol_id").alias("id"))
        files = R._of(g, c).select(F.col("_path").alias("path"), F.lit(f"from {module} import {decorator}").alias("statement")).distinct()
        parts += [R.add_decorator(g, c, decorator), R.add_import(g, files)]
    return union(*parts)


@codemod("mark_internal_to_module", PY)
def mark_internal_to_module(g, folder: str = "app"):
    """Functions of a folder that nothing imports get an underscore before their name."""
    imported = g.import_resolutions.where("target_symbol_id is not null").select(F.col("target_symbol_id").alias("id"))
    starred = g.imports.where("name = '*'").select(F.col("id").alias("import_id")).join(g.import_resolutions, "import_id").select(F.col("target_file_id").alias("file_id")).distinct()
    f = R._located(g, _functions(g).where("is_top_level and not is_private").join(imported, "id", "left_anti").join(starred, "file_id", "left_anti"))
    return R.rename(g, f.where(F.col("_path").contains(folder)).select("id"), F.concat(F.lit("_"), F.col("name")))


# What in a method's source shows that it reads its request, and decorators that state what it expects.
REQUEST = ("request_get_json", "request.json", "request.args", "request.form", "request.files", "request", "self.request")
EXPECTS = ("load_with", "expect", "use_args", "use_kwargs")


@codemod("openapi_no_reference_request", PY)
def openapi_no_reference_request(g, suffix: str = "Resource"):
    """HTTP methods of routed resource classes that don't touch the request are decorated with an empty expectation."""
    route = F.get(F.filter("decorators", lambda d: d.contains("_ns.route")), F.lit(0))
    c = g.symbols.where((F.col("kind") == "class") & F.endswith("name", F.lit(suffix)) & route.isNotNull()).select(F.col("id").alias("parent_symbol_id"), F.substring_index(route, ".", 1).alias("_ns"))
    m = _functions(g).where(F.col("name").isin("get", "post", "put", "patch", "delete")).join(c, "parent_symbol_id")
    m = m.where(~F.exists("decorators", lambda d: d.rlike("|".join(EXPECTS))))
    m = RW.sliced(g, R._located(g, m), "range.start_byte", "range.end_byte").where(~F.col("_source").rlike("|".join(r.replace(".", r"[.]") for r in REQUEST)))
    indent = F.repeat(F.lit(" "), F.col("range.start_column").cast("int"))
    return planned(m, "_path", "insert", "range.start_byte", "range.start_byte", F.concat(F.lit("@"), F.col("_ns"), F.lit(".expect(None)\n"), indent))


@codemod("split_file", PY)
def split_file(g, path: str, to: str, base: str = "Enum"):
    """The classes of a file below a base class into a new file."""
    from graphloom.plans.views import is_subclass_of

    f = g.files.where(F.col("path") == g.find_file(path)).select(F.col("id").alias("file_id"))
    c = g.symbols.where("kind = 'class' and is_top_level").join(f, "file_id", "left_semi").join(is_subclass_of(g, base), "id", "left_semi")
    return R.move_to_file(g, c.select("id"), to)


def split_file_and_rename_symbols(g: CodeGraph, path: str, to: str, contains: str, old: str, new: str, rename_to: str | None = None) -> DataFrame:
    """Sources after three steps: classes whose name holds a word move to a new file, one is renamed there, the old file is moved.

    Each step plans on the graph of the sources that the one before left, so this gives (path, content), not edits.
    """
    from graphloom.lineage import cut
    from graphloom.operators.edits import apply

    def after(g: CodeGraph, edits: DataFrame) -> CodeGraph:
        out = apply(g.sources, edits)
        return CodeGraph(g.spark, cut(out.where("status <> 'removed'").select("path", "content")), g.language, g.configs, g.roots)

    f = g.files.where(F.col("path") == g.find_file(path)).select(F.col("id").alias("file_id"))
    c = g.symbols.where("kind = 'class' and is_top_level").where(F.col("name").contains(contains)).join(f, "file_id", "left_semi")
    g = after(g, R.move_to_file(g, c.select("id"), to))
    there = g.files.where(F.col("path") == to).select(F.col("id").alias("file_id"))
    g = after(g, R.rename(g, g.symbols.where(F.col("name") == old).where("kind = 'class'").join(there, "file_id", "left_semi").select("id"), new))
    return (after(g, R.rename_file(g, path, rename_to)) if rename_to else g).sources


@codemod("swap_class_attribute_usages", PY)
def swap_class_attribute_usages(g, old: str, new: str, parameter: str, attribute: str, module: str):
    """Parameters of one class become such of another, which holds the first in an attribute; bodies and calls follow."""
    p = g.parameters.where(F.col("annotation") == old)
    rest = RW.sliced(g, R._located(g, p).withColumn("_to", F.col("end_byte") + 2 * len(old.encode()) + 64), "end_byte", "_to")
    mark = F.regexp_extract("_source", rf"^\s*:\s*{re.escape(old)}", 0)  # the name's annotation
    parts = [planned(rest, "_path", "edit", "start_byte", F.col("end_byte") + F.octet_length(mark), f"{parameter}: {new}")]
    fs = R._of(g, p.select(F.col("symbol_id").alias("id")))
    parts.append(R.add_import(g, fs.select(F.col("_path").alias("path"), F.lit(f"from {module} import {new}").alias("statement")).distinct()))
    # where the body uses the name, it is bound anew
    used = g.identifiers.where("role = 'load'").select("symbol_id", "name").distinct()
    b = fs.join(p.join(used, ["symbol_id", "name"], "left_semi").select(F.col("symbol_id").alias("id"), F.col("name").alias("_name")), "id").where("body_start is not null")
    at = F.coalesce("doc_end", "body_start")
    indent = F.repeat(F.lit(" "), (F.col("range.start_column") + 4).cast("int"))
    line = F.concat(F.col("_name"), F.lit(f" = {parameter}.{attribute}"))
    text = F.when(F.col("doc_end").isNull(), F.concat(line, F.lit("\n"), indent)).otherwise(F.concat(F.lit("\n"), indent, line))
    parts.append(planned(b, "_path", "insert", at, at, text))
    a = g.arguments().join(p.select(F.col("symbol_id").alias("target_symbol_id"), F.col("name").alias("parameter")), ["target_symbol_id", "parameter"], "left_semi")
    value = F.when(F.col("name").isNotNull(), F.concat(F.lit(f"{parameter}="), F.col("value"), F.lit(f".{parameter}"))).otherwise(F.concat(F.col("value"), F.lit(f".{parameter}")))
    parts.append(planned(R._located(g, a, "source_file_id"), "_path", "edit", "start_byte", "end_byte", value))
    return union(*parts)


def from_source(source: str, name: str = "execute", language: str | None = None) -> None:
    """Register the codemod that trusted source defines under a name."""
    from graphloom.functions.expressions import compiled

    _registry[name] = (compiled(source, name, {"F": F, "R": R, "planned": planned}), language)


class Skill:
    """A codemod with examples: pairs of files before and after, which check() runs it on."""

    def __init__(self, name: str, language: str, examples: list[tuple[dict[str, str], dict[str, str]]], **arguments):
        self.name, self.language, self.examples, self.arguments = name, language, examples, arguments

    def check(self, spark) -> list[dict[str, tuple[str | None, str | None]]]:
        """For each example the files that differ from what was expected, as (expected, got); all empty if it is right."""
        from graphloom.operators.edits import apply

        out = []
        for before, after in self.examples:
            g = CodeGraph.from_files(spark, before, self.language)
            rows = apply(g.sources, run(self.name, g, **self.arguments)).where("status <> 'removed'").collect()  # an example's files
            got = {r.path: bytes(r.content).decode() for r in rows}
            out.append({p: (after.get(p), got.get(p)) for p in sorted({*after, *got}) if after.get(p) != got.get(p)})
        return out
