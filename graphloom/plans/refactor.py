"""Refactorings of a code graph as tables of edits: each function returns rows of graphloom.operators.edits.SCHEMA.

Targets are DataFrames with a column id of symbols (as CodeGraph.resolve_target gives), so one call can change many.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import scalar as S
from graphloom.operators.edits import planned
from graphloom.plans.codegraph import CodeGraph

#: Matches that one batch of a search gives at most.
PLACES = 100_000


def _paths(g: CodeGraph) -> DataFrame:
    return g.files.select(F.col("id").alias("_f"), F.col("path").alias("_path"), "module_name")


def _located(g: CodeGraph, df: DataFrame, file: str = "file_id") -> DataFrame:
    """df with _path of its file."""
    return df.join(_paths(g), F.col(file) == F.col("_f")).drop("_f")


def _of(g: CodeGraph, targets: DataFrame) -> DataFrame:
    return _located(g, g.symbols.join(targets.select(F.col("id").alias("_t")).distinct(), F.col("id") == F.col("_t"), "left_semi"))


def rename(g: CodeGraph, targets: DataFrame, new_name: str | Column) -> DataFrame:
    """Definition, imports and references of the symbols under a new name, which may depend on the column name.

    References through an alias keep the alias.
    """
    new = F.lit(new_name) if isinstance(new_name, str) else new_name
    s = _of(g, targets).withColumn("_new", new)
    names = s.select(F.col("id").alias("_id"), F.col("name").alias("_old"), "_new")
    own = planned(s, "_path", "edit", "name_start", "name_end", F.col("_new"))
    refs = g.references.join(names, F.col("target_symbol_id") == F.col("_id")).where("name = _old")
    uses = planned(_located(g, refs, "source_file_id"), "_path", "edit", "range.start_byte", "range.end_byte", F.col("_new"), seq=1)
    imps = g.imports.join(g.import_resolutions.select(F.col("import_id").alias("id"), "target_symbol_id"), "id").join(names, F.col("target_symbol_id") == F.col("_id")).where("name = _old and name_start is not null")
    # `import x as x` written short: the local name must not change with an unrelated alias
    brought = planned(_located(g, imps), "_path", "edit", "name_start", "name_end", F.col("_new"), seq=2)
    return own.unionAll(uses).unionAll(brought)


def remove(g: CodeGraph, targets: DataFrame) -> DataFrame:
    """Whole declarations, with the lines they stand on."""
    return planned(_of(g, targets), "_path", "remove_lines", "range.start_byte", "range.end_byte")


def unused_imports(g: CodeGraph) -> DataFrame:
    """(id, ...) of imports that bind a name nothing refers to; side effects, wildcards, re-exports and packages' own files stay."""
    used = g.references.select("import_id").unionAll(g.external_references.select("import_id")).where("import_id is not null").select(F.col("import_id").alias("id")).distinct()
    i = g.imports.where("kind not in ('side_effect', 'future_import') and coalesce(name, '') <> '*'").join(used, "id", "left_anti")
    binding = S.import_binding(F.col("kind"), F.col("module"), F.col("name"), F.col("alias"))
    again = g.exports.where("import_id is not null").select(F.col("import_id").alias("id"))
    i = i.join(again, "id", "left_anti").withColumn("binding", binding)
    # a bound module may be used as a qualifier, and names may be listed in __all__
    seen = g.identifiers.where("role = 'load'").select(F.col("file_id").alias("_vf"), F.col("name").alias("_vn")).unionAll(g.all_exports.select("file_id", "name")).distinct()
    i = i.join(seen, (F.col("file_id") == F.col("_vf")) & (F.col("binding") == F.col("_vn")), "left_anti")
    return _located(g, i).where(~F.col("_path").rlike(r"(^|/)__init__\.py$"))


def remove_unused_imports(g: CodeGraph) -> DataFrame:
    """Statements without a used import go; from statements with some they are rewritten (Python)."""
    gone = unused_imports(g).select("id").withColumn("_gone", F.lit(True))
    i = _located(g, g.imports).join(gone, "id", "left").where("kind in ('import', 'from_import')")
    one = F.concat(F.col("name"), F.when(F.col("alias").isNotNull(), F.concat(F.lit(" as "), F.col("alias"))).otherwise(""))
    kept = F.filter(F.array_sort(F.collect_list(F.struct("id", F.when(F.col("_gone").isNull(), one).alias("n")))), lambda x: x["n"].isNotNull())
    st = i.groupBy("_path", F.col("range.start_byte").alias("a"), F.col("range.end_byte").alias("b"), "kind", F.when(F.col("kind") == "from_import", F.col("module")).alias("module")).agg(kept.alias("kept"), F.count("_gone").alias("lost"))
    st = st.where("lost > 0")
    names = F.array_join(F.transform("kept", lambda x: x["n"]), ", ")
    text = F.when(F.col("kind") == "import", F.concat(F.lit("import "), names)).otherwise(F.concat(F.lit("from "), F.col("module"), F.lit(" import "), names))
    return planned(st.where("size(kept) = 0"), "_path", "remove_lines", "a", "b").unionAll(planned(st.where("size(kept) > 0"), "_path", "edit", "a", "b", text))


def import_place(g: CodeGraph) -> DataFrame:
    """(_path, _at): where a file takes a new import: before its first import but those from the future, else its begin."""
    first = g.imports.where("kind <> 'future_import' and owner is null").groupBy(F.col("file_id").alias("_i")).agg(F.min("range.start_byte").alias("first"))
    future = g.imports.where("kind = 'future_import'").groupBy(F.col("file_id").alias("_g")).agg((F.max("range.end_byte") + 1).alias("after"))
    f = _paths(g).join(first, F.col("_f") == F.col("_i"), "left").join(future, F.col("_f") == F.col("_g"), "left").join(g.files.select(F.col("id").alias("_n"), F.col("root_range.end_byte").alias("_end")), F.col("_f") == F.col("_n"))
    return f.select("_path", F.least(F.coalesce("first", "after", F.lit(0)), "_end").alias("_at"))


def add_import(g: CodeGraph, wanted: DataFrame) -> DataFrame:
    """wanted: (path, statement). Statements that a file already has on a line of its own are left out."""
    have = g.imports.join(_paths(g), F.col("file_id") == F.col("_f")).select(F.col("_path").alias("path"), statement(F.col("kind"), F.col("module"), F.col("name"), F.col("alias")).alias("statement"))
    new = wanted.select("path", "statement").distinct().join(have, ["path", "statement"], "left_anti")
    return planned(new.join(import_place(g), F.col("path") == F.col("_path")), "_path", "insert", "_at", "_at", F.concat("statement", F.lit("\n")))


def statement(kind: Column, module: Column, name: Column, alias: Column) -> Column:
    """The statement that imports one name."""
    suffix = F.when(alias.isNotNull() & (alias != name), F.concat(F.lit(" as "), alias)).otherwise(F.lit(""))
    quoted = F.concat(F.lit(" from '"), module, F.lit("'"))
    return (
        F.when(kind == "import", F.concat(F.lit("import "), name, suffix))
        .when(kind.isin("from_import", "future_import"), F.concat(F.lit("from "), module, F.lit(" import "), name, suffix))
        .when(kind == "default_import", F.concat(F.lit("import "), F.coalesce(alias, name), quoted))
        .when(kind == "namespace_import", F.concat(F.lit("import * as "), alias, quoted))
        .when(kind == "side_effect", F.concat(F.lit("import '"), module, F.lit("'")))
        .otherwise(F.concat(F.lit("import { "), name, suffix, F.lit(" }"), quoted))
    )


def move_to_file(g: CodeGraph, targets: DataFrame, to_path: str, strategy: str = "update_all_imports") -> DataFrame:
    """Python symbols into another file, with the imports that they need there.

    update_all_imports: importers import from the new place; add_back_edge: the old file imports the symbol back, so
    that importers stay as they are; duplicate_dependencies: as the first, and what only the symbol uses of its old
    file is copied along instead of imported.
    """
    s = _of(g, targets).where(F.col("_path") != to_path)
    src = g.sources.select(F.col("path").alias("_p"), F.col("content").cast("binary").alias("_content"))
    body = s.join(src, F.col("_path") == F.col("_p")).withColumn("_text", F.substring("_content", F.col("range.start_byte") + 1, F.col("range.end_byte") - F.col("range.start_byte")).cast("string"))
    target_module = S.python_module(F.lit(to_path))
    exists = g.get_file(to_path).limit(1).count() > 0
    moved = s.select(F.col("id").alias("_id"), F.col("name").alias("_name"), F.col("file_id").alias("_from"), F.col("module_name").alias("_module"), "_path")
    out = planned(s, "_path", "remove_lines", "range.start_byte", "range.end_byte")
    # what the symbols use: imports of their file, and neighbours in it
    inner = g.symbols.join(moved.select("_id"), F.col("id") == F.col("_id"), "left_semi").select(F.col("id").alias("source_symbol_id"))
    used = g.references.join(inner, "source_symbol_id", "left_semi").select("import_id", "target_symbol_id").unionAll(g.external_references.join(inner, "source_symbol_id", "left_semi").select("import_id", F.lit(None).cast("long")))
    imps = g.imports.join(used.where("import_id is not null").select(F.col("import_id").alias("id")).distinct(), "id", "left_semi")
    pkg = g.files.select(F.col("id").alias("_pf"), S.package_of(F.col("path"), F.col("module_name")).alias("_pkg"))
    imps = imps.join(pkg, F.col("file_id") == F.col("_pf"))
    lines = imps.select(statement(F.col("kind"), S.absolute_module(F.coalesce("module", F.lit("")), F.col("_pkg")), F.col("name"), F.col("alias")).alias("statement"))
    near = g.symbols.join(used.where("import_id is null").select(F.col("target_symbol_id").alias("id")).distinct(), "id", "left_semi").join(moved.select(F.col("_id").alias("id")), "id", "left_anti").where("is_top_level")
    copied = None
    if strategy == "duplicate_dependencies":
        copied = _located(g, near).join(src, F.col("_path") == F.col("_p")).select("id", F.substring("_content", F.col("range.start_byte") + 1, F.col("range.end_byte") - F.col("range.start_byte")).cast("string").alias("_text"))
    else:
        lines = lines.unionAll(_located(g, near).select(F.concat(F.lit("from "), F.col("module_name"), F.lit(" import "), F.col("name")).alias("statement")))
    text = body.select("id", "_text") if copied is None else body.select("id", "_text").unionAll(copied)
    block = text.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "_text"))), lambda x: x["_text"]), "\n\n\n").alias("_block"))  # the moved code becomes one file
    head = lines.distinct().agg(F.array_join(F.array_sort(F.collect_list("statement")), "\n").alias("_head"))
    if exists:
        end = g.get_file(to_path).select("path", F.col("root_range.end_byte").alias("_end"))
        out = out.unionAll(planned(end.crossJoin(F.broadcast(block)), "path", "insert", "_end", "_end", F.concat(F.lit("\n\n"), "_block", F.lit("\n")), seq=5))
        out = out.unionAll(add_import(g, lines.distinct().withColumn("path", F.lit(to_path))))
    else:
        new = block.crossJoin(F.broadcast(head))  # one row each
        out = out.unionAll(planned(new, F.lit(to_path), "file_add", F.lit(0), F.lit(0), F.concat("_head", F.when(F.col("_head") != "", "\n\n\n").otherwise(""), "_block", F.lit("\n"))))
    if strategy == "add_back_edge":
        back = moved.select(F.col("_path").alias("path"), F.concat(F.lit("from "), target_module, F.lit(" import "), F.col("_name")).alias("statement"))
        return out.unionAll(add_import(g, back))
    if strategy not in ("update_all_imports", "duplicate_dependencies"):
        raise ValueError(f"unknown strategy {strategy!r}")
    # importers, and the old file where it still uses the symbols
    i = g.imports.where("kind = 'from_import'").join(g.import_resolutions.select(F.col("import_id").alias("id"), "target_symbol_id", "target_file_id"), "id")
    i = _located(g, i.join(moved.select("_id", "_from"), (F.col("target_symbol_id") == F.col("_id")) & (F.col("target_file_id") == F.col("_from")))).drop("module_name")
    size = g.imports.groupBy(F.col("file_id").alias("_sf"), F.col("range.start_byte").alias("_sa")).agg(F.count("*").alias("_n"))
    i = i.join(size, (F.col("file_id") == F.col("_sf")) & (F.col("range.start_byte") == F.col("_sa")))
    line = statement(F.col("kind"), target_module, F.col("name"), F.col("alias"))
    alone = planned(i.where("_n = 1"), "_path", "edit", "range.start_byte", "range.end_byte", line)
    # one of several names: the statement loses it, and a new one follows
    several = i.where("_n > 1").select("id", "_path", "range", line.alias("_line"))
    rest = g.imports.join(several.select("id", F.lit(True).alias("_out")), "id", "left").join(several.select(F.col("_path"), F.col("range.start_byte").alias("_a")).distinct().join(_paths(g).select("_f", F.col("_path").alias("_q")), F.col("_path") == F.col("_q")).select("_f", "_a", "_path"), (F.col("file_id") == F.col("_f")) & (F.col("range.start_byte") == F.col("_a")))
    one = F.concat(F.col("name"), F.when(F.col("alias").isNotNull(), F.concat(F.lit(" as "), F.col("alias"))).otherwise(""))
    kept = F.transform(F.filter(F.array_sort(F.collect_list(F.struct("id", F.when(F.col("_out").isNull(), one).alias("n")))), lambda x: x["n"].isNotNull()), lambda x: x["n"])
    both = rest.groupBy("_path", F.col("range.start_byte").alias("a"), F.col("range.end_byte").alias("b"), "module").agg(kept.alias("kept"))
    more = several.groupBy("_path", F.col("range.start_byte").alias("a")).agg(F.array_join(F.array_sort(F.collect_set("_line")), "\n").alias("_more"))
    both = both.join(more, ["_path", "a"])
    text = F.concat(F.when(F.size("kept") > 0, F.concat(F.lit("from "), F.col("module"), F.lit(" import "), F.array_join("kept", ", "), F.lit("\n"))).otherwise(""), F.col("_more"))
    out = out.unionAll(alone).unionAll(planned(both, "_path", "edit", "a", "b", text))
    own = g.references.where("import_id is null").join(moved, (F.col("target_symbol_id") == F.col("_id")) & (F.col("source_file_id") == F.col("_from"))).join(moved.select(F.col("_id").alias("source_symbol_id")), "source_symbol_id", "left_anti")
    back = own.select(F.col("_path").alias("path"), F.concat(F.lit("from "), target_module, F.lit(" import "), F.col("_name")).alias("statement"))
    return out.unionAll(add_import(g, back))


def rename_file(g: CodeGraph, path: str, new_path: str) -> DataFrame:
    """A file's path, and the module in the import statements that mean it (Python)."""
    f = g.get_file(path).select(F.col("id").alias("_id"), "path", F.col("module_name").alias("_old"))
    out = planned(f, "path", "file_rename", F.lit(0), F.lit(0), new_path)
    r = g.import_resolutions.join(f.select(F.col("_id").alias("target_file_id"), "_old"), "target_file_id")
    i = _located(g, g.imports.join(r.select(F.col("import_id").alias("id"), "_old"), "id")).drop("module_name")
    new = S.python_module(F.lit(new_path))
    src = g.sources.select(F.col("path").alias("_p"), F.col("content").cast("binary").alias("_content"))
    i = i.join(src, F.col("_path") == F.col("_p")).withColumn("_text", F.substring("_content", F.col("range.start_byte") + 1, F.col("range.end_byte") - F.col("range.start_byte")).cast("string"))
    text = F.when(F.col("kind") == "import", F.replace(F.col("_text"), F.col("_old"), new)).otherwise(F.concat(F.lit("from "), new, F.regexp_extract("_text", r"(?s)^from\s+\S+(\s+import.*)$", 1)))
    named = (F.col("kind") == "import") | F.endswith(F.col("_old"), F.regexp_replace(F.coalesce("module", F.lit("")), r"^\.+", ""))
    return out.unionAll(planned(i.where(named).dropDuplicates(["_path", "range"]), "_path", "edit", "range.start_byte", "range.end_byte", text))


def rename_parameter(g: CodeGraph, targets: DataFrame, old: str, new: str) -> DataFrame:
    """A parameter of the functions, its uses inside them, and its keyword in calls."""
    s = _of(g, targets)
    ids = s.select(F.col("id").alias("symbol_id"), "_path")
    inside = g.identifiers.where((F.col("name") == old) & (F.col("role") != "keyword")).join(ids, "symbol_id")
    out = planned(inside, "_path", "edit", "start_byte", "end_byte", new)
    a = g.arguments().where(F.col("name") == old).join(ids.select(F.col("symbol_id").alias("target_symbol_id")), "target_symbol_id", "left_semi")
    width = len(old.encode())
    return out.unionAll(planned(_located(g, a, "source_file_id"), "_path", "edit", "start_byte", F.col("start_byte") + width, new, seq=1))


def rename_local(g: CodeGraph, targets: DataFrame, old: str, new: str, fuzzy: bool = False) -> DataFrame:
    """A local variable in the functions; fuzzy: any variable whose name holds the old text, in which it is replaced."""
    ids = _of(g, targets).select(F.col("id").alias("symbol_id"), "_path")
    hit = F.col("name").contains(old) if fuzzy else F.col("name") == old
    stored = g.identifiers.where("role in ('store', 'parameter')").where(hit).join(ids, "symbol_id").select("symbol_id", "name").distinct()
    uses = g.identifiers.where("role <> 'keyword'").join(stored, ["symbol_id", "name"], "left_semi").join(ids, "symbol_id")
    return planned(uses, "_path", "edit", "start_byte", "end_byte", F.replace(F.col("name"), F.lit(old), F.lit(new)))


def keyword_arguments(g: CodeGraph, targets: DataFrame, at_least: int = 1) -> DataFrame:
    """Positional arguments of calls of the functions get their parameter's name; calls with fewer arguments stay."""
    a = g.arguments().join(targets.select(F.col("id").alias("target_symbol_id")).distinct(), "target_symbol_id", "left_semi")
    n = a.groupBy("call_id").agg(F.count("*").alias("_n"), F.count_if(F.col("value").startswith("*")).alias("_star")).where((F.col("_n") >= at_least) & (F.col("_star") == 0)).select("call_id")
    a = a.join(n, "call_id", "left_semi").where("name is null and parameter is not null")
    return planned(_located(g, a, "source_file_id"), "_path", "insert", "start_byte", "start_byte", F.concat("parameter", F.lit("=")))


def set_keyword(g: CodeGraph, targets: DataFrame, name: str, value: str, create: bool = True, override: bool = True) -> DataFrame:
    """One keyword argument in all calls of the functions, set or added at the end."""
    c = g.calls.join(targets.select(F.col("id").alias("target_symbol_id")).distinct(), "target_symbol_id", "left_semi")
    c = _located(g, c, "source_file_id").withColumn("_hit", F.get(F.filter("arguments", lambda x: x["name"] == name), 0))
    out = planned(c.where("_hit is not null"), "_path", "edit", "_hit.start_byte", "_hit.end_byte", f"{name}={value}") if override else None
    if create:
        end = F.col("range.end_byte") - 1
        comma = F.when(F.size("arguments") > 0, ", ").otherwise("")
        more = planned(c.where("_hit is null"), "_path", "insert", end, end, F.concat(comma, F.lit(f"{name}={value}")))
        out = more if out is None else out.unionAll(more)
    return out if out is not None else planned(c.where(F.lit(False)), "_path", "insert", "range.end_byte", "range.end_byte", "")


def asyncify(g: CodeGraph, targets: DataFrame) -> DataFrame:
    """Functions become async, and their calls awaited where the caller is or becomes async."""
    s = _of(g, targets).where("not is_async")
    word = F.when(F.lit(g.language == "python"), F.col("name_start") - 4).otherwise(F.col("range.start_byte"))
    out = planned(s, "_path", "insert", word, word, "async ")
    late = g.symbols.where("is_async").select(F.col("id").alias("source_symbol_id")).unionAll(targets.select("id")).distinct()
    c = g.calls.join(s.select(F.col("id").alias("target_symbol_id")), "target_symbol_id", "left_semi").join(late, "source_symbol_id", "left_semi")
    return out.unionAll(planned(_located(g, c, "source_file_id"), "_path", "insert", "range.start_byte", "range.start_byte", "await ", seq=1))


def add_decorator(g: CodeGraph, targets: DataFrame, decorator: str) -> DataFrame:
    """A decorator line above the symbols that don't have it."""
    bare = decorator.lstrip("@")
    s = _of(g, targets).where(~F.array_contains("decorators", bare))
    return planned(s, "_path", "insert", "range.start_byte", "range.start_byte", F.concat(F.lit(f"@{bare}\n"), F.repeat(F.lit(" "), F.col("range.start_column").cast("int"))))


def set_return_type(g: CodeGraph, targets: DataFrame, annotation: str | Column) -> DataFrame:
    """The return annotation of functions, set anew or added; a column may depend on the symbol's."""
    text = F.lit(annotation) if isinstance(annotation, str) else annotation
    s = _of(g, targets).where("returns_start is not null").withColumn("_new", text)
    mark = " -> " if g.language == "python" else ": "
    there = planned(s.where("returns is not null"), "_path", "edit", "returns_start", "returns_end", F.col("_new"))
    return there.unionAll(planned(s.where("returns is null"), "_path", "insert", "returns_start", "returns_start", F.concat(F.lit(mark), "_new")))


def set_docstring(g: CodeGraph, targets: DataFrame, text: str) -> DataFrame:
    """The docstring of Python symbols, replaced or put before the first statement."""
    body = '"""' + text.replace('"""', '\\"""') + '"""'
    s = _of(g, targets).where("body_start is not null")
    indent = F.repeat(F.lit(" "), (F.col("range.start_column") + 4).cast("int"))
    there = planned(s.where("doc_start is not null"), "_path", "edit", "doc_start", "doc_end", body)
    return there.unionAll(planned(s.where("doc_start is null"), "_path", "insert", "body_start", "body_start", F.concat(F.lit(body + "\n"), indent)))


def prepend_statements(g: CodeGraph, targets: DataFrame, lines: str) -> DataFrame:
    """Statements before the first of a function's body (after its docstring)."""
    s = _of(g, targets).where("body_start is not null")
    indent = F.repeat(F.lit(" "), (F.col("range.start_column") + 4).cast("int"))
    block = F.array_join(F.transform(F.split(F.lit(lines), "\n"), lambda x: F.concat(x, F.lit("\n"), indent)), "")
    before = planned(s.where("doc_end is null"), "_path", "insert", "body_start", "body_start", block)
    after = F.array_join(F.transform(F.split(F.lit(lines), "\n"), lambda x: F.concat(F.lit("\n"), indent, x)), "")
    return before.unionAll(planned(s.where("doc_end is not null"), "_path", "insert", "doc_end", "doc_end", after))


def set_comment(g: CodeGraph, targets: DataFrame, text: str) -> DataFrame:
    """A comment above the symbols, in the language's style."""
    mark = "# " if g.language == "python" else "// "
    s = _of(g, targets)
    indent = F.repeat(F.lit(" "), F.col("range.start_column").cast("int"))
    block = F.array_join(F.transform(F.split(F.lit(text), "\n"), lambda x: F.concat(F.lit(mark), x, F.lit("\n"), indent)), "")
    return planned(s, "_path", "insert", "range.start_byte", "range.start_byte", block)


def rename_tag(g: CodeGraph, old: str, new: str) -> DataFrame:
    """JSX elements under another name, opening and closing."""
    e = _located(g, g.jsx_elements.where(F.col("name") == old), "source_file_id")
    return planned(e, "_path", "edit", "name_start", "name_end", new).unionAll(planned(e.where("close_start is not null"), "_path", "edit", "close_start", "close_end", new))


def set_prop(g: CodeGraph, tag: str, name: str, value: str) -> DataFrame:
    """A property of JSX elements, replaced or added."""
    e = _located(g, g.jsx_elements.where(F.col("name") == tag), "source_file_id")
    p = g.jsx_props.where(F.col("name") == name).select(F.col("parent_jsx_element_id").alias("_e"), F.col("range").alias("_pr"))
    e = e.join(p, F.col("id") == F.col("_e"), "left")
    return planned(e.where("_pr is not null"), "_path", "edit", "_pr.start_byte", "_pr.end_byte", f"{name}={value}").unionAll(planned(e.where("_pr is null"), "_path", "insert", "name_end", "name_end", f" {name}={value}"))


def wrap_elements(g: CodeGraph, tag: str, wrapper: str) -> DataFrame:
    """JSX elements inside a new element each."""
    e = _located(g, g.jsx_elements.where(F.col("name") == tag), "source_file_id")
    return planned(e, "_path", "insert", "range.start_byte", "range.start_byte", f"<{wrapper}>").unionAll(planned(e, "_path", "insert", "range.end_byte", "range.end_byte", f"</{wrapper}>"))


def unused_exports(g: CodeGraph) -> DataFrame:
    """Exports of declarations that no other file imports or refers to (TypeScript)."""
    used = g.import_resolutions.where("target_symbol_id is not null").select(F.col("target_symbol_id").alias("symbol_id"))
    used = used.unionAll(g.references.join(g.symbols.select(F.col("id").alias("_t"), F.col("file_id").alias("_tf")), F.col("target_symbol_id") == F.col("_t")).where("source_file_id <> _tf").select(F.col("target_symbol_id").alias("symbol_id")))
    return g.exports.where("symbol_id is not null and kind = 'named'").join(used.distinct(), "symbol_id", "left_anti")


def remove_unused_exports(g: CodeGraph) -> DataFrame:
    """The word export before declarations that nothing outside their file uses."""
    e = _located(g, unused_exports(g).join(g.symbols.select(F.col("id").alias("symbol_id"), F.col("range.start_byte").alias("_at")), "symbol_id"))
    return planned(e, "_path", "remove", "range.start_byte", "_at")


def search(g: CodeGraph | DataFrame, pattern: str, replacement: str | None = None) -> DataFrame:
    """(path, start_byte, end_byte, text) of a pattern's matches in a graph's or a table's sources; with a replacement, the edits.

    Matches are Java's; offsets are running sums of the lengths of matches and of what lies between them, one pass a file.
    """
    sources = g if isinstance(g, DataFrame) else g.sources
    t = sources.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("_t"))
    m = t.where(F.col("_t").rlike(pattern)).select("path", F.regexp_extract_all("_t", F.lit(pattern), F.lit(0)).alias("_m"), F.transform(F.split("_t", pattern, -1), F.octet_length).alias("_g"))
    gaps = F.concat(F.array_repeat(F.lit(0), F.size("_m") + 1 - F.size("_g")), "_g")  # a split has no part before an empty match at the start
    x = m.select("path", "_m", F.slice(gaps, F.lit(1), F.size("_m")).alias("_g")).mapInArrow(_places, schema="path string, start_byte bigint, end_byte bigint, text string")
    if replacement is None:
        return x
    return planned(x, "path", "edit", "start_byte", "end_byte", F.regexp_replace("text", pattern, replacement))


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each match, from (path, matches, bytes before each since the last)."""
    for batch in batches:
        n = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
        row, text = np.repeat(np.arange(len(n)), n), batch.column(1).flatten()
        size = pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64)
        end = np.cumsum(size + batch.column(2).flatten().to_numpy(zero_copy_only=False))
        end -= np.concatenate(([0], end))[np.cumsum(n) - n][row]
        for k in range(0, len(row), PLACES):
            s = slice(k, k + PLACES)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[s])), pa.array(end[s] - size[s]), pa.array(end[s]), text[s]], names=["path", "start_byte", "end_byte", "text"])
