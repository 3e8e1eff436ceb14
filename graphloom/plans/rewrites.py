"""Edits of classes, collections, exports and namespaces, and of single definitions, as tables of edits."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import expressions as X
from graphloom.operators.edits import planned
from graphloom.plans import refactor as R
from graphloom.plans.codegraph import CodeGraph


def sliced(g: CodeGraph, located: DataFrame, start: str, end: str, out: str = "_source") -> DataFrame:
    """Rows that have _path, with the text of a byte range of their file."""
    src = g.sources.select(F.col("path").alias("_sp"), F.col("content").cast("binary").alias("_sc"))
    text = F.substring("_sc", F.col(start) + 1, F.col(end) - F.col(start)).cast("string")
    return located.join(src, F.col("_path") == F.col("_sp")).withColumn(out, text).drop("_sp", "_sc")


def mapped(df: DataFrame, column: str, function: Callable[[str], str | None], out: str = "_new") -> DataFrame:
    """df with what a Python function makes of a text column, in one Arrow pass; where it fails, null."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = []
            for t in batch.column(names.index(column)).to_pylist():
                try:
                    new.append(None if t is None else function(t))
                except (SyntaxError, ValueError):
                    new.append(None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(new, pa.string())], names=[*batch.schema.names, out])

    return df.mapInArrow(run, df.withColumn(out, F.lit(None).cast("string")).schema)


def rewrite_each(g: CodeGraph, targets: DataFrame, function: Callable[[str], str | None]) -> DataFrame:
    """Symbols' sources as a function of them, where it changes them."""
    s = sliced(g, R._of(g, targets), "range.start_byte", "range.end_byte").select("_path", "range", "_source")
    s = mapped(s, "_source", function).where("_new is not null and _new <> _source")
    return planned(s, "_path", "edit", "range.start_byte", "range.end_byte", F.col("_new"))


# classes --------------------------------------------------------------------------------------------------------------


def _indent(levels: int = 4) -> Column:
    return F.repeat(F.lit(" "), (F.col("range.start_column") + levels).cast("int"))


def add_attribute(g: CodeGraph, targets: DataFrame, line: str) -> DataFrame:
    """A line after the last attribute of classes, else before their first statement."""
    c = R._of(g, targets)
    last = g.members.where("kind = 'attribute'").groupBy(F.col("symbol_id").alias("id")).agg(F.max("range.end_byte").alias("_last"))
    c = c.join(last, "id", "left")
    after = planned(c.where("_last is not null"), "_path", "insert", "_last", "_last", F.concat(F.lit("\n"), _indent(), F.lit(line)))
    return after.unionAll(R.prepend_statements(g, c.where("_last is null").select("id"), line))


def add_source(g: CodeGraph, targets: DataFrame, source: str) -> DataFrame:
    """Source, such as a method, at the end of classes, indented as their bodies are."""
    if g.language == "python":
        lines = F.transform(F.split(F.lit(source), "\n"), lambda x: F.when(x == "", x).otherwise(F.concat(_indent(), x)))
        return planned(R._of(g, targets), "_path", "insert", "range.end_byte", "range.end_byte", F.concat(F.lit("\n\n"), F.array_join(lines, "\n")))
    lines = F.array_join(F.transform(F.split(F.lit(source), "\n"), lambda x: F.concat(F.lit("  "), x)), "\n")
    at = F.col("range.end_byte") - 1  # before the closing brace
    return planned(R._of(g, targets), "_path", "insert", at, at, F.concat(lines, F.lit("\n")))


def remove_attribute(g: CodeGraph, targets: DataFrame, name: str) -> DataFrame:
    """An attribute of classes."""
    m = g.members.where((F.col("kind") == "attribute") & (F.col("name") == name)).join(targets.select(F.col("id").alias("symbol_id")).distinct(), "symbol_id", "left_semi")
    return planned(R._located(g, m), "_path", "remove_lines", "range.start_byte", "range.end_byte")


def declassify(g: CodeGraph, targets: DataFrame) -> DataFrame:
    """Methods of Python classes as functions of the file in place of the class."""
    s = sliced(g, R._of(g, targets), "range.start_byte", "range.end_byte").select("_path", "range", "name", "_source")
    s = s.withColumn("_both", F.concat("name", F.lit("\n"), "_source"))
    s = mapped(s, "_both", lambda t: X.declassified(t.split("\n", 1)[1], t.split("\n", 1)[0])).where("_new is not null")
    return planned(s, "_path", "edit", "range.start_byte", "range.end_byte", F.col("_new"))


# collections ----------------------------------------------------------------------------------------------------------


def edit_value(g: CodeGraph, targets: DataFrame, function: Callable[[str], str]) -> DataFrame:
    """The right side of global variables' assignments as a function of it, e.g. one of the collection functions."""

    def change(source: str) -> str | None:
        head, mark, value = source.partition("=")
        return f"{head}{mark} {function(value.strip())}" if mark else None

    return rewrite_each(g, targets.join(g.symbols.where("kind = 'global_variable'").select("id"), "id", "left_semi"), change)


def edit_arguments(g: CodeGraph, targets: DataFrame, function: Callable[[str], str]) -> DataFrame:
    """The arguments of all calls of the targets, as a function of the call's source."""
    c = g.calls.join(targets.select(F.col("id").alias("target_symbol_id")).distinct(), "target_symbol_id", "left_semi")
    c = sliced(g, R._located(g, c, "source_file_id"), "name_end", "range.end_byte").select("_path", F.col("name_end").alias("_a"), F.col("range.end_byte").alias("_b"), "_source")
    c = mapped(c, "_source", function).where("_new is not null and _new <> _source")
    return planned(c, "_path", "edit", "_a", "_b", F.col("_new"))


# exports and namespaces -----------------------------------------------------------------------------------------------


def reexports(g: CodeGraph, path: str) -> DataFrame:
    """Export rows that pass on what another file exports, by the path they name (as written, without extension)."""
    return g.exports.where(F.col("source_module").isNotNull() & (F.regexp_replace("source_module", r"\.(ts|tsx|js|jsx)$", "") == path.rsplit(".", 1)[0] if "." in path.rsplit("/", 1)[-1] else F.col("source_module") == path))


def make_non_default(g: CodeGraph, targets: DataFrame) -> DataFrame:
    """Default exports of the symbols as named ones, and the imports of them by name."""
    s = sliced(g, R._of(g, targets).withColumn("_from", F.greatest(F.lit(0), F.col("range.start_byte") - 32)), "_from", "name_start").select("id", "name", "_path", "range", "name_start", "_source", "_from")
    word = F.regexp_extract("_source", r"export\s+(default\s+)", 1)
    at = F.col("name_start") - F.octet_length(F.regexp_extract("_source", r"export\s+(default\s+[\s\S]*)$", 1))
    own = planned(s.where(word != ""), "_path", "remove", at, at + F.octet_length(word))
    i = g.imports.where("kind = 'default_import'").join(g.import_resolutions.select(F.col("import_id").alias("id"), "target_symbol_id"), "id")
    i = i.join(s.where(word != "").select(F.col("id").alias("target_symbol_id"), F.col("name").alias("_real")), "target_symbol_id")
    binding = F.coalesce("alias", "name")
    named = F.when(binding == F.col("_real"), F.col("_real")).otherwise(F.concat("_real", F.lit(" as "), binding))
    i = sliced(g, R._located(g, i).withColumn("_to", F.col("range.end_byte") + 64), "range.end_byte", "_to")
    more = F.regexp_extract("_source", r"^\s*,\s*\{\s*", 0)  # a braced list after the default binding
    text = F.concat(F.lit("{ "), named, F.when(more != "", F.lit(", ")).otherwise(F.lit(" }")))
    return own.unionAll(planned(i, "_path", "edit", "range.start_byte", F.col("range.end_byte") + F.octet_length(more), text, seq=1))


def reexport(g: CodeGraph, targets: DataFrame, path: str, module: str) -> DataFrame:
    """A line in a file that passes the symbols on from a module."""
    s = R._of(g, targets).select("name").groupBy().agg(F.array_sort(F.collect_set("name")).alias("names"))  # the symbols asked for
    f = g.files.where(F.col("path") == path).select(F.col("path").alias("_path"), "byte_len").join(g.sources.select(F.col("path").alias("_path"), F.col("content").cast("string").alias("_t")), "_path")
    line = F.concat(F.when(F.col("_t").rlike(r"[^\n]\z"), "\n").otherwise(""), F.lit("export { "), F.array_join("names", ", "), F.lit(f" }} from '{module}';\n"))
    return planned(f.join(F.broadcast(s)), "_path", "insert", "byte_len", "byte_len", line)


def namespace_symbols(g: CodeGraph, targets: DataFrame, name: str | None = None) -> DataFrame:
    """Symbols that stand in the namespaces, or that of a name."""
    s = g.symbols.join(targets.select(F.col("id").alias("parent_symbol_id")).distinct(), "parent_symbol_id", "left_semi")
    return s if name is None else s.where(F.col("name") == name)


def add_to_namespace(g: CodeGraph, targets: DataFrame, source: str, export: bool = True) -> DataFrame:
    """A declaration at the end of namespaces."""
    return add_source(g, targets, ("export " if export and not source.startswith("export ") else "") + source)


def export_in_namespace(g: CodeGraph, targets: DataFrame, name: str) -> DataFrame:
    """The word export before a declaration of the namespaces that lacks it."""
    s = R._located(g, namespace_symbols(g, targets, name)).withColumn("_from", F.greatest(F.lit(0), F.col("range.start_byte") - 16))
    s = sliced(g, s, "_from", "name_start")
    return planned(s.where(~F.col("_source").rlike(r"\bexport\b")), "_path", "insert", "range.start_byte", "range.start_byte", "export ")


def remove_from_namespace(g: CodeGraph, targets: DataFrame, name: str) -> DataFrame:
    return R.remove(g, namespace_symbols(g, targets, name).select("id"))


def rename_in_namespace(g: CodeGraph, targets: DataFrame, old: str, new: str) -> DataFrame:
    return R.rename(g, namespace_symbols(g, targets, old).select("id"), new)


# questions about source -----------------------------------------------------------------------------------------------


def signatures(g: CodeGraph) -> DataFrame:
    """(id, name, signature) of functions and methods."""
    s = sliced(g, R._located(g, g.symbols.where("kind = 'function'")), "range.start_byte", "range.end_byte").select("id", "name", "_source")
    return mapped(s, "_source", X.signature, "signature").drop("_source")


def awaited_calls(g: CodeGraph) -> DataFrame:
    """Calls with is_awaited: whether the word await stands before them, with brackets at most between."""
    c = R._located(g, g.calls, "source_file_id").withColumn("_from", F.greatest(F.lit(0), F.col("range.start_byte") - 64))
    return sliced(g, c, "_from", "range.start_byte").withColumn("is_awaited", F.col("_source").rlike(r"(^|[^\w$])await[\s(]*$")).drop("_source", "_from", "_path")


def source_urls(g: CodeGraph, base: str, ref: str = "main") -> DataFrame:
    """(id, url): where a hosted repository shows each symbol's lines."""
    s = R._located(g, g.symbols)
    lines = F.format_string("#L%d-L%d", F.col("range.start_row") + 1, F.col("range.end_row") + 1)
    return s.select("id", F.concat(F.lit(f"{base.rstrip('/')}/blob/{ref}/"), "_path", lines).alias("url"))


def conditional_definitions(g: CodeGraph) -> DataFrame:
    """(file_id, symbol_id, name, statement_id, branches): names that several branches of one conditional statement bind.

    A use of such a name may mean any of them, unlike one that a later definition replaces.
    """
    bound = g.identifiers.where("role = 'store'")
    block = g.statements.where("kind in ('if', 'elif', 'else', 'try', 'except', 'match', 'case', 'switch')").select(F.col("file_id").alias("_f"), F.col("id").alias("statement_id"), F.col("range.start_byte").alias("_a"), F.col("range.end_byte").alias("_b"))
    inside = bound.join(block, (F.col("file_id") == F.col("_f")) & (F.col("_a") <= F.col("start_byte")) & (F.col("end_byte") <= F.col("_b")))
    n = inside.groupBy("file_id", "symbol_id", "name", "statement_id").agg(F.countDistinct("start_byte").alias("branches"), F.min("_a").alias("_a"), F.max("_b").alias("_b"))
    return n.where("branches > 1").drop("_a", "_b")
