"""Derived views of a code graph: usages with kinds, class members through the resolution order, scopes, chains, reports."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import scalar as S
from graphloom.operators import aggregates as A
from graphloom.operators import joins as J
from graphloom.operators import rows as W
from graphloom.operators import traversal as T
from graphloom.plans.codegraph import USAGE_TYPES, CodeGraph


def _in(df: DataFrame, other: DataFrame, column: str, key: str = "id") -> DataFrame:
    """Rows of df whose column is among other's keys."""
    return df.join(other.select(F.col(key).alias("_in")).distinct(), F.col(column) == F.col("_in"), "left_semi")


# files and lookups ----------------------------------------------------------------------------------------------------


def files(g: CodeGraph, extensions: list[str] | str | None = None) -> DataFrame:
    """Source files, those with the given extensions, or with "*" every file of the scan, by name and path."""
    if extensions == "*":
        return g.sources.select("path", F.octet_length("content").alias("byte_len")).orderBy(S.file_name(F.col("path")), "path")
    f = g.files if extensions is None else g.files.where(S.extension(F.col("path")).isin([e if e.startswith(".") else f".{e}" for e in extensions]))
    return f.orderBy(S.file_name(F.col("path")), "path")


def directory(g: CodeGraph, path: str, recursive: bool = False) -> DataFrame:
    """Files of a directory; with recursive also those below it."""
    prefix = path.strip("/") + "/" if path.strip("/") else ""
    f = g.files.where(F.startswith("path", F.lit(prefix)))
    return f if recursive else f.where(~F.expr(f"substring(path, {len(prefix) + 1})").contains("/"))


def directory_rollup(g: CodeGraph) -> DataFrame:
    """(directory, files, lines, bytes) of every directory, subdirectories included."""
    d = g.files.withColumn("directory", F.explode(F.concat(F.array(F.lit("")), S.directory_prefixes(F.col("path")))))
    return d.groupBy("directory").agg(F.count("*").alias("files"), F.sum("line_count").alias("lines"), F.sum("byte_len").alias("bytes"))


def by_span(g: CodeGraph, path: str, start: int, end: int) -> DataFrame:
    """Symbols, imports, calls and identifiers of a file that overlap a byte range, the shortest first."""
    f = g.get_file(path).select("id")
    at = lambda d, kind, a, b, name, file="file_id": _in(d, f, file).select(F.lit(kind).alias("kind"), F.col(name).alias("name"), F.col(a).alias("start_byte"), F.col(b).alias("end_byte"))
    r = ("range.start_byte", "range.end_byte")
    out = at(g.symbols, "symbol", *r, "name").unionAll(at(g.imports, "import", *r, "name")).unionAll(at(g.calls, "call", *r, "name", "source_file_id")).unionAll(at(g.identifiers, "identifier", "start_byte", "end_byte", "name"))
    return out.where((F.col("start_byte") < end) & (F.lit(start) < F.col("end_byte"))).orderBy(F.col("end_byte") - F.col("start_byte"), "start_byte", "kind")


def names_in_file(g: CodeGraph, path: str) -> DataFrame:
    """(name, kind, id) that a file binds at its top level: symbols, then imports, of one name the last."""
    f = g.get_file(path).select("id")
    s = _in(g.symbols.where("is_top_level"), f, "file_id").select("name", F.lit("symbol").alias("kind"), "id", F.col("range.start_byte").alias("at"))
    i = _in(g.imports, f, "file_id").where("owner is null").select(S.import_binding(F.col("kind"), F.col("module"), F.col("name"), F.col("alias")).alias("name"), F.lit("import").alias("kind"), "id", F.col("range.start_byte").alias("at"))
    return J.last_wins(s.unionAll(i.where("name is not null")), ["name"], ["at", "id"]).select("name", "kind", "id")


def predicates(g: CodeGraph) -> DataFrame:
    """Functions with what their names, decorators and places make of them."""
    parent = g.symbols.select(F.col("id").alias("_p"), F.col("kind").alias("_pk"))
    f = g.symbols.where("kind = 'function'").join(parent, F.col("parent_symbol_id") == F.col("_p"), "left")
    has = lambda p: F.exists("decorators", lambda d: d.rlike(p))
    tagged = g.jsx_elements.select(F.col("source_symbol_id").alias("_j")).where("_j is not null").distinct()
    f = f.join(tagged, F.col("id") == F.col("_j"), "left")
    return f.select(
        "id", "name", "is_private", "is_magic", "is_async", (F.size("decorators") > 0).alias("is_decorated"), (F.coalesce("_pk", F.lit("")) == "class").alias("is_method"),
        (F.col("name").isin("__init__", "constructor") & F.col("_p").isNotNull()).alias("is_constructor"), has(r"^(\w+\.)*(cached_)?property$").alias("is_property"), has(r"^(typing\.)?overload$").alias("is_overload"),
        has("^staticmethod$").alias("is_static_method"), has("^classmethod$").alias("is_class_method"), F.col("_j").isNotNull().alias("is_jsx"),
    )


def import_predicates(g: CodeGraph) -> DataFrame:
    """Imports with what they import: a module, a symbol, all names, under an alias, at run time, from the repository."""
    r = g.import_resolutions.select(F.col("import_id").alias("_i"), "target_file_id", "target_symbol_id")
    i = g.imports.join(r, F.col("id") == F.col("_i"), "left")
    again = g.exports.select(F.col("import_id").alias("_e")).where("_e is not null").distinct()
    i = i.join(again, F.col("id") == F.col("_e"), "left")
    return i.select(
        "id", "file_id", "kind", "module", "name", F.coalesce(F.col("alias") != F.col("name"), F.lit(False)).alias("is_aliased"), ((F.col("name") == "*") & F.col("kind").isin("from_import", "namespace_import")).alias("is_wildcard"),
        (F.col("target_file_id").isNotNull() & F.col("target_symbol_id").isNull()).alias("is_module"), F.col("target_symbol_id").isNotNull().alias("is_symbol"), (F.col("kind") == "dynamic_import").alias("is_dynamic"),
        F.col("_e").isNotNull().alias("is_reexport"), F.col("target_file_id").isNull().alias("is_external"),
    )


def find(g: CodeGraph, texts: list[str] | str, exact: bool = False) -> DataFrame:
    """String literals and identifiers that hold (or are) one of the texts."""
    wanted = [texts] if isinstance(texts, str) else texts
    both = g.string_literals.select("file_id", F.col("value").alias("text"), "start_byte", "end_byte", F.lit("string").alias("kind")).unionAll(g.identifiers.select("file_id", F.col("name").alias("text"), "start_byte", "end_byte", F.lit("identifier").alias("kind")))
    cond = F.lit(False)
    for w in wanted:
        cond |= F.col("text") == w if exact else F.col("text").contains(w)
    return both.where(cond)


def variable_usages(g: CodeGraph, name: str | None = None, fuzzy: bool = False) -> DataFrame:
    """Names read as variables: no called names, no keywords of calls, no imported names."""
    called = g.calls.select(F.col("source_file_id").alias("file_id"), F.col("name_start").alias("start_byte"))
    v = g.identifiers.where("role = 'load'").join(called, ["file_id", "start_byte"], "left_anti")
    bound = g.imports.select("file_id", S.import_binding(F.col("kind"), F.col("module"), F.col("name"), F.col("alias")).alias("name")).where("name is not null").distinct()
    v = v.join(bound, ["file_id", "name"], "left_anti")
    return v if name is None else v.where(F.col("name").contains(name) if fuzzy else F.col("name") == name)


def assignments(g: CodeGraph, name: str | None = None, fuzzy: bool = False, parameters: bool = False) -> DataFrame:
    """Bindings of variables, with parameters if asked for."""
    a = g.identifiers.where(F.col("role").isin("store", "parameter") if parameters else F.col("role") == "store")
    return a if name is None else a.where(F.col("name").contains(name) if fuzzy else F.col("name") == name)


def unused_locals(g: CodeGraph) -> DataFrame:
    """(symbol_id, name) of local variables that are bound and never read in their function."""
    s = g.identifiers.where("role = 'store' and symbol_id is not null").join(g.symbols.where("kind = 'function'").select(F.col("id").alias("symbol_id")), "symbol_id", "left_semi")
    return s.select("symbol_id", "name").distinct().join(g.identifiers.where("role = 'load'").select("symbol_id", "name"), ["symbol_id", "name"], "left_anti")


def resolve_local(g: CodeGraph) -> DataFrame:
    """Reads of names in functions with the binding that precedes them: (symbol_id, name, at, defined_at), null if none."""
    uses = g.identifiers.where("role = 'load' and symbol_id is not null").select("symbol_id", "name", F.col("start_byte").alias("at"))
    defs = g.identifiers.where("role in ('store', 'parameter') and symbol_id is not null").select("symbol_id", "name", F.col("end_byte").alias("at"), F.col("start_byte").alias("defined_at"))
    return J.as_of(uses, defs, ["symbol_id", "name"], "at", ["defined_at"], strict=False).withColumnRenamed("prev_defined_at", "defined_at")


def statements(g: CodeGraph, kind: str | None = None, max_level: int | None = None) -> DataFrame:
    s = g.statements if kind is None else g.statements.where(F.col("kind") == kind)
    return s if max_level is None else s.where(F.col("level") <= max_level)


def modified_symbols(g: CodeGraph, patches: DataFrame) -> DataFrame:
    """Symbols whose lines overlap the added lines of unified diffs (path, patch)."""
    from graphloom.sources.repo import changed_lines

    c = changed_lines(patches).select(F.col("path").alias("_path"), "start", "length")
    s = g.symbols.join(g.files.select(F.col("id").alias("_f"), "path"), F.col("file_id") == F.col("_f"))
    first, last = F.col("range.start_row") + 1, F.col("range.end_row") + 1
    return s.join(c, (F.col("path") == F.col("_path")) & (first < F.col("start") + F.col("length")) & (F.col("start") <= last), "left_semi").drop("_f")


# usages ---------------------------------------------------------------------------------------------------------------


def usages(g: CodeGraph, types: int | None = None) -> DataFrame:
    """(target_symbol_id, source_symbol_id, name, kind, usage_type, start_byte, nth, ...), the last in a file first.

    usage_type is direct, aliased (another name is used), chained (through a qualifier) or indirect (through a file that
    passes the symbol on), as bits of USAGE_TYPES. types filters by bits; direct together with aliased means nothing.
    """
    if types is not None and types & USAGE_TYPES["direct"] and types & USAGE_TYPES["aliased"]:
        raise ValueError("a usage can't be direct and aliased")
    home = g.symbols.select(F.col("id").alias("target_symbol_id"), F.col("file_id").alias("_home"), F.col("name").alias("_real"))
    via = g.import_resolutions.select(F.col("import_id").alias("_i"), F.col("target_file_id").alias("_via"))
    q = g.candidates.select(F.col("source_file_id").alias("_cf"), F.col("range.start_byte").alias("_cs"), F.col("name").alias("_cn"), "qualifier", "is_subclass")
    r = g.references.join(home, "target_symbol_id").join(via, F.col("import_id") == F.col("_i"), "left")
    r = r.join(q, (F.col("source_file_id") == F.col("_cf")) & (F.col("range.start_byte") == F.col("_cs")) & (F.col("name") == F.col("_cn")), "left")
    bits = F.when(F.col("qualifier").isNotNull(), USAGE_TYPES["chained"]).when(F.col("name") != F.col("_real"), USAGE_TYPES["aliased"]).when(F.col("_via").isNotNull() & (F.col("_via") != F.col("_home")), USAGE_TYPES["indirect"]).otherwise(USAGE_TYPES["direct"])
    called = g.calls.select(F.col("source_file_id").alias("_kf"), F.col("name_start").alias("_ks")).distinct()
    r = r.join(called, (F.col("source_file_id") == F.col("_kf")) & (F.col("range.start_byte") == F.col("_ks")), "left")
    kind = F.when(F.col("is_subclass"), "subclass").when(F.col("_ks").isNotNull(), "call").otherwise("body")
    out = r.select("target_symbol_id", "source_file_id", "source_symbol_id", "import_id", "name", kind.alias("kind"), bits.alias("usage_type"), F.col("range.start_byte").alias("start_byte"))
    out = out if types is None else W.with_bits(out, "usage_type", types)
    return W.place_within(out, ["target_symbol_id"], ["source_file_id", F.desc("start_byte"), "name"], "nth", 1).orderBy("target_symbol_id", "nth")


def usage_summary(g: CodeGraph) -> DataFrame:
    """Usages of each symbol by kind."""
    return W.by_kind(usages(g), "target_symbol_id", "kind", {k: k for k in ("body", "call", "subclass")})


def import_chain(g: CodeGraph) -> DataFrame:
    """(import_id, symbol_id, hops files): where an import's symbol is defined, if that is not the imported file itself."""
    home = g.symbols.select(F.col("id").alias("target_symbol_id"), F.col("file_id").alias("defined_in"))
    return g.import_resolutions.join(home, "target_symbol_id").select("import_id", F.col("target_symbol_id").alias("symbol_id"), F.col("target_file_id").alias("imported_from"), "defined_in", (F.col("target_file_id") != F.col("defined_in")).alias("is_indirect"))


def api(g: CodeGraph) -> DataFrame:
    """(file_id, name, symbol_id) that other files can import from each file."""
    if g.language == "python":
        from graphloom.plans.resolve import exports_by_file

        return exports_by_file(g.symbols, g.imports, g.import_resolutions, g.all_exports)
    from graphloom.plans.resolve_typescript import exported

    return exported(g.symbols, g.exports, g.import_resolutions)


# classes --------------------------------------------------------------------------------------------------------------


def resolution_order(g: CodeGraph) -> DataFrame:
    """(class_id, node, level, place): each class and its bases, nearest first; on a level in the order of the bases."""
    own = g.symbols.where("kind in ('class', 'interface')").select(F.col("id").alias("class_id"), F.col("id").alias("node"), F.lit(0).alias("level"))
    return g.superclasses().select(F.col("root").alias("class_id"), "node", "level").unionAll(own)


def attributes(g: CodeGraph) -> DataFrame:
    """(class_id, name, annotation, level): own and inherited attributes, the nearest of a name wins."""
    m = g.members.where("kind = 'attribute'").select(F.col("symbol_id").alias("node"), "name", "annotation", "pos")
    j = resolution_order(g).join(m, "node")
    return j.groupBy("class_id", "name").agg(F.min_by(F.struct("annotation", "level"), F.struct("level", "node", "pos")).alias("b")).select("class_id", "name", "b.*")


def resolve_attribute(g: CodeGraph, class_name: str, name: str) -> DataFrame:
    """The member that a name means on a class: its own or that of the nearest base."""
    c = g.symbols.where((F.col("kind") == "class") & (F.col("name") == class_name)).select(F.col("id").alias("class_id"))
    a = attributes(g).select("class_id", "name", "level", F.lit("attribute").alias("kind"))
    m = g.methods().select("class_id", "name", "level", F.lit("method").alias("kind"))
    return a.unionAll(m).join(c, "class_id", "left_semi").where(F.col("name") == name).orderBy("level", "kind").limit(1)


def is_subclass_of(g: CodeGraph, base: str, max_depth: int | None = None) -> DataFrame:
    """(id) of classes below one of a name (its last dotted part), known to the repository or not."""
    last = base.split(".")[-1]
    direct = g.base_names.where(F.element_at(F.split("name", r"\."), -1) == last).select(F.col("symbol_id").alias("node")).distinct()
    e = g.subclass_edges.select(F.col("target_symbol_id").alias("src"), F.col("source_symbol_id").alias("dst"))
    more = T.reach(e, direct, None if max_depth is None else max(0, max_depth - 1))
    return direct.unionAll(more.select("node")).distinct().select(F.col("node").alias("id"))


def callables(g: CodeGraph) -> DataFrame:
    """(id, kind): functions and the methods that classes list, each once; what is both is a method."""
    f = g.symbols.where("kind = 'function'").select("id", F.lit("function").alias("kind"))
    c = g.symbols.where("kind = 'class'").select(F.col("id").alias("parent_symbol_id"))
    m = g.symbols.where("kind = 'function'").join(c, "parent_symbol_id", "left_semi").select("id", F.lit("method").alias("kind"))
    return W.one_of([m, f.join(m, "id", "left_anti")], ["id"])


def widely_used(g: CodeGraph, least: int = 2) -> DataFrame:
    """(target_symbol_id, n): symbols that so many other symbols refer to."""
    return W.distinct_per(g.references.where("source_symbol_id is not null"), "target_symbol_id", "source_symbol_id", "n", least)


def directory_subtotals(g: CodeGraph) -> DataFrame:
    """(directory, language, files, lines) of every directory's own files by language, with subtotals."""
    f = g.files.withColumn("directory", F.regexp_replace("path", r"/?[^/]*$", ""))
    return W.subtotals(f, ["directory", "language"], F.count("*").alias("files"), F.sum("line_count").alias("lines"))


def inheritance_depth(g: CodeGraph) -> DataFrame:
    """(class_id, depth): the number of a class's bases, direct and indirect."""
    n = W.distinct_per(g.superclasses().withColumnRenamed("root", "class_id"), "class_id", "node", "depth")
    c = g.symbols.where("kind = 'class'").select(F.col("id").alias("class_id"))
    return c.join(n, "class_id", "left").select("class_id", F.coalesce("depth", F.lit(0)).alias("depth"))


def method_graph(g: CodeGraph, class_name: str) -> DataFrame:
    """Calls among the methods of a class: (source, target)."""
    c = g.symbols.where((F.col("kind") == "class") & (F.col("name") == class_name)).select("id")
    m = _in(g.symbols, c, "parent_symbol_id").select("id", "name")
    calls = _in(g.calls, m, "source_symbol_id").where(F.coalesce("qualifier", F.lit("")).isin("self", "cls", "this"))
    a, b = m.select(F.col("id").alias("source_symbol_id"), F.col("name").alias("source")), m.select(F.col("name").alias("target"))
    return calls.join(a, "source_symbol_id").join(b, F.col("name") == F.col("target")).select("source", "target").distinct()


def descendants(g: CodeGraph, targets: DataFrame) -> DataFrame:
    """(root, node, level) of symbols inside others."""
    return T.reach(g.symbols.select(F.col("parent_symbol_id").alias("src"), F.col("id").alias("dst")), targets.select(F.col("id").alias("node")))


# calls ----------------------------------------------------------------------------------------------------------------


def call_chains(g: CodeGraph) -> DataFrame:
    """Calls with their predecessor and successor in chains like a().b().c(): those that begin at one byte of a file."""
    c = g.calls.select("id", "source_file_id", "name", F.col("range.start_byte").alias("_a"), F.col("range.end_byte").alias("_b"))
    chain, order = ["source_file_id", "_a"], ["_b", "id"]
    return W.place_within(W.neighbours(c, chain, order, "id"), chain, order).drop("_a", "_b")


def call_sites(g: CodeGraph, target: str) -> DataFrame:
    return _in(g.calls, g.resolve_target(target), "target_symbol_id")


def topological_files(g: CodeGraph) -> DataFrame:
    """(path, level): files that nothing imports first; files of an import cycle share a level."""
    n = g.files.select(F.col("id").alias("node"))
    return T.topological_levels(g.import_edges, n).join(g.files.select(F.col("id").alias("node"), "path"), "node").select("path", "level")


def mixed_import_loops(g: CodeGraph) -> DataFrame:
    """Pairs of files in one import cycle, with their numbers of run-time and plain imports, where there are both."""
    dynamic = F.col("kind").isin("dynamic_import") | F.col("owner").isNotNull()
    r = g.import_resolutions.join(g.imports.select(F.col("id").alias("import_id"), dynamic.alias("dynamic")), "import_id")
    c = T.strongly_connected(g.import_edges)
    r = r.join(c.select(F.col("node").alias("source_file_id"), F.col("component").alias("_a")), "source_file_id").join(c.select(F.col("node").alias("target_file_id"), F.col("component").alias("_b")), "target_file_id").where("_a = _b")
    return W.pair_counts(r, "source_file_id", "target_file_id", F.col("dynamic"), "dynamic_imports", "static_imports")


# reports and sinks ----------------------------------------------------------------------------------------------------


def file_summary(g: CodeGraph) -> DataFrame:
    """Imports, importers, symbols by kind of every file."""
    i = g.imports.groupBy("file_id").agg(F.count("*").alias("imports"))
    by = g.import_resolutions.where("source_file_id <> target_file_id").groupBy(F.col("target_file_id").alias("file_id")).agg(F.countDistinct("source_file_id").alias("importers"))
    k = g.symbols.groupBy("file_id").pivot("kind", ["class", "function", "global_variable", "interface", "type_alias", "enum", "namespace"]).count()
    f = g.files.select(F.col("id").alias("file_id"), "path", "line_count")
    return f.join(i, "file_id", "left").join(by, "file_id", "left").join(k, "file_id", "left").na.fill(0)


def edge_summary(g: CodeGraph) -> DataFrame:
    """Numbers of nodes and edges by type."""
    nodes, edges = g.graph_dump()
    return nodes.groupBy(F.col("node_type").alias("type")).agg(F.count("*").alias("n")).unionAll(edges.groupBy("edge_type").agg(F.count("*")))


def report(g: CodeGraph) -> dict:
    """Totals and means of lines, complexity, volume, inheritance and maintainability of a repository."""
    m = g.metrics().agg(F.count("*").alias("functions"), F.avg("complexity").alias("complexity"), F.avg("volume").alias("volume"), F.avg("maintainability").alias("maintainability")).first().asDict()
    d = inheritance_depth(g).agg(F.count("*").alias("classes"), F.avg("depth").alias("inheritance")).first().asDict()
    f = g.files.agg(F.count("*").alias("files"), F.sum("line_count").alias("lines"), F.count_if(F.col("line_count") > 1000).alias("large_files")).first().asDict()
    return {k: v or 0 for k, v in {**f, **m, **d}.items()}


def line_metrics(sources: DataFrame) -> DataFrame:
    """(path, loc, sloc, comments, lloc) of Python files; logical lines count each part of a line with semicolons."""
    t = sources.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("t"))
    lines = F.transform(F.split("t", "\n", -1), lambda x: F.trim(x))
    code = F.filter(lines, lambda x: (x != "") & ~x.startswith("#"))
    parts = F.aggregate(code, F.lit(0), lambda a, x: a + 1 + F.length(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"(['\"]).*?\1", ""), r"#.*$", ""), r"[^;]|;\s*$", "")))
    return t.select("path", A.line_count(F.col("t")).alias("loc"), F.size(code).alias("sloc"), F.size(F.filter(lines, lambda x: x.rlike("(^|[^'\"])#"))).alias("comments"), parts.alias("lloc"))


def flags(targets: DataFrame, message: str, by: Column, size: int = 10) -> DataFrame:
    """Marked symbols with group and chunk: chunks of `size` in the order of ids within each group."""
    f = targets.select("id", F.lit(message).alias("message"), by.cast("string").alias("group"))
    return A.flag_groups(f, "group", size, ["id"])


def visual(edges: DataFrame, names: DataFrame, root: int | None = None, most: int = 10_000) -> str:
    """JSON of a result's nodes and links, of which more than `most` are an error; names is (id, name)."""
    e = edges.select("src", "dst").distinct()
    rows = e.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} links: show a part of the graph")
    ids = e.select(F.col("src").alias("id")).unionAll(e.select("dst")).distinct()
    nodes = [{"id": r.id, "name": r.name, "root": r.id == root} for r in ids.join(names.select("id", "name"), "id", "left").orderBy("id").collect()]
    links = [{"source": r.src, "target": r.dst} for r in sorted(rows, key=lambda r: (r.src, r.dst))]
    return json.dumps({"type": "graph", "nodes": nodes, "links": links}, sort_keys=True)


def cypher(g: CodeGraph) -> DataFrame:
    """The property graph as statements of a graph database's language, one a row; nodes before relations by `step`."""
    nodes, relations = g.property_graph()
    quote = lambda c: F.concat(F.lit("'"), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))
    n = nodes.select(F.lit(0).alias("step"), F.format_string("MERGE (:%s {id: %d, name: %s})", "label", "id", quote(F.col("full_name"))).alias("statement"))
    r = relations.select(F.lit(1).alias("step"), F.format_string("MATCH (a {id: %d}), (b {id: %d}) MERGE (a)-[:%s]->(b)", "source", "target", "relation").alias("statement"))
    return n.unionAll(r)


def write_json(g: CodeGraph, folder: str) -> None:
    """All tables and the debug graph as JSON lines below a folder."""
    g.write(folder, "json")
    nodes, edges = g.graph_dump()
    nodes.write.mode("overwrite").json(f"{folder.rstrip('/')}/debug_nodes")
    edges.write.mode("overwrite").json(f"{folder.rstrip('/')}/debug_edges")


def validate(g: CodeGraph, before: CodeGraph | None = None) -> dict:
    """Broken invariants of a graph, and against an earlier one the rows that are missing or new; all 0 if it's sound."""
    dangling = lambda d, c, t: d.where(F.col(c).isNotNull()).join(t.select(F.col("id").alias("_t")), F.col(c) == F.col("_t"), "left_anti").count()
    out = {
        "resolutions_without_file": dangling(g.import_resolutions, "target_file_id", g.files), "references_without_target": dangling(g.references, "target_symbol_id", g.symbols),
        "self_references": g.references.where("source_symbol_id = target_symbol_id").count(), "symbols_without_parent": dangling(g.symbols, "parent_symbol_id", g.symbols), "files_with_errors": g.files.where("has_error").count(),
    }
    if before is not None:
        row = lambda x: x.symbols.join(x.files.select(F.col("id").alias("_f"), "path"), F.col("file_id") == F.col("_f")).select("path", "name", "kind")
        n = {r.side: r.n for r in W.differences(row(before), row(g)).collect()}
        out |= {"missing_symbols": n["missing"], "new_symbols": n["added"]}
    return out


# editor questions -----------------------------------------------------------------------------------------------------


def definition_at(g: CodeGraph, path: str, at: int) -> DataFrame:
    """(path, line, name) of what the name at a byte refers to."""
    r = _in(g.references, g.get_file(path), "source_file_id").where((F.col("range.start_byte") <= at) & (F.col("range.end_byte") > at))
    s = g.symbols.join(r.select(F.col("target_symbol_id").alias("_t")).distinct(), F.col("id") == F.col("_t"), "left_semi").join(g.files.select(F.col("id").alias("_f"), "path"), F.col("file_id") == F.col("_f"))
    return s.select("path", (F.col("range.start_row") + 1).alias("line"), "name")


def document_symbols(g: CodeGraph, path: str) -> DataFrame:
    """(name, kind, parent, line) of a file's symbols in their order."""
    s = _in(g.symbols, g.get_file(path), "file_id")
    p = g.symbols.select(F.col("id").alias("_p"), F.col("name").alias("parent"))
    return s.join(p, F.col("parent_symbol_id") == F.col("_p"), "left").select("name", "kind", "parent", (F.col("range.start_row") + 1).alias("line"), "id").orderBy("id").drop("id")
