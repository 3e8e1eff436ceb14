"""The code graph of one repository: a DataFrame per record table, and the questions one asks of them."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom import schema
from graphloom.functions import scalar as S
from graphloom.lineage import cut
from graphloom.operators import aggregates as A
from graphloom.operators import rows as W
from graphloom.operators import traversal as T
from graphloom.plans import resolve
from graphloom.sources import repo

USAGE_TYPES = {"direct": 1, "chained": 2, "indirect": 4, "aliased": 8}
# Names of calls that callgraphs may hide as part of the runtime.
RUNTIME = frozenset((
    "Any", "Array", "Boolean", "Date", "Error", "Map", "Number", "Object", "Promise", "Set", "String", "append", "assign", "cast", "entries", "error", "exit", "filter", "flat", "forEach",
    "fromEntries", "getattr", "has", "hasattr", "isArray", "isinstance", "items", "join", "keys", "log", "map", "parseInt", "push", "repr", "slice", "sort", "split", "startsWith", "str",
    "stringify", "toISOString", "trim", "tuple", "type", "values", "warning",
))


def numbered(parsed: DataFrame) -> DataFrame:
    """Parsed files with a dense file_id in component-wise path order, and each record kind's first id per file.

    Two levels of running sums, within ranges of files and over the ranges, so no task holds all files.
    """
    counts = ["symbols", "imports", "exports", "calls", "candidates", "statements", "jsx_elements", "promise_chains"]
    parsed = cut(parsed)  # parsed once, though the ranges are sampled before rows are dealt out
    sizes = parsed.select("path", F.split("path", "/").alias("_order"), *[F.size(c).alias(f"_n_{c}") for c in counts])
    df = cut(sizes.repartitionByRange("_order").withColumn("_p", F.spark_partition_id()))
    w = Window.partitionBy("_p").orderBy("_order")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    inner = df.select("path", "_p", (F.row_number().over(w) - 1).alias("_i"), *[F.coalesce(F.sum(f"_n_{c}").over(before), F.lit(0)).alias(f"_{c}") for c in counts])
    totals = df.groupBy("_p").agg(F.count("*").alias("_n"), *[F.sum(f"_n_{c}").alias(f"_t_{c}") for c in counts])
    prior = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    sums = totals.select(F.col("_p").alias("_q"), F.coalesce(F.sum("_n").over(prior), F.lit(0)).alias("_bn"), *[F.coalesce(F.sum(f"_t_{c}").over(prior), F.lit(0)).alias(f"_b_{c}") for c in counts])
    ids = inner.join(F.broadcast(sums), F.col("_p") == F.col("_q")).select(
        F.col("path").alias("_path"), (F.col("_i") + F.col("_bn")).cast("long").alias("file_id"), *[(F.col(f"_{c}") + F.col(f"_b_{c}")).cast("long").alias(f"first_{c}") for c in counts]
    )
    return cut(parsed.join(ids, F.col("path") == F.col("_path")).drop("_path"))


class CodeGraph:
    """Tables of a repository, built lazily; each is a plain DataFrame.

    language is python or typescript. Ids are dense: files by path components, records by file and place. roots are
    folders, such as src, that Python modules are named from. resolver takes the imports that no rule resolves and the
    files, and gives rows (import_id, path) for those that it knows, at most one an import.
    extracted is what repo.parse gave for the sources, if that is at hand.
    """

    def __init__(
        self,
        spark: SparkSession,
        sources: DataFrame,
        language: str,
        configs: list[dict] | None = None,
        roots: tuple[str, ...] = (),
        resolver: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
        extracted: DataFrame | None = None,
    ):
        self.spark, self.sources, self.language, self.configs, self.roots = spark, sources, language, configs or [], tuple(roots)
        self.resolver, self.extracted = resolver, extracted

    # construction --------------------------------------------------------------------------------------------------
    @classmethod
    def from_files(cls, spark: SparkSession, files: dict[str, str], language: str | None = None) -> CodeGraph:
        src = repo.from_files(spark, files)
        configs = [c for p, t in sorted(files.items()) if p.split("/")[-1].startswith("tsconfig") and p.endswith(".json") and (c := repo.tsconfig(p, t if isinstance(t, str) else t.decode()))]
        return cls(spark, src, language or repo.detect_language(src), configs)

    @classmethod
    def from_string(cls, spark: SparkSession, code: str, language: str) -> CodeGraph:
        return cls.from_files(spark, {"test.py" if language == repo.PYTHON else "test.ts": code}, language)

    @classmethod
    def from_path(cls, spark: SparkSession, root: str, language: str | None = None, paths: list[str] | None = None, roots: tuple[str, ...] = (), **filters) -> CodeGraph:
        """All files below root, or those of the given paths. Configurations are few and read on the driver."""
        src = repo.scan(spark, root, **filters)
        conf = [(r.path, bytes(r.content).decode("utf-8", "replace")) for r in src.where(F.col("path").rlike(r"(^|/)tsconfig[^/]*\.json$")).toLocalIterator()]
        if paths is not None:
            src = src.join(spark.createDataFrame([(p,) for p in paths], "path string"), "path", "left_semi")
        return cls(spark, src, language or repo.detect_language(src), [c for p, t in sorted(conf) if (c := repo.tsconfig(p, t))], roots)

    # tables --------------------------------------------------------------------------------------------------------
    @cached_property
    def parsed(self) -> DataFrame:
        return numbered(repo.parse(self.sources, self.language, roots=self.roots) if self.extracted is None else self.extracted)

    @cached_property
    def files(self) -> DataFrame:
        return self.parsed.select(F.col("file_id").alias("id"), "path", "module_name", "language", "content_hash", "byte_len", "line_count", "has_error", "root_range")

    def _records(self, kind: str) -> DataFrame:
        keep = ["file_id", "path"] + [c for c in self.parsed.columns if c.startswith("first_")]
        return self.parsed.select(*keep, F.posexplode(kind).alias("pos_in_file", "r"))

    def _symbol(self, column: str) -> Column:
        return F.col("first_symbols") + F.col(column)

    @cached_property
    def symbols(self) -> DataFrame:
        r = self._records("symbols")
        return r.select(
            self._symbol("r.id").alias("id"), "file_id", self._symbol("r.parent").alias("parent_symbol_id"), F.col("r.is_top_level").alias("is_top_level"), F.col("r.name").alias("name"),
            F.col("r.kind").alias("kind"), F.col("r.range").alias("range"), F.col("r.name_start").alias("name_start"), F.col("r.name_end").alias("name_end"), F.col("r.is_async").alias("is_async"),
            F.col("r.decorators").alias("decorators"), F.col("r.docstring").alias("docstring"), F.col("r.returns").alias("returns"),
            "r.returns_start", "r.returns_end", "r.body_start", "r.doc_start", "r.doc_end",
            S.is_private(F.col("r.name")).alias("is_private"), S.is_magic(F.col("r.name")).alias("is_magic"),
        )

    @cached_property
    def imports(self) -> DataFrame:
        r = self._records("imports").select((F.col("first_imports") + F.col("r.id")).alias("id"), "file_id", F.col("r.kind").alias("kind"), F.col("r.module").alias("module"), F.col("r.name").alias("name"), F.col("r.alias").alias("alias"), F.col("r.range").alias("range"), F.col("r.name_start").alias("name_start"), F.col("r.name_end").alias("name_end"))
        s = self.symbols.select(F.col("file_id").alias("_f"), F.col("id").alias("_s"), F.col("range.start_byte").alias("_a"), F.col("range.end_byte").alias("_b"))
        inside = r.join(s, (F.col("file_id") == F.col("_f")) & (F.col("_a") <= F.col("range.start_byte")) & (F.col("range.end_byte") <= F.col("_b")))
        owner = inside.groupBy("id").agg(F.min_by("_s", F.struct(F.col("_b") - F.col("_a"), F.col("_s"))).alias("owner"))
        return cut(r.join(owner, "id", "left"))

    @cached_property
    def exports(self) -> DataFrame:
        return self._records("exports").select(
            (F.col("first_exports") + F.col("r.id")).alias("id"), "file_id", F.col("r.kind").alias("kind"), F.col("r.name").alias("name"), F.col("r.local_name").alias("local_name"), F.col("r.source_module").alias("source_module"),
            self._symbol("r.symbol_id").alias("symbol_id"), (F.col("first_imports") + F.col("r.import_id")).alias("import_id"), F.col("r.range").alias("range"),
        )

    @cached_property
    def candidates(self) -> DataFrame:
        return self._records("candidates").select(
            (F.col("first_candidates") + F.col("pos_in_file")).alias("row"), F.col("file_id").alias("source_file_id"), self._symbol("r.source").alias("source_symbol_id"), F.col("r.name").alias("name"), F.col("r.qualifier").alias("qualifier"), F.col("r.range").alias("range"), F.col("r.is_subclass").alias("is_subclass"), self._symbol("r.local").alias("local_symbol_id"),
        )

    @cached_property
    def all_exports(self) -> DataFrame:
        limited = self.parsed.where("all_names is not null")
        return limited.select("file_id", F.explode_outer("all_names").alias("name"))

    @cached_property
    def import_resolutions(self) -> DataFrame:
        if self.language == repo.PYTHON:
            found = resolve.resolve_imports(self.files, self.symbols, self.imports, self.all_exports)
        else:
            from graphloom.plans import resolve_typescript

            found = resolve_typescript.resolve_imports(self.files, self.symbols, self.imports, self.exports, self.configs)
        if self.resolver is not None:
            open_ = self.imports.join(found.select(F.col("import_id").alias("id")), "id", "left_anti")
            own = self.resolver(open_, self.files).select("import_id", F.col("path").alias("_p"))
            files = self.files.select(F.col("path").alias("_p"), F.col("id").alias("target_file_id"))
            top = self.symbols.where("is_top_level").groupBy(F.col("file_id").alias("target_file_id"), "name").agg(F.max("id").alias("target_symbol_id"))
            own = own.join(files, "_p").join(open_.select(F.col("id").alias("import_id"), F.col("file_id").alias("source_file_id"), "name"), "import_id").join(top, ["target_file_id", "name"], "left")
            found = found.unionByName(own.select(*found.columns))
        return cut(A.dense_ids(found, ["import_id"]))

    @cached_property
    def external_modules(self) -> DataFrame:
        return cut(A.dense_ids(resolve.external_modules(self.imports, self.import_resolutions), ["import_id"]))

    @cached_property
    def _references(self) -> tuple[DataFrame, DataFrame]:
        if self.language == repo.PYTHON:
            refs, ext = resolve.resolve_references(self.files, self.symbols, self.imports, self.import_resolutions, self.external_modules, self.all_exports, self.candidates)
        else:
            from graphloom.plans import resolve_typescript

            refs, ext = resolve_typescript.resolve_references(self.files, self.symbols, self.imports, self.exports, self.import_resolutions, self.external_modules, self.candidates)
        return cut(A.dense_ids(refs, ["row"])), cut(A.dense_ids(ext, ["row"]))

    @cached_property
    def references(self) -> DataFrame:
        return self._references[0].drop("row")

    @cached_property
    def external_references(self) -> DataFrame:
        return self._references[1].drop("row")

    @cached_property
    def dependencies(self) -> DataFrame:
        d = A.dependencies(self.references)
        of = self.symbols.select(F.col("id").alias("_i"), "file_id")
        d = d.join(of.select(F.col("_i").alias("source_symbol_id"), F.col("file_id").alias("source_file_id")), "source_symbol_id").join(of.select(F.col("_i").alias("target_symbol_id"), F.col("file_id").alias("target_file_id")), "target_symbol_id")
        return cut(A.dense_ids(d, ["source_symbol_id", "target_symbol_id"]))

    @cached_property
    def subclass_edges(self) -> DataFrame:
        """(source_symbol_id, target_symbol_id, reference_id): base class references, one row a pair, the first reference."""
        marked = self._references[0].join(self.candidates.where("is_subclass").select("row"), "row", "left_semi").where("source_symbol_id is not null")
        return marked.groupBy("source_symbol_id", "target_symbol_id").agg(F.min("id").alias("reference_id"))

    @cached_property
    def calls(self) -> DataFrame:
        """Calls with their definition: the reference at the callee's name; null target where it is not resolved."""
        c = self._records("calls").select(
            (F.col("first_calls") + F.col("r.id")).alias("id"), F.col("file_id").alias("source_file_id"), self._symbol("r.source").alias("source_symbol_id"), F.col("r.name").alias("name"), F.col("r.qualifier").alias("qualifier"), F.col("r.range").alias("range"), F.col("r.name_start").alias("name_start"), F.col("r.name_end").alias("name_end"), F.col("r.arguments").alias("arguments")
        )
        at = self.references.select(F.col("source_file_id").alias("_f"), F.col("range.start_byte").alias("_a"), F.col("range.end_byte").alias("_b"), "target_symbol_id", "import_id")
        return c.join(at, (F.col("source_file_id") == F.col("_f")) & (F.col("name_start") == F.col("_a")) & (F.col("name_end") == F.col("_b")), "left").drop("_f", "_a", "_b")

    @cached_property
    def parameters(self) -> DataFrame:
        return self._records("parameters").select("file_id", self._symbol("r.symbol_id").alias("symbol_id"), "r.pos", "r.name", "r.kind", "r.annotation", "r.has_default", "r.start_byte", "r.end_byte")

    @cached_property
    def statements(self) -> DataFrame:
        first = F.col("first_statements")
        return self._records("statements").select((first + F.col("r.id")).alias("id"), (first + F.col("r.parent")).alias("parent_id"), "file_id", "r.pos", "r.level", "r.kind", self._symbol("r.symbol_id").alias("symbol_id"), F.col("r.range").alias("range"))

    @cached_property
    def members(self) -> DataFrame:
        """Attributes and methods that classes, interfaces, enums and object types list in their bodies."""
        r = self._records("members")
        return r.select("file_id", self._symbol("r.symbol_id").alias("symbol_id"), "r.pos", "r.name", "r.kind", "r.annotation", "r.value", "r.is_optional", "r.is_static", F.col("r.range").alias("range"), S.is_private(F.col("r.name")).alias("is_private"))

    @cached_property
    def identifiers(self) -> DataFrame:
        """Every name in an expression, parameter list or binding, shadowed or not, with its role."""
        return self._records("identifiers").select("file_id", self._symbol("r.symbol_id").alias("symbol_id"), "r.name", "r.role", "r.start_byte", "r.end_byte")

    @cached_property
    def string_literals(self) -> DataFrame:
        return self._records("strings").select("file_id", self._symbol("r.symbol_id").alias("symbol_id"), "r.value", "r.start_byte", "r.end_byte")

    @cached_property
    def tokens(self) -> DataFrame:
        return self._records("tokens").select("file_id", self._symbol("r.symbol_id").alias("symbol_id"), "r.group", "r.token")

    @cached_property
    def base_names(self) -> DataFrame:
        return self._records("bases").select("file_id", self._symbol("r.symbol_id").alias("symbol_id"), "r.pos", "r.name")

    @cached_property
    def jsx_elements(self) -> DataFrame:
        first = F.col("first_jsx_elements")
        return self._records("jsx_elements").select((first + F.col("r.id")).alias("id"), F.col("file_id").alias("source_file_id"), self._symbol("r.source").alias("source_symbol_id"), (first + F.col("r.parent")).alias("parent_jsx_element_id"), F.col("r.name").alias("name"), F.col("r.range").alias("range"), F.col("r.name_start").alias("name_start"), F.col("r.name_end").alias("name_end"), F.col("r.close_start").alias("close_start"), F.col("r.close_end").alias("close_end"))

    @cached_property
    def jsx_props(self) -> DataFrame:
        return self._records("jsx_props").select("file_id", (F.col("first_jsx_elements") + F.col("r.element")).alias("parent_jsx_element_id"), "r.pos", "r.name", "r.value", "r.value_is_expression", "r.expression", F.col("r.range").alias("range"))

    @cached_property
    def promise_chains(self) -> DataFrame:
        return self._records("promise_chains").select((F.col("first_promise_chains") + F.col("r.id")).alias("id"), F.col("file_id").alias("source_file_id"), self._symbol("r.source").alias("source_symbol_id"), F.col("r.stage_names").alias("stage_names"), F.col("r.range").alias("range"), F.col("r.base_start").alias("base_start"), F.col("r.base_end").alias("base_end"))

    # lookups -------------------------------------------------------------------------------------------------------
    def symbols_of(self, kind: str | None = None, top_level: bool = True) -> DataFrame:
        s = self.symbols.where("is_top_level") if top_level else self.symbols
        return s if kind is None else s.where(F.col("kind") == kind)

    @property
    def functions(self) -> DataFrame:
        return self.symbols_of("function")

    @property
    def classes(self) -> DataFrame:
        return self.symbols_of("class")

    @property
    def global_vars(self) -> DataFrame:
        return self.symbols_of("global_variable")

    @property
    def directories(self) -> DataFrame:
        return self.files.select(F.explode(S.directory_prefixes(F.col("path"))).alias("path")).distinct()

    def get_file(self, path: str, ignore_case: bool = False) -> DataFrame:
        return self.files.where(F.lower("path") == path.lower() if ignore_case else F.col("path") == path)

    def find_file(self, ref: str) -> str:
        """The path that a reference names: exactly, or as the only path that ends in it."""
        if self.get_file(ref).limit(1).count():
            return ref
        rows = self.files.where(F.col("path").endswith("/" + ref)).select("path").limit(2).collect()
        if len(rows) != 1:
            raise KeyError(f"{'no' if not rows else 'more than one'} file matches {ref!r}")
        return rows[0].path

    def get_symbol(self, name: str, kind: str | None = None, optional: bool = False) -> dict | None:
        """The only top-level symbol of a name; an error if there are several, or none unless optional."""
        rows = self.symbols_of(kind).where(F.col("name") == name).limit(2).collect()
        if len(rows) > 1:
            raise ValueError(f"more than one symbol is named {name!r}")
        if not rows and not optional:
            raise KeyError(name)
        return rows[0].asDict(recursive=True) if rows else None

    def resolve_target(self, target: str) -> DataFrame:
        """Symbols of `file::name`, `file:name`, dotted `path.name` (the longest file wins), `Class.method` or a name."""
        s = self.symbols.join(self.files.select(F.col("id").alias("_f"), "path", "module_name"), F.col("file_id") == F.col("_f")).drop("_f")
        for mark in ("::", ":"):
            if mark in target:
                ref, name = target.split(mark, 1)
                return s.where((F.col("path") == self.find_file(ref)) & (F.col("name") == name.split(".")[-1]))
        if "." in target:
            dotted = s.where(F.lit(target) == F.concat_ws(".", "module_name", "name"))
            if dotted.limit(1).count():
                best = dotted.agg(F.max(F.length("module_name")).alias("n")).first().n
                return dotted.where(F.length("module_name") == best)
            parent, name = target.rsplit(".", 1)
            p = self.symbols.where(F.col("name") == parent.split(".")[-1]).select(F.col("id").alias("_p"))
            return s.join(p, F.col("parent_symbol_id") == F.col("_p"), "left_semi").where(F.col("name") == name)
        return s.where(F.col("name") == target)

    def search_symbols(self, query: str | None = None, kind: str = "all", max_results: int = 200) -> DataFrame:
        """Symbols whose name, kind or path holds the query, whatever its case."""
        s = self.symbols.join(self.files.select(F.col("id").alias("_f"), "path"), F.col("file_id") == F.col("_f")).drop("_f")
        parent = self.symbols.select(F.col("id").alias("_p"), F.col("name").alias("_pn"))
        s = s.join(parent, F.col("parent_symbol_id") == F.col("_p"), "left").withColumn("qualified_name", F.concat_ws(".", "_pn", "name"))
        if kind != "all":
            s = s.where(F.col("kind") == kind)
        out = s.select("id", "name", "qualified_name", "kind", "path", S.location(F.col("path"), F.col("range.start_row")).alias("location"))
        return W.holding(out, query or "", ["name", "qualified_name", "kind", "path"], ["path", "id"], max_results)

    # graph questions -----------------------------------------------------------------------------------------------
    @property
    def edges(self) -> DataFrame:
        return self.dependencies.select(F.col("source_symbol_id").alias("src"), F.col("target_symbol_id").alias("dst"))

    @property
    def call_edges(self) -> DataFrame:
        c = self.calls.where("source_symbol_id is not null and target_symbol_id is not null")
        return c.select(F.col("source_symbol_id").alias("src"), F.col("target_symbol_id").alias("dst")).distinct()

    @property
    def import_edges(self) -> DataFrame:
        """(src, dst) files, without imports of a file by itself."""
        r = self.import_resolutions.where("source_file_id <> target_file_id")
        return r.select(F.col("source_file_id").alias("src"), F.col("target_file_id").alias("dst")).distinct()

    def _nodes(self, ids: DataFrame) -> DataFrame:
        return ids.select(F.col("id").alias("node"))

    def callgraph(self, target: str, depth: int = 2, max_results: int = 200) -> DataFrame:
        return self._named(T.trace(self.call_edges, self._nodes(self.resolve_target(target)), depth, max_results=max_results))

    def usages(self, target: str, depth: int = 1, max_results: int = 200) -> DataFrame:
        """Who uses the target: call sites, or other references where there are none."""
        start = self._nodes(self.resolve_target(target))
        found = T.trace(self.call_edges, start, depth, inbound=True, max_results=max_results)
        if not found.limit(1).count():
            found = T.trace(self.edges, start, depth, inbound=True, max_results=max_results)
        return self._named(found)

    def using(self, target: str, depth: int = 1, max_results: int = 200) -> DataFrame:
        return self._named(T.trace(self.edges, self._nodes(self.resolve_target(target)), depth, max_results=max_results))

    def _named(self, e: DataFrame) -> DataFrame:
        n = self.symbols.select(F.col("id").alias("_i"), "name")
        a, b = n.select(F.col("_i").alias("src"), F.col("name").alias("source")), n.select(F.col("_i").alias("dst"), F.col("name").alias("target"))
        return e.join(a, "src").join(b, "dst").select("src", "dst", "source", "target", "depth")

    def dependency_closure(self, target: str, max_depth: int | None = None) -> DataFrame:
        """(node, level) of all that the target needs, without what it contains itself."""
        start = self.resolve_target(target)
        own = T.reach(self.symbols.select(F.col("parent_symbol_id").alias("src"), F.col("id").alias("dst")), self._nodes(start)).select("node")
        return T.reach(self.edges, self._nodes(start), max_depth).groupBy("node").agg(F.min("level").alias("level")).join(own, "node", "left_anti")

    def superclasses(self, max_depth: int | None = None) -> DataFrame:
        e = self.subclass_edges.select(F.col("source_symbol_id").alias("src"), F.col("target_symbol_id").alias("dst"))
        return T.reach(e, self._nodes(self.symbols.where("kind = 'class'")), max_depth)

    def subclasses(self, max_depth: int | None = None) -> DataFrame:
        e = self.subclass_edges.select(F.col("target_symbol_id").alias("src"), F.col("source_symbol_id").alias("dst"))
        return T.reach(e, self._nodes(self.symbols.where("kind = 'class'")), max_depth)

    def methods(self) -> DataFrame:
        """(class_id, name, method_id, level): own and inherited methods, the nearest definition of a name wins."""
        mro = self.superclasses().select(F.col("root").alias("class_id"), "node", "level").unionAll(self.symbols.where("kind = 'class'").select(F.col("id").alias("class_id"), F.col("id").alias("node"), F.lit(0).alias("level")))
        m = self.symbols.where("kind = 'function' and parent_symbol_id is not null").select(F.col("parent_symbol_id").alias("node"), "name", F.col("id").alias("method_id"))
        return mro.join(m, "node").groupBy("class_id", "name").agg(F.min_by(F.struct("method_id", "level"), F.struct("level", "node", -F.col("method_id"))).alias("b")).select("class_id", "name", "b.*")

    def import_cycles(self) -> DataFrame:
        return T.strongly_connected(self.import_edges)

    def dead_code(self, rounds: int = 1) -> DataFrame:
        """Functions nothing refers to, not decorated, outside test files; in later rounds those only dead ones use."""
        f = self.symbols.where("kind = 'function' and is_top_level and size(decorators) = 0").join(self.files.select(F.col("id").alias("_f"), "path"), F.col("file_id") == F.col("_f")).where(~F.lower("path").contains("test"))
        outer = self.references.select(F.coalesce("source_symbol_id", -1 - F.col("source_file_id")).alias("src"), F.col("target_symbol_id").alias("dst"))
        gone = T.dead(self._nodes(f), outer, rounds)
        return gone.join(f.select(F.col("id").alias("node"), "name", "path"), "node")

    def importers(self, path: str) -> DataFrame:
        f = self.get_file(path).select(F.col("id").alias("target_file_id"))
        return self.import_resolutions.join(f, "target_file_id", "left_semi").select(F.col("source_file_id").alias("id")).distinct().join(self.files, "id")

    # summaries -----------------------------------------------------------------------------------------------------
    def summary(self) -> dict:
        """Counts of all tables, bytes, lines and files with errors."""
        f = (self.files, [F.count("*").alias("files"), F.sum("byte_len").alias("bytes"), F.sum("line_count").alias("lines"), F.count_if("has_error").alias("files_with_errors")])
        tables = ("symbols", "imports", "exports", "import_resolutions", "external_modules", "references", "external_references", "dependencies", "subclass_edges", "calls", "jsx_elements", "jsx_props", "promise_chains")
        row = W.one_row(f, *[(getattr(self, t), [F.count("*").alias(t)]) for t in tables]).first()
        return {k: v or 0 for k, v in row.asDict().items()}

    def metrics(self) -> DataFrame:
        """Complexity with rank, Halstead volume, lines and maintainability of each function."""
        fns = self.symbols.where("kind = 'function'").select("id", "name", (F.col("range.end_row") - F.col("range.start_row") + 1).alias("loc"))
        cc = A.cyclomatic(self.tokens.where(F.col("group") == "branch").withColumnRenamed("token", "kind"))
        hv = A.halstead(self.tokens.where(F.col("group") != "branch"), "symbol_id", "token")
        m = fns.join(cc.withColumnRenamed("symbol_id", "id"), "id", "left").join(hv.withColumnRenamed("symbol_id", "id"), "id", "left")
        m = m.select("id", "name", "loc", F.coalesce("complexity", F.lit(1)).alias("complexity"), F.coalesce("volume", F.lit(0.0)).alias("volume"))
        return m.withColumn("rank", A.cc_rank(F.col("complexity"))).withColumn("maintainability", A.maintainability(F.col("volume"), F.col("complexity"), F.col("loc")))

    def untyped(self) -> dict:
        p = self.parameters.where("name not in ('self', 'cls')").agg(F.count_if(F.col("annotation").isNull()).alias("parameters")).first()
        r = self.symbols.where("kind = 'function'").agg(F.count_if(F.col("returns").isNull()).alias("returns")).first()
        return {"parameters": p.parameters, "returns": r.returns}

    def arguments(self) -> DataFrame:
        """Arguments of resolved calls with the parameter each is passed to, by name or by place."""
        a = self.calls.where("target_symbol_id is not null").select(F.col("id").alias("call_id"), "source_file_id", "target_symbol_id", F.explode("arguments").alias("a")).select("call_id", "source_file_id", "target_symbol_id", "a.*")
        method = self.symbols.where("parent_symbol_id is not null").join(self.symbols.where("kind = 'class'").select(F.col("id").alias("_c")), F.col("parent_symbol_id") == F.col("_c"), "left_semi").select(F.col("id").alias("_m"))
        p = self.parameters.join(method, F.col("symbol_id") == F.col("_m"), "left").withColumn("place", F.col("pos") - F.when(F.col("_m").isNotNull(), 1).otherwise(0))
        p = p.select(F.col("symbol_id").alias("_s"), F.col("name").alias("parameter"), "place", F.col("pos").alias("parameter_pos"))
        by = F.when(a["name"].isNotNull(), a["name"] == F.col("parameter")).otherwise(a["pos"] == F.col("place"))
        return a.join(p, (F.col("target_symbol_id") == F.col("_s")) & by, "left").drop("_s", "place")

    def graph_dump(self) -> tuple[DataFrame, DataFrame]:
        """Nodes and edges of all tables."""
        n = lambda d, t, name: d.select(F.lit(t).alias("node_type"), F.col("id").alias("record_id"), name.alias("name"))
        nodes = n(self.files, "FILE", F.col("path")).unionByName(n(self.symbols, "SYMBOL", F.col("name"))).unionByName(n(self.imports, "IMPORT", F.col("name"))).unionByName(n(self.external_modules, "EXTERNAL", F.col("name")))
        e = lambda d, t, a, b: d.select(F.lit(t).alias("edge_type"), F.col(a).alias("source"), F.col(b).alias("target")).where("target is not null")
        edges = e(self.import_resolutions, "IMPORT_SYMBOL_RESOLUTION", "import_id", "target_symbol_id").unionByName(e(self.dependencies, "SYMBOL_USAGE", "source_symbol_id", "target_symbol_id")).unionByName(e(self.subclass_edges, "SUBCLASS", "source_symbol_id", "target_symbol_id"))
        return nodes, edges

    def property_graph(self) -> tuple[DataFrame, DataFrame]:
        """Class, Method and Func nodes with DEFINES, CALLS and INHERITS_FROM relations; calls of itself are left out."""
        parent = self.symbols.select(F.col("id").alias("_p"), F.col("kind").alias("_pk"), F.col("name").alias("_pn"))
        s = self.symbols.where("kind in ('class', 'function')").join(parent, F.col("parent_symbol_id") == F.col("_p"), "left")
        label = F.when(F.col("kind") == "class", "Class").when(F.col("_pk") == "class", "Method").otherwise("Func")
        nodes = s.select("id", label.alias("label"), "name", F.concat_ws(".", "_pn", "name").alias("full_name"))
        rel = lambda d, t, a, b: d.select(F.lit(t).alias("relation"), F.col(a).alias("source"), F.col(b).alias("target"))
        relations = rel(s.where("_pk = 'class'"), "DEFINES", "parent_symbol_id", "id").unionAll(rel(self.call_edges.where("src <> dst"), "CALLS", "src", "dst")).unionAll(rel(self.subclass_edges, "INHERITS_FROM", "source_symbol_id", "target_symbol_id"))
        return nodes, relations

    def write(self, folder: str, fmt: str = "parquet") -> None:
        """All tables below a folder, one directory each."""
        for name in ("files", "symbols", "imports", "exports", "import_resolutions", "external_modules", "references", "external_references", "dependencies", "subclass_edges", "calls", "parameters", "statements"):
            getattr(self, name).write.mode("overwrite").format(fmt).save(f"{folder.rstrip('/')}/{name}")


__all__ = ["CodeGraph", "RUNTIME", "USAGE_TYPES", "numbered", "schema"]
