"""Name resolution of Python code as joins: imports, re-exports, references, dependencies.

Inputs are the tables of graphloom.plans.codegraph. Every build side is made unique by (key, last id wins) before it is
joined, so a ladder never repeats a row. Fixed-point loops cut their lineage each round and go on until nothing
changes; one that comes back to an earlier state raises.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import scalar as S
from graphloom.lineage import cut, digest, is_empty
from graphloom.operators.joins import last_wins


def _modules(files: DataFrame) -> DataFrame:
    return files.where("module_name is not null").groupBy(F.col("module_name").alias("m")).agg(F.max("id").alias("mf"))


def _top(symbols: DataFrame) -> DataFrame:
    return symbols.where("is_top_level").groupBy(F.col("file_id").alias("tf"), F.col("name").alias("tn")).agg(F.max("id").alias("ts"))


def resolve_imports(files: DataFrame, symbols: DataFrame, imports: DataFrame, all_exports: DataFrame) -> DataFrame:
    """(import_id, source_file_id, target_file_id, target_symbol_id) of imports within the repository."""
    modules, top = _modules(files), _top(symbols)
    pkg = files.select(F.col("id").alias("fid"), S.package_of(F.col("path"), F.col("module_name")).alias("package"))
    i = imports.join(pkg, F.col("file_id") == F.col("fid")).drop("fid")
    plain = i.where("kind = 'import'").join(modules, F.col("name") == F.col("m")).select(
        F.col("id").alias("import_id"), F.col("file_id").alias("source_file_id"), F.col("mf").alias("target_file_id"), F.lit(None).cast("long").alias("target_symbol_id")
    )
    f = i.where("kind = 'from_import'").withColumn("base", S.absolute_module(F.col("module"), F.col("package")))
    f = f.withColumn("sub", F.when(F.col("name") != "*", S.join_module(F.col("base"), F.col("name"))))
    f = f.join(modules.select(F.col("m").alias("m1"), F.col("mf").alias("f1")), F.col("base") == F.col("m1"), "left")
    f = f.join(top, (F.col("f1") == F.col("tf")) & (F.col("name") == F.col("tn")), "left")
    f = f.join(modules.select(F.col("m").alias("m2"), F.col("mf").alias("f2")), F.col("sub") == F.col("m2"), "left")
    own = F.col("ts").isNotNull() | ((F.col("name") == "*") & F.col("f1").isNotNull())
    target = F.when(own, F.col("f1")).otherwise(F.coalesce("f2", "f1"))
    found = f.select(F.col("id").alias("import_id"), F.col("file_id").alias("source_file_id"), target.alias("target_file_id"), F.when(own, F.col("ts")).alias("target_symbol_id")).where("target_file_id is not null")
    res = cut(plain.unionAll(found))
    kept = imports.select(F.col("id").alias("iid"), "kind", "name", "alias", "module")
    while True:  # names that another file only re-exports; each round but the last resolves an import
        exported = exports_by_file(symbols, imports, res, all_exports).select(F.col("file_id").alias("ef"), F.col("name").alias("en"), F.col("symbol_id").alias("es"))
        j = res.join(kept, F.col("import_id") == F.col("iid")).drop("iid")
        open_ = (F.col("kind") == "from_import") & F.col("target_symbol_id").isNull() & (F.col("name") != "*")
        j = j.join(exported, open_ & (F.col("target_file_id") == F.col("ef")) & (F.col("name") == F.col("en")), "left")
        nxt = cut(j.select("import_id", "source_file_id", "target_file_id", F.coalesce("target_symbol_id", "es").alias("target_symbol_id"), F.col("es").isNotNull().alias("moved")))
        res = nxt.drop("moved")
        if is_empty(nxt.where("moved")):
            break
    return res


def exports_by_file(symbols: DataFrame, imports: DataFrame, resolutions: DataFrame, all_exports: DataFrame) -> DataFrame:
    """(file_id, name, symbol_id): a file's own symbols, over which its import bindings win in the order of their ids.

    all_exports: (file_id, name) of files with a static __all__, and a row with null name for an empty one. Wildcards
    pull the target's names of the round before, until nothing changes.
    """
    own = _top(symbols).select(F.col("tf").alias("file_id"), F.col("tn").alias("name"), F.col("ts").alias("symbol_id"), F.lit(-1).cast("long").alias("rank"))
    i = imports.join(resolutions.select(F.col("import_id").alias("id"), "target_file_id", "target_symbol_id"), "id").where("kind <> 'future_import'")
    binding = S.import_binding(F.col("kind"), F.col("module"), F.col("name"), F.col("alias"))
    named = i.where("name <> '*' and target_symbol_id is not null").select("file_id", binding.alias("name"), F.col("target_symbol_id").alias("symbol_id"), F.col("id").alias("rank")).where("name is not null")
    stars = i.where("name = '*'").select("file_id", "target_file_id", F.col("id").alias("rank"))
    fixed = own.unionAll(named)
    exports = cut(last_wins(fixed, ["file_id", "name"], ["rank"]).select("file_id", "name", "symbol_id"))
    stars = cut(stars)
    if is_empty(stars):
        return exports
    fixed, state = cut(fixed), digest(exports)
    limited = all_exports.select(F.col("file_id").alias("lf")).distinct()
    seen = {state}
    while True:
        visible = exports.join(limited, F.col("file_id") == F.col("lf"), "left_anti").unionAll(exports.join(all_exports, ["file_id", "name"], "left_semi"))
        pulled = stars.join(visible.select(F.col("file_id").alias("vf"), "name", "symbol_id"), F.col("target_file_id") == F.col("vf")).select("file_id", "name", "symbol_id", "rank")
        exports = cut(last_wins(fixed.unionAll(pulled), ["file_id", "name"], ["rank"]).select("file_id", "name", "symbol_id"))
        before, state = state, digest(exports)
        if state == before:
            break
        if state in seen:
            raise RuntimeError("wildcard exports did not settle")
        seen.add(state)
    return exports


def external_modules(imports: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Imports that nothing in the repository answers: neither relative nor from the future."""
    rest = imports.join(resolutions.select(F.col("import_id").alias("id")), "id", "left_anti")
    rest = rest.where((F.col("kind") != "future_import") & ~F.coalesce(F.col("module"), F.lit("")).startswith("."))
    return rest.select(F.col("id").alias("import_id"), "file_id", "module", F.coalesce("name", "module").alias("name"), "alias", "range")


def resolve_references(files: DataFrame, symbols: DataFrame, imports: DataFrame, resolutions: DataFrame, externals: DataFrame, all_exports: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """References and external references of unshadowed candidates.

    candidates: (row, source_file_id, source_symbol_id, name, qualifier, range), row their order in the whole
    repository. imports has owner, the innermost symbol that holds the statement, or null.
    """
    modules, top = _modules(files), _top(symbols)
    binding = S.import_binding(F.col("kind"), F.col("module"), F.col("name"), F.col("alias"))
    i = cut(imports.join(resolutions.select(F.col("import_id").alias("id"), "target_file_id", "target_symbol_id"), "id", "left").withColumn("binding", binding))
    # bindings of symbols, in a symbol and in a file; wildcards bind in the file
    exports = exports_by_file(symbols, imports, resolutions, all_exports)
    limited = all_exports.select(F.col("file_id").alias("lf")).distinct()
    visible = exports.join(limited, F.col("file_id") == F.col("lf"), "left_anti").unionAll(exports.join(all_exports, ["file_id", "name"], "left_semi"))
    stars = i.where("name = '*' and kind = 'from_import' and target_file_id is not null").select("id", F.col("file_id").alias("sf"), F.col("target_file_id").alias("tf"))
    pulled = stars.join(visible, F.col("tf") == F.col("file_id")).select(F.col("sf").alias("bf"), F.col("name").alias("bn"), F.col("symbol_id").alias("bs"), F.col("id").alias("bi"))
    bound = i.where("name <> '*' and target_symbol_id is not null and binding is not null")
    in_file = bound.where("owner is null").select(F.col("file_id").alias("bf"), F.col("binding").alias("bn"), F.col("target_symbol_id").alias("bs"), F.col("id").alias("bi")).unionAll(pulled)
    in_file = last_wins(in_file, ["bf", "bn"], ["bi"]).select("bf", "bn", "bs", "bi")
    local = bound.where("owner is not null").select(F.col("owner").alias("lo"), F.col("binding").alias("ln"), F.col("target_symbol_id").alias("ls"), F.col("id").alias("li"))
    local = local.groupBy("lo", "ln").agg(F.max_by("ls", "li").alias("ls"), F.max("li").alias("li"))
    ext = i.join(externals.select(F.col("import_id").alias("id")), "id", "left_semi").where("binding is not null")
    ext_local = ext.where("owner is not null").groupBy(F.col("owner").alias("xo"), F.col("binding").alias("xn")).agg(F.max("id").alias("xi"))
    ext_file = ext.where("owner is null").groupBy(F.col("file_id").alias("yf"), F.col("binding").alias("yn")).agg(F.max("id").alias("yi"))

    c = candidates.where("qualifier is null")
    c = c.join(ext_local, (F.col("source_symbol_id") == F.col("xo")) & (F.col("name") == F.col("xn")), "left")
    c = c.join(local, (F.col("source_symbol_id") == F.col("lo")) & (F.col("name") == F.col("ln")), "left")
    c = c.join(in_file, (F.col("source_file_id") == F.col("bf")) & (F.col("name") == F.col("bn")), "left")
    c = c.join(top, (F.col("source_file_id") == F.col("tf")) & (F.col("name") == F.col("tn")), "left")
    c = c.join(ext_file, (F.col("source_file_id") == F.col("yf")) & (F.col("name") == F.col("yn")), "left")
    target = F.when(F.col("xi").isNull(), F.coalesce("ls", "bs", "ts"))
    via = F.when(F.col("xi").isNull(), F.when(F.col("ls").isNotNull(), F.col("li")).when(F.col("bs").isNotNull(), F.col("bi")))
    keep = ["row", "source_file_id", "source_symbol_id", "name", "range"]
    c = cut(c.select(*keep, target.alias("target_symbol_id"), via.alias("import_id"), F.coalesce("xi", "yi").alias("external_id")))
    external = c.where("target_symbol_id is null and external_id is not null").select(*keep, F.col("external_id").alias("import_id"))

    # modules by the name that qualifies: exact, then the module prefix that a binding stands for
    q_name = F.when(F.col("kind") == "import", F.array_distinct(F.array_compact(F.array("alias", "name")))).otherwise(F.array(F.coalesce("alias", "name")))
    quals = i.where("target_file_id is not null and target_symbol_id is null and name <> '*'").select("file_id", F.explode(q_name).alias("q"), "target_file_id", "id")
    quals = quals.groupBy(F.col("file_id").alias("qf"), F.col("q").alias("qq")).agg(F.max_by("target_file_id", "id").alias("qt"), F.max("id").alias("qi"))
    prefixes = files.where("module_name is not null").select(F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("module_name", r"\."))), lambda k: F.array_join(F.slice(F.split("module_name", r"\."), F.lit(1), k), "."))).alias("prefix")).distinct()
    pkg = files.select(F.col("id").alias("fid"), S.package_of(F.col("path"), F.col("module_name")).alias("package"))
    p = i.join(pkg, F.col("file_id") == F.col("fid")).where("name <> '*' and kind <> 'future_import'")
    plain = F.col("kind") == "import"
    stands_for = F.when(plain & F.col("alias").isNotNull(), F.col("name")).when(plain, S.qualifier_root(F.col("name"))).otherwise(S.join_module(S.absolute_module(F.col("module"), F.col("package")), F.col("name")))
    named = F.coalesce("alias", F.when(plain, S.qualifier_root(F.col("name"))).otherwise(F.col("name")))
    p = p.select("file_id", named.alias("b"), stands_for.alias("prefix"), "id").join(prefixes, "prefix", "left_semi")
    p = p.groupBy(F.col("file_id").alias("pf"), F.col("b").alias("pb")).agg(F.max_by("prefix", "id").alias("pp"), F.max("id").alias("pi"))
    d = candidates.where("qualifier is not null")
    d = d.withColumn("root", S.qualifier_root(F.col("qualifier"))).withColumn("rest", F.when(F.col("qualifier").contains("."), F.regexp_replace("qualifier", r"^[^.]*\.", "")))
    d = d.join(quals, (F.col("source_file_id") == F.col("qf")) & (F.col("qualifier") == F.col("qq")), "left")
    d = d.join(top.select(F.col("tf").alias("af"), F.col("tn").alias("an"), F.col("ts").alias("a_s")), (F.col("qt") == F.col("af")) & (F.col("name") == F.col("an")), "left")
    d = d.join(p, (F.col("source_file_id") == F.col("pf")) & (F.col("root") == F.col("pb")), "left")
    d = d.withColumn("tm", F.when(F.col("rest").isNull(), F.col("pp")).otherwise(F.concat_ws(".", "pp", "rest")))
    d = d.join(modules, F.col("tm") == F.col("m"), "left")
    d = d.join(top.select(F.col("tf").alias("cf"), F.col("tn").alias("cn"), F.col("ts").alias("c_s")), (F.col("mf") == F.col("cf")) & (F.col("name") == F.col("cn")), "left")
    d = d.select(*keep, F.coalesce("a_s", "c_s").alias("target_symbol_id"), F.when(F.col("a_s").isNotNull(), F.col("qi")).when(F.col("c_s").isNotNull(), F.col("pi")).alias("import_id"))
    refs = c.select(*keep, "target_symbol_id", "import_id").unionAll(d).where("target_symbol_id is not null")
    refs = refs.where(~F.coalesce(F.col("source_symbol_id") == F.col("target_symbol_id"), F.lit(False)))
    return refs, external
