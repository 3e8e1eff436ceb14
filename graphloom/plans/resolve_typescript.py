"""Name resolution of TypeScript and JavaScript code as joins: modules, re-exports, namespaces, references.

Inputs are the tables of graphloom.plans.codegraph, configs the few tsconfig files as dicts (dir, base_url, paths).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import scalar as S
from graphloom.lineage import cut, digest, is_empty
from graphloom.operators.joins import last_wins
from graphloom.plans.resolve import _top

NO_LONG = F.lit(None).cast("long")


def module_files(files: DataFrame, imports: DataFrame, configs: list[dict]) -> DataFrame:
    """(import_id, source_file_id, target_file_id): the first candidate path that is a file.

    Relative modules are seen from the importing file; others through the nearest tsconfig above it: its path patterns,
    the most specific first, then its base directory.
    """
    f = files.select(F.col("id").alias("fid"), "path")
    i = imports.where("module is not null").select(F.col("id").alias("import_id"), "file_id", "module").join(f, F.col("file_id") == F.col("fid")).drop("fid")
    relative = F.col("module").startswith(".")
    bases = i.where(relative).select("import_id", "file_id", F.lit(0).alias("rank"), S.normal_path(S.parent_dir(F.col("path")), F.col("module")).alias("base"))
    if configs:
        rows = [
            (c["dir"], c["base_url"], k, p, j, t)
            for c in configs
            for k, (p, j, t) in enumerate([(p, j, t) for p, ts in c["paths"] for j, t in enumerate(ts)] or [(None, 0, None)])
        ]
        conf = cut(files.sparkSession.createDataFrame(rows, "dir string, base_url string, k int, pattern string, j int, target string"))
        up = i.where(~relative).withColumn("dir", F.explode(F.concat(F.array(F.lit("")), S.directory_prefixes(F.col("path")))))
        near = up.join(conf.select("dir").distinct(), "dir", "left_semi").groupBy("import_id", "file_id", "module").agg(F.max_by("dir", F.length("dir")).alias("dir"))
        near = cut(near.join(conf, "dir"))
        star = S.apply_pattern(F.col("pattern"), F.col("module"))
        root = S.normal_path(F.col("dir"), F.coalesce("base_url", F.lit(".")))
        mapped = near.where("pattern is not null").withColumn("star", star).where("star is not null")
        mapped = mapped.select("import_id", "file_id", F.col("k").alias("rank"), S.normal_path(root, F.replace(F.col("target"), F.lit("*"), F.col("star"))).alias("base"))
        based = near.where("base_url is not null and k = 0").select("import_id", "file_id", F.lit(1 << 30).alias("rank"), S.normal_path(root, F.col("module")).alias("base"))
        bases = bases.unionAll(mapped).unionAll(based)
    paths = bases.where("base is not null").select("import_id", "file_id", "rank", F.posexplode(S.typescript_candidates(F.col("base"))).alias("ordinal", "candidate"))
    hit = paths.join(f, F.col("candidate") == F.col("path"))
    return hit.groupBy("import_id", F.col("file_id").alias("source_file_id")).agg(F.min_by("fid", F.struct("rank", "ordinal")).alias("target_file_id"))


def local_exports(symbols: DataFrame, exports: DataFrame) -> DataFrame:
    """(file_id, name, symbol_id, rank) of names that a file exports itself; of one name the last export counts."""
    top = _top(symbols)
    e = exports.where("source_module is null and name is not null").withColumn("local", F.coalesce("local_name", "name"))
    e = e.join(top, (F.col("file_id") == F.col("tf")) & (F.col("local") == F.col("tn")), "left")
    e = e.select("file_id", "name", F.coalesce("symbol_id", "ts").alias("symbol_id"), F.col("id").alias("rank"), ((F.col("kind") == "export_equals") & (F.col("local_name") == F.col("name"))).alias("whole"))
    e = e.where("symbol_id is not null")
    default = e.where("whole").withColumn("name", F.lit("default"))
    return last_wins(e.unionAll(default).drop("whole"), ["file_id", "name"], ["rank"]).select("file_id", "name", "symbol_id")


def exported(symbols: DataFrame, exports: DataFrame, resolutions: DataFrame) -> DataFrame:
    """(file_id, name, symbol_id) of all exported names, re-exports and wildcards included, until nothing changes."""
    own = local_exports(symbols, exports).withColumn("rank", F.lit(-1).cast("long"))
    r = resolutions.select("import_id", "target_file_id", "target_symbol_id")
    e = exports.where("import_id is not null").select("id", "file_id", "kind", "name", "import_id").join(r, "import_id")
    named = e.where("kind in ('named', 'default', 'export_equals') and name is not null and target_symbol_id is not null").select("file_id", "name", F.col("target_symbol_id").alias("symbol_id"), F.col("id").alias("rank"))
    fixed = cut(own.unionAll(named))
    stars = cut(e.where("kind = 'wildcard'").select(F.col("file_id").alias("sf"), F.col("target_file_id").alias("tf"), F.col("id").alias("rank")))
    out = cut(last_wins(fixed, ["file_id", "name"], ["rank"]).select("file_id", "name", "symbol_id"))
    if is_empty(stars):
        return out
    state = digest(out)
    seen = {state}
    while True:
        pulled = stars.join(out.where("name <> 'default'"), F.col("tf") == F.col("file_id")).select(F.col("sf").alias("file_id"), "name", "symbol_id", "rank")
        out = cut(last_wins(fixed.unionAll(pulled), ["file_id", "name"], ["rank", "symbol_id"]).select("file_id", "name", "symbol_id"))
        before, state = state, digest(out)
        if state == before:
            break
        if state in seen:
            raise RuntimeError("wildcard exports did not settle")
        seen.add(state)
    return out


def resolve_imports(files: DataFrame, symbols: DataFrame, imports: DataFrame, exports: DataFrame, configs: list[dict]) -> DataFrame:
    """(import_id, source_file_id, target_file_id, target_symbol_id) of imports of files of the repository."""
    found = cut(module_files(files, imports, configs))
    wanted = F.when(F.col("kind") == "default_import", "default").when(F.col("kind") == "named_import", F.col("name"))
    asked = cut(found.join(imports.select(F.col("id").alias("import_id"), wanted.alias("wanted")), "import_id"))
    top = _top(symbols)
    res = found.withColumn("target_symbol_id", NO_LONG)
    state = digest(res)
    again = not is_empty(exports.where("import_id is not null"))
    seen = {state}
    while True:
        names = exported(symbols, exports, res).select(F.col("file_id").alias("ef"), F.col("name").alias("en"), F.col("symbol_id").alias("es"))
        j = asked.join(names, (F.col("target_file_id") == F.col("ef")) & (F.col("wanted") == F.col("en")), "left")
        j = j.join(top, (F.col("target_file_id") == F.col("tf")) & (F.col("wanted") == F.col("tn")), "left")
        res = cut(j.select("import_id", "source_file_id", "target_file_id", F.coalesce("es", "ts").alias("target_symbol_id")))
        before, state = state, digest(res)
        if state == before or not again:  # without re-exports nothing can change again
            break
        if state in seen:
            raise RuntimeError("re-exports did not settle")
        seen.add(state)
    return res


def _walk(start: DataFrame, symbols: DataFrame) -> DataFrame:
    """(row, target): from symbol `at`, down the child names in `path` one after another; lost rows are left out."""
    children = cut(symbols.where("parent_symbol_id is not null").groupBy(F.col("parent_symbol_id").alias("cp"), F.col("name").alias("cn")).agg(F.max("id").alias("ci")))
    state, done = cut(start.select("row", "at", "path")), None
    while True:
        ends = state.where("size(path) = 0").select("row", F.col("at").alias("target"))
        done = ends if done is None else done.unionAll(ends)
        rest = state.where("size(path) > 0")
        if is_empty(rest):
            return done
        step = rest.join(children, (F.col("at") == F.col("cp")) & (F.element_at("path", 1) == F.col("cn")))
        state = cut(step.select("row", F.col("ci").alias("at"), F.slice("path", F.lit(2), F.size("path") - 1).alias("path")))


def resolve_references(files: DataFrame, symbols: DataFrame, imports: DataFrame, exports: DataFrame, resolutions: DataFrame, externals: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """References and external references of unshadowed candidates, in the priorities of local, imported, same file."""
    top = _top(symbols)
    names = cut(exported(symbols, exports, resolutions))
    i = cut(imports.join(resolutions.select(F.col("import_id").alias("id"), "target_file_id", "target_symbol_id"), "id", "left"))
    bound = i.where("target_symbol_id is not null and alias is not null").groupBy(F.col("file_id").alias("bf"), F.col("alias").alias("bn")).agg(F.max_by("target_symbol_id", "id").alias("bs"), F.max("id").alias("bi"))
    ext = i.join(externals.select(F.col("import_id").alias("id")), "id", "left_semi").where("alias is not null").groupBy(F.col("file_id").alias("xf"), F.col("alias").alias("xn")).agg(F.max("id").alias("xi"))
    keep = ["row", "source_file_id", "source_symbol_id", "name", "range"]
    c = candidates.where("qualifier is null")
    c = c.join(bound, (F.col("source_file_id") == F.col("bf")) & (F.col("name") == F.col("bn")), "left")
    c = c.join(top, (F.col("source_file_id") == F.col("tf")) & (F.col("name") == F.col("tn")), "left")
    c = c.join(ext, (F.col("source_file_id") == F.col("xf")) & (F.col("name") == F.col("xn")), "left")
    via = F.when(F.col("local_symbol_id").isNull() & F.col("bs").isNotNull(), F.col("bi"))
    c = cut(c.select(*keep, F.coalesce("local_symbol_id", "bs", "ts").alias("target_symbol_id"), via.alias("import_id"), "xi"))
    external = c.where("target_symbol_id is null and xi is not null").select(*keep, F.col("xi").alias("import_id"))

    # modules by the name that qualifies: namespace imports, and names that stand for a namespace re-export
    spaces = exports.where("kind = 'namespace' and name is not null").join(resolutions.select("import_id", "target_file_id"), "import_id")
    spaces = spaces.groupBy(F.col("file_id").alias("sf"), F.col("name").alias("sn")).agg(F.max_by("target_file_id", "id").alias("st"))
    whole = i.where("kind = 'namespace_import' and alias is not null and target_file_id is not null").select("file_id", "alias", F.col("target_file_id").alias("mt"), "id")
    named = i.where("kind = 'named_import' and target_file_id is not null").join(spaces, (F.col("target_file_id") == F.col("sf")) & (F.col("name") == F.col("sn"))).select("file_id", "alias", F.col("st").alias("mt"), "id")
    modules = whole.unionAll(named).groupBy(F.col("file_id").alias("mf"), F.col("alias").alias("mn")).agg(F.max_by("mt", "id").alias("mt"), F.max("id").alias("mi"))

    d = candidates.where("qualifier is not null").withColumn("parts", F.split("qualifier", r"\."))
    d = d.withColumn("first", F.element_at("parts", 1)).withColumn("rest", F.concat(F.slice("parts", F.lit(2), F.size("parts")), F.array("name")))
    d = d.join(modules, (F.col("source_file_id") == F.col("mf")) & (F.col("first") == F.col("mn")), "left")
    d = d.join(bound, (F.col("source_file_id") == F.col("bf")) & (F.col("first") == F.col("bn")), "left")
    d = cut(d.select(*keep, "first", "rest", "mt", "mi", "bs", "bi"))
    m = d.where("mt is not null").withColumn("head", F.element_at("rest", 1))
    m = m.join(names.select(F.col("file_id").alias("ef"), F.col("name").alias("en"), F.col("symbol_id").alias("es")), (F.col("mt") == F.col("ef")) & (F.col("head") == F.col("en")), "left")
    m = m.join(top, (F.col("mt") == F.col("tf")) & (F.col("head") == F.col("tn")), "left")
    tail = F.slice("rest", F.lit(2), F.size("rest"))
    by_module = m.select("row", F.coalesce("es", "ts").alias("at"), tail.alias("path"), F.col("mi").alias("via"))
    by_symbol = d.where("mt is null and bs is not null").select("row", F.col("bs").alias("at"), F.col("rest").alias("path"), F.col("bi").alias("via"))
    here = d.where("mt is null and bs is null").join(top, (F.col("source_file_id") == F.col("tf")) & (F.col("first") == F.col("tn")))
    by_file = here.select("row", F.col("ts").alias("at"), F.col("rest").alias("path"), NO_LONG.alias("via"))
    starts = cut(by_module.unionAll(by_symbol).unionAll(by_file).where("at is not null"))
    hit = _walk(starts, symbols).join(starts.select("row", "via"), "row")
    d = d.join(hit, "row").select(*keep, F.col("target").alias("target_symbol_id"), F.col("via").alias("import_id"))

    refs = c.select(*keep, "target_symbol_id", "import_id").unionAll(d).where("target_symbol_id is not null")
    return refs.where(~F.coalesce(F.col("source_symbol_id") == F.col("target_symbol_id"), F.lit(False))), external
