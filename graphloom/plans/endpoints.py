"""HTTP endpoints: definitions in server code and calls in client code, joined on method and path across repositories."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.plans.codegraph import CodeGraph

PLUGINS: dict[str, Callable[[CodeGraph], DataFrame]] = {}


def plugin(name: str):
    """Register a scan of a graph that gives rows (side, method, url, file, symbol_id); side is definition or usage."""

    def wrap(f):
        PLUGINS[name] = f
        return f

    return wrap


def route_of(decorator: Column) -> Column:
    """The path of a route decorator's first argument, null for other decorators."""
    p = r"^[\w.]+\.(?:route|get|post|put|patch|delete)\(\s*[rf]?['\"]([^'\"]*)['\"]"
    return F.when(decorator.rlike(p), F.regexp_extract(decorator, p, 1))


def methods_of(decorator: Column) -> Column:
    """The HTTP methods a route decorator names: its own name's, its methods argument, else GET."""
    own = F.upper(F.regexp_extract(decorator, r"^[\w.]+\.(get|post|put|patch|delete)\(", 1))
    listed = F.regexp_extract(decorator, r"methods\s*=\s*[\[(]([^\])]*)[\])]", 1)
    names = F.transform(F.regexp_extract_all(listed, F.lit(r"\w+"), F.lit(0)), lambda x: F.upper(x))
    return F.when(own != "", F.array(own)).when(F.size(names) > 0, names).otherwise(F.array(F.lit("GET")))


def normal_url(url: Column) -> Column:
    """A path with every placeholder written alike: <int:id>, {id}, :id and ${id} become {}."""
    bare = F.regexp_replace(url, r"^https?://[^/]+", "")
    bare = F.regexp_replace(bare, r"[?#].*$", "")
    bare = F.regexp_replace(bare, r"<[^>]*>|\$\{[^}]*\}|\{[^}]*\}|(?<=/):\w+", "{}")
    return F.when(F.length(bare) > 1, F.regexp_replace(bare, "/$", "")).otherwise(bare)


@plugin("routes")
def routes(g: CodeGraph) -> DataFrame:
    """Decorated handler functions of Python web frameworks."""
    d = g.symbols.where("kind = 'function'").select("id", "file_id", F.explode("decorators").alias("d"))
    d = d.withColumn("url", route_of(F.col("d"))).where("url is not null").withColumn("method", F.explode(methods_of(F.col("d"))))
    return d.join(g.files.select(F.col("id").alias("_f"), "path"), F.col("file_id") == F.col("_f")).select(F.lit("definition").alias("side"), "method", normal_url(F.col("url")).alias("url"), F.col("path").alias("file"), F.col("id").alias("symbol_id"))


@plugin("requests")
def requests(g: CodeGraph) -> DataFrame:
    """Calls client.method(url) and fetch(url) of HTTP clients."""
    c = g.calls.where("size(arguments) > 0").withColumn("v", F.col("arguments")[0]["value"])
    lit = F.col("v").rlike(r"^[fr]?['\"`].*['\"`]$")
    method = F.when(F.lower("name").isin("get", "post", "put", "patch", "delete") & F.coalesce("qualifier", F.lit("")).rlike(r"(?i)(axios|requests|httpx|client|http|api|session)$"), F.upper("name")).when((F.col("name") == "fetch") & F.col("qualifier").isNull(), F.upper(F.coalesce(F.nullif(F.regexp_extract(F.coalesce(F.get(F.col("arguments"), F.lit(1))["value"], F.lit("")), r"method\s*:\s*['\"](\w+)", 1), F.lit("")), F.lit("GET"))))
    c = c.withColumn("method", method).where(lit & F.col("method").isNotNull())
    url = normal_url(F.regexp_replace("v", r"^[fr]?['\"`]|['\"`]$", ""))
    return c.join(g.files.select(F.col("id").alias("_f"), "path"), F.col("source_file_id") == F.col("_f")).select(F.lit("usage").alias("side"), "method", url.alias("url"), F.col("path").alias("file"), F.col("source_symbol_id").alias("symbol_id"))


def scan(g: CodeGraph) -> DataFrame:
    """All plugins' endpoints of one repository."""
    out = None
    for f in PLUGINS.values():
        out = f(g) if out is None else out.unionAll(f(g))
    return out


def link(endpoints: DataFrame) -> DataFrame:
    """(method, url, definitions, usages): who defines and who calls each endpoint; either list may be empty."""
    of = lambda side: F.array_sort(F.collect_set(F.when(F.col("side") == side, F.concat_ws("::", "file", "symbol_id"))))
    return endpoints.groupBy("method", "url").agg(of("definition").alias("definitions"), of("usage").alias("usages"))
