"""Views that make the driver's star-schema tables look like a code graph, and one query per operator over them.

    symbols        part (symbol_id=p_partkey, name=p_name, kind=p_type, file=p_brand)
    references     lineitem (source=l_suppkey, target=l_partkey)
    files          documents (file_id=doc_id, path=source/doc_id, language=lang, content=text)
    spans          conversations (start=turn)
    containment    customer/supplier -> nation -> region
    calls, changes events in the order of ts
    markup         pages.html

The SQL beside each query is the same result in ANSI SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import scalar as S
from graphloom.operators import aggregates as A
from graphloom.operators import edits as E
from graphloom.operators import joins as J
from graphloom.operators import rows as W
from graphloom.operators import traversal as T
from graphloom.plans import refactor as R
from graphloom.plans.codegraph import CodeGraph
from graphloom.sources import repo
from graphloom.streaming import changes as C

_registry: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None = None):
    def wrap(f):
        _registry[f.__name__] = (f, sql)
        return f

    return wrap


def queries() -> dict:
    return {k: f for k, (f, _) in _registry.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _registry.items() if s}


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def references(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("source_symbol_id"), F.col("l_partkey").alias("target_symbol_id"), F.col("l_orderkey").alias("id"), F.col("l_linenumber").cast("long").alias("ordinal"), "l_returnflag", "l_linestatus", "l_quantity", "l_shipdate"
    )


def document_sources(spark: SparkSession, d: str) -> DataFrame:
    """(path, content) of the documents, under their ids."""
    return t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.encode("text", "UTF-8").alias("content"))


def supply_edges(spark: SparkSession, d: str) -> DataFrame:
    """The bipartite graph of all line items; parts are numbered apart from suppliers."""
    return t(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + PARTS).alias("dst"))


def order_edges(spark: SparkSession, d: str) -> DataFrame:
    """Orders to customers to nations to regions, each numbered apart."""
    one = lambda n, a, k, b, j: t(spark, d, n).select((F.col(a) + k).alias("src"), (F.col(b) + j).cast("long").alias("dst"))
    o, c, n = one("orders", "o_orderkey", 0, "o_custkey", CUSTOMERS), one("customer", "c_custkey", CUSTOMERS, "c_nationkey", NATIONS), one("nation", "n_nationkey", NATIONS, "n_regionkey", REGIONS)
    return o.unionAll(c).unionAll(n)


#: What keeps the ids of the tables apart.
PARTS, CUSTOMERS, NATIONS, REGIONS = 10**12, 2 * 10**12, 3 * 10**12, 4 * 10**12
ORDER_EDGES = f"""SELECT o_orderkey AS src, o_custkey + {CUSTOMERS} AS dst FROM orders UNION ALL SELECT c_custkey + {CUSTOMERS}, CAST(c_nationkey AS BIGINT) + {NATIONS} FROM customer
 UNION ALL SELECT CAST(n_nationkey AS BIGINT) + {NATIONS}, CAST(n_regionkey AS BIGINT) + {REGIONS} FROM nation"""


def both_ways(e: DataFrame) -> DataFrame:
    return e.select("src", "dst").unionAll(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


SUPPLY = f"SELECT l_suppkey AS src, l_partkey + {PARTS} AS dst FROM lineitem"


@query("SELECT doc_id AS file_id, source || '/' || doc_id AS path, lang AS language, CAST(octet_length(encode(text)) AS BIGINT) AS byte_len FROM documents WHERE lang IN ('en','fr') AND source LIKE 'src1%'")
def scan_filter_files(spark, d):
    docs = t(spark, d, "documents").select("doc_id", F.concat("source", F.lit("/"), "doc_id", F.lit("."), "lang").alias("path"), "text")
    kept = repo.filtered(docs, extensions=("en", "fr"), ignore="^(?!src1)")
    path = F.substring_index("path", ".", 1)
    return kept.select(F.col("doc_id").alias("file_id"), path.alias("path"), F.substring_index("path", ".", -1).alias("language"), F.octet_length("text").cast("long").alias("byte_len"))


@query("""SELECT (SELECT count(*) FROM documents) AS files, (SELECT count(*) FROM part) AS symbols, (SELECT count(*) FROM lineitem) AS refs,
 (SELECT count(*) FROM orders) AS imports, (SELECT CAST(sum(octet_length(encode(text))) AS BIGINT) FROM documents) AS bytes""")
def summary_counts(spark, d):
    n = F.count("*")
    docs = (t(spark, d, "documents"), [n.alias("files"), F.sum(F.octet_length("text")).cast("long").alias("bytes")])
    return W.one_row(docs, *[(t(spark, d, table), [n.alias(name)]) for table, name in (("part", "symbols"), ("lineitem", "refs"), ("orders", "imports"))])


@query("SELECT p_partkey AS symbol_id, p_name AS name, p_type AS kind FROM part WHERE contains(lower(p_name || ' ' || p_type || ' ' || p_brand), 'gear') ORDER BY p_name, p_partkey LIMIT 200")
def symbols_search(spark, d):
    p = t(spark, d, "part").select(F.col("p_partkey").alias("symbol_id"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"), "p_brand")
    return W.holding(p, "GEAR", ["name", "kind", "p_brand"], ["name", "symbol_id"], 200).drop("p_brand")


@query("SELECT l_suppkey AS source_symbol_id, l_partkey AS target_symbol_id, array_to_string(list_sort(list(l_orderkey)), ',') AS reference_ids, count(*) AS reference_count FROM lineitem WHERE l_suppkey IS NOT NULL GROUP BY 1, 2")
def dependencies_group(spark, d):
    return A.dependencies(references(spark, d)).withColumn("reference_ids", F.array_join(F.col("reference_ids").cast("array<string>"), ","))


@query("SELECT p_partkey AS symbol_id, p_name AS name FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 49)")
def external_anti(spark, d):
    p = t(spark, d, "part").select(F.col("p_partkey").alias("symbol_id"), F.col("p_name").alias("name"))
    return J.unmatched(p, t(spark, d, "lineitem").where("l_quantity >= 49"), [("symbol_id", "l_partkey")])


@query("SELECT p_partkey AS symbol_id, p_name AS name FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 49)")
def semi_used(spark, d):
    p = t(spark, d, "part").select(F.col("p_partkey").alias("symbol_id"), F.col("p_name").alias("name"))
    return J.matched(p, t(spark, d, "lineitem").where("l_quantity >= 49"), [("symbol_id", "l_partkey")])


@query("""SELECT o.o_orderkey AS import_id, coalesce(a.v, b.v, c.v) AS target, CASE WHEN a.v IS NOT NULL THEN 1 WHEN b.v IS NOT NULL THEN 2 WHEN c.v IS NOT NULL THEN 3 END AS rung
 FROM orders o
 LEFT JOIN (SELECT l_orderkey AS k, max(l_partkey) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) a ON a.k = o.o_orderkey
 LEFT JOIN (SELECT l_orderkey AS k, max(l_partkey) AS v FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1) b ON b.k = o.o_orderkey
 LEFT JOIN (SELECT c_custkey AS k, max(c_custkey) AS v FROM customer GROUP BY 1) c ON c.k = o.o_custkey""")
def resolve_ladder(spark, d):
    line = t(spark, d, "lineitem")
    rungs = [
        (line.where("l_returnflag = 'R'"), [("o_orderkey", "l_orderkey")], "l_partkey"),
        (line.where("l_linestatus = 'O'"), [("o_orderkey", "l_orderkey")], "l_partkey"),
        (t(spark, d, "customer"), [("o_custkey", "c_custkey")], "c_custkey"),
    ]
    out = J.ladder(t(spark, d, "orders").select("o_orderkey", "o_custkey"), rungs, "target", "rung")
    return out.select(F.col("o_orderkey").alias("import_id"), "target", "rung")


@query("SELECT user_id, event_type AS name, arg_max(value, (ts, event_id)) AS value, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2")
def last_wins_dedupe(spark, d):
    e = t(spark, d, "events").select("user_id", F.col("event_type").alias("name"), "value", "event_id", "ts")
    return J.last_wins(e, ["user_id", "name"], ["ts", "event_id"]).select("user_id", "name", "value", "event_id")


_spans = "SELECT conv_id, turn, turn AS s, turn + 1 + length(text) % 5 AS e, conv_id * 1000 + turn AS id FROM conversations"


def spans(spark, d):
    return t(spark, d, "conversations").select("conv_id", "turn", F.col("turn").alias("s"), (F.col("turn") + 1 + F.length("text") % 5).alias("e"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id")).distinct()


@query(f"""WITH s AS (SELECT DISTINCT * FROM ({_spans})) SELECT p.id AS "row", arg_min(q.id, (q.e - q.s, q.id)) AS container
 FROM s p LEFT JOIN s q ON p.conv_id = q.conv_id AND q.s <= p.s AND p.s + 1 <= q.e AND q.id <> p.id GROUP BY 1""")
def innermost_span(spark, d):
    s = spans(spark, d)
    points = s.select(F.col("id").alias("row"), "conv_id", "s", (F.col("s") + 1).alias("e"))
    return J.innermost(points, s, "conv_id", "s", "e", "id", itself=False).select("row", "container")


@query("""SELECT min_id AS "row", container FROM (SELECT conv_id * 1000 + turn AS min_id, (SELECT 1) AS one, arg_min(q.id, (q.e - q.s, q.id)) AS container FROM (SELECT DISTINCT conv_id, turn FROM conversations) c
 JOIN (SELECT DISTINCT conv_id AS g, turn AS s, turn + 1 + length(text) % 5 AS e, conv_id * 1000 + turn AS id FROM conversations) q ON c.conv_id = q.g AND q.s <= c.turn AND c.turn + 1 <= q.e GROUP BY 1)""")
def span_containers(spark, d):
    s = spans(spark, d)
    points = s.select("conv_id", "turn").distinct().select((F.col("conv_id") * 1000 + F.col("turn")).alias("row"), "conv_id", F.col("turn").alias("s"), (F.col("turn") + 1).alias("e"))
    return J.innermost(points, s, "conv_id", "s", "e", "id").select("row", "container")


@query(f"WITH s AS (SELECT DISTINCT * FROM ({_spans})) SELECT a.id AS a_id, b.id AS b_id FROM s a JOIN s b ON a.conv_id = b.conv_id AND a.s < b.e AND b.s < a.e AND a.id < b.id")
def overlap_join(spark, d):
    s = spans(spark, d)
    b = s.select("conv_id", F.col("s").alias("bs"), F.col("e").alias("be"), F.col("id").alias("b_id"))
    return J.overlaps(s.withColumnRenamed("id", "a_id"), b, "conv_id", ("s", "e"), ("bs", "be")).where("a_id < b_id").select("a_id", "b_id")


@query("""SELECT p.event_id, max(v.ts) AS prev_ts FROM events p LEFT JOIN events v ON v.user_id = p.user_id AND v.event_type = 'view' AND v.ts < p.ts
 WHERE p.event_type = 'purchase' GROUP BY 1""")
def asof_definition(spark, d):
    e = t(spark, d, "events")
    uses = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    defs = e.where("event_type = 'view'").select("user_id", "ts", F.col("ts").alias("def_ts"))
    return J.as_of(uses, defs, ["user_id"], "ts", ["def_ts"]).select("event_id", F.col("prev_def_ts").alias("prev_ts"))


@query("SELECT l_partkey AS symbol_id, l_orderkey AS id, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC) AS nth FROM lineitem WHERE l_returnflag = 'A'")
def usages_desc(spark, d):
    r = references(spark, d).where("l_returnflag = 'A'").withColumnRenamed("target_symbol_id", "symbol_id")
    return W.place_within(r, ["symbol_id"], [F.desc("l_shipdate"), F.desc("id"), F.desc("ordinal")], "nth", 1).select("symbol_id", "id", "nth")


@query("""SELECT l_orderkey AS id, l_linenumber AS ordinal, CASE WHEN l_returnflag = 'R' THEN 1 WHEN l_returnflag = 'A' THEN 2 ELSE 4 END + CASE WHEN l_linestatus = 'O' THEN 8 ELSE 0 END AS usage_type
 FROM lineitem WHERE ((CASE WHEN l_returnflag = 'R' THEN 1 WHEN l_returnflag = 'A' THEN 2 ELSE 4 END + CASE WHEN l_linestatus = 'O' THEN 8 ELSE 0 END) & 9) <> 0""")
def usage_type_filter(spark, d):
    kind = F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "A", 2).otherwise(4) + F.when(F.col("l_linestatus") == "O", 8).otherwise(0)
    r = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("ordinal"), kind.alias("usage_type"))
    return W.with_bits(r, "usage_type", 1 | 8)


def _trace_sql(start: str, depth: int, e: str) -> str:
    return f"""WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM ({e})), r AS (SELECT {start} AS node, 0 AS depth UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.node WHERE r.depth < {depth - 1}),
 f AS (SELECT node, min(depth) AS depth FROM r GROUP BY 1) SELECT e.src, e.dst, f.depth + 1 AS depth FROM f JOIN e ON e.src = f.node"""


BOTH = f"SELECT src, dst FROM ({SUPPLY}) UNION ALL SELECT dst, src FROM ({SUPPLY})"


@query(_trace_sql("(SELECT CAST(min(s_suppkey) AS BIGINT) FROM supplier)", 2, BOTH))
def trace_out_depth2(spark, d):
    start = t(spark, d, "supplier").agg(F.min("s_suppkey").alias("node"))
    return T.trace(both_ways(supply_edges(spark, d)), start, 2)


@query(f"""WITH e AS ({ORDER_EDGES}), s AS (SELECT min(n_nationkey) + {NATIONS} AS node FROM nation), one AS (SELECT src, dst FROM e WHERE dst = (SELECT node FROM s))
 SELECT src, dst, 1 AS depth FROM one UNION ALL SELECT e.src, e.dst, 2 FROM e WHERE e.dst IN (SELECT src FROM one)""")
def trace_in_depth2(spark, d):
    start = t(spark, d, "nation").agg((F.min("n_nationkey") + NATIONS).alias("node"))
    return T.trace(order_edges(spark, d), start, 2, inbound=True)


@query(f"""WITH RECURSIVE e AS ({ORDER_EDGES}), r AS (SELECT DISTINCT src AS root, src AS node, 0 AS level FROM e
  UNION SELECT r.root, e.dst, r.level + 1 FROM r JOIN e ON e.src = r.node WHERE r.level < 3)
 SELECT root, node, min(level) AS level FROM r GROUP BY 1, 2 HAVING min(level) > 0""")
def deps_depth(spark, d):
    e = order_edges(spark, d)
    return T.reach(e, e.select(F.col("src").alias("node")).distinct(), 3)


_parents = """SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation"""


def parents(spark, d):
    one = lambda n, a, x, b, y: t(spark, d, n).select(F.concat(F.lit(a), x).alias("src"), F.concat(F.lit(b), y).alias("dst"))
    return one("customer", "c", "c_custkey", "n", "c_nationkey").unionAll(one("supplier", "s", "s_suppkey", "n", "s_nationkey")).unionAll(one("nation", "n", "n_nationkey", "r", "n_regionkey"))


@query(f"""WITH p AS ({_parents}) SELECT src AS root, dst AS node, 1 AS level FROM p UNION ALL SELECT a.src, b.dst, 2 FROM p a JOIN p b ON a.dst = b.src""")
def superclass_levels(spark, d):
    p = parents(spark, d)
    return T.reach(p, p.select(F.col("src").alias("node")).distinct())


@query("""WITH m AS (SELECT n_regionkey AS class_id, 0 AS level, n_nationkey AS pos, substr(n_name, 1, 1) AS name, n_name AS v FROM nation
 UNION ALL SELECT r_regionkey, 1, r_regionkey, substr(r_name, 1, 1), r_name FROM region)
 SELECT class_id, name, arg_min(v, (level, pos)) AS method FROM m GROUP BY 1, 2""")
def mro_first_wins(spark, d):
    own = t(spark, d, "nation").select(F.col("n_regionkey").alias("class_id"), F.lit(0).alias("level"), F.col("n_nationkey").alias("pos"), F.substring("n_name", 1, 1).alias("name"), F.col("n_name").alias("method"))
    base = t(spark, d, "region").select(F.col("r_regionkey").alias("class_id"), F.lit(1).alias("level"), F.col("r_regionkey").alias("pos"), F.substring("r_name", 1, 1).alias("name"), F.col("r_name").alias("method"))
    return J.last_wins(own.unionAll(base), ["class_id", "name"], ["level", "pos"], first=True).select("class_id", "name", "method")


@query("SELECT doc_id AS node, 1 AS round FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def dead_code(spark, d):
    uses = t(spark, d, "labels").select((F.col("doc_id") + PARTS).alias("src"), F.col("doc_id").alias("dst"))
    return T.dead(t(spark, d, "documents").select(F.col("doc_id").alias("node")), uses)


@query(f"""WITH e AS ({ORDER_EDGES}), n AS (SELECT src AS node FROM e UNION SELECT dst FROM e), d1 AS (SELECT node FROM n WHERE node NOT IN (SELECT dst FROM e)),
 d2 AS (SELECT node FROM n WHERE node NOT IN (SELECT node FROM d1) AND node NOT IN (SELECT dst FROM e WHERE src NOT IN (SELECT node FROM d1)))
 SELECT node, 1 AS round FROM d1 UNION ALL SELECT node, 2 FROM d2""")
def second_order_dead(spark, d):
    e = order_edges(spark, d)
    return T.dead(e.select(F.col("src").alias("node")).unionAll(e.select("dst")), e, rounds=2)


@query("""SELECT l_suppkey AS from_file, l_partkey AS to_file, count(*) FILTER (WHERE l_returnflag = 'R') AS dynamic_imports, count(*) FILTER (WHERE l_returnflag <> 'R') AS static_imports
 FROM lineitem GROUP BY 1, 2 HAVING count(*) FILTER (WHERE l_returnflag = 'R') > 0 AND count(*) FILTER (WHERE l_returnflag <> 'R') > 0""")
def import_pair_counts(spark, d):
    r = t(spark, d, "lineitem").select(F.col("l_suppkey").alias("from_file"), F.col("l_partkey").alias("to_file"), (F.col("l_returnflag") == "R").alias("dynamic"))
    return W.pair_counts(r, "from_file", "to_file", F.col("dynamic"), "dynamic_imports", "static_imports")


@query(f"""WITH e AS (SELECT DISTINCT src, dst FROM ({SUPPLY})), k AS (SELECT node FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY 1 HAVING count(*) >= 30)
 SELECT src, dst FROM e WHERE src IN (SELECT node FROM k) AND dst IN (SELECT node FROM k)""")
def degree_prune(spark, d):
    return T.prune_degree(supply_edges(spark, d), 30)


@query("SELECT DISTINCT l_suppkey AS source, l_partkey AS target, l_returnflag AS call FROM lineitem WHERE l_linestatus = 'O' AND l_returnflag NOT IN ('A') AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 10)")
def edge_filter_dedupe(spark, d):
    e = t(spark, d, "lineitem").where("l_linestatus = 'O' and l_returnflag <> 'A'").select(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target"), F.col("l_returnflag").alias("call"))
    return J.matched(e.distinct(), t(spark, d, "part").where("p_size > 10"), [("target", "p_partkey")])


@query("SELECT CASE WHEN max(n) * 10 >= sum(n) THEN arg_max(lang, (n, lang)) ELSE 'OTHER' END AS language FROM (SELECT lang, count(*) AS n FROM documents GROUP BY 1)")
def top_language(spark, d):
    return W.main_kind(t(spark, d, "documents"), "lang", repo.LANGUAGE_SHARE, "OTHER", "language")


@query("SELECT source, lang, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY ROLLUP (source, lang)")
def file_rollup(spark, d):
    return W.subtotals(t(spark, d, "documents"), ["source", "lang"], F.count("*").alias("files"), F.sum("n_chars").alias("chars"))


@query("""SELECT symbol_id, complexity, CASE WHEN complexity <= 5 THEN 'A' WHEN complexity <= 10 THEN 'B' WHEN complexity <= 20 THEN 'C' WHEN complexity <= 30 THEN 'D' WHEN complexity <= 40 THEN 'E' ELSE 'F' END AS rank
 FROM (SELECT l_suppkey AS symbol_id, CAST(1 + sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS complexity FROM lineitem WHERE l_quantity > 45 GROUP BY 1)""")
def complexity_rank(spark, d):
    s = t(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_suppkey").alias("symbol_id"), F.when(F.col("l_returnflag") == "R", "if").otherwise("return").alias("kind"))
    return A.cyclomatic(s).withColumn("rank", A.cc_rank(F.col("complexity")))


_words = r"regexp_extract_all(lower(text), '[a-z]+')"


@query(f"""SELECT doc_id AS symbol_id, count(*) AS total, count(DISTINCT w) AS distinct_tokens, round(count(*) * log2(count(DISTINCT w)), 6) AS volume
 FROM (SELECT doc_id, unnest({_words}) AS w FROM documents) GROUP BY 1""")
def halstead(spark, d):
    words = F.filter(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)), lambda w: w != "")
    total, distinct, volume = A.halstead_of(F.col("words"))
    w = t(spark, d, "documents").select(F.col("doc_id").alias("symbol_id"), words.alias("words")).where("size(words) > 0")
    return w.select("symbol_id", total.alias("total"), distinct.alias("distinct_tokens"), F.round(volume, 6).alias("volume"))


@query(r"""SELECT doc_id AS file_id, CASE WHEN text = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + CASE WHEN ends_with(text, chr(10)) THEN 0 ELSE 1 END END AS loc,
 CAST(len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS BIGINT) AS sloc FROM documents""")
def line_metrics(spark, d):
    lines = F.split("text", "\n", -1)
    return t(spark, d, "documents").select(F.col("doc_id").alias("file_id"), A.line_count(F.col("text")).alias("loc"), F.size(F.filter(lines, lambda x: F.trim(x) != "")).cast("long").alias("sloc"))


@query("""SELECT p_partkey AS symbol_id, CAST(greatest(0, least(100, floor((171 - 5.2 * ln(greatest(p_retailprice, 1.0)) - 0.23 * p_size - 16.2 * ln(greatest(p_size, 1))) * 100 / 171))) AS INTEGER) AS mi FROM part""")
def maintainability(spark, d):
    p = t(spark, d, "part")
    return p.select(F.col("p_partkey").alias("symbol_id"), A.maintainability(F.col("p_retailprice"), F.col("p_size"), F.col("p_size")).alias("mi"))


@query(r"SELECT doc_id AS file_id, CAST(len(regexp_extract_all(text, '[0-9]{3}-[0-9]{4}')) AS BIGINT) AS hits FROM documents WHERE regexp_matches(text, '[0-9]{3}-[0-9]{4}')")
def regex_search(spark, d):
    found = R.search(document_sources(spark, d), r"[0-9]{3}-[0-9]{4}")
    return found.groupBy(F.col("path").cast("long").alias("file_id")).agg(F.count("*").alias("hits"))


@query("""SELECT page_id, rtrim('site/' || regexp_extract(url, '^[a-z]+://[^/]+/([^?]*)', 1), '/') AS path,
 CASE WHEN page_id % 3 = 0 THEN NULL ELSE rtrim(regexp_extract(url, '^[a-z]+://[^/]+/([^?]*)', 1), '/') END AS up FROM pages""")
def path_normalize(spark, d):
    rest = F.regexp_extract("url", r"^[a-z]+://[^/]+/([^?]*)", 1)
    up = F.when(F.col("page_id") % 3 == 0, F.lit("../../")).otherwise(F.lit("../"))
    return t(spark, d, "pages").select("page_id", S.normal_path(F.lit("site"), F.concat(F.lit("./x/../"), rest)).alias("path"), S.normal_path(F.lit("site"), F.concat(up, rest)).alias("up"))


@query("SELECT doc_id AS file_id, source || CASE WHEN doc_id % 5 = 0 THEN '' ELSE '.m' || doc_id END AS module_name FROM documents")
def module_name(spark, d):
    path = F.concat("source", F.when(F.col("doc_id") % 5 == 0, "/__init__.py").otherwise(F.concat(F.lit("/m"), F.col("doc_id"), F.lit(".py"))))
    return t(spark, d, "documents").select(F.col("doc_id").alias("file_id"), S.python_module(path).alias("module_name"))


@query("SELECT p_partkey AS import_id, p_name AS name, CASE WHEN p_size % 2 = 0 THEN p_brand END AS alias FROM part")
def alias_split(spark, d):
    text = F.when(F.col("p_size") % 2 == 0, F.concat("p_name", F.lit(" as "), "p_brand")).otherwise(F.col("p_name"))
    name, alias = S.split_alias(text)
    return t(spark, d, "part").select(F.col("p_partkey").alias("import_id"), name.alias("name"), alias.alias("alias"))


@query("SELECT p_partkey AS flag_id, p_brand AS owner, CAST(floor((row_number() OVER (PARTITION BY p_brand ORDER BY p_name, p_partkey) - 1) / 10) AS BIGINT) AS chunk FROM part")
def chunk_groups(spark, d):
    f = t(spark, d, "part").select(F.col("p_partkey").alias("flag_id"), F.col("p_brand").alias("owner"), "p_name")
    return A.flag_groups(f, "owner", 10, ["p_name", "flag_id"]).select("flag_id", "owner", "chunk")


@query("""SELECT event_id, lag(event_type) OVER w AS predecessor, lead(event_type) OVER w AS successor FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def lead_lag_chain(spark, d):
    e = W.neighbours(t(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type")
    return e.select("event_id", "predecessor", "successor")


@query("SELECT l_orderkey AS parent, l_linenumber AS start_byte, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS pos FROM lineitem")
def sibling_index(spark, d):
    line = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("parent"), F.col("l_linenumber").alias("start_byte"), "l_partkey", "l_suppkey")
    return W.place_within(line, ["parent"], ["start_byte", "l_partkey", "l_suppkey"], "pos").select("parent", "start_byte", "pos")


@query("""SELECT 'missing' AS side, count(*) AS n FROM (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R' EXCEPT ALL SELECT l_partkey, l_suppkey FROM lineitem WHERE l_linestatus = 'F')
 UNION ALL SELECT 'added', count(*) FROM (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_linestatus = 'F' EXCEPT ALL SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R')""")
def validation_except(spark, d):
    line = t(spark, d, "lineitem")
    return W.differences(*(line.where(c).select("l_partkey", "l_suppkey") for c in ("l_returnflag = 'R'", "l_linestatus = 'F'")))


@query("SELECT DISTINCT id, kind FROM (SELECT s_suppkey AS id, 'function' AS kind FROM supplier UNION ALL SELECT l_suppkey, 'function' FROM lineitem UNION ALL SELECT p_partkey, 'method' FROM part)")
def union_dedupe(spark, d):
    one = lambda table, key, kind: t(spark, d, table).select(F.col(key).alias("id"), F.lit(kind).alias("kind"))
    return W.one_of([one("supplier", "s_suppkey", "function"), one("lineitem", "l_suppkey", "function"), one("part", "p_partkey", "method")], ["id", "kind"])


@query("SELECT o_custkey AS file FROM orders WHERE o_orderstatus = 'O' INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 5000")
def intersect_commit(spark, d):
    queued = t(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("file"))
    return W.common(queued, t(spark, d, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("file")))


@query("""SELECT user_id AS path, CASE arg_max(event_type, (ts, event_id)) WHEN 'view' THEN 'ADD' WHEN 'click' THEN 'REPARSE' WHEN 'purchase' THEN 'REPARSE' WHEN 'error' THEN 'DELETE' ELSE 'ADD' END AS action FROM events GROUP BY 1""")
def change_last_wins(spark, d):
    e = t(spark, d, "events").select(F.col("user_id").alias("path"), "event_type", "ts", "event_id")
    k = F.col("event_type")
    action = F.when(k.isin("click", "purchase"), "REPARSE").when(k == "error", "DELETE").otherwise("ADD")
    return J.last_wins(e, ["path"], ["ts", "event_id"]).select("path", action.alias("action"))


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_events(spark, d):
    w = C.tumbling(t(spark, d, "events"), "1 hour", ["event_type"], total="value")
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH s AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL '2 hours' THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM s) SELECT user_id, min(ts) AS start, count(*) AS n FROM g GROUP BY user_id, k""")
def session_events(spark, d):
    s = C.sessions(t(spark, d, "events"), "2 hours", ["user_id"])
    return s.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("""SELECT l_partkey AS symbol_id, count(*) FILTER (WHERE l_returnflag = 'R') AS direct, count(*) FILTER (WHERE l_returnflag = 'A') AS aliased, count(*) FILTER (WHERE l_returnflag = 'N') AS chained FROM lineitem GROUP BY 1""")
def pivot_usage_kinds(spark, d):
    r = references(spark, d).withColumnRenamed("target_symbol_id", "symbol_id")
    return W.by_kind(r, "symbol_id", "l_returnflag", {"R": "direct", "A": "aliased", "N": "chained"})


_trade = """SELECT DISTINCT CAST(c_nationkey AS BIGINT) AS src, CAST(s_nationkey AS BIGINT) + CASE WHEN c_nationkey < s_nationkey THEN 0 ELSE 1000 END AS dst
 FROM orders JOIN customer ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey
 UNION SELECT CAST(n_nationkey AS BIGINT) + 1000, CAST(n_regionkey AS BIGINT) FROM nation"""


@query(f"""WITH RECURSIVE e AS ({_trade}), r AS (SELECT src AS a, dst AS b FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON e.src = r.b)
 SELECT x.a AS node, least(x.a, min(x.b)) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b GROUP BY x.a""")
def scc_import_loops(spark, d):
    bought = t(spark, d, "orders").join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    sold = t(spark, d, "lineitem").join(t(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "s_nationkey")
    side = F.when(F.col("c_nationkey") < F.col("s_nationkey"), 0).otherwise(1000)
    trade = bought.join(sold, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("c_nationkey").cast("long").alias("src"), (F.col("s_nationkey") + side).cast("long").alias("dst")).distinct()
    back = t(spark, d, "nation").select((F.col("n_nationkey") + 1000).cast("long").alias("src"), F.col("n_regionkey").cast("long").alias("dst"))
    return T.strongly_connected(trade.unionAll(back))


@query("""SELECT DISTINCT unnest(['site', 'site/' || source]) AS directory FROM documents""")
def directories(spark, d):
    path = F.concat(F.lit("site/"), "source", F.lit("/"), "doc_id")
    return t(spark, d, "documents").select(F.explode(S.directory_prefixes(path)).alias("directory")).distinct()


@query("""SELECT p.p_partkey AS symbol_id, n.n FROM part p LEFT JOIN (SELECT l_partkey, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1) n ON n.l_partkey = p.p_partkey WHERE coalesce(n.n, 0) >= 2""")
def widely_used(spark, d):
    n = W.distinct_per(t(spark, d, "lineitem"), "l_partkey", "l_suppkey", "n", least=2)
    return J.matched(n.withColumnRenamed("l_partkey", "symbol_id"), t(spark, d, "part"), [("symbol_id", "p_partkey")])


@query("""SELECT doc_id, regexp_replace(text, '!!|\\*\\*\\*|\\$\\$\\$|###|&&&|%%%', '', 'g') AS text FROM documents WHERE regexp_matches(text, '!!|\\*\\*\\*|\\$\\$\\$|###|&&&|%%%')""".replace("\\\\", "\\"))
def regex_replace(spark, d):
    docs = document_sources(spark, d)
    out = E.apply(docs, R.search(docs, r"!!|\*\*\*|\$\$\$|###|&&&|%%%", "")).where("status = 'modified'")
    return out.select(F.col("path").cast("long").alias("doc_id"), F.col("content").cast("string").alias("text"))


@query("""SELECT node, level FROM (WITH p AS (SELECT DISTINCT src, dst FROM (SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier))
 SELECT src AS node, CASE WHEN src LIKE 's%' THEN 0 WHEN EXISTS (SELECT 1 FROM p q WHERE q.dst = p.src) THEN 1 ELSE 0 END AS level FROM p
 UNION SELECT dst, max(CASE WHEN EXISTS (SELECT 1 FROM p q WHERE q.dst = p.src) THEN 2 ELSE 1 END) FROM p WHERE dst LIKE 'r%' GROUP BY 1)""")
def topological_levels(spark, d):
    one = lambda n, a, x, b, y: t(spark, d, n).select(F.concat(F.lit(a), x).alias("src"), F.concat(F.lit(b), y).alias("dst"))
    e = one("nation", "n", "n_nationkey", "r", "n_regionkey").unionAll(one("supplier", "s", "s_suppkey", "n", "s_nationkey"))
    return T.topological_levels(e, e.select(F.col("src").alias("node")).unionAll(e.select("dst")))


# queries through the whole engine: source files are written from the tables, then extracted, resolved and edited


def _module_sources(spark: SparkSession, d: str, text: Callable, path: Callable) -> DataFrame:
    """(path, content) of one file for each supplier, which uses that with the least key of its nation."""
    s = t(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), "s_nationkey")
    first = s.groupBy("s_nationkey").agg(F.min("k").alias("f"))
    s = s.join(first, "s_nationkey")
    return s.select(path(F.col("k")).alias("path"), F.encode(text(F.col("k"), F.col("f")), "UTF-8").alias("content"))


_uses = "SELECT s.s_suppkey AS k, f.f AS f FROM supplier s JOIN (SELECT s_nationkey, min(s_suppkey) AS f FROM supplier GROUP BY 1) f ON f.s_nationkey = s.s_nationkey WHERE s.s_suppkey <> f.f"


@query(f"SELECT 'f' || k AS source, 'f' || f AS target, CAST(2 AS BIGINT) AS reference_count FROM ({_uses})")
def python_dependencies(spark, d):
    text = lambda k, f: F.when(k == f, F.format_string("def f%d(x):\n    return x\n", k)).otherwise(F.format_string("from pkg.m%d import f%d as used\n\n\ndef f%d(used_by):\n    y = used(1)\n    return [used for z in y]\n", f, f, k))
    g = CodeGraph(spark, _module_sources(spark, d, text, lambda k: F.format_string("pkg/m%d.py", k)), "python")
    n = g.symbols.select("id", "name")
    e = g.dependencies.join(n.select(F.col("id").alias("source_symbol_id"), F.col("name").alias("source")), "source_symbol_id").join(n.select(F.col("id").alias("target_symbol_id"), F.col("name").alias("target")), "target_symbol_id")
    return e.select("source", "target", "reference_count")


@query(f"SELECT 'F' || k AS source, 'F' || f AS target, 'used' AS name FROM ({_uses}) UNION ALL SELECT 'F' || k, 'F' || f, 'F' || f FROM ({_uses})")
def typescript_references(spark, d):
    text = lambda k, f: F.when(k == f, F.format_string("export class F%d { go(): void {} }\n", k)).otherwise(F.format_string("import { F%d as used } from '../lib/i%d';\nimport * as all from '../lib/i%d';\nexport class F%d extends used { go() { return new all.F%d(); } }\n", f, f, f, k, f))
    own = _module_sources(spark, d, text, lambda k: F.format_string("src/m%d.ts", k))
    index = t(spark, d, "supplier").select(F.format_string("lib/i%d.ts", "s_suppkey").alias("path"), F.encode(F.format_string("export * from '../src/m%d';\n", "s_suppkey"), "UTF-8").alias("content"))
    g = CodeGraph(spark, own.unionAll(index), "typescript")
    n = g.symbols.select("id", "name")
    r = g.references.withColumnRenamed("name", "used_name")
    r = r.join(n.select(F.col("id").alias("source_symbol_id"), F.col("name").alias("source")), "source_symbol_id").join(n.select(F.col("id").alias("target_symbol_id"), F.col("name").alias("target")), "target_symbol_id")
    return r.select("source", "target", F.col("used_name").alias("name"))


@query("SELECT doc_id AS file_id, '> ' || text || ' <' AS text, 'modified' AS status FROM documents")
def edits_apply(spark, d):
    docs = t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.encode("text", "UTF-8").alias("content"))
    n = docs.withColumn("n", F.octet_length("content"))
    both = E.planned(n, "path", "insert", F.lit(0), F.lit(0), "> ", seq=1).unionAll(E.planned(n, "path", "insert", "n", "n", " <", seq=2)).unionAll(E.planned(n, "path", "insert", F.lit(0), F.lit(0), "> ", seq=3))
    out = E.apply(docs, both)
    return out.select(F.col("path").cast("long").alias("file_id"), F.col("content").cast("string").alias("text"), "status")


@query("""WITH l AS (SELECT user_id AS path, arg_max(event_type, (ts, event_id)) AS k FROM events GROUP BY 1), p AS (SELECT DISTINCT c_custkey AS path FROM customer)
 SELECT l.path, CASE WHEN l.k = 'error' THEN 'delete' WHEN p.path IS NOT NULL THEN 'reparse' ELSE 'add' END AS action FROM l LEFT JOIN p ON p.path = l.path WHERE l.k <> 'error' OR p.path IS NOT NULL""")
def sync_actions(spark, d):
    from graphloom.streaming.changes import sync_actions as actions

    e = t(spark, d, "events")
    kind = F.when(F.col("event_type") == "error", "removed").when(F.col("event_type").isin("click", "purchase"), "modified").otherwise("added")
    c = e.select(F.col("user_id").cast("string").alias("path"), kind.alias("change"), F.lit(None).cast("string").alias("rename_to"), F.lit(None).cast("binary").alias("content"), "ts", F.col("event_id").alias("seq"))
    present = t(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("path"))
    return actions(c, present).select(F.col("path").cast("long").alias("path"), "action")


@query("""SELECT time_bucket(INTERVAL '30 minutes', ts) - to_minutes(30 * o) AS start, event_type, count(*) AS n FROM events, (SELECT unnest([0, 1]) AS o) GROUP BY 1, 2""")
def sliding_events(spark, d):
    from graphloom.streaming.changes import sliding

    return sliding(t(spark, d, "events"), "1 hour", "30 minutes", ["event_type"]).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(r"""SELECT page_id, CASE WHEN length(u) > 1 THEN regexp_replace(u, '/$', '') ELSE u END AS url
 FROM (SELECT page_id, regexp_replace(regexp_replace(url, '^https?://[^/]+', ''), '[?#].*$', '') AS u FROM pages)""")
def endpoint_urls(spark, d):
    from graphloom.plans.endpoints import normal_url

    return t(spark, d, "pages").select("page_id", normal_url(F.col("url")).alias("url"))


@query("""SELECT l_suppkey AS class_id, count(DISTINCT l_partkey) AS depth FROM lineitem GROUP BY 1""")
def inheritance_depth(spark, d):
    return W.distinct_per(t(spark, d, "lineitem").withColumnRenamed("l_suppkey", "class_id"), "class_id", "l_partkey", "depth")


@query("""SELECT r_name AS directory, count(*) AS files, CAST(sum(c_acctbal * 100) AS BIGINT) AS size FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1
 UNION ALL SELECT r_name || '/' || n_name, count(*), CAST(sum(c_acctbal * 100) AS BIGINT) FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1""")
def directory_rollup(spark, d):
    n, r = t(spark, d, "nation"), t(spark, d, "region")
    c = t(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    path = F.concat_ws("/", "r_name", "n_name", F.col("c_custkey").cast("string"))
    x = c.select(F.explode(S.directory_prefixes(path)).alias("directory"), (F.col("c_acctbal") * 100).alias("b"))
    return x.groupBy("directory").agg(F.count("*").alias("files"), F.round(F.sum("b")).cast("long").alias("size"))


def _components(spark: SparkSession, d: str) -> CodeGraph:
    """One component for each supplier but the first of its nation, which the others hold in a box around a leaf."""
    text = lambda k, f: F.when(k == f, F.format_string("export const F%d = () => null;\n", k)).otherwise(F.format_string("import { F%d } from './m%d';\nexport const C%d = () => <Box id={%d}><F%d><Leaf%d kind=\"leaf\" /></F%d></Box>;\n", f, f, k, k, f, k, f))
    return CodeGraph(spark, _module_sources(spark, d, text, lambda k: F.format_string("src/m%d.tsx", k)), "typescript")


@query(f"""WITH u AS ({_uses}) SELECT 'Box' AS tag, NULL AS parent FROM u UNION ALL SELECT 'F' || f, 'Box' FROM u UNION ALL SELECT 'Leaf' || k, 'F' || f FROM u""")
def markup_elements(spark, d):
    g = _components(spark, d)
    up = g.jsx_elements.select(F.col("id").alias("_u"), F.col("name").alias("parent"))
    return g.jsx_elements.join(up, F.col("parent_jsx_element_id") == F.col("_u"), "left").select(F.col("name").alias("tag"), "parent")


@query(f"""WITH u AS ({_uses}) SELECT 'id' AS prop, CAST(k AS VARCHAR) AS value, true AS value_is_expression FROM u UNION ALL SELECT 'kind', '"leaf"', false FROM u""")
def markup_props(spark, d):
    g = _components(spark, d)
    value = F.when(F.col("value_is_expression"), F.col("expression")).otherwise(F.col("value"))
    return g.jsx_props.select(F.col("name").alias("prop"), value.alias("value"), "value_is_expression")


@query(f"SELECT parameter, CAST(pos AS BIGINT) AS pos, count(*) AS n FROM ({_uses}), (SELECT unnest(['first', 'second', 'third']) AS parameter, unnest([0, 1, 2]) AS pos) GROUP BY 1, 2")
def argument_parameters(spark, d):
    text = lambda k, f: F.when(k == f, F.format_string("def f%d(first, second, *, third=3):\n    return first\n", k)).otherwise(F.format_string("from pkg.m%d import f%d\n\n\ndef f%d(x):\n    return f%d(x, %d, third=%d)\n", f, f, k, f, k, f))
    g = CodeGraph(spark, _module_sources(spark, d, text, lambda k: F.format_string("pkg/m%d.py", k)), "python")
    return g.arguments().groupBy("parameter", "pos").agg(F.count("*").alias("n")).select("parameter", F.col("pos").cast("long").alias("pos"), "n")
