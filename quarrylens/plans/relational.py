"""Look-ups, ordered scans and set operations in relational form (J*, W*, U*, A8-A15, 2.10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quarrylens.functions import names, types
from quarrylens.operators.asof import nearest_before
from quarrylens.operators.hierarchy import closure, nearest
from quarrylens.sources.tables import table


# ---------------------------------------------------------------- joins
def unknown_refs_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that issues name and no scan has; the hot file is one row before the join."""
    refs = table(spark, sf_dir, "issues", "filename").where("filename IS NOT NULL").groupBy("filename").agg(F.count("*").alias("n"))
    return refs.join(table(spark, sf_dir, "php_files", F.col("path").alias("filename")), "filename", "left_anti")


def known_refs_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with issues of either tool that the scan has, per project."""
    f = table(spark, sf_dir, "php_files", "path", "case_id").distinct()
    refs = table(spark, sf_dir, "issues", F.col("filename").alias("path")).distinct()
    return f.join(refs, "path", "left_semi").groupBy("case_id").agg(F.count("*").alias("files"))


def guarded_refs_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions of files without an unknown-symbol issue, unless a guard of the same name stands in the project."""
    n = table(spark, sf_dir, "ast_nodes", "path", "node_type", "name").where("name IS NOT NULL AND path IS NOT NULL")
    project = F.split("path", "/")[0]
    fn = n.where("node_type = 'Function'").select("path", project.alias("project"), "name").distinct()
    guards = n.where("node_type = 'InterfaceMethod'").select(project.alias("project"), "name").distinct()
    known = table(spark, sf_dir, "issues", F.col("filename").alias("path"), "code").where("path IS NOT NULL AND code = 'PHPStan.Level0.Symbols'").select("path").distinct()
    return fn.join(known, "path", "left_anti").join(guards, ["project", "name"], "left_anti").groupBy("project").agg(F.count("*").alias("functions"))


def fallback_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects resolve to a declared name exactly, else without regard to case, else not at all."""
    subjects = table(spark, sf_dir, "issues", "subject_name").where("subject_name IS NOT NULL").groupBy("subject_name").agg(F.count("*").alias("n"))
    declared = table(spark, sf_dir, "ast_nodes", "name", "node_type").where("name IS NOT NULL AND node_type IN ('Function', 'InterfaceMethod', 'Constant')").select("name").distinct()
    exact = declared.select(F.col("name").alias("subject_name"), F.col("name").alias("exact"))
    loose = declared.groupBy(F.lower("name").alias("key")).agg(F.min("name").alias("loose"))
    r = subjects.join(exact, "subject_name", "left").withColumn("key", F.lower("subject_name")).join(loose, "key", "left")
    how = F.when(F.col("exact").isNotNull(), "exact").when(F.col("loose").isNotNull(), "case").otherwise("none")
    return r.select("subject_name", "n", F.coalesce("exact", "loose").alias("resolved"), how.alias("how"))


def required_minus_implemented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priorities that a customer never ordered with; the five are an enumeration, so no product of tables."""
    o = table(spark, sf_dir, "orders", F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("priority")).distinct()
    five = F.array(*[F.lit(p) for p in PRIORITIES])
    need = table(spark, sf_dir, "customer", "c_custkey").select("c_custkey", F.explode(five).alias("priority"))
    return need.join(o, ["c_custkey", "priority"], "left_anti")


PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def args_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line numbers an order lacks below its greatest; counted by position, found by anti join."""
    have = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber").distinct()
    want = have.groupBy("l_orderkey").agg(F.max("l_linenumber").alias("m")).select("l_orderkey", F.explode(F.sequence(F.lit(1), F.greatest("m", F.lit(1)))).alias("l_linenumber"))
    return want.join(have, ["l_orderkey", "l_linenumber"], "left_anti")


def hierarchy_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ancestors of each part in the tree of halved keys; key 0 is its own parent."""
    p = table(spark, sf_dir, "part", "p_partkey")
    return closure(p.select("p_partkey", F.floor(F.col("p_partkey") / 2).cast("bigint").alias("parent")), "p_partkey", "parent").select(
        "node", "ancestor", F.col("depth").cast("int").alias("depth"))


def nearest_ancestor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest ancestor of size above 40."""
    p = table(spark, sf_dir, "part", "p_partkey", "p_size")
    pairs = closure(p.select("p_partkey", F.floor(F.col("p_partkey") / 2).cast("bigint").alias("parent")), "p_partkey", "parent")
    return nearest(pairs, p.where("p_size > 40").select("p_partkey"), "p_partkey").select("node", "ancestor", F.col("depth").cast("int").alias("depth"))


def override_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that carry the brand of an ancestor of size above 40."""
    p = table(spark, sf_dir, "part", "p_partkey", "p_size", "p_brand")
    pairs = closure(p.select("p_partkey", F.floor(F.col("p_partkey") / 2).cast("bigint").alias("parent")), "p_partkey", "parent")
    own = p.select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("brand"))
    final = p.where("p_size > 40").select(F.col("p_partkey").alias("ancestor"), F.col("p_brand").alias("brand"))
    return pairs.join(own, "node").join(final, ["ancestor", "brand"]).select("node", "ancestor", "brand")


def asof_hover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each purchase the user's nearest click: seconds back, or seconds ahead and 1000; ties go to the earlier."""
    e = table(spark, sf_dir, "events", "event_id", "user_id", "ts", "event_type")
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    click = F.when(F.col("event_type") == "click", F.struct("ts", "event_id"))
    back = F.last(click, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    ahead = F.first(click, ignorenulls=True).over(w.rowsBetween(1, W.unboundedFollowing))
    e = e.withColumn("b", back).withColumn("a", ahead).where("event_type = 'purchase'")
    sec = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    db, da = sec(F.col("ts")) - sec(F.col("b.ts")), sec(F.col("a.ts")) - sec(F.col("ts")) + 1000
    pick = F.when(F.col("a").isNull() | (F.col("b").isNotNull() & (db <= da)), F.col("b.event_id")).otherwise(F.col("a.event_id"))
    return e.select(F.col("event_id").alias("purchase_id"), pick.alias("click_id"))


def issue_enclosing_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The function whose line is nearest before each issue in its file.

    Issues meet by (file, line), so the rows of the hot file shrink to its
    lines before they are sorted.
    """
    i = table(spark, sf_dir, "issues", F.col("filename").alias("path"), "line").where("path IS NOT NULL AND line IS NOT NULL").groupBy("path", "line").agg(F.count("*").alias("n"))
    fn = table(spark, sf_dir, "ast_nodes", "path", "line", "name", "node_type").where("node_type = 'Function' AND line IS NOT NULL AND name IS NOT NULL")
    fn = fn.groupBy("path", "line").agg(F.min("name").alias("name"))
    return nearest_before(i, fn, "path", "line", "name").where("name IS NOT NULL").groupBy("path", "name").agg(F.sum("n").alias("n"))


# ---------------------------------------------------------------- ordered scans
def running_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth (+1 a click, -1 a purchase) of each user, reset at each signup."""
    e = table(spark, sf_dir, "events", "event_id", "user_id", "ts", "event_type")
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    e = e.withColumn("session", F.sum(F.when(F.col("event_type") == "signup", 1).otherwise(0)).over(w))
    step = F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "purchase", -1).otherwise(0)
    s = W.partitionBy("user_id", "session").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    return e.select("event_id", "session", F.sum(step).over(s).alias("depth"))


def unreachable_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user after the first error."""
    e = table(spark, sf_dir, "events", "event_id", "user_id", "ts", "event_type")
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, -1)
    return e.withColumn("ended", F.max(F.when(F.col("event_type") == "error", 1).otherwise(0)).over(w)).where("ended = 1").select("event_id", "user_id")


def ordering_violation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks of a user after a purchase."""
    e = table(spark, sf_dir, "events", "event_id", "user_id", "ts", "event_type")
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, -1)
    seen = F.max(F.when(F.col("event_type") == "purchase", 1).otherwise(0)).over(w)
    return e.withColumn("seen", seen).where("event_type = 'click' AND seen = 1").groupBy("user_id").agg(F.count("*").alias("violations"))


# ---------------------------------------------------------------- grouping
def param_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters of each function: their number, the nullable ones, whether one is an array."""
    n = table(spark, sf_dir, "ast_nodes", "node_id", "node_type", "params").where("node_type IN ('Function', 'InterfaceMethod') AND params IS NOT NULL").dropDuplicates(["node_id"])
    nullable = F.size(F.filter("params", lambda p: F.contains(p["type"], F.lit("null")) | F.startswith(p["type"], F.lit("?"))))
    return n.select("node_id", F.size("params").cast("bigint").alias("n_params"), nullable.cast("bigint").alias("n_nullable"),
                    F.exists("params", lambda p: F.coalesce(p["type"] == "array", F.lit(False))).alias("has_array"))


def enum_duplicate_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """String values that several constants of a file share."""
    n = table(spark, sf_dir, "ast_nodes", "path", "node_type", "name", "str_value").where("node_type = 'Constant' AND str_value IS NOT NULL AND name IS NOT NULL")
    return n.groupBy("path", "str_value").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("names")).where(F.contains(F.col("names"), F.lit(",")))


def return_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each return type is declared, and in how many files."""
    n = table(spark, sf_dir, "ast_nodes", "path", "node_type", "return_type").where("node_type IN ('Function', 'InterfaceMethod')")
    return n.groupBy("node_type", "return_type").agg(F.count("*").alias("n"), F.countDistinct("path").alias("files"))


def any_all_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with both declarations and string literals (both flags in one pass)."""
    n = table(spark, sf_dir, "ast_nodes", "path", "node_type").where("path IS NOT NULL")
    g = n.groupBy("path").agg(F.bool_or(F.col("node_type").isin("Function", "InterfaceMethod")).alias("declares"), F.bool_or(F.col("node_type") == "StringLiteral").alias("effects"))
    return g.where("declares AND effects").select("path")


def hot_codes_by_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct files and issues per project and tool."""
    i = table(spark, sf_dir, "issues", "tool", "filename").where("filename IS NOT NULL")
    per = i.groupBy("tool", "filename").agg(F.count("*").alias("n"))
    return per.groupBy("tool", F.split("filename", "/")[0].alias("project")).agg(F.count("*").alias("files"), F.sum("n").alias("issues"))


# ---------------------------------------------------------------- sets and scalars
def symbol_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names declared as functions only, as interface methods only, or as both, per project."""
    n = table(spark, sf_dir, "ast_nodes", "path", "node_type", "name").where("name IS NOT NULL AND path IS NOT NULL")
    g = n.groupBy(F.split("path", "/")[0].alias("project"), "name").agg(F.bool_or(F.col("node_type") == "Function").alias("f"), F.bool_or(F.col("node_type") == "InterfaceMethod").alias("m"))
    return g.groupBy("project").agg(F.count_if(F.col("f") & ~F.col("m")).alias("functions_only"), F.count_if(F.col("m") & ~F.col("f")).alias("methods_only"), F.count_if(F.col("f") & F.col("m")).alias("both"))


def name_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.10 names: index key, Pascal and camel case, unqualified name of part names."""
    n = F.regexp_replace("p_name", " ", "_")
    return table(spark, sf_dir, "part", "p_partkey", "p_name").select(
        "p_partkey", names.index_key(n).alias("index_key"), names.pascal_case(n).alias("pascal"), names.camel_case(n).alias("camel"),
        names.unqualified(F.regexp_replace("p_name", " ", "\\\\")).alias("last"))


def type_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.10 types: declared types as sorted distinct atoms, with the null atom apart."""
    n = table(spark, sf_dir, "ast_nodes", "return_type").where("return_type IS NOT NULL").groupBy("return_type").agg(F.count("*").alias("n"))
    atoms = types.atoms(F.col("return_type"))
    return n.select("return_type", "n", F.array_join(atoms, "|").alias("atoms"), F.array_contains(atoms, "null").alias("nullable"))


def type_accepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a parameter's declared type accepts its documented function's return type (forall over exists)."""
    n = table(spark, sf_dir, "ast_nodes", "return_type", "params").where("return_type IS NOT NULL AND params IS NOT NULL")
    p = n.select("return_type", F.explode("params").alias("p")).where("p.type IS NOT NULL").groupBy("return_type", F.col("p.type").alias("param_type")).agg(F.count("*").alias("n"))
    return p.withColumn("accepted", types.accepts(types.atoms(F.col("param_type")), types.atoms(F.col("return_type"))))


def visibility_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks of order priorities, and orders ranked above their customer's usual one."""
    rank = F.substring("o_orderpriority", 1, 1).cast("int")
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderpriority").withColumn("rank", rank)
    usual = o.groupBy("o_custkey").agg(F.max("rank").alias("usual"))
    return o.join(usual, "o_custkey").where("rank < usual").groupBy("rank", "usual").agg(F.count("*").alias("n"))


def template_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.10 generics: words of part names replaced through a binding map."""
    binding = F.create_map(*[F.lit(x) for kv in BINDINGS.items() for x in kv])
    words = F.transform(F.split("p_name", " "), lambda w: F.coalesce(binding[w], w))
    return table(spark, sf_dir, "part", "p_partkey", "p_name").select("p_partkey", F.array_join(words, " ").alias("bound"))


BINDINGS = {"blue": "T1", "green": "T2", "small": "K"}


def project_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.10 paths: project, top directory and base name of every path."""
    p = table(spark, sf_dir, "php_files", "path").distinct()
    parts = F.split("path", "/")
    return p.select("path", parts[0].alias("project"), F.when(F.size(parts) > 2, parts[1]).otherwise("").alias("top"), F.element_at(parts, -1).alias("base"))


def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5: a JSON property of events, aggregated."""
    e = table(spark, sf_dir, "events", "event_type", "props")
    k = F.get_json_object("props", "$.k").cast("bigint")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("total"), F.max(k).alias("most"))


QUERIES = {f.__name__: f for f in (
    unknown_refs_anti, known_refs_semi, guarded_refs_anti, fallback_resolution, required_minus_implemented, args_match, hierarchy_closure, nearest_ancestor,
    override_conflict, asof_hover, issue_enclosing_function, running_depth, unreachable_events, ordering_violation, param_bounds, enum_duplicate_values,
    return_histogram, any_all_flags, hot_codes_by_project, symbol_sets, name_normalise, type_split, type_accepts, visibility_case, template_binding,
    project_name, json_props)}
_TREE = """WITH RECURSIVE c AS (SELECT p_partkey AS node, p_partkey // 2 AS ancestor, 1 AS depth FROM part WHERE p_partkey > 0
  UNION ALL SELECT node, ancestor // 2, depth + 1 FROM c WHERE ancestor > 0)"""
_ATOMS = "list_sort(list_distinct(list_filter(string_split(CASE WHEN starts_with({0}, '?') THEN 'null|' || substr({0}, 2) ELSE {0} END, '|'), lambda x: x <> '')))"
ORACLE = {
    "unknown_refs_anti": "SELECT filename, count(*) AS n FROM issues WHERE filename IS NOT NULL AND filename NOT IN (SELECT path FROM php_files WHERE path IS NOT NULL) GROUP BY filename",
    "known_refs_semi": "SELECT case_id, count(DISTINCT path) AS files FROM php_files WHERE path IN (SELECT filename FROM issues) GROUP BY case_id",
    "guarded_refs_anti": """WITH n AS (SELECT DISTINCT path, split_part(path, '/', 1) AS project, node_type, name FROM ast_nodes WHERE name IS NOT NULL AND path IS NOT NULL)
SELECT project, count(*) AS functions FROM n f WHERE node_type = 'Function' AND NOT EXISTS (SELECT 1 FROM issues i WHERE i.filename = f.path AND i.code = 'PHPStan.Level0.Symbols')
AND NOT EXISTS (SELECT 1 FROM n g WHERE g.node_type = 'InterfaceMethod' AND g.project = f.project AND g.name = f.name) GROUP BY project""",
    "fallback_resolution": """WITH s AS (SELECT subject_name, count(*) AS n FROM issues WHERE subject_name IS NOT NULL GROUP BY 1),
d AS (SELECT DISTINCT name FROM ast_nodes WHERE name IS NOT NULL AND node_type IN ('Function', 'InterfaceMethod', 'Constant')), l AS (SELECT lower(name) AS key, min(name) AS loose FROM d GROUP BY 1)
SELECT subject_name, n, coalesce(d.name, loose) AS resolved, CASE WHEN d.name IS NOT NULL THEN 'exact' WHEN loose IS NOT NULL THEN 'case' ELSE 'none' END AS how
FROM s LEFT JOIN d ON d.name = subject_name LEFT JOIN l ON key = lower(subject_name)""",
    "required_minus_implemented": f"""SELECT c_custkey, priority FROM customer, (SELECT unnest({list(PRIORITIES)}) AS priority)
WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = priority)""",
    "args_match": """WITH h AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem), w AS (SELECT l_orderkey, unnest(generate_series(1, greatest(max(l_linenumber), 1))) AS k FROM h GROUP BY 1)
SELECT l_orderkey, CAST(k AS INTEGER) AS l_linenumber FROM w WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.l_orderkey = w.l_orderkey AND h.l_linenumber = k)""",
    "hierarchy_closure": _TREE + " SELECT node, CAST(ancestor AS BIGINT) AS ancestor, depth FROM c",
    "nearest_ancestor": _TREE + """ SELECT node, CAST(ancestor AS BIGINT) AS ancestor, depth FROM c JOIN part ON p_partkey = ancestor WHERE p_size > 40
QUALIFY row_number() OVER (PARTITION BY node ORDER BY depth, ancestor) = 1""",
    "override_conflict": _TREE + """ SELECT node, CAST(ancestor AS BIGINT) AS ancestor, a.p_brand AS brand FROM c JOIN part a ON a.p_partkey = ancestor JOIN part o ON o.p_partkey = node
WHERE a.p_size > 40 AND a.p_brand = o.p_brand""",
    "asof_hover": """WITH e AS (SELECT *, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER b AS bid, last_value(CASE WHEN event_type = 'click' THEN ts END IGNORE NULLS) OVER b AS bts,
  first_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER a AS aid, first_value(CASE WHEN event_type = 'click' THEN ts END IGNORE NULLS) OVER a AS ats FROM events
  WINDOW b AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
SELECT event_id AS purchase_id, CASE WHEN aid IS NULL OR (bid IS NOT NULL AND epoch_us(ts) / 1e6 - epoch_us(bts) / 1e6 <= epoch_us(ats) / 1e6 - epoch_us(ts) / 1e6 + 1000) THEN bid ELSE aid END AS click_id
FROM e WHERE event_type = 'purchase'""",
    "issue_enclosing_function": """WITH i AS (SELECT filename AS path, line, count(*) AS n FROM issues WHERE filename IS NOT NULL AND line IS NOT NULL GROUP BY 1, 2),
f AS (SELECT path, line, min(name) AS name FROM ast_nodes WHERE node_type = 'Function' AND line IS NOT NULL AND name IS NOT NULL GROUP BY 1, 2)
SELECT i.path, f.name, CAST(sum(n) AS BIGINT) AS n FROM i ASOF JOIN f ON i.path = f.path AND i.line >= f.line GROUP BY 1, 2""",
    "running_depth": """WITH s AS (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM events)
SELECT event_id, CAST(session AS BIGINT) AS session, CAST(sum(CASE event_type WHEN 'click' THEN 1 WHEN 'purchase' THEN -1 ELSE 0 END) OVER (PARTITION BY user_id, session ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS depth FROM s""",
    "unreachable_events": """SELECT event_id, user_id FROM (SELECT *, max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id
ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ended FROM events) WHERE ended = 1""",
    "ordering_violation": """SELECT user_id, count(*) AS violations FROM (SELECT *, max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id
ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM events) WHERE event_type = 'click' AND seen = 1 GROUP BY user_id""",
    "param_bounds": """SELECT DISTINCT ON (node_id) node_id, len(params) AS n_params, len(list_filter(params, lambda p: contains(p.type, 'null') OR starts_with(p.type, '?'))) AS n_nullable,
  len(list_filter(params, lambda p: p.type = 'array')) > 0 AS has_array FROM ast_nodes WHERE node_type IN ('Function', 'InterfaceMethod') AND params IS NOT NULL""",
    "enum_duplicate_values": """SELECT path, str_value, array_to_string(list_sort(list(DISTINCT name)), ',') AS names FROM ast_nodes WHERE node_type = 'Constant' AND str_value IS NOT NULL AND name IS NOT NULL
GROUP BY path, str_value HAVING count(DISTINCT name) > 1""",
    "return_histogram": "SELECT node_type, return_type, count(*) AS n, count(DISTINCT path) AS files FROM ast_nodes WHERE node_type IN ('Function', 'InterfaceMethod') GROUP BY 1, 2",
    "any_all_flags": "SELECT path FROM ast_nodes WHERE path IS NOT NULL GROUP BY path HAVING bool_or(node_type IN ('Function', 'InterfaceMethod')) AND bool_or(node_type = 'StringLiteral')",
    "hot_codes_by_project": "SELECT tool, split_part(filename, '/', 1) AS project, count(DISTINCT filename) AS files, count(*) AS issues FROM issues WHERE filename IS NOT NULL GROUP BY 1, 2",
    "symbol_sets": """WITH g AS (SELECT split_part(path, '/', 1) AS project, name, bool_or(node_type = 'Function') AS f, bool_or(node_type = 'InterfaceMethod') AS m FROM ast_nodes
  WHERE name IS NOT NULL AND path IS NOT NULL GROUP BY 1, 2)
SELECT project, count(*) FILTER (WHERE f AND NOT m) AS functions_only, count(*) FILTER (WHERE m AND NOT f) AS methods_only, count(*) FILTER (WHERE f AND m) AS both FROM g GROUP BY project""",
    "name_normalise": """WITH w AS (SELECT p_partkey, p_name, replace(p_name, ' ', '_') AS n, list_transform(string_split(p_name, ' '), lambda x: upper(left(x, 1)) || substr(x, 2)) AS parts FROM part),
p AS (SELECT *, array_to_string(parts, '') AS pascal FROM w)
SELECT p_partkey, lower(n) AS index_key, pascal, lower(left(pascal, 1)) || substr(pascal, 2) AS camel, list_extract(string_split(p_name, ' '), -1) AS last FROM p""",
    "type_split": f"""WITH n AS (SELECT return_type, count(*) AS n FROM ast_nodes WHERE return_type IS NOT NULL GROUP BY 1), a AS (SELECT *, {_ATOMS.format('return_type')} AS l FROM n)
SELECT return_type, n, array_to_string(l, '|') AS atoms, list_contains(l, 'null') AS nullable FROM a""",
    "type_accepts": f"""WITH p AS (SELECT return_type, p.type AS param_type, count(*) AS n FROM (SELECT return_type, unnest(params) AS p FROM ast_nodes WHERE return_type IS NOT NULL AND params IS NOT NULL)
  WHERE p.type IS NOT NULL GROUP BY 1, 2), a AS (SELECT *, {_ATOMS.format('param_type')} AS d, {_ATOMS.format('return_type')} AS x FROM p),
u AS (SELECT *, unnest(CASE WHEN len(x) = 0 THEN [''] ELSE x END) AS atom FROM a)
SELECT return_type, param_type, n, bool_and(len(d) = 0 OR len(x) = 0 OR list_contains(d, 'mixed') OR list_contains(x, 'mixed') OR list_contains(d, atom) OR (atom = 'int' AND list_contains(d, 'float'))
  OR (atom = 'null' AND list_contains(d, 'void')) OR (atom IN ('true', 'false') AND list_contains(d, 'bool')) OR (atom = 'array' AND list_contains(d, 'iterable'))
  OR (list_contains(d, 'object') AND atom NOT IN ({', '.join(repr(b) for b in sorted(types.BUILTINS))}))) AS accepted FROM u GROUP BY 1, 2, 3""",
    "visibility_case": """WITH o AS (SELECT *, CAST(left(o_orderpriority, 1) AS INTEGER) AS rank FROM orders), u AS (SELECT *, max(rank) OVER (PARTITION BY o_custkey) AS usual FROM o)
SELECT rank, usual, count(*) AS n FROM u WHERE rank < usual GROUP BY 1, 2""",
    "template_binding": """SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: CASE w """ + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in BINDINGS.items()) + """ ELSE w END), ' ') AS bound FROM part""",
    "project_name": """SELECT DISTINCT path, split_part(path, '/', 1) AS project, CASE WHEN len(string_split(path, '/')) > 2 THEN split_part(path, '/', 2) ELSE '' END AS top,
list_extract(string_split(path, '/'), -1) AS base FROM php_files""",
    "json_props": "SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total, max(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS most FROM events GROUP BY 1",
}
