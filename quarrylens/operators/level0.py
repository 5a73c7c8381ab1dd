"""Cross-file analysis as relational work over facts (J1-J4, J10, J13, J16, J17, W1, 2.7).

Each project is a world of its own: names of symbols carry their project, so
one repository never answers for another and every join is keyed by project
and name. Facts are written once to the checkpoint folder, then every rule is a
filter and a join. The language's own names are a literal table; references to
them are taken out by a broadcast of that table before anything is shuffled.
"""

from __future__ import annotations

import json
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.operators.hierarchy import closure
from quarrylens.operators.php_tables import facts, php_files
from quarrylens.php.builtins import CLASSES, FUNCTIONS
from quarrylens.session import checkpointed
from quarrylens.sources.tables import table

SYMBOLS, MODEL, INVOCATION = "PHPStan.Level0.Symbols", "PHPStan.Level0.ClassModel", "PHPStan.Level0.Invocation"


#: Stands between a project and a name.
SEP = "\x1f"
#: Kinds of facts whose `key`, and whose `alt`, name classes or functions.
_SYMBOL_KEYS = ("decl_class", "decl_function", "edge", "ref_class", "new", "call", "subtype")
_SYMBOL_ALTS = ("decl_method", "edge", "this_call", "static_call", "const_fetch", "decl_const", "this_property", "decl_property", "call")
#: Ways to a parent in order of how little they hand down: a subclass is also bound by final, a trait's user is no subtype (fixed values).
ROLES = {"extends": 0, "implements": 1, "uses": 2}


def bare(name):
    """The name without its project."""
    return F.substring_index(name, SEP, -1)


def scoped(rows: DataFrame) -> DataFrame:
    """Facts with the project put before each name of a class or function."""
    def put(c, kinds):
        named = F.col("kind").isin(*kinds) if kinds else F.lit(True)
        return F.when(named & F.col(c).isNotNull() & ~F.col(c).isin("self", "static", "parent"), F.concat("project", F.lit(SEP), c)).otherwise(F.col(c))

    guard = (F.col("kind") == "guard") & F.col("name").isin("class_exists", "interface_exists", "function_exists")
    alternatives = F.array_join(F.transform(F.split("alt", r"\|"), lambda v: F.concat(F.col("project"), F.lit(SEP), v)), "|")
    return (rows.withColumn("cls", put("cls", ())).withColumn("key", F.when(guard, F.concat("project", F.lit(SEP), "key")).otherwise(put("key", _SYMBOL_KEYS)))
            .withColumn("alt", F.when(F.col("kind") == "subtype", alternatives).otherwise(put("alt", _SYMBOL_ALTS))))


class Index:
    """The symbol catalogue of a corpus by project: declarations first to last, with the language's own."""

    def __init__(self, spark: SparkSession, rows: DataFrame, files: DataFrame):
        self.spark, self.files = spark, files
        self.rows = rows = checkpointed(scoped(rows))
        own = rows.where("kind = 'decl_class' AND name IS NOT NULL").select("key", "name", F.col("extra").alias("kind"), "flags", "path", "line", "file_id", F.lit(False).alias("builtin"))
        self.projects = rows.where("kind <> 'issue'").select("project").distinct()
        native = self._native([(k.lower(), k, kind) for k, (kind, _) in CLASSES.items()], "key string, name string, kind string").select(
            "key", "name", "kind", *(F.lit(None).cast(t).alias(c) for c, t in (("flags", "string"), ("path", "string"), ("line", "int"), ("file_id", "long"))), F.lit(True).alias("builtin"))
        # The language's class wins, then the first by path and line; later ones are duplicates.
        order = F.struct(~F.col("builtin"), F.coalesce("path", F.lit("")), F.coalesce("line", F.lit(0)), F.coalesce("file_id", F.lit(0)))
        self.classes = checkpointed(own.unionByName(native).groupBy("key").agg(
            F.min_by(F.struct("name", "kind", "flags", "path", "line", "file_id", "builtin"), order).alias("c")).select("key", "c.*"))
        # Members and parents are those of the declaration that won.
        won = self.classes.where("NOT builtin").select(F.col("key").alias("cls"), "file_id")
        self.methods = checkpointed(rows.where("kind = 'decl_method'").withColumnRenamed("cls", "inside").withColumnRenamed("alt", "cls").join(won, ["cls", "file_id"]).groupBy("cls", "key").agg(
            F.min_by(F.struct("name", "low", "high", "flags", "extra"), F.struct("line")).alias("m")).select("cls", "key", "m.*"))
        functions = rows.where("kind = 'decl_function'").groupBy("key").agg(F.min_by(F.struct("low", "high"), F.struct("path", "line")).alias("f")).select("key", "f.*")
        self.functions = functions.unionByName(self._native([(k, a, b) for k, (a, b) in FUNCTIONS.items()], "key string, low int, high int")).groupBy("key").agg(
            F.min("low").alias("low"), F.when(F.min("high") < 0, -1).otherwise(F.max("high")).alias("high"))
        edges = rows.where("kind = 'edge'").join(won.withColumnRenamed("cls", "key"), ["key", "file_id"]).select("key", "alt", F.col("name").alias("role")).distinct()
        native_edges = self._native([(k.lower(), p.lower()) for k, (_, p) in CLASSES.items() if p], "key string, alt string", "alt").withColumn("role", F.lit("extends"))
        self.edges = edges.unionByName(native_edges).withColumn("rank", F.coalesce(*(F.when(F.col("role") == r, n) for r, n in ROLES.items()), F.lit(2)))
        self.lineage = closure(self.edges, "key", "alt", rank="rank")

    def _native(self, rows: list[tuple], schema: str, *more: str) -> DataFrame:
        """Rows of the language's own catalogue, a copy for each project that has facts (so, a few hundred rows each)."""
        names = [c.split()[0] for c in schema.split(", ")]
        table = F.from_json(F.lit(json.dumps([dict(zip(names, r)) for r in rows])), f"array<struct<{', '.join(c.replace(' ', ': ') for c in schema.split(', '))}>>")
        df = self.projects.select("project", F.explode(table).alias("t")).select("project", "t.*")
        for c in ("key", *more):
            df = df.withColumn(c, F.concat("project", F.lit(SEP), c))
        return df.drop("project")

    def guards(self, *functions: str) -> DataFrame:
        """(file_id, key) of what a file asks for by one of `functions`."""
        return self.rows.where((F.col("kind") == "guard") & F.col("name").isin(*functions)).select("file_id", "key").distinct()

    @cached_property
    def _open(self) -> DataFrame:
        return checkpointed(self._open_classes())

    def open_classes(self) -> DataFrame:
        return self._open

    @cached_property
    def members(self) -> DataFrame:
        """All methods a class has, its own and inherited; several rules ask for them, so they are written once."""
        return checkpointed(self.lookup(self.methods))

    def _open_classes(self) -> DataFrame:
        """Classes about which not everything is known: an ancestor is unknown, or calls are caught by magic methods."""
        unknown = self.lineage.join(self.classes.select(F.col("key").alias("ancestor")), "ancestor", "left_anti").select(F.col("node").alias("cls"))
        magic = self.methods.where("key IN ('__call', '__callstatic', '__get')").select("cls")
        heirs = self.lineage.join(magic.withColumnRenamed("cls", "ancestor"), "ancestor").select(F.col("node").alias("cls"))
        native = self.lineage.join(self.classes.where("builtin").select(F.col("key").alias("ancestor")), "ancestor").select(F.col("node").alias("cls"))
        return unknown.union(magic).union(heirs).union(native).distinct()

    def lookup(self, declared: DataFrame) -> DataFrame:
        """Members of each class and its ancestors, the nearest first: (cls, key, ...)."""
        inherited = declared.withColumnRenamed("cls", "ancestor").join(self.lineage, "ancestor").select(F.col("node").alias("cls"), "key", "name", "low", "high", "flags", "depth")
        all_ = declared.select("cls", "key", "name", "low", "high", "flags", F.lit(0).alias("depth")).unionByName(inherited)
        return all_.groupBy("cls", "key").agg(F.min_by(F.struct("name", "low", "high", "flags"), "depth").alias("m")).select("cls", "key", "m.*")


def _issue(df: DataFrame, code: str, message) -> DataFrame:
    return df.select("file_id", F.col("path").alias("filename"), "line", "col", F.lit("ERROR").alias("type"), F.lit(False).alias("fixable"), message.alias("message"), F.lit(code).alias("code"))


def unknown_classes(x: Index) -> DataFrame:
    """Class references that no declaration answers, not guarded in their file."""
    refs = x.rows.where("kind = 'ref_class' AND key NOT IN ('self', 'static', 'parent')")
    known = x.classes.select("key")
    # A name also resolves to the language's class by its last part; the language's are a bounded list, so they go before the shuffle.
    short = F.element_at(F.split(bare(F.col("key")), r"\\"), -1)
    refs = refs.where(~short.isin(*(k.lower() for k in CLASSES)))
    bad = refs.join(known, "key", "left_anti").join(x.guards("class_exists", "interface_exists"), ["file_id", "key"], "left_anti")
    return _issue(bad, SYMBOLS, F.concat(F.lit("Class "), "name", F.lit(" is not known ("), "extra", F.lit(")")))


def unknown_functions(x: Index) -> DataFrame:
    """Calls whose name is no function, neither globally nor in the namespace."""
    calls = x.rows.where("kind = 'call'")
    known = x.functions.select("key")
    guards = x.guards("function_exists").withColumnRenamed("key", "alt")
    bad = calls.join(known, "key", "left_anti").join(known.withColumnRenamed("key", "alt"), "alt", "left_anti").join(guards, ["file_id", "alt"], "left_anti")
    return _issue(bad, SYMBOLS, F.concat(F.lit("Function "), "name", F.lit(" is not known")))


def _wrong_count(df: DataFrame):
    n = F.col("n")
    return df.where(F.col("flags").isNull() & ((n < F.col("least")) | ((F.col("most") >= 0) & (n > F.col("most")))))


def _count_message():
    most = F.when(F.col("most") < 0, F.lit("more")).otherwise(F.col("most").cast("string"))
    return F.concat(F.lit("Call of "), "name", F.lit(" with "), "n", F.lit(" arguments, "), "least", F.lit(" to "), most, F.lit(" fit"))


def function_arguments(x: Index) -> DataFrame:
    """Calls of functions with too few or too many arguments."""
    calls = x.rows.where("kind = 'call'").select("file_id", "path", "line", "col", "name", "key", "alt", F.col("low").alias("n"), "flags")
    f = x.functions.select("key", F.col("low").alias("least"), F.col("high").alias("most"))
    exact = calls.join(f, "key")
    other = calls.join(x.functions.select("key"), "key", "left_anti").join(f.withColumnRenamed("key", "alt"), "alt")
    return _issue(_wrong_count(exact.unionByName(other, allowMissingColumns=True)), INVOCATION, _count_message())


def this_calls(x: Index) -> DataFrame:
    """Calls on $this of methods that the class and its ancestors lack, or with arguments that do not fit."""
    calls = x.rows.where("kind = 'this_call'").select("file_id", "path", "line", "col", "name", "key", F.col("alt").alias("cls"), F.col("low").alias("n"), "flags")
    calls = calls.join(x.open_classes(), "cls", "left_anti").join(x.rows.where("kind = 'decl_class' AND extra <> 'trait'").select(F.col("key").alias("cls")).distinct(), "cls", "left_semi")
    m = x.members.select("cls", "key", F.col("low").alias("least"), F.col("high").alias("most"))
    undefined = calls.join(m, ["cls", "key"], "left_anti").join(x.guards("method_exists"), ["file_id", "key"], "left_anti")
    return _issue(undefined, SYMBOLS, F.concat(F.lit("Method "), "name", F.lit(" is not defined in "), bare("cls"))).unionByName(
        _issue(_wrong_count(calls.join(m, ["cls", "key"])), INVOCATION, _count_message()))


def static_members(x: Index) -> DataFrame:
    """Static calls and class constants that the class and its ancestors lack."""
    hidden = x.open_classes()
    known = x.classes.where("NOT builtin").select(F.col("key").alias("cls"))
    m = x.members.select("cls", "key")
    calls = x.rows.where("kind = 'static_call'").withColumn("owner", F.col("alt")).drop("cls").withColumnRenamed("alt", "cls")
    bad = calls.join(known, "cls", "left_semi").join(hidden, "cls", "left_anti").join(m, ["cls", "key"], "left_anti").join(x.guards("method_exists"), ["file_id", "key"], "left_anti")
    consts = x.rows.where("kind = 'decl_const'").select("cls", "key", "name", "low", "high", "flags")
    c = x.lookup(consts).select("cls", "key")
    fetch = x.rows.where("kind = 'const_fetch'").drop("cls").withColumnRenamed("alt", "cls")
    missing = fetch.join(known, "cls", "left_semi").join(hidden, "cls", "left_anti").join(c, ["cls", "key"], "left_anti")
    return _issue(bad, SYMBOLS, F.concat(F.lit("Static method "), "name", F.lit(" is not defined in "), bare("cls"))).unionByName(
        _issue(missing, SYMBOLS, F.concat(F.lit("Constant "), "name", F.lit(" is not defined in "), bare("cls"))))


def this_properties(x: Index) -> DataFrame:
    """Properties of $this that the class and its ancestors lack."""
    uses = x.rows.where("kind = 'this_property'").drop("cls").withColumnRenamed("alt", "cls")
    declared = x.rows.where("kind = 'decl_property'").select("cls", "key", "name", "low", "high", "flags")
    own = x.lookup(declared).select("cls", "key")
    bad = uses.join(x.open_classes(), "cls", "left_anti").join(own, ["cls", "key"], "left_anti").join(x.rows.where("kind = 'decl_class' AND extra = 'class'").select(F.col("key").alias("cls")).distinct(), "cls", "left_semi")
    return _issue(bad, SYMBOLS, F.concat(F.lit("Property "), "name", F.lit(" is not defined in "), bare("cls")))


def duplicates(x: Index) -> DataFrame:
    """Second and later declarations of a class in a project. The first comes from a hash aggregate, so a name with many copies is in no one task."""
    d = x.rows.where("kind = 'decl_class' AND name IS NOT NULL")
    place = F.struct("path", "line", "file_id", "col")
    first = d.groupBy("key").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    return _issue(d.join(first, "key").where(place > F.col("first")), MODEL, F.concat(F.lit("Class "), "name", F.lit(" is declared before")))


def heritage(x: Index) -> DataFrame:
    """Parents of the wrong kind: final or no class to extend, no interface to implement, no trait to use."""
    e = x.rows.where("kind = 'edge'").select("file_id", "path", "line", "col", F.col("name").alias("role"), "key", F.col("alt").alias("target"), F.col("extra").alias("own_kind"))
    c = x.classes.select(F.col("key").alias("target"), F.col("kind").alias("target_kind"), F.col("flags").alias("target_flags"))
    e = e.join(c, "target")
    final = F.contains(F.concat(F.lit(" "), F.coalesce("target_flags", F.lit("")), F.lit(" ")), F.lit(" final "))
    wrong = (F.when((F.col("role") == "extends") & (F.col("own_kind") == "class") & (F.col("target_kind") != "class"), "is no class to extend")
             .when((F.col("role") == "extends") & (F.col("own_kind") == "class") & final, "is final")
             .when((F.col("role") == "extends") & (F.col("own_kind") == "interface") & (F.col("target_kind") != "interface"), "is no interface to extend")
             .when((F.col("role") == "implements") & (F.col("target_kind") != "interface"), "is no interface")
             .when((F.col("role") == "uses") & (F.col("target_kind") != "trait"), "is no trait"))
    return _issue(e.withColumn("wrong", wrong).where("wrong IS NOT NULL"), MODEL, F.concat(bare("target"), F.lit(" "), "wrong"))


def final_overrides(x: Index) -> DataFrame:
    """Methods that a final method of a parent class forbids; a used trait's methods may be replaced, private ones too but for constructors."""
    own = x.rows.where("kind = 'decl_method'").select("file_id", "path", "line", "col", "name", "key", F.col("alt").alias("cls"))
    final = x.methods.where("concat(' ', flags, ' ') LIKE '% final %' AND (key = '__construct' OR concat(' ', flags, ' ') NOT LIKE '% private %')").select(F.col("cls").alias("ancestor"), "key")
    parents = x.lineage.where(F.col("rank") == ROLES["extends"]).withColumnRenamed("node", "cls")
    hit = own.join(parents, "cls").join(final, ["ancestor", "key"]).groupBy("file_id", "path", "line", "col", "name").agg(F.min_by("ancestor", F.struct("depth", "ancestor")).alias("ancestor"))
    return _issue(hit, MODEL, F.concat(F.lit("Method "), "name", F.lit(" is final in "), bare("ancestor")))


def required_methods(x: Index) -> DataFrame:
    """Abstract methods of ancestors that a concrete class leaves open."""
    concrete = x.rows.where("kind = 'decl_class' AND extra = 'class' AND NOT coalesce(concat(' ', flags, ' ') LIKE '% abstract %', false)").select("file_id", "path", "line", "col", "key").join(
        x.open_classes().withColumnRenamed("cls", "key"), "key", "left_anti")
    m = x.methods.withColumn("open", F.expr("concat(' ', flags, ' ') LIKE '% abstract %' OR concat(' ', flags, ' ') LIKE '% interface %'"))
    need = m.where("open").select(F.col("cls").alias("ancestor"), F.col("key").alias("method"), "name")
    need = concrete.join(x.lineage.withColumnRenamed("node", "key"), "key").join(need, "ancestor")
    have = m.where("NOT open").select("cls", F.col("key").alias("method"))
    inherited = have.withColumnRenamed("cls", "ancestor").join(x.lineage, "ancestor").select(F.col("node").alias("cls"), "method")
    have = have.unionByName(inherited).distinct().withColumnRenamed("cls", "key")
    missing = need.join(have, ["key", "method"], "left_anti").dropDuplicates(["file_id", "key", "method"])
    return _issue(missing, MODEL, F.concat(F.lit("Method "), "name", F.lit(" is required by "), bare("ancestor")))


def instantiation(x: Index) -> DataFrame:
    """New of something that has no instances."""
    n = x.rows.where("kind = 'new'").join(x.classes.select("key", F.col("kind").alias("k"), F.col("flags").alias("f")), "key")
    bad = n.where("k <> 'class' OR concat(' ', f, ' ') LIKE '% abstract %'")
    return _issue(bad, MODEL, F.concat(F.lit("No instance can be made of "), "name"))


def constructors(x: Index) -> DataFrame:
    """Instances made with arguments that the constructor does not take, or by strangers of a private one."""
    new = x.rows.where("kind = 'new'").select("file_id", "path", "line", "col", "name", F.col("key").alias("made"), F.col("low").alias("n"), "flags", F.col("cls").alias("caller"))
    ctor = x.members.where("key = '__construct'").select(F.col("cls").alias("made"), F.col("low").alias("least"), F.col("high").alias("most"), F.col("flags").alias("ctor_flags"))
    calls = new.join(x.open_classes().withColumnRenamed("cls", "made"), "made", "left_anti").join(ctor, "made")
    hidden = calls.where("concat(' ', ctor_flags, ' ') LIKE '% private %' AND coalesce(caller, '') <> made")
    return _issue(_wrong_count(calls), "A.ARG.COUNT", _count_message()).unionByName(_issue(hidden, INVOCATION, F.concat(F.lit("The constructor of "), "name", F.lit(" is private"))))


def static_to_instance(x: Index) -> DataFrame:
    """Static calls of instance methods from outside the class's own line."""
    m = x.members.where("NOT coalesce(concat(' ', flags, ' ') LIKE '% static %', false)").select(F.col("cls").alias("target"), "key")
    calls = x.rows.where("kind = 'static_call' AND alt <> 'parent'").select("file_id", "path", "line", "col", "name", "key", F.col("alt").alias("target"), F.col("cls").alias("caller"))
    bad = calls.where("coalesce(caller, '') <> target").join(m, ["target", "key"]).join(x.lineage.select(F.col("node").alias("caller"), F.col("ancestor").alias("target")), ["caller", "target"], "left_anti")
    return _issue(bad, INVOCATION, F.concat(F.lit("Method "), "name", F.lit(" of "), bare("target"), F.lit(" is not static")))


def missing_includes(x: Index) -> DataFrame:
    """Written-out includes of files that the corpus does not have; a path starts with its project."""
    have = x.files.select(F.col("path").alias("key"))
    return _issue(x.rows.where("kind = 'include'").join(have, "key", "left_anti"), "PHPStan.Level0.Language", F.concat(F.lit("No file "), "name"))


def subtypes(x: Index) -> DataFrame:
    """Values of a class where another is declared, with no path between them; open hierarchies are let pass."""
    t = x.rows.where("kind = 'subtype'")
    t = t.join(x.open_classes().withColumnRenamed("cls", "key"), "key", "left_anti").join(x.classes.select("key"), "key", "left_semi")
    t = t.withColumn("ancestor", F.explode(F.split("alt", r"\|"))).join(x.lineage.where(F.col("rank") < ROLES["uses"]).withColumnRenamed("node", "key"), ["key", "ancestor"], "left")
    g = t.groupBy("file_id", "path", "line", "col", "name", "extra").agg(F.count("depth").alias("paths")).where("paths = 0")
    return g.select("file_id", F.col("path").alias("filename"), "line", "col", F.lit("ERROR").alias("type"), F.lit(False).alias("fixable"), F.col("name").alias("message"), F.col("extra").alias("code"))


RULES = {f.__name__: f for f in (unknown_classes, unknown_functions, function_arguments, this_calls, static_members, this_properties, duplicates, heritage, final_overrides, required_methods, instantiation, constructors, static_to_instance, missing_includes, subtypes)}
#: Level of each group of codes (F3): local rules run at every level.
LEVEL = {SYMBOLS: 0, MODEL: 0, INVOCATION: 0, "A.PROP.TYPE": 3, "A.RETURN.TYPE": 3, "Generic.CodeAnalysis.UnreachableCode": 4, "A.ARG.TYPE": 5}


def analyse(files: DataFrame, level: int | None = None, disabled: tuple[str, ...] = (), rules: tuple[str, ...] = tuple(RULES)) -> DataFrame:
    """All issues of a corpus (U1). `rules` chooses branches before anything runs; `disabled` drops codes."""
    spark = files.sparkSession
    x = Index(spark, facts(files), files)
    local = x.rows.where("kind = 'issue'").select("file_id", F.col("path").alias("filename"), "line", "col", F.lit("ERROR").alias("type"), F.lit(False).alias("fixable"), F.col("name").alias("message"), F.col("key").alias("code"))
    out = reduce(DataFrame.unionByName, [local, *(RULES[r](x) for r in rules)])
    if disabled:
        out = out.where(~F.col("code").isin(*disabled))
    if level is not None:
        high = [c for c, n in LEVEL.items() if n > level]
        out = out.where(~F.col("code").isin(*high)) if high else out
    return out


def at_levels(issues: DataFrame, levels: DataFrame) -> DataFrame:
    """issues whose code runs at the level of their file, from rows (file_id, level); a null level runs all."""
    needed = F.create_map(*[F.lit(v) for kv in LEVEL.items() for v in kv])[F.col("code")]
    return issues.join(levels, "file_id", "left").where(F.col("level").isNull() | needed.isNull() | (needed <= F.col("level"))).drop("level")


def file_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, level): the level given with a file, else that of its project; repeated rows count once."""
    own = table(spark, sf_dir, "php_files", "file_id", "case_id", "level").groupBy("file_id").agg(F.max("case_id").alias("project"), F.max("level").alias("own"))
    projects = table(spark, sf_dir, "projects", "project", "analysis_level").where("project IS NOT NULL").groupBy("project").agg(F.max("analysis_level").alias("analysis_level"))
    return own.join(projects, "project", "left").select("file_id", F.coalesce("own", "analysis_level").alias("level"))


def php_level0(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.7: issues per file and code, each file at its level."""
    return at_levels(analyse(php_files(spark, sf_dir)), file_levels(spark, sf_dir)).groupBy("filename", "code").agg(F.count("*").alias("n"), F.min("line").alias("first_line"))


def php_class_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes with their number of ancestors and of methods, inherited ones too."""
    files = php_files(spark, sf_dir)
    x = Index(spark, facts(files), files)
    depth = x.lineage.groupBy(F.col("node").alias("key")).agg(F.count("*").alias("ancestors"))
    m = x.members.groupBy(F.col("cls").alias("key")).agg(F.count("*").alias("methods"))
    return x.classes.join(depth, "key", "left").join(m, "key", "left").select(F.substring_index("key", SEP, 1).alias("project"), bare("key").alias("key"), "name", "kind", "builtin", F.coalesce("ancestors", F.lit(0)).alias("ancestors"), F.coalesce("methods", F.lit(0)).alias("methods"))


QUERIES = {"php_level0": php_level0, "php_class_index": php_class_index}
ORACLE: dict[str, str] = {}
