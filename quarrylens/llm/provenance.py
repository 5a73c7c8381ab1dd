"""Problem 3: generated, minified or vendored source files.

PHP and JavaScript are lexed and emitted again in canonical form: a statement or
block edge a line, indented by depth. The layout as written is compared with
it. Extreme expansion marks minified code; perfect uniformity (nearly every
line as the canonical form has it, and lines of one shape, or members counted
through without a word of comment) generated code; dominance of literals bulk
data. The other languages have one value a line in either form, so there only
shapes and literals are compared. Sentences in a file's first or last comment
that say a tool wrote it are evidence where they speak of the file itself.

Vendored copies show in the root namespace: each project has one of its own,
and files under another root that several projects hold, or that lie in a
third-party directory or call themselves part of a package, are copies.
Directories to ignore are weak evidence only, as they may hold own work: they
count for files without a namespace of their own.

Null content gives no row; an empty text is no case. Without a path the layout alone decides.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.llm.scan import comment_lines, is_comment, pieces
from quarrylens.llm.sources import files, language
from quarrylens.operators.rowmap import flat_map
from quarrylens.session import checkpointed
from quarrylens.sources.tables import table

#: Canonical lines per written line from which layout counts as minified.
EXPANSION = 4.0
#: Share of one line shape, and lines it needs, for uniform files.
UNIFORM, UNIFORM_LINES = 0.8, 10
#: Members numbered one after the other from which a class counts as generated.
COUNTED = 5
#: Share of literals in the code's characters, and literals needed, for bulk data.
LITERALS, LITERALS_LEAST = 0.6, 60
#: Length of one string from which it may be an embedded blob.
BLOB = 512
#: Directories that package managers and people use for third-party code (fixed values).
THIRD_PARTY = frozenset("vendor vendors node_modules third_party third-party thirdparty bower_components external externals jspm_packages pods".split())

#: What a file says of itself; each starts a sentence or clause.
_MARKER = re.compile(
    r"""(?:^|[.;,!?]\s+|--?\s+|\|\s*)(?:
    @generated\b
  |(?:please\ )?(?:do\ not|don't|never)\ (?:edit|modify|change|touch|alter)(?:\s+(?:by\ hand|manually|directly|it\b|this\b|the\ (?:file|class|code|copy|source)\b|anything)|\W*$|[.!;,]|\s*--)
  |(?:this\ (?:file|class|code|module|script|source)\b\s+)?(?:(?:is|was|has\ been)\s+)?(?:auto-?\s?generated|automatically\ generated|machine[-\ ]generated|generated\ (?:by|from|with|using|automatically|code|file|class|on)\b)
  |(?:this\ )?code\ (?:is\ |was\ )?generated\b
  |this\ (?:file|class|code|module|script|source)\ (?:is|was|has\ been)\ (?:built|created|produced|written|compiled)\ by\ (?:the\ |a\ |an\ )?(?:\w+\ ){0,3}(?:compiler|generator|builder|tool)\b
  |(?:all\ |any\ |your\ |manual\ )?changes?\ (?:made\ here\ |to\ this\ file\ )?(?:will|would)\ be\ (?:lost|overwritten)\b
  |edit\ the\ template\b)""", re.I | re.X)
_PACKAGE = re.compile(r"\bthis file is part of the \S+ (?:package|library|framework|component)\b|^\s*!?\s*\S+ v?\d+\.\d[\d.]* \| ", re.I)
_NAMESPACE = re.compile(r"^[ \t]*namespace[ \t]+([A-Za-z_\x80-\U0010ffff]\w*)", re.M)
_TOKEN = re.compile(r"(?P<str>'[^'\\]*(?:\\.[^'\\]*)*'|\"[^\"\\]*(?:\\.[^\"\\]*)*\")|(?P<num>-?\b\d[\w.]*)|(?P<word>[^\W\d]\w*)|(?P<op>[^\w\s])", re.S)
_TYPES = frozenset("int float string bool array iterable callable object mixed void self static null true false".split())
_NUMBERED = re.compile(r"(?<![\w.])\$?_*[A-Za-z]+?(?:_)*0*(\d{1,6})(?![\d])")


@lru_cache(100_000)
def line_profile(line: str) -> tuple[str, int, int, int]:
    """(the line with names, numbers and strings made alike, literals, their characters, those of blobs)."""
    out, n, chars, blob = [], 0, 0, 0
    for m in _TOKEN.finditer(line):
        kind, size = m.lastgroup, m.end() - m.start()
        if kind == "str" or kind == "num":
            out.append("s" if kind == "str" else "0")
            n += 1
            chars += size
            if kind == "str" and size >= BLOB and not re.search(r"\s", m.group()):
                blob += size
        elif kind == "word":
            out.append("t" if m.group() in _TYPES else "a")
        else:
            out.append(m.group())
    return "".join(out).replace("?t", "t"), n, chars, blob


def canonical(code: str) -> list[str]:
    """Canonical lines of comment-free PHP or JavaScript: statements, list items of a sequence and block edges stand alone, indented by depth."""
    out: list[str] = []
    line: list[str] = []
    depth = inside = 0

    def end() -> None:
        if line:
            out.append("    " * max(0, depth) + "".join(line))
            line.clear()

    for m in _TOKEN.finditer(code):
        t = m.group()
        if t == "{" and not inside:
            end()
            out.append("    " * max(0, depth) + t)
            depth += 1
        elif t == "}" and not inside:
            end()
            depth -= 1
            out.append("    " * max(0, depth) + t)
        elif (t == ";" or t == ",") and not inside:
            line.append(t)
            end()
        else:
            if t in "([":
                inside += 1
            elif t in ")]":
                inside = max(0, inside - 1)
            line.append(t)
    end()
    return out


def agreement(written: list[str], emitted: list[str]) -> float:
    """Share of written lines that the canonical form has too, blanks and the place of braces aside."""
    mine = Counter("".join(x.split()).strip("{}") for x in written)
    theirs = Counter(x.strip(" {}") for x in emitted)
    theirs = Counter({"".join(k.split()): n for k, n in theirs.items()})
    mine.pop("", None)
    return sum(min(n, theirs[k]) for k, n in mine.items()) / max(1, sum(mine.values()))


def layout(path: str, content: str) -> tuple[str | None, str | None, bool, bool]:
    """(verdict, root namespace, marked as a package's file, marked by its directory) of one file."""
    lang = language(path)
    if not content.strip():
        return None, None, False, False
    parts = pieces(lang, content)
    comments = [(k, a, b) for k, a, b in parts if is_comment(k)]
    # Code with comments taken out, and strings as they are.
    bare, i = [], 0
    for _, a, b in comments:
        bare.append(content[i:a])
        i = b
    bare.append(content[i:])
    code = "".join(bare)
    first_body = re.search(r"^[^\n]*\b(?:class|interface|trait|enum|function)\b", code, re.M)
    limit = len(content)
    if first_body:  # its place in the whole text: comments before it are put back
        limit = first_body.start()
        for _, a, b in comments:
            if a > limit:
                break
            limit += b - a
    last = len(content.rstrip())
    for k, a, b in reversed(comments):  # a footer says as much as a header
        if b < last:
            break
        last = len(content[:a].rstrip())
    edge = [(k, a, b) for k, a, b in comments if a <= limit or a >= last]
    head = [" ".join(" ".join(comment_lines(k, content[a:b])).split()) for k, a, b in edge]
    package = any(_PACKAGE.search(h) for h in head)
    m = _NAMESPACE.search(code) if lang == "php" and "<?" in content else None
    root = m[1] if m else None
    segments = path.split("/")[1:-1]
    by_dir = bool(segments) and (segments[0] in THIRD_PARTY or (len(segments) > 1 and segments[0] in ("lib", "libs", "src", "app", "public", "web", "assets") and segments[1] in THIRD_PARTY))
    name = path.rsplit("/", 1)[-1].lower()

    if any(_MARKER.search(h) for h in head) or re.search(r"^[ \t]*#\[\\?(?:\w+\\)*Generated\b", code[: max(limit, 0) + 200], re.M):
        return "generated", root, package, by_dir
    if name.endswith(".lock") or re.search(r"[-.]lock\.\w+$", name):
        return "generated", root, package, by_dir

    lines = [x for x in code.split("\n") if x.strip()]
    n_lines = max(1, len(lines))
    if lang in ("php", "js"):
        emitted = canonical(code)
        if len(emitted) >= 20 and len(emitted) / n_lines >= EXPANSION and max(map(len, lines)) > 200:
            return "minified", root, package, by_dir
    profiles = [line_profile(x.strip().rstrip(",")) for x in lines]
    literals, literal_chars, blob = (sum(x[k] for x in profiles) for k in (1, 2, 3))
    chars = sum(len(x.strip()) for x in lines)
    if lang in ("php", "js") and (blob > 0.5 * chars or (literals >= LITERALS_LEAST and literal_chars >= LITERALS * len(re.sub(r"[\s,\[\]()]", "", code)))):
        return "data", root, package, by_dir
    shapes = Counter(x[0] for x in profiles)
    top = max(shapes.values())
    if top >= UNIFORM_LINES and top >= UNIFORM * (n_lines - 6):
        return ("data" if lang in ("json", "sql", "yml") or literal_chars > 0.5 * chars else "generated"), root, package, by_dir
    if lang in ("php", "js"):
        run = expect = 0
        for m in _NUMBERED.finditer(code):
            v = int(m[1])
            if v == expect:
                run, expect = run + 1, expect + 1
        if len(edge) == len(comments) and run >= COUNTED and len(shapes) <= 0.5 * n_lines and agreement(lines, emitted) >= UNIFORM:
            return "generated", root, package, by_dir
    return None, root, package, by_dir


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per file: what its layout, header, namespace and directory say."""

    def make():
        return lambda file_id, project, path, content: ((file_id, project, path, *layout(path or "", content)),)

    rows = files(spark, sf_dir, "file_id", F.col("case_id").alias("project"), "path", "content")
    return flat_map(rows, make, "file_id long, project string, path string, verdict string, root string, package boolean, third_party boolean").dropDuplicates(["file_id"])


def _below(parts):
    """Parts of a path below the project's folder, however many."""
    return F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))


def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, project, verdict) of every file; verdict null is hand-written source."""
    f = checkpointed(features(spark, sf_dir))
    shared = f.where(F.col("root").isNotNull()).groupBy(F.lower("root").alias("shared_root")).agg(F.countDistinct("project").alias("n_projects")).where("n_projects > 1").select("shared_root")
    roots = f.where(F.col("root").isNotNull() & ~F.col("third_party")).groupBy("project", F.lower("root").alias("r")).agg(F.count("*").alias("n"))
    # A root that other projects have too is a project's own only where it has no other.
    roots = roots.join(shared, F.col("r") == F.col("shared_root"), "left")
    own = roots.groupBy("project").agg(F.max_by("r", F.struct(F.col("shared_root").isNull(), "n", "r")).alias("own"))
    f = f.join(own, "project", "left").join(shared, F.lower("root") == F.col("shared_root"), "left")
    ignored = table(spark, sf_dir, "projects", "project", "ignore_dirs")
    f = f.join(ignored.dropDuplicates(["project"]), "project", "left")
    foreign = F.col("root").isNotNull() & (F.lower("root") != F.coalesce("own", F.lit("")))
    in_ignored = F.coalesce(F.arrays_overlap(_below(F.split("path", "/")), F.col("ignore_dirs")), F.lit(False))
    in_own_folder = F.array_contains(_below(F.split(F.lower("path"), "/")), F.lower("root"))  # deps/name/src of package name
    parts = F.split(F.lower("path"), "/")
    # name/ directly below a folder that is no source folder; then the root is foreign even where the project has no other file.
    package_folder = (F.size(parts) > 3) & (F.get(parts, F.lit(2)) == F.lower("root")) & ~F.get(parts, F.lit(1)).isin("src", "app", "lib", "libs", "source", "classes", "include", "test", "tests", "modules", "packages")
    vendored = F.when(F.col("root").isNotNull(), foreign & (F.col("third_party") | F.col("package") | F.col("shared_root").isNotNull() | in_own_folder) | package_folder).otherwise(
        F.col("third_party") & (in_ignored | F.col("package") | F.col("path").rlike(r"^[^/]+/[^/]+/[^/]+/")))
    return f.select("file_id", "project", "path", F.coalesce("verdict", F.when(vendored, "vendored")).alias("verdict"))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance(spark, sf_dir).where(F.col("verdict").isNotNull()).select("file_id")


def hand_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What remains: the files that people wrote."""
    return provenance(spark, sf_dir).where(F.col("verdict").isNull()).select("file_id", "project", "path")
