"""Small PHP sources with the issues they must give, as queries with a VALUES oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.operators import style
from quarrylens.operators.level0 import analyse
from quarrylens.operators.php_tables import parse_errors

SOURCES = {
    "a.php": """<?php
namespace App;

use Lib\\Tool;

interface Shape { public function area(int $scale); }
abstract class Base implements Shape
{
    const UNIT = 1;
    protected int $size = 0;
    abstract protected function name(): string;
    final public function lock() { return $this->size; }
}
final class Square extends Base
{
    public function area(int $scale) { return $this->side($scale) * self::UNIT * self::NONE; }
    protected function name(): string { return $this->label; }
    public function lock() { return 1; }
    private function side(int $n, int $m = 1) { return $n * $m; }
    public function run() { return $this->side(); }
}
class Wrong extends Square
{
    public function call() { $this->missing(); self::nope(); return new Tool(); }
}
class Open extends Gone { public function f() { $this->anything(); } }
""",
    "b.php": """<?php
function twice($x) { return $x + $x; }
function dead($x)
{
    if ($x) {
        return 1;
    } else {
        throw new Exception('no');
    }
    echo 2;
}
function vars($a)
{
    $b = $a;
    return $b . $c . ($d ?? '') . (isset($e) ? 1 : 0);
}
twice(1, 2);
unknown_thing();
if (function_exists('maybe')) { maybe(); }
strlen();
$k = ['x' => 1, 'x' => 2];
if ($k = 1) { goto nowhere; }
echo sprintf('%s %s', 1);
new Shape2();
""",
    "c.php": """<?php
namespace App;
class Square {}
enum Suit: string { case A = 'a'; case B = 'a'; case C; }
trait T { public function t() {} }
class UsesT { use T; public function x() { return $this->t(); } }
class Needs extends Base { public function area(int $scale) { return 1; } }
$s = new Base();
$t = new Suit();
""",
    "t.php": """<?php
namespace Ty;
interface Animal {}
class Dog implements Animal {}
class Stone {}
class Keeper
{
    private int $n = 0;
    private Animal $pet;
    public function a(): array { return $this; }
    public function b(): void { return 1; }
    public function c(): ?int { return; }
    public function d(int $x): string { $y = $x; return $y; }
    public function e(): float { return 1; }
    public function f(): Animal { return new Dog(); }
    public function g(): Animal { return new Stone(); }
    public function h() { $this->n = 'x'; $this->pet = new Dog(); $this->take([], 'ok', more: 2); }
    private function take(int $i, string $s, bool $more = false) {}
    public function k($v) { if ($v); ; return $v; }
}
""",
    "n.php": """<?php
class Made { private function __construct(int $a) {} public function inst() {} public static function make() { return new Made(1, 2); } }
class Free { public function __construct(int $a, int ...$b) {} }
new Made(1);
new Free();
new Free(1, 2, 3);
Made::inst();
Made::make();
require __DIR__ . '/a.php';
require_once 'gone.php';
""",
    "broken.php": "<?php class X { public funtion y() {} }\n",
    # Two projects with the same names: neither declares anything for the other.
    "p/x.php": """<?php
namespace Shared;
class Twin extends Root {
    public function run() { $this->onlyInQ(); $this->both(); if (method_exists($this, 'maybe')) { $this->maybe(); } }
    public function both() {}
    public final function lock() {}
}
trait Sealed { final public function go() {} private final function own() {} }
class User { use Sealed; public function go() {} }
class Root { final protected function kept() {} private final function mine() {} }
class Low extends Twin { public function kept() {} public function mine() {} }
only_in_q();
""",
    "q/x.php": """<?php
namespace Shared;
class Twin { public function onlyInQ() {} public function both() {} }
function only_in_q() {}
""",
    "q/y.php": """<?php
namespace Shared;
class Twin { public function late() {} }
""",
    "q/z.php": """<?php
namespace Shared;
class Heir extends Twin { public function f() { $this->late(); $this->onlyInQ(); } }
""",
}
#: Issues that the level-0 rules must give: (file, line, code, message).
LEVEL0 = [
    ('p/x.php', 4, 'PHPStan.Level0.Symbols', 'Method onlyInQ is not defined in shared\\twin'),
    ('p/x.php', 11, 'PHPStan.Level0.ClassModel', 'Method kept is final in shared\\root'),
    ('p/x.php', 12, 'PHPStan.Level0.Symbols', 'Function only_in_q is not known'),
    ('p/x.php', 12, 'PSR1.Files.SideEffects', 'The file declares symbols and has side effects'),
    ('q/y.php', 3, 'PHPStan.Level0.ClassModel', 'Class Twin is declared before'),
    ('q/z.php', 3, 'PHPStan.Level0.Symbols', 'Method late is not defined in shared\\heir'),
    ('a.php', 16, 'PHPStan.Level0.Symbols', 'Constant NONE is not defined in app\\square'),
    ('a.php', 17, 'PHPStan.Level0.Symbols', 'Property label is not defined in app\\square'),
    ('a.php', 18, 'PHPStan.Level0.ClassModel', 'Method lock is final in app\\base'),
    ('a.php', 20, 'PHPStan.Level0.Invocation', 'Call of side with 0 arguments, 1 to 2 fit'),
    ('a.php', 22, 'PHPStan.Level0.ClassModel', 'app\\square is final'),
    ('a.php', 24, 'PHPStan.Level0.Symbols', 'Class Tool is not known (new)'),
    ('a.php', 24, 'PHPStan.Level0.Symbols', 'Method missing is not defined in app\\wrong'),
    ('a.php', 24, 'PHPStan.Level0.Symbols', 'Static method nope is not defined in app\\wrong'),
    ('a.php', 26, 'PHPStan.Level0.Symbols', 'Class app\\gone is not known (extends)'),
    ('b.php', 10, 'Generic.CodeAnalysis.UnreachableCode', 'This statement is never reached'),
    ('b.php', 15, 'PHPStan.Level0.Variables', 'Variable $c is not defined'),
    ('b.php', 17, 'PHPStan.Level0.Invocation', 'Call of twice with 2 arguments, 1 to 1 fit'),
    ('b.php', 17, 'PSR1.Files.SideEffects', 'The file declares symbols and has side effects'),
    ('b.php', 18, 'PHPStan.Level0.Symbols', 'Function unknown_thing is not known'),
    ('b.php', 20, 'PHPStan.Level0.Invocation', 'Call of strlen with 0 arguments, 1 to 1 fit'),
    ('b.php', 21, 'PHPStan.Level0.Language', 'Key x stands twice'),
    ('b.php', 22, 'Generic.CodeAnalysis.AssignmentInCondition', 'Assignment inside a condition'),
    ('b.php', 22, 'PHPStan.Level0.Language', 'No label nowhere'),
    ('b.php', 23, 'PHPStan.Level0.Invocation', '2 placeholders but 1 values'),
    ('b.php', 24, 'PHPStan.Level0.Symbols', 'Class Shape2 is not known (new)'),
    ('n.php', 2, 'A.ARG.COUNT', 'Call of Made with 2 arguments, 1 to 1 fit'),
    ('n.php', 4, 'PHPStan.Level0.Invocation', 'The constructor of Made is private'),
    ('n.php', 4, 'PSR1.Files.SideEffects', 'The file declares symbols and has side effects'),
    ('n.php', 5, 'A.ARG.COUNT', 'Call of Free with 0 arguments, 1 to more fit'),
    ('n.php', 7, 'PHPStan.Level0.Invocation', 'Method inst of made is not static'),
    ('n.php', 10, 'PHPStan.Level0.Language', 'No file gone.php'),
    ('t.php', 10, 'A.RETURN.TYPE', 'Return: ty\\keeper does not fit array'),
    ('t.php', 11, 'A.RETURN.TYPE', 'A value is returned where void is declared'),
    ('t.php', 12, 'A.RETURN.TYPE', 'Return without a value does not fit int|null'),
    ('t.php', 13, 'A.RETURN.TYPE', 'Return: int does not fit string'),
    ('t.php', 16, 'A.RETURN.TYPE', 'Return: ty\\stone does not fit ty\\animal'),
    ('t.php', 17, 'A.PROP.TYPE', 'Property n: string does not fit int'),
    ('t.php', 17, 'A.ARG.TYPE', 'Argument $i: array does not fit int'),
    ('t.php', 17, 'A.ARG.TYPE', 'Argument $more: int does not fit bool'),
    ('t.php', 19, 'Generic.CodeAnalysis.EmptyStatement', 'Empty body of if'),
    ('t.php', 19, 'Generic.CodeAnalysis.EmptyStatement', 'Empty statement'),
    ('c.php', 3, 'PHPStan.Level0.ClassModel', 'Class Square is declared before'),
    ('c.php', 4, 'PHPStan.Level0.ClassModel', "Case C and the enum's backing do not agree"),
    ('c.php', 4, 'PHPStan.Level0.ClassModel', 'Value a belongs to several cases'),
    ('c.php', 7, 'PHPStan.Level0.ClassModel', 'Method name is required by app\\base'),
    ('c.php', 8, 'PHPStan.Level0.ClassModel', 'No instance can be made of Base'),
    ('c.php', 9, 'PHPStan.Level0.ClassModel', 'No instance can be made of Suit'),
]
STYLE_SOURCE = """<?php
class bad_name {
    const lower = 1; const A__B = 2;
    function noVis() { return 1; }
    public function Snake_case($a){
        if($a){ foo($a,1); }
        foreach  ($a as $b) { bar (1); }
        $x = new Foo; $y = 1 ;
        if ($a) {
        } else if ($b) {\x20
        }
    }
}"""
#: Issues that the style rules must give: (line, column, code).
STYLE = [
    (0, 1, "PSR12.Files.EndFileNewline"), (2, 1, "PSR12.Files.MissingBlankLineAfterPHPOpeningTag"), (2, 1, "PSR1.Classes.ClassDeclaration.PascalCase"), (2, 1, "PSR12.Classes.OpenBraceOnOwnLine"), (3, 11, "PSR1.Classes.ClassConstantName"), (3, 28, "PSR1.Classes.ClassConstantName"),
    (3, 36, "Generic.Formatting.DisallowMultipleStatements"), (4, 5, "PSR12.Methods.VisibilityDeclared"), (4, 34, "PSR12.Classes.ClosingBraceOnOwnLine"), (5, 12, "PSR1.Methods.CamelCapsMethodName"),
    (5, 34, "PSR12.ControlStructures.ControlStructureSpacing"), (6, 9, "PSR12.ControlStructures.ControlStructureSpacing"), (6, 14, "PSR12.ControlStructures.ControlStructureSpacing"),
    (6, 23, "Generic.Functions.FunctionCallArgumentSpacing"), (7, 9, "PSR12.ControlStructures.ControlStructureSpacing"), (7, 31, "PSR12.ControlStructures.ControlStructureSpacing"),
    (8, 1, "PSR12.Files.NoSpaceBeforeSemicolon"), (8, 14, "PSR1.Classes.ClassInstantiation"), (8, 30, "Generic.Formatting.DisallowMultipleStatements"),
    (10, 11, "PSR12.ControlStructures.ElseIfDeclaration"), (10, 25, "PSR12.Files.EndFileNoTrailingWhitespace"),
]


def sources(spark: SparkSession) -> DataFrame:
    rows = [(i, p, t, p.rpartition("/")[0]) for i, (p, t) in enumerate(SOURCES.items())]
    return spark.createDataFrame(rows, "file_id long, path string, content string, project string")


def php_level0_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.7: the rules over the fixture."""
    return analyse(sources(spark)).select("filename", "line", "code", "message")


def php_style_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.8: the style rules over the fixture."""
    f = spark.createDataFrame([(1, "s.php", STYLE_SOURCE)], "file_id long, path string, content string")
    return style.issues(f).select("line", "col", "code")


def php_compat_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which fixture files parse."""
    f = sources(spark)
    bad = parse_errors(f).select("file_id", "line")
    return f.join(bad, "file_id", "left").select("path", F.col("line").alias("error_line"))


def _values(rows: list[tuple], columns: str) -> str:
    def text(v):
        return "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) AS t({columns})"


QUERIES = {f.__name__: f for f in (php_level0_fixture, php_style_fixture, php_compat_fixture)}
ORACLE = {
    "php_level0_fixture": _values(LEVEL0, "filename, line, code, message"),
    "php_style_fixture": _values(STYLE, "line, col, code"),
    "php_compat_fixture": _values([("a.php", None), ("b.php", None), ("c.php", None), ("t.php", None), ("n.php", None), ("broken.php", 1), *((f, None) for f in ("p/x.php", "q/x.php", "q/y.php", "q/z.php"))], "path, error_line"),
}
