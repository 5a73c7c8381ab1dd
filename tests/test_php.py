from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarrylens.functions import types
from quarrylens.php.grammar import first_error
from quarrylens.php.lexer import tokens

GOOD = [
    "<?php\n", "<p>hi</p><?= $x ?>", "<?php namespace A; use B\\{C, D as E}; use function F\\g; const X = 1, Y = 2;",
    "<?php final readonly class P extends Q implements R, S { use T, U { T::a insteadof U; U::b as protected c; } const int A = 1; public function __construct(private readonly int $x = 1, public protected(set) string $y = 'a') {} }",
    "<?php enum Suit: string { case A = 'a'; const X = self::A; public static function f(): static { return self::A; } }",
    "<?php abstract class A { abstract protected function f(?int $a, int|string|null $b, (A&B)|null $c, self ...$d): ?static; public string $h { get => $this->h; set(string $v) { $this->h = $v; } } }",
    "<?php $f = fn(int $x): int => $x + 1; $g = static function () use (&$a, $b): void {}; $h = strlen(...); $i = $o?->p?->q()['x'] ?? throw new E();",
    "<?php match (true) { $a, $b => 1, default => throw new E }; $x = new class(1) extends B { public $y; }; [$a, [, $b]] = $c; ['k' => $d] = $e;",
    "<?php if ($a): ?>x<?php elseif ($b): ?>y<?php else: ?>z<?php endif; foreach ($a as $k => [$x, $y]): endforeach; while (1): endwhile; for ($i = 0, $j = 1; $i < 3; $i++): endfor; switch ($x): case 1: break; default: endswitch;",
    "<?php try { f(); } catch (A | B $e) { } catch (C) { } finally { } do { } while (0); goto end; end: echo 1, 2; unset($a, $b); declare(strict_types=1); static $z = 1, $w; global $q;",
    "<?php $s = <<<EOT\n  {$a['b']} text\n  EOT; $t = <<<'X'\nplain $a\nX;\n", "<?php echo \"a {$b[\"c\"]} ${d}\"; $x = `ls`; $y = (int) $z; $w = @$a ?: $b; $a **= 2; $a ??= 3; $q = $a <=> $b;",
    "<?php #[A, B(1, x: 2)] function f(#[S] int $p) { yield; yield 1; yield $k => $v; yield from g(); return; } #[X] class Y { #[Z] public int $q = 1; }",
    "<?php class C { public function list() {} public function class() {} const CLASS_ = 1; } C::list(); $o->new(); new ($x)(); $$v = ${'a' . 'b'}; A::{$m}(); foo(...$args, named: 1,);",
    "<?php function &r(array &$a, callable ...$c): iterable { return $a; } interface I extends J, K { public const A = 1; public function m(): void; } trait T { abstract function x(); }",
    "<?php if ($a) echo 1; elseif ($b) echo 2; else if ($c) echo 3; else echo 4; for (;;) break; return [1, 2, ...$x, 'k' => &$y,];",
]
BAD = [
    "", "plain text", "<?php $x = = 4;", "<?php funtion f() {}", "<?php class A { private funtion b() {} }", "<?php return return 1;", "<?php foo((1, 2);", "<?php $a = [1, 2;", "<?php if ($a > ) { }",
    "<?php $x = 1", "<?php class 9a {}", "<?php <<<<<<< HEAD\n$a = 1;", "<?php $a = 'open;", "<?php /* open", "<?php $t = <<<EOT\nopen\n", "<?php }", "<?php function f( {}", "<?php $a ? $b ? 1 : 2 : 3 ? 4 : 5;", "<?php try { }", "<?php echo 1 2;",
    "<?php class A { public public function f() {} }", "<?php 1 = $a;", "<?php $a = 1 < 2 < 3;",
]


@pytest.mark.parametrize("text", GOOD)
def test_grammatical(text):
    assert first_error(text) is None


@pytest.mark.parametrize("text", BAD)
def test_not_grammatical(text):
    assert first_error(text) is not None


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<?php {}()[]'\"$ax1;/*#\n=->:,`\\|", max_size=60))
def test_any_text_is_lexed_whole_and_never_raises(text):
    toks = tokens("<?php " + text)
    assert [t[1] for t in toks][1:] == [t[2] for t in toks][:-1] or any(t[0] == "__halt_compiler" for t in toks)
    first_error("<?php " + text)


def test_types():
    assert types.parse("?int") == {"null", "int"} and types.parse("array<int, Foo>|list<x>") == {"array"} and types.parse("\\A\\B[]") == {"array"}
    assert types.fits(types.parse("float"), types.parse("int")) and not types.fits(types.parse("int"), types.parse("float"))
    assert types.fits(types.parse("A|null"), types.parse("B"), lambda a, b: (a, b) == ("b", "a"))
    assert types.split_top_level("A<B|C>|D") == ["A<B|C>", "D"] and types.bind("T|array<T>", {"T": "int"}) == "int|array<int>"
