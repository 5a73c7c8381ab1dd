"""What the language brings along (S13): classes, functions with their argument bounds, constants (fixed values)."""

from __future__ import annotations

#: name -> (kind, parent)
CLASSES: dict[str, tuple[str, str | None]] = {
    **dict.fromkeys("Traversable Countable ArrayAccess Stringable JsonSerializable Serializable UnitEnum Throwable".split(), ("interface", None)),
    "Iterator": ("interface", "Traversable"), "IteratorAggregate": ("interface", "Traversable"), "BackedEnum": ("interface", "UnitEnum"), "DateTimeInterface": ("interface", None),
    "Exception": ("class", "Throwable"), "Error": ("class", "Throwable"), "ErrorException": ("class", "Exception"), "TypeError": ("class", "Error"), "ValueError": ("class", "Error"),
    "ArithmeticError": ("class", "Error"), "LogicException": ("class", "Exception"), "RuntimeException": ("class", "Exception"), "InvalidArgumentException": ("class", "LogicException"),
    "DomainException": ("class", "LogicException"), "OutOfBoundsException": ("class", "RuntimeException"), "UnexpectedValueException": ("class", "RuntimeException"), "JsonException": ("class", "Exception"),
    "Closure": ("class", None), "Generator": ("class", "Iterator"), "stdClass": ("class", None), "ArrayObject": ("class", "IteratorAggregate"), "ArrayIterator": ("class", "Iterator"),
    "DateTime": ("class", "DateTimeInterface"), "DateTimeImmutable": ("class", "DateTimeInterface"), "WeakMap": ("class", None), "PDO": ("class", None), "ReflectionClass": ("class", None),
}
_BOUNDS = """strlen 1 1|count 1 2|sprintf 1 -1|printf 1 -1|vsprintf 2 2|str_replace 3 4|substr 2 3|strpos 2 3|explode 2 3|implode 1 2|trim 1 2|ltrim 1 2|rtrim 1 2|strtolower 1 1|strtoupper 1 1|ucfirst 1 1
lcfirst 1 1|in_array 2 3|array_map 2 -1|array_filter 1 3|array_keys 1 3|array_values 1 1|array_merge 0 -1|array_key_exists 2 2|array_slice 2 4|array_unique 1 2|array_reverse 1 2|array_sum 1 1
array_pop 1 1|array_push 1 -1|array_shift 1 1|usort 2 2|sort 1 2|ksort 1 2|is_array 1 1|is_string 1 2|is_int 1 1|is_null 1 1|is_callable 1 3|is_numeric 1 1|is_object 1 1|intval 1 2|floatval 1 1
intdiv 2 2|round 1 3|floor 1 1|ceil 1 1|abs 1 1|min 1 -1|max 1 -1|define 2 3|defined 1 1|constant 1 1|getenv 0 2|env 1 2|json_encode 1 3|json_decode 1 4|base64_decode 1 2|base64_encode 1 1
md5 1 2|sha1 1 2|hash 2 4|random_int 2 2|file_get_contents 1 5|file_put_contents 2 4|file_exists 1 1|is_file 1 1|dirname 1 2|basename 1 2|class_exists 1 2|interface_exists 1 2|function_exists 1 1
method_exists 2 2|property_exists 2 2|preg_match 2 5|preg_replace 3 5|preg_split 2 4|preg_quote 1 2|date 1 2|time 0 0|microtime 0 1|strtotime 1 2|usleep 1 1|call_user_func 1 -1|func_get_args 0 0
compact 1 -1|extract 1 3|isset 1 -1|empty 1 1|exit 0 1|die 0 1|unset 1 -1|eval 1 1|get_class 0 1|spl_object_id 1 1|iterator_to_array 1 2|str_contains 2 2|str_starts_with 2 2|str_ends_with 2 2
array_column 2 3|array_combine 2 2|array_diff 1 -1|array_fill 3 3|array_flip 1 1|array_search 2 3|range 2 3|number_format 1 4|htmlspecialchars 1 4|nl2br 1 2|ord 1 1|chr 1 1|strrev 1 1|trigger_error 1 2"""
#: name -> (least, most arguments; -1 without bound)
FUNCTIONS = {n: (int(a), int(b)) for n, a, b in (x.split() for line in _BOUNDS.split("\n") for x in line.split("|"))}
CONSTANTS = frozenset("PHP_EOL PHP_INT_MAX PHP_INT_MIN PHP_VERSION DIRECTORY_SEPARATOR E_ALL M_PI NAN INF true false null".split())
SUPERGLOBALS = frozenset("GLOBALS _GET _POST _SERVER _COOKIE _FILES _ENV _REQUEST _SESSION this argc argv".split())
