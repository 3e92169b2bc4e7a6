"""Programs over single values: paths, pipes, folds, order, errors."""

import pytest

from docsluice.lang.evaluate import evaluate

CASES = [
    (".a.b", {"a": {"b": 3}}, [3]),
    (".[]", [1, 2], [1, 2]),
    (".[1:]", [1, 2, 3], [[2, 3]]),
    (".a?", 3, []),
    (".a // 7", {"a": None}, [7]),
    ("[.[] | select(. > 1)]", [1, 2, 3], [[2, 3]]),
    ("{a: .x, b: (.x + 1)}", {"x": 1}, [{"a": 1, "b": 2}]),
    ("reduce .[] as $x (0; . + $x)", [1, 2, 3], [6]),
    ("[foreach .[] as $x (0; . + $x)]", [1, 2, 3], [[1, 3, 6]]),
    ("if . then 1 else 2 end", None, [2]),
    ("group_by(.k) | map(length)", [{"k": 1}, {"k": 2}, {"k": 1}], [[2, 1]]),
    ("sort", [3, None, "a", 1, True], [[None, True, 1, 3, "a"]]),
    ("unique_by(.k)", [{"k": 1, "i": 0}, {"k": 1, "i": 1}], [[{"k": 1, "i": 0}]]),
    ("top_k(2; .a)", [{"a": 3}, {"a": 1}, {"a": 2}], [[{"a": 1}, {"a": 2}]]),
    ("to_entries", {"a": 1}, [[{"key": "a", "value": 1}]]),
    ("[paths]", {"a": [1]}, [[["a"], ["a", 0]]]),
    ("del(.a)", {"a": 1, "b": 2}, [{"b": 2}]),
    (".a |= . + 1", {"a": 1}, [{"a": 2}]),
    ("def f(x): x * 2; f(.)", 4, [8]),
    ("try error(\"x\") catch .", None, ["x"]),
    ('"\\(.a)!"', {"a": 1}, ["1!"]),
    ("[limit(2; range(10))]", None, [[0, 1]]),
    ("any(.[]; . > 2)", [1, 3], [True]),
    ("[.[] as [$a, $b] | $a + $b]", [[1, 2], [3, 4]], [[3, 7]]),
    ("label $out | 1, break $out, 2", None, [1]),
    ("test(\"b+\")", "abb", [True]),
    ("split(\",\")", "a,b", [["a", "b"]]),
    ("@base64", "hi", ["aGk="]),
    ("[windows(2; .[])]", [1, 2, 3], [[[1], [1, 2], [2, 3]]]),
    ("[deltas(.[])]", [1, 3, 2], [[2, -1]]),
    ('[.[] | numfmt("%.0f")]', [2.5, -2.5], [["3", "-3"]]), ('numfmt("%,.2f")', 9876543.215, ["9,876,543.22"]), ('[numfmt("%9.1f", "%09.1f", "<%d>")]', -7.25, [["     -7.3", "-000007.3", "<-7>"]]), ('numfmt("%.3e")', 98765, ["9.877e+04"]),
    ('try numfmt("%q") catch .', 1, ['numfmt: invalid format "%q"']), ("try round(2) catch \"no\"", "x", ["no"]), ("[.[] | log(10)]", [1000, 0], [[3, float("-inf")]]), ('try log("x") catch "no"', 5, ["no"]),
    ("[.[] | tonumber]", ["+7.5", "007"], [[7.5, 7]]), ("[.[] | fromjson]", ["+03", " 4 "], [[3, 4]]), ("delpaths([[1], [1, 0]])", [1, [2], 3], [[1, 3]]), ('[.[] | redact("a")]', [7, "bab"], [["[REDACTED]", "b[REDACTED]b"]]),
    ("rand(42)", None, [0.08386297105988216]), ('gzip_compress[:12]', "x", ["H4sIAAAAAAAA"]), ("(shuffle | sort), (sample(2) | length)", [3, 1, 2], [[1, 2, 3], 2]), ("[range(5)] | map(select(. != choice([9])))", None, [[0, 1, 2, 3, 4]]),
    ("[rand(1) == rand(1), rand(1) == rand(2)]", None, [[True, False]]), ("randint(5; 6)", None, [5]), ("fill_forward", [1, None, 2, None], [[1, 1, 2, 2]]), ("[.[] | ip_class]", ["10.0.0.1", "127.0.0.1"], [["private", "loopback"]]),
    ("[limit(3; repeat(1))]", None, [[1, 1, 1]]), ("[.[] | ltrimstr(\"a\")]", ["ab", 1], [["b", 1]]), ("to_entries | from_entries", {"a": 1}, [{"a": 1}]), ("[splits(\", *\")]", "a, b,c", [["a", "b", "c"]]), ("transpose", [[1, 2], [3]], [[[1, 3], [2, None]]]),
    ("[walk(if type == \"number\" then . + 1 else . end)]", [1, [2]], [[[2, [3]]]]), ("tojson, (tojson | fromjson)", [1, "a"], ['[1,"a"]', [1, "a"]]), ("[getpath([\"a\", 0])]", {"a": [5]}, [[5]]), ("[tostream] | fromstream(.[])", {"a": [1]}, [{"a": [1]}]),
]


@pytest.mark.parametrize("program, value, wanted", CASES)
def test_outputs(program, value, wanted):
    assert list(evaluate(program, value)) == wanted
