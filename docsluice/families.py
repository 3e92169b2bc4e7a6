"""Registered queries of the function families, each over a whole table, and the same in SQL.

Numbers that libraries may round differently in the last place are scaled and rounded on both sides.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from docsluice.plans.compiler import compile_program


@dataclass(frozen=True)
class Query:
    """A program over the table `main` as `.`, in the order of columns `order`, with other tables as variables.

    `schema` has the columns of what the evaluator makes, where a program has no plan. `finite`: no NaN in the table.
    """

    main: str
    program: str
    sql: str | None
    order: tuple[str, ...] = ()
    others: tuple[str, ...] = ()
    schema: str | None = None
    on_error: str = "raise"
    finite: bool = False

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
        return compile_program(self.program, read(self.main), list(self.order) or None, tables={n: read(n) for n in self.others}, schema=self.schema, on_error=self.on_error, finite=self.finite)


def _scaled(names: dict[str, tuple[str, str]], key: str, table: str, given: str, given_sql: str, schema: bool = False) -> Query:
    """One column for each function: name to (program over $x, SQL over x), times a million and rounded."""
    members = ", ".join(f"{n}: ({p} * 1000000 | round)" for n, (p, _) in names.items())
    columns = ", ".join(f"round(({s}) * 1000000)::DOUBLE + 0 AS {n}" for n, (_, s) in names.items())
    ddl = f"{key} long, " + ", ".join(f"{n} double" for n in names) if schema else None
    return Query(table, f".[] | ({given}) as $x | {{{key}, {members}}}", f"SELECT {key}, {columns} FROM (SELECT *, {given_sql} AS x FROM {table})", schema=ddl)


_UNARY = {n: (f"($x | {n})", f"{n}(x)") for n in ("sin", "cos", "tan", "asin", "acos", "atan", "sinh", "cosh", "tanh", "asinh", "exp", "log2", "log10", "cbrt", "sqrt", "degrees", "radians")}
_UNARY |= {
    "atanh": ("($x / 2 | atanh)", "atanh(x / 2)"), "acosh": ("($x + 1 | acosh)", "acosh(x + 1)"), "expm1": ("($x | expm1)", "exp(x) - 1"), "exp2": ("($x | exp2)", "pow(2, x)"),
    "exp10": ("($x | exp10)", "pow(10, x)"), "pow10": ("($x | pow10)", "pow(10, x)"), "log": ("($x | log)", "ln(x)"), "log1p": ("($x | log1p)", "ln(1 + x)"), "recip": ("($x | recip)", "1 / x"),
    "fract": ("($x * 7 | fract)", "x * 7 - trunc(x * 7)"), "signum": ("($x - 0.5 | signum)", "sign(x - 0.5)"), "fabs": ("($x - 0.5 | fabs)", "abs(x - 0.5)"), "abs": ("($x - 0.5 | abs)", "abs(x - 0.5)"),
    "pi": ("($x | pi)", "pi()"), "e": ("($x | e)", "exp(1)"), "tau": ("($x | tau)", "2 * pi()"),
}
_BINARY = {
    "pow": ("pow($x; 1.5)", "pow(x, 1.5)"), "atan2": ("atan2($x; 0.3)", "atan2(x, 0.3)"), "hypot": ("hypot($x; 2)", "sqrt(x * x + 4)"), "fmod": ("fmod($x * 10; 3)", "fmod(x * 10, 3)"),
    "fmin": ("fmin($x; 0.5)", "least(x, 0.5)"), "fmax": ("fmax($x; 0.5)", "greatest(x, 0.5)"), "fdim": ("fdim($x; 0.5)", "greatest(x - 0.5, 0)"), "copysign": ("copysign($x; -2)", "-x"),
    "ldexp": ("ldexp($x; 3)", "x * 8"), "scalb": ("scalb($x; 2)", "x * 4"), "scalbln": ("scalbln($x; 1)", "x * 2"), "fma": ("fma($x; 3; 1)", "x * 3 + 1"), "log_b": ("($x + 1 | log(3))", "ln(x + 1) / ln(3)"),
}
#: Series of the Bessel functions of the first kind, for arguments up to 1.
_J = "list_sum(list_transform(range(0, 15), lambda k: pow(-1, k) * pow(x / 2, 2 * k + {n}) / (factorial(k::INT) * factorial((k + {n})::INT))::DOUBLE))"
_HARMONIC = "list_sum(list_transform(range(1, k + 1), lambda i: 1.0::DOUBLE / i))"
_RARE = {
    "j0": ("($x | j0)", _J.format(n=0)), "j1": ("($x | j1)", _J.format(n=1)), "jn": ("jn(3; $x)", _J.format(n=3)),
    "y0": ("($x | y0)", f"2 / pi() * (ln(x / 2) + 0.57721566490153286) * {_J.format(n=0)} + 2 / pi() * list_sum(list_transform(range(1, 15), lambda k: pow(-1, k + 1) * {_HARMONIC} * pow(x * x / 4, k) / pow(factorial(k::INT)::DOUBLE, 2)))"),
    "gamma": ("($x | gamma)", "lgamma(x)"), "lgamma": ("($x | lgamma)", "lgamma(x)"), "tgamma": ("($x | tgamma)", "gamma(x)"), "lgamma_r": ("($x | lgamma_r[0])", "lgamma(x)"),
    "significand": ("($x | significand)", "x / pow(2, floor(log2(x)))"), "logb": ("($x | logb)", "floor(log2(x))"), "frexp": ("($x | frexp[0])", "x / pow(2, floor(log2(x)) + 1)"), "power": ("($x | frexp[1])", "floor(log2(x)) + 1"),
    "modf": ("($x * 7 | modf[0])", "x * 7 - trunc(x * 7)"), "drem": ("drem($x * 10; 3)", "x * 10 - 3 * round_even(x * 10 / 3, 0)"), "remainder": ("remainder($x * 10; 3)", "x * 10 - 3 * round_even(x * 10 / 3, 0)"),
    "nextafter": ("nextafter($x; 2)", "x"), "nexttoward": ("nexttoward($x; 2)", "x"), "log_of": ("log($x + 1; 2)", "ln(x + 1) / ln(2)"),
}

_V = "list_transform(embedding, lambda x: x::DOUBLE)"

FAMILIES: dict[str, Query] = {
    "math_unary": _scaled(_UNARY, "p_partkey", "part", ".p_size / 50", "p_size / 50.0::DOUBLE"),
    "math_binary": _scaled(_BINARY, "p_partkey", "part", ".p_size / 50", "p_size / 50.0::DOUBLE"),
    "math_rare": _scaled(_RARE, "p_partkey", "part", ".p_size / 50", "p_size / 50.0::DOUBLE", schema=True),
    "math_rounding": Query(
        "part",
        ".[] | (.p_retailprice - 950.05) as $x | {p_partkey, f: ($x | floor), c: ($x | ceil), t: ($x | trunc), r: ($x | round), i: ($x | rint), n: ($x | nearbyint), v: ($x | round_even), h: (.p_size / 2 | round), g: (.p_size / 2 | round_even)}",
        "SELECT p_partkey, floor(x)::BIGINT AS f, ceil(x)::BIGINT AS c, trunc(x) AS t, round(x) AS r, round_even(x, 0) AS i, round_even(x, 0) AS n, round_even(x, 0) AS v, round(p_size / 2.0::DOUBLE) AS h, round_even(p_size / 2.0::DOUBLE, 0) AS g FROM (SELECT *, p_retailprice - 950.05 AS x FROM part)",
    ),
    "math_kinds": Query(
        "part",
        ".[] | (if .p_size < 10 then nan elif .p_size < 20 then infinite else .p_size * 1.5 end) as $x | {p_partkey, a: ($x | isnan), b: ($x | isinfinite), c: ($x | isfinite), d: ($x | isnormal), n: ([$x | finites] | length), m: ([$x | normals] | length)}",
        "SELECT p_partkey, p_size < 10 AS a, p_size BETWEEN 10 AND 19 AS b, p_size >= 20 AS c, p_size >= 20 AS d, (p_size >= 20)::BIGINT AS n, (p_size >= 20)::BIGINT AS m FROM part",
        schema="p_partkey long, a boolean, b boolean, c boolean, d boolean, n long, m long",
    ),
    "text_trims": Query(
        "customer",
        '.[] | (" \\t" + .c_name + "\\n ") as $s | {c_custkey, t: ($s | trim), l: ($s | ltrim | length), r: ($s | rtrim | length), x: (.c_name | rtrimstr("0")), y: (.c_name | trimstr("C")), z: (.c_name | ltrimstr("nope")), e: (.c_name | endswith("7")), c: (.c_name | contains("00012")), i: ("00" | inside("a00")), d: (.c_name | ascii_downcase)}',
        "SELECT c_custkey, c_name AS t, length(c_name) + 2 AS l, length(c_name) + 2 AS r, CASE WHEN ends_with(c_name, '0') THEN c_name[:-2] ELSE c_name END AS x, c_name[2:] AS y, c_name AS z, ends_with(c_name, '7') AS e, contains(c_name, '00012') AS c, true AS i, lower(c_name) AS d FROM customer",
    ),
    "text_pieces": Query(
        "part",
        '.[] | {p_partkey, a: (.p_name | split(" ") | join("-")), j: (.p_name | explode | implode), n: (.p_name | explode | add), i: (.p_name | indices("l")), r: (.p_name | rindex("l")), x: (.p_name | index("ll")), s: (.p_name | split(" "; null) | length), u: (.p_name[1:4]), k: (.p_name * 2), q: (.p_name / " " | length)}',
        "SELECT p_partkey, replace(p_name, ' ', '-') AS a, p_name AS j, list_sum(list_transform(string_split(p_name, ''), lambda c: ord(c)))::BIGINT AS n, list_transform(list_filter(range(1, length(p_name) + 1), lambda i: substr(p_name, i, 1) = 'l'), lambda i: i - 1) AS i, (CASE WHEN contains(p_name, 'l') THEN length(p_name) - strpos(reverse(p_name), 'l') END)::BIGINT AS r, (nullif(strpos(p_name, 'll'), 0) - 1)::BIGINT AS x, len(string_split(p_name, ' '))::BIGINT AS s, substr(p_name, 2, 3) AS u, p_name || p_name AS k, len(string_split(p_name, ' '))::BIGINT AS q FROM part",
        schema="p_partkey long, a string, j string, n long, i array<long>, r long, x long, s long, u string, k string, q long",
    ),
    "text_formats": Query(
        "nation",
        '.[] | {n_nationkey, a: (.n_nationkey | @text), b: ({k: .n_name} | @json), c: ("a b/" + .n_name | @uri), d: ("a%20" + .n_name | @urid), e: ([.n_nationkey, .n_name] | @tsv), f: ("it\'s " + .n_name | @sh), g: (.n_name | @base64 | @base64d), h: @html "<\\(.n_name)>", i: (.n_name | format("base64")), j: (.n_nationkey | tojson), k: (.n_nationkey | tostring | tonumber), l: ([.n_name, 1] | tojson)}',
        "SELECT n_nationkey, n_nationkey::VARCHAR AS a, '{\"k\":\"' || n_name || '\"}' AS b, 'a%20b%2F' || n_name AS c, 'a ' || n_name AS d, n_nationkey || chr(9) || n_name AS e, '''it''\\''''s ' || n_name || '''' AS f, n_name AS g, '<' || n_name || '>' AS h, base64(n_name::BLOB) AS i, n_nationkey::VARCHAR AS j, n_nationkey::BIGINT AS k, '[\"' || n_name || '\",1]' AS l FROM nation",
        schema="n_nationkey long, a string, b string, c string, d string, e string, f string, g string, h string, i string, j string, k long, l string",
    ),
    "text_json": Query("events", ".[] | {event_id, k: (.props | fromjson.k), s: (.props | fromjson | tojson), t: (.props | fromjson | type)}", "SELECT event_id, (props->>'k')::BIGINT AS k, replace(props, ' ', '') AS s, 'object' AS t FROM events", schema="event_id long, k long, s string, t string"),
    "regex_match": Query(
        "part",
        '.[] | {p_partkey, at: (.p_name | match("[aeiou]").offset), all: [.p_name | match("[aeiou]"; "g").string], cap: (.p_name | capture("(?<first>[a-z]+) (?<rest>.*)")), up: (.p_type | test("^econ"; "i")), n: ([.p_name | match("(l)(x)?"; "g").captures | length])}',
        "SELECT p_partkey, (length(regexp_extract(p_name, '^[^aeiou]*')))::BIGINT AS at, regexp_extract_all(p_name, '[aeiou]') AS all, '{\"first\":\"' || split_part(p_name, ' ', 1) || '\",\"rest\":\"' || split_part(p_name, ' ', 2) || '\"}' AS cap, starts_with(p_type, 'ECON') AS up, list_transform(regexp_extract_all(p_name, 'l'), lambda x: 2::BIGINT) AS n FROM part",
        schema="p_partkey long, at long, all array<string>, cap string, up boolean, n array<long>",
    ),
    "regex_replace": Query(
        "part",
        '.[] | {p_partkey, s: (.p_name | sub("(?<v>[aeiou])"; "<\\(.v)>")), g: (.p_name | gsub("(?<v>[aeiou])"; "\\(.v | ascii_upcase)")), f: (.p_type | gsub("e"; "3"; "i")), p: [.p_name | splits("[aeiou]+")], w: (.p_name | split("[aeiou]"; "g")), c: [.p_name | scan("([a-z])l")], d: [.p_name | scan("L"; "i")]}',
        "SELECT p_partkey, regexp_replace(p_name, '([aeiou])', '<\\1>') AS s, translate(p_name, 'aeiou', 'AEIOU') AS g, replace(p_type, 'E', '3') AS f, string_split_regex(p_name, '[aeiou]+') AS p, string_split_regex(p_name, '[aeiou]') AS w, '[' || array_to_string(list_transform(regexp_extract_all(p_name, '([a-z])l', 1), lambda x: '[\"' || x || '\"]'), ',') || ']' AS c, regexp_extract_all(p_name, 'l') AS d FROM part",
        schema="p_partkey long, s string, g string, f string, p array<string>, w array<string>, c string, d array<string>",
    ),
    "regex_native": Query(
        "documents",
        '.[] | {doc_id, a: (.text | test("the"; "i")), n: ([.text | scan("[0-9]+")] | length), l: ([.text | splits("\\n")] | length), m: (.text | gsub("[aeiou]"; "$") | length)}',
        "SELECT doc_id, regexp_matches(text, '(?i)the') AS a, len(regexp_extract_all(text, '[0-9]+'))::BIGINT AS n, len(string_split(text, chr(10)))::BIGINT AS l, length(text) AS m FROM documents",
    ),
    "time_parts": Query(
        "orders",
        '.[] | (.o_orderkey * 86411) as $t | {o_orderkey, g: ($t | gmtime), d: ($t | todate), s: ($t | strftime("%Y/%m/%d %H:%M:%S %j")), b: ($t | todate | fromdate), i: ($t | todateiso8601 | fromdateiso8601)}',
        "SELECT o_orderkey, [year(t)::DOUBLE, month(t) - 1, day(t), hour(t), minute(t), second(t), dayofweek(t), dayofyear(t) - 1] AS g, strftime(t, '%Y-%m-%dT%H:%M:%SZ') AS d, strftime(t, '%Y/%m/%d %H:%M:%S %j') AS s, k AS b, k AS i FROM (SELECT o_orderkey, o_orderkey * 86411 AS k, make_timestamp(o_orderkey * 86411 * 1000000) AS t FROM orders)",
    ),
    "time_rest": Query(
        "orders",
        '.[] | (.o_orderkey * 86411) as $t | {o_orderkey, m: ($t | gmtime | mktime), p: ($t | strftime("%Y-%m-%d %H:%M:%S") | strptime("%Y-%m-%d %H:%M:%S") | mktime), r: ($t | torfc3339 | fromrfc3339), l: ($t | localtime | length), f: ($t | strflocaltime("%Y")), n: (now > 1700000000)}',
        "SELECT o_orderkey, o_orderkey * 86411 AS m, o_orderkey * 86411 AS p, o_orderkey * 86411 AS r, 8::BIGINT AS l, strftime(make_timestamp(o_orderkey * 86411 * 1000000), '%Y') AS f, true AS n FROM orders",
        schema="o_orderkey long, m long, p long, r long, l long, f string, n boolean",
    ),
    "encodings": Query(
        "customer",
        '.[] | (.c_name + "?>") as $s | {c_custkey, a: ($s | base64_encode), b: ($s | base64_encode | base64_decode), c: ($s | base64url_encode), d: ($s | base64url_encode | base64url_decode), e: ($s | hex_encode | hex_decode), f: ($s | sha1), g: ($s | md5)}',
        "SELECT c_custkey, base64(s::BLOB) AS a, s AS b, rtrim(translate(base64(s::BLOB), '+/', '-_'), '=') AS c, s AS d, s AS e, sha1(s) AS f, md5(s) AS g FROM (SELECT *, c_name || '?>' AS s FROM customer)",
    ),
    "encodings_rest": Query(
        "customer",
        '.[] | (.c_name + " é?") as $s | {c_custkey, a: ($s | percent_encode), b: ($s | percent_encode | percent_decode), c: ($s | base32_encode | base32_decode), d: ($s | quoted_printable_encode | quoted_printable_decode), e: ($s | gzip_compress | gzip_decompress), f: ($s | deflate_compress | deflate_decompress), g: ($s | zlib_compress | zlib_decompress)}',
        "SELECT c_custkey, replace(lower(replace(replace(c_name, '#', '%23') || '%20%C3%A9%3F', 'Customer', '_')), '_', 'Customer') AS a, s AS b, s AS c, s AS d, s AS e, s AS f, s AS g FROM (SELECT *, c_name || ' é?' AS s FROM customer)",
        schema="c_custkey long, a string, b string, c string, d string, e string, f string, g string",
    ),
    "array_order": Query(
        "embeddings",
        ".[] | {vec_id, s: (.embedding | sort | .[0]), a: (.embedding | min), b: (.embedding | max), f: (.embedding | first), l: (.embedding | last), r: (.embedding | reverse | .[0]), n: (.embedding | length), k: (.embedding | keys | length), y: (.embedding | any(. > 0.2)), z: (.embedding | all(. < 0.9)), u: (.embedding | unique | length), h: (.embedding | has(3)), p: ([.embedding | .[] | select(. > 0)] | length), q: (.embedding[2:5] | length), w: (.embedding | sort_by(-.) | .[0])}",
        "SELECT vec_id, list_min(embedding) AS s, list_min(embedding) AS a, list_max(embedding) AS b, embedding[1] AS f, embedding[-1] AS l, embedding[-1] AS r, len(embedding) AS n, len(embedding) AS k, list_max(embedding) > 0.2 AS y, list_max(embedding) < 0.9 AS z, len(list_distinct(embedding))::BIGINT AS u, true AS h, len(list_filter(embedding, lambda x: x > 0))::BIGINT AS p, 3::BIGINT AS q, list_max(embedding) AS w FROM embeddings",
    ),
    "array_reshape": Query(
        "embeddings",
        ".[] | [.embedding[:4] | .[] * 1000 | floor] as $a | {vec_id, t: ([$a, $a] | transpose | length), f: ([$a, [$a]] | flatten | length), g: ([$a, [$a]] | flatten(1) | length), c: ([[1, 2], $a] | [combinations] | length), n: ($a | nth(1)), e: ($a | to_entries | map(.key) | add), i: ($a | sort | bsearch($a | min)), v: ($a | map_values(. + 1) | add - 4), w: ([$a[] | in([0, 1])] | length), o: ([$a | .[] as $x | $x] | length), r: ($a | [range(0; length; 2)]), l: ($a | [limit(2; .[])] | length), z: ([skip(1; $a[])] | length), d: ($a | del(.[0, 2]) | length), q: ($a | .[1:] |= map(. * 2) | add)}",
        "SELECT vec_id, 4 AS t, 8 AS f, 5 AS g, 8 AS c, a[2] AS n, 6 AS e, 0 AS i, list_sum(a) AS v, 4 AS w, 4 AS o, [0, 2] AS r, 2 AS l, 3 AS z, 2 AS d, list_sum(a) * 2 - a[1] AS q FROM (SELECT vec_id, list_transform(embedding[1:4], lambda x: floor(x::DOUBLE * 1000)::BIGINT) AS a FROM embeddings)",
        schema="vec_id long, t int, f int, g int, c int, n long, e int, i int, v long, w int, o int, r array<int>, l int, z int, d int, q long",
    ),
    "array_stats": Query(
        "embeddings",
        ".[] | [.embedding[] * 1000 | floor] as $a | {vec_id, s: sum($a), c: count($a), m: median($a), q: (quantile($a; 0.25) * 100 | round), v: (variance($a) | round), d: (stddev($a) | round), a: (avg($a) * 100 | round), f: (frequency([$a[] | . > 0]) | length), u: (union($a; [5000]) | last), x: (intersect($a; $a + [7000]) | length), e: (except($a; $a) | length)}",
        "SELECT vec_id, list_sum(a)::BIGINT AS s, len(a) AS c, list_median(a) AS m, round(list_aggregate(a, 'quantile_cont', 0.25) * 100)::DOUBLE AS q, round(list_var_pop(a))::DOUBLE AS v, round(list_stddev_pop(a))::DOUBLE AS d, round(list_avg(a) * 100)::DOUBLE AS a, len(list_distinct(list_transform(a, lambda x: x > 0)))::BIGINT AS f, 5000::BIGINT AS u, len(list_distinct(a))::BIGINT AS x, 0::BIGINT AS e FROM (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1000)::BIGINT) AS a FROM embeddings)",
        schema="vec_id long, s long, c long, m double, q double, v double, d double, a double, f long, u long, x long, e long",
    ),
    "array_order_rest": Query(
        "embeddings",
        ".[] | [.embedding[:8] | .[] * 1000 | floor] as $a | {vec_id, t: ([$a | top_k(2)] | .[0]), m: ($a | min_by(-.)), x: ($a | max_by(-.)), g: ($a | group_by(. > 0) | map(length) | add), u: ($a | unique_by(. > 0) | length), w: ([windows(2; $a[])] | .[-1] | length), s: ([moving_sum(2; $a[])] | .[-1]), v: ([moving_avg(2; $a[])] | .[0]), n: ([moving_min(3; $a[])] | .[-1]), y: ([moving_max(3; $a[])] | .[-1]), d: ([deltas($a[])] | add), l: ([lag($a[])] | length), c: ([counter($a[])] | add), r: ([running(. + $a[0]; $a[])] | length), e: (reduce $a[] as $x (0; . + $x)), f: [foreach $a[] as $x (0; . + 1)], k: ([1, null, 2, null] | fill_forward), p: ($a | IN($a, 5)), i: (INDEX($a[]; . > 0) | length)}",
        "SELECT vec_id, list_sort(a)[1:2] AS t, list_max(a) AS m, list_min(a) AS x, 8 AS g, len(list_distinct(list_transform(a, lambda x: x > 0))) AS u, 2 AS w, a[8] + a[7] AS s, a[1]::DOUBLE AS v, least(a[6], a[7], a[8]) AS n, greatest(a[6], a[7], a[8]) AS y, a[8] - a[1] AS d, 7 AS l, 36 AS c, 8 AS r, list_sum(a) AS e, [1, 2, 3, 4, 5, 6, 7, 8] AS f, [1, 1, 2, 2] AS k, true AS p, len(list_distinct(list_transform(a, lambda x: x > 0))) AS i FROM (SELECT vec_id, list_transform(embedding[1:8], lambda x: floor(x::DOUBLE * 1000)::BIGINT) AS a FROM embeddings)",
        schema="vec_id long, t array<long>, m long, x long, g int, u long, w int, s long, v double, n long, y long, d long, l int, c int, r int, e long, f array<int>, k array<int>, p boolean, i long",
    ),
    "objects": Query(
        "nation",
        ".[] | {a: .n_nationkey, b: {c: .n_name}} as $o | {n_nationkey, k: ($o | keys), u: ($o | keys_unsorted), h: ($o | has(\"b\")), e: ($o | to_entries | length), f: ([{key: \"x\", value: .n_name}] | from_entries), w: ({a: 1} | with_entries(.value += 1)), m: ({a: 1, b: 2} | map_values(. * 2)), d: ($o | del(.b)), p: ($o | pick(.b.c)), g: ($o | getpath([\"b\", \"c\"])), s: ({} | setpath([\"x\", 0]; 1)), x: ($o | delpaths([[\"a\"], [\"b\"]])), v: ([$o | paths] | length), q: [$o | paths(type == \"number\")], t: ([$o | tostream] | length), r: (fromstream($o | tostream) == $o), y: ($o | walk(if type == \"string\" then length else . end) | .b.c), z: ([$o | ..] | length), j: ([$o | path(.b.c)] | .[0])}",
        "SELECT n_nationkey, ['a', 'b'] AS k, ['a', 'b'] AS u, true AS h, 2 AS e, '{\"x\":\"' || n_name || '\"}' AS f, '{\"a\":2}' AS w, '{\"a\":2,\"b\":4}' AS m, '{\"a\":' || n_nationkey || '}' AS d, '{\"b\":{\"c\":\"' || n_name || '\"}}' AS p, n_name AS g, '{\"x\":[1]}' AS s, '{}' AS x, 3 AS v, '[[\"a\"]]' AS q, 4 AS t, true AS r, length(n_name)::INT AS y, 4 AS z, ['b', 'c'] AS j FROM nation",
        schema="n_nationkey int, k array<string>, u array<string>, h boolean, e int, f string, w string, m string, d string, p string, g string, s string, x string, v int, q string, t int, r boolean, y int, z int, j array<string>",
    ),
    "control": Query(
        "part",
        '.[] | {p_partkey, t: (try (if .p_size % 2 == 0 then error("even") else "odd" end) catch .), l: [label $f | .p_size, 1, 2 | if . == 1 then break $f else . end], u: (.p_size | until(. < 10; . / 2 | floor)), w: ([.p_size | while(. > 1; . / 2 | floor)] | length), r: [.p_size | limit(3; repeat(. * 2))], e: isempty(empty), f: first(.p_size, 9), g: [range(.p_size % 4)], h: [.p_size | recurse(if . < 3 then . + 1 else empty end)], q: [.p_size as [$a] ?// $a | $a], n: ([.p_size, "x", null, true, [1], {}] | [.[] | scalars] | length), k: ([1, "a", null, true, [], {}] | [(.[] | numbers), (.[] | strings), (.[] | booleans), (.[] | nulls), (.[] | arrays), (.[] | objects), (.[] | iterables), (.[] | values)] | length), y: [.p_size, 1 | type], d: (def f(x): if x > 100 then x else f(x * 2) end; f(.p_size)), o: (.p_size | . as $x | [1, 2] | map(. + $x) | add), a: [.p_size | (., 1) | select(. > 20) // 0], z: (try error catch "none"), s: ((.p_name | tonumber)? // "text"), x: ("true" | toboolean), c: ([limit(0; 1, 2)] | length)}',
        "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'even' ELSE 'odd' END AS t, CASE WHEN p_size = 1 THEN []::INT[] ELSE [p_size] END AS l, CASE WHEN p_size < 10 THEN p_size WHEN p_size < 20 THEN p_size // 2 WHEN p_size < 40 THEN p_size // 4 ELSE p_size // 8 END AS u, floor(log2(p_size))::INT AS w, [p_size * 2, p_size * 2, p_size * 2] AS r, true AS e, p_size AS f, list_transform(range(0, p_size % 4), lambda i: i::INT) AS g, CASE WHEN p_size < 3 THEN list_transform(range(p_size, 4), lambda i: i::INT) ELSE [p_size] END AS h, [p_size] AS q, 4 AS n, 13 AS k, ['number', 'number'] AS y, (p_size * pow(2, CASE WHEN p_size > 100 THEN 0 ELSE ceil(log2(100.5 / p_size)) END))::INT AS d, 3 + 2 * p_size AS o, CASE WHEN p_size > 20 THEN [p_size, 0] ELSE [0, 0] END AS a, 'none' AS z, 'text' AS s, true AS x, 0 AS c FROM part",
        schema="p_partkey int, t string, l array<int>, u int, w int, r array<int>, e boolean, f int, g array<int>, h array<int>, q array<int>, n int, k int, y array<string>, d int, o int, a array<int>, z string, s string, x boolean, c int",
    ),
    "error_rows": Query(
        "part",
        '.[] | if .p_size % 5 == 0 then error("five") else {p_partkey} end',
        "SELECT CASE WHEN p_size % 5 <> 0 THEN p_partkey END AS p_partkey, CASE WHEN p_size % 5 = 0 THEN 'five' END AS error FROM part",
        schema="p_partkey int",
        on_error="report",
    ),
    "optional_rows": Query("part", '.[] | {p_partkey, n: (.p_name | split(" ")[1] | tonumber)?}', "SELECT p_partkey, 0 AS n FROM part WHERE false", schema="p_partkey int, n int"),
    "network": Query(
        "nation",
        '.[] | "10.0.\\(.n_regionkey).\\(.n_nationkey)" as $a | {n_nationkey, v: ($a | ip_valid), w: ("::1" | ip_valid), x: ("nope" | ip_valid), f: ($a | ip_version), c: ($a | ip_class), n: ($a | ip_in_cidr("10.0.1.0/24")), k: ("::0001" | ip_canonical), e: (.n_name | edit_distance("nation_1")), s: (.n_name | similarity("NATION_1") * 100 | round), m: (.n_name | fuzzy_match("NATION_1"; 0.8)), r: (.n_name | redact("[0-9]+")), u: ("123E4567-E89B-12D3-A456-426614174000" | uuid)}',
        "SELECT n_nationkey, true AS v, true AS w, false AS x, 4 AS f, 'private' AS c, n_regionkey = 1 AS n, '::1' AS k, levenshtein(lower(n_name), 'nation_1')::INT AS e, round((1 - levenshtein(lower(n_name), 'nation_1') / greatest(length(n_name), 8)::DOUBLE) * 100)::INT AS s, 1 - levenshtein(lower(n_name), 'nation_1') / greatest(length(n_name), 8)::DOUBLE >= 0.8 AS m, 'NATION_[REDACTED]' AS r, '123e4567-e89b-12d3-a456-426614174000' AS u FROM nation",
        schema="n_nationkey int, v boolean, w boolean, x boolean, f int, c string, n boolean, k string, e int, s int, m boolean, r string, u string",
    ),
    "parsers": Query(
        "pages",
        '.[] | {page_id, h: (.url | parse_url.host), q: ("a=1&b=\\(.page_id)" | parse_query_string.b), l: ("level=info id=\\(.page_id) msg=\\"x y\\"" | parse_logfmt), g: ("id \\(.page_id) ok" | parse_grok("id %{INT:n} %{WORD:w}"))}',
        "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS h, page_id::VARCHAR AS q, '{\"level\":\"info\",\"id\":\"' || page_id || '\",\"msg\":\"x y\"}' AS l, '{\"n\":\"' || page_id || '\",\"w\":\"ok\"}' AS g FROM pages",
        schema="page_id long, h string, q string, l string, g string",
    ),
    "selectors": Query(
        "nation",
        '.[] | {a: [{k: .n_nationkey, s: .n_name}]} as $o | {n_nationkey, p: ($o | json_pointer("/a/0/k")), j: ($o | jsonpath("$.a[*].s")), t: ("<t id=\\"\\(.n_nationkey)\\"><b>x</b><b>\\(.n_name)</b></t>" | [xpath("//b")] | flatten | length), c: ("<div><p class=k>\\(.n_name)</p><p>y</p></div>" | [css("p.k")] | flatten | .[0].text), d: (diff($o; $o) | length)}',
        "SELECT n_nationkey, '[' || n_nationkey || ']' AS p, '[\"' || n_name || '\"]' AS j, 2 AS t, n_name AS c, 0 AS d FROM nation",
        schema="n_nationkey int, p string, j string, t int, c string, d int",
    ),
    "schemas": Query(
        "nation",
        '.[] | {type: "object", required: ["n_name"], properties: {n_nationkey: {type: "integer", maximum: 9}}} as $s | {n_nationkey, v: schema_validate(.; $s), e: (schema_errors(.; $s) | length), i: (schema_infer(.) | .type), d: (schema_diff(.; $s) | type)}',
        "SELECT n_nationkey, n_nationkey <= 9 AS v, (n_nationkey > 9)::INT AS e, 'object' AS i, 'array' AS d FROM nation",
        schema="n_nationkey int, v boolean, e int, i string, d string",
    ),
    "window_programs": Query("events", "group_by(.user_id) | .[] | [moving_sum(3; .[].event_id)] | {n: length, last: .[-1]}", "SELECT count(*) AS n, arg_max(s, (ts, event_id)) AS last FROM (SELECT user_id, ts, event_id, sum(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 2 PRECEDING)::BIGINT AS s FROM events) GROUP BY user_id", ("ts", "event_id"), schema="n long, last long"),
    "fold_programs": Query("events", "group_by(.user_id) | map({user_id: .[0].user_id, total: [foreach .[] as $r (0; . + $r.event_id)][-1], mean: ([running(if . == null then 0 else . + 1 end; .[])] | last)}) | .[]", "SELECT user_id, sum(event_id)::BIGINT AS total, count(*) - 1 AS mean FROM events GROUP BY 1", ("ts", "event_id"), schema="user_id long, total long, mean long"),
    "ewma_programs": Query(
        "events",
        "group_by(.user_id) | map({user_id: .[0].user_id, e: ([ewma(0.5; .[].event_id)] | last | . * 1000 | round)}) | .[]",
        "WITH RECURSIVE o AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events), f AS (SELECT user_id, r, event_id::DOUBLE AS e FROM o WHERE r = 1 UNION ALL SELECT o.user_id, o.r, 0.5::DOUBLE * o.event_id + 0.5::DOUBLE * f.e FROM f JOIN o ON o.user_id = f.user_id AND o.r = f.r + 1) SELECT user_id, round(arg_max(e, r) * 1000)::BIGINT AS e FROM f GROUP BY 1",
        ("ts", "event_id"),
        schema="user_id long, e long",
    ),
    "filter_pushed": Query("lineitem", ".[] | select(.l_quantity < 3 or .l_discount >= 0.1) | {l_orderkey, l_quantity}", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity < 3 OR l_discount >= 0.1", finite=True),
    "join_pairs": Query(
        "orders",
        "INDEX($customer[]; .c_custkey) as $ix | .[] | {o_orderkey, segment: $ix[.o_custkey | tostring].c_mktsegment, known: ($ix[.o_custkey | tostring].c_name != null)}",
        "SELECT o_orderkey, c_mktsegment AS segment, c_name IS NOT NULL AS known FROM orders LEFT JOIN customer ON c_custkey = o_custkey",
        (),
        ("customer",),
    ),
    "join_4": Query(
        "orders",
        "INDEX($customer[]; .c_custkey) as $ix | JOIN($ix; .[]; .o_custkey; {o_orderkey: .[0].o_orderkey, segment: .[1].c_mktsegment})",
        "SELECT o_orderkey, c_mktsegment AS segment FROM orders LEFT JOIN customer ON c_custkey = o_custkey",
        (),
        ("customer",),
    ),
    "join_3": Query("orders", "INDEX($customer[]; .c_custkey) as $ix | JOIN($ix; .[]; .o_custkey) | {o_orderkey: .[0].o_orderkey, name: .[1].c_name}", "SELECT o_orderkey, c_name AS name FROM orders LEFT JOIN customer ON c_custkey = o_custkey", (), ("customer",)),
    "join_2": Query("orders", "INDEX($customer[]; .c_custkey) as $ix | JOIN($ix; .o_custkey) | .[] | {o_orderkey: .[0].o_orderkey, name: .[1].c_name}", "SELECT o_orderkey, c_name AS name FROM orders LEFT JOIN customer ON c_custkey = o_custkey", (), ("customer",)),
    "histogram_fold": Query("events", "reduce .[] as $e ({}; .[$e.event_type] += 1) | to_entries | .[]", "SELECT event_type AS key, count(*) AS value FROM events GROUP BY 1"),
    "sums_by_key": Query("lineitem", "reduce .[] as $r ({}; .[$r.l_returnflag] += $r.l_quantity) | to_entries | map({flag: .key, total: .value}) | .[]", "SELECT l_returnflag AS flag, sum(l_quantity) AS total FROM lineitem GROUP BY 1"),
    "native_moving_sum": Query("events", "group_by(.user_id) | .[] | moving_sum(3; .[].event_id) | {out: .}", "SELECT sum(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 2 PRECEDING)::BIGINT AS out FROM events", ("ts", "event_id")),
    "native_moving_avg": Query("events", "group_by(.user_id) | .[] | moving_avg(4; .[].event_id) | {out: (. * 1000 | round)}", "SELECT round(avg(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 3 PRECEDING) * 1000)::DOUBLE AS out FROM events", ("ts", "event_id")),
    "native_moving_max": Query("events", "group_by(.user_id) | .[] | moving_max(3; .[].event_id) | {out: .}", "SELECT max(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 2 PRECEDING) AS out FROM events", ("ts", "event_id")),
    "native_moving_min": Query("events", "group_by(.user_id) | .[] | moving_min(3; .[].event_id) | {out: .}", "SELECT min(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 2 PRECEDING) AS out FROM events", ("ts", "event_id")),
    "native_windows": Query("events", "group_by(.user_id) | .[] | windows(2; .[].event_id) | {n: length, out: add}", "SELECT count(*) OVER w AS n, sum(event_id) OVER w::BIGINT AS out FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 1 PRECEDING)", ("ts", "event_id")),
    "native_lag": Query("events", "group_by(.user_id) | .[] | lag(.[].event_id) | {out: .}", "SELECT lag(event_id) OVER w AS out FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id) QUALIFY row_number() OVER w > 1", ("ts", "event_id")),
    "native_deltas": Query("events", "group_by(.user_id) | .[] | deltas(.[].event_id) | {out: .}", "SELECT event_id - lag(event_id) OVER w AS out FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id) QUALIFY row_number() OVER w > 1", ("ts", "event_id")),
    "native_counter": Query("events", "group_by(.user_id) | .[] | counter(.[].event_id) | {out: .}", "SELECT row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS out FROM events", ("ts", "event_id")),
}
