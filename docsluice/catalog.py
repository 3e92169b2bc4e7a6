"""Registered queries over the fixture tables, each a program of the filter language, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsluice.families import FAMILIES, Query
from docsluice.operators import windows
from docsluice.operators.reshape import differences
from docsluice.sources.tables import decoded, encoded

FLAGSHIP = Query(
    "lineitem",
    "group_by(.l_returnflag, .l_linestatus) | map({l_returnflag: .[0].l_returnflag, l_linestatus: .[0].l_linestatus, sum_qty: (map(.l_quantity) | add), n: length}) | .[]",
    "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, count(*) AS n FROM lineitem GROUP BY ALL",
)

QUERIES: dict[str, Query] = {
    "group_by_agg": FLAGSHIP,
    "select_filter": Query(
        "lineitem",
        ".[] | select(.l_discount > 0.05 and .l_quantity < 24) | {l_orderkey, l_linenumber, l_quantity, l_discount}",
        "SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem WHERE l_discount > 0.05 AND l_quantity < 24",
        finite=True,
    ),
    "project_construct": Query("orders", ".[] | {key: .o_orderkey, double_price: (.o_totalprice * 2)}", "SELECT o_orderkey AS key, o_totalprice * 2 AS double_price FROM orders"),
    "alternative": Query(
        "customer",
        '.[] | {c_custkey, segment: (if .c_acctbal < 0 then null else .c_mktsegment end // "none")}',
        "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'none' ELSE c_mktsegment END AS segment FROM customer",
    ),
    "cond_if": Query(
        "part",
        '.[] | {p_partkey, class: (if .p_size < 10 then "small" elif .p_size < 30 then "middle" else "large" end)}',
        "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'middle' ELSE 'large' END AS class FROM part",
    ),
    "add_fold": Query("lineitem", "{total: (map(.l_quantity) | add), n: length}", "SELECT sum(l_quantity) AS total, count(*) AS n FROM lineitem"),
    "reduce_sum": Query("lineitem", "{total: reduce .[] as $r (0; . + $r.l_quantity)}", "SELECT sum(l_quantity) AS total FROM lineitem"),
    "any_all": Query(
        "orders",
        "{some: any(.[]; .o_totalprice > 1000), every: all(.[]; .o_totalprice > 1000)}",
        "SELECT bool_or(o_totalprice > 1000) AS some, bool_and(o_totalprice > 1000) AS every FROM orders",
    ),
    "unique_values": Query("part", "map(.p_brand) | unique | .[] | {brand: .}", "SELECT DISTINCT p_brand AS brand FROM part"),
    "unique_by": Query(
        "orders",
        "unique_by(.o_orderpriority) | .[] | {o_orderpriority, o_orderkey}",
        "SELECT o_orderpriority, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1",
        ("o_orderkey",),
    ),
    "min_by": Query("orders", "min_by(.o_totalprice) | {o_orderkey, o_totalprice}", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 1", ("o_orderkey",)),
    "max_by": Query("orders", "max_by(.o_totalprice) | {o_orderkey, o_totalprice}", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 1", ("o_orderkey",)),
    "group_extreme": Query(
        "orders",
        "group_by(.o_custkey) | map(max_by(.o_totalprice)) | .[] | {o_custkey, o_orderkey}",
        "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey DESC) = 1",
        ("o_orderkey",),
    ),
    "sort_by_slice": Query(
        "orders", "sort_by(.o_totalprice) | .[5:25] | .[] | {o_orderkey, o_totalprice}", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 20 OFFSET 5", ("o_orderkey",)
    ),
    "top_k": Query(
        "orders", "top_k(10; .o_totalprice) | .[] | {o_orderkey, o_totalprice}", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 10", ("o_orderkey",)
    ),
    "reverse_first": Query("orders", "sort_by(.o_orderkey) | reverse | .[:3] | .[] | {o_orderkey}", "SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 3", ("o_orderkey",)),
    "limit_items": Query("nation", "limit(5; .[]) | {n_nationkey, n_name}", "SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey LIMIT 5", ("n_nationkey",)),
    "skip_items": Query("nation", "skip(20; .[]) | {n_nationkey, n_name}", "SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey OFFSET 20", ("n_nationkey",)),
    "stats": Query(
        "lineitem",
        "{med: median(map(.l_quantity)), mean: ((avg(map(.l_quantity)) * 1000 | round) / 1000), dev: ((stddev(map(.l_quantity)) * 1000 | round) / 1000)}",
        "SELECT quantile_cont(l_quantity, 0.5) AS med, round(avg(l_quantity) * 1000) / 1000 AS mean, round(stddev_pop(l_quantity) * 1000) / 1000 AS dev FROM lineitem",
    ),
    "frequency": Query(
        "events",
        "group_by(.event_type) | map({event_type: .[0].event_type, n: length}) | .[]",
        "SELECT event_type, count(*) AS n FROM events GROUP BY 1",
    ),
    "distinct_users": Query(
        "events",
        "group_by(.event_type) | map({event_type: .[0].event_type, users: (map(.user_id) | unique | length)}) | .[]",
        "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY 1",
    ),
    "join_correlated": Query(
        "orders",
        ".[] as $o | $customer[] | select(.c_custkey == $o.o_custkey and .c_acctbal > 5000) | {o_orderkey: $o.o_orderkey, c_name}",
        "SELECT o_orderkey, c_name FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal > 5000",
        (),
        ("customer",),
        finite=True,
    ),
    "semi_any": Query(
        "customer",
        ".[] as $c | $c | select(any($orders[]; .o_custkey == $c.c_custkey)) | {c_custkey}",
        "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)",
        (),
        ("orders",),
    ),
    "anti_all": Query(
        "nation",
        ".[] as $n | $n | select(all($region[]; .r_regionkey != $n.n_nationkey)) | {n_nationkey, n_name}",
        "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey NOT IN (SELECT r_regionkey FROM region)",
        (),
        ("region",),
    ),
    "join_index": Query(
        "orders",
        "INDEX($customer[]; .c_custkey) as $ix | .[] | {o_orderkey, c_name: $ix[.o_custkey | tostring].c_name}",
        "SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey",
        (),
        ("customer",),
    ),
    "theta_join": Query(
        "nation",
        ".[] as $n | $region[] | select(.r_regionkey < $n.n_regionkey) | {n_name: $n.n_name, r_name}",
        "SELECT n_name, r_name FROM nation JOIN region ON r_regionkey < n_regionkey",
        (),
        ("region",),
    ),
    "strings": Query(
        "part",
        '.[] | {p_partkey, up: (.p_name | ascii_upcase), n: (.p_name | length), bytes: (.p_name | utf8bytelength), hash: (.p_brand | startswith("Brand")), cut: (.p_brand | ltrimstr("Brand")), at: (.p_name | index("a"))}',
        "SELECT p_partkey, upper(p_name) AS up, length(p_name) AS n, strlen(p_name) AS bytes, starts_with(p_brand, 'Brand') AS hash, CASE WHEN starts_with(p_brand, 'Brand') THEN substr(p_brand, 6) ELSE p_brand END AS cut, (nullif(strpos(p_name, 'a'), 0) - 1)::INT AS at FROM part",
    ),
    "split_words": Query("part", '.[] | {p_partkey, word: (.p_name | split(" ")[0])}', "SELECT p_partkey, string_split(p_name, ' ')[1] AS word FROM part"),
    "regex_test": Query(
        "documents",
        '.[] | {doc_id, digits: (.text | test("[0-9]{3}")), clean: (.text | gsub("[0-9]+"; "#") | length)}',
        "SELECT doc_id, regexp_matches(text, '[0-9]{3}') AS digits, length(regexp_replace(text, '[0-9]+', '#', 'g')) AS clean FROM documents",
    ),
    "math": Query(
        "part",
        ".[] | {p_partkey, root: (.p_retailprice | sqrt * 1000 | floor), low: (.p_retailprice | floor), pow: pow(.p_size; 2), left: (.p_size % 7)}",
        "SELECT p_partkey, floor(sqrt(p_retailprice) * 1000)::BIGINT AS root, floor(p_retailprice)::BIGINT AS low, pow(p_size, 2)::DOUBLE AS pow, (p_size % 7) AS left FROM part",
    ),
    "hashes": Query(
        "customer",
        ".[] | {c_custkey, m: (.c_name | md5), s: (.c_name | sha256), b: (.c_name | @base64), h: (.c_name | hex_encode)}",
        "SELECT c_custkey, md5(c_name) AS m, sha256(c_name) AS s, base64(c_name::BLOB) AS b, lower(hex(c_name)) AS h FROM customer",
    ),
    "formats": Query(
        "region",
        '.[] | {r_regionkey, html: ("<" + .r_name + ">" | @html), csv: ([.r_regionkey, .r_name] | @csv)}',
        "SELECT r_regionkey, '&lt;' || r_name || '&gt;' AS html, r_regionkey || ',\"' || r_name || '\"' AS csv FROM region",
    ),
    "interpolation": Query("nation", '.[] | {line: "\\(.n_name)=\\(.n_regionkey)"}', "SELECT n_name || '=' || n_regionkey AS line FROM nation"),
    "array_of_row": Query(
        "embeddings",
        ".[] | {vec_id, n: (.embedding | length), first: .embedding[0]}",
        "SELECT vec_id, len(embedding) AS n, embedding[1] AS first FROM embeddings",
    ),
    "explode_array": Query(
        "embeddings",
        ".[] as $r | $r.embedding[] | select(. > 0.2) | {vec_id: $r.vec_id, x: .}",
        "SELECT vec_id, x FROM (SELECT vec_id, unnest(embedding) AS x FROM embeddings) WHERE x > 0.2",
    ),
    "slurp_conversation": Query(
        "conversations",
        "group_by(.conv_id) | map({conv_id: .[0].conv_id, n: length, last: .[-1].role}) | .[]",
        "SELECT conv_id, count(*) AS n, arg_max(role, turn) AS last FROM conversations GROUP BY 1",
        ("conv_id", "turn"),
    ),
    "del_keys": Query("nation", ".[] | del(.n_regionkey)", "SELECT n_nationkey, n_name FROM nation"),
    "update_field": Query("nation", '.[] | .n_name |= ascii_downcase', "SELECT n_nationkey, lower(n_name) AS n_name, n_regionkey FROM nation"),
    "parse_url": Query("pages", ".[] | {page_id, host: (.url | parse_url.host)}", "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host FROM pages"),
    "edit_distance": Query(
        "part", '.[] | {p_partkey, d: (.p_type | edit_distance("promo tin"))}', "SELECT p_partkey, levenshtein(lower(p_type), 'promo tin') AS d FROM part"
    ),
    "set_union": Query("nation", "union(map(.n_nationkey); $region | map(.r_regionkey)) | .[] | {key: .}", "SELECT n_nationkey AS key FROM nation UNION SELECT r_regionkey FROM region", (), ("region",)),
    "set_intersect": Query("nation", "intersect(map(.n_nationkey); $region | map(.r_regionkey)) | .[] | {key: .}", "SELECT n_nationkey AS key FROM nation INTERSECT SELECT r_regionkey FROM region", (), ("region",)),
    "set_except": Query("nation", "except(map(.n_nationkey); $region | map(.r_regionkey)) | .[] | {key: .}", "SELECT n_nationkey AS key FROM nation EXCEPT SELECT r_regionkey FROM region", (), ("region",)),
    "melt": Query(
        "part",
        'map({p_partkey, p_brand, p_type}) | melt(["p_partkey"]; ["p_brand", "p_type"]; "k"; "v") | .[]',
        "SELECT p_partkey, 'p_brand' AS k, p_brand AS v FROM part UNION ALL SELECT p_partkey, 'p_type', p_type FROM part",
    ),
    "semi_in": Query("customer", ".[] | select(.c_custkey | IN($orders[].o_custkey)) | {c_custkey}", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)", (), ("orders",)),
    "filtered_counts": Query(
        "orders",
        'group_by(.o_orderpriority) | map({o_orderpriority: .[0].o_orderpriority, open: (map(select(.o_orderstatus == "O")) | length), most: (map(.o_totalprice) | max)}) | .[]',
        "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'O') AS open, max(o_totalprice) AS most FROM orders GROUP BY 1",
    ),
    "group_min_by": Query(
        "events",
        "group_by(.user_id) | map({user_id: .[0].user_id, first_event: min_by(.event_id).event_id}) | .[]",
        "SELECT user_id, min(event_id) AS first_event FROM events GROUP BY 1",
        ("event_id",),
    ),
    "having_groups": Query(
        "orders",
        "group_by(.o_custkey) | map({o_custkey: .[0].o_custkey, n: length}) | .[] | select(.n > 12)",
        "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12",
    ),
}


#: Columns that make the sequences of events, and put each in order.
USER, TIME = ["user_id"], ["ts", "event_id"]


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "ts", F.round("value", 2).cast("decimal(18,2)").alias("v"))


def _out(df: DataFrame) -> DataFrame:
    return df.select("event_id", F.col("out").cast("double").alias("out"))


#: Window functions: what each does to the events, and the same in SQL over `e` (event_id, v) with the window w.
WINDOWS: dict[str, tuple[Callable[[DataFrame], DataFrame], str]] = {
    "moving_sum": (lambda e: windows.trailing(e, "moving_sum", "v", 3, USER, TIME, "out"), "sum(v) OVER (w ROWS 2 PRECEDING)"),
    "moving_min": (lambda e: windows.trailing(e, "moving_min", "v", 3, USER, TIME, "out"), "min(v) OVER (w ROWS 2 PRECEDING)"),
    "moving_max": (lambda e: windows.trailing(e, "moving_max", "v", 3, USER, TIME, "out"), "max(v) OVER (w ROWS 2 PRECEDING)"),
    "counter": (lambda e: windows.counter(e, USER, TIME, "out"), "row_number() OVER w"),
    "lag": (lambda e: windows.lag(e, "v", USER, TIME, "out"), "lag(v) OVER w"),
    "deltas": (lambda e: windows.deltas(e, "v", USER, TIME, "out"), "v - lag(v) OVER w"),
    "fill_forward": (lambda e: windows.fill_forward(e.withColumn("v", F.when(F.col("event_id") % 3 == 0, F.col("v"))), "v", USER, TIME, "out"), "last_value(CASE WHEN event_id % 3 = 0 THEN v END IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING)"),
}


def _window_sql(name: str) -> str:
    rest = " QUALIFY row_number() OVER w > 1" if name in ("lag", "deltas") else ""
    source = "(SELECT event_id, user_id, ts, round(value, 2)::DECIMAL(18,2) AS v FROM events)"
    return f"SELECT event_id, ({WINDOWS[name][1]})::DOUBLE AS out FROM {source} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)" + rest


def _window_query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _out(WINDOWS[name][0](_events(spark, sf_dir)))


#: Formats that each row is written in and read from again: how it is written, the format to read, and the program that gets the row back.
FORMATS: dict[str, tuple[str, str, str, str]] = {
    "json": (".", "json", "json", "."),
    "jsonc": (".", "json", "jsonc", "."),
    "json5": (".", "json", "json5", "."),
    "ndjson": ("., {n_nationkey: -1}", "ndjson", "ndjson", "select(.n_nationkey >= 0)"),
    "json_seq": (".", "json-seq", "json-seq", "."),
    "yaml": (".", "yaml", "yaml", "."),
    "toml": (".", "toml", "toml", "."),
    "cbor": (".", "cbor", "cbor", "."),
    "msgpack": (".", "msgpack", "msgpack", "."),
    "csv": (".", "csv", "csv-header", ".n_nationkey |= tonumber | .n_regionkey |= tonumber"),
    "tsv": (".", "tsv", "tsv-header", ".n_nationkey |= tonumber | .n_regionkey |= tonumber"),
    "ini": (".", "ini", "ini", ".n_nationkey |= tonumber | .n_regionkey |= tonumber"),
    "properties": (".", "properties", "properties", ".n_nationkey |= tonumber | .n_regionkey |= tonumber"),
    "dotenv": (".", "dotenv", "dotenv", ".n_nationkey |= tonumber | .n_regionkey |= tonumber"),
    "xml": ('{row: {"@n": .n_nationkey, "@r": .n_regionkey, "#text": .n_name}}', "xml", "xml", '.row | {n_nationkey: (.["@n"] | tonumber), n_regionkey: (.["@r"] | tonumber), n_name: .["#text"]}'),
    "html": ('{p: {"@n": .n_nationkey, "@r": .n_regionkey, "#text": .n_name}}', "html", "html", '.html.body.p | {n_nationkey: (.["@n"] | tonumber), n_regionkey: (.["@r"] | tonumber), n_name: .["#text"]}'),
    "lines": ('"\\(.n_nationkey) \\(.n_regionkey) \\(.n_name)"', "lines", "lines", 'split(" ") | {n_nationkey: (.[0] | tonumber), n_regionkey: (.[1] | tonumber), n_name: .[2]}'),
}


def _format_query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    write, form, back, read = FORMATS[name]
    schema = "n_nationkey int, n_name string, n_regionkey int"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        documents = encoded(spark.read.parquet(f"{sf_dir}/nation.parquet"), form, program=write)
        return decoded(documents, "content", back, schema, read)

    return run


def diff_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders against a copy with some rows gone, some new and some with another price."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus", "o_totalprice")
    other = orders.where("o_orderkey % 10 <> 3").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 7 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    other = other.unionByName(orders.where("o_orderkey % 50 = 1").withColumn("o_orderkey", -F.col("o_orderkey")))
    return differences(orders, other, ["o_orderkey"])


DIFF_SQL = """
SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 3 THEN 'removed' ELSE 'changed' END AS change, CASE WHEN o_orderkey % 10 = 3 THEN []::VARCHAR[] ELSE ['o_totalprice'] END AS fields
FROM orders WHERE o_orderkey % 10 = 3 OR o_orderkey % 7 = 0
UNION ALL SELECT -o_orderkey, 'added', []::VARCHAR[] FROM orders WHERE o_orderkey % 50 = 1
"""


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FLAGSHIP(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return QUERIES | FAMILIES | {"diff_tables": diff_tables} | {f"window_{name}": _window_query(name) for name in WINDOWS} | {f"format_{name}": _format_query(name) for name in FORMATS}


def oracle_sql() -> dict[str, str]:
    return {name: q.sql for name, q in (QUERIES | FAMILIES).items() if q.sql} | {"diff_tables": DIFF_SQL} | {f"window_{name}": _window_sql(name) for name in WINDOWS} | {f"format_{name}": "SELECT n_nationkey, n_name, n_regionkey FROM nation" for name in FORMATS}
