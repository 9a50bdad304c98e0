"""Queries over trees made from the driver's tables, and their SQL.

``heap``: parts as a binary tree by key; ``recursive``: events as an irregular
tree; ``sales``: regions, nations, customers and orders as a forest; ``conv``:
turns of conversations as chains, a tree each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from grove.functions import columns
from grove.operators import checks, counts, marks, orders, pairs, representation, sampling, traits, transforms
from grove.sources import newick, spop, trees

Query = Callable[[SparkSession, str], DataFrame]


def heap(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size", "p_name")
    n = part.count()
    key = F.col("p_partkey")
    return part.filter(key < n - (n + 1) % 2).select(
        key.alias("id"),
        F.greatest(F.floor((key - 1) / 2), F.lit(0)).cast("long").alias("ancestor_id"),
        (key * 10 + F.col("p_size") % 10).cast("double").alias("origin_time"),
        F.col("p_size").cast("long").alias("v"),
    )


def recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("event_id")
    up = F.when(key == 0, F.lit(0)).otherwise(F.try_mod(key * 7919 + 104729, key)).cast("long")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        key.alias("id"), up.alias("ancestor_id"), key.cast("double").alias("origin_time"), (key * 37 % 101).alias("v"), "event_type"
    )


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    row = lambda own, up, level: [own.cast("long").alias("id"), up.cast("long").alias("ancestor_id"), F.lit(float(level)).alias("origin_time")]
    c = F.col
    out = read("region").select(*row(c("r_regionkey"), c("r_regionkey"), 0))
    out = out.union(read("nation").select(*row(c("n_nationkey") + 100, c("n_regionkey"), 1)))
    out = out.union(read("customer").select(*row(c("c_custkey") + 1000, c("c_nationkey") + 100, 2)))
    return out.union(read("orders").select(*row(c("o_orderkey") + 10_000_000, c("o_custkey") + 1000, 3)))


def conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1).cast("long")
    out = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").alias("tree_id"), at.alias("id"), F.length("text").cast("long").alias("v"))
    return out.select("tree_id", "id", F.greatest(F.col("id") - 1, F.lit(0)).alias("ancestor_id"), F.col("id").cast("double").alias("origin_time"), "v")


#: The same trees in DuckDB's SQL.
TREES = {
    "heap": """SELECT p_partkey AS id, CASE WHEN p_partkey = 0 THEN 0 ELSE (p_partkey - 1) // 2 END AS ancestor_id,
      (p_partkey * 10 + p_size % 10)::DOUBLE AS origin_time, p_size::BIGINT AS v
      FROM part WHERE p_partkey < (SELECT count(*) - (count(*) + 1) % 2 FROM part)""",
    "recursive": """SELECT event_id AS id, CASE WHEN event_id = 0 THEN 0 ELSE (event_id * 7919 + 104729) % event_id END AS ancestor_id,
      event_id::DOUBLE AS origin_time, event_id * 37 % 101 AS v, event_type FROM events""",
    "sales": """SELECT r_regionkey::BIGINT AS id, r_regionkey::BIGINT AS ancestor_id, 0.0::DOUBLE AS origin_time FROM region
      UNION ALL SELECT n_nationkey + 100, n_regionkey, 1.0 FROM nation
      UNION ALL SELECT c_custkey + 1000, c_nationkey + 100, 2.0 FROM customer
      UNION ALL SELECT o_orderkey + 10000000, o_custkey + 1000, 3.0 FROM orders""",
    "conv": """SELECT conv_id AS tree_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS id, length(text)::BIGINT AS v FROM conversations""",
}
#: Helper tables: closure, children, leaves, depth, sizes, sisters.
HELPERS = """
t AS ({tree}),
cl AS (SELECT id AS anc, id, 0 AS dist FROM t UNION ALL
       SELECT p.ancestor_id, cl.id, cl.dist + 1 FROM cl JOIN t p ON p.id = cl.anc WHERE p.id <> p.ancestor_id),
ch AS (SELECT ancestor_id AS id, count(*) AS n, min(id) AS a, max(id) AS b FROM t WHERE id <> ancestor_id GROUP BY 1),
lf AS (SELECT id FROM t WHERE id NOT IN (SELECT ancestor_id FROM t WHERE id <> ancestor_id)),
dp AS (SELECT id, max(dist)::BIGINT AS d FROM cl GROUP BY id),
nl AS (SELECT anc AS id, count(*) AS n FROM cl WHERE id IN (SELECT id FROM lf) GROUP BY anc),
sz AS (SELECT anc AS id, count(*) AS n FROM cl GROUP BY anc),
sis AS (SELECT x.id, coalesce(y.id, x.id) AS s FROM t x LEFT JOIN t y
        ON x.ancestor_id = y.ancestor_id AND x.id <> y.id AND x.id <> x.ancestor_id AND y.id <> y.ancestor_id),
mx AS (SELECT anc AS id, max(t.origin_time) AS m FROM cl JOIN t USING (id) GROUP BY anc)
"""
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, tree: str, make: Callable[[DataFrame], DataFrame], sql: str | None = None, more: str = "") -> None:
    """Register a query over a tree; ``sql`` may use the helper tables and those in ``more``."""
    source = {"heap": heap, "recursive": recursive, "sales": sales, "conv": conv}[tree]
    QUERIES[name] = lambda spark, sf_dir: make(source(spark, sf_dir))
    if sql:
        base = TREES[tree]
        if tree == "conv":
            helpers = f"t0 AS ({base}), t AS (SELECT tree_id, id, greatest(id - 1, 0) AS ancestor_id, id::DOUBLE AS origin_time, v FROM t0)"
        else:
            helpers = HELPERS.format(tree=base)
        ORACLES[name] = f"WITH RECURSIVE {helpers}{',' + more if more else ''} {sql}"


def marked(name: str, tree: str, sql_value: str, source: str = "t", function: Callable | None = None, *, only: str | None = None, round_to: int | None = None, **options) -> None:
    """A query of (id, mark) from the mark of that name."""
    column = only or name.removeprefix("mark_")
    apply = function or getattr(marks, name, None) or getattr(traits, name)
    value = lambda: F.round(column, round_to).alias(column) if round_to else F.col(column)
    query(name, tree, lambda df: apply(df, **options).select("id", value()), f"SELECT t.id, {sql_value} AS {column} FROM {source}")


def one(name: str, tree: str, function: Callable[[DataFrame], DataFrame], sql: str) -> None:
    """A query of one row."""
    query(name, tree, function, sql)


# ---------------------------------------------------------------- flagship
query(
    "sales_depth_summary",
    "sales",
    lambda df: marks.mark_node_depth(marks.mark_num_children(marks.mark_leaves(df)))
    .groupBy("node_depth")
    .agg(F.count(F.lit(1)).alias("nodes"), F.count_if("is_leaf").alias("leaves"), F.sum("num_children").alias("children")),
    """SELECT d AS node_depth, count(*) AS nodes, count(*) FILTER (t.id IN (SELECT id FROM lf)) AS leaves, sum(coalesce(ch.n, 0))::BIGINT AS children
    FROM t JOIN dp USING (id) LEFT JOIN ch USING (id) GROUP BY d""",
)

# ---------------------------------------------------------------- one hop
marked("mark_roots", "sales", "t.id = t.ancestor_id", only="is_root")
marked("mark_leaves", "sales", "t.id IN (SELECT id FROM lf)", only="is_leaf")
marked("mark_oldest_root", "sales", "t.id = (SELECT min(id) FROM t WHERE id = ancestor_id)", only="is_oldest_root")
marked("mark_num_children", "recursive", "coalesce(ch.n, 0)", "t LEFT JOIN ch ON ch.id = t.id")
marked("mark_ancestor_origin_time", "recursive", "p.origin_time", "t JOIN t p ON p.id = t.ancestor_id")
marked("mark_origin_time_delta", "recursive", "t.origin_time - p.origin_time", "t JOIN t p ON p.id = t.ancestor_id")
marked("mark_first_child_id", "recursive", "coalesce(ch.a, t.id)", "t LEFT JOIN ch ON ch.id = t.id")
_W = "OVER (PARTITION BY t.ancestor_id, t.id = t.ancestor_id ORDER BY t.id)"
marked("mark_next_sibling_id", "recursive", f"CASE WHEN t.id = t.ancestor_id THEN t.id ELSE coalesce(lead(t.id) {_W}, t.id) END")
marked("mark_prev_sibling_id", "recursive", f"CASE WHEN t.id = t.ancestor_id THEN t.id ELSE coalesce(lag(t.id) {_W}, t.id) END")
marked("mark_left_child", "heap", "coalesce(ch.a, t.id)", "t LEFT JOIN ch ON ch.id = t.id", only="left_child_id")
marked("mark_right_child", "heap", "coalesce(ch.b, t.id)", "t LEFT JOIN ch ON ch.id = t.id", only="right_child_id")
marked("mark_is_left_child", "heap", "t.id <> t.ancestor_id AND t.id = ch.a", "t JOIN ch ON ch.id = t.ancestor_id")
marked("mark_is_right_child", "heap", "t.id <> t.ancestor_id AND t.id = ch.b", "t JOIN ch ON ch.id = t.ancestor_id")
marked("mark_sister", "heap", "sis.s", "t JOIN sis ON sis.id = t.id", only="sister_id")
marked("mark_csr_offsets", "recursive", "coalesce(sum(coalesce(ch.n, 0)) OVER (ORDER BY t.id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT", "t LEFT JOIN ch ON ch.id = t.id")
query(
    "mark_csr_children",
    "recursive",
    lambda df: marks.mark_csr_children(df).select("id", "csr_children"),
    """SELECT a.id, coalesce(b.id, -1) AS csr_children FROM (SELECT id, row_number() OVER (ORDER BY id) AS r FROM t) a
    LEFT JOIN (SELECT id, row_number() OVER (ORDER BY ancestor_id, id) AS r FROM t WHERE id <> ancestor_id) b USING (r)""",
)

# ---------------------------------------------------------------- lineages
marked("mark_node_depth", "recursive", "dp.d", "t JOIN dp ON dp.id = t.id")
marked("mark_root_id", "sales", "cl.anc", "t JOIN cl ON cl.id = t.id JOIN t r ON r.id = cl.anc AND r.id = r.ancestor_id")
_UP, _DOWN = "(SELECT {f} FROM cl JOIN t x ON x.id = cl.anc WHERE cl.id = t.id)", "(SELECT {f} FROM cl JOIN t x ON x.id = cl.id WHERE cl.anc = t.id)"
for _name, _f in (("sum", "sum(x.v)::DOUBLE"), ("max", "max(x.v)::DOUBLE"), ("min", "min(x.v)::DOUBLE")):
    _apply = getattr(marks, f"mark_lineage_cum{_name}")
    marked(f"mark_lineage_cum{_name}", "recursive", _UP.format(f=_f), function=_apply, values="v")
    query(
        f"mark_lineage_cum{_name}_reverse",
        "heap",
        lambda df, a=_apply, n=_name: a(df, "v", reverse=True).select("id", f"lineage_cum{n}"),
        f"SELECT t.id, {_DOWN.format(f=_f)} AS lineage_cum{_name} FROM t",
    )
query(
    "mark_lineage_cumprod",
    "heap",
    lambda df: marks.mark_lineage_cumprod(df, F.col("v") % 2 + 1).select("id", "lineage_cumprod"),
    f"SELECT t.id, {_UP.format(f='pow(2.0, sum(x.v % 2))')} AS lineage_cumprod FROM t",
)
query(
    "mask_descendants",
    "recursive",
    lambda df: marks.mask_descendants(df, ancestor_mask=F.col("v") == 7).select("id", "mask_descendants"),
    f"SELECT t.id, {_UP.format(f='bool_or(x.v = 7)')} AS mask_descendants FROM t",
)
query(
    "mark_num_preceding_leaves",
    "heap",
    lambda df: marks.mark_num_preceding_leaves(df).select("id", "num_preceding_leaves"),
    """SELECT t.id, (SELECT coalesce(sum(nl.n), 0)::BIGINT FROM cl JOIN t x ON x.id = cl.anc JOIN ch ON ch.id = x.ancestor_id JOIN nl ON nl.id = ch.a
    WHERE cl.id = t.id AND x.id <> x.ancestor_id AND x.id = ch.b) AS num_preceding_leaves FROM t""",
)
query("unfurl_lineage", "recursive", lambda df: marks.unfurl_lineage(df, 999), "SELECT dist::BIGINT AS ord, anc AS id FROM cl WHERE id = 999")
query(
    "calc_clade_lookback_n",
    "recursive",
    lambda df: marks.calc_clade_lookback_n(df, 3).select("id", "lookback_id"),
    "SELECT id, anc AS lookback_id FROM (SELECT id, anc, row_number() OVER (PARTITION BY id ORDER BY dist DESC) AS r FROM cl WHERE dist <= 3) WHERE r = 1",
)
query(
    "calc_clade_lookback_origin_time_delta",
    "recursive",
    lambda df: traits.calc_clade_lookback_origin_time_delta(df, 100.0).select("id", "lookback_id"),
    """SELECT t.id, coalesce((SELECT arg_min(cl.anc, cl.dist) FROM cl JOIN t x ON x.id = cl.anc WHERE cl.id = t.id AND x.origin_time <= t.origin_time - 100),
    (SELECT arg_max(cl.anc, cl.dist) FROM cl WHERE cl.id = t.id)) AS lookback_id FROM t""",
)

# ---------------------------------------------------------------- clades
marked("mark_num_descendants", "recursive", "sz.n - 1", "t JOIN sz ON sz.id = t.id")
marked("mark_num_leaves", "recursive", "nl.n", "t JOIN nl ON nl.id = t.id")
marked("mark_num_leaves_sibling", "recursive", "p.n - nl.n", "t JOIN nl ON nl.id = t.id JOIN nl p ON p.id = t.ancestor_id")
marked("mark_max_descendant_origin_time", "recursive", "mx.m", "t JOIN mx ON mx.id = t.id")
marked("mark_clade_duration", "recursive", "mx.m - t.origin_time", "t JOIN mx ON mx.id = t.id")
_SINCE = "mx.m - CASE WHEN t.id = t.ancestor_id THEN 0.0 ELSE p.origin_time END"
marked("mark_clade_subtended_duration", "recursive", _SINCE, "t JOIN mx ON mx.id = t.id JOIN t p ON p.id = t.ancestor_id")
marked("mark_clade_faithpd", "recursive", "(SELECT coalesce(sum(x.origin_time - p.origin_time), 0.0) FROM cl JOIN t x ON x.id = cl.id JOIN t p ON p.id = x.ancestor_id WHERE cl.anc = t.id AND cl.dist > 0)")
marked("mark_sackin_index", "recursive", "(SELECT coalesce(sum(nl.n), 0)::BIGINT FROM cl JOIN nl ON nl.id = cl.id WHERE cl.anc = t.id AND cl.dist > 0)")
_COLLESS = "(SELECT coalesce(sum(abs(l.n - r.n)), 0)::BIGINT FROM cl JOIN ch ON ch.id = cl.id JOIN nl l ON l.id = ch.a JOIN nl r ON r.id = ch.b WHERE cl.anc = t.id)"
marked("mark_colless_index", "heap", _COLLESS)
marked("mark_colless_index_corrected", "heap", f"CASE WHEN nl.n > 2 THEN round(2.0 * {_COLLESS} / ((nl.n - 1.0) * (nl.n - 2.0)), 9) ELSE 0.0 END", "t JOIN nl ON nl.id = t.id", round_to=9)
_FS = "fs AS (SELECT cl.anc AS id, sum(ln(coalesce(ch.n, 0) + exp(1.0::DOUBLE))) AS s FROM cl LEFT JOIN ch ON ch.id = cl.id GROUP BY 1)"
for _name, _f in (
    ("mdm", "(SELECT avg(abs(c.s - m.m)) FROM k c JOIN (SELECT p, median(s) AS m FROM k GROUP BY p) m ON m.p = c.p WHERE c.p = q.p)"),
    ("sd", "stddev_samp(q.s)"),
    ("var", "var_samp(q.s)"),
):
    query(
        f"mark_colless_like_index_{_name}",
        "heap",
        lambda df, n=_name: getattr(marks, f"mark_colless_like_index_{n}")(df).select("id", F.round(f"colless_like_index_{n}", 6).alias(f"colless_like_index_{n}")),
        f"SELECT t.id, round((SELECT coalesce(sum(lo.x), 0.0) FROM cl JOIN lo ON lo.p = cl.id WHERE cl.anc = t.id), 6) AS colless_like_index_{_name} FROM t",
        f"{_FS}, k AS (SELECT t.ancestor_id AS p, fs.s FROM t JOIN fs ON fs.id = t.id WHERE t.id <> t.ancestor_id), lo AS (SELECT q.p, {_f} AS x FROM k q GROUP BY q.p HAVING count(*) > 1)",
    )
_RATIO = "CASE WHEN {b} = 0 AND {a} = 0 THEN 'nan'::DOUBLE WHEN {b} = 0 THEN 'inf'::DOUBLE ELSE {a} / {b} END"
_DUR = "du AS (SELECT t.id, mx.m - t.origin_time AS x FROM t JOIN mx ON mx.id = t.id)"
_SUB = f"du AS (SELECT t.id, {_SINCE} AS x FROM t JOIN mx ON mx.id = t.id JOIN t p ON p.id = t.ancestor_id)"
for _name, _more in (
    ("nodecount", "du AS (SELECT id, n::DOUBLE AS x FROM sz)"),
    ("leafcount", "du AS (SELECT id, n::DOUBLE AS x FROM nl)"),
    ("duration", _DUR),
    ("subtended_duration", _SUB),
):
    _column = f"clade_{_name}_ratio_sister"
    query(
        f"mark_{_column}",
        "heap",
        lambda df, c=_column: getattr(marks, f"mark_{c}")(df).select("id", F.when(~F.isnan(c), F.col(c)).alias(c)),  # NaN as null in both
        f"SELECT id, CASE WHEN NOT isnan({_column}) THEN {_column} END AS {_column} FROM (SELECT t.id, {_RATIO.format(a='a.x', b='b.x')} AS {_column} FROM t JOIN sis ON sis.id = t.id JOIN du a ON a.id = t.id JOIN du b ON b.id = sis.s)",
        _more,
    )

# ---------------------------------------------------------------- counts
one("count_leaf_nodes", "recursive", counts.count_leaf_nodes, "SELECT count(*) AS count FROM lf")
one("count_inner_nodes", "recursive", counts.count_inner_nodes, "SELECT count(*) AS count FROM ch")
one("count_root_nodes", "sales", counts.count_root_nodes, "SELECT count(*) AS count FROM t WHERE id = ancestor_id")
one("count_polytomies", "recursive", counts.count_polytomies, "SELECT count(*) AS count FROM ch WHERE n > 2")
one("count_unifurcations", "recursive", counts.count_unifurcations, "SELECT count(*) AS count FROM ch WHERE n = 1")
one("count_unifurcating_roots", "sales", counts.count_unifurcating_roots, "SELECT count(*) AS count FROM ch JOIN t USING (id) WHERE n = 1 AND t.id = t.ancestor_id")
one("count_children_of", "recursive", lambda df: counts.count_children_of(df, 1), "SELECT count(*) AS count FROM t WHERE ancestor_id = 1 AND id <> 1")
one(
    "calc_polytomic_index",
    "recursive",
    counts.calc_polytomic_index,
    "SELECT greatest(2 * (SELECT count(*) FROM lf) - (SELECT count(*) FROM t WHERE id = ancestor_id), 0) - ((SELECT count(*) FROM t) - (SELECT count(*) FROM ch WHERE n = 1)) AS polytomic_index",
)
one("sum_origin_time_deltas", "recursive", counts.sum_origin_time_deltas, "SELECT sum(t.origin_time - p.origin_time) AS sum FROM t JOIN t p ON p.id = t.ancestor_id")
query("count_leaf_nodes_by_tree", "conv", counts.count_leaf_nodes, "SELECT tree_id, count(*) FILTER (id NOT IN (SELECT ancestor_id FROM t u WHERE u.tree_id = t.tree_id AND u.id <> u.ancestor_id)) AS count FROM t GROUP BY 1")

# ---------------------------------------------------------------- predicates and search
_CONTIGUOUS = "(SELECT min(id) = 0 AND max(id) = count(*) - 1 AND count(DISTINCT id) = count(*) FROM t)"
for _name, _tree, _sql in (
    ("has_compact_ids", "recursive", "(SELECT max(id) = count(*) - 1 FROM t)"),
    ("has_contiguous_ids", "recursive", _CONTIGUOUS),
    ("has_increasing_ids", "sales", "(SELECT bool_and(id >= ancestor_id) FROM t)"),
    ("has_multiple_roots", "sales", "(SELECT count(*) >= 2 FROM t WHERE id = ancestor_id)"),
    ("is_topologically_sorted", "sales", "(SELECT bool_and(ancestor_id <= id) FROM t)"),
    ("is_chronologically_sorted", "heap", "(SELECT bool_and(x) FROM (SELECT origin_time >= lag(origin_time, 1, origin_time) OVER (ORDER BY id) AS x FROM t))"),
    ("is_chronologically_ordered", "heap", "(SELECT bool_and(t.origin_time >= p.origin_time) FROM t JOIN t p ON p.id = t.ancestor_id)"),
    ("is_strictly_bifurcating", "heap", "(SELECT bool_and(n = 2) FROM ch)"),
    ("is_working_format", "recursive", f"{_CONTIGUOUS} AND (SELECT bool_and(ancestor_id <= id) FROM t)"),
    ("is_ultrametric", "sales", "(SELECT max(origin_time) - min(origin_time) <= 0 FROM t WHERE id IN (SELECT id FROM lf))"),
):
    one(_name, _tree, getattr(checks, _name), f"SELECT {_sql} AS result")
# The same where the answer is the other one.
_BACK = lambda df: df.withColumn("pos", -F.col("id"))
for _name, _tree, _change, _sql in (
    ("has_contiguous_ids", "sales", lambda df: df, _CONTIGUOUS),
    ("has_contiguous_ids", "heap", _BACK, "(SELECT bool_and(id = r - 1) FROM (SELECT id, row_number() OVER (ORDER BY -id) AS r FROM t))"),
    ("is_working_format", "sales", lambda df: df, f"{_CONTIGUOUS} AND (SELECT bool_and(ancestor_id <= id) FROM t)"),
    ("has_compact_ids", "sales", lambda df: df, "(SELECT max(id) = count(*) - 1 FROM t)"),
    ("has_multiple_roots", "heap", lambda df: df, "(SELECT count(*) >= 2 FROM t WHERE id = ancestor_id)"),
    ("is_strictly_bifurcating", "recursive", lambda df: df, "(SELECT bool_and(n = 2) FROM ch)"),
    ("is_topologically_sorted", "heap", _BACK, "(SELECT bool_and(-ancestor_id <= -id) FROM t)"),
    ("is_chronologically_sorted", "heap", _BACK, "(SELECT bool_and(x) FROM (SELECT origin_time >= lag(origin_time, 1, origin_time) OVER (ORDER BY -id) AS x FROM t))"),
    ("is_ultrametric", "recursive", lambda df: df, "(SELECT max(origin_time) - min(origin_time) <= 0 FROM t WHERE id IN (SELECT id FROM lf))"),
):
    _other = f"{_name}_{_tree}" + "_reversed" * (_change is _BACK)
    one(_other, _tree, lambda df, f=getattr(checks, _name), c=_change: f(c(df)), f"SELECT {_sql} AS result")
query(
    "find_chronological_inconsistency",
    "recursive",
    lambda df: checks.find_chronological_inconsistency(df.withColumn("origin_time", (F.col("id") * 13 % 97).cast("double"))),
    "SELECT min(t.id) AS id FROM t JOIN t p ON p.id = t.ancestor_id WHERE t.id * 13 % 97 < p.id * 13 % 97",
)
query("find_leaf_ids", "recursive", checks.find_leaf_ids, "SELECT id FROM lf")
query("find_root_ids", "sales", checks.find_root_ids, "SELECT id FROM t WHERE id = ancestor_id")

# ---------------------------------------------------------------- orders
_PATH = "pa AS (SELECT id, [id] AS path FROM t WHERE id = ancestor_id UNION ALL SELECT t.id, list_append(pa.path, t.id) FROM t JOIN pa ON pa.id = t.ancestor_id WHERE t.id <> t.ancestor_id)"
query("unfurl_traversal_preorder", "recursive", orders.unfurl_traversal_preorder, "SELECT row_number() OVER (ORDER BY path) - 1 AS ord, id FROM pa", _PATH)
query("unfurl_traversal_preorder_forest", "sales", orders.unfurl_traversal_preorder, "SELECT row_number() OVER (ORDER BY path) - 1 AS ord, id FROM pa", _PATH)
query(
    "unfurl_traversal_postorder_contiguous",
    "recursive",
    orders.unfurl_traversal_postorder_contiguous,
    "SELECT row_number() OVER (ORDER BY list_append(path, 9000000000000)) - 1 AS ord, id FROM pa",
    _PATH,
)
query("unfurl_traversal_postorder", "recursive", orders.unfurl_traversal_postorder, "SELECT row_number() OVER (ORDER BY d DESC, ancestor_id DESC, id DESC) - 1 AS ord, id FROM t JOIN dp USING (id)")
query("unfurl_traversal_levelorder", "recursive", orders.unfurl_traversal_levelorder, "SELECT row_number() OVER (ORDER BY d, id) - 1 AS ord, id FROM t JOIN dp USING (id)")
query("unfurl_traversal_topological", "recursive", orders.unfurl_traversal_topological, "SELECT row_number() OVER (ORDER BY id) - 1 AS ord, id FROM t")
_SIDE = """pa AS (SELECT id, []::INT[] AS path FROM t WHERE id = ancestor_id UNION ALL
  SELECT t.id, list_append(pa.path, CASE WHEN t.id = {first} THEN 0 ELSE 2 END) FROM t JOIN pa ON pa.id = t.ancestor_id JOIN ch ON ch.id = t.ancestor_id {join} WHERE t.id <> t.ancestor_id)"""
_IN = "SELECT row_number() OVER (ORDER BY list_append(path, 1)) - 1 AS ord, id FROM pa"
query("unfurl_traversal_inorder", "heap", orders.unfurl_traversal_inorder, _IN, _SIDE.format(first="ch.a", join=""))
query(
    "unfurl_traversal_semiorder",
    "heap",
    orders.unfurl_traversal_semiorder,
    _IN,
    "ml AS (SELECT anc AS id, min(id) AS m FROM cl WHERE id IN (SELECT id FROM lf) GROUP BY 1), "
    + _SIDE.format(first="CASE WHEN x.m < y.m THEN ch.a ELSE ch.b END", join="JOIN ml x ON x.id = ch.a JOIN ml y ON y.id = ch.b"),
)

# ---------------------------------------------------------------- pairs
_LCA = "(SELECT arg_max(a.anc, d.d) FROM cl a JOIN cl b ON a.anc = b.anc JOIN dp d ON d.id = a.anc WHERE a.id = {x} AND b.id = {y})"
query("find_pair_mrca_id", "recursive", lambda df: pairs.find_pair_mrca_id(df, 900, 951), f"SELECT {_LCA.format(x=900, y=951)} AS mrca_id")
query("find_mrca_id", "recursive", lambda df: pairs.find_mrca_id(df, [900, 951, 777]), f"SELECT {_LCA.format(x=_LCA.format(x=900, y=951), y=777)} AS mrca_id")
query(
    "find_pair_distance",
    "recursive",
    lambda df: pairs.find_pair_distance(df, 900, 951),
    f"SELECT 900 + 951 - 2.0::DOUBLE * {_LCA.format(x=900, y=951)} AS distance",
)
query(
    "calc_mrca_id_vector",
    "sales",
    lambda df: pairs.calc_mrca_id_vector(df, target_id=1003),
    "SELECT t.id, coalesce((SELECT arg_min(a.anc, a.dist) FROM cl a WHERE a.id = t.id AND a.anc IN (SELECT anc FROM cl WHERE id = 1003)), -1) AS mrca_id FROM t",
)
# All pairs of a whole table, within each tree.
_TURNS = "FROM t x JOIN t y ON x.tree_id = y.tree_id"
query(
    "calc_mrca_id_matrix",
    "conv",
    pairs.calc_mrca_id_matrix,
    f"SELECT x.tree_id, x.id AS first, y.id AS second, least(x.id, y.id) AS mrca_id {_TURNS}",
)
query(
    "calc_distance_matrix",
    "conv",
    pairs.calc_distance_matrix,
    f"SELECT x.tree_id, x.id AS first, y.id AS second, abs(x.origin_time - y.origin_time) AS distance {_TURNS}",
)

# ---------------------------------------------------------------- transforms
_REST = "t.origin_time, t.v"


def _edges(df: DataFrame) -> DataFrame:
    return df.select("id", "ancestor_id")


query(
    "collapse_unifurcations",
    "recursive",
    lambda df: _edges(transforms.collapse_unifurcations(df)),
    """SELECT t.id, CASE WHEN t.id = t.ancestor_id THEN t.id ELSE (SELECT arg_min(cl.anc, cl.dist) FROM cl JOIN kp ON kp.id = cl.anc WHERE cl.id = t.ancestor_id) END AS ancestor_id
    FROM t JOIN kp ON kp.id = t.id""",
    "kp AS (SELECT t.id FROM t LEFT JOIN ch ON ch.id = t.id WHERE coalesce(ch.n, 0) <> 1 OR t.id = t.ancestor_id)",
)
query(
    "collapse_unifurcations_chains",
    "conv",
    lambda df: transforms.collapse_unifurcations(df).select("tree_id", "id", "ancestor_id"),
    "SELECT tree_id, id, 0::BIGINT AS ancestor_id FROM t WHERE id = 0 OR id = (SELECT max(id) FROM t u WHERE u.tree_id = t.tree_id)",
)
query(
    "delete_unifurcating_roots",
    "conv",
    lambda df: transforms.delete_unifurcating_roots(df).select("tree_id", "id", "ancestor_id"),
    "SELECT tree_id, id, greatest(id - 1, least(m, 1)) AS ancestor_id FROM (SELECT *, max(id) OVER (PARTITION BY tree_id) AS m FROM t) WHERE id > 0 OR m = 0",
)
_TRUNK = lambda df: df.withColumn("is_trunk", F.col("id") < 3)
query("collapse_trunk", "heap", lambda df: _edges(transforms.collapse_trunk(_TRUNK(df))), "SELECT id, CASE WHEN ancestor_id < 3 THEN 0 ELSE ancestor_id END AS ancestor_id FROM t WHERE id = 0 OR id >= 3")
query("delete_trunk", "heap", lambda df: _edges(transforms.delete_trunk(_TRUNK(df))), "SELECT id, CASE WHEN ancestor_id < 3 THEN id ELSE ancestor_id END AS ancestor_id FROM t WHERE id >= 3")
query(
    "prune_extinct_lineages",
    "recursive",
    lambda df: _edges(transforms.prune_extinct_lineages(df.withColumn("extant", F.col("v") == 5))),
    "SELECT DISTINCT p.id, p.ancestor_id FROM t JOIN cl ON cl.id = t.id JOIN t p ON p.id = cl.anc WHERE t.v = 5",
)
query(
    "coarsen_mask",
    "recursive",
    lambda df: _edges(transforms.coarsen_mask(df, F.col("v") % 3 == 0)),
    """SELECT t.id, CASE WHEN t.id = t.ancestor_id THEN t.id ELSE coalesce((SELECT arg_min(cl.anc, cl.dist) FROM cl JOIN t x ON x.id = cl.anc
    WHERE cl.id = t.ancestor_id AND x.v % 3 = 0), t.id) END AS ancestor_id FROM t WHERE v % 3 = 0""",
)
query(
    "coarsen_taxa",
    "recursive",
    lambda df: transforms.coarsen_taxa(df, by="event_type").select("id", "ancestor_id", "origin_time", "event_type"),
    """SELECT f.id, CASE WHEN f.id = f.ancestor_id THEN f.id ELSE (SELECT arg_min(cl.anc, cl.dist) FROM cl JOIN fo ON fo.id = cl.anc WHERE cl.id = f.ancestor_id) END AS ancestor_id,
    f.origin_time, f.event_type FROM fo f""",
    "fo AS (SELECT t.* FROM t JOIN t p ON p.id = t.ancestor_id WHERE t.id = t.ancestor_id OR t.event_type IS DISTINCT FROM p.event_type)",
)
query(
    "coarsen_dilate",
    "recursive",
    lambda df: transforms.coarsen_dilate(df, dilation=64).select("id", "ancestor_id", "origin_time"),
    """SELECT t.id, CASE WHEN t.id = t.ancestor_id THEN t.id ELSE (SELECT arg_min(cl.anc, cl.dist) FROM cl JOIN kp ON kp.id = cl.anc WHERE cl.id = t.ancestor_id) END AS ancestor_id, t.s AS origin_time
    FROM sn t JOIN kp ON kp.id = t.id""",
    """sn AS (SELECT id, ancestor_id, id IN (SELECT id FROM lf) AS leaf, CASE WHEN id IN (SELECT id FROM lf) THEN origin_time ELSE floor(origin_time / 64) * 64 END AS s FROM t),
    kp AS (SELECT t.id FROM sn t JOIN sn p ON p.id = t.ancestor_id WHERE t.leaf OR t.id = t.ancestor_id OR t.s <> p.s)""",
)
query(
    "splay_polytomies_counts",
    "recursive",
    lambda df: counts.count_polytomies(transforms.splay_polytomies(df)).crossJoin(transforms.splay_polytomies(df).agg(F.count(F.lit(1)).alias("nodes"))),
    "SELECT 0::BIGINT AS count, (SELECT count(*) FROM t) + (SELECT sum(greatest(n - 2, 0)) FROM ch)::BIGINT AS nodes",
)
query(
    "add_global_root",
    "sales",
    lambda df: transforms.add_global_root(df, {"origin_time": -1.0}),
    "SELECT id, CASE WHEN id = ancestor_id THEN m ELSE ancestor_id END AS ancestor_id, origin_time FROM t, (SELECT max(id) + 1 AS m FROM t) UNION ALL SELECT max(id) + 1, max(id) + 1, -1.0 FROM t",
)
query("join_roots", "sales", lambda df: _edges(transforms.join_roots(df)), "SELECT id, CASE WHEN id = ancestor_id THEN (SELECT min(id) FROM t WHERE id = ancestor_id) ELSE ancestor_id END AS ancestor_id FROM t")
query(
    "prefix_roots",
    "sales",
    lambda df: transforms.prefix_roots(df),
    """SELECT t.id, coalesce(r.n, t.ancestor_id) AS ancestor_id, t.origin_time FROM t LEFT JOIN ro r ON r.id = t.id UNION ALL SELECT n, n, 0.0 FROM ro""",
    "ro AS (SELECT id, (SELECT max(id) FROM t) + row_number() OVER (ORDER BY id) AS n FROM t WHERE id = ancestor_id)",
)
query(
    "add_inner_leaves",
    "recursive",
    lambda df: _edges(transforms.add_inner_leaves(df)),
    "SELECT id, ancestor_id FROM t UNION ALL SELECT (SELECT max(id) FROM t) + row_number() OVER (ORDER BY id), id FROM ch",
)
_KN = "kn AS (SELECT id, id + (SELECT max(id) + 1 FROM t) AS k FROM ch)"
_KNUCKLES = "SELECT t.id, coalesce(kn.k, t.ancestor_id) AS ancestor_id FROM t LEFT JOIN kn ON kn.id = t.id UNION ALL SELECT kn.k, CASE WHEN t.id = t.ancestor_id THEN kn.k ELSE t.ancestor_id END FROM kn JOIN t USING (id)"
query("add_inner_knuckles", "recursive", lambda df: _edges(transforms.add_inner_knuckles(df)), _KNUCKLES, _KN)
query(
    "reroot_at_id",
    "recursive",
    lambda df: _edges(transforms.reroot_at_id(df, 999)),
    "SELECT t.id, CASE WHEN t.id = 999 THEN 999 ELSE coalesce((SELECT x.id FROM t x JOIN cl ON cl.anc = x.id AND cl.id = 999 WHERE x.ancestor_id = t.id AND x.id <> x.ancestor_id), t.ancestor_id) END AS ancestor_id FROM t",
)
query("ultrametricize", "recursive", lambda df: transforms.ultrametricize(df).select("id", "origin_time"), "SELECT id, CASE WHEN id IN (SELECT id FROM lf) THEN (SELECT max(origin_time) FROM t) ELSE origin_time END AS origin_time FROM t")
query(
    "coerce_chronological_consistency",
    "recursive",
    lambda df: transforms.coerce_chronological_consistency(df.withColumn("origin_time", F.col("v").cast("double"))).select("id", "origin_time"),
    "SELECT cl.id, max(x.v)::DOUBLE AS origin_time FROM cl JOIN t x ON x.id = cl.anc GROUP BY 1",
)
query("assign_contiguous_ids", "sales", lambda df: _edges(representation.assign_contiguous_ids(df)), "SELECT a.n AS id, b.n AS ancestor_id FROM t JOIN rn a ON a.id = t.id JOIN rn b ON b.id = t.ancestor_id", "rn AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS n FROM t)")
query("to_working_format", "sales", lambda df: _edges(representation.to_working_format(df)), "SELECT a.n AS id, b.n AS ancestor_id FROM t JOIN rn a ON a.id = t.id JOIN rn b ON b.id = t.ancestor_id", "rn AS (SELECT id, row_number() OVER (ORDER BY d, id) - 1 AS n FROM t JOIN dp USING (id))")
query("topological_sort", "recursive", lambda df: representation.topological_sort(df).select("id", "pos"), "SELECT id, row_number() OVER (ORDER BY d, id) - 1 AS pos FROM t JOIN dp USING (id)")
query("chronological_sort", "heap", lambda df: representation.chronological_sort(df).select("id", "pos"), "SELECT id, row_number() OVER (ORDER BY origin_time, id) - 1 AS pos FROM t")
query("sort_children", "recursive", lambda df: representation.sort_children(df, "v").select("id", "pos"), "SELECT id, row_number() OVER (ORDER BY d, ancestor_id, v, id) - 1 AS pos FROM t JOIN dp USING (id)")
query("ladderize", "recursive", lambda df: representation.ladderize(df).select("id", "pos"), "SELECT t.id, row_number() OVER (ORDER BY d, ancestor_id, nl.n, t.id) - 1 AS pos FROM t JOIN dp USING (id) JOIN nl ON nl.id = t.id")
query(
    "ancestor_lists",
    "sales",
    lambda df: representation.make_ancestor_id_col(representation.make_ancestor_list_col(df).drop("ancestor_id")).select("id", "ancestor_list", "ancestor_id"),
    "SELECT id, CASE WHEN id = ancestor_id THEN '[none]' ELSE '[' || ancestor_id || ']' END AS ancestor_list, ancestor_id FROM t",
)
query("pipe_unary_ops", "recursive", lambda df: representation.pipe_unary_ops(df, "mark_num_leaves", "mark_node_depth").select("id", "num_leaves", "node_depth"), "SELECT nl.id, nl.n AS num_leaves, dp.d AS node_depth FROM nl JOIN dp USING (id)")

# ---------------------------------------------------------------- sampling
query("mark_sample_tips_canopy", "recursive", lambda df: sampling.mark_sample_tips_canopy(df, 25).select("id", "sampled"), "SELECT id, coalesce(id IN (SELECT id FROM lf ORDER BY id DESC LIMIT 25), false) AS sampled FROM t")
query(
    "downsample_tips_canopy",
    "recursive",
    lambda df: _edges(sampling.downsample_tips_canopy(df, 25)),
    "SELECT DISTINCT p.id, p.ancestor_id FROM cl JOIN t p ON p.id = cl.anc WHERE cl.id IN (SELECT id FROM lf ORDER BY id DESC LIMIT 25)",
)
_LIN = """mv AS (SELECT t.id, (SELECT arg_min(a.anc, a.dist) FROM cl a WHERE a.id = t.id AND a.anc IN (SELECT anc FROM cl WHERE id = (SELECT max(id) FROM lf))) AS m FROM t),
  de AS (SELECT lf.id, abs(x.origin_time - y.origin_time) AS d FROM lf JOIN mv USING (id) JOIN t x ON x.id = lf.id JOIN t y ON y.id = mv.m)"""
query("mark_sample_tips_lineage", "recursive", lambda df: sampling.mark_sample_tips_lineage(df, 20).select("id", "sampled"), "SELECT id, coalesce(id IN (SELECT id FROM de ORDER BY d, id LIMIT 20), false) AS sampled FROM t", _LIN)
query(
    "mark_sample_tips_lineage_stratified",
    "recursive",
    lambda df: sampling.mark_sample_tips_lineage_stratified(df, criterion_stratify="event_type", n_tips_per_stratum=2).select("id", "sampled"),
    "SELECT id, id IN (SELECT id FROM (SELECT de.id, row_number() OVER (PARTITION BY t.event_type ORDER BY de.d, de.id) AS r FROM de JOIN t USING (id)) WHERE r <= 2) AS sampled FROM t",
    _LIN,
)
query(
    "downsample_tips_lineage",
    "recursive",
    lambda df: _edges(sampling.downsample_tips_lineage(df, 20)),
    "SELECT DISTINCT p.id, p.ancestor_id FROM cl JOIN t p ON p.id = cl.anc WHERE cl.id IN (SELECT id FROM de ORDER BY d, id LIMIT 20)",
    _LIN,
)
query("mark_sample_tips_uniform_count", "recursive", lambda df: sampling.mark_sample_tips_uniform(df, 40, seed=1).agg(F.count_if("sampled").alias("n")), "SELECT least(40, (SELECT count(*) FROM lf)) AS n")


def _one_clade(df: DataFrame, tips: DataFrame) -> DataFrame:
    top = pairs.find_mrca_id(df, tips).withColumnRenamed("mrca_id", "id")
    sized = marks.with_parent(marks.mark_num_leaves(df, mark_as="_n"), _above="_n").join(F.broadcast(top), "id")
    return sized.crossJoin(tips.agg(F.count(F.lit(1)).alias("_k"))).select((F.col("_n") == F.col("_k")).alias("whole"), ((F.col("_above") > 40) & (F.col("_n") <= 40)).alias("largest"))


def _drawn(df: DataFrame, kept: DataFrame) -> DataFrame:
    """What must hold of a drawn sample: its tips, how many of them are tips of the tree, how many rows are the tree's, and how many have their parent."""
    tips = marks.mark_leaves(kept, mark_as="_tip").select("id", "ancestor_id", "_tip")
    whole = marks.mark_leaves(df, mark_as="_leaf").select("id", F.col("ancestor_id").alias("_up"), "_leaf")
    there = kept.select(F.col("id").alias("ancestor_id"), F.lit(1).alias("_there"))
    rows = tips.join(whole, "id", "left").join(there, "ancestor_id", "left")
    return rows.agg(
        F.count_if("_tip").alias("tips"),
        F.count_if(F.col("_tip") & ~F.coalesce("_leaf", F.lit(False))).alias("tips_that_are_none"),
        F.count_if(~F.col("ancestor_id").eqNullSafe(F.col("_up"))).alias("other_rows"),
        F.count_if(F.col("_there").isNull()).alias("orphans"),
    )


_HOLDS = "SELECT {tips} AS tips, 0::BIGINT AS tips_that_are_none, 0::BIGINT AS other_rows, 0::BIGINT AS orphans"
_FORTY = "least(40, (SELECT count(*) FROM lf))"
query("downsample_tips_uniform", "recursive", lambda df: _drawn(df, sampling.downsample_tips_uniform(df, 40, seed=1)), _HOLDS.format(tips=_FORTY))
# A clade's tips: its number of tips is that of a largest clade with at most 40.
query(
    "downsample_tips_clade",
    "recursive",
    lambda df: _drawn(df, sampling.downsample_tips_clade(df, 40, seed=1)).withColumn("tips", F.col("tips").between(1, 40)),
    _HOLDS.format(tips="(SELECT count(*) BETWEEN 1 AND 40 FROM nl x JOIN t ON t.id = x.id JOIN nl p ON p.id = t.ancestor_id WHERE x.n <= 40 AND p.n > 40) IS NOT NULL"),
)
query(
    "mark_sample_tips_clade_is_one_clade",
    "recursive",
    # The sampled tips are all tips below their common ancestor, whose parent's clade is too large.
    lambda df: _one_clade(df, sampling.mark_sample_tips_clade(df, 40, seed=1).filter("sampled").select("id")),
    "SELECT true AS whole, true AS largest",
)
query("downsample_tips_lineage_stratified", "recursive", lambda df: _edges(sampling.downsample_tips_lineage_stratified(df, criterion_stratify="event_type")))

# ---------------------------------------------------------------- traits
_YES, _NO = (lambda: F.col("v") < 20), (lambda: F.col("v") >= 30)
_FREQ = "fr AS (SELECT cl.anc AS id, count(*) FILTER (x.v < 20) AS p, count(*) FILTER (x.v >= 30) AS a FROM cl JOIN t x ON x.id = cl.id GROUP BY 1)"
query("calc_clade_trait_count", "recursive", lambda df: traits.calc_clade_trait_count(df, trait_mask=_YES()).select("id", "trait_count"), "SELECT id, p AS trait_count FROM fr", _FREQ)
query(
    "calc_clade_trait_frequency",
    "recursive",
    lambda df: traits.calc_clade_trait_frequency(df, mask_trait_absent=_NO(), mask_trait_present=_YES()).select("id", F.when(~F.isnan("trait_frequency"), F.col("trait_frequency")).alias("trait_frequency")),
    "SELECT id, CASE WHEN p + a > 0 THEN p / (p + a)::DOUBLE END AS trait_frequency FROM fr",
    _FREQ,
)
query(
    "mask_monomorphic_clades",
    "recursive",
    lambda df: traits.mask_monomorphic_clades(df, trait_mask=_YES(), trait_values=F.col("v") % 3).select("id", "is_monomorphic"),
    "SELECT cl.anc AS id, count(DISTINCT CASE WHEN x.v < 20 THEN x.v % 3 END) <= 1 AS is_monomorphic FROM cl JOIN t x ON x.id = cl.id GROUP BY 1",
)
query(
    "screen_trait_defined_clades_naive",
    "heap",
    lambda df: traits.screen_trait_defined_clades_naive(df, mask_trait_absent=_NO(), mask_trait_present=_YES(), defining_mut_thresh=0.6, defining_mut_sister_thresh=0.4).select("id", "trait_defined_naive"),
    """SELECT x.id, coalesce(x.f >= 0.6 AND y.f <= 0.4, false) AS trait_defined_naive FROM ff x JOIN sis ON sis.id = x.id JOIN ff y ON y.id = sis.s""",
    _FREQ + ", ff AS (SELECT id, CASE WHEN p + a > 0 THEN p / (p + a)::DOUBLE END AS f FROM fr)",
)
_LC = "lgamma({n} + 1.0) - lgamma({k} + 1.0) - lgamma({n} - {k} + 1.0)"
query(
    "screen_trait_defined_clades_fisher",
    "heap",
    lambda df: traits.screen_trait_defined_clades_fisher(df, mask_trait_absent=_NO(), mask_trait_present=_YES()).select("id", F.round("trait_defined_fisher", 8).alias("trait_defined_fisher")),
    f"""SELECT id, round(CASE WHEN p = 0 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, list_sum(list_transform(range(p, least(n1, r) + 1),
      lambda k: exp({_LC.format(n="n1", k="k")} + {_LC.format(n="(n - n1)", k="(r - k)")} - ({_LC.format(n="n", k="r")}))))) END, 8) AS trait_defined_fisher
    FROM (SELECT x.id, x.p::BIGINT AS p, (x.p + y.p)::BIGINT AS n1, (x.p + x.a + y.p + y.a)::BIGINT AS n, (x.p + x.a)::BIGINT AS r FROM fr x JOIN sis ON sis.id = x.id JOIN fr y ON y.id = sis.s)""",
    _FREQ,
)
query("screen_trait_defined_clades_fitch", "heap", lambda df: traits.screen_trait_defined_clades_fitch(df, mask_trait_absent=_NO(), mask_trait_present=_YES()).select("id", "trait_defined_fitch"))
for _name in ("logistic", "fblr"):
    for _side in ("children", "sister"):
        _column = f"clade_{_name}_growth_{_side}"
        query(f"mark_{_column}", "heap", lambda df, c=_column: getattr(traits, f"mark_{c}")(df).select("id", c))
query(
    "mark_ot_mrca",
    "heap",
    lambda df: traits.mark_ot_mrca(df).select("id", "ot_mrca_id", "ot_mrca_time_of", "ot_mrca_time_since"),
    """SELECT t.id, m AS ot_mrca_id, x.origin_time AS ot_mrca_time_of, t.origin_time - x.origin_time AS ot_mrca_time_since FROM t JOIN
    (SELECT id, (SELECT arg_max(anc, depth) FROM (SELECT cl.anc, any_value(dp.d) AS depth FROM cl JOIN t y ON y.id = cl.id JOIN dp ON dp.id = cl.anc
      WHERE y.origin_time >= u.origin_time GROUP BY cl.anc HAVING count(*) = (SELECT count(*) FROM t z WHERE z.origin_time >= u.origin_time))) AS m FROM t u) q USING (id) JOIN t x ON x.id = q.m""",
)

# ---------------------------------------------------------------- sources, text and comparison


def _on(name: str, make: Query, sql: str | None = None) -> None:
    QUERIES[name] = make
    if sql:
        ORACLES[name] = sql


_on("make_balanced_bifurcating", lambda s, d: trees.make_balanced_bifurcating(s, 10), "SELECT range AS id, CASE WHEN range = 0 THEN 0 ELSE (range - 1) // 2 END AS ancestor_id FROM range(1023)")
_on("make_comb", lambda s, d: trees.make_comb(s, 500), "SELECT range AS id, CASE WHEN range = 0 THEN 0 ELSE (range - 1) // 2 * 2 END AS ancestor_id FROM range(999)")
_on("make_star", lambda s, d: trees.make_star(s, 500), "SELECT range AS id, 0::BIGINT AS ancestor_id FROM range(501)")
_on("make_edge_split", lambda s, d: trees.make_edge_split(s, 200, seed=1, n_trees=8))
_on("make_leaf_split", lambda s, d: trees.make_leaf_split(s, 200, seed=1, n_trees=8))
_on(
    "aggregate_phylogenies",
    lambda s, d: trees.aggregate_phylogenies([heap(s, d).select("id", "ancestor_id"), sales(s, d).select("id", "ancestor_id")]),
    f"""WITH a AS ({TREES['heap']}), b AS ({TREES['sales']}) SELECT 0::BIGINT AS tree_id, id, ancestor_id FROM a
    UNION ALL SELECT 1, id + m, ancestor_id + m FROM b, (SELECT max(id) + 1 AS m FROM a)""",
)
query(
    "newick_round_trip",
    "conv",
    lambda df: newick.from_newick(newick.as_newick(df.withColumn("label", F.concat(F.lit("t "), F.col("id"))), taxon_label="label")).select("tree_id", "id", "ancestor_id", "taxon_label"),
    "SELECT tree_id, id, ancestor_id, 't ' || id AS taxon_label FROM t",
)
query(
    "as_newick",
    "conv",
    lambda df: newick.as_newick(df),
    """SELECT tree_id, repeat('(', n - 1) || string_agg(CASE WHEN id = 0 THEN ':0' ELSE ':1)' END, '' ORDER BY id DESC) || ';' AS newick
    FROM (SELECT *, (count(*) OVER (PARTITION BY tree_id))::INT AS n FROM t) GROUP BY tree_id, n""",
)


def _labelled(spark: SparkSession, depth: int, turned: bool) -> DataFrame:
    df = trees.make_balanced_bifurcating(spark, depth)
    label = F.when(F.lit(turned) & F.col("id").isin(7, 14), F.lit(21) - F.col("id")).otherwise(F.col("id"))
    return df.withColumn("taxon_label", F.concat(F.lit("x"), F.format_string("%03d", label)))


_on("calc_triplet_distance", lambda s, d: pairs.calc_triplet_distance(_labelled(s, 4, False), _labelled(s, 4, True)).select(F.round("distance", 9).alias("distance")))
_on("calc_quartet_distance", lambda s, d: pairs.calc_quartet_distance(_labelled(s, 4, False), _labelled(s, 4, True)).select(F.round("distance", 9).alias("distance")))
_on("test_leaves_isomorphic", lambda s, d: pairs.test_leaves_isomorphic(_labelled(s, 4, False), _labelled(s, 4, True), "taxon_label"), "SELECT false AS result")
_on("sample_triplet_comparisons", lambda s, d: pairs.sample_triplet_comparisons(_labelled(s, 4, False), _labelled(s, 4, True), "taxon_label", 200))


# ---------------------------------------------------------------- formats, checks and other names
_LISTS = lambda df: representation.make_ancestor_list_col(df)
query("assign_root_ancestor_token", "sales", lambda df: representation.assign_root_ancestor_token(_LISTS(df), "None").select("id", "ancestor_list"), "SELECT id, CASE WHEN id = ancestor_id THEN '[None]' ELSE '[' || ancestor_id || ']' END AS ancestor_list FROM t")
query(
    "parse_ancestor_ids",
    "sales",
    lambda df: _LISTS(df).select("id", F.size(columns.parse_ancestor_ids(F.col("ancestor_list"))).cast("long").alias("n"), columns.parse_ancestor_id(F.col("ancestor_list")).alias("one")),
    "SELECT id, CASE WHEN id = ancestor_id THEN 0 ELSE 1 END::BIGINT AS n, CASE WHEN id <> ancestor_id THEN ancestor_id END AS one FROM t",
)
query("try_add_ancestor_list_col", "sales", lambda df: representation.try_add_ancestor_id_col(representation.try_add_ancestor_list_col(df).drop("ancestor_id")).select("id", "ancestor_id"), "SELECT id, ancestor_id FROM t")
query("validate", "sales", lambda df: df.sparkSession.createDataFrame([(checks.validate(_LISTS(df)),)], "result boolean"), "SELECT true AS result")
query(
    "check_topological_sensitivity",
    "heap",
    lambda df: df.sparkSession.createDataFrame([(c,) for c in checks.check_topological_sensitivity(marks.mark_node_depth(marks.mark_num_leaves(df)), insert=True, delete=False, update=True)], "stale string"),
    "SELECT unnest(['num_leaves', 'node_depth']) AS stale",
)
query("drop_topological_sensitivity", "heap", lambda df: checks.drop_topological_sensitivity(marks.mark_num_leaves(df)), "SELECT * FROM t")
query("categorize_triplet", "heap", lambda df: df.sparkSession.createDataFrame([(pairs.categorize_triplet(df, [7, 8, 30]),)], "outgroup int"), "SELECT 2 AS outgroup")
query("mark_sample_tips_count", "recursive", lambda df: sampling.mark_sample_tips(df, 30, seed=2).agg(F.count_if("sampled").alias("n")), "SELECT least(30, (SELECT count(*) FROM lf)) AS n")
query("downsample_tips_count", "recursive", lambda df: counts.count_leaf_nodes(sampling.downsample_tips(df, 30, seed=2)), "SELECT least(30, (SELECT count(*) FROM lf)) AS count")
query("mark_sample_tips_clade", "recursive", lambda df: sampling.mark_sample_tips_clade(df, 40, seed=1).select("id", "sampled"))
_NIB = """kd AS (SELECT t.id, kn.k, (SELECT count(*) FROM cl WHERE cl.id = t.id AND cl.anc <> t.id)::BIGINT AS inner_above FROM t JOIN kn USING (id)),
  al AS (SELECT k AS id, 2 * inner_above AS d, CASE WHEN t.id = t.ancestor_id THEN k ELSE t.ancestor_id END AS up FROM kd JOIN t USING (id)
         UNION ALL SELECT kd.id, 2 * inner_above + 1, k FROM kd)"""
query(
    "add_inner_niblings",
    "recursive",
    lambda df: _edges(transforms.add_inner_niblings(df)),
    _KNUCKLES + " UNION ALL SELECT al.id + (SELECT max(k) + 1 FROM kn), al.up FROM al WHERE al.d % 2 = 1",
    _KN + ", " + _NIB,
)


def _spop(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat_ws(" ", F.col("n_nationkey"), F.when(F.col("n_nationkey") == 0, "(none)").otherwise((F.col("n_nationkey") - 1).cast("string")), F.col("n_regionkey"))
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select(line.alias("x")).collect()  # 25 rows
    text = "\n".join(["#filetype genotype_data", "#format id parents update_born", *(r.x for r in rows)])
    return spop.from_avida_spop(spark, text=text).select("id", "ancestor_list", "origin_time")


_on("from_avida_spop", _spop, "SELECT n_nationkey::BIGINT AS id, CASE WHEN n_nationkey = 0 THEN '[none]' ELSE '[' || (n_nationkey - 1) || ']' END AS ancestor_list, n_regionkey::BIGINT AS origin_time FROM nation")


# ---------------------------------------------------------------- rows with several parents
def pedigree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sales tree where customers and orders have a second parent, a nation, unless it is the first; ancestor_list alone."""
    rows = sales(spark, sf_dir).select("id", F.when(F.col("id") != F.col("ancestor_id"), F.col("ancestor_id")).alias("a"))
    second = F.when((F.col("id") >= 1000) & (F.col("id") % 3 > 0), F.col("id") % 25 + 100)
    rows = rows.withColumn("b", F.when(second != F.col("a"), second))
    text = F.concat(F.lit("["), F.concat_ws(", ", F.col("a").cast("string"), F.col("b").cast("string")), F.lit("]"))
    return rows.select("id", F.when(F.col("a").isNull(), "[none]").otherwise(text).alias("ancestor_list"), (F.col("id") * 37 % 101).cast("double").alias("origin_time"))


_PEDIGREE = """
f AS (SELECT id, CASE WHEN id <> ancestor_id THEN ancestor_id END AS a, CASE WHEN id >= 1000 AND id % 3 > 0 THEN id % 25 + 100 END AS s FROM ({sales})),
t AS (SELECT id, a, CASE WHEN s <> a THEN s END AS b, (id * 37 % 101)::DOUBLE AS origin_time FROM f),
e AS (SELECT id, a AS up FROM t WHERE a IS NOT NULL UNION ALL SELECT id, b FROM t WHERE b IS NOT NULL),
cl AS (SELECT id AS anc, id FROM t UNION SELECT e.up, cl.id FROM cl JOIN e ON e.id = cl.anc),
rf AS (SELECT up AS id, count(*) AS n FROM e GROUP BY 1),
li AS (SELECT id, CASE WHEN a IS NULL THEN '[none]' WHEN b IS NULL THEN '[' || a || ']' ELSE '[' || a || ', ' || b || ']' END AS ancestor_list FROM t)"""


def pedigree_query(name: str, make: Callable[[DataFrame], DataFrame], sql: str, more: str = "") -> None:
    QUERIES[f"{name}_pedigree"] = lambda spark, sf_dir: make(pedigree(spark, sf_dir))
    ORACLES[f"{name}_pedigree"] = f"WITH RECURSIVE {_PEDIGREE.format(sales=TREES['sales'])}{',' + more if more else ''} {sql}"


_LEAF = "id NOT IN (SELECT up FROM e)"
pedigree_query("is_sexual", checks.is_sexual, "SELECT count(b) > 0 AS result FROM t")
pedigree_query("is_asexual", checks.is_asexual, "SELECT count(b) = 0 AS result FROM t")
pedigree_query("is_asexual_orders_left_out", lambda df: checks.is_asexual(df.filter("id < 1000")), "SELECT count(b) = 0 AS result FROM t WHERE id < 1000")
pedigree_query("mark_leaves", lambda df: marks.mark_leaves(df).select("id", "is_leaf"), f"SELECT id, {_LEAF} AS is_leaf FROM t")
pedigree_query("mark_roots", lambda df: marks.mark_roots(df).select("id", "is_root"), "SELECT id, a IS NULL AS is_root FROM t")
pedigree_query("find_leaf_ids", checks.find_leaf_ids, f"SELECT id FROM t WHERE {_LEAF}")
pedigree_query("find_root_ids", checks.find_root_ids, "SELECT id FROM t WHERE a IS NULL")
pedigree_query("count_leaf_nodes", counts.count_leaf_nodes, f"SELECT count(*) AS count FROM t WHERE {_LEAF}")
pedigree_query("count_inner_nodes", counts.count_inner_nodes, "SELECT count(DISTINCT up) AS count FROM e")
pedigree_query("count_root_nodes", counts.count_root_nodes, "SELECT count(*) AS count FROM t WHERE a IS NULL")
for _how in ("min", "max"):
    pedigree_query(
        f"mark_root_id_{_how}",
        lambda df, h=_how: marks.mark_root_id(df, h).select("id", "root_id"),
        f"SELECT cl.id, {_how}(anc) AS root_id FROM cl JOIN t r ON r.id = anc AND r.a IS NULL GROUP BY 1",
    )
pedigree_query("is_topologically_sorted", checks.is_topologically_sorted, "SELECT bool_and(up < id) AS result FROM e")
pedigree_query("is_topologically_sorted_reversed", lambda df: checks.is_topologically_sorted(_BACK(df)), "SELECT bool_and(-up < -id) AS result FROM e")
_OLDER = "FROM e JOIN t USING (id) JOIN t p ON p.id = e.up WHERE t.origin_time < p.origin_time"
pedigree_query("find_chronological_inconsistency", checks.find_chronological_inconsistency, f"SELECT min(t.id) AS id {_OLDER}")
pedigree_query("is_chronologically_ordered", checks.is_chronologically_ordered, f"SELECT count(*) = 0 AS result {_OLDER}")
_LATEST = "SELECT cl.id, max(x.origin_time) AS origin_time FROM cl JOIN t x ON x.id = cl.anc GROUP BY 1"
pedigree_query("coerce_chronological_consistency", lambda df: transforms.coerce_chronological_consistency(df).select("id", "origin_time"), _LATEST)
pedigree_query(
    "is_chronologically_ordered_coerced",
    lambda df: checks.is_chronologically_ordered(transforms.coerce_chronological_consistency(df)),
    "SELECT count(*) = 0 AS result FROM e JOIN m USING (id) JOIN m p ON p.id = e.up WHERE m.origin_time < p.origin_time",
    f"m AS ({_LATEST})",
)
pedigree_query(
    "collapse_unifurcations",
    lambda df: transforms.collapse_unifurcations(df).select("id", "ancestor_list"),
    """SELECT t.id, CASE WHEN t.a IS NULL THEN '[none]' WHEN t.b IS NULL THEN '[' || x.dst || ']' ELSE '[' || x.dst || ', ' || y.dst || ']' END AS ancestor_list
    FROM t LEFT JOIN ends x ON x.id = t.a LEFT JOIN ends y ON y.id = t.b WHERE t.id NOT IN (SELECT id FROM go)""",
    """go AS (SELECT t.id, t.a FROM t JOIN rf ON rf.id = t.id WHERE t.b IS NULL AND t.a IS NOT NULL AND rf.n = 1),
    wy AS (SELECT id, id AS dst FROM t UNION SELECT wy.id, go.a FROM wy JOIN go ON go.id = wy.dst),
    ends AS (SELECT id, dst FROM wy WHERE dst NOT IN (SELECT id FROM go))""",
)
pedigree_query(
    "coarsen_mask",
    lambda df: transforms.coarsen_mask(df, F.col("id") % 3 < 2).select("id", "ancestor_list"),
    """SELECT t.id, coalesce('[' || string_agg(DISTINCT up::VARCHAR, ', ' ORDER BY up::VARCHAR) FILTER (up % 3 < 2) || ']', '[none]') AS ancestor_list
    FROM t LEFT JOIN wy USING (id) WHERE t.id % 3 < 2 GROUP BY t.id""".replace("string_agg(DISTINCT up::VARCHAR, ', ' ORDER BY up::VARCHAR) FILTER (up % 3 < 2)", "array_to_string(list_sort(list(DISTINCT up) FILTER (up % 3 < 2)), ', ')"),
    "wy AS (SELECT id, up FROM e WHERE id % 3 < 2 UNION SELECT wy.id, e.up FROM wy JOIN e ON e.id = wy.up WHERE wy.up % 3 = 2)",
)
pedigree_query(
    "add_global_root",
    lambda df: transforms.add_global_root(df, {"origin_time": -1.0}),
    """SELECT id, CASE WHEN a IS NULL THEN '[' || (SELECT max(id) + 1 FROM t) || ']' ELSE ancestor_list END AS ancestor_list, origin_time FROM t JOIN li USING (id)
    UNION ALL SELECT max(id) + 1, '[none]', -1.0 FROM t""",
)
pedigree_query(
    "join_roots",
    lambda df: transforms.join_roots(df).select("id", "ancestor_list"),
    "SELECT id, CASE WHEN a IS NULL AND id <> (SELECT arg_min(id, origin_time) FROM t WHERE a IS NULL) THEN '[' || (SELECT arg_min(id, origin_time) FROM t WHERE a IS NULL) || ']' ELSE ancestor_list END AS ancestor_list FROM t JOIN li USING (id)",
)
pedigree_query(
    "aggregate_phylogenies",
    lambda df: trees.aggregate_phylogenies([df, df]).select("id", "ancestor_list"),
    """SELECT id, ancestor_list FROM li UNION ALL SELECT id + m, CASE WHEN a IS NULL THEN '[none]' WHEN b IS NULL THEN '[' || (a + m) || ']' ELSE '[' || (a + m) || ', ' || (b + m) || ']' END
    FROM t, (SELECT max(id) + 1 AS m FROM t)""",
)
pedigree_query(
    "topological_sort",
    lambda df: representation.topological_sort(df).select("id", "pos"),
    "SELECT id, row_number() OVER (ORDER BY d, id) - 1 AS pos FROM (SELECT id, max(d) AS d FROM dp GROUP BY id)",
    "dp AS (SELECT id, 0 AS d FROM t WHERE a IS NULL UNION SELECT e.id, dp.d + 1 FROM e JOIN dp ON dp.id = e.up)",
)
QUERIES["make_empty"] = lambda spark, sf_dir: trees.make_empty(spark).select("id", "ancestor_id")
ORACLES["make_empty"] = "SELECT 0::BIGINT AS id, 0::BIGINT AS ancestor_id WHERE false"


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
