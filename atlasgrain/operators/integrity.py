"""Integrity of records (survey rows 172 to 192): keys, references, coverage, order and graphs.

The driver's tables stand in for asset records: part = asset, lineitem = deliverable, orders = delivery, customer = owner.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.registry import query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def duplicate_ids(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("int_duplicate_ids", "SELECT l_orderkey * 10 + l_linenumber AS id, count(*)::BIGINT AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def q_duplicates(spark, sf_dir: str) -> DataFrame:
    """Row 172."""
    return duplicate_ids(table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id")), "id")


def dangling(rows: DataFrame, key: str, targets: DataFrame, target: str) -> DataFrame:
    """Rows whose non-null reference has no target."""
    return rows.where(F.col(key).isNotNull()).join(targets.select(F.col(target).alias(key)).distinct(), key, "left_anti")


@query("int_unknown_reference", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5)")
def q_dangling(spark, sf_dir: str) -> DataFrame:
    """Rows 173, 178."""
    return dangling(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "l_partkey", table(spark, sf_dir, "part").where("p_size > 5"), "p_partkey")


def owner_mismatch(rows: DataFrame, owners: DataFrame, key: str, declared: str, owner: str) -> DataFrame:
    """Row 173: rows whose declared owner is not the owner of what they refer to; ``owners`` has key and owner."""
    return rows.join(owners.select(key, owner), key).where(F.col(declared) != F.col(owner))


@query("int_owner_mismatch", """SELECT l_orderkey, l_linenumber, s_nationkey AS declared, c_nationkey AS owner FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE s_nationkey <> c_nationkey""")
def q_owner(spark, sf_dir: str) -> DataFrame:
    """Row 173: who delivers is not who owns."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("declared"))
    o, c = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("owner"))
    return owner_mismatch(l.join(s, "l_suppkey"), o.join(c, "o_custkey"), "l_orderkey", "declared", "owner").select("l_orderkey", "l_linenumber", "declared", "owner")


def missing_combinations(rows: DataFrame, axes: dict[str, list | None]) -> DataFrame:
    """Row 174: combinations of the declared axes that no row covers. Axes are small lists; None stands for the values met."""
    out = None
    for name, values in axes.items():
        axis = rows.select(name).distinct() if values is None else None
        if axis is not None:
            out = axis if out is None else out.join(axis)
        else:
            listed = F.explode(F.array(*map(F.lit, values)).cast(f"array<{dict(rows.dtypes)[name]}>"))
            out = rows.sparkSession.range(1).select(listed.alias(name)) if out is None else out.withColumn(name, listed)
    return out.join(rows.select(*axes), list(axes), "left_anti")


@query("int_variant_matrix", """WITH b AS (SELECT DISTINCT p_brand FROM part), z AS (SELECT unnest(range(1, 51))::INT AS p_size) SELECT p_brand, p_size FROM b, z EXCEPT SELECT p_brand, p_size FROM part""")
def q_matrix(spark, sf_dir: str) -> DataFrame:
    """Row 174."""
    return missing_combinations(table(spark, sf_dir, "part").select("p_brand", "p_size"), {"p_brand": None, "p_size": list(range(1, 51))})


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once and cut from its plan, in ``spark.checkpoint.dir``; only a local master may go without one."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        found = sc.getConf().get("spark.checkpoint.dir") or df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not found and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(found or tempfile.mkdtemp(prefix="atlasgrain-"))
    return df.checkpoint()


def reference_cycles(edges: DataFrame) -> DataFrame:
    """Rows 175 to 177: the cycles of a graph in which a node (a) has at most one successor (b), as start (least node) and length.

    Doubling: after k rounds a node knows the node 2^k steps ahead and the least on the way; rounds follow the number of
    nodes, and each is written, so plans stay small. Chains that end drop out. Null ends and repeated edges play no part.
    """
    edges = edges.where("a IS NOT NULL AND b IS NOT NULL").distinct()
    j = settled(edges.select("a", F.col("b").alias("at"), F.least("a", "b").alias("least")))
    for _ in range(max(1, j.count()).bit_length()):
        ahead = j.select(F.col("a").alias("at"), F.col("at").alias("then"), F.col("least").alias("farther"))
        j = settled(j.join(ahead, "at").select("a", F.col("then").alias("at"), F.least("least", "farther").alias("least")))
    on_cycle = j.select(F.col("at").alias("a")).distinct()  # that far along, only cycle nodes are reached
    return j.join(on_cycle, "a", "left_semi").groupBy(F.col("least").alias("start")).agg(F.count(F.lit(1)).alias("length"))


_NEXT = "c_custkey - c_custkey % 50 + (c_custkey % 50 * 7 + 3) % 50"


@query("int_reference_cycles", f"""WITH RECURSIVE e AS (SELECT c_custkey AS a, {_NEXT} AS b FROM customer), w AS (SELECT a, b FROM e UNION SELECT w.a, e.b FROM w JOIN e ON e.a = w.b), c AS (SELECT a FROM w WHERE a = b),
m AS (SELECT c.a, min(w.b) AS start FROM c JOIN w ON w.a = c.a GROUP BY c.a) SELECT start, count(*)::BIGINT AS length FROM m GROUP BY start""")
def q_cycles(spark, sf_dir: str) -> DataFrame:
    return reference_cycles(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("a"), F.expr(_NEXT).alias("b")))


def lineage_depth(rows: DataFrame, group: str, place: str) -> DataFrame:
    """Row 177: how far a chain of parents (each at the place before) reaches from its root without a gap."""
    c, w = rows.select(group, place).distinct(), Window.partitionBy(group)
    linked = c.withColumn("_gap", F.col(place) - F.min(place).over(w) - F.row_number().over(w.orderBy(place)) + 1).where("_gap = 0")
    return linked.groupBy(group).agg((F.count(F.lit(1)) - 1).alias("depth"), F.count(F.lit(1)).alias("reached"))


@query("int_lineage_chain", """WITH RECURSIVE c AS (SELECT conv_id, turn, turn AS root, 0 AS depth FROM conversations WHERE turn = (SELECT min(turn) FROM conversations x WHERE x.conv_id = conversations.conv_id) UNION ALL SELECT n.conv_id, n.turn, c.root, c.depth + 1 FROM c JOIN conversations n ON n.conv_id = c.conv_id AND n.turn = c.turn + 1)
SELECT conv_id, max(depth)::BIGINT AS depth, count(*)::BIGINT AS reached FROM c GROUP BY conv_id""")
def q_lineage(spark, sf_dir: str) -> DataFrame:
    """Row 177; gaps and islands, not recursion."""
    return lineage_depth(table(spark, sf_dir, "conversations"), "conv_id", "turn")


def order_rules(rows: DataFrame, group: str, order: str, depth: str) -> DataFrame:
    """Row 182: of each group, whether its order has no gaps from 1, and whether depth never falls along it."""
    w = Window.partitionBy(group).orderBy(order, depth)
    o = rows.select(group, order, depth, F.lag(depth).over(w).alias("_before"), F.row_number().over(w).alias("_rank"))
    return o.groupBy(group).agg(F.bool_and(F.col("_rank") == F.col(order)).alias("contiguous"), F.bool_and(F.col("_before").isNull() | (F.col(depth) >= F.col("_before"))).alias("rising"))


@query("int_order_rules", """WITH o AS (SELECT l_orderkey, l_linenumber, l_extendedprice, lag(l_extendedprice) OVER w AS before, row_number() OVER w AS rn FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice))
SELECT l_orderkey, bool_and(rn = l_linenumber) AS contiguous, bool_and(before IS NULL OR l_extendedprice >= before) AS rising FROM o GROUP BY l_orderkey""")
def q_order(spark, sf_dir: str) -> DataFrame:
    """Row 182."""
    return order_rules(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", "l_extendedprice")


def required_members(rows: DataFrame, key: str, member: str, required: list[str]) -> DataFrame:
    """Rows 183, 187: the members that each key has, sorted, and the required ones that it lacks, in their order."""
    g = rows.groupBy(key).agg(F.array_sort(F.collect_set(member)).alias("present"))
    return g.withColumn("missing", F.array_except(F.array(*map(F.lit, required)), F.col("present")))


@query("int_required_sets", """SELECT o_custkey, array_to_string(list_sort(list(DISTINCT o_orderstatus)), ',') AS present, array_to_string(list_sort(list_filter(['F', 'O', 'P'], lambda s: NOT list_contains(list(DISTINCT o_orderstatus), s))), ',') AS missing FROM orders GROUP BY o_custkey""")
def q_required(spark, sf_dir: str) -> DataFrame:
    """Rows 183, 187."""
    g = required_members(table(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus", ["F", "O", "P"])
    return g.select("o_custkey", F.array_join("present", ",").alias("present"), F.array_join("missing", ",").alias("missing"))


def unmet_needs(rows: DataFrame, key: str, kind: str, needs: dict[str, str], held: DataFrame) -> DataFrame:
    """Row 184: rows of a kind that requires something (``needs``) which ``held`` (key, needs) does not have."""
    rules = F.create_map(*[F.lit(x) for p in needs.items() for x in p])
    asked = rows.withColumn("needs", F.try_element_at(rules, F.col(kind))).where("needs IS NOT NULL")
    return asked.join(held.select(key, "needs").distinct(), [key, "needs"], "left_anti")


@query("int_rule_dimension", """WITH r(seg, needs) AS (VALUES ('BUILDING', 'F'), ('MACHINERY', 'O'), ('AUTOMOBILE', 'P')) SELECT c_custkey, c_mktsegment, needs FROM customer JOIN r ON seg = c_mktsegment WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = needs)""")
def q_licence(spark, sf_dir: str) -> DataFrame:
    """Row 184: what a kind requires, against what is there."""
    held = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderstatus").alias("needs"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return unmet_needs(c, "c_custkey", "c_mktsegment", {"BUILDING": "F", "MACHINERY": "O", "AUTOMOBILE": "P"}, held).select("c_custkey", "c_mktsegment", "needs")


def later_uses(rows: DataFrame, label: list[str], order: str) -> DataFrame:
    """Row 185: rows that use a label again after the first one in order."""
    return rows.withColumn("_use", F.row_number().over(Window.partitionBy(*label).orderBy(order))).where("_use > 1").drop("_use")


@query("int_catalogue_duplicates", """SELECT p_partkey, p_name, p_brand FROM part QUALIFY row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) > 1""")
def q_catalogue(spark, sf_dir: str) -> DataFrame:
    """Row 185."""
    return later_uses(table(spark, sf_dir, "part"), ["p_brand", "p_size"], "p_partkey").select("p_partkey", "p_name", "p_brand")


def not_checked(expected: DataFrame, checked: DataFrame, key: str) -> DataFrame:
    """Row 186: expected items that were not checked."""
    return expected.join(checked.select(key), key, "left_anti")


@query("int_expected_checked", """SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def q_coverage(spark, sf_dir: str) -> DataFrame:
    """Row 186."""
    return not_checked(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


def exact_aspect(width: Column, height: Column, across: Column, down: Column) -> Column:
    """Row 179: whether two shapes agree exactly, by cross-multiplication."""
    return width * down == height * across


def safe_zone(low: Column, high: Column, size: Column | int) -> Column:
    """Row 179: whether a zone lies inside a side."""
    return (low >= 0) & (high <= size)


@query("int_geometry", """SELECT p_partkey, p_size * 9 = (p_size % 16) * 16 AS exact_aspect, p_size - 3 >= 0 AND p_size + 3 <= 48 AS safe FROM part""")
def q_geometry(spark, sf_dir: str) -> DataFrame:
    """Row 179."""
    n = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", exact_aspect(n, n % 16, F.lit(16), F.lit(9)).alias("exact_aspect"), safe_zone(n - 3, n + 3, 48).alias("safe"))


def first_fit(rows: DataFrame, group: str, order: str, fits: Column, keep: list[str]) -> DataFrame:
    """Rows 189, 191: of each group the first row that fits, in order."""
    return rows.where(fits).groupBy(group).agg(F.min_by(F.struct(*keep), order).alias("m")).select(group, "m.*")


@query("int_template_choice", """SELECT p_brand, p_partkey, p_type FROM part WHERE p_size = 8 OR p_size % 5 = 0 QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) = 1""")
def q_template(spark, sf_dir: str) -> DataFrame:
    """Rows 189, 191."""
    return first_fit(table(spark, sf_dir, "part"), "p_brand", "p_partkey", F.expr("p_size = 8 OR p_size % 5 = 0"), ["p_partkey", "p_type"])


def frame_budget(kind: Column, frames: Column, limits: list[tuple[str, int]]) -> Column:
    """Row 192: frames under the limit of the first pattern that the kind matches."""
    out = frames
    for pattern, most in reversed(limits):
        out = F.when(kind.rlike(pattern), F.least(frames, F.lit(most))).otherwise(out)
    return out


def frame_rate(duration_ms: Column) -> Column:
    """Row 192: whole frames a second for a duration, halves to even."""
    return F.rint(1000 / duration_ms).cast("int")


@query("int_preset_budget", """SELECT p_partkey, CASE WHEN regexp_matches(p_type, 'STEEL|steel') THEN least(p_size, 8) WHEN regexp_matches(p_type, 'BRASS|brass') THEN least(p_size, 12) ELSE p_size END::INT AS budget, round_even(1000 / (p_size + 40)::DOUBLE, 0)::INT AS fps FROM part""")
def q_preset(spark, sf_dir: str) -> DataFrame:
    """Row 192."""
    p, n = F.col("p_type"), F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", frame_budget(p, n, [("STEEL|steel", 8), ("BRASS|brass", 12)]).alias("budget"), frame_rate(n + 40).alias("fps"))


@query("int_path_rules", r"""WITH p AS (SELECT page_id, regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*/?([^?#]*)', 1), '/$', '') AS path FROM pages)
SELECT page_id, path, CASE WHEN path = '' THEN 'empty' WHEN starts_with(path, '/') THEN 'absolute' WHEN len(list_filter(string_split(path, '/'), lambda s: s IN ('', '.', '..'))) > 0 THEN 'segment' WHEN len(list_filter(string_split(path, '/'), lambda s: regexp_matches(s, '[. ]$'))) > 0 THEN 'ending' END AS problem FROM p""")
def q_paths(spark, sf_dir: str) -> DataFrame:
    """Rows 180, 181."""
    path = F.regexp_replace(F.regexp_extract("url", "^[a-z]+://[^/?#]*/?([^?#]*)", 1), "/$", "")
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path")).withColumn("problem", T.path_problem(F.col("path")))
