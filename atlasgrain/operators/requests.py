"""Text, tokens, JSON and request planning (survey rows 1 to 7, 219 to 250)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.registry import query
from .integrity import table

#: In canonical order.
WORKFLOWS = [("jump", ["almond", "antique"]), ("attack", ["blue", "bisque"]), ("idle", ["chiffon", "cream", "red"]), ("walk", ["green", "steel", "tin"])]
_LISTS = ", ".join("CASE WHEN " + " OR ".join(f"list_contains(t, '{w}')" for w in words) + f" THEN '{name}' END" for name, words in WORKFLOWS)
_TOKENS = "list_distinct(regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z0-9]+'))"


@query("txt_tokens", f"SELECT p_partkey, len({_TOKENS})::INT AS n, array_to_string(list_sort({_TOKENS}), ' ') AS tokens FROM part")
def q_tokens(spark, sf_dir: str) -> DataFrame:
    """Row 219."""
    t = T.tokens(F.concat_ws(" ", "p_name", "p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", F.size(t).alias("n"), F.array_join(F.array_sort(t), " ").alias("tokens"))


@query("txt_positive_tokens", r"""WITH d AS (SELECT doc_id, lower(regexp_replace(regexp_replace(text, '[^ -~\n]', '', 'g'), '\n', ' ', 'g')) AS s FROM documents), c AS (SELECT doc_id, regexp_replace(s, '\b(and|that|never|without)\b.*$', '') AS s FROM d) SELECT doc_id, len(list_distinct(regexp_extract_all(s, '[a-z0-9]+')))::INT AS n FROM c""")
def q_positive(spark, sf_dir: str) -> DataFrame:
    """Row 219: tokens before the first word that turns the sense, over ASCII text."""
    s = F.lower(F.regexp_replace(F.regexp_replace("text", r"[^ -~\n]", ""), "\n", " "))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.tokens(F.regexp_replace(s, r"\b(and|that|never|without)\b.*$", ""))).alias("n"))


def choose(explicit: Column, inferred: Column, default: str) -> Column:
    """Row 224: an explicit choice comes first, then what was inferred, then a default."""
    return F.coalesce(explicit, F.nullif(inferred, F.lit("")), F.lit(default))


@query("txt_workflows", f"WITH t AS (SELECT p_partkey, p_size, {_TOKENS} AS t FROM part), w AS (SELECT p_partkey, p_size, concat_ws(',', {_LISTS}) AS inferred FROM t) SELECT p_partkey, inferred, CASE WHEN p_size % 10 = 0 THEN 'walk' WHEN inferred <> '' THEN inferred ELSE 'idle' END AS chosen FROM w")
def q_workflows(spark, sf_dir: str) -> DataFrame:
    """Rows 220, 221, 224: labels by words, in canonical order."""
    found = F.array_join(T.first_word_sets(T.tokens(F.concat_ws(" ", "p_name", "p_type")), WORKFLOWS), ",")
    w = table(spark, sf_dir, "part").select("p_partkey", "p_size", found.alias("inferred"))
    return w.select("p_partkey", "inferred", choose(F.when(F.col("p_size") % 10 == 0, "walk"), F.col("inferred"), "idle").alias("chosen"))


@query("txt_slugs", """WITH s AS (SELECT p_partkey, trim(regexp_replace(lower(p_name || '#' || p_type), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part) SELECT p_partkey, slug, regexp_matches(slug, '^[a-z0-9]+(-[a-z0-9]+)*$') AND length(slug) <= 64 AS valid FROM s""")
def q_slugs(spark, sf_dir: str) -> DataFrame:
    """Rows 226, 227."""
    return table(spark, sf_dir, "part").select("p_partkey", T.slug(F.concat_ws("#", "p_name", "p_type")).alias("slug")).withColumn("valid", T.is_slug(F.col("slug")))


@query("txt_lists", """SELECT c_custkey, array_to_string(list_filter(list_transform(string_split(c_mktsegment || ', ,' || c_name || ' ,', ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS items FROM customer""")
def q_lists(spark, sf_dir: str) -> DataFrame:
    """Rows 225, 228."""
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(T.csv_list(F.concat("c_mktsegment", F.lit(", ,"), "c_name", F.lit(" ,"))), "|").alias("items"))


def locomotion(declared: Column, named: Column, list_decides: bool) -> Column:
    """Row 223: declared (true, false, or null for no list) and named by words. For the checker a declared list decides
    alone; for the planner either is enough."""
    return F.coalesce(declared, named) if list_decides else F.coalesce(declared, F.lit(False)) | named


@query("txt_locomotion", """SELECT p_partkey, p_size % 3 = 0 OR (p_size % 3 = 1 AND regexp_matches(lower(p_name), '(walk|green|red)')) AS by_checker, p_size % 3 = 0 OR regexp_matches(lower(p_name), '(walk|green|red)') AS by_planner FROM part""")
def q_locomotion(spark, sf_dir: str) -> DataFrame:
    """Row 223."""
    k, named = F.col("p_size") % 3, F.lower("p_name").rlike("(walk|green|red)")
    declared = F.when(k == 0, True).when(k == 2, False)
    return table(spark, sf_dir, "part").select("p_partkey", locomotion(declared, named, True).alias("by_checker"), locomotion(declared, named, False).alias("by_planner"))


def first_kind(text: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """Rows 222, 242, 243: the name of the first pattern that a text matches."""
    out = F.lit(default)
    for pattern, name in reversed(rules):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


@query("txt_pose_kind", """SELECT p_partkey, CASE WHEN regexp_matches(lower(p_name), 'blue') THEN 'crouch' WHEN regexp_matches(lower(p_name), 'green') THEN 'jump' ELSE 'stand' END AS pose, CASE WHEN regexp_matches(lower(p_name), 'blue') THEN 0.62::DOUBLE ELSE 1.0::DOUBLE END AS height FROM part""")
def q_pose(spark, sf_dir: str) -> DataFrame:
    """Rows 222, 242, 243: the first kind that matches, and what follows from it."""
    pose = first_kind(F.lower("p_name"), [("blue", "crouch"), ("green", "jump")], "stand")
    return table(spark, sf_dir, "part").select("p_partkey", pose.alias("pose"), F.when(pose == "crouch", 0.62).otherwise(1.0).alias("height"))


def sampling_policy(pixel_art: Column, repeats: Column) -> dict[str, Column]:
    """Rows 229, 234: how a texture is sampled: pixel art by the nearest pixel and without mipmaps, repeats wrapped."""
    return {"filter_": F.when(pixel_art, "nearest").otherwise("linear"), "wrap_": F.when(repeats, "repeat").otherwise("clamp"), "mipmaps": ~pixel_art}


@query("txt_sampling_policy", """SELECT p_partkey, CASE WHEN p_size <= 16 THEN 'nearest' ELSE 'linear' END AS filter_, CASE WHEN p_type LIKE '%TIN%' THEN 'repeat' ELSE 'clamp' END AS wrap_, p_size > 16 AS mipmaps FROM part""")
def q_policy(spark, sf_dir: str) -> DataFrame:
    """Rows 229, 234."""
    policy = sampling_policy(F.col("p_size") <= 16, F.col("p_type").contains("TIN"))
    return table(spark, sf_dir, "part").select("p_partkey", *[c.alias(k) for k, c in policy.items()])


def json_facts(text: Column) -> dict[str, Column]:
    """Rows 1, 2, 7, 230: whether a text parses, whether it is an object, and the number of its keys; never a failure."""
    v = F.try_parse_json(text)
    return {"parsed": v.isNotNull(), "is_object": F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)), "keys": F.size(F.json_object_keys(text))}


@query("txt_json_contract", """SELECT event_id, json_valid(props) AS parsed, coalesce(json_type(props) = 'OBJECT', false) AS is_object, len(json_keys(props))::INT AS keys FROM events WHERE props IS NOT NULL""")
def q_json(spark, sf_dir: str) -> DataFrame:
    """Rows 1, 2, 7, 230."""
    e = table(spark, sf_dir, "events").where("props IS NOT NULL")
    return e.select("event_id", *[c.alias(k) for k, c in json_facts(F.col("props")).items()])


def error_place(*steps: Column | str) -> dict[str, Column]:
    """Rows 232, 258: where in a document an error is, as a JSON path and dotted; numbers (columns of ints) are places in lists."""
    path, dotted = F.lit("$"), []
    for s in steps:
        name = isinstance(s, str)
        path = F.concat(path, F.lit(f".{s}")) if name else F.concat(path, F.lit("["), s.cast("string"), F.lit("]"))
        dotted.append(F.lit(s) if name else s.cast("string"))
    return {"place": path, "dotted": F.concat_ws(".", *dotted)}


@query("txt_schema_errors", """SELECT o_orderkey, '$.orders[' || (o_orderkey % 7) || '].' || CASE WHEN o_totalprice < 0 THEN 'total' ELSE 'status' END AS place, concat_ws('.', 'orders', o_orderkey % 7, CASE WHEN o_totalprice < 0 THEN 'total' ELSE 'status' END) AS dotted FROM orders""")
def q_errors(spark, sf_dir: str) -> DataFrame:
    """Rows 232, 258: two ways to write where an error is."""
    k, low = F.col("o_orderkey") % 7, F.col("o_totalprice") < 0
    total, status = error_place("orders", k, "total"), error_place("orders", k, "status")
    return table(spark, sf_dir, "orders").select("o_orderkey", *[F.when(low, total[c]).otherwise(status[c]).alias(c) for c in ("place", "dotted")])


def batch_identity(explicit: Column, *parts: Column) -> Column:
    """Rows 231, 233: an explicit identity, else its parts by slashes."""
    return F.coalesce(explicit, F.concat_ws("/", *[p.cast("string") for p in parts]))


@query("txt_batch_identity", """SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN 'id-' || o_orderkey END, concat_ws('/', o_custkey, o_orderstatus, substr(o_orderpriority, 1, 1))) AS identity FROM orders""")
def q_identity(spark, sf_dir: str) -> DataFrame:
    """Rows 231, 233."""
    told = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("id-"), F.col("o_orderkey").cast("string")))
    return table(spark, sf_dir, "orders").select("o_orderkey", batch_identity(told, F.col("o_custkey"), F.col("o_orderstatus"), F.substring("o_orderpriority", 1, 1)).alias("identity"))


PHASES = ["contact-a", "down-a", "pass-a", "up-a", "contact-b", "down-b", "pass-b", "up-b"]
#: Which phases a cycle of so many frames shows.
CYCLES = {n: [k for k in range(8) if n == 8 or (k % 4 != 3 if n == 6 else k % 2 == 0)] for n in (4, 6, 8)}


def phase_plan(rows: DataFrame, key: str, frames: str) -> DataFrame:
    """Row 241: key, frame and phase of each frame of a cycle of 4, 6 or 8; other numbers have no plan."""
    plans = F.create_map(*[x for n, ks in CYCLES.items() for x in (F.lit(n), F.array(*[F.lit(PHASES[k]) for k in ks]))])
    return rows.select(key, F.posexplode(F.try_element_at(plans, F.col(frames))).alias("frame", "phase"))


@query("plan_phases", """WITH p AS (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN [0, 2, 4, 6] WHEN 1 THEN [0, 1, 2, 4, 5, 6] ELSE [0, 1, 2, 3, 4, 5, 6, 7] END AS ph FROM part), d(k, name) AS (VALUES (0, 'contact-a'), (1, 'down-a'), (2, 'pass-a'), (3, 'up-a'), (4, 'contact-b'), (5, 'down-b'), (6, 'pass-b'), (7, 'up-b'))
SELECT p_partkey, (i - 1)::INT AS frame, name AS phase FROM (SELECT p_partkey, unnest(ph) AS k, generate_subscripts(ph, 1) AS i FROM p) JOIN d USING (k)""")
def q_phases(spark, sf_dir: str) -> DataFrame:
    """Row 241."""
    return phase_plan(table(spark, sf_dir, "part").select("p_partkey", F.expr("p_size % 3 * 2 + 4").alias("frames")), "p_partkey", "frames")


def state_defaults(frames: Column, fps_rules: list[tuple[Column, int]], default_frames: int = 4, default_fps: int = 10) -> dict[str, Column]:
    """Rows 235, 236: frames (none or zero: the default) and frame rate (of the first rule that holds)."""
    fps = F.lit(default_fps)
    for holds, value in reversed(fps_rules):
        fps = F.when(holds, value).otherwise(fps)
    return {"frames": F.coalesce(F.nullif(frames, F.lit(0)), F.lit(default_frames)).cast("int"), "fps": fps}


@query("plan_state_defaults", """SELECT o_orderkey, trim(lower(o_orderpriority)) AS state, coalesce(nullif(o_orderkey % 9, 0), 4)::INT AS frames, CASE WHEN o_orderstatus = 'O' THEN 12 WHEN o_orderstatus = 'F' THEN 8 ELSE 10 END AS fps, NOT regexp_matches(o_orderpriority, '^[a-z0-9-]+$') AS bad_slug FROM orders""")
def q_defaults(spark, sf_dir: str) -> DataFrame:
    """Rows 235 to 237: defaults of a state, and what is wrong with it."""
    s = F.col("o_orderstatus")
    found = state_defaults(F.col("o_orderkey") % 9, [(s == "O", 12), (s == "F", 8)])
    return table(spark, sf_dir, "orders").select("o_orderkey", F.trim(F.lower("o_orderpriority")).alias("state"), *[c.alias(k) for k, c in found.items()], (~F.col("o_orderpriority").rlike("^[a-z0-9-]+$")).alias("bad_slug"))


def selected_frames(rows: DataFrame, group: str, order: list[str], chosen: Column) -> DataFrame:
    """Rows 155, 250, 256: frames of each group in play order: those whose number is in ``chosen``, all where that is null."""
    w = Window.partitionBy(group)
    n = rows.withColumn("_k", F.row_number().over(w.orderBy(*order)) - 1).where(chosen.isNull() | F.array_contains(chosen, F.col("_k")))
    return n.withColumn("play", F.row_number().over(w.orderBy("_k")) - 1).drop("_k")


@query("plan_selected_cycle", """WITH n AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events), s AS (SELECT * FROM n WHERE CASE WHEN user_id % 2 = 0 THEN k IN (0, 2, 4) ELSE true END) SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY k) - 1)::INT AS play FROM s""")
def q_cycle(spark, sf_dir: str) -> DataFrame:
    """Rows 155, 250, 256."""
    chosen = F.when(F.col("user_id") % 2 == 0, F.array(F.lit(0), F.lit(2), F.lit(4)))
    return selected_frames(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], chosen).select("user_id", "event_id", "play")


def job_binding(*inputs: Column) -> Column:
    """Rows 197, 247, 257: the digest that binds a job to its inputs."""
    return F.sha2(F.concat_ws("|", *[c.cast("string") for c in inputs]), 256)


@query("plan_job_binding", """SELECT l_orderkey, l_linenumber, sha256(concat_ws('|', l_orderkey, l_partkey, l_shipdate::DATE)) AS job FROM lineitem""")
def q_jobs(spark, sf_dir: str) -> DataFrame:
    """Rows 247, 257."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", job_binding(F.col("l_orderkey"), F.col("l_partkey"), F.col("l_shipdate").cast("date")).alias("job"))


def repairs(rows: DataFrame, key: str, state: str, failed: Column) -> DataFrame:
    """Rows 252, 259: of each key the states that failed, sorted, and the number of failures; keys without any are left out."""
    g = rows.groupBy(key).agg(F.array_sort(F.collect_set(F.when(failed, F.col(state)))).alias("repairs"), F.count_if(failed).alias("n"))
    return g.where("n > 0")


@query("plan_repairs", """SELECT o_custkey, array_to_string(list_sort(list(DISTINCT o_orderstatus) FILTER (o_totalprice > 100000)), ',') AS repairs, count(*) FILTER (o_totalprice > 100000)::BIGINT AS n FROM orders GROUP BY o_custkey HAVING count(*) FILTER (o_totalprice > 100000) > 0""")
def q_repairs(spark, sf_dir: str) -> DataFrame:
    """Rows 252, 259."""
    return repairs(table(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus", F.col("o_totalprice") > 100000).withColumn("repairs", F.array_join("repairs", ","))
