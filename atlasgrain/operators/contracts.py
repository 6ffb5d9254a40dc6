"""Rules over contract rows (survey rows 15, 71, 123, 142, 147, 148, 154, 170, 190, 201, 217, 238 to 240, 248, 261, 264).

Each rule is a function over columns or rows of a contract; its query applies it to contract rows that are made of the
driver's tables, all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.registry import query
from .integrity import table

#: In order.
GATES = "generation-provenance animation-contracts frame-alignment identity-consistency motion-variation asset-slots isometric-tiles segmentation-diagnostic frame-registration runtime-preview".split()
LOCOMOTION = "front-fps-creature-locomotion run-gun-layered-motion sideview-locomotion topdown-locomotion".split()
ISOMETRIC = ["2:1-dimetric", "2:1 dimetric diamond", "dimetric-2:1", "isometric"]
ASSET_KINDS = "asset icon prop sprite texture tileset ui vfx".split()
SEMANTICS = "animation effects seamless-textures still-assets tiles user-defined variants".split()
MOVES = "block combo guard hitstun kick knockdown punch special".split()
LIMBS = "arm claw fist foreleg gauntlet hand hook limb mandible pincer scythe tentacle wing".split() + ["front leg"]
CROSSING = ["bilateral", "cross", "inward", "x shaped", "x-shaped"]
HEADS = "head jaw maw mouth tusk".split()
#: What any review of identity errors has to pin.
EVIDENCE = "frames/frames-manifest.json qa/background-matte-review.png sprite-request.json sprite-sheet-alpha.png".split()


def yes(c: Column) -> Column:
    """A condition whose unknown is false."""
    return F.coalesce(c, F.lit(False))


def request_errors(version: Column, kind: Column, asset_kind: Column, semantics: Column, extraction: Column, n_states: Column) -> Column:
    """Row 201: which facts keep a request from being normalised, in order."""
    wrong = [(version == 2, "version"), (kind == "sprite-gen-request", "kind"), (asset_kind.isin(ASSET_KINDS), "asset_kind"), (semantics.isin(SEMANTICS), "frame_semantics"), (extraction.isin("components", "slots"), "extraction_mode"), (n_states > 0, "states")]
    return F.array_compact(F.array(*[F.when(~yes(good), name) for good, name in wrong]))


def gate_policy(requests: DataFrame, workflow: str = "production", selectors: list[str] | None = None) -> DataFrame:
    """Row 201: for each request and gate, in order, whether it applies and why not.

    ``requests``: request_id, asset_kind, frame_semantics, extraction_mode, frames (sum over states), workflows (array, of
    the request and its states), projection, camera, catalog_projection, isometric. Gates off an explicit selector list do
    not apply, and such a run is partial. A null fact is a fact that is not so.
    """
    if workflow not in ("production", "import-diagnostic") or set(selectors or []) - set(GATES):
        raise ValueError("unknown workflow or gate")
    c = F.col
    made, sprite, tiles = F.lit(workflow == "production"), yes(c("asset_kind") == "sprite"), yes(c("asset_kind") == "tileset")
    animated = yes(c("frame_semantics").isin("animation", "effects"))
    iso = tiles & (yes(c("projection").isin(ISOMETRIC)) | yes(c("camera") == "isometric") | yes(c("catalog_projection").isin(ISOMETRIC)) | yes(c("isometric")))
    rules = [made, made & animated, made & animated & sprite, made & sprite & (animated | yes(c("frames") > 1)), made & yes(F.arrays_overlap("workflows", F.array(*map(F.lit, LOCOMOTION)))), made & yes(c("extraction_mode") == "slots"), made & iso, ~made, ~made & sprite, made & animated]
    rows = [F.struct(F.lit(k + 1).alias("ord"), F.lit(g).alias("gate"), r.alias("rule"), F.lit(selectors is None or g in selectors).alias("selected")) for k, (g, r) in enumerate(zip(GATES, rules, strict=True))]
    out = requests.select("request_id", F.explode(F.array(*rows)).alias("g")).select("request_id", "g.*")
    return out.select("request_id", "ord", "gate", (c("rule") & c("selected")).alias("applied"), F.when(~c("selected"), "not selected").when(c("rule"), "required").otherwise("not required").alias("reason"))


_FACTS = """o_orderkey AS request_id, CASE o_orderkey % 5 WHEN 0 THEN 'sprite' WHEN 1 THEN 'tileset' WHEN 2 THEN 'texture' WHEN 3 THEN 'sprite' ELSE NULL END AS asset_kind,
CASE o_orderkey % 4 WHEN 0 THEN 'animation' WHEN 1 THEN 'tiles' WHEN 2 THEN 'still-assets' ELSE 'effects' END AS frame_semantics, CASE WHEN o_orderkey % 3 = 0 THEN 'slots' ELSE 'components' END AS extraction_mode,
CAST(o_custkey % 3 AS INT) AS frames, CASE WHEN o_orderkey % 7 = 1 THEN 'dimetric-2:1' END AS projection, CASE WHEN o_orderkey % 11 = 1 THEN 'isometric' ELSE 'side' END AS camera,
CASE WHEN o_orderkey % 13 = 1 THEN 'isometric' END AS catalog_projection, o_orderkey % 17 = 1 AS isometric, CASE o_orderkey % 6 WHEN 0 THEN 'sideview-locomotion' WHEN 1 THEN 'gesture-loop' ELSE 'idle-breath' END AS workflow"""


def requests(spark, sf_dir: str) -> DataFrame:
    return spark.sql(f"SELECT {_FACTS} FROM {{orders}}", orders=table(spark, sf_dir, "orders")).withColumn("workflows", F.array("workflow"))


_ANIMATED, _LOCO = "frame_semantics IN ('animation', 'effects')", "workflow = 'sideview-locomotion'"
_GATE_SQL = f"""WITH r AS (SELECT {_FACTS} FROM orders), g AS (
SELECT request_id, 1 AS ord, 'generation-provenance' AS gate, true AS applied FROM r UNION ALL SELECT request_id, 2, 'animation-contracts', {_ANIMATED} FROM r UNION ALL
SELECT request_id, 3, 'frame-alignment', {_ANIMATED} AND coalesce(asset_kind, '') = 'sprite' FROM r UNION ALL SELECT request_id, 4, 'identity-consistency', coalesce(asset_kind, '') = 'sprite' AND ({_ANIMATED} OR frames > 1) FROM r UNION ALL
SELECT request_id, 5, 'motion-variation', {_LOCO} FROM r UNION ALL SELECT request_id, 6, 'asset-slots', extraction_mode = 'slots' FROM r UNION ALL
SELECT request_id, 7, 'isometric-tiles', coalesce(asset_kind, '') = 'tileset' AND (coalesce(projection, '') = 'dimetric-2:1' OR camera = 'isometric' OR coalesce(catalog_projection, '') = 'isometric' OR isometric) FROM r UNION ALL
SELECT request_id, 8, 'segmentation-diagnostic', false FROM r UNION ALL SELECT request_id, 9, 'frame-registration', false FROM r UNION ALL SELECT request_id, 10, 'runtime-preview', {_ANIMATED} FROM r)
SELECT request_id, ord, gate, applied, CASE WHEN applied THEN 'required' ELSE 'not required' END AS reason FROM g"""


@query("ev_gate_policy", _GATE_SQL)
def q_gates(spark, sf_dir: str) -> DataFrame:
    return gate_policy(requests(spark, sf_dir))


@query("ev_gate_policy_import", f"""WITH r AS (SELECT {_FACTS} FROM orders), g(ord, gate) AS (VALUES {", ".join(f"({k + 1}, '{g}')" for k, g in enumerate(GATES))})
SELECT request_id, ord, gate, ord = 8 AS applied, CASE WHEN ord NOT IN (8, 2) THEN 'not selected' WHEN ord = 8 THEN 'required' ELSE 'not required' END AS reason FROM r, g""")
def q_gates_import(spark, sf_dir: str) -> DataFrame:
    """Row 201: a diagnostic import with two gates asked for."""
    return gate_policy(requests(spark, sf_dir), "import-diagnostic", ["animation-contracts", "segmentation-diagnostic"])


def full_bleed(asset_kind: Column, repeat_mode: Column) -> Column:
    """Row 123: slots of tile sets and textures that are filled without a margin."""
    return yes(asset_kind.isin("tileset", "texture")) & yes(repeat_mode.isin("self", "adjacency"))


@query("plan_full_bleed", f"""WITH r AS (SELECT {_FACTS} FROM orders), k AS (SELECT l_orderkey, l_linenumber, CASE l_partkey % 4 WHEN 0 THEN 'self' WHEN 1 THEN 'adjacency' WHEN 2 THEN 'none' END AS repeat_mode FROM lineitem)
SELECT l_orderkey, l_linenumber, coalesce(asset_kind IN ('tileset', 'texture') AND repeat_mode IN ('self', 'adjacency'), false) AS full_bleed FROM k JOIN r ON request_id = l_orderkey""")
def q_full_bleed(spark, sf_dir: str) -> DataFrame:
    slots = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.expr("CASE l_partkey % 4 WHEN 0 THEN 'self' WHEN 1 THEN 'adjacency' WHEN 2 THEN 'none' END AS repeat_mode"))
    r = requests(spark, sf_dir).select("request_id", "asset_kind")
    return slots.join(r, F.col("request_id") == F.col("l_orderkey")).select("l_orderkey", "l_linenumber", full_bleed(F.col("asset_kind"), F.col("repeat_mode")).alias("full_bleed"))


def descriptor(*parts: Column) -> Column:
    """Row 239: the request's words in one lower-cased line; a null is an empty word."""
    return F.lower(F.concat_ws(" ", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def production_workflows(asset_kind: Column, semantics: Column, frames: Column, words: Column) -> Column:
    """Row 238, in canonical order."""
    poses = yes(asset_kind == "sprite") & ~yes(semantics.isin("animation", "effects")) & yes(frames > 1)
    iso, top = words.contains("isometric") | words.contains("dimetric"), words.contains("topdown") | words.contains("top-down")
    names = [F.when(poses, "character-pose-set"), F.when(poses & iso, "isometric-direction-set"), F.when(poses & ~iso & top, "topdown-direction-set"), F.when(yes(asset_kind == "tileset"), "tileset-adjacency"), F.when(yes(asset_kind == "texture"), "seamless-material-set")]
    return F.array_compact(F.array(*names))


def fighting(words: Column, tokens: Column) -> Column:
    """Row 239: told by its words, or by a fighting move among its tokens."""
    moves = F.array(*map(F.lit, MOVES))
    return words.contains("fighting") | words.contains("fighter") | words.contains("combat") | yes(F.arrays_overlap(tokens, moves))


_SAID = "CASE o_orderkey % 9 WHEN 0 THEN 'Isometric hero' WHEN 1 THEN 'top-down hero' WHEN 2 THEN 'Combat stance' WHEN 3 THEN 'high kick' WHEN 4 THEN 'kicker walks' ELSE 'idle' END"


@query("plan_production_workflows", f"""WITH r AS (SELECT {_FACTS}, lower({_SAID}) AS said FROM orders), k AS (SELECT *, coalesce(asset_kind, '') = 'sprite' AND NOT {_ANIMATED} AND frames > 1 AS poses FROM r)
SELECT request_id, concat_ws(',', CASE WHEN poses THEN 'character-pose-set' END, CASE WHEN poses AND contains(said, 'isometric') THEN 'isometric-direction-set' WHEN poses AND contains(said, 'top-down') THEN 'topdown-direction-set' END,
  CASE asset_kind WHEN 'tileset' THEN 'tileset-adjacency' WHEN 'texture' THEN 'seamless-material-set' END) AS workflows, regexp_matches(said, 'fight|combat') OR len(list_intersect(string_split(said, ' '), ['kick', 'punch'])) > 0 AS fighting FROM k""")
def q_production(spark, sf_dir: str) -> DataFrame:
    r = requests(spark, sf_dir).join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request_id"), F.expr(f"{_SAID} AS said")), "request_id")
    words = descriptor(F.col("said"))
    tokens = F.split(words, "[^a-z0-9]+")
    return r.select("request_id", F.array_join(production_workflows(F.col("asset_kind"), F.col("frame_semantics"), F.col("frames"), words), ",").alias("workflows"), fighting(words, tokens).alias("fighting"))


def told(words: Column, *keys: str) -> Column:
    out = F.lit(False)
    for k in keys:
        out = out | yes(words.contains(k))
    return out


_ARMS = ["asymmetrical arm", "asymmetric arm", "extra long", "extra-long"]
LONG_SWING = ["long arm counter-swing", "long-arm counter-swing", *_ARMS]
LONG_STRIKE = ["elongated", "long arm", "long claw", *_ARMS]


def unreliable_proxies(head: Column, upper: Column, body: Column, anatomy: Column, locomotion: Column, movement: Column, attack: Column, scale_policy: Column) -> Column:
    """Row 147: identity proxies that a creature's build or motion makes meaningless, in order of name; none without a body width."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    kind, gait, moves, hits = low(anatomy), low(locomotion), low(movement), low(attack)
    both = F.concat_ws(" ", moves, hits)
    flaps = yes(scale_policy == "source-reference") & (kind.isin("winged", "flying") | gait.isin("fly", "flight"))
    swing = (kind == "biped") & told(moves, *LONG_SWING)
    crossing = (kind == "biped") & told(hits, "both") & told(hits, "elongated", "long arm") & told(hits, *CROSSING)
    no_head = yes(head / body < 0.12) | (kind.isin("multi-legged", "quadruped") & told(both, "maw", "mouth")) | ((kind == "hovering") & told(both, "jaw pod", "colony")) | ((kind == "amorphous") & told(hits, "maw", "mouth")) | (swing & told(hits, *LONG_STRIKE))
    names = F.array_compact(F.array(F.when(flaps, "body_mass_width_80"), F.when(no_head, "head_width"), F.when(yes(upper / body < 0.12) | flaps | swing | crossing, "upper_width")))
    return F.when(yes(body > 0), names).otherwise(F.array().cast("array<string>"))


def driven_by(state: Column, attack: Column, anatomy: Column, locomotion: Column) -> dict[str, Column]:
    """Row 147: attacks led by a limb or by the head, and airborne idle steps."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    hits = yes(state == "attack")
    limb = told(low(attack), *LIMBS)
    return {"limb": hits & limb, "head": hits & told(low(attack), *HEADS), "airborne": yes(state == "idle-step") & (low(anatomy).isin("hovering", "flying") | low(locomotion).isin("hover", "fly", "flight"))}


_CREATURE = """p_partkey, CAST(p_size % 9 AS DOUBLE) AS head, CAST(p_partkey % 13 AS DOUBLE) AS upper_, CAST(p_partkey % 60 AS DOUBLE) AS body,
CASE p_partkey % 7 WHEN 0 THEN 'Winged' WHEN 1 THEN 'quadruped' WHEN 2 THEN 'hovering' WHEN 3 THEN 'amorphous' WHEN 4 THEN 'biped' WHEN 5 THEN 'biped' END AS anatomy, CASE WHEN p_partkey % 5 = 0 THEN 'fly' ELSE 'walk' END AS locomotion,
CASE p_partkey % 4 WHEN 0 THEN 'Extra-long counter swing' WHEN 1 THEN 'colony drift' WHEN 2 THEN 'legs' END AS movement, CASE p_partkey % 6 WHEN 0 THEN 'both elongated arms cross' WHEN 1 THEN 'central maw' WHEN 2 THEN 'long claw' WHEN 3 THEN 'tusk ram' ELSE NULL END AS attack,
CASE WHEN p_partkey % 3 = 0 THEN 'source-reference' END AS scale_policy, CASE WHEN p_size % 2 = 0 THEN 'attack' ELSE 'idle-step' END AS state"""


@query("identity_unreliable", f"""WITH c AS (SELECT {_CREATURE} FROM part), k AS (SELECT *, lower(coalesce(anatomy, '')) AS kind, lower(coalesce(movement, '')) AS m, coalesce(attack, '') AS h FROM c),
f AS (SELECT *, coalesce(scale_policy, '') <> '' AND (kind = 'winged' OR locomotion = 'fly') AS flaps, kind = 'biped' AND m = 'extra-long counter swing' AS swing FROM k)
SELECT p_partkey, CASE WHEN body > 0 THEN concat_ws(',', CASE WHEN flaps THEN 'body_mass_width_80' END,
  CASE WHEN head / body < 0.12::DOUBLE OR (kind = 'quadruped' AND h = 'central maw') OR (kind = 'hovering' AND m = 'colony drift') OR (kind = 'amorphous' AND h = 'central maw') OR (swing AND h IN ('both elongated arms cross', 'long claw')) THEN 'head_width' END,
  CASE WHEN upper_ / body < 0.12::DOUBLE OR flaps OR swing OR (kind = 'biped' AND h = 'both elongated arms cross') THEN 'upper_width' END) ELSE '' END AS unreliable,
  state = 'attack' AND h IN ('both elongated arms cross', 'long claw') AS limb, state = 'attack' AND h IN ('central maw', 'tusk ram') AS head, state = 'idle-step' AND (kind = 'hovering' OR locomotion = 'fly') AS airborne FROM f""")
def q_unreliable(spark, sf_dir: str) -> DataFrame:
    c = spark.sql(f"SELECT {_CREATURE} FROM {{parts}}", parts=table(spark, sf_dir, "part"))
    col = F.col
    found = unreliable_proxies(col("head"), col("upper_"), col("body"), col("anatomy"), col("locomotion"), col("movement"), col("attack"), col("scale_policy"))
    led = driven_by(col("state"), col("attack"), col("anatomy"), col("locomotion"))
    return c.select("p_partkey", F.array_join(found, ",").alias("unreliable"), *[v.alias(k) for k, v in led.items()])


def waiver_issues(review: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Row 148: why a review of identity errors does not waive them; no issue means that it does.

    ``review``: run_id, version, status, reviewer, reason, covered (array), errors (array, the current ones), pins (array of
    path and sha). ``artifacts``: run_id, path, sha as they are now. A review covers exactly the current errors, pins all
    evidence of the states that they name, and no pin has changed.
    """
    fixed = [F.lit(x) for x in EVIDENCE]
    states = F.array_distinct(F.transform("errors", lambda e: F.substring_index(e, ":", 1)))
    needed = F.concat(F.array(*fixed), F.transform(states, lambda s: F.concat(F.lit("qa/"), s, F.lit("-contact.png"))), F.transform(states, lambda s: F.concat(F.lit("qa/"), s, F.lit("-onion.png"))))
    pins = review.select("run_id", F.explode("pins").alias("p")).select("run_id", "p.path", F.col("p.sha").alias("pinned"))
    now = artifacts.select("run_id", "path", F.col("sha").alias("now"))
    changed = pins.join(now, ["run_id", "path"], "left").where("now IS NULL OR now <> pinned").groupBy("run_id").agg(F.count(F.lit(1)).alias("changed"))
    r = review.join(changed, "run_id", "left")
    rules = [(yes(F.col("version") == 1), "version"), (yes(F.col("status") == "approved"), "status"), (yes(F.col("reviewer").isin("human", "vision-model")), "reviewer"), (yes(F.length(F.trim("reason")) >= 20), "reason"), (yes(F.col("covered") == F.col("errors")), "errors"),
             (F.col("changed").isNull(), "changed"), (F.size(F.array_except(needed, F.transform("pins", lambda p: p["path"]))) == 0, "evidence")]
    return r.select("run_id", F.array_compact(F.array(*[F.when(~good, name) for good, name in rules])).alias("issues"))


def fingerprint(artifacts: DataFrame) -> DataFrame:
    """Row 261: of a run's reviewed artifacts (run_id, path, sha, size), whatever their order: a digest of the canonical JSON."""
    entry = F.concat(F.lit('{"path":"'), F.col("path"), F.lit('","sha256":"'), F.col("sha"), F.lit('","size_bytes":'), F.col("size").cast("string"), F.lit("}"))
    g = artifacts.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("path", entry.alias("entry")))).alias("a"))
    return g.select("run_id", F.concat(F.lit("sha256:"), F.sha2(F.concat(F.lit("["), F.array_join("a.entry", ","), F.lit("]")), 256)).alias("fingerprint"), F.size("a").cast("long").alias("n"))


@query("ev_record_review", """WITH a AS (SELECT o_custkey AS run_id, 'out/' || o_orderkey || '.png' AS path, sha256(o_orderpriority || o_orderkey) AS sha, o_orderkey * 3 AS size FROM orders)
SELECT run_id, 'sha256:' || sha256('[' || string_agg('{"path":"' || path || '","sha256":"' || sha || '","size_bytes":' || size || '}', ',' ORDER BY path) || ']') AS fingerprint, count(*)::BIGINT AS n, bool_or(path = 'out/' || (run_id * 4) || '.png') AS overwrites FROM a GROUP BY run_id""")
def q_review(spark, sf_dir: str) -> DataFrame:
    """Row 261: the fingerprint of what was reviewed, and whether the report would overwrite a part of it."""
    a = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run_id"), F.concat(F.lit("out/"), F.col("o_orderkey").cast("string"), F.lit(".png")).alias("path"), F.sha2(F.concat("o_orderpriority", F.col("o_orderkey").cast("string")), 256).alias("sha"), (F.col("o_orderkey") * 3).alias("size"))
    target = F.concat(F.lit("out/"), (F.col("run_id") * 4).cast("string"), F.lit(".png"))
    hits = a.groupBy("run_id").agg(F.bool_or(F.col("path") == target).alias("overwrites"))
    return fingerprint(a).join(hits, "run_id")


def selector_labels(workflows: Column, slots: Column, idle: Column) -> Column:
    """Row 170: what each slot of a frame selector is to show."""
    of = lambda *x: F.array(*map(F.lit, x))
    plain = F.transform(F.sequence(F.lit(0), slots - 1), lambda k: F.when(F.array_contains(idle, k), "exact idle").otherwise(F.concat(F.lit("pose "), (k + 1).cast("string"))))
    four = slots == 4
    return F.when(four & F.array_contains(workflows, "front-fps-creature-locomotion"), of("exact idle", "phase a", "exact idle", "phase b")).when(four & F.array_contains(workflows, "front-fps-creature-attack"), of("exact idle", "anticipation", "contact", "exact idle")).otherwise(plain)


@query("plan_selector_labels", """WITH s AS (SELECT p_partkey, p_size % 4 + 2 AS slots, CASE p_partkey % 3 WHEN 0 THEN 'front-fps-creature-locomotion' WHEN 1 THEN 'front-fps-creature-attack' ELSE 'gesture-loop' END AS w FROM part)
SELECT p_partkey, CASE WHEN slots = 4 AND p_partkey % 3 = 0 THEN 'exact idle|phase a|exact idle|phase b' WHEN slots = 4 AND p_partkey % 3 = 1 THEN 'exact idle|anticipation|contact|exact idle'
  ELSE array_to_string([CASE WHEN k IN (0, 2) THEN 'exact idle' ELSE 'pose ' || (k + 1) END FOR k IN range(slots)], '|') END AS labels FROM s""")
def q_labels(spark, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "part").select("p_partkey", F.expr("p_size % 4 + 2").alias("slots"), F.expr("array(CASE p_partkey % 3 WHEN 0 THEN 'front-fps-creature-locomotion' WHEN 1 THEN 'front-fps-creature-attack' ELSE 'gesture-loop' END)").alias("w"))
    return s.select("p_partkey", F.array_join(selector_labels(F.col("w"), F.col("slots"), F.array(F.lit(0), F.lit(2))), "|").alias("labels"))


def video_report(sheets: DataFrame, reports: DataFrame) -> DataFrame:
    """Row 248: for each raw sheet (run_id, state, path, sha) the one video report (run_id, state, kind, removed, path, sha,
    report) that made it; more than one is an error, none is null."""
    fit = reports.where(F.col("kind").isin("sprite-video-source", "sprite-grok-video-source") & yes(F.col("removed"))).select("run_id", "state", "path", "sha", "report")
    g = sheets.join(fit, ["run_id", "state", "path", "sha"], "left").groupBy("run_id", "state", "path", "sha").agg(F.count("report").alias("n"), F.min("report").alias("report"))
    return g.select("run_id", "state", F.when(F.col("n") == 1, F.col("report")).alias("report"), (F.col("n") > 1).alias("ambiguous"))


@query("ev_video_report", """WITH s AS (SELECT o_orderkey AS run_id, o_orderstatus AS state FROM orders), r AS (SELECT l_orderkey AS run_id, l_returnflag, l_linenumber, l_linestatus FROM lineitem WHERE l_quantity <= 25 AND l_linenumber % 3 <> 0)
SELECT s.run_id, state, CASE WHEN count(l_linenumber) = 1 THEN min(l_linenumber) END AS report, count(l_linenumber) > 1 AS ambiguous FROM s LEFT JOIN r ON r.run_id = s.run_id AND l_linestatus = state GROUP BY s.run_id, state""")
def q_video_report(spark, sf_dir: str) -> DataFrame:
    sheet = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderstatus").alias("state"), F.lit("raw.png").alias("path"), F.col("o_orderkey").cast("string").alias("sha"))
    r = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_linestatus").alias("state"), F.when(F.col("l_linenumber") % 3 != 0, "sprite-video-source").otherwise("other").alias("kind"), (F.col("l_quantity") <= 25).alias("removed"), F.lit("raw.png").alias("path"), F.col("l_orderkey").cast("string").alias("sha"), F.col("l_linenumber").alias("report"))
    return video_report(sheet, r)


def merge_runs(before: DataFrame, now: DataFrame, order: DataFrame) -> DataFrame:
    """Row 154: a partial run's rows in place of those states' earlier ones, the others kept, in the request's order.

    ``before`` and ``now``: run_id, state and the same further columns; ``order``: run_id, state, ord. States that the
    request does not name go.
    """
    kept = before.join(now.select("run_id", "state").distinct(), ["run_id", "state"], "left_anti")
    return kept.withColumn("fresh", F.lit(False)).unionByName(now.withColumn("fresh", F.lit(True))).join(order, ["run_id", "state"])


@query("plan_merge_runs", """WITH b AS (SELECT o_custkey AS run_id, o_orderstatus AS state, max(o_orderkey) AS v FROM orders GROUP BY ALL), n AS (SELECT o_custkey AS run_id, o_orderstatus AS state, min(o_orderkey) AS v FROM orders WHERE o_totalprice > 150000 GROUP BY ALL),
o(state, ord) AS (VALUES ('O', 1), ('F', 2)), m AS (SELECT coalesce(n.run_id, b.run_id) AS run_id, coalesce(n.state, b.state) AS state, coalesce(n.v, b.v) AS v, n.v IS NOT NULL AS fresh FROM b FULL JOIN n ON n.run_id = b.run_id AND n.state = b.state)
SELECT run_id, state, v, fresh, ord FROM m JOIN o USING (state)""")
def q_merge(spark, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run_id"), F.col("o_orderstatus").alias("state"), "o_orderkey", "o_totalprice")
    before, now = o.groupBy("run_id", "state").agg(F.max("o_orderkey").alias("v")), o.where("o_totalprice > 150000").groupBy("run_id", "state").agg(F.min("o_orderkey").alias("v"))
    order = o.select("run_id").distinct().withColumn("s", F.explode(F.array(F.struct(F.lit("O").alias("state"), F.lit(1).alias("ord")), F.struct(F.lit("F").alias("state"), F.lit(2).alias("ord"))))).select("run_id", "s.*")
    return merge_runs(before, now, order)


def authored_boxes(files: DataFrame) -> DataFrame:
    """Row 15: rows of boxes in a JSON document (column json): file, state, ord, x, y, w, h, fps, loop, and the cell, by
    default the widest and tallest box.

    Rows name themselves by state, name or place; a box is an object or four numbers.
    """
    kind = "struct<cell:struct<width:int,height:int>,rows:array<struct<state:string,name:string,fps:int,loop:boolean,rects:array<string>>>>"
    d = files.select("file", F.from_json("json", kind).alias("d"))
    r = d.select("file", "d.cell", F.posexplode("d.rows").alias("k", "row")).select("file", "cell", F.coalesce("row.state", "row.name", F.concat(F.lit("row-"), F.col("k").cast("string"))).alias("state"), F.coalesce("row.fps", F.lit(6)).alias("fps"), F.coalesce("row.loop", F.lit(True)).alias("loop"), F.posexplode("row.rects").alias("ord", "rect"))
    four, named = F.from_json("rect", "array<int>"), F.from_json("rect", "struct<x:int,y:int,w:int,h:int>")
    side = lambda i, c: F.when(F.col("rect").startswith("["), F.get(four, F.lit(i))).otherwise(named[c]).alias(c)
    r = r.select("file", "state", "ord", "fps", "loop", "cell", *[side(i, c) for i, c in enumerate("xywh")])
    over = Window.partitionBy("file")
    size = lambda c, side: F.when(yes(F.col(f"cell.{c}") > 0), F.col(f"cell.{c}")).otherwise(F.max(side).over(over)).alias(f"cell_{side}")
    return r.select("file", "state", "ord", "x", "y", "w", "h", "fps", "loop", size("width", "w"), size("height", "h"))


@query("layout_authored_boxes", """WITH b AS (SELECT p_partkey AS file, k AS row_, j AS ord, (p_size + k)::INT AS x, j::INT AS y, (p_size % 7 + k + 1)::INT AS w, (p_size % 5 + j + 1)::INT AS h FROM part, range(2) t(k), range(2) u(j))
SELECT file, CASE WHEN row_ = 0 THEN 'walk' ELSE 'row-1' END AS state, ord::INT AS ord, x, y, w, h, CASE WHEN row_ = 0 THEN 9 ELSE 6 END AS fps, row_ = 1 AS loop, CASE WHEN file % 2 = 0 THEN 20 ELSE max(w) OVER (PARTITION BY file) END AS cell_w, max(h) OVER (PARTITION BY file) AS cell_h FROM b""")
def q_boxes(spark, sf_dir: str) -> DataFrame:
    box = lambda k, j: f"(p_size + {k}), {j}, (p_size % 7 + {k} + 1), (p_size % 5 + {j} + 1)"
    rect = lambda k, j: (f"format_string('[%d,%d,%d,%d]', {box(k, j)})" if j else f"format_string('{{\"x\":%d,\"y\":%d,\"w\":%d,\"h\":%d}}', {box(k, j)})")
    rows = f"""concat('"rows":[{{"state":"walk","fps":9,"loop":false,"rects":[', {rect(0, 0)}, ',', {rect(0, 1)}, ']}},{{"rects":[', {rect(1, 0)}, ',', {rect(1, 1)}, ']}}]}}')"""
    files = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("file"), F.expr(f"""concat('{{', if(p_partkey % 2 = 0, '"cell":{{"width":20}},', ''), {rows})""").alias("json"))
    return authored_boxes(files)


#: view/facing
SIGNATURES = [tuple(x.split("/")) for x in "back/center front/center side/right three-quarter-back/right three-quarter-front/right".split()]


def template_errors(templates: DataFrame, pending_allowed: bool = False) -> DataFrame:
    """Row 190: what is wrong with each motion template.

    ``templates``: template_id, status, prompt, pinned, sha (of the file, null if there is none), width, height, approved_sha
    (null without a sidecar), checks (array of the approvals that are given), needed (array), tokens (array that a prompt holds).
    """
    c = F.col
    pending = F.lit(pending_allowed) & yes(c("status") == "needs-imagegen")
    has = ~pending & c("sha").isNotNull()
    rules = [(c("prompt").isNull(), "prompt"), (yes(F.exists("tokens", lambda t: ~c("prompt").contains(t))), "token"), (pending & c("pinned").isNotNull(), "pending-pin"), (pending & c("sha").isNotNull(), "pending-asset"), (pending & c("approved_sha").isNotNull(), "pending-approval"), (~pending & ~yes(c("status") == "approved"), "status"), (~pending & c("sha").isNull(), "asset"),
             (has & ~yes(c("pinned") == c("sha")), "sha"), (has & (yes(c("width") < 1024) | yes(c("height") < 512) | yes(c("width") % 4 != 0) | yes(c("height") % 2 != 0)), "size"), (has & c("approved_sha").isNull(), "no-approval"), (has & yes(c("approved_sha") != c("sha")), "stale-approval"), (has & c("approved_sha").isNotNull() & (F.size(F.array_except("needed", F.coalesce("checks", F.array().cast("array<string>")))) > 0), "checks")]
    return templates.select("template_id", pending.alias("pending"), F.array_compact(F.array(*[F.when(bad, name) for bad, name in rules])).alias("errors"))


def missing_signatures(templates: DataFrame) -> DataFrame:
    """Row 190: required (view, facing) pairs that no template has."""
    spark = templates.sparkSession
    return spark.createDataFrame(SIGNATURES, "view string, facing string").join(templates.select("view", "facing").distinct(), ["view", "facing"], "left_anti")


@query("int_template_audit", """WITH t AS (SELECT p_partkey AS template_id, CASE p_size % 4 WHEN 0 THEN 'needs-imagegen' WHEN 1 THEN 'draft' ELSE 'approved' END AS status, CASE WHEN p_size % 9 <> 0 THEN p_name END AS prompt, CASE WHEN p_partkey % 3 <> 0 THEN p_brand END AS pinned,
  CASE WHEN p_partkey % 5 <> 0 THEN CASE WHEN p_partkey % 7 = 0 THEN 'x' ELSE p_brand END END AS sha, 1000 + p_size AS width, 500 + p_size AS height, CASE WHEN p_partkey % 4 <> 0 THEN p_brand END AS approved FROM part), k AS (SELECT *, status = 'needs-imagegen' AS pend FROM t)
SELECT template_id, pend AS pending, concat_ws(',', CASE WHEN prompt IS NULL THEN 'prompt' END, CASE WHEN NOT contains(prompt, 'e') THEN 'token' END, CASE WHEN pend AND pinned IS NOT NULL THEN 'pending-pin' END, CASE WHEN pend AND sha IS NOT NULL THEN 'pending-asset' END, CASE WHEN pend AND approved IS NOT NULL THEN 'pending-approval' END,
  CASE WHEN status = 'draft' THEN 'status' END, CASE WHEN NOT pend AND sha IS NULL THEN 'asset' END, CASE WHEN NOT pend AND sha IS NOT NULL AND (pinned IS NULL OR pinned <> sha) THEN 'sha' END, CASE WHEN NOT pend AND sha IS NOT NULL AND (width < 1024 OR height < 512 OR width % 4 <> 0 OR height % 2 <> 0) THEN 'size' END,
  CASE WHEN NOT pend AND sha IS NOT NULL AND approved IS NULL THEN 'no-approval' END, CASE WHEN NOT pend AND approved <> sha THEN 'stale-approval' END, CASE WHEN NOT pend AND sha IS NOT NULL AND approved IS NOT NULL AND template_id % 2 = 0 THEN 'checks' END) AS errors FROM k""")
def q_templates(spark, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS template_id", "CASE p_size % 4 WHEN 0 THEN 'needs-imagegen' WHEN 1 THEN 'draft' ELSE 'approved' END AS status", "CASE WHEN p_size % 9 <> 0 THEN p_name END AS prompt", "CASE WHEN p_partkey % 3 <> 0 THEN p_brand END AS pinned",
        "CASE WHEN p_partkey % 5 <> 0 THEN CASE WHEN p_partkey % 7 = 0 THEN 'x' ELSE p_brand END END AS sha", "1000 + p_size AS width", "500 + p_size AS height", "CASE WHEN p_partkey % 4 <> 0 THEN p_brand END AS approved_sha", "array('poses', 'seam') AS needed", "if(p_partkey % 2 = 0, array('poses'), array('seam', 'poses')) AS checks", "array('e') AS tokens",
    )
    return template_errors(t, pending_allowed=True).withColumn("errors", F.array_join("errors", ","))


def routing_errors(cases: DataFrame, candidates: list[str], scopes: list[str]) -> DataFrame:
    """Row 217: what is wrong with each routing case (id, prompt, rationale, scope, selected, excluded)."""
    c, names = F.col, F.array(*map(F.lit, candidates))
    twice = F.count(F.lit(1)).over(Window.partitionBy("id")) > 1
    others = F.array_sort(F.array_except(names, F.when(c("selected").isNull(), F.array().cast("array<string>")).otherwise(F.array("selected"))))
    rules = [(~yes(c("id").rlike("^[a-z0-9]+(-[a-z0-9]+)*$")), "id"), (twice, "duplicate"), (~yes(F.length(F.trim("prompt")) >= 40), "prompt"), (~yes(F.length(F.trim("rationale")) >= 30), "rationale"), (~yes(c("scope").isin(scopes)), "scope"), (c("selected").isNotNull() & ~yes(c("selected").isin(candidates)), "selected"), (~yes(F.array_sort("excluded") == others), "excluded")]
    return cases.select("id", F.array_compact(F.array(*[F.when(bad, name) for bad, name in rules])).alias("errors"))


def migrated(contracts: DataFrame, kind: str) -> DataFrame:
    """Row 264: each document's canonical form under a schema, and whether it differs from what is written.

    Text that is no object gives a null form and ``changed`` null, which is a load error.
    """
    d = contracts.withColumn("d", F.from_json("json", kind))
    return d.select("id", F.to_json("d").alias("canonical"), F.when(F.get_json_object("json", "$").isNotNull(), F.to_json("d") != F.get_json_object("json", "$")).alias("changed"))


def art_direction_tokens(rows: DataFrame) -> DataFrame:
    """Row 240: the animation workflows that an art direction (JSON, column json) records for a state, without ``auto``.

    Rows are an object by state, or a list of objects with a state, of which the first one counts.
    """
    one = "struct<state:string,animation_workflows:array<string>>"
    named = F.from_json(F.get_json_object("json", "$.rows"), f"map<string,{one}>")[F.col("state")]["animation_workflows"]
    listed = F.get(F.filter(F.from_json(F.get_json_object("json", "$.rows"), f"array<{one}>"), lambda r: r["state"] == F.col("state")), F.lit(0))["animation_workflows"]
    found = F.when(F.get_json_object("json", "$.rows").startswith("["), listed).otherwise(named)
    return rows.select("id", "state", F.filter(F.coalesce(found, F.array().cast("array<string>")), lambda w: w != "auto").alias("workflows"))


@query("plan_art_tokens", """SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN 'walk' ELSE 'idle' END AS state, CASE WHEN p_size % 2 = 0 THEN 'w-' || p_size ELSE '' END AS workflows FROM part""")
def q_art_tokens(spark, sf_dir: str) -> DataFrame:
    """Row 240; odd parts ask for a state that only has ``auto``."""
    body = F.expr("""concat(if(p_partkey % 3 = 0, '{"rows":[{"state":"walk","animation_workflows":["auto","w-', '{"rows":{"walk":{"animation_workflows":["w-'), p_size, if(p_partkey % 3 = 0, '"]},{"state":"idle","animation_workflows":["auto"]}]}', '","auto"]},"idle":{"animation_workflows":["auto"]}}}'))""")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.expr("CASE WHEN p_size % 2 = 0 THEN 'walk' ELSE 'idle' END").alias("state"), body.alias("json"))
    return art_direction_tokens(rows).withColumn("workflows", F.array_join("workflows", ","))
