"""Provenance, evidence and verdicts (survey rows 193 to 210, 254 to 263)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.registry import query
from .integrity import table

SEVERITY = [("pass", 0), ("skipped", 0), ("blocked", 1), ("fail", 2), ("operational-error", 3)]
EXIT = {"pass": 0, "skipped": 0, "blocked": 2, "fail": 1, "operational-error": 3}


def digests(rows: DataFrame, key: str, content: str) -> DataFrame:
    """Row 193: key, sha256 and size_bytes of each content."""
    return rows.select(key, F.sha2(content, 256).alias("sha256"), F.octet_length(content).cast("long").alias("size_bytes"))


@query("ev_digest", "SELECT doc_id, sha256(text) AS sha256, octet_length(encode(text))::BIGINT AS size_bytes FROM documents")
def q_digest(spark, sf_dir: str) -> DataFrame:
    """Row 193."""
    return digests(table(spark, sf_dir, "documents"), "doc_id", "text")


def exact_duplicates(rows: DataFrame, key: str, content: str) -> DataFrame:
    """Rows 119, 208: contents that occur more than once, by digest, with the first key."""
    d = digests(rows, key, content)
    return d.groupBy("sha256").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first_id")).where("n > 1")


@query("ev_exact_duplicates", "SELECT sha256(text) AS sha256, count(*)::BIGINT AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def q_exact(spark, sf_dir: str) -> DataFrame:
    """Rows 119, 208."""
    return exact_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text")


def pin_states(pins: DataFrame, now: DataFrame, key: str) -> DataFrame:
    """Rows 12, 168: pinned digests (key, pin) against current ones (key, now); missing and stale are two things."""
    joined = pins.join(now, key, "left")
    return joined.withColumns({"missing": F.col("now").isNull(), "stale": F.coalesce(F.col("pin") != F.col("now"), F.lit(False))})


@query("ev_stale_pins", """WITH p AS (SELECT doc_id AS item_id, sha256(text) AS pin FROM documents) SELECT p.item_id, pin, sha256(b.text) AS now, b.item_id IS NULL AS missing, coalesce(pin <> sha256(b.text), false) AS stale FROM p LEFT JOIN benchmark b USING (item_id)""")
def q_stale(spark, sf_dir: str) -> DataFrame:
    """Rows 12, 167, 168, 206, 207."""
    pins = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.sha2("text", 256).alias("pin"))
    now = table(spark, sf_dir, "benchmark").select("item_id", F.sha2("text", 256).alias("now"))
    return pin_states(pins, now, "item_id").select("item_id", "pin", "now", "missing", "stale")


def canonical_fingerprint(**fields: Column) -> Column:
    """Row 194: digest of JSON with sorted keys and no spaces."""
    return F.concat(F.lit("sha256:"), F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)])), 256))


@query("ev_canonical_fingerprint", """SELECT p_partkey, 'sha256:' || sha256('{"brand":"' || p_brand || '","key":' || p_partkey || ',"size":' || p_size || '}') AS fingerprint FROM part""")
def q_fingerprint(spark, sf_dir: str) -> DataFrame:
    """Row 194."""
    return table(spark, sf_dir, "part").select("p_partkey", canonical_fingerprint(size=F.col("p_size"), key=F.col("p_partkey"), brand=F.col("p_brand")).alias("fingerprint"))


def set_fingerprint(rows: DataFrame, key: str, *fields: str) -> DataFrame:
    """Row 195: one digest for each key's entries, the same for any order of arrival. A key's entries bound its group."""
    entries = F.transform(F.array_sort(F.collect_list(F.struct(*fields))), lambda s: F.concat_ws(":", *[s[f].cast("string") for f in fields]))
    return rows.groupBy(key).agg(F.sha2(F.array_join(entries, ";"), 256).alias("fingerprint"))


@query("ev_set_fingerprint", """SELECT o_custkey, sha256(string_agg(o_orderkey || ':' || o_orderstatus, ';' ORDER BY o_orderkey)) AS fingerprint FROM orders GROUP BY o_custkey""")
def q_set(spark, sf_dir: str) -> DataFrame:
    """Row 195."""
    return set_fingerprint(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", "o_orderstatus")


def merge_provenance(records: DataFrame, run: str, state: str, record: str, *order: str) -> DataFrame:
    """Row 198: the latest record of each state, and of each run its one type, or mixed."""
    latest = records.groupBy(run, state).agg(F.max_by(record, F.struct(*order)).alias(record))
    return latest.groupBy(run).agg(F.when(F.count_distinct(state) == 1, F.min(state)).otherwise("mixed").alias("root"), F.count(F.lit(1)).alias("states"), F.max(record).alias("last_event"))


@query("ev_provenance_merge", """WITH n AS (SELECT user_id, event_type, ts, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1) SELECT user_id, CASE WHEN count(DISTINCT event_type) = 1 THEN min(event_type) ELSE 'mixed' END AS root, count(*)::BIGINT AS states, max(event_id) AS last_event FROM n GROUP BY user_id""")
def q_merge(spark, sf_dir: str) -> DataFrame:
    """Row 198."""
    return merge_provenance(table(spark, sf_dir, "events"), "user_id", "event_type", "event_id", "ts", "event_id")


def report_status(exit_code: Column, ok: Column, errors: Column, complete: Column) -> Column:
    """Row 199: a report passes only if exit code, flag, errors and coverage all say so."""
    return (
        F.when((exit_code == 3) | exit_code.isNull(), "operational-error")
        .when(exit_code == 2, "blocked")
        .when((exit_code != 0) | ~F.coalesce(ok, F.lit(False)) | (errors > 0) | ~F.coalesce(complete, F.lit(False)), "fail")
        .otherwise("pass")
    )


REPORTS = """rp AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 7 THEN NULL ELSE (l_partkey % 4)::INT END AS code, l_returnflag <> 'R' AS ok, (l_quantity > 49)::INT AS errors, l_linestatus = 'F' AS complete FROM lineitem),
rs AS (SELECT *, CASE WHEN code = 3 OR code IS NULL THEN 'operational-error' WHEN code = 2 THEN 'blocked' WHEN code <> 0 OR NOT ok OR errors > 0 OR NOT complete THEN 'fail' ELSE 'pass' END AS status FROM rp)"""


def _reports(spark, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")
    code = F.when(F.col("l_linenumber") == 7, None).otherwise((F.col("l_partkey") % 4).cast("int"))
    return l.select("l_orderkey", "l_linenumber", report_status(code, F.col("l_returnflag") != "R", (F.col("l_quantity") > 49).cast("int"), F.col("l_linestatus") == "F").alias("status"))


@query("ev_report_status", f"WITH {REPORTS} SELECT l_orderkey, l_linenumber, status FROM rs")
def q_reports(spark, sf_dir: str) -> DataFrame:
    return _reports(spark, sf_dir)


def verdict_rollup(results: DataFrame, key: str, stages: list[str] | None = None) -> DataFrame:
    """Rows 202, 205: the worst status of each key by severity (which is not the exit code), gates and blockers.

    With ``stages``, only results of those (column stage) count.
    """
    pick = lambda values, c: F.element_at(F.create_map(*[F.lit(x) for p in values for x in p]), c)
    r = (results if stages is None else results.where(F.col("stage").isin(stages))).withColumn("_sev", pick(SEVERITY, F.col("status")))
    m = r.groupBy(key).agg(F.max_by("status", "_sev").alias("status"), F.count(F.lit(1)).alias("gates"), F.count_if(F.col("_sev") > 0).alias("blockers"))
    return m.select(key, "status", pick(EXIT.items(), F.col("status")).alias("exit_code"), "gates", "blockers")


@query("ev_verdict_rollup", f"""WITH {REPORTS}, v(status, sev, ex) AS (VALUES ('pass', 0, 0), ('blocked', 1, 2), ('fail', 2, 1), ('operational-error', 3, 3)), m AS (SELECT l_orderkey, max(sev) AS sev, count(*)::BIGINT AS gates, count(*) FILTER (sev > 0)::BIGINT AS blockers FROM rs JOIN v USING (status) GROUP BY l_orderkey)
SELECT l_orderkey, status, ex AS exit_code, gates, blockers FROM m JOIN v USING (sev)""")
def q_rollup(spark, sf_dir: str) -> DataFrame:
    """Rows 202, 205."""
    return verdict_rollup(_reports(spark, sf_dir), "l_orderkey")


#: status: applicable, complete, has errors
ALGEBRA = {"pass": (True, True, False), "skipped": (False, True, False), "blocked": (True, False, True), "fail": (True, True, True), "operational-error": (True, False, True)}


def result_invariant(status: Column, applicable: Column, complete: Column, errors: Column) -> Column:
    """Row 200: whether a result's flags are those of its status; an unknown status or flag is not."""
    out = F.lit(False)
    for name, (a, b, c) in ALGEBRA.items():
        out = out | F.coalesce((status == name) & (applicable == a) & (complete == b) & ((errors > 0) == c), F.lit(False))
    return out


@query("ev_result_invariant", """WITH r AS (SELECT l_orderkey, l_linenumber, CASE l_partkey % 6 WHEN 0 THEN 'pass' WHEN 1 THEN 'skipped' WHEN 2 THEN 'blocked' WHEN 3 THEN 'fail' WHEN 4 THEN 'operational-error' END AS status, l_returnflag <> 'N' AS a, l_linestatus = 'F' AS c, l_quantity > 25 AS e FROM lineitem),
t(status, ta, tc, te) AS (VALUES ('pass', true, true, false), ('skipped', false, true, false), ('blocked', true, false, true), ('fail', true, true, true), ('operational-error', true, false, true)) SELECT l_orderkey, l_linenumber, coalesce(a = ta AND c = tc AND e = te, false) AS consistent FROM r LEFT JOIN t ON t.status = r.status""")
def q_invariant(spark, sf_dir: str) -> DataFrame:
    """Row 200."""
    status = F.expr("CASE l_partkey % 6 WHEN 0 THEN 'pass' WHEN 1 THEN 'skipped' WHEN 2 THEN 'blocked' WHEN 3 THEN 'fail' WHEN 4 THEN 'operational-error' END")
    flags = F.col("l_returnflag") != "N", F.col("l_linestatus") == "F", (F.col("l_quantity") > 25).cast("int")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", result_invariant(status, *flags).alias("consistent"))


def validate_provenance(entries: DataFrame, files: DataFrame, expected: DataFrame, allow_imported: bool = False, allow_fixture: bool = False) -> DataFrame:
    """Row 196: run_id and what is wrong, each once, sorted; a run without issues has an empty list.

    ``entries``: run_id, path, sha, size, source_type, states (array); ``files``: run_id, path, sha, size as they are;
    ``expected``: run_id, state. Every state needs an entry, every entry's states are expected ones, every file is there
    with its size and digest, and imported or fixture sources need their flag.
    """
    now = files.select("run_id", "path", F.col("sha").alias("_sha"), F.col("size").alias("_size"))
    policy = ((F.col("source_type") == "imported") & F.lit(not allow_imported)) | ((F.col("source_type") == "fixture") & F.lit(not allow_fixture))
    found = F.array_compact(F.array(F.when(F.col("_sha").isNull(), "missing-file"), F.when(F.col("_size") != F.col("size"), "size"), F.when(F.col("_sha") != F.col("sha"), "hash"), F.when(policy, "policy")))
    own = entries.join(now, ["run_id", "path"], "left").select("run_id", F.explode(found).alias("issue"))
    covered = entries.select("run_id", F.explode("states").alias("state")).distinct()
    wanted = expected.select("run_id", "state").distinct()
    lacks = wanted.join(covered, ["run_id", "state"], "left_anti").select("run_id", F.lit("uncovered").alias("issue"))
    extra = covered.join(wanted, ["run_id", "state"], "left_anti").select("run_id", F.lit("unknown-state").alias("issue"))
    issues = own.union(lacks).union(extra).groupBy("run_id").agg(F.array_sort(F.collect_set("issue")).alias("issues"))
    runs = entries.select("run_id").union(expected.select("run_id")).distinct()
    return runs.join(issues, "run_id", "left").select("run_id", F.coalesce("issues", F.array().cast("array<string>")).alias("issues"))


@query("ev_validate_provenance", """WITH e AS (SELECT l_orderkey AS run_id, l_linenumber AS path, l_partkey AS sha, l_suppkey AS size, CASE l_partkey % 11 WHEN 0 THEN 'imported' WHEN 1 THEN 'fixture' ELSE 'imagegen' END AS kind, CASE l_returnflag WHEN 'A' THEN 'O' WHEN 'R' THEN 'F' ELSE 'X' END AS state FROM lineitem),
j AS (SELECT e.*, sha % 9 = 2 AS gone, sha % 7 = 3 AS resized, sha % 5 = 1 AS altered FROM e), x AS (SELECT o_orderkey AS run_id, o_orderstatus AS state FROM orders),
i AS (SELECT run_id, 'missing-file' AS issue FROM j WHERE gone UNION SELECT run_id, 'size' FROM j WHERE NOT gone AND resized UNION SELECT run_id, 'hash' FROM j WHERE NOT gone AND altered UNION SELECT run_id, 'policy' FROM j WHERE kind = 'imported'
  UNION SELECT x.run_id, 'uncovered' FROM x WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.run_id = x.run_id AND e.state = x.state) UNION SELECT e.run_id, 'unknown-state' FROM e WHERE NOT EXISTS (SELECT 1 FROM x WHERE e.run_id = x.run_id AND e.state = x.state)),
r AS (SELECT run_id FROM e UNION SELECT run_id FROM x) SELECT r.run_id, coalesce(string_agg(issue, ',' ORDER BY issue), '') AS issues FROM r LEFT JOIN i ON i.run_id = r.run_id GROUP BY r.run_id""")
def q_provenance(spark, sf_dir: str) -> DataFrame:
    """Row 196 on orders as runs; fixtures are allowed."""
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("path"), F.col("l_partkey").alias("sha"), F.col("l_suppkey").alias("size"), "l_returnflag")
    entries = l.withColumns({"source_type": F.expr("CASE sha % 11 WHEN 0 THEN 'imported' WHEN 1 THEN 'fixture' ELSE 'imagegen' END"), "states": F.expr("array(CASE l_returnflag WHEN 'A' THEN 'O' WHEN 'R' THEN 'F' ELSE 'X' END)")})
    # a path can stand in several entries of an order, so files are told apart by what pins them
    entries = entries.withColumn("path", F.concat_ws("/", F.col("path").cast("string"), F.col("sha").cast("string"), F.col("size").cast("string")))
    files = entries.where("sha % 9 <> 2").select("run_id", "path", F.expr("if(sha % 5 = 1, -1, sha)").alias("sha"), F.expr("if(sha % 7 = 3, -1, size)").alias("size")).distinct()
    expected = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderstatus").alias("state"))
    return validate_provenance(entries, files, expected, allow_fixture=True).withColumn("issues", F.array_join("issues", ","))


def playback_coverage(rows: DataFrame, key: str, frame: str) -> DataFrame:
    """Row 203: frames played are all frames of a range, each once."""
    g = rows.groupBy(key).agg(F.min(frame).alias("_low"), F.max(frame).alias("_high"), F.count_distinct(frame).alias("_d"), F.count(F.lit(1)).alias("n"))
    return g.select(key, "n", ((F.col("_high") - F.col("_low") + 1 == F.col("_d")) & (F.col("_d") == F.col("n"))).alias("covered"))


@query("ev_playback_coverage", """WITH g AS (SELECT conv_id, list_sort(list(DISTINCT turn)) AS t, count(*)::BIGINT AS n FROM conversations GROUP BY conv_id) SELECT conv_id, n, t = range(t[1], t[1] + len(t)) AND len(t) = n AS covered FROM g""")
def q_playback(spark, sf_dir: str) -> DataFrame:
    """Row 203."""
    return playback_coverage(table(spark, sf_dir, "conversations"), "conv_id", "turn")


@query("ev_review_rules", """WITH r AS (SELECT o_orderkey, o_orderdate, (o_orderkey % 5 + 1)::INT AS score, o_orderpriority AS answer, o_orderdate + INTERVAL 30 DAY AS waived_until FROM orders) SELECT o_orderkey, score, CASE WHEN score <= 2 AND NOT starts_with(answer, '1') THEN 'needs-failure' WHEN score >= 4 AND starts_with(answer, '5') THEN 'unexpected' ELSE 'ok' END AS verdict, waived_until > TIMESTAMP '1996-01-01' AS waived FROM r""")
def q_review(spark, sf_dir: str) -> DataFrame:
    """Row 204: score bands against answers, and waivers that have run out."""
    s, a = (F.col("o_orderkey") % 5 + 1).cast("int"), F.col("o_orderpriority")
    verdict = F.when((s <= 2) & ~a.startswith("1"), "needs-failure").when((s >= 4) & a.startswith("5"), "unexpected").otherwise("ok")
    return table(spark, sf_dir, "orders").select("o_orderkey", s.alias("score"), verdict.alias("verdict"), (F.expr("o_orderdate + INTERVAL 30 DAY") > F.expr("timestamp'1996-01-01'")).alias("waived"))


@query("ev_batch_audit", """SELECT p_brand, count(*)::BIGINT AS n, count(DISTINCT p_name)::BIGINT AS names, count(DISTINCT p_type)::BIGINT AS types, count(*) <> count(DISTINCT p_partkey) AS repeats, max(p_retailprice) - min(p_retailprice) AS drift FROM part GROUP BY p_brand""")
def q_audit(spark, sf_dir: str) -> DataFrame:
    """Row 208: exact counts, no estimates."""
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("p_name").alias("names"), F.count_distinct("p_type").alias("types"), (F.count(F.lit(1)) != F.count_distinct("p_partkey")).alias("repeats"), (F.max("p_retailprice") - F.min("p_retailprice")).alias("drift"))


def resolve_source(explicit: Column, canonical: Column, matches: Column) -> Column:
    """Rows 11, 209, 254, 255: an explicit source, then the canonical one, then a single match, else an error."""
    return F.when(F.coalesce(explicit, F.lit(False)), "explicit").when(F.coalesce(canonical, F.lit(False)), "canonical").when(matches == 1, "single").otherwise("error")


@query("ev_source_resolution", """SELECT c_custkey, coalesce(CASE WHEN c_acctbal > 5000 THEN 'explicit' END, CASE WHEN c_acctbal > 0 THEN 'canonical' END, CASE WHEN n = 1 THEN 'single' END, 'error') AS source FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) o ON o_custkey = c_custkey""")
def q_resolution(spark, sf_dir: str) -> DataFrame:
    """Rows 11, 209, 254, 255."""
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    b = F.col("c_acctbal")
    return table(spark, sf_dir, "customer").join(n, "c_custkey", "left").select("c_custkey", resolve_source(b > 5000, b > 0, F.col("n")).alias("source"))


def coverage_status(expected: Column, checked: Column, errors: Column) -> Column:
    """Rows 256, 258, 260: nothing checked is a failure, as are errors; partly checked is blocked."""
    return F.when((checked == 0) | (errors > 0), "fail").when(checked < expected, "blocked").otherwise("pass")


@query("ev_label_coverage", """SELECT source, count(*)::BIGINT AS expected, count(l.doc_id)::BIGINT AS checked, count(*) FILTER (quality = 0)::BIGINT AS errors, CASE WHEN count(l.doc_id) = 0 OR count(*) FILTER (quality = 0) > 0 THEN 'fail' WHEN count(l.doc_id) < count(*) THEN 'blocked' ELSE 'pass' END AS status FROM documents LEFT JOIN labels l USING (doc_id) GROUP BY source""")
def q_labels(spark, sf_dir: str) -> DataFrame:
    """Rows 256, 258, 260."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").withColumn("seen", F.lit(1)), "doc_id", "left")
    checked, errors, n = F.count("seen"), F.count_if(F.col("quality") == 0), F.count(F.lit(1))
    return d.groupBy("source").agg(n.alias("expected"), checked.alias("checked"), errors.alias("errors"), coverage_status(n, checked, errors).alias("status"))


@query("ev_vacuous_gate", """SELECT count(*)::BIGINT AS planned, coalesce(bool_and(p_size > 0), true) AS ok FROM part WHERE p_size > 1000""")
def q_vacuous(spark, sf_dir: str) -> DataFrame:
    """Row 263: an empty plan passes here, unlike elsewhere."""
    return table(spark, sf_dir, "part").where("p_size > 1000").agg(F.count(F.lit(1)).alias("planned"), F.coalesce(F.bool_and(F.col("p_size") > 0), F.lit(True)).alias("ok"))
