"""Queries on payloads and rule documents, and their SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenmill.operators import payloads, selection
from lumenmill.plans.oracle import PROBE
from lumenmill.plans.queries import _probed
from lumenmill.sources import fixtures as fx
from lumenmill.sources import rules

#: Four layers of a task's payload, the weakest first: some are missing, some say null, some are empty.
LAYERS = [
    """CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CONCAT('{"clarity_score":', CAST(o_orderkey % 90 AS VARCHAR(20)), ',"mode":"draft","notes":["a","b"]}') END AS debug_quality""",
    """CASE WHEN o_orderkey % 3 = 0 THEN '{"clarity_score":null,"edge_quality_score":"71"}' WHEN o_orderkey % 3 = 1 THEN CONCAT('{"edge_quality_score":', CAST(o_orderkey % 50 AS VARCHAR(20)), '}') ELSE '[1,2]' END AS task_result""",
    """CASE o_orderkey % 4 WHEN 0 THEN '{}' WHEN 1 THEN '{"mode":null}' ELSE '{"mode":"final","nested":{"a":1}}' END AS task_report""",
    """CONCAT('{"id":', CAST(o_orderkey AS VARCHAR(20)), ',"status":"', o_orderstatus, CASE WHEN o_orderkey % 7 = 0 THEN '","nested":null}' ELSE '"}' END) AS item""",
]
NAMES = ["debug_quality", "task_result", "task_report", "item"]


def _layers(spark: SparkSession, d: str) -> DataFrame:
    return fx.table(spark, d, "orders").selectExpr("o_orderkey", *LAYERS)


def payload_members(spark: SparkSession, d: str) -> DataFrame:
    return payloads.merged(_layers(spark, d), "o_orderkey", NAMES)


def payload_merged(spark: SparkSession, d: str) -> DataFrame:
    """The merged payload of every order, and two of its scores, where an explicit null is 0 and an absent one null."""
    members = payloads.merged(_layers(spark, d), "o_orderkey", NAMES)
    score = lambda name: F.max(F.when(F.col("name") == name, payloads.read_score(F.col("value")))).alias(name)
    scores = members.groupBy("o_orderkey").agg(score("clarity_score"), score("edge_quality_score"))
    return payloads.rebuilt(members, "o_orderkey").join(scores, "o_orderkey")


def payload_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Documents' first characters deep in a payload, beside a path and a sentence with a user's name."""
    rows = fx.table(spark, d, "documents").where("text IS NOT NULL").withColumn("plain", F.regexp_replace(F.substring("text", 1, 80), r'["\\\x00-\x1f]', " "))
    path = F.when(F.col("doc_id") % 2 == 0, r"C:\\in\\photo.png").otherwise("/srv/in/")
    body = F.concat(F.lit('{"id": '), F.col("doc_id").cast("string"), F.lit(', "api_key": {"note": ["'), F.col("plain"), F.lit('", 1.50, null], "path": "'), path, F.lit(r'"}, "user": "said \"anna\" and token=abc"}'))
    return rows.select("doc_id", payloads.redact_json(body, ("anna",)).alias("payload"))


#: An indented text of each part.
RULES = """CONCAT('# part', chr(10), 'name: ', p_name, chr(10), 'limits:', chr(10), '  width: ', CAST(p_partkey % 50 AS VARCHAR(20)), chr(10), '  ratio: "', CAST(p_partkey % 7 AS VARCHAR(20)), '.5"', chr(10), chr(10),
 CASE p_partkey % 3 WHEN 0 THEN CONCAT('  tags:', chr(10), '    - a', chr(10), '    - b7', chr(10)) WHEN 1 THEN CONCAT('  tags:', chr(10)) ELSE CONCAT('  deep:', chr(10), '    more:', chr(10), '      x: -1.5e3', chr(10), '  y: no', chr(10)) END,
 'flags:', chr(10), '  on: true  ', chr(10), '  # off', chr(10), 'rest: ~', chr(10))"""


#: Rule documents of a task.
TREES = 5_000


def rule_tree(spark: SparkSession, d: str) -> DataFrame:
    parts = fx.table(spark, d, "part")
    # The rows of a file are few bytes but a tree each: they are dealt out first.
    return rules.rule_values(parts.repartition(max(1, math.ceil(parts.count() / TREES)), "p_partkey").selectExpr("p_partkey", f"{RULES} AS text"))


def sample_selection(spark: SparkSession, d: str) -> DataFrame:
    """The samples of a run that events ask for by user, in their order; some are not there."""
    manifest = fx.runs(spark, d)[0].select("sample_id", "level", "format").where("sample_id % 3 <> 0")
    return selection.selected(manifest, fx.table(spark, d, "events").selectExpr("event_id AS ordinal", "user_id AS sample_id"))


def probe_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Probe rows whose original is there and whose candidate was written."""
    rows = _probed(spark, d)
    return selection.with_both_sides(rows, fx.probe_files(spark, d).where("doc_id % 9 <> 0"), rows.where("(doc_id + length(method)) % 5 <> 0")).select("doc_id", "file_name", "method", "saved_bytes")


def file_facts(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.lit("/in.dir/"), F.col("file_name"), F.when(F.col("doc_id") % 4 == 0, ".JPEG").when(F.col("doc_id") % 4 == 1, "/.hidden").otherwise(""))
    facts = fx.probe_files(spark, d).select("doc_id", selection.file_format(path).alias("format"), selection.dimensions(F.col("width"), F.col("height")).alias("d"), selection.tail(F.col("file_name"), 12).alias("tail"))
    return facts.select("doc_id", "format", "d.long_side", "d.short_side", "d.megapixels", "tail")


ALL = (sample_selection, probe_pairs, file_facts, payload_members, payload_merged, payload_redacted, rule_tree)

_MEMBERS = f"""ly AS (SELECT o_orderkey, {", ".join(LAYERS)} FROM orders), lz AS (SELECT o_orderkey, layer, body FROM ly, (VALUES (0), (1), (2), (3)) v(layer), LATERAL (SELECT CASE layer WHEN 0 THEN debug_quality WHEN 1 THEN task_result WHEN 2 THEN task_report ELSE item END AS body)),
  ob AS (SELECT * FROM lz WHERE json_valid(body) AND json_type(body) = 'OBJECT'), me AS (SELECT o_orderkey, layer, unnest(json_keys(body)) AS name, body FROM ob),
  la AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey, name ORDER BY layer DESC) AS turn FROM me), mm AS (SELECT o_orderkey, name, CAST(json_extract(body, '$.' || name) AS VARCHAR) AS value, layer FROM la WHERE turn = 1)"""
_SECRET = r"""(?i)(api[_-]?key|token|cookie|authorization|password|secret)["'']?\s*[:=]\s*["'']?[^"''\s,}]+"""
_SCORE = lambda name: f"""max(CASE WHEN name = '{name}' THEN CASE WHEN value = 'null' THEN CAST(0 AS DOUBLE) ELSE TRY_CAST(trim(value, '"') AS DOUBLE) END END) AS {name}"""

SQL = {
    "sample_selection": """WITH m AS (SELECT o_orderkey AS sample_id, o_orderstatus AS level, o_orderpriority AS format FROM orders WHERE o_orderkey % 3 <> 0)
        SELECT event_id AS ordinal, user_id AS sample_id, level, format, m.sample_id IS NOT NULL AS found FROM events LEFT JOIN m ON m.sample_id = user_id""",
    "probe_pairs": f"WITH {PROBE} SELECT doc_id, file_name, method, saved_bytes FROM pr WHERE file_name IN (SELECT file_name FROM pf WHERE doc_id % 9 <> 0) AND (file_name, method) IN (SELECT (file_name, method) FROM pr WHERE (doc_id + length(method)) % 5 <> 0)",
    "file_facts": "WITH pf AS (SELECT " + ", ".join(fx.PROBE_FILES) + """ FROM documents)
        SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'jpg' WHEN 1 THEN 'unknown' ELSE string_split(file_name, '.')[-1] END AS format, greatest(width, height) AS long_side, least(width, height) AS short_side, ROUND(width * height / CAST(1000000 AS DOUBLE), 3) AS megapixels, right(file_name, 12) AS tail FROM pf""",
    "payload_members": f"WITH {_MEMBERS} SELECT o_orderkey, name, value, CAST(layer AS INT) AS layer FROM mm",
    "payload_merged": f"""WITH {_MEMBERS} SELECT o_orderkey, '{{' || string_agg('"' || name || '":' || value, ',' ORDER BY name) || '}}' AS payload, {_SCORE("clarity_score")}, {_SCORE("edge_quality_score")} FROM mm GROUP BY o_orderkey""",
    "payload_redacted": rf"""WITH t AS (SELECT doc_id, regexp_replace(substr(text, 1, 80), '["\\\x00-\x1f]', ' ', 'g') AS plain FROM documents WHERE text IS NOT NULL),
        r AS (SELECT doc_id, regexp_replace(regexp_replace(plain, '{_SECRET}', '<redacted>', 'g'), '[\p{{L}}\p{{N}}_.+-]+@[\p{{L}}\p{{N}}_.-]+\.[A-Za-z]{{2,}}', '<redacted>', 'g') AS v FROM t),
        n AS (SELECT *, regexp_extract(regexp_replace(v, '/+$', ''), '[^/]*$') AS name FROM r),
        p AS (SELECT doc_id, CASE WHEN NOT contains(v, '/') THEN replace(v, 'anna', '<redacted_user>') WHEN regexp_full_match(name, '.+\.[^.]+') AND NOT regexp_full_match(name, '\.[^.]*') THEN '<redacted_path>/' || name ELSE '<redacted_path>' END AS v FROM n)
        SELECT doc_id, '{{"id": ' || doc_id || ', "api_key": {{"note": ["' || v || '", 1.50, null], "path": "' || CASE WHEN doc_id % 2 = 0 THEN '<redacted_path>/photo.png' ELSE '<redacted_path>' END || '"}}, "user": "said \"<redacted_user>\" and <redacted>"}}' AS payload FROM p""",
    "rule_tree": f"""WITH RECURSIVE tx AS (SELECT p_partkey, string_split({RULES}, chr(10)) AS lines FROM part), ln AS (SELECT p_partkey, unnest(range(len(lines))) AS n, unnest(lines) AS line FROM tx),
        cl AS (SELECT p_partkey, n, length(rtrim(line)) - length(trim(line)) AS indent, trim(line) AS bare FROM ln WHERE trim(line) <> '' AND NOT starts_with(trim(line), '#')),
        kv AS (SELECT *, starts_with(bare, '- ') AS item, CASE WHEN starts_with(bare, '- ') THEN NULL ELSE trim(string_split(bare, ':')[1]) END AS name, CASE WHEN starts_with(bare, '- ') THEN trim(bare[3:]) ELSE trim(bare[instr(bare, ':') + 1:]) END AS value FROM cl),
        pa AS (SELECT *, (SELECT max(b.n) FROM kv b WHERE b.p_partkey = a.p_partkey AND b.n < a.n AND b.indent < a.indent) AS parent FROM kv a),
        nm AS (SELECT *, CASE WHEN item THEN CAST(row_number() OVER (PARTITION BY p_partkey, parent, item ORDER BY n) - 1 AS VARCHAR) ELSE name END AS label FROM pa),
        tr AS (SELECT p_partkey, n, label AS path FROM nm WHERE parent IS NULL UNION ALL SELECT nm.p_partkey, nm.n, tr.path || '.' || label FROM tr JOIN nm ON nm.p_partkey = tr.p_partkey AND nm.parent = tr.n)
        SELECT p_partkey, CAST(n AS INT) AS n, path AS rule_path, CASE WHEN value = '' THEN '{{}}' WHEN value LIKE '"%"' THEN value[2:-2] ELSE value END AS value,
          CASE WHEN value = '' THEN 'map' WHEN value IN ('true', 'false') THEN 'bool' WHEN value = '~' THEN 'null' WHEN value LIKE '"%"' THEN 'string' WHEN TRY_CAST(value AS BIGINT) IS NOT NULL AND NOT contains(value, '.') THEN 'int' WHEN TRY_CAST(value AS DOUBLE) IS NOT NULL THEN 'float' ELSE 'string' END AS kind
        FROM tr JOIN nm USING (p_partkey, n) WHERE value <> '' OR NOT EXISTS (SELECT 1 FROM nm c WHERE c.p_partkey = nm.p_partkey AND c.parent = nm.n)""",
}
