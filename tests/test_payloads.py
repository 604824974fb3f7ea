"""Payloads against a walk in Python; rule files on disk."""

import json
import random

from pyspark.sql import functions as F

from lumenmill.operators import payloads, policies
from lumenmill.sources import fixtures, rules

SF = "/root/testdata/sf0.001"


def some_json(rng, depth=0):
    kind = rng.randrange(7 if depth < 4 else 5)
    words = ["anna", "a@b.org", "C:\\dir\\f.png", "/home/x", "/a/b.tar.gz", 'say "hi" \\', "token=abc rest", "tab\there", "日本 é", "", "x/", "\\\\srv\\.hidden"]
    if kind < 3:
        return " ".join(rng.sample(words, rng.randrange(3)))
    if kind < 5:
        return rng.choice([None, True, 1.5, -3, 10**12])
    if kind == 5:
        return [some_json(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {rng.choice(["token", "/p/q", 'k"ey', "n", "anna"]) + str(i): some_json(rng, depth + 1) for i in range(rng.randrange(4))}


def walked(value, clean):
    if isinstance(value, dict):
        return {k: walked(v, clean) for k, v in value.items()}
    if isinstance(value, list):
        return [walked(v, clean) for v in value]
    return clean[value] if isinstance(value, str) else value


def strings(value):
    if isinstance(value, dict):
        return set().union(*map(strings, value.values()), set())
    if isinstance(value, list):
        return set().union(*map(strings, value), set())
    return {value} if isinstance(value, str) else set()


def test_redaction_at_any_depth(spark):
    rng = random.Random(11)
    bodies = [some_json(rng) for _ in range(400)]
    texts = sorted(set().union(*map(strings, bodies)))
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", payloads.redact_value(F.col("t"), ("anna",)).alias("r"))
    clean = {r.t: r.r for r in df.collect()}
    assert clean["C:\\dir\\f.png"] == "<redacted_path>/f.png" and clean["/home/x"] == "<redacted_path>" and clean["anna"] == "<redacted_user>" and clean["tab\there"] == "tab\there"
    dumped = [json.dumps(b, ensure_ascii=i % 2 == 0, indent=2 if i % 3 == 0 else None) for i, b in enumerate(bodies)]
    got = spark.createDataFrame(list(enumerate(dumped)), "i int, j string").select("i", payloads.redact_json(F.col("j"), ("anna",)).alias("r")).collect()
    for r in got:
        want = walked(bodies[r.i], clean)
        assert json.loads(r.r) == want and (not isinstance(want, dict) or list(json.loads(r.r)) == list(want))


def test_redaction_of_long_and_broken_texts(spark):
    long = json.dumps({"a": 'x"\\' * 50_000, "b": ["/p/q.txt"] * 2000})
    rows = spark.createDataFrame([(long,), ('{"a": "/x/y.png"',), (None,), ("",)], "j string").select(payloads.redact_json(F.col("j"))).collect()
    assert json.loads(rows[0][0]) == {"a": 'x"\\' * 50_000, "b": ["<redacted_path>/q.txt"] * 2000}
    assert [r[0] for r in rows[1:]] == ['<redacted_path>/y.png"', None, ""]


def test_layers_merge_by_presence(spark):
    rng = random.Random(4)
    some = lambda: rng.choice([None, "[1]", "no json", "{}"]) if rng.random() < 0.3 else json.dumps({k: rng.choice([None, 1, "x", [1], {"y": None}, True]) for k in rng.sample("abcd", rng.randrange(5))})
    data = [(i, *[some() for _ in range(4)]) for i in range(200)]
    df = spark.createDataFrame(data, "id int, l0 string, l1 string, l2 string, l3 string")
    members = payloads.merged(df, "id", ["l0", "l1", "l2", "l3"])
    got = {r.id: json.loads(r.payload) for r in payloads.rebuilt(members, "id").collect()}
    want = {}
    for i, *layers in data:
        for layer in layers:
            if layer and layer.startswith("{"):
                want.setdefault(i, {}).update(json.loads(layer))
    assert got == {i: w for i, w in want.items() if w}


def test_scores_of_members(spark):
    cases = {"null": 0.0, "true": 1.0, "false": 0.0, '""': 0.0, '" 7.5 "': 7.5, "12": 12.0, '"high"': None, "[1]": None, '"Infinity"': None}
    df = spark.createDataFrame([(k,) for k in [*cases, None]], "v string").select("v", payloads.read_score(F.col("v")).alias("s"))
    assert {r.v: r.s for r in df.collect()} == cases | {None: None}


def test_rule_files_give_a_strategy(spark, tmp_path):
    for folder, name, text in (("rules", "b.yaml", "pipeline:\n  steps:\n    - clean\n"), ("rules", "a.md", "# Title #\ntext\n## Part\n"), ("material_rules", "m.YML", "metal:\n  risk: 爆高光\n"), ("rules", "no.txt", "diffusion"), ("other", "x.yaml", "diffusion: 1")):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_text(text, encoding="utf-8")
    docs = rules.read_rules(spark, str(tmp_path))
    assert [(r.category, r.file_type, r.path.rsplit("/", 1)[1]) for r in docs.orderBy("place", "path").collect()] == [("rules", "md", "a.md"), ("rules", "yaml", "b.yaml"), ("material_rules", "yaml", "m.YML")]
    assert docs.where("file_type = 'md'").select(rules.headings(F.col("text"))).first()[0] == ["Title", "Part"]
    values = {(r.rule_path, r.value, r.kind) for r in rules.rule_values(docs.where("file_type = 'yaml'")).collect()}
    assert values == {("pipeline.steps.0", "clean", "string"), ("metal.risk", "爆高光", "string")}
    policy = policies.visual_policy(fixtures.features(spark, SF).limit(500)).cache()
    strengths = lambda by: {tuple(r) for r in policies.strategy(policy, by).select("l_orderkey", "l_linenumber", "light_compression_strength", "high_frequency_control_strength").collect()}
    assert strengths(docs) == strengths("爆高光") != strengths("")
    assert strengths(rules.read_rules(spark, str(tmp_path / "nothing"))) == strengths("")
