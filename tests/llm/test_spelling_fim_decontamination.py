"""Operators 11, 12 and 13 against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenmill.llm import decontamination, fim, queries, spelling
from tests.llm.conftest import SF

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows(df):
    return [r.asDict() for r in df.collect()]


def counted(docs, every=31, least=7):
    found = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", (text or "").translate(LOWER)):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += len(run) >= least
    return {w: n for w, n in found.items() if n >= 2}


def edits(words):
    """Near words by what deleting one letter leaves: of both for a replacement, of one for an insertion."""
    holes, near = {}, {w: set() for w in words}
    for w in words:
        for i in range(len(w)):
            holes.setdefault((i, w[:i] + w[i + 1 :]), set()).add(w)
            short = w[:i] + w[i + 1 :]
            if short in near:
                near[w].add(short)
                near[short].add(w)
    for group in holes.values():
        for w in group:
            near[w] |= group - {w}
    return near


def grouped(words, ratio=10):
    near, form = edits(words), {}
    for w, around in near.items():
        best = min(around, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), words.get(form[w])))
    return out


def test_bands_of_a_mask(spark):
    df = spark.createDataFrame([("aabbc",), ("ÿzz",), ("",)], "w string")
    got = df.select(*[spelling.band_mask(F.col("w"), b) for b in range(3)], *[spelling.band_letters(F.col("w"), b) for b in range(3)]).collect()
    assert [tuple(r) for r in got] == [(0, 0, 1, "aa", "bb", "c"), (0, 0, 1 << 29, "", "zz", "ÿ"), (0, 0, 0, "", "", "")]


@pytest.mark.parametrize("letters", ["abc", "adg", "aéÿbz"])
def test_every_pair_one_edit_apart_once(spark, letters):
    rng = random.Random(len(letters))
    words = sorted({"".join(rng.choice(letters) for _ in range(rng.randrange(1, 7))) for _ in range(300)})
    df = spark.createDataFrame([(w, len(w), 1) for w in words], "word string, length int, n long")
    got = [(r.a, r.b) for r in spelling.near_pairs(df).collect()]
    want = {(min(w, x), max(w, x)) for w, around in edits(words).items() for x in around}
    assert len(got) == len(want) and {(min(p), max(p)) for p in got} == want


def test_variants_of_the_tables(spark, docs):
    want = grouped(counted([(r.doc_id, r.text) for r in docs.collect()]))
    got = [tuple(r) for r in queries.queries()["op11_spelling"](spark, SF).collect()]
    assert len(got) == len(want) and set(got) == want
    assert any(r[1] is not None for r in got)


def test_variants_follow_forms_to_the_end(spark):
    text = " ".join(["statements"] * 500 + ["statement"] * 45 + ["statemen"] * 4 + ["statemant"] * 4 + ["Straßen-Übergang"] * 2 + ["×÷×÷×÷×"] * 2 + ["x" * 3_000] * 2 + ["x" * 3_001] * 2)
    df = spark.createDataFrame([(1, text, 0), (None, None, 0), (2, "", 0), (2, "", 0)], "doc_id long, text string, n int")
    got = {tuple(r) for r in spelling.spelling_variants(df).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    assert got == grouped(counted([(1, text)], every=0))
    assert ("statemen", "statement", "statements", 4, 1, 45) in got


def test_variants_on_odd_rows(spark, odd, none):
    want = grouped(counted([(r.doc_id, r.text) for r in odd.collect()]))
    clash = odd.withColumns({"__id": F.lit(1), "__row": F.lit(2), "word": F.lit("z"), "length": F.lit(1), "key": F.lit(0), "h": F.lit(0)})
    assert {tuple(r) for r in spelling.spelling_variants(clash, every=31).select("word", "form", "root", "n", "n_near", "form_n").collect()} == want
    assert spelling.spelling_variants(none).collect() == []


UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def transformed(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 80:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def kinds(text):
    return fim._CLASS[np.frombuffer(text.encode(), np.uint8)]


def test_chunk_functions_compose():
    """Any cut of a text into chunks gives the function of the whole, whichever way it is bracketed."""
    rng = random.Random(5)
    for _ in range(300):
        text = "".join(rng.choice("<<PM> \n>aé") for _ in range(rng.randrange(14)))
        want = []
        for state in range(fim.STATES):
            ends = marks = 0
            for kind in kinds(text).tolist():
                state, e, m = fim.step(state, kind)
                ends, marks = ends + e, marks + m
            want.append((state, ends, marks))
        assert list(zip(*fim.chunk_function(kinds(text)), strict=True)) == want
        raw = kinds(text)
        i, j = sorted(rng.randrange(len(raw) + 1) for _ in range(2))
        f, g, h = (fim.chunk_function(raw[p:q]) for p, q in ((0, i), (i, j), (j, len(raw))))
        assert fim.composed(fim.composed(f, g), h) == fim.composed(f, fim.composed(g, h)) == fim.chunk_function(raw)
        assert want[0][1] + bool(text) == len(UNIT.findall(text))


@pytest.mark.parametrize("chunk", [1, 3, 64])
def test_fim_in_chunks_of_any_size(spark, chunk):
    rng = random.Random(chunk)
    texts = ["".join(rng.choice(["<", "P", "S>", "<M>" if i % 4 == 0 else "m", " ", "\n", "ab", "é", "日本", "😀", " "]) for _ in range(rng.randrange(40))) for i in range(120)]
    texts += [None, "", " ", "<", "<S", "<S>", "a <P", "P> b", " x", "x ", "y" * 200, " " * 200]
    data = [(i // 2, t, i) for i, t in enumerate(texts)] + [(None, "no id <S", 0), (None, "none at all", 1), (7, "again  and again", 2), (7, "again  and again", 2)]
    df = spark.createDataFrame(data, "doc_id long, text string, h long").withColumns({"row": F.lit(1), "n": F.lit(2), "body": F.lit("b"), "__row": F.lit(3), "__id": F.lit(4)})
    got = fim.fim_documents(df, chunk=chunk).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got) == Counter((i, *transformed(i, t)) for i, t, _ in data)
    assert Counter((r.doc_id, r.back) for r in got) == Counter((i, t or "") for i, t, _ in data)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_fim_of_odd_rows_and_of_none(spark, odd, none):
    got = fim.fim_documents(odd).collect()
    assert Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got) == Counter((r.doc_id, *transformed(r.doc_id, r.text)) for r in odd.collect())
    assert fim.fim_documents(none).collect() == []


def same_as_sql(df, sql, con):
    want = con.execute(sql)
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    found = Counter(tuple(r[c] for c in columns) for r in df.collect())
    assert found == Counter(want.fetchall())
    return found


def test_fim_query_against_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert same_as_sql(queries.queries()["op12_fim"](spark, SF), queries.oracle_sql()["op12_fim"], con)


def contaminated(docs, items, width=10):
    words = lambda text: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - width + 1)) if w else ():
            windows.setdefault(tuple(w[i : i + width]), set()).add("" if item is None else str(item))
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                owners = windows.get(tuple(w[i : i + size]))
                if owners:
                    hit |= set(range(i, i + size))
                    found |= owners
        out.append((doc, len(w), len(hit), tuple(sorted(found)), bool(hit)))
    return Counter(out)


def flat(df):
    return Counter((r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids), r.contaminated) for r in df.collect())


@pytest.mark.parametrize("width", [3, 5, 10])
def test_windows_of_a_few_words(spark, width):
    """Few different words, so that windows overlap, repeat within an item, stand at both ends, and share all but one shingle."""
    rng = random.Random(width)
    word = lambda: rng.choice(["a", "B", "cé", "日本", "Ça"])
    sep = lambda: rng.choice([" ", ", ", "\0", "--", "\n", "_"])
    text = lambda n: "".join(word() + sep() for _ in range(rng.randrange(n)))
    items = [(i // 2, text(16)) for i in range(24)] + [(None, text(16)), (None, None), (77, ""), (78, " . "), (5, "a b"), (6, "É")]
    docs = [(i, text(60)) for i in range(60)] + [(3, items[0][1]), (3, items[0][1]), (None, items[2][1]), (None, None), (9, ""), (10, f"x {items[4][1]} x"), (11, "é É a_B"), (12, "a b")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("row", "words", "at", "shingle", "n", "__row", "__id")})
    b = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit(1) for c in ("words", "id", "items", "doc_id")})
    assert flat(decontamination.benchmark_hits(d, b, width=width)) == contaminated(docs, items, width)


def test_planted_passages_are_found_and_clean_text_left_alone(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(14)]
    clean = [word() for _ in range(3000)]
    docs = [(1, " ".join(clean)), (2, " ".join(clean[:50] + passage + clean[50:])), (3, " ".join(passage[:9] + clean)), (4, ", ".join(passage[4:]).upper())]
    items = [("b", " ".join(passage)), ("a", " ".join(passage[2:12])), ("z", " ".join(word() for _ in range(30)))]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    got = {r.doc_id: (r.n_hit, r.item_ids) for r in decontamination.benchmark_hits(d, b).collect()}
    assert got == {1: (0, []), 2: (14, ["a", "b"]), 3: (0, []), 4: (10, ["b"])}


def test_decontamination_of_odd_rows_and_of_none(spark, odd, none):
    docs, items = [(r.doc_id, r.text) for r in odd.collect()], [(1, "ONE two three"), (2, "x y x y x y x y x y x y"), (3, None)]
    b = spark.createDataFrame(items, "item_id long, text string")
    assert flat(decontamination.benchmark_hits(odd, b)) == contaminated(docs, items)
    assert decontamination.benchmark_hits(none, b).collect() == []
    assert flat(decontamination.benchmark_hits(odd, b.where("false"))) == contaminated(docs, [])


def test_decontamination_query_against_its_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    found = same_as_sql(queries.queries()["op13_decontamination"](spark, SF), queries.oracle_sql()["op13_decontamination"], con)
    assert any(True in row for row in found)
