"""Operators 1, 3, 4, 5, 6 and 7 against brute force or held-out labels."""

import inspect
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenmill.llm import gru, langid, line_dedup, lm, ngram_join, quality, shingles, topk
from tests.llm.conftest import SF


def rows(df):
    return [r.asDict() for r in df.collect()]


# 4: top-k


def best(vectors, k, every):
    out = set()
    known = {(i, tuple(v)) for i, v in vectors if i is not None}
    for q, v in known:
        if q % every == 0:
            found = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in known if i != q and len(w) == len(v))[:k]
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(found)}
    return out


@pytest.mark.parametrize("low,high,dims", [(-3, 3, 5), (0, 2, 3), (-(10**9), 10**9, 4), (0, 0, 2)])
def test_top_k(spark, low, high, dims):
    rng = random.Random(low + dims)
    vectors = [(i, [rng.randint(low, high) for _ in range(dims)]) for i in range(300)] + [(None, [1] * dims), (7, [1, 2]), (14, [])]
    df = spark.createDataFrame(vectors, "vec_id long, v array<long>")
    got = topk.top_k(df, df.where("vec_id % 7 = 0"), k=5, block=64, query_block=16)
    # Several vectors of one id are several queries, whose finds are ranked together.
    single = lambda found: {x for x in found if x[0] not in (7, 14)}
    found = {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows(got)}
    assert single(found) == single(best(vectors, 5, 7))
    several = defaultdict(set)
    for q, _, i, s in best(vectors, 10**6, 7):
        several[q].add((-s, i))
    for q in (7, 14):
        assert [x[3] for x in sorted(found) if x[0] == q] == [-s for s, _ in sorted(several[q])[:5]]


def test_bound_stops_the_search():
    """With a few dimensions that matter only a part of the rows is scored, and a floor from elsewhere leaves a block untouched."""
    rng = np.random.default_rng(5)
    values = np.floor(256 * rng.normal(size=(4000, 16)) * 0.4 ** np.arange(16))
    order, ordered = topk.sorted_lists(values)
    ids, scored = np.arange(4000), []
    for q in range(0, 4000, 400):
        found, n = topk.threshold_search(ids, values, order, ordered, q, values[q], 5)
        scores = values @ values[q]
        scores[q] = -np.inf
        assert found == [(scores[i], i) for i in np.lexsort((ids, -scores))[:5]]
        scored.append(n)
        assert topk.threshold_search(ids, values, order, ordered, q, values[q], 5, floor=10**9) == ([], 0)
        kth = found[-1][0]
        assert topk.threshold_search(ids, values, order, ordered, q, values[q], 5, floor=int(kth))[0] == found
    assert sum(scored) < 0.5 * 4000 * len(scored)


def test_quantized_leaves_out_what_is_not_finite(spark):
    inf, nan = float("inf"), float("nan")
    df = spark.createDataFrame([(1, [0.5, -0.001]), (2, [nan, 1.0]), (3, [inf, 1.0]), (4, None), (5, [None, 1.0])], "vec_id long, embedding array<float>")
    assert rows(topk.quantized(df)) == [{"vec_id": 1, "v": [128, -1]}]
    nothing = topk.quantized(df.where("false"))
    assert rows(topk.top_k(nothing, nothing)) == []


# 7: language


def test_automaton_and_phrases():
    rng = random.Random(1)
    text = [rng.randrange(3) for _ in range(60)]
    trans = langid.suffix_automaton(text)
    for n in range(1, 6):
        for word in itertools.product(range(3), repeat=n):
            state = 0
            for c in word:
                state = trans[state].get(c) if state is not None else None
            assert (state is not None) == any(tuple(text[i : i + n]) == word for i in range(len(text)))
    model = langid.Model([("a", ["hello world hello"], 0.5), ("b", ["wonderful days"], 0.5)])
    for lang, sample in enumerate(["hello world hello", "wonderful days"]):
        for asked in ["hello", "wonder  world", "zzz", "he!!!llo days", "Ünknown HELLO " * 60]:
            clean = re.sub(r"[^a-zß-ÿ]+", " ", asked.lower())
            want = 0
            for at in range(0, len(clean), langid.WINDOW):
                part, i = clean[at : at + langid.WINDOW], 0
                while i < len(part):
                    n = 1
                    while i + n < len(part) and part[i : i + n + 1] in sample:
                        n += 1
                    i, want = i + n, want + 1
            assert model.phrases([asked, "x"])[0][0, lang] == want, (asked, lang)


def test_language_on_held_out(docs, odd, none):
    got = {r["doc_id"]: r for r in rows(langid.identify(docs, langid.remainder("doc_id") == 0))}
    held = [r for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert {i for i, r in got.items() if r["held_out"]} == {r.doc_id for r in held}
    assert sum(got[r.doc_id]["lang_pred"] == r.lang for r in held) >= 0.9 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    for out in (langid.identify(odd), langid.identify(odd.drop("lang").withColumn("lang", F.lit(None).cast("string")))):
        by = {r["doc_id"]: r["lang_pred"] for r in rows(out)}
        assert by[1] == by[2] == by[3] == "und" and out.count() == odd.count()
    assert rows(langid.identify(none)) == []
    assert langid.identified(odd).columns == [*odd.columns, "__lang", "__score"]


def test_samples_are_bounded_and_cover_every_language(spark):
    """Many rows without an id, equal rows, and more languages than the characters in all would give enough."""
    data = [(None, f"text number {i % 500} of language {i % 7} " * 4, f"l{i % 7}") for i in range(3000)] + [(i, "x" * 50, f"rare{i}") for i in range(40)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    got = langid.labelled_samples(docs, F.lit(True), 32_768, "doc_id", "text", "lang", total_chars=47 * 100, least_chars=600)
    assert [x[0] for x in got[:7]] == sorted((f"l{i}" for i in range(7)), key=lambda x: (-sum(r[2] == x for r in data), x))
    assert {x[0] for x in got[7:]} == {f"rare{i}" for i in range(40)}
    assert all(0 < sum(map(len, texts)) <= 600 for _, texts, _ in got) and abs(sum(x[2] for x in got) - 1) < 1e-9


def test_more_than_64_languages_are_told_apart(spark):
    rng = random.Random(9)
    alphabets = [rng.sample("abcdefghijklmnopqrstuvwxyz", 9) for _ in range(90)]
    text = lambda i: " ".join("".join(rng.choice(alphabets[i]) for _ in range(5)) for _ in range(60))
    data = [(n * 90 + i, text(i), f"l{i:02d}") for n in range(3) for i in range(90)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    got = langid.identify(docs, F.col("doc_id") >= 180).where("held_out").collect()
    assert len({r.lang_pred for r in got}) > 80 and sum(r.lang_pred == f"l{r.doc_id % 90:02d}" for r in got) > 80


def test_evidence_shrinks_as_by_hand(spark):
    """Host and path posteriors from the evidence, recomputed in Python."""
    rng = random.Random(1)
    words = ["plain", "words", "that", "say", "something", "###", "$$$", "DAY", "12345"]
    data = [(i, " ".join(rng.choice(words[: 5 + (i % 3) * 2]) for _ in range(rng.randrange(3, 30))), f"h{i % 5 if i % 9 else 'rare' + str(i)}", "ab"[i % 2]) for i in range(400)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(0, 400, 3)] + [(i, 0) for i in range(1, 400, 3)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in rows(quality.quality_posteriors(docs, labels, F.col("source"), F.col("lang")))}
    p = {i: r["evidence"] for i, r in got.items()}
    center = sum(p.values()) / len(p)

    def weight(groups, toward):
        some = {k: v for k, v in groups.items() if len(v) > 1}
        n = sum(map(len, some.values()))
        within = max(sum(sum((x - sum(v) / len(v)) ** 2 for x in v) for v in some.values()) / (n - len(some)), 1e-9)
        beyond = (sum(len(v) * (sum(v) / len(v) - toward(k)) ** 2 for k, v in some.items()) - len(some) * within) / n
        return min(10_000.0, max(1.0, within / beyond)) if beyond > 0 else 10_000.0

    hosts, paths = defaultdict(list), defaultdict(list)
    for i, _, h, q in data:
        hosts[h].append(p[i])
        paths[h, q].append(p[i])
    w = weight(hosts, lambda _: center)
    host = {h: (sum(v) + w * center) / (len(v) + w) for h, v in hosts.items()}
    w = weight(paths, lambda k: host[k[0]])
    path = {k: (sum(v) + w * host[k[0]]) / (len(v) + w) for k, v in paths.items()}
    logit = lambda x: math.log(x / (1 - x))
    for i, _, h, q in data:
        r = got[i]
        assert abs(r["host_posterior"] - host[h]) < 2e-3 and abs(r["path_posterior"] - path[h, q]) < 2e-3
        assert abs(logit(min(max(r["quality"], 1e-6), 1 - 1e-6)) - (logit(min(max(p[i], 1e-6), 1 - 1e-6)) + logit(path[h, q]) - logit(center))) < 0.1 or not 0.001 < r["quality"] < 0.999


# 5: n-gram join


def sets_of(texts, width):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    return out


def check_join(df, width, num, den):
    data = df.select("doc_id", "text").collect()
    ids, sets = [r.doc_id for r in data], sets_of([r.text for r in data], width)
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(ids)), 2):
        both = len(sets[i] & sets[j])
        if both and den * both >= num * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    least = defaultdict(lambda: 1 << 62)
    for i, d in enumerate(ids):
        least[find(i)] = min(least[find(i)], d)
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows(ngram_join.ngram_components(df, width, num, den)))
    assert got == Counter((d, len(sets[i]), least[find(i)]) for i, d in enumerate(ids))


def test_shingles_follow_words():
    texts = ["A b\tc d e", "a B c\x0bd\re", "", " ", "x", "a b c d e f", "é É b c", "x" * 5000 + " y z w"]
    got, want = shingles.shingle_sets(texts, 4), sets_of(texts, 4)
    assert [len(g) for g in got] == [len(w) for w in want]
    assert all((set(got[i].tolist()) == set(got[j].tolist())) == (want[i] == want[j]) for i, j in itertools.combinations(range(len(texts)), 2))


def test_join_on_documents(docs):
    check_join(docs, 4, 85, 100)


def test_join_with_a_group_of_near_copies(spark, monkeypatch):
    """Many copies of one text with words changed, near and beyond the threshold, and common passages; all n-grams of the group count as common."""
    monkeypatch.setattr(ngram_join, "LOCAL", 2)
    monkeypatch.setattr(ngram_join, "COMMON", 4)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(70)]
    passage = " ".join(f"p{i}" for i in range(30))
    texts = []
    for _ in range(120):
        words = list(base)
        for _ in range(rng.randrange(6)):
            words[rng.randrange(70)] = f"z{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    texts += [passage + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 40))) for _ in range(60)] + [passage] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for num in (60, 85, 95):
        check_join(df, 3, num, 100)


def test_join_of_repeated_rows_under_the_threshold(spark):
    text = lambda *spans: " ".join(f"w{i}" for a, b in spans for i in range(a, b))
    left, right, near = text((0, 5000)), text((0, 4000), (9000, 10000)), text((0, 4800), (7000, 7200))
    df = spark.createDataFrame([(1, left), (1, left), (2, right), (3, near), (2, right)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in rows(ngram_join.ngram_components(df, width=4, num=85, den=100))}
    assert got == {1: 1, 2: 2, 3: 1}


def test_join_of_odd_rows(odd, none):
    got = {r["doc_id"]: r for r in rows(ngram_join.ngram_components(odd, 4, 85, 100))}
    assert got[5]["component_id"] == 4 and got[None]["component_id"] == 6 and got[2] == {"doc_id": 2, "n_shingles": 0, "component_id": 2}
    assert rows(ngram_join.ngram_components(none)) == []


def test_components_of_long_chains(spark):
    n = 200
    order = list(range(n))
    random.Random(2).shuffle(order)
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(1000, 1001)], "a long, b long")
    assert {(r.doc, r.label) for r in ngram_join.components(edges).collect()} == {(i, 0) for i in range(n)} | {(1000, 1000), (1001, 1000)}


# 6: language model


def test_gradients_and_scores():
    rng = np.random.default_rng(0)
    p = gru.fresh(5, rng.random(gru.TOKENS))
    for k in p:
        p[k] = (p[k] + rng.normal(0, 0.3, p[k].shape)).astype(np.float64)
    texts = [rng.integers(0, gru.TOKENS, n) for n in (9, 4, 1, 9)]
    one_by_one = [float(gru.score(p, [t])[0]) for t in texts]
    assert np.allclose(gru.score(p, texts), one_by_one)
    assert abs(sum(math.exp(float(gru.score(p, [np.array([i])])[0])) for i in range(gru.TOKENS)) - 1) < 1e-5
    seen = {}
    trainer = gru.Trainer(p)
    p = trainer.p
    trainer._update = lambda grads: seen.update({k: g.copy() for k, g in grads.items()})
    trainer.train(texts)
    total = sum(len(t) for t in texts)
    for k in p:
        for at in [tuple(rng.integers(0, s) for s in p[k].shape) for _ in range(4)] + [np.unravel_index(np.abs(seen[k]).argmax(), p[k].shape)]:
            keep, both = p[k][at], []
            for e in (1e-4, -1e-4):
                p[k][at] = keep + e
                both.append(-gru.score(p, texts).sum() / total)
            p[k][at] = keep
            assert abs((both[0] - both[1]) / 2e-4 - seen[k][at]) < 2e-4, (k, at)


def test_texts_in_one_lane_do_not_see_each_other(monkeypatch):
    """Gradients and scores of texts that follow one another in a lane are those of texts side by side."""
    rng = np.random.default_rng(4)
    p = {k: (v + rng.normal(0, 0.3, v.shape)).astype(np.float64) for k, v in gru.fresh(5, rng.random(gru.TOKENS)).items()}
    texts = [rng.integers(0, gru.TOKENS, n) for n in (5, 3, 1, 6, 2)]
    found = []
    for lanes in (1, 2, 64):
        monkeypatch.setattr(gru, "LEAST_LANES", 1)
        monkeypatch.setattr(gru, "LANES", lanes)
        monkeypatch.setattr(gru, "_even", lambda texts, most, lanes=lanes: lanes)
        trainer, grads = gru.Trainer(p), {}
        trainer._update = lambda g, grads=grads: grads.update({k: v.copy() for k, v in g.items()})
        trainer.train(texts)
        found.append((grads, gru.score(p, texts)))
    for grads, scores in found[1:]:
        assert np.allclose(scores, found[0][1]) and all(np.allclose(grads[k], found[0][0][k]) for k in p)


def test_state_runs_through_windows():
    """A text of several windows scores as if its tokens were given one by one."""
    rng = np.random.default_rng(8)
    p = {k: (v + rng.normal(0, 0.3, v.shape)).astype(np.float64) for k, v in gru.fresh(5, np.ones(gru.TOKENS)).items()}
    text = rng.integers(0, gru.TOKENS, 3 * gru.WINDOW + 5)
    h, last, want = np.zeros((1, 5)), gru.TOKENS, 0.0
    for token in text:
        h = gru._forward(p, h, np.array([last]), np.array([False]), np.array([0, 1]))[0]
        want += float(gru._output(p, h, np.array([token]), None)[0][0])
        last = token
    assert abs(gru.score(p, [text])[0] - want) < 1e-9 and gru.score(p, [text[:40], text])[1] == pytest.approx(want)


def test_default_size_of_the_model():
    assert inspect.signature(lm.lm_scores).parameters["hidden"].default == 32


class InProcess:
    """Stands in for a frame: what mapInArrow is given runs here, on one batch."""

    def __init__(self, **columns):
        self.batch = pa.RecordBatch.from_pydict(columns)
        self.sparkSession = self.sparkContext = self

    def broadcast(self, value):
        self.value = value
        return self

    def select(self, *names):
        return self

    def mapInArrow(self, function, schema):
        return [r for b in function(iter([self.batch])) for r in b.to_pylist()]


ODD_WORDS = ["", "  Lead Ünï\x0b\x0c x", "tail \n", "\x1c\x1d a\x1cb A", " \t", "rare Rare rare a", "É é İ" * 3]


def test_words_are_those_between_ascii_white_space():
    words, sizes = lm.words_of(pa.array(ODD_WORDS))
    want = [t.encode().lower().split() for t in ODD_WORDS]
    assert words.to_pylist() == [w for t in want for w in t] and sizes.tolist() == [len(t) for t in want]
    assert [len(x) for x in lm.words_of(pa.array([], pa.string()))] == [0, 0]


def test_a_word_is_looked_up_once_in_a_batch(monkeypatch):
    asked, bucket = Counter(), lm.bucket
    monkeypatch.setattr(lm, "bucket", lambda w: asked.update([w]) or bucket(w))
    monkeypatch.setattr(lm, "WORDS", 1)
    listed, logs, mass = (b"a", b"x"), np.array([2.0, 1.0]), np.linspace(1, 2, gru.TOKENS)
    docs = InProcess(doc_id=[*range(len(ODD_WORDS))], held_out=[False] * len(ODD_WORDS), turn=[0] * len(ODD_WORDS), text=ODD_WORDS)
    got = lm.encode(docs, listed, logs, mass)
    for r, text in zip(got, ODD_WORDS, strict=True):
        words = text.encode().lower().split()
        ids = [1 if w == b"a" else bucket(w) for w in words]
        assert np.frombuffer(r["ids"], np.uint16).tolist() == [*ids, 0] and r["n_tokens"] == len(words) + 1
        assert r["n_known"] == sum(w in listed for w in words) and r["base"] == pytest.approx(sum(logs[listed.index(w)] for w in words if w in listed))
        assert r["model"] == pytest.approx(sum(w == b"x" for w in words) - sum(mass[i] for i in ids if i >= 512))
        assert {x["word"]: x["n"] for x in r["rare"]} == Counter(w for w in words if w not in listed)
    assert max(asked.values()) == 1 and b"rare" in asked
    (empty,) = lm.encode(InProcess(doc_id=[1], held_out=[False], turn=[0], text=[" "]), listed, logs, mass)
    assert isinstance(empty["base"], float) and isinstance(empty["model"], float) and (empty["n_tokens"], empty["rare"], empty["ids"]) == (1, [], b"\0\0")


def check_lm(df, listed=None):
    held = langid.remainder("doc_id") == 1
    got = rows(lm.lm_scores(df, held, hidden=8, rounds=2))
    data = df.select("doc_id", "text").collect()
    texts = [(r.doc_id, (r.text or "").encode().lower().split()) for r in data]
    is_held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    counts = Counter(w for i, t in texts if not is_held(i) for w in [*t, None])
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for i, t in texts:
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*t, None])
        want[i, is_held(i), len(t) + 1, sum(counts[w] > 0 for w in [*t, None]), n, round(base, 5)] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in got) == want
    assert all(r["score"] < 0 or r["n_tokens"] == 1 for r in got)
    return got


def test_lm_scores(docs, odd, none, monkeypatch):
    monkeypatch.setattr(lm, "LISTED", 1500)
    got = [r for r in check_lm(docs) if r["held_out"]]
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)
    check_lm(odd)
    monkeypatch.setattr(lm, "SIDE", 1)
    check_lm(odd)
    assert rows(lm.lm_scores(none, langid.remainder("doc_id") == 1)) == []
    only_held = rows(lm.lm_scores(docs.limit(3), F.lit(True)))
    assert all(abs(r["base_score"]) < 1e-9 and r["n_known"] == 0 and r["train_tokens"] == 0 for r in only_held)


# 3: lines


def cleaned(data, sites, chars):
    spread = defaultdict(set)
    for r in data:
        for line in (r.text or "").split("\n"):
            if line.strip(" "):
                spread[line].add(r.source)
    stays = lambda x: len(spread[x]) < (sites if len(x) >= chars else 2 * sites)
    return Counter((r.doc_id, None if r.text is None else "\n".join(x for x in r.text.split("\n") if stays(x))) for r in data)


@pytest.mark.parametrize("in_plan", [2000, 0])
def test_shared_lines(spark, docs, odd, none, monkeypatch, in_plan):
    monkeypatch.setattr(line_dedup, "IN_PLAN", in_plan)
    for df, sites, chars in ((docs, 3, 5), (odd, 2, 1)):
        out = line_dedup.remove_shared_lines(df, sites, chars)
        assert out.columns == [*df.columns, "__lines", "__removed"]
        assert Counter((r.doc_id, r.text) for r in out.collect()) == cleaned(df.collect(), sites, chars)
    assert rows(line_dedup.remove_shared_lines(none)) == []


def test_short_lines_of_many_sites_go_and_blank_ones_stay(spark):
    shared = ["menu", "a line of twenty characters or more", "", "  ", "few"]
    data = [(s, "\n".join([*shared[:4], *(["few"] if s < 9 else []), f"own {s}"]), f"site {s}") for s in range(12)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    left = {r.doc_id: r.text.split("\n") for r in line_dedup.remove_shared_lines(df, min_sites=5).collect()}
    assert left == {s: ["", "  ", *(["few"] if s < 9 else []), f"own {s}"] for s in range(12)}
    assert {r.text for r in line_dedup.remove_shared_lines(df, min_sites=5, short_sites=13).collect()} == {"\n".join(["menu", "", "  ", *(["few"] if s < 9 else []), f"own {s}"]) for s in range(12)}
    with pytest.raises(ValueError):
        line_dedup.remove_shared_lines(df.withColumn("__Lines", F.lit(1)))


def test_exact_counts_near_the_threshold(spark):
    df = spark.createDataFrame([(s, f"line {n}", f"site {s}") for n in range(95, 106) for s in range(n)], "doc_id long, text string, source string")
    spread = {r["line"]: r for r in rows(line_dedup.line_spread(df, 100, 1, lg_k=6))}
    exact = {r["x"]: r["n"] for r in rows(df.groupBy(F.xxhash64("text").alias("x")).agg(F.countDistinct("source").alias("n")))}
    assert all(r["sites"] in (None, exact[x]) for x, r in spread.items()) and any(r["sites"] for r in spread.values())


# 1: quality


def test_quality_on_labels_it_has_not_seen(spark, docs, odd, none):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    train, rest = labels.where("doc_id % 2 = 0"), {r.doc_id: r.quality for r in labels.where("doc_id % 2 = 1").collect()}
    got = {r["doc_id"]: r for r in rows(quality.quality_posteriors(docs, train, F.col("source"), F.col("lang")))}
    assert len(got) == docs.count()
    assert sum(got[i]["kept"] == bool(q) for i, q in rest.items()) >= 0.95 * len(rest)
    nobody = labels.where("false")
    for df, known in ((odd, labels), (odd, nobody), (none, labels)):
        out = rows(quality.quality_posteriors(df, known, F.col("source"), F.col("lang")))
        assert len(out) == df.count() and all(0 <= r["quality"] <= 1 for r in out)


def test_sparse_sites_shrink(spark):
    """A host of one bad document stays near the global mean; one of many bad documents does not."""
    bad, good = "### $$$ %%% &&& ***", "plain words that say something about the day"
    data = [(i, good, f"g{i % 10}", "en") for i in range(300)] + [(1000 + i, bad, "many", "en") for i in range(60)] + [(2000, bad, "one", "en")]
    df = spark.createDataFrame(data, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(0, 300, 2)] + [(1000 + i, 0) for i in range(0, 60, 2)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in rows(quality.quality_posteriors(df, labels, F.col("source"), F.col("lang")))}
    assert got[1001]["host_posterior"] < 0.3 < got[2000]["host_posterior"] and not got[1001]["kept"] and got[1]["kept"]
