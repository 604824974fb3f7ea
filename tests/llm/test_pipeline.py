"""The pipeline's stages, each against brute force on what the one before kept."""

import gc
import pickle
import weakref
from collections import Counter, defaultdict

import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F

from lumenmill.llm import common, exact_dedup, langid, packing
from tests.llm.conftest import SF
from tests.llm.test_copies_mixing_secrets_packing import check_packing
from tests.llm.test_search_language_join_lm_quality_lines import sets_of


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(150).cache()
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "exact_dedup", "near_dedup", "mixing", "packing"] and corpus_pipeline.ORACLE_SQL is None
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept[name] = stage(spark, docs, SF).cache()
        assert kept[name].columns == docs.columns
        docs = kept[name]
    ids = {n: [r.doc_id for r in df.collect()] for n, df in kept.items()}
    start = spark.read.parquet(f"{SF}/documents.parquet").limit(150).collect()
    assert set(ids["language"]) == {r.doc_id for r in start if any(c.isalpha() for c in r.text or "")}
    first = {}
    for r in sorted(kept["language"].collect(), key=lambda r: r.doc_id):
        first.setdefault(r.text, r.doc_id)
    assert sorted(ids["exact_dedup"]) == sorted(first.values())
    data = sorted(kept["exact_dedup"].collect(), key=lambda r: r.doc_id)
    sets = sets_of([r.text for r in data], 5)
    near = defaultdict(set)
    for i in range(len(data)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                near[i].add(j)
                near[j].add(i)
    gone, seen = set(), set()
    for i in range(len(data)):
        if i not in seen:
            stack = [i]
            while stack:
                x = stack.pop()
                if x not in seen:
                    seen.add(x)
                    gone |= {data[x].doc_id} if x != i else set()
                    stack += near[x]
    assert sorted(ids["near_dedup"]) == [r.doc_id for r in data if r.doc_id not in gone]
    copies = Counter(ids["mixing"])
    assert set(copies) <= set(ids["near_dedup"]) and max(copies.values()) <= 2
    check_packing(docs)


def test_rows_that_share_an_id_are_told_apart(spark):
    made = lambda k: " ".join(f"{k}{i}" for i in range(60))
    near = made("n") + " end"
    data = [(1, made("a")), (1, made("a")), (2, made("b")), (3, made("c")), (3, made("b")), (None, made("a")), (None, made("d")), (None, made("d")), (None, made("n")), (3, near)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in data], "doc_id long, text string, lang string, source string, n_chars long")
    exact = corpus_pipeline.exact(spark, docs, SF)
    want = [(1, made("a")), (2, made("b")), (3, made("c")), (3, near), (None, made("d")), (None, made("n"))]
    assert Counter((r.doc_id, r.text) for r in exact.collect()) == Counter(want)
    left = corpus_pipeline.near(spark, exact, SF)
    assert Counter((r.doc_id, r.text) for r in left.collect()) == Counter(want[:-1])


def test_rows_without_an_id_draw_apart(spark):
    docs = spark.createDataFrame([(None, f"w{i}", "en", "ab"[i % 2], 1) for i in range(400)], "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter(r.source for r in corpus_pipeline.mixed(spark, docs, SF).collect())
    assert got["a"] == 400 and 150 < got["b"] < 250


def test_without_any_language_only_text_without_letters_goes(spark):
    docs = spark.createDataFrame([(1, "some words", None, "a", 10), (2, "12 !", None, "a", 4), (3, None, None, "a", 0), (4, "été", None, None, 3), (5, "", None, "a", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted((r.doc_id, r.lang) for r in corpus_pipeline.language(spark, docs, SF).collect()) == [(1, None), (4, None)]


def test_results_of_stages_are_readable_side_by_side(spark):
    """Lazy results of several stages, over a table in files, are read after all stages have begun, in another order."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    results = {name: stage(spark, docs, SF) for name, stage in corpus_pipeline.STAGES}
    counts = {name: results[name].count() for name in reversed(results)}
    assert counts == {name: df.count() for name, df in results.items()}
    assert counts["language"] >= counts["exact_dedup"] > 0 and counts["exact_dedup"] >= counts["near_dedup"] > 0 and counts["packing"] > 0


def test_run_removes_what_its_stages_left(spark):
    standing = set(common._made)
    out = corpus_pipeline.run(spark, SF)
    left = common._made - standing
    assert out.count() > 0
    read = {f.rpartition("/")[0].rpartition("/")[2] for f in out.inputFiles()}
    assert read & {p.rpartition("/")[2] for p in left} and len(left) < 6


def test_run_on_odd_rows(spark, odd, none):
    for df in (odd, none):
        for _, stage in corpus_pipeline.STAGES:
            df = stage(spark, df, SF)
        df.count()


def test_rows_of_tables_are_numbered_without_a_copy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    folder = common.written(docs.repartition(5))
    clash = common.written(docs.withColumn("_metadata", F.lit(1)))
    for table in (docs, folder, clash, common.written(docs.limit(0))):
        made = len(common._made)
        numbered = common.with_rows(table)
        assert common.is_table(table)
        assert len(common._made) == made
        assert numbered.columns == [*table.columns, "__row"]
        assert numbered.select("__row").distinct().count() == table.count() == numbered.count()
    first, again = (Counter((r.doc_id, r["__row"]) for r in common.with_rows(folder).select(*c).collect()) for c in (("doc_id", "__row"), ("text", "doc_id", "__row")))
    assert first == again
    for other in (docs.limit(20), docs.where("doc_id > 3"), docs.union(docs), docs.select("doc_id"), docs.crossJoin(spark.range(2)), spark.range(4), docs.sort("doc_id").cache()):
        assert not common.is_table(other)
        assert common.with_rows(other).select("__row").distinct().count() == other.count()


def test_stages_on_tables_as_read(spark):
    """Places in files decide as written numbers do: repeated rows, rows without an id, several files."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    docs = docs.union(docs.limit(20)).union(docs.limit(9).withColumn("doc_id", F.lit(None).cast("long")))
    table = common.written(docs.repartition(3))
    for stage in (corpus_pipeline.exact, corpus_pipeline.near):
        of_table = Counter((r.doc_id, r.text) for r in stage(spark, table, SF).collect())
        assert of_table == Counter((r.doc_id, r.text) for r in stage(spark, table.where("true"), SF).collect())
    assert corpus_pipeline.mixed(spark, table, SF).count() > 0


def test_a_worker_holds_the_tables_of_one_stage():
    """Workers live on: what packing remembered goes when language ID starts, and the automata go when tries are grown."""
    path = public_tokenizers.path("word_bpe_49k.json")
    packing.token_bytes(["one two"], path)
    words = weakref.ref(packing._words(path))
    assert packing._words(path) is words()
    blob = pickle.dumps([("en", ["the house"], 0.5), ("de", ["das haus"], 0.5)])
    model = weakref.ref(langid._model(blob))
    gc.collect()
    assert words() is None and langid._model(blob) is model()
    assert list(exact_dedup._grown(iter([]), True, 1, False)) == []
    gc.collect()
    assert model() is None


def test_language_reads_and_hands_over_few_documents_at_once(spark):
    corpus_pipeline.language(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
    assert int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) <= 1024
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 500
