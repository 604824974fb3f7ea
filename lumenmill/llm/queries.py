"""The queries of the corpus operators and the DuckDB SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenmill.llm.common import modest_batches, read


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenmill.llm.mixing import mixing_plan, word_count

    plan = mixing_plan(read(spark, sf_dir, "documents"), word_count("text"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "rate")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenmill.llm.quality import quality_posteriors

    # Addresses of pages are host/language/number, so a document's site is its source and its path begins with its language.
    return quality_posteriors(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), F.col("source"), F.col("lang"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenmill.llm.line_dedup import remove_shared_lines

    out = remove_shared_lines(read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("__lines").cast("long").alias("n_lines"), F.col("__removed").cast("long").alias("n_removed"), F.sha2("text", 256).alias("text_sha256"))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenmill.llm.topk import every_nth, quantized, top_k

    vectors = quantized(read(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where(every_nth("vec_id", 50)), k=5)


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenmill.llm.ngram_join import ngram_components

    modest_batches(spark)
    return ngram_components(read(spark, sf_dir, "documents"), width=4, num=85, den=100)


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenmill.llm.langid import remainder
    from lumenmill.llm.lm import lm_scores

    modest_batches(spark)
    return lm_scores(read(spark, sf_dir, "documents"), remainder("doc_id") == 1)


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenmill.llm.langid import identify, remainder

    modest_batches(spark)
    return identify(read(spark, sf_dir, "documents"), remainder("doc_id") == 0)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenmill.llm.packing import pack_documents

    modest_batches(spark)
    return pack_documents(read(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenmill.llm.secrets import scan_secrets

    modest_batches(spark)
    return scan_secrets(read(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.tiktoken"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenmill.llm.exact_dedup import trie_owners

    modest_batches(spark)
    found = trie_owners(read(spark, sf_dir, "documents"), keep="largest")
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenmill.llm.spelling import spelling_variants

    found = spelling_variants(read(spark, sf_dir, "documents"), least_length=7, least_n=2, ratio=10, every=31)
    return found.select("word", "form", "root", "n", "n_near", "form_n")


def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenmill.llm.fim import fim_documents, restored

    modest_batches(spark)
    made = fim_documents(read(spark, sf_dir, "documents"), seed=42, percent=50, spm_percent=80)
    digest = lambda text: F.sha2(text, 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenmill.llm.decontamination import benchmark_hits

    modest_batches(spark)
    found = benchmark_hits(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), width=10)
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality, op2_mixing, op3_line_dedup, op4_topk, op5_ngram_join, op6_lm_scores, op7_langid, op8_packing, op9_secrets, op10_exact_dedup, op11_spelling, op12_fim, op13_decontamination)}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_line_dedup": """
            WITH x AS (SELECT source, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
                 gone AS (SELECT list(line) AS lines FROM (
                     SELECT line FROM x WHERE trim(line, ' ') <> '' GROUP BY line HAVING count(DISTINCT coalesce('s' || source, '')) >= CASE WHEN length(line) < 20 THEN 16 ELSE 8 END)),
                 d AS (SELECT doc_id, text, coalesce(string_split(text, chr(10)), []) AS old,
                              list_filter(string_split(text, chr(10)), lambda y: NOT coalesce(list_contains(lines, y), false)) AS rest FROM documents, gone)
            SELECT doc_id, CAST(len(old) AS BIGINT) AS n_lines, CAST(len(old) - coalesce(len(rest), 0) AS BIGINT) AS n_removed,
                   CASE WHEN text IS NOT NULL THEN sha256(coalesce(array_to_string(rest, chr(10)), '')) END AS text_sha256 FROM d""",
        "op4_topk": """
            WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
                       WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
                 s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
                       FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
                 r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
            SELECT * FROM r WHERE rank <= 5""",
        "op10_exact_dedup": """
            SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
                   doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
            FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
        "op12_fim": r"""
            WITH h AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents),
                 u AS (SELECT *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
                              list_transform([0, 1, 2, 3], lambda i: CAST('0x' || s[8 * i + 1 : 8 * i + 8] AS BIGINT)) AS h FROM h),
                 k AS (SELECT *, len(units) AS n, least(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) AS a, greatest(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) AS b FROM u),
                 p AS (SELECT *, coalesce(array_to_string(units[1 : a], ''), '') AS prefix, coalesce(array_to_string(units[a + 1 : b], ''), '') AS middle, coalesce(array_to_string(units[b + 1 : n], ''), '') AS suffix,
                              CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 50 THEN 'plain' WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM k)
            SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
                   sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
                   sha256(text) AS restored_sha256 FROM p""",
        "op13_decontamination": r"""
            WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
                 b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
                 bw AS (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0),
                 win AS (SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i : i + 9], ' ') AS s FROM bw),
                 sizes AS (SELECT DISTINCT size FROM win),
                 dp AS (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size),
                 met AS (SELECT r, i, size, item_id FROM (SELECT r, i, size, array_to_string(w[i : i + size - 1], ' ') AS s FROM dp) JOIN win USING (size, s)),
                 hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT r, i, size FROM met)) GROUP BY r),
                 own AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM met) GROUP BY r)
            SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
                   coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN hit USING (r) LEFT JOIN own USING (r)""",
    }
