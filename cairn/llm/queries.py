"""The registered queries of the training-data operators, and their SQL where there is some."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import align, ann, bpe, exact_dedup, fill_middle, jaccard_join, license_scan, lm_score, merkle, packing, suffix_dedup, toxicity, warc

WORD_TOKENIZER, BYTE_RANKS = "word_bpe_49k.json", "byte_bpe_50k.tiktoken"
BYTE_TOKENIZER, PIECE_TOKENIZER = "byte_bpe_50k.json", "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary(WORD_TOKENIZER))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages")).drop("url")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), vocabulary(BYTE_RANKS), public_tokenizers.PATTERN)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scores.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents")))


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.cross_entropy_difference(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").filter("quality = 1"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(table(spark, sf_dir, "documents"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.alignment_counts(table(spark, sf_dir, "documents"), (vocabulary(BYTE_TOKENIZER), vocabulary(PIECE_TOKENIZER)))


def op13_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.fingerprints(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [op1_best_fit_packing, op2_warc, op3_byte_bpe, op4_exact_dedup, op5_toxicity, op6_suffix_dedup, op7_nearest_neighbours, op8_license_scan, op9_lm_score, op10_jaccard_join, op11_fill_in_middle, op12_token_alignment, op13_document_fingerprints, pipeline]
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {
        "op4_exact_dedup": r"""
            WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
            SELECT doc_id, min(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
                   doc_id = min(doc_id) OVER (PARTITION BY body) AS kept, sha256(body) AS text_sha256
            FROM d""",
        "op11_fill_in_middle": r"""
            WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || doc_id) AS h FROM documents),
            g AS (SELECT *, length(t) AS n, [CAST('0x' || substr(h, 8 * i + 1, 8) AS BIGINT) for i in [0, 1, 2, 3]] AS x FROM d),
            c AS (SELECT *, least(x[1] % (n + 1), x[2] % (n + 1)) AS i, greatest(x[1] % (n + 1), x[2] % (n + 1)) AS j,
                  CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR x[3] % 100 >= 90 THEN 'plain' WHEN x[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM g),
            p AS (SELECT *, substring(t, 1, i) AS a, substring(t, i + 1, j - i) AS b, substring(t, j + 1, n - j) AS e FROM c)
            SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN i END AS prefix_chars, CASE WHEN form <> 'plain' THEN j - i END AS middle_chars,
                   sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || e || '<M>' || b ELSE '<S>' || e || '<P>' || a || '<M>' || b END) AS output_sha256, sha256(t) AS restored_sha256
            FROM p""",
        "op13_document_fingerprints": rf"""
            WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
            e AS (SELECT *, length(t) AS n, coalesce(lead(t) OVER w, first_value(t) OVER w) AS nx FROM d WINDOW w AS (ORDER BY doc_id DESC)),
            x AS (SELECT *, left(t, n - n // 3) || left(nx, n // 3) AS ed FROM e),
            y AS (SELECT doc_id, 'own' AS kind, t AS s FROM x UNION ALL SELECT doc_id, 'edited', ed FROM x UNION ALL SELECT doc_id, 'next', nx FROM x),
            l AS (SELECT doc_id, kind, list_transform(string_split(s, chr(10)), lambda p: list_transform(regexp_extract_all(p, '{merkle.CLAUSE}'), lambda c: {{'sha': sha256(c), 'chars': length(c)}})) AS ls FROM y),
            p AS (SELECT doc_id, kind, list_transform(ls, lambda x: {{'sha': sha256(coalesce(array_to_string(list_transform(x, lambda y: y.sha), ''), '')), 'leaves': x}}) AS ps FROM l),
            b AS (SELECT *, list_filter(range(1, len(ps) + 1), lambda i: len(ps[i].leaves) = 0 OR ps[i].sha[1] IN ('0', '1') OR i = len(ps)) AS ends FROM p),
            s AS (SELECT *, list_transform(range(1, len(ends) + 1), lambda k: {{'n': ends[k] - CASE WHEN k > 1 THEN ends[k - 1] ELSE 0 END,
                  'sha': sha256(array_to_string(list_transform(ps[CASE WHEN k > 1 THEN ends[k - 1] ELSE 0 END + 1 : ends[k]], lambda z: z.sha), ''))}}) AS ss FROM b),
            f AS (SELECT doc_id, kind, sha256(array_to_string(list_transform(ss, lambda z: z.sha), '')) AS root,
                  array_to_string(list_transform(ss, lambda z: z.sha[1:16] || ':' || z.n), ' ') AS f1, array_to_string(list_transform(ps, lambda z: z.sha[1:16] || ':' || len(z.leaves) || ':' || coalesce(list_sum(list_transform(z.leaves, lambda c: c.chars)), 0)::BIGINT), ' ') AS f2,
                  list_transform(flatten(list_transform(ps, lambda z: z.leaves)), lambda c: c.sha[1:10] || ':' || c.chars) AS f3 FROM s),
            g AS (SELECT doc_id, kind, root, root || '/' || f1 || '/' || f2 || '/' || coalesce(array_to_string(f3, ' '), '') AS fp, list_distinct(f3) AS u FROM f),
            h AS (SELECT o.doc_id, o.fp AS fp0, e.fp AS fp1, len(o.u) AS nu,
                  o.root = e.root AS same1, o.root = m.root AS same2, o.u AS u0, e.u AS u1, m.u AS u2 FROM (SELECT * FROM g WHERE kind = 'own') o JOIN (SELECT * FROM g WHERE kind = 'edited') e USING (doc_id) JOIN (SELECT * FROM g WHERE kind = 'next') m USING (doc_id)),
            i AS (SELECT *, list_transform([u0, u1, u2, list_intersect(u0, u1), list_intersect(u0, u2)], lambda q: coalesce(list_sum(list_transform(q, lambda c: CAST(string_split(c, ':')[2] AS BIGINT))), 0)) AS w FROM h)
            SELECT i.doc_id, n AS n_chars, sha256(ed) AS edited_sha256, fp0 AS fingerprint, fp1 AS edited_fingerprint,
                   CASE WHEN same1 THEN 1 WHEN w[1] + w[2] = 0 THEN 0 ELSE 2.0::DOUBLE * w[4] / (w[1] + w[2]) END::DOUBLE AS near_edited, CASE WHEN same2 THEN 1 WHEN w[1] + w[3] = 0 THEN 0 ELSE 2.0::DOUBLE * w[5] / (w[1] + w[3]) END::DOUBLE AS near_next
            FROM i JOIN x USING (doc_id)""",
    }
