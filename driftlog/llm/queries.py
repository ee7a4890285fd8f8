"""The queries of the training-data operators: thin, each runs its operator over the whole intended table."""

from __future__ import annotations

from pyspark.sql import functions as F

from .common import table
from .exact_dedup import exact_dedup
from .imatch import edited_fingerprints
from .html_text import main_text
from .mixture import mix
from .pii import KINDS, pii_spans
from .secrets import find_secrets
from .sentencepiece_codec import encode_and_decode
from .simhash import simhash_components
from .token_files import token_files
from .toxicity import toxicity

QUERIES = {}
ORACLES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op8_simhash(spark, sf_dir):
    return simhash_components(table(spark, sf_dir, "documents"))


@query
def op9_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLES["op9_exact_dedup"] = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents),
     h AS (SELECT doc_id, n, sha256(t) AS text_sha256, t FROM t),
     w AS (SELECT doc_id, first_value(doc_id) OVER (PARTITION BY t ORDER BY n DESC, doc_id) AS keep_id,
                  count(*) OVER (PARTITION BY t) AS group_size, text_sha256 FROM h)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM w"""


@query
def op6_sentencepiece(spark, sf_dir):
    import public_tokenizers

    rows = encode_and_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op10_token_files(spark, sf_dir):
    import public_tokenizers

    return token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op3_mixture(spark, sf_dir):
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.round(F.try_element_at("positions", F.lit(1)), 6).alias("position"))


ORACLES["op3_mixture"] = r"""
WITH d AS (SELECT doc_id, source, md5(CAST(doc_id AS VARCHAR)) AS h,
                  CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
 s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
 r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM s),
 w AS (SELECT *, CAST(rank % 3 + 1 AS DOUBLE) AS weight FROM r),
 p AS (SELECT *, row_number() OVER (ORDER BY source_size / weight, rank) AS pos,
       (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER f, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER f, 0)) AS level
       FROM w WINDOW f AS (ORDER BY source_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 l AS (SELECT level FROM p WHERE level * weight <= 3 * source_size * (1 + 1e-12) ORDER BY pos LIMIT 1),
 t AS (SELECT source, source_size, rank % 3 AS kind, least(source_size * 3.0::DOUBLE, (SELECT level FROM l) * weight) AS target FROM p),
 c AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.kind, CAST(round(t.target) AS BIGINT) AS q,
       CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS c
       FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
 x AS (SELECT *, CASE WHEN source_size > 0 THEN q // source_size ELSE 0 END AS passes FROM c),
 y AS (SELECT *, greatest(least(q - passes * source_size - c, size), 0) AS extra, c / q AS u FROM x)
SELECT doc_id, size, source_size, target, CAST(passes * size + extra AS BIGINT) AS taken,
       round(CASE WHEN size = 0 OR passes * size + extra = 0 THEN NULL WHEN kind = 1 THEN u
             WHEN kind = 0 THEN 2 * u / (1.5 + sqrt(1.5 * 1.5 - 2 * u)) ELSE 2 * u / (0.5 + sqrt(0.25 + 2 * u)) END, 6) AS position
FROM y"""


@query
def op5_main_text(spark, sf_dir):
    rows = main_text(table(spark, sf_dir, "pages"))
    return rows.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "path")


def _joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


@query
def op7_secrets(spark, sf_dir):
    rows = find_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["base"])
    return rows.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


@query
def op4_imatch(spark, sf_dir):
    return edited_fingerprints(table(spark, sf_dir, "documents"))


@query
def op2_sanitise(spark, sf_dir):
    rows = pii_spans(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select("doc_id", *map(count, KINDS), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


@query
def op1_toxicity(spark, sf_dir):
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
