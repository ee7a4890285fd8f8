"""Every operator on nulls in any column, empty and very long texts, ties, repeated rows, no rows, and extra columns with clashing names."""

from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from driftlog.llm import exact_dedup, html_text, imatch, mixture, pii, secrets, sentencepiece_codec, simhash, token_files, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PAGES = "page_id long, url string, html string"
#: Names that operators use inside.
CLASHES = ["row", "h", "fp", "key", "size", "score", "term", "found", "signs", "bucket", "block", "name", "ids", "part", "spans", "path", "host", "digest", "rank", "kind", "toxic", "held_out", "l_id", "root", "n", "start", "positions"]
LONG = "Lorem ipsum dolor a@b.co 10.0.0.1 password = hunter22 " * 3000
TEXTS = [None, "", " \n\t", "one", "one two", "ONE  two", "é😀 x y", LONG, LONG, LONG + "z", "vilest " * 4, "vilest you", "x" * 40_000]
ROWS = [(i, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else f"s{i % 2}", None if i % 5 == 0 else 1) for i, t in enumerate(TEXTS)]
ROWS += [ROWS[4], ROWS[4], ROWS[7], (None, "one two", None, None, None), (None, None, None, None, None), (-5, "one", "en", "s1", 3)]
HTML = "<body><nav>m</nav><article><p>One &amp; two</p><p>three</p></article></body>"
WEB = [(i, u, t) for i, (u, t) in enumerate([(None, None), ("", ""), ("http://a.example/", HTML), ("http://a.example/", HTML), ("not a url", "<p>" + "long words " * 20_000), ("http://[bad", "<<<>>> & &#x; </p>"), (None, HTML)])]
WEB += [WEB[2], (None, None, None), (None, "http://a.example/", HTML)]

OPERATORS = {
    "toxicity": lambda d: toxicity.toxicity(d, d.sparkSession.createDataFrame([(None, 1), (1, None), (3, 0), (3, 0), (10, 1), (11, 1), (99, 1)], "doc_id long, toxic int")),
    "pii": lambda d: pii.pii_spans(d),
    "mixture": lambda d: mixture.mix(d),
    "imatch": lambda d: imatch.edited_fingerprints(d),
    "html_text": lambda d: html_text.main_text(d),
    "sentencepiece": lambda d: sentencepiece_codec.encode_and_decode(d, public_tokenizers.path("piece_bpe_32k.model")).select("doc_id", F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids"), "decoded"),
    "secrets": lambda d: secrets.find_secrets(d),
    "simhash": lambda d: simhash.simhash_components(d),
    "exact_dedup": lambda d: exact_dedup.exact_dedup(d),
    "token_files": lambda d: token_files.token_files(d, public_tokenizers.path("word_bpe_49k.json")),
}
#: Operators whose results for equal rows are equal as well; in the others equal rows share a quota, a file or a group.
PER_ROW = ("toxicity", "pii", "imatch", "html_text", "sentencepiece", "secrets", "simhash")


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_and_clashing_columns(spark, name):
    run, rows, schema = OPERATORS[name], *((WEB, PAGES) if name == "html_text" else (ROWS, DOCS))
    id_col = schema.split()[0]
    docs = spark.createDataFrame(rows, schema)
    wide = docs.select("*", *(F.lit(f"extra {c}").alias(c) for c in CLASHES))
    plain, clash = run(docs).collect(), run(wide).collect()
    assert Counter(map(repr, plain)) == Counter(map(repr, clash)), "extra columns change nothing, and reruns agree"
    assert Counter(r[id_col] for r in plain) == Counter(r[0] for r in rows)
    if name in PER_ROW:
        results = Counter(map(repr, plain))
        for row, n in Counter(rows).items():
            mates = [r for r in rows if r[0] == row[0]]
            if row[0] is not None and len(set(mates)) == 1:
                own = {x for x in map(repr, (r for r in plain if r[id_col] == row[0]))}
                assert len(own) == 1 and results[own.pop()] == n
    empty = run(spark.createDataFrame([], schema))
    assert empty.columns == run(docs).columns and empty.count() == 0
    nulls = run(spark.createDataFrame([tuple([None] * len(rows[0]))] * 3, schema)).collect()
    assert len(nulls) == 3 and all(r[id_col] is None for r in nulls)


def test_stages_keep_columns(spark):
    docs = spark.createDataFrame(ROWS, DOCS).select("*", *(F.lit(f"extra {c}").alias(c) for c in CLASHES))
    labels = spark.createDataFrame([(3, 0), (10, 1), (11, 1)], "doc_id long, toxic int")
    for stage in (lambda d: toxicity.drop_toxic(d, labels), exact_dedup.drop_copies, simhash.drop_near_copies, mixture.apply_mix):
        out = stage(docs)
        assert out.columns == docs.columns and all(r.fp == "extra fp" for r in out.collect())
        assert stage(docs.limit(0)).count() == 0
