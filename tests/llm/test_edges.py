"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from flowloom.llm import bpe, bytecnn, mixing, neartext, nndescent, pii, qda, quality, simhash, toxicity, warc
from flowloom.llm.common import crc_part
from flowloom.llm.queries import tokenizer_path

LONG = "lorem ipsum dolor " * 20_000
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, row string, node string, hash string, size string, "
          "pattern string, `__salt` string, fp string, `text_key` string, `__key` string, `__doc` string, `__removed` string, `__row` string, "
          "`__keep` string, `__pass` string, `__times` string, doc string, key string, own string, keep string, times string, removed string, tile string")
EXTRA = ("x",) * 22


def row(i, text, lang="en", source="s"):
    return (i, text, lang, source, None if text is None else len(text), *EXTRA)


ROWS = [
    row(1, "a b c d"), row(1, "a b c d"), row(2, None), row(3, ""), row(None, "a b c d"), row(None, None, None, None), row(4, " \t\n "),
    row(5, LONG), row(6, "x" * 50_000), row(7, "A B C D", None, None), row(1, "other words here now", "de", "t"), row(8, "İ😀".encode("utf-16", "surrogatepass").decode("utf-16")),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 0, 1), (None, 1, 1), (6, None, None), (99, 1, 1), (1, 1, 0)], "doc_id long, quality int, toxic int")


def operators(labels):
    held = crc_part(3, 1)
    return {
        "quality": quality.verdicts, "clean": quality.clean, "bpe": lambda d: bpe.encode_digests(d, tokenizer_path()),
        "ids": lambda d: bpe.encode_documents(d, tokenizer_path()), "simhash": simhash.near_duplicates, "one": neartext.one_of_each,
        "pii": pii.find, "redact": pii.redact, "mix": mixing.mix, "mixed": mixing.mixed_documents,
        "toxicity": lambda d: toxicity.score(d, toxicity.fit(d, labels, "toxic"), held),
        "qda": lambda d: qda.quality_scores(d, labels, "quality", held),
        "language": lambda d: bytecnn.predict(d, bytecnn.fit(d), held)}


ALL = "quality clean bpe ids simhash one pii redact mix mixed toxicity qda language".split()


@pytest.mark.parametrize("name", ALL)
def test_odd_rows(docs, labels, name):
    got = operators(labels)[name](docs).collect()
    if name in ("clean", "one", "mixed"):
        assert {len(r) for r in got} <= {len(ROWS[0])}
    else:
        assert len(got) == len(ROWS)


@pytest.mark.parametrize("name", ALL)
def test_empty_table(none, labels, name):
    assert operators(labels)[name](none).collect() == []


@pytest.mark.parametrize("stage", [s[0] for s in corpus_pipeline.STAGES])
def test_stages(spark, docs, none, stage):
    run = dict(corpus_pipeline.STAGES)[stage]
    out = run(spark, docs, "")
    if stage != "encode":
        assert out.columns == docs.columns
    out.collect()
    assert run(spark, none, "").collect() == []


def test_equal_rows_get_equal_results(docs):
    for found in (quality.verdicts(docs), simhash.near_duplicates(docs)):
        twins = [tuple(r)[1:] for r in found.where("doc_id = 1").collect()]
        assert len(twins) == 3 and len(set(twins)) == 2


def test_a_repeated_row_counts_its_lines_once(spark):
    """A document of which half goes is not depleted, however often its row is there."""
    shared, own = "this line stands in all of them and goes everywhere it stands", "own words of text {} come here in one line with some more of them too"
    rows = [row(i, f"{shared}\n{own.format('n' * i)}\n{' '.join(own.format('m' * i).split()[::-1])}") for i in range(1, 40)]
    got = {(r.doc_id, r.n_removed_lines, r.depleted) for r in quality.verdicts(spark.createDataFrame(rows + rows[:1] * 5, SCHEMA)).collect()}
    assert got == {(i, 1, False) for i in range(1, 40)}
    kept = quality.clean(spark.createDataFrame(rows + rows[:1] * 5, SCHEMA)).where("doc_id = 1").collect()
    assert len(kept) == 6 and {r.text.count("\n") for r in kept} == {1}


def test_simhash_of_nothing_and_ties(docs):
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert {(i, "0" * 16, 2) for i in (2, 3, 4)} <= got  # null, empty and blank texts link
    same = [c for _, f, c in got if f == f"{simhash.fingerprint('a b c d'):016x}"]
    assert set(same) == {1}  # the row without a doc_id and the upper-case one too


def test_nothing_is_no_language_and_no_token(docs):
    network = bytecnn.fit(docs)
    got = {r.doc_id: r for r in bytecnn.predict(docs, network, crc_part(4, 2)).collect()}
    assert [got[i].lang_pred for i in (2, 3, 4)] == ["und"] * 3 and got[2].score == 0
    empty = hashlib.sha256(b"").hexdigest()
    got = {r.doc_id: r for r in bpe.encode_digests(docs, tokenizer_path()).collect()}
    assert (got[2].n_tokens, got[2].ids_sha256, got[2].decoded_sha256) == (0, empty, empty)


def test_warc_odd_rows(spark, new_dir):
    big, sep = "z" * 200, "WARC/1.1\r\n\r\nWARC-Type: response\r\n\r\n" * 9
    rows = [(1, "http://a/\r\nX: y", big, "c"), (2, None, big, "c"), (None, "u", big, "c"), (3, "u", None, "c"), (4, "u", "", "c"), (5, "u", sep, "c"),
            (6, "u", sep, "c"), (1, "again", big, "c"), (7, "é", "short", "c"), (8, "u", "short", "c"), (9, "u", LONG * 3, "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload_digest string")
    warc.write_archives(pages, f"{new_dir}/w", archive_chars=1000)
    records = warc.read_archives(spark, f"{new_dir}/w")
    got = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.resolved_records(records).collect()), key=str)
    n = len(sep)
    assert got == sorted([(1, "response", None, 200), (1, "response", None, 200), (2, "revisit", 1, 200), (None, "revisit", 1, 200), (3, "response", None, 0),
                          (4, "response", None, 0), (5, "response", None, n), (6, "revisit", 5, n), (7, "response", None, 5), (8, "response", None, 5),
                          (9, "response", None, len(LONG) * 3)], key=str)
    assert {r.page_id: r.payload for r in records.where("type = 'response'").collect()}[5] == sep
    warc.write_archives(pages.limit(0), f"{new_dir}/none")
    assert warc.read_archives(spark, f"{new_dir}/none").count() == 0


def test_vectors_odd_rows(spark):
    a, b = [1.0, 0.0, 0.0], [0.99, 0.05, 0.0]
    rows = [(1, a, 1), (2, a, 1), (3, b, 1), (4, a, 2), (5, a, None), (6, None, 1), (7, [0.0, 0.0, 0.0], 1), (8, [1.0, float("nan"), 0.0], 1),
            (9, [None, 1.0, 0.0], 1), (10, [float("inf"), 1.0, 0.0], 1), (11, [1.0, 0.0], 1), (12, [], 1), (2, a, 1), (None, b, 1), (13, [-1.0, 0.0, 0.0], 1)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("node", F.lit("x")).withColumn("root", F.lit("x"))
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in nndescent.near_duplicates(vectors).collect()), key=str)
    alone = [(i, 0, i, True) for i in (4, 5, 6, 7, 8, 9, 10, 11, 12, 13)]
    assert got == sorted([(1, 4, 1, True), (2, 4, 1, False), (2, 4, 1, False), (3, 4, 1, False), (None, 4, 1, False), *alone], key=str)
    assert nndescent.near_duplicates(vectors.limit(0)).count() == 0
