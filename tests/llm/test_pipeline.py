import hashlib

import public_tokenizers as P
import pytest
import tiktoken

import __spark_entry__
import corpus_pipeline
from pagegauge.llm import bpe, ngram_join, queries, secrets, toxicity

from .cases import awkward
from .test_ngram_join import brute

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("corpus"))
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows += [(10_000 + (r[0] if r[0] is not None else 500), *r[1:5]) for r in awkward()]
    rows += [(20_000, "clean words here password=hunter22 and more of them to read", "en", "s", 1)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{d}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.1/labels.parquet").where("doc_id < 200").write.parquet(f"{d}/labels.parquet")
    return d, rows


def test_stages_do_what_they_say(spark, small):
    d, rows = small
    docs = spark.read.parquet(f"{d}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "secret_scans", "source_mixing", "byte_bpe"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns
        before, after = docs.collect(), out.collect()
        ids = {r["doc_id"] for r in after}
        if name == "toxicity":
            chain = toxicity.fit(docs, spark.read.parquet(f"{d}/labels.parquet"))
            gone = {r["doc_id"] for r in toxicity.report(docs, chain).where("rejected").collect()}
            assert ids == {r["doc_id"] for r in before} - gone
        elif name == "ngram_jaccard_join":
            assert sorted(map(str, ids)) == sorted({c for _, _, c in brute([tuple(r) for r in before])})
        elif name == "secret_scans":
            assert ids == {r["doc_id"] for r in before}
            assert not any(secrets.KINDS["access"][0] in (r["text"] or "") or "hunter22" in (r["text"] or "") for r in after)
        else:
            assert ids <= {r["doc_id"] for r in before}
            texts = {(r["doc_id"], r["text"]) for r in before}
            assert all((r["doc_id"], r["text"]) in texts for r in after)
        path = f"{d}/{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(open(P.path(corpus_pipeline.RANKS), "rb").read()), special_tokens={})
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in corpus_pipeline.tokenize(spark, docs, d).collect():
        ids = library.encode_ordinary(texts[r["doc_id"]] or "")
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_run_and_registration(spark, small):
    d, _ = small
    assert corpus_pipeline.run(spark, d).count() > 50
    assert {*__spark_entry__.queries()} >= {"pipeline", *queries.queries()}
    assert len([n for n in queries.queries() if n.startswith("op")]) == 10


def test_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_copies_by_ratio():
    assert ngram_join.Ratio().overlap(4, 4) == 4 and ngram_join.Ratio().prefix(100) == 26
