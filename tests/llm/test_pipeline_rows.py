"""The pipeline decides by row: null and repeated ids neither shield a row nor take others along."""

import pytest

import corpus_pipeline


@pytest.fixture(params=["rows", "files"])
def held(request, spark, tmp_path):
    """Documents as they are, or as rows of several Parquet files."""

    def keep(docs):
        if request.param == "rows":
            return docs
        docs.repartition(3).write.parquet(str(tmp_path / "docs"))
        return spark.read.parquet(str(tmp_path / "docs"))

    return keep


def words(k):
    return " ".join(f"{w}{(i * k) % 61}" for i, w in enumerate(["alpha", "beta", "gamma", "delta"] * 30))


def kept(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_decontaminate_by_row(spark, make, small, held):
    dirty = spark.read.parquet(f"{small}/benchmark.parquet").first().text
    docs = make([(None, dirty, "en", "s"), (None, "a clean text", "en", "s"), (9, dirty, "en", "s"), (9, "another clean text", "en", "s"), (4, "one more", "en", "s"), (None, None, "en", "s")])
    docs = held(docs)
    out = corpus_pipeline.decontaminate(spark, docs, small)
    assert out.columns == docs.columns
    assert kept(out) == sorted([(None, "a clean text"), (9, "another clean text"), (4, "one more"), (None, None)], key=str)


def test_near_duplicates_by_row(spark, make, small, held):
    a, b, c, d = map(words, (7, 11, 13, 17))
    docs = make([(5, a, "en", "s"), (5, b, "en", "s"), (3, b, "en", "s"), (7, a, "en", "s"), (None, c, "en", "s"), (None, c, "en", "s"), (None, d, "en", "s"), (8, d, "en", "s")])
    docs = held(docs)
    out = corpus_pipeline.near_duplicates(spark, docs, small)
    assert out.columns == docs.columns
    assert kept(out) == sorted([(5, a), (3, b), (None, c), (8, d)], key=str)
