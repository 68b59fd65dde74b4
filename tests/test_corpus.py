"""The derived library: every event becomes an annotation, and every document gets its share."""

import pytest

from marginalia.sources.corpus import Corpus


def corpus(spark, path, doc_ids, events):
    spark.createDataFrame([(i, f"Line {i}.\nSecond.\nThird.", "src") for i in doc_ids],
                          "doc_id long, text string, source string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, i * 37 % 150, ["click", "view", "purchase", "error", "other"][i % 5]) for i in range(events)],
                          "event_id long, user_id long, event_type string").write.parquet(f"{path}/events.parquet")
    return Corpus(spark, str(path))


@pytest.mark.parametrize("documents", [200, 144])
def test_every_document_is_reached_alike(spark, tmp_path, documents):
    """Numbers of documents that 4 divides, as all given sizes, are no exception."""
    marks = corpus(spark, tmp_path, range(documents), 3000).marks()
    spread = [r.doc_id for r in marks.where("event_id % 4 <> 0").select("doc_id").collect()]
    assert set(spread) == set(range(documents))
    for modulus in range(2, 17):
        counts = [sum(d % modulus == rest for d in spread) for rest in range(modulus)]
        shares = [c / len([d for d in range(documents) if d % modulus == rest]) for rest, c in enumerate(counts)]
        assert max(shares) < 1.2 * min(shares)


def test_sparse_ids_lose_no_event(spark, tmp_path):
    marks = corpus(spark, tmp_path, [-5, 3, 1000, 70_000, 70_001, 2**40], 500).marks()
    assert marks.count() == 500 and marks.select("doc_id").distinct().count() == 6


def test_no_documents(spark, tmp_path):
    assert corpus(spark, tmp_path, [], 10).marks().count() == 0
