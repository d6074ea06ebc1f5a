import __spark_entry__ as entry
import corpus_pipeline
from detlake.session import scratch_path
from tests.llm.helpers import clashing, documents, prose

FOLDER = "/root/testdata/sf0.001"


def applied(spark, docs, names):
    for name, stage in corpus_pipeline.STAGES:
        if name in names:
            path = scratch_path(spark, "test-stage")
            stage(spark, docs, FOLDER).write.parquet(path)
            docs = spark.read.parquet(path)
    return docs


def test_all_queries_are_registered():
    names = set(entry.queries())
    assert "pipeline" in names
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


def test_stages_take_effect(spark):
    base = " ".join(f"the{i} of and word{i * 7}" for i in range(60))
    rows = [
        (1, base, "en", "a", 1),
        (2, base, "en", "a", 1),
        (2, base, "en", "a", 1),
        (3, base + " more", "en", "a", 1),
        (4, "&&& " * 80, "en", "a", 1),
        (5, None, "en", "a", 1),
        (6, " ".join(f"of the{i} and x{i}" for i in range(80)), "en", "b", 1),
    ]
    docs = clashing(documents(spark, rows), "kept", "document", "size")
    names = [n for n, _ in corpus_pipeline.STAGES]
    kept = applied(spark, docs, names[:1])
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 2, 3, 6] and kept.columns == docs.columns
    exact = applied(spark, kept, names[1:2])
    assert sorted(r.doc_id for r in exact.collect()) == [2, 3, 6]
    near = applied(spark, exact, names[2:3])
    assert sorted(r.doc_id for r in near.collect()) == [2, 6]
    mixed = applied(spark, near, names[3:4])
    assert mixed.columns == docs.columns and set(r.doc_id for r in mixed.collect()) <= {2, 6}
    coded = applied(spark, mixed, names[4:])
    assert coded.count() == mixed.count() and coded.filter("not round_trip").count() == 0


def test_run_and_empty_table(spark):
    out = corpus_pipeline.run(spark, FOLDER)
    assert out.columns == ["doc_id", "n_pieces", "ids_crc32", "round_trip"] and out.count() > 50
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert applied(spark, documents(spark, []), names).count() == 0


def test_clean_documents_stay(spark):
    rows = [(i, prose(i, 150), "en", "a", 0) for i in range(30)]
    assert applied(spark, documents(spark, rows), ["quality rules", "exact dedup", "n-gram jaccard join"]).count() == 30
