import __spark_entry__ as driver
import corpus_pipeline
from edge_documents import edge_documents, no_documents
from llm_paths import SMALL
from sweepfield.llm import near
from test_corpus_operators import brute_components, shingles


def test_entry_has_the_operators():
    names = driver.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))


def test_stages_keep_the_columns(spark):
    for docs in (edge_documents(spark), no_documents(spark)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            made = stage(spark, docs, SMALL)
            assert made.columns == docs.columns and [f.dataType for f in made.schema] == [f.dataType for f in docs.schema], name
            made.count()
        assert set(corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).columns) >= {"doc_id", "n_tokens"}


def test_run(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    ids = [r.doc_id for r in docs.collect()]
    rows = corpus_pipeline.run(spark, SMALL).collect()
    assert rows and {r.doc_id for r in rows} < set(ids) and all(r.n_tokens > 0 for r in rows)
    assert len({r.doc_id for r in rows}) > 0.8 * len(ids)


def near_pairs(n=40, words=300):
    """Texts in pairs, the second with some words replaced one by one far apart: similarities between 0.80 and 0.85."""
    docs = []
    for i in range(n):
        one = [f"a{i}x{j}" for j in range(words)]
        two = list(one)
        for j in range(5 + i % 2):  # each changes five of 296 shingles
            two[20 + 40 * j] = f"b{i}x{j}"
        docs += [(2 * i, " ".join(one)), (2 * i + 1, " ".join(two))]
    return docs


def test_the_stage_drops_near_copies_from_0_80_on(spark):
    docs = near_pairs()
    alike = [len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b)) for (_, a), (_, b) in zip(docs[::2], docs[1::2])]
    assert all(0.80 <= x < 0.85 for x in alike)
    want = sorted(i for i, (_, least) in brute_components(docs, 80).items() if i == least)
    got = corpus_pipeline.deduplicate(spark, spark.createDataFrame(docs, "doc_id long, text string"), SMALL).collect()
    assert sorted(r.doc_id for r in got) == want == list(range(0, len(docs), 2))


def test_the_sketch_bound_follows_the_percent():
    for percent in (80, 85, 95):
        mean = percent / 100 + (1 - percent / 100) / 16
        assert near.least_agree(percent) <= mean - 5 * (mean * (1 - mean) / near.HASHES) ** 0.5 + 1e-9
    assert near.least_agree(80) < 0.65
