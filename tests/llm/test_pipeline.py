"""The pipeline: its stages in order, and run() against the stages applied one by one."""

import pytest

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages_pass_documents_on(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, SF), f"test-{name}")
        assert docs.columns == columns and 0 < docs.count() <= before, name
        before = docs.count()
    pieces = corpus_pipeline.materialize(corpus_pipeline.STAGES[-1][1](spark, docs, SF), "test-pieces")
    assert pieces.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    key = lambda df: sorted(map(tuple, df.select("doc_id", "start", "length", "ids_crc32").collect()))
    assert key(corpus_pipeline.run(spark, SF)) == key(pieces)


@pytest.mark.parametrize("name", ["toxicity", "line_dedup", "minhash_near_dedup", "benchmark_decontamination"])
def test_each_stage_removes_documents(spark, name):
    """On the documents themselves: after line dedup few near copies are left."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    left = dict(corpus_pipeline.STAGES)[name](spark, docs, SF)
    assert left.columns == docs.columns and 0 < left.count() < docs.count()


def wrapped(words, first, width=10):
    cut = [0, *range(first, len(words), width), len(words)]
    return "\n".join(" ".join(words[a:b]) for a, b in zip(cut, cut[1:]) if b > a)


def test_stages_in_order_each_remove_documents(spark, tmp_path):
    """Copies with other line breaks pass line dedup, as no line of theirs is alike; near-dedup keeps one of each. The stages'
    order is given, so near copies with the same lines are mostly gone by then."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    words = [[f"{chr(97 + k)}{i * 37 % 101}o{i}" for i in range(80)] for k in range(5)]
    made = [(1_000_000 + 10 * k + n, wrapped(w, first), "en", "made", 0) for k, w in enumerate(words) for n, first in enumerate((10, 5, 3))]
    docs.unionByName(spark.createDataFrame(made, docs.schema)).write.parquet(str(tmp_path / "documents.parquet"))
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(str(tmp_path / f"{t}.parquet"))
    left = spark.read.parquet(str(tmp_path / "documents.parquet"))
    counts = [left.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = corpus_pipeline.materialize(stage(spark, left, str(tmp_path)), f"order-{name}")
        counts.append(left.count())
        ids = {r.doc_id for r in left.select("doc_id").collect() if r.doc_id >= 1_000_000}
        assert ids == ({1_000_000 + 10 * k for k in range(5)} if name in ("minhash_near_dedup", "benchmark_decontamination") else {r[0] for r in made})
    assert all(a > b for a, b in zip(counts, counts[1:])), counts


def test_entry_registers_all(spark):
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
