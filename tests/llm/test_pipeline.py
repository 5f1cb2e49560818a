"""The corpus pipeline stage by stage against plain versions, and its entry in the driver's contract."""

import sys
from pathlib import Path

import pyarrow.parquet as pq
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

import brute  # noqa: E402
import corpus_pipeline  # noqa: E402
from mnemoframe.llm import complement_pack, quality_model  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage read and gave, through files as in a run."""
    folder, out = tmp_path_factory.mktemp("stages"), {}
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, FOLDER)
        after.write.parquet(f"{folder}/{name}")
        after = spark.read.parquet(f"{folder}/{name}")
        out[name] = (docs, after)
        docs = after
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_stages_keep_the_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "copies", "leaks", "packing"]
    for name in ("quality", "lines", "copies", "leaks"):
        assert stages[name][1].columns == COLUMNS


def test_quality_stage(stages):
    before, after = stages["quality"]
    kept = {r["doc_id"] for r in quality_model.quality_scores(before).where("kept").collect()}
    assert texts(after) == {i: t for i, t in texts(before).items() if i in kept}
    labels = pq.read_table(f"{FOLDER}/labels.parquet").to_pydict()
    clean = [i in kept for i, q in zip(labels["doc_id"], labels["quality"]) if q]
    assert sum(clean) >= 0.97 * len(clean)


def test_lines_stage(stages):
    before, after = stages["lines"]
    want = {i: t for i, t, _, lost in brute.without_lines(list(texts(before).items())) if not lost or brute.words(t)}
    assert texts(after) == want and len(want) < before.count()
    assert all(r["n_chars"] == len(r["text"]) for r in after.collect())


def test_copies_leave_no_blank_document(stages):
    """Of the copies that whole documents have after the quality stage, those that lost all lines go with the lines."""
    before = list(texts(stages["quality"][1]).items())
    copies = {i for i, _, c in brute.components(before) if i != c}
    lines, packed = texts(stages["lines"][1]), texts(stages["packing"][0])
    assert copies and all(brute.words(t) for t in packed.values())
    # what is left of a copy holds only lines that no earlier document has
    whole = dict(before)
    for i in copies & set(packed):
        assert lines[i] != whole[i] or len(whole[i].split("\n")) == 1


def test_copies_stage(stages):
    before, after = stages["copies"]
    rows = list(texts(before).items())
    assert texts(after) == {i: t for (i, t), (_, _, c) in zip(rows, brute.components(rows)) if i == c}


def test_leaks_stage(stages):
    before, after = stages["leaks"]
    bench = pq.read_table(f"{FOLDER}/benchmark.parquet").to_pydict()
    seeds = {g for t in bench["text"] for g in brute.shingles(" ".join(brute.plain(t)))}
    rows = [(i, t) for i, t in texts(before).items() if brute.shingles(" ".join(brute.plain(t))) & seeds]
    lost = {i for i, _ in brute.leaks(rows, list(zip(bench["item_id"], bench["text"])))}
    assert lost and texts(after) == {i: t for i, t in texts(before).items() if i not in lost}


def test_packing_stage(stages):
    import public_tokenizers
    from tokenizers import Tokenizer

    before, after = stages["packing"]
    whole = Tokenizer.from_file(public_tokenizers.path(complement_pack.VOCABULARY))
    got = {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in after.collect()}
    assert got == brute.pieces(list(texts(before).items()), whole, complement_pack.CAPACITY)


def test_run(spark, stages):
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    got = {tuple(r) for r in corpus_pipeline.run(spark, FOLDER).select(*columns).collect()}
    assert got == {tuple(r) for r in stages["packing"][1].select(*columns).collect()}


def test_registered():
    import __spark_entry__ as entry

    names = list(entry.queries())
    assert "pipeline" in names
    for n in range(1, 14):
        assert len([x for x in names if x.startswith(f"op{n}_")]) == 1


def test_null_documents_pass_all_stages(spark):
    docs = spark.createDataFrame([(1, None, "en", None, 0), (2, "", None, "s", 0), (None, None, None, None, None), (3, "one two three four five six seven", "en", "s", 33), (3, "one two three four five six seven", "en", "s", 33)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[1:]:
        stage(spark, docs, FOLDER).collect()
    assert corpus_pipeline.quality(spark, docs, FOLDER).collect() is not None
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, FOLDER).count() == 0
