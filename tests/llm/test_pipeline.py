"""The pipeline stage by stage: what each keeps and drops, held against plain versions on its own input."""

import zlib

import corpus_pipeline
from tessera.llm import mixing
from tessera.llm.common import pinned
from tests.llm.test_llm_operators import check_pieces, plain_classes, plain_secrets

SMALL = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    inputs, outputs = [], []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        inputs.append({r.doc_id: r for r in docs.collect()})
        out = stage(spark, docs, SMALL)
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        outputs.append(docs.collect())
    good = [i for i, q in labels.items() if q == 1]
    kept = {r.doc_id for r in outputs[0]}
    assert sum(i in kept for i in good) >= 0.95 * len(good)
    ids = sorted(inputs[1])
    classes = plain_classes([inputs[1][i].text for i in ids])
    assert {r.doc_id for r in outputs[1]} == {ids[c] for c in set(classes.values())}
    assert {r.doc_id for r in outputs[2]} == set(inputs[2]) and not any(plain_secrets(r.text)[0] for r in outputs[2])
    assert all(r.text == inputs[2][r.doc_id].text for r in outputs[2] if not plain_secrets(inputs[2][r.doc_id].text)[0])
    assert {(r.doc_id, zlib.crc32(r.text.encode())) for r in outputs[3]} == {(i, zlib.crc32(r.text.encode())) for i, r in inputs[3].items()}
    check_pieces(outputs[4], {i: r.text for i, r in inputs[4].items()})


def test_run_equals_its_stages(spark):
    assert corpus_pipeline.run(spark, SMALL).select("doc_id").distinct().count() > 50


def test_run_gives_the_rows_of_its_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = pinned(stage(spark, docs, SMALL))
    pieces = corpus_pipeline.run(spark, SMALL)
    check_pieces(pieces.collect(), {r.doc_id: r.text for r in docs.collect()})


def test_stages_handle_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, _found string, _key long, position long"
    texts = [None, "", "one two", "one two", "pass word " * 30 + "password=Zx9kQ2mN7pL4", "w " * 5000]
    rows = [(i, t, "en", None if i % 2 else "a", None, "x", 1, 2) for i, t in enumerate(texts)]
    rows += [(None, "no id " * 9, None, None, 1, None, None, None), rows[2], (2, "other text with id two", "de", "b", 5, "", 0, 0)]
    docs = spark.createDataFrame(rows, schema)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = pinned(stage(spark, docs, SMALL))
        empty = stage(spark, docs.limit(0), SMALL)
        assert empty.collect() == [] and (k == 4 or out.columns == docs.columns == empty.columns)
        if k in (2, 3):
            assert out.count() == docs.count()
        docs = out if k and k < 4 else docs  # the classifier's own choice is left out, so that all odd rows go on
    assert out.count() > 5


def test_sequences_follow_the_mix(spark, tmp_path):
    counts = {"big": 3000, "small": 300}
    rows = [(k * 10_000 + i, f"{s} " + "word " * 60, "en", s) for k, (s, n) in enumerate(counts.items()) for i in range(n)]
    corpus_pipeline.mix_sources(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), SMALL).write.parquet(str(tmp_path / "mixed"))
    # files may be read in any order
    out = corpus_pipeline.pack_windows(spark, spark.read.parquet(str(tmp_path / "mixed")).orderBy("doc_id"), SMALL)
    pieces = sorted(out.collect(), key=lambda r: (r.sequence_id, r.offset))
    assert len({r.doc_id for r in pieces}) == 3300
    steps = [r.step_id for r in pieces]
    assert steps == sorted(steps)
    # documents are equally long, so tokens stand for rows; the small source ends after about 1300 rows of the mix
    all_tokens, small, seen, last = sum(r.length for r in pieces), 0, 0, 0
    total = sum(n**mixing.POWER for n in counts.values())
    for r in pieces:
        seen += r.length
        small += r.length if r.doc_id >= 10_000 else 0
        last = seen if r.doc_id >= 10_000 else last
        at = 3300 * seen / all_tokens
        assert abs(3300 * small / all_tokens - min(300, at * 300**mixing.POWER / total)) < 3 * mixing.BLOCK_ROWS
    assert last < 0.55 * all_tokens
