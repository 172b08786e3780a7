"""Texts above a window: the same features as at once, in memory that doesn't grow with all of them."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessera.llm import quality_model


def at_once(text, settings):
    """Buckets of one text's byte n-grams, a number at a time."""
    raw, found = text.encode(), []
    for n in settings.ngrams:
        for i in range(len(raw) - n + 1):
            value = n
            for byte in raw[i : i + n]:
                value = (value * 0x100000001B3 + byte) % (1 << 64)
            value ^= value >> 29
            value = value * 0xBF58476D1CE4E5B9 % (1 << 64)
            found.append((value >> 40) & (settings.buckets - 1))
    return found


def test_windows_give_every_feature_once(monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abé \n") for _ in range(rng.randrange(90))) for _ in range(40)] + ["", "x"]
    settings = quality_model.Settings(buckets=1 << 10)
    whole = quality_model.feature_buckets(pa.array(texts), settings)
    for width in (1, 7, 64):
        monkeypatch.setattr(quality_model, "WINDOW_BYTES", width)
        parts = quality_model.feature_buckets(pa.array(texts), settings)
        assert sorted(zip(*(x.tolist() for x in parts), strict=True)) == sorted(zip(*(x.tolist() for x in whole), strict=True))
    for k, text in enumerate(texts):
        words = len(text.split())
        mine = sorted(whole[1][whole[0] == k].tolist())
        grams = at_once(text, settings)
        assert len(mine) == len(grams) + 2 * words + 2 * max(words - 1, 0)
        ((found, counts),) = quality_model.bucket_counts(pa.array([text]), settings)
        assert sorted(np.repeat(found, counts).tolist()) == mine
        left = list(mine)
        for g in grams:
            left.remove(g)


def test_memory_of_a_long_text():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    text = pa.array([" ".join(rng.choice(words) for _ in range(1_500_000))])
    model = quality_model.Model(np.zeros(1 << 18, np.float32), 0.5, quality_model.Settings())
    tracemalloc.start()
    assert abs(model.score(text)[0] - 1 / (1 + np.exp(-0.5))) < 1e-9
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    size = len(text[0].as_py())
    assert peak < 45 * size, peak / size


def test_training_sample_is_bounded_by_bytes(spark):
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("word"), F.col("id"), F.repeat(F.col("id").cast("string"), 40)).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    args = ("doc_id", "text", "quality")
    every = quality_model.training_samples(docs, labels, quality_model.Settings(), *args)
    sizes = [8 * len(c) for c, _, _ in every]
    for limit in (1, sum(sizes) // 6):
        some = quality_model.training_samples(docs, labels, quality_model.Settings(bytes_per_class=limit), *args)
        for label in (0, 1):
            mine = [8 * len(c) for c, _, x in some if x == label]
            assert mine and (sum(mine) <= limit or len(mine) == 1)
    assert 2 < len(some) < len(every)
