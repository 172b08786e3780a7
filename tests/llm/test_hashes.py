"""Hashes of spans that no text can make collide by algebra, and one shingle set a text whatever the repeats."""

import random
import zlib

import numpy as np
import pyarrow as pa

import public_tokenizers
from tessera.llm import fingerprints, near_dedup, packing
from tessera.llm.common import span_hashes

PATH = public_tokenizers.path("word_bpe_49k.json")


def thue_morse(doublings):
    word = "a"
    for _ in range(doublings):
        word += word.translate(str.maketrans("ab", "ba"))
    return word


WORD = thue_morse(10)
OTHER = WORD.translate(str.maketrans("ab", "ba"))


def test_span_hashes_tell_spans_apart():
    rng = random.Random(1)
    spans = [bytes(rng.choice(b"ab\0") for _ in range(rng.choice([0, 1, 3, 7, 8, 9, 16, 17, 1024, 1025, 3000]))) for _ in range(600)]
    spans += [WORD.encode(), OTHER.encode(), WORD.encode() * 2, WORD.encode() + OTHER.encode(), b"\0" * 8, b"\0" * 9]
    ends = np.cumsum([len(s) for s in spans])
    raw = np.frombuffer(b"".join(spans), np.uint8)
    found = span_hashes(raw, ends - [len(s) for s in spans], ends)
    other = span_hashes(raw, ends - [len(s) for s in spans], ends, seed=1)
    assert len(set(found.tolist())) == len(set(other.tolist())) == len(set(spans)) and not set(found.tolist()) & set(other.tolist())
    seen = {}
    assert all(seen.setdefault(s, h) == h for s, h in zip(spans, found.tolist(), strict=True))
    # where a span stands doesn't matter
    moved = span_hashes(np.concatenate([np.frombuffer(b"xyz", np.uint8), raw]), ends - [len(s) for s in spans] + 3, ends + 3)
    assert (moved == found).all()


def test_long_words_keep_their_ids_and_fingerprints(spark):
    text = f"x {WORD} y {OTHER} z"
    coder = packing.WordIds(PATH, 1 << 20)
    assert coder.encode(text) == np.array(coder.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    rows = spark.createDataFrame([(1, WORD), (2, OTHER), (3, WORD)], "doc_id long, text string")
    got = {r.doc_id: r for r in fingerprints.edited_pairs(rows).collect()}
    assert got[1].fingerprint == got[3].fingerprint != got[2].fingerprint and got[1].near_next == 0.0
    assert zlib.crc32(WORD.encode()) != zlib.crc32(OTHER.encode())


def test_repeated_rows_have_one_set(spark, monkeypatch):
    rng = random.Random(2)
    base = [f"w{rng.randrange(900)}" for _ in range(200)]
    near = base[:-1] + ["end"]
    rows = spark.createDataFrame([(1, " ".join(base))] * 60 + [(2, " ".join(near))] * 60, "doc_id long, text string")
    sizes = []
    real = near_dedup.checked

    def counted(pairs, sets, least):
        sizes.append((pairs.count(), sets.count(), sets.select("node").distinct().count()))
        return real(pairs, sets, least)

    monkeypatch.setattr(near_dedup, "checked", counted)
    got = near_dedup.near_duplicates(rows).collect()
    assert sizes[0] == (1, 2, 2)
    assert len(got) == 120 and {(r.class_id, r.class_size) for r in got} == {(1, 120)}


def test_hashes_of_strings_with_an_offset():
    array = pa.array(["zero", "one", "two", "one"]).slice(1)
    ends = np.cumsum([3, 3, 3])
    found = span_hashes(np.frombuffer("".join(array.to_pylist()).encode(), np.uint8), ends - 3, ends)
    assert found[0] == found[2] != found[1]
