"""Collocations, spelling variants and substring dedup beside plain versions, and on odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import collocations as co
from tessera.llm import spelling as sp
from tessera.llm import substrings as su
from tessera.llm.fm_index import FMIndex, WaveletMatrix
from tessera.llm.wordstream import Bitmap, Splitter, common_hashes, cut_hash, packed, unpacked

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, word string, phrase string, seg string, node int, hash long"
BLANK = "[\x20\x09-\x0d]+"


def docs_of(spark, rows):
    """Rows (doc_id, text, lang) with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, lang, "s", 1, 7, "x", "y", "z", 3, 9) for i, t, lang in rows], SCHEMA)


def some_words(rng, n, size):
    return [f"w{int(rng.random() ** 2 * size)}" for _ in range(n)]


ODD = [(1, None, "en"), (2, "", "en"), (3, " \t\n\r", None), (None, "one two", None), (4, "é" * 3000 + " " + "x" * 700_000, "de"), (4, "İ ß 😀, a.b", "de"), (4, "İ ß 😀, a.b", "de")]


# --- pieces, packed hashes, bitmaps -------------------------------------------------------------------------------


def test_pieces_cover_texts_once_and_bring_the_next_words():
    rng = random.Random(1)
    texts = [" ".join(some_words(rng, n, 50)) for n in (0, 3, 900, 2, 4000, 1)] + ["x" * 5000 + " y z", ""]
    found = defaultdict(list)
    for raw, offsets, rows, own in Splitter(b" ", 2, 100).pieces(pa.array(texts)):
        for row, a, b in zip(rows.tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            data = raw[a:b].tobytes().decode()
            mine = raw[a : min(b, own)].tobytes().decode().split()
            before = [w for part in found[row] for w in part]
            assert data.split() == texts[row].split()[len(before) :][: len(mine) + (2 if own < b else 0)]
            found[row].append(mine)
    assert [[w for part in found[i] for w in part] for i in range(len(texts))] == [t.split() for t in texts]


def test_packed_hashes():
    rng = np.random.default_rng(2)
    codes = np.unique(rng.integers(0, 1 << 32, 3000, dtype=np.uint64)).astype(np.uint32)
    counts = rng.integers(1, 90_000, len(codes))
    a, b = unpacked(packed(codes, counts))
    assert (a == codes).all() and (b == np.minimum(counts, 65535)).all()


def test_common_hashes_and_bitmap(spark):
    rng = random.Random(3)
    values = [rng.randrange(500) ** 3 * 0x9E3779B97F4A7C15 % (1 << 64) for _ in range(6000)]
    rows = spark.createDataFrame([(v - (1 << 63),) for v in values], "v long").repartition(5)
    found = common_hashes(rows, lambda batch: iter([batch.column("v").to_numpy().view(np.uint64)]), 12, 8)
    signed = np.array([v - (1 << 63) for v in values], np.int64).view(np.uint64)
    cut = Counter(cut_hash(signed, 8).tolist())
    got = {np.int64(r.hash).view(np.uint64).item() for r in found.collect()}
    assert got == {v for v, n in cut.items() if n >= 12}
    bitmap = Bitmap.of(found, len(got))
    assert bitmap.has(np.array(sorted(got), np.uint64)).all()
    others = np.random.default_rng(4).integers(0, 1 << 63, 20_000).astype(np.uint64)
    assert bitmap.has(others).mean() < 0.02


# --- collocations ---------------------------------------------------------------------------------------------------


def plain_collocations(rows, limits):
    counts, totals = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = [x for x in re.split("[\x20\x09]+", piece) if x]
            totals[lang or "und"] += len(w)
            for k in range(1, limits.max_words + 1):
                for i in range(len(w) - k + 1):
                    counts[lang or "und"][tuple(w[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        kept = []
        good = {p: a for p, a in f.items() if len(p) > 1 and a >= limits.min_count}
        for p, a in good.items():
            if any(len(q) > len(p) and 100 * b >= limits.cover * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in good.items()):
                continue
            cuts = [(1000 * a * totals[lang] // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            kept.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(kept)[: limits.top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("limits", [co.Limits(4, 5, 100, 30), co.Limits(3, 2, 100, 2000), co.Limits(5, 4, 60, 2000), co.Limits(1, 1, 100, 5)])
def test_collocations_equal_a_plain_version(spark, limits):
    rng = random.Random(5)
    rows = [(i, " ".join(some_words(rng, rng.randrange(90), 30)) + rng.choice([". A b", ",\tB  a\nA", " New York City", ""]), rng.choice(["en", "de", None, "und"])) for i in range(120)] + ODD
    got = [tuple(r) for r in co.collocations(docs_of(spark, rows), limits).collect()]
    assert sorted(got) == plain_collocations(rows, limits)


def test_collocations_of_long_texts_and_of_large_products(spark):
    rng = random.Random(6)
    long = [(1, " ".join(some_words(rng, 60_000, 40)), "en")]
    limits = co.Limits(200, 5, 100, 50)
    got = [tuple(r) for r in co.collocations(docs_of(spark, long), limits).collect()]
    assert sorted(got) == plain_collocations(long, limits)
    big = 3_000_000_000
    found = spark.createDataFrame([("en", None, 9 * big), ("en", "a", big), ("en", "b", big - 1), ("en", "a b", big - 2)], "lang string, phrase string, n long")
    row = co.scored(found, co.Limits()).first()
    assert row.score == 1000 * (big - 2) * 9 * big // (big * (big - 1))


def test_no_collocations_in_an_empty_table(spark):
    assert co.collocations(docs_of(spark, [])).collect() == []


# --- spelling variants ----------------------------------------------------------------------------------------------


def plain_words(rows, rules):
    n = Counter()
    for doc_id, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if rules.damage and h % rules.damage == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            if len(run) >= rules.min_length:
                n[run] += 1
    return {w: k for w, k in n.items() if k >= rules.min_count}


def one_apart(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows, rules):
    n = plain_words(rows, rules)
    near = {w: [x for x in n if one_apart(w, x)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= rules.ratio * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("rules", [sp.Rules(3, 1, 2, 5), sp.Rules(2, 2, 3, None), sp.Rules()])
def test_variants_equal_a_plain_version(spark, rules):
    rng = random.Random(7)
    letters = "abÀé÷Zz"
    rows = []
    for i in range(150):
        text = [rng.choice(["", "kitten", "Straße", "aaaaaaab"]) + "".join(rng.choice(letters) for _ in range(rng.randrange(1, 6))) for _ in range(20)]
        rows.append((i % 40 if i % 7 else None, rng.choice([" ", "-", "1", "\n", "€"]).join(text), "en"))
    rows += ODD[:3] + [(9, ("é" * 9 + " ") * 3 + "kittens " * 30 + "kitten " * 2, "en"), (9, "y" * 70 + " " + "y" * 70, "en")]
    got = sorted((tuple(r) for r in sp.variants(docs_of(spark, rows), rules).collect()), key=str)
    assert got == plain_variants(rows, rules)


def test_neighbourhoods_are_whole_and_distinct(spark):
    words = ["aab", "ab", "bÿa", "aaaa", "b"]
    alphabet = "abÿ"
    found = sp.near_candidates(spark.createDataFrame([(w,) for w in words], "word string"), bytes(sorted(map(ord, alphabet))), None, at_once=5).collect()
    for w in words:
        got = [r.near for r in found if r.word == w]
        want = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in alphabet}
        want |= {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in alphabet if c != w[i]}
        assert sorted(got) == sorted(want)


def test_check_sums():
    rng = random.Random(8)
    parts = [bytes(rng.randrange(256) for _ in range(n)) for n in (0, 1, 5, 63, 64, 65, 200, 3)]
    ends = np.cumsum([len(p) for p in parts])
    begun = np.array([zlib.crc32(f"{i}:".encode()) for i in range(len(parts))], np.uint32)
    got = sp.check_sums(np.frombuffer(b"".join(parts), np.uint8), ends - [len(p) for p in parts], ends, begun)
    assert got.tolist() == [zlib.crc32(p, int(b)) for p, b in zip(parts, begun, strict=True)]


def test_variants_of_an_empty_table(spark):
    assert sp.variants(docs_of(spark, [])).collect() == []


# --- FM-index and substring dedup -----------------------------------------------------------------------------------


def test_wavelet_matrix_ranks():
    rng = np.random.default_rng(9)
    for sigma in (1, 2, 7, 64):
        symbols = rng.integers(0, sigma, 300)
        matrix = WaveletMatrix(symbols, sigma)
        c, upto = rng.integers(0, sigma, 200), rng.integers(0, 301, 200)
        assert matrix.rank(c, upto).tolist() == [int((symbols[:u] == x).sum()) for x, u in zip(c.tolist(), upto.tolist(), strict=True)]


def test_matching_statistics_equal_a_plain_search():
    rng = random.Random(10)
    texts = [[rng.randrange(1, 4) for _ in range(rng.randrange(1, 25))] for _ in range(30)] + [[1] * 40, [1] * 40, [2]]
    owners = np.array([rng.randrange(12) for _ in texts], np.int32)
    tokens, offsets = np.array(sum(texts, [])), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    index = FMIndex(tokens, offsets, owners)

    def stands(part, owner):
        return any(o < owner and any(t[i : i + len(part)] == part for i in range(len(t) - len(part) + 1)) for t, o in zip(texts, owners, strict=True))

    for text, owner in zip(texts, owners, strict=True):
        ends = np.arange(1, len(text) + 1)
        most = np.minimum(ends, 9)
        want = [max(k for k in range(m + 1) if k == 0 or stands(text[e - k : e], owner)) for e, m in zip(ends.tolist(), most.tolist(), strict=True)]
        # a longer match has all the shorter ones
        assert index.matched(np.array(text), ends, most, np.full(len(ends), owner)).tolist() == want


def plain_dedup(rows, window):
    first = {}
    split = [(i, [w for w in re.split(BLANK, t or "") if w]) for i, t, _ in rows]
    order = [float("inf") if i is None else i for i, _ in split]
    for (_, w), o in zip(split, order, strict=True):
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(o, first.get(key, o))
    out = []
    for (i, w), o in zip(split, order, strict=True):
        gone = {k + j for k in range(len(w) - window + 1) if first[tuple(w[k : k + window])] < o for j in range(window)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def shared_passages(rng, n, size, passages):
    rows = []
    for i in range(n):
        parts = [some_words(rng, rng.randrange(30), size)]
        for _ in range(rng.randrange(4)):
            p = list(rng.choice(passages))
            if rng.random() < 0.4:
                p[rng.randrange(len(p))] = f"e{rng.randrange(9)}"
            parts += [p, some_words(rng, rng.randrange(12), size)]
        rows.append((rng.choice([i, i, i % 10, None]), rng.choice([" ", "\n", " \t"]).join(sum(parts, [])), "en"))
    return rows


@pytest.mark.parametrize("window,run,shard_words", [(50, 8, su.SHARD_WORDS), (12, 3, 400), (10, 4, 40), (6, 6, 1)])
def test_dedup_equals_a_plain_version(spark, window, run, shard_words):
    """Small shards make anchors common, so that these go by windows."""
    rng = random.Random(11)
    passages = [some_words(rng, rng.choice([window - 1, window, window + 3, 3 * window]), 500) for _ in range(8)] + [["a"] * (window + 5)]
    rows = shared_passages(rng, 140, 400, passages) + ODD
    rows += rows[:9] + [(i, rows[3][1], "en") for i in range(200, 240)]
    got = sorted((tuple(r) for r in su.deduplicated_words(docs_of(spark, rows), window, run, shard_words).collect()), key=str)
    assert got == plain_dedup(rows, window)


def test_dedup_of_long_texts(spark):
    """Texts of several pieces, whose repeated passages cross the pieces' ends."""
    rng = random.Random(12)
    base = some_words(rng, 150_000, 100_000)
    rows = [(2, " ".join(base), "en"), (1, " ".join(some_words(rng, 500, 900) + base[20_000:120_000] + ["end"]), "en"), (3, "\n".join(base[40_000:140_040]), "en")]
    got = sorted((tuple(r) for r in su.deduplicated_words(docs_of(spark, rows)).collect()), key=str)
    assert got == plain_dedup(rows, 50)


def test_dedup_of_an_empty_table(spark):
    assert su.deduplicated_words(docs_of(spark, [])).collect() == []
    with pytest.raises(ValueError):
        su.deduplicated_words(docs_of(spark, []), 5, 8)
