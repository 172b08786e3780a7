"""No letter of a name stays, in any script; domains stay distinct; addresses come out of archives as they went in."""

import random
import re
import unicodedata
from collections import defaultdict

from pyspark.sql import functions as F

from tessera.llm import pii, warc

NAMES = {
    "armenian": ["Արամյան", "Հակոբյան"],
    "cyrillic": ["Ђорђевић", "Шевченко", "Їжакевич", "Ћирић", "Ёлкин", "Ӏбрагимов"],
    "latin": ["Żółć", "Dvořák", "Łukasiewicz", "Şükrü", "Ångström", "Þórsson", "Đặng", "Nguyễn", "Ǆepić", "Smith", "O'Brien", "McDonald", "D’Angelo", "Ümit-Ñandú"],
    "greek": ["Παπαδόπουλος", "Ἀριστοτέλης", "Ώρα"],
    "coptic": ["Ⲁⲛⲧⲱⲛⲓ"],
    "glagolitic": ["Ⰽⱁⱀⱄⱅ"],
    "deseret": ["𐐔𐐯𐑅"],
}


def letters(text):
    return [c for c in unicodedata.normalize("NFC", text).lower() if c.isalpha()]


def test_no_letter_of_a_name_stays(spark):
    names = [n for group in NAMES.values() for n in group] + [unicodedata.normalize("NFD", "Dvořák"), unicodedata.normalize("NFD", "Żółć")]
    rows = spark.createDataFrame([(i, f"Dr. {n} und Frau {n}: {n}.") for i, n in enumerate(names)], "doc_id long, text string")
    out = {r.doc_id: r.text for r in pii.with_surrogates(rows, "key").collect()}
    for i, name in enumerate(names):
        new = re.fullmatch(r"Dr\. (\S+) und Frau (\S+): (\S+)\.", out[i])
        assert new and len(set(new.groups())) == 1, out[i]
        old, drawn = letters(name), letters(new[1])
        assert old and len(drawn) >= len(old)
        assert all(a != b for a, b in zip(old, drawn, strict=False)), (name, new[1])
        assert not set(re.findall(r"[^\W\d_]{3,}", name)) & set(re.findall(r"[^\W\d_]{3,}", new[1]))
        assert not any(unicodedata.combining(c) for c in new[1])
        upper = [c.isupper() or c.istitle() for c in unicodedata.normalize("NFC", name) if c.isalpha()]
        assert [c.isupper() for c in new[1] if c.isalpha()][: len(upper)] == upper
    for script, block in (("armenian", "ARMENIAN"), ("cyrillic", "CYRILLIC"), ("greek", "GREEK"), ("latin", "LATIN"), ("coptic", "LATIN"), ("deseret", "LATIN")):
        for name in NAMES[script]:
            drawn = out[names.index(name)].split(" ")[1]
            assert all(unicodedata.name(c).startswith(block) for c in drawn if c.isalpha())


def test_each_letter_becomes_another_one(spark):
    every = "".join(chr(c) for c in range(0xC0, 0x590) if chr(c).isalpha()) + "abcdefghijklmnopqrstuvwxyzაბგჰ"
    for key in range(4):
        new = spark.range(1).select(pii.like(F.lit(every), F.sha2(F.lit(str(key)), 512))).first()[0]
        assert len(new) == len(every) and not any(a == b for a, b in zip(every, new, strict=True))


def plain_replaced(text, table):
    """A text with each address and titled name replaced from a table of what was drawn."""
    return re.sub("|".join(sorted(map(re.escape, table), key=len, reverse=True)), lambda m: table[m[0]], text)


def test_texts_are_those_of_a_plain_replacer(spark):
    """What the operator drew for each entity, taken from texts of one entity, gives all other texts by plain replacing."""
    rng = random.Random(1)
    hosts = ["x.com", "q.com", "z.com", "mail.x.com", "y.org", "v.net", "k.com", "x.org"]
    entities = [f"{a}@{h}" for h in hosts for a in ("a", "bo", "ann.lee")] + [f"Frau {n}" for n in ("Żółć", "Smith", "Արամյան")] + ["10.0.0.7", "10.0.0.8"]
    texts = list(entities)
    for _ in range(40):
        texts.append(" und ".join(rng.choice(entities) for _ in range(4)) + " ende")
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = [r.text for r in sorted(pii.with_surrogates(rows, "key").collect(), key=lambda r: r.doc_id)]
    table = dict(zip(entities, out, strict=False))
    assert len(set(table.values())) == len(entities) and not set(table.values()) & set(entities)
    assert out[len(entities) :] == [plain_replaced(t, table) for t in texts[len(entities) :]]
    domains = defaultdict(set)
    for old, new in table.items():
        if "@" in old:
            domains[old.split("@")[1]].add(new.split("@")[1])
    assert all(len(d) == 1 for d in domains.values())
    drawn = [d for x in domains.values() for d in x]
    assert len(set(drawn)) == len(hosts) and not set(drawn) & set(hosts) and all(d.rpartition(".")[2] == h.rpartition(".")[2] for h, x in domains.items() for d in x)


def test_addresses_come_back_as_they_are(spark):
    urls = ["http://a.example/b%20c", "http://a.example/b c", "http://a.example/%0D%0A", "http://a.example/x\r\nWARC-Type: evil", "http://a.example/ü  ß", "%", "a: b", None, "", "http://a.example/%zz\x7f"]
    rows = spark.createDataFrame([(i, u, "h" * 10) for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r.page_id: r.url for r in warc.round_trip(rows).collect()}
    assert got == {i: u or "" for i, u in enumerate(urls)}
    plain = warc.record(1, "http://a.example/b%20c", b"x", "d", None)
    assert b"\r\nWARC-Target-URI: http://a.example/b%20c\r\n" in plain and b"Escaped" not in plain
    assert warc.record(1, urls[3], b"x", "d", None).count(b"WARC-Type") == 2
