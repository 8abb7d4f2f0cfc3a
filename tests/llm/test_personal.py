"""Personal data: plain spans against the patterns as they stand, disguised ones by their places, odd input, linear time."""

import hashlib
import random
import re
import time

import pytest

from quillspark.llm import personal

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def by_patterns(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            even = [int(c) * 2 - 9 * (int(c) > 4) for c in d[-2::-2]]
            luhn = (sum(map(int, d[-1::-2])) + sum(even)) % 10 == 0
            fits = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 12 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}
            if fits[kind]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_plain_spans_by_brute_force():
    rng = random.Random(4)
    for _ in range(20_000):
        t = "".join(rng.choice(rng.choice(["ab.@", "019. -", "+0123456789 ()-.", "a@b.1-+ é", "4 -"])) for _ in range(rng.randrange(60)))
        assert [(f.start, f.kind, f.end) for f in personal.search(t) if f.plain] == by_patterns(t), t


@pytest.mark.parametrize(
    ("text", "kind", "span", "value"),
    [
        ("mail john.smith [at] example [dot] com now", "email", "john.smith [at] example [dot] com", "john.smith@example.com"),
        ("mail john at example dot com now", "email", "john at example dot com", "john@example.com"),
        ("Write to jane dot roe arroba mail7 punto example punto com, é", "email", "jane dot roe arroba mail7 punto example punto com", "jane.roe@mail7.example.com"),
        ("x und.34 at mail7.example.com x", "email", "und.34 at mail7.example.com", "und.34@mail7.example.com"),
        ("john@example[.]com", "email", "john@example[.]com", "john@example.com"),
        ("é john (AT) example.com", "email", "john (AT) example.com", "john@example.com"),
        ("john @ example . com", "email", "john @ example . com", "john@example.com"),
        ("to јоhn@exаmple.com!", "email", "јоhn@exаmple.com", "john@example.com"),
        ("j​ohn@exam​ple.com", "email", "j​ohn@exam​ple.com", "john@example.com"),
        ("ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ", "email", "ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ", "john@example.com"),
        ("john&#64;example&#46;com", "email", "john&#64;example&#46;com", "john@example.com"),
        ("call plus four nine one five one two three four five six seven eight", "phone", "plus four nine one five one two three four five six seven eight", "+491512345678"),
        ("call +1 (five five five) zero one two 3456", "phone", "+1 (five five five) zero one two 3456", "+1 (555) 012 3456"),
        ("call +1 555 zero one two 3456.", "phone", "+1 555 zero one two 3456", "+1 555 012 3456"),
        ("+١ ٥٥٥ ١٢٣ ٤٥٦٧", "phone", "+١ ٥٥٥ ١٢٣ ٤٥٦٧", "+1 555 123 4567"),
        ("pay four double one one one one one one one one one one one one one one", "card", "four double one one one one one one one one one one one one one one", "4111111111111111"),
        ("４１１１ １１１１ １１１１ １１１１", "card", "４１１１ １１１１ １１１１ １１１１", "4111 1111 1111 1111"),
        ("at 192[.]168[.]0[.]1 and", "ip", "192[.]168[.]0[.]1", "192.168.0.1"),
        ("eins neun zwei punkt eins sechs acht punkt null punkt eins", "ip", "eins neun zwei punkt eins sechs acht punkt null punkt eins", "192.168.0.1"),
    ],
)
def test_disguised(text, kind, span, value):
    found = [f for f in personal.search(text) if not f.plain]
    assert [(personal.KINDS[f.kind], text[f.start : f.end], f.value) for f in found] == [(kind, span, value)]


@pytest.mark.parametrize(
    "text",
    ["we met at example.com today", "look at this dot matrix", "at one, two or three of them", "one two three four five six seven eight", "1. 2. 3. 4. go", "привет@пример.рф", "He is at home. The dot com boom", "(at) x", "two dot five", "a – b – c 2019–2020"],
)
def test_clean_texts_have_none(text):
    assert personal.search(text) == []


def test_disguise_beside_something_plain():
    t = "a@b.co [dot] uk, me@example.com dot the i"
    assert personal.written(personal.search(t)) == "email:0:6,email:0:15,email:17:31"
    assert personal.hidden(t) == "[EMAIL], [EMAIL] dot the i"


def test_views():
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choices("abcdef", k=30))
        cuts = sorted(rng.sample(range(31), 6))
        view = personal.View(text, [(a, b, rng.choice(["", "X", "YZ"])) for a, b in zip(cuts[::2], cuts[1::2], strict=True)])
        for i, c in enumerate(view.text):
            a, b = view.before((i, i + 1))
            assert text[a:b] == c if c.islower() else (a, b) in [e[:2] for e in view.edits]


def test_linear_time():
    for piece in ("a", "1", "1 ", "1.", "a@", "+1 ", "at ", "one ", "a at b dot ", "[ at ", "а", "@a.b", "1 dot ", "a.b at c.d ", "a@b dot com "):
        took = []
        for n in (20_000, 160_000):
            began = time.process_time()
            personal.search(piece * (n // len(piece)))
            took.append(time.process_time() - began)
        assert took[1] < 14 * max(took[0], 0.02), piece


def test_odd(spark):
    rows = [(1, None), (2, ""), (3, " \n "), (4, "a@b.co é +1 555 010 0100"), (4, "a@b.co é +1 555 010 0100"), (4, "x"), (None, "é 4111 1111 1111 1111"), (5, "no " * 60_000 + "j (at) e.com")]
    docs = spark.createDataFrame([(*r, "x", 7) for r in rows], "doc_id long, text string, personal string, n_chars long")
    found = personal.find(docs).collect()
    assert len(found) == len(rows) and sorted(((r["doc_id"] or 0), len(r["personal"])) for r in found) == [(0, 1), (1, 0), (2, 0), (3, 0), (4, 0), (4, 2), (4, 2), (5, 1)]
    assert next(r["personal"][0]["start"] for r in found if r["doc_id"] == 5) == 180_000
    out = personal.redact(docs)
    assert out.columns == docs.columns and {(r["doc_id"], r["text"]) for r in out.collect() if r["doc_id"] != 5} == {(1, None), (2, ""), (3, " \n "), (4, "[EMAIL] é [PHONE]"), (4, "x"), (None, "é [CARD]")}
    assert personal.find(docs.limit(0)).count() == 0 and personal.redact(docs.limit(0)).count() == 0


def test_query(spark):
    where = "/root/testdata/sf0.001"
    theirs = {r[0]: r[1] for r in spark.read.parquet(f"{where}/documents.parquet").select("doc_id", "text").collect()}
    found = personal.op12_personal_data(spark, where).collect()
    assert len(found) == len(theirs)
    for r in found:
        base = by_patterns(theirs[r["doc_id"]] or "")
        listed = ",".join(f"{personal.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert [r[f"n_{k}"] for k in personal.KINDS] == [sum(x[1] == i for x in base) for i in range(4)]
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest() and r["spans"] == listed and r["n_disguised"] == 0
    assert sum(r["n_email"] for r in found) > 0
