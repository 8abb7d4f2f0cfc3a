"""The dealt operators against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import collections
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import htmltext, langid, mixing, neighbours, ordermin, packing, secrets, similar, simhash, substring, toxicity
from quillspark.llm.htmlpages import made_page

TINY = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 1.0) for r in rows], "doc_id long, text string, score string, rank double")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and blank texts, ties, a repeated row, a long text, and columns whose names operators use."""
    long = " ".join(random.Random(1).choice("alpha beta gamma delta epsilon zeta".split()) for _ in range(40_000))
    return docs_of(spark, [(1, None), (2, ""), (3, " \n\t "), (4, "a b c"), (4, "a b c"), (5, "a b c"), (None, "a b c"), (6, long), (7, "日本語 é ß")])


def words_left(texts, n):
    """doc_id to its text: words left and the number removed, by the definition."""
    first = {}
    for i, t in texts.items():
        w = WORD.findall(t or "")
        for k in range(len(w) - n + 1):
            key = tuple(w[k : k + n])
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, t in texts.items():
        w, gone = WORD.findall(t or ""), set()
        for k in range(len(w) - n + 1):
            if first[tuple(w[k : k + n])] < i:
                gone.update(range(k, k + n))
        out[i] = (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))
    return out


def test_substring_random(spark):
    rng = random.Random(3)
    texts = {i: " ".join(rng.choice("a b c".split()) for _ in range(rng.randrange(60))) for i in range(60)} | {100: None, 101: ""}
    base = " ".join(f"w{k}" for k in range(80))
    texts |= {200 + i: " ".join(x if rng.random() > 0.04 else "changed" for x in base.split()) for i in range(12)}
    found = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substring.remove_repeats(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert found == words_left(texts, 13)


def test_substring_odd(spark, odd):
    found = substring.remove_repeats(odd).collect()
    assert len(found) == 9 and all(r["n_removed"] == 0 for r in found)
    assert substring.remove_repeats(odd.limit(0)).count() == 0


def fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(text)
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    import xxhash

    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(keys, near):
    parent = {k: k for k in keys}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in keys:
        for b in keys:
            if b < a and near(a, b):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {k: root(k) for k in keys}


@pytest.mark.parametrize("largest", [1, 8, 1000])
def test_links(spark, largest):
    rng = random.Random(largest)
    fps = set()
    for _ in range(3):
        seed = rng.getrandbits(63)
        for _ in range(60):
            x = seed
            for _ in range(rng.randrange(5)):
                x ^= 1 << rng.randrange(63)
            fps.add(x)
    found = {r["node"]: r["component"] for r in simhash.components(simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"), 2, largest)).collect()}
    assert {x: found.get(x, x) for x in fps} == components(fps, lambda a, b: (a ^ b).bit_count() <= 2)


def test_simhash(spark, odd):
    rows = simhash.near_duplicates(odd).collect()
    texts = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert collections.Counter((r["doc_id"], r["fp"] % (1 << 64)) for r in rows) == collections.Counter((i, fingerprint(t)) for i, t in texts)
    of = {r["doc_id"]: r["component_id"] for r in rows if r["doc_id"]}
    assert of[1] == of[2] == of[3] == 1 and of[4] == of[5] == 4
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def test_wide_near_duplicates(spark, odd):
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    near = [x if i % 60 else f"new{i}" for i, x in enumerate(base)]  # five changed words: similarity over 0.8
    far = [x if i % 9 else f"far{i}" for i, x in enumerate(base)]
    rows = [(11, " ".join(base)), (12, " ".join(near)), (13, " ".join(far)), (14, " ".join(base))]
    of = {r["doc_id"]: r["component_id"] for r in similar.near_duplicates(docs_of(spark, rows)).collect()}
    assert of == {11: 11, 12: 11, 13: 13, 14: 11}
    assert similar.near_duplicates(odd).count() == 9
    assert similar.near_duplicates(odd.limit(0)).count() == 0


def near_by_sets(texts, size=5, similarity=0.8):
    """doc_id to the smallest doc_id reachable, by all pairs of sets of shingles."""
    sets = {i: {" ".join(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} for i, t in texts.items() if (w := t.split())}
    up = {i: i for i in texts}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            x, y = sets[i], sets[j]
            if min(len(x), len(y)) >= similarity * max(len(x), len(y)) and root(i) != root(j):
                both = len(x & y)
                if both >= similarity * (len(x) + len(y) - both):
                    a, b = sorted((root(i), root(j)))
                    up[b] = a
    return {i: root(i) for i in texts}


def wide_components(spark, texts):
    return {r["doc_id"]: r["component_id"] for r in similar.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}


def test_wide_repeated_lines_count_once(spark):
    line = "home | products | about us | contact"
    own = [[f"d{d}w{k}" for k in range(40)] for d in range(2)]
    base = " ".join(f"w{k}" for k in range(300))
    texts = {1: " ".join(own[0] + [line] * 20), 2: " ".join(own[1] + [line] * 20), 3: base, 4: " ".join([base] + [line] * 10), 5: "one " * 50, 6: "one " * 80}
    wanted = near_by_sets(texts)
    assert wanted == {1: 1, 2: 2, 3: 3, 4: 3, 5: 5, 6: 5}
    assert wide_components(spark, texts) == wanted


def test_wide_large_family(spark):
    """Thousands of texts below the threshold to one another, and among them pairs just above it."""
    rng = random.Random(8)
    base = [f"w{k}" for k in range(60)]
    texts = {}
    for i in range(0, 3000, 2):
        x = list(base)
        for k in rng.sample(range(0, 60, 6), 3):
            x[k] = f"v{rng.randrange(40)}"
        y = list(x)
        y[rng.randrange(60)] = f"n{i}"
        texts[i], texts[i + 1] = " ".join(x), " ".join(y)
    wanted = near_by_sets(texts)
    assert 300 < len(set(wanted.values())) < 2900
    assert wide_components(spark, texts) == wanted


@pytest.mark.parametrize("changed", ["x", "c0 c1 c2 c3 c4"])
def test_wide_loose_family_by_brute_force(spark, changed, monkeypatch):
    """Members are alike by a half to over 0.8: every pair at 0.8 is linked, and the pairs below aren't made."""
    rng = random.Random(11)
    base, by = [f"w{rng.randrange(5000)}" for _ in range(200)], changed.split()
    rows = []
    for i in range(2000):
        x = list(base)
        for p in rng.sample(range(200), rng.choice((6, 6, 6, 6, 5, 7))):
            x[p] = rng.choice(by)
        rows.append((i, " ".join(x)))
    made, cut = {}, similar.cut

    def noted(df, by=None):
        made[by] = cut(df, by)
        return made[by]

    monkeypatch.setattr(similar, "cut", noted)
    found = {r["doc_id"]: r["component_id"] for r in similar.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = [similar.shingle_set(t.encode(), 5) for _, t in rows]
    names = {h: k for k, h in enumerate(np.unique(np.concatenate(sets)))}
    has = np.zeros((len(sets), len(names)), np.float32)
    for i, x in enumerate(sets):
        has[i, [names[h] for h in x]] = 1
    both, sizes = has @ has.T, has.sum(axis=1)
    a, b = np.nonzero(both + 1e-4 >= 0.8 * (sizes[:, None] + sizes - both))
    low = np.arange(len(sets))
    for _ in range(len(sets)):
        new = low.copy()
        np.minimum.at(new, a, low[b])
        if (new == low).all():
            break
        low = new
    assert found == dict(enumerate(low.tolist()))
    assert made["rest-pairs"].count() < 20 * len(rows) if "rest-pairs" in made else True


def test_wide_short_texts(spark):
    texts = {}
    for i in range(0, 60, 2):
        words = [f"t{i}w{k}" for k in range(9)]
        texts[i], texts[i + 1] = " ".join(words[:8]), " ".join(words)
    wanted = near_by_sets(texts)
    assert all(wanted[i] == i - i % 2 for i in texts)
    assert wide_components(spark, texts) == wanted


def test_packing(spark, odd):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.vocabulary())
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(20, "a <|endoftext|> b")], "doc_id long, text string"))
    rows = packing.pack(docs, group_rows=8).collect()
    wanted = collections.Counter()
    for i, x in [(r["doc_id"], r["text"]) for r in docs.collect()]:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 0]
        wanted.update((i, a, len(ids[a : a + 1024]), zlib.crc32(np.array(ids[a : a + 1024], "<u4").tobytes()), len(ids)) for a in range(0, len(ids), 1024))
    assert collections.Counter(tuple(r)[:5] for r in rows) == wanted
    by = collections.defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for x in by.values():
        at = 0
        for offset, n in sorted(x):
            assert offset == at
            at += n
        assert at <= 1024
    assert packing.pack(odd.limit(0)).count() == 0


def test_token_ids_are_the_librarys():
    from tokenizers import Tokenizer

    t, e, rng = Tokenizer.from_file(packing.vocabulary()), packing.Encoder(packing.vocabulary()), random.Random(9)
    some = [*"ab1 '\n\t\r\x0b\x1c\x85\xa0 ​กéß我²½'st<|endoftext|>$\x00́\U0001f600", "<|endoftext|>"]
    for _ in range(3000):
        x = "".join(rng.choice(some) for _ in range(rng.randrange(14)))
        assert np.frombuffer(e.encode([x])[0], "<u4").tolist() == t.encode(x, add_special_tokens=False).ids


def test_token_ids_of_long_runs_and_added_tokens():
    from tokenizers import Tokenizer

    t, e = Tokenizer.from_file(packing.vocabulary()), packing.Encoder(packing.vocabulary())
    n = 1_600_000
    for x in ("a" + " " * n + "b", "a" + "\n" * n, "x <|endoftext|><|endoftext|> y", "<|endoftext|>", "<|endoftext", "a " * (1 << 16), " " * ((1 << 16) - 1)):
        assert np.frombuffer(e.encode([x])[0], "<u4").tolist() == t.encode(x, add_special_tokens=False).ids


def test_first_fit_decreasing():
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 101, 300)
    bins, offsets = packing.first_fit_decreasing(lengths, 100)
    left, at = [], {}
    for i in np.argsort(-lengths, kind="stable"):
        b = next((k for k, x in enumerate(left) if x >= lengths[i]), None)
        if b is None:
            b = len(left)
            left.append(100)
        assert (bins[i], offsets[i]) == (b, at.get(b, 0))
        left[b] -= lengths[i]
        at[b] = at.get(b, 0) + lengths[i]


def test_order_min_hash(spark, odd):
    rows = ordermin.edited_likeness(odd).collect()
    assert len(rows) == 9
    texts = sorted([(r["doc_id"] if r["doc_id"] is not None else -(1 << 63), r["text"] or "") for r in odd.collect()])
    assert sorted(r["n_chars"] for r in rows) == sorted(len(t) for _, t in texts)
    last = next(r for r in rows if r["doc_id"] == 7)  # its next is the first
    half = len("日本語 é ß") // 2
    assert last["edited_sha256"] == hashlib.sha256(("日本語 é ß"[: 7 - half + (len("日本語 é ß") - 7)] + "a b c"[:half]).encode()).hexdigest()
    f = ordermin.Fingerprinter()
    a = "one two three four five six seven eight nine ten"
    assert (f(a) == f(a)).all() and ordermin.likeness(f(a), f(a + " eleven")) > ordermin.likeness(f(a), f(" ".join(reversed(a.split()))))
    assert ordermin.edited_likeness(odd.limit(0)).count() == 0
    assert {r["doc_id"] for r in ordermin.fingerprints(odd).collect()} == {None, 1, 2, 3, 4, 5, 6, 7}


def brute_order_min_hash(text, sketches=64, k=2, size=2):
    """Components by the definition, over lists, with the operator's hashes of words and orders."""
    f = ordermin.Fingerprinter(sketches, k, size)
    words = [x.encode() for x in re.findall(rf"[{ordermin.ALONE}]|[^\x20\x09-\x0D{ordermin.ALONE}]+", text)]
    h = ordermin.hashed(words, f.cache).tolist()
    if not h:
        return [0] * sketches
    one = lambda x: int(ordermin.mix(np.array([x % (1 << 64)], np.uint64))[0])
    n = min(k, len(h))
    kmers = [int(ordermin.Prefix(np.array(h[i : i + n], np.uint64)).windows(n)[0]) for i in range(len(h) - n + 1)]
    seen, numbered = collections.Counter(), []
    for x in kmers:
        numbered.append(one(x + seen[x] * 0xD6E8FEB86659FD93))
        seen[x] += 1
    out = []
    for xor, odd_ in zip(f.xors[:, 0].tolist(), f.odds[:, 0].tolist(), strict=True):
        places = sorted(sorted(range(len(kmers)), key=lambda i: ((numbered[i] ^ xor) * odd_ % (1 << 64), i))[:size])
        total = 0
        for i in places:
            total = one(total * 0xA24BAED4963EE407 + kmers[i])
        out.append(total >> 32)
    return out


def test_order_min_hash_by_brute_force(spark):
    rng = random.Random(12)
    texts = ["", " ", "one", "one two", "a a a a a a", "日本語 text 中", "коричневая быстрая лиса"] + [" ".join(rng.choice("a b c d e f".split()) for _ in range(rng.randrange(1, 60))) for _ in range(25)]
    rows = list(enumerate(texts, 1)) + [(100, None)]
    found = {r["doc_id"]: r for r in ordermin.edited_likeness(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        text, after, r = text or "", after or "", found[i]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        own, changed, next_ = (brute_order_min_hash(x) for x in (text, edited, after))
        hexed = [np.array(x, np.uint32).tobytes().hex() for x in (own, changed)]
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest(), *hexed)
        assert r["near_edited"] == np.mean(np.array(own) == changed) and r["near_next"] == np.mean(np.array(own) == next_)


def test_order_min_hash_units():
    assert ordermin.units("коричневая быстрая") == [w.encode() for w in ("коричневая", "быстрая")]
    assert ordermin.units("the extraordinarily-long-word-of-many-letters x") == [b"the", b"extraordinarily-long-word-of-many-letters", b"x"]
    assert ordermin.units("新しい word") == [c.encode() for c in "新しい"] + [b"word"]


def test_next_documents_of_one_id(spark):
    """A third of the rows have no doc_id, others share one: each has the next by doc_id and text hash, in a ring."""
    rows = [(None if i % 3 == 0 else 5 if i % 3 == 1 else i, f"text {i}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    out = ordermin.with_next(docs, lambda i, a, b: (i, a, b), "doc_id long, text string, after string").collect()
    after = {r["text"]: r["after"] for r in out}
    assert len(out) == 3000 and sorted(after.values()) == sorted(after)
    of, at, seen = {t: i for i, t in rows}, "text 0", []
    for _ in range(3000):
        seen.append(at)
        at = after[at]
    assert at == "text 0" and len(set(seen)) == 3000
    key = [-1 if of[t] is None else of[t] for t in seen]
    turn = next((i for i in range(3000) if key[i] == -1 and key[i - 1] != -1), 0)
    assert key[turn:] + key[:turn] == sorted(key)


def segments(scores):
    """All maximal-scoring segments by recursion."""
    best, at = 0.0, None
    for i in range(len(scores)):
        for j in range(i + 1, len(scores) + 1):
            s = sum(scores[i:j])
            if s > best + 1e-12:
                best, at = s, (i, j)
    if at is None:
        return []
    return [(i, j, s) for i, j, s in segments(scores[: at[0]])] + [(*at, best)] + [(i + at[1], j + at[1], s) for i, j, s in segments(scores[at[1] :])]


def test_maximal_segments():
    rng = random.Random(4)
    for _ in range(60):
        scores = [rng.uniform(0.1, 4.0) if rng.random() < 0.2 else -0.7 for _ in range(25)]  # no ties
        found = toxicity.maximal_segments(np.array([i for i, s in enumerate(scores) if s > 0], int), np.array([max(s, 0) for s in scores]), 0.7)
        assert [(a, b) for a, b, _ in found] == [(a, b) for a, b, _ in segments(scores)]
        assert np.allclose([s for *_, s in found], [s for *_, s in segments(scores)])


def test_maximal_segments_take_linear_time():
    def seconds(n, gap):
        hits = np.arange(0, n * gap, gap)
        scores = np.zeros(n * gap)
        scores[hits] = 1.0
        start = time.perf_counter()
        found = toxicity.maximal_segments(hits, scores, 0.05)
        assert len(found) == (n if gap > 20 else 1)
        return time.perf_counter() - start

    assert seconds(100_000, 40) < 1 and seconds(100_000, 2) < 1


def test_significant_passages():
    found = [(0, 5, 20.0), (100, 101, 1.0), (200, 203, 9.0)]
    for chance in (0.001, 0.05, 0.5):
        assert toxicity.significant(found, 1000, 0.9, chance) == [x for x in found if 1 - math.exp(-1000 * math.exp(-0.9 * x[2])) <= chance]
    assert toxicity.significant([], 0, 1.0) == []


def test_score_by_brute_force():
    """Evidence, segments, the sum statistic over the best r of them and the curve, each by its definition over lists."""
    model = toxicity.Model({"vile": 2.5, "nast*": 1.5, "rott*": 0.7}, drift=0.3, rate=1.2, curve=(-2.0, 1.5, -0.2))
    rng = random.Random(7)
    for _ in range(80):
        words = [rng.choice(["plain", "Vile!", "nasty", "nastier,", "rotten", "word", "vileness", "..."]) if rng.random() < 0.4 else "other" for _ in range(rng.randrange(25))]
        values = []
        for w in words:
            bare = w.lower().strip("!,.")
            values.append(max([model.weights.get(bare, 0.0), *(model.weights.get(f"{bare[:n]}*", 0.0) for n in toxicity.PREFIXES if len(bare) > n)]))
        found = segments([v if v > 0 else -0.3 for v in values])
        n, best = len(words), 0.0
        ordered = sorted((s for *_, s in found), reverse=True)
        for r in range(1, len(ordered) + 1):
            total = sum(1.2 * s - math.log(n) for s in ordered[:r])
            if total <= 0:
                break
            best = max(best, total - (r - 1) * math.log(total) + math.log(math.factorial(r)) + math.log(math.factorial(r - 1)))
        best = max(best, 1.2 * max(ordered, default=0.0) / (1 + math.log(n or 1)))
        got_n, nats, passages = toxicity.Scorer(model)(" ".join(words))
        assert got_n == n and nats == pytest.approx(best)
        assert [x[:2] for x in passages] == [x[:2] for x in found if 1 - math.exp(-n * math.exp(-1.2 * x[2])) <= 0.05 + 1e-12]
        z = -2.0 + 1.5 * math.log1p(best) - (0.2 * math.log1p(n) if best > 0 else 0.0)
        assert toxicity.Scorer(model).probability(n, nats) == pytest.approx(1 / (1 + math.exp(-z)))


def test_toxicity_keeps_columns_of_its_names(spark):
    docs = spark.createDataFrame([(1, "a b", 7.0, "mine", 3)], "doc_id long, text string, toxicity double, passages string, `odd name.` int")
    model = toxicity.Model({"vile": 3.0})
    row = toxicity.score(docs, model, "tox", "where").first()
    assert (row["toxicity"], row["passages"], row["odd name."]) == (7.0, "mine", 3) and row["tox"] < 0.5 and row["where"] == []
    assert toxicity.score(docs, model).columns == ["doc_id", "text", "odd name.", "toxicity", "passages"]


def test_toxicity(spark, odd):
    rng = random.Random(6)
    plain = [f"word{i}" for i in range(300)]
    rows = []
    for i in range(400):
        w = rng.choices(plain, k=rng.randrange(20, 80))
        if i % 4 == 0:
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(["vile", "nasty!", "Rotten"]))
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(0, 400) if i % 5], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    scored = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    held = [i for i in range(400) if i % 5 == 0]
    assert np.mean([(scored[i]["toxicity"] >= 0.5) == (i % 4 == 0) for i in held]) >= 0.97
    out = toxicity.score(odd, model)
    assert out.columns == [*odd.columns, "toxicity", "passages"] and all(0 <= r["toxicity"] <= 1 for r in out.collect())
    assert toxicity.score(odd.limit(0), model).count() == 0
    none = toxicity.fit(docs, labels.limit(0))
    assert not none.weights and toxicity.score(odd, none).count() == 9


def kneser_ney(texts, order, alphabet):
    """Probability of a character after a context, by the definition."""
    seqs = [" " * (order - 1) + t for t in texts]
    grams = {order: collections.Counter(s[i : i + order] for s in seqs for i in range(len(s) - order + 1))}
    for n in range(order - 1, 0, -1):
        grams[n] = collections.Counter(g[1:] for g in grams[n + 1])

    def p(context, c):
        n = len(context) + 1
        below = 1 / alphabet if n == 1 else p(context[1:], c)
        once, twice = (sum(v == k for v in grams[n].values()) for k in (1, 2))
        d = once / (once + 2 * twice) if once and twice else 0.5
        own = {g: v for g, v in grams[n].items() if g[:-1] == context}
        if not own:
            return below
        total = sum(own.values())
        return max(own.get(context + c, 0) - d, 0) / total + d * len(own) / total * below

    return p


def test_kneser_ney():
    texts = {"x": ["abc abd aab", "bca abc"], "y": ["dda dad", "aad"]}
    model = langid.train(texts, 3)
    letters = len(model.alphabet.letters) + 2
    for j, language in enumerate(model.languages):
        p = kneser_ney(texts[language], 3, letters)
        for text in ("abcd", "dab da", "q"):
            seq = langid._sequence(model.alphabet.numbers(text), 3)
            got = model.scored(seq)[:, j]
            padded = "  " + text
            assert np.allclose(np.exp(got), [p(padded[i : i + 2].replace("q", "?"), padded[i + 2].replace("q", "?")) for i in range(len(text))], rtol=1e-4)


def test_language_of_long_texts(monkeypatch):
    """In pieces of any length a text has the scores of the whole."""
    model = langid.train({"x": ["abc abd aab", "bca abc"], "y": ["dda dad", "aad"]}, 4)
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcd   .") for _ in range(n)) for n in (1, 5, 300, 1000)] + ["... ..", "", None, "  a", "a. b"]
    whole, has = model.entropies(texts)
    for i, t in enumerate(texts):
        if t and any(c.isalpha() for c in t):
            scores = model.scored(langid._sequence(model.alphabet.numbers(t), 4))
            assert has[i] and np.allclose(whole[i], -scores.mean(axis=0, dtype=float))
        else:
            assert not has[i] and np.isinf(whole[i]).all()
    for piece in (1, 2, 3, 7, 64):
        monkeypatch.setattr(langid, "_PIECE", piece)
        assert np.allclose(model.entropies(texts)[0], whole)


def test_language_sample_is_bounded(spark, monkeypatch):
    train = langid.train
    docs = spark.createDataFrame([(i, "abc de " * 100 + str(i), "x") for i in range(200)], "doc_id long, text string, lang string")
    assert langid.fit(docs, each=100, most_chars=1500).languages == ["x"]
    seen, calibrate = [], langid.calibrate
    monkeypatch.setattr(langid, "train", lambda texts, order: seen.append(texts) or train(texts, order))
    monkeypatch.setattr(langid, "calibrate", lambda model, texts: seen.append(texts) or calibrate(model, texts))
    long = spark.createDataFrame([(i, "word " * 50_000 + str(i), "x") for i in range(3)], "doc_id long, text string, lang string")
    langid.fit(long, each=100, most_chars=1500)
    assert all(sum(map(len, t.get("x", []))) <= 1500 for t in seen) and any(t for t in seen)


def test_language_of_many_letters():
    """Two languages of 8000 letters each: the rarest of them tell as well as frequent ones."""
    rng = random.Random(2)
    own = [[chr(0x4E00 + i) for i in range(8000)], [chr(0xAC00 + i) for i in range(8000)]]
    texts = {n: ["".join(x) + "".join(rng.choices(x[:50], k=3000))] for n, x in zip("ab", own, strict=True)}
    model = langid.train(texts, 4)
    assert len(model.alphabet.letters) == 16_000
    h, has = model.entropies(["".join(own[0][7000:7040]), "".join(own[1][7000:7040])])
    assert has.all() and h.argmin(axis=1).tolist() == [0, 1]


def test_language(spark, odd):
    docs = spark.read.parquet(f"{TINY}/documents.parquet").select("doc_id", "text", "lang")
    model = langid.fit(docs.where("doc_id % 2 = 0"), each=40)
    found = langid.identify(docs.where("doc_id % 2 = 1"), model).join(docs, "doc_id")
    assert found.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("double"))).first()[0] >= 0.95
    rows = {(r["doc_id"], r["lang_pred"], r["score"]) for r in langid.identify(odd, model).where("doc_id < 4").collect()}
    assert rows == {(1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0)}
    assert langid.identify(odd.limit(0), model).count() == 0
    assert {r["lang_pred"] for r in langid.identify(odd, langid.fit(docs.limit(0))).collect()} == {"und"}


def test_secrets(spark, odd):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    texts = [(1, "token=token :=abcdef Secret = 'hunter22' é " + "AKIA" + "A" * 20 + " " + "0" * 24), (2, "ghp_16C7e42F292c6912E7710c838347Ae178B4a get_user_account_information"), (3, "token=abc")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").unionByName(odd.select("doc_id", "text").where("doc_id is not null").withColumn("doc_id", F.col("doc_id") + 100))
    model = secrets.fit(secrets.samples(spark.read.parquet(f"{TINY}/documents.parquet")))
    found = {r["doc_id"]: r["w"] for r in secrets.find(docs, model).select("doc_id", secrets.written(F.col("secrets")).alias("w")).collect()}
    for i, t in texts:
        base = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 6] + [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        assert [x for x in found[i].split(",") if x and not x.startswith("markov")] == [f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(base)]
    assert found[2].startswith("markov:0:40") and found[3] == "" and found[101] == ""
    out = secrets.redact(docs, model)
    assert out.columns == docs.columns and "hunter22" not in "".join(r["text"] or "" for r in out.collect())
    assert secrets.find(odd.limit(0), model).count() == 0


def test_secret_ratio_by_brute_force(spark):
    labelled = spark.createDataFrame([("a1b2c3d4", 1), ("ZX9Y8W", 1), ("hello", 0), ("world_wide", 0), ("x", 0)], "word string, random int")
    model = secrets.fit(labelled)
    n, code = len(secrets.SYMBOLS) + 1, lambda c: secrets.SYMBOLS.find(c) + 1
    counts = np.full((2, n, n), 0.5)
    for r in labelled.collect():
        for a, b in zip(r["word"], r["word"][1:], strict=False):
            counts[r["random"], code(a), code(b)] += 1
    p = np.log(counts / counts.sum(axis=2, keepdims=True))
    assert np.allclose(np.array(model).reshape(n, n), p[1] - p[0])
    words = ["hello", "a1b2", "ZX9é", "q", ""]
    got = spark.createDataFrame([(w,) for w in words], "word string").select(secrets.ratio(F.col("word"), model)).collect()
    assert np.allclose([r[0] for r in got], [sum((p[1] - p[0])[code(a), code(b)] for a, b in zip(w, w[1:], strict=False)) for w in words], atol=1e-4)


def test_secrets_by_brute_force(spark):
    """All spans, and the redacted text, by the definitions over whole strings; many matches in a text, and texts of several blocks."""
    model = secrets.fit(secrets.samples(spark.read.parquet(f"{TINY}/documents.parquet")))
    table_ = np.array(model).reshape(len(secrets.SYMBOLS) + 1, -1)
    code = lambda c: secrets.SYMBOLS.find(c) + 1
    rng = random.Random(5)
    alphabet = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    made = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    parts = ["word", "é日", "token=", "password: 'hunter22'", "AKIA" + "B7" * 8, "0" * 24, "deadbeef" * 4, "=", " ", "\n", "api_key=abc", "2024-05-06", "12345678"]
    texts = ["".join(rng.choice([*parts, " ", " ", made(12), made(25)]) for _ in range(rng.randrange(40))) for _ in range(60)]
    texts += [" ".join(rng.choice(parts) + rng.choice(["", " ", made(30)]) for _ in range(3000)), "x" * 5000 + " token=abcdef9 " + "y" * 9000, None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: [tuple(x) for x in r["secrets"]] for r in secrets.find(docs, model).collect()}
    redacted = {r["doc_id"]: r["text"] for r in secrets.redact(docs, model).collect()}
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    n_markov = 0
    for i, t in enumerate(texts):
        t0, t = t, t or ""
        base = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 6] + [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        more = []
        for m in re.finditer(f"{secrets.CANDIDATE}+", t):
            c = list(map(code, m[0]))
            if sum(round(table_[a, b], 6) for a, b in zip(c, c[1:], strict=False)) >= 12 and not any(a < m.end() and m.start() < e for a, _, e in base):
                more.append((m.start(), 3, m.end()))
        n_markov += len(more)
        assert found[i] == sorted(base + more)
        out, at = [], 0
        for a, _, e in found[i]:
            if a >= at:
                out += [t[at:a], "[SECRET]"]
            at = max(at, e)
        assert redacted[i] == (None if t0 is None else "".join([*out, t[at:]]))
    assert n_markov > 100


def test_secrets_keep_a_column_of_that_name(spark):
    docs = spark.createDataFrame([(1, "token=abcdef99", "mine", 2)], "doc_id long, text string, secrets string, secrets_ int")
    row = secrets.redact(docs, [0.0] * (len(secrets.SYMBOLS) + 1) ** 2).first()
    assert tuple(row) == (1, "[SECRET]", "mine", 2)


def test_targets_of_many_sources(spark):
    rng = random.Random(3)
    sizes = {f"s{rng.getrandbits(40):x}": rng.choice([0, 1, 10, 1000, 10**6]) for _ in range(700)} | {None: 50}
    names = [*sorted(x for x in sizes if x), None]
    weights = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    full: set = set()
    while True:
        unit = (sum(sizes.values()) - sum(3 * sizes[n] for n in full)) / sum(weights[n] for n in names if n not in full)
        over = {n for n in names if n not in full and weights[n] * unit > 3 * sizes[n]}
        if not over:
            break
        full |= over
    found = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    assert found == {n: pytest.approx(min(3 * sizes[n], weights[n] * unit)) for n in names}


def test_mixing_tilts_documents(spark):
    """The rates are those of the dual's solution: exp(lambda * size / mean) up to the cap, with the target reached; reached too where all documents must be at the cap."""
    rng = random.Random(4)
    rows = [(i, "w " * int(rng.paretovariate(1.2) * 5), "abc"[min(2, int(rng.expovariate(1)))]) for i in range(900)]
    df = spark.createDataFrame([(*r, 1, "x", 0.0, 2) for r in rows], "doc_id long, text string, source string, size int, of string, rate double, copies int")
    out = mixing.mix(df).collect()
    for s in "abc":
        own = [r for r in out if r["source"] == s and r["size"]]
        mean = own[0]["source_size"] / sum(r["source"] == s for r in out)
        assert sum(r["rate"] * r["size"] for r in own) == pytest.approx(own[0]["target"], rel=1e-6)
        slope = [math.log(r["rate"]) * mean / r["size"] for r in own if 1e-6 < r["rate"] < 2.999]
        assert np.allclose(slope, np.median(slope), rtol=1e-4) if slope else all(r["rate"] > 2.999 for r in own)
        assert sum(r["taken"] for r in own) == pytest.approx(own[0]["target"], rel=0.01)


def test_mixing(spark):
    rng = random.Random(8)
    rows = [(i, " ".join("w" for _ in range(rng.randrange(1, 200))), rng.choice(["a", "b", "b", "b", "b", "c", None])) for i in range(600)] + [(900, None, "a"), (901, "", "d"), (3, "dup dup", "a"), (3, "dup dup", "a"), (None, "no id", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(df).collect()
    assert len(out) == len(rows) and all(0 <= r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"] for r in out)
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    names = [*sorted(x for x in sizes if x), None]
    weights, target, capped = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}, {}, set()
    while True:
        free = [n for n in names if n not in capped]
        unit = (sum(sizes.values()) - sum(3 * sizes[n] for n in capped)) / sum(weights[n] for n in free)
        over = {n for n in free if weights[n] * unit > 3 * sizes[n]}
        if not over:
            break
        capped |= over
    target = {n: 3 * sizes[n] if n in capped else weights[n] * unit for n in names}
    taken = collections.Counter()
    for r in out:
        assert r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == sizes[r["source"]]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[n] - target[n]) <= max(2, 0.005 * target[n]) for n in names)
    assert sorted(map(repr, mixing.mix(df.repartition(3)).collect())) == sorted(map(repr, out))
    assert mixing.mix(df.limit(0)).count() == 0
    tilted = mixing.mix(df, prior="documents").groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r["taken"] - r["target"]) <= max(2, 0.02 * r["target"]) for r in tilted)


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((20, 16))
    x = centres[rng.integers(0, 20, 3000)] + 0.3 * rng.standard_normal((3000, 16))
    x[1000:1200] = x[0]  # one common vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] * 16), (5003, [None] * 16)]
    v = neighbours.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert v.count() == 3000
    out = collections.defaultdict(list)
    for r in neighbours.search(v, v.where("vec_id % 20 = 0"), 10, 64, part_rows=200).orderBy("query_id", "rank").collect():
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    hit = total = 0
    for q in range(0, 3000, 20):
        s = (x[q] * x).sum(axis=1)
        wanted = [i for i in np.lexsort((np.arange(3000), -s)) if i != q][:10]
        hit += len(set(wanted) & {i for i, _ in out[q]})
        total += 10
        assert [i for i, _ in out[q]] == [i for i, _ in sorted(out[q], key=lambda t: (-t[1], t[0]))] and all(abs(s[i] - y) < 1e-9 for i, y in out[q])
    assert hit / total >= 0.9
    router = neighbours.fit(v, 3000, part_rows=200)
    assert router.parts == 16 and router.probes <= router.parts // 2  # clustered vectors need few of the parts
    few = v.where("vec_id < 5")
    assert neighbours.search(few, few.where("vec_id = 0")).count() == 4
    assert neighbours.search(few.limit(0), few.limit(0)).count() == 0


def test_neighbours_odd(spark):
    """Lengths that differ, ties, repeated ids, and queries whose parts hold too few."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((600, 8))
    x[300:] = 0.01 * x[300:] + np.repeat(np.eye(8)[:6] * 40, 50, axis=0)  # six far clusters of 50
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(700, [1.0, 2.0]), (701, [1.0] * 9), (3, x[3].tolist()), (3, x[4].tolist()), (720, x[300].tolist()), (721, x[300].tolist())]
    v = neighbours.usable(spark.createDataFrame([(*r, "q", 1) for r in rows], "vec_id long, embedding array<double>, part string, block int"))
    assert v.count() == 606
    found = collections.defaultdict(list)
    for r in neighbours.search(v, v.where("vec_id % 20 = 0 or vec_id = 3"), 200, 64, part_rows=40, each=8, aim=0.5).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(found) == {i for i, e in rows if len(e) == 8 and (i % 20 == 0 or i == 3)}
    for i, got in found.items():
        assert [r for r, *_ in got] == list(range(1, 201)) and all(a[2] >= b[2] for a, b in zip(got, got[1:], strict=False)) and i not in {j for _, j, _ in got}
        assert all(a[1] <= b[1] for a, b in zip(got, got[1:], strict=False) if a[2] == b[2])
    assert {j for _, j, _ in found[300]} >= {720, 721}


@pytest.fixture(scope="module")
def labeller():
    return htmltext.default_labeller()


def test_blocks():
    page = "<html><head><title>t</title></head><body><p>a <b>b<br>c</b>\n d<p>e &amp; f<script>x</p></script><ul><li>g<li>h</ul><!-- i -->j<div hidden>k</div><a href='x>y'>l</a>"
    assert [b.text for b in htmltext.blocks(page)] == ["a b c d", "e & f", "g", "h", "jl"]
    assert htmltext.blocks("") == [] and [b.text for b in htmltext.blocks("a < b <3 <")] == ["a < b <3 <"]


def test_blocks_hide_only_what_is_hidden():
    of = lambda page: [b.text for b in htmltext.blocks(page)]
    assert of('<div style="overflow:hidden"><p>a <a href="/hidden/valley" title="Hidden gems">b</a></p></div><p style="overflow-x: hidden">c</p>') == ["a b", "c"]
    assert of('<p>a</p><div HIDDEN>b</div><div hidden="">c</div><p style="color:red; visibility: hidden">d</p><p style="Display:none">e</p><p hidden="until-found">f</p><p data-x="hidden">g</p>') == ["a", "f", "g"]
    for tag in ("noscript", "object", "video", "iframe", "template", "textarea"):
        assert of(f"<body><div><p>a</p><{tag}>x<b>y</b></div><p>b</p></body>") == ["a", "b"]


@pytest.mark.parametrize(
    "part", ["<div>x", '<a "', "<a ", "<div hidden>", "<noscript>a", "<![CDATA[a", "<!--", "<li>x", "<b>x", """<a '\"""", "<", "<div", "<span> ", "<p class='c'>x</span>", "<x y=\"'>", "&amp", "<script>", "</p>"]
)
def test_blocks_take_linear_time(part):
    start = time.process_time()
    htmltext.blocks("<p>a</p>" + part * 200_000 + "<p>b>")
    assert time.process_time() - start < 5


def test_long_page(labeller):
    page = "<article>" + "<p>Some words of a long article, in order.</p>" * 20_000 + "</article>"
    blocks = htmltext.blocks(page)
    assert len(blocks) == 20_000
    assert np.allclose(labeller.of_blocks([blocks])[0], labeller.probabilities([htmltext.vectors(blocks, labeller.known)])[0], atol=1e-4)


def test_labeller(labeller):
    rng = np.random.default_rng(99)
    pages = [made_page(rng) for _ in range(200)]
    cut = [htmltext.blocks(p) for p, _ in pages]
    assert all(len(b) == len(y) for b, (_, y) in zip(cut, pages, strict=True))
    found = labeller.probabilities([htmltext.vectors(b, labeller.known) for b in cut])
    assert np.mean(np.concatenate([(p >= 0.5) == np.array(y, bool) for p, (_, y) in zip(found, pages, strict=True)])) >= 0.99


def test_gradients():
    rng = np.random.default_rng(0)
    hidden = 3
    w = {"b": rng.standard_normal(1)} | {d + k: rng.standard_normal(s) * 0.3 for d in "fr" for k, s in (("w", (htmltext.SIZE, 4 * hidden)), ("b", 4 * hidden), ("u", (hidden, 4 * hidden)), ("o", (hidden, 1)))}
    x, mask, y = rng.standard_normal((4, 2, htmltext.SIZE)) * 0.1, np.ones((4, 2, 1)), rng.integers(0, 2, (4, 2))
    mask[3, 1] = 0

    def loss():
        p = htmltext._forward(w, x, mask)[0].astype(float)
        return -(mask[:, :, 0] * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum()

    p, seen = htmltext._forward(w, x, mask)
    grad = htmltext._backward(w, x, mask, (p - y) * mask[:, :, 0], seen)
    for k in ("fu", "ro", "fb", "ru"):
        i = tuple(0 for _ in w[k].shape)
        held = w[k][i]
        w[k][i] = held + 1e-2
        up = loss()
        w[k][i] = held - 1e-2
        down = loss()
        w[k][i] = held
        assert grad[k][i] == pytest.approx((up - down) / 2e-2, rel=0.05, abs=2e-3)


def test_extraction(spark, labeller):
    rows = [(1, "u", None), (2, "u", ""), (2, "u", ""), (None, None, "<p>only text"), (3, None, "<p>only text"), (4, "u", "<nav><ul><li><a href='/x'>Home</a></li></ul></nav><article><h1>Title</h1><p>Text  of\nit &eacute;.</p></article><footer>&copy; us</footer>")]
    out = {r["page_id"]: r for r in htmltext.extract(spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, text string"), labeller).collect()}
    assert out[1]["text"] == out[2]["text"] == "" and out[4]["text"] == "Title\nText of it é." and out[4]["n_chars"] == len(out[4]["text"])
    pages = spark.read.parquet(f"{TINY}/pages.parquet")
    assert htmltext.extract(pages, labeller).where("n_chars > 0").count() >= 0.9 * pages.count()
    assert htmltext.extract(pages.limit(0), labeller).count() == 0
