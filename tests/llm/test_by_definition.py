"""Operators without SQL against plain versions written from their definitions."""

import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tickvet.llm import bestfit, ftrl, importance, oph, simhash
from tickvet.llm.queries import BPE_FILE, vocabulary

VOCAB = "alpha beta gamma delta omega river stone cloud forest winter summer letter window garden silver golden".split()
MASK = (1 << 64) - 1


def words(rng, n):
    return " ".join(rng.choice(VOCAB) + rng.choice(["", "s", "ly", "er"]) for _ in range(n))


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text.translate({i: i + 32 for i in range(65, 91)}))


def shingles(text, w):
    found = split(text)
    return [" ".join(found[i : i + w]) for i in range(max(1, len(found) - w + 1))] if found else []


def test_importance_weights(spark):
    rng, dim = random.Random(3), 97
    rows = [(i, words(rng, rng.randint(0, 30)) if i % 9 else None) for i in range(60)]
    docs = spark.createDataFrame([*rows, (None, "alpha beta")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)] + [(None, 1), (7, None)], "doc_id long, quality int")
    one = lambda text: importance._features(pa.RecordBatch.from_pydict({"text": [text]}), dim)[0].tolist()

    def grams(text):  # buckets of single words and of neighbouring pairs
        w = (text or "").lower().split()
        return Counter([one(x)[0] for x in w] + [one(f"{x} {y}")[2] for x, y in zip(w, w[1:], strict=False)])

    raw = sum((grams(t) for _, t in [*rows, (None, "alpha beta")]), Counter())
    target = sum((grams(t) for i, t in rows if i % 3 == 0), Counter())
    ratio = [math.log((target[b] + 1) / (target.total() + dim)) - math.log((raw[b] + 1) / (raw.total() + dim)) for b in range(dim)]
    assert np.allclose(importance.fit(docs, labels, dim), ratio)
    got = importance.resample(docs, labels, fraction=0.5, dim=dim).collect()
    for r in got:
        want = grams("alpha beta" if r.doc_id is None else rows[r.doc_id][1])
        assert r.n_features == want.total() and abs(r.log_weight - sum(n * ratio[b] for b, n in want.items())) < 1e-9
    assert sum(r.selected for r in got) == 31
    noise = np.array([r.gumbel_key - r.log_weight for r in importance.score(spark.range(4000).selectExpr("id doc_id", "'' text"), np.zeros(dim)).collect()])
    assert abs(noise.mean() - 0.5772) < 0.08 and abs(noise.var() - math.pi**2 / 6) < 0.2  # a standard Gumbel's


def test_ftrl_updates():
    rng, alpha, beta, l1, l2 = random.Random(5), 0.7, 1.3, 0.4, 0.2
    model, z, n = ftrl.Ftrl(20, alpha, beta, l1, l2), defaultdict(float), defaultdict(float)
    for _ in range(300):
        at, y = sorted(rng.sample(range(20), 4)), rng.randint(0, 1)
        w = {i: 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2) for i in [0, *(a + 1 for a in at)]}
        g = 1 / (1 + math.exp(-sum(w.values()))) - y
        for i, x in w.items():
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * x
            n[i] += g * g
        model.learn(np.array([0, *(a + 1 for a in at)]), y)
    assert np.allclose(model.z, [z[i] for i in range(21)]) and np.allclose(model.n, [n[i] for i in range(21)])
    assert (model.weights() == 0).any() and (model.weights() != 0).any()


def test_toxicity_features():
    texts = ["the bad the bad word", "", None, "one", "a, b"]
    bucket, row = ftrl.features(pa.array(texts), 1 << 40)
    for i, t in enumerate(texts):
        w = re.findall(r"[^\W_]+|[^\w\s]", (t or "").lower())
        want = Counter(w) + Counter(zip(w, w[1:], strict=False)) + Counter((x, None, y) for x, y in zip(w, w[2:], strict=False))
        got = Counter(bucket[row == i].tolist())
        assert sorted(got.values()) == sorted(want.values())


def test_simhash_fingerprint():
    rng = random.Random(6)
    texts = ["", None, " \t\n", "One", "one TWO", "a b c", "ÄÖÜ ünï ÇA va\x0bbien", *(words(rng, rng.randint(3, 200)).title() for _ in range(40)), "x " * 500]
    for t in texts:
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles(t or "", 3)]
        want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))
        assert simhash.simhash(t) == want


def mix(x):
    x = (x ^ x >> 33) * 0xFF51AFD7ED558CCD & MASK
    x = (x ^ x >> 33) * 0xC4CEB9FE1A85EC53 & MASK
    return x ^ x >> 33


def test_minhash_bins_and_packing():
    rng, bins, bits = random.Random(7), 16, 4
    printer = oph.Fingerprinter(bins, bits, 5)
    texts = ["", "a", "a b c d e f", *(words(rng, n) for n in (4, 5, 9, 14, 60, 200))]
    values, some = printer.values([t.encode() for t in texts])
    for t, got, has, packed in zip(texts, values.tolist(), some, printer.packed(values), strict=True):
        found = shingles(t, 5)
        assert has == bool(found)
        h, row = oph.word_hashes(*oph.joined_bytes([t.encode()]), punctuation=False)
        hashed = [int(x) for x in oph.word_shingles(h, row, 1, 5)[0]]
        assert len(hashed) == len(found) and len(set(hashed)) == len(set(found))
        least = {}
        for x in hashed:
            b = x >> 60
            least[b] = min(least.get(b, MASK), x & (1 << 60) - 1)
        want = []
        for b in range(bins if found else 0):
            at, step = b, 0
            while at not in least and len(least) > 1:  # the bin's own sequence of bins
                step += 1
                at = mix(b * 0x10001 + (step << 32) & MASK) % bins
            low = least.get(at, min(least.values()))
            want.append(mix(low ^ mix(b)) & 15)
        want = want or [0] * bins
        assert got == want and packed == bytes(want[i] | want[i + 1] << 4 for i in range(0, bins, 2)).hex()
    a = np.array([[1, 2, 3, 4] * 4])
    yes = np.array([True])
    assert printer.likeness(a, yes, a, yes)[0] == 1 and printer.likeness(a, yes, np.where(np.arange(16) < 8, a, a + 1), yes)[0] == pytest.approx((0.5 - 1 / 16) / (1 - 1 / 16))


def test_minhash_edits(spark):
    rows = [(5, "abcdefgh"), (2, "ünïcødé text of some length"), (9, None), (11, "wxyz"), (30, "x" * 101), (31, "")]
    got = {r.doc_id: r for r in oph.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    order = sorted((i, t or "") for i, t in rows)
    for k, (i, t) in enumerate(order):
        after, m = order[(k + 1) % len(order)][1], len(t) // 4
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256((t[: len(t) - m] + after[:m]).encode()).hexdigest()


def test_packing_order_and_hot_ids(spark):
    rng, size = random.Random(8), 64
    lengths = [rng.randint(1, size) for _ in range(500)]
    packer, free = bestfit.Packer(size, open_bins=7), {}
    at = bins = 0
    for n in lengths:  # the bin with least room that suffices; when none does, the fullest of 7 closes for a new one
        fitting = [f for f in free.values() if f >= n]
        got_bin, got_at = packer.place(n)
        if fitting:
            assert size - got_at == min(fitting) and free[got_bin] == min(fitting)
            free[got_bin] -= n
        else:
            if len(free) == 7:
                fullest = min(free.values())
                closed = [b for b, f in free.items() if f == fullest]
                free.pop(closed[-1] if len(closed) == 1 else packer_closed(packer, closed))
            assert (got_bin, got_at) == (bins, 0)
            free[got_bin], bins = size - n, bins + 1
        if not free[got_bin]:
            free.pop(got_bin)
        at += n
    assert bins >= at / size
    docs = spark.range(400).selectExpr("cast(null as long) doc_id", "repeat('word ', cast(id % 50 as int)) text")
    rows = bestfit.pack(docs, vocabulary(BPE_FILE), group_rows=50).collect()
    held = Counter(r.sequence_id >> 40 for r in rows)
    assert len(rows) == 400 and len(held) > 4 and max(held.values()) < 100  # rows of one id are dealt to all groups


def packer_closed(packer, candidates):
    """Of equally full bins the one that the packer no longer holds."""
    held = {b for stack in packer.free for b in stack}
    return next(b for b in candidates if b not in held)


def code_length(texts, data):
    """PPM of order 3, escape method C with exclusion, in bits."""
    seen = defaultdict(Counter)
    for t in texts:
        padded = b"\0\0\0" + t
        for i in range(len(t)):
            for k in range(4):
                seen[padded[i + 3 - k : i + 3]][padded[i + 3]] += 1
    total, padded = 0.0, b"\0\0\0" + data
    for i, s in enumerate(data):
        gone = set()
        for k in (3, 2, 1, 0):
            here = {x: n for x, n in seen[padded[i + 3 - k : i + 3]].items() if x not in gone}
            if not here:
                continue
            if s in here:
                total -= math.log2(here[s] / (sum(here.values()) + len(here)))
                break
            total -= math.log2(len(here) / (sum(here.values()) + len(here)))
            gone |= set(here)
        else:
            total += math.log2(256 - len(gone))
    return total


def edit_distance(pattern, text):
    last = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        row = [i]
        for j, t in enumerate(text, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (p != t)))
        last = row
    return min(last)


def test_pipeline_by_definition(spark, tmp_path):
    import corpus_pipeline
    from tickvet.llm import edit_decontam
    from tokenizers import Tokenizer

    rng = random.Random(13)
    texts = ["\n".join(words(rng, rng.randint(2, 14)) for _ in range(rng.randint(1, 5))) for _ in range(40)]
    near = texts[3].split(" ")
    near[2] = "changed"
    item, other = words(rng, 25), words(rng, 30)
    texts += [texts[0], " ".join(near), texts[5] + "\n" + texts[6], words(rng, 10) + " " + item + " " + words(rng, 5), item.replace("e", "E", 2)[:-1], "1234 5678 !!", "", None]
    texts += ["".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(60)), words(rng, 900)]
    langs = [["en", "xx", None][i % 3] if i < 48 else None for i in range(len(texts))]
    docs = [(i, t, lang, "s", len(t or "")) for i, (t, lang) in enumerate(zip(texts, langs, strict=True))]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, other), (3, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    learned = [[t.encode() for t, x in zip(texts, langs, strict=True) if x == lang and t is not None] for lang in ("en", "xx")]
    kept = {}
    for i, t in enumerate(texts):
        if t and any(map(str.isalpha, t)) and min(code_length(ts, t.encode()) for ts in learned) / len(t.encode()) < 7.0:
            kept[i] = t
    assert set(range(len(texts))) - set(kept) >= {45, 46, 47, 48}
    before = []
    for i in sorted(kept):
        stay = []
        for line in kept[i].split("\n"):
            s = set(line.lower().split(" ")) - {""}
            if not s or not any(len(s & y) * 5 >= len(s | y) * 4 for y in before):
                stay.append(line)
            before += [s] if s else []
        kept[i] = "\n".join(stay)
    label = {i: i for i in kept}
    sets = {i: set(shingles(t, 5)) for i, t in kept.items()}
    for i in sorted(kept):
        for j in sorted(kept):
            if j < i and label[i] != label[j] and len(sets[i] & sets[j]) * 5 >= len(sets[i] | sets[j]) * 4:
                low, high = sorted((label[i], label[j]))
                label = {k: low if x == high else x for k, x in label.items()}
    kept = {i: t for i, t in kept.items() if label[i] == i}
    n = edit_decontam.normal
    items = [n(item), n(other)]
    clean = {i: t for i, t in kept.items() if not any(edit_distance(x, n(t)) <= len(x) // 20 for x in items)}
    assert set(kept) - set(clean)
    tok, want = Tokenizer.from_file(vocabulary(BPE_FILE)), set()
    for i, t in clean.items():
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 2], "<u4")
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        want |= {(i, p, a, b - a, zlib.crc32(ids[a:b].tobytes())) for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))}
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want), json.dumps(sorted({r.doc_id for r in got} ^ {w[0] for w in want}))
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for held in places.values():
        assert [o for o, _ in sorted(held)] == [sum(x for _, x in sorted(held)[:k]) for k in range(len(held))] and sum(x for _, x in held) <= 1024
