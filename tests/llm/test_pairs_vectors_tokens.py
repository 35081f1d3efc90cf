"""Operators 11 to 13 against versions written from their definitions."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from tickvet.llm import metricjoin, tokenalign, whiten
from tickvet.llm.queries import BPE_FILE, PIECE_FILE, vocabulary

LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
DOCS = "doc_id long, text string, c string, n int, root string, key string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def shingles(text):
    w = words(text)
    return frozenset(tuple(w[i : i + 3]) for i in range(max(len(w) - 2, 0))) or frozenset([tuple(w)] if w else [])


def components_by_force(rows):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 90 * len(a | sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return Counter((d, len(s), least.get(root(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def near_copies():
    rng = np.random.default_rng(5)
    pool = [f"w{i}" for i in range(3000)]
    rows = []
    for base in range(14):
        text = list(rng.choice(pool, int(rng.integers(3, 220))))
        for _ in range(int(rng.integers(1, 14))):
            copy = list(text)
            for _ in range(int(rng.integers(0, 4))):
                copy[int(rng.integers(len(copy)))] = str(rng.choice(pool))
            rows.append((len(rows) * 3 + base, " ".join(copy)))
    rows += [(9000, None), (9001, ""), (9002, " \t\n"), (9003, "one"), (9004, "ONE"), (9005, "one two"), (9006, "one two three")]
    rows += [rows[0], (None, rows[0][1]), (None, "no id here at all"), (rows[1][0], "same id other text entirely")]
    rows.append((9100, " ".join(f"long{i % 7919}x{i % 13}" for i in range(40_000))))
    return rows


@pytest.mark.parametrize(("leaf", "stars"), [(256, 1), (2, 0)])
def test_metric_join(spark, leaf, stars):
    rows = near_copies()
    docs = spark.createDataFrame([(d, t, "x", 1, "y", "z") for d, t in rows], DOCS)
    got = metricjoin.groups(docs, leaf=leaf, stars=stars, pivots=3).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == components_by_force(rows)


def test_metric_join_of_nothing(spark):
    assert metricjoin.groups(spark.createDataFrame([], DOCS)).collect() == []
    alone = metricjoin.groups(spark.createDataFrame([(1, "a b c d e", None, 0, None, None), (2, None, None, 0, None, None)], DOCS)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in alone) == [(1, 3, 1), (2, 0, 2)]


def join_rows(plan):
    """Rows that the sorted joins of an executed plan by region and band made."""
    own = plan.metrics().apply("numOutputRows").value() if plan.nodeName() == "SortMergeJoin" and "[region" in plan.simpleString(100) else 0
    return own + sum(join_rows(plan.children().apply(i)) for i in range(plan.children().size()))


def test_pairs_meet_in_their_least_cell(spark):
    rng = np.random.default_rng(8)
    base, rows = [f"w{i}" for i in range(400)], []
    for i in range(12):
        text = list(base)
        text[int(rng.integers(400))] = f"own{i}"
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    cells = metricjoin.first_cells(metricjoin.prints(docs, 3, 9, 10)).selectExpr("*", "c AS root", "CAST(NULL AS double) AS d")
    pairs = metricjoin.close(cells, 9, 10)
    assert len(pairs.collect()) == 66
    assert 66 <= join_rows(pairs._jdf.queryExecution().executedPlan()) <= 2 * 66  # one row a common cell would be some thousand


VECTORS = "vec_id long, embedding array<float>, x string, k int, component int"


def test_whitening(spark):
    rng = np.random.default_rng(3)
    v = (rng.normal(size=(300, 20)) @ rng.normal(size=(20, 20))).astype(np.float32)
    rows = [(i, list(map(float, x))) for i, x in enumerate(v)]
    rows += [rows[0]] * 150 + [(None, rows[1][1])]  # one vector is a third of all rows
    bad = [(900, None), (901, []), (902, [1.0] * 19), (903, [float("nan")] + [0.0] * 19), (904, [None] + [0.0] * 19), (905, [float("inf")] + [0.0] * 19)]
    frame = spark.createDataFrame([(i, x, "a", 1, 2) for i, x in rows + bad], VECTORS).repartition(7)
    got = sorted(whiten.whiten(frame, fan_in=2).collect(), key=lambda r: (r.vec_id is None, r.vec_id, r.component))
    x = np.floor(64 * v.astype(float)).astype(int) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    e, u = np.linalg.eigh(np.cov(fit.T, bias=True))
    e, u = e[::-1], u[:, ::-1]
    assert len(got) == 16 * len(rows) and {r.n for r in got} == {n} and max(r.identity_error for r in got) < 1e-9
    signs = np.sign([sum(r.whitened * ((x[r.vec_id] - s / n) @ u[:, k]) for r in got if r.component == k + 1 and r.vec_id is not None) for k in range(16)])
    for r in got:
        at, k = 1 if r.vec_id is None else r.vec_id, r.component - 1
        assert r.deviation == int(((n * x[at] - s) ** 2).sum())
        assert r.whitened == pytest.approx(signs[k] * ((x[at] - s / n) @ u[:, k]) / np.sqrt(e[k]), abs=1e-8)
        assert r.explained == pytest.approx(e[k] / e.sum(), rel=1e-9)


def test_whitening_without_directions(spark):
    assert whiten.whiten(spark.createDataFrame([], VECTORS)).collect() == []
    assert whiten.whiten(spark.createDataFrame([(1, [1.0, 2.0], "", 0, 0), (2, [1.0, 2.0], "", 0, 0)], VECTORS)).collect() == []
    line = spark.createDataFrame([(i, [float(i), float(i), 5.0], "", 0, 0) for i in range(4)], VECTORS)
    assert {r.component for r in whiten.whiten(line).collect()} == {1}  # rank one
    huge = whiten.Whitening(2, [0, 0], np.array([[1.0, 0.0], [0.0, 1.0]]), 2)
    assert huge.deviations(np.array([[1 << 40, 0]])) == [None] and huge.deviations(np.array([[3, 4]])) == [100]


TEXTS = [
    (1, "Hello  world, it's 2024!\n"), (2, "Grüße aus Köln - naïve café 日本語 🙂🙂"), (3, ""), (4, None), (5, " leading\ttabs\r\n\r\nand <s> </s> <unk> <0x0A>"),
    (6, "a<|endoftext|>b"), (7, "▁lower▁block"), (8, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"), (9, "\x00\x01 �"), (None, "Hello  world, it's 2024!\n"), (1, "Hello"), (10, "der Hund und die Katze " * 3000),
]


def aligned_by_force(rows):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(vocabulary(BPE_FILE))
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=vocabulary(PIECE_FILE))
    of_char = tokenalign._byte_of_char()
    counts, docs = Counter(), []
    for d, text in rows:
        links, groups, n = [], [], (0, 0)
        if text:
            e, ids = a.encode(" " + text, add_special_tokens=False), b.encode(text)
            left = [bytes(of_char[c] for c in t) for t in e.tokens]
            right = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode() for p in map(b.id_to_piece, ids)]
            if b"".join(left) == b"".join(right) == (" " + text).encode():
                n, ends_a, ends_b = (len(left), len(right)), np.cumsum([*map(len, left)]), np.cumsum([*map(len, right)])
                group = ([], [])
                for end in sorted({*ends_a.tolist(), *ends_b.tolist()}):
                    i, j = int(np.searchsorted(ends_a, end)), int(np.searchsorted(ends_b, end))
                    links.append((e.ids[i], ids[j]))
                    if ends_a[i] == end:
                        group[0].append(e.ids[i])
                    if ends_b[j] == end:
                        group[1].append(ids[j])
                    if ends_a[i] == ends_b[j] == end:
                        groups.append("|".join(",".join(map(str, g)) for g in group))
                        group = ([], [])
        counts.update(links)
        docs.append((d, n, links, groups))
    best = {}
    for (_, y), c in counts.items():
        best[y] = max(best.get(y, 0), c)
    digest = lambda g: hashlib.sha256(";".join(g).encode()).hexdigest() if g else ""
    return Counter((d, *n, len(g), len(k), sum(counts[x] == best[x[1]] for x in k), sum(counts[x] for x in k), digest(g)) for d, n, k, g in docs)


@pytest.mark.parametrize("chunk_bytes", [1 << 20, 40])
def test_alignment(spark, chunk_bytes):
    docs = spark.createDataFrame([(d, t, "x", 1, "r", "k") for d, t in TEXTS], DOCS)
    got = tokenalign.align(docs, vocabulary(BPE_FILE), vocabulary(PIECE_FILE), chunk_bytes=chunk_bytes)
    fields = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert Counter(tuple(r[k] for k in fields) for r in got.collect()) == aligned_by_force(TEXTS)


def test_alignment_dictionary(spark):
    files = vocabulary(BPE_FILE), vocabulary(PIECE_FILE)
    empty = spark.createDataFrame([], DOCS)
    assert tokenalign.align(empty, *files).collect() == []
    docs = spark.createDataFrame([(1, "the the cat", "", 0, "", ""), (2, "the dog", "", 0, "", "")], DOCS)
    groups = tokenalign.dictionary(tokenalign.chunks(docs, *files))
    the = [r for r in groups.collect() if r.freq == 3]
    assert [(r.freq, r.docs) for r in the] == [(3, 2)]
    by_docs = tokenalign.pairs(tokenalign.links(groups, *files), "docs").collect()
    a, b = tokenalign.unpacked(the[0].ids)
    assert [(r["count"], r.best) for r in by_docs if (r.a, r.b) == (a[0], b[0])] == [(2, True)]


def test_alignment_rows_do_not_grow_with_a_chunk(spark):
    # Parquet is read by batches of thousands of rows, so a row must not hold a chunk.
    files = vocabulary(BPE_FILE), vocabulary(PIECE_FILE)
    widest = []
    for n in (20, 400):
        docs = spark.createDataFrame([(d, f"a row of words {d} and {d * 7}", "", 0, "", "") for d in range(n)], DOCS).coalesce(1)
        found = tokenalign.chunks(docs, *files)
        widest.append(max(len(str(tuple(r))) for r in found.collect()))
    assert widest[1] < 1.5 * widest[0]
