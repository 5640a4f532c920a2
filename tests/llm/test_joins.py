"""Token-group join, fill-in-middle and pivot-table clustering against plain versions; hard cases of earlier operators."""

import hashlib
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from airgrid.llm import bpe, fim, laesa, quality, suffix, tokengroups, toxicity

RNG = np.random.default_rng(13)
WORDS = ["w%d" % k for k in range(400)]
DOCUMENTS = "doc_id bigint, text string, grp string, n string"


def sentence(n: int) -> list[str]:
    return [WORDS[k] for k in RNG.integers(0, len(WORDS), n)]


def edited(words: list[str], share: float) -> list[str]:
    out = list(words)
    for k in RNG.integers(0, len(out), max(1, int(share * len(out)))):
        out[k] = "edit%d" % RNG.integers(1000)
    return out


@pytest.fixture(scope="module")
def texts() -> list:
    """Nulls, short and empty texts, exact and near copies, a chain of edits, a passage in many texts, a text mostly made of it."""
    base, passage = sentence(150), sentence(60)
    out = [None, "", " \n", "one", "ONE", "one two three", "a b c d", "A  B\nc d", " ".join(base), " ".join(base).upper(), " ".join(base)]
    out += [" ".join(edited(base, s)) for s in np.repeat([0.007, 0.02, 0.04, 0.06], 15)]
    last = base
    for _ in range(12):
        last = edited(last, 0.01)
        out.append(" ".join(last))
    out += [" ".join(sentence(30) + passage + sentence(20)) for _ in range(25)] + [" ".join(passage + sentence(3)) for _ in range(40)]
    return out + [" ".join(sentence(60)) for _ in range(20)] + [" ".join(sentence(9000))]


def plain_sets(texts, size):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        out.append({tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    return out


def plain_classes(ids, sets, percent):
    of = {i: i for i in ids}

    def root(i):
        while of[i] != i:
            i = of[i]
        return i
    for a in range(len(ids)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = root(ids[a]), root(ids[b])
                of[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize(("rare", "most", "shingle", "percent"), [(2, 8, 4, 85), (1000, 256, 4, 85), (5, 3, 2, 80)])
def test_token_groups(spark, texts, monkeypatch, rare, most, shingle, percent):
    monkeypatch.setattr(tokengroups, "RARE", rare)
    ids = list(range(100, 100 + len(texts)))
    rows = [(i, t, "x", None) for i, t in zip(ids, texts, strict=True)] + [(108, texts[8], "y", None), (None, texts[8], "y", None)]
    got = tokengroups.classes(spark.createDataFrame(rows, DOCUMENTS).repartition(3), shingle, percent, most=most).collect()
    assert len(got) == len(rows)
    sets = plain_sets(texts, shingle)
    want = plain_classes(ids, sets, percent)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(i, len(s), want[i]) for i, s in zip(ids, sets, strict=True)} | {(None, len(sets[8]), None)}


def test_token_groups_of_nothing(spark):
    assert tokengroups.classes(spark.createDataFrame([], DOCUMENTS), 4, 85).collect() == []
    got = tokengroups.classes(spark.createDataFrame([(1, None, "", ""), (2, " ", "", ""), (2, "a b", "", "")], DOCUMENTS)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == [(1, 0, 1), (2, 0, 2), (2, 1, 2)]


def test_texts_of_one_id_link_their_components(spark):
    a, b = " ".join(sentence(40)), " ".join(sentence(40))
    got = tokengroups.classes(spark.createDataFrame([(1, a, "", ""), (7, a, "", ""), (7, b, "", ""), (9, b, "", "")], DOCUMENTS)).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (7, 1), (9, 1)}


def test_prefixes_of_similar_sets_meet():
    """Whatever the order, sets of the given similarity have MEET prefix shingles in common, or as many as they need at all."""
    for n in list(range(1, 60)) + [400]:
        for _ in range(4):
            order = RNG.permutation(3 * n).astype(np.uint64)
            a = order[:n]
            keep = int(np.ceil(0.85 * n))
            b = np.concatenate((a[:keep], order[n:2 * n]))[:max(keep, int(keep / 0.85))]
            common = len(np.intersect1d(a, b))
            if 100 * common >= 85 * (len(a) + len(b) - common):
                pa_, pb = (np.sort(x)[:tokengroups.prefix_length(len(x), 85)] for x in (a, b))
                assert len(np.intersect1d(pa_, pb)) >= min(tokengroups.MEET, tokengroups.least_common(len(a), 85))


def test_tables_of_bits_join(spark):
    small, large = np.zeros(64, np.uint64), np.zeros(256, np.uint64)
    small[3], large[200] = 1 << 5, 1 << 9
    both = tokengroups.joined(small, large)
    tokens = np.array([3 * 64 + 5, 67 * 64 + 5 + (1 << 40), 200 * 64 + 9, 200 * 64 + 8, 7], np.uint64)
    assert tokengroups.is_frequent(tokens, both).tolist() == [True, True, True, False, False]


# ---------------------------------------------------------------- fill in the middle
def plain_fim(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i:8 * i + 8], 16) for i in range(4))
    n = len(text)
    if n == 0 or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:low], text[low:high], text[high:]
    spm = h4 % 100 < 20
    return n, "spm" if spm else "psm", low, high - low, f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("segment", [1 << 20, 7])
def test_fill_in_middle(spark, monkeypatch, segment):
    monkeypatch.setattr(fim, "SEGMENT", segment)
    pool = ["é", "😀", "a", "<", "P>", "S", "M>", "\n", "\0", "é", "\U0010ffff", " ", "<S"]
    texts = [None, "", "a", "é", "with <M> inside", "<P", "😀" * 50] + ["".join(RNG.choice(pool, RNG.integers(1, 60))) for _ in range(120)]
    rows = [(i if i else None, t, "x", "y") for i, t in enumerate(texts)] + [(3, "é", "x", "y")]
    made = fim.transform(spark.createDataFrame(rows, "doc_id bigint, text string, form string, n string").repartition(2))
    got = fim.restore(made).collect()
    want = [plain_fim(i, t) + (t or "",) for i, t, *_ in rows]
    key = lambda x: tuple(map(repr, x))
    assert sorted(((r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in got), key=key) == sorted(want, key=key)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_fill_in_middle_of_long_and_no_texts(spark):
    text = ("é😀 long " * 400_000)
    got = fim.digests(spark.createDataFrame([(4, text, "", "")], DOCUMENTS)).first()
    n, form, low, middle, output = plain_fim(4, text)
    assert (got.n, got.form, got.prefix_chars, got.middle_chars) == (n, form, low, middle)
    assert got.output_sha256 == hashlib.sha256(output.encode()).hexdigest() and got.restored_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert fim.digests(spark.createDataFrame([], DOCUMENTS)).collect() == []


# ---------------------------------------------------------------- pivot table
def plain_clusters(rows, k, rounds):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) and abs(x) < laesa.LARGEST for x in v):
            kept.append((i, [int(np.floor(256 * float(x))) for x in v]))
    start = sorted((hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)[:k]
    centroids = [v for _, v in start]

    def near(v):
        return min((sum((x - y) ** 2 for x, y in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        at = [near(v)[1] for _, v in kept]
        for j in range(len(centroids)):
            mine = [v for (_, v), c in zip(kept, at, strict=True) if c == j]
            if mine:
                centroids[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    out = [(i, near(v)[1], near(v)[0]) for i, v in kept]
    total = {j: sum(d for _, c, d in out if c == j) for j in range(len(centroids))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, c, d, total[c], sum(total.values()), sha[c]) for i, c, d in out]


@pytest.mark.parametrize(("n", "k"), [(90, 7), (5, 40), (60, 12)])
def test_clusters(spark, n, k):
    rows = [(i, (RNG.normal(0, 1, 64) + (i % 4) * (n == 60)).astype(np.float32).tolist()) for i in range(n)]
    rows += [(n, rows[0][1]), (3, rows[3][1]), (None, rows[1][1])]
    odd = [(200, None), (201, [0.0] * 63), (202, [None] + [0.0] * 63), (203, [float("nan")] + [0.0] * 63), (204, [float("inf")] + [0.0] * 63), (205, [1e30] + [0.0] * 63)]
    table = spark.createDataFrame([(i, v, 5, "x") for i, v in rows + odd], "vec_id bigint, embedding array<float>, cluster int, n string").repartition(3)
    got = laesa.cluster(table, k, 3)
    key = lambda x: tuple(map(repr, x))
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(plain_clusters(rows + odd, k, 3), key=key)
    assert laesa.cluster(table.limit(0), k, 3).collect() == []


def test_pivots_spare_distances():
    """On clustered vectors the bounds rule most centroids out, and what they leave is exact."""
    centres = RNG.integers(-4000, 4000, (30, 64))
    points = centres[RNG.integers(0, 30, 2000)] + RNG.integers(-40, 40, (2000, 64))
    fixed = laesa.far_apart(centres, 6)
    cluster, far, computed = laesa.nearest(points, laesa.distances(points, fixed), centres, laesa.distances(centres, fixed))
    every = ((points[:, None, :] - centres[None]) ** 2).sum(2)
    assert (cluster == every.argmin(1)).all() and (far == every.min(1)).all()
    assert computed < 0.2 * every.size


# ---------------------------------------------------------------- hard cases of earlier operators
@pytest.mark.parametrize("size", [5 << 20, 20 << 20])
def test_bpe_of_very_long_texts(size):
    import tiktoken

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    codec = bpe.Codec(ranks, public_tokenizers.PATTERN)
    words = np.array(["alpha", "beta ", "é", "gamma\n", "x1y", ", "])
    text = " ".join(words[RNG.integers(0, len(words), size // 5)])
    ids = codec.encode([text, "short"])
    library = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert np.frombuffer(ids[0], "<u4").tolist() == library.encode_ordinary(text)
    assert codec.decode(ids) == [text.encode(), b"short"]


def test_repeated_rows_of_one_id(spark):
    """Copies with one id give what copies with different ids give."""
    text = " ".join(sentence(700))
    want = suffix.remove_repeats(spark.createDataFrame([(i, text, "", "") for i in range(300)], DOCUMENTS)).drop("doc_id").distinct().collect()
    got = suffix.remove_repeats(spark.createDataFrame([(1, text, "", "")] * 300, DOCUMENTS))
    assert got.count() == 300 and got.drop("doc_id").distinct().collect() == want


def test_passages_in_slices():
    texts = [b"", b"abc " * 700, b"x" * 3000, b"hello, world\n" * 90, b""]
    whole, first = quality.passages(texts)
    for most in (1, 3000, 1 << 20):
        rows, at = quality.all_passages(texts, most)
        assert (at == first).all() and np.array_equal(rows, whole.astype(np.float16))
    assert quality.all_passages([])[0].shape == (0, quality.FEATURES)


def test_only_long_labelled_texts(spark):
    """Nothing can be learned from: as without labels."""
    docs = spark.createDataFrame([(i, "bad words " * 200, "en", "") for i in range(8)], "doc_id bigint, text string, lang string, n string")
    labels = docs.select("doc_id", F.lit(1).alias("toxic"), F.lit(1).alias("quality"))
    with pytest.warns(UserWarning):
        assert {r.predicted for r in toxicity.classify(docs, labels, sample_bytes=1000).collect()} == {0}
    with pytest.warns(UserWarning):
        assert {r.score for r in quality.classify(docs, labels, sample_bytes=1000).collect()} == {0.5}
