"""Near-duplicate documents against all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash

from skyframe.llm import simhash
from skyframe.llm.components import connected_components


def fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(values, radius=4):
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(values):
        for j in range(i):
            if (a ^ values[j]).bit_count() <= radius:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(values))]


def near(rng, base, bits):
    for b in rng.sample(range(64), bits):
        base ^= 1 << b
    return base


def values(seed, clusters, size, singles):
    rng = random.Random(seed)
    out = set()
    for _ in range(clusters):
        base = rng.getrandbits(64)
        out |= {near(rng, base, rng.randrange(5)) for _ in range(size)}
    return sorted(out | {rng.getrandbits(64) for _ in range(singles)})


def signed(v):
    return v - (1 << 64) if v >> 63 else v


@pytest.mark.parametrize("rows", [2048, 8])
def test_links_connect_all_close_fingerprints(spark, monkeypatch, rows):
    """With groups of 8 rows every level of bands and the block-wise step come into play."""
    found = values(1, 6, 40, 200)
    df = spark.createDataFrame([(signed(v),) for v in found], "fp long")
    links = simhash.fingerprint_links(df, group_rows=rows)
    place = {signed(v): i for i, v in enumerate(found)}
    parent = list(range(len(found)))
    edges = [(place[r["a"]], place[r["b"]]) for r in links.collect()]
    assert all((found[i] ^ found[j]).bit_count() <= 64 for i, j in edges)
    label = parent[:]
    for _ in range(len(found)):
        before = label[:]
        for i, j in edges:
            label[i] = label[j] = min(label[i], label[j])
        if label == before:
            break
    assert label == groups(found)


def test_bit_sliced_distances():
    rng = np.random.default_rng(3)
    fp = rng.integers(0, 1 << 63, 130, dtype=np.uint64)
    fp[100] = fp[3] ^ np.uint64(0b1111)
    fp[101] = fp[3] ^ np.uint64(0b11111)
    planes = simhash._planes(fp)
    for radius in (0, 1, 3, 4, 7, 20):
        q, b = np.repeat(fp, 3), np.tile(np.arange(3), 130)
        alive, words = simhash.close_words(planes, q, b, radius)
        seen = {(int(a) // 3, int(b[a]) * 64 + bit) for a, w in zip(alive, words.tolist()) for bit in range(64) if w >> bit & 1}
        wanted = {(i, j) for i in range(130) for j in range(130) if (int(fp[i]) ^ int(fp[j])).bit_count() <= radius}
        assert {s for s in seen if s[1] < 130} == wanted


def test_documents_against_all_pairs(spark, documents, odd_rows):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    rows = list(odd_rows)
    for i in range(40):
        text = rng.choices(words, k=120)
        rows.append((100 + 2 * i, " ".join(text), "s"))
        text[rng.randrange(120)] = "Changed"
        rows.append((101 + 2 * i, " ".join(text), "s"))
    found = simhash.near_duplicates(documents(rows)).collect()
    marks = [fingerprint(t) for _, t, _ in rows]
    root = groups(marks)
    smallest = {}
    for (i, _, _), r in zip(rows, root):
        if i is not None:
            smallest[r] = min(i, smallest.get(r, i))
    expected = sorted((str(i), f"{m:016x}", str(smallest.get(r))) for (i, _, _), m, r in zip(rows, marks, root))
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in found) == expected


def test_one_of_each_group_stays(spark, documents, odd_rows):
    docs = documents(odd_rows)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    texts = [(i, t, s) for i, t, s in odd_rows]
    root = groups([fingerprint(t) for _, t, _ in texts])
    assert kept.count() == len(set(root))
    assert {r["doc_id"] for r in kept.collect() if r["doc_id"] is not None} <= {i for i, _, _ in texts}


def shingles(text, words=5):
    parts = text.lower().split()
    return {" ".join(parts[i : i + words]) for i in range(len(parts) - words + 1)}


def test_near_copies_of_a_corpus_go_by_similarity(spark, documents):
    """Copies at a similarity of 0.8 to 0.95 mostly go, and none below 0.8 does."""
    rng = random.Random(21)
    words = [f"w{i}" for i in range(3000)]
    rows, similarity = [], {}
    for i in range(120):
        text = rng.choices(words, k=200)
        rows.append((2 * i, " ".join(text), "s"))
        copy = text[:]
        for at in rng.sample(range(200), rng.choice([1, 2, 3, 4, 8])):
            copy[at] = "changed"
        rows.append((2 * i + 1, " ".join(copy), "s"))
        a, b = shingles(rows[-2][1]), shingles(rows[-1][1])
        similarity[2 * i + 1] = len(a & b) / len(a | b)
    kept = {r["doc_id"] for r in simhash.one_of_each(documents(rows)).collect()}
    assert kept >= {2 * i for i in range(120)} | {i for i, j in similarity.items() if j < 0.8}
    near = [i for i, j in similarity.items() if 0.8 <= j < 0.95]
    assert len(near) > 50 and sum(i not in kept for i in near) >= 0.6 * len(near)


def test_no_link_of_a_corpus_is_passed_over(spark, documents):
    """Components are those of all pairs within the radius that are similar, in families
    whose nearest pairs are often not similar."""
    rng = random.Random(4)
    rows = []
    for family in range(8):
        base = [f"f{family}w{i}" for i in rng.choices(range(150), k=260)]
        for _ in range(40):
            text = base[:]
            for at in rng.sample(range(260), rng.choice([3, 5, 7, 9])):
                text[at] = f"x{rng.randrange(1000)}"
            rows.append((len(rows), " ".join(text), "s"))
    texts = [t.encode() for _, t, _ in rows]
    marks = np.array([simhash.fingerprint(t, simhash.CORPUS_WORDS) for t in texts], np.uint64)
    root = np.arange(len(rows))
    for i in range(len(rows)):
        near = np.flatnonzero(np.bitwise_count(marks[i] ^ marks) <= simhash.CORPUS_RADIUS)
        near = np.array([j for j in near if j > i and simhash.similar(texts[i], texts[j])], np.int64)
        simhash.unite(root, np.full(len(near), i), near)
    kept = {r["doc_id"] for r in simhash.one_of_each(documents(rows)).collect()}
    assert kept == set(root.tolist()) and 8 < len(kept) < 300


def test_nearest_links_are_close_and_connect():
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    fp = np.unique(np.array([b ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, 3, dtype=np.uint64)) for b in base for _ in range(60)]))
    i, j = simhash.nearest_links(fp, np.array([0, len(fp)]), 8)
    assert len(i) <= 2 * len(fp) and (np.bitwise_count(fp[i] ^ fp[j]) <= 8).all()
    root = np.arange(len(fp))
    simhash.unite(root, i, j)
    assert root.tolist() == groups(fp.tolist(), 8)


def test_texts_of_one_fingerprint_are_compared():
    assert simhash.similar(b"A b", b"a  B") and simhash.similar(b"", b" ") and not simhash.similar(b"", b"a")
    assert not simhash.similar(b"a b c d e f", b"a b c d e g")


def test_empty_table(spark, documents):
    assert simhash.near_duplicates(documents([])).collect() == []
    assert simhash.one_of_each(documents([])).collect() == []


def test_components_of_long_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1500)] + [(5, 5), (2000, 2001), (2001, 2000)]
    random.Random(1).shuffle(edges)
    df = spark.createDataFrame(edges, "a long, b long")
    found = {r["node"]: r["component"] for r in connected_components(df).collect()}
    assert found == {**{i: 0 for i in range(301)}, **{i: 1000 for i in range(1000, 1500)}, 2000: 2000, 2001: 2000}
    assert connected_components(df.limit(0)).collect() == []


def test_no_pairs_of_a_family_are_listed(spark, documents, monkeypatch):
    """Many texts within the radius and few of them similar: links are found in parts of groups,
    and what is listed and compared again grows with the texts, not with their pairs."""
    rng = random.Random(9)
    base = [f"w{i}" for i in rng.choices(range(400), k=400)]
    rows = []
    for i in range(150):
        text = base[:]
        for at in rng.sample(range(400), rng.choice([2, 9, 12, 14])):
            text[at] = f"x{rng.randrange(1000)}"
        rows.append((i, " ".join(text), "s"))
    rows += [(len(rows), "a b c d e f", "s"), (len(rows) + 1, "A  b c d e F", "s"), (len(rows) + 2, "", "s")]
    listed = []
    real = simhash.similar_links

    def counted(links, texts):
        listed.append(links.count())
        return real(links, texts)

    for name, value in (("similar_links", counted), ("GROUP_ROWS", 40), ("GROUP_SHINGLES", 9000), ("SLAB", 500)):
        monkeypatch.setattr(simhash, name, value, raising=False)
    kept = {r["doc_id"] for r in simhash.one_of_each(documents(rows)).collect()}
    texts = [t.encode() for _, t, _ in rows]
    marks = np.array([simhash.fingerprint(t, simhash.CORPUS_WORDS) for t in texts], np.uint64)
    root, close = np.arange(len(rows)), 0
    for i in range(len(rows)):
        near = np.flatnonzero(np.bitwise_count(marks[i] ^ marks) <= simhash.CORPUS_RADIUS)
        close += int((near > i).sum())
        near = np.array([j for j in near if j > i and simhash.similar(texts[i], texts[j])], np.int64)
        simhash.unite(root, np.full(len(near), i), near)
    assert kept == set(root.tolist()) and 50 < len(kept) < 140
    assert close > 10 * len(rows) and listed[1] <= 2 * len(rows)


def test_each_pair_has_one_group():
    rng = random.Random(3)
    bands = 9
    for _ in range(200):
        a = rng.getrandbits(64)
        b = near(rng, a, rng.randrange(1, 9))
        paths = [band + 1 for band in range(bands)]
        deeper = [p * (bands + 1) + band + 1 for p in paths for band in range(bands)]
        for level in (paths, deeper):
            both = np.array([p for p in level if not (a ^ b) & simhash.band_masks(simhash._digits(p, bands), bands)[0]], np.int64)
            assert len(both) and simhash.first_meeting(both, np.full(len(both), a ^ b, np.uint64), 8).sum() == 1
