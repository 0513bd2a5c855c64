import random

import numpy as np
import xxhash

from graphloom.llm import simhash


def plain(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode()
    w = low.split()
    if not w:
        return 0
    sh = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(fps, ids):
    """Smallest id reachable, by comparing all pairs."""
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    low = {}
    for i, d in enumerate(ids):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    return [low.get(find(i)) for i in range(len(fps))]


def check(rows, got):
    fps = [plain(t) for _, t in rows]
    want = sorted(((d, f, c) for (d, _), f, c in zip(rows, fps, classes(fps, [d for d, _ in rows]))), key=str)
    assert sorted(((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in got), key=str) == want


def test_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check([(r.doc_id, r.text) for r in docs.collect()], simhash.near_duplicates(docs).collect())


def test_odd_rows(odd, none):
    check([(r.doc_id, r.text) for r in odd.collect()], simhash.near_duplicates(odd).collect())
    assert simhash.near_duplicates(none).count() == 0


def test_covering_finds_every_pair():
    """Two halves within two bits share an anchor."""
    rng = random.Random(1)
    x = np.array([rng.getrandbits(32) for _ in range(400)], np.uint32)
    for flips in (0, 1, 2):
        y = x.copy()
        for i in range(len(y)):
            for b in rng.sample(range(32), flips):
                y[i] ^= np.uint32(1 << b)
        own, other = ([set() for _ in x] for _ in range(2))
        for sets, half in ((own, x), (other, y)):
            for i, a in zip(*simhash.anchors_of(half)):
                sets[i].add(int(a))
        assert all(a & b for a, b in zip(own, other))


def test_large_anchor_goes_on_in_blocks(spark):
    """A chain of fingerprints that meet at few anchors, with buckets of 4 rows, keeps its links."""
    rng = random.Random(2)
    base = rng.getrandbits(64)
    fps = list({base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(300)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    got = simhash.connected_components(simhash.links(df, bucket_rows=16)).collect()
    label = {f: f for f in signed} | {r.node: r.root for r in got}
    want = classes(fps, list(range(len(fps))))
    assert len({(label[f], w) for f, w in zip(signed, want)}) == len(set(want)) == len(set(label.values()))
