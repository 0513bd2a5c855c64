"""Mixing, sharding, line dedup and the pipeline against plain Python."""

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from graphloom.llm import linededup, mixing, ranks, sharding, simhash
from graphloom.llm.common import read_table

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs_of(spark):
    return read_table(spark, SF, "documents")


def plain_targets(sizes):
    """By sharing again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, free = dict.fromkeys(names, 0.0), 1.5 * sum(sizes.values()), set(names)
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] >= 2 * sizes[s]}
        if not full:
            for s in free:
                target[s] = level * weight[s]
            break
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free -= full
    return target


def test_mixing(spark, odd, none):
    for docs in (docs_of(spark), odd):
        rows = [(r.doc_id, r.source, len(WORD.findall(r.text or ""))) for r in docs.collect()]
        sizes = Counter()
        for _, s, n in rows:
            sizes[s] += n
        target = plain_targets(sizes)
        got = mixing.mix(docs).collect()
        assert sorted((str(r.doc_id), str(r.source), r.size) for r in got) == sorted((str(d), str(s), n) for d, s, n in rows)
        taken = Counter()
        for r in got:
            assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6
            assert 0 <= r.taken <= 2 * r.size
            taken[r.source] += r.taken
        assert all(abs(taken[s] - target[s]) < 1.5 for s in sizes)
        assert Counter(map(str, got)) == Counter(map(str, mixing.mix(docs).collect()))
    assert mixing.mix(none).count() == 0 and mixing.sample(none).count() == 0


def plain_sample(docs, seed=0):
    """How often each (doc_id, source, text) is taken: whole epochs, then documents in key order while their middles fit."""
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    rows = [(r.doc_id, r.source, r.text or "", len(WORD.findall(r.text or ""))) for r in docs.collect()]
    sizes = Counter()
    for _, s, _, n in rows:
        sizes[s] += n
    out = Counter()
    for s, t in plain_targets(sizes).items():
        epochs, at = (int(t // sizes[s]) if sizes[s] else 0), 0
        left = int(t - epochs * sizes[s])
        own = sorted((md5("\x1f".join(["" if d is None else str(d), str(seed), md5(x)])), d is not None, d or 0, n, x) for d, y, x, n in rows if y == s and n)
        for _, some, d, n, x in own:
            out[d if some else None, s, x] += epochs + (2 * (left - at) >= n)
            at += n
    return +out


def test_mixed_rows(spark, odd):
    repeated = spark.createDataFrame([(i % 3 if i % 2 else None, f"w{i % 5} " * (3 + i % 5), "h" if i % 4 else None, i) for i in range(400)], "doc_id long, text string, source string, _key long")
    clash = repeated.withColumns({x: repeated["_key"] for x in ("_source", "_cut", "_epochs", "_copy", "_n")})
    for docs in (docs_of(spark), odd, repeated, clash):
        got = mixing.sample(docs)
        assert got.columns == docs.columns
        rows = got.collect()
        assert Counter((r.doc_id, r.source, r.text) for r in rows) == plain_sample(docs)
    assert {r["_cut"] for r in rows} <= set(range(400)) and all(r["_cut"] == r["_source"] == r["_key"] for r in rows)


def plain_walk(keys, shards, virtual):
    """Rows in ring order: home shards first, then what is over goes clockwise."""
    ring = sharding.nodes(shards, virtual)
    room = sharding.bounds(len(keys), shards)
    cell = lambda k: int(k[:4], 16) >> 2
    out, over = {}, []
    for k in sorted(keys):
        i = next((j for j, (c, _) in enumerate(ring) if c >= cell(k)), 0)
        if room[ring[i][1]]:
            room[ring[i][1]] -= 1
            out[k] = ring[i][1]
        else:
            over.append((k, i))
    for k, i in over:
        while not room[ring[i][1]]:
            i = (i + 1) % len(ring)
        room[ring[i][1]] -= 1
        out[k] = ring[i][1]
    return out


def test_sharding(spark, odd, none):
    docs = docs_of(spark)
    got = sharding.assign(docs, shards=7, virtual=8).collect()
    want = plain_walk([r.key for r in got], 7, 8)
    assert all(r.shard == want[r.key] for r in got) and len(got) == docs.count()
    for rows in (got, sharding.assign(odd, shards=5).collect()):
        n = Counter(r.shard for r in rows)
        assert max(n.values()) - min(n.values()) <= 1
        for s in n:
            assert sorted(r.slot for r in rows if r.shard == s) == list(range(n[s]))
    assert sharding.assign(none).count() == 0
    # with slack, one more shard moves few rows
    a, b = ({r.key: r.shard for r in sharding.assign(docs, shards=s, slack=0.25).collect()} for s in (7, 8))
    moved = sum(a[k] != b[k] for k in a) / len(a)
    new = sum(b[k] == 7 for k in b) / len(b)
    assert new > 0.05 and moved < 0.3
    with_all = sharding.add_shards(odd)
    assert with_all.columns == [*[c for c in odd.columns if c != "shard"], "shard", "slot"]
    assert Counter((r.doc_id, r.text, r.size, r.key) for r in with_all.collect()) == Counter((r.doc_id, r.text, 1, 1) for r in odd.collect())


def plain_lines(rows):
    """doc_id, line, removed: every line against every earlier one."""
    lines = []
    for doc_id, text in rows:
        for i, t in enumerate((text or "").lower().split("\n") if text is not None else []):
            w = WORD.findall(t)
            if w:
                grams = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) or frozenset([tuple(w)])
                lines.append(((doc_id is None, doc_id or 0, i), grams, " ".join(w), doc_id, i))
    seen, by_gram = {}, {}
    for at, g, w, _, _ in sorted(lines, key=lambda x: x[0]):
        if w not in seen:
            seen[w] = (at, g)
            for x in g:
                by_gram.setdefault(x, []).append(w)
    gone = set()
    for w, (at, g) in seen.items():
        for v in {v for x in g for v in by_gram[x]}:
            if seen[v][0] < at and len(g & seen[v][1]) >= 0.8 * len(g | seen[v][1]) - 1e-9:
                gone.add(w)
    return sorted((str(d), i, at > seen[w][0] or w in gone) for at, _, w, d, i in lines)


def test_lines_against_all_pairs(spark, odd, none):
    near = "a b c d e f g h i j k l m n o p q r s t u v w x y z a1 b1 c1 d1 e1 f1 g1 h1 i1 j1 k1 l1 m1 n1 o1 p1 q1 r1 s1 t1"
    rows = [(500 + i, near.replace(f"{x} ", f"Q{i} ") + "\n" + near) for i, x in enumerate(["c", "m1", "z", "h", "k1"])]
    extra = spark.createDataFrame(rows, "doc_id long, text string")
    for docs in (docs_of(spark).select("doc_id", "text").union(extra), odd.select("doc_id", "text")):
        got = sorted((str(r.doc_id), r.line, r.removed) for r in linededup.removed_lines(docs).collect())
        assert got == plain_lines([(r.doc_id, r.text) for r in docs.collect()])
    assert linededup.removed_lines(none).count() == 0
    docs = docs_of(spark)
    cut = linededup.removed_lines(docs)
    want = {(r.doc_id, r.line) for r in cut.where("removed").collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in linededup.clean(docs, cut).collect():
        assert r.text == "\n".join(t for i, t in enumerate(texts[r.doc_id].split("\n")) if (r.doc_id, i) not in want)


def test_lines_of_repeated_and_null_doc_ids(spark):
    """Rows lose their own lines only."""
    rows = [(7, "x one", 1), (8, "x one\ny two", 2), (8, "p three\nx one", 3), (8, "p three\nx one", 4), (None, "q four\n\nx one", 5), (None, "r five\nq  FOUR", 6), (9, None, 7), (None, None, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _cut long").withColumnRenamed("_cut", "_key0")
    got = {r["_key0"]: r.text for r in linededup.clean(docs, linededup.removed_lines(docs)).collect()}
    assert got == {1: "x one", 2: "y two", 3: "p three", 4: "p three", 5: "q four\n", 6: "r five", 7: None, 8: None}


def test_lines_with_hot_tokens(spark, monkeypatch):
    """Many lines that share a passage, some alike and some not, with every bucket crowded and with none."""
    passage = " ".join(f"w{i}" for i in range(40))
    rows = [(i, f"{passage} end{i % 7} a{i} b{i} c{i % 3}\n" + " ".join(f"u{i}x{k}" for k in range(20)) + f" {passage}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for crowded in (8, 10**9, 0):
        monkeypatch.setattr(linededup, "CROWDED", crowded)
        assert sorted((str(r.doc_id), r.line, r.removed) for r in linededup.removed_lines(docs).collect()) == plain_lines(rows)


def test_pipeline(spark):
    import corpus_pipeline as cp

    from .test_simhash import classes, plain
    from .test_text_ops import plain_leaks

    docs, seen = docs_of(spark), {}
    for name, stage in cp.STAGES:
        before, out = docs, stage(spark, docs, SF)
        path = f"{spark.conf.get('spark.checkpoint.dir')}/test-{name}"
        out.write.mode("overwrite").parquet(path)
        docs = seen[name] = spark.read.parquet(path)
        a, b = [r.asDict() for r in before.collect()], [r.asDict() for r in docs.collect()]
        if name != "ring_sharding":
            assert docs.columns == before.columns
        ids = [r["doc_id"] for r in a]
        if name == "language_id":
            assert sorted(r["doc_id"] for r in b) == sorted(r["doc_id"] for r in a if re.search(r"[^\W\d_]", r["text"]))
        if name == "simhash_dedup":
            assert sorted(r["doc_id"] for r in b) == sorted(set(classes([plain(r["text"]) for r in a], ids)))
        if name == "decontamination":
            items = [(r.item_id, r.text) for r in read_table(spark, SF, "benchmark").collect()]
            bad = {x[0] for x in plain_leaks([(r["doc_id"], r["text"]) for r in a], items)}
            assert sorted(r["doc_id"] for r in b) == sorted(set(ids) - bad)
        if name == "source_mixing":
            size, total = Counter(), Counter()
            for rows, c in ((a, size), (b, total)):
                for r in rows:
                    c[r["source"]] += len(WORD.findall(r["text"]))
            longest = max(len(WORD.findall(r["text"])) for r in a)
            assert all(abs(total[s] - t) <= longest for s, t in plain_targets(size).items())
            assert max(Counter(r["doc_id"] for r in b).values()) <= 2
        if name == "ring_sharding":
            assert Counter(r["doc_id"] for r in b) == Counter(ids)
            n = Counter(r["shard"] for r in b)
            assert max(n.values()) - min(n.values()) <= 1


def test_pipeline_stages_on_odd_rows(spark, odd, none):
    """Which rows each stage keeps of nulls, empty and long texts and repeats; and nothing of nothing."""
    import corpus_pipeline as cp

    names = {"_key0": "a", "_source": "b", "_copy": "c", "_id": "d"}
    docs = odd.withColumn("n_chars", odd["n_chars"].cast("long")).withColumns({x: F.lit(y) for x, y in names.items()})
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    letters = Counter((d, t) for d, t in rows if t and re.search(r"[^\W\d_]", t))
    first = Counter({(1, rows[0][1]): 1, (3, None): 1, (6, "one"): 1, (7, rows[6][1]): 1, (None, "a b c d e f"): 1, (8, rows[8][1]): 1, (9, "x" * 200000): 1, (10, rows[11][1]): 1})
    want = {"language_id": letters, "decontamination": Counter(rows), "ring_sharding": Counter(rows)}
    for name, stage in cp.STAGES:
        out = stage(spark, docs, SF)
        got = out.collect()
        kept = Counter((r.doc_id, r.text) for r in got)
        if name == "language_id":  # no filter is learned from so few rows but for single n-grams: what has letters may go, nothing else stays
            assert not kept - want[name]
        elif name == "simhash_dedup":
            assert {k for k in kept if k[0] is not None} == {k for k in first if k[0] is not None} and max(kept.values()) == 1
        elif name == "source_mixing":
            assert Counter({(d, t): n for (d, _, t), n in plain_sample(odd).items()}) == Counter({(d, t or ""): n for (d, t), n in kept.items()})
        else:
            assert kept == want[name]
        assert all(r[x] == y for r in got for x, y in names.items()) and {*docs.columns} <= {*out.columns}
        assert stage(spark, none, SF).count() == 0


def test_keep_first_of_repeated_rows(odd):
    kept = [r.doc_id for r in simhash.keep_first(odd).collect()]
    assert kept.count(8) == 1 and 1 in kept and 2 not in kept and 3 in kept and 4 not in kept


def test_sums_of_sources_with_very_many_buckets(spark, monkeypatch):
    """Buckets' totals are summed in coarser buckets, twice over; the mix stays the same."""
    rows = [(f"s{i % 2}" if i % 5 else None, i // 2, i, i % 7) for i in range(3000)]
    plain, sums = {}, Counter()
    for g, _, k, v in rows:
        plain[k] = sums[g]
        sums[g] += v
    mixed = mixing.mix(docs_of(spark)).collect()
    monkeypatch.setattr(ranks, "_FAN", 8)
    table = spark.createDataFrame(rows, "g string, b long, k long, v long")
    got = ranks.prefix_sums(table, "g", "b", ["k"], "v", 1500, "before")
    assert got.columns == ["g", "b", "k", "v", "before"]
    assert {r.k: r.before for r in got.collect()} == plain
    monkeypatch.setattr(ranks, "_FAN", 2)
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 4)
    assert Counter(map(str, mixed)) == Counter(map(str, mixing.mix(docs_of(spark)).collect()))


def test_lines_without_python_and_words_written_once(spark, monkeypatch):
    """No step of the line dedup runs Python; of all lines, only those of the classes' table are written with their words."""
    plans, real = {}, linededup.scratch

    def spy(df, name):
        plans[name] = df._jdf.queryExecution().toString()
        return real(df, name)

    monkeypatch.setattr(linededup, "scratch", spy)
    out = linededup.removed_lines(spark.createDataFrame([(i, f"a b c d e f g h i{i % 2} j\nx{i} y") for i in range(4)], "doc_id long, text string"))
    plans["last"] = out._jdf.queryExecution().toString()
    assert "lines-entries" in plans and "lines" not in plans
    assert not [k for k, x in plans.items() if "InArrow" in x or "InPandas" in x or "PythonUDF" in x]


def test_lines_of_tokens_that_few_classes_have(spark, monkeypatch):
    """Tokens of few classes give their pairs at once, without leaders; the rows are the same with all tokens or none taken as such."""
    rows = [(i, "\n".join(" ".join(f"w{i // 3}x{k}" for k in range(30)) + f" end{i} {j}" for j in range(2)) + f"\nu{i} v{i} w{i} x{i} y{i} z{i}") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    counts, real = {}, linededup.scratch

    def spy(df, name):
        out = real(df, name)
        counts[name] = counts.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(linededup, "scratch", spy)
    monkeypatch.setattr(linededup, "CROWDED", 10**9)
    for few in (16, 1, 10**9):
        monkeypatch.setattr(linededup, "FEW", few)
        counts.clear()
        assert sorted((str(r.doc_id), r.line, r.removed) for r in linededup.removed_lines(docs).collect()) == plain_lines(rows)
        assert counts["lines-entries"] > 0 and (counts["lines-leaders"] == 0) == (few > 1)


def test_lines_whatever_the_sample_of_the_order(spark, monkeypatch):
    """the sample orders tokens and no more: the rows are the same with every class counted, one of 16, or none, and with any bucket ranked."""
    passage = " ".join(f"p{i}" for i in range(12))
    rows = [(i, f"{passage} " + " ".join(f"w{i // 3}x{k}" for k in range(40)) + f" end{i}\n  {passage} \t a{i}\n{passage} a{i // 2}\nu{i} v{i}") for i in range(30)]
    docs, seen, real = spark.createDataFrame(rows, "doc_id long, text string"), [], linededup.rarity
    monkeypatch.setattr(linededup, "FEW", 4)
    for sampled, least in ((1, 2), (16, 16), (1 << 62, 16)):
        monkeypatch.setattr(linededup, "LEAST_CROWDED", least)
        monkeypatch.setattr(linededup, "rarity", lambda found, n: seen.append(real(found, n, sampled)) or seen[-1])
        assert sorted((str(r.doc_id), r.line, r.removed) for r in linededup.removed_lines(docs).collect()) == plain_lines(rows)
    assert max(seen[0][0]) > 0 and max(seen[2][0]) == 0


def test_lines_tokens_worked_out_once_a_class(spark, monkeypatch):
    """few classes' pairs come from the written entries themselves, and pairs are verified by token sets that a class has once."""
    rows = [(i, " ".join(f"w{k}" for k in range(40)) + f" end{i}") for i in range(12)] + [(90 + i, f"z{i} y x w v u t") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    tables, real = {}, linededup.scratch

    def spy(df, name):
        out = real(df, name)
        tables.setdefault(name, []).append((out.columns, [tuple(r) for r in out.collect()]))
        return out

    monkeypatch.setattr(linededup, "CROWDED", 10**9)
    monkeypatch.setattr(linededup, "scratch", spy)
    assert sorted((str(r.doc_id), r.line, r.removed) for r in linededup.removed_lines(docs).collect()) == plain_lines(rows)
    columns, known = tables["lines-known"][0]
    assert "words" not in columns and len({r[:2] for r in known}) == len(known) == 12
    assert all({"d1", "d2"} <= {*c} and r for c, r in tables["lines-entries"]) and not tables["lines-placed"][0][1]


def test_lines_that_share_a_passage_are_not_compared(spark, monkeypatch):
    """tokens of a passage that lines share, and little else, are told from the others of their buckets and stay out of the prefixes."""
    passage = " ".join(f"p{i}" for i in range(12))
    rows = [(i, " ".join(f"u{i}x{k}" for k in range(30)) + f" {passage} " + " ".join(f"v{i}x{k}" for k in range(40))) for i in range(120)]
    docs, made, real = spark.createDataFrame(rows, "doc_id long, text string"), {}, linededup.scratch

    def spy(df, name):
        out = real(df, name)
        made[name] = made.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(linededup, "scratch", spy)
    monkeypatch.setattr(linededup, "FEW", 16)
    monkeypatch.setattr(linededup, "SKETCH", 256)
    assert sorted((str(r.doc_id), r.line, r.removed) for r in linededup.removed_lines(docs).collect()) == plain_lines(rows)
    assert made["lines-entries"] < 60
