"""Operators on single texts against plain Python: language filters, decontamination, quality, chat, tokens, toxicity."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphloom.llm import chat, decontaminate, langid, quality, rans, textvec, tokenfiles, tokens, toxicity
from graphloom.llm.textvec import binary

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def read(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


# --- language


def grams(text):
    out = []
    low = "".join(c.lower()[0] if c.isalpha() else " " for c in text)
    for w in low.split(" "):
        w = f" {w} "
        out += [w[i : i + k] for k in (3, 4) for i in range(len(w) - k + 1) if w.strip()]
    return out


def test_grams_are_those_of_single_words():
    texts = ["", "A", "Été, x-y  Ünder2words", " ", "日本 ab"]
    h, row, has = langid.grams(*binary(pa.array(texts)))
    assert [int((row == i).sum()) for i in range(len(texts))] == [len(grams(t)) for t in texts]
    assert has.tolist() == [False, True, True, False, True]


def test_language_of_held_out_rows(spark):
    docs = read(spark, "documents")
    out = langid.identify(docs, langid.fit(docs))
    rows = out.join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.95
    assert langid.drop_unknown(docs, langid.fit(docs)).count() == docs.count()


def plain_language(rows):
    """Filters as sets, counts by loops: doc_id to language and score."""
    learn = [(t or "", x) for d, t, x in rows if d is not None and x is not None and zlib.crc32(str(d).encode()) % 3 != 1]
    langs = sorted({x for _, x in learn})
    drawn, df = {x: sum(y == x for _, y in learn) for x in langs}, {}
    for t, x in learn:
        for g in set(grams(t)):
            df.setdefault(g, dict.fromkeys(langs, 0))[x] += 1
    own = {x: [] for x in langs}
    for g, by in df.items():
        best = max(by[x] / drawn[x] for x in langs)
        for x in langs:
            if by[x] >= 2 and by[x] / drawn[x] >= 0.25 * best:
                own[x].append(g)
    size = 1 << min(max(int(np.ceil(np.log2(16 * max(map(len, own.values()))))), 12), 22)

    def slots(g):
        h = len(g)
        for c in g:
            h = (h * 0x100000001B3 + ord(c)) % (1 << 64)
        h = int(textvec.mix(np.array([h], np.uint64))[0])
        return [(h >> 20 * k) % size for k in range(3)]

    filled = {x: {s for g in own[x] for s in slots(g)} for x in langs}
    wrong = {x: min((len(filled[x]) / size) ** 3, 0.99) for x in langs}
    default, out = max(langs, key=lambda x: (drawn[x], [-ord(c) for c in x])), {}
    for d, t, _ in rows:
        found = [slots(g) for g in grams(t or "")]
        if not found:
            out[d] = ("und", 0)
            continue
        c = {x: max(sum(all(s in filled[x] for s in g) for g in found) - len(found) * wrong[x], 0) / (1 - wrong[x]) for x in langs}
        top = max(langs, key=lambda x: (c[x], [-ord(k) for k in x])) if max(c.values()) else default
        out[d] = (top, c[top] / max(sum(c.values()), 1e-12))
    return out


def test_language_against_plain_sets(spark):
    docs = read(spark, "documents").where("doc_id % 2 = 0").select("doc_id", F.substring("text", 1, 900).alias("text"), "lang")
    rows = [tuple(r) for r in docs.collect()] + [(5001, None, "en"), (5003, "12 34", "de"), (5005, "Zzyzx qqq", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    want = plain_language(rows)
    got = langid.identify(docs, langid.fit(docs)).collect()
    assert {r.doc_id: r.lang_pred for r in got} == {d: x for d, (x, _) in want.items()}
    assert all(abs(r.score - want[r.doc_id][1]) < 1e-9 for r in got)


def test_unknown_language_goes(spark):
    docs = read(spark, "documents")
    more = spark.createDataFrame([(9001, "xqzvk wqjxz vvkqq zzxqj kkqxw " * 20), (9002, "12 34 !!"), (9003, None)], "doc_id long, text string")
    every = docs.unionByName(more, allowMissingColumns=True)
    assert {r.doc_id for r in langid.drop_unknown(every, langid.fit(docs)).collect()} == {r.doc_id for r in docs.collect()}


def test_language_odd_rows(spark, odd, none):
    docs = read(spark, "documents")
    filters = langid.fit(docs)
    by = {r.doc_id: r for r in langid.identify(odd, filters).collect()}
    assert by[3].lang_pred == by[4].lang_pred == by[5].lang_pred == "und" and by[3].score == 0
    assert by[7].lang_pred in filters.langs
    assert langid.identify(odd, filters).count() == odd.count()
    assert langid.identify(none, langid.fit(none)).count() == 0
    assert {r.lang_pred for r in langid.identify(odd, langid.fit(none)).collect()} == {"und"}
    assert {r.doc_id for r in langid.drop_unknown(odd, langid.fit(none)).collect()} >= {1, 2, 6, 8}


def test_bloom_filters_hold_what_they_were_given(spark):
    filters = langid.fit(read(spark, "documents"))
    h, row, _ = langid.grams(*binary(pa.array(["the of and", "der die und"])))
    c, total = filters.counts(h, row, 2)
    assert c.argmax(axis=1).tolist() == [filters.langs.index("en"), filters.langs.index("de")]
    assert (filters.rate < 0.05).all() and (total > 0).all()


def test_more_than_64_languages(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda n: letters[n // 26] + letters[n % 26] + "xyq"[n % 3] + letters[n % 26] + letters[n // 26]
    rows = [(100 * n + i, f"{word(n)} {word(n)}", f"l{n:03}") for n in range(140) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    filters = langid.fit(docs)
    assert len(filters.langs) == 140 and filters.slots.shape[0] == 3
    by = {r.doc_id: r.lang_pred for r in langid.identify(docs, filters).collect()}
    assert all(by[i] == lang for i, _, lang in rows)
    assert langid.drop_unknown(docs, filters).count() == len(rows)


# --- decontamination


def plain_leaks(docs, items):
    words = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())
    gram = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    out = []
    for doc_id, text in docs:
        own = words(text)
        for item_id, item in dict.fromkeys(items):
            w = words(item)
            n = min(5, len(w))
            if n:
                g = gram(w, n)
                k = len(g & gram(own, n))
                if k >= 0.8 * len(g) - 1e-9:
                    out.append((doc_id, item_id, k, len(g)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_words", [1 << 20, 40])
def test_leaks_against_all_pairs(spark, block_words):
    docs, items = read(spark, "documents"), read(spark, "benchmark")
    got = decontaminate.find_leaks(docs, items, block_words=block_words).collect()
    want = plain_leaks([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert sorted(((r.doc_id, r.item_id, r.n_shared, r.n_shingles) for r in got), key=str) == want and want
    bad = {w[0] for w in want}
    assert {r.doc_id for r in decontaminate.decontaminate(docs, items).collect()} == {r.doc_id for r in docs.collect()} - bad


def test_leaks_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, "ALPHA beta, gamma delta epsilon zeta"), (2, None), (3, " "), (4, "one"), (None, "a b c d e f"), (4, "one")], "item_id long, text string")
    want = plain_leaks([(r.doc_id, r.text) for r in odd.collect()], [(r.item_id, r.text) for r in items.collect()])
    got = decontaminate.find_leaks(odd, items).collect()
    assert sorted(((r.doc_id, r.item_id, r.n_shared, r.n_shingles) for r in got), key=str) == want
    assert decontaminate.find_leaks(none, items).count() == 0 and decontaminate.find_leaks(odd, items.where("1 = 0")).count() == 0


def test_short_items_inside_long_documents(spark):
    """Items of every size, whole, just over and just under the threshold, in one long text; and the SQL on items of fewer than five words."""
    import duckdb

    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([1, 2, 3, 4, 5, 6, 9, 14, 29, 60, 150])]
    pieces = []
    for _, text in items:
        w = text.split()
        pieces += [w, [word()], w[: max(1, int(0.85 * len(w)))], [word()], w[: len(w) // 2]]
    docs = [(1, " ".join(x for p in pieces for x in p)), (2, " ".join(word() for _ in range(3000)))] + [(10 + k, " ".join(p)) for k, p in enumerate(pieces)]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id, r.n_shared, r.n_shingles) for r in decontaminate.find_leaks(df, bench).collect()), key=str)
    assert got == plain_leaks(docs, items)
    c = duckdb.connect()
    c.register("documents", df.toPandas())
    c.register("benchmark", bench.toPandas())
    assert sorted([tuple(r[:4]) for r in c.sql(decontaminate.OP3_SQL).fetchall()], key=str) == got


# --- quality


def plain_counts(text):
    text = text or ""
    w = WORD.findall(text)
    seen = {}
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality(spark, odd, none):
    for docs in (read(spark, "documents"), odd):
        rows = docs.select("doc_id", "source", "text").collect()
        got = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.quality(docs).collect())
        want = []
        for r in rows:
            n, c, s, d, p = plain_counts(r.text)
            want.append((str(r.doc_id), n, c, s, d, p, n < 50 or 100 * p > 50 * n))
        assert got == sorted(want)
    assert quality.quality(none).count() == 0


def plain_verdicts(rows, rules, max_rate=0.5, z=1.645):
    """rows: (host, failed by rule). (host, rule): (trusted, rejected), by plain loops."""
    out, hosts = {}, sorted({h for h, *_ in rows}, key=str)
    for k, rule in enumerate(rules):
        n = {h: sum(r[0] == h for r in rows) for h in hosts}
        f = {h: sum(r[0] == h and r[1][k] for r in rows) for h in hosts}
        mean = sum(f.values()) / len(rows)
        spread = sum(f[h] ** 2 / n[h] for h in hosts) / len(rows) - mean**2 - mean * (1 - mean) * len(hosts) / len(rows)
        strength = min(max(mean * (1 - mean) / spread - 1, 1), 1e6) if spread > 0 else 1e6
        for h in hosts:
            rate = (f[h] + mean * strength) / (n[h] + strength)
            margin = z * (rate * (1 - rate) / (n[h] + strength + 1)) ** 0.5
            out[h, rule] = (rate + margin < mean, rate - margin > mean and rate > max_rate)
    return out


def test_host_verdicts(spark):
    """A bad host is rejected, a good one trusted with its few failures, documents of the others go by the rules."""
    plain, piped = "some clean words that make a line of prose", "# | some & words | with * marks $ in % them"
    text = lambda host, i: "".join(" ".join(f"{w}{k}" for w in (piped if i * 37 % 100 < {"bad": 80, "good": 1, None: 24, "new": 30}[host] else plain).split()) + "\n" for k in range(8))
    rows = [(i, h, text(h, i)) for h, n in (("bad", 200), ("good", 400), (None, 200), ("new", 10)) for i in range(n)]
    got = quality.quality(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    failed = lambda r: [getattr(r, x) for x in quality.RULES]
    want = plain_verdicts([(r.source, failed(r)) for r in got], list(quality.RULES))
    assert want["bad", "symbols"] == (False, True) and want["good", "symbols"] == (True, False) and not any(want["new", "symbols"])
    for r in got:
        rejected = any(want[r.source, x][1] for x in quality.RULES)
        lost = any(y and not want[r.source, x][0] for x, y in zip(quality.RULES, failed(r), strict=True))
        assert (r.host_rejected, r.host_rule_failed) == (rejected, lost) and r.kept == (not r.base_failed and not rejected and not lost)
    assert {r.kept for r in got if r.source == "bad"} == {False} and {r.kept for r in got if r.source == "good"} == {True}
    assert {r.kept for r in got if r.source is None} == {True, False}


# --- chat


def test_chat_round_trip(spark):
    rng = random.Random(3)
    parts = ["\\", "### ", "</turn>", "\n", ": ", "é", "x", "#", "<", "\n</turn>\n", "\\\\### "]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "a: b\\<", None]), rng.choice([None, "", "".join(rng.choices(parts, k=rng.randint(0, 12)))])) for c in range(30) for t in range(rng.randint(1, 7))]
    rows += [(None, None, "user", "u"), (None, 1, "assistant", "long " * 20000), (99, 1, "assistant", "a"), (99, 1, "assistant", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.digests(chat.examples(df)).collect()}
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, _, role, x in turns if role == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256) == (len(turns), sha("".join(f"{a}\n{b}\n" for _, _, a, b in turns)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))
    out = chat.examples(df).collect()
    assert sum(r.loss_start is not None for r in out) == sum(role == "assistant" for _, _, role, _ in rows)
    assert chat.digests(chat.examples(df.where("1 = 0"))).count() == 0


def test_chat_ignores_other_columns(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    clash = df.withColumns({x: F.lit(9) for x in ("turns", "example", "last", "formatted", "n_turns", "loss", "body", "head")})
    assert chat.digests(chat.examples(clash)).collect() == chat.digests(chat.examples(df)).collect()


# --- tokens


def test_rans_round_trip_and_checkpoints():
    rng = np.random.default_rng(1)
    for n in (0, 1, 511, 513, 70_000):
        ids = np.minimum(rng.geometric(0.01, n), 3000).astype(np.uint32)
        freq = rans.quantise(np.bincount(ids, minlength=3001) if n else np.ones(3))
        assert freq.sum() == 1 << rans.BITS
        coder = rans.Coder(freq)
        block = coder.encode(ids, lanes=64, every=16)
        assert (coder.decode(block) == ids).all()
        if n > 64 * 32:
            assert (coder.decode(block, 2) == ids[64 * 32 :]).all()
        with pytest.raises(ValueError):
            coder.decode(block[:-5] + bytes([block[-5] ^ 1]) + block[-4:])


def test_token_files(spark, odd, none, tmp_path):
    from tokenizers import Tokenizer

    path = tokenfiles.public_tokenizer()
    tok = Tokenizer.from_file(path)
    extra = ["don't we're 'said I'll ''s !'s it'S", "été ÀÇ×÷ß µ ª²", "a1b22 3.14%%", "<|endoftext|> hi", "日本 é", "\x85 a\xa0b\x00", "'t", "é's É're"]
    more = spark.createDataFrame([(100 + i, t) for i, t in enumerate(extra)], "doc_id long, text string")
    for k, docs in enumerate((read(spark, "documents").select("doc_id", "text"), odd.select("doc_id", "text").union(more), none)):
        tokenfiles.write(docs, f"{tmp_path}/{k}", path, block_ids=5000)
        got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in tokenfiles.read(spark, f"{tmp_path}/{k}").collect()]
        rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in docs.collect()))
        want, at = [], 0
        for some, doc_id, text in rows:
            ids = tok.encode(text, add_special_tokens=False).ids + [1]
            want.append((doc_id if some else None, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            at += len(ids)
        assert sorted(got, key=str) == sorted(want, key=str)


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") & 1] for i in range(n))


@pytest.mark.parametrize("weak", [False, True])
def test_words_of_one_hash_keep_their_ids(weak, monkeypatch):
    """Ids are the library's though hashes collide."""
    if weak:
        real = tokens.span_hashes
        monkeypatch.setattr(tokens, "span_hashes", lambda raw, a, b: real(raw, a, b) & np.uint64(63))
    with open(tokenfiles.public_tokenizer(), encoding="utf-8") as f:
        encoder = tokens.Encoder(f.read())
    assert encoder.fast
    word = thue_morse(2048)
    texts = [word, word.translate({97: 98, 98: 97}), "", "alpha beta gamma " * 3, "unrelated words, many of them; 12 34", "alphabetical orders aplhabetical", "x" * 9 + " " + "x" * 17 + " " + "x" * 16]
    for some in (texts, texts[::-1]):
        ids, n = encoder.encode(*binary(pa.array(some)), 1)
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [[*own, 1] for own in encoder.whole(some)]


def test_other_tokenizer_files(spark, tmp_path):
    """A file with another split goes through the library; so does one whose ids need 32 bits."""
    from tokenizers import Tokenizer

    path = tokenfiles.public_tokenizer("byte_bpe_50k.json")
    big = Tokenizer.from_file(path)
    big.add_tokens([f"<extra{i}>" for i in range(20_000)])
    big.save(str(tmp_path / "big.json"))
    rows = [(i, t) for i, t in enumerate(["Hello  World", "don't <extra19999> x", None, "\u65e5\u672c A\nB"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for k, file in enumerate((path, str(tmp_path / "big.json"))):
        tok = Tokenizer.from_file(file)
        tokenfiles.write(docs, f"{tmp_path}/other{k}", file)
        got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in tokenfiles.read(spark, f"{tmp_path}/other{k}").collect()}
        ids = {i: tok.encode(t or "", add_special_tokens=False).ids + [1] for i, t in rows}
        assert got == {i: (len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in ids.items()}
    assert max(ids[1]) > 1 << 16


# --- toxicity


def test_nearest_are_exact(spark):
    rng = np.random.default_rng(2)
    space = toxicity.Space(np.sort(rng.integers(1, 1 << 62, 60).astype(np.uint64)), rng.random(60) + 0.1)
    vectors = []
    for _ in range(500):
        t = np.sort(rng.choice(60, rng.integers(0, 8), replace=False))
        vectors.append((t, space.weights(t, rng.integers(1, 5, len(t)).astype(float))))
    ix = toxicity.Index(space, list(range(500)), rng.integers(0, 2, 500).astype(float), np.ones(500), vectors)
    dense = np.zeros((len(ix.vectors), 60))
    for i, (t, w) in enumerate(ix.vectors):
        dense[i, t] = w
    for t, w in vectors[:100]:
        q = np.zeros(60)
        q[t] = w
        want = np.sort((dense @ q)[dense @ q > 0])[::-1][:16]
        assert np.allclose(ix.nearest(t, w, 16)[1], want)


def test_toxicity(spark, odd, none):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    index = toxicity.fit(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs, index).collect()}
    held = [(got[r.doc_id], r.toxic) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    pos, neg = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([np.mean([(p > n) + 0.5 * (p == n) for n in neg]) for p in pos]) > 0.7
    assert all(0 <= r.score <= 1 for r in toxicity.score(odd, index).collect())
    assert toxicity.score(odd, index).count() == odd.count() and toxicity.score(none, index).count() == 0
    bare = toxicity.fit(docs, labels.where("1 = 0"))
    assert {r.score for r in toxicity.score(odd, bare).collect()} == {bare.score(bare.none)}
    toxicity.fit(none, labels)


def plain_terms(text):
    out = {}
    for w in re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").lower().encode()):
        for t in ((0, w), (4, w[:4]), (5, w[:5])):
            out[t] = out.get(t, 0) + 1
    return out


def test_toxicity_neighbours_over_all_terms(spark):
    docs, labels = read(spark, "documents"), read(spark, "labels")
    texts = {r.doc_id: plain_terms(r.text) for r in docs.collect()}
    examples = sorted({r.doc_id for r in labels.collect() if r.doc_id in texts and zlib.crc32(str(r.doc_id).encode()) % 5})
    space = {t: i for i, t in enumerate(sorted({t for d in examples for t in texts[d]}))}
    df = np.array([sum(t in own for own in texts.values()) for t in space])
    vectors = {}
    for d, own in texts.items():
        vectors[d] = np.zeros(len(space))
        for t, n in own.items():
            if t in space:
                vectors[d][space[t]] = (1 + np.log(n)) * np.log(1 + len(texts) / df[space[t]])
        vectors[d] /= max(np.linalg.norm(vectors[d]), 1e-300)
    table = np.array([vectors[d] for d in examples])
    index = toxicity.fit(docs, labels)
    assert len(index.space.terms) == len(space) and {y for y in index.labels} == {0.0, 1.0}
    for r in toxicity.score(docs, index).collect():
        cosine = table @ vectors[r.doc_id]
        assert np.allclose(r.cosines, np.sort(cosine[cosine > 1e-12])[::-1][:16])
        assert np.allclose(r.cosines, [cosine[examples.index(d)] for d in r.neighbours])


def test_toxicity_labels_and_texts_that_repeat(spark):
    rows = [(i, f"w{i} common") for i in range(40)] + [(1, "a first text")] * 50 + [(None, "w1"), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, (-3, 0, 1, 7)[i % 4]) for i in range(40)] + [(3, None), (None, 1), (4, 1)], "doc_id long, toxic int")
    index = toxicity.fit(docs, labels)
    learned = {i for i in range(40) if zlib.crc32(str(i).encode()) % 5}
    assert set(index.ids) == learned and len(index.ids) == len(learned)
    assert {i: y for i, y in zip(index.ids, index.labels, strict=True)} == {i: float(i % 4 > 1 or i == 4) for i in learned}
    if 1 in learned:
        assert toxicity.score(docs.where("text = 'a first text'"), index).first().neighbours[0] == 1


def test_toxicity_finds_words_that_do_not_depend_on_labels(spark):
    rows = [(i, f"common words w{i} here") for i in range(60)] + [(1000 + i, f"w{i}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    index = toxicity.fit(docs, labels)
    got = {r.doc_id: r.neighbours[:1] for r in toxicity.score(docs, index).collect()}
    for i in range(60):
        if zlib.crc32(str(i).encode()) % 5:
            assert got[1000 + i] == [i]


def test_toxicity_votes_by_words_that_tell(spark):
    """Long texts differ in one word: votes of alike texts must not drown it. Scores against plain sums over shared terms."""
    rng = np.random.default_rng(5)
    words = [f"{rng.integers(1 << 30):x}q" for _ in range(3000)]
    rows = []
    for i in range(900):
        own = rng.choice(words[:60] * 50 + words, 200).tolist()  # 60 words are in most texts
        rows.append((i, " ".join(own + ["vile", "vile"] * (i % 8 == 0)), int(i % 8 == 0)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    index = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, index).collect()}
    held = [(got[i].score, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    worst = np.quantile([s for s, y in held if not y], 0.9)
    assert np.mean([s > worst for s, y in held if y]) > 0.95

    texts = {i: plain_terms(t) for i, t, _ in rows}
    label = {i: rows[i][2] for i in index.ids}
    df = Counter(t for own in texts.values() for t in own)
    have = [Counter(t for i, y in label.items() if y == own for t in texts[i]) for own in (0, 1)]
    of = [sum(y == own for y in label.values()) for own in (0, 1)]

    def vector(i):
        v = {t: (1 + math.log(n)) * math.log(1 + len(rows) / df[t]) for t, n in texts[i].items() if have[0][t] + have[1][t]}
        length = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / length for t, x in v.items()}

    def tells(t):
        a, b = have[1][t] + 0.5, have[0][t] + 0.5
        return max(0, abs(math.log(a / (of[1] + 1) / b * (of[0] + 1))) - 2 * math.sqrt(1 / a + 1 / b))

    mass = dict(zip(index.ids, index.mass.tolist(), strict=True))
    for i in range(0, 900, 45):
        query, up, down = vector(i), 1e-3 * index.usual * index.none, 1e-3 * index.usual
        for j in got[i].neighbours:
            other = vector(j)
            w = sum(x * other[t] * (tells(t) + 0.01) for t, x in query.items() if t in other) ** 2 * mass[j]
            up, down = up + w * label[j], down + w
        assert np.isclose(got[i].score, index.score(up / down))
