"""Operators that SQL can't express, held against plain versions."""

import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import benchmark_windows, pii_votes, quality_llr, secret_scan, simhash_dedup, source_mix, suffix_tree_lm


def noise(seed, alphabet, pieces, n):
    r = random.Random(seed)
    return ["".join(r.choice(pieces) if r.random() < 0.3 else r.choice(alphabet) for _ in range(r.randrange(0, 60))) for _ in range(n)]


def test_personal_data_patterns():
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card = re.compile(r"[0-9]([\x20-]?[0-9])+")
    phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    pieces = ["ab@c.de", "10.0.0.255", "4111 1111 1111 1111", "+49 (30) 123-456", "256.1.1.1", "378282246310005", "@x.y", "..", "é"]
    for text in noise(7, "a.@-+% 1(9", pieces, 4000):
        want = [(0, *m.span()) for m in email.finditer(text)]
        want += [(1, *m.span()) for m in ip.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
        want += [(2, *m.span()) for m in card.finditer(text) if 13 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and pii_votes.luhn(d)]
        want += [(3, *m.span()) for m in phone.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
        assert pii_votes.base_spans(text) == want, text


def test_secret_patterns(spark):
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    pieces = ["password=", "Token: ", "api_key", "APIKEY='", "secret", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "deadbeefcafe", "é", "𝒳", "ſ", "K", '"', " = "]
    texts = [None, "", *noise(11, "aF0:= /", pieces, 1500)]
    got = {r["doc_id"]: r["base"] for r in secret_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        text = text or ""
        want = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 12 and m[1].isascii()]
        want += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
        want += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
        assert [tuple(s) for s in got[i]] == sorted(want), text


def test_leaks_against_all_windows(spark):
    r = random.Random(5)
    word = lambda: f"w{r.randrange(3000)}"
    items = [[word() for _ in range(r.randrange(30, 70))] for _ in range(8)] + [["la", "li", "lu"] * 12, [word() for _ in range(6)]]
    docs = []
    for i in range(60):
        body = list(items[i % len(items)])
        for _ in range(r.randrange(0, 4)):
            at = r.randrange(len(body))
            body[at : at + r.randrange(0, 2)] = [word() for _ in range(r.randrange(0, 2))]
        docs.append([word() for _ in range(r.randrange(0, 20))] + body + [word() for _ in range(r.randrange(0, 20))])
    shingles = lambda w: [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    want = {}
    for d, doc in enumerate(docs):
        for i, item in enumerate(items):
            a, b = shingles(doc), shingles(item)
            width = min(len(a), len(b))
            best = 0.0
            for start in range(len(a) - width + 1):
                common = sum((Counter(a[start : start + width]) & Counter(b)).values())
                best = max(best, common / (width + len(b) - common))
            if best >= 0.8 - 1e-12:
                want[d, i] = best
    frame = lambda rows, name: spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(rows)], f"{name} long, text string")
    got = {(x["doc_id"], x["item_id"]): x["similarity"] for x in benchmark_windows.leaks(frame(docs, "doc_id"), frame(items, "item_id")).collect()}
    assert len(want) > 20 and set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)


def test_likelihood_ratio(spark):
    r = np.random.default_rng(4)
    texts = {i: " ".join(f"{'é' if i % 5 else 'q'}{x}" for x in r.integers(0, 40 if i % 2 else 400, r.integers(0, 60))) for i in range(80)}
    good, bits = {i for i in texts if i % 4 == 1}, 10
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    text_hash = lambda w: signed(xxhash.xxh64_intdigest(w.encode(), 42))
    pair_hash = lambda a, b: xxhash.xxh64_intdigest(struct.pack("<q", b), xxhash.xxh64_intdigest(struct.pack("<q", a), 42))

    def buckets(text):
        w = text.split()
        h = [text_hash(x) for x in w]
        return [x % (1 << bits) for x in [text_hash(x[-3:]) for x in w] + [pair_hash(a, b) for a, b in zip(h, h[1:], strict=False)]]

    raw, target = Counter(), Counter()
    for i, t in texts.items():
        raw.update(buckets(t))
        target.update(buckets(t) if i in good else [])
    n, m, size = sum(raw.values()), sum(target.values()), 1 << bits
    llr = {b: math.log(((target[b] + 1) / (m + size)) / ((raw[b] + 1) / (n + size))) for b in raw}
    labels = spark.createDataFrame([(i, 1 if i in good else 0, 0) for i in texts], "doc_id long, quality int, toxic int")
    for x in quality_llr.quality(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), labels, bits).collect():
        own = buckets(texts[x["doc_id"]])
        assert x["n_grams"] == len(own) and x["llr_score"] == pytest.approx(sum(llr[b] for b in own) / len(own) if own else 0.0)
        assert x["kept"] == (not x["base_failed"] and x["llr_score"] >= quality_llr.THRESHOLD)


def test_fingerprints(spark):
    texts = [None, "", " \t\n", "One", "a B  c", "Ä ö\x0bü x", "x y " * 500, *noise(13, "ab C\n", ["Word ", "é ", "\u00a0", "word "], 300)]

    def plain(text):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
        grams = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    got = {r["doc_id"]: r["fp"] % (1 << 64) for r in simhash_dedup.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: plain(t) for i, t in enumerate(texts)}


def test_mix_schedule(spark, monkeypatch):
    monkeypatch.setattr(source_mix, "SLOTS", 1 << 8)
    r = random.Random(3)
    docs = [(i, " ".join(["w"] * r.randrange(0, 60 if i % 3 else 9)), [None, "b", "a", "a", "é"][i % 5]) for i in range(200)]
    size = {i: len(t.split()) for i, t, _ in docs}
    sizes = Counter()
    for i, _, s in docs:
        sizes[s] += size[i]
    aim, total = source_mix.targets(sizes), sum(sizes.values())
    order, block = ["a", "b", "é", None], total // source_mix.SLOTS
    text = {i: t for i, t, _ in docs}
    signed = lambda h: h - ((h >> 63) << 64)
    mixed = lambda i: signed(xxhash.xxh64_intdigest(b"mix", xxhash.xxh64_intdigest(struct.pack("<q", signed(xxhash.xxh64_intdigest(text[i].encode(), 42))), xxhash.xxh64_intdigest(struct.pack("<q", i), 42))))
    rings = {s: [i for i in sorted((i for i, _, x in docs if x == s), key=mixed) for _ in range(size[i])] for s in order}
    rank, taken = Counter(), Counter()
    for slot in range(round(total / block)):
        point = sum((slot >> b & 1) / 2 ** (b + 1) for b in range(40))
        ends = [sum(aim[x] for x in order[: k + 1]) / total for k in range(4)]
        s = order[min(sum(e <= point for e in ends), 3)]
        if rank[s] < 3 * sizes[s] // block:
            taken.update(rings[s][(rank[s] * block + k) % sizes[s]] for k in range(min(block, sizes[s])))
        rank[s] += 1
    assert block > 1 and math.isclose(sum(aim.values()), total)
    got = {x["doc_id"]: (x["size"], x["taken"]) for x in source_mix.mix(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()}
    assert got == {i: (size[i], taken[i]) for i in size}


def test_suffix_tree_scores(spark):
    r = random.Random(8)
    phrases = [["the", "old", "man", "and", "the", "sea"], ["a", "b", "a", "c"], ["the", "old", "sea", "a"], ["x", "y", "z", "x", "y", "w"], ["p", "q", "q", "q", "r"], ["t", "q", "q", "q", "u"]]
    texts = [" ".join(x for _ in range(r.randrange(0, 12)) for x in (r.choice(phrases) if r.random() < 0.8 else [f"odd{r.randrange(300)}"])) for _ in range(200)]
    least, depth, mu, end = 4, 4, 2.0, " "
    rows = {i: [*t.split(), end] for i, t in enumerate(texts)}
    train = [w for i, w in rows.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    count = Counter(x for w in train for x in w)
    n = sum(count.values())
    root = lambda x: (count[x] + 1) / (n + len(count) + 1)
    follow = {}
    for w in train:
        s = [end, *w]
        for i in range(1, len(s)):
            for k in range(1, min(depth, i) + 1):
                follow.setdefault(tuple(s[i - k : i]), Counter())[s[i]] += 1
    kept = {}

    def prob(context, x):
        while context and context not in kept:
            context = context[1:]
        if not context:
            return root(x)
        c = kept[context]
        return (c[x] + mu * len(c) * prob(context[1:], x)) / (c.total() + mu * len(c))

    for k in range(1, depth + 1):
        for context, c in [(a, b) for a, b in follow.items() if len(a) == k and b.total() >= least]:
            gain, df = sum(v * math.log(v / c.total() / prob(context[1:], x)) for x, v in c.items()), max(len(c) - 1, 1)
            if 2 * gain > df + 4 * math.sqrt(2 * df) and gain > 0.01 * c.total():
                kept[context] = c
    assert {len(c) for c in kept} == {1, 2, 3, 4} and any(len(a) == 2 and a not in kept and b.total() >= least for a, b in follow.items())

    def plain(w):
        s = [end, *w]
        return sum(math.log10(prob(tuple(s[max(0, i - depth) : i]), s[i])) for i in range(1, len(s)))

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for size in (1 << 20, 40):
        got = suffix_tree_lm.score(docs, least=least, depth=depth, mu=mu, chunk=size).collect()
        assert len(got) == len(rows)
        for x in got:
            assert x["score"] == pytest.approx(plain(rows[x["doc_id"]]), rel=1e-4), x["doc_id"]


def test_pipeline_without_rows(spark, tmp_path):
    import corpus_pipeline

    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(50)), "en", "a", 9, 7, "x"), (None, None, None, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long, component_id long, kind string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([], "item_id long, text string")
    for name, d in (("some", docs), ("none", docs.limit(0))):
        for table, rows in (("documents", d), ("labels", labels), ("benchmark", items)):
            rows.write.parquet(str(tmp_path / name / f"{table}.parquet"))
        now = spark.read.parquet(str(tmp_path / name / "documents.parquet"))
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, str(tmp_path / name))
            assert now.columns == docs.columns
        out = corpus_pipeline.run(spark, str(tmp_path / name)).select("doc_id", F.col("taken") > 0).collect()
        assert [tuple(x) for x in out] == ([(1, True)] if name == "some" else [])


def test_pipeline_keeps_columns(spark, tmp_path):
    import corpus_pipeline

    big, text = (1 << 60) + 1, lambda k: " ".join(f"w{(i * 7 + k * k) % 997}{k}" for i in range(60))
    rows = [(big, text(1) + " a@b.com", "en", "s", 1, None, "x"), (None, text(2), "en", "s", 1, big, "y"), (None, text(3) + " 10.0.0.1", None, None, 1, big + 2, None), (5, text(4), "en", "s", 1, 3, "z"), (5, text(5), "en", "t", 1, None, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size long, _text_hash long, _d string")
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "no such words in any text at all here")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == [*docs.columns, "size_", "source_size", "target", "taken"]
    clean = lambda t: t.replace("a@b.com", "<EMAIL>").replace("10.0.0.1", "<IP>")
    assert sorted(map(str, ((*r[: len(rows[0])],) for r in out.collect()))) == sorted(str((r[0], clean(r[1]), *r[2:])) for r in rows)


def test_pipeline_near_copies(spark):
    import corpus_pipeline

    r = random.Random(9)
    word = lambda: f"w{r.randrange(4000)}"
    passage, texts = [word() for _ in range(30)], []
    for i in range(60):
        base = [word() for _ in range(r.randrange(3, 120))] + (passage if i % 2 else [])
        for _ in range(r.randrange(1, 6) if i else 25):
            copy = list(base)
            for _ in range(r.randrange(0, 5)):
                copy[r.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    texts += [None, "", "One two", "one  TWO", texts[0], None]
    r.shuffle(texts)
    ids = [i // 2 if i % 40 == 1 else None if i % 41 == 2 else i for i in range(len(texts))]

    def plain(text):
        w = (text or "").lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}

    sets, label = [plain(t) for t in texts], list(range(len(texts)))
    near = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    for _ in range(30):
        for i, j in near:
            label[i] = label[j] = min(label[i], label[j])
    assert any(sets[i] != sets[j] and len(sets[i] & sets[j]) < 0.9 * len(sets[i] | sets[j]) for i, j in near)
    groups = {}
    for i, k in enumerate(label):
        groups.setdefault(k, []).append((ids[i] is None, ids[i] or 0, i))
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string"), "").collect()
    assert sorted(str(x["doc_id"]) for x in got) == sorted(str(ids[min(g)[2]]) for g in groups.values())
    of = {(ids[i], texts[i]): label[i] for i in range(len(texts))}
    assert len(got) == len({of[x["doc_id"], x["text"]] for x in got}) == len(groups)


def test_pipeline_leaks_by_text(spark, tmp_path):
    import corpus_pipeline

    item, clean = " ".join(f"b{k}" for k in range(30)), " ".join(f"c{k}" for k in range(40))
    rows = [(1, clean + " " + item), (1, clean), (None, item + " x"), (None, clean + " y"), (None, None), (2, item.upper()), (3, "z " + clean), (2, item.upper())]
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    shingles = lambda t: {tuple(w[k : k + 5]) for w in [(t or "").lower().split()] for k in range(len(w) - 4)}
    want = [x for x in rows if len(shingles(x[1]) & shingles(item)) < 0.8 * len(shingles(item))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(x) for x in corpus_pipeline.decontaminate(spark, docs, str(tmp_path)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(want) == 4
    twice = spark.createDataFrame([(None, clean), (None, clean), (None, clean + " y z"), (7, clean)], "doc_id long, text string")
    assert [tuple(x) for x in corpus_pipeline.near_dedup(spark, twice, "").collect()] == [(7, clean)]


def test_mix_small_sources(spark, monkeypatch):
    monkeypatch.setattr(source_mix, "SLOTS", 1 << 7)
    texts = [("big", 3000)] * 10 + [("other", 4000)] * 5 + [("tiny", 7), ("tiny", 13), (None, 60), ("nothing", 0), ("z", 1), ("one", 250), ("one", 333)]
    docs = spark.createDataFrame([(i, " ".join(["w"] * n), s) for i, (s, n) in enumerate(texts)], "doc_id long, text string, source string")
    sizes, taken = Counter(), Counter()
    for s, n in texts:
        sizes[s] += n
    assert sum(sizes.values()) // source_mix.SLOTS > 3 * sizes[None]  # a block is longer than the targets of three sources
    aim = source_mix.targets(sizes)
    for x in source_mix.mix(docs).collect():
        assert x["size"] == texts[x["doc_id"]][1] and x["taken"] <= 3 * x["size"]
        taken[texts[x["doc_id"]][0]] += x["taken"]
    assert {s: taken[s] for s in ("tiny", None, "nothing", "z", "one")} == {"tiny": 60, None: 180, "nothing": 0, "z": 3, "one": 1749}
    assert all(abs(taken[s] - aim[s]) <= 0.05 * aim[s] for s in ("big", "other"))
