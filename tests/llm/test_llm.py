import hashlib
import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.llm import benchmark_windows, chat_format, common, pii_votes, quality_llr, secret_scan, simhash_dedup, source_mix, suffix_tree_lm, url_redirects, warc_archive

DOCS = "doc_id long, text string, source string, size long, kind string"  # size and kind clash with names inside the operators
TEXT = " ".join(f"word{i} and{i % 7}" for i in range(60))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, TEXT, "a"), (2, TEXT, "a"), (2, TEXT, "a"), (3, TEXT.replace("word3 ", "wurd3 "), None), (4, None, "b"), (5, "", "b"), (6, "one", "b"), (None, TEXT, None), (7, "x y " * 30000, "c"), (8, "Ünï cödé\nÜnï cödé\n\n\nlast & # line", "c")]
    return spark.createDataFrame([(*r, 9, "k") for r in rows], DOCS).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101), (101, 100), (5, 5), (None, 3)], "src long, dst long")
    got = {r["node"]: r["component"] for r in common.components(edges).collect()}
    assert got == {i: 0 for i in range(31)} | {100: 100, 101: 100}
    assert common.components(edges.limit(0)).count() == 0


def test_simhash_links_and_edges(spark, docs, empty):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 40, dtype=np.int64)
    near = [int(b) ^ sum(1 << int(i) for i in rng.choice(63, k, replace=False)) for b in base for k in range(6)]
    fps = sorted(set(map(int, base)) | set(near))
    for tile in (20_000, 2):
        links = simhash_dedup.links(spark.createDataFrame([(x,) for x in fps], "fp long"), tile=tile)
        got = {r["node"]: r["component"] for r in common.components(links).collect()}
        label = {x: x for x in fps}
        for _ in range(12):
            for x in fps:
                label[x] = min(label[y] for y in fps if (x ^ y).bit_count() <= 4)
        want = Counter(label.values())
        assert sorted(Counter(got.get(x, x) for x in fps).values()) == sorted(want.values())
    rows = simhash_dedup.near_duplicates(docs).collect()
    assert len(rows) == docs.count() and {r["doc_id"]: r["component_id"] for r in rows}[2] == 1
    assert [r["component_id"] for r in rows if r["doc_id"] in (4, 5)] == [4, 4] and [r["component_id"] for r in rows if r["doc_id"] is None] == [1]
    assert simhash_dedup.near_duplicates(empty).count() == 0


def repeated(words):
    at, hit = {}, set()
    for i in range(len(words) - 7):
        at.setdefault(tuple(words[i : i + 8]), []).append(i)
    for places in at.values():
        if len(places) > 1:
            hit |= {p + k for p in places for k in range(8)}
    return len(hit)


def test_quality(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (None, 1, 0), (8, 0, 1)], "doc_id long, quality int, toxic int")
    got = quality_llr.quality(docs, labels).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert len(got) == docs.count()
    for r in got:
        w = texts[r["doc_id"]].split()
        lines = [x for x in texts[r["doc_id"]].split("\n") if x.strip()]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"], r["n_dup_lines"], r["n_symbols"]) == (len(w), sum(map(len, w)), repeated(w), len(lines) - len(set(lines)), sum(c in "#*$%&|<>" for c in texts[r["doc_id"]]))
        assert r["base_failed"] == (len(w) < 20 or 100 * repeated(w) > 30 * len(w)) and not (r["base_failed"] and r["kept"])
    assert quality_llr.quality(empty, labels).count() == 0
    assert {r["llr_score"] for r in quality_llr.quality(docs, labels.limit(0)).collect()} == {0.0}


def test_warc(spark, tmp_path):
    big = "x" * 2000
    pages = spark.createDataFrame([(1, "http://a/", big), (3, "http://b/", big), (2, None, None), (4, "http://c/", "small"), (5, "http://d/", "small"), (None, "http://e/", big)], "page_id long, url string, html string")
    warc_archive.write_archives(pages, str(tmp_path / "w"), roll=500)
    rows = warc_archive.read_archives(spark, str(tmp_path / "w")).collect()
    assert Counter(r["kind"] for r in rows) == {"record": 6}
    by = {r["record_id"]: r for r in rows}
    assert by["1"]["record_type"] == "revisit" and by["1"]["refers_to"] == "3" and by["1"]["payload_bytes"] == 2000 and by["1"]["payload_digest"] == hashlib.sha1(big.encode()).hexdigest()
    assert by["5"]["record_type"] == "response" and by["2"]["payload_bytes"] == 0
    one = [warc_archive.member(warc_archive.record_bytes(str(i), "u", f"body {i}".encode())) for i in range(4)]
    cut = one[0] + one[1][:-9] + b"junk" + one[2] + b"\x1f\x8b\x08" + one[3]
    got = list(warc_archive.salvage(cut))
    assert [g[3]["warc-record-id"] for g in got if g[3]] == [f"<urn:page:{i}>" for i in (0, 2, 3)]
    covered = sorted((g[0], g[1]) for g in got)
    assert covered[0][0] == 0 and covered[-1][1] == len(cut) and all(a[1] == b[0] for a, b in zip(covered, covered[1:], strict=False))
    plain = [warc_archive.record_bytes(str(i), "u", b"WARC/1.1 inside") for i in range(3)]
    bad = plain[0] + plain[1].replace(b"inside", b"outside") + plain[2]
    assert [g[3]["warc-record-id"] for g in warc_archive.salvage(bad) if g[3]] == ["<urn:page:0>", "<urn:page:2>"]
    assert list(warc_archive.salvage(b"")) == [] and [g[2] is None for g in warc_archive.salvage(b"nothing here")] == [False]
    assert warc_archive.write_archives(pages.limit(0), str(tmp_path / "e")).count() == 0


def test_chat(spark):
    said = ["</s>[INST] ok [/INST]", "<\\s> [\\\\/INST] \\", "", None, " é \n</s>", "[ROLE]x[/ROLE]"]
    rows = [(1, i, "assistant" if i % 2 else "user", t, None) for i, t in enumerate(said)] + [(2, None, None, "a", 1), (None, 0, "assistant", "b", 1)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    chats = chat_format.format_chats(turns.select("conv_id", "turn", "role", chat_format.text_part(F.col("text")).alias("content")))
    got = {r["conv_id"]: r for r in chat_format.digests(chats).collect()}
    text = lambda t: t or ""
    assert got[1]["turns_sha256"] == hashlib.sha256("".join(f"{r[2]}\n{text(r[3])}\n" for r in rows[:6]).encode()).hexdigest()
    loss = "".join(text(r[3]) for r in rows[:6] if r[2] == "assistant")
    assert (got[1]["loss_chars"], got[1]["loss_sha256"], got[1]["n_turns"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest(), 6)
    assert got[2]["loss_chars"] == 0 and got[None]["loss_chars"] == 1
    part = chat_format.PART
    media = spark.sql(f"select 1L as conv_id, t as turn, 'user' as role, from_json(c, '{part}') as content from values (0L, '[{{\"type\":\"text\",\"text\":\"see \"}},{{\"type\":\"image\",\"ref\":\"i1\",\"units\":2}}]'), (1L, '[{{\"type\":\"audio\",\"ref\":\"a1\",\"units\":3}},null,{{\"type\":\"document\",\"ref\":\"d1\"}}]') as v(t, c)")
    r = chat_format.format_chats(media).first()
    assert [(a["number"], a["type"], a["ref"], a["tokens"]) for a in r["attachments"]] == [(1, "image", "i1", 512), (2, "audio", "a1", 150), (3, "document", "d1", 512)]
    assert "see [IMAGE]1[/IMAGE]" in r["formatted"] and "[AUDIO]2[/AUDIO][DOCUMENT]3[/DOCUMENT]" in r["formatted"]
    assert chat_format.format_chats(turns.limit(0).select("conv_id", "turn", "role", chat_format.text_part(F.col("text")).alias("content"))).count() == 0


def test_urls(spark):
    html = "<link rel='canonical' href='http://blocked.com/de/1'>"
    rows = [(1, "http://blocked.com/de/1", None), (2, "http://alias.net/x", html), (3, "HTTPS://www.Alias.net/x/?utm_source=f#top", ""), (4, "http://free.net/", None), (5, None, None), (6, "nothing", None), (7, "http://x.com/fr/1", html), (8, "http://far.net/y", None), (9, "http://a.example.org/en/12", None)]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, rule string")
    redirects = spark.createDataFrame([("http://far.net/y", "http://near.com/de/z"), (None, "u")], "src string, dst string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_redirects.judge(pages, redirects=redirects).collect()}
    assert got[1][2:] == ("com/de/", "block") and got[9] == ("a.example.org", "/en/12", "example.org/en/1", "block")
    assert got[7][2:] == ("com/fr/", "allow") and got[2][3] == "allow" and got[3] == ("www.alias.net", "/x/", None, "allow")  # the allow of 7 reaches its aliases
    assert got[8][3] == "block" and got[4][3] == "allow" and got[5] == ("", "", None, "allow") and got[6][3] == "allow"
    without = {r["page_id"]: r["verdict"] for r in url_redirects.judge(pages.where("page_id <> 7")).collect()}
    assert without[2] == without[3] == "block" and without[8] == "allow"
    assert url_redirects.judge(pages.limit(0)).count() == 0


def test_suffix_tree(spark, docs, empty):
    got = suffix_tree_lm.score(docs, least=2).collect()
    count, n = Counter(), 0
    tokens = lambda t: (t or "").encode().translate(suffix_tree_lm.LOWER).split() + [b" "]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for i, t in rows:
        if not held(i):
            count.update(tokens(t))
            n += len(tokens(t))
    want = sorted((str(i), held(i), len(tokens(t)), round(sum(math.log10((count[w] + 1) / (n + len(count) + 1)) for w in tokens(t)), 5)) for i, t in rows)
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], round(r["base_score"], 5)) for r in got) == want
    assert all(r["train_tokens"] == n and r["score"] < 0 for r in got) and sum(r["score"] for r in got) > sum(r["base_score"] for r in got)
    assert suffix_tree_lm.score(empty).count() == 0
    big = spark.createDataFrame([((1 << 60) + 1, "a b"), (None, "a"), (3, None)], "doc_id long, text string").coalesce(1)
    assert sorted(str(x["doc_id"]) for x in suffix_tree_lm.score(big).collect()) == sorted(map(str, ((1 << 60) + 1, None, 3)))


def test_secrets(spark, empty):
    rng = np.random.default_rng(3)
    key = "".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"), 44))
    text = f"é secret:token:abcdefghijklmnop Password = \"hunter2hunter2\" AKIAABCDEFGHIJKLMN {'0123456789abcdef' * 2} key_id={key} aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa1"
    rows = spark.createDataFrame([(1, text, 1), (2, None, 1), (None, "", 1)], "doc_id long, text string, base int")
    got = {r["doc_id"]: r for r in secret_scan.scan(rows).collect()}
    found = {(secret_scan.KINDS[s["kind"]], text[s["start"] : s["stop"]]) for s in [*got[1]["base"], *got[1]["random"]]}
    assert ("assign", 'Password = "hunter2hunter2') in found and ("access", "AKIAABCDEFGHIJKLMN") in found and ("hex", "0123456789abcdef" * 2) in found and ("random", key) in found
    assert not any("token:abc" in v or v.startswith("aaaa") for _, v in found if _ != "hex") and got[2]["base"] == [] == got[None]["random"]
    assert secret_scan.scan(empty).count() == 0


def test_secrets_found_and_left(spark):
    """Planted random strings of every encoding and length among names and counters that are as long."""
    rng, digits = np.random.default_rng(12), "0123456789"
    b64 = [x[2] for x in secret_scan.ENCODINGS]
    words = ["get", "User", "Account", "name", "By", "List", "item", "count", "Default", "page", "index", "Order", "total", "Map"]
    planted, rows, ids = [], [], iter(range(10**6))
    for _ in range(500):
        k = int(rng.integers(0, 3))
        value = "".join(rng.choice(list(b64[k]), int(rng.integers(24, 64)))).replace("/", "Z").replace("+", "9")
        if any(c in value for c in digits) and (k or any(c > "9" for c in value)):
            value = value.upper() if k == 0 else value  # lower-case hex is a base pattern
            planted.append((i := next(ids), value))
            rows.append((i, f"see {value} there"))
    for _ in range(500):
        name = "_".join(rng.choice(words, 8)) + str(rng.integers(0, 99)) if rng.random() < 0.7 else "-".join(["0000", "1111", "2222"] * 4) + "ABAB" * int(rng.integers(1, 5))
        rows.append((next(ids), f"call {name} there"))
    got = {(r["doc_id"], s["start"]) for r in secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect() for s in r["random"]}
    right = sum((i, 4) in got for i, _ in planted)
    assert right >= 0.9 * len(planted) and len(got) - right <= 0.1 * len(got), (right, len(planted), len(got))


def test_many_matches(spark):
    hexes = " ".join(f"é{i:016x}" for i in range(2000))
    got = secret_scan.scan(spark.createDataFrame([(1, hexes)], "doc_id long, text string")).first()["base"]
    want = [m.span() for m in re.finditer("[0-9a-f]{16,}", hexes)]
    assert [(s["start"], s["stop"]) for s in got] == want


def test_personal_data_by_votes(spark):
    """Loose kinds beside contexts are found, chapter and part numbers of the same shape are left."""
    r = np.random.default_rng(4)
    rows, mine = [], set()
    for i in range(600):
        a, b, c = r.integers(200, 899), r.integers(200, 999), r.integers(1000, 9999)
        kind, of = i % 3, i % 2
        if kind == 0:
            text = f"please call my phone {a}-{b}-{c} today" if of else f"see version 1{a % 100:02d}.1{b % 100:02d} {c}, page 1{a % 100:02d}-1{b % 100:02d}-{c}"
        elif kind == 1:
            text = f"her social security ssn is {a % 665 + 1:03d}-{b % 99 + 1:02d}-{c}" if of else f"issue 000-{b % 99 + 1:02d}-{c} of the section"
        else:
            text = f"contact mail j{a} (at) host{b} (dot) com" if of else f"mail x@host{b}.com and 10.0.{b % 255}.7"
        rows.append((i, text))
        if of:
            mine.add(i)
    got = {x["doc_id"] for x in pii_votes.detect(spark.createDataFrame(rows, "doc_id long, text string")).collect() for s in x["spans"] if s["kind"] >= pii_votes.BASE}
    assert len(got & mine) >= 0.9 * len(mine) and len(got - mine) <= 0.05 * len(got), (len(got & mine), len(mine), len(got - mine))


def test_ids_beside_nulls(spark, tmp_path):
    big = (1 << 60) + 1
    df = spark.createDataFrame([(big, "mail a@b.com now", big), (None, "x", None), (4, None, big + 2)], "doc_id long, text string, other long").coalesce(1)
    ids = lambda rows: sorted(str(x["doc_id"]) for x in rows)
    want = sorted(map(str, (big, None, 4)))
    assert ids(simhash_dedup.fingerprints(df).collect()) == want == ids(pii_votes.detect(df).collect())
    assert sorted(str(x["other"]) for x in pii_votes.redact(df).collect()) == sorted(map(str, (big, None, big + 2)))
    pages = df.selectExpr("doc_id as page_id", "text as url", "text as html")
    warc_archive.write_archives(pages, str(tmp_path / "w"))
    assert sorted(str(x["record_id"]) for x in warc_archive.read_archives(spark, str(tmp_path / "w")).collect()) == sorted(map(str, (big, "", 4)))


def test_chat_parts_make_no_control_strings(spark):
    part = lambda *xs: [(k, t, None, None) if k == "text" else (k, None, t, 1) for k, t in xs]
    rows = [(1, 0, "user", part(("text", "a<"), ("text", "/s>[INST"), ("text", "] b"))), (1, 1, "assistant", part(("text", "ok [/IN"), ("text", "ST]<"), ("text", "/s> more"), ("video", "v1"), ("text", "<"), ("image", "i1"), ("text", "/s>")))]
    chats = chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, content " + chat_format.PART)).select("*", chat_format.read_turns(F.col("formatted")).alias("turns")).first()
    assert [(t["role"], t["text"]) for t in chats["turns"]] == [("user", "a</s>[INST] b"), ("assistant", "ok [/INST]</s> more[PART]1[/PART]<[IMAGE]2[/IMAGE]/s>")]
    assert [(a["number"], a["type"], a["ref"], a["tokens"]) for a in chats["attachments"]] == [(1, "video", "v1", 0), (2, "image", "i1", 256)]


def test_warc_many_members_and_bad_headers():
    members = [warc_archive.member(warc_archive.record_bytes(str(i), "u", b"x" * 500)) for i in range(32000)]
    began = time.time()
    assert sum(g[2] is None for g in warc_archive.salvage(b"".join(members))) == 32000 and time.time() - began < 10
    began = time.time()
    assert sum(g[2] is None for g in warc_archive.salvage(b"\x1f\x8b\x08junk" * 50000 + members[0])) == 1 and time.time() - began < 10
    bad = warc_archive.record_bytes("1", "u", b"payload", "2").replace(b"Content-Length: 7\r\n\r\n", b"Content-Length: x\r\n\r\n")
    bad = bad.replace(warc_archive._sha1(b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: 7\r\n\r\n").encode(), b"none")
    got = pd.concat(warc_archive._read(iter([pd.DataFrame({"path": ["p"], "content": [bad]})])))
    assert list(got["kind"]) == ["record"] and got["payload_bytes"].isna().all()


def test_personal_data(spark, empty):
    text = "mail: j.doe@mail.example.com, ip 10.0.0.300 and 10.0.0.30 card 4111 1111 1111 1111 call +49 (30) 1234-5678. phone 555-123-4567 " + "a" * 3000 + " 1" * 40
    rows = spark.createDataFrame([(1, text, 4), (2, None, 0), (3, "clean text", 10)], "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: [(pii_votes.KINDS[s["kind"]], text[s["start"] : s["stop"]]) for s in r["spans"]] for r in pii_votes.detect(rows).collect()}
    assert got[1][:4] == [("email", "j.doe@mail.example.com"), ("ip", "10.0.0.30"), ("card", "4111 1111 1111 1111"), ("phone", "+49 (30) 1234-5678")] and got[2] == [] == got[3]
    clean = {r["doc_id"]: r for r in pii_votes.redact(rows).collect()}
    assert "<EMAIL>" in clean[1]["text"] and "4111" not in clean[1]["text"] and clean[1]["n_chars"] == len(clean[1]["text"]) and clean[2]["text"] is None and clean[3]["text"] == "clean text"
    assert pii_votes.detect(empty).count() == 0
    assert pii_votes.emails("a@b.c@d.e x@y @z.de q@r.st") == [(0, 5), (20, 26)]


def test_mix(spark, docs, empty):
    assert source_mix.targets({"a": 10, "b": 100, None: 1}) == pytest.approx({"a": 30, None: 3, "b": 78})
    got = source_mix.mix(docs).collect()
    assert len(got) == docs.count() and all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    total = Counter()
    for r in got:
        total[r["source_size"], r["target"]] += r["taken"]
    assert all(abs(v - t) <= max(0.02 * t, 4) for (_, t), v in total.items())
    assert sorted(map(str, source_mix.mix(docs).collect())) == sorted(map(str, got))
    assert source_mix.mix(empty).count() == 0


def test_leaks(spark, empty):
    item = [f"it{i}" for i in range(40)]
    changed = [*item[:39], "other"]
    far = [*item[:15], "other", *item[16:]]
    make = lambda w: " ".join(["pre"] * 30 + w + [f"post{i}" for i in range(50)])
    rows = spark.createDataFrame([(1, make(item), 1), (2, make(changed), 1), (3, make(far), 1), (4, None, 1), (5, " ".join(item[:38]), 1), (6, "Is THIS it now", 1), (1, make(item), 1)], "doc_id long, text string, n int")
    items = spark.createDataFrame([(10, " ".join(item).upper()), (11, None), (12, "is this it"), (13, "")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in benchmark_windows.leaks(rows, items).collect()}
    assert set(got) == {(1, 10), (2, 10), (5, 10), (6, 12)}
    assert got[1, 10]["start"] == 30 and got[1, 10]["similarity"] == 1.0 and got[2, 10]["similarity"] == pytest.approx(35 / 37)
    assert benchmark_windows.leaks(empty, items).count() == 0 and benchmark_windows.leaks(rows, items.limit(0)).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    good = [f"{i} " + " ".join(f"good{(i * 37 + j * j) % 900}" for j in range(40)) for i in range(12)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(good)] + [(20, good[1], "en", "s1", 9), (21, "short", "en", "s1", 5), (22, good[2] + " " + " ".join(f"b{k}" for k in range(30)), "en", "s2", 9), (23, None, None, None, None)]
    rows[3] = (3, good[3] + " mail me@here.com", "en", "s0", 9)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(24)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, " ".join(f"b{k}" for k in range(30)))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == list(range(12))


def test_warc_members_of_several_records():
    noise = np.random.default_rng(2).integers(32, 126, (9, 3000), dtype=np.uint8)
    plain = [warc_archive.record_bytes(str(i), "u", noise[i].tobytes() + b" inside") for i in range(9)]
    ids = lambda data: [g[3]["warc-record-id"] for g in warc_archive.salvage(data) if g[3]]
    want = lambda *n: [f"<urn:page:{i}>" for i in n]
    bad = plain[:4] + [plain[4].replace(b" inside", b"outside")] + plain[5:]
    whole = warc_archive.member(b"".join(bad))
    assert ids(whole) == want(0, 1, 2, 3, 5, 6, 7, 8)
    at = len(b"".join(plain[:4]))
    assert [g[2] for g in warc_archive.salvage(whole) if g[2]] == [f"block digest differs (plain bytes {at} to {at + len(plain[4])})"]
    good = warc_archive.member(b"".join(plain))
    assert ids(good) == want(*range(9)) and ids(good[: len(good) * 3 // 5] + warc_archive.member(plain[8])) == want(0, 1, 2, 3, 4, 8)


def test_url_targets_outside_the_pages(spark):
    tag = lambda u: f"<link rel='canonical' href='{u}'>"
    rows = [(1, "http://free.net/a", tag("http://x.com/de/9")), (2, "http://m.com/q/a?x=1", tag("/de/1")), (3, "http://n.com/q/r/a", tag("../../de/./1#t")), (4, "https://o.net/", "<meta http-equiv=refresh content='0; url=//p.com/de/3'>"), (5, "http://r.net/", tag("mailto:a@x.com")), (6, "http://s.com", tag("de/2")), (7, "nothing", tag("/de/1")), (8, "http://t.com/q/", tag("?y=2")), (9, "http://www.free.net/a/", None)]
    got = {r["page_id"]: r["verdict"] for r in url_redirects.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow", 6: "block", 7: "allow", 8: "allow", 9: "block"}
