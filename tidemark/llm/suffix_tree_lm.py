"""Operator 5: language-model scoring by a probabilistic suffix tree over words.

Tokens are words and one end a text; a text begins after an end. The tree's contexts are the sequences of up to DEPTH
tokens that N training tokens hold RATE * sqrt(N) times or more (and LEAST at least): the share that a context must have
falls as the corpus grows, so the tree grows too, by the root of N contexts a depth and all that follows them. A context is retained if a G-test says that what follows it diverges from what its longest retained suffix says.
Next-token distributions cover the whole vocabulary: the root is the unigram smoothed by one, and a retained context has
(count + MU * kinds * probability in its longest retained suffix) / (occurrences + MU * kinds), where kinds is the number of
different tokens that follow it. A token is scored in the longest retained suffix of what precedes it in its text.

Plan: documents become chunks of at most CHUNK tokens. For each depth, a chunk sends every different (context, next token)
that it holds once, with its training count, to the bucket of the context, where the counts meet and contexts are tested;
what a chunk asked about goes back to it in the same order. Sequences whose count is under LEAST end there, so later depths
move less. Contexts that make up HOT of all tokens (at most 1 / HOT of them) are dealt out over all buckets by the next
token, and only their sums meet. Buckets hold about ENTRIES entries at any corpus size; what moves is a row for each chunk and bucket that have an entry in
common, so never more rows than entries. Chunks are tables bucketed by chunk, so that only questions and
answers move; a chunk keeps codes into its own vocabulary, not hashes. No table of the model is collected
or broadcast, but for the hot contexts' sums. Of next tokens, 48 bits of the hash tell them apart within a context.

Nulls: a null text is the end alone; a null doc_id counts as '' in the split and trains. Repeated rows train and are
returned as often as they occur. Very long texts are chunks of their own. Other columns are ignored; an empty table gives
an empty result, and with no training rows N and V are 0 and every score is that of the root. Nothing depends on ties.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import forget, forget_buckets, saved_at, saved_buckets, sliced, table

#: A context's least occurrences: RATE times the root of all training tokens, and at least LEAST.
RATE, LEAST, DEPTH, MU, CHUNK = 0.01, 20, 4, 2.0, 1 << 20
#: G-test: a context is retained if G exceeds its degrees of freedom by so many standard deviations, and its divergence (nats) is at least GAIN.
SIGMAS, GAIN = 4.0, 0.01
ENTRIES, HOT = 1 << 19, 1 / 256
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
END = xxhash.xxh64_intdigest(b"\x20end", 0)  # a blank is in no word
DOC = np.dtype([("doc_id", np.int64), ("null", np.int8), ("held", np.int8), ("n", np.int64), ("known", np.int64), ("base", np.float64), ("score", np.float64)])


def _pack(a: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(a).tobytes(), 1)


def _unpack(b: bytes, kind) -> np.ndarray:
    return np.frombuffer(zlib.decompress(b), kind)


def _box(**arrays: np.ndarray) -> bytes:
    """Arrays by name; hashes and probabilities don't compress."""
    return pickle.dumps({k: (v.dtype.descr if v.dtype.names else v.dtype.str, raw := v.dtype in (np.uint64, np.float32), v.tobytes() if raw else _pack(v)) for k, v in arrays.items()})


def _open(box: bytes) -> dict[str, np.ndarray]:
    return {k: np.frombuffer(v, np.dtype(kind)) if raw else _unpack(v, np.dtype(kind)) for k, (kind, raw, v) in pickle.loads(box).items()}


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


# --- chunks and their vocabularies ----------------------------------------------------------------------------------

CHUNKS = "chunk long, n_train long, entries long, body binary"


def _chunk(key: int, docs: list, codes: list[np.ndarray], ids: dict[bytes, int]) -> dict:
    """Codes are ranks by frequency within the chunk, so that they compress well. The end has an entry of its own."""
    n, flat = len(ids) + 1, np.concatenate(codes)
    info = np.zeros(len(docs), DOC)
    info["doc_id"], info["null"], info["held"], info["n"] = zip(*docs, strict=True)
    order = np.argsort(-np.bincount(flat, minlength=n), kind="stable")
    rank = np.empty(n, np.uint32)
    rank[order] = np.arange(n)
    flat = rank[flat]
    h = np.array([END, *[xxhash.xxh64_intdigest(w, 0) for w in ids]], np.uint64)[order]
    train = np.repeat(info["held"] == 0, info["n"])
    return {"chunk": key, "n_train": int(train.sum()), "entries": n, "body": _box(docs=info, hash=h, count=np.bincount(flat[train], minlength=n), codes=flat)}


def _encode(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k = TaskContext.get().partitionId(), 0
        docs, codes, ids, tokens = [], [], {}, 0
        kinds = pa.schema([(x, pa.binary() if x == "body" else pa.int64()) for x in _names(CHUNKS)])

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([_chunk(part << 32 | k, docs, codes, ids)], kinds)

        for batch in sliced(batches):
            for doc, text, held in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "held")), strict=True):
                found = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
                if docs and tokens + len(found) >= size:
                    yield out()
                    k, docs, codes, ids, tokens = k + 1, [], [], {}, 0
                new = ids.setdefault
                codes.append(np.append(np.fromiter((new(w, len(ids) + 1) for w in found), np.uint32, len(found)), np.uint32(0)))
                docs.append((doc or 0, doc is None, held, len(found) + 1))
                tokens += len(found) + 1
        if docs:
            yield out()

    return run


def encode(docs: DataFrame, held: Column | None = None, size: int = CHUNK) -> DataFrame:
    """Chunks of docs (doc_id, text); held: what is not trained on."""
    text_id = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    held = F.crc32(text_id) % 7 == 2 if held is None else held
    return docs.select(F.col("doc_id").cast("long"), "text", held.alias("held")).mapInArrow(_encode(size), CHUNKS)


def _where(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(40)) % np.uint64(buckets)).astype(np.int32)


def _cuts(where: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(where, kind="stable")
    return order, np.searchsorted(where[order], np.arange(buckets + 1))


VOCAB = "bucket int, chunk long, hash binary, n binary"


def _deal_words(buckets: int):
    """Each chunk's vocabulary, cut by hash."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for chunk, body in zip(batch["chunk"], batch["body"], strict=True):
                x = _open(body)
                h, n = x["hash"], x["count"]
                order, ends = _cuts(_where(h, buckets), buckets)
                cut = [(b, order[ends[b] : ends[b + 1]]) for b in range(buckets) if ends[b + 1] > ends[b]]
                yield pd.DataFrame([(b, int(chunk), h[i].tobytes(), _pack(n[i])) for b, i in cut], columns=_names(VOCAB))

    return run


BACK = "kind string, chunk long, bucket int, a long, b double, c long, counts binary, kinds binary"


def _count_words(pdf: pd.DataFrame) -> pd.DataFrame:
    """One bucket: the total of each word, back to the chunks in their order; how many words are known."""
    own = [np.frombuffer(x, np.uint64) for x in pdf["hash"]]
    h, inverse = np.unique(np.concatenate(own), return_inverse=True)
    total = np.bincount(inverse, np.concatenate([_unpack(x, np.int64) for x in pdf["n"]]), len(h)).astype(np.int64)
    back, bucket, at, out = total[inverse], int(pdf["bucket"].iloc[0]), 0, []
    for chunk, x in zip(pdf["chunk"], own, strict=True):
        out.append(("back", int(chunk), bucket, 0, 0.0, 0, _pack(back[at : at + len(x)]), None))
        at += len(x)
    return pd.DataFrame([*out, ("total", 0, bucket, int((total > 0).sum()), 0.0, 0, None, None)], columns=_names(BACK))


def _returned(order: np.ndarray, right: pd.DataFrame, column: str) -> np.ndarray:
    """What came back for a chunk's entries, in the order of the entries."""
    parts = [_unpack(x, np.int64) for x in right.sort_values("bucket")[column]]
    out = np.zeros(len(order), np.int64)
    if parts:
        out[order] = np.concatenate(parts)
    return out


# --- contexts -------------------------------------------------------------------------------------------------------

STATE = "chunk long, entries long, hot array<long>, body binary"


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of a context that goes on with a token."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Asked:
    """What a chunk asks about at one depth.

    docs with what is decided so far; place and entry of the tokens that go on; entries by (context, next): the context's
    hash and occurrences n, the next token's hash, its probability p so far and the chunk's training count.
    """

    def __init__(self, body: bytes, least: float, total: int, known: int):
        x = _open(body)
        self.docs = x["docs"].copy()
        self.starts = np.cumsum(self.docs["n"]) - self.docs["n"]
        if "codes" in x:  # contexts of one token, read off the words
            codes, h, count = x["codes"], x["hash"], x["count"]
            end = codes[self.starts[0] + self.docs["n"][0] - 1]
            before = np.concatenate(([end], codes[:-1]))
            before[self.starts] = end
            self.place = np.flatnonzero(count[before] >= least)
            first, self.entry, self.train = entries_of(before[self.place].astype(np.int64) * len(h) + codes[self.place], self.trained(self.place))
            u, w = before[self.place][first], codes[self.place][first]
            self.context, self.next, self.n = h[u], h[w], count[u]
            self.p = ((count + 1) / (total + known + 1))[w]
        else:
            self.place, self.entry = np.cumsum(x["place"].astype(np.int64)), x["entry"].astype(np.int64)
            self.context, self.next = x["contexts"][x["context"]], x["words"][x["next"]]
            self.n, self.p, self.train = x["n"][x["context"]], x["p"].astype(np.float64), x["train"]

    def trained(self, place: np.ndarray) -> np.ndarray:
        return (self.docs["held"] == 0)[self.doc(place)]

    def doc(self, place: np.ndarray) -> np.ndarray:
        return np.repeat(np.arange(len(self.docs), dtype=np.int32), self.docs["n"])[place]

    def buckets(self, buckets: int, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        where = _where(self.context, buckets)
        if len(hot):
            where = np.where(np.isin(self.context, hot), _where(self.next, buckets), where)
        return _cuts(where, buckets)


def entries_of(pair: np.ndarray, trains: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different pairs: one place of each, the entry of each token, training counts."""
    _, first, entry = np.unique(pair, return_index=True, return_inverse=True)
    return first, entry, np.bincount(entry, trains, len(first)).astype(np.int64)


def _root(buckets: int, total: int, known: int, least: float, hot: float):
    """From a chunk and its words' counts: base columns, the scores of tokens after rare ones, and what is asked at depth 1."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in left.itertuples():
            x = _open(row.body)
            docs, h, codes = x["docs"].copy(), x["hash"], x["codes"]
            count = _returned(_cuts(_where(h, buckets), buckets)[0], right[right["chunk"] == row.chunk], "counts")
            log = np.log10((count + 1) / (total + known + 1))
            starts = np.cumsum(docs["n"]) - docs["n"]
            docs["known"] = np.add.reduceat((count > 0)[codes].astype(np.int64), starts)
            docs["base"] = np.add.reduceat(log[codes], starts)
            before = np.concatenate((codes[:1], codes[:-1]))
            before[starts] = codes[docs["n"][0] - 1]
            on = count[before] >= least
            docs["score"] = np.add.reduceat(np.where(on, 0.0, log[codes]), starts)
            out.append((row.chunk, int(on.sum()), h[count >= hot].view(np.int64).tolist(), _box(docs=docs, hash=h, count=count, codes=codes)))
        return pd.DataFrame(out, columns=_names(STATE))

    return run


DEALT = "bucket int, chunk long, context binary, size binary, next binary, n binary, p binary"


def _deal(buckets: int, hot: np.ndarray, *model):
    """Each chunk's entries by bucket; within one, by context."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for chunk, body in zip(batch["chunk"], batch["body"], strict=True):
                a = Asked(body, *model)
                bits = np.round(-512 * np.log2(a.p)).clip(0, 65535).astype(np.uint16)
                order, ends = a.buckets(buckets, hot)
                out = []
                for b in range(buckets):
                    if ends[b + 1] > ends[b]:
                        i = order[ends[b] : ends[b + 1]]
                        c = a.context[i]
                        cut = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1])))
                        out.append((b, int(chunk), c[cut].tobytes(), _pack(np.diff(np.append(cut, len(i))).astype(np.uint32)), a.next[i].view(np.uint8).reshape(-1, 8)[:, 2:].tobytes(), _pack(a.train[i].astype(np.uint32)), _pack(bits[i])))
                yield pd.DataFrame(out, columns=_names(DEALT))

    return run


def diverges(n: np.ndarray, gain: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """gain: n times the divergence in nats of what follows a context from what its suffix says."""
    df = np.maximum(kinds - 1, 1)
    return (2 * gain > df + SIGMAS * np.sqrt(2 * df)) & (gain > GAIN * n)


def _count(hot: np.ndarray):
    """One bucket: the total of each entry and, of retained contexts, the kinds, back to the chunks; of hot contexts, sums."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        size = [_unpack(x, np.uint32).astype(np.int64) for x in pdf["size"]]
        context = np.concatenate([np.repeat(np.frombuffer(c, np.uint64), s) for c, s in zip(pdf["context"], size, strict=True)])
        after = np.zeros((len(context), 8), np.uint8)
        after[:, 2:] = np.frombuffer(b"".join(pdf["next"]), np.uint8).reshape(-1, 6)
        after = after.view(np.uint64).reshape(-1)
        train = np.concatenate([_unpack(x, np.uint32) for x in pdf["n"]]).astype(np.int64)
        bits = np.concatenate([_unpack(x, np.uint16) for x in pdf["p"]])
        order = np.lexsort((after, context))
        c, a = context[order], after[order]
        new_c = np.concatenate(([True], c[1:] != c[:-1]))
        start = np.flatnonzero(new_c | np.concatenate(([True], a[1:] != a[:-1])))
        total = np.add.reduceat(train[order], start)
        inner = np.flatnonzero(new_c[start])
        seen = total > 0
        log = np.where(seen, total * (np.log(np.maximum(total, 1)) + bits[order][start] * (np.log(2) / 512)), 0.0)
        n, gain, kinds = (np.add.reduceat(x, inner) for x in (total, log, seen.astype(np.int64)))
        own = c[start[inner]]
        spread = np.isin(own, hot)
        keep = np.where(diverges(n, gain - n * np.log(np.maximum(n, 1)), kinds) & ~spread, kinds, 0)
        back, kept = np.empty(len(c), np.int64), np.empty(len(c), np.int64)
        back[order] = np.repeat(total, np.diff(np.append(start, len(c))))
        kept[order] = np.repeat(keep, np.diff(np.append(start[inner], len(c))))
        bucket, at, out = int(pdf["bucket"].iloc[0]), 0, []
        for chunk, s in zip(pdf["chunk"], size, strict=True):
            to = at + int(s.sum())
            out.append(("back", int(chunk), bucket, 0, 0.0, 0, _pack(back[at:to]), _pack(kept[at:to])))
            at = to
        out += [("hot", int(x), bucket, int(i), float(g), int(k), None, None) for x, i, g, k in zip(own[spread].view(np.int64), n[spread], gain[spread], kinds[spread], strict=True)]
        return pd.DataFrame(out, columns=_names(BACK))

    return run


def _apply(buckets: int, hot: np.ndarray, hot_kinds: np.ndarray, hot_least: float, mu: float, last: bool, *model):
    """From what a chunk asked and what came back: probabilities in retained contexts; what it asks about contexts one longer."""
    least = model[0]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in left.itertuples():
            a = Asked(row.body, *model)
            order, _ = a.buckets(buckets, hot)
            mine = right[right["chunk"] == row.chunk]
            count, kinds = _returned(order, mine, "counts"), _returned(order, mine, "kinds")
            if len(hot):
                at = np.minimum(np.searchsorted(hot, a.context), len(hot) - 1)
                kinds = np.where(hot[at] == a.context, hot_kinds[at], kinds)
            p = np.where(kinds > 0, (count + mu * kinds * a.p) / (a.n + mu * kinds), a.p)
            on = np.zeros(len(a.place), np.bool_)
            if not last and len(a.place):
                on[1:] = (np.diff(a.place) == 1) & (count[a.entry[:-1]] >= least) & (a.place[1:] != a.starts[a.doc(a.place[1:])])
            a.docs["score"] += np.bincount(a.doc(a.place[~on]), np.log10(p[a.entry[~on]]), len(a.docs))
            i = np.flatnonzero(on)
            contexts, context = np.unique(a.entry[i - 1], return_inverse=True)
            words, after = np.unique(a.next[a.entry[i]], return_inverse=True)
            first, entry, train = entries_of(context * max(len(words), 1) + after, a.trained(a.place[i]))
            h, n = joined(a.context[contexts], a.next[contexts]), count[contexts]
            body = _box(docs=a.docs, place=np.diff(a.place[i], prepend=0).astype(np.uint32), entry=entry.astype(np.uint32), contexts=h, n=n, words=words, context=context[first].astype(np.uint32), next=after[first].astype(np.uint32), p=p[a.entry[i[first]]].astype(np.float32), train=train)
            out.append((row.chunk, len(first), h[n >= hot_least].view(np.int64).tolist(), body))
        return pd.DataFrame(out, columns=_names(STATE))

    return run


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _listed(total: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body in batch.column("body").to_pylist():
                d = _open(body)["docs"]
                yield pa.RecordBatch.from_arrays([pa.array(d["doc_id"], mask=d["null"] == 1), pa.array(d["held"] == 1), pa.array(d["n"]), pa.array(d["known"]), pa.array(np.full(len(d), total)), pa.array(d["base"]), pa.array(d["score"])], _names(SCORES))

    return run


def score(docs: DataFrame, least: float | None = None, depth: int = DEPTH, mu: float = MU, chunk: int = CHUNK) -> DataFrame:
    """SCORES for each row of docs. least: a context's least occurrences, by the rule above if None."""
    spark = docs.sparkSession
    at_least = spark.sparkContext.defaultParallelism
    state, path = saved_buckets(encode(docs, size=chunk), "chunks", "chunk")
    asked, total = state.agg(F.sum("entries"), F.sum("n_train")).first()
    if asked is None:
        return spark.createDataFrame([], SCORES)
    least = max(LEAST, RATE * total**0.5) if least is None else max(least, 1)
    buckets = max(at_least, -(-asked // ENTRIES))
    told, told_at = saved_at(state.select("chunk", "body").mapInPandas(_deal_words(buckets), VOCAB).groupBy("bucket").applyInPandas(_count_words, BACK), "word-counts")
    known = told.where("kind = 'total'").agg(F.coalesce(F.sum("a"), F.lit(0))).first()[0]
    model, hot_least = (least, total, known), max(1.0, HOT * total)
    make = _root(buckets, total, known, least, hot_least)
    for k in range(depth + 1):
        back = told.where("kind = 'back'").select("chunk", "bucket", "counts", "kinds")
        old, (state, path) = path, saved_buckets(state.select("chunk", "body").groupBy("chunk").cogroup(back.groupBy("chunk")).applyInPandas(make, STATE), "asked", "chunk")
        forget_buckets(spark, old)
        forget(spark, told_at)
        asked = state.agg(F.sum("entries")).first()[0]
        if k == depth or not asked:
            break
        buckets = max(at_least, -(-asked // ENTRIES))
        hot = np.sort(np.array([r[0] for r in state.select(F.explode("hot")).distinct().collect()], np.int64).view(np.uint64))  # at most 1 / HOT
        dealt = state.where("entries > 0").select("chunk", "body").mapInPandas(_deal(buckets, hot, *model), DEALT)
        told, told_at = saved_at(dealt.groupBy("bucket").applyInPandas(_count(hot), BACK), "context-counts")
        sums = {r[0] % (1 << 64): r[1:] for r in told.where("kind = 'hot'").groupBy("chunk").agg(F.sum("a"), F.sum("b"), F.sum("c")).collect()}  # at most 1 / HOT
        n, gain, kinds = (np.array([sums[int(x)][i] for x in hot], float) for i in range(3))
        hot_kinds = np.where(diverges(n, gain - n * np.log(np.maximum(n, 1)), kinds), kinds, 0).astype(np.int64)
        make = _apply(buckets, hot, hot_kinds, hot_least, mu, k + 1 == depth, *model)
    return state.select("body").mapInArrow(_listed(total), SCORES)


def op5_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
