"""Operator 7: personal data by weak supervision.

Patterns give base spans (email, ip, card, phone), which always stay. Beside them, looser finders give candidates (mail
addresses in words, phone numbers without +, social security and IBAN numbers, hexadecimal IPs). On each candidate three
kinds of labelers vote for, against or not at all: patterns, gazetteers (top-level domains, dialling codes, IBAN
countries, card prefixes, reserved blocks) and context words around it. The pattern labeler judges the form of a find, base
spans' too, so it doesn't restate the kind. The votes of all base spans and candidates are
counted by pattern, a table whose size depends on the labelers alone; expectation-maximisation over these counts (Dawid
and Skene) estimates each labeler's reliability, and the resulting probabilities train a logistic span classifier,
again over the counts. Candidates with a probability of ACCEPT or more become spans.

A text is scanned once, in time linear in its length: every pattern starts at characters that it can't skip.

Nulls: a null text is empty; null doc_ids stay. Repeated rows are counted and returned as often as they occur. Other
columns are ignored by `detect` and kept as they are by `redact`, whatever their names; an empty table gives an empty result.
Votes that tie leave the decision to the gazetteers' and contexts' reliabilities. Very long texts are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from tidemark.llm.common import free_name, saved, sliced, table

KINDS = ("email", "ip", "card", "phone", "email_words", "phone_local", "ssn", "iban", "ip6")
BASE = 4
ACCEPT, ROUNDS, NEAR = 0.9, 50, 40
#: Gazetteers and context words.
TLDS = frozenset("com org net edu gov io info biz eu uk de fr es it nl se no pl ch at us ca au jp cn in br mx ru example test".split())
DIALLING = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 92 351 352 353 358 420 421".split())
IBAN_COUNTRIES = frozenset("AT BE CH CZ DE DK ES FI FR GB IE IT LU NL NO PL PT SE".split())
IBAN_LENGTHS = {"AT": 20, "BE": 16, "CH": 21, "CZ": 24, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "SE": 24}
CARD_PREFIXES = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "2221", "2720", "35", "36", "38")
CONTEXT = {
    "email": ("mail", "contact", "correo", "courriel", "write", "schreib"), "ip": ("ip", "address", "host", "server", "client"), "card": ("card", "visa", "credit", "carte", "karte", "tarjeta", "amex"), "phone": ("tel", "phone", "call", "fax", "mobil", "ruf"),
    "email_words": ("mail", "contact", "correo", "courriel", "write"), "phone_local": ("tel", "phone", "call", "fax", "mobil", "ruf"), "ssn": ("ssn", "social", "security"), "iban": ("iban", "account", "konto", "compte", "cuenta"), "ip6": ("ip", "address", "host", "server"),
}
AGAINST = ("isbn", "version", "order no", "invoice", "issue", "page", "chapter", "section", "price", "$", "eur")

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOOSE = {
    "email_words": re.compile(r"\b[A-Za-z0-9][A-Za-z0-9_.-]{0,63} ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]{1,63}(?: ?(?:\(dot\)|\[dot\]|\.) ?[A-Za-z]{2,24})+"),
    "phone_local": re.compile(r"(?<![0-9+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])"),
    "ssn": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "iban": re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?\b"),
    "ip6": re.compile(r"(?<![0-9A-Za-z:])(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}(?![0-9A-Za-z:])"),
}


def _one_gap(value: str) -> bool:
    return len(set(re.sub(r"[0-9()]", "", value))) == 1


#: The pattern labeler: what a careful writer's form of each kind looks like.
FORMS = {
    "email": lambda v, d: int(re.search(r"[A-Za-z0-9]@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}$", v) is not None and ".." not in v),
    "ip": lambda v, d: int(not re.search(r"(^|\.)0[0-9]", v)),
    "card": lambda v, d: 1 if len(d) in (15, 16) else 2,
    "phone": lambda v, d: 1 if len(d) >= 10 else 2,
    "email_words": lambda v, d: 1 if re.search(r"\(at\).*(\(dot\)|\.)|\[at\].*(\[dot\]|\.)", v) else 2,
    "phone_local": lambda v, d: int(_one_gap(v) or v.startswith("(")),
    "ssn": lambda v, d: 1,
    "iban": lambda v, d: int(IBAN_LENGTHS.get(v[:2]) == len(v.replace(" ", ""))),
    "ip6": lambda v, d: 1 if re.search("[a-f]", v) else 2,
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost, non-overlapping; found from each @ to the left, so that a long run without @ costs nothing."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        else:
            free = max(free, at + 1)  # no address starts at or before this @ and passes it
        at = text.find("@", free)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in code points, by kind, then start."""
    out = [(0, a, b) for a, b in emails(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if 13 <= m.end() - m.start() and 13 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append((2, *m.span()))
    for m in PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((3, *m.span()))
    return out


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Looser finds that touch no base span."""
    out, taken = [], sorted((a, b) for _, a, b in base)
    starts = np.array([a for a, _ in taken]), np.array([b for _, b in taken])
    for name, pattern in LOOSE.items():
        if name == "email_words" and "at" not in text:
            continue
        for m in pattern.finditer(text):
            if not taken or not np.any((starts[0] < m.end()) & (starts[1] > m.start())):
                out.append((KINDS.index(name), *m.span()))
    return out


def votes(text: str, kind: int, start: int, end: int) -> int:
    """The labelers' votes (1 for, 0 against, 2 none) as one number in base 3: pattern, gazetteer, context, counter-context, shape."""
    name, value = KINDS[kind], text[start:end]
    before, after = text[max(0, start - NEAR) : start].lower(), text[end : end + 12].lower()
    digits = re.sub(r"[^0-9]", "", value)
    pattern = FORMS[name](value, digits)
    if name in ("email", "email_words"):
        gazetteer = int((re.findall("[a-z]+", value.lower()) or [""])[-1] in TLDS)
    elif name == "ip":
        gazetteer = int(not value.startswith(("0.", "255.")))
    elif name == "card":
        gazetteer = int(digits.startswith(CARD_PREFIXES))
    elif name == "phone":
        gazetteer = int(any(digits[:k] in DIALLING for k in (1, 2, 3)))
    elif name == "phone_local":
        gazetteer = int(digits[0] not in "01" and digits[3] not in "01")
    elif name == "ssn":
        gazetteer = int(digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000")
    elif name == "iban":
        compact = value.replace(" ", "")
        gazetteer = int(compact[:2] in IBAN_COUNTRIES and int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1)
    else:
        gazetteer = 2
    context = 1 if any(w in before for w in CONTEXT[name]) else 2
    counter = 0 if any(w in before[-16:] for w in AGAINST) else 2
    shape = 0 if before[-1:].isalnum() or after[:1].isalnum() else 1
    return sum(v * 3**i for i, v in enumerate((pattern, gazetteer, context, counter, shape)))


LABELERS = 5


FOUND = "array<struct<kind:int,start:int,stop:int,votes:int>>"


def _scan(fields: list[str]):
    """The rows as they are, their text first, with what is found in it. Only texts are read in Python, so no other value changes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(x, pa.int32()) for x in ("kind", "start", "stop", "votes")]))
        for batch in sliced(batches):
            out = []
            for text in batch.column(0).to_pylist():
                text = text or ""
                base = base_spans(text)
                out.append([{"kind": k, "start": a, "stop": b, "votes": votes(text, k, a, b)} for k, a, b in base + candidates(text, base)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, kind)], fields)

    return run


def scanned(docs: DataFrame, columns: list[str]) -> tuple[DataFrame, str]:
    """The columns of docs and what is found in their texts, saved; and the name of that column."""
    found = free_name(docs, "found")
    rows = docs.select(F.col("text").alias("text"), *[F.col(f"`{c}`") for c in columns if c != "text"])
    fields = [*rows.columns, found]
    schema = StructType([*rows.schema.fields, StructField(found, _parse_datatype_string(FOUND))])
    return saved(rows.mapInArrow(_scan(fields), schema).select(*[F.col(f"`{c}`") for c in columns], found), "pii"), found


def _open(codes: np.ndarray) -> np.ndarray:
    return np.stack([codes // 3**i % 3 for i in range(LABELERS)], axis=1)


def reliabilities(kinds: np.ndarray, codes: np.ndarray, n: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """EM over counts of (kind, votes): P(personal) of each row, and table[class, labeler, vote].

    It starts from the majority of votes. A smoothing count of 1 for each vote keeps every probability inside (0, 1).
    """
    v = _open(codes)
    p = (0.5 + (v == 1).sum(1)) / (1.0 + (v != 2).sum(1))
    theta = np.full((2, LABELERS, 3), 1 / 3)
    for _ in range(rounds):
        for c, w in ((0, (1 - p) * n), (1, p * n)):
            for j in range(LABELERS):
                theta[c, j] = (np.bincount(v[:, j], w, 3) + (1.0, 1.0, 1.0)) / (w.sum() + 3)
        prior = {k: (0.5 + (p * n)[kinds == k].sum()) / (1 + n[kinds == k].sum()) for k in set(kinds.tolist())}
        log = np.stack([np.log([1 - prior[k] for k in kinds.tolist()]), np.log([prior[k] for k in kinds.tolist()])], 1)
        for j in range(LABELERS):
            log += np.log(theta[:, j, v[:, j]]).T
        new = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50)))
        if np.abs(new - p).max() < 1e-9:
            break
        p = new
    # classes have no names in EM: personal is the one whose members get more votes for
    votes_for = theta[:, :, 1] / np.maximum(theta[:, :, :2].sum(axis=2), 1e-12)
    if votes_for[1].mean() < votes_for[0].mean():
        p, theta = 1 - p, theta[::-1]
    return p, theta


def train(kinds: np.ndarray, codes: np.ndarray, n: np.ndarray, p: np.ndarray, steps: int = 60) -> np.ndarray:
    """Logistic regression (Newton, ridge 1) of p on kind and votes, weighted by counts: the classifier's probability of each row."""
    v = _open(codes)
    x = np.concatenate([np.eye(len(KINDS))[kinds], *[(v[:, [j]] == k).astype(float) for j in range(LABELERS) for k in (0, 1)]], axis=1)
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (n * q * (1 - q))[:, None]) + np.eye(len(w)), x.T @ (n * (p - q)) - w)
        w += np.clip(step, -2, 2)
    return 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))


def detect(docs: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """A row for each row of docs: doc_id, spans (array of kind, start, stop by kind, then start): base and accepted ones."""
    rows, found = scanned(docs.select(F.col("doc_id").cast("long"), "text"), ["doc_id"])
    return rows.select("doc_id", accepted(rows, found, accept).alias("spans"))


def rated(docs: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """Like detect, with q in each span: the classifier's probability that it is personal."""
    rows, found = scanned(docs.select(F.col("doc_id").cast("long"), "text"), ["doc_id"])
    return rows.select("doc_id", accepted(rows, found, accept, rate=True).alias("spans"))


def model(rows: DataFrame, found: str) -> pd.DataFrame:
    """kind, votes, n, p (EM) and q (classifier) of every combination that occurs: at most kinds x 3^labelers rows."""
    counts = rows.where(F.size(found) > 0).select(F.explode_outer(found).alias("f")).groupBy("f.kind", "f.votes").agg(F.count("*").alias("n")).orderBy("kind", "votes").toPandas()
    if not len(counts):
        return counts.assign(p=[], q=[])
    kinds, codes, n = (counts[c].to_numpy(np.int64) for c in ("kind", "votes", "n"))
    p, _ = reliabilities(kinds, codes, n.astype(float))
    return counts.assign(p=p, q=train(kinds, codes, n.astype(float), p))


def accepted(rows: DataFrame, found: str, accept: float = ACCEPT, rate: bool = False) -> Column:
    """The base spans, and the others that the classifier takes; with rate, their probabilities too."""
    fitted = model(rows, found)
    good = [int(k) * 1000 + int(v) for k, v, q in zip(fitted["kind"], fitted["votes"], fitted["q"], strict=True) if k >= BASE and q >= accept]
    keep = F.filter(found, lambda s: (s["kind"] < BASE) | ((s["kind"] * 1000 + s["votes"]).isin(good) if good else F.lit(False)))
    told = {int(k) * 1000 + int(v): float(q) for k, v, q in zip(fitted["kind"], fitted["votes"], fitted["q"], strict=True)}
    q = F.create_map(*[F.lit(x) for kv in told.items() for x in kv]) if told else F.create_map(F.lit(-1), F.lit(0.0))
    more = lambda s: [q[s["kind"] * 1000 + s["votes"]].alias("q")] if rate else []
    return F.array_sort(F.transform(keep, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), *more(s))))


def redact(docs: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """docs with every span of `detect` replaced by its kind; n_chars, if there, follows the text. Other columns stay."""
    rows, found = scanned(docs, docs.columns)
    spans = F.array_sort(F.transform(accepted(rows, found, accept), lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
    # a span that an earlier one covers is dropped; of one that it overlaps, the rest is replaced
    reach = lambda i: F.coalesce(F.array_max(F.transform(F.slice("_spans", 1, i), lambda x: x["stop"])), F.lit(0))
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    piece = lambda s, i: F.when(s["stop"] > reach(i), F.concat(F.substring("_text", reach(i) + 1, F.greatest(F.lit(0), s["start"] - reach(i))), F.get(names, s["kind"]))).otherwise(F.lit(""))
    text = F.concat(F.array_join(F.transform("_spans", piece), ""), F.substring("_text", reach(F.size("_spans")) + 1, F.char_length("_text")))
    out = rows.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col("text").alias("_text"), spans.alias("_spans"))
    out = out.select("_doc", F.when(F.size("_spans") > 0, text).otherwise(F.col("_text")).alias("_new"))
    new = {"text": F.col("_new")} | ({"n_chars": F.char_length("_new").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return out.select(*[new.get(c, F.col("_doc").getField(c)).alias(c) for c in docs.columns])


def listed(found: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def op7_pii_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rated(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in KINDS[:BASE]], F.sha2(listed(F.filter("spans", lambda s: s["kind"] < BASE)), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), F.array_join(F.transform("spans", lambda s: F.format_string("%.3f", s["q"])), ",").alias("probabilities"))
