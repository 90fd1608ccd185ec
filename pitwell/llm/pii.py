"""Operator 8: personal data by weak supervision.

Base spans follow fixed patterns and checks and always stay. The method adds
spans: looser patterns propose candidates, and five labelers (pattern, layout,
gazetteer, context, border) vote yes, no or nothing on each candidate and each
base span. Spark counts how often each combination of votes occurs for each
kind, at most 5 x 3**5 rows whatever the input; expectation-maximisation over
that table estimates the labelers' reliabilities and the probability that a
combination is personal data (with a prior belief that labelers are rather right than
wrong, so that the two classes keep their meaning where nearly all spans are of one), and a logistic span classifier is trained on
those probabilities, weighted by the counts. Candidates that the classifier
accepts and that touch no base span are added. Credentials (keys, tokens and
passwords) are a fifth kind that has candidates only; they are reported beside
the spans of the four kinds, in `secrets`, and count in `n_found`.

Defined results: a null text counts as empty; positions are code points;
repeated rows get equal results; a null doc_id is kept; other columns are
ignored. All patterns run in time linear in the text.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitwell.llm.shared import documents

KINDS = ("email", "ip", "card", "phone")
SECRET = "secret"
BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"),
    # A match can only begin where a run of digits does; without that, long runs would be read again from each digit.
    "ip": re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    "card": re.compile(r"[0-9](?:[\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
LOOSE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]{1,64} ?[\[(] ?at ?[\])] ?[A-Za-z0-9-]{1,63}(?: ?(?:[\[(] ?dot ?[\])]|\.) ?[A-Za-z0-9-]{2,63}){1,4}", re.I),
    "ip": re.compile(r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"),
    "card": re.compile(r"(?<![0-9])(?:(?:[0-9]{4}[ -]){3}[0-9]{4}|[0-9]{13,16})(?![0-9])"),
    "phone": re.compile(r"\+[0-9]{1,3} ?\([0-9]{2,4}\) ?[0-9]{3,4}[ .-][0-9]{4}(?![0-9])|\+[0-9]{1,3}(?:[ .-][0-9]{2,4}){2,3}(?![.0-9])|(?<![0-9+])(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9])"),
}
#: A credential: a quoted or assigned word of many letters and digits, or one with a well-known beginning.
LOOSE_SECRET = re.compile(r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{16,512}={0,2}(?![A-Za-z0-9_+/=-])")
#: Beginnings of keys of public services, and words that name a credential.
KEY_STARTS = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "sk-", "sk_live_", "pk_live_", "AIza", "eyJ")
SECRET_WORDS = re.compile(r"(?:token|secret|passw(?:or)?d|passwd|pwd|api[_-]?key|access[_-]?key|private[_-]?key|credential|bearer|authorization)", re.I)
ASSIGNED = re.compile(r"(?:=|:|=>)\s*[\"'`]?$")
#: The ten digits of a North American number, without the country's.
NATIONAL = re.compile(r"(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[.-])[2-9][0-9]{2}[.-][0-9]{4}")
HEX = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64})", re.I)
LAYOUT = {
    "email": re.compile(r".{1,64}@[A-Za-z0-9.-]*[A-Za-z0-9]\.[A-Za-z]{2,24}|.*\b(?:at)\b.*", re.I),
    "ip": re.compile(r"(?:(?:0|[1-9][0-9]{0,2})\.){3}(?:0|[1-9][0-9]{0,2})"),
    "card": re.compile(r"(?:[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4})|[0-9]{13,16}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}"),
    "phone": re.compile(r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){1,4}|" + NATIONAL.pattern),
}
#: Common endings of mail domains, first digits of card issuers, words that stand near personal data or near plain numbers.
ENDINGS = ("com", "org", "net", "edu", "gov", "io", "co", "info", "de", "fr", "es", "uk", "eu", "us", "ca", "it", "nl", "ch", "at")
ISSUERS = ("4", "51", "52", "53", "54", "55", "34", "37", "36", "38", "60", "62", "64", "65", "22", "23", "24", "25", "26", "27")
NEAR = {
    "email": re.compile(r"\b(?:e-?mails?|mailto|contact|write|correo|courriel|kontakt)\b"),
    "ip": re.compile(r"\b(?:ip|host|server|address|client|login|adresse)\b"),
    "card": re.compile(r"\b(?:card|visa|mastercard|amex|credit|debit|pay|payment|karte|carte|tarjeta)\b"),
    "phone": re.compile(r"\b(?:phone|tel|telephone|mobile|cell|fax|call|whatsapp|telefon|téléphone|teléfono)\b"),
}
FAR_WORDS = re.compile(r"\b(?:version|isbn|issn|doi|order|invoice|serial|build|commit|page|id|sha|hash)\b")
REGION = re.compile(r"[+(0-9][+0-9 ().-]*")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
NEAR_CHARS = 40
LABELERS = ("pattern", "layout", "gazetteer", "context", "border")
EM_STEPS = 50
#: What is believed beforehand, as a share of all rows: how often spans that aren't personal data, and spans that are, get -1, 0, 1
#: from the pattern labeler, which runs checks, and from the others.
CHECKS, HINTS = ((0.9, 0.05, 0.05), (0.05, 0.05, 0.9)), ((0.5, 0.3, 0.2), (0.2, 0.3, 0.5))
BELIEF, BELIEF_SHARE = np.array([[c, *[h] * (len(LABELERS) - 1)] for c, h in zip(CHECKS, HINTS)]), 0.3


def digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def valid(kind: str, s: str) -> bool:
    if kind == "ip":
        return all(len(x := p.lstrip("0")) <= 3 and int(x or 0) <= 255 for p in s.split("."))
    if kind == "card":
        d = digits(s)
        return 12 <= len(d) <= 19 and luhn(d)
    return kind == "email" or 9 <= len(digits(s)) <= 15


def mails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches of BASE["email"], looked for around each @, in linear time."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = done + len(text[done:at].rstrip(LOCAL))
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
        done = found.end() if found else at + 1
        at = text.find("@", at + 1)


class Covered:
    """Whether a span touches one of some spans that are sorted by their start."""

    def __init__(self, spans: list[tuple[int, int, str]]):
        self.starts = [s for s, _, _ in spans]
        self.ends = list(accumulate((e for _, e, _ in spans), max))

    def touches(self, start: int, end: int) -> bool:
        k = bisect_left(self.starts, end)
        return k > 0 and self.ends[k - 1] > start


def found_spans(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, other candidates) as (start, end, kind). Patterns only run over stretches of their own characters."""
    base, loose = [(a, b, "email") for a, b in mails(text)], []
    low = text.lower() if "@" not in text or "(" in text or "[" in text else ""
    if any(x in low for x in ("(at", "( at", "[at", "[ at")):
        loose += [(m.start(), m.end(), "email") for m in LOOSE["email"].finditer(text)]
    for r in REGION.finditer(text):
        a, b = r.span()
        if b - a < 7:
            continue
        part = text[a:b]
        for kind in ("ip", "card", "phone"):
            if kind == "ip" and part.count(".") < 3 or kind == "phone" and "+" not in part:
                continue
            base += [(a + m.start(), a + m.end(), kind) for m in BASE[kind].finditer(part) if valid(kind, m.group())]
        for kind in ("ip", "card", "phone"):
            # A number that fails its checksum or range is none, whatever stands around it.
            loose += [(a + m.start(), a + m.end(), kind) for m in LOOSE[kind].finditer(part) if kind == "phone" or valid(kind, m.group())]
    for m in LOOSE_SECRET.finditer(text):
        word = m.group()
        if word.startswith(KEY_STARTS) or any(map(str.isdigit, word)) and any(map(str.isalpha, word)):
            loose.append((m.start(), m.end(), SECRET))
    base.sort(key=lambda x: (x[0], KINDS.index(x[2])))
    if loose:
        held = Covered(base)
        loose = [c for c in sorted(set(loose)) if c[2] == SECRET or not held.touches(c[0], c[1])]
    return base, loose


def secret_votes(text: str, start: int, end: int) -> tuple[int, ...]:
    s, before = text[start:end], text[max(0, start - NEAR_CHARS) : start]
    kinds = sum(any(map(f, s)) for f in (str.isdigit, str.islower, str.isupper))
    pattern = 1 if HEX.fullmatch(s) or s.startswith(KEY_STARTS) or kinds == 3 and len(set(s)) >= 12 else -1
    layout = 1 if ASSIGNED.search(before) else -1
    gazetteer = 1 if s.startswith(KEY_STARTS) else 0
    context = 1 if SECRET_WORDS.search(before) else -1
    quotes = text[max(0, start - 1) : start], text[end : end + 1]
    border = 1 if quotes[0] == quotes[1] and quotes[0] in ("'", '"', "`") else 0
    return pattern, layout, gazetteer, context, border


def votes(text: str, start: int, end: int, kind: str) -> tuple[int, ...]:
    if kind == SECRET:
        return secret_votes(text, start, end)
    s = text[start:end]
    full = BASE[kind].fullmatch(s)
    pattern = 1 if full and valid(kind, s) or kind == "phone" and NATIONAL.fullmatch(s) else -1
    layout = 1 if LAYOUT[kind].fullmatch(s) else -1
    d = digits(s)
    if kind == "email":
        gazetteer = 1 if re.split(r"[.\s\])]+", s.rstrip("])"))[-1].lower() in ENDINGS else -1
    elif kind == "card":
        gazetteer = 1 if d.startswith(ISSUERS) else -1
    elif kind == "ip":
        gazetteer = -1 if s.split(".")[0].lstrip("0") in ("", "255") else 0
    else:
        gazetteer = (1 if not d.startswith("0") else -1) if s.startswith("+") else 0
    before = text[max(0, start - NEAR_CHARS) : start].lower()
    context = 1 if NEAR[kind].search(before) else -1 if FAR_WORDS.search(before) else 0
    around = text[max(0, start - 1) : start] + text[end : end + 1]
    border = -1 if any(c.isalnum() or c in "_\"'" for c in around) else 1
    return pattern, layout, gazetteer, context, border


class SpanModel:
    """Probabilities of vote combinations: expectation-maximisation, then a logistic classifier per kind."""

    def __init__(self, table: list[tuple[str, tuple[int, ...], int]]):
        self.weights: dict[str, np.ndarray] = {}
        self.reliability: dict[str, np.ndarray] = {}
        for kind in (*KINDS, SECRET):
            rows = sorted((v, n) for k, v, n in table if k == kind)
            if not rows:
                continue
            v, n = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
            posterior = self._em(kind, v, n)
            self.weights[kind] = self._fit(v, n, posterior)

    def _em(self, kind: str, v: np.ndarray, n: np.ndarray) -> np.ndarray:
        one_hot = np.stack([v == x for x in (-1, 0, 1)], axis=2).astype(float)  # rows x labelers x votes
        y = np.clip(0.5 + 0.3 * v[:, 0] + 0.15 * v[:, 1:].mean(axis=1), 0.02, 0.98)
        for _ in range(EM_STEPS):
            chance = []
            for r, belief in zip((1 - y, y), BELIEF):
                held = np.einsum("i,ijk->jk", n * r, one_hot) + belief * (1 + BELIEF_SHARE * n.sum())
                chance.append(held / held.sum(axis=1, keepdims=True))
            prior = ((n * y).sum() + 1) / (n.sum() + 2)
            logs = [np.einsum("ijk,jk->i", one_hot, np.log(c)) for c in chance]
            y = 1 / (1 + np.exp(np.clip(logs[0] - logs[1] + np.log((1 - prior) / prior), -60, 60)))
        self.reliability[kind] = np.stack(chance)
        return y

    def features(self, v: np.ndarray) -> np.ndarray:
        return np.concatenate([np.ones((len(v), 1)), v == 1, v == -1], axis=1).astype(float)

    def _fit(self, v: np.ndarray, n: np.ndarray, y: np.ndarray) -> np.ndarray:
        x, w = self.features(v), np.zeros(1 + 2 * v.shape[1])
        n = n / n.sum()
        for _ in range(30):  # Newton steps with a ridge
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            hessian = (x * (n * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + 1e-3 * np.eye(len(w))
            w += np.linalg.solve(hessian, x.T @ (n * (y - p)) - 1e-3 * w)
        return w

    def probability(self, kind: str, v: tuple[int, ...]) -> float:
        if kind not in self.weights:
            return 0.0
        return float(1 / (1 + np.exp(-np.clip(self.features(np.array([v])) @ self.weights[kind], -30, 30)))[0])


def vote_table(docs: DataFrame) -> list[tuple[str, tuple[int, ...], int]]:
    """How often each combination of votes occurs over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for t in b.column(0):
                text = t.as_py()
                for spans in found_spans(text):
                    seen.update((k, *votes(text, s, e, k)) for s, e, k in spans)
        keys = [*seen]
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([list(k[1:]) for k in keys], pa.list_(pa.int32())), pa.array([seen[k] for k in keys], pa.int64())], names=["kind", "votes", "n"])

    parts = docs.filter("text IS NOT NULL").select("text").mapInArrow(run, "kind string, votes array<int>, n long")
    return [(r.kind, tuple(r.votes), r.n) for r in parts.groupBy("kind", "votes").agg(F.sum("n").alias("n")).collect()]


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def personal_data(docs: DataFrame, threshold: float = 0.9) -> DataFrame:
    """doc_id, counts of base spans, their digest, all spans, credentials likewise, and n_found, the number of both."""
    model = SpanModel(vote_table(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, bool] = {}
        for b in batches:
            out: list[tuple] = []
            for t in b.column(1):
                text = t.as_py() or ""
                base, loose = found_spans(text)
                more, secrets = [], []
                for s, e, k in loose:
                    v = (k, *votes(text, s, e, k))
                    if v not in known:
                        known[v] = model.probability(k, v[1:]) >= threshold
                    kept = secrets if k == SECRET else more
                    if known[v] and (not kept or kept[-1][1] <= s):  # they come by their start
                        kept.append((s, e, k))
                n = Counter(k for _, _, k in base)
                every = sorted(base + more, key=lambda x: (x[0], KINDS.index(x[2])))
                out.append((*(n[k] for k in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), joined(secrets), len(every) + len(secrets)))
            if out:
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols[:4]), *(pa.array(c, pa.string()) for c in cols[4:7]), pa.array(cols[7], pa.int64())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "secrets", "n_found"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, secrets string, n_found long")


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(documents(spark, sf_dir))
