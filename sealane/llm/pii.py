"""Personal data: base patterns, and a character BiLSTM-CRF over overlapping windows."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sealane.llm.common import documents
from sealane.llm.spans import PAD, Span, codes, digest, joined
from sealane.llm.tagger import Tagger

# The base patterns.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: A match begins where a run of digits does: later in the run it would fail in the same way.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

BASE_KINDS = ["email", "ip", "card", "phone"]
KINDS = [*BASE_KINDS, *(f"lstm_{k}" for k in BASE_KINDS)]

#: Characters that the network sees at once; windows overlap by half.
WINDOW, STRIDE = 64, 32
LEAST_LENGTH = 6
#: Only windows with one of these can hold what the labelled spans are made of.
TRIGGER = re.compile(r"[0-9@]")
#: Texts whose base spans are labels for training, and windows of each; made examples; steps.
SAMPLE_TEXTS, SAMPLE_EACH, N_MADE, STEPS = 3_000, 8, 2_000, 350
SEED = 17
_DIGITS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _number(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[Span]:
    """Leftmost matches, in linear time: a local part can begin only right after its last stop."""
    end, place = 0, text.find("@")
    while place >= 0:
        start = place
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        match = EMAIL.match(text, start) if start < place else None
        if match:
            yield Span("email", *match.span())
            end = match.end()
        place = text.find("@", max(place + 1, end))


_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def base_spans(text: str) -> list[Span]:
    out = list(_emails(text)) if "@" in text else []
    if _DIGITS.search(text):
        out += [Span("ip", *m.span()) for m in IP.finditer(text) if all(int(p[-20:]) <= 255 and len(p.lstrip("0")) <= 3 for p in m[0].split("."))]
        out += [Span("card", *m.span()) for m in CARD.finditer(text) if 12 <= len(n := _number(m[0])) <= 19 and luhn(n)]
        if "+" in text:
            out += [Span("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(_number(m[0])) <= 15]
    return out


def window_starts(text: str) -> list[int]:
    """Starts of the windows, at every STRIDE, that have a trigger in them."""
    last = max(0, len(text) - WINDOW)
    out, seen = [], -1
    for match in TRIGGER.finditer(text):
        at = match.start()
        first = max(0, (at - WINDOW) // STRIDE + 1)
        for k in range(max(first, seen + 1), at // STRIDE + 1):
            out.append(k * STRIDE)
            seen = k
    return [s for s in out if s <= last + STRIDE]


def window_codes(text: str, start: int) -> np.ndarray:
    row = np.full(WINDOW, PAD, np.int16)
    part = codes(text[start : start + WINDOW])
    row[: len(part)] = part
    return row


def tags_of(spans: list[Span], start: int) -> np.ndarray:
    tags = np.zeros(WINDOW, np.int8)
    for s in spans:
        kind = BASE_KINDS.index(s.kind)
        a, b = max(s.start, start) - start, min(s.end, start + WINDOW) - start
        if a < b and not tags[a:b].any():
            tags[a:b] = 2 + 2 * kind
            tags[a] = 1 + 2 * kind
    return tags


def spans_of(tags: np.ndarray, start: int) -> list[Span]:
    out, k = [], 0
    while k < len(tags):
        if tags[k] % 2:
            end = k + 1
            while end < len(tags) and tags[end] == tags[k] + 1:
                end += 1
            out.append(Span(BASE_KINDS[tags[k] // 2], start + k, start + end))
            k = end
        else:
            k += 1
    return out


def reconciled(found: list[tuple[Span, int]], length: int) -> list[Span]:
    """One set of spans for a text from those of all its windows (span, window start).

    A span counts in each window by how far it stays from the window's edges, where it may be cut
    off; equal spans add up.  Of overlapping spans the heaviest set without overlaps stays.
    """
    weight: dict[Span, float] = defaultdict(float)
    for span, start in found:
        left = WINDOW if start == 0 else span.start - start
        right = WINDOW if start + WINDOW >= length else start + WINDOW - span.end
        weight[span] += (0.05 + min(left, right, STRIDE) / STRIDE) * (span.end - span.start)
    order = sorted(weight, key=lambda s: (s.end, s.start, s.kind))
    ends, best = [s.end for s in order], [(0.0, -1, 0)]
    for k, s in enumerate(order):
        before = int(np.searchsorted(ends[:k], s.start, "right"))
        take = best[before][0] + weight[s]
        best.append((take, k, before) if take > best[k][0] else (best[k][0], -1, k))
    out, k = [], len(order)
    while k:
        _, chosen, before = best[k]
        if chosen >= 0:
            out.append(order[chosen])
        k = before
    return out[::-1]


def made_examples(n: int = N_MADE, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Labelled windows from rules: personal data in several forms, and numbers that are none."""
    rng = np.random.default_rng(seed)
    pick = lambda options: options[int(rng.integers(len(options)))]
    draw = lambda letters, a, b: "".join(letters[i] for i in rng.integers(0, len(letters), int(rng.integers(a, b))))
    word, num = lambda: draw("abcdefghijklmnopqrstuvwxyz", 2, 9), lambda a, b: draw("0123456789", a, b + 1)
    made = {
        "email": lambda: f"{word()}{pick(['', '.', '_'])}{word()}@{word()}.{pick(['com', 'org', 'example.com', 'net'])}",
        "ip": lambda: ".".join(str(rng.integers(0, 256)) for _ in range(4)),
        "card": lambda: pick([" ", "-", ""]).join(num(4, 4) for _ in range(4)),
        "phone": lambda: pick([lambda: f"+{num(1, 2)} ({num(3, 3)}) {num(3, 3)}-{num(4, 4)}", lambda: f"({num(3, 3)}) {num(3, 3)}-{num(4, 4)}", lambda: f"+{num(2, 2)} {num(3, 3)} {num(3, 3)} {num(3, 3)}"])(),
    }
    rows, tags = [], []
    for k in range(n):
        lead, tail = " ".join(word() for _ in range(int(rng.integers(0, 6)))), " ".join(word() for _ in range(int(rng.integers(0, 6))))
        if k % 3:
            kind = BASE_KINDS[k % 4]
            value, spans = made[kind](), None
        else:
            value = pick([lambda: f"{rng.integers(1900, 2030)}-{rng.integers(1, 13):02d}-{rng.integers(1, 29):02d}", lambda: f"version {num(1, 2)}.{num(1, 2)}.{num(1, 1)}", lambda: num(1, 7), lambda: f"{num(1, 3)}.{num(2, 2)}%", lambda: f"{word()}{num(1, 3)}", lambda: f"{num(1, 1)}.0.", word])()
            kind = None
        text = f"{lead} {value} {tail}".strip() if lead else f"{value} {tail}"
        at = len(lead) + 1 if lead else 0
        spans = [Span(kind, at, at + len(value))] if kind else []
        start = int(rng.integers(0, max(1, at - 8)))
        rows.append(window_codes(text, start))
        tags.append(tags_of(spans, start))
    return np.stack(rows), np.stack(tags)


def labelled_windows(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Windows of a bounded sample of texts, tagged by their base spans."""
    some = docs.where("doc_id IS NOT NULL").select("doc_id").orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(SAMPLE_TEXTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, tags = [], []
            for text in batch.column(0).to_pylist():
                text = text or ""
                spans = base_spans(text)
                for start in window_starts(text)[:SAMPLE_EACH]:
                    rows.append(window_codes(text, start).tobytes())
                    tags.append(tags_of(spans, start).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), pa.array(tags, pa.binary())], names=["x", "y"])

    found = docs.select("doc_id", "text").join(F.broadcast(some.distinct()), "doc_id", "left_semi").select("text").mapInArrow(run, "x binary, y binary").collect()
    found = sorted((bytes(r[0]), bytes(r[1])) for r in found)
    return np.asarray([np.frombuffer(x, np.int16) for x, _ in found], np.int16).reshape(-1, WINDOW), np.asarray([np.frombuffer(y, np.int8) for _, y in found], np.int8).reshape(-1, WINDOW)


def fit(docs: DataFrame) -> Tagger:
    made, own = made_examples(), labelled_windows(docs)
    tagger = Tagger(len(BASE_KINDS))
    tagger.fit(np.concatenate([made[0], own[0]]), np.concatenate([made[1], own[1]]), STEPS)
    return tagger


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def pii_scan(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans), one row for each row of ``docs``.

    Base spans come from every whole text.  Every window of every text that has a digit or an @ is
    decoded, windows overlap by half, and their spans are reconciled over the text; those of at
    least LEAST_LENGTH characters that no base span touches are added as lstm_<kind>.  The network
    is fitted on windows of at most SAMPLE_TEXTS texts and on made examples.  A null or empty text
    has no spans (empty strings).  Repeated rows get a row each; only doc_id and text are read; an
    empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tagger or fit(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            base, lengths, owners, inputs = [], [], [], []
            found: dict[int, list[tuple[Span, int]]] = defaultdict(list)

            def decode() -> None:
                for (k, start), tags in zip(owners, net.decode(np.stack(inputs)), strict=True):  # noqa: B023
                    found[k] += [(s, start) for s in spans_of(tags, start)]  # noqa: B023
                owners.clear()  # noqa: B023
                inputs.clear()  # noqa: B023

            for k, text in enumerate(batch.column(1)):
                text = text.as_py() or ""
                base.append(base_spans(text))
                lengths.append(len(text))
                for start in window_starts(text):
                    owners.append((k, start))
                    inputs.append(window_codes(text, start))
                    if len(inputs) == 512:
                        decode()
            if inputs:
                decode()
            texts = []
            for k, own in enumerate(base):
                more = [s for s in reconciled(found[k], lengths[k]) if s.end - s.start >= LEAST_LENGTH] if k in found else []
                texts.append(joined(own + [Span(f"lstm_{s.kind}", s.start, s.end) for s in more if not any(s.start < o.end and o.start < s.end for o in own)], KINDS))
            counts = [pa.array([sum(s.kind == kind for s in own) for own in base], pa.int64()) for kind in BASE_KINDS]
            digests = [digest(joined(own, KINDS)) for own in base]
            names = [part.split()[0] for part in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(digests, pa.string()), pa.array(texts, pa.string())], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_scan(documents(spark, sf_dir))
