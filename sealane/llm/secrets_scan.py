"""Secret scans: base patterns, and a character convolutional network over other candidates."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sealane.llm.common import documents, durable
from sealane.llm.spans import N_CODES, PAD, Adam, Span, codes, digest, joined

# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # greedy runs of 32 or more are the maximal runs that long
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

KINDS = ["assign", "access", "hex", "cnn"]
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")

#: Characters of a candidate that one window shows, and around it; longer candidates take several.
INSIDE, BEFORE, AFTER = 40, 24, 12
WIDTH, FILTERS = 5, 32
N_INPUTS = 2 * N_CODES  # a code inside the candidate is another input than outside
#: Distinct windows that one task trains on, rounds of such training, and steps of a round at least.
SHARD, ROUNDS, LEAST_STEPS = 50_000, 3, 150
#: Rows of a step from the table, and made ones beside them.
STEP_OWN, STEP_MADE = 96, 32
#: Parts of a whole in which weights are summed, and in which scores are counted for the threshold.
FINE, SCORE_STEPS = 1 << 30, 1_000
N_MADE = 1_500
LEAST_RECALL = 0.98
SEED = 11


def base_spans(text: str) -> list[Span]:
    low = text.lower()
    out = []
    if (":" in text or "=" in text) and any(k in low for k in KEYWORDS):
        out += [Span("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [Span("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    return out + [Span("hex", *m.span()) for m in HEX.finditer(text)]


def candidates(text: str) -> list[tuple[int, int]]:
    """Runs of the characters secrets are made of, with a digit among them."""
    return [m.span() for m in CANDIDATE.finditer(text) if any("0" <= c <= "9" for c in m[0])]


def windows(text: str, start: int, end: int) -> np.ndarray:
    """Network inputs for a candidate: one row for each INSIDE characters of it."""
    rows = []
    for a in range(start, end, INSIDE):
        b = min(a + INSIDE, end)
        if a > start and b - a < INSIDE // 2:
            a, b = max(start, end - INSIDE), end
        row = np.full(BEFORE + INSIDE + AFTER, PAD, np.int16)
        left, right = text[max(0, a - BEFORE) : a], text[b : b + AFTER]
        row[BEFORE - len(left) : BEFORE] = codes(left)
        row[BEFORE : BEFORE + b - a] = codes(text[a:b]) + N_CODES
        row[BEFORE + b - a : BEFORE + b - a + len(right)] = codes(right)
        rows.append(row)
    return np.stack(rows)


class Network(NamedTuple):
    weights: dict[str, np.ndarray]
    slope: float  # calibration: probability = sigmoid(slope * output + offset)
    offset: float
    threshold: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = np.concatenate([_forward(self.weights, x[i : i + 512])[0] for i in range(0, len(x), 512)]) if len(x) else np.empty(0)
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.offset, -30, 30)))


def _forward(w: dict[str, np.ndarray], x: np.ndarray):
    length = x.shape[1] - WIDTH + 1
    out = w["bias"] + sum(w["conv"][k][x[:, k : k + length]] for k in range(WIDTH))
    at = out.argmax(1)
    pooled = np.maximum(np.take_along_axis(out, at[:, None], 1)[:, 0], 0)
    return pooled @ w["dense"] + w["last"][0], pooled, at


def _gradient(w: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    z, pooled, at = _forward(w, x)
    error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight
    inner = np.outer(error, w["dense"]) * (pooled > 0)
    conv = np.zeros_like(w["conv"])
    for k in range(WIDTH):
        np.add.at(conv[k], (np.take_along_axis(x, at + k, 1), np.arange(FILTERS)[None]), inner)
    return {"conv": conv + 1e-5 * w["conv"], "bias": inner.sum(0), "dense": pooled.T @ error + 1e-4 * w["dense"], "last": np.asarray([error.sum()])}


def train(x: np.ndarray, y: np.ndarray, steps: int = 500, seed: int = SEED) -> Network:
    """Fit on four fifths; calibrate and set the threshold on the rest.

    The threshold is the largest at which LEAST_RECALL of the held-out positives are found.
    """
    rng = np.random.default_rng(seed)
    w = {"conv": rng.normal(0, 0.1, (WIDTH, N_INPUTS, FILTERS)), "bias": np.zeros(FILTERS), "dense": rng.normal(0, 0.2, FILTERS), "last": np.zeros(1)}
    order = rng.permutation(len(y))
    held, used = order[: len(y) // 5], order[len(y) // 5 :]
    if not len(used) or y[used].all() or not y[used].any():
        return Network(w, 0.0, 0.0, 2.0)  # nothing to learn from: no candidate passes
    adam = Adam(w, 0.01)
    groups = [used[y[used]], used[~y[used]]]
    for _ in range(steps):
        pick = np.concatenate([rng.choice(g, 64) for g in groups])
        adam.step(_gradient(w, x[pick], y[pick], np.full(len(pick), 1 / len(pick))))
    z = _forward(w, x[held])[0]
    slope, offset = _calibrate(z, y[held])
    p = 1 / (1 + np.exp(-np.clip(slope * z + offset, -30, 30)))
    positive = np.sort(p[y[held]])[::-1]
    threshold = float(positive[int(np.ceil(LEAST_RECALL * len(positive))) - 1]) if len(positive) else 2.0
    return Network(w, slope, offset, threshold)


def _calibrate(z: np.ndarray, y: np.ndarray, times: np.ndarray | None = None) -> tuple[float, float]:
    """Platt scaling: logistic regression of the label on the network's output."""
    a, b = 1.0, 0.0
    times = np.ones(len(y)) if times is None else times
    yes, no, share = times[y].sum(), times[~y].sum(), times / max(times.sum(), 1)
    target = np.where(y, (yes + 1) / (yes + 2), 1 / (no + 2))
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        a -= 0.05 * ((p - target) * z * share).sum()
        b -= 0.05 * ((p - target) * share).sum()
    return float(a), float(b)


def made_findings(n: int = N_MADE, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Labelled examples from rules: keys in several phrasings, and harmless runs with digits."""
    rng = np.random.default_rng(seed)
    pick = lambda options: options[int(rng.integers(len(options)))]
    draw = lambda letters, a, b: "".join(letters[i] for i in rng.integers(0, len(letters), int(rng.integers(a, b))))
    low, digits, up = "abcdefghijklmnopqrstuvwxyz", "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    word = lambda: draw(low, 3, 9)
    rows, labels = [], []
    for k in range(n):
        if k % 2:
            value = pick([lambda: draw(low + up + digits, 20, 44), lambda: draw("abcdef" + digits, 24, 64), lambda: draw(up + digits, 16, 24), lambda: pick(["ghp_", "sk-", "xoxb-", "glpat-"]) + draw(low + up + digits, 20, 40)])()
            lead = pick(["", "key ", "the key is ", "Bearer ", "token: ", "credential=", "auth ", word() + " ", "client_secret -> "])
        else:
            value = pick([
                lambda: f"{rng.integers(1990, 2030)}-{rng.integers(1, 13):02d}-{rng.integers(1, 29):02d}T{rng.integers(0, 24):02d}", lambda: f"{word()}.{rng.integers(10, 99)}", lambda: f"555-{rng.integers(1000, 9999)}-{rng.integers(100, 999)}",
                lambda: f"{word()}-{rng.integers(1, 99)}.{rng.integers(1, 9)}.{rng.integers(1, 9)}", lambda: f"/{word()}/{word()}/{word()}{rng.integers(1, 99)}", lambda: f"{word()}-{word()}-{rng.integers(1, 999)}", lambda: f"mail{rng.integers(1, 9)}.{word()}.com", lambda: draw(digits, 12, 18),
            ])()
            lead = pick(["", word() + " ", "on ", "see ", "version ", "call ", word() + "@", "file ", "the "])
        text = f"{word()} {word()} {lead}{value} {word()} {word()}"
        start = text.index(value, len(text) - len(value) - len(text.rpartition(value)[2]))
        rows.append(windows(text, start, start + min(len(value), INSIDE)))
        labels.append(bool(k % 2))
    return np.concatenate(rows), np.asarray(labels)


def labelled_findings(docs: DataFrame) -> DataFrame:
    """(x, y): every window of every candidate of every text, and whether a base span touches the candidate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, labels = [], []
            for text in batch.column(0):
                text = text.as_py() or ""
                base = base_spans(text)
                for a, b in candidates(text):
                    found = windows(text, a, b).astype(np.uint8)
                    rows += [x.tobytes() for x in found]
                    labels += [any(s.start < b and a < s.end for s in base)] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), pa.array(labels, pa.bool_())], names=["x", "y"])

    return docs.select("text").mapInArrow(run, "x binary, y boolean")


def _inputs(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BEFORE + INSIDE + AFTER).astype(np.int16)


def fit(docs: DataFrame) -> Network:
    """A network fitted on made examples and on all windows of all texts, but for a fifth that is held out.

    It starts from made examples.  In each round tasks go through all distinct windows of their shards
    from the same weights, with made examples beside them and both labels weighing alike, and the mean of
    the shards' weights by rows is the next round's start (iterative parameter mixing).  Calibration and
    threshold come from the scores of all held-out windows, as often as they occur, and of made ones.
    Spark sums the weights, in whole numbers, and counts the scores: what the driver gets does not grow
    with the table.
    """
    made, context = made_findings(), docs.sparkSession.sparkContext
    network = train(*made)
    rows = durable(labelled_findings(docs).groupBy("x", "y").agg(F.count("*").alias("times")))
    held = F.pmod(F.xxhash64("x", F.lit(SEED)), F.lit(5)) == 0
    sizes = {r.y: r.n for r in rows.where(~held).groupBy("y").agg(F.count("*").alias("n")).collect()}
    n = sum(sizes.values())
    if not rows.head(1):
        return network
    shards = max(1, n // SHARD)
    names = ["conv", "bias", "dense", "last"]
    w = {k: network.weights[k] for k in names}
    alike = {k: n / (2 * sizes[k]) for k in sizes} if len(sizes) == 2 else {}

    def trained(start, seed: int):
        def run(table: pa.Table) -> pa.Table:
            order = np.lexsort((table.column("y").to_numpy(), table.column("x").to_numpy()))
            x, y, rng = _inputs(table.column("x"))[order], table.column("y").to_numpy()[order], np.random.default_rng(seed)
            own = {k: v.copy() for k, v in start.value.items()}
            adam, (made_x, made_y) = Adam(own, 0.003), made
            at = np.concatenate([rng.permutation(len(y)) for _ in range(-(-LEAST_STEPS * STEP_OWN // len(y)))])
            for a in range(0, len(at), STEP_OWN):
                one, two = at[a : a + STEP_OWN], rng.integers(0, len(made_y), STEP_MADE)
                labels = np.concatenate([y[one], made_y[two]])
                weight = np.concatenate([[alike.get(v, 1.0) for v in y[one].tolist()], np.ones(len(two))]) / len(labels)
                adam.step(_gradient(own, np.concatenate([x[one], made_x[two]]), labels, weight))
            flat = np.concatenate([own[k].ravel() for k in names])
            return pa.table({"k": np.arange(len(flat)), "w": np.round(flat * len(y) * FINE).astype(np.int64)})

        return run

    for r in range(ROUNDS if n else 0):
        shard = F.pmod(F.xxhash64("x", F.lit(SEED + 1)), F.lit(shards)).alias("shard")
        parts = rows.where(~held).select(shard, "x", "y").groupBy("shard").applyInArrow(trained(context.broadcast(w), SEED + r), "k long, w long")
        flat = np.asarray([s for _, s in sorted(parts.groupBy("k").agg(F.sum("w")).collect())], float) / (n * FINE)
        ends = np.cumsum([w[k].size for k in names])
        w = {k: flat[end - w[k].size : end].reshape(w[k].shape) for k, end in zip(names, ends, strict=True)}

    final = context.broadcast(w)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_steps(final.value, _inputs(batch.column(0)))), batch.column(1), batch.column(2)], names=["z", "y", "times"])

    seen = rows.where(held).mapInArrow(scored, "z long, y boolean, times long").groupBy("z", "y").agg(F.sum("times")).collect()
    made_x, made_y = made_findings(seed=SEED + 1)
    seen = sorted([*map(tuple, seen), *zip(_steps(w, made_x).tolist(), made_y.tolist(), [1] * len(made_y), strict=True)])
    z, y, times = np.asarray([s[0] for s in seen]) / SCORE_STEPS, np.asarray([s[1] for s in seen], bool), np.asarray([s[2] for s in seen], float)
    slope, offset = _calibrate(z, y, times)
    found = np.cumsum(times[y][::-1])  # from the highest score down
    lowest = z[y][::-1][np.searchsorted(found, LEAST_RECALL * found[-1])]
    return Network(w, slope, offset, float(1 / (1 + np.exp(-np.clip(slope * lowest + offset, -30, 30)))))


def _steps(w: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """The network's outputs, rounded down to whole SCORE_STEPS parts."""
    z = np.concatenate([np.empty(0), *(_forward(w, x[i : i + 512])[0] for i in range(0, len(x), 512))])
    return np.floor(np.clip(z, -30, 30) * SCORE_STEPS).astype(np.int64)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def secret_scan(docs: DataFrame, network: Network | None = None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans), one row for each row of ``docs``.

    Base spans come from every whole text.  Every candidate that no base span touches goes through
    the network, and those over its threshold are spans of kind ``cnn``.  The network is fitted on
    all texts and on made examples (see :func:`fit`).  A null or empty text has no spans (empty
    strings).  Repeated rows get a row each; only doc_id and text are read; an empty table gives an
    empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(network or fit(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            rows, inputs, owner = [], [], []
            for k, text in enumerate(batch.column(1)):
                text = text.as_py() or ""
                base = base_spans(text)
                rows.append((base, []))
                for a, b in candidates(text) if _DIGIT.search(text) else []:
                    if not any(s.start < b and a < s.end for s in base):
                        x = windows(text, a, b)
                        inputs.append(x)
                        owner += [(k, a, b)] * len(x)
            if inputs:
                for (k, a, b), p in zip(owner, net.probability(np.concatenate(inputs)), strict=True):
                    if p >= net.threshold and (not rows[k][1] or rows[k][1][-1] != Span("cnn", a, b)):
                        rows[k][1].append(Span("cnn", a, b))
            count = lambda kind: pa.array([sum(s.kind == kind for s in base) for base, _ in rows], pa.int64())  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), count("assign"), count("access"), count("hex"), pa.array([digest(joined(base, KINDS)) for base, _ in rows], pa.string()), pa.array([joined(base + more, KINDS) for base, more in rows], pa.string())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


_DIGIT = re.compile("[0-9]")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(documents(spark, sf_dir))
