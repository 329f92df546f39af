"""Operator 5: toxicity by compression distance with zstandard dictionaries of two classes.

The words of labelled toxic and ordinary texts are dealt at random into bags of
equal numbers; each bag is the content of one zstandard dictionary, so a
dictionary holds what is frequent in its class and by chance some of the rest.
A window is a word (or ``WINDOW`` bytes of a longer one), compressed once with
each dictionary of either class. Its distance is the mean length under the
ordinary dictionaries less that under the toxic ones: strings that are more
frequent in toxic text cost less there, and what has been met by chance evens
out over the pairs. Nothing is counted, picked or listed by hand.

A match costs zstandard about as much as three or four bytes, too coarse for a
word. So a byte is written as ``WIDE`` random bytes that depend on it and on its
place in the window: a string counts ``WIDE``-fold, and matches only where it
stands at the same place of a word.

A window goes through the pairs by ``STAGES`` and is left, at distance 0, when its
mean does not pass ``SCREEN``; the new windows of ``GROUP`` texts go through each dictionary
together, which keeps it in the processor's cache. A text is described by the distances of its windows:
their sum, share and largest values, and how many exceed each of ``LIMITS``.
Logistic regression calibrates that to a score, whose threshold is where
precision and recall on the calibration texts balance best. It learns from documents
whose own half of the labelled texts was not in the dictionaries used; the
final distances use the dictionaries of both halves.

At most about ``sample`` labelled rows are used (chosen by a hash of doc_id,
all of them if there are fewer) and about ``POOL`` windows of each class and
half; that bounds the dictionaries and what reaches the driver. Scoring reads
every whole text, however long, and nothing but the text.

Null and empty texts have a score like any other (no window, no distance).
Labels other than 0 and 1 teach nothing; repeated labels count once for each;
repeated documents each get a row; an empty table gives no rows; other columns
are ignored, whatever they are called. Without labels of both classes the score
is the share of label 1 (0 without labels).
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, pin, text_key

THRESHOLD = 0.5
SAMPLE = 8000
WINDOW = 32
WIDE = 4
PAIRS = 20
BAG = 2600
POOL = 50_000
STAGES, SCREEN = (2, 8), 1.0
LIMITS = (3.0, 5.0)
FEATURES = 6 + 2 * len(LIMITS)
CACHE = 800_000
GROUP = 256
_EDGE = re.compile(rb"[\s.,!?|#$%&*;:\"()]+")
_CODE = np.random.default_rng(5).integers(0, 256, (WINDOW, 256, WIDE), dtype=np.uint8)
_BYTES = [[_CODE[place, byte].tobytes() for byte in range(256)] for place in range(WINDOW)]


def windows(text: str | None) -> list[bytes]:
    """The words of a text in lower case, longer ones in pieces."""
    words = _EDGE.split((text or "").lower().encode("utf-8", "surrogatepass"))
    return [w if len(w) <= WINDOW else w[i : i + WINDOW] for w in words if w for i in range(0, len(w), WINDOW)]


def _wide(window: bytes) -> bytes:
    return b"".join([place[byte] for place, byte in zip(_BYTES, window)])


def _compressor(bag: bytes):
    how = zstandard.ZstdCompressionParameters(
        window_log=17, hash_log=13, chain_log=13, search_log=1, min_match=4, target_length=0, strategy=zstandard.STRATEGY_DFAST, write_content_size=False, write_dict_id=False
    )
    content = b"".join(map(_wide, bag.split())) or b"\0" * 8
    return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=how).compress


# Dictionaries and distances of the last model used, for the life of a process.
_ready: dict[str, tuple[list, dict[int | None, dict[bytes, float]]]] = {}


class Model:
    """``bags``: for each half the bags of ordinary and of toxic windows, separated by spaces."""

    def __init__(self, bags: list[tuple[list[bytes], list[bytes]]], constant: float | None = None):
        self.bags, self.constant, self.name = bags, constant, uuid.uuid4().hex
        self.center = self.scale = self.weights = None

    def _prepared(self):
        if self.name not in _ready:
            _ready.clear()
            pairs = [[(_compressor(a), _compressor(b)) for a, b in zip(*half)] for half in self.bags]
            _ready[self.name] = (pairs, {})
        return _ready[self.name]

    def measure(self, half: int | None = None):
        """A function from texts to their features, with the dictionaries of one half or of both."""
        pairs, known = self._prepared()
        pairs = [p for both in zip(*pairs) for p in both] if half is None else pairs[half]
        distances = known.setdefault(half, {})

        def meet(new: list[bytes]) -> None:
            """Distances of windows not met yet."""
            left, total, done = np.arange(len(new)), np.zeros(len(new)), 0
            wide = [*map(_wide, new)]
            for upto in (*STAGES, len(pairs)):
                some = [wide[i] for i in left.tolist()]
                for a, b in pairs[done:upto]:
                    total[left] += np.fromiter(map(len, map(a, some)), np.int64, len(some)) - np.fromiter(map(len, map(b, some)), np.int64, len(some))
                done = upto
                left = left[total[left] > SCREEN * done]
            far = np.zeros(len(new))
            far[left] = total[left] / done
            distances.update(zip(new, far.tolist()))

        def run(texts: list[str | None]) -> list[list[float]]:
            cut = [windows(text) for text in texts]
            found = dict.fromkeys(w for own in cut for w in own)
            new = [w for w in found if w not in distances]
            if len(distances) + len(new) > CACHE:
                distances.clear()
                new = [*found]
            if new:
                meet(new)
            return [described(own) for own in cut]

        def described(all_windows: list[bytes]) -> list[float]:
            n = len(all_windows)
            far = sorted((d for d in map(distances.__getitem__, all_windows) if d), reverse=True)
            total = sum(far)
            out = [np.log1p(total), np.log1p(100 * total / (n + 5)), *(far + [0.0, 0.0, 0.0])[:3], np.log1p(n)]
            for limit in LIMITS:
                more = sum(d > limit for d in far)
                out += [np.log1p(more), np.log1p(100 * more / (n + 5))]
            return [float(x) for x in out]

        return run

    def calibrate(self, x: np.ndarray, y: np.ndarray, penalty: float = 0.1) -> None:
        self.center, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        a = np.c_[np.ones(len(x)), (x - self.center) / self.scale]
        w = np.zeros(a.shape[1])
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -50, 50)))
            step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + penalty * np.eye(len(w)), a.T @ (p - y) + penalty * w)
            w -= step
            if np.abs(step).max() < 1e-9:
                break
        # 0.5 is where precision and recall on these documents balance best.
        z = a @ w
        order = np.argsort(-z, kind="stable")
        right = np.cumsum(y[order])
        best = int(np.argmax(2 * right / (np.arange(1, len(z) + 1) + y.sum())))
        w[0] -= (z[order[best]] + z[order[min(best + 1, len(z) - 1)]]) / 2
        self.weights = w

    def probability(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + (x - self.center) / self.scale @ self.weights[1:], -50, 50)))


def _bags(pools: list[list[bytes]], seed: int) -> tuple[list[bytes], list[bytes]]:
    """PAIRS bags of windows from each pool, all of one size, dealt round after round."""
    size = max(1, min(BAG, *(len(p) // 2 for p in pools)))
    out = []
    for k, pool in enumerate(pools):
        order = np.random.default_rng([seed, k])
        dealt = np.concatenate([order.permutation(len(pool)) for _ in range(-(-PAIRS * size // len(pool)))])
        out.append([b" ".join(pool[i] for i in dealt[j * size : (j + 1) * size]) for j in range(PAIRS)])
    return out[0], out[1]


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> Model:
    known = labels.filter(~held_out() & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("label"))
    n = known.count()
    if n > sample:
        known = known.filter(F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1_000_000)) < int(1_000_000 * sample / n))
    # At most about `sample` rows of two numbers: small enough to broadcast at any size of the input.
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id")
    # Equal texts share a half, so that none is measured by a dictionary that holds it.
    rows = rows.withColumn("tkey", text_key()).withColumn("half", F.pmod(F.xxhash64(F.lit(6), "tkey"), F.lit(2)).cast("int"))
    rows = pin(rows.select("tkey", "half", "label", "text"), "labelled")
    sizes = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(sizes) < 2:
        return Model([], float(next(iter(sizes), 0)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for half, y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                own = list(dict.fromkeys(windows(text.as_py())))
                order = pa.array(_spread(own), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array([half] * len(own), pa.int32()), pa.array([y] * len(own), pa.int32()), pa.array(own, pa.binary()), order], ["half", "y", "w", "at"])

    base = rows.groupBy("tkey").agg(F.first("half").alias("half"), F.max("label").alias("label"), F.first("text").alias("text"))
    pool = pin(base.select("half", "label", "text").mapInArrow(cut, "half int, y int, w binary, at double"), "windows")
    counts = {(r.half, r.y): r["count"] for r in pool.groupBy("half", "y").count().collect()}
    share = F.lit(0.0)
    for (half, y), count in counts.items():
        share = F.when((F.col("half") == half) & (F.col("y") == y), min(1.0, POOL / count)).otherwise(share)
    taken: dict[tuple[int, int], list[bytes]] = {}
    for r in pool.filter(F.col("at") < share).collect():  # about POOL windows of each half and class at most
        taken.setdefault((r.half, r.y), []).append(bytes(r.w))
    pools = [[sorted(taken.get((h, y), [])) for y in (0, 1)] for h in (0, 1)]
    # With too few texts for two halves both have all of them.
    if any(not p for half in pools for p in half):
        pools = [[sorted(pools[0][y] + pools[1][y]) for y in (0, 1)]] * 2
    if any(not p for p in pools[0]):
        return Model([], sizes[1] / sum(sizes.values()))
    model = Model([_bags(p, seed) for seed, p in enumerate(pools)])
    held = _measured(rows.select("half", "label", "text"), model).collect()  # about `sample` rows of FEATURES numbers at most
    held.sort(key=lambda r: (r.y, r.x))
    model.calibrate(np.array([r.x for r in held]), np.array([r.y for r in held], float))
    return model


def _spread(own: list[bytes]) -> np.ndarray:
    """A number from 0 to 1 for each window, the same in every run, that depends on the text as well."""
    seed = xxhash.xxh3_64_intdigest(b" ".join(own[:50]))
    return np.array([xxhash.xxh3_64_intdigest(w, seed=seed) for w in own], float) / 2.0**64


def _measured(rows: DataFrame, model: Model) -> DataFrame:
    """(y, x) of labelled texts, each measured with the dictionaries of the other half."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = [model.measure(1), model.measure(0)]
        for batch in batches:
            for at in range(0, batch.num_rows, GROUP):
                piece = batch.slice(at, GROUP)
                halves, texts, x = piece.column(0).to_pylist(), piece.column(2).to_pylist(), [None] * piece.num_rows
                for h in (0, 1):
                    own = [i for i, half in enumerate(halves) if half == h]
                    for i, features in zip(own, measure[h]([texts[i] for i in own])):
                        x[i] = features
                yield pa.RecordBatch.from_arrays([piece.column(1), pa.array(x, pa.list_(pa.float64()))], ["y", "x"])

    return rows.mapInArrow(run, "y int, x array<double>")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score): the probability of label 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = model.measure() if model.constant is None else lambda texts: [[0.0] * FEATURES] * len(texts)
        for batch in batches:
            for at in range(0, batch.num_rows, GROUP):
                piece = batch.slice(at, GROUP)
                x = np.array(measure(piece.column(1).to_pylist())).reshape(-1, FEATURES)
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(model.probability(x), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")
