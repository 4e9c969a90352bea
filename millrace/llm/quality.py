"""Quality classifier by co-training: one model sees the text, the other the page's metadata.

Both are logistic regressions, fitted on a bounded sample of the labelled documents (``labelled`` rows;
which ones is decided by a hash of the id). In every round each view fits, scores all documents of the corpus
where they lie, and hands those that it is sure of to the other view as pseudo-labels. What travels are sums: for
each feature of the other view, how many documents that have it were called good, and how many bad. The
other view's next fit sees them as weighted rows with that one feature, ``LENT`` of the labelled rows in all. So
every document takes part at any size, and the driver holds two arrays of fixed length per view.
At the end each view is calibrated on labelled documents whose labels no fit has seen, the calibrated log-odds
are added, and every document is scored where it lies.

A document is good if its quality label is 1 and it is not labelled toxic.

Text view: which words occur (hashed), with an absolute-value penalty so that words without evidence
weigh nothing, and the shape of the text (symbols, capitals, repeats, line lengths) in steps. Metadata
view: language, source and the order of magnitude of the length.

Defined cases: a null or empty text has no words; null metadata are a value of their own; an empty
table of documents gives an empty table; without labels of both kinds every document is kept; repeated
rows are scored alike; a doc_id labelled twice counts with its worst label; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import row_bytes

LABELLED = 6000
LENT = 0.25  # weight of all pseudo-labels, as a share of the labelled rows
ROUNDS = 2
WORD_BITS = 18
SURE = 0.97  # calibrated probability from which a view hands a pseudo-label over
_SHAPES, _STEPS = 8, 12
_WORDS = 1 << WORD_BITS
_TEXT_DIM = _WORDS + _SHAPES * _STEPS
_META_DIM = 1 << 14
_EDGES = np.array([0.002, 0.005, 0.01, 0.02, 0.04, 0.08, 0.15, 0.25, 0.4, 0.6, 0.8])
_STRIP = b".,;:!?\"'()[]*#$%&|"
_ALL_BYTES = bytes(range(256))
_LETTERS = bytes(b for b in _ALL_BYTES if chr(b).isalnum() and b < 128 or b >= 128)
_UPPER = bytes(range(65, 91))
_BLANK = b" \t\n\x0b\x0c\r"


def shape(text: bytes, words: list[bytes]) -> list[float]:
    """Shares between 0 and 1 that tell prose from junk."""
    n, size = max(1, len(words)), max(1, len(text))
    letters = size - len(text.translate(None, _LETTERS))
    upper = len(text) - len(text.translate(None, _UPPER))
    symbols = len(text.translate(None, _LETTERS + _BLANK))
    lines = text.split(b"\n")
    repeats = sum(map(bytes.__eq__, words, words[1:]))
    return [
        symbols / size,
        upper / max(1, letters),
        repeats / n,
        1 - len(set(words)) / n,
        1 - len(set(lines)) / len(lines),
        min(1.0, len(lines) / n),
        min(1.0, size / n / 20),
        min(1.0, math.log10(1 + len(words)) / 5),
    ]


def text_features(text: bytes) -> np.ndarray:
    """Numbers of the features that the text has."""
    words = text.lower().split()
    steps = np.searchsorted(_EDGES, shape(text, words), side="right")
    own = {w.strip(_STRIP) for w in set(words)}
    hashed = np.fromiter({zlib.crc32(w) & (_WORDS - 1) for w in own if w}, np.int32)
    return np.concatenate([np.sort(hashed), (_WORDS + np.arange(_SHAPES) * _STEPS + steps).astype(np.int32)])


def meta_features(lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    size = -1 if n_chars is None else int(n_chars).bit_length()
    return np.array([zlib.crc32(f"{name}={value!r}".encode()) & (_META_DIM - 1) for name, value in (("lang", lang), ("source", source), ("size", size), ("lang+size", (lang, size)))], np.int32)


@dataclass
class Linear:
    weights: np.ndarray
    intercept: float
    scale: float = 1.0  # calibration
    shift: float = 0.0

    def raw(self, features: list[np.ndarray]) -> np.ndarray:
        return np.array([self.weights[f].sum() for f in features]) + self.intercept

    def logit(self, features: list[np.ndarray]) -> np.ndarray:
        return self.scale * self.raw(features) + self.shift


@dataclass
class Model:
    text: Linear
    meta: Linear
    prior: float


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


Lent = tuple[np.ndarray, np.ndarray]  # by feature: documents called bad, and called good


def fit_linear(features: list[np.ndarray], labels: np.ndarray, lent: Lent | None, dim: int, free_from: int, penalty: float, steps: int = 120) -> Linear:
    """Logistic regression on present features by accelerated proximal gradients; features below ``free_from`` pay by absolute value."""
    flat = np.concatenate(features)
    rows = np.repeat(np.arange(len(features)), [len(f) for f in features])
    counts, weight, labels = np.bincount(flat, minlength=dim), np.ones(len(features)), labels.astype(float)
    if lent is not None and lent[0].sum() + lent[1].sum() > 0:
        scale = LENT * len(features) / (lent[0].sum() + lent[1].sum())
        for label, called in enumerate(lent):
            has = np.flatnonzero(called)
            flat, rows = np.concatenate([flat, has]), np.concatenate([rows, len(weight) + np.arange(len(has))])
            weight, labels = np.concatenate([weight, called[has] * scale]), np.concatenate([labels, np.full(len(has), float(label))])
            counts = counts + called
    keep = (counts >= 3)[flat]
    flat, rows = flat[keep], rows[keep]
    names, flat = np.unique(flat, return_inverse=True)
    n, total = len(weight), weight.sum()
    cost = np.where(names < free_from, penalty, 0.0)
    # A step that suits each feature: common ones move less.
    used = np.bincount(flat, weights=weight[rows], minlength=len(names)) / total
    rate = 1 / (0.25 * np.maximum(used, 1e-9) * max(1.0, (len(np.concatenate(features)) / len(features)) ** 0.5) + 1e-3)
    w, look, b, look_b, t = np.zeros(len(names)), np.zeros(len(names)), 0.0, 0.0, 1.0
    prior = np.clip((weight * labels).sum() / total, 1e-3, 1 - 1e-3)
    b = look_b = float(np.log(prior / (1 - prior)))
    for _ in range(steps):
        z = np.bincount(rows, weights=look[flat], minlength=n) + look_b
        error = weight * (_sigmoid(z) - labels) / total
        grad = np.bincount(flat, weights=error[rows], minlength=len(names)) + 1e-5 * look
        step = look - rate * grad
        new = np.sign(step) * np.maximum(np.abs(step) - rate * cost, 0)
        new_b = look_b - 2.0 * error.sum()
        t_new = (1 + math.sqrt(1 + 4 * t * t)) / 2
        if ((look - new) * (new - w)).sum() > 0:  # restart the momentum where it overshoots
            t_new = 1.0
        look, look_b = new + (t - 1) / t_new * (new - w), new_b + (t - 1) / t_new * (new_b - b)
        w, b, t = new, new_b, t_new
    weights = np.zeros(dim)
    weights[names] = w
    return Linear(weights, float(b))


def calibrate(model: Linear, features: list[np.ndarray], labels: np.ndarray) -> Linear:
    """Platt scaling by a few Newton steps, with smoothed targets so that a perfect view stays finite."""
    if not len(labels) or labels.min() == labels.max():
        return model
    x, good = model.raw(features), labels.sum()
    bad = len(labels) - good
    goal = np.where(labels > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    spread = x.std()
    if spread < 1e-9:  # this view says nothing
        return Linear(model.weights, model.intercept, 0.0, float(np.log((good + 1) / (bad + 1))))
    design = np.stack([(x - x.mean()) / spread, np.ones(len(x))], 1)
    beta = np.zeros(2)
    for _ in range(30):
        p = _sigmoid(design @ beta)
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 1e-4 * np.eye(2)
        beta = beta + np.clip(np.linalg.solve(hessian, design.T @ (goal - p) - 1e-4 * beta), -2, 2)
    scale = max(0.0, beta[0] / spread)
    return Linear(model.weights, model.intercept, float(scale), float(beta[1] - beta[0] * x.mean() / spread))


def fit_views(text: list[np.ndarray], meta: list[np.ndarray], label: np.ndarray, lent: dict[str, Lent] | None = None) -> Model | None:
    """Both views from labelled documents, 1 good and 0 bad, and what the other view lent. Every fifth only calibrates.

    None if there are not documents of both kinds to fit on.
    """
    held = np.arange(len(label)) % 5 == 0
    base, rest = np.flatnonzero(~held), np.flatnonzero(held)
    if not len(base) or label[base].min() == label[base].max():
        return None
    views = {"text": (text, _TEXT_DIM, _WORDS, 1.0 / len(base) * 1.5), "meta": (meta, _META_DIM, _META_DIM, 2.0 / len(base))}
    made = {}
    for name, (features, dim, free, penalty) in views.items():
        fitted = fit_linear([features[k] for k in base.tolist()], label[base], lent and lent[name], dim, free, penalty)
        made[name] = calibrate(fitted, [features[k] for k in rest.tolist()], label[rest])
    share = (label.sum() + 1) / (len(label) + 2)
    return Model(made["text"], made["meta"], float(np.log(share / (1 - share))))


_BLOCK = 1 << 13  # features whose sums travel together
_DIMS = {"text": _TEXT_DIM, "meta": _META_DIM}
_SUMS = "view string, called int, block int, sums binary"


def _features(batch: pa.RecordBatch) -> dict[str, list[np.ndarray]]:
    text = [text_features(t) for t in row_bytes(batch.column("text"))]
    meta = [meta_features(*m) for m in zip(*(batch.column(n).to_pylist() for n in ("lang", "source", "n_chars")), strict=True)]
    return {"text": text, "meta": meta}


def lend(docs: DataFrame, model: Model) -> dict[str, Lent]:
    """Of each view the sums by feature of all documents that the other view is sure of."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {view: np.zeros((2, -(-dim // _BLOCK) * _BLOCK), np.int64) for view, dim in _DIMS.items()}
        for batch in batches:
            features = _features(batch)
            for view, other in (("text", "meta"), ("meta", "text")):
                p = _sigmoid(getattr(shared.value, view).logit(features[view]))
                for called, sure in enumerate((p <= 1 - SURE, p >= SURE)):
                    if sure.any():
                        given = np.concatenate([features[other][k] for k in np.flatnonzero(sure).tolist()])
                        sums[other][called] += np.bincount(given, minlength=sums[other].shape[1])
        rows = []
        for view, both in sums.items():
            for called, flat in enumerate(both):
                rows += [(view, called, k, part.tobytes()) for k, part in enumerate(flat.reshape(-1, _BLOCK)) if part.any()]
        columns = [*zip(*rows, strict=True)] or [(), (), (), ()]
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["view", "called", "block", "sums"])

    def summed(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), np.int64) for x in group.column("sums"))
        return group.slice(0, 1).set_column(3, "sums", pa.array([total.tobytes()], pa.binary()))

    parts = docs.select("text", "lang", "source", "n_chars").mapInArrow(run, _SUMS)
    lent = {view: (np.zeros(dim, np.int64), np.zeros(dim, np.int64)) for view, dim in _DIMS.items()}
    for r in parts.groupBy("view", "called", "block").applyInArrow(summed, _SUMS).collect():  # as many numbers as features
        into = lent[r["view"]][r["called"]]
        at = r["block"] * _BLOCK
        into[at : at + _BLOCK] = np.frombuffer(r["sums"], np.int64)[: len(into) - at]
    return lent


_SAYS_NOTHING = Model(Linear(np.zeros(_TEXT_DIM), 1.0, 0.0, 1.0), Linear(np.zeros(_META_DIM), 1.0, 0.0, 1.0), 0.0)


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS) -> Model:
    """Fit on at most ``labelled`` labelled documents, the first by a hash of the id, and on pseudo-labels of all documents."""
    own = labels.where("quality IS NOT NULL OR toxic IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(F.min(((F.coalesce("quality", F.lit(1)) == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).cast("int")).alias("_good"))
    ids = docs.select(F.col("doc_id").alias("_doc")).join(own, F.col("_doc") == F.col("_id")).select("_doc", F.col("_good").alias("good"), F.xxhash64("_doc", F.lit(11)).alias("k"))
    # The ids of the sample alone, of bounded number: the broadcast that picks their texts is bounded too.
    chosen = ids.orderBy("k", "_doc").limit(labelled)
    chosen = F.broadcast(chosen.select(F.col("_doc").alias("_id"), "good").dropDuplicates(["_id"]))
    sample = docs.select("doc_id", "text", "lang", "source", "n_chars").join(chosen, F.col("doc_id") == F.col("_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            features = {view: pa.array([x.tolist() for x in rows], pa.list_(pa.int32())) for view, rows in _features(batch).items()}
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("good").cast(pa.int32()), features["text"], features["meta"]], ["doc_id", "good", "t", "m"])

    rows = sample.mapInArrow(run, "doc_id long, good int, t array<int>, m array<int>").toArrow()
    order = np.argsort(rows["doc_id"].to_numpy(), kind="stable")
    text, meta = ([np.asarray(rows[name][k].values, np.int32) for k in order.tolist()] for name in ("t", "m"))
    label = rows["good"].to_numpy()[order]
    model = fit_views(text, meta, label)
    for _ in range(rounds if model else 0):
        model = fit_views(text, meta, label, lend(docs, model))
    return model or _SAYS_NOTHING


_OUT = "doc_id long, text_score double, meta_score double, score double, keep boolean"


def _scores(batch: pa.RecordBatch, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    text = np.array([model.text.weights[text_features(t)].sum() for t in row_bytes(batch.column("text"))]) + model.text.intercept
    meta = model.meta.raw([meta_features(*m) for m in zip(*(batch.column(n).to_pylist() for n in ("lang", "source", "n_chars")), strict=True)])
    text, meta = model.text.scale * text + model.text.shift, model.meta.scale * meta + model.meta.shift
    return text, meta, _sigmoid(text + meta - model.prior)


def score(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """doc_id, the log-odds of both views, the joint probability of being good, and whether the document is kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two weight arrays of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                text, meta, p = _scores(batch, shared.value)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *map(pa.array, (text, meta, p, p >= threshold))], ["doc_id", "text_score", "meta_score", "score", "keep"])

    return docs.select("doc_id", "text", "lang", "source", "n_chars").mapInArrow(run, _OUT)


def kept_documents(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The documents that are kept, with their own columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(_scores(batch, shared.value)[2] >= threshold))

    return docs.mapInArrow(run, docs.schema)
