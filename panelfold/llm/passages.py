"""Quality scores by attention-based multiple-instance learning over passages."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelfold.llm.rows import narrow, widen
from panelfold.llm.textscan import _power_tables, as_bytes, mix, pieces

WORDS = 64
HIDDEN, ATTENTION = 24, 12
# Bounds of the training sample: documents, and evenly spaced passages of each.
TRAIN_DOCUMENTS, TRAIN_PASSAGES = 4000, 32
EPOCHS = 80
BUCKETS = 16
CLASSES = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", ".,;:",
           "!", "?", "#$%&*@^~", "|", "<>{}[]()\\/=+_", "'\"-"]


def _class_table() -> np.ndarray:
    table = np.zeros(256, np.uint8)
    for k, members in enumerate(CLASSES):
        for c in members:
            table[ord(c)] = k + 1
    table[128:] = len(CLASSES) + 1
    return table


_CLASS = _class_table()
FEATURES = len(CLASSES) + 8 + BUCKETS


def passage_features(texts: list[bytes], words: int = WORDS):
    """Features of every passage (``words`` words, the last one shorter) and its text's row.

    A text without words has one passage, all zeros.
    """
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff((~blank).astype(np.int8), prepend=0))
    starts, ends = edge[::2], edge[1::2]
    row = np.searchsorted(np.cumsum(sizes), starts, "right")
    counts = np.bincount(row, minlength=len(texts))
    number = np.arange(len(starts)) - np.repeat(np.cumsum(counts) - counts, counts)
    held = np.maximum(1, -(-counts // words))
    base = np.cumsum(held) - held
    passage = base[row] + number // words
    total = int(held.sum())
    n = np.bincount(passage, minlength=total).astype(np.float64)
    per = np.maximum(n, 1)
    length = ends - starts

    def summed(values):
        return np.bincount(passage, weights=values, minlength=total)

    letters = np.maximum(summed(length), 1)
    out = np.zeros((total, FEATURES), np.float32)
    kinds = _CLASS[data]
    for k in range(len(CLASSES) + 1):
        running = np.zeros(len(data) + 1, np.int32)
        np.cumsum(kinds == k + 1, out=running[1:], dtype=np.int32)
        out[:, k] = np.sqrt(summed(running[ends] - running[starts]) / letters)
    at = len(CLASSES) + 1
    power, inverse = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(data * power[:len(data)], out=sums[1:])
    code = mix((sums[ends] - sums[starts]) * inverse[starts] + length.astype(np.uint64))
    mean = summed(length) / per
    out[:, at] = mean / 8
    out[:, at + 1] = np.sqrt(np.maximum(summed(length.astype(float) ** 2) / per - mean ** 2, 0)) / 8
    follows = np.zeros(len(code), bool)
    follows[1:] = (code[1:] == code[:-1]) & (row[1:] == row[:-1])
    out[:, at + 2] = summed(follows) / per
    key = np.sort((passage.astype(np.uint64) << np.uint64(32)) | (code >> np.uint64(32)))
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[1:] != key[:-1]
    kinds_of = np.bincount((key[fresh] >> np.uint64(32)).astype(np.int64), minlength=total)
    out[:, at + 3] = np.where(n > 0, kinds_of / per, 0)
    # A word two or more places ahead of itself: loops over a few words.
    looped = np.zeros(len(code), bool)
    for gap in range(2, 9):
        looped[gap:] |= (code[gap:] == code[:-gap]) & (row[gap:] == row[:-gap])
    out[:, at + 4] = summed(looped) / per
    out[:, at + 5] = np.log1p(n) / 4
    out[:, at + 6] = np.repeat(np.log1p(counts), held) / 8
    bucket = (code % np.uint64(BUCKETS)).astype(np.int64)
    hashed = np.bincount(passage * BUCKETS + bucket, minlength=total * BUCKETS)
    out[:, at + 7:] = hashed.reshape(total, BUCKETS) / per[:, None]
    return out, np.repeat(np.arange(len(texts)), held)


def _softmax_sums(gate, h, row, count):
    """Attention weights within each bag (rows lie together) and the weighted sums."""
    first = np.searchsorted(row, np.arange(count))
    top = np.maximum.reduceat(gate, first)
    e = np.exp(gate - top[row])
    a = e / np.add.reduceat(e, first)[row]
    return a, np.add.reduceat(a[:, None] * h, first, axis=0)


class Attention:
    """Encoder, gated attention and a logistic output, trained together by Adam."""

    def __init__(self, hidden=HIDDEN, attention=ATTENTION, seed=7):
        self.hidden, self.attention, self.seed = hidden, attention, seed

    def _forward(self, x, row, count):
        p = self.p
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        a, z = _softmax_sums((t * g) @ p["w"], h, row, count)
        return h, t, g, a, z, 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))

    def fit(self, x, row, y, epochs=EPOCHS, batch=256, rate=0.01, decay=1e-4):
        """``row`` numbers the bags from 0 and is sorted; ``y`` holds a label per bag."""
        rng = np.random.default_rng(self.seed)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        x = ((x - self.mean) / self.scale).astype(np.float64)
        f, hid, att = x.shape[1], self.hidden, self.attention
        shapes = {"W": (f, hid), "b": (hid,), "V": (hid, att), "U": (hid, att), "w": (att,),
                  "c": (hid,), "d": ()}
        self.p = {k: rng.normal(0, 1 / np.sqrt(s[0]) if s else 0, s) if k not in "bd"
                  else np.zeros(s) for k, s in shapes.items()}
        m = {k: np.zeros(s) for k, s in shapes.items()}
        v = {k: np.zeros(s) for k, s in shapes.items()}
        first = np.searchsorted(row, np.arange(len(y) + 1))
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(y))
            for s in range(0, len(y), batch):
                bags = np.sort(order[s:s + batch])
                sizes = first[bags + 1] - first[bags]
                at = np.concatenate([np.arange(first[b], first[b + 1]) for b in bags])
                own, xb = np.repeat(np.arange(len(bags)), sizes), x[at]
                h, t, g, a, z, s1 = self._forward(xb, own, len(bags))
                p, grads = self.p, {}
                dl = (s1 - y[bags]) / len(bags)
                grads["d"], grads["c"] = dl.sum(), z.T @ dl
                dz = np.outer(dl, p["c"])[own]
                da = (dz * h).sum(1)
                mean = np.add.reduceat(a * da, np.searchsorted(own, np.arange(len(bags))))
                ds = a * (da - mean[own])
                grads["w"] = (t * g).T @ ds
                dt, dg = np.outer(ds, p["w"]) * g * (1 - t * t), np.outer(ds, p["w"]) * t * g * (1 - g)
                grads["V"], grads["U"] = h.T @ dt, h.T @ dg
                dh = (a[:, None] * dz + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
                grads["W"], grads["b"] = xb.T @ dh, dh.sum(0)
                step += 1
                lr = rate * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
                for k in p:
                    gk = grads[k] + decay * p[k]
                    m[k] = 0.9 * m[k] + 0.1 * gk
                    v[k] = 0.999 * v[k] + 0.001 * gk * gk
                    p[k] = p[k] - lr * (m[k] / (1 - 0.9 ** step)) \
                        / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
        return self

    def score(self, x, row, count):
        return self._forward((x - self.mean) / self.scale, row, count)[-1]


def _training_sample(docs: DataFrame, labels: DataFrame, label: str, allowed, documents, per_text):
    """Passage features, bags and labels of at most ``documents`` labelled rows."""
    chosen = (labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
              .select(F.col("doc_id").cast("bigint").alias("_id"), F.col(label).alias("_y"))
              .where(allowed(F.col("_id")))
              .groupBy("_id").agg(F.avg("_y").alias("_y"))
              .orderBy(F.xxhash64("_id"), "_id").limit(documents))
    rows = (docs.join(F.broadcast(chosen), docs["doc_id"] == F.col("_id"))  # documents rows at most
            .select("_id", "_y", docs["text"].alias("text")).dropDuplicates(["_id"])
            .repartition(8, "_id"))

    def run(batches):
        for batch in pieces(batches):
            x, row = passage_features(as_bytes(batch.column(2)))
            keep = []
            for r in range(len(batch)):
                at = np.flatnonzero(row == r)
                keep.append(at[np.unique(np.linspace(0, len(at) - 1, min(len(at), per_text)).astype(int))])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([x[k].ravel() for k in keep],
                                                            pa.list_(pa.float32()))],
                names=["_id", "_y", "x"])

    found = rows.mapInArrow(run, "_id bigint, _y double, x array<float>").toArrow().sort_by("_id")
    bags = [np.asarray(v, np.float32).reshape(-1, FEATURES) for v in found.column("x").to_pylist()]
    return bags, found.column("_y").to_numpy()


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", allowed=None,
          documents: int = TRAIN_DOCUMENTS, per_text: int = TRAIN_PASSAGES) -> Attention | None:
    """Fit on a bounded sample of labelled documents (by hash of the id); None without any."""
    bags, y = _training_sample(docs, labels, label, allowed or (lambda c: F.lit(True)),
                               documents, per_text)
    if not bags:
        return None
    row = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    return Attention().fit(np.concatenate(bags), row, y)


def score(docs: DataFrame, model: Attention | None, keep=("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` columns and ``score``, the chance of label 1, of every whole text.

    Null texts count as empty; they and texts without words have one passage of
    zeros. Without a model (no labels) every score is 0.5. Repeated rows stay.
    """
    keep = list(keep)
    place = keep.index(text) if text in keep else len(keep)
    source = docs.select(*keep, *([] if text in keep else [F.col(text)]))
    schema = docs.select(*keep).withColumn("score", F.lit(0.0)).schema

    def run(batches):
        for batch in pieces(batches, text, 1 << 20):
            if model is None:
                found = np.full(len(batch), 0.5)
            else:
                x, row = passage_features(as_bytes(batch.column(place)))
                found = model.score(x, row, len(batch))
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(len(keep))] + [pa.array(found)],
                names=[*keep, "score"])

    return source.mapInArrow(run, schema)


def good(docs: DataFrame, model: Attention | None, least: float = 0.7) -> DataFrame:
    """The documents that score ``least`` or more, with all their columns; without a
    model, all documents."""
    if model is None:
        return docs
    scored = score(narrow(docs, "doc_id", "text"), model, keep=("doc_id", "text", "_rest"))
    return widen(scored.where(F.col("score") >= least), docs.columns, "doc_id", "text")


def held_out(column):
    """True for a quarter of the ids: never used for training."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit(""))) % 4 == 2
