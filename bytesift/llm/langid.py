"""Language identification with a byte-level convolutional network, trained and run in numpy.

Bytes of fixed-length windows are embedded; filters of several widths slide over them, the largest response of
each filter over a window feeds a softmax. A text is all its windows; its language has the largest mean probability.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bytesift.llm.common import bounded_batches, cut

#: Bytes of a window, dimensions of a byte, widths of the filters and filters of each width.
WINDOW, DIMS, WIDTHS, FILTERS = 256, 8, (2, 3, 4), 16
#: The training sample: documents of each language and of all, at most; windows and short pieces drawn from each whole text.
SAMPLE_DOCS, SAMPLE_TOTAL, SAMPLE_WINDOWS, SAMPLE_SHORT = 800, 100_000, 4, 2
UNKNOWN = "und"
#: Windows that the network is applied to at once, and windows of a batch's texts that are gathered before.
CHUNK, GATHERED = 64, 4096


@dataclass
class Model:
    """The learned languages and weights. conv holds all filters at the largest width, narrow ones with zeros behind."""

    languages: list[str]
    embed: np.ndarray
    conv: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray


def data_of(text: str) -> bytes:
    """What the network reads of a text: its bytes in lower case, so that a text in capitals is no other language."""
    return text.lower().encode("utf-8", "replace")


def windows_of(data: bytes) -> np.ndarray:
    """All bytes of a text in windows: one padded with zeros if it is short, else in steps of a window with the last at the end."""
    n = len(data)
    raw = np.frombuffer(data, np.uint8)
    if n <= WINDOW:
        return np.pad(raw, (0, WINDOW - n))[None]
    whole = n // WINDOW
    rows = [raw[: whole * WINDOW].reshape(whole, WINDOW)]
    if n % WINDOW:
        rows.append(raw[None, n - WINDOW :])
    return np.concatenate(rows)


def _patches(model: Model, x: np.ndarray) -> np.ndarray:
    """Windows of bytes -> (window, place, width * dims)."""
    wide = max(WIDTHS)
    e = model.embed[np.pad(x, ((0, 0), (0, wide - 1)))]
    view = np.lib.stride_tricks.sliding_window_view(e, wide, axis=1)  # window, place, dim, width
    return np.ascontiguousarray(view.transpose(0, 1, 3, 2)).reshape(len(x), WINDOW, wide * DIMS)


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def probabilities(model: Model, x: np.ndarray) -> np.ndarray:
    """Windows -> a probability of each language."""
    out = []
    for i in range(0, len(x), CHUNK):
        part = x[i : i + CHUNK]
        h = (_patches(model, part).reshape(-1, max(WIDTHS) * DIMS) @ model.conv).reshape(len(part), WINDOW, -1).max(1)
        out.append(_softmax(np.maximum(h + model.bias, 0) @ model.out + model.out_bias))
    return np.concatenate(out)


def drawn_windows(text: str, seed: int) -> np.ndarray:
    """Windows drawn over a whole text, and short pieces of it, as short texts must be recognised as well."""
    rng = np.random.default_rng(seed)
    data = data_of(text)
    own = windows_of(data)
    own = own[np.sort(rng.choice(len(own), min(SAMPLE_WINDOWS, len(own)), replace=False))]
    starts = rng.integers(0, max(1, len(data) - 64), SAMPLE_SHORT)
    return np.concatenate([own, *(windows_of(data[a : a + int(rng.integers(4, 64))]) for a in starts.tolist())])


def train(x: np.ndarray, labels: list[str], epochs: int = 3, seed: int = 0) -> Model:
    """A model of the labels' languages, by Adam on windows and their labels."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    wide, filters = max(WIDTHS), FILTERS * len(WIDTHS)
    mask = np.concatenate([np.repeat(np.arange(wide * DIMS)[:, None] < w * DIMS, FILTERS, 1) for w in WIDTHS], 1).astype(np.float32)
    p = {
        "embed": rng.normal(0, 0.5, (256, DIMS)),
        "conv": rng.normal(0, 0.3, (wide * DIMS, filters)) * mask,
        "bias": np.zeros(filters),
        "out": rng.normal(0, 0.3, (filters, len(languages))),
        "out_bias": np.zeros(len(languages)),
    }
    p = {k: v.astype(np.float32) for k, v in p.items()}
    model = Model(languages, **p)
    if len(languages) < 2:
        return model
    y = np.searchsorted(languages, labels)
    m, v = ({k: np.zeros_like(w) for k, w in p.items()} for _ in range(2))
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(x), CHUNK):
            own = order[i : i + CHUNK]
            xb, yb = x[own], y[own]
            patches = _patches(model, xb)
            h = (patches.reshape(-1, wide * DIMS) @ p["conv"]).reshape(len(xb), WINDOW, -1)
            at = h.argmax(1)
            pooled = np.take_along_axis(h, at[:, None], 1)[:, 0] + p["bias"]
            a = np.maximum(pooled, 0)
            q = _softmax(a @ p["out"] + p["out_bias"])
            q[np.arange(len(xb)), yb] -= 1
            q /= len(xb)
            back = (q @ p["out"].T) * (pooled > 0)
            best = patches[np.arange(len(xb))[:, None], at]  # window, filter, width * dims
            g = {"out": a.T @ q, "out_bias": q.sum(0), "bias": back.sum(0), "conv": np.einsum("bf,bfk->kf", back, best) * mask}
            into = (back[:, :, None] * p["conv"].T[None]).reshape(len(xb), filters, wide, DIMS)
            byte = np.pad(xb, ((0, 0), (0, wide - 1)))[np.arange(len(xb))[:, None, None], at[:, :, None] + np.arange(wide)]
            g["embed"] = np.stack([np.bincount(byte.ravel(), into[..., d].ravel(), 256) for d in range(DIMS)], 1)
            step += 1
            for k in p:
                m[k] += 0.1 * (g[k] - m[k])
                v[k] += 0.001 * (g[k] ** 2 - v[k])
                p[k] -= (0.003 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text leaves 1 when divided by 3. Null ids: false."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_sample(docs: DataFrame, label: str = "lang") -> pd.DataFrame:
    """doc_id, label, window of at most about SAMPLE_DOCS documents of each language, drawn by a hash, none of them held out.

    Whole texts are read where they lie. What reaches the driver is bounded by SAMPLE_TOTAL documents of a few windows each; it grows
    neither with the table nor with the number of languages, of which each has its share.
    """
    usable = docs.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col(label).isNotNull() & F.col("text").rlike(r"\p{L}"))
    rows = usable.select("doc_id", F.col(label).alias("label"), "text")
    counts = cut(rows.groupBy("label").count())
    n = counts.count()
    each = min(SAMPLE_DOCS, SAMPLE_TOTAL / max(1, n))
    counts = F.broadcast(counts) if n <= SAMPLE_TOTAL else counts  # a name and a number a language
    draw = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    drawn = rows.join(counts, "label").filter(draw < F.lit(float(each)) / F.col("count")).select("doc_id", "label", "text")

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            own = [drawn_windows(t, zlib.crc32(str(d).encode())) for d, t in zip(b["doc_id"], b["text"])]
            many = [len(w) for w in own]
            yield pd.DataFrame({"doc_id": b["doc_id"].repeat(many), "label": b["label"].repeat(many), "window": [w.tobytes() for part in own for w in part]})

    types = dict(rows.dtypes)
    out = drawn.mapInPandas(windows, f"doc_id {types['doc_id']}, label {types['label']}, window binary").toPandas()
    return out.sort_values(["doc_id", "label", "window"], kind="stable", ignore_index=True)


def fit(docs: DataFrame, label: str = "lang") -> Model | None:
    """A model learned from the sample; None if nothing is labelled."""
    bounded_batches(docs.sparkSession)
    sample = training_sample(docs, label)
    if not len(sample):
        return None
    return train(np.frombuffer(b"".join(sample["window"]), np.uint8).reshape(len(sample), WINDOW), sample["label"].tolist())


def predict(model: Model, texts: list[str | None]) -> list[tuple[str, float]]:
    """For each text the language with the largest mean probability over all its windows, and that probability.

    Windows of neighbouring texts go through the network together, GATHERED at a time.
    """
    total, count = np.zeros((len(texts), len(model.languages))), np.zeros(len(texts), np.int64)
    held: list[tuple[int, np.ndarray]] = []
    rows = 0

    def settle() -> None:
        nonlocal rows
        if held:
            owner = np.repeat([i for i, _ in held], [len(x) for _, x in held])
            np.add.at(total, owner, probabilities(model, np.concatenate([x for _, x in held])))
        held.clear()
        rows = 0

    for i, text in enumerate(texts):
        if text is None:
            continue
        x = windows_of(data_of(text))
        count[i] = len(x)
        for a in range(0, len(x), GATHERED):
            held.append((i, x[a : a + GATHERED]))
            rows += len(held[-1][1])
            if rows >= GATHERED:
                settle()
    settle()
    best = total.argmax(1)
    return [(model.languages[k], min(1.0, float(row[k] / n))) if n else (UNKNOWN, 0.0) for k, row, n in zip(best, total, count)]


def _lettered() -> Column:
    return F.when(F.col("text").rlike(r"\p{L}"), F.col("text"))


def identify(docs: DataFrame, model: Model | None, keep: list[str]) -> DataFrame:
    """The columns keep with lang_pred and score, the language's mean probability over the windows of the whole text.

    Null texts and texts without a letter are `und` with score 0, as is everything if the model is None. Repeated rows each
    get a row. Very long texts are read window by window to their end. No rows give no rows.
    """
    bounded_batches(docs.sparkSession)
    if model is None:
        return docs.select(*keep, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))

    def classify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = predict(model, b["text_"].tolist())
            yield b.drop(columns="text_").assign(lang_pred=[o[0] for o in out], score=[o[1] for o in out])

    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    return docs.select(*keep, _lettered().alias("text_")).mapInPandas(classify, ", ".join(f"`{c}` {types[c]}" for c in keep) + ", lang_pred string, score double")


def recognised(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows of docs, with their columns whatever they are, whose language is known with a score of `least` or more."""
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("boolean")
    def known(texts: pd.Series) -> pd.Series:
        return pd.Series([score > 0 and score >= least for _, score in predict(model, texts.tolist())], dtype=bool)

    return docs.filter(known(_lettered()))
