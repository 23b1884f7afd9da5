"""Language identification by a bidirectional gated recurrent network over bytes.

Two gated recurrent layers read a window of bytes, one forwards and one backwards. Their states at
every byte give a label distribution for that position; the positions of all windows of a document
are averaged into its probabilities. The network is trained in numpy by backpropagation through time
on a bounded sample of labelled windows, then applied to every window of every text.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNKNOWN = "und"
WIDTH = 128
BATCH = 1024


class Network(NamedTuple):
    """Weights: input gates by byte (256, 3H), recurrent gates (H, 3H) per direction, output layer.

    Gates are update, reset and candidate. ``labels`` are the languages in output order.
    """

    labels: list[str]
    inputs: list[np.ndarray]
    recurrent: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def start_network(labels: Sequence[str], hidden: int, rng: np.random.Generator) -> Network:
    def small(*shape: int, scale: float) -> np.ndarray:
        return rng.normal(0, scale, shape).astype(np.float32)

    return Network(
        list(labels),
        [small(256, 3 * hidden, scale=0.3) for _ in range(2)],
        [small(hidden, 3 * hidden, scale=hidden**-0.5) for _ in range(2)],
        small(2 * hidden, len(labels), scale=0.3),
        np.zeros(len(labels), np.float32),
    )


def run_direction(codes: np.ndarray, mask: np.ndarray, w: np.ndarray, u: np.ndarray, keep: bool = False):
    """States (T, B, H) of one layer over ``codes`` (T, B); padding leaves the state as it is.

    With ``keep`` the gate values needed for the backward pass come along.
    """
    steps, rows = codes.shape
    h = u.shape[0]
    state = np.zeros((rows, h), np.float32)
    states, saved = np.empty((steps, rows, h), np.float32), []
    for t in range(steps):
        x, gates = w[codes[t]], state @ u[:, : 2 * h]
        zr = _sigmoid(x[:, : 2 * h] + gates)
        z, r = zr[:, :h], zr[:, h:]
        back = state @ u[:, 2 * h :]
        c = np.tanh(x[:, 2 * h :] + r * back)
        m = mask[t][:, None]
        if keep:
            saved.append((state, z, r, back, c, m))
        state = state + m * z * (c - state)
        states[t] = state
    return (states, saved) if keep else states


def back_direction(codes: np.ndarray, saved: list, u: np.ndarray, grad: np.ndarray):
    """Gradients of input and recurrent weights from ``grad`` (T, B, H), back through time."""
    h = u.shape[0]
    dw, du = np.zeros((256, 3 * h), np.float32), np.zeros_like(u)
    later = np.zeros_like(grad[0])
    for t in range(len(saved) - 1, -1, -1):
        state, z, r, back, c, m = saved[t]
        d = grad[t] + later
        dz, dc = d * m * (c - state), d * m * z
        da = dc * (1 - c * c)
        dr = da * back
        gates = np.concatenate([dz * z * (1 - z), dr * r * (1 - r)], axis=1)
        du[:, : 2 * h] += state.T @ gates
        du[:, 2 * h :] += state.T @ (da * r)
        np.add.at(dw, codes[t], np.concatenate([gates, da], axis=1))
        later = d * (1 - m * z) + gates @ u[:, : 2 * h].T + (da * r) @ u[:, 2 * h :].T
    return dw, du


def position_labels(net: Network, codes: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Label probabilities (T, B, L) of every byte of a batch of windows (T, B)."""
    ahead = run_direction(codes, mask, net.inputs[0], net.recurrent[0])
    behind = run_direction(codes[::-1], mask[::-1], net.inputs[1], net.recurrent[1])[::-1]
    h = ahead.shape[2]
    return _softmax(ahead @ net.out[:h] + behind @ net.out[h:] + net.bias)


def train(
    windows: list[bytes],
    labels: list[str],
    hidden: int = 8,
    rounds: int = 240,
    batch: int = 128,
    rate: float = 0.02,
    seed: int = 7,
) -> Network:
    """Fit by Adam on cross-entropy at every position; the same windows give the same network."""
    rng = np.random.default_rng(seed)
    names = sorted(set(labels))
    net = start_network(names, hidden, rng)
    target = np.array([names.index(x) for x in labels])
    codes, mask = to_batch(windows)
    weights = [*net.inputs, *net.recurrent, net.out, net.bias]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    share = np.bincount(target, minlength=len(names)) / len(target)
    for step in range(1, rounds + 1):
        rows = rng.choice(len(windows), size=min(batch, len(windows)), p=None, replace=False)
        x, m, y = codes[:, rows], mask[:, rows], target[rows]
        ahead, kept_a = run_direction(x, m, net.inputs[0], net.recurrent[0], keep=True)
        behind, kept_b = run_direction(x[::-1], m[::-1], net.inputs[1], net.recurrent[1], keep=True)
        both = np.concatenate([ahead, behind[::-1]], axis=2)
        error = _softmax(both @ net.out + net.bias)
        error[:, np.arange(len(rows)), y] -= 1
        error *= (m / max(1.0, float(m.sum())))[:, :, None] * (1 / (len(names) * share[y]))[None, :, None]
        error = error.astype(np.float32)
        dout = np.einsum("tbh,tbl->hl", both, error)
        dstate = error @ net.out.T
        da, ua = back_direction(x, kept_a, net.recurrent[0], dstate[:, :, :hidden])
        db, ub = back_direction(x[::-1], kept_b, net.recurrent[1], dstate[::-1, :, hidden:])
        grads = [da, db, ua, ub, dout, error.sum(axis=(0, 1))]
        speed = rate * min(1.0, 2 * (1 - step / (rounds + 1)))
        for w, g, a, b in zip(weights, grads, first, second, strict=True):
            g = np.clip(g, -1, 1)
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            w -= speed * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6)
    return net


def to_batch(windows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Windows as byte codes (A-Z as a-z) and mask, both (T, B)."""
    sizes = np.array([len(w) for w in windows])
    steps = int(sizes.max(initial=1))
    flat = np.frombuffer(b"".join(w.ljust(steps, b"\0") for w in windows).lower(), np.uint8)
    mask = (np.arange(steps)[:, None] < sizes[None, :]).astype(np.float32)
    return np.ascontiguousarray(flat.reshape(-1, steps).T), mask


def predict_texts(net: Network, texts: Iterator[bytes]) -> Iterator[np.ndarray]:
    """Mean label probabilities of each text, all bytes counted. Windows of many texts share a batch."""
    waiting: list[tuple[int, bytes]] = []
    totals: list[np.ndarray] = []
    sizes: list[int] = []
    done = 0

    def flush() -> None:
        order = sorted(waiting, key=lambda x: -len(x[1]))
        codes, mask = to_batch([w for _, w in order])
        found = np.einsum("tbl,tb->bl", position_labels(net, codes, mask), mask)
        for (owner, _), row in zip(order, found, strict=True):
            totals[owner - done] += row
        waiting.clear()

    for number, text in enumerate(texts):
        totals.append(np.zeros(len(net.labels)))
        sizes.append(len(text))
        for begin in range(0, len(text), WIDTH):
            waiting.append((number, text[begin : begin + WIDTH]))
            if len(waiting) == BATCH:
                flush()
        if len(totals) >= 4 * BATCH:
            if waiting:
                flush()
            yield from (t / max(1, n) for t, n in zip(totals, sizes, strict=True))
            done += len(totals)
            totals.clear()
            sizes.clear()
    if waiting:
        flush()
    yield from (t / max(1, n) for t, n in zip(totals, sizes, strict=True))


def _lowest(share: float) -> int:
    """Upper bound of the lowest ``share`` of signed 64-bit hashes."""
    return min(2**63 - 1, int(share * 2**64) - 2**63)


def sample_windows(df: DataFrame, id_col: str, text_col: str, lang_col: str, rows: Column, per_lang: int):
    """Windows and labels to learn from: at most ``per_lang`` texts per language, a window of each.

    The texts of lowest id hash are taken and, of each, the window that the hash points at; null
    languages, null texts and texts without a letter teach nothing. The hashes are cut at twice the
    share wanted before they are ranked; of equal ids (one hash) a language may then give fewer.
    """
    usable = df.where(rows & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    named = usable.select(
        F.col(lang_col).alias("lang"), F.col(text_col).cast("binary").alias("data"),
        F.xxhash64(F.col(id_col).cast("string"), F.lit(1)).alias("key"),
    )
    # only hashes that can be among the lowest are ranked, so that no task gets a whole language
    sizes = {r["lang"]: r["count"] for r in named.groupBy("lang").count().collect()}
    near = [F.when(F.col("lang") == lang, F.lit(_lowest(2 * per_lang / n))) for lang, n in sizes.items()]
    named = named.where(F.col("key") <= F.coalesce(*near)) if near else named
    places = F.greatest(F.lit(1), F.ceil(F.octet_length("data") / WIDTH))
    begin = F.pmod(F.xxhash64("key"), places) * WIDTH
    named = named.select("lang", "key", F.substring("data", (begin + 1).cast("int"), F.lit(WIDTH)).alias("window"))
    order = Window.partitionBy("lang").orderBy("key", "window")
    few = named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_lang)
    found = few.orderBy("lang", "rank").collect()
    return [bytes(r["window"]) for r in found], [r["lang"] for r in found]


def identify(
    df: DataFrame,
    id_col: str,
    text_col: str,
    lang_col: str,
    learn_from: Column,
    per_lang: int = 1500,
    hidden: int = 8,
    rounds: int = 240,
) -> DataFrame:
    """All columns of ``df`` with ``lang_pred`` and ``score``, the share of the label over the text.

    Learns from ``learn_from`` rows only, at most ``per_lang`` windows of ``WIDTH`` bytes for each
    language (the bound of what reaches the driver); reads only the text to predict. Null texts and
    texts without a letter, and all texts if there is nothing to learn from, are ``und`` with score
    0. Equal rows are predicted alike; columns named like the added ones are replaced; an empty table
    gives none. Texts are read in windows, so a long one costs time and not memory.
    """
    windows, labels = sample_windows(df, id_col, text_col, lang_col, learn_from, per_lang)
    net = train(windows, labels, hidden, rounds) if windows else None
    shared = df.sparkSession.sparkContext.broadcast(net)
    result = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())])

    @F.arrow_udf(result)
    def label(texts: pa.Array) -> pa.Array:
        model = shared.value
        langs, scores = [], []
        rows = (t.as_py() or b"" for t in texts)
        for shares in predict_texts(model, rows):
            best = int(np.argmax(shares))
            langs.append(model.labels[best])
            scores.append(min(1.0, float(shares[best])))
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

    rest = df.drop("lang_pred", "score")
    letters = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    if net is None:
        return rest.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
    read = rest.withColumn("__llm_label", label(F.when(letters, F.col(text_col)).cast("binary")))
    return read.withColumns(
        {
            "lang_pred": F.when(letters, F.col("__llm_label.lang")).otherwise(UNKNOWN),
            "score": F.when(letters, F.col("__llm_label.score")).otherwise(0.0),
        }
    ).drop("__llm_label")
