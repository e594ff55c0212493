"""Quality of documents by attention over their passages (multiple-instance learning).

A document is a bag of passages of 64 tokens, and only the bag has a label. A
passage is encoded from its bytes: shares of characters, lengths, repetitions,
and hashed words and word shapes. A layer turns the encoding into a vector;
gated attention, ``w · (tanh(V h) * sigmoid(U h))`` through a softmax over the
document's passages, weighs it; the weighted vector of the document is scored.
All weights are learned together from the labels of documents.

The model is fitted on a bounded sample of labelled rows, each with all its
passages; every document is scored over its whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curbmeter.llm.shared import free_name, store
from curbmeter.llm.words import _runs, list_array, run_hashes, text_chunks

PASSAGE = 64
# Labelled rows taken to learn from, at most, per label; the classes' true shares weigh them.
SAMPLE = 3000
# Passages of the sampled documents of one label, at most; documents are taken whole or not at all.
PASSAGES = 64 * SAMPLE
HASHED = 64
HIDDEN = 24
GATE = 12
EPOCHS = 14
SEED = 7

# Bytes that are encoded at once, about; a longer text is encoded in blocks of whole passages.
BLOCK_BYTES = 1 << 20

# Classes of bytes whose shares in a passage are counted.
_MARKS = "!|%#*&;/:.,<>{}@_-\"'()=+$?"
_CLASS = np.zeros(256, np.int64)
for _b in range(256):
    _c = chr(_b)
    if _b >= 0x80:
        _CLASS[_b] = 5
    elif _c.islower():
        _CLASS[_b] = 0
    elif _c.isupper():
        _CLASS[_b] = 1
    elif _c.isdigit():
        _CLASS[_b] = 2
    elif _c == "\n":
        _CLASS[_b] = 3
    elif _b <= 0x20 or _b == 0x7F:
        _CLASS[_b] = 4
    elif _c in _MARKS:
        _CLASS[_b] = 7 + _MARKS.index(_c)
    else:
        _CLASS[_b] = 6
N_CLASSES = 7 + len(_MARKS)
N_FEATURES = N_CLASSES + 8 + 2 * HASHED


def encode(texts: pa.Array):
    """Per chunk of texts: the passages' encodings (float32) and the offsets of each text's passages.

    A text without tokens is one passage of zeros.
    """
    for data, offsets in text_chunks(texts):
        token = data > 0x20
        starts, ends = _runs(token, offsets)
        first = np.searchsorted(starts, offsets)
        counts = np.diff(first)
        n_passages = np.maximum(1, -(-counts // PASSAGE))
        at = np.concatenate([[0], np.cumsum(n_passages)])
        text = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
        passage = at[text] + (np.arange(len(starts)) - first[text]) // PASSAGE
        out = np.zeros((at[-1], N_FEATURES), np.float32)
        # Bytes from a token's start to the next token's belong to its passage, and those before a text's first token.
        begins, stops = starts.copy(), np.append(starts[1:], len(data))[: len(starts)]
        own = np.flatnonzero(counts)
        begins[first[own]] = offsets[own]
        stops[first[own + 1] - 1] = offsets[own + 1]
        last = None
        for low, high in _blocks(begins, passage):
            block, begin, first_passage = slice(low, high), begins[low], passage[low]
            n = passage[high - 1] + 1 - first_passage
            places = [x[block] - begin for x in (starts, ends, begins, stops)]
            out[first_passage : first_passage + n], last = _features(
                data[begin : stops[high - 1]], *places, passage[block] - first_passage, text[block], n, last
            )
        yield out, at


def _blocks(begins: np.ndarray, passage: np.ndarray):
    """Ranges of tokens that hold whole passages and, but for one long passage, about ``BLOCK_BYTES``."""
    if len(passage) == 0:
        return
    firsts = np.concatenate([[0], np.flatnonzero(np.diff(passage)) + 1])
    block = (begins[firsts] - begins[0]) // BLOCK_BYTES
    cuts = firsts[np.concatenate([[True], np.diff(block) > 0])]
    yield from zip(cuts, np.append(cuts[1:], len(passage)))


def _features(data, starts, ends, begins, stops, passage, text, n, last) -> tuple:
    """Encodings of ``n`` passages, and the hash and text of the last token, for the block that follows."""
    kinds = _CLASS[data]
    head = np.repeat(passage, stops - begins)
    # Texts without tokens leave gaps.
    counted = np.zeros(len(data) + 1, np.int8)
    counted[begins] += 1
    counted[stops] -= 1
    counted = np.cumsum(counted[:-1], dtype=np.int8) > 0
    shares = np.bincount(head * N_CLASSES + kinds[counted], minlength=n * N_CLASSES).reshape(n, N_CLASSES)
    size = np.maximum(shares.sum(axis=1, keepdims=True), 1)
    tokens = np.bincount(passage, minlength=n)
    some = np.maximum(tokens, 1)
    length = (ends - starts).astype(np.float64)
    words = run_hashes(data, starts, ends)
    same = np.zeros(len(words), bool)
    same[1:] = (words[1:] == words[:-1]) & (text[1:] == text[:-1])
    same[0] = (words[0], text[0]) == last
    order = np.lexsort((words, passage))
    new = np.ones(len(words), bool)
    new[1:] = (words[order][1:] != words[order][:-1]) | (passage[order][1:] != passage[order][:-1])
    distinct = np.bincount(passage[order][new], minlength=n)
    mean = np.bincount(passage, length, n) / some
    square = np.bincount(passage, length * length, n) / some
    upper = np.add.reduceat((kinds == 1).astype(np.int64), starts)
    capital = np.bincount(passage, kinds[starts] == 1, n) / some
    # A token's shape: its classes of bytes, runs of one class taken once, digits and letters apart.
    step = np.ones(len(data), bool)
    step[1:] = kinds[1:] != kinds[:-1]
    step[starts] = True
    inside = step & (data > 0x20)
    codes = (kinds[inside] + 1).astype(np.uint8)
    place = np.concatenate([[0], np.cumsum(inside)])
    shapes = run_hashes(codes, place[starts], place[ends])
    extra = np.stack(
        [
            np.log1p(tokens),
            np.log1p(np.where(tokens > 0, size[:, 0], 0)),
            mean,
            np.sqrt(np.maximum(square - mean * mean, 0)),
            distinct / some,
            np.bincount(passage, same, n) / some,
            np.bincount(passage, (upper == length) & (length > 1), n) / some,
            capital,
        ],
        axis=1,
    )
    hashed = [
        np.bincount(passage * HASHED + (h % np.uint64(HASHED)).astype(np.int64), minlength=n * HASHED).reshape(n, HASHED)
        / some[:, None]
        for h in (words, shapes)
    ]
    encoded = np.concatenate([shares / size, extra, *hashed], axis=1).astype(np.float32)
    return encoded, (words[-1], text[-1])


@dataclass
class Attention:
    """Weights of the model; ``scale`` and ``shift`` standardise encodings."""

    weights: dict

    def forward(self, x: np.ndarray, at: np.ndarray) -> dict:
        p = self.weights
        x = np.clip((x - p["shift"]) * p["scale"], -6, 6)
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * g) @ p["w"]
        counts = np.diff(at)
        e = e - np.repeat(np.maximum.reduceat(e, at[:-1]), counts)
        a = np.exp(e)
        a = a / np.repeat(np.add.reduceat(a, at[:-1]), counts)
        z = np.add.reduceat(a[:, None] * h, at[:-1], axis=0)
        return {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "logit": z @ p["c"] + p["d"], "counts": counts}

    def score(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        if "constant" in self.weights:
            return np.full(len(at) - 1, self.weights["constant"], np.float64)
        return 1 / (1 + np.exp(-np.clip(self.forward(x, at)["logit"].astype(np.float64), -500, 500)))

    def gradients(self, x: np.ndarray, at: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
        p, f = self.weights, self.forward(x, at)
        h, t, g, a, n = f["h"], f["t"], f["g"], f["a"], f["counts"]
        error = (1 / (1 + np.exp(-f["logit"])) - y) * weight / weight.sum()
        of_passage = np.repeat(error, n)
        dz = of_passage[:, None] * p["c"]
        da = (dz * h).sum(axis=1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, at[:-1]), n))
        dgate = de[:, None] * p["w"]
        dt, dg = dgate * g * (1 - t * t), dgate * t * g * (1 - g)
        dh = a[:, None] * dz + dt @ p["V"].T + dg @ p["U"].T
        dx = dh * (1 - h * h)
        return {
            "c": f["z"].T @ error,
            "d": error.sum(),
            "w": ((t * g) * de[:, None]).sum(axis=0),
            "V": h.T @ dt,
            "U": h.T @ dg,
            "W": f["x"].T @ dx,
            "b": dx.sum(axis=0),
        }


def fit(bags: list[np.ndarray], labels: np.ndarray, weight: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Attention:
    """Learn by Adam from encoded passages of each document, its label (0, 1) and weight."""
    if len(bags) == 0 or labels.min() == labels.max():
        # One class alone teaches nothing but itself; no label at all, nothing.
        return Attention({"constant": 0.5 if len(bags) == 0 else float(labels[0])})
    random = np.random.default_rng(seed)
    every = np.concatenate(bags)
    shift, spread = every.mean(axis=0), every.std(axis=0)
    p = {
        "shift": shift,
        "scale": (1 / np.maximum(spread, 1e-3)).astype(np.float32),
        "W": random.normal(0, N_FEATURES**-0.5, (N_FEATURES, HIDDEN)),
        "b": np.zeros(HIDDEN),
        "V": random.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)),
        "U": random.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)),
        "w": random.normal(0, GATE**-0.5, GATE),
        "c": random.normal(0, HIDDEN**-0.5, HIDDEN),
        "d": np.zeros(()),
    }
    p = {k: np.asarray(v, np.float32) for k, v in p.items()}
    model = Attention(p)
    first = {k: np.zeros_like(p[k]) for k in "WbVUwcd"}
    second = {k: np.zeros_like(p[k]) for k in "WbVUwcd"}
    step, size = 0, max(16, min(128, len(bags) // 16))
    for epoch in range(epochs):
        order = random.permutation(len(bags))
        for i in range(0, len(order), size):
            pick = order[i : i + size]
            x = np.concatenate([bags[j] for j in pick])
            at = np.concatenate([[0], np.cumsum([len(bags[j]) for j in pick])])
            step += 1
            rate = 0.01 * 0.5 ** (epoch / (epochs / 3))
            for k, grad in model.gradients(x, at, labels[pick], weight[pick]).items():
                grad = np.asarray(grad, np.float32) + 1e-4 * p[k]
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.999 * second[k] + 0.001 * grad * grad
                p[k] = p[k] - np.float32(rate) * (first[k] / (1 - 0.9**step)) / (
                    np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8
                )
    return model


def _encoded_bags(texts: pa.Array) -> pa.Array:
    out = []
    for x, at in encode(texts):
        rows, values = [], []
        for i in range(len(at) - 1):
            bag = x[at[i] : at[i + 1]]
            values.append(bag.reshape(-1))
            rows.append(np.full(bag.size, i))
        out.append(list_array(np.concatenate(rows), len(at) - 1, pa.array(np.concatenate(values), pa.float32())))
    return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.float32()))


def held_out(id_col: str):
    """Whether a document is kept from learning: CRC-32 of its id as text leaves remainder 1 by 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def whole_documents(sizes: list[tuple], most: int) -> set:
    """The ids of ``sizes(id, passages)``, in this order, that together have at most ``most`` passages."""
    ids, total = set(), 0
    for i, n in sizes:
        if total + n <= most:
            ids.add(i)
            total += n
    return ids


def learn(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    sample: int = SAMPLE,
    passages: int = PASSAGES,
) -> Attention:
    """Fit the model on labelled documents that are not held out.

    At most ``sample`` labelled ids of each class are used, those of the
    smallest hashes, of them those that together have at most ``passages``
    passages; their weights restore the shares that the classes have
    among all labels. A null label or id is left out; an id labelled more than
    once counts with its smallest label, and of its texts one is used.
    """
    known = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
        .where(F.col("id").isNotNull() & F.col("label").isNotNull())
        .where(~held_out("id"))
        .groupBy("id")
        .agg(F.min("label").alias("label"))
    )
    total = {r["label"]: r["n"] for r in known.where("label in (0, 1)").groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = None
    for label in total:
        part = known.where(F.col("label") == label).orderBy(F.xxhash64("id"), "id").limit(sample)
        chosen = part if chosen is None else chosen.union(part)
    if chosen is None:
        return Attention({"constant": 0.5})

    def bags(texts: pa.Array) -> pa.Array:
        return _encoded_bags(texts)

    # At most twice ``sample`` rows, here of two numbers and then of four.
    texts = (
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        .join(F.broadcast(chosen), "id")
        .groupBy("id", "label")
        .agg(F.min("text").alias("text"))
    )
    tokens = F.regexp_count("text", F.lit(r"[^\x00-\x20]+"))
    texts = store(texts.withColumn("n", F.greatest(F.ceil(tokens / PASSAGE), F.lit(1))), "sample")
    sizes = texts.select("id", "label", F.coalesce("n", F.lit(1)).alias("n"), F.xxhash64("id").alias("hash")).collect()
    sizes.sort(key=lambda r: (r["hash"], r["id"]))
    kept = set().union(*[whole_documents([(r["id"], r["n"]) for r in sizes if r["label"] == label], passages) for label in total])
    if len(kept) < len(sizes):
        ids = texts.sparkSession.createDataFrame([(i,) for i in kept], T.StructType([texts.schema["id"]]))
        texts = texts.join(F.broadcast(ids), "id")
    rows = texts.select("id", "label", F.arrow_udf(bags, "array<float>")("text").alias("bag")).toArrow()
    rows = rows.sort_by("id")
    encoded = [np.asarray(b.values.to_numpy(), np.float32).reshape(-1, N_FEATURES) for b in rows["bag"]]
    y = rows["label"].to_numpy().astype(np.float32)
    weight = np.ones(len(y), np.float32)
    for label, n in total.items():
        weight[y == label] = n / max(1, (y == label).sum())
    return fit(encoded, y, weight / max(weight.mean(), 1e-9) if len(y) else weight)


def score_column(model: Attention, text_col: str = "text"):
    """The score of a whole text, 0 to 1; a null is an empty text."""

    def score(texts: pa.Array) -> pa.Array:
        out = [model.score(x, at) for x, at in encode(texts)]
        return pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())

    return F.arrow_udf(score, "double")(F.col(text_col))


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, held_out, score, predicted`` for every document, learned by :func:`learn`.

    Null and empty texts are scored as one empty passage. Repeated rows are
    scored each; a null id is not held out. Without usable labels every score
    is 0.5; with one class alone it is that class. An empty table gives no
    rows. Other columns, whatever their names, are no inputs.
    """
    model = learn(docs, labels, id_col, text_col)
    scored = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), score_column(model, text_col).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that score 0.5 or more."""
    name = free_name(docs, "score")
    scored = docs.withColumn(name, score_column(learn(docs, labels, id_col, text_col), text_col))
    return scored.where(F.col(name) >= 0.5).drop(name)
