"""The quality model against plain arithmetic, and long texts in bounded memory."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from curbmeter.llm import quality
from curbmeter.llm.shared import table


@pytest.fixture()
def small_model():
    random = np.random.default_rng(0)
    shapes = {"W": (5, 4), "b": (4,), "V": (4, 3), "U": (4, 3), "w": (3,), "c": (4,), "d": ()}
    weights = {k: np.asarray(random.normal(size=s), np.float64) for k, s in shapes.items()}
    weights |= {"shift": random.normal(size=5), "scale": np.ones(5)}
    return quality.Attention(weights), random.normal(size=(9, 5)), np.array([0, 2, 3, 9])


def test_forward_against_a_plain_loop(small_model):
    model, x, at = small_model
    p = model.weights
    for d in range(3):
        h = [np.tanh((row - p["shift"]) @ p["W"] + p["b"]) for row in x[at[d] : at[d + 1]]]
        e = [np.exp(p["w"] @ (np.tanh(v @ p["V"]) / (1 + np.exp(-(v @ p["U"]))))) for v in h]
        z = sum(a / sum(e) * v for a, v in zip(e, h))
        assert model.score(x, at)[d] == pytest.approx(1 / (1 + np.exp(-(z @ p["c"] + p["d"]))), rel=1e-9)


def test_gradients_against_finite_differences(small_model):
    model, x, at = small_model
    y, weight = np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])

    def loss():
        s = model.score(x, at)
        return -(weight * (y * np.log(s) + (1 - y) * np.log(1 - s))).sum() / weight.sum()

    got = model.gradients(x, at, y, weight)
    for name, gradient in got.items():
        flat = model.weights[name].reshape(-1)
        for i, g in enumerate(np.reshape(gradient, -1)):
            kept = flat[i]
            flat[i] = kept + 1e-6
            above = loss()
            flat[i] = kept - 1e-6
            below = loss()
            flat[i] = kept
            assert g == pytest.approx((above - below) / 2e-6, abs=1e-7), name


@pytest.mark.parametrize("size", [1, 900, 1 << 16])
def test_blocks_give_the_same_encodings(spark, monkeypatch, size):
    texts = [r["text"] for r in table(spark, "/root/testdata/sf0.001", "documents").select("text").collect()]
    texts = pa.array([*texts, None, "", " \n", "  a a a" * 200, "x" * 5000, "é " * 300])
    monkeypatch.setattr(quality, "BLOCK_BYTES", 1 << 60)
    want = list(quality.encode(texts))
    monkeypatch.setattr(quality, "BLOCK_BYTES", size)
    got = list(quality.encode(texts))
    assert len(got) == len(want)
    for (x, at), (y, bt) in zip(got, want):
        assert (x == y).all() and (at == bt).all()


def test_a_text_is_encoded_alike_whatever_its_neighbours():
    texts = ["", "a b", " \n ", "  lead", None, "tail \n\n", "\tB b b", " "]
    together = [x[at[i] : at[i + 1]] for x, at in quality.encode(pa.array(texts)) for i in range(len(at) - 1)]
    for text, x in zip(texts, together):
        ((alone, _),) = quality.encode(pa.array([text], pa.string()))
        assert (x == alone).all() and x.any() == bool((text or "").strip())


@pytest.fixture(scope="module")
def long_text():
    """20 MB in lines, of words that recur."""
    words = np.random.default_rng(5).choice([f"w{i}" for i in range(40_000)], 3_300_000)
    return "\n".join(" ".join(words[i : i + 12]) for i in range(0, len(words), 12))


def test_long_text_is_encoded_in_bounded_memory(long_text):
    texts = pa.array([long_text])
    tracemalloc.start()
    for x, at in quality.encode(texts):
        assert at[-1] == -(-3_300_000 // quality.PASSAGE)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(long_text) > 19 << 20 and peak < 12 * len(long_text), peak / len(long_text)
