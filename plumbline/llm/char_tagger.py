"""A character-level bidirectional LSTM with CRF transitions in numpy: training, decoding and marginals of windows.

Characters come as shapes: letters by case, digits, other letters, and each sign of its own.  Windows have WIDTH places; places
outside of the text are PAD.  Tags are O and, for each kind, a first and a later place; a window may begin inside a span.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WIDTH, HIDDEN = 64, 16
#: Windows that are tagged at a time.
TOGETHER = 512

_SIGNS = "\t\n !\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
PAD, LOWER, UPPER, DIGIT, LETTER, CONTROL = range(6)
SHAPES = np.full(128, CONTROL, np.uint8)
SHAPES[97:123], SHAPES[65:91], SHAPES[48:58] = LOWER, UPPER, DIGIT
for _k, _c in enumerate(_SIGNS):
    SHAPES[ord(_c)] = 6 + _k
SYMBOLS = 6 + len(_SIGNS)


def shapes(text: str) -> np.ndarray:
    """The shape of each code point."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(codes < 128, SHAPES[np.minimum(codes, 127)], LETTER).astype(np.uint8)


def allowed(kinds: int) -> np.ndarray:
    """Which tag may follow which: a later place only its own kind's first or later place."""
    tags = 1 + 2 * kinds
    out = np.ones((tags, tags), bool)
    for k in range(kinds):
        out[:, 2 + 2 * k] = False
        out[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = True
    return out


def start_values(kinds: int, seed: int = 5) -> dict[str, np.ndarray]:
    """Untrained parameters; index 0 of the recurrent ones reads forwards, index 1 backwards."""
    rng = np.random.default_rng(seed)
    tags = 1 + 2 * kinds
    table = rng.normal(0, 0.3, (2, SYMBOLS, 4 * HIDDEN))
    table[:, :, HIDDEN : 2 * HIDDEN] += 1.0  # gates begin by remembering
    out = {
        "table": table, "inner": rng.normal(0, 0.25, (2, HIDDEN, 4 * HIDDEN)), "out": rng.normal(0, 0.2, (2 * HIDDEN, tags)), "bias": np.zeros(tags),
        "trans": np.zeros((tags, tags)), "begin": np.zeros(tags),
    }
    return {k: v.astype(np.float32) for k, v in out.items()}


def _lstm(model: dict, x: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """Hidden states (batch, WIDTH, both directions) and what the way back needs.  Gates: input, forget, output, value."""
    both = np.stack([x, x[:, ::-1]])
    z = np.stack([model["table"][d][both[d]] for d in (0, 1)])
    batch = x.shape[0]
    h, c = np.zeros((2, batch, HIDDEN), np.float32), np.zeros((2, batch, HIDDEN), np.float32)
    hidden, trail = np.empty((2, batch, x.shape[1], HIDDEN), np.float32), []
    for t in range(x.shape[1]):
        gates = z[:, :, t] + h @ model["inner"]
        gates[..., : 3 * HIDDEN] *= 0.5
        np.tanh(gates, out=gates)
        gates[..., : 3 * HIDDEN] *= 0.5
        gates[..., : 3 * HIDDEN] += 0.5
        i, f, o, g = (gates[..., k * HIDDEN : (k + 1) * HIDDEN] for k in range(4))
        before = c, h
        c = f * c + i * g
        live = np.tanh(c)
        h = o * live
        hidden[:, :, t] = h
        if keep:
            trail.append((gates, live, *before))
    return np.concatenate([hidden[0], hidden[1][:, ::-1]], axis=2), [both, trail]


def _lstm_back(model: dict, grad: np.ndarray, kept: list) -> dict[str, np.ndarray]:
    """Gradients of the recurrent parameters from those of the hidden states."""
    both, trail = kept
    down = np.stack([grad[:, :, :HIDDEN], grad[:, ::-1, HIDDEN:]])
    inner, z = np.zeros_like(model["inner"]), np.empty((*both.shape, 4 * HIDDEN), np.float32)
    h, c = np.zeros_like(down[:, :, 0]), np.zeros_like(down[:, :, 0])
    for t in range(len(trail) - 1, -1, -1):
        gates, live, c_before, h_before = trail[t]
        i, f, o, g = (gates[..., k * HIDDEN : (k + 1) * HIDDEN] for k in range(4))
        h = h + down[:, :, t]
        c = c + h * o * (1 - live * live)
        step = z[:, :, t]
        step[..., :HIDDEN] = c * g * i * (1 - i)
        step[..., HIDDEN : 2 * HIDDEN] = c * c_before * f * (1 - f)
        step[..., 2 * HIDDEN : 3 * HIDDEN] = h * live * o * (1 - o)
        step[..., 3 * HIDDEN :] = c * i * (1 - g * g)
        inner += h_before.transpose(0, 2, 1) @ step
        h, c = step @ model["inner"].transpose(0, 2, 1), c * f
    table = np.zeros_like(model["table"])
    for d in (0, 1):
        hot = np.eye(SYMBOLS, dtype=np.float32)[both[d].ravel()]
        table[d] = hot.T @ z[d].reshape(-1, 4 * HIDDEN)
    return {"table": table, "inner": inner}


def _chain(model: dict, scores: np.ndarray, may: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Logarithm of the sum over all taggings, marginals (batch, place, tag), summed marginals of pairs, of first tags."""
    batch, width, tags = scores.shape
    top = scores.max(axis=2, keepdims=True)
    emit = np.exp(scores - top)
    step = np.where(may, np.exp(model["trans"]), 0).astype(np.float32)
    forward, backward, total = np.empty_like(emit), np.empty_like(emit), top.sum(axis=(1, 2))
    now = np.exp(model["begin"]) * emit[:, 0]
    for t in range(width):
        if t:
            now = (now @ step) * emit[:, t]
        size = now.sum(axis=1, keepdims=True)
        now = now / size
        total = total + np.log(size[:, 0])
        forward[:, t] = now
    now = np.ones((batch, tags), np.float32)
    for t in range(width - 1, -1, -1):
        backward[:, t] = now
        now = (now * emit[:, t]) @ step.T
        now = now / now.sum(axis=1, keepdims=True)
    share = forward * backward
    share /= share.sum(axis=2, keepdims=True)
    left, right = forward[:, :-1], backward[:, 1:] * emit[:, 1:]
    size = np.einsum("bti,ij,btj->bt", left, step, right, optimize=True)
    pairs = step * np.einsum("bti,btj->ij", left / size[..., None], right, optimize=True)
    return total, share, pairs, share[:, 0].sum(axis=0)


def _loss(model: dict, x: np.ndarray, gold: np.ndarray, may: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean negative log-likelihood of the gold tags, and its gradients."""
    hidden, kept = _lstm(model, x, True)
    scores = hidden @ model["out"] + model["bias"]
    total, share, pairs, first = _chain(model, scores, may)
    batch, width = x.shape
    tags = scores.shape[2]
    hot = np.eye(tags, dtype=np.float32)[gold]
    right = (scores * hot).sum(axis=(1, 2)) + model["trans"][gold[:, :-1], gold[:, 1:]].sum(axis=1) + model["begin"][gold[:, 0]]
    up = (share - hot) / batch
    seen = np.bincount((gold[:, :-1].astype(np.int64) * tags + gold[:, 1:]).ravel(), minlength=tags * tags).reshape(tags, tags)
    grads = _lstm_back(model, up @ model["out"].T, kept)
    flat = up.reshape(-1, tags)
    grads |= {"out": hidden.reshape(-1, 2 * HIDDEN).T @ flat, "bias": flat.sum(axis=0), "trans": (pairs - seen) / batch, "begin": (first - hot[:, 0].sum(axis=0)) / batch}
    return float((total - right).mean()), grads


def train(x: np.ndarray, gold: np.ndarray, kinds: int, epochs: int = 16, batch: int = 96, rate: float = 0.03) -> dict[str, np.ndarray]:
    """Parameters fitted to windows x (shapes) and their tags by Adam; the order of windows is fixed by a seed."""
    model, may, rng = start_values(kinds), allowed(kinds), np.random.default_rng(9)
    first = {k: np.zeros_like(v) for k, v in model.items()}
    second = {k: np.zeros_like(v) for k, v in model.items()}
    steps, done = epochs * -(-len(x) // batch), 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), batch):
            pick = order[at : at + batch]
            _, grads = _loss(model, x[pick], gold[pick], may)
            done += 1
            speed = rate * (1 - done / (steps + 1))
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                model[k] = (model[k] - speed * (first[k] / (1 - 0.9**done)) / (np.sqrt(second[k] / (1 - 0.99**done)) + 1e-6)).astype(np.float32)
    return model


def decode(model: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best tags (Viterbi) of windows, and the marginal of each chosen tag's kind at its place."""
    tags = len(model["bias"])
    may = allowed((tags - 1) // 2)
    step = np.where(may, model["trans"], -1e9).astype(np.float32)
    best, sure = np.zeros(x.shape, np.uint8), np.zeros(x.shape, np.float32)
    for a in range(0, len(x), TOGETHER):
        part = x[a : a + TOGETHER]
        scores = _lstm(model, part, False)[0] @ model["out"] + model["bias"]
        share = _chain(model, scores, may)[1]
        now, back = scores[:, 0] + model["begin"], np.empty(scores.shape, np.uint8)
        for t in range(1, part.shape[1]):
            ways = now[:, :, None] + step
            back[:, t] = ways.argmax(axis=1)
            now = ways.max(axis=1) + scores[:, t]
        tag = now.argmax(axis=1)
        rows = np.arange(len(part))
        for t in range(part.shape[1] - 1, -1, -1):
            best[a : a + len(part), t] = tag
            twin = np.where(tag == 0, 0, np.where(tag % 2 == 1, tag + 1, tag - 1))
            sure[a : a + len(part), t] = np.where(tag == 0, share[rows, t, 0], share[rows, t, tag] + share[rows, t, twin])
            if t:
                tag = back[rows, t, tag]
    return best, sure


def pieces(tags: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(start, end, kind) of the spans of one window's tags; the first may be cut by its begin."""
    at = 0
    while at < len(tags):
        if tags[at] == 0:
            at += 1
            continue
        kind, end = (int(tags[at]) - 1) // 2, at + 1
        while end < len(tags) and tags[end] == 2 + 2 * kind:
            end += 1
        yield at, end, kind
        at = end
