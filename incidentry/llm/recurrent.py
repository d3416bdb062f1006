"""A gated recurrent language model in numpy: class-factored softmax, truncated backpropagation, whole-document scores.

Ids: 0 is the end of a document, 1 to HEAD - 1 are frequent words, the rest stand for kinds of other words. SLOTS frequent words make a class, a kind
is a class of its own. The state predicts the class of the next id, and within it the word; a window of steps is run at a time for many texts
side by side, and the output layer sees all states of a window together, sorted by class. The recurrent unit has one gate: it decides for each
part of the state how much is kept and how much gives way to a candidate.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

STATE, SLOTS, CLASSES, KINDS = 16, 64, 16, 14
HEAD = SLOTS * CLASSES
STEPS, LANES = 16, 512
SCORE_ROWS = 1 << 14
RATE, DECAYS, CLIP, FAR = 0.01, (0.9, 0.99), 1.0, 60.0
UPDATE, OWN = 0, 1  # parts of the recurrent layer
SHAPES = {
    "inputs": (2, HEAD + KINDS, STATE),
    "loops": (2, STATE, STATE),
    "to_class": (STATE, CLASSES + KINDS),
    "class_bias": (CLASSES + KINDS,),
    "to_word": (CLASSES, STATE, SLOTS),
    "word_bias": (CLASSES, SLOTS),
}
IDS = np.arange(HEAD + KINDS)
CLASS_OF = np.where(IDS < HEAD, IDS // SLOTS, IDS - HEAD + CLASSES)
SLOT_OF = IDS % SLOTS
GROUP_OF = np.minimum(CLASS_OF, CLASSES).astype(np.uint8)
LOG10 = np.log(10.0)

Weights = dict[str, np.ndarray]


def started(counts: np.ndarray) -> Weights:
    """Weights whose first predictions are the shares of ``counts``, one per id; ids that never came have next to none in their class."""
    pick = np.random.default_rng(0)
    weights = {name: pick.normal(0, 0.05, shape).astype(np.float32) for name, shape in SHAPES.items()}
    words = counts[:HEAD].reshape(CLASSES, SLOTS).astype(np.float64)
    classes = np.concatenate([words.sum(axis=1), counts[HEAD:]]) + 0.1
    weights["class_bias"] = np.log(classes / classes.sum()).astype(np.float32)
    weights["word_bias"] = np.log((words + 1e-9) / (words + 1e-9).sum(axis=1, keepdims=True)).astype(np.float32)
    return weights


def flat(weights: Weights) -> np.ndarray:
    return np.concatenate([weights[name].ravel() for name in SHAPES])


def shaped(values: np.ndarray) -> Weights:
    found, at = {}, 0
    for name, shape in SHAPES.items():
        size = int(np.prod(shape))
        found[name] = values[at : at + size].astype(np.float32).reshape(shape)
        at += size
    return found


def _step(weights: Weights, given: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The next state, and the gate and the candidate that its gradient needs."""
    parts = np.matmul(state, weights["loops"])
    parts += weights["inputs"].take(given, axis=1)
    parts[UPDATE] *= 0.5
    np.tanh(parts, out=parts)
    parts[UPDATE] += 1
    parts[UPDATE] *= 0.5
    after = state - parts[OWN]
    after *= parts[UPDATE]
    after += parts[OWN]
    return after, parts


def _by_class(targets: np.ndarray) -> Iterable[tuple[int, np.ndarray]]:
    """(class, rows) of the frequent words among the targets."""
    groups = GROUP_OF[targets]
    order = np.argsort(groups, kind="stable")
    ends = np.cumsum(np.bincount(groups, minlength=CLASSES + 1)).tolist()
    for number in range(CLASSES):
        low = ends[number - 1] if number else 0
        if ends[number] > low:
            yield number, order[low : ends[number]]


def _shares(states: np.ndarray, weight: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the logits and their sums; logits are held within FAR of 0."""
    powers = states @ weight
    powers += bias
    np.clip(powers, -FAR, FAR, out=powers)
    np.exp(powers, out=powers)
    return powers, powers @ np.ones(powers.shape[1], powers.dtype)


def log_shares(weights: Weights, states: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """The natural logarithm of the probability of each target id after its state."""
    powers, sums = _shares(states, weights["to_class"], weights["class_bias"])
    found = powers[np.arange(len(targets)), CLASS_OF[targets]].astype(np.float64) / sums
    for number, rows in _by_class(targets):
        powers, sums = _shares(states[rows], weights["to_word"][number], weights["word_bias"][number])
        found[rows] *= powers[np.arange(len(rows)), SLOT_OF[targets[rows]]].astype(np.float64) / sums
    return np.log(found)


def score_all(weights: Weights, texts: list[np.ndarray]) -> np.ndarray:
    """log10 of the probability of each row of ids; the state is carried from the first id to the last."""
    lengths = np.array([len(ids) for ids in texts], np.int64)
    order = np.argsort(-lengths, kind="stable")
    stream = np.concatenate([*texts, np.zeros(0, np.uint16)])
    starts = (np.cumsum(lengths) - lengths)[order]
    found = np.zeros(len(texts))
    state = np.zeros((len(texts), STATE), np.float32)
    running = np.searchsorted(-lengths[order], -np.arange(lengths.max(initial=0)), side="left")  # texts longer than t
    held: list[tuple[np.ndarray, np.ndarray]] = []
    rows = 0
    given = np.zeros(len(texts), np.int64)
    for step, n in enumerate(running.tolist()):
        if n < len(state):
            state, given = state[:n], given[:n]
        state = _step(weights, given, state)[0]
        given = stream[starts[:n] + step].astype(np.int64)
        held.append((state, given))
        rows += n
        if rows >= SCORE_ROWS or step + 1 == len(running):
            told = log_shares(weights, np.concatenate([s for s, _ in held]), np.concatenate([g for _, g in held]))
            owners = np.concatenate([np.arange(len(g)) for _, g in held])
            found += np.bincount(owners, told, len(found))
            held, rows = [], 0
    out = np.zeros(len(texts))
    out[order] = found / LOG10
    return out


def gradients(weights: Weights, given: np.ndarray, targets: np.ndarray, counted: np.ndarray, state: np.ndarray) -> tuple[Weights, np.ndarray, float]:
    """Of the mean loss over a window (steps x lanes): gradients, the state at its end, and the summed loss.

    The state starts anew where the id given is the end of a text. ``counted`` is 0 for targets that only fill up the window. The gradient
    ends at the window's first step.
    """
    steps, lanes = given.shape
    before = np.empty((steps, lanes, STATE), np.float32)
    after, parts = np.empty_like(before), np.empty((2, steps, lanes, STATE), np.float32)
    fresh = given == 0
    for t in range(steps):
        before[t] = state
        before[t][fresh[t]] = 0
        state, parts[:, t] = _step(weights, given[t], before[t])
        after[t] = state
    states, y, use = after.reshape(-1, STATE), targets.ravel(), counted.ravel()
    share = use * np.float32(1 / max(1.0, float(use.sum())))
    out: Weights = {}

    def wrong(some: np.ndarray, weight: np.ndarray, bias: np.ndarray, right: np.ndarray, part: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, float]:
        """Gradient of the logits, and the loss."""
        powers, sums = _shares(some, weight, bias)
        at = np.arange(len(right)), right
        powers *= (part / sums)[:, None]
        hit = powers[at]
        powers[at] -= part
        told = np.flatnonzero(count)
        return powers, -float(np.log(hit[told] / part[told]).sum(dtype=np.float64))

    delta, loss = wrong(states, weights["to_class"], weights["class_bias"], CLASS_OF[y], share, use)
    d_states = delta @ weights["to_class"].T
    out["to_class"], out["class_bias"] = states.T @ delta, np.ones(len(y), np.float32) @ delta
    out["to_word"], out["word_bias"] = np.zeros(SHAPES["to_word"], np.float32), np.zeros(SHAPES["word_bias"], np.float32)
    for number, rows in _by_class(y):
        some = states[rows]
        delta, more = wrong(some, weights["to_word"][number], weights["word_bias"][number], SLOT_OF[y[rows]], share[rows], use[rows])
        loss += more
        d_states[rows] += delta @ weights["to_word"][number].T
        out["to_word"][number], out["word_bias"][number] = some.T @ delta, np.ones(len(rows), np.float32) @ delta
    d_states = d_states.reshape(steps, lanes, STATE)
    # what each step's gradient is multiplied by, for all steps at once
    update, candidates = parts
    give = 1 - update
    by_update = before - candidates
    by_update *= update
    by_update *= give
    candidates *= candidates
    by_candidate = np.subtract(1, candidates, out=candidates)
    by_candidate *= give
    d_input = np.empty((2, steps, lanes, STATE), np.float32)
    back = np.ascontiguousarray(weights["loops"].transpose(0, 2, 1))
    carried = np.zeros((lanes, STATE), np.float32)
    for t in range(steps - 1, -1, -1):
        carried += d_states[t]
        np.multiply(carried, by_update[t], out=d_input[UPDATE, t])
        np.multiply(carried, by_candidate[t], out=d_input[OWN, t])
        carried *= update[t]
        carried += d_input[UPDATE, t] @ back[UPDATE]
        carried += d_input[OWN, t] @ back[OWN]
        carried[fresh[t]] = 0
    out["loops"] = np.matmul(before.reshape(-1, STATE).T, d_input.reshape(2, -1, STATE))
    x = given.ravel()
    order = np.argsort(x.astype(np.uint16), kind="stable")
    x = x[order]
    firsts = np.flatnonzero(np.diff(x, prepend=-1))
    out["inputs"] = np.zeros(SHAPES["inputs"], np.float32)
    out["inputs"][:, x[firsts]] = np.add.reduceat(d_input.reshape(2, -1, STATE).take(order, axis=1), firsts, axis=1)
    return out, state, loss


class Learner:
    """Trains weights on streams of texts, window by window, by steps scaled to each weight's own gradients (Adam)."""

    def __init__(self, weights: Weights) -> None:
        self.weights = {name: w.copy() for name, w in weights.items()}
        self.first = {name: np.zeros_like(w) for name, w in weights.items()}
        self.second = {name: np.zeros_like(w) for name, w in weights.items()}
        self.updates, self.loss, self.ids = 0, 0.0, 0

    def _move(self, found: Weights) -> None:
        self.updates += 1
        size = np.sqrt(sum(float((g * g).sum()) for g in found.values()))
        shrink = np.float32(min(1.0, CLIP / size)) if size else np.float32(1)
        a, b = DECAYS
        rate = np.float32(RATE * np.sqrt(1 - b**self.updates) / (1 - a**self.updates))
        for name, g in found.items():
            g *= shrink
            first, second = self.first[name], self.second[name]
            first += np.float32(1 - a) * (g - first)
            second += np.float32(1 - b) * (g * g - second)
            self.weights[name] -= rate * first / (np.sqrt(second) + np.float32(1e-8))

    def learn(self, texts: list[np.ndarray]) -> None:
        """One pass over texts of ids, each ending with 0: as one stream, cut into lanes that run side by side."""
        if not texts:
            return
        stream = np.concatenate(texts).astype(np.int64)
        lanes = max(1, min(LANES, len(stream) // STEPS))
        length = -(-len(stream) // (lanes * STEPS)) * STEPS
        filled = np.zeros(lanes * length, np.int64)
        filled[: len(stream)] = stream
        counted = (np.arange(lanes * length) < len(stream)).astype(np.float32)
        given = np.append(0, filled[:-1])
        given, filled, counted = (np.ascontiguousarray(x.reshape(lanes, length).T) for x in (given, filled, counted))
        state = np.zeros((lanes, STATE), np.float32)
        for low in range(0, length, STEPS):
            part = slice(low, low + STEPS)
            if not counted[part].any():
                continue
            found, state, loss = gradients(self.weights, given[part], filled[part], counted[part], state)
            self._move(found)
            self.loss += loss
        self.ids += len(stream)
