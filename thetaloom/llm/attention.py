"""A small causal self-attention model over sequences of subword ids, in numpy: training, and scoring in overlapping windows.

A symbol is twice an id, plus one where its word ends with it. A sequence is predicted symbol by symbol and ends with
``END``. A symbol is five digits, four of 16 for the id, lowest first, and one for the end of the word; its probability is the
product of its digits' probabilities, each given the digits before it. A digit's logit is the logarithm of how often it
follows these digits in training, apart for ids that begin a word, plus what the state of the context adds. So every id is
predicted from its context, and the probabilities of all symbols sum to one.

A window has ``WIDTH`` places; the next one starts ``WIDTH // 2`` later and scores its second half only, so each symbol is
scored once and, but for the first of a sequence, from at least ``WIDTH // 2`` symbols before it. Places count by distance.
"""

from __future__ import annotations

import numpy as np

DIGIT, LEVELS = 16, 4
IDS = DIGIT**LEVELS
SYMBOLS, SIZE, WIDTH = 2 * IDS, 24, 64
END = SYMBOLS - 1
HALF = WIDTH // 2
LOW = 2048
"""A symbol is seen as the sum of two vectors, of its id's remainder by ``LOW`` and of the quotient with the end of the word."""
CHUNK = 1024
"""Rows of states whose logits are worked on at once: they stay in a core's cache."""
FAR = np.float32(60)
"""Bound of logits, in which the exponentials and their sums are proper floats."""
UNSEEN = 0.1
"""What a digit that never followed its digits before in training counts."""
_distance = np.arange(WIDTH)[:, None] - np.arange(WIDTH)
_columns = np.array([DIGIT * level + (np.arange(IDS) >> 4 * level) % DIGIT for level in range(LEVELS)]).T
_code = sum((np.arange(IDS) >> 4 * level) % DIGIT << 4 * (LEVELS - 1 - level) for level in range(LEVELS))
LOGITS = DIGIT * LEVELS + 2
_level_of = np.zeros((LOGITS, LEVELS + 1), np.float32)
_level_of[np.arange(LOGITS), np.arange(LOGITS) // DIGIT] = 1
SHAPES = {"low": (LOW, SIZE), "high": (SYMBOLS // LOW, SIZE), "near": (WIDTH,), "qkv": (SIZE, 3 * SIZE), "mix": (SIZE, SIZE), "up": (SIZE, LOGITS)}
"""What is learned by steps. ``seen``, how often each symbol occurs within and at the begin of words, is counted."""


def fresh(seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    scale = {"low": 0.3, "high": 0.1, "near": 0.0, "qkv": SIZE**-0.5, "mix": SIZE**-0.5, "up": 0.05}
    model = {name: (rng.standard_normal(shape) * scale[name]).astype(np.float32) for name, shape in SHAPES.items()}
    return {**model, "seen": np.zeros((2, SYMBOLS), np.int64)}


def packed(model: dict[str, np.ndarray]) -> bytes:
    """What is learned by steps."""
    return b"".join(np.ascontiguousarray(model[name], np.float32).tobytes() for name in SHAPES)


def unpacked(content: bytes, seen: np.ndarray) -> dict[str, np.ndarray]:
    out, start = {"seen": seen}, 0
    flat = np.frombuffer(content, np.float32)
    for name, shape in SHAPES.items():
        size = int(np.prod(shape))
        out[name] = flat[start : start + size].reshape(shape)
        start += size
    return out


def occurring(symbols: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How often each symbol occurs in sequences: within words, and at their begin."""
    begins = (_before(symbols, counts)[: len(symbols)] & 1).astype(np.int64)
    return np.bincount(begins * SYMBOLS + symbols, minlength=2 * SYMBOLS).reshape(2, SYMBOLS)


def started(seen: np.ndarray) -> np.ndarray:
    """Of each id, within words and then at their begin, the logits that its digits, and those in their stead, have by
    counts alone."""
    out = np.empty((2, IDS, LOGITS), np.float32)
    for begins, mine in enumerate(seen):
        inner = np.zeros(IDS, np.float64)
        inner[_code] = mine.reshape(IDS, 2).sum(axis=1)
        out[begins, :, DIGIT * LEVELS :] = _logs(mine.reshape(IDS, 2))
        for level in reversed(range(LEVELS)):
            inner = inner.reshape(-1, DIGIT)
            out[begins, :, DIGIT * level : DIGIT * (level + 1)] = _logs(inner)[_code >> 4 * (LEVELS - level)]
            inner = inner.sum(axis=1)
    return out.reshape(2 * IDS, LOGITS)


def _logs(counts: np.ndarray) -> np.ndarray:
    logit = np.log(counts + UNSEEN)
    return (logit - logit.max(axis=1, keepdims=True)).astype(np.float32)


def _before(symbols: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """What stands before each symbol: ``END`` before the first of a sequence."""
    before = np.full(len(symbols) + WIDTH, END, np.int32)
    before[1 : len(symbols)] = symbols[:-1]
    before[(np.cumsum(counts) - counts)[counts > 0]] = END
    return before


def _entries(padded: np.ndarray, symbols: np.ndarray, begun: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of ``begun`` that ``symbols`` need, few enough for a core's cache, and the row of each."""
    entry = (padded[: len(symbols)] & 1) * IDS + (symbols >> 1)
    used = np.zeros(len(begun), bool)
    used[entry] = True
    return begun[used], (np.cumsum(used, dtype=np.int32) - 1)[entry]


def _seen_as(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (symbols >> 1) % LOW, (symbols >> 1) // LOW * 2 + (symbols & 1)


def windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sequences of ``counts`` symbols one after another: the first place of each window, the places it has, and
    whether it is the first of its sequence."""
    number = np.where(counts > 0, 1 + np.maximum(-(-(counts - WIDTH) // HALF), 0), 0)
    owner = np.repeat(np.arange(len(counts)), number)
    step = np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number)
    begin = np.cumsum(counts) - counts
    return begin[owner] + step * HALF, np.minimum(counts[owner] - step * HALF, WIDTH), step == 0


def _near(model: dict) -> np.ndarray:
    """What the distance adds for a place (row) that looks at another (column); later ones are out of sight."""
    return np.where(_distance < 0, np.float32(-1e9), model["near"][np.maximum(_distance, 0)])


def _weights(asked: np.ndarray, k: np.ndarray, near: np.ndarray) -> np.ndarray:
    """The places' weights but for their total."""
    weight = asked @ k.transpose(0, 2, 1)
    weight += near
    np.minimum(weight, FAR, out=weight)
    return np.exp(weight, out=weight)


def log_probabilities(model: dict, symbols: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The natural log-probability of each symbol given those before it in its sequence. ``symbols`` holds sequences that
    end with ``END``, one after another; ``counts`` their lengths."""
    return sum(log_shares(model, started(model["seen"]), symbols, counts))


def log_shares(model: dict, begun: np.ndarray, symbols: np.ndarray, counts: np.ndarray, batch: int = 48) -> tuple[np.ndarray, np.ndarray]:
    """The natural log-probability of each symbol's id given the symbols before it, and that of the word's end or not given
    the id as well. ``begun`` are the logits by counts alone."""
    out, ends = np.zeros(len(symbols), np.float64), np.zeros(len(symbols), np.float64)
    if not len(symbols):
        return out, ends
    padded = _before(symbols, counts)
    occurs = np.zeros(SYMBOLS, bool)
    occurs[padded] = True
    used, which = np.flatnonzero(occurs), (np.cumsum(occurs, dtype=np.int32) - 1)[padded]
    begun, entry = _entries(padded, symbols, begun)
    low, high = _seen_as(used)
    x = model["low"][low] + model["high"][high]
    q, k, v = (np.ascontiguousarray(part) for part in np.split(x @ model["qkv"], 3, axis=1))
    q *= np.float32(SIZE**-0.5)
    near = _near(model)
    start, size, first = windows(counts)
    place = np.arange(WIDTH)
    for late in (False, True):
        chosen = np.flatnonzero(first != late)
        offset = HALF if late else 0
        for at in range(0, len(chosen), batch):
            mine = chosen[at : at + batch]
            seen = which[start[mine, None] + place]
            asking = seen[:, offset:]
            weight = _weights(q[asking], k[seen], near[offset:])
            mixed = weight @ v[seen]
            mixed /= weight.sum(axis=2, keepdims=True)
            told = (place[offset:] < size[mine, None]).ravel()
            state = x[asking].reshape(-1, SIZE)[told] + mixed.reshape(-1, SIZE)[told] @ model["mix"]
            target = (start[mine, None] + place[offset:]).ravel()[told]
            for row in range(0, len(state), CHUNK):
                at_row, part = target[row : row + CHUNK], slice(row, row + CHUNK)
                goal = symbols[at_row]
                logits = _logits(model, state[part], begun[entry[at_row]])
                lines = np.arange(len(goal))
                wanted = logits[lines[:, None], _columns[goal >> 1]].sum(axis=1, dtype=np.float64)
                end = logits[lines, DIGIT * LEVELS + (goal & 1)]
                total = np.log(np.exp(logits, out=logits) @ _level_of)
                out[at_row] = wanted - total[:, :LEVELS].sum(axis=1, dtype=np.float64)
                ends[at_row] = end.astype(np.float64) - total[:, LEVELS]
    return out, ends


def _logits(model: dict, state: np.ndarray, begun: np.ndarray) -> np.ndarray:
    logits = state @ model["up"]
    logits += begun
    return np.clip(logits, -FAR, FAR, out=logits)


def trained(symbols: np.ndarray, counts: np.ndarray, steps: int = 500, batch: int = 48, rate: float = 3e-3, seed: int = 7) -> dict[str, np.ndarray]:
    """A model fitted to sequences by Adam over batches of their windows. The windows are shuffled by ``seed``."""
    model = fresh(seed)
    if not len(symbols):
        return model
    start, size, _ = windows(counts)
    rng = np.random.default_rng(seed)
    return _fitted(model, symbols, counts, start, size, [rng.integers(0, len(start), batch) for _ in range(steps)], rate, 50)


def refined(model: dict[str, np.ndarray], symbols: np.ndarray, counts: np.ndarray, batch: int = 48, rate: float = 1.5e-3, seed: int = 7) -> dict[str, np.ndarray]:
    """``model`` fitted further to sequences by one pass: windows side by side, shuffled by ``seed``, so each symbol counts
    once."""
    if not len(symbols):
        return model
    number = -(-counts // WIDTH)
    owner = np.repeat(np.arange(len(counts)), number)
    done = (np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number)) * WIDTH
    start, size = (np.cumsum(counts) - counts)[owner] + done, np.minimum(counts[owner] - done, WIDTH)
    mixed = np.random.default_rng(seed).permutation(len(start))
    return _fitted(model, symbols, counts, start, size, [mixed[at : at + batch] for at in range(0, len(mixed), batch)], rate, 10)


def _summed(rows: np.ndarray, at: np.ndarray, like: np.ndarray) -> np.ndarray:
    """The sums of ``rows`` by their places ``at`` in an array like ``like``."""
    out = np.zeros_like(like)
    order = np.argsort(at, kind="stable")
    place = at[order]
    edges = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    out[place[edges]] = np.add.reduceat(rows[order], edges)
    return out


def _fitted(model: dict, symbols: np.ndarray, counts: np.ndarray, start: np.ndarray, size: np.ndarray, batches: list[np.ndarray], rate: float, warm: int) -> dict[str, np.ndarray]:
    """``model`` after a step of Adam for each batch of windows. Its counts are those of ``symbols``."""
    model, steps = {**model, "seen": occurring(symbols, counts)}, len(batches)
    begun = started(model["seen"])
    padded, goals = _before(symbols, counts), np.r_[symbols, np.full(WIDTH, END, symbols.dtype)].astype(np.int32)
    begun, entries = _entries(padded, symbols, begun)
    entries = np.r_[entries, np.zeros(WIDTH, np.int32)]
    first, second = ({name: np.zeros(shape, np.float32) for name, shape in SHAPES.items()} for _ in range(2))
    place, scale = np.arange(WIDTH), np.float32(SIZE**-0.5)
    for step, mine in enumerate(batches, 1):
        at = start[mine, None] + place
        seen = padded[at].ravel()
        low, high = (index.astype(np.uint16) for index in _seen_as(seen))  # sorted by radix
        x = model["low"][low] + model["high"][high]
        q, k, v = np.split((x @ model["qkv"]).reshape(len(mine), WIDTH, 3 * SIZE), 3, axis=2)
        weight = _weights(q * scale, k, _near(model))
        total = weight.sum(axis=2, keepdims=True)
        mixed = weight @ v
        mixed /= total
        told = np.flatnonzero((place < size[mine, None]).ravel())
        state, goal = (x + mixed.reshape(-1, SIZE) @ model["mix"])[told], goals[at].ravel()[told]
        entry = entries[at].ravel()[told]
        slope = {"up": np.zeros_like(model["up"])}
        d_state = np.zeros_like(x)
        each = np.float32(1 / len(told))
        for row in range(0, len(told), CHUNK):
            part = slice(row, row + CHUNK)
            share = _logits(model, state[part], begun[entry[part]])
            np.exp(share, out=share)
            share *= (each / (share @ _level_of)) @ _level_of.T
            lines = np.arange(len(share))
            share[lines[:, None], _columns[goal[part] >> 1]] -= each
            share[lines, DIGIT * LEVELS + (goal[part] & 1)] -= each
            slope["up"] += state[part].T @ share
            d_state[told[part]] = share @ model["up"].T
        slope["mix"] = mixed.reshape(-1, SIZE).T @ d_state
        d_mixed = (d_state @ model["mix"].T).reshape(mixed.shape)
        level = (d_mixed * mixed).sum(axis=2, keepdims=True)
        d_mixed /= total
        d_v = weight.transpose(0, 2, 1) @ d_mixed
        d_score = d_mixed @ v.transpose(0, 2, 1)
        d_score -= level / total
        d_score *= weight
        slope["near"] = np.bincount(np.maximum(_distance, 0).ravel(), weights=np.where(_distance < 0, 0, d_score.sum(axis=0)).ravel(), minlength=WIDTH).astype(np.float32)
        d_all = np.concatenate([(d_score @ k) * scale, (d_score.transpose(0, 2, 1) @ q) * scale, d_v], axis=2).reshape(-1, 3 * SIZE)
        slope["qkv"] = x.T @ d_all
        d_x = d_state + d_all @ model["qkv"].T
        slope["low"], slope["high"] = _summed(d_x, low, model["low"]), _summed(d_x, high, model["high"])
        now = rate * min(1.0, step / warm) * (1 - 0.9 * step / steps)
        for name, value in slope.items():
            first[name] = 0.9 * first[name] + 0.1 * value
            second[name] = 0.99 * second[name] + 0.01 * value * value
            model[name] = (model[name] - now * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model
