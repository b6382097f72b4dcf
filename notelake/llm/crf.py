"""Linear-chain conditional random fields over the words of texts.

Emissions are sums of weights of hashed features of a word: the word itself (lexicon), its affixes and its
character trigrams. Training maximises the chain likelihood by AdaGrad on the driver, over a bounded sample.
Scoring makes a word's emission once per task and runs forward-backward over a whole batch of texts as one
chain that is reset at the start of every text: transfer matrices of blocks first, then the messages between
blocks, then the messages inside all blocks at once.
"""

from __future__ import annotations

import zlib
from array import array
from itertools import chain

import numpy as np

from notelake.llm.common import CACHE_WORDS

BITS = 17
START, END = "^", "$"
#: Letters of one chain position, and how far the next one begins in a longer run of letters.
LETTERS, STRIDE = 40, 32


def core(word: bytes) -> str:
    """The letters of a word, in lower case."""
    text = word.decode("utf-8", "replace").lower()
    return text if text.isalpha() else "".join(filter(str.isalpha, text))


def pieces(word: bytes) -> list[str]:
    """Letters of the chain positions of a word: one, if it has at most LETTERS of them.

    Longer words are split into their runs of letters, and runs into overlapping pieces, so every letter is in one.
    """
    text = core(word)
    if len(text) <= LETTERS:
        return [text]
    runs = "".join(c if c.isalpha() else " " for c in word.decode("utf-8", "replace").lower()).split()
    return [run[i : i + LETTERS] for run in runs for i in range(0, max(1, len(run) - LETTERS + STRIDE), STRIDE)]


def feature_ids(text: str) -> list[int]:
    """Hashed features of a run of letters; none for an empty one."""
    if not text:
        return []
    whole = START + text + END
    parts = [whole, *(whole[:i] for i in range(2, min(7, len(whole)))), *(whole[-i:] for i in range(2, min(6, len(whole)))), *(whole[i : i + 3] for i in range(1, len(whole) - 3))]
    crc = zlib.crc32
    mask = (1 << BITS) - 1
    return [crc(x.encode()) & mask for x in parts]


class Emissions(dict):
    """Word to the row of its emission scores, or to a negative number if it takes several chain positions.

    Row 0 is for words without letters and is zero.
    """

    def __init__(self, weights: np.ndarray):
        self.weights = weights
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.rows, self.waiting, self.long = np.zeros((1, self.weights.shape[1]), np.float32), [], []

    def row(self, letters: str) -> int:
        ids = feature_ids(letters)
        if ids:
            self.waiting.append(ids)
        return len(self.rows) + len(self.waiting) - 1 if ids else 0

    def __missing__(self, word: bytes) -> int:
        rows = [self.row(x) for x in pieces(word)]
        if len(rows) > 1:
            self.long.append(rows)
        found = self[word] = rows[0] if len(rows) == 1 else -len(self.long)
        return found

    def of(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row and word of every chain position, and where each text begins; ``rows`` then holds the scores."""
        if len(self) >= CACHE_WORDS:
            self.reset()
        starts = np.concatenate([[0], np.cumsum([len(x) for x in texts], dtype=np.int64)])
        at = np.fromiter(map(self.__getitem__, chain.from_iterable(texts)), np.int64, int(starts[-1]))
        word = np.arange(len(at))
        several = np.flatnonzero(at < 0)
        if len(several):
            rows = [self.long[-i - 1] for i in at[several]]
            sizes = np.ones(len(at), np.int64)
            sizes[several] = [len(x) for x in rows]
            ends = np.concatenate([[0], np.cumsum(sizes)])
            word, starts = np.repeat(word, sizes), ends[starts]
            at = at[word]
            at[at < 0] = np.concatenate(rows)
        if self.waiting:
            sizes = np.array([len(x) for x in self.waiting])
            flat = np.fromiter(chain.from_iterable(self.waiting), np.int64, int(sizes.sum()))
            new = np.add.reduceat(self.weights[flat], np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0)
            self.rows, self.waiting = np.concatenate([self.rows, new]), []
        return at, word, starts


def posteriors(scores: np.ndarray, starts: np.ndarray, transitions: np.ndarray, block: int = 256) -> np.ndarray:
    """Marginal probability of every state of every word (n by states)."""
    n, states = scores.shape
    if not n:
        return np.zeros((0, states))
    blocks = -(-n // block)
    x = np.ones((blocks * block, states))
    x[:n] = np.exp(scores - scores.max(axis=1, keepdims=True))
    begin = np.zeros(blocks * block, bool)
    begin[starts[:-1][np.diff(starts) > 0]] = True
    begin[n:] = True
    x, begin = x.reshape(blocks, block, states).transpose(1, 0, 2).copy(), begin.reshape(blocks, block).T.copy()
    step = np.exp(transitions - transitions.max())
    some = begin.any(axis=1)
    m = np.tile(np.eye(states), (blocks, 1, 1))
    for t in range(block):
        new = m @ step
        if some[t]:
            new[begin[t]] = m[begin[t]].sum(axis=2, keepdims=True)
        m = new * x[t][:, None, :]
        m /= m.max(axis=(1, 2), keepdims=True)
    into, out = np.ones((blocks, states)), np.ones((blocks, states))
    for b in range(1, blocks):
        v = into[b - 1] @ m[b - 1]
        into[b] = v / v.sum()
    for b in range(blocks - 1, 0, -1):
        v = m[b] @ out[b]
        out[b - 1] = v / v.sum()
    forward, now = np.empty_like(x), into
    for t in range(block):
        new = now @ step
        if some[t]:
            new[begin[t]] = 1.0
        now = new * x[t]
        now /= now.sum(axis=1, keepdims=True)
        forward[t] = now
    now = out
    for t in range(block - 1, -1, -1):
        forward[t] *= now
        now = (x[t] * now) @ step.T
        now /= now.sum(axis=1, keepdims=True)
        if some[t]:
            now[begin[t]] = 1.0 / states
    forward /= forward.sum(axis=2, keepdims=True)
    return forward.transpose(1, 0, 2).reshape(-1, states)[:n]


def train(words: list[list[bytes]], tags: list[np.ndarray], states: int, *, length: int = 32, batch: int = 192, epochs: int = 3, rate: float = 0.25, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Feature weights and transition scores from tagged words, in chains of ``length`` positions; the last is padded."""
    rng = np.random.default_rng(seed)
    vocabulary: dict[str, int] = {}
    split: dict[bytes, list[int]] = {}
    for w in chain.from_iterable(words):
        if w not in split:
            split[w] = [vocabulary.setdefault(x, len(vocabulary)) for x in pieces(w)]
    of_words = [split[w] for w in chain.from_iterable(words)]
    tag = np.repeat(np.concatenate([np.zeros(0, np.int64), *tags]).astype(np.int64), [len(x) for x in of_words])
    flat = np.array(array("i", chain.from_iterable(of_words)), np.int64)
    held, sizes = array("i"), np.zeros(max(1, len(vocabulary)), np.int64)
    for i, letters in enumerate(vocabulary):
        found = feature_ids(letters)
        held.extend(found)
        sizes[i] = len(found)
    begin, ids = np.concatenate([[0], np.cumsum(sizes)]), np.array(held, np.int32)
    del vocabulary, held, split, of_words
    weights, squares = np.zeros((1 << BITS, states), np.float32), np.full((1 << BITS, states), 1e-2, np.float32)
    trans, trans_sq = np.zeros((states, states)), np.full((states, states), 1e-2)
    chains = -(-len(flat) // length)
    valid = (np.arange(chains * length) < len(flat)).reshape(chains, length)
    flat, tag = (np.concatenate([x, np.zeros(chains * length - len(x), np.int64)]).reshape(chains, length) for x in (flat, tag))
    for _ in range(epochs):
        order = rng.permutation(chains)
        for i in range(0, chains, batch):
            rows = order[i : i + batch]
            used, where = np.unique(flat[rows], return_inverse=True)
            n = sizes[used]
            place = np.repeat(begin[used] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
            feats, own = ids[place], np.repeat(np.arange(len(used)), n)
            e = np.zeros((len(used), states), np.float32)
            np.add.at(e, own, weights[feats])
            e = e[where.reshape(len(rows), length)].astype(float)
            x, step = np.exp(e - e.max(axis=2, keepdims=True)), np.exp(trans - trans.max())
            alpha, beta = np.empty_like(x), np.ones_like(x)
            alpha[:, 0] = x[:, 0] / x[:, 0].sum(axis=1, keepdims=True)
            for t in range(1, length):
                a = (alpha[:, t - 1] @ step) * x[:, t]
                alpha[:, t] = a / a.sum(axis=1, keepdims=True)
            use = valid[rows]
            for t in range(length - 1, 0, -1):
                b = (x[:, t] * beta[:, t]) @ step.T
                beta[:, t - 1] = np.where(use[:, t, None], b / b.sum(axis=1, keepdims=True), 1.0)
            p = alpha * beta
            p /= p.sum(axis=2, keepdims=True)
            pairs = alpha[:, :-1, :, None] * step * (x * beta)[:, 1:, None, :]
            pairs /= pairs.sum(axis=(2, 3), keepdims=True)
            pairs *= use[:, 1:, None, None]
            y = tag[rows]
            grad = (np.eye(states)[y] - p) * use[:, :, None]
            g_word = np.zeros((len(used), states))
            np.add.at(g_word, where.reshape(-1), grad.reshape(-1, states))
            g = np.zeros((1 << BITS, states), np.float32)
            np.add.at(g, feats, g_word[own].astype(np.float32))
            g = g / len(rows) - 1e-5 * weights
            squares += g * g
            weights += rate * g / np.sqrt(squares)
            seen = np.zeros((states, states))
            np.add.at(seen, (y[:, :-1].ravel(), y[:, 1:].ravel()), use[:, 1:].ravel())
            gt = (seen - pairs.sum(axis=(0, 1))) / len(rows) - 1e-4 * trans
            trans_sq += gt * gt
            trans += rate * gt / np.sqrt(trans_sq)
    return weights, trans
