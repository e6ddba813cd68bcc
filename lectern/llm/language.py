"""Language of code-switched text by a linear-chain conditional random field over words (operator 3).

Every word has affix, byte n-gram and lexicon features, hashed into one weight table per label;
transitions between labels are learned with them. Training chains are spliced from stretches of
labelled documents, so switches occur in them, and of stretches of no language: the same words with
their letters shuffled, words of letters drawn at random, and words of scripts that the labelled
documents hardly use. These carry one more label, "other". A text's words, lower-cased, are cut into
chains of at most ``CHAIN`` words, words of more than ``REACH`` bytes into stretches that enter the
chain one after the other, so every byte counts; forward-backward gives each word's label
probabilities. A document's score for a label is the mean over its words with letters, "other" among
the labels; its prediction is the best label that was learned from rows, so text in no learned
language gets a label with a low score, which a caller can reject.

Training reads a bounded, documented sample of labelled rows (``sample`` documents, by a hash of the
id, and ``sample_chars`` characters of each from a place that the hash chooses) and runs on the
driver; predictions cover every word of every text. A text that is null or has no letter is ``und``
with score 0. Rows with one id are scored each, equal texts alike. An empty table gives an empty
result; without any labelled row every text is ``und``. Labels in ties: alphabetical.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm import frames

CHAIN = 64
BITS = 16
# Longest word of a chain, in bytes; a longer one enters as consecutive stretches of this size.
REACH = 30
# Scripts that words of no learned language are drawn from: first and last code point.
SCRIPTS = [
    (0x0391, 0x03C9),  # Greek
    (0x0410, 0x044F),  # Cyrillic
    (0x05D0, 0x05EA),  # Hebrew
    (0x0621, 0x064A),  # Arabic
    (0x0905, 0x0939),  # Devanagari
    (0x0E01, 0x0E30),  # Thai
    (0x10D0, 0x10F0),  # Georgian
    (0x3041, 0x30FA),  # Hiragana, Katakana
    (0x4E00, 0x9FA5),  # Han
    (0xAC00, 0xD7A3),  # Hangul
]


def _lower() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[ord("A") : ord("Z") + 1] += 32
    return table


_LOWER = _lower()
# Letters, and all bytes of characters outside ASCII.
_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1), *range(0x80, 0x100)]] = True


def lowered(raw: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and Latin-1 letters in UTF-8 bytes."""
    out = _LOWER[raw]
    if len(out) > 1:
        accented = np.flatnonzero((raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)) + 1
        out[accented] += 0x20
    return out


def features(words: list[bytes]) -> np.ndarray:
    """Feature numbers of each word (of ``REACH`` bytes at most), a row per word; 0 where a word has fewer."""
    width = REACH + 2
    joined = b"".join((b"\x02" + w + b"\x03").ljust(width, b"\x00") for w in words)
    grid = np.frombuffer(joined, np.uint8).reshape(len(words), width).astype(np.uint64)
    columns = []
    code = grid
    for size in (2, 3, 4):  # runs of bytes, word borders among them: affixes of up to three letters
        code = (code[:, :-1] << np.uint64(8)) | grid[:, size - 1 :]
        full = grid[:, size - 1 :] != 0
        columns.append(np.where(full, frames.mix(code * np.uint64(8) + np.uint64(size)) >> np.uint64(64 - BITS), 0))
    whole = np.array([hash_bytes(w) for w in words], np.uint64)[:, None]
    columns.append((frames.mix(whole) >> np.uint64(64 - BITS)) | np.uint64(1 << BITS))  # lexicon: a table of its own
    return np.concatenate(columns, axis=1).astype(np.int32)


def hash_bytes(word: bytes) -> int:
    out = 0xCBF29CE484222325
    for k in range(0, len(word), 8):
        out = ((out ^ int.from_bytes(word[k : k + 8], "little")) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
    return out ^ len(word)


def stretches(starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of more than ``REACH`` bytes as consecutive stretches; the counts before each text follow."""
    parts = -(-(ends - starts) // REACH)
    if not len(parts) or parts.max() == 1:
        return starts, ends, before
    first = np.repeat(starts, parts) + REACH * frames.ranges(np.zeros(len(parts), np.int64), parts)
    return first, np.minimum(first + REACH, np.repeat(ends, parts)), np.concatenate([[0], np.cumsum(parts)])[before]


def words_of(text: str) -> list[bytes]:
    """The words of a text as they enter a chain."""
    raw = lowered(np.frombuffer(text.encode(), np.uint8)).tobytes()
    return [w[k : k + REACH] for w in raw.split() for k in range(0, len(w), REACH)]


@dataclass
class Model:
    labels: list[str]  # as learned from rows; the last column of the weights stands for "other"
    weights: np.ndarray  # feature, label
    transitions: np.ndarray  # from, to

    def emissions(self, words: list[bytes]) -> np.ndarray:
        """Summed feature weights of each word per label."""
        if not words:
            return np.empty((0, self.weights.shape[1]), np.float32)
        at = features(words)
        return np.stack([self.weights[:, y][at].sum(1) for y in range(self.weights.shape[1])], axis=1)


def forward_backward(scores: np.ndarray, valid: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities of chains side by side (position, chain, label), and pair counts (from, to)."""
    steps, chains, labels = scores.shape
    local = np.exp(scores - scores.max(2, keepdims=True))
    move = np.exp(transitions - transitions.max())
    ahead = np.empty_like(local)
    back = np.ones_like(local)
    ahead[0] = local[0] / local[0].sum(1, keepdims=True)
    for t in range(1, steps):
        x = (ahead[t - 1] @ move) * local[t]
        ahead[t] = x / x.sum(1, keepdims=True)
    for t in range(steps - 2, -1, -1):
        x = (local[t + 1] * back[t + 1]) @ move.T
        x /= x.sum(1, keepdims=True)
        back[t] = np.where(valid[t + 1][:, None], x, 1.0)
    gamma = ahead * back
    gamma /= gamma.sum(2, keepdims=True)
    pairs = np.zeros((labels, labels))
    for t in range(steps - 1):
        x = ahead[t][:, :, None] * move * (local[t + 1] * back[t + 1])[:, None, :]
        x /= x.sum((1, 2), keepdims=True)
        pairs += x[valid[t + 1]].sum(0)
    return gamma, pairs


def probabilities(scores: np.ndarray, valid: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Only the label probabilities of ``forward_backward``."""
    local = np.exp(scores - scores.max(2, keepdims=True))
    move = np.exp(transitions - transitions.max()).astype(local.dtype)
    out = np.empty_like(local)
    x = local[0]
    for t in range(len(local)):
        if t:
            x = (x @ move) * local[t]
        x = x / x.sum(1, keepdims=True)
        out[t] = x
    back = np.ones_like(local[0])
    for t in range(len(local) - 2, -1, -1):
        x = (local[t + 1] * back) @ move.T
        x /= x.sum(1, keepdims=True)
        back = np.where(valid[t + 1][:, None], x, np.float32(1))
        out[t] *= back
    return out / out.sum(2, keepdims=True)


def strange(doc: list[bytes], known: set[bytes], rng: np.random.Generator) -> list[bytes]:
    """Words of no learned language, as long as those of ``doc``: shuffled, of random letters, or of another script."""
    kind = int(rng.integers(3))
    if kind == 2:
        low, high = SCRIPTS[rng.integers(len(SCRIPTS))]
        own = [rng.integers(low, high + 1, rng.integers(1, 1 + max(1, REACH // 3))) for _ in doc]
        return ["".join(map(chr, w.tolist())).encode() for w in own]
    out = []
    for word in doc:
        try:
            letters = np.array(list(word.decode()))
        except UnicodeDecodeError:  # a stretch that begins or ends within a character
            letters = np.array(list("x" * len(word)))
        if kind:
            letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))[rng.integers(26, size=len(letters))]
        else:
            rng.shuffle(letters)
        made = "".join(letters).encode()
        if made not in known:
            out.append(made)
    return out


def fit(texts: list[str], langs: list[str], chains: int = 2000, steps: int = 40, ridge: float = 1e-5, others: float = 0.4, seed: int = 3) -> Model | None:
    """Weights and transitions by gradient steps on the likelihood of spliced chains.

    A share ``others`` of their stretches is of no language.
    """
    labels = sorted(set(langs))
    rng = np.random.default_rng(seed)
    own: list[list[list[bytes]]] = [[] for _ in labels]
    for text, lang in zip(texts, langs, strict=True):
        split = words_of(text)
        if split:
            own[labels.index(lang)].append(split)
    usable = [y for y, docs in enumerate(own) if docs]
    if not usable:
        return None
    known = {w for docs in own for doc in docs for w in doc}
    other = len(labels)
    index: dict[bytes, int] = {}
    at = np.zeros((CHAIN, chains), np.int64)
    gold = np.zeros((CHAIN, chains), np.int64)
    for c in range(chains):
        t = 0
        while t < CHAIN:
            y = usable[rng.integers(len(usable))]
            doc = own[y][rng.integers(len(own[y]))]
            if rng.random() < others:
                y, doc = other, strange(doc[: 2 * CHAIN], known, rng)
                if not doc:
                    continue
            n = min(int(rng.integers(8, 2 * CHAIN)), CHAIN - t, len(doc))
            start = int(rng.integers(len(doc) - n + 1))
            for w in doc[start : start + n]:
                at[t, c], gold[t, c] = index.setdefault(w, len(index)), y
                t += 1
    numbers = features(list(index))
    flat = numbers.ravel()
    classes = len(labels) + 1
    model = Model(labels, np.zeros((2 << BITS, classes), np.float32), np.zeros((classes, classes)))
    weights, moves = np.zeros((2 << BITS, classes)), np.zeros((classes, classes))
    valid = np.ones((CHAIN, chains), bool)
    truth = np.eye(classes)[gold]
    true_pairs = np.zeros((classes, classes))
    np.add.at(true_pairs, (gold[:-1], gold[1:]), 1)
    total = CHAIN * chains
    memory = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(moves), np.zeros_like(moves)]
    for step in range(1, steps + 1):
        table = np.stack([weights[:, y][numbers].sum(1) for y in range(classes)], axis=1)
        gamma, pairs = forward_backward(table[at], valid, moves)
        error = (truth - gamma).reshape(-1, classes)
        per_word = np.stack([np.bincount(at.ravel(), error[:, y], len(index)) for y in range(classes)], axis=1)
        gain = np.stack([np.bincount(flat, np.repeat(per_word[:, y], numbers.shape[1]), 2 << BITS) for y in range(classes)], axis=1)
        gain[0] = 0  # the number of absent features
        for value, grad, k in ((weights, gain / total - ridge * weights, 0), (moves, (true_pairs - pairs) / total, 2)):
            memory[k] = 0.9 * memory[k] + 0.1 * grad
            memory[k + 1] = 0.99 * memory[k + 1] + 0.01 * grad**2
            value += 0.1 * (memory[k] / (1 - 0.9**step)) / (np.sqrt(memory[k + 1] / (1 - 0.99**step)) + 1e-8)
    weights[0] = 0
    model.weights, model.transitions = weights.astype(np.float32), moves
    return model


def train(
    df: DataFrame, sample: int = 800, sample_chars: int = 20_000, id_col: str = "doc_id", text: str = "text", lang: str = "lang", **options
) -> Model | None:
    """Fit on ``sample`` labelled rows at most, those with the smallest hashes of their id and length.

    Of a text longer than ``sample_chars`` that many characters are learned from, at a place given by the hash.
    """
    known = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    mark = F.xxhash64(id_col, F.length(text))
    ids = known.select(mark.alias("_mark")).orderBy("_mark").limit(sample)
    place = F.pmod(F.col("_mark"), F.greatest(F.length("_text") - sample_chars + 1, F.lit(1))).cast("int") + 1
    picked = known.select(mark.alias("_mark"), F.col(text).alias("_text"), F.col(lang).alias("_lang")).join(F.broadcast(ids.distinct()), "_mark")
    picked = picked.select("_mark", F.col("_text").substr(place, F.lit(sample_chars)).alias("_text"), "_lang")
    rows = picked.orderBy("_mark", "_text", "_lang").limit(sample).collect()
    return fit([r[1] for r in rows], [r[2] for r in rows], **options)


class _Scorer:
    """A model with the emissions of the words met so far (a bounded number)."""

    def __init__(self, model: Model, limit: int = 400_000):
        self.model, self.limit = model, limit
        self.index: dict[bytes, int] = {}
        self.table = np.empty((0, model.weights.shape[1]), np.float32)

    def emissions(self, words: list[bytes]) -> np.ndarray:
        at = np.fromiter(map(self.index.get, words, itertools.repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(at < 0)
        if not len(missing):
            return self.table[at]
        fresh = {w: i for i, w in enumerate(dict.fromkeys([words[i] for i in missing.tolist()]))}
        new = list(fresh)
        rows = np.concatenate([self.model.emissions(new[k : k + 20_000]) for k in range(0, len(new), 20_000)])
        n = len(self.index)
        if n + len(new) <= self.limit:
            if n + len(new) > len(self.table):
                grown = np.empty((max(n + len(new), 2 * len(self.table)), rows.shape[1]), np.float32)
                grown[:n] = self.table[:n]
                self.table = grown
            self.table[n : n + len(new)] = rows
            self.index.update((w, n + i) for w, i in fresh.items())
        out = np.empty((len(words), rows.shape[1]), np.float32)
        seen = at >= 0
        out[seen] = self.table[at[seen]]
        out[missing] = rows[[fresh[words[i]] for i in missing.tolist()]]
        return out

    def score(self, texts: frames.Texts) -> np.ndarray:
        """Label shares of each text, "other" last (rows of zeros: no letter)."""
        labels = self.model.weights.shape[1]
        raw = lowered(texts.raw)
        starts, ends, before = frames.words(texts)
        shares = np.zeros((texts.n, labels))
        if not len(starts):
            return shares
        starts, ends, before = stretches(starts, ends, before)
        words = raw.tobytes().split()
        if len(words) != len(starts) or max(map(len, words)) > REACH:  # neighbours without white space between them, or stretches: cut by position
            data = raw.tobytes()
            words = [data[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        scores = self.emissions(words)
        n = np.diff(before)
        per = -(-n // CHAIN)
        row = np.repeat(np.arange(texts.n), per)
        k = frames.ranges(np.zeros(texts.n, np.int64), per)
        first = before[row] + k * CHAIN
        length = np.minimum(CHAIN, before[row + 1] - first)
        letters = np.concatenate([[0], np.cumsum(_LETTERS[texts.raw])])
        counts = (letters[ends] > letters[starts]).astype(np.float64)
        order = np.argsort(-length, kind="stable")
        for c in range(0, len(order), 4096):
            own = order[c : c + 4096]
            steps = int(length[own].max())
            at = first[own][None, :] + np.arange(steps)[:, None]
            valid = np.arange(steps)[:, None] < length[own][None, :]
            gamma = probabilities(scores[np.where(valid, at, 0)], valid, self.model.transitions)
            weight = np.where(valid, counts[np.where(valid, at, 0)], 0.0)
            sums = np.einsum("tc,tcl->cl", weight, gamma)
            np.add.at(shares, row[own], sums)
        total = np.bincount(np.repeat(np.arange(texts.n), n), counts, texts.n)
        return shares / np.maximum(total, 1)[:, None]


def predict(df: DataFrame, model: Model | None, text: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """Add the predicted language of each row's whole text and its score from 0 to 1."""
    keep = [c for c in df.columns if c not in (pred, score)]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(pred, T.StringType(), False), T.StructField(score, T.DoubleType(), False)])
    told = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(told.value) if told.value else None
        for batch in batches:
            for part in frames.slices(batch, text):
                best, sure = np.full(part.num_rows, "und", object), np.zeros(part.num_rows)
                if scorer:
                    shares = scorer.score(frames.Texts(part.column(text)))
                    texts = part.column(text)
                    for i in np.flatnonzero(shares.sum(1) > 0).tolist():
                        value = texts[i].as_py()
                        if value.isascii() or any(c.isalpha() for c in value):
                            k = int(shares[i, :-1].argmax())
                            best[i], sure[i] = scorer.model.labels[k], min(1.0, float(shares[i, k]))
                columns = [part.column(c) for c in keep] + [pa.array(best.tolist(), pa.string()), pa.array(sure)]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return df.select(*keep).mapInArrow(run, schema)


def remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``: what parts learning rows from held-out ones."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus
