"""Language identification with a linear-chain conditional random field.

Each word of a text is labelled with a language. A word's emission scores come
from features: the word itself if it is in the learned lexicon, prefixes and
suffixes of up to three letters, and letter n-grams of one to three; neighbours
are tied by learned transitions, so runs of a language and switches between two
are scored together. Forward-backward gives each word's probabilities; a text's
language is the one with the largest sum over its words, and the score is that
sum's share.

Labelled documents have one language each. For switches to be learned too, the
training sequences are cut from the sampled documents and spliced: most segments
are followed by one of the same language, a share `SWITCHES` by one of another.
Weights are fitted by gradient ascent (Adam) on the penalised log-likelihood.

A whole slice of documents is one chain. At a document's first word the transition
matrix is a constant, which cuts the chain there. The chain is folded into columns:
products over each column, then a scan over the columns, then all columns at once.

The training sample is bounded: for each language the `DOCS_PER_LANGUAGE` documents
with the smallest seeded hashes, whole. Predictions read whole texts. Words are
maximal runs of letters, lower-cased. `word_labels` gives each word of a text with
its own language, which is what code-switched texts are read for; `predict` sums up.

Defined results: a text that is null or has no letter is `und` with score 0; with no
labelled document at all every text is `und`; labels of which no sampled document
has a letter are not learned; ties go to the label that sorts first. Rows that repeat
an id are read each by its own text, and rows with a null id like any other, but do
not teach; of sampled rows that share an id, language and text decide the order, so
the sample is a function of the table. An empty table gives no rows; other columns
are not read. A very long text is a slice of its own, some 200 bytes a word.
"""

from __future__ import annotations

import dataclasses
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

DOCS_PER_LANGUAGE, SEED = 100, 4_099
SEGMENT, SWITCHES = 12, 0.25
STEPS, RATE, PENALTY = 40, 0.15, 1e-6
#: Hashed features; words of the lexicon are those seen `LEXICON_LEAST` times in the sample.
SIZE, LEXICON_LEAST = 1 << 17, 2
MOST_WORDS = 500_000
UNKNOWN = "und"
#: A label column with more values than this is refused: each is a column of weights.
MOST_LANGUAGES = 1_000

_LETTERS = regex.compile(r"\p{L}+")


def words_of(text: str) -> list[str]:
    return _LETTERS.findall(text.lower())


def features(word: str, lexicon: frozenset[str]) -> list[int]:
    """Hashed features of a word: lexicon entry, affixes, letter n-grams."""
    n = len(word)
    told = {word[i : i + k] for k in (1, 2, 3) for i in range(n - k + 1)}
    for k in range(1, min(n, 3) + 1):
        told.add("<" + word[:k])
        told.add(word[n - k :] + ">")
    if word in lexicon:
        told.add("=" + word)
    return sorted({zlib.crc32(t.encode()) % SIZE for t in told})


@dataclasses.dataclass
class Model:
    labels: list[str]
    weights: np.ndarray
    moves: np.ndarray
    lexicon: frozenset[str]

    def emissions(self, words: list[str]) -> np.ndarray:
        found = [features(w, self.lexicon) for w in words]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((i for f in found for i in f), np.int64, int(sizes.sum()))
        out = np.zeros((len(words), len(self.labels)))
        if len(words):
            sums = np.add.reduceat(self.weights[flat], np.cumsum(sizes) - sizes, axis=0)
            out = sums / np.sqrt(sizes)[:, None]
        return out


def _scan(maps: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Rows start @ maps[0] @ ... @ maps[i - 1], each scaled to a sum of one, for all i."""
    out = np.empty((len(maps), len(start)))
    state = start
    for i in range(len(maps)):
        out[i] = state
        state = state @ maps[i]
        state = state / state.sum()
    return out


def _forward(score: np.ndarray, step: np.ndarray, first: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Scaled forward rows of one chain; at `first` words the row before does not count."""
    n, k = score.shape
    width = max(1, int(np.sqrt(n)))
    rows = -(-n // width)
    pad = rows * width - n
    s = np.concatenate([score, np.ones((pad, k))]).reshape(rows, width, k)
    f = np.concatenate([first, np.zeros(pad, bool)]).reshape(rows, width)
    # What each row of the folded chain does to a state that comes into it.
    maps = np.broadcast_to(np.eye(k), (rows, k, k)).copy()
    for j in range(width):
        moved = maps @ step
        cut = f[:, j]
        if cut.any():
            moved[cut] = start
        maps = moved * s[:, j, None, :]
        maps /= maps.sum(axis=(1, 2), keepdims=True)
    state = _scan(maps, np.full(k, 1 / k))
    out = np.empty((rows, width, k))
    for j in range(width):
        moved = state @ step
        moved[f[:, j]] = start
        state = moved * s[:, j]
        state /= state.sum(axis=1, keepdims=True)
        out[:, j] = state
    return out.reshape(-1, k)[:n]


def marginals(emission: np.ndarray, moves: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each word's label probabilities, and before each word the forward row; `first` marks words that begin a text.

    emission: log scores by word; moves: log transitions.
    """
    n, k = emission.shape
    score = np.exp(emission - emission.max(axis=1, keepdims=True)) + 1e-30
    step = np.exp(moves - moves.max())
    ahead = _forward(score, step, first, np.full(k, 1 / k))
    # Backward is forward on the reversed chain, without the word's own score.
    last = np.concatenate([first[1:], [True]])[::-1] if n else first
    back = _forward(score[::-1], step.T, last, np.full(k, 1 / k))[::-1]
    behind = np.ones((n, k))
    if n > 1:
        inner = back[1:] @ step.T
        behind[:-1] = np.where(first[1:, None], 1.0, inner)
    out = ahead * behind
    return out / out.sum(axis=1, keepdims=True), ahead


def _spliced(rng: np.random.Generator, docs: list[tuple[int, list[str]]]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Training words, their labels and where sequences begin."""
    segments: dict[int, list[list[str]]] = {}
    for label, words in docs:
        for i in range(0, len(words), SEGMENT):
            segments.setdefault(label, []).append(words[i : i + SEGMENT])
    for label in segments:
        order = rng.permutation(len(segments[label]))
        segments[label] = [segments[label][i] for i in order]
    words, labels, first = [], [], []
    label, left = None, 0
    while segments:
        if left == 0 or label is None:
            left, begins = 8, True
        else:
            begins = False
        if label not in segments or rng.random() < SWITCHES:
            label = sorted(segments)[rng.integers(len(segments))]
        part = segments[label].pop()
        if not segments[label]:
            del segments[label]
        words += part
        labels += [label] * len(part)
        first += [begins] + [False] * (len(part) - 1)
        left -= 1
    return words, np.array(labels), np.array(first, bool)


def train(docs: list[tuple[str, list[str]]]) -> Model | None:
    """A model from (language, words) of sampled documents; None without any word."""
    docs = [(lang, words) for lang, words in docs if words]
    if not docs:
        return None
    labels = sorted({lang for lang, _ in docs})
    k = len(labels)
    rng = np.random.default_rng(SEED)
    words, gold, first = _spliced(rng, [(labels.index(lang), words) for lang, words in sorted(docs)])
    kinds: dict[str, int] = {}
    code = np.fromiter((kinds.setdefault(w, len(kinds)) for w in words), np.int64, len(words))
    often = np.bincount(code)
    lexicon = frozenset(w for w, i in kinds.items() if often[i] >= LEXICON_LEAST)
    found = [features(w, lexicon) for w in kinds]
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    flat = np.fromiter((i for f in found for i in f), np.int64, int(sizes.sum()))
    used, flat = np.unique(flat, return_inverse=True)
    owner, norm = np.repeat(np.arange(len(found)), sizes), 1 / np.sqrt(sizes)
    starts = np.cumsum(sizes) - sizes
    hit = np.zeros((len(words), k))
    hit[np.arange(len(words)), gold] = 1
    inner = ~first[1:]
    seen_moves = np.zeros((k, k))
    np.add.at(seen_moves, (gold[:-1][inner], gold[1:][inner]), 1)
    weights, moves = np.zeros((len(used), k)), np.zeros((k, k))
    state = [[np.zeros_like(weights), np.zeros_like(weights)], [np.zeros_like(moves), np.zeros_like(moves)]]
    for t in range(1, STEPS + 1):
        emission = (np.add.reduceat(weights[flat], starts, axis=0) * norm[:, None])[code]
        told, ahead = marginals(emission, moves, first)
        error = hit - told
        by_kind = np.zeros((len(found), k))
        for j in range(k):
            by_kind[:, j] = np.bincount(code, weights=error[:, j], minlength=len(found))
        by_kind *= norm[:, None]
        slope = np.stack([np.bincount(flat, weights=by_kind[owner, j], minlength=len(used)) for j in range(k)], axis=1) / len(words)
        # Expected moves: the forward row, the move and what the next word's marginal leaves, word by word.
        step = np.exp(moves - moves.max())
        before = ahead[:-1][inner] @ step
        expected = (ahead[:-1][inner].T @ (told[1:][inner] / np.maximum(before, 1e-300))) * step
        slopes = (slope - PENALTY * weights, (seen_moves - expected) / len(words) - PENALTY * moves)
        for value, g, (m, v) in zip((weights, moves), slopes, state, strict=True):
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            value += RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    whole = np.zeros((SIZE, k))
    whole[used] = weights
    return Model(labels, whole, moves, lexicon)


class Reader:
    """Labels words of slices of documents; remembers the scores of the first words it meets."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}
        self.scores = np.zeros((1 << 14, len(model.labels)))

    def _look_up(self, words: list[str]) -> np.ndarray:
        known = self.known
        new = [w for w in words if w not in known]
        if not new:
            return self.scores[[known[w] for w in words]]
        made = self.model.emissions(new)
        first, room = len(known), max(0, min(len(new), MOST_WORDS - len(known)))
        while first + len(new) > len(self.scores):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
        self.scores[first : first + len(new)] = made
        fresh = {w: first + i for i, w in enumerate(new)}
        out = self.scores[[known[w] if w in known else fresh[w] for w in words]]
        known.update(list(fresh.items())[:room])
        return out

    def _told(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """How many words each text has, and the probabilities of all words, one text after the other."""
        kinds: dict[str, int] = {}
        codes, counts = [], []
        for text in texts:
            words = words_of(text) if text else []
            codes += [kinds.setdefault(w, len(kinds)) for w in words]
            counts.append(len(words))
        sizes = np.array(counts, np.int64)
        if not codes:
            return sizes, np.zeros((0, len(self.model.labels)))
        first = np.zeros(len(codes), bool)
        first[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
        return sizes, marginals(self._look_up(list(kinds))[np.array(codes)], self.model.moves, first)[0]

    def read(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        labels, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        sizes, told = self._told(texts)
        own = np.flatnonzero(sizes)
        if len(own):
            sums = np.add.reduceat(told, (np.cumsum(sizes) - sizes)[own], axis=0)
            best = sums.argmax(axis=1)
            scores[own] = np.clip(sums[np.arange(len(own)), best] / sizes[own], 0, 1)
            for i, b in zip(own.tolist(), best.tolist(), strict=True):
                labels[i] = self.model.labels[b]
        return labels, scores

    def read_words(self, texts: list[str | None]) -> list[list[str]]:
        """The language of each word of each text."""
        sizes, told = self._told(texts)
        each = np.array(self.model.labels, object)[told.argmax(axis=1)]
        return [part.tolist() for part in np.split(each, np.cumsum(sizes)[:-1])]


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All words of each sampled document."""
    for batch in batches:
        words = [words_of(text) for text in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("hash"), batch.column("lang"), pa.array(words, pa.list_(pa.string()))], names=["id", "hash", "lang", "words"])


def sample(docs: DataFrame, teaches: Column, id_col: str, text_col: str, lang_col: str) -> list[tuple[str, list[str]]]:
    """The bounded training sample of the rows that `teaches` is true for.

    Languages are counted first (one row each); a document is a candidate if its
    hash is below a bound that leaves somewhat more than are wanted of its language.
    """
    taught = docs.where(teaches & shared.named(lang_col).isNotNull() & shared.named(text_col).isNotNull() & shared.named(id_col).isNotNull()).select(shared.named(id_col).cast("long").alias("id"), shared.named(lang_col).alias("lang"), shared.named(text_col).alias("text"))
    counts = {r["lang"]: r["n"] for r in taught.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if not counts:
        return []
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"{len(counts)} languages; a model has at most {MOST_LANGUAGES}")
    spread = F.xxhash64("id", F.lit(SEED))
    bound = {lang: min(1.0, 2 * DOCS_PER_LANGUAGE / n) for lang, n in counts.items()}
    within = F.element_at(F.create_map(*[F.lit(x) for pair in sorted(bound.items()) for x in pair]), F.col("lang"))
    candidates = taught.withColumn("hash", spread).where(F.col("hash").cast("double") / 2.0**64 + 0.5 < within).select("id", "lang", "text", "hash")
    rows = shared.through(candidates, _sampled, "id long, hash long, lang string, words array<string>").collect()
    out, taken = [], dict.fromkeys(counts, 0)
    for r in sorted(rows, key=lambda r: (r["hash"], r["id"], r["lang"], r["words"])):
        if taken[r["lang"]] < DOCS_PER_LANGUAGE and r["words"]:
            taken[r["lang"]] += 1
            out.append((r["lang"], list(r["words"])))
    return out


def held_out(id_col: str) -> Column:
    return F.coalesce(F.pmod(F.crc32(shared.named(id_col).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


_READERS: dict[str, Reader] = {}
shared.forgets.append(_READERS.clear)


def _reader(model: Model | None, name: str) -> Reader | None:
    """The worker's reader of a model, with what it remembers."""
    if model is None:
        return None
    if name not in _READERS:
        _READERS.clear()
        _READERS[name] = Reader(model)
    return _READERS[name]


def _predicted(batches: Iterator[pa.RecordBatch], model: Model | None, name: str) -> Iterator[pa.RecordBatch]:
    shared.serves("language")
    reader = _reader(model, name)
    for batch in shared.bounded(batches, "text", 1 << 20):
        texts = batch.column("text").to_pylist()
        labels, scores = reader.read(texts) if reader else ([UNKNOWN] * len(texts), np.zeros(len(texts)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(labels), pa.array(scores)], names=["doc_id", "held_out", "lang_pred", "score"])


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; only texts are read for it."""
    rows = docs.select(shared.named(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.coalesce(shared.named(text_col), F.lit("")).alias("text"))
    name = uuid.uuid4().hex
    # A model's size is bounded by SIZE, the languages and the sample's words; each executor gets it once.
    told = docs.sparkSession.sparkContext.broadcast(model)
    return shared.through(rows, lambda it: _predicted(it, told.value, name), "doc_id long, held_out boolean, lang_pred string, score double")


def _worded(batches: Iterator[pa.RecordBatch], model: Model | None, name: str) -> Iterator[pa.RecordBatch]:
    shared.serves("language")
    reader = _reader(model, name)
    for batch in shared.bounded(batches, "text", 1 << 20):
        texts = batch.column("text").to_pylist()
        words = [words_of(t) for t in texts]
        langs = reader.read_words(texts) if reader else [[UNKNOWN] * len(w) for w in words]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words, pa.list_(pa.string())), pa.array(langs, pa.list_(pa.string()))], names=["doc_id", "words", "langs"])


def word_labels(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, words and langs of every document: its words in order, and the most probable language of each."""
    rows = docs.select(shared.named(id_col).cast("long").alias("doc_id"), F.coalesce(shared.named(text_col), F.lit("")).alias("text"))
    name = uuid.uuid4().hex
    told = docs.sparkSession.sparkContext.broadcast(model)
    return shared.through(rows, lambda it: _worded(it, told.value, name), "doc_id long, words array<string>, langs array<string>")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learns from documents that are not held out, predicts every document."""
    return predict(docs, train(sample(docs, ~held_out(id_col), id_col, text_col, lang_col)), id_col, text_col)
