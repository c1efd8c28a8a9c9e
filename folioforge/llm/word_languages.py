"""Languages of words in code-switched text, by a linear-chain conditional random field.

A word is a run of letters (and the marks on them). Its features are letter n-grams up to four, those that hold a word
boundary being its affixes, and its entry in a lexicon of common words; the weights of features and of transitions
between languages are learned together from chains made of pieces of texts of different languages. Forward-backward
gives each word its probability of each language; a document's language is the one of most expected words, its score
that share of the words.

Training takes a bounded sample: of each language the DOCS documents whose hash is least, of each at most RUNS runs of
RUN words that are spread over the whole text. Everything else runs over all documents and whole texts. The model (a
row of floats for each feature bucket and language) travels as a broadcast variable: its size is BUCKETS + LEXICON
rows, whatever the corpus size. All words of a slice of texts are one chain whose documents do not influence each
other: the chain is cut into lanes that advance together, and the lanes' transfer matrices join them exactly.

Defined cases: a null text, or one without a letter, is 'und' with score 0; so is every text if no document of the
training part has a language; texts of any length are labelled whole, as one chain; a null doc_id is the empty string
in the split; the language of a tie is the first in code-point order; repeated rows are documents of their own, and
count once in the sample; an empty table gives no rows; other columns of the input are carried along if ``carry``
names them.
"""

from __future__ import annotations

import functools
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

UNKNOWN = "und"
#: The training sample: documents of a language, runs of a document, words of a run.
DOCS, RUNS, RUN = 300, 8, 32
SHARES = 64
#: Hash buckets of the n-grams (a power of two), longest n-gram, entries of the lexicon, least count of an entry.
BUCKETS, LONGEST, LEXICON, ENTRY_COUNT = 1 << 17, 4, 8192, 3
#: Pieces of one language in a training chain have these lengths; a step learns from STEP words in chains of CHAIN.
PIECES, CHAIN, STEP, EPOCHS = (4, 24), 48, 6144, 4
RATE, DECAY = 0.3, 1e-6
#: Code points labelled together; a longer text is a slice of its own, and its features come in pieces of that size.
SLICE = 1 << 20
ODD = np.uint64(0x9E3779B97F4A7C15)


@functools.cache
def letter_tables() -> tuple[np.ndarray, np.ndarray]:
    """(lower-case letter or mark of each code point, 0 for all else; whether it is a letter)."""
    lower, letter = np.zeros(0x110000, np.uint32), np.zeros(0x110000, bool)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            small = x.lower()
            lower[c], letter[c] = ord(small) if len(small) == 1 else c, True
        elif unicodedata.category(x)[0] == "M":
            lower[c] = c
    return lower, letter


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * ODD
    return h ^ (h >> np.uint64(32))


@functools.cache
def _place_weights() -> np.ndarray:
    return _mixed(np.arange(1, 1025, dtype=np.uint64) * ODD) | np.uint64(1)


class Words:
    """The words of texts: letters with one 0 between words, where words start, and whose text they are."""

    def __init__(self, texts: list[str]):
        lower, letter = letter_tables()
        self.n_texts = len(texts)
        points = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        z = lower[points]
        lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        text_at = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
        letters = np.concatenate([[0], np.cumsum(letter[points])])
        self.has_letter = letters[text_at + lengths] > letters[text_at]
        inside = z > 0
        before = np.concatenate([[False], inside[:-1]])
        first = np.flatnonzero(inside & ~before)
        self.text = np.searchsorted(text_at, first, "right") - 1
        self.begin = first - text_at[self.text]
        self.length = np.flatnonzero(np.concatenate([before & ~inside, inside[-1:]])) - first
        self.z = np.concatenate([[0], z[inside | before], [0]]).astype(np.uint64)
        self.start = np.flatnonzero((self.z[1:] > 0) & (self.z[:-1] == 0)) + 1

    def __len__(self) -> int:
        return len(self.start)

    def pieces(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first word, end, letters from the boundary before it, starts among these) in pieces of about SLICE letters."""
        lo = 0
        while lo < len(self):
            hi = max(lo + 1, int(np.searchsorted(self.start, self.start[lo] + SLICE)))
            at = int(self.start[lo]) - 1
            end = int(self.start[hi]) if hi < len(self) else len(self.z)
            yield lo, hi, self.z[at:end], self.start[lo:hi] - at
            lo = hi


def word_hashes(z: np.ndarray, start: np.ndarray) -> np.ndarray:
    if not len(start):
        return np.zeros(0, np.uint64)
    owner = np.cumsum(np.bincount(start, minlength=len(z))) - 1
    offset = (np.arange(len(z)) - start[np.maximum(owner, 0)]) % 1024
    return np.add.reduceat(z * _place_weights()[offset], start)


def ngrams(z: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(feature, whether there is one) of the n-gram that ends at each place, for each n; none runs across a boundary."""
    bits = np.uint64(64 - (BUCKETS.bit_length() - 1))
    h = z
    inner = np.ones(len(z), bool)
    for n in range(1, LONGEST + 1):
        if n > 1:
            h = np.concatenate([[np.uint64(0)], h[:-1]]) * ODD + z
        if n > 2:
            inner = inner & np.concatenate([np.zeros(n - 2, bool), z[: -(n - 2)] > 0])
        there = z > 0 if n == 1 else inner & (np.arange(len(z)) >= n - 1)
        yield (_mixed(h + np.uint64(n)) * ODD >> bits).astype(np.int64), there


@dataclass
class Model:
    """Weights of n-gram buckets, of lexicon entries, of words outside of the lexicon and of no feature (always 0)."""

    langs: list[str]
    weights: np.ndarray
    lexicon: np.ndarray
    moves: np.ndarray
    begin: np.ndarray

    def entries(self, z: np.ndarray, start: np.ndarray) -> np.ndarray:
        """The lexicon's row of each word; words that are not in it share the last row."""
        hashes = word_hashes(z, start)
        if not len(self.lexicon):
            return np.full(len(start), BUCKETS + LEXICON)
        at = np.minimum(np.searchsorted(self.lexicon, hashes), len(self.lexicon) - 1)
        return np.where(self.lexicon[at] == hashes, BUCKETS + at, BUCKETS + LEXICON)

    def scores(self, z: np.ndarray, start: np.ndarray) -> np.ndarray:
        """(word, language) sums of the weights of the words' features."""
        of_place = np.zeros((len(z), len(self.langs)), np.float32)
        for feature, there in ngrams(z):
            of_place += np.take(self.weights, np.where(there, feature, BUCKETS + LEXICON + 1), 0)
        return np.add.reduceat(of_place, start) + self.weights[self.entries(z, start)]


def forward_backward(p: np.ndarray, first: np.ndarray, moves: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(alpha, beta), each scaled to sum 1, of the chain of ``p`` (word, language); where ``first``, a new chain begins."""
    n, k = p.shape
    lane = max(1, int(np.sqrt(n / 4)))
    lanes = -(-n // lane)
    pad = lanes * lane - n
    p = np.concatenate([p, np.ones((pad, k))]).reshape(lanes, lane, k)
    first = np.concatenate([first, np.ones(pad, bool)]).reshape(lanes, lane)
    scaled = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    m = np.broadcast_to(np.eye(k), (lanes, k, k))
    for s in range(lane):
        m = np.where(first[:, s, None, None], m.sum(2, keepdims=True) * begin, m @ moves)
        m = scaled(m * p[:, s, None, :], (1, 2))
    enter, leave = np.empty((lanes, k)), np.empty((lanes, k))
    v, r = np.full(k, 1 / k), np.full(k, 1 / k)
    for i in range(lanes):
        enter[i], v = v, scaled(v @ m[i], 0)
    for i in reversed(range(lanes)):
        leave[i], r = r, scaled(m[i] @ r, 0)
    alpha, beta = np.empty_like(p), np.empty_like(p)
    a, b = enter, leave
    for s in range(lane):
        a = scaled(np.where(first[:, s, None], begin, a @ moves) * p[:, s], 1)
        alpha[:, s] = a
    for s in reversed(range(lane)):
        beta[:, s] = b
        x = p[:, s] * b
        b = scaled(np.where(first[:, s, None], (x @ begin)[:, None] * np.ones(k), x @ moves.T), 1)
    return alpha.reshape(-1, k)[:n], beta.reshape(-1, k)[:n]


def posteriors(model: Model, words: Words) -> np.ndarray:
    """(word, language) probabilities."""
    e = np.concatenate([model.scores(z, start) for _, _, z, start in words.pieces()]).astype(np.float64)
    first = np.concatenate([[True], words.text[1:] != words.text[:-1]])
    p = np.exp(e - e.max(1, keepdims=True))
    alpha, beta = forward_backward(np.maximum(p, 1e-30), first, np.exp(model.moves), np.exp(model.begin))
    both = alpha * beta
    return both / both.sum(1, keepdims=True)


def gradient(model: Model, words: Words, gold: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Of the mean log-likelihood of a word: by weights, transitions and beginnings; and that likelihood."""
    (_, _, z, start), k = next(words.pieces()), len(model.langs)
    e = model.scores(z, start).astype(np.float64)
    top = e.max(1, keepdims=True)
    p, moves, begin = np.exp(e - top), np.exp(model.moves), np.exp(model.begin)
    alpha, beta = forward_backward(p, first, moves, begin)
    post = alpha * beta
    post /= post.sum(1, keepdims=True)
    went = ~first[1:]
    a, x = alpha[:-1][went], (p * beta)[1:][went]
    pair = (a / ((a @ moves) * x).sum(1, keepdims=True)).T @ x * moves
    true = np.eye(k)[gold]
    by_move = np.bincount((gold[:-1] * k + gold[1:])[went], minlength=k * k).reshape(k, k) - pair
    by_begin = (true - post)[first].sum(0)
    # log of the paths' weight less log of all paths' weight; the latter from the scaled sums of each step
    into = np.where(first[:, None], begin, np.concatenate([np.zeros((1, k)), alpha[:-1] @ moves]))
    likely = ((e - top) * true).sum() + model.moves[gold[:-1], gold[1:]][went].sum() + model.begin[gold[first]].sum() - np.log((into * p).sum(1)).sum()
    miss = (true - post).astype(np.float32)
    owner = np.cumsum(np.bincount(start, minlength=len(z))) - 1
    by_weight = np.zeros_like(model.weights)
    parts = [(f[there], owner[there]) for f, there in ngrams(z)] + [(model.entries(z, start), np.arange(len(start)))]
    feature, word = (np.concatenate(x) for x in zip(*parts))
    for j in range(k):
        by_weight[:, j] = np.bincount(feature, miss[word, j], minlength=len(model.weights))
    n = len(gold)
    return by_weight / n, by_move / n, by_begin / n, likely / n


def fit(runs: list[tuple[str, str]], epochs: int = EPOCHS, seed: int = 1) -> Model:
    """A model learned from (language, run of words), words apart by one blank; the order of the runs does not matter."""
    runs = sorted(runs)
    langs = sorted({lang for lang, _ in runs})
    rng = np.random.default_rng(seed)
    pieces: list[tuple[int, list[str]]] = []
    for lang, run in runs:
        words = run.split(" ")
        while words:
            size = int(rng.integers(*PIECES, endpoint=True))
            pieces.append((langs.index(lang), words[:size]))
            words = words[size:]
    counts = Counter(w for _, piece in pieces for w in piece)
    common = [w for w, n in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:LEXICON] if n >= ENTRY_COUNT]
    known = Words([" ".join(common)])
    lexicon = np.unique(word_hashes(known.z, known.start))
    k = len(langs)
    model = Model(langs, np.zeros((BUCKETS + LEXICON + 2, k), np.float32), lexicon, np.zeros((k, k)), np.zeros(k))
    text, gold = [], []
    for i in rng.permutation(len(pieces)):
        text += pieces[i][1]
        gold += [pieces[i][0]] * len(pieces[i][1])
    batches = []
    for at in range(0, len(text), STEP):
        batch = Words([" ".join(text[at : at + STEP])])
        batches.append((batch, np.array(gold[at : at + STEP]), np.arange(len(batch)) % CHAIN == 0))
    seen = [np.full(x.shape, 1e-8) for x in (model.weights, model.moves, model.begin)]
    for _ in range(epochs):
        for i in rng.permutation(len(batches)):
            *slopes, _ = gradient(model, *batches[i])
            for x, g, s in zip((model.weights, model.moves, model.begin), slopes, seen):
                g = g - DECAY * x
                s += g * g
                x += RATE * g / np.sqrt(s)
    return model


def _slices(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    run: list[str] = []
    at = size = 0
    for i, text in enumerate(texts):
        if run and size + len(text) > SLICE:
            yield at, run
            run, at, size = [], i, 0
        run.append(text)
        size += len(text)
    if run:
        yield at, run


def _decoded(column: pa.Array) -> list[str]:
    return [(x or b"").decode("utf-8", "replace") for x in column.to_pylist()]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, run): at most RUNS runs of RUN words, spread over each text."""
    for batch in batches:
        out = []
        for lang, text in zip(batch.column(0).to_pylist(), _decoded(batch.column(1))):
            words = Words([text])
            runs = -(-len(words) // RUN)
            for r in sorted({i * runs // RUNS for i in range(RUNS)} if runs > RUNS else range(runs)):
                spans = zip(words.begin[r * RUN : (r + 1) * RUN].tolist(), words.length[r * RUN : (r + 1) * RUN].tolist())
                out.append((lang, " ".join(text[b : b + n] for b, n in spans)))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.string()) for i in (0, 1)], ["lang", "run"])


def training_runs(docs: DataFrame, text: str = "text", lang: str = "lang") -> list[tuple[str, str]]:
    """The bounded sample of labelled documents (see above): at most DOCS * RUNS * RUN words of a language."""
    keyed = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(text).alias("key"))
    # the first of each share of a language, then of the language: no task sees all keys of a common language
    place = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("key"))
    shares = keyed.select("lang", "key").distinct().withColumn("share", F.pmod("key", F.lit(SHARES)))
    ranked = shares.withColumn("place", place("lang", "share")).where(F.col("place") <= DOCS).withColumn("place", place("lang")).where(F.col("place") <= DOCS)
    last = ranked.groupBy("lang").agg(F.max("key").alias("last"))
    chosen = keyed.join(F.broadcast(last), "lang").where("key <= last")  # one row a language
    one_each = chosen.groupBy("lang", "key").agg(F.min("text").alias("text")).select("lang", F.col("text").cast("binary").alias("text"))
    return [(r["lang"], r["run"]) for r in one_each.mapInArrow(_runs, "lang string, run string").collect()]


def _labeller(model, with_runs: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def one_slice(texts: list[str]) -> tuple[list[str], list[float], list[list[dict]]]:
        langs = model.value.langs
        words = Words(texts)
        if not len(words) or not langs:
            return [UNKNOWN] * len(texts), [0.0] * len(texts), [[] for _ in texts]
        post = posteriors(model.value, words)
        sums = np.stack([np.bincount(words.text, post[:, j], minlength=len(texts)) for j in range(len(langs))], 1)
        total = sums.sum(1)
        best = sums.argmax(1)
        known = words.has_letter & (total > 0)
        share = np.where(known, sums[np.arange(len(texts)), best] / np.where(total > 0, total, 1), 0.0)
        names = [langs[b] if ok else UNKNOWN for b, ok in zip(best, known)]
        runs: list[list[dict]] = [[] for _ in texts]
        if with_runs:
            label = post.argmax(1)
            cut = np.flatnonzero(np.concatenate([[True], (label[1:] != label[:-1]) | (words.text[1:] != words.text[:-1])]))
            for lo, hi in zip(cut, [*cut[1:], len(label)]):
                runs[words.text[lo]].append({"start": int(words.begin[lo]), "end": int(words.begin[hi - 1] + words.length[hi - 1]), "lang": langs[label[lo]]})
        return names, np.clip(share, 0.0, 1.0).tolist(), runs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores, runs = [], [], []
            for _, texts in _slices(_decoded(batch.column(batch.num_columns - 1))):
                for all_of, some in zip((names, scores, runs), one_slice(texts)):
                    all_of += some
            columns = [*batch.columns[:-1], pa.array(names, pa.string()), pa.array(scores, pa.float64())]
            if with_runs:
                columns.append(pa.array(runs, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))))
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "lang_pred", "score", *(["runs"] if with_runs else [])])

    return run


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """The quarter of the documents that is never learned from."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def label_languages(docs: DataFrame, model: Model, text: str = "text", carry: Sequence[str] = ("doc_id",), with_runs: bool = False) -> DataFrame:
    """``carry``, lang_pred and score of each whole text; ``with_runs``, also the runs of words of one language.

    A run's start and end are code points of the text.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*carry, F.col(text).cast("binary").alias("__text"))
    found = "lang_pred string, score double" + (", runs array<struct<start:int, end:int, lang:string>>" if with_runs else "")
    schema = StructType(rows.drop("__text").schema.fields + StructType.fromDDL(found).fields)
    return rows.mapInArrow(_labeller(sent, with_runs), schema)


def predict_languages(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document, by a model of the documents that are not held out."""
    split = docs.select("doc_id", F.col(text).alias("text"), F.col(lang).alias("lang"), held_out().alias("held_out"))
    model = fit(training_runs(split.where(~F.col("held_out"))))
    return label_languages(split, model, carry=("doc_id", "held_out"))
