"""Language-model scores: log-bilinear models trained by noise-contrastive estimation on counts of the whole corpus.

Every word has a symbol with vectors: frequent words one of their own, all others share those of their last bytes, which
unmet words have too. For each of the last POSITIONS tokens a model of its own (matrix and vectors) predicts the next
symbol; the models' probabilities are averaged. A word has a share of its symbol by its count in the whole corpus.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, forget, slices, table, written

#: The end of a text as a token; no word holds white space.
END = b"\n"
#: Symbols: words with one of their own (the end included), symbols that all other words share, by their last bytes.
OWN, SHARED, LAST = 1_280, 768, 3
#: Tokens before a token from which it is predicted.
POSITIONS = 3
#: Words that every worker knows by heart (some 60 MB); the others' counts come by a join.
KNOWN_WORDS = 1 << 18
#: Size of the vectors, noise samples for each token, and rounds of the optimiser.
SIZE, NOISE, ROUNDS = 48, 10, 40
#: Weight of the vectors' squares against the log-likelihood of all tokens: rare pairs stay near the words' frequencies.
L2 = 20.0
#: A worker hands on its counts when it holds so many words.
HELD = 300_000


@dataclass
class LogBilinear:
    """P(next | one before) with vectors ``r`` of the token before, ``c`` to predict the next one's vector, ``q`` and ``b`` of the next."""

    r: np.ndarray
    c: np.ndarray
    q: np.ndarray
    b: np.ndarray

    def probabilities(self, rows: int = 256) -> np.ndarray:
        """Normalised probabilities, (before, next), by batches of matrix products."""
        out = np.empty((len(self.r), len(self.q)), np.float32)
        for at in range(0, len(self.r), rows):
            score = (self.r[at : at + rows] @ self.c @ self.q.T + self.b).astype(np.float64)
            score = np.exp(score - score.max(axis=1, keepdims=True))
            out[at : at + rows] = score / score.sum(axis=1, keepdims=True)
        return out


def train(pairs: np.ndarray, size: int = SIZE, noise: int = NOISE, rounds: int = ROUNDS, l2: float = L2, seed: int = 11) -> LogBilinear:
    """Noise-contrastive estimation on the counts of all pairs of symbols, (before, next), at one distance.

    For one position the counts are sufficient: each round sums over every pair of the corpus, and over ``noise``
    samples of the noise for each, whose numbers are drawn anew. Adam's steps shrink as the rounds go on.
    """
    pairs = pairs.astype(np.float32)
    n, rng = len(pairs), np.random.default_rng(seed)
    total = max(float(pairs.sum(dtype=np.float64)), 1.0)
    noise_p = ((pairs.sum(axis=0) + 0.5) / (total + 0.5 * n)).astype(np.float32)
    expected = noise * pairs.sum(axis=1, keepdims=True) * noise_p
    p = [x.astype(np.float32) for x in (rng.normal(0, 0.1, (n, size)), np.eye(size) + rng.normal(0, 0.01, (size, size)), rng.normal(0, 0.1, (n, size)), np.log(noise_p))]
    m, v = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
    offset = np.log(noise * noise_p)
    for k in range(1, rounds + 1):
        drawn = rng.poisson(expected).astype(np.float32)  # how often each pair is among the noise
        h = p[0] @ p[1]
        data = 1 / (1 + np.exp(np.clip(offset - h @ p[2].T - p[3], -40, 40)))  # that a pair is of the text, not noise
        g = ((pairs + drawn) * data - pairs) / np.float32(total)  # the slope of the loss by the score of each pair
        dh = g @ p[2]
        slopes = (dh @ p[1].T + l2 / total * p[0], p[0].T @ dh, g.T @ h + l2 / total * p[2], g.sum(axis=0))
        step = 0.05 * (1 - 0.9 * k / rounds)
        for i, slope in enumerate(slopes):
            m[i] = 0.9 * m[i] + 0.1 * slope
            v[i] = 0.99 * v[i] + 0.01 * slope**2
            p[i] -= (step * (m[i] / (1 - 0.9**k)) / (np.sqrt(v[i] / (1 - 0.99**k)) + 1e-9)).astype(np.float32)
    return LogBilinear(*p)


def is_held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 7 == 2


def tokens(text: bytes) -> list[bytes]:
    """Words, A-Z lower-cased; bytes.split parts at just the six ASCII blanks."""
    return text.lower().split()


def word_counts(df: DataFrame) -> DataFrame:
    """(word: binary, c: long) over all texts, the end of each counted; counted in each task before the shuffle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "c"])

        for batch in slices(batches, "text", 4 << 20):
            for t in as_bytes(batch.column("text")):
                held.update(tokens(t))
            held[END] += batch.num_rows
            if len(held) > HELD:
                yield out()
                held.clear()
        if held:
            yield out()

    return df.select("text").mapInArrow(work, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Symbols(dict):
    """Word to symbol: its own, or one that words with the same last bytes share."""

    def __init__(self, own: list[bytes], shared: int) -> None:
        super().__init__(zip(own, range(len(own)), strict=True))
        self.first, self.shared = len(own), shared

    def __missing__(self, word: bytes) -> int:
        return self.first + zlib.crc32(word[-LAST:]) % self.shared


def shared_symbol(word: Column, first: int, shared: int) -> Column:
    """The same in Spark, for words without a symbol of their own."""
    return F.crc32(F.substring(word, F.greatest(F.octet_length(word) - (LAST - 1), F.lit(1)), F.lit(LAST))) % shared + first


def _before(ids: np.ndarray, place: np.ndarray, position: int) -> np.ndarray:
    """The symbols so many tokens before; the end (0) where the text has none. ``place``: a token's place in its text."""
    out = np.zeros_like(ids)
    out[position:] = ids[: len(ids) - position]
    out[place < position] = 0
    return out


def _places(sizes: list[int]) -> np.ndarray:
    return np.arange(sum(sizes)) - np.repeat(np.cumsum([0, *sizes])[:-1], sizes)


def pair_counts(df: DataFrame, own: list[bytes], shared: int, positions: int = POSITIONS) -> Iterator[np.ndarray]:
    """For each distance up to ``positions``, counts of pairs of symbols over all texts as a square matrix.

    Before a text's first token is the end. The matrices have a fixed size, so what each task sends and the driver
    gets is bounded; tasks send what they have met. The corpus is read once.
    """
    words = df.sparkSession.sparkContext.broadcast(own)
    n = len(own) + shared

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Symbols(words.value, shared)
        held = [np.zeros(n * n, np.int64 if n < 100 else np.int32) for _ in range(positions)]
        for batch in slices(batches, "text", 4 << 20):
            flat, sizes = _flat(as_bytes(batch.column("text")))
            ids, place = np.fromiter(map(known.__getitem__, flat), np.int32, len(flat)), _places(sizes)
            for k in range(positions):
                pairs, counts = np.unique(_before(ids, place, k + 1).astype(np.int64) * n + ids, return_counts=True)
                held[k][pairs] += counts.astype(held[k].dtype)
        for k, matrix in enumerate(held):
            at = np.flatnonzero(matrix)
            for i in range(0, len(at), 100_000):
                part = at[i : i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), k, np.int32)), pa.array(part.astype(np.int32)), pa.array(matrix[part].astype(np.int64))], names=["position", "pair", "n"])

    summed = df.select("text").mapInArrow(work, "position int, pair int, n long").groupBy("position", "pair").agg(F.sum("n").alias("n"))
    found = written(summed, "lm-pairs")
    for k in range(positions):
        some = found.where(F.col("position") == k).select("pair", "n").toArrow()
        out = np.zeros(n * n, np.float32)
        out[some["pair"].to_numpy()] = some["n"].to_numpy()
        yield out.reshape(n, n)
    forget(found)


class _Numbers(dict):
    """Word to number; ``other`` for words that are not in it."""

    def __init__(self, words: list[bytes], other: int) -> None:
        super().__init__(zip(words, range(len(words)), strict=True))
        self.other = other

    def __missing__(self, word: bytes) -> int:
        return self.other


def _flat(texts: list[bytes]) -> tuple[list[bytes], list[int]]:
    """All tokens of all texts in one list, ends included, and the tokens of each text."""
    flat: list[bytes] = []
    sizes = []
    for t in texts:
        words = tokens(t)
        flat += words
        flat.append(END)
        sizes.append(len(words) + 1)
    return flat, sizes


def _most_frequent(counts: DataFrame, most: int) -> Column:
    """Whether a word is of the frequent ones, ``most`` at most: whole classes of like counts, from the top, as far as they fit."""
    level = F.floor(F.log2("c") * 16)
    levels = sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True)  # some hundred rows
    least, room = 10_000, most
    for r in levels:
        room -= r["count"]
        if room < 0:
            break
        least = r["level"]
    return level >= least


def score_texts(df: DataFrame, train_on: Column, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``df`` (or its columns ``keep``) with n_tokens, n_known, train_tokens, base_score and score (log10), learning from rows where ``train_on`` holds.

    Counts of words and of pairs of symbols cover all training rows. The models of POSITIONS tokens before, averaged,
    give a token's symbol; a word of a shared one has its share (c - D) / C of it, C being the count of all the symbol's
    tokens and D the discount that the numbers of words met once and twice give. What that leaves, D for each word, is
    for words not met, each of which counts as one met once. So probabilities sum to one over the words met and
    D / (1 - D) times as many unmet ones; a symbol that no word has leaves all it has to one unmet word.
    Frequent words are looked up in each task; the exact counts of all others come by a join, however many they are.

    Null text is empty: its end alone is scored. No training rows leave a uniform model and base scores of 0. A null in
    ``train_on`` is false. Repeated rows count each. No rows give no rows. Input columns of these names are replaced.
    """
    spark = df.sparkSession
    made = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    own = [c for c in (df.columns if keep is None else keep) if c not in made]
    training = df.where(train_on).select(F.col(f"`{text}`").alias("text"))
    counts = written(word_counts(training), "lm-counts")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.count_if(F.col("c") == 1).alias("once"), F.count_if(F.col("c") == 2).alias("twice")).first()
    discount = min(0.9, max(0.1, total["once"] / max(total["once"] + 2 * total["twice"], 1)))
    known_here = _most_frequent(counts, KNOWN_WORDS) | (F.col("word") == F.lit(bytearray(END)))
    heard = counts.where(known_here).toArrow()
    order = sorted(zip(heard["word"].to_pylist(), heard["c"].to_pylist(), strict=True), key=lambda x: (x[0] != END, -x[1], x[0]))
    own_words = [END, *[w for w, _ in order if w != END][: OWN - 1]]
    models = [train(pairs) for pairs in pair_counts(training, own_words, SHARED)]
    by_heart = dict(order)
    # Tokens of the shared symbols: those of all words, less those of words with one of their own.
    sums = {r["s"]: r["c"] for r in counts.groupBy(shared_symbol(F.col("word"), len(own_words), SHARED).alias("s")).agg(F.sum("c").alias("c")).collect()}
    symbols = Symbols([], SHARED)
    for w in own_words:
        sums[len(own_words) + symbols[w]] = sums.get(len(own_words) + symbols[w], 0) - by_heart.get(w, 0)
    held = np.array([1.0] * len(own_words) + [max(sums.get(len(own_words) + k, 0), 1.0) for k in range(SHARED)])
    base_log = np.log10(total["n"] + total["v"] + 1)
    shared = spark.sparkContext.broadcast((models, own_words, SHARED, np.log10(held), discount, list(by_heart), np.array(list(by_heart.values()), np.int64)))

    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), F.col(f"`{text}`").alias("text"), F.monotonically_increasing_id().alias("uid"))
    schema = f"row {rows.schema['row'].dataType.simpleString()}, uid long, n_tokens long, n_here long, logs double, score double, others array<binary>"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, logs, shares, symbol_of, symbols, tables, sums_log = _prepared(shared.value)
        n_known = len(logs) - 1
        for batch in slices(batches, "text", 8 << 20):
            flat, sizes = _flat(as_bytes(batch.column("text")))
            ids = np.fromiter(map(numbers.__getitem__, flat), np.int64, len(flat))
            cuts = np.cumsum([0, *sizes])[:-1]
            here = ids < n_known
            symbol = symbol_of[ids]
            far = np.flatnonzero(~here)
            symbol[far] = [symbols[flat[k]] for k in far.tolist()]
            place = _places(sizes)
            score = np.log10(sum(t[_before(symbol, place, k), symbol] for k, t in enumerate(tables, 1)).astype(np.float64))
            score += shares[ids] - sums_log[symbol]
            missing = np.flatnonzero(~here)
            spread = np.searchsorted(missing, np.append(cuts, len(ids)))
            others = [flat[k] for k in missing.tolist()]
            offsets = pa.array(spread.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"),
                    batch.column("uid"),
                    pa.array(np.array(sizes, np.int64)),
                    pa.array(np.add.reduceat(here.astype(np.int64), cuts)),
                    pa.array(np.add.reduceat(logs[ids], cuts)),
                    pa.array(np.add.reduceat(score, cuts)),
                    pa.ListArray.from_arrays(offsets, pa.array(others, pa.binary())),
                ],
                names=["row", "uid", "n_tokens", "n_here", "logs", "score", "others"],
            )

    scored = written(rows.mapInArrow(work, schema), "lm-scores")  # with their numbers, which later reads cannot change
    rest = counts.where(~known_here)
    words = scored.select("uid", F.explode("others").alias("word")).join(rest, "word", "left")
    sums = words.groupBy("uid").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + 1)).alias("more"), F.sum(F.log10(F.coalesce("c", F.lit(1)) - discount)).alias("more_share"), F.count("c").alias("met"))
    more, met = F.coalesce("more", F.lit(0.0)), F.coalesce("met", F.lit(0))
    base = F.col("logs") + more - F.col("n_tokens") * F.lit(float(base_log))
    return scored.drop("others").join(sums, "uid", "left").select(
        "row.*", "n_tokens", (F.col("n_here") + met).alias("n_known"), F.lit(total["n"]).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("score") + F.coalesce("more_share", F.lit(0.0))).alias("score")
    )


_READY: list[tuple] = []


def _prepared(shared: tuple) -> tuple[_Numbers, np.ndarray, np.ndarray, np.ndarray, Symbols, list[np.ndarray], np.ndarray]:
    """Per worker: numbers of the words known by heart; log10 of their counts and one, log10 of their parts of their
    symbols' tokens (0 with a symbol of their own) and their symbols (the last entries stand for other words); symbols
    of words; the models' tables, each with its part of the average; log10 of the tokens of each symbol."""
    if not _READY or _READY[0] is not shared:
        models, own_words, n_shared, sums_log, discount, words, counts = shared
        symbols = Symbols(own_words, n_shared)
        symbol_of = np.array([*(symbols[w] for w in words), 0], np.int32)
        logs = np.append(np.log10(counts + 1.0), 0.0)
        shares = np.append(np.where(symbol_of[:-1] < len(own_words), 0.0, np.log10(counts - discount)), 0.0)
        _READY[:] = [shared, (_Numbers(words, len(words)), logs, shares, symbol_of, symbols, [m.probabilities() / np.float32(len(models)) for m in models], sums_log)]
    return _READY[1]


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learnt from those whose checksum of the id leaves another remainder than 2 by 7."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", is_held_out(F.col("doc_id")).alias("held_out"))
    found = score_texts(docs, ~F.col("held_out"), keep=["doc_id", "held_out"])
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
