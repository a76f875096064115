"""Topics of texts: counts of a bounded vocabulary, a topic model over all rows, shares per row.

Rounds, draws, steps and stops of the fit follow Spark's variational Bayes, and the result is a Spark model. What is made
here is the step of a round that infers the topics of each drawn text: many texts go through it together as one array.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.clustering import LDA, LDAModel, LocalLDAModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.linalg import DenseMatrix, Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import col
from ..session import cut_lineage, scratch_path
from .models import SEED

#: most words of the vocabulary; share of the rows that a word may stand in; rows that it must stand in
WORDS, MOST_SHARE, LEAST_ROWS = 5_000, 0.5, 2
#: words of texts, with padding, that go through the inference as one array
HELD = 1 << 15
#: shape of the first guesses, and the mean change of a text's topics that ends its inference, as in Spark's fit
SHAPE, CHANGE = 100.0, 1e-3
#: reach of a leap where the steps still grow
GROWS = 8.0
#: words of a text up to which, and the least prior from which, single precision tells a step's change
SINGLE_COUNT, SINGLE_PRIOR = 10_000, 0.05


def words_of(text: str) -> Column:
    """Lower-cased runs of letters, in any script; a null text has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(col(text).cast("string"), F.lit(""))), F.lit(r"\p{L}+"), 0)


def vocabulary(df: DataFrame, text: str, words: int = WORDS, most_share: float = MOST_SHARE, least_rows: int = LEAST_ROWS) -> list[str]:
    """The ``words`` words that stand in most rows, of those in at least ``least_rows`` and at most ``most_share`` of them; smaller words first on ties."""
    rows = df.count()
    found = df.select(F.explode(F.array_distinct(words_of(text))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    kept = found.filter((F.col("n") >= least_rows) & (F.col("n") <= most_share * rows))
    return [r.word for r in kept.orderBy(F.desc("n"), "word").limit(words).collect()]


def digamma(x: np.ndarray) -> np.ndarray:
    """Of positive numbers, to about twelve digits: six steps up, then the asymptotic series."""
    u, y = x * (x + 5.0), x + 6.0
    z = 1.0 / (y * y)
    series = z * (1 / 12 - z * (1 / 120 - z * (1 / 252 - z * (1 / 240 - z * (1 / 132 - z * (691 / 32760 - z / 12))))))
    return np.log(y) - 0.5 / y - series - (2.0 * x + 5.0) * (1.0 / u + 1.0 / (u + 4.0) + 1.0 / (u + 6.0))


def grown(x: np.ndarray) -> np.ndarray:
    """exp(digamma) of positive numbers, to about eight digits: as `digamma`, with its six steps as one fraction and a shorter series."""
    u, y = x * (x + 5.0), x + 6.0
    z = 1.0 / (y * y)
    steps = (2.0 * x + 5.0) * ((3.0 * u + 20.0) * u + 24.0) / (u * (u + 4.0) * (u + 6.0))
    return y * np.exp(z * (z * (1 / 120 - z * (1 / 252)) - 1 / 12) - 0.5 / y - steps)


def expected(weights: np.ndarray) -> np.ndarray:
    """exp(E[log p]) of Dirichlet weights along the last axis."""
    return np.exp(digamma(weights) - digamma(weights.sum(axis=-1, keepdims=True)))


def sparse(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, counts and the number of words of each row, of sparse vectors as Arrow holds them."""
    _, _, words, counts = vectors.flatten()
    return words.flatten().to_numpy(), counts.flatten().to_numpy(), words.value_lengths().to_numpy().astype(np.int64)


def inferred(words: np.ndarray, counts: np.ndarray, lengths: np.ndarray, beta: np.ndarray, prior: np.ndarray,
             rng: np.random.Generator) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(texts, their words, topic weights, counts over expected counts) of all texts with words, each until a step changes no more.

    ``beta`` has a row per word, and one of zeros for padding. Texts of like length go together. Those that take longer than
    most beside them are put off and go together later, so that few never keep an array busy. Steps are made in single
    precision where the counts and the prior allow it, with the rows of ``beta`` scaled, which changes no step; the expected
    counts of the weights found are made in double precision.
    """
    starts, none = np.cumsum(lengths) - lengths, len(beta) - 1
    weights = rng.gamma(SHAPE, 1.0 / SHAPE, (len(lengths), len(prior)))
    most = beta.max(axis=1, keepdims=True)
    scaled = beta / np.where(most > 0.0, most, 1.0)
    single = scaled.astype(np.float32)
    total = np.add.reduceat(np.append(counts, 0.0), starts) if len(lengths) else counts  # of a text without words the next one's
    exact = (total > SINGLE_COUNT) | (prior.min() < SINGLE_PRIOR)
    kinds = [np.flatnonzero((lengths > 0) & (exact if double else ~exact)) for double in (False, True)]
    for table, todo in zip((single, scaled), kinds):
        todo = todo[np.argsort(lengths[todo], kind="stable")]
        while len(todo):
            at, late = 0, []
            while at < len(todo):
                sizes = lengths[todo[at:]]
                n = max(1, int(np.searchsorted(sizes * np.arange(1, len(sizes) + 1), HELD, "right")))
                texts = todo[at:at + n]
                column = np.arange(lengths[texts[-1]])
                inside = column < lengths[texts, None]
                place = np.where(inside, starts[texts, None] + column, 0)
                w, c = np.where(inside, words[place], none), np.where(inside, counts[place], 0.0)
                given = np.ascontiguousarray(table[w].transpose(0, 2, 1))
                ended, found = settled(given, c.astype(table.dtype), weights[texts].astype(table.dtype), prior.astype(table.dtype), 0 if n == len(todo) else n // 4)
                weights[texts] = found
                texts, w, c = texts[ended], w[ended], c[ended]
                yield texts, w, weights[texts], c / (np.matmul(beta[w], expected(weights[texts])[:, :, None])[:, :, 0] + 1e-100)
                late.append(todo[at:at + n][~ended])
                at += n
            todo = np.concatenate(late)


def settled(given: np.ndarray, counts: np.ndarray, weights: np.ndarray, prior: np.ndarray, leave: int) -> tuple[np.ndarray, np.ndarray]:
    """(ended, weights) of texts once at most ``leave`` of them still change; ``given`` has a row per topic and text.

    The plain step creeps towards its end along few directions, so after every two steps a text goes on from where they lead
    (Varadhan and Roland's squared extrapolation). There it must change less than in the step before, else it goes back.
    Where steps still grow, as on the way from topics that are all alike, it goes on by `GROWS` at most and may change more.
    What ends a text is always a plain step.
    """
    n, limit = len(given), CHANGE * len(prior)
    out, ended = weights.copy(), np.zeros(n, bool)
    most = counts.sum(axis=1, keepdims=True) + prior.sum()  # what the weights of a text add up to after a step

    def step(at):
        theta = grown(at)  # a factor common to all topics of a text makes no difference
        theta /= theta.max(axis=1, keepdims=True)
        share = np.matmul(theta[:, None, :], given)
        share += 1e-30
        np.divide(counts[:, None, :], share, out=share)
        return prior + theta * np.matmul(given, share.transpose(0, 2, 1))[:, :, 0]

    own, going, safe, least = np.arange(n), np.ones(n, bool), weights, np.full(n, np.inf)
    while True:
        one = step(weights)
        first = one - weights
        change = np.abs(first).sum(axis=1)
        back = going & ~(change <= least)
        if back.any():
            one[back] = safe[back]
        ends = going & ~back & (change <= limit)
        if ends.any():
            out[own[ends]], ended[own[ends]] = one[ends], True
            going &= ~ends
            left = np.count_nonzero(going)
            if left <= leave:
                out[own[going]] = one[going]
                return ended, out
            if left <= 0.8 * len(own):  # those that ended wait until there are enough of them
                given, counts, most, own, one, first, back = (a[going] for a in (given, counts, most, own, one, first, back))
                going = np.ones(left, bool)
        two = step(one)
        second = two - one
        bend = second - first
        far, near = (first * first).sum(axis=1), (second * second).sum(axis=1)
        grows = near > far
        reach = np.clip(np.sqrt(far / np.maximum((bend * bend).sum(axis=1), 1e-30)), 1.0, 1e6)
        reach = np.where(grows, np.minimum(reach, GROWS), reach)[:, None]
        ahead = (one - first) + 2.0 * reach * first + reach * reach * bend
        leaps = ~back & ((ahead > 0.0) & (ahead <= most)).all(axis=1)
        weights, safe = np.where(leaps[:, None], ahead, two), two
        least = np.where(leaps & ~grows, np.abs(second).sum(axis=1), np.inf)


def padded(weights: np.ndarray) -> np.ndarray:
    """A row per word from topics' word weights (topics are rows), with one of zeros for padding."""
    return np.vstack([expected(weights).T, np.zeros(len(weights))])


def gathered(drawn: DataFrame, beta: np.ndarray, prior: np.ndarray, seed: int) -> np.ndarray | None:
    """What the drawn texts (id, features) add to each word (row) and topic, before ``beta``; None if none has a word.

    A text drawn several times stands in neighbouring rows of one id; it is inferred once. A task sends a row per word it met.
    """
    words, k = len(beta) - 1, len(prior)
    shared = drawn.sparkSession.sparkContext.broadcast(beta)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng, total = np.random.default_rng([seed % (1 << 63), TaskContext.get().partitionId()]), np.zeros((words + 1, k))
        for batch in batches:
            ids = batch.column(0).to_numpy()
            first = np.flatnonzero(np.diff(ids, prepend=-1) != 0)
            times = np.diff(first, append=len(ids)).astype(float)
            once = batch.column(1).take(pa.array(first))
            for texts, w, weights, ratio in inferred(*sparse(once), shared.value, prior, rng):
                theta = expected(weights) * times[texts, None]
                for t in range(k):
                    total[:, t] += np.bincount(w.ravel(), (ratio * theta[:, t, None]).ravel(), words + 1)
        met = np.flatnonzero(total[:words].any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), *[pa.array(total[met, t]) for t in range(k)]], ["word", *names])

    names = [f"s{t}" for t in range(k)]
    sums = drawn.mapInArrow(run, ", ".join(["word int", *[f"{n} double" for n in names]])).groupBy("word").agg(*[F.sum(n).alias(n) for n in names])
    found = sums.toPandas()
    shared.destroy()
    if found.empty:
        return None
    out = np.zeros((words, k))
    out[found["word"].to_numpy()] = found[names].to_numpy()
    return out


@dataclass
class Topics:
    """A fitted model with its vocabulary."""

    words: list[str]
    model: LDAModel
    text: str

    def counts(self, df: DataFrame) -> DataFrame:
        return CountVectorizerModel.from_vocabulary(self.words, inputCol="_words", outputCol="_counts").transform(df.withColumn("_words", words_of(self.text)))

    def top_words(self, n: int = 10) -> DataFrame:
        """Rows (topic, rank, word, weight): the ``n`` heaviest words of each topic."""
        found = self.model.describeTopics(n)
        names = found.sparkSession.createDataFrame(list(enumerate(self.words)), "place int, word string")
        each = found.select("topic", F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("at", "t"))
        each = each.select("topic", (F.col("at") + 1).alias("rank"), F.col("t.termIndices").alias("place"), F.col("t.termWeights").alias("weight"))
        return each.join(names, "place").select("topic", "rank", "word", "weight")

    def shares(self, df: DataFrame, name: str = "shares") -> DataFrame:
        """``df`` with an array of topic shares that add up to 1; equal shares where no word of the vocabulary stands."""
        weights, prior = self.model.topicsMatrix().toArray().T, np.array(self.model.estimatedDocConcentration().toArray())
        beta, seed = padded(weights), self.model.getSeed() % (1 << 63)

        @F.arrow_udf("array<double>")
        def shares_of(vectors: pa.Array) -> pa.Array:
            out, rng = np.full((len(vectors), len(prior)), 1.0 / len(prior)), np.random.default_rng(seed)
            for texts, _, found, _ in inferred(*sparse(vectors), beta, prior, rng):
                out[texts] = found / found.sum(axis=1, keepdims=True)
            return pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * len(prior)), pa.array(out.ravel()))

        packed = self.counts(df.select(F.struct("*").alias("_row"), col(self.text)))
        # as not deterministic, or a query that explodes the shares would infer them twice, once for a filter on their number
        return packed.select("_row.*", shares_of.asNondeterministic()("_counts").alias(name))

    def log_likelihood(self, df: DataFrame) -> float:
        return float(self.model.logLikelihood(self.counts(df).select(F.col("_counts").alias("features"))))


def fit_topics(df: DataFrame, text: str, k: int = 10, words: int = WORDS, rounds: int = 30, most_share: float = MOST_SHARE, least_rows: int = LEAST_ROWS, seed: int = SEED) -> Topics:
    """Topics of all rows by variational Bayes, each round a pass over all of them. Raises where no word fits the vocabulary.

    The counts are written once, and what a round sends to the driver is one number per word and topic. First weights,
    the draws of each round and its step are those of Spark's own fit with the same seed.
    """
    names = vocabulary(df, text, words, most_share, least_rows)
    if not names:
        raise ValueError("no word stands in enough rows and not too many")
    spark, shell = df.sparkSession, Topics(names, None, text)
    counts = cut_lineage(shell.counts(df.select(col(text))).select(F.col("_counts").alias("features")), "word-counts")
    lda = LDA(k=k, maxIter=rounds, seed=seed, optimizer="online", subsamplingRate=1.0, learningOffset=1.0, optimizeDocConcentration=False)
    start = lda.fit(spark.createDataFrame([(Vectors.sparse(len(names), [0], [1.0]),)], ["features"]), {lda.maxIter: 0})
    weights, prior = start.topicsMatrix().toArray().T, np.array(start.estimatedDocConcentration().toArray())
    random = spark.sparkContext._jvm.java.util.Random(seed)
    random.nextLong()  # for the first weights
    known = counts.select(F.monotonically_increasing_id().alias("id"), "features")
    for step in range(1, rounds + 1):
        beta = padded(weights)
        added = gathered(known.sample(True, 1.0, random.nextLong()), beta, prior, random.nextLong())
        if added is not None:
            rate = (lda.getLearningOffset() + step) ** -lda.getLearningDecay()
            weights = (1.0 - rate) * weights + rate * ((added * beta[:-1]).T + 1.0 / k)
    # the model before the first round carries all parameters; its weights are put in place
    path = scratch_path(spark, "topics")
    start.save(path)
    data = spark.read.parquet(f"{path}/data")
    row = data.first().asDict() | {"topicsMatrix": DenseMatrix(len(names), k, weights.ravel())}
    spark.createDataFrame([tuple(row[c] for c in data.columns)], data.schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/data")
    shell.model = LocalLDAModel.load(path)
    shell.model.set(shell.model.maxIter, rounds)
    return shell
