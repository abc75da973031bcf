"""Toxicity by weak supervision: voters, a generative label model, a linear classifier."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemaloom.llm.common import with_fields
from schemaloom.runtime import broadcast_if_small, materialise

#: Words and word starts in the lexicon, and the voters that they are dealt to.
TERMS = 600
VOTERS = 24
#: Characters of a word start.
START = 5
#: A term needs so many toxic training documents, in all and as a share.
LEAST = 5
LEAST_SHARE = 0.01
#: Its log odds ratio must exceed so many standard errors, and be so large a part of the clearest term's.
ERRORS = 2.0
LEAST_PART = 0.55
#: Labelled rows, chosen by hash, on which label model and classifier are fitted; lexicon counts are over all.
FIT_ROWS = 20_000
ROUNDS = 25
RIDGE = 0.1
THRESHOLD = 0.7
#: Terms that a task counts before it hands the counts on.
COUNTED = 300_000
#: Label rows (16 bytes each) up to which they are broadcast.
BROADCAST_LABELS = 1_000_000

WORDS = re.compile(r"\w+")
PATTERNS = [
    re.compile(r"!!"),
    re.compile(r"\b[A-Z]{4,}\b.{0,80}\b[A-Z]{4,}\b"),
    re.compile(r"\b(?:you|your|du|dich|tu|toi|te|usted)\b.{0,40}!", re.I),
    re.compile(r"([^\W\d_])\1{5,}"),
]


def terms_of(text: str | None) -> set[str]:
    """The distinct lower-cased words of a text and the starts (with a star) of the longer ones."""
    words = set(WORDS.findall((text or "").lower()))
    return words | {f"{w[:START]}*" for w in words if len(w) > START}


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, toxic) of labelled rows outside the held-out third; null ids and labels do not count."""
    known = labels.where("toxic is not null and doc_id is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    return docs.select("doc_id", "text").join(broadcast_if_small(known, BROADCAST_LABELS), "doc_id")


def term_counts(training: DataFrame) -> DataFrame:
    """(term, n, n_toxic): training documents with each term, summed per task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, toxic = Counter(), Counter()

        def rows() -> pa.RecordBatch:
            columns = [pa.array(list(every), pa.string()), pa.array(list(every.values()), pa.int64())]
            columns.append(pa.array([toxic[t] for t in every], pa.int64()))
            every.clear()
            toxic.clear()
            return pa.record_batch(columns, ["term", "n", "n_toxic"])

        for batch in batches:
            for text, label in zip(batch["text"], batch["toxic"].to_pylist()):
                found = terms_of(text.as_py())
                every.update(found)
                if label:
                    toxic.update(found)
                if len(every) >= COUNTED:
                    yield rows()
        yield rows()

    parts = training.mapInArrow(run, "term string, n long, n_toxic long")
    return parts.groupBy("term").agg(F.sum("n").alias("n"), F.sum("n_toxic").alias("n_toxic"))


def choose_lexicon(counts: DataFrame, n_toxic: int, n_clean: int, size: int = TERMS) -> list[str]:
    """The ``size`` terms that tell most toxic documents, by toxic documents times log odds ratio.

    Terms far weaker than the clearest one are left out, however strong that is; where nothing tells the classes
    apart no term is chosen.
    """
    odds = f"ln((n_toxic + 0.5) / {n_toxic + 1.0}) - ln((n - n_toxic + 0.5) / {n_clean + 1.0})"
    error = "sqrt(1 / (n_toxic + 0.5) + 1 / (n - n_toxic + 0.5))"
    known = counts.where(f"n_toxic >= {max(LEAST, LEAST_SHARE * n_toxic)}")
    known = materialise(known.withColumn("odds", F.expr(odds)).where(f"odds > {ERRORS} * {error}"))
    clearest = known.agg(F.max("odds")).first()[0] or 0.0
    strong = known.where(F.col("odds") >= LEAST_PART * clearest)
    top = strong.orderBy(F.desc(F.col("n_toxic") * F.col("odds")), "term").limit(size)
    return [r.term for r in top.select("term").collect()]


class Features:
    """Which lexicon terms and patterns a text has; the votes of the voters that they make up."""

    def __init__(self, lexicon: list[str], voters: int = VOTERS):
        self.index = {t: i for i, t in enumerate(lexicon)}
        self.lexicon = frozenset(lexicon)
        self.size = len(lexicon) + len(PATTERNS)
        self.voters = min(voters, max(len(lexicon), 1))

    def of(self, text: str | None) -> list[int]:
        found = [self.index[t] for t in self.lexicon & terms_of(text)]
        return found + [len(self.index) + i for i, p in enumerate(PATTERNS) if p.search(text or "")]

    def voter(self, feature: int) -> int:
        """Lexicon terms are dealt out in turn, so that voters overlap little; each pattern is a voter."""
        lexical = len(self.index)
        return feature % self.voters if feature < lexical else self.voters + feature - lexical

    def matrix(self, rows: list[list[int]]) -> np.ndarray:
        out = np.zeros((len(rows), self.size), np.float32)
        for i, found in enumerate(rows):
            out[i, found] = 1
        return out

    def votes(self, rows: list[list[int]]) -> np.ndarray:
        out = np.zeros((len(rows), self.voters + len(PATTERNS) + 1))
        for i, found in enumerate(rows):
            out[i, [self.voter(f) for f in found]] = 1
        out[:, -1] = ~out[:, : self.voters].any(axis=1)  # no term of the lexicon at all: a vote for clean
        return out


def label_posteriors(votes: np.ndarray, start: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, dict]:
    """Posterior of the toxic class under a generative model of the votes, fitted by expectation maximisation.

    A voter votes or abstains, and has a rate of voting per class (its accuracy); abstaining is no
    evidence. Voters that still agree where the class explains their votes are correlated; each voter's
    evidence is divided by one plus its correlations with the others that vote with it, so that a crowd
    that votes alike counts about once. ``start`` is the given label as a probability; it is a voter of
    that fixed accuracy, which keeps the classes from drifting.
    """
    posterior = start.astype(float)
    given = np.log(start / (1 - start))
    weights = np.ones(votes.shape[1])
    for _ in range(rounds):
        prior = np.clip(posterior.mean(), 1e-4, 1 - 1e-4)
        total = np.array([(1 - posterior).sum(), posterior.sum()])
        toxic_votes = np.stack([(1 - posterior) @ votes, posterior @ votes])
        rates = (toxic_votes + 0.5) / (total[:, None] + 1)
        rest = votes - ((1 - posterior)[:, None] * rates[0] + posterior[:, None] * rates[1])
        scale = np.sqrt((rest**2).mean(axis=0)) + 1e-9
        related = (rest.T @ rest) / len(votes) / np.outer(scale, scale)
        np.fill_diagonal(related, 0)
        related = np.clip(related, 0, 1)
        weights = 1 / (1 + related.sum(axis=1))
        shared = 1 / (1 + votes @ related)  # by document: only voters that vote there
        logit = given + np.log(prior / (1 - prior)) + (votes * shared) @ np.log(rates[1] / rates[0])
        posterior = 1 / (1 + np.exp(-np.clip(logit, -50, 50)))
    return posterior, {"prior": prior, "rates": rates, "weights": weights, "correlations": related}


def fit_linear(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, rounds: int = 20) -> np.ndarray:
    """Logistic regression on soft labels by damped Newton steps; the last weight is the constant."""
    x = np.concatenate([x, np.ones((len(x), 1), x.dtype)], axis=1).astype(np.float64)
    w = np.zeros(x.shape[1])
    mean = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    w[-1] = np.log(mean / (1 - mean))
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-3

    def loss(w: np.ndarray) -> float:
        logit = x @ w
        return float((np.logaddexp(0, logit) - y * logit).sum() + (penalty * w * w).sum() / 2)

    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        gradient = x.T @ (p - y) + penalty * w
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step, size = np.linalg.solve(curve, gradient), 1.0
        while (after := loss(w - size * step)) > now and size > 1e-4:
            size /= 2
        if after >= now - 1e-7 * abs(now):
            break
        w, now = w - size * step, after
    return w


@dataclass
class Model:
    features: Features
    weights: np.ndarray
    label_model: dict

    def score(self, text: str | None) -> float:
        found = self.features.of(text)
        logit = float(self.weights[found].sum() + self.weights[-1])
        return 1 / (1 + float(np.exp(-np.clip(logit, -50, 50))))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model | None:
    """A model from the labelled rows outside the held-out third; None if they do not have both classes.

    Counts behind the lexicon are over all of these rows. ``fit_rows`` of them, by hash of id and text,
    go to the driver as lists of features: the label model is started from their labels and fitted to
    their votes, and the classifier is fitted to the label model's posteriors.
    """
    training = training_rows(docs, labels)
    total = training.agg(F.count(F.lit(1)), F.sum(F.when(F.col("toxic") > 0, 1).otherwise(0))).first()
    n, n_toxic = total[0], total[1] or 0
    if not n_toxic or n_toxic == n:
        return None
    features = Features(choose_lexicon(term_counts(training), n_toxic, n - n_toxic))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([sorted(features.of(t.as_py())) for t in batch["text"]], pa.list_(pa.int32()))
            yield pa.record_batch([batch["toxic"], batch["rank"], found], ["toxic", "rank", "found"])

    ranked = training.withColumn("rank", F.xxhash64("doc_id", "text"))
    rows = ranked.select("toxic", "rank", "text").mapInArrow(run, "toxic int, rank long, found array<int>")
    sample = rows.orderBy("rank", "toxic", "found").limit(fit_rows).collect()
    found = [r.found for r in sample]
    start = np.array([0.98 if r.toxic else 0.02 for r in sample])
    posterior, described = label_posteriors(features.votes(found), start)
    return Model(features, fit_linear(features.matrix(found), posterior), described)


def with_scores(docs: DataFrame, model: Model | None, column: str) -> DataFrame:
    """``docs`` with the score (0 to 1) of each ``text``; null counts as empty. Without a model all are 0."""
    if model is None:
        return docs.withColumn(column, F.lit(0.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = pa.array([model.score(t.as_py()) for t in batch["text"]], pa.float64())
            yield pa.record_batch([*batch.columns, scores], [*batch.schema.names, column])

    return docs.mapInArrow(run, with_fields(docs.schema, **{column: "double"}))


def judge(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of ``docs(doc_id, text)``.

    Scores read the text alone. A null doc_id is not held out and never trained on. Repeated rows stay
    repeated; a label given twice counts as its larger value. No rows in, no rows out.
    """
    scored = with_scores(docs.select("doc_id", "text"), fit(docs, labels, fit_rows), "score")
    return scored.select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
