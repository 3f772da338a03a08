"""Toxicity scores by weak supervision: many voters, a label model, a linear classifier.

Voters are words and word beginnings that a bounded sample of labelled documents shows to be far
likelier in toxic texts, a fixed list of insults in four languages, patterns of address, and two looks
at the text as a whole: shouting, and words repeated without end. A voter
votes where it occurs and abstains elsewhere. The label model is generative: given the unknown
class, each voter fires at a rate of its own. EM estimates those rates over the labelled sample and a
bounded sample of documents without labels, silent ones too; a label is one more witness there, of an accuracy that
is estimated like the voters', and tells which class is the toxic one. The sample has the classes in other
proportions than the labels; weights put that right in every sum. A label that no voter bears
out is overruled. Voters repeat each other (a word and its beginning always fire together): their correlations within the classes are
parameters too, estimated in each round, and the votes are weighted by the inverse of the
correlation matrix, so that echoes share one vote. The posterior labels, made from the votes and, as one
witness of its estimated accuracy, the given label, then train a logistic classifier on the voters, which
scores every document. So what only some labels know, of texts in which few voters fire, still ranks.

Only rows whose crc32(doc_id as text) mod 5 is not 0 are learnt from, with or without labels, and
labels, language, source and id never enter a score. The samples are at most ``per_class`` documents
of each class and ``unlabelled`` others, those with the lowest hashes; the driver sees only their
voters. Of the induced voters the ``voters`` strongest are kept; on the fixtures there are fewer.
Scoring is one pass over whole texts without shuffles.

Defined results: a null or empty text has no voters and gets the score of silence; a text of any
length is read whole; equal texts and repeated rows get equal scores; an id that occurs several
times is learnt from once, with its least text and its gravest label; columns of the input other
than doc_id and text give way; without documents there are no rows; with labels of one class only or
none, every score is the smoothed share of toxic labels, 0 where there is none.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import bounded_batches, digits
from evidentia.llm.word_bpe import Remembered
from evidentia.plans.staging import staged

WORD = re.compile(r"[^\W\d_]+")
#: Lengths of the word beginnings that may become voters. Short ones occur in any text.
STEMS = (4, 5, 6, 7)
#: Insults that vote even where the sample lacks them, in English, German, Spanish and French.
INSULTS = (
    "asshole", "bastard", "bitch", "clown", "cretin", "disgusting", "dumb", "fool", "garbage", "idiot", "imbecile", "jerk", "loser", "moron", "pathetic", "pig", "scum", "stupid", "trash", "useless", "vermin", "worthless",
    "abschaum", "arschloch", "blödmann", "dummkopf", "dreckig", "ekelhaft", "erbärmlich", "idioten", "mistkerl", "nutzlos", "schwachkopf", "trottel", "versager", "widerlich",
    "asqueroso", "basura", "cabrón", "cretino", "escoria", "estúpido", "estúpida", "idiota", "imbécil", "inútil", "maldito", "payaso", "patético", "tonto",
    "abruti", "connard", "crétin", "débile", "dégoûtant", "idiote", "imbécile", "inutile", "minable", "ordure", "pathétique", "racaille", "salaud", "stupide",
)
PATTERNS = {
    "told off": re.compile(r"\b(?:shut up|get lost|go to hell|drop dead|you people|kill yourself)\b"),
    "called names": re.compile(r"\byou(?:'re| are)? (?:such )?an? (?:\w+ )?(?:" + "|".join(INSULTS) + r")\b"),
    "hatred": re.compile(r"\bi? ?hate (?:you|them|all)\b"),
    "masked insult": re.compile(r"\b[a-z]{1,3}[*@#$]{2,}[a-z]{0,4}\b"),
}


def shouted(text: str) -> bool:
    """Mostly capitals, with many exclamation marks."""
    marks = text.count("!")
    if not marks or 20 * marks <= len(text.split()):
        return False
    letters = sum(map(str.isalpha, text))
    return letters >= 40 and 2 * sum(map(str.isupper, text)) > letters


def repeated(text: str) -> bool:
    """A third of the words or more are the word before once again."""
    words = text.split()
    return len(words) >= 12 and 3 * sum(a == b for a, b in zip(words, words[1:])) >= len(words)


#: Voters that look at the whole text as it is written.
SHAPES = {"shouted": shouted, "repeated": repeated}
#: In the place of a label where there is none.
UNLABELLED = -1
#: The least correlation within the classes at which voters count as echoes of each other.
ECHO = 0.5


@dataclass(frozen=True)
class ToxicityModel:
    """per_class, unlabelled: documents of each labelled class, and others, to learn from, at most.
    voters: induced voters kept, the strongest. odds: how many times likelier a voter must be in toxic
    texts. seen: toxic documents that must have it. label_accuracy: how far a label is trusted at
    the start of EM."""

    per_class: int = 4000
    unlabelled: int = 8000
    voters: int = 400
    odds: float = 8.0
    seen: int = 5
    label_accuracy: float = 0.95
    ridge: float = 0.3


@dataclass
class Fitted:
    names: list[str] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    intercept: float = -30.0


def stems(word: str) -> list[str]:
    return [word[:n] + "*" for n in STEMS if len(word) >= n]


class Voters:
    """Finds which voters fire in a text. Names are words, ``stem*`` or ``/pattern/``."""

    def __init__(self, names: list[str]):
        self.at = {n: i for i, n in enumerate(names)}
        self.patterns = [(self.at[f"/{k}/"], p) for k, p in PATTERNS.items() if f"/{k}/" in self.at]
        self.shapes = [(self.at[f"/{k}/"], f) for k, f in SHAPES.items() if f"/{k}/" in self.at]
        self.known = Remembered(200_000)

    def of_word(self, word: str) -> tuple[int, ...]:
        found = self.known[word]
        if found is None:
            found = tuple(i for n in (word, *stems(word)) if (i := self.at.get(n)) is not None)
            self.known.put(word, found)
        return found

    def fired(self, text: str) -> list[int]:
        """The voters that occur in the text, in order."""
        lower = text.lower()
        found = {i for word in set(WORD.findall(lower)) for i in self.of_word(word)}
        found.update(i for i, p in self.patterns if p.search(lower))
        found.update(i for i, f in self.shapes if f(text))
        return sorted(found)


def sampled(documents: DataFrame, labels: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, text, toxic of the documents to learn from; one row for each id, UNLABELLED where there is no label."""
    marks = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = marks.filter(F.pmod(F.crc32(digits(F.col("doc_id"))), F.lit(5)) != 0)
    order = [F.xxhash64(digits(F.col("doc_id"))), F.col("doc_id")]
    ids = marks.filter("toxic = 1").orderBy(*order).limit(model.per_class).unionByName(marks.filter("toxic = 0").orderBy(*order).limit(model.per_class))
    rest = documents.select("doc_id").filter("doc_id is not null").filter(F.pmod(F.crc32(digits(F.col("doc_id"))), F.lit(5)) != 0)
    rest = rest.join(labels.filter("toxic is not null").select("doc_id"), "doc_id", "left_anti").distinct()
    ids = ids.unionByName(rest.orderBy(*order).limit(model.unlabelled).withColumn("toxic", F.lit(UNLABELLED).cast(ids.schema["toxic"].dataType)))
    found = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
    return staged(found.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("toxic").alias("toxic")), "toxicity_sample")


def induced(sample: DataFrame, n_toxic: int, n_clean: int, model: ToxicityModel) -> list[str]:
    """Words and stems far likelier in the sample's toxic texts, the strongest first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, clean = Counter(), Counter()
        for batch in batches:
            for text, is_toxic in zip(batch.column(0), batch.column(1).to_pylist()):
                own = set(WORD.findall(text.as_py().lower()))
                own.update([s for w in own for s in stems(w)])
                if is_toxic != UNLABELLED:
                    (toxic if is_toxic else clean).update(own)
        names = sorted(toxic.keys() | clean.keys())
        for k in range(0, len(names), 50_000):
            part = names[k : k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([toxic[n] for n in part], pa.int64()), pa.array([clean[n] for n in part], pa.int64())], ["term", "toxic", "clean"])

    counts = sample.select("text", "toxic").mapInArrow(count, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    odds = ((F.col("toxic") + 0.5) / (n_toxic + 1)) / ((F.col("clean") + 0.5) / (n_clean + 1))
    best = counts.filter((F.col("toxic") >= model.seen) & (odds >= model.odds)).orderBy((F.log(odds) * F.sqrt("toxic")).desc(), "term").limit(model.voters)
    return [r["term"] for r in best.collect()]


def posteriors(votes: np.ndarray, rates: tuple[np.ndarray, np.ndarray], share: np.ndarray, prior: float, typical: np.ndarray) -> np.ndarray:
    """The probability of the toxic class for each row: rates of firing in clean and toxic texts, weights of the voters.

    A vote adds what firing says over silence. What silence of all says is not multiplied up from
    hundreds of rare voters but set so that the mean over the ``typical`` rows (a mask, or weights) is ``prior``."""
    fires, silent = np.log(rates[1] / rates[0]), np.log((1 - rates[1]) / (1 - rates[0]))
    evidence = votes @ (share * (fires - silent))
    of = lambda base: 1 / (1 + np.exp(-np.clip(base + evidence, -30, 30)))
    low, high = -60.0, 60.0
    for _ in range(50):
        middle = (low + high) / 2
        low, high = (middle, high) if np.average(of(middle), weights=typical) < prior else (low, middle)
    return np.clip(of(low), 1e-12, 1 - 1e-12)


def echo_weights(votes: np.ndarray, posterior: np.ndarray, rates: tuple[np.ndarray, np.ndarray], weight: np.ndarray | None = None) -> np.ndarray:
    """The inverse of the voters' correlations within the classes, summed for each voter: 1 for one that
    none repeats, 1/k for each of k that always fire together. Correlations below ECHO do not count:
    posteriors that are not sure leave some between any two voters of a class."""
    left = votes - np.outer(1 - posterior, rates[0]) - np.outer(posterior, rates[1])
    left *= np.sqrt(np.ones(len(votes)) if weight is None else weight / weight.mean())[:, None]
    spread = np.sqrt((left**2).mean(0)) + 1e-9
    correlation = np.clip((left.T @ left) / len(votes) / np.outer(spread, spread), 0, 1)
    correlation[correlation < ECHO] = 0
    np.fill_diagonal(correlation, 1)
    return np.clip(np.linalg.solve(correlation + 0.05 * np.eye(len(correlation)), np.full(len(correlation), 1.05)), 0, 1)


def heard_labels(posterior: np.ndarray, given: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The votes' posterior once the label, where there is one, is heard as a witness; its accuracy in each class
    is estimated from ``given``, the probability of the toxic class for each row."""
    known, said = (labels != UNLABELLED) * weight, labels == 1
    right = [np.clip(((p * said * known).sum() + 0.5) / ((p * known).sum() + 1), 0.01, 0.99) for p in (1 - given, given)]
    witness = np.where(said, np.log(right[1] / right[0]), np.log((1 - right[1]) / (1 - right[0]))) * (labels != UNLABELLED)
    return 1 / (1 + np.exp(-np.clip(np.log(posterior / (1 - posterior)) + witness, -30, 30)))


def label_model(votes: np.ndarray, labels: np.ndarray, prior: float, accuracy: float, rounds: int = 30, weight: np.ndarray | None = None) -> np.ndarray:
    """The posterior probability of the toxic class for each row, from its votes alone.

    Rates and correlations come from EM over all rows. Where there is a label (UNLABELLED for none) it
    stands beside the votes while rates are estimated, as one more witness whose own accuracy in each
    class is estimated too; that keeps the classes what the labels mean. It has no part in what is
    returned, so a label that the votes do not bear out is overruled. ``prior`` is the share of toxic
    documents; ``weight`` must give the labelled rows that share where they were drawn by class, else toxic
    rows in excess of it would be taken for clean."""
    known, said = labels != UNLABELLED, labels == 1
    weight = np.ones(len(votes)) if weight is None else weight
    v = votes.astype(float)
    posterior, heard = None, np.where(said, accuracy, 1 - accuracy)
    counts = known * weight
    for _ in range(rounds):
        rates = tuple(((p * counts) @ v + 0.1) / ((p * counts).sum() + 1) for p in (1 - heard, heard))
        new = posteriors(v, rates, echo_weights(v, heard, rates, weight), prior, weight * (known if known.any() else ~known))
        done = posterior is not None and np.abs(new - posterior).max() < 1e-6
        posterior, counts = new, weight
        if done or not known.any():
            break
        heard = heard_labels(new, heard, labels, weight)
    return posterior


def train_linear(x: np.ndarray, target: np.ndarray, weight: np.ndarray, ridge: float, steps: int = 50) -> np.ndarray:
    """Weights and, last, the intercept of a logistic regression on soft labels, by Newton's method."""
    z = np.column_stack([x, np.ones(len(x))])
    penalty = np.append(np.full(x.shape[1], ridge), 1e-3)
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (weight * (p - target)) + penalty * w
        step = np.linalg.solve((z * (weight * p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty), gradient)
        w -= step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-7:
            break
    return w


def fit(documents: DataFrame, labels: DataFrame, model: ToxicityModel) -> Fitted:
    shares = labels.filter("toxic is not null and doc_id is not null").filter(F.pmod(F.crc32(digits(F.col("doc_id"))), F.lit(5)) != 0).agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("t")).first()
    n, t = shares["n"], shares["t"]
    if not 0 < t < n:
        share = (t + 0.5) / (n + 1) if n else 0.0
        return Fitted(intercept=float(np.log(share / (1 - share))) if share else -30.0)
    sample = sampled(documents, labels, model)
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    names = induced(sample, sizes.get(1, 0), sizes.get(0, 0), model)
    names += [w for w in INSULTS if w not in names] + [f"/{k}/" for k in (*PATTERNS, *SHAPES)]

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters = Voters(names)
        for batch in batches:
            fired = [voters.fired(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fired, pa.list_(pa.int32()))], ["doc_id", "toxic", "fired"])

    kinds = {f.name: f.dataType.simpleString() for f in sample.schema}
    rows = sample.select("doc_id", "text", "toxic").mapInArrow(vote, f"doc_id {kinds['doc_id']}, toxic {kinds['toxic']}, fired array<int>").orderBy("doc_id").collect()
    y = np.array([r["toxic"] for r in rows])
    votes = np.zeros((len(rows), len(names)), bool)
    for i, r in enumerate(rows):
        votes[i, r["fired"]] = True
    known = y != UNLABELLED
    if not 0 < (y == 1).sum() < known.sum():
        return Fitted(intercept=float(np.log((t + 0.5) / (n - t + 0.5))))
    share = t / n
    # The labelled sample has the classes in other proportions than the labels; weights put that right.
    ratio = (y == 1).sum() / known.sum()
    weight = np.where(y == 1, share / ratio, np.where(y == 0, (1 - share) / (1 - ratio), 1.0))
    posterior = label_model(votes, y, float(share), model.label_accuracy, weight=weight)
    w = train_linear(votes.astype(float), heard_labels(posterior, posterior, y, weight), weight, model.ridge)
    return Fitted(names, w[:-1].tolist(), float(w[-1]))


def toxicity_scores(documents: DataFrame, labels: DataFrame, model: ToxicityModel = ToxicityModel()) -> DataFrame:
    """doc_id, held_out, score, predicted and the number of voters that fired, for every document."""
    fitted = fit(documents, labels, model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters = Voters(fitted.names)
        for batch in batches:
            scores, fired = [], []
            for text in batch.column(1):
                found = voters.fired(text.as_py() or "")
                logit = fitted.intercept + sum(fitted.weights[i] for i in found)
                scores.append(1 / (1 + np.exp(-min(max(logit, -30.0), 30.0))))
                fired.append(len(found))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(fired, pa.int32())], ["doc_id", "score", "n_voters"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    scored = bounded_batches(documents.select("doc_id", "text")).mapInArrow(score, f"doc_id {kind}, score double, n_voters int")
    held_out = F.pmod(F.crc32(digits(F.col("doc_id"))), F.lit(5)) == 0
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_voters")
