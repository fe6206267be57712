"""Toxicity by weak supervision: many noisy voters, a label model, a linear classifier.

Known lexicons and patterns are joined by lexicons mined from a bounded sample of labelled
files: words that the toxic class holds too often to be chance.  Each text is then read once:
all voters vote, and the votes and the shape of the text are kept as a narrow checkpoint.  A generative model with a hidden class explains
the counts of vote patterns (at most two to the number of voters, whatever the corpus):
expectation-maximisation gives how often each voter fires in either class, the class shares
and, from what the votes share beyond the class, their correlations, by which voters that
repeat each other are toned down.  Its posteriors train a linear classifier.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packaudit.functions.tables import cut
from packaudit.llm.common import fold, key_type, slices, texts

FOLDS, HELD_OUT = 5, 0
SAMPLE = 20_000  # files, in the order of a hash of the path: to mine words from, and whose posteriors train the classifier
MINED, GROUPS = 600, 6  # most words mined, and the lexicons they are dealt to
CHANCE = 0.5  # words that pass the mining test by chance, at most, in expectation
ROUNDS, TURNS = 60, 3
TIED = 0.5  # correlation inside a class from which voters count as repeating each other

LEXICONS = {
    "slow": ("idiot", "idiots", "moron", "morons", "stupid", "imbecile", "imbecil", "dumb", "dimwit", "halfwit", "fool", "fools"),
    "worthless": ("worthless", "loser", "losers", "useless", "nobody", "failure", "good-for-nothing"),
    "waste": ("trash", "scum", "garbage", "filth", "vermin", "parasite"),
    "disgust": ("disgusting", "pathetic", "repulsive", "revolting", "vile", "despicable", "hideous"),
    "mockery": ("clown", "clowns", "laughingstock", "freak", "weirdo", "creep"),
    "coarse": ("shit", "bullshit", "crap", "bitch", "bastard", "asshole", "fuck", "fucking", "damn"),
    "german": ("idioten", "dumm", "dummkopf", "trottel", "abschaum", "widerlich", "versager", "erbärmlich", "arschloch", "scheiße"),
    "french": ("imbécile", "stupide", "débile", "crétin", "ordure", "minable", "pathétique", "dégoûtant", "merde", "connard"),
    "spanish": ("idiota", "estúpido", "imbécil", "basura", "asqueroso", "patético", "payaso", "inútil", "mierda", "escoria"),
}
PATTERNS = {
    "threat": r"\b(?:kill|hurt|destroy|hunt)\s+(?:you|them|yourself)\b|\b(?:drop dead|shut up|go to hell)\b",
    "address": r"\byou(?:'re| are)?\s+(?:all\s+|such\s+|an?\s+|nothing\s+but\s+)*(?:idiot|moron|loser|clown|trash|scum|fool|stupid|pathetic|worthless|disgusting)",
    "hatred": r"\b(?:hate|despise|loathe)\s+(?:you|them|those|these)\b",
    "shouting": r"(?:\b[A-Z]{4,}\b[^\w\n]{0,3}){6}",
}
REPEATED = "repeated"  # three or more term hits of any lexicon
VOTERS = (*LEXICONS, *PATTERNS, *(f"mined_{g}" for g in range(GROUPS)), REPEATED)
TERMS = tuple(dict.fromkeys(t for words in LEXICONS.values() for t in words))
FEATURES = (*VOTERS, "log_hits", "log_terms", "hits_per_text", "upper", "exclamations")
_WORD = re.compile(r"[^\W\d_]+")


def mine(files: DataFrame, labels: DataFrame) -> list[str]:
    """Words of the toxic class, most telling first, from at most SAMPLE labelled files
    outside the held-out fold.

    A word passes if so many of the files that hold it would be toxic by chance less than
    CHANCE times among all words tested.  Words are counted per file in tasks; only words
    that pass come to the driver.
    """
    known = labels.select("path", F.col("label").cast("int").alias("label")).where(F.col("label").isNotNull() & (fold("path", FOLDS) != HELD_OUT))
    sample = known.orderBy(F.xxhash64("path"), "path", "label").limit(SAMPLE)
    share = cut(sample).agg(F.avg("label")).first()[0]
    if not share or share >= 1:
        return []

    def count(batches):
        seen: dict[str, list[int]] = {}
        for batch in slices(batches):
            for text, y in zip(texts(batch), batch.column("label").to_pylist()):
                for w in set(_WORD.findall(text.lower())):
                    c = seen.setdefault(w, [0, 0])
                    c[0] += 1
                    c[1] += y
        yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), *(pa.array([c[i] for c in seen.values()], pa.int64()) for i in (0, 1))], ["word", "n", "toxic"])

    told = files.select("path", "content").join(F.broadcast(sample), "path").select("content", "label")  # the sample is bounded
    words = cut(told.mapInArrow(count, "word string, n bigint, toxic bigint").groupBy("word").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic")).where("n >= 3"))
    limit = math.log(CHANCE / max(1, words.count()))
    # Chernoff bound on the chance of so many toxic files among n: exp(-n * divergence).
    rate = F.col("toxic") / F.col("n")
    clean = F.when(rate < 1, (1 - rate) * F.log((1 - rate) / F.lit(1 - share))).otherwise(0.0)
    chance = -F.col("n") * (rate * F.log(rate / F.lit(share)) + clean)
    telling = words.where((rate > max(0.5, share)) & (chance < limit)).orderBy(chance, "word").limit(MINED)
    return [r["word"] for r in telling.select("word").collect()]


class Voters:
    """Finds terms in one scan of a text and lets every voter speak."""

    def __init__(self, mined: list[str]):
        self.lexicons = [set(words) for words in LEXICONS.values()]
        groups = [set(mined[g::GROUPS]) for g in range(GROUPS)]
        self.scan = ahocorasick.Automaton()
        for term in {*TERMS, *mined}:
            self.scan.add_word(term, term)
        self.scan.make_automaton()
        self.groups = groups
        self.patterns = [re.compile(p, 0 if name == "shouting" else re.I) for name, p in PATTERNS.items()]

    def read(self, text: str) -> tuple[int, np.ndarray]:
        low, found = text.lower(), []
        for end, term in self.scan.iter(low):
            before, after = end - len(term), end + 1
            if (before < 0 or not low[before].isalpha()) and (after == len(low) or not low[after].isalpha()):
                found.append(term)
        terms = set(found)
        votes = [*(bool(terms & own) for own in self.lexicons), *(p.search(text) is not None for p in self.patterns), *(bool(terms & own) for own in self.groups), len(found) >= 3]
        size = max(1, len(text))
        shape = math.log1p(len(found)), math.log1p(len(terms)), min(1.0, 60 * len(found) / size), sum(map(text.count, "AEIOU")) / size * 5, min(1.0, text.count("!") / size * 20)
        return sum(1 << i for i, v in enumerate(votes) if v), np.array([*votes, *shape], np.float32)


def signals(files: DataFrame, mined: list[str]) -> DataFrame:
    """(path, votes, features) per file, from its whole content; null content counts as empty.
    ``votes`` has a bit per voter in the order of VOTERS."""

    def run(batches):
        voters = Voters(mined)
        for batch in slices(batches):
            read = [voters.read(t) for t in texts(batch)]
            x = pa.FixedSizeListArray.from_arrays(pa.array(np.array([r[1] for r in read]).ravel()), len(FEATURES)).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array([r[0] for r in read], pa.int64()), x], ["path", "votes", "features"])

    return files.select("path", "content").mapInArrow(run, f"path {key_type(files)}, votes bigint, features array<float>")


@dataclass
class LabelModel:
    prior: float
    rates: np.ndarray  # chance of each voter to fire, in classes 0 and 1
    correlations: np.ndarray  # of votes inside the classes
    trust: np.ndarray  # share of its evidence that each voter keeps

    def posterior(self, votes: np.ndarray, without: tuple[int, ...] = ()) -> np.ndarray:
        v = (votes[:, None] >> np.arange(len(VOTERS))) & 1
        trust = self.trust.copy()
        trust[list(without)] = 0
        fired = np.log(self.rates[1] / self.rates[0]) * trust
        silent = np.log((1 - self.rates[1]) / (1 - self.rates[0])) * trust
        return 1 / (1 + np.exp(-np.clip(math.log(self.prior / (1 - self.prior)) + v @ fired + (1 - v) @ silent, -50, 50)))


def label_model(patterns: np.ndarray, counts: np.ndarray, prior: float | None = None) -> LabelModel:
    """Fit to counts of vote patterns.  ``prior`` fixes the share of the toxic class, if known."""
    v = ((patterns[:, None] >> np.arange(len(VOTERS))) & 1).astype(float)
    weight = counts.astype(float)
    model = LabelModel(prior or 0.1, np.zeros((2, len(VOTERS))), np.eye(len(VOTERS)), np.ones(len(VOTERS)))
    p = np.select([v[:, :-1].sum(1) > 1, v[:, :-1].sum(1) == 1], [0.9, 0.3], 0.02)
    for _ in range(TURNS):
        for _ in range(ROUNDS):
            for y, q in enumerate((1 - p, p)):
                w = weight * q
                model.rates[y] = (w @ v + 0.01) / (w.sum() + 1.0)
            model.rates[1] = np.maximum(model.rates[1], model.rates[0])  # a voter never speaks for the clean class
            if prior is None:
                model.prior = min(0.5, max(1e-4, float((weight * p).sum() / weight.sum())))
            p = model.posterior(patterns)
        # What two voters share beyond the class, as all the others tell it.
        for i in range(len(VOTERS)):
            for j in range(i):
                q = model.posterior(patterns, (i, j))
                rates = [(weight * c) @ v[:, [i, j]] / max((weight * c).sum(), 1e-9) for c in (1 - q, q)]
                shared = sum((weight * c)[:, None, None] * (v[:, [i, j], None] - r[:, None]) * (v[:, None, [i, j]] - r) for c, r in zip((1 - q, q), rates)).sum(0)
                model.correlations[i, j] = model.correlations[j, i] = shared[0, 1] / math.sqrt(max(shared[0, 0] * shared[1, 1], 1e-9))
        tied = np.where(np.abs(model.correlations) >= TIED, np.abs(model.correlations), 0)
        np.fill_diagonal(tied, 0)
        model.trust = 1 / (1 + tied.sum(1))
        p = model.posterior(patterns)
    return model


def logistic(x: np.ndarray, p: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights of a linear classifier on soft labels, by Newton steps; the last one is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = ridge * np.diag([*[1.0] * (x.shape[1] - 1), 0.0])
    for _ in range(25):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + penalty + 1e-8 * np.eye(len(w)), x.T @ (p - q) - penalty @ w)
        w += step * min(1.0, 5 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(found: DataFrame, labels: DataFrame) -> tuple[LabelModel, np.ndarray]:
    """Label model and classifier weights, from files outside the held-out fold.

    Labels (path, label 0 or 1) here only tell the share of the toxic class; without any,
    the label model estimates it.  To the driver come vote-pattern counts and SAMPLE rows.
    """
    train = found.where(fold("path", FOLDS) != HELD_OUT)
    told = labels.where(fold("path", FOLDS) != HELD_OUT).agg(F.avg(F.col("label").cast("double"))).first()[0]
    seen = train.groupBy("votes").count().collect()
    if not seen:
        return LabelModel(0.1, np.full((2, len(VOTERS)), 0.5), np.eye(len(VOTERS)), np.ones(len(VOTERS))), np.zeros(len(FEATURES) + 1)
    model = label_model(np.array([r["votes"] for r in seen]), np.array([r["count"] for r in seen]), None if told is None else min(0.9, max(1e-3, told)))
    rows = train.orderBy(F.xxhash64("path"), "path").select("votes", "features").limit(SAMPLE).toArrow()
    x = np.array(rows.column("features").to_pylist(), float)
    return model, logistic(x, model.posterior(rows.column("votes").to_numpy()))


def rate(files: DataFrame, labels: DataFrame) -> DataFrame:
    """(path, held_out, score) per file: mining, votes, fit, chance of toxicity from 0 to 1.

    One row per input row; repeated and null paths keep their rows (a null path belongs to
    the held-out fold).  Empty and null contents are scored like any other.  Other columns
    are not read.  Of an empty table nothing is learned and nothing returned.
    """
    found = cut(signals(files, mine(files, labels)))
    _, weights = fit(found, labels)

    def run(batches):
        for batch in slices(batches, 4096):
            x = np.array(batch.column("features").to_pylist(), float).reshape(batch.num_rows, len(FEATURES))
            s = 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -50, 50)))
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(s)], ["path", "score"])

    out = found.select("path", "features").mapInArrow(run, f"path {key_type(files)}, score double")
    return out.select("path", (fold("path", FOLDS) == HELD_OUT).alias("held_out"), "score")
