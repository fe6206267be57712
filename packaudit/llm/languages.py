"""Language of texts by a linear-chain conditional random field over their words.

Each word of a text gets a label; forward-backward gives the chance of every language at
every word, so a text that switches languages is followed word by word, and its own language
is the one expected most often.  Affixes, character n-grams and word lists score a word,
learned transitions score a switch.  Fitting takes a bounded sample of labelled files, chosen
by a hash after one count per language; applying is a plain Arrow task over the corpus in
which scores of words are remembered and all texts of a chunk step together.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packaudit.functions.tables import first_rows
from packaudit.llm.common import CACHE_WORDS, fold, key_type, slices, texts

FOLDS, HELD_OUT = 4, 2
SAMPLE = 240  # files per language that the field is fitted to
SIZE = 1 << 15  # of the hashed feature space
STRETCH, BATCH, EPOCHS, RATE = 24, 192, 3, 0.25  # words of a training sequence, sequences of a step
SWITCH = 0.25  # share of training sequences that change language half-way
LEXICON = 400  # words of each language's list
CHUNK_WORDS = 1_500_000  # words that step together in a task
UNKNOWN = "und"

LETTERS = 40  # a longer run of letters is a chain of words of so many, so all of it counts
_WORD = re.compile(rf"[^\W\d_]{{1,{LETTERS}}}")


def features(word: str, lexicons: dict[str, int]) -> list[int]:
    """Hashed features of a lower-case word: affixes, n-grams, whole word, lists it is on."""
    b, n = f"^{word}$", len(word) + 2
    keys = [f"p{b[:k]}" for k in (2, 3, 4)] + [f"s{b[-k:]}" for k in (2, 3, 4)] + [b[i:i + 3] for i in range(n - 2)] + [f"c{c}" for c in set(word) if c > "\x7f"]
    if n <= 12:
        keys.append(f"w{b}")
    out = [zlib.crc32(k.encode()) % SIZE for k in keys]
    lists = lexicons.get(word, 0)
    return out if not lists else out + [SIZE + i for i in range(lists.bit_length()) if lists >> i & 1]


@dataclass
class Field:
    labels: list[str]
    weights: np.ndarray  # features by labels
    moves: np.ndarray  # log scores from label to label
    lexicons: dict[str, int]  # word -> bits of the languages whose list holds it

    def scores(self, words: list[str]) -> np.ndarray:
        """A row of label scores per word."""
        ids = [features(w, self.lexicons) for w in words]
        at = np.cumsum([0, *(len(i) for i in ids[:-1])])
        flat = np.fromiter((x for i in ids for x in i), np.int64)
        return np.add.reduceat(self.weights[flat], at, axis=0).astype(np.float32) if words else np.zeros((0, len(self.labels)), np.float32)


def forward_backward(emit: np.ndarray, active: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Expected labels of many texts at once.

    ``emit`` holds positive scores with all first words, then all second words, ...; of the
    ``active[t]`` texts still running at word t, the longest comes first.  Returns the
    marginals in the same layout.
    """
    at = np.concatenate([[0], np.cumsum(active)])
    alpha = np.empty_like(emit)
    for t, n in enumerate(active):
        a = emit[at[t]:at[t + 1]]
        if t:
            a = a * (alpha[at[t - 1]:at[t - 1] + n] @ move)
        alpha[at[t]:at[t + 1]] = a / a.sum(1, keepdims=True)
    beta = np.ones((0, emit.shape[1]), emit.dtype)
    for t in range(len(active) - 1, -1, -1):
        own = np.ones((active[t], emit.shape[1]), emit.dtype)
        if len(beta):
            own[:len(beta)] = (beta * emit[at[t + 1]:at[t + 2]]) @ move.T
            own[:len(beta)] /= own[:len(beta)].sum(1, keepdims=True)
        g = alpha[at[t]:at[t + 1]] * own
        alpha[at[t]:at[t + 1]] = g / g.sum(1, keepdims=True)
        beta = own
    return alpha


def train(samples: list[tuple[str, str]]) -> Field:
    """Fit to (content, language) pairs by stochastic ascent of the conditional likelihood."""
    labels = sorted({lang for _, lang in samples})
    k, rng = len(labels), np.random.default_rng(11)
    words: dict[str, int] = {}
    runs: list[list[np.ndarray]] = [[] for _ in labels]
    counts = [np.zeros(0, np.int64) for _ in labels]
    for content, lang in samples:
        y = labels.index(lang)
        ids = np.array([words.setdefault(w, len(words)) for w in _WORD.findall(content.lower())], np.int64)
        counts[y] = np.add(*(np.pad(c, (0, len(words) - len(c))) for c in (counts[y], np.bincount(ids, minlength=len(words)))))
        runs[y] += [ids[i:i + STRETCH] for i in range(0, len(ids) - STRETCH + 1, STRETCH)] or ([ids] if len(ids) else [])
    names, lexicons = list(words), {}
    for y, c in enumerate(counts):
        for i in np.argsort(-c, kind="stable")[:LEXICON]:
            if c[i] > 1:
                lexicons[names[i]] = lexicons.get(names[i], 0) | 1 << y
    field = Field(labels, np.zeros((SIZE + k, k)), np.zeros((k, k)), lexicons)
    if k < 2 or not names:
        return field
    ids = [features(w, lexicons) for w in names]
    width = max(map(len, ids))
    table = np.full((len(ids), width), SIZE + k, np.int64)  # the last row stays zero
    for row, i in zip(table, ids):
        row[:len(i)] = i
    weights, squares = np.zeros((SIZE + k + 1, k)), np.full((SIZE + k + 1, k), 1e-6)
    moves, move_squares = 2 * np.eye(k), np.full((k, k), 1e-6)
    share = max(len(r) for r in runs)
    for _ in range(EPOCHS):
        # Languages with fewer runs are drawn again, so that no prior of the sample is learned.
        order = [(y, int(i)) for y, r in enumerate(runs) if r for i in rng.integers(0, len(r), min(share, 4000))]
        rng.shuffle(order)
        for s in range(0, len(order), BATCH):
            seqs, gold = [], []
            for y, i in order[s:s + BATCH]:
                a, ya = runs[y][i], np.full(len(runs[y][i]), y)
                if rng.random() < SWITCH:
                    z = int(rng.integers(0, k))
                    if runs[z]:
                        b = runs[z][int(rng.integers(0, len(runs[z])))]
                        cut = int(rng.integers(1, STRETCH))
                        a, ya = np.concatenate([a[:cut], b[cut:]]), np.concatenate([np.full(len(a[:cut]), y), np.full(len(b[cut:]), z)])
                if len(a):
                    seqs.append(a)
                    gold.append(ya)
            rank = sorted(range(len(seqs)), key=lambda i: -len(seqs[i]))
            sizes = np.array([len(seqs[i]) for i in rank])
            active = np.array([(sizes > t).sum() for t in range(sizes[0])])
            flat = np.concatenate([[seqs[i][t] for i in rank[:n]] for t, n in enumerate(active)]).astype(np.int64)
            y = np.concatenate([[gold[i][t] for i in rank[:n]] for t, n in enumerate(active)]).astype(np.int64)
            rows = table[flat]
            e = weights[rows].sum(1)
            emit, move = np.exp(e - e.max(1, keepdims=True)) + 1e-12, np.exp(moves)
            at = np.concatenate([[0], np.cumsum(active)])
            alpha, beta = np.empty_like(emit), np.ones_like(emit)
            for t, n in enumerate(active):
                a = emit[at[t]:at[t + 1]] * (1 if t == 0 else alpha[at[t - 1]:at[t - 1] + n] @ move)
                alpha[at[t]:at[t + 1]] = a / a.sum(1, keepdims=True)
            step = np.zeros((k, k))
            for t in range(len(active) - 1, 0, -1):
                n = active[t]
                later = beta[at[t]:at[t + 1]] * emit[at[t]:at[t + 1]]
                b = later @ move.T
                beta[at[t - 1]:at[t - 1] + n] = b / b.sum(1, keepdims=True)
                pair = alpha[at[t - 1]:at[t - 1] + n, :, None] * move * later[:, None, :]
                step -= (pair / pair.sum((1, 2), keepdims=True)).sum(0)
                np.add.at(step, (y[at[t - 1]:at[t - 1] + n], y[at[t]:at[t + 1]]), 1)
            g = alpha * beta
            g /= g.sum(1, keepdims=True)
            g = np.eye(k)[y] - g
            cells = rows.ravel()
            for j in range(k):
                d = np.bincount(cells, np.repeat(g[:, j], width), SIZE + k + 1) / len(seqs)
                squares[:, j] += d * d
                weights[:, j] += RATE * d / np.sqrt(squares[:, j])
            weights[-1] = 0
            step /= len(seqs)
            move_squares += step * step
            moves += RATE * step / np.sqrt(move_squares)
    field.weights, field.moves = weights[:-1], moves
    return field


def fit(files: DataFrame) -> Field:
    """Fit to files (path, content, lang) outside the held-out fold that have both text and language.

    At most SAMPLE files per language reach the driver: a count per language sets the hash
    threshold below which about twice as many are drawn, whatever the size of the corpus.
    """
    known = files.select("path", "content", "lang").where((fold("path", FOLDS) != HELD_OUT) & F.col("lang").isNotNull() & F.col("content").isNotNull())
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not sizes:
        return Field([], np.zeros((SIZE, 0)), np.zeros((0, 0)), {})
    wanted = F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, (2 * SAMPLE + 50) / n))))
    draw = (F.xxhash64(F.lit(3), "path") / F.lit(2.0 ** 64)) + 0.5
    drawn = known.withColumn("_draw", draw).where(F.col("_draw") <= F.element_at(wanted, F.col("lang")))
    rows = first_rows(drawn, ["lang"], [F.col("_draw"), F.col("path")], SAMPLE).orderBy("lang", "_draw", "path").select("content", "lang").collect()
    return train([(r["content"], r["lang"]) for r in rows])


def label(files: DataFrame, field: Field) -> DataFrame:
    """(path, lang_pred, score) per file from every word of its whole content.

    ``score`` is the expected share of the text's words in that language.  ``und`` with score 0
    where the content is null or has no letter, or nothing was learned.  One row per input row.
    """

    def run(batches):
        move = np.exp(field.moves).astype(np.float32)
        rows: dict[str, int] = {}
        table = np.zeros((0, len(field.labels)), np.float32)
        for batch in slices(batches, 8192):
            found = [_WORD.findall(t.lower()) for t in texts(batch)]
            found = [w if any(map(str.isalpha, w)) and field.labels else [] for w in found]
            pred, score = [UNKNOWN] * len(found), np.zeros(len(found))
            order = sorted((i for i, w in enumerate(found) if w), key=lambda i: -len(found[i]))
            while order:
                size, n = 0, 0
                while n < len(order) and (n == 0 or size + len(found[order[n]]) <= CHUNK_WORDS):
                    size += len(found[order[n]])
                    n += 1
                chunk, order = order[:n], order[n:]
                if len(rows) > CACHE_WORDS:
                    rows, table = {}, table[:0]
                new = list(set().union(*(found[i] for i in chunk)).difference(rows))
                rows.update(zip(new, range(len(rows), len(rows) + len(new))))
                e = field.scores(new)
                table = np.vstack([table, np.exp(e - e.max(1, keepdims=True)) + 1e-9]) if new else table
                sizes = np.array([len(found[i]) for i in chunk])
                active = len(sizes) - np.searchsorted(sizes[::-1], np.arange(sizes[0]), "right")
                at = np.concatenate([[0], np.cumsum(active)])
                flat, owner = np.empty(at[-1], np.int64), np.empty(at[-1], np.int64)
                for rank, i in enumerate(chunk):
                    cells = at[:sizes[rank]] + rank
                    flat[cells] = list(map(rows.__getitem__, found[i]))
                    owner[cells] = rank
                g = forward_backward(table[flat], active, move)
                share = np.column_stack([np.bincount(owner, g[:, j], len(chunk)) for j in range(len(field.labels))]) / sizes[:, None]
                for i, best, s in zip(chunk, share.argmax(1), share.max(1)):
                    pred[i], score[i] = field.labels[best], min(1.0, s)
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(pred, pa.string()), pa.array(score)], ["path", "lang_pred", "score"])

    return files.select("path", "content").mapInArrow(run, f"path {key_type(files)}, lang_pred string, score double")


def identify(files: DataFrame) -> DataFrame:
    """(path, held_out, lang_pred, score) per file (path, content, lang): fit, then label all.

    Repeated and null paths keep their rows (a null path is never held out).  Columns other
    than those three are not read, ``lang`` only for fitting.  An empty table gives no rows.
    """
    out = label(files, fit(files))
    return out.select("path", (fold("path", FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score")
