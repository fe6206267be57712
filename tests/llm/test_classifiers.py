import random
import zlib

import numpy as np
import pytest

from packaudit.llm import languages, quality, toxicity


def labelled(spark, rows):
    return spark.createDataFrame(rows, "path string, label int")


@pytest.fixture(scope="module")
def rated(package_files, prose):
    texts, labels = {}, []
    for i in range(500):
        path, text = f"pkg{i % 7}/f{i}.md", prose(i, 40 + i % 90)
        bad = i % 4 == 0
        texts[path] = "\n".join(w + "###" for w in text.split()) if bad else text.capitalize() + "."
        labels.append((path, 0 if bad else 1))
    return package_files(texts), labels


def test_quality_held_out(spark, rated):
    files, labels = rated
    want = dict(labels)
    rows = quality.rate(files, labelled(spark, labels)).collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == 500 and 60 < len(held) < 140
    assert all(r["held_out"] == (zlib.crc32(r["path"].encode()) % 5 == 0) for r in rows)
    assert np.mean([(r["score"] >= 0.5) == want[r["path"]] for r in held]) > 0.95
    kept = quality.accept(files, labelled(spark, labels))
    assert kept.columns == files.columns
    assert {r["path"] for r in kept.collect()} == {r["path"] for r in rows if r["score"] >= 0.3}


def test_quality_never_sees_held_out_labels(spark, rated):
    files, labels = rated
    flipped = [(p, 1 - y if zlib.crc32(p.encode()) % 5 == 0 else y) for p, y in labels]
    a, b = ({(r["path"], round(r["score"], 9)) for r in quality.rate(files, labelled(spark, x)).collect()} for x in (labels, flipped))
    assert a == b


def test_normal_equations_equal_one_machine(spark, rated):
    files, labels = rated
    stats = quality.statistics(files)
    model = quality.fit(stats, labelled(spark, labels))
    want = dict(labels)
    rows = [(np.array(r["stats"]), want[r["path"]]) for r in stats.collect() if zlib.crc32(r["path"].encode()) % 5 not in (0, 1)]
    x = model.features(np.array([s for s, _ in rows]))
    gram = x.T @ x + np.diag([*[quality.RIDGE] * quality.FEATURES, 1e-9 * quality.RIDGE]) + 1e-9 * np.eye(x.shape[1])
    assert np.allclose(model.weights, np.linalg.solve(gram, x.T @ np.array([y for _, y in rows])), atol=1e-6)


def test_isotonic_is_the_best_rising_fit():
    x, y = quality.isotonic(np.arange(6.0), np.array([0, 1, 0, 1, 1, 0.5]), np.array([1, 1, 1, 1, 1, 2.0]))
    assert list(np.round(y, 6)) == [0, 0.5, 0.75] and list(x) == [0, 1.5, 4.25]


@pytest.mark.parametrize("rate", [quality.rate, toxicity.rate])
def test_scores_on_hard_rows(spark, package_files, hard_rows, rate):
    files = package_files(hard_rows)
    for labels in ([], [("p/a.md", 1), ("p/empty.md", 0), ("q/one.md", None), (None, 1), ("nowhere", 0)]):
        rows = rate(files, labelled(spark, labels)).collect()
        assert len(rows) == len(hard_rows) and all(0 <= r["score"] <= 1 for r in rows)
        assert len({r["score"] for r in rows if r["path"] == "p/a.md"}) == 1
    assert rate(files.limit(0), labelled(spark, [])).count() == 0


def test_toxicity_catches_known_and_mined_words(spark, package_files, prose):
    rng, texts, labels = random.Random(2), {}, []
    insults = ["idiot", "moron", "worthless", "scum", "pathetic"]
    local = ["grumtak", "velsnor", "ottopiff", "brasnel"]  # words only labels can tell
    for i in range(900):
        words, bad = prose(1000 + i, 60).split(), i % 5 == 0
        if bad:
            for w in rng.sample(local if i % 2 else insults, 3):
                words.insert(rng.randrange(len(words)), w)
        path = f"pkg/f{i}.md"
        texts[path] = " ".join(words) + "."
        labels.append((path, int(bad)))
    files, want = package_files(texts), dict(labels)
    mined = toxicity.mine(files, labelled(spark, labels))
    assert set(local) <= set(mined)
    held = [r for r in toxicity.rate(files, labelled(spark, labels)).collect() if r["held_out"]]
    assert all((r["score"] >= 0.5) == want[r["path"]] for r in held)


def test_label_model_finds_accuracies_and_ties():
    rng = np.random.default_rng(0)
    y = rng.random(20_000) < 0.2
    n = len(toxicity.VOTERS)
    fire = np.zeros((len(y), n), bool)
    for j, (hit, false) in enumerate([(0.8, 0.02), (0.6, 0.01), (0.7, 0.05), (0.5, 0.03)]):
        fire[:, j] = rng.random(len(y)) < np.where(y, hit, false)
    fire[:, 4] = np.where(rng.random(len(y)) < 0.95, fire[:, 2], fire[:, 2] ^ True)  # nearly a copy of voter 2
    votes, counts = np.unique(fire @ (1 << np.arange(n)), return_counts=True)
    model = toxicity.label_model(votes, counts, 0.2)
    assert abs(model.rates[1, 0] - 0.8) < 0.1 and model.rates[0, 0] < 0.06
    assert model.correlations[2, 4] > 0.3 and model.trust[4] < model.trust[0]
    p = model.posterior(fire @ (1 << np.arange(n)))
    assert ((p > 0.5) == y).mean() > 0.93


def sentences(lang, seed, n):
    lists = {"en": "the of and with from thing making other house there", "de": "der die und mit von machen haus ander schön straße", "fr": "le la et avec dans faire maison autre très déjà"}
    rng = random.Random(f"{lang}{seed}")
    stems = lists[lang].split()
    return " ".join(rng.choice(stems) + rng.choice(["", "", {"en": "ing", "de": "ung", "fr": "eau"}[lang]]) for _ in range(n))


def test_languages(spark, package_files, hard_rows):
    rows = [(f"pkg/{lang}{i}.md", sentences(lang, i, 30 + i % 40), lang) for i in range(60) for lang in ("en", "de", "fr")]
    files = spark.createDataFrame([*rows, ("x/none.md", None, "en"), ("x/digits.md", "12 34 !", "de"), (None, "the house", None)], "path string, content string, lang string")
    got = {r["path"]: r for r in languages.identify(files).collect()}
    assert all(got[p]["lang_pred"] == lang for p, _, lang in rows)
    assert all(got[p]["held_out"] == (zlib.crc32(p.encode()) % 4 == 2) for p, _, _ in rows)
    assert got["x/none.md"]["lang_pred"] == got["x/digits.md"]["lang_pred"] == "und"
    field = languages.fit(files)
    mixed = package_files([*hard_rows, ("m/en-de.md", sentences("en", 99, 60) + " " + sentences("de", 99, 40))])
    out = {r["path"]: r for r in languages.label(mixed, field).collect()}
    assert out["m/en-de.md"]["lang_pred"] == "en" and 0.45 < out["m/en-de.md"]["score"] < 0.75
    assert out["p/empty.md"]["lang_pred"] == "und" and len(languages.label(mixed, field).collect()) == len(hard_rows) + 1
    nothing = languages.identify(files.withColumn("lang", files["lang"].substr(99, 1)).where("1 = 0"))
    assert nothing.count() == 0


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(3)
    k, lengths = 3, [4, 3, 1]
    move, emits = rng.random((k, k)) + 0.1, [rng.random((n, k)) + 0.1 for n in lengths]
    active = np.array([sum(n > t for n in lengths) for t in range(4)])
    flat = np.array([emits[i][t] for t, n in enumerate(active) for i in range(n)])
    got, at = languages.forward_backward(flat, active, move), np.concatenate([[0], np.cumsum(active)])
    for i, n in enumerate(lengths):
        want = np.zeros((n, k))
        for path in np.ndindex(*[k] * n):
            p = np.prod([emits[i][t, y] for t, y in enumerate(path)]) * np.prod([move[a, b] for a, b in zip(path, path[1:])])
            for t, y in enumerate(path):
                want[t, y] += p
        assert np.allclose([got[at[t] + i] for t in range(n)], want / want.sum(1, keepdims=True))


def test_long_runs_of_letters_count_whole():
    """A run of letters longer than a word of the chain is read to its end."""
    run = "a" * 40 + "schaft"
    assert languages._WORD.findall(run + " x" + "ность" * 20) == ["a" * 40, "schaft", "x" + ("ность" * 20)[:39], ("ность" * 20)[39:79], ("ность" * 20)[79:]]
    assert languages.features("schaft", {}) != languages.features("ность", {})
