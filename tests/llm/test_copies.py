"""Near copies, passages, sketches and links against brute force."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from packaudit.llm import passages, simhash, sketches, vectors
from packaudit.llm.common import components


def roots(nodes, links):
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(1000 + i, 1001 + i) for i in range(70)] + [(2000, 2001 + i) for i in range(80)] + [(None, 5), (7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    real = [(a, b) for a, b in links if a is not None and a != b]
    assert got == roots({n for e in real for n in e}, real)
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0


def brute_print(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i:i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near_texts(prose):
    texts = {}
    for i in range(40):
        words = prose(i % 8, 120).split()
        if i >= 8:
            words[(7 * i) % 120] = "changed"
        texts[f"p/{i:03}.md"] = " ".join(words)
    return texts


def test_simhash_classes(package_files, prose, hard_rows):
    texts = near_texts(prose)
    rows = [*hard_rows, *texts.items(), ("a/copy.md", texts["p/000.md"].upper()), ("a/short.md", "Two words")]
    got = simhash.classes(package_files(rows)).collect()
    prints = {(p, brute_print(c)) for p, c in rows}
    assert {(r["path"], r["fingerprint"] % (1 << 64)) for r in got} == prints and len(got) == len(rows)
    f = sorted({x for _, x in prints})
    top = roots(f, [(a, b) for i, a in enumerate(f) for b in f[:i] if (a ^ b).bit_count() <= 4])
    least = {}
    for p, x in prints:
        if p is not None:
            least[top[x]] = min(p, least.get(top[x], p))
    assert all(r["component"] == least.get(top[r["fingerprint"] % (1 << 64)]) for r in got)
    kept = simhash.keep_one(package_files(rows))
    assert {r["path"] for r in kept.collect()} == {None, *least.values()} and kept.columns == package_files(rows).columns
    assert simhash.classes(package_files(rows).limit(0)).count() == 0


def test_spark_hash_is_the_fingerprints_hash(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("a b c d"))).first()[0] % (1 << 64) == xxhash.xxh64_intdigest("a b c d", 42)


@pytest.mark.parametrize("limit", [4096, 3, 0])
def test_links_join_the_same_whether_buckets_are_crowded(spark, monkeypatch, limit):
    monkeypatch.setattr(simhash, "CROWDED", limit)
    rng, f = random.Random(limit), set()
    for _ in range(6):
        base = rng.getrandbits(64)
        for _ in range(12):
            x = base
            for _ in range(rng.randint(0, 5)):
                x ^= 1 << rng.randrange(64)
            f.add(x)
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in f]
    got = components(simhash.links(spark.createDataFrame(signed, "f long")))
    top = roots(f, [(a, b) for a in f for b in f if a < b and (a ^ b).bit_count() <= 4])
    size = {}
    for x in f:
        size.setdefault(top[x], set()).add(x)
    found = {}
    for r in got.collect():
        found.setdefault(r["root"], set()).add(r["node"] % (1 << 64))
    assert {frozenset(s) for s in size.values() if len(s) > 1} == {frozenset(s) for s in found.values()}


def brute_passages(rows, window):
    first, out = {}, []
    real = sorted((r for r in rows if r[0] is not None), key=lambda r: r[0])
    for path, text in real:
        w = (text or "").encode().split()
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i:i + window]), path)
    for path, text in rows:
        w = (text or "").encode().split()
        gone = set()
        for i in range(len(w) - window + 1) if path is not None else ():
            if first[tuple(w[i:i + window])] < path:
                gone.update(range(i, i + window))
        out.append((path or "", len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(out)


@pytest.mark.parametrize("window", [50, 7, 2])
def test_passages(package_files, prose, hard_rows, window):
    shared = [prose(900 + i, 40 + 15 * i) for i in range(4)]
    rng, rows = random.Random(window), list(hard_rows)
    for i in range(60):
        parts = [prose(i, rng.randint(0, 60))] + [rng.choice([shared[rng.randrange(4)], prose(2000 + i * 9 + j, rng.randint(1, 40))]) for j in range(3)]
        rows.append((f"s/{i:03}.md", "\n".join(parts)))
    rows += [("s/900.md", rows[-1][1]), ("a/000.md", rows[-2][1]), ("s/loop.md", "la " * 200), ("s/loop2.md", "la " * 120 + "end"), ("t/long.md", rows[6][1] + " tail")]
    files = package_files(rows)
    got = sorted((r["path"] or "", r["n_words"], r["n_removed"], r["content"]) for r in passages.dedupe(files, window).collect())
    assert got == brute_passages(rows, window)
    assert passages.dedupe(files.limit(0), window).count() == 0


def test_passages_of_rows_that_share_a_path(package_files, prose):
    """Each row is judged by its own text, whatever other rows have its path."""
    long = prose(31, 2000)
    for rows in ([(1, long), (2, "head " + long), (2, prose(32, 10))], [(1, long), (2, long), (2, prose(33, 120))],
                 [(1, long), (2, prose(34, 60) + " " + long[:900]), (2, long[300:2000]), (2, prose(35, 70)), (None, long), (2, None), (3, prose(35, 70))]):
        rows = [(p and f"p/{p}", t) for p, t in rows]
        got = sorted((r["path"] or "", r["n_words"], r["n_removed"], r["content"]) for r in passages.dedupe(package_files(rows), 50).collect())
        assert got == brute_passages(rows, 50)


def test_smallest_windows():
    rng = np.random.default_rng(1)
    for n, width in [(0, 3), (2, 3), (3, 3), (50, 7), (40, 1), (33, 26)]:
        h = rng.integers(0, 9, n).astype(np.uint64)
        want = {i + int(h[i:i + width].argmin()) for i in range(n - width + 1)}
        got = set(passages.smallest(h, width).tolist())
        assert got == want


def test_sketches(package_files, prose, hard_rows):
    rows = [*hard_rows, *((f"s/{i:03}.md", prose(i, 20 + 11 * i)) for i in range(40))]
    files = package_files(rows)
    got = sketches.with_neighbours(files).collect()
    order = sorted(((p, c or "") for p, c in rows), key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    want = []
    for i, (p, text) in enumerate(order):
        nxt = order[(i + 1) % len(order)][1]
        cut = len(text) // 4
        want.append((p or "", len(text), hashlib.sha256((text[:len(text) - cut] + nxt[:cut]).encode()).hexdigest()))
    assert sorted((r["path"] or "", r["n_chars"], r["edited_sha256"]) for r in got) == sorted(want)
    prints = {r["path"]: r["fingerprint"] for r in sketches.fingerprints(files).collect()}
    assert all(prints[r["path"]] == r["fingerprint"] for r in got)
    long = [r for r in got if r["n_chars"] > 1500 and r["path"].startswith("s/")]
    assert all(r["near_edited"] > 0.5 and r["near_next"] < 0.1 for r in long)
    one = sketches.with_neighbours(package_files({"a/b.md": "x y z"})).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert sketches.with_neighbours(files.limit(0)).count() == 0


def plain_sketch(text, words):
    """Distinct shingle hashes below the limit, one by one in Python integers."""
    found, mask = text.encode().lower().split(), (1 << 64) - 1
    if not found:
        return set()
    out = set()
    width = min(len(found), sketches.SHINGLE)
    for i in range(len(found) - width + 1):
        x = width
        for k in range(width):
            x = (x + words[found[i + k]] * int(sketches._MIX[k])) & mask
            x ^= x >> 29
            x = x * 0xBF58476D1CE4E5B9 & mask
        out.add((x ^ x >> 32) >> 64 - sketches.BITS)
    limit = (1 << sketches.BITS) // sketches.KEPT
    return {x for x in out if x < limit} or {min(out)}


def test_sketches_against_plain_code(package_files, prose, hard_rows):
    from packaudit.llm.common import word_hashes

    words = word_hashes()
    rows = [*hard_rows, *((f"w/{n}", prose(n, n)) for n in (1, 4, 5, 6, 30, 700)), ("w/case", "One two THREE four five Six"), ("w/same", "la " * 60)]
    got = {(r["path"], r["fingerprint"]) for r in sketches.fingerprints(package_files(rows)).collect()}
    assert got == {(p, "".join(f"{x:010x}" for x in sorted(plain_sketch(c or "", words)))) for p, c in rows}


@pytest.mark.parametrize("n", [8, 12, 20, 40, 100, 400])
def test_sketch_error_by_length(prose, n):
    """Estimated against true containment of edited texts, from eight words on."""
    from packaudit.llm.common import word_hashes

    words, off = word_hashes(), []
    for i in range(200):
        text, other = prose(i, n), prose(9000 + i, n)
        cut = len(text) // 4
        edited = text[:len(text) - cut] + other[:cut]
        a, b = ({tuple(t.split()[k:k + 5]) for k in range(max(1, len(t.split()) - 4))} for t in (text, edited))
        off.append(sketches.likeness(sketches.sketch(text, words), sketches.sketch(edited, words)) - len(a & b) / min(len(a), len(b)))
    allowed = {8: 0.42, 12: 0.3, 20: 0.2, 40: 0.13, 100: 0.08, 400: 0.04}[n]
    assert abs(float(np.mean(off))) < 0.07 and float(np.sqrt(np.mean(np.square(off)))) < allowed, (np.mean(off), np.sqrt(np.mean(np.square(off))))


def test_sketches_estimate_containment(prose):
    from packaudit.llm.common import word_hashes

    words = word_hashes()
    small, rest = prose(1, 3000), prose(2, 30_000)
    a, b = sketches.sketch(small, words), sketches.sketch(small + " " + rest, words)
    assert sketches.likeness(a, b) > 0.98
    half = sketches.sketch(" ".join(small.split()[:1500]) + " " + prose(3, 1500), words)
    assert abs(sketches.likeness(a, half) - 0.5) < 0.08
    merged = sketches.merge(a, sketches.sketch(rest, words))
    assert len(np.setdiff1d(b, merged)) <= 4 and set(merged) <= set(b)
    assert sketches.likeness(sketches.sketch("", words), a) == 0 and len(sketches.sketch("one two", words)) == 1


def brute_links(rows, threshold):
    ok = [(i, np.array(e, float)) for i, e in rows if e and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    units = [(i, e / np.linalg.norm(e / np.abs(e).max()) / np.abs(e).max()) for i, e in ok]
    return [(a, b) for k, (a, x) in enumerate(units) for b, y in units[:k] if len(x) == len(y) and x @ y >= threshold]


@pytest.mark.parametrize("small", [False, True])
def test_vectors(spark, monkeypatch, small):
    if small:  # many shards, clusters cut into blocks
        for name, value in (("CLUSTER", 60), ("BLOCK", 40), ("CENTRES", 4)):
            monkeypatch.setattr(vectors, name, value)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 16))
    x[100:160] = x[100] + 0.1 * rng.normal(size=(60, 16))
    x[200:204] = x[0] * 3
    x[204:230] = x[1] + 0.2 * rng.normal(size=(26, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] * 16), (904, [None] + [1.0] * 15), (905, [1.0, 0.0]), (906, [2.0, 0.0]), (907, x[0].tolist()), (908, (x[0] * 1e-200).tolist()), (None, x[5].tolist())]
    table = spark.createDataFrame([(i, e, "taken") for i, e in rows], "vec_id long, embedding array<double>, component string")
    got = vectors.links(table)
    out = got.collect()
    links = brute_links([r for r in rows if r[0] is not None], vectors.COSINE)
    degree = {i: 0 for i, _ in rows if i is not None}
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    degree[5] += 1  # its copy without a key
    found = {r["vec_id"]: r["n_links"] for r in out}
    assert len(out) == len(rows) and found[None] == 1
    assert all(found[i] <= n for i, n in degree.items())
    assert sum(found[i] for i in degree) >= 0.97 * sum(degree.values())
    top = roots(degree, links)
    assert sum(r["component"] == top[r["vec_id"]] for r in out if r["vec_id"] is not None) >= 0.97 * len(degree)
    assert all(r["kept"] == (r["component"] == r["vec_id"]) for r in out)
    assert vectors.recall(table.where("vec_id < 900"), got.where("vec_id < 900"), 4) >= 0.9
    assert vectors.links(table.limit(0)).count() == 0


def test_vectors_without_structure(spark, monkeypatch):
    """Centres fitted to few of the vectors part many links; the job sees it and deals wider."""
    for name, value in (("CLUSTER", 24), ("SAMPLE", 200), ("OVERLAP", 1)):
        monkeypatch.setattr(vectors, name, value)
    rng = np.random.default_rng(11)
    x = rng.normal(size=(1200, 64))
    y = x + 0.46 * rng.normal(size=x.shape)  # cosine about 0.91
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate([*x, *y])], "vec_id long, embedding array<double>")
    unit = np.vstack([x, y])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    true = (unit @ unit.T >= vectors.COSINE).sum(1) - 1
    found = {r["vec_id"]: r["n_links"] for r in vectors.links(table).collect()}
    assert true.sum() > 300 and all(found[i] <= n for i, n in enumerate(true))
    assert sum(found.values()) / true.sum() >= 0.9


@pytest.mark.parametrize("split", [120, 1575])
def test_second_level_of_centres(spark, monkeypatch, split):
    """Few first-level clusters, all too large: leaves keep shards small and find nearly all links,
    and a crowd that no centre parts falls into blocks."""
    for name, value in (("CENTRES", 4), ("CLUSTER", 40), ("BLOCK", 120), ("SPLIT", split), ("INNER", 300)):
        monkeypatch.setattr(vectors, name, value)
    rng = np.random.default_rng(13)
    x = rng.normal(size=(900, 24))
    y = x + 0.25 * rng.normal(size=x.shape)
    crowd = rng.normal(size=24) + 0.05 * rng.normal(size=(300, 24))
    every = np.vstack([x, y, crowd])
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(every)], "vec_id long, embedding array<double>")
    shards, walk = [], vectors.deal
    monkeypatch.setattr(vectors, "deal", lambda *a: shards.append(walk(*a)) or shards[-1])
    out = vectors.links(table).collect()
    members, queries = shards[-1]
    sizes = [r["count"] for r in members.groupBy("shard").count().collect()]
    assert len(sizes) > 20 and max(sizes) <= 3 * 120
    homes = {r["n"] for r in members.selectExpr("size(homes) n").distinct().collect()}
    assert split == 120 or len(homes) > 1  # some clusters are split, some are not
    per = queries.groupBy("rep").count().agg({"count": "avg"}).first()[0]
    assert per < 40  # shards that a query visits
    unit = every / np.linalg.norm(every, axis=1, keepdims=True)
    true = (unit @ unit.T >= vectors.COSINE).sum(1) - 1
    found = {r["vec_id"]: r["n_links"] for r in out}
    assert all(found[i] <= n for i, n in enumerate(true)) and sum(found.values()) >= 0.9 * true.sum()
    assert {r["audited_recall"] for r in out} <= {min(r["audited_recall"] for r in out)} and out[0]["audited_recall"] >= 0.9


def test_wider_until_the_audit_is_met(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CLUSTER", 8)
    rng = np.random.default_rng(12)
    x = rng.normal(size=(60, 16))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate([*x, *(x + 0.05 * rng.normal(size=x.shape))])], "vec_id long, embedding array<double>")
    tried, shares, walks = [], iter([{16: 0.5}, {16: 0.89}, {16: 0.95}]), vectors.walks
    monkeypatch.setattr(vectors, "audited", lambda *a: next(shares))
    monkeypatch.setattr(vectors, "walks", lambda p, f, overlap, t: tried.append(overlap[16]) or walks(p, f, overlap, t))
    assert {r["n_links"] for r in vectors.links(table).collect()} == {1}
    assert tried == [3, 6, 12]
