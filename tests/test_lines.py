import random
import re
import time

import pytest

from packaudit.functions import fixed, lines
from packaudit.operators import manifest, other_code, python_code

PATTERNS = ["(?i)" + fixed.JS_PROCESS, fixed.QUOTED_BLOB, "(?i)" + fixed.UNLISTED_URL, *(p for p, _ in fixed.EMBEDDED_CODE)]


def made(rng):
    parts = ["exec(", "spawn \n(", "child_process.", "eval (", "os.system\n(", "subprocess.", "requests.get(", "'" + "QUJD" * 21 + "\n" + "REVG" * 4 + "'", "https://files.badhost.org/payload/abc", "\n", "\n\n", " ", "x", "é🎉", "\r\n", "\x01"]
    return "".join(rng.choice(parts) for _ in range(rng.randint(0, 60)))


def test_lines_equal_the_plain_count(spark, make_files):
    rng = random.Random(5)
    texts = {f"f{i}.js": made(rng) for i in range(120)} | {"none.js": "", "end.js": "eval(", "start.js": "\n\neval(\n"}
    files = make_files({"p": texts})
    for pattern in PATTERNS:
        got = sorted((r.path, r.pos, r.m, r.line) for r in lines.match_lines(files, ["skill_id", "path"], pattern, 0).collect())
        want = [(path, i, m[0], text.count("\n", 0, m.start()) + 1) for path, text in texts.items() for i, m in enumerate(re.finditer(pattern, text))]
        assert got == sorted(want), pattern
    assert lines.match_lines(files.limit(0), ["skill_id", "path"], PATTERNS[0]).count() == 0


def test_extractors_use_them(spark, make_files):
    rng = random.Random(6)
    texts = {f"f{i}.js": made(rng) for i in range(40)}
    calls = other_code.js_io(make_files({"p": texts})).filter("subtype = 'subprocess'").collect()
    want = [(p, t.count("\n", 0, m.start()) + 1) for p, t in texts.items() for m in re.finditer("(?i)" + fixed.JS_PROCESS, t)]
    assert sorted((r.path, r.line) for r in calls) == sorted(want)
    notes = {p.replace(".js", ".md"): t for p, t in texts.items()}
    ops = python_code.embedded_ops(make_files({"p": notes})).collect()
    want = [(p, t.count("\n", 0, m.start()) + 1, label) for p, t in notes.items() for e, label in fixed.EMBEDDED_CODE for m in re.finditer(e, t)]
    assert sorted((r.path, r.line, r.label) for r in ops) == sorted(want)
    urls = manifest.audit_embedded({"files": make_files({"p": notes})}).filter("severity = 'MEDIUM'").collect()
    want = [(p, t.count("\n", 0, m.start()) + 1) for p, t in notes.items() for m in re.finditer("(?i)" + fixed.UNLISTED_URL, t)]
    assert sorted((r.path, r.line) for r in urls) == sorted(want)


@pytest.mark.parametrize("gap", ["; ", "\n"])
def test_many_matches_take_linear_time(spark, make_files, gap):
    """Five megabytes with 100,000 matches, on one line and on as many."""
    text = gap.join(["a = exec(" + "b" * 40] * 100_000)
    files = make_files({"p": {"one.js": text}}).cache()
    files.count()
    start = time.perf_counter()
    r = other_code.js_io(files).selectExpr("count(*) n", "max(line) last").first()
    assert (r.n, r["last"]) == (100_000, 1 if gap == "; " else 100_000) and time.perf_counter() - start < 60
