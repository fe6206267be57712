import random
import re

import pytest

from packaudit.llm import private


def plain(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 16 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def test_plain_spans_equal_the_patterns():
    rng = random.Random(8)
    parts = ["a", "b.c", "@", ".", "x@y.z", "1", "12", "255", "256", ".", " ", "-", "+1 ", "(", ")", "4111 1111 1111 1111", "5500-0000-0000-0004", "_", "%", "+", "é", "\n", "10.0.0.1", "00"]
    for _ in range(6000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert private.plain_spans(text) == plain(text), text


DISGUISED = {
    "write to jane [at] corp [dot] example (dot) org now": ("email", "jane [at] corp [dot] example (dot) org"),
    "mail jane.doe at corp dot com please": ("email", "jane.doe at corp dot com"),
    "mail jаne@corp.com": ("email", "jаne@corp.com"),
    "mail ｊane＠corp．com": ("email", "ｊane＠corp．com"),
    "mail ja​ne@co​rp.com": ("email", "ja​ne@co​rp.com"),
    "call plus one five five five zero one two three four today": ("phone", "plus one five five five zero one two three four"),
    "card four one one one one one one one one one one one one one one one": ("card", "four one one one one one one one one one one one one one one one"),
    "host １０.２０.３０.４０ up": ("ip", "１０.２０.３０.４０"),
    "ruf plus vier neun drei null eins zwei drei vier fünf an": ("phone", "plus vier neun drei null eins zwei drei vier fünf"),
}


@pytest.mark.parametrize("text", DISGUISED)
def test_disguises_map_back(text):
    kind, want = DISGUISED[text]
    found = private.spans(text)
    assert [(k, text[a:b]) for k, a, b, p in found if not p] == [(kind, want)]
    assert [(k, a, b) for k, a, b, p in found if p] == plain(text)


def test_clean_texts_stay_clean(prose):
    for text in ["meet me at noon, dot the i", "one two three four", "see section 1.2.3 (at last) [dot]", "über älter café naïve", prose(3, 400), "at dot at dot", "<at> <dot>"]:
        assert private.spans(text) == []


def test_base_spans_stay_beside_disguised():
    text = "a@b.co and c [at] d [dot] eu and +1 (222) 333-4444"
    assert [(k, text[a:b], p) for k, a, b, p in private.spans(text)] == [("email", "a@b.co", True), ("email", "c [at] d [dot] eu", False), ("phone", "+1 (222) 333-4444", True)]


def test_linear_on_long_runs():
    for text in ["1" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "@" * 100_000, "+1" * 100_000, "one " * 60_000, "[at] " * 40_000, "a.b" * 60_000 + "@c", "one-" * 50_000]:
        private.spans(text)


def test_files(package_files, hard_rows):
    files = package_files([*hard_rows, ("z/mail.md", "to a@b.co or c [at] d [dot] eu."), ("z/both.md", "x@1.2.3.4")])
    got = {(r["path"], tuple((s["kind"], s["start"], s["end"], s["plain"]) for s in r["spans"])) for r in private.find(files).collect()}
    assert ("z/mail.md", (("email", 3, 9, True), ("email", 13, 30, False))) in got and ("p/null.md", ()) in got
    assert private.find(files).count() == len(hard_rows) + 2
    clean = private.redact(files)
    assert clean.columns == files.columns
    texts = {r["path"]: r["content"] for r in clean.collect()}
    assert texts["z/mail.md"] == "to <email> or <email>." and texts["z/both.md"] == "<email>" and texts["p/null.md"] is None
    assert private.find(files.limit(0)).count() == private.redact(files.limit(0)).count() == 0


@pytest.mark.parametrize("text, want", [("mail jane at example.com", "jane at example.com"), ("Mail JANE AT\texample.com today", "JANE AT\texample.com"),
                                        ("escribe a ana arroba correo.es hoy", "ana arroba correo.es"), ("mail jane at 163.com", "jane at 163.com")])
def test_spoken_at_with_a_written_dot(text, want):
    assert [(k, text[a:b], p) for k, a, b, p in private.spans(text)] == [("email", want, False)]
    for other in (" an anecdote", " point"):  # an unrelated word changes nothing
        assert private.spans(text + other) == private.spans(text)


def test_a_number_is_no_host():
    for text in ("priced at 9.99 now", "closed at 10.5 points", "starts at 5.30"):
        assert private.spans(text) == private.spans(text + " anecdote") == []


def unguarded(text):
    """rewrite() with every pattern tried."""
    r = private.Rewritten(text)
    r.apply(private._ODD, lambda m: private._plain_character(m[0]))
    r.apply(private._SOFT, lambda m: private._plain_character(m[0]))
    r.apply(private._BRACKET_AT, lambda m: "@")
    r.apply(private._BRACKET_DOT, lambda m: ".")
    r.apply(private._SPOKEN_AT, lambda m: "@")
    r.apply(private._SPOKEN_DOT, lambda m: ".")
    r.apply(private._DIGITS_SPOKEN, private._digits)
    return r if r.text != text else None


def test_guards_change_no_span_of_addresses(monkeypatch):
    rng = random.Random(21)
    parts = ["jane", "at", "AT", "arroba", "Arroba", "dot", "Punkt", "punto", "example.com", "corp", "com", ".", "@", "[at]", "(dot)", " ", " ", " ", "\n", "\u00a0", "é", "“", "9.9"]
    cases = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(5000)]
    guarded = [private.spans(t) for t in cases]
    monkeypatch.setattr(private, "rewrite", unguarded)
    assert guarded == [private.spans(t) for t in cases] and sum(map(len, guarded)) > 200


SHORT_HOSTS = {
    "host one two seven dot zero dot zero dot one up": "one two seven dot zero dot zero dot one",
    "host one zero dot zero dot zero dot one": "one zero dot zero dot zero dot one",
    "use eight dot eight dot eight dot eight now": "eight dot eight dot eight dot eight",
    "use eight.eight.8.eight now": "eight.eight.8.eight",
    "use eight . eight . eight . eight now": "eight . eight . eight . eight",
    "anyone eight dot eight dot eight dot eight": "eight dot eight dot eight dot eight",
    "host “one two seven dot one zero dot zero dot five” up": "one two seven dot one zero dot zero dot five",
    "someone one two seven dot one zero dot zero dot five": "one two seven dot one zero dot zero dot five",
}


@pytest.mark.parametrize("text", SHORT_HOSTS)
def test_spelled_hosts_of_four_digits(text):
    assert [(k, text[a:b], p) for k, a, b, p in private.spans(text)] == [("ip", SHORT_HOSTS[text], False)]


@pytest.mark.parametrize("text, want", [
    ("RUF PLUS FÜNF FÜNF FÜNF FÜNF FÜNF FÜNF FÜNF FÜNF AN", "PLUS FÜNF FÜNF FÜNF FÜNF FÜNF FÜNF FÜNF FÜNF"),
    ("appelle plus ZÉRO ZÉRO ZÉRO ZÉRO ZÉRO ZÉRO ZÉRO ZÉRO.", "plus ZÉRO ZÉRO ZÉRO ZÉRO ZÉRO ZÉRO ZÉRO ZÉRO"),
    ("call plus ſix ſeven five fİve zero one two three", "plus ſix ſeven five fİve zero one two three"),
])
def test_spelled_digits_in_any_letters(text, want):
    assert [(k, text[a:b]) for k, a, b, _ in private.spans(text)] == [("phone", want)]


def test_counting_is_no_host():
    for text in ("One. Two. Three. Four.", "one two three four five six", "One. Two, three. Four."):
        assert private.spans(text) == []


def test_folding_is_what_the_patterns_take():
    letters = set("".join(private.DIGIT_WORDS))
    either = re.compile("[" + "".join(letters) + "]", re.I)
    for c in map(chr, range(0x110000)):
        if either.match(c):
            assert private._fold(c) in letters and re.fullmatch(private._fold(c), c, re.I), c


def test_guards_change_no_span_of_digits(monkeypatch):
    rng = random.Random(22)
    parts = [*private.DIGIT_WORDS, "FÜNF", "ZÉRO", "ſix", "fİve", "anyone", "dot", "DOT", "Punkt", "plus", "más", "surplus", "1", "7", "42", ".", ".", "-", ",", "“", "”", "—", "_", "é", "\u0308"]
    cases = []
    for _ in range(6000):
        words = [rng.choice(parts) for _ in range(rng.randint(1, 24))]
        cases.append("".join(w + rng.choice(["", " ", " ", " ", " ", ". ", " dot "]) for w in words))
    digits = list(private.DIGIT_WORDS)
    cases += ["".join(rng.choice(digits).upper() + rng.choice([" ", "-", " dot ", ".", "“"]) for _ in range(rng.randint(3, 20))) for _ in range(3000)]
    guarded = [private.spans(t) for t in cases]
    monkeypatch.setattr(private, "rewrite", unguarded)
    assert guarded == [private.spans(t) for t in cases] and sum(map(len, guarded)) > 200
