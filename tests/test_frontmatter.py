import random

from packaudit.functions.frontmatter import paths
from packaudit.operators import manifest as man


def test_depths_lists_and_scalars():
    front = '\n'.join(['name: "a: b"  # c', "permissions:", "  network:", "  - name: one", "    ports: [1, '2, 3', \"x # y\"]", "  -", "    name: two", "  deep:", "    er:", "      est: {k: [p, {q: r}], s: t}",
                       "empty:", "text: >-", "  folded", "", "  more: text", "after: it's # fine", "'quoted key': v", "- stray", "# no: thing"])
    assert [(k, v) for _, k, v in paths(front)] == [
        (["name"], "a: b"), (["permissions", "network", "name"], "one"), *[(["permissions", "network", "ports"], p) for p in ("1", "2, 3", "x # y")], (["permissions", "network", "name"], "two"),
        (["permissions", "deep", "er", "est", "k"], "p"), (["permissions", "deep", "er", "est", "k", "q"], "r"), (["permissions", "deep", "er", "est", "s"], "t"),
        (["text"], "folded more: text"), (["after"], "it's"), (["quoted key"], "v"), (["quoted key"], "stray")]
    assert paths("") == [] and paths("no keys at all") == [] and paths("a:\n\t- b") == [(1, ["a"], "b")]


def test_written_trees_are_read_back():
    """Random trees of maps and lists, written in block style, against their own paths."""
    rng = random.Random(3)

    def made(depth):
        kind = rng.choice(["map", "list", "text"] if depth else ["map"])
        if kind == "map" or depth > 4:
            return {f"k{i}": made(depth + 1) if depth < 4 else f"v{rng.randrange(9)}" for i in range(rng.randint(1, 3))}
        return [f"i{rng.randrange(9)}" for _ in range(rng.randint(1, 3))] if kind == "list" else f"t{rng.randrange(99)}"

    def write(node, indent):
        pad = " " * indent
        if isinstance(node, dict):
            for k, v in node.items():
                if isinstance(v, str):
                    yield f"{pad}{k}: {v}"
                else:
                    yield f"{pad}{k}:"
                    yield from write(v, indent + rng.choice([1, 2, 4]))
        else:
            yield from (f"{pad}- {x}" for x in node)

    def flat(node, keys=()):
        if isinstance(node, dict):
            return [row for k, v in node.items() for row in flat(v, (*keys, k))]
        return [(list(keys), x) for x in ([node] if isinstance(node, str) else node)]

    for _ in range(300):
        tree = made(0)
        assert [(k, v) for _, k, v in paths("\n".join(write(tree, 0)))] == flat(tree)


def test_long_header_takes_linear_time(make_files):
    import time

    header = "permissions:\n" + "".join(f"  p{i}:\n    in:\n    - a\n    - b\n" for i in range(40_000))
    start = time.perf_counter()
    files = make_files({"p": {"SKILL.md": f"---\n{header}---\nbody"}, "q": {"SKILL.md": "no header"}, "r": {"SKILL.md": "---\npermissions: all\n---\n"}})
    rows = man.permissions(files)
    assert rows.count() == 80_000 and rows.filter("skill_id <> 'p'").count() == 0 and time.perf_counter() - start < 60
