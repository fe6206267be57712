"""Operations in Python files, found by pattern over whole file contents.

One pass per file yields its calls and string constants in text order, in an Arrow task
(``functions.pytokens``); all that follows is built-in expressions over those tokens.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packaudit.functions import columns as c
from packaudit.functions import fixed, lines, pytokens
from packaudit.functions.pytokens import STRING
from packaudit.functions.tables import findings, union_all

NODE = ("fn", "line", "open", "close", "depth", "parent")
_COMMENT = r"#[^\n]*+"
PORTION = 4 << 20  # bytes of file contents that the scan holds at a time
_DEPTH = 4  # the scan shows brackets inside arguments two deep


def _nested(depth: int) -> str:
    inner = _nested(depth - 1) if depth else ""
    group = rf"|[(\[{{]{inner}[)\]}}]" if depth else ""
    return rf"(?:[^()\[\]{{}}\"'#]++|{STRING}|{_COMMENT}{group})*+"


ARGUMENT = rf"((?:[^,()\[\]{{}}\"'#]++|{STRING}|{_COMMENT}|[(\[{{]{_nested(_DEPTH - 1)}[)\]}}])++)"


_IMPORT = r"(?m)^[ \t]*((?:import[ \t]+[\w., \t]+)|(?:from[ \t]+[\w.]+[ \t]+import[ \t]+[\w., \t(*]+))"


def python_files(files: DataFrame) -> DataFrame:
    return files.filter("ext = '.py' and not is_binary and content is not null")


def _portions(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows whose contents come to about ``PORTION`` bytes; a larger file is alone."""
    start = held = 0
    for i, n in enumerate(pc.binary_length(batch.column("content")).to_pylist()):
        if i > start and held + n > PORTION:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def _lists(rows: list[list[tuple] | None], names: tuple[str, ...]) -> pa.Array:
    """Lists of tuples as an array of lists of structs, built column by column; the first is text, the others numbers."""
    flat = [t for r in rows if r for t in r]
    columns = list(zip(*flat)) or [()] * len(names)
    values = pa.StructArray.from_arrays([pa.array(x, pa.int32() if i else pa.string()) for i, x in enumerate(columns)], names)
    offsets = pa.array([0, *accumulate(len(r) if r else 0 for r in rows)], pa.int32())
    missing = [r is None for r in rows]
    return pa.ListArray.from_arrays(offsets, values, mask=pa.array(missing) if any(missing) else None)


def parse(files: DataFrame) -> DataFrame:
    """All that is read off file contents, in one pass: one row per Python file.

    ``tokens`` holds calls and string constants in text order with their lines, ``divisions``
    paths built with ``/``, ``modules`` the imports, ``calls`` the tree of all calls; two scores
    need only the text itself.
    """
    t = F.col("content")
    lowered = lambda test, why: F.when(test, fixed.READABLE_LOSS[why]).otherwise(0.0)
    readable = F.greatest(F.lit(0.1), F.lit(1.0)
        - lowered(c.is_encoding_b(t), "encoding") - lowered(t.contains("sys.meta_path"), "import_hook")
        - lowered(t.contains("__import__"), "import_call") - lowered(t.contains("+") & t.rlike(r"""['"][a-z]+['"]\s*\+\s*['"][a-z]+['"]"""), "joined_names"))
    rows = python_files(files).select(
        "skill_id", "path", c.all_matches(t, _IMPORT).alias("modules"), (t.contains("__name__") & t.rlike(r"if\s+__name__\s*(==|!=|in\b)")).alias("entry_point"),
        readable.alias("readable"), (t.contains("/") & t.rlike(r"""/\s*['"]""")).alias("divides"), "content")

    def scan(batches):
        for batch in batches:
            for part in _portions(batch):
                texts = part.column("content").to_pylist()
                trees = [[] for _ in texts]
                toks = _lists([pytokens.tokens(x, tree) for x, tree in zip(texts, trees)], ("text", "line"))
                cuts = _lists([pytokens.divisions(x) if d else None for x, d in zip(texts, part.column("divides").to_pylist())], ("text", "line"))
                yield pa.RecordBatch.from_arrays([*part.columns[:5], toks, cuts, _lists(trees, NODE)], ["skill_id", "path", "modules", "entry_point", "readable", "tokens", "divisions", "calls"])

    span = "array<struct<text:string,line:int>>"
    return rows.mapInArrow(scan, f"skill_id string, path string, modules array<string>, entry_point boolean, readable double, tokens {span}, divisions {span}, "
                           "calls array<struct<fn:string,line:int,open:int,close:int,depth:int,parent:int>>")


def call_tree(parsed: DataFrame) -> DataFrame:
    """All calls of each file: number, name, line, interval of places, depth and enclosing call.

    ``parent`` is the number of the innermost call whose arguments hold it, -1 outside of all.
    """
    return parsed.select("skill_id", "path", F.posexplode("calls").alias("call", "z")).select("skill_id", "path", "call", "z.*")


def inside_arguments(tree: DataFrame, outer: Column) -> DataFrame:
    """The calls that stand, at any depth, in the arguments of a call for which ``outer`` holds.

    Intervals nest: a call lies in an outer one exactly if some outer call before it closes
    after it opens.  One window over the calls of each file, and no pairs of calls.
    """
    before = Window.partitionBy("skill_id", "path").orderBy("open").rowsBetween(Window.unboundedPreceding, -1)
    return tree.withColumn("_far", F.max(F.when(outer, F.col("close"))).over(before)).filter(F.col("_far") > F.col("open")).drop("_far")


def tokens(parsed: DataFrame) -> DataFrame:
    """Calls and string constants of Python files in text order, with line numbers."""
    rows = parsed.select("skill_id", "path", F.posexplode("tokens").alias("pos", "z"))
    text = F.col("z.text")
    is_text = F.col("z.text").rlike(r"""^[rRbBuUfF]{0,2}["']""")
    head = r"^([\w.]+)\s*[(\[]"
    return rows.select(
        "skill_id", "path", "pos", F.col("z.line").cast("int").alias("line"),
        F.when(is_text, "text").otherwise("call").alias("kind"),
        F.when(~is_text, F.regexp_extract(text, head, 1)).alias("fn"),
        F.when(~is_text, F.regexp_replace(text, r"^[\w.]+\s*", "")).alias("args_text"),
        F.when(is_text, F.lower(F.regexp_extract(text, r"^([rRbBuUfF]{0,2})", 1))).alias("prefix"),
        F.when(is_text, string_value(text)).alias("value"),
    )


def string_value(text: Column) -> Column:
    """Contents of a quoted constant; common escapes are resolved unless it is raw."""
    body = F.regexp_replace(text, r'''(?s)^[rRbBuUfF]{0,2}("""|\'\'\'|"|')(.*)\1$''', "$2")
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(body, r"\\\n", ""), r"\\n", "\n"), r"\\([\\'\"])", "$1")
    return F.when(text.rlike("^[bBuUfF]?[rR]"), body).otherwise(F.when(body.contains("\\"), plain).otherwise(body))


_IS_STRING = rf"(?s)^[rRuU]?(?:{STRING}\s*)++$"
_IS_FORMAT = r"""^(?:[fF][rR]?|[rR][fF])["']"""
_IS_CONSTANT = rf"(?s)^(?:[rRbBuU]{{0,2}}{STRING}|[+-]?[\d.][\w.]*|True|False|None|\.\.\.)$"
_IS_VARIABLE = r"(?s)^(?!(?:True|False|None|not|lambda|await)\b)[A-Za-z_]\w*(?:\.\w+|\[.*\])*$"
_IS_SUBSCRIPT = r"(?s)^[A-Za-z_][\w.]*\(.*\)\[[^\[\]]*\]$"


def calls(toks: DataFrame) -> DataFrame:
    """Call tokens with their positional arguments and what the first one is."""
    return with_arguments(toks.filter("kind = 'call'")).drop("kind", "prefix", "value")


def with_arguments(toks: DataFrame) -> DataFrame:
    """Argument columns for call tokens; they stay null for string constants."""
    parts = F.transform(c.all_matches(F.expr("substring(args_text, 2)"), "(?s)" + ARGUMENT, 1), lambda a: F.trim(a, F.lit(" \n\t\r")))
    parts = F.transform(F.filter(parts, lambda a: (a != "") & ~a.startswith("#")), lambda a: F.regexp_replace(a, r"(?s)^#[^\n]*\n\s*", ""))
    called = toks.withColumn("parts", parts)
    keyword = r"^\w+\s*=(?!=)"
    called = called.withColumns({
        "args": F.filter("parts", lambda a: ~a.rlike(keyword)),
        "mode_kw": F.get(F.filter("parts", lambda a: a.rlike(r"^mode\s*=")), F.lit(0)),
    })
    a0, a1 = F.get("args", F.lit(0)), F.get("args", F.lit(1))
    called = called.withColumns({"a0": F.coalesce(a0, F.lit("")), "a1": F.coalesce(a1, F.lit(""))})
    a0, a1 = F.col("a0"), F.col("a1")
    strings = F.transform(F.filter("args", lambda a: a.rlike(_IS_STRING)), string_value)
    listed = F.when(a0.startswith("["), F.transform(
        F.filter(F.transform(c.all_matches(F.regexp_replace(a0, r"(?s)^\[(.*)\]$", "$1"), "(?s)" + ARGUMENT, 1), lambda a: F.trim(a, F.lit(" \n\t\r"))),
                 lambda a: a != ""), lambda a: a))
    mode = F.when(a1.rlike(_IS_CONSTANT), F.regexp_replace(a1, r"""^[rRbBuU]{0,2}["']|["']$""", ""))
    kw_mode = F.regexp_extract(F.coalesce("mode_kw", F.lit("")), r"""=\s*["'](.*)["']""", 1)
    return called.select(
        "skill_id", "path", "pos", "line", "kind", "prefix", "value", "fn", "args", "a0", "a1", strings.alias("strings"),
        F.when(a0.rlike(_IS_STRING), string_value(a0)).when(a0.rlike(_IS_FORMAT), "<f-string>").otherwise("").alias("first"),
        F.when(a0.rlike(_IS_STRING), string_value(a0)).otherwise("").alias("literal"),
        listed.alias("listed"),
        (a0.rlike(_IS_VARIABLE) | a0.rlike(_IS_SUBSCRIPT)).alias("is_var"),
        F.exists("args", lambda a: ~a.rlike(_IS_CONSTANT)).alias("dynamic_arg"),
        F.coalesce(mode, F.nullif(kw_mode, F.lit("")), F.lit("r")).alias("mode"),
        F.coalesce(F.when(a1.rlike(_IS_STRING), string_value(a1)), F.lit("")).alias("literal_mode"),
        F.col("args_text").startswith("[").alias("indexed"),
    )


def string_literals(toks: DataFrame, longer_than: int = 2) -> DataFrame:
    """String constants longer than two characters; a formatted string gives its fixed pieces."""
    texts = toks.filter("kind = 'text' and not contains(prefix, 'b')")
    pieces = F.when(F.col("prefix").contains("f"), F.split("value", r"\{[^{}]*\}")).otherwise(F.array("value"))
    return texts.select("skill_id", "path", "pos", "line", F.explode(pieces).alias("value")).filter(F.length("value") > longer_than)


def imports(parsed: DataFrame) -> DataFrame:
    """Imported modules per file, ``from`` imports also as module.name."""
    rows = parsed.select("skill_id", "path", F.explode("modules").alias("s"))
    module = F.regexp_extract("s", r"^from[ \t]+([\w.]+)", 1)
    names = F.transform(
        F.split(F.regexp_replace("s", r"^(?:import|from[ \t]+[\w.]+[ \t]+import)[ \t]+\(?", ""), ","),
        lambda n: F.regexp_extract(n, r"^\s*([\w.]+)", 1))
    names = F.filter(names, lambda n: n != "")
    found = F.when(module == "", names).otherwise(F.concat(F.array(module), F.transform(names, lambda n: F.concat(module, F.lit("."), n))))
    return rows.select("skill_id", "path", F.explode(found).alias("module")).distinct()


# ------------------------------------------------------------------- view A: findings


def _fact(test: Column, kind, subtype, detail: Column) -> Column:
    """One script fact where ``test`` holds, else null."""
    sub = subtype if isinstance(subtype, Column) else F.lit(subtype)
    kind = kind if isinstance(kind, Column) else F.lit(kind)
    return F.when(test, F.struct(kind.alias("kind"), sub.alias("subtype"), detail.alias("detail")))


def _facts(df: DataFrame, *facts: Column) -> DataFrame:
    """All facts of a row in one pass over the table."""
    return df.select("skill_id", "path", F.inline(F.array_compact(F.array(*facts))), "line", "pos")


def path_divisions(parsed: DataFrame) -> DataFrame:
    """Sensitive paths built with ``/`` from constants, for instance below a home directory."""
    rows = parsed.select("skill_id", "path", F.posexplode("divisions").alias("pos", "z"))
    parts = F.transform(c.all_matches(F.col("z.text"), f"(?s)({STRING})", 1), string_value)
    parts = F.when(F.col("z.text").rlike(r"(?i)^[\w.]*(?:home|expanduser)"), F.concat(F.array(F.lit("~")), parts)).otherwise(parts)
    return rows.select("skill_id", "path", F.col("z.line").cast("int").alias("line"), (F.col("pos") + 1_000_000).alias("pos"),
                       F.array_join(parts, "/").alias("joined"), F.size(parts).alias("n")
                       ).filter((F.col("n") >= 2) & c.is_sensitive_a(F.col("joined"))).drop("n")


def python_io(called: DataFrame, literals: DataFrame, divisions: DataFrame, imported: DataFrame, parsed: DataFrame) -> DataFrame:
    """What each Python file takes in, gives out, causes and reads of sensitive places."""
    from packaudit.operators.rules import sensitive_literals

    fn, first = F.col("fn"), F.col("first")
    process, net = fn.isin(fixed.PROCESS_CALLS_A), fn.isin(fixed.NETWORK_CALLS_A)
    items = F.filter("listed", lambda a: a.rlike(_IS_STRING))
    listed = F.array_join(F.transform(items, string_value), " ")
    run = F.when(F.size(F.coalesce(items, c.empty_strings())) > 0, listed).when(first != "", first).otherwise("<dynamic>")
    target = F.when(first == "", "<dynamic>").otherwise(first)
    opened = fn == "open"
    is_write = F.col("mode").rlike("[wxa+]")
    env = fn.isin("os.environ.get", "os.getenv") | ((fn == "os.environ") & F.col("indexed") & (F.col("literal") != ""))
    joined = F.array_join("strings", "/")
    true = F.lit(True)
    end = {"line": F.lit(0), "pos": F.lit(2_000_000)}
    sensitive = lambda test, subtype, detail: _fact(test, "sensitive_read", subtype, detail)
    rows = union_all([
        _facts(
            called,
            _fact(process, "effect", "subprocess", run),
            _fact(net, "output", F.when(F.lower(fn).contains("post"), "network_post").otherwise("network_get"), target),
            _fact(net, "effect", "network_request", target),
            _fact(opened, F.when(is_write, "output").otherwise("input"), F.when(is_write, "file_write").otherwise("file_read"), target),
            _fact(env, "input", "env_var", target),
        ),
        _facts(imported.filter("module = 'sys'").withColumns(end), _fact(true, "input", "argv", F.lit("sys.argv"))),
        _facts(literals.filter(F.col("value").contains("stdin")).select("skill_id", "path").distinct().withColumns(end), _fact(true, "input", "stdin", F.lit(""))),
        _facts(parsed.select("skill_id", "path").withColumns(end), _fact(true, "output", "stdout", F.lit("print/stdout"))),
    ])
    reads = union_all([
        _facts(
            called,
            sensitive(opened & c.is_sensitive_a(first), "path", first),
            sensitive(fn.isin("os.path.join", "Path") & c.is_sensitive_a(joined), "path", joined),
            sensitive(env & c.is_secret_env(first), "env", F.concat(F.lit("env:"), first)),
        ),
        _facts(divisions, sensitive(true, "path", F.col("joined"))),
        _facts(sensitive_literals(literals), sensitive(true, "path", F.col("value"))),
    ])
    first_places = reads.groupBy("skill_id", "path", "kind", "subtype", "detail").agg(F.min("line").alias("line"), F.min("pos").alias("pos"))
    return rows.unionByName(first_places)


def call_findings(called: DataFrame) -> DataFrame:
    """Findings that follow from one call alone, all in one pass over the calls."""
    fn, first, dyn = F.col("fn"), F.col("first"), F.col("dynamic_arg")
    items = F.filter("listed", lambda a: a.rlike(_IS_STRING))
    fixed_n = F.size(F.coalesce(items, c.empty_strings()))
    all_n = F.size(F.coalesce("listed", c.empty_strings()))
    cmd = F.coalesce(string_value(F.get(items, F.lit(0))), F.lit(""))
    process = fn.isin(fixed.PROCESS_CALLS_A)
    net = fn.isin(fixed.NETWORK_CALLS_A) & c.is_external_a(first)
    joined = F.array_join("strings", "/")
    s = F.lit

    def found(test, severity, category, text, evidence, confidence=1.0):
        severity = severity if isinstance(severity, Column) else F.lit(severity)
        return F.when(test, F.struct(severity.alias("severity"), s(category).alias("category"), text.alias("text"),
                                     evidence.alias("ev"), s(confidence).alias("conf")))

    marks = F.array(
        found(fn.isin(fixed.EXEC_CALLS_A), F.when(dyn, "CRITICAL").otherwise("HIGH"), "RemoteCodeExecution",
              F.concat(s("Dynamic code execution: "), fn, s("() with "), F.when(dyn, "dynamic").otherwise("static"), s(" argument")), fn),
        found(net, F.when(F.lower(fn).contains("post"), "HIGH").otherwise("MEDIUM"), "DataExfiltration",
              F.concat(s("External network call: "), fn, s("() to "), first), first),
        found((fn == "open") & c.is_sensitive_a(first), "CRITICAL", "CredentialTheft", F.concat(s("Sensitive file access: "), first), first),
        found((fn == "getattr") & F.arrays_overlap("strings", c.str_array(fixed.RISKY_ATTRIBUTES)), "CRITICAL", "Obfuscation",
              s("Indirect access via getattr to dangerous attribute"), s("")),
        found(fn.isin("os.path.join", "Path") & c.is_sensitive_a(joined), "CRITICAL", "CredentialTheft",
              F.concat(s("Sensitive path constructed via "), fn, s("(): "), joined), joined),
        found(process & (fixed_n > 0) & (fixed_n < all_n), "MEDIUM", "CommandInjection",
              F.concat(s("Subprocess with partially dynamic args: "), fn, s("("), cmd, s(", ...)")), cmd, 0.5),
        found(process & (fixed_n == 0) & (first == ""), "MEDIUM", "CommandInjection",
              F.concat(s("Subprocess with fully dynamic command: "), fn, s("()")), fn))
    rows = called.select("skill_id", "path", "line", "pos", F.inline(F.array_compact(marks)))
    return findings(rows, "code", F.col("severity"), F.col("category"), F.col("text"), path=F.col("path"), line=F.col("line"),
                    evidence=F.col("ev"), confidence=F.col("conf"), pos=F.col("pos"))


def division_findings(divisions: DataFrame) -> DataFrame:
    first = divisions.groupBy("skill_id", "path", "joined").agg(F.min("line").alias("line"), F.min("pos").alias("pos"))
    return findings(first, "code", "CRITICAL", "CredentialTheft", F.concat(F.lit("Sensitive path via Path division: "), "joined"),
                    path=F.col("path"), line=F.col("line"), evidence=F.col("joined"), pos=F.col("pos"))


def reverse_shells(called: DataFrame) -> DataFrame:
    """Files that connect out, redirect standard streams and start a shell: three weak signals."""
    fn, a0 = F.col("fn"), F.col("a0")
    connect = fn.rlike(r"(^|\.)connect$") & fn.contains(".") | (fn == "connect")
    inner = F.trim(F.regexp_extract(a0, r"(?s)^\(\s*([^,()]*)", 1))
    host = (F.when(a0.startswith("("), F.when(inner.rlike(_IS_STRING), string_value(inner))
                   .when(inner.rlike(r"^[A-Za-z_]\w*$"), F.concat(F.lit("<"), F.lower(inner), F.lit(">"))).otherwise("<dynamic>"))
            .when(F.col("literal") != "", F.col("literal")).when(a0 == "", "").otherwise("<dynamic>"))
    redirect = fn.isin(fixed.FD_CALLS) & F.col("a1").isin("0", "1", "2")
    items = F.transform(F.filter("listed", lambda a: a.rlike(_IS_STRING)), string_value)
    listed = F.size(F.coalesce(items, c.empty_strings())) > 0
    cmd = F.when(listed, F.get(items, F.lit(0))).otherwise(F.element_at(F.split(F.trim("first"), r"\s+"), 1))
    shell = fn.isin(fixed.PROCESS_CALLS_A) & c.is_shell_command(F.coalesce(cmd, F.lit("")))
    rest = F.when(listed, F.slice(items, 2, F.greatest(F.size(items), F.lit(1)))).otherwise(c.words(F.col("first")))
    interactive = shell & F.exists(rest, lambda t: F.lower(F.trim(t)).isin("-i", "/i"))
    signal = called.withColumns({"connect": connect, "out": connect & c.is_external_host(host), "redirect": redirect,
                                 "shell": shell, "tty": interactive}).filter("connect or redirect or shell")
    per = signal.groupBy("skill_id", "path").agg(
        *[F.bool_or(x).alias(x) for x in ("connect", "out", "redirect", "shell", "tty")], F.min("line").alias("line"), F.min("pos").alias("pos"))
    hit = per.filter("connect and redirect and shell")
    hard = F.col("out") | F.coalesce("tty", F.lit(False))
    return findings(hit, "code", F.when(hard, "CRITICAL").otherwise("HIGH"), "RemoteCodeExecution",
                    "Reverse shell behavior: socket.connect + stdio redirection + shell spawn", path=F.col("path"), line=F.col("line"),
                    evidence="socket.connect + os.dup2 + shell", confidence=F.when(hard, 0.95).otherwise(0.85), pos=F.col("pos"))


def python_flags(parsed: DataFrame, called: DataFrame, literals: DataFrame, imported: DataFrame) -> DataFrame:
    """Per file: how far it can be analysed, and whether it hides or builds code."""
    from packaudit.operators.rules import is_packed

    keys, value = ["skill_id", "path"], F.col("value")

    def seen(df: DataFrame, **tests: Column) -> DataFrame:
        """Rows that show any of the five signs; one pass over the table for all of its tests."""
        signs = [F.coalesce(tests[k], F.lit(False)).alias(k) if k in tests else F.lit(False).alias(k) for k in ("dyn", "getattr", "obf", "hook", "packed")]
        return df.select(*keys, *signs).filter("dyn or getattr or obf or hook or packed")

    rows = union_all([
        seen(called, dyn=F.col("fn").isin(fixed.EXEC_CALLS_A), getattr=F.col("fn") == "getattr"),
        seen(imported, obf=F.col("module").isin(fixed.OBFUSCATION_IMPORTS)),
        seen(literals, hook=c.has_any(value, ["sys.meta_path", "__import__"]), packed=is_packed(value)),
    ])
    signs = rows.groupBy(*keys).agg(*[F.bool_or(x).alias(x) for x in ("dyn", "getattr", "obf", "hook", "packed")])
    j = parsed.select(*keys, "entry_point").join(signs, keys, "left")
    flag = lambda x: F.coalesce(F.col(x), F.lit(False))
    low = lambda x, v: F.when(flag(x), v).otherwise(1.0)
    return j.select(
        *keys, F.least(low("dyn", 0.3), low("getattr", 0.5), low("obf", 0.4), low("hook", 0.3)).alias("analyzability"),
        flag("obf").alias("has_obfuscation"), flag("dyn").alias("has_dynamic_execution"),
        flag("packed").alias("has_encoded_payloads"), "entry_point")


# --------------------------------------------------------------- view B: operation rows

OPS = ("skill_id string, path string, line int, pos int, op_type string, fn string, label string, file_path string, url string, cmd string, "
       "var_name string, is_write boolean, is_sensitive boolean, is_external boolean, cmd_dynamic boolean")


_OP_FIELDS = {"fn": "", "file_path": "", "url": "", "cmd": "", "var_name": "", "is_write": False, "is_sensitive": False,
              "is_external": False, "cmd_dynamic": False}


def _operation(op_type: str, label: Column, **values: Column) -> Column:
    """An operation as a struct with all fields, defaults where nothing is given."""
    fields = [F.coalesce(values[k], F.lit(v)).alias(k) if k in values else F.lit(v).alias(k) for k, v in _OP_FIELDS.items()]
    return F.struct(F.lit(op_type).alias("op_type"), label.alias("label"), *fields)


def _short(c_: Column, n: int) -> Column:
    return F.when(c_ == "", "...").otherwise(F.substring(c_, 1, n))


def call_operation() -> Column:
    """The operation a call stands for, null for other calls; the first family wins."""
    fn, lit_ = F.col("fn"), F.col("literal")
    write = F.col("literal_mode").rlike("[wax]")
    s = F.lit
    run = _operation("sys_op", F.concat(fn, s("("), _short(lit_, 40), s("))")), fn=fn, cmd=lit_, cmd_dynamic=F.col("is_var"))
    net = _operation("net_op", F.concat(fn, s("("), _short(lit_, 60), s("))")), fn=fn, url=lit_, is_external=c.is_external_b(lit_))
    file = _operation("io_op", F.concat(F.when(write, "write").otherwise("read"), s("("), _short(lit_, 50), s("))")), fn=fn, file_path=lit_,
                      is_write=write, is_sensitive=(lit_ != "") & c.is_sensitive_b(lit_))
    env = _operation("env_op", F.concat(s("env["), F.when(lit_ == "", "...").otherwise(lit_), s("]")), fn=fn, var_name=lit_)
    return (
        F.when(fn.isin(fixed.EXEC_CALLS_B) | fn.isin(fixed.PROCESS_CALLS_B) | fn.contains("subprocess"), run)
        .when(c.has_any(fn, fixed.NETWORK_NAME_PARTS_B), net)
        .when((fn == "open") | c.has_any(fn, fixed.FILE_NAME_PARTS_B), file)
        .when(~F.col("indexed") & (fn.contains("getenv") | fn.isin("os.environ.get", "os.environ.__getitem__")), env))


def literal_pieces() -> Column:
    """Fixed pieces of a string constant: one, or those between a formatted string's braces."""
    return F.when(F.col("prefix").contains("f"), F.split("value", r"\{[^{}]*\}")).otherwise(F.array("value"))


def literal_operations() -> Column:
    """Operations only visible in constants: sensitive names, addresses, and both behind base64."""
    yes = F.lit(True)
    name = lambda kind, v, n: F.concat(F.lit(kind + "("), F.substring(v, 1, n), F.lit(")"))
    io = lambda kind, v: _operation("io_op", name(kind, v, 50), file_path=v, is_sensitive=yes)
    net = lambda kind, v: _operation("net_op", name(kind, v, 60), url=v, is_external=yes)

    def of_piece(v: Column) -> Column:
        return F.array(F.when((F.length(v) > 2) & c.is_sensitive_b(v), io("sensitive_ref", v)),
                       F.when((F.length(v) > 8) & c.is_external_b(v), net("url_literal", v)))

    def of_bytes(v: Column) -> Column:
        return F.array(F.when(c.is_external_b(v), net("b64_url", v)).when((F.length(v) > 3) & c.is_sensitive_b(v), io("b64_path", v)))

    plain = F.flatten(F.transform(literal_pieces(), of_piece))
    hidden = c.let(c.decode_base64(F.regexp_replace("value", r"[^A-Za-z0-9+/=]", "")), of_bytes)
    return F.when(F.col("prefix").contains("b"), hidden).otherwise(plain)


def embedded_ops(files: DataFrame) -> DataFrame:
    """Python-like calls inside text files beside the code."""
    any_hit = F.col("content").rlike("|".join(p for p, _ in fixed.EMBEDDED_CODE))
    each = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(label).alias("label"), lines.found(F.col("content"), p, 0).alias("found")) for k, (p, label) in enumerate(fixed.EMBEDDED_CODE)])
    kinds = files.filter(any_hit).select("skill_id", "path", F.inline(each))
    rows = kinds.select("skill_id", "path", "k", "label", F.posexplode("found").alias("pos", "m")).select("skill_id", "path", "k", "label", "pos", F.col("m.before").alias("before"), F.col("m.inside").alias("inside"))
    at = lines.with_lines(rows, ["skill_id", "path", "k"])
    at = at.withColumn("pos", (F.col("pos") + F.col("k") * 1_000_000).cast("int"))
    return at.select("skill_id", "path", "line", "pos", _operation("sys_op", F.col("label")).alias("op")).select("skill_id", "path", "line", "pos", "op.*")


def code_ops(toks: DataFrame, text_files: DataFrame) -> DataFrame:
    """All operation rows of a corpus, each with risk and the entropy of constants that follow it.

    A constant of high entropy counts for the operation just before it in the same file, if
    that is a process operation.  Windows run inside one file, whose size is bounded.
    """
    bits = F.array_max(F.transform(F.filter(literal_pieces(), lambda p: F.length(p) > 30), c.entropy))
    is_call = F.col("kind") == "call"
    found = F.array_compact(F.when(is_call, F.array(call_operation())).otherwise(literal_operations()))
    dense = F.when(~is_call & ~F.col("prefix").contains("b"), bits)
    rows = with_arguments(toks).select("skill_id", "path", "line", "pos", found.alias("found"), dense.alias("bits"))
    both = rows.select("skill_id", "path", "line", "pos", "bits", F.posexplode_outer("found").alias("o", "op"))
    mark = F.when((F.col("bits") > fixed.DENSE_BITS) & (F.coalesce("o", F.lit(0)) == 0), F.col("bits"))
    both = both.select("skill_id", "path", "line", "pos", F.coalesce("o", F.lit(0)).alias("o"), mark.alias("bits"), "op").filter("op is not null or bits is not null")
    # a row that is both mark and operation becomes two: the mark first, for the operation before
    parts = F.when(F.col("op").isNotNull() & F.col("bits").isNotNull(), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(2)))
    both = both.withColumn("part", F.explode(parts))
    both = both.select("skill_id", "path", "line", "pos", "o", "part", F.when(F.col("part") != 1, F.col("bits")).alias("bits"), F.when(F.col("part") != 0, F.col("op")).alias("op"))
    order = Window.partitionBy("skill_id", "path").orderBy("pos", "o", "part")
    both = both.withColumn("op_no", F.count("op").over(order))
    slot = Window.partitionBy("skill_id", "path", "op_no")
    both = both.withColumn("e", F.max("bits").over(slot)).filter("op is not null").select("skill_id", "path", "line", "pos", "op.*", "e")
    scored = both.withColumn("entropy", F.when((F.col("op_type") == "sys_op"), F.coalesce("e", F.lit(0.0))).otherwise(0.0))
    rest = embedded_ops(text_files).withColumn("entropy", F.lit(0.0))
    out = scored.drop("e").unionByName(rest)
    return out.withColumn("risk", op_risk())


def op_risk() -> Column:
    """Fixed risk of an operation row."""
    kind, r = F.col("op_type"), fixed.OP_RISK
    dense = F.col("entropy") > fixed.DENSE_BITS
    return (
        F.when(kind == "io_op", F.when(F.col("is_sensitive"), r["io_sensitive"]).when(F.col("is_write"), r["io_write"]).otherwise(r["io_read"]))
        .when(kind == "net_op", F.when(F.col("is_external"), r["net_external"]).otherwise(r["net_other"]))
        .when(kind == "sys_op", F.when(F.col("cmd_dynamic"), r["sys_dynamic"]).when(dense, r["sys_dense"]).otherwise(r["sys_other"]))
        .when(kind == "env_op", r["env"]).otherwise(r["other"]))


def analyzability(parsed: DataFrame) -> DataFrame:
    """Per file: 1 lowered for encoding calls, import hooks and names built from pieces."""
    return parsed.select("skill_id", "path", F.col("readable").alias("analyzability"))


def scored_paths() -> Column:
    """Files whose operations enter the code score: top level and ``scripts/``."""
    return F.col("path").rlike(r"^(scripts/)?[^/]+\.py$")
