"""The package graph: instruction, code and permission nodes, and the edges between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packaudit.functions import columns as c
from packaudit.functions import fixed
from packaudit.functions.tables import first_rows, union_all
from packaudit.operators.reach import closure, nearest_targets, next_within, roots

KEY = "skill_id"
DIMS = ["file_read", "file_write", "network", "subprocess"]
EDGE = [KEY, "from_id", "to_id", "edge_type", "label", "weight"]


# ---------------------------------------------------------------------------- nodes


def nl_id(index: Column) -> Column:
    return F.concat(F.lit("nl:"), index.cast("string"))


def with_code_ids(ops: DataFrame) -> DataFrame:
    """A stable id from where the operation stands; no numbering over the package."""
    return ops.withColumn("id", F.concat_ws(":", F.lit("code"), "path", "line", "pos", "op_type", F.hex(F.xxhash64("label"))))


def nl_nodes(units: DataFrame) -> DataFrame:
    cmd = F.trim(F.concat_ws(" ", "command", F.coalesce("target", F.lit(""))))
    label = F.when(F.coalesce("command", F.lit("")) != "", cmd).otherwise(F.col("text"))
    kind = F.when(F.col("is_conditional"), "nl_trigger").when(F.col("action_type") == "agent_capability", "nl_agent_call").otherwise("nl_directive")
    return units.select(KEY, nl_id(F.col("step_index")).alias("id"), kind.alias("node_type"), F.substring(label, 1, 80).alias("label"),
                        F.lit("SKILL.md").alias("path"), F.col("step_index").alias("line"), F.lit(0.0).alias("risk"))


def code_nodes(ops: DataFrame) -> DataFrame:
    return ops.select(KEY, "id", F.col("op_type").alias("node_type"), F.substring("label", 1, 80).alias("label"), "path", "line", "risk")


def permission_nodes(perms: DataFrame) -> DataFrame:
    return perms.select(KEY, F.concat_ws(":", F.lit("perm"), "pos", "perm_type", "scope").alias("id"), F.lit("permission").alias("node_type"),
                        F.concat("perm_type", F.lit(":"), "scope").alias("label"), F.lit("SKILL.md").alias("path"), F.lit(0).alias("line"), F.lit(0.0).alias("risk"))


def nodes(units: DataFrame, ops: DataFrame, perms: DataFrame) -> DataFrame:
    return union_all([nl_nodes(units), code_nodes(ops), permission_nodes(perms)])


# ---------------------------------------------------------------------------- edges


def _edges(df: DataFrame, a: Column, b: Column, kind: str, label: Column, weight=1.0) -> DataFrame:
    w = weight if isinstance(weight, Column) else F.lit(weight)
    return df.select(KEY, a.alias("from_id"), b.alias("to_id"), F.lit(kind).alias("edge_type"), label.alias("label"), w.cast("double").alias("weight"))


def sibling_edges(units: DataFrame) -> DataFrame:
    """Flow between steps: next sibling, entry into children, and the two ways of a condition.

    Windows run over the steps of one instruction file.
    """
    parent = F.coalesce("parent_step", F.lit(0))
    skip = F.coalesce("skip_to_step", F.lit(0))
    w = Window.partitionBy(KEY, "parent").orderBy("step_index")
    u = units.withColumns({"parent": parent, "skip": skip}).withColumns({
        "after": F.lead("step_index").over(w), "place": F.row_number().over(w)})
    i = nl_id(F.col("step_index"))
    branch = (F.col("action_type") == "condition") & (F.col("skip") > 0)
    step_keys = units.select(KEY, F.col("step_index").alias("k")).distinct()
    enter = _edges(u.filter("place = 1 and parent <> 0").withColumn("k", F.col("parent")).join(step_keys, [KEY, "k"], "left_semi"),
                   nl_id(F.col("parent")), i, "nl_flow", F.lit("enter"))
    nxt = _edges(u.filter("after is not null"), i, nl_id(F.col("after")), "nl_flow", F.when(branch, "true").otherwise("next"))
    jump = u.filter(branch & F.col("after").isNotNull() & (F.col("skip") != F.col("after"))).withColumn("k", F.col("skip")).join(step_keys, [KEY, "k"], "left_semi")
    return union_all([enter, nxt, _edges(jump, i, nl_id(F.col("skip")), "nl_flow", F.lit("skip"))])


def ctrl_flow_edges(ops: DataFrame) -> DataFrame:
    """Consecutive operations of one file, by line."""
    w = Window.partitionBy(KEY, "path").orderBy("line", "pos", "id")
    return _edges(ops.withColumn("after", F.lead("id").over(w)).filter("after is not null"), F.col("id"), F.col("after"), "ctrl_flow", F.lit("seq"))


def declared_scopes(units: DataFrame) -> DataFrame:
    """What the instructions declare: scope lists per package, as long as its manifest at most."""
    scope, kind = F.lower("resource_scope"), F.col("action_type")
    writes = c.has_any(F.lower("text"), ["write", "creat"])
    tests = {"file_write": (kind == "file_op") & writes, "file_read": (kind == "file_op") & ~writes, "network": kind == "net_op", "subprocess": kind == "subprocess"}
    return units.groupBy(KEY).agg(
        *[F.sort_array(F.collect_set(F.when(t, scope))).alias(d) for d, t in tests.items()],
        F.bool_or((kind == "file_op") & c.is_sensitive_b(scope)).alias("sensitive_access"))


def _scopes_or_empty(df: DataFrame) -> DataFrame:
    return df.withColumns({d: F.coalesce(d, c.empty_strings()) for d in DIMS})


def declared_ops(ops: DataFrame, scopes: DataFrame) -> DataFrame:
    """Operations with whether the declared scopes plausibly cover them."""
    # what the looks into the lists test is made once per operation, not once per scope
    made = {"_p": F.lower("file_path"), "_cmd": F.lower("cmd"), "_dom": F.lower(c.url_domain(F.col("url"))), "_files": F.concat("file_read", "file_write")}
    j = _scopes_or_empty(ops.join(scopes, KEY, "left")).withColumns(made)
    kind, files, p, low_cmd, dom, low_label = F.col("op_type"), F.col("_files"), F.col("_p"), F.col("_cmd"), F.col("_dom"), F.lower("label")
    io = (F.when(F.col("is_sensitive"), False).when(p == "", F.size(files) > 0)
          .otherwise(F.exists(files, lambda s: s.isin(fixed.OPEN_SCOPES) | p.contains(F.lower(s)))))
    net = (F.when(~F.col("is_external"), True).when(F.col("url") == "", F.size("network") > 0)
           .otherwise(F.exists("network", lambda d: (d != "") & (dom.contains(F.lower(d)) | F.lower(d).contains(dom)))))
    runs = F.col("cmd_dynamic") | low_label.contains("eval") | low_label.contains("exec")
    sys = (F.when(runs, False)
           .when(low_cmd != "", F.exists("subprocess", lambda s: (s != "") & (low_cmd.contains(F.lower(s)) | F.lower(s).contains(low_cmd))))
           .otherwise(F.size("subprocess") > 0))
    ok = F.when(kind == "io_op", io).when(kind == "net_op", net).when(kind == "sys_op", sys).when(kind == "env_op", F.col("var_name") == "").otherwise(True)
    return j.withColumn("declared", ok).drop(*DIMS, *made, "sensitive_access")


def step_anchors(units: DataFrame) -> DataFrame:
    """Per package: the first step of each action type, the first substantial one, the last."""
    i, kind = F.col("step_index"), F.col("action_type")
    return units.groupBy(KEY).agg(
        *[F.min(F.when(kind == a, i)).alias("first_" + a) for a in ("subprocess", "net_op", "file_op", "other")],
        F.min(F.when(~kind.isin("other", "display", "condition"), i)).alias("first_any"), F.max(i).alias("last_step"))


def best_step(ops: DataFrame, anchors: DataFrame) -> DataFrame:
    """Operations with the step that fits them best: same action, else substantial, else last."""
    j = ops.join(anchors, KEY, "left")
    same = F.lit(None).cast("int")
    for op, action in fixed.OP_TO_ACTION.items():
        same = F.when(F.col("op_type") == op, F.col("first_" + action)).otherwise(same)
    return j.withColumn("anchor", F.coalesce(same, "first_any", "last_step")).drop(*[x for x in anchors.columns if x != KEY])


def cross_edges(judged: DataFrame) -> DataFrame:
    """Declared operations are invoked by their step; undeclared risky ones are misaligned."""
    rows = judged.filter("anchor is not null")
    a, b = nl_id(F.col("anchor")), F.col("id")
    inv = _edges(rows.filter("declared"), a, b, "nl_invokes", F.concat(F.lit("implements:"), "op_type"))
    mis = _edges(rows.filter("not declared and risk >= 0.5"), a, b, "misalign", F.concat(F.lit("undeclared:"), "op_type"), F.col("risk"))
    return inv.unionByName(mis)


def covers_edges(ops: DataFrame, perms: DataFrame) -> DataFrame:
    """Permission to operation, where the permission plausibly allows it.

    A package's permissions are a short list from its manifest, so each operation filters
    that list; operations are not paired with permissions before the test.
    """
    t, s = F.lower("perm_type"), F.lower("scope")
    tests = {  # what a permission alone decides is told once per permission
        "s": s, "open": s.isin("any", "all", "project_dir", "project", "cwd"), "reads": t.contains("read"), "writes": t.contains("write"), "net": t.contains("net"),
        "runs": t.contains("exec") | t.contains("subprocess") | t.contains("shell"), "env": t.contains("env")}
    lists = perms.groupBy(KEY).agg(F.sort_array(F.collect_list(F.struct("pos", "perm_type", "scope", *[x.alias(k) for k, x in tests.items()]))).alias("perms"))
    kind, p = F.col("op_type"), F.col("p")

    def allows(x: Column) -> Column:
        scope_ok = x["open"] | ((p != "") & p.contains(x["s"]))
        io = ((x["reads"] & ~F.col("is_write")) | (x["writes"] & F.col("is_write"))) & scope_ok
        return F.when(kind == "io_op", io).when(kind == "net_op", x["net"]).when(kind == "sys_op", x["runs"]).when(kind == "env_op", x["env"]).otherwise(False)

    j = ops.select(KEY, "id", "op_type", "is_write", F.lower("file_path").alias("p")).join(lists, KEY).select(KEY, "id", F.explode(F.filter("perms", allows)).alias("x"))
    return _edges(j, F.concat_ws(":", F.lit("perm"), "x.pos", "x.perm_type", "x.scope"), F.col("id"), "covers", F.concat("x.perm_type", F.lit(":"), "x.scope"))


def edges(units: DataFrame, ops: DataFrame, perms: DataFrame, judged: DataFrame) -> DataFrame:
    return union_all([sibling_edges(units), ctrl_flow_edges(ops), cross_edges(judged), covers_edges(ops, perms)])


def instruction_graph(units: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, flow edges and declared scopes from the instructions alone."""
    return nl_nodes(units), sibling_edges(units), declared_scopes(units)


def graph_stats(node_rows: DataFrame, edge_rows: DataFrame) -> DataFrame:
    n = node_rows.groupBy(KEY, F.lit("node").alias("part"), F.col("node_type").alias("kind")).agg(F.count("*").alias("n"))
    e = edge_rows.groupBy(KEY, F.lit("edge").alias("part"), F.col("edge_type").alias("kind")).agg(F.count("*").alias("n"))
    return n.unionByName(e)


# --------------------------------------------------------------- capability alignment


def code_capabilities(ops: DataFrame) -> DataFrame:
    """Distinct scopes per package and dimension, each at its first place."""
    kind = F.col("op_type")
    dim = (F.when(kind == "io_op", F.when(F.col("is_write"), "file_write").otherwise("file_read")).when(kind == "net_op", "network")
           .when(kind == "sys_op", "subprocess").when(kind == "env_op", "env"))
    scope = (F.when(kind == "io_op", F.when(F.col("file_path") == "", "unknown_path").otherwise(F.col("file_path")))
             .when(kind == "net_op", F.when(F.col("url") == "", "unknown_domain").otherwise(c.url_domain(F.col("url"))))
             .when(kind == "sys_op", F.substring(F.when(F.col("cmd") == "", F.col("label")).otherwise(F.col("cmd")), 1, 60))
             .when(kind == "env_op", F.when(F.col("var_name") == "", "unknown_var").otherwise(F.col("var_name"))))
    rows = ops.select(KEY, dim.alias("dim"), scope.alias("scope"), "path", "line", "pos").filter("dim is not null")
    return rows.groupBy(KEY, "dim", "scope").agg(F.min(F.struct("path", "line", "pos")).alias("first"))


def normal_scopes(scope: Column) -> Column:
    """A scope without outer marks, plus its first path part when it has several."""
    s = F.regexp_replace(F.lower(scope), r"^[/~ ]+|[/~ ]+$", "")
    parts = F.split(s, r"[/\\]")
    return F.when(F.size(parts) > 1, F.array_distinct(F.array(s, F.element_at(parts, 1)))).otherwise(F.array(s))


def declared_long(scopes: DataFrame) -> DataFrame:
    """Declared scopes as one row per package and dimension, with their normal forms."""
    pairs = F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).alias("declared")) for d in DIMS])
    return scopes.select(KEY, F.inline(pairs)).withColumn(
        "normal", F.array_distinct(F.flatten(F.transform("declared", normal_scopes))))


def fuzzy_overlap(declared: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """Containment-matched overlap of two scope sets per key.

    ``declared`` has the keys and a short ``normal`` list; ``observed`` is long: the keys and
    a ``scope``.  Every observed scope looks into the declared list on its own, so a key with
    very many scopes is counted by partial aggregates.
    """
    norm = observed.select(*keys, F.explode(normal_scopes(F.col("scope"))).alias("y")).distinct()
    have = norm.join(declared.select(*keys, "normal"), keys, "left")
    own = F.coalesce("normal", c.empty_strings())
    y = F.col("y")
    # one row per observed scope, without an x, and one per declared scope it meets: all three counts in one pass
    meets = F.concat(F.array(F.lit(None).cast("string")), F.filter(own, lambda x: x.contains(y) | y.contains(x)))
    have = have.select(*keys, F.array_contains(own, y).alias("same"), F.explode(meets).alias("x"))
    met = have.groupBy(*keys, "x").agg(F.count("*").alias("n"), F.count_if("same").alias("n_same"))
    whole = F.col("x").isNull()
    sizes = met.groupBy(*keys).agg(F.sum(F.when(whole, F.col("n"))).alias("n_obs"), F.sum(F.when(whole, F.col("n_same"))).alias("n_same"), F.count("x").alias("n_match"))
    j = declared.select(*keys, F.size("normal").alias("n_dec")).join(sizes, keys, "full")
    n = lambda x: F.coalesce(F.col(x), F.lit(0))
    union = n("n_dec") + n("n_obs") - n("n_same")
    sim = F.when((n("n_dec") == 0) & (n("n_obs") == 0), 1.0).when((n("n_dec") == 0) | (n("n_obs") == 0), 0.0).otherwise(n("n_match") / union)
    return j.select(*keys, sim.alias("similarity"))


def over_reach_rows(caps: DataFrame, declared: DataFrame) -> DataFrame:
    """Observed scopes that no declared scope covers, each with its weight and a gap text."""
    j = caps.join(declared.select(KEY, "dim", "declared"), [KEY, "dim"], "left").withColumn("declared", F.coalesce("declared", c.empty_strings()))
    j = j.withColumn("base", F.when(F.col("dim") == "subprocess", F.coalesce(F.get(c.words(F.col("scope")), F.lit(0)), F.col("scope"))))
    j = j.withColumns({"low_scope": F.lower("scope"), "low_base": F.lower("base"), "low_declared": F.transform("declared", F.lower)})
    scope, dim, base = F.col("scope"), F.col("dim"), F.col("base")
    near = lambda low: F.exists("low_declared", lambda d: low.contains(d) | d.contains(low))
    w = fixed.DIMENSION_WEIGHTS
    runs = (base.contains("eval") | base.contains("exec")) & (F.size("declared") == 0)
    gap = lambda weight, text: F.struct(F.lit(weight).alias("weight"), text.alias("gap"))
    missing = lambda what, v: F.concat(F.lit(what + ": '"), v, F.lit("' not declared in NL"))
    g = (
        F.when((dim == "file_read") & c.is_high_risk_scope(scope) & ~near(F.col("low_scope")), gap(w["file_read"] * 1.5, missing("file_read", scope)))
        .when((dim == "file_write") & ~near(F.col("low_scope")) & ~c.is_benign_scope(scope), gap(w["file_write"], missing("file_write", scope)))
        .when((dim == "network") & ~scope.isin(fixed.UNSCORED_DOMAINS) & ~near(F.col("low_scope")) & c.is_external_b(F.concat(F.lit("https://"), scope)),
              gap(w["network"], missing("network", scope)))
        .when((dim == "subprocess") & runs, gap(w["subprocess"] * 1.5, F.lit("subprocess: dangerous eval/exec not declared")))
        .when((dim == "subprocess") & ~runs & ~near(F.col("low_base")) & ~base.isin(fixed.COMMON_TOOLS), gap(w["subprocess"] * 0.5, missing("subprocess", base))))
    return j.withColumn("g", g).filter("g is not null").select(KEY, "dim", "scope", "first", F.col("g.weight").alias("weight"), F.col("g.gap").alias("gap"))


def top_gaps(rows: DataFrame, n: int | None = None) -> DataFrame:
    order = c.ranked(F.col("dim"), DIMS)
    return first_rows(rows.withColumn("o", order), [KEY], [F.col("o"), F.col("first"), F.col("scope")], n)


def declared_of(packages: DataFrame, scopes: DataFrame) -> DataFrame:
    """Declared scopes per package and dimension, empty where the instructions declare none."""
    return declared_long(_scopes_or_empty(packages.join(scopes, KEY, "left")))


def alignment(packages: DataFrame, caps: DataFrame, scopes: DataFrame, misaligned: DataFrame, analyzability: DataFrame, reaching: DataFrame | None = None) -> DataFrame:
    """Cross-modal gap per package: over-reach, overlap, how far code can be read, misaligned edges.

    ``reaching`` takes the ``over_reach_rows`` of these packages where they are known already.
    """
    declared = declared_of(packages, scopes)
    sim = fuzzy_overlap(declared, caps.filter(F.col("dim").isin(DIMS)), [KEY, "dim"])
    w = F.lit(0.0)
    for d in DIMS:
        w = F.when(F.col("dim") == d, fixed.DIMENSION_WEIGHTS[d]).otherwise(w)
    align = sim.groupBy(KEY).agg(F.sum(w * F.col("similarity")).alias("align_score"))
    reaching = over_reach_rows(caps, declared) if reaching is None else reaching
    over = reaching.groupBy(KEY).agg(F.least(F.lit(1.0), F.sum("weight")).alias("over_reach"))
    mis = misaligned.groupBy(KEY).agg(F.count("*").alias("misalign_count"))
    j = packages.join(align, KEY, "left").join(over, KEY, "left").join(mis, KEY, "left").join(analyzability, KEY, "left")
    z = lambda x, v: F.coalesce(F.col(x), F.lit(v))
    raw = 0.60 * z("over_reach", 0.0) + 0.40 * (F.lit(1.0) - z("align_score", 0.90))
    al = z("analyzability", 0.5)
    amp = F.when(al < 0.8, F.least(F.lit(1.0), raw * (F.lit(1.0) + (F.lit(0.8) - al) * 0.5))).otherwise(raw)
    m = z("misalign_count", 0)
    total = F.when(m > 0, F.least(F.lit(1.0), amp + m * 0.05)).otherwise(amp)
    return j.select(KEY, z("over_reach", 0.0).alias("over_reach"), z("align_score", 0.90).alias("align_score"), m.alias("misalign_count"), al.alias("analyzability"), total.alias("alignment_gap"))


# ------------------------------------------------------------------ taint and chains


def propagate_taint(ops: DataFrame, flows: DataFrame) -> DataFrame:
    """Operations that sources reach over data-flow edges; sources themselves included."""
    source = F.col("op_type").isin("net_op", "env_op") | ((F.col("op_type") == "io_op") & (F.col("file_path") != "") & c.is_sensitive_b(F.col("file_path")))
    links = flows.filter(F.col("edge_type").isin("data_flow", "taint"))
    return closure(ops.filter(source).select(KEY, "id"), links).select(KEY, "id").distinct()


def tainted_risk(ops: DataFrame, tainted: DataFrame) -> DataFrame:
    return ops.filter("op_type = 'sys_op'").join(tainted, [KEY, "id"], "left_semi").groupBy(KEY).agg(F.max("risk").alias("taint_risk"))


def is_sensitive_read() -> Column:
    return (F.col("op_type") == "io_op") & c.has_any(F.lower("file_path"), fixed.SENSITIVE_PREFIXES)


def is_external_call() -> Column:
    return (F.col("op_type") == "net_op") & c.has_any(F.lower("url"), fixed.URL_SCHEMES)


def _chain_ends() -> dict[str, tuple[Column, Column]]:
    """Where each kind of chain starts and ends."""
    dynamic = (F.col("op_type") == "sys_op") & F.col("cmd_dynamic")
    return {"theft": (is_sensitive_read(), is_external_call()), "env": (F.col("op_type") == "env_op", is_external_call()), "fetch": (F.col("op_type") == "net_op", dynamic)}


def _chain_text(key: str, target: str = "target.") -> Column:
    at = lambda p: F.concat(F.col(p + "path"), F.lit(":"), F.col(p + "line").cast("string"))
    s = F.lit
    return {
        "theft": F.concat(s("Sensitive read «"), "file_path", s("» ("), at(""), s(") flows to external network call «"), target + "url", s("» ("), at(target), s(")")),
        "env": F.concat(s("Env var «"), "var_name", s("» ("), at(""), s(") flows to external endpoint «"), target + "url", s("» ("), at(target), s(")")),
        "fetch": F.concat(s("Network fetch ("), at(""), s(") flows to dynamic exec/eval «"), target + "label", s("» ("), at(target), s(")")),
        "stay": F.concat(s("Write to persistence path «"), "file_path", s("» at "), at("")),
    }[key]


def _chain_rows(df: DataFrame, key: str) -> DataFrame:
    name, severity, category = fixed.OP_CHAINS[key]
    return df.select(KEY, F.lit(name).alias("name"), F.lit(severity).alias("severity"), F.lit(category).alias("category"), F.col("id").alias("node"), "path", "line", _chain_text(key).alias("description"))


def op_chains(ops: DataFrame) -> DataFrame:
    """Dangerous sequences inside files, and writes to start-up files, in one pass over the operations."""
    carry = [F.col(x) for x in ("id", "path", "line", "label", "url")]
    ends = _chain_ends()
    near = ops.withColumns({"to_" + key: next_within(b, fixed.OP_CHAIN_REACH[key], carry, order=("line", "pos", "id")) for key, (_, b) in ends.items()})
    tests = {key: a & F.col("to_" + key).isNotNull() for key, (a, _) in ends.items()}
    tests["stay"] = (F.col("op_type") == "io_op") & F.col("is_write") & c.is_startup_file(F.col("file_path"), fixed.STARTUP_FILES_B)
    marks = [F.when(test, F.struct(*[F.lit(v).alias(k) for k, v in zip(("name", "severity", "category"), fixed.OP_CHAINS[key])], _chain_text(key, f"to_{key}.").alias("description")))
             for key, test in tests.items()]
    rows = near.select(KEY, F.col("id").alias("node"), "path", "line", F.array_compact(F.array(*marks)).alias("found")).filter(F.size("found") > 0)
    return rows.select(KEY, "node", "path", "line", F.inline("found")).select(KEY, "name", "severity", "category", "node", "path", "line", "description")


def flow_chains(ops: DataFrame, flows: DataFrame) -> DataFrame:
    """Dangerous sequences over supplied edges (skill_id, from_id, to_id, edge_type), across files.

    Data-flow, control-flow and taint edges count.  Of the ends within reach the nearest is
    reported, the first by path, line and place where several are equally near.
    """
    links = flows.filter(F.col("edge_type").isin("data_flow", "ctrl_flow", "taint"))
    found = []
    for key, (start, end) in _chain_ends().items():
        hit = nearest_targets(ops.filter(start), ops.filter(end), links, fixed.OP_CHAIN_REACH[key], ["path", "line", "pos", "label", "url"])
        found.append(_chain_rows(ops.filter(start).join(hit, [KEY, "id"]), key))
    return union_all(found)


def step_escalation(units: DataFrame, flow: DataFrame, misaligned: DataFrame) -> DataFrame:
    """Step sequences along which undeclared operations pile up.

    A step's way on is its latest flow edge; sequences are the chains these form, from their
    first directive on.  Misaligned edges count at the step they start from.
    """
    index = lambda x: F.substring_index(x, ":", -1).cast("int")
    order = F.when(F.col("label") == "enter", 2).when(F.col("label") == "skip", 1).otherwise(0)
    way = flow.select(KEY, index(F.col("from_id")).alias("a"), index(F.col("to_id")).alias("b"), order.alias("o")).filter("b > a")
    way = way.groupBy(KEY, "a").agg(F.max(F.struct("o", "b")).alias("m")).select(KEY, "a", F.col("m.b").alias("b"))
    up = way.groupBy(KEY, "b").agg(F.min("a").alias("up_id")).withColumnRenamed("b", "id")
    base = units.select(KEY, F.col("step_index").alias("id"))
    chain = roots(base.join(up, [KEY, "id"], "left"))
    bad = misaligned.select(KEY, index(F.col("from_id")).alias("id")).distinct().withColumn("bad", F.lit(True))
    shown = nl_nodes(units).select(KEY, F.col("line").alias("id"), "node_type", F.substring("label", 1, 50).alias("label"))
    rows = chain.join(shown, [KEY, "id"]).join(bad, [KEY, "id"], "left")
    start = rows.groupBy(KEY, "root").agg(F.min(F.when(F.col("node_type") == "nl_directive", F.col("id"))).alias("start"))
    rows = rows.join(start, [KEY, "root"]).filter("id >= start")
    per = rows.groupBy(KEY, "root").agg(F.min("id").alias("head"), F.count("*").alias("n"), F.count("bad").alias("m")).filter("m >= 2 or (n >= 3 and m >= 1)")
    # A sequence may be of any length; each task keeps its first four steps before the shuffle.
    told = first_rows(rows.select(KEY, "root", "id", "label"), [KEY, "root"], [F.col("id")], 4)
    hit = per.join(told.groupBy(KEY, "root").agg(F.array_sort(F.collect_list(F.struct("id", "label"))).alias("first")), [KEY, "root"])
    names = F.array_join(F.transform("first", lambda x: F.concat(F.lit("«"), x["label"], F.lit("»"))), " → ")
    return hit.select(KEY, *[F.lit(v).alias(k) for k, v in zip(("name", "severity", "category"), fixed.OP_CHAINS["steps"])],
                      nl_id(F.col("head")).alias("node"), F.lit("SKILL.md").alias("path"), F.col("head").alias("line"),
                      F.concat(F.col("n").cast("string"), F.lit("-step NL chain with "), F.col("m").cast("string"),
                               F.lit(" undeclared code capability misaligns. Steps: "), names).alias("description"))


def dedupe_chains(chains: DataFrame) -> DataFrame:
    """First chain per category and first node."""
    return first_rows(chains, [KEY, "category", "node"], [F.col("name"), F.col("description")])


def context_lines(scopes: DataFrame, caps: DataFrame, judged: DataFrame, scores: DataFrame) -> DataFrame:
    """Declared against observed, as summary lines in order: section, sequence, text.

    One row per line, so a package with very many capabilities stays many short rows.
    """
    s = F.lit
    said = declared_long(_scopes_or_empty(scopes)).select(KEY, F.lit(1).alias("section"), "dim", F.explode("declared").alias("scope"))
    did = caps.filter(F.col("dim").isin(DIMS)).select(KEY, F.lit(2).alias("section"), "dim", "scope")
    listed = said.unionByName(did).select(KEY, "section", F.concat("dim", s(": "), "scope").alias("text"))
    gaps = judged.filter("not declared and risk >= 0.5 and anchor is not null")
    gap = gaps.select(KEY, F.lit(3).alias("section"), F.concat("label", F.format_string(" (risk=%.0f%%) at ", F.col("risk") * 100), "path", s(":"), F.col("line").cast("string"),
                                                               s(" — undeclared:"), "op_type").alias("text"))
    num = scores.select(KEY, F.lit(4).alias("section"), F.format_string("code=%.2f alignment=%.2f", "s2", "s3").alias("text"))
    return union_all([listed, gap, num])
