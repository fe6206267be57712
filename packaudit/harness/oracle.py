"""The same results in plain SQL, derived from the tables on their own, not from the operators."""

from __future__ import annotations

from packaudit.functions import fixed
from packaudit.harness.views import PHRASES

ORACLE: dict[str, str] = {}


def _with(*parts: str, recursive: bool = False) -> str:
    return ("with recursive " if recursive else "with ") + ",\n".join(parts) + "\n"


LICENSE, ADDRESS = "(?i)licen[cs]e|copyright", "[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}"
MAIL, SECRET, PACKED, ENDING = "(?i)[a-z0-9._-]+@[a-z0-9-]+\\.[a-z]", "(?i)token|secret|passw|api[_-]?key", "(?i)[a-z0-9+/]{40}", "(?i)tion[.]"

# name, pattern, severity, rank, category, types it skips
_RULES = [
    ("license", LICENSE, "MEDIUM", 2, "SupplyChainPoisoning", "''"), ("address", ADDRESS, "HIGH", 3, "DataExfiltration", "'doc'"),
    ("mail", MAIL, "LOW", 1, "DataExfiltration", "''"), ("secret", SECRET, "CRITICAL", 4, "CredentialTheft", "'py'"),
    ("packed", PACKED, "MEDIUM", 2, "Obfuscation", "'doc','py'"), ("ending", ENDING, "LOW", 1, "Unknown", "''"),
]
LINES = """lines as (select source as skill_id, cast(doc_id as varchar) as path, case lang when 'en' then 'py' when 'de' then 'doc' else 'other' end as kind,
  i as line, t[i] as text from (select *, string_split(text, chr(10)) as t from documents) d, unnest(range(1, len(t) + 1)) as u(i))"""


def _hits(scoped: bool) -> str:
    comment = " and not starts_with(trim(text), '#')"
    return "hits as (" + " union all ".join(
        f"select skill_id, path, line, text, {i} as pos, '{n}' as rule, '{s}' as severity, {r} as rank, '{cat}' as category from lines "
        f"where regexp_matches(text, '{p}')" + comment + (f" and kind not in ({skip})" if scoped else "")
        for i, (n, p, s, r, cat, skip) in enumerate(_RULES)) + ")"


HITS = _hits(True)
W4 = "case severity when 'CRITICAL' then 1.0 when 'HIGH' then 0.7 when 'MEDIUM' then 0.4 when 'LOW' then 0.15 else 0 end"

ORACLE["line_explode"] = _with(LINES) + "select skill_id, path, line, text from lines"
ORACLE["rule_scan_lines"] = _with(LINES, _hits(False)) + "select skill_id, path, line, rule, severity from hits"
ORACLE["rule_scan_scoped"] = _with(LINES, HITS) + "select skill_id, path, line, rule, category from hits"
ORACLE["high_entropy_literals"] = """
with w as (select distinct source as skill_id, cast(doc_id as varchar) as path, word from (select *, unnest(regexp_split_to_array(text, '\\s+')) as word from documents) where length(word) > 14),
c as (select skill_id, path, word, ch, count(*) as n from (select *, unnest(string_split(word, '')) as ch from w) where ch <> '' group by all),
e as (select skill_id, path, word, -sum(n / cast(length(word) as double) * log2(n / cast(length(word) as double))) as bits from c group by all)
select skill_id, path, word as value, round(bits, 6) as bits from e where bits > 3.2"""

_WEIGHTED = [("license", 0.60, LICENSE), ("address", 0.70, ADDRESS), ("mail", 0.50, MAIL), ("secret", 0.95, SECRET)]


def _weighted(key: str) -> str:
    h = " union all ".join(f"select {key} as skill_id, '{n}' as name, {w} as weight from documents where regexp_matches(text, '{p}')" for n, w, p in _WEIGHTED)
    return f"""with h as ({h}), d as (select skill_id, max(cast(weight as double)) as top, count(distinct name) as n from h group by 1),
f as (select skill_id, n as distinct_rules, case when n > 1 then least(1.0, top + 0.1 * (n - 1)) else top end as c from d)
select skill_id, distinct_rules, round(c, 6) as confidence, c >= 0.7 as detected from f"""


ORACLE["weighted_rules_confidence"] = _weighted("source")
ORACLE["weighted_rules_per_text"] = _weighted("cast(doc_id as varchar)")
ORACLE["tiered_confidence"] = f"""
with h as (select cast(doc_id as varchar) as skill_id, regexp_matches(text, '{SECRET}')::int + regexp_matches(text, '{ADDRESS}')::int as tier1,
  regexp_matches(text, '{LICENSE}')::int as tier2, regexp_matches(text, '{PACKED}')::int as hidden from documents),
c as (select *, least(1.0, 0.7 * least(1.0, tier1 * 0.6) + 0.2 * least(1.0, tier2 * 0.4) + 0.1 * least(1.0, hidden * 0.5)) as b from h where tier1 + tier2 + hidden > 0),
d as (select *, case when tier1 >= 2 then greatest(b, 0.9) else b end as f from c)
select skill_id, cast(tier1 as bigint) as tier1, cast(tier2 as bigint) as tier2, cast(hidden as bigint) as hidden, round(cast(f as double), 6) as confidence, f > 0.4 as is_injection from d"""


def _flood(key: str, length: int, lines: int, chars: int, share: float, out: str) -> str:
    return f"""
with s as (select {key} as k, sum(length(text)) + 2 * (count(*) - 1) as chars, sum(len([x for x in string_split(text, chr(10)) if length(x) > {length}])) as n from documents group by 1),
w as (select {key} as k, unnest(regexp_split_to_array(lower(text), '\\s+')) as word from documents where {key} in (select k from s where chars > {chars})),
c as (select k, word, count(*) as n from w where word <> '' group by 1, 2),
r as (select *, row_number() over (partition by k order by n desc, word desc) as rn, sum(n) over (partition by k) as total from c)
select k as {out}, 'context_bomb:long_lines=' || cast(n as bigint) as name from s where n > {lines}
union all select k, 'context_bomb:word_repetition=' || word || ':' || printf('%.2f', n / total) from r where rn = 1 and n / total > {share}"""


ORACLE["repeat_flood"] = _flood("source", 400, 60, 5000, 0.02, "skill_id")
ORACLE["repeat_flood_per_text"] = _flood("cast(doc_id as varchar)", 200, 20, 1500, 0.06, "path")
ORACLE["encoded_runs"] = """
with r as (select source as skill_id, cast(doc_id as varchar) as path, i - 1 as pos, m[i] as run from (select *, regexp_extract_all(text, '[A-Za-z0-9+/]{40,}') as m from documents) d, unnest(range(1, len(m) + 1)) as u(i))
select skill_id, path, pos, run from r"""

# ---------------------------------------------------------------------------- findings

ORACLE["finding_dedupe"] = _with(LINES, HITS) + """, f as (select *, rule || ': line' as description, 'pattern' as analyzer from hits
 union all select skill_id, path, line, text, pos + 10, rule, severity, rank, category, rule || ': line', 'second' from hits)
select skill_id, analyzer, category, path, line, description, cast(pos as bigint) as pos from
 (select *, row_number() over (partition by skill_id, category, path, line, description order by pos) as rn from f) where rn = 1"""
ORACLE["finding_topn"] = _with(LINES, HITS) + """select skill_id, severity, path, line, rule as evidence from
 (select *, row_number() over (partition by skill_id order by rank desc, path, line, pos) as rn from hits) where rn <= 5"""
ORACLE["finding_numbering"] = _with(LINES, HITS) + """select skill_id, path, line, rule as evidence, row_number() over (partition by skill_id order by path, line, pos) - 1 as finding_index from hits"""
ORACLE["anti_duplicate_hits"] = _with(LINES, HITS) + """select skill_id, path, line, rule as evidence from hits h where not exists (select 1 from hits o
 where o.skill_id = h.skill_id and o.path = h.path and o.severity in ('HIGH', 'CRITICAL') and h.rule = 'ending')"""
ORACLE["package_severity"] = _with(LINES, HITS) + """select skill_id, arg_max(severity, rank) as max_severity, max(rank) = 4 as has_critical, count(*) as n_findings from hits group by 1"""
_SCORE = f"score as (select path, count(*) as n, 1 / (1 + exp(-6.0 * (max({W4}) + least(0.15, count(*) * 0.02) - 0.55))) as s from hits group by 1)"
_VERDICT = """v as (select cast(doc_id as varchar) as skill_id, cast(coalesce(s, 0) as double) as s, case when coalesce(s, 0) >= 0.85 then 'BLOCK' when coalesce(s, 0) >= 0.65 then 'REVIEW'
 when coalesce(s, 0) >= 0.35 then 'WARN' else 'PASS' end as verdict from documents left join score on path = cast(doc_id as varchar))"""
ORACLE["severity_score_logistic"] = _with(LINES, HITS, _SCORE) + "select path, round(cast(s as double), 6) as code_threat, n as n_findings from score"
ORACLE["verdict_ladder"] = _with(LINES, HITS, _SCORE, _VERDICT) + "select skill_id, round(s, 6) as code_threat, verdict from v"
ORACLE["batch_summary"] = _with(LINES, HITS, _SCORE, _VERDICT) + "select verdict, count(*) as n_packages from v group by 1"
ORACLE["worst_verdict"] = _with(LINES, HITS, _SCORE, _VERDICT) + """select arg_max(verdict, case verdict when 'BLOCK' then 3 when 'REVIEW' then 2 when 'WARN' then 1 else 0 end) as worst_verdict,
 count(*) as n_packages from v"""
_OUTCOME = """o as (select v.skill_id, verdict, toxic = 1 as is_malicious, verdict in ('BLOCK', 'REVIEW') as flagged,
 case when toxic = 1 then case when verdict in ('BLOCK', 'REVIEW') then 'TP' else 'FN' end when verdict in ('BLOCK', 'REVIEW') then 'FP' else 'TN' end as outcome
 from v join labels on v.skill_id = cast(doc_id as varchar))"""
ORACLE["label_outcomes"] = _with(LINES, HITS, _SCORE, _VERDICT, _OUTCOME) + "select * from o"
ORACLE["confusion_matrix"] = _with(LINES, HITS, _SCORE, _VERDICT, _OUTCOME) + """, c as (select count(*) filter (outcome = 'TP') as tp, count(*) filter (outcome = 'TN') as tn,
 count(*) filter (outcome = 'FP') as fp, count(*) filter (outcome = 'FN') as fn from o),
r as (select *, coalesce(tp / nullif(tp + fp, 0), 0) as p, coalesce(tp / nullif(tp + fn, 0), 0) as q from c)
select tp, tn, fp, fn, round(cast(p as double), 6) as precision, round(cast(q as double), 6) as recall, round(cast(coalesce(fp / nullif(fp + tn, 0), 0) as double), 6) as fpr,
 round(cast((tp + tn) / (tp + tn + fp + fn) as double), 6) as accuracy, round(cast(coalesce(2 * p * q / nullif(p + q, 0), 0) as double), 6) as f1 from r"""
ORACLE["check_scores"] = _with(LINES, HITS) + """select skill_id, round(cast(least(1.0, max(case severity when 'CRITICAL' then 0.85 when 'HIGH' then 0.55 when 'MEDIUM' then 0.30 when 'LOW' then 0.10 else 0.05 end)
 + 0.05 * greatest(0, count(*) filter (severity in ('CRITICAL', 'HIGH')) - 1)) as double), 6) as check_score from hits group by 1"""
ORACLE["filtered_scores"] = _with(LINES, HITS) + """, n as (select *, row_number() over (partition by skill_id order by path, line, pos) - 1 as i from hits),
d as (select source as skill_id, count(*) as c from documents group by 1),
w as (select n.skill_id, case severity when 'CRITICAL' then 0.90 when 'HIGH' then 0.65 when 'MEDIUM' then 0.30 else 0.10 end
 * case when severity in ('CRITICAL', 'HIGH') and i % 2 = 0 then case when (i + c) % 3 = 0 then 1.0 else 0.0 end else 0.5 end as s from n join d on d.skill_id = n.skill_id)
select skill_id, round(cast(max(s) as double), 6) as filtered_score from w group by 1"""

# -------------------------------------------------------------------------------- URLs

_DOMAIN = "regexp_extract(url, '^https?://([^/:?#]+)', 1)"
_TRUSTED = " or ".join(f"contains(lower(url), '{x}')" for x in (
    "github.com", "raw.githubusercontent.com", "pypi.org", "files.pythonhosted.org", "registry.npmjs.org", "cdn.jsdelivr.net", "storage.googleapis.com",
    "s3.amazonaws.com", "anthropic.com", "openai.com", "huggingface.co"))
_URLS = f"""u as (select {_DOMAIN} as skill_id, url, min(page_id) as first from pages group by 1, 2),
k as (select * from u where not ({_TRUSTED}))"""
ORACLE["url_domains"] = f"select page_id, case when {_DOMAIN} <> '' then {_DOMAIN} else url[1:50] end as domain from pages"
ORACLE["urls_to_check"] = _with(_URLS) + "select skill_id, url from k"
ORACLE["reputation_join"] = _with(_URLS) + """, r as (select *, case when length(url) % 3 = 0 then length(url) % 5 else 0 end as m, length(url) % 2 as s, 2 + length(url) % 7 as rest from k)
select skill_id, case when m > 0 then 'CRITICAL' else 'HIGH' end as severity, 'link:' || url as evidence,
 round(cast(least(1.0, case when m > 0 then m / greatest(m + rest, 5) else s / greatest(s + rest, 3) end) as double), 6) as confidence from r where m > 0 or s > 0"""

# ------------------------------------------------------------ events as code operations

EV = """ev as (select 'u' || user_id as skill_id, 'scripts/b' || (event_id // 256) || '.py' as path, event_id, event_id // 256 as block, event_id % 256 + 1 as line,
 cast(regexp_extract(props, '([0-9]+)', 1) as int) as k, event_type as t from events)"""
OP = """op as (select *, 'code:' || event_id as id,
 case t when 'click' then 'net_op' when 'view' then 'io_op' when 'purchase' then 'env_op' else 'sys_op' end as op_type,
 case when t = 'error' and k % 2 = 0 then case when k % 8 = 0 then 'crontab d' else 'make -C d' end || k else '' end as cmd,
 case when t = 'click' and k % 2 = 0 then 'https://h' || k || '.example.net/e' else '' end as url,
 case when t = 'view' then case when k % 10 = 0 then '/home/x/.ssh/id_rsa' else 'data/f' || k || '.csv' end else '' end as file_path,
 case when t = 'purchase' then 'SHOP_VAR_' || k else '' end as var_name,
 t = 'view' and k % 3 = 0 as is_write, t = 'view' and k % 10 = 0 as is_sensitive, t = 'click' and k % 2 = 0 as is_external, t = 'signup' or (t = 'error' and k % 4 = 1) as dyn from ev)"""
OP2 = """ops as (select *,
 case t when 'click' then case when url <> '' then 'requests.get(' || url || '))' else 'requests.post(...))' end
  when 'view' then case when is_write then 'write(' else 'read(' end || file_path || '))'
  when 'error' then case when cmd <> '' then 'os.system(' || cmd || '))' else 'subprocess.run(...))' end
  when 'purchase' then 'env[' || var_name || ']' else 'eval(...))' end as label,
 case op_type when 'io_op' then case when is_sensitive then 0.85 when is_write then 0.45 else 0.25 end when 'net_op' then case when is_external then 0.65 else 0.35 end
  when 'sys_op' then case when dyn then 0.85 else 0.55 end else 0.30 end as risk from op)"""
OPS = f"{EV}, {OP}, {OP2}"
IO = """io as (select skill_id, path, line, k, case when t in ('click', 'error') then 'effect' when t = 'view' and is_write then 'output' else 'input' end as kind,
 case t when 'click' then 'network_request' when 'error' then 'subprocess' when 'purchase' then 'env_var' else case when is_write then 'file_write' else 'file_read' end end as subtype,
 case t when 'click' then case when url = '' then '<dynamic>' else url end when 'error' then case when cmd <> '' then cmd when dyn then '<dynamic>' else 'tool' || k || ' --n' end
  when 'view' then file_path else var_name end as detail from op where t <> 'signup'
 union all select skill_id, path, line, k, 'sensitive_read', 'path', file_path from op where is_sensitive
 union all select skill_id, path, line, k, 'sensitive_read', 'env', 'env:' || var_name from op where t = 'purchase' and k % 5 = 0)"""
FLAGS = """fl as (select skill_id, path, any_value(block) as block, bool_or(t = 'signup') as dyn, bool_or(k % 17 = 0) as obf, bool_or(k % 19 = 0) as packed from ev group by 1, 2)"""

ORACLE["builtin_rules_scripts"] = _with(EV) + """select skill_id, 'HIGH' as severity, 'Persistence' as category, count(*) as n from ev where t = 'error' and k % 8 = 0 group by 1
 union all select skill_id, 'MEDIUM', 'Obfuscation', count(*) from ev where t = 'click' and k % 2 = 1 and k % 5 = 0 group by 1"""
ORACLE["package_flags"] = _with(EV, FLAGS) + """select skill_id, bool_or(obf) as has_obfuscation, bool_or(packed) as has_encoded_payloads, bool_or(dyn) as has_dynamic_execution,
 round(avg(case when dyn then 0.3 else 1.0 end), 6) as mean_analyzability, cast(min(case when dyn then 0.3 else 1.0 end) as double) as min_analyzability, count(*) as n_files from fl group by 1"""
ORACLE["external_url_distinct"] = _with(OPS) + "select distinct skill_id, url from ops where url <> ''"
ORACLE["op_risks"] = _with(OPS) + "select id, op_type, cast(risk as double) as risk from ops"
_SCORED = """s as (select *, case when op_type = 'sys_op' then case when contains(label, 'eval') and dyn then 0.95 when dyn then 0.80 when cmd <> '' then 0.40 else 0 end
  when op_type = 'net_op' then case when is_external then 0.60 else 0.20 end when op_type = 'io_op' then case when is_sensitive then 0.85 when is_write then 0.45 else 0 end else 0.25 end as score,
 case when op_type = 'sys_op' then case when contains(label, 'eval') then 'eval/exec with dynamic source' else 'Subprocess with variable command' end
  when op_type = 'net_op' then 'External HTTP call to ' || url else 'Sensitive path access: ' || file_path end || ' at ' || path || ':' || line as description from ops)"""
ORACLE["op_score_topn"] = _with(OPS, _SCORED) + """select skill_id, id, cast(score as double) as score, description from
 (select *, row_number() over (partition by skill_id order by score desc, path, line) as rn from s where score >= 0.5) where rn <= 10"""
ORACLE["hiding_scores"] = _with(OPS) + "select skill_id, round(cast(least(0.30, 0.15 * count(*) filter (op_type = 'sys_op' and dyn)) as double), 6) as hiding_score from ops group by 1"
ORACLE["ctrl_flow_edges"] = _with(OPS) + """select skill_id, from_id, to_id from (select skill_id, id as from_id, lead(id) over (partition by skill_id, path order by line) as to_id from ops) where to_id is not null"""
ORACLE["reach_within_k"] = _with(OPS) + """, n as (select *, row_number() over (partition by skill_id, event_id // 8192 order by event_id) as rn, event_id // 8192 as f from ops)
select skill_id, id as source, tid as target, turl as url from (select a.skill_id, a.id, b.id as tid, b.url as turl, row_number() over (partition by a.id order by b.rn) as o from n a join n b
 on a.skill_id = b.skill_id and a.f = b.f and b.rn between a.rn + 1 and a.rn + 6 and a.is_sensitive and b.url <> '') where o = 1"""
ORACLE["flow_chain_targets"] = _with(OPS, """n as (select *, lead(id) over w as n1, lead(id, 2) over w as n2, lag(id, 3) over w as n3 from ops window w as (partition by skill_id, event_id // 8192 order by event_id))""",
    """e as (select id as a, n1 as b from n where n1 is not null and event_id % 3 <> 0 union select id, n2 from n where n2 is not null and event_id % 4 = 1 union select id, n3 from n where n3 is not null and event_id % 5 = 0)""",
    """s as (select id, 'theft' as kind, 6 as k from ops where is_sensitive union all select id, 'env', 5 from ops where op_type = 'env_op' union all select id, 'fetch', 5 from ops where op_type = 'net_op')""",
    """r as (select s.id, s.kind, s.k, e.b as node, 1 as d from s join e on e.a = s.id union select r.id, r.kind, r.k, e.b, d + 1 from r join e on e.a = r.node where d < r.k)""", recursive=True) + """
select skill_id, kind, source, depth, target from (
 select t.skill_id, r.kind, r.id as source, r.d as depth, t.id as target, row_number() over (partition by r.id, r.kind order by r.d, t.path, t.line, t.id) as o
 from r join ops t on t.id = r.node and case when r.kind = 'fetch' then t.op_type = 'sys_op' and t.dyn else t.url <> '' end) where o = 1"""
ORACLE["op_chains"] = _with(OPS) + """, n as (select *, row_number() over (partition by skill_id, path order by line) as rn from ops),
p as (select a.skill_id, a.id as node, a.op_type, a.is_sensitive, b.rn - a.rn as d, b.url <> '' as ext, b.op_type = 'sys_op' and b.dyn as run from n a join n b
 on a.skill_id = b.skill_id and a.path = b.path and b.rn between a.rn + 1 and a.rn + 6)
select distinct skill_id, 'T1-CredentialTheft' as category, 'CRITICAL' as severity, node from p where is_sensitive and ext
union all select distinct skill_id, 'T3-DataExfiltration', 'HIGH', node from p where op_type = 'env_op' and ext and d <= 5
union all select distinct skill_id, 'T5-RemoteCodeExecution', 'CRITICAL', node from p where op_type = 'net_op' and run and d <= 5"""
_TEXTLINE = "x as (select *, row_number() over (partition by skill_id, path order by event_id) + 1 as tl from ops)"
_FALSE = "false as is_write, false as is_sensitive, false as is_external, false as cmd_dynamic"
ORACLE["python_code_ops"] = _with(OPS, _TEXTLINE) + """select skill_id, path, tl as line, op_type, label, file_path, url, cmd, var_name, is_write, is_sensitive, is_external, dyn as cmd_dynamic, cast(risk as double) as risk from x
union all select skill_id, path, tl, 'io_op', 'sensitive_ref(' || file_path || ')', file_path, '', '', '', false, true, false, false, 0.85 from x where is_sensitive
union all select skill_id, path, tl, 'net_op', 'url_literal(' || url || ')', '', url, '', '', false, false, true, false, 0.65 from x where url <> ''"""
ORACLE["python_script_io"] = _with(EV, OP) + """, i as (
 select skill_id, path, 'output' as kind, case when url = '' then 'network_post' else 'network_get' end as subtype, case when url = '' then '<dynamic>' else url end as detail from op where t = 'click'
 union all select skill_id, path, 'effect', 'network_request', case when url = '' then '<dynamic>' else url end from op where t = 'click'
 union all select skill_id, path, 'effect', 'subprocess', case when cmd <> '' then cmd when dyn then '<dynamic>' else 'tool' || k || ' --n' end from op where t = 'error'
 union all select skill_id, path, case when is_write then 'output' else 'input' end, case when is_write then 'file_write' else 'file_read' end, file_path from op where t = 'view'
 union all select skill_id, path, 'input', 'env_var', var_name from op where t = 'purchase'
 union all select distinct skill_id, path, 'sensitive_read', 'path', file_path from op where is_sensitive
 union all select distinct skill_id, path, 'output', 'stdout', 'print/stdout' from op)
select skill_id, path, kind, subtype, detail, count(*) as n from i group by all"""
ORACLE["python_call_findings"] = _with(OPS, _TEXTLINE) + """select skill_id, path, tl as line, 'CRITICAL' as severity, 'RemoteCodeExecution' as category, 'Dynamic code execution: eval() with dynamic argument' as description,
 'eval' as evidence, 1 as n from x where t = 'signup'
union all select skill_id, path, tl, 'MEDIUM', 'DataExfiltration', 'External network call: requests.get() to ' || url, url, 1 from x where url <> ''
union all select skill_id, path, tl, 'CRITICAL', 'CredentialTheft', 'Sensitive file access: ' || file_path, file_path, 1 from x where is_sensitive
union all select skill_id, path, tl, 'MEDIUM', 'CommandInjection', 'Subprocess with partially dynamic args: subprocess.run(tool' || k || ', ...)', 'tool' || k, 1 from x where t = 'error' and k % 4 = 3
union all select skill_id, path, tl, 'MEDIUM', 'CommandInjection', 'Subprocess with fully dynamic command: subprocess.run()', 'subprocess.run', 1 from x where t = 'error' and k % 4 = 1"""
ORACLE["python_file_flags"] = _with(EV, FLAGS) + """select skill_id, path, cast(case when dyn then 0.3 else 1.0 end as double) as analyzability, false as has_obfuscation, dyn as has_dynamic_execution,
 false as has_encoded_payloads, false as entry_point from fl"""
ORACLE["code_capabilities"] = _with(OPS) + """select distinct skill_id, case op_type when 'io_op' then case when is_write then 'file_write' else 'file_read' end when 'net_op' then 'network' when 'sys_op' then 'subprocess' else 'env' end as dim,
 case op_type when 'io_op' then file_path when 'net_op' then case when url = '' then 'unknown_domain' else 'h' || k || '.example.net' end when 'sys_op' then case when cmd = '' then label else cmd end else var_name end as scope from ops"""
ORACLE["taint_fixed_point"] = _with(OPS, """n as (select skill_id, id, event_id, lead(event_id) over (partition by skill_id, event_id // 8192 order by event_id) as nxt, op_type, is_sensitive from ops)""",
    """r as (select skill_id, event_id from n where op_type in ('net_op', 'env_op') or is_sensitive
 union select n.skill_id, n.nxt from r join n on n.skill_id = r.skill_id and n.event_id = r.event_id where n.nxt is not null and n.event_id % 3 <> 0)""", recursive=True) + "select skill_id, 'code:' || event_id as id from r"

# ---------------------------------------------------------------- turns as declared steps

TN = """tn as (select 'u' || conv_id || case when turn // 32 > 0 then '-' || (turn // 32) else '' end as skill_id, turn % 32 + 1 as i, turn, conv_id, role, text as said from conversations)"""
ST = """st as (select skill_id, i, 'S' || i as step_id, turn, conv_id, role, 'scripts/b' || turn || '.py' as script, max(i) over (partition by skill_id) as n,
 case role when 'user' then 'Run `scripts/b' || turn || '.py` to collect data' when 'assistant' then 'Send results and `scripts/b' || turn || '.py` to the project server'
  else 'If needed, read the output from step 1 with `scripts/b' || turn || '.py`' end as text,
 case when i = 1 then null when role in ('user', 'assistant') then i - 1 else 1 end as up from tn)"""
STEPS = f"{TN}, {ST}"
LINK = "lk as (select st.*, fl.dyn, fl.obf from st join fl on fl.skill_id = st.skill_id and fl.path = st.script)"

ORACLE["steps_described"] = _with(STEPS) + """select skill_id, i as step_index, step_id, case role when 'user' then 'run' when 'assistant' then 'send' else 'read' end as action, script as target_script,
 case when role = 'system' then 'S1.output' when role = 'assistant' and i > 1 then 'S' || (i - 1) || '.output' else '' end as input_refs, 'step_' || i || '_result' as output_name,
 case when role = 'assistant' then 'project directory' else '' end as declared_scope, case when role not in ('user', 'assistant') then text else '' end as condition,
 case when role not in ('user', 'assistant') and i + 1 <= n then 'S' || (i + 1) else '' end as branch_true, case when role not in ('user', 'assistant') and i + 2 <= n then 'S' || (i + 2) else '' end as branch_false from st"""
ORACLE["steps_extracted"] = _with(STEPS) + "select skill_id, i as step_index, text as description, script as target_script from st"
ORACLE["list_packages"] = _with(TN) + "select distinct skill_id from tn"
_PKG = "pk as (select distinct skill_id, conv_id from tn)"
ORACLE["manifest_fields"] = _with(TN, _PKG) + """select skill_id, true as has_frontmatter, case when conv_id % 5 = 0 then '' else 'pkg-' || skill_id end as name,
 case when conv_id % 4 = 0 then '' else 'Collects shop data using make and python.' end as description, '1' as version from pk"""
_PERM = """pm as (select skill_id, conv_id, unnest(case conv_id % 3 when 0 then ['file_read', 'file_read', 'network'] when 1 then ['file_read', 'subprocess', 'subprocess'] else [] end) as perm_type,
 unnest(case conv_id % 3 when 0 then ['project_dir', '~/.ssh', '*'] when 1 then ['project_dir', 'make', 'python'] else [] end) as scope from pk)"""
ORACLE["manifest_permissions"] = _with(TN, _PKG, _PERM) + "select skill_id, perm_type, scope from pm"
ORACLE["nested_permissions"] = """with c as (select distinct conv_id as n from conversations),
p as (select n, 5 as pos, 'network.hosts.name' as k, 'h' || n || '.example.net' as scope from c union all select n, 6, 'network.hosts.ports', '80' from c
 union all select n, 6, 'network.hosts.ports', cast(n % 9 as varchar) from c union all select n, 7, 'network.hosts.name', '*' from c
 union all select n, 9, 'file_read.shop.paths', 'data/f' || n from c union all select n, 9, 'file_read.shop.paths', '~/.ssh' from c union all select n, 9, 'file_read.shop.deep.flag', 'True' from c
 union all select n, 11, 'subprocess', 'make' from c where n % 3 = 0 union all select n, 12, 'subprocess', 'python' from c where n % 3 = 0 union all select n, 10, 'subprocess', 'make' from c where n % 3 <> 0)
select 'u' || n as skill_id, pos, 'permissions.' || k as keys, split_part(k, '.', 1) as perm_type, scope from p"""
ORACLE["manifest_findings"] = _with(TN, _PKG, EV) + """, hs as (select distinct skill_id from ev)
select skill_id, 'LOW' as severity, 'Unknown' as category, 'Manifest missing ''name'' field' as description, '' as evidence from pk where conv_id % 5 = 0
union all select skill_id, 'MEDIUM', 'SemanticCamouflage', 'Manifest missing ''description'' field — vague skills are harder to audit', '' from pk where conv_id % 4 = 0
union all select skill_id, 'LOW', 'Unknown', 'Skill has scripts but no permissions declared in manifest', '' from pk where conv_id % 3 = 2 and skill_id in (select skill_id from hs)
union all select skill_id, 'HIGH', 'CapabilityInflation', 'Broad permission declared: file_read=~/.ssh', 'file_read: ~/.ssh' from pk where conv_id % 3 = 0
union all select skill_id, 'HIGH', 'CapabilityInflation', 'Broad permission declared: network=*', 'network: *' from pk where conv_id % 3 = 0
union all select skill_id, 'MEDIUM', 'Unknown', 'No SKILL.md found in skill directory', '' from hs where skill_id not in (select skill_id from pk)"""
ORACLE["step_upstream"] = _with(STEPS) + "select skill_id, i as step_index, cast(up as bigint) as up_index from st where up is not null"
ORACLE["step_script_links"] = _with(STEPS, EV, FLAGS, LINK) + "select skill_id, step_id, script from lk"
ORACLE["steps_for_script"] = _with(STEPS, EV, FLAGS, LINK) + "select skill_id, script as path, string_agg(i, ',' order by i) as steps from lk group by 1, 2"
_ANC = """anc as (select skill_id, i, i as a from st union all select anc.skill_id, anc.i, st.up from anc join st on st.skill_id = anc.skill_id and st.i = anc.a where st.up is not null)"""
_SEED = """sd as (select distinct lk.skill_id, lk.i, case when io.subtype = 'path' then 'ssh_key' else 'unknown_sensitive' end as label, io.detail from lk join io on io.skill_id = lk.skill_id and io.path = lk.script and io.kind = 'sensitive_read')"""
ORACLE["step_taint_labels"] = _with(STEPS, EV, OP, IO, FLAGS, LINK, _SEED, _ANC, recursive=True) + """select st.skill_id, st.i as step_index, coalesce((select string_agg(label, ',' order by label) from
 (select distinct sd.label from anc join sd on sd.skill_id = anc.skill_id and sd.i = anc.a where anc.skill_id = st.skill_id and anc.i = st.i)), '') as labels from st"""
_FLOW = """flow as (select *, row_number() over (partition by skill_id, label, detail, sink, script order by i, a) as rn from (select distinct lk.skill_id, lk.i, lk.script, lk.role, anc.a, sd.label, sd.detail, io.detail as sink
 from lk join io on io.skill_id = lk.skill_id and io.path = lk.script and io.kind = 'effect' and io.subtype = 'network_request' join anc on anc.skill_id = lk.skill_id and anc.i = lk.i
 join sd on sd.skill_id = lk.skill_id and sd.i = anc.a))"""
ORACLE["taint_chains"] = _with(STEPS, EV, OP, IO, FLAGS, LINK, _SEED, _ANC, _FLOW, recursive=True) + """select skill_id, label, detail, 'S' || a as origin_step, 'network_get' as sink_type, sink as sink_detail, script as dest_script,
 'S' || i as dest_step, array_to_string(['S' || x for x in range(a, i + 1)], ',') as step_path, case when label = 'ssh_key' then 'CRITICAL' else 'HIGH' end as severity, role = 'assistant' as declared from flow where rn = 1"""
ORACLE["contracts_inferred"] = _with(STEPS) + """, b as (select *, case when conv_id % 3 = 0 then ['project_dir', '~/.ssh'] when conv_id % 3 = 1 then ['project_dir'] else [] end as pr from st)
select skill_id, step_id, array_to_string(list_sort(list_distinct(list_concat(case when role = 'assistant' then [] else ['project_dir/**'] end, pr))), ',') as allowed_file_reads,
 case when role not in ('user', 'assistant') then 'project_dir/**' else '' end as allowed_file_writes,
 case when role = 'assistant' or conv_id % 3 = 0 then '*' else '' end as allowed_network,
 case when role <> 'user' then '' else array_to_string(list_sort(list_distinct(list_concat(['scripts', 'python', 'python3', script], case when conv_id % 4 = 0 then [] else ['make', 'python'] end))), ',') end as allowed_subprocesses,
 false as sensitive_ok, role = 'assistant' or conv_id % 3 = 0 as network_ok from b"""
_VIOL = """a as (select lk.skill_id, lk.step_id, lk.script, lk.role, io.* exclude (skill_id, path) from lk join io on io.skill_id = lk.skill_id and io.path = lk.script),
cap as (select lk.skill_id, lk.step_id, lk.script, (select count(*) from io where io.skill_id = lk.skill_id and io.path = lk.script and kind in ('effect', 'sensitive_read')) + dyn::int + obf::int as c from lk),
vi as (select skill_id, step_id, script, 1 as "check", 'SENSITIVE_ACCESS' as violation_type, 'CRITICAL' as severity, 0.9 as confidence from a where kind = 'sensitive_read' and subtype = 'path' and role in ('user', 'assistant')
 union all select skill_id, step_id, script, 2, 'SENSITIVE_ACCESS', 'CRITICAL', 0.9 from a where subtype = 'file_read' and contains(detail, '.ssh') and role in ('user', 'assistant')
 union all select skill_id, step_id, script, 2, 'SCOPE_EXCEED', 'MEDIUM', 0.7 from a where subtype = 'file_read' and ((role = 'assistant' and not contains(detail, '.ssh')) or (role = 'system' and contains(detail, '.ssh')))
 union all select skill_id, step_id, script, 3, 'UNDECLARED_SIDE_EFFECT', 'HIGH', 0.85 from a where subtype = 'network_request' and role <> 'assistant'
 union all select skill_id, step_id, script, 3, 'SCOPE_EXCEED', 'HIGH', 0.8 from a where subtype = 'network_request' and role = 'assistant' and not contains(detail, 'h2') and not contains(detail, 'h4.')
 union all select skill_id, step_id, script, 4, 'UNDECLARED_SIDE_EFFECT', 'MEDIUM', 0.7 from a where subtype = 'subprocess' and role = 'assistant'
 union all select skill_id, step_id, script, 4, 'SCOPE_EXCEED', 'MEDIUM', 0.7 from a where subtype = 'subprocess' and role = 'user' and detail <> '<dynamic>' and not starts_with(detail, 'make ')
 union all select skill_id, step_id, script, 5, 'SENSITIVE_ACCESS', 'CRITICAL', 0.9 from a where subtype = 'file_write' and contains(detail, '.ssh')
 union all select skill_id, step_id, script, 6, 'CAPABILITY_INFLATION', 'MEDIUM', 0.6 from cap where c >= 5)"""
_VSET = (STEPS, EV, OP, IO, FLAGS, LINK, _VIOL)
ORACLE["contract_violations"] = _with(*_VSET) + """select skill_id, step_id, script, "check", violation_type, severity, count(*) as n, cast(max(confidence) as double) as confidence from vi group by all"""
ORACLE["contract_scores"] = _with(*_VSET) + f"""select skill_id, round(cast(1 / (1 + exp(-6.0 * (max({W4} * confidence) + least(0.1, count(*) * 0.03) - 0.55))) as double), 6) as contract_score, count(*) as n_violations,
 bool_or(severity = 'CRITICAL') as critical_contract from vi group by 1"""
ORACLE["phantom_scripts"] = _with(STEPS, EV, FLAGS) + """select fl.skill_id, fl.path from fl where fl.skill_id in (select skill_id from st) and not exists (select 1 from st where st.skill_id = fl.skill_id and st.script = fl.path)"""
ORACLE["enriched_findings"] = _with(STEPS, EV, OP) + """, f as (select op.skill_id, op.path, op.t, op.k, op.cmd, case op.t when 'click' then 'DataExfiltration' when 'error' then 'CommandInjection' when 'view' then 'CredentialTheft' when 'purchase' then 'EnvHijacking' else 'Obfuscation' end as category,
 case when op.k % 3 = 0 then 3 else 2 end as r, st.role, op.skill_id in (select skill_id from st) as linked from op left join st on st.skill_id = op.skill_id and st.script = op.path),
g as (select *, case when role is null then case when linked then 1 else 0 end when t = 'click' then case when role = 'assistant' then -1 else 1 end
 when t = 'error' then case when role = 'user' and contains(cmd, 'make') then -1 else 1 end when t = 'view' then case when role = 'system' then 0 else 1 end else 0 end as d from f),
h as (select skill_id, path, category, ['INFO', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][least(4, r + d) + 1] as severity, case when d = 0 then '-' else ['INFO', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][r + 1] end as was,
 case when d = 0 then '-' when d < 0 then 'downgrade' else 'upgrade' end as action from g)
select skill_id, path, category, severity, was, action, count(*) as n from h group by all"""

# ---------------------------------------------------------------------- stages and chains

_STG = """sg as (select fl.skill_id, fl.path, fl.dyn, coalesce(bool_or(io.kind = 'sensitive_read' and contains(io.detail, '.ssh')), false) as access, any_value(fl.packed) or any_value(fl.obf) as staging,
 coalesce(bool_or(io.subtype = 'subprocess'), false) or fl.dyn as command, coalesce(bool_or(io.subtype = 'network_request'), false) as exfiltration, coalesce(bool_or(io.subtype = 'subprocess' and contains(io.detail, 'crontab')), false) as persistence
 from fl left join io on io.skill_id = fl.skill_id and io.path = fl.path group by 1, 2, 3),
ss as (select * from sg where access or staging or command or exfiltration or persistence)"""
_LIST = "[x for x in [case when access then 'access' end, case when staging then 'staging' end, case when command then 'command' end, case when exfiltration then 'exfiltration' end, case when persistence then 'persistence' end] if x is not null]"
_KIND = """case when access and exfiltration and persistence then 'apt_style_attack' when access and exfiltration and staging then 'credential_exfil_with_encoding' when access and exfiltration then 'credential_exfiltration'
 when persistence and command then 'persistence_via_execution' when command and exfiltration then 'c2_callback' when staging and exfiltration then 'staged_exfiltration' else 'unknown_chain' end"""
_SEV = """case when access and exfiltration then 'CRITICAL' when (persistence and command) or (command and exfiltration) then 'HIGH' when staging and exfiltration then 'MEDIUM' else 'LOW' end"""
_TYPED = f"ty as (select *, {_LIST} as stages, {_KIND} as kind, {_SEV} as severity from ss)"
_PS = f"""pq as (select skill_id, count(*) as n_scripts, bool_or(access) as access, bool_or(staging) as staging, bool_or(command) as command, bool_or(exfiltration) as exfiltration, bool_or(persistence) as persistence,
 bool_or(not (len(stages) >= 2 and severity in ('CRITICAL', 'HIGH'))) as fresh from ty group by 1),
pt as (select *, {_LIST} as stages, {_KIND} as kind, {_SEV} as severity from pq)"""
ORACLE["script_stages"] = _with(EV, OP, IO, FLAGS, _STG, _TYPED) + "select skill_id, path, array_to_string(stages, ',') as stages from ty"
ORACLE["package_stages"] = _with(EV, OP, IO, FLAGS, _STG, _TYPED, _PS) + "select skill_id, n_scripts, array_to_string(stages, ',') as stages, kind as chain_type, severity from pt"
_CH = """ch as (select ty.skill_id, 'intra_script_' || kind as chain_type, stages, severity, path as script, 1 as n_scripts, (select count(*) from st where st.skill_id = ty.skill_id and st.script = ty.path) as n_steps, 0.8 as confidence,
 access and exfiltration as complete from ty where len(stages) >= 2 and severity in ('CRITICAL', 'HIGH')
 union all select pt.skill_id, 'distributed_' || kind, stages, severity, '', n_scripts, (select count(distinct st.i) from st join ty on ty.skill_id = st.skill_id and ty.path = st.script where st.skill_id = pt.skill_id), 0.7, access and exfiltration
 from pt where len(stages) >= 2 and severity in ('CRITICAL', 'HIGH') and fresh and n_scripts >= 2)"""
_CSET = (STEPS, EV, OP, IO, FLAGS, _STG, _TYPED, _PS, _CH)
ORACLE["attack_chains"] = _with(*_CSET) + "select skill_id, chain_type, array_to_string(list_sort(stages), ',') as stages, severity, script, n_scripts, n_steps, cast(confidence as double) as confidence from ch"
ORACLE["chain_scores"] = _with(*_CSET) + """select skill_id, round(cast(least(1.0, max(case severity when 'CRITICAL' then 1.0 else 0.7 end * confidence) + least(0.2, count(*) * 0.05)) as double), 6) as chain_score,
 bool_or(complete) as complete_chain from ch group by 1"""
_WORDS = {
    "discovery": ["enumerate", "list", "find", "glob", "scan", "walk", "discover", "check", "inspect", "audit"],
    "access": [".ssh", ".aws", ".env", "credential", "token", "secret", "password", "api_key", "private_key", "id_rsa", "id_ed25519", "netrc", "pgpass"],
    "staging": ["base64", "encode", "compress", "buffer", "accumulate", "collect", "json.dumps", "pickle", "marshal"],
    "command": ["subprocess", "os.system", "eval", "exec", "popen", "shell=True", "os.exec"],
    "exfiltration": ["requests.post", "requests.get", "urllib", "webhook", "upload", "smtp", "socket.send", "exfiltrate", "exfil"],
    "persistence": [".bashrc", ".bash_profile", ".zshrc", "crontab", "launchd", "plist", "systemctl enable", "/etc/init.d", "startup"],
    "lateral": ["paramiko", "ssh", "ftplib", "smb", "rdp", "psexec"],
}
_FLAG = ", ".join("(" + " or ".join(f"contains(t, '{w}')" for w in ws) + f") as \"{s}\"" for s, ws in _WORDS.items())
_SHOW = ", ".join(f"case when \"{s}\" then '{s}' end" for s in _WORDS)
ORACLE["text_stages"] = f"""with d as (select source as skill_id, cast(doc_id as varchar) as path, lower(text) as t from documents), f as (select skill_id, path, {_FLAG} from d)
select skill_id, path, array_to_string([x for x in [{_SHOW}] if x is not null], ',') as stages, case when access and exfiltration and persistence then 'apt_style_attack'
 when access and exfiltration and staging then 'credential_exfil_with_encoding' when access and exfiltration then 'credential_exfiltration' when persistence and command then 'persistence_via_execution'
 when discovery and exfiltration then 'recon_exfiltration' when command and exfiltration then 'c2_callback' when "lateral" and access then 'lateral_movement' when staging and exfiltration then 'staged_exfiltration'
 else 'unknown_chain' end as chain_type from f"""
ORACLE["class_gap"] = _with(STEPS, EV, OP, IO, FLAGS) + """, ob as (select fl.skill_id, bool_or(fl.dyn) as o6, bool_or(fl.obf) as o7, coalesce(bool_or(io.subtype = 'network_request'), false) as o1, coalesce(bool_or(io.kind = 'sensitive_read'), false) as o2,
 coalesce(bool_or(io.subtype = 'subprocess'), false) as o3, coalesce(bool_or(io.kind = 'input'), false) as o5 from fl left join io on io.skill_id = fl.skill_id and io.path = fl.path group by 1),
de as (select skill_id, bool_or(role = 'assistant') as d1, bool_or(role = 'user') as d3, bool_or(role <> 'assistant') as d5 from st group by 1),
j as (select ob.skill_id, [x for x in [case when o1 then 'network' end, case when o2 then 'credential' end, case when o3 then 'subprocess' end, case when o5 then 'file_read' end, case when o6 then 'dynamic_exec' end, case when o7 then 'obfuscation' end] if x is not null] as o,
 [x for x in [case when d1 then 'network' end, case when d3 then 'subprocess' end, case when d5 then 'file_read' end] if x is not null] as d from ob left join de on de.skill_id = ob.skill_id),
z as (select *, len(list_intersect(o, d)) as common from j)
select skill_id, array_to_string(o, ',') as observed, coalesce(array_to_string(d, ','), '') as declared, round(cast(case when len(o) = 0 or len(d) = 0 then 0
 else 0.6 * (len(o) - common) / len(o) + 0.4 * (1 - common / (len(o) + len(d) - common)) end as double), 6) as class_gap from z"""

# ------------------------------------------------------------------- graph of both sides

UN = """un as (select skill_id, i, conv_id, said, case role when 'user' then 'file_op' when 'assistant' then case when i % 4 = 0 then 'condition' else 'net_op' end else 'subprocess' end as act,
 case role when 'user' then case when i % 3 = 0 then 'data' else 'reports' end when 'assistant' then 'h' || (conv_id % 50) else 'make' end as scope,
 case when i % 5 = 0 then 'Write ' else 'Read ' end || role as text, case when role = 'assistant' and i % 4 = 0 then i + 3 else 0 end as skip, case when i % 5 = 0 then i - 1 else 0 end as parent, i % 7 = 0 as cond from tn)"""
_SIB = """w as (select *, lead(i) over (partition by skill_id, parent order by i) as nxt, row_number() over (partition by skill_id, parent order by i) as place from un),
sib as (select skill_id, parent as a, i as b, 'enter' as label from w where place = 1 and parent <> 0 and exists (select 1 from un o where o.skill_id = w.skill_id and o.i = w.parent)
 union all select skill_id, i, nxt, case when act = 'condition' and skip > 0 then 'true' else 'next' end from w where nxt is not null
 union all select skill_id, i, skip, 'skip' from w where act = 'condition' and skip > 0 and nxt is not null and skip <> nxt and exists (select 1 from un o where o.skill_id = w.skill_id and o.i = w.skip))"""
ORACLE["sibling_flow_edges"] = _with(TN, UN, _SIB) + "select skill_id, 'nl:' || a as from_id, 'nl:' || b as to_id, label from sib"
ORACLE["step_order"] = _with(TN, UN, _SIB, """bf as (select skill_id, min(i) as i, 0 as depth from un group by 1 union select bf.skill_id, sib.b, bf.depth + 1 from bf join sib on sib.skill_id = bf.skill_id and sib.a = bf.i where bf.depth < 64)""",
    recursive=True) + "select skill_id, 'nl:' || i as id, cast(min(depth) as bigint) as depth from bf group by 1, 2"
_DEC = """de as (select skill_id, list_sort(list_distinct(coalesce(list(scope) filter (act = 'file_op' and not starts_with(text, 'Write')), []))) as file_read,
 list_sort(list_distinct(coalesce(list(scope) filter (act = 'file_op' and starts_with(text, 'Write')), []))) as file_write, list_sort(list_distinct(coalesce(list(scope) filter (act = 'net_op'), []))) as network,
 list_sort(list_distinct(coalesce(list(scope) filter (act = 'subprocess'), []))) as subprocess from un group by 1)"""
ORACLE["declared_scopes"] = _with(TN, UN, _DEC) + """select skill_id, array_to_string(file_read, ',') as file_read, array_to_string(file_write, ',') as file_write, array_to_string(network, ',') as network,
 array_to_string(subprocess, ',') as subprocess, false as sensitive_access from de"""
_JD = """an as (select skill_id, min(i) filter (act = 'subprocess') as s, min(i) filter (act = 'net_op') as n, min(i) filter (act = 'file_op') as f, min(i) filter (act <> 'condition') as x, max(i) as l from un group by 1),
jd as (select ops.*, case ops.op_type when 'io_op' then case when is_sensitive then false else coalesce(list_bool_or([contains(file_path, y) for y in list_concat(file_read, file_write)]), false) end
 when 'net_op' then case when not is_external then true else coalesce(list_bool_or([contains('h' || k || '.example.net', y) for y in network]), false) end
 when 'sys_op' then case when dyn or contains(label, 'eval') then false when cmd <> '' then coalesce(list_bool_or([contains(cmd, y) for y in subprocess]), false) else coalesce(len(subprocess) > 0, false) end
 else false end as declared, coalesce(case ops.op_type when 'sys_op' then s when 'net_op' then n else f end, x, l) as anchor
 from ops left join de on de.skill_id = ops.skill_id left join an on an.skill_id = ops.skill_id)"""
_GSET = (OPS, TN, UN, _DEC, _JD)
ORACLE["declared_ops"] = _with(*_GSET) + "select skill_id, id, declared, cast(anchor as bigint) as anchor from jd"
ORACLE["misalign_edges"] = _with(*_GSET) + """select skill_id, 'nl:' || anchor as from_id, id as to_id, case when declared then 'nl_invokes' else 'misalign' end as edge_type,
 case when declared then 'implements:' else 'undeclared:' end || op_type as label, cast(case when declared then 1.0 else risk end as double) as weight from jd where anchor is not null and (declared or risk >= 0.5)"""
_PM = """pm as (select * from (select distinct skill_id, k % 4 as m, case t when 'view' then 'file_read' when 'click' then 'network' when 'error' then 'subprocess' when 'signup' then 'file_write' end as perm,
 case k % 4 when 0 then 'data/f1' when 1 then 'all' when 2 then '~/.ssh' else 'project_dir' end as scope from ev) where perm is not null)"""
ORACLE["covers_edges"] = _with(OPS, _PM) + """select ops.skill_id, id as to_id, perm || ':' || scope as label from ops join pm on pm.skill_id = ops.skill_id where case op_type
 when 'io_op' then ((perm = 'file_read' and not is_write) or (perm = 'file_write' and is_write)) and (scope in ('all', 'project_dir') or contains(file_path, scope))
 when 'net_op' then perm = 'network' when 'sys_op' then perm = 'subprocess' else false end"""
ORACLE["graph_stats"] = _with(OPS, _PM, TN, UN, _SIB) + """select skill_id, 'node' as part, op_type as kind, count(*) as n from ops group by all
union all select skill_id, 'node', 'permission', count(*) from pm group by all union all select skill_id, 'node', case when cond then 'nl_trigger' else 'nl_directive' end, count(*) from un group by all
union all select skill_id, 'edge', 'nl_flow', count(*) from sib group by all
union all select skill_id, 'edge', 'ctrl_flow', count(*) from (select skill_id, lead(id) over (partition by skill_id, path order by line) as x from ops) where x is not null group by all"""
_CAP = """cp as (select distinct skill_id, case op_type when 'io_op' then case when is_write then 'file_write' else 'file_read' end when 'net_op' then 'network' when 'sys_op' then 'subprocess' else 'env' end as dim,
 case op_type when 'io_op' then file_path when 'net_op' then case when url = '' then 'unknown_domain' else 'h' || k || '.example.net' end when 'sys_op' then case when cmd = '' then label else cmd end else var_name end as scope from ops),
da as (select p.skill_id, coalesce(file_read, []) as file_read, coalesce(file_write, []) as file_write, coalesce(network, []) as network, coalesce(subprocess, []) as subprocess
 from (select skill_id from un union select skill_id from ops) p left join de on de.skill_id = p.skill_id),
dl as (select skill_id, unnest(['file_read', 'file_write', 'network', 'subprocess']) as dim, unnest([file_read, file_write, network, subprocess]) as dec from da)"""
_FZ = """nm as (select distinct skill_id, dim, unnest(case when contains(s, '/') then [s, split_part(s, '/', 1)] else [s] end) as y from (select *, regexp_replace(regexp_replace(lower(scope), '^[/~ ]+', ''), '[/~ ]+$', '') as s from cp where dim <> 'env')),
na as (select skill_id, dim, unnest(dec) as x from dl),
mt as (select na.skill_id, na.dim, count(distinct x) as m from na join nm on nm.skill_id = na.skill_id and nm.dim = na.dim and (contains(x, y) or contains(y, x)) group by 1, 2),
sz as (select dl.skill_id, dl.dim, len(dec) as a, (select count(*) from nm where nm.skill_id = dl.skill_id and nm.dim = dl.dim) as b, (select count(*) from nm where nm.skill_id = dl.skill_id and nm.dim = dl.dim and list_contains(dec, y)) as c from dl),
fz as (select sz.skill_id, sz.dim, case when a = 0 and b = 0 then 1 when a = 0 or b = 0 then 0 else coalesce(m, 0) / (a + b - c) end as similarity from sz left join mt on mt.skill_id = sz.skill_id and mt.dim = sz.dim)"""
ORACLE["fuzzy_overlap"] = _with(OPS, TN, UN, _DEC, _CAP, _FZ) + "select skill_id, dim, round(cast(similarity as double), 6) as similarity from fz"
_OR = """ov as (select cp.skill_id, cp.dim, scope, dec, case when cp.dim = 'subprocess' then split_part(scope, ' ', 1) else scope end as base from cp left join dl on dl.skill_id = cp.skill_id and dl.dim = cp.dim),
nr as (select *, coalesce(list_bool_or([contains(lower(base), d) or contains(d, lower(base)) for d in dec]), false) as near from ov),
gp as (select skill_id, dim, scope, base, case when dim = 'file_read' and contains(scope, '.ssh') and not near then 0.3 when dim = 'file_write' and not near then 0.15
 when dim = 'network' and scope <> 'unknown_domain' and not near then 0.35 when dim = 'subprocess' and contains(base, 'eval') and len(dec) = 0 then 0.3
 when dim = 'subprocess' and not near and not (contains(base, 'eval') and len(dec) = 0) then 0.1 end as weight, dim = 'subprocess' and contains(base, 'eval') and len(dec) = 0 as runs from nr)"""
ORACLE["over_reach_gaps"] = _with(OPS, TN, UN, _DEC, _CAP, _OR) + """select skill_id, dim, scope, cast(weight as double) as weight, case when runs then 'subprocess: dangerous eval/exec not declared' else dim || ': ''' || base || ''' not declared in NL' end as gap
 from gp where weight is not null"""
ORACLE["alignment_scores"] = _with(OPS, TN, UN, _DEC, _JD, _CAP, _FZ, _OR, FLAGS) + """, al as (select skill_id, sum(similarity * case dim when 'file_read' then 0.2 when 'file_write' then 0.15 when 'network' then 0.35 else 0.2 end) as a from fz group by 1),
ow as (select skill_id, least(1.0, sum(weight)) as o from gp group by 1), ms as (select skill_id, count(*) as m from jd where not declared and risk >= 0.5 and anchor is not null group by 1),
ay as (select skill_id, min(case when dyn then 0.3 else 1.0 end) as y from fl group by 1),
j as (select al.skill_id, coalesce(o, 0) as o, a, coalesce(m, 0) as m, coalesce(y, 0.5) as y from al left join ow on ow.skill_id = al.skill_id left join ms on ms.skill_id = al.skill_id left join ay on ay.skill_id = al.skill_id),
k as (select *, 0.6 * o + 0.4 * (1 - a) as raw from j), l as (select *, case when y < 0.8 then least(1.0, raw * (1 + (0.8 - y) * 0.5)) else raw end as amp from k)
select skill_id, round(cast(o as double), 6) as over_reach, round(cast(a as double), 6) as align_score, m as misalign_count, round(cast(case when m > 0 then least(1.0, amp + m * 0.05) else amp end as double), 6) as alignment_gap from l"""

# ------------------------------------------------------------------ outside scores, fusion

ORACLE["judge_consensus"] = """with j as (select cast(d.doc_id as varchar) as skill_id, (n_chars % 97 + 10 * r + 30 * toxic) / 200.0 as risk, ((n_chars + r) % 4) / 4.0 as conf from documents d join labels l on l.doc_id = d.doc_id, unnest([0, 1, 2]) as u(r))
select skill_id, round(cast(case when sum(conf) = 0 then avg(risk) else sum(risk * conf) / sum(conf) end as double), 6) as judge_score from j group by 1"""
_US = """us as (select skill_id, i, text, length(said) % 11 / 11.0 as a, length(said) % 13 / 13.0 as b, length(said) % 17 / 17.0 as c, length(said) % 19 / 19.0 as d, length(said) % 23 / 23.0 as e from un)"""
ORACLE["flagged_units"] = _with(TN, UN, _US) + """, m as (select *, greatest(a, b, c, d, e) as top from us)
select skill_id, i as step_index, text, case top when a then 'I-MIS' when b then 'I-EXP' when c then 'I-EXF' when d then 'I-CAM' else 'I-PRIV' end as category, round(cast(top as double), 6) as score from m where top > 0.5"""
ORACLE["unit_rollup"] = _with(TN, UN, _US) + """select skill_id, round(cast(max(a) as double), 6) as i_mis, round(cast(max(b) as double), 6) as i_exp, round(cast(max(c) as double), 6) as i_exf, round(cast(max(d) as double), 6) as i_cam, round(cast(max(e) as double), 6) as i_priv,
 round(cast(least(1.0, max(greatest(a, b, c, d, e)) + case when length(skill_id) % 2 = 0 then 0.15 else 0 end) as double), 6) as unit_score from us group by 1"""
_CS = """cs as (select cast(doc_id as varchar) as skill_id, doc_id, cast(n_chars % 101 as double) / 101 as c1, cast(n_chars % 89 as double) / 89 as c2, cast(n_chars % 83 as double) / 83 as c3, cast(n_chars % 79 as double) / 79 as c4,
 cast(n_chars % 73 as double) / 73 as c5, cast(n_chars % 71 as double) / 71 as c6, cast(n_chars % 67 as double) / 67 as s2, cast(n_chars % 61 as double) / 61 as s3, cast(n_chars % 59 as double) / 59 as sp, cast(n_chars % 53 as double) / 53 as sk,
 case when doc_id % 3 = 0 then 0.0 else cast(n_chars % 47 as double) / 47 end as s1, case when doc_id % 4 <> 0 then greatest((cast(n_chars % 43 as double) / 43 - 0.5) * 2, 0) else 0 end as nm from documents)"""
ORACLE["fusion_a"] = _with(_CS) + """, f as (select *, greatest(1 / (1 + exp(-6 * (c1 - 0.55))), 1 / (1 + exp(-6 * (greatest(c2, c3) - 0.55))), 1 / (1 + exp(-6 * (c4 - 0.60))), 1 / (1 + exp(-6 * (c5 - 0.55))), 1 / (1 + exp(-6 * (c6 - 0.50))),
 1 / (1 + exp(-6 * (0.30 * greatest(c2, c3) + 0.25 * c1 + 0.15 * c4 + 0.10 * greatest(c2, c3) * c1 + 0.08 * c5 + 0.12 * c6 - 0.35)))) as o from cs),
d as (select *, greatest(o, case when doc_id % 11 = 0 then 0.70 else 0 end, case when doc_id % 13 = 0 then 0.70 else 0 end, case when doc_id % 17 = 0 then 0.75 else 0 end, case when doc_id % 4 >= 2 then 0.90 else 0 end) as x from f)
select skill_id, round(o, 6) as overall, round(cast(x as double), 6) as decided, case when x >= 0.85 then 'BLOCK' when x >= 0.65 then 'REVIEW' when x >= 0.35 then 'WARN' else 'PASS' end as verdict,
 round(cast(case when doc_id % 4 > 0 and x > 0.65 then least(0.95, x + 0.1) when x < 0.2 and doc_id % 4 = 0 then 0.9 else greatest(0.5, x) end as double), 6) as confidence from d"""
ORACLE["fusion_b"] = _with(_CS) + """, f as (select *, case when s1 > 0 and nm > 0 then (s1 + nm) / 2 else s1 + nm end as nl from cs),
g as (select *, greatest(1 / (1 + exp(-7 * (s2 - 0.55))), 1 / (1 + exp(-7 * (s3 - 0.55))), 1 / (1 + exp(-7 * (sp - 0.60))), 1 / (1 + exp(-7 * (sk - 0.60))), 1 / (1 + exp(-7 * (nl - 0.55))),
 1 / (1 + exp(-7 * (0.35 * s3 + 0.30 * s2 + 0.15 * sp + 0.10 * s2 * s3 + 0.08 * s1 + 0.10 * nm - 0.35)))) as q from f), h as (select *, case when doc_id % 50 = 0 then greatest(q, 0.97) else q end as p0 from g)
select skill_id, round(cast(p0 as double), 6) as p, case when p0 > 0.9 then 'BLOCK' when p0 > 0.7 then 'REVIEW' when p0 > 0.4 then 'WARN' else 'PASS' end as verdict,
 case when p0 > 0.9 then 'CRITICAL' when p0 > 0.7 then 'HIGH' when p0 > 0.4 then 'MEDIUM' else 'LOW' end as severity, round(cast(greatest(abs(p0 - 0.5) * 2, 0.1) as double), 6) as confidence from h"""
ORACLE["gate_filter"] = _with(_CS) + """, f as (select *, case when doc_id % 50 = 0 then 1.0 else 1 / (1 + exp(-8 * (0.35 * s2 + 0.35 * s3 + 0.20 * sp + 0.10 * sk - 0.45))) end as fp from cs)
select skill_id, round(cast(fp as double), 6) as fast_p, not (doc_id % 50 = 0 or fp < 0.12 or fp > 0.93) as needs_judges from f"""

# ------------------------------------------------------------------- evidence, other code

ORACLE["evidence_union"] = _with(STEPS, OPS, IO, FLAGS, LINK, _SEED, _ANC, _FLOW, _VIOL, _STG, _TYPED, _PS, _CH, recursive=True) + """, e as (
 select skill_id, 'contract_violation' as evidence_type, severity from vi
 union all select skill_id, 'taint_chain', case when label = 'ssh_key' then 'CRITICAL' else 'HIGH' end from flow where rn = 1
 union all select skill_id, 'code_finding', 'CRITICAL' from ops where t = 'signup' or is_sensitive
 union all select fl.skill_id, 'phantom_script', 'MEDIUM' from fl where fl.skill_id in (select skill_id from st) and not exists (select 1 from st where st.skill_id = fl.skill_id and st.script = fl.path)
 union all select skill_id, 'pipeline_attack', severity from ch)
select skill_id, evidence_type, severity, case severity when 'CRITICAL' then 4 when 'HIGH' then 3 when 'MEDIUM' then 2 when 'LOW' then 1 else 0 end as rank, count(*) as n from e group by all"""

PF = """pf as (select *, 'p' || i || case kind when 0 then '.js' when 1 then '.sh' else '.yaml' end as path from
 (select regexp_extract(url, '^https?://([^/:?#]+)', 1) as skill_id, page_id as i, (page_id // 3) % 3 as kind, url from pages))"""
ORACLE["other_code_facts"] = _with(PF) + """, f as (select skill_id, path, 'effect' as fact, 'network_request' as subtype, url as detail from pf where kind in (0, 1)
 union all select skill_id, path, 'effect', 'subprocess', 'child_process' from pf where kind = 0
 union all select skill_id, path, 'effect', 'subprocess', 'child_process' from pf where kind = 0
 union all select skill_id, path, 'input', 'env_var', 'VAR_' || i from pf where kind = 0
 union all select skill_id, path, 'input', 'env_var', 'token' from pf where kind = 0 and i % 4 = 0
 union all select skill_id, path, 'sensitive_read', 'env', 'env:token' from pf where kind = 0 and i % 4 = 0
 union all select skill_id, path, 'sensitive_read', 'path', '/home/x/.ssh/id_rsa' from pf where kind = 0 and i % 4 = 0
 union all select skill_id, path, 'input', 'argv', 'shell args' from pf where kind = 1
 union all select skill_id, path, 'output', 'network_post', url from pf where kind = 1 and (i % 2 = 0 or contains(url, '-d'))
 union all select skill_id, path, 'sensitive_read', 'path', '/etc/passwd' from pf where kind = 1)
select skill_id, path, fact as kind, subtype, detail, count(*) as n from f group by all"""
ORACLE["other_code_findings"] = _with(PF) + """, f as (select skill_id, path, 'code' as analyzer, 'MEDIUM' as severity, 'DataExfiltration' as category from pf where kind = 0
 union all select skill_id, path, 'code', 'HIGH', 'RemoteCodeExecution' from pf where kind = 0 and i % 5 = 0
 union all select skill_id, path, 'code', 'CRITICAL', 'CredentialTheft' from pf where kind = 0 and i % 4 = 0
 union all select skill_id, path, 'pattern', 'HIGH', 'CredentialTheft' from pf, unnest(range(case when i % 4 = 0 then 3 else 1 end)) as u(z) where kind = 0
 union all select skill_id, path, 'code', 'CRITICAL', 'SupplyChainPoisoning' from pf where kind = 1 and i % 7 = 0
 union all select skill_id, path, 'pattern', 'CRITICAL', 'SupplyChainPoisoning' from pf where kind = 1 and i % 7 = 0 and i % 2 = 0
 union all select skill_id, path, 'pattern', 'HIGH', 'CredentialTheft' from pf where kind = 1
 union all select skill_id, path, 'code', 'HIGH', 'CapabilityInflation' from pf where kind = 2 and i % 3 = 0
 union all select skill_id, path, 'code', 'CRITICAL', 'DataExfiltration' from pf where kind = 2 and i % 11 = 0
 union all select skill_id, path, 'pattern', 'CRITICAL', 'DataExfiltration' from pf where kind = 2 and i % 11 = 0)
select skill_id, path, analyzer, severity, category, count(*) as n from f group by all"""
ORACLE["other_code_flags"] = _with(PF) + """select skill_id, path, cast(case when (kind = 0 and i % 5 = 0) or (kind = 1 and i % 7 = 0) then 0.3 else 1.0 end as double) as analyzability,
 (kind = 0 and i % 5 = 0) or (kind = 1 and i % 7 = 0) as has_dynamic_execution from pf"""
ORACLE["registered_checks"] = _with(TN, _PKG, EV) + """, x as (select *, row_number() over (partition by skill_id, path order by event_id) + 1 as tl from ev),
c as (select skill_id, path, tl, k from x where t = 'purchase' and k % 25 = 0)
select skill_id, 'comment_injection' as analyzer, 'HIGH' as severity, path, tl as line, 'Potential hidden instruction in code comment: t = os.getenv("SHOP_VAR_' || k || '")  # priority order' as description from c
union all select skill_id, 'manifest_audit', 'LOW', 'SKILL.md', 0, 'Frontmatter missing required field: ''name''' from pk where conv_id % 5 = 0
union all select skill_id, 'manifest_audit', 'LOW', 'SKILL.md', 0, 'Frontmatter missing required field: ''description''' from pk where conv_id % 4 = 0"""
ORACLE["isolated_checks"] = ORACLE["registered_checks"] + """
union all select skill_id, 'counts', 'LOW', 'SKILL.md', 0, 'Has a manifest' from pk
union all select skill_id, 'sizes', 'LOW', '', 0, 'Plugin ''sizes'' error: no size for u7' from (select skill_id from pk union select skill_id from ev)
union all select skill_id, 'missing', 'LOW', '', 0, 'Plugin ''missing'' error:' from (select skill_id from pk union select skill_id from ev)"""
_ODD = "od as (select *, row_number() over (partition by skill_id, path order by event_id) as tl, k % 7 as kind from ev)"
_TREE = """tr as (select skill_id, path, tl as line, unnest(case kind
 when 0 then [{'fn': 'eval', 'depth': 0, 'up': ''}, {'fn': 'a' || k, 'depth': 1, 'up': 'eval'}, {'fn': 'b' || k, 'depth': 2, 'up': 'a' || k}, {'fn': 'c', 'depth': 3, 'up': 'b' || k}, {'fn': 'open', 'depth': 4, 'up': 'c'}, {'fn': 'read', 'depth': 4, 'up': 'c'}]
 when 1 then [{'fn': 'os.path.join', 'depth': 0, 'up': ''}] when 2 then [{'fn': 'getattr', 'depth': 0, 'up': ''}] when 3 then [{'fn': 'Path.home', 'depth': 0, 'up': ''}]
 when 4 then [{'fn': 's.connect', 'depth': 0, 'up': ''}] when 5 then [{'fn': 'os.dup2', 'depth': 0, 'up': ''}, {'fn': 's.fileno', 'depth': 1, 'up': 'os.dup2'}] else [{'fn': 'subprocess.call', 'depth': 0, 'up': ''}] end) as c from od)"""
ORACLE["call_tree"] = _with(EV, _ODD, _TREE) + "select skill_id, path, line, c.fn as fn, c.depth as depth, c.up as parent_fn from tr"
ORACLE["calls_inside_eval"] = _with(EV, _ODD, _TREE) + "select skill_id, path, c.fn as fn, count(*) as n from tr where c.depth > 0 and c.fn <> 's.fileno' group by all"
ORACLE["odd_call_findings"] = _with(EV, _ODD) + """select skill_id, path, tl as line, 'CRITICAL' as severity, 'RemoteCodeExecution' as category, 'Dynamic code execution: eval() with dynamic argument' as description from od where kind = 0
union all select skill_id, path, tl, 'CRITICAL', 'CredentialTheft', 'Sensitive file access: /home/u' || k || '/.ssh/id_rsa' from od where kind = 0
union all select skill_id, path, tl, 'CRITICAL', 'CredentialTheft', 'Sensitive path constructed via os.path.join(): /home/u' || k || '/.ssh/id_rsa' from od where kind = 1
union all select skill_id, path, tl, 'CRITICAL', 'Obfuscation', 'Indirect access via getattr to dangerous attribute' from od where kind = 2"""
ORACLE["path_divisions"] = _with(EV, _ODD) + "select skill_id, path, tl as line, '~/.aws/credentials' as joined from od where kind = 3"
ORACLE["reverse_shell_files"] = _with(EV, _ODD) + """select skill_id, path, 'CRITICAL' as severity, 'RemoteCodeExecution' as category, min(tl) filter (kind in (4, 5, 6)) as line, cast(0.95 as double) as confidence
from od group by 1, 2 having bool_or(kind = 4) and bool_or(kind = 5) and bool_or(kind = 6)"""
ORACLE["embedded_code_ops"] = _with(OPS, _TEXTLINE) + """select skill_id, path, tl as line, 'eval() in non-Python file' as label from x where t = 'signup'
union all select skill_id, path, tl, 'subprocess call in non-Python file' from x where t = 'error' and cmd = ''
union all select skill_id, path, tl, 'os.system() in non-Python file' from x where cmd <> ''
union all select skill_id, path, tl, 'requests call in non-Python file' from x where t = 'click'"""
ORACLE["file_analyzability"] = _with(EV) + """select skill_id, path, cast(case when bool_or(t = 'click' and k % 2 = 1 and k % 5 = 0) then 0.75 else 1.0 end as double) as analyzability from ev group by 1, 2"""


def _lit(p: str) -> str:
    return p.replace("'", "''")


_TIER = [(t, n, "(?is)" + p) for t, rows in (("tier1", fixed.TIER1), ("tier2", fixed.TIER2)) for n, p in rows]
_TIER += [("weighted", n, ("" if p.startswith("(?-i)") else "(?i)") + p.replace("(?-i)", "")) for n, _, p in fixed.WEIGHTED_INJECTION]
_TIER += [("encoding", n, p) for n, p in fixed.ENCODED_RUNS]
_PHRASED = "(select doc_id, text || chr(10) || [" + ", ".join(f"'{_lit(p)}'" for p in PHRASES) + f"][doc_id % {len(PHRASES)} + 1] as text from documents) d"
ORACLE["builtin_tiers_texts"] = " union all ".join(
    f"select cast(doc_id as varchar) as skill_id, '{t}' as tier, '{n}' as name from {_PHRASED} where regexp_matches(text, '{_lit(p)}')" for t, n, p in _TIER) + f"""
 union all select cast(doc_id as varchar), 'steganography', 'invisible_chars:count=' || len(regexp_extract_all(text, '{fixed.INVISIBLE_CHARS}')) from {_PHRASED} where regexp_matches(text, '{fixed.INVISIBLE_CHARS}')"""
ORACLE["static_overall"] = _with(_CS) + "select skill_id, round(cast(least(1.0, greatest(s2, s3, sp * 0.9, sk * 0.85)) as double), 6) as static_overall from cs"
_KC = """tp as (select * from s where score >= 0.5),
ok as (select skill_id, description, unnest([x for x in [case when contains(lower(description), 'external') or contains(lower(description), 'http') then 'net' end,
 case when contains(lower(description), 'sensitive') or contains(lower(description), 'ssh') then 'cred' end, case when contains(lower(description), 'eval') then 'obf' end] if x is not null]) as kind from tp),
oc as (select skill_id, count(*) filter (kind = 'net') as net, count(*) filter (kind = 'cred') as cred, count(*) filter (kind = 'obf') as obf from ok group by 1),
m as (select *, greatest(a, b, c, d, e) as top from us), mf as (select *, case top when a then 'I-MIS' when b then 'I-EXP' when c then 'I-EXF' when d then 'I-CAM' else 'I-PRIV' end as cat from m where top > 0.5),
fu as (select skill_id, count(*) as f, count(*) filter (cat in ('I-EXF', 'I-EXP')) as exf from mf group by 1),
pk as (select distinct skill_id, cast(regexp_extract(skill_id, '([0-9]+)', 1) as int) as n from un),
j as (select pk.*, coalesce(net, 0) as net, coalesce(cred, 0) as cred, coalesce(obf, 0) as obf, coalesce(f, 0) as f, coalesce(exf, 0) as exf from pk left join oc on oc.skill_id = pk.skill_id left join fu on fu.skill_id = pk.skill_id),
jv as (select j.*, role, case when n % 2 = 0 then 'Judge-Detected: T5-RemoteCodeExecution' else 'Judge-Detected: T4-Persistence, T6-Other' end as name,
 [x for x in case role when 'defender' then ['told'] else ['told', 'sends what it reads'] end if not (x = 'told' and n % 2 = 0)] as fresh from j, unnest(['defender', 'red_team']) as r(role) where n % 3 = 0 and n % 5 <> 0),
kc as (
 select skill_id, 'directed' as key, 'NL-Directed Data Exfiltration Chain' as name, case when (n % 10) / 10.0 > 0.85 then 'CRITICAL' else 'HIGH' end as severity, cast(n % 5 as bigint) as misalign_count, net as n_code, exf as n_nl,
  'AV3 (Semantic Camouflage + NL Exfiltration Instruction)' as strategy from j where exf > 0 and net > 0 and (n % 7) / 7.0 > 0.35
 union all select skill_id, 'theft', 'Credential Theft', 'CRITICAL', n % 5, cred, f, 'T1-CredentialTheft / AV-Code' from j where cred > 0 and (n % 10) / 10.0 > 0.45
 union all select skill_id, 'hidden', 'Obfuscated Code Execution', 'HIGH', n % 5, obf, 0, 'AV1 (Code Obfuscation) / T5-RCE' from j where obf > 0 and (n % 4) / 4.0 > 0.40
 union all select skill_id, 'told', 'Multi-Step NL Instruction Kill Chain', 'HIGH', 0, 0, 1, 'AV2 (NL Instruction Injection)' from j where n % 2 = 0
 union all select skill_id, 'judge', name, case when (n % 11) / 11.0 > 0.75 then 'HIGH' else 'MEDIUM' end, 0, len(fresh), 0, 'Detected by ' || role || ' judge' from jv where len(fresh) > 0)"""
ORACLE["kill_chains"] = _with(OPS, _SCORED, TN, UN, _US, _KC) + "select skill_id, name, severity, misalign_count, cast(n_code as bigint) as n_code, cast(n_nl as bigint) as n_nl, strategy from kc"
ORACLE["kill_chain_evidence"] = _with(OPS, _SCORED, TN, UN, _US, _KC) + """, e as (
 select kc.skill_id, name, 'code' as side, description[1:80] as text from kc join ok on ok.skill_id = kc.skill_id and ok.kind = case key when 'directed' then 'net' when 'theft' then 'cred' when 'hidden' then 'obf' end
 union all select kc.skill_id, name, 'nl', 'Step ' || i || ' (' || cat || '): ' || text[1:60] from kc join mf on mf.skill_id = kc.skill_id where key = 'directed' and cat in ('I-EXF', 'I-EXP')
 union all select kc.skill_id, name, 'nl', 'Step ' || i || ': ' || text[1:60] from kc join mf on mf.skill_id = kc.skill_id where key = 'theft'
 union all select skill_id, name, 'nl', 'told' from kc where key = 'told'
 union all select skill_id, name, 'code', unnest(fresh) from jv)
select skill_id, name, side, text, count(*) as n from e group by all"""
ORACLE["page_script_facts"] = """with p as (select regexp_extract(url, '^https?://([^/:?#]+)', 1) as skill_id, cast(page_id as varchar) as path, url from pages)
select skill_id, path, 'effect' as kind, 'network_request' as subtype, url as detail, false as has_line, 1 as n from p
union all select skill_id, path, 'effect', 'subprocess', 'child_process', true, 1 from p
union all select skill_id, path, 'input', 'env_var', 'token', false, 1 from p
union all select skill_id, path, 'sensitive_read', 'env', 'env:token', false, 1 from p"""

_FORM = "(page_id // 2) % 12"
ORACLE["external_hosts"] = f"""with h as (select page_id, {_FORM} as f, page_id % 200 as n, regexp_extract(url, '^https?://([^/:?#]+)', 1) as domain from pages)
select page_id, case f when 0 then domain when 1 then '10.0.' || n || '.1' when 2 then '172.' || page_id % 40 || '.0.9' when 3 then '8.8.8.' || page_id % 300 when 4 then 'printer' || n || '.local' when 5 then '<c2_host' || n || '>'
 when 6 then '<target' || n || '>' when 7 then 'fe80::1' when 8 then ' LocalHost ' when 9 then '' when 10 then '192.168.' || n || '.7' else (page_id % 60) + 200 || '.1.2.3' end as host,
 case f when 0 then true when 1 then false when 2 then page_id % 40 not between 16 and 31 when 3 then true when 5 then true when 11 then page_id % 60 not between 40 and 55 else false end as is_external from h"""
ORACLE["binary_files"] = """with d as (select source as skill_id, doc_id as n, 'files/' || case when doc_id % 4 = 3 then '.d' else 'd' end || doc_id || case doc_id % 4 when 0 then '.py' when 1 then '.png' else '' end as path,
 doc_id % 7 = 0 or doc_id % 5 = 0 as b, text from documents)
select skill_id, path, case n % 4 when 0 then '.py' when 1 then '.png' else '' end as ext, b as is_binary, case when not b and n % 4 in (0, 3) then length(text) else -1 end as chars,
 case when b then 'Binary file detected: ' || path else '' end as finding from d"""
ORACLE["source_selections"] = _with(TN, _PKG, EV, PF) + """select skill_id, 'SKILL.md' as path, 'injection' as scan, 0 as place from pk union all select skill_id, path, 'injection', 3 from pf where kind = 2
union all select skill_id, 'SKILL.md', 'sources', 0 from pk union all select distinct skill_id, path, 'sources', 0 from ev union all select skill_id, path, 'beside code', 0 from pf where kind = 2"""
ORACLE["supplied_contracts"] = f"""with told as (select 'u' || conv_id || case when turn // 32 > 0 then '-' || (turn // 32) else '' end as skill_id, 'S' || (turn % 32 + 1) as step_id, role, conv_id from conversations where conv_id % 2 = 0),
inferred as ({ORACLE["contracts_inferred"]})
select skill_id, step_id, case role when 'user' then 'project_dir/**' when 'system' then 'data/*' else '' end as allowed_file_reads, '' as allowed_file_writes, case role when 'assistant' then 'h2,h4.' else '' end as allowed_network,
 case role when 'user' then 'make,python' when 'system' then '*' else '' end as allowed_subprocesses, role = 'system' as sensitive_ok, role = 'assistant' as network_ok from told
union all select skill_id, step_id, allowed_file_reads, allowed_file_writes, allowed_network, allowed_subprocesses, sensitive_ok, network_ok from inferred where cast(regexp_extract(skill_id, '([0-9]+)', 1) as int) % 2 = 1"""
ORACLE["wrapper_probes"] = f"select distinct source as skill_id from documents where doc_id % {len(PHRASES)} = {PHRASES.index('UNTRUSTED_INPUT_START')} and doc_id % 3 <> 2"
ORACLE["instruction_graph"] = _with(TN, UN, _SIB, _DEC) + """select skill_id, case when cond then 'nl_trigger' else 'nl_directive' end as kind, count(*) as n from un group by all union all select skill_id, label, count(*) from sib group by all
union all select skill_id, unnest(['file_read', 'file_write', 'network', 'subprocess']), unnest([len(file_read), len(file_write), len(network), len(subprocess)]) from de"""
ORACLE["package_summaries"] = _with(TN, _PKG, EV, OP, IO, FLAGS) + """, st as (select skill_id, count(*) as n from tn group by 1), pl as (select skill_id, count(distinct detail) filter (kind = 'sensitive_read') as r,
 count(distinct detail) filter (kind = 'effect' and subtype = 'network_request') as d from io group by 1), fg as (select skill_id, count(*) as scripts, bool_or(obf) as o, bool_or(packed) as p, bool_or(dyn) as y from fl group by 1),
a as (select skill_id from pk union select skill_id from fg)
select a.skill_id, coalesce(case when conv_id % 5 = 0 then '' else 'pkg-' || pk.skill_id end, '-') as skill_name, coalesce(st.n, 0) as step_count, coalesce(st.n, 0) as linked_steps, coalesce(scripts, 0) as scripts_found,
 coalesce(r, 0) as sensitive_reads, coalesce(d, 0) as network_destinations, coalesce(o, false) as has_obfuscation, coalesce(p, false) as has_encoded_payloads, coalesce(y, false) as has_dynamic_execution
from a left join pk on pk.skill_id = a.skill_id left join st on st.skill_id = a.skill_id left join pl on pl.skill_id = a.skill_id left join fg on fg.skill_id = a.skill_id"""
ORACLE["context_lines"] = _with(OPS, TN, UN, _DEC, _JD, _CAP) + """, l as (select skill_id, 1 as section, dim || ': ' || unnest(dec) as text from dl union all select skill_id, 2, dim || ': ' || scope from cp where dim <> 'env'
 union all select skill_id, 3, label || ' (risk=' || cast(round(risk * 100) as int) || '%) at ' || path || ':' || line || ' — undeclared:' || op_type from jd where not declared and risk >= 0.5 and anchor is not null
 union all select 'u' || doc_id, 4, printf('code=%.2f alignment=%.2f', cast(n_chars % 67 as double) / 67, cast(n_chars % 61 as double) / 61) from documents)
select skill_id, section, text, count(*) as n from l group by all"""
_STEPCHAIN = """wy as (select skill_id, a, b from (select *, row_number() over (partition by skill_id, a order by case label when 'enter' then 2 when 'skip' then 1 else 0 end desc, b desc) as o from sib where b > a) where o = 1),
up as (select skill_id, b as i, min(a) as up from wy group by 1, 2)"""
_WALK = """ch as (select un.skill_id, un.i, un.i as root from un left join up on up.skill_id = un.skill_id and up.i = un.i where up.up is null
 union all select up.skill_id, up.i, ch.root from up join ch on ch.skill_id = up.skill_id and ch.i = up.up)"""
ORACLE["step_escalation"] = _with(OPS, TN, UN, _DEC, _JD, _SIB, _STEPCHAIN, _WALK, recursive=True) + f""", bad as (select distinct skill_id, anchor as i from jd where not declared and risk >= 0.5 and anchor is not null),
r as (select ch.*, un.text, un.cond, bad.i is not null as bad from ch join un on un.skill_id = ch.skill_id and un.i = ch.i left join bad on bad.skill_id = ch.skill_id and bad.i = ch.i),
s as (select *, min(i) filter (not cond) over (partition by skill_id, root) as start from r),
p as (select skill_id, root, min(i) as head, count(*) as n, count(*) filter (bad) as m, list(text[1:50] order by i)[1:4] as first from s where i >= start group by 1, 2)
select skill_id, '{fixed.OP_CHAINS["steps"][1]}' as severity, '{fixed.OP_CHAINS["steps"][2]}' as category, 'nl:' || head as node,
 n || '-step NL chain with ' || m || ' undeclared code capability misaligns. Steps: ' || array_to_string([('«' || x || '»') for x in first], ' → ') as description from p where m >= 2 or (n >= 3 and m >= 1)"""

_RARE = "ra as (select *, row_number() over (partition by skill_id, path order by event_id) as tl, k % 5 as kind, 'https://h' || k || '.example.net/b' as hidden, 'https://files.badhost.org/payload/abc' || k as plain from ev)"
ORACLE["rare_code_ops"] = _with(EV, _RARE) + """, o as (select skill_id, path, 'net_op' as op_type, 'b64_url(' || hidden[1:60] || ')' as label, false as is_write, true as is_external from ra where kind = 0
 union all select skill_id, path, 'net_op', 'url_literal(' || plain[1:60] || ')', false, true from ra where kind = 2
 union all select skill_id, path, 'io_op', 'write(/home/u' || k || '/.bashrc))', true, false from ra where kind = 1)
select skill_id, path, op_type, label, is_write, is_external, count(*) as n from o group by all"""
ORACLE["startup_writes"] = _with(EV, _RARE) + f"""select skill_id, path, tl as line, '{fixed.OP_CHAINS["stay"][1]}' as severity, '{fixed.OP_CHAINS["stay"][2]}' as category,
 'Write to persistence path «/home/u' || k || '/.bashrc» at ' || path || ':' || tl as description from ra where kind = 1"""
ORACLE["embedded_resources"] = _with(EV, _RARE) + """select skill_id, path, 'MEDIUM' as severity, tl as line, 'Suspicious hardcoded external URL: ' || plain[1:80] || ' in ' || split_part(path, '/', 2) as description from ra where kind = 2"""
ORACLE["script_imports"] = _with(EV, _RARE) + """, m as (select skill_id, path, unnest(case when kind = 3 then ['json', 'json.loads', 'json.m' || k] else ['marshal', 'os.path'] end) as module from ra where kind = 3 or (kind = 4 and k % 10 <> 4)),
e as (select skill_id, path, bool_or(kind = 4 and k % 10 = 4) as entry_point from ra group by 1, 2)
select distinct m.skill_id, m.path, module, entry_point from m join e on e.skill_id = m.skill_id and e.path = m.path"""
