"""Literal anchors: plain texts of which every match of a rule contains at least one.

A byte search for a few literals is far cheaper than a regular expression at every
position, so long texts are searched for anchors first and only then matched.  Anchors
are tested on ``folded`` text, in which letters that Unicode case folding treats as
ASCII letters have become those letters; so the guard never loses a match.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from packaudit.functions.columns import has_any, let

LINE = {
    "Prompt injection attempt": ["ignore", "unrestricted", "debug", "jailbreak", "developer", "disable", "reveal", "forget", "instruction", "system", "[inst]", "im_start"],
    "Known exfiltration endpoint": ["webhook.site", "requestbin", "ngrok", "burpcollaborator", "interact.sh", "oastify", "canarytokens", "pipedream"],
    "Sensitive file path reference": [".ssh", ".aws", ".gnupg", ".netrc", ".npmrc", ".env", "/etc/passwd", "/etc/shadow", ".kube", ".docker", ".git-credentials", ".pgpass"],
    "Obfuscation/encoding API usage": ["base64.", "codecs.", "binascii", "marshal", "compile", "zlib.", "rot_13", "chr", "\\x", "\\u"],
    "Time bomb pattern": ["time.now", "time.time", ".day", ".hour", ".weekday", "time.sleep"],
    "Persistence mechanism": [".bashrc", ".bash_profile", ".zshrc", ".profile", "crontab", "launchd", "plist", "systemctl", "/etc/init.d", "autostart", "startup"],
    "Supply chain attack pattern": ["curl", "pip", "wget", "npx", "eval"],
}
TIERS = {
    "direct_override": ["ignore", "disregard"],
    "role_impersonation": ["mode", "persona", "version", "unrestricted", "evil", "uncensored", "jailbroken", "pretend", "filter", "constraint", "restriction"],
    "system_leak": ["reveal", "print", "output", "tell"],
    "forget_rules": ["forget", "reset", "clear"],
    "new_instructions": ["instruction", "bypass", "command", "override"],
    "delimiter_injection": ["system", "inst]", "im_start", "im_end", "endoftext", "[sys]", "human", "assistant"],
    "safety_disable": ["disable", "bypass", "remove", "turn"],
    "exfil_command": ["send", "exfiltrate", "leak", "report"],
    "role_takeover": ["from", "henceforth", "role", "persona", "instruction"],
    "data_extraction": ["internal", "confidential", "enumerate", "instruction", "rule", "restriction"],
    "developer_mode": ["mode", "feature", "capabilit", "root"],
    "hallucination_seed": ["pretend", "assume", "simulate"],
    "scope_expansion": ["allowed", "access", "permission", "security"],
}
WEIGHTED = {
    "system_override": ["ignore", "disregard", "forget", "override", "bypass"],
    "role_switch": ["you", "act", "pretend", "roleplay"],
    "system_prompt_inject": ["system", "updated", "priority", "objective"],
    "delimiter_probe": ["untrusted_input_"],
    "boundary_inject": ["prompt", "actual", "from"],
    "hidden_action_directive": ["silently", "invisib", "hidden", "without"],
    "nl_exfil_directive": ["ssh", "aws", "api", "secret", ".env", "password", "private"],
    "classic_injection_phrase": ["everything", "directive", "attention", "important"],
    "system_prompt_exfil": ["prompt", "instruction"],
    "nl_remote_exec": ["download", "pip", "curl"],
}


def folded(text: Column) -> Column:
    """Lower case, with the letters that fold to ASCII ones replaced by them."""
    return F.lower(F.translate(text, "ſKıİ", "skii"))


def guarded(text: Column, tests) -> Column:
    """Evaluate ``tests(may)`` where ``may(anchors)`` says whether any anchor occurs.

    The text is folded once per row; no anchors means the rule is always tried.
    """
    return let(folded(text), lambda low: tests(lambda anchors: has_any(low, anchors) if anchors else F.lit(True)))
