"""Scalar building blocks: Column in, Column out, all evaluated inside Spark's JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from packaudit.functions import fixed


def rx(pattern: str, case: bool = False, dotall: bool = False) -> str:
    """Add Unicode-aware flags, so case folding and ``\\w`` cover all scripts."""
    return "(?" + ("" if case else "i") + ("s" if dotall else "") + "uU)" + pattern


def matches(c: Column, pattern: str, case: bool = False, dotall: bool = False) -> Column:
    return c.rlike(rx(pattern, case, dotall))


def has_any(c: Column, parts: list[str]) -> Column:
    """True when the text contains any of the fixed parts (no lower-casing here)."""
    return reduce(lambda a, b: a | b, [c.contains(p) for p in parts])


def words(c: Column) -> Column:
    """Whitespace-separated words, empty ones dropped."""
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def has_word(c: Column, vocabulary: list[str]) -> Column:
    return F.arrays_overlap(words(F.lower(c)), str_array(vocabulary))


def str_array(values: list[str]) -> Column:
    """A constant array, stated in one expression."""
    quoted = ", ".join("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values)
    return F.expr(f"array({quoted})") if values else F.array().cast("array<string>")


def empty_strings() -> Column:
    return F.array().cast("array<string>")


def ranked(c: Column, ladder: list[str]) -> Column:
    """Position of a value in an ordered list, -1 when absent."""
    return F.coalesce(F.array_position(str_array(ladder), c).cast("int"), F.lit(0)) - 1


def severity_rank(c: Column) -> Column:
    return ranked(c, fixed.SEVERITIES)


def severity_name(rank: Column) -> Column:
    return F.element_at(str_array(fixed.SEVERITIES), (rank + 1).cast("int"))


def weight_of(c: Column, weights: dict[str, float], default: float = 0.0) -> Column:
    expr = F.lit(default)
    for name, w in weights.items():
        expr = F.when(c == name, F.lit(w)).otherwise(expr)
    return expr


def logistic(x: Column, k: float, bias: float) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.lit(k) * (x - F.lit(bias))))


def basename(c: Column) -> Column:
    return F.substring_index(c, "/", -1)


def extension(c: Column) -> Column:
    """Lower-cased suffix with its dot; a leading dot alone is no suffix."""
    return F.lower(F.regexp_extract(basename(c), r".(\.[^.]*)$", 1))


def first_match(c: Column, pattern: str, group: int = 1) -> Column:
    """Captured group of the first match, null when nothing matches."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def all_matches(c: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def let(c: Column, use) -> Column:
    """Evaluate ``c`` once and hand it to ``use`` as a bound variable."""
    return F.element_at(F.transform(F.array(c), use), 1)


def entropy(c: Column) -> Column:
    """Shannon entropy in bits per character; work is length times distinct characters."""

    def of(s: Column) -> Column:
        n = F.length(s).cast("double")
        distinct = F.array_distinct(F.filter(F.split(s, ""), lambda x: x != ""))

        def add(acc: Column, ch: Column) -> Column:
            p = (n - F.length(F.replace(s, ch, F.lit("")))) / n
            return acc - p * F.log2(p)

        return F.aggregate(distinct, F.lit(0.0), add)

    return F.when(F.length(c) > 0, let(c, of)).otherwise(F.lit(0.0))


def url_domain(c: Column) -> Column:
    return F.coalesce(first_match(c, r"^https?://([^/:?#]+)"), F.substring(c, 1, 50))


def decode_base64(c: Column) -> Column:
    """Text behind a base64 run, null when it does not decode; padding is optional."""

    def of(body: Column) -> Column:
        size = (F.ceil(F.length(body) / 4) * 4).cast("int")
        raw = F.call_function("try_to_binary", F.rpad(body, size, F.lit("=")), F.lit("base64"))
        return F.when(F.length(body) % 4 != 1, F.make_valid_utf8(raw.cast("string")))

    return let(F.regexp_replace(c, r"=+$", ""), of)


def printable_share(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"(?U)[\p{Print}]")) / F.greatest(F.length(c), F.lit(1))


# ------------------------------------------------------------------ named predicates


def is_sensitive_a(c: Column) -> Column:
    return matches(c, fixed.SENSITIVE_PATH_A)


def is_sensitive_b(c: Column) -> Column:
    return matches(c, fixed.SENSITIVE_PATH_B)


def is_sensitive_contract_path(c: Column) -> Column:
    return has_any(F.lower(c), fixed.SENSITIVE_PATH_WORDS)


def is_external_a(c: Column) -> Column:
    return matches(c, fixed.EXTERNAL_URL_A)


def is_external_b(c: Column) -> Column:
    return matches(c, fixed.EXTERNAL_URL_B)


def is_trusted_url(c: Column) -> Column:
    return has_any(F.lower(c), fixed.TRUSTED_URL_PARTS)


def is_secret_env(c: Column, bounded: bool = True) -> Column:
    return matches(c, fixed.SECRET_WORD_BOUNDED if bounded else fixed.SECRET_WORD_ANY)


def is_encoding_b(c: Column) -> Column:
    """Names of encoding calls; few texts hold a mark of them, the others need no regular expression."""
    return has_any(F.lower(c), fixed.OBFUSCATION_B_MARKS) & matches(c, fixed.OBFUSCATION_B)


def is_startup_file(c: Column, names: list[str] = fixed.STARTUP_FILES_A) -> Column:
    return has_any(F.lower(c), names)


def is_benign_scope(c: Column) -> Column:
    return has_any(F.regexp_replace(F.lower(c), r"^[/~]+|[/~]+$", ""), fixed.BENIGN_SCOPES)


def is_high_risk_scope(c: Column) -> Column:
    return has_any(F.lower(c), fixed.HIGH_RISK_SCOPES) | is_sensitive_b(F.lower(c))


def is_external_host(host: Column) -> Column:
    """Whether a connect() host points outside: names, literal addresses, ``<variable>`` hints."""
    h = F.lower(F.trim(host))
    octet = [F.regexp_extract(h, r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$", i) for i in (1, 2, 3, 4)]
    a, b = octet[0].try_cast("int"), octet[1].try_cast("int")
    is_ip = reduce(lambda x, y: x & y, [F.coalesce(o.try_cast("int") <= 255, F.lit(False)) for o in octet])
    inside = (
        a.isin(0, 10, 127) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168))
        | ((a == 169) & (b == 254)) | (a >= 240)
    )
    return (
        F.when(F.coalesce(h, F.lit("")) == "", False)
        .when(h.isin(fixed.LOCAL_HOSTS), False)
        .when(h.rlike("^<.*>$"), has_any(h, fixed.HOST_HINT_TAGS))
        .when(is_ip, ~F.coalesce(inside, F.lit(False)))
        .when(h.rlike("^(fe80|fc|fd)[0-9a-f]*:"), False)
        .otherwise(~h.endswith(".local"))
    )


def is_shell_command(c: Column) -> Column:
    cmd = F.regexp_replace(F.trim(F.lower(c)), "^['\"]+|['\"]+$", "")
    return cmd.isin(fixed.SHELL_COMMANDS) | basename(cmd).isin(fixed.SHELL_BASENAMES)


def glob_to_regex(c: Column) -> Column:
    """Shell wildcard pattern to an anchored regular expression (``*``, ``?``, ``[seq]``).

    A bracket that opens no plain character set stands for itself.
    """
    quoted = F.regexp_replace(c, r"([.+^$(){}|\\])", r"\\$1")
    sets = F.regexp_replace(quoted, r"\[(?!!?(?:a-z|A-Z|0-9|\w)+\])", r"\\[")
    star = F.regexp_replace(sets, r"\*+", ".*")
    return F.concat(F.lit("(?s)^"), F.regexp_replace(F.regexp_replace(star, r"\?", "."), r"\[!", "[^"), F.lit("$"))


def matches_glob(text: Column, pattern: Column) -> Column:
    """Whether a text fits a shell wildcard pattern of its own row.

    A pattern with stars only is cut into its literal pieces: the first must start the text,
    the last must end it, and the others follow in order, each at its first place after the one
    before.  No regular expression is built for it; patterns with ``?`` or ``[seq]`` need one.
    """

    def by_pieces(pieces: Column) -> Column:
        n = F.size(pieces)
        first, last = F.element_at(pieces, 1), F.element_at(pieces, -1)
        found = lambda at, piece: F.call_function("locate", piece, text, at)

        def step(at: Column, piece: Column) -> Column:
            return F.when(at == 0, 0).otherwise(let(found(at, piece), lambda q: F.when(q == 0, 0).otherwise(q + F.length(piece))))

        end = F.aggregate(F.slice(pieces, 2, F.greatest(n - 2, F.lit(0))), F.length(first) + 1, step)
        return F.when(n == 1, text == first).otherwise(text.startswith(first) & text.endswith(last) & (end > 0) & (end <= F.length(text) - F.length(last) + 1))

    return F.when(pattern.rlike(r"[?\[]"), F.rlike(text, glob_to_regex(pattern))).otherwise(let(F.split(pattern, r"\*+"), by_pieces))
