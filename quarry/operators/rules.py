"""Rule scans over code units (J7-J10) and lexical features.

Rules are a fixed list of a few dozen patterns, so instead of joining units
to a rule table each rule becomes a column expression evaluated once per unit
(no shuffle, no join).  A rule that matches writes a mark before each match,
once, and the marked text is split into lines: a line's marks are its matches,
so the work grows with the text and not with matches times text.  A pattern runs
on a unit only if the unit has the literals without which the pattern cannot match
(a substring test costs far less than a regex that fails at every place).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.fixed import C_RULES, CALL_RULE_REGEX, CALL_RULES, JSON_TOOL_SEVERITY, KEYWORD_RULES, SEVERITY_CONFIDENCE, TEXT_RULES
from ..functions import text as TX
from .segment import find_functions, segment_units  # noqa: F401 (U2)


#: A private-use character; one in the text becomes its neighbour before marking.
MARK, OTHER = "\ue000", "\ue001"


#: More alternatives than these are no test that costs less than the regex.
_MOST_LITERALS = 12


def needed_literals(pattern: str) -> list[frozenset[str]]:
    """Sets of lower-case ASCII literals: a text that ``pattern`` matches, with or without regard
    to the case of ASCII letters, holds one of each set once it is in lower case.  What the pattern may leave out
    (optional parts, classes, lookarounds, references) asks for nothing."""

    def walk(tree) -> list[frozenset[str]]:
        found, run = [], ""
        for op, arg in [*tree, (None, None)]:
            if op is _parser.LITERAL and arg < 128:
                run += chr(arg).lower()
                continue
            if run:
                found.append(frozenset([run]))
            run = ""
            if op is _parser.SUBPATTERN:
                found += walk(arg[-1])
            elif op in (_parser.MAX_REPEAT, _parser.MIN_REPEAT, _parser.POSSESSIVE_REPEAT) and arg[0] > 0:
                found += walk(arg[2])
            elif op is _parser.ATOMIC_GROUP:
                found += walk(arg)
            elif op is _parser.BRANCH:
                # of each alternative its longest literals
                each = [max(walk(x), key=lambda c: min(map(len, c)), default=None) for x in arg[1]]
                if None not in each:
                    found.append(frozenset().union(*each))
        return [c for c in dict.fromkeys(found) if len(c) <= _MOST_LITERALS]

    return walk(_parser.parse(pattern))


def may_match(has: Callable[[str], Column], pattern: str) -> Column:
    """False if ``pattern`` cannot match for lack of literals; ``has`` tests for one."""
    ok = F.lit(True)
    for clause in needed_literals(pattern):
        some = F.lit(False)
        for x in sorted(clause):
            some = some | has(x)
        ok = ok & some
    return ok


def literal_tests(units: DataFrame, low: str, patterns: Sequence[str]) -> tuple[DataFrame, dict[str, Column]]:
    """``units`` with a column a literal and, by pattern, whether it may match.  A literal is
    searched once in each text ``low``, and only in those that hold the single characters that
    all the patterns asking for it need."""
    text, needs = F.col(low), {p: needed_literals(p) for p in patterns}
    literals = sorted({x for clauses in needs.values() for clause in clauses for x in clause})
    names = {x: f"_has{i}" for i, x in enumerate(literals)}
    single = {p: {x for clause in clauses if len(clause) == 1 for x in clause if len(x) == 1} for p, clauses in needs.items()}
    chars = set().union(*single.values())
    units = units.withColumns({names[x]: text.contains(x) for x in literals if x in chars})
    tests = {}
    for x in literals:
        if x not in chars:
            asking = [single[p] for p, clauses in needs.items() if any(x in clause for clause in clauses)]
            test = F.lit(True)
            for char in sorted(set.intersection(*asking)):
                test = test & F.col(names[char])
            tests[names[x]] = test & text.contains(x)
    units = units.withColumns(tests)
    units = units.withColumns({f"_may{i}": may_match(lambda x: F.col(names[x]), p) for i, p in enumerate(needs)})
    return units, {p: F.col(f"_may{i}") for i, p in enumerate(needs)}


def match_lines(code: Column, pattern: str) -> Column:
    """Lines with matches of ``pattern``: array of (off: 0-based line, text: the line,
    n: matches that start in it)."""
    marked = F.regexp_replace(F.translate(code, MARK, OTHER), pattern, MARK + "$0")
    own = F.split(code, "\n", -1)  # marks break no line, so a line's text is the untouched one
    lines = F.transform(
        F.split(marked, "\n", -1),
        lambda l, i: F.struct(i.alias("off"), F.get(own, i).alias("text"),
                              (F.length(l) - F.length(F.translate(l, MARK, ""))).alias("n")))
    return F.when(code.rlike(pattern), F.filter(lines, lambda x: x["n"] > 0))


def live_c_rules(re2_only: bool = False) -> list[tuple]:
    """(cwe, name, severity, idx, pattern, message, safe[]) for patterns the
    reference's engine accepts (one pattern is rejected there and skipped)."""
    out = []
    for cwe, name, sev, pats, safe in C_RULES:
        for i, (p, msg) in enumerate(pats):
            try:
                re.compile(p)
            except re.error:
                continue
            if re2_only and (("(?!" in p) or re.search(r"\\[1-9]", p)):
                continue
            out.append((cwe, name, sev, i, p, msg, safe))
    return out


def scan_rules(units: DataFrame, rules: Sequence[tuple] | None = None, code: str = "code",
               flags: str = "(?is)", tool: str = "pattern_matcher") -> DataFrame:
    """Every match of every rule: one finding row per (unit, rule, match).

    Safe-pattern demotion: when any safe pattern of the CWE matches anywhere
    in the unit, severity becomes LOW and confidence round(conf * 0.6, 2).
    Returns (uid, file_path, tool, rule_id, cwe_id, cwe_name, severity,
    confidence, message, line, highlighted_code)."""
    rules = list(rules if rules is not None else live_c_rules())
    c = F.col(code)
    # one safe-pattern flag per CWE, evaluated once per unit and shared by its rules
    safe_sets, of_cwe = {}, {}
    for cwe, name, sev, idx, p, msg, safe in rules:
        safe_sets.setdefault(cwe, tuple(safe))
        of_cwe.setdefault(cwe, []).append(p)
    # each text is put in lower case once; the literals of the safe patterns are tested where a rule may match
    units = units.withColumn("_low", F.lower(c))
    units, may = literal_tests(units, "_low", [r[4] for r in rules])
    low, flag_cols, safe_flags = F.col("_low"), {}, {}
    for k, (cwe, safe) in enumerate(safe_sets.items()):
        asked, flag = F.lit(False), F.lit(False)
        for p in of_cwe[cwe]:
            asked = asked | may[p]
        for sp in safe:
            flag = flag | (may_match(low.contains, sp) & c.rlike(flags + sp))
        flag_cols[cwe] = f"_safe{k}"
        safe_flags[f"_safe{k}"] = asked & flag
    units = units.withColumns(safe_flags).drop("_low")
    hits = []
    for cwe, name, sev, idx, p, msg, safe in rules:
        has_safe = F.col(flag_cols[cwe])
        conf = SEVERITY_CONFIDENCE[sev]
        offs = F.when(may[p], match_lines(c, flags + p))
        hits.append(F.struct(
            F.lit(cwe).alias("cwe_id"), F.lit(name).alias("cwe_name"), F.lit(f"{cwe}#{idx}").alias("pattern_id"),
            F.when(has_safe, F.lit("LOW")).otherwise(F.lit(sev)).alias("severity"),
            F.when(has_safe, F.lit(round(conf * 0.6, 2))).otherwise(F.lit(conf)).alias("confidence"),
            F.lit(msg).alias("message"), offs.alias("lines")))
    # keep only matching rules before generating rows; the text itself is not carried on
    matched = F.filter(F.array(*hits), lambda h: h["lines"].isNotNull())
    per = units.select("uid", "file_path", "start_line", F.inline(matched))
    ex = per.select("*", F.inline("lines")).drop("lines")
    ex = ex.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("n"))))
    return ex.select(
        "uid", "file_path", F.lit(tool).alias("tool"), F.concat(F.lit("regex:"), F.col("cwe_id")).alias("rule_id"),
        "pattern_id", "cwe_id", "cwe_name", "severity", "confidence", "message",
        (F.col("start_line") + F.col("off")).alias("line"),
        F.regexp_replace("text", r"^\s+|\s+$", "").alias("highlighted_code"))


def detect_rules(units: DataFrame, code: str = "code", flags: str = "(?id)") -> DataFrame:
    """Rule base 2: one row per (unit, CWE) having a vulnerable pattern and no safe one."""
    c = F.col(code)
    rows = []
    for cwe, name, sev, text, pats, safe, mit, fix in TEXT_RULES:
        vul = F.lit(False)
        for p in pats:
            vul = vul | c.rlike(flags + p)
        ok = F.lit(False)
        for sp in safe:
            ok = ok | c.rlike(flags + sp)
        rows.append(F.struct(F.lit(cwe).alias("cwe_id"), F.lit(name).alias("name"), F.lit(sev).alias("severity"),
                             F.lit(text).alias("description"), F.lit(mit).alias("mitigation"),
                             F.lit(fix).alias("example_fix"), (vul & ~ok).alias("_hit")))
    return (units.select("uid", F.inline(F.array(*rows))).filter("_hit").drop("_hit")
            .withColumn("confidence", F.lit("high")))


def detect_keywords(units: DataFrame, code: str = "code") -> DataFrame:
    """Lower-cased substring tests; ['CWE-Unknown'] when nothing matches."""
    low = F.lower(F.col(code))
    labels = []
    for cwe, needles, name in KEYWORD_RULES:
        hit = F.lit(False)
        for n in needles.split("|"):
            hit = hit | low.contains(n)
        labels.append(F.when(hit, F.lit(f"{cwe}: {name}")))
    arr = F.array_compact(F.array(*labels))
    return units.select("uid", F.when(F.size(arr) == 0, F.array(F.lit("CWE-Unknown"))).otherwise(arr).alias("cwe_types"))


def scan_calls(units: DataFrame, code: str = "code") -> DataFrame:
    """Call rules rendered as regexes, scanned like J7 (case-sensitive)."""
    rules = []
    for rid, level, cwe, msg in CALL_RULES:
        sev = JSON_TOOL_SEVERITY.get(level, "LOW")
        rules.append((cwe, rid, sev, 0, CALL_RULE_REGEX[rid], msg, []))
    out = scan_rules(units, rules, code, flags="(?s)", tool="call_rules")
    return out.withColumn("rule_id", F.col("cwe_name")).withColumn("cwe_name", F.lit(None).cast("string"))


# ------------------------------------------------------------------ lexical features
UNSAFE_FUNCS = ["strcpy", "strcat", "sprintf", "vsprintf", "gets", "scanf", "memcpy", "memmove"]
SAFE_FUNCS = ["strncpy", "strncat", "snprintf", "fgets", "strlcpy", "memcpy_s"]


_NOT_WORD_BEFORE = r"(?<![A-Za-z0-9_])"
_NOT_WORD_AFTER = r"(?![A-Za-z0-9_])"


def ascii_b(pattern: str) -> str:
    """Rewrite \\b as an ASCII word boundary (Java 17's \\b also treats non-ASCII
    letters as word characters, unlike its ASCII \\w); feature counts then mean
    the same on any text.  In the feature patterns every \\b touches a word
    character, so a leading one is 'no word char before' and any other one
    'no word char after' (cheaper than a general boundary test)."""
    out, i = [], 0
    while i < len(pattern):
        if pattern.startswith("\\\\", i):
            out.append("\\\\")
            i += 2
            continue
        if pattern.startswith("\\b", i):
            prev = pattern[i - 1] if i else ""
            out.append(_NOT_WORD_BEFORE if prev in ("", "|", "(") or pattern.endswith("(?:", 0, i) else _NOT_WORD_AFTER)
            i += 2
            continue
        out.append(pattern[i])
        i += 1
    return "".join(out)


def _count(code: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(code, F.lit(ascii_b(pattern)), 0))


def _moments(state: Column, x: Column) -> Column:
    """Count, mean and sum of squares around the mean after one more value (one pass, and no
    sum of squares that could leave 64 bits)."""
    k, d = state["k"] + 1, x - state["mean"]
    mean = state["mean"] + d / k
    return F.struct(k.alias("k"), mean.alias("mean"), (state["m2"] + d * (x - mean)).alias("m2"))


def _after(state: Column, d: Column) -> Column:
    """Depth, its maximum, sum and sum of squares after one more brace."""
    return F.struct(d.alias("d"), F.greatest(state["m"], d).alias("m"), (state["s"] + d).alias("s"), (state["q"] + d * d).alias("q"))


def lexical_features(units: DataFrame, code: str = "code") -> DataFrame:
    c = F.col(code)
    lines = F.split(c, "\n", -1)
    lens = F.transform(lines, lambda l: F.length(l).cast("long"))
    n = F.size(lines)
    blank = F.size(F.filter(lines, lambda l: TX.is_blank(l)))
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)
    mean = total(lens) / n
    moments = F.aggregate(lens, F.struct(*[F.lit(0.0).alias(x) for x in ("k", "mean", "m2")]), _moments)
    braces = F.regexp_extract_all(c, F.lit(r"[{}]"), 0)
    depth = F.aggregate(
        braces, F.struct(*[F.lit(0).cast("long").alias(x) for x in ("d", "m", "s", "q")]),
        lambda s, b: _after(s, s["d"] + F.when(b == "{", 1).otherwise(-1)))
    k = F.size(braces)
    unsafe = _count(c, r"\b(?:" + "|".join(UNSAFE_FUNCS) + r")\s*\(")
    safe = _count(c, r"\b(?:" + "|".join(SAFE_FUNCS) + r")\s*\(")
    branches = _count(c, r"\b(?:if|for|while|case|catch)\b|&&|\|\|")
    return units.select(
        "uid", n.alias("total_lines"), blank.alias("blank_lines"),
        F.round(blank / n, 6).alias("blank_ratio"), F.round(mean, 6).alias("mean_line_length"),
        unsafe.alias("unsafe_calls"), safe.alias("safe_calls"), branches.alias("branches"),
        (branches + 1).alias("cyclomatic"), depth["m"].cast("int").alias("max_brace_depth"),
        F.round(F.sqrt(moments["m2"] / n), 6).alias("std_line_length"),
        F.round(F.when(k == 0, 0.0).otherwise(F.sqrt((depth["q"] * k - depth["s"] * depth["s"]).cast("double")) / k), 6)
        .alias("std_brace_depth"),
        _count(c, r"\b(?:malloc|calloc|realloc|strdup)\s*\(").alias("allocations"),
        _count(c, r"\bfree\s*\(").alias("frees"),
        _count(c, r"\w\s*\*\s*\w").alias("pointer_ops"),
    )


# ------------------------------------------------------------------ X5-X7
CONTROL_KW = ["if", "for", "while", "switch", "catch", "do"]
HALSTEAD_OPERATORS = r"[-+*/%=<>!&|^~?:]+|\b(?:sizeof|return|if|else|for|while|do|switch|case|break|continue|goto)\b|[\[\]().,;{}]"
HALSTEAD_OPERANDS = r"\b[A-Za-z_]\w*\b|\b\d+(?:\.\d+)?\b|\"[^\"]*\"|'[^']*'"


def complexity_features(units: DataFrame, code: str = "code") -> DataFrame:
    """X5 bounds-check score and X7 Halstead measures (our definitions; the
    reference's extractor is not in its tree).

    bounds = accesses * (1 - min(checks, accesses) / accesses), accesses are
    ``name[`` index expressions and checks are if/while conditions with < or >.
    Halstead: n1/n2 distinct operators/operands, N1/N2 totals,
    difficulty = n1 / 2 * N2 / n2 (0 without operands)."""
    c = F.col(code)
    acc = _count(c, r"[A-Za-z_]\w*\s*\[")
    chk = _count(c, r"\b(?:if|while)\s*\([^)]*[<>]")
    bounds = (acc - F.least(chk, acc)).cast("double")  # = acc * (1 - min(chk, acc) / acc), exactly
    ops = F.regexp_extract_all(c, F.lit(ascii_b(HALSTEAD_OPERATORS)), 0)
    opd = F.regexp_extract_all(c, F.lit(ascii_b(HALSTEAD_OPERANDS)), 0)
    n1, n2 = F.size(F.array_distinct(ops)), F.size(F.array_distinct(opd))
    N1, N2 = F.size(ops), F.size(opd)
    diff = F.when(n2 == 0, F.lit(0.0)).otherwise((n1 * N2).cast("double") / (n2 * 2).cast("double"))
    return units.select("uid", acc.alias("accesses"), chk.alias("checks"), bounds.alias("bounds_score"),
                        n1.alias("n1"), n2.alias("n2"), N1.alias("N1"), N2.alias("N2"), diff.alias("halstead_difficulty"))


def cognitive_complexity(units: DataFrame, code: str = "code") -> DataFrame:
    """Each control keyword adds 1 + current nesting; only braces opened
    right after a control keyword increase nesting; '}' closes the innermost
    brace first.  State (nesting, pending, score, brace stack) folds over the
    token array of each unit."""
    toks = F.regexp_extract_all(F.col(code), F.lit(ascii_b(r"\b(?:" + "|".join(CONTROL_KW) + r")\b|[{}]")), 0)
    init = F.struct(F.lit(0).alias("nest"), F.lit(False).alias("pend"), F.lit(0).alias("score"),
                    F.array().cast("array<boolean>").alias("stack"))

    def step(s, t):
        is_kw = (t != "{") & (t != "}")
        opened = F.concat(s["stack"], F.array(s["pend"]))
        top = F.get(s["stack"], F.size(s["stack"]) - 1)
        popped = F.slice(s["stack"], 1, F.greatest(F.size(s["stack"]) - 1, F.lit(0)))
        return F.when(is_kw, F.struct(s["nest"].alias("nest"), F.lit(True).alias("pend"),
                                      (s["score"] + 1 + s["nest"]).alias("score"), s["stack"].alias("stack"))) \
            .when(t == "{", F.struct((s["nest"] + F.when(s["pend"], 1).otherwise(0)).alias("nest"), F.lit(False).alias("pend"),
                                     s["score"].alias("score"), opened.alias("stack"))) \
            .otherwise(F.struct((s["nest"] - F.when(F.coalesce(top, F.lit(False)), 1).otherwise(0)).alias("nest"),
                                s["pend"].alias("pend"), s["score"].alias("score"), popped.alias("stack")))

    res = F.aggregate(toks, init, step)
    return units.select("uid", res["score"].alias("cognitive_complexity"))
