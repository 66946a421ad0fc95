"""Code smells and style rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpus_audit.functions import metrics as M
from corpus_audit.functions.paths import is_source, is_style_source
from corpus_audit.functions.patterns import Count, Derived, Has, count_matches, until, walked, wide_parentheses
from corpus_audit.operators.rules import Family, Rule, counted

# --- fixed values: smell patterns, thresholds and messages -----------------------------------------
SMELL_FEATURES = {
    "long_parameters": Count(r"\([^)]{50,}\)", build=wide_parentheses(50)),
    "magic_numbers": Count(r"\b(?!0|1|-1)\d{2,}\b", linear=r"[2-9](?<!\w[2-9])\d++(?!\w)"),
    "deep_nesting": Count(r"\{[^{}]*\{[^{}]*\{[^{}]*\{[^{}]*\{"),
    "todo_comments": Count(r"(?i)//\s*TODO|/\*\s*TODO", linear=r"/[/*]\s*[Tt][Oo][Dd][Oo]", needs=("/",)),
    "console_calls": Count(r"console\.(log|debug|warn)"),
    "long_lines": M.lines_longer_than(120),
    "repeated_lines": M.REPEATED_LINES,
}

SMELL_RULES = (
    Rule(
        "long-parameters",
        "Long Parameter Lists",
        "long_parameters > 0",
        counted("long_parameters", " functions with long parameter lists"),
        "long_parameters",
    ),
    Rule(
        "magic-numbers",
        "Magic Numbers",
        "magic_numbers > 3",
        counted("magic_numbers", " potential magic numbers found"),
        "magic_numbers",
    ),
    Rule(
        "deep-nesting",
        "Deep Nesting",
        "deep_nesting > 0",
        counted("deep_nesting", " locations with >4 levels of nesting"),
        "deep_nesting",
    ),
    Rule(
        "todo-comments",
        "TODO Comments",
        "todo_comments > 0",
        counted("todo_comments", " TODO comments need attention"),
        "todo_comments",
    ),
    Rule(
        "console-statements",
        "Console Statements",
        "console_calls > 2",
        counted("console_calls", " console statements (debugging leftovers?)"),
        "console_calls",
    ),
    Rule(
        "long-lines",
        "Long Lines",
        "long_lines > 3",
        counted("long_lines", " lines exceed 120 characters"),
        "long_lines",
    ),
    Rule(
        "duplicate-lines",
        "Code Duplication",
        "repeated_lines > 5",
        counted("repeated_lines", " potentially duplicated lines"),
        "repeated_lines",
    ),
)
# --- end of fixed values ---------------------------------------------------------------------------

SMELLS = Family("smells", SMELL_FEATURES, SMELL_RULES, is_source)

# Linear forms of patterns below that span parentheses and braces, see ``walked``.  Heads before one ``)`` share what
# follows it, so a head that fails takes the text up to there with it.
FOR_LOOP_WALK = r"for\s*+\([^)]*+(?:\)\s*+\{[^{}]*+(\}))?+"
# Up to the last inner loop; if nothing closes that one, the first one tells whether there is a match at all.
_INNER_LOOP = r"for\s*+\("
NESTED_LOOP_WALK = (
    r"for\s*+\([^)]*+(?:\)\s*+(\{)(?:"
    + until(_INNER_LOOP, "{}", last=True)
    + r"[^)]*+\)|"
    + until(_INNER_LOOP, "{}")
    + r"[^)]*+\)))?+"
)
# Only the last inner function can be the one whose ``)`` a ``{`` follows.
NESTED_CALLBACK_WALK = (
    r"function\s*+\([^)]*+(?:\)\s*+(\{)" + until(r"function\s*+\(", "{}", last=True) + r"[^)]*+\)\s*+\{)?+"
)
ASK_THEN_ACT_WALK = (
    r"if\s*+\((?:" + until(r"\.\w", ")") + r"[^)]*+\)\s*+(\{)" + until(r"\.\w++\s*+=", "{}", last=True) + r"|[^)]*+)"
)


def conditional_chains(text: Column) -> Column:
    """Count of long ``switch`` and ``else if`` chains.

    The first head before a ``)`` decides, then any head of the other kind.  A failing head takes the ``)`` with
    it, so real matches are those that hold a ``)`` but don't end with it."""
    cases = r"\)\s*+\{(?:" + until("case", "{}") + "){3,}+"
    elses = r"\)\s*+\{[^{}]*+\}\s*+else\s*+if" + until(r"else\s*+if", "{}", last=True)
    heads = (r"switch\s*+\(", cases), (r"if\s*+\(", elses)
    branches = [
        f"{head}(?:[^)]*+{end}|{until(other, ')')}[^)]*+{other_end}|[^)]*+" + r"\)?+)"
        for (head, end), (other, other_end) in (heads, heads[::-1])
    ]
    found = F.regexp_extract_all(text, F.lit("|".join(branches)), 0)
    n = F.array_size(F.filter(found, lambda x: F.contains(x, F.lit(")")) & ~F.endswith(x, F.lit(")")))).cast("bigint")
    possible = F.contains(text, F.lit("case")) | F.contains(text, F.lit("else"))
    return F.when(~possible, F.lit(0).cast("bigint")).otherwise(n)


# --- fixed values: style patterns, thresholds and messages -----------------------------------------
# Searched by the dot, which is rarer than letters; behind a letter, digits may precede it.  Two matches share nothing.
PROPERTY_WRITE = r"[.0-9](?<=[a-zA-Z_][.0-9])(?:(?<=\.)|(?<=[0-9])[0-9]*+\.)[a-zA-Z_]\w*+\s*+="
REPEATED_ACCESS = r"(\w+)\.(\w+)[^=\n]*\1\.\2"

FUNCTIONAL_FEATURES = {
    "for_loops": Count(r"for\s*\([^)]*\)\s*\{[^{}]*\}", build=walked(FOR_LOOP_WALK, "for", "}")),
    "array_mutations": Count(r"\.push\(|\.pop\(|\.shift\(|\.unshift\(|\.splice\("),
    "object_mutations": Count(
        r"Object\.assign\(|[a-zA-Z_]\w*\.[a-zA-Z_]\w*\s*=",
        build=lambda text: count_matches(text, r"Object\.assign\(") + count_matches(text, "", PROPERTY_WRITE, (".", "=")),
    ),
    "nested_loops": Count(r"for\s*\([^)]*\)\s*\{[^{}]*for\s*\([^)]*\)", build=walked(NESTED_LOOP_WALK, "for", "{")),
    "const_decls": Count(M.CONST_PATTERN),
    "let_decls": Count(M.LET_PATTERN),
    "var_decls": Count(M.VAR_PATTERN),
    "spreads": Count(r"\.\.\.[\w\[\]]"),
    "indexed_assigns": Count(r"\w+\[\w+\]\s*=", linear=r"\w\[\w++\]\s*+=", needs=("[", "=")),
}

FUNCTIONAL_RULES = (
    Rule(
        "imperative-loops",
        "Imperative Loops",
        "for_loops > 2",
        counted("for_loops", " for-loops could potentially be replaced with map/filter/reduce"),
        "for_loops",
    ),
    Rule(
        "array-mutations",
        "Array Mutations",
        "array_mutations > 0",
        counted("array_mutations", " array mutation methods detected"),
        "array_mutations",
    ),
    Rule(
        "object-mutations",
        "Object Mutations",
        "object_mutations > 3",
        counted("object_mutations", " object property mutations detected"),
        "object_mutations",
    ),
    Rule(
        "nested-loops",
        "Nested Imperative Logic",
        "nested_loops > 0",
        counted("nested_loops", " nested loops that could benefit from functional composition"),
        "nested_loops",
    ),
    Rule(
        "var-declarations",
        "Variable Declaration",
        "var_decls > 0",
        counted("var_decls", " var declarations - prefer const/let"),
        "var_decls",
    ),
    Rule(
        "mutability",
        "Mutability",
        "let_decls > 0.5 * const_decls",
        "concat('High let/const ratio (', CAST(let_decls AS STRING), ':', CAST(const_decls AS STRING), "
        "') - prefer const when possible')",
        "let_decls",
    ),
    Rule(
        "direct-mutations",
        "Direct Mutations",
        "indexed_assigns > spreads AND indexed_assigns > 2",
        counted("indexed_assigns", " direct property assignments detected"),
        "indexed_assigns",
    ),
)

ORGANIZATION_FEATURES = {
    "n_lines": Derived(M.line_count, "len(string_split({text}, chr(10)))"),
    "style_numbers": Count(
        r"\b(?!0|1|-1|100|200|404|500)\d{2,}\b",
        linear=r"[2-9](?<!\w[2-9])(?!(?<=[25])00|(?<=4)04)\d++(?!\w)",
    ),
    "wide_parameters": Count(r"\([^)]{60,}\)", build=wide_parentheses(60)),
    "complex_conditionals": Count(
        r"(switch\s*\([^)]*\)\s*\{[^{}]*case[^{}]*case[^{}]*case)"
        r"|(if\s*\([^)]*\)\s*\{[^{}]*\}\s*else\s*if[^{}]*else\s*if)",
        build=conditional_chains,
    ),
    "repeated_strings": M.REPEATED_STRINGS,
    "ui_logic": Has(r"document\.|innerHTML|addEventListener|querySelector"),
    "data_access": Has(r"SELECT|INSERT|UPDATE|DELETE|fetch\(|axios|\.query\("),
    "business_logic": Has(r"validate|calculate|process|transform"),
    "imports": Count(r"import\s+.*from|require\("),
}

ORGANIZATION_RULES = (
    Rule(
        "large-file",
        "Large Files",
        "n_lines > 250",
        counted("n_lines", " lines"),
        "n_lines",
        "CASE WHEN n_lines > 400 THEN 'high' ELSE 'medium' END",
    ),
    Rule(
        "style-magic-numbers",
        "Magic Numbers",
        "style_numbers > 3",
        counted("style_numbers", " magic numbers should be named constants"),
        "style_numbers",
    ),
    Rule(
        "style-long-parameters",
        "Long Parameter Lists",
        "wide_parameters > 0",
        counted("wide_parameters", " functions with >3 parameters - consider parameter objects"),
        "wide_parameters",
    ),
    Rule(
        "complex-conditionals",
        "Complex Conditionals",
        "complex_conditionals > 0",
        counted("complex_conditionals", " complex if/switch chains - consider polymorphism"),
        "complex_conditionals",
    ),
    Rule(
        "duplicate-strings",
        "Duplicate Strings",
        "repeated_strings > 2",
        counted("repeated_strings", " duplicate string literals - consider constants"),
        "repeated_strings",
    ),
    Rule(
        "mixed-concerns",
        "Mixed Concerns",
        "CAST(ui_logic AS INT) + CAST(data_access AS INT) + CAST(business_logic AS INT) > 1",
        "concat('Multiple concerns in one file: ', concat_ws(', ', CASE WHEN ui_logic THEN 'UI' END, "
        "CASE WHEN data_access THEN 'Data Access' END, CASE WHEN business_logic THEN 'Business Logic' END))",
        "CAST(ui_logic AS INT) + CAST(data_access AS INT) + CAST(business_logic AS INT)",
    ),
    Rule(
        "high-coupling",
        "High Coupling",
        "imports > 10",
        counted("imports", " imports - consider dependency injection or module splitting"),
        "imports",
    ),
)

MODERN_FEATURES = {
    "string_concatenations": Count(r"""['"][^'"]*['"]\s*\+|['"]\s*\+\s*['"][^'"]*['"]""", needs=("+",)),
    "nested_ifs": Count(r"\{\s*if[^{}]*\{\s*if[^{}]*\{\s*if"),
    "nested_callbacks": Count(
        r"function\s*\([^)]*\)\s*\{\s*[^{}]*function\s*\([^)]*\)\s*\{", build=walked(NESTED_CALLBACK_WALK, "function", "{")
    ),
    "property_chains": Count(
        # Searched by the first dot; a dot behind the match has no word of its own before it and is taken along.
        r"\w+\.\w+\.\w+\.\w+", linear=r"\.(?<=\w\.)\w++\.\w++\.\w++\.?+", needs=(".",)
    ),
    "getter_chains": Count(r"\.get\w+\(\)[^=]*\.get\w+\(\)"),
    "ask_then_act": Count(r"if\s*\([^)]*\.\w+[^)]*\)\s*\{[^{}]*\.\w+\s*=", build=walked(ASK_THEN_ACT_WALK, "if", "{", "=")),
    "primitive_parameters": Count(
        r"\(\s*\w+\s*:\s*(string|number|boolean)[^)]*,\s*\w+\s*:\s*(string|number|boolean)"
        r"[^)]*,\s*\w+\s*:\s*(string|number|boolean)"
    ),
    "type_checks": Count(
        r"""(typeof\s+\w+\s*===\s*['"]string['"]|typeof\s+\w+\s*===\s*['"]number['"])"""
    ),
}

MODERN_RULES = (
    Rule(
        "string-concatenation",
        "String Concatenation",
        "string_concatenations > 0",
        counted("string_concatenations", " string concatenations - use template literals"),
        "string_concatenations",
    ),
    Rule(
        "nested-ifs",
        "Deep Nesting",
        "nested_ifs > 0",
        counted("nested_ifs", " deeply nested conditions - use early returns"),
        "nested_ifs",
    ),
    Rule(
        "callback-nesting",
        "Callback Nesting",
        "nested_callbacks > 2",
        counted("nested_callbacks", " nested callbacks - consider async/await"),
        "nested_callbacks",
    ),
    Rule(
        "law-of-demeter",
        "Law of Demeter",
        "property_chains > 0",
        counted("property_chains", " property chain violations (a.b.c.d pattern)"),
        "property_chains",
    ),
    Rule(
        "tell-dont-ask",
        "Tell Don't Ask",
        "getter_chains > 0",
        counted("getter_chains", " potential getter chains - consider telling objects what to do"),
        "getter_chains",
    ),
    Rule(
        "ask-then-act",
        "Ask Then Act",
        "ask_then_act > 2",
        counted("ask_then_act", " ask-then-act patterns detected"),
        "ask_then_act",
    ),
    Rule(
        "primitive-obsession",
        "Primitive Obsession",
        "primitive_parameters > 0",
        counted(
            "primitive_parameters",
            " functions with multiple primitive parameters - consider parameter objects",
        ),
        "primitive_parameters",
    ),
    Rule(
        "type-validation",
        "Type Validation",
        "type_checks > 5",
        counted("type_checks", " primitive type validations - consider domain objects"),
        "type_checks",
    ),
)

ACCESS_RULES = (
    Rule(
        "repetitive-access",
        "Repetitive Property Access",
        "repeated_access > 3",
        counted("repeated_access", " repetitive property accesses - use destructuring"),
        "repeated_access",
    ),
)
# --- end of fixed values ---------------------------------------------------------------------------


def _repeated_access(text):
    """Matches of REPEATED_ACCESS.

    A match holds neither ``=`` nor a newline, so each piece between those is counted on its own.  The
    look-ahead asks for the letters around the dot to come back later in the piece before every
    object/property length is tried, which keeps long pieces cheap.  Texts without a piece of two accesses are not cut.
    """
    from pyspark.sql import functions as F

    pieces = F.filter(F.split(text, "[=\n]"), lambda s: F.rlike(s, F.lit(r"\.(?<=\w\.)\w[^\n]*\w\.\w")))
    counted_piece = r"(?=\w*(\w\.\w)[^\n]*\1)(\w+)\.(\w+)[^\n]*\2\.\3"
    n = F.aggregate(
        F.transform(pieces, lambda s: F.regexp_count(s, F.lit(counted_piece)).cast("bigint")),
        F.lit(0).cast("bigint"),
        lambda acc, n: acc + n,
    )
    return F.when(~F.rlike(text, F.lit(r"\.(?<=\w\.)\w[^=\n]*\w\.\w")), F.lit(0).cast("bigint")).otherwise(n)


FUNCTIONAL = Family("functional-style", FUNCTIONAL_FEATURES, FUNCTIONAL_RULES, is_style_source)
ORGANIZATION = Family("organization", ORGANIZATION_FEATURES, ORGANIZATION_RULES, is_style_source)
MODERN = Family("modern-style", MODERN_FEATURES, MODERN_RULES, is_style_source)
ACCESS = Family(
    "property-access", {"repeated_access": Derived(_repeated_access, "")}, ACCESS_RULES, is_style_source
)
STYLE = (FUNCTIONAL, ORGANIZATION, MODERN, ACCESS)
