"""Spark forms of the patterns against the plain patterns in another regex engine."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpus_audit.functions import metrics as M
from corpus_audit.functions import patterns as P
from corpus_audit.operators import api, documentation, security
from corpus_audit.operators.quality_rules import ACCESS, FUNCTIONAL, MODERN, ORGANIZATION, REPEATED_ACCESS, SMELLS
from corpus_audit.operators.security_rules import AUTH, SECURITY

CHAR = "[^\n\r\u2028\u2029]"


def plain(pattern):
    """The plain meaning, for Python's engine."""
    out = ""
    for token, _, in_class in P._tokens(pattern):
        out += CHAR if token == "." and not in_class else token
    return re.compile(out, re.ASCII)


def java_as_python(pattern):
    return re.compile(re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: "\\u" + m.group(1), pattern), re.ASCII)


FEATURES = {
    f"{family.name}.{name}": feature
    for family in (SMELLS, FUNCTIONAL, ORGANIZATION, MODERN, SECURITY, AUTH)
    for name, feature in family.features.items()
    if isinstance(feature, (P.Has, P.Count))
}
FEATURES.update({f"branch.{i}": b for i, b in enumerate(M.BRANCHES)})
FEATURES.update({f"syntax.{n}": f for n, f in M.SYNTAX.items()})
FEATURES["functions"] = M.FUNCTIONS
FEATURES.update({f"count.{p}": P.Count(p) for p in [M.TEST_CASES, M.TYPE_ANNOTATIONS, M.ANY_TYPES, *security.ROUTE_CALLS]})
PRESENCE = [
    *api.API_PATTERNS,
    *api.ERROR_HANDLING,
    *api.INPUT_VALIDATION,
    *api.AUTHENTICATION,
    *api.ROUTE_PATTERNS,
    *api.AUTH_WORDS,
    *[p for _, _, p in documentation.README_CHECKS[1:]],
    documentation.API_MARKS,
    security.CLI_USE,
    security.WEB_SERVER_USE,
    security.PRODUCTION_USE,
    security.VALIDATION_LIBRARIES,
    security.REQUEST_TO_DATABASE,
]
FEATURES.update({f"has.{i}.{p}": P.Has(p) for i, p in enumerate(PRESENCE)})
LINEAR = {n: f for n, f in FEATURES.items() if f.linear}
ORDERED = {n: f for n, f in FEATURES.items() if isinstance(f, P.Has) and P.linear_regex(f.pattern) != P.java_regex(f.pattern)}

PIECES = (
    "if else for while case catch switch try finally throw Error async await function const let var eval import from "
    "require( process.env process.env.A_B EnvManager.get NODE_ENV production load balance secure httpOnly "
    "jwt.sign resave false req.body req.body. .find validate typeof === 'string' middleware auth token verify "
    "Object.assign( return password secret api_key => && || ? : ; , . .. ... .push( .then( .catch( .getA() .getB() "
    "( ) { } [ ] < = + - / // /* TODO ' \" ` ${ a b1 _x 2 45 100 200 2001 404 77 é string number any query "
    "res.cookie( Math.random() exec( console.log app.get ( router.post ("
).split() + [" ", " ", "\n", "\n", "\r", "\t", "\u2028", "it(", "test("]


def text_of(rng, n):
    return "".join(rng.choice(PIECES) for _ in range(n))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=30).map("".join))
@pytest.mark.parametrize("name", sorted(LINEAR))
def test_linear_forms_equal_the_plain_pattern(name, text):
    feature = LINEAR[name]
    fast = java_as_python(P.java_regex(feature.linear))
    if isinstance(feature, P.Has):
        assert bool(fast.search(text)) == bool(plain(feature.pattern).search(text))
    else:
        assert len(list(fast.finditer(text))) == len(list(plain(feature.pattern).finditer(text)))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=30).map("".join))
@pytest.mark.parametrize("name", sorted(ORDERED))
def test_ordered_forms_equal_the_plain_pattern(name, text):
    feature = ORDERED[name]
    fast = java_as_python(P.linear_regex(feature.pattern))
    assert bool(fast.search(text)) == bool(plain(feature.pattern).search(text))


def test_every_feature_in_spark(spark):
    rng = random.Random(7)
    texts = [text_of(rng, rng.randrange(0, 45)) for _ in range(1500)]
    texts += ["".join(rng.choice(["if", "(", "\n", " ", "process.env", "throw", "Error", "+", "'", "a"]) for _ in range(12)) for _ in range(500)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(8)
    names = list(FEATURES)
    rows = df.select("i", "t", *[FEATURES[n].column(F.col("t")).alias(f"c{k}") for k, n in enumerate(names)]).collect()
    seen = dict.fromkeys(names, 0)
    for row in rows:
        for k, name in enumerate(names):
            feature = FEATURES[name]
            found = len(list(plain(feature.pattern).finditer(row["t"])))
            expected = found > 0 if isinstance(feature, P.Has) else found
            assert row[f"c{k}"] == expected, (name, row["t"])
            seen[name] += bool(found)
    # The random texts exercise nearly all patterns; the rest have hits in test_rules.
    assert sum(1 for n in names if seen[n] == 0) < len(names) / 2


def test_repeated_access_counts(spark):
    rng = random.Random(3)
    bits = ["a", "b", "ab", ".", ".", ".", " ", "=", "\n", "1", "_", ", ", "user.name", "x.y"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(0, 40))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(8)
    feature = ACCESS.features["repeated_access"]
    for row in df.select("t", feature.column(F.col("t")).alias("n")).collect():
        assert row["n"] == len(list(plain(REPEATED_ACCESS).finditer(row["t"]))), row["t"]


def test_walks_in_spark(spark):
    """Patterns over parentheses and braces, on texts made of their parts."""
    rng = random.Random(11)
    heads = ["for (", "for(", "function (", "function(", "if (", "if(", "switch (", "case ", "else if", "else", "const a = (", "function f", "b(", "x.y = ", ".z", "=", ") {", ") {", ")", "} ", "{", "}", ") =>", " ", "a", "\n"]
    texts = ["".join(rng.choice(heads) for _ in range(rng.randrange(0, 30))) for _ in range(6000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(8)
    built = {n: f for n, f in FEATURES.items() if isinstance(f, P.Count) and f.build is not None}
    assert len(built) >= 8
    for row in df.select("t", *[f.column(F.col("t")).alias(n.replace(".", "_")) for n, f in built.items()]).collect():
        for name, feature in built.items():
            assert row[name.replace(".", "_")] == len(list(plain(feature.pattern).finditer(row["t"]))), (name, row["t"])


def test_null_text_stays_null(spark):
    df = spark.createDataFrame([(None,)], "t string")
    row = df.select(
        P.Count(r"for\s*\(").column(F.col("t")).alias("a"), P.Count("&&").column(F.col("t")).alias("b"),
        M.line_count(F.col("t")).alias("c"),
    ).first()
    assert tuple(row) == (None, None, None)


def test_long_lines_stay_cheap(spark):
    """A single line per shape: quadratic matching would take minutes."""
    n = 20_000
    shapes = [
        "typeof === " * n,
        "async " * n,
        "throw Error " * n + "process.env.A ",
        "if (process.env.A) " + "if (a) " * n,
        "a?" * n,
        "'a' + b " * n,
        "f" * (8 * n),
        "try { catch " * n,
        "user.name, " * n,
        "token " * n,
        "a.b1 c2.d " * n,
        "( { " * n,
        *(head * (200_000 // len(head)) for head in ("if (a.b ", "for (", "function(", "if (", "switch (if (", "a(", "const a = (", "for(){for( ", "if (a.b) { a.b ")),
    ]
    df = spark.createDataFrame([(s,) for s in shapes], "t string").repartition(len(shapes))
    names = list(FEATURES)
    picked = [FEATURES[n].column(F.col("t")).alias(f"c{k}") for k, n in enumerate(names)]
    picked.append(ACCESS.features["repeated_access"].column(F.col("t")).alias("access"))
    assert len(df.select(*picked).collect()) == len(shapes)


def test_walked_repeated_access_equals_the_pattern(spark):
    """The Spark count, the SQL walk and another regex engine agree on pieces full of near misses."""
    import duckdb

    from corpus_audit.operators.quality_rules import ACCESS
    from corpus_audit.plans import position_sql as X

    rng = random.Random(18)
    plain = re.compile(r"(\w+)\.(\w+)[^=\n]*\1\.\2", re.ASCII)
    texts = ["".join(rng.choices(["a", "b", "ab", ".", ".", "a.b", "ba.ab", " ", "=", "\n", "é", "_1"], k=rng.randrange(30))) for _ in range(400)]
    texts += ["a.b" * 50, "a.b " * 50, "aa.bb aa.bb aa.b aa.bb a.b", "x.y = x.y\nx.y x.y"]
    want = {f"src/f{k}.js": len(plain.findall(t)) for k, t in enumerate(texts)}
    files = spark.createDataFrame([("r", f"src/f{k}.js", t) for k, t in enumerate(texts)], "repo string, path string, content string")
    column = ACCESS.features["repeated_access"].column(F.col("content"))
    assert {r["path"]: r["n"] for r in files.select("path", column.alias("n")).collect()} == want
    con = duckdb.connect()
    con.register("files", files.toPandas())
    walked = dict(con.execute(f"WITH RECURSIVE {X.ACCESS} SELECT path, repeated_access FROM access_features").fetchall())
    assert walked == {p: n for p, n in want.items() if n}


def test_patterns_searched_by_their_rarest_character_count_alike():
    from corpus_audit.operators.quality_rules import PROPERTY_WRITE

    rng = random.Random(6)
    pieces = ["a", "b1", "12", "_", ".", ".", "..", "=", " = ", "\n", '"', "'", "+", "é", "0123456789", "Object.assign(", "a.b", "a1.b"]
    write = plain(r"Object\.assign\(|[a-zA-Z_]\w*\.[a-zA-Z_]\w*\s*=")
    access, seen = (plain(r"\w\.\w[^\n]*\w\.\w"), plain(r"\.(?<=\w\.)\w[^\n]*\w\.\w"))
    for _ in range(6000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(30)))
        found = text.count("Object.assign(") + len(java_as_python(PROPERTY_WRITE).findall(text))
        assert found == len(write.findall(text)), text
        strings = [m.group() for m in java_as_python(M._STRINGS_BY_QUOTE).finditer(text)]
        assert strings == [m.group() for m in plain(M.DUPLICATE_STRINGS_PATTERN).finditer(text)], text
        assert bool(seen.search(text)) == bool(access.search(text)), text


def test_dense_letters_do_not_slow_the_searches_down(spark):
    """One letter or digit after another: forms that try every one of them took several times as long."""
    assert not any(re.match(r"\[a-z|\\w|\(\?i\)", f.linear or "") for f in (MODERN.features["property_chains"], SMELLS.features["todo_comments"]))
    assert SMELLS.features["todo_comments"].linear and FUNCTIONAL.features["object_mutations"].build
    row = spark.createDataFrame([("a1" * 500_000 + ".b = 1; x.a.b.c.d.e.f.g // todo",)], "t string")
    got = row.select(*[f.column(F.col("t")).alias(n) for n, f in (("w", FUNCTIONAL.features["object_mutations"]), ("c", MODERN.features["property_chains"]), ("t", SMELLS.features["todo_comments"]))]).first()
    assert tuple(got) == (1, 2, 1)


def test_repeated_lines_are_judged_as_if_trimmed(spark):
    rng = random.Random(7)
    lines = [" " * a + x * n + "\t" * b + y for a in (0, 1, 31) for x in ("a", "é ", "- ") for n in (10, 15, 16, 30, 31) for b in (0, 2, 40) for y in ("", "z")]
    texts = ["\n".join(rng.choice(lines) for _ in range(rng.randrange(60))) for _ in range(300)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", M.REPEATED_LINES.column(F.col("t")).alias("n")).collect()
    for row in rows:
        kept = [x for x in row["t"].split("\n") if len(x.strip(M.TRIMMED)) > 30]
        assert row["n"] == len(kept) - len(set(kept))
    assert "btrim" not in M.REPEATED_LINES.column(F.col("t"))._jc.toString() and "trim(both" not in M.REPEATED_LINES.column(F.col("t"))._jc.toString().lower()
