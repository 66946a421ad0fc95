"""Each rule: a text that just fires and a near miss."""

import pytest
from pyspark.sql import functions as F

from corpus_audit.functions.patterns import Count
from corpus_audit.operators.detect import detect
from corpus_audit.operators.quality_rules import ACCESS, FUNCTIONAL, MODERN, ORGANIZATION, SMELLS
from corpus_audit.operators.rules import Rule, register_rule
from corpus_audit.operators.security_rules import AUTH, SECURITY

LOOP = "for (;;) { x }\n"
CASES = {
    "long-parameters": ("f(" + "a" * 50 + ")", "f(" + "a" * 49 + ")"),
    "magic-numbers": ("22 33 44 55", "22 33 44 5 10 100 0123 x55"),
    "deep-nesting": ("{{{{{", "{{{{ }{"),
    "todo-comments": ("// todo", "# TODO"),
    "console-statements": ("console.log console.warn console.debug", "console.log console.warn console.error"),
    "long-lines": (("x" * 121 + "\n") * 4, ("x" * 121 + "\n") * 3 + "y" * 120),
    "duplicate-lines": (("a" * 31 + "\n") * 7, ("a" * 31 + "\n") * 6 + ("b" * 30 + "\n") * 9),
    "imperative-loops": (LOOP * 3, LOOP * 2 + "while (a) { x }"),
    "array-mutations": ("a.push(1)", "push(1)"),
    "object-mutations": ("a.b = 1;" * 4, "a.b = 1;" * 3),
    "nested-loops": ("for (a) { for (b) }", "for (a) { } for (b) { }"),
    "var-declarations": ("var a", "variable a"),
    "mutability": ("let a; let b; const c", "let a; const b; const c"),
    "direct-mutations": ("a[i] = 1;" * 3, "a[i] = 1;" * 3 + "...x ...y ...z"),
    "large-file": ("\n" * 250, "\n" * 249),
    "style-magic-numbers": ("22 33 44 55", "22 33 44 200 404 500 4045"),
    "style-long-parameters": ("f(" + "a" * 60 + ")", "f(" + "a" * 59 + ")"),
    "complex-conditionals": ("switch (a) { case case case", "switch (a) { case case"),
    "duplicate-strings": ('"aaaaaaaaaa" ' * 4, '"aaaaaaaaaa" ' * 3 + '"short" "short" "short"'),
    "mixed-concerns": ("document. axios", "document. innerHTML"),
    "high-coupling": ("require( " * 11, "require( " * 10),
    "string-concatenation": ("'a' + b", "a + b"),
    "nested-ifs": ("{ if { if { if", "{ if { if {"),
    "callback-nesting": ("function (a) { function (b) { } }\n" * 3, "function (a) { function (b) { } }\n" * 2),
    "law-of-demeter": ("a.b.c.d", "a.b.c"),
    "tell-dont-ask": (".getA() .getB()", ".getA() = .getB()"),
    "ask-then-act": ("if (a.b) { a.c = 1 }\n" * 3, "if (a.b) { a.c = 1 }\n" * 2),
    "primitive-obsession": ("(a: string, b: number, c: boolean)", "(a: string, b: number, c: Date)"),
    "type-validation": ("typeof a === 'string' " * 6, "typeof a === 'string' " * 5 + "typeof a === 'object'"),
    "repetitive-access": ("x.y x.y\n" * 4, "x.y x.y\n" * 3 + "p.q\n"),
    "sql-injection": ("query(`a ${b} c`)", "query(`a b c`)"),
    "command-injection": ("exec(a + b)", "exec(a)"),
    "path-traversal": ("readFile('../x')", "readFile('./x')"),
    "hardcoded-password": ("password = 'abcdefgh'", "password = 'abcdefg'"),
    "hardcoded-api-key": ("API-KEY: 'abcdefghij'", "API-KEY: 'abcdefghi'"),
    "hardcoded-secret": ("secret='abcdefghijklmnop'", "secret='abcdefghijklmno'"),
    "hardcoded-token": ("token='abcdefghijklmnopqrst'", "token='abcdefghijklmnopqrs'"),
    "unchecked-environment": ("x = process.env.ABC", "if (process.env.ABC) x"),
    "weak-random": ("Math.random() token", "Math.random() dice"),
    "unvalidated-input": ("req.body", "req.body validate"),
    "eval-use": ("eval (x)", "medieval (x)"),
    "insecure-cookie": ("res.cookie(a)", "res.cookie(a, { httpOnly, secure })"),
    "secure-environment": ("EnvManager.maskSensitive", "EnvManager.get"),
    "validates-input": ("sanitize", "sanitize console.log"),
    "handles-errors": ("try { \n catch \n finally", "try { \n finally \n catch"),
    "jwt-not-verified": ("jwt.sign", "jwt.sign jwt.verify"),
    "weak-jwt-secret": ("jwt.sign(a, '123", "jwt.sign(a,\n'123"),
    "password-not-hashed": ("password", "password scrypt"),
    "session-resave": ("express-session", "express-session resave: false"),
    "session-uninitialized": ("express-session", "express-session saveUninitialized: false"),
    "no-csrf": ("express post", "express post csrf"),
}
FAMILIES = (SMELLS, FUNCTIONAL, ORGANIZATION, MODERN, ACCESS, SECURITY, AUTH)


def test_every_rule_has_a_case():
    assert set(CASES) == {r.rule_id for f in FAMILIES for r in f.rules}


def test_hits_and_near_misses(files):
    rows = []
    for rule, (hit, miss) in CASES.items():
        rows += [(rule, "src/auth-hit.js", hit), (rule, "src/auth-miss.js", miss)]
    found = {(r["repo"], r["path"], r["rule_id"]) for r in detect(files(rows), *FAMILIES).collect()}
    for rule in CASES:
        assert (rule, "src/auth-hit.js", rule) in found, rule
        assert (rule, "src/auth-miss.js", rule) not in found, rule


def test_scope_and_counts(files):
    table = files(
        {"a.js": "a.push(1); a.push(2)", "a.test.js": "a.push(1)", "a.min.js": "a.push(1)", "node_modules/a.js": "a.push(1)", "a.md": "a.push(1)"}
    )
    rows = detect(table, FUNCTIONAL).where("rule_id = 'array-mutations'").collect()
    assert [(r["path"], r["n"], r["description"]) for r in rows] == [("a.js", 2, "2 array mutation methods detected")]
    assert rows[0]["severity"] is None and rows[0]["polarity"] == "issue"


def test_large_file_severity(files):
    rows = detect(files({"a.js": "\n" * 300, "b.js": "\n" * 400}), ORGANIZATION).where("rule_id = 'large-file'").collect()
    assert {r["path"]: r["severity"] for r in rows} == {"a.js": "medium", "b.js": "high"}


def test_register_rule(files):
    rule = Rule("goto", "Goto", "gotos > 1", "concat(CAST(gotos AS STRING), ' gotos')", "gotos", "'High'")
    mine = register_rule(SMELLS, rule, {"gotos": Count(r"\bgoto\b")})
    rows = detect(files({"a.js": "goto x; goto y; agoto"}), mine).collect()
    assert [(r["rule_id"], r["n"], r["severity"]) for r in rows] == [("goto", 2, "High")]
    with pytest.raises(ValueError):
        register_rule(mine, rule)


def test_one_pass_equals_single_runs(files):
    table = files([(rule, "src/auth-x.js", hit) for rule, (hit, _) in CASES.items()])
    together = {tuple(r) for r in detect(table, *FAMILIES).collect()}
    apart = {tuple(r) for f in FAMILIES for r in detect(table, f).collect()}
    assert together == apart
    assert {tuple(r) for r in detect(table.repartition(5, F.rand(1)), *FAMILIES).collect()} == together


def test_appending_a_plain_line_changes_no_count(files):
    table = files([(rule, "src/auth-x.js", hit) for rule, (hit, _) in CASES.items() if rule != "large-file"])
    longer = table.withColumn("content", F.concat("content", F.lit("\nplain words")))
    keys = ["repo", "rule_id", "n"]
    before = {tuple(r) for r in detect(table, SMELLS, SECURITY, AUTH).select(*keys).collect()}
    after = {tuple(r) for r in detect(longer, SMELLS, SECURITY, AUTH).select(*keys).collect()}
    assert before == after
