"""Paths, sizes, values and report text."""

from pyspark.sql import functions as F

from corpus_audit.functions import paths as P
from corpus_audit.functions import values as V
from corpus_audit.operators import governance, profile, rollup


def column(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["x"] for r in rows.select("i", expression(F.col("v")).alias("x")).orderBy("i").collect()]


def test_globs(spark):
    paths = ["a.js", "x/a.ts", ".h/a.js", ".a.js", "a.jsx", "src/cli.ts", "my-express-app.js", "test/a", "test/a/b", "src/x/__tests__/y", ".env", ".env.local", "c/.env", "a.env", "a.config.js", "docs/x.md", "a/doc/b/c.md", "api/openapi-1.yml"]

    def hits(globs):
        return [p for p, ok in zip(paths, column(spark, paths, lambda c: P.matches_glob(c, globs))) if ok]

    assert hits(P.CODE) == ["a.js", "x/a.ts", "src/cli.ts", "my-express-app.js", "a.config.js"]
    assert hits(P.CLI_FILES) == ["src/cli.ts"]
    assert hits(P.WEB_FILES) == ["my-express-app.js"]
    assert hits(P.TEST_DIRS) == ["test/a", "test/a/b", "src/x/__tests__/y"]
    assert hits(P.ENV_FILES) == [".env", ".env.local"]
    assert hits(P.SECRET_FILES) == ["a.js", "x/a.ts", "src/cli.ts", "my-express-app.js", "a.env", "a.config.js"]
    assert hits(P.DOC_FILES) == ["docs/x.md", "a/doc/b/c.md"]
    assert hits(P.API_SPEC_FILES) == ["api/openapi-1.yml"]


def test_extension_and_sizes(spark):
    assert column(spark, ["a.JS", "a/b.test.ts", ".env", "a/.x", "README", "a.", "x.y/z"], P.extension) == [".js", ".ts", "", "", "", ".", ""]
    sizes = [0, 512, 1024, 1536, 10 * 1024, 10 * 1024 + 1, 50 * 1024, 100 * 1024, 100 * 1024 + 1, 5 * 1024**2, 3 * 1024**3]
    assert column(spark, sizes, P.human_bytes, "bigint") == ["0 B", "512 B", "1 KB", "1.5 KB", "10 KB", "10 KB", "50 KB", "100 KB", "100 KB", "5 MB", "3 GB"]
    assert column(spark, sizes, P.size_category, "bigint") == ["small"] * 5 + ["medium", "medium", "large", "huge", "huge", "huge"]
    assert column(spark, sizes[7:9], P.is_large, "bigint") == [False, True]


def test_normalize_and_audit(spark):
    raw = [" a\\b//c/ ", "/", "a%2Fb+c", "a%zz", "%ff", "a%20b/"]
    assert column(spark, raw, P.normalize_path) == ["a/b/c", "/", "a/b+c", "a%zz", "%ff", "a b"]
    bad = ["ok/file.txt", "a\u0001b", "a/../b", "/etc/x", "a/~/b", "x" * 261, "a/${b}", "a/my-secret", "a b", "/opt/x"]
    got = column(spark, bad, lambda c: F.array_join(P.path_violations(c), ","))
    assert got == [
        "", "control_characters,unusual_characters", "traversal,dangerous_component", "restricted_directory",
        "dangerous_component", "too_long", "template,unusual_characters", "sensitive_name", "unusual_characters", "",
    ]


def test_values(spark):
    assert column(spark, ["api_key", "MY_PASS", "authority", "NAME", None], V.is_sensitive_key) == [True, True, True, False, False]
    assert column(spark, ["", None, "ab", "abcdef", "abcdefg", "abcdefghij"], V.mask_value) == ["[EMPTY]", "[EMPTY]", "**", "******", "abc*efg", "abc****hij"]
    kinds = ["", "12", "12\n", "TRUE", "http://x", "a@b.co", "a@b", "x"]
    assert column(spark, kinds, V.value_type) == ["empty", "numeric", "string", "boolean", "url", "email", "string", "string"]
    assert column(spark, [" a\u0000b\u0007\n", None], V.clean_value) == ["ab", ""]
    urls = ["https://a.b/c", "postgres://u@h/d", "nope", "http://", ""]
    assert column(spark, urls, lambda c: V.url_problem(F.lit("SERVICE_URL"), c)) == [False, False, True, True, False]


def test_required_keys(spark):
    entries = spark.createDataFrame([("r", "A", "abc"), ("r", "B", " "), ("s", "A", "a")], "repo string, key string, value string")
    rules = [{"key": "A", "min_length": 2}, {"key": "B"}, {"key": "C", "required": False}]
    checks = governance.required_key_check(entries, governance.rule_rows(spark, rules))
    assert {(r["repo"], r["key"]): r["state"] for r in checks.collect()} == {
        ("r", "A"): "ok", ("r", "B"): "missing", ("r", "C"): "ok", ("s", "A"): "too short", ("s", "B"): "missing", ("s", "C"): "ok",
    }
    assert {r["repo"]: (r["missing"], r["invalid"], r["valid"]) for r in governance.configuration_validity(checks).collect()} == {
        "r": (1, 0, False), "s": (1, 1, False),
    }


def test_the_number_of_key_rules_does_not_grow_the_plan(spark):
    entries = spark.range(300).selectExpr("concat('r', id % 30) AS repo", "concat('K', id % 10) AS key", "cast(id AS STRING) AS value").distinct().groupBy("repo", "key").agg(F.max("value").alias("value"))
    plans = []
    for n in (2, 1000):
        checks = governance.required_key_check(entries, governance.rule_rows(spark, [{"key": f"K{k}", "pattern": "^[0-9]+$"} for k in range(n)]))
        assert checks.count() == 30 * n
        plans.append(len(checks._jdf.queryExecution().optimizedPlan().toString()))
    assert plans[1] < 1.2 * plans[0]
    assert checks.where("state = 'ok'").count() == entries.count()


def test_secrets_have_an_identity(files):
    import hashlib

    from corpus_audit.operators import security

    one, two = "A" * 60 + "b", "A" * 60 + "c"
    text = f"é = '{one}'\nx = \"{two}\"; password = 'abcdefgh'\npassword = 'abcdefgh'"
    rows = security.find_secrets(files({"a.js": text, "b.js": "none"})).orderBy("offset").collect()
    assert [(r["type"], r["offset"], r["length"]) for r in rows] == [
        ("Base64 Token", text.index(one), 61), ("Base64 Token", text.index(two), 61),
        ("Hardcoded Password", text.index("password"), 21), ("Hardcoded Password", text.rindex("password"), 21),
    ]
    assert len({r["snippet"] for r in rows[:2]}) == 1 and [r["sha256"] for r in rows[:2]] == [hashlib.sha256(x.encode()).hexdigest() for x in (one, two)]


def test_sections(spark):
    texts = [
        "x ## Analysis Results\n body \n## Coordination y", "## Analysis Results\n tail ", "none",
        "## Coordination first\n## Analysis Results later",
    ]
    assert column(spark, texts, rollup.analysis_section) == ["body", "tail", "No analysis results found", "## Coordination first"]


def test_insight_scales_and_primary(spark):
    stats = spark.createDataFrame(
        [("big", f"f{i}.py", 200_000, None) for i in range(101)] + [("tiny", "a.png", 1, None), ("tiny", "b.js", 1, None), ("odd", "x.zzz", 1, None)],
        "repo string, path string, size bigint, modified timestamp",
    )
    rows = {(r["repo"], r["type"]): r for r in profile.insights(stats).collect()}
    assert rows["big", "fileSize"]["paths"] == "f0.py, f1.py, f10.py"
    assert rows["big", "scale"]["message"].startswith("Large repository: 101")
    assert ("tiny", "binaryFiles") in rows and ("tiny", "fileSize") not in rows
    assert {r["repo"]: r["primary_language"] for r in profile.primary_language(stats).collect()} == {"big": "Python", "tiny": "JavaScript", "odd": "Unknown"}
    assert {r["repo"]: r["size"] for r in profile.size_class(stats).collect()} == {"big": "Large", "tiny": "Small", "odd": "Small"}


def test_add_comments_moves_older_ones_back(spark):
    old = rollup.parse_comments(
        spark.createDataFrame(
            [("r", "security", "<!-- @api-quality: q1\nContext: c\nStatus: pending\nRound: 1\n-->\n<!-- @x: q2\nContext: c\nStatus: resolved\nRound: 2\n-->")],
            "repo string, agent string, content string",
        )
    )
    new = spark.createDataFrame([("r", "security", "documentation", "q0", "c", 1)], "repo string, agent string, target string, question string, context string, round int")
    rows = {r["comment_id"]: (r["question"], r["status"]) for r in rollup.add_comments(old, new).collect()}
    assert rows == {"comment-1": ("q0", "pending"), "comment-2": ("q1", "pending"), "comment-3": ("q2", "resolved")}


def test_project_context(files):
    from corpus_audit.operators import security

    table = files(
        [
            ("a", "src/cli.js", ""), ("a", "x.js", "express()"),
            ("b", "my-koa.ts", ""), ("b", "x.json", "pm2"),
            ("c", "package.json", '{"exports": {".": "x"}}'), ("c", "Dockerfile", ""), ("c", "x.js", "NODE_ENV == 'production'"),
            ("d", "package.json", '{"main": ""}'), ("d", "x.js", "NODE_ENV = 'production'"),
            ("e", "x.md", "express() pm2 cli"),
        ]
    )
    context = {r["repo"]: (r["project_type"], r["deployment"], r["user_facing"], r["is_production"]) for r in security.project_context(table).collect()}
    assert context == {
        "a": ("cli-tool", "development", False, False),
        "b": ("web-service", "production", True, True),
        "c": ("library", "containerized", False, True),
        "d": ("unknown", "production", False, True),
        "e": ("unknown", "development", False, False),
    }
    from corpus_audit.operators.detect import detect
    from corpus_audit.operators.security_rules import SECRET_ADVICE, SECRET_ADVICE_CLI, SECRET_ADVICE_SERVICE, SECURITY

    leak = files([(r, "y.js", "password = 'abcdefgh'; z = process.env.A") for r in "abc"])
    found = {(r["repo"], r["rule_id"]): r for r in security.with_context(detect(leak, SECURITY), security.project_context(table)).collect()}
    assert [found[r, "hardcoded-password"]["remediation"] for r in "abc"] == [SECRET_ADVICE_CLI, SECRET_ADVICE_SERVICE, SECRET_ADVICE]
    assert [found[r, "unchecked-environment"]["severity"] for r in "abc"] == ["Low", "Medium", "Medium"]
