"""Reading files, exclusions, manifests, settings text and writing reports."""

import random
import re

from pyspark.sql import functions as F

from corpus_audit.operators import rollup
from corpus_audit.operators.detect import detect
from corpus_audit.operators.quality_rules import SMELLS
from corpus_audit.sources import config, exclusions, manifests, reports
from corpus_audit.sources import files as S
from corpus_audit.streaming import arrivals


def test_load_files(spark, tmp_path):
    (tmp_path / "one" / "src").mkdir(parents=True)
    (tmp_path / "one" / "src" / "a b+c.js").write_text("let é = 1;\n", encoding="utf-8")
    (tmp_path / "one" / "bad.js").write_bytes(b"ok \xff")
    (tmp_path / "two").mkdir()
    (tmp_path / "two" / "x.md").write_text("# x")
    rows = {(r["repo"], r["path"]): r for r in S.load_files(spark, str(tmp_path)).collect()}
    assert set(rows) == {("one", "src/a b+c.js"), ("one", "bad.js"), ("two", "x.md")}
    assert rows["one", "src/a b+c.js"]["content"] == "let é = 1;\n"
    assert rows["one", "bad.js"]["content"] == "ok �"
    assert rows["two", "x.md"]["size"] == 3 and rows["two", "x.md"]["modified"] is not None


def test_sizes_do_not_read_content(spark, tmp_path):
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "a.js").write_text("x")
    plan = S.load_files(spark, str(tmp_path)).select("repo", "path", "size")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1]


CASES = {
    "dist/**": (["dist/a.js", "dist/a/b", "dist"], ["src/dist/a.js", "distx/a"]),
    "**/*.min.js": (["a/x.min.js", "x.min.js"], ["x.min.ts", "xmin.js"]),
    "**/vendor/**": (["vendor/a", "a/b/vendor/c/d"], ["vendors/a"]),
    "a/**/z.js": (["a/z.js", "a/b/z.js", "a/b/c/z.js"], ["b/a/z.js", "a/z.jsx"]),
    "*.log": (["x.log", "a/b/x.log"], ["x.logs"]),
    "bundle.js": (["bundle.js", "a/bundle.js", "bundle.js/x", "a/bundle.js/x"], ["xbundle.js", "bundle.jsx"]),
    "out/": (["out/a", "a/out/b", "out"], ["outer/a"]),
    "f?.t(1)*": (["fa.t(1)x"], ["f.t(1)", "fa.t1"]),
}


def test_exclusion_modes(files):
    for pattern, (hit, miss) in CASES.items():
        table = files({p: "" for p in hit + miss})
        kept = {r["path"] for r in exclusions.exclude_paths(table, user=[pattern], defaults=[]).collect()}
        assert kept == set(miss), pattern
        # The same pattern from an ignore file.
        with_rules = files({".gitignore": f"# c\n\n {pattern} \n", **{p: "" for p in hit + miss}})
        rules = exclusions.ignore_rules(with_rules)
        kept = {r["path"] for r in exclusions.exclude_paths(with_rules, rules, defaults=[]).collect()}
        assert kept == {".gitignore", *miss}, pattern


def test_rules_stay_in_their_repository(files):
    table = files([("a", ".gitignore", "*.js"), ("a", "x.js", ""), ("b", "x.js", ""), ("a", "x.ts", "")])
    kept = exclusions.exclude_paths(table, exclusions.ignore_rules(table)).collect()
    assert {(r["repo"], r["path"]) for r in kept} == {("a", ".gitignore"), ("a", "x.ts"), ("b", "x.js")}
    summary = {r["repo"]: (r["default"], r["ignore_file"], r["total"]) for r in exclusions.exclusion_summary(table, exclusions.ignore_rules(table)).collect()}
    assert summary == {"a": (20, 1, 21), "b": (20, 0, 20)}


PIECES = ["a", "b.js", "*", "**", "?", "a*", "*.js", "**/", "/", "c.min.js", ".d", "+("]


def test_indexed_rules_equal_each_pattern_alone(spark, files):
    """Anchors lose nothing: every pattern removes what its regex matches."""
    rng = random.Random(4)
    patterns = sorted({"".join(rng.choice(PIECES) + rng.choice(["", "/"]) for _ in range(rng.randrange(1, 4))) for _ in range(150)} - {""})
    names = ["a", "b.js", "c.min.js", ".d", "xa", "a.js", "ab", "+(", "js"]
    paths = sorted({"/".join(rng.choice(names) for _ in range(rng.randrange(1, 4))) for _ in range(120)} | {"a\\b.js", "a//a", "/a"})
    rows = spark.createDataFrame([(p,) for p in patterns], "pattern string").select("pattern", F.expr(exclusions.exclusion_regex("pattern")).alias("regex"))
    regexes = {r["pattern"]: re.compile(r["regex"]) for r in rows.collect()}
    table = files([(f"r{k}", path, "") for k in range(len(patterns)) for path in paths])
    rules = spark.createDataFrame([(f"r{k}", 1, 0, p) for k, p in enumerate(patterns)], "repo string, file_rank int, pos int, pattern string")
    got = {(r["repo"], r["path"]) for r in exclusions.ignored_paths(table, rules).collect()}
    assert got == {(f"r{k}", path) for k, p in enumerate(patterns) for path in paths if regexes[p].search(path.replace("\\", "/"))}


def test_exclusions_run_no_job_before_the_sink_and_join_no_text(spark, files, tmp_path):
    files([("hot" if k % 3 == 0 else f"r{k % 9}", f"src/f{k}.js", "text " * k) for k in range(300)] + [("hot", ".gitignore", "src/f1*\n*.ts\nf9.js")]).write.parquet(f"{tmp_path}/f")
    table = spark.read.parquet(f"{tmp_path}/f")
    spark.sparkContext.setJobGroup("plans", "building plans")
    kept = exclusions.exclude_paths(table, exclusions.ignore_rules(table), ["*.log"])
    listed = S.select_files(table, table.where("path LIKE '%3.js'").select("repo", "path"))
    assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("plans")) == []
    left = {r["path"] for r in kept.where("repo = 'hot'").collect()}
    assert left == {".gitignore", *(f"src/f{k}.js" for k in range(0, 300, 3) if not f"f{k}".startswith("f1") and k != 9)}
    assert listed.count() == 30
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    plan = exclusions.ignored_paths(table, exclusions.ignore_rules(table)).select("path")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ReadSchema: struct<repo:string,path:string>") == 1


def test_manifests(files):
    good = '{"name": "n", "main": "m.js", "scripts": {"test": "t"}, "dependencies": {"a": "1", "b": "2"}, "devDependencies": {"b": "3"}}'
    table = files([("a", "package.json", good), ("b", "package.json", "{broken"), ("c", "sub/package.json", good), ("d", "package.json", "[1]")])
    rows = {r["repo"]: r for r in manifests.manifests(table).collect()}
    assert set(rows) == {"a", "b", "d"}
    assert (rows["a"]["valid"], rows["a"]["main"], rows["a"]["dependencies"]) == (True, "m.js", {"a": "1", "b": "3"})
    assert not rows["b"]["valid"] and rows["b"]["main"] is None and not rows["d"]["valid"]
    assert {(r["name"], r["version"]) for r in manifests.dependencies(manifests.manifests(table)).collect()} == {("a", "1"), ("b", "3")}


def test_config_entries(files):
    text = "# c\nA = 1\nA=2 # later\nB=\"x # y\"\nC='q r'\n bad line\n1X=2\nURL=nope\nD=\"\n E_1\t=\tv\t\n"
    rows = {r["key"]: r["value"] for r in config.config_entries(files({".env": text})).collect()}
    assert rows == {"A": "2", "B": '"x', "C": "q r", "URL": "nope", "D": "", "E_1": "v"}


def test_caps(files):
    table = files({"a.js": "x" * 30, "b.js": "y" * (500 * 1024)})
    rows = {r["path"]: r["content"] for r in S.cap_content(table, 10, 500 * 1024).collect()}
    assert rows == {"a.js": "x" * 10, "b.js": None}
    whole = {r["path"]: r["content"] for r in S.cap_content(table).collect()}
    assert whole == {"a.js": "x" * 30, "b.js": "y" * (500 * 1024)}
    assert [r["path"] for r in S.cap_per_group(table, 1, ["repo"], ["path"]).collect()] == ["a.js"]


def test_reports_round_trip(files, spark, tmp_path):
    table = files({f"f{i}.js": "// TODO\n" for i in range(8)})
    grouped = rollup.group_issues(detect(table, SMELLS), k=2)
    sections = reports.issue_sections(grouped, "code-quality", "Code Smells", 2).unionByName(
        reports.bullet_sections(table.where("path < 'f2'"), "code-quality", "Files", 1, "path")
    )
    rendered = reports.render_reports(sections, "Code Quality")
    text = rendered.first()["content"]
    assert text == (
        "### Code Quality\n\n#### Files\n\n- f0.js\n- f1.js\n\n#### Code Smells\n\n**TODO Comments** (8 issues):\n"
        "- f0.js: 1 TODO comments need attention\n- f1.js: 1 TODO comments need attention\n\n\n"
    )
    reports.write_reports(rendered, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).first()["agent"] == "code-quality"
    reports.write_markdown(rendered, str(tmp_path / "md"))
    assert (tmp_path / "md" / "agent=code-quality").is_dir()


def test_arriving_files_get_the_same_issues(files, spark, tmp_path):
    table = files({f"f{i}.js": "// TODO\n" for i in range(6)})
    table.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    query = arrivals.write_issue_stream(
        arrivals.issue_stream(stream, SMELLS), str(tmp_path / "out"), "issues", checkpoint=str(tmp_path / "cp")
    )
    query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).select("path", "rule_id", "n").collect()
    want = detect(table, SMELLS).select("path", "rule_id", "n").collect()
    assert {tuple(r) for r in got} == {tuple(r) for r in want}
