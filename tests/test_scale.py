"""Plans that must hold at a thousand times the data, and results under a hot repository."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpus_audit.operators import documentation, metrics, profile, rollup, security
from corpus_audit.operators.detect import detect
from corpus_audit.operators.quality_rules import FUNCTIONAL, MODERN, ORGANIZATION, SMELLS
from corpus_audit.operators.security_rules import AUTH, SECURITY
from corpus_audit.plans.catalog import QUERIES
from corpus_audit.sources import exclusions, manifests
from corpus_audit.sources.files import cap_per_group

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def stored(spark, tmp_path):
    """A files table on disk where one repository holds a third of the rows."""
    rows = []
    for i in range(900):
        repo = "hot" if i % 3 == 0 else f"r{i % 50}"
        rows.append((repo, f"src/auth-f{i:04}.js", f"// TODO {i}\n" + "a.push(1);\n" * (i % 4) + "eval(x);\n" * (i % 2), i))
    spark.createDataFrame(rows, "repo string, path string, content string, size bigint").repartition(6).write.parquet(
        str(tmp_path / "files")
    )
    return spark.read.parquet(str(tmp_path / "files")), rows


def test_no_query_pairs_everything_with_everything(spark):
    for name, query in QUERIES.items():
        plan = plan_of(query(spark, SF))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_detectors_never_shuffle(stored):
    files, _ = stored
    plan = plan_of(detect(files, SMELLS, FUNCTIONAL, ORGANIZATION, MODERN, SECURITY, AUTH))
    assert "Exchange" not in plan and plan.count("FileScan") == 1
    assert "ReadSchema: struct<repo:string,path:string,content:string>" in plan


def test_filters_on_metrics_do_not_repeat_the_work(stored):
    files, _ = stored
    plan = plan_of(metrics.complex_files(metrics.file_metrics(files)))
    assert plan.count(r"catch\s*\(") == 1 and "Exchange" not in plan


def test_path_only_queries_do_not_read_texts(stored):
    files, _ = stored
    for df in (
        profile.file_type_counts(files),
        profile.config_files(files),
        documentation.undocumented_configs(files),
        profile.largest_files(files),
        profile.insights(files),
    ):
        assert all("content" not in schema for schema in re.findall(r"ReadSchema: struct<([^>]*)>", plan_of(df)))


def test_top_k_is_cut_before_the_shuffle(stored):
    files, _ = stored
    issues = detect(files, SECURITY)
    for df in (
        security.top_high_issues(issues),
        profile.largest_files(files),
        cap_per_group(files, 3, ["repo"], ["path"]),
        rollup.group_issues(issues, k=5),
    ):
        plan = plan_of(df)
        assert re.search(r"Exchange hashpartitioning[^\n]*\n[^\n]*WindowGroupLimit[^\n]*Partial", plan), plan


def test_hot_repository_results(stored):
    files, rows = stored
    issues = detect(files, SMELLS, FUNCTIONAL, SECURITY)
    want = Counter()
    for repo, _, content, _ in rows:
        want[repo, "TODO Comments"] += 1
        want[repo, "Array Mutations"] += "push" in content
        want[repo, "Code Injection"] += "eval" in content
    got = {(r["repo"], r["type"]): r for r in rollup.group_issues(issues, k=2).collect()}
    for (repo, kind), n in want.items():
        assert (got[repo, kind]["issues"] if n else 0) == n
    hot = sorted(p for r, p, _, _ in rows if r == "hot")
    assert [line.split(":")[0] for line in got["hot", "TODO Comments"]["lines"]] == hot[:2]
    top = [(r["rank"], r["path"]) for r in profile.largest_files(files).where("repo = 'hot'").orderBy("rank").collect()]
    assert [p for _, p in top] == [p for r, p, _, s in sorted(rows, key=lambda x: -x[3]) if r == "hot"][:10]
    summary = {r["repo"]: r["critical"] for r in security.severity_summary(issues).collect()}
    assert summary["hot"] == sum("eval" in c for r, _, c, _ in rows if r == "hot")


def test_context_takes_one_scan_of_the_texts_and_no_sort_of_issues(stored):
    files, _ = stored
    found = security.issues_in_context(files, SECURITY)
    plan = plan_of(found)
    assert "content" not in "".join(re.findall(r"ReadSchema: struct<([^>]*)>", plan))
    assert "Sort" not in plan and "BroadcastHashJoin" in plan
    apart = security.with_context(detect(files, SECURITY), security.project_context(files))
    assert {tuple(r) for r in found.collect()} == {tuple(r) for r in apart.collect()}


def test_every_context_occurs(spark):
    rows = {(r["project_type"], r["deployment"]) for r in QUERIES["project_context"](spark, SF).collect()}
    assert {("library", "development"), ("web-service", "production"), ("cli-tool", "containerized")} <= rows
    advice = {r["remediation"] for r in QUERIES["contextual_vulnerabilities"](spark, SF).where("type = 'Information Disclosure'").collect()}
    assert advice == {security.R.SECRET_ADVICE, security.R.SECRET_ADVICE_CLI, security.R.SECRET_ADVICE_SERVICE}


def test_repartitioning_changes_nothing(stored):
    files, _ = stored
    a = detect(files, SMELLS, SECURITY)
    b = detect(files.repartition(13, F.rand(3)), SMELLS, SECURITY)
    assert {tuple(r) for r in a.collect()} == {tuple(r) for r in b.collect()}


def test_selective_path_filters_reach_the_scan(stored):
    files, _ = stored
    assert "StringStartsWith(path,README)" in plan_of(documentation.readme_score(files))
    assert "StringStartsWith(path,.env)" in plan_of(security.env_files(files))
    assert "EqualTo(path,package.json)" in plan_of(manifests.manifests(files))
    assert "EqualTo(path,.gitignore)" in plan_of(exclusions.ignore_rules(files))


def test_reports_hold_every_line_once(stored):
    files, _ = stored
    issues = detect(files, SMELLS, FUNCTIONAL, SECURITY)
    rows = rollup.group_issues(issues, part_lines=7).collect()
    want = Counter((r["repo"], r["type"], f"{r['path']}: {r['description']}") for r in issues.collect())
    assert Counter((r["repo"], r["type"], line) for r in rows for line in r["lines"]) == want
    totals = Counter()
    for (repo, kind, _), n in want.items():
        totals[repo, kind] += n
    assert all(r["issues"] == totals[r["repo"], r["type"]] for r in rows)
    lines, parts = Counter(), {}
    for r in rows:
        lines[r["repo"], r["part"]] += len(r["lines"])
        parts.setdefault(r["repo"], set()).add(r["part"])
    for repo, found in parts.items():
        assert found == set(range(len(found))) and all(lines[repo, p] == 7 for p in found if p < len(found) - 1)
    assert len(parts["hot"]) > 40


def test_prompts_hold_every_character_once(spark, files):
    from corpus_audit.sources import manifests

    rows = [("hot", f"src/f{i:03}.js", "é" * (37 * i % 211)) for i in range(80)] + [("r", "a.js", "x" * 5000), ("r", "b.ts", ""), ("r", "c.ts", "y"), ("t", "z.xyz", "not read")]
    table = files(rows).repartition(5)
    structure = profile.repo_structure(table, manifests.manifests(table))
    prompts = rollup.build_prompts(table, structure, {"security": "Security", "next-task": "Next Task"}, part_chars=300).collect()
    for repo, names in (("hot", 80), ("r", 3)):
        frames = "".join(f"\n--- {p} ---\n{c or rollup.NO_CONTENT}\n" for r, p, c in sorted(rows) if r == repo)
        for agent, name in (("security", "Security"), ("next-task", "Next Task")):
            mine = sorted((r["part"], r["parts"], r["prompt"], r["prompt_length"]) for r in prompts if r["repo"] == repo and r["agent"] == agent)
            language = "JavaScript" if repo == "hot" else "TypeScript"
            header = rollup.PROMPT_HEADER % (language, name, names, language, "No" if repo == "hot" else "Yes", "No", "No")
            assert [p for p, *_ in mine] == list(range(-(-len(frames) // 300))) and {n for _, n, _, _ in mine} == {len(mine)}
            assert "".join(t.removeprefix(header) for _, _, t, _ in mine) == frames
            assert all(t.startswith(header) and len(t) == n and len(t) - len(header) <= 300 for _, _, t, n in mine)
    first = rollup.build_prompts(table, structure, {"security": "Security"}, max_files=1, chars=4).where("repo = 'r'").first()
    assert first["prompt"].endswith("Files to analyze:\n\n--- a.js ---\nxxxx\n") and "Total files: 1\n" in first["prompt"]
    assert not any(r["repo"] == "t" for r in prompts)


def test_texts_of_prompts_are_never_dealt_by_repository(spark, stored):
    files, _ = stored
    prompts = rollup.build_prompts(files, profile.repo_structure(files, manifests.manifests(files)), part_chars=300)
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    plan = prompts._jdf.queryExecution().explainString(mode)
    dealt = re.findall(r"Exchange\nInput \[\d+\]: \[([^\n]*)\]\nArguments: hashpartitioning\(([^\n]*), \d+\)", plan)
    texts = [by for columns, by in dealt if re.search(r"\b(content|frame|buf|body)#", columns)]
    assert texts and all("part#" in by or "path#" in by for by in texts), texts


def test_new_comments_of_a_hot_report(spark):
    new = spark.range(3000).selectExpr("'r' AS repo", "IF(id % 3 = 0, 'security', concat('a', id % 7)) AS agent", "'x' AS target", "lpad(id, 6, '0') AS question", "'c' AS context", "1 AS round")
    old = spark.createDataFrame([("r", "security", 1, "t", "old", "c", "resolved", 1)], "repo string, agent string, comment_no int, target string, question string, context string, status string, round int")
    rows = rollup.add_comments(old, new.repartition(6)).where("agent = 'security'").orderBy("comment_no").collect()
    assert [r["comment_no"] for r in rows] == list(range(1, 1002)) and rows[-1]["question"] == "old"
    assert [r["question"] for r in rows[:-1]] == [f"{k:06}" for k in range(0, 3000, 3)]


def test_running_sums_over_ranges(spark):
    from corpus_audit.operators.numbering import placed

    rows = [("a" if k % 3 else None, k, k % 5) for k in range(500)]
    got = placed(spark.createDataFrame(rows, "g string, k int, w int").repartition(7), ["g"], ["k"], weight="w").collect()
    sums = Counter()
    for g, k, w in rows:
        (row,) = [r for r in got if r["k"] == k] if k % 50 == 0 else [None]
        if row:
            assert row["place"] == sums[g] and row["total"] == sum(x for y, _, x in rows if y == g)
        sums[g] += w
    assert len(got) == 500


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from corpus_audit.operators.numbering import shared_folder

    def session(master, folder):
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda d: None)
        return SimpleNamespace(sparkContext=context, conf={"spark.checkpoint.dir": folder} if folder else {})

    assert shared_folder(session("spark://host:7077", "hdfs://shared")) == "hdfs://shared"
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            shared_folder(session(master, None))
    assert shared_folder(session("local[4]", None))
