"""Tables derived from the sample data by expressions that Spark and plain SQL evaluate alike.

Every table has a Spark builder ``(spark, sf_dir) -> DataFrame`` and the text of an equal SQL common table
expression, so a query over it can be checked in another engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_audit.plans.snippets import SNIPPETS

REPO_FILES = 50  # documents per derived repository; below len(SNIPPETS), so no path repeats
HOT = 3  # every third document, if its snippet's path names it, belongs to one large repository
# Small repositories of their own, one for every so many documents: what they are, and their files.
OWN = 40
OWN_FILES = [
    ("lib", "package.json", '{"name": "x@ID@", "main": "index.js"}'),
    ("lib", "src/index.js", "export const add = (a, b) => a + b;\npassword = 'abcdefgh@ID@';\n"),
    ("lib", "src/env.js", "const home = process.env.HOME;\n"),
    ("svc", "src/server.js", "const app = express();\napp.listen(8080);\nconst password = 'abcdefgh@ID@';\n"),
    ("svc", "src/env.js", "if (process.env.NODE_ENV === 'production') {\n  go(process.env.PORT);\n}\n"),
    ("svc", "package.json", '{"name": "s@ID@", "dependencies": {"express": "4.0.0"}}'),
]
AS_OF = "2001-08-01 00:00:00"

EXTENSIONS = ["js", "ts", "jsx", "tsx", "json", "md", "py", "png", "test.js", "vue"]
PACKAGES = [
    "lodash",
    "moment",
    "request",
    "morgan",
    "express",
    "react",
    "vue",
    "next",
    "koa",
    "left-pad",
]
VERSIONS = ["^0.4.1", "~0.9.2", "1.2.3", "^4.17.0", "*"]
EVENT_KEYS = {
    "view": ["API_KEY", "VIEW_URL", "VIEW_TIMEOUT", "PAGE_SIZE"],
    "signup": ["DB_PASSWORD", "SERVICE_URL", "SIGNUP_MODE", "MAIL_FROM"],
    "click": ["AUTH_TOKEN", "CLICK_ENDPOINT", "CLICK_LIMIT", "CONFIG_PATH"],
    "error": ["CLIENT_SECRET", "ERROR_URL", "RETRIES", "LEVEL"],
    "purchase": ["PAYMENT_PWD", "SHOP_URL", "CURRENCY", "SHOP_API"],
}
AGENTS = ["api-quality", "documentation", "code-quality", "security"]
KEYWORD_SENTENCES = [
    "Critical vulnerability found. Use ESLint and Jest.",
    "There is no test. Add TypeScript.",
    "The project has no readme and poor documentation.",
    "High complexity and a code smell. ❌ test missing, bcrypt advised.",
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _quote(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _pick(index, values: list[str]):
    """``values[index]`` as a Spark column."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _pick_sql(index: str, values: list[str]) -> str:
    return f"([{', '.join(_quote(v) for v in values)}])[({index}) + 1]"


def _repo(file):
    hot = (F.col("doc_id") % HOT == 0) & F.contains(file, F.lit("@ID@"))
    return F.when(hot, "repohot").otherwise(F.concat(F.lit("repo"), F.floor(F.col("doc_id") / REPO_FILES).cast("string")))


REPO_SQL = f"CASE WHEN doc_id % {HOT} = 0 AND contains(file, '@ID@') THEN 'repohot' ELSE 'repo' || CAST(doc_id // {REPO_FILES} AS VARCHAR) END"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as source files: repo, path, content.

    A third of them are in one repository, the others in many small ones.  A document whose snippet cannot hold prose (a
    manifest, an ignore file) has a second file with its text.  Some documents give a library and a service besides.
    """
    snippets = F.broadcast(
        spark.createDataFrame(
            [(k, *s) for k, s in enumerate(SNIPPETS)], "k bigint, file string, snippet string, with_prose boolean"
        )
    )
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    number = F.col("doc_id").cast("string")

    def filled(column):
        return F.replace(column, F.lit("@ID@"), number)

    def file(repo, path, content):
        return F.struct(repo.alias("repo"), path.alias("path"), content.alias("content"))

    prose = F.when(F.col("with_prose"), F.concat(F.lit("\n"), F.col("text"))).otherwise("")
    snippet = file(_repo(F.col("file")), filled(F.col("file")), F.concat(filled(F.col("snippet")), prose))
    apart = file(
        F.concat(F.lit("repo"), F.floor(F.col("doc_id") / REPO_FILES).cast("string")), F.concat(F.lit("src/prose"), number, F.lit(".js")), F.col("text")
    )
    own = F.array(*[file(F.concat(F.lit(kind), number), F.lit(path), filled(F.lit(content))) for kind, path, content in OWN_FILES])
    every = F.concat(
        F.array(snippet), F.when(F.col("with_prose"), F.array()).otherwise(F.array(apart)), F.when(F.col("doc_id") % OWN == 0, own).otherwise(F.array())
    )
    return docs.join(snippets, F.col("doc_id") % len(SNIPPETS) == F.col("k")).select(F.explode(every).alias("f")).select("f.repo", "f.path", "f.content")


FILES_SQL = (
    "snip(k, file, snippet, with_prose) AS (VALUES "
    + ", ".join(f"({k}, {_quote(p)}, {_quote(s)}, {str(w).lower()})" for k, (p, s, w) in enumerate(SNIPPETS))
    + "), own(kind, path, content) AS (VALUES "
    + ", ".join(f"({_quote(kind)}, {_quote(p)}, {_quote(c)})" for kind, p, c in OWN_FILES)
    + f"), files AS MATERIALIZED (SELECT {REPO_SQL} AS repo, "
    "replace(file, '@ID@', CAST(doc_id AS VARCHAR)) AS path, "
    "replace(snippet, '@ID@', CAST(doc_id AS VARCHAR)) || "
    "CASE WHEN with_prose THEN chr(10) || text ELSE '' END AS content "
    f"FROM documents JOIN snip ON doc_id % {len(SNIPPETS)} = k "
    f"UNION ALL SELECT 'repo' || CAST(doc_id // {REPO_FILES} AS VARCHAR), 'src/prose' || CAST(doc_id AS VARCHAR) || '.js', text "
    f"FROM documents JOIN snip ON doc_id % {len(SNIPPETS)} = k WHERE NOT with_prose "
    f"UNION ALL SELECT kind || CAST(doc_id AS VARCHAR), path, replace(content, '@ID@', CAST(doc_id AS VARCHAR)) FROM documents, own WHERE doc_id % {OWN} = 0)"
)


def file_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as a file listing: repo, path, size, modified."""
    return _table(spark, sf_dir, "orders").select(
        F.concat(F.lit("repo"), (F.col("o_custkey") % 50).cast("string")).alias("repo"),
        F.concat(
            F.lit("src/f"), F.col("o_orderkey").cast("string"), F.lit("."), _pick(F.col("o_orderkey") % 10, EXTENSIONS)
        ).alias("path"),
        F.floor("o_totalprice").cast("bigint").alias("size"),
        F.col("o_orderdate").alias("modified"),
    )


STATS_SQL = (
    "file_stats AS (SELECT 'repo' || CAST(o_custkey % 50 AS VARCHAR) AS repo, "
    f"'src/f' || CAST(o_orderkey AS VARCHAR) || '.' || {_pick_sql('o_orderkey % 10', EXTENSIONS)} AS path, "
    "CAST(floor(o_totalprice) AS BIGINT) AS size, o_orderdate AS modified FROM orders)"
)


def dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``part`` as dependency lists: repo, name, version."""
    return _table(spark, sf_dir, "part").select(
        F.concat(F.lit("repo"), (F.col("p_partkey") % 50).cast("string")).alias("repo"),
        _pick(F.floor(F.col("p_partkey") / 50) % 10, PACKAGES).alias("name"),
        _pick(F.col("p_size") % 5, VERSIONS).alias("version"),
    )


DEPENDENCIES_SQL = (
    "dependencies AS (SELECT 'repo' || CAST(p_partkey % 50 AS VARCHAR) AS repo, "
    f"{_pick_sql('(p_partkey // 50) % 10', PACKAGES)} AS name, "
    f"{_pick_sql('p_size % 5', VERSIONS)} AS version FROM part)"
)


def config_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as settings: repo, key, value, pos."""
    number, kind = F.col("event_id"), F.col("event_type")
    key = F.coalesce(
        *[F.when(kind == k, _pick(number % 4, names)) for k, names in EVENT_KEYS.items()]
    )
    whole = F.floor("value").cast("bigint").cast("string")
    value = (
        F.when(F.floor(number / 4) % 6 == 0, "")
        .when(F.floor(number / 4) % 6 == 1, whole)
        .when(F.floor(number / 4) % 6 == 2, "true")
        .when(F.floor(number / 4) % 6 == 3, F.concat(F.lit("https://example.org/"), whole))
        .when(F.floor(number / 4) % 6 == 4, F.concat(F.lit("user"), whole, F.lit("@example.org")))
        .otherwise(F.concat(F.lit("free text "), F.col("props")))
    )
    return _table(spark, sf_dir, "events").select(
        F.concat(F.lit("repo"), (F.col("user_id") % 20).cast("string")).alias("repo"),
        key.alias("key"),
        value.alias("value"),
        number.alias("pos"),
    )


_WHOLE_SQL = "CAST(CAST(floor(value) AS BIGINT) AS VARCHAR)"
ENTRIES_SQL = (
    "raw_entries AS (SELECT 'repo' || CAST(user_id % 20 AS VARCHAR) AS repo, CASE event_type "
    + " ".join(f"WHEN {_quote(k)} THEN {_pick_sql('event_id % 4', v)}" for k, v in EVENT_KEYS.items())
    + " END AS key, CASE (event_id // 4) % 6 WHEN 0 THEN '' "
    f"WHEN 1 THEN {_WHOLE_SQL} WHEN 2 THEN 'true' WHEN 3 THEN 'https://example.org/' || {_WHOLE_SQL} "
    f"WHEN 4 THEN 'user' || {_WHOLE_SQL} || '@example.org' ELSE 'free text ' || props END AS value, "
    "event_id AS pos FROM events), "
    "entries AS (SELECT repo, key, arg_max(value, pos) AS value FROM raw_entries GROUP BY repo, key)"
)


def config_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as one settings text per event: repo, path, content."""
    entries = config_entries(spark, sf_dir)
    line = F.concat(F.col("key"), F.lit(' = "'), F.col("value"), F.lit('" # note\n'), F.col("key"), F.lit("_2='x y'"))
    return entries.select(
        "repo", F.concat(F.lit("conf/"), F.col("pos").cast("string"), F.lit(".env")).alias("path"), line.alias("content")
    )


CONFIG_TEXT_SQL = (
    "config_text AS (SELECT repo, 'conf/' || CAST(pos AS VARCHAR) || '.env' AS path, "
    "key || ' = \"' || value || '\" # note' || chr(10) || key || '_2=''x y''' AS content FROM raw_entries)"
)


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as agent reports: repo, agent, content.  One conversation is one report."""
    turns = _table(spark, sf_dir, "conversations")
    conv, turn = F.col("conv_id"), F.col("turn")
    target = _pick((conv + turn + 1) % 4, AGENTS)
    status = F.when((turn % 2 == 0) & (F.col("role") == "user"), "pending").otherwise("resolved")
    comment = F.concat(
        F.lit("<!-- @"),
        target,
        F.lit(": question "),
        turn.cast("string"),
        F.lit("\nContext: "),
        F.col("role"),
        F.lit("\nStatus: "),
        status,
        F.lit("\nRound: "),
        (turn % 3 + 1).cast("string"),
        F.lit("\n-->\n\n"),
    )
    # A conversation is one text, so gathering its turns only rebuilds that text.
    whole = turns.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct(turn.alias("turn"), F.col("text"), comment.alias("comment")))).alias("t")
    )
    content = F.concat(
        F.lit("# Report\n\n## Analysis Results\n\n"),
        F.array_join(F.transform("t", lambda x: x["text"]), "\n"),
        F.lit("\n"),
        _pick(F.floor(conv / 4) % 4, KEYWORD_SENTENCES),
        F.lit("\n\n## Coordination\n\n"),
        F.array_join(F.transform("t", lambda x: x["comment"]), ""),
    )
    # Further repositories whose agents left short or empty reports, or none.
    stub = F.when(conv % 11 == 5, F.struct(F.lit("stub").alias("kind"), F.lit("short").alias("content"))).when(
        conv % 7 == 3, F.struct(F.lit("stub").alias("kind"), F.lit("").alias("content"))
    )
    both = F.array_compact(F.array(F.struct(F.lit("repo").alias("kind"), content.alias("content")), stub))
    return whole.select("conv_id", F.explode(both).alias("r")).select(
        F.concat("r.kind", F.floor(conv / 4).cast("string")).alias("repo"), _pick(conv % 4, AGENTS).alias("agent"), "r.content"
    )


REPORTS_SQL = (
    "turns AS (SELECT conv_id, turn, text, '<!-- @' || "
    + _pick_sql("(conv_id + turn + 1) % 4", AGENTS)
    + " || ': question ' || CAST(turn AS VARCHAR) || chr(10) || 'Context: ' || role || chr(10) || 'Status: ' || "
    "CASE WHEN turn % 2 = 0 AND role = 'user' THEN 'pending' ELSE 'resolved' END || chr(10) || "
    "'Round: ' || CAST(turn % 3 + 1 AS VARCHAR) || chr(10) || '-->' || chr(10) || chr(10) AS comment "
    "FROM conversations), "
    "reports AS (SELECT 'repo' || CAST(conv_id // 4 AS VARCHAR) AS repo, "
    + _pick_sql("conv_id % 4", AGENTS)
    + " AS agent, '# Report' || chr(10) || chr(10) || "
    "'## Analysis Results' || chr(10) || chr(10) || string_agg(text, chr(10) ORDER BY turn) || chr(10) || "
    + _pick_sql("(conv_id // 4) % 4", KEYWORD_SENTENCES)
    + " || chr(10) || chr(10) || '## Coordination' || chr(10) || chr(10) || "
    "string_agg(comment, '' ORDER BY turn) AS content FROM turns GROUP BY conv_id UNION ALL "
    "SELECT DISTINCT 'stub' || CAST(conv_id // 4 AS VARCHAR), "
    + _pick_sql("conv_id % 4", AGENTS)
    + ", CASE WHEN conv_id % 11 = 5 THEN 'short' ELSE '' END FROM turns WHERE conv_id % 11 = 5 OR conv_id % 7 = 3)"
)


def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` URLs as paths: page_id, path (every seventh one with an awkward form)."""
    url = F.col("url")
    odd = F.col("page_id") % 7
    path = (
        F.when(odd == 1, F.concat(F.lit("/etc//x/"), url, F.lit("/..")))
        .when(odd == 2, F.concat(F.lit(" a\\b%20c/"), url, F.lit("/")))
        .when(odd == 3, F.concat(F.lit("x/${y}/"), F.lit("secret-"), url, F.lit(".env")))
        .when(odd == 4, F.concat(F.lit("a/%252e%252e/+b/"), url, F.lit(".min.js")))
        .otherwise(url)
    )
    return _table(spark, sf_dir, "pages").select("page_id", path.alias("path"))


PAGES_SQL = (
    "page_paths AS (SELECT page_id, CASE page_id % 7 "
    "WHEN 1 THEN '/etc//x/' || url || '/..' "
    "WHEN 2 THEN ' a\\b%20c/' || url || '/' "
    "WHEN 3 THEN 'x/${y}/secret-' || url || '.env' "
    "WHEN 4 THEN 'a/%252e%252e/+b/' || url || '.min.js' "
    "ELSE url END AS path FROM pages)"
)


def document_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document went: doc_id, repo, path."""
    names = F.broadcast(
        spark.createDataFrame([(k, p) for k, (p, _, _) in enumerate(SNIPPETS)], "k bigint, file string")
    )
    docs = _table(spark, sf_dir, "documents").select("doc_id")
    return docs.join(names, F.col("doc_id") % len(SNIPPETS) == F.col("k")).select(
        "doc_id", _repo(F.col("file")).alias("repo"), F.replace("file", F.lit("@ID@"), F.col("doc_id").cast("string")).alias("path")
    )


def repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``repo`` of every file, from the keys of documents alone."""
    number = F.col("doc_id")
    kinds = list(dict.fromkeys(kind for kind, _, _ in OWN_FILES))
    own = F.when(number % OWN == 0, F.array(*[F.concat(F.lit(k), number.cast("string")) for k in kinds])).otherwise(F.array())
    bare = F.array(*[F.lit(k) for k, (_, _, with_prose) in enumerate(SNIPPETS) if not with_prose])
    apart = F.array(F.concat(F.lit("repo"), F.floor(number / REPO_FILES).cast("string")))
    apart = F.when(F.array_contains(bare, (number % len(SNIPPETS)).cast("int")), apart).otherwise(F.array())
    return document_keys(spark, sf_dir).select(F.explode(F.concat(F.array("repo"), apart, own)).alias("repo"))


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` whose markup holds a script with keys on every fifth page: page_id, html."""
    script = F.concat(F.lit('<script>var api_key = "'), F.md5("url"), F.lit('-key"; token: "'), F.md5("url"), F.md5("html"), F.lit('x"</script>'))
    return _table(spark, sf_dir, "pages").select("page_id", F.concat("html", F.when(F.col("page_id") % 5 == 0, script).otherwise("")).alias("html"))


PAGE_TEXTS_SQL = (
    "page_texts AS (SELECT page_id, html || CASE WHEN page_id % 5 = 0 THEN '<script>var api_key = \"' || md5(url) || '-key\"; token: \"' || md5(url) || md5(html) || "
    "'x\"</script>' ELSE '' END AS html FROM pages)"
)
