"""Queries over the code tables files, symbols, imports and chunks, always over their current rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import graph as G
from ..operators import records as R
from ..operators import retrieval as S
from ..operators import rules
from ..operators import validate as V
from ..operators.ranking import nearest, top
from ..session import stored
from ..sources.tables import current_rows, table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def files(spark: SparkSession, folder: str) -> DataFrame:
    """Current files; kind and language as classified by path, since the recorded ones are unreliable. Of rows equal in time the
    one with the smallest hash, loc and bytes stands, so that every engine takes the same."""
    rows = table(spark, folder, "files").where("id IS NOT NULL")
    now = rows.groupBy("id").agg(F.max_by(F.struct("moduleId", "loc", "bytes", "hash"), F.struct(F.coalesce("scannedAt", F.lit("0001-01-01").cast("timestamp_ntz")))).alias("r")).select("id", "r.*")
    language = rules.language_of(F.col("id"))
    return now.withColumn("language", language).withColumn("kind", rules.file_kind(F.col("id"), language))


def symbols(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "symbols").where("id IS NOT NULL")
    held = [c for c in rows.columns if c != "id"]
    return rows.groupBy("id").agg(F.first(F.struct(*held)).alias("r")).select("id", "r.*")


def imports(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "imports").where("id IS NOT NULL")
    held = [c for c in rows.columns if c != "id"]
    return rows.groupBy("id").agg(F.first(F.struct(*held)).alias("r")).select("id", "r.*")


def chunks(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return current_rows(table(spark, folder, "chunks"), columns)


#: The same rows in SQL.
FILES = "f AS (SELECT id, moduleId, loc, bytes, hash FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY scannedAt DESC NULLS LAST) AS k FROM files WHERE id IS NOT NULL) WHERE k = 1)"
SYMBOLS = "s AS (SELECT DISTINCT ON (id) * FROM symbols WHERE id IS NOT NULL)"
IMPORTS = "i AS (SELECT DISTINCT ON (id) * FROM imports WHERE id IS NOT NULL)"
CHUNKS = "c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seenAt DESC NULLS LAST) AS k FROM chunks WHERE id IS NOT NULL) WHERE k = 1)"
MODULE = "CASE WHEN contains({0}, '/') THEN regexp_replace({0}, '/[^/]*$', '') ELSE '.' END"
FILE_EDGES = f"{IMPORTS}, e AS (SELECT fileId AS a, target AS b, count(*) AS weight FROM i WHERE target IS NOT NULL AND fileId <> target GROUP BY 1, 2)"
MODULE_EDGES = f"{IMPORTS}, e AS (SELECT a, b, count(*) AS weight FROM (SELECT moduleId AS a, {MODULE.format('target')} AS b FROM i WHERE target IS NOT NULL) WHERE a <> b GROUP BY 1, 2)"
DEGREES = "d AS (SELECT id, sum(i) AS fan_in, sum(o) AS fan_out FROM (SELECT b AS id, 1 AS i, 0 AS o FROM e UNION ALL SELECT a, 0, 1 FROM e) GROUP BY id)"


def file_edges(spark: SparkSession, folder: str) -> DataFrame:
    return G.weighted_edges(imports(spark, folder), "fileId", "target")


def module_edges(spark: SparkSession, folder: str) -> DataFrame:
    links = imports(spark, folder).where("target IS NOT NULL").select("moduleId", X.module_of(F.col("target")).alias("targetModule"))
    return G.weighted_edges(links, "moduleId", "targetModule")


# ---------------------------------------------------------------- paths and rules


#: Written apart from the operators' tables, so that a wrong table or pattern shows.
_LANGUAGE = """CASE WHEN lower(base) IN ('rakefile', 'gemfile') THEN 'ruby' WHEN lower(base) IN ('readme', 'changelog') THEN 'markdown' WHEN lower(base) IN ('.bashrc', '.zshrc') THEN 'shell' WHEN lower(base) IN ('.babelrc', '.eslintrc', '.prettierrc', '.stylelintrc') THEN 'json'
 WHEN lower(base) IN ('cmakelists.txt', 'requirements.txt') OR starts_with(lower(base), 'dockerfile') OR starts_with(lower(base), 'makefile') THEN 'text'
 WHEN ext IN ('.ts', '.mts', '.cts') THEN 'typescript' WHEN ext IN ('.js', '.mjs', '.cjs') THEN 'javascript' WHEN ext IN ('.tsx', '.jsx', '.java', '.go', '.swift', '.sql', '.vue', '.svelte', '.php', '.scala', '.c') THEN substr(ext, 2) WHEN ext IN ('.py', '.pyi') THEN 'python' WHEN ext = '.rs' THEN 'rust'
 WHEN ext = '.h' THEN 'c' WHEN ext IN ('.cc', '.cpp', '.cxx', '.hpp', '.hh') THEN 'cpp' WHEN ext = '.cs' THEN 'csharp' WHEN ext = '.rb' THEN 'ruby' WHEN ext IN ('.kt', '.kts') THEN 'kotlin' WHEN ext = '.sc' THEN 'scala' WHEN ext IN ('.sh', '.bash', '.zsh') THEN 'shell'
 WHEN ext IN ('.html', '.htm') THEN 'html' WHEN ext IN ('.css', '.scss', '.sass', '.less') THEN 'css' WHEN ext IN ('.yaml', '.yml') THEN 'yaml' WHEN ext IN ('.json', '.jsonc') THEN 'json' WHEN ext IN ('.md', '.markdown', '.mdx') OR starts_with(lower(base), 'readme.') THEN 'markdown' ELSE 'text' END"""
_KIND = """CASE WHEN id LIKE '%.pb.go' OR id LIKE '%\\_pb2.py' ESCAPE '\\' OR id LIKE '%\\_pb2\\_grpc.py' ESCAPE '\\' OR id LIKE '%.g.dart' OR id LIKE '%.min.js' OR id LIKE '%.min.css' OR id LIKE '%.map' OR id ILIKE '%.designer.cs' OR id ILIKE '%.generated.%'
  OR len(list_intersect(folders, ['dist', 'build', 'out', 'generated', '__generated__', 'vendor'])) > 0 THEN 'generated'
 WHEN len(list_intersect(folders, ['k8s', 'kubernetes', 'helm', 'charts', 'deploy', 'deployment', 'infra', 'terraform'])) > 0 OR contains('/' || lower(id), '/.github/workflows') OR contains('/' || lower(id), '/.gitlab-ci') OR contains('/' || lower(id), '/.circleci') OR contains('/' || lower(id), '/.azure') OR contains('/' || lower(id), '/.bitbucket')
  OR lower(id) = '.github/dependabot.yml' OR ext IN ('.tf', '.tfvars') OR base ILIKE 'dockerfile%' OR lower(base) IN ('jenkinsfile', 'serverless.yml', 'serverless.yaml', 'chart.yaml', 'ansible.cfg', 'procfile', 'fly.toml', 'vercel.json') OR (base ILIKE 'playbook%' AND ext IN ('.yml', '.yaml')) THEN 'infra'
 WHEN len(list_intersect(folders, ['test', 'tests', '__tests__', 'spec', 'specs', 'e2e', 'testing'])) > 0 OR regexp_matches(base, '[.](test|spec)[.][A-Za-z]+$') OR starts_with(base, 'test_') OR contains(id, '/test_') OR starts_with(id, 'conftest') OR contains(id, '/conftest') OR regexp_matches(base, '_test[.][A-Za-z]+$') OR base LIKE '%Test.java' OR base LIKE '%Tests.java' THEN 'test'
 WHEN lower(base) IN ('.env', 'env', '.editorconfig', '.npmrc', '.nvmrc', 'nginx.conf', 'ruff.toml', 'mypy.ini', '.flake8', 'pytest.ini', 'tox.ini', '.coveragerc', 'package.json', 'pyproject.toml', 'setup.py', 'setup.cfg', 'pom.xml', 'build.gradle', 'build.gradle.kts', 'go.mod', 'cargo.toml', 'composer.json', 'gemfile', 'settings.gradle', 'makefile', 'cmakelists.txt', '.sparklodeignore', '.gitignore', '.dockerignore', '.gitattributes')
  OR base ILIKE '.env.%' OR base ILIKE 'env.%' OR base ILIKE '.eslintrc%' OR base ILIKE '.prettierrc%' OR base ILIKE '.babelrc%' OR (base ILIKE 'tsconfig%' OR base ILIKE 'jsconfig%') AND ext = '.json' OR split_part(lower(base), '.config', 1) IN ('jest', 'vite', 'webpack', 'rollup', 'next', 'nuxt', 'tailwind', 'postcss', 'babel', 'eslint') AND contains(lower(base), '.config')
  OR base ILIKE 'docker-compose%' AND ext IN ('.yml', '.yaml') OR base ILIKE 'requirements%' AND ext = '.txt' OR ext = '.csproj' THEN 'config'
 WHEN language = 'markdown' OR ext IN ('.md', '.mdx', '.rst', '.adoc') THEN 'docs'
 WHEN ext IN ('.css', '.scss', '.sass', '.less', '.svg', '.png', '.jpg', '.jpeg', '.gif', '.ico', '.webp', '.woff', '.woff2', '.ttf', '.eot', '.mp4', '.mp3', '.pdf', '.csv', '.parquet', '.ipynb') THEN 'asset'
 WHEN language IN ('json', 'yaml') THEN 'config' WHEN language = 'text' THEN CASE WHEN starts_with(id, 'docs/') THEN 'docs' ELSE 'asset' END ELSE 'source' END"""
_NAMED = f"WITH {FILES}, n AS (SELECT *, regexp_extract(id, '[^/]*$') AS base, lower(regexp_extract(id, '[^/](\\.[^./]*)$', 1)) AS ext, list_transform(string_split(id, '/')[:-2], lambda x: lower(x)) AS folders FROM f), k AS (SELECT *, {_LANGUAGE} AS language FROM n), g AS (SELECT *, {_KIND} AS kind FROM k)"


@query(_NAMED + "SELECT id, language, kind FROM g")
def file_kinds(spark, folder):
    return files(spark, folder).select("id", "language", "kind")


@query(f"WITH {FILES} SELECT id, regexp_extract(id, '[^/]*$') AS base, lower(regexp_extract(id, '[^/](\\.[^./]*)$', 1)) AS extension, {MODULE.format('id')} AS module, regexp_replace(regexp_replace(regexp_replace(lower(id), '[^a-z0-9]+', '-', 'g'), '^-+', ''), '-+$', '') AS slug FROM f")
def path_parts(spark, folder):
    p = F.col("id")
    return files(spark, folder).select("id", X.base_name(p).alias("base"), X.extension_of(p).alias("extension"), X.module_of(p).alias("module"), X.slugify(p).alias("slug"))


_RULES = [*rules.IGNORED, "!**/vendor/**/*.go", "docs/", "!README.md", "*_{test,spec}.*"]


_ANY = "len(list_filter(string_split(id, '/'), lambda s: {0})) > 0"
_IGNORED = f"""CASE WHEN {_ANY.format("s LIKE '%~_test.%' ESCAPE '~' OR s LIKE '%~_spec.%' ESCAPE '~'")} THEN true WHEN {_ANY.format("s = 'README.md'")} THEN false WHEN {_ANY.format("s = 'docs'")} THEN true WHEN regexp_matches(id, '^([^/]+/)*vendor/([^/]+/)*[^/]*[.]go(/.*)?$') THEN false
 ELSE {_ANY.format("s LIKE '%.min.js' OR s LIKE '%.min.css' OR s LIKE '%.map' OR s LIKE '%.lock' OR s LIKE '%.log' OR s LIKE '%.snap' OR s IN ('node_modules', 'bower_components', '.pnpm-store', '.yarn', '.git', '.hg', '.svn', 'dist', 'build', 'out', 'target', 'coverage', '.nyc_output', '.next', '.nuxt', '.svelte-kit', '.turbo', '.cache', '.parcel-cache', '.angular', '.dart_tool', 'DerivedData', 'Pods', '.venv', 'venv', '__pycache__', '.pytest_cache', '.mypy_cache', '.ruff_cache', '.tox', '.gradle', '.idea', '.vscode', '.terraform', '.serverless', '.fusebox', '.dynamodb', '.sass-cache', 'vendor', '.DS_Store', '.eslintcache', 'package-lock.json', 'pnpm-lock.yaml', 'yarn.lock', '.sparklode', 'sparklode-report')")} END"""


@query(f"WITH {FILES} SELECT id, {_IGNORED} AS ignored FROM f")
def ignored_paths(spark, folder):
    return files(spark, folder).select("id", rules.ignored(F.col("id"), _RULES).alias("ignored"))


#: What paths of all kinds are, by hand: path, language, kind, what a sensitive one holds, whether a scan leaves it out, kind of configuration, build service.
PLANTED = (
    ("src/app.ts", "typescript", "source", None, False, None, None), ("src/App.TSX", "tsx", "source", None, False, None, None), ("lib/a.test.js", "javascript", "test", None, False, None, None), ("tests/conftest.py", "python", "test", None, False, None, None),
    ("pkg/util_test.go", "go", "test", None, False, None, None), ("src/main/java/UserTests.java", "java", "test", None, False, None, None), ("src/latest.py", "python", "source", None, False, None, None), ("contest.py", "python", "source", None, False, None, None),
    ("README", "markdown", "docs", None, False, None, None), ("README.rst", "markdown", "docs", None, False, None, None), ("CHANGELOG", "markdown", "docs", None, False, None, None), ("docs/guide.md", "markdown", "docs", None, False, None, None), ("docs/plain.txt", "text", "docs", None, False, None, None), ("notes.txt", "text", "asset", None, False, None, None),
    ("Rakefile", "ruby", "source", None, False, None, None), ("Gemfile", "ruby", "config", None, False, None, None), ("Gemfile.lock", "text", "asset", None, True, None, None), ("Makefile", "text", "config", None, False, "build", None), ("CMakeLists.txt", "text", "config", None, False, "build", None), ("LICENSE", "text", "asset", None, False, None, None),
    ("Dockerfile", "text", "infra", None, False, None, None), ("deploy/Dockerfile.dev", "text", "infra", None, False, None, None), ("Jenkinsfile", "text", "infra", None, False, None, "jenkins"), ("ci/Jenkinsfile", "text", "infra", None, False, None, "jenkins"), (".github/workflows/ci.yml", "yaml", "infra", None, False, None, "github-actions"), (".gitlab-ci.yml", "yaml", "infra", None, False, None, "gitlab-ci"),
    ("infra/main.tf", "text", "infra", None, False, None, None), ("prod.tfvars", "text", "infra", None, False, None, None), ("playbook-web.yaml", "yaml", "infra", None, False, None, None), ("fly.toml", "text", "infra", None, False, None, None), (".travis.yml", "yaml", "config", None, False, None, "travis"), ("azure-pipelines.yml", "yaml", "config", None, False, None, "azure-pipelines"),
    (".eslintrc", "json", "config", None, False, "lint", None), (".eslintrc.js", "javascript", "config", None, False, "lint", None), (".babelrc", "json", "config", None, False, "build", None), ("tsconfig.json", "json", "config", None, False, "typescript", None), ("tsconfig.base.json", "json", "config", None, False, "typescript", None), ("vite.config.ts", "typescript", "config", None, False, "build", None),
    ("my.config.yaml", "yaml", "config", None, False, "app", None), ("application-prod.yml", "yaml", "config", None, False, "app", None), ("config/db.json", "json", "config", None, False, "runtime", None), ("docker-compose.dev.yml", "yaml", "config", None, False, "container", None), ("compose.yaml", "yaml", "config", None, False, "container", None), ("requirements-dev.txt", "text", "config", None, False, None, None), ("App.csproj", "text", "config", None, False, None, None), ("turbo.json", "json", "config", None, False, "workspace", None),
    ("api/user.pb.go", "go", "generated", None, False, None, None), ("api/user_pb2_grpc.py", "python", "generated", None, False, None, None), ("web/app.min.js", "javascript", "generated", None, True, None, None), ("dist/app.js", "javascript", "generated", None, True, None, None), ("a/vendor/x.go", "go", "generated", None, True, None, None), ("ui/Main.designer.cs", "csharp", "generated", None, False, None, None), ("build.rs", "rust", "source", None, False, None, None), ("app.js.map", "text", "generated", None, True, None, None),
    ("logo.SVG", "text", "asset", None, False, None, None), ("site.scss", "css", "asset", None, False, None, None), ("data.csv", "text", "asset", None, False, None, None), ("schema.sql", "sql", "source", None, False, None, None), ("run.bash", "shell", "source", None, False, None, None), (".zshrc", "shell", "source", None, False, None, None), ("x.h", "c", "source", None, False, None, None), ("x.hpp", "cpp", "source", None, False, None, None),
    (".env", "text", "config", "env", False, "env", None), (".env.local", "text", "config", "env", False, "env", None), (".env.example", "text", "config", "env-template", False, "env", None), ("certs/server.pem", "text", "asset", "certificate", False, None, None), ("keys/id_rsa", "text", "asset", "ssh-key", False, None, None), ("id_ed25519.pub", "text", "asset", "ssh-key", False, None, None), ("secrets.yaml", "yaml", "config", "secrets", False, None, None),
    ("config/credentials.json", "json", "config", "credentials", False, "runtime", None), (".npmrc", "text", "config", "registry-token", False, None, None), ("home/.aws/config", "text", "asset", None, False, None, None), (".aws/config", "text", "asset", "cloud-credentials", False, None, None), ("a.p12", "text", "asset", "keystore", False, None, None), ("terraform.tfstate.backup", "text", "asset", "terraform-state", False, None, None), ("kubeconfig", "text", "asset", "kubeconfig", False, None, None),
    ("node_modules/x/index.js", "javascript", "source", None, True, None, None), ("a/.git/config", "text", "asset", None, True, None, None), ("srv/debug.log", "text", "asset", None, True, None, None), ("src/.cache/x.py", "python", "source", None, True, None, None), ("poetry.lock", "text", "asset", None, True, None, None),
)
_PATHS = ("path", "language", "kind", "sensitive", "ignored", "config", "ci")
_ROWS = ", ".join("(" + ", ".join("NULL" if v is None else str(v).lower() if isinstance(v, bool) else f"'{v}'" for v in row) + ")" for row in PLANTED)


@query(f"SELECT * FROM (VALUES {_ROWS}) t({', '.join(_PATHS)})")
def planted_paths(spark, folder):
    """Every path rule over paths whose results are written down."""
    p = F.col("path")
    rows = spark.createDataFrame([(row[0],) for row in PLANTED], "path string").withColumn("language", rules.language_of(p))
    return rows.select("path", "language", rules.file_kind(p, F.col("language")).alias("kind"), rules.sensitive_kind(p).alias("sensitive"), rules.ignored(p).alias("ignored"), rules.path_roles(p)["config"].alias("config"), rules.path_roles(p)["ci"].alias("ci"))


@query(f"WITH {FILES}, p AS (SELECT id, regexp_extract(lower(id), '[^/]*$') AS base FROM f UNION ALL SELECT path, regexp_extract(lower(path), '[^/]*$') FROM (VALUES {_ROWS}) t({', '.join(_PATHS)})) SELECT id, CASE WHEN base = '.env.example' THEN 'env-template' WHEN starts_with(base, '.env') THEN 'env' WHEN base LIKE '%.pem' THEN 'certificate' WHEN base LIKE '%.key' THEN 'private-key' WHEN starts_with(base, 'id_rsa') OR starts_with(base, 'id_ed25519') THEN 'ssh-key' WHEN starts_with(base, 'credentials') THEN 'credentials' WHEN starts_with(base, 'secrets') THEN 'secrets' WHEN base = '.npmrc' THEN 'registry-token' WHEN base LIKE '%.p12' THEN 'keystore' WHEN starts_with(id, '.aws/') THEN 'cloud-credentials' WHEN base = 'kubeconfig' THEN 'kubeconfig' WHEN starts_with(base, 'terraform.tfstate') OR base LIKE '%.tfstate' THEN 'terraform-state' END AS kind FROM p WHERE kind IS NOT NULL")
def sensitive_paths(spark, folder):
    """The files of the table and the planted paths, as no file of the table is sensitive."""
    paths = files(spark, folder).select("id").unionByName(spark.createDataFrame([(row[0],) for row in PLANTED], "id string"))
    return paths.select("id", rules.sensitive_kind(F.col("id")).alias("kind")).where("kind IS NOT NULL")


# ---------------------------------------------------------------- roll-ups and checks


@query(_NAMED + """, c AS (SELECT moduleId, kind, count(*) AS n, kind NOT IN ('test', 'generated') AS m FROM g GROUP BY ALL),
r AS (SELECT *, rank() OVER (PARTITION BY moduleId ORDER BY m DESC, n DESC) AS k FROM c), t AS (SELECT moduleId, CASE WHEN count(*) > 1 THEN 'mixed' ELSE min(kind) END AS kind FROM r WHERE k = 1 GROUP BY 1)
SELECT moduleId, count(*) AS files, sum(coalesce(loc, 0)) AS loc, count(DISTINCT language) AS languages, CASE WHEN count(DISTINCT language) > 1 THEN 'mixed' ELSE min(language) END AS language, any_value(t.kind) AS kind
FROM g LEFT JOIN t USING (moduleId) GROUP BY moduleId""")
def module_rollup(spark, folder):
    return R.module_rollup(files(spark, folder))


@query(_NAMED + "SELECT language, count(*) AS files, sum(loc) AS loc, sum(bytes) AS bytes, count_if(kind = 'test') AS tests FROM g GROUP BY language")
def language_stats(spark, folder):
    return files(spark, folder).groupBy("language").agg(F.count(F.lit(1)).alias("files"), F.sum("loc").alias("loc"), F.sum("bytes").alias("bytes"), F.count_if(F.col("kind") == "test").alias("tests"))


@query(f"WITH {FILES}, {SYMBOLS}, {IMPORTS} SELECT (SELECT count(*) FROM f) AS files, (SELECT count(*) FROM s) AS symbols, (SELECT count_if(exported) FROM s) AS exported, (SELECT count(*) FROM i) AS imports, (SELECT count_if(\"external\") FROM i) AS external, (SELECT count_if(resolved IS NOT TRUE) FROM i) AS unresolved")
def record_stats(spark, folder):
    a = files(spark, folder).agg(F.count(F.lit(1)).alias("files"))
    b = symbols(spark, folder).agg(F.count(F.lit(1)).alias("symbols"), F.count_if("exported").alias("exported"))
    c = imports(spark, folder).agg(F.count(F.lit(1)).alias("imports"), F.count_if("external").alias("external"), F.count_if(~F.coalesce("resolved", F.lit(False))).alias("unresolved"))
    one = lambda d: d.withColumn("__one", F.lit(1))
    return one(a).join(one(b), "__one").join(one(c), "__one").drop("__one")


@query(f"""WITH {FILES}, {SYMBOLS}, {IMPORTS}
SELECT id, 'symbol without file' AS problem FROM s WHERE fileId IS NOT NULL AND fileId NOT IN (SELECT id FROM f) UNION ALL SELECT id, 'import without file' FROM i WHERE fileId IS NOT NULL AND fileId NOT IN (SELECT id FROM f)
UNION ALL SELECT id, 'import of no file' FROM i WHERE target IS NOT NULL AND target NOT IN (SELECT id FROM f) UNION ALL SELECT id, 'chunk without file' FROM (SELECT DISTINCT id, fileId FROM chunks) WHERE id IS NOT NULL AND fileId IS NOT NULL AND fileId NOT IN (SELECT id FROM f)
UNION ALL SELECT id, 'ids repeat' FROM files WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1""")
def integrity(spark, folder):
    f, i = files(spark, folder).select("id"), imports(spark, folder)
    c = table(spark, folder, "chunks").where("id IS NOT NULL").select("id", "fileId").distinct()
    repeats = R.duplicates(table(spark, folder, "files").where("id IS NOT NULL")).select("id", F.lit("ids repeat").alias("problem"))
    return (R.dangling(symbols(spark, folder), "fileId", f, name="symbol without file").unionByName(R.dangling(i, "fileId", f, name="import without file"))
            .unionByName(R.dangling(i, "target", f, name="import of no file")).unionByName(R.dangling(c, "fileId", f, name="chunk without file")).unionByName(repeats))


@query("""WITH o AS (SELECT id, arg_min(lower(hash), seenAt) AS h FROM (SELECT id, hash, seenAt FROM chunks WHERE id IS NOT NULL AND seenAt < TIMESTAMP '2025-03-10') GROUP BY id),
n AS (SELECT id, lower(hash) AS h FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seenAt DESC NULLS LAST) AS k FROM chunks WHERE id IS NOT NULL AND NOT contains(fileId, '/test/')) WHERE k = 1),
p AS (SELECT id, first(h) AS h FROM (SELECT id, lower(hash) AS h, row_number() OVER (PARTITION BY id ORDER BY seenAt) AS k FROM chunks WHERE id IS NOT NULL AND seenAt < TIMESTAMP '2025-03-10') WHERE k = 1 GROUP BY id)
SELECT coalesce(p.id, n.id) AS id, CASE WHEN p.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' WHEN p.h IS NOT DISTINCT FROM n.h THEN 'unchanged' ELSE 'changed' END AS state FROM p FULL JOIN n ON p.id = n.id""")
def chunk_diff(spark, folder):
    """The first rows before a date against the current rows without tests."""
    rows = table(spark, folder, "chunks").where("id IS NOT NULL").select("id", "fileId", F.lower("hash").alias("hash"), "seenAt")
    old = rows.where("seenAt < timestamp_ntz'2025-03-10'").groupBy("id").agg(F.min_by("hash", "seenAt").alias("hash"))
    new = current_rows(rows.where("NOT contains(fileId, '/test/')"), ["hash"])
    return R.diff(old, new)


@query()
def stale_hashes(spark, folder):
    """Current chunks whose recorded hash is not that of their text."""
    now = chunks(spark, folder, "fileId", "hash", "text")
    real = now.withColumn("real", X.content_hash(F.col("text")))
    return real.where(~F.lower("hash").eqNullSafe(F.col("real"))).select("id", "fileId", F.lower("hash").alias("hash"), "real")


@query(f"WITH {CHUNKS}, {SYMBOLS}, o AS (SELECT c.id, s.id AS symbol, row_number() OVER (PARTITION BY c.id ORDER BY s.endLine - s.line, s.line DESC, s.id) AS k FROM c JOIN s ON c.fileId = s.fileId AND c.startLine BETWEEN s.line AND s.endLine) SELECT id, symbol FROM o WHERE k = 1")
def enclosing_symbol(spark, folder):
    return R.innermost(chunks(spark, folder, "fileId", "startLine").select("id", "fileId", F.col("startLine").alias("at")), symbols(spark, folder))


@query(f"WITH {CHUNKS}, {SYMBOLS}, o AS (SELECT c.id, s.id AS symbol, row_number() OVER (PARTITION BY c.id ORDER BY s.line, s.id) AS k FROM c JOIN s ON c.fileId = s.fileId AND s.line BETWEEN c.startLine AND c.startLine + 8) SELECT id, symbol FROM o WHERE k = 1")
def following_symbol(spark, folder):
    return R.next_within(chunks(spark, folder, "fileId", "startLine").select("id", "fileId", F.col("startLine").alias("at")), symbols(spark, folder))


@query(f"""WITH {IMPORTS}, {SYMBOLS}, u AS (SELECT fileId, name, min(id) AS symbol FROM s GROUP BY fileId, name HAVING count(*) = 1), e AS (SELECT fileId, unnest(names) AS name, target, line, id FROM i WHERE target IS NOT NULL),
l AS (SELECT *, row_number() OVER (PARTITION BY fileId, name ORDER BY line DESC, id DESC) AS k FROM e WHERE name IS NOT NULL AND name <> '')
SELECT l.fileId, l.name, l.target, u.symbol FROM l LEFT JOIN u ON l.target = u.fileId AND l.name = u.name WHERE k = 1""")
def bound_names(spark, folder):
    return R.bind_names(imports(spark, folder), symbols(spark, folder))


_ENDS = "['.ts', '.tsx', '.js', '.jsx', '.mjs', '.cjs', '.mts', '.cts', '.py', '.java', '.go', '.rs', '.rb', '.php', '.kt', '.kts', '.scala', '.swift', '.cs', '.vue', '.svelte']"


@query(f"""WITH {FILES}, {IMPORTS}, x AS (SELECT id, trim(specifier) AS spec, CASE WHEN contains(fileId, '/') THEN regexp_replace(fileId, '/[^/]*$', '') ELSE '' END AS dir FROM i),
forms AS (SELECT 0 AS k, '' AS tail UNION ALL SELECT k, e FROM (SELECT unnest({_ENDS}) AS e, unnest(range(1, 22)) AS k) UNION ALL SELECT 22 + 21 * p + k, '/' || stem || e FROM (SELECT unnest(['index', '__init__', 'mod', 'main']) AS stem, unnest(range(0, 4)) AS p), (SELECT unnest({_ENDS}) AS e, unnest(range(0, 21)) AS k)),
steps AS (SELECT id, spec, list_filter(string_split(CASE WHEN starts_with(spec, '/') THEN substr(spec, 2) ELSE dir || '/' || spec END, '/'), lambda p: p NOT IN ('', '.')) AS parts FROM x WHERE starts_with(spec, '.') OR starts_with(spec, '/')),
bases AS (SELECT id, array_to_string(list_reduce(list_transform(parts, lambda p: [p]), lambda acc, p: CASE WHEN p[1] = '..' THEN acc[:-2] ELSE list_concat(acc, p) END, []::VARCHAR[]), '/') AS base FROM steps),
tries AS (SELECT id, k, base || tail AS path FROM bases, forms),
hits AS (SELECT t.id, t.k, 0 AS loose, f.id AS target FROM tries t JOIN f ON t.path = f.id UNION ALL SELECT t.id, t.k, 1, l.target FROM tries t JOIN (SELECT lower(id) AS low, min(id) AS target FROM f GROUP BY 1) l ON lower(t.path) = l.low),
hit AS (SELECT id, arg_min(target, k * 2 + loose) AS target FROM hits GROUP BY id),
code AS (SELECT id, string_split(regexp_replace(id, '[.][A-Za-z]+$', ''), '/') AS p FROM f WHERE id LIKE '%.java' OR id LIKE '%.kt' OR id LIKE '%.kts' OR id LIKE '%.scala' OR id LIKE '%.py'),
tails AS (SELECT array_to_string(list_slice(p, k, len(p)), '/') AS tail, id FROM (SELECT id, p, unnest(range(1, len(p) + 1)) AS k FROM code)), one AS (SELECT tail, min(id) AS target FROM tails GROUP BY tail HAVING count(*) = 1),
dotted AS (SELECT x.id, one.target FROM x JOIN one ON replace(x.spec, '.', '/') = one.tail WHERE regexp_matches(x.spec, '^[A-Za-z_][A-Za-z0-9_]*([.][A-Za-z0-9_]+)+$')),
r AS (SELECT x.id, x.spec, coalesce(hit.target, dotted.target) AS target FROM x LEFT JOIN hit USING (id) LEFT JOIN dotted USING (id)),
o AS (SELECT *, target IS NULL AND NOT starts_with(spec, '.') AND NOT starts_with(spec, '/') AS ext FROM r)
SELECT id, target, coalesce(ext, false) AS external, CASE WHEN ext THEN nullif(CASE WHEN starts_with(spec, '@') THEN CASE WHEN contains(spec, '/') THEN array_to_string(string_split(spec, '/')[:2], '/') ELSE spec END ELSE split_part(split_part(spec, '/', 1), '.', 1) END, '') END AS package FROM o""")
def resolved_imports(spark, folder):
    return R.resolve_imports(imports(spark, folder), files(spark, folder))


@query(f"WITH {FILES}, r AS (SELECT id, coalesce(sum(bytes) OVER (ORDER BY bytes DESC NULLS LAST, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM f) SELECT id FROM r WHERE before < 500000")
def prefix_budget(spark, folder):
    return R.prefix_budget(files(spark, folder), "bytes", 500_000, [F.desc_nulls_last("bytes"), F.col("id")]).select("id")


@query(f"""WITH RECURSIVE {FILES}, o AS (SELECT id, bytes, row_number() OVER (ORDER BY bytes DESC, id) AS k FROM f WHERE bytes BETWEEN 0 AND 500000),
g AS (SELECT 0::BIGINT AS k, 500000::BIGINT AS room, NULL::VARCHAR AS id UNION ALL SELECT o.k, CASE WHEN o.bytes <= g.room THEN g.room - o.bytes ELSE g.room END, CASE WHEN o.bytes <= g.room THEN o.id END FROM g JOIN o ON o.k = g.k + 1) SELECT id FROM g WHERE id IS NOT NULL""")
def greedy_budget(spark, folder):
    return R.greedy_budget(files(spark, folder), "id", "bytes", 500_000)


@query(f"""WITH {CHUNKS}, r AS (SELECT id, fileId, row_number() OVER (PARTITION BY fileId ORDER BY startLine, id) - 1 AS p, count(*) OVER (PARTITION BY fileId) AS n FROM c)
SELECT id, fileId FROM r WHERE n <= 3 OR p IN (0, floor((n - 1) / 2.0 + 0.5), n - 1)""")
def spread_chunks(spark, folder):
    """At most three chunks of each file, evenly spaced."""
    return R.even_sample(chunks(spark, folder, "fileId", "startLine"), "fileId", [F.col("startLine"), F.col("id")], 3).select("id", "fileId")


# ---------------------------------------------------------------- graphs


@query(f"WITH {FILE_EDGES} SELECT a AS \"from\", b AS \"to\", weight FROM e")
def file_graph(spark, folder):
    return file_edges(spark, folder)


@query(f"WITH {MODULE_EDGES} SELECT a AS \"from\", b AS \"to\", weight FROM e")
def module_graph(spark, folder):
    return module_edges(spark, folder)


@query(f"WITH {FILE_EDGES}, {DEGREES} SELECT id, fan_in, fan_out FROM d")
def fan_in_out(spark, folder):
    return G.degrees(file_edges(spark, folder))


@query(f"WITH {FILES}, {FILE_EDGES}, {DEGREES} SELECT id, moduleId, fan_in, fan_out FROM d JOIN f USING (id) ORDER BY fan_in DESC, fan_out DESC, id LIMIT 30")
def hub_files(spark, folder):
    return G.hubs(files(spark, folder).select("id", "moduleId"), file_edges(spark, folder))


@query(_NAMED + f", {FILE_EDGES} SELECT id FROM g WHERE kind NOT IN ('config', 'docs', 'asset', 'infra') AND id NOT IN (SELECT a FROM e UNION SELECT b FROM e)")
def orphan_files(spark, folder):
    return G.orphans(files(spark, folder).select("id", "kind"), file_edges(spark, folder))


def _entries(spark, folder):
    return file_edges(spark, folder).select(F.col("from").alias("id")).where(r"id RLIKE '(?i)/test/|_test\\.'").distinct()


@query(f"WITH RECURSIVE {FILE_EDGES}, r AS (SELECT DISTINCT a AS id FROM e WHERE regexp_matches(a, '(?i)/test/|_test\\.') UNION SELECT e.b FROM r JOIN e ON r.id = e.a) SELECT id FROM r")
def reachable_files(spark, folder):
    return G.reachable(_entries(spark, folder), file_edges(spark, folder)).select("id")


@query(f"""WITH RECURSIVE {MODULE_EDGES}, r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT x.a AS id, least(x.a, min(x.b)) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a) SELECT id, component FROM m""")
def module_cycles(spark, folder):
    """Members of strongly connected module groups; a module's only cycle may be through itself, which edges leave out."""
    return G.components(module_edges(spark, folder))


def _walk_sql(depth: int = 5, steps: int = 24) -> str:
    """Breadth-first walks level by level: what a level finds first, by the step of its parent, then the line and id of the import."""
    parts = [IMPORTS, "e AS (SELECT fileId AS a, target AS b, min((line, id)) AS rank FROM i WHERE target IS NOT NULL AND target <> fileId GROUP BY 1, 2)", "l0 AS (SELECT DISTINCT a AS start, a AS id, 1::BIGINT AS step, 0 AS depth FROM e WHERE a NOT IN (SELECT b FROM e))", "s0 AS (SELECT * FROM l0)"]
    for d in range(1, depth + 1):
        parts.append(f"f{d} AS (SELECT start, e.b AS id, min((step, rank, e.b)) AS o FROM l{d - 1} JOIN e ON e.a = l{d - 1}.id GROUP BY ALL)")
        parts.append(f"n{d} AS (SELECT f.start, f.id, row_number() OVER (PARTITION BY f.start ORDER BY f.o) AS k FROM f{d} f ANTI JOIN s{d - 1} s ON f.start = s.start AND f.id = s.id)")
        parts.append(f"l{d} AS (SELECT n.start, n.id, n.k + m.last AS step, {d} AS depth FROM n{d} n JOIN (SELECT start, max(step) AS last FROM s{d - 1} GROUP BY 1) m USING (start) WHERE n.k + m.last <= {steps})")
        parts.append(f"s{d} AS (SELECT * FROM s{d - 1} UNION ALL SELECT * FROM l{d})")
    return f"WITH {', '.join(parts)} SELECT start, step::INT AS step, id, depth::INT AS depth FROM s{depth}"


@query(_walk_sql())
def import_walks(spark, folder):
    """From every file that nothing imports, what its imports lead to, breadth first."""
    edges = imports(spark, folder).where("target IS NOT NULL AND target != fileId").groupBy(F.col("fileId").alias("from"), F.col("target").alias("to")).agg(F.min(F.struct("line", "id")).alias("rank"))
    starts = edges.select(F.col("from").alias("id")).distinct().join(edges.select(F.col("to").alias("id")).distinct(), "id", "left_anti")
    return G.walks(starts, edges)


_MODULE_KIND = """kc AS (SELECT moduleId, kind, count(*) AS n, kind NOT IN ('test', 'generated') AS m FROM g GROUP BY ALL), kr AS (SELECT *, rank() OVER (PARTITION BY moduleId ORDER BY m DESC, n DESC) AS k FROM kc), kt AS (SELECT moduleId AS id, CASE WHEN count(*) > 1 THEN 'mixed' ELSE min(kind) END AS kind FROM kr WHERE k = 1 GROUP BY 1)"""


@query(_NAMED.replace("WITH ", "WITH RECURSIVE ", 1) + f""", {MODULE_EDGES}, {_MODULE_KIND}, fan AS (SELECT b AS id, count(*) AS fan_in FROM e GROUP BY b), r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), cyc AS (SELECT DISTINCT a AS id FROM r WHERE a = b),
l AS (SELECT moduleId AS id, count(*) AS links, count_if(resolved IS NOT TRUE AND "external" IS NOT TRUE) AS unresolved FROM i GROUP BY 1),
m AS (SELECT moduleId AS id, sum(coalesce(loc, 0)) AS loc, bool_or(kind = 'test') AS has_test FROM g GROUP BY 1),
v AS (SELECT m.id, CASE WHEN coalesce(fan_in, 0) >= 10 THEN 3 WHEN coalesce(fan_in, 0) >= 5 THEN 2 ELSE 0 END + CASE WHEN cyc.id IS NOT NULL THEN 3 ELSE 0 END + CASE WHEN coalesce(unresolved, 0) >= 5 AND unresolved / greatest(links, 1) > 0.6 THEN 2 ELSE 0 END
  + CASE WHEN NOT has_test AND kt.kind IN ('source', 'mixed') THEN 1 ELSE 0 END + CASE WHEN loc > 2000 THEN 1 ELSE 0 END AS score FROM m LEFT JOIN kt USING (id) LEFT JOIN fan USING (id) LEFT JOIN l USING (id) LEFT JOIN cyc ON cyc.id = m.id)
SELECT id, least(10, score)::INT AS score FROM v WHERE score > 0""")
def module_risk(spark, folder):
    """The scores of module_risks, by all rules."""
    return module_risks(spark, folder).select("id", "score")


@query()
def module_risks(spark, folder):
    """Scores and reasons by all rules: members of module_cycles are on a cycle, a module's kind is that of its roll-up."""
    kinds = R.mode_or_mixed(files(spark, folder), "moduleId", "kind", ("test", "generated")).withColumnRenamed("moduleId", "id")
    edges = stored(module_edges(spark, folder))
    return G.risk(_linked_modules(spark, folder).join(kinds, "id", "left"), edges, G.components(edges), limit=None)


def _linked_modules(spark, folder):
    """id, loc, has_test, links and unresolved of each module."""
    roll = files(spark, folder).groupBy(F.col("moduleId").alias("id")).agg(F.sum(F.coalesce("loc", F.lit(0))).alias("loc"), F.bool_or(F.col("kind") == "test").alias("has_test"))
    links = imports(spark, folder).groupBy(F.col("moduleId").alias("id")).agg(F.count(F.lit(1)).alias("links"), F.count_if(~F.coalesce("resolved", F.lit(False)) & ~F.coalesce("external", F.lit(False))).alias("unresolved"))
    return roll.join(links, "id", "left").fillna(0, ["links", "unresolved"])


# ---------------------------------------------------------------- text and retrieval

_WORDS = """t AS (SELECT id, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*|\\d+(?:\\.\\d+)?')) AS w FROM {0}),
p AS (SELECT id, w, list_filter(regexp_split_to_array(regexp_replace(regexp_replace(w, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+'), lambda x: x <> '') AS parts FROM t),
w AS (SELECT id, lower(unnest(CASE WHEN len(parts) > 0 THEN parts ELSE [w] END)) AS token FROM p), k AS (SELECT id, token FROM w WHERE length(token) >= 2 AND token NOT IN (""" + ", ".join(f"'{x}'" for x in X.STOP_WORDS) + "))"


@query("WITH d AS (SELECT doc_id AS id, text FROM documents WHERE text IS NOT NULL), " + _WORDS.format("d") + " SELECT token, count(*) AS occurrences, count(DISTINCT id) AS documents FROM k GROUP BY token")
def token_counts(spark, folder):
    words = table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", F.explode(X.tokenize(F.col("text"))).alias("token"))
    per = words.groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("token").agg(F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("documents"))


@query(f"WITH {SYMBOLS} SELECT id, list_transform(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+'), lambda x: x <> ''), lambda x: lower(x)) AS words FROM s")
def name_words(spark, folder):
    return symbols(spark, folder).select("id", X.split_identifier(F.col("name")).alias("words"))


_CLEAN = "regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '^\\x{FEFF}', '')"


@query(f"SELECT doc_id, CASE WHEN x = '' THEN 0 ELSE length(x) - length(replace(x, chr(10), '')) + CASE WHEN ends_with(x, chr(10)) THEN 0 ELSE 1 END END AS lines FROM (SELECT doc_id, {_CLEAN} AS x FROM documents)")
def line_counts(spark, folder):
    return table(spark, folder, "documents").select("doc_id", X.count_lines(X.normalize_text(F.col("text"))).alias("lines"))


@query(f"""WITH l AS (SELECT doc_id, CASE WHEN x = '' THEN 0 ELSE length(x) - length(replace(x, chr(10), '')) + CASE WHEN ends_with(x, chr(10)) THEN 0 ELSE 1 END END AS n FROM (SELECT doc_id, {_CLEAN} AS x FROM documents WHERE text IS NOT NULL)),
w AS (SELECT doc_id, n, unnest(CASE WHEN n <= 60 THEN [1] ELSE list_filter(range(1, n + 1, 20), lambda s: s = 1 OR s - 20 + 39 < n) END) AS startLine FROM l WHERE n > 0)
SELECT doc_id, startLine, CASE WHEN n <= 60 THEN n ELSE least(n, startLine + 39) END AS endLine FROM w""")
def line_windows(spark, folder):
    docs = table(spark, folder, "documents").where("text IS NOT NULL")
    lines = X.count_lines(X.normalize_text(F.col("text")))
    return S.windows(docs.select("doc_id", lines.alias("n")), F.col("n"), 60, 40, 20).select("doc_id", "startLine", "endLine")


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents WHERE text IS NOT NULL)
SELECT doc_id, line_no, upper(regexp_extract(line, '(?i)(?:#|//|/\\*|\\*|--|<!--)\\s*(TODO|FIXME|HACK|XXX|NOTE|BUG)\\b', 1)) AS kind FROM l WHERE regexp_matches(line, '(?i)(?:#|//|/\\*|\\*|--|<!--)\\s*(TODO|FIXME|HACK|XXX|NOTE|BUG)\\b')""")
def todo_lines(spark, folder):
    pattern = r"(?i)(?:#|//|/\*|\*|--|<!--)\s*(TODO|FIXME|HACK|XXX|NOTE|BUG)(?![A-Za-z0-9_])"
    lines = table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("p", "line"))
    return lines.where(F.col("line").rlike(pattern)).select("doc_id", (F.col("p") + 1).alias("line_no"), F.upper(F.regexp_extract("line", pattern, 1)).alias("kind"))


QUESTIONS = ["how does serializeToken work", "where is the turbine throttled when the grid is congested", "付款与发票", "which file handles appeal deadline", "quux zzyzzx"]


_CHUNK_WORDS = f"{CHUNKS}, {_WORDS.format('c')}"
_LOOKED_UP = ", ".join(f"({q}, '{t}')" for q, ts in ((0, ("how", "does", "serialize", "token", "work")), (1, ("is", "turbine", "throttled", "grid", "congested")), (2, ("which", "file", "handles", "appeal", "deadline"))) for t in ts)


@query(f"""WITH {_CHUNK_WORDS}, q AS (SELECT * FROM (VALUES {_LOOKED_UP}) t(qid, term)), len AS (SELECT id, count(*) AS len FROM k GROUP BY id), st AS (SELECT (SELECT count(*) FROM c) AS total, (SELECT count(*) FROM k)::DOUBLE / (SELECT count(*) FROM c) AS avg),
tf AS (SELECT id, token, count(*) AS tf FROM k WHERE token IN (SELECT term FROM q) GROUP BY ALL), df AS (SELECT token, count(*) AS df FROM tf GROUP BY token)
SELECT qid, id, round(round(sum(ln(1 + (total - df + 0.5) / (df + 0.5)) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * len / avg))), 9), 6) AS bm25, count_if(NOT (df / total > 0.4 AND df > 3) AND length(term) > 2)::INT AS strong
FROM q JOIN tf ON term = tf.token JOIN df ON tf.token = df.token JOIN len USING (id), st GROUP BY qid, id""")
def ask_words(spark, folder):
    """The part of ask_hits that words give: BM25 and telling terms of every chunk, for the questions in plain letters."""
    index = S.index_chunks(chunks(spark, folder, "fileId", "symbolName", "startLine", "endLine", "kind", "text"))
    asked = S.query_terms(spark, [QUESTIONS[0], QUESTIONS[1], QUESTIONS[3]]).collect()
    return S.scores(stored(index), asked).where("bm25 > 0").select("qid", "id", F.round("bm25", 6).alias("bm25"), "strong")


@query()
def ask_hits(spark, folder):
    """The hybrid search of a few questions over all chunks."""
    index = S.index_chunks(chunks(spark, folder, "fileId", "symbolName", "startLine", "endLine", "kind", "text"))
    return S.search(stored(index), QUESTIONS)


_ASKED = " UNION ALL ".join(f"SELECT {q} AS qid, unnest({t}) AS term" for q, t in enumerate((["serialize", "token", "work"], ["turbine", "throttled", "grid", "congested"], ["appeal", "deadline", "files"])))


@query(f"""WITH d AS (SELECT doc_id AS id, text FROM documents WHERE text IS NOT NULL), {_WORDS.format('d')}, q AS ({_ASKED}), n AS (SELECT id, count(*) AS len FROM k GROUP BY id), st AS (SELECT (SELECT count(*) FROM d) AS total, (SELECT count(*) FROM k)::DOUBLE / (SELECT count(*) FROM d) AS avg),
tf AS (SELECT id, token, count(*) AS tf FROM k WHERE token IN (SELECT term FROM q) GROUP BY ALL), df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
sc AS (SELECT qid, id, round(sum(ln(1 + (total - df + 0.5) / (df + 0.5)) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * len / avg))), 6) AS bm25 FROM q JOIN tf ON term = tf.token JOIN df ON tf.token = df.token JOIN n USING (id), st GROUP BY qid, id),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY bm25 DESC, id) AS rank FROM sc) SELECT qid, rank, id AS doc_id, bm25 FROM r WHERE rank <= 20""")
def bm25_top(spark, folder):
    """The 20 best documents for three term lists by BM25 alone."""
    docs = stored(table(spark, folder, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("id"), X.tokenize(F.col("text")).alias("words"), F.lit("").alias("text")))
    size = docs.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("words")).alias("avg")).first()
    pairs = spark.createDataFrame([(q, t) for q, ts in enumerate((["serialize", "token", "work"], ["turbine", "throttled", "grid", "congested"], ["appeal", "deadline", "files"])) for t in ts], "qid int, term string")
    held = S.postings(docs, sorted({r.term for r in pairs.collect()}))
    df = held.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    rows = held.join(pairs, "term").join(df, "term").join(docs.select("id", F.size("words").alias("len")), "id")
    score = X.bm25(F.col("tf"), F.col("df"), F.lit(float(size.n)), F.col("len"), F.lit(float(size.avg or 1)))
    best = rows.groupBy("qid", "id").agg(F.round(F.sum(score), 6).alias("bm25"))
    return top(best, "qid", [F.desc("bm25"), F.col("id")], 20).select("qid", "rank", F.col("id").alias("doc_id"), "bm25")


@query("""WITH q AS (SELECT vec_id AS query, embedding::DOUBLE[] AS qe FROM embeddings WHERE vec_id % 100 = 0), c AS (SELECT query, vec_id AS key, round(list_cosine_similarity(qe, embedding::DOUBLE[]), 6) AS similarity FROM q, embeddings WHERE vec_id <> query),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, key) AS rank FROM c) SELECT query, key, similarity, rank FROM r WHERE rank <= 10""")
def nearest_vectors(spark, folder):
    rows = table(spark, folder, "embeddings")
    return nearest(rows, rows.where("vec_id % 100 = 0"), "vec_id", "embedding", 10)


@query("""WITH q AS (SELECT vec_id AS query, embedding::DOUBLE[] AS qe FROM embeddings WHERE vec_id % 100 = 0), c AS (SELECT query, vec_id AS key, label, round(list_cosine_similarity(qe, embedding::DOUBLE[]), 6) AS similarity FROM q, embeddings WHERE vec_id <> query),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, key) AS rank FROM c), v AS (SELECT query, label, count(*) AS votes FROM r WHERE rank <= 10 GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY votes DESC, label) AS k FROM v) SELECT query, label, votes FROM o WHERE k = 1""")
def neighbour_vote(spark, folder):
    labels = table(spark, folder, "embeddings").select(F.col("vec_id").alias("key"), "label")
    votes = nearest_vectors(spark, folder).join(labels, "key").groupBy("query", "label").agg(F.count(F.lit(1)).alias("votes"))
    return top(votes, "query", [F.desc("votes"), F.col("label")], 1).select("query", "label", "votes")


_REF = "[A-Za-z0-9_./@-]+\\.[A-Za-z0-9]+:\\d+(?:-\\d+)?(?:#[A-Za-z_$][A-Za-z0-9_$.]*)?"


@query(f"SELECT doc_id, ref, regexp_extract(ref, '^(.*?\\.[A-Za-z0-9]+):\\d', 1) AS path, TRY_CAST(regexp_extract(ref, ':(\\d+)', 1) AS INT) AS line, nullif(regexp_extract(ref, '#(.*)$', 1), '') AS symbol FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_REF}')) AS ref FROM documents)")
def cited_places(spark, folder):
    return V.references(table(spark, folder, "documents"), "doc_id").select("doc_id", "ref", "path", "line", "symbol")


@query(f"""WITH {FILES}, {SYMBOLS}, r AS (SELECT doc_id, ref, regexp_extract(ref, '^(.*?\\.[A-Za-z0-9]+):\\d', 1) AS path, TRY_CAST(regexp_extract(ref, ':(\\d+)', 1) AS INT) AS line, TRY_CAST(nullif(regexp_extract(ref, ':\\d+-(\\d+)', 1), '') AS INT) AS last, nullif(regexp_extract(ref, '#(.*)$', 1), '') AS symbol
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_REF}')) AS ref FROM documents)),
n AS (SELECT name, count(DISTINCT id) AS n FROM s WHERE name IS NOT NULL GROUP BY 1), low AS (SELECT lower(id) AS id, max(loc) AS loc FROM f GROUP BY 1),
v AS (SELECT r.*, f.id AS exact, low.id AS loose, coalesce(CASE WHEN f.id IS NOT NULL THEN f.loc ELSE low.loc END, 0) AS loc, CASE WHEN n.n IS NULL AND y.id IS NULL THEN NULL ELSE greatest(coalesce(n.n, 0), CASE WHEN y.id IS NULL THEN 0 ELSE 1 END) END AS symbols
  FROM r LEFT JOIN f ON r.path = f.id LEFT JOIN low ON lower(r.path) = low.id LEFT JOIN n ON r.symbol = n.name LEFT JOIN s y ON r.symbol = y.id)
SELECT doc_id, ref, CASE WHEN exact IS NULL AND loose IS NULL THEN 'unknown path' WHEN symbol IS NOT NULL AND symbols IS NULL THEN 'unknown symbol' WHEN symbols > 1 THEN 'ambiguous'
 WHEN line < 1 OR loc > 0 AND line > loc OR last < 1 OR loc > 0 AND last > loc THEN 'line out of range' ELSE 'ok' END AS verdict FROM v""")
def checked_citations(spark, folder):
    refs = V.references(table(spark, folder, "documents"), "doc_id")
    return V.check(refs, files(spark, folder), symbols(spark, folder)).select("doc_id", "ref", "verdict")


@query("SELECT l_returnflag, quantile_cont(l_extendedprice, 0.5) AS median_price, round(quantile_cont(l_quantity, 0.9), 6) AS p90_quantity, count(*) AS line_items, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY l_returnflag")
def percentiles(spark, folder):
    rows = table(spark, folder, "lineitem")
    return rows.groupBy("l_returnflag").agg(
        F.percentile("l_extendedprice", 0.5).alias("median_price"), F.round(F.percentile("l_quantity", 0.9), 6).alias("p90_quantity"),
        F.count(F.lit(1)).alias("line_items"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("""WITH x AS (SELECT DISTINCT s_nationkey AS a, c_nationkey AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey <> c_nationkey)
SELECT a AS id, count(*) AS partners FROM x GROUP BY a""")
def trade_partners(spark, folder):
    """Distinct neighbours on a graph that takes four joins to make."""
    t = lambda n: table(spark, folder, n)
    links = t("lineitem").select("l_orderkey", "l_suppkey").join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    edges = G.weighted_edges(links, "s_nationkey", "c_nationkey")
    return edges.groupBy(F.col("from").alias("id")).agg(F.count(F.lit(1)).alias("partners"))
