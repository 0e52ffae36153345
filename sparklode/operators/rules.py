"""Path rules: globs, ordered ignore rules, sensitive paths, file kinds and languages, as Column expressions over regexes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed
from ..functions.text import base_name, extension_of

#: What a scan leaves out unless told otherwise; the tool's own folders stand at the end.
IGNORED = (
    "node_modules bower_components .pnpm-store .yarn .git .hg .svn dist build out target coverage .nyc_output .next .nuxt "
    ".svelte-kit .turbo .cache .parcel-cache .angular .dart_tool DerivedData Pods .venv venv __pycache__ .pytest_cache "
    ".mypy_cache .ruff_cache .tox .gradle .idea .vscode .terraform .serverless .fusebox .dynamodb .sass-cache vendor .DS_Store "
    ".eslintcache *.min.js *.min.css *.map *.lock package-lock.json pnpm-lock.yaml yarn.lock *.log *.snap .sparklode sparklode-report"
).split()
#: Sensitive paths with the kind of what they hold, first match first.
SENSITIVE = (
    (".env*", "env"), ("*.pem", "certificate"), ("*.key", "private-key"), ("id_rsa*", "ssh-key"), ("id_dsa*", "ssh-key"), ("id_ecdsa*", "ssh-key"), ("id_ed25519*", "ssh-key"),
    ("credentials*", "credentials"), ("credentials.json", "credentials"), ("secrets*", "secrets"), (".npmrc", "registry-token"), (".pypirc", "registry-token"), (".netrc", "credentials"),
    (".git-credentials", "credentials"), (".htpasswd", "credentials"), ("*.p12", "keystore"), ("*.pfx", "keystore"), ("*.jks", "keystore"), ("*.keystore", "keystore"),
    (".aws/**", "cloud-credentials"), (".ssh/**", "ssh-config"), (".docker/config.json", "docker-credentials"), ("serviceAccount*.json", "service-account"), ("service-account*.json", "service-account"),
    ("kubeconfig", "kubeconfig"), ("*.kubeconfig", "kubeconfig"), ("*.tfstate", "terraform-state"), ("terraform.tfstate*", "terraform-state"),
)
ENV_TEMPLATE = r"(?i)^(?:.*/)?\.env\.(?:example|sample|template|dist|example\.[a-z0-9]+)$"
#: Lock files.
LOCK_FILES = "package-lock.json npm-shrinkwrap.json pnpm-lock.yaml yarn.lock bun.lockb poetry.lock pipfile.lock cargo.lock gemfile.lock composer.lock go.sum".split()


def glob_regex(pattern: str) -> str:
    """The regex of a glob: ** crosses folders, * and ? stay within one, {a,b} chooses. A pattern without a slash matches at any
    depth, one with a slash from the root; what is matched includes everything below it."""
    source = pattern.rstrip("/")
    source = source[1:] if source.startswith("/") else source
    out, k = [], 0
    while k < len(source):
        c, choice = source[k], source.find("}", k)
        if source.startswith("**/", k):
            out.append("(?:[^/]+/)*")
            k += 3
        elif source.startswith("**", k):
            out.append(".*")
            k += 2
        elif c == "{" and choice > k:
            out.append("(?:" + "|".join(escape(p.strip()) for p in source[k + 1 : choice].split(",")) + ")")
            k = choice + 1
        else:
            out.append({"*": "[^/]*", "?": "[^/]"}.get(c) or escape(c))
            k += 1
    return ("^" if "/" in source else "^(?:.*/)?") + "".join(out) + "(?:/.*)?$"


def escape(text: str) -> str:
    return "".join("\\" + c if c in ".+^$()|[]{}\\*?" else c for c in text)


def java(pattern: str) -> str:
    r"""The pattern for Java, where $ also matches before a last line end: \z does not."""
    return pattern[:-1] + r"\z" if pattern.endswith("$") and not pattern.endswith(r"\$") else pattern


def parse_rules(rules: Sequence[str]) -> list[tuple[str, bool]]:
    """(regex, whether it ignores) of each rule in order; blank lines and comments are none, ! takes back."""
    clean = [r.strip() for r in rules]
    return [(glob_regex(r.lstrip("!") if r.startswith("!") else r), not r.startswith("!")) for r in clean if r and not r.startswith("#") and r != "!"]


def ignored(path: Column, rules: Sequence[str] = IGNORED) -> Column:
    """The last rule that matches decides; rules that agree and follow each other are one regex, so that long lists stay cheap."""
    verdict, held = F.lit(False), []
    groups: list[tuple[list[str], bool]] = []
    for regex, ignores in parse_rules(rules):
        if groups and groups[-1][1] == ignores:
            groups[-1][0].append(regex)
        else:
            groups.append(([regex], ignores))
    for regexes, ignores in groups:
        verdict = F.when(path.rlike("|".join(f"(?:{java(r)})" for r in regexes)), F.lit(ignores)).otherwise(verdict)
    return F.coalesce(verdict, F.lit(False))


def sensitive_kind(path: Column, extra: Sequence[str] = ()) -> Column:
    """What a sensitive path holds, null for others; paths are tried as they are and in lower case, and as folders."""
    chain = F.when(path.rlike(java(ENV_TEMPLATE)), "env-template")
    for pattern, kind in [*SENSITIVE, *[(p, "custom") for p in extra]]:
        regex = java(glob_regex(pattern))
        hit = path.rlike(regex) | F.lower(path).rlike(regex)
        if pattern.endswith("/**"):
            hit = hit | F.concat(path, F.lit("/_")).rlike(regex) | F.concat(F.lower(path), F.lit("/_")).rlike(regex)
        chain = chain.when(hit, kind)
    return chain


def any_of(value: Column, patterns: Sequence[str]) -> Column:
    """Whether one of the patterns is found in `value`; all are one regex, so a list costs one pass."""
    scoped = [f"(?i:{java(p[4:])})" if p.startswith("(?i)") else f"(?:{java(p)})" for p in patterns]
    return value.rlike("|".join(scoped))


def first_of(value: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """What the first rule found in `value` stands for, null for none."""
    chain = F.when(F.lit(False), F.lit(None).cast("string"))
    for pattern, name in rules:
        chain = chain.when(value.rlike(java(pattern)), name)
    return chain


def file_kind(path: Column, language: Column) -> Column:
    """generated, infra, test, config, docs, asset or source, first match first."""
    base = base_name(path)
    text = F.when(path.startswith("docs/"), "docs").otherwise("asset")
    return (
        F.when(any_of(path, fixed.GENERATED_PATHS), "generated").when(any_of(path, fixed.INFRA_PATHS) | any_of(base, fixed.INFRA_PATHS), "infra").when(any_of(path, fixed.TEST_PATHS), "test")
        .when(any_of(base, fixed.CONFIG_NAMES), "config")
        .when((language == "markdown") | path.rlike(r"(?i)\.(?:md|mdx|rst|adoc)\z"), "docs").when(extension_of(path).isin(*fixed.ASSETS), "asset")
        .when(language.isin("json", "yaml"), "config").when(language == "text", text).otherwise("source")
    )


def language_of(path: Column) -> Column:
    """The language of a path: by its whole name, its beginning, its extension, else `text`."""
    base = F.lower(base_name(path))
    table = lambda rows: F.create_map(*[F.lit(x) for pair in rows.items() for x in pair])
    named = F.when(base.startswith("dockerfile") | base.startswith("makefile"), "text")
    return F.coalesce(table(fixed.NAME_LANGUAGES)[base], named, table(fixed.EXTENSION_LANGUAGES)[extension_of(path)], F.when(base.startswith("readme."), "markdown"), F.lit("text"))


def path_roles(path: Column) -> Column:
    """What else a path tells, as a struct: config (its kind or null), ci (the service or null), docs, container, infra, test and
    generated."""
    base = base_name(path)
    docs = base.rlike(r"(?i)^(?:readme|changelog|contributing)") | path.rlike(r"(?i)(^|/)(adr|docs?)/") & base.rlike(r"(?i)\.(?:md|mdx|markdown|txt|rst|adoc)\z") | ~path.contains("/") & base.rlike(r"(?i)\.(?:md|mdx|markdown|rst)\z")
    return F.struct(
        F.coalesce(first_of(base, fixed.CONFIG_KINDS), first_of(path, fixed.CONFIG_FOLDERS)).alias("config"), first_of(path, fixed.CI_SERVICES).alias("ci"), docs.alias("docs"), any_of(base, fixed.CONTAINER_NAMES).alias("container"),
        (any_of(base, fixed.CODE_OF_INFRA_NAMES) | any_of(path, fixed.CODE_OF_INFRA_PATHS)).alias("infra"), any_of(path, fixed.TEST_FILES).alias("test"), any_of(path, fixed.GENERATED_FILES).alias("generated"))
