"""Tables that results must agree with. Rules are tried in the order given, the first match decides."""

#: Paths of test files.
TEST_PATHS = (
    r"(?i)(^|/)(test|tests|__tests__|spec|specs|e2e|testing)/",
    r"(?i)\.(test|spec)\.[a-z]+$",
    r"(^|/)(test_|conftest)",
    r"(?i)_test\.[a-z]+$",
    r"Tests?\.java$",
)

#: Names of configuration files.
CONFIG_NAMES = (
    r"(?i)^\.?env(\..*)?$",
    r"(?i)^\.eslintrc",
    r"(?i)^\.prettierrc",
    r"(?i)^\.editorconfig$",
    r"(?i)^\.babelrc",
    r"(?i)^\.npmrc$",
    r"(?i)^\.nvmrc$",
    r"(?i)^tsconfig.*\.json$",
    r"(?i)^jsconfig.*\.json$",
    r"(?i)^jest\.config",
    r"(?i)^vite\.config",
    r"(?i)^webpack\.config",
    r"(?i)^rollup\.config",
    r"(?i)^next\.config",
    r"(?i)^nuxt\.config",
    r"(?i)^tailwind\.config",
    r"(?i)^postcss\.config",
    r"(?i)^babel\.config",
    r"(?i)^eslint\.config",
    r"(?i)^docker-compose.*\.ya?ml$",
    r"(?i)^nginx\.conf$",
    r"(?i)^ruff\.toml$",
    r"(?i)^mypy\.ini$",
    r"(?i)^\.flake8$",
    r"(?i)^pytest\.ini$",
    r"(?i)^tox\.ini$",
    r"(?i)^\.coveragerc$",
    r"(?i)^requirements.*\.txt$",
    r"(?i)^package\.json$",
    r"(?i)^pyproject\.toml$",
    r"(?i)^setup\.(py|cfg)$",
    r"(?i)^pom\.xml$",
    r"(?i)^build\.gradle(\.kts)?$",
    r"(?i)^go\.mod$",
    r"(?i)^Cargo\.toml$",
    r"(?i)^composer\.json$",
    r"(?i)^Gemfile$",
    r"(?i).*\.csproj$",
    r"(?i)^settings\.gradle$",
    r"(?i)^Makefile$",
    r"(?i)^CMakeLists\.txt$",
    r"(?i)^\.sparklodeignore$",
    r"(?i)^\.gitignore$",
    r"(?i)^\.dockerignore$",
    r"(?i)^\.gitattributes$",
)

#: Infrastructure, matched against the path and against the name.
INFRA_PATHS = (
    r"(?i)(^|/)(\.github/workflows|\.gitlab-ci|\.circleci|\.azure|\.bitbucket)",
    r"(?i)^Dockerfile",
    r"(?i)^Jenkinsfile$",
    r"(?i)\.tf(vars)?$",
    r"(?i)^serverless\.ya?ml$",
    r"(?i)(^|/)(k8s|kubernetes|helm|charts|deploy|deployment|infra|terraform)/",
    r"(?i)^Chart\.yaml$",
    r"(?i)^playbook.*\.ya?ml$",
    r"(?i)^ansible\.cfg$",
    r"(?i)^Procfile$",
    r"(?i)^fly\.toml$",
    r"(?i)^vercel\.json$",
    r"(?i)^\.github/dependabot\.yml$",
)

#: Extensions of assets.
ASSETS = (
    ".css", ".scss", ".sass", ".less", ".svg", ".png", ".jpg", ".jpeg", ".gif", ".ico", ".webp",
    ".woff", ".woff2", ".ttf", ".eot", ".mp4", ".mp3", ".pdf", ".csv", ".parquet", ".ipynb",
)

#: Paths of generated files.
GENERATED_PATHS = (
    r"\.pb\.go$",
    r"_pb2(_grpc)?\.py$",
    r"\.g\.dart$",
    r"\.min\.(js|css)$",
    r"\.map$",
    r"(?i)(^|/)(dist|build|out|generated|__generated__|vendor)/",
    r"(?i)\.designer\.cs$",
    r"(?i)\.generated\.",
)

#: Languages by extension.
EXTENSION_LANGUAGES = {
    ".ts": "typescript", ".mts": "typescript", ".cts": "typescript", ".tsx": "tsx",
    ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".jsx": "jsx",
    ".py": "python", ".pyi": "python", ".java": "java", ".go": "go", ".rs": "rust",
    ".c": "c", ".h": "c", ".cc": "cpp", ".cpp": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".hh": "cpp",
    ".cs": "csharp", ".rb": "ruby", ".php": "php", ".kt": "kotlin", ".kts": "kotlin", ".scala": "scala", ".sc": "scala",
    ".swift": "swift", ".sh": "shell", ".bash": "shell", ".zsh": "shell", ".sql": "sql", ".vue": "vue", ".svelte": "svelte",
    ".html": "html", ".htm": "html", ".css": "css", ".scss": "css", ".sass": "css", ".less": "css",
    ".yaml": "yaml", ".yml": "yaml", ".json": "json", ".jsonc": "json", ".md": "markdown", ".markdown": "markdown", ".mdx": "markdown",
    ".txt": "text", ".log": "text",
}

#: Languages by whole name in lower case; they go before extensions.
NAME_LANGUAGES = {
    "dockerfile": "text", "dockerfile.dev": "text", "dockerfile.prod": "text", "makefile": "text", "gnumakefile": "text", "cmakelists.txt": "text",
    "rakefile": "ruby", "gemfile": "ruby", "procfile": "text", "license": "text", "notice": "text", "authors": "text",
    "changelog": "markdown", "readme": "markdown",
    ".gitignore": "text", ".gitattributes": "text", ".dockerignore": "text", ".npmignore": "text", ".editorconfig": "text", ".env": "text", ".env.example": "text",
    ".bashrc": "shell", ".zshrc": "shell", ".babelrc": "json", ".eslintrc": "json", ".prettierrc": "json", ".stylelintrc": "json", ".sparklodeignore": "text",
    "package.json": "json", "package-lock.json": "json", "requirements.txt": "text", "tsconfig.json": "json",
}

#: Kinds of configuration by name.
CONFIG_KINDS = (
    (r"(?i)^\.env(?:\.|$)", "env"),
    (r"(?i)^\.eslintrc(?:\.|$)", "lint"),
    (r"(?i)^eslint\.config\.[cm]?[jt]s$", "lint"),
    (r"(?i)^\.eslintignore$", "lint"),
    (r"(?i)^tsconfig(?:\..*)?\.json$", "typescript"),
    (r"(?i)^jsconfig\.json$", "typescript"),
    (r"(?i)^jest\.config\.[cm]?[jt]s$", "test"),
    (r"(?i)^vitest\.config\.[cm]?[jt]s$", "test"),
    (r"(?i)^playwright\.config\.[cm]?[jt]s$", "test"),
    (r"(?i)^cypress\.config\.[cm]?[jt]s$", "test"),
    (r"(?i)^vite\.config\.[cm]?[jt]s$", "build"),
    (r"(?i)^webpack\.config\.[cm]?[jt]s$", "build"),
    (r"(?i)^rollup\.config\.[cm]?[jt]s$", "build"),
    (r"(?i)^esbuild\.config\.[cm]?[jt]s$", "build"),
    (r"(?i)^babel\.config\.[cm]?[jt]s$", "build"),
    (r"(?i)^\.babelrc(?:\.|$)", "build"),
    (r"(?i)^docker-compose.*\.ya?ml$", "container"),
    (r"(?i)^compose\.ya?ml$", "container"),
    (r"(?i)^nginx\.conf$", "server"),
    (r"(?i)^\.prettierrc(?:\.|$)", "format"),
    (r"(?i)^prettier\.config\.[cm]?[jt]s$", "format"),
    (r"(?i)^\.prettierignore$", "format"),
    (r"(?i)^ruff\.toml$", "lint"),
    (r"(?i)^\.flake8$", "lint"),
    (r"(?i)^mypy\.ini$", "typecheck"),
    (r"(?i)^pytest\.ini$", "test"),
    (r"(?i)^tox\.ini$", "test"),
    (r"(?i)^setup\.cfg$", "build"),
    (r"(?i)^\.nycrc(?:\.|$)", "coverage"),
    (r"(?i)^codecov\.ya?ml$", "coverage"),
    (r"(?i)^\.codecov\.ya?ml$", "coverage"),
    (r"(?i)^sonar-project\.properties$", "coverage"),
    (r"(?i)^Makefile$", "build"),
    (r"(?i)^CMakeLists\.txt$", "build"),
    (r"(?i)^settings\.[a-z0-9]+$", "app"),
    (r"(?i)^application(?:-[a-z0-9_-]+)?\.(?:ya?ml|properties)$", "app"),
    (r"(?i)^[^/]+\.config\.(?:[cm]?[jt]s|json5?|ya?ml|toml)$", "app"),
    (r"(?i)^pnpm-workspace\.ya?ml$", "workspace"),
    (r"(?i)^lerna\.json$", "workspace"),
    (r"(?i)^nx\.json$", "workspace"),
    (r"(?i)^turbo\.json$", "workspace"),
    (r"(?i)^rush\.json$", "workspace"),
)
CONFIG_FOLDERS = ((r"(?i)^(?:config|configs|conf)/", "runtime"),)

#: Build services by path.
CI_SERVICES = (
    (r"(?i)^\.github/workflows/.+\.ya?ml$", "github-actions"),
    (r"(?i)^\.gitlab-ci\.ya?ml$", "gitlab-ci"),
    (r"(?i)(^|/)Jenkinsfile$", "jenkins"),
    (r"(?i)^\.circleci/config\.ya?ml$", "circleci"),
    (r"(?i)^azure-pipelines\.ya?ml$", "azure-pipelines"),
    (r"(?i)^bitbucket-pipelines\.ya?ml$", "bitbucket-pipelines"),
    (r"(?i)^\.travis\.ya?ml$", "travis"),
    (r"(?i)^\.drone\.ya?ml$", "drone"),
    (r"(?i)^\.woodpecker\.ya?ml$", "woodpecker"),
)

#: Names of container files; infrastructure as code by name and by path; test and generated files of a scan.
CONTAINER_NAMES = (r"(?i)^Dockerfile(\..+)?$", r"(?i)\.dockerfile$", r"(?i)^docker-compose.*\.ya?ml$", r"(?i)^compose\.ya?ml$")
CODE_OF_INFRA_NAMES = (r"(?i)\.tf(vars)?\.json$", r"(?i)\.tfvars$", r"(?i)\.tf$", r"(?i)^ansible\.cfg$", r"(?i)^playbook.*\.ya?ml$", r"(?i)^Chart\.ya?ml$", r"(?i)^serverless\.ya?ml$", r"(?i)^pulumi")
CODE_OF_INFRA_PATHS = (r"(?i)(^|/)(k8s|kubernetes|manifests)/", r"(?i)(^|/)helm/")
TEST_FILES = (
    r"(?i)(^|/)(tests?|__tests__|spec|specs)/",
    r"(?i)(^|/)tests?\.[cm]?[jt]s$",
    r"(?i)\.(?:test|spec)\.[cm]?[jt]sx?$",
    r"(?i)(^|/)test_.*\.py$",
    r"(?i)(^|/).*_test\.py$",
    r"(^|/)[^/]*(?:Test|Tests|IT)\.java$",
    r"(?i)(^|/).*_test\.go$",
    r"(?i)(^|/).*_spec\.rb$",
    r"(?i)(^|/)[^/]*Test\.php$",
    r"(?i)(^|/)[^/]*Tests?\.cs$",
)
GENERATED_FILES = (
    r"(?i)\.pb\.go$",
    r"(?i)_pb2\.py$",
    r"(?i)_pb2_grpc\.py$",
    r"(?i)\.g\.dart$",
    r"(?i)\.min\.(?:js|css|mjs)$",
    r"(?i)\.generated\.",
    r"(?i)(^|/)dist/",
    r"(?i)(^|/)generated/",
    r"(?i)(^|/)__generated__/",
)

#: Names a runtime or a language brings along, in lower case; a call of one is no missing link.
BUILTINS = (
    # JavaScript and TypeScript
    "console", "json", "object", "array", "string", "number", "boolean", "math", "promise", "date",
    "regexp", "error", "typeerror", "rangeerror", "map", "set", "weakmap", "weakset", "symbol",
    "bigint", "proxy", "reflect", "parseint", "parsefloat", "isnan", "isfinite", "encodeuri",
    "decodeuri", "encodeuricomponent", "decodeuricomponent", "structuredclone", "fetch",
    "settimeout", "setinterval", "clearinterval", "cleartimeout", "queuemicrotask",
    "requestanimationframe", "require", "import", "usestate", "useeffect", "usememo", "usecallback",
    "useref", "usecontext", "usereducer", "definecomponent",
    # Python
    "print", "len", "range", "str", "int", "float", "bool", "list", "dict", "tuple", "set", "frozenset",
    "isinstance", "issubclass", "getattr", "setattr", "hasattr", "delattr", "enumerate", "zip",
    "sorted", "reversed", "sum", "min", "max", "abs", "open", "format", "repr", "type", "super", "id",
    "iter", "next", "any", "all", "round", "map", "filter", "vars", "dir", "hash", "callable",
    "staticmethod", "classmethod", "property", "globals", "locals", "input", "exit",
    # Java
    "system", "arrays", "collections", "objects", "optional", "stream", "integer", "long", "double",
    "stringbuilder", "thread", "runtime", "class", "println", "printf", "valueof", "getinstance",
    "requirenonnull", "empty", "oflist", "tolist",
    # Go and Rust
    "fmt", "make", "append", "copy", "delete", "panic", "recover", "vec", "println", "format", "clone",
    "tostring", "unwrap", "expect", "ok", "err", "new", "len", "cap", "close",
    # Ruby and PHP
    "puts", "p", "gets", "nil", "self", "dd", "dump", "var_dump", "echo", "empty", "isset", "unset",
    "printf", "sprintf", "implode", "explode", "array_map", "function_exists",
)

#: Kinds of projects in their order, dependencies that make one a web app or a service, and signs of a monorepo.
PROJECT_KINDS = ("cli", "library", "web-app", "api-service", "monorepo", "plugin", "data", "docs-only")
FRONTEND = ("react", "vue", "svelte", "next", "nuxt", "angular", "astro", "solid-js", "preact", "gatsby", "tailwind")
BACKEND = (
    "express", "koa", "fastify", "nestjs", "hapi", "restify", "django", "flask", "fastapi",
    "starlette", "rails", "sinatra", "laravel", "symfony", "spring-boot", "gin-gonic", "labstack/echo",
    "gofiber", "actix-web", "axum", "quarkus", "micronaut",
)
MONOREPO_FILES = ("pnpm-workspace.yaml", "pnpm-workspace.yml", "lerna.json", "nx.json", "turbo.json", "rush.json")
MONOREPO_PACKAGES = r"^(?:packages|apps|libs|modules|plugins)/[^/]+/package\.json$"
