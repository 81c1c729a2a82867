"""Source trees as tables: files, lines, diffs, declared environment names, dependencies, Python facts."""

from __future__ import annotations

import ast
import json
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import per_row

# Folders that hold no sources of their own.
IGNORED_DIRS = (
    ".git", ".hg", ".svn", ".venv", "venv", "env", ".env", "node_modules", "__pycache__", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".tox", ".nox",
    ".eggs", "dist", "build", "site-packages", ".next", ".nuxt", ".cache", ".idea", ".vscode", "target", "vendor", "coverage", ".turbo", ".parcel-cache",
)
# Names that systems, runtimes and CI provide, and beginnings of such names.
AMBIENT = (
    "PATH", "HOME", "USER", "LOGNAME", "SHELL", "PWD", "OLDPWD", "TMPDIR", "TMP", "TEMP", "LANG", "LC_ALL", "LC_CTYPE", "TZ", "TERM", "HOSTNAME", "USERPROFILE", "APPDATA",
    "LOCALAPPDATA", "SYSTEMROOT", "COMSPEC", "OS", "PROGRAMFILES", "PROGRAMDATA", "NODE_ENV", "NODE_OPTIONS", "PYTHONPATH", "PYTHONUNBUFFERED", "PYTHONDONTWRITEBYTECODE",
    "VIRTUAL_ENV", "CONDA_PREFIX", "RUST_LOG", "RUST_BACKTRACE", "GOPATH", "GOROOT", "JAVA_HOME", "CI", "GITLAB_CI", "CI_COMMIT_SHA", "BUILDKITE", "CIRCLECI", "TRAVIS",
    "JENKINS_URL", "PORT", "DEBUG", "MODE", "DEV", "PROD", "SSR", "BASE_URL", "npm_package_version", "npm_package_name", "npm_lifecycle_event",
)
AMBIENT_PREFIXES = (
    "XDG_", "GITHUB_", "RUNNER_", "VERCEL_", "RAILWAY_", "RENDER_", "FLY_", "HEROKU_", "AWS_LAMBDA_", "AWS_REGION", "AWS_DEFAULT_REGION", "KUBERNETES_", "DYNO",
    "WEBSITE_", "FUNCTIONS_", "CF_PAGES", "NETLIFY", "CODESPACE",
)
# Files that declare environment names for all to see; a private `.env` is none of them.
DOTENV_NAMES = (".env.example", ".env.sample", ".env.template", ".env.defaults", ".env.dist", ".env.example.local", ".env.local.example", "env.example", "example.env")
# Folders whose sources only illustrate.
DOCS_DIRS = ("docs", "doc", "documentation", "examples-docs", "snippets")
# A default of a script's own; imports of a Python line, plain and by name.
SCRIPT_DEFAULT = r"\bprocess\.env\.([A-Za-z_][A-Za-z0-9_]*)\s*(?:=[^=]|\|\||\?\?)"
IMPORT_LINE = r"^\s*(?:import\s+([\w., ]+)|from\s+([\w.]+)\s+import\b)"
NAMED_IMPORT = r"""(?:importlib\.import_module|__import__)\(\s*['"]([\w.]+)['"]"""
COMPUTED_IMPORT = r"""(?:importlib\.import_module|__import__)\(\s*(?!["'])[^)]"""
COMMENT_LINE = r"^\s*(#|//|\*|/\*)"


def read_files(spark: SparkSession, root: str, limit: int = 4_000_000) -> DataFrame:
    """(path, text) of a tree: relative paths, ignored folders left out, UTF-8 with replacement; large files are null."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    full = F.regexp_replace("path", r"^[a-z]+:/*", "/")
    rel = F.regexp_replace(full, "^" + re.escape(root.rstrip("/")) + "/", "")
    parents = F.slice(F.split(rel, "/"), F.lit(1), F.size(F.split(rel, "/")) - 1)
    seen = raw.select(rel.alias("path"), F.when(F.col("length") <= limit, F.decode("content", "UTF-8")).alias("text"), parents.alias("dirs"))
    return seen.where(~F.exists("dirs", lambda d: d.isin(*IGNORED_DIRS) | d.endswith(".egg-info"))).drop("dirs")


#: What ends a line, as for `str.splitlines`.
LINE_END = r"(?:\r\n|[\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029])"


def text_lines(text) -> F.Column:
    """The lines of a text, as `str.splitlines` tells them; a final end opens no line, an empty text has none."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(text, LINE_END + r"\z", ""), LINE_END))


def region_lines(files: DataFrame) -> DataFrame:
    """(file, lineno, text) of whole texts, by the line ends that `added_lines` knows too."""
    parts = text_lines(F.col("text"))
    return files.where("text is not null and text <> ''").select(F.col("path").alias("file"), F.posexplode(parts).alias("i", "text")).select("file", (F.col("i") + 1).alias("lineno"), "text")


def added_lines(diff: str):
    """(file, lineno, text) of the added lines of a unified diff; combined hunks are skipped.

    A section without `+++` keeps the path of its `diff --git` line.
    """
    file, at, old, new = None, 0, 0, 0
    for line in diff.splitlines():
        if old > 0 or new > 0:
            mark, body = line[:1], line[1:]
            if mark == "+":
                if file:
                    yield file, at, body
                at, new = at + 1, new - 1
                continue
            if mark == "-":
                old -= 1
                continue
            if mark in (" ", ""):
                at, old, new = at + 1, old - 1, new - 1
                continue
            if mark == "\\":
                continue
            old = new = 0
        if line.startswith("diff --git "):
            named = re.match(r"diff --git a/.* b/(.+)$", line)
            file = named.group(1) if named else None
        elif line.startswith("@@@ "):
            file = None
        elif line.startswith("+++ "):
            name = line[4:].split("\t")[0].strip()
            file = None if name == "/dev/null" else name[2:] if name[:2] in ("a/", "b/") else name
        elif hunk := re.match(r"@@ -\d+(?:,(\d+))? \+(\d+)(?:,(\d+))? @@", line):
            old, at, new = (int(x) if x is not None else 1 for x in hunk.groups())


def diff_regions(diffs: DataFrame, column: str = "diff") -> DataFrame:
    return per_row(diffs, added_lines, [column], "file string, lineno long, text string")


def declared_env(files: DataFrame, facts: DataFrame | None = None, configured: tuple[str, ...] = ()) -> DataFrame:
    """(file, name, source): names that dotenv, Dockerfile and compose files declare, and those that code sets or defaults.

    configured: paths that are read like dotenv files too.  facts: `python_facts` of the files, where they are at hand.
    """
    name_of = "([A-Za-z_][A-Za-z0-9_]*)"
    lines = region_lines(files).withColumn("base", F.element_at(F.split("file", "/"), -1))
    listed = F.col("base").isin(*DOTENV_NAMES) | F.col("file").isin(*configured)
    dotenv = lines.where(listed).select("file", F.regexp_extract("text", rf"^\s*(?:export\s+)?{name_of}\s*[=:]", 1).alias("name"), F.lit("dotenv").alias("source"))
    docker = lines.where(F.col("base").rlike("^Dockerfile|\\.Dockerfile$") & F.col("text").rlike(r"^\s*(?i:ENV|ARG)\s"))
    docker = docker.select("file", F.explode(F.regexp_extract_all("text", F.lit(rf"(?:^\s*(?:ENV|ARG)\s+|\s){name_of}(?==|\s|$)"), F.lit(1))).alias("name"), F.lit("dockerfile").alias("source"))
    # compose: entries deeper than the last `environment:` line, until a line no deeper than it
    compose = lines.where(F.col("base").rlike(r"^(docker-)?compose(\..+)?\.ya?ml$") & (F.trim("text") != ""))
    indent = F.length("text") - F.length(F.ltrim("text"))
    in_file = Window.partitionBy("file").orderBy("lineno").rowsBetween(Window.unboundedPreceding, 0)
    compose = compose.withColumn("indent", indent).withColumn("open", F.when(F.col("text").rlike(r"^\s*environment:\s*$"), F.col("indent")))
    compose = compose.withColumn("scope", F.last("open", ignorenulls=True).over(in_file)).withColumn("opened", F.last(F.when(F.col("open").isNotNull(), F.col("lineno")), ignorenulls=True).over(in_file))
    inner = Window.partitionBy("file", "opened").orderBy("lineno").rowsBetween(Window.unboundedPreceding, 0)
    closed = F.max(F.when((F.col("lineno") > F.col("opened")) & (F.col("indent") <= F.col("scope")) & ~F.col("text").rlike(r"^\s*-"), 1)).over(inner)
    compose = compose.where("opened is not null").withColumn("closed", closed).where("closed is null and lineno > opened")
    compose = compose.select("file", F.regexp_extract("text", rf"^\s*(?:-\s*)?[\"']?{name_of}\s*[=:]?", 1).alias("name"), F.lit("compose").alias("source"))
    scripts = lines.where(F.col("file").rlike(r"\.[cm]?[jt]sx?$")).select("file", F.explode(F.regexp_extract_all("text", F.lit(SCRIPT_DEFAULT), F.lit(1))).alias("name"), F.lit("code_default").alias("source"))
    facts = python_facts(files) if facts is None else facts
    code = facts.where("tag = 'env_decl'").select(F.col("path").alias("file"), "name", F.col("value").alias("source"))
    return dotenv.unionByName(docker).unionByName(compose).unionByName(scripts).unionByName(code).where("name <> ''").distinct()


def where_to_declare(files: DataFrame, by: tuple[str, ...] = (), configured: tuple[str, ...] = ()) -> DataFrame:
    """(*by, file): where a missing name of the environment belongs, for a tree or for each one that `by` tells apart.

    The first of the configured files, then of the usual ones, that stands at the root; without any, `.env.example`.
    """
    names = F.array(*map(F.lit, (*configured, *DOTENV_NAMES)))
    nth = F.array_position(names, F.col("path"))
    first = files.groupBy(*by).agg(F.min_by("path", F.when(nth > 0, nth)).alias("file"))
    return first.select(*by, F.coalesce("file", F.lit(".env.example")).alias("file"))


# Names of manifests and lockfiles; a requirement's name, one that a URL carries; names in lockfiles and environment files; keys of a lockfile that are no packages.
MANIFEST = r"^(requirements.*\.txt|poetry\.lock|uv\.lock|Pipfile(\.lock)?|pyproject\.toml|setup\.cfg|environment\.ya?ml|package\.json|package-lock\.json|npm-shrinkwrap\.json|yarn\.lock|pnpm-lock\.yaml)$"
REQUIREMENT = r"\s*([A-Za-z0-9][A-Za-z0-9._-]*)"
EGG = r"[#&]egg=([A-Za-z0-9._-]+)"
LOCKED_NAME = r'(?m)^name\s*=\s*"([^"]+)"'
CONDA_NAME = r"(?m)^\s*-\s*([A-Za-z0-9][A-Za-z0-9._-]*)"
PNPM_PACKAGE = r"(?m)^\s{2}/?'?(@?[^@'\s/]+(?:/[^@'\s/]+)?)@"
PNPM_ENTRY = r"(?m)^\s{4,}'?(@[A-Za-z0-9._-]+/[A-Za-z0-9._-]+|[A-Za-z0-9._-]+)'?:\s*$"
PNPM_KEYS = (
    "dependencies", "devDependencies", "optionalDependencies", "packages", "snapshots", "importers", "specifiers", "resolution", "engines", "cpu", "os", "peerDependencies",
    "peerDependenciesMeta", "transitivePeerDependencies", "optional", "dev", "hasBin", "requiresBuild", "bin", "deprecated", "libc",
)


def _requirement(line) -> str | None:
    """The distribution that a requirement line names; a line of options or a bare URL names one only in its fragment."""
    if not isinstance(line, str):
        return None
    egg, plain = re.search(EGG, line), line.split("#", 1)[0].strip()
    if not plain or plain.startswith("-") or ("://" in plain and "@" not in plain.split("://")[0]):
        return egg.group(1) if egg else None
    found = re.match(REQUIREMENT, plain)
    return found.group(1) if found else None


def _locked_npm(tree: dict):
    for name, value in (tree or {}).items():
        yield name
        yield from _locked_npm(value.get("dependencies") if isinstance(value, dict) else None)


def manifest_names(path: str, text: str | None):
    """(file, lang, dist, kind): distributions that a manifest or lockfile names.

    Corrupt text gives one row of kind `error`, for what it lists, and with it what is absent, is not known.  A manifest
    that lists nothing gives one row with an empty name.
    """
    import configparser
    import tomllib

    base = path.rsplit("/", 1)[-1]
    names: list[str | None] = []
    lang, kind = "python", "manifest"
    try:
        if text is None:
            return
        if re.fullmatch(r"requirements.*\.txt", base):
            names = [_requirement(x) for x in text.splitlines()]
            rows = [x for x in text.splitlines() if x.strip() and not x.lstrip().startswith(("#", "-"))]
            kind = "lockfile" if rows and all(re.match(REQUIREMENT + r"(?:\[[^\]]*\])?\s*==", x) for x in rows) else "manifest"
        elif base in ("poetry.lock", "uv.lock"):
            names, kind = re.findall(LOCKED_NAME, text), "lockfile"
        elif base == "Pipfile":
            data = tomllib.loads(text)
            names = [*data.get("packages", {}), *data.get("dev-packages", {})]
        elif base == "Pipfile.lock":
            data = json.loads(text)
            names, kind = [*data.get("default", {}), *data.get("develop", {})], "lockfile"
        elif base == "pyproject.toml":
            data = tomllib.loads(text)
            project, poetry = data.get("project", {}), data.get("tool", {}).get("poetry", {})
            wanted = [*project.get("dependencies", []), *(y for x in project.get("optional-dependencies", {}).values() for y in x)]
            wanted += [y for x in data.get("dependency-groups", {}).values() for y in x]
            tool = data.get("tool", {})
            wanted += tool.get("uv", {}).get("dev-dependencies", [])
            wanted += [y for x in tool.get("hatch", {}).get("envs", {}).values() for key in ("dependencies", "extra-dependencies") for y in x.get(key, [])]
            wanted += [y for x in tool.get("pdm", {}).get("dev-dependencies", {}).values() for y in x]
            names = [*map(_requirement, wanted), *poetry.get("dependencies", {}), *poetry.get("dev-dependencies", {}), *(y for x in poetry.get("group", {}).values() for y in x.get("dependencies", {}))]
            names = [x for x in names if x != "python"]
        elif base == "setup.cfg":
            data = configparser.ConfigParser()
            data.read_string(text)
            wanted = data.get("options", "install_requires", fallback="").splitlines()
            if data.has_section("options.extras_require"):
                wanted += [y for _, x in data.items("options.extras_require") for y in x.splitlines()]
            names = [_requirement(x) for x in wanted if x.strip()]
        elif base in ("environment.yml", "environment.yaml"):
            names = [x for x in re.findall(CONDA_NAME, text) if x not in ("python", "pip")]
        elif base == "package.json":
            lang, data = "node", json.loads(text)
            names = [y for x in ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies") for y in data.get(x, {})]
        elif base in ("package-lock.json", "npm-shrinkwrap.json"):
            lang, kind, data = "node", "lockfile", json.loads(text)
            names = [x.rsplit("node_modules/", 1)[-1] for x in data.get("packages", {}) if "node_modules/" in x] + list(_locked_npm(data.get("dependencies")))
            names += [y for x in ("dependencies", "devDependencies", "optionalDependencies") for y in data.get("packages", {}).get("", {}).get(x, {})]
        elif base == "yarn.lock":
            lang, kind = "node", "lockfile"
            names = [y for x in re.findall(r"(?m)^(\S.*):$", text) for y in re.findall(r'(?:^|,\s*)"?((?:@[^/"\s]+/)?[^@"\s,]+)@', x)]
        elif base == "pnpm-lock.yaml":
            lang, kind = "node", "lockfile"
            names = [x for x in re.findall(PNPM_PACKAGE, text) + re.findall(PNPM_ENTRY, text) if x not in PNPM_KEYS]
    except (ValueError, AttributeError, TypeError, configparser.Error):
        yield path, lang, "", "error"
        return
    # a manifest without names is a source all the same
    for name in sorted({x for x in names if x}) or [""] * bool(re.match(MANIFEST, base)):
        yield path, lang, name, kind


def declared_dists(files: DataFrame) -> DataFrame:
    named = files.where(F.element_at(F.split("path", "/"), -1).rlike(MANIFEST))
    return per_row(named, manifest_names, ["path", "text"], "file string, lang string, dist string, kind string")


METHODS = ("get", "post", "put", "patch", "delete", "head", "options")


def _string(node) -> str | None:
    return node.value if isinstance(node, ast.Constant) and isinstance(node.value, str) else None


def _keyword(call: ast.Call, name: str):
    return next((k.value for k in call.keywords if k.arg == name), None)


def _env_prefix(body: list[ast.stmt]) -> str:
    """The prefix that a settings class gives in `model_config` or in an inner `Config`."""
    for stmt in body:
        target = stmt.targets[0] if isinstance(stmt, ast.Assign) else stmt.target if isinstance(stmt, ast.AnnAssign) else None
        if getattr(target, "id", "") == "model_config" and stmt.value is not None:
            pairs = [(k.arg, k.value) for k in getattr(stmt.value, "keywords", [])]
            if isinstance(stmt.value, ast.Dict):
                pairs += [(_string(k), v) for k, v in zip(stmt.value.keys, stmt.value.values)]
            return next((_string(v) or "" for k, v in pairs if k == "env_prefix"), "")
        if isinstance(stmt, ast.ClassDef) and stmt.name == "Config":
            return next((_string(x.value) or "" for x in stmt.body if isinstance(x, ast.Assign) and getattr(x.targets[0], "id", "") == "env_prefix"), "")
    return ""


def _dotted(node) -> str:
    # plain names, which most are, without the printer of whole expressions
    parts, at = [], node
    while isinstance(at, ast.Attribute):
        parts.append(at.attr)
        at = at.value
    if isinstance(at, ast.Name):
        return ".".join([at.id, *reversed(parts)])
    return ast.unparse(node) if parts else ""


ENVIRON = ("os.environ", "environ")


def _declarations(node):
    """(name, source) that one node declares: defaults, assignments, fields of settings classes."""
    if isinstance(node, ast.Call) and node.args and _string(node.args[0]):
        called, name = _dotted(node.func), _string(node.args[0])
        if called in ("os.environ.setdefault", "environ.setdefault"):
            yield name, "code_default"
        elif called in ("os.getenv", "os.environ.get", "getenv", "environ.get") and _has_default(node):
            yield name, "code_default"
    elif isinstance(node, ast.Assign):
        yield from ((_string(x.slice), "code_assign") for x in node.targets if isinstance(x, ast.Subscript) and _dotted(x.value) in ENVIRON and _string(x.slice))
    elif isinstance(node, ast.ClassDef) and any(_dotted(x).endswith("Settings") for x in node.bases):
        prefix = _env_prefix(node.body)
        for stmt in node.body:
            target = stmt.target if isinstance(stmt, ast.AnnAssign) else stmt.targets[0] if isinstance(stmt, ast.Assign) and len(stmt.targets) == 1 else None
            name = getattr(target, "id", "_")
            if not name.startswith("_") and name not in ("model_config", "Config"):
                yield (prefix + name).upper(), "settings_class"
                yield prefix + name, "settings_class"


def _has_default(call: ast.Call) -> bool:
    given = [*call.args[1:2], *([_keyword(call, "default")] if _keyword(call, "default") is not None else [])]
    return any(not (isinstance(x, ast.Constant) and x.value is None) for x in given)


def _bindings(node):
    """(name, kind, target) that one node binds in its file."""
    if isinstance(node, ast.Import):
        yield from ((a.asname or a.name.split(".")[0], "import", a.name if a.asname else a.name.split(".")[0]) for a in node.names)
    elif isinstance(node, ast.ImportFrom):
        module = "." * node.level + (node.module or "")
        yield from (("*", "star", module) if a.name == "*" else (a.asname or a.name, "import", f"{module}:{a.name}") for a in node.names)
    elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
        yield node.name, "class" if isinstance(node, ast.ClassDef) else "def", ""
    elif isinstance(node, ast.arg):
        yield node.arg, "param", ""
    elif isinstance(node, ast.Name) and isinstance(node.ctx, ast.Store):
        yield node.id, "assign", ""


def _routes(node):
    """(line, methods, path, handler, style, router) of routes that one node registers."""
    if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
        for d in node.decorator_list:
            if isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute) and isinstance(d.func.value, ast.Name) and d.func.attr in (*METHODS, "api_route"):
                methods = [d.func.attr] if d.func.attr in METHODS else [_string(x) or "?" for x in getattr(_keyword(d, "methods"), "elts", [])] or ["get"]
                yield d.lineno, methods, d.args[0] if d.args else _keyword(d, "path"), node.name, "decorator", d.func.value.id
    elif isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute) and node.func.attr in ("add_api_route", "add_route") and isinstance(node.func.value, ast.Name) and len(node.args) > 1:
        methods = [_string(x) or "?" for x in getattr(_keyword(node, "methods"), "elts", [ast.Constant("GET")])]
        yield node.lineno, methods, node.args[0], ast.unparse(node.args[1]), "call", node.func.value.id


def _line_rows(path: str, text: str):
    """Imports of a file that does not parse, line by line."""
    for line, x in enumerate(text.splitlines(), 1):
        if re.match(COMMENT_LINE, x):
            continue
        if found := re.match(IMPORT_LINE, x):
            names = [found.group(2)] if found.group(2) else [y.strip().split(" as ")[0].strip() for y in found.group(1).split(",")]
            yield from ((path, line, "import", y, "", "") for y in names if y and not y.startswith("."))
        yield from ((path, line, "import", y, "", "") for y in re.findall(NAMED_IMPORT, x))
        if re.search(COMPUTED_IMPORT, x):
            yield path, line, "import", "<dynamic>", "", "dynamic"


def _scopes(tree):
    """(line, qualified name, kind, end) of every definition, named with the definitions around it."""
    open_ = [(tree, "")]
    while open_:
        node, outer = open_.pop()
        for child in ast.iter_child_nodes(node):
            inner = outer
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                inner = f"{outer}.{child.name}" if outer else child.name
                yield child.lineno, inner, "class" if isinstance(child, ast.ClassDef) else "def", str(child.end_lineno)
            open_.append((child, inner))


def python_rows(path: str, text: str | None):
    """(path, line, tag, name, value, extra) of one Python file: imports, environment reads and declarations, symbols,
    scopes, bindings, routers, includes and routes; of a file that does not parse, its imports alone."""
    if text is None or not path.endswith(".py"):
        return
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        yield from _line_rows(path, text)
        return
    yield path, 0, "parsed", "", "", ""
    yield from ((path, line, "scope", name, kind, end) for line, name, kind, end in _scopes(tree))
    optional, nodes = set(), list(ast.walk(tree))
    for node in nodes:
        if isinstance(node, ast.Try) and any(h.type is None or any(getattr(x, "id", "") in ("ImportError", "ModuleNotFoundError", "Exception") for x in ast.walk(h.type)) for h in node.handlers):
            optional |= {x.lineno for y in node.body for x in ast.walk(y) if isinstance(x, (ast.Import, ast.ImportFrom))}
    for node in nodes:
        line = getattr(node, "lineno", 0)
        yield from ((path, line, "env_decl", name, source, "") for name, source in _declarations(node))
        yield from ((path, line, "binding", name, kind, target) for name, kind, target in _bindings(node))
        for at, methods, where, handler, style, router in _routes(node):
            full = _string(where) if _string(where) is not None else "?"
            for m in methods:
                yield path, at, "route", m.upper(), full, f"{router} {handler}"
                yield path, at, "edge", f"{m.upper()} {full}", handler, f"{style} {router}"
        if isinstance(node, ast.Import):
            for a in node.names:
                yield path, line, "import", a.name, a.asname or a.name.split(".")[0], "optional" if line in optional else ""
        elif isinstance(node, ast.ImportFrom):
            module = "." * node.level + (node.module or "")
            if node.level == 0:
                yield path, line, "import", module, "", "optional" if line in optional else ""
            for a in node.names:
                yield path, line, "star" if a.name == "*" else "imported", a.asname or a.name, module, a.name
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            yield path, line, "symbol", node.name, "class" if isinstance(node, ast.ClassDef) else "def", str(node.end_lineno)
        elif isinstance(node, ast.Subscript) and isinstance(node.ctx, ast.Load) and _dotted(node.value) in ENVIRON:
            name = _string(node.slice)
            yield path, line, "env", name or "<dynamic>", "", "dynamic" if name is None else ""
        elif isinstance(node, ast.Assign) and isinstance(node.value, ast.Call) and getattr(node.value.func, "id", getattr(node.value.func, "attr", "")) in ("FastAPI", "APIRouter"):
            kind = "app" if "FastAPI" in ast.unparse(node.value.func) else "router"
            prefix = _keyword(node.value, "prefix")
            for target in node.targets:
                if isinstance(target, ast.Name):
                    yield path, line, "router", target.id, "" if prefix is None else _string(prefix) if _string(prefix) is not None else "?", kind
        elif isinstance(node, ast.Call):
            called = _dotted(node.func)
            if called in ("os.getenv", "os.environ.get", "getenv", "environ.get") and node.args:
                name = _string(node.args[0])
                yield path, line, "env", name or "<dynamic>", "", "dynamic" if name is None else "default" if _has_default(node) else ""
            elif called in ("importlib.import_module", "__import__") and node.args:
                name = _string(node.args[0])
                if name is None or not name.startswith("."):
                    yield path, line, "import", name or "<dynamic>", "", "dynamic" if name is None else "optional" if line in optional else ""
            elif isinstance(node.func, ast.Attribute) and node.func.attr == "include_router" and isinstance(node.func.value, ast.Name) and node.args:
                prefix = _keyword(node, "prefix")
                yield path, line, "include", node.func.value.id, ast.unparse(node.args[0]), "" if prefix is None else _string(prefix) if _string(prefix) is not None else "?"


def python_facts(files: DataFrame) -> DataFrame:
    return per_row(files, python_rows, ["path", "text"], "path string, line long, tag string, name string, value string, extra string")


def in_docs(path) -> F.Column:
    """Whether a path lies in a folder of documentation, whose sources only illustrate."""
    dirs = F.split(F.lower(path), "/")
    return F.arrays_overlap(F.slice(dirs, F.lit(1), F.size(dirs) - 1), F.array(*map(F.lit, DOCS_DIRS)))


def is_ambient(name) -> F.Column:
    return name.isin(*AMBIENT) | name.rlike("^(" + "|".join(AMBIENT_PREFIXES) + ")")
