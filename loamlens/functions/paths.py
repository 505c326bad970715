"""Expressions on file paths and module specifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slashed(path: Column) -> Column:
    """``path`` with forward slashes and without leading ``./``; null stays null."""
    return F.regexp_replace(F.translate(path, "\\", "/"), r"^(?:\./+)+", "")


def parent(path: Column) -> Column:
    """The folder of ``path``: everything before the last slash, or an empty text at the root."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, r"/[^/]*$", "")).otherwise(F.when(path.isNotNull(), F.lit("")))


def resolved(path: Column) -> Column:
    """``path`` with ``.``, ``..`` and empty segments worked off; ``..`` at the root is dropped."""

    def step(done: Column, part: Column) -> Column:
        return (
            F.when(part.isin("", "."), done)
            .when(part == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
            .otherwise(F.array_append(done, part))
        )

    plain = ~path.rlike(r"(^|/)\.{0,2}(/|$)")
    worked = F.array_join(F.aggregate(F.split(path, "/", -1), F.array().cast("array<string>"), step), "/")
    return F.when(plain, path).otherwise(worked)


def extension(path: Column) -> Column:
    """The last extension of ``path`` in lower case without its dot; an empty text when there is none."""
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


# Extensions and the languages they stand for; two-part ones come first.
LANGUAGE_OF = {
    "d.ts": "ts", "ts": "ts", "tsx": "ts", "mts": "ts", "cts": "ts", "js": "js", "jsx": "js", "mjs": "js", "cjs": "js", "py": "py", "pyi": "py", "go": "go", "rs": "rs", "java": "java",
    "rb": "ruby", "cs": "csharp", "php": "php", "c": "c", "h": "c", "cpp": "cpp", "hpp": "cpp", "swift": "swift", "kt": "kotlin", "scala": "scala", "sh": "shell", "sql": "sql",
    "md": "markdown", "txt": "text", "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml", "html": "html", "css": "css",
}
# Names of folders and what they are for.
FOLDER_ROLES = {
    "src": "source", "lib": "library", "libs": "library", "test": "tests", "tests": "tests", "__tests__": "tests", "spec": "tests", "docs": "documentation", "doc": "documentation", "scripts": "scripts",
    "bin": "executables", "cmd": "executables", "apps": "applications", "packages": "packages", "services": "services", "examples": "examples", "public": "assets", "assets": "assets", "static": "assets", "config": "configuration",
    "build": "build", "dist": "build", "vendor": "vendored", "tools": "tooling", "internal": "internal",
}
# Folders that a scan passes over, hidden names that it doesn't, and endings of files that hold no source.
SKIPPED_FOLDERS = ("node_modules", ".git", "dist", "build", "out", "target", "vendor", "__pycache__", ".venv", "venv", "coverage", ".next", ".cache", ".idea", ".vscode")
SHOWN_HIDDEN = (".github", ".env.example", ".gitignore", ".eslintrc", ".prettierrc", ".editorconfig", ".dockerignore", ".npmrc")
SKIPPED_ENDINGS = (
    ".map", ".png", ".jpg", ".jpeg", ".gif", ".svg", ".ico", ".woff", ".woff2", ".ttf", ".eot", ".pdf", ".zip", ".gz", ".tar", ".jar", ".class", ".pyc", ".so", ".dll", ".exe", ".bin", ".lock", ".min.js", ".min.css",
)
# Files by which a program is entered.
ENTRY_FILES = r"(?:^|/)(?:src/)?(?:index|main|app|server|cli|__main__|manage|lib|mod)\.(?:ts|tsx|js|jsx|mjs|py|go|rs|java)$"


def detected_language(path: Column) -> Column:
    """The language of a path by its extension, two-part ones first; null where the extension says nothing."""
    table = F.create_map(*[F.lit(x) for kv in LANGUAGE_OF.items() for x in kv])
    name = F.lower(path)
    return F.coalesce(table[F.regexp_extract(name, r"\.([^./]+\.[^./]+)$", 1)], table[F.regexp_extract(name, r"\.([^./]+)$", 1)])


def is_test_path(path: Column) -> Column:
    """Whether a file holds tests, by its folders and name."""
    return path.rlike(r"(^|/)(tests?|__tests__)/|/spec/|\.(test|spec)\.(ts|tsx|js|jsx|mjs|py|go|rs|cs|rb)$|(^|/)test_[^/]*\.pyi?$|_test\.go$")


def is_skipped_path(path: Column) -> Column:
    """Whether a scan passes over a file: a skipped or hidden folder above it, a hidden name or an ending without source."""
    parts = F.split(path, "/", -1)
    hidden = F.exists(parts, lambda p: p.isin(*SKIPPED_FOLDERS) | (p.startswith(".") & ~p.isin(".", "..", *SHOWN_HIDDEN)))
    return hidden | F.lower(path).rlike("(" + "|".join(e.replace(".", r"\.") for e in SKIPPED_ENDINGS) + ")$")


def folder_role(folder: Column) -> Column:
    """What the first segment of a folder is for, ``source`` where it says nothing."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in FOLDER_ROLES.items() for x in kv])[F.lower(F.substring_index(folder, "/", 1))], F.lit("source"))


def file_role(path: Column) -> Column:
    """What a file is for, by the first rule that its path meets."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    return (
        F.when(is_test_path(path), "test")
        .when(name.rlike(r"^(index|main|app|server|cli|__main__)\."), "entry")
        .when(name.rlike(r"(config|settings|options)"), "config")
        .when(name.rlike(r"(route|router|controller|handler|endpoint)"), "routing")
        .when(name.rlike(r"(model|schema|entity|types?)[._-]"), "model")
        .when(name.rlike(r"(util|helper|common|shared)"), "utility")
        .when(name.rlike(r"(service|client|api)"), "service")
        .when(name.rlike(r"(store|reducer|cache|repository)"), "state")
        .when(name.rlike(r"(middleware|plugin|hook)"), "middleware")
        .when(name.rlike(r"\.(md|txt|rst)$"), "documentation")
        .otherwise("source")
    )


def ancestors(path: Column) -> Column:
    """All folders above a file (array), the root as ``.``."""
    parts = F.split(path, "/", -1)
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return F.when(F.size(parts) > 1, F.concat(F.array(F.lit(".")), above)).otherwise(F.array(F.lit(".")))


def quotient_id(path: Column) -> Column:
    """The group of a file in the folder graph: its first two folders."""
    parts = F.split(path, "/", -1)
    return F.when(F.size(parts) <= 1, path).when(F.size(parts) == 2, F.concat(parts[0], F.lit("/*"))).otherwise(F.concat_ws("/", parts[0], parts[1], F.lit("*")))


def glob_pattern(glob: str, *, any_case: bool = False) -> str:
    """The regular expression of a glob: ``**`` spans folders, ``*`` does not; all other signs stand for themselves."""
    special = set(r"\.+?()[]{}|^$")
    body = "".join("\x00" if c == "*" else "\\" + c if c in special else c for c in glob)
    return ("(?i)" if any_case else "") + "^" + body.replace("\x00\x00", ".*").replace("\x00", "[^/]*") + "$"


def package_name(module: Column) -> Column:
    """The package of an external module specifier: two segments behind an ``@``, otherwise one."""
    return F.when(module.startswith("@"), F.substring_index(module, "/", 2)).otherwise(F.substring_index(module, "/", 1))
