"""Source files: discovery, filters, languages and declarations, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Directories, file names and patterns of files that are not indexed.
EXCLUDED_DIRECTORIES = (
    "node_modules", ".git", "dist", "build", "out", "target", ".idea", ".vscode", ".next", ".nuxt", ".angular", ".turbo", ".vercel", ".output",
    ".svelte-kit", ".astro", "DerivedData", "Pods", ".xcbuild", "xcuserdata", ".gradle", ".m2", "www", "public", "coverage", "__coverage__",
    ".cache", ".tmp", ".temp", ".nx", ".pnpm", "__pycache__", ".venv", "venv", ".tox", "vendor/bundle", "target/debug", "target/release",
)
# The names that end in .config and a script's ending are left out here: CONFIG_PATTERN covers them all.
EXCLUDED_CONFIG_FILES = (
    ".eslintrc.js", ".eslintrc.cjs", ".eslintrc.mjs", ".prettierrc.js", ".prettierrc.cjs", ".babelrc.js", "tsconfig.json", "jsconfig.json",
    "package.json", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "bun.lockb", "angular.json", "karma.conf.js", "protractor.conf.js",
    "eas.json", "build.gradle", "build.gradle.kts", "settings.gradle", "settings.gradle.kts", "gradle.properties", "Podfile", "Podfile.lock",
)
CONFIG_PATTERN = r"\.(config|setup)\.(ts|js|mjs|cjs)$"
DECLARATION_PATTERN = r"\.d\.[mc]?ts$"
GENERATED_PATTERN = r"\.min\.(js|css)$|\.(bundle|chunk)\.js$|\.generated\.(ts|js)$|\.g\.dart$|-lock\.json$"
TEST_PATTERN = (
    r"\.(test|spec|tests|specs)\.(ts|tsx|js|jsx|mjs|cjs)$|(Test|Tests|Spec)\.(kt|java)$|Tests\.swift$"
    r"|/(__tests__|test|tests|spec|specs|androidTest|androidTestDebug|xctest)/"
)
LANGUAGE_OF = {"kt": "kotlin", "kts": "kotlin", "java": "java", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript"}
SOURCE_ROOTS = ("src", "lib", "app", "source", "sources")


def read_sources(spark: SparkSession, folder: str) -> DataFrame:
    """(file_path, text) of all files below a folder."""
    return spark.read.option("recursiveFileLookup", "true").text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("text"))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def language(path: Column) -> Column:
    """Language of a file's ending, in any case; NULL without a parser."""
    ending = F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1))
    return F.element_at(F.create_map(*[F.lit(x) for p in LANGUAGE_OF.items() for x in p]), ending)


def is_test_file(path: Column) -> Column:
    return path.rlike(TEST_PATTERN)


def should_scan(path: Column, additional_directories: tuple[str, ...] = ()) -> Column:
    """Whether a directory is entered: by its own name, and by where a `public` directory or one below `.angular` stands."""
    p = F.regexp_replace(path, r"\\", "/")
    name = base_name(p)
    return ~name.isin(*EXCLUDED_DIRECTORIES, *additional_directories) & ~((name == "public") & p.rlike("/(ios|android)/")) & ~F.contains(p, F.lit("/.angular/"))


def scanned(path: Column, root: Column, additional_directories: tuple[str, ...] = ()) -> Column:
    """Whether a scan that begins at root reaches a file: every directory between them is entered."""
    above = F.filter(with_ancestors(F.regexp_replace(path, "/[^/]*$", "")), lambda d: F.length(d) > F.length(root))
    return F.startswith(path, F.concat(root, F.lit("/"))) & F.forall(above, lambda d: should_scan(d, additional_directories))


def should_parse(
    path: Column, include_declarations: Column | bool = False, include_tests: bool = True, include_config: bool = False,
    excluded: Column | None = None, additional_directories: tuple[str, ...] = (),
) -> Column:
    """Whether a file is indexed. excluded: array of regular expressions searched in the path; NULL paths give NULL."""
    p, name = F.regexp_replace(path, r"\\", "/"), base_name(F.regexp_replace(path, r"\\", "/"))
    directories = "|".join(d.replace(".", r"\.") for d in (*EXCLUDED_DIRECTORIES, *additional_directories))
    keep = ~p.rlike(f"(^|/)({directories})/") & ~name.rlike(GENERATED_PATTERN)
    wanted = F.lit(include_declarations) if isinstance(include_declarations, bool) else F.coalesce(include_declarations, F.lit(False))
    keep &= wanted | ~name.rlike(DECLARATION_PATTERN)
    if not include_config:
        keep &= ~name.isin(*EXCLUDED_CONFIG_FILES) & ~name.rlike(CONFIG_PATTERN)
    if not include_tests:
        keep &= ~is_test_file(p)
    if excluded is not None:
        keep &= ~F.coalesce(F.exists(excluded, lambda x: F.regexp_like(p, x)), F.lit(False))
    return keep


def module_path(path: Column, project: Column) -> Column:
    """Directory of a file below its project, without leading source roots; NULL outside the project or where nothing is left."""
    rest = F.when(F.startswith(path, project), F.regexp_replace(F.substr(path, F.length(project) + 1), "^/+", ""))
    folder = F.when(F.contains(base_name(rest), F.lit(".")), F.regexp_replace(rest, "(^|/)[^/]*$", "")).otherwise(rest)
    return F.nullif(F.regexp_replace(folder, rf"^(({'|'.join(SOURCE_ROOTS)})(/|$))+", ""), F.lit(""))


def with_ancestors(path: Column) -> Column:
    """Array of a slash path and all paths above it."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def declared_package(text: Column) -> Column:
    """The package a Kotlin or Java text declares, or NULL."""
    return F.nullif(F.regexp_extract(text, r"(?m)^\s*package\s+([\w.]+)", 1), F.lit(""))


def imports(text: Column) -> Column:
    """Array of the paths of import statements: dotted paths, or the quoted modules of import, export and require."""
    dotted = F.regexp_extract_all(text, F.lit(r"(?m)^\s*import\s+(?:static\s+)?([\w.]+(?:\.\*)?)(?:\s+as\s+\w+)?;?\s*$"), 1)
    quoted = F.regexp_extract_all(text, F.lit(r"""(?:\bfrom|\bimport|\brequire)\s*\(?\s*["']([^"']+)["']"""), 1)
    return F.array_distinct(F.concat(dotted, quoted))


def declared_types(text: Column) -> Column:
    """Array of the names of declared classes, interfaces, objects, enums and records."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?m)^\s*(?:(?:export|default|declare|public|private|protected|internal|abstract|final|open|sealed|data|static|inner|annotation|value|enum)\s+)*(?:class|interface|object|enum|record)\s+([A-Z]\w*)"), 1))
