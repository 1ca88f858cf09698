"""What a project is made of, from ``project_files(project_root, path, content)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logsieve.functions.text import each, strict_json, trimmed

# Names and places looked for, in order.
MANIFEST, COMPILER, ENV_EXAMPLE = "package.json", "tsconfig.json", ".env.example"
READMES = ["README.md", "readme.md"]
TEST_FRAMEWORKS = ["vitest", "jest", "mocha", "ava"]
SKIPPED_NAMES = ["node_modules", "dist", "output", "coverage"]
ENTRY_NAME = r"^(?:index|main|app|server|cli)\.(?:ts|js|tsx|jsx)\z"
TEST_NAME = r"\.(?:test|spec)\.(?:ts|js|tsx|jsx)\z"
KNOWN_ENTRIES = [
    "src/index.ts", "src/app.ts", "src/main.ts", "src/cli.ts", "src/index.js", "src/app.js",
    "src/main.js", "index.ts", "index.js", "app.ts", "app.js",
]
MAX_DEPTH = 3
README_LENGTH = 500
MAX_KEY_FILES = 5

_MANIFEST_FIELDS = {"name": "$.name", "description": "$.description", "type": "$.type", "node": "$.engines.node"}
_MANIFEST_MAPS = ["dependencies", "devDependencies", "scripts"]
#: JSON texts that count as false.
FALSY = ["false", "null", "0", "-0", "0.0", '""']


def _file(project_files: DataFrame, path: str) -> DataFrame:
    return project_files.filter(F.col("path") == path).select("project_root", "content")


def manifests(project_files: DataFrame) -> DataFrame:
    """Parsed manifests; unreadable JSON counts as no manifest, an odd field as no field."""
    fields = [F.get_json_object("content", path).alias(name) for name, path in _MANIFEST_FIELDS.items()]
    fields += [
        F.from_json(F.get_json_object("content", f"$.{name}"), "map<string,string>").alias(name)
        for name in _MANIFEST_MAPS
    ]
    content = strict_json(F.col("content")).alias("content")
    return _file(project_files, MANIFEST).select("project_root", content).select(
        "project_root", F.when(F.col("content").isNotNull(), F.struct(*fields)).alias("m")
    )


def dependencies(project_files: DataFrame) -> DataFrame:
    rows = manifests(project_files)

    def names(field: str, is_dev: bool) -> DataFrame:
        return each(rows, F.map_keys(f"m.{field}"), "at", "name", "project_root").select(
            "project_root", "name", F.lit(is_dev).alias("is_dev"), (F.col("at") + 1).alias("nth")
        )

    return names("dependencies", False).unionByName(names("devDependencies", True))


def scripts(project_files: DataFrame) -> DataFrame:
    entries = F.map_entries("m.scripts")
    return each(manifests(project_files), entries, "at", "e", "project_root").select(
        "project_root",
        F.col("e.key").alias("name"),
        F.col("e.value").alias("command"),
        (F.col("at") + 1).alias("nth"),
    )


def projects(project_files: DataFrame) -> DataFrame:
    return project_files.select("project_root").distinct()


def manifest_facts(project_files: DataFrame) -> DataFrame:
    """One row per project; a project without a readable manifest gets the defaults."""
    return (
        projects(project_files)
        .join(manifests(project_files), "project_root", "left")
        .select(
            "project_root",
            F.coalesce("m.name", F.lit("unknown")).alias("name"),
            F.coalesce("m.description", F.lit("")).alias("description"),
            F.coalesce("m.type", F.lit("commonjs")).alias("type"),
            F.coalesce(
                F.concat(F.lit("Node.js "), F.nullif(F.col("m.node"), F.lit(""))),
                F.lit("Node.js"),
            ).alias("runtime"),
        )
    )


def compiler_options(project_files: DataFrame) -> DataFrame:
    """Options of projects whose compiler configuration has an options object."""

    def option(name: str) -> Column:
        return F.get_json_object("content", f"$.compilerOptions.{name}")

    def truthy(name: str) -> Column:
        value = F.try_variant_get(F.try_parse_json("content"), f"$.compilerOptions.{name}", "variant")
        return F.coalesce(~F.to_json(value).isin(FALSY), F.lit(False))

    return (
        _file(project_files, COMPILER)
        .select("project_root", strict_json(F.col("content")).alias("content"))
        .filter(F.get_json_object("content", "$.compilerOptions").isNotNull())
        .select(
            "project_root",
            truthy("strict").alias("strict"),
            F.coalesce(option("target"), F.lit("unknown")).alias("target"),
            F.coalesce(option("module"), F.lit("unknown")).alias("module"),
            truthy("noUncheckedIndexedAccess").alias("unchecked_index"),
            option("paths").alias("paths"),
        )
    )


def env_vars(project_files: DataFrame) -> DataFrame:
    lines = F.transform(F.split("content", "\n"), trimmed)
    named = F.filter(
        F.transform(
            F.filter(
                lines,
                lambda l: (l != "") & ~F.startswith(l, F.lit("#")) & F.contains(l, F.lit("=")),
            ),
            lambda l: F.substring_index(l, "=", 1),
        ),
        lambda n: n != "",
    )
    return each(_file(project_files, ENV_EXAMPLE), named, "at", "name", "project_root").select(
        "project_root", "name", (F.col("at") + 1).alias("nth")
    )


def test_framework(project_files: DataFrame) -> DataFrame:
    """First known framework among the development dependencies, null when there is none."""
    dev = F.map_keys("m.devDependencies")
    found = F.coalesce(
        *[F.when(F.array_contains(dev, name), F.lit(name)) for name in TEST_FRAMEWORKS]
    )
    return (
        projects(project_files)
        .join(manifests(project_files), "project_root", "left")
        .select("project_root", found.alias("framework"))
    )


def project_language(project_files: DataFrame) -> DataFrame:
    return project_files.groupBy("project_root").agg(
        F.when(F.max(F.col("path") == COMPILER), "TypeScript")
        .otherwise("JavaScript")
        .alias("language")
    )


def file_listing(project_files: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Entries down to ``max_depth`` under ``src``, or under the root where there is no ``src``.

    ``sort_key`` orders entries as a tree: folders first at every level, then by name without
    regard to case, then by name. Names are joined by a character below all that names hold, so
    what is in ``auth`` comes before ``auth-client``.
    """
    has_src = project_files.groupBy("project_root").agg(
        F.max(F.startswith("path", F.lit("src/"))).alias("has_src")
    )
    rows = project_files.select("project_root", "path").join(has_src, "project_root")
    parts = F.split("path", "/")
    below = rows.filter(~F.col("has_src") | F.startswith("path", F.lit("src/"))).select(
        "project_root",
        "has_src",
        F.when(F.col("has_src"), F.slice(parts, F.lit(2), F.size(parts))).otherwise(parts).alias("p"),
    )
    levels = F.sequence(F.lit(0), F.least(F.size("p") - 1, F.lit(max_depth)))
    entries = below.select(
        "project_root", "has_src", "p", F.explode(levels).alias("depth")
    ).select(
        "project_root",
        "has_src",
        "depth",
        (F.col("depth") < F.size("p") - 1).alias("is_dir"),
        F.slice("p", F.lit(1), F.col("depth") + 1).alias("p"),
    )
    hidden = F.exists(
        "p", lambda s: F.startswith(s, F.lit(".")) | s.isin(SKIPPED_NAMES)
    )
    # The last name counts as a folder only if the entry is one.
    key = F.array_join(
        F.transform(
            "p",
            lambda s, k: F.concat(
                F.when((k < F.col("depth")) | F.col("is_dir"), "0").otherwise("1"),
                F.lower(s), F.lit("\x02"), s,
            ),
        ),
        "\x01",
    )
    return (
        entries.filter(~hidden)
        .select(
            "project_root",
            F.concat(
                F.when(F.col("has_src"), "src/").otherwise(""), F.array_join("p", "/")
            ).alias("path"),
            "depth",
            "is_dir",
            key.alias("sort_key"),
        )
        .distinct()
    )


def key_files(project_files: DataFrame, k: int = MAX_KEY_FILES) -> DataFrame:
    """Entry points of the tree by name, the first test file, then known places that exist.

    Names found in the tree are bare, so a known place is left out only if it equals one.
    """
    tree = file_listing(project_files).withColumn("name", F.substring_index("path", "/", -1))
    entries = tree.filter(F.col("name").rlike(ENTRY_NAME)).select(
        "project_root", "name", F.lit(0).alias("kind"), "sort_key"
    )
    tests = (
        tree.filter(~F.col("is_dir") & F.col("name").rlike(TEST_NAME))
        .groupBy("project_root")
        .agg(F.min_by("name", "sort_key").alias("name"), F.min("sort_key").alias("sort_key"))
        .select("project_root", "name", F.lit(1).alias("kind"), "sort_key")
    )
    named = entries.unionByName(tests)
    rank = None
    for nth, path in enumerate(KNOWN_ENTRIES):
        test = F.col("path") == path
        rank = F.when(test, f"{nth:02d}") if rank is None else rank.when(test, f"{nth:02d}")
    known = (
        project_files.filter(F.col("path").isin(KNOWN_ENTRIES))
        .select("project_root", F.col("path").alias("name"), F.lit(2).alias("kind"), rank.alias("sort_key"))
        .join(named.select("project_root", "name").distinct(), ["project_root", "name"], "left_anti")
    )
    order = Window.partitionBy("project_root").orderBy("kind", "sort_key")
    return (
        named.unionByName(known)
        .withColumn("rk", F.row_number().over(order))
        .filter(F.col("rk") <= k)
        .select("project_root", "rk", F.col("name").alias("path"))
    )


def readme_excerpt(project_files: DataFrame, limit: int = README_LENGTH) -> DataFrame:
    """First characters of the read-me; the capital form wins."""
    return (
        project_files.filter(F.col("path").isin(READMES))
        .groupBy("project_root")
        .agg(F.min_by(F.substring("content", 1, limit), "path").alias("excerpt"))
    )
