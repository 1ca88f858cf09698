"""Column expressions shared by every operator.

All helpers take and return Columns, use only built-in functions and are narrow.
Patterns are written in the subset that Java and RE2 regular expressions agree on.
"""

from __future__ import annotations

import weakref
from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Characters that count as white space when a text is trimmed.
WHITE_SPACE = (
    " \t\n\x0b\x0c\r\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
)

# File extension -> language name.
LANGUAGES = {
    ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript",
    ".mjs": "javascript", ".cjs": "javascript", ".py": "python", ".rb": "ruby", ".go": "go",
    ".rs": "rust", ".java": "java", ".kt": "kotlin", ".swift": "swift", ".c": "c",
    ".cpp": "cpp", ".h": "c", ".hpp": "cpp", ".cs": "csharp", ".php": "php", ".sh": "bash",
    ".json": "json", ".yaml": "yaml", ".yml": "yaml", ".toml": "toml", ".md": "markdown",
    ".sql": "sql",
}

# Libraries looked for in error texts, in order of preference.
LIBRARIES = [
    "react", "next", "express", "prisma", "mongoose", "sequelize", "typeorm", "jest", "vitest",
    "mocha", "webpack", "vite", "rollup", "axios", "node-fetch", "zod", "yup", "fastify",
    "nestjs", "angular", "vue", "svelte", "drizzle", "trpc",
]

DOMAIN = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]+)"
SENTENCE = r"[^.!?]+[.!?]+"
SENTENCE_END = r"[^.!?][.!?]"
#: Characters in which the first sentences are looked for before the whole text is.
SENTENCE_HEAD = 500
PATH_IN_TEXT = r"/[\w/.:\-]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``.

    ``element_at`` keeps the type of its result; ``get`` derives it anew for each row, from all that ``body`` holds.
    """
    return F.element_at(F.transform(F.array(value), body), F.lit(1))


def each(rows: DataFrame, array: Column | str, pos: str, item: str, *keep: str) -> DataFrame:
    """Explode with positions, keeping the named columns.

    The outer form plus a null test, because the optimizer answers a plain explode of a column
    with a pushed-down ``size(column) > 0``, which would compute the whole parse twice.
    """
    return rows.select(*keep, F.posexplode_outer(array).alias(pos, item)).filter(
        F.col(pos).isNotNull()
    )


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE_SPACE))


def lines_of(text: Column) -> Column:
    """Split on line feeds; a trailing empty line and carriage returns stay."""
    return F.split(text, "\n")


def captured(text: Column, pattern: str, group: int = 1) -> Column:
    """Captured group, null when the pattern or the group did not match.

    A one-element array holds the match; nullif would run the pattern twice inside a lambda.
    """
    found = F.array(F.regexp_extract(text, pattern, group))
    return F.try_element_at(F.filter(found, lambda v: v != ""), F.lit(1))


def captured_int(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(text, pattern, group).try_cast("int")


def has(text: Column, needle: str) -> Column:
    return F.contains(text, F.lit(needle))


def gated(text: Column, needle: str, pattern: str) -> Column:
    """Regex test behind a cheap byte search for a literal the regex needs anyway."""
    return has(text, needle) & text.rlike(pattern)


def strict_json(text: Column) -> Column:
    """``text`` if it is one JSON document and nothing else, else null.

    The variant parser rejects single quotes and comments, the length of the text as an element
    tells text behind the document.
    """
    whole = F.concat(F.lit("["), text, F.lit("]"))
    return F.when(F.try_parse_json(whole).isNotNull() & (F.json_array_length(whole) == 1), text)


def truncate_text(text: Column, limit: int) -> Column:
    return F.when(
        F.length(text) > limit, F.concat(F.substring(text, 1, limit - 3), F.lit("..."))
    ).otherwise(text)


def resolve_path(file: Column, root: Column) -> Column:
    """Absolute path of ``file``; the fold over '.' and '..' only runs when one is present."""
    joined = F.concat(root, F.lit("/"), file)

    def fold(path: Column) -> Column:
        parts = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))
        kept = F.aggregate(
            parts,
            F.array().cast("array<string>"),
            lambda acc, s: F.when(
                s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
            ).otherwise(F.concat(acc, F.array(s))),
        )
        return F.concat(F.lit("/"), F.array_join(kept, "/"))

    return (
        F.when(F.startswith(file, F.lit("/")), file)
        .when(joined.rlike(r"/\.{0,2}(?:/|\z)"), fold(joined))
        .otherwise(joined)
    )


def owned_path(file: Column, full: Column, root: Column) -> Column:
    """Whether the resolved path ``full`` belongs to the project.

    Prefix test on purpose: a sibling '/repo/p10' counts for root '/repo/p1'.
    """
    return F.coalesce(
        (file != "") & F.startswith(full, root) & ~has(full, "node_modules"), F.lit(False)
    )


def is_project_file(file: Column, root: Column) -> Column:
    return owned_path(file, resolve_path(file, root), root)


def reusable(build: Callable) -> Callable:
    """Build an expression over fixed column names once per session and use it in every plan.

    The larger expressions take thousands of calls into the JVM to put together.
    """
    # By gateway object, not by its id: an id may be given out again after a restart.
    made: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()

    def once(*args):
        gateway = SparkContext._gateway
        if gateway is None:
            return build(*args)
        mine = made.setdefault(gateway, {})
        if args not in mine:
            mine[args] = build(*args)
        return mine[args]

    return once


def language_from_ext(file: Column) -> Column:
    ext = F.lower(F.regexp_extract(file, r"[^/](\.[^./]*)\z", 1))
    table = F.create_map(*[F.lit(v) for pair in LANGUAGES.items() for v in pair])
    return F.coalesce(F.try_element_at(table, ext), F.lit("text"))


def clean_error_message(message: Column) -> Column:
    no_paths = F.regexp_replace(message, PATH_IN_TEXT, "")
    return trimmed(F.regexp_replace(no_paths, r"\s{2,}", " "))


def first_literal(text: Column, words: list[str]) -> Column:
    """First word, in list order, that ``text`` contains."""
    return F.coalesce(*[F.when(has(text, w), F.lit(w)) for w in words])


def detect_library(text: Column) -> Column:
    return let(F.lower(text), lambda t: first_literal(t, LIBRARIES))


def detect_test_word(text: Column) -> Column:
    """Leftmost test runner named in ``text``."""
    return captured(F.lower(text), "(vitest|jest|mocha)")


def extract_domain(url: Column) -> Column:
    return F.coalesce(F.lower(captured(url, DOMAIN)), url)


def first_sentences(text: Column, count: int) -> Column:
    """First sentences of a text, or its first 200 characters when no sentence ends.

    Sentences follow each other without a gap, so one match covers the wanted number. A text's head answers
    for it if it holds them all and a character behind them; only else is the whole text read.
    """
    head = f"\\A[.!?]*+((?:[^.!?]++[.!?]++){{{count}}})[^.!?]"
    found = F.regexp_extract(text, f"(?:{SENTENCE}){{1,{count}}}", 0)
    whole = F.when(text.rlike(SENTENCE_END), trimmed(found)).otherwise(F.substring(text, 1, 200))
    return let(
        F.regexp_extract(F.substring(text, 1, SENTENCE_HEAD), head, 1),
        lambda first: F.when(first != "", trimmed(first)).otherwise(whole),
    )
