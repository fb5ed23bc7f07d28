"""Paths, extensions and file classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.model import IGNORED_DIRS, IGNORED_FILES, SOURCE_EXTENSIONS


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirname(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def normalise(path: Column) -> Column:
    """Without ``.`` and ``..`` steps."""
    parts = F.filter(F.split(path, "/"), lambda x: ~x.isin("", "."))
    step = lambda acc, x: F.when(x != "..", F.concat(acc, F.array(x))).when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc)
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def joined(path: Column, source: Column) -> Column:
    """The path that a relative ``source`` names from the file ``path``, normalised. Where steps up stand at its beginning
    only, which is the rule, they are counted and so many folders are cut; other forms go step by step."""
    folder, step, odd = dirname(path), r"^(?:\.\.?/)+", r"(?:^|/)\.{0,2}(?:/|$)"
    rest = F.regexp_replace(source, step, "")
    ups = F.length(F.regexp_replace(F.regexp_replace(F.regexp_extract(source, step, 0), r"(?<!\.)\./", ""), "[^/]", ""))
    left = F.size(F.split(folder, "/")) - ups
    kept = F.when(left > 0, F.concat(F.call_function("substring_index", folder, F.lit("/"), left), F.lit("/"), rest)).when(folder.isNotNull(), rest)
    return F.when(folder.rlike(odd) | rest.rlike(odd), normalise(F.concat(folder, F.lit("/"), source))).otherwise(kept)


def strip_extension(path: Column) -> Column:
    return F.regexp_replace(path, "\\.(js|jsx|mjs|cjs|ts|tsx)$", "")


def extension(path: Column) -> Column:
    return F.regexp_extract(path, "(\\.[^./]+)$", 1)


def scanned(path: Column) -> Column:
    """A source file outside the ignored directories."""
    inside = F.exists(F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1), lambda s: s.isin(*IGNORED_DIRS))
    return extension(path).isin(*SOURCE_EXTENSIONS) & ~inside & ~basename(path).isin(*IGNORED_FILES)


def is_test(path: Column) -> Column:
    """A test by its name (test or spec before the extension of a script) or its folder, as enrichment sees it."""
    named = F.lower(path).rlike(r"[._](test|spec)\.[cm]?[jt]sx?$")
    return F.coalesce(named | path.contains("__tests__/") | path.rlike("(^|/)tests?/"), F.lit(False))


#: Asset classes by ordered patterns on the lower-cased path.
ASSETS = (
    ("pipeline", r"(^|/)\.github/workflows/|(^|/)\.gitlab-ci\.yml$"),
    ("service", r"(^|/)dockerfile$|(^|/)docker-compose[^/]*\.ya?ml$"),
    ("schema", r"\.(sql|prisma)$|(^|/)schema\.graphql$"),
    ("document", r"\.(md|mdx|rst)$"),
    ("config", r"(^|/)package\.json$|(^|/)tsconfig[^/]*\.json$|\.(yaml|yml|toml)$|(^|/)\.[a-z]+rc[^/]*$|\.config\.[cm]?[jt]s$"),
)


def asset_class(path: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, form in reversed(ASSETS):
        out = F.when(F.lower(path).rlike(form), name).otherwise(out)
    return out


#: Prefixes of node ids.
ID_PREFIXES = ("file", "function", "class", "module", "concept", "config", "document", "service", "table", "endpoint", "pipeline", "schema", "resource")


def node_id(ref: Column) -> Column:
    """A reference as a node id: one with a known prefix as it is, else a file."""
    return F.when(ref.rlike("^(" + "|".join(ID_PREFIXES) + "):"), ref).otherwise(F.concat(F.lit("file:"), ref))


def path_of_id(node: Column) -> Column:
    """What lies between the first and the last part of an id; of one with two parts, the second."""
    parts = F.split(node, ":")
    return F.when(F.size(parts) > 2, F.array_join(F.slice(parts, F.lit(2), F.size(parts) - 2), ":")).otherwise(F.get(parts, F.lit(1)))
