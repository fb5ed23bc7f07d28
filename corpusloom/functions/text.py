"""Text functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.model import PLAN_STOP, RECOMMEND_STOP


def tokens(text: Column, stop: tuple[str, ...] = PLAN_STOP) -> Column:
    """Distinct lower-case alphanumeric words of over two characters that aren't stop words."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]{3,}"), F.lit(0))
    return F.filter(F.array_distinct(words), lambda w: ~w.isin(*stop))


def plan_tokens(text: Column) -> Column:
    return tokens(text, PLAN_STOP)


def recommend_tokens(text: Column) -> Column:
    return tokens(text, RECOMMEND_STOP)


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all items of two sets; 0 where both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b))), F.lit(0.0))


def slug(text: Column, most: int = 30) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, most)


def truncate(text: Column, most: int = 80) -> Column:
    """At most ``most`` characters, the last an ellipsis where text was cut."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def normalise_description(text: Column) -> Column:
    """Without the file and line that a description names."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, " in [\\w./-]+\\.\\w+", ""), " at line \\d+", ""), "\\s+", " "))


def mask_key(key: Column) -> Column:
    """First and last four characters of a key; all stars where it has ten or fewer."""
    return F.when(F.length(key) <= 10, F.repeat(F.lit("*"), F.length(key))).otherwise(F.concat(F.substring(key, 1, 4), F.lit("****"), F.substring(key, -4, 4)))


#: Forms of secrets in text.
SECRETS = (r"sk-[A-Za-z0-9_-]{8,}", r"(?i)bearer\s+[A-Za-z0-9._-]{8,}", r"""(?i)(?:token|api[_-]?key|secret|password)\s*[=:]\s*["']?[A-Za-z0-9_+/=-]{8,}["']?""")


def mask_secrets(text: Column) -> Column:
    for form in SECRETS:
        text = F.regexp_replace(text, form, "[masked]")
    return text


def leading_comment(content: Column, lines: int = 20, kept: int = 3, most: int = 200) -> Column:
    """First lines of a file that aren't blank, without comment marks; empty without content."""
    head = F.slice(F.split(F.coalesce(content, F.lit("")), "\n"), 1, lines)
    bare = F.filter(F.transform(head, lambda x: F.trim(F.regexp_replace(F.trim(x), r"^(//+|/\*+|\*+/?|#)\s?", ""))), lambda x: x != "")
    return F.substring(F.array_join(F.slice(bare, 1, kept), " "), 1, most)


def line_range(content: Column, first: Column, last: Column, most: int = 1200) -> Column:
    """Lines from ``first`` to ``last`` (from 1, inclusive), at most ``most`` characters."""
    return F.substring(F.array_join(F.slice(F.split(content, "\n"), first, F.greatest(F.lit(0), last - first + 1)), "\n"), 1, most)


def strip_tags(html: Column) -> Column:
    """Text without tags, with the common entities decoded."""
    return F.trim(decode_entities(F.regexp_replace(html, "<[^>]+>", "")))


def decode_entities(text: Column) -> Column:
    for entity, char in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&#x27;", "'"), ("&#39;", "'"), ("&nbsp;", " ")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


#: Keywords that name a fault pattern, in order.
FAULT_WORDS = ("null", "undefined", "unused", "memory leak", "error handling", "type safety")


def fault_key(description: Column) -> Column:
    """The first keyword that a description holds, with hyphens; else its first three words."""
    low = F.lower(description)
    out = F.array_join(F.slice(F.split(low, "\\s+"), 1, 3), "-")
    for word in reversed(FAULT_WORDS):
        out = F.when(low.contains(word), word.replace(" ", "-")).otherwise(out)
    return out


def fix_label(description: Column) -> Column:
    """What kind of fix a description speaks of; itself where no rule fits."""
    low = F.lower(description)
    has = lambda *ws: F.lit(False) if not ws else _any(low, ws)
    return (
        F.when(has("optional chaining", "?.", "null"), "null safety").when(has("logger", "console.log"), "structured logger")
        .when(has("catch", "error handling"), "try/catch").when(has("unused", "dead code"), "remove unused").otherwise(description)
    )


def _any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


#: Architecture layers by keyword, in order, and tags by keyword.
LAYERS = (("api", ("api", "route", "endpoint"), 0.7), ("service", ("service", "business", "logic"), 0.7), ("data", ("db", "database", "query", "model"), 0.7), ("ui", ("ui", "component", "render", "view"), 0.7), ("utility", ("util", "helper", "lib"), 0.6))
TAGS = (("auth", ("auth",)), ("user", ("user",)), ("logging", ("log",)), ("error-handling", ("error", "exception")), ("data-access", ("db", "query")), ("ui", ("render", "component")))


def layer(name: Column) -> Column:
    """(layer, confidence) of the first layer whose keyword a name holds; unknown .5 where none does."""
    low = F.lower(name)
    of = lambda label, c: F.struct(F.lit(label).alias("layer"), F.lit(c).alias("confidence"))
    out = of("unknown", 0.5)
    for label, words, confidence in reversed(LAYERS):
        out = F.when(_any(low, words), of(label, confidence)).otherwise(out)
    return out


def tags(name: Column) -> Column:
    """Tags of a name by keyword; general where none fits."""
    low = F.lower(name)
    found = F.filter(F.array(*[F.when(_any(low, ws), F.lit(tag)) for tag, ws in TAGS]), lambda x: x.isNotNull())
    return F.when(F.size(found) == 0, F.array(F.lit("general"))).otherwise(found)


def camel_case(name: Column) -> Column:
    return name.rlike("^[a-z][a-zA-Z0-9]*$") & name.rlike("[A-Z]")


def pascal_case(name: Column) -> Column:
    return name.rlike("^[A-Z][a-zA-Z0-9]*$")
