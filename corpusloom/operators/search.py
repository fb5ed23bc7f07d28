"""Search results: sources, pages, fallbacks, templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.model import CREDIBILITY

#: Query templates by priority.
TEMPLATES = (("error_message", "{errorMessage} {language} {framework}", 1), ("stack_trace", "{stackTraceTopFrame} {library} {version} bug", 2), ("pattern", "{framework} {pattern} best practice", 3), ("compatibility", "{library} {version} breaking change migration", 4))


def host(url: Column) -> Column:
    return F.regexp_extract(F.lower(url), "^[a-z][a-z0-9+.-]*://([^/?#:]+)", 1)


def source(url: Column) -> Column:
    """A source's short name: known sites by part of their host, else the host without www; unknown without one."""
    h = host(url)
    named = F.lit(None).cast("string")
    for part, label in reversed((("stackoverflow", "stackoverflow"), ("github", "github"), ("developer.mozilla", "mdn"), ("react.dev", "react-docs"), ("medium", "medium"))):
        named = F.when(h.contains(part), label).otherwise(named)
    return F.when(h == "", "unknown").otherwise(F.coalesce(named, F.regexp_replace(h, "^www\\.", "")))


def credibility(label: Column) -> Column:
    out = F.lit(0.60)
    for name, score in CREDIBILITY.items():
        out = F.when(label == name, score).otherwise(out)
    return out


def unwrap(url: Column) -> Column:
    """The address inside a redirect."""
    return F.when(url.contains("?uddg="), F.coalesce(F.try_url_decode(F.regexp_extract(url, "uddg=([^&]+)", 1)), url)).otherwise(url)


def parse_page(pages: DataFrame, most: int = 5) -> DataFrame:
    """pages (query, html) -> (query, position, title, url, snippet, source, score): the first relevant results.

    A page is split at the outer block of a result only, so each block keeps its snippet. The url is the one that the
    result displays, else the one that its title leads to, which also says the source; redirects are unwrapped in both.
    """
    blocks = F.split("html", r"""<div class="result(?:\s[^"]*)?\"""")
    each = pages.select("query", F.posexplode(F.slice(blocks, F.lit(2), F.size(blocks))).alias("position", "b"))
    title = T.strip_tags(F.regexp_extract("b", r"""(?is)<a[^>]*class="result__a"[^>]*>(.*?)</a>""", 1))
    href = unwrap(T.decode_entities(F.regexp_extract("b", r"""(?is)<a[^>]*class="result__a"[^>]*href="([^"]*)\"""", 1)))
    shown = unwrap(T.decode_entities(F.regexp_extract("b", r"""(?is)<a[^>]*class="result__url"[^>]*href="([^"]*)\"""", 1)))
    snippet = T.strip_tags(F.regexp_extract("b", r"""(?is)<(?:div|a)[^>]*class="result__snippet"[^>]*>(.*?)</(?:div|a)>""", 1))
    rows = each.select("query", "position", title.alias("title"), F.when(shown != "", shown).otherwise(href).alias("url"), snippet.alias("snippet"), source(href).alias("source")).where("title <> ''")
    rows = rows.where(relevant(F.col("query"), F.col("title"), F.col("snippet")))
    rows = rows.withColumn("snippet", F.when(F.col("snippet") == "", F.col("title")).otherwise(F.col("snippet"))).withColumn("score", credibility(F.col("source")))
    return rows.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy("position"))).where(F.col("r") <= most).drop("r")


def relevant(query: Column, title: Column, snippet: Column) -> Column:
    """Whether a result holds a word of the query (over two letters) or names one of two sites."""
    text = F.lower(F.concat_ws(" ", title, snippet))
    words = F.filter(F.split(F.lower(query), "\\s+"), lambda w: F.length(w) > 2)
    return F.exists(words, lambda w: text.contains(w)) | text.contains("stackoverflow") | text.contains("github")


def first_provider(results: DataFrame) -> DataFrame:
    """results (query, priority, ...) -> those of the least priority that has any for the query."""
    best = results.groupBy("query").agg(F.min("priority").alias("priority"))
    return results.join(best, ["query", "priority"], "left_semi")


def supporting(results: DataFrame, least: float = 0.5, most: int = 2) -> DataFrame:
    """results (query, position, snippet, score) -> the first ``most`` of each query, in page order, that score over ``least``."""
    ranked = results.where(F.col("score") > least).withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy("position")))
    return ranked.where(F.col("r") <= most).drop("r")


def by_credibility(results: DataFrame, most: int = 5) -> DataFrame:
    """results (query, position, score) -> the ``most`` most credible of each query with their rank; ties in page order."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), "position")
    return results.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


#: Results that stand in for a search, by the words a query has to hold, any of each group: title, url,
#: snippet, source, score.
SIMULATED = (
    (
        (("map",), ("undefined",)), "TypeError: Cannot read property 'map' of undefined", "https://stackoverflow.com/questions/12345",
        "Check if the array is defined before calling .map(). Use optional chaining: arr?.map(...) or ensure initialization.", "stackoverflow", 0.92,
    ),
    (
        (("null", "undefined"),), "Handling null and undefined in JavaScript", "https://developer.mozilla.org/en-US/docs/Web/JavaScript/Reference/Operators/Optional_chaining",
        "The optional chaining operator (?.) enables you to read the value of a property located deep within a chain of connected objects.", "mdn", 0.95,
    ),
    (
        (("memory leak", "cleanup"),), "React useEffect cleanup function guide", "https://react.dev/reference/react/useEffect",
        "To prevent memory leaks, return a cleanup function from useEffect. This is especially important for subscriptions and timers.", "react-docs", 0.90,
    ),
    (
        (("async", "await", "promise"),), "JavaScript async/await error handling patterns", "https://javascript.info/async-await",
        "Always wrap await calls in try/catch blocks. Unhandled promise rejections can crash Node.js applications.", "javascript-info", 0.88,
    ),
)
#: What stands in where no result fits; the query goes between the quotes.
GENERIC = ("Search results for: ", "https://github.com/search", 'No specific match found. Try searching GitHub issues or Stack Overflow for "', "generic", 0.3)


def simulate(queries: DataFrame) -> DataFrame:
    """queries (query) -> the literal results that fit, most credible first (rank from 1); a generic one where none does."""
    q = F.lower("query")
    row = lambda *parts: F.struct(*[(x if isinstance(x, Column) else F.lit(x)).alias(n) for n, x in zip(("title", "url", "snippet", "source", "score"), parts, strict=True)])
    hits = []
    for groups, *parts in sorted(SIMULATED, key=lambda r: -r[-1]):
        on = F.lit(True)
        for words in groups:
            on = on & F.exists(F.array(*map(F.lit, words)), lambda w: q.contains(w))
        hits.append(F.when(on, row(*parts)))
    found = F.filter(F.array(*hits), lambda x: x.isNotNull())
    title, url, snippet, label, score = GENERIC
    generic = F.array(row(F.concat(F.lit(title), "query"), url, F.concat(F.lit(snippet), "query", F.lit('".')), label, score))
    rows = queries.where(F.trim("query") != "").select("query", F.posexplode(F.when(F.size(found) == 0, generic).otherwise(found)).alias("at", "x"))
    return rows.select("query", (F.col("at") + 1).alias("rank"), "x.*")


def fill(params: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """params (id, names...) -> (id, template, query): the first template by priority that has a value to fill in."""
    out = F.lit(None)
    for label, form, _ in sorted(TEMPLATES, key=lambda t: -t[2]):
        here = [n for n in names if f"{{{n}}}" in form]
        text = F.lit(form)
        for n in here:
            text = F.replace(text, F.lit(f"{{{n}}}"), F.coalesce(n, F.lit("")))
        text = F.trim(F.regexp_replace(text, "\\{\\w+\\}", ""))
        used = F.lit(False)
        for n in here:
            used = used | (F.coalesce(n, F.lit("")) != "")
        out = F.when(used & (text != ""), F.struct(F.lit(label).alias("template"), text.alias("query"))).otherwise(out)
    return params.select("id", out.alias("x")).select("id", "x.template", "x.query")


def needs_search(n: Column, confidence: Column) -> Column:
    """Whether findings are too few or too unsure to do without a search."""
    return (n > 0) & ((confidence < 0.5) | ((n <= 1) & (confidence < 0.7)))


def remote_parts(url: Column) -> list[Column]:
    """host, owner, repo of a git remote in either form."""
    form = r"^(?:[a-z+]+://(?:[^@/]+@)?|[^@/]+@)([^:/]+)[:/](.+?)/([^/]+?)(?:\.git)?/?$"
    return [F.regexp_extract(url, form, g).alias(n) for g, n in ((1, "host"), (2, "owner"), (3, "repo"))]
