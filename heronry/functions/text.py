"""Text functions as Column expressions: they stay in the JVM and in whole-stage codegen."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F



def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bound(c: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once: what a lambda names is otherwise computed again for each of its elements."""
    return F.get(F.transform(F.array(c), body), F.lit(0))


def words(c: Column | str) -> Column:
    """Lower case; everything but letters and digits is a space; single spaces."""
    return F.trim(F.regexp_replace(F.lower(col(c)), r"[^\p{L}\p{N}]+", " "))


def word_array(c: Column | str) -> Column:
    """The words of `words`, an empty array for null or wordless text."""
    w = words(F.coalesce(col(c), F.lit("")))
    return F.filter(F.split(w, " "), lambda x: x != "")


def has_word(text: Column, keyword: str) -> Column:
    """Whether normalised text holds the keyword: a phrase as a whole, up to three bytes as a whole word, longer ones as the beginning of a word."""
    padded = F.concat(F.lit(" "), text, F.lit(" "))
    whole = " " in keyword or len(keyword.encode()) <= 3
    return F.contains(padded, F.lit(f" {keyword} " if whole else f" {keyword}"))


def first_match(text: Column, table: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """Name of the first table entry with a keyword in the normalised text, null without one."""
    out = None
    for name, keywords in table:
        hit = F.lit(False)
        for k in keywords:
            hit = hit | has_word(text, k)
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out


def skill_words(c: Column | str) -> Column:
    """Like `words`, but + # . stay, and dots at a word's end go."""
    kept = F.trim(F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), r"[^\p{L}\p{N}+#.]+", " "))
    return F.trim(F.regexp_replace(F.regexp_replace(kept, r"\.+( |$)", " "), " +", " "))


def fold(c: Column | str) -> Column:
    """Trimmed, lower case, single spaces; accents stay."""
    return F.lower(F.trim(F.regexp_replace(col(c), r"\s+", " ")))


def simplify(c: Column | str) -> Column:
    """Letters and digits only, lower case: for comparing names."""
    return F.lower(F.regexp_replace(col(c), r"[^\p{L}\p{N}]", ""))


def clean(c: Column | str) -> Column:
    """Trimmed; nothing left is null."""
    return F.nullif(F.trim(col(c)), F.lit(""))


def truncate(c: Column | str, n: int) -> Column:
    """The first n characters."""
    return F.substring(col(c), 1, n)


def title_case(c: Column | str) -> Column:
    """First letter of each space-separated word in upper case, the rest as it is."""
    return F.array_join(F.transform(F.split(col(c), " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1_000_000))), " ")


def match_rank(name: Column | str, query: Column | str) -> Column:
    """0 equal, 1 begins with the query, 2 a later word begins with it, else null; both folded."""
    n, q = col(name), col(query)
    return F.when(n == q, 0).when(F.startswith(n, q), 1).when(F.contains(n, F.concat(F.lit(" "), q)), 2)


def one_of(c: Column | str, allowed: Sequence[str]) -> Column:
    """The closed list's spelling of a value; null for others."""
    v = F.translate(F.lower(F.trim(col(c))), " -", "__")
    return F.when(v.isin(*allowed), v)


def employment_type(c: Column | str) -> Column:
    """Canonical employment type; unknown ones in lower case with underscores, null for empty."""
    key = F.lower(F.regexp_replace(col(c), "[^a-zA-Z0-9]", ""))
    canon = F.when(key.isin("fulltime", "permanent"), "full_time").when(key == "parttime", "part_time").when(key.isin("contract", "contractor", "freelance"), "contract")
    canon = canon.when(key.isin("intern", "internship"), "internship").when(key.isin("temporary", "temp", "fixedterm"), "temporary").when(key == "volunteer", "volunteer")
    return F.when(key == "", None).otherwise(F.coalesce(canon, F.translate(F.lower(F.trim(col(c))), " -", "__")))


def remote_mode(c: Column | str) -> Column:
    """remote, hybrid or onsite as a source says it; null for others."""
    key = simplify(c)
    return F.when(key.isin("remote", "telecommute", "fullyremote"), "remote").when(key == "hybrid", "hybrid").when(key.isin("onsite", "inoffice", "office", "inperson"), "onsite")


def salary_period(c: Column | str) -> Column:
    """The first of these that the text contains: year, annual, month, week, day, hour."""
    t, out = F.lower(col(c)), None
    for needle, name in (("year", "year"), ("annual", "year"), ("month", "month"), ("week", "week"), ("day", "day"), ("hour", "hour")):
        hit = F.contains(t, F.lit(needle))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def content_hash(c: Column | str) -> Column:
    """32 hexadecimal digits that are equal for equal content."""
    return F.substring(F.sha2(col(c), 256), 1, 32)


def contains_any(columns: Sequence[Column | str], text: str) -> Column:
    """Whether any column holds the text literally, case ignored; null columns don't."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.contains(F.lower(F.coalesce(col(c), F.lit(""))), F.lit(text.lower()))
    return hit


def json_list(c: Column | str) -> Column:
    """A JSON array of strings as an array; bad JSON and null are empty."""
    return F.coalesce(F.from_json(col(c), "array<string>"), F.array().cast("array<string>"))


def dedupe_ci(c: Column | str, cap: int) -> Column:
    """Trimmed strings without empty and repeated ones (case ignored, the first stays), `cap` at most."""
    trimmed = F.filter(F.transform(col(c), lambda x: F.trim(x)), lambda x: x != "")
    start = F.array().cast("array<string>")
    kept = F.aggregate(trimmed, start, lambda a, x: F.when(F.exists(a, lambda y: F.lower(y) == F.lower(x)), a).otherwise(F.array_append(a, x)))
    return F.slice(kept, 1, cap)


#: Words of a question that are no keywords.
STOPWORDS = frozenset((
    "a", "am", "an", "and", "any", "are", "around", "as", "at", "be", "find", "for", "from", "get", "give", "good", "i", "in", "is", "it", "job", "jobs", "like", "looking", "me", "my", "near", "nice", "of", "on", "or", "paid", "paying", "please", "role", "roles", "show", "some", "the", "to", "top", "want", "well", "with", "work", "would",
))


def keyword_fallback(text: str, most: int = 8) -> list[str]:
    """Keywords of a free question, when nothing better reads it: words of at least two bytes without stop words, each once."""
    cur, out = "", []
    for ch in text.lower() + " ":
        if ch.isalnum() or ch in "+#":
            cur += ch
            continue
        if len(cur.encode()) >= 2 and cur not in STOPWORDS and cur not in out:
            out.append(cur)
        cur = ""
    return out[:most]


def parse_json_reply(reply: str) -> dict | list | None:
    """JSON in a model's reply: as it is, within a fence, or between the first brace and the last."""
    import json

    body = reply.strip()
    if body.startswith("```"):
        body = body.split("\n", 1)[-1].rsplit("```", 1)[0]
    tries = [body]
    if "{" in reply and "}" in reply:
        tries.append(reply[reply.index("{") : reply.rindex("}") + 1])
    for t in tries:
        try:
            return json.loads(t)
        except ValueError:
            continue
    return None
