"""Category, seniority, skills and remote openings of a posting as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from heronry.functions.text import bound, col, first_match, has_word, skill_words, words

#: Categories and their words; the first that fits counts.
CATEGORIES = (
    ("security", ("security", "infosec", "appsec", "cybersecurity", "pentest")),
    ("data", ("data", "machine learning", "ml", "analytics", "analyst", "scientist", "bi", "ai")),
    ("design", ("design", "ux", "ui", "creative", "illustrat", "animator")),
    ("product", ("product manager", "product owner", "product", "head of product")),
    ("it", ("it", "sysadmin", "system administrator", "network administrator", "helpdesk")),
    ("customer_support", ("customer success", "customer support", "customer service", "customer experience", "support", "care")),
    ("engineering", ("engineer", "developer", "software", "devops", "sre", "programmer", "architect", "backend", "frontend", "fullstack", "full stack", "firmware", "embedded", "qa", "sdet", "platform", "technical lead", "cto")),
    ("sales", ("sales", "account executive", "account manager", "business development", "bdr", "sdr", "partnerships", "revenue")),
    ("marketing", ("marketing", "growth", "seo", "content", "brand", "communications", "social media", "copywriter", "pr")),
    ("finance", ("finance", "financial", "accountant", "accounting", "controller", "payroll", "audit", "treasury", "bookkeeper", "fp a")),
    ("hr", ("recruiter", "recruiting", "talent", "people operations", "human resources", "hr", "people partner")),
    ("legal", ("legal", "counsel", "attorney", "compliance", "paralegal")),
    ("operations", ("operations", "logistics", "supply chain", "program manager", "project manager", "office manager", "administrat", "coordinator", "procurement", "facilities")),
)
#: Levels and their words; the first that fits counts.
SENIORITIES = (
    ("executive", ("chief", "ceo", "cto", "cfo", "coo", "cmo", "vp", "vice president", "president")),
    ("director", ("director", "head of")),
    ("lead", ("lead", "staff", "principal", "architect")),
    ("senior", ("senior", "sr")),
    ("manager", ("manager",)),
    ("junior", ("junior", "jr", "entry level", "graduate", "new grad")),
    ("intern", ("intern", "internship", "trainee", "apprentice", "working student")),
)
#: Skills and the words that stand for them, where these aren't the skill's own name.
SKILLS = {
    "rust": ("rust",), "go": ("golang",), "python": ("python",), "java": ("java",), "javascript": ("javascript",), "typescript": ("typescript",), "react": ("react", "reactjs"), "vue": ("vue", "vuejs"), "angular": ("angular",), "node.js": ("nodejs", "node.js"),
    "django": ("django",), "rails": ("rails", "ruby on rails"), "ruby": ("ruby",), "php": ("php",), "laravel": ("laravel",), "c++": ("c++",), "c#": ("c#",), ".net": (".net", "dotnet"), "swift": ("swift", "swiftui"), "kotlin": ("kotlin",), "android": ("android",),
    "ios": ("ios",), "flutter": ("flutter",), "sql": ("sql",), "postgresql": ("postgres", "postgresql"), "mysql": ("mysql",), "mongodb": ("mongodb",), "redis": ("redis",), "kafka": ("kafka",), "spark": ("spark",), "airflow": ("airflow",), "dbt": ("dbt",),
    "snowflake": ("snowflake",), "aws": ("aws",), "gcp": ("gcp", "google cloud"), "azure": ("azure",), "kubernetes": ("kubernetes", "k8s"), "docker": ("docker",), "terraform": ("terraform",), "linux": ("linux",), "graphql": ("graphql",),
    "machine learning": ("machine learning",), "pytorch": ("pytorch",), "tensorflow": ("tensorflow",), "llm": ("llm", "llms"), "figma": ("figma",), "salesforce": ("salesforce",), "hubspot": ("hubspot",), "excel": ("excel",), "tableau": ("tableau",),
    "power bi": ("power bi", "powerbi"), "seo": ("seo",),
}
#: Regions of remote openings as written and as stored.
REGIONS = (("emea", "EMEA"), ("apac", "APAC"), ("latam", "LATAM"), ("europe", "Europe"), ("north america", "North America"), ("americas", "Americas"), ("africa", "Africa"), ("asia", "Asia"), ("worldwide", "global"), ("anywhere", "global"), ("global", "global"))
MOST_SKILLS, SCAN_CHARS = 12, 6000


def category(title: Column | str, department: Column | str) -> Column:
    """From the title, else the department; null where neither tells."""
    e = F.lit("")
    return F.coalesce(first_match(words(F.coalesce(col(title), e)), CATEGORIES), first_match(words(F.coalesce(col(department), e)), CATEGORIES))


def seniority(title: Column | str) -> Column:
    return first_match(words(F.coalesce(col(title), F.lit(""))), SENIORITIES)


def _among(listed: list[str]):
    return lambda x: x.isin(*listed)


def skill_counts(text: Column) -> Column:
    """Array of structs name, count in table order: mentions of each skill that occurs.

    Single words are looked up in the token array, phrases are counted by removing them from the padded text; only skills that occur are
    counted, and the text is cleaned and split once.
    """
    order = {name: k for k, name in enumerate(SKILLS)}
    single = {s: order[name] for name, signs in SKILLS.items() for s in signs if " " not in s}
    places, names = F.create_map(*[F.lit(x) for kv in single.items() for x in kv]), F.array(*map(F.lit, SKILLS))

    def mentions(t: Column) -> Column:
        padded = F.concat(F.lit(" "), t, F.lit(" "))
        times = lambda s: ((F.length(padded) - F.length(F.replace(padded, F.lit(f" {s} "), F.lit("")))) / (len(s) + 2)).cast("int")
        phrases = [F.when(F.contains(padded, F.lit(f" {s} ")), F.array_repeat(F.lit(order[name]), times(s))).otherwise(F.array().cast("array<int>")) for name, signs in SKILLS.items() for s in signs if " " in s]
        return F.concat(F.transform(F.filter(F.split(t, " "), _among(list(single))), lambda x: F.try_element_at(places, x)), *phrases)

    counted = lambda m: F.transform(F.sort_array(F.array_distinct(m)), lambda k: F.struct(F.element_at(names, k + 1).alias("name"), F.size(F.filter(m, lambda x: x == k)).alias("count")))
    return bound(skill_words(text), lambda t: bound(mentions(t), counted))


def top_skills(text: Column, most: int = MOST_SKILLS) -> Column:
    """The most mentioned skills of a text, equal ones in table order."""
    ranked = F.array_sort(F.transform(skill_counts(text), lambda x, i: F.struct((-x["count"]).alias("n"), i.alias("i"), x["name"].alias("name"))))
    return F.transform(F.slice(ranked, 1, most), lambda x: x["name"])


def skills(title: Column | str, description: Column | str) -> Column:
    """The first twelve known skills in table order, from the title and the beginning of the description.

    Tokens are looked up in a small map, so the text is split once and the plan stays small.
    """
    text = skill_words(F.concat_ws(" ", F.coalesce(col(title), F.lit("")), F.substring(F.coalesce(col(description), F.lit("")), 1, SCAN_CHARS)))
    order = {s: k for k, s in enumerate(SKILLS)}
    single = F.create_map(*[F.lit(x) for name, signs in SKILLS.items() for s in signs if " " not in s for x in (s, order[name])])
    # an intersection hashes the list once; what is left to look up are a few words
    named = F.array_intersect(F.split(text, " "), F.array(*[F.lit(s) for signs in SKILLS.values() for s in signs if " " not in s]))
    hits = F.transform(named, lambda x: F.try_element_at(single, x))
    padded = F.concat(F.lit(" "), text, F.lit(" "))
    phrases = F.array_compact(F.array(*[F.when(F.contains(padded, F.lit(f" {s} ")), F.lit(order[name])) for name, signs in SKILLS.items() for s in signs if " " in s]))
    names = F.array(*[F.lit(s) for s in SKILLS])
    ranked = F.slice(F.array_sort(F.array_distinct(F.concat(hits, phrases))), 1, MOST_SKILLS)
    return F.transform(ranked, lambda k: F.element_at(names, k + 1))


def remote_mode_of(location: Column | str) -> Column:
    """hybrid or remote as a location says it, else null."""
    w = words(F.coalesce(col(location), F.lit("")))
    return F.when(has_word(w, "hybrid"), "hybrid").when(has_word(w, "remote") | has_word(w, "anywhere") | has_word(w, "worldwide"), "remote")


def remote_region(value: Column | str) -> Column:
    """A region as stored: a named one, or a country code in upper case; null for others."""
    v = F.lower(F.trim(col(value)))
    out = None
    for w, name in REGIONS:
        out = F.when(v == w, name) if out is None else out.when(v == w, name)
    return out.when(v.rlike("^[a-z]{2}$"), F.upper(v))


def remote_regions(location: Column | str, country: Column | str) -> Column:
    """Regions a remote posting is open to: those its location names, in table order, then the country."""
    w = words(F.coalesce(col(location), F.lit("")))
    named = F.array_compact(F.array(*[F.when(has_word(w, k), F.lit(v)) for k, v in REGIONS]))
    return F.array_distinct(F.concat(named, F.when(col(country).isNotNull(), F.array(col(country))).otherwise(F.array().cast("array<string>"))))


def needs_model(location: Column | str, category_: Column | str, country: Column | str) -> Column:
    """Whether rules left a gap: no category, or a place that wasn't found. A comma counts as a place even in a remote location."""
    loc = F.coalesce(col(location), F.lit(""))
    has_place = ((F.trim(loc) != "") & remote_mode_of(loc).isNull()) | F.contains(loc, F.lit(","))
    return col(category_).isNull() | (has_place & col(country).isNull())
