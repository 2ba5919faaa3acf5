"""Answers of a language model as tables: cleaned, and merged into what rules found. Rules win, and coordinates come only from the gazetteer."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heronry.functions.enrich import CATEGORIES, SENIORITIES, remote_region
from heronry.functions.text import one_of

CONFIDENT = 0.7
LEVELS = ("intern", "junior", "mid", "senior", "lead", "manager", "director", "executive")
MODES = ("onsite", "hybrid", "remote")
KNOWN = tuple(c for c, _ in CATEGORIES) + ("other",)


def _capped(c: Column, n: int) -> Column:
    return F.nullif(F.substring(F.trim(c), 1, n), F.lit(""))


def country(c: Column) -> Column:
    v = F.upper(F.trim(c))
    return F.when(v.rlike("^[A-Z]{2}$"), v)


def verdicts(answers: DataFrame) -> DataFrame:
    """Verdicts on domains within their limits: texts trimmed and cut, a two-letter country, a confidence in [0, 1] (0 for NaN and null)."""
    conf = F.col("confidence").cast("double")
    sure = F.when(conf.isNull() | F.isnan(conf), 0.0).otherwise(F.least(F.greatest(conf, F.lit(0.0)), F.lit(1.0)))
    return answers.select(
        "domain_id", "is_company", _capped(F.col("company_name"), 120).alias("company_name"), F.lower(_capped(F.col("industry"), 40)).alias("industry"), country(F.col("hq_country")).alias("hq_country"), sure.alias("confidence"), F.substring(F.trim("reason"), 1, 300).alias("reason"),
    )


def apply_verdicts(domains: DataFrame, answers: DataFrame) -> DataFrame:
    """Domains after their verdicts: a confident one settles a probing domain; industry and country are kept in any case, a name only where there was none."""
    v = verdicts(answers).dropDuplicates(["domain_id"]).select(F.col("domain_id").alias("id"), "is_company", F.col("company_name").alias("v_name"), F.col("industry").alias("v_industry"), F.col("hq_country").alias("v_country"), "confidence")
    j = domains.join(v, "id", "left")
    settled = (F.col("status") == "probing") & (F.col("confidence") >= CONFIDENT)
    status = F.when(F.coalesce(settled, F.lit(False)), F.when(F.col("is_company"), "company").otherwise("not_company")).otherwise(F.col("status"))
    return j.withColumns({"status": status, "name": F.coalesce("name", "v_name"), "industry": F.coalesce("v_industry", "industry"), "hq_country": F.coalesce("v_country", "hq_country")}).select(*domains.columns)


def merge_enrichment(found: DataFrame, answers: DataFrame, most_skills: int = 12) -> DataFrame:
    """Rule results (id, category, seniority, skills, remote_mode, remote_regions, city, country_code) with the gaps filled from answers."""
    a = answers.dropDuplicates(["id"]).select("id", *[F.col(c).alias(f"a_{c}") for c in ("category", "seniority", "skills", "remote_mode", "remote_regions", "city", "country_code")])
    j = found.join(a, "id", "left")
    none = F.array().cast("array<string>")
    more = F.filter(F.transform(F.coalesce("a_skills", none), lambda s: F.lower(F.trim(s))), lambda s: (s != "") & (F.octet_length(s) <= 40))
    have = F.coalesce("skills", none)
    skills = F.when(F.size(have) >= most_skills, have).otherwise(F.slice(F.array_distinct(F.concat(have, more)), 1, most_skills))
    mode = F.coalesce("remote_mode", one_of("a_remote_mode", MODES))
    unplaced = F.col("country_code").isNull() & F.col("city").isNull()
    regions = F.when(mode.isin("remote", "hybrid"), F.array_distinct(F.concat(F.coalesce("remote_regions", none), F.filter(F.transform(F.coalesce("a_remote_regions", none), remote_region), lambda r: r.isNotNull())))).otherwise(F.coalesce("remote_regions", none))
    return j.select(
        "id", F.coalesce("category", one_of("a_category", KNOWN)).alias("category"), F.coalesce("seniority", one_of("a_seniority", LEVELS)).alias("seniority"), skills.alias("skills"), mode.alias("remote_mode"), regions.alias("remote_regions"),
        F.when(unplaced, _capped(F.col("a_city"), 80)).otherwise(F.col("city")).alias("city"), F.when(unplaced, country(F.col("a_country_code"))).otherwise(F.col("country_code")).alias("country_code"),
    )


def _listed(items: object, cut: int, most: int = 30) -> list[str]:
    out: list[str] = []
    for x in items if isinstance(items, list) else []:
        t = x.strip()[:cut] if isinstance(x, str) else ""
        if t and t.lower() not in map(str.lower, out) and len(out) < most:
            out.append(t)
    return out


def _choice(v: object, allowed: tuple[str, ...]) -> str | None:
    k = v.strip().lower().replace(" ", "_").replace("-", "_") if isinstance(v, str) else None
    return k if k in allowed else None


def profile_of(answer: dict, fallback: dict) -> dict:
    """A model's reading of a CV within its limits, with gaps filled from what rules read."""
    skills: dict[str, float] = {}
    for s in answer.get("skills") or []:
        name = str(s.get("name", "")).strip().lower()
        w = s.get("weight")
        if name and len(name.encode()) <= 40 and name not in skills and len(skills) < 30:
            skills[name] = min(max(float(w) if isinstance(w, (int, float)) and math.isfinite(w) else 0.5, 0.1), 1.0)
    years = answer.get("years_experience")
    fits = isinstance(years, (int, float)) and math.isfinite(years) and 0 <= years <= 60
    return {
        "titles": _listed(answer.get("titles"), 80) or fallback.get("titles", []), "seniority": _choice(answer.get("seniority"), LEVELS) or fallback.get("seniority"), "skills": skills or fallback.get("skills", {}), "years": float(years) if fits else fallback.get("years"),
        "industries": [i.lower() for i in _listed(answer.get("industries"), 40)] or fallback.get("industries", []), "languages": _listed(answer.get("languages"), 30), "remote": _choice(answer.get("remote"), MODES) or fallback.get("remote"),
    }


_LISTS = ("titles", "industries", "languages", "must_have", "exclude", "excluded_companies", "locations")
_NUMBERS = ("years_experience", "salary_expectation_usd")


def patched(current: dict, patch: dict) -> dict:
    """Overrides after an edit: a value replaces a field's override, None removes it; unknown fields and wrong shapes are errors."""
    out = dict(current)
    for k, v in patch.items():
        if k not in (*_LISTS, *_NUMBERS, "skills", "seniority", "remote", "relocate"):
            raise ValueError(f'unknown field "{k}"')
        if v is None:
            out.pop(k, None)
        elif k in _LISTS:
            if not isinstance(v, list) or not all(isinstance(x, str) for x in v):
                raise ValueError(f'"{k}" has the wrong shape')
            out[k] = _listed(v, 80)
        elif k in _NUMBERS:
            if isinstance(v, bool) or not isinstance(v, (int, float)) or not math.isfinite(v) or v < 0:
                raise ValueError(f'"{k}" has the wrong shape')
            out[k] = float(v)
        elif k == "relocate":
            if not isinstance(v, bool):
                raise ValueError(f'"{k}" has the wrong shape')
            out[k] = v
        elif k == "skills":
            if not isinstance(v, list):
                raise ValueError(f'"{k}" has the wrong shape')
            pairs = [(x, 0.6) if isinstance(x, str) else (x.get("name", ""), x.get("weight", 0.6)) for x in v]
            out[k] = {n.strip().lower(): min(max(float(w), 0.1), 1.0) for n, w in pairs if n.strip()}
        else:
            one = _choice(v, LEVELS if k == "seniority" else MODES)
            if one is None:
                raise ValueError(f'"{k}" has an unknown value')
            out[k] = one
    return out


__all__ = ["SENIORITIES", "apply_verdicts", "merge_enrichment", "patched", "profile_of", "verdicts"]
