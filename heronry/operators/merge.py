"""Changes to tables as new snapshots: each takes the table and the changes and gives the table as it is afterwards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: list[str], order: Sequence[Column]) -> DataFrame:
    """Of each key the row that is last in order (nulls first), as an aggregate that combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def insert_missing(current: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `new` whose key isn't there yet are added; the others change nothing."""
    return current.unionByName(new.dropDuplicates(keys).join(current.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def replace(current: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `changes` stand instead of those of the same key, or are added."""
    return current.join(changes.select(*keys), keys, "left_anti").unionByName(changes, allowMissingColumns=True)


#: Fields of which a change makes a posting be enriched anew.
WATCHED = ("title", "location", "department", "salary_min", "salary_max", "salary_currency", "salary_period")


def upsert_jobs(current: DataFrame, seen: DataFrame, now: int) -> DataFrame:
    """Postings by url after a listing was seen: refreshed, reopened, or new; a domain or board that the listing lacks stays.

    Result: the columns of `seen` that `current` has, first_seen, last_seen, closed_at, is_new, and unchanged (whether what
    was derived from the posting holds). Postings that weren't seen stay as they are, with both flags false. Where `current` has them, country_code and remote_mode of an unchanged posting stay if the listing has
    none, and enrich_state and enrich_attempts of a changed one start again.
    """
    fields = [c for c in seen.columns if c in current.columns and c not in ("url", "id", "first_seen", "last_seen", "closed_at")]
    c, n = current.alias("c"), seen.dropDuplicates(["url"]).alias("n")
    both = c.join(n.withColumn("__seen", F.lit(True)), "url", "full")
    hit = F.coalesce(F.col("__seen"), F.lit(False))
    out = {}
    for f in fields:
        fresh = F.coalesce(F.col(f"n.{f}"), F.col(f"c.{f}")) if f in ("domain_id", "board_key") else F.col(f"n.{f}")
        out[f] = F.when(hit, fresh).otherwise(F.col(f"c.{f}"))
    same = F.lit(True)
    for f in WATCHED:
        if f in fields:
            same = same & F.col(f"n.{f}").eqNullSafe(F.col(f"c.{f}"))
    was = F.col("c.first_seen")
    for f in ("country_code", "remote_mode"):
        if f in fields:
            out[f] = F.when(~hit, F.col(f"c.{f}")).otherwise(F.coalesce(F.col(f"n.{f}"), F.when(same, F.col(f"c.{f}"))))
    for f, start in (("enrich_state", "pending"), ("enrich_attempts", 0)):
        if f in current.columns and f not in fields:
            kept = ~hit | (was.isNotNull() & same)
            out[f] = F.when(kept, F.col(f"c.{f}")).otherwise(F.lit(start))
    return both.select(
        "url", *[v.alias(k) for k, v in out.items()], F.coalesce(was, F.lit(now)).alias("first_seen"), F.when(hit, F.lit(now)).otherwise(F.col("c.last_seen")).alias("last_seen"),
        F.when(~hit, F.col("c.closed_at")).alias("closed_at"), (hit & was.isNull()).alias("is_new"), (hit & was.isNotNull() & same).alias("unchanged"),
    )


#: What enrichment writes of a posting.
ENRICHED = ("category", "seniority", "skills", "city", "region", "country_code", "lat", "lon", "remote_mode", "remote_regions", "salary_annual_min", "salary_annual_max", "salary_usd_annual")


def write_enrichment(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """`jobs` after enrichment (id, the fields ENRICHED, state, counts): all fields and the state are replaced, also by nulls; an attempt that counts raises enrich_attempts."""
    r = results.dropDuplicates(["id"]).select("id", F.struct(*ENRICHED, "state", "counts").alias("__r"))
    j = jobs.join(r, "id", "left")
    hit = F.col("__r").isNotNull()
    new = {f: F.when(hit, F.col(f"__r.{f}")).otherwise(F.col(f)) for f in ENRICHED} | {"enrich_state": F.coalesce("__r.state", "enrich_state"), "enrich_attempts": F.col("enrich_attempts") + F.coalesce(F.col("__r.counts").cast("int"), F.lit(0))}
    return j.withColumns(new).select(*jobs.columns)


def close_missing(current: DataFrame, listing: DataFrame, board_key: str, now: int) -> DataFrame:
    """Open postings of a board whose url isn't in its listing are closed."""
    there = listing.select("url").distinct().withColumn("__there", F.lit(True))
    gone = (F.col("board_key") == board_key) & F.col("closed_at").isNull() & F.col("__there").isNull()
    return current.join(there, "url", "left").withColumn("closed_at", F.when(F.coalesce(gone, F.lit(False)), F.lit(now)).otherwise(F.col("closed_at"))).drop("__there")


def enqueue(frontier: DataFrame, new: DataFrame) -> DataFrame:
    """New urls are queued; of known ones that still wait the score is raised, nothing else changes."""
    best = new.groupBy("url").agg(F.max_by(F.struct(*[c for c in new.columns if c != "url"]), "score").alias("b"))
    known = frontier.join(best, "url", "left")
    up = F.coalesce((F.col("state") == "queued") & (F.col("b.score") > F.col("score")), F.lit(False))
    kept = known.withColumn("score", F.when(up, F.col("b.score")).otherwise(F.col("score"))).select(*frontier.columns)
    fresh = best.join(frontier.select("url"), "url", "left_anti").select("url", "b.*").withColumn("state", F.lit("queued"))
    return kept.unionByName(fresh, allowMissingColumns=True)


def retry(frontier: DataFrame, failed: DataFrame, most: int = 2) -> DataFrame:
    """Failed urls are queued again at half the score, or skipped after `most` attempts in all."""
    f = failed.select("url").distinct().withColumn("__f", F.lit(True))
    j = frontier.join(f, "url", "left")
    hit = F.col("__f").isNotNull()
    n = F.col("attempts") + 1
    return j.select(
        *[c for c in frontier.columns if c not in ("score", "attempts", "state")],
        F.when(hit & (n < most), F.col("score") / 2).otherwise(F.col("score")).alias("score"),
        F.when(hit, n).otherwise(F.col("attempts")).alias("attempts"),
        F.when(hit, F.when(n < most, "queued").otherwise("skipped")).otherwise(F.col("state")).alias("state"),
    )


def set_state(frontier: DataFrame, changes: DataFrame) -> DataFrame:
    """Urls of `changes` (url, state) are in its state; of several for a url the last by name counts."""
    c = changes.groupBy("url").agg(F.max("state").alias("__s"))
    return frontier.join(c, "url", "left").withColumn("state", F.coalesce("__s", "state")).select(*frontier.columns)


def mark_visited(frontier: DataFrame, visited: DataFrame, now: int) -> DataFrame:
    """Urls that a redirect led to (url, host, domain, depth) are done: known ones change their state only, others are added with score 0."""
    done = set_state(frontier, visited.select("url", F.lit("done").alias("state")))
    new = visited.select("url", "host", "domain", "depth").withColumns({"score": F.lit(0.0), "reason": F.lit("redirect"), "state": F.lit("done"), "enqueued_at": F.lit(now)})
    return insert_missing(done, new, ["url"])


def backfill_hosts(frontier: DataFrame) -> DataFrame:
    """Host and domain of urls that have no host yet; an empty host for what is no URL."""
    from heronry.functions.urls import host_key, registrable_domain

    bare = F.col("host").isNull()
    return frontier.withColumns({"domain": F.when(bare, registrable_domain("url")).otherwise(F.col("domain")), "host": F.when(bare, F.coalesce(host_key("url"), F.lit(""))).otherwise(F.col("host"))})


def reset_in_flight(frontier: DataFrame) -> DataFrame:
    return frontier.withColumn("state", F.when(F.col("state") == "in_flight", "queued").otherwise(F.col("state")))


def revive_deferred(frontier: DataFrame, domain_id: int) -> DataFrame:
    mine = (F.col("domain_id") == domain_id) & (F.col("state") == "deferred")
    return frontier.withColumn("state", F.when(F.coalesce(mine, F.lit(False)), "queued").otherwise(F.col("state")))


def adjust_domain_scores(frontier: DataFrame, domain_id: int, by: float) -> DataFrame:
    mine = (F.col("domain_id") == domain_id) & F.col("state").isin("queued", "deferred")
    return frontier.withColumn("score", F.when(F.coalesce(mine, F.lit(False)), F.col("score") + by).otherwise(F.col("score")))


def replace_boost(frontier: DataFrame, boosts: DataFrame) -> DataFrame:
    """Waiting urls' scores with the old profile's boost taken off and the new one added."""
    b = boosts.select("url", F.col("boost").alias("__b"))
    j = frontier.join(b, "url", "left")
    hit = F.col("__b").isNotNull() & F.col("state").isin("queued", "deferred")
    return j.withColumn("score", F.when(hit, F.col("score") - F.col("profile_boost") + F.col("__b")).otherwise(F.col("score"))).withColumn("profile_boost", F.when(hit, F.col("__b")).otherwise(F.col("profile_boost"))).drop("__b")


def _set(df: DataFrame, hit: Column, values: dict[str, Column]) -> DataFrame:
    """`df` with new values where `hit` is true; null counts as false."""
    return df.withColumns({k: F.when(F.coalesce(hit, F.lit(False)), v).otherwise(F.col(k)) for k, v in values.items() if k in df.columns})


def activate(profiles: DataFrame, profile_id: int | None, now: int | None = None) -> DataFrame:
    """One profile is active, or none. With a time, the one that is has it as updated_at, so that its ranking is stale."""
    mine = F.col("id").eqNullSafe(F.lit(profile_id))
    p = profiles.withColumn("active", mine)
    return p if now is None else _set(p, mine, {"updated_at": F.lit(now)})


def insert_profile(profiles: DataFrame, new: DataFrame, now: int) -> DataFrame:
    """`profiles` with the one row of `new`, which is the active one then."""
    rest = profiles.withColumn("active", F.lit(False))
    return rest.unionByName(new.withColumns({"active": F.lit(True), "created_at": F.lit(now), "updated_at": F.lit(now)}), allowMissingColumns=True)


def rename_profile(profiles: DataFrame, profile_id: int, name: str) -> DataFrame:
    """A name doesn't affect ranking, so updated_at stays."""
    return _set(profiles, F.col("id") == profile_id, {"name": F.lit(name)})


def override_profile(profiles: DataFrame, profile_id: int, overrides: str | None, now: int) -> DataFrame:
    return _set(profiles, F.col("id") == profile_id, {"overrides": F.lit(overrides), "updated_at": F.lit(now)})


def mark_matched(profiles: DataFrame, profile_id: int, updated_at: int) -> DataFrame:
    """Matches are those of the profile as it was at `updated_at`."""
    return _set(profiles, F.col("id") == profile_id, {"matched_at": F.lit(updated_at)})


def stale_profiles(profiles: DataFrame) -> DataFrame:
    """Profiles whose matches are of an older version, or missing."""
    return profiles.where("matched_at is null or matched_at < updated_at")


def delete_cascade(profiles: DataFrame, matches: DataFrame, profile_id: int) -> tuple[DataFrame, DataFrame]:
    return profiles.where(F.col("id") != profile_id), matches.where(F.col("profile_id") != profile_id)


#: Scores from which a domain is a company, and under which it's none.
COMPANY, NO_COMPANY = 0.6, 0.3


def fold_domains(pages: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """(domain_id, best_score, status, reasons, home_seen) from page assessments (domain_id, id, score, parked, conclusive, home, reasons), taken in order of id.

    `before`: (domain_id, status, company_score, home_seen) as stored; only domains with pages come out. The best score ever counts. A company stays one; a domain becomes one with the first page from
    which on its best score is at least COMPANY and that isn't parked itself. Else its last page decides: not_company if parked, or if under NO_COMPANY once a
    conclusive home page was seen; else probing. Reasons are the best page's, null where the stored score is better. Aggregates tell all that, so no task goes through a domain's pages in turn.
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    score = F.coalesce("score", F.lit(0.0))
    parked = yes(F.col("parked"))
    a = pages.groupBy("domain_id").agg(
        F.greatest(F.max("score"), F.lit(0.0)).alias("best"), F.max(yes(F.col("home") & F.col("conclusive"))).alias("home"), F.max_by("reasons", F.struct(score, "id")).alias("reasons"),
        F.min(F.when(score >= COMPANY, F.col("id"))).alias("rose"), F.max(F.when(~parked, F.col("id"))).alias("plain"), F.max_by(parked, "id").alias("parked"),
    )
    empty = a.select("domain_id", F.lit(None).cast("string").alias("status"), F.lit(None).cast("double").alias("company_score"), F.lit(None).cast("boolean").alias("home_seen"))
    j = empty.join(a, "domain_id") if before is None else a.join(before.select("domain_id", "status", "company_score", "home_seen"), "domain_id", "left")
    was = F.coalesce("company_score", F.lit(0.0))
    best = F.greatest(was, F.coalesce("best", F.lit(0.0)))
    seen = yes(F.col("home_seen")) | F.col("home")
    risen = F.col("plain").isNotNull() & ((was >= COMPANY) | yes(F.col("plain") >= F.col("rose")))
    status = F.when((F.col("status") == "company") | risen, "company").when(F.col("parked") | (seen & (best < NO_COMPANY)), "not_company").otherwise("probing")
    reasons = F.when(F.col("company_score").isNull() | (F.col("best") >= was), F.col("reasons"))
    return j.select("domain_id", best.alias("best_score"), status.alias("status"), reasons.alias("reasons"), seen.alias("home_seen"))


def control(commands: DataFrame, started_at: int, done: DataFrame) -> DataFrame:
    """Commands after a run's start: pending ones from before it are expired, executed ones have their outcome."""
    d = done.select("id", F.col("status").alias("__s"))
    j = commands.join(d, "id", "left")
    status = F.when(F.col("__s").isNotNull(), F.col("__s")).when((F.col("status") == "pending") & (F.col("ts") < started_at), "expired").otherwise(F.col("status"))
    return j.withColumn("status", status).drop("__s")


#: What can be asked of a crawler.
COMMANDS = ("pause", "resume", "stop")


def submit(commands: DataFrame, command: str, now: int) -> DataFrame:
    """`commands` with one more, pending, of the next id."""
    if command not in COMMANDS:
        raise ValueError(f"unknown command: {command}")
    new = commands.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("id")).select("id", F.lit(now).alias("ts"), F.lit(command).alias("command"), F.lit("pending").alias("status"))
    return commands.unionByName(new, allowMissingColumns=True)


def pending(commands: DataFrame, limit: int = 100) -> DataFrame:
    """(id, command) of what waits, oldest first; the command is null where it isn't known."""
    return commands.where("status = 'pending'").select("id", F.when(F.col("command").isin(*COMMANDS), F.col("command")).alias("command")).orderBy("id").limit(limit)
