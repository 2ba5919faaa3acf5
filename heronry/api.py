"""The service's questions as functions: parameters are clamped here, answers are DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame

from heronry.operators import catalog, graph, matching, search, timeline
from heronry.operators.aggregates import counts, downsample
from heronry.operators.sequences import rates
from heronry.plans.model import Model
from heronry.sources import gazetteer


class Api:
    def __init__(self, model: Model, now: int):
        self.m, self.now = model, now

    def stats(self) -> tuple[DataFrame, DataFrame]:
        """(counts, crawler status)."""
        m = self.m
        return counts(domains=m.domains, pages=m.pages, jobs=m.jobs, boards=m.boards), timeline.crawler_status(m.log, m.samples, self.now)

    def graph(self, limit: int = 200, offset: int = 0, discovered: bool = True, at: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
        m = self.m
        return graph.domain_graph(m.domains, m.pages, m.jobs, m.edges, m.log, limit, offset, discovered, at)

    def history(self, buckets: int = 160) -> tuple[DataFrame, DataFrame]:
        return timeline.history(self.m.log, buckets, self.now)

    def events(self, after: int | None = None, before: int | None = None, limit: int = 200) -> DataFrame:
        return timeline.events(self.m.log, after, before, limit)

    def metrics(self) -> DataFrame:
        """Rates of the latest sample."""
        from pyspark.sql import functions as F

        return rates(self.m.samples, ["pages", "bytes"]).orderBy(F.desc("id")).limit(1)

    def metrics_history(self, start: int | None = None, end: int | None = None, step: int | None = None) -> DataFrame:
        end = self.now if end is None else end
        start = end - 3_600_000 if start is None else start
        return downsample(self.m.samples, start, end, max(step or (end - start) // 300, 1000))

    def domain(self, host: str) -> dict[str, DataFrame]:
        m = self.m
        return catalog.domain_detail(m.domains, m.pages, m.jobs, m.boards, m.edges, host)

    def domain_pages(self, domain_id: int, host: str) -> tuple[DataFrame, DataFrame]:
        m = self.m
        return graph.page_graph(m.pages, m.links, m.frontier, domain_id, host)

    def companies(self, **filters) -> tuple[DataFrame, DataFrame]:
        m = self.m
        return catalog.companies(m.domains, m.jobs, m.pages, m.boards, **filters)

    def places(self, q: str, limit: int = 8) -> DataFrame:
        return gazetteer.suggest(self.m.places, q, limit)

    def search(self, query: search.JobQuery, profile_id: int | None = None) -> tuple[DataFrame, list[str], str]:
        m = self.m
        return search.run(m.facts, m.domains, query, self.now, m.places, m.matches, profile_id)

    def search_text(self, text: str, profile_id: int | None = None) -> tuple[DataFrame, list[str], str]:
        """A question in words, when nothing better reads it than its keywords."""
        from heronry.functions.text import keyword_fallback

        return self.search(search.JobQuery(keywords=keyword_fallback(text)), profile_id)

    def matches(self, profile_id: int, **filters) -> tuple[DataFrame, DataFrame]:
        m = self.m
        return matching.browse(m.matches, m.facts, m.domains, profile_id, now=self.now, **filters)

    def facets(self, profile_id: int) -> tuple[DataFrame, DataFrame]:
        return matching.facets(self.m.matches, self.m.jobs, profile_id)
