"""What a service answers: checked parameters, rows of a page, and the page's metadata."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tarnwell.functions.text import fold
from tarnwell.operators import relational
from tarnwell.operators.relational import BadRequest, NotFound, Page


@dataclass(frozen=True)
class Answer:
    """Rows of a page, at most its limit, with what follows it."""

    rows: list[Row]
    limit: int
    has_more: bool
    next_cursor: Any = None
    type_counts: dict[str, int] | None = None


def _page(rows: DataFrame, limit: int, cursor: Callable[[Row], Any], counts: dict[str, int] | None = None) -> Answer:
    """The page holds one row more than its limit if there are more; that row is not shown."""
    found = rows.collect()
    more = len(found) > limit
    found = found[:limit]
    return Answer(found, limit, more, cursor(found[-1]) if more else None, counts)


def datasets(tables: dict[str, DataFrame], page: Page) -> Answer:
    """A page of datasets, and the counts by type of all that the query and the species leave."""
    rows = relational.dataset_page(tables["dataset"], tables["asset"], tables["asset_file"], page)
    if page.sort == "relevance":
        rows, cursor = rows.orderBy("relevance_rank", "id"), lambda r: (r.relevance_rank, r.id)
    else:
        rows, cursor = rows.orderBy("id"), lambda r: (0, r.id)
    counts = {r.value: r["count"] for r in relational.type_counts(tables["dataset"], page.query, page.species).collect()}
    return _page(rows, page.limit, cursor, counts)


def dataset(tables: dict[str, DataFrame], dataset_id: int) -> tuple[Row, list[Row]]:
    """(the dataset, its assets by id); NotFound if there is none."""
    if dataset_id <= 0:
        raise BadRequest("ids are positive")
    own = tables["dataset"].where(F.col("id") == dataset_id).first()
    if own is None:
        raise NotFound(f"dataset {dataset_id}")
    return own, relational.dataset_detail(tables["dataset"], tables["asset"], tables["asset_file"], dataset_id).orderBy("id").collect()


def files(tables: dict[str, DataFrame], dataset_id: int, cursor: tuple[int, int] = (0, 0), limit: int = 50, asset_id: int | None = None) -> Answer:
    """A page of a dataset's live files, of one asset if given; NotFound if there is no such dataset."""
    if dataset_id <= 0 or asset_id is not None and asset_id <= 0:
        raise BadRequest("ids are positive")
    if not 1 <= limit <= Page.MOST:
        raise BadRequest(f"the limit must be from 1 to {Page.MOST}")
    if tables["dataset"].where(F.col("id") == dataset_id).limit(1).count() == 0:
        raise NotFound(f"dataset {dataset_id}")
    rows = relational.files_page(tables["asset"], tables["asset_file"], tables["files"], dataset_id, cursor, limit, asset_id).orderBy("file_id", "asset_id")
    return _page(rows, limit, lambda r: (r.file_id, r.asset_id))


def dataset_list(tables: dict[str, DataFrame], parts: int | None = None) -> DataFrame:
    """All datasets with their exact counts, made in so many tasks as ``parts`` says."""
    rows = tables["dataset"].join(relational.dataset_counts(tables["asset"], tables["asset_file"], parts), F.col("id") == F.col("dataset_id"), "left").drop("dataset_id")
    return rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("asset_count", "file_count")})


def dataset_by_name(tables: dict[str, DataFrame], name: str) -> tuple[Row, list[Row]]:
    """The first dataset of exactly this name, and its assets."""
    first = tables["dataset"].where(F.col("name") == name).agg(F.min("id")).first()[0]
    if first is None:
        raise NotFound(name)
    return dataset(tables, first)


class Cached:
    """A small result that is computed again when it is older than ``seconds``."""

    def __init__(self, load: Callable[[], Any], seconds: float = 60, clock: Callable[[], float] = time.monotonic) -> None:
        self.load, self.seconds, self.clock = load, seconds, clock
        self._at: float | None = None
        self._value: Any = None

    def get(self) -> Any:
        now = self.clock()
        if self._at is None or now - self._at >= self.seconds:
            self._value, self._at = self.load(), now
        return self._value


def facets(tables: dict[str, DataFrame], most: int = 100) -> dict[str, list[tuple[str, int]]]:
    """Values and counts of species and types; at most ``most`` of each."""
    out: dict[str, list[tuple[str, int]]] = {"species": [], "dataset_type": []}
    for r in relational.facet_counts(tables["dataset"], most=most).where(F.col("facet").isin(*out)).orderBy(F.desc("count"), fold("value"), "value").collect():
        out[r.facet].append((r.value, r["count"]))
    return out
