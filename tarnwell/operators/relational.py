"""Catalogue queries: pages, facets, counts, status, lists.

Counts per dataset are aggregated before they are joined, so no join multiplies rows, and pages are
filtered and limited before the counts are attached.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwell.functions.paths import base_name
from tarnwell.functions.text import filled, fold, holds, same, when_all


class BadRequest(ValueError):
    """A parameter is out of its range."""


class NotFound(LookupError):
    """No such row."""


@dataclass(frozen=True)
class Page:
    """Validated page parameters."""

    query: str | None = None
    species: str | None = None
    dataset_type: str | None = None
    cursor: tuple[int, int] | None = None
    limit: int = 50
    sort: str = "id"

    MOST = 200

    def __post_init__(self) -> None:
        query = (self.query or "").strip() or None
        object.__setattr__(self, "query", query)
        if query and len(query) > 200:
            raise BadRequest("the query has over 200 characters")
        if not 1 <= self.limit <= self.MOST:
            raise BadRequest(f"the limit must be from 1 to {self.MOST}")
        if self.sort not in ("id", "relevance") or self.sort == "relevance" and not query:
            raise BadRequest("sort is id, or relevance with a query")
        if self.cursor and min(self.cursor) < 0:
            raise BadRequest("the cursor must not be negative")


def pack_cursor(rank: Column, id_: Column) -> Column:
    """The one-number form of a cursor; right for ids below 10**9 only."""
    return rank.cast("long") * F.lit(10**9) + id_


def unpack_cursor(cursor: Column) -> tuple[Column, Column]:
    return F.floor(cursor / F.lit(10**9)).cast("long"), F.pmod(cursor, F.lit(10**9)).cast("long")


def matches(query: str | None) -> Column | None:
    if query is None:
        return None
    out = F.lit(False)
    for c in ("name", "species", "dataset_type", "summary"):
        out = out | holds(c, query)
    return out


def relevance(query: str) -> Column:
    """0 exact name, 1 prefix, 2 part of the name, 3 exact species, 4 part of it, 5 part of the type, 6 else."""
    q = fold(F.lit(query))
    name, species = fold("name"), fold("species")
    return (
        F.when(name == q, 0).when(F.startswith(name, q), 1).when(F.contains(name, q), 2)
        .when(species == q, 3).when(F.contains(species, q), 4).when(F.contains(fold("dataset_type"), q), 5).otherwise(6)
    )


def dataset_counts(assets: DataFrame, links: DataFrame, parts: int | None = None) -> DataFrame:
    """(dataset_id, asset_count, file_count): exact distinct counts, links to deleted files too.

    Ids of assets and files are told apart in so many tasks as ``parts`` says; nearly all differ, so they are dealt before, not after, a first pass over them.
    """
    by_asset = assets.select(F.col("id").alias("asset_id"), "dataset_id")
    both = by_asset.join(links.select("asset_id", "file_id"), "asset_id", "left")
    each = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).cast("long").alias("id")) for k, c in enumerate(("asset_id", "file_id"))])
    ids = both.select("dataset_id", F.explode(each).alias("e")).select("dataset_id", "e.kind", "e.id")
    if parts:
        ids = ids.repartition(parts, "dataset_id", "kind", "id")
    return ids.distinct().groupBy("dataset_id").agg(*[F.count(F.when(F.col("kind") == k, F.col("id"))).alias(c) for k, c in enumerate(("asset_count", "file_count"))])


def dataset_page(datasets: DataFrame, assets: DataFrame, links: DataFrame, page: Page) -> DataFrame:
    """One page, by id or by relevance, with one row more than the limit if there are more pages."""
    rows = datasets.where(when_all(same("species", page.species), same("dataset_type", page.dataset_type), matches(page.query)))
    if page.sort == "relevance":
        rows = rows.withColumn("relevance_rank", relevance(page.query))
        if page.cursor:
            rank, id_ = page.cursor
            rows = rows.where((F.col("relevance_rank") > rank) | (F.col("relevance_rank") == rank) & (F.col("id") > id_))
        order = ["relevance_rank", "id"]
    else:
        if page.cursor:
            rows = rows.where(F.col("id") > page.cursor[1])
        order = ["id"]
    rows = rows.orderBy(*order).limit(page.limit + 1)
    # A page is at most limit + 1 rows, so its ids bound what is counted.
    of_page = assets.join(F.broadcast(rows.select(F.col("id").alias("dataset_id"))), "dataset_id", "left_semi")
    counted = rows.join(dataset_counts(of_page, links), rows["id"] == F.col("dataset_id"), "left").drop("dataset_id")
    return counted.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("asset_count", "file_count")})


def type_counts(datasets: DataFrame, query: str | None, species: str | None) -> DataFrame:
    """Counts by type for a query, whatever type is chosen; null and "unknown" are one."""
    rows = datasets.where(when_all(same("species", species), matches(query)))
    return rows.groupBy(F.coalesce("dataset_type", F.lit("unknown")).alias("value")).agg(F.count(F.lit(1)).alias("count"))


def facets(datasets: DataFrame, column: str, most: int = 100) -> DataFrame:
    counted = datasets.where(filled(column)).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("count"))
    return counted.orderBy(F.desc("count"), fold("value"), "value").limit(most)


def facet_counts(datasets: DataFrame, query: str | None = None, species: str | None = None, dataset_type: str | None = None, most: int = 100) -> DataFrame:
    """(facet, value, count) from one scan: "species" and "dataset_type" of all datasets, the ``most`` commonest of each, and for a query
    "query_type", whatever type is chosen, and "query_species", whatever species is.

    Groups are made once for each of both columns, with a count of all rows and of those that the query and the other
    column's choice leave. For the query null and "unknown" are one value.
    """
    found = when_all(matches(query))
    rows = datasets.select("species", "dataset_type", (found & when_all(same("species", species))).alias("_by_type"), (found & when_all(same("dataset_type", dataset_type))).alias("_by_species"))
    sets = rows.groupingSets([["species"], ["dataset_type"]], "species", "dataset_type").agg(
        F.grouping("species").alias("_g"), F.count(F.lit(1)).alias("n"), F.count_if("_by_type").alias("t"), F.count_if("_by_species").alias("s"),
    )
    one = lambda facet, value, count: F.struct(F.lit(facet).alias("facet"), value.alias("value"), F.col(count).alias("count"))
    known = lambda c: F.when(filled(c), F.col(c))
    told = lambda c: F.coalesce(c, F.lit("unknown"))
    each = F.when(F.col("_g") == 0, F.array(one("species", known("species"), "n"), one("query_species", told("species"), "s")))
    each = each.otherwise(F.array(one("dataset_type", known("dataset_type"), "n"), one("query_type", told("dataset_type"), "t")))
    counted = sets.select(F.inline(each)).where("value IS NOT NULL AND count > 0").groupBy("facet", "value").agg(F.sum("count").alias("count"))
    top = Window.partitionBy("facet").orderBy(F.desc("count"), fold("value"), "value")
    ranked = counted.withColumn("_r", F.row_number().over(top)).where((F.col("_r") <= most) | F.startswith("facet", F.lit("query")))
    return ranked.drop("_r")


def dataset_detail(datasets: DataFrame, assets: DataFrame, links: DataFrame, dataset_id: int) -> DataFrame:
    """The assets of a dataset with their link counts."""
    if dataset_id <= 0:
        raise BadRequest("ids are positive")
    own = assets.where(F.col("dataset_id") == dataset_id)
    count = links.join(own.select(F.col("id").alias("asset_id")), "asset_id", "left_semi").groupBy("asset_id").agg(F.count(F.lit(1)).alias("file_count"))
    return own.join(count, own["id"] == count["asset_id"], "left").select("dataset_id", "id", "name", "asset_type", F.coalesce("file_count", F.lit(0)).alias("file_count"))


def files_page(assets: DataFrame, links: DataFrame, files: DataFrame, dataset_id: int, cursor: tuple[int, int] = (0, 0), limit: int = 50, asset_id: int | None = None) -> DataFrame:
    """Live files of a dataset after (file id, asset id); base names only."""
    own = assets.where((F.col("dataset_id") == dataset_id) & (F.lit(True) if asset_id is None else F.col("id") == asset_id)).select(F.col("id").alias("asset_id"))
    rows = links.join(own, "asset_id").join(files.where(~F.col("deleted")), F.col("file_id") == F.col("id"))
    after = (F.col("file_id") > cursor[0]) | (F.col("file_id") == cursor[0]) & (F.col("asset_id") > cursor[1])
    return rows.where(after).orderBy("file_id", "asset_id").limit(limit + 1).select("file_id", "asset_id", "role", base_name("path").alias("file_name"), F.greatest("size", F.lit(0)).alias("size"))


def stats_upper_bound(datasets: DataFrame, assets: DataFrame, files: DataFrame) -> DataFrame:
    """Cheap upper bounds: the largest ids; last update of the file with the largest id."""
    d = datasets.agg(F.max("id").alias("datasets"))
    a = assets.agg(F.max("id").alias("assets"))
    f = files.agg(F.max("id").alias("files"), F.max_by("updated_at", "id").alias("last_indexed_at"))
    one = F.lit(1).alias("_k")
    return d.select("*", one).join(a.select("*", one), "_k").join(f.select("*", one), "_k").select("datasets", "assets", "files", "last_indexed_at", F.lit(True).alias("approximate"))


def index_status(files: DataFrame) -> DataFrame:
    return files.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(~F.col("deleted")).alias("live"), F.count_if("deleted").alias("deleted"),
        F.max("indexed_at").alias("last_indexed_at"), F.max("updated_at").alias("last_updated_at"),
    )


def status_by_server(files: DataFrame) -> DataFrame:
    return files.where(~F.col("deleted")).groupBy("source_server").agg(F.count(F.lit(1)).alias("live"), F.max("indexed_at").alias("last_indexed_at"))


def metadata_coverage(files: DataFrame) -> DataFrame:
    live = files.where(~F.col("deleted"))
    have = F.count_if(F.col("bio_metadata").isNotNull() & (F.col("bio_metadata") != ""))
    n = F.count(F.lit(1))
    return live.agg(have.alias("with_metadata"), n.alias("live"), F.round(F.when(n > 0, 100.0 * have / n).otherwise(0.0), 6).alias("percent"))


def list_files(files: DataFrame, tags: DataFrame | None = None, tag: str | None = None, server: str | None = None, limit: int = 100) -> DataFrame:
    """The first live files by id, of a tag or server if given; filters come before the limit."""
    rows = files.where(~F.col("deleted"))
    if server is not None:
        rows = rows.where(F.col("source_server") == server)
    if tag is not None:
        rows = rows.join(tags.where(F.col("tag") == tag).select(F.col("file_id").alias("id")).distinct(), "id", "left_semi")
    return rows.orderBy("id").limit(limit).select("id", "path", "size")


def info(files: DataFrame, path: str) -> DataFrame:
    """A file by path, deleted or not."""
    return files.where(F.col("path") == path)


def documents_after(files: DataFrame, after: int, n: int) -> DataFrame:
    """The next live files by id for indexing, with their metadata text; missing parts are "?"."""
    part = lambda c: F.coalesce(c, F.lit("?"))
    text = F.concat_ws(" | ", "path", part("species"), part("assay_type"), part("format"))
    return files.where(~F.col("deleted") & (F.col("id") > after)).orderBy("id").limit(n).select("id", text.alias("metadata"))


def neighbours(relations: DataFrame, nodes: DataFrame, node: int) -> DataFrame:
    """The other ends of a node's relations, either way round."""
    near = relations.where((F.col("a") == node) | (F.col("b") == node))
    near = near.select(F.when(F.col("a") == node, F.col("b")).otherwise(F.col("a")).alias("id"), "relation", "score")
    return near.join(nodes, "id")


def correction_rules(history: DataFrame, threshold: int = 3) -> DataFrame:
    return history.groupBy("pattern").agg(F.count(F.lit(1)).alias("count")).where(F.col("count") >= threshold)
