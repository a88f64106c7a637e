"""Full-text search by BM25, vector search, and their fusion."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwell.functions.text import cosine, holds, tokens

K1, B = 1.2, 0.75


@dataclass
class Query:
    """Clauses of a query: words and phrases, each with its field if it names one, that may, must and must not occur."""

    should: list[tuple[str | None, list[str]]] = field(default_factory=list)
    must: list[tuple[str | None, list[str]]] = field(default_factory=list)
    never: list[tuple[str | None, list[str]]] = field(default_factory=list)


def parse(text: str, fields: tuple[str, ...] = ()) -> Query | None:
    """``+`` must, ``-`` must not, quotes make phrases, ``field:`` names one of ``fields``, AND and OR join; None if quotes do not pair."""
    if text.count('"') % 2:
        return None
    out, both = Query(), False
    named = "|".join(map(re.escape, fields)) or r"(?!)"
    items = re.findall(rf'([+-]?)(?:({named}):)?(?:"([^"]*)"|(\S+))', text)
    for i, (sign, where, quoted, plain) in enumerate(items):
        if plain in ("AND", "OR") and not sign:
            both = plain == "AND"
            continue
        words = [w for w in re.split(r"[^\w]|_", (quoted or plain).lower()) if w and len(w) <= 40]
        follows = i + 1 < len(items) and items[i + 1][3] == "AND"
        if words:
            (out.never if sign == "-" else out.must if sign == "+" or both or follows else out.should).append((where or None, words))
        both = False
    return out


def postings(docs: DataFrame) -> DataFrame:
    """(doc_id, term, tf, positions, length) of documents with id and text."""
    words = docs.select("id", tokens("text").alias("w"))
    rows = words.select(F.col("id").alias("doc_id"), F.size("w").alias("length"), F.posexplode("w").alias("pos", "term"))
    return rows.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"), F.first("length").alias("length"))


def bm25(docs: DataFrame, text: str, k: int = 50) -> DataFrame:
    """(doc_id, score): the k best, ties to smaller ids. Unparsable queries give nothing.

    One pass over the documents keeps only query terms; corpus statistics are an aggregate of the same scan.
    """
    query = parse(text)
    must, never = ([c for _, c in query.must], [c for _, c in query.never]) if query else ([], [])
    clauses = [c for _, c in query.should + query.must] if query else []
    terms = sorted({t for c in clauses for t in c})
    words = docs.select(F.col("id").alias("doc_id"), tokens("text").alias("w"))
    occurs = lambda t: F.size(F.filter("w", lambda x: x == F.lit(t)))
    tf = [occurs(t).alias(f"tf{i}") for i, t in enumerate(terms)]
    at = lambda c: F.contains(F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" ")), F.lit(" " + " ".join(c) + " "))
    rows = words.select("doc_id", F.size("w").alias("length"), *tf, *[at(c).alias(f"must{i}") for i, c in enumerate(must)], *[at(c).alias(f"never{i}") for i, c in enumerate(never)], *[at(c).alias(f"phrase{i}") for i, c in enumerate(clauses) if len(c) > 1])
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    score = F.lit(0.0)
    for i, t in enumerate(terms):
        in_phrase = [j for j, c in enumerate(clauses) if len(c) > 1 and t in c]
        alone = any(c == [t] for c in clauses)
        f, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log1p((F.col("n") - df + 0.5) / (df + 0.5))
        part = idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("length") / F.col("mean")))
        if in_phrase and not alone:
            hit = F.lit(False)
            for j in in_phrase:
                hit = hit | F.col(f"phrase{j}")
            part = F.when(hit, part).otherwise(0.0)
        score = score + part
    good = F.lit(bool(terms))
    for i in range(len(must)):
        good = good & F.col(f"must{i}")
    for i in range(len(never)):
        good = good & ~F.col(f"never{i}")
    # The statistics are one row.
    scored = rows.join(F.broadcast(stats)).where(good).withColumn("score", F.round(score, 6)).where("score > 0")
    return scored.orderBy(F.desc("score"), "doc_id").limit(k).select("doc_id", "score")


def nearest(vectors: DataFrame, query: list[float], k: int = 20) -> DataFrame:
    """(id, similarity): the k largest cosines; vectors of another length take no part."""
    q = F.array(*[F.lit(float(x)) for x in query])
    rows = vectors.where(F.size("vector") == len(query)).select("id", F.round(cosine(F.col("vector"), q), 5).alias("similarity"))
    return rows.orderBy(F.desc("similarity"), "id").limit(k)


def few(rows: DataFrame) -> DataFrame:
    """Rows of a page, computed once: they are a limited result, so the driver holds them."""
    return rows.sparkSession.createDataFrame(rows.collect(), rows.schema)


def rerank(hits: DataFrame, vectors: DataFrame, query: list[float], k: int = 20) -> DataFrame:
    """(doc_id, score): 0.6 of BM25 by its largest (1 at least) and 0.4 of the cosine, 0 without a vector.

    Without any vector the normalised BM25 score alone. Hits are at most a page: they are computed once, and only their vectors are read.
    """
    q = F.array(*[F.lit(float(x)) for x in query])
    page = hits.collect()
    hits = hits.sparkSession.createDataFrame(page, hits.schema)
    own = few(vectors.where(F.col("id").isin([r.doc_id for r in page]) & (F.size("vector") == len(query))).select("id", cosine(F.col("vector"), q).alias("cos")))
    some = own.limit(1).count() > 0
    norm = F.col("score") / F.lit(max([1.0, *(r.score for r in page)]))
    both = hits.join(F.broadcast(own), hits["doc_id"] == own["id"], "left")
    score = 0.6 * norm + 0.4 * F.coalesce("cos", F.lit(0.0)) if some else norm
    return both.select("doc_id", F.round(score, 5).alias("score")).orderBy(F.desc("score"), "doc_id").limit(k)


def hydrate(hits: DataFrame, files: DataFrame, projects: DataFrame | None = None) -> DataFrame:
    """(doc_id, score, path, file_type, assay_type, species, summary) of a page of hits, deleted files too.

    ``files`` has id, path, format, assay_type and species; ``projects`` has project_id, name and file_id, and the first project of a
    file stands before its summary.
    """
    page = few(hits)
    ids = [r.doc_id for r in page.select("doc_id").collect()]
    own = files.where(F.col("id").isin(ids)).select(F.col("id").alias("doc_id"), "path", F.col("format").alias("file_type"), "assay_type", "species")
    rows = own.join(F.broadcast(page), "doc_id").withColumn("summary", F.concat_ws(", ", "assay_type", "species"))
    if projects is not None:
        first = projects.where(F.col("file_id").isin(ids)).groupBy(F.col("file_id").alias("doc_id")).agg(F.min_by("name", "project_id").alias("_p"))
        rows = rows.join(F.broadcast(few(first)), "doc_id", "left")
        rows = rows.withColumn("summary", F.concat(F.coalesce(F.concat(F.lit("[project: "), "_p", F.lit("] ")), F.lit("")), "summary"))
    return rows.select("doc_id", "score", "path", "file_type", "assay_type", "species", "summary")


def weighted(files: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """(id, score): live files whose path (3), metadata (2) or format (1) holds the query but for ASCII case, weights added."""
    part = lambda c, w: F.when(holds(c, query), w).otherwise(0)
    rows = files.where("NOT deleted").select("id", (part("path", 3) + part("bio_metadata", 2) + part("format", 1)).alias("score"))
    return rows.where("score > 0").orderBy(F.desc("score"), "id").limit(limit)
