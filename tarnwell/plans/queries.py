"""Registered queries over the sample tables, each with the same result in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tarnwell.functions import formats, paths, text
from tarnwell.operators import catalog, containment, discovery, relational, search, suggest
from tarnwell.operators.relational import Page
from tarnwell.plans.registry import register
from tarnwell.sources.buckets import Buckets
from tarnwell.sources.store import scratch_folder
from tarnwell.streaming import changes

COUNTED = """
, counted as (
  select d.*, count(distinct a.id) as asset_count, count(distinct af.file_id) as file_count
  from dataset d left join asset a on a.dataset_id = d.id left join asset_file af on af.asset_id = a.id group by all
)
"""
DATASET = ("id", "name", "dataset_type", "species", "path", "updated_at", "asset_count", "file_count")


@register(COUNTED + "select id, name, dataset_type, species, path, updated_at, asset_count, file_count from counted where lower(species) = 'brand#1' and id > 100 order by id limit 51")
def dataset_page_id(c):
    return relational.dataset_page(c.datasets, c.assets, c.links, Page(species="BRAND#1", cursor=(0, 100))).select(*DATASET)


RANK = """
case when lower(name) = 'small' then 0 when starts_with(lower(name), 'small') then 1 when contains(lower(name), 'small') then 2
  when lower(species) = 'small' then 3 when contains(lower(species), 'small') then 4 when contains(lower(dataset_type), 'small') then 5 else 6 end
"""


@register(COUNTED + f"select id, name, dataset_type, species, path, updated_at, asset_count, file_count, {RANK} as relevance_rank from counted where contains(lower(name || species || dataset_type || summary), 'small') order by relevance_rank, id limit 51")
def dataset_page_relevance(c):
    return relational.dataset_page(c.datasets, c.assets, c.links, Page(query="Small", sort="relevance")).select(*DATASET, "relevance_rank")


@register("select coalesce(dataset_type, 'unknown') as value, count(*) as count from dataset where contains(lower(name || '|' || species || '|' || dataset_type || '|' || summary), 're') and lower(species) = 'brand#2' group by 1")
def dataset_type_counts(c):
    return relational.type_counts(c.datasets, "RE", "Brand#2")


@register("select species as value, count(*) as count from dataset where trim(species) <> '' group by 1 order by 2 desc, 1 limit 100")
def facet_species(c):
    return relational.facets(c.datasets, "species")


@register("select dataset_type as value, count(*) as count from dataset where trim(dataset_type) <> '' group by 1 order by 2 desc, 1 limit 100")
def facet_type(c):
    return relational.facets(c.datasets, "dataset_type")


@register("""select * from (select 'species' as facet, species as value, count(*) as count from dataset where trim(species) <> '' group by 2 order by 3 desc, lower(species) limit 100) union all
select * from (select 'dataset_type', dataset_type, count(*) from dataset where trim(dataset_type) <> '' group by 2 order by 3 desc, lower(dataset_type) limit 100) union all
select 'query_type', coalesce(dataset_type, 'unknown'), count(*) from dataset where contains(lower(name || '|' || species || '|' || dataset_type || '|' || summary), 're') and lower(species) = 'brand#2' group by 2 union all
select 'query_species', coalesce(species, 'unknown'), count(*) from dataset where contains(lower(name || '|' || species || '|' || dataset_type || '|' || summary), 're') and lower(dataset_type) = 'promo' group by 2""")
def facet_counts(c):
    return relational.facet_counts(c.datasets, "RE", "Brand#2", "PROMO")


@register("select dataset_id, a.id, name, asset_type, count(af.file_id) as file_count from asset a left join asset_file af on af.asset_id = a.id where dataset_id = 5 group by all")
def dataset_detail(c):
    return relational.dataset_detail(c.datasets, c.assets, c.links, 5)


@register("""select file_id, asset_id, role, split_part(path, '/', -1) as file_name, greatest(size, 0) as size from asset_file af join asset a on a.id = af.asset_id
join files f on f.id = af.file_id where not deleted and dataset_id = 5 and (file_id, asset_id) > (10, 0) order by 1, 2 limit 21""")
def files_page(c):
    return relational.files_page(c.assets, c.links, c.files, 5, cursor=(10, 0), limit=20)


@register("select (select max(id) from dataset) as datasets, (select max(id) from asset) as assets, (select max(id) from files) as files, (select updated_at from files order by id desc limit 1) as last_indexed_at, true as approximate")
def stats_upper_bound(c):
    return relational.stats_upper_bound(c.datasets, c.assets, c.files)


@register("select count(*) as total, count(*) filter (not deleted) as live, count(*) filter (deleted) as deleted, max(indexed_at) as last_indexed_at, max(updated_at) as last_updated_at from files")
def index_status(c):
    return relational.index_status(c.files)


@register("select source_server, count(*) as live, max(indexed_at) as last_indexed_at from files where not deleted group by 1")
def status_by_server(c):
    return relational.status_by_server(c.files)


@register("select count(*) filter (bio_metadata <> '') as with_metadata, count(*) as live, round(100.0 * count(*) filter (bio_metadata <> '') / count(*), 6) as percent from files where not deleted")
def metadata_coverage(c):
    return relational.metadata_coverage(c.files)


@register("""select id, path, size from files where not deleted and source_server = '1-URGENT' and id in (select o_orderkey from orders join customer on c_custkey = o_custkey where c_mktsegment = 'BUILDING') order by id limit 100""")
def list_by_tag(c):
    tags = c.read("orders").join(c.read("customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("file_id"), F.col("c_mktsegment").alias("tag"))
    return relational.list_files(c.files, tags, tag="BUILDING", server="1-URGENT")


@register("select id, path, size, deleted, strftime(make_timestamp(mtime * 1000000), '%Y-%m-%d %H:%M:%S') as modified, round(size / 1048576, 2) as mb from files where path = (select path from files where id = 33)")
def info_by_path(c):
    path = c.files.where("id = 33").select(F.col("path").alias("p"))
    rows = c.files.join(F.broadcast(path), F.col("path") == F.col("p"))
    return rows.select("id", "path", "size", "deleted", text.epoch_text("mtime").alias("modified"), F.round(F.col("size") / 1048576, 2).alias("mb"))


@register("select id, path, mtime from files where not deleted")
def live_paths(c):
    return c.files.where(~F.col("deleted")).select("id", "path", "mtime")


@register("select id, path || ' | ' || coalesce(species, '?') || ' | ' || coalesce(assay_type, '?') || ' | ' || coalesce(format, '?') as metadata from files where not deleted and id > 500 order by id limit 1000")
def index_docs_after(c):
    return relational.documents_after(c.files, 500, 1000)


@register("select species || name as name, id, path from dataset where snapshot_id = 3 and species || name not in (select species || name from dataset where snapshot_id = 1)")
def snapshot_added(c):
    d = c.datasets.withColumn("name", F.concat("species", "name"))
    return catalog.snapshot_added(d.where("snapshot_id = 1"), d.where("snapshot_id = 3").select("name", "id", "path"))


@register("select name, id, path from dataset where snapshot_id = 1 and name not in (select name from dataset where snapshot_id = 3)")
def snapshot_removed(c):
    d = c.datasets
    return catalog.snapshot_added(d.where("snapshot_id = 3"), d.where("snapshot_id = 1").select("name", "id", "path"))


@register("""select n.name, n.dataset_type, n.species, o.dataset_type as old_type, o.species as old_species from dataset n join dataset o on n.name = o.name
where n.snapshot_id = 3 and o.snapshot_id = 1 and (n.dataset_type <> o.dataset_type or n.species <> o.species)""")
def snapshot_modified(c):
    return catalog.snapshot_modified(c.datasets.where("snapshot_id = 1"), c.datasets.where("snapshot_id = 3"))


@register("""select asset_id, file_id, role from asset_file where asset_id not in (select a.id from asset a join dataset d on a.dataset_id = d.id where d.snapshot_id > 2)""")
def snapshot_rollback(c):
    stamped = c.assets.join(c.datasets.select(F.col("id").alias("dataset_id"), "snapshot_id"), "dataset_id")
    return catalog.rollback(c.datasets, stamped, c.links, 2)[2].select("asset_id", "file_id", "role")


@register(""", delta as (select path, size + 1 as size, mtime + 5 as mtime, source_server from files where id % 10 = 0
  union all select '/new/f' || cast(id as varchar), size, mtime, source_server from files where id % 100 = 1)
select coalesce(f.path, d.path) as path, case when d.path is not null then d.size else f.size end as size, case when d.path is not null then false else f.deleted end as deleted,
  coalesce(f.indexed_at, 2000000000) as indexed_at, case when d.path is not null then 2000000000 else f.updated_at end as updated_at,
  coalesce(f.id, (select max(id) from files) + row_number() over (partition by f.id is null order by d.path)) as id
from files f full join delta d on f.path = d.path""")
def upsert_latest(c):
    old = c.files.where("id % 10 = 0").select("path", (F.col("size") + 1).alias("size"), (F.col("mtime") + 5).alias("mtime"), "source_server")
    new = c.files.where("id % 100 = 1").select(F.concat(F.lit("/new/f"), F.col("id").cast("string")).alias("path"), "size", "mtime", "source_server")
    delta = old.union(new).withColumn("format", F.lit(None).cast("string"))
    return catalog.upsert(c.files, delta, 2_000_000_000).select("path", "size", "deleted", "indexed_at", F.col("updated_at").cast("long"), "id")


@register(""", delta as (select path, size + 1 as size, mtime + 5 as mtime, source_server from files where id % 10 = 0
  union all select '/new/f' || cast(id as varchar), size, mtime, source_server from files where id % 100 = 1)
select coalesce(f.path, d.path) as path, case when d.path is not null then d.size else f.size end as size, case when d.path is not null then false else f.deleted end or coalesce(f.id % 7 = 3 and f.id % 10 <> 0, false) as deleted,
  coalesce(f.indexed_at, 2000000000) as indexed_at, case when d.path is not null or f.id % 7 = 3 then 2000000000 else f.updated_at end as updated_at, f.id as known_id, f.id is null as fresh
from files f full join delta d on f.path = d.path""")
def upsert_buckets(c):
    """The same upsert, and soft deletes, over files in buckets; ids of new files follow the largest."""
    files = c.files
    table = Buckets(c.spark, f"{scratch_folder(c.spark)}/buckets-{uuid.uuid4().hex}")
    table.create(files, 32)
    old = files.where("id % 10 = 0").select("path", (F.col("size") + 1).alias("size"), (F.col("mtime") + 5).alias("mtime"), "source_server")
    new = files.where("id % 100 = 1").select(F.concat(F.lit("/new/f"), F.col("id").cast("string")).alias("path"), "size", "mtime", "source_server")
    delta = old.union(new).withColumn("format", F.lit(None).cast("string"))
    table.change(delta, files.where("id % 7 = 3 AND id % 10 <> 0").select("path"), 2_000_000_000)
    top = files.agg(F.max("id")).first()[0] or 0
    fresh = F.col("id") > top
    return table.read().select("path", "size", "deleted", "indexed_at", "updated_at", F.when(~fresh, F.col("id")).alias("known_id"), fresh.alias("fresh"))


@register("select id, path, deleted or id % 7 = 0 as deleted, case when id % 7 = 0 then 2000000000 else updated_at end as updated_at from files")
def soft_delete(c):
    return catalog.soft_delete(c.files, c.files.where("id % 7 = 0"), 2_000_000_000).select("id", "path", "deleted", F.col("updated_at").cast("long"))


@register("select id, path, updated_at from files where not (deleted and updated_at < 883612800 - 30 * 86400)")
def purge_deleted(c):
    return catalog.purge(c.files, 883_612_800, 30).select("id", "path", "updated_at")


PARTS = """, named as (select *, regexp_replace(path, '/[^/]*$', '') as dir, split_part(path, '/', -1) as name from docs),
extended as (select *, case when ends_with(name, '.fastq.gz') then 'fastq.gz' when ends_with(name, '.vcf.gz') then 'vcf.gz' else lower(split_part(name, '.', -1)) end as ext from named)
"""


@register(PARTS + """, ranked as (select dir, name, row_number() over (partition by dir order by name) as r from extended)
select dir, count(*) as files, count(distinct ext) as extensions, bool_or(ext in ('fastq.gz', 'bam', 'vcf.gz', 'h5', 'gtf', 'fq')) as has_bio,
  (select string_agg(name, ',' order by name) from ranked r where r.dir = e.dir and r <= 8) as samples from extended e group by dir""")
def dir_fingerprint(c):
    return discovery.fingerprints(c.docs)


@register(PARTS + "select dir, ext, n from (select dir, ext, count(*) as n, row_number() over (partition by dir order by count(*) desc, ext) as r from extended group by dir, ext) where r <= 5")
def dir_ext_top5(c):
    return discovery.extension_tops(c.docs)


@register("""select regexp_replace(path, '/[^/]*$', '') as dir, count(*) as files, 'dat' as ext from files group by 1 having count(*) >= 20""")
def uniform_dirs(c):
    return discovery.uniform(c.files, 20)


@register(PARTS + """, bio as (select distinct dir from extended where ext in ('fastq.gz', 'bam', 'vcf.gz', 'h5', 'gtf', 'fq'))
select regexp_replace(dir, '/[^/]*$', '') as path, count(*) as bio_children from bio group by 1""")
def child_signal(c):
    return discovery.child_signals(c.docs)


UP = """, up as (select id, size, path, array_to_string(list_slice(string_split(path, '/'), 1, i), '/') as dir, i
  from (select id, size, path, unnest(range(2, len(string_split(path, '/')) + 1)) as i from docs))
"""
NESTED = UP + """, ds as (select distinct '/data/' || lang as path from docs union select distinct '/data/' || lang || '/' || source from docs where length(source) % 2 = 0)
"""


@register(PARTS + """, up as (select dir, ext in ('fastq.gz', 'bam', 'vcf.gz', 'h5', 'gtf', 'fq') as bio, array_to_string(list_slice(string_split(path, '/'), 1, i), '/') as path, len(string_split(path, '/')) - 1 - i as gap
  from (select *, unnest(range(2, len(string_split(path, '/')))) as i from extended))
select path, case when bool_or(gap = 0 and bio) then 'Bio' when bool_or(gap > 0 and bio) then 'PropagatedBio' when count(*) filter (gap = 0) = 0 then 'Empty' else 'Unknown' end as signal from up group by path""")
def dir_signals(c):
    return discovery.signals(c.docs)


@register(NESTED + "select ds.path as dataset_path, up.id as file_id from up join ds on up.dir = ds.path")
def containment_links(c):
    return containment.containment(c.docs, c.dirs_as_datasets).select("dataset_path", "file_id")


@register(NESTED + "select ds.path as dataset_path, up.id as file_id from up join ds on up.dir = ds.path")
def containment_filtered(c):
    """The same for more datasets than are broadcast: ancestors pass a filter of bounded size before they are shuffled."""
    return containment.containment(c.docs, c.dirs_as_datasets, broadcast_rows=0).select("dataset_path", "file_id")


@register(NESTED + "select up.id as file_id, max(ds.path) as dataset_path from up join ds on up.dir = ds.path group by 1")
def most_specific_dataset(c):
    d = c.dirs_as_datasets
    return containment.most_specific(c.docs, d).join(d.select(F.col("id").alias("dataset_id"), F.col("path").alias("dataset_path")), "dataset_id").select("file_id", "dataset_path")


@register(NESTED + "select ds.path as dataset_path, up.id as file_id from up join ds on up.dir = ds.path where up.id % 3 <> 0 or ds.path <> '/data/' || split_part(up.path, '/', 3)")
def aux_unlinked(c):
    d = c.dirs_as_datasets
    linked = c.docs.where("id % 3 = 0").select(F.col("id").alias("file_id"), F.concat(F.lit("/data/"), "lang").alias("path")).join(d, "path").select(F.col("id").alias("dataset_id"), "file_id")
    rows = containment.unlinked(c.docs, d, linked)
    return rows.join(d.select(F.col("id").alias("dataset_id"), F.col("path").alias("dataset_path")), "dataset_id").select("dataset_path", "file_id")


@register("""select id, path, 1 as rank from dataset where starts_with('/ds/Brand#1/3/p0/x', path || '/') union all
select id, path, rank from (select id, path, 2 as rank from dataset where starts_with(path, '/ds/Brand#1/3/') order by length(path), id limit 1)""")
def best_dataset_for_path(c):
    return containment.best_dataset(c.datasets, "/ds/Brand#1/3").select("id", "path", "rank")


@register(UP + "select dir, count(*) as files, cast(sum(size) as bigint) as bytes from up where dir <> path group by dir")
def ancestor_counts(c):
    return containment.subtree_counts(c.docs)


@register(PARTS + "select id, name, ext from extended")
def ext_extract(c):
    return c.docs.select("id", paths.base_name("path").alias("name"), paths.extension(paths.base_name("path")).alias("ext"))


TYPE = """case split_part(path, '.', -1) when 'gz' then 'gzip' when 'bam' then 'BAM' when 'csv' then 'CSV' when 'h5' then 'HDF5' when 'gtf' then 'GFF' when 'fq' then 'FASTQ' else 'text' end"""


@register(f"select id, {TYPE} as file_type, case {TYPE} when 'gzip' then 'application/gzip' when 'CSV' then 'text/plain' when 'GFF' then 'text/plain' when 'FASTQ' then 'text/plain' else 'application/octet-stream' end as mime from docs")
def format_detect_ext(c):
    kind = formats.detect("path")
    return c.docs.select("id", kind.alias("file_type"), formats.mime(kind).alias("mime"))


@register("select id, case when id % 8 in (0, 6) then 'fastq' when id % 8 = 1 then 'bam' when id % 8 = 4 then 'hdf5' when id % 8 = 5 then 'annotation' else 'generic' end as interpreter, case when id % 8 in (0, 6) then 0.95 when id % 8 = 1 then 0.9 when id % 8 in (4, 5) then 0.85 else 0.5 end :: double as score from docs")
def interpreter_choice(c):
    return c.docs.select("id", formats.interpreter("path", formats.detect("path")).alias("i")).select("id", "i.interpreter", "i.score")


@register("select id, case when regexp_matches(lower(path), '_r1|_r2|_1\\.|_2\\.') then 'paired-end' else 'single-end' end as tag from docs")
def paired_end_tag(c):
    return c.docs.select("id", paths.paired_tag("path").alias("tag"))


@register("select id, source as project from docs")
def project_extract(c):
    return c.docs.select("id", paths.project_of(paths.ancestor_names("path")).alias("project"))


@register("""select id, case when contains(low, '.') then coalesce(nullif(regexp_extract(low, '\\.((fastq|fq|vcf|gff|tsv|csv|txt|tab|fa)\\.gz)$', 1), ''), regexp_extract(low, '\\.([^.]*)$', 1)) else '(noext)' end as ext
from (select id, lower(case id % 5 when 0 then path || '.GZ' when 1 then replace(split_part(path, '/', -1), '.', '-') when 2 then path || '.fa.gz' else path end) as low from docs)""")
def second_extension(c):
    odd = F.col("id") % 5
    name = F.when(odd == 0, F.concat("path", F.lit(".GZ"))).when(odd == 1, F.replace(paths.base_name("path"), F.lit("."), F.lit("-"))).when(odd == 2, F.concat("path", F.lit(".fa.gz"))).otherwise(F.col("path"))
    return c.docs.select("id", paths.second_extension(paths.base_name(name)).alias("ext"))


@register("select p_partkey as id, regexp_replace(regexp_extract(upper(p_name), '^[^0-9.]*'), '_+$', '') as family from part where p_name <> ''", views=False)
def name_family(c):
    return c.datasets.where("name != ''").select("id", paths.name_family("name").alias("family"))


WORDS = """, words as (select id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '' and length(x) <= 40) as w from docs),
stats as (select count(*) as n, avg(len(w)) as mean from words),
tfs as (select id, len(w) as dl, len(list_filter(w, lambda x: x = 'apache')) as a, len(list_filter(w, lambda x: x = 'thing')) as b from words),
dfs as (select count(*) filter (a > 0) as da, count(*) filter (b > 0) as db from tfs),
bm as (select id as doc_id, round(ln(1 + (n - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * dl / mean)) + ln(1 + (n - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * dl / mean)), 6) as score from tfs, dfs, stats),
hits as (select * from bm where score > 0 order by score desc, doc_id limit 50)
"""


@register(WORDS + "select doc_id, score from hits")
def bm25_topk(c):
    """From the stored index."""
    return c.text_index.search("apache thing")


@register(WORDS + "select doc_id, score from hits")
def bm25_scan(c):
    """The same without an index, by one pass over the documents."""
    return search.bm25(c.docs, "apache thing")


def _first(vectors) -> list[float]:
    """The vector of the smallest id; none without vectors."""
    row = vectors.orderBy("id").first()
    return list(row["vector"]) if row else []


@register(""", q as (select embedding as v from embeddings order by vec_id limit 1)
select vec_id as id, round(list_cosine_similarity(embedding::double[], v::double[]), 5) as similarity from embeddings, q order by 2 desc, 1 limit 20""")
def cosine_topk(c):
    vectors = c.read("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return search.nearest(vectors, _first(vectors))


@register(WORDS + """, q as (select embedding as v from embeddings order by vec_id limit 1)
select doc_id, round(0.6 * score / greatest((select max(score) from hits), 1.0) + 0.4 * coalesce(list_cosine_similarity(embedding::double[], v::double[]), 0), 5) as score
from hits left join embeddings on vec_id = doc_id, q order by 2 desc, 1 limit 20""")
def hybrid_rerank(c):
    vectors = c.read("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return search.rerank(c.text_index.search("apache thing"), vectors, _first(vectors))


@register(WORDS + "select doc_id, term, count(*) as tf from (select id as doc_id, unnest(w) as term from words) group by all")
def term_postings(c):
    return search.postings(c.docs).select("doc_id", "term", "tf")


@register(""", own as (select lower(species) as s, lower(dataset_type) as t from dataset where id = 5),
pool as (select d.*, t from dataset d, own where lower(species) = s and id <> 5 order by updated_at desc, id limit 200),
scored as (select id, path, round(0.5 + case when t = 'promo' and lower(dataset_type) in ('economy', 'small') then 0.35 when lower(dataset_type) <> t then 0.15 else 0 end + case when confidence = 'high' then 0.05 else 0 end, 6)::double as score,
  'same species' || case when t = 'promo' and lower(dataset_type) in ('economy', 'small') then ', complementary dataset type' when lower(dataset_type) <> t then ', different dataset type' else '' end || case when confidence = 'high' then ', high-confidence species' else '' end as summary from pool)
select * from scored order by score desc, path limit 10""")
def suggest_datasets(c):
    return suggest.suggest(c.datasets, 5, 10, complements={"PROMO": ("ECONOMY", "SMALL")})


@register("select n_nationkey as id, n_name as name, 'region' as relation, 1.0::double as score from nation where n_regionkey = 2", views=False)
def relation_neighbours(c):
    nations = c.read("nation")
    edges = nations.select((F.col("n_regionkey") + 1000).alias("a"), F.col("n_nationkey").alias("b"), F.lit("region").alias("relation"), F.lit(1.0).alias("score"))
    return relational.neighbours(edges, nations.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")), 1002)


@register("select p_partkey as id, cast(p_size % 7 as bigint) * 1000000000 + p_partkey as cursor, cast(p_size % 7 as bigint) as rank, p_partkey as last_id from part", views=False)
def cursor_roundtrip(c):
    rows = c.read("part").select(F.col("p_partkey").alias("id"), relational.pack_cursor(F.col("p_size") % 7, F.col("p_partkey")).alias("cursor"))
    rank, last = relational.unpack_cursor(F.col("cursor"))
    return rows.select("id", "cursor", rank.alias("rank"), last.alias("last_id"))


@register("select regexp_replace(regexp_replace(regexp_replace(p_name, '[0-9]+$', ''), '\\.+$', ''), '_+$', '') as pattern, count(*) as count from part group by 1 having count(*) >= 3", views=False)
def correction_rules(c):
    return relational.correction_rules(c.read("part").select(paths.version_pattern("p_name").alias("pattern")))


@register("select user_id, event_type, ts from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) where r = 1 and event_type <> 'error'", views=False)
def stream_last_state(c):
    return changes.last_state(c.read("events"), "user_id", "ts", "event_id").where("event_type != 'error'").select("user_id", "event_type", "ts")


@register("select user_id, count(*) as n, count(*) // 10 as fires from events group by 1", views=False)
def stream_count_triggers(c):
    return changes.count_triggers(c.read("events"), "user_id")


@register(UP + ", targets as (select distinct '/data/en' as path) select distinct dir as path from up where dir <> up.path and not (dir = '/data/en' or starts_with(dir, '/data/en/'))")
def scan_skips(c):
    dirs = discovery.directories(c.docs).select("path")
    return discovery.skips(dirs, dirs.where("path = '/data/en'"))


@register(UP + "select distinct dir as path, len(string_split(dir, '/')) - 1 as depth from up where dir <> up.path")
def all_directories(c):
    return discovery.directories(c.docs)


@register("""select id, source_server || ':' || p as shown from (select id, source_server, case when size % 7 = 1 then path || '.tmp' when size % 7 = 2 then replace(path, '/f', '/.f') else path end as p from files)
where not starts_with(p, '/srv/3') and not ends_with(p, '.tmp') and not contains(p, '/.f')""")
def exclude_and_show(c):
    odd = F.col("size") % 7
    p = F.when(odd == 1, F.concat("path", F.lit(".tmp"))).when(odd == 2, F.replace("path", F.lit("/f"), F.lit("/.f"))).otherwise(F.col("path"))
    rows = c.files.withColumn("path", p)
    return rows.where(~paths.excluded("path", ["*.tmp", ".*", "/srv/3"])).select("id", paths.server_path("source_server", "path").alias("shown"))


@register("""select n.name, min(f.id) as file_id from (select distinct 'f' || cast(id as varchar) || '.dat' as name from files) n
join files f on split_part(f.path, '/', -1) = n.name and ends_with(f.path, n.name) group by 1""")
def response_file_match(c):
    names = c.files.select(F.concat(F.lit("f"), F.col("id").cast("string"), F.lit(".dat")).alias("name"))
    return containment.first_by_suffix(c.files, names)
