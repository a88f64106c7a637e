"""Registered queries of the write path: datasets, assets, links, metadata, snapshots, projects, scans, and the stored index."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwell.functions import formats
from tarnwell.operators import datasets, endpoints, ingest, projects, search, trees
from tarnwell.plans.queries import PARTS, UP
from tarnwell.plans.registry import register

NOW = 2_000_000_000

# Datasets and assets


@register(f""", new as (select path, 'renamed ' || name as name, 'updated' as species from dataset where confidence = 'high' union all select '/new/' || n_name, n_name, null from nation)
select coalesce(d.id, (select max(id) from dataset) + row_number() over (partition by d.id is null order by n.path)) as id, coalesce(d.path, n.path) as path,
  coalesce(n.name, d.name) as name, case when n.path is null then d.species else n.species end as species, d.dataset_type, case when n.path is null then d.updated_at else {NOW} end as updated_at
from dataset d full join new n on d.path = n.path""")
def put_datasets(c):
    old = c.datasets.where("confidence = 'high'").select("path", F.concat(F.lit("renamed "), "name").alias("name"), F.lit("updated").alias("species"))
    new = old.union(c.read("nation").select(F.concat(F.lit("/new/"), "n_name"), "n_name", F.lit(None).cast("string")))
    return datasets.put_datasets(c.datasets, new, NOW).select("id", "path", "name", "species", "dataset_type", "updated_at")


@register("""select id, dataset_id, name, asset_type from asset union all
select (select max(id) from asset) + row_number() over (order by n_nationkey, n_name), n_nationkey, n_name, 'region' from nation""")
def put_assets(c):
    new = c.read("nation").select(F.col("n_nationkey").cast("long").alias("dataset_id"), F.col("n_name").alias("name"), F.lit("region").alias("asset_type"))
    return datasets.put_assets(c.assets, new).select("id", "dataset_id", "name", "asset_type")


@register("select asset_id, file_id, case when role = 'A' then 'primary' else role end as role from asset_file union all select n_nationkey, n_regionkey, 'index' from nation")
def link_files(c):
    changed = c.links.where("role = 'A'").select("asset_id", "file_id", F.lit("primary").alias("role"))
    fresh = c.read("nation").select(F.col("n_nationkey").cast("long"), F.col("n_regionkey").cast("long"), F.lit("index"))
    return datasets.link_files(c.links, changed.union(fresh))


@register(""", pairs as (select distinct l_partkey as dataset_id, l_orderkey as file_id from lineitem where l_returnflag = 'R')
select (select max(id) from asset) + dense_rank() over (order by dataset_id) as asset_id, dataset_id, file_id, 'auxiliary' as role from pairs""")
def link_auxiliary(c):
    pairs = c.read("lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("dataset_id"), F.col("l_orderkey").alias("file_id"))
    assets, links = datasets.link_auxiliary(c.assets, c.links.limit(0), pairs)
    return links.join(assets.where(F.col("name") == datasets.AUXILIARY).select(F.col("id").alias("asset_id"), "dataset_id"), "asset_id").select("asset_id", "dataset_id", "file_id", "role")


@register("select (select count(*) from asset) as assets, (select count(*) from asset_file) as links")
def link_counts(c):
    return datasets.link_counts(c.assets, c.links)


@register("""select d.id, d.name, d.dataset_type, count(distinct a.id) as asset_count, count(distinct af.file_id) as file_count
from dataset d left join asset a on a.dataset_id = d.id left join asset_file af on af.asset_id = a.id group by all""")
def dataset_list(c):
    rows = endpoints.dataset_list({"dataset": c.datasets, "asset": c.assets, "asset_file": c.links}, c.parts("lineitem"))
    return rows.select("id", "name", "dataset_type", "asset_count", "file_count")


# Metadata


def _told(c):
    return c.files.where("species IS NOT NULL").select("id", F.lit("WGS").alias("assay_type"), F.when(F.col("size") % 2 == 0, "maize").alias("species"), F.lit(None).cast("string").alias("project"), F.array(F.lit("new"), F.col("source_server")).alias("tags"))


def _tags(c):
    return c.read("orders").join(c.read("customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("file_id"), F.col("c_mktsegment").alias("tag"))


@register(f"""select id, case when species is null then null when size % 2 = 0 then 'maize' end as species, case when species is not null then 'WGS' end as assay_type,
case when species is null then bio_metadata else '{{"assay_type":"WGS",' || case when size % 2 = 0 then '"species":"maize",' else '' end || '"tags":["new","' || source_server || '"]}}' end as bio_metadata,
case when species is null then updated_at else {NOW} end as updated_at from files""")
def metadata_files(c):
    return datasets.put_metadata(c.files, _tags(c), _told(c), NOW)[0].select("id", "species", "assay_type", "bio_metadata", "updated_at")


@register("""select o_orderkey as file_id, c_mktsegment as tag from orders join customer on c_custkey = o_custkey where o_orderkey in (select id from files where species is null) union all
select id, unnest(['new', source_server]) from files where species is not null""")
def metadata_tags(c):
    return datasets.put_metadata(c.files, _tags(c), _told(c), NOW)[1].select("file_id", "tag")


@register("select id, dataset_type as assay_type, species, case when id % 2 = 0 then name end as extra, case when id % 3 = 0 then null else 0 end as tags from dataset")
def metadata_roundtrip(c):
    k = F.col("id")
    extra = F.when(k % 2 == 0, F.create_map(F.lit("tissue"), F.col("name"), F.lit("species"), F.lit("never")))
    text = datasets.metadata_json(F.col("dataset_type"), F.col("species"), F.lit(None).cast("string"), F.array().cast("array<string>"), extra)
    rows = c.datasets.select("id", datasets.metadata_fields(text).alias("m"), datasets.metadata_fields(F.when(k % 3 == 0, F.lit("no JSON")).otherwise(F.lit("{}"))).alias("bad"))
    return rows.select("id", "m.assay_type", "m.species", F.col("m.extra")["tissue"].alias("extra"), F.when(F.col("bad").isNotNull(), F.size("bad.tags")).alias("tags"))


@register(""", linked as (select distinct af.file_id, d.dataset_type || ' ' || d.species as extra from asset_file af join asset a on af.asset_id = a.id join dataset d on d.id = a.dataset_id)
select f.id, f.path, f.path || ' ' || max(extra) as metadata from linked join files f on f.id = file_id group by f.id, f.path""")
def enrichment_texts(c):
    return datasets.enrichment_texts(c.links, c.assets, c.datasets, c.files)


@register("""select file_id, updated_at, vector from (select *, row_number() over (partition by file_id order by updated_at desc) as r from (
  select vec_id as file_id, 1 as updated_at, embedding[1]::double as vector from embeddings union all select vec_id, 2, embedding[2]::double from embeddings where label > 3)) where r = 1""")
def store_vectors(c):
    e = c.read("embeddings").select(F.col("vec_id").alias("file_id"), F.col("embedding").alias("vector"), "label")
    old = e.select("file_id", "vector", F.lit(1).cast("long").alias("updated_at"))
    new = e.where("label > 3").select("file_id", F.slice("vector", 2, 1).alias("vector"), F.lit(2).cast("long").alias("updated_at"))
    rows = datasets.store_vectors(old, new)
    return rows.select("file_id", "updated_at", F.get("vector", F.lit(0)).cast("double").alias("vector"))


# Snapshots


@register("select id, created_at, 'manual' as trigger, summary from snapshot union all select max(id) + 1, 5, 'inference', 'new' from snapshot")
def create_snapshot(c):
    return datasets.create_snapshot(c.snapshots, "inference", "new", 5)


@register("select id, strftime(make_timestamp(created_at * 1000000), '%H:%M:%S') as time, 'manual' as trigger, summary from snapshot order by id desc limit 20")
def snapshot_list(c):
    return datasets.snapshot_list(c.snapshots)


@register("select snapshot_id, count(*) as datasets from dataset where snapshot_id is not null group by 1")
def snapshot_counts(c):
    return datasets.snapshot_counts(c.datasets)


@register("select id, case when confidence = 'low' then 9 else snapshot_id end as snapshot_id from dataset")
def set_dataset_snapshot(c):
    return datasets.stamp(c.datasets, c.datasets.where("confidence = 'low'"), 9).select("id", "snapshot_id")


@register("""select '    + ' || n as line from (select n_name as n from nation order by 1 limit 10) union all select '    ... +' || (count(*) - 10) || ' more' from nation having count(*) > 10""")
def overflow_lines(c):
    return datasets.overflow(c.read("nation"), "n_name", "+")


# Projects


@register("select id, name, species from project union all select (select max(id) from project) + row_number() over (order by r_name), r_name, 'new' from region")
def project_insert(c):
    return projects.insert(c.projects, c.read("region").select(F.col("r_name").alias("name"), F.lit("new").alias("species")), NOW).select("id", "name", "species")


@register("select project_id, file_id from project_file union select 1, id from files where species is not null")
def project_links(c):
    return projects.link(c.project_files, c.files.where("species IS NOT NULL").select(F.lit(1).alias("project_id"), F.col("id").alias("file_id")))


@register("select a, b, relation, case when score = 1 then 0.5 else score end as score from relation union all select s_suppkey, s_suppkey, 'self', 1 from supplier")
def project_relations(c):
    new = c.relations.where("score = 1").withColumn("score", F.lit(0.5)).union(c.projects.select("id", "id", F.lit("self"), F.lit(1.0)))
    return projects.relate(c.relations, new)


@register("select id, coalesce(species, 'rice') as species, case when species is null then 'user' end as species_source, case when species is null then 'high' else 'low' end as species_confidence from project")
def project_species(c):
    changes = c.projects.where("species IS NULL").select("id", F.lit("rice").alias("species"), F.lit("user").alias("source"), F.lit("high").alias("confidence"))
    return projects.update_species(c.projects, changes, NOW).select("id", "species", "species_source", "species_confidence")


@register("select min(id) as id, name from project where name = (select max(name) from project) group by name")
def project_by_name(c):
    name = c.projects.agg(F.max("name")).first()[0]
    return projects.by_name(c.projects, name).select("id", "name")


@register("""select id, name, '?' as assay, coalesce(species, '?') || ' (low)' as species, '?' as server, count(file_id) as files from project left join project_file on project_id = id group by id, name, species""")
def project_list(c):
    return projects.listing(c.projects, c.project_files)


@register("""select path, arg_min(p.name, p.id) as project from files f join project_file pf on pf.file_id = f.id join project p on p.id = pf.project_id where f.species is not null group by path""")
def project_of_paths(c):
    return projects.of_paths(c.projects, c.project_files, c.files, c.files.where("species IS NOT NULL").select("path"))


NESTED_DIRS = UP + ", pd as (select 1 as project_id, '/data/' || lang as dir from docs union select 2, '/data/' || lang || '/' || source from docs)"


def _directories(c):
    top, low = F.concat(F.lit("/data/"), "lang"), F.concat(F.lit("/data/"), "lang", F.lit("/"), "source")
    some = c.docs.select(F.lit(1).alias("id"), top.alias("dir")).union(c.docs.select(F.lit(2), low))
    return some.groupBy("id").agg(F.collect_set("dir").alias("dirs"))


@register(NESTED_DIRS + " select distinct project_id, id as file_id from up join pd on up.dir = pd.dir")
def project_files_below(c):
    return projects.files_below(_directories(c), c.docs)


@register(NESTED_DIRS + " select id as file_id, min(project_id) as project_id from up join pd on up.dir = pd.dir group by id")
def project_first_directory(c):
    return projects.first_directory(_directories(c), c.docs)


@register("""select s_suppkey as id from supplier where s_suppkey % 4 = 3 or exists (select 1 from (select unnest([s_nationkey, s_suppkey % 7]) as d) where d not in (select r_regionkey from region))""", views=False)
def project_uncovered(c):
    dirs = lambda *cols: F.array(*[F.col(x).cast("string") if isinstance(x, str) else x.cast("string") for x in cols])
    first = c.read("supplier").select(F.col("s_suppkey").alias("id"), dirs("s_nationkey", F.col("s_suppkey") % 7).alias("dirs"), (F.col("s_suppkey") % 4 == 3).alias("skip"))
    second = c.read("region").select(F.col("r_regionkey").cast("long").alias("id"), dirs("r_regionkey").alias("dirs"), F.lit(False).alias("skip"))
    return projects.uncovered(first, second).select("id")


@register("select name, string_agg(id, '|' order by id) as dirs, count(*) as projects from project group by name")
def project_by_names(c):
    rows = projects.by_names(c.projects.select("id", "name", F.array(F.col("id").cast("string")).alias("dirs")))
    return rows.select("name", F.array_join("dirs", "|").alias("dirs"), "projects")


@register("""select min(id) as id, arg_min(name, id) as name, species, string_agg(id, '|' order by id) as dirs, string_agg(summary, '; ' order by id) as summary from project where species is not null group by species
union all select id, name, null, cast(id as varchar), summary from project where species is null""")
def project_merged(c):
    rows = projects.merged(c.projects.withColumn("dirs", F.array(F.col("id").cast("string"))))
    return rows.select("id", "name", "species", F.array_join("dirs", "|").alias("dirs"), "summary")


@register("""select a, b, relation, score, rank from (select *, row_number() over (partition by a order by score desc, b) as rank from (select a, b, relation, score from relation union all select b, a, relation, score from relation)) where rank <= 10""")
def project_top_related(c):
    return projects.top_related(c.relations)


# Scans


@register(PARTS + """select id, case when id % 8 in (0, 6) then 'fastq' when id % 8 = 1 then 'bam' when id % 8 = 4 then 'hdf5' when id % 8 = 5 then 'annotation' else 'generic' end as interpreter,
case when id % 8 = 5 then 'annotation' end as assay_type, source as project, case when id % 8 = 6 then 'paired-end' when id % 8 = 0 then 'single-end' when id % 8 = 5 then 'reference' else '' end as tags from docs""")
def interpretations(c):
    rows = ingest.interpretations(c.docs.withColumn("format", formats.detect("path")))
    return rows.select("id", "interpreter", "assay_type", "project", F.array_join("tags", "|").alias("tags"))


@register(PARTS + """, kids as (select distinct dir, name from named union select distinct regexp_replace(dir, '/[^/]*$', ''), split_part(dir, '/', -1) from named
  union select '/data', lang from docs) select dir, string_agg(name, '|' order by name) as entries from kids group by dir""")
def sibling_lists(c):
    return ingest.siblings(c.docs).select("dir", F.array_join("entries", "|").alias("entries"))


@register(PARTS + """select path as file_path, source || '|' || lang || '|data' as directory_tree, case id % 8 when 0 then 'gzip' when 1 then 'BAM' when 2 then 'gzip' when 3 then 'CSV' when 4 then 'HDF5' when 5 then 'GFF' when 6 then 'FASTQ' else 'text' end as format_tags from extended""")
def file_contexts(c):
    rows = ingest.contexts(c.docs.withColumn("format", formats.detect("path")))
    return rows.select("file_path", F.array_join("directory_tree", "|").alias("directory_tree"), F.array_join("format_tags", "|").alias("format_tags"))


TREE = PARTS + """, k as (select dir, ext, count(*) as n, row_number() over (partition by dir order by count(*) desc, ext) as r from extended group by dir, ext),
own as (select dir as path, count(*) as files from extended group by 1), tops as (select dir as path, string_agg(ext || '×' || n, ',' order by r) filter (r <= 5) as types from k group by 1),
l as (select path, 2 as depth, files, 0 as subdirs, types from own join tops using (path) union all
  select '/data/' || lang, 1, 0, count(distinct source), '' from docs group by 1 union all select '/data', 0, 0, count(distinct lang), '' from docs)
"""


@register(TREE + "select * from l")
def light_tree(c):
    return trees.light(c.docs, "/data")


PATTERN = """, e as (select dir, ext, name, row_number() over (partition by dir, ext order by name) as r from extended),
m as (select dir as path, ext, count(*) as n, string_agg(name, ', ' order by name) filter (r <= 5) as names from e group by dir, ext),
pat as (select path, string_agg(ext || '×' || n || ' [' || names || ']', '; ' order by ext) as pattern from m group by path having sum(n) > 20)
"""


@register(PARTS + PATTERN.replace(", e as", ", e as", 1) + "select path, pattern from pat")
def compressed_dirs(c):
    return trees.compressed(c.docs, 20)


@register(TREE + PATTERN + """, s as (select dir as path, string_agg(name, ', ' order by name) as names from (select dir, name, row_number() over (partition by dir order by name) as r from extended) where r <= 5 group by dir)
select path, repeat('  ', depth) || '📁 ' || split_part(path, '/', -1) || case
  when subdirs > 0 then '/  (' || files || ' files: ' || types || ', ' || subdirs || ' subdirs)' || coalesce(' [' || pattern || ']', '')
  when files > 40 then '  (LARGE FLAT DIR' || coalesce(' — ' || pattern, '') || ' — skip deep listing)'
  when pattern is not null then '  (' || pattern || ')' else '  (' || files || ' files: ' || types || ')  e.g. ' || names end as line
from l left join pat using (path) left join s using (path)""")
def prompt_tree(c):
    return trees.prompt_lines(c.docs, "/data", 4, 20, 40)


# The stored index

FULLTEXT = """, field as (
  select id, 'metadata' as f, text as t from docs union all select id, 'path', path from docs union all select id, 'tags', lang || ' ' || source from docs
), words as (
  select id, f, list_filter(regexp_split_to_array(lower(t), '[^\\p{L}\\p{N}]+'), lambda x: x <> '' and length(x) <= 40) as w from field
), stat as (select f, count(*) as n, sum(len(w)) / count(*) as mean from words group by f),
tf as (select id, f, q, len(w) as dl, len(list_filter(w, lambda x: x = q)) as tf from words, (select unnest(['en', 'thing', 'bam']) as q)),
df as (select f, q, count(*) as df from tf where tf > 0 group by f, q),
part as (select id, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean)) as s from tf join df using (f, q) join stat using (f) where tf > 0),
hits as (select id as doc_id, round(sum(s), 6) as score from part group by id order by 2 desc, 1 limit {k})
"""


@register(FULLTEXT.replace("{k}", "50") + "select doc_id, score from hits")
def fulltext_fields(c):
    return c.text_index.search("en thing bam")


@register("select count(*) as docs from documents", views=False)
def index_num_docs(c):
    return c.spark.createDataFrame([(c.text_index.num_docs(),)], "docs long")


RESULTS = FULLTEXT.replace("{k}", "50") + """, member as (select id % 7 as project_id, 'p' || (id % 7) as name, id as file_id from docs where length(source) % 2 = 0)
select doc_id, score, path, source as file_type, null::varchar as assay_type, lang as species, coalesce('[project: ' || m.name || '] ', '') || lang as summary
from hits join docs on id = doc_id left join member m on m.file_id = doc_id"""


def _as_files(c):
    return c.docs.select("id", "path", F.col("source").alias("format"), F.lit(None).cast("string").alias("assay_type"), F.col("lang").alias("species"))


@register(RESULTS)
def search_results(c):
    k = F.col("id") % 7
    member = c.docs.where(F.length("source") % 2 == 0).select(k.alias("project_id"), F.concat(F.lit("p"), k.cast("string")).alias("name"), F.col("id").alias("file_id"))
    return search.hydrate(c.text_index.search("en thing bam"), _as_files(c), member)


@register(FULLTEXT.replace("['en', 'thing', 'bam']", "['apache']").replace("{k}", "100") + "select doc_id, score, path from hits join docs on id = doc_id")
def list_by_category(c):
    return search.hydrate(c.text_index.search("apache", 100), _as_files(c)).select("doc_id", "score", "path")
