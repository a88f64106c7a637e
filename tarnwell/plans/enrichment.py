"""Registered queries of the enrichment side: batches, answers, review, plugins, trees, embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwell.functions import embed, formats, paths, plugins, text
from tarnwell.operators import discovery, inference, search, trees
from tarnwell.plans.catalogue import VIEWS
from tarnwell.plans.queries import NESTED, PARTS, UP
from tarnwell.plans.registry import register

FOLDED = VIEWS.replace("with dataset", "with recursive dataset", 1) + """, c as (
  select species as root, path, length(summary) * 40 as size, id % 11 = 0 as kids, row_number() over (partition by species order by path) as i from dataset
), fold as (
  select root, path, i, cast(0 as bigint) as batch, 1 as held, 500 + size as total from c where i = 1 union all
  select c.root, c.path, c.i, batch + (closes)::int, case when closes then 1 else held + 1 end, case when closes then 500 + c.size else total + c.size end
  from (select f.*, c.size as n, not kids and (total + c.size > 12000 or held >= 20) as closes from fold f join c on c.root = f.root and c.i = f.i + 1) f join c on c.root = f.root and c.i = f.i + 1
) select root, path, batch from fold"""


@register(FOLDED, views=False)
def prompt_batches(c):
    rows = c.datasets.select(F.col("species").alias("root"), "path", (F.length("summary") * 40).alias("size"), (F.col("id") % 11 == 0).alias("kids"))
    return inference.batches(rows, "root", "path", "size", "kids", most=20, base=500)


@register("select path, (row_number() over (order by path) - 1) // 100 as chunk from dataset")
def container_chunks(c):
    return inference.chunks(c.datasets.select("path"), ["path"])


@register("""select r_regionkey as key, (row_number() over (partition by n_regionkey order by n_nationkey) - 1)::int as pos, n_name as name, '/n/' || n_name || '|/m' as dirs,
case when n_nationkey % 3 = 0 then null else r_name end as species from nation join region on n_regionkey = r_regionkey where r_regionkey <> 4""", views=False)
def answer_projects(c):
    old = F.col("n_regionkey") % 2 == 0
    dirs = F.array(F.concat(F.lit("/n/"), "n_name"), F.lit("/m"))
    rows = c.read("nation").join(c.read("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
        "r_regionkey", "n_nationkey",
        F.struct(
            F.when(old, F.col("n_name")).alias("id"), F.when(~old, F.col("n_name")).alias("name"), F.when(old, dirs).alias("paths"), F.when(~old, dirs).alias("dirs"),
            F.when(F.col("n_nationkey") % 3 != 0, F.col("r_name")).alias("species"),
        ).alias("p"),
    )
    packed = rows.groupBy(F.col("r_regionkey").alias("key")).agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "p")))["p"].alias("projects"))
    text = F.when(F.col("key") == 4, F.lit("no JSON")).otherwise(F.to_json(F.struct("projects")))
    projects, _ = inference.parse_projects(packed.select("key", text.alias("response")))
    return projects.select("key", "pos", "name", F.array_join("dirs", "|").alias("dirs"), "species")


@register("""select path, 'ds' as asset, f.name as said, min(f.id) as file_id from dataset d join (select id, dataset_id, name from asset) f on f.dataset_id = d.id
where f.id in (select min(id) from asset group by dataset_id, right(name, 1)) group by all""")
def answer_links(c):
    d = c.datasets.join(inference.chunks(c.datasets.select("path"), ["path"]), "path").select("id", "path", F.col("chunk").alias("batch"))
    a = c.assets.select("dataset_id", F.col("id").alias("file_id"), F.col("name").alias("file_path"))
    files = d.join(a, F.col("id") == F.col("dataset_id")).select("path", "file_id", "file_path", "batch")
    said = files.groupBy("batch", "path", F.substring("file_path", -1, 1).alias("end")).agg(F.count(F.lit(1)).alias("k"))
    assets = said.groupBy("batch", "path").agg(F.sort_array(F.collect_list("end")).alias("ends"))
    name = F.element_at(F.split("path", "/"), -1)
    told = F.struct(
        name.alias("name"), F.lit("genome").alias("type"),
        F.array(F.struct(F.lit("ds").alias("name"), F.transform("ends", lambda e: F.struct(e.alias("path"), F.lit("primary").alias("role"))).alias("files"))).alias("assets"),
    )
    answers = assets.select("batch", told.alias("d")).groupBy("batch").agg(F.to_json(F.struct(F.sort_array(F.collect_list("d")).alias("datasets"))).alias("response"))
    members = d.select("batch", F.col("id").alias("pos"), F.col("path").alias("name"), "path")
    _, links, _ = inference.parse_datasets(answers, members, files.drop("batch"))
    named = links.join(files.select("path", "file_id", "file_path"), ["path", "file_id"])
    return named.select("path", "asset", F.col("file_path").alias("said"), "file_id")


@register("select name as project, 'species' as field, species as current_value, confidence, 1700000000 as timestamp from dataset where confidence in ('low', 'medium')")
def pending_review(c):
    return inference.pending_review(c.datasets.withColumn("species_confidence", F.col("confidence")), 1_700_000_000)


@register("select id, name, species, min(id) over (partition by species, left(name, 4)) as base from dataset")
def merged_projects(c):
    return inference.merge_projects(c.datasets.select("id", "name", "species"))


@register("select '- ' || p as line from (select regexp_replace(regexp_replace(regexp_replace(p_name, '[0-9]+$', ''), '\\.+$', ''), '_+$', '') as p, count(*) as n from part group by 1) where n >= 3", views=False)
def rule_lines(c):
    return inference.rule_lines(c.read("part").groupBy(paths.version_pattern("p_name").alias("pattern")).agg(F.count(F.lit(1)).alias("count")))


def _case(rules) -> str:
    return "case " + " ".join(f"when {' or '.join(f'contains(low, $q{w}$q)'.replace('$q', chr(39)) for w in words.split())} then '{name}'" for name, words in rules) + " end"


@register(f"select id, {_case(plugins.ASSAYS)} as assay_type, {_case(plugins.SPECIES)} as species from (select id, lower(text) as low from docs)")
def path_keywords(c):
    return c.docs.select("id", plugins.ladder("text", plugins.ASSAYS).alias("assay_type"), plugins.ladder("text", plugins.SPECIES).alias("species"))


@register("select id, case when id % 8 = 1 then 'late' when id % 8 in (1, 3) then 'table' else 'plain' end as file_type from docs")
def plugin_dispatch(c):
    kind = lambda end, name: lambda path, magic: F.when(path.endswith(end), F.struct(F.lit(name).alias("file_type"), F.lit("application/octet-stream").alias("mime")))
    known = plugins.Registry()
    known.add(plugins.Detector("low", kind(".bam", "never"), 10))
    known.add(plugins.Detector("high", kind(".bam", "late"), 90))
    known.add(plugins.Detector("middle", kind(".csv", "table")))
    plain = F.struct(F.lit("plain").alias("file_type"), F.lit("text/plain").alias("mime"))
    return c.docs.select("id", known.detect(F.col("path"), F.lit(None).cast("binary"), plain)["file_type"].alias("file_type"))


@register(PARTS + """, n as (select dir, ext, count(*) as n, min(name) as sample, row_number() over (partition by dir order by ext) as r from extended group by dir, ext)
select dir, cast(sum(n) as bigint) as files, string_agg('.' || ext || '×' || n, ', ' order by ext) filter (r <= 3) || case when count(*) > 3 then ', ... +' || (count(*) - 3) || ' more types' else '' end as types, min(sample) as sample from n group by dir""")
def file_list(c):
    return trees.file_list(c.docs, 3)


@register(UP + "select dir as path, i - 1 as depth, count(*) as files, cast(sum(size) as bigint) as bytes from up where dir <> path and i <= 3 group by 1, 2")
def tree_depth2(c):
    return trees.bounded(c.docs, 2)


@register("select * from (select *, row_number() over (partition by parent order by files desc, dir) as rank from (select regexp_replace(path, '/[^/]*$', '') as dir, regexp_replace(path, '/[^/]*/[^/]*$', '') as parent, count(*) as files from files group by 1, 2)) where rank <= 15")
def top_subdirs(c):
    return trees.top_subdirs(c.files)


@register(PARTS + """, d as (select lang, dir, bool_or(ext in ('fastq.gz', 'bam', 'vcf.gz', 'h5', 'gtf', 'fq')) as bio from extended group by 1, 2),
l as (select lang, count(*) as sub, count(*) filter (bio) as bio from d group by 1)
select '/data' as path, 'EMPTY data/ (f:0 none sub:' || count(*) || ') | sub:' || count(*) || ' bio:0' as line from l union all
select '/data/' || lang, '  BIO↑ ' || lang || '/ (auto:0 files sub:' || bio || '/' || sub || ')' from l""")
def tree_lines(c):
    return trees.annotated(c.docs, "/data")


@register("select id, 'f' || id || '.dat dat ' || coalesce('rice ', '') || (string_split(path, '/'))[-2] || ' ' || (string_split(path, '/'))[-3] as text from files where species is not null and not deleted")
def embedding_text(c):
    up = paths.ancestor_names("path", 2)
    rows = c.files.where("species IS NOT NULL AND NOT deleted")
    return rows.select("id", F.concat_ws(" ", paths.base_name("path"), "format", "assay_type", "species", up).alias("text"))


@register("select id, lpad(printf('%.1f', size / 1048576), 8, ' ') || ' MB  [' || coalesce(assay_type, '-') || ']  ' || path as line from files where not deleted")
def list_lines(c):
    mb = F.abs("size") / 1048576
    # A half goes to the even digit, as in C; the formatter alone would take it up.
    shown = F.bround(mb, 1) * F.when(F.col("size") < 0, -1.0).otherwise(1.0)
    return c.files.where("NOT deleted").select("id", F.format_string("%8.1f MB  [%s]  %s", shown, F.coalesce("assay_type", F.lit("-")), "path").alias("line"))


@register(None)
def hash_embeddings(c):
    """Hashed embeddings of the metadata texts; no SQL has the hash, so tests compare it with the interpreter's own."""
    return embed.embed(embedding_text(c), "id", "text")


@register("select id, replace(ltrim(path[4:], '/'), '/', '_') as name from dataset")
def dataset_names(c):
    return c.datasets.select("id", paths.dataset_name("path", "/ds").alias("name"))


@register("select id, case when length(summary) <= 20 then summary else left(summary, 17) || '...' end as short, concat_ws(', ', species, case when confidence = 'high' then dataset_type end, name) as line from dataset")
def result_lines(c):
    line = text.summary("species", F.when(F.col("confidence") == "high", F.col("dataset_type")), "name")
    return c.datasets.select("id", text.truncated("summary", 20).alias("short"), line.alias("line"))


@register(PARTS + r""", r as (select dir, name, row_number() over (partition by dir order by name) as r from extended),
k as (select *, regexp_matches(name, '\.(fastq\.gz|bam|vcf\.gz|h5|gtf)$') as key from r where r <= 8), o as (select *, row_number() over (partition by dir, key order by name) as n from k),
j as (select dir, string_agg(name, ', ' order by key desc, name) as s from o where key or n <= 5 group by dir)
select dir, case when length(s) <= 60 then s else left(s, 57) || '...' end as shown from j""")
def sample_display(c):
    return discovery.sample_display(c.docs, most=60)


@register(PARTS + """, b as (select dir as path, bool_or(ext in ('fastq.gz', 'bam', 'vcf.gz', 'h5', 'gtf', 'fq')) as bio from extended group by 1),
t as (select path from b where bio union select '/data/' || lang from docs where lang in ('en', 'xx'))
select path, case when path = '/data/en' then 'genome' else 'other' end as dataset_type, case when path = '/data/en' then 'high' else 'low' end as confidence from t""")
def dataset_candidates(c):
    hints = c.docs.where("lang = 'en'").select(F.lit("/data/en").alias("path"), F.lit("genome").alias("dataset_type"), F.lit("high").alias("confidence")).distinct()
    return discovery.candidates(discovery.targets(discovery.signals(c.docs, 1), hints), hints)


@register(PARTS + """, d as (select '/data/' || lang as path, dir, bool_or(ext in ('fastq.gz', 'bam', 'vcf.gz', 'h5', 'gtf', 'fq')) as bio from extended group by 1, 2)
select path, count(*) as subdirs from d group by path having bool_or(bio)""")
def ambiguous_containers(c):
    return discovery.ambiguous(c.docs)


@register(NESTED + "select a.path as parent, b.path as child from ds a join ds b on regexp_replace(b.path, '/[^/]*$', '') = a.path")
def candidate_children(c):
    return discovery.children(c.dirs_as_datasets)


@register(""", d as (select distinct lang, source, '/data/' || lang || '/' || source as dir from docs)
select dir, concat_ws('|', case when length(source) % 2 = 0 then dir || '/README.md' end, case when lang in ('en', 'de') then '/data/' || lang || '/design.csv' end, case when lang = 'en' then '/data/en/config.yml' end) as found from d
where length(source) % 2 = 0 or lang in ('en', 'de') union all
select '/data/' || lang, '/data/' || lang || '/design.csv' || case when lang = 'en' then '|/data/en/config.yml' else '' end from d where lang in ('en', 'de') group by lang""")
def metadata_near(c):
    top = F.concat(F.lit("/data/"), "lang")
    low = c.docs.where(F.length("source") % 2 == 0).select(F.concat(top, F.lit("/"), "source", F.lit("/README.md")).alias("path"))
    high = c.docs.where("lang IN ('en', 'de')").select(F.concat(top, F.lit("/design.csv")).alias("path"))
    more = c.docs.where("lang = 'en'").select(F.lit("/data/en/config.yml").alias("path"))
    found = discovery.metadata_near(c.docs.select("path").union(low).union(high).union(more).distinct())
    return found.select("dir", F.array_join("metadata_files", "|").alias("found"))


@register("""select id, score from (select id, case when contains(lower(path), 'd') then 3 else 0 end + case when contains(lower(bio_metadata), 'd') then 2 else 0 end + case when contains(format, 'd') then 1 else 0 end as score
from files where not deleted) where score > 0 order by score desc, id limit 50""")
def weighted_search(c):
    return search.weighted(c.files, "D")


@register("""select id, score from (select id, case when contains(lower(path), '/f1') then 3 else 0 end as score from files where not deleted) where score > 0 order by score desc, id limit 50""")
def substring_search(c):
    """The weighted search by stored trigrams."""
    return search.weighted(c.trigrams.narrow(c.files, "/F1"), "/F1")


@register("""select id, case id % 8 when 0 then 'FASTA' when 1 then 'FASTQ' when 2 then 'SAM' when 3 then 'png' when 4 then 'HDF5' when 5 then 'GFF' when 6 then 'FASTQ' end as file_type,
case when id % 8 < 3 then 'text/plain' when id % 8 < 7 then 'application/octet-stream' end as mime from docs""")
def second_detector(c):
    kinds = ("3E63687231", "40726561", "40535109", "89504E470D0A1A0A", "", "", "", "00")
    magic = F.unhex(F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("id") % 8 + 1).cast("int")))
    path = F.regexp_replace("path", r"\.txt$", ".unknown")
    return c.docs.select("id", formats.second_detect(path, magic).alias("f")).select("id", "f.file_type", "f.mime")
