"""The sample tables seen as a catalogue, as DataFrames and as the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnwell.operators.fulltext import TextIndex
from tarnwell.operators.substring import Trigrams
from tarnwell.sources.store import file_bytes, fingerprint, scratch_folder

#: Bytes of a table's files that one task of a shuffle takes.
PART = 4 << 20
EXTENSIONS = (".fastq.gz", ".bam", ".vcf.gz", ".csv", ".h5", ".gtf", "_R1.fq", ".txt")

VIEWS = """
with dataset as (
  select p_partkey as id, p_name as name, '/ds/' || p_brand || '/' || cast(p_size % 7 as varchar) || '/p' || cast(p_partkey as varchar) as path,
    p_type as dataset_type, p_brand as species, case when p_size > 25 then 'high' when p_size > 10 then 'medium' else 'low' end as confidence,
    p_name || ' ' || p_type as summary, p_partkey * 10 as updated_at, case when p_size % 5 = 0 then null else p_size % 5 end as snapshot_id from part
), asset as (
  select l_partkey * 1000000 + l_suppkey as id, l_partkey as dataset_id, 's' || cast(l_suppkey as varchar) as name, min(l_returnflag) as asset_type
  from lineitem group by l_partkey, l_suppkey
), asset_file as (
  select l_partkey * 1000000 + l_suppkey as asset_id, l_orderkey as file_id, min(l_returnflag) as role from lineitem group by 1, 2
), files as (
  select o_orderkey as id, '/srv/' || left(o_orderpriority, 1) || '/' || cast(o_custkey % 97 as varchar) || '/f' || cast(o_orderkey as varchar) || '.dat' as path,
    cast(floor(o_totalprice) as bigint) as size, o_orderstatus = 'F' as deleted, o_orderpriority as source_server,
    cast(floor(epoch(o_orderdate)) as bigint) as mtime, cast(floor(epoch(o_orderdate)) as bigint) as indexed_at,
    cast(floor(epoch(o_orderdate)) as bigint) + o_custkey as updated_at, case when o_custkey % 3 = 0 then null when o_custkey % 3 = 1 then '' else '{}' end as bio_metadata,
    case when o_custkey % 2 = 0 then 'rice' end as species, cast(null as varchar) as assay_type, 'dat' as format from orders
), docs as (
  select doc_id as id, '/data/' || lang || '/' || source || '/d' || cast(doc_id as varchar) || (['.fastq.gz', '.bam', '.vcf.gz', '.csv', '.h5', '.gtf', '_R1.fq', '.txt'])[doc_id % 8 + 1] as path,
    n_chars as size, text, lang, source from documents
), project as (
  select s_suppkey as id, 'project_' || cast(s_nationkey as varchar) as name, case when s_nationkey % 3 <> 0 then 'species ' || cast(s_nationkey % 4 as varchar) end as species, s_name as summary from supplier
), project_file as (select distinct l_suppkey as project_id, l_orderkey as file_id from lineitem),
relation as (
  select * from (select lag(s_suppkey) over (partition by s_nationkey order by s_suppkey) as a, s_suppkey as b, 'next' as relation, (s_suppkey % 5) / 4.0 :: double as score from supplier) where a is not null
), snapshot as (select n_nationkey + 1 as id, n_nationkey * 86461::bigint as created_at, n_name as summary from nation)
"""


class Catalogue:
    """Lazily read tables of a folder under catalogue names."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def parts(self, name: str) -> int:
        """Tasks that a table's rows are dealt to: one for each ``PART`` bytes of its files, and for each core at least."""
        return max(self.spark.sparkContext.defaultParallelism, -(-file_bytes(self.spark, f"{self.dir}/{name}.parquet") // PART))

    @property
    def lines(self) -> DataFrame:
        """Lines with their asset. Nearly every asset and link has one line, so a task that grouped whole files would hold them all: lines are dealt by asset first."""
        key = (F.col("l_partkey") * 1000000 + F.col("l_suppkey")).alias("asset_id")
        return self.read("lineitem").select(key, "l_partkey", "l_suppkey", "l_orderkey", "l_returnflag").repartition(self.parts("lineitem"), "asset_id")

    @property
    def datasets(self) -> DataFrame:
        size = F.col("p_size")
        return self.read("part").select(
            F.col("p_partkey").alias("id"), F.col("p_name").alias("name"),
            F.concat(F.lit("/ds/"), "p_brand", F.lit("/"), (size % 7).cast("string"), F.lit("/p"), F.col("p_partkey").cast("string")).alias("path"),
            F.col("p_type").alias("dataset_type"), F.col("p_brand").alias("species"),
            F.when(size > 25, "high").when(size > 10, "medium").otherwise("low").alias("confidence"),
            F.concat("p_name", F.lit(" "), "p_type").alias("summary"), (F.col("p_partkey") * 10).alias("updated_at"),
            F.when(size % 5 != 0, size % 5).alias("snapshot_id"),
        )

    @property
    def assets(self) -> DataFrame:
        rows = self.lines.groupBy("asset_id", "l_partkey", "l_suppkey").agg(F.min("l_returnflag").alias("asset_type"))
        return rows.select(F.col("asset_id").alias("id"), F.col("l_partkey").alias("dataset_id"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("name"), "asset_type")

    @property
    def links(self) -> DataFrame:
        return self.lines.groupBy("asset_id", F.col("l_orderkey").alias("file_id")).agg(F.min("l_returnflag").alias("role"))

    @property
    def files(self) -> DataFrame:
        cust, at = F.col("o_custkey"), F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
        return self.read("orders").select(
            F.col("o_orderkey").alias("id"),
            F.concat(F.lit("/srv/"), F.substring("o_orderpriority", 1, 1), F.lit("/"), (cust % 97).cast("string"), F.lit("/f"), F.col("o_orderkey").cast("string"), F.lit(".dat")).alias("path"),
            F.floor("o_totalprice").cast("long").alias("size"), (F.col("o_orderstatus") == "F").alias("deleted"), F.col("o_orderpriority").alias("source_server"),
            at.alias("mtime"), at.alias("indexed_at"), (at + cust).alias("updated_at"),
            F.when(cust % 3 == 1, "").when(cust % 3 == 2, "{}").alias("bio_metadata"),
            F.when(cust % 2 == 0, "rice").alias("species"), F.lit(None).cast("string").alias("assay_type"), F.lit("dat").alias("format"),
        )

    @property
    def docs(self) -> DataFrame:
        ext = F.element_at(F.array(*[F.lit(e) for e in EXTENSIONS]), (F.col("doc_id") % 8 + 1).cast("int"))
        return self.read("documents").select(
            F.col("doc_id").alias("id"), F.concat(F.lit("/data/"), "lang", F.lit("/"), "source", F.lit("/d"), F.col("doc_id").cast("string"), ext).alias("path"),
            F.col("n_chars").alias("size"), "text", "lang", "source",
        )

    @property
    def indexed(self) -> DataFrame:
        """The documents as the full-text index takes them."""
        return self.docs.select("id", F.col("text").alias("metadata"), "path", F.array("lang", "source").alias("tags"))

    @property
    def text_index(self) -> TextIndex:
        """The documents' full-text index, built when these files are first asked for in a session: files written anew get an index of their own."""
        index = TextIndex(self.spark, f"{scratch_folder(self.spark)}/text-{fingerprint(self.spark, f'{self.dir}/documents.parquet')[:16]}")
        if not index.built():
            index.rebuild(self.indexed)
        return index

    @property
    def trigrams(self) -> Trigrams:
        """Trigrams of what a search over files looks at, built when these files are first asked for in a session."""
        index = Trigrams(self.spark, f"{scratch_folder(self.spark)}/grams-{fingerprint(self.spark, f'{self.dir}/orders.parquet')[:16]}")
        if not index.built():
            index.build(self.files, ["path", "bio_metadata", "format"])
        return index

    @property
    def projects(self) -> DataFrame:
        """Suppliers as projects; names repeat."""
        key = F.col("s_nationkey")
        return self.read("supplier").select(
            F.col("s_suppkey").alias("id"), F.concat(F.lit("project_"), key.cast("string")).alias("name"), F.lit(None).cast("string").alias("assay_type"),
            F.when(key % 3 != 0, F.concat(F.lit("species "), (key % 4).cast("string"))).alias("species"), F.lit("low").alias("species_confidence"),
            F.lit(None).cast("string").alias("species_source"), F.lit(None).cast("string").alias("source_server"), F.col("s_name").alias("summary"),
            F.lit(0).cast("long").alias("created_at"), F.lit(0).cast("long").alias("updated_at"),
        )

    @property
    def project_files(self) -> DataFrame:
        return self.read("lineitem").select(F.col("l_suppkey").alias("project_id"), F.col("l_orderkey").alias("file_id")).distinct()

    @property
    def relations(self) -> DataFrame:
        """Pairs of suppliers of one nation, each with the next."""
        s = self.read("supplier").select(F.col("s_suppkey").alias("b"), F.col("s_nationkey").alias("n"))
        w = Window.partitionBy("n").orderBy("b")
        return s.select(F.lag("b").over(w).alias("a"), "b", F.lit("next").alias("relation"), (F.col("b") % 5 / 4).alias("score")).where("a IS NOT NULL")

    @property
    def snapshots(self) -> DataFrame:
        k = F.col("n_nationkey").cast("long")
        return self.read("nation").select((k + 1).alias("id"), (k * 86461).alias("created_at"), F.lit("manual").alias("trigger"), F.col("n_name").alias("summary"))

    @property
    def dirs_as_datasets(self) -> DataFrame:
        """Every language directory and every second source directory, as nested datasets."""
        top = self.docs.select(F.concat(F.lit("/data/"), "lang").alias("path")).distinct()
        low = self.docs.where(F.length("source") % 2 == 0).select(F.concat(F.lit("/data/"), "lang", F.lit("/"), "source").alias("path")).distinct()
        return top.union(low).select(F.abs(F.crc32(F.col("path").cast("binary"))).alias("id"), "path")
