"""Path expressions: names, extensions, ancestors, boundaries."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extensions of the domain, by field.
BIO_EXTENSIONS = (
    "fastq fastq.gz fq fq.gz bam sam cram sra fa fasta fna faa ffn frn fa.gz fasta.gz cds pep rna dna "
    "bai crai fai tbi csi paf vcf vcf.gz bcf gvcf gvcf.gz ped map bim fam tped tfam hmp eigenvec eigenval "
    "gff gtf gff3 gff.gz gff3.gz gtf.gz bed bed.gz bw bigwig bigbed bedgraph bg narrowpeak broadpeak tagalign "
    "gb gbk embl counts count fpkm rpkm tpm h5 hdf5 h5ad mtx rds loom nwk newick tree tre nex nexus phy phylip "
    "maf aln stockholm nhx phyloxml hmm sto anchors collinearity pdb pdbqt mmcif cif sdf mol mol2 "
    "mzml mzxml mzdata nmrml biom qza qzv agp chain net gmt gmx kgml gpml obo idat gtc cel phen blup gebv"
).split()
# Endings of compressed files, endings that count as one, directories that are left out, directory names that say nothing.
COMPRESSIONS = ("gz", "bz2", "bz", "xz", "zst", "zstd")
COMPOUNDS = ("fastq.gz", "fq.gz", "vcf.gz", "gff.gz", "tsv.gz", "csv.gz", "txt.gz", "tab.gz")
# The endings that count as one for the tree of an inference.
SECOND_COMPOUNDS = ("fastq.gz", "fq.gz", "vcf.gz", "gff.gz", "tsv.gz", "csv.gz", "txt.gz", "tab.gz", "fa.gz")
NOISE = (".git", "node_modules", "__pycache__", ".DS_Store", "__MACOSX", ".idea", ".vscode", "target")
GENERIC = ("data", "results", "analysis", "raw", "processed", "fastq", "bam", "vcf", "rnaseq", "chipseq", "src", "home", "tmp", "projects", "users", "", "/", ".")
# Suffixes of the files that are shown first.
KEY_SUFFIXES = "fastq.gz fq.gz fastq fasta fa.gz fa bam vcf.gz vcf gff3 gtf bed h5 hdf5".split()
# Names of files that describe the files around them.
METADATA_FILES = "design.csv design.tsv metadata.csv metadata.xlsx README.md readme.txt samples.csv samples.tsv config.yaml config.yml manifest.csv".split()
# Accession prefixes and what they name.
ACCESSIONS = (
    ("SRR|ERR|DRR", "SRA_run"),
    ("SRX|ERX|DRX", "SRA_experiment"),
    ("GSM", "GEO_sample"),
    ("GSE", "GEO_series"),
    ("GPL", "GEO_platform"),
    ("PRJNA|PRJEB|PRJDB", "BioProject"),
    ("ERS|SAME|SAMN|SAMEA", "BioSample"),
)


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def base_name(path: Column | str) -> Column:
    return F.element_at(F.split(_c(path), "/"), -1)


def parent(path: Column | str) -> Column:
    return F.regexp_replace(_c(path), "/[^/]*$", "")


def depth(path: Column | str) -> Column:
    return F.size(F.split(_c(path), "/")) - 1


def ancestors(path: Column | str, itself: bool = False) -> Column:
    """All directories above a path, root first; with the path itself if asked for."""
    parts = F.split(_c(path), "/")
    last = F.size(parts) if itself else F.size(parts) - 1
    return F.when(last >= 2, F.transform(F.sequence(F.lit(2), last), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(F.array().cast("array<string>"))


def ancestor_names(path: Column | str, n: int = 3) -> Column:
    """Up to n names of directories above, nearest first."""
    names = F.filter(F.split(parent(path), "/"), lambda x: x != "")
    return F.slice(F.reverse(names), 1, n)


def extension(name: Column | str) -> Column:
    """Lower-case extension; compound for compressed domain formats and a few others; "(noext)" without a dot."""
    low = F.lower(_c(name))
    plain = [e for e in BIO_EXTENSIONS if "." not in e]
    packed = F.regexp_extract(low, r"\.([^.]+)\.(?:" + "|".join(COMPRESSIONS) + ")$", 1)
    pair = F.regexp_extract(low, r"([^.]+\.[^.]+)$", 1)
    last = F.regexp_extract(low, r"\.([^.]*)$", 1)
    return F.when(packed.isin(plain) | pair.isin(*COMPOUNDS), pair).when(F.contains(low, F.lit(".")), last).otherwise("(noext)")


def second_extension(name: Column | str) -> Column:
    """Lower-case extension by the rule of the inference's trees: one of its compounds, else what follows the last dot; "(noext)" without a dot."""
    low = F.lower(_c(name))
    pair = F.regexp_extract(low, r"\.(" + "|".join(re.escape(e) for e in SECOND_COMPOUNDS) + ")$", 1)
    return F.when(pair != "", pair).when(F.contains(low, F.lit(".")), F.regexp_extract(low, r"\.([^.]*)$", 1)).otherwise("(noext)")


def is_bio(ext: Column | str) -> Column:
    inner = F.regexp_replace(F.lower(_c(ext)), r"\.(?:" + "|".join(COMPRESSIONS) + ")$", "")
    return F.lower(_c(ext)).isin(BIO_EXTENSIONS) | inner.isin(BIO_EXTENSIONS)


def in_noise(path: Column | str) -> Column:
    return F.arrays_overlap(F.split(_c(path), "/"), F.array(*[F.lit(x) for x in NOISE]))


def excluded(path: Column | str, patterns: list[str]) -> Column:
    """``*.ext``: the path ends so; ``.*``: hidden base name; else a raw prefix."""
    out = F.lit(False)
    for p in patterns:
        if p == ".*":
            out = out | base_name(path).startswith(".")
        elif p.startswith("*."):
            out = out | _c(path).endswith(p[1:])
        else:
            out = out | _c(path).startswith(p)
    return out


def project_of(names: Column | str) -> Column:
    """The outermost of the names (nearest first) that is not generic and has over 2 bytes."""
    good = F.filter(F.reverse(_c(names)), lambda x: ~F.lower(x).isin(*GENERIC) & (F.octet_length(x) > 2))
    return F.get(good, F.lit(0))


def paired_tag(path: Column | str) -> Column:
    return F.when(F.lower(_c(path)).rlike(r"_r1|_r2|_1\.|_2\."), "paired-end").otherwise("single-end")


def name_family(name: Column | str) -> Column:
    """What an accession names; else the part before the first digit, without trailing underscores."""
    base = F.upper(F.split_part(_c(name), F.lit("."), F.lit(1)))
    out = F
    for prefixes, family in ACCESSIONS:
        out = out.when(base.rlike(f"^(?:{prefixes})"), family)
    head = F.regexp_replace(F.regexp_extract(base, "^[^0-9]*", 0), "_+$", "")
    return out.otherwise(F.when(head == "", "unknown").otherwise(head))


def version_pattern(name: Column | str) -> Column:
    """Without trailing digits, then dots, then underscores, once each: cds_v1.0 gives cds_v1."""
    out = _c(name)
    for cut in ("[0-9]+$", r"\.+$", "_+$"):
        out = F.regexp_replace(out, cut, "")
    return out


def trivial_version(name: Column | str) -> Column:
    low = F.lower(_c(name))
    return low.rlike("^v[0-9._]+$") | low.startswith("obsolete") | (low == "")


def key_file(name: Column | str) -> Column:
    """Whether a file is of a kind that is shown first."""
    return F.lower(_c(name)).rlike(r"\.(?:" + "|".join(KEY_SUFFIXES).replace(".", r"\.") + ")$")


def dataset_name(path: Column | str, root: str) -> Column:
    """The path below a root, which may be repeated, with underscores for slashes."""
    rest = F.regexp_replace(_c(path), f"^(?:{re.escape(root)})+", "") if root else _c(path)
    return F.regexp_replace(F.regexp_replace(rest, "^/+", ""), "/", "_")


def server_path(server: Column | str, path: Column | str) -> Column:
    return F.when(_c(server) == "local", _c(path)).otherwise(F.concat_ws(":", _c(server), _c(path)))


def relation(path: Column | str, root: Column | str) -> Column:
    """0: the path is the root; 1: below it; 2: above it; null: apart. Boundaries are slashes."""
    a, b = _c(path), _c(root)
    return F.when(a == b, 0).when(F.startswith(a, F.concat(b, F.lit("/"))), 1).when(F.startswith(b, F.concat(a, F.lit("/"))), 2)
