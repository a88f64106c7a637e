"""File formats from leading bytes, text and extension."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnwell.functions.paths import base_name

# Extensions by type.
TYPES = {
    "FASTQ": "fastq fq",
    "FASTA": "fasta fa fna faa ffn",
    "BAM": "bam",
    "SAM": "sam",
    "CRAM": "cram",
    "VCF": "vcf",
    "BCF": "bcf",
    "GFF": "gff gtf gff3",
    "BED": "bed",
    "bigWig": "bw bigwig",
    "bedGraph": "bg bedgraph",
    "HDF5": "h5 hdf5 h5ad",
    "CSV": "csv",
    "TSV": "tsv tab",
    "text": "txt",
    "JSON": "json",
    "gzip": "gz",
    "bzip2": "bz2",
    "MatrixMarket": "mtx",
    "RData": "rds",
}
# Leading bytes (hexadecimal) by type, tried in this order.
MAGIC = (("42414D01", "BAM"), ("4352414D", "CRAM"), ("40484409", "SAM"), ("232366696C65666F726D61743D564346", "VCF"), ("89484446", "HDF5"), ("4844460D", "HDF5"))
# Leading bytes of the second detector, tried in this order, and the extensions that it knows besides or instead.
SECOND_MAGIC = (
    ("42414D01", "BAM"), ("4352414D", "CRAM"), ("40484409", "SAM"), ("232366696C65666F726D61743D564346", "VCF"),
    ("894844460D0A1A0A", "HDF5"), ("4844460D0A1A0A", "HDF5"), ("1F8B", "gzip"), ("425A68", "bzip2"), ("504B0304", "zip"),
    ("89504E470D0A1A0A", "png"), ("934E554D5059", "npy"), ("52494646", "riff"),
)
SECOND_TYPES = {"FASTA": "frn", "HDF5": "loom", "zip": "zip", "YAML": "yaml yml", "RData": "rda"}
TEXT = ("FASTQ", "FASTA", "SAM", "VCF", "GFF", "BED", "CSV", "TSV")
# What each interpreter scores for a file.
SCORES = {"fastq": 0.95, "bam": 0.90, "vcf": 0.90, "hdf5": 0.85, "annotation": 0.85, "generic": 0.5}


def last_extension(path: Column | str) -> Column:
    return F.regexp_extract(F.lower(base_name(path)), r"[^/]\.([^.]*)$", 1)


def type_of_extension(ext: Column) -> Column:
    out = F
    for name, exts in TYPES.items():
        out = out.when(ext.isin(*exts.split()), name)
    return out.otherwise("unknown")


def detect(path: Column | str, magic: Column | None = None) -> Column:
    """Type by leading bytes, then by text, then by extension; never null."""
    by_ext = type_of_extension(last_extension(path))
    if magic is None:
        return by_ext
    head = F.hex(magic)
    out, long_ = F, F.length(magic) >= 4
    for code, name in MAGIC:
        out = out.when(long_ & head.startswith(code), name)
    out = out.when(long_ & head.startswith("1F8B"), F.concat(F.lit("gzip("), by_ext, F.lit(")")))
    out = out.when(head.startswith("3E"), "FASTA")
    out = out.when(head.rlike("^40(4844|5351|5247|5047)"), "SAM").when(head.startswith("40"), "FASTQ")
    return out.otherwise(by_ext)


def second_detect(path: Column | str, magic: Column) -> Column:
    """struct(file_type, mime) of the detector for plugins, which sees 16 bytes and has no answer (null) for what it does not know."""
    head = F.hex(F.substring(magic, 1, 16))
    answer = lambda name, kind="application/octet-stream": F.struct((F.lit(name) if isinstance(name, str) else name).alias("file_type"), F.lit(kind).alias("mime"))
    out = F
    for code, name in SECOND_MAGIC:
        out = out.when(head.startswith(code), answer(name))
    out = out.when(head.startswith("3E"), answer("FASTA", "text/plain"))
    out = out.when(head.rlike("^40(4844|5351|5247|5047)"), answer("SAM", "text/plain")).when(head.startswith("40"), answer("FASTQ", "text/plain"))
    ext = F.lower(F.element_at(F.split(F.col(path) if isinstance(path, str) else path, r"\."), -1))
    kind = F
    for name, exts in SECOND_TYPES.items():
        kind = kind.when(ext.isin(*exts.split()), name)
    kind = kind.otherwise(type_of_extension(ext))
    return out.when(kind != "unknown", answer(kind))


def mime(file_type: Column) -> Column:
    return F.when(file_type.isin(*TEXT), "text/plain").when(file_type.startswith("gzip"), "application/gzip").when(file_type == "JSON", "application/json").otherwise("application/octet-stream")


def interpreter(path: Column | str, file_type: Column) -> Column:
    """struct(interpreter, score): the best of the built-in interpreters; ties go to the first named."""
    low = F.lower(F.col(path) if isinstance(path, str) else path)
    rules = (
        ("fastq", (file_type == "FASTQ") | low.rlike(r"\.fastq|\.fq")),
        ("bam", file_type.isin("BAM", "CRAM", "SAM")),
        ("vcf", file_type.isin("VCF", "BCF")),
        ("hdf5", file_type == "HDF5"),
        ("annotation", file_type.isin("GFF", "BED")),
        ("generic", F.lit(True)),
    )
    out = F
    for name, test in sorted(rules, key=lambda r: -SCORES[r[0]]):
        out = out.when(test, F.struct(F.lit(name).alias("interpreter"), F.lit(SCORES[name]).alias("score")))
    return out
