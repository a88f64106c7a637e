"""Plugins for formats and file contexts, as columns: the first by priority that has an answer wins."""

from __future__ import annotations

import importlib.util
import json
import logging
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

PRIORITY = 50
LEAST_SCORE = 0.3
FANOUT_SCORE = 0.8
MOST_BYTES = 4096
FORMAT = "file_type string, mime string"
CONTEXT = "assay_type string, species string, tags array<string>"

# Words of a path by what they say of the assay, first match wins.
ASSAYS = (
    ("RNA-seq", "rnaseq rna-seq rna_seq"),
    ("ChIP-seq", "chipseq chip-seq chip_seq"),
    ("ATAC-seq", "atac atac-seq"),
    ("WGS", "wgs whole_genome dna-seq"),
    ("WGBS", "wgbs methylation bisulfite"),
    ("scRNA-seq", "scrna singlecell single_cell 10x"),
)
# Words of a path by species, first match wins.
SPECIES = (
    ("human", "human hg38 hg19"),
    ("mouse", "mouse mm10 mm39"),
    ("rat", "rat rattus"),
    ("zebrafish", "zebrafish danio"),
    ("fruit fly", "drosophila dmel"),
    ("C. elegans", "celegans elegans"),
    ("Arabidopsis", "arabidopsis thaliana"),
    ("yeast", "yeast cerevisiae"),
    ("E. coli", "ecoli e_coli k12"),
)


def ladder(text: Column | str, rules: tuple[tuple[str, str], ...]) -> Column:
    """The first rule any of whose words the lower-cased text holds; null if none."""
    low, out = F.lower(F.col(text) if isinstance(text, str) else text), F
    for name, words in rules:
        test = F.lit(False)
        for word in words.split():
            test = test | low.contains(word)
        out = out.when(test, name)
    return out.otherwise(F.lit(None).cast("string"))


@dataclass(frozen=True)
class Detector:
    """``detect`` maps path and leading bytes to a struct (file_type, mime), or null."""

    name: str
    detect: Callable[[Column, Column], Column]
    priority: int = PRIORITY


@dataclass(frozen=True)
class Interpreter:
    """``extract`` maps a path to a struct (assay_type, species, tags); it counts from a score of LEAST_SCORE on."""

    name: str
    score: Callable[[Column], Column]
    extract: Callable[[Column], Column]
    priority: int = PRIORITY


def from_python(f: Callable[..., dict | None], schema: str) -> Callable[..., Column]:
    """A plugin body in Python as a column: Arrow batches in, JSON out; errors and over-long answers are null."""

    @F.pandas_udf("string")
    def run(*columns: pd.Series) -> pd.Series:
        def one(*values):
            try:
                found = f(*values)
                text = None if found is None else json.dumps(found)
            except Exception:  # noqa: BLE001 - a plugin's failure is no answer
                return None
            return text if text is not None and len(text.encode()) < MOST_BYTES else None

        return pd.Series([one(*row) for row in zip(*columns)], dtype=object)

    return lambda *columns: F.from_json(run(*columns), schema)


def path_interpreter() -> Interpreter:
    """The built-in sample: assay and species by words of the path, pairing of reads."""

    def extract(path: Column) -> Column:
        low = F.lower(path)
        tags = F.when(low.rlike(r"_r1|_r2|_1\.|_2\."), F.array(F.lit("paired-end"))).when(low.rlike(r"\.fastq|\.fq"), F.array(F.lit("single-end"))).otherwise(F.array().cast("array<string>"))
        return F.struct(ladder(path, ASSAYS).alias("assay_type"), ladder(path, SPECIES).alias("species"), tags.alias("tags"))

    return Interpreter("paths", lambda path: F.when(F.lower(path).rlike(r"\.fq|fastq"), 0.95).otherwise(0.0), extract)


@dataclass
class Registry:
    detectors: list[Detector] = field(default_factory=list)
    interpreters: list[Interpreter] = field(default_factory=list)

    def add(self, plugin: Detector | Interpreter) -> None:
        (self.detectors if isinstance(plugin, Detector) else self.interpreters).append(plugin)

    def discover(self, folder: str) -> int:
        """Add ``plugin`` of each Python file of a folder; those that fail to load are warned of and skipped."""
        n = 0
        for path in sorted(Path(folder).glob("*.py")) if Path(folder).is_dir() else ():
            try:
                spec = importlib.util.spec_from_file_location(path.stem, path)
                module = importlib.util.module_from_spec(spec)
                spec.loader.exec_module(module)
                self.add(module.plugin)
                n += 1
            except Exception as e:  # noqa: BLE001 - one bad plugin stops no other
                logging.getLogger(__name__).warning("plugin %s not loaded: %s", path, e)
        return n

    def detect(self, path: Column, magic: Column, builtin: Column) -> Column:
        """struct (file_type, mime): the first answer by priority, else ``builtin``."""
        ordered = sorted(self.detectors, key=lambda p: -p.priority)
        return F.coalesce(*[p.detect(path, magic) for p in ordered], builtin)

    def interpret(self, path: Column, builtin: Column) -> Column:
        """The context of the first interpreter by priority whose score counts, else ``builtin``."""
        ordered = sorted(self.interpreters, key=lambda p: -p.priority)
        return F.coalesce(*[F.when(p.score(path) >= LEAST_SCORE, p.extract(path)) for p in ordered], builtin)

    def answers(self, path: Column) -> Column:
        """All interpreters' answers, unranked: an array of (name, score, context)."""
        each = [F.when(p.score(path) >= LEAST_SCORE, F.struct(F.lit(p.name).alias("name"), F.lit(FANOUT_SCORE).alias("score"), p.extract(path).alias("context"))) for p in sorted(self.interpreters, key=lambda p: -p.priority)]
        return F.filter(F.array(*each), lambda x: x.isNotNull())
