"""Reference files of a genome build, with overrides."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, replace

from pyspark.sql import SparkSession

BUILDS = ("hg19", "hg38")


@dataclass(frozen=True)
class ReferenceFiles:
    """Paths of a build's files; optional ones may be None."""

    build: str
    cytoband: str
    replication_timing: str | None = None
    faire: str | None = None
    gc: str | None = None
    fasta: str | None = None

    @staticmethod
    def of(folder: str, build: str) -> ReferenceFiles:
        if build not in BUILDS:
            raise ValueError(f"build {build!r} is none of {', '.join(BUILDS)}")
        at = f"{folder.rstrip('/')}/{build}"
        return ReferenceFiles(build, f"{at}/cytoband.tsv", f"{at}/replication_timing.tsv", f"{at}/faire.tsv", f"{at}/gc.parquet", f"{at}/fasta")

    def overridden(self, text: str) -> ReferenceFiles:
        """With the entries of a JSON object; unknown names are an error."""
        given = json.loads(text)
        if unknown := set(given) - set(asdict(self)):
            raise ValueError(f"unknown reference files: {', '.join(sorted(unknown))}")
        return replace(self, **given)

    def missing(self, spark: SparkSession) -> list[str]:
        """Names of files that are given and are not there."""
        out = []
        for name, path in asdict(self).items():
            if name != "build" and path is not None:
                p = spark._jvm.org.apache.hadoop.fs.Path(path)
                if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
                    out.append(name)
        return out
