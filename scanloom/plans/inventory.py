"""Package inventory of a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame

from scanloom.operators.documents import to_cyclonedx, to_spdx
from scanloom.operators.packages import extract_packages, inventory


def packages_of(files: DataFrame) -> DataFrame:
    return inventory(extract_packages(files))


def sbom(files: DataFrame, fmt: str = "cyclonedx", by=None) -> DataFrame:
    """One document per scan unit, as CycloneDX or SPDX."""
    found = extract_packages(files)
    return to_cyclonedx(found, by) if fmt == "cyclonedx" else to_spdx(found, by)
