"""JSON documents per scan unit: result documents and software inventories.

A document is written as records: a head, one record per item in the document's order, and a foot. Joined
with line ends, the records of a unit are one valid JSON document. No record grows with the
unit, so a unit may hold any number of items: their places come from a sort by ranges and a count per
range (`order.with_positions`), not from a list.

``to_*`` put records together where single documents are wanted, in pages of at most ``page_size``
items, which is what bounds a row. A unit of more items has several pages, each a valid
document of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from scanloom.functions.grades import document_level
from scanloom.functions.lam import sql_text
from scanloom.functions.versions import purl
from scanloom.operators.order import with_positions
from scanloom.sources.shared import save

TOOL = "scanloom"
VERSION = "0.1.0"
PAGE_SIZE = 10_000
#: Sections of a document, in their order; heads and feet hold no items.
HEAD, RULES, MIDDLE, ITEMS, FOOT = range(5)


def repository(path: Column) -> Column:
    """Default scan unit: the first path part."""
    return F.substring_index(path, "/", 1)


def _fixed(units: DataFrame, section: int, text: Column) -> DataFrame:
    return units.select("unit", "page", F.lit(section).alias("section"), F.lit(0).cast("long").alias("position"), text.alias("record"))


def _listed(items: DataFrame, section: int, item: Column) -> DataFrame:
    """Items of one list: all but the first of a page follow a comma."""
    comma = F.when(F.col("position") > 0, F.lit(",")).otherwise(F.lit(""))
    return items.select("unit", "page", F.lit(section).alias("section"), "position", F.concat(comma, F.to_json(item)).alias("record"))


def _paged(placed: DataFrame, page_size: int | None) -> DataFrame:
    """Add ``page``; positions count from 0 in every page."""
    if page_size is None:
        return placed.withColumn("page", F.lit(0).cast("long"))
    return placed.withColumn("page", F.floor(F.col("position") / page_size)).withColumn("position", F.col("position") % page_size)


# --- results ------------------------------------------------------------------

def _result() -> Column:
    loc = F.col("location")
    region = F.struct(
        loc["line"].alias("startLine"), loc["column"].alias("startColumn"),
        loc["byte_offset"].alias("charOffset"),
        F.when(loc["byte_offset"].isNotNull(), loc["byte_length"]).alias("charLength"),
    )
    has_region = loc["line"].isNotNull() | loc["column"].isNotNull() | loc["byte_offset"].isNotNull()
    return F.struct(
        F.col("code").alias("ruleId"), document_level("severity").alias("level"),
        F.struct(F.col("message").alias("text")).alias("message"),
        F.struct(F.col("confidence").alias("confidence")).alias("properties"),
        F.when(loc["file"].isNotNull(), F.array(F.struct(F.struct(
            F.struct(loc["file"].alias("uri")).alias("artifactLocation"), F.when(has_region, region).alias("region"),
        ).alias("physicalLocation")))).alias("locations"),
    )


def _rule() -> Column:
    return F.struct(
        F.col("code").alias("id"), F.col("code").alias("name"),
        F.struct(F.col("message").alias("text")).alias("shortDescription"),
        F.struct(document_level("severity").alias("level")).alias("defaultConfiguration"),
        F.struct(F.col("category").alias("category")).alias("properties"),
        F.when(F.col("help").isNotNull(), F.struct(F.col("help").alias("text"))).alias("help"),
    )


def sarif_records(findings: DataFrame, by: Column | None = None, tool: str = TOOL, version: str = VERSION,
                  page_size: int | None = None) -> DataFrame:
    """(unit, page, section, position, record) of SARIF 2.1.0 documents.

    Rules are those of a page's findings, by code, each described by its first finding. Results are in the order of
    detector, file, rule and offset; findings that agree in all of these are ordered by code and message.
    """
    loc = F.col("location")
    unit = repository(F.coalesce(loc["file"], F.lit(""))) if by is None else by
    keyed = findings.withColumns({"unit": unit, "_file": loc["file"], "_offset": loc["byte_offset"]})
    placed = _paged(with_positions(keyed, ["family_no", "_file", "rule_no", "_offset", "code", "message"], ["unit"]), page_size)
    found = save(placed.select("unit", "page", "position", "code", _result().alias("result"), _rule().alias("rule")), "results")
    # The codes of a unit are no more than the rules of the run.
    first = found.groupBy("unit", "page", "code").agg(F.min_by("rule", "position").alias("rule"))
    codes = first.withColumn("position", (F.row_number().over(Window.partitionBy("unit", "page").orderBy("code")) - 1).cast("long"))
    units = found.select("unit", "page").distinct()
    head = F.concat(
        F.lit('{"$schema":"https://json.schemastore.org/sarif-2.1.0.json","version":"2.1.0","runs":[{"tool":{"driver":{"name":'),
        _quoted(F.lit(tool)), F.lit(',"version":'), _quoted(F.lit(version)), F.lit(',"rules":['))
    return (
        _fixed(units, HEAD, head)
        .unionByName(_listed(codes, RULES, F.col("rule")))
        .unionByName(_fixed(units, MIDDLE, F.lit(']}},"results":[')))
        .unionByName(_listed(found, ITEMS, F.col("result")))
        .unionByName(_fixed(units, FOOT, F.lit("]}]}")))
    )


# --- inventories ----------------------------------------------------------------

#: Columns that a table of placed packages has and a table of packages has not.
PLACED = {"unit", "page", "position"}


def place_packages(packages: DataFrame, by: Column | None = None, page_size: int | None = None) -> DataFrame:
    """Distinct packages of every unit with their places, kept for the head, the items and the foot.

    Every kind of document takes such a table in place of packages: several documents of one inventory read and order it once.
    """
    unit = repository(F.col("source")) if by is None else by
    distinct = packages.select(unit.alias("unit"), "ecosystem", "name", "version").distinct()
    return save(_paged(with_positions(distinct, ["ecosystem", "name", "version"], ["unit"]), page_size), "packages")


def _placed_packages(packages: DataFrame, by: Column | None, page_size: int | None) -> DataFrame:
    if not PLACED <= set(packages.columns):
        return place_packages(packages, by, page_size)
    if by is not None or page_size is not None:
        raise ValueError("placed packages have their units and pages")
    return packages


def _document(items: DataFrame, head: Column, item: Column) -> DataFrame:
    units = items.select("unit", "page").distinct()
    return (_fixed(units, HEAD, head).unionByName(_listed(items, ITEMS, item)).unionByName(_fixed(units, FOOT, F.lit("]}"))))


def cyclonedx_records(packages: DataFrame, by: Column | None = None, version: str = VERSION, page_size: int | None = None) -> DataFrame:
    """(unit, page, section, position, record) of CycloneDX 1.5 documents."""
    url = purl("ecosystem", "name", "version")
    item = F.struct(F.lit("library").alias("type"), url.alias("bom-ref"), F.col("name"), F.col("version"), url.alias("purl"))
    head = F.concat(
        F.lit('{"bomFormat":"CycloneDX","specVersion":"1.5","version":1,"metadata":{"tools":['),
        F.to_json(F.struct(F.lit(TOOL).alias("vendor"), F.lit(TOOL).alias("name"), F.lit(version).alias("version"))),
        F.lit(']},"components":['))
    return _document(_placed_packages(packages, by, page_size), head, item)


def spdx_records(packages: DataFrame, by: Column | None = None, version: str = VERSION, page_size: int | None = None) -> DataFrame:
    """(unit, page, section, position, record) of SPDX 2.3 documents, with ids by position and a fixed creation time."""
    item = F.struct(
        F.concat(F.lit("SPDXRef-Package-"), F.col("position").cast("string")).alias("SPDXID"), F.col("name"),
        F.col("version").alias("versionInfo"), F.lit("NOASSERTION").alias("downloadLocation"), F.lit(False).alias("filesAnalyzed"),
        F.array(F.struct(
            F.lit("PACKAGE-MANAGER").alias("referenceCategory"), F.lit("purl").alias("referenceType"),
            purl("ecosystem", "name", "version").alias("referenceLocator"))).alias("externalRefs"),
    )
    facts = F.to_json(F.struct(
        F.lit("SPDX-2.3").alias("spdxVersion"), F.lit("CC0-1.0").alias("dataLicense"), F.lit("SPDXRef-DOCUMENT").alias("SPDXID"),
        F.lit(f"{TOOL}-sbom").alias("name"),
        F.concat(F.lit(f"urn:{TOOL}:sbom:{version}:"), F.col("unit"), F.lit(":"), F.col("page").cast("string")).alias("documentNamespace"),
        F.struct(F.array(F.lit(f"Tool: {TOOL}-{version}")).alias("creators"), F.lit("1970-01-01T00:00:00Z").alias("created")).alias("creationInfo"),
    ))
    # The list of packages is the last member of the object.
    return _document(_placed_packages(packages, by, page_size), F.concat(F.regexp_replace(facts, r"\}$", ""), F.lit(',"packages":[')), item)


def _quoted(text: Column) -> Column:
    """A string as JSON."""
    return F.regexp_extract(F.to_json(F.struct(text.alias("t"))), r"^\{\"t\":([\s\S]*)\}$", 1)


# --- writing --------------------------------------------------------------------

DOCUMENT_ORDER = ("unit", "page", "section", "position")


def write_documents(records: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Store records in the order of their documents, in as many files as tasks; a unit's records are neighbours."""
    records.repartitionByRange(*DOCUMENT_ORDER).sortWithinPartitions(*DOCUMENT_ORDER).write.mode(mode).parquet(path)


def write_document(records: DataFrame, unit: str, path: str, page: int = 0, mode: str = "errorifexists") -> None:
    """Write one document as text: its part files, joined in the order of their names, are the JSON."""
    own = records.filter(f"unit = {sql_text(unit)} and page = {int(page)}")
    own.repartitionByRange("section", "position").sortWithinPartitions("section", "position").select("record").write.mode(mode).text(path)


def _assembled(records: DataFrame) -> DataFrame:
    """(unit, page, document); a page's size bounds the row."""
    lines = F.array_sort(F.collect_list(F.struct("section", "position", "record")))
    return records.groupBy("unit", "page").agg(F.array_join(F.transform(lines, lambda x: x["record"]), "").alias("document")).select(
        "unit", F.col("page").cast("int").alias("page"), "document")


def to_sarif(findings: DataFrame, by: Column | None = None, tool: str = TOOL, version: str = VERSION,
             page_size: int = PAGE_SIZE) -> DataFrame:
    """(unit, page, document): SARIF 2.1.0 with rules by first finding and results in order."""
    return _assembled(sarif_records(findings, by, tool, version, page_size))


def to_cyclonedx(packages: DataFrame, by: Column | None = None, version: str = VERSION, page_size: int = PAGE_SIZE) -> DataFrame:
    """(unit, page, document): CycloneDX 1.5."""
    return _assembled(cyclonedx_records(packages, by, version, page_size))


def to_spdx(packages: DataFrame, by: Column | None = None, version: str = VERSION, page_size: int = PAGE_SIZE) -> DataFrame:
    """(unit, page, document): SPDX 2.3 with positional ids and a fixed creation time."""
    return _assembled(spdx_records(packages, by, version, page_size))
