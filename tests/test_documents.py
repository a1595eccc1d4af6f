"""Documents as ordered records."""

import json

import pytest
import scanloom as sl
from pyspark.sql import functions as F
from scanloom.operators import documents as documents_module
from scanloom.operators.documents import ITEMS, cyclonedx_records, sarif_records, spdx_records, write_document, write_documents
from scanloom.operators.order import with_positions
from scanloom.schema import FINDING_COLUMNS


def packages(spark, n):
    """All but one in a hundred in one unit."""
    return spark.range(n).select(
        F.lit("npm").alias("ecosystem"), F.format_string("p-%09d", (F.col("id") * 48271) % n).alias("name"), F.lit("1.0").alias("version"),
        F.when(F.col("id") % 100 == 1, F.concat(F.lit("s"), (F.col("id") % 7).cast("string"))).otherwise("hot").alias("unit_")
    ).withColumn("source", F.concat("unit_", F.lit("/package-lock.json")))


def found(spark, n):
    rows = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, "A-1").otherwise("B-1").alias("code"), F.concat(F.lit('say "hi" \\ '), F.col("id").cast("string")).alias("message"),
        F.when(F.col("id") % 3 == 0, "high").otherwise("low").alias("severity"), F.lit("high").alias("confidence"), F.lit("security").alias("category"),
        F.when(F.col("id") % 3 == 0, "help").alias("help"),
        F.struct(F.when(F.col("id") % 10 == 9, "other/é").otherwise("hot/f").alias("file"), (F.lit(n) - F.col("id")).alias("byte_offset"),
                 F.lit(1).cast("long").alias("byte_length"), F.lit(1).alias("line"), F.lit(2).alias("column")).alias("location"),
        F.lit(1).alias("family_no"), (F.col("id") % 3).cast("int").alias("rule_no"))
    return rows.select(*FINDING_COLUMNS)


def document(folder):
    return "\n".join(p.read_text() for p in sorted(folder.glob("part-*")))


def test_a_unit_of_a_million_items(spark):
    n = 1_100_000
    records = spdx_records(packages(spark, n)).filter(f"unit = 'hot' and section = {ITEMS}")
    item = F.from_json(F.regexp_replace("record", "^,", ""), "SPDXID string, name string")
    checked = records.select("position", item.alias("i")).agg(
        F.count(F.lit(1)), F.count_distinct("position"), F.min("position"), F.max("position"),
        F.count_if(F.col("i.SPDXID") == F.concat(F.lit("SPDXRef-Package-"), F.col("position").cast("string"))),
        F.min_by("i.name", "position"), F.max_by("i.name", "position")).first()
    size = n - n // 100
    assert tuple(checked) == (size, size, 0, size - 1, size, "p-000000000", f"p-{n - 1:09d}")


def test_records_hold_no_lists(spark):
    for records in (cyclonedx_records(packages(spark, 100)), spdx_records(packages(spark, 100)), sarif_records(found(spark, 100))):
        plan = records._jdf.queryExecution().executedPlan().toString()
        assert "collect_list" not in plan and "collect_set" not in plan


def test_written_documents_are_json(spark, tmp_path):
    cdx, sarif = cyclonedx_records(packages(spark, 3000)), sarif_records(found(spark, 3000), tool='a "tool"')
    write_document(cdx, "hot", str(tmp_path / "cdx"))
    write_document(sarif, "hot", str(tmp_path / "sarif"))
    write_document(spdx_records(packages(spark, 50)), "s1", str(tmp_path / "spdx"))
    bill = json.loads(document(tmp_path / "cdx"))
    names = [c["name"] for c in bill["components"]]
    assert len(names) == 2970 and names == sorted(names) and bill["bomFormat"] == "CycloneDX" and bill["metadata"]["tools"][0]["name"] == "scanloom"
    run = json.loads(document(tmp_path / "sarif"))["runs"][0]
    assert run["tool"]["driver"]["name"] == 'a "tool"' and [r["id"] for r in run["tool"]["driver"]["rules"]] == ["A-1", "B-1"]
    offsets = [(r["ruleId"], r["locations"][0]["physicalLocation"]["region"]["charOffset"]) for r in run["results"]]
    assert len(offsets) == 2700 and run["results"][0]["message"]["text"].startswith('say "hi" \\ ')
    kinds = [o for o in offsets if o[0] == "A-1"]
    assert offsets[:len(kinds)] == sorted(kinds, key=lambda x: x[1])
    assert json.loads(document(tmp_path / "spdx"))["documentNamespace"].endswith(":s1:0")


def test_stored_records_stay_in_order(spark, tmp_path):
    write_documents(cyclonedx_records(packages(spark, 2000)), str(tmp_path / "all"))
    text = {}
    for r in spark.read.parquet(str(tmp_path / "all")).orderBy("unit", "page", "section", "position").collect():
        text.setdefault(r.unit, []).append(r.record)
    assert sum(len(json.loads("".join(t))["components"]) for t in text.values()) == 2000


def test_pages_are_exact(spark):
    pages = {(r.unit, r.page): json.loads(r.document) for r in sl.to_spdx(packages(spark, 1000), page_size=100).collect()}
    hot = [len(d["packages"]) for (u, _), d in sorted(pages.items()) if u == "hot"]
    assert hot == [100] * 9 + [90]
    results = {(r.unit, r.page): json.loads(r.document)["runs"][0] for r in sl.to_sarif(found(spark, 100), page_size=30).collect()}
    assert [len(results["hot", p]["results"]) for p in range(3)] == [30, 30, 30] and len(results["other", 0]["results"]) == 10
    # A page names the rules of its own results only.
    for run in results.values():
        assert {r["ruleId"] for r in run["results"]} == {r["id"] for r in run["tool"]["driver"]["rules"]}


def test_no_items(spark):
    assert cyclonedx_records(packages(spark, 0)).count() == 0 and sl.to_sarif(found(spark, 0)).count() == 0


def test_documents_of_one_inventory_order_it_once(spark, monkeypatch):
    """Placed packages give the records of packages, without another order; places need no window over the rows."""
    placed = documents_module.place_packages(packages(spark, 500))
    plain = {kind: kind(packages(spark, 500)) for kind in (cyclonedx_records, spdx_records)}
    with pytest.raises(ValueError):
        cyclonedx_records(placed, page_size=10)
    monkeypatch.setattr(documents_module, "with_positions", None)
    for kind, expected in plain.items():
        found = kind(placed)
        assert found.exceptAll(expected).count() == 0 and found.count() == expected.count() == 500 + 2 * 6


def test_places_come_from_seats(spark):
    plan = with_positions(packages(spark, 300).select("unit_", "name"), ["name"], ["unit_"], partitions=6)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
