import base64
import hashlib

import pytest
from incidentry.llm import warc
from incidentry.session import scratch_path


def table(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string, hash string, first string")


def long_rows():
    return [(i, f"http://x/{i % 50}", f"<html><title>Page {i % 90}</title>" + "<p>some words of a page</p>" * (i % 60), "h", "f") for i in range(400)]


AWKWARD = [
    (1, "http://a\r\nX: y", None, "", ""),
    (2, None, "", "", ""),
    (3, "u", "é" * 100_000, "", ""),
    (4, "u", "é" * 100_000, "", ""),
    (None, "u", "é" * 100_000, "", ""),
    (None, None, "only without id", "", ""),
    (5, "u", "a\r\n\r\nb", "", ""),
    (5, "u", "a\r\n\r\nb", "", ""),
]


@pytest.mark.parametrize("rows", [long_rows(), AWKWARD], ids=["long", "awkward"])
def test_round_trip(spark, rows):
    found = warc.archive_pages(table(spark, rows).repartition(4)).collect()
    assert len(found) == len(rows)
    least = {}
    for page, _, html, *_ in rows:
        key = html or ""
        least[key] = min((x for x in (page, least.get(key)) if x is not None), default=None)
    expected = []
    for page, url, html, *_ in rows:
        payload = (html or "").encode()
        first = least[html or ""]
        revisit = page != first
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        expected.append((str(page), len(payload), digest, "revisit" if revisit else "response", f"<urn:page:{first}>" if revisit else "None", "" if revisit else payload.decode()))
    got = [
        (
            r["record_id"][len("<urn:page:") : -1] if "page" in r["record_id"] else "None",
            r["payload_bytes"],
            r["payload_digest"],
            r["record_type"],
            str(r["refers_to"]),
            bytes(r["payload"] or b"").decode(),
        )
        for r in found
    ]
    assert sorted(got) == sorted(expected)


def test_single_records_and_dictionary(spark):
    folder = scratch_path(spark, "warc-test")
    index = warc.write(table(spark, long_rows()).repartition(2), folder).collect()
    path = f"{folder}/{index[0]['file']}"
    data = open(path, "rb").read()
    size = int.from_bytes(data[4:8], "little")
    assert int.from_bytes(data[:4], "little") == warc.DICTIONARY_FRAME and size > 1000
    for row in index[:50]:
        if row["file"] == index[0]["file"]:
            fields, _, payload = warc.read_one(folder, row["file"], row["offset"], row["length"], data[8 : 8 + size])
            assert fields["WARC-Record-ID"] == f"<urn:page:{row['id']}>"
            assert row["record_type"] == fields["WARC-Type"]
            assert (payload == b"") == (row["record_type"] == "revisit")


def test_small_payloads_are_never_revisits(spark):
    rows = [(i, "u", "tiny", "", "") for i in range(5)] + [(10 + i, "u", "large enough to be found again", "", "") for i in range(5)]
    found = warc.archive_pages(table(spark, rows), least=10).collect()
    assert sorted(r["record_type"] for r in found) == ["response"] * 6 + ["revisit"] * 4


def test_empty_table(spark):
    assert warc.archive_pages(table(spark, [])).count() == 0


def test_ids_of_other_types_and_clashing_names(spark):
    rows = spark.sql("SELECT CAST(i AS smallint) AS page_id, concat('http://a/', i) AS url, 'same' AS html, 'x' AS file, 'y' AS record_type FROM (SELECT explode(sequence(1, 5)) AS i)")
    found = {r["record_id"]: r["refers_to"] for r in warc.archive_pages(rows).collect()}
    assert found == {"<urn:page:1>": None} | {f"<urn:page:{i}>": "<urn:page:1>" for i in range(2, 6)}
    folder = warc.scratch_path(spark, "warc")
    index = warc.write(rows.withColumn("page_id", rows["page_id"].cast("decimal(5,1)")), folder)
    assert index.schema["id"].dataType.simpleString() == "decimal(5,1)" and index.count() == 5
