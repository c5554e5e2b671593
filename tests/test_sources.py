"""Files, mapping, reports, sinks, workspaces and streams."""

from __future__ import annotations

import io
import zipfile

import pytest

from samewise.operators import report
from samewise.plans.workspace import Workspace, page
from samewise.sources import files, mapping, sinks
from samewise.streaming import ingest

CSV = "Stock Code;Item Description;Manufacturer;Qty On Hand;Cost Price\nA1;SKF 6205-2RS bearing;SKF;4;£4.20\nA2;6205 2RS SKF bearing;;n/a;5\n\nA2;;x;1;€2\nA3;Hex bolt M8x25 A2;;1;2;;extra\nA4;=cmd;;2;\n"


def test_formats_are_told_by_content():
    assert files.detect_format(b"a,b\n1,2") == "csv"
    assert files.detect_format(b'\xef\xbb\xbf [{"a": 1}]') == "json"
    assert files.detect_format("{}".encode("utf-16")) == "json"
    for data, code in ((b"", "empty_file"), (b" \n\x00", "empty_file"), (b"%PDF-1.4", "unsupported_format"), (b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1..", "legacy_excel"), (b"ab\x00cd", "unsupported_format"), (b"PK\x03\x04broken", "unreadable_file"), (b"x" * 99, "file_too_large")):
        with pytest.raises(files.FileError, match=code):
            files.detect_format(data, files.Limits(max_bytes=50))


def test_csv_rows_keep_their_numbers():
    t = files.read_csv(CSV.encode())
    assert [n for n, _ in t.rows] == [2, 3, 5, 7] and t.malformed == [(6, "extra_values")]
    assert t.note["delimiter"] == ";" and t.rows[0][1]["Cost Price"] == "£4.20"
    assert files.unique_names(["a", "", "A", "a"]) == ["a", "Column 2", "A (2)", "a (3)"]
    french = "Désignation;Qté\n" + "".join(f"Écrou hexagonal à épaulement, pièce n° {i};{i}\n" for i in range(40))
    assert files.read_csv(french.encode("cp1252")).columns == ["Désignation", "Qté"]
    assert files.read_csv('a,b\n"x\ny",2'.encode()).rows == [(2, {"a": "x\ny", "b": "2"})]
    with pytest.raises(files.FileError, match="no_rows"):
        files.read_csv(b"a,b\n\n")
    with pytest.raises(files.FileError, match="too_many_rows"):
        files.read_csv(b"a\n1\n2\n3", files.Limits(max_rows=2))


def test_json_rows():
    t = files.read_json(b'{"n": 1, "items": [{"k": "a", "f": {"s": [1, 2], "t": null}}, 7, {"x": true, "d": {"e": {"g": 1}}}]}'.replace(b", 7", b""))
    assert t.columns == ["k", "f.s", "f.t", "x", "d.e"]
    assert t.rows[0][1]["f.s"] == "1; 2" and t.rows[1][1] == {"k": "", "f.s": "", "f.t": "", "x": "true", "d.e": '{"g":1}'}
    assert files.read_json(b'[{"a": 1}, 5]').malformed == [(2, "not_an_object")]
    for bad, code in ((b"{", "invalid_json"), (b'{"a": 1}', "json_shape"), (b"[]", "no_rows")):
        with pytest.raises(files.FileError, match=code):
            files.read_json(bad)


def test_workbook_round_trip():
    data = sinks.workbook({"Items": (["Code", "Name", "Qty"], [("A1", "=1+1 <b>", 4), ("007", "x", 2.5), (None, "", None)]), "Second": (["k"], [("v",)])})
    assert files.detect_format(data) == "xlsx"
    t = files.read_xlsx(data)
    assert t.rows == [(2, {"Code": "A1", "Name": "=1+1 <b>", "Qty": "4"}), (3, {"Code": "007", "Name": "x", "Qty": "2.5"})]
    assert files.read_xlsx(data, "Second").rows == [(2, {"k": "v"})] and files.list_sheets(data) == [("Items", 3), ("Second", 1)]
    with pytest.raises(files.FileError, match="sheet_not_found"):
        files.read_xlsx(data, "Third")


def test_archives_that_unpack_too_far():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", b"0" * (30 << 20))
    with pytest.raises(files.FileError, match="archive_too_large"):
        files.detect_format(out.getvalue())


def test_mapping():
    m = mapping.auto_map(["Stock Code", "Item Description", "Manufacturer", "Qty On Hand", "Cost Price", "UOM", "true_product_id", "group"], "catalogue")
    assert (m["item_code"], m["item_name"], m["brand"], m["stock"], m["unit_cost"], m["unit"], m["category"]) == ("Stock Code", "Item Description", "Manufacturer", "Qty On Hand", "Cost Price", "UOM", None)
    assert mapping.auto_map(["fields.summary", "key", "fields.status"], "tasks")["title"] == "fields.summary"
    assert mapping.auto_map(["Long item name"], "catalogue")["item_name"] == "Long item name"
    assert mapping.detect_kind(["Summary", "Status", "Assignee"]) == "tasks" and mapping.detect_kind(["Name", "Brand", "Stock"]) == "catalogue"
    for bad in ({"nope": "a"}, {"brand": "z"}, {"brand": "a", "stock": "a"}):
        with pytest.raises(mapping.MappingError):
            mapping.validate(bad, ["a", "b"], "catalogue")


def test_workspace_from_file_to_export(spark, tmp_path):
    (tmp_path / "in.csv").write_text(CSV, encoding="utf-8")
    space = Workspace(spark, "one", str(tmp_path / "store"))
    d = space.ingest(str(tmp_path / "in.csv"), "d1")
    assert d.kind == "catalogue" and d.mapping["item_name"] == "Item Description"
    r = d.report()
    codes = {w["code"]: w for w in r.warnings}
    assert (r.rows_read, r.rows_ready, r.blocking) == (5, 3, [])
    assert codes["malformed_rows"]["rows"] == [6] and codes["empty_names"]["rows"] == [5] and codes["not_a_number"]["rows"] == [3]
    assert codes["duplicate_item_codes"]["count"] == 2 and "mixed_currencies" in codes and "no_part_number_column" in codes
    assert {c["name"]: c["fill_percent"] for c in r.columns}["Item Description"] == 75
    out = {(x["Stock Code"] or "") + (x["Item Description"] or ""): x for x in (row.asDict() for row in d.export().collect())}
    assert [out[k]["dedupe_role"] for k in ("A1SKF 6205-2RS bearing", "A26205 2RS SKF bearing")] == ["master", "duplicate"]
    assert out["A2"]["dedupe_role"] == "not_analysed"
    apart = d.decide("different", [2, 3])
    assert apart.analyse().members.count() == 0 and d.analyse().members.count() == 2
    with pytest.raises(KeyError):
        Workspace(spark, "two", str(tmp_path / "store")).open("d1")
    assert Workspace(spark, "two", str(tmp_path / "store")).datasets().count() == 0
    sinks.write(d.export(), str(tmp_path / "csv"), "csv")
    assert "'=cmd" in "".join(p.read_text() for p in (tmp_path / "csv").glob("part-*"))


def test_refused_files(spark, tmp_path):
    (tmp_path / "x.pdf").write_bytes(b"%PDF-1")
    with pytest.raises(files.FileError, match="unsupported_format"):
        Workspace(spark, "one", str(tmp_path / "s")).ingest(str(tmp_path / "x.pdf"), "d")


def test_task_report(spark):
    rows = spark.createDataFrame([(1, {"Title": "a", "Body": ""}, None), (2, {"Title": " ", "Body": "x"}, None), (3, {"Title": "b", "Body": "y" * 3000}, None)], "row_number int, values map<string,string>, malformed_reason string")
    r = report.build_report(rows, ["Title", "Body"], mapping.auto_map(["Title", "Body"], "tasks"), "tasks")
    codes = {w["code"]: w["severity"] for w in r.warnings}
    assert r.rows_ready == 2 and codes == {"empty_titles": "warning", "no_id_column": "info", "missing_descriptions": "info", "long_descriptions": "info"}


def test_pages(spark):
    assert [r.id for r in page(spark.range(10).toDF("id"), ["id"], 3, 4).collect()] == [4, 5, 6]
    with pytest.raises(ValueError):
        page(spark.range(10), ["id"], 500)


def test_stream_reads_each_file_once(spark, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    (inbox / "a.csv").write_text("k,v\n1,2\n")
    run = lambda: ingest.ingest(spark, str(inbox), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    run()
    (inbox / "b.json").write_text('[{"k": 3}]')
    run()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r["values"]["k"] for r in got.collect()) == ["1", "3"]
