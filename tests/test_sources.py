"""Readers: raw lexemes, scope, abstention, whole-file failure, cache."""

import json
import struct
import zipfile

from tessera.sources import detect, readers


def run(path, content, hint=None, limit=200):
    return readers.parse(path, content, hint, limit)


def test_csv_keeps_lexemes():
    name, _, status, _, facts, coverage = run("a.csv", b"id,status,amount\n001, A ,1.50\n002,B,2.00\n")
    values = [v for s, p, v, *_ in facts if p == "value"]
    assert (name, status, coverage) == ("csv", "success", "full")
    assert values == ["001", " A ", "1.50", "002", "B", "2.00"]


def test_csv_sample_is_reported():
    *_, facts, coverage = run("a.csv", b"x,y\n" + b"".join(b"%d,1\n" % i for i in range(25)), limit=3)
    assert coverage == "sample" and ("$", "row_count", 25, "structure", "observed", "file") in facts


def test_headers():
    assert readers.canonical_header(["a", "", "a", "a__duplicate_2", " ", " b "]) == ["a", "__unnamed_column_2", "a__duplicate_2", "a__duplicate_2__duplicate_2", "__unnamed_column_5", " b "]


def test_no_header():
    *_, facts, _ = run("a.csv", b"1,2,3\n4,5,6\n7,8,9\n", "csv_no_header", 2)
    assert not [f for f in facts if f[1] == "name"] and len([f for f in facts if f[1] == "value"]) == 6


def test_json_numbers_keep_spelling():
    *_, facts, _ = run("a.json", b'{"code":"007","v":[3.10,4e2]}')
    assert ("$/v/0", "value", "3.10", "value", "observed", "$/v/0") in facts and ("$/v/1", "type", "number", "structure|encoding", "observed", "$/v/1") in facts


def test_bad_tail_fails_whole_file():
    for name, body in (("a.jsonl", b'{"a":1}\n{"a":2}\n{"a"'), ("a.xml", b"<r><a>1</a><b></r>"), ("a.json", b"{bad")):
        *_, status, issue, facts, _ = run(name, body, limit=1)
        assert status in ("failed", "abstained") and not facts


def test_conflicts_and_unknown_abstain():
    assert run("a.csv", b"PAR1xxxx", "csv")[3] == "format_conflict"
    assert run("x.csv", b'{"a":1}')[3] == "format_conflict"
    assert run("x.bin", b"\x00\x01")[3] == "no_recognized_signature"
    assert run("x.h5", b"\x89HDF\r\n\x1a\n....")[3] == "dependency_unavailable"
    assert detect.decide([])[1] == "no_signature"


def test_xml_namespace_and_occurrences():
    *_, facts, _ = run("a.xml", b'<r xmlns:x="u:1"><x:item k="1"> a </x:item><x:item> b</x:item></r>')
    assert ("/r/item", "value", " a ", "value|syntax", "observed", "/r/item[1]") in facts and ("/r/item", "namespace", "u:1", "structure", "observed", "/r/item[2]") in facts


def test_xsd_is_declared():
    *_, facts, _ = run("a.xsd", b'<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:element name="n" type="xs:int" minOccurs="0"/></xs:schema>')
    assert ("n", "declared_type", "integer") in [f[:3] for f in facts] and ("n", "required", False) in [f[:3] for f in facts]


def test_arff():
    *_, facts, _ = run("a.arff", b"@relation r\n@attribute c {'001','002'}\n@attribute v numeric\n@data\n'001',?\n'002',2.50\n")
    assert ("c", "declared_enum", ["001", "002"]) in [f[:3] for f in facts] and ("v", "value", "NaN") in [f[:3] for f in facts]


def test_json_schema_is_declared():
    body = json.dumps({"$schema": "s", "type": "object", "properties": {"status": {"type": "string", "enum": ["a"]}}, "required": ["status", "missing"]}).encode()
    *_, facts, _ = run("s.json", body)
    assert ("missing", "required", True) in [f[:3] for f in facts] and {f[4] for f in facts} == {"declared"}


def test_xlsx(tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    p = tmp_path / "a.xlsx"
    with zipfile.ZipFile(p, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>code</t></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {ns}><numFmts><numFmt numFmtId="170" formatCode="000"/></numFmts><cellXfs><xf numFmtId="170"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c></row><row r="2"><c r="A2" s="0"><f>1+6</f><v>7</v></c></row></sheetData></worksheet>')
    name, *_, facts, _ = run("a.xlsx", p.read_bytes())
    got = [f[:3] for f in facts]
    assert name == "xlsx" and ("sheet1.code", "raw_token", "7") in got and ("sheet1.code", "number_format", "000") in got and ("sheet1.code", "formula", "1+6") in got


def cdf():
    def text(s):
        b = s.encode()
        return struct.pack(">i", len(b)) + b + b"\0" * (-len(b) % 4)

    def att(name, s):
        return text(name) + struct.pack(">i", 2) + text(s)

    flags = text("flag_values") + struct.pack(">ii", 3, 2) + struct.pack(">2h", 0, 1)
    atts = struct.pack(">ii", 12, 3) + att("units", "K") + flags + att("flag_meanings", "good bad")
    var = text("temperature") + struct.pack(">ii", 1, 0) + atts + struct.pack(">iii", 5, 8, 0)
    return b"CDF\x01" + struct.pack(">i", 0) + struct.pack(">ii", 10, 1) + text("n") + struct.pack(">i", 2) + struct.pack(">ii", 0, 0) + struct.pack(">ii", 11, 1) + var


def test_netcdf_classic():
    *_, facts, _ = run("a.nc", cdf())
    got = [f[:3] for f in facts]
    assert ("temperature", "declared_unit", "K") in got and ("temperature", "shape", [2]) in got and ("temperature", "code_meaning:1", "bad") in got


def test_spark_readers_and_cache(spark, tmp_path):
    for i in range(4):
        (tmp_path / f"f{i}.csv").write_text(f"a,b\n{i},x\n")
    paths = [str(tmp_path / f"f{i}.csv") for i in range(5)]
    manifest = spark.createDataFrame([(p,) for p in paths], "path string")
    first = readers.parse_batch(spark, manifest, None)
    rows = {r.path.rsplit("/", 1)[-1]: r for r in first.collect()}
    assert rows["f4.csv"].issue == "missing_file" and rows["f0.csv"].status == "success"
    receipts = spark.createDataFrame([r for r in first.collect() if r.status == "success"], first.schema)
    again = readers.parse_batch(spark, manifest, receipts).collect()
    assert sum(r.reused for r in again) == 4
    (tmp_path / "f0.csv").write_text("a,b\n9,x\n")
    assert sum(r.reused for r in readers.parse_batch(spark, manifest, receipts).collect()) == 3
    facts = readers.facts(readers.files(spark, str(tmp_path), "*.csv")).filter("predicate = 'value'").count()
    assert facts == 8


def test_zarr(spark, tmp_path):
    store = tmp_path / "s.zarr"
    (store / "a").mkdir(parents=True)
    doc = {"shape": [10, 2], "chunks": [5, 2], "dtype": "<f4", "order": "C", "compressor": None, "filters": None}
    (store / "a" / ".zarray").write_text(json.dumps(doc))
    (store / "a" / "0.0").write_bytes(b"chunk")
    (store / ".zmetadata").write_text(json.dumps({"metadata": {"a/.zarray": {**doc, "shape": [9, 2]}, "b/.zarray": doc}}))
    got = {r["array"].rsplit("/", 1)[-1]: r for r in readers.zarr_arrays(readers.zarr_metadata(spark, str(store))).collect()}
    assert got["a"].shape == [10, 2] and got["a"].conflict and not got["b"].conflict


def test_paths_stay_inside():
    assert readers.inside("/r", "a/b") and not readers.inside("/r", "../b") and not readers.inside("/r", "/b")
