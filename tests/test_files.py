"""Spreadsheets, keyword lists and JSON of earlier steps."""

import json
import zipfile

import pytest

from termloom.sources import corpus as C
from termloom.sources import files, sinks


def column(k):
    return (column(k // 26 - 1) if k >= 26 else "") + chr(65 + k % 26)


def workbook(path, sheets, inline=False):
    """An xlsx file of {sheet: rows}; None leaves a cell out, a number is stored as one."""
    shared = []

    def cell(r, c, v):
        at = f'r="{column(c)}{r + 1}"'
        if v is None:
            return ""
        if isinstance(v, bool):
            return f'<c {at} t="b"><v>{int(v)}</v></c>'
        if isinstance(v, int | float):
            return f"<c {at}><v>{v}</v></c>"
        if inline:
            return f'<c {at} t="inlineStr"><is><t>{v}</t></is></c>'
        shared.append(v)
        return f'<c {at} t="s"><v>{len(shared) - 1}</v></c>'

    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        listed = "".join(f'<sheet name="{n.replace("&", "&amp;")}" sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{rel}"><sheets>{listed}</sheets></workbook>')
        targets = "".join(f'<Relationship Id="rId{k}" Type="{rel}/worksheet" Target="worksheets/s{k}.xml"/>' for k in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{targets}</Relationships>')
        for k, rows in enumerate(sheets.values(), 1):
            body = "".join(f'<row r="{r + 1}">{"".join(cell(r, c, v) for c, v in enumerate(row))}</row>' for r, row in enumerate(rows))
            z.writestr(f"xl/worksheets/s{k}.xml", f"<worksheet {main}><sheetData>{body}</sheetData></worksheet>")
        if shared:
            # a text of two runs, with how it is pronounced
            items = "".join(f"<si><r><t>{s[:1]}</t></r><r><t>{s[1:]}</t></r><rPh><t>x</t></rPh></si>" for s in shared)
            z.writestr("xl/sharedStrings.xml", f"<sst {main}>{items}</sst>")


@pytest.mark.parametrize("inline", [False, True])
def test_sheet(spark, tmp_path, inline):
    path = str(tmp_path / "b.xlsx")
    wide = [None] * 27 + ["far"]
    workbook(path, {"other": [["x"]], "s": [["a", "b", *wide], ["one", 2, *wide], [None, "NA"], [], ["", True]]}, inline)
    got = {tuple(r) for r in files.sheet_cells(spark, path, "s").collect()}
    assert got == {(1, 0, "a", "one"), (1, 1, "b", "2"), (1, 29, "far", "far"), (4, 1, "b", "True")}
    assert files.sheet_cells(spark, path, "none", required=False).count() == 0
    with pytest.raises(Exception, match="no sheet 'none'"):
        files.sheet_cells(spark, path, "none").collect()


def test_places_with_and_without_spellings(spark, tmp_path):
    rows = [["Country code", "NUTS Code", "NUTS label", "note"], ["AT", "AT1", " Ostösterreich ", "left out"], ["AT", "AT2", None, None]]
    workbook(tmp_path / "one.xlsx", {files.PLACE_SHEET: rows})
    workbook(tmp_path / "two.xlsx", {files.PLACE_SHEET: rows, files.SPELLING_SHEET: [["Greek", "Latin"], ["Αττική", "Attiki"]]})
    one = [r.term for r in files.place_terms(spark, str(tmp_path / "one.xlsx")).collect()]
    assert sorted(one) == sorted({"AT", "AT1", "AT2", "Ostösterreich", *C.COUNTRIES})
    two = [r.term for r in files.place_terms(spark, str(tmp_path / "two.xlsx")).collect()]
    assert sorted(two) == sorted({*one, "Αττική", "Attiki"})


def test_keywords_and_descriptions_keep_their_order(spark, tmp_path):
    words = {"transport": {"rail (fast)": 3, "car": 1}, "energy": {"gas": 2}, "empty": {}}
    (tmp_path / "k.json").write_text(json.dumps(words, indent=2, ensure_ascii=False), "utf-8")
    rows = files.keywords(spark, str(tmp_path / "k.json"))
    assert [tuple(r) for r in rows.orderBy("domain_idx").collect()] == [("transport", 0, "rail (fast)", 3.0), ("transport", 0, "car", 1.0), ("energy", 1, "gas", 2.0)]
    assert C.lexicon(rows).filter("pattern IS NULL").count() == 0
    (tmp_path / "d.json").write_text('{"b": "Öl, gas", "a": "x"}', "utf-8")
    got = files.descriptions(spark, str(tmp_path / "d.json"))
    assert [tuple(r) for r in got.orderBy("domain_idx").collect()] == [("b", 0, "Öl, gas"), ("a", 1, "x")]
    (tmp_path / "bad.json").write_text('{"b": ', "utf-8")
    with pytest.raises(Exception, match="MALFORMED|Malformed|parse"):
        files.descriptions(spark, str(tmp_path / "bad.json")).collect()


def test_step_values(spark, tmp_path):
    step = {"t1": {"geo": ["Austria", "Köln"], "none": []}, "t2": {}, "t3": {"geo": ["x"]}}
    (tmp_path / "s.json").write_text(json.dumps(step, indent=2, ensure_ascii=False), "utf-8")
    got = files.step_values(spark, str(tmp_path / "s.json"))
    assert sorted(map(tuple, got.collect())) == [("t1", "geo", "Austria"), ("t1", "geo", "Köln"), ("t3", "geo", "x")]
    sinks.write_json(sinks.nested_values(got), str(tmp_path / "out"))
    assert sorted(map(tuple, files.nested_lines(spark, str(tmp_path / "out")).collect())) == sorted(map(tuple, got.collect()))
