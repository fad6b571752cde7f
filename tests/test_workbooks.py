"""Workbooks written by hand and read again."""

import hashlib
import zipfile

import pytest

from ladderlake.sources import workbooks as wb

X = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def workbook(path, sheets):
    """A minimal workbook; texts are shared strings, and numbers are numbers."""
    shared = sorted({v for rows in sheets.values() for row in rows for v in row if isinstance(v, str)})
    letter = lambda c: (chr(64 + c // 26) if c >= 26 else "") + chr(65 + c % 26)
    cell = lambda r, c, v: "" if v is None else f'<c r="{letter(c)}{r}" t="s"><v>{shared.index(v)}</v></c>' if isinstance(v, str) else f'<c r="{letter(c)}{r}"><v>{v}</v></c>'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{X}" xmlns:r="{R}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i + 1}" r:id="r{i}"/>' for i, n in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i, _ in enumerate(sheets)) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{X}">' + "".join(f"<si><t>{v}</t></si>" for v in shared) + "</sst>")
        for i, rows in enumerate(sheets.values()):
            body = "".join(f'<row r="{r}">' + "".join(cell(r, c, v) for c, v in enumerate(row)) + "</row>" for r, row in enumerate(rows, 1) if any(v is not None for v in row))
            z.writestr(f"xl/worksheets/s{i}.xml", f'<worksheet xmlns="{X}"><sheetData>{body}</sheetData></worksheet>')


@pytest.fixture
def folder(tmp_path):
    workbook(tmp_path / "one.xlsx", {
        "Players": [["Server", "Spieler", "Tag", "THP"], [551, "Lora", "ABc", 250000000.0], ["#552", "Mena", None, "1.5b"], [None, "nobody", None, 1]],
        "Metrics": [["Server", "kills", "score"], [551, 5, "1,000"], ["x", 1, 1], [552, None, 7]],
        "Pairs": [["a", 551, 2000000, None], [None, 552, 10, 553]],
        "Plain": [[551, "x", 5000000], [552, None, 6000000]],
        "Cities": [["Server", "n"], ["S551", 3], ["none", 4]],
        "Empty": [],
    })
    (tmp_path / "broken.xlsx").write_bytes(b"no workbook")
    return str(tmp_path)


def test_sheets_by_specification(spark, folder):
    specs = [wb.SheetSpec("Players"), wb.SheetSpec("Metrics", "wide"), wb.SheetSpec("Pairs", "pairs"), wb.SheetSpec("Plain", "headerless", value=2), wb.SheetSpec("Cities", "cities")]
    got = {k: {tuple(r[c] for c in df.columns) for r in df.collect()} for k, df in ((k, df.select(*sorted(df.columns))) for k, df in wb.load_workbooks(spark, folder, specs).items())}
    assert got["Players"] == {("ABc", "Lora", 551, 250000000), (None, "Mena", 552, 15000000000), (None, "nobody", None, 1)}
    assert got["Metrics"] == {("kills", 551, 5), ("score", 551, 1000), ("score", 552, 7)}
    assert got["Pairs"] == {(1, 1, 551, "Pairs", 2000000)} and got["Plain"] == {(551, 5000000), (552, 6000000)}
    assert {r[-1] for r in got["Cities"]} == {551}


def test_missing_columns_and_kinds_are_named(spark, folder):
    cells = wb.workbook_cells(spark, folder)
    with pytest.raises(ValueError, match="server, value"):
        wb.load_sheet(cells, wb.SheetSpec("Empty"))
    with pytest.raises(ValueError, match="kind"):
        wb.SheetSpec("Players", "other")
    assert wb.sheet_table(cells, "Empty").count() == 0


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x/one.png", b"1")
        z.writestr("x/.two.png", b"2")
        z.writestr("three.txt", b"3")
    (tmp_path / "b.zip").write_bytes(b"none")
    assert [tuple(r) for r in wb.archive_entries(spark, str(tmp_path)).collect()] == [("a.zip", "x/one.png", 1, hashlib.sha256(b"1").hexdigest())]
