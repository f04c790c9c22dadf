import zipfile

import pytest
from pyspark.sql import functions as F

from lumen.operators import evaluate as E
from lumen.sources import readers, sheets, sinks


def test_workbook_round_trip(spark, tmp_path):
    path = str(tmp_path / "report.xlsx")
    df = spark.createDataFrame([(1, "a <b> & \"c\"\r\n é", 0.5, True, [1, 2]), (2, None, float("nan"), None, None), (3, " two ", -1e300, False, [])], "n long, t string, x double, f boolean, l array<int>")
    assert sinks.workbook({"all / rows": df, "none": df.limit(0), "n": df.select("n")}, path) == ["all / rows", "n"]
    got = readers.by_suffix(spark, path)
    assert got.dtypes == [(c, "string") for c in "ntxfl"]
    want = [("1", "a <b> & \"c\"\r\n é", "0.5", "1", "[1,2]"), ("2", None, None, None, None), ("3", " two ", "-1e+300", "0", "[]")]
    assert sorted(tuple(r) for r in got.collect()) == want
    assert sorted(r[0] for r in sheets.read(spark, path, "n").collect()) == ["1", "2", "3"]
    assert sorted(r[0] for r in sheets.read(spark, path, 1).collect()) == ["1", "2", "3"]
    with pytest.raises(Exception, match="no sheet"):
        sheets.read(spark, path, "x").collect()
    with pytest.raises(ValueError):
        readers.by_suffix(spark, str(tmp_path / "old.xls"))


def test_workbook_of_another_writer(spark, tmp_path):
    """Shared and formatted strings, cells left out, cells without places, repeated and missing names, errors, empty rows."""
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    kind = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    body = (
        '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c><c r="D1" t="s"><v>0</v></c></row>'
        '<row r="2"><c r="A2"><v>7</v></c><c r="C2" t="s"><v>2</v></c></row><row r="3"/>'
        '<row r="4"><c t="str"><f>A1</f><v>x</v></c><c t="e"><v>#N/A</v></c><c t="b"><v>1</v></c><c r="AA4"><v>9</v></c></row>'
    )
    for name in ("one", "two"):
        with zipfile.ZipFile(tmp_path / f"{name}.xlsx", "w") as z:
            z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{kind}"><sheets><sheet name="s" sheetId="1" r:id="q"/></sheets></workbook>')
            z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="p"><Relationship Id="q" Target="/xl/w.xml"/></Relationships>')
            z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>id</t></si><si><t>name</t></si><si><r><t>Jo</t></r><r><t>hn</t></r><rPh><t>x</t></rPh></si></sst>')
            z.writestr("xl/w.xml", f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')
    got = readers.by_suffix(spark, str(tmp_path / "*.xlsx"))
    assert got.columns == ["id", "_c1", "name", "id_3"]
    assert sorted(tuple(r) for r in got.collect()) == [("7", None, "John", None)] * 2 + [("x", None, "1", None)] * 2


def test_workbook_limits(spark, tmp_path):
    with pytest.raises(ValueError, match="too many rows"):
        sinks.workbook({"long": spark.range(sheets.MOST_ROWS)}, str(tmp_path / "w.xlsx"))
    assert sinks.workbook({"none": spark.range(0)}, str(tmp_path / "w.xlsx")) == []
    assert not (tmp_path / "w.xlsx").exists()
    sinks.workbook({"t": spark.range(3 * sheets.BATCH + 1)}, str(tmp_path / "w.xlsx"))
    assert sheets.read(spark, str(tmp_path / "w.xlsx")).agg(F.sum(F.col("id").cast("long"))).first()[0] == sum(range(3 * sheets.BATCH + 1))


def test_latest_tables_and_evaluation_from_sheets(spark, tmp_path):
    folder = str(tmp_path / "d")
    for stamp, n in (("20250101_000000", 1), ("20250102_000000", 2)):
        for prefix in ("truth", "found"):
            spark.range(n).select(F.concat(F.lit("Img"), "id", F.lit(".jpg")).alias("image_id"), F.lit(2).alias("true_faces" if prefix == "truth" else "face_count")).write.parquet(f"{folder}/{prefix}_{stamp}.parquet")
    out = str(tmp_path / "w.xlsx")
    assert sinks.parquet_to_workbook(spark, folder, ["truth", "found"], out) == ["truth_20250102_000000.parquet", "found_20250102_000000.parquet"]
    rows = E.count_report(sheets.read(spark, out, "truth"), sheets.read(spark, out, "found"))
    assert [tuple(r) for r in rows.collect()] == [("img0", 2, 2, 2, 0, 0), ("img1", 2, 2, 2, 0, 0)]
    assert sinks.parquet_to_workbook(spark, folder, ["truth"], out, "20250101_000000") == ["truth_20250101_000000.parquet"]
    assert sheets.read(spark, out).count() == 1
    with pytest.raises(FileNotFoundError):
        sinks.parquet_to_workbook(spark, folder, ["other"], out)
