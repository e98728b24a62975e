"""Exports that fail leave the former one; word-processor text."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from corpusmill.sources import files, sinks


def lines(path):
    return [json.loads(line)["a"] for f in sorted(path.glob("part-*")) for line in f.read_text().splitlines()]


def left(folder):
    return sorted(p.name for p in folder.iterdir() if p.name != "out")


def test_a_failing_task_leaves_the_former_export(spark, tmp_path):
    path, out = f"file://{tmp_path}/out", tmp_path / "out"
    sinks.json_lines(spark.range(50, 0, -1).select(F.col("id").alias("a")), path, ["a"])
    assert lines(out) == list(range(1, 51))
    failing = spark.range(0, 90, 1, 9).select(F.when(F.col("id") == 77, F.raise_error(F.lit("broken row"))).otherwise(F.col("id")).cast("long").alias("a"), "id")
    with pytest.raises(Exception, match="broken row"):
        sinks.json_lines(failing, path, ["id"])
    assert lines(out) == list(range(1, 51)) and left(tmp_path) == []
    # an export may read what it replaces
    sinks.json_lines(spark.read.json(path).where("a > 45"), path, ["a"])
    assert lines(out) == [46, 47, 48, 49, 50] and left(tmp_path) == []


def test_a_writer_that_ends_between_the_renames(spark, tmp_path):
    path, out = f"file://{tmp_path}/out", tmp_path / "out"
    sinks.json_lines(spark.range(3).select(F.col("id").alias("a")), path, ["a"])
    out.rename(tmp_path / ".out.former")
    assert sinks.restore(spark, path) and lines(out) == [0, 1, 2]
    assert not sinks.restore(spark, path)
    out.rename(tmp_path / ".out.former")
    with pytest.raises(ZeroDivisionError):
        sinks.replaced(spark, path, lambda beside: 1 / 0)
    assert lines(out) == [0, 1, 2] and left(tmp_path) == []
    # the new one came, the former one was not removed yet
    (tmp_path / ".out.former").mkdir()
    assert not sinks.restore(spark, path) and lines(out) == [0, 1, 2] and left(tmp_path) == []


WORD = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:x="other"'
P = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"


def container(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, xml in parts.items():
            z.writestr(f"word/{name}.xml", xml)
    return out.getvalue()


def body(inner):
    return f'<?xml version="1.0" encoding="UTF-8"?><w:document {WORD}><w:body>{inner}</w:body></w:document>'


def test_word_processor_text():
    inner = P("um &amp; dois") + "<w:p><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t><w:br/><w:t xml:space='preserve'> c</w:t></w:r><w:instrText>no</w:instrText><x:t>no</x:t></w:p>"
    inner += f"<w:tbl><w:tr><w:tc>{P('x')}</w:tc><w:tc>{P('é')}</w:tc></w:tr></w:tbl>"
    data = container(document=body(inner), footer1=f"<w:ftr {WORD}>{P('foot')}</w:ftr>", header2=f"<w:hdr {WORD}>{P('h2')}</w:hdr>", header1=f"<w:hdr {WORD}>{P('h1')}</w:hdr>", styles="<s/>")
    assert files.docx_text(data) == "h1\n\nh2\n\num & dois\n\na\tb\n c\n\nx\n\né\n\nfoot"
    assert files.docx_text(container(document=body(""))) == ""


def test_broken_and_hostile_containers():
    good = container(document=body(P("x" * 5000)))
    with pytest.raises(zipfile.BadZipFile):
        files.docx_text(good[:-30])
    with pytest.raises(ValueError, match="no document"):
        files.docx_text(container(styles="<s/>"))
    with pytest.raises(ValueError, match="larger than"):
        files.docx_text(good, 1000)
    with pytest.raises(ValueError, match="document type"):
        files.docx_text(container(document='<!DOCTYPE d [<!ENTITY a "aaaa">]>' + body(P("&a;")).partition("?>")[2]))


def test_word_processor_files_are_read(spark, tmp_path):
    (tmp_path / "a.DOCX").write_bytes(container(document=body(P("texto"))))
    (tmp_path / "b.docx").write_bytes(b"not a container")
    got = {r["path"][-6:]: r for r in files.extracted(spark, str(tmp_path)).collect()}
    assert got["a.DOCX"]["text"] == "texto" and got["a.DOCX"]["error"] is None
    assert got["b.docx"]["text"] is None and "BadZipFile" in got["b.docx"]["error"]
