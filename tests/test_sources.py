import json

import pytest
from pyspark.sql import functions as F

from corpusmill.sources import files, listing, sinks
from corpusmill.streaming import feed

GOOD = [{"file_id": "a", "texto": "um"}, {"file_id": "b", "texto": ""}, {"file_id": "a", "texto": "dois"}]


@pytest.fixture
def lines(tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text("\n".join([json.dumps(GOOD[0]), "", json.dumps(GOOD[1]), "not json", json.dumps(GOOD[2])]) + "\n")
    return str(path)


def test_json_modes(spark, lines):
    schema = "file_id string, texto string"
    rows = files.json_lines(spark, lines, schema, "PERMISSIVE").cache()
    assert rows.count() == 4 and rows.where("_corrupt_record is not null").count() == 1
    assert files.json_lines(spark, lines, schema, "DROPMALFORMED").select("file_id", "texto").collect().__len__() == 3
    with pytest.raises(Exception, match="MALFORMED|FAILFAST"):
        files.json_lines(spark, lines, schema).collect()
    assert {r["texto"] for r in files.one_per_id(spark, lines, schema, "first").collect()} == {"um", ""}
    assert {r["texto"] for r in files.one_per_id(spark, lines, schema, "last").collect()} == {"dois", ""}
    assert [r["texto"] for r in files.until_bad(spark, lines, schema).collect()] == ["um", ""]


def test_csv_and_object(spark, tmp_path):
    good, other = tmp_path / "a.csv", tmp_path / "b.csv"
    good.write_text('\ufeffprotocolo,assunto,ato_constitutivo\n1,"a, b",c\n', encoding="utf-8")
    other.write_text("x,y\n1,2\n")
    assert [tuple(r) for r in files.subjects_csv(spark, str(good)).collect()] == [("1", "a, b", "c")]
    assert files.subjects_csv(spark, str(other)).count() == 0
    schema = "schema int, counts map<string,bigint>"
    sinks.checkpoint_object({"schema": 2, "counts": {"votos": 3}}, f"{tmp_path}/m.json", spark)
    sinks.checkpoint_object({"schema": 3, "counts": {"votos": 4}}, f"{tmp_path}/m.json", spark)
    row = files.json_object(spark, f"{tmp_path}/m.json", schema).first()
    assert row["schema"] == 3 and row["counts"] == {"votos": 4}
    assert files.json_object(spark, f"{tmp_path}/none.json", schema).first()["schema"] is None
    assert sinks.patch_checkpoint({"counts": {"a": 1, "b": 2}, "x": 9}, {"b": 3}, {"matched": 1}, "d") == {"counts": {"a": 1, "b": 3}, "x": 9, "public_drive": {"matched": 1}, "description": "d"}


def test_nested_round_trip(spark, tmp_path):
    row = {"file_id": "a", "nome_arquivo": "x", "autos": [{"numero": "1", "pdf_encontrado": True}], "texto": "t"}
    (tmp_path / "in.jsonl").write_text(json.dumps(row))
    df = files.json_lines(spark, f"{tmp_path}/in.jsonl", files.DECISIONS)
    sinks.json_lines(df, f"{tmp_path}/out", ["decisao_instancia", "nome_arquivo"], with_text=False)
    back = files.json_lines(spark, f"{tmp_path}/out", files.DECISIONS).first()
    assert back["autos"][0]["pdf_encontrado"] is True and back["texto"] is None


def test_extractors(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.TXT").write_bytes(b"abc\xff def")
    (tmp_path / "d" / "b.bad").write_bytes(b"x")
    (tmp_path / "d" / "c.pdf").write_bytes(b"x")
    got = {r["path"][-5:]: r for r in files.extracted(spark, str(tmp_path), 5, {**files.EXTRACTORS, ".bad": lambda data: 1 / 0}).collect()}
    assert got["a.TXT"]["text"] == "abc d" and "ZeroDivisionError" in got["b.bad"]["error"] and got["c.pdf"]["error"] == "no extractor"
    assert {r["name"] for r in files.listing(spark, str(tmp_path)).collect()} == {"a.TXT", "b.bad", "c.pdf"}


def test_fan_out_and_csv(spark, tmp_path):
    df = spark.createDataFrame([("1a", "LEI 1", "X", 1), ("1a", "LEI 1", "X", 2), ("2a", "LEI 2", "Y", 1)], "level string, law string, act string, id int")
    sinks.fan_out(df, f"{tmp_path}/tree")
    assert spark.read.parquet(f"{tmp_path}/tree").where("law = 'LEI 1'").count() == 2
    sinks.csv_rows(df.union(df), f"{tmp_path}/csv", df.where("id = 2"))
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").count() == 2


class FakeClient:
    """Two pages for each folder; the first call of each process fails."""

    failed = False

    def page(self, folder, token, pushed):
        if not FakeClient.failed:
            FakeClient.failed = True
            raise OSError("try again")
        number = int(token or 0)
        items = [{"id": f"{folder}{number}{k}", "name": f"n{k}", "mimeType": "pdf" if k else "doc", "modifiedTime": f"2099-01-0{k + 1}"} for k in range(2)]
        if "types" in pushed:
            items = [i for i in items if i["mimeType"] in pushed["types"]]
        return items, str(number + 1) if number < 1 else None


def test_listing_source(spark):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(listing.ListingSource)
    df = spark.read.format("listing").option("client", "tests.test_sources.FakeClient").option("wait", "0").load("f,g")
    assert df.count() == 8
    assert {r["id"] for r in df.where(F.col("mimeType") == "pdf").collect()} == {"f01", "f11", "g01", "g11"}
    assert list(listing.waits(7)) == [2, 4, 8, 16, 32, 60, 60]


def test_stream(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").limit(50)
    for _ in range(2):
        events.write.mode("append").parquet(f"{tmp_path}/in")
    stream = feed.deduplicated(feed.read(spark, f"{tmp_path}/in", events.schema, 1), ["event_id"], "ts", "60 days")
    seen = []
    feed.upsert_batches(stream, lambda batch, n: seen.append((n, batch.count())), f"{tmp_path}/ck").awaitTermination()
    assert sum(c for _, c in seen) == 50
    feed.upsert_batches(stream, lambda batch, n: seen.append((n, batch.count())), f"{tmp_path}/ck").awaitTermination()
    assert sum(c for _, c in seen) == 50
