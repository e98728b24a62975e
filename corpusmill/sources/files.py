"""Readers: nested JSON lines with each reader's rules for bad and repeated rows, CSV with a byte-order mark, one JSON
object, whole text files, directory listings, and documents by pluggable extractors."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

CITATION = "struct<numero:string,idn:string,tipo:string,autuado:string,infracao:string,dispositivo_legal_transgredido:string,local_constatacao:string,lei:string,pdf_encontrado:boolean>"
# The field names of the files.
DECISIONS = f"file_id string, nome_arquivo string, instancia string, decisao_instancia string, caminho_bruto string, protocolo string, assunto string, autos array<{CITATION}>, texto string, drive_file_id_publico string, drive_view_url string, drive_preview_url string"
OPINIONS = "file_id string, nome_arquivo string, categoria string, pasta string, ext string, texto string, drive_view_url string, drive_preview_url string, ocr boolean, tem_arquivo_publico boolean"
SUBJECTS = ["protocolo", "assunto", "ato_constitutivo"]


def json_lines(spark: SparkSession, path: str, schema: str, mode: str = "FAILFAST") -> DataFrame:
    """PERMISSIVE keeps bad lines in `_corrupt_record`, DROPMALFORMED drops them, FAILFAST raises. Blank lines don't count."""
    if mode == "PERMISSIVE":
        schema += ", _corrupt_record string"
    return spark.read.schema(schema).option("mode", mode).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) in file order; the number only orders lines within a file."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"), "value").where(F.trim("value") != "")


def one_per_id(spark: SparkSession, path: str, schema: str, keep: str = "last", key: str = "file_id", where: str = "true") -> DataFrame:
    """Parsed lines with one row for each key: the first or the last that fits `where`."""
    rows = numbered_lines(spark, path).select("file", "line", F.from_json("value", schema).alias("r")).where(F.col(f"r.{key}").isNotNull()).select("file", "line", "r.*").where(where)
    order = [F.col("file"), F.col("line")] if keep == "first" else [F.desc("file"), F.desc("line")]
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n", "file", "line")


def until_bad(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Parsed lines of each file before its first bad one."""
    bad = "r is null or r._corrupt_record is not null"
    rows = numbered_lines(spark, path).select("file", "line", F.from_json("value", schema + ", _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    first = rows.where(bad).groupBy("file").agg(F.min("line").alias("stop"))
    return rows.join(first, "file", "left").where(F.col("stop").isNull() | (F.col("line") < F.col("stop"))).select("r.*").drop("_corrupt_record")


def subjects_csv(spark: SparkSession, path: str) -> DataFrame:
    """The subject file; a byte-order mark is dropped, and another header than the known one gives no rows."""
    df = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    names = [c.lstrip("\ufeff") for c in df.columns]
    if names != SUBJECTS:
        return spark.createDataFrame([], StructType([StructField(c, StringType()) for c in SUBJECTS]))
    return df.toDF(*names)


def subjects_ready(spark: SparkSession, path: str) -> bool:
    """Whether rows may be appended to the subject file; if its header is another, the file is to be written anew."""
    first = spark.read.text(path).limit(1).collect()
    return bool(first) and first[0]["value"].lstrip("\ufeff").rstrip("\r") == ",".join(SUBJECTS)


def json_object(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object as one row; a missing or bad file, or another kind of value, gives a row of nulls."""
    empty = spark.range(1).select(F.from_json(F.lit("{}"), schema).alias("o")).select("o.*")
    try:
        found = spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("o")).limit(1).collect()
    except Exception as e:  # noqa: BLE001  only a path that isn't there
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return empty
    return spark.createDataFrame([found[0]["o"]], schema) if found and found[0]["o"] is not None else empty


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, size, modified) of all files below a folder; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


MAX_CHARS = 120_000  # of a text; 0: no limit
Extractor = Callable[[bytes], str | None]
#: By extension. Formats that need other programs (PDF, old word processors, OCR) plug in here.
EXTRACTORS: dict[str, Extractor] = {".txt": lambda data: data.decode("utf-8", errors="ignore")}


MAX_XML = 64 << 20  # bytes of a container's part
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_PARTS = re.compile(r"word/(?:(header)\d*|(document)|(footer)\d*)\.xml")


def docx_text(data: bytes, most: int = MAX_XML) -> str:
    """Text of a word-processor container: headers, body with the cells of tables, footers; an empty line between paragraphs.

    A part of more than `most` bytes, one with a document type (entities could grow without bound) and a broken container are errors.
    """
    with zipfile.ZipFile(io.BytesIO(data)) as container:
        found = [(m, m.lastindex) for m in map(_PARTS.fullmatch, container.namelist()) if m]
        if not any(kind == 2 for _, kind in found):
            raise ValueError("no document in the container")
        parts = []
        for match, _ in sorted(found, key=lambda f: (f[1], f[0][0])):
            with container.open(match[0]) as part:
                xml = part.read(most + 1)
            if len(xml) > most:
                raise ValueError(f"{match[0]} is larger than {most} bytes")
            parts.append(_part_text(xml))
    return "".join(parts).strip()


def _part_text(xml: bytes) -> str:
    out: list[str] = []

    def refuse(*_: object) -> None:
        raise ValueError("a document type")

    class Target:
        within = False

        def start(self, tag: str, _: dict) -> None:
            self.within = tag == _WORD + "t"
            out.append({"p": "\n\n", "tab": "\t", "br": "\n", "cr": "\n"}.get(tag.removeprefix(_WORD), "") if tag.startswith(_WORD) else "")

        def end(self, tag: str) -> None:
            self.within = False

        def data(self, text: str) -> None:
            if self.within:
                out.append(text)

        doctype = staticmethod(refuse)

        def close(self) -> str:
            return "".join(out)

    parser = ElementTree.XMLParser(target=Target())
    parser.feed(xml)
    return parser.close()


EXTRACTORS[".docx"] = docx_text


def register(extension: str, extractor: Extractor) -> None:
    EXTRACTORS[extension.lower()] = extractor


def extracted(spark: SparkSession, path: str, max_chars: int = MAX_CHARS, extractors: dict[str, Extractor] | None = None) -> DataFrame:
    """(path, text, error) of all files below a folder. An extractor's failure is its row's error; max_chars 0: no limit."""
    known = dict(EXTRACTORS if extractors is None else extractors)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for where, data in zip(frame["path"], frame["content"], strict=True):
                name = where.rsplit("/", 1)[-1]
                extension = "." + name.rsplit(".", 1)[-1].lower() if "." in name.lstrip(".") else ""
                try:
                    text = known[extension](bytes(data))
                    rows.append((where, text[:max_chars] if text and max_chars else text, None if text is not None else "no text"))
                except KeyError:
                    rows.append((where, None, "no extractor"))
                except Exception as e:  # noqa: BLE001  told in its row
                    rows.append((where, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "text", "error"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    return files.mapInPandas(work, "path string, text string, error string")
