import re

from pyspark.sql import functions as F

from corpusmill.api import Corpus
from corpusmill.functions import text
from corpusmill.operators.index import TextIndex


def corpus(spark):
    docs = spark.createDataFrame(
        [("a", "1a_instancia", "Voto um", "Multa de obra", "obra sem licença em maio de 2099"), ("b", "2a_instancia", "Voto dois", "Ruído", "som alto, obra parada"), ("c", "1a_instancia", "Voto três", "", "nada")],
        "file_id string, instancia string, nome_arquivo string, assunto string, texto string",
    )
    cites = spark.createDataFrame([("a", "2"), ("a", "1"), ("b", "3")], "voto_file_id string, numero string")
    return Corpus(docs, citations=cites, rejected=docs.limit(1))


def test_service(spark):
    c = corpus(spark)
    assert tuple(c.stats().first()) == (3, 3, 1)
    assert [r["file_id"] for r in c.search("obra", "any").collect()] in (["a", "b"], ["b", "a"])
    assert [r["file_id"] for r in c.search("sem LICENCA").collect()] == ["a"]
    assert [r["file_id"] for r in c.search("obra", "words", level="2a_instancia").collect()] == ["b"]
    assert [r["file_id"] for r in c.search("", month="maio", year="2099").collect()] == ["a"]
    assert c.search("", month="maio").count() == 3 and c.search("", level="other", limit=2).count() == 2
    assert "<mark>obra</mark>" in c.search("obra", "words").first()["snippet"]
    row = c.detail("a").first()
    assert [x["numero"] for x in row["citations"]] == ["1", "2"] and "texto" not in row.asDict()
    assert c.detail("none").count() == 0


def test_service_with_an_index_finds_the_same(spark, tmp_path):
    c = corpus(spark)
    asked = [dict(query="obra", mode="any"), dict(query="sem LICENCA"), dict(query="obra", mode="words", level="2a_instancia"), dict(query="", month="maio", year="2099")]
    plain = [[(r["file_id"], round(r["rank"], 9), r["snippet"]) for r in c.search(**a).collect()] for a in asked]
    c.index = TextIndex(spark, f"file://{tmp_path}/index", "file_id", "string")
    c.index.put(c.docs, c.searched_text())
    assert [[(r["file_id"], round(r["rank"], 9), r["snippet"]) for r in c.search(**a).collect()] for a in asked] == plain


def test_file(spark):
    docs = spark.createDataFrame([("a", "/r/x.pdf"), ("b", "/r/../x.doc")], "file_id string, p string")
    assert tuple(Corpus(docs).file("a", "p", "/r").first())[2:] == ("inline", True)
    assert tuple(Corpus(docs).file("b", "p", "/r").first())[2:] == ("attachment", False)


def test_token_snippet(spark):
    raw = "x " * 50 + "lice. a th b " + "y " * 60 + "the lice the"
    got = spark.createDataFrame([(raw,)], "t string").select(text.token_snippet(F.col("t"), ["lice", "th"]).alias("s")).first()["s"]
    assert got.startswith("...<mark>lice</mark>. a <mark>th</mark> b y") and got.endswith("...")
    assert len(re.findall(r"\w+", got.replace("<mark>", "").replace("</mark>", ""))) == 42
    assert spark.createDataFrame([("é lice",)], "t string").select(text.token_snippet(F.col("t"), ["e"]).alias("s")).first()["s"] == "<mark>é</mark> lice"
