"""One invented row for each rule, and brute-force twins where SQL has none."""

import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import extract, fold, naming, text
from corpusmill.operators import search, state


def one(spark, column, **values):
    names = list(values)
    schema = ", ".join(f"{n} {'string' if values[n] is None or isinstance(values[n], str) else 'bigint'}" for n in names)
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


T = None


@pytest.fixture(autouse=True, scope="module")
def _column(spark):
    """Columns need a session."""
    global T
    T = F.col("t")


def test_codes(spark):
    assert one(spark, extract.codes(T), t="Assunto: autos 20990000001AN, 20990000002AI e 20990000001AN") == ["20990000001AN", "20990000002AI"]
    assert one(spark, extract.codes(T), t="1234567AN 12345678AN 123456789012345AN 12345678an") == ["12345678AN"]


@pytest.mark.parametrize(("raw", "want"), [("Assunto: a\nb\n\nc", "a b"), ("Assunto - x\nCPF 1", "x"), ("nada", "")])
def test_subject(spark, raw, want):
    assert one(spark, extract.subject(T), t=raw) == want


def test_protocol(spark):
    assert one(spark, extract.protocol(F.col("n"), T), n="x 31.000001_2099-01.pdf", t="31.000002_2099-01") == "31.000001_2099-01"
    assert one(spark, extract.protocol(F.col("n"), T), n="x", t="see 31.000002-01") == ""


def test_levels(spark):
    assert [one(spark, naming.is_first_level(T), t=x) for x in ("SESSÃO 001", "Sessão nº 450", "sessão 000", "sessão 1000")] == [True, True, False, False]
    assert [one(spark, naming.is_second_level(T), t=x) for x in ("Votos dos Relatores", "VOTO RELATORA X", "Relatores", "voto dos relatres")] == [True, True, False, True]


def test_names(spark):
    assert one(spark, naming.act_folder(T), t="Ocupar, habitar ou utilizar edificaçãO sem a 31.361,93 licença") == "OCUPAR, HABITAR OU UTILIZAR EDIFICAÇÃO"
    assert one(spark, naming.act_folder(T), t="da") == "DA"
    assert one(spark, naming.act_folder(T), t=" 12 ") == ""
    assert [one(spark, naming.with_extension(T, F.lit(".pdf")), t=x) for x in ("Voto.PDF", "Voto")] == ["Voto.PDF", "Voto.pdf"]
    assert one(spark, fold.safe_file(T), t=" a/b:c  d. ") == "a_b_c d"
    assert one(spark, fold.safe_file(T), t=" . ") == "sem_nome" and one(spark, fold.safe_file(T), t=None) == "sem_nome"
    assert one(spark, naming.law_folder(T), t="") == "SEM LEI" and one(spark, naming.law_folder(T), t="LEI 1/19") == "LEI 1_19"


def test_values(spark):
    assert [one(spark, extract.once(T), t=x) for x in ("RUA X RUA X", "RUA X RUA", " : a  b -")] == ["RUA X", "RUA X RUA", "a b"]
    assert one(spark, extract.cell_value(T, "bairro"), t="Bairro\nCentro\nCentro") == "Centro"
    assert one(spark, extract.cell_value(T, "bairro"), t="BAIRRO: Sul") == "Sul"
    assert one(spark, extract.cell_value(T, "bairro"), t="Outro") is None
    assert one(spark, extract.first_law(T), t="Art. 1, lei 11111/19") == "LEI 11111/19"


@pytest.mark.parametrize(
    ("name", "body", "want"),
    [
        ("_ATA 1", "Ata da 1ª sessão", "ata de sessao"),
        ("x", "Controle de Votação", "controle de votacao"),
        ("x", "DISPOSITIVO DA DECISÃO", None),
        ("x", "olá", "sem dispositivo da decisao"),
        ("x", "", "sem dispositivo da decisao"),
        ("x", None, "texto nao extraido"),
        ("Cópia de Sessão 12", "Junta Integrada de Julgamento Fiscal sessão presidente dispositivo da decisao", "nome de sessao confirmado pelo conteudo"),
        ("voto", "Junta Integrada de Julgamento Fiscal sessão secretaria defesas julgadas", "ata com defesas julgadas"),
    ],
)
def test_rejection(spark, name, body, want):
    assert one(spark, extract.rejection(F.col("n"), T), n=name, t=body) == want


def test_fold(spark):
    raw = "ÀÉîõÜç ñ Ệ é ª ﬁ"
    want = "".join(c for c in unicodedata.normalize("NFD", raw) if not unicodedata.combining(c)).lower()
    assert one(spark, fold.fold(T), t=raw) == want
    assert one(spark, fold.norm(T), t=" 1ª  Straße ") == "1a strasse"
    assert one(spark, fold.norm_label(T), t="Nome/Razão-Social:") == "nome razao social"


def test_suffixes(spark):
    df = spark.createDataFrame([(1, "a.pdf"), (2, "a.pdf"), (3, "a.pdf"), (4, "a (1).pdf")], "id int, p string")
    out = state.unique_suffix(df, "p", [F.col("id")], F.regexp_replace("p", "\\.pdf$", ""), F.lit(".pdf"))
    got = {r["id"]: r["unique_name"] for r in out.collect()}
    assert got[1] == "a.pdf" and got[4] == "a (1).pdf" and got[3] == "a (2).pdf"
    assert len(set(got.values())) == 4


def brute_highlight(raw, needles):
    def esc(s):
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
            s = s.replace(a, b)
        return s

    low = "".join(c for c in unicodedata.normalize("NFD", raw) if not unicodedata.combining(c)).lower()
    marks = [False] * (len(raw) + 1)
    for n in needles:
        for m in re.finditer(re.escape(n), low):
            for i in range(m.start(), m.end()):
                marks[i] = True
    out, on = "", False
    for i, c in enumerate(raw):
        if marks[i] and not on:
            out, on = out + "<mark>", True
        if on and not marks[i]:
            out, on = out + "</mark>", False
        out += esc(c)
    return out + ("</mark>" if on else "")


@pytest.mark.parametrize("raw", ["Ação ação", "a<b>tiontion & 'the' thion", "", "nada"])
def test_highlight(spark, raw):
    needles = ["acao", "tion", "the", "ion"]
    assert one(spark, text.highlight(T, needles), t=raw) == brute_highlight(raw, needles)


def test_highlight_query(spark):
    from corpusmill.plans.registry import QUERIES

    for r in QUERIES["highlight_ranges"](spark, "/root/testdata/sf0.001").collect():
        raw = re.sub("</?mark>", "", r["html"]).replace("&#039;", "'").replace("&quot;", '"').replace("&gt;", ">").replace("&lt;", "<").replace("&amp;", "&")
        assert r["html"] == brute_highlight(raw, ["tion", "the", "ion"])


def test_ranges_merge(spark):
    got = spark.sql("select array(named_struct('low',5,'high',8),named_struct('low',1,'high',3),named_struct('low',3,'high',4)) as r").select(text.merge_ranges(F.col("r")).alias("x")).first()["x"]
    assert [tuple(x) for x in got] == [(1, 4), (5, 8)]


def test_date_phrase():
    assert text.date_phrase("março", "2099") == "março de 2099" and text.date_phrase("", "2099") == "de 2099" and text.date_phrase("maio", "") == ""


def test_static_phrase_score(spark):
    docs = spark.createDataFrame([("x y", "body x y")], "title string, body string")
    got = search.search_static(docs, F.concat_ws("\n", "title", "body"), {"title": F.col("title"), "subject": F.lit(""), "citations": F.lit("")}, "x y", "phrase")
    assert got.first()["score"] == 30 + 8 + 2 + 2 * 2
    assert search.search_static(docs, F.col("body"), {}, "!?").first()["score"] == 1
    assert search.search_full_text(docs, "title", F.col("body"), "!?").count() == 0
    assert search.clamp(500, -5) == (100, 0) and search.clamp(0, 3) == (1, 3)


def test_changes(spark):
    feed = spark.createDataFrame([("a", "1"), ("a", "2"), ("n", "1"), ("o", "1")], "id string, modified string")
    out = state.classify_changes(feed, feed.where("id = 'a' and modified = '1'"), feed.where("id = 'a'"), F.col("id") != "o", F.lit(True))
    assert {(r["id"], r["modified"]): r["change"] for r in out.collect()} == {("a", "1"): "unchanged", ("a", "2"): "modified", ("n", "1"): "new", ("o", "1"): "out of scope"}
    prev = spark.createDataFrame([("b", "v"), ("c", "v"), ("a", "s"), ("d", "s")], "id string, side string")
    now = spark.createDataFrame([("a", "v"), ("b", "s")], "id string, side string")
    assert {tuple(r) for r in state.merge_checkpoint(now, prev).collect()} == {("a", "v"), ("c", "v"), ("b", "s"), ("d", "s")}
    assert one(spark, state.kept_count(F.col("n"), F.col("b")), n=0, b=7) == 7


def test_first_law_is_collapsed_and_ends_at_a_word(spark):
    from corpusmill.functions import extract

    texts = ["LEI  11111/19", "LEI 1/2A lei\n3/4", "XLEI 1/2", None, "Lei 5.6, LEI 7/8"]
    rows = spark.createDataFrame([*enumerate(texts)], "i int, t string").select("i", extract.first_law(F.col("t")).alias("l")).collect()
    assert {r["i"]: r["l"] for r in rows} == {0: "LEI 11111/19", 1: "LEI 3/4", 2: "", 3: "", 4: "LEI 5.6"}


def test_text_fields_of_doubled_blank_and_null_lines(spark, tmp_path):
    """The query keeps a line told twice, as its SQL does; the operator's default halves it, as `once` does."""
    import duckdb

    from corpusmill.plans import registry

    texts = ["A!! B A!! B\nx", "A B\nA B", " \nx", "\nx", "", None, " : a  b -\ny"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = registry.QUERIES["text_fields"](spark, str(tmp_path)).select("doc_id", "infracao", "dispositivo").collect()
    want = con.sql(f"SELECT doc_id, infracao, dispositivo FROM ({registry.ORACLE_SQL['text_fields']})").fetchall()
    assert sorted(map(tuple, got)) == sorted(want)
    assert got[0]["infracao"] == "A!! B A!! B"
    assert one(spark, extract.text_field(T, "infracao"), t="ATO OU FATO CONSTITUTIVO DA INFRACAO: A B A B") == "A B"
