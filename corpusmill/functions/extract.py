"""Codes, subjects, blocks and labelled fields out of raw text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fold import bound, norm, norm_label

# Patterns of the documents' own vocabulary.
CODE = r"\b(\d{8,14})([A-Z]{2})\b"
PROTOCOL = r"31\.\d{6,10}(?:[_\-/]?\d{4})-\d{2}"
LAW = r"(?iu)LEI\s+\d+[./]\d+"
WHOLE_LAW = r"(?iuU)\bLEI\s+\d+[./]\d+\b"
SUBJECT = r"(?isu)Assunto\s*[:\-]\s*(.+?)(?=\n[ \t]*\n|\n[ \t]*(?:CPF|CNPJ|LOCAL|Relat[oó]rio|Data\b|Ref\.\s|Senhor|RELAT)|\z)"
DECISION = r"(?iu)DISPOSITIVO DA DECIS[AÃ]O"
ACT_HEAD = r"(?iu)ATO\s+OU\s+FATO\s+CONSTITUTIVO\s+DA\s+INFRA\w*[^\n]*\n"
ACT_STOPS = (r"DESCRI[ÇC][ÃA]O\s+COMPLEMENTAR", r"DISPOSITIVO\s+LEGAL", r"MEDIDA\s+AFERIDA", "ENQUADRAMENTO")
# Labels of table cells, folded as by norm_label.
CELL_LABELS = {
    "autuado": "nome razao social ou pessoa fisica",
    "infracao": "ato ou fato constitutivo da infracao",
    "dispositivo_legal_transgredido": "dispositivo legal transgredido",
    "local_constatacao": "local da constatacao da infracao endereco completo",
}
DISTRICT = "bairro"
# Labels in running text, and those that end what follows them.
TEXT_LABELS = {
    "autuado": (r"NOME\s*\(RAZ[ÃA]O\s+SOCIAL\s+OU\s+PESSOA\s+F[ÍI]SICA\)", ("NOME FANTASIA", "CNPJ/CPF", "CPF/CNPJ", "DML", "ATIVIDADE EXERCIDA")),
    "infracao": (r"ATO\s+OU\s+FATO\s+CONSTITUTIVO\s+DA\s+INFRA[ÇC][ÃA]O", ("DESCRI[ÇC][ÃA]O COMPLEMENTAR", "DISPOSITIVO LEGAL TRANSGREDIDO")),
    "dispositivo_legal_transgredido": (r"DISPOSITIVO\s+LEGAL\s+TRANSGREDIDO", ("DATA DE VISTORIA", "DADOS DO VE[ÍI]CULO", "PELO PRESENTE", "PRAZO PARA CUMPRIMENTO", "LOCAL DA CONSTATA[ÇC][ÃA]O")),
    "local_constatacao": (r"LOCAL\s+DA\s+CONSTATA[ÇC][ÃA]O\s+DA\s+INFRA[ÇC][ÃA]O\s*\(ENDERE[ÇC]O\s+COMPLETO\)", ("PENALIDADE", "VALOR BASE", "DETALHAMENTO DA MULTA", "NA REINCID[ÊE]NCIA")),
}


def _squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "(?U)\\s+", " "))


def codes(text: Column) -> Column:
    """Distinct codes in the order they first appear."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(CODE), F.lit(0)))


def protocol(name: Column, text: Column) -> Column:
    """The first case number in the name, else in the text, else empty."""
    return F.coalesce(F.nullif(F.regexp_extract(name, PROTOCOL, 0), F.lit("")), F.regexp_extract(text, PROTOCOL, 0), F.lit(""))


def subject(text: Column) -> Column:
    return _squeeze(F.regexp_extract(text, SUBJECT, 1))


def block(text: Column, head: str, stops: tuple[str, ...]) -> Column:
    """What follows a head line, up to a line that starts with a stop label or the end; lone numbers go."""
    pattern = f"(?su){head}(.*?)(?=\\n[ \\t]*(?:{'|'.join(stops)})|\\z)"
    return _squeeze(F.regexp_replace(F.regexp_extract(text, pattern, 1), "(?m)^[ \\t]*\\d[\\d.,]*[ \\t]*$", " "))


def law_near(text: Column, label: str, width: int = 400) -> Column:
    """The first law within width characters after a label, upper case and collapsed."""
    at = F.locate(label, text)
    window = F.when(at > 0, F.substring(text, at, F.lit(width))).otherwise(F.lit(""))
    return _squeeze(F.upper(F.regexp_extract(window, LAW, 0)))


def first_law(text: Column) -> Column:
    """The first law that ends at a word's end, upper case and collapsed; null text: empty."""
    return _squeeze(F.upper(F.regexp_extract(F.coalesce(text, F.lit("")), WHOLE_LAW, 0)))


def clean(value: Column) -> Column:
    """Collapsed, without ` :-` at the ends."""
    return F.btrim(_squeeze(value), F.lit(" :-"))


def once(value: Column) -> Column:
    """Clean, and `A B A B` as `A B`."""
    whole = clean(value)
    words = F.split(whole, " ")
    half = (F.size(words) / 2).cast("int")
    doubled = (F.size(words) % 2 == 0) & (half > 0) & (F.slice(words, F.lit(1), half) == F.slice(words, half + 1, half))
    return F.when(doubled, F.array_join(F.slice(words, F.lit(1), half), " ")).otherwise(whole)


def cell_value(cell: Column, label: str) -> Column:
    """Of a cell whose first line holds the label: the other lines, or what follows its colon; else null."""
    lines = F.split(F.trim(cell), "\n")
    first = F.get(lines, F.lit(0))
    rest = once(F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), " "))
    after = F.when(first.contains(":"), once(F.substring_index(first, ":", -1))).otherwise(F.lit(""))
    return F.when(F.contains(norm_label(first), F.lit(label)), F.when(rest != "", rest).otherwise(after))


def text_field(text: Column, field: str, halved: bool = True) -> Column:
    """What follows a field's label, up to a line that starts with a stop label and a colon, or with `nn -`, or the end.

    halved: a value that is told twice counts once.
    """
    label, stops = TEXT_LABELS[field]
    pattern = rf"(?isu){label}\s*:?\s*(.+?)(?=\n\s*(?:{'|'.join(stops)})\s*:|\n\s*\d{{2}}\s+-|\z)"
    value = F.regexp_extract(text, pattern, 1)
    return once(value) if halved else clean(value)


def table_fields(cells: DataFrame, doc: str = "doc") -> DataFrame:
    """doc and a column for each field, of cells (doc, page, tbl, row, col, value).

    A field is the first non-empty value over pages, tables, rows and cells. The place comes with the district of its row:
    the row's last place, and its first district from the first place on, unless that is part of it already.
    """
    found = cells.select(doc, "page", "tbl", "row", "col", *[F.nullif(cell_value(F.col("value"), label), F.lit("")).alias(f) for f, label in [*CELL_LABELS.items(), ("_district", DISTRICT)]])
    order = F.struct("page", "tbl", "row", "col")
    plain = [f for f in CELL_LABELS if f != "local_constatacao"]
    first = found.groupBy(doc).agg(*[F.min_by(f, F.when(F.col(f).isNotNull(), order)).alias(f) for f in plain])
    place = F.col("local_constatacao").isNotNull()
    rows = found.groupBy(doc, "page", "tbl", "row").agg(
        F.max_by("local_constatacao", F.when(place, F.col("col"))).alias("place"),
        F.min(F.when(place, F.col("col"))).alias("start"),
        F.array_sort(F.collect_list(F.when(F.col("_district").isNotNull(), F.struct("col", "_district")))).alias("districts"),  # of one row
    )
    district = F.get(F.filter("districts", lambda d: d["col"] >= F.col("start")), F.lit(0))["_district"]
    whole = F.when(district.isNotNull() & ~F.contains("place", district), F.concat_ws(" - ", "place", district)).otherwise(F.col("place"))
    places = rows.where("place is not null").groupBy(doc).agg(F.min_by(whole, F.struct("page", "tbl", "row")).alias("local_constatacao"))
    return first.join(places, doc, "left").select(doc, *[F.coalesce(f, F.lit("")).alias(f) for f in CELL_LABELS])


def pdf_part(content: Column) -> Column:
    """The bytes of an answer from `%PDF` on; null if it holds none, which means that there is no such citation."""
    at = F.instr(F.decode(content, "ISO-8859-1"), "%PDF")  # one character for each byte
    return F.when(at > 0, F.substring(content, at, F.length(content)))


def rejection(name: Column, text: Column) -> Column:
    """Why a document is no decision, or null: ordered rules, the first that fits."""
    stem = F.regexp_replace(F.regexp_replace(norm(F.regexp_extract(name, "([^/]*)$", 1)), "^[^0-9a-z]+", ""), "^copia\\s+de\\s+", "")
    folded = F.struct(stem.alias("stem"), norm(F.left(text, F.lit(20_000))).alias("head"))
    session = bound(folded, lambda x: _session(x["stem"], x["head"]))
    return F.when(text.isNull(), F.lit("texto nao extraido")).otherwise(F.coalesce(session, F.when(~text.rlike(DECISION), F.lit("sem dispositivo da decisao"))))


def _session(stem: Column, head: Column) -> Column:
    """Why a document is of a session and no decision, or null; an empty head has no reason here."""
    session = head.contains("junta integrada de julgamento fiscal") & head.contains("sessao") & _any(head, ("membros presentes", "foi aberta a sessao", "presidente", "secretaria"))
    strong = stem.rlike("^ata(?:\\b|\\s|\\d)") | stem.rlike("^controle\\s+de\\s+votacao\\b") | stem.rlike("^sessao\\s*\\d")
    return (
        F.when(head.contains("controle de votacao"), F.lit("controle de votacao"))
        .when(head.rlike("\\bata\\s+da\\b.{0,180}\\bsessao\\b") | head.contains("ata da sessao"), F.lit("ata de sessao"))
        .when(head.contains("defesas julgadas") & session, F.lit("ata com defesas julgadas"))
        .when(strong & session, F.lit("nome de sessao confirmado pelo conteudo"))
    )


def _any(text: Column, words: tuple[str, ...]) -> Column:
    out = text.contains(words[0])
    for word in words[1:]:
        out = out | text.contains(word)
    return out
