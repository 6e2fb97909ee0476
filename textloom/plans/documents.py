"""Registered queries of document formats: files made of table rows, read, written with new texts and read again."""

from __future__ import annotations

import csv
import io
import json
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.plans.catalogue import query, read
from textloom.sources import formats, glossaries, tables


def zipped(parts: dict[str, str]) -> bytes:
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return raw.getvalue()


def xml(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;")


def names(*spaces: tuple[str, str]) -> str:
    return " ".join(f'xmlns:{p}="{uri[1:-1]}"' for p, uri in spaces)


def csv_of(rows: list[list[str]], sep: str) -> bytes:
    out = io.StringIO(newline="")
    csv.writer(out, delimiter=sep, lineterminator="\n").writerows(rows)
    return out.getvalue().encode()


def sheet(texts: list[str]) -> bytes:
    """A workbook: every second string shared, one merged cell, a formula, a number."""
    shared = texts[::2]
    cell = lambda i, t: f'<s:c r="A{i + 1}" t="s"><s:v>{i // 2}</s:v></s:c>' if i % 2 == 0 else f'<s:c r="A{i + 1}" t="inlineStr"><s:is><s:t>{xml(t)}</s:t></s:is></s:c>'
    rows = "".join(f'<s:row r="{i + 1}">{cell(i, t)}<s:c r="B{i + 1}"><s:v>{i}</s:v></s:c><s:c r="C{i + 1}" t="str"><s:f>A1</s:f><s:v>f</s:v></s:c></s:row>' for i, t in enumerate(texts))
    n = names(("s", formats.S))
    return zipped({
        "xl/workbook.xml": f'<s:workbook {n} {names(("r", formats.R))}><s:sheets><s:sheet name="One" r:id="r1"/></s:sheets></s:workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<s:sst {n}>" + "".join(f"<s:si><s:t>{xml(t)}</s:t></s:si>" for t in shared) + "</s:sst>",
        "xl/worksheets/sheet1.xml": f'<s:worksheet {n}><s:sheetData>{rows}</s:sheetData><s:mergeCells><s:mergeCell ref="A1:B1"/></s:mergeCells></s:worksheet>',
    })


#: By extension a file of a list of texts.
FILES = {
    "txt": lambda t: "\r\n".join(f"  {x}\r\n" for x in t).encode(),
    "csv": lambda t: csv_of([[x, "", x] for x in t], ","),
    "tsv": lambda t: csv_of([[x] for x in t] + [["\t"]], "\t"),
    "json": lambda t: json.dumps({"items": [{"text": x, "id": x, "n": 1} for x in t], "url": t}).encode(),
    "md": lambda t: ("---\ntitle: keep\n---\n" + "".join(f"- {x}\n```\n{x}\n```\n" for x in t)).encode(),
    "html": lambda t: ("<html><script>x</script><body>" + "".join(f"<p>{xml(x)}</p><pre>{xml(x)}</pre>" for x in t) + "</body></html>").encode(),
    "srt": lambda t: "".join(f"00:00:{i:02d},000 --> 00:00:{i + 1:02d}.500\n{x}\n\n" for i, x in enumerate(t)).encode(),
    "vtt": lambda t: ("WEBVTT\n\nNOTE x\n\n" + "".join(f"00:{i:02d}.000 --> 00:{i + 1:02d}.000\n<v Ann>{x}</v>\n\n" for i, x in enumerate(t))).encode(),
    "ass": lambda t: ("[Script Info]\nTitle: x\n[Events]\nFormat: Layer, Start, Text\n" + "".join(f"Dialogue: 0,0:00:{i:02d},{x}\n" for i, x in enumerate(t))).encode(),
    "lrc": lambda t: ("[ti:x]\n" + "".join(f"[00:{i:02d}.00][01:{i:02d}.00]{x}\n" for i, x in enumerate(t))).encode(),
    "docx": lambda t: zipped({"word/document.xml": f'<w:document {names(("w", formats.W))}><w:body>' + "".join(f"<w:p><w:r><w:t>{xml(x[:2])}</w:t></w:r><w:r><w:t>{xml(x[2:])}</w:t></w:r></w:p>" for x in t) + "</w:body></w:document>", "word/styles.xml": "<x/>"}),
    "pptx": lambda t: zipped({f"ppt/slides/slide{i + 1}.xml": f'<p:sld {names(("p", formats.P), ("a", formats.A))}><a:p><a:r><a:t>{xml(x)}</a:t></a:r></a:p></p:sld>' for i, x in enumerate(t)}),
    "xlsx": sheet,
    "odt": lambda t: zipped({"mimetype": "application/vnd.oasis.opendocument.text", "content.xml": f'<o:x {names(("o", formats.O))}>' + "".join(f"<o:p>{xml(x)}</o:p>" for x in t) + "</o:x>"}),
    "epub": lambda t: zipped({"mimetype": "application/epub+zip", **{f"c{i}.xhtml": f'<html xmlns="{formats.H[1:-1]}"><body><p>{xml(x)}</p></body></html>' for i, x in enumerate(t)}, "o.opf": "<package><manifest>" + "".join(f'<item id="i{i}" href="c{i}.xhtml"/>' for i in range(len(t))) + "</manifest><spine>" + "".join(f'<itemref idref="i{i}"/>' for i in range(len(t))) + "</spine></package>"}),
}


def turned(extension: str, texts: Column) -> Column:
    """The texts that a file of these texts has after it has been read, written with new ones and read again; its writer has
    to leave other bytes be, so a second writing of the old texts gives the first file's texts again."""
    made, reader, writer = FILES[extension], formats.READERS[extension], formats.WRITERS[extension]

    @F.pandas_udf("array<string>")
    def run(values: pd.Series) -> pd.Series:
        def of(t) -> list[str]:
            raw = made([x for x in t])
            slots = reader(raw)
            done = writer(raw, {place: "[T]" + text for _, place, text in slots})
            new = reader(done)
            again = reader(writer(done, {place: text for (_, place, _), (_, _, text) in zip(new, slots, strict=True)}))
            if [x[2] for x in again] != [x[2] for x in slots]:
                return ["not undone", *[x[2] for x in again]]
            return [text for _, _, text in new]

        return values.map(of)

    return run(texts)


def customers(spark, sf) -> DataFrame:
    """(id, texts): the names of a nation's customers as sentences, in order."""
    c = read(spark, sf, "customer").select("c_nationkey", F.struct("c_custkey", F.concat_ws(" ", F.lit("Dear"), "c_name", F.lit("of"), "c_mktsegment", F.lit("& sons")).alias("t")).alias("s"))
    return c.groupBy(F.col("c_nationkey").alias("id")).agg(F.slice(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["t"]), 1, 40).alias("texts"))


def _roundtrip(extension: str, copies: int = 1) -> None:
    sql = f"""WITH c AS (SELECT c_nationkey AS id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS k, 'Dear ' || c_name || ' of ' || c_mktsegment || ' & sons' AS t FROM customer)
SELECT id, CAST(k * {copies} + j AS INTEGER) AS n, '[T]' || t AS value FROM c, (SELECT unnest(range({copies})) AS j) WHERE k < 40"""

    def run(spark, sf):
        got = customers(spark, sf).select("id", F.posexplode(turned(extension, F.col("texts"))).alias("n", "value"))
        return got

    run.__name__ = f"{extension}_roundtrip"
    run.__doc__ = f"Files of the format {extension} made of customers' names, forty of a nation at most."
    query(sql)(run)


for _ext in FILES:
    _roundtrip(_ext, 2 if _ext == "csv" else 1)


@query("SELECT p_partkey AS row_id, c AS col, v AS value FROM (SELECT p_partkey, unnest([0, 1, 2]) AS c, unnest([CASE WHEN p_partkey % 5 = 0 THEN ' =' ELSE '' END || p_name, p_brand || ',\"' || p_type || '\"', p_name || '␊' || p_type]) AS v FROM part)")
def csv_files(spark, sf):
    """Parts written as CSV with delimiters, quotes, line ends and formulas in cells, read again in parallel."""
    from textloom.storage import scratch

    p = read(spark, sf, "part")
    first = F.concat(F.when(F.col("p_partkey") % 5 == 0, "=").otherwise(""), "p_name")
    cells = F.array(first, F.concat("p_brand", F.lit(',"'), "p_type", F.lit('"')), F.concat("p_name", F.lit("␊"), "p_type"))
    path = scratch(spark, "parts")
    tables.write(p.select(F.col("p_partkey").alias("row"), F.posexplode(F.concat(cells, F.array(F.col("p_partkey").cast("string")))).alias("col", "value")), path, 4)
    got = tables.cells(spark, path)
    ids = got.where("col = 3").select("path", "row", F.col("value").cast("long").alias("row_id"))
    return got.where("col < 3").join(ids, ["path", "row"]).select("row_id", "col", "value")


@query("SELECT src, max(dst) AS dst FROM (SELECT 'term ' || item_id AS src, upper('term ' || item_id) AS dst FROM benchmark WHERE item_id % 3 <> 0) GROUP BY src")
def glossary_files(spark, sf):
    """A glossary written as a file headed by names of languages, blank terms among them, and read by their codes."""
    from textloom.storage import scratch

    rows = read(spark, sf, "benchmark").select("item_id").orderBy("item_id").collect()  # a user's list of terms
    folder = scratch(spark, "glossaries")
    glossaries.write(spark, folder, "Mine", ["Deutsch", "English"], [[f"TERM {r.item_id}" if r.item_id % 3 else " ", f"term {r.item_id}"] for r in rows], new=True)
    return glossaries.scan(spark, folder, "en", "de").select("src", "dst")


@query("SELECT doc_id, length(text) - length(replace(text, 'a', '')) AS cues, CAST(doc_id % 3 AS BIGINT) AS lost FROM documents")
def srt_losses(spark, sf):
    """Subtitle files with as many cues as a text has a's, and up to two stamps that can't be read."""
    from textloom.functions.tokens import arrow

    def of(n: int, lost: int) -> list[int]:
        raw = "".join(f"00:00:01,000 --> 00:00:02,000\ncue {i}\n\n" for i in range(n)) + "broken --> stamp\nx\n\n" * lost
        return [len(formats.read_srt(raw.encode())), formats.srt_loss(raw.encode())]

    d = read(spark, sf, "documents")
    n = (F.length("text") - F.length(F.translate("text", "a", ""))).cast("int")
    got = d.select("doc_id", arrow(of, "array<long>")(n, (F.col("doc_id") % 3).cast("int")).alias("r"))
    return got.select("doc_id", F.col("r")[0].alias("cues"), F.col("r")[1].alias("lost"))


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'utf-8' WHEN 1 THEN 'utf-8-sig' WHEN 2 THEN 'utf-16' WHEN 3 THEN 'gb18030' ELSE 'utf-8' END AS encoding, CASE doc_id % 3 WHEN 0 THEN 'lf' WHEN 1 THEN 'crlf' ELSE 'cr' END AS newline, true AS same FROM documents")
def decoded_files(spark, sf):
    """Texts in five encodings and three kinds of line ends."""
    from textloom.functions.tokens import arrow

    def of(i: int) -> list[str]:
        nl = ("\n", "\r\n", "\r")[i % 3]
        text = f"中文 number {i}{nl}second line"
        name = ("utf-8", "utf-8-sig", "utf-16", "gb18030", "utf-8")[i % 5]
        got, found = formats.decode(text.encode(name))
        return [found, {"\n": "lf", "\r\n": "crlf", "\r": "cr"}[formats.newline_of(got)], str(got.lstrip("﻿") == text).lower()]

    got = read(spark, sf, "documents").select("doc_id", arrow(of, "array<string>")(F.col("doc_id")).alias("r"))
    return got.select("doc_id", F.col("r")[0].alias("encoding"), F.col("r")[1].alias("newline"), (F.col("r")[2] == "true").alias("same"))
