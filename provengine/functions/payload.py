"""Checks of payload bytes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Marks of HTML pages, of access challenges, and plausible media types.
HTML_MARKS = ("<!doctype html", "<html", "<head", "<body")
CHALLENGE_MARKS = ("cloudpmc-viewer-pow", "pow_challenge", "window.ncbi.pmc.pow")
PDF_TYPES = ("application/pdf", "application/x-pdf", "application/octet-stream")
XML_TYPES = ("text/plain", "application/octet-stream")


def _head(content: Column, n: int) -> Column:
    return F.lower(F.decode(F.substring(content, 1, n), "ISO-8859-1"))


def looks_like_html(content: Column) -> Column:
    """The first 512 bytes, without white space and byte-order mark, begin as an HTML page."""
    head = F.regexp_replace(_head(content, 512), "^[\\s\\x0b\\x{ef}\\x{bb}\\x{bf}]+", "")
    return head.rlike("^(?:" + "|".join(HTML_MARKS) + ")")


def looks_like_challenge(content: Column) -> Column:
    head, out = _head(content, 16 * 1024), F.lit(False)
    for mark in CHALLENGE_MARKS:
        out = out | head.contains(mark)
    return out


def classify_payload(kind: Column, content: Column, min_size: int) -> Column:
    """The first thing wrong with a payload, or OK; what it is comes before how large it is."""
    size = F.octet_length(content)
    head = F.decode(F.substring(content, 1, 2048), "ISO-8859-1")
    tail = F.decode(F.substring(content, F.greatest(size - 4095, F.lit(1)), F.lit(4096)), "ISO-8859-1")
    html = looks_like_html(content)
    pdf = (
        F.when(~head.startswith("%PDF-") & html & looks_like_challenge(content), "BOT_CHALLENGE").when(~head.startswith("%PDF-") & html, "HTML_PAGE").when(~head.startswith("%PDF-"), "BAD_MAGIC")
        .when(size < min_size, "TOO_SMALL").when(~tail.contains("%%EOF"), "TRUNCATED").otherwise("OK")
    )
    xml = F.when(html, "HTML_PAGE").when(~head.rlike("^\\s*<"), "NO_MARKUP").when(size < min_size, "TOO_SMALL").otherwise("OK")
    return F.when(content.isNull() | (size == 0), "EMPTY").when(kind == "pdf", pdf).otherwise(xml)


def content_type_ok(kind: Column, content_type: Column) -> Column:
    value = F.lower(F.trim(F.substring_index(content_type, ";", 1)))
    xml = value.endswith("/xml") | value.endswith("+xml") | value.isin(*XML_TYPES)
    return F.when(F.coalesce(content_type, F.lit("")) == "", True).when(kind == "pdf", value.isin(*PDF_TYPES)).when(kind == "xml", xml).otherwise(True)


def content_digest(content: Column) -> Column:
    return F.struct(F.sha2(content, 256).alias("sha256"), F.octet_length(content).cast("long").alias("size_bytes"))


# What may stand before the root element, and a document type that declares entities.
_MISC = "(?:\\s++|<!--.*?-->|<\\?.*?\\?>)*+"
_PROLOG = f"(?s)^\ufeff?{_MISC}(?:<!DOCTYPE[^>\\[]*+(?:\\[[^\\]]*+\\]\\s*+)?>)?"
_ENTITIES = f"(?s)^\ufeff?{_MISC}<!DOCTYPE[^>\\[]*+\\[[^\\]]*?<!ENTITY"


def _xml_text(content: Column) -> Column:
    """Bytes as text, by byte order mark or declaration: UTF-8, UTF-16, Latin-1 and ASCII; NULL if they aren't that."""
    said = F.lower(F.regexp_extract(F.decode(F.substring(content, 1, 200), "ISO-8859-1"), "^<\\?xml[^>]*?encoding\\s*=\\s*[\"']([A-Za-z0-9._-]+)", 1))
    marked = F.hex(F.substring(content, 1, 2)).isin("FEFF", "FFFE")
    return F.when(marked, F.decode(content, "UTF-16")).when(said.isin("iso-8859-1", "latin1", "us-ascii"), F.decode(content, "ISO-8859-1")).otherwise(F.try_validate_utf8(content.cast("string")))


def xml_wellformed(df: DataFrame, key: str, content: str) -> DataFrame:
    """key, well_formed, root, problem: a full parse by Spark's XML functions; declared entities are refused.

    The parser stops after the root element and says nothing of what follows. So what stands after the prolog is also put into an
    element that no text can close (named by the text's digest), which must parse and hold one element and no text."""
    parsed = lambda text: F.from_xml(text, "broken string", {"columnNameOfCorruptRecord": "broken"})["broken"].isNull()
    name = F.concat(F.lit("w"), F.md5("text"))
    inside = F.concat(F.lit("<"), name, F.lit(">"), F.regexp_replace("text", _PROLOG, ""), F.lit("</"), name, F.lit(">"))
    rows = df.select(key, _xml_text(F.col(content).cast("binary")).alias("text"))
    rows = rows.select(key, F.regexp_replace("text", "^\ufeff", "").alias("text"), F.col("text").rlike(_ENTITIES).alias("unsafe")).withColumn("inside", inside)
    fine = F.col("text").isNotNull() & ~F.col("unsafe") & (F.trim("text") != "") & parsed(F.col("text")) & parsed(F.col("inside"))
    rows = rows.withColumn("tree", F.when(fine, F.from_xml("inside", "variant", {"valueTag": "#text"})))
    names = F.map_keys(F.try_variant_get("tree", "$", "map<string, variant>"))
    kinds = F.transform(F.map_values(F.try_variant_get("tree", "$", "map<string, variant>")), F.schema_of_variant)
    one = (F.size(names) == 1) & (F.get(names, F.lit(0)) != "#text") & ~F.get(kinds, F.lit(0)).startswith("ARRAY")
    good = F.coalesce(one, F.lit(False))
    problem = F.when(F.col("unsafe"), "unsafe entity").when(~good, "not well-formed")
    return rows.select(key, good.alias("well_formed"), F.when(good, F.get(names, F.lit(0))).alias("root"), problem.alias("problem"))
