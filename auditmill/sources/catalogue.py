"""Weakness catalogue (XML) as knowledge rows.

The file is cut at the end tag of a record, so tasks read it in parallel and each record
is a small document of its own. Its parts are cut out by regular expressions and entities
are resolved last, which keeps markup and escaped text apart. Spark's `xpath` functions set up
an XML parser for every call, so they serve only the rare texts that need one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditmill import params as P
from auditmill import schemas
from auditmill.functions.lookup import canonical_names, guess_severity
from auditmill.functions.text import join_parts, labelled, let, strip
from auditmill.sources.files import path_exists

RECORD_END = "</Weakness>"


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """One row (`record`) per weakness element, with its place in the document. A missing file is an error."""
    if not path_exists(path):
        raise FileNotFoundError(path)
    raw = spark.read.option("lineSep", RECORD_END).text(path)
    # Rows of one block stand in one task in the order of the file, so their ids rise.
    start = F.lpad(F.col("_metadata.file_block_start").cast("string"), 19, "0")
    placed = raw.select("value", F.concat_ws(":", "_metadata.file_path", start).alias("path"),
                        F.monotonically_increasing_id().alias("pos"))
    return cut_records(placed, F.col("value"), F.col("path"), F.col("pos"))


def cut_records(df: DataFrame, text: Column, path: Column, pos: Column) -> DataFrame:
    """The element in each text that the missing end tag would close; no row where none starts. `path` and `pos`
    give the order of the records."""
    found = F.regexp_extract_all(F.concat(text, F.lit(RECORD_END)), F.lit(r"(?s)<Weakness\s.*\z"), F.lit(0))
    return df.select(F.explode(found).alias("record"), path.alias("order_path"), pos.cast("bigint").alias("order_pos"))


def _decoded(c: Column) -> Column:
    """Text with its entities resolved. Numbered ones are rare and left to an XML parser."""

    def resolve(text: Column) -> Column:
        plain = text
        for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
            plain = F.replace(plain, F.lit(entity), F.lit(char))
        parsed = F.xpath_string(F.concat(F.lit("<a>"), text, F.lit("</a>")), F.lit("string(/a)"))
        return F.when(F.contains(text, F.lit("&#")), parsed).when(F.contains(text, F.lit("&")), plain).otherwise(text)

    return let(c, resolve)


def _without_cdata(xml: Column) -> Column:
    """Markup with its literal sections written as escaped text."""

    def escape(part: Column) -> Column:
        inner = F.regexp_replace(part, r"\A<!\[CDATA\[|\]\]>\z", "")
        for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            inner = F.replace(inner, F.lit(char), F.lit(entity))
        return F.when(F.startswith(part, F.lit("<![CDATA[")), inner).otherwise(part)

    parts = F.regexp_extract_all(xml, F.lit(r"(?s)<!\[CDATA\[.*?\]\]>|[^<]++|<"), F.lit(0))
    return F.when(F.contains(xml, F.lit("<![CDATA[")), F.array_join(F.transform(parts, escape), "")).otherwise(xml)


def _pieces(xml: Column) -> Column:
    return F.transform(F.split(_without_cdata(xml), r"(?=[<-])(?:<(?:!--|[^>]*+>)|-->)", -1), lambda p: strip(_decoded(p)))


def flat_text(xml: Column) -> Column:
    """Text pieces between the tags, each trimmed, the blank ones left out, joined by a space."""
    return F.array_join(F.filter(let(xml, _pieces), lambda p: p != ""), " ")


ATTRIBUTES = r"(?:\s+[\w:.-]+\s*=\s*(?:\"[^\"]*+\"|'[^']*+'))"


def _attribute(xml: Column, name: str) -> Column:
    """Attribute of the element the text starts with; empty if it has none of that name."""
    quoted = F.regexp_extract(xml, rf"\A<[\w:.-]+{ATTRIBUTES}*?\s+{name}\s*=\s*(\"[^\"]*+\"|'[^']*+')", 1)
    return _decoded(F.regexp_replace(quoted, r"(?s)\A.|.\z", ""))


def _child(xml: Column, name: str) -> Column:
    """Content of the first child of that name of the element the text starts with."""
    sibling = r"(?:<!--.*?-->|<([\w:.-]+)(?:\s[^>]*+)?(?:(?<=/)>|(?<!/)>.*?</\1>))\s*"
    return F.regexp_extract(
        xml, rf"(?s)\A<[\w:.-]+{ATTRIBUTES}*+\s*>[^<]*(?:{sibling})*?<{name}(?:\s[^>]*+)?(?<!/)>({_up_to_end(name)})</{name}>", 2)


def _up_to_end(tag: str) -> str:
    """What stands before the next end tag of a name, in long steps."""
    return rf"[^<]*+(?:<(?!/{tag}>)[^<]*+)*+"


def _elements(xml: Column, tag: str, attribute: str = "") -> Column:
    """All elements of a name as text; `attribute` is a regex its start tag must hold."""
    wanted = rf"(?=[^>]*{attribute})" if attribute else ""
    return F.regexp_extract_all(xml, F.lit(rf"<{tag}(?=[\s>]){wanted}[^>]*(?<!/)>{_up_to_end(tag)}</{tag}>"), F.lit(0))


def _cut_texts(elements: Column, limit: int) -> Column:
    texts = F.transform(elements, lambda e: F.left(flat_text(e), F.lit(limit)))
    return F.filter(texts, lambda t: t != "")


def parse_records(records: DataFrame, limits: P.TextLimits = P.TextLimits()) -> DataFrame:
    """Columns of each record: id, name, status, texts, languages and examples."""
    xml = F.col("record")
    bad_code = _elements(xml, "Example_Code", r"\sNature\s*=\s*[\"']bad[\"']")
    advice = F.flatten(F.transform(_elements(xml, "Mitigation"), lambda m: _elements(m, "Description")))
    names = F.regexp_extract_all(xml, F.lit(r"<Language(?=\s)[^>]*?\sName\s*=\s*[\"']([^\"']*)[\"']"), F.lit(1))
    return records.withColumn("number", _attribute(xml, "ID")).filter(F.col("number") != "").select(
        "number",
        F.concat(F.lit("CWE-"), "number").alias("cwe_id"),
        _attribute(xml, "Name").alias("name"),
        _attribute(xml, "Status").alias("status"),
        flat_text(_child(xml, "Description")).alias("description"),
        flat_text(_child(xml, "Extended_Description")).alias("details"),
        canonical_names(names, P.CATALOGUE_LANGUAGES, P.CATALOGUE_DEFAULT_LANGUAGES).alias("languages"),
        F.slice(_cut_texts(bad_code, limits.catalogue_example), 1, limits.catalogue_examples).alias("examples"),
        _cut_texts(advice, limits.catalogue_mitigation).alias("mitigations"),
        "order_path",
        "order_pos",
    )


def valid_ids(parsed: DataFrame) -> DataFrame:
    """Distinct ids, those of retired entries included."""
    return parsed.select("cwe_id").distinct()


def chunk_text(name: Column, description: Column, details: Column, mitigations: Column, limits: P.TextLimits = P.TextLimits()) -> Column:
    listed = F.array_join(F.slice(mitigations, 1, limits.catalogue_mitigations), " | ")
    parts = [
        F.concat(F.lit("Name: "), name),
        labelled("Description: ", description),
        labelled("Details: ", F.left(details, F.lit(limits.catalogue_details))),
        labelled("Mitigations: ", F.left(listed, F.lit(limits.catalogue_mitigation_text))),
    ]
    return F.left(join_parts(parts, "\n\n"), F.lit(limits.chunk_text))


def knowledge(parsed: DataFrame, limits: P.TextLimits = P.TextLimits()) -> DataFrame:
    """Knowledge rows of the entries in force. Their text is never blank: it starts with a label."""
    text = chunk_text(F.col("name"), F.col("description"), F.col("details"), F.col("mitigations"), limits)
    rows = parsed.filter(~F.col("status").isin(*P.CATALOGUE_RETIRED))
    return rows.withColumn("text", text).select(
        F.lit("cwe").alias("source"),
        "cwe_id",
        F.concat("cwe_id", F.lit(": "), "name").alias("title"),
        "text",
        "examples",
        "languages",
        F.create_map(
            F.lit("source"), F.lit("cwe"),
            F.lit("cwe_id"), F.col("cwe_id"),
            F.lit("severity_hint"), guess_severity(F.col("name"), F.col("description")),
        ).alias("metadata"),
        "order_path",
        "order_pos",
    ).to(schemas.KNOWLEDGE)
