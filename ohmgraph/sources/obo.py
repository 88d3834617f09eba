"""Gene ontology in OBO format: stanzas read as records, rules as column expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stanzas(spark: SparkSession, path: str) -> DataFrame:
    """(lines) of each term stanza. A stanza ends at a blank line; a last one without is not complete and is left out."""
    raw = spark.read.option("lineSep", "\n\n").text(path)
    whole = raw.select(F.regexp_replace("value", r"^\n+", "").alias("value")).filter(F.startswith("value", F.lit("[Term]")))
    # a record that the file's end cuts short is the only one that can end in a single newline or none at all
    return whole.select(F.split("value", "\n").alias("lines"))


def _first(prefix: str) -> F.Column:
    hit = F.filter("lines", lambda x: F.startswith(x, F.lit(prefix + ": ")))
    return F.get(F.split(F.get(hit, F.lit(0)), ": "), F.lit(1))


def terms(spark: SparkSession, path: str) -> DataFrame:
    """(id, name, namespace, def, chebi) of terms that are not obsolete; values end at a second ``': '``, ids lose ``GO:``."""
    s = stanzas(spark, path)
    live = s.filter(~F.exists("lines", lambda x: F.startswith(x, F.lit("is_obsolete: true"))))
    chebi = F.filter(F.transform("lines", lambda x: F.regexp_extract(x, r"CHEBI:(\d+)", 1)), lambda x: x != "")
    bare = F.get(F.split(F.get(F.filter("lines", lambda x: F.startswith(x, F.lit("id: "))), F.lit(0)), "GO:"), F.lit(1))
    got = live.select(F.trim(bare).alias("id"), _first("name").alias("name"), _first("namespace").alias("namespace"), _first("def").alias("def"), F.get(chebi, F.lit(-1) + F.size(chebi)).alias("chebi"), "lines")
    return got.filter("id is not null").select("id", "name", "namespace", "def", "chebi", "lines")


def relations(terms_: DataFrame) -> DataFrame:
    """(child, relation, parent) of ``is_a`` and ``relationship`` lines."""
    line = terms_.select(F.col("id").alias("child"), F.explode("lines").alias("x"))
    is_a = line.filter(F.startswith("x", F.lit("is_a: "))).select("child", F.lit("is_a").alias("relation"), F.regexp_extract("x", r"GO:(\d+)", 1).alias("parent"))
    rel = line.filter(F.startswith("x", F.lit("relationship: "))).select("child", F.regexp_extract("x", r"^relationship: (\S+)", 1).alias("relation"), F.regexp_extract("x", r"GO:(\d+)", 1).alias("parent"))
    return is_a.unionByName(rel).filter("parent <> ''")


EDGE_OF = {"is_a": ["is_a_go"], "part_of": ["is_part_of_go"], "regulates": ["is_regulant:UNKNOWN"], "positively_regulates": ["is_regulant:ACTIVATES", "is_regulant:UNKNOWN"], "negatively_regulates": ["is_regulant:INHIBITS"]}


def edges(triples: DataFrame) -> DataFrame:
    """(child, parent, edge_type, control); a positive regulation gives two edges."""
    m = F.create_map(*(x for k, v in EDGE_OF.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    got = triples.select("child", "parent", F.explode(m[F.col("relation")]).alias("e"))
    return got.select("child", "parent", F.substring_index("e", ":", 1).alias("edge_type"), F.get(F.split("e", ":"), F.lit(1)).alias("control"))
