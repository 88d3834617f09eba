"""Swiss-Prot flat file: entries read as records, filtered by organism before they are parsed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_NAME = r"^[a-zA-Z0-9_.\-]*$"


def entries(spark: SparkSession, path: str, tax_ids: list[str]) -> DataFrame:
    """(ord, id, tax_id, lines) of the entries of the given organisms."""
    raw = spark.read.option("lineSep", "\n//\n").text(path).withColumn("ord", F.monotonically_increasing_id())
    tax = F.regexp_extract("value", r"(?m)^OX   NCBI_TaxID=([^;\s]+)", 1)
    kept = raw.withColumn("tax_id", tax).filter(F.col("tax_id").isin(*tax_ids))
    return kept.select("ord", F.regexp_extract("value", r"(?m)^ID   (\S+)", 1).alias("id"), "tax_id", F.split("value", "\n").alias("lines")).filter("id <> ''")


def _lines(prefix: str) -> Column:
    return F.transform(F.filter("lines", lambda x: F.startswith(x, F.lit(prefix))), lambda x: F.substring(x, F.lit(6), F.length(x)))


def _refs(db: str, *cells: int) -> Column:
    rows = F.filter(_lines("DR   "), lambda x: F.startswith(x, F.lit(db + ";")))
    parts = F.transform(rows, lambda x: F.transform(F.split(x, ";"), lambda y: F.regexp_replace(F.trim(y), r"\.$", "")))
    return F.filter(F.flatten(F.transform(parts, lambda p: F.array(*(F.get(p, F.lit(c)) for c in cells)))), lambda x: x.isNotNull() & (x != "") & (x != "-"))


def _gene(key: str) -> Column:
    text = F.array_join(_lines("GN   "), " ")
    raw = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(rf"\b{key}=([^;]*);?"), 1), lambda x: F.split(x, ",")))
    names = F.transform(raw, lambda x: F.trim(F.regexp_replace(x, r"\{[^}]*\}", "")))
    return F.filter(names, lambda x: (x != "") & x.rlike(_NAME))


def _described(kind: str) -> Column:
    text = F.array_join(_lines("DE   "), "\n")
    return F.transform(F.regexp_extract_all(text, F.lit(kind), 1), lambda x: F.trim(F.regexp_replace(x, r"\{[^}]*\}", "")))


def proteins(spark: SparkSession, path: str, tax_ids: list[str]) -> DataFrame:
    """One row per entry; of full names the last one stands. A sub-protein's names are not told apart."""
    e = entries(spark, path, tax_ids)
    full = _described(r"RecName: Full=([^;]*);")
    alt = F.concat(_described(r"AltName: Full=([^;]*);"), _described(r"(?:^|\n)\s*Short=([^;]*);"))
    acc = F.filter(F.transform(F.split(F.array_join(_lines("AC   "), " "), ";"), lambda x: F.trim(x)), lambda x: x != "")
    embl = F.filter(F.transform(F.filter(_lines("DR   "), lambda x: F.startswith(x, F.lit("EMBL;"))), lambda x: F.transform(F.split(x, ";"), lambda y: F.regexp_replace(F.trim(y), r"\.$", ""))), lambda p: ~F.array_contains(p, "ChEMBL"))
    structs = F.transform(embl, lambda p: F.struct(F.get(p, F.lit(1)).alias("accession"), F.get(p, F.lit(2)).alias("id"), F.get(p, F.lit(3)).alias("status"), F.coalesce(F.get(p, F.lit(4)), F.lit("")).alias("type")))
    return e.select(
        "ord", "id", "tax_id", acc.alias("acnum"),
        F.struct(F.get(full, F.size(full) - 1).alias("full"), alt.alias("alt_names")).alias("names"),
        F.struct(_gene("Name").alias("names"), _gene("Synonyms").alias("alt_names"), _gene("OrderedLocusNames").alias("ordered_locus_names"), _gene("ORFNames").alias("orf_names")).alias("gene_refs"),
        _refs("Ensembl", 1, 2, 3).alias("ensembl"), _refs("KEGG", 1).alias("kegg"), F.transform(_refs("GO", 1), lambda x: F.regexp_replace(x, "^GO:", "")).alias("go"), _refs("Pfam", 1).alias("pfam"), _refs("SUPFAM", 1).alias("supfam"), _refs("PDB", 1).alias("pdb"), _refs("GeneID", 1).alias("gene_id"), structs.alias("embl"),
    )


def access_table(p: DataFrame) -> DataFrame:
    """(external_id, swissprot_id); of several proteins the last one in the file."""
    ids = F.flatten(F.array("kegg", "ensembl", F.transform("embl", lambda x: x["accession"]), F.transform("embl", lambda x: x["id"]), "acnum", F.col("gene_refs.names"), F.col("gene_refs.alt_names"), F.col("gene_refs.ordered_locus_names"), F.col("gene_refs.orf_names")))
    one = p.select("ord", F.col("id").alias("swissprot_id"), F.explode(ids).alias("external_id")).filter("external_id is not null and external_id <> ''")
    return one.groupBy("external_id").agg(F.max_by("swissprot_id", "ord").alias("swissprot_id"))


def xrefs(p: DataFrame) -> DataFrame:
    """(legacy_id, tag, tag_type, preferential): every identifier of a protein under which it can be looked up."""
    t = lambda kind, tags, pref=False: p.select(F.col("id").alias("legacy_id"), F.explode(tags).alias("tag"), F.lit(kind).alias("tag_type"), F.lit(pref).alias("preferential"))
    up = lambda c: F.transform(c, F.upper)
    out = t("UNIPROT_Accnum", "acnum").unionByName(t("UNIPROT_SwissProtId", F.array("id"), True)).unionByName(t("UNIPROT_GeneName", up("gene_refs.names"), True))
    for kind, c in (("UNIPROT_GeneOL", "gene_refs.ordered_locus_names"), ("UNIPROT_GeneORF", "gene_refs.orf_names"), ("UNIPROT_GeneAlt", "gene_refs.alt_names")):
        out = out.unionByName(t(kind, up(c)))
    for kind, c in (("UNIPROT_FullName", F.array("names.full")), ("UNIPROT_AltName", F.col("names.alt_names")), ("UNIPROT_Ensembl", F.col("ensembl")), ("UNIPROT_KEGG", F.col("kegg")), ("UNIPROT_PDB", F.col("pdb")), ("UNIPROT_GeneID", F.col("gene_id"))):
        out = out.unionByName(t(kind, c))
    e = p.select(F.col("id").alias("legacy_id"), F.explode("embl").alias("e"))
    ac = e.select("legacy_id", F.col("e.accession").alias("tag"), F.concat_ws("|", F.lit("UNIPROT_EMBL_AC"), "e.status", "e.type").alias("tag_type"), F.lit(False).alias("preferential"))
    idv = e.select("legacy_id", F.col("e.id").alias("tag"), F.concat(F.lit("UNIPROT_EMBL_ID||"), F.concat_ws("|", "e.status", "e.type")).alias("tag_type"), F.lit(False).alias("preferential"))
    return out.unionByName(ac).unionByName(idv).filter("tag is not null and tag not in ('', '-')")


__all__ = ["access_table", "entries", "proteins", "xrefs"]
