"""BioPAX level 3 (OWL/XML): one scan per element type with an explicit schema; references are ``#id`` attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_REF = "struct<`_rdf:resource`: string>"
_PARTICIPANT = ("Dna", "Rna", "SmallMolecule", "Protein", "PhysicalEntity", "Complex")
_REACTION = {"TemplateReaction": (), "Degradation": ("left", "right"), "BiochemicalReaction": ("left", "right")}


def scan(spark: SparkSession, path: str, element: str, **fields: str) -> DataFrame:
    """(id, fields) of an element type; ``fields``: child name to type (``text``, ``texts``, ``ref``, ``refs``)."""
    kind = {"text": "string", "texts": "array<string>", "ref": _REF, "refs": f"array<{_REF}>"}
    schema = ", ".join(["`_rdf:ID` string", *(f"`bp:{k}` {kind[v]}" for k, v in fields.items())])
    raw = spark.read.format("xml").option("rowTag", f"bp:{element}").schema(schema).load(path)
    cols = []
    for k, v in fields.items():
        c = F.col(f"`bp:{k}`")
        if v == "ref":
            c = _bare(c["_rdf:resource"])
        elif v == "refs":
            c = F.coalesce(F.transform(c, lambda x: _bare(x["_rdf:resource"])), F.array().cast("array<string>"))
        elif v == "texts":
            c = F.coalesce(c, F.array().cast("array<string>"))
        cols.append(c.alias(k))
    return raw.filter("`_rdf:ID` is not null").select(F.col("`_rdf:ID`").alias("id"), *cols)


def _bare(c: Column) -> Column:
    return F.regexp_replace(c, "^#", "")


def vocabularies(spark: SparkSession, path: str) -> DataFrame:
    """(id, kind, value) of sources, locations, modification terms and sequence sites."""
    one = lambda element, tag: scan(spark, path, element, **{tag: "text"}).select("id", F.lit(element).alias("kind"), F.col(tag).alias("value"))
    return one("BioSource", "name").unionByName(one("CellularLocationVocabulary", "term")).unionByName(one("SequenceModificationVocabulary", "term")).unionByName(one("SequenceSite", "sequencePosition"))


def references(spark: SparkSession, path: str) -> DataFrame:
    """(id, kind, names, tags map<db, array<accession>>): names of the form ``DB:acc`` are tags, the others names."""
    out = None
    for kind in ("DnaReference", "RnaReference", "SmallMoleculeReference", "ProteinReference"):
        df = scan(spark, path, kind, name="texts").withColumn("kind", F.lit(kind))
        out = df if out is None else out.unionByName(df)
    word = out.select("id", "kind", F.explode_outer("name").alias("n")).select("id", "kind", "n", F.regexp_extract("n", r"^(\w+):(\S+)", 1).alias("db"), F.regexp_extract("n", r"^(\w+):(\S+)", 2).alias("acc"))
    names = word.groupBy("id", "kind").agg(F.sort_array(F.collect_set(F.when(F.col("db") == "", F.col("n")))).alias("names"))
    per = word.filter("db <> ''").groupBy("id", "db").agg(F.sort_array(F.collect_set("acc")).alias("accs"))
    tags = per.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("db", "accs"))).alias("tags"))
    return names.join(tags, "id", "left")


def modifications(spark: SparkSession, path: str, words: DataFrame | None = None) -> DataFrame:
    """(id, location, modification), both looked up in ``words``, the file's vocabularies."""
    v = vocabularies(spark, path) if words is None else words
    m = scan(spark, path, "ModificationFeature", featureLocation="ref", modificationType="ref")
    a = v.filter("kind = 'SequenceSite'").select(F.col("id").alias("featureLocation"), F.col("value").alias("location"))
    b = v.filter("kind = 'SequenceModificationVocabulary'").select(F.col("id").alias("modificationType"), F.col("value").alias("modification"))
    return m.join(a, "featureLocation", "left").join(b, "modificationType", "left").select("id", "location", "modification")


def physical_entities(spark: SparkSession, path: str) -> DataFrame:
    """(id, kind, display_name, location_id, names, members, parts, features, reference, is_collection); members make a collection."""
    out = None
    for kind in _PARTICIPANT:
        df = scan(spark, path, kind, displayName="text", cellularLocation="ref", name="texts", memberPhysicalEntity="refs", component="refs", feature="refs", entityReference="ref").withColumn("kind", F.lit(kind))
        out = df if out is None else out.unionByName(df)
    return out.select("id", "kind", F.col("displayName").alias("display_name"), F.col("cellularLocation").alias("location_id"), F.col("name").alias("names"), F.col("memberPhysicalEntity").alias("members"), F.col("component").alias("parts"), F.col("feature").alias("features"), F.col("entityReference").alias("reference"), (F.size("memberPhysicalEntity") > 0).alias("is_collection"))


def reactions(spark: SparkSession, path: str) -> DataFrame:
    """(id, kind, display_name, left, right, ec_number); a template reaction keeps neither side."""
    out = None
    for kind, sides in _REACTION.items():
        df = scan(spark, path, kind, displayName="text", eCNumber="text", left="refs", right="refs")
        empty = F.array().cast("array<string>")
        df = df.select("id", F.lit(kind).alias("kind"), F.col("displayName").alias("display_name"), (F.col("left") if sides else empty).alias("left"), (F.col("right") if sides else empty).alias("right"), F.col("eCNumber").alias("ec_number"))
        out = df if out is None else out.unionByName(df)
    return out


def controls(spark: SparkSession, path: str, modulations: bool = False) -> DataFrame:
    """(id, kind, controller, controlled, control_type) without those that control a pathway."""
    out = None
    for kind in ("Catalysis", "Control", "TemplateReactionRegulation", *(("Modulation",) if modulations else ())):
        df = scan(spark, path, kind, controller="ref", controlled="ref", controlType="text").withColumn("kind", F.lit(kind))
        out = df if out is None else out.unionByName(df)
    return out.filter("controlled is null or not contains(controlled, 'Pathway')").select("id", "kind", "controller", "controlled", F.col("controlType").alias("control_type"))


def pathways(spark: SparkSession, path: str) -> DataFrame:
    return scan(spark, path, "Pathway", displayName="text", name="texts", pathwayComponent="refs", pathwayOrder="refs").select("id", F.col("displayName").alias("display_name"), F.col("name").alias("names"), F.col("pathwayComponent").alias("components"), F.col("pathwayOrder").alias("steps"))


def pathway_steps(spark: SparkSession, path: str) -> DataFrame:
    """(id, components, next_steps); controls and catalyses are no components."""
    s = scan(spark, path, "PathwayStep", stepProcess="refs", nextStep="refs")
    return s.select("id", F.filter("stepProcess", lambda x: ~x.rlike("Control|Catalysis")).alias("components"), F.col("nextStep").alias("next_steps"))
