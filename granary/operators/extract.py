"""Triples, schema entries and entities out of knowledge texts (source_id, content)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import chunk_sentences, strip, words

# The accepted notations.
PAREN = r"\(([^,|]+?)\s*,\s*([^,|]+?)\s*,\s*([^,|]+?)\s*\)"
SCHEMA = r"^([\p{L}\p{N}_]+)\s*:\s*([\p{L}\p{N}_]+)\s*->\s*(.+)"
ENTITY = r"^([^{\[]+)\s*(?:\[([\p{L}\p{N}_]+)\])?\s*(?:\{([^}]*)\})?"
INPUT_TYPES = ("triple", "schema", "text", "entity")


def detect_input_type(df: DataFrame) -> DataFrame:
    """``df`` with the detected ``input_type`` of its content; the first rule that holds decides."""
    s = F.col("stripped")
    n_words = F.size(words(s))
    kind = (
        F.when(s.contains("(") & s.contains(",") & s.contains(")"), "triple")
        .when(F.length(s) - F.length(F.replace(s, F.lit("|"), F.lit(""))) >= 2, "triple")
        .when(s.contains("->") | (s.contains(":") & (s.contains("Entity") | s.contains("Class") | s.contains("Type"))), "schema")
        .when(s.contains("[") & s.contains("]"), "entity")
        .when(s.contains("{") & s.contains("}") & s.contains(":"), "entity")
        .when((n_words > 5) & (F.length(s) > 20), "text")
        .when(F.length(s) > 50, "text")
        .when(n_words > 2, "text")
        .otherwise("entity")
    )
    return df.withColumn("stripped", strip(F.coalesce("content", F.lit("")))).withColumn("input_type", kind).drop("stripped")


def _paren_triples() -> Column:
    groups = [F.regexp_extract_all("content", F.lit(PAREN), F.lit(g)) for g in (1, 2, 3)]
    return F.transform(
        F.arrays_zip(*(g.alias(n) for g, n in zip(groups, "spo", strict=True))),
        lambda t: F.struct(strip(t["s"]).alias("subject"), strip(t["p"]).alias("predicate"), strip(t["o"]).alias("object")),
    )


def _at(cells: str, i: Column) -> Column:
    return F.struct(*(strip(F.get(cells, i + k)).alias(n) for k, n in enumerate(("subject", "predicate", "object"))))


def _bar_triples() -> Column:
    """Runs of three non-empty cells between bars, from the left without overlaps."""
    filled = F.transform("cells", lambda c: F.length(c) > 0)
    starts = F.aggregate(
        F.when(F.size("cells") >= 3, F.sequence(F.lit(0), F.size("cells") - 3)).otherwise(F.array().cast("array<int>")),
        F.expr("struct(0 as free, cast(array() as array<int>) as starts)"),
        lambda a, i: F.when(
            (i >= a["free"]) & F.get("filled", i) & F.get("filled", i + 1) & F.get("filled", i + 2),
            F.struct((i + 3).alias("free"), F.concat(a["starts"], F.array(i)).alias("starts")),
        ).otherwise(a),
        lambda a: a["starts"],
    )
    return F.transform(starts, lambda i: _at("cells", i)), filled


def extract_triples(df: DataFrame) -> DataFrame:
    """(source_id, pos, subject, predicate, object): parenthesised, then bar-separated triples; groups of
    three comma parts only where neither matches. Repeats within a source keep their first place."""
    parts = F.filter(F.transform(F.split("content", ",", -1), strip), lambda p: p != "")
    commas = F.length("content") - F.length(F.replace("content", F.lit(","), F.lit("")))
    starts = F.when(F.size("parts") >= 3, F.sequence(F.lit(0), F.size("parts") - 3, F.lit(3))).otherwise(F.array().cast("array<int>"))
    by_comma = F.transform(starts, lambda i: _at("parts", i))
    barred, filled = _bar_triples()
    return (
        df.select("source_id", F.coalesce("content", F.lit("")).alias("content")).withColumn("parts", parts)
        .withColumn("cells", F.split("content", r"\|", -1)).withColumn("filled", filled).withColumn("found", F.concat(_paren_triples(), barred))
        .withColumn("t", F.when((F.size("found") == 0) & (commas >= 2) & ~F.col("content").contains("|"), by_comma).otherwise(F.col("found")))
        .select("source_id", F.posexplode(F.array_distinct("t")).alias("pos", "t"))
        .select("source_id", "pos", "t.subject", "t.predicate", "t.object")
    )


def canonical_triple(c: Column) -> Column:
    """Triple text with `` | `` between its parts and no outer parentheses."""
    bare = F.regexp_replace(strip(F.coalesce(c, F.lit(""))), r"^\((.*)\)$", "$1")
    return strip(F.regexp_replace(bare, r"\s*[,|]\s*", " | "))


def dedup_triple_text(df: DataFrame) -> DataFrame:
    """One row per canonical triple text: smallest source_id, triple, copies."""
    return df.groupBy(canonical_triple(F.col("content")).alias("triple")).agg(F.min("source_id").alias("source_id"), F.count("*").alias("copies"))


def triple_profile(triples: DataFrame) -> DataFrame:
    """Per source: triple count and sorted distinct subjects, predicates and objects."""
    return triples.groupBy("source_id").agg(
        F.count("*").alias("n_triples"), *(F.array_sort(F.collect_set(c)).alias(f"{c}s") for c in ("subject", "predicate", "object"))
    )


def _lines(df: DataFrame) -> DataFrame:
    lines = F.filter(F.transform(F.split(F.coalesce("content", F.lit("")), r"[\n;]+", -1), strip), lambda x: x != "")
    return df.select("source_id", F.posexplode(lines).alias("pos", "line"))


def extract_schema(df: DataFrame) -> DataFrame:
    """(source_id, pos, entity_type, property, value) from ``Type:property -> value`` lines."""
    return _lines(df).where(F.col("line").rlike(SCHEMA)).select(
        "source_id", "pos", *(strip(F.regexp_extract("line", SCHEMA, g)).alias(n) for g, n in ((1, "entity_type"), (2, "property"), (3, "value")))
    )


def schema_profile(entries: DataFrame) -> DataFrame:
    """Per source: entry count, sorted entity types and a map of each type's sorted properties."""
    by_type = entries.groupBy("source_id", "entity_type").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("property")).alias("properties"))
    return by_type.groupBy("source_id").agg(
        F.sum("n").alias("n_entries"), F.array_sort(F.collect_set("entity_type")).alias("entity_types"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("entity_type", "properties")))).alias("properties_by_type"),
    )


def extract_entities(df: DataFrame) -> DataFrame:
    """(source_id, pos, name, type, properties) from ``Name [Type] {k: v, ...}`` lines; a source without
    any such line is one entity named by its whole content."""
    pairs = F.filter(F.split(F.regexp_extract("line", ENTITY, 3), ",", -1), lambda p: p.contains(":"))
    entries = F.transform(pairs, lambda p: F.struct(strip(F.substring_index(p, ":", 1)).alias("k"), strip(F.regexp_replace(p, r"^[^:]*:", "")).alias("v")))
    made = _lines(df).where(F.col("line").rlike(ENTITY)).select(
        "source_id", "pos", strip(F.regexp_extract("line", ENTITY, 1)).alias("name"), F.nullif(F.regexp_extract("line", ENTITY, 2), F.lit("")).alias("type"),
        F.map_from_entries(_last_by_key(entries)).alias("properties"),
    )
    rest = df.join(made.select("source_id").distinct(), "source_id", "left_anti").where(strip(F.coalesce("content", F.lit(""))) != "")
    return made.unionByName(rest.select(
        "source_id", F.lit(0).alias("pos"), strip(F.col("content")).alias("name"), F.lit(None).cast("string").alias("type"), F.expr("cast(map() as map<string,string>)").alias("properties")
    ))


def _last_by_key(entries: Column) -> Column:
    """Entries without those that a later one with the same key replaces."""
    return F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda o: o["k"] == e["k"]))


def entity_profile(entities: DataFrame) -> DataFrame:
    """Per source: entity count, sorted types and sorted property keys."""
    return entities.groupBy("source_id").agg(
        F.count("*").alias("n_entities"), F.array_sort(F.collect_set("type")).alias("types"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.map_keys("properties"))))).alias("property_keys"),
    )


def process_knowledge(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, errors): every row extracted by its input_type, as (source_id, kind, pos, item); rows of an
    unknown type are errors."""
    def kind(name: str, rows: DataFrame, item: Column) -> DataFrame:
        return rows.select("source_id", F.lit(name).alias("kind"), F.col("pos").cast("int").alias("pos"), item.alias("item"))

    def of(name: str) -> DataFrame:
        return df.where(F.col("input_type") == name)

    chunks = chunk_sentences(of("text").select(F.col("source_id").alias("doc_id"), F.col("content").alias("text"))).select(F.col("doc_id").alias("source_id"), F.col("chunk_index").alias("pos"), "content")
    items = (
        kind("triple", extract_triples(of("triple")), F.concat_ws(" | ", "subject", "predicate", "object"))
        .unionByName(kind("schema", extract_schema(of("schema")), F.concat_ws(" | ", "entity_type", "property", "value")))
        .unionByName(kind("entity", extract_entities(of("entity")), F.col("name")))
        .unionByName(kind("text", chunks, F.col("content")))
    )
    errors = df.where(F.col("input_type").isNull() | ~F.col("input_type").isin(*INPUT_TYPES)).select("source_id", F.lit("unknown input_type").alias("error"))
    return items, errors
