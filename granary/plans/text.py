"""Queries of text preparation, extraction and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.operators import extract as X
from granary.operators import text as T
from granary.operators import validate as V

from .common import KNOWLEDGE, frame, plain, table

_K = plain(KNOWLEDGE)
_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def _knowledge(spark, sf):
    return frame(spark, sf, KNOWLEDGE)


def _docs(spark, sf):
    return table(spark, sf, "documents")


def txt1(spark, sf):
    return T.clean_corpus(_docs(spark, sf)).select("doc_id", "copies", F.sha2("text", 256).alias("text_sha256"))


def txt2(spark, sf):
    return T.drop_empty(_docs(spark, sf).withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.lit(" NaN ")).otherwise(F.col("text"))))[1]


def txt3(spark, sf):
    return T.token_budget(_docs(spark, sf), ["source", "lang"])


def txt4(spark, sf):
    return X.dedup_triple_text(_knowledge(spark, sf).where("input_type = 'triple'"))


def txt6(spark, sf):
    return X.detect_input_type(_knowledge(spark, sf)).groupBy("input_type").agg(F.count("*").alias("n"))


def txt7(spark, sf):
    items, errors = X.process_knowledge(_knowledge(spark, sf).withColumn("input_type", F.when(F.col("source_id") == "d3", F.lit("audio")).otherwise(F.col("input_type"))))
    listed = items.groupBy("source_id", "kind").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("item")), "\n").alias("items"))
    listed = listed.select("source_id", "kind", "n", F.sha2("items", 256).alias("items_sha256"))
    return listed.unionByName(errors.select("source_id", F.lit("error").alias("kind"), F.lit(1).cast("long").alias("n"), F.sha2("error", 256).alias("items_sha256")))


def txt8(spark, sf):
    return X.extract_triples(_knowledge(spark, sf))


def txt9(spark, sf):
    p = X.triple_profile(X.extract_triples(_knowledge(spark, sf).where("input_type = 'triple'")))
    return p.select("source_id", "n_triples", *(F.array_join(c, ";").alias(c) for c in ("subjects", "predicates", "objects")))


def txt10(spark, sf):
    return X.extract_schema(_knowledge(spark, sf)).drop("pos")


def txt11(spark, sf):
    p = X.schema_profile(X.extract_schema(_knowledge(spark, sf)))
    text = F.array_join(F.transform(F.map_entries("properties_by_type"), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], ","))), ";")
    return p.select("source_id", "n_entries", F.array_join("entity_types", ",").alias("entity_types"), text.alias("properties"))


def txt12(spark, sf):
    e = X.extract_entities(_knowledge(spark, sf).where("input_type = 'entity'"))
    text = F.array_join(F.array_sort(F.transform(F.map_entries("properties"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")
    return e.select("source_id", "name", "type", text.alias("properties"))


def txt13(spark, sf):
    p = X.entity_profile(X.extract_entities(_knowledge(spark, sf).where("input_type = 'entity'")))
    return p.select("source_id", "n_entities", F.array_join("types", ",").alias("types"), F.array_join("property_keys", ",").alias("property_keys"))


def txt14(spark, sf):
    return T.chunk_sentences(_docs(spark, sf))


def txt15(spark, sf):
    return T.chunk_fixed(_docs(spark, sf))


def txt16(spark, sf):
    return T.sentence_table(_docs(spark, sf)).select("doc_id", "pos", F.sha2("sentence", 256).alias("sentence_sha256"))


def txt17(spark, sf):
    docs = _docs(spark, sf).select("doc_id", F.lit(None).cast("string").alias("source_id"), F.col("text").alias("content"))
    return T.assign_source_ids(docs)[0].select("doc_id", "source_id")


_BROKEN = """
    SELECT CASE WHEN length(source_id) % 4 = 0 THEN '' ELSE source_id END AS source_id,
           CASE WHEN source_id LIKE '%7' THEN 'audio' ELSE input_type END AS input_type,
           CASE WHEN source_id LIKE '%5' THEN ' None ' WHEN source_id LIKE 'p%4' THEN 'no separator' ELSE content END AS content, metadata, source_id AS row_id
    FROM ({0}) AS k
"""


def _rows(spark, sf):
    return frame(spark, sf, _BROKEN.format(KNOWLEDGE))


def val1(spark, sf):
    return _rows(spark, sf).select("row_id", F.array_join(V.format_errors(), ",").alias("errors"))


def val2(spark, sf):
    return _rows(spark, sf).select("row_id", F.array_join(V.semantic_errors(), ",").alias("errors"))


def val3(spark, sf):
    return V.validate(_rows(spark, sf)).select("row_id", "error")


def val4(spark, sf):
    ok, rejected = V.split_valid(_rows(spark, sf))
    return ok.select("row_id", F.lit("ok").alias("part")).unionByName(rejected.select("row_id", F.lit("rejected").alias("part")))


QUERIES = {
    "txt1_clean_corpus": txt1, "txt2_drop_empty": txt2, "txt3_token_budget": txt3, "txt4_dedup_triple_text": txt4, "txt6_detect_input_type": txt6,
    "txt7_process_knowledge": txt7, "txt8_extract_triples": txt8, "txt9_triple_profile": txt9, "txt10_extract_schema": txt10, "txt11_schema_profile": txt11,
    "txt12_extract_entities": txt12, "txt13_entity_profile": txt13, "txt14_chunk_sentences": txt14, "txt15_chunk_fixed": txt15, "txt16_sentence_table": txt16,
    "txt17_assign_source_ids": txt17, "val1_validate_format": val1, "val2_validate_semantic": val2, "val3_validate": val3, "val4_split_valid": val4,
}

_CLEAN = r"regexp_replace(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'), '^ | $', '', 'g')"
_TRIPLES = rf"""
    WITH k AS ({_K}), a AS (
        SELECT source_id, input_type, content, list_concat(
            list_zip(regexp_extract_all(content, '\(([^,|]+?)\s*,\s*([^,|]+?)\s*,\s*([^,|]+?)\s*\)', 1), regexp_extract_all(content, '\(([^,|]+?)\s*,\s*([^,|]+?)\s*,\s*([^,|]+?)\s*\)', 2), regexp_extract_all(content, '\(([^,|]+?)\s*,\s*([^,|]+?)\s*,\s*([^,|]+?)\s*\)', 3)),
            list_zip(regexp_extract_all(content, '([^|]+?)\s*\|\s*([^|]+?)\s*\|\s*([^|]+)', 1), regexp_extract_all(content, '([^|]+?)\s*\|\s*([^|]+?)\s*\|\s*([^|]+)', 2), regexp_extract_all(content, '([^|]+?)\s*\|\s*([^|]+?)\s*\|\s*([^|]+)', 3))) AS found,
            list_filter(list_transform(string_split(content, ','), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p <> '') AS parts
        FROM k
    ), b AS (
        SELECT source_id, input_type, CASE
            WHEN len(found) = 0 AND len(content) - len(replace(content, ',', '')) >= 2 AND NOT contains(content, '|')
            THEN CASE WHEN len(parts) >= 3 THEN list_transform(range(1, len(parts) - 1, 3), lambda i: {{'s': parts[i], 'p': parts[i + 1], 'o': parts[i + 2]}}) ELSE [] END
            ELSE list_transform(found, lambda f: {{'s': regexp_replace(f[1], '^\s+|\s+$', '', 'g'), 'p': regexp_replace(f[2], '^\s+|\s+$', '', 'g'), 'o': regexp_replace(f[3], '^\s+|\s+$', '', 'g')}}) END AS t
        FROM a
    ), c AS (SELECT source_id, input_type, unnest(t) AS t, generate_subscripts(t, 1) AS i FROM b
    ), d AS (SELECT source_id, input_type, t, min(i) AS i FROM c GROUP BY ALL
    ), triples AS (
        SELECT source_id, input_type, CAST(row_number() OVER (PARTITION BY source_id ORDER BY i) - 1 AS INT) AS pos, t.s AS subject, t.p AS predicate, t.o AS object FROM d
    )
"""
_LINES = rf"""
    WITH k AS ({_K}), l AS (
        SELECT source_id, input_type, content, regexp_replace(unnest(regexp_split_to_array(content, '[\n;]+')), '^\s+|\s+$', '', 'g') AS line FROM k
    )
"""
_SCHEMA = r"'^([\p{L}\p{N}_]+)\s*:\s*([\p{L}\p{N}_]+)\s*->\s*(.+)'"
_ENTRIES = _LINES + rf""", entries AS (
        SELECT source_id, trim(regexp_extract(line, {_SCHEMA}, 1)) AS entity_type, trim(regexp_extract(line, {_SCHEMA}, 2)) AS property, regexp_replace(regexp_extract(line, {_SCHEMA}, 3), '^\s+|\s+$', '', 'g') AS value
        FROM l WHERE regexp_matches(line, {_SCHEMA})
    )
"""
_ENTITY = r"'^([^{\[]+)\s*(?:\[([\p{L}\p{N}_]+)\])?\s*(?:\{([^}]*)\})?'"
_ENTITIES = _LINES + rf""", entities AS (
        SELECT source_id, trim(regexp_extract(line, {_ENTITY}, 1)) AS name, nullif(regexp_extract(line, {_ENTITY}, 2), '') AS type,
               list_sort(list_transform(list_filter(string_split(regexp_extract(line, {_ENTITY}, 3), ','), lambda p: contains(p, ':')),
                   lambda p: trim(string_split(p, ':')[1]) || '=' || trim(regexp_replace(p, '^[^:]*:', '')))) AS props
        FROM l WHERE input_type = 'entity' AND line <> '' AND regexp_matches(line, {_ENTITY})
    )
"""
_ROWS = _BROKEN.format(_K)
_EMPTY = r"(regexp_replace(coalesce(content, ''), '^\s+|\s+$', '', 'g') = '' OR lower(regexp_replace(coalesce(content, ''), '^\s+|\s+$', '', 'g')) IN ('null', 'none', 'nan', '-'))"
_FORMAT = rf"""list_filter([
        CASE WHEN coalesce(source_id, '') = '' OR length(source_id) > 256 THEN 'source_id' END,
        CASE WHEN coalesce(input_type, 'triple') NOT IN ('triple', 'schema', 'text', 'entity') THEN 'input_type' END,
        CASE WHEN {_EMPTY} OR length(content) > 100000 THEN 'content' END,
        CASE WHEN length(coalesce(metadata, '')) > 10000 THEN 'metadata' END], lambda e: e IS NOT NULL)"""
_SEMANTIC = r"""CASE WHEN CASE input_type
        WHEN 'triple' THEN len(list_filter(string_split(content, '|'), lambda p: trim(p) <> '')) < 3
        WHEN 'schema' THEN NOT contains(content, '->') AND NOT contains(content, ':')
        WHEN 'text' THEN len(list_filter(string_split(content, '.'), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g') <> '')) < 1 OR length(content) < 3
        WHEN 'entity' THEN trim(content) = '' ELSE false END THEN 'content' ELSE '' END"""
_PIECES = r"""
    WITH p0 AS (
        SELECT doc_id, CAST(i AS INT) AS chunk_index, CAST(i * 462 AS INT) AS char_start, substr(text, i * 462 + 1, 512) AS piece, i * 462 + 512 < length(text) AS inside
        FROM (SELECT * FROM documents WHERE trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) <> '') d, unnest(range(0, CAST(ceil(length(text) / 462.0) AS BIGINT))) AS t(i)
    ), q AS (
        SELECT *, length(regexp_extract(substr(piece, 257), '(?s)^(.*?[.!?。！？]\s+)', 1)) AS sentence, length(regexp_extract(substr(piece, 257), '(?s)^(.*?)\s', 1)) AS word FROM p0
    ), r AS (
        SELECT *, CASE WHEN NOT inside THEN length(piece) WHEN sentence > 0 THEN 256 + sentence WHEN regexp_matches(substr(piece, 257), '\s') THEN 256 + word ELSE length(piece) END AS kept FROM q
    )
    SELECT doc_id || '_chunk_' || chunk_index AS chunk_id, doc_id, chunk_index, char_start, CAST(char_start + kept AS INT) AS char_end,
           regexp_replace(substr(piece, 1, kept), '^\s+|\s+$', '', 'g') AS content
    FROM r
"""



def _sentence_chunks(docs: str) -> str:
    """Greedy sentence chunks of ``docs`` (doc_id, text), a sentence a round."""
    lens = "list_transform(list_reverse(open), lambda t: length(t))"
    kept = f"len(list_filter(range(1, len(open) + 1), lambda j: list_sum(({lens})[1:j]) + j - 1 <= 50))"
    return rf"""
        WITH RECURSIVE s AS (
            SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS ss FROM ({docs}) AS d
        ), st AS (
            SELECT doc_id, 1 AS i, [ss[1]] AS open, length(ss[1]) + 1 AS n, 0 AS k, CAST(NULL AS VARCHAR) AS chunk FROM s
            UNION ALL
            SELECT doc_id, i + 1, list_append(CASE WHEN is_full THEN open[len(open) - c + 1:] ELSE open END, nxt),
                   CASE WHEN is_full THEN coalesce(list_sum(list_transform(open[len(open) - c + 1:], lambda t: length(t) + 1)), 0) ELSE n END + length(nxt) + 1,
                   k + CAST(is_full AS INT), CASE WHEN is_full THEN array_to_string(open, ' ') END
            FROM (SELECT st.*, ss[i + 1] AS nxt, n + length(ss[i + 1]) > 512 AS is_full, {kept} AS c FROM st JOIN s USING (doc_id) WHERE i < len(ss)) AS step
        )
        SELECT doc_id, CAST(k - 1 AS INT) AS chunk_index, chunk AS content FROM st WHERE chunk IS NOT NULL
        UNION ALL SELECT doc_id, CAST(k AS INT), array_to_string(open, ' ') FROM st JOIN s USING (doc_id) WHERE i = len(ss)
    """


_PARTS = rf"""
    SELECT source_id, 'triple' AS kind, subject || ' | ' || predicate || ' | ' || object AS item FROM ({_TRIPLES} SELECT * FROM triples WHERE input_type = 'triple') AS a
    UNION ALL SELECT source_id, 'schema', entity_type || ' | ' || property || ' | ' || value FROM ({_ENTRIES} SELECT * FROM entries WHERE source_id LIKE 'p%') AS b
    UNION ALL SELECT source_id, 'entity', name FROM ({_ENTITIES} SELECT * FROM entities) AS c
    UNION ALL SELECT doc_id, 'text', content FROM ({_sentence_chunks("SELECT 'd' || doc_id AS doc_id, text FROM documents WHERE doc_id <> 3")}) AS d
"""

ORACLE = {
    "txt7_process_knowledge": f"""SELECT source_id, kind, count(*) AS n, sha256(string_agg(item, chr(10) ORDER BY item)) AS items_sha256 FROM ({_PARTS}) AS p GROUP BY ALL
        UNION ALL SELECT 'd3', 'error', 1, sha256('unknown input_type') FROM documents WHERE doc_id = 3""",
    "txt14_chunk_sentences": _sentence_chunks("SELECT doc_id, text FROM documents"),
    "txt1_clean_corpus": f"SELECT min(doc_id) AS doc_id, count(*) AS copies, sha256({_CLEAN}) AS text_sha256 FROM documents GROUP BY {_CLEAN}",
    "txt2_drop_empty": "SELECT source, count(*) AS n_total, count(*) FILTER (doc_id % 7 = 0 OR trim(text) = '' OR text IS NULL OR lower(trim(text)) IN ('null', 'none', 'nan', '-')) AS n_dropped FROM documents GROUP BY source",
    "txt3_token_budget": "SELECT source, lang, CAST(sum(length(coalesce(text, '')) // 4) AS BIGINT) AS tokens, count(*) AS n_docs FROM documents GROUP BY source, lang",
    "txt4_dedup_triple_text": rf"""
        WITH k AS ({_K}), c AS (
            SELECT source_id, trim(regexp_replace(regexp_replace(trim(content), '^\((.*)\)$', '\1'), '\s*[,|]\s*', ' | ', 'g')) AS triple FROM k WHERE input_type = 'triple'
        ) SELECT triple, min(source_id) AS source_id, count(*) AS copies FROM c GROUP BY triple""",
    "txt6_detect_input_type": rf"""
        WITH k AS (SELECT regexp_replace(coalesce(content, ''), '^\s+|\s+$', '', 'g') AS s FROM ({_K}) k), w AS (
            SELECT s, len(list_filter(regexp_split_to_array(s, '\s+'), lambda x: x <> '')) AS n FROM k)
        SELECT CASE WHEN contains(s, '(') AND contains(s, ',') AND contains(s, ')') THEN 'triple' WHEN length(s) - length(replace(s, '|', '')) >= 2 THEN 'triple'
            WHEN contains(s, '->') OR (contains(s, ':') AND (contains(s, 'Entity') OR contains(s, 'Class') OR contains(s, 'Type'))) THEN 'schema'
            WHEN contains(s, '[') AND contains(s, ']') THEN 'entity' WHEN contains(s, chr(123)) AND contains(s, chr(125)) AND contains(s, ':') THEN 'entity'
            WHEN n > 5 AND length(s) > 20 OR length(s) > 50 OR n > 2 THEN 'text' ELSE 'entity' END AS input_type, count(*) AS n
        FROM w GROUP BY 1""",
    "txt8_extract_triples": _TRIPLES + "SELECT source_id, pos, subject, predicate, object FROM triples",
    "txt9_triple_profile": _TRIPLES + """SELECT source_id, count(*) AS n_triples, string_agg(DISTINCT subject, ';' ORDER BY subject) AS subjects,
        string_agg(DISTINCT predicate, ';' ORDER BY predicate) AS predicates, string_agg(DISTINCT object, ';' ORDER BY object) AS objects FROM triples WHERE input_type = 'triple' GROUP BY source_id""",
    "txt10_extract_schema": _ENTRIES + "SELECT * FROM entries",
    "txt11_schema_profile": _ENTRIES + """, t AS (SELECT source_id, entity_type, count(*) AS n, string_agg(DISTINCT property, ',' ORDER BY property) AS p FROM entries GROUP BY ALL)
        SELECT source_id, CAST(sum(n) AS BIGINT) AS n_entries, string_agg(entity_type, ',' ORDER BY entity_type) AS entity_types, string_agg(entity_type || '=' || p, ';' ORDER BY entity_type) AS properties FROM t GROUP BY source_id""",
    "txt12_extract_entities": _ENTITIES + "SELECT source_id, name, type, array_to_string(props, ',') AS properties FROM entities",
    "txt13_entity_profile": _ENTITIES + """SELECT source_id, count(*) AS n_entities, coalesce(string_agg(DISTINCT type, ',' ORDER BY type), '') AS types,
        array_to_string(list_sort(list_distinct(flatten(list(list_transform(props, lambda p: string_split(p, '=')[1]))))), ',') AS property_keys FROM entities GROUP BY source_id""",
    "txt15_chunk_fixed": _PIECES,
    "txt16_sentence_table": r"""
        WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '[.!?]\s+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS s FROM documents)
        SELECT doc_id, CAST(generate_subscripts(s, 1) - 1 AS INT) AS pos, sha256(unnest(s)) AS sentence_sha256 FROM s""",
    "txt17_assign_source_ids": "SELECT doc_id, 'kp_' || substr(sha256(coalesce(text, '')), 1, 12) AS source_id FROM documents",
    "val1_validate_format": f"SELECT row_id, array_to_string({_FORMAT}, ',') AS errors FROM ({_ROWS}) r",
    "val2_validate_semantic": f"SELECT row_id, {_SEMANTIC} AS errors FROM ({_ROWS}) r",
    "val3_validate": f"SELECT row_id, coalesce('format:' || {_FORMAT}[1], 'semantic:' || nullif({_SEMANTIC}, '')) AS error FROM ({_ROWS}) r",
    "val4_split_valid": f"SELECT row_id, CASE WHEN len({_FORMAT}) > 0 OR {_SEMANTIC} <> '' THEN 'rejected' ELSE 'ok' END AS part FROM ({_ROWS}) r",
}
