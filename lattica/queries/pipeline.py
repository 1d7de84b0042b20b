"""Queries of problems 1 to 5 over the store tables, with SQL for the same results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators.changes import apply_changes
from lattica.operators.merkle import process_new, unseen_changes
from lattica.operators.nested import contained, current_rows, element_maps, flat_rows, flat_table, is_element_map, node_table
from lattica.operators.orphans import document_orphans, orphan_report, orphans
from lattica.operators.skew import frequent_keys, salted_aggregate
from lattica.sources.shared import fresh, stage
from lattica.sources.tables import table


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    parts = [
        frequent_keys(table(spark, root, t), key, 0.05).select(F.lit(t).alias("table_name"), F.col(key).alias("key_value"))
        for t, key in (("winche_changes", "collection_path"), ("winche_documents", "collection_id"))
    ]
    return parts[0].unionByName(parts[1])


def p1_change_collections(spark: SparkSession, root: str) -> DataFrame:
    return salted_aggregate(
        table(spark, root, "winche_changes"), "collection_path",
        {"rows": ("count", None), "latest_seq": ("max", "seq"), "latest_commit": ("max", "commit_time"), "max_version": ("max", "version")},
        {"documents": ["document_path"], "versions": ["document_path", "version"]})


def p1_document_collections(spark: SparkSession, root: str) -> DataFrame:
    return salted_aggregate(
        table(spark, root, "winche_documents"), "collection_id",
        {"rows": ("count", None), "latest_update": ("max", "updated_at"), "max_version": ("max", "version")},
        {"documents": ["document_path"], "versions": ["document_path", "version"]})


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    rows = current_rows(table(spark, root, "winche_documents"), "document_path", "version", "collection_id", "data")
    return element_maps(rows).select("document_path", "parent_pointer", F.col("pointer").alias("child_pointer"))


def p2_nodes(spark: SparkSession, root: str) -> DataFrame:
    rows = current_rows(table(spark, root, "winche_documents"), "document_path", "version", "collection_id", "data")
    return node_table(rows).select("document_path", "pre", "post", "depth", "parent_pre", "kind", "in_array", "pointer", "name", "value")


def p2_documents(spark: SparkSession, root: str) -> DataFrame:
    rows = current_rows(table(spark, root, "winche_documents"), "document_path", "version", "collection_id", "data")
    nodes = node_table(rows, lambda n: n[2] == "document")
    return nodes.select("document_path", "pre", "post", ((F.col("post") - F.col("pre")) + F.col("depth")).alias("descendants"))


def _flat(spark: SparkSession, root: str) -> DataFrame:
    return flat_rows(current_rows(table(spark, root, "winche_documents"), "document_path", "version", "collection_id", "data"))


def p2_flat_rows(spark: SparkSession, root: str) -> DataFrame:
    return _flat(spark, root).select("document_path", "table_name", "kind", "pre", "parent_pre", "pointer", F.size("fields").alias("n_fields"))


def p2_items(spark: SparkSession, root: str) -> DataFrame:
    return flat_table(_flat(spark, root), "items[]", {"product": "product", "qty": "qty", "price": "price"}).select("document_path", "pointer", "product", "qty", "price")


def p2_item_options(spark: SparkSession, root: str) -> DataFrame:
    """Options with the item they stand in, by the parent's label."""
    rows = stage(_flat(spark, root).where(F.col("table_name").isin("items[]", "items[].options[]")), "flat")
    options = flat_table(rows, "items[].options[]", {"name": "name", "value": "value"})
    items = flat_table(rows, "items[]", {"product": "product"}).select("document_path", F.col("pre").alias("parent_pre"), F.col("pointer").alias("item"), "product")
    return options.join(items, ["document_path", "parent_pre"]).select("document_path", "pointer", "item", "product", "name", "value")


def p2_contained(spark: SparkSession, root: str) -> DataFrame:
    """Every reference value with each map of an array that it stands in, however far above: two node tables, linked by interval containment."""
    rows = current_rows(table(spark, root, "winche_documents"), "document_path", "version", "collection_id", "data")
    nodes = stage(node_table(rows, lambda n: is_element_map(n) or n[2] == "referenceValue"), "nodes")
    maps, references = nodes.where("kind = 'mapValue'"), nodes.where("kind = 'referenceValue'")
    links = contained(maps, references)
    inner = links.join(references.select("document_path", F.col("pre").alias("inner_pre"), F.col("pointer").alias("reference"), "value"), ["document_path", "inner_pre"])
    return inner.join(maps.select("document_path", F.col("pre").alias("outer_pre"), F.col("pointer").alias("map")),
        ["document_path", "outer_pre"]).select("document_path", "map", "reference", "value")


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return apply_changes(spark, table(spark, root, "winche_changes"), fresh(spark, "p3"))


def p3_two_runs(spark: SparkSession, root: str) -> DataFrame:
    """The feed in two runs, its later rows first: the second meets repeats, lower places of known changes and tombstones."""
    changes, at = table(spark, root, "winche_changes"), fresh(spark, "p3")
    middle = changes.agg(F.avg("seq")).first()[0] or 0
    later = F.coalesce(F.col("seq") > middle, F.lit(False))
    apply_changes(spark, changes.where(later), at)
    return apply_changes(spark, changes.where(~later), at)


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return document_orphans(table(spark, root, "winche_documents")).select("document_path", "target_path")


def p4_report(spark: SparkSession, root: str) -> DataFrame:
    return orphan_report(document_orphans(table(spark, root, "winche_documents")))


def _by_mask(match: str):
    """Changes whose collection and document id (either may be null) name no stored document, under a match rule."""
    def run(spark: SparkSession, root: str) -> DataFrame:
        named = F.when(F.col("document_path").isNotNull(), F.substring_index("document_path", "/", -1))
        references = table(spark, root, "winche_changes").select("seq", "type", "collection_path", named.alias("id"))
        targets = table(spark, root, "winche_documents").select(F.col("collection_path").alias("stored_collection"), "document_id").distinct()
        return orphans(references, targets, [("collection_path", "stored_collection"), ("id", "document_id")], match)

    run.__name__ = f"p4_{match}"
    return run


p4_simple, p4_partial, p4_full, p4_exact = map(_by_mask, ("simple", "partial", "full", "exact"))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return unseen_changes(table(spark, root, "winche_changes"), table(spark, root, "winche_feed_cursors"), fresh(spark, "p5"))


def p5_two_runs(spark: SparkSession, root: str) -> DataFrame:
    """The feed in two runs; the second, over all of it, gives what the first has not put out."""
    changes, cursors, at = table(spark, root, "winche_changes"), table(spark, root, "winche_feed_cursors"), fresh(spark, "p5")
    middle = changes.agg(F.avg("seq")).first()[0] or 0
    first = unseen_changes(changes.where(F.col("seq") <= middle), cursors, at)
    return first.unionByName(unseen_changes(changes, cursors, at))


def p5_process_new(spark: SparkSession, root: str) -> DataFrame:
    """Rows of the feed that have been handled after three runs (half of it, all of it, all of it again), each once."""
    changes, at = table(spark, root, "winche_changes"), fresh(spark, "p5")
    middle = changes.agg(F.avg("seq")).first()[0] or 0
    handled = [process_new(spark, part, "seq", at, lambda new: new) for part in (changes.where(F.col("seq") <= middle), changes, changes)]
    return handled[0].unionByName(handled[1]).unionByName(handled[2])


QUERIES = {f.__name__: f for f in (
    p1_found, p1_change_collections, p1_document_collections, p2_found, p2_nodes, p2_documents, p2_flat_rows, p2_items, p2_item_options, p2_contained,
    p3_found, p3_two_runs, p4_found, p4_report, p4_simple, p4_partial, p4_full, p4_exact,
    p5_found, p5_two_runs, p5_process_new)}

# arg_max skips rows whose argument is null, so the row is taken as one struct
CURRENT = """current AS (
    SELECT document_path, r.data AS data, r.collection_id AS collection_id, r.created_at AS created_at, r.updated_at AS updated_at
    FROM (SELECT document_path, arg_max(struct_pack(data := data, collection_id := collection_id, created_at := created_at, updated_at := updated_at), k) AS r
        FROM (SELECT *, struct_pack(v := version, c := collection_id IS NOT NULL, u := updated_at) AS k FROM winche_documents WHERE document_path IS NOT NULL) GROUP BY document_path))"""

# a node is a tagged value; ``v`` is what stands under its tag
_NODES = CURRENT + """,
nodes AS (
    SELECT document_path, f.key AS pointer, false AS in_array, '' AS parent_case, '' AS own_case, json_keys(f.value)[1] AS tag, f.value AS whole
    FROM (SELECT document_path, data FROM current WHERE json_valid(data)) c, json_each(c.data) f
    UNION ALL
    SELECT n.document_path, CASE WHEN n.tag = 'mapValue' THEN n.pointer || '.' || f.key ELSE n.pointer || '[' || f.key || ']' END, n.tag = 'arrayValue',
        CASE WHEN n.in_array AND n.tag = 'mapValue' THEN n.pointer ELSE n.parent_case END, '', json_keys(f.value)[1], f.value
    FROM nodes n, json_each(CASE WHEN n.tag = 'mapValue' THEN coalesce(n.whole->'mapValue'->'fields', '{}'::JSON) WHEN n.tag = 'arrayValue' THEN coalesce(n.whole->'arrayValue'->'values', '[]'::JSON) ELSE '[]'::JSON END) f)"""

_REFERENCES = _NODES + """,
refs AS (
    SELECT document_path, whole->>'referenceValue' AS target_path FROM nodes WHERE tag = 'referenceValue'
    UNION
    SELECT document_path, array_to_string(list_slice(string_split(document_path, '/'), 1, len(string_split(document_path, '/')) - 2), '/') FROM current WHERE len(string_split(document_path, '/')) > 2),
orphans AS (
    SELECT r.document_path, r.target_path, c.collection_id, c.updated_at FROM refs r JOIN current c ON c.document_path = r.document_path
    WHERE NOT EXISTS (SELECT 1 FROM current t WHERE t.document_path = r.target_path AND t.created_at <= c.updated_at))"""

SQL = {
    "p1_found": """
        SELECT 'winche_changes' AS table_name, collection_path AS key_value FROM winche_changes WHERE collection_path IS NOT NULL GROUP BY 2 HAVING count(*) >= 0.05 * (SELECT count(*) FROM winche_changes)
        UNION ALL
        SELECT 'winche_documents', collection_id FROM winche_documents WHERE collection_id IS NOT NULL GROUP BY 2 HAVING count(*) >= 0.05 * (SELECT count(*) FROM winche_documents)""",
    "p1_change_collections": """
        SELECT collection_path, count(*) AS rows, max(seq) AS latest_seq, max(commit_time) AS latest_commit, max(version) AS max_version, count(DISTINCT document_path) AS documents,
            count(DISTINCT CASE WHEN document_path IS NOT NULL AND version IS NOT NULL THEN (document_path, version) END) AS versions
        FROM winche_changes GROUP BY collection_path""",
    "p1_document_collections": """
        SELECT collection_id, count(*) AS rows, max(updated_at) AS latest_update, max(version) AS max_version, count(DISTINCT document_path) AS documents,
            count(DISTINCT CASE WHEN document_path IS NOT NULL AND version IS NOT NULL THEN (document_path, version) END) AS versions
        FROM winche_documents GROUP BY collection_id""",
    "p2_found": f"WITH RECURSIVE {_NODES} SELECT document_path, parent_case AS parent_pointer, pointer AS child_pointer FROM nodes WHERE in_array AND tag = 'mapValue'",
    "p2_documents": f"""
        WITH RECURSIVE {_NODES} SELECT c.document_path, 0::BIGINT AS pre, count(n.document_path) AS post, count(n.document_path) AS descendants
        FROM current c LEFT JOIN nodes n ON n.document_path = c.document_path GROUP BY c.document_path""",
    "p2_items": f"""
        WITH {CURRENT}, i AS (SELECT document_path, v.key AS n, v.value->'mapValue'->'fields' AS f, json_exists(v.value, '$.mapValue') AS is_map FROM (SELECT * FROM current WHERE json_valid(data)) c, json_each(coalesce(json_extract(c.data, '$.items.arrayValue.values'), '[]'::JSON)) v)
        SELECT document_path, 'items[' || n || ']' AS pointer, json_extract_string(f, '$.product.referenceValue') AS product, coalesce(json_extract_string(f, '$.qty.integerValue'), json_extract_string(f, '$.qty.doubleValue')) AS qty,
            coalesce(json_extract_string(f, '$.price.doubleValue'), json_extract_string(f, '$.price.integerValue')) AS price FROM i WHERE is_map""",
    "p2_item_options": f"""
        WITH {CURRENT}, i AS (SELECT document_path, 'items[' || v.key || ']' AS item, v.value->'mapValue'->'fields' AS f FROM (SELECT * FROM current WHERE json_valid(data)) c, json_each(coalesce(json_extract(c.data, '$.items.arrayValue.values'), '[]'::JSON)) v WHERE json_exists(v.value, '$.mapValue')),
        o AS (SELECT document_path, item, f AS parent, item || '.options[' || v.key || ']' AS pointer, v.value->'mapValue'->'fields' AS g FROM i, json_each(coalesce(json_extract(i.f, '$.options.arrayValue.values'), '[]'::JSON)) v WHERE json_exists(v.value, '$.mapValue'))
        SELECT document_path, pointer, item, json_extract_string(parent, '$.product.referenceValue') AS product, json_extract_string(g, '$.name.stringValue') AS name,
            coalesce(json_extract_string(g, '$.value.stringValue'), json_extract_string(g, '$.value.integerValue'), json_extract_string(g, '$.value.doubleValue')) AS value FROM o""",
    "p3_found": """
        WITH known AS (SELECT document_path, type, version, commit_time, min(seq) AS seq FROM winche_changes WHERE document_path IS NOT NULL AND seq IS NOT NULL GROUP BY ALL)
        SELECT document_path, arg_max(version, seq) AS version, max(seq) AS seq FROM known GROUP BY document_path HAVING arg_max(type, seq) <> 'removed'""",
    "p4_found": f"WITH RECURSIVE {_REFERENCES} SELECT document_path, target_path FROM orphans",
    "p4_report": f"WITH RECURSIVE {_REFERENCES} SELECT collection_id, strftime(updated_at, '%Y-%m') AS month, count(*) AS orphans FROM orphans GROUP BY 1, 2",
    "p5_found": """
        WITH known AS (SELECT min(seq) AS seq, commit_time FROM winche_changes WHERE document_path IS NOT NULL AND seq IS NOT NULL GROUP BY type, document_path, version, commit_time),
        saves AS (SELECT * FROM winche_feed_cursors WHERE seq IS NOT NULL AND consumer IS NOT NULL)
        SELECT DISTINCT c.consumer, k.seq FROM known k, (SELECT DISTINCT consumer FROM saves) c
        WHERE k.commit_time IS NULL OR coalesce(k.commit_time > (SELECT min(s.updated_at) FROM saves s WHERE s.consumer = c.consumer AND s.seq >= k.seq), true)""",
}
_MASKED = """
    WITH refs AS (SELECT seq, type, collection_path, regexp_extract(document_path, '[^/]*$') AS id FROM winche_changes), pairs AS (SELECT DISTINCT collection_path AS c, document_id AS d FROM winche_documents),
    both_held AS (SELECT r.* FROM refs r WHERE collection_path IS NOT NULL AND id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM pairs WHERE c = collection_path AND d = id)),
    one_held AS (SELECT r.* FROM refs r WHERE collection_path IS NULL AND id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM pairs WHERE d = id)
        UNION ALL SELECT r.* FROM refs r WHERE collection_path IS NOT NULL AND id IS NULL AND NOT EXISTS (SELECT 1 FROM pairs WHERE c = collection_path)),
    null_held AS (SELECT r.* FROM refs r WHERE collection_path IS NULL AND id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM pairs WHERE c IS NULL AND d = id)
        UNION ALL SELECT r.* FROM refs r WHERE collection_path IS NOT NULL AND id IS NULL AND NOT EXISTS (SELECT 1 FROM pairs WHERE c = collection_path AND d IS NULL)
        UNION ALL SELECT r.* FROM refs r WHERE collection_path IS NULL AND id IS NULL AND NOT EXISTS (SELECT 1 FROM pairs WHERE c IS NULL AND d IS NULL))
    SELECT * FROM both_held"""
SQL["p4_simple"] = _MASKED
SQL["p4_partial"] = f"{_MASKED} UNION ALL SELECT * FROM one_held"
SQL["p4_full"] = f"{_MASKED} UNION ALL SELECT * FROM refs WHERE (collection_path IS NULL) <> (id IS NULL)"
SQL["p4_exact"] = f"{_MASKED} UNION ALL SELECT * FROM null_held"

# every node with its place (the ordinals of the fields and elements on the way to it), which sorts in pre-order
_PLACED = CURRENT + """,
placed AS (
    SELECT document_path, f.key AS pointer, f.key AS name, false AS in_array, 1 AS depth, [f.id]::UBIGINT[] AS place, json_keys(f.value) AS tags, f.value AS whole, NULL::VARCHAR[] AS maps
    FROM (SELECT document_path, data FROM current WHERE json_valid(data)) c, json_each(c.data) f
    UNION ALL
    SELECT n.document_path, CASE WHEN n.tags[1] = 'mapValue' THEN n.pointer || '.' || f.key ELSE n.pointer || '[' || f.key || ']' END, f.key, n.tags[1] = 'arrayValue', n.depth + 1, n.place || [f.id], json_keys(f.value), f.value,
        CASE WHEN n.in_array AND n.tags[1] = 'mapValue' THEN list_append(coalesce(n.maps, []), n.pointer) ELSE n.maps END
    FROM placed n, json_each(CASE WHEN n.tags[1] = 'mapValue' THEN coalesce(n.whole->'mapValue'->'fields', '{}'::JSON) WHEN n.tags[1] = 'arrayValue' THEN coalesce(n.whole->'arrayValue'->'values', '[]'::JSON) ELSE '[]'::JSON END) f),
labelled AS (
    SELECT document_path, pointer, name, in_array, depth, place, tags[1] AS kind, whole, maps, row_number() OVER (PARTITION BY document_path ORDER BY place) AS pre FROM placed)"""
SQL["p2_contained"] = f"WITH RECURSIVE {_PLACED} SELECT document_path, m AS map, pointer AS reference, whole->>'referenceValue' AS value FROM labelled, unnest(maps) AS u(m) WHERE kind = 'referenceValue'"
SQL["p2_nodes"] = f"""
    WITH RECURSIVE {_PLACED}, sizes AS (
        SELECT a.document_path, a.pre, count(*) AS below FROM labelled a JOIN labelled b ON a.document_path = b.document_path AND len(b.place) >= len(a.place) AND b.place[:len(a.place)] = a.place GROUP BY ALL)
    SELECT document_path, pre, pre + below - 1 - depth AS post, depth::INT AS depth, coalesce(up.pre, 0) AS parent_pre, kind, in_array, pointer, name,
        CASE WHEN kind IN ('mapValue', 'arrayValue') THEN NULL WHEN kind = 'geoPointValue' THEN replace(replace(whole->>kind, '":', '": '), ',"', ', "') ELSE whole->>kind END AS value
    FROM labelled JOIN sizes USING (document_path, pre) LEFT JOIN (SELECT document_path, place AS above, pre FROM labelled) up ON up.document_path = labelled.document_path AND up.above = labelled.place[:-2]
    UNION ALL SELECT c.document_path, 0, count(p.document_path), 0, -1, 'document', false, '', '', NULL FROM current c LEFT JOIN placed p ON p.document_path = c.document_path GROUP BY c.document_path"""
SQL["p2_flat_rows"] = f"""
    WITH RECURSIVE {_PLACED}, flat AS (
        SELECT document_path, pre, pointer, CASE WHEN kind = 'mapValue' THEN 'map' ELSE 'value' END AS kind, maps[-1] AS above FROM labelled WHERE in_array AND kind <> 'arrayValue'
        UNION ALL SELECT document_path, 0, '', 'document', NULL FROM current),
    held AS (SELECT document_path, coalesce(maps[-1], '') AS pointer, count(DISTINCT pointer) AS n FROM labelled WHERE NOT in_array AND kind NOT IN ('mapValue', 'arrayValue') GROUP BY ALL)
    SELECT f.document_path, regexp_replace(f.pointer, '\\[[0-9]+\\]', '[]', 'g') AS table_name, f.kind, f.pre, CASE WHEN f.kind = 'document' THEN -1 ELSE coalesce(up.pre, 0) END AS parent_pre, f.pointer,
        CASE WHEN f.kind = 'value' THEN 1 ELSE coalesce(n, 0) END::INT AS n_fields
    FROM flat f LEFT JOIN flat up ON up.document_path = f.document_path AND up.pointer = f.above AND up.kind = 'map' LEFT JOIN held ON held.document_path = f.document_path AND held.pointer = f.pointer AND f.kind <> 'value'"""
SQL["p3_two_runs"], SQL["p5_two_runs"] = SQL["p3_found"], SQL["p5_found"]
SQL["p5_process_new"] = "SELECT DISTINCT * FROM winche_changes WHERE seq IS NOT NULL"
