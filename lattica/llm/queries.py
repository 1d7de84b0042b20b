"""Queries of problems 6 to 8, with SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import contamination, mixing, quality
from lattica.sources.tables import table


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    return contamination.leaked_items(table(spark, root, "documents"), table(spark, root, "eval_items"))


def p6_leak_report(spark: SparkSession, root: str) -> DataFrame:
    items = table(spark, root, "eval_items")
    return contamination.leak_report(contamination.leaked_items(table(spark, root, "documents"), items), items)


def p7_mix(spark: SparkSession, root: str) -> DataFrame:
    return mixing.mix(table(spark, root, "documents"), table(spark, root, "mix_targets"), total=mixing.AVAILABLE)


def p7_shares(spark: SparkSession, root: str) -> DataFrame:
    targets = table(spark, root, "mix_targets")
    return mixing.shares(p7_mix(spark, root), targets)


def p7_weighted_mix(spark: SparkSession, root: str) -> DataFrame:
    """The mix with documents of a source weighted by how well their two sides fit."""
    documents = table(spark, root, "documents")
    weights = documents.select("doc_id", F.col("align_score").alias("weight"))
    return mixing.mix(documents, table(spark, root, "mix_targets"), total=mixing.AVAILABLE, weights=weights)


def p8_statistics(spark: SparkSession, root: str) -> DataFrame:
    return quality.text_statistics(table(spark, root, "documents"), table(spark, root, "common_words"))


def p8_plain_statistics(spark: SparkSession, root: str) -> DataFrame:
    """The statistics that SQL can tell, too."""
    return p8_statistics(spark, root).select("doc_id", "n_words", "mean_word_length", "symbol_ratio", "punct_line_share", "common_word_share",
        "duplicate_line_share", "duplicate_paragraph_share")


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    return quality.not_prose(p8_statistics(spark, root))


QUERIES = {f.__name__: f for f in (p6_found, p6_leak_report, p7_mix, p7_shares, p7_weighted_mix, p8_statistics, p8_plain_statistics, p8_found)}

_WORDS = r"""list_filter(string_split_regex(regexp_replace(lower(strip_accents(nfc_normalize({}))), '[\x{{200B}}-\x{{200F}}\x{{2060}}-\x{{2064}}\x{{FEFF}}\x{{00AD}}\x{{0300}}-\x{{036F}}]', '', 'g'), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"""
_HELD = f"""
WITH docs AS MATERIALIZED (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents WHERE text IS NOT NULL),
items AS MATERIALIZED (SELECT item_id, suite, {_WORDS.format('text')} AS w FROM eval_items WHERE text IS NOT NULL),
doc_runs AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i+3], ' ') AS run FROM docs, unnest(generate_series(1, len(w) - 3)) AS g(i)),
doc_long AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i+11], ' ') AS run FROM docs, unnest(generate_series(1, len(w) - 11)) AS g(i)),
item_runs AS MATERIALIZED (SELECT item_id, i, len(w) AS n, array_to_string(w[i:i+3], ' ') AS run FROM items, unnest(generate_series(1, len(w) - 3)) AS g(i)),
item_long AS MATERIALIZED (SELECT item_id, array_to_string(w[i:i+11], ' ') AS run FROM items, unnest(generate_series(1, len(w) - 11)) AS g(i)),
covered AS (SELECT doc_id, item_id, n, len(list_distinct(flatten(list([i, i+1, i+2, i+3])))) AS k FROM item_runs JOIN doc_runs USING (run) GROUP BY ALL),
held AS (SELECT DISTINCT doc_id, item_id FROM item_long JOIN doc_long USING (run) UNION SELECT doc_id, item_id FROM covered WHERE k >= 0.8 * n)"""

_BLANK = r"[\s\x1c-\x1f\x{85}\p{Z}]"
_TRIM = rf"regexp_replace(regexp_replace(x, '^{_BLANK}+', ''), '{_BLANK}+$', '')"
_REPEATED = "coalesce((list_sum(list_transform({0}, lambda x: len(x))) - list_sum(list_transform(list_distinct({0}), lambda x: len(x)))) / list_sum(list_transform({0}, lambda x: len(x))), 0)::DOUBLE"


def _parts(mark: str) -> str:
    """The pieces of a text that are not blank, trimmed."""
    return f"list_filter(list_transform(string_split_regex(text, '{mark}'), lambda x: {_TRIM}), lambda x: x <> '')"


_STATISTICS = rf"""
WITH shown AS (SELECT doc_id, CASE WHEN regexp_replace(coalesce(text, ''), '{_BLANK}+', '', 'g') = '' THEN NULL ELSE text END AS text FROM documents),
parts AS (SELECT row_number() OVER () AS row_no, doc_id, text, regexp_extract_all(text, '[\p{{L}}\p{{N}}]+') AS w,
    {_parts(r'\r\n|[\n\r\v\f\x1c-\x1e\x{85}\x{2028}\x{2029}]')} AS lines, {_parts(rf'\n{_BLANK}*\n')} AS paragraphs FROM shown),
common AS (SELECT lang, list(DISTINCT replace(lower(word), 'ß', 'ss')) AS words FROM common_words WHERE lang IS NOT NULL AND word IS NOT NULL GROUP BY lang),
shares AS (SELECT row_no, max(len(list_filter(w, lambda x: list_contains(words, replace(lower(x), 'ß', 'ss'))))) AS n FROM parts, common WHERE text IS NOT NULL GROUP BY row_no)
SELECT doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: len(x))) / len(w), 0)::DOUBLE AS mean_word_length,
    coalesce(len(regexp_replace(text, '[\p{{L}}\p{{N}}\p{{M}}\s\x1c-\x1f\x{{85}}\p{{Z}}]+', '', 'g')) / len(text), 0)::DOUBLE AS symbol_ratio,
    coalesce(len(list_filter(lines, lambda x: regexp_matches(x, '\p{{P}}["''”’»›“‘)\]*_]*$'))) / len(lines), 0)::DOUBLE AS punct_line_share,
    (CASE WHEN len(w) > 0 THEN coalesce(n, 0) / len(w) ELSE 0 END)::DOUBLE AS common_word_share,
    {_REPEATED.format("lines")} AS duplicate_line_share, {_REPEATED.format("paragraphs")} AS duplicate_paragraph_share
FROM parts LEFT JOIN shares USING (row_no)"""

SQL = {
    "p8_plain_statistics": _STATISTICS,
    "p6_found": f"{_HELD} SELECT doc_id, item_id FROM held",
    "p6_leak_report": f"{_HELD} SELECT item_id, suite, count(doc_id) AS documents FROM eval_items LEFT JOIN held USING (item_id) GROUP BY ALL",
}
