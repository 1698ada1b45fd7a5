"""DuckDB statements for those queries that SQL can express on whole tables."""

_NEAR = """WITH v AS (SELECT id, embedding::DOUBLE[] AS e FROM content_chunks WHERE model = 'embed-v2' AND embedding IS NOT NULL AND list_aggregate(list_transform(embedding, lambda x: abs(x)), 'max') > 0),
    u AS (SELECT id, e, sqrt(list_dot_product(e, e)) AS n FROM v),
    s AS (SELECT a.id AS query_id, b.id AS neighbour_id, round(list_dot_product(a.e, b.e) / (a.n * b.n), 6) AS similarity FROM u a JOIN u b ON a.id <> b.id WHERE a.id % 20 = 0)
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, neighbour_id) AS "rank", neighbour_id, similarity FROM s QUALIFY "rank" <= 10"""

ORACLES: dict[str, str] = {
    "p2_neighbours": _NEAR,
    "p2_found": f"SELECT DISTINCT least(query_id, neighbour_id) AS chunk_a, greatest(query_id, neighbour_id) AS chunk_b FROM ({_NEAR})",
    # the result is the same for any common tokenizer, so characters stand for tokens here
    "p7_found": """WITH d AS (SELECT source, sum(coalesce(length(text), 0)) AS n FROM documents WHERE source IN (SELECT source FROM mix_targets) GROUP BY 1)
        SELECT m.source FROM mix_targets m LEFT JOIN d USING (source) WHERE coalesce(n, 0) * max_repeats < target_share * (SELECT sum(n) FROM d)""",
    "p4_found": """
        SELECT 'page' AS item_kind, id AS item_id FROM pages WHERE ceil(length(compiled_truth) / 4.0) > 512
        UNION ALL
        SELECT 'chunk' AS item_kind, id AS item_id FROM content_chunks WHERE ceil(length(chunk_text) / 4.0) > 512
    """,
}
