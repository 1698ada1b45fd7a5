"""DuckDB statements that give the same rows as the registered queries."""

from loregraph.functions.expressions import ACCENTED, PLAIN, RECENCY, RECENCY_DEFAULT, SOURCE_FACTORS

AS_OF = "TIMESTAMP '2025-06-01 00:00:00'"
_LIVE = "SELECT * FROM pages WHERE deleted_at IS NULL"
_DEGREES = "SELECT id, count(*) AS degree FROM (SELECT from_page_id AS id FROM links UNION ALL SELECT to_page_id FROM links) GROUP BY id"
def _by_prefix(table: dict, default: float, col: str = "slug") -> str:
    """The longest matching prefix decides."""
    cases = " ".join(f"WHEN starts_with({col}, '{p}') THEN {float(v)}" for p, v in sorted(table.items(), key=lambda x: -len(x[0])))
    return f"CASE {cases} ELSE {float(default)} END::DOUBLE"


_FACTOR = _by_prefix(SOURCE_FACTORS, 1.0)
_HALF = _by_prefix({p: v[0] for p, v in RECENCY.items()}, RECENCY_DEFAULT[0])
_COEF = _by_prefix({p: v[1] for p, v in RECENCY.items()}, RECENCY_DEFAULT[1])


def _recency(days: str) -> str:
    return f"CASE WHEN {_HALF} = 0 OR {_COEF} = 0 THEN 0.0 ELSE {_COEF} * {_HALF} / ({_HALF} + greatest({days}, 0.0)) END"


def _age(col: str, as_of: str = AS_OF) -> str:
    return f"((epoch_us({as_of}) - epoch_us({col})) / 86400e6)"


_CLAIMS = """SELECT o_orderkey AS id, o_orderpriority AS domain, o_custkey % 7 AS holder, (o_orderkey % 101) / 100.0::DOUBLE AS weight,
    CASE WHEN o_orderstatus = 'F' THEN 'correct' WHEN o_orderstatus = 'O' THEN 'incorrect' ELSE 'partial' END AS quality FROM orders"""
_HIT = "CASE WHEN quality = 'correct' THEN 1.0::DOUBLE WHEN quality = 'incorrect' THEN 0.0::DOUBLE END"


def _scorecard(by: str) -> str:
    return f"""WITH c AS ({_CLAIMS}), h AS (SELECT *, {_HIT} AS hit FROM c)
    SELECT {by}, count(*) AS total, count(*) FILTER (quality = 'correct') AS correct, count(*) FILTER (quality = 'incorrect') AS incorrect, count(*) FILTER (quality = 'partial') AS "partial",
    round(avg((weight - hit) * (weight - hit)), 6) AS brier, round(avg(hit), 6) AS accuracy, round(count(*) FILTER (quality = 'partial')::DOUBLE / count(*), 6) AS partial_rate FROM h GROUP BY {by}"""


_WORDS = "list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
_KW = f"""qs(query_id, query) AS (VALUES (1, 'retrieval quality'), (2, 'citation check'), (3, 'board freeze'), (4, 'zebra')),
    terms AS (SELECT DISTINCT query_id, unnest({_WORDS.format("query")}) AS term FROM qs),
    post AS (SELECT id AS chunk_id, unnest({_WORDS.format("chunk_text")}) AS term FROM content_chunks),
    tf AS (SELECT chunk_id, term, count(*) AS tf FROM post WHERE term IN (SELECT term FROM terms) GROUP BY ALL),
    hits AS (SELECT query_id, chunk_id, sum(1 + ln(tf)) AS score FROM tf JOIN terms USING (term) GROUP BY ALL HAVING count(*) = (SELECT count(*) FROM terms t WHERE t.query_id = terms.query_id))"""
_KW = _KW.replace("FROM tf JOIN terms USING (term) GROUP BY ALL HAVING count(*) = (SELECT count(*) FROM terms t WHERE t.query_id = terms.query_id)", "FROM tf JOIN terms USING (term) JOIN (SELECT query_id, count(*) AS need FROM terms GROUP BY 1) USING (query_id) GROUP BY query_id, chunk_id, need HAVING count(*) = need")


def _pool(k: int, pages: str = "pages") -> str:
    return f"""scored AS (SELECT query_id, chunk_id, page_id, round(score * {_FACTOR}, 6) AS score FROM hits JOIN (SELECT id AS chunk_id, page_id FROM content_chunks) USING (chunk_id) JOIN (SELECT id AS page_id, slug FROM {pages}) USING (page_id)),
    best AS (SELECT *, row_number() OVER (PARTITION BY query_id, page_id ORDER BY score DESC, chunk_id) AS rp FROM scored),
    pooled AS (SELECT query_id, page_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, page_id, chunk_id) AS "rank" FROM best WHERE rp = 1 QUALIFY "rank" <= {k})"""


_VISIBLE = """(SELECT * FROM pages WHERE deleted_at IS NULL AND json_extract(frontmatter, '$.quarantine') IS NULL AND NOT starts_with(slug, 'test/') AND NOT starts_with(slug, 'attachments/')
    AND NOT starts_with(slug, '.raw/') AND source_id NOT IN (SELECT id FROM sources WHERE archived))"""
_TAGS = "SELECT DISTINCT id AS page_id, unnest(from_json(json_extract(frontmatter, '$.tags'), '[\"VARCHAR\"]')) AS tag FROM pages WHERE json_extract(frontmatter, '$.tags') IS NOT NULL"
_SEEDS = "SELECT id FROM pages WHERE id % 20 = 0"
_COS = "(list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))))"

_SLUG = f"regexp_replace(regexp_replace(translate(lower({{0}}), '{ACCENTED}', '{PLAIN}'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"

ORACLES: dict[str, str] = {
    "list_pages": f"SELECT id, slug, type FROM ({_LIVE}) ORDER BY updated_at DESC NULLS LAST, id LIMIT 100",
    "list_pages_filtered": f"SELECT id, slug FROM ({_LIVE}) WHERE type = 'meeting' AND starts_with(slug, 'meetings/') AND updated_at > TIMESTAMP '2022-01-01' ORDER BY slug, id LIMIT 50 OFFSET 5",
    "list_pages_by_tag": f"SELECT id, slug FROM ({_LIVE}) WHERE list_contains(from_json(json_extract(frontmatter, '$.tags'), '[\"VARCHAR\"]'), 'wedding') ORDER BY created_at DESC, id LIMIT 1000",
    "visible_pages": f"SELECT id, slug FROM {_VISIBLE}",
    "page_tags": _TAGS,
    "upsert_pages": "SELECT id, CASE WHEN type = 'daily' THEN upper(title) ELSE title END AS title, import_filename FROM pages",
    "duplicate_pages": f"SELECT content_hash, count(*) AS copies, min(id) AS first_id FROM ({_LIVE}) WHERE content_hash IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "purge_deleted_pages": "SELECT id FROM pages WHERE deleted_at IS NULL OR deleted_at >= TIMESTAMP '2024-06-01' - INTERVAL 72 HOUR",
    "newest_chunks": "SELECT id, page_id, chunk_index FROM content_chunks QUALIFY row_number() OVER (PARTITION BY page_id, chunk_index ORDER BY embedded_at DESC NULLS LAST, id DESC) = 1",
    "stale_chunks": "SELECT count(*) AS n, sum(length(chunk_text)) AS chars FROM content_chunks WHERE embedding IS NULL OR model IS DISTINCT FROM 'embed-v2'",
    "stale_chunk_page": "SELECT id, page_id, chunk_index FROM content_chunks WHERE (embedding IS NULL OR model IS DISTINCT FROM 'embed-v2') AND (page_id, chunk_index) > (10, 0) ORDER BY page_id, chunk_index, id LIMIT 200",
    "timeline_dedup": "SELECT min(id) AS id, page_id, summary FROM timeline_entries GROUP BY page_id, date, summary, source",
    "timeline_range": "SELECT id, page_id, summary FROM timeline_entries WHERE page_id = 1 AND date BETWEEN DATE '2021-01-01' AND DATE '2024-12-31' ORDER BY date DESC, id LIMIT 100",
    "effective_dates": "SELECT source_id, slug, strftime(coalesce(effective_date, updated_at, created_at), '%Y-%m-%d') AS day FROM pages",
    "content_sanity": """SELECT id, strlen(compiled_truth) AS bytes, CASE WHEN strlen(compiled_truth) > 500000 THEN 'oversize'
        WHEN regexp_matches(lower(concat_ws(' ', title, substr(compiled_truth, 1, 2048))), 'access denied|attention required|just a moment\\.\\.\\.|enable javascript|404 not found|captcha') THEN 'junk'
        WHEN strlen(compiled_truth) > 50000 AND 1 - length(regexp_replace(regexp_replace(regexp_replace(regexp_replace(compiled_truth, '(?s)```.*?```', '', 'g'), '<[^<>]*>', '', 'g'), '!?\\[[^\\]]*\\]\\([^)]*\\)|https?://\\S+', '', 'g'), '\\s', '', 'g'))
        / greatest(length(regexp_replace(compiled_truth, '\\s', '', 'g')), 1)::DOUBLE > 0.85 THEN 'markup' WHEN strlen(compiled_truth) > 50000 THEN 'large' ELSE 'ok' END AS verdict FROM pages WHERE compiled_truth IS NOT NULL""",
    "ingest_pages": "SELECT min(id) AS id, source_id, unnest(from_json(pages_updated, '[\"BIGINT\"]')) AS page_id FROM ingest_log GROUP BY source_id, source_type, source_ref, pages_updated",
    "ingest_rollup": "SELECT source_type, strftime(created_at, '%Y-%m') AS month, count(*) AS runs, sum(json_array_length(pages_updated)) AS pages FROM ingest_log GROUP BY 1, 2",
    "corpus_sample": f"SELECT id FROM (SELECT id, md5('11:' || id) AS k FROM ({_LIVE}) ORDER BY k, id LIMIT 50)",
    "brain_stats": f"""SELECT (SELECT count(*) FROM ({_LIVE})) AS page_count, (SELECT count(*) FROM content_chunks) AS chunk_count, (SELECT count(embedding) FROM content_chunks) AS embedded_count,
        (SELECT count(*) FROM links) AS link_count, (SELECT count(*) FROM timeline_entries) AS timeline_count, (SELECT count(*) FROM ({_TAGS})) AS tag_count""",
    "brain_health": f"""WITH a AS (SELECT (SELECT count(*) FROM pages) AS pages, (SELECT count(*) FROM content_chunks) AS chunks, (SELECT count(embedding) FROM content_chunks) AS embedded, (SELECT count(*) FROM links) AS links,
        (SELECT count(DISTINCT page_id) FROM timeline_entries) AS with_timeline, (SELECT count(*) FROM ({_LIVE}) p WHERE NOT EXISTS (SELECT 1 FROM links l JOIN ({_LIVE}) f ON l.from_page_id = f.id WHERE l.to_page_id = p.id)) AS orphans,
        (SELECT count(*) FROM links l WHERE NOT EXISTS (SELECT 1 FROM ({_LIVE}) p WHERE p.id = l.to_page_id)) AS dead)
        SELECT *, floor(35.0 * embedded / greatest(chunks, 1) + 0.5) + floor(25 * least(1.0, links::DOUBLE / greatest(pages, 1)) + 0.5) + floor(15 * least(1.0, with_timeline::DOUBLE / greatest(pages, 1)) + 0.5)
        + floor(15 * (1 - orphans::DOUBLE / greatest(pages, 1)) + 0.5) + floor(10 * (1 - least(1.0, dead::DOUBLE / greatest(links, 1))) + 0.5) AS score FROM a""",
    "orphan_pages": f"SELECT id, slug, source_id FROM ({_LIVE}) p WHERE NOT EXISTS (SELECT 1 FROM links l JOIN ({_LIVE}) f ON l.from_page_id = f.id WHERE l.to_page_id = p.id)",
    "dead_links": f"SELECT id, from_page_id, to_page_id FROM links l WHERE NOT EXISTS (SELECT 1 FROM ({_LIVE}) p WHERE p.id = l.to_page_id)",
    "most_connected": f"SELECT id, degree FROM ({_LIVE}) JOIN ({_DEGREES}) USING (id) WHERE type IN ('person', 'company') ORDER BY degree DESC, id LIMIT 5",
    "backlink_counts": f"SELECT p.id, count(l.id) AS backlinks FROM ({_LIVE}) p LEFT JOIN links l ON l.to_page_id = p.id AND l.link_source IS DISTINCT FROM 'mentions' GROUP BY p.id",
    "link_sources": "SELECT link_source, link_type, count(*) AS n FROM links GROUP BY 1, 2",
    "pages_by_type": "SELECT type, count(*) AS pages FROM pages GROUP BY 1",
    "source_health": f"""SELECT s.id AS source_id, count(p.id) AS pages, coalesce(sum(c.n), 0)::BIGINT AS chunks, coalesce(sum(c.e), 0)::BIGINT AS embedded FROM sources s LEFT JOIN ({_LIVE}) p ON p.source_id = s.id
        LEFT JOIN (SELECT page_id, count(*) AS n, count(embedding) AS e FROM content_chunks GROUP BY 1) c ON c.page_id = p.id GROUP BY s.id""",
    "slug_prefixes": "SELECT split_part(slug, '/', 1) AS prefix, count(*) AS n, count(DISTINCT type) AS types FROM pages WHERE contains(slug, '/') GROUP BY 1 HAVING count(*) >= 5",
    "scorecard": _scorecard("holder").replace("round(avg(hit), 6)", "round(count(*) FILTER (hit = 1) / nullif(count(hit), 0)::DOUBLE, 6)"),
    "domain_scorecards": _scorecard("domain"),
    "conviction_brier": f"""WITH c AS ({_CLAIMS}), h AS (SELECT *, {_HIT} AS hit FROM c), v AS (SELECT *, CASE WHEN hit IS NOT NULL THEN 2 * abs(weight - 0.5) END AS w2 FROM h)
        SELECT domain, round(sum((weight - hit) * (weight - hit) * w2) / sum(w2), 6) AS conviction_brier FROM v GROUP BY domain""",
    "calibration_curve": f"""WITH c AS ({_CLAIMS}) SELECT least(floor(weight::DECIMAL(10,4) / 0.1::DECIMAL(10,4) + 1e-9), 9)::INT AS bin, count(*) AS n, round(avg(CASE WHEN quality = 'correct' THEN 1.0 ELSE 0.0 END), 6) AS observed,
        round(avg(weight), 6) AS predicted FROM c WHERE quality IN ('correct', 'incorrect') GROUP BY 1""",
    "anomalies": """WITH e AS (SELECT concat_ws('/', event_type, user_id % 10) AS cohort, ts::DATE AS d FROM events WHERE ts::DATE BETWEEN DATE '2024-01-29' - 20 AND DATE '2024-01-29'),
        n AS (SELECT cohort, d, count(*) AS n FROM e GROUP BY ALL), days AS (SELECT cohort, unnest(range(1, 21)) AS k FROM (SELECT DISTINCT cohort FROM n)),
        b AS (SELECT cohort, avg(coalesce(n, 0)) AS mean, coalesce(stddev_samp(coalesce(n, 0)), 0) AS sd FROM (SELECT cohort, DATE '2024-01-29' - k::INT AS d FROM days) LEFT JOIN n USING (cohort, d) GROUP BY 1)
        SELECT cohort, n AS count, round(mean, 6) AS mean, round(sd, 6) AS sd FROM n JOIN b USING (cohort) WHERE d = DATE '2024-01-29' AND CASE WHEN sd > 0 THEN n > mean + sd ELSE n > mean + 1 END
        ORDER BY CASE WHEN sd > 0 THEN (n - mean) / sd ELSE n - mean END DESC, cohort LIMIT 20""",
    "emotional_weight": f"""SELECT p.id AS page_id, round(least(coalesce(max(h.hot), 0) + least(coalesce(max(t.n), 0) * 0.1::DOUBLE, 0.3::DOUBLE), 1.0), 6) AS weight FROM pages p
        LEFT JOIN (SELECT DISTINCT page_id, 0.5::DOUBLE AS hot FROM ({_TAGS}) WHERE tag IN ('wedding', 'hiring')) h ON h.page_id = p.id LEFT JOIN (SELECT page_id, count(*) AS n FROM timeline_entries GROUP BY 1) t ON t.page_id = p.id GROUP BY p.id""",
    "recent_salience": f"""SELECT id, round(5 * coalesce(emotional_weight::DOUBLE, 0) + ln(1 + coalesce(n, 0)) + {_recency("age")}, 6) AS score FROM (SELECT *, {_age("updated_at")} AS age FROM ({_LIVE}))
        LEFT JOIN (SELECT page_id, count(DISTINCT (date, summary)) AS n FROM timeline_entries GROUP BY 1) t ON t.page_id = id WHERE age BETWEEN 0 AND 700 ORDER BY score DESC, id LIMIT 50""",
    "enrich_candidates": f"""SELECT id, inbound FROM ({_LIVE}) JOIN (SELECT to_page_id AS id, count(*) AS inbound FROM links GROUP BY 1) USING (id) WHERE coalesce(length(compiled_truth), 0) < 400 ORDER BY inbound DESC, id LIMIT 50""",
    "adjacency_boosts": """WITH r AS (SELECT id, source_id FROM pages) SELECT b.id, count(DISTINCT a.id) AS inbound, count(DISTINCT CASE WHEN a.source_id <> b.source_id THEN a.source_id END) AS foreign_sources
        FROM links l JOIN r a ON l.from_page_id = a.id JOIN r b ON l.to_page_id = b.id WHERE a.id <> b.id GROUP BY b.id""",
    "prefix_sample": f"""SELECT prefix, id, degree FROM (SELECT array_to_string(string_split(slug, '/')[1:2], '/') AS prefix, id, slug, coalesce(degree, 0) AS degree FROM ({_LIVE}) LEFT JOIN ({_DEGREES}) USING (id))
        QUALIFY row_number() OVER (PARTITION BY prefix ORDER BY degree DESC, slug, id) = 1""",
    "fact_regressions": """SELECT event_id AS id, user_id AS entity, event_type AS metric, old, value AS new, round((old - value) / abs(old), 6) AS fall FROM
        (SELECT *, lag(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS old FROM events) WHERE old <> 0 AND (old - value) / abs(old) >= 0.1""",
    "fact_validity": "SELECT event_id AS id, lead(event_id) OVER w AS next_id, lead(ts) OVER w AS valid_until FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)",
    "drift_score": f"""WITH x AS (SELECT label, vec_id, embedding::DOUBLE[] AS e, lag(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM embeddings)
        SELECT label, count(*) AS points, round(greatest(0.0, least(1.0, 1 - avg(list_dot_product(e, p) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(p, p)))))), 6) AS drift FROM x GROUP BY label HAVING count(*) >= 3""",
    "wilson_intervals": f"""WITH c AS (SELECT domain, count(*) FILTER (quality = 'correct')::DOUBLE AS h, count(*)::DOUBLE AS n FROM ({_CLAIMS}) GROUP BY 1)
        SELECT domain, round(CASE WHEN h = 0 THEN 0.0 ELSE (h / n + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt(h / n * (1 - h / n) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n) END, 6) AS low,
        round(CASE WHEN h = n THEN 1.0 ELSE (h / n + 1.96 * 1.96 / (2 * n) + 1.96 * sqrt(h / n * (1 - h / n) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n) END, 6) AS high FROM c""",
    "user_sessions": """WITH a AS (SELECT *, coalesce((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) > 240 * 60000000::BIGINT)::INT, 0) AS new FROM events),
        b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM a)
        SELECT user_id AS entity, session, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM b GROUP BY 1, 2 HAVING count(*) >= 2""",
    "token_budget": """WITH r AS (SELECT page_id, id, row_number() OVER w AS "rank", sum(ceil(length(chunk_text) / 4.0)) OVER (w ROWS UNBOUNDED PRECEDING) AS running FROM content_chunks WINDOW w AS (PARTITION BY page_id ORDER BY chunk_index, id))
        SELECT page_id, id, "rank", running FROM r WHERE running <= 1000""",
    "autocut": """WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice AS s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS "rank" FROM orders),
        g AS (SELECT *, (s - lead(s) OVER (PARTITION BY o_custkey ORDER BY "rank")) / max(s) OVER (PARTITION BY o_custkey) AS gap FROM r),
        m AS (SELECT o_custkey, max(gap) AS most FROM g GROUP BY 1), c AS (SELECT o_custkey, min("rank") AS cut FROM g JOIN m USING (o_custkey) WHERE gap = most GROUP BY 1)
        SELECT g.o_custkey, o_orderkey, "rank" FROM g JOIN m USING (o_custkey) LEFT JOIN c USING (o_custkey) WHERE coalesce(most, 0) < 0.2 OR "rank" <= cut""",
    "ir_metrics": """WITH r AS (SELECT o_custkey AS query, o_orderkey AS doc, o_orderpriority LIKE '1%' AS rel, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders),
        a AS (SELECT query, count(*) FILTER (rel) AS n, count(*) FILTER (rel AND k <= 5) AS h, min(k) FILTER (rel AND k <= 5) AS first, sum(1 / log2(k + 1)) FILTER (rel AND k <= 5) AS dcg FROM r GROUP BY query HAVING count(*) FILTER (rel) > 0)
        SELECT query, coalesce(first = 1, false) AS top1, round(h / 5.0, 6) AS p_at_k, round(h / n::DOUBLE, 6) AS r_at_k, round(coalesce(1.0 / first, 0), 6) AS rr, round(coalesce(dcg, 0) / list_sum(list_transform(range(1, least(n, 5) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg FROM a""",
    "score_distribution": """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
        SELECT event_type, count(*) AS n, """ + ", ".join(f"max(value) FILTER (i = floor((n - 1) * {s}::DOUBLE + 0.5)) AS {c}" for c, s in (("least", 0.0), ("p25", 0.25), ("p50", 0.5), ("p75", 0.75), ("p95", 0.95), ("most", 1.0))) + " FROM r GROUP BY 1",
    "duration_percentiles": "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1",
    "daily_rollup": "SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, round(sum(value), 4) AS total, min(value) AS least, max(value) AS most FROM events GROUP BY 1, 2",
    "replay_metrics": """WITH n AS (SELECT user_id, ts < TIMESTAMP '2024-01-16' AS first, event_type, count(*) AS n FROM events GROUP BY ALL),
        t AS (SELECT *, row_number() OVER (PARTITION BY user_id, first ORDER BY n DESC, event_type) AS r FROM n QUALIFY r <= 3), s AS (SELECT user_id, first, list(event_type) AS s, min_by(event_type, r) AS t FROM t GROUP BY 1, 2)
        SELECT count(*) AS n, round(avg(len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s)))::DOUBLE), 6) AS jaccard, round(avg((a.t = b.t)::INT::DOUBLE), 6) AS top1 FROM s a JOIN s b ON a.user_id = b.user_id AND a.first AND NOT b.first""",
    "expert_finder": """WITH o AS (SELECT o_custkey AS id, count(*) AS raw, max(o_orderdate) AS last FROM orders WHERE o_orderpriority LIKE '1%' GROUP BY 1)
        SELECT id, round(ln(1 + raw) * greatest(0.1, exp(-date_diff('day', last::DATE, DATE '2001-12-31') / 180.0)) * (0.5 + 0.5 * (s / (1 + s))), 6) AS score FROM o JOIN (SELECT c_custkey AS id, greatest(c_acctbal, 0) / 1000 AS s FROM customer) USING (id) ORDER BY score DESC, id LIMIT 20""",
    "fact_confidence": f"""SELECT event_id, round(least(abs(value) / 100, 1.0) * exp(-greatest({_age("ts", "TIMESTAMP '2024-02-01'")}, 0) / CASE event_type WHEN 'error' THEN 7.0 WHEN 'click' THEN 90.0 ELSE 365.0 END), 6) AS confidence FROM events""",
    "keyword_chunks": f"""WITH {_KW} SELECT query_id, chunk_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, chunk_id) AS "rank" FROM hits QUALIFY "rank" <= 20""",
    "keyword_pages": f"""WITH {_KW}, {_pool(20)} SELECT * FROM pooled""",
    "hybrid_search_keyword": f"""WITH {_KW}, {_pool(50, _VISIBLE)}, c AS (SELECT pooled.*, ceil(length(chunk_text) / 4.0) AS cost FROM pooled JOIN content_chunks ON id = chunk_id),
        r AS (SELECT query_id, page_id, chunk_id, score, "rank", sum(cost) OVER (PARTITION BY query_id ORDER BY "rank" ROWS UNBOUNDED PRECEDING) AS running FROM c) SELECT * FROM r WHERE running <= 4000""",
    "substring_search": """SELECT query_id, id, ((length(compiled_truth) - length(replace(compiled_truth, query, ''))) / length(query))::INT AS score FROM pages JOIN (VALUES (1, 'Größere'), (2, 'réunion')) q(query_id, query) ON contains(compiled_truth, query)""",
    "vector_search": f"""WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT b.id AS query_id, a.id AS chunk_id, round({_COS}, 6) AS score FROM v a, v b WHERE b.id % 20 = 0)
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS "rank" FROM s QUALIFY "rank" <= 10""",
    "rank_fusion": """WITH a AS (SELECT o_custkey AS query_id, o_orderkey AS doc, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS r2 FROM orders),
        s AS (SELECT query_id, doc, CASE WHEN r <= 10 THEN 1 / (60.0::DOUBLE + r - 1) ELSE 0 END + CASE WHEN r2 <= 10 THEN 1 / (120.0::DOUBLE + r2 - 1) ELSE 0 END AS s FROM a WHERE r <= 10 OR r2 <= 10)
        SELECT query_id, doc, round(s / max(s) OVER (PARTITION BY query_id), 6) AS score FROM s""",
    "boosted_scores": f"""WITH n AS (SELECT to_page_id AS id, count(*) AS n FROM links WHERE link_source IS DISTINCT FROM 'mentions' GROUP BY 1)
        SELECT id, round({_FACTOR} * (1 + 0.05 * ln(1 + coalesce(n, 0))) * (1 + {_recency(_age("coalesce(effective_date, updated_at, created_at)"))}), 6) AS score FROM ({_LIVE}) LEFT JOIN n USING (id)""",
    "title_matches": f"""WITH q(query_id, query) AS (VALUES (1, 'retrieval quality'), (2, 'weekly review log'), (3, 'runway')), p AS (SELECT id, array_to_string({_WORDS.format("title")}, ' ') AS t FROM pages)
        SELECT query_id, id FROM p JOIN q ON t = query OR (contains(query, ' ') AND contains(' ' || t || ' ', ' ' || query || ' '))""",
    "result_dedup": """WITH r AS (SELECT l_suppkey AS query_id, l_partkey AS page_id, l_orderkey * 10 + l_linenumber AS chunk_id, l_returnflag AS type, l_extendedprice AS score FROM lineitem),
        a AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY query_id, page_id ORDER BY score DESC, chunk_id) <= 3), b AS (SELECT *, ceil(count(*) OVER (PARTITION BY query_id) * 0.6::DOUBLE) AS most FROM a),
        c AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY query_id, type ORDER BY score DESC, page_id, chunk_id) <= most)
        SELECT query_id, page_id, chunk_id FROM c QUALIFY row_number() OVER (PARTITION BY query_id, page_id ORDER BY score DESC, chunk_id) <= 2""",
    "similar_titles": f"""WITH t AS (SELECT type, lower(title) AS t, min(id) AS id FROM pages WHERE title IS NOT NULL GROUP BY 1, 2),
        g AS (SELECT type, id, list_distinct(flatten(list_transform({_WORDS.format("t")}, lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))) AS g FROM t),
        s AS (SELECT a.id AS a, b.id AS b, round(len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g)))::DOUBLE, 6) AS similarity FROM g a JOIN g b ON a.type = b.type AND a.id < b.id) SELECT * FROM s WHERE similarity >= 0.7""",
    "fanout_inbound": f"""WITH e AS (SELECT DISTINCT to_page_id AS src, from_page_id AS nxt, link_type FROM links WHERE link_source IS DISTINCT FROM 'mentions')
        SELECT src AS seed, nxt AS node, 1 AS hop, count(DISTINCT link_type) AS types FROM e WHERE src IN ({_SEEDS}) AND nxt <> src GROUP BY 1, 2""",
    "fanout": f"""WITH e AS (SELECT DISTINCT from_page_id AS src, to_page_id AS nxt, link_type FROM links WHERE link_source IS DISTINCT FROM 'mentions'),
        h1 AS (SELECT src AS seed, nxt AS node, 1 AS hop, count(DISTINCT link_type) AS types FROM e WHERE src IN ({_SEEDS}) AND nxt <> src GROUP BY 1, 2),
        h2 AS (SELECT seed, nxt AS node, 2 AS hop, count(DISTINCT link_type) AS types FROM h1 JOIN e ON h1.node = e.src WHERE nxt <> seed AND NOT EXISTS (SELECT 1 FROM h1 x WHERE x.seed = h1.seed AND x.node = nxt) GROUP BY 1, 2)
        SELECT * FROM h1 UNION ALL SELECT * FROM h2""",
    "walk_edges": f"""WITH e AS (SELECT DISTINCT from_page_id, to_page_id, link_type FROM links), w1 AS (SELECT from_page_id AS seed, from_page_id, to_page_id, link_type, 1 AS depth FROM e WHERE from_page_id IN ({_SEEDS})),
        f AS (SELECT DISTINCT seed, to_page_id AS node FROM w1 WHERE to_page_id <> seed) SELECT * FROM w1 UNION ALL SELECT seed, from_page_id, to_page_id, link_type, 2 FROM f JOIN e ON node = from_page_id""",
    "connects": """WITH RECURSIVE e AS (SELECT DISTINCT from_page_id AS a, to_page_id AS b FROM links WHERE link_source IS DISTINCT FROM 'mentions' UNION SELECT to_page_id, from_page_id FROM links WHERE link_source IS DISTINCT FROM 'mentions'),
        w AS (SELECT s AS seed, s AS node, 0 AS hop FROM (VALUES (3), (7)) t(s) UNION SELECT seed, b, hop + 1 FROM w JOIN e ON node = a WHERE hop < 2), m AS (SELECT seed, node, min(hop) AS hop FROM w GROUP BY 1, 2 HAVING min(hop) > 0)
        SELECT x.node, x.hop + y.hop AS hops FROM m x JOIN m y ON x.node = y.node AND x.seed = 3 AND y.seed = 7""",
    "connected_components": """WITH RECURSIVE e AS (SELECT from_page_id AS a, to_page_id AS b FROM links UNION SELECT to_page_id, from_page_id FROM links),
        w AS (SELECT a AS page_id, a AS m FROM e UNION SELECT e.b, w.m FROM w JOIN e ON w.page_id = e.a) SELECT page_id, min(m) AS component FROM w GROUP BY 1""",
    "slugs_of_titles": f"SELECT id, {_SLUG.format('title')} AS slug FROM pages",
    "headings": r"""WITH l AS (SELECT id, unnest(x) AS l, unnest(range(1, len(x) + 1)) AS line_no FROM (SELECT id, regexp_split_to_array(compiled_truth, '\r?\n') AS x FROM pages))
        SELECT id, line_no, length(regexp_extract(l, '^(#+)', 1)) AS level, trim(regexp_replace(l, '^#+ ', '')) AS heading FROM l WHERE regexp_matches(l, '^#{1,6} \S')""",
    "timeline_lines": r"""WITH l AS (SELECT id, unnest(regexp_split_to_array(timeline, '\r?\n')) AS l FROM pages WHERE timeline IS NOT NULL)
        SELECT id, regexp_extract(l, '^\s*-?\s*\*\*(\d{4}-\d{2}-\d{2})\*\*\s*[|–—-]\s*(.*)$', 1) AS day, trim(regexp_extract(l, '^\s*-?\s*\*\*(\d{4}-\d{2}-\d{2})\*\*\s*[|–—-]\s*(.*)$', 2)) AS summary
        FROM l WHERE try_strptime(regexp_extract(l, '^\s*-?\s*\*\*(\d{4}-\d{2}-\d{2})\*\*\s*[|–—-]\s*(.*)$', 1), '%Y-%m-%d') IS NOT NULL""",
    "transcript_lines": r"""WITH l AS (SELECT id, unnest(x) AS l, unnest(range(1, len(x) + 1)) AS line_no FROM (SELECT id, regexp_split_to_array(compiled_truth, '\r?\n') AS x FROM pages)),
        m AS (SELECT *, regexp_matches(l, '^\*\*([^*]+)\*\* \((\d{1,2}:\d{2})\): (.*)$') AS a FROM l WHERE regexp_matches(l, '^\*\*([^*]+)\*\* \((\d{1,2}:\d{2})\): (.*)$') OR regexp_matches(l, '^\[(\d{1,2}:\d{2})\] ([^:]{1,60}): (.*)$'))
        SELECT id, line_no, CASE WHEN a THEN regexp_extract(l, '^\*\*([^*]+)\*\* \((\d{1,2}:\d{2})\): (.*)$', 1) ELSE regexp_extract(l, '^\[(\d{1,2}:\d{2})\] ([^:]{1,60}): (.*)$', 2) END AS speaker,
        CASE WHEN a THEN regexp_extract(l, '^\*\*([^*]+)\*\* \((\d{1,2}:\d{2})\): (.*)$', 2) ELSE regexp_extract(l, '^\[(\d{1,2}:\d{2})\] ([^:]{1,60}): (.*)$', 1) END AS "at",
        CASE WHEN a THEN regexp_extract(l, '^\*\*([^*]+)\*\* \((\d{1,2}:\d{2})\): (.*)$', 3) ELSE regexp_extract(l, '^\[(\d{1,2}:\d{2})\] ([^:]{1,60}): (.*)$', 3) END AS message FROM m""",
    "title_mentions": f"""WITH w AS (SELECT id, source_id, {_WORDS.format("compiled_truth")} AS w FROM pages), pos AS (SELECT id, source_id, unnest(w) AS first, unnest(range(1, len(w) + 1)) AS p FROM w),
        n AS (SELECT DISTINCT array_to_string({_WORDS.format("title")}, ' ') AS run, ({_WORDS.format("title")})[1] AS first, len({_WORDS.format("title")}) AS k, id AS entity, source_id FROM pages WHERE length(title) >= 4),
        c AS (SELECT pos.id, p, k, entity, run FROM pos JOIN n ON pos.first = n.first AND pos.source_id = n.source_id), h AS (SELECT c.id, p, k, entity FROM c JOIN w USING (id) WHERE p + k - 1 <= len(w) AND array_to_string(w[p:p + k - 1], ' ') = run)
        SELECT DISTINCT id, entity FROM (SELECT *, max(k) OVER (PARTITION BY id, p) AS most FROM h) WHERE k = most AND id <> entity""",
    "context_link_types": r"""SELECT CASE WHEN regexp_matches(lower(context), '\b(founded|founder|co-founded|started)\b') THEN 'founded' WHEN regexp_matches(lower(context), '\b(invested|investor|backed|led the round)\b') THEN 'invested_in'
        WHEN regexp_matches(lower(context), '\b(advises|adviser|advisor|mentor)\b') THEN 'advises' WHEN regexp_matches(lower(context), '\b(works at|engineer|joined|employee|head of)\b') THEN 'works_at' ELSE 'mentions' END AS inferred, count(*) AS n FROM links GROUP BY 1""",
    "markdown_round_trip": "SELECT id, true AS same FROM pages",
    "money_totals": r"""WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '[$€£]([0-9][0-9,]*(?:\.[0-9]+)?)', 1)) AS a FROM documents) SELECT doc_id, sum(replace(a, ',', '')::DOUBLE) AS total FROM m GROUP BY 1 HAVING total > 0""",
    "facts_by_entity": """SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS "rank" FROM events QUALIFY "rank" <= 3""",
    "facts_health": """SELECT count(*) AS total, count(*) FILTER (h >= 0 AND h < 24) AS last_day, count(*) FILTER (h >= 0 AND h < 168) AS last_week, count(DISTINCT user_id) AS entities
        FROM (SELECT *, (epoch_us(TIMESTAMP '2024-01-30') - epoch_us(ts)) / 3600e6 AS h FROM events)""",
    "superseded_facts": """SELECT event_id AS id, user_id, value, event_type = 'error' AS expired, CASE WHEN event_type = 'error' THEN event_id + 1000000 END AS superseded_by FROM events
        UNION ALL SELECT event_id + 1000000, user_id, value * 2, false, NULL FROM events WHERE event_type = 'error'""",
    "fact_duplicates": f"""WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT b.vec_id AS new_id, a.vec_id AS id, round({_COS}, 6) AS similarity FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE b.vec_id % 20 = 0)
        SELECT *, row_number() OVER (PARTITION BY new_id ORDER BY similarity DESC, id) AS "rank", similarity >= 0.5 AS duplicate FROM s QUALIFY "rank" <= 3""",
    "upserted_takes": f"""SELECT id % 500 AS page_id, id // 500 AS row_num, round(CASE WHEN quality = 'partial' THEN least(greatest(weight * 3 - 1, 0), 1) ELSE weight END, 6) AS weight,
        CASE WHEN quality <> 'partial' THEN quality END AS quality FROM ({_CLAIMS})""",
    "telemetry_stats": "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most, count(DISTINCT ts::DATE) AS days FROM events GROUP BY 1",
    "tier_pairs": f"""WITH p AS (SELECT id, CASE WHEN {_FACTOR} > 1.05 THEN 'curated' WHEN {_FACTOR} < 0.95 THEN 'bulk' ELSE 'other' END AS tier FROM pages)
        SELECT least(a.tier, b.tier) AS tier_a, greatest(a.tier, b.tier) AS tier_b, count(*) AS n FROM links l JOIN p a ON l.from_page_id = a.id JOIN p b ON l.to_page_id = b.id GROUP BY 1, 2""",
    "job_stats": "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS mean_price, strftime(max(o_orderdate), '%Y-%m-%d') AS last FROM orders GROUP BY 1, 2",
    "quarter_windows": "SELECT year(o_orderdate)::VARCHAR || 'Q' || quarter(o_orderdate)::VARCHAR AS quarter, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1",
    "result_pairs": """WITH r AS (SELECT o_custkey AS query_id, o_orderkey AS doc, o_orderstatus AS s, o_totalprice AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders QUALIFY r <= 5)
        SELECT a.query_id, a.doc AS doc_a, b.doc AS doc_b, round(a.p + b.p, 2) AS combined FROM r a JOIN r b ON a.query_id = b.query_id AND a.r < b.r AND a.s <> b.s""",
    "edge_union": "SELECT from_page_id, CASE WHEN link_source IS NULL THEN 'unresolved' ELSE 'resolved' END AS state, count(*) AS n, count(DISTINCT to_page_id) AS targets FROM links GROUP BY 1, 2",
    "page_link_coverage": f"""SELECT type, count(*) AS n, round(avg(h), 6) AS share, round(sqrt(avg(h) * (1 - avg(h)) / count(*)), 6) AS error FROM (SELECT type, (id IN (SELECT to_page_id FROM links))::INT::DOUBLE AS h FROM ({_LIVE})) GROUP BY 1""",
    "chunk_page_context": """SELECT c.id, p.slug, coalesce(t.newest > p.updated_at::DATE, false) AS stale FROM content_chunks c JOIN pages p ON c.page_id = p.id LEFT JOIN (SELECT page_id, max(date) AS newest FROM timeline_entries GROUP BY 1) t ON t.page_id = p.id""",
    "frontmatter_stats": """SELECT source_id, count(*) AS pages, count(*) FILTER (frontmatter = '{}') AS bare, count(*) FILTER (json_extract(frontmatter, '$.title') IS NOT NULL) AS titled, count(*) FILTER (json_extract(frontmatter, '$.tags') IS NOT NULL) AS tagged FROM pages GROUP BY 1""",
}
ORACLES["retrieval_gate"] = f"SELECT count(*) AS queries, round(avg(r_at_k), 6) AS recall, round(avg(rr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg, round(avg(top1::INT::DOUBLE), 6) AS top1, round(avg(r_at_k), 6) >= 0.7 AND round(avg(rr), 6) >= 0.6 AND round(avg(top1::INT::DOUBLE), 6) >= 0.5 AS passed FROM ({ORACLES['ir_metrics']})"

_G = "list_distinct(flatten(list_transform({0}, lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
ORACLES |= {
    "resolved_names": f"""WITH n AS (SELECT name, {_SLUG.format("name")} AS s, {_G.format(_WORDS.format("name"))} AS g FROM (VALUES ('Retrieval quality notes'), ('Weekly review'), ('Obsidian Weather Board'), ('release rhythm draft'), ('Runway')) v(name)),
        p AS (SELECT id, slug, split_part(slug, '/', -1) AS tail, {_G.format(_WORDS.format("title"))} AS g FROM ({_LIVE})),
        e AS (SELECT name, min(slug) AS x FROM n JOIN p ON tail = s GROUP BY 1), f AS (SELECT name, slug AS x FROM (SELECT name, slug, round(len(list_intersect(n.g, p.g)) / len(list_distinct(list_concat(n.g, p.g)))::DOUBLE, 12) AS sim FROM n, p)
        WHERE sim >= 0.4 QUALIFY row_number() OVER (PARTITION BY name ORDER BY round(sim, 6) DESC, slug) = 1),
        d AS (SELECT to_page_id AS id, count(*) AS deg FROM links GROUP BY 1), r AS (SELECT name, slug AS x FROM n JOIN p ON starts_with(tail, s || '-') LEFT JOIN d USING (id) QUALIFY row_number() OVER (PARTITION BY name ORDER BY coalesce(deg, 0) DESC, slug) = 1)
        SELECT n.name, coalesce(e.x, f.x, r.x, n.s) AS slug, CASE WHEN e.x IS NOT NULL THEN 'exact' WHEN f.x IS NOT NULL THEN 'fuzzy' WHEN r.x IS NOT NULL THEN 'prefix' ELSE 'new' END AS how FROM n LEFT JOIN e USING (name) LEFT JOIN f USING (name) LEFT JOIN r USING (name)""",
    "query_intents": r"""SELECT item_id, CASE WHEN regexp_matches(lower(question), '\b(when|yesterday|today|last (week|month|year)|recent|latest|since|20\d\d)\b') THEN 'temporal'
        WHEN regexp_matches(lower(question), '\b(who|whom|person|founder|ceo|works? at|invested)\b') THEN 'entity' WHEN regexp_matches(lower(question), '\b(meeting|call|launch|offsite|event|met)\b') THEN 'event' ELSE 'general' END AS intent FROM eval_items""",
    "far_set": f"""WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), c AS (SELECT * FROM v WHERE label < 3 AND vec_id % 20 = 0)
        SELECT a.vec_id AS id, a.label, round(1 - max({_COS}), 6) AS distance FROM v a, c b WHERE a.label NOT IN (SELECT label FROM c) GROUP BY 1, 2 ORDER BY distance DESC, id LIMIT 25""",
    "adaptive_returns": """SELECT o_custkey AS query_id, o_orderkey AS doc, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS "rank" FROM orders QUALIFY "rank" <= CASE WHEN o_custkey % 2 = 0 THEN 2 ELSE 6 END""",
    "timeline_by_month": """WITH t AS (SELECT * FROM timeline_entries QUALIFY row_number() OVER (PARTITION BY page_id, date, summary, source ORDER BY id) = 1)
        SELECT source, strftime(date, '%Y-%m') AS month, count(*) AS n, count(*) FILTER (date_diff('day', date, created_at::DATE) > 90) AS late FROM t GROUP BY 1, 2""",
    "events_as_of_orders": """SELECT event_id, purchase_id FROM (SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS purchase_id FROM events)
        WHERE purchase_id IS NOT NULL""",
    "near_link_types": """WITH l AS (SELECT DISTINCT from_page_id, to_page_id, link_type FROM links WHERE link_type <> '') SELECT a.link_type, b.link_type AS other, count(*) AS n FROM l a JOIN l b USING (from_page_id, to_page_id) WHERE a.link_type < b.link_type GROUP BY 1, 2""",
    "reciprocal_links": "SELECT from_page_id, to_page_id FROM links WHERE from_page_id < to_page_id INTERSECT SELECT to_page_id, from_page_id FROM links",
}

ORACLES |= {
    "cosine_rescored": f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), f AS (SELECT b.vec_id AS query_id, a.vec_id AS chunk_id, {_COS} AS c FROM v a, v b WHERE b.vec_id % 20 = 0),
        r AS (SELECT *, 1 / (60.0::DOUBLE + row_number() OVER (PARTITION BY query_id ORDER BY round(c, 6) DESC, chunk_id)) AS s FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(c, 6) DESC, chunk_id) <= 50)
        SELECT query_id, chunk_id, round(0.7 * s / max(s) OVER (PARTITION BY query_id) + 0.3 * c, 6) AS score FROM r""",
    "exact_matches": f"""WITH q AS (SELECT * FROM (VALUES (-1, 'Runway log'), (-2, 'notes'), (-3, 'weekly review digest'), (-4, '2023')) v(query_id, query) UNION ALL SELECT id, title FROM ({_LIVE}) WHERE id % 20 = 0 AND title IS NOT NULL),
        m AS (SELECT query_id, id, CASE WHEN lower(trim(title)) = lower(trim(query)) OR split_part(slug, '/', -1) = s THEN 1.25 WHEN ends_with(split_part(slug, '/', -1), '-' || s) THEN 1.1 END AS factor FROM ({_LIVE}), (SELECT *, {_SLUG.format("query")} AS s FROM q))
        SELECT * FROM m WHERE factor IS NOT NULL""",
    "graph_signals": """WITH r AS (SELECT id, source_id, slug, type, emotional_weight::DOUBLE AS s FROM pages),
        a AS (SELECT b.id, count(DISTINCT a.id) AS i, count(DISTINCT CASE WHEN a.source_id <> b.source_id THEN a.source_id END) AS f FROM links l JOIN r a ON l.from_page_id = a.id JOIN r b ON l.to_page_id = b.id WHERE a.id <> b.id GROUP BY b.id),
        h AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY s DESC, id) <= 20 AS head FROM r),
        u AS (SELECT id, slug, type, head, CASE WHEN head THEN s * CASE WHEN coalesce(i, 0) >= 2 THEN 1.05 ELSE 1.0 END::DOUBLE * CASE WHEN coalesce(f, 0) >= 2 THEN 1.1 ELSE 1.0 END::DOUBLE ELSE s END AS s FROM h LEFT JOIN a USING (id)),
        p AS (SELECT *, regexp_extract(slug, '^(.*)/[^/]*$', 1) AS g FROM u)
        SELECT id AS page_id, round(CASE WHEN head AND g <> '' AND row_number() OVER (PARTITION BY type, g, head ORDER BY s DESC, id) > 1 THEN s * 0.95::DOUBLE ELSE s END, 6) AS score FROM p""",
    "blast_radius": f"""WITH e AS (SELECT DISTINCT to_page_id AS src, from_page_id AS nxt FROM links), h1 AS (SELECT DISTINCT src AS seed, nxt AS node, 1 AS hop FROM e WHERE src IN ({_SEEDS}) AND nxt <> src),
        h2 AS (SELECT DISTINCT seed, nxt AS node, 2 AS hop FROM h1 JOIN e ON h1.node = e.src WHERE nxt <> seed AND NOT EXISTS (SELECT 1 FROM h1 x WHERE x.seed = h1.seed AND x.node = nxt))
        SELECT seed, node, hop, round(1 / (1 + 0.3::DOUBLE * hop), 6) AS confidence FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2)""",
}

_TITLE_FIT = "(t = qt OR (contains(qt, ' ') AND contains(' ' || t || ' ', ' ' || qt || ' ')))"
_TAIL = "split_part(slug, '/', -1)"
ORACLES["hybrid_fused"] = f"""WITH v AS (SELECT id, page_id, embedding::DOUBLE[] AS e FROM content_chunks WHERE model = 'embed-v2' AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    qs AS (SELECT p.id AS query_id, p.title AS query, array_to_string({_WORDS.format("p.title")}, ' ') AS qt, e FROM pages p JOIN (SELECT page_id, min_by(e, id) AS e FROM v GROUP BY 1) x ON x.page_id = p.id WHERE p.id % 20 = 0),
    terms AS (SELECT DISTINCT query_id, unnest({_WORDS.format("query")}) AS term FROM qs), need AS (SELECT query_id, count(*) AS need FROM terms GROUP BY 1),
    post AS (SELECT id AS chunk_id, unnest({_WORDS.format("chunk_text")}) AS term FROM content_chunks), tf AS (SELECT chunk_id, term, count(*) AS tf FROM post WHERE term IN (SELECT term FROM terms) GROUP BY ALL),
    kw AS (SELECT query_id, chunk_id, round(sum(1 + ln(tf)), 6) AS s FROM tf JOIN terms USING (term) JOIN need USING (query_id) GROUP BY query_id, chunk_id, need HAVING count(*) = need),
    kr AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS r FROM kw QUALIFY r <= 100),
    all_v AS (SELECT id, embedding::DOUBLE[] AS e FROM content_chunks WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    vs AS (SELECT b.query_id, a.id AS chunk_id, round({_COS}, 6) AS s FROM all_v a JOIN qs b ON len(a.e) = len(b.e)), vr AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS r FROM vs QUALIFY r <= 100),
    f AS (SELECT query_id, chunk_id, sum(1 / (60.0::DOUBLE + r - 1)) AS rrf FROM (SELECT * FROM kr UNION ALL SELECT * FROM vr) GROUP BY 1, 2), g AS (SELECT *, rrf / max(rrf) OVER (PARTITION BY query_id) AS s0 FROM f),
    n AS (SELECT to_page_id AS page_id, count(*) AS n FROM links WHERE link_source IS DISTINCT FROM 'mentions' GROUP BY 1),
    j AS (SELECT g.query_id, g.chunk_id, c.page_id, p.slug, p.title, array_to_string({_WORDS.format("p.title")}, ' ') AS t, qs.qt, qs.query, coalesce(p.emotional_weight::DOUBLE, 0) AS ew, coalesce(n, 0) AS n, {_age("coalesce(p.effective_date, p.updated_at, p.created_at)")} AS age,
        round(s0 * CASE WHEN c.chunk_source = 'compiled_truth' THEN 2.0::DOUBLE ELSE 1 END * {_FACTOR}, 9) AS s FROM g JOIN content_chunks c ON c.id = g.chunk_id JOIN ({_LIVE}) p ON p.id = c.page_id JOIN qs USING (query_id) LEFT JOIN n ON n.page_id = c.page_id),
    b AS (SELECT *, max(s) OVER (PARTITION BY query_id) AS best, s * (1 + 0.05::DOUBLE * ln(1 + n)) * (1 + 0.15::DOUBLE * ln(1 + ew)) * (1 + 0.5::DOUBLE * {_recency("age")}) * CASE WHEN {_TITLE_FIT} THEN 1.25::DOUBLE ELSE 1 END
        * CASE WHEN lower(trim(title)) = lower(trim(query)) OR {_TAIL} = {_SLUG.format("query")} THEN 1.25::DOUBLE WHEN ends_with({_TAIL}, '-' || {_SLUG.format("query")}) THEN 1.1::DOUBLE ELSE 1 END AS boosted FROM j)
    SELECT query_id, page_id, chunk_id, round(CASE WHEN s >= 0.5 * best THEN boosted ELSE s END, 6) AS score FROM b"""

from loregraph.plans.store import ORACLES as _STORE  # noqa: E402
from loregraph.plans.structure import ORACLES as _STRUCTURE  # noqa: E402

ORACLES |= _STORE | _STRUCTURE

_CUT = _KW.replace("hits AS (SELECT query_id, chunk_id, sum(1 + ln(tf)) AS score", "hits0 AS (SELECT query_id, chunk_id, round(sum(1 + ln(tf)), 6) AS score") + ", hits AS (SELECT * FROM hits0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 100)"
ORACLES["over_fetched_pages"] = f"""WITH {_CUT}, {_pool(20)} SELECT query_id, page_id, chunk_id, "rank" FROM pooled"""

ORACLES["semantic_segments"] = """WITH v AS (SELECT label, vec_id, embedding::DOUBLE[] AS e, lag(embedding::DOUBLE[]) OVER w AS p FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id)),
    c AS (SELECT label, vec_id, list_dot_product(e, p) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(p, p))) AS c FROM v),
    s AS (SELECT label, vec_id, (-3 * coalesce(lag(c, 2) OVER w, c) + 12 * coalesce(lag(c) OVER w, c) + 17 * c + 12 * coalesce(lead(c) OVER w, c) - 3 * coalesce(lead(c, 2) OVER w, c)) / 35 AS s FROM c WINDOW w AS (PARTITION BY label ORDER BY vec_id)),
    q AS (SELECT *, quantile_cont(s, 0.2) OVER (PARTITION BY label) AS low, lag(s) OVER w AS b, lead(s) OVER w AS a FROM s WINDOW w AS (PARTITION BY label ORDER BY vec_id))
    SELECT label, vec_id, sum(coalesce(s <= low AND s <= coalesce(b, 2.0) AND s < coalesce(a, 2.0), false)::INT) OVER (PARTITION BY label ORDER BY vec_id ROWS UNBOUNDED PRECEDING) AS segment FROM q"""

ORACLES["streamed_rate_limit"] = """WITH RECURSIVE e AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
    s AS (SELECT DISTINCT user_id, 0::BIGINT AS k, []::TIMESTAMP[] AS last, NULL::BIGINT AS event_id FROM e
    UNION ALL SELECT user_id, k, CASE WHEN ok THEN list_append(last, ts)[-3:] ELSE last END, CASE WHEN ok THEN event_id END FROM (SELECT s.user_id, e.k, s.last, e.ts, e.event_id, len(s.last) < 3 OR e.ts - s.last[1] >= INTERVAL 24 HOUR AS ok FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1))
    SELECT event_id FROM s WHERE event_id IS NOT NULL"""
ORACLES["consolidated_facts"] = """WITH RECURSIVE u AS (SELECT label, vec_id, embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings WHERE embedding IS NOT NULL AND label IN (SELECT label FROM embeddings GROUP BY 1 HAVING count(*) >= 3)),
    e AS (SELECT label, vec_id, list_transform(v, lambda x: x / n) AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) AS k FROM u),
    s AS (SELECT DISTINCT label, 0::BIGINT AS k, []::BIGINT[] AS ids, []::DOUBLE[][] AS vs, NULL::BIGINT AS id, NULL::BIGINT AS head FROM e
    UNION ALL SELECT label, k, CASE WHEN p IS NULL THEN list_append(ids, vec_id) ELSE ids END, CASE WHEN p IS NULL THEN list_append(vs, v) ELSE vs END, vec_id, coalesce(ids[p], vec_id) FROM
    (SELECT s.label, e.k, s.ids, s.vs, e.vec_id, e.v, nullif(list_position(list_transform(s.vs, lambda h: list_dot_product(h, e.v) >= 0.4), true), 0) AS p FROM s JOIN e ON e.label = s.label AND e.k = s.k + 1))
    SELECT label::VARCHAR AS entity, head, id FROM s WHERE id IS NOT NULL QUALIFY count(*) OVER (PARTITION BY label, head) > 1"""
ORACLES["promoted_takes"] = f"""SELECT entity, head, 'c' || arg_max(id, (id % 10) * 1000000000::BIGINT - id) AS claim, round(avg((id % 10) / 10.0::DOUBLE), 6) AS weight, count(*) AS n FROM ({ORACLES["consolidated_facts"]}) GROUP BY 1, 2"""
