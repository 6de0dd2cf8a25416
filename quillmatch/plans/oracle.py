"""DuckDB SQL for the queries: written on its own terms, sharing no expression with them."""

from __future__ import annotations

NORM = r"trim(regexp_replace(regexp_replace(lower({}), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def knn(corpus: str, asked: str, k: int) -> str:
    """WITH-items that end in ``knn(qid, cid, sim, r)`` from ``corpus(id, t)`` and ``asked(id, t)``."""
    gram = lambda t: f"""SELECT id, substr(pw, k, z) AS g FROM (SELECT id, pw, z, unnest(range(1, lw + 4 - z)) AS k FROM
        (SELECT id, ' ' || w || ' ' AS pw, length(w) AS lw FROM (SELECT id, unnest(string_split(n, ' ')) AS w FROM {t}) WHERE w <> ''), (VALUES (2), (3), (4)) v(z) WHERE z <= lw + 2)"""  # noqa: E731
    return f"""c_ AS (SELECT id, {NORM.format("coalesce(t, '')")} AS n FROM ({corpus})), q_ AS (SELECT id, {NORM.format("coalesce(t, '')")} AS n FROM ({asked})),
    cg AS ({gram("c_")}), qg AS ({gram("q_")}),
    tf AS (SELECT id, g, CAST(count(*) AS DOUBLE) AS tf FROM cg GROUP BY id, g), nn AS (SELECT count(*) AS n FROM c_),
    idf AS (SELECT g, ln((1.0::DOUBLE + max(nn.n)) / (1.0::DOUBLE + count(*))) + 1.0::DOUBLE AS idf FROM tf CROSS JOIN nn GROUP BY g),
    w AS (SELECT tf.id, tf.g, tf.tf * idf.idf AS w FROM tf JOIN idf ON tf.g = idf.g), wn AS (SELECT id, sqrt(sum(w * w)) AS nrm FROM w GROUP BY id),
    qtf AS (SELECT id, g, CAST(count(*) AS DOUBLE) AS tf FROM qg GROUP BY id, g), qw AS (SELECT qtf.id, qtf.g, qtf.tf * idf.idf AS w FROM qtf JOIN idf ON qtf.g = idf.g),
    qn AS (SELECT id, sqrt(sum(w * w)) AS nrm FROM qw GROUP BY id),
    dot AS (SELECT qw.id AS qid, w.id AS cid, sum(qw.w * w.w) AS dp FROM qw JOIN w ON qw.g = w.g GROUP BY qw.id, w.id),
    sc AS (SELECT qid, cid, dp / (qn.nrm * wn.nrm) AS raw FROM dot JOIN qn ON qid = qn.id JOIN wn ON cid = wn.id),
    rk AS (SELECT qid, cid, raw, row_number() OVER (PARTITION BY qid ORDER BY round_even(raw, 6) DESC, cid) AS r FROM sc WHERE raw > 0.1),
    knn AS (SELECT qid, cid, round_even(raw, 3) AS sim, r FROM rk WHERE r <= {k})"""


def named(items: str, suffix: str) -> str:
    """The same WITH-items under names of their own."""
    import re

    for name in ("c_", "q_", "cg", "qg", "tf", "nn", "idf", "w", "wn", "qtf", "qw", "qn", "dot", "sc", "rk", "knn"):
        items = re.sub(rf"\b{name} AS \(", f"{name}{suffix} AS (", items)
        items = re.sub(rf"\b(FROM|JOIN) {name}\b(?! AS \()", rf"\1 {name}{suffix} {name}", items)
    return items


ASKED = "SELECT p_partkey AS id, substr(p_name, 1, length(p_name) - 2) AS t FROM part WHERE p_partkey % 50 = 0"
BRANDED = "SELECT p_partkey AS id, p_name AS t FROM part"
GENERIC = "SELECT p_partkey AS id, p_type || ' ' || p_brand AS t FROM part"
MASTER = f"SELECT p_partkey AS id, {NORM.format('p_name')} AS t FROM part"
PRICES = """mkt AS (SELECT l_partkey, avg(l_extendedprice / l_quantity) AS market FROM lineitem GROUP BY l_partkey),
    m AS (SELECT p_partkey, p_name, p_type, p_brand, coalesce(CAST(CAST(round_even(market, 0) AS BIGINT) AS VARCHAR), '') AS product_price, CAST(CAST(round_even(p_retailprice, 0) AS BIGINT) AS VARCHAR) AS nppa_price,
          CASE WHEN market IS NULL THEN 'missing' WHEN market / p_retailprice > 1 THEN 'overpriced' ELSE 'ok' END AS price_flag FROM part LEFT JOIN mkt ON p_partkey = l_partkey)"""
PRICE = "CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR)"

def looked_up(asked: str) -> str:
    """WITH-items of the lookup for ``asked(id, t)``: ``knn1`` branded, ``knn2`` master, ``knn3`` generics."""
    return f"""{named(knn(BRANDED, asked, 3), "1")}, {named(knn(MASTER, asked, 3), "2")},
    dep AS (SELECT a.id, CASE WHEN p.p_partkey IS NOT NULL AND p.p_type <> '' THEN trim(p.p_type || ' ' || p.p_brand) ELSE a.t END AS t
            FROM ({asked}) a LEFT JOIN knn1 k ON k.qid = a.id AND k.r = 1 LEFT JOIN part p ON p.p_partkey = k.cid),
    {named(knn(GENERIC, "SELECT id, t FROM dep", 5), "3")}"""


LOOKUP = looked_up(ASKED)
#: What an answer takes from the lookup: prices of the first master match, and the generics in order.
ENRICHED = f"""alt AS (SELECT qid, string_agg(p_type || ' ' || p_brand || ': ₹' || {PRICE} || ' for ' || p_size || '''s', '; ' ORDER BY r) AS alternatives FROM knn3 JOIN part ON cid = p_partkey GROUP BY qid),
    top AS (SELECT qid, product_price, nppa_price, price_flag FROM knn2 JOIN m ON cid = p_partkey WHERE r = 1)"""
SCANS = """s AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey % 10 <> 0 THEN CAST(o_custkey AS VARCHAR) END AS user_id, o_orderkey || '.png' AS image_path,
    CASE o_orderkey % 6 WHEN 0 THEN '{"brand_name":"' || o_orderpriority || '","generic_name":"' || o_orderstatus || '"}'
      WHEN 1 THEN '{"success":true,"data":{"brand_name":"' || o_orderpriority || '","generic_name":"' || o_orderstatus || '"},"error":null}'
      WHEN 2 THEN '{"success":false,"data":null,"error":"e"}' WHEN 3 THEN '{"brand_name":""}' WHEN 4 THEN '{bad' END AS result_json,
    CASE WHEN o_orderkey % 6 = 0 THEN o_orderpriority ELSE 'Unknown' END AS brand_name, CASE WHEN o_orderkey % 6 = 0 THEN o_orderstatus ELSE '' END AS generic_name,
    o_totalprice / 1000000 AS confidence, strftime(date_trunc('day', o_orderdate), '%Y-%m-%d') AS created_at FROM orders)"""
MESSAGES = "m AS (SELECT CAST(conv_id AS VARCHAR) AS scan_id, turn AS id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)"


def clean(c: str) -> str:
    """Character by character: one that differs in kind from both its neighbours goes, unless it is a or i."""
    squeeze = lambda x: r"regexp_replace(regexp_replace(" + x + r", '[\s\x0b\x85\p{Z}]+', ' ', 'g'), '^ | $', '', 'g')"
    kind = lambda i: rf"regexp_full_match(substr(x, {i}, 1), '[\p{{L}}\p{{N}}\p{{M}}_]')"
    stays = f"contains('aAiI', substr(x, i, 1)) OR {kind('i - 1')} = {kind('i')} OR {kind('i')} = {kind('i + 1')}"
    lone = f"(SELECT array_to_string(list_transform(list_filter(range(1, length(x) + 1), lambda i: {stays}), lambda i: substr(x, i, 1)), '') FROM (SELECT {squeeze(c)} AS x))"
    return "coalesce(" + squeeze(f"regexp_replace({lone}, '[|}}{{~`]', '', 'g')") + ", '')"


WORDS = r"""a AS (SELECT coalesce(CAST(conv_id AS VARCHAR), '') || '/' || coalesce(CAST(turn AS VARCHAR), '') AS image_id, text FROM conversations),
    g AS (SELECT v, a.a AS angle, a.i AS i FROM (VALUES (0), (1), (2), (3)) v(v), (VALUES (0, 0), (90, 1), (270, 2)) a(a, i)),
    wd AS (SELECT image_id, v, angle, i, unnest(string_split(text, ' ')) AS t, unnest(range(0, len(string_split(text, ' ')))) AS k FROM a, g),
    cf AS (SELECT *, CAST((length(t) * 7 + k * 3 + v * 5 + i * 11) % 97 - 3 AS DOUBLE) AS conf FROM wd),
    tx AS (SELECT image_id, v, angle, i, string_agg(regexp_replace(t, '^\s+|\s+$', '', 'g'), ' ' ORDER BY k) AS raw, avg(conf) AS conf FROM cf WHERE CAST(conf AS INT) > 0 AND regexp_matches(t, '\S') GROUP BY ALL)"""
REPLIES = "e AS (SELECT event_id, props, event_id % 5 AS kind FROM events)"
TEXTS = "t AS (SELECT doc_id AS text_id, text, CASE lang WHEN 'en' THEN 'en-US' WHEN 'de' THEN 'hi-IN' WHEN 'fr' THEN 'ta-IN' ELSE 'xx-XX' END AS language FROM documents)"
PIECES = f"""{TEXTS}, p AS (SELECT text_id, CASE language WHEN 'hi-IN' THEN 'Helsinki-NLP/opus-mt-en-hi' WHEN 'ta-IN' THEN 'Helsinki-NLP/opus-mt-en-ta' ELSE 'Helsinki-NLP/opus-mt-en-mul' END AS model,
    o // 450 AS piece, substr(text, o + 1, 450) AS chunk FROM (SELECT *, unnest(range(0, CAST(length(text) AS BIGINT), 450)) AS o FROM t WHERE language <> 'en-US'))"""
METRICS = "r AS (SELECT event_type AS endpoint, (event_id % 90) * 1000 AS ms FROM events WHERE value > 10)"

ORACLE: dict[str, str] = {
    "normalise": f"SELECT doc_id, {NORM.format('text')} AS n FROM documents",
    "term_frequencies": f"WITH {knn(BRANDED, ASKED, 5)} SELECT id AS doc_id, g AS gram, tf FROM tf",
    "inverse_document_frequencies": f"WITH {knn(BRANDED, ASKED, 5)} SELECT g AS gram, round_even(idf, 6) AS idf FROM idf",
    "knn_branded": f"""WITH {knn(BRANDED, ASKED, 5)} SELECT qid, r AS rank, p_name AS name, {PRICE} AS price, p_brand AS manufacturer, 'part' AS type, CAST(p_size AS VARCHAR) AS pack_size,
        p_type AS composition1, p_brand AS composition2, 'FALSE' AS is_discontinued, sim AS match_score FROM knn JOIN part ON cid = p_partkey""",
    "knn_generics": f"""WITH {knn(GENERIC, GENERIC + " WHERE p_partkey % 50 = 0", 5)} SELECT qid, r AS rank, p_type || ' ' || p_brand AS generic_name, {PRICE} AS mrp, p_size || '''s' AS unit_size,
        p_type AS category, sim AS match_score FROM knn JOIN part ON cid = p_partkey""",
    "knn_master": f"""WITH {knn(MASTER, ASKED, 3)}, {PRICES} SELECT qid, r AS rank, {NORM.format('p_name')} AS brand_name, p_type AS canonical_name, p_type AS composition, p_brand AS manufacturer, 'False' AS is_generic,
        product_price, nppa_price, price_flag, '' AS ratio_market_to_nppa, sim AS match_score FROM knn JOIN m ON cid = p_partkey""",
    "knn_documents": f"WITH {knn('SELECT doc_id AS id, text AS t FROM documents', 'SELECT item_id AS id, text AS t FROM benchmark', 5)} SELECT qid, cid AS doc_id, r AS rank, sim AS match_score FROM knn",
    "lookup": f"""WITH {LOOKUP} SELECT qid, 'branded' AS part, r AS rank, p_name AS name, sim AS match_score FROM knn1 JOIN part ON cid = p_partkey
        UNION ALL SELECT qid, 'generic', r, p_type || ' ' || p_brand, sim FROM knn3 JOIN part ON cid = p_partkey
        UNION ALL SELECT qid, 'master', r, {NORM.format('p_name')}, sim FROM knn2 JOIN part ON cid = p_partkey""",
    "price_info": f"WITH {knn(MASTER, ASKED, 1)}, {PRICES} SELECT a.id AS qid, product_price, nppa_price AS ceiling, price_flag AS flag FROM ({ASKED}) a LEFT JOIN knn ON qid = a.id LEFT JOIN m ON cid = p_partkey",
    "alternatives": f"""WITH {LOOKUP} SELECT qid, r - 1 AS at, p_type || ' ' || p_brand AS name, '₹' || {PRICE} || ' for ' || p_size || '''s' AS price, 'jan_aushadhi' AS source, '' AS drug_code FROM knn3 JOIN part ON cid = p_partkey""",
    "enrichment": f"""WITH {knn(MASTER, ASKED, 1)}, {PRICES} SELECT a.id AS qid, CASE WHEN a.id % 100 = 0 THEN '1' ELSE coalesce(product_price, '') END AS price, coalesce(nppa_price, '') AS nppa_ceiling_price,
        coalesce(price_flag, '') AS price_flag FROM ({ASKED}) a LEFT JOIN knn ON qid = a.id LEFT JOIN m ON cid = p_partkey""",
    "history_pages": f"""WITH {SCANS} SELECT user_id, rank, id, '/uploads/' || image_path AS image_url, brand_name, generic_name, confidence, 'ocr' AS method, created_at
        FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id) AS rank FROM s WHERE user_id IS NOT NULL) WHERE rank <= 5""",
    "history_corrected": f"WITH {SCANS} SELECT id, coalesce(CASE WHEN json_valid(result_json) THEN coalesce(json_extract_string(result_json, '$.data.brand_name'), nullif(json_extract_string(result_json, '$.brand_name'), '')) END, 'Unknown') AS brand_name FROM s",
    "history_page_of_user": f"WITH {SCANS} SELECT id, '/uploads/' || image_path AS image_url, brand_name, generic_name, confidence, 'ocr' AS method FROM s WHERE user_id = '7' ORDER BY created_at DESC, id LIMIT 3 OFFSET 2",
    "history_of_nobody": f"WITH {SCANS} SELECT id FROM s WHERE user_id = 'anonymous' LIMIT 20",
    "pagination": f"WITH {SCANS} SELECT user_id, count(*) AS total, CAST(ceil(count(*) / 20.0) AS BIGINT) AS pages FROM s WHERE user_id IS NOT NULL GROUP BY user_id",
    "page_parameters": """WITH x AS (SELECT o_orderkey, TRY_CAST(regexp_extract(o_orderpriority, '^\\s*([+-]?[0-9]+)', 1) AS INT) AS p FROM orders),
        y AS (SELECT o_orderkey, coalesce(nullif(p, 0), 1) AS page FROM x) SELECT o_orderkey, page, CAST(20 AS INT) AS page_size, CAST((page - 1) * 20 AS INT) AS skipped FROM y""",
    "chat_first_messages": f"WITH {MESSAGES} SELECT scan_id, id, role, pos FROM m WHERE pos <= 4",
    "chat_window": f"WITH {MESSAGES} SELECT scan_id, id, role, pos FROM m WHERE pos <= 4 AND pos > least(n, 4) - 2",
    "chat_window_full": f"WITH {MESSAGES} SELECT scan_id, id, role, pos FROM m WHERE pos <= 20 AND pos > least(n, 20) - 10",
    "chat_prompts": f"""WITH {SCANS}, {MESSAGES}, h AS (SELECT scan_id, string_agg(role || ': ' || text, chr(10) ORDER BY pos) AS h FROM m WHERE pos <= 20 AND pos > least(n, 20) - 3 GROUP BY scan_id)
        SELECT s.id AS scan_id, 'context ' || coalesce(result_json, '{{}}') || chr(10) || coalesce(h || chr(10), '') || 'user: and now?' AS prompt FROM s LEFT JOIN h ON s.id = h.scan_id""",
    "upsert_users": """SELECT lower(c_name) AS email, c_custkey AS id FROM customer WHERE c_mktsegment <> 'BUILDING'
        UNION ALL SELECT lower(c_name), min(o_orderkey) + 1000000 FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY lower(c_name) HAVING lower(c_name) NOT IN (SELECT lower(c_name) FROM customer WHERE c_mktsegment <> 'BUILDING')""",
    "delete_scans": "SELECT CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE o_orderpriority <> '1-URGENT'",
    "delete_messages": "SELECT CAST(conv_id AS VARCHAR) AS scan_id, turn FROM conversations WHERE conv_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')",
    "orphan_messages": "SELECT CAST(conv_id AS VARCHAR) AS scan_id, turn FROM conversations WHERE conv_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority <> '1-URGENT')",
    "uploads": "SELECT count(*) AS n, count(*) AS n_names, count(*) AS n_ids, count(*) AS n_uuids, count(*) AS n_kept FROM pages WHERE page_id % 2 = 0 AND length(html) BETWEEN 1 AND 10485760",
    "repeated_keys": "SELECT p_name, count(*) AS n FROM part GROUP BY p_name HAVING count(*) > 1 OR p_name IS NULL",
    "bad_roles": "SELECT role, count(*) AS n FROM conversations WHERE role IS NULL OR role NOT IN ('user', 'assistant') GROUP BY role",
    "append_searches": """SELECT CAST(p_partkey AS VARCHAR) AS id, CAST(NULL AS VARCHAR) AS user_id, '' AS image_path, CASE WHEN p_size > 25 THEN '{"brand_name":"' || p_brand || '"}' ELSE '{"success":false}' END AS result_json,
        trim(p_name) AS ocr_text, CAST(1 AS DOUBLE) AS ocr_confidence, 'text_search' AS method FROM part""",
    "append_images": """SELECT CAST(p_partkey AS VARCHAR) AS id, p_brand AS user_id, p_name AS image_path, '{"p_size":' || p_size || '}' AS result_json, '' AS ocr_text, CAST(0 AS DOUBLE) AS ocr_confidence, 'ocr' AS method FROM part""",
    "append_messages": """SELECT CAST(conv_id AS VARCHAR) AS scan_id, 'user' AS role, text AS content FROM conversations UNION ALL SELECT CAST(conv_id AS VARCHAR), 'assistant', 'assistant' FROM conversations WHERE role = 'assistant'""",
    "append_metrics": f"WITH {METRICS} SELECT endpoint, ms AS response_time_ms, CAST(200 AS BIGINT) AS status_code FROM r",
    "latency": f"WITH {METRICS} SELECT endpoint, count(*) AS n, quantile_cont(ms, 0.5) AS p50, quantile_cont(ms, 0.95) AS p95, max(ms) AS worst FROM r GROUP BY endpoint",
    "required_fields": r"SELECT doc_id, regexp_matches(coalesce(text, ''), '\S') AS ok FROM documents",
    "scan_by_id": f"WITH {SCANS} SELECT id, user_id, image_path, json_extract_string(result_json, '$.data.brand_name') AS brand_name, o_orderstatus AS ocr_text, confidence AS ocr_confidence, 'ocr' AS method FROM s JOIN orders ON o_orderkey = 7 WHERE id = '7'",
    "stored_results_that_open": f"WITH {SCANS} SELECT id, coalesce(json_valid(result_json), true) AS opens FROM s",
    "scan_responses": f"""WITH {SCANS} SELECT id AS scan_id, '/uploads/' || image_path AS image_url, CASE CAST(id AS BIGINT) % 6 WHEN 1 THEN true WHEN 2 THEN false END AS success,
        CASE WHEN CAST(id AS BIGINT) % 6 = 1 THEN json_extract_string(result_json, '$.data.brand_name') END AS brand_name, CASE WHEN CAST(id AS BIGINT) % 6 = 2 THEN 'e' END AS error FROM s""",
    "chat_replies": """SELECT conv_id, turn, CASE WHEN role = 'assistant' AND text <> '' THEN text WHEN turn % 2 = 0 THEN role END AS reply,
        coalesce(CASE WHEN turn % 2 = 0 THEN nullif(role, '') END, CASE WHEN role = 'assistant' THEN nullif(text, '') END, 'no reply') AS shown FROM conversations""",
    "bearer_tokens": """SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN replace(p_name, ' ', '-') WHEN p_size % 3 = 0 THEN '' WHEN starts_with(p_name, 'Bearer ') THEN split_part(p_name, ' ', 2) END AS token FROM part""",
    "translation_prompts": f"""WITH {TEXTS} SELECT text_id, 'Target language: ' || language || '. Answer with the translated text.' || chr(10) || text AS prompt
        FROM t WHERE language <> 'en-US'""",
    "extracted_json": f"""WITH {REPLIES} SELECT event_id, CASE WHEN kind < 3 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k, CASE WHEN kind = 4 THEN 'busy' END AS error,
        kind < 3 AND coalesce(json_exists(props, '$.k'), false) AS has_k FROM e""",
    "analysis_defaults": """SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE p_name END AS brand_name, '' AS form, CASE WHEN p_size % 2 = 0 THEN p_type END AS uses, CAST(0 AS BIGINT) AS n_warnings,
        CASE WHEN p_size % 2 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END AS confidence, p_size % 2 = 0 AS valid FROM part""",
    "stored_names": f"WITH {SCANS} SELECT id, brand_name, generic_name FROM s",
    "clean_ocr": f"WITH {WORDS} SELECT image_id, {clean('text')} AS text FROM a",
    "ocr_candidates": f"WITH {WORDS} SELECT image_id, v AS variant, angle, round_even(conf, 6) AS conf, length(raw) AS n_chars FROM tx",
    "ocr_best": f"""WITH {WORDS}, ok AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY conf DESC, v, i) AS r FROM (SELECT *, {clean('raw')} AS c FROM tx) WHERE length(c) > 5 AND conf > 0),
        b AS (SELECT a.image_id, coalesce(c, '') AS ocr_text, coalesce(conf, 0) AS conf FROM a LEFT JOIN ok ON a.image_id = ok.image_id AND r = 1)
        SELECT image_id, ocr_text, round_even(CAST(conf AS DOUBLE), 6) AS conf, CASE WHEN conf < 40 OR length(ocr_text) < 10 THEN 'vision_fallback' ELSE 'ocr' END AS method FROM b""",
    "image_sizes": """SELECT p_partkey, round_even(CASE WHEN greatest(w, h) > 2000 THEN CAST(2000 AS DOUBLE) / greatest(w, h) ELSE CAST(1 AS DOUBLE) END, 6) AS scale, CAST(w AS INT) AS rotated_w, CAST(h AS INT) AS rotated_h
        FROM (SELECT p_partkey, p_size * 100 AS w, p_partkey % 3000 + 1 AS h FROM part)""",
    "acceptable_uploads": """WITH f AS (SELECT url || CASE page_id % 4 WHEN 0 THEN '.PNG' WHEN 1 THEN '.jpg' WHEN 2 THEN '.gif' ELSE '' END AS path, length(html) * (page_id % 5000) AS length FROM pages)
        SELECT path, length FROM f WHERE regexp_matches(lower(path), '\\.(jpg|jpeg|png|webp|bmp)$') AND length > 0 AND length <= 10485760""",
    "translation_pieces": f"WITH {PIECES} SELECT text_id, model, piece, chunk FROM p",
    "translations": f"""WITH {PIECES}, j AS (SELECT text_id, string_agg(CASE WHEN piece % 3 <> 2 THEN '<' || chunk || '>' ELSE chunk END, ' ' ORDER BY piece) AS whole FROM p GROUP BY text_id)
        SELECT t.text_id, coalesce(whole, text) AS translation FROM t LEFT JOIN j ON t.text_id = j.text_id""",
    "localised_strings": "SELECT n_nationkey, n_regionkey AS locale, 'title' AS key, r_name AS value FROM nation JOIN region ON r_regionkey = CASE WHEN n_regionkey < 3 THEN n_regionkey ELSE 0 END",
    "result_header": """SELECT p_partkey, coalesce(nullif(CASE WHEN p_size % 3 = 0 THEN '' ELSE p_name END, ''), nullif(CASE WHEN p_size % 2 = 0 THEN '' ELSE p_type END, ''), 'Unknown Medicine') AS title,
        CASE WHEN p_size > 25 THEN 'overpriced' WHEN p_size > 10 THEN 'fair' END AS price_badge, CASE WHEN p_size % 5 = 0 THEN 'vision' ELSE 'ocr' END AS method_badge,
        CASE WHEN p_size > 1 THEN ((p_size - 1) * 2) || '%' END AS confidence_label FROM part""",
    "result_sections": """SELECT p_partkey, 'uses' AS section, CAST(0 AS BIGINT) AS item_no, p_brand AS item FROM part WHERE p_size > 25 UNION ALL SELECT p_partkey, 'uses', 1, p_type FROM part WHERE p_size > 25
        UNION ALL SELECT p_partkey, 'warnings', 0, p_name FROM part""",
    "knn_stored": f"""WITH {knn(BRANDED, ASKED, 5)} SELECT qid, r AS rank, p_name AS name, {PRICE} AS price, p_brand AS manufacturer, 'part' AS type, CAST(p_size AS VARCHAR) AS pack_size,
        p_type AS composition1, p_brand AS composition2, 'FALSE' AS is_discontinued, sim AS match_score FROM knn JOIN part ON cid = p_partkey""",
    "csv_catalogues": f"""SELECT 'branded' AS catalogue, CASE WHEN p_partkey % 3 = 0 THEN p_name || ' "new",' || chr(10) || 'improved' ELSE p_name END AS a, CASE WHEN p_size > 10 THEN {PRICE} ELSE '' END AS b, p_type AS c, 'FALSE' AS d FROM part
        UNION ALL SELECT 'generics', p_type || ' ' || p_brand, {PRICE}, CAST(p_size AS VARCHAR), p_type FROM part
        UNION ALL SELECT 'master', CASE WHEN p_partkey % 3 = 0 THEN p_name || ' "new",' || chr(10) || 'improved' ELSE p_name END, p_name, {PRICE}, '' FROM part""",
    "csv_search": f"WITH {knn(BRANDED, ASKED, 1)} SELECT qid, p_name AS canonical_name, sim AS match_score FROM knn JOIN part ON cid = p_partkey",
    "csv_counts": "SELECT c AS catalogue, CASE WHEN c = 'absent' THEN 0 ELSE n END AS n FROM (SELECT count(*) AS n FROM part), (VALUES ('branded'), ('generics'), ('master'), ('absent')) v(c)",
    "stored_scans": f"""WITH {SCANS} SELECT id, 'scan' AS kind, user_id FROM s JOIN orders ON CAST(o_orderkey AS VARCHAR) = id WHERE o_orderpriority <> '1-URGENT'
        UNION ALL SELECT conv_id || '/' || turn, 'message', NULL FROM conversations WHERE conv_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')""",
    "stored_users": """WITH u AS (SELECT CAST(c_custkey AS VARCHAR) AS id, lower(c_name) AS email, c_name AS name FROM customer WHERE c_mktsegment <> 'BUILDING')
        SELECT id, email, name FROM u UNION ALL SELECT CAST(min(o_orderkey) + 1000000 AS VARCHAR), lower(c_name), c_name FROM orders JOIN customer ON o_custkey = c_custkey
        WHERE lower(c_name) NOT IN (SELECT email FROM u) GROUP BY c_name""",
    "stored_metrics": f"""WITH {METRICS} SELECT endpoint, count(*) AS n, quantile_disc(ms, 0.5) AS p50, quantile_disc(ms, 0.95) AS p95, max(ms) AS worst, count(*) AS n_ids, CAST(0 AS BIGINT) AS n_without_time FROM r GROUP BY endpoint""",
    "replies_kept": """WITH a AS (SELECT doc_id, concat_ws('/', lang, source) AS s FROM documents) SELECT count(*) AS n, count_if(doc_id % 2 = 0) AS n_same, CAST(0 AS BIGINT) AS n_without,
        count(DISTINCT CASE WHEN doc_id % 2 = 0 THEN s END) AS n_first, count(DISTINCT s) AS n_both FROM a""",
    "pipeline_search": f"""WITH q AS (SELECT id, trim(t) AS t FROM ({ASKED})), {looked_up("SELECT id, t FROM q")}, {PRICES}, {ENRICHED}
        SELECT q.id AS qid, true AS success, CAST(NULL AS VARCHAR) AS error, t AS brand_name, lower(t) AS generic_name, t AS ocr_text, 'text_search' AS method, coalesce(product_price, '') AS price,
        coalesce(nppa_price, '') AS nppa_ceiling_price, coalesce(price_flag, '') AS price_flag, CAST(0.5 AS DOUBLE) AS confidence, 'use of ' || t AS uses, coalesce(alternatives, '') AS alternatives
        FROM q LEFT JOIN top ON top.qid = q.id LEFT JOIN alt ON alt.qid = q.id""",
    "pipeline_analyze": f"""WITH c AS (SELECT id, {clean('t')} AS c FROM ({ASKED})), q AS (SELECT id, CASE WHEN length(c) > 5 THEN c ELSE '' END AS t, length(c) >= 10 AS by_text FROM c),
        {looked_up("SELECT id, t FROM q WHERE by_text")}, {PRICES}, {ENRICHED}
        SELECT CAST(q.id AS VARCHAR) AS image_id, true AS success, CAST(NULL AS VARCHAR) AS error, CASE WHEN by_text THEN t ELSE '' END AS brand_name, CASE WHEN by_text THEN lower(t) ELSE '' END AS generic_name, t AS ocr_text,
        CASE WHEN by_text THEN 'ocr' ELSE 'vision_fallback' END AS method, coalesce(product_price, '') AS price, coalesce(nppa_price, '') AS nppa_ceiling_price, coalesce(price_flag, '') AS price_flag, CAST(0.5 AS DOUBLE) AS confidence,
        'use of ' || CASE WHEN by_text THEN t ELSE '' END AS uses, coalesce(alternatives, '') AS alternatives FROM q LEFT JOIN top ON top.qid = q.id LEFT JOIN alt ON alt.qid = q.id""",
    "pipeline_chat": f"""WITH {SCANS}, {MESSAGES}, h AS (SELECT scan_id, string_agg(role || ': ' || text, chr(10) ORDER BY pos) AS h FROM m WHERE pos <= 20 AND pos > least(n, 20) - 10 GROUP BY scan_id),
        a AS (SELECT scan_id, text, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS t FROM m WHERE pos = n),
        y AS (SELECT a.*, '```json' || chr(10) || '{{"brand_name": ' || CAST(to_json(t) AS VARCHAR) || ', "generic_name": ' || CAST(to_json(lower(t)) AS VARCHAR) || ', "uses": [' || CAST(to_json('use of ' || t) AS VARCHAR) || '], "confidence": 0.5}}' || chr(10) || '```' AS reply FROM a),
        z AS (SELECT scan_id, string_agg('[hi-IN] ' || substr(reply, o + 1, 450), ' ' ORDER BY o) AS reply FROM (SELECT *, unnest(range(0, CAST(length(reply) AS BIGINT), 450)) AS o FROM y) GROUP BY scan_id)
        SELECT CAST(s.id AS BIGINT) AS request_id, 'You answer questions about this product:' || chr(10) || coalesce(result_json, '{{}}') || chr(10) || coalesce(h || chr(10), '') || 'user: ' || a.text AS prompt, z.reply
        FROM s JOIN a ON a.scan_id = s.id JOIN z ON z.scan_id = s.id LEFT JOIN h ON h.scan_id = s.id""",
    "catalogue_counts": "SELECT c AS catalogue, n FROM (SELECT count(*) AS n FROM part), (VALUES ('branded'), ('generics'), ('master')) v(c)",
}
