"""Common table expressions deriving, in SQL, the tables of ``catalog.inputs``."""

from __future__ import annotations

from docloom.fixed_values import (
    FILE_MIME_PREFIX,
    INGESTION_MIME_TYPES,
    MIME_DOCUMENT,
    MIME_FOLDER,
    MIME_PRESENTATION,
    MIME_SPREADSHEET,
)

T0 = "TIMESTAMP '2024-01-01 00:00:00'"
#: Key parts with trailing empty ones removed, as a list expression over ``{k}``.
PARTS = (
    "CASE WHEN NOT contains({k}, '___') THEN [{k}] ELSE "
    "list_slice(string_split({k}, '___'), 1, coalesce(list_max(list_transform(string_split({k}, '___'), "
    "lambda x, i: CASE WHEN x <> '' THEN i END)), 0)) END"
)


def parts(key: str) -> str:
    return PARTS.format(k=key)


def doc_key(key: str) -> str:
    return (
        f"CASE WHEN len({parts(key)}) = 3 THEN ({parts(key)})[1] || '___' || ({parts(key)})[2] "
        f"ELSE ({parts(key)})[1] END"
    )


def file_id(key: str) -> str:
    return f"CASE WHEN len({parts(key)}) = 3 THEN ({parts(key)})[2] ELSE '' END"


FILE_MIME = (
    f"CASE WHEN doc_id % 7 < 3 THEN '{MIME_DOCUMENT}' WHEN doc_id % 7 = 3 THEN '{MIME_SPREADSHEET}' "
    f"WHEN doc_id % 7 = 4 THEN '{MIME_PRESENTATION}' WHEN doc_id % 7 = 5 THEN '{FILE_MIME_PREFIX}drawing' "
    "ELSE 'application/x-other' END"
)
LINK = (
    "CASE WHEN len({parts}) = 3 THEN CASE {mime} "
    f"WHEN '{MIME_DOCUMENT}' THEN 'https://docs.google.com/document/d/' "
    f"WHEN '{MIME_SPREADSHEET}' THEN 'https://docs.google.com/spreadsheets/d/' "
    f"WHEN '{MIME_PRESENTATION}' THEN 'https://docs.google.com/presentation/d/' "
    "ELSE 'NA ' END || ({parts})[2] ELSE ({parts})[1] END"
)
RAW = (
    """'{{"rawData":{{"id":"raw' || doc_id || '","data":"' || {data} || '","mimeType":"{mime}"}}}}'"""
)
REF = """'{{"url":"https://x.example/' || doc_id || '.{ext}","mimeType":"{mime}"}}'"""
CODED = "to_base64(encode(to_base64(encode(text))))"
PDF, PNG, TXT = (
    REF.format(ext="pdf", mime="application/pdf"),
    REF.format(ext="png", mime="image/png"),
    REF.format(ext="txt", mime="text/plain"),
)

KNOWN_MIMES = "[" + ", ".join(f"'{m}'" for m in INGESTION_MIME_TYPES) + "]"

#: name -> (tables it needs, SQL)
CTES: dict[str, tuple[list[str], str]] = {
    "files": (
        [],
        f"""SELECT 'f' || doc_id AS id, 'folder_' || source || '_' || lang AS parent_id, {FILE_MIME} AS mime_type,
            {T0} + to_seconds(doc_id * 60) AS modified_time, '[' || source || '] Doc (' || lang || ') no ' || doc_id AS name,
            CASE WHEN doc_id % 11 <> 10 THEN 'https://docs.google.com/document/d/f' || doc_id || '/edit' END AS web_view_link
            FROM documents
            UNION ALL SELECT DISTINCT 'folder_' || source || '_' || lang, 'folder_' || source, '{MIME_FOLDER}', NULL::TIMESTAMP,
            'folder_' || source || '_' || lang, NULL FROM documents
            UNION ALL SELECT DISTINCT 'folder_' || source, 'root', '{MIME_FOLDER}', NULL::TIMESTAMP, 'folder_' || source, NULL FROM documents
            UNION ALL SELECT 'root', 'folder_' || min(source), '{MIME_FOLDER}', NULL::TIMESTAMP, 'root', NULL FROM documents""",
    ),
    "lines": (
        [],
        "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents",
    ),
    "doc_lines": (
        ["lines"],
        """SELECT doc_id, i AS pos, replace(t, chr(10), '') AS line FROM (
            SELECT doc_id, i, array_to_string(list_transform(list_filter(string_split(line, ', '), lambda x: x <> ''),
            lambda x: x || chr(10)), ' ') || CASE WHEN i % 3 = 2 THEN ' ' ELSE '' END AS t FROM lines)
            WHERE regexp_matches(t, '\\S')""",
    ),
    "sheet_lines": (
        ["lines"],
        """SELECT doc_id, i * 1000000 + j AS pos, CASE WHEN length(w) % 2 = 0 THEN w || ' ' ELSE w END AS line FROM (
            SELECT doc_id, i, unnest(string_split(line, ' ')) AS w, generate_subscripts(string_split(line, ' '), 1) AS j FROM lines)
            WHERE regexp_matches(w, '\\S')""",
    ),
    "slide_lines": (
        ["lines"],
        """SELECT doc_id, i * 1000000 + j AS pos, w AS line FROM (
            SELECT doc_id, i, unnest(string_split(line, ', ')) AS w, generate_subscripts(string_split(line, ', '), 1) AS j FROM lines)
            WHERE regexp_matches(w, '\\S')""",
    ),
    "messages": (
        [],
        f"""SELECT doc_id, {T0} + to_seconds(doc_id) AS ts, source AS origin, doc_id % 205 AS retries, CASE doc_id % 10
            WHEN 0 THEN '{{"googleDrive":[{{"urlOrId":"https://docs.google.com/document/d/f' || doc_id || '/edit?usp=sharing"}}]}}'
            WHEN 1 THEN '{{"googleDrive":[{{"urlOrId":"f' || doc_id || '"}},{{"urlOrId":"https://drive.google.com/drive/u/0/settings"}}]}}'
            WHEN 2 THEN {RAW.format(data=CODED, mime="text/plain")}
            WHEN 3 THEN {RAW.format(data="'%%%'", mime="text/plain")}
            WHEN 4 THEN {RAW.format(data=CODED, mime="image/png")}
            WHEN 5 THEN '{{"references":[' || {PDF} || ',' || {PNG} || '],"extra":1}}'
            WHEN 6 THEN '{{"references":[' || {PDF} || ',' || {TXT} || ',' || {PNG} || ']}}'
            WHEN 7 THEN '{{"googleDrive":[{{"urlOrId":"f' || doc_id || '"}}],"rawData":{{"id":"x","data":"YQ==","mimeType":"text/plain"}}}}'
            WHEN 8 THEN '{{"other":' || doc_id || '}}'
            ELSE CASE WHEN doc_id % 20 < 10 THEN '{{"googleDrive": ["' ELSE '{{"references":[{{"url":"u","mimeType":"application/zip"}}]}}' END
            END AS payload FROM documents""",
    ),
    "parsed": (
        ["messages"],
        f"""SELECT m.*, CASE WHEN j0 IS NOT NULL
            AND coalesce(list_bool_and(list_transform(json_extract_string(j0, '$.references[*].mimeType'),
            lambda x: list_contains({KNOWN_MIMES}, x))), true)
            AND coalesce(list_contains({KNOWN_MIMES}, json_extract_string(j0, '$.rawData.mimeType')), true)
            THEN j0 END AS j FROM (SELECT *, TRY_CAST(payload AS JSON) AS j0 FROM messages) m""",
    ),
    "routed": (
        ["parsed"],
        """SELECT *, CASE WHEN j IS NULL THEN 'malformed' WHEN json_exists(j, '$.googleDrive') THEN 'drive'
            WHEN json_exists(j, '$.rawData') THEN 'raw' WHEN json_exists(j, '$.references') THEN 'references'
            ELSE 'unsupported' END AS route FROM parsed""",
    ),
    "transports": (
        ["routed"],
        """SELECT doc_id, ts, origin, retries, unnest(json_extract_string(j, '$.googleDrive[*].urlOrId')) AS content_id
            FROM routed WHERE route = 'drive'""",
    ),
    "contents": (
        [],
        f"""SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN 'raw' || doc_id
            ELSE lower(source || '_doc_' || lang || '_no_' || doc_id) || '___f' || doc_id END AS key,
            text, CASE WHEN doc_id % 4 <> 3 THEN {FILE_MIME} END AS mime_type FROM documents""",
    ),
    "words": (
        ["contents"],
        """SELECT doc_id, key, mime_type, string_split(trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')), ' ') AS ws
            FROM contents WHERE regexp_matches(text, '\\S')""",
    ),
    "starts": (
        ["words"],
        """SELECT key, pos, n FROM (SELECT key, pos, n, max(CASE WHEN pos = 0 OR after_end THEN pos END)
            OVER (PARTITION BY key ORDER BY pos) AS sentence FROM (
            SELECT key, pos, n, lag(right(word, 1) IN ('.', '?', '!')) OVER (PARTITION BY key ORDER BY pos) AS after_end FROM (
            SELECT key, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS pos, len(ws) AS n FROM words)))
            WHERE (pos - sentence) % 824 = 0""",
    ),
    "heads": (
        ["starts"],
        """SELECT key, pos, n, coalesce(prev, 0) AS lead_pos FROM (
            SELECT key, pos, n, lag(pos) OVER (PARTITION BY key ORDER BY pos) AS prev FROM starts)
            WHERE prev IS NULL OR pos // 400 <> prev // 400""",
    ),
    "chunks": (
        ["heads", "words"],
        """SELECT c.key, c.idx, array_to_string(list_slice(w.ws, c.lead_pos + 1, coalesce(c.next_pos, c.n)), ' ') AS chunk,
            w.mime_type, w.doc_id FROM (
            SELECT key, i AS idx, lead_pos, n, lead(pos) OVER (PARTITION BY key ORDER BY pos) AS next_pos FROM (
            SELECT key, pos, n, lead_pos, row_number() OVER (PARTITION BY key ORDER BY pos) - 1 AS i,
            count(*) OVER (PARTITION BY key) AS m, lag(lead_pos) OVER (PARTITION BY key ORDER BY pos) AS prev_lead FROM heads)
            WHERE NOT (m > 1 AND i = m - 1 AND n - pos < 200 AND n - prev_lead <= 2048)) c JOIN words w USING (key)""",
    ),
    "chunk_keys": (
        ["chunks"],
        "SELECT key || '___' || idx AS row_key, key AS doc_key, chunk AS content, idx, mime_type, doc_id FROM chunks",
    ),
    "linked": (
        ["chunk_keys"],
        f"SELECT *, {LINK.format(parts=parts('row_key'), mime='mime_type')} AS link FROM chunk_keys",
    ),
    "cells": (
        ["linked"],
        f"""SELECT row_key, 'content' AS qualifier, {T0} + to_hours(100) AS ts, content AS value FROM linked
            UNION ALL SELECT row_key, 'link', {T0} + to_hours(100), link FROM linked
            UNION ALL SELECT row_key, 'content', {T0} + to_hours(100 - v), 'older ' || v FROM
            (SELECT row_key, unnest(generate_series(1, (idx % 7)::BIGINT)) AS v FROM linked WHERE idx % 7 > 0)""",
    ),
    "changed": (
        ["chunk_keys"],
        """SELECT row_key, doc_key, content, doc_id FROM chunk_keys
            WHERE idx = 0 AND doc_id IN (SELECT doc_id FROM labels)""",
    ),
    "owned": (
        ["chunk_keys"],
        f"SELECT *, CASE WHEN len({parts('row_key')}) = 3 THEN ({parts('row_key')})[2] ELSE ({parts('row_key')})[1] END AS owner FROM chunk_keys",
    ),
    "vectors": ([], "SELECT vec_id::VARCHAR AS id, embedding::DOUBLE[] AS embedding, vec_id, label FROM embeddings"),
    "scored": (
        ["vectors"],
        """SELECT q.vec_id AS query_pos, 'query' || q.vec_id AS query_id, v.id, 3 + q.vec_id % 2 AS max_nn,
            round(list_cosine_similarity(q.embedding, v.embedding), 9) AS score FROM vectors q CROSS JOIN vectors v""",
    ),
    "ranked": (
        ["scored"],
        """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_pos ORDER BY score DESC, id) AS rank FROM scored)
            WHERE rank <= max_nn""",
    ),
    "exchanges": (
        [],
        f"""SELECT CASE WHEN q.conv_id % 52 < 4 THEN '  ' ELSE 'session' || (q.conv_id // 4) END AS session,
            {T0} + to_seconds((q.conv_id % 4) * 600 + q.turn * 60) AS ts,
            (CASE WHEN q.turn < 2 AND q.conv_id % 2 = 0 THEN 'Opening question' ELSE q.text END) || '___' ||
            (CASE WHEN (q.conv_id + q.turn) % 7 = 0 THEN 'I''m not sure. ' || a.text
                  WHEN (q.conv_id + q.turn) % 11 = 0 THEN a.text || '___x' ELSE a.text END) AS exchange
            FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1
            WHERE q.role = 'user' AND a.role = 'assistant'""",
    ),
    "qa": (
        ["exchanges"],
        f"""SELECT session, ts, p[1] AS question, p[2] AS answer FROM (SELECT *, {parts('exchange')} AS p FROM exchanges)
            WHERE len(p) = 2""",
    ),
    "first_answers": (
        ["qa"],
        """SELECT session, ts, question, answer FROM (SELECT *, row_number() OVER (PARTITION BY session, question ORDER BY ts, answer) AS rn
            FROM qa WHERE NOT (contains(answer, 'That isn''t something I know about yet, but I''m always learning so please try asking me again later!')
            OR contains(answer, 'I''m not sure') OR contains(answer, 'I am not sure'))) WHERE rn = 1""",
    ),
    "last_five": (
        ["first_answers"],
        """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts DESC, question DESC) AS rn FROM first_answers)
            WHERE rn <= 5""",
    ),
    "turns": (
        ["last_five"],
        """SELECT session, string_agg('user: ' || question || chr(10) || 'model: ' || answer, chr(10) ORDER BY ts, question) AS said
            FROM last_five GROUP BY session""",
    ),
    "questions": (
        [],
        """SELECT item_id, item_id::VARCHAR AS request_id, CASE WHEN item_id % 17 = 16 THEN '  ' ELSE text END AS text,
            CASE WHEN item_id % 19 <> 18 THEN 'session' || (item_id % 25) END AS session_id, item_id % 7 <> 6 AS has_parameters,
            CASE WHEN item_id % 7 = 6 THEN NULL WHEN item_id % 5 = 0 THEN 'You are an expert in archives.' WHEN item_id % 5 = 1 THEN ' ' END AS expertise,
            CASE WHEN item_id % 7 = 6 THEN NULL WHEN item_id % 3 = 0 THEN false WHEN item_id % 3 = 1 THEN true END AS enrich,
            CASE WHEN item_id % 7 = 6 THEN NULL WHEN item_id % 4 = 0 THEN 2 WHEN item_id % 4 = 1 THEN 9 END AS max_neighbors,
            CASE WHEN item_id % 7 = 6 THEN NULL WHEN item_id % 2 = 0 THEN 0.1 END AS temperature,
            CASE WHEN item_id % 7 = 6 THEN NULL WHEN item_id % 6 = 0 THEN 256 END AS max_output FROM benchmark""",
    ),
    "chunk_weights": (
        ["chunk_keys"],
        """SELECT row_key, bucket, CAST(CAST(w / norm AS FLOAT) AS DOUBLE) AS v FROM (
            SELECT *, sqrt(sum(w * w) OVER (PARTITION BY row_key)) AS norm FROM (
            SELECT row_key, ('0x' || substr(h, 1, 8))::BIGINT % 768 AS bucket,
            sum(CASE WHEN substr(h, 9, 1) < '8' THEN 1 ELSE -1 END)::DOUBLE AS w FROM (
            SELECT row_key, md5(word) AS h FROM (SELECT row_key, unnest(string_split(translate(lower(content), '.,?!', ''), ' ')) AS word
            FROM chunk_keys) WHERE word <> '') GROUP BY row_key, bucket)) WHERE norm > 0""",
    ),
    "question_weights": (
        ["questions"],
        """SELECT request_id, bucket, CAST(CAST(w / norm AS FLOAT) AS DOUBLE) AS v FROM (
            SELECT *, sqrt(sum(w * w) OVER (PARTITION BY request_id)) AS norm FROM (
            SELECT request_id, ('0x' || substr(h, 1, 8))::BIGINT % 768 AS bucket,
            sum(CASE WHEN substr(h, 9, 1) < '8' THEN 1 ELSE -1 END)::DOUBLE AS w FROM (
            SELECT request_id, md5(word) AS h FROM (SELECT request_id, unnest(string_split(translate(lower(text), '.,?!', ''), ' ')) AS word
            FROM questions WHERE session_id IS NOT NULL AND regexp_matches(text, '\\S')) WHERE word <> '')
            GROUP BY request_id, bucket)) WHERE norm > 0""",
    ),
    "question_hits": (
        ["chunk_weights", "question_weights", "linked", "questions"],
        """SELECT request_id, row_key AS id, score, content, link FROM (
            SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, row_key) AS rank FROM (
            SELECT request_id, row_key, round(sum(q.v * c.v) / (any_value(q.norm) * any_value(c.norm)), 9) AS score FROM
            (SELECT *, sqrt(sum(v * v) OVER (PARTITION BY request_id)) AS norm FROM question_weights) q JOIN
            (SELECT *, sqrt(sum(v * v) OVER (PARTITION BY row_key)) AS norm FROM chunk_weights) c USING (bucket)
            GROUP BY request_id, row_key)) s JOIN linked USING (row_key) JOIN questions USING (request_id)
            WHERE score > 0.4 AND rank <= least(3, coalesce(max_neighbors, 2147483647))""",
    ),
}


def sql(body: str, *tables: str) -> str:
    """``body`` with the common table expressions it needs in front."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for needed in CTES[name][0]:
            visit(needed)
        if name not in ordered:
            ordered.append(name)

    for table in tables:
        visit(table)
    if not ordered:
        return body
    return "WITH " + ", ".join(f"{name} AS ({CTES[name][1]})" for name in ordered) + " " + body
