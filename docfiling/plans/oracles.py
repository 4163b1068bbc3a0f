"""The same queries in SQL, over the same tables; derived tables are common table expressions."""

from __future__ import annotations

from .. import corpus as C
from ..functions import text as T
from ..operators import lifecycle as L
from . import jobs

_STATES = "['queued','extracting','analyzing','ready','needs_review','failed','canceled','applying','completed']"
_STAGES = "['planned','copied','verified','published','rollback_required','rolled_back','complete']"
_TYPES = "CASE o_orderstatus WHEN 'F' THEN 'Invoice' WHEN 'O' THEN 'Purchase Order' ELSE 'Notice of Termination' END"
_WORD = r"regexp_extract_all({}, '[^\s]+')"

_DAY = "strftime(CAST(o_orderdate AS DATE) + {}, '%B %-d, %Y')"
_ISO = "strftime(CAST(o_orderdate AS DATE) + {}, '%Y-%m-%d')"
DERIVED = {
    "contracts": f"""
      SELECT o_orderkey AS doc_id, o_custkey, array_to_string([
        CASE o_orderstatus WHEN 'F' THEN 'INVOICE' WHEN 'O' THEN 'PURCHASE ORDER' ELSE 'NOTICE OF TERMINATION' END,
        'Invoice Number: INV-' || o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'Date of this Notice: ' ELSE 'Invoice Date: ' END || {_DAY.format(0)}, 'Payment Due Date: ' || {_DAY.format(30)}, '',
        'Bill To: ' || c_name, 'Issued under the Master Services Agreement dated ' || {_DAY.format(-400)}, rows, 'Total Due: $' || CAST(floor(o_totalprice) AS BIGINT)], chr(10)) AS text
      FROM orders JOIN customer ON c_custkey = o_custkey
      JOIN (SELECT l_orderkey, string_agg('| part ' || l_partkey || ' | ' || CAST(l_quantity AS BIGINT) || ' |', chr(10) ORDER BY l_linenumber, '| part ' || l_partkey || ' | ' || CAST(l_quantity AS BIGINT) || ' |') AS rows FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey""",
    "statements": f"""
      SELECT o_custkey AS doc_id, n AS page, 'CONFIDENTIAL STATEMENT' || chr(10) || text || chr(10) || chr(10) || [{", ".join("'" + c.replace("'", "''") + "'" for c in C.CLAUSES)}][CAST(doc_id % 16 AS INT) + 1] || chr(10) || chr(10) || 'Page ' || n || ' of ' || m AS text
      FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY doc_id) AS n, count(*) OVER (PARTITION BY o_custkey) AS m FROM contracts)""",
    "have": "SELECT DISTINCT l_orderkey AS k FROM lineitem",
    "proposals": f"""
      SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 13 = 0 THEN 'Settlement Agreement' ELSE {_TYPES} END AS document_type,
        CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN {_ISO.format(30)} ELSE {_ISO.format(0)} END AS document_date,
        CASE WHEN o_orderkey % 11 = 0 THEN [c_name, 'Northwind Traders LLC'] ELSE [c_name] END AS parties, c_name,
        CASE o_orderkey % 3 WHEN 0 THEN 'between' WHEN 1 THEN 'from' ELSE 'none' END AS party_relation, {_TYPES} AS true_type, {_ISO.format(0)} AS true_date, {_ISO.format(30)} AS due
      FROM orders JOIN have ON k = o_orderkey JOIN customer ON c_custkey = o_custkey""",
    "items": f"""
      SELECT o_orderkey AS id, 'C:/In/Doc-' || (o_orderkey % 1000) || '.PDF' AS source_path, lower(replace('C:/In/Doc-' || (o_orderkey % 1000) || '.PDF', '/', chr(92))) AS source_path_key,
        sha256(CAST(o_custkey % 700 AS VARCHAR)) AS source_hash, {_STATES}[CAST(o_orderkey % 9 AS INT) + 1] AS status, CASE WHEN o_orderkey % 4 <> 0 THEN 's' || (o_orderkey % 13) END AS owner_session,
        o_orderkey % 500 AS lease_expires_at, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey * 2 WHEN o_orderkey % 3 = 0 THEN o_orderkey * 2 + 1 END AS active_receipt_id,
        CASE WHEN o_orderkey % 6 <> 0 THEN 'Name ' || o_orderkey || CASE WHEN o_orderkey % 10 = 0 THEN '.txt' WHEN o_orderkey % 15 = 0 THEN '?.pdf' ELSE '.pdf' END END AS proposed_name
      FROM orders""",
    "receipts": f"""
      SELECT i AS id, k AS queue_item_id, CASE WHEN i % 5 = 0 THEN 'undo' ELSE 'apply' END AS direction, 'C:/In/Doc-' || (k % 1000) || '.PDF' AS source_path, 'C:/Out/Name ' || i || '.pdf' AS destination_path,
        sha256(CAST(c % 700 AS VARCHAR)) AS pre_hash, CASE WHEN i % 4 <> 0 THEN sha256(CAST(c % 700 AS VARCHAR)) END AS post_hash, {_STAGES}[CAST(i % 7 AS INT) + 1] AS stage
      FROM (SELECT o_orderkey AS k, o_custkey AS c, o_orderkey * 2 + n AS i FROM orders, (VALUES (0), (1)) v(n) WHERE o_orderkey % 3 <> 0)""",
    "files": """
      SELECT 'C:/In/Doc-' || p || '.PDF' AS path, CASE WHEN p % 9 <> 0 THEN sha256(CAST(c % 700 AS VARCHAR)) END AS sha256 FROM (SELECT o_orderkey % 1000 AS p, min(o_custkey) AS c FROM orders GROUP BY 1) WHERE p % 4 <> 1
      UNION ALL SELECT destination_path, CASE WHEN id % 11 = 0 THEN '0' ELSE pre_hash END FROM receipts WHERE id % 3 <> 0""",
    "sessions": "SELECT 's' || (r_regionkey * 2) AS session_id, r_regionkey * 60 + 100 AS heartbeat_at FROM region",
    "latest": "SELECT queue_item_id, max(id) AS id, arg_max(stage, id) AS stage, arg_max(direction, id) AS direction, arg_max(destination_path, id) AS destination_path, arg_max(source_path, id) AS source_path, arg_max(coalesce(post_hash, ''), id) AS post_hash FROM receipts GROUP BY queue_item_id",
    "item_events": f"""
      SELECT event_id // 8 AS id, event_id % 8 AS seq, CASE event_type WHEN 'signup' THEN 'claim' WHEN 'view' THEN 'claim' WHEN 'click' THEN 'demote' WHEN 'purchase' THEN 'approve' ELSE 'failure' END AS event,
        {_STATES}[CAST(event_id % 9 AS INT) + 1] AS from_status, {_STATES}[CAST((event_id // 2 + 1) % 9 AS INT) + 1] AS to_status FROM events""",
    "scans": """
      SELECT path, scan_no, max(event_id) // 300 AS size FROM (SELECT 'doc-' || user_id || '.pdf' AS path, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS scan_no, event_id FROM events) GROUP BY path, scan_no""",
    "claim_events": """
      SELECT 'k' || user_id AS key, event_id // 500 * 100000 AS ts, event_id AS seq, 'm' || (event_id % 3) AS machine_id,
        CASE event_type WHEN 'signup' THEN 'claim' WHEN 'view' THEN 'claim' WHEN 'click' THEN 'renew' WHEN 'purchase' THEN 'done' ELSE 'release' END AS event FROM events""",
    "words": r"""
      SELECT doc_id, r.rotation, i - 1 AS seq, w[i] AS word, CAST(CASE WHEN (doc_id * 7 + (i - 1) * 13 + r.rotation) % 17 = 0 THEN -1 ELSE (doc_id * 7 + (i - 1) * 13 + r.rotation) % 101 END AS DOUBLE) AS confidence
      FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id, string_split(replace(text, chr(10), ' '), ' ') AS w FROM documents)), (VALUES (0), (90), (180), (270)) r(rotation)""",
    "readings": "SELECT doc_id, rotation, coalesce(string_agg(word, ' ' ORDER BY seq) FILTER (WHERE trim(word) <> ''), '') AS text, coalesce(avg(confidence) FILTER (WHERE trim(word) <> '' AND confidence >= 0), 0.0) AS confidence FROM words GROUP BY doc_id, rotation",
    "inspections": """
      SELECT conv_id AS doc_id, turn AS page_index, CASE WHEN conv_id % 8 = 3 THEN '' WHEN conv_id % 9 = 0 THEN text || repeat(chr(65533), length(text) // 20 + 1) ELSE text END AS t, (conv_id % 4) / 4.0 AS coverage, 5000 * (conv_id % 6000) AS pixels FROM conversations""",
    "solid": r"SELECT doc_id, page_index, coverage, regexp_replace(t, '\s', '', 'g') AS s, len(regexp_extract_all(t, '[^\s]+')) AS n FROM inspections",
    "lines": "SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM contracts",
    "gold": f"""
      SELECT o_orderkey AS k, {_TYPES} AS g_type, {_ISO.format(0)} AS g_date, [{_ISO.format(30)}, {_ISO.format(-400)}] AS bad_dates, CASE WHEN o_orderkey % 5 <> 0 THEN c_name END AS g_party,
        (o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0 AND o_orderkey % 17 <> 0 AND o_orderkey % 19 <> 0 AND o_orderkey % 50 >= 10) AS clean
      FROM orders JOIN have h ON h.k = o_orderkey JOIN customer ON c_custkey = o_custkey""",
    # a result's party list is the customer, plus an invented name where the key says so
    "scores": """
      SELECT CAST(doc_id AS VARCHAR) AS file, pipeline, CASE WHEN doc_id % 97 = 0 THEN 'expected_error' WHEN doc_id % 101 = 0 THEN 'extraction_failed' ELSE 'completed' END AS status,
        CASE WHEN ok THEN coalesce(d = g_date, false) END AS date_correct, CASE WHEN ok THEN coalesce(d = g_date, false) END AS date_exact, CASE WHEN ok THEN coalesce(list_contains(bad_dates, d), false) END AS date_forbidden,
        CASE WHEN ok THEN d IS NOT NULL END AS date_present, CASE WHEN ok AND d IS NOT NULL THEN doc_id % 17 <> 0 END AS date_role_correct,
        CASE WHEN ok THEN doc_id % 13 <> 0 END AS type_correct, CASE WHEN ok THEN true END AS type_present,
        CASE WHEN ok AND g_party IS NOT NULL THEN doc_id % 11 <> 0 END AS parties_correct, CASE WHEN ok AND g_party IS NOT NULL THEN doc_id % 11 = 0 END AS party_forbidden,
        CASE WHEN ok THEN true END AS description_covers_facts, CASE WHEN ok THEN true END AS description_specific,
        CASE WHEN ok THEN clean = ready END AS readiness_match, CASE WHEN ok THEN ready END AS ready,
        CASE WHEN ok AND g_party IS NOT NULL THEN 1 END AS parties_matched, CASE WHEN ok AND g_party IS NOT NULL THEN 1 END AS parties_expected, CASE WHEN ok AND g_party IS NOT NULL THEN CAST(doc_id % 11 = 0 AS INT) END AS parties_spurious,
        doc_id % 41 + 10 AS extraction_millis, doc_id % 1009 + 5000 AS inference_millis
      FROM (SELECT *, NOT (doc_id % 97 = 0 OR doc_id % 101 = 0) AS ok, CASE WHEN pipeline = 'old' AND doc_id % 4 = 0 THEN NULL ELSE document_date END AS d, doc_id % 7 <> 0 AND doc_id % 13 <> 0 AND pipeline = 'new' AS ready
            FROM proposals, (VALUES ('new'), ('old')) v(pipeline)) JOIN gold ON gold.k = doc_id""",
}
_NEEDS = {
    "statements": ["contracts"], "proposals": ["have"], "gold": ["have"], "scores": ["proposals", "gold"], "files": ["receipts"], "latest": ["receipts"], "lines": ["contracts"], "readings": ["words"], "solid": ["inspections"],
}
FLAGS = "date_correct date_exact date_forbidden date_present date_role_correct type_correct type_present parties_correct party_forbidden description_covers_facts description_specific readiness_match ready".split()


def sql(body: str, *needs: str, head: str = "WITH") -> str:
    order: list[str] = []

    def add(name: str) -> None:
        for n in _NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for n in needs:
        add(n)
    tables = ", ".join(f"{n} AS ({DERIVED[n]})" for n in order)
    return f"{head} {tables} {body}" if order else body


_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lower(x: str) -> str:
    return f"translate({x}, '{_UP}', '{_LOW}')"


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _cues(x: str, cues: list[str]) -> str:
    return " + ".join(f"CAST(contains({_lower(x)}, {_quoted(c)}) AS INT)" for c in cues)


def _heading(x: str) -> str:
    n = f"length(regexp_replace({x}, '[^\\p{{L}}]', '', 'g'))"
    u = f"length(regexp_replace({x}, '[^\\p{{Lu}}]', '', 'g'))"
    words = f"len(regexp_extract_all({x}, '[^\\s]+'))"
    return f"(length(trim({x})) BETWEEN 1 AND 90 AND (trim({x}) LIKE '#%' OR (NOT (trim({x}) LIKE '%.' AND {words} > 6) AND {n} >= 3 AND {u} * 10 >= {n} * 8)))"


def _runs(source: str) -> str:
    return f"""
    l AS (SELECT doc_id, page, i, rtrim(w[i]) AS line FROM (SELECT doc_id, page, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id, page, string_split(text, chr(10)) AS w FROM {source}))),
    k AS (SELECT *, CASE WHEN line = '' THEN 'blank' WHEN {_heading("line")} THEN 'heading' WHEN ltrim(line) LIKE '|%' THEN 'table' ELSE 'body' END AS kind FROM l),
    b AS (SELECT *, CASE WHEN kind = 'heading' OR kind IS DISTINCT FROM lag(kind) OVER (PARTITION BY doc_id, page ORDER BY i) THEN 1 ELSE 0 END AS new FROM k),
    g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, page ORDER BY i) AS island FROM b),
    r AS (SELECT doc_id, kind, island, sum(length(line) + 1) - 1 AS n FROM g WHERE kind <> 'blank' GROUP BY doc_id, page, kind, island)
    SELECT doc_id, kind, count(*) AS n, CAST(sum(n) AS BIGINT) AS characters FROM r GROUP BY doc_id, kind"""


def _blocks(source: str) -> str:
    """Common table expressions up to blk: the runs of lines of source (doc_id, page, text) with their text, none of which is long enough to be cut."""
    chain = _runs(source).split("r AS (SELECT", 1)[0]
    return chain + "blk AS (SELECT doc_id, page, kind, island, string_agg(line, chr(10) ORDER BY i) AS joined FROM g WHERE kind <> 'blank' GROUP BY doc_id, page, kind, island)"


_DATES = r"len(list_filter(regexp_extract_all({0}, '[0-9]+'), lambda y: length(y) = 4 AND CAST(y AS INT) BETWEEN 1900 AND 2199))"
_IDENT = r"len(list_filter(list_transform(regexp_extract_all({0}, '[^\s]+'), lambda w: regexp_replace(regexp_replace(w, '^[^0-9A-Za-z]+', ''), '[^0-9A-Za-z]+$', '')), lambda w: length(regexp_replace(w, '[^A-Za-z]', '', 'g')) >= 2 AND length(regexp_replace(w, '[^0-9]', '', 'g')) >= 2 AND length(w) <= 24)) > 0"
# bytes as pairs of hexadecimal digits: $ or A3, and a digit within three
_MONEY = "(regexp_matches(hex(encode({0})), '^(..)*(24|A3)(..)?(..)?3[0-9]') OR regexp_matches({0}, '(?i)usd |eur '))"
_MOVE = "(" + ", ".join(_quoted(f"{a}>{b}") for a, bs in L.STATUS_MOVES.items() for b in bs) + ")"
_NAMED = "(" + ", ".join(_quoted(f"{e}:{a}>{b}") for e, moves in L.NAMED_MOVES.items() for a, b in moves) + ")"
_STAGE = "(" + ", ".join(_quoted(f"{a}>{b}") for a, bs in L.STAGE_MOVES.items() for b in bs) + ")"
_LONG = " UNION ALL ".join(f"SELECT pipeline, '{f}' AS flag, {f} AS v FROM scores" for f in FLAGS)
_RATES = f"rates AS (SELECT pipeline, flag, count(*) FILTER (WHERE v) AS correct, count(*) AS total, count(*) FILTER (WHERE v) / count(*) AS rate FROM ({_LONG}) WHERE v IS NOT NULL GROUP BY pipeline, flag)"
_REVIEW = "review AS (SELECT pipeline, 1 - count(*) FILTER (WHERE ready) / greatest(count(*), 1) AS rate, count(*) AS evaluated FROM scores WHERE status = 'completed' GROUP BY pipeline)"
_NAMEDRATE = """named AS (SELECT p.pipeline, coalesce(good / n, 1.0) AS rate, coalesce(n, 0) AS n, coalesce(n - good, 0) AS n_wrong FROM (SELECT DISTINCT pipeline FROM scores) p
 LEFT JOIN (SELECT pipeline, count(*) FILTER (WHERE date_correct) AS good, count(*) AS n FROM scores WHERE ready AND date_correct IS NOT NULL GROUP BY pipeline) f ON f.pipeline = p.pipeline)"""
_DRIFT = "drift AS (SELECT id, CASE WHEN f.sha256 IS NULL THEN 'IO_ERROR' WHEN f.sha256 <> source_hash THEN 'FILE_CHANGED' END AS error_code FROM items LEFT JOIN files f ON f.path = source_path WHERE status = 'ready')"


def oracle_sql() -> dict[str, str]:
    conversations = "(SELECT conv_id AS doc_id, turn + 1 AS page, text FROM conversations)"
    out = {
        "a05_sizes": f"SELECT doc_id, count(*) AS page_count, CAST(sum(length(text)) AS BIGINT) AS source_characters FROM {conversations} GROUP BY doc_id",
        "w01_runs": "WITH " + _runs("(SELECT doc_id, 1 AS page, text FROM documents)"),
        "x_signals": sql(
            f"""SELECT doc_id, CAST(sum({_DATES.format("line")}) AS BIGINT) AS dates, {", ".join(f"CAST(sum({_cues('line', cues)}) AS BIGINT) AS {k}_cues" for k, cues in T.CUES.items())},
            CAST(sum(CAST({_IDENT.format("line")} AS INT)) AS BIGINT) AS identifiers, CAST(sum(CAST({_MONEY.format("line")} AS INT)) AS BIGINT) AS money,
            CAST(sum(CAST({_heading("line")} AS INT)) AS BIGINT) AS headings, count(DISTINCT lower(regexp_replace(line, '[0-9]+', '#', 'g'))) AS shapes FROM lines GROUP BY doc_id""",
            "lines",
        ),
        "p05_headings": f"SELECT doc_id, count(*) AS headings FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE {_heading('line')} GROUP BY doc_id",
        "x04_cue_histogram": " UNION ALL ".join(
            f"SELECT {_quoted(f'{k}:{c}')} AS cue, count(*) AS documents FROM documents WHERE contains({_lower('text')}, {_quoted(c)}) HAVING count(*) > 0" for k, cues in T.CUES.items() for c in cues
        ),
        "x01_evidence_text": r"SELECT doc_id, sha256(trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\s+', ' ', 'g'))) AS normal_sha256 FROM documents",
        "d03_dates": """SELECT o_orderkey, day(o_orderdate) || CASE WHEN day(o_orderdate) BETWEEN 11 AND 13 THEN 'th' WHEN day(o_orderdate) % 10 = 1 THEN 'st' WHEN day(o_orderdate) % 10 = 2 THEN 'nd' WHEN day(o_orderdate) % 10 = 3 THEN 'rd' ELSE 'th' END AS nth,
            true AS valid, try_cast(strftime(o_orderdate, '%Y-%m-') || lpad(CAST(o_orderkey % 33 AS VARCHAR), 2, '0') AS DATE) IS NOT NULL AS odd_valid, true AS rendered FROM orders""",
        "x08_segments": r"""SELECT p_partkey, regexp_replace(trim(regexp_replace(regexp_replace(' ' || p_type || ': ' || p_name || ' / ' || p_brand || ' .. ', '[<>:"/\\|?*]', '', 'g'), '\s+', ' ', 'g')), '[ .]+$', '') AS segment,
            lower(regexp_replace(' ' || p_type || ': ' || p_name || ' / ' || p_brand || ' .. ', '[ .]+$', '')) AS name_key, left(lower(regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g')), 16) AS extension FROM part""",
        "x13_path_keys": sql("SELECT id, source_path_key AS path_key, sha256(lower(source_path) || '|' || id || '|' || lease_expires_at) AS document_key, string_split(source_path, '/')[3] AS leaf, 'pdf' AS extension FROM items", "items"),
        "e01_scores": sql("SELECT * FROM scores", "scores"),
        "e08_flags": sql(f", {_RATES} SELECT pipeline, flag, correct, total, round(rate, 6) AS rate FROM rates", "scores"),
        "e09_review_rate": sql(f", {_REVIEW} SELECT pipeline, round(rate, 6) AS rate, evaluated FROM review", "scores"),
        "e10_latency": sql(
            """, l AS (SELECT pipeline, 'inference' AS measure, inference_millis AS v FROM scores WHERE status = 'completed' UNION ALL SELECT pipeline, 'total', inference_millis + extraction_millis FROM scores WHERE status = 'completed')
            SELECT pipeline, measure, count(*) AS n, min(v) AS least, list_sort(list(v))[count(*) // 2 + 1] AS median, max(v) AS most, CAST(sum(v) // count(*) AS BIGINT) AS mean FROM l GROUP BY pipeline, measure""",
            "scores",
        ),
        "e11_named": sql(f", {_NAMEDRATE} SELECT pipeline, round(rate, 6) AS rate, n, n_wrong FROM named", "scores"),
        "e12_gates": sql(
            f""", {_RATES}, {_REVIEW}, {_NAMEDRATE},
            every AS (SELECT pipeline, flag AS gate, rate FROM rates UNION ALL SELECT pipeline, 'review_rate', rate FROM review UNION ALL SELECT pipeline, 'date_correct_when_named', rate FROM named),
            gates(gate, least, most) AS (VALUES ('date_correct', 0.75, NULL), ('date_correct_when_named', 1.0, NULL), ('type_correct', 0.7, NULL), ('parties_correct', 0.6, NULL), ('description_specific', 0.9, NULL), ('date_forbidden', NULL, 0.0), ('party_forbidden', NULL, 0.25), ('review_rate', NULL, 0.6))
            SELECT pipeline, gate, round(rate, 6) AS value FROM every JOIN gates USING (gate) WHERE rate < least OR rate > most""",
            "scores",
        ),
        "j17_compare": sql(
            f""", a AS (SELECT * FROM scores WHERE pipeline = 'new'), b AS (SELECT * FROM scores WHERE pipeline = 'old')
            SELECT file, a.status AS status_a, b.status AS status_b, a.ready AS ready_a, b.ready AS ready_b, array_to_string(list_filter([{", ".join(f"CASE WHEN a.{f} IS DISTINCT FROM b.{f} THEN '{f}' END" for f in FLAGS)}], lambda x: x IS NOT NULL), ',') AS changed
            FROM a FULL JOIN b USING (file)""",
            "scores",
        ),
        "j16_audit": "SELECT CAST(doc_id AS VARCHAR) AS file, CASE doc_id % 10 WHEN 3 THEN 'missing' WHEN 4 THEN 'extra' WHEN 5 THEN 'changed' ELSE 'match' END AS state FROM documents",
        "j08_items": sql("SELECT i.id, i.status, CASE WHEN i.id % 6 <> 0 THEN 'p' || i.id END AS proposal_json, l.id AS receipt_id, l.stage FROM items i LEFT JOIN latest l ON l.queue_item_id = i.id", "items", "latest"),
        "j09_active": sql("SELECT i.id AS item_id, r.id AS receipt_id FROM items i JOIN receipts r ON r.id = i.active_receipt_id AND r.queue_item_id = i.id", "items", "receipts"),
        "j10_abandoned": sql(
            """SELECT id, CASE WHEN status = 'applying' THEN 'reconcile' ELSE 'recover' END AS action FROM items i WHERE status IN ('extracting', 'analyzing', 'applying') AND (owner_session IS NULL
            OR NOT EXISTS (SELECT 1 FROM sessions s WHERE s.session_id = i.owner_session) OR (lease_expires_at <= 300 AND EXISTS (SELECT 1 FROM sessions s WHERE s.session_id = i.owner_session AND s.heartbeat_at <= 240)))""",
            "items", "sessions",
        ),
        "j11_new_files": sql(
            """, found AS (SELECT upper(source_path) AS path, lower(replace(source_path, '/', chr(92))) AS source_path_key, CASE WHEN id % 3 = 0 THEN 'new' ELSE source_hash END AS source_hash FROM items)
            SELECT min(path) AS path, source_path_key, source_hash FROM found f WHERE NOT EXISTS (SELECT 1 FROM items i WHERE i.id % 7 <> 0 AND i.source_path_key = f.source_path_key AND i.source_hash = f.source_hash) GROUP BY source_path_key, source_hash""",
            "items",
        ),
        "j12_drift": sql(f", {_DRIFT} SELECT id, CASE WHEN error_code IS NULL THEN 'apply' ELSE 'needs_review' END AS outcome, error_code FROM drift", "items", "files"),
        "t02_apply_plan": sql(
            f""", {_DRIFT}, p AS (SELECT id, coalesce(error_code, CASE WHEN contains(proposed_name, '?') THEN 'INVALID_NAME' WHEN proposed_name LIKE '%.txt' THEN 'EXTENSION_CHANGED' END) AS refusal FROM drift JOIN items USING (id) WHERE proposed_name IS NOT NULL)
            SELECT id, refusal IS NULL AS planned, refusal FROM p""",
            "items", "files",
        ),
        "j18_fates": sql(
            """, n AS (SELECT source_path AS path, max(id) AS id, arg_max(status, id) AS status FROM items GROUP BY source_path),
            f AS (SELECT path, n.id, CASE WHEN n.status = 'completed' AND direction = 'apply' AND stage = 'complete' THEN 'renamed' WHEN n.status = 'completed' THEN 'kept_original' WHEN n.status = 'canceled' THEN 'unknown' END AS fate, destination_path FROM n LEFT JOIN latest l ON l.queue_item_id = n.id)
            SELECT path, id AS item_id, fate, CASE WHEN fate = 'renamed' THEN string_split(destination_path, '/')[3] END AS name FROM f""",
            "items", "latest",
        ),
        "j19_reconcile": sql(
            """, r AS (SELECT id, stage, s.sha256 IS NOT NULL AS src, d.sha256 IS NOT NULL AS dst, coalesce(s.sha256 = pre_hash, false) AS same_s, coalesce(d.sha256 = coalesce(post_hash, pre_hash), false) AS same_d
              FROM receipts LEFT JOIN files s ON s.path = source_path LEFT JOIN files d ON d.path = destination_path)
            SELECT id, CASE WHEN stage NOT IN ('published', 'complete') AND same_s AND NOT dst THEN 'roll_back' WHEN stage = 'published' AND same_d AND NOT src THEN 'complete' WHEN stage = 'published' AND same_d AND same_s THEN 'delete_source'
              WHEN stage = 'complete' AND same_d AND NOT src THEN 'complete' ELSE 'manual' END AS action FROM r""",
            "receipts", "files",
        ),
        "a12_exclusive": sql("SELECT queue_item_id, count(*) AS n FROM receipts WHERE stage NOT IN ('complete', 'rolled_back') GROUP BY queue_item_id HAVING count(*) > 1", "receipts"),
        "a13_retries": """WITH e AS (SELECT event_id // 8 AS item, event_id % 8 AS seq, event_type FROM events), r AS (SELECT item, max(seq) FILTER (WHERE event_type = 'signup') AS last FROM e GROUP BY item),
            f AS (SELECT e.item, count(*) FILTER (WHERE event_type IN ('click', 'purchase', 'error') AND seq > coalesce(last, -1)) AS failures FROM e JOIN r USING (item) GROUP BY e.item)
            SELECT item, CAST(failures AS INT) AS failures, CASE WHEN failures >= 2 THEN 'failed' ELSE 'queued' END AS status FROM f""",
        "a14_status": sql(f"SELECT CAST(list_position({_STATES}, status) AS INT) AS rank, status, count(*) AS n FROM items GROUP BY status", "items"),
        "a15_same_content": "SELECT sha256(text) AS source_hash, count(DISTINCT doc_id) AS n, min('doc-' || doc_id) AS first FROM documents GROUP BY 1 HAVING count(DISTINCT doc_id) > 1",
        "w09_latest": sql("SELECT queue_item_id, id, stage FROM latest", "latest"),
        "w10_stages": f"""WITH e AS (SELECT event_id // 6 AS id, event_id % 6 AS seq, {_STAGES}[CAST((event_id // 2) % 7 AS INT) + 1] AS after FROM events), l AS (SELECT *, lag(after) OVER (PARTITION BY id ORDER BY seq) AS before FROM e)
            SELECT id, seq, before, after FROM l WHERE before IS NOT NULL AND before <> after AND before || '>' || after NOT IN {_STAGE}""",
        "w11_transitions": sql(f"SELECT id, seq, event, from_status, to_status FROM item_events WHERE from_status || '>' || to_status NOT IN {_MOVE} AND event || ':' || from_status || '>' || to_status NOT IN {_NAMED}", "item_events"),
        "st05_fold": sql(
            f""", f(item, seq, status, illegal) AS (SELECT DISTINCT id, CAST(-1 AS BIGINT), 'queued', 0 FROM item_events UNION ALL
              SELECT f.item, e.seq, CASE WHEN f.status || '>' || e.to_status IN {_MOVE} OR e.event || ':' || f.status || '>' || e.to_status IN {_NAMED} THEN e.to_status ELSE f.status END,
                f.illegal + CASE WHEN f.status || '>' || e.to_status IN {_MOVE} OR e.event || ':' || f.status || '>' || e.to_status IN {_NAMED} THEN 0 ELSE 1 END
              FROM f JOIN item_events e ON e.id = f.item AND e.seq = (SELECT min(n.seq) FROM item_events n WHERE n.id = f.item AND n.seq > f.seq))
            SELECT item, arg_max(status, seq) AS status, CAST(max(illegal) AS INT) AS illegal FROM f GROUP BY item""",
            "item_events", head="WITH RECURSIVE",
        ),
        "w14_revisions": sql(
            """SELECT id AS item, CAST(1 + count(*) FILTER (WHERE seq <> 0 AND event IN ('demote', 'approve')) AS BIGINT) AS revision, arg_max('n' || seq, seq) FILTER (WHERE event = 'approve') AS filename FROM item_events GROUP BY id""",
            "item_events",
        ),
        "s11_upsert": """SELECT o_orderkey AS queue_item_id, CASE WHEN o_orderkey % 2 = 0 AND o_custkey % 10 >= o_orderkey % 10 THEN 'new' ELSE 'old' END AS proposal_json,
            CAST(CASE WHEN o_orderkey % 2 = 0 THEN greatest(o_custkey % 10, o_orderkey % 10) ELSE o_orderkey % 10 END AS BIGINT) AS created_at FROM orders""",
        "p07_views": sql(
            """SELECT 'queue' AS view, count(*) AS n FROM items WHERE status <> 'completed' UNION ALL SELECT 'review', count(*) FROM items WHERE status = 'needs_review' UNION ALL SELECT 'completed', count(*) FROM items WHERE status = 'completed'
            UNION ALL SELECT 'waiting', count(*) FROM items WHERE status = 'queued' UNION ALL SELECT 'ready', count(*) FROM items WHERE status = 'ready' AND proposed_name IS NOT NULL""",
            "items",
        ),
        "p08_undoable": sql(
            """SELECT i.id FROM items i JOIN latest l ON l.queue_item_id = i.id WHERE i.status = 'completed' AND l.direction = 'apply' AND l.stage = 'complete' AND NOT EXISTS (SELECT 1 FROM files f WHERE f.path = l.source_path)
            AND EXISTS (SELECT 1 FROM files f WHERE f.path = l.destination_path AND f.sha256 = l.post_hash)""",
            "items", "latest", "files",
        ),
        "p09_retained": sql("SELECT status, count(*) AS n FROM items WHERE status IN ('extracting', 'analyzing', 'applying') GROUP BY status", "items"),
        "j13_roots": """WITH f AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS path FROM pages), h AS (SELECT page_id, path, string_split(path, '/')[1] AS host FROM f)
            SELECT page_id, CASE WHEN lower(path) = lower(host) || '/fr' OR starts_with(lower(path), lower(host) || '/fr/') THEN 'french' ELSE 'host' END AS kind,
            CASE WHEN lower(path) = lower(host) || '/fr' OR starts_with(lower(path), lower(host) || '/fr/') THEN host || '/FR/' ELSE upper(host) END AS root FROM h""",
        "w12_stable": sql(
            """SELECT path, scan_no, size, coalesce(lag(scan_no) OVER w = scan_no - 1 AND lag(size) OVER w = size, false) AS stable FROM scans WINDOW w AS (PARTITION BY path ORDER BY scan_no)""", "scans",
        ),
        "a09_origins": sql("SELECT key, arg_min(machine_id, ts * 10 + CAST(substr(machine_id, 2) AS INT)) AS machine_id FROM claim_events GROUP BY key", "claim_events"),
        "a11_retention": sql(
            """, a AS (SELECT seq, CASE WHEN seq % 7 <> 0 AND seq % 5 <> 0 THEN 2700000 - CASE WHEN seq % 3 = 0 AND event = 'done' THEN CASE WHEN seq % 2 = 0 THEN ts + 100 ELSE ts END WHEN seq % 3 = 0 THEN ts + 60 WHEN seq % 3 = 1 THEN ts + 5 ELSE ts + 9 END < 2592000
              ELSE 2700000 - ts < 86400 END AS keep FROM claim_events) SELECT seq, keep FROM a""",
            "claim_events",
        ),
        "a02_readings": sql("SELECT doc_id, rotation, sha256(text) AS text_sha256, round(confidence, 4) AS confidence FROM readings", "readings"),
        "a03_best": sql(
            """, t AS (SELECT *, CASE WHEN rotation = [0, 90, 180, 270][CAST(doc_id % 4 AS INT) + 1] THEN 0 ELSE list_position([270, 90, 180, 0], rotation) END AS turn FROM readings),
            s AS (SELECT *, min(CASE WHEN confidence >= 75 THEN turn END) OVER (PARTITION BY doc_id) AS stop FROM t)
            SELECT doc_id, arg_max(rotation, confidence * 1000000 - turn) AS rotation, round(max(confidence), 4) AS confidence FROM s WHERE stop IS NULL OR turn <= stop GROUP BY doc_id""",
            "readings",
        ),
        "p01_routes": sql(
            r"""SELECT doc_id, page_index, (length(regexp_replace(s, '[\x{FFFD}\x00-\x1F\x7F-\x{9F}]', '', 'g')) < 20 AND coverage >= 0.65) OR (CASE WHEN s = '' THEN 0 ELSE (length(s) - length(replace(s, chr(65533), ''))) / length(s) END) > 0.03 AS ocr,
            length(s) < 100 AND coverage >= 0.65 AND n <= 1 AS vision FROM solid""",
            "solid",
        ),
        "p03_limits": sql(
            """, p AS (SELECT doc_id, count(*) AS n, max(pixels) AS px FROM inspections GROUP BY doc_id)
            SELECT d.doc_id, CASE WHEN n_chars * 500000 > 1073741824 OR coalesce(p.n, 0) > 500 OR coalesce(p.px, 0) > 25000000 THEN 'RESOURCE_LIMIT_EXCEEDED' END AS error_code FROM documents d LEFT JOIN p ON p.doc_id = d.doc_id""",
            "inspections",
        ),
        "w08_vision": sql("SELECT doc_id, min(page_index) AS page_index FROM solid WHERE (length(s) < 100 AND coverage >= 0.65 AND n <= 1) OR (doc_id % 11 = 0 AND doc_id < 75) GROUP BY doc_id", "solid"),
        "a04_warnings": """SELECT conv_id AS doc_id, array_to_string(list_filter([CASE WHEN conv_id % 5 = 0 THEN 'NATIVE_TEXT_CORRUPT' END, CASE WHEN conv_id % 2 = 0 AND bool_or((turn + 1) % 3 = 0) THEN 'LOW_OCR_CONFIDENCE' END,
            CASE WHEN bool_or(turn > 6) THEN 'TEXT_TRUNCATED' END], lambda x: x IS NOT NULL), ',') AS codes FROM conversations GROUP BY conv_id""",
        "t03_unseen": sql("SELECT DISTINCT key FROM claim_events c WHERE NOT EXISTS (SELECT 1 FROM claim_events d WHERE d.key = c.key AND d.event = 'done' AND d.machine_id = 'm1')", "claim_events"),
        "k05_domains": sql("SELECT 'old' AS pipeline, 'date_role' AS \"column\", 'due' AS value, count(*) AS n FROM proposals", "proposals"),
        "k02_decode": sql(
            """SELECT doc_id, document_type, document_date, party_relation, CAST(len(parties) AS BIGINT) AS n_parties, true AS good FROM proposals WHERE doc_id % 29 <> 0
            UNION ALL SELECT doc_id, NULL, NULL, NULL, NULL, false FROM proposals WHERE doc_id % 29 = 0""",
            "proposals",
        ),
        "c02_validate": sql(
            r""", seg AS (SELECT doc_id, lower(text) AS s FROM contracts),
            v AS (SELECT p.doc_id, p.c_name, CASE WHEN doc_id % 13 = 0 THEN NULL ELSE document_type END AS kind, document_date IS NULL AS no_date, document_date, doc_id % 17 = 0 OR true AS ok, party_relation,
              CAST(doc_id % 50 AS FLOAT) / 100 + 0.5 AS conf FROM proposals p)
            SELECT doc_id, kind AS document_type, document_date, CASE WHEN document_date IS NOT NULL THEN 'invoice' END AS date_role, c_name AS parties, CASE WHEN party_relation = 'between' THEN 'with' ELSE party_relation END AS party_relation,
              CASE WHEN reasons = '' THEN 'ready' ELSE 'needs_review' END AS status, reasons FROM (
              SELECT *, array_to_string(list_filter([CASE WHEN kind IS NULL THEN 'TYPE_UNSUPPORTED' END, CASE WHEN no_date THEN 'DATE_MISSING' END, CASE WHEN doc_id % 11 = 0 THEN 'PARTY_UNSUPPORTED' END,
                CASE WHEN doc_id % 50 < 10 THEN 'LOW_CONFIDENCE' END, CASE WHEN doc_id % 19 = 0 THEN 'MODEL_REQUESTED_REVIEW' END], lambda x: x IS NOT NULL), ',') AS reasons FROM v)""",
            "contracts", "proposals",
        ),
    }
    named = """, n AS (SELECT doc_id, folder, stem, lower(stem) AS key, row_number() OVER (PARTITION BY folder, lower(stem) ORDER BY doc_id) AS rn, one, two FROM base),
        k AS (SELECT doc_id, folder, stem, CAST(CASE WHEN one AND two THEN rn + 2 WHEN one THEN rn + 1 WHEN two AND rn > 1 THEN rn + 1 ELSE rn END AS INT) AS collision_index FROM n)"""
    file = "stem || CASE WHEN collision_index > 1 THEN ' (' || collision_index || ')' ELSE '' END || '.pdf'"
    checked = out["c02_validate"]
    decided = """, d AS (SELECT path || '#' || scan_no AS key, path, size AS m, (scan_no * 7 + size) % 6 AS n FROM scans),
        decided AS (SELECT key, CASE WHEN n < 2 THEN CASE WHEN n = 0 THEN 'mine_' ELSE 'other_' END || CASE WHEN m % 2 = 0 THEN 'done' ELSE 'claimed' END WHEN n = 2 THEN 'claim'
          WHEN n = 3 OR path IN (SELECT path FROM d WHERE n = 4) THEN CASE WHEN 130 - m >= 120 THEN 'claim' ELSE 'hold' END ELSE 'claim_new_local' END AS decision FROM d)"""
    digest = f""", {_blocks("(SELECT doc_id, 1 AS page, text FROM contracts)")},
        dl AS (SELECT doc_id, d, min(island * 1000 + p) AS place FROM (SELECT doc_id, island, trim(w[p]) AS d, p FROM (SELECT doc_id, island, w, unnest(range(1, len(w) + 1)) AS p FROM (SELECT doc_id, island, string_split(joined, chr(10)) AS w FROM blk))) WHERE {_DATES.format("d")} > 0 GROUP BY doc_id, d),
        ds AS (SELECT doc_id, list(d ORDER BY place)[1:14] AS ds FROM dl GROUP BY doc_id),
        bs AS (SELECT doc_id, string_agg(CASE WHEN kind = 'heading' THEN trim(joined) ELSE joined END || chr(10) || chr(10), '' ORDER BY island) AS body, count(*) AS n_blocks, count(*) FILTER (WHERE kind = 'heading') AS n_headings FROM blk GROUP BY doc_id),
        digests AS (SELECT c.doc_id, length(c.text) AS source_characters, n_blocks, n_headings, coalesce(len(ds), 0) AS n_dates,
          rtrim(CASE WHEN len(ds) > 1 THEN 'EVERY DATE IN THIS DOCUMENT, WITH ITS OWN WORDS:' || chr(10) || array_to_string(list_transform(ds, lambda x: '- ' || x || chr(10)), '') || chr(10) ELSE '' END || '[Page 1]' || chr(10) || body, chr(10) || ' ') AS text
          FROM contracts c JOIN bs ON bs.doc_id = c.doc_id LEFT JOIN ds ON ds.doc_id = c.doc_id)"""
    out |= {
        "k04_legacy_replies": sql(
            """SELECT doc_id, CASE WHEN ok THEN document_type END AS document_type, CASE WHEN ok THEN document_date END AS document_date, CASE WHEN ok THEN 'issue' END AS date_kind, CASE WHEN ok THEN c_name END AS subject, CAST(NULL AS VARCHAR) AS party,
            CASE WHEN ok THEN doc_id % 4 = 0 END AS needs_review FROM (SELECT *, doc_id % 5 <> 0 AS ok FROM proposals)""",
            "proposals",
        ),
        "st09_progress": "SELECT item, CASE WHEN last % 3 <> 0 THEN least(CAST(last % 150 AS DOUBLE), 100.0) END AS percent FROM (SELECT event_id % 500 AS item, max(event_id) AS last FROM events GROUP BY 1)",
        "k03_unwrapped": "SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 7 <> 0 THEN sha256(text || CASE WHEN (conv_id + turn) % 5 = 0 THEN ' end' ELSE '' END) END AS content_sha256 FROM conversations",
        "s04_events": """SELECT conv_id || '-' || turn AS request_id, CAST(turn + 1 AS INT) AS page_number, sha256(text) AS text_sha256 FROM conversations WHERE turn % 7 <> 6 AND turn % 5 <> 4
            UNION ALL SELECT CAST(count(*) FILTER (WHERE turn % 7 = 6 OR turn % 5 = 4) AS VARCHAR), NULL, NULL FROM conversations""",
        "s05_checked": """WITH p AS (SELECT conv_id AS k, CASE WHEN conv_id % 11 = 0 THEN turn WHEN conv_id % 13 = 0 AND turn = 1 THEN 1 ELSE turn + 1 END AS n FROM conversations),
            b AS (SELECT k FROM p GROUP BY k HAVING count(*) <> count(DISTINCT n) OR min(n) < 1 OR (k % 11 <> 0 AND (k % 19 = 0 OR count(*) FILTER (WHERE n = CASE WHEN k % 17 = 0 THEN 99 ELSE 1 END) = 0)))
            SELECT k AS doc_id, CAST(n AS INT) AS page_number, CAST(least(greatest(round(k % 130 - 10.4), 0), 100) AS INT) AS ocr_confidence, true AS good FROM p WHERE k NOT IN (SELECT k FROM b) UNION ALL SELECT k, NULL, NULL, false FROM b""",
        "s06_gold": sql(
            """SELECT CAST(k AS VARCHAR) AS file, g_type AS document_type, g_date AS document_date, array_to_string(bad_dates, ',') AS forbidden_dates, g_party AS parties, CASE WHEN clean THEN 'ready' ELSE 'needs_review' END AS expected_readiness,
            CASE WHEN k % 97 = 0 THEN 'PARSE_FAILED' END AS expected_error, 0 AS n_types, true AS silent FROM gold""",
            "gold",
        ),
        "s07_lifecycle": sql(
            """SELECT id, status, 0 AS processing_failures, CASE WHEN id % 8 = 0 THEN 'IO_ERROR' ELSE 'NONE' END AS error_code, true AS lacks FROM items UNION ALL SELECT id, stage, 1, direction, true FROM receipts UNION ALL SELECT heartbeat_at, session_id, 2, 's', false FROM sessions""",
            "items", "receipts", "sessions",
        ),
        "s09_analysis": sql("SELECT doc_id, document_type, document_date, party_relation, 'A' AS reason, '7' AS characters, document_date IS NULL AS dateless FROM proposals", "proposals"),
        "s02_routes": """SELECT page_id, ['pdf', 'office', 'office', 'text', 'text', 'ocr', 'ocr', NULL, NULL][CAST(page_id % 9 AS INT) + 1] AS route, CASE WHEN page_id % 9 >= 7 THEN 'UNSUPPORTED_FORMAT' END AS error_code FROM pages""",
        "c01_distil_contracts": sql(f"{digest} SELECT doc_id, CAST(1 AS BIGINT) AS page_count, source_characters, CAST(length(text) AS BIGINT) AS digest_characters, false AS compressed, n_blocks AS block_count, n_blocks AS n_segments, n_headings AS n_outline, CAST(n_dates AS BIGINT) AS n_dates, sha256(text) AS text_sha256 FROM digests", "contracts"),
        "x21_prompts": sql(
            f"""{digest}, p AS (SELECT doc_id, {_quoted(jobs._ASK.split("{scope}")[0])} || {_quoted(jobs._WHOLE)} || {_quoted(jobs._ASK.split("{scope}")[1])} || text || chr(10) || '--- END DOCUMENT ---' || chr(10) AS prompt FROM digests)
            SELECT doc_id, sha256(prompt) AS prompt_sha256, CAST(length(prompt) AS INT) AS prompt_characters FROM p""",
            "contracts",
        ),
        "w01_runs_statements": sql(", " + _runs("statements"), "statements"),
        "a01_running_lines": sql(
            f""", {_blocks("statements")}, pg AS (SELECT doc_id, count(*) AS n FROM statements GROUP BY doc_id),
            sh AS (SELECT doc_id, lower(regexp_replace(trim(joined), '[0-9]+', '#', 'g')) AS shape, count(*) AS c, count(DISTINCT page) AS p FROM blk WHERE length(joined) <= 120 GROUP BY ALL),
            gone AS (SELECT sh.doc_id, sum(c - 1) AS gone FROM sh JOIN pg USING (doc_id) WHERE n >= 3 AND p >= greatest(n // 2, 3) GROUP BY sh.doc_id)
            SELECT blk.doc_id, count(*) AS blocks, CAST(count(*) - coalesce(any_value(gone), 0) AS BIGINT) AS left FROM blk LEFT JOIN gone ON gone.doc_id = blk.doc_id GROUP BY blk.doc_id""",
            "statements",
        ),
        "a06_outline": sql(
            f""", {_blocks("statements")} SELECT regexp_replace(trim(regexp_replace(trim(joined), '^#+', '')), ':+$', '') AS heading, count(*) AS n, count(DISTINCT doc_id) AS documents FROM blk WHERE kind = 'heading' GROUP BY 1""", "statements",
        ),
        "x18_legacy": sql(
            """, t AS (SELECT doc_id, string_agg('[Page ' || page || ']' || chr(10) || text, chr(10) ORDER BY page) AS t FROM statements GROUP BY doc_id)
            SELECT doc_id, CAST(CASE WHEN length(t) > 22000 THEN 2 ELSE 1 END AS BIGINT) AS n_segments, CAST(least(length(t), 22000) AS BIGINT) AS characters FROM t""",
            "statements",
        ),
        "a08_reasons": f"""WITH c AS ({checked}), r AS (SELECT status, unnest(CASE WHEN reasons = '' THEN ['NONE'] ELSE string_split(reasons, ',') END) AS reason FROM c)
            SELECT status, reason, count(*) AS n FROM r GROUP BY ROLLUP (status, reason)""",
        "c03_names": sql(
            f""", base0 AS (SELECT doc_id, 'f' || (doc_id % 5) AS folder, concat_ws(' ', substr(document_date, 1, 7), document_type) AS stem FROM proposals),
            there AS (SELECT DISTINCT folder, lower(stem) AS key, doc_id % 80 = 0 AS second FROM base0 WHERE doc_id % 40 = 0),
            base AS (SELECT b.*, EXISTS (SELECT 1 FROM there t WHERE t.folder = b.folder AND t.key = lower(b.stem) AND NOT second) AS one, EXISTS (SELECT 1 FROM there t WHERE t.folder = b.folder AND t.key = lower(b.stem) AND second) AS two FROM base0 b)
            {named} SELECT doc_id, folder, {file} AS filename, collision_index FROM k""",
            "proposals",
        ),
        "c04_replay": f"""WITH c AS ({checked}), p AS (SELECT doc_id, status, concat_ws(' ', document_date, coalesce(document_type, 'Document'), CASE party_relation WHEN 'none' THEN '-' ELSE party_relation END || ' ' || parties) AS stem, document_type IS NOT NULL AS typed FROM c),
            there AS (SELECT DISTINCT lower(stem) AS key FROM p WHERE doc_id % 8 = 0 AND typed),
            base AS (SELECT doc_id, 'in' AS folder, stem, EXISTS (SELECT 1 FROM there t WHERE t.key = lower(p.stem)) AS one, false AS two FROM p)
            {named} SELECT k.doc_id, p.status, {file.replace("stem", "k.stem")} AS filename, collision_index FROM k JOIN p ON p.doc_id = k.doc_id""",
        "x12_fitted": sql(
            """, q AS (SELECT doc_id, document_date AS d, document_type AS kind, party_relation AS rel, rtrim(repeat(parties[1] || ' ', CAST(doc_id % 5 + 1 AS INT))) AS a, rtrim(repeat(parties[2] || ' ', CAST(doc_id % 5 + 1 AS INT))) AS b FROM proposals),
            n AS (SELECT doc_id, concat_ws(' ', d, kind, CASE WHEN rel = 'none' THEN '- ' || a WHEN rel = 'between' AND b IS NOT NULL THEN 'between ' || a || ' and ' || b ELSE rel || ' ' || a END) AS whole,
              concat_ws(' ', d, kind, CASE WHEN rel = 'none' THEN '- ' || a WHEN rel = 'between' THEN 'with ' || a ELSE rel || ' ' || a END) AS fewer, concat_ws(' ', d, kind) AS bare FROM q)
            SELECT doc_id, CASE WHEN length(whole) <= 116 THEN whole WHEN length(fewer) <= 116 THEN fewer ELSE bare END || '.pdf' AS name FROM n""",
            "proposals",
        ),
        "c06_legacy": sql(
            """, v AS (SELECT p.doc_id, p.document_type, p.document_date, c_name, p.doc_id % 13 <> 0 AS typed, p.document_date IS NOT NULL AND p.doc_id % 7 <> 0 AND o_orderstatus <> 'P' AS dated, p.doc_id % 50 < 36 AS low FROM proposals p JOIN orders ON o_orderkey = p.doc_id)
            SELECT doc_id, CASE WHEN typed THEN document_type END AS document_type, CASE WHEN dated THEN document_date END AS document_date, c_name AS subject, CASE WHEN typed AND dated AND NOT low THEN 'ready' ELSE 'needs_review' END AS status,
              concat_ws(',', CASE WHEN NOT typed THEN 'TYPE_UNSUPPORTED' END, CASE WHEN NOT dated THEN 'DATE_UNSUPPORTED' END, CASE WHEN low THEN 'LOW_CONFIDENCE' END) AS reasons,
              concat_ws(' - ', CASE WHEN dated THEN document_date END, CASE WHEN typed THEN document_type END, c_name) || '.pdf' AS filename FROM v""",
            "proposals",
        ),
        "j14_decisions": sql(f"{decided} SELECT key, decision FROM decided", "scans"),
        "a10_status": sql(
            f"""{decided} SELECT count(*) FILTER (WHERE decision = 'hold') AS held_for_others, count(*) FILTER (WHERE decision = 'other_claimed') AS claimed_by_others, count(*) FILTER (WHERE decision = 'mine_done') AS processed_here,
            (SELECT string_agg(DISTINCT machine_id, ',' ORDER BY machine_id) FROM claim_events) AS machines FROM decided""",
            "scans", "claim_events",
        ),
        "st03_claims": sql(
            """, e AS (SELECT *, ts + 900 AS until, row_number() OVER (PARTITION BY key ORDER BY ts, event = 'claim', seq) AS rn FROM claim_events),
            f(key, rn, owner, state, lease, beat, refused) AS (SELECT DISTINCT key, CAST(0 AS BIGINT), CAST(NULL AS VARCHAR), 'free', CAST(0 AS BIGINT), CAST(0 AS BIGINT), 0 FROM e UNION ALL
              SELECT key, rn, CASE WHEN act = 'hold' OR act = 'done' THEN machine_id WHEN act = 'free' THEN NULL ELSE owner END, CASE act WHEN 'hold' THEN 'claimed' WHEN 'done' THEN 'done' WHEN 'free' THEN 'free' ELSE state END,
                CASE act WHEN 'hold' THEN until ELSE lease END, CASE act WHEN 'no' THEN beat ELSE ts END, refused + CASE act WHEN 'no' THEN 1 ELSE 0 END
              FROM (SELECT e.key, e.rn, e.ts, e.until, e.machine_id, f.owner, f.state, f.lease, f.beat, f.refused, CASE
                WHEN e.event = 'claim' AND (f.state = 'free' OR (f.state = 'claimed' AND (f.owner = e.machine_id OR (e.ts >= f.lease AND e.ts >= f.beat + 900)))) THEN 'hold'
                WHEN f.state = 'claimed' AND f.owner = e.machine_id THEN CASE e.event WHEN 'renew' THEN 'hold' WHEN 'done' THEN 'done' WHEN 'release' THEN 'free' ELSE 'no' END ELSE 'no' END AS act
                FROM f JOIN e ON e.key = f.key AND e.rn = f.rn + 1))
            SELECT key, nullif(arg_max(coalesce(owner, ''), rn), '') AS owner, arg_max(state, rn) AS state, CAST(max(refused) AS INT) AS refused FROM f GROUP BY key""",
            "claim_events", head="WITH RECURSIVE",
        ),
        "st06_leases": """WITH e AS (SELECT 's' || user_id AS owner, event_id % 3 AS item, event_id AS ts, greatest(event_id + event_id % 1200, event_id + 60) AS e FROM events),
            n AS (SELECT *, coalesce(lead(ts) OVER (PARTITION BY owner, item ORDER BY ts), 100000) AS nxt FROM e)
            SELECT owner, item, e AS ts, CAST(row_number() OVER (PARTITION BY owner, item ORDER BY ts) AS INT) AS failures FROM n WHERE nxt > e""",
        "st04_released": "SELECT path, due FROM (SELECT 'f' || (event_id % 700) AS path, arg_max(event_id - event_id % 90 + 120, event_id) AS due FROM events GROUP BY 1) WHERE due <= (SELECT max(event_id) + 60 FROM events)",
        "st11_pruned": sql(
            """, r AS (SELECT key || CASE WHEN seq % 5 = 0 THEN ' (copy).json' ELSE '.json' END AS file_name, seq, CASE WHEN seq % 7 <> 0 AND seq % 5 <> 0 THEN 2592000 + CASE WHEN event = 'done' THEN ts + 100 ELSE ts + 60 END ELSE 86400 + ts END AS due FROM claim_events)
            SELECT file_name, due FROM (SELECT file_name, arg_max(due, seq) AS due FROM r GROUP BY file_name) WHERE due <= 2700000""",
            "claim_events",
        ),
        "st08_changes": "SELECT key, ts, digest FROM (SELECT *, lag(digest) OVER w AS b, lag(ts) OVER w AS t FROM (SELECT 'k' || user_id AS key, event_id AS ts, event_id // 4 % 5 AS digest FROM events) WINDOW w AS (PARTITION BY key ORDER BY ts)) WHERE digest IS DISTINCT FROM b OR ts - t > 2592000",
        "st07_machines": "SELECT event_id * 3 // 600 * 600 AS start, count(DISTINCT user_id) AS machines FROM events GROUP BY 1",
        "t01_listing": sql("SELECT id, source_path AS path FROM items", "items"),
        "t04_live": sql("SELECT path, scan_no FROM scans WHERE path IN (SELECT path FROM scans WHERE scan_no % 3 = 0)", "scans"),
        "p04_barely_readable": "SELECT doc_id FROM documents WHERE length(text) < 200 AND doc_id % 2 = 0",
        "p13_fresh": sql("SELECT id, lease_expires_at - 20 < 450 AS renew, 420 - lease_expires_at >= 300 AS touch, 900 - lease_expires_at <= 600 AS active FROM items", "items"),
        "p12_review_rows": sql(
            """, v AS (SELECT i.*, CASE WHEN i.id % 5 = 4 THEN 'SOURCE_DELETE_FAILED' WHEN i.id % 8 = 0 THEN 'IO_ERROR' END AS err, l.id AS rid, l.stage, l.direction FROM items i LEFT JOIN latest l ON l.queue_item_id = i.id)
            SELECT id, string_split(source_path, '/')[3] AS original, status, CASE WHEN status <> 'queued' THEN proposed_name END AS filename, CASE WHEN status <> 'queued' THEN 'T' || (id % 3) END AS document_type, CASE WHEN status <> 'queued' THEN '2024-01-02' END AS document_date,
              CASE WHEN status <> 'queued' THEN 'A; B' END AS parties, CASE WHEN id % 4 = 0 THEN 'X, Y' ELSE err END AS reason, CASE WHEN status = 'needs_review' AND err = 'SOURCE_DELETE_FAILED' AND direction = 'apply' AND stage = 'published' THEN rid END AS reconciliation_receipt FROM v""",
            "items", "latest",
        ),
    }
    from . import digest_sql  # it builds on this module

    return out | digest_sql.oracle_sql()
