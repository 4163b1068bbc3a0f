"""Distillation in SQL, with what doesn't fit: cutting, scores, the greedy fill, marks.  Folds are list_reduce over a state."""

from __future__ import annotations

from ..functions import text as T
from ..operators import distill as D
from . import oracles as O

NL = "chr(10)"
#: Short dates such as 3/14/26; what stands around them is no digit.
_SHORT = r"len(regexp_extract_all(regexp_replace({0}, '([^0-9])', '\1\1', 'g'), '(^|[^0-9])[0-9]{{1,2}}(//|--)[0-9]{{1,2}}(//|--)[0-9]{{2}}([^0-9]|$)'))"


_YEARS = "len(list_filter(regexp_extract_all({0}, '[0-9]+'), lambda y: length(y) = 4 AND y BETWEEN '1900' AND '2199'))"


def _dates(x: str) -> str:
    return f"({_YEARS.format(x)} + {_SHORT.format(x)})"


def split(x: str, most: int) -> str:
    """The chunks of a text, as split_sentences makes them."""
    pieces = f"regexp_extract_all({x}, '[^.!?;\\n]*[.!?;\\n]|[^.!?;\\n]+')"
    full = rf"s.now <> '' AND regexp_matches(p.now, '[.!?;\n]$') AND length(s.now) + length(p.now) > {most}"
    fold = f"list_reduce(list_transform({pieces}, lambda p: {{'done': CAST([] AS VARCHAR[]), 'now': p}}), lambda s, p: CASE WHEN {full} THEN {{'done': list_append(s.done, s.now), 'now': p.now}} ELSE {{'done': s.done, 'now': s.now || p.now}} END)"
    peels = f"greatest(CAST(ceil((length(f.now) - {2 * most}) / {most}) AS INT), 0)"
    rest = f"substr(f.now, {peels} * {most} + 1)"
    whole = f"list_concat(f.done, list_transform(range({peels}), lambda k: substr(f.now, k * {most} + 1, {most})), CASE WHEN regexp_matches({rest}, '[^\\s]') THEN [{rest}] ELSE CAST([] AS VARCHAR[]) END)"
    cut = f"list_transform([{fold}], lambda f: {whole})[1]"
    return f"CASE WHEN length({x}) <= {most} THEN [{x}] ELSE list_transform([{cut}], lambda c: CASE WHEN len(c) > 0 THEN c ELSE [{x}] END)[1] END"


def digests(source: str, budget: int, passthrough: int) -> str:
    """Common table expressions up to digests, over source (doc_id, page, text)."""
    cue = {k: f"({O._cues('text', v)})" for k, v in T.CUES.items()}
    heading = "kind = 'heading'"
    one = lambda c, n: f"CASE WHEN {c} THEN {n} ELSE 0 END"
    score = " + ".join((
        "n_date * 30", "n_date_role * 45", "n_party * 22", "n_type * 26", "n_subject * 24", "n_signature * 14", one(heading, 40), one("kind = 'table'", 10), one(O._IDENT.format("text"), 14), one(O._MONEY.format("text"), 8),
        one("opening", 60), one("closing", 25), one("page = 1", 12), one("page = last_page", 8), one(f"n_boilerplate > 0 AND NOT {heading}", -70), one("length(text) < 25", -8), one("length(text) > 400", -6),
    ))
    must = f"n_boilerplate = 0 AND (opening OR n_date_role > 0 OR (n_date > 0 AND page = 1) OR (n_party > 0 AND n_type > 0) OR n_subject > 0 OR (closing AND n_signature > 0) OR ({heading} AND (n_type > 0 OR n_date > 0)))"
    state = "{'used': CAST(0 AS BIGINT), 'kept': CAST([] AS BIGINT[]), 'cost': CAST(0 AS BIGINT), 'idx': CAST(0 AS BIGINT)}"
    entry = "{'used': CAST(0 AS BIGINT), 'kept': CAST([] AS BIGINT[]), 'cost': CAST(length(text) + 2 AS BIGINT), 'idx': CAST(idx AS BIGINT)}"
    take = f"s.used < {budget} AND (s.used + x.cost <= {budget} OR len(s.kept) = 0)"
    mark = f"CASE WHEN before IS NULL THEN '[Page ' || page || ']' || {NL} WHEN before_page <> page THEN {NL} || '[Page ' || page || ']' || {NL} WHEN before + 1 <> idx THEN '[...]' || {NL} ELSE '' END"
    chain = O._runs(source).split("r AS (SELECT", 1)[0]
    return chain + rf"""
    src AS MATERIALIZED (SELECT * FROM {source}),
    runs AS (SELECT doc_id, page, kind, island, string_agg(line, {NL} ORDER BY i) AS joined FROM g WHERE kind <> 'blank' GROUP BY doc_id, page, kind, island),
    cut AS (SELECT doc_id, page, kind, island, CASE WHEN kind = 'heading' THEN [trim(joined)] ELSE {split("joined", D.BLOCK_CHARACTERS)} END AS c FROM runs),
    chunk AS (SELECT doc_id, page, kind, island, part, regexp_replace(c[part], '\s+$', '') AS text FROM (SELECT *, unnest(range(1, len(c) + 1)) AS part FROM cut)),
    blocks AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, island, part) AS o FROM chunk WHERE regexp_matches(text, '[^\s]')),
    sizes AS (SELECT doc_id, count(*) AS n_pages, max(page) AS last_page, CAST(sum(length(text)) AS BIGINT) AS source_characters FROM src GROUP BY doc_id),
    shaped AS (SELECT b.*, n_pages, last_page, CASE WHEN length(text) <= {D.RUNNING_CHARACTERS} THEN lower(regexp_replace(trim(text), '[0-9]+', '#', 'g')) END AS shape FROM blocks b JOIN sizes USING (doc_id)),
    counted AS (SELECT *, count(DISTINCT page) OVER (PARTITION BY doc_id, shape) AS on_pages, row_number() OVER (PARTITION BY doc_id, shape ORDER BY o) AS nth FROM shaped),
    left_blocks AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY o) - 1 AS idx, count(*) OVER (PARTITION BY doc_id) AS total FROM counted WHERE NOT (n_pages >= 3 AND shape IS NOT NULL AND on_pages >= greatest(n_pages // 2, 3) AND nth > 1)),
    told AS (SELECT *, idx < 4 AS opening, idx + 3 >= total AS closing, {_dates("text")} AS n_date, {", ".join(f"{v} AS n_{k}" for k, v in cue.items())} FROM left_blocks),
    scored AS MATERIALIZED (SELECT *, {score} AS score, {must} AS must FROM told),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY must DESC, score DESC, o) AS rank, CASE WHEN NOT must THEN lower(regexp_replace(left(text, 80), '[0-9]+', '#', 'g')) END AS look FROM scored),
    wanted AS (SELECT *, look IS NOT NULL AND row_number() OVER (PARTITION BY doc_id, look ORDER BY rank) > 1 AS repeat FROM ranked),
    filled AS (SELECT doc_id, list_reduce(list_prepend({state}, list({entry} ORDER BY rank)), lambda s, x: CASE WHEN {take} THEN {{'used': s.used + x.cost, 'kept': list_append(s.kept, x.idx), 'cost': CAST(0 AS BIGINT), 'idx': CAST(0 AS BIGINT)}} ELSE s END).kept AS kept
      FROM wanted WHERE NOT repeat GROUP BY doc_id),
    picked AS (SELECT doc_id, unnest(kept) AS idx FROM filled JOIN sizes USING (doc_id) WHERE source_characters > {passthrough} UNION ALL SELECT doc_id, idx FROM scored JOIN sizes USING (doc_id) WHERE source_characters <= {passthrough}),
    kept AS (SELECT s.*, lag(idx) OVER w AS before, lag(page) OVER w AS before_page FROM scored s JOIN picked USING (doc_id, idx) WINDOW w AS (PARTITION BY doc_id ORDER BY idx)),
    body AS (SELECT doc_id, string_agg({mark} || text || {NL} || {NL}, '' ORDER BY idx) AS body, count(*) AS n_segments FROM kept GROUP BY doc_id),
    kept_lines AS (SELECT doc_id, idx, q, w[q] AS line FROM (SELECT doc_id, idx, w, unnest(range(1, len(w) + 1)) AS q FROM (SELECT doc_id, idx, string_split(text, {NL}) AS w FROM kept))),
    line_parts AS (SELECT doc_id, idx, q, z, regexp_replace(regexp_replace(c[z], '^\s+', ''), '\s+$', '') AS part FROM (SELECT *, unnest(range(1, len(c) + 1)) AS z FROM (SELECT *, {split("line", D.DATE_LINE_CHARACTERS)} AS c FROM kept_lines))),
    dated AS (SELECT doc_id, left(part, {D.DATE_LINE_CHARACTERS}) AS d, min([idx, q, z]) AS place FROM line_parts WHERE part <> '' AND {_dates("part")} > 0 GROUP BY 1, 2),
    date_lines AS (SELECT doc_id, list(d ORDER BY place)[1:{D.DATE_LINES}] AS ds FROM dated GROUP BY doc_id),
    heads AS (SELECT doc_id, list(h ORDER BY o) AS hs FROM (SELECT doc_id, o, regexp_replace(trim(regexp_replace(trim(text), '^#+', '')), ':+$', '') AS h FROM scored WHERE {heading}) WHERE h <> '' GROUP BY doc_id),
    digests AS (SELECT doc_id, n_pages, source_characters, source_characters > {passthrough} AS compressed, coalesce(n_segments, 0) AS n_segments, coalesce(n_blocks, 0) AS n_blocks, coalesce(hs, []) AS hs, coalesce(len(ds), 0) AS n_dates,
      regexp_replace(CASE WHEN source_characters > {passthrough} AND len(hs) > 0 THEN 'SECTIONS: ' || array_to_string(hs, ' | ') || {NL} || {NL} ELSE '' END
        || CASE WHEN len(ds) > 1 THEN 'EVERY DATE IN THIS DOCUMENT, WITH ITS OWN WORDS:' || {NL} || array_to_string(list_transform(ds, lambda x: '- ' || x || {NL}), '') || {NL} ELSE '' END || coalesce(body, ''), '\s+$', '') AS text
      FROM sizes LEFT JOIN body USING (doc_id) LEFT JOIN date_lines USING (doc_id) LEFT JOIN heads USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n_blocks FROM scored GROUP BY doc_id) USING (doc_id))"""


ROW = """SELECT doc_id, n_pages AS page_count, source_characters, CAST(length(text) AS BIGINT) AS digest_characters, compressed, n_blocks AS block_count, CAST(n_segments AS BIGINT) AS n_segments,
  CAST(len(hs) AS BIGINT) AS n_outline, CAST(n_dates AS BIGINT) AS n_dates, sha256(text) AS text_sha256 FROM digests"""


def first_sentence(x: str) -> str:
    """Up to the first end that ends neither the text nor an abbreviation nor a single letter."""
    blank = "{'found': false, 'text': '', 'word': ''}"
    pieces = rf"list_transform(regexp_extract_all({x}, '[^.!?]*[.!?]'), lambda p: {{'found': false, 'text': p, 'word': p}})"
    word = r"CASE WHEN regexp_matches(p.text, '\s') THEN regexp_replace(p.text, '(?s)^.*\s', '') ELSE s.word || p.text END"
    before = f"left({word}, -1)"
    short = f"({O._lower(before)} IN ({', '.join(map(O._quoted, T.ABBREVIATIONS))}) OR length(regexp_replace({before}, '[^A-Za-z]', '', 'g')) = 1)"
    fold = f"list_reduce(list_prepend({blank}, {pieces}), lambda s, p: CASE WHEN s.found THEN s ELSE {{'found': NOT {short} AND length(s.text || p.text) < length({x}), 'text': s.text || p.text, 'word': {word}}} END)"
    return f"list_transform([{fold}], lambda f: CASE WHEN f.found THEN f.text ELSE {x} END)[1]"


def oracle_sql() -> dict[str, str]:
    most = T.MOST_WORDS
    statements = digests("statements", 2000, 2000)
    conversations = "(SELECT conv_id AS doc_id, turn + 1 AS page, text FROM conversations)"
    return {
        "c01_distil": "WITH " + digests("(SELECT doc_id, 1 AS page, text FROM documents)", D.BUDGET, D.BUDGET) + ROW,
        "c01_distil_statements": O.sql(", " + statements + ROW, "statements"),
        "s13_report": "WITH " + digests(conversations, D.BUDGET, D.BUDGET) + """
          SELECT doc_id, n_pages AS pages, source_characters, CAST(length(text) AS BIGINT) AS digest_characters, round(CAST(CASE WHEN source_characters = 0 THEN 1.0 ELSE length(text) / source_characters END AS FLOAT), 4) AS ratio, compressed, sha256(text) AS digest_sha256 FROM digests""",
        "x07_sentences": f"""SELECT doc_id, CAST(len(p) AS BIGINT) AS chunks, CAST(length(array_to_string(p, '')) AS BIGINT) AS characters, array_to_string(p, '') = text AS whole FROM (SELECT doc_id, text, {split("text", D.BLOCK_CHARACTERS)} AS p FROM documents)""",
        "x15_first_sentences": rf"""WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '') AS t FROM documents), s AS (SELECT doc_id, {first_sentence("t")} AS s FROM t),
          c AS (SELECT doc_id, len(regexp_extract_all(s, '[^\s]+')) > {most} AS over, CASE WHEN len(regexp_extract_all(s, '[^\s]+')) > {most} THEN regexp_replace(array_to_string(regexp_extract_all(s, '[^\s]+')[1:{most}], ' '), '[,;.!?]+$', '') || '.' ELSE s END AS c FROM s)
          SELECT doc_id, sha256(c) AS sentence_sha256, over, regexp_matches(c, '[.!?]$') AND len(regexp_extract_all(c, '[^\s]+')) BETWEEN 6 AND {most} AND regexp_matches(c, '^\P{{L}}*\p{{Lu}}') AS usable FROM c""",
    }
