"""DuckDB SQL for the queries that SQL can express, written from their definitions."""

from __future__ import annotations


def _pieces(turns: str) -> str:
    """Rendered turns of a list column, with the length of the head."""
    head = "'<|' || coalesce(x.role, 'unknown') || '|>' || chr(10)"
    return f"[{{'t': {head} || coalesce(x.text, '') || '<|end|>' || chr(10), 'h': length({head}), 'a': coalesce(x.role = 'assistant', false)}} for x in {turns}]"


def _text(pieces: str) -> str:
    return f"coalesce(array_to_string([x.t for x in {pieces}], ''), '')"


def _loss(pieces: str) -> str:
    """begin:end of each assistant text, comma-joined."""
    before = f"coalesce(list_sum([length(y.t) for y in {pieces}[1 : i - 1]]), 0)::bigint"
    each = f"(({before}) + {pieces}[i].h) || ':' || (({before}) + length({pieces}[i].t))"
    return f"coalesce(array_to_string([{each} for i in range(1, len({pieces}) + 1) if {pieces}[i].a], ','), '')"


CHAT = f"""WITH t AS (
  SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS ts
    FROM (SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS lone FROM conversations) GROUP BY conv_id, lone),
l AS (SELECT *, list_max([i for i in range(1, len(ts) + 1) if ts[i].role = 'assistant']) AS last FROM t),
p AS (SELECT l.conv_id, l.ts, CASE WHEN l.last IS NULL THEN l.ts ELSE
    l.ts[1 : l.last - 1] || CASE WHEN o.conv_id IS NOT NULL THEN [{{'role': 'assistant', 'text': o.ts[o.last].text}}] ELSE [] END || l.ts[l.last + 1 :] END AS rs
  FROM l LEFT JOIN l AS o ON o.conv_id = xor(l.conv_id, 1) AND o.last IS NOT NULL),
c AS (SELECT *, coalesce(list_min([i for i in range(1, least(len(ts), len(rs)) + 1)
    if ts[i].role IS DISTINCT FROM rs[i].role OR ts[i].text IS DISTINCT FROM rs[i].text]) - 1, least(len(ts), len(rs))) AS k FROM p),
r AS (SELECT conv_id, k, {_pieces("ts[1 : k]")} AS pre, {_pieces("ts[k + 1 :]")} AS a, {_pieces("rs[k + 1 :]")} AS b FROM c)
SELECT conv_id, k::int AS n_common, {_text("pre")} AS prompt, {_text("a")} AS chosen_text, {_loss("a")} AS chosen_loss, {_text("b")} AS rejected_text, {_loss("b")} AS rejected_loss FROM r"""


def _words(text: str) -> str:
    lower = f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


DECONTAMINATION = rf"""WITH d AS MATERIALIZED (SELECT doc_id, {_words("text")} AS w FROM documents),
i AS (SELECT item_id::varchar AS item, {_words("text")} AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS MATERIALIZED (SELECT DISTINCT item, least(len(w), 8) AS n, array_to_string(w[k : k + 7], ' ') AS p
  FROM i, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS u(k) WHERE len(w) > 0),
dw AS (SELECT doc_id, k, n, array_to_string(w[k : k + n - 1], ' ') AS p
  FROM d, (SELECT DISTINCT n FROM win), unnest(range(1, len(w) - n + 2)) AS u(k)),
hit AS MATERIALIZED (SELECT doc_id, k, win.n, item FROM dw JOIN win ON win.n = dw.n AND win.p = dw.p),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS joined FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id),
hw AS MATERIALIZED (SELECT DISTINCT doc_id, j FROM hit, unnest(range(k, k + n)) AS u(j)),
words AS (SELECT doc_id, count(*) AS n_hit FROM hw GROUP BY doc_id),
cut AS (SELECT doc_id, regexp_extract_all(text, '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS parts
  FROM documents WHERE doc_id IN (SELECT doc_id FROM hw)),
pieces AS (SELECT doc_id, j, parts[j] AS piece FROM cut, unnest(range(1, len(parts) + 1)) AS u(j)),
places AS (SELECT doc_id, j, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY j) AS e,
  length(regexp_extract(piece, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+$')) AS w FROM pieces),
runs AS (SELECT doc_id, min(e - w)::bigint AS b, max(e)::bigint AS e
  FROM (SELECT *, j - row_number() OVER (PARTITION BY doc_id ORDER BY j) AS run FROM hw JOIN places USING (doc_id, j)) GROUP BY doc_id, run),
spans AS (SELECT doc_id, string_agg(b || ':' || e, ',' ORDER BY b) AS spans FROM runs GROUP BY doc_id)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(n_items, 0)::bigint AS n_items,
  sha256(coalesce(joined, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated, coalesce(spans, '') AS spans
FROM d LEFT JOIN items USING (doc_id) LEFT JOIN words USING (doc_id) LEFT JOIN spans USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {"op3_chat_format": CHAT, "op8_decontaminate": DECONTAMINATION}
