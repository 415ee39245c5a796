"""SQL for those queries of this package that SQL can express."""

from __future__ import annotations


OP6 = """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


OP11 = r"""
WITH read AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units
  FROM documents
), drawn AS (
  SELECT *, len(units) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
         CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4
  FROM read
), cut AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
              WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
), parts AS (
  SELECT *, coalesce(array_to_string(units[1:a], ''), '') AS prefix, coalesce(array_to_string(units[a + 1:b], ''), '') AS middle,
         coalesce(array_to_string(units[b + 1:], ''), '') AS suffix
  FROM cut
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text
                        WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(prefix || middle || suffix) AS restored_sha256
FROM parts
"""

# A run has 16 or more words that recur at its period, so runs show among recurring windows of 16 words.
OP12 = r"""
WITH RECURSIVE ids AS (
  SELECT DISTINCT doc_id, CAST(doc_id AS VARCHAR) AS s FROM documents
), crc AS (
  SELECT doc_id, s, 0 AS k, CAST(4294967295 AS BIGINT) AS c FROM ids
  UNION ALL
  SELECT doc_id, s, k + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END
  FROM (SELECT *, CASE WHEN k % 8 = 0 THEN xor(c, CAST(ascii(s[k // 8 + 1]) AS BIGINT)) ELSE c END AS v FROM crc WHERE k < 8 * length(s))
), read AS (
  SELECT d.doc_id, xor(c, 4294967295) AS h, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents d JOIN crc ON d.doc_id = crc.doc_id AND k = 8 * length(s)
), sized AS (
  SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS planted, h // 10 AS g, (h // 10) % greatest(len(w), 1) AS a FROM read
), placed AS (
  SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM sized
), words AS (
  SELECT doc_id, i, w[CASE WHEN planted AND i >= a THEN a + (i - a) % p ELSE i END + 1] AS word
  FROM (SELECT *, unnest(range(n)) AS i FROM placed)
), windows AS (
  SELECT doc_id, i, string_agg(word, ' ') OVER last_16 AS context, count(*) OVER last_16 AS have
  FROM words WINDOW last_16 AS (PARTITION BY doc_id ORDER BY i ROWS 15 PRECEDING)
), pairs AS (
  SELECT x.doc_id, x.i, x.i - y.i AS lag
  FROM windows x JOIN windows y ON x.doc_id = y.doc_id AND x.context = y.context AND x.have = 16 AND y.have = 16 AND y.i < x.i
), stretches AS (
  SELECT doc_id, lag, min(i) - 15 - lag AS start, count(*) + 15 + lag AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, lag ORDER BY i) AS island FROM pairs)
  GROUP BY doc_id, lag, island
), runs AS (
  SELECT doc_id, start, length, min(lag) AS period FROM stretches
  WHERE length >= greatest(24, 3 * lag) GROUP BY doc_id, start, length
), dropped AS (
  SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs
), kept AS (
  SELECT w.doc_id, string_agg(word, ' ' ORDER BY w.i) AS collapsed
  FROM words w ANTI JOIN dropped d ON w.doc_id = d.doc_id AND w.i = d.i GROUP BY w.doc_id
), listed AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines
  FROM runs GROUP BY doc_id
), best AS (
  SELECT * FROM runs x WHERE NOT EXISTS (
    SELECT 1 FROM runs y WHERE x.doc_id = y.doc_id
    AND (y.length * x.period > x.length * y.period
         OR y.length * x.period = x.length * y.period AND (y.start < x.start OR y.start = x.start AND y.period < x.period)))
)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, CAST(b.start AS BIGINT) AS start, CAST(b.length AS BIGINT) AS length,
       CAST(b.period AS BIGINT) AS period, CAST(1000 * b.length // b.period AS BIGINT) AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM documents d LEFT JOIN listed l ON d.doc_id = l.doc_id LEFT JOIN best b ON d.doc_id = b.doc_id LEFT JOIN kept k ON d.doc_id = k.doc_id
"""


def llm_oracles() -> dict[str, str]:
    return {"op6_exact_dedup": OP6, "op11_fill_middle": OP11, "op12_periodic_runs": OP12}
