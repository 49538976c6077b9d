"""DuckDB SQL of the queries that SQL can express over whole tables."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LETTERS = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
_NONSPACE = r"[^\x20\x09-\x0D]+"


def _words(pattern: str, text: str = "text") -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}'), '{pattern}')"


#: smallest id that each id reaches along the links (a, b), a CTE named `links` in both directions
_REACHED = """reach AS (
  SELECT a AS id, least(a, min(b)) AS low FROM links GROUP BY a
  UNION
  SELECT l.a, r.low FROM reach r JOIN links l ON l.b = r.id WHERE r.low < l.a
), lowest AS (SELECT id, min(low) AS low FROM reach GROUP BY id)"""

_PHRASES = [("cc-by", ["cc", "by"]), ("gpl", ["general", "public", "license"]), ("reserved", ["all", "rights", "reserved"])]

#: kind, pattern and what a match must fulfil
_BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "list_max(list_transform(string_split(hit, '.'), lambda x: CASE WHEN length(ltrim(x, '0')) > 3 THEN 999 ELSE x::BIGINT END)) <= 255"),
    ("card", r"[0-9]([\x20-]?[0-9])+", "length(digits) BETWEEN 12 AND 19 AND luhn % 10 = 0"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "length(digits) BETWEEN 9 AND 15"),
]

#: role, opening and closing mark, bears loss, states in which it may speak
_ROLES = [("system", "[SYSTEM]", "[/SYSTEM]", False, ["start"]), ("user", "[INST]", "[/INST]", False, ["start", "system", "assistant"]), ("assistant", "", "</s>", True, ["user"])]


def _escaped(text: str) -> str:
    """Text with a backslash behind the first character of each mark."""
    for first, rest in (("<", "s>|/s>"), (r"\[", r"SYSTEM\]|/SYSTEM\]|INST\]|/INST\]|ROLE\]|/ROLE\]|/TURN\]")):
        text = rf"regexp_replace({text}, '({first})(\\*(?:{rest}))', '\1\\\2', 'g')"
    return text


ORACLES = {
    "op12_divergence_audit": f"""
WITH doc AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_words(_LETTERS)} AS words FROM documents),
counted AS (SELECT id, lang, source, term, count(*) AS n FROM (SELECT id, lang, source, unnest(words) AS term FROM doc) GROUP BY ALL),
kept AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM counted GROUP BY ALL HAVING count(*) >= 10),
langs AS (SELECT lang, count(*) AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang),
sums AS (SELECT lang, source, term, sum(n) AS n FROM counted GROUP BY ALL),
dense AS (SELECT g.lang, g.source, k.term, coalesce(s.n, 0)::HUGEINT AS n, k.n AS lang_n FROM (SELECT DISTINCT lang, source FROM doc) g JOIN kept k USING (lang) LEFT JOIN sums s USING (lang, source, term)),
share AS (
  SELECT d.*, (1 + (1000000000 * (n + 2)) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v))::BIGINT AS p, (1 + (1000000000 * (lang_n + 2)) // (total + 2 * v))::BIGINT AS q
  FROM dense d JOIN langs USING (lang)
),
sources AS (SELECT DISTINCT lang, source FROM doc),
value AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (
    SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) AS value FROM share x JOIN share y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
  ) f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM share WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM value
QUALIFY part = 'pair' OR rank <= 10""",
    "op13_fill_in_middle": r"""
WITH doc AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS digest FROM documents),
cut AS (
  SELECT doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units, ('0x' || digest[1:8])::UBIGINT AS h1, ('0x' || digest[9:16])::UBIGINT AS h2,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || digest[17:24])::UBIGINT % 100 >= 50 THEN 'plain' WHEN ('0x' || digest[25:32])::UBIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM doc
),
placed AS (SELECT *, len(units)::BIGINT AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1))::BIGINT AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1))::BIGINT AS b FROM cut),
parts AS (SELECT *, coalesce(array_to_string(units[1:a], ''), '') AS prefix, coalesce(array_to_string(units[a + 1:b], ''), '') AS middle, coalesce(array_to_string(units[b + 1:], ''), '') AS suffix FROM placed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
FROM parts""",
    "op11_chat_format": rf"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
),
placed AS (
  SELECT *, row_number() OVER w - 1 AS place, coalesce(lag(role) OVER w, 'start') AS state FROM said
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  (3 + sum(length({_escaped("text")}) + CASE {" ".join(f"WHEN role = '{r}' THEN {len(a) + len(b)}" for r, a, b, _, _ in _ROLES)} ELSE 20 + length({_escaped("role")}) END))::BIGINT AS formatted_chars,
  bool_and({" OR ".join(f"role = '{r}' AND state IN ({', '.join(repr(x) for x in states)})" for r, _, _, _, states in _ROLES)}) AND arg_max(role, place) = 'assistant' AS valid,
  (min(place) FILTER (WHERE NOT ({" OR ".join(f"role = '{r}' AND state IN ({', '.join(repr(x) for x in states)})" for r, _, _, _, states in _ROLES)})))::INT AS first_error
FROM placed GROUP BY conv_id""",
    "op1_decontamination": f"""
WITH item AS (SELECT DISTINCT item_id::VARCHAR AS item_id, {_words(_ALNUM)} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, w[i:i + least(len(w), 13) - 1] AS win FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 11, 2))) AS i FROM item WHERE len(w) > 0)
),
doc AS (SELECT doc_id, {_words(_ALNUM)} AS w FROM documents),
places AS (
  SELECT doc_id, i, n, w[i:i + n - 1] AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, (SELECT DISTINCT len(win) AS n FROM windows) WHERE len(w) >= n)
),
hit AS (SELECT doc_id, i, n, item_id FROM places JOIN windows USING (win)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, list_sort(list(DISTINCT item_id)) AS ids FROM hit GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, len(coalesce(ids, []))::BIGINT AS n_items,
  sha256(array_to_string(coalesce(ids, []), ',')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "pii_base_spans": f"""
WITH matches AS ({" UNION ALL ".join(f"SELECT doc_id, {k} AS rank, '{kind}' AS kind, regexp_extract_all(t, '{p}') AS hits, string_split_regex(t, '{p}') AS rest FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)" for k, (kind, p, _) in enumerate(_BASE))}),
each AS (SELECT doc_id, rank, kind, hits, rest, unnest(range(1, len(hits) + 1)) AS i FROM matches WHERE len(hits) > 0),
spans AS (
  SELECT doc_id, rank, kind, hits[i] AS hit, (list_sum(list_transform(rest[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0))::BIGINT AS start
  FROM each
),
told AS (SELECT *, start + length(hit) AS stop, regexp_replace(hit, '[^0-9]', '', 'g') AS digits FROM spans),
summed AS (
  SELECT *, list_sum(list_transform(range(1, length(digits) + 1), lambda i: CASE WHEN (length(digits) - i) % 2 = 0 THEN digits[i]::INT WHEN digits[i]::INT > 4 THEN 2 * digits[i]::INT - 9 ELSE 2 * digits[i]::INT END)) AS luhn
  FROM told
),
kept AS (SELECT * FROM summed WHERE CASE kind {" ".join(f"WHEN '{kind}' THEN {test}" for kind, _, test in _BASE)} END),
found AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{kind}') AS n_{kind}" for kind, _, _ in _BASE)}, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS base FROM kept GROUP BY doc_id)
SELECT doc_id, {", ".join(f"coalesce(n_{kind}, 0)::BIGINT AS n_{kind}" for kind, _, _ in _BASE)}, sha256(coalesce(base, '')) AS base_sha256 FROM documents LEFT JOIN found USING (doc_id)""",
    "op4_embedding_dedup": f"""
WITH RECURSIVE usable AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM usable x JOIN usable y ON x.vec_id <> y.vec_id AND len(x.v) = len(y.v) AND list_cosine_similarity(x.v, y.v) >= 0.95),
{_REACHED},
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(low, e.vec_id) AS component_id, coalesce(low, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN counts c ON c.vec_id = e.vec_id LEFT JOIN lowest ON id = e.vec_id""",
    "mix_targets": f"""
WITH sizes AS (SELECT source, sum(len(regexp_extract_all(coalesce(text, ''), '{_NONSPACE}')))::BIGINT AS source_size FROM documents GROUP BY source),
weights AS (SELECT source, source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM sizes),
ranked AS (
  SELECT *, sum(source_size) OVER () AS total, 3.0 * source_size / w AS most, row_number() OVER r AS k,
    coalesce(sum(3.0 * source_size) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held, sum(w) OVER (r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free
  FROM weights WINDOW r AS (ORDER BY 3.0 * source_size / w, source)
),
factor AS (SELECT min_by((total - held) / free, k) AS f FROM ranked WHERE (total - held) / free <= most)
SELECT source, source_size, round(least(coalesce(f, 'infinity'::DOUBLE) * w, 3.0 * source_size), 3)::DOUBLE AS target FROM ranked LEFT JOIN factor ON true""",
    "op6_minhash_dedup": f"""
WITH RECURSIVE doc AS (SELECT doc_id, {_words(_NONSPACE)} AS w FROM documents),
sets AS (SELECT DISTINCT doc_id, w[i:i + 3] AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM doc WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * common.n >= 80 * (p.n + q.n - common.n)),
{_REACHED}
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(low, d.doc_id) AS component_id, coalesce(low, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN lowest ON id = d.doc_id""",
    "license_base": f"""
WITH doc AS (SELECT doc_id, {_words(_ALNUM)} AS w FROM documents),
word AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM doc WHERE len(w) > 0),
place AS ({" UNION ALL ".join(f"SELECT doc_id, i - 1 AS start, '{label}' AS label FROM word WHERE w[i] = '{p[0]}' AND w[i:i + {len(p) - 1}] = {p}" for label, p in _PHRASES)}),
found AS (SELECT doc_id, count(*) AS n, min(start) AS first_word, max(start) AS last_word, list_sort(list(DISTINCT label)) AS labels FROM place GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, array_to_string(coalesce(labels, []), ',') AS base_labels
FROM doc LEFT JOIN found USING (doc_id)""",
    "op9_warc": """
WITH page AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS digest FROM pages),
named AS (
  SELECT *, array_to_string([chr((CASE WHEN x < 26 THEN 65 + x ELSE 24 + x END)::INT) FOR x IN [(('0x' || digest[5 * (c // 4) + 1:5 * (c // 4) + 5])::BIGINT >> (15 - 5 * (c % 4))) & 31 FOR c IN range(32)]], '') AS payload_digest,
    min(page_id) OVER (PARTITION BY digest) AS first_id
  FROM page
)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM named""",
}
