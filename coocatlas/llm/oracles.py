"""DuckDB SQL of the operators that SQL can express, over views of the given tables."""

ORACLES: dict[str, str] = {}

_LEDGER = r"""
WITH texts AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t FROM documents),
words AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM texts),
windows AS (
  SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k
  FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM words WHERE len(w) >= 3)),
again AS (SELECT rid, i FROM windows QUALIFY count(*) OVER (PARTITION BY rid, k) > 1),
covered AS (
  SELECT rid, count(DISTINCT p) AS n
  FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY rid),
lines AS (
  SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup
  FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM texts)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
measured AS (
  SELECT doc_id, len(w)::BIGINT AS n_words,
    length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
    coalesce(n_lines, 0) AS n_lines,
    length(regexp_replace(t, '[^\p{Lu}]', '', 'g')) AS n_upper,
    length(t) - length(replace(t, '!', '')) AS n_shouts
  FROM words LEFT JOIN covered c USING (rid) LEFT JOIN lines USING (rid)),
bits AS (
  SELECT *,
    (n_words < 50)::BIGINT
    | ((100 * n_repeat_words > 50 * n_words)::BIGINT << 1)
    | ((100 * n_symbols > 30 * n_words)::BIGINT << 2)
    | ((100 * n_dup_lines > 50 * n_lines)::BIGINT << 3)
    | ((word_chars < 2 * n_words OR word_chars > 15 * n_words)::BIGINT << 4)
    | ((100 * n_upper > 40 * word_chars)::BIGINT << 5)
    | ((100 * n_shouts > 30 * n_words)::BIGINT << 6) AS failure_bits
  FROM measured)
"""

ORACLES["op4_quality_rules"] = _LEDGER + """
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (failure_bits & 3) <> 0 AS base_failed, failure_bits = 0 AS kept, failure_bits
FROM bits
"""

ORACLES["rule_ablations"] = _LEDGER + """,
rules(rule, bit, since) AS (VALUES
  ('few_words', 1, 1), ('repeated_windows', 2, 1), ('symbols', 4, 2), ('repeated_lines', 8, 2),
  ('word_length', 16, 2), ('upper_case', 32, 2), ('shouting', 64, 2)),
policies(policy, version, mask) AS (VALUES ('v1', 1, 3), ('v2', 2, 127))
SELECT policy, rule,
  coalesce(sum(((failure_bits & mask) = 0)::BIGINT), 0)::BIGINT AS n_kept,
  coalesce(sum(((failure_bits & bit) <> 0)::BIGINT), 0)::BIGINT AS n_failed,
  coalesce(sum(((failure_bits & mask) = bit)::BIGINT), 0)::BIGINT AS n_failed_alone,
  coalesce(sum(((failure_bits & mask & ~bit) = 0)::BIGINT), 0)::BIGINT AS n_kept_without
FROM policies JOIN rules ON since <= version JOIN bits ON true GROUP BY policy, rule
"""

ORACLES["op10_host_reputation"] = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
placed AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(rest, '^[^/?#]*'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut),
outcomes AS (
  SELECT host, quality AS good FROM (
    SELECT host, regexp_extract(path, '^/[^/]*/([0-9]{1,18})', 1) AS number FROM placed)
  JOIN labels ON number <> '' AND doc_id = try_cast(number AS BIGINT) WHERE quality IS NOT NULL),
counted AS (SELECT host, sum(good) AS k, count(*) AS n FROM outcomes GROUP BY host),
hosts AS (
  SELECT host, coalesce(k, 0)::DOUBLE AS k, coalesce(n, 0)::DOUBLE AS n, string_split(host, '.') AS p
  FROM (SELECT DISTINCT host FROM placed) LEFT JOIN counted USING (host)),
levels AS (
  SELECT host, k, n, len(p) AS parts, p,
    length(p[-1]) = 2 AND len(p) > 1 AND p[-2] IN ('ac', 'co', 'com', 'edu', 'gov', 'net', 'org') AS country FROM hosts),
named AS (
  SELECT host, k, n,
    array_to_string(p[greatest(1, parts - country::INT):parts], '.') AS suffix,
    array_to_string(p[greatest(1, parts - 1 - country::INT):parts], '.') AS domain FROM levels),
root AS (SELECT (coalesce(sum(k), 0) + 1) / (coalesce(sum(n), 0) + 2) AS mean FROM named),
s0 AS (SELECT suffix, sum(k) AS k, sum(n) AS n, any_value(mean) AS mean FROM named, root GROUP BY suffix),
s_fit AS (SELECT 1 / greatest(1 / 1001.0, least(0.5, coalesce(sum(pow(k - n * mean, 2) / n - mean * (1 - mean)) FILTER (n > 0)
  / nullif(greatest(sum(mean * (1 - mean) * (n - 1)) FILTER (n > 0), 0), 0), 0))) - 1 AS s FROM s0),
s1 AS (SELECT suffix, (k + s * mean) / (n + s) AS mean FROM s0, s_fit),
d0 AS (SELECT domain, sum(k) AS k, sum(n) AS n, any_value(mean) AS mean FROM named JOIN s1 USING (suffix) GROUP BY domain),
d_fit AS (SELECT 1 / greatest(1 / 1001.0, least(0.5, coalesce(sum(pow(k - n * mean, 2) / n - mean * (1 - mean)) FILTER (n > 0)
  / nullif(greatest(sum(mean * (1 - mean) * (n - 1)) FILTER (n > 0), 0), 0), 0))) - 1 AS s FROM d0),
d1 AS (SELECT domain, (k + s * mean) / (n + s) AS mean FROM d0, d_fit),
h0 AS (SELECT host, k, n, mean FROM named JOIN d1 USING (domain)),
h_fit AS (SELECT 1 / greatest(1 / 1001.0, least(0.5, coalesce(sum(pow(k - n * mean, 2) / n - mean * (1 - mean)) FILTER (n > 0)
  / nullif(greatest(sum(mean * (1 - mean) * (n - 1)) FILTER (n > 0), 0), 0), 0))) - 1 AS s FROM h0),
h1 AS (SELECT host, (k + s * mean) / (n + s) AS m, n + s AS w FROM h0, h_fit),
rules(rule, on_host, on_path, verdict) AS (VALUES
  ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'),
  ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')),
ruled AS (
  SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM (SELECT DISTINCT host, path FROM placed)
  JOIN rules ON (host = on_host OR ends_with(host, '.' || on_host)) AND starts_with(path, on_path) GROUP BY host, path)
SELECT page_id, host, path, rule,
  coalesce(verdict, CASE WHEN m - 1.645 * sqrt(m * (1 - m) / (w + 1)) >= 0.5 THEN 'allow' ELSE 'block' END) AS verdict
FROM placed JOIN h1 USING (host) LEFT JOIN ruled USING (host, path)
"""

ORACLES["op3_preference_pairs"] = r"""
WITH turns AS (
  SELECT conv_id, role, coalesce(text, '') AS t,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS nth FROM conversations),
marked AS (
  SELECT *, max(nth) FILTER (role = 'assistant') OVER (PARTITION BY conv_id) AS final,
    last_value(CASE WHEN role = 'assistant' THEN t END IGNORE NULLS)
      OVER (PARTITION BY conv_id ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier FROM turns),
sides AS (
  SELECT conv_id, nth, coalesce(role, 'user') AS role, t AS c,
    CASE WHEN nth = final THEN coalesce(earlier, '') ELSE t END AS r FROM marked WHERE nth <= final),
common AS (
  SELECT *, bool_and(c = r) OVER (PARTITION BY conv_id ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS shared FROM sides),
rendered AS (
  SELECT *, '<|' || role || '|>' || chr(10) || c || '<|end|>' || chr(10) AS ct,
    '<|' || role || '|>' || chr(10) || r || '<|end|>' || chr(10) AS rt FROM common),
placed AS (
  SELECT *,
    sum(CASE WHEN shared THEN 0 ELSE length(ct) END) OVER (PARTITION BY conv_id ORDER BY nth) AS ce,
    sum(CASE WHEN shared THEN 0 ELSE length(rt) END) OVER (PARTITION BY conv_id ORDER BY nth) AS re FROM rendered)
SELECT conv_id, count(*) FILTER (shared) AS n_common,
  coalesce(string_agg(ct, '' ORDER BY nth) FILTER (shared), '') AS prompt,
  coalesce(string_agg(ct, '' ORDER BY nth) FILTER (NOT shared), '') AS chosen,
  coalesce(string_agg((ce - length(ct) + 14)::VARCHAR || ':' || (ce - 1)::VARCHAR, ',' ORDER BY nth)
    FILTER (NOT shared AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg(rt, '' ORDER BY nth) FILTER (NOT shared), '') AS rejected,
  coalesce(string_agg((re - length(rt) + 14)::VARCHAR || ':' || (re - 1)::VARCHAR, ',' ORDER BY nth)
    FILTER (NOT shared AND role = 'assistant'), '') AS rejected_mask
FROM placed GROUP BY conv_id
"""


def _crc32(number: str) -> str:
    """DuckDB expression: crc32 of the decimal text of an integer, byte by byte, each bit by bit."""
    return f"""xor(list_reduce(list_prepend(4294967295::BIGINT,
    list_transform(string_split(({number})::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
    lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0],
      lambda x, zero: xor(x >> 1, 3988292384::BIGINT * (x & 1)))), 4294967295::BIGINT)"""


def _field(value: str) -> str:
    return f"coalesce(strlen(({value})::VARCHAR)::VARCHAR || ':' || ({value})::VARCHAR, '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_field(v) for v in ("doc_id", "source", "lang", n_chars, "text")) + ")"


ORACLES["op11_merkle_manifest"] = f"""
WITH RECURSIVE leaves AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce('+' || lang, '') AS seq, {_leaf('n_chars')} AS leaf,
    CASE WHEN {_crc32('doc_id')} % 7 = 0 THEN {_leaf('n_chars::HUGEINT + 1')} ELSE {_leaf('n_chars')} END AS shown FROM documents),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY seq ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
    count(*) OVER (PARTITION BY seq) AS n FROM leaves),
tree AS (
  SELECT seq, 0 AS lvl, idx, n, leaf AS digest FROM placed
  UNION ALL
  SELECT seq, lvl + 1, idx // 2, (max(n) + 1) // 2, sha256(string_agg(digest, '' ORDER BY idx)) FROM tree
  WHERE n > 1 GROUP BY seq, lvl, idx // 2),
subroots AS (
  SELECT seq, lvl AS height, digest AS subroot, row_number() OVER (ORDER BY seq) - 1 AS idx, count(*) OVER () AS n FROM tree WHERE n = 1),
crown AS (
  SELECT 0 AS lvl, idx, n, subroot AS digest FROM subroots
  UNION ALL
  SELECT lvl + 1, idx // 2, (max(n) + 1) // 2, sha256(string_agg(digest, '' ORDER BY idx)) FROM crown
  WHERE n > 1 GROUP BY lvl, idx // 2),
steps AS (
  SELECT p.rid, t.lvl AS step, (p.idx >> t.lvl) & 1 AS is_right, s.digest
  FROM placed p JOIN (SELECT DISTINCT seq, lvl FROM tree WHERE n > 1) t USING (seq)
  LEFT JOIN tree s ON s.seq = p.seq AND s.lvl = t.lvl AND s.idx = xor(p.idx >> t.lvl, 1)
  UNION ALL
  SELECT p.rid, r.height + c.lvl, (r.idx >> c.lvl) & 1, s.digest
  FROM placed p JOIN subroots r USING (seq) JOIN (SELECT DISTINCT lvl FROM crown WHERE n > 1) c ON true
  LEFT JOIN crown s ON s.lvl = c.lvl AND s.idx = xor(r.idx >> c.lvl, 1)),
folded AS (
  SELECT rid, 0 AS step, shown AS digest FROM placed
  UNION ALL
  SELECT f.rid, f.step + 1, CASE WHEN s.is_right = 1 THEN sha256(coalesce(s.digest, '') || f.digest)
    ELSE sha256(f.digest || coalesce(s.digest, '')) END
  FROM folded f JOIN steps s ON s.rid = f.rid AND s.step = f.step),
ends AS (SELECT rid, arg_max(digest, step) AS folded_root FROM folded GROUP BY rid),
proofs AS (SELECT rid, sha256(coalesce(string_agg(digest, '' ORDER BY step), '')) AS proof_sha256 FROM steps GROUP BY rid)
SELECT doc_id, leaf, subroot, digest AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root,
  folded_root = digest AS verified
FROM placed JOIN subroots USING (seq) JOIN ends USING (rid) LEFT JOIN proofs USING (rid) JOIN crown ON crown.n = 1
"""

ORACLES["op12_prefix_trie"] = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
lists AS (
  SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, sha256(strlen(role) || ':' || role || text)) AS own
  FROM turns GROUP BY conv_id),
heads AS (SELECT *, {_crc32('conv_id')} % 6 AS h FROM lists),
rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(b.own, [])[1:c.h], c.own[c.h + 1:]) AS seq
  FROM heads c LEFT JOIN lists b ON b.conv_id = c.conv_id - c.conv_id % 100),
prefixes AS (
  SELECT conv_id, len(seq) AS n, depth, seq[1:depth] AS prefix
  FROM (SELECT *, unnest(range(0, len(seq) + 1)) AS depth FROM rebuilt)),
nodes AS (
  SELECT min(conv_id) AS conv_id, depth, prefix, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256,
    (count(*) - 1) * CASE WHEN depth = 0 THEN 0 ELSE length(prefix[-1].text) END AS saved
  FROM prefixes GROUP BY depth, prefix),
members AS (
  SELECT p.conv_id AS member, p.depth, n.conv_id FROM prefixes p JOIN nodes n ON n.depth = p.depth AND n.prefix = p.prefix),
linked AS (
  SELECT n.*, m.conv_id AS parent_conv_id FROM nodes n LEFT JOIN members m ON m.member = n.conv_id AND m.depth = n.depth - 1),
children AS (
  SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM linked WHERE depth > 0 GROUP BY ALL),
counted AS (
  SELECT l.*, coalesce(n_children, 0) AS n_children FROM linked l LEFT JOIN children c ON c.conv_id = l.conv_id AND c.depth = l.depth),
subtrees AS (
  SELECT m.conv_id, m.depth, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens
  FROM counted n JOIN members m ON m.member = n.conv_id AND m.depth <= n.depth GROUP BY m.conv_id, m.depth),
stored AS (
  SELECT n.conv_id, n.depth,
    CASE WHEN n.depth = 0 THEN NULL WHEN n.depth <= shared THEN n.conv_id - n.conv_id % 100 ELSE n.conv_id END AS ref_conv,
    CASE WHEN n.depth = 0 THEN NULL WHEN n.depth <= shared THEN n.depth - 1 ELSE n.depth - 1 - shared + h END AS ref_turn
  FROM nodes n JOIN (
    SELECT c.conv_id, c.h, least(c.h, coalesce(len(b.own), 0)) AS shared
    FROM heads c LEFT JOIN lists b ON b.conv_id = c.conv_id - c.conv_id % 100) USING (conv_id))
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, ref_conv, ref_turn
FROM counted JOIN subtrees USING (conv_id, depth) JOIN stored USING (conv_id, depth)
"""
