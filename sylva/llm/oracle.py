"""DuckDB SQL of the operators that SQL can express."""

OP2 = r"""
WITH line AS (SELECT doc_id, i, l, trim(l, ' ' || chr(9) || chr(13)) AS t
              FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), unnest(ls) WITH ORDINALITY AS s(l, i)),
solid AS (SELECT doc_id, i, t, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM line WHERE t <> ''),
run AS (SELECT doc_id, r, string_agg(t, chr(10)) OVER w AS t, count(*) OVER w AS n
        FROM solid WINDOW w AS (PARTITION BY doc_id ORDER BY r ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)),
later AS (SELECT doc_id, r FROM (SELECT doc_id, r, row_number() OVER (PARTITION BY t ORDER BY doc_id, r) AS k FROM run WHERE n = 3) WHERE k > 1),
gone AS (SELECT DISTINCT solid.doc_id, solid.i FROM later, solid WHERE solid.doc_id = later.doc_id AND solid.r BETWEEN later.r AND later.r + 2),
kept AS (SELECT line.doc_id, count(*) AS n_lines, count(gone.i) AS n_removed,
                sha256(coalesce(string_agg(CASE WHEN gone.i IS NULL THEN l END, chr(10) ORDER BY line.i), '')) AS text_sha256
         FROM line LEFT JOIN gone ON line.doc_id = gone.doc_id AND line.i = gone.i GROUP BY line.doc_id)
SELECT documents.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(text_sha256, sha256('')) AS text_sha256
FROM documents LEFT JOIN kept ON documents.doc_id = kept.doc_id
"""

_WORDS4 = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

OP4 = rf"""
WITH d AS (SELECT doc_id, {_WORDS4} AS w FROM documents),
b AS (SELECT item_id, {_WORDS4} AS w FROM benchmark),
pattern AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(list_slice(w, i, i + least(13, len(w)) - 1), ' ') AS t
            FROM b, unnest(generate_series(1, greatest(1, len(w) - 12))) AS s(i) WHERE len(w) > 0),
place AS (SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS t
          FROM (SELECT DISTINCT n FROM pattern) AS size, d, unnest(generate_series(1, len(w) - n + 1)) AS s(i)),
hit AS (SELECT DISTINCT doc_id, i, place.n, item_id FROM place JOIN pattern ON place.t = pattern.t AND place.n = pattern.n),
counted AS (SELECT doc_id, count(DISTINCT j) AS n_hit, count(DISTINCT item_id) AS n_items FROM hit, unnest(generate_series(i, i + n - 1)) AS s(j) GROUP BY doc_id),
named AS (SELECT doc_id, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN counted ON d.doc_id = counted.doc_id LEFT JOIN named ON d.doc_id = named.doc_id
"""

OP6 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
run AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 34), ' ') AS t FROM d, unnest(generate_series(1, len(w) - 34)) AS s(i)),
twice AS (SELECT t FROM run GROUP BY t HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, j FROM run JOIN twice ON run.t = twice.t, unnest(generate_series(i, i + 34)) AS s(j)),
word AS (SELECT doc_id, j, w[j] AS v FROM d, unnest(generate_series(1, len(w))) AS s(j)),
kept AS (SELECT word.doc_id, count(*) AS n, string_agg(v, ' ' ORDER BY word.j) AS t
         FROM word LEFT JOIN gone ON word.doc_id = gone.doc_id AND word.j = gone.j WHERE gone.j IS NULL GROUP BY word.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""

OP8 = r"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url,
                  translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
rule(rule_host, rule_path, action) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
                                              ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
best AS (SELECT page_id, host, path, max(struct_pack(n := length(rule_host || rule_path), rule := rule_host || rule_path, action := action)) AS r
         FROM p JOIN rule ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY ALL)
SELECT p.page_id, p.host, p.path, r.rule AS rule,
       coalesce(r.action, CASE WHEN regexp_matches(translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '(^|[^a-z0-9])(ads-track|spam-farm|casino-win|adult-x|cheap-pills|free-bets)([^a-z0-9]|$)') THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN best ON p.page_id = best.page_id AND p.host = best.host AND p.path = best.path
"""

_TERMS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

OP11 = rf"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, {_TERMS} AS w FROM documents),
size AS (SELECT count(*) AS nd, CAST(sum(len(w)) AS BIGINT) AS nt FROM d WHERE len(w) > 0),
asked AS (SELECT row_number() OVER () AS item, item_id, {_TERMS} AS w FROM benchmark),
wanted AS (SELECT item, item_id, t, count(*) AS times FROM asked, unnest(w) AS s(t) GROUP BY ALL),
post AS (SELECT id, doc_id, len(w) AS n, t, count(*) AS tf FROM d, unnest(w) AS s(t) WHERE t IN (SELECT t FROM wanted) GROUP BY ALL),
weight AS (SELECT t, CAST(floor(1000 * ln((2 * nd + 2) / (2 * df + 1))) AS BIGINT) AS g FROM (SELECT t, count(*) AS df FROM post GROUP BY t), size),
part AS (SELECT id, doc_id, t, (1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nd) // nt)) AS q FROM post, size),
scored AS (SELECT item, item_id, id, doc_id, CAST(sum(times * g * q) AS BIGINT) AS score
           FROM wanted JOIN weight ON wanted.t = weight.t JOIN part ON part.t = wanted.t GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 20
"""


def _op12() -> str:
    """Costs, initials and repaired rows for the four states (nothing, after system, user, assistant), from the last row back."""
    needs, role, to = "uuau", {2: "user", 3: "assistant"}, (2, 2, 3, 2)

    def best(cost: str, letter: str, ahead: str, line: str | None) -> str:
        lines = f"{ahead}.r" if line is None else f"list_prepend({line}, {ahead}.r)"
        return f"struct_pack(c := {ahead}.c + {cost}, a := '{letter}' || {ahead}.a, r := {lines})"

    def options(s: int) -> str:
        fits = f"left(role, 1) = '{needs[s]}'"
        keep = f"CASE WHEN NOT faulty AND {fits} THEN {best('cut', 'K', f'w{to[s]}', 'line')} END"
        if s == 0:
            keep += f", CASE WHEN NOT faulty AND left(role, 1) = 's' THEN {best('cut', 'K', 'w1', 'line')} END"
        turned = f"CASE WHEN NOT faulty THEN {best('cut + 1', 'R', f'w{to[s]}', f"""'{role[to[s]]}:' || text""")} END"
        return f"list_min([{best('2', 'D', f'w{s}', None)}, {keep}, {turned}]) AS n{s}"

    def put(s: int, ahead: str) -> str:
        return best("5", "I", ahead, f"'{role[to[s]]}:'")

    end = ["struct_pack(c := 0, a := '', r := CAST([] AS VARCHAR[]))", "struct_pack(c := 10, a := 'II', r := ['user:', 'assistant:'])",
           "struct_pack(c := 5, a := 'I', r := ['assistant:'])", "struct_pack(c := 0, a := '', r := CAST([] AS VARCHAR[]))"]
    return rf"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda x: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, x)) AS t),
given AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                 string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), '') AS k FROM conversations),
drawn AS (SELECT conv_id, turn, role, text,
                 xor(list_reduce(list_transform(k, lambda x: CAST(ascii(x) AS BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 20 AS kind FROM given, crc),
damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                   CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
            FROM drawn, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS n,
                  rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS solid FROM damaged),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, lag(role) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed),
turns AS (SELECT conv_id, turn, role, text, i, n, before, solid = '' AS blank, solid <> '' AND again AS duplicate,
                 solid <> '' AND NOT again AND right(solid, 1) NOT IN ('.', '!', '?') AS truncated FROM seen),
marked AS (SELECT *, blank OR duplicate AS faulty, CASE WHEN truncated THEN 5 ELSE 0 END AS cut, role || ':' || text AS line FROM turns),
counted AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(duplicate) AS duplicate, count_if(truncated) AS truncated,
                   count_if(before IS NOT NULL AND left(before, 1) || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal FROM marked GROUP BY conv_id),
back AS (SELECT DISTINCT conv_id, n + 1 AS i, {', '.join(f'{e} AS w{s}' for s, e in enumerate(end))} FROM marked
         UNION ALL
         SELECT conv_id, i, list_min([n0, {put(0, 'w2')}]) AS w0, list_min([n1, {put(1, 'w2')}]) AS w1, w2, w3
         FROM (SELECT conv_id, i, n0, n1, list_min([n2, {put(2, 'n3')}]) AS w2, list_min([n3, {put(3, 'n2')}]) AS w3
               FROM (SELECT marked.conv_id, marked.i, {', '.join(options(s) for s in range(4))}
                     FROM back JOIN marked ON back.conv_id IS NOT DISTINCT FROM marked.conv_id AND marked.i = back.i - 1))),
fixed AS (SELECT conv_id, w0.c AS cost, w0.a AS audit, sha256(array_to_string(w0.r, chr(10))) AS repaired_sha256 FROM back WHERE i = 1),
every AS (SELECT DISTINCT conv_id FROM conversations)
SELECT every.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM every LEFT JOIN counted ON every.conv_id IS NOT DISTINCT FROM counted.conv_id LEFT JOIN fixed ON every.conv_id IS NOT DISTINCT FROM fixed.conv_id
"""


ORACLE: dict[str, str] = {"op2_line_dedup": OP2, "op4_decontaminate": OP4, "op6_substring_dedup": OP6, "op8_url_filter": OP8, "op11_lexical": OP11, "op12_conversations": _op12()}
