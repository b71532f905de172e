"""Parts of the SQL that checks the queries: rules with spans, span algebra, decisions, draws, poison."""

from __future__ import annotations

from palimpsest.functions import draws, fixed, rules
from palimpsest.operators import generate
from palimpsest.registry import quoted

FIRE = {n: f"coalesce(regexp_matches(text, {quoted('(?im)' + p)}), false)" for n, _, _, p in fixed.RULES}
SCORE = "greatest(0.0::DOUBLE, " + ", ".join(f"CASE WHEN {FIRE[n]} THEN {w}::DOUBLE ELSE 0.0::DOUBLE END" for n, w, _, _ in fixed.RULES) + ")"
FIRED = "concat_ws(',', " + ", ".join(f"CASE WHEN {FIRE[n]} THEN '{n}' END" for n in rules.NAMES) + ")"


def _line_end(at: str) -> str:
    rest = f"strpos(substr(text, CAST({at} + 1 AS BIGINT)), chr(10))"
    return f"CASE WHEN {rest} > 0 THEN {at} + {rest} - 1 ELSE length(text) END"


def rule_spans(rows: str, key: str) -> str:
    """(key, rule, s, e) of the rules' matches in rows (key, text)."""
    parts = []
    for name, _, scope, pattern in fixed.RULES:
        p = quoted("(?im)" + pattern)
        hits = f"""SELECT {key}, text, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s, CAST(length(m[i]) AS BIGINT) AS n FROM (
          SELECT {key}, text, m, g, unnest(range(1, len(m) + 1)) AS i FROM (SELECT {key}, text, regexp_extract_all(text, {p}) AS m, regexp_split_to_array(text, {p}) AS g FROM {rows} WHERE regexp_matches(text, {p})))"""
        if scope == "match":
            parts.append(f"SELECT {key}, '{name}' AS rule, s, s + n AS e FROM ({hits})")
            continue
        line = f"SELECT *, {_line_end('(s + n)')} AS stop, regexp_extract(substr(text, 1, s), '[^\\n]*$') AS before FROM ({hits})"
        own = f"regexp_full_match(before, '[\\s]*') AND length(before) + stop - s <= {fixed.BLOCK_NEXT_LINE_MAX} AND stop < length(text) AND substr(text, stop + 2, 1) <> chr(10)"
        parts.append(f"SELECT {key}, '{name}' AS rule, s, CASE WHEN {own} THEN {_line_end('(stop + 1)')} ELSE stop END AS e FROM ({line})")
    return "(" + " UNION ALL ".join(parts) + ")"


def merged(spans: str, key: str) -> str:
    """(key, grp, s, e): spans (key, s, e) with those that overlap or touch joined."""
    w = f"OVER (PARTITION BY {key} ORDER BY s, e"
    return f"""(SELECT {key}, grp, CAST(min(s) AS BIGINT) AS s, CAST(max(e) AS BIGINT) AS e FROM (SELECT *, sum(fresh) {w} ROWS UNBOUNDED PRECEDING) AS grp FROM (
      SELECT *, CASE WHEN s <= max(e) {w} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM {spans})) GROUP BY {key}, grp)"""


def expanded(spans: str, texts: str, key: str) -> str:
    """(key, grp, s, e): merged spans (key, s, e) grown to lines or sentences of texts (key, text), merged."""

    def bounds(stop: str) -> tuple[str, str]:
        left = f"s - length(regexp_extract(substr(text, 1, CAST(s AS BIGINT)), '[^{stop}]*$'))"
        upto = f"length(regexp_extract(substr(text, CAST(a + 1 AS BIGINT)), '^[^{stop}]*[{stop}]'))"
        return left, f"CASE WHEN {upto} > 0 THEN a + {upto} ELSE length(text) END"

    line, sentence = bounds("\\n"), bounds(".!?\\n")
    anchored = f"SELECT {key}, text, s, e, greatest(s, s + length(regexp_replace(substr(text, CAST(s + 1 AS BIGINT), CAST(e - s AS BIGINT)), '[ \\t\\n\\x0b\\f\\r]+$', '')) - 1) AS a FROM {spans} JOIN {texts} USING ({key})"
    both = f"SELECT {key}, text, e, {line[0]} AS ls, {line[1]} AS le, {sentence[0]} AS ss, {sentence[1]} AS se FROM ({anchored})"
    wide = f"(le - ls > {fixed.MAX_LINE} OR le - ls > {fixed.MAX_LINE_SHARE}::DOUBLE * length(text))"
    grown = f"(SELECT {key}, CASE WHEN {wide} THEN ss ELSE ls END AS s, least(greatest(CASE WHEN {wide} THEN se ELSE le END, e), length(text)) AS e FROM ({both}))"
    return merged(grown, key)


def cleaned(spans: str, texts: str, key: str) -> str:
    """(key, action, clean): texts (key, text) that have spans (key, s, e), merged, with them redacted."""
    before = f"coalesce(lag(e) OVER (PARTITION BY {key} ORDER BY s), 0)"
    body = f"""SELECT {key}, sum(e - s) AS covered, max(e) AS last, string_agg(kept || {quoted(fixed.MARKER)}, '' ORDER BY s) AS body FROM (
      SELECT {key}, s, e, substr(text, CAST({before} + 1 AS BIGINT), CAST(s - {before} AS BIGINT)) AS kept FROM {spans} JOIN {texts} USING ({key})) GROUP BY {key}"""
    few = f"length(text) = 0 OR (length(text) - covered)::DOUBLE / length(text) < {fixed.MIN_KEPT_SHARE}"
    return f"(SELECT {key}, CASE WHEN {few} THEN 'block' ELSE 'sanitize' END AS action, CASE WHEN {few} THEN '' ELSE body || substr(text, CAST(last + 1 AS BIGINT)) END AS clean FROM {texts} JOIN ({body}) USING ({key}))"


def segments(texts: str, key: str) -> str:
    """(key, s, e, piece) of the segments of texts (key, text)."""
    return f"""(SELECT {key}, lead + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s, lead + list_sum(list_transform(m[1:i], lambda x: length(x))) AS e, m[i] AS piece FROM (
      SELECT {key}, lead, m, unnest(range(1, len(m) + 1)) AS i FROM (SELECT {key}, regexp_extract_all(text, '[^\\n.!?]+[\\n.!?]*') AS m, length(regexp_extract(text, '^[\\n.!?]*')) AS lead FROM {texts}))
      WHERE length(m[i]) >= {fixed.MIN_SEGMENT})"""


def inspected(texts: str, key: str, s2: str | None = None, judged: str | None = None) -> str:
    """A WITH list whose last table, verdicts_, is (key, action, score, decided_by, clean_text, n_spans, fired,
    escalated): texts (key, text) that have been through S0. ``s2`` and ``judged`` are expressions of text."""
    decided = f"CASE WHEN rule >= {fixed.RULES_DECIDE} THEN 'S1+' ELSE 'S1-' END"
    if s2:
        lo, hi = fixed.TAU_LO, fixed.TAU_HI
        gray = "WHEN judged THEN 'S3+' ELSE 'S3-'" if judged else "ELSE 'S2-'"
        decided = f"CASE WHEN rule >= {fixed.RULES_DECIDE} THEN 'S1+' WHEN s2 < {lo} THEN 'S2-' WHEN s2 > {hi} THEN 'S2+' {gray} END"
    seg = segments("lost_", key)
    score2 = (s2 or "0.0").replace("text", "piece")
    return f"""texts_ AS ({texts}), scored_ AS (SELECT {key}, text, {SCORE} AS rule, {FIRED} AS fired, {s2 or 'NULL::DOUBLE'} AS s2, {judged or 'NULL::BOOLEAN'} AS judged FROM texts_),
    decided_ AS (SELECT *, {decided} AS d FROM scored_), bad_ AS (SELECT {key}, text FROM decided_ WHERE d LIKE '%+'),
    own_ AS (SELECT {key}, s, e FROM {rule_spans('bad_', key)}),
    lost_ AS (SELECT {key}, text FROM bad_ WHERE {key} NOT IN (SELECT {key} FROM own_)),
    pieces_ AS (SELECT *, {score2} AS x, count(*) OVER (PARTITION BY {key}) AS many FROM {seg}),
    over_ AS (SELECT {key}, s, e FROM pieces_ WHERE many > 1 AND x > {fixed.TAU_HI}),
    base_ AS (SELECT * FROM own_ UNION ALL SELECT * FROM over_ UNION ALL SELECT {key}, 0, length(text) FROM lost_ WHERE {key} NOT IN (SELECT {key} FROM over_)),
    spans_ AS (SELECT * FROM {expanded(merged('base_', key), 'bad_', key)}),
    clean_ AS (SELECT * FROM {cleaned('spans_', 'bad_', key)}),
    verdicts_ AS (SELECT {key}, coalesce(action, 'pass') AS action, CASE WHEN d LIKE 'S1%' THEN rule ELSE s2 END AS score, d[1:2] AS decided_by, coalesce(clean, text) AS clean_text,
      coalesce(n, 0) AS n_spans, fired, CAST(d LIKE 'S3%' AS INT) AS escalated, text FROM decided_ LEFT JOIN clean_ USING ({key}) LEFT JOIN (SELECT {key}, count(*) AS n FROM spans_ GROUP BY {key}) USING ({key}))"""


def lexical(weights: dict[str, float], text: str = "text") -> str:
    total = " + ".join(f"CASE WHEN contains(lower({text}), {quoted(w)}) THEN {x}::DOUBLE ELSE 0.0::DOUBLE END" for w, x in weights.items())
    return f"(1 - exp(-({total})))"


def pick(values, key: str, tag: str, seed: int = 42) -> str:
    return "[" + ", ".join(quoted(v) for v in values) + f"][CAST({draws.draw_sql(key, tag, str(len(values)), seed)} + 1 AS INT)]"


def marker(key: str, seed: int = 42) -> str:
    letters = fixed.CANARY_ALPHABET
    return f"{quoted(fixed.CANARY_PREFIX)} || " + " || ".join(f"substr('{letters}', CAST({draws.draw_sql(key, f'm{i}', str(len(letters)), seed)} + 1 AS INT), 1)" for i in range(fixed.CANARY_LENGTH))


def payload(key: str) -> str:
    kind = draws.draw_sql(key, "kind", "10")
    return f"CASE WHEN {kind} < {int(10 * fixed.PAYLOAD_CODE)} THEN {marker(key)} WHEN {kind} < {int(10 * fixed.PAYLOAD_NAME)} THEN {pick(generate.DECOYS, key, 'decoy')} ELSE {pick(generate.LINKS, key, 'link')} END"


def synthetic_attack(key: str, styles) -> str:
    style = pick(styles, key, "style")
    goal = f"CASE WHEN regexp_matches({style}, 'automatico|Programma|chi scrive|archivio') THEN {pick(generate.GOALS_IT, key, 'goal')} ELSE {pick(generate.GOALS, key, 'goal')} END"
    return f"replace(replace({style}, '{{p}}', {goal}), '{{x}}', {payload(key)})"


_PARTS = "CASE WHEN contains(text, chr(10)) THEN string_split(text, chr(10)) ELSE string_split(regexp_replace(text, '([.!?])[ \\t\\n\\x0b\\f\\r]+', '\\1' || chr(1), 'g'), chr(1)) END"


def poisoned(rows: str, key: str) -> str:
    """rows (key, text, attack, place, ...) with head, tail: what stands before and after the attack."""
    at = f"CASE place WHEN 'start' THEN 0 WHEN 'end' THEN n ELSE least(1 + {draws.draw_sql(key, 'middle', 'greatest(1, n - 1)')}, n) END"

    def joined(parts: str) -> str:
        return f"CASE WHEN contains(text, chr(10)) THEN array_to_string({parts}, chr(10)) ELSE array_to_string({parts}, ' ') END"

    return f"""(SELECT *, CASE WHEN before <> '' THEN before || chr(10) ELSE '' END AS head, CASE WHEN after <> '' THEN chr(10) || after ELSE '' END AS tail FROM (
      SELECT *, {joined('parts[1:spot]')} AS before, {joined('parts[spot + 1:]')} AS after FROM (SELECT *, CAST({at} AS BIGINT) AS spot FROM (SELECT *, len(parts) AS n FROM (SELECT *, {_PARTS} AS parts FROM {rows})))))"""


def chunked(rows: str) -> str:
    """rows (doc_id, text, s, e, ...) with position_index, chunk and label: windows of words with offsets."""
    size, stride, keep = fixed.CHUNK_TOKENS, fixed.CHUNK_TOKENS - fixed.CHUNK_OVERLAP, fixed.CHUNK_OVERLAP
    whole = f"array_to_string(p[{stride} * i + 1:{stride} * i + {size}], '')"
    cs = f"length(array_to_string(p[1:{stride} * i], '')) + length({whole}) - length(chunk)"
    return f"""(SELECT *, CASE WHEN s IS NOT NULL AND least(cs + length(chunk), e) - greatest(cs, s) >= {fixed.LABEL_OVERLAP} THEN 1 ELSE 0 END AS label FROM (SELECT *, {cs} AS cs FROM (
      SELECT *, CAST(i AS INT) AS position_index, regexp_replace({whole}, '^[ \\n\\t\\r]+', '') AS chunk FROM (
        SELECT *, unnest(range(0, (greatest(1, len(p) - {keep}) + {stride - 1}) // {stride})) AS i FROM (SELECT *, regexp_extract_all(text, '[ \\n\\t\\r]*[^ \\n\\t\\r]+') AS p FROM {rows}) WHERE len(p) > 0))))"""


def variants(docs: str, attacks: str, count: int) -> str:
    """(doc_id, domain, text, query, attack_id, attack_category, injection_position, s, e) as generate.variants."""
    bad = f"{draws.draw_sql('doc_id', 'poisoned', '1000')} < {int(1_000 * fixed.POSITIVE_SHARE)}"
    numbered = f"(SELECT attack_id, category, text AS attack, row_number() OVER (ORDER BY md5('42|' || attack_id), attack_id) - 1 AS k FROM {attacks} WHERE text IS NOT NULL)"
    base = f"(SELECT d.doc_id || '-v' || v AS doc_id, domain, text, question AS query FROM {docs} d, range(0, {count}) t(v) WHERE text IS NOT NULL)"
    drawn = f"(SELECT *, CASE WHEN {bad} THEN {draws.draw_sql('doc_id', 'attack', f'(SELECT count(*) FROM {attacks} WHERE text IS NOT NULL)')} END AS k, {pick(fixed.POSITIONS, 'doc_id', 'position')} AS place FROM {base})"
    met = f"(SELECT b.*, a.attack_id, a.category, a.attack FROM {drawn} b LEFT JOIN {numbered} a USING (k))"
    return f"""(SELECT doc_id, domain, CASE WHEN attack IS NULL THEN text ELSE head || attack || tail END AS text, query, coalesce(attack_id, '') AS attack_id, coalesce(category, '') AS attack_category,
      CASE WHEN attack IS NULL THEN '' ELSE place END AS injection_position, CASE WHEN attack IS NOT NULL THEN length(head) END AS s, CASE WHEN attack IS NOT NULL THEN length(head) + length(attack) END AS e FROM {poisoned(met, 'doc_id')})"""


def chunk_records(docs: str, attacks: str, count: int) -> str:
    return f"(SELECT doc_id || '-' || position_index AS chunk_id, doc_id, position_index, chunk AS text, query, label, domain, attack_id, attack_category, injection_position FROM {chunked(variants(docs, attacks, count))})"


def synthetic_attacks(styles) -> str:
    key = "('synthetic-' || i)"
    return f"(SELECT {key} AS attack_id, 'synthetic' AS category, {synthetic_attack(key, styles)} AS text FROM range(0, {fixed.SYNTHETIC_ATTACKS}) t(i))"
