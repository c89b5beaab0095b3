"""SQL of the registered queries for an engine with RE2 patterns, built from the same rule pack, text by text."""

from __future__ import annotations

from damhwa.functions import rules
from damhwa.functions.rules import re2
from damhwa.operators import catalog
from damhwa.plans import overlay, queries as Q

SP = rules._RE2_SPACE


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def hit(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {lit(re2(pattern))})"


def times(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {lit(re2(pattern))}))"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^[{SP}]+|[{SP}]+$', '', 'g')"


def strip(x: str) -> str:
    return trim(f"regexp_replace({x}, {lit(re2(rules.SPEAKER))}, '')")


def names(x: str, patterns: dict[str, str]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {hit(x, patterns[n])} THEN '{n}' END" for n in sorted(patterns)) + "], lambda z: z IS NOT NULL)"


def speech(x: str) -> str:
    s = strip(x)
    return f"CASE WHEN {hit(s, rules.HAPSYO)} THEN 'hapsyo' WHEN {hit(s, rules.HAEYO)} THEN 'haeyo' WHEN {hit(s, rules.BANMAL)} OR {hit(s, rules.CALIBRATION_LINE['informal_address'])} THEN 'banmal' ELSE 'unknown' END"


def bucket(x: str, bounds) -> str:
    out, low = "CASE", 0
    for b in bounds:
        out += f" WHEN {x} <= {b} THEN '{low}-{b}'"
        low = b + 1
    return f"{out} ELSE '{low}+' END"


BREAK = r"\r\n|[\r\n\x{2028}\x{2029}]"
LINES = "[" + ", ".join(map(lit, overlay.LINES)) + "]"
N = len(overlay.LINES)
SIZES = {"nfc_chars": "length(x)", "chars_without_whitespace": f"length(regexp_replace(x, '[{SP}]', '', 'g'))", "utf8_bytes": "strlen(x)", "neis_bytes": "strlen(x)"}


def metrics(source: str, key: str, text: str, speakers: bool = True) -> str:
    line = strip("raw") if speakers else "raw"
    out = ", ".join(f"CAST(coalesce(sum({e}), 0) + {'2 * any_value(breaks)' if k == 'neis_bytes' else '0'} AS BIGINT) AS total_{k}, coalesce(round(sum({e}) / count(x), 1), 0) AS avg_{k}, CAST(coalesce(max({e}), 0) AS BIGINT) AS max_{k}" for k, e in SIZES.items())
    return f"""WITH t AS (SELECT row_number() OVER () AS id, {key}, nfc_normalize(coalesce({text}, '')) AS s FROM {source}),
    u AS (SELECT id, {key}, CAST(len(regexp_extract_all(s, '{BREAK}')) AS BIGINT) AS breaks, unnest(string_split_regex(s, '{BREAK}')) AS part FROM t),
    v AS (SELECT id, {key}, breaks, nullif({trim("part")}, '') AS raw FROM u),
    w AS (SELECT id, {key}, breaks, {line} AS x FROM v)
    SELECT any_value({key}) AS {key}, count(x) AS line_count, any_value(breaks) AS line_breaks, {out} FROM w GROUP BY id"""


DOC = metrics("documents", "doc_id", "text")
LINE_SIGNALS = {**rules.GRAMMAR, **rules.TRANSLATIONESE, **rules.RHYTHM}


def _signals() -> str:
    c = {n: hit("line", p) for n, p in rules.CALIBRATION_LINE.items()}
    found = dict(c)
    found |= {
        "long": "chars > 60", "very_long": "chars > 120", "known_level": "speech <> 'unknown'",
        "bare_command": f"{c['command']} AND NOT {c['buffer']}", "bare_request": f"{c['unsoftened_request']} AND NOT {c['buffer']}", "bare_refusal": f"{c['blunt_refusal']} AND NOT {c['buffer']}",
        "advice_or_overpromise": f"({c['advice']} OR {c['overpromise']})", "written": hit("line", rules.WRITTEN_ENDING), "reaction": f"chars <= 8 AND {hit('line', rules.REACTION)}", "da_ending": hit("line", rules.DA_ENDING),
        "clause_stack": f"{times('line', rules.COUNTED['clause'])} >= 3",
    }
    found |= {n: hit("line", p) for n, p in LINE_SIGNALS.items()} | {n: hit("line", p) for n, p in rules.COUNTED.items()}
    counts = {n: times("line", p) for n, p in {**rules.TRANSLATIONESE, **rules.COUNTED}.items()}
    rows = ", ".join(f"CASE WHEN {cond} THEN {{'signal': '{n}', 'm': CAST({counts.get(n, '1')} AS BIGINT)}} END" for n, cond in found.items())
    return f"SELECT scene_id, line_index, s.signal AS signal, s.m AS m FROM (SELECT scene_id, line_index, unnest([{rows}]) AS s FROM feats) WHERE s IS NOT NULL"


FIELDS = ("scene", "medium", "genre", "character_profiles", "relationship_boundaries")
SCENES = "[" + ", ".join("{" + ", ".join(f"'{f}': {lit(v)}" for f, v in zip(FIELDS, s)) + "}" for s in overlay.SCENES) + "]"
JOINED = "concat_ws(' ', " + ", ".join(f"nullif(s.{f}, '')" for f in FIELDS) + ")"

FEATS = f"""items AS (SELECT conv_id AS scene_id, turn AS item_idx, coalesce(role, '-') || ': ' || {LINES}[(conv_id * 7 + turn * 3) % {N} + 1] AS item FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
  raws AS (SELECT scene_id, row_number() OVER (PARTITION BY scene_id ORDER BY item_idx) AS line_index, {trim("item")} AS raw FROM items),
  lined AS (SELECT scene_id, line_index, raw, {strip("raw")} AS line FROM raws),
  feats AS (SELECT scene_id, line_index, line, length(nfc_normalize(line)) AS chars, length(line) AS raw_chars, {speech("raw")} AS speech, {speech("line")} AS guided, {names("line", rules.ACTS)} AS acts, nullif(regexp_extract({trim("line")}, {lit(re2(rules.ENDING_KEY))}, 1), '') AS ending_key FROM lined),
  scened AS (SELECT DISTINCT conv_id AS scene_id, {SCENES}[conv_id % {len(overlay.SCENES)} + 1] AS s FROM conversations WHERE conv_id IS NOT NULL)"""

STATE_NAMES = sorted({h[4] for h in rules.CALIBRATION_HINTS.values() if h[4]} | {"buffer", "advice", "overpromise", "reaction"} | {x[2] for x in rules.SCENE_SIGNALS.values()} | {x[3] for x in rules.SCENE_HINTS.values() if x[3]})
STATE = f"""{FEATS}, sig0 AS ({_signals()}),
  runs AS (SELECT scene_id, line_index, line_index - row_number() OVER (PARTITION BY scene_id ORDER BY line_index) AS run FROM sig0 WHERE signal = 'da_ending'),
  sig AS (SELECT * FROM sig0 UNION ALL SELECT scene_id, line_index, 'da_streak', 1 FROM (SELECT *, count(*) OVER (PARTITION BY scene_id, run) AS n FROM runs) WHERE n >= 4),
  grouped AS (SELECT scene_id, signal, count(*) AS n, CAST(sum(m) AS BIGINT) AS m, list(line_index ORDER BY line_index) AS refs FROM sig GROUP BY scene_id, signal),
  pivoted AS (SELECT scene_id, {", ".join(f"coalesce(max(n) FILTER (WHERE signal = '{x}'), 0) AS n_{x}, coalesce(max(m) FILTER (WHERE signal = '{x}'), 0) AS m_{x}, any_value(refs) FILTER (WHERE signal = '{x}') AS r_{x}" for x in STATE_NAMES)} FROM grouped GROUP BY scene_id),
  based AS (SELECT scene_id, count(*) AS line_count, CAST(sum(chars) AS BIGINT) AS total_chars, round(sum(chars) / count(*), 1) AS avg_chars, max(chars) AS max_chars, min(chars) AS min_chars, count(DISTINCT speech) FILTER (WHERE speech <> 'unknown') AS known_levels, count(DISTINCT ending_key) AS ending_keys, count(ending_key) AS endings FROM feats GROUP BY scene_id),
  state AS (SELECT 60 AS soft_max, b.*, p.* EXCLUDE (scene_id), {", ".join(f"{hit(JOINED, p)} AS {n}" for n, p in rules.CALIBRATION_CONTEXT.items())} FROM scened JOIN based b USING (scene_id) JOIN pivoted p USING (scene_id))"""

CSV = "coalesce(array_to_string({}, ','), '')"


def calibration(wanted) -> str:
    parts = []
    for seq, (name, (axis, confidence, signals, condition, cited)) in enumerate(rules.CALIBRATION_HINTS.items(), 1):
        if not wanted or name in wanted:
            refs = CSV.format(f"r_{cited}") if cited else "''"
            parts.append(f"SELECT scene_id, {seq} AS seq, '{name}' AS hint, '{axis}' AS axis, CAST({confidence} AS DOUBLE) AS confidence, '{','.join(signals)}' AS signals, {refs} AS line_refs FROM state WHERE {condition}")
    return f"WITH {STATE} " + " UNION ALL ".join(parts)


AXIS = {**dict.fromkeys(rules.GRAMMAR, "grammar_acceptability"), **dict.fromkeys(rules.TRANSLATIONESE, "native_korean_idiom"), **dict.fromkeys(rules.RHYTHM, "spoken_korean_rhythm")}
NAT = f"{STATE}, axed AS (" + " UNION ALL ".join(
    [f"SELECT scene_id, CASE {' '.join(f'''WHEN signal = '{s}' THEN '{a}' ''' for s, a in AXIS.items())} END AS axis, signal, n, m, refs FROM grouped WHERE signal IN ({', '.join(lit(s) for s in AXIS)})"]
    + [f"SELECT scene_id, '{axis}', '{name}', n_{ref}, m_{ref}, r_{ref} FROM state WHERE {cond}" for name, (axis, cond, ref) in rules.SCENE_SIGNALS.items()]
) + ")"
ORDER = {a: k for k, a in enumerate(rules.AXIS_CONFIDENCE, 1)}
NAT_HINTS = f"{NAT}, hinted AS (" + " UNION ALL ".join(
    [f"SELECT scene_id, CASE axis {' '.join(f'''WHEN '{a}' THEN {k}''' for a, k in ORDER.items())} END AS seq, axis, CAST(CASE axis {' '.join(f'''WHEN '{a}' THEN {c}''' for a, c in rules.AXIS_CONFIDENCE.items())} END AS DOUBLE) AS confidence, array_to_string(list_sort(list_distinct(list(signal))), ',') AS signals, array_to_string(list_sort(list_distinct(flatten(list(refs)))), ',') AS line_refs FROM axed GROUP BY scene_id, axis"]
    + [f"SELECT scene_id, {seq}, '{axis}', CAST({conf} AS DOUBLE), '{name}', {CSV.format(f'r_{cited}') if cited else lit('')} FROM state WHERE {cond}" for seq, (name, (axis, conf, cond, cited)) in enumerate(rules.SCENE_HINTS.items(), 4)]
) + ")"
SIGNAL_ROWS = f"SELECT scene_id, signal, n, m, {CSV.format('refs')} AS line_refs FROM axed"

BANK = "\n".join(
    f"""u{d} AS (SELECT {d} AS dataset, {LINES}[(doc_id * 13 + pos) % {N} + 1] AS text, {SCENES}[doc_id % {len(overlay.SCENES)} + 1].relationship_boundaries AS blob
    FROM (SELECT {d}, doc_id, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents)),
  f{d} AS (SELECT dataset, length(text) AS chars, {bucket("length(text)", rules.LENGTH_BOUNDS)} AS length, {speech("text")} AS speech, {names("text", rules.ACTS)} AS acts, {names("blob || ' ' || text", rules.CONTEXTS)} AS contexts FROM u{d}),
  e{d} AS (SELECT NULL AS context, * FROM f{d} UNION ALL SELECT unnest(contexts) AS context, * FROM f{d}),
  k{d} AS (SELECT dataset, context, 'length' AS family, length AS key FROM e{d} UNION ALL SELECT dataset, context, 'speech', speech FROM e{d} UNION ALL SELECT dataset, context, 'act', unnest(acts) FROM e{d}
    UNION ALL SELECT dataset, context, 'marker', m FROM (SELECT dataset, context, unnest(acts) AS m FROM e{d}) WHERE m IN ({", ".join(map(lit, rules.MARKERS))}) UNION ALL SELECT dataset, context, 'context', unnest(contexts) FROM e{d} WHERE context IS NULL),
  t{d} AS (SELECT dataset, context, count(*) AS total FROM e{d} GROUP BY ALL),
  r{d} AS (SELECT dataset, k.context, family, key, count(*) AS cnt, any_value(total) AS total, round(count(*) / any_value(total), 4) AS rate FROM k{d} k JOIN t{d} t USING (dataset) WHERE k.context IS NOT DISTINCT FROM t.context GROUP BY dataset, k.context, family, key),
  p{d} AS (SELECT dataset, count(*) AS utterances, round(sum(chars) / count(*), 1) AS avg_chars, max(chars) AS max_chars FROM f{d} GROUP BY dataset)"""
    for d in ("lang",)
)
PROFILE = BANK.replace("lang", "source")
TOTALS = "(SELECT context, sum(total) AS total FROM tlang GROUP BY context)"
RAW = f"raw AS (SELECT x.context, family, key, CAST(cnt AS BIGINT) AS cnt, CAST(total AS BIGINT) AS total, round(cnt / total, 4) AS rate FROM (SELECT context, family, key, sum(cnt) AS cnt FROM rlang GROUP BY ALL) x JOIN {TOTALS} y ON x.context IS NOT DISTINCT FROM y.context)"
BALANCED = "bal AS (SELECT x.context, family, key, datasets, CAST((2 * s + datasets) // (2 * datasets) AS DOUBLE) / 10000 AS rate FROM (SELECT context, family, key, CAST(sum(CAST(round(rate * 10000) AS BIGINT)) AS BIGINT) AS s FROM rlang GROUP BY ALL) x JOIN (SELECT context, count(*) AS datasets FROM tlang GROUP BY context) y ON x.context IS NOT DISTINCT FROM y.context)"
BALANCED_SIZE = "SELECT CAST(sum(utterances) AS BIGINT) AS utterances, count(*) AS datasets, round(avg(avg_chars), 4) AS avg_chars, max(max_chars) AS max_chars FROM plang"

MATCHED = f"""{FEATS}, said AS (SELECT scene_id, count(*) AS line_count, max(raw_chars) AS max_chars, count(DISTINCT guided) FILTER (WHERE guided <> 'unknown') AS known_levels, list_sort(list_distinct(flatten(list(acts)))) AS acts, string_agg(line, ' ' ORDER BY line_index) AS lines FROM feats GROUP BY scene_id),
  matched AS (SELECT scene_id, line_count, max_chars, known_levels, acts, {names(f"concat_ws(' ', nullif({JOINED}, ''), nullif(lines, ''))", rules.CONTEXTS)} AS contexts FROM scened JOIN said USING (scene_id))"""


def guidance() -> str:
    wanted = {m: [s for s, g in rules.GUIDANCE.items() if m in g[4]] for m in ("apology", "polite_buffer", "empathy")}
    flags = ", ".join([f"list_contains(contexts, '{c}') AS c_{c}" for c in rules.CONTEXTS] + [f"list_contains(acts, '{a}') AS a_{a}" for a in rules.ACTS])
    parts = []
    for signal, (axis, conf, cond, cited, _) in rules.GUIDANCE.items():
        first, _, second = (cited or "").partition("|")
        name = f"CASE WHEN c_{first} THEN '{first}' ELSE '{second}' END" if second else lit(cited) if cited else "CAST(NULL AS VARCHAR)"
        parts.append(f"SELECT scene_id, contexts, '{signal}' AS signal, '{axis}' AS axis, CAST({conf} AS DOUBLE) AS confidence, {name} AS cited FROM flagged WHERE {cond}")
    rate = ", ".join(f"CASE WHEN signal IN ({', '.join(map(lit, w))}) THEN coalesce((SELECT rate FROM bal WHERE context = cited AND family = 'marker' AND key = '{m}'), 0) END AS {m}_rate" for m, w in wanted.items())
    return f"""WITH {MATCHED}, {BANK}, {BALANCED}, size AS ({BALANCED_SIZE}),
    flagged AS (SELECT *, {flags}, greatest(80, CAST(floor((SELECT avg_chars FROM size) * 2.5) AS INT), least((SELECT max_chars FROM size), 180)) AS density_threshold FROM matched),
    hits AS ({" UNION ALL ".join(parts)})
    SELECT scene_id, signal, axis, confidence, array_to_string(contexts, ',') AS contexts, coalesce(cited, '') AS cited, coalesce((SELECT CAST(sum(total) AS BIGINT) FROM tlang t WHERE t.context = cited), 0) AS utterances, {rate} FROM hits"""


GUIDED = guidance()
UNAVAILABLE = f"WITH {MATCHED} SELECT scene_id, 'bank_unavailable' AS signal, 'genre_fit' AS axis, CAST(0.99 AS DOUBLE) AS confidence, array_to_string(contexts, ',') AS contexts FROM matched"
LENGTHS = f"SELECT {bucket('length(x)', rules.LENGTH_BOUNDS)} AS bucket, count(*) AS cnt FROM (SELECT {trim('part')} AS x FROM (SELECT unnest(string_split_regex(coalesce(text, ''), '{BREAK}')) AS part FROM documents)) WHERE x <> '' GROUP BY 1"
META = "(VALUES " + ", ".join("(" + ", ".join(lit(x) for x in (s, *m)) + ")" for s, m in rules.SIGNAL_METADATA.items()) + ") AS meta(signal, category, severity, scope)"
KINDS = "(VALUES " + ", ".join(f"({lit(s)}, {lit(k)})" for k, v in rules.SUGGESTIONS.items() for s in v) + ") AS kinds(signal, suggestion_type)"


def _has(words) -> str:
    return " OR ".join(f"contains(lower(path), {lit(w)})" for w in words)


PATHS = "(VALUES " + ", ".join(f"({lit(p)})" for p in Q.PATHS) + ") AS v(path)"
RECORDS = f"""SELECT path, CASE WHEN contains(path, '/') THEN string_split(path, '/')[1] ELSE regexp_replace(path, '\\.[^.]*$', '') END AS dataset, lower(regexp_extract(path, '(\\.[^./]*)$', 1)) AS extension,
  CASE WHEN {_has(("valid", "/vl_"))} THEN 'validation' WHEN {_has(("train", "/tl_"))} THEN 'training' WHEN {_has(("test",))} THEN 'test' WHEN {_has(("dev",))} THEN 'dev' ELSE 'unknown' END AS split,
  CASE WHEN {_has(("라벨링", "[라벨]", "label", "/vl_", "/tl_"))} THEN 'label' WHEN {_has(("원천", "원시", "source", "/vs_", "/ts_"))} THEN 'source' ELSE 'unknown' END AS data_role FROM {PATHS}"""

ORACLES = {
    "doc_text_metrics": DOC,
    "metrics_keep_speakers": f"SELECT doc_id, line_count, total_nfc_chars, max_nfc_chars FROM ({metrics('documents', 'doc_id', 'text', speakers=False)})",
    "doc_line_metrics": f"""WITH t AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '{BREAK}'), lambda p: {trim("p")}), lambda p: p <> '') AS parts FROM documents WHERE text IS NOT NULL),
      u AS (SELECT doc_id, i AS line_index, nfc_normalize({strip("parts[i]")}) AS x FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM t))
      SELECT doc_id, line_index, {", ".join(f"{e} AS {k}" for k, e in SIZES.items())} FROM u""",
    "line_break_counts": f"SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '{BREAK}')) AS line_breaks FROM documents",
    "conv_text_metrics": f"""WITH t AS (SELECT conv_id AS scene_id, nfc_normalize(coalesce(text, '')) AS s FROM conversations), b AS (SELECT scene_id, CAST(sum(len(regexp_extract_all(s, '{BREAK}'))) AS BIGINT) AS breaks FROM t GROUP BY scene_id),
      w AS (SELECT scene_id, CASE WHEN raw <> '' THEN {strip("raw")} END AS x FROM (SELECT scene_id, {trim("part")} AS raw FROM (SELECT scene_id, unnest(string_split_regex(s, '{BREAK}')) AS part FROM t)))
      SELECT scene_id, count(x) AS line_count, any_value(breaks) AS line_breaks, {", ".join(f"CAST(coalesce(sum({e}), 0) + {'2 * any_value(breaks)' if k == 'neis_bytes' else '0'} AS BIGINT) AS total_{k}, coalesce(round(sum({e}) / count(x), 1), 0) AS avg_{k}, CAST(coalesce(max({e}), 0) AS BIGINT) AS max_{k}" for k, e in SIZES.items())} FROM w JOIN b USING (scene_id) GROUP BY scene_id""",
    "metrics_by_lang": f"SELECT lang, count(*) AS docs, CAST(sum(line_count) AS BIGINT) AS line_count, CAST(sum(total_nfc_chars) AS BIGINT) AS nfc_chars, CAST(sum(total_utf8_bytes) AS BIGINT) AS utf8_bytes, max(max_nfc_chars) AS max_nfc_chars FROM ({metrics('documents', 'lang', 'text')}) GROUP BY lang",
    "speech_level_by_line": f"WITH {FEATS} SELECT scene_id, line_index, speech FROM feats",
    "speech_level_counts": f"WITH {FEATS} SELECT scene_id, {', '.join(f'''count(*) FILTER (WHERE speech = '{s}') AS {s}''' for s in ('banmal', 'haeyo', 'hapsyo', 'unknown'))} FROM feats GROUP BY scene_id",
    "act_counts": f"WITH {FEATS} SELECT scene_id, act, count(*) AS cnt FROM (SELECT scene_id, unnest(acts) AS act FROM feats) GROUP BY scene_id, act",
    "context_matches": f"WITH {MATCHED} SELECT scene_id, array_to_string(contexts, ',') AS contexts, array_to_string(acts, ',') AS acts FROM matched",
    "marker_counts": f"WITH {BANK} SELECT dataset, key, cnt FROM rlang WHERE family = 'marker' AND context IS NULL",
    "length_buckets": LENGTHS,
    **{name: calibration(hints) for name, hints in Q.CALIBRATION.items()},
    "calib_large_packet": "SELECT doc_id AS scene_id, 'genre_fit' AS axis, CAST(0.56 AS DOUBLE) AS confidence, len(string_split(coalesce(text, ''), chr(10))) AS line_count FROM documents WHERE len(string_split(coalesce(text, ''), chr(10))) > 20",
    "calib_thresholds": f"SELECT s AS short_share, CASE WHEN s < 0.6 THEN 80 ELSE 60 END AS soft_max, 120 AS hard_max FROM (SELECT round(sum(cnt) FILTER (WHERE bucket IN ('0-10', '11-30', '31-60')) / sum(cnt), 4) AS s FROM ({LENGTHS}))",
    **{name: f"WITH {NAT} {SIGNAL_ROWS} WHERE axis = '{a}'" for name, a in Q.AXES.items()},
    **{name: f"WITH {NAT} {SIGNAL_ROWS} WHERE signal = '{s}'" for name, s in Q.SCENE_SIGNALS.items()},
    **{name: f"WITH {NAT_HINTS} SELECT * FROM hinted WHERE signals = '{s}'" for name, s in Q.SCENE_HINTS.items()},
    "nat_all_hints": f"WITH {NAT_HINTS} SELECT * FROM hinted",
    "nat_ending_diversity": f"WITH {STATE} SELECT scene_id, line_count, total_chars, avg_chars, max_chars, n_reaction AS short_reactions, n_written AS written_sentences, m_pronoun AS pronouns, m_third_person AS third_person_pronouns, m_progressive AS progressives, m_discourse AS discourse_markers, n_clause_stack AS clause_stacks, n_da_streak AS da_streak_lines, CASE WHEN endings > 0 THEN round(ending_keys / endings, 2) ELSE 0 END AS ending_key_diversity FROM state",
    "nat_signal_counts": f"WITH {NAT} SELECT scene_id, signal, CASE WHEN signal IN ('relative_clause_stack', 'da_ending_streak') THEN n ELSE m END AS cnt FROM axed WHERE signal IN ({', '.join(lit(s) for s in (*rules.TRANSLATIONESE, *rules.SCENE_SIGNALS))})",
    "nat_metadata_join": f"WITH {NAT} SELECT signal, category, severity, scope, count(*) AS scenes, CAST(sum(n) AS BIGINT) AS lines FROM axed JOIN {META} USING (signal) GROUP BY ALL",
    "nat_suggestions": f"WITH {NAT} SELECT suggestion_type, count(*) AS scene_signals, count(DISTINCT scene_id) AS scenes FROM axed JOIN {KINDS} USING (signal) GROUP BY suggestion_type",
    "bank_raw_rates": f"WITH {BANK}, {RAW} SELECT family, key, cnt, total, rate FROM raw WHERE context IS NULL",
    "bank_dataset_profile": f"WITH {PROFILE} SELECT * FROM psource",
    "bank_dataset_rates": f"WITH {BANK} SELECT dataset, family, key, cnt, total, rate FROM rlang WHERE context IS NULL",
    "bank_balanced_rates": f"WITH {BANK}, {BALANCED} SELECT family, key, datasets, rate FROM bal WHERE context IS NULL",
    "bank_context_raw": f"WITH {BANK}, {RAW} SELECT * FROM raw WHERE context IS NOT NULL",
    "bank_context_balanced": f"WITH {BANK}, {BALANCED} SELECT * FROM bal WHERE context IS NOT NULL",
    "bank_politeness": f"WITH {BANK}, {RAW} SELECT context, key, cnt, total, rate FROM raw WHERE family = 'marker' AND context IN ({', '.join(map(lit, rules.POLITENESS_CONTEXTS))})",
    "bank_turn_buckets": f"SELECT bucket, count(*) AS cnt, round(count(*) / sum(count(*)) OVER (), 4) AS rate FROM (SELECT {bucket('count(*)', rules.TURN_BOUNDS)} AS bucket FROM conversations GROUP BY conv_id) GROUP BY bucket",
    "bank_labels_top80": "WITH l AS (SELECT 'quality' AS key, CAST(quality AS VARCHAR) AS value FROM labels UNION ALL SELECT 'toxic', CAST(toxic AS VARCHAR) FROM labels UNION ALL SELECT 'event_type', event_type FROM events) SELECT key, value, cnt FROM (SELECT key, value, count(*) AS cnt, row_number() OVER (PARTITION BY key ORDER BY count(*) DESC, value) AS r FROM l WHERE value <> '' AND length(value) <= 40 AND NOT regexp_matches(value, '[\\n.?!。…]') GROUP BY key, value) WHERE r <= 80",
    "bank_dominance": f"WITH {BANK} SELECT s AS dominant_share, n AS datasets, s >= 0.5 AND n > 1 AS warning FROM (SELECT round(max(utterances) / sum(utterances), 4) AS s, count(*) AS n FROM plang)",
    "bank_sizes": f"WITH {BANK} SELECT 'raw' AS mode, count(*) AS utterances, count(DISTINCT dataset) AS datasets, round(sum(chars) / count(*), 1) AS avg_chars, max(chars) AS max_chars FROM flang UNION ALL SELECT 'balanced', * FROM ({BALANCED_SIZE})",
    **{name: f"SELECT * FROM ({GUIDED}) WHERE signal = '{s}'" for name, s in Q.GUIDANCE.items()},
    "guide_all": GUIDED,
    "guide_unavailable": UNAVAILABLE,
    "inventory_split_role": RECORDS,
    "inventory_summary": f"WITH r AS ({RECORDS}) SELECT 'dataset' AS kind, dataset AS name, count(*) AS files FROM r GROUP BY dataset UNION ALL SELECT 'extension', extension, count(*) FROM r GROUP BY extension",
    "json_shape": "SELECT '$.' || k AS path, CASE json_type(props, '$.\"' || k || '\"') WHEN 'UBIGINT' THEN 'int' WHEN 'BIGINT' THEN 'int' WHEN 'DOUBLE' THEN 'float' WHEN 'BOOLEAN' THEN 'bool' ELSE 'str' END AS type, count(*) AS cnt FROM (SELECT CAST(props AS JSON) AS props, unnest(json_keys(CAST(props AS JSON))) AS k FROM events) GROUP BY ALL",
    "hygiene_scan": "SELECT doc_id, pos, field FROM (SELECT doc_id, pos, ['text', 'note', 'summary', 'Utterance', '발화'][(doc_id + pos) % 5 + 1] AS field FROM (SELECT doc_id, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents)) WHERE pos % 3 = 0 AND pos % 2 = 1 AND field <> 'note'",
    "example_filter": "SELECT * FROM (VALUES " + ", ".join(f"({k}, 'card-{k:02d}', {lit(c[0])}, {lit(c[1])})" for k, c in list(enumerate(catalog.CARDS, 1)) if c[0] == "speech_level" and sum(x[0] == "speech_level" for x in catalog.CARDS[: k - 1]) < 4) + ") AS v(seq, id, category, scene)",
    "rubric_catalog": "SELECT axis, count(*) AS anchors FROM (VALUES " + ", ".join(f"('{a}')" for a in rules.AXES) + ") AS a(axis), (VALUES (5), (3), (1)) AS s(score) GROUP BY axis",
    "audit_packet": f"WITH {NAT_HINTS}, cal AS ({calibration(()).replace('WITH ' + STATE, '')}) SELECT scene_id, line_count, total_chars, (SELECT count(*) FROM cal WHERE cal.scene_id = b.scene_id) AS calibration, (SELECT count(*) FROM hinted h WHERE h.scene_id = b.scene_id) AS naturalness, 1 AS guidance FROM based b",
}
