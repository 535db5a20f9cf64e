"""The linkage queries in DuckDB's SQL over the driver's tables."""

from __future__ import annotations

from linkwright.functions import tables as K
from linkwright.operators.features import ADDRESS, ALL, BOTH_EMPTY, INTERACTION, NAME, ONE_EMPTY
from linkwright.operators.normalize import legal_pattern


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _case(key: str, table: dict[str, str], other: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in table.items()) + f" ELSE {other} END"


def _clean(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower(strip_accents({x})), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


W = r"""w AS (SELECT doc_id, lang, n_chars, string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') ws FROM documents)"""
E = (
    W
    + """, e AS (SELECT doc_id AS ingest_seq, CASE doc_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS source,
  CASE doc_id % 3 WHEN 0 THEN 'S1-' WHEN 1 THEN 'S2-' ELSE 'S3-' END || CAST(doc_id AS VARCHAR) AS entity_id,
  array_to_string(ws[1:3], ' ') || CASE doc_id % 5 WHEN 0 THEN ' Pvt Ltd' WHEN 1 THEN ' Ltd' WHEN 2 THEN ', Inc.' WHEN 3 THEN ' SARL' ELSE '' END AS business_name,
  CASE WHEN doc_id % 30 = 7 THEN '' ELSE CAST(n_chars % 97 + 1 AS VARCHAR) || ' ' || coalesce(ws[4], 'x') || ' St, ' || coalesce(ws[5], 'y') || ' ' || CAST(10000 + n_chars % 53 AS VARCHAR) END AS business_address,
  CASE lang WHEN 'en' THEN 'usa' WHEN 'fr' THEN 'FR' WHEN 'de' THEN 'germany' ELSE 'India' END AS country,
  array_to_string(ws[1:8], ' ') AS gt_key FROM w)"""
)
COUNTRY = "coalesce(" + _case("lower(trim(country))", K.COUNTRIES, "NULL") + ", upper(trim(country)[1]) || lower(trim(country)[2:]))"


def _names() -> str:
    dba = _q(K.DBA)
    out = [
        f"d0 AS (SELECT *, CASE WHEN regexp_matches(business_name, {dba}, 'i') THEN CASE WHEN trim(regexp_extract(business_name, {dba}, 2, 'i')) <> '' THEN trim(regexp_extract(business_name, {dba}, 2, 'i')) ELSE trim(regexp_extract(business_name, {dba}, 1, 'i')) END ELSE business_name END AS t0 FROM e)",
        f"d1 AS (SELECT *, regexp_replace(t0, {_q(K.DOMAIN)}, '', 'i') AS t1 FROM d0)",
        f"d2 AS (SELECT *, {_clean("CASE WHEN starts_with(t1, 'www.') THEN t1[5:] ELSE t1 END")} AS cleaned FROM d1)",
        "p0 AS (SELECT *, ' ' || replace(cleaned, ' ', '  ') || ' ' AS l, [] :: VARCHAR[] AS found FROM d2)",
    ]
    for k, (form, phrases) in enumerate(K.LEGAL_FORMS):
        p = _q(legal_pattern(phrases))
        out.append(f"p{k + 1} AS (SELECT * EXCLUDE (l, found), regexp_replace(l, {p}, ' ', 'g') AS l, CASE WHEN regexp_matches(l, {p}) THEN list_append(found, {_q(form)}) ELSE found END AS found FROM p{k})")
    late = _case("x", K.LEGAL_WORDS, "NULL")
    out += [
        f"t AS (SELECT * EXCLUDE (l), [x FOR x IN regexp_split_to_array(l, ' +') IF x <> ''] AS tokens FROM p{len(K.LEGAL_FORMS)})",
        f"u AS (SELECT *, [x FOR x IN tokens IF ({late}) IS NULL] AS rest, [y FOR y IN [({late}) FOR x IN tokens] IF y IS NOT NULL] AS late FROM t)",
        "v AS (SELECT *, CASE WHEN len(rest) > 0 THEN array_to_string(rest, ' ') ELSE cleaned END AS core FROM u)",
        """n AS (SELECT *, regexp_replace(cleaned, '[^a-z0-9]', '', 'g') AS alnum, array_to_string(list_sort(tokens), ' ') AS sorted_t,
  array_to_string([x FOR x, i IN tokens IF list_position(tokens, x) = i], ' ') AS deduped,
  array_to_string(list_concat(found, [x FOR x, i IN late IF list_position(late, x) = i AND NOT list_contains(found, x)]), ' ') AS legal,
  [substr(' ' || core || ' ', i, 3) FOR i IN range(1, greatest(length(core), 1) + 1)] AS grams FROM v)""",
    ]
    return ", ".join(out)


def _addresses() -> str:
    street = _case("x", K.STREET_WORDS, "x")
    state = _case("y", K.STATES, "y")
    return f"""a0 AS (SELECT *, trim(business_address) = '' AS a_empty, [{state} FOR y IN [{street} FOR x IN string_split({_clean('business_address')}, ' ') IF x <> '']] AS a_tokens FROM n),
a AS (SELECT *, array_to_string(a_tokens, ' ') AS a_cleaned, regexp_replace(array_to_string(a_tokens, ' '), '[^a-z0-9]', '', 'g') AS a_alnum,
  array_to_string(list_sort(list_distinct(a_tokens)), ' ') AS a_sorted,
  [CASE WHEN regexp_full_match(x, '0+') THEN '0' ELSE ltrim(x, '0') END FOR x IN a_tokens IF regexp_full_match(x, '\\d+')] AS a_num,
  regexp_extract(business_address, {_q(K.POSTAL)}) AS postal, lower(regexp_extract(business_address, {_q(K.BUILDING)}, 1, 'i')) AS building,
  {COUNTRY} AS country_norm, lower({COUNTRY}) AS ckey FROM a0)"""


RECORDS = f"WITH {E}, {_names()}, {_addresses()}, s1 AS (SELECT * FROM a WHERE source = 1), tg AS (SELECT * FROM a WHERE source > 1)"
TRUTH = "gt AS (SELECT x.entity_id AS s1_id, y.entity_id AS target_id FROM e x JOIN e y ON x.country = y.country AND x.gt_key = y.gt_key WHERE x.source = 1 AND y.source > 1), asked AS (SELECT entity_id AS s1_id FROM e WHERE source = 1)"
LINES = "gl AS (SELECT asked.s1_id, coalesce(string_agg(target_id, ',' ORDER BY target_id), '') AS matched FROM asked LEFT JOIN gt USING (s1_id) GROUP BY asked.s1_id)"
_COMMON = ", ".join(map(_q, K.COMMON_TOKENS))


def _block(key: str, where: str) -> str:
    return f"SELECT DISTINCT s.entity_id AS s1_id, g.entity_id AS target_id FROM s1 s JOIN tg g ON s.ckey = g.ckey AND s.{key} = g.{key} WHERE {where}"


BLOCKS = {
    "core": _block("core", "length(g.core) >= 3"),
    "sorted": _block("sorted_t", "len(g.tokens) >= 2"),
    "alnum": _block("alnum", "length(g.alnum) >= 4"),
    "token": f"""SELECT DISTINCT s.entity_id AS s1_id, p.entity_id AS target_id FROM (SELECT ckey, entity_id, unnest(list_distinct(tokens)) AS tok FROM s1) s JOIN (
  SELECT * FROM (SELECT ckey, entity_id, source, ingest_seq, unnest(tokens) AS tok, generate_subscripts(tokens, 1) AS pos FROM tg) WHERE length(tok) >= 4 AND tok NOT IN ({_COMMON})
  QUALIFY row_number() OVER (PARTITION BY ckey, tok ORDER BY source, ingest_seq, pos) <= 150) p ON s.ckey = p.ckey AND s.tok = p.tok""",
}


def _address_block(key: str) -> str:
    return f"""SELECT DISTINCT s.entity_id AS s1_id, p.entity_id AS target_id FROM (SELECT ckey, entity_id, {key} AS k FROM s1) s JOIN (
  SELECT * FROM (SELECT ckey, entity_id, source, ingest_seq, {key} AS k FROM tg) WHERE k IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ckey, k ORDER BY source, ingest_seq, entity_id) <= 100) p ON s.ckey = p.ckey AND s.k = p.k"""


_POSTAL = "CASE WHEN NOT a_empty AND postal <> '' AND core <> '' THEN postal || '|' || lower(core[1:2]) END"
_STREET = r"CASE WHEN regexp_full_match(a_tokens[1], '\d+') THEN a_tokens[2] ELSE a_tokens[1] END"
_BUILDING = f"CASE WHEN NOT a_empty AND building <> '' AND len(a_tokens) >= 2 AND length({_STREET}) >= 3 THEN building || '|' || {_STREET} END"
BLOCKS |= {"postal": _address_block(_POSTAL), "building": _address_block(_BUILDING)}
GRAMS = r"""gr AS (SELECT id, source, gram, count(*) AS tf FROM (SELECT entity_id AS id, source, unnest(CASE WHEN length(w) <= 3 THEN [w] ELSE list_concat([substr(w, i, 3) FOR i IN range(1, length(w) - 1)], [substr(w, i, 4) FOR i IN range(1, greatest(length(w) - 2, 2))]) END) AS gram
  FROM (SELECT entity_id, source, ' ' || unnest([x FOR x IN regexp_split_to_array(lower(core || ' ' || a_cleaned), '\s+') IF x <> '']) || ' ' AS w FROM (SELECT * FROM s1 UNION ALL SELECT * FROM tg))) GROUP BY ALL),
df AS (SELECT gram, ln((1 + (SELECT count(*) FROM tg)) / (1 + count(*))::DOUBLE) + 1 AS idf FROM gr WHERE source > 1 GROUP BY gram),
ww AS (SELECT id, source, gram, (1 + ln(tf)) * idf AS raw FROM gr JOIN df USING (gram)),
wt AS (SELECT id, source, gram, raw / sqrt(sum(raw * raw) OVER (PARTITION BY id)) AS weight FROM ww)"""
SIMILAR = f"""{GRAMS}, sm AS (SELECT x.id AS s1_id, y.id AS target_id, round(sum(x.weight * y.weight), 9) AS similarity FROM wt x JOIN wt y USING (gram) WHERE x.source = 1 AND y.source > 1 GROUP BY ALL),
cs AS (SELECT * FROM sm WHERE similarity >= 0.25 QUALIFY row_number() OVER (PARTITION BY s1_id ORDER BY similarity DESC, target_id) <= 20)"""
CANDIDATES = f"""ce AS ({BLOCKS['core']} UNION {BLOCKS['sorted']} UNION {BLOCKS['alnum']}), ct AS ({BLOCKS['token']}), ca AS ({BLOCKS['postal']} UNION {BLOCKS['building']}),
{SIMILAR}, cu AS (SELECT s1_id, target_id, max(x) = 1 AS gen_exact, max(t) = 1 AS gen_token, max(f) = 1 AS gen_tfidf, max(d) = 1 AS gen_address, CAST(max(x) + max(t) + max(f) + max(d) AS INTEGER) AS gen_count
  FROM (SELECT *, 1 AS x, 0 AS t, 0 AS f, 0 AS d FROM ce UNION ALL SELECT *, 0, 1, 0, 0 FROM ct UNION ALL SELECT s1_id, target_id, 0, 0, 1, 0 FROM cs UNION ALL SELECT *, 0, 0, 0, 1 FROM ca) GROUP BY s1_id, target_id)"""
#: The inference form leaves the similarity join out.
FEWER = CANDIDATES.replace(f"{SIMILAR}, ", "").replace("UNION ALL SELECT s1_id, target_id, 0, 0, 1, 0 FROM cs ", "")
ORDER = "gen_count DESC, gen_exact DESC, gen_token DESC, gen_tfidf DESC, target_id"
TOP = f"ck AS (SELECT * FROM cu QUALIFY row_number() OVER (PARTITION BY s1_id ORDER BY {ORDER}) <= 45)"
def _jaccard(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    return f"CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0 WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE {both}::DOUBLE / (len(list_distinct({a})) + len(list_distinct({b})) - {both}) END"


def _overlap(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0 WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b}))::DOUBLE / least(len(list_distinct({a})), len(list_distinct({b}))) END"


def _bytes(x: str, a: str, b: str) -> str:
    """x with each character of the pair as a byte of its own: DuckDB's distances are of bytes, and only ask which are equal."""
    return f"CASE WHEN length({a} || {b}) = strlen({a} || {b}) THEN {x} ELSE array_to_string([chr(CAST(list_position(list_distinct(string_split({a} || {b}, '')), c) AS INTEGER)) FOR c IN string_split({x}, '')], '') END"


def _lev(a: str, b: str) -> str:
    return f"CASE WHEN {a} = '' AND {b} = '' THEN 1.0 WHEN {a} = '' OR {b} = '' THEN 0.0 ELSE 1 - levenshtein({_bytes(a, a, b)}, {_bytes(b, a, b)})::DOUBLE / greatest(length({a}), length({b})) END"


def _jw(a: str, b: str) -> str:
    return f"CASE WHEN {a} = '' AND {b} = '' THEN 1.0 WHEN {a} = '' OR {b} = '' THEN 0.0 ELSE jaro_winkler_similarity({_bytes(a, a, b)}, {_bytes(b, a, b)}) END"


def _prefix(a: str, b: str) -> str:
    return f"CASE WHEN {a} = '' OR {b} = '' THEN 0.0 ELSE len([i FOR i IN range(1, least(length({a}), length({b})) + 1) IF {a}[1:i] = {b}[1:i]])::DOUBLE / greatest(length({a}), length({b})) END"


def _gap(a: str, b: str) -> str:
    return f"abs(length({a}) - length({b}))::DOUBLE / greatest(length({a}), length({b}), 1)"


def _eq(c: str) -> str:
    return f"CAST(l.{c} = r.{c} AS DOUBLE)"


NAME_SQL = [_eq("cleaned"), _eq("core"), _eq("sorted_t"), _eq("alnum"), _jaccard("l.tokens", "r.tokens"), _overlap("l.tokens", "r.tokens"), "len(list_intersect(l.tokens, r.tokens))::DOUBLE", _jaccard("l.grams", "r.grams"), _lev("l.core", "r.core"), _jw("l.core", "r.core"), None, _prefix("l.core", "r.core"), _gap("l.core", "r.core"), "abs(len(l.tokens) - len(r.tokens))::DOUBLE"]


def _agree(c: str) -> str:
    return f"CASE WHEN l.{c} <> '' AND r.{c} <> '' THEN {_eq(c)} ELSE 0.5 END"


ADDRESS_SQL = ["0.0", "0.0", _eq("a_cleaned"), _eq("a_sorted"), _eq("a_alnum"), _jaccard("l.a_tokens", "r.a_tokens"), _overlap("l.a_tokens", "r.a_tokens"), "len(list_intersect(l.a_tokens, r.a_tokens))::DOUBLE", _lev("l.a_cleaned", "r.a_cleaned"), "len(list_intersect(l.a_num, r.a_num))::DOUBLE", _agree("postal"), _agree("building"), _gap("l.a_cleaned", "r.a_cleaned")]
INTERACTION_SQL = ["name_levenshtein * addr_levenshtein", "(name_levenshtein + addr_levenshtein) / 2", "name_token_jaccard * addr_token_jaccard", "2 * name_levenshtein * addr_levenshtein / (name_levenshtein + addr_levenshtein + 1e-6)", "name_exact_clean * addr_exact_clean", "abs(name_levenshtein - addr_levenshtein)", "CAST(ckey_l = ckey_r AS DOUBLE)"]
PAIRS = "FROM ck JOIN s1 l ON l.entity_id = ck.s1_id JOIN tg r ON r.entity_id = ck.target_id"
#: Longest common subsequence: a row of the table per character of the one text, from the row before by a running maximum.
_STEP = "[list_max([greatest(acc[k], CASE WHEN y[k] = chr(x[1]) THEN coalesce(acc[k - 1], 0) + 1 ELSE 0 END) FOR k IN range(1, j + 1)]) FOR j IN range(1, length(y) + 1)]"
SORTED = f"""st AS (SELECT s1_id, target_id, array_to_string(list_sort([t FOR t IN string_split(l.cleaned, ' ') IF t <> '']), ' ') AS x_, array_to_string(list_sort([t FOR t IN string_split(r.cleaned, ' ') IF t <> '']), ' ') AS y {PAIRS}),
lc AS (SELECT s1_id, target_id, x_, y, CASE WHEN x_ = '' OR y = '' THEN 0 ELSE list_last(list_reduce([[unicode(c)] FOR c IN string_split(x_, '')], lambda acc, x: {_STEP}, [0 FOR k IN range(1, length(y) + 1)])) END AS n FROM st)"""
TOKEN_SORT = "CASE WHEN x_ = '' AND y = '' THEN 1.0 ELSE 2 * n::DOUBLE / greatest(length(x_) + length(y), 1) END"
FN = f"{SORTED}, fn AS (SELECT ck.s1_id, ck.target_id, l.ckey AS ckey_l, r.ckey AS ckey_r, gen_exact, gen_token, gen_tfidf, gen_address, gen_count, " + ", ".join(f"{s or TOKEN_SORT} AS {n}" for n, s in zip(NAME, NAME_SQL, strict=True)) + ", " + ", ".join(f"CASE WHEN l.a_empty AND r.a_empty THEN {x}::DOUBLE WHEN l.a_empty OR r.a_empty THEN {y}::DOUBLE ELSE {s} END AS {n}" for n, s, x, y in zip(ADDRESS, ADDRESS_SQL, BOTH_EMPTY, ONE_EMPTY, strict=True)) + f" {PAIRS} JOIN lc ON lc.s1_id = ck.s1_id AND lc.target_id = ck.target_id)"
FI = "fi AS (SELECT *, " + ", ".join(f"{s} AS {n}" for n, s in zip(INTERACTION, INTERACTION_SQL, strict=True)) + " FROM fn)"
FEATURES = f"{FN}, {FI}"


def _rounded(names: list[str]) -> str:
    return ", ".join(f"round(CAST({n} AS DOUBLE), 6) AS {n}" for n in names)


def _counts(pred: str) -> str:
    return f"""ec AS (SELECT asked.s1_id, coalesce(n_pred, 0) AS n_pred, coalesce(n_gt, 0) AS n_gt, coalesce(tp, 0) AS tp FROM asked
  LEFT JOIN (SELECT s1_id, count(*) AS n_pred FROM ({pred}) GROUP BY s1_id) USING (s1_id) LEFT JOIN (SELECT s1_id, count(*) AS n_gt FROM gt GROUP BY s1_id) USING (s1_id)
  LEFT JOIN (SELECT s1_id, count(*) AS tp FROM ({pred}) SEMI JOIN gt USING (s1_id, target_id) GROUP BY s1_id) USING (s1_id))"""


def _ef(extra: str = "") -> str:
    score = lambda x: f"CASE WHEN n_pred = 0 AND n_gt = 0 THEN 1.0 WHEN n_pred = 0 OR n_gt = 0 THEN 0.0 ELSE {x} END"
    p, r = "tp::DOUBLE / greatest(n_pred, 1)", "tp::DOUBLE / greatest(n_gt, 1)"
    return f"ef AS (SELECT {extra}n_pred, n_gt, tp, {score(p)} AS precision, {score(r)} AS recall, {score(f'CASE WHEN tp > 0 THEN 1.25 * ({p}) * ({r}) / (0.25 * ({p}) + ({r})) ELSE 0.0 END')} AS f05 FROM ec)"


MACRO = "SELECT count(*) AS num_entities, round(avg(precision), 5) AS macro_precision, round(avg(recall), 5) AS macro_recall, round(avg(f05), 5) AS macro_f05, CAST(coalesce(sum(CASE WHEN n_gt = 0 THEN 1 ELSE 0 END), 0) AS BIGINT) AS singleton_count, round(coalesce(avg(f05) FILTER (n_gt = 0), 0.0), 5) AS singleton_accuracy, round(coalesce(avg(f05) FILTER (n_gt > 0), 0.0), 5) AS non_singleton_f05 FROM ef"
BASE = "bl AS (SELECT DISTINCT l.entity_id AS s1_id, r.entity_id AS target_id FROM s1 l JOIN tg r ON l.country_norm = r.country_norm AND l.core = r.core AND l.a_cleaned = r.a_cleaned)"
PRED_BASE = "SELECT s1_id, target_id FROM bl"
PRED_CORE = f"SELECT s1_id, target_id FROM ({BLOCKS['core']})"
#: For queries without a trained model: the harmonic similarity stands for a probability.
SCORED = "sc AS (SELECT s1_id, target_id, round(harmonic_sim, 6) AS prob FROM fi)"
THRESHOLDS = "th AS (SELECT round(0.15 + 0.02 * k, 4) AS threshold FROM range(0, 36) x(k))"
SWEEP = f"""ec AS (SELECT th.threshold, asked.s1_id, coalesce(n_gt, 0) AS n_gt, coalesce(n_pred, 0) AS n_pred, coalesce(tp, 0) AS tp FROM th CROSS JOIN asked
  LEFT JOIN (SELECT s1_id, count(*) AS n_gt FROM gt GROUP BY s1_id) USING (s1_id)
  LEFT JOIN (SELECT threshold, s1_id, count(*) AS n_pred, count(gt.s1_id) AS tp FROM th JOIN sc ON prob >= threshold LEFT JOIN gt USING (s1_id, target_id) GROUP BY threshold, s1_id) USING (threshold, s1_id)),
{_ef('threshold, ')}, sw AS (SELECT threshold, round(avg(f05), 5) AS macro_f05 FROM ef GROUP BY threshold)"""
POSITIVES = "po AS (SELECT s1_id, target_id, coalesce(gen_exact, false) AS gen_exact, coalesce(gen_token, false) AS gen_token, coalesce(gen_tfidf, false) AS gen_tfidf, coalesce(gen_address, false) AS gen_address, coalesce(gen_count, 0) AS gen_count FROM gt LEFT JOIN ck USING (s1_id, target_id))"
NEGATIVES = f"ne AS (SELECT * EXCLUDE (r, cap) FROM (SELECT c.*, row_number() OVER (PARTITION BY c.s1_id ORDER BY {ORDER}) AS r, coalesce(cap, 2) AS cap FROM ck c ANTI JOIN gt USING (s1_id, target_id) LEFT JOIN (SELECT s1_id, greatest(1, floor(count(*) * 3.0)) AS cap FROM po GROUP BY s1_id) USING (s1_id)) WHERE r <= cap)"
SPARE = "sp AS (SELECT s1_id, target_id FROM (SELECT asked.s1_id, tg.entity_id AS target_id, tg.source, tg.ingest_seq FROM asked, tg WHERE asked.s1_id NOT IN (SELECT s1_id FROM ne)) ANTI JOIN gt USING (s1_id, target_id) QUALIFY row_number() OVER (PARTITION BY s1_id ORDER BY source, ingest_seq) = 1)"


def _pct(x: str, n: str, d: int) -> str:
    return f"round(({x})::DOUBLE / greatest({n}, 1) * 100, {d})"


def _profile() -> str:
    miss = ", ".join(f"count(*) FILTER ({c} = '') AS missing_{many}, {_pct(f"count(*) FILTER ({c} = '')", 'count(*)', 4)} AS missing_{one}_pct" for c, one, many in (("n", "name", "names"), ("a", "address", "addresses"), ("c", "country", "countries")))
    dup = ", ".join(f"{_pct(f'count(*) - count(DISTINCT {x})', 'count(*)', 2)} AS sample_duplicate_{k}_pct" for x, k in (("n", "name"), ("a", "addr"), ("(n, a)", "combo")))
    tok = lambda c: rf"len([x FOR x IN regexp_split_to_array({c}, '\s+') IF x <> ''])"
    mean = ", ".join(f"round(avg(length({c})), 2) AS {k}_length_mean, round(avg({tok(c)}), 2) AS {k}_tokens_mean" for c, k in (("n", "name"), ("a", "addr")))
    script = ", ".join(f"{_pct(f'count(*) FILTER (regexp_matches(n, {_q(r)}))', 'count(*)', 2)} AS {k}_pct" for r, k in ((K.DEVANAGARI_RANGE, "devanagari_script"), (K.GUJARATI_RANGE, "gujarati_script"), (K.ACCENTS, "accented_chars")))
    return f"WITH {E}, f AS (SELECT source, trim(business_name) AS n, trim(business_address) AS a, trim(country) AS c FROM e) SELECT source, count(*) AS total_records, count(*) AS sampled_records, {miss}, {dup}, {mean}, {script} FROM f GROUP BY source"


def _text(select: str) -> str:
    return f"WITH {E} SELECT entity_id, {select} FROM e"


_c = _clean("business_name")
_LIST = "array_to_string({}, '|')"


def sql() -> dict[str, str]:
    r, out = RECORDS, {}
    out["entities"] = f"WITH {E} SELECT * FROM e"
    out["scan_country_filter"] = f"WITH {E} SELECT entity_id, business_name, country FROM e WHERE lower(country) = 'usa' ORDER BY ingest_seq LIMIT 100"
    out["scan_tsv_country"] = f"WITH {E} SELECT entity_id, trim(business_name) AS business_name, trim(business_address) AS business_address, trim(country) AS country FROM e WHERE lower(country) = 'usa'"
    out["gt_parse_explode"] = f"WITH {E}, {TRUTH} SELECT s1_id, target_id FROM gt"
    out["gt_singletons"] = f"WITH {E}, {TRUTH} SELECT s1_id FROM asked ANTI JOIN gt USING (s1_id)"
    out["target_sample_semi"] = f"WITH {E}, {TRUTH} SELECT entity_id, source FROM e WHERE source > 1 AND entity_id IN (SELECT target_id FROM gt) UNION ALL SELECT entity_id, source FROM (SELECT * FROM e WHERE source > 1 AND entity_id NOT IN (SELECT target_id FROM gt) QUALIFY row_number() OVER (PARTITION BY source ORDER BY ingest_seq) <= 50)"
    out["text_clean"] = _text(f"{_c} AS cleaned")
    out["text_alnum"] = _text("regexp_replace(lower(strip_accents(business_name)), '[^a-z0-9]', '', 'g') AS alnum")
    out["text_tokens"] = _text(f"array_to_string([x FOR x IN string_split({_c}, ' ') IF x <> ''], '|') AS tokens")
    out["text_sorted_tokens"] = _text(f"array_to_string(list_sort(list_distinct([x FOR x IN string_split({_c}, ' ') IF x <> ''])), ' ') AS sorted_tokens")
    out["text_char_ngrams"] = _text(f"array_to_string([substr(' ' || {_c} || ' ', i, 3) FOR i IN range(1, greatest(length({_c}), 1) + 1)], '|') AS char_ngrams")
    out["text_numbers"] = _text(r"array_to_string(regexp_extract_all(business_address, '\b\d+\b'), '|') AS numbers")
    out["has_indic"] = _text(f"regexp_matches(business_name, {_q(K.INDIC)}) AS has_indic")
    out["norm_country"] = _text(f"{COUNTRY} AS country_norm")
    out["norm_name"] = f"{r} SELECT entity_id, cleaned, alnum, {_LIST.format('tokens')} AS tokens, sorted_t AS sorted_tokens, deduped AS deduped_tokens, core AS core_name, legal AS legal_suffix, {_LIST.format('grams')} AS char_ngrams FROM a"
    out["norm_address"] = f"{r} SELECT entity_id, a_cleaned AS cleaned, a_alnum AS alnum, {_LIST.format('a_tokens')} AS tokens, a_sorted AS sorted_tokens, {_LIST.format('a_num')} AS numeric_tokens, postal AS postal_code, building AS building_number, a_empty AS is_empty FROM a"
    for name, key in (("block_exact_core", "core"), ("block_exact_sorted", "sorted"), ("block_exact_alnum", "alnum"), ("block_token_capped", "token"), ("block_addr_postal", "postal"), ("block_addr_building", "building")):
        out[name] = f"{r} {BLOCKS[key]}"
    out["block_exact_union"] = f"{r} {BLOCKS['core']} UNION {BLOCKS['sorted']} UNION {BLOCKS['alnum']}"
    out["tfidf_weights"] = f"{r}, {GRAMS} SELECT id, gram, round(weight, 6) AS weight FROM wt WHERE source > 1"
    out["block_tfidf_topk"] = f"{r}, {SIMILAR} SELECT s1_id, target_id, round(similarity, 6) AS similarity FROM cs"
    out["baseline_exact_join"] = f"{r}, {BASE} SELECT * FROM bl"
    cand = f"{r}, {TRUTH}, {CANDIDATES}, {TOP}"
    out["candidate_union_provenance"] = f"{r}, {CANDIDATES} SELECT * FROM cu"
    out["candidate_topk"] = f"{cand} SELECT * FROM ck"
    figures = """q AS (SELECT (SELECT count(*) FROM asked) AS total_s1, (SELECT count(*) FROM gt) AS total_gt_pairs, (SELECT count(*) FROM gt SEMI JOIN ck USING (s1_id, target_id)) AS recalled_gt_pairs, (SELECT count(*) FROM ck) AS total_candidates_generated, (SELECT count(*) FROM tg) AS nt)
SELECT total_s1, total_gt_pairs, recalled_gt_pairs, round(recalled_gt_pairs::DOUBLE / greatest(total_gt_pairs, 1), 5) AS candidate_recall, round(recalled_gt_pairs::DOUBLE / greatest(total_gt_pairs, 1) * 100, 2) AS candidate_recall_pct, total_candidates_generated, round(total_candidates_generated::DOUBLE / greatest(total_s1, 1), 2) AS avg_candidates_per_s1, round(1 - total_candidates_generated::DOUBLE / greatest(total_s1 * nt, 1), 6) AS reduction_ratio FROM q"""
    out["candidate_recall"] = f"{cand}, {figures}"
    few = "s1 AS (SELECT * FROM a WHERE source = 1 AND entity_id IN (SELECT s1_id FROM gt)), tg AS (SELECT * FROM a WHERE source > 1 AND entity_id IN (SELECT target_id FROM gt) UNION ALL SELECT * FROM (SELECT * FROM a WHERE source > 1 AND entity_id NOT IN (SELECT target_id FROM gt) QUALIFY row_number() OVER (PARTITION BY source ORDER BY ingest_seq) <= 50))"
    pairs, records = TRUTH.split(", asked AS")[0], RECORDS.split(", s1 AS")[0]
    out["controlled_recall"] = f"{records}, {pairs}, asked AS (SELECT DISTINCT s1_id FROM gt), {few}, {CANDIDATES}, {TOP}, {figures}"
    kinds = " UNION ALL ".join(f"SELECT '{k}' AS strategy, {c} AS on_, s1_id, target_id FROM ck" for k, c in (("union", "true"), ("exact", "gen_exact"), ("token", "gen_token"), ("tfidf", "gen_tfidf"), ("address", "gen_address")))
    out["recall_by_strategy"] = f"{cand}, ks AS ({kinds}) SELECT strategy, count(*) FILTER (on_) AS candidates, count(gt.s1_id) FILTER (on_) AS recalled FROM ks LEFT JOIN gt USING (s1_id, target_id) GROUP BY strategy"
    feat = f"{cand}, {FEATURES}"
    for name, cols in (("sim_jaccard", ["name_token_jaccard", "addr_token_jaccard", "name_char_jaccard"]), ("sim_overlap", ["name_token_overlap", "addr_token_overlap"]), ("sim_prefix", ["name_prefix_sim"]), ("sim_token_sort", ["name_token_sort_ratio"]), ("sim_levenshtein", ["name_levenshtein", "addr_levenshtein"]), ("sim_jaro_winkler", ["name_jaro_winkler"]), ("features_name", NAME), ("features_address", ADDRESS), ("features_interaction", INTERACTION), ("features_all", ALL)):
        out[name] = f"{feat} SELECT s1_id, target_id, {_rounded(cols)} FROM fi"
    out["match_semi_subset"] = f"{cand}, {BASE} SELECT * FROM bl SEMI JOIN ck USING (s1_id, target_id)"
    out["missed_positives_anti"] = f"{r}, {TRUTH}, {BASE} SELECT * FROM gt ANTI JOIN bl USING (s1_id, target_id)"
    out["split_train_val"] = f"WITH {E}, {TRUTH} SELECT s1_id, row_number() OVER (ORDER BY md5('42|' || s1_id), s1_id) <= floor((SELECT count(*) FROM asked) * (1 - 0.2)) AS is_train FROM asked"
    train = f"{cand}, {POSITIVES}, {NEGATIVES}, {SPARE}"
    out["hard_negatives"] = f"{cand}, {POSITIVES}, {NEGATIVES} SELECT * FROM ne"
    out["training_pairs"] = f"{train} SELECT *, 1 AS label FROM po UNION ALL SELECT *, 0 FROM ne UNION ALL SELECT s1_id, target_id, false, false, false, false, 0, 0 FROM sp"
    out["entity_f05"] = f"{r}, {TRUTH}, {BASE}, {_counts(PRED_CORE)}, {_ef('s1_id, ')} SELECT s1_id, n_pred, n_gt, tp, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f05, 6) AS f05 FROM ef"
    out["macro_f05"] = f"{r}, {TRUTH}, {BASE}, {_counts(PRED_BASE)}, {_ef()} {MACRO}"
    out["macro_f05_core"] = f"{r}, {TRUTH}, {_counts(PRED_CORE)}, {_ef()} {MACRO}"
    sweep = f"{feat}, {SCORED}, {THRESHOLDS}, {SWEEP}"
    out["threshold_sweep"] = f"{sweep} SELECT * FROM sw"
    out["threshold_best"] = f"{sweep} SELECT * FROM sw ORDER BY macro_f05 DESC, threshold LIMIT 1"
    total = lambda x: f"CAST(coalesce(sum({x}), 0) AS BIGINT)"
    out["error_totals"] = f"{r}, {TRUTH}, {_counts(PRED_CORE)} SELECT {total('tp')} AS total_tp_pairs, {total('n_pred - tp')} AS total_fp_pairs, {total('n_gt - tp')} AS total_fn_pairs, {total('CASE WHEN n_gt = 0 AND n_pred > 0 THEN 1 ELSE 0 END')} AS singleton_false_positives_count, {total('CASE WHEN n_gt > 0 AND n_pred = 0 THEN 1 ELSE 0 END')} AS singleton_false_negatives_count FROM ec"
    out["error_samples"] = f"""{r}, {TRUTH}, {_counts(PRED_CORE)}, pr AS ({PRED_CORE}), both_ AS (SELECT s1_id FROM ec WHERE n_gt > 0 AND n_pred > 0),
er AS (SELECT 'false_positive' AS kind, s1_id, target_id FROM pr ANTI JOIN gt USING (s1_id, target_id) SEMI JOIN both_ USING (s1_id) UNION ALL SELECT 'false_negative', s1_id, target_id FROM gt ANTI JOIN pr USING (s1_id, target_id) SEMI JOIN both_ USING (s1_id))
SELECT * FROM er QUALIFY row_number() OVER (PARTITION BY kind ORDER BY s1_id, target_id) <= 15"""
    out["error_multi_match"] = f"{r}, {TRUTH}, {_counts(PRED_CORE)}, {_ef('s1_id, ')} SELECT s1_id, n_gt AS true_count, n_pred AS pred_count, tp AS tp_count, round(f05, 4) AS f05 FROM ef WHERE n_gt > 1 AND n_pred > 0 AND (n_pred > tp OR n_gt > tp) ORDER BY s1_id LIMIT 15"
    out["profile_source"] = _profile()
    out["profile_country_hist"] = f"WITH {E} SELECT source, trim(country) AS country, count(*) AS records FROM e WHERE trim(country) <> '' GROUP BY ALL"
    mc = "mc AS (SELECT len(ids) AS n, len([x FOR x IN ids IF starts_with(x, 'S2-')]) AS s2, len([x FOR x IN ids IF starts_with(x, 'S3-')]) AS s3 FROM (SELECT [trim(x) FOR x IN string_split(matched, ',') IF trim(x) <> ''] AS ids FROM gl))"
    truth = f"WITH {E}, {TRUTH}, {LINES}, {mc}"
    parts = ", ".join(f"count(*) FILTER ({c}) AS {a}, {_pct(f'count(*) FILTER ({c})', 'count(*)', 2)} AS {b}" for a, b, c in (("singletons_zero_matches", "singletons_pct", "n = 0"), ("one_match", "one_match_pct", "n = 1"), ("multi_matches", "multi_matches_pct", "n > 1")))
    out["profile_gt"] = f"{truth} SELECT count(*) AS total_s1_entities, {parts}, {total('n')} AS total_matched_pairs, round(coalesce(sum(n), 0)::DOUBLE / greatest(count(*), 1), 3) AS mean_matches_per_s1, CAST(coalesce(max(n), 0) AS INTEGER) AS max_matches, {total('s2')} AS total_s2_matches, {total('s3')} AS total_s3_matches FROM mc"
    out["profile_gt_hist"] = f"{truth} SELECT CAST(n AS INTEGER) AS matches, count(*) AS entities FROM mc GROUP BY n"
    out["write_matching_format"] = f"WITH {E}, {TRUTH}, {LINES} SELECT s1_id AS source1_entity_id, matched AS matched_entity_ids FROM gl"
    out["validate_subset"] = f"{r}, {TRUTH}, {BASE} SELECT 'not in candidate_pairs' AS problem, s1_id, target_id FROM gt ANTI JOIN bl USING (s1_id, target_id)"
    out["resolve_fixed_scorer"] = f"{r}, {TRUTH}, {FEWER}, {TOP}, {FEATURES}, {SCORED} SELECT s1_id, target_id, prob FROM sc WHERE prob >= 0.5"
    return out
