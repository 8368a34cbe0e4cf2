"""DuckDB SQL for the registered queries, in another formulation than the jobs.

Phrases are matched by containment in padded token strings and picked by ``row_number``;
labels are cut with window functions. Lexicon and pool come in as literal rows.
"""

from __future__ import annotations

from larder.operators.labels import NOISE, PANEL_UNITS
from larder.plans.adapters import AS_OF, generated_rows, pool
from larder.sources.lexicon import ENAME_STAGE, PROFILE_KEYS, _FOOD_STAGE, _OTHER_STAGE, _REASONS, seed_rows


def _lit(x) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, int) else "'" + str(x).replace("'", "''") + "'"


def _values(rows: list[tuple], columns: str) -> str:
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_lit, r)) + ')' for r in rows)}) AS v({columns}))"


def _norm(x: str) -> str:
    x = f"regexp_replace(lower(coalesce({x}, '')), '\\([^)]*\\)', ' ', 'g')"
    x = f"regexp_replace({x}, '[0-9]+(\\.[0-9]+)?\\s*%', ' ', 'g')"
    return f"trim(regexp_replace(regexp_replace({x}, '[^a-z0-9&''\\- ]', ' ', 'g'), ' +', ' ', 'g'))"


def _padded(x: str) -> str:
    """Tokens of normalised text between single spaces."""
    return f"(' ' || trim(regexp_replace({x}, '[^a-z0-9]+', ' ', 'g')) || ' ')"


def _merged_rows() -> dict[str, list[tuple]]:
    """The seed with the generated entries that it lacks after its own."""
    seed, more = seed_rows(), generated_rows()
    of = {"additives": lambda r: (r[1], r[2]), "enumbers": lambda r: r[1], "terms": lambda r: (r[0], r[2]), "concern_terms": lambda r: (r[0], r[3])}
    place = {"additives": 0, "enumbers": 0, "terms": 1, "concern_terms": 2}
    for name, key in of.items():
        have, i = {key(r) for r in seed[name]}, place[name]
        shift = 1 + max(r[i] for r in seed[name])
        # Of equal keys the first stays.
        fresh = {key(r): r for r in reversed(more[name]) if key(r) not in have}
        seed[name] = seed[name] + [(*r[:i], r[i] + shift, *r[i + 1 :]) for r in fresh.values()]
    return seed


def _lexicon(seed: dict[str, list[tuple]] | None = None) -> str:
    seed, rows = seed or seed_rows(), []
    for seq, family, key, names, enumber, category, risk, *_ in seed["additives"]:
        rows += [(family, 1, seq * 1000 + i, n, key, risk, None, category, names[0], enumber) for i, n in enumerate(names)]
    for seq, code, name, risk in seed["enumbers"]:
        rows.append(("food", ENAME_STAGE, seq, name, None, risk, "e" + risk.capitalize(), None, name, code))
    for family, stages in (("food", _FOOD_STAGE), ("nonfood", _OTHER_STAGE)):
        rows += [(family, stages[k], seq, p, None, (_REASONS.get(k) or ("good", ""))[0], k, None, None, None) for k, seq, p in seed["terms"] if k in stages]
    rows += [("nonfood", o + 2, seq, p, None, status, b, None, None, None) for b, o, seq, p, status, _ in seed["concern_terms"]]
    values = _values(rows, "family, stage, seq, raw, additive_id, status, grp, category, name, code")
    return f"""lexicon AS (
  SELECT *, {_padded(_norm('raw'))} AS phrase FROM {values}
), lexicon_ok AS (
  SELECT *, CASE WHEN stage = 1 THEN -(length(phrase) - length(replace(phrase, ' ', ''))) ELSE 0 END AS longer FROM lexicon
  WHERE trim(phrase) <> '' AND (stage <> {ENAME_STAGE} OR trim(phrase) LIKE '% %' OR length(trim(phrase)) >= 4)
), enumbers AS {_values(seed['enumbers'], 'seq, code, name, risk')}"""


def _label(k: str) -> str:
    words = pool()
    pick = lambda i: f"(SELECT w FROM words WHERE n = ({k} * 7 + {i} * 13 + {i} * {i}) % {len(words)})"  # noqa: E731, F841
    return f"""'Ingredients: ' || coalesce((SELECT string_agg(CASE WHEN {k} % 7 = 0 AND i = {k} % 13 - 1 THEN '(' || w || ')' ELSE w END, ', ' ORDER BY o)
    FROM (SELECT i, i * 2 + 1 AS o, {k} AS kk FROM range(0, 12) r(i) WHERE i < {k} % 13 UNION ALL SELECT -1, 0, {k} WHERE {k} % 13 = 3) s
    JOIN words ON n = ({k} * 7 + greatest(i, 0) * 13 + greatest(i, 0) * greatest(i, 0)) % {len(words)}), '')
  || CASE WHEN {k} % 5 = 0 THEN '. Calories 120. Total Fat 2g. Distributed by ACME. www.acme.com' ELSE '' END
  || CASE WHEN {k} % 11 = 0 THEN '. Contains: Milk, Soy' ELSE '' END"""


_WORDS = "words AS " + _values([(i, w) for i, w in enumerate(pool())], "n, w")


def _products(text: str | None = None, kind: str | None = None) -> str:
    """Products with the label text and type given by expressions, else the part's own."""
    text = text or _label("p_partkey")
    kind = kind or "CASE WHEN p_partkey % 10 <= 6 THEN 'food' WHEN p_partkey % 10 = 7 THEN 'petfood' WHEN p_partkey % 10 = 8 THEN 'beauty' ELSE 'household' END"
    t = lambda c, m: f"((p_partkey * {c} % {m}) / 10.0)::DOUBLE"
    return f"""{_WORDS}, products AS (
  SELECT p_partkey AS product_id, CASE WHEN p_partkey % 19 = 0 THEN '' ELSE lpad(p_partkey::VARCHAR, 13, '0') END AS barcode,
    p_name AS name, p_brand AS brand, lower(p_type) AS category,
    {kind} AS product_type, CASE WHEN {kind} IN ('food', 'petfood') THEN 'food' ELSE 'nonfood' END AS family,
    {text} AS ingredients_text,
    ((p_partkey % 5) * 25)::DOUBLE AS serving, CASE WHEN p_partkey % 17 <> 0 THEN 1 + p_size % 4 END AS nova_group,
    CASE WHEN p_partkey % 17 <> 1 THEN substr('abcde', (1 + p_size % 5)::INT, 1) END AS nutriscore_grade,
    {t(37, 6000)} AS kcal100, {t(11, 100)} AS sat, {t(23, 400)} AS sug, {t(7, 90)} AS fib, {t(13, 200)} AS pro, {t(29, 800)} AS carb, {t(17, 350)} AS fat100,
    CASE WHEN p_partkey % 6 <> 0 THEN {t(19, 30)} END AS salt, {t(3, 12)} AS sodium,
    CASE WHEN p_partkey % 4 = 0 THEN {t(41, 5000)} END AS kcal_serving
  FROM part
)"""


def _parse(source: str, key: str, text: str, extra: str = "", kept: str = " WHERE pos < 81") -> str:
    """CTE ``ingredients (id, extra, pos, raw, norm)``."""
    t = f"translate(coalesce({text}, ''), chr(160) || chr(65279), '  ')"
    t = f"regexp_replace({t}, '(?i)\\b(?:https?://|www\\.)\\S+', ' ', 'g')"
    t = f"regexp_replace({t}, '\\S+@\\S+\\.\\S+', ' ', 'g')"
    t = f"regexp_replace({t}, '(?i)\\b[\\w.\\-]+\\.(?:com|net|org|co|us)\\b', ' ', 'g')"
    t = f"regexp_replace({t}, '(?i)ingredients?:?', ' ')"
    t = f"regexp_replace({t}, '(?i)contains( 2% or less of| less than 2% of)?:?', ',', 'g')"
    t = f"regexp_replace({t}, '[\\[\\]{{}}]', ',', 'g')"
    t = f"regexp_replace({t}, '(?i)\\band\\b', ',', 'g')"
    more = f", {extra}" if extra else ""
    return f"""pieces AS (
  SELECT {key} AS id{more}, unnest(parts) AS piece, generate_subscripts(parts, 1) AS place
  FROM (SELECT {key}{more}, regexp_split_to_array({t}, '[,;.]+') AS parts FROM {source})
), bare AS (
  SELECT * EXCLUDE (piece), trim(regexp_replace(piece, '\\([^)]*\\)', '', 'g')) AS piece FROM pieces
), normed AS (
  SELECT id{more}, place, trim(regexp_replace(piece, '\\s+', ' ', 'g')) AS raw, {_norm('piece')} AS norm FROM bare WHERE piece <> ''
), kept AS (
  SELECT *, lag(norm) OVER (PARTITION BY id ORDER BY place) AS before FROM normed
  WHERE length(norm) >= 2 AND NOT regexp_matches(norm, '\\b(?:{NOISE})\\b') AND NOT regexp_matches(norm, '\\b\\d+(\\.\\d+)?\\s?(?:{PANEL_UNITS})\\b')
), ingredients AS (
  SELECT id{more}, pos, raw, norm FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY place) - 1 AS pos FROM kept WHERE before IS NULL OR before <> norm){kept}
)"""


_CLASSIFIED = f"""vocabulary AS (
  SELECT DISTINCT family, norm, CASE WHEN family = 'food' THEN regexp_extract(' ' || lower(raw), '[^a-z0-9_]e ?([0-9]{{3,4}}[a-z]?)(?:[^a-z0-9_]|$)', 1) ELSE '' END AS ecode FROM ingredients
), hits AS (
  SELECT v.*, l.*, row_number() OVER (PARTITION BY v.family, v.norm, v.ecode ORDER BY l.stage, l.longer, l.seq) AS n
  FROM vocabulary v LEFT JOIN (SELECT family AS lfamily, stage, longer, seq, phrase, additive_id, status, grp, name, code FROM lexicon_ok) l
    ON l.lfamily = v.family AND contains({_padded('v.norm')}, l.phrase)
), told AS (
  SELECT h.family, h.norm, h.ecode,
    CASE WHEN coded THEN coalesce(e.risk, 'caution') WHEN h.stage IS NULL THEN 'unknown' ELSE h.status END AS status,
    CASE WHEN coded THEN 'e' || upper(substr(coalesce(e.risk, 'caution'), 1, 1)) || substr(coalesce(e.risk, 'caution'), 2) WHEN h.stage IS NULL THEN 'unknown' ELSE h.grp END AS grp,
    CASE WHEN coded THEN coalesce(e.name, 'Additive E' || upper(h.ecode)) WHEN h.stage IS NOT NULL THEN h.name END AS name,
    CASE WHEN coded THEN coalesce(e.code, 'E' || upper(h.ecode)) WHEN h.stage IS NOT NULL THEN h.code END AS enumber,
    CASE WHEN NOT coded THEN h.additive_id END AS additive_id
  FROM (SELECT *, ecode <> '' AND (stage IS NULL OR stage > 6) AS coded FROM hits WHERE n = 1) h
  LEFT JOIN enumbers e ON lower(e.code) = 'e' || h.ecode AND h.ecode <> ''
), classified AS (
  SELECT i.id AS product_id, i.pos, i.raw, i.norm, i.family, t.status, t.grp, t.name, t.enumber, t.additive_id
  FROM ingredients i JOIN told t ON t.family = i.family AND t.norm = i.norm
    AND t.ecode = CASE WHEN i.family = 'food' THEN regexp_extract(' ' || lower(i.raw), '[^a-z0-9_]e ?([0-9]{{3,4}}[a-z]?)(?:[^a-z0-9_]|$)', 1) ELSE '' END
)"""

_R1 = lambda x: f"floor({x} * 10 + 0.5) / 10"
_NUTRITION = f"""nutrition AS (
  SELECT product_id, ord, label, {_R1('v')} AS value_num, unit, CASE WHEN v <= good THEN 'good' WHEN v <= mid THEN 'mid' ELSE 'bad' END AS sev FROM (
    SELECT product_id, 1 AS ord, 'Calories' AS label, kcal100 AS v, 'kcal' AS unit, 120.0 AS good, 300.0 AS mid FROM products WHERE family = 'food'
    UNION ALL SELECT product_id, 2, 'Saturated fat', sat, 'g', 1.5, 5.0 FROM products WHERE family = 'food'
    UNION ALL SELECT product_id, 3, 'Sugar', sug, 'g', 5.0, 22.5 FROM products WHERE family = 'food'
    UNION ALL SELECT product_id, 4, 'Salt', coalesce(salt, sodium * 2.5), 'g', 0.3, 1.5 FROM products WHERE family = 'food'
    UNION ALL SELECT product_id, 5, 'Fiber', fib, 'g', 1e9, 1e9 FROM products WHERE family = 'food' AND fib >= 3
    UNION ALL SELECT product_id, 6, 'Protein', pro, 'g', 1e9, 1e9 FROM products WHERE family = 'food' AND pro >= 8)
)"""
_NOTE = """CASE WHEN label = 'Fiber' AND value_num >= 6 THEN 'Plenty' WHEN label IN ('Fiber', 'Protein') THEN 'A fair amount'
  WHEN label = 'Calories' THEN CASE sev WHEN 'good' THEN 'Light' WHEN 'mid' THEN 'Medium' ELSE 'Rich in energy' END
  WHEN label = 'Saturated fat' THEN CASE sev WHEN 'good' THEN 'Little' WHEN 'mid' THEN 'Some' ELSE 'A lot' END
  ELSE CASE sev WHEN 'good' THEN 'Barely ' WHEN 'mid' THEN '' ELSE 'Very ' END || CASE WHEN sev = 'mid' THEN CASE label WHEN 'Sugar' THEN 'Sweet' ELSE 'Salty' END WHEN label = 'Sugar' THEN 'sweet' ELSE 'salty' END END"""
_SCORED = """counted AS (
  SELECT p.*, coalesce(n_avoid, 0) AS n_avoid, coalesce(n_caution, 0) AS n_caution, coalesce(n_limit, 0) AS n_limit, coalesce(n_all, 0) AS n_ingredients,
    coalesce(n_bad, 0) AS n_bad, CASE WHEN family = 'food' THEN coalesce(nutriscore_grade, '') ELSE '' END AS grade, coalesce(family = 'food' AND nova_group = 4, false) AS nova
  FROM products p
  LEFT JOIN (SELECT product_id, count(*) FILTER (WHERE status = 'avoid') AS n_avoid, count(*) FILTER (WHERE status = 'caution') AS n_caution,
    count(*) FILTER (WHERE status = 'limit') AS n_limit, count(*) AS n_all FROM classified GROUP BY product_id) USING (product_id)
  LEFT JOIN (SELECT product_id, count(*) AS n_bad FROM nutrition WHERE sev = 'bad' GROUP BY product_id) USING (product_id)
), pointed AS (
  SELECT *, least(100, greatest(0, 100 - 22 * n_avoid - 10 * n_caution - 4 * n_limit - CASE WHEN nova THEN 8 ELSE 0 END
    + CASE grade WHEN 'e' THEN -12 WHEN 'd' THEN -7 WHEN 'a' THEN 5 ELSE 0 END - 4 * n_bad)) AS points FROM counted
), scored AS (
  SELECT *, (CASE WHEN n_avoid > 0 AND points >= 40 THEN 39 ELSE points END)::INT AS score, (n_avoid + n_caution)::INT AS flagged_count FROM pointed
), badged AS (
  SELECT *, CASE WHEN n_avoid > 0 THEN 'bad' WHEN score >= 80 THEN 'exc' WHEN score >= 60 THEN 'good' WHEN score >= 40 THEN 'mid' ELSE 'bad' END AS badge_cls FROM scored
), analysis AS (
  SELECT *, CASE WHEN badge_cls = 'exc' THEN 'Excellent' WHEN badge_cls = 'good' THEN 'Good' WHEN badge_cls = 'mid' THEN 'Poor' ELSE 'Bad' END AS badge_label,
    CASE WHEN family = 'food' THEN coalesce(floor(kcal_serving + 0.5), floor((CASE WHEN serving <> 0 THEN kcal100 * serving / 100 ELSE kcal100 END) + 0.5))::INT END AS kcal,
    CASE WHEN family = 'food' THEN floor((CASE WHEN serving <> 0 THEN pro * serving / 100 ELSE pro END) + 0.5)::INT END AS protein,
    CASE WHEN family = 'food' THEN floor((CASE WHEN serving <> 0 THEN carb * serving / 100 ELSE carb END) + 0.5)::INT END AS carbs,
    CASE WHEN family = 'food' THEN floor((CASE WHEN serving <> 0 THEN fat100 * serving / 100 ELSE fat100 END) + 0.5)::INT END AS fat
  FROM badged
), sides AS (
  SELECT product_id, ord, label, value_num, sev, sev = 'good' AS positive FROM nutrition
  UNION ALL SELECT product_id, 0, 'Additives', flagged_count::DOUBLE, 'bad', false FROM analysis WHERE flagged_count > 0
  UNION ALL SELECT product_id, 0, 'Additives', NULL, 'good', true FROM analysis WHERE flagged_count = 0 AND n_ingredients > 0
)"""
_SCANS = """scans AS (
  SELECT event_id AS scan_id, user_id, event_id * 31 % (SELECT count(*) FROM part) AS product_id, ts, event_type, CASE WHEN event_type IN ('purchase', 'view') THEN 'eaten' ELSE 'checked' END AS logged,
    least(10.0, greatest(0.25, floor(value / 10.0 * 4 + 0.5) / 4)) AS portion FROM events
), latest AS (
  SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY user_id, product_id ORDER BY ts DESC, scan_id DESC) AS n FROM scans) WHERE n = 1
)"""
_HEALTH = """health AS (
  SELECT c_custkey AS user_id, CASE WHEN c_custkey % 2 = 0 THEN 'male' ELSE 'female' END AS sex, CASE WHEN c_custkey % 23 = 0 THEN 0 ELSE 18 + c_custkey % 60 END AS age,
    (150 + c_custkey % 50)::DOUBLE AS cm, 45 + ((c_custkey * 3 % 700) / 10.0)::DOUBLE AS kg,
    CASE WHEN c_custkey % 29 = 0 THEN 1.375::DOUBLE ELSE ([1.2::DOUBLE, 1.375, 1.55, 1.725, 1.9])[c_custkey % 5 + 1] END AS activity,
    ([-500, 0, 400])[c_custkey % 3 + 1] AS goal FROM customer
), burned AS (
  SELECT *, 10 * kg + 6.25::DOUBLE * cm - 5 * age + CASE WHEN sex = 'female' THEN -161 ELSE 5 END AS bmr FROM health WHERE age > 0
), targets AS (
  SELECT user_id, floor(bmr + 0.5::DOUBLE)::INT AS bmr, floor(bmr * activity + 0.5::DOUBLE)::INT AS tdee, greatest(1200, floor(bmr * activity + goal + 0.5::DOUBLE))::INT AS target FROM burned
), split AS (
  SELECT *, floor(target * 0.3::DOUBLE / 4 + 0.5::DOUBLE)::INT AS protein, floor(target * 0.4::DOUBLE / 4 + 0.5::DOUBLE)::INT AS carbs, floor(target * 0.3::DOUBLE / 9 + 0.5::DOUBLE)::INT AS fat FROM targets
)"""
_PROFILES = "profiles AS (SELECT c_custkey AS user_id, k AS profile_key FROM customer, " + _values(list(enumerate(PROFILE_KEYS)), "j, k") + " WHERE (c_custkey + j * 5) % 7 = 0)"


def _alerts(mode: str) -> str:
    terms = _values(seed_rows()["allergen_terms"], "profile_key, seq, phrase")
    match = f"contains({_padded('i.norm')}, {_padded(_norm('a.phrase'))})" if mode == "token" else "contains(i.norm, lower(a.phrase))"
    return f"""alerted AS (
  SELECT product_id, profile_key, string_agg(raw, '|' ORDER BY pos) FILTER (WHERE n <= 4) AS hits FROM (
    SELECT *, row_number() OVER (PARTITION BY product_id, profile_key ORDER BY pos) AS n FROM (
      SELECT DISTINCT i.id AS product_id, i.pos, i.raw, a.profile_key FROM ingredients i JOIN {terms} a ON {match})) GROUP BY ALL
), alerts AS (SELECT user_id, product_id, profile_key, hits FROM profiles JOIN alerted USING (profile_key))"""


_PARSED = f"{_products()}, {_parse('products', 'product_id', 'ingredients_text', 'family')}"
_KNOWN = f"WITH {_PARSED}, {_lexicon()}, {_CLASSIFIED}"
_FULL = f"{_KNOWN}, {_NUTRITION}, {_SCORED}"
_SOURCES = """sources AS (
  SELECT *, ([0, 1, 2, 3])[s + 1] AS source_rank, (['food', 'beauty', 'household', 'petfood'])[s + 1] AS source FROM (
    SELECT product_id, barcode, name, brand, product_id % 4 AS s FROM products
    UNION ALL SELECT product_id, barcode, name || ' (2)', brand, (product_id + 1) % 4 FROM products WHERE product_id % 9 = 0)
)"""


def _title(x: str) -> str:
    """Upper case after each boundary; seed names hold ASCII only."""
    return f"(SELECT string_agg(CASE WHEN i = 1 OR NOT regexp_matches(substr({x}, i - 1, 1), '\\w') THEN upper(substr({x}, i, 1)) ELSE substr({x}, i, 1) END, '' ORDER BY i) FROM range(1, length({x}) + 1) r(i))"


def _set(left: str, right: str, kind: str, both: bool) -> str:
    sev, pos = ("bad", "NOT s.positive") if kind == "bad" else ("good", "s.positive")
    exists = f"EXISTS (SELECT 1 FROM sides o WHERE o.product_id = {right} AND o.label = s.label AND o.sev = '{sev}' AND {pos.replace('s.', 'o.')})"
    return f"coalesce((SELECT string_agg(s.label, '|' ORDER BY s.ord) FROM sides s WHERE s.product_id = {left} AND s.sev = '{sev}' AND {pos} AND {'' if both else 'NOT '}{exists}), '')"


_PAIRS = "pairs AS (SELECT a.product_id AS a_id, b.product_id AS b_id FROM products a JOIN products b ON b.product_id = a.product_id + 1)"
_POOLED = """need AS (SELECT product_id, category, score AS own, coalesce(nullif(barcode, ''), name) AS own_key FROM analysis WHERE category <> '' AND score < 75
), candidates AS (
  SELECT * FROM (SELECT category, product_id AS other_id, score AS other_score, coalesce(nullif(barcode, ''), name) AS k,
    row_number() OVER (PARTITION BY category, coalesce(nullif(barcode, ''), name) ORDER BY product_id) AS n FROM analysis WHERE category <> '' AND n_ingredients > 0 AND name <> '') WHERE n = 1
)"""
_EATEN = """eaten AS (
  SELECT s.user_id, s.ts::DATE AS day, coalesce(floor(a.kcal * s.portion + 0.5), 0)::BIGINT AS kcal, coalesce(floor(a.protein * s.portion + 0.5), 0)::BIGINT AS protein,
    coalesce(floor(a.carbs * s.portion + 0.5), 0)::BIGINT AS carbs, coalesce(floor(a.fat * s.portion + 0.5), 0)::BIGINT AS fat
  FROM {rows} s JOIN analysis a USING (product_id) WHERE s.logged = 'eaten'
)"""


def _today(rows: str) -> str:
    pct = lambda a, b: f"least(100, floor(coalesce(sum(e.{a}), 0) * 100 / any_value(t.{b})::DOUBLE + 0.5))::INT"
    total = lambda c: f"coalesce(sum(e.{c}), 0)::BIGINT"
    return f"""{_FULL}, {_SCANS}, {_HEALTH}, {_EATEN.format(rows=rows)}
SELECT t.user_id, count(e.user_id) AS n_items, {total('kcal')} AS kcal, {total('protein')} AS protein, {total('carbs')} AS carbs, {total('fat')} AS fat, any_value(t.target) AS target,
  {pct('kcal', 'target')} AS pct, (any_value(t.target) - {total('kcal')})::BIGINT AS remaining, {pct('protein', 'protein')} AS protein_pct, {pct('carbs', 'carbs')} AS carbs_pct, {pct('fat', 'fat')} AS fat_pct
FROM split t LEFT JOIN eaten e ON e.user_id = t.user_id AND e.day = TIMESTAMP '{AS_OF}'::DATE GROUP BY t.user_id"""


def _insights(where: str, named: str = "", top: str = "") -> str:
    """With ``top``, each user's ranked names after the CTE ``named``, those of rank 6 and less."""
    order = lambda s: f"arg_min(product_id, row({s}, -epoch_us(ts), scan_id, product_id))"
    rows = f"""SELECT user_id, count(*) AS n, floor(avg(score) + 0.5)::INT AS avg_score, count(*) FILTER (WHERE badge_cls = 'exc') AS n_exc, count(*) FILTER (WHERE badge_cls = 'good') AS n_good,
  count(*) FILTER (WHERE badge_cls = 'mid') AS n_mid, count(*) FILTER (WHERE badge_cls = 'bad') AS n_bad, {order('-score')} AS best_id, {order('score')} AS worst_id
FROM latest JOIN analysis USING (product_id) {where} GROUP BY user_id"""
    if not top:
        return f"{_FULL}, {_SCANS}\n{rows}"
    tops = f"tops AS (SELECT user_id, string_agg(title || ' ' || n, '|' ORDER BY rank) AS top_flagged FROM ({top}) WHERE rank <= 6 GROUP BY user_id)"
    return f"{_FULL}, {_SCANS}, {named}, {tops} SELECT i.*, coalesce(top_flagged, '') AS top_flagged FROM ({rows}) i LEFT JOIN tops USING (user_id)"


def oracle_sql() -> dict[str, str]:
    groups = _values([(g, c, st, s) for g, c, st, s in seed_rows()["groups"]], "grp, category, status, summary")
    additives = _values([(r[2], r[1], r[3][0], r[5], r[6], r[7]) for r in seed_rows()["additives"]], "id, family, first, category, risk, summary")
    banned = _values(seed_rows()["banned"], "additive_id, note")
    rank = "CASE {0} WHEN 'avoid' THEN 4 WHEN 'caution' THEN 3 WHEN 'limit' THEN 2 WHEN 'unknown' THEN 1 ELSE 0 END"
    facts = [("Energy", "kcal100", "kcal", 0), ("Fat", "fat100", "g", 0), ("of which saturates", "sat", "g", 1), ("Carbohydrate", "carb", "g", 0), ("of which sugars", "sug", "g", 1), ("Fiber", "fib", "g", 0), ("Protein", "pro", "g", 0), ("Salt", "salt", "g", 0)]
    fact_rows = " UNION ALL ".join(f"SELECT product_id, {i} AS ord, '{n}' AS label, {_R1(c)} AS value_num, '{u}' AS unit, {bool(sub)} AS sub FROM products WHERE {c} IS NOT NULL" for i, (n, c, u, sub) in enumerate(facts))
    lower = "('Calories', 'Sugar', 'Salt', 'Saturated fat', 'Additives')"
    many = lambda s: f"CASE WHEN n_{s} > 1 THEN ' ingredients ' ELSE ' ingredient ' END"
    reasons = " UNION ALL ".join(
        [f"SELECT product_id, {i} AS o, 0 AS o2, (-{w} * n_{s})::INT AS d, n_{s} || {many(s)} || 'rated {s}' AS t FROM analysis WHERE n_{s} > 0" for i, (s, w) in enumerate((("avoid", 22), ("caution", 10), ("limit", 4)), 1)]
        + ["SELECT product_id, 4, 0, -8, 'Processing: NOVA 4' FROM analysis WHERE nova"]
        + [f"SELECT product_id, 5, 0, {w}, 'Nutri-Score {g.upper()}' FROM analysis WHERE grade = '{g}'" for g, w in (("e", -12), ("d", -7), ("a", 5))]
        + ["SELECT product_id, 6, ord, -4, lower(label) || ' above the limit' FROM nutrition WHERE sev = 'bad'", "SELECT product_id, 7, 0, 0, 'Held below 40 by an ingredient rated avoid' FROM analysis WHERE n_avoid > 0 AND points >= 40", "SELECT product_id, 0, 0, 100, 'Start' FROM analysis", "SELECT product_id, 8, 0, score, 'Result' FROM analysis"]
    )
    alternatives = """SELECT product_id{u}, rank, other_id, other_score, fit::INT AS fit FROM (
  SELECT *, row_number() OVER (PARTITION BY product_id{u} ORDER BY fit DESC, other_score DESC, other_id) AS rank FROM ({inner})) WHERE rank <= 4"""
    plain = "SELECT product_id, other_id, other_score, other_score AS fit FROM need JOIN candidates c ON c.category = need.category AND other_score >= own + 8 AND k <> own_key"
    # The label text is a correlated subquery; labels of order lines are the part formula on their own key.
    lines = f"WITH {_WORDS}, keys AS (SELECT DISTINCT l_orderkey * 10 + l_linenumber AS k FROM lineitem), items AS (SELECT k, i, i * 2 + 1 AS o FROM keys, range(0, 12) r(i) WHERE i < k % 13 UNION ALL SELECT k, 0, 0 FROM keys WHERE k % 13 = 3), joined AS (SELECT k, string_agg(CASE WHEN k % 7 = 0 AND o > 0 AND i = k % 13 - 1 THEN '(' || w || ')' ELSE w END, ', ' ORDER BY o) AS t FROM items JOIN words ON n = (k * 7 + i * 13 + i * i) % {len(pool())} GROUP BY k), labels AS (SELECT k AS product_id, 'food' AS family, 'Ingredients: ' || coalesce(t, '') || CASE WHEN k % 5 = 0 THEN '. Calories 120. Total Fat 2g. Distributed by ACME. www.acme.com' ELSE '' END || CASE WHEN k % 11 = 0 THEN '. Contains: Milk, Soy' ELSE '' END AS ingredients_text FROM keys LEFT JOIN joined USING (k)), {_parse('labels', 'product_id', 'ingredients_text', 'family')}, {_lexicon()}, {_CLASSIFIED}"
    visible = "length(regexp_replace(translate(coalesce(text, ''), chr(160) || chr(65279), '  '), '\\s+', '', 'g'))"
    swapped = _products(f"CASE WHEN p_partkey % 2 = 0 THEN {_label('(p_partkey + 1)')} ELSE {_label('p_partkey')} END", "CASE WHEN p_partkey % 5 = 0 THEN 'beauty' WHEN p_partkey % 10 <= 6 THEN 'food' WHEN p_partkey % 10 = 7 THEN 'petfood' WHEN p_partkey % 10 = 8 THEN 'beauty' ELSE 'household' END")
    overridden = f"{swapped}, {_parse('products', 'product_id', 'ingredients_text', 'family')}, {_lexicon()}, {_CLASSIFIED}, {_NUTRITION}, {_SCORED}"
    seed = seed_rows()
    told = _values([("a", r[2], r[5], r[7], r[8], r[9], r[10]) for r in seed["additives"]] + [("g", g, c, s, *next(x[1:] for x in seed["group_details"] if x[0] == g)) for g, c, _, s in seed["groups"]], "kind, key, category, summary, what_is, why_flagged, effects")
    studies = _values([(k[0], *rest) for k, *rest in seed["studies"]], "kind, key, seq, title, source, year")
    history = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, scan_id DESC)::INT AS rank FROM latest) WHERE rank <= 100)"
    eaten_sums = ", ".join(f"sum(coalesce(floor(a.{c} * s.portion + 0.5), 0))::BIGINT AS {c}" for c in ("kcal", "protein", "carbs", "fat"))
    liked = "(SELECT user_id, product_id FROM scans WHERE event_type = 'click' GROUP BY user_id, product_id HAVING count(*) % 2 = 1)"
    named = f"named AS (SELECT product_id, pos, coalesce(a.first, c.name, c.raw) AS t FROM classified c LEFT JOIN {additives} a ON a.id = c.additive_id WHERE status IN ('avoid', 'caution')), spelt AS (SELECT t, {_title('t')} AS title FROM (SELECT DISTINCT t FROM named)), titled AS (SELECT product_id, title, min(pos) AS pos FROM named JOIN spelt USING (t) GROUP BY product_id, title)"
    ranked = "SELECT user_id, title, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, min(row(-epoch_us(ts), -scan_id, pos)), title)::INT AS rank FROM latest JOIN titled USING (product_id) GROUP BY user_id, title"
    sql = {
        "score_products": f"{_FULL} SELECT product_id, score, badge_label, badge_cls, flagged_count, n_ingredients::INT AS n_ingredients FROM analysis",
        "parse_part_labels": f"WITH {_PARSED} SELECT id AS product_id, pos::INT AS pos, raw, norm FROM ingredients",
        "parse_document_labels": f"WITH {_parse('documents', 'doc_id', 'text', kept='')} SELECT id AS label_id, pos::INT AS pos, raw, norm FROM ingredients",
        "classify_ingredients": f"{_KNOWN} SELECT product_id, pos::INT AS pos, norm, family, status, grp, name, enumber, additive_id FROM classified",
        "ingredient_snapshots": f"WITH {_SCANS} SELECT scan_id, product_id, snapshot_id, epoch_us(read) AS read_us, told FROM (SELECT s.scan_id, s.product_id, n.scan_id AS snapshot_id, n.ts AS read, n.portion AS told, row_number() OVER (PARTITION BY s.scan_id ORDER BY n.ts DESC, n.scan_id DESC) AS r FROM scans s JOIN scans n ON n.product_id = s.product_id AND n.event_type = 'purchase' AND n.ts <= s.ts AND n.ts >= s.ts - INTERVAL 90 DAY) WHERE r = 1",
        "additives_counted": f"{_FULL} SELECT a.product_id AS a_id, b.product_id AS b_id, CASE WHEN a.score > b.score THEN 'a' WHEN b.score > a.score THEN 'b' ELSE 'tie' END AS better, a.score - b.score AS score_delta, (SELECT count(*) FROM classified c WHERE c.product_id = a.product_id AND status IN ('avoid', 'caution'))::INT AS a_additives, (SELECT count(*) FROM classified c WHERE c.product_id = b.product_id AND status IN ('avoid', 'caution'))::INT AS b_additives FROM analysis a JOIN analysis b ON b.product_id = a.product_id + 1",
        "merged_lexicon": f"WITH {_PARSED}, {_lexicon(_merged_rows())}, {_CLASSIFIED} SELECT product_id, pos::INT AS pos, norm, family, status, grp, name, enumber, additive_id FROM classified",
        "classify_order_lines": f"{lines} SELECT status, grp, count(*) AS n, sum(product_id)::BIGINT AS id_sum, sum(pos)::BIGINT AS pos_sum FROM classified GROUP BY status, grp",
        "eval_nutrition": f"WITH {_products()}, {_NUTRITION} SELECT product_id, CASE WHEN sev = 'good' THEN 'positive' ELSE 'negative' END AS side, ord, label, value_num, unit, sev, {_NOTE} AS note FROM nutrition",
        "explain_scores": f"{_FULL}, reasons AS ({reasons}) SELECT product_id, (row_number() OVER (PARTITION BY product_id ORDER BY o, o2) - 1)::INT AS ord, d, t FROM reasons",
        "build_analysis": f"{_FULL} SELECT product_id, coalesce(nullif(barcode, ''), product_id::VARCHAR) AS id, score, kcal, protein, carbs, fat, family = 'food' AS is_food, CASE product_type WHEN 'food' THEN 'Food' WHEN 'petfood' THEN 'Pet food' WHEN 'beauty' THEN 'Cosmetics' ELSE 'Household and others' END AS type_label, CASE badge_cls WHEN 'exc' THEN 'Nothing of note against it.' WHEN 'good' THEN 'Little to hold against it.' WHEN 'mid' THEN 'Some points to keep an eye on.' ELSE 'Better left alone or kept rare.' END AS verdict FROM analysis",
        "overridden_labels": f"WITH {overridden} SELECT product_id, product_type, score, badge_cls, n_ingredients::INT AS n_ingredients FROM analysis",
        "shown_negatives": f"{_FULL} SELECT product_id, 'ingredient' AS kind, (row_number() OVER (PARTITION BY product_id ORDER BY {rank.format('status')} DESC, pos) - 1)::INT AS ord, raw AS label, CASE WHEN status = 'limit' THEN 'mid' ELSE 'bad' END AS sev FROM classified WHERE status IN ('avoid', 'caution', 'limit') UNION ALL SELECT product_id, 'nutrition', ord, label, sev FROM nutrition WHERE sev <> 'good'",
        "status_breakdown": f"{_KNOWN} SELECT product_id, status, count(*) AS n, {rank.format('status')} AS rank FROM classified WHERE status <> 'ok' GROUP BY product_id, status",
        "concern_rows": f"{_KNOWN} SELECT product_id, (row_number() OVER (PARTITION BY product_id ORDER BY {rank.format('status')} DESC, pos) - 1)::INT AS ord, pos::INT AS pos, raw, status, CASE WHEN status = 'limit' THEN 'mid' ELSE 'bad' END AS sev FROM classified WHERE status IN ('avoid', 'caution', 'limit')",
        "nutrition_facts": f"WITH {_products()} {fact_rows}",
        "ingredient_detail": f"{_KNOWN}, keyed AS (SELECT *, CASE WHEN additive_id IS NOT NULL THEN 'a' ELSE 'g' END AS kind, CASE WHEN additive_id IS NOT NULL THEN additive_id WHEN grp IN (SELECT grp FROM {groups}) THEN grp ELSE 'unknown' END AS key FROM classified), shown AS (SELECT c.*, coalesce(a.first, c.name, c.raw) AS t, b.note, d.category, d.summary, d.what_is, d.why_flagged, d.effects FROM keyed c LEFT JOIN {additives} a ON a.id = c.additive_id LEFT JOIN {told} d ON d.kind = c.kind AND d.key = c.key LEFT JOIN {banned} b ON b.additive_id = c.additive_id) SELECT product_id, pos::INT AS pos, {_title('t')} AS title, category, coalesce(enumber, '') AS enumber, status, summary, what_is, why_flagged, effects, coalesce(note, '') AS banned, coalesce((SELECT string_agg(title || '|' || source || '|' || year, ';' ORDER BY seq) FROM {studies} x WHERE x.kind = shown.kind AND x.key = shown.key), '') AS studies FROM shown",
        "lexicon_browse": f"{_KNOWN} SELECT a.family, a.id AS additive_id, a.first AS name, a.category, a.risk, {rank.format('a.risk')} AS rank, (SELECT count(DISTINCT product_id) FROM classified c WHERE c.additive_id = a.id) AS n_products FROM {additives} a WHERE contains(lower(a.category), 'colour')",
        "unknown_terms": f"{_KNOWN} SELECT norm, count(*) AS n_rows, count(DISTINCT product_id) AS n_products FROM classified WHERE status = 'unknown' AND length(raw) >= 3 AND lower(raw) NOT IN ('and', 'or', 'contains', 'less than', 'of', 'the', 'other', 'color added', 'natural', 'artificial') GROUP BY norm",
        "personal_alerts": f"WITH {_PARSED}, {_PROFILES}, {_alerts('token')}, {_SCANS} SELECT * FROM alerts WHERE (user_id, product_id) IN (SELECT (user_id, product_id) FROM scans)",
        "personal_alerts_substring": f"WITH {_PARSED}, {_PROFILES}, {_alerts('substring')}, {_SCANS} SELECT * FROM alerts WHERE (user_id, product_id) IN (SELECT (user_id, product_id) FROM scans)",
        "compare_products": f"{_FULL}, {_PAIRS} SELECT a_id, b_id, CASE WHEN a.score > b.score THEN 'a' WHEN b.score > a.score THEN 'b' ELSE 'tie' END AS better, CASE WHEN a.score > b.score THEN 'The first scores ' || (a.score - b.score) || ' more' WHEN b.score > a.score THEN 'The second scores ' || (b.score - a.score) || ' more' ELSE 'Equal scores' END AS verdict, a.score - b.score AS score_delta, a.flagged_count AS a_additives, b.flagged_count AS b_additives, "
        + ", ".join(f"{_set('a_id', 'b_id', k, False)} AS {k}_a_only, {_set('b_id', 'a_id', k, False)} AS {k}_b_only, {_set('a_id', 'b_id', k, True)} AS {k}_shared" for k in ("bad", "good"))
        + " FROM pairs JOIN analysis a ON a.product_id = a_id JOIN analysis b ON b.product_id = b_id",
        "compare_nutrition": f"{_FULL}, {_PAIRS} SELECT a_id, b_id, x.label, x.value_num AS a, y.value_num AS b, {_R1('(x.value_num - y.value_num)')} AS delta, CASE WHEN x.value_num = y.value_num THEN 'tie' WHEN (x.label IN {lower}) = (x.value_num < y.value_num) THEN 'a' ELSE 'b' END AS better FROM pairs JOIN sides x ON x.product_id = a_id JOIN sides y ON y.product_id = b_id AND y.label = x.label WHERE x.value_num IS NOT NULL AND y.value_num IS NOT NULL",
        "compare_candidates": f"{_FULL}, {_POOLED}, {_SCANS}, saved AS {history}, liked AS {liked}, better AS ({alternatives.format(u='', inner=plain)}), screen AS (SELECT user_id, product_id, barcode FROM saved JOIN products USING (product_id) WHERE rank = 1), every AS (SELECT s.*, k.product_id AS other_id, 0 AS source FROM screen s JOIN saved k USING (user_id) UNION ALL SELECT s.*, k.product_id, 1 FROM screen s JOIN liked k USING (user_id) UNION ALL SELECT s.*, k.other_id, 2 FROM screen s JOIN better k USING (product_id)), listed AS (SELECT e.*, o.barcode AS other_barcode FROM every e JOIN products o ON o.product_id = e.other_id WHERE e.product_id <> other_id AND (e.barcode = '' OR e.barcode <> o.barcode)) SELECT user_id, product_id, other_id, source FROM (SELECT *, row_number() OVER (PARTITION BY user_id, product_id, coalesce(nullif(other_barcode, ''), other_id::VARCHAR) ORDER BY source, other_id) AS n FROM listed) WHERE n = 1",
        "find_alternatives": f"{_FULL}, {_POOLED} " + alternatives.format(u="", inner=plain),
        "find_alternatives_for_users": f"{_FULL}, {_POOLED}, {_SCANS}, {_PROFILES}, {_alerts('token')}, costs AS (SELECT user_id, product_id AS other_id, count(*) AS n_alerts FROM alerts GROUP BY ALL), eaters AS (SELECT DISTINCT user_id, product_id FROM scans WHERE logged = 'eaten') "
        + alternatives.format(u=", user_id", inner="SELECT product_id, user_id, other_id, other_score, other_score - 12 * coalesce(n_alerts, 0) AS fit FROM need JOIN eaters USING (product_id) JOIN candidates c ON c.category = need.category AND other_score >= own + 8 AND k <> own_key LEFT JOIN costs USING (user_id, other_id)"),
        "category_scan": f"WITH {_products()} SELECT barcode, name, category FROM products WHERE category = 'economy' AND product_id % 3 = 0 AND product_id % 8 <> 0 AND name NOT IN ('', 'Unknown product')",
        "health_sort": f"WITH {_products()} SELECT product_id, nutriscore_grade, CASE WHEN nutriscore_grade IS NULL THEN 9 ELSE instr('abcde', nutriscore_grade) END::INT AS grade_rank FROM products",
        "load_products": f"WITH {_products()} SELECT barcode, CASE WHEN product_id % 8 = 0 THEN 'Unknown product' ELSE name END AS name, brand, CASE WHEN product_id % 2 = 0 THEN 'small/' ELSE 'large/' END || product_id AS image, CASE WHEN product_id % 3 < 2 THEN category ELSE '' END AS category, length(ingredients_text)::INT AS n_text, product_id % 5 = 0 AS kosher, nova_group, CASE product_id % 3 WHEN 0 THEN 'en:snacks|en:' || category || '|fr:divers' WHEN 1 THEN 'fr:' || category ELSE '' END AS categories_tags, CASE WHEN product_id % 2 = 0 THEN 'en:e330|en:e129' ELSE '' END AS additives_tags FROM products",
        "union_sources": f"WITH {_products()}, {_SOURCES} SELECT source, source_rank, count(*) AS n, sum(product_id)::BIGINT AS id_sum FROM sources GROUP BY source, source_rank",
        "resolve_barcodes": f"WITH {_products()}, {_SOURCES} SELECT barcode, name, source FROM (SELECT *, row_number() OVER (PARTITION BY barcode ORDER BY source_rank, product_id) AS n FROM sources WHERE barcode <> '') WHERE n = 1",
        "search_products": f"WITH {_products()}, {_SOURCES} SELECT barcode, name, brand, source FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(nullif(barcode, ''), name || '|' || brand) ORDER BY source_rank, product_id) AS n FROM sources WHERE contains(lower(name), 'ring') OR contains(lower(brand), 'ring')) WHERE n = 1",
        "fresh_snapshots": f"WITH {_SCANS} SELECT product_id, scan_id, portion FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY ts DESC, scan_id DESC) AS n FROM scans WHERE ts >= TIMESTAMP '2024-02-20 12:00:00' - INTERVAL 30 DAY) WHERE n = 1",
        "normalize_barcodes": f"WITH {_products()}, codes AS (SELECT product_id, CASE WHEN product_id % 4 = 0 THEN substr(barcode, 9, 5) ELSE ' ' || barcode || '-x' END AS code FROM products) SELECT product_id, code, regexp_replace(code, '[^0-9]', '', 'g') AS barcode FROM codes WHERE length(regexp_replace(code, '[^0-9]', '', 'g')) >= 8",
        "label_intake_gate": f"SELECT CASE WHEN {visible} < 6 THEN 'reject' WHEN doc_id % 100 < 60 OR {visible} < 12 THEN 'review' ELSE 'accept' END AS gate, count(*) AS n, sum(doc_id)::BIGINT AS id_sum FROM documents GROUP BY gate",
        "daily_targets": f"WITH {_HEALTH} SELECT * FROM split",
        "upsert_scans": f"WITH {_SCANS} SELECT user_id, product_id, scan_id, logged, portion FROM latest",
        "newest_scans": f"WITH {_SCANS} SELECT user_id, product_id, scan_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, scan_id DESC)::INT AS rank FROM latest) WHERE rank <= 5",
        "set_logged": f"WITH {_SCANS} SELECT user_id, product_id, logged, CASE WHEN logged = 'eaten' THEN epoch_us(ts) END AS ate_at_us FROM latest",
        "toggle_favorites": f"WITH {_SCANS} SELECT user_id, product_id, epoch_us(max(ts)) AS since_us FROM scans WHERE event_type = 'click' GROUP BY user_id, product_id HAVING count(*) % 2 = 1",
        "scan_insights": _insights("", named, ranked),
        "scan_insights_eaten": _insights("WHERE logged = 'eaten'"),
        "top_flagged": f"{_KNOWN}, {_SCANS}, {named} SELECT user_id, title, n, rank FROM ({ranked}) WHERE rank <= 6",
        "today_intake": _today("latest"),
        "today_intake_events": _today("scans"),
        "weekly_trend": f"{_FULL}, {_SCANS}, {_HEALTH}, {_EATEN.format(rows='latest')}, span AS (SELECT (TIMESTAMP '{AS_OF}'::DATE - i::INT)::DATE AS day FROM range(0, 7) r(i)), days AS (SELECT user_id, day, sum(kcal)::BIGINT AS kcal FROM eaten WHERE day IN (SELECT day FROM span) GROUP BY ALL), ate AS (SELECT u.user_id, coalesce(max(d.kcal), 0) AS top, coalesce(any_value(target), 0) AS target FROM (SELECT DISTINCT user_id FROM eaten) u LEFT JOIN days d USING (user_id) LEFT JOIN targets USING (user_id) GROUP BY u.user_id) "
        "SELECT a.user_id, s.day, coalesce(d.kcal, 0)::BIGINT AS kcal, a.target > 0 AND coalesce(d.kcal, 0) > a.target AS over, floor(coalesce(d.kcal, 0) * 100 / greatest(a.target, a.top, 1)::DOUBLE + 0.5)::INT AS bar, floor(a.target * 100 / greatest(a.target, a.top, 1)::DOUBLE + 0.5)::INT AS goal_line FROM ate a CROSS JOIN span s LEFT JOIN days d ON d.user_id = a.user_id AND d.day = s.day",
        "backup_round_trip": f"WITH {_SCANS}, kept AS (SELECT user_id, scan_id, product_id, epoch_us(ts) AS ts_us, logged, CASE WHEN logged = 'eaten' THEN epoch_us(ts) END AS ate_at_us, portion FROM {history}) SELECT * FROM kept UNION ALL SELECT * REPLACE (-1 - user_id AS user_id, 0.0::DOUBLE AS portion) FROM kept",
        "backup_sections": f"WITH {_SCANS}, {_HEALTH}, {_PROFILES}, flags AS (SELECT user_id, string_agg(profile_key, '|' ORDER BY profile_key) AS flags FROM profiles GROUP BY user_id), liked AS (SELECT user_id, count(*) AS n_favorites, sum(product_id)::BIGINT AS favorites_sum FROM {liked} GROUP BY user_id) SELECT user_id, sex, age, cm, kg, CASE goal WHEN -500 THEN 'lose' WHEN 0 THEN 'maintain' ELSE 'gain' END AS goal, CASE sex WHEN 'male' THEN 'dark' ELSE 'light' END AS theme, flags, n_favorites, favorites_sum FROM health LEFT JOIN flags USING (user_id) LEFT JOIN liked USING (user_id)",
        "saved_history": f"WITH {_SCANS} SELECT user_id, product_id, scan_id, logged, portion, rank FROM {history}",
        "step_portion": f"WITH {_SCANS} SELECT scan_id, least(10.0, greatest(0.25, floor((portion + CASE WHEN event_type = 'purchase' THEN 0.25 ELSE -0.25 END) * 4 + 0.5) / 4))::DOUBLE AS portion FROM scans",
        "body_from_imperial": "SELECT c_custkey AS user_id, floor(((4 + c_custkey % 3) * 12 + c_custkey % 12) * 2.54::DOUBLE + 0.5::DOUBLE) AS cm, floor((90 + c_custkey % 200) * 0.45359::DOUBLE * 10 + 0.5::DOUBLE) / 10 AS kg FROM customer",
        "stream_scores": f"{_FULL} SELECT product_id, score, badge_cls, flagged_count FROM analysis",
        "stream_daily_intake": f"{_FULL}, {_SCANS} SELECT s.user_id, s.ts::DATE AS day, {eaten_sums}, count(*) AS n FROM scans s JOIN analysis a USING (product_id) WHERE s.logged = 'eaten' AND s.ts::DATE + INTERVAL 1 DAY <= (SELECT max(ts) FROM scans WHERE logged = 'eaten') - INTERVAL 1 DAY GROUP BY s.user_id, s.ts::DATE",
        "stream_latest_scan": f"WITH {_SCANS} SELECT user_id, product_id, scan_id, logged FROM latest",
    }
    sql["search_indexed"] = sql["search_products"]
    return sql
