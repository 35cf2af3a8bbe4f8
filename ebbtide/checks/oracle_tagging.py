"""Oracle SQL (DuckDB dialect, RE2 regexes) for question tagging."""

from ebbtide.operators import tagging as TG

SQL = {}

MSGS = "msgs AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user')"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def has(low: str, w: str) -> str:
    return f"coalesce(contains({low}, {q(w)}), false)"


def any_(low: str, words) -> str:
    return "(" + " OR ".join(has(low, w) for w in words) + ")"


def first_word(low: str, words) -> str:
    return "CASE " + " ".join(f"WHEN {has(low, w)} THEN {q(w.title())}" for w in words) + " ELSE NULL END"


def rx(s: str, pat: str) -> str:
    return f"coalesce(regexp_matches({s}, {q(pat)}), false)"


def extract_num(s: str, pat: str) -> str:
    return (f"CASE WHEN {rx(s, pat)} THEN TRY_CAST(replace(regexp_extract({s}, {q(pat)}, 1), ',', '') AS DOUBLE) END")


LOW = "lower(text)"


def keyword_intent() -> str:
    return "CASE " + " ".join(f"WHEN {any_(LOW, kws)} THEN {q(n)}" for n, kws in TG.KEYWORD_INTENTS) + \
        f" ELSE {q(TG.UNKNOWN_INTENT)} END"


def budget() -> str:
    v = extract_num(LOW, TG.BUDGET_RE)
    sfx = f"regexp_extract({LOW}, {q(TG.BUDGET_RE)}, 2)"
    return f"CASE WHEN {sfx} = 'k' THEN {v} * 1000.0 WHEN {sfx} = 'm' THEN {v} * 1000000.0 ELSE {v} END"


def regex_intent() -> str:
    present = {"region": f"({first_word(LOW, TG.PARAM_REGIONS)}) IS NOT NULL",
               "segment": f"({first_word(LOW, TG.PARAM_SEGMENTS)}) IS NOT NULL"}
    parts = []
    for name, needs, pat in TG.REGEX_INTENTS:
        cond = rx(LOW, pat)
        if needs:
            cond = f"({present[needs]} AND {cond})"
        parts.append(f"WHEN {cond} THEN {q(name)}")
    return "CASE " + " ".join(parts) + f" ELSE {q(TG.DEFAULT_REGEX_INTENT)} END"


def agent_route() -> str:
    intent = f"({regex_intent()})"
    parts = [f"WHEN {intent} = {q(it)} THEN {q(a)}" for it, a in TG.INTENT_AGENT]
    parts.append(f"WHEN {intent} = 'specific_segment' AND {any_(LOW, TG.SEGMENT_STRATEGY_WORDS)} "
                 "THEN 'RetentionStrategistAgent'")
    scores = ["(" + " + ".join(f"CAST({has(LOW, k)} AS INTEGER)" for k in kws) + ")" for _, kws in TG.ROUTES]
    best = f"greatest({', '.join(scores)})"
    parts.append(f"WHEN {best} <= 0 THEN {q(TG.DEFAULT_AGENT)}")
    parts += [f"WHEN {s} = {best} THEN {q(a)}" for (a, _), s in zip(TG.ROUTES, scores)]
    return "CASE " + " ".join(parts) + " END"


SQL["intent_keyword_tag"] = f"WITH {MSGS} SELECT conv_id, turn, {keyword_intent()} AS intent FROM msgs"
SQL["entity_tag"] = (f"WITH {MSGS} SELECT conv_id, turn, {first_word(LOW, TG.ENTITY_REGIONS)} AS region, "
                     f"{first_word(LOW, TG.ENTITY_SEGMENTS)} AS segment FROM msgs")
SQL["parameter_extract"] = f"""WITH {MSGS} SELECT conv_id, turn, {budget()} AS budget,
  {extract_num(LOW, TG.DISCOUNT_RE)} AS discount,
  CASE WHEN {rx(LOW, TG.TOP_N_RE)} THEN TRY_CAST(regexp_extract({LOW}, {q(TG.TOP_N_RE)}, 1) AS BIGINT) END AS top_n,
  {first_word(LOW, TG.PARAM_SEGMENTS)} AS segment, {first_word(LOW, TG.PARAM_REGIONS)} AS region FROM msgs"""
SQL["intent_regex_tag"] = f"WITH {MSGS} SELECT conv_id, turn, {regex_intent()} AS intent FROM msgs"
SQL["agent_route"] = f"WITH {MSGS} SELECT conv_id, turn, {agent_route()} AS agent FROM msgs"
SQL["intent_counts"] = (f"WITH {MSGS}, t AS (SELECT {regex_intent()} AS intent FROM msgs) "
                        "SELECT intent, count(*) AS messages FROM t GROUP BY intent")

_D = TG.WHATIF_DEFAULTS
_B0 = f"({budget()})"
_B1 = f"({extract_num('text', TG.WHATIF_BUDGET_RE)})"
_BUD = f"(CASE WHEN coalesce({_B0}, 0.0) <> 0 THEN {_B0} WHEN {_B1} IS NOT NULL THEN {_B1} ELSE {_D['budget']!r} END)"
WHATIF_SELECT = f"""SELECT conv_id, turn,
  CASE WHEN {rx('text', TG.WHATIF_K_SUFFIX_RE)} AND {_BUD} < 10000 THEN {_BUD} * 1000.0 ELSE {_BUD} END AS retention_budget,
  coalesce({extract_num(LOW, TG.DISCOUNT_RE)}, {_D['discount']!r}) AS offer_discount_pct,
  coalesce({extract_num('text', TG.WHATIF_THRESHOLD_RE)}, {_D['threshold']!r}) AS risk_threshold,
  coalesce({extract_num('text', TG.WHATIF_SUCCESS_RE)}, {_D['success_pct']!r}) / 100.0 AS expected_success_rate
FROM msgs"""
SQL["whatif_params_from_text"] = f"WITH {MSGS} " + WHATIF_SELECT
