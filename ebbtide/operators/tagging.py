"""Question tagging (N1-N7) as a batch job over a message table.

Each message is lower-cased once and tested with ordered ``when`` chains of
``contains`` / ``rlike`` expressions generated from the fixed keyword and
pattern lists below. Everything is a projection over the whole message text
(no Python UDF, no shuffle); only ``intent_counts`` aggregates.

Regex dialect: every pattern uses only classes, groups, alternation and
(lazy) quantifiers, which mean the same in Python ``re``, Java (Spark) and
RE2. ``\\s``/``\\d``/``\\b`` are ASCII classes in Java and RE2.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Keyword intents, in priority order (first match wins).
# ---------------------------------------------------------------------------
KEYWORD_INTENTS = [
    ("churn_rate", ["churn rate", "overall churn", "how many churn", "% churn", "churning"]),
    ("high_risk", ["high risk", "most likely to churn", "at risk customers", "top risk", "risky customers"]),
    ("revenue_risk", ["revenue at risk", "financial exposure", "revenue impact", "money at risk", "clv at risk"]),
    ("region_analysis", ["region", "state", "geographic", "north", "south", "east", "west", "city tier"]),
    ("segment_analysis", ["segment", "enterprise", "smb", "consumer", "mid-market", "customer type"]),
    ("kpi_summary", ["kpi", "summary", "overview", "dashboard", "metrics", "scorecard", "how are we doing"]),
    ("recommend", ["recommend", "retention", "strategy", "action plan", "what should", "next best", "nba"]),
    ("predict", ["predict", "prediction", "score", "probability", "model", "likelihood"]),
    ("data_profile", ["profile", "data quality", "missing values", "duplicates", "column", "data issues"]),
]
UNKNOWN_INTENT = "unknown"

# Entity word lists (first listed word found wins; "north"
# precedes "northeast", so compound regions resolve to the first word).
ENTITY_REGIONS = ["north", "south", "east", "west", "central", "northeast", "northwest", "southeast",
                  "southwest", "midwest"]
ENTITY_SEGMENTS = ["enterprise", "smb", "consumer", "mid-market", "premium", "standard", "basic"]

# Parameter-extraction word lists and patterns.
PARAM_SEGMENTS = ["premium", "standard", "enterprise", "basic", "platinum", "gold", "silver", "sme", "smb",
                  "corporate", "retail", "consumer"]
PARAM_REGIONS = ["mumbai", "delhi", "bangalore", "bengaluru", "chennai", "kolkata", "hyderabad", "pune",
                 "ahmedabad", "jaipur", "surat", "lucknow", "kanpur", "nagpur", "indore", "thane", "bhopal",
                 "visakhapatnam", "north", "south", "east", "west", "central"]
BUDGET_RE = r"\$([\d,]+(?:\.\d+)?)\s*([km]?)"
DISCOUNT_RE = r"(\d+(?:\.\d+)?)\s*%\s*(?:off|discount|offer)"
TOP_N_RE = r"top\s*(\d+)"

# Ordered regex intents. ``needs`` names an extracted
# parameter that must be present for the rule to apply.
REGEX_INTENTS = [
    ("upload_info", None,
     r"upload|my\s+file|this\s+file|this\s+data(?:set)?|the\s+file|what\s+did\s+i\s+upload|"
     r"what.?s\s+in\s+the\s+file|what\s+(?:data|file)\s+do\s+(?:i|we)\s+have"),
    ("specific_region", "region", r"what|how|tell|show|give|analyse|analyze|churn|rate|perform"),
    ("specific_segment", "segment", r"what|how|tell|show|give|analyse|analyze|strateg|retain|churn|rate"),
    ("churn_rate", None,
     r"churn\s*rate|how\s+(?:many|much).*churn|what\s+(?:is|was|.?s)\s+(?:the\s+)?churn|"
     r"overall\s+churn|total\s+churn|churn\s+percent"),
    ("revenue_risk", None,
     r"revenue\s+at\s+risk|revenue.*risk|risk.*revenue|money\s+at\s+risk|financial\s+(?:risk|exposure)|"
     r"how\s+much.*(?:risk|lose|loss)"),
    ("region_breakdown", None,
     r"which\s+region|region.*(?:highest|most|worst|best)|top\s+region|by\s+region|"
     r"region(?:al)?\s+(?:breakdown|analysis|churn)"),
    ("segment_breakdown", None,
     r"which\s+segment|segment.*(?:highest|most|worst|best)|top\s+segment|by\s+segment|"
     r"segment(?:al)?\s+(?:breakdown|analysis|churn)"),
    ("satisfaction", None, r"satisf|csat|nps|customer\s+(?:experience|cx)|happiness|sentiment"),
    ("top_customers", None,
     r"top\s*(?:\d+\s*)?(?:priority\s+)?customers?|priority\s+(?:customer|list|queue)|"
     r"who\s+(?:should|to)\s+(?:we\s+)?(?:contact|call|reach|target)|outreach\s+(?:list|priority)|"
     r"at.risk\s+customers?"),
    ("scenario", None,
     r"simulat|what.?if|budget|roi|return\s+on|scenario|forecast|spend|retention\s+campaign|"
     r"campaign\s+(?:cost|budget|roi)"),
    ("strategy", None,
     r"strateg|recommend|how\s+to\s+retain|retention\s+(?:strategy|plan|approach)|"
     r"best\s+(?:action|approach|way)\s+to\s+retain"),
    ("executive", None,
     r"summar|executive|overview|brief(?:ing)?|report|(?:tell|give)\s+me\s+(?:everything|all)|status\s+report"),
]
DEFAULT_REGEX_INTENT = "general_analysis"

# Agent routing keyword groups (ties go to the earlier group).
ROUTES = [
    ("UploadedDataAgent", ["uploaded", "my file", "this file", "this data", "this dataset", "the file",
                           "what is this", "analyze this", "analyse this", "what did i upload",
                           "what's in the file", "what data"]),
    ("ScenarioPlannerAgent", ["simulat", "what if", "what-if", "budget", "roi", "return on", "scenario",
                              "forecast", "spend", "retention campaign"]),
    ("ExecutiveBriefingAgent", ["summary", "leadership", "ceo", "board", "executive", "brief", "overview",
                                "status report", "tell me everything"]),
    ("RetentionStrategistAgent", ["retain", "offer", "priority customer", "priority list", "outreach",
                                  "who should", "next best", "top customer", "who to contact", "action plan",
                                  "strateg"]),
    ("DataAnalystAgent", ["kpi", "churn", "revenue", "segment", "region", "breakdown", "metric", "data",
                          "analys", "rate", "score", "satisf", "how many"]),
]
DEFAULT_AGENT = "DataAnalystAgent"
INTENT_AGENT = [("upload_info", "UploadedDataAgent"), ("scenario", "ScenarioPlannerAgent"),
                ("executive", "ExecutiveBriefingAgent"), ("top_customers", "RetentionStrategistAgent"),
                ("strategy", "RetentionStrategistAgent")]
SEGMENT_STRATEGY_WORDS = ["strateg", "retain", "offer", "recommend"]

# What-if parameters read from free text (with defaults).
WHATIF_BUDGET_RE = r"(?i)\$?([\d,]+(?:\.\d+)?)\s*(?:k|thousand)?.*?budget"
WHATIF_THRESHOLD_RE = r"(?i)risk\s*(?:threshold|score)?\s*[>=of]*\s*(0\.\d+)"
WHATIF_SUCCESS_RE = r"(?i)(\d+(?:\.\d+)?)\s*%\s*success"
WHATIF_K_SUFFIX_RE = r"(?i)[\d,]+k\b"
WHATIF_DEFAULTS = {"budget": 500_000.0, "discount": 10.0, "threshold": 0.6, "success_pct": 18.0}


# ---------------------------------------------------------------------------
def _lower(text: Column, low: Column | None) -> Column:
    """The lowered text: a column of an earlier projection where the caller has one
    (many keyword tests then share it), else computed here."""
    return F.lower(text) if low is None else low


def _lowered(msgs: DataFrame) -> DataFrame:
    """Messages with the lowered text as a column of its own projection."""
    return msgs.select("conv_id", "turn", "text", F.lower("text").alias("_low"))


def _has(low: Column, word: str) -> Column:
    return F.coalesce(F.contains(low, F.lit(word)), F.lit(False))


def _any(low: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | _has(low, w)
    return out


def _first_word(low: Column, words: list[str]) -> Column:
    """Title-cased first word of the list (list order) that occurs in the text."""
    e = None
    for w in words:
        e = F.when(_has(low, w), F.lit(w.title())) if e is None else e.when(_has(low, w), F.lit(w.title()))
    return e.otherwise(F.lit(None).cast("string"))


def _extract_num(text: Column, pattern: str, group: int = 1) -> Column:
    """Number captured by ``pattern`` (commas removed); null when there is no match."""
    raw = F.regexp_replace(F.regexp_extract(text, pattern, group), ",", "")
    return F.when(text.rlike(pattern), raw.try_cast("double"))


def keyword_intent(text: Column, low: Column | None = None) -> Column:
    low = _lower(text, low)
    e = None
    for name, kws in KEYWORD_INTENTS:
        e = F.when(_any(low, kws), F.lit(name)) if e is None else e.when(_any(low, kws), F.lit(name))
    return e.otherwise(F.lit(UNKNOWN_INTENT))


def entity_region(text: Column, low: Column | None = None) -> Column:
    return _first_word(_lower(text, low), ENTITY_REGIONS)


def entity_segment(text: Column, low: Column | None = None) -> Column:
    return _first_word(_lower(text, low), ENTITY_SEGMENTS)


def param_budget(text: Column, low: Column | None = None) -> Column:
    low = _lower(text, low)
    v = _extract_num(low, BUDGET_RE)
    sfx = F.regexp_extract(low, BUDGET_RE, 2)
    return (F.when(sfx == "k", v * F.lit(1_000.0)).when(sfx == "m", v * F.lit(1_000_000.0)).otherwise(v))


def param_discount(text: Column, low: Column | None = None) -> Column:
    return _extract_num(_lower(text, low), DISCOUNT_RE)


def param_top_n(text: Column, low: Column | None = None) -> Column:
    low = _lower(text, low)
    return F.when(low.rlike(TOP_N_RE), F.regexp_extract(low, TOP_N_RE, 1).try_cast("bigint"))


def param_segment(text: Column, low: Column | None = None) -> Column:
    return _first_word(_lower(text, low), PARAM_SEGMENTS)


def param_region(text: Column, low: Column | None = None) -> Column:
    return _first_word(_lower(text, low), PARAM_REGIONS)


def regex_intent(text: Column, low: Column | None = None) -> Column:
    """Ordered regex intents; the region / segment rules need that parameter."""
    low = _lower(text, low)
    present = {"region": param_region(text, low).isNotNull(), "segment": param_segment(text, low).isNotNull()}
    e = None
    for name, needs, pat in REGEX_INTENTS:
        cond = F.coalesce(low.rlike(pat), F.lit(False))
        if needs:
            cond = present[needs] & cond
        e = F.when(cond, F.lit(name)) if e is None else e.when(cond, F.lit(name))
    return e.otherwise(F.lit(DEFAULT_REGEX_INTENT))


def route_scores(text: Column, low: Column | None = None) -> list[Column]:
    """Keyword hits per agent group, in ``ROUTES`` order."""
    low = _lower(text, low)
    return [sum(_has(low, k).cast("int") for k in kws) for _, kws in ROUTES]


def agent_route(intent: Column, strategy_words: Column, scores: list[Column]) -> Column:
    """Intent-first routing, else the keyword group with the most hits.

    The inputs should be columns of an earlier projection (``route_agents``):
    each is referenced several times here, and Catalyst keeps a non-trivial
    expression that is used more than once in its own projection instead of
    copying it into every branch.
    """
    e = None
    for it, agent in INTENT_AGENT:
        e = F.when(intent == it, F.lit(agent)) if e is None else e.when(intent == it, F.lit(agent))
    e = e.when((intent == "specific_segment") & strategy_words, F.lit("RetentionStrategistAgent"))
    best = F.greatest(*scores)
    e = e.when(best <= 0, F.lit(DEFAULT_AGENT))
    for (agent, _), sc in zip(ROUTES, scores):
        e = e.when(sc == best, F.lit(agent))
    return e


def whatif_params(text: Column) -> list[Column]:
    """budget, discount, risk threshold and success rate read from the text
    (parameters of the campaign what-if), with the defaults filled in."""
    d = WHATIF_DEFAULTS
    b0 = param_budget(text)
    b1 = _extract_num(text, WHATIF_BUDGET_RE)
    # a zero or missing first reading falls through to the next one
    budget = F.when(F.coalesce(b0, F.lit(0.0)) != 0, b0).when(b1.isNotNull(), b1).otherwise(F.lit(d["budget"]))
    budget = F.when(text.rlike(WHATIF_K_SUFFIX_RE) & (budget < 10_000), budget * F.lit(1_000.0)).otherwise(budget)
    # the second reading of the discount uses the same pattern, so a zero stays zero
    discount = F.coalesce(param_discount(text), F.lit(d["discount"]))
    thr = F.coalesce(_extract_num(text, WHATIF_THRESHOLD_RE), F.lit(d["threshold"]))
    succ = F.coalesce(_extract_num(text, WHATIF_SUCCESS_RE), F.lit(d["success_pct"])) / F.lit(100.0)
    return [budget.alias("retention_budget"), discount.alias("offer_discount_pct"),
            thr.alias("risk_threshold"), succ.alias("expected_success_rate")]


# ---------------------------------------------------------------------------
# Table-level operators
# ---------------------------------------------------------------------------
def user_messages(conversations: DataFrame) -> DataFrame:
    return conversations.filter(F.col("role") == "user").select("conv_id", "turn", "text")


def tag_intents_keyword(msgs: DataFrame) -> DataFrame:
    t, low = F.col("text"), F.col("_low")
    return _lowered(msgs).select("conv_id", "turn", keyword_intent(t, low).alias("intent"))


def tag_entities(msgs: DataFrame) -> DataFrame:
    t, low = F.col("text"), F.col("_low")
    return _lowered(msgs).select("conv_id", "turn", entity_region(t, low).alias("region"),
                                 entity_segment(t, low).alias("segment"))


def extract_parameters(msgs: DataFrame) -> DataFrame:
    t, low = F.col("text"), F.col("_low")
    return _lowered(msgs).select("conv_id", "turn", param_budget(t, low).alias("budget"),
                                 param_discount(t, low).alias("discount"), param_top_n(t, low).alias("top_n"),
                                 param_segment(t, low).alias("segment"), param_region(t, low).alias("region"))


def tag_intents_regex(msgs: DataFrame) -> DataFrame:
    return _lowered(msgs).select("conv_id", "turn", regex_intent(F.col("text"), F.col("_low")).alias("intent"))


def route_agents(msgs: DataFrame) -> DataFrame:
    t, low = F.col("text"), F.col("_low")
    scores = route_scores(t, low)
    stage = _lowered(msgs).select("conv_id", "turn", regex_intent(t, low).alias("_intent"),
                                  _any(low, SEGMENT_STRATEGY_WORDS).alias("_strategy"),
                                  *[sc.alias(f"_s{i}") for i, sc in enumerate(scores)])
    return stage.select("conv_id", "turn", agent_route(
        F.col("_intent"), F.col("_strategy"), [F.col(f"_s{i}") for i in range(len(scores))]).alias("agent"))


def whatif_parameters(msgs: DataFrame) -> DataFrame:
    return msgs.select("conv_id", "turn", *whatif_params(F.col("text")))


def intent_counts(tagged: DataFrame, col: str = "intent") -> DataFrame:
    return tagged.groupBy(col).agg(F.count(F.lit(1)).alias("messages"))
