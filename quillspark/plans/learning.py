"""Diffs, the edit log, rules, drafts and evaluation: conversations are versions, events the log, benchmark passages the gold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import CITATION_MARKS, GENERIC_WORDS, STOPWORDS, edit_type
from ..operators import draft, evaluate, learn
from ..sources import tables
from ..sources.tables import table
from .sql import said, when

TYPES = ["citation_fix", "fact_correction", "addition", "risk_rating", "wording"]
TURN = "(conv_id, turn, text) AS (SELECT conv_id, turn, min(text) FROM conversations GROUP BY conv_id, turn)"


def _turns(spark: SparkSession, d: str) -> DataFrame:
    """One text a turn, whatever repeats."""
    return table(spark, d, "conversations").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))


def _versions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Even turns before, odd turns after: turn 2k and 2k + 1 are sentence k of a matter."""
    t = _turns(spark, d).select(F.col("conv_id").alias("matter_id"), F.concat(F.lit("s"), (F.col("conv_id") % 8 + 1).cast("string")).alias("section"), F.lit("summary").alias("field"), F.floor(F.col("turn") / 2).cast("long").alias("ordinal"), "turn", "text")
    return t.where("turn % 2 = 0").drop("turn"), t.where("turn % 2 = 1").drop("turn")


def diff_full_outer_events(spark: SparkSession, d: str) -> DataFrame:
    return learn.diff(*_versions(spark, d)).select("edit_id", "matter_id", "section", "field_path", "edit_type")


def edit_type_classification(spark: SparkSession, d: str) -> DataFrame:
    t = _turns(spark, d)
    after = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("after"))
    return t.join(after, ["conv_id", "turn"], "left").select("conv_id", "turn", edit_type(F.col("text"), F.col("after")).alias("edit_type"))


def edits_by_section_and_type(spark: SparkSession, d: str) -> DataFrame:
    return learn.diff(*_versions(spark, d)).groupBy("section", "edit_type").agg(F.count("*").alias("n"))


def edit_memory_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    events = learn.diff(*_versions(spark, d))
    queries = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.lit("s"), (F.col("item_id") % 8 + 1).cast("string")).alias("section"), "text")
    return learn.search(events, queries).select("query_id", "edit_id", "score", "rank")


def _log(spark: SparkSession, d: str) -> DataFrame:
    """events as an edit log: event_type is the section, value picks the type, and the texts hold a number of the event."""
    number = F.get_json_object("props", "$.k").cast("int")
    kind = F.element_at(F.array(*map(F.lit, TYPES)), (F.col("event_id") % 5 + 1).cast("int"))
    return table(spark, d, "events").select(
        F.concat(F.lit("e_"), F.col("event_id").cast("string")).alias("edit_id"), F.col("user_id").alias("matter_id"), F.col("event_type").alias("section"), F.lit("summary[0].text").alias("field_path"), kind.alias("edit_type"),
        F.lit("plain text").alias("before"), F.concat(F.lit("plain text with token"), (F.coalesce(number, F.lit(0)) % 7).cast("string"), F.lit(" and field"), (F.col("user_id") % 3).cast("string")).alias("after"), F.col("event_id").alias("seq"),
    )


def distill_last20_top_tokens(spark: SparkSession, d: str) -> DataFrame:
    return learn.top_added_tokens(learn.last_events(_log(spark, d)))


def rule_versioning(spark: SparkSession, d: str) -> DataFrame:
    log = _log(spark, d)
    previous = log.groupBy("section").agg((F.count("*") % 4).alias("version"))
    out = learn.distilled(log, previous)
    return out.select("section", "version", F.size("rules").alias("n_rules"), F.array_join(F.transform("rules", lambda r: F.concat(r["id"], F.lit(":"), F.array_join(r["triggers"], "+"))), ",").alias("triggers"), F.array_join(F.transform("rules", lambda r: r["text"]), " ").alias("texts"))


def rules_version_tag(spark: SparkSession, d: str) -> DataFrame:
    log = _log(spark, d)
    return learn.version_tag(learn.distilled(log, log.groupBy("section").agg((F.count("*") % 4).alias("version"))))


def upsert_latest_by_key(spark: SparkSession, d: str) -> DataFrame:
    log = _log(spark, d).select("matter_id", "section", "edit_id", "seq")
    old, new = log.where("seq % 2 = 0"), log.where("seq % 2 = 1")
    out = tables.upsert(old, new, ["matter_id", "section"], [F.desc("seq")])
    return tables.upsert(out, new, ["matter_id", "section"], [F.desc("seq")])


def filtered_log(spark: SparkSession, d: str) -> DataFrame:
    """The log of one section, in its order."""
    return _log(spark, d).where("section = 'click'").select("edit_id", "matter_id", "edit_type", "seq").orderBy("seq")


def json_props_coercion(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    listed = F.when(F.col("props").startswith("["), F.from_json("props", "array<string>")).otherwise(F.array(F.coalesce(k, F.lit(""))))
    return table(spark, d, "events").select("event_id", F.try_to_number(k, F.lit("999999")).cast("int").alias("k"), F.array_join(listed, ",").alias("as_list"))


def flat_keys_to_map(spark: SparkSession, d: str) -> DataFrame:
    """Flat s<N>_* keys as a map, other keys left out, and back."""
    flat = F.create_map(F.concat(F.lit("s"), (F.col("event_id") % 8 + 1).cast("string"), F.lit("_"), F.col("event_type")), F.col("value").cast("int").cast("string"), F.lit("matter"), F.col("user_id").cast("string"))
    kept = F.map_filter(flat, lambda k, v: k.rlike("^s[0-9]+_[A-Za-z0-9_]+$"))
    return table(spark, d, "events").select("event_id", F.explode(kept).alias("section", "value"))


def llm_hook_cache_antijoin(spark: SparkSession, d: str) -> DataFrame:
    """Prompts that repeat; every third is answered before, the rest by a stand-in that tells a prompt's number."""
    n = F.col("doc_id") % 97
    prompt = F.concat(F.lit("prompt "), n.cast("string"))
    asked = table(spark, d, "documents").select(n.alias("n"), tables.cache_key(prompt).alias("key")).distinct()
    cached = asked.where("n % 3 = 0").select("key", F.lit("cached").alias("answer"))
    return tables.with_cache(asked, cached, lambda misses: misses.select("key", F.concat(F.lit("answer of "), F.col("n").cast("string")).alias("answer")))


def _hits(spark: SparkSession, d: str) -> DataFrame:
    """Four hits of each benchmark item: documents by a rule on their id."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    items = table(spark, d, "benchmark").select("item_id")
    n = table(spark, d, "benchmark").agg(F.count("*").alias("n"))
    dealt = docs.join(n).withColumn("key", F.col("doc_id") % F.col("n"))
    return dealt.join(items, F.col("key") == F.col("item_id")).select("key", F.col("doc_id").alias("hit_id"), F.floor(F.col("doc_id") / F.col("n")).cast("int").alias("rank"), "text")


def groundable_filter(spark: SparkSession, d: str) -> DataFrame:
    edits = table(spark, d, "benchmark").select(F.col("item_id").alias("key"), F.concat(F.lit("e"), F.col("item_id").cast("string")).alias("edit_id"), F.col("text").alias("after"))
    return draft.groundable(edits, _hits(spark, d)).select("key", "edit_id", F.round("share", 6).alias("share"))


def best_evidence_argmax(spark: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("item_id") % 4 == 0, "zzzz none of it").otherwise(F.col("text"))
    sentences = table(spark, d, "benchmark").select(F.col("item_id").alias("key"), F.col("item_id").alias("sentence_id"), text.alias("text"))
    return draft.best_evidence(sentences, _hits(spark, d)).select("key", "hit_id", "overlap")


def citation_snippet_span(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("key"), F.array_sort(draft.content_tokens(F.col("text"))).alias("tokens"))
    cut = _hits(spark, d).join(items, "key").select("key", "hit_id", draft.snippet(F.col("text"), F.col("tokens")).alias("s"))
    return cut.where("s is not null").select("key", "hit_id", "s.start", "s.end", F.sha2("s.snippet", 256).alias("snippet_sha256"))


def token_levenshtein_norm(spark: SparkSession, d: str) -> DataFrame:
    t = _turns(spark, d)
    after = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("gold"))
    return t.join(after, ["conv_id", "turn"]).select("conv_id", "turn", F.round(evaluate.edit_distance(F.col("text"), F.col("gold")), 6).alias("distance"))


def recall_at_5(spark: SparkSession, d: str) -> DataFrame:
    hits = _hits(spark, d).select(F.col("key").alias("query_id"), (F.col("rank") + 1).alias("rank"), F.col("hit_id").alias("doc_id"), (F.col("hit_id") % 3).cast("int").alias("page"), "text")
    gold = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(F.array(*(F.when(F.col("item_id") % 7 != 0, F.col("item_id") * i) for i in (1, 2)))).alias("doc_id")).withColumn("page", (F.col("doc_id") % 3).cast("int"))
    return evaluate.recall_at_k(gold, hits).select("query_id", F.round("recall", 6).alias("recall"))


def faithfulness_lexical(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "benchmark").agg(F.count("*").alias("n"))
    claims = _turns(spark, d).join(n).select((F.col("conv_id") % F.col("n")).alias("key"), F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("claim_id"), "text")
    return evaluate.faithfulness(claims, _hits(spark, d))


def citation_accuracy_jaccard(spark: SparkSession, d: str) -> DataFrame:
    t = _turns(spark, d)
    snippets = t.groupBy("conv_id").agg(F.array_sort(F.collect_list("text")).alias("snippets"))
    return evaluate.citation_accuracy(t.join(snippets, "conv_id").select(F.col("conv_id").alias("key"), F.concat_ws(" ", "text", F.reverse("text")).alias("text"), "snippets"))


def answer_relevancy_lexical(spark: SparkSession, d: str) -> DataFrame:
    t = _turns(spark, d)
    after = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return t.join(after, ["conv_id", "turn"]).select("conv_id", "turn", F.round(evaluate.answer_relevancy(F.col("text"), F.col("answer")), 6).alias("relevancy"))


def rule_application_rate(spark: SparkSession, d: str) -> DataFrame:
    t = _turns(spark, d)
    rules = t.where("turn % 2 = 0").select(F.col("conv_id").alias("key"), F.concat(F.lit("r"), F.col("turn").cast("string")).alias("rule_id"), F.when(F.col("turn") % 6 == 0, "the of").otherwise(F.col("text")).alias("text"))
    drafts = t.where("turn % 2 = 1").groupBy(F.col("conv_id").alias("key")).agg(F.array_join(F.array_sort(F.collect_list("text")), " ").alias("text"))
    return evaluate.rule_application(rules, drafts)


def paired_eval_delta(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "labels")
    cases = x.select(F.when(F.col("doc_id") % 2 == 0, "pre").otherwise("post").alias("condition"), *(((F.col("doc_id") * (i + 3) % 11) / F.lit(10.0) + F.col("quality") * 0.0).alias(m) for i, m in enumerate(evaluate.METRICS)))
    return evaluate.paired(evaluate.aggregated(cases))


def section_dimension(spark: SparkSession, d: str) -> DataFrame:
    return draft.section_table(spark).select("ordinal", "field", "name", F.size("structured").alias("n_fields"))


def _facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts of a matter out of an order: what a matter has depends on its numbers."""
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    k = F.col("o_orderkey")
    none = F.array().cast("array<string>")
    has = lambda n, r, x: F.when(k % n == r, x)
    text = lambda *p: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in p))
    return o.select(
        k.alias("matter_id"),
        F.coalesce(has(2, 0, F.array("c_name")), none).alias("owners"),
        has(4, 0, F.lit("fee simple")).alias("estate"), has(3, 0, F.col("c_name")).alias("insured"), has(6, 0, F.lit("1996-01-05")).alias("effective_date"),
        F.lit("platted").alias("legal_type"), has(3, 1, text("Lot ", k, " of the plat")).alias("legal_text"), has(2, 1, text("P-", k)).alias("parcel"),
        F.when(k % 5 == 0, F.array(*(text("deed ", k + i) for i in range(4)))).otherwise(none).alias("links"),
        F.when(k % 3 == 0, F.array(text("mortgage in favor of bank ", k % 10))).otherwise(none).alias("liens"),
        F.when(k % 4 == 1, F.array(F.lit("utility"), F.lit("access"), F.lit("utility"))).otherwise(none).alias("easements"),
        F.when(k % 8 == 1, F.array(F.lit("deed_restriction"))).otherwise(none).alias("restrictions"),
        F.when(k % 4 == 2, F.array(F.lit("payment"), F.lit("survey"))).otherwise(none).alias("requirements"),
        F.when(k % 2 == 1, F.array(F.struct(F.lit("tax").alias("category"), F.lit(True).alias("is_standard")), F.struct(F.lit("lease").alias("category"), F.lit(False).alias("is_standard")))).otherwise(F.array().cast("array<struct<category:string,is_standard:boolean>>")).alias("exceptions"),
        (k % 3).cast("int").alias("taxes"), F.when(k % 7 == 0, F.array(F.lit("encroachment"))).otherwise(none).alias("surveys"),
    )


def fallback_section_text(spark: SparkSession, d: str) -> DataFrame:
    return draft.fallback_sentences(_facts(spark, d))


def section_gaps(spark: SparkSession, d: str) -> DataFrame:
    f = _facts(spark, d).select("matter_id", (F.size("owners") > 0).alias("vesting"), (F.size("liens") > 0).alias("open_liens"), F.lit(False).alias("released_liens"))
    return draft.gaps(f, ["vesting", "open_liens", "released_liens"])


def open_questions_cap(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "lineitem").select((F.col("l_suppkey") % 50).alias("matter_id"), F.col("l_linenumber").alias("section_ordinal"), F.col("l_orderkey").alias("ordinal"), F.concat(F.lit("gap "), F.col("l_partkey").cast("string")).alias("gap"))
    return draft.open_questions(found.groupBy("matter_id", "section_ordinal", "ordinal").agg(F.min("gap").alias("gap")))


def _rated(spark: SparkSession, d: str) -> DataFrame:
    flag = F.when(F.col("l_returnflag") == "R", F.when(F.col("l_linenumber") == 6, "red").otherwise("green")).when((F.col("l_returnflag") == "A") & (F.col("l_linenumber") > 4), "yellow").otherwise("green")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("matter_id"), F.col("l_linenumber").alias("section"), "l_partkey", flag.alias("flag"), (F.col("l_partkey") % 97 == 0).cast("int").alias("n_gaps"), (F.col("l_suppkey") % 41 == 0).cast("int").alias("n_open_liens"), (F.col("l_partkey") % 5 == 0).cast("int").alias("n_warnings"), (F.col("l_partkey") % 3 == 0).alias("has_risk_rule"))


def overall_risk_rollup(spark: SparkSession, d: str) -> DataFrame:
    return draft.overall_risk(_rated(spark, d))


def rule_flags(spark: SparkSession, d: str) -> DataFrame:
    return draft.flagged(_rated(spark, d)).groupBy("flag").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        diff_full_outer_events, edit_type_classification, edits_by_section_and_type, edit_memory_topk_filtered, distill_last20_top_tokens, rule_versioning, rules_version_tag, upsert_latest_by_key, filtered_log, json_props_coercion,
        flat_keys_to_map, llm_hook_cache_antijoin, groundable_filter, best_evidence_argmax, citation_snippet_span, token_levenshtein_norm, recall_at_5, faithfulness_lexical, citation_accuracy_jaccard, answer_relevancy_lexical,
        rule_application_rate, paired_eval_delta, section_dimension, fallback_section_text, section_gaps, open_questions_cap, overall_risk_rollup, rule_flags,
    )
}

_STOP = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"


def _content(x: str, stop: str = "") -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower(coalesce({x}, '')), '[\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) >= 4 AND NOT list_contains({stop or _STOP}, w)))"


_GENERIC = "[" + ", ".join(f"'{w}'" for w in GENERIC_WORDS) + "]"


def _diffs(x: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower(coalesce({x}, '')), '[\\p{{L}}\\p{{N}}]+'), lambda w: length(w) >= 3))"


_MARKED = " OR ".join(f"contains(lower(coalesce(b, '')), '{m}') <> contains(lower(coalesce(a, '')), '{m}')" for m in CITATION_MARKS)
_SIMILAR = "len({0}) > 0 AND len({1}) > 0 AND len(list_intersect({0}, {1})) / least(len({0}), len({1})) >= 0.5".format(_diffs("b"), _diffs("a"))
_EDIT = f"CASE WHEN coalesce(b, '') = '' AND coalesce(a, '') <> '' THEN 'addition' WHEN coalesce(a, '') = '' AND coalesce(b, '') <> '' THEN 'deletion' WHEN {_MARKED} THEN 'citation_fix' WHEN {_SIMILAR} THEN 'wording' ELSE 'fact_correction' END"
_DIFF = f"""
tt{TURN},
v AS (SELECT conv_id AS matter_id, 's' || (conv_id % 8 + 1) AS section, turn // 2 AS ordinal, turn % 2 AS side, text FROM tt),
both_sides AS (SELECT matter_id FROM v GROUP BY matter_id HAVING count(DISTINCT side) = 2),
joined AS (SELECT coalesce(x.matter_id, y.matter_id) AS matter_id, coalesce(x.section, y.section) AS section, coalesce(x.ordinal, y.ordinal) AS ordinal, coalesce(x.text, '') AS b, coalesce(y.text, '') AS a
  FROM (SELECT * FROM v WHERE side = 0) x FULL JOIN (SELECT * FROM v WHERE side = 1) y ON x.matter_id = y.matter_id AND x.ordinal = y.ordinal),
ev AS (SELECT matter_id, section, 'summary[' || ordinal || '].text' AS field_path, b, a, {_EDIT} AS edit_type FROM joined SEMI JOIN both_sides USING (matter_id) WHERE b <> a),
events_of AS (SELECT *, 'e_' || substr(md5(concat_ws('|', matter_id::VARCHAR, section, field_path, b, a)), 1, 12) AS edit_id FROM ev)
"""
_LOG = """
log AS (SELECT 'e_' || event_id AS edit_id, user_id AS matter_id, event_type AS section, ['citation_fix', 'fact_correction', 'addition', 'risk_rating', 'wording'][event_id % 5 + 1] AS edit_type,
  'plain text with token' || (coalesce((props->>'$.k')::INT, 0) % 7) || ' and field' || (user_id % 3) AS after, event_id AS seq FROM events),
recent AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY section ORDER BY seq DESC) <= 20),
words AS (SELECT section, unnest(list_distinct(list_filter(list_transform(regexp_extract_all(after, '[A-Za-z][A-Za-z0-9_-]+'), lambda w: lower(w)), lambda w: length(w) >= 4 AND NOT list_contains(['plain', 'text', 'with'], w)))) AS token FROM recent),
top3 AS (SELECT section, token, count(*) AS n, row_number() OVER (PARTITION BY section ORDER BY count(*) DESC, token)::INT AS rank FROM words GROUP BY section, token QUALIFY rank <= 3)
"""
_RULE_CASES = ", ".join(
    "CASE WHEN " + (f"{kind[0]} = 1" if kind else "words IS NOT NULL") + " THEN {'id': '" + id_ + "', 'triggers': '" + "+".join(triggers) + "', 'text': '" + text.replace("'", "''").replace("{words}", "' || words || '") + "'} END" for id_, kind, text, triggers, _ in learn.RULES
)
_RULES = f"""
cnt AS (SELECT section, max((edit_type = 'citation_fix')::INT) AS c, max((edit_type = 'fact_correction')::INT) AS f, max((edit_type = 'addition')::INT) AS a, max((edit_type = 'risk_rating')::INT) AS r FROM recent GROUP BY section),
ver AS (SELECT section, count(*) % 4 + 1 AS version FROM log GROUP BY section),
named AS (SELECT section, string_agg(token, ', ' ORDER BY rank) AS words FROM top3 GROUP BY section),
lists AS (SELECT section, version, list_filter([{_RULE_CASES}], lambda x: x IS NOT NULL) AS t FROM cnt JOIN ver USING (section) LEFT JOIN named USING (section))
"""
_HITS = "n AS (SELECT count(*) AS n FROM benchmark), hits AS (SELECT doc_id % n AS key, doc_id AS hit_id, (doc_id // n)::INT AS rank, text FROM documents, n WHERE doc_id % n IN (SELECT item_id FROM benchmark))"
_NEXT = f"tt{TURN}, nx AS (SELECT x.conv_id, x.turn, x.text, y.text AS after FROM tt x JOIN tt y ON x.conv_id = y.conv_id AND y.turn = x.turn + 1)"
_DOT = """tok AS (SELECT section, edit_id AS id, unnest(regexp_extract_all(lower(concat_ws(' ', section, edit_type, 'before:', b, 'after:', a)), '[a-z0-9]+')) AS token FROM events_of),
q AS (SELECT 's' || (item_id % 8 + 1) AS section, item_id AS id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM benchmark),
{0}
"""


def _vector(source: str, name: str) -> str:
    h = "('0x' || substr(md5({}), 1, 8))::BIGINT"
    return f"""{name}_s AS (SELECT section, id, {h.format("token")} % 384 AS bucket, sum(CASE WHEN {h.format("'sign:' || token")} % 2 = 0 THEN 1.0 ELSE -1.0 END * (1 + ln(f))) AS w FROM (SELECT section, id, token, count(*) AS f FROM {source} GROUP BY ALL) GROUP BY ALL HAVING abs(w) > 1e-12),
{name} AS (SELECT section, id, bucket, w / sqrt(sum(w * w) OVER (PARTITION BY section, id)) AS w FROM {name}_s)"""


def _sections_sql() -> str:
    r = rules

    estate, insured, effective = when("k % 4 = 0", said(r.S1_ESTATE, estate="'fee simple'")), when("k % 3 = 0", said(r.S1_INSURED, insured="c_name")), when("k % 6 = 0", said(r.S1_EFFECTIVE, effective="'1996-01-05'"))
    easements, restrictions = said(r.S5_EASEMENTS, n="'3'", kinds="'access, utility'"), said(r.S5_RESTRICTIONS, n="'1'", kinds="'deed restriction'")
    matters = f"concat_ws(' and ', {when('k % 3 > 0', said(r.S8_TAXES, n='k % 3'), 'NULL')}, {when('k % 7 = 0', said(r.S8_SURVEYS, n='1', kinds=chr(39) + 'encroachment' + chr(39)), 'NULL')})"
    rows = {
        "s1_vesting_and_estate": said(r.S1, owners=when("k % 2 = 0", "c_name", said(r.S1_NO_OWNER)), estate=estate, insured=insured, effective=effective),
        "s2_legal_description": when("k % 3 = 1", said(r.S2, kind="'platted'", text="'Lot ' || k || ' of the plat'", parcel=when("k % 2 = 1", said(r.S2_PARCEL, parcel="'P-' || k"))), said(r.S2_NONE)),
        "s3_chain_of_title": when("k % 5 = 0", said(r.S3, n="'4'", links="'deed ' || k || '; deed ' || (k + 1) || '; deed ' || (k + 2)"), said(r.S3_NONE)),
        "s4_open_encumbrances_and_liens": when("k % 3 = 0", said(r.S4, n="'1'", liens="'mortgage in favor of bank ' || (k % 10)"), said(r.S4_NONE)),
        "s5_easements_and_restrictions": when("k % 8 = 1", said(r.S5, burdens=f"{easements} || ' and ' || {restrictions}"), when("k % 4 = 1", said(r.S5, burdens=easements), said(r.S5_NONE))),
        "s6_requirements_schedule_b_i": when("k % 4 = 2", said(r.S6, n="'2'", kinds="'payment, survey'"), said(r.S6_NONE)),
        "s7_exceptions_schedule_b_ii": when("k % 2 = 1", said(r.S7, n="'2'", standard="'1'", specific="'1'"), said(r.S7_NONE)),
        "s8_taxes_and_survey_matters": when("k % 3 > 0 OR k % 7 = 0", said(r.S8, matters=matters), said(r.S8_NONE)),
    }
    return "WITH f AS (SELECT o_orderkey AS k, c_name FROM orders JOIN customer ON o_custkey = c_custkey) " + " UNION ALL ".join(f"SELECT k AS matter_id, '{name}' AS section, {text} AS text FROM f" for name, text in rows.items())


SQL = {
    "diff_full_outer_events": f"WITH {_DIFF} SELECT edit_id, matter_id, section, field_path, edit_type FROM events_of",
    "edit_type_classification": f"WITH tt{TURN}, nx AS (SELECT x.conv_id, x.turn, x.text AS b, y.text AS a FROM tt x LEFT JOIN tt y ON x.conv_id = y.conv_id AND y.turn = x.turn + 1) SELECT conv_id, turn, {_EDIT} AS edit_type FROM nx",
    "edits_by_section_and_type": f"WITH {_DIFF} SELECT section, edit_type, count(*) AS n FROM events_of GROUP BY ALL",
    "edit_memory_topk_filtered": f"""WITH {_DIFF}, {_DOT.format(_vector("tok", "dv") + "," + _vector("q", "dq"))},
s AS (SELECT dq.id AS query_id, dv.id AS edit_id, round(sum(dv.w * dq.w), 6) AS score FROM dv JOIN dq USING (section, bucket) GROUP BY ALL)
SELECT query_id, edit_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, edit_id)::INT AS rank FROM s QUALIFY rank <= 3""",
    "distill_last20_top_tokens": f"WITH {_LOG} SELECT section, token, n, rank FROM top3",
    "rule_versioning": f"WITH {_LOG}, {_RULES} SELECT section, version, len(t)::INT AS n_rules, array_to_string(list_transform(t, lambda x: x.id || ':' || x.triggers), ',') AS triggers, array_to_string(list_transform(t, lambda x: x.text), ' ') AS texts FROM lists",
    "rules_version_tag": f"WITH {_LOG}, {_RULES} SELECT 'rules-v' || max(version) AS tag FROM lists",
    "upsert_latest_by_key": f"WITH {_LOG} SELECT matter_id, section, edit_id, seq FROM log QUALIFY row_number() OVER (PARTITION BY matter_id, section ORDER BY seq DESC) = 1",
    "filtered_log": f"WITH {_LOG} SELECT edit_id, matter_id, edit_type, seq FROM log WHERE section = 'click'",
    "json_props_coercion": "SELECT event_id, TRY_CAST(props->>'$.k' AS INT) AS k, coalesce(props->>'$.k', '') AS as_list FROM events",
    "flat_keys_to_map": "SELECT event_id, 's' || (event_id % 8 + 1) || '_' || event_type AS section, trunc(value)::INT::VARCHAR AS value FROM events",
    "llm_hook_cache_antijoin": """SELECT DISTINCT sha256('{"prompt":"prompt ' || n || '","temperature":0.0,"json":false,"space":"default"}') AS key, CASE WHEN n % 3 = 0 THEN 'cached' ELSE 'answer of ' || n END AS answer, n % 3 = 0 AS cached FROM (SELECT doc_id % 97 AS n FROM documents)""",
    "groundable_filter": f"""WITH {_HITS}, ht AS (SELECT DISTINCT key, unnest({_content("text", _GENERIC)}) AS token FROM hits), e AS (SELECT item_id AS key, unnest({_content("text", _GENERIC)}) AS token FROM benchmark),
sh AS (SELECT key, count(ht.token) / count(*) AS share FROM e LEFT JOIN ht USING (key, token) GROUP BY key)
SELECT item_id AS key, 'e' || item_id AS edit_id, round(share, 6) AS share FROM benchmark LEFT JOIN sh ON key = item_id WHERE share IS NULL OR share >= 0.25 OR item_id NOT IN (SELECT key FROM hits)""",
    "best_evidence_argmax": f"""WITH {_HITS}, ht AS (SELECT key, hit_id, rank, {_content("text", _GENERIC)} AS ht FROM hits), e AS (SELECT item_id AS key, {_content("CASE WHEN item_id % 4 = 0 THEN 'zzzz none of it' ELSE text END", _GENERIC)} AS et FROM benchmark)
SELECT key, hit_id, len(list_intersect(et, ht)) AS overlap FROM e JOIN ht USING (key) QUALIFY row_number() OVER (PARTITION BY key ORDER BY len(list_intersect(et, ht)) DESC, rank, hit_id) = 1""",
    "citation_snippet_span": f"""WITH {_HITS}, b AS (SELECT item_id AS key, {_content("text", _GENERIC)} AS tokens FROM benchmark),
c AS (SELECT key, hit_id, text, list_filter(list_transform(tokens, lambda t: instr(lower(text), t) - 1), lambda p: p >= 0) AS ps FROM hits JOIN b USING (key)),
m AS (SELECT *, floor(list_sum(ps) / len(ps))::INT AS mid FROM c WHERE len(ps) > 0)
SELECT key, hit_id, greatest(0, mid - 220)::INT AS start, least(length(text), mid + 220)::INT AS "end", sha256(substr(text, greatest(0, mid - 220) + 1, least(length(text), mid + 220) - greatest(0, mid - 220))) AS snippet_sha256 FROM m""",
    "token_levenshtein_norm": rf"""WITH RECURSIVE tt{TURN}, w AS (SELECT x.conv_id, x.turn, regexp_extract_all(lower(x.text), '[\p{{L}}\p{{N}}_]+') AS a, regexp_extract_all(lower(y.text), '[\p{{L}}\p{{N}}_]+') AS b FROM tt x JOIN tt y ON x.conv_id = y.conv_id AND y.turn = x.turn + 1),
r AS (SELECT conv_id, turn, 0::BIGINT AS i, unnest(range(0, len(b) + 1)) AS j, j AS v FROM w
  UNION ALL SELECT conv_id, turn, i + 1, j, (j + min(c - j) OVER (PARTITION BY conv_id, turn ORDER BY j))::BIGINT
  FROM (SELECT r.conv_id, r.turn, i, j, CASE WHEN j = 0 THEN i + 1 ELSE least(v + 1, lag(v) OVER (PARTITION BY r.conv_id, r.turn ORDER BY j) + (a[i + 1] <> b[j])::INT) END AS c FROM r JOIN w USING (conv_id, turn) WHERE i < len(a)))
SELECT conv_id, turn, round(least(1.0, v / greatest(len(b), 1)), 6) AS distance FROM r JOIN w USING (conv_id, turn) WHERE i = len(a) AND j = len(b)""",
    "recall_at_5": f"""WITH {_HITS}, h AS (SELECT DISTINCT key AS query_id, hit_id AS doc_id, unnest(list_distinct(list_prepend((hit_id % 3)::INT, list_transform(regexp_extract_all(text, '(?i)##\\s*Page\\s+(\\d+)\\b', 1), lambda x: x::INT)))) AS page FROM hits WHERE rank + 1 <= 5),
g AS (SELECT DISTINCT item_id AS query_id, item_id * i AS doc_id, (item_id * i % 3)::INT AS page FROM benchmark, (VALUES (1), (2)) AS t(i) WHERE item_id % 7 <> 0)
SELECT item_id AS query_id, coalesce(round(avg(CASE WHEN g.doc_id IS NULL THEN NULL WHEN h.doc_id IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6), 1.0) AS recall
FROM benchmark LEFT JOIN g ON g.query_id = item_id LEFT JOIN h ON h.query_id = g.query_id AND h.doc_id = g.doc_id AND h.page = g.page GROUP BY item_id""",
    "faithfulness_lexical": f"""WITH tt{TURN}, {_HITS}, c AS (SELECT conv_id % n AS key, conv_id || ':' || turn AS claim_id, {_content("text")} AS toks FROM tt, n), w AS (SELECT key, claim_id, len(toks) AS k, unnest(toks) AS token FROM c),
ht AS (SELECT key, hit_id, unnest({_content("text")}) AS token FROM hits), best AS (SELECT key, claim_id, max(s) AS s FROM (SELECT key, claim_id, hit_id, count(*) / max(k) AS s FROM w JOIN ht USING (key, token) GROUP BY ALL) GROUP BY ALL)
SELECT key, count(*) AS n_claims, round(avg(CASE WHEN coalesce(s, 0.0) >= 0.18 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS faithfulness FROM c LEFT JOIN best USING (key, claim_id) GROUP BY key""",
    "answer_relevancy_lexical": f"WITH {_NEXT} SELECT conv_id, turn, round(CASE WHEN len({_content('text')}) > 0 THEN len(list_intersect({_content('text')}, {_content('after')})) / len({_content('text')}) ELSE 0.0 END, 6) AS relevancy FROM nx",
    "rule_application_rate": f"""WITH tt{TURN}, r AS (SELECT conv_id AS key, turn, {_content("CASE WHEN turn % 6 = 0 THEN 'the of' ELSE text END")} AS t FROM tt WHERE turn % 2 = 0), dr AS (SELECT conv_id AS key, string_agg(text, ' ' ORDER BY text) AS text FROM tt WHERE turn % 2 = 1 GROUP BY conv_id),
w AS (SELECT key, {_content("text", "['']")} AS d FROM dr)
SELECT key, count(*) AS n_rules, count(*) FILTER (len(t) > 0) AS n_applicable, round(coalesce(avg(CASE WHEN len(list_intersect(t, d)) / len(t) >= 0.30 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FILTER (len(t) > 0), 0.0), 6) AS rate FROM r JOIN w USING (key) GROUP BY key""",
    "paired_eval_delta": "WITH c AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'pre' ELSE 'post' END AS condition, m.metric, round_even(avg((doc_id * m.f % 11) / 10.0::DOUBLE), 4) AS v FROM labels, (VALUES "
    + ", ".join(f"('{m}', {i + 3})" for i, m in enumerate(evaluate.METRICS))
    + ") AS m(metric, f) GROUP BY ALL), p AS (SELECT metric, max(v) FILTER (condition = 'pre') AS pre, max(v) FILTER (condition = 'post') AS post FROM c GROUP BY metric) SELECT metric, pre, post, round_even(post - pre, 4) AS delta, round_even((pre - post) / CASE WHEN pre = 0 THEN 1e-9 ELSE pre END, 4) AS pct_reduction FROM p",
    "fallback_section_text": _sections_sql(),
    "section_gaps": """WITH f AS (SELECT o_orderkey AS k FROM orders JOIN customer ON o_custkey = c_custkey), g AS (SELECT k, list_filter([CASE WHEN k % 2 <> 0 THEN 'vesting' END, CASE WHEN k % 3 <> 0 THEN 'open liens' END, 'released liens'], lambda x: x IS NOT NULL) AS l FROM f)
SELECT k AS matter_id, (generate_subscripts(l, 1) - 1)::INT AS ordinal, 'Structured extraction did not contain ' || unnest(l) || '.' AS gap FROM g""",
    "open_questions_cap": "SELECT matter_id, section_ordinal, ordinal, gap, row_number() OVER (PARTITION BY matter_id ORDER BY section_ordinal, ordinal)::INT AS n FROM (SELECT l_suppkey % 50 AS matter_id, l_linenumber AS section_ordinal, l_orderkey AS ordinal, min('gap ' || l_partkey) AS gap FROM lineitem GROUP BY ALL) QUALIFY n <= 20",
}
_RATED = "SELECT l_orderkey AS matter_id, CASE WHEN l_returnflag = 'R' AND l_linenumber = 6 THEN 'red' WHEN l_returnflag = 'A' AND l_linenumber > 4 THEN 'yellow' ELSE 'green' END AS flag, (l_partkey % 97 = 0)::INT AS g, (l_suppkey % 41 = 0)::INT AS o, (l_partkey % 5 = 0)::INT AS w, l_partkey % 3 = 0 AS h FROM lineitem"
SQL |= {
    "overall_risk_rollup": f"SELECT matter_id, CASE WHEN bool_or(flag = 'red' OR o > 0) THEN 'material_issues' WHEN bool_or(flag = 'yellow' OR g > 0) THEN 'curable_issues' ELSE 'clear_to_close' END AS overall_risk FROM ({_RATED}) GROUP BY matter_id",
    "rule_flags": f"SELECT CASE WHEN h AND flag = 'green' AND (g > 0 OR o > 0 OR w > 0) THEN 'yellow' ELSE flag END AS flag, count(*) AS n FROM ({_RATED}) GROUP BY ALL",
    "citation_accuracy_jaccard": f"""WITH tt{TURN}, s AS (SELECT conv_id, list(text ORDER BY text) AS snippets FROM tt GROUP BY conv_id), x AS (SELECT conv_id AS key, {_content("text || ' ' || reverse(text)")} AS t, list_transform(snippets, lambda z: {_content("z")}) AS ss FROM tt JOIN s USING (conv_id)),
y AS (SELECT key, len(list_filter(ss, lambda z: len(z) > 0 AND len(list_intersect(t, z)) / len(list_distinct(list_concat(t, z))) >= 0.15)) > 0 AS ok FROM x WHERE len(t) > 0)
SELECT key, round_even(avg(CASE WHEN ok THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 4) AS accuracy, count(*) AS n FROM y GROUP BY key""",
    "section_dimension": "SELECT * FROM (VALUES "
    + ", ".join(f"({i}, '{f}', '{n}', {len(s.split(','))})" for i, (f, n, _, s) in enumerate(draft.SECTIONS))
    + ") AS t(ordinal, field, name, n_fields)",
}
