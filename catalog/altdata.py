"""Text, hiring, contract, OTC and macro signals."""

from pyspark.sql import functions as F

from catalog import base
from catalog.bars import TOKENS
from catalog.base import awards, bars, filings, jobs, macro, otc, query, table
from tidemark.functions.columns import fiscal_month_end, signal_label
from tidemark.functions.vocabularies import EVASIVE_PATTERNS, RISK_SEVERITY, SKILL_PATTERNS
from tidemark.operators import aggregates as A, text as X
from tidemark.plans import signals as S

# The given text is invented prose, so the checks add frequent tokens to the lists.
LEXICON = {**RISK_SEVERITY, "the": 1, "of": 2, "and": 1, "to": 2}
PATTERNS = [*EVASIVE_PATTERNS, r"\bthe\b", r"\bto [a-z]+"]
SKILLS = {**SKILL_PATTERNS, "ai_ml": [*SKILL_PATTERNS["ai_ml"], "data", r"\bmodel\w*"],
          "cyber": [*SKILL_PATTERNS["cyber"], r"\bthe\b"], "cloud": [*SKILL_PATTERNS["cloud"], r"\bof\b"]}


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


WEIGHT = "case " + " ".join(f"when contains(x, {quoted(w)}) then {v}" for w, v in LEXICON.items()) + " end"
WORDS = r"list_filter(string_split_regex(lower(text), '[\s\x0b\x1c-\x1f\x{85}\p{Z}]+'), lambda x: x <> '')"
COUNTS = " + ".join(f"len(regexp_extract_all(lower(text), {quoted(p)}))" for p in PATTERNS)
FOUND = "flatten([" + ", ".join(f"regexp_extract_all(lower(text), {quoted(p)})" for p in PATTERNS) + "])"


def unicode_borders(p: str) -> str:
    """``\\b`` for all scripts, which the SQL engine knows for ASCII only."""
    word, other = r"[\p{L}\p{M}\p{N}_]", r"[^\p{L}\p{M}\p{N}_]"
    if p.startswith(r"\b"):
        p = f"(?:^|{other})" + p[2:]
    if p.endswith(r"\+\b"):
        return p[:-2] + word
    return p[:-2] + f"(?:$|{other})" if p.endswith(r"\b") else p


def skill_count(patterns, column="description"):
    return " + ".join(f"regexp_matches(lower(coalesce({column},'')), {quoted(unicode_borders(p))})::int" for p in patterns)


base.SQL_VIEWS.update({
    "token_docs": f"select source symbol, doc_id seq, date '2020-01-01' + cast(doc_id as int) filed, {TOKENS} t from documents",
    "filing_scores": f"""select symbol, filed, seq, case when len(p)>0 then round((na+nr)/u*100,2) else 0 end pct_changed,
       case when len(p)>0 then round(na/u*100,2) else 0 end pct_added, case when len(p)>0 then round(nr/u*100,2) else 0 end pct_removed,
       case when len(p)>0 then coalesce(list_sum(h),0)::int else 0 end severity_score, case when len(p)>0 then len(h)::int else 0 end new_risk_count from (
       select *, len(a)::double na, len(list_filter(p, lambda x: not list_contains(t, x)))::double nr, greatest(len(list_distinct(list_concat(t,p))),1) u,
       list_filter(list_transform(a, lambda x: {WEIGHT}), lambda x: x is not null) h from (
       select *, list_filter(t, lambda x: not list_contains(p, x)) a from (select symbol, filed, seq, t,
       lag(t) over (partition by symbol order by filed, seq) p from token_docs)))""",
    "skills": " union all ".join(
        f"select agency, post_date, {quoted(c)} skill_category, ({skill_count(ps)})::int \"count\" from jobs" for c, ps in SKILLS.items()),
    "trends": """select skill_category, "month", total_mentions, posting_count, total_mentions/lag(total_mentions) over w-1 mom_change_pct,
       avg(posting_count) over (partition by skill_category order by "month" rows 2 preceding) rolling_3mo_avg from (
       select skill_category, cast(date_trunc('month', post_date) as date) "month", sum("count")::bigint total_mentions, count(*) posting_count
       from skills where "count">0 group by 1,2) window w as (partition by skill_category order by "month")""",
})
base.DEPENDS.update({"filing_scores": ("token_docs",), "skills": ("jobs",), "trends": ("skills",)})


@query("t1_filing_diff", "select * from filing_scores", ("filing_scores",),
       {"pct_changed": 2, "pct_added": 2, "pct_removed": 2})
def t1(spark, sf):
    return X.filing_diff(filings(spark, sf), LEXICON)


@query("t2_evasiveness", f"""select doc_id, ({COUNTS})::int evasive_phrase_count,
    least(({COUNTS})/greatest(len({WORDS}),1)*10000, 100) evasiveness_score, array_to_string({FOUND}[1:5], '|') sample_matches
    from documents""", (), {"evasiveness_score": 2})
def t2(spark, sf):
    out = X.evasiveness(table(spark, sf, "documents").select("doc_id", "text"), patterns=PATTERNS)
    return out.select("doc_id", "evasive_phrase_count", "evasiveness_score",
                      F.array_join("sample_matches", "|").alias("sample_matches"))


@query("t2_evasiveness_by_transcript", f"""select conv_id, sum({COUNTS})::bigint evasive_phrase_count,
    least(sum({COUNTS})/greatest(sum(len({WORDS})),1)*10000, 100) evasiveness_score from conversations group by 1""", (),
       {"evasiveness_score": 2})
def t2_turns(spark, sf):
    return X.evasiveness_by(table(spark, sf, "conversations"), "conv_id", "turn", patterns=PATTERNS).drop("sample_matches")


@query("t3_skill_tags", "select agency, post_date, skill_category, \"count\" from skills", ("skills",))
def t3(spark, sf):
    return X.skill_tags(jobs(spark, sf), SKILLS)


@query("t3_skill_tags_ignore_case", " union all ".join(
    f"select agency, post_date, {quoted(c)} skill_category, (" + " + ".join(
        f"regexp_matches(coalesce(description,''), {quoted('(?i)' + unicode_borders(p))})::int" for p in ps) + ')::int "count" from jobs'
    for c, ps in SKILLS.items()), ("jobs",))
def t3_ignore(spark, sf):
    return X.skill_tags(jobs(spark, sf), SKILLS, ignore_case=True)


@query("t4_skill_acceleration", "select * from trends", ("trends",), {"mom_change_pct": 6, "rolling_3mo_avg": 6})
def t4(spark, sf):
    return S.skill_acceleration(jobs(spark, sf), SKILLS)


HIRING = """select sum(m*m)/sum(m) ai_hiring_index, sum(a*m)/sum(m) ai_hiring_momentum from (select skill_category, sum(total_mentions) m,
    avg(mom_change_pct) a from (select *, row_number() over (partition by skill_category order by "month" desc) rn from trends
    where skill_category in ('ai_ml','gpu_hpc','cyber','data_infra','clearance')) where rn<=6 group by 1)"""


@query("t5_hiring_index", HIRING, ("trends",), {"ai_hiring_index": 6, "ai_hiring_momentum": 6})
def t5(spark, sf):
    return S.hiring_index(S.skill_acceleration(jobs(spark, sf), SKILLS))


CONTRACT = """select {k} r recent_90d_awards, coalesce(h/nullif(span,0)*90,0) expected_90d_awards, coalesce((r-h/nullif(span,0)*90)/nullif(h/nullif(span,0)*90,0),0)
    contract_surprise_ratio, hhi award_concentration_hhi, unique_agencies, coalesce(r/nullif(n,0),0) avg_award_size from (
    select {k} coalesce(sum(amount) filter (new),0) r, coalesce(sum(amount) filter (not new),0) h, count(*) filter (new) n,
    date_diff('day', min(event_date) filter (not new), max(event_date) filter (not new)) span,
    count(distinct agency) filter (new) unique_agencies from c group by all)
    join (select {k} coalesce(sum(v*v)/nullif(pow(sum(v),2),0)*10000,0) hhi from (select {k} vendor, coalesce(sum(amount) filter (new),0) v from c group by all) group by all) {j}"""
base.SQL_VIEWS["c"] = """select symbol, event_date, amount, 'V'||(cast(award_id as bigint)%40) vendor, 'A'||(cast(award_id as bigint)%7) agency,
    event_date>=date '2000-06-30'-90 as new from awards"""
base.DEPENDS["c"] = ("awards",)
C_FLOATS = {"recent_90d_awards": 2, "expected_90d_awards": 3, "contract_surprise_ratio": 6, "award_concentration_hhi": 5,
            "avg_award_size": 3}


def contracts(spark, sf):
    n = F.col("award_id").cast("long")
    return awards(spark, sf).select(
        "symbol", F.col("event_date").alias("start_date"), "amount",
        F.concat(F.lit("V"), (n % 40).cast("string")).alias("vendor"),
        F.concat(F.lit("A"), (n % 7).cast("string")).alias("agency"))


@query("t6_contract_surprise", CONTRACT.format(k="", j="on true"), ("c",), C_FLOATS)
def t6(spark, sf):
    return S.contract_surprise(contracts(spark, sf), as_of="2000-06-30")


@query("t6_contract_surprise_by_symbol", CONTRACT.format(k="symbol,", j="using (symbol)"), ("c",), C_FLOATS)
def t6_by(spark, sf):
    return S.contract_surprise(contracts(spark, sf), as_of="2000-06-30", by=["symbol"])


@query("a9_hhi", """select symbol, sum(v*v)/pow(sum(v),2)*10000 award_concentration_hhi from (select symbol, vendor, sum(amount) v from c
    group by 1,2) group by 1""", ("c",), {"award_concentration_hhi": 5})
def a9(spark, sf):
    return A.hhi(contracts(spark, sf), by=["symbol"])


# Components keyed by symbol: the scores of source n go to symbol n.
@query("t7_composite_signal", f"""with f as (select 'S'||lpad(substr(symbol,4),2,'0') symbol, severity_score, pct_changed from filing_scores
      qualify row_number() over (partition by symbol order by filed desc, seq desc)=1),
    cs as ({CONTRACT.format(k='symbol,', j='using (symbol)')}),
    ev as (select 'S'||lpad(substr(source,4),2,'0') symbol, least(sum({COUNTS})/greatest(sum(len({WORDS})),1)*10000,100) s from documents group by 1),
    h as ({HIRING}), px as (select symbol, (last/(sum(close)/20)-1)*100 mom from (select symbol, close, first(close) over (partition by symbol order by date desc) last,
      row_number() over (partition by symbol order by date desc) rn, count(*) over (partition by symbol) k from bars) where rn<=20 and k>20 group by symbol, last),
    p as (select y.symbol, -(least(severity_score,30)/10*0.7+pct_changed/10*0.3) fr, case when y.symbol < 'S20' then least(greatest(ai_hiring_momentum*5,-3),3) end ah,
      least(greatest(contract_surprise_ratio*2,-3),3) ca, case when s is not null then least(greatest(-round(s,2)/5,-3),3) end es, case when mom is not null then least(greatest(mom,-3),3) end pm
      from (select distinct symbol from bars) y left join f using (symbol) left join cs using (symbol) left join ev using (symbol) left join px using (symbol), h),
    z as (select *, (coalesce(fr*0.25,0)+coalesce(ah*0.25,0)+coalesce(ca*0.25,0)+coalesce(es*0.15,0)+coalesce(pm*0.10,0))/
      ((fr is not null)::int*0.25::double+(ah is not null)::int*0.25::double+(ca is not null)::int*0.25::double+(es is not null)::int*0.15::double+(pm is not null)::int*0.10::double) sc from p)
    select symbol, fr filing_risk, ah ai_hiring, ca contract_awards, es evasiveness, pm price_momentum, sc composite_score,
    case when sc>1.5 then 'STRONG_BULLISH' when sc>0.5 then 'BULLISH' when sc>-0.5 then 'NEUTRAL' when sc>-1.5 then 'BEARISH' else 'STRONG_BEARISH' end interpretation from z""",
       ("filing_scores", "c", "trends", "bars"),
       {n: 5 for n in ("filing_risk", "ai_hiring", "contract_awards", "evasiveness", "price_momentum", "composite_score")})
def t7(spark, sf):
    from tidemark.operators.sets import keep_last, last_n
    from tidemark.session import reused
    symbol = lambda c: F.concat(F.lit("S"), F.lpad(F.substring(c, 4, 9), 2, "0")).alias("symbol")
    b = reused(bars(spark, sf))
    names = b.select("symbol").distinct()
    # Only each company's latest filing counts, so it is scored against the one before it and no other pair is.
    scores = X.filing_diff(last_n(filings(spark, sf), ["symbol"], ["filed", "seq"], 2), LEXICON)
    filing = keep_last(scores, ["symbol"], ["filed", "seq"]).select(symbol("symbol"), "severity_score", "pct_changed")
    hiring = S.hiring_index(S.skill_acceleration(jobs(spark, sf), SKILLS)).withColumn("_all", F.lit(0))
    hired = names.filter("symbol < 'S20'").withColumn("_all", F.lit(0)).join(hiring, "_all").drop("_all")
    contract = S.contract_surprise(contracts(spark, sf), as_of="2000-06-30", by=["symbol"])
    docs = table(spark, sf, "documents").select("source", "doc_id", "text")
    evasive = X.evasiveness_by(docs, "source", "doc_id", patterns=PATTERNS, samples=False).withColumn("symbol", symbol("source"))
    return S.composite_signal(names, filing, hired, contract, evasive, b)


@query("t7_signal_labels", """select o_orderkey, case when s>1.5 then 'STRONG_BULLISH' when s>0.5 then 'BULLISH' when s>-0.5 then 'NEUTRAL'
    when s>-1.5 then 'BEARISH' else 'STRONG_BEARISH' end "label" from (select o_orderkey, o_totalprice/100000-2.5 s from orders)""")
def t7_labels(spark, sf):
    score = F.col("o_totalprice") / 100000 - 2.5
    return table(spark, sf, "orders").select("o_orderkey", signal_label(score).alias("label"))


@query("t8_volume_spikes", """select ticker, trade_date, share_volume, m avg_volume, s std_volume, (share_volume-m)/s volume_z_score from (
    select *, avg(share_volume) over w m, stddev_samp(share_volume) over w s from otc window w as (partition by ticker))
    where s>0 and (share_volume-m)/s>2.5""", ("otc",), {"avg_volume": 5, "std_volume": 5, "volume_z_score": 6})
def t8(spark, sf):
    out = S.volume_spikes(otc(spark, sf), 2.5)
    return out.select("ticker", "trade_date", "share_volume", "avg_volume", "std_volume", "volume_z_score")


@query("t9_series_spread", """select arg_max(value, date) filter (series_id='1-URGENT')-arg_max(value, date) filter (series_id='5-LOW') spread
    from macro""", ("macro",), {"spread": 4})
def t9(spark, sf):
    return S.series_spread(macro(spark, sf), "1-URGENT", "5-LOW")


@query("t10_series_trend", """select series_id, date, value, value/lag(value,4) over w-1 yoy_change_pct, value-lag(value) over w qoq_change
    from macro window w as (partition by series_id order by date)""", ("macro",),
       {"value": 4, "yoy_change_pct": 6, "qoq_change": 4})
def t10(spark, sf):
    return S.series_trend(macro(spark, sf))


@query("t11_macro_regime", """with v as (select series_id, date, value/50000 v, value/lag(value,12) over (partition by series_id order by date)-1 y from macro),
    r as (select coalesce(max(y) filter (series_id='1-URGENT'),0)*100 p, coalesce(max(v) filter (series_id='2-HIGH'),0) u, coalesce(max(v) filter (series_id='3-MEDIUM'),0) e
      from v where row(series_id, date) in (select row(series_id, max(date)) from macro group by series_id)),
    s as (select *, least(greatest(case when p>4 then -2 when p>3 then -1 when p>1.5 and p<2.5 then 1 else 0 end +
      case when u>6 then -1.5 when u between 4 and 5 then 0.5 when u<3.5 then 1 else 0 end,-3),3) sc from r)
    select p inflation_cpi, u unemployment, e sp500_latest, sc macro_score, case when sc>1 then 'RISK_ON' when sc>0.25 then 'GOLDILOCKS'
    when sc<-1 then 'RISK_OFF' when sc<-0.25 then 'STAGFLATION_LEANING' else 'NEUTRAL' end regime from s""", ("macro",),
       {"inflation_cpi": 5, "unemployment": 6, "sp500_latest": 6, "macro_score": 3})
def t11(spark, sf):
    scaled = macro(spark, sf).withColumn("value", F.col("value") / 50000)
    return S.macro_regime(scaled, "1-URGENT", "2-HIGH", "3-MEDIUM")


@query("t12_latest_by_series", "select series_id, max(date) date, arg_max(value, date) as value from macro group by 1", ("macro",),
       {"value": 4})
def t12(spark, sf):
    return S.latest_by_series(macro(spark, sf))


@query("s20_fiscal_month_end", """select o_orderkey, last_day(cast(o_orderdate as date)) month_end from orders""")
def s20(spark, sf):
    # Fiscal year and month of a calendar month: October opens the next year.
    day = F.col("o_orderdate").cast("date")
    fy = F.year(day) + (F.month(day) >= 10).cast("int")
    fm = (F.month(day) + 2) % 12 + 1
    return table(spark, sf, "orders").select("o_orderkey", fiscal_month_end(fy, fm).alias("month_end"))
