"""From chunks to answers, and their evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.functions import text
from corpusloom.operators import answer, blocks, evaluate, search
from corpusloom.plans.base import DataFrame, SparkSession, query, table

_RANKED = """ranked as (select source, doc_id, text, row_number() over (partition by source order by doc_id) as r from documents)"""


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as sources of the question that their source stands for, in order of id."""
    place = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    return table(spark, sf_dir, "documents").withColumn("r", place).select("source", "doc_id", "text", "r")


_PREFIX = f"""{_RANKED}, t as (select *, cast(ceil(strlen(text) / 4.0) as bigint) as tokens from ranked),
s as (select *, sum(tokens) over (partition by source order by r) as running from t), kept as (select * from s where running <= 4000 or r = 1)"""


#: A first text over the budget, cut to its bytes at a whole code point.
_CUT = """case when tokens <= 4000 then text else left(text, list_max(list_filter(range(greatest(0, 16000 - (strlen(text) - length(text))), 16001), lambda n: strlen(left(text, cast(n as bigint))) <= 16000))) end"""


@query(f"""with {_PREFIX} select source, doc_id, tokens, cast(running as bigint) as running from kept""")
def budget_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = answer.budget_prefix(ranked(spark, sf_dir), 4000, ["source"], content="text")
    return kept.select("source", "doc_id", "tokens", "running")


@query(f"""with {_PREFIX} select source, doc_id, '[' || r || '] ' || source || chr(10) || 'doc/' || doc_id || chr(10) || {_CUT} as block from kept""")
def prompt_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blocks(spark, sf_dir).select("source", "doc_id", "block")


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources that each question's budget takes, rendered; a first one over the budget is cut to it."""
    uri = F.concat(F.lit("doc/"), F.col("doc_id"))
    kept = answer.budget_prefix(ranked(spark, sf_dir), 4000, ["source"], content="text")
    return kept.withColumn("block", answer.rendered_block(F.col("r"), F.col("source"), _no_path(), uri, F.col("text")))


def _no_path():
    return F.lit(None).cast("array<string>")


@query(f"""with {_PREFIX}, b as (select source, r, '[' || r || '] ' || source || chr(10) || 'doc/' || doc_id || chr(10) || {_CUT} as block from kept)
select source, string_agg(block, chr(10) || chr(10) order by r) as context from b group by source""")
def prompt_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer.context(_blocks(spark, sf_dir), ["source"])


_ANSWERS = "select source, 'See [' || (length(source) % 3 + 1) || '], [2] and [' || count(*) || ']; not [0] or [9999]. Again [2].' as answer, count(*) as n from documents group by source"


@query(f"""with {_RANKED}, a as ({_ANSWERS}), c as (select source, n, cast(unnest(list_distinct(regexp_extract_all(answer, '\\[([0-9]+)\\]', 1))) as bigint) as r from a)
select c.source, c.r, k.doc_id, case when length(trim(regexp_replace(k.text, '\\s+', ' ', 'g'))) <= 240 then trim(regexp_replace(k.text, '\\s+', ' ', 'g')) else left(trim(regexp_replace(k.text, '\\s+', ' ', 'g')), 240) || '…' end as snippet
from c join ranked k on k.source = c.source and k.r = c.r where c.r between 1 and c.n""")
def citations_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ranked(spark, sf_dir)
    told = F.concat(F.lit("See ["), F.length("source") % 3 + 1, F.lit("], [2] and ["), F.max("r"), F.lit("]; not [0] or [9999]. Again [2]."))
    answers = rows.groupBy("source").agg(told.alias("answer"))
    return answer.cited(answers, rows, "source", content="text").select("source", F.col("r").cast("long").alias("r"), "doc_id", "snippet")


@query("""select conv_id, turn, role from conversations qualify row_number() over (partition by conv_id order by turn desc) <= 6""")
def last_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer.last_turns(table(spark, sf_dir, "conversations"), 6).select("conv_id", "turn", "role")


@query("""select item_id, coalesce(nullif(case when item_id % 3 = 0 then ' ' when item_id % 3 = 1 then reverse(text) end, ' '), text) as embedded from benchmark""")
def hyde_passthrough(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("item_id")
    hypothetical = F.when(i % 3 == 0, F.lit(" ")).when(i % 3 == 1, F.reverse("text"))
    return table(spark, sf_dir, "benchmark").select("item_id", answer.search_text(F.col("text"), F.lit(None).cast("string"), hypothetical).alias("embedded"))


@query("""select item_id, text as unwrapped from benchmark""")
def unwrap_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrapped = F.concat(F.lit('```text\n"'), "text", F.lit('"\n```'))
    return table(spark, sf_dir, "benchmark").select("item_id", text.unwrapped(wrapped).alias("unwrapped"))


@query("""with s as (select vec_id, vec_id % 100 / 1000.0 as score from embeddings) select vec_id from s where score >= 0.02""")
def grounding_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("vec_id") % 100 / 1000.0).alias("score"))
    return answer.grounded(rows, reranked=True).select("vec_id")


@query("""select event_id % 500 as query_id, case when arg_max(event_id, (ts, event_id)) % 2 = 0 then 1 else -1 end as rating from events where event_type in ('click', 'view') group by 1""")
def feedback_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    rating = F.when(~F.col("event_type").isin("click", "view"), 5).when(F.col("event_id") % 2 == 0, 1).otherwise(-1)
    rows = e.select((F.col("event_id") % 500).alias("query_id"), F.struct("ts", "event_id").alias("created_at"), rating.alias("rating"))
    return answer.feedback_latest(rows).select("query_id", "rating")


@query(f"""with {_RANKED} select source, cast(count(*) as bigint) as n, string_agg(r || ':' || doc_id, ',' order by r) as retrieved from ranked where r <= 5 group by source""")
def query_log_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ranked(spark, sf_dir).where("r <= 5").select("source", "r", F.col("doc_id").alias("chunk_id"), F.lit(0.0).alias("score"))
    told = F.array_join(F.transform("retrieved", lambda x: F.concat(x["rank"], F.lit(":"), x["chunk_id"])), ",")
    return answer.query_log(rows, "source").select("source", F.size("retrieved").cast("long").alias("n"), told.alias("retrieved"))


_RESULTS = """results as (select item_id as case_id, case when item_id % 5 = 0 then null else item_id % 3 = 0 end as recall_hit, item_id % 4 <> 1 as grounded,
 case when item_id % 7 = 0 then null else item_id % 2 = 0 end as correct, cast(100 + item_id * 13 % 400 as bigint) as latency_ms, case when item_id % 11 = 5 then 'boom' end as error from benchmark)"""
_SUMMARY = """summary as (select count(*) as cases, count(error) as errors, count(recall_hit) as recall_scored, round(avg(recall_hit::int), 6) as recall, round(avg(grounded::int), 6) as grounded_rate,
 round(avg(correct::int), 6) as correctness, cast(floor(avg(latency_ms)) as bigint) as mean_latency_ms from results)"""


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("item_id")
    return table(spark, sf_dir, "benchmark").select(
        i.alias("case_id"), F.when(i % 5 != 0, i % 3 == 0).alias("recall_hit"), (i % 4 != 1).alias("grounded"), F.when(i % 7 != 0, i % 2 == 0).alias("correct"),
        (100 + i * 13 % 400).alias("latency_ms"), F.when(i % 11 == 5, "boom").alias("error"),
    )


def summed(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = evaluate.summary(results(spark, sf_dir))
    return own.withColumns({c: F.round(c, 6) for c in ("recall", "grounded_rate", "correctness")})


@query(f"with {_RESULTS}, {_SUMMARY} select * from summary")
def eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summed(spark, sf_dir)


@query(f"""with {_RESULTS}, {_SUMMARY} select cases, cases = 0 as skipped, concat_ws(',', case when recall < 0.7 then 'recall' end, case when grounded_rate < 0.5 then 'grounded_rate' end, case when correctness < 0.8 then 'correctness' end) as failures from summary""")
def eval_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.gate(summed(spark, sf_dir), 0.7, 0.5, 0.8).select("cases", "skipped", F.array_join("failures", ",").alias("failures"))


@query("""with e as (select doc_id, case when doc_id % 6 = 0 then [] else [doc_id % 10, doc_id % 17 + 20] end as expected, [doc_id % 7, doc_id % 23 + 15] as got from documents)
select doc_id, case when len(expected) = 0 then null else list_has_any(expected, got) end as recall_hit from e""")
def eval_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    text_of = lambda *cs: F.array(*cs).cast("array<string>")
    expected = F.when(i % 6 == 0, F.array().cast("array<string>")).otherwise(text_of(i % 10, i % 17 + 20))
    return table(spark, sf_dir, "documents").select("doc_id", evaluate.recall_hit(expected, text_of(i % 7, i % 23 + 15)).alias("recall_hit"))


@query("""select doc_id, case doc_id % 3 when 0 then false when 1 then true end as correct from documents""")
def judge_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id") % 3
    said = F.when(i == 0, "The answer is INCORRECT.").when(i == 1, "Verdict: correct").otherwise("uncorrectable")
    return table(spark, sf_dir, "documents").select("doc_id", evaluate.verdict(said).alias("correct"))


@query(f"""with {_RESULTS} select r.case_id, b.text as question, r.error from results r left join (select * from benchmark where item_id % 2 = 0) b on b.item_id = r.case_id""")
def eval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = table(spark, sf_dir, "benchmark").where("item_id % 2 = 0").select(F.col("item_id").alias("case_id"), F.col("text").alias("question"), F.col("item_id").alias("created_at"))
    return evaluate.report(results(spark, sf_dir), cases).select("case_id", "question", "error")


@query(f"""with {_RANKED} select source, array_to_string(list(lang order by first), ',') as retrieved from (select k.source, d.lang, min(k.r) as first from ranked k join documents d using (doc_id) where k.r <= 8 group by 1, 2) group by source""")
def retrieved_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ranked(spark, sf_dir).where("r <= 8").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return evaluate.retrieved_documents(rows, "source", "lang").select("source", F.array_join("retrieved", ",").alias("retrieved"))


@query("""select doc_id, case when source like 'src1%' or source = 'src2' then true else false end as permitted from documents""")
def model_allow_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", answer.permitted_model(F.col("source"), ["src1*", "src2"]).alias("permitted"))


_FUSED = "f as (select doc_id // 30 as query, doc_id as chunk_id, row_number() over (partition by doc_id // 30 order by doc_id) as r from documents)"


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirty candidates for each query."""
    i = F.col("doc_id")
    group = F.floor(i / 30).alias("query")
    return table(spark, sf_dir, "documents").select(group, i.alias("chunk_id")).withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy("chunk_id")))


_SCORED = "s as (select query, chunk_id, cast((chunk_id * 7) % 13 as double) as score from f where r % 5 <> 0 and r <= 20)"


@query(f"""with {_FUSED}, {_SCORED}, k as (select f.query, f.chunk_id, row_number() over (partition by f.query order by case when r <= 20 then 0 else 1 end, case when r <= 20 then -coalesce(score, 0) end, r) as n from f left join s using (query, chunk_id) where r <= 20)
select query, chunk_id, n as r from k where n <= 8""")
def search_reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reranker's answer names candidates by index, one out of range and one twice; what it leaves out has score 0."""
    fused = _fused(spark, sf_dir)
    index, relevance = (F.col("r") - 1).alias("index"), ((F.col("chunk_id") * 7) % 13).cast("double").alias("relevance")
    own = fused.where("r % 5 <> 0 and r <= 20").select("query", index, relevance, F.lit(0).alias("at"))
    odd = fused.where("r = 1").select("query", F.explode(F.array(F.lit(0), F.lit(99))).alias("index"), F.lit(50.0).alias("relevance"), F.lit(1).alias("at"))
    settings = search.Reranking(True, "remote", ("remote",), True)
    head = fused.where(F.col("r") <= settings.top_n)
    rows = search.searched(fused, search.mapped(head, own.union(odd)), 8, settings)
    return rows.select("query", "chunk_id", F.col("r").cast("long").alias("r"))


@query(f"""with {_FUSED} select query, chunk_id, r from f where r <= 8""")
def search_without_reranker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A provider that is not on the list leaves the fused order."""
    rows = search.searched(_fused(spark, sf_dir), None, 8, search.Reranking(True, "remote", ("other",), True))
    return rows.select("query", "chunk_id", F.col("r").cast("long").alias("r"))


@query("""select doc_id, case when doc_id % 2 = 0 and doc_id % 3 > 0 and doc_id % 5 <> 0 then 'rewritten ' || doc_id else source end as question from documents""")
def rewrite_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    rewritten = F.when(i % 5 == 0, F.lit(" ")).otherwise(F.concat(F.lit('"rewritten '), i, F.lit('"')))
    return table(spark, sf_dir, "documents").select("doc_id", search.standalone(F.col("source"), i % 3, i % 2 == 0, rewritten).alias("question"))


@query(f"""with {_FUSED}, q as (select distinct query, case when query % 7 = 3 then null else 'as [2] and [' || (query % 9 + 1) || '], [77]' end as answer, query % 5 <> 0 as grounded, query % 2 = 0 as streamed from f),
o as (select *, case when not grounded then 'refused' when answer is null then 'degraded' else 'answered' end as outcome from q)
select o.query, outcome, coalesce(string_agg(chunk_id, ',' order by r) filter (where outcome <> 'refused' and (outcome = 'degraded' or streamed or r = 2 or r = query % 9 + 1)), '') as citations from o join f using (query) where r <= 8 group by 1, 2""")
def answer_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = _fused(spark, sf_dir)
    k = F.col("query")
    told = F.when(k % 7 != 3, F.concat(F.lit("as [2] and ["), k % 9 + 1, F.lit("], [77]")))
    asked = fused.select("query").distinct().select("query", told.alias("answer"), F.when(k % 7 == 3, "timeout").alias("error"), (k % 5 != 0).alias("grounded"), (k % 2 == 0).alias("streamed"))
    rows = search.answered(asked, fused.where("r <= 8"))
    return rows.select("query", "outcome", F.array_join("citations", ",").alias("citations"))


@query("""select count(*) as pages, 1.0::double as removal, 1.0::double as retention from pages""")
def boilerplate_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page wrapped in chrome that the parser is to take away, around an article that is to stay."""
    i = F.col("page_id")
    chrome = [F.concat(F.lit(m), i) for m in ("navmark", "asidemark", "footmark")]
    html = F.concat(F.lit("<html><body><nav>"), chrome[0], F.lit("</nav><main><h1>kept"), i, F.lit("</h1><p>stays"), i, F.lit("</p></main><aside>"), chrome[1], F.lit("</aside><footer>"), chrome[2], F.lit("</footer></body></html>"))
    text = blocks.canonical_column(blocks.parsed("text/html", html)["blocks"]).alias("text")
    rows = table(spark, sf_dir, "pages").select(text, F.array(F.concat(F.lit("kept"), i), F.concat(F.lit("stays"), i)).alias("content"), F.array(*chrome).alias("boilerplate"))
    return evaluate.boilerplate(rows)


@query(r"""with p as (select page_id, html, regexp_replace(regexp_replace(regexp_extract(html, '<article>(.*)</article>', 1, 's'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g') as t from pages),
m as (select page_id, t, regexp_extract_all(html, '<p>([\p{L}., ]{12,})</p>', 1) as content, list_concat(regexp_extract_all(html, '<div class="ad">([\p{L}., ]{12,})', 1), regexp_extract_all(html, '&middot; ([\p{L}., ]{12,})', 1)) as chrome from p),
n as (select len(content) as c, len(list_filter(content, lambda x: contains(t, x))) as kept, len(chrome) as b, len(list_filter(chrome, lambda x: contains(t, x))) as stayed from m)
select count(*) as pages, cast(sum(c) as bigint) as paragraphs, cast(sum(b) as bigint) as chrome, round(avg(case when b = 0 then 1.0::double else (b - stayed)::double / b end), 9) as removal, round(sum(kept)::double / sum(c), 9) as retention from n""")
def boilerplate_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parser on the pages as they are: plain paragraphs of the article are to stay, the texts of the advertisement and of the
    footer to go."""
    pages = table(spark, sf_dir, "pages")
    plain = lambda before, after: F.regexp_extract_all("html", F.lit(before + r"([\p{L}., ]{12,})" + after), F.lit(1))
    text = blocks.canonical_column(blocks.parsed("text/html", F.col("html"))["blocks"]).alias("text")
    rows = pages.select(text, plain("<p>", "</p>").alias("content"), F.concat(plain('<div class="ad">', ""), plain("&middot; ", "")).alias("boilerplate"))
    counts = rows.agg(F.sum(F.size("content")).alias("paragraphs"), F.sum(F.size("boilerplate")).alias("chrome"))
    # frames of one row
    return evaluate.boilerplate(rows).crossJoin(counts).withColumns({"removal": F.round("removal", 9), "retention": F.round("retention", 9)})


@query("""select item_id as case_id, case when item_id % 4 = 1 then 'new ' || item_id else text end as question from benchmark where item_id % 4 <> 2 union all select -1 - item_id, 'added' from benchmark where item_id % 4 = 3""")
def eval_case_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("item_id")
    items = table(spark, sf_dir, "benchmark")
    none = F.array().cast("array<string>").alias("expected")
    cases = items.select(i.alias("case_id"), F.col("text").alias("question"), none)
    puts = items.where(i % 4 == 1).select(F.lit(1).alias("seq"), F.lit("put").alias("op"), i.alias("case_id"), F.concat(F.lit("new "), i).alias("question"), none)
    first = items.where(i % 4 == 2).select(F.lit(0), F.lit("put"), i, F.lit("soon gone"), none)
    gone = items.where(i % 4 == 2).select(F.lit(2), F.lit("delete"), i, F.lit(None).cast("string"), none)
    added = items.where(i % 4 == 3).select(F.lit(3), F.lit("put"), -1 - i, F.lit("added"), none)
    return evaluate.cases_changed(cases, puts.union(first).union(gone).union(added)).select("case_id", "question")
