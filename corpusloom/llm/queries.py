"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import alignment, chat, cws, decontam, divergence, langid, packing, pii, simhash, tokenfile, tokens, urlfilter, warc
from corpusloom.session import bound_batches
from corpusloom.sources.tables import spread, table


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cws.fingerprint(spread(table(spark, sf_dir, "documents")))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(spread(table(spark, sf_dir, "pages")))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(spread(table(spark, sf_dir, "documents")))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spread(table(spark, sf_dir, "pages")))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(spread(table(spark, sf_dir, "documents")))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(spread(table(spark, sf_dir, "documents")))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spread(table(spark, sf_dir, "documents")))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(spread(table(spark, sf_dir, "documents")))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.collapse(table(spark, sf_dir, "conversations"))


def op11_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return tokenfile.round_trip(table(spark, sf_dir, "documents"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return alignment.alignment(spread(table(spark, sf_dir, "documents")))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(spread(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_fingerprints, op2_url_filter, op3_token_counts, op4_warc, op5_decontamination, op6_pii,
        op7_language_id, op8_packing, op9_simhash, op10_chat, op11_token_ids, op12_alignment, op13_divergence,
    )
}
#: Base32 of a SHA-1: five hex digits at a time are four characters.
_BASE32 = """array_to_string(list_transform(range(0, 8), lambda k: array_to_string(list_transform([15, 10, 5, 0], lambda b:
  substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(((cast('0x' || substr(h, 5 * k + 1, 5) as bigint) >> b) & 31) + 1 as bigint), 1)), '')), '')"""

_AUDIT = """with d as materialized (select coalesce(lang, '') as lang, coalesce(source, '') as source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as ws from documents),
g as (select distinct lang, source from d), l as (select lang, unnest(list_distinct(ws)) as term from d), o as (select lang, source, unnest(ws) as term from d),
k as materialized (select lang, term from l group by 1, 2 having count(*) >= 30), v as (select lang, count(*) as v from k group by 1),
c as materialized (select lang, source, term, count(*) as n from o join k using (lang, term) group by 1, 2, 3),
gn as materialized (select lang, source, coalesce(sum(n), 0)::hugeint as t, coalesce(any_value(v), 0)::hugeint as v from g left join c using (lang, source) left join v using (lang) group by 1, 2),
p as materialized (select lang, source, term, coalesce(n, 0) as n, (1 + (1000000000::hugeint * (coalesce(n, 0) + 5)) // (t + 5 * v))::bigint as p from gn join k using (lang) left join c using (lang, source, term)),
q as (select lang, term, (1 + (1000000000::hugeint * (sum(n) + 5)) // (any_value(t) + 5 * any_value(v)))::bigint as q from c join (select lang, sum(t) as t, any_value(v) as v from gn group by 1) using (lang) group by 1, 2),
pv as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p))::bigint as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3),
pairs as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0) as value from g a join g b on a.lang = b.lang and a.source <> b.source left join pv on pv.lang = a.lang and pv.source = a.source and pv.item = b.source),
terms as (select lang, source, 'term' as part, term as item, p - q as value from p join q using (lang, term) where n > 0 and p > q),
r as (select *, cast(row_number() over (partition by lang, source, part order by value desc, encode(item)) as integer) as rank from (select * from pairs union all select * from terms))
select lang, source, part, item, value, rank from r where part = 'pair' or rank <= 50"""

ORACLE: dict[str, str] = {
    "op13_divergence": _AUDIT,
    "op4_warc": f"""with d as (select page_id, strlen(coalesce(html, '')) as n, sha1(coalesce(html, '')) as h from pages), t as (select *, max(page_id) over (partition by h, n) as top from d)
select page_id, n as payload_bytes, {_BASE32} as payload_digest, case when page_id = top then 'response' else 'revisit' end as record_type, case when page_id <> top then top end as refers_to from t""",
    "op10_chat": r"""with c as (select conv_id, list({'r': role, 't': text} order by turn) as ts from conversations group by conv_id),
u as (select min(conv_id) as conv_id, count(*) as n_copies, ts from c group by ts),
p as (select distinct ts[1:k] as ts from (select ts, unnest(range(1, len(ts))) as k from u))
select conv_id, cast(len(ts) as bigint) as n_turns, n_copies, array_to_string(list_transform(ts, lambda x: '<|im_start|>' || regexp_replace(coalesce(x.r, 'unknown'), '[\s<>|]+', '_', 'g') || chr(10)
  || regexp_replace(coalesce(x.t, ''), '<\|(im_start|im_end)\|>', '<\1>', 'g') || '<|im_end|>' || chr(10)), '') as chat from u anti join p using (ts)""",
}
