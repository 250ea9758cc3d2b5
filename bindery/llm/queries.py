"""Registered queries of the operators, and their oracles."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from bindery.llm import alignment, chat, divergence, html, langid, licences, minhash, mixing, packing, quality, secrets, suffix, topk

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
TOKENIZERS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op2_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), TOKENIZER)


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op4_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(table(spark, sf_dir, "documents"))


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.train(docs))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.conversations(table(spark, sf_dir, "conversations"))


#: Every message of the given table once more as mail: an answer that quotes it at the first level and the message before it at the second.
QUOTING = r"""
select conv_id, turn * 2 as turn, role, text from conversations
union all select conv_id, turn * 2 + 1, 'mailer', 'On Monday, ' || coalesce(role, 'somebody') || ' wrote:' || chr(10)
  || '> ' || replace(replace(text, '. ', '.' || chr(10)), chr(10), chr(10) || '> ') || chr(10) || coalesce('> > ' || replace(before, chr(10), chr(10) || '> > ') || chr(10), '')
  || chr(10) || 'Answer to number ' || cast(turn as string) || ' of conversation ' || cast(conv_id as string)
from (select *, lag(text) over (partition by conv_id order by turn) as before from conversations)"""


def op8_nested_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "conversations").createOrReplaceTempView("conversations")
    return chat.conversations(spark.sql(QUOTING))


def chat_sql(messages: str) -> str:
    """The linking of quotations as DuckDB SQL over a table of messages."""
    norm = r"trim(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
    parts = r"list_concat([{0}], string_split_regex({0}, '\n\s*\n'), string_split({0}, chr(10)), string_split(regexp_replace(regexp_replace({0}, '\n+', ' ', 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)))"
    return rf"""
        with recursive m as (select conv_id as conv, turn, role, coalesce(text, '') as text, row_number() over () as id from {messages}),
        raw as (select id, conv, turn, unnest(a) as line, generate_subscripts(a, 1) as i
                from (select *, string_split_regex(text, '\r\n?|\n') as a from m where contains(text, '>'))),
        marked as (select id, conv, turn, i, regexp_replace(line, '^\s{{0,3}}((?:>[ \t]?)+)', '') as line,
                     length(regexp_replace(regexp_extract(line, '^\s{{0,3}}((?:>[ \t]?)+)', 1), '[^>]', '', 'g')) as depth from raw),
        followed as (select *, coalesce(lead(depth) over (partition by id order by i), 0) > 0 as before_quote,
                       i - row_number() over (partition by id, depth order by i) as run from marked),
        kept as (select id, string_agg(line, chr(10) order by i) as own from followed
                 where depth = 0 and not (before_quote and regexp_matches(line,
                   '(?i)^[^\n]{{0,200}}\b(?:wrote|said|writes|schrieb|escribió|a écrit)\b[^\n]{{0,20}}:\s*$')) group by id),
        own as (select m.id, conv, turn, role, regexp_replace(regexp_replace(case when contains(text, '>') then coalesce(own, '') else text end,
                  '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') as own from m left join kept using (id)),
        quoted as (select conv, turn, depth, string_agg(line, chr(10) order by i) as passage from followed where depth > 0 group by id, conv, turn, depth, run),
        asked as (select distinct conv, turn, depth, {norm.format("part")} as words from (select conv, turn, depth, unnest({parts.format("passage")}) as part from quoted)
                  where conv is not null and turn is not null),
        sources as (select conv, {norm.format("part")} as words, min(turn) as source from (select conv, turn, unnest({parts.format("own")}) as part from own
                  where conv in (select conv from asked) and turn is not null) group by all),
        found as (select a.conv, a.turn, depth, source, count(*) as pieces from asked a join sources s on a.conv = s.conv and a.words = s.words
                  where a.words != '' and source < a.turn group by all),
        links as (select conv, turn, arg_max(source, struct_pack(d := -depth, v := pieces, s := source)) as reply_to, sum(pieces)::bigint as linked,
                    string_agg(depth || ':' || source, ',' order by depth, source) as quoted_turns from found group by all),
        chain as (select conv, turn, reply_to as up from links union all
                  select chain.conv, chain.turn, links.reply_to from chain join links on links.conv = chain.conv and links.turn = chain.up),
        roots as (select conv, turn, min(up) as root from chain group by all)
        select o.conv as conv_id, o.turn, o.role, reply_to, coalesce(root, o.turn) as thread_turn, coalesce(q, 0) as n_quote_lines,
          coalesce(linked, 0) as n_linked, coalesce(quoted_turns, '') as quoted_turns, own as text, '<|' || coalesce(o.role, 'unknown') || '|>' || chr(10) || own as formatted
        from own o left join (select id, count(*) as q from followed where depth > 0 group by id) using (id)
          left join links l on l.conv = o.conv and l.turn = o.turn left join roots r on r.conv = o.conv and r.turn = o.turn"""


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.learn(docs))
    return found.select("doc_id", langid.held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op11_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "obligation")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), *TOKENIZERS)


QUERIES = {f.__name__: f for f in (
    op1_minhash_near_dedup, op2_vector_packing, op3_exact_top_k, op4_pfair_mixing, op5_suffix_dedup, op6_secret_scans,
    op7_html_extraction, op8_chat_formatting, op8_nested_quotes, op9_quality_rules, op10_language_id,
    op11_license_scans, op12_source_divergence, op13_tokenizer_alignment)}

ORACLES = {
    "op1_minhash_near_dedup": r"""
        with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x20\x09-\x0D]+') as ws from documents),
        s as (select distinct doc_id, array_to_string(ws[i:i + 4], ' ') as shingle
              from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) as i from w where len(ws) > 0)),
        n as (select doc_id, count(*) as n from s group by doc_id),
        common as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.shingle = b.shingle and a.doc_id != b.doc_id group by all),
        links as (select x, y from common join n p on p.doc_id = x join n q on q.doc_id = y where 100 * c >= 85 * (p.n + q.n - c)),
        reached as (select doc_id, doc_id as other from w union select links.y, reached.other from reached join links on links.x = reached.doc_id)
        select doc_id, coalesce(n, 0) as n_shingles, component_id, doc_id = component_id as kept
        from (select doc_id, min(other) as component_id from reached group by doc_id) left join n using (doc_id)""",
    "op8_chat_formatting": chat_sql("conversations"),
    "op8_nested_quotes": chat_sql(f"({QUOTING})"),
    "op3_exact_top_k": """
        with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as e from embeddings
                   where embedding is not null and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))),
        s as (select q.vec_id as query_id, c.vec_id, list_dot_product(q.e, c.e)::bigint as score
              from v q join v c on q.vec_id % 100 = 0 and c.vec_id != q.vec_id)
        select query_id, rank::int as rank, vec_id, score
        from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 10""",
    "op12_source_divergence": r"""
        with d as (select coalesce(lang, '') as lang, coalesce(source, '') as source, row_number() over () as id,
                     regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as ws
                   from documents),
        w as (select lang, source, id, unnest(ws) as term from d),
        kept as (select lang, term, count(*) as total from w group by all having count(distinct id) >= 30),
        langs as (select lang, count(*) as v, sum(total)::bigint as n from kept group by all),
        groups as (select distinct lang, source from d),
        c as (select lang, source, term, count(*) as n from w join kept using (lang, term) group by all),
        cells as (select g.lang, g.source, k.term, total, coalesce(c.n, 0) as n from groups g join kept k using (lang) left join c using (lang, source, term)),
        sums as (select lang, source, sum(n)::bigint as sum_n from cells group by all),
        p as (select cells.lang, source, term, cells.n, (1 + (1000000000::hugeint * (cells.n + 5)) // (sum_n + 5 * v))::bigint as p,
                (1 + (1000000000::hugeint * (total + 5)) // (langs.n + 5 * v))::bigint as q
              from (select cells.lang, cells.source, term, total, cells.n, sum_n from cells join sums using (lang, source)) as cells join langs on langs.lang = cells.lang),
        pair as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p))::bigint as value
                 from p a join p b on a.lang = b.lang and a.term = b.term and a.source != b.source group by all),
        rows_ as (select g.lang, g.source, 'pair' as part, h.source as item, coalesce(value, 0) as value
                  from groups g join groups h on g.lang = h.lang and g.source != h.source
                    left join pair on pair.lang = g.lang and pair.source = g.source and pair.item = h.source
                  union all select lang, source, 'term', term, p - q from p where n > 0 and p > q)
        select * from (select *, (row_number() over (partition by lang, source, part order by value desc, item))::int as rank from rows_)
        where part = 'pair' or rank <= 50""",
}
