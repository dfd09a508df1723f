"""The queries of this subpackage: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, decontam, htmlextract, idplanes, jaccard, mixing, pii, piecewise, quality, spandedup, tokencount, toolchat, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of each document by boosted trees."""
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each source near 150 % of all words dealt 5 : 2 : 1."""
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_benchmark_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages of ten words found in documents."""
    hits = decontam.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return hits.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op4_piece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentencepiece tokens of each document."""
    return tokencount.count_tokens(_table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of each page."""
    return htmlextract.extract(_table(spark, sf_dir, "pages"))


def op6_id_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids written in byte planes and read back."""
    return idplanes.write_and_read(_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op7_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without sentences of passages that occurred before."""
    return spandedup.deduplicate(_table(spark, sf_dir, "documents")).select("doc_id", "n_sentences", "n_removed", "removed", "cut_words", "text")


def op8_tool_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages in canonical JSON with linked and validated tool calls."""
    return toolchat.link(_table(spark, sf_dir, "conversations"), toolchat.tool_table(spark))


def op9_shingle_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose word triples overlap by 90 %."""
    return jaccard.join(_table(spark, sf_dir, "documents"))


def op10_piecewise_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of documents and of edited documents, and their likeness."""
    return piecewise.with_next(_table(spark, sf_dir, "documents"))


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mail and network addresses, card and phone numbers, disguised ones too."""
    return pii.digest(_table(spark, sf_dir, "documents"))


def op12_whitened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings on the first four components, with unit variance."""
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of two to five words of each language."""
    return collocations.mine(_table(spark, sf_dir, "documents"))


def with_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations whose assistant texts are wrapped in five calls each, sound and unsound, and half of whose user texts are results."""
    text, turn, conv = toolchat._text("text"), F.col("turn").cast("string"), F.col("conv_id").cast("string")
    within = F.concat(F.lit('"filter":{"field":"title","within":[{"from":'), turn, F.lit(',"to":null}]}'))
    bodies = [
        ("search", F.concat(F.lit('{"query":'), text, F.lit(',"limit":'), turn, F.lit(","), within, F.lit("}"))),
        ("fetch", F.concat(F.lit('{"timeout":'), (F.col("turn") - 2).cast("string"), F.lit(',"headers":{"a":'), conv, F.lit("}}"))),
        ("calculate", F.concat(F.lit('{"expression":'), text, F.lit(',"digits":'), (F.col("turn") * 10).cast("string"), F.lit("}"))),
        ("lookup", F.lit('{"a":1}')),
        ("search", F.concat(F.lit('{"other":true,"query":'), turn, F.lit(',"filter":{"field":"nope"}}'))),
    ]
    calls = [F.concat(F.lit('<tool_call>{"id":"c'), turn, F.lit(f'_{k}","name":"{name}","arguments":'), body, F.lit("}</tool_call>")) for k, (name, body) in enumerate(bodies)]
    answer = (F.col("role") == "user") & ((F.col("conv_id") + F.col("turn")) % 2 == 0)
    result = F.concat(F.lit('{"tool_call_id":"c'), (F.col("turn") - 1).cast("string"), F.lit("_"), (F.col("conv_id") % 5).cast("string"), F.lit('","content":'), text, F.lit("}"))
    said = F.when(F.col("role") == "assistant", F.concat(F.lit("see "), *calls)).when(answer, result).otherwise(F.col("text"))
    rows = _table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", F.when(answer, "tool").otherwise(F.col("role")).alias("role"), said.alias("text"))


def tool_calls_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 8 on conversations with calls and results."""
    return toolchat.link(with_calls(spark, sf_dir), toolchat.tool_table(spark))


def pii_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plain patterns' numbers of spans."""
    return pii.digest(_table(spark, sf_dir, "documents")).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of the source mix no draw decides: sizes and targets."""
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"))


def fingerprint_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edited texts that fingerprints are compared on."""
    return piecewise.with_next(_table(spark, sf_dir, "documents")).select("doc_id", "n_chars", "edited_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_scores": op1_quality_scores,
    "op2_source_mix": op2_source_mix,
    "op3_benchmark_hits": op3_benchmark_hits,
    "op4_piece_counts": op4_piece_counts,
    "op5_main_text": op5_main_text,
    "op6_id_planes": op6_id_planes,
    "op7_span_dedup": op7_span_dedup,
    "op8_tool_chat": op8_tool_chat,
    "op9_shingle_components": op9_shingle_components,
    "op10_piecewise_fingerprints": op10_piecewise_fingerprints,
    "op11_personal_data": op11_personal_data,
    "op12_whitened": op12_whitened,
    "op13_phrase_collocations": op13_phrase_collocations,
    "tool_calls_linked": tool_calls_linked,
    "pii_counts": pii_counts,
    "mix_targets": mix_targets,
    "fingerprint_edits": fingerprint_edits,
}

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL: dict[str, str] = {
    "op3_benchmark_hits": f"""
with d as (select doc_id, {_WORDS} as ws from documents),
b as (select item_id, {_WORDS} as ws from benchmark),
bw as (select distinct item_id, k, array_to_string(ws[i : i + k - 1], ' ') as win
       from (select item_id, ws, k, unnest(range(1, len(ws) - k + 2)) as i
             from (select item_id, ws, least(len(ws), 10) as k from b where len(ws) > 0))),
dw as (select doc_id, k, i, array_to_string(ws[i : i + k - 1], ' ') as win
       from (select doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) as i
             from d, (select distinct k from bw) where len(ws) >= k)),
m as (select dw.doc_id, dw.i, dw.k, bw.item_id from dw join bw on dw.win = bw.win and dw.k = bw.k),
hit as (select doc_id, count(distinct p) as n_hit
        from (select doc_id, unnest(range(i, i + k)) as p from m) group by doc_id),
it as (select doc_id, count(*) as n_items, sha256(string_agg(item, ',' order by item)) as items_sha256
       from (select distinct doc_id, cast(item_id as varchar) as item from m) group by doc_id)
select d.doc_id, cast(len(d.ws) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       coalesce(items_sha256, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit using (doc_id) left join it using (doc_id)
""",
    "op9_shingle_components": f"""
with recursive w as (select doc_id, regexp_extract_all({_LOWERED}, '[^\x20\x09-\x0D]+') as ws from documents),
s as (select distinct doc_id, array_to_string(ws[i : i + 2], ' ') as g
      from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) as i from w where len(ws) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
l as (select x.doc_id as a, y.doc_id as b from s x join s y on x.g = y.g and x.doc_id <> y.doc_id
      join n nx on nx.doc_id = x.doc_id join n ny on ny.doc_id = y.doc_id
      group by x.doc_id, y.doc_id, nx.n, ny.n having 100 * count(*) >= 90 * (nx.n + ny.n - count(*))),
r(doc_id, other) as (select doc_id, doc_id from w union select r.doc_id, l.b from r join l on l.a = r.other)
select w.doc_id, coalesce(n.n, 0) as n_shingles, c.component_id
from w left join n using (doc_id) join (select doc_id, min(other) as component_id from r group by doc_id) c using (doc_id)
""",
    "op13_phrase_collocations": rf"""
with p as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array({_LOWERED}, '[.,;:!?\x0A-\x0D]')) as piece from documents),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as ws from p),
n as (select lang, cast(sum(len(ws)) as bigint) as n from w group by lang),
g as (select lang, k, array_to_string(ws[i : i + k - 1], ' ') as phrase, count(*) as f
      from (select lang, ws, k, unnest(range(1, len(ws) - k + 2)) as i from w, (select unnest(range(1, 6)) as k) where len(ws) >= k)
      group by lang, k, phrase having count(*) >= 100),
c as (select lang, k, phrase, f as a, string_split(phrase, ' ') as ws from g where k > 1),
cut as (select c.lang, c.k, c.phrase, c.a, x.f as l, y.f as r, n.n, j, (1000::hugeint * c.a * n.n) // (x.f::hugeint * y.f) as score
        from (select *, unnest(range(1, k)) as j from c) c
        join g x on x.lang = c.lang and x.phrase = array_to_string(ws[1 : j], ' ')
        join g y on y.lang = c.lang and y.phrase = array_to_string(ws[j + 1 : c.k], ' ') join n on n.lang = c.lang),
best as (select *, row_number() over (partition by lang, phrase order by score, j) as best from cut),
inside as (select lang, array_to_string(ws[i : i + m - 1], ' ') as phrase, max(a) as a
           from (select *, unnest(range(1, k - m + 2)) as i from (select *, unnest(range(2, k)) as m from c)) group by all),
kept as (select b.* from best b left join inside on inside.lang = b.lang and inside.phrase = b.phrase
         where b.best = 1 and (inside.a is null or 100 * inside.a < 100 * b.a)),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select lang, rank, phrase, a, l, r, n, cast(score as bigint) as score from ranked where rank <= 2000
""",
    "mix_targets": r"""
with w as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents),
s as (select source, sum(size)::bigint as source_size from w group by source),
r as (select *, row_number() over (order by source nulls last) - 1 as k, 2.0::double * source_size as cap from s),
v as (select *, [5.0::double, 2.0, 1.0][k % 3 + 1] as weight from r),
l as (select *, (1.5 * sum(source_size) over () - coalesce(sum(cap) over (order by cap / weight, k rows between unbounded preceding and 1 preceding), 0))
       / sum(weight) over (order by cap / weight, k rows between current row and unbounded following) as level from v),
f as (select arg_min(level, cap / weight) as fill from l where cap / weight >= level)
select w.doc_id, w.size, l.source_size, round(least(l.cap, coalesce(f.fill * l.weight, l.cap)), 6) as target
from w join l on w.source is not distinct from l.source cross join f
""",
    "fingerprint_edits": """
with t as (select doc_id, coalesce(text, '') as t, length(coalesce(text, '')) as n, first_value(coalesce(text, '')) over (order by doc_id desc) as top,
                  lead(coalesce(text, '')) over (order by doc_id desc) as below from documents)
select doc_id, n as n_chars, sha256(left(t, n - n // 2) || left(coalesce(below, top), n // 2)) as edited_sha256 from t
""",
    "tool_calls_linked": """
with m as (select conv_id, turn, role as was, case when role = 'user' and (conv_id + turn) % 2 = 0 then 'tool' else role end as role, text, cast(to_json(text) as varchar) as j from conversations),
c as (select *, '{"content":"see","role":"assistant","tool_calls":['
       || '{"arguments":{"filter":{"field":"title","within":[{"from":' || turn || ',"to":null}]},"limit":' || turn || ',"query":' || j || '},"errors":[],"id":"c' || turn || '_0","name":"search","valid":true},'
       || '{"arguments":{"headers":{"a":' || conv_id || '},"timeout":' || (turn - 2) || '},"errors":["missing url"' || case when turn < 2 then ',"range timeout"' else '' end || '],"id":"c' || turn || '_1","name":"fetch","valid":false},'
       || '{"arguments":{"digits":' || (turn * 10) || ',"expression":' || j || '},"errors":[' || case when turn > 4 then '"range digits"' else '' end || '],"id":"c' || turn || '_2","name":"calculate","valid":' || (turn <= 4) || '},'
       || '{"arguments":{"a":1},"errors":["no such tool"],"id":"c' || turn || '_3","name":"lookup","valid":false},'
       || '{"arguments":{"filter":{"field":"nope"},"other":true,"query":' || turn || '},"errors":["unknown other","type query","enum filter.field"],"id":"c' || turn || '_4","name":"search","valid":false}]}' as line,
       2 - (turn > 4)::int as n_valid from m where role = 'assistant')
select conv_id, turn, role, 'call' as state, null as call_id, null as call_turn, turn as order_turn, 0 as order_phase, 0 as order_call, 5 as n_calls, n_valid, line from c
union all
select a.conv_id, a.turn, 'tool', case when c.turn is null then 'orphan' else 'result' end, 'c' || (a.turn - 1) || '_' || (a.conv_id % 5), c.turn, a.turn, 0,
       case when c.turn is null then 0 else a.conv_id % 5 end, 0, 0, '{"content":' || a.j || ',"role":"tool","tool_call_id":"c' || (a.turn - 1) || '_' || (a.conv_id % 5) || '"}'
from m a left join c on c.conv_id = a.conv_id and c.turn = a.turn - 1 where a.role = 'tool'
union all
select conv_id, turn, role, 'plain', null, null, turn, 0, 0, 0, 0, '{"content":' || j || ',"role":"' || role || '"}' from m where role not in ('assistant', 'tool')
""",
    "pii_counts": r"""
with t as (select doc_id, coalesce(text, '') as t from documents),
f as (select doc_id,
        len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')) as n_email,
        len(list_filter(regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), lambda m: list_max(list_transform(string_split(m, '.'), lambda p: try_cast(p as hugeint))) <= 255)) as n_ip,
        list_filter(list_transform(regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+'), lambda m: reverse(regexp_replace(m, '[^0-9]', '', 'g'))), lambda d: length(d) between 16 and 19) as cards,
        len(list_filter(regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), lambda m: length(regexp_replace(m, '[^0-9]', '', 'g')) between 8 and 15)) as n_phone
      from t)
select doc_id, n_email, n_ip,
       len(list_filter(cards, lambda d: list_sum(list_transform(range(1, length(d) + 1), lambda i: [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 0, 2, 4, 6, 8, 1, 3, 5, 7, 9][1 + 10 * ((i + 1) % 2) + substr(d, i, 1)::int])) % 10 = 0)) as n_card, n_phone
from f
""",
    # Rows with calls or results would be missing here; the given tables have none.
    "op8_tool_chat": """
select conv_id, turn, role, 'plain' as state, cast(null as varchar) as call_id, cast(null as bigint) as call_turn, turn as order_turn,
       0 as order_phase, 0 as order_call, 0 as n_calls, 0 as n_valid,
       '{"content":' || coalesce(cast(to_json(text) as varchar), 'null') || ',"role":' || coalesce(cast(to_json(role) as varchar), 'null') || '}' as line
from conversations
where role is distinct from 'tool' and not coalesce(role = 'assistant' and contains(text, '<tool_call>'), false)
""",
}
