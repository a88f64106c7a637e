"""Queries that apply each corpus operator to its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.llm import ann, conversations, language, linedup, mixing, neardup, packing, quality, resampling, secrets, surrogates, telephony, tokencount
from tarnwell.llm.common import table

#: Key of the surrogates of op9; a parameter of the operator, kept apart from the data in production.
SURROGATE_KEY = surrogates.key_from("tarnwell example key")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"))
    label = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    joined = lambda spans: F.array_join(F.transform(spans, label), ",")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined("spans").alias("spans"),
    )


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", "text")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), width=4)


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), k=5, every=50)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"))


def op7_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = telephony.encode_media(table(spark, sf_dir, "documents"))
    return telephony.media_digests(telephony.decode_media(media))


def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replace(table(spark, sf_dir, "documents"), SURROGATE_KEY)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.where(~language.held_out(F.col("doc_id"))).select("text", "lang"))
    found = language.identify(docs, model)
    return found.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return conversations.digests(conversations.damage(rows), rows)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    ops = (op1_secrets, op2_mix, op3_line_dedup, op4_near_dedup, op5_nearest, op6_quality, op7_telephony, op8_pack, op9_surrogates, op10_token_counts, op11_resample, op12_language, op13_repair, pipeline)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": LINE_DEDUP_SQL, "op4_near_dedup": NEAR_DEDUP_SQL, "op5_nearest": NEAREST_SQL, "op11_resample": RESAMPLE_SQL, "op13_repair": REPAIR_SQL}


#: Exact classes of lines, pairs that share a half (as any two lines within one edit do), and their edit distance.
LINE_DEDUP_SQL = r"""
with lines as (
  select doc_id, no, line, lower(trim(line)) as n from (
    select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as no from documents)
), big as (select * from lines where regexp_matches(n, '\S')),
first as (select n, min(struct_pack(d := doc_id, i := no)) as pos from big group by n),
halves as (
  select n, pos, unnest(list_distinct([
    'h' || left(n, length(n) // 2), 't' || right(n, length(n) // 2),
    'h' || left(n, (length(n) - 1) // 2), 't' || right(n, (length(n) - 1) // 2)])) as half from first where length(n) >= 10
), near as (
  select distinct b.n from halves a join halves b on a.half = b.half and a.pos < b.pos
  where abs(length(a.n) - length(b.n)) <= 1 and levenshtein(a.n, b.n) <= 1
), marked as (
  select l.doc_id, l.no, l.line,
    regexp_matches(l.n, '\S') and (x.n is not null or f.pos <> struct_pack(d := l.doc_id, i := l.no)) as gone
  from lines l left join first f on l.n = f.n left join near x on l.n = x.n
)
select doc_id, count(*) as n_lines, cast(sum(case when coalesce(gone, false) then 1 else 0 end) as bigint) as n_dropped,
  coalesce(string_agg(line, chr(10) order by no) filter (where not coalesce(gone, false)), '') as text
from marked group by doc_id
"""

#: Exact shingle sets (equal ones are one class), all pairs that share a shingle, and the closure of their links.
NEAR_DEDUP_SQL = r"""
with recursive split as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), sets as (
  select doc_id, case when coalesce(len(w), 0) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
    else list_sort(list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')))) end as s from split
), classes as (select s, min(doc_id) as rep from sets where len(s) > 0 group by s),
shingle as (select rep, len(s) as n, unnest(s) as g from classes),
pairs as (
  select a.rep as a, b.rep as b from shingle a join shingle b on a.g = b.g and a.rep < b.rep and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  group by a.rep, b.rep, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))
), edges as (select a, b from pairs union all select b, a from pairs),
reach(node, root) as (select rep, rep from classes union select e.b, r.root from reach r join edges e on e.a = r.node),
roots as (select node, min(root) as root from reach group by node)
select d.doc_id, cast(len(d.s) as bigint) as n_shingles, coalesce(r.root, d.doc_id) as component_id, coalesce(r.root, d.doc_id) = d.doc_id as kept
from sets d left join classes c on c.s = d.s left join roots r on r.node = c.rep
"""

#: All cosines in double precision, sums from the first component to the last.
NEAREST_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings
), usable as (
  select vec_id, e, sqrt(list_reduce(list_transform(e, lambda x: x * x), lambda x, y: x + y)) as norm from v
  where len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0
), scored as (
  select q.vec_id as query_id, c.vec_id, list_reduce(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]), lambda x, y: x + y) / (c.norm * q.norm) as score
  from usable q join usable c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id
), ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored)
select query_id, cast(rank as integer) as rank, vec_id, score from ranked where rank <= 5
"""

#: A CRC-32 by bytes, from a table of 256 that is made by its rule: ``t`` is the table.
_CRC_TABLE = "select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, z: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end)) as t"
_CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(range(0, length(h), 2), lambda i: ('0x' || substr(h, i + 1, 2))::bigint)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"

#: Words of both tables, totals by bucket, gains, scores and ranks.
RESAMPLE_SQL = rf"""
with crc as ({_CRC_TABLE}),
own as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
goal as (select regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
counted as (select r, w, count(*) as k from (select r, unnest(w) as w from own) group by r, w),
source as (select w, sum(k) as k from counted group by w),
target as (select w, count(*) as k from (select unnest(w) as w from goal) group by w),
words as (select w, {_CRC} % 10000 as bucket from (select w, hex(encode(w)) as h from (select w from source union select w from target)), crc),
s as (select bucket, cast(sum(k) as double) as s from source join words using (w) group by bucket),
t as (select bucket, cast(sum(k) as double) as t from target join words using (w) group by bucket),
sums as (select coalesce((select sum(s) from s), 0) + 10000 as s_all, coalesce((select sum(t) from t), 0) + 10000 as t_all),
gain as (select s.bucket, cast(floor(1000 * ln((coalesce(t, 0) + 1) * s_all / ((s + 1) * t_all))) as bigint) as gain from s left join t using (bucket), sums),
weighed as (select r, cast(sum(k * gain) as bigint) as weight from counted join words using (w) join gain using (bucket) group by r),
scored as (
  select own.r, doc_id, cast(len(w) as bigint) as n_features, coalesce(weight, 0) as weight,
    coalesce(weight, 0) + cast(floor(-1000 * ln(-ln((('0x' || left(sha256('2024:' || coalesce(doc_id::varchar, '')), 8))::bigint + 0.5::double) / 4294967296::double))) as bigint) as score
  from own left join weighed on own.r = weighed.r
), placed as (select *, row_number() over (order by score desc, doc_id nulls last, n_features, weight) as place, 10 * count(*) over () // 100 as drawn from scored where n_features >= 20)
select scored.doc_id, scored.n_features, scored.weight, scored.score, case when place <= drawn then place end as rank from scored left join placed on scored.r = placed.r
"""

_BEST = "list_sort([{}])[1]"


def _then(state: str, cost: str, letters: str, said: str = "''") -> str:
    return f"struct_pack(c := {state}.c + {cost}, a := {state}.a || '{letters}', t := {state}.t || {said})"


def _said(role: str, text: str) -> str:
    return f"chr(10) || {role} || ':' || {text}"


_USER, _ASSISTANT = _said("'user'", "''"), _said("'assistant'", "''")
_INSERTED = f"""e, s,
  {_BEST.format(', '.join(['u', _then('e', '3', 'I', _USER), _then('s', '3', 'I', _USER), _then('a', '3', 'I', _USER)]))} as u,
  {_BEST.format(', '.join(['a', _then('u', '3', 'I', _ASSISTANT), _then('e', '6', 'II', _USER + ' || ' + _ASSISTANT), _then('s', '6', 'II', _USER + ' || ' + _ASSISTANT)]))} as a"""


def _keep(state: str, when: str, cost: str, letter: str, role: str) -> str:
    return f"case when {when} then {_then(state, cost + ' + more', letter, _said(role, 'text'))} else never end"


_FREE, _OWN = "fault not in ('blank', 'duplicate')", "role"

#: Damage, faults, and the cheapest edits row by row: the best of each state before, as cost, audit and what it says.
REPAIR_SQL = rf"""
with recursive crc as ({_CRC_TABLE}),
plain as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, hex(encode(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '))) as h from conversations),
drawn as (select plain.*, {_CRC} % 20 as op from plain, crc),
damaged as (
  select conv_id, turn, case op when 4 then 'user' else role end as role, case op when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from drawn, range(case op when 0 then 0 when 3 then 2 else 1 end)
), ordered as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i, 
    lag(left(role, 1)) over (partition by conv_id order by turn nulls first, role, text) as before, left(role, 1) as initial, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as visible
  from damaged
), faults as (
  select *, row_number() over (partition by conv_id, role, text order by i) as seen, case when visible = '' then 'blank' when seen > 1 then 'duplicate' when right(visible, 1) not in ('.', '!', '?') then 'truncated' else '' end as fault from ordered
), counts as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
    count(*) filter (fault = 'truncated') as truncated, count(*) filter (i > 1 and before || initial not in ('su', 'ua', 'au')) as illegal from faults group by conv_id
), steps as (
  select *, case fault when 'truncated' then 3 else 0 end as more, struct_pack(c := 1000000000::bigint, a := '', t := '') as never from faults
), best as (
  select conv_id, 0::bigint as i, struct_pack(c := 0::bigint, a := '', t := '') as e, x as s, x as u, x as a
  from (select distinct conv_id, struct_pack(c := 1000000000::bigint, a := '', t := '') as x from conversations)
  union all
  select conv_id, i, {_then('e', '4', 'D')} as e,
    {_BEST.format(', '.join([_then('s', '4', 'D'), _keep('e', _FREE + " and initial = 's'", '0', 'K', _OWN)]))} as s,
    {_BEST.format(', '.join([_then('u', '4', 'D'), *[_keep(x, _FREE + " and initial = 'u'", '0', 'K', _OWN) for x in 'esa'], *[_keep(x, _FREE, '3', 'R', "'user'") for x in 'esa']]))} as u,
    {_BEST.format(', '.join([_then('a', '4', 'D'), _keep('u', _FREE + " and initial = 'a'", '0', 'K', _OWN), _keep('u', _FREE, '3', 'R', "'assistant'")]))} as a
  from (select steps.*, {', '.join(f'b.{x}' for x in 'esua')} from (select conv_id, i, {_INSERTED} from best) b join steps on steps.conv_id is not distinct from b.conv_id and steps.i = b.i + 1)
), ends as (
  select conv_id, {_BEST.format('e, a')} as z from (select conv_id, i, {_INSERTED} from best) qualify i = max(i) over (partition by conv_id)
)
select ends.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
  z.c as cost, z.a as audit, sha256(substr(z.t, 2)) as repaired_sha256
from ends left join counts on counts.conv_id is not distinct from ends.conv_id
"""
