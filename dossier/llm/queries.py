"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversation_repair, exact_dedup, language_id, lm_score, merkle, mixing, near_dedup, packing, secret_scan, token_counts, topk_search, vector_dedup, warc
from .common import new_path, table

WORD_BPE, PIECES = "word_bpe_49k.json", "piece_bpe_32k.model"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def crc_mod(n: int, id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents"), crc_mod(5) == 1).withColumnRenamed("id", "doc_id")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias("n_" + kind)
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    base = F.filter("spans", lambda s: s.kind.isin([r.kind for r in secret_scan.BASE_RULES]))
    return found.select(F.col("id").alias("doc_id"), count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = exact_dedup.DigestIndex(spark, new_path(spark, "digest-index"))
    found = exact_dedup.deduplicate(table(spark, sf_dir, "documents"), index)
    index.forget()
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP3_SQL = r"""
with d as (select doc_id, text, length(coalesce(text, '')) as n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as h from documents),
k as (select doc_id, h, row_number() over (partition by h order by n desc, doc_id) as r, count(*) over (partition by h) as group_size,
        first_value(doc_id) over (partition by h order by n desc, doc_id) as keep_id from d)
select doc_id, keep_id, cast(group_size as bigint) as group_size, r = 1 as kept, h as text_sha256 from k
"""


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.classes(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "class_id", "class_size", "links", F.col("id").eqNullSafe(F.col("class_id")).alias("kept"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = token_counts.Vocabulary.from_sentencepiece(tokenizer_path(PIECES))
    return token_counts.count(table(spark, sf_dir, "documents"), vocabulary).withColumnRenamed("id", "doc_id")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learned = language_id.learn(docs, crc_mod(4) != 2)
    found = language_id.classify(docs.select("doc_id", "text"), learned)
    return found.select(F.col("id").alias("doc_id"), (crc_mod(4, "id") == 2).alias("held_out"), "lang_pred", "score", "rejected")


def op7_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.search(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


OP7_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as (select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) as bigint) as score
  from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id),
r as (select query_id, row_number() over (partition by query_id order by score desc, vec_id) as rank, vec_id, score from p)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 5
"""


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = packing.pieces(table(spark, sf_dir, "documents"), tokenizer_path(WORD_BPE))
    return packing.pack(cut).withColumnRenamed("id", "doc_id")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.archive_folder(spark)
    index = warc.write(table(spark, sf_dir, "pages"), folder)
    return warc.read(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def _mixing_sql(rounds: int = mixing.ROUNDS) -> str:
    """Raking written out round by round."""
    steps, last = [], "c0"
    for k in range(rounds):
        for d in mixing.DIMENSIONS:
            name = f"r{k}_{d}"
            steps.append(f"{name} as materialized (select * replace (case when sum(w) over (partition by {d}) > 0 then w * t_{d} / sum(w) over (partition by {d}) else 0 end as w) from {last})")
            last = name
    target = lambda d: f"(select sum(pow(cast(s as double), {mixing.TEMPER})) from (select sum(tokens) as s from c group by {d}))"
    targets = ", ".join(f"pow(cast(sum(tokens) over (partition by {d}) as double), {mixing.TEMPER}) / {target(d)} as t_{d}" for d in mixing.DIMENSIONS)
    return rf"""
with d as (select doc_id, coalesce(source, '(null)') as source, coalesce(lang, '(null)') as lang, coalesce(text, '') as text from documents),
f as (select doc_id, source, lang, case when not regexp_matches(text, '[\p{{L}}\p{{N}}|;]') then 'blank' when len(regexp_extract_all(text, '[\p{{N}}|\t;]')) * {mixing.FIGURES} >= length(text) then 'data'
  when len(regexp_extract_all(text, '\p{{Lu}}')) * 3 >= length(text) then 'shout' when length(text) < {mixing.SHORT} then 'short' when length(text) > {mixing.LONG} then 'long' else 'prose' end as topic,
  cast(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as bigint) as n_tokens from d),
c as (select source, lang, topic, cast(sum(n_tokens) as bigint) as tokens from f group by all),
c0 as (select *, cast(tokens as double) as w, {targets} from c),
{", ".join(steps)},
p as (select source, lang, topic, round(w, 9) as weight, case when tokens > 0 then w / (tokens / (select sum(tokens) from c)) else 0 end as ratio from {last})
select f.doc_id, f.source, f.lang, f.topic, f.n_tokens, p.weight, round(p.ratio / (select max(ratio) from p), 9) as probability,
  cast(('0x' || substr(md5('{mixing.SALT}' || cast(f.doc_id as varchar)), 1, 12)) as bigint) / 281474976710656.0 < round(p.ratio / (select max(ratio) from p), 9) as sampled
from f join p using (source, lang, topic)
"""


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    found = conversation_repair.summaries(conversation_repair.damaged(rows))
    every = rows.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    told = every.join(found, every["conv_id"].eqNullSafe(found["conv"]), "left")
    return told.select("conv_id", *map(count, conversation_repair.COUNTS), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(conversation_repair.NOTHING_SHA256)).alias("repaired_sha256"))


def _repair_sql() -> str:
    """The dynamic programme as a recursion from the last row of every conversation to the first.

    The best of a state is one text: cost (8 digits), edits, a separator and the repaired turns, so the least text is the least cost and the ASCII-least edits.
    """
    space, joint = r"[\x20\x09-\x0D]", "chr(1)"
    told = lambda c: f"coalesce({c}::varchar, ' ')"
    # before(x, cost, letter, turn): one edit in front of x
    before = lambda x, cost, letter, turn: f"printf('%08d', substr({x}, 1, 8)::int + {cost}) || '{letter}' || split_part(substr({x}, 9), {joint}, 1) || {joint} || {turn} || split_part({x}, {joint}, 2)"
    turn = lambda role, text: f"chr(10) || {role} || ':' || {text}"
    follows = {"n": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    goes, role = {"n": "u", "s": "u", "u": "a", "a": "u"}, {"n": "user", "s": "user", "u": "assistant", "a": "user"}
    extra = "(case when f = 3 then 3 else 0 end)"
    base = []
    for q in "nsua":
        # texts greater than every other one where an edit isn't possible
        keep = " ".join(f"when '{i}' then {before(f'b.{to}', extra, 'K', turn('e.role', 'e.text'))}" for i, to in follows[q].items())
        keep = f"case when f in (1, 2) then '~' else case e.initial {keep} when '' then {before(f'b.{q}', extra, 'K', turn('e.role', 'e.text'))} else '~' end end"
        rerole = f"case when f in (1, 2) then '~' else {before(f'b.{goes[q]}', '3 + ' + extra, 'R', turn(f"'{role[q]}'", 'e.text'))} end"
        base.append(f"least({before(f'b.{q}', 4, 'D', "''")}, {keep}, {rerole}) as {q}")
    insert = lambda x, q: before(x, 3, "I", turn(f"'{role[q]}'", "''"))
    close = lambda n, s, u, a: (
        f"select * replace (least({n}, {insert(f'least({u}, {insert(a, "u")})', 'n')}) as n, least({s}, {insert(f'least({u}, {insert(a, "u")})', 's')}) as s, least({u}, {insert(a, 'u')}) as u, least({a}, {insert(u, 'a')}) as a)"
    )
    return rf"""
with recursive k as (select *, {_crc32_sql(f"{told('conv_id')} || ':' || {told('turn')}")} % 20 as kind from conversations),
d as (select conv_id, turn, case when kind = 4 then 'user' else {told('role')} end as role, case kind when 1 then '' when 2 then translate({told('text')}, '.!?', '') else {told('text')} end as text, unnest(range(case when kind = 3 then 2 else 1 end)) as nth from k where kind <> 0),
o as (select conv_id, turn, role, text, substr(role, 1, 1) as initial, row_number() over (partition by conv_id order by turn nulls first, role, text) as i from d),
m as (select *, row_number() over (partition by conv_id, role, text order by i) as same from o),
e as materialized (select *, case when not regexp_matches(text, '[^ 	-
]') then 1 when same > 1 then 2 when not regexp_matches(text, '[.!?]{space}*$') then 3 else 0 end as f from m),
p as (select conv_id, count(*) filter (i > 1 and not pair in ('su', 'ua', 'au')) as illegal from (select conv_id, i, lag(initial) over (partition by conv_id order by i) || initial as pair from e) group by conv_id),
c as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (f = 1) as blank, count(*) filter (f = 2) as duplicate, count(*) filter (f = 3) as truncated, max(i) as last from e group by conv_id),
r as (
  select conv_id, last as i, '00000000' || {joint} as n, '00000006II' || {joint} || {turn("'user'", "''")} || {turn("'assistant'", "''")} as s, '00000003I' || {joint} || {turn("'assistant'", "''")} as u, '00000000' || {joint} as a from c
  union all
  {close("n", "s", "u", "a")} from (select b.conv_id, b.i - 1 as i, {", ".join(base)} from r b join e on e.conv_id is not distinct from b.conv_id and e.i = b.i)),
w as (select c.*, illegal, r.n from r join c on c.conv_id is not distinct from r.conv_id and r.i = 0 join p on p.conv_id is not distinct from r.conv_id)
select v.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(substr(n, 1, 8)::bigint, 0) as cost,
  coalesce(split_part(substr(n, 9), {joint}, 1), '') as audit, sha256(coalesce(substr(split_part(n, {joint}, 2), 2), '')) as repaired_sha256
from (select distinct conv_id from conversations) v left join w on w.conv_id is not distinct from v.conv_id
"""


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.classes(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


OP12_SQL = f"""
with recursive e as (select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
p as materialized (select a.vec_id as x, b.vec_id as y from e a join e b on a.label = b.label and a.vec_id <> b.vec_id where list_cosine_similarity(a.v, b.v) >= {vector_dedup.COSINE}),
r(x, y) as (select vec_id, vec_id from e union select r.x, p.y from r join p on p.x = r.y),
c as (select x, min(y) as component_id from r group by x), n as (select x, count(*) as n_links from p group by x)
select vec_id, coalesce(n_links, 0) as n_links, coalesce(component_id, vec_id) as component_id, coalesce(component_id, vec_id) = vec_id as kept
from embeddings left join c on c.x = vec_id left join n on n.x = vec_id
"""


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    lower = F.translate(F.col("text"), ascii_uppercase, ascii_lowercase)
    found = merkle.manifest(table(spark, sf_dir, "documents"), {"text": F.when(crc_mod(5) == 0, lower).otherwise(F.col("text"))})
    return found.withColumnRenamed("id", "doc_id")


def _crc32_sql(text: str) -> str:
    """Unsigned crc32 of an ASCII text, bit by bit."""
    bits = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(list_reduce([4294967295::bigint] || list_transform(string_split({text}, ''), lambda c: ascii(c)::bigint), lambda c, b: {bits}), 4294967295)"


def _merkle_sql(deep: int = 7, wide: int = 5) -> str:
    """The levels written out: sources of at most 16^deep documents, at most 16^wide sources."""
    told = lambda c: f"coalesce(strlen({c}::varchar)::varchar || ':' || {c}::varchar, '-')"
    head = " || ".join(told(c) for c in ("doc_id", "source", "lang", "n_chars"))
    crc = _crc32_sql("doc_id::varchar")
    steps = [
        f"""h as (select doc_id, source, sha256({head} || {told("text")}) as leaf,
  case when coalesce({crc}, 0) % 5 = 0 then sha256({head} || {told(f"translate(text, '{ascii_uppercase}', '{ascii_lowercase}')")}) end as other from documents)""",
        """l0 as materialized (select dense_rank() over (order by source nulls first) - 1 as t, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as p,
  count(*) over (partition by source) as n, leaf as h, doc_id, coalesce(other, leaf) as other from h)""",
    ]
    up = "as materialized (select t, p // 16 as p, any_value((n + 15) // 16) as n, string_agg(h, '' order by p) as run, sha256(string_agg(h, '' order by p)) as h from {} where n > 1 group by t, p // 16)"
    steps += [f"l{k + 1} {up.format(f'l{k}')}" for k in range(deep)]
    steps.append("s as materialized (" + " union all ".join(f"select t, h from l{k} where n = 1" for k in range(deep + 1)) + ")")
    steps.append("t0 as (select 0 as t, t as p, (select count(*) from s) as n, h from s)")
    steps += [f"t{k + 1} {up.format(f't{k}')}" for k in range(wide)]
    steps.append("r as (" + " union all ".join(f"select h as root from t{k} where n = 1" for k in range(wide + 1)) + ")")
    steps.append("w as (select doc_id, h as leaf, t as tree, t, p, n, other as cur, '' as proof from l0)")
    last = "w"
    for level in [*[f"l{k + 1}" for k in range(deep)], "", *[f"t{k + 1}" for k in range(wide)]]:
        if not level:
            steps.append(f"w_top as (select * replace (0 as t, t as p, (select count(*) from s) as n) from {last})")
            last = "w_top"
            continue
        left, right = "substr(u.run, 1, 64 * (w.p % 16))", "substr(u.run, 64 * (w.p % 16) + 65)"
        steps.append(f"""w_{level} as (select w.* replace (w.p // 16 as p, (w.n + 15) // 16 as n, case when u.run is null then cur else sha256({left} || cur || {right}) end as cur,
  case when u.run is null then proof else proof || {left} || {right} end as proof) from {last} w left join {level} u on u.t = w.t and u.p = w.p // 16 and w.n > 1)""")
        last = f"w_{level}"
    return f"with {', '.join(steps)}\nselect doc_id, leaf, s.h as subroot, root, sha256(proof) as proof_sha256, cur as folded_root, cur = root as verified from {last} join s on s.t = tree cross join r"


def queries() -> dict:
    return {f.__name__: f for f in (op1_lm_score, op2_secret_scan, op3_exact_dedup, op4_minhash_dedup, op5_token_counts, op6_language_id, op7_topk_search, op8_packing, op9_warc, op10_source_mixing, op11_conversation_repair, op12_embedding_dedup, op13_merkle_manifest)}


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_dedup": OP3_SQL, "op7_topk_search": OP7_SQL, "op10_source_mixing": _mixing_sql(), "op11_conversation_repair": _repair_sql(), "op12_embedding_dedup": OP12_SQL, "op13_merkle_manifest": _merkle_sql()}
