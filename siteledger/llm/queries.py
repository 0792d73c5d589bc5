"""Queries of this subpackage: thin wrappers over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siteledger.llm import packing

    return packing.digest(packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=1))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siteledger.llm import spm

    out = spm.encode(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))
    return out.select("doc_id", "n_ids", F.crc32("ids").alias("ids_crc32"), F.octet_length("text_back").cast("long").alias("bytes_back"), "round_trip", "parity")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siteledger.llm import quality

    docs = table(spark, sf_dir, "documents")
    return quality.apply(docs, quality.train(docs, table(spark, sf_dir, "labels")), ["doc_id"]).select("row.doc_id", *[c.split()[0] for c in quality.COLUMNS.split(", ")])


#: Where the surrogates' secret key is set, and the public one of tests and examples.
PII_SETTING, EXAMPLE_KEY = "spark.siteledger.pii.key", "not secret"


def pii_key(spark: SparkSession) -> str:
    return spark.conf.get(PII_SETTING, None) or EXAMPLE_KEY


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siteledger.llm import pii

    return pii.replace(table(spark, sf_dir, "documents"), pii_key(spark)).select("doc_id", "text", "n_entities", "entity_types")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siteledger.llm import warc

    back = warc.round_trip(table(spark, sf_dir, "pages"), min_bytes=0)
    # digest and length of a response come from the bytes that were read, a revisit's from its record
    body = F.col("payload").isNotNull()
    return back.select(
        "page_id", F.when(body, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(body, warc.base32(F.sha1("payload"))).otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type", "refers_to", "intact",
    )


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siteledger.llm import langid

    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.train(docs), ["doc_id"]).select("row.doc_id", "lang_pred", "score")
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siteledger.llm import tokenfile

    back = tokenfile.round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=0, first=65536)
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"), "shard")


def op8_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siteledger.llm import annlinks

    return annlinks.links(table(spark, sf_dir, "embeddings"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siteledger.llm import minhash

    return minhash.classes(table(spark, sf_dir, "documents"))


def op10_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siteledger.llm import quotes

    return quotes.conversations(table(spark, sf_dir, "conversations"))


def damaged(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text: by a hash of a turn's number it is dropped, emptied, cut short, repeated or ascribed to the user, or stays."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    text = F.when(hit == 1, "").when(hit == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    rows = messages.select("conv_id", "turn", hit.alias("hit"), F.when(hit == 4, "user").otherwise(space("role")).alias("role"), text.alias("text")).where("hit <> 0")
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.expr("if(hit = 3, array(1, 2), array(1))")).alias("copy")).drop("copy")


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siteledger.llm import repair

    messages = table(spark, sf_dir, "conversations")
    report, turns = repair.repair(damaged(messages))
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    every = messages.select(F.struct("conv_id").alias("key")).distinct().join(report, "key", "left").join(repair.digests(turns), "key", "left")
    return every.select("key.conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siteledger.llm import merkle

    leaf = lambda n_chars: merkle.digest(F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text"))
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False))
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", "lang", leaf(F.col("n_chars")).alias("leaf"), F.when(tampered, leaf(F.col("n_chars") + 1)).alias("tampered"))
    found = merkle.manifest(rows, "lang", "doc_id", "leaf").withColumn("folded_root", merkle.folded(F.coalesce("tampered", "leaf"), F.col("proof")))
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("proof")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siteledger.llm import classifier
    from siteledger.llm.shared import cut

    known = cut(classifier.described(table(spark, sf_dir, "documents"), ["doc_id"]), "statistics")
    held_out = lambda c: F.coalesce(F.crc32(c.cast("string")) % 5 == 0, F.lit(False))
    own = F.col("row")["doc_id"]
    found = classifier.score(known, classifier.train(known, table(spark, sf_dir, "labels"), own, ~held_out(own)))
    return found.select("row.doc_id", held_out(own).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_packing": op1_packing, "op2_sentencepiece": op2_sentencepiece, "op3_quality": op3_quality, "op4_pii": op4_pii, "op5_warc": op5_warc, "op6_language": op6_language, "op7_token_output": op7_token_output, "op8_embedding_links": op8_embedding_links, "op9_near_duplicates": op9_near_duplicates, "op10_conversations": op10_conversations, "op11_repair": op11_repair, "op12_manifest": op12_manifest, "op13_quality_score": op13_quality_score, "pipeline": pipeline}


#: Links of good vectors by all pairs of a label; components by reach along links.
OP8_SQL = """
with recursive good as (select vec_id, label, embedding::double[] as v from embeddings where label is not null and embedding is not null and list_sum(list_transform(embedding, lambda x: x::double * x::double)) > 0),
links as (select a.vec_id as a, b.vec_id as b from good a join good b on a.label = b.label and a.vec_id <> b.vec_id and list_cosine_similarity(a.v, b.v) >= 0.98),
reach as (select vec_id as a, vec_id as b from embeddings union select r.a, l.b from reach r join links l on l.a = r.b),
comp as (select a, min(b) as component_id from reach group by 1)
select vec_id, (select count(*) from links where a = vec_id) as n_links, component_id, vec_id = component_id as kept from embeddings join comp on a = vec_id"""

OP5_SQL = """
with p as (select page_id, coalesce(html, '') as body from pages), d as (select page_id, strlen(body)::bigint as payload_bytes, sha1(body) as h, min(page_id) over (partition by body) as first_id from p)
select page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, (i // 4) * 5 + 1, 5))::bigint >> (15 - 5 * (i % 4))) & 31) + 1)::bigint, 1)), '') as payload_digest,
case when page_id > first_id then 'revisit' else 'response' end as record_type, case when page_id > first_id then first_id end as refers_to, true as intact from d"""


def crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of a text of ASCII characters, bit by bit."""
    byte = "list_reduce(list_prepend(xor(a, b), [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, strlen({text})::bigint + 1), lambda i: ascii(substr({text}, i, 1))::bigint)), lambda a, b: {byte}), 4294967295)"


def _field(c: str) -> str:
    return f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')"


#: Both forests level by level (tree 0: the subroots), then each document's siblings and the fold of its digest.
OP12_SQL = f"""
with recursive d as (select doc_id, lang, {" || ".join(map(_field, ("doc_id", "source", "lang", "n_chars", "text")))} as told, case when {crc32_sql("doc_id::varchar")} % 7 = 0 then {" || ".join(map(_field, ("doc_id", "source", "lang", "(n_chars + 1)", "text")))} end as other from documents),
leaves as (select doc_id, lang, sha256(told) as leaf, coalesce(sha256(other), sha256(told)) as given from d),
placed as (select *, dense_rank() over (order by lang nulls first) as tree, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as place, count(*) over (partition by lang) as n from leaves),
low as (select tree, 0 as level, place, leaf as h, n from placed union all
select tree, level + 1, place // 2, sha256(h || coalesce(next, '')), (n + 1) // 2 from (select *, lead(h) over (partition by tree order by place) as next from low where n > 1) where place % 2 = 0),
subs as (select tree, h from low where n = 1),
high as (select 0 as level, tree - 1 as place, h, (select count(*) from subs) as n from subs union all
select level + 1, place // 2, sha256(h || coalesce(next, '')), (n + 1) // 2 from (select *, lead(h) over (order by place) as next from high where n > 1) where place % 2 = 0),
way as (select p.tree, p.place, a.level as up, xor((p.place >> a.level), 1) as other, (p.place >> a.level) & 1 as mine from placed p join (select distinct tree, level from low where n > 1) a using (tree)
union all select p.tree, p.place, 1000 + a.level, xor(((p.tree - 1) >> a.level), 1), ((p.tree - 1) >> a.level) & 1 from placed p, (select distinct level from high where n > 1) a),
nodes as (select tree, level as up, place as other, h from low union all select t.tree, 1000 + level, place, h from high, (select distinct tree from placed) t),
proof as (select way.tree, way.place, list({{'mine': mine, 'h': coalesce(h, '')}} order by up) as steps from way left join nodes using (tree, up, other) group by all),
full_ as (select doc_id, leaf, given, subs.h as subroot, (select h from high where n = 1) as root, coalesce(steps, []) as steps from placed left join proof using (tree, place) join subs using (tree)),
done as (select *, list_reduce(list_prepend({{'mine': 0::bigint, 'h': given}}, list_transform(steps, lambda s: {{'mine': s.mine::bigint, 'h': s.h}})), lambda a, s: {{'mine': 0::bigint, 'h': case when s.mine = 1 then sha256(s.h || a.h) else sha256(a.h || s.h) end}}).h as folded_root from full_)
select doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(steps, lambda s: s.h), '')) as proof_sha256, folded_root, folded_root = root as verified from done"""


def _op11_sql() -> str:
    """One turn at a time: v0 to v3 are the least cost (ten digits) and audit that end in each state of the automaton."""
    add = lambda v, cost, letters: f"(lpad(((left({v}, 10))::bigint + {cost})::varchar, 10, '0') || substr({v}, 11) || '{letters}')"
    least = lambda *ways: f"least({', '.join(ways)})"
    c2, c3 = least("v2", add("v0", 2, "I"), add("v1", 2, "I"), add("v3", 2, "I")), least("v3", add("v2", 2, "I"), add("v0", 4, "II"), add("v1", 4, "II"))
    own = lambda v, more, letter: f"case when fault in ('none', 'truncated') then {add(v, f'({more} + (fault = {chr(39)}truncated{chr(39)})::int)', letter)} end"
    keep = lambda v, role: f"case when initial = '{role}' then {own(v, 0, 'K')} end"
    return f"""
with recursive hits as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {crc32_sql("(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '))")} % 20 as hit from conversations),
rows_ as (select conv_id, turn, case when hit = 4 then 'user' else role end as role, case when hit = 1 then '' when hit = 2 then translate(text, '.!?', '') else text end as text from hits, (values (1), (2)) t(copy) where hit <> 0 and (copy = 1 or hit = 3)),
numbered as (select *, row_number() over (partition by conv_id order by turn nulls first, role, sha256(text)) as position, right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) as last from rows_),
marked as (select *, left(role, 1) as initial, left(lag(role) over (partition by conv_id order by position), 1) || left(role, 1) as pair, count(*) over (partition by conv_id) as n,
case when last = '' then 'blank' when row_number() over (partition by conv_id, role, text order by position) > 1 then 'duplicate' when last not in ('.', '!', '?') then 'truncated' else 'none' end as fault from numbered),
counts as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated,
count(*) filter (position > 1 and pair not in ('su', 'ua', 'au')) as illegal from marked group by 1),
scan as (select conv_id, 0::bigint as position, max(n) as n, '0000000000' as v0, null::varchar as v1, null::varchar as v2, null::varchar as v3 from marked group by 1 union all
select s.conv_id, s.position + 1, s.n, {add("v0", 3, "D")}, {least(add("v1", 3, "D"), keep("v0", "s"))}, {least(add("c2", 3, "D"), keep(least("v0", "v1", "c3"), "u"), own(least("v0", "v1", "c3"), 2, "R"))}, {least(add("c3", 3, "D"), keep("c2", "a"), own("c2", 2, "R"))}
from (select *, {c2} as c2, {c3} as c3 from scan) s join marked m on s.conv_id is not distinct from m.conv_id and m.position = s.position + 1),
best as (select conv_id, {least("v0", add("v1", 4, "II"), add("v2", 2, "I"), "v3")} as b from scan where position = n),
letters as (select conv_id, unnest(string_split(substr(b, 11), '')) as letter, generate_subscripts(string_split(substr(b, 11), ''), 1) as nth from best where length(b) > 10),
placed as (select *, sum((letter <> 'I')::int) over w as position, sum((letter <> 'D')::int) over w as place, sum((letter <> 'D')::int) over (partition by conv_id) as total from letters window w as (partition by conv_id order by nth)),
told as (select p.conv_id, place, case when letter = 'K' then m.role when (total - place) % 2 = 0 then 'assistant' else 'user' end || ':' || case when letter = 'I' then '' else m.text end as line
from placed p left join marked m on p.conv_id is not distinct from m.conv_id and p.position = m.position where letter <> 'D'),
texts as (select conv_id, sha256(string_agg(line, chr(10) order by place)) as h from told group by 1)
select o.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce((left(b, 10))::bigint, 0) as cost, coalesce(substr(b, 11), '') as audit, coalesce(h, sha256('')) as repaired_sha256
from (select distinct conv_id from conversations) o left join counts c on o.conv_id is not distinct from c.conv_id left join best on o.conv_id is not distinct from best.conv_id left join texts t on o.conv_id is not distinct from t.conv_id"""


def oracle_sql() -> dict[str, str]:
    return {"op11_repair": _op11_sql(), "op12_manifest": OP12_SQL, "op5_warc": OP5_SQL, "op8_embedding_links": OP8_SQL}
