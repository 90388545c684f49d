"""The registered queries of this package, with their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from restock.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return register


TOP_K_SQL = """
with usable as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) v
  from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
hits as (
  select q.vec_id query_id, c.vec_id,
    cast(coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])), 0) as bigint) score
  from usable q join usable c on c.vec_id <> q.vec_id where q.vec_id % 100 = 0)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as "rank",
  vec_id, score
from hits qualify "rank" <= 10"""


@query("op10_block_pruned_top_k", TOP_K_SQL)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    from restock.llm.top_k import top_k

    return top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


@query("op3_token_efficiency_secrets")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    from restock.llm.secret_scan import scan

    return scan(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


DECONTAMINATION_SQL = r"""
with tokens as (
  select 'd' kind, row_number() over () as r, doc_id id,
    regexp_extract_all(translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents
  union all
  select 'b', row_number() over (), item_id,
    regexp_extract_all(translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') from benchmark),
windows as (
  select distinct id item, k, list_slice(w, p, p + k - 1) g
  from (select id, w, least(10, len(w)) k, unnest(generate_series(1, greatest(len(w) - 9, 1))) p
        from tokens where kind = 'b' and len(w) > 0)),
sizes as (select distinct k from windows),
places as (
  select r, k, p, list_slice(w, p, p + k - 1) g
  from (select r, w, k, unnest(generate_series(1, len(w) - k + 1)) p from tokens, sizes where kind = 'd' and len(w) >= k)),
found as (select places.r, places.k, p, item from places join windows on places.k = windows.k and places.g = windows.g),
hits as (select r, count(distinct q) n from (select r, unnest(generate_series(p, p + k - 1)) q
  from (select distinct r, k, p from found)) group by r),
items as (select r, count(*) n, string_agg(i, ',' order by i) l
  from (select distinct r, cast(item as varchar) i from found) group by r)
select id doc_id, cast(len(w) as bigint) n_words, coalesce(hits.n, 0) n_hit, coalesce(items.n, 0) n_items,
  sha256(coalesce(l, '')) items_sha256, coalesce(hits.n, 0) > 0 contaminated
from tokens left join hits on hits.r = tokens.r left join items on items.r = tokens.r where kind = 'd'"""


@query("op9_suffix_array_decontamination", DECONTAMINATION_SQL)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    from restock.llm.decontaminate import contamination

    return contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op5_karmarkar_karp_packing")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    from restock.llm.packing import pack_documents

    return pack_documents(table(spark, folder, "documents"), tokenizer=public_tokenizers.path("word_bpe_49k.json"))


@query("op7_offset_mapped_token_counts")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    from restock.llm.token_counts import count_tokens

    return count_tokens(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


@query("op6_huffman_token_files")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    from restock.llm.id_files import read_ids, write_ids
    from restock.session import staging_path

    path = staging_path(spark, "ids")
    write_ids(table(spark, folder, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return read_ids(spark, path)


@query("op8_site_style_tree")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    from restock.llm.site_tree import extract

    return extract(table(spark, folder, "pages"))


@query("op2_kneser_ney_language")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    from restock.llm.common import fold
    from restock.llm.language_id import learn, predict

    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    held = fold(F.col("doc_id"), 5) == 0
    models = learn(docs, ~held)
    return predict(docs.withColumn("held_out", held), models, keep=("doc_id", "held_out"))


@query("op1_dart_minhash_classes")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    from restock.llm.dart_minhash import classes

    return classes(table(spark, folder, "documents")).select("doc_id", "class_id", "class_size", "kept")


@query("op4_elias_fano_ngram_scores")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    from restock.llm.common import fold
    from restock.llm.ngram_score import score

    return score(table(spark, folder, "documents"), fold(F.col("doc_id"), 7) == 2)


# crc32 of a short ASCII text, bit by bit
_CRC32_SQL = """xor(list_reduce(list_concat([4294967295::bigint], list_transform(generate_series(0, 8 * length({0}) - 1),
  lambda k: cast((ascii({0}[k // 8 + 1]) >> (k % 8)) & 1 as bigint))),
  lambda c, b: xor(c >> 1, (xor(c, b) & 1) * 3988292384)), 4294967295)"""


def _periodic_runs_sql(levels: int = 18) -> str:
    """Runs from names of 2^k words: in a run of period q, the next occurrence of L words, q <= L <= 2q, is q on."""
    names = ["n0 as (select r, i, hash(w) g from words)"]
    for k in range(1, levels):
        names.append(
            f"n{k} as (select r, i, hash(g, next) g from (select r, i, g, lead(g, {1 << k - 1}) over (partition by r order by i) "
            f"as next from n{k - 1}) where next is not null)"
        )
    near = " union all ".join(
        f"select r, d from (select r, lead(i) over (partition by r, g order by i) - i d from n{k}) where d between {(1 << k) / 2} and {1 << k}"
        for k in range(levels)
    )
    crc = _CRC32_SQL.format("coalesce(cast(doc_id as varchar), '')")
    return f"""
with docs as (
  select row_number() over () as r, doc_id, {crc} h,
    regexp_extract_all(coalesce("text", ''), '[^\\x20\\x09-\\x0D]+') w from documents),
planted as (
  select r, doc_id, len(w) n, case when h % 10 = 0 and len(w) > 0 then list_transform(generate_series(0, len(w) - 1), lambda i:
    w[1 + case when i < (h // 10) % len(w) then i
      else (h // 10) % len(w) + (i - (h // 10) % len(w)) % (1 + (len(w) - (h // 10) % len(w)) // (3 + (h // 10) % 8)) end])
    else w end w from docs),
words as materialized (select r, unnest(generate_series(0, n - 1)) i, unnest(w) w from planted),
{", ".join(names)},
periods as (select distinct r, d from ({near})),
equal as (
  select r, d, i, i - row_number() over (partition by r, d order by i) island from (
    select a.r, d, a.i from periods join words a on a.r = periods.r join words b on b.r = a.r and b.i = a.i + d and b.w = a.w)),
runs as (
  select r, min(i) "start", count(*) + d "length", d period from equal group by r, d, island
  having count(*) + d >= greatest(6, 4 * d)
  qualify row_number() over (partition by r, min(i), count(*) + d order by d) = 1),
best as (select r, "start", "length", period, (1000 * "length") // period exponent_milli from runs
  qualify row_number() over (partition by r order by cast("length" as double) / period desc, "start", period) = 1),
summed as (select r, count(*) n_runs, string_agg(concat("start", ',', "length", ',', period, chr(10)), '' order by "start", period) l
  from runs group by r),
gone as (select distinct r, unnest(generate_series("start" + period, "start" + "length" - 1)) i from runs),
kept as (select words.r, string_agg(w, ' ' order by words.i) l from words anti join gone on gone.r = words.r and gone.i = words.i group by words.r)
select doc_id, coalesce(n_runs, 0) n_runs, "start", "length", period, exponent_milli,
  sha256(coalesce(summed.l, '')) runs_sha256, sha256(coalesce(kept.l, '')) collapsed_sha256
from planted left join summed on summed.r = planted.r left join best on best.r = planted.r left join kept on kept.r = planted.r"""


@query("op11_suffix_automaton_runs", _periodic_runs_sql())
def op11(spark: SparkSession, folder: str) -> DataFrame:
    from restock.llm.periodic_runs import detect_runs

    docs = table(spark, folder, "documents")
    h = F.crc32(F.coalesce(docs.doc_id.cast("string"), F.lit("")).cast("binary"))
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    repeated = F.expr(
        "array_join(transform(sequence(0, size(w) - 1), i -> w[int(if(i < g % size(w), i, "
        "g % size(w) + (i - g % size(w)) % (1 + (size(w) - g % size(w)) div (3 + g % 8))))]), ' ')"
    )
    planted = (
        docs.select("doc_id", "text", F.expr("null").alias("w"), F.floor(h / 10).alias("g"), h.alias("h"))
        .withColumn("w", F.when(F.col("h") % 10 == 0, words))
        .select("doc_id", F.when((F.col("h") % 10 == 0) & (F.size("w") > 0), repeated).otherwise(F.col("text")).alias("text"))
    )
    best = (
        "reduce(runs, cast(null as struct<start: bigint, length: bigint, period: bigint>), (b, r) -> "
        "if(b is null or r.length * b.period > b.length * r.period, r, b))"
    )
    listed = "array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')"
    return (
        detect_runs(planted)
        .withColumn("best", F.expr(best))
        .select(
            "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
            F.expr("1000 * best.length div best.period").alias("exponent_milli"),
            F.sha2(F.expr(listed), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
        )
    )


SOURCE_DIVERGENCE_SQL = r"""
with docs as (select row_number() over () as r, coalesce("lang", '') lang, coalesce(source, '') source, coalesce("text", '') t from documents),
hits as (select r, lang, source, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) term from docs),
counts as (select lang, source, term, count(*) n, count(distinct r) d from hits group by all),
kept as (select lang, term, sum(n) n from counts group by all having sum(d) >= 3),
v as (select lang, count(*) v, sum(n) n from kept group by lang),
own as (select c.* from counts c join kept k on k.lang = c.lang and k.term = c.term),
groups as (
  select g.lang, g.source, coalesce(v.v, 0) v, coalesce((select sum(n) from own o where o.lang = g.lang and o.source = g.source), 0) n,
    coalesce(v.n, 0) lang_n
  from (select distinct lang, source from docs) g left join v on v.lang = g.lang),
p as materialized (
  select g.lang, g.source, k.term, coalesce(o.n, 0) n,
    1 + cast(1000000000 * (coalesce(o.n, 0) + 1) // (g.n + g.v) as bigint) p,
    1 + cast(1000000000 * (k.n + 1) // (g.lang_n + g.v) as bigint) q
  from groups g join kept k on k.lang = g.lang left join own o on o.lang = g.lang and o.source = g.source and o.term = k.term),
pairs as (
  select a.lang, a.source, b.source item, sum((a.p - b.p) * (a.p - b.p) // b.p) f
  from p a join p b on b.lang = a.lang and b.term = a.term and b.source <> a.source group by all),
every as (
  select a.lang, a.source, 'pair' part, b.source item, cast(coalesce(f, 0) as bigint) "value"
  from groups a join groups b on b.lang = a.lang and b.source <> a.source
  left join pairs on pairs.lang = a.lang and pairs.source = a.source and pairs.item = b.source
  union all
  select lang, source, 'term', term, cast((p - q) * (p - q) // q as bigint) from p where n > 0 and p > q)
select lang, source, part, item, "value",
  cast(row_number() over (partition by lang, source, part order by "value" desc, item) as int) "rank"
from every qualify part = 'pair' or "rank" <= 200"""


@query("op12_packed_source_divergence", SOURCE_DIVERGENCE_SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    from restock.llm.source_divergence import divergences

    return divergences(table(spark, folder, "documents"))


CURRICULUM_SQL = r"""
with docs as (
  select doc_id, source, len(regexp_extract_all(coalesce("text", ''), '[^\x20\x09-\x0D]+')) size,
    md5(coalesce(cast(doc_id as varchar), '')) "key" from documents),
sizes as (select source, cast(sum(size) as bigint) size from docs group by source),
places as (select *, row_number() over (order by source nulls last) - 1 place from sizes),
shares as (select *, cast([3, 1, 2][place % 3 + 1] as bigint) w, sum(size) over () total from places),
-- twice the words, so that all are whole: the first sources by cap over weight are capped
ranked as (
  select *, coalesce(sum(4 * size) over (o rows between unbounded preceding and 1 preceding), 0) capped,
    sum(w) over (o rows between current row and unbounded following) open_w
  from shares window o as (order by cast(size as double) / w, place)),
level as (select coalesce(min_by(3 * total - capped, capped) , 0) need, coalesce(min_by(open_w, capped), 1) w
  from ranked where 4 * size * open_w >= w * (3 * total - capped) and open_w > 0),
targets as (select source, place, size source_size, shares.w weight,
  least(cast(2 * size as double), cast(shares.w as double) * (cast(need as double) / 2) / cast(level.w as double)) target from shares, level),
laid as (
  select d.*, place, source_size, target, weight,
    cast(coalesce(sum(size) over (partition by d.source order by "key", doc_id, size rows between unbounded preceding and 1 preceding), 0) as bigint) before
  from docs d join targets t on t.source is not distinct from d.source),
copies as (
  select *, cast(greatest(0, least(size, floor(target) - before)) as bigint) first_words,
    cast(greatest(0, least(size, floor(target) - source_size - before)) as bigint) second_words from laid),
filled as (select *, (before + case when first_words > 0 then first_words else second_words end / 2.0::double) / target * weight y from copies)
select doc_id, size, source_size, target, first_words + second_words taken,
  case when first_words + second_words > 0 then least(1.0::double, case place % 3
    when 0 then 2.0::double * y / (4.5::double + sqrt(4.5::double * 4.5::double + -6.0::double * y))
    when 1 then 2.0::double * y / (1.0::double + sqrt(1.0::double * 1.0::double + 0.0::double * y))
    else 2.0::double * y / (1.0::double + sqrt(1.0::double * 1.0::double + 4.0::double * y)) end) end first_position
from filled"""


@query("op13_curriculum_mixture", CURRICULUM_SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    from restock.llm.curriculum import assign_positions, by_first_position

    return by_first_position(assign_positions(table(spark, folder, "documents"))).drop("source")
