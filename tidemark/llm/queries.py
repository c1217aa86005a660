"""The queries opN_<name> over the whole documents table, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, exact_dedup, fill_in_middle, hard_negatives, language_id, maxent_lm, mixing, ngram_join, quality_classifier, quality_rules, substring_dedup, token_histogram, toxicity


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _multi() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op1_token_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_histogram.token_limits(_documents(spark, sf_dir), *_multi())


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades: 0 toxic, 1 neither toxic nor good, 2 good and not toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    grade = F.when(F.col("toxic") == 1, 0).otherwise(F.col("quality") + 1)
    return quality_classifier.selection(_documents(spark, sf_dir), labels.select("doc_id", grade.alias("grade")))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.verdicts(_documents(spark, sf_dir))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predictions(_documents(spark, sf_dir))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(_documents(spark, sf_dir), *_multi())


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(_documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.without_repeats(_documents(spark, sf_dir))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(_documents(spark, sf_dir))


def op10_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent_lm.scores(_documents(spark, sf_dir))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fill_in_middle.transformed(_documents(spark, sf_dir)).withColumn("restored", fill_in_middle.restored())
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, i, label = spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id"), F.col("label")
    return hard_negatives.mined(rows.withColumn("label", F.when(i % 7 == 0, (label + 1) % 10).otherwise(label)), i % 50 == 0)


QUERIES = {f.__name__: f for f in (op1_token_histogram, op2_quality_rules, op3_mixing, op4_language_id, op5_byte_bpe, op6_exact_dedup, op7_quality_classifier, op8_substring_dedup, op9_ngram_join, op10_maxent_lm, op11_fill_in_middle, op12_toxicity, op13_hard_negatives)}

SPACE = r"[\x20\x09-\x0D]"

OP2 = rf"""
with d as (select doc_id, coalesce(text, '') as text, list_filter(string_split_regex(coalesce(text, ''), '{SPACE}+'), lambda x: x <> '') as w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines,
                  row_number() over () as row_id
           from documents),
g as (select row_id, i, w[i] as a, w[i + 1] as b, w[i + 2] as c from (select row_id, w, unnest(range(1, len(w) - 1)) as i from d)),
r as (select row_id, i from (select row_id, i, count(*) over (partition by row_id, a, b, c) as n from g) where n > 1),
p as (select row_id, count(distinct i + k) as n_repeat_words from r, (select unnest([0, 1, 2]) as k) group by row_id),
s as (select doc_id, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars,
             cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
             cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words,
             len(lines) as n_lines, len(list_filter(w, lambda x: suffix(x, '!!'))) as n_shouts
      from d left join p using (row_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
       not (n_words < 50 or 100 * n_repeat_words > 50 * n_words or 100 * n_symbols > 10 * n_words or (n_dup_lines > 2 and 100 * n_dup_lines > 30 * n_lines)
            or word_chars < 2 * n_words or word_chars > 20 * n_words or 100 * n_shouts > 30 * n_words) as kept
from s"""

OP3 = rf"""
with d as (select doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '{SPACE}+'), lambda x: x <> '')) as size,
                  md5('mix:' || coalesce(cast(doc_id as varchar), 'null')) as r from documents),
s as (select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source nulls last) - 1 as place from d group by source),
t as (select *, cast(2 * source_size as double) as cap, cast([3, 1, 2][place % 3 + 1] as double) as weight,
             cast(sum(source_size) over () as double) * 1.5 as wanted from s),
f as (select *, (wanted - coalesce(sum(cap) over (order by cap / weight, place rows between unbounded preceding and 1 preceding), 0))
                / sum(weight) over (order by cap / weight, place rows between current row and unbounded following) as level from t),
l as (select min_by(level, (cap / weight, place)) as level from f where not cap <= weight * level),
g as (select source, source_size, coalesce(least(cap, weight * l.level), cap) as target from f, l),
o as (select d.*, source_size, target, coalesce(sum(size) over (partition by d.source order by r, doc_id, size rows between unbounded preceding and 1 preceding), 0) as before
      from d join g on d.source is not distinct from g.source),
e as (select *, case when source_size > 0 then cast(floor(target) as bigint) // source_size else 0 end as epochs from o)
select doc_id, cast(size as bigint) as size, source_size, target,
       cast(epochs * size + least(size, greatest(0, floor(target) - epochs * source_size - before)) as bigint) as taken
from e"""

OP6 = rf"""
with d as (select doc_id, length(coalesce(text, '')) as points, regexp_replace(coalesce(text, ''), '{SPACE}+', '', 'g') as t from documents),
r as (select *, first_value(doc_id) over w as keep_id, count(*) over (partition by t) as group_size, row_number() over w as place
      from d window w as (partition by t order by points desc, doc_id rows between unbounded preceding and unbounded following))
select doc_id, keep_id, cast(group_size as bigint) as group_size, place = 1 as kept, sha256(t) as text_sha256 from r"""

OP8 = rf"""
with d as (select row_number() over () as row_id, doc_id, list_filter(string_split_regex(coalesce(text, ''), '{SPACE}+'), lambda x: x <> '') as w from documents),
k as (select row_id, doc_id, s, array_to_string(w[s : s + 19], ' ') as g from (select row_id, doc_id, w, unnest(range(1, len(w) - 18)) as s from d)),
l as (select row_id, s, rank() over (partition by g order by doc_id nulls last, s) as i from k),
gone as (select distinct row_id, s + j as place from l, (select unnest(range(0, 20)) as j) where i > 1),
n as (select row_id, count(*) as n from gone group by 1),
kept as (select p.row_id, string_agg(word, ' ' order by p.place) as t from (select row_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as place from d) p anti join gone using (row_id, place) group by 1)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n, 0) as n_removed, sha256(coalesce(t, '')) as kept_sha256 from d left join n using (row_id) left join kept using (row_id)"""

OP9 = rf"""
with recursive d as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{SPACE}+'), lambda x: x <> '') as w from documents),
sh as (select distinct doc_id, array_to_string(w[s : s + 4], ' ') as g from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, least(len(w), 1) + 1))) as s from d)),
n as (select doc_id, count(*) as n from sh group by 1),
o as (select a.doc_id as a, b.doc_id as b, count(*) as i from sh a join sh b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from o join n x on x.doc_id = a join n y on y.doc_id = b where 100 * i >= 80 * (x.n + y.n - i)),
e as (select a, b from l union all select b, a from l),
r as (select a, b from e union select r.a, e.b from r join e on r.b = e.a)
select d.doc_id, coalesce(n.n, 0) as n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) as component_id from d left join n using (doc_id) left join (select a, min(b) as m from r group by 1) on a = d.doc_id"""

OP11 = r"""
with d as (select doc_id, coalesce(text, '') as t, length(coalesce(text, '')) as n, sha256('1:' || coalesce(cast(doc_id as varchar), 'null')) as h from documents),
h as (select *, [cast('0x' || substr(h, 8 * i + 1, 8) as bigint) for i in [0, 1, 2, 3]] as x from d),
p as (select *, least(x[1] % (n + 1), x[2] % (n + 1)) as a, greatest(x[1] % (n + 1), x[2] % (n + 1)) as b,
             case when n = 0 or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or x[3] % 100 >= 90 then 'plain' when x[4] % 100 < 20 then 'spm' else 'psm' end as form from h),
c as (select *, substring(t, 1, a) as prefix, substring(t, a + 1, b - a) as middle, substring(t, b + 1) as suffix from p)
select doc_id, cast(n as bigint) as n, form, case when form <> 'plain' then cast(a as bigint) end as prefix_chars, case when form <> 'plain' then cast(b - a as bigint) end as middle_chars,
       sha256(case form when 'plain' then t when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
       sha256(t) as restored_sha256
from c"""

OP13 = """
with r as (select vec_id as id, row_number() over () as k, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v
           from embeddings where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.k as q, a.id as anchor_id, b.k, b.id, a.label = b.label as same, cast(list_dot_product(a.v, b.v) as bigint) as score from r a join r b on a.id % 50 = 0 and a.k <> b.k),
p as (select q, anchor_id, k as pk, id as positive_id, score as positive_score from s where same qualify row_number() over (partition by q order by score desc, id, k) <= 5),
n as (select p.*, s.id as negative_id, s.score as negative_score, row_number() over (partition by p.q, p.pk order by s.score desc, s.id, s.k) as rank
      from p join s on s.q = p.q and not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score)
select anchor_id, positive_id, cast(rank as int) as rank, negative_id, positive_score, negative_score from n where rank <= 3"""

ORACLES = {"op13_hard_negatives": OP13, "op11_fill_in_middle": OP11, "op8_substring_dedup": OP8, "op9_ngram_join": OP9, "op6_exact_dedup": OP6, "op2_quality_rules": OP2, "op3_mixing": OP3}
